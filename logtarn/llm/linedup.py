"""Line deduplication over levelled sorted runs of line hashes.

A run is a table of line keys (128-bit hashes), bucketed and sorted by key, with the number of
documents that hold a key and the document that keeps its lines. Documents come in batches, the
largest ids first. A new batch sums up its keys, merge-joins them with every run without shuffling
the runs, and adds a run of its own: keys that the runs lack (the anti-join) get the batch's largest
holder as keeper, known ones only add to their count. When a level has enough runs they are merged
into one of the next level, so a batch meets few runs. A single merge at the end gives the frequent
keys, whose lines go from all documents but the keeper.

Work follows keys, never groups: a key has one row in each run, whoever holds it. Keys of a large
share of all holders are at most ``HOT_KEYS`` by construction and are looked up by broadcast; each
of the others has at most that share of one join. Runs are written tables in the shared folder, so
a lost executor repeats its tasks only.

Null or empty text is one empty line. Each row is a document of its own, also where rows share an
id; rows that share id and text are cut alike. A row without ``doc_id`` counts as below all ids: its
lines go if any row with an id holds them, and stay where only such rows do. ``doc_id`` is a number.
Lines of any length are hashed whole. Other columns, whatever their names, stay as they are.
"""

import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from logtarn.llm.registry import registered, table
from logtarn.llm.stored import stored, unused
from logtarn.llm.textbytes import pieces
from logtarn.session import work_area

SPACE = b" \t\n\x0b\x0c\r"
#: Keys with over this part of all holders are joined by broadcast; there can be no more of them.
HOT_KEYS = 4096
KEY = ["h1", "h2"]
ROW = ["doc_id", "t1", "t2"]


@dataclass(frozen=True)
class Setting:
    """Keys of ``least_chars`` in ``least_documents`` lose their lines. Documents come in
    ``batches``; ``fan_in`` runs of a level are merged into one of the next."""

    least_chars: int = 20
    least_documents: int = 3
    batches: int = 4
    fan_in: int = 2


def line_keys(text: str | None, least_chars: int) -> dict[bytes, list[int]]:
    """The hash of each different key of a text that counts, and the positions of its lines."""
    from xxhash import xxh3_128_digest

    found: dict[bytes, list[int]] = {}
    for position, line in enumerate((text or "").encode().split(b"\n")):
        # bytes.lower() changes A-Z only.
        key = line.strip(SPACE).lower()
        if len(key) >= least_chars and (key.isascii() or len(key.decode()) >= least_chars):
            found.setdefault(xxh3_128_digest(key), []).append(position)
    return found


def keyed_lines(docs: DataFrame, setting: Setting = Setting()) -> DataFrame:
    """A row for each document and different key: id and hash of the row, key, line positions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 3):
            rows, digests, positions = [], [], []
            for row, text in enumerate(batch.column(3).to_pylist()):
                for digest, at in line_keys(text, setting.least_chars).items():
                    rows.append(row)
                    digests.append(digest)
                    positions.append(at)
            keys = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
            of = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    *[batch.column(c).take(of) for c in range(3)],
                    pa.array(np.ascontiguousarray(keys[:, 0])), pa.array(np.ascontiguousarray(keys[:, 1])),
                    pa.array(positions, pa.list_(pa.int32())),
                ],
                [*ROW, *KEY, "positions"],
            )

    ids = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {ids}, t1 long, t2 long, h1 long, h2 long, positions array<int>"
    return named_rows(docs).select(*ROW, "text").mapInArrow(run, schema)


def named_rows(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``text`` and two independent hashes of the text, which tell rows of one id apart."""
    return docs.select(
        "doc_id", "text", F.xxhash64("text").alias("t1"), F.xxhash64(F.lit(1), "text").alias("t2")
    )


@dataclass
class LineRuns:
    """The runs by level, the newest level first. Batches come by falling ids."""

    spark: SparkSession
    setting: Setting = Setting()
    levels: list[list[str]] = field(default_factory=list)

    def add(self, lines: DataFrame) -> None:
        """Take a batch of :func:`keyed_lines`, whose ids are below those of all batches before."""
        keys = lines.groupBy(*KEY).agg(
            F.count(F.lit(1)).alias("holders"), F.max("doc_id").alias("largest")
        )
        runs = [run for level in self.levels for run in level]
        for k, run in enumerate(runs):
            known = self.spark.table(run).select(*KEY, F.lit(True).alias(f"known{k}"))
            keys = keys.hint("merge").join(known, KEY, "left")
        new = F.lit(True)
        for k in range(len(runs)):
            new = new & F.col(f"known{k}").isNull()
        self._put(0, keys.select(*KEY, "holders", F.when(new, F.col("largest")).alias("keeper")))

    def merged(self) -> DataFrame | None:
        """All keys, a row each; None before the first batch."""
        runs = [run for level in self.levels for run in level]
        if len(runs) > 1:
            self._merge(len(self.levels) - 1)
            runs = [run for level in self.levels for run in level]
        return self.spark.table(runs[0]) if runs else None

    def _put(self, level: int, keys: DataFrame) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(self._written(keys))
        if len(self.levels[level]) >= self.setting.fan_in:
            self._merge(level)

    def _merge(self, level: int) -> None:
        """Make one run of those up to a level, and put it into the next."""
        runs = [run for below in self.levels[: level + 1] for run in below]
        together = self.spark.table(runs[0])
        for run in runs[1:]:
            # Both sides lie in the same buckets: a merge of sorted rows, nothing is shuffled.
            other = self.spark.table(run).toDF(*KEY, "more", "kept")
            together = together.hint("merge").join(other, KEY, "full").select(
                *KEY,
                (F.coalesce("holders", F.lit(0)) + F.coalesce("more", F.lit(0))).alias("holders"),
                F.greatest("keeper", "kept").alias("keeper"),
            )
        self.levels[: level + 1] = [[] for _ in range(level + 1)]
        self._put(level + 1, together)
        for run in runs:
            self.spark.sql(f"DROP TABLE {run}")

    def _written(self, keys: DataFrame) -> str:
        """Store a run; as many buckets as a shuffle has parts, so that joins take it as it lies."""
        name = f"line_run_{uuid.uuid4().hex}"
        buckets = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        (
            keys.write.format("parquet").bucketBy(buckets, *KEY).sortBy(*KEY)
            .option("path", work_area(self.spark, "line-run")).saveAsTable(name)
        )
        return name


def _batches(lines: DataFrame, batches: int) -> list[DataFrame]:
    """The rows by ranges of ids with about equal numbers of lines, the largest ids first."""
    shares = [k / batches for k in range(batches - 1, 0, -1)]
    cuts = lines.agg(F.percentile_approx("doc_id", shares, 10_000)).first()[0] if shares else None
    parts, above = [], None
    for cut in [*dict.fromkeys(cuts or []), None]:
        within = F.lit(True) if cut is None else F.col("doc_id") > cut
        if above is not None:
            within = within & (F.col("doc_id") <= above)
        if cut is None:
            within = within | F.col("doc_id").isNull()
        parts.append(lines.where(within))
        above = cut
    return parts


def repeated_lines(docs: DataFrame, setting: Setting = Setting()) -> DataFrame:
    """``doc_id``, ``t1``, ``t2`` and the ``positions`` of the lines to drop, where there are any."""
    spark = docs.sparkSession
    lines = stored(keyed_lines(docs, setting), "line-keys")
    runs = LineRuns(spark, setting)
    for batch in _batches(lines, setting.batches):
        runs.add(batch)
    keys = runs.merged()
    holders = keys.agg(F.sum("holders")).first()[0] or 0
    frequent = keys.where(
        (F.col("holders") >= setting.least_documents) & F.col("keeper").isNotNull()
    ).select(*KEY, "keeper", (F.col("holders") * HOT_KEYS > holders).alias("hot"))
    hot = frequent.where("hot").select(*KEY, F.col("keeper").alias("hot_keeper"))
    rest = frequent.where("NOT hot").select(
        F.col("h1").alias("j1"), F.col("h2").alias("j2"), "keeper"
    )
    # What is decided by broadcast joins on by a hash of its row: spread out, and matching nothing.
    spread = F.xxhash64("doc_id", "t1")
    looked = lines.join(F.broadcast(hot), KEY, "left").withColumns({
        "j1": F.when(F.col("hot_keeper").isNull(), F.col("h1")).otherwise(spread),
        "j2": F.when(F.col("hot_keeper").isNull(), F.col("h2")).otherwise(F.col("t2")),
    })
    keeper = F.coalesce(F.col("hot_keeper"), F.col("keeper"))
    dropped = looked.join(rest, ["j1", "j2"], "left").where(
        keeper.isNotNull() & (F.col("doc_id").isNull() | (F.col("doc_id") < keeper))
    )
    return dropped.groupBy(*ROW).agg(F.flatten(F.collect_set("positions")).alias("positions"))


def without_repeated_lines(docs: DataFrame, setting: Setting = Setting()) -> DataFrame:
    """The documents with the lines that stay as ``text``, and two columns more: the number of lines
    there were and of those dropped, ``n_lines`` and ``n_dropped`` unless there are such columns."""
    columns = [F.col(f"d.{_quoted(c)}") for c in docs.columns]
    counts = [unused("n_lines", docs.columns), unused("n_dropped", docs.columns)]
    inner = [unused(name, docs.columns) for name in ("t1", "t2", "positions")]
    found = repeated_lines(docs, setting).alias("f")
    rows = docs.withColumns({
        inner[0]: F.xxhash64("text"), inner[1]: F.xxhash64(F.lit(1), "text"),
    }).alias("d")
    joined = rows.join(
        found,
        F.col("d.doc_id").eqNullSafe(F.col("f.doc_id"))
        & (F.col(f"d.{inner[0]}") == F.col("f.t1"))
        & (F.col(f"d.{inner[1]}") == F.col("f.t2")),
        "left",
    ).select(*columns, F.col("f.positions").alias(inner[2]))
    at, last = docs.columns.index("text"), len(docs.columns)
    names = [*docs.columns, *counts]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, at):
            texts, lines, gone = [], [], []
            for text, positions in zip(
                batch.column(at).to_pylist(), batch.column(last).to_pylist(), strict=True
            ):
                each = (text or "").split("\n")
                drop = set(positions or ())
                texts.append("\n".join(x for k, x in enumerate(each) if k not in drop) if drop else text)
                lines.append(len(each))
                gone.append(len(drop))
            kept = list(batch.columns[:last])
            kept[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(
                [*kept, pa.array(lines, pa.int64()), pa.array(gone, pa.int64())], names
            )

    added = [StructField(name, LongType()) for name in counts]
    return joined.mapInArrow(run, StructType([*docs.schema.fields, *added]))


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


SQL = r"""
WITH docs AS (SELECT row_number() OVER () AS row, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
each AS (
    SELECT row, doc_id, unnest(lines) AS line, unnest(range(1, len(lines) + 1)) AS position FROM docs
),
keyed AS (
    SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
    FROM each
),
frequent AS (
    SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 20
    GROUP BY key HAVING count(DISTINCT row) >= 3
),
marked AS (
    SELECT row, line, position, keeper IS NOT NULL AND (doc_id IS NULL OR doc_id < keeper) AS dropped
    FROM keyed LEFT JOIN frequent USING (key)
),
cut AS (
    SELECT row, count(*) AS n_lines, count(*) FILTER (dropped) AS n_dropped,
        string_agg(line, chr(10) ORDER BY position) FILTER (NOT dropped) AS kept
    FROM marked GROUP BY row
)
SELECT doc_id, n_lines, n_dropped, sha256(coalesce(kept, '')) AS kept_sha256 FROM docs JOIN cut USING (row)
"""


@registered(SQL)
def op13_linedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What line deduplication leaves of each document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return without_repeated_lines(docs).select(
        "doc_id", "n_lines", "n_dropped",
        F.sha2(F.coalesce(F.col("text"), F.lit("")), 256).alias("kept_sha256"),
    )

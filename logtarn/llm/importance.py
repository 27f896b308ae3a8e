"""Importance resampling towards a target distribution of hashed n-grams.

Words and their byte offsets come from the pre-tokeniser of ``tokenizers``, an untrained split by a
regular expression over ASCII-lowered text. Windows of one to three words are pairs of offsets;
their CRC-32, carried on from word to word in numpy, is their bucket. Each text is tokenised once:
the buckets of its windows are stored, in two bytes each, histograms of both corpora give the gain
of each bucket, and a document's weight is the sum of the gains of its windows. Gumbel noise from a
hash of the id turns weights into a weighted draw without replacement.

Only the histograms, of a fixed number of buckets, and the row counts of the files of the ranking
meet on the driver. The ranking is a sort by ranges, numbered by file and row, so no task sees more
than its range however equal the scores.

Null or empty text has no words. A row without ``doc_id`` has no noise, hence no score: it neither
counts among those drawn from nor is drawn, its windows count like any other's. Rows may repeat;
each is scored and drawn alone, equal ones in any order among themselves. An empty target or corpus
has an empty histogram. Other columns are not read.
"""

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logtarn.llm.registry import registered, table
from logtarn.llm.stored import stored
from logtarn.llm.textbytes import ASCII_LOWER, pieces, utf8

#: Fixed value: what lies between words.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Text is split for the tokeniser at separators after about so many bytes.
CHUNK_BYTES = 1 << 16
#: Longer words are hashed one by one, shorter ones a byte of all words at a time.
LONG_WORD = 48


@dataclass(frozen=True)
class Setting:
    """Windows of up to ``orders`` words fall into ``buckets``; ``percent`` of the documents of at
    least ``least_words`` words are drawn."""

    orders: int = 3
    buckets: int = 10_000
    percent: int = 5
    least_words: int = 20
    seed: int = 42


def _crc_table() -> np.ndarray:
    """CRC-32 of each byte, reflected, before the outer inversions."""
    values = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        values = np.where(values & 1, (values >> 1) ^ np.uint32(0xEDB88320), values >> 1)
    return values


CRC = _crc_table()


def _space(crc: np.ndarray) -> np.ndarray:
    """The CRC of each string with a space behind it."""
    state = ~crc
    return ~(CRC[(state ^ np.uint32(32)) & np.uint32(255)] ^ (state >> np.uint32(8)))


def crc_on(crc: np.ndarray, data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The CRC of each string with the bytes ``data[begin:end]`` behind it."""
    length = end - begin
    order = np.argsort(-length, kind="stable")
    out = crc.copy()
    long = int(np.count_nonzero(length > LONG_WORD))
    for at in order[:long]:
        out[at] = zlib.crc32(data[begin[at] : end[at]], int(crc[at]))
    order = order[long:]
    state, start = ~crc[order], begin[order]
    # Longest first, so that those which still have a byte are always in front.
    having = np.searchsorted(-length[order], -np.arange(LONG_WORD), "left")
    for k, count in enumerate(having):
        if not count:
            break
        part = state[:count]
        state[:count] = CRC[(part ^ data[start[:count] + k]) & np.uint32(255)] ^ (part >> np.uint32(8))
    out[order] = ~state
    return out


def _chunks(data: np.ndarray, between: np.ndarray, begin: int, end: int) -> Iterator[tuple[int, int]]:
    """A text in parts of about ``CHUNK_BYTES`` that end before a separator."""
    while end - begin > CHUNK_BYTES:
        at = int(np.searchsorted(between, begin + CHUNK_BYTES))
        stop = int(between[at]) if at < len(between) and between[at] < end else end
        yield begin, stop
        begin = stop
    yield begin, end


def words_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The lowered bytes of all texts, begin and end of each word in them, and each word's text."""
    from tokenizers import PreTokenizedString, Regex, pre_tokenizers

    split = pre_tokenizers.Split(Regex(SEPARATORS), "removed")
    data, ends = utf8(column)
    data = ASCII_LOWER[data]
    between = np.flatnonzero((data == 32) | (data == 10)) if len(data) > CHUNK_BYTES else np.empty(0, int)
    spans, counts = [], np.zeros(len(ends) - 1, np.int64)
    for row in range(len(ends) - 1):
        for begin, end in _chunks(data, between, int(ends[row]), int(ends[row + 1])):
            text = PreTokenizedString(data[begin:end].tobytes().decode())
            split.pre_tokenize(text)
            found = [offsets for _, offsets, _ in text.get_splits("original", "byte")]
            if found:
                spans.append(np.array(found, np.int64) + begin)
                counts[row] += len(found)
    words = np.concatenate(spans) if spans else np.empty((0, 2), np.int64)
    return data, words[:, 0], words[:, 1], np.repeat(np.arange(len(counts)), counts)


def window_buckets(column: pa.Array, setting: Setting) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The number of words of each text, and text and bucket of each of its windows."""
    data, begin, end, text = words_of(column)
    texts, buckets = [], []
    crc = np.zeros(len(begin), np.uint32)
    for n in range(1, setting.orders + 1):
        # The window that starts at each word, one word longer than before.
        last = len(begin) - n + 1
        if last <= 0:
            break
        if n > 1:
            crc = _space(crc[:last])
        crc = crc_on(crc, data, begin[n - 1 :], end[n - 1 :])
        within = text[:last] == text[n - 1 :]
        texts.append(text[:last][within])
        buckets.append(crc[within] % np.uint32(setting.buckets))
    if not texts:
        return np.zeros(len(column), np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    of, bucket = np.concatenate(texts), np.concatenate(buckets)
    order = np.argsort(of, kind="stable")
    return np.bincount(text, minlength=len(column)), of[order], bucket[order].astype(np.int64)


def bucketed(docs: DataFrame, setting: Setting = Setting()) -> DataFrame:
    """``doc_id``, ``n_words``, ``n_features`` and ``buckets``, two or four bytes for each window."""
    width = np.dtype("<u2") if setting.buckets <= 1 << 16 else np.dtype("<u4")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 1):
            words, of, bucket = window_buckets(batch.column(1), setting)
            ends = np.searchsorted(of, np.arange(batch.num_rows + 1))
            packed = bucket.astype(width)
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column(0),
                "n_words": pa.array(words.astype(np.int64)),
                "n_features": pa.array(np.diff(ends)),
                "buckets": pa.array(
                    [packed[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)], pa.binary()
                ),
            })

    ids = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {ids}, n_words long, n_features long, buckets binary"
    )


def _unpacked(column: pa.Array, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """All buckets end to end, and the row of each."""
    width = np.dtype("<u2") if buckets <= 1 << 16 else np.dtype("<u4")
    rows = [np.frombuffer(value, width) for value in column.to_pylist()]
    row = np.repeat(np.arange(len(rows)), [len(value) for value in rows])
    return (np.concatenate(rows) if rows else np.empty(0, width)).astype(np.int64), row


def histogram(windows: DataFrame, setting: Setting = Setting()) -> list[int]:
    """How many windows fall into each bucket; tasks sum up theirs first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(setting.buckets, np.int64)
        for batch in batches:
            counts += np.bincount(_unpacked(batch.column(0), setting.buckets)[0], minlength=setting.buckets)
        held = np.flatnonzero(counts)
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(held), "n": pa.array(counts[held])})

    summed = windows.select("buckets").mapInArrow(run, "bucket long, n long")
    total = [0] * setting.buckets
    for row in summed.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        total[row.bucket] = row.n
    return total


def gains(source: list[int], target: list[int]) -> list[int]:
    """What a window in each bucket adds to a weight: how much likelier the target makes it.

    In thousandths of a natural logarithm, rounded down; one is added to each count.
    """
    buckets, all_source, all_target = len(source), sum(source), sum(target)
    return [
        math.floor(1000 * math.log(
            (t + 1.0) * (all_source + float(buckets)) / ((s + 1.0) * (all_target + float(buckets)))
        ))
        for s, t in zip(source, target, strict=True)
    ]


def weighed(windows: DataFrame, gain: list[int], setting: Setting = Setting()) -> DataFrame:
    """``weight`` and ``score`` of each row of :func:`bucketed`, without the buckets."""
    table = np.array(gain, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            start = 0
            sizes = np.asarray(batch.column(2))
            while start < batch.num_rows:  # a few million windows at a time
                stop = start + max(1, int(np.searchsorted(np.cumsum(sizes[start:]), 1 << 21, "right")))
                part = batch.slice(start, stop - start)
                bucket, row = _unpacked(part.column(3), setting.buckets)
                weight = np.zeros(part.num_rows, np.int64)
                np.add.at(weight, row, table[bucket])
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:3], pa.array(weight)], ["doc_id", "n_words", "n_features", "weight"]
                )
                start = stop

    ids = windows.schema["doc_id"].dataType.simpleString()
    found = windows.mapInArrow(run, f"doc_id {ids}, n_words long, n_features long, weight long")
    named = F.sha2(F.concat(F.lit(f"{setting.seed}:"), F.col("doc_id").cast("string")), 256)
    h = F.conv(F.substring(named, 1, 8), 16, 10).cast("double")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0)))
    return found.withColumn("score", F.col("weight") + noise)


def drawn(scored: DataFrame, setting: Setting = Setting()) -> DataFrame:
    """``rank`` of those with the highest scores, null for the rest. ``scored`` is a written table."""
    spark = scored.sparkSession
    eligible = F.col("score").isNotNull() & (F.col("n_words") >= setting.least_words)
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # Rows alike in all else are told apart by their place, so that no range holds more than its share.
    order = [F.desc("score"), F.asc("doc_id"), F.asc("n_features")]
    ordered = stored(
        scored.where(eligible).withColumn("place", F.monotonically_increasing_id())
        .repartitionByRange(ranges, *order, F.asc("place"))
        .withColumn("range", F.spark_partition_id())
        .sortWithinPartitions("range", *order, "place").drop("place"),
        "ranking",
    ).select("*", F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("at"))

    # Files in the order of their ranges: one each, more only if the session limits their rows.
    files = ordered.groupBy("range", "file").agg(F.count(F.lit(1)).alias("n")).orderBy("range", "file").collect()
    total = sum(file.n for file in files)
    before, starts = 0, []
    for file in files:
        starts.append((file.file, before))
        before += file.n
    starts = spark.createDataFrame(starts, "file string, start long")
    rank = F.col("start") + F.col("at") + 1
    rank = F.when(rank <= setting.percent * total // 100, rank)
    ranked = ordered.join(F.broadcast(starts), "file").withColumn("rank", rank)
    columns = [c for c in scored.columns]
    rest = scored.where(~F.coalesce(eligible, F.lit(False))).withColumn("rank", F.lit(None).cast("long"))
    return ranked.select(*columns, "rank").union(rest.select(*columns, "rank"))


def resampled(docs: DataFrame, target: DataFrame, setting: Setting = Setting()) -> DataFrame:
    """``doc_id``, ``n_words``, ``n_features``, ``weight``, ``score`` and ``rank`` of each document.

    ``target`` is a table with the ``text`` of the target distribution.
    """
    source = stored(bucketed(docs, setting), "windows")
    aim = bucketed(target.select(F.lit(None).cast("long").alias("doc_id"), "text"), setting)
    gain = gains(histogram(source, setting), histogram(aim, setting))
    return drawn(stored(weighed(source, gain, setting), "scored"), setting)


#: CRC-32 of each different window by a table made from the polynomial; sizes as in :class:`Setting`.
SQL = r"""
WITH RECURSIVE steps(byte, step, value) AS (
    SELECT b::BIGINT, 0, b::BIGINT FROM range(256) AS t(b)
    UNION ALL
    SELECT byte, step + 1, CASE WHEN value & 1 = 1 THEN xor(value >> 1, 3988292384) ELSE value >> 1 END
    FROM steps WHERE step < 8
),
crc AS (SELECT list(value ORDER BY byte) AS entries FROM steps WHERE step = 8),
texts AS (
    SELECT row_number() OVER () AS row, 's' AS side, doc_id, text FROM documents
    UNION ALL SELECT row_number() OVER (), 't', NULL, text FROM benchmark
),
tokens AS (
    SELECT row, side, doc_id, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
    FROM texts
),
features AS (
    SELECT row, side, array_to_string(words[i : i + n - 1], ' ') AS feature FROM (
        SELECT row, side, words, n, unnest(range(1, len(words) - n + 2)) AS i
        FROM tokens, (VALUES (1), (2), (3)) AS sizes(n) WHERE len(words) >= n)
),
different AS (SELECT DISTINCT feature FROM features),
bytes AS (
    SELECT feature, list_prepend(4294967295, list_transform(
        range(1, octet_length(encode(feature)) + 1),
        lambda k: ('0x' || substr(hex(encode(feature)), 2 * k - 1, 2))::BIGINT)) AS codes
    FROM different
),
bucket AS (
    SELECT feature, xor(4294967295, list_reduce(codes,
        lambda state, code: xor(state >> 8, entries[(xor(state, code) & 255) + 1]))) % 10000 AS bucket
    FROM bytes, crc
),
windows AS (SELECT row, side, bucket FROM features JOIN bucket USING (feature)),
counts AS (
    SELECT bucket, count(*) FILTER (side = 's') AS s, count(*) FILTER (side = 't') AS t
    FROM windows GROUP BY bucket
),
totals AS (SELECT sum(s)::DOUBLE AS all_s, sum(t)::DOUBLE AS all_t FROM counts),
gain AS (
    SELECT bucket, floor(1000 * ln((t + 1.0::DOUBLE) * (all_s + 10000) / ((s + 1.0::DOUBLE) * (all_t + 10000))))::BIGINT
        AS gain
    FROM counts, totals
),
weights AS (
    SELECT row, count(*) AS n_features, sum(gain)::BIGINT AS weight
    FROM windows JOIN gain USING (bucket) WHERE side = 's' GROUP BY row
),
scored AS (
    SELECT doc_id, len(words) AS n_words, coalesce(n_features, 0) AS n_features,
        coalesce(weight, 0) AS weight,
        coalesce(weight, 0) + floor(-1000 * ln(-ln(
            (('0x' || sha256('42:' || doc_id)[1:8])::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
    FROM tokens LEFT JOIN weights USING (row) WHERE side = 's'
),
ranked AS (
    SELECT *, row_number() OVER (PARTITION BY n_words >= 20 AND score IS NOT NULL ORDER BY score DESC, doc_id) AS place,
        count(*) FILTER (n_words >= 20 AND score IS NOT NULL) OVER () AS n
    FROM scored
)
SELECT doc_id, n_features, weight, score,
    CASE WHEN n_words >= 20 AND score IS NOT NULL AND place <= 5 * n // 100 THEN place END AS rank
FROM ranked
"""


@registered(SQL)
def op11_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents drawn towards the distribution of the benchmark's words."""
    found = resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_features", "weight", "score", "rank")

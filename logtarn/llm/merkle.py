"""WARC fixity audit: hash trees over ordered offset ranges of two replicas.

Leaves are fixed ranges of offsets, hashed over their records' offsets, lengths and digests in
order; an upper node hashes up to ``FANOUT`` nodes below it. Replicas are compared at their roots,
and only the branches that differ are read further down, to the records that are changed, missing
or extra. Each level is a join on what differed above, so sound archives cost one row per file.

No node gathers more than ``FANOUT`` children or the records that begin within ``SPAN`` bytes, so
a file with a third of all records is spread like any other. Records without a file share one
nameless file. Null payloads count as empty; equal records at one offset are one. A record that
has another length in one replica moves those behind it: they are missing at one offset and extra
at another. Pages without an id are dealt to files by a hash; equal ones lie in one file.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from logtarn.llm.registry import registered, table
from logtarn.llm.stored import stored

SPAN = 1 << 16
FANOUT = 16
PAGES_PER_FILE = 1000


def _hash_of(parts: Column) -> Column:
    return F.sha2(F.concat_ws("\n", parts), 256)


def hash_tree(records: DataFrame) -> DataFrame:
    """``level``, ``file``, ``node``, ``hash`` of all nodes; level 0 are the offset ranges.

    ``records`` has ``file``, ``start`` (the offset), ``length`` and ``digest``.
    """
    line = F.concat_ws(":", F.col("start").cast("string"), F.col("length").cast("string"), "digest")
    leaves = stored(
        records.groupBy(F.coalesce("file", F.lit("")).alias("file"), F.floor(F.col("start") / SPAN).alias("node"))
        .agg(_hash_of(F.transform(F.array_sort(F.collect_set(F.struct("start", line.alias("line")))), lambda r: r["line"])).alias("hash")),
        "leaves",
    )
    tree = level = leaves.select(F.lit(0).alias("level"), "file", "node", "hash")
    for depth in range(1, _levels(leaves) + 1):
        child = F.struct("node", F.concat_ws(":", F.col("node").cast("string"), "hash").alias("line"))
        level = stored(
            level.groupBy(F.lit(depth).alias("level"), "file", F.floor(F.col("node") / FANOUT).alias("up"))
            .agg(_hash_of(F.transform(F.array_sort(F.collect_list(child)), lambda c: c["line"])).alias("hash"))
            .select("level", "file", F.col("up").alias("node"), "hash"),
            "level",
        )
        tree = tree.union(level)
    return tree


def _levels(leaves: DataFrame) -> int:
    last = leaves.agg(F.max("node")).first()[0] or 0
    levels = 0
    while last:
        last //= FANOUT
        levels += 1
    return levels


def differing(one: DataFrame, other: DataFrame) -> DataFrame:
    """``file`` and ``node`` of the offset ranges whose records differ, found from the roots down."""
    top = max(t.agg(F.max("level")).first()[0] or 0 for t in (one, other))
    suspects = None
    for level in range(top, -1, -1):
        sides = []
        for tree, name in ((one, "one"), (other, "other")):
            nodes = tree.where(F.col("level") == level).select("file", "node", F.col("hash").alias(name))
            if suspects is not None:
                above = suspects.select("file", F.col("node").alias("up"))
                nodes = nodes.withColumn("up", F.floor(F.col("node") / FANOUT))
                nodes = nodes.join(above, ["file", "up"], "left_semi").drop("up")
            sides.append(nodes)
        pairs = sides[0].join(sides[1], ["file", "node"], "full")
        suspects = stored(pairs.where(~F.col("one").eqNullSafe(F.col("other"))).select("file", "node"), "suspects")
    return suspects


def audit(one: DataFrame, other: DataFrame) -> DataFrame:
    """``file``, ``start``, ``one`` and ``other`` (length and digest) and ``status`` of the records
    that differ between two replicas: changed, missing (in the other) or extra."""
    ranges = differing(hash_tree(one), hash_tree(other))

    def suspicious(records: DataFrame, name: str) -> DataFrame:
        return (
            records.select(
                F.coalesce("file", F.lit("")).alias("file"),
                F.floor(F.col("start") / SPAN).alias("node"),
                "start",
                F.struct("length", "digest").alias(name),
            )
            .join(ranges, ["file", "node"], "left_semi")
            .distinct()
        )

    pairs = suspicious(one, "one").join(suspicious(other, "other"), ["file", "node", "start"], "full")
    return pairs.where(~F.col("one").eqNullSafe(F.col("other"))).select(
        "file", "start", "one", "other",
        F.when(F.col("other").isNull(), "missing").when(F.col("one").isNull(), "extra")
        .otherwise("changed").alias("status"),
    )


def archived(pages: DataFrame, payload: Column | str = "html") -> DataFrame:
    """Pages as response records of WARC files of some pages each, with offsets, by page id.

    The declared length is that of ``html``; the bytes are those of ``payload``.
    """
    payload = F.coalesce(F.col(payload) if isinstance(payload, str) else payload, F.lit(""))
    record = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: response\r\nWARC-Target-URI: "),
        F.coalesce("url", F.lit("")),
        F.lit("\r\nContent-Length: "),
        F.octet_length(F.coalesce("html", F.lit(""))).cast("string"),
        F.lit("\r\n\r\n"),
        payload,
        F.lit("\r\n\r\n"),
    )
    without_id = -(-pages.where("page_id IS NULL").count() // PAGES_PER_FILE)
    number = F.coalesce(
        F.floor(F.col("page_id") / PAGES_PER_FILE).cast("string"),
        F.concat(F.lit("none-"), F.pmod(F.xxhash64("url", "html"), F.lit(max(without_id, 1))).cast("string")),
    )
    offsets = pages.select(
        "page_id",
        F.concat(F.lit("pages-"), number, F.lit(".warc")).alias("file"),
        F.octet_length(record).cast("long").alias("length"),
        F.sha2(record, 256).alias("digest"),
    )
    before = W.partitionBy("file").orderBy("page_id", "digest").rowsBetween(W.unboundedPreceding, -1)
    return offsets.withColumn("start", F.coalesce(F.sum("length").over(before), F.lit(0)))


def _damaged() -> Column:
    """The payload as the second replica has it: some overwritten at their begin, a few cut in half."""
    html = F.coalesce("html", F.lit(""))
    return (
        F.when(F.col("page_id") % 97 == 13, F.concat(F.lit("#"), F.substr(html, F.lit(2))))
        .when(F.col("page_id") % 3001 == 1500, F.substr(html, F.lit(1), F.floor(F.length(html) / 2).cast("int")))
        .otherwise(html)
    )


def _without(records: DataFrame, every: int, at: int) -> DataFrame:
    """A replica that has lost some records."""
    return records.where(~F.coalesce(F.col("page_id") % every == at, F.lit(False)))


@registered("""
WITH page AS (
  SELECT page_id, floor(coalesce(page_id, 0) / 1000) AS f, coalesce(html, '') AS html,
    'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Target-URI: '
    || coalesce(url, '') || chr(13) || chr(10) || 'Content-Length: ' || CAST(strlen(coalesce(html, '')) AS VARCHAR)
    || chr(13) || chr(10) || chr(13) || chr(10) AS head, chr(13) || chr(10) || chr(13) || chr(10) AS tail
  FROM pages),
record AS (
  SELECT page_id, 'pages-' || CAST(CAST(f AS BIGINT) AS VARCHAR) || '.warc' AS file, head || html || tail AS a,
    head || CASE WHEN page_id % 97 = 13 THEN '#' || substr(html, 2)
      WHEN page_id % 3001 = 1500 THEN substr(html, 1, length(html) // 2) ELSE html END || tail AS b
  FROM page),
placed AS (
  SELECT page_id, file, strlen(a) AS la, strlen(b) AS lb, sha256(a) AS da, sha256(b) AS db,
    coalesce(sum(strlen(a)) OVER before, 0) AS sa, coalesce(sum(strlen(b)) OVER before, 0) AS sb
  FROM record
  WINDOW before AS (PARTITION BY file ORDER BY page_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
one AS (SELECT file, sa AS start, la, da FROM placed WHERE page_id % 503 <> 11),
other AS (SELECT file, sb AS start, lb, db FROM placed WHERE page_id % 211 <> 7)
SELECT file, CAST(start AS BIGINT) AS start, CAST(coalesce(la, lb) AS BIGINT) AS length,
  CASE WHEN lb IS NULL THEN 'missing' WHEN la IS NULL THEN 'extra' ELSE 'changed' END AS status
FROM one FULL JOIN other USING (file, start)
WHERE la IS NULL OR lb IS NULL OR la <> lb OR da <> db
""")
def op2_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records that differ between two replicas of the archived pages.

    Both replicas are hashed from their own bytes. The faults are planted by page id: overwritten
    and shortened payloads, lost records; the audit sees only records.
    """
    pages = table(spark, sf_dir, "pages")
    one = _without(stored(archived(pages), "records"), 503, 11)
    other = _without(stored(archived(pages, _damaged()), "records"), 211, 7)
    found = audit(one, other)
    return found.select(
        "file", "start", F.coalesce("one.length", "other.length").alias("length"), "status"
    )

"""Benchmark decontamination by winnowing, in DataFrame functions only.

Of each window of ``WINDOW`` words the smallest hash of its ``KGRAM``-word grams is kept. Equal
windows keep equal hashes, so each shared span of ``WINDOW`` words or more is found by joining
these few hashes; then the windows behind a hit are compared in full. Items shorter than a window
have no such guarantee and are looked up whole, at their own lengths: their hashes set bits of a
filter of bounded size, and only windows of documents whose bit is set are compared.

Null and empty texts have no words: such documents are clean, such items never occur. Repeated
items count once by ``item_id``. Repeated rows of documents get a row each; rows that share a
``doc_id`` but not the text are judged apart.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logtarn.functions.let import let
from logtarn.llm.registry import registered, table
from logtarn.llm.stored import stored

WINDOW = 10
KGRAM = 4
#: Bits of the filter for short items, by item, and at most.
ITEM_BITS, MOST_BITS = 16, 1 << 20

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BETWEEN_WORDS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """Words of a text, A to Z lower-cased."""
    text = F.coalesce(text, F.lit(""))
    ascii_only = F.octet_length(text) == F.char_length(text)
    lowered = F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.array_remove(F.split(lowered, BETWEEN_WORDS, -1), "")


def _indices(count: Column) -> Column:
    """0 to count - 1; none for a count below 1."""
    return F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(
        F.array().cast("array<int>")
    )


def minima(words: Column) -> Column:
    """The smallest k-gram hash of each window of words."""

    def of(words: Column) -> Column:
        grams = F.transform(
            _indices(F.size(words) - (KGRAM - 1)),
            lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(KGRAM)]),
        )
        return let(
            grams,
            lambda grams: F.transform(
                _indices(F.size(words) - (WINDOW - 1)),
                lambda i: F.least(*[F.get(grams, i + k) for k in range(WINDOW - KGRAM + 1)]),
            ),
        )

    return let(words, of)


def _window(words: Column, at: Column, length: Column | int) -> Column:
    length = F.lit(length)
    return F.struct(
        at.alias("at"),
        length.alias("length"),
        F.array_join(F.slice(words, at + 1, length), " ").alias("window"),
    )


def _bit(words: Column, at: Column, length: int, bits: int) -> Column:
    """The bit of the filter that a window sets."""
    return F.pmod(F.xxhash64(*[F.get(words, at + k) for k in range(length)]), F.lit(bits))


def _short_windows(words: Column, items: DataFrame, lengths: list[int]) -> Column:
    """Windows of these lengths whose bit is set by one of the items' windows."""
    bits = ITEM_BITS
    while bits < min(ITEM_BITS * items.count(), MOST_BITS):
        bits *= 2
    own = F.split("window", " ")
    bit = F.coalesce(*[F.when(F.col("length") == n, _bit(own, F.lit(0), n, bits)) for n in lengths])
    mask = F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("bit") % 64).cast("int"))
    rows = items.select(bit.alias("bit")).groupBy(F.floor(F.col("bit") / 64).alias("at")).agg(F.bit_or(mask).alias("mask"))
    masks = ["0"] * -(-bits // 64)
    for r in rows.collect():  # at most MOST_BITS / 64
        masks[r["at"]] = str(r["mask"])
    # A constant: the optimizer folds it to one literal array.
    masks = F.split(F.lit(",".join(masks)), ",").cast("array<long>")

    def of(words: Column, length: int) -> Column:
        def is_set(at: Column) -> Column:
            return let(
                _bit(words, at, length, bits),
                lambda bit: F.getbit(F.get(masks, F.floor(bit / 64).cast("int")), (bit % 64).cast("int")) == 1,
            )

        found = F.filter(_indices(F.size(words) - (length - 1)), is_set)
        return F.transform(found, lambda at: _window(words, at, length))

    return let(words, lambda words: F.concat(*[of(words, n) for n in lengths]))


def _row() -> Column:
    """Tells rows apart; null-safe, unlike the plain columns."""
    return F.struct(F.col("doc_id"), F.xxhash64("text").alias("text"))


def _whole_windows(words: Column) -> Column:
    """All windows of an item, as struct(at, length, words)."""
    length = F.least(F.size(words), F.lit(WINDOW))
    return F.transform(_indices(F.size(words) - length + 1), lambda at: _window(words, at, length))


def item_windows(benchmark: DataFrame) -> DataFrame:
    """``item_id``, ``length`` and ``window`` of each window of each item."""
    return (
        benchmark.select("item_id", words_of(F.col("text")).alias("words"))
        .where(F.size("words") > 0)
        .select(
            "item_id",
            F.explode(_whole_windows(F.col("words"))).alias("w"),
        )
        .select("item_id", "w.length", "w.window")
        .distinct()
    )


def overlaps(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``doc_id``, ``n_words``, ``n_hit`` and ``items`` (sorted ids) of each row of documents.

    Also ``row``, a key by which the result can be joined with the documents.
    """
    docs = docs.select("doc_id", "text")
    items = stored(item_windows(benchmark), "item-windows")
    item_minima = (
        items.where(F.col("length") == WINDOW)
        .select(F.explode(minima(F.split("window", " "))).alias("minimum")).distinct()
    )
    short = items.where(F.col("length") < WINDOW)
    lengths = sorted(r.length for r in short.select("length").distinct().collect())

    prints = stored(
        docs.select(
            _row().alias("row"),
            let(
                words_of(F.col("text")),
                lambda words: F.struct(
                    F.size(words).cast("long").alias("n_words"),
                    F.array_distinct(minima(words)).alias("minima"),
                ),
            ).alias("of"),
        ).select("row", "of.n_words", "of.minima"),
        "minima",
    )
    marked = (
        prints.select("row", F.explode("minima").alias("minimum"))
        .join(item_minima, "minimum", "left_semi")
        .groupBy("row").agg(F.collect_set("minimum").alias("marked"))
    )
    # The windows behind the hits, to be compared in full.
    windows = (
        docs.withColumn("row", _row()).join(marked, "row")
        .select("row", F.explode(_marked_windows(words_of(F.col("text")), F.col("marked"))).alias("w"))
    )
    if lengths:
        of_short = _short_windows(words_of(F.col("text")), short, lengths)
        windows = windows.union(docs.select(_row().alias("row"), F.explode(of_short).alias("w")))
    hits = stored(
        windows.select("row", "w.at", "w.length", "w.window")
        .join(items.select("window").distinct(), "window", "left_semi"),
        "window-hits",
    )
    covered = hits.groupBy("row").agg(_covered(F.collect_set(F.struct("at", "length"))).alias("n_hit"))
    # Windows of one passage mostly have the same items: one array of them per window, and each
    # array once per row.
    of_window = items.groupBy("window").agg(F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("ids"))
    named = (
        hits.select("row", "window").distinct().join(of_window, "window")
        .groupBy("row").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("ids")))).alias("items"))
    )
    return prints.select("row", "n_words").join(covered, "row", "left").join(named, "row", "left").select(
        "row",
        F.col("row.doc_id").alias("doc_id"),
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
    )


def _marked_windows(words: Column, marked: Column) -> Column:
    def of(words: Column) -> Column:
        return let(
            minima(words),
            lambda least: F.transform(
                F.filter(_indices(F.size(least)), lambda i: F.array_contains(marked, F.get(least, i))),
                lambda i: _window(words, i, WINDOW),
            ),
        )

    return let(words, of)


def _covered(spans: Column) -> Column:
    """How many words lie in any of the spans."""
    end = lambda span: span["at"] + span["length"]
    return F.aggregate(
        F.array_sort(spans),
        F.struct(F.lit(0).alias("words"), F.lit(0).alias("end")),
        lambda sofar, span: F.struct(
            (
                sofar["words"]
                + F.greatest(F.lit(0), end(span) - F.greatest(sofar["end"], span["at"]))
            ).alias("words"),
            F.greatest(sofar["end"], end(span)).alias("end"),
        ),
        lambda sofar: sofar["words"],
    )


def without_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without a word of the benchmark in them, all columns as they are."""
    hit = overlaps(docs, benchmark).where("n_hit > 0").select("row").distinct()
    key = _row()
    return docs.join(hit, key == hit["row"], "left_anti")


_WORDS = (
    "regexp_extract_all(translate(coalesce(text, ''), "
    f"'{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
)


@registered(f"""
WITH item AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
iw AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n,
    array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS win
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM item WHERE len(w) > 0)),
doc AS (SELECT doc_id, {_WORDS} AS w FROM documents),
dw AS (
  SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS win
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i
        FROM doc, (SELECT DISTINCT n FROM iw) WHERE len(w) >= n)),
hit AS (SELECT doc_id, i, dw.n, item_id FROM dw JOIN iw USING (win)),
covered AS (
  SELECT doc_id, count(DISTINCT k) AS n_hit
  FROM (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS k FROM hit) GROUP BY doc_id),
named AS (
  SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM hit) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit,
  coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN covered USING (doc_id) LEFT JOIN named USING (doc_id)
""")
def op7_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark words and items in each document."""
    found = overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )

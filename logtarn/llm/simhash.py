"""SimHash near-duplicates: fingerprints, links within a few bits, components.

A text without words has fingerprint zero and is linked like any other; null counts as empty.
Equal fingerprints are one node of the index, so any number of copies costs one row. Rows that
repeat a ``doc_id`` are judged by their own texts. A null ``doc_id`` never names a component
unless the component has no other; ``without_near_copies`` keeps such rows, since it has no way
to say which of them are the same document.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logtarn.llm.components import components
from logtarn.llm.hamming import links
from logtarn.llm.registry import registered, table
from logtarn.llm.stored import stored
from logtarn.llm.textbytes import ASCII_LOWER, SPACE, owner, pieces, runs, utf8

SEED = 42
SHINGLE_WORDS = 3
MAX_BITS = 2


def simhashes(column: pa.Array, shingle_words: int = SHINGLE_WORDS) -> np.ndarray:
    """The 64-bit fingerprint of each text."""
    data, ends = utf8(column)
    texts = len(ends) - 1
    data = ASCII_LOWER[data]
    filled = ~SPACE[data]
    begin, end = runs(filled, ends)
    doc = owner(begin, ends)
    # All words with one space behind each: a shingle is a slice of this.
    lengths = end - begin
    stop = np.cumsum(lengths + 1) - 1
    joined = np.full(int(stop[-1]) + 1 if len(stop) else 0, 32, np.uint8)
    spaces = np.zeros(len(joined), bool)
    spaces[stop] = True
    joined[~spaces] = data[filled]

    words = np.bincount(doc, minlength=texts)
    first = np.concatenate([[0], np.cumsum(words)[:-1]])
    shingles = np.where(words > 0, np.maximum(words - shingle_words + 1, 1), 0)
    shingle_doc = np.repeat(np.arange(texts), shingles)
    start = np.arange(len(shingle_doc)) - np.repeat(np.cumsum(shingles) - shingles, shingles)
    start += first[shingle_doc]
    last = start + np.minimum(words[shingle_doc], shingle_words) - 1
    buffer, digest = joined.tobytes(), xxhash.xxh64_intdigest
    hashes = np.array(
        [
            digest(buffer[a:b], SEED)
            for a, b in zip((stop - lengths)[start].tolist(), stop[last].tolist(), strict=True)
        ],
        np.uint64,
    )
    fingerprints = np.zeros(texts, np.uint64)
    full = np.flatnonzero(shingles)
    if len(full):
        at = (np.cumsum(shingles) - shingles)[full]
        for bit in range(64):
            ones = np.add.reduceat((hashes >> np.uint64(bit)) & np.uint64(1), at)
            majority = 2 * ones.astype(np.int64) > shingles[full]
            fingerprints[full] |= majority.astype(np.uint64) << np.uint64(bit)
    return fingerprints


def fingerprinted(docs: DataFrame, shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """``doc_id`` and ``fp``, the fingerprint as a signed number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 1):
            found = simhashes(batch.column(1), shingle_words).view(np.int64)
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "fp": pa.array(found)})

    ids = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {ids}, fp long")


def near_copies(
    docs: DataFrame, shingle_words: int = SHINGLE_WORDS, max_bits: int = MAX_BITS
) -> DataFrame:
    """``doc_id``, ``fp`` and ``component_id``, the smallest id of what links reach."""
    prints = stored(fingerprinted(docs, shingle_words), "fingerprints")
    distinct = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    found = components(links(distinct.select("fp"), max_bits)).withColumnRenamed("node", "fp")
    linked = distinct.join(found, "fp")
    names = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    named = stored(linked.join(names, "root").select("fp", "component_id"), "components")
    every = distinct.join(named, "fp", "left").select(
        "fp", F.coalesce("component_id", "least").alias("component_id")
    )
    return prints.join(every, "fp").select("doc_id", "fp", "component_id")


def without_near_copies(
    docs: DataFrame, shingle_words: int = SHINGLE_WORDS, max_bits: int = MAX_BITS
) -> DataFrame:
    """The documents with one of each component, the one of the smallest id.

    Where rows share that id, each of their different texts stays, linked or not: the id does not
    say which of them the component is named after.
    """
    found = near_copies(docs, shingle_words, max_bits)
    kept = found.where("doc_id = component_id").select("doc_id").distinct()
    one = docs.join(kept, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return one.unionByName(docs.where("doc_id IS NULL"))


@registered()
def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of each document."""
    found = near_copies(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )

"""Quality rules on repetition: how much of a text lies in n-grams and lines it has twice.

Rolling hashes of several n-gram lengths are computed in numpy over a megabyte of texts at a
time. Work is per document, so nothing is shuffled.

Null or empty text has no words and fails the base rules. Rows may repeat; each is judged alone.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logtarn.llm.registry import registered, table
from logtarn.llm.textbytes import SPACE, byte_set, mixed, named, owner, pieces, runs, total, utf8

SYMBOLS = byte_set(b"#*$%&|<>")
BASE = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Limits:
    """A document is kept if each share of its word characters stays at or below its limit."""

    ngram_chars: tuple[tuple[int, float], ...] = ((5, 0.45), (8, 0.42), (10, 0.40))
    line_chars: float = 0.30
    symbols_per_word: float = 0.20


MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
COLUMNS = (
    MEASURES
    + ", dup_line_chars long, dup_ngram_chars array<long>, base_failed boolean, kept boolean"
)


def _repeated(ids: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """Marks words in windows of n words that their text has twice or more, the first included."""
    count = len(ids) - n + 1
    if count < 2:
        return np.zeros(len(ids), bool)
    rolled = mixed(doc[:count] + 1)
    for k in range(n):
        rolled = rolled * BASE + ids[k : k + count]
    start = np.flatnonzero(doc[:count] == doc[n - 1 :])
    order = start[np.argsort(rolled[start], kind="stable")]
    a, b = order[:-1], order[1:]
    same = rolled[a] == rolled[b]
    equal = same & (doc[a] == doc[b])
    for k in range(n):
        equal &= ids[a + k] == ids[b + k]
    if (same & ~equal).any():  # two different windows with one hash: compare the words
        order = start[np.lexsort([*(ids[start + k] for k in range(n)), doc[start]])]
        a, b = order[:-1], order[1:]
        equal = doc[a] == doc[b]
        for k in range(n):
            equal &= ids[a + k] == ids[b + k]
    change = np.zeros(len(ids) + 1, np.int64)
    window = np.zeros(len(ids), bool)
    window[a[equal]] = window[b[equal]] = True
    hit = np.flatnonzero(window)
    np.add.at(change, hit, 1)
    np.add.at(change, hit + n, -1)
    return np.cumsum(change[:-1]) > 0


def measure(column: pa.Array, limits: Limits = Limits()) -> dict[str, np.ndarray]:
    """The measures of each text, as arrays."""
    data, ends = utf8(column)
    texts = len(ends) - 1
    filled = ~SPACE[data]
    begin, end = runs(filled, ends)
    doc = owner(begin, ends)
    ids = mixed(named(data[filled], end - begin) + 1)
    chars_before = total((data & 0xC0) != 0x80)
    word_chars = chars_before[end] - chars_before[begin]

    def per_text(of: np.ndarray, values: np.ndarray) -> np.ndarray:
        return np.bincount(of, values, texts).astype(np.int64)

    found = {
        "n_words": np.bincount(doc, minlength=texts).astype(np.int64),
        "word_chars": per_text(doc, word_chars),
        "n_symbols": np.diff(total(SYMBOLS[data])[ends]),
        "n_repeat_words": per_text(doc, _repeated(ids, doc, 3)),
    }
    ngrams = [per_text(doc, word_chars * _repeated(ids, doc, n)) for n, _ in limits.ngram_chars]
    found["dup_ngram_chars"] = np.stack(ngrams, 1)

    # Lines end at a newline or with the text; bytes between newlines, end to end, are named.
    newline = data == 10
    breaks = np.flatnonzero(newline)
    stop = np.concatenate([breaks, ends[1:]])
    line_doc = np.concatenate([owner(breaks, ends), np.arange(texts)])
    order = np.lexsort([stop, line_doc])
    stop, line_doc = stop[order], line_doc[order]
    first = np.concatenate([[True], line_doc[1:] != line_doc[:-1]])[: len(stop)]
    begin = np.where(first, ends[line_doc], np.concatenate([[0], stop[:-1] + 1])[: len(stop)])
    line = named(data[~newline], stop - begin)
    chars_in_words = total(filled & ((data & 0xC0) != 0x80))
    line_chars = chars_in_words[stop] - chars_in_words[begin]
    order = np.lexsort([line, line_doc])
    again = np.zeros(len(line), bool)
    a, b = order[:-1], order[1:]
    again[b] = (line[a] == line[b]) & (line_doc[a] == line_doc[b]) & (line_chars[b] > 0)
    found["n_dup_lines"] = per_text(line_doc, again)
    found["dup_line_chars"] = per_text(line_doc, again * line_chars)

    words, chars = found["n_words"], np.maximum(found["word_chars"], 1)
    failed = (words < 50) | (100 * found["n_repeat_words"] > 50 * words)
    kept = ~failed & (found["dup_line_chars"] <= limits.line_chars * chars)
    kept &= found["n_symbols"] <= limits.symbols_per_word * words
    for k, (_, most) in enumerate(limits.ngram_chars):
        kept &= found["dup_ngram_chars"][:, k] <= most * chars
    return found | {"base_failed": failed, "kept": kept}


def repetition(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """A row per document: ``doc_id`` and its measures and verdict.

    ``dup_ngram_chars`` has the word characters inside repeated n-grams for each length of
    ``limits.ngram_chars``, ``dup_line_chars`` those of lines equal to an earlier one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 1):
            found = measure(batch.column(1), limits)
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column(0),
                **{
                    name: pa.array(list(found[name]) if found[name].ndim > 1 else found[name])
                    for name in [c.split()[0] for c in COLUMNS.split(", ")]
                },
            })

    ids = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {ids}, {COLUMNS}")


def without_repetitive(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """The documents that the rules keep, all columns as they are."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, at):
            yield batch.filter(pa.array(measure(batch.column(at), limits)["kept"]))

    return docs.mapInArrow(run, docs.schema)


@registered()
def op1_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repetition measures and verdict of each document."""
    found = repetition(table(spark, sf_dir, "documents"))
    return found.withColumn("dup_ngram_chars", F.concat_ws(",", F.col("dup_ngram_chars").cast("array<string>")))

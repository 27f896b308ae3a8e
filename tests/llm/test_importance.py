"""Importance resampling against brute force and odd input."""

import math
import re
import zlib
from collections import Counter
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pytest
from brute import ascii_lower
from conftest import DATA

from logtarn.llm import importance
from logtarn.llm.importance import Setting, crc_on, resampled, words_of

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def buckets(text, setting):
    words = WORD.findall(ascii_lower(text or ""))
    spans = [
        " ".join(words[i : i + n]) for n in range(1, setting.orders + 1) for i in range(len(words) - n + 1)
    ]
    return len(words), [zlib.crc32(s.encode()) % setting.buckets for s in spans]


def brute(docs, items, setting=Setting()):
    """(doc_id, n_features, weight, score, rank) of each row."""
    found = [(doc_id, *buckets(text, setting)) for doc_id, text in docs]
    s = Counter(b for *_, of in found for b in of)
    t = Counter(b for text in items for b in buckets(text, setting)[1])
    size, all_s, all_t = setting.buckets, sum(s.values()), sum(t.values())

    def gain(b):
        share = (t[b] + 1.0) * (all_s + float(size)) / ((s[b] + 1.0) * (all_t + float(size)))
        return math.floor(1000 * math.log(share))

    rows = []
    for doc_id, words, of in found:
        weight, score = sum(map(gain, of)), None
        if doc_id is not None:
            h = int(sha256(f"{setting.seed}:{doc_id}".encode()).hexdigest()[:8], 16)
            score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))
        rows.append([doc_id, len(of), weight, score, None, words])
    eligible = [r for r in rows if r[3] is not None and r[5] >= setting.least_words]
    eligible.sort(key=lambda r: (-r[3], r[0], r[1]))
    for place, row in enumerate(eligible[: setting.percent * len(eligible) // 100]):
        row[4] = place + 1
    return sorted((tuple(r[:5]) for r in rows), key=order)


def order(row):
    return [(v is None, v or 0) for v in row]


def found(docs, target, setting=Setting()):
    rows = resampled(docs, target, setting).select("doc_id", "n_features", "weight", "score", "rank")
    return sorted(map(tuple, rows.collect()), key=order)


def pairs(frame):
    return [(r.doc_id, r.text) for r in frame.select("doc_id", "text").collect()]


def test_weights_and_ranks(spark, documents):
    benchmark = spark.read.parquet(f"{DATA}/benchmark.parquet")
    items = [r.text for r in benchmark.collect()]
    for setting in (Setting(), Setting(orders=2, buckets=70_000, percent=40, least_words=3)):
        expected = brute(pairs(documents), items, setting)
        assert found(documents, benchmark, setting) == expected
        assert sum(row[4] is not None for row in expected) > 5


def test_odd_rows(spark, odd, clashing, odd_rows):
    target = spark.createDataFrame([("alpha1 alpha2 alpha3",), (None,), ("",)], "text string")
    setting = Setting(percent=60)
    expected = brute([row[:2] for row in odd_rows], ["alpha1 alpha2 alpha3"], setting)
    assert found(odd, target, setting) == expected
    assert found(clashing, target, setting) == expected
    nothing = target.where("false")
    assert found(odd, nothing, setting) == brute([row[:2] for row in odd_rows], [], setting)
    assert found(odd.where("false"), target) == []


def test_equal_scores_go_by_id_over_many_ranges(spark, monkeypatch):
    """Rows of one id have one score; the ranges of the ranking cut right through them."""
    rows = [(7, "same words " * 15)] * 300 + [(8, "same words " * 15)] * 300
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    ranks = sorted(r[4] for r in found(docs, docs, Setting(percent=90)) if r[4] is not None)
    assert ranks == list(range(1, 541))


def test_ranks_hold_where_files_are_cut(spark, documents):
    benchmark = spark.read.parquet(f"{DATA}/benchmark.parquet")
    expected = found(documents, benchmark, Setting(percent=80))
    spark.conf.set("spark.sql.files.maxRecordsPerFile", 7)
    try:
        assert found(documents, benchmark, Setting(percent=80)) == expected
    finally:
        spark.conf.unset("spark.sql.files.maxRecordsPerFile")


@pytest.mark.parametrize("chunk", [1 << 16, 8, 1])
def test_words_do_not_depend_on_chunks(monkeypatch, chunk):
    monkeypatch.setattr(importance, "CHUNK_BYTES", chunk)
    texts = ["Ünï Text, with\nlines and 日本 語\x00end\x7fx", None, "", "  ", "A" * 100 + " b " * 50]
    data, begin, end, of = words_of(pa.array(texts))
    words = [data[a:b].tobytes().decode() for a, b in zip(begin, end, strict=True)]
    expected = [(k, w) for k, text in enumerate(texts) for w in WORD.findall(ascii_lower(text or ""))]
    assert list(zip(of.tolist(), words, strict=True)) == expected


def test_crc_of_short_and_long_words():
    rng = np.random.default_rng(1)
    data = rng.integers(0, 256, 5000, dtype=np.uint8)
    begin = np.array([0, 3, 3, 10, 100, 200, 4000])
    end = np.array([3, 3, 10, 100, 147, 4000, 5000])
    crc = np.array([0, 5, 2**32 - 1, 7, 1, 0, 9], np.uint32)
    expected = [zlib.crc32(data[a:b], int(c)) for a, b, c in zip(begin, end, crc, strict=True)]
    assert crc_on(crc, data, begin, end).tolist() == expected

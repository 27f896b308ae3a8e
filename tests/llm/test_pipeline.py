"""The corpus pipeline, stage by stage, against brute force."""

import brute
import pytest
from conftest import DATA

import corpus_pipeline
from logtarn.llm import repetition


@pytest.fixture(scope="module")
def stages(spark):
    """The documents before and after each stage."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    found = [docs.collect()]
    schema = docs.schema
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, DATA)
        found.append(docs.collect())
        if name != "mixing":
            assert docs.schema == schema
            docs = spark.createDataFrame(found[-1], schema)
    return found


def rows(frame):
    return sorted(tuple(r) for r in frame)


def test_quality_rules(stages):
    limits = repetition.Limits()

    def good(text):
        m = brute.base_measures(text)
        chars = max(m["word_chars"], 1)
        return (
            not m["base_failed"]
            and m["dup_line_chars"] <= limits.line_chars * chars
            and m["n_symbols"] <= limits.symbols_per_word * m["n_words"]
            and all(n <= most * chars for n, (_, most) in zip(m["dup_ngram_chars"], limits.ngram_chars, strict=True))
        )

    assert rows(stages[1]) == rows(r for r in stages[0] if good(r.text))


def test_near_duplicates(stages):
    before = stages[1]
    least = brute.near_components([(r.doc_id, brute.simhash(r.text)) for r in before])
    assert rows(stages[2]) == rows(r for r, c in zip(before, least, strict=True) if r.doc_id == c)


def test_decontamination(spark, stages):
    items = {r.item_id: r.text for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()}
    assert rows(stages[3]) == rows(r for r in stages[2] if not brute.overlaps(r.text, items)[1])


def test_personal_data(stages):
    before = {r.doc_id: r for r in stages[3]}
    assert sorted(before) == sorted(r.doc_id for r in stages[4])
    for r in stages[4]:
        spans = brute.private_spans(before[r.doc_id].text)
        if not spans:
            assert r == before[r.doc_id]
        else:
            assert "[" in r.text and not brute.private_spans(r.text) and r.n_chars == len(r.text)


def test_mixing(stages):
    before = {r.doc_id: r for r in stages[4]}
    for r in stages[5]:
        assert tuple(r)[:5] == tuple(before[r.doc_id]) and r.copies >= 1 and abs(r.copies - r.weight) < 1
    assert sum(r.copies for r in stages[5]) == pytest.approx(sum(r.weight for r in stages[5]), rel=0.5)


def test_run(spark, stages):
    rounded = lambda frame: rows((*r[:5], round(r.weight, 6), r.copies) for r in frame)
    assert rounded(corpus_pipeline.run(spark, DATA).collect()) == rounded(stages[5])


def test_odd_documents(spark, odd, clashing):
    for frame in (odd, clashing, odd.limit(0)):
        docs, columns = frame, frame.columns
        for name, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, DATA)
            assert docs.columns[: len(columns)] == columns, name
        assert docs.count() <= frame.count() and len(set(docs.columns)) == len(docs.columns)

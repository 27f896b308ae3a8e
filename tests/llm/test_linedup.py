"""Line deduplication against brute force and odd input."""

import random

import pytest
from brute import ascii_lower

from logtarn.llm import linedup
from logtarn.llm.linedup import LineRuns, Setting, keyed_lines, without_repeated_lines

SPACE = " \t\n\x0b\x0c\r"


def brute(rows, setting=Setting()):
    """(doc_id, text that stays, lines, dropped lines) of each row."""
    holders = {}
    for at, (doc_id, text) in enumerate(rows):
        for line in (text or "").split("\n"):
            key = ascii_lower(line.strip(SPACE))
            if len(key) >= setting.least_chars:
                holders.setdefault(key, {})[at] = doc_id
    found = []
    for doc_id, text in rows:
        lines, kept = (text or "").split("\n"), []
        for line in lines:
            of = holders.get(ascii_lower(line.strip(SPACE)), {})
            ids = [i for i in of.values() if i is not None]
            gone = len(of) >= setting.least_documents and ids and (doc_id is None or doc_id < max(ids))
            if not gone:
                kept.append(line)
        dropped = len(lines) - len(kept)
        found.append((doc_id, "\n".join(kept) if dropped else text, len(lines), dropped))
    return sorted(found, key=str)


def found(docs, setting=Setting()):
    return sorted(
        ((r[0], r[1], r[-2], r[-1]) for r in without_repeated_lines(docs, setting).collect()), key=str
    )


def crowd(seed, n):
    """Texts of few and of many lines, some in most texts, some in a few, some of space only."""
    rng = random.Random(seed)
    lines = [f"{'  ' * (k % 3)}This is Line number {k} É of the pool{chr(9) * (k % 2)}" for k in range(60)]
    lines += ["short", "", "   ", "x" * 19, "x" * 20, "é" * 19, "É" * 20, "　" * 25, "THE SAME LINE IN MOST TEXTS"]
    rows = []
    for k in range(n):
        chosen = [rng.choice(lines) for _ in range(rng.randrange(8))] + (["The same line in most texts"] if k % 3 else [])
        rows.append((rng.choice([k, k, k // 2, None]) if k % 5 == 0 else k, "\n".join(chosen)))
    return rows


@pytest.mark.parametrize("setting", [Setting(), Setting(batches=7, fan_in=3), Setting(batches=1), Setting(least_documents=1)])
def test_lines(spark, setting):
    rows = crowd(1, 150)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    expected = brute(rows, setting)
    assert found(docs, setting) == expected
    assert sum(row[3] for row in expected) > 50


def test_hot_keys_and_others_alike(spark, monkeypatch):
    rows = crowd(2, 120)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for share in (1, 20, 10**9):  # no key, some keys, all keys are looked up by broadcast
        monkeypatch.setattr(linedup, "HOT_KEYS", share)
        assert found(docs) == brute(rows)


def test_odd_rows(spark, odd, clashing, odd_rows):
    expected = brute([row[:2] for row in odd_rows])
    assert found(odd) == expected
    assert found(clashing) == expected
    columns = without_repeated_lines(clashing)
    assert columns.columns == [*clashing.columns, "n_lines", "n_dropped"]
    assert found(odd.where("false")) == []
    blank = spark.createDataFrame([(1, None), (2, ""), (None, None), (3, "\n")], "doc_id long, text string")
    assert found(blank) == brute([(1, None), (2, ""), (None, None), (3, "\n")])
    taken = odd.selectExpr("doc_id", "text", "1 AS n_lines", "2 AS t1", "3 AS positions")
    assert without_repeated_lines(taken).columns == ["doc_id", "text", "n_lines", "t1", "positions", "_n_lines", "n_dropped"]


def test_long_lines(spark):
    long = "long " * 300_000
    rows = [(k, f"{k} own\n{long}\nend of text {k}") for k in range(4)] + [(9, "\n".join(["again and again and again"] * 50_000))]
    assert found(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)


def test_runs_are_merged_by_levels(spark):
    rows = crowd(3, 90)
    docs = spark.createDataFrame([r for r in rows if r[0] is not None], "doc_id long, text string")
    lines = keyed_lines(docs).cache()
    runs, levels = LineRuns(spark, Setting(fan_in=2)), []
    for low in range(80, -1, -10):
        runs.add(lines.where(f"doc_id >= {low} AND doc_id < {low + 10}"))
        levels.append([len(level) for level in runs.levels])
    assert levels == [
        [1], [0, 1], [1, 1], [0, 0, 1], [1, 0, 1], [0, 1, 1], [1, 1, 1], [0, 0, 0, 1], [1, 0, 0, 1],
    ]
    merged = {(r.h1, r.h2): (r.holders, r.keeper) for r in runs.merged().collect()}
    expected = {}
    for r in lines.collect():
        holders, keeper = expected.get((r.h1, r.h2), (0, -1))
        expected[r.h1, r.h2] = (holders + 1, max(keeper, r.doc_id))
    assert merged == expected


def test_runs_are_joined_as_they_lie(spark):
    docs = spark.createDataFrame(crowd(4, 30), "doc_id long, text string")
    lines = keyed_lines(docs)
    runs = LineRuns(spark, Setting(fan_in=9))
    for part in ("doc_id >= 15", "doc_id < 15"):
        runs.add(lines.where(part))
    first, second = (spark.table(run) for run in runs.levels[0])
    plan = first.hint("merge").join(second, ["h1", "h2"], "full")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan

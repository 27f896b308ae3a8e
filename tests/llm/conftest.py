import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

DATA = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns named like the ones that operators make for themselves.
CLASHING = (
    "row", "fp", "component_id", "kept", "spans", "weight", "copies", "topic", "tokens", "documents",
    "id", "part", "n_words", "minima", "marked", "least", "root", "value", "factor", "score", "toxic",
)


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet").cache()


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in each column, empty and very long texts, ties and repeated rows."""
    long = " ".join(f"word{i % 997} and{i % 13}" for i in range(30_000))
    plain = " ".join(f"alpha{i}" for i in range(80))
    rows = [
        (1, plain, "en", "a", 5), (1, plain, "en", "a", 5), (2, plain, "en", "a", 5),
        (3, plain + " more", None, "a", None), (4, None, "en", None, 0), (5, "", "en", "a", 0),
        (6, " \n\t ", "de", "b", 4), (7, long, "en", "a", len(long)), (None, plain, "en", "a", 5),
        (None, None, None, None, None), (8, "É\u3000Ü " * 60, "fr", "b", 1),
        (9, "short one", "en", "a", 9), (8, "the same id, another text " * 9, "fr", "b", 1),
    ]
    return rows


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, SCHEMA)


@pytest.fixture(scope="session")
def clashing(spark, odd_rows):
    """The same with extra columns of the operators' own names."""
    schema = SCHEMA + "".join(f", {c} string" for c in CLASHING)
    return spark.createDataFrame([(*r, *CLASHING) for r in odd_rows], schema)

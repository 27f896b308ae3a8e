"""Each catalogued query against its oracle, on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

from logtarn.catalog import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def oracle():
    connection = duckdb.connect()
    for path in Path(DATA).glob("*.parquet"):
        connection.sql(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return connection


def canonical(rows):
    return sorted(
        (tuple(round(v, 6) if isinstance(v, float) else v for v in row) for row in rows),
        key=lambda row: [(v is None, str(v)) for v in row],
    )


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, oracle, name):
    result = QUERIES[name](spark, DATA)
    columns = sorted(result.columns)
    listed = ", ".join(columns)
    expected = oracle.sql(f"SELECT {listed} FROM ({ORACLES[name]})")
    found = [tuple(row) for row in result.select(*columns).collect()]
    assert found, "a query without rows proves nothing"
    assert canonical(found) == canonical(expected.fetchall())

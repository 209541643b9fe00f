"""Every query of the library itself against its SQL in the other engine, on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
import oracles
from check import canonical

SF = "/root/testdata/sf0.001"
NAMES = sorted(entry.OPERATORS | entry.PLANTED)
TABLES = "nation customer orders lineitem pages events"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES.split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def test_every_query_has_an_oracle():
    assert set(NAMES) == set(oracles.oracle_sql()) and set(NAMES) <= set(entry.queries())


@pytest.mark.parametrize("name", NAMES)
def test_matches_oracle(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    cur = duck.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(columns)
    assert canonical(df.columns, df.collect()) == canonical(columns, cur.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0

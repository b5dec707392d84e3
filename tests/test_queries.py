"""Every query runs, and gives what its SQL gives, on the small tables."""

import pytest

import __spark_entry__ as entry
from textloom.plans.oracles import ORACLES
from textloom.plans.queries import QUERIES

TABLES = "documents embeddings pages benchmark labels conversations".split()


def plain(frame):
    columns = sorted(frame.columns)
    return columns, sorted(map(repr, frame[columns].astype(object).itertuples(index=False, name=None)))


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, small, name):
    got = QUERIES[name](spark, small).toPandas()
    assert len(got)
    if name in ORACLES:
        duckdb = pytest.importorskip("duckdb")
        con = duckdb.connect()
        for t in TABLES:
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
        assert plain(got) == plain(con.execute(ORACLES[name]).df())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())

"""Catalogue queries against the same in SQL, and the entry points."""

import duckdb
import pytest

import __spark_entry__ as entry
from gaugewright.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", list(catalogue.oracle_sql()))
def test_query_matches_sql(spark, con, name):
    df = catalogue.queries()[name](spark, SF)
    want = con.sql(catalogue.oracle_sql()[name])
    assert sorted(df.columns) == sorted(want.columns)
    at = [want.columns.index(c) for c in df.columns]
    assert sorted(map(tuple, df.collect()), key=repr) == sorted((tuple(r[i] for i in at) for r in want.fetchall()), key=repr)


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert [r.criterion_id for r in rows] == [f"D{i}" for i in range(8)]
    assert {r.criterion_id: r.status for r in rows}["D7"] == "NOT_APPLICABLE"
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_rank(spark):
    r = catalogue.d3_rank_condition(spark, SF).first()
    assert r.design_rank == 4 and r.condition_number >= 1

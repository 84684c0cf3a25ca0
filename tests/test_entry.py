"""Every graph query against its SQL in DuckDB, and the contract of the entry module."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from islet.plans import queries as q

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


@pytest.mark.parametrize("name", sorted(q.ORACLE))
def test_matches_sql(spark, duck, name):
    got, want = q.QUERIES[name](spark, SF).toPandas(), duck.sql(q.ORACLE[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert sorted(map(str, got[columns].values.tolist())) == sorted(map(str, want[columns].values.tolist()))


def test_contract(spark):
    assert set(q.ORACLE) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
    rows = entry.entry(spark).collect()
    assert len(rows) == 125 and sum(r["nC"] for r in rows) == 380


@pytest.mark.parametrize("name", sorted(set(q.QUERIES) - set(q.ORACLE)))
def test_others_have_rows(spark, name):
    assert q.QUERIES[name](spark, SF).count() > 0


def test_known_statistics(spark):
    row = q.QUERIES["cc_stats_order_part"](spark, SF).first()
    assert (row["n"], row["f"], row["cl"], row["cu"], row["cm"], row["cv"]) == (380, 125, 2, 13, 3.04, 2.3904)


def test_subtrees_of_leaves_are_listed(spark):
    from islet.operators import edges
    from islet.plans import queries

    sf_dir = "/root/testdata/sf0.001"
    rows = queries.QUERIES["bfs_subtree"](spark, sf_dir).collect()
    assert {r["id"] for r in rows} == {r["id"] for r in edges.vertices(queries.graph(spark, sf_dir, "customer_order")).collect()}
    assert min(r["subtree"] for r in rows) == 1

import glob
import os

import duckdb
import pytest

from islet.llm import oracle
from islet.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(oracle.ORACLE))
def test_matches_sql(spark, name):
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    got, want = QUERIES[name](spark, SF), c.sql(oracle.ORACLE[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    key = lambda r: tuple((x is None, x) for x in r)
    rows = sorted((tuple(r) for r in got.select(*columns).collect()), key=key)
    assert rows == sorted(want.project(", ".join(columns)).fetchall(), key=key)

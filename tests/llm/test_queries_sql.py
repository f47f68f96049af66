"""Queries of the corpus operators that SQL can express, against DuckDB."""

import glob
import os

import duckdb
import pytest

from lorebase.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_rows(spark, duck, name):
    got = QUERIES[name](spark, SF)
    names = sorted(got.columns)
    want = duck.sql(f"SELECT {', '.join(names)} FROM ({ORACLE_SQL[name]}) q").fetchall()
    assert sorted(map(tuple, got.select(*names).collect())) == sorted(want)

"""Capture where tables are too large to be broadcast."""

import duckdb

from lorebase.plans.catalog import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.01"


def test_capture_of_shuffled_notes(spark):
    """Notes and captures are dealt by id and the registry is broadcast: branches of a union over them had other counts of partitions."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1000")
    try:
        got = QUERIES["capture_pipeline"](spark, SF)
        rows, names = got.collect(), got.columns
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    c = duckdb.connect()
    c.sql(f"CREATE VIEW conversations AS SELECT * FROM '{SF}/conversations.parquet'")
    want = c.sql(f"SELECT {', '.join(names)} FROM ({ORACLE_SQL['capture_pipeline']}) q").fetchall()
    assert sorted(map(tuple, rows), key=str) == sorted(want, key=str)

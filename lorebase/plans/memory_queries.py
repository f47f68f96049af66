"""Text and window queries built from functions, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorebase.functions import text as T
from lorebase.sources.views import view
from lorebase.streaming.ingest import sessions


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def token_estimate(spark, d):
    return view(spark, d, "memories").select("id", T.token_estimate(F.col("content")).alias("tokens"))


def slugify(spark, d):
    return view(spark, d, "memories").select("id", T.slugify(F.col("summary")).alias("slug"))


def transcript_blob(spark, d):
    rows = _table(spark, d, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    return rows.select("conv_id", F.array_join(F.transform("t", lambda x: F.concat(x["role"], F.lit(": "), x["text"])), "\n").alias("blob"))


def session_windows(spark, d):
    """Beyond the reference: 30-minute sessions over the event stream."""
    return sessions(_table(spark, d, "events").select("user_id", "ts")).groupBy("user_id").agg(F.count("*").alias("sessions"), F.sum("n").alias("events"))


QUERIES = {f.__name__: f for f in (
    token_estimate, slugify, transcript_blob, session_windows,
)}
ORACLE_SQL = {
    "token_estimate": "SELECT id, CAST(ceil(octet_length(encode(content)) / 4.0) AS BIGINT) AS tokens FROM memories",
    "slugify": r"SELECT id, substr(regexp_replace(regexp_replace(regexp_replace(trim(lower(summary)), '[^a-z0-9\s-]', '', 'g'), '[\s_]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 60) AS slug FROM memories",
    "transcript_blob": "SELECT conv_id, string_agg(concat(role, ': ', text), chr(10) ORDER BY turn, role, text) AS blob FROM conversations GROUP BY conv_id",
    "session_windows": "SELECT user_id, count(CASE WHEN fresh THEN 1 END) AS sessions, count(*) AS events FROM (SELECT user_id, coalesce(ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE, true) AS fresh FROM events) GROUP BY user_id",
}

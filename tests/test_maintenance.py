"""Versioned snapshots, and a maintenance run that changes them phase by phase."""

import pytest
from pyspark.sql import functions as F

from lorebase.operators import maintenance as M
from lorebase.operators import search
from lorebase.plans import maintenance_queries
from lorebase.sources.snapshots import Conflict, Snapshots

NOW = 1_000_000


def _tables(spark):
    frame = spark.createDataFrame
    return {
        "memories": frame([(1, "one", None), (2, "two", NOW - 80 * 3600), (3, "three", NOW - 71 * 3600), (4, None, NOW + 5)], "id long, content string, expires_at long"),
        "entities": frame([("a", "persist", "x" * 80, "short"), ("b", "active", "y" * 80, ""), ("c", "persist", "- one\n- two\n- three\n- four" + "!" * 60, None), ("d", "persist", "", "")], "id string, tier string, timeline string, compiled_truth string"),
        "facts": frame(
            [(1, 7, "k", "x", 0.5, None), (2, 7, "k", "y", 0.9, None), (3, 7, "k", "y", 0.9, None), (4, 7, "other", "z", 0.1, None), (5, 8, "k", "p", 0.5, "2020-01-01"), (6, 8, "k", "q", 0.1, None)],
            "fact_id long, entity_id long, claim_key string, claim_value string, confidence double, superseded_at string",
        ).withColumn("superseded_at", F.to_date("superseded_at")).withColumn("observed_at", F.to_date(F.lit("2021-01-01"))),
        "embeddings": frame([(1, "ready", "m", "", [1.0]), (2, "ready", "old", "", [1.0])], "memory_id long, status string, model string, content_hash string, vec array<double>").withColumn("content_hash", F.when(F.col("memory_id") == 1, F.sha2(F.lit("one"), 256)).otherwise("")),
        "links": frame([(1, "a"), (2, "a"), (2, "b"), (9, "c")], "memory_id long, entity_id string"),
    }


PHASES = {"truth_rewrite": M.truth_rewrite, "fact_resolve": M.fact_resolve(NOW), "embed_stale": M.embed_stale("m", search.hash_embedded), "purge": M.purge(NOW, ("embeddings", "links"))}


def test_versions_are_seen_whole(spark, tmp_path):
    store = Snapshots(spark, str(tmp_path / "s"))
    assert store.version() == 0
    one = spark.range(3)
    assert store.commit({"t": one, "u": one}) == 1 and store.commit({"t": spark.range(5)}) == 2
    assert store.table("t").count() == 5 and store.table("t", 1).count() == 3 and store.table("u").count() == 3
    # Two writers that start from the same version: the second must start again.
    with pytest.raises(Conflict):
        store.commit({"t": spark.range(9)}, 1)
    assert store.version() == 2 and store.table("t").count() == 5
    # A writer that died while it wrote its manifest has made no version.
    (tmp_path / "s/manifest-3.json").write_text('{"t": {"fol')
    assert store.version() == 2 and store.table("t").count() == 5


def test_phases_change_tables(spark, tmp_path):
    store = M.opened(spark, str(tmp_path / "s"), _tables(spark))
    report = [(r.phase, r.status, r.found, r.version) for r in M.run(store, PHASES).orderBy("place").collect()]
    assert report == [("truth_rewrite", "ok", 2, 2), ("fact_resolve", "ok", 2, 3), ("embed_stale", "ok", 3, 4), ("purge", "ok", 4, 5)]
    truth = {r.id: r.compiled_truth for r in store.table("entities").collect()}
    assert truth == {"a": "x" * 80, "b": "", "c": "- one - two - three", "d": ""}
    assert {r.fact_id for r in store.table("facts").where("superseded_at is null").collect()} == {3, 4, 6}
    assert {(r.memory_id, r.status, r.model) for r in store.table("embeddings").collect()} == {(1, "ready", "m"), (3, "ready", "m"), (4, "ready", "m")}
    assert {r.id for r in store.table("memories").collect()} == {1, 3, 4} and {r.memory_id for r in store.table("links").collect()} == {1, 9}
    audit = sorted((r.version, r.table_name, r.id, r.change) for r in store.table("audit").collect())
    assert audit == [
        (2, "entities", "a", "truth rewritten"), (2, "entities", "c", "truth rewritten"), (3, "facts", "1", "superseded"), (3, "facts", "2", "superseded"),
        (4, "embeddings", "2", "embedded"), (4, "embeddings", "3", "embedded"), (4, "embeddings", "4", "embedded"),
        (5, "embeddings", "2", "deleted with its memory"), (5, "links", "2", "deleted with its memory"), (5, "links", "2", "deleted with its memory"), (5, "memories", "2", "deleted"),
    ]
    # The state before is there to be read, and a second run finds nothing to do.
    assert store.table("memories", 1).count() == 4
    assert {r.found for r in M.run(store, PHASES).collect()} == {0}


def test_a_phase_that_fails_changes_nothing(spark, tmp_path):
    def broken(table):
        new, audit = M.purge(NOW, ("links",))(table)
        return {**new, "links": new["links"].withColumn("entity_id", F.raise_error(F.lit("no such store")))}, audit

    store = M.opened(spark, str(tmp_path / "s"), _tables(spark))
    report = {r.phase: (r.status.split(":")[0], r.found) for r in M.run(store, {"truth_rewrite": M.truth_rewrite, "broken": broken, "fact_resolve": M.fact_resolve(NOW)}).collect()}
    assert report == {"truth_rewrite": ("ok", 2), "broken": ("failed", 0), "fact_resolve": ("ok", 2)}
    assert store.table("memories").count() == 4 and store.table("links").count() == 4 and store.version() == 3
    dry = M.run(store, PHASES, dry_run=True).collect()
    assert {r.status for r in dry} == {"dry run"} and store.version() == 3


def _query(spark, monkeypatch, embed):
    """Rows of the query over the small tables, with another embedder."""
    hung = spark.createDataFrame([(1,), (2,)], "memory_id long")
    monkeypatch.setattr(maintenance_queries, "_tables", lambda s, d: {**_tables(s), "chunks": hung, "usage": hung})
    monkeypatch.setattr(search, "hash_embedded", embed)
    return {(r.phase, r.table_name, r.change): r.n for r in maintenance_queries.maintenance_run(spark, "").collect()}


def test_the_query_ends_with_an_error_if_a_phase_fails(spark, monkeypatch):
    down = lambda texts: texts.select("id", F.raise_error(F.lit("no such model")).cast("array<double>").alias("vec"))
    with pytest.raises(RuntimeError, match="^embed_stale failed: .*no such model"):
        _query(spark, monkeypatch, down)


def test_the_query_tells_who_got_no_vector(spark, monkeypatch):
    some = lambda texts: texts.select("id", F.when(F.col("content") != "two", F.array(F.lit(1.0))).alias("vec"))
    got = _query(spark, monkeypatch, some)
    assert {change: n for (phase, _, change), n in got.items() if phase == "embed_stale"} == {"embedded": 2, "not embedded": 2}


def test_retention_rules(spark):
    """1, 3, 14 and 30 days by kind, 90 for a success, nothing for other kinds; never shorter, and pinned for ever."""
    day = 86400
    kinds = ["selected", "injected", "expanded", "used", "ignored", "rejected", "corrected"]
    memories = spark.createDataFrame([(i, "active", 50) for i in range(7)] + [(7, "pinned", 50), (8, "active", 10**9), (9, "active", None), (10, "active", 50)], "id long, lifecycle string, expires_at long")
    usage = spark.createDataFrame([(i, k, 100, False) for i, k in enumerate(kinds)] + [(7, "used", 100, False), (8, "used", 100, False), (9, "selected", 100, False), (10, "used", 100, True), (10, "selected", 500, False)], "memory_id long, usage_type string, used_at long, successful boolean")
    got = {r.id: (r.expires_at, r.review_at) for r in M.retention(memories, usage).collect()}
    review = 100 + 30 * day
    assert got == {
        0: (100 + day, None), 1: (100 + 3 * day, None), 2: (100 + 14 * day, review), 3: (100 + 30 * day, review), 4: (50, None), 5: (50, None), 6: (50, None),
        7: (None, review), 8: (10**9, review), 9: (100 + day, None), 10: (100 + 90 * day, review),
    }


def test_jobs_that_fail(spark):
    jobs = spark.createDataFrame([(n, n) for n in (0, 1, 2, 9, 10, 11)], "job_id long, attempts int")
    got = {r.job_id: (r.status, r.available_at) for r in M.failed_jobs(jobs, 1000).collect()}
    assert got == {0: ("retry", 1001), 1: ("retry", 1001), 2: ("retry", 1002), 9: ("retry", 1256), 10: ("dead", None), 11: ("dead", None)}
    assert M.failed_jobs(jobs.where("job_id = 9"), 0, base=30).first().available_at == 300
    due = lambda *rows: M.oldest_due(spark.createDataFrame(list(rows), "status string, available_at long, lease_until long"), 100).first().age
    assert due(("pending", 90, None), ("retry", 200, None), ("processing", 10, 70), ("dead", 1, 1)) == 30
    assert due(("pending", 101, None), ("processing", 1, 300)) == 0

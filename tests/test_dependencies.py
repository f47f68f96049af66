"""Cached packs against sources of many kinds."""

from pyspark.sql import functions as F

from lorebase.operators import packs


def test_a_source_takes_all_its_entries_along(spark):
    frame = spark.createDataFrame
    log = frame(
        [(e, "task", "t1", "h1") for e in (1, 2, 3, 4, 5, 7)] + [(1, "skill", "s1", "a"), (2, "skill", "s2", "b"), (3, "memory", "p", "m"), (4, "handoff", "h", "x"), (5, "skill", "s1", "a"), (7, "skill", "s1", "a")],
        "entry_id long, kind string, dep_id string, hash string",
    )
    current = frame([("task", "t1", "h1"), ("skill", "s1", "a"), ("skill", "s2", "changed"), ("memory", "p", "other"), ("task", "skill", "a")], "kind string, dep_id string, hash string")
    entries = frame([(1, "fresh", None, "v2"), (2, "fresh", 200, "v2"), (3, "fresh", 100, "v2"), (4, "fresh", None, "v2"), (5, "fresh", None, "v1"), (6, "fresh", None, "v2"), (7, "fresh", None, "v2"), (8, "stale", None, "v2")], "entry_id long, status string, expires_at long, policy_version string")
    entries = entries.join(packs.dependency_print(log), "entry_id", "left")
    # One recorded row of entry 7 is gone since its digest was taken.
    recorded = log.where(~((F.col("entry_id") == 7) & (F.col("kind") == "skill")))
    got = {r.entry_id: (r.valid, r.reason, r.changed) for r in packs.typed_validity(entries, recorded, current, "v2", 100).collect()}
    assert got == {
        1: (True, None, ""), 2: (False, "source_changed", "skill"), 3: (False, "ttl_expired", "memory"), 4: (False, "source_changed", "handoff"), 5: (False, "policy_changed", ""),
        6: (False, "missing_dependencies", ""), 7: (False, "dependency_mismatch", ""), 8: (False, "stale", ""),
    }
    # The task changes: every entry with it falls.
    after = packs.typed_validity(entries, recorded, current.withColumn("hash", F.when(F.col("dep_id") == "t1", "h2").otherwise(F.col("hash"))), "v2", 0)
    assert {r.entry_id for r in after.where("reason = 'source_changed' AND changed LIKE '%task%'").collect()} == {1, 2, 3, 4, 7}

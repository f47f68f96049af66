"""Steps whose work or memory grew faster than their input."""

from pyspark.sql import functions as F

from lorebase.operators import graph, maintenance, packs, search, sequence
from lorebase.sources import scratch


def test_texts_are_embedded_once(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def embed(texts):
        def run(batches):
            for pdf in batches:
                seen.add(len(pdf))
                yield pdf[["id"]].assign(vec=[[1.0]] * len(pdf))

        return texts.mapInPandas(run, "id long, vec array<double>")

    memories = spark.createDataFrame([(1, "a"), (2, None), (3, "c")], "id long, content string")
    held = spark.createDataFrame([(3, "ready", "m", memories.select(F.sha2(F.lit("c"), 256)).first()[0], [2.0])], "memory_id long, status string, model string, content_hash string, vec array<double>")
    store = maintenance.opened(spark, str(tmp_path / "s"), {"memories": memories, "embeddings": held})
    assert maintenance.run(store, {"embed": maintenance.embed_stale("m", embed)}).first()["found"] == 2
    assert {(r.memory_id, r.vec[0]) for r in store.table("embeddings").collect()} == {(1, 1.0), (2, 1.0), (3, 2.0)}
    assert seen.value == 2


def test_tasks_grow_with_rows(spark, monkeypatch):
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert scratch.tasks_for(spark.range(10), 100) == least and scratch.tasks_for(spark.range(100), 10) == 11
    monkeypatch.setattr(sequence, "PACKED", 2)
    items = spark.range(40).select(F.col("id").alias("request"), F.lit("memory").alias("kind"), F.lit(1).alias("place"), F.lit("c").alias("category"), F.lit(10).alias("content_tokens"), F.lit(5).alias("summary_tokens"), F.lit(3).alias("reference_tokens"), F.lit("t").alias("text_key"), F.lit(False).alias("needs_check"))
    asked = spark.range(40).select(F.col("id").alias("request"), F.lit(1000).alias("budget"), F.lit(0).alias("mandatory_tokens"), F.lit(0).alias("continuity_tokens"), F.lit(0).alias("continuity_brief_tokens"), F.lit(True).alias("references"))
    packed = sequence.pack(asked, items)
    assert packed.rdd.getNumPartitions() == 21 and packed.where("disposition = 'inline'").count() == 40
    assert search.SCORED * 400 < 1 << 20


def test_steps_are_dealt_by_edges(spark, monkeypatch):
    monkeypatch.setattr(graph, "STEPPED", 2)
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("a", "e")], "src string, dst string")
    got = {(r.id, r.distance) for r in graph.around(edges, spark.createDataFrame([("a",)], "src string"), 2).collect()}
    assert got == {("a", 0), ("b", 1), ("e", 1), ("c", 2)}


def test_lost_rows_are_told_in_one_pass(spark):
    entries = spark.createDataFrame([(i, "fresh", 500, "v2") for i in (1, 2, 3, 4)], "entry_id long, status string, expires_at long, policy_version string")
    log = spark.createDataFrame([(1, "task", "t", "h", False), (1, "skill", "s", "h", True), (2, "task", "t", "h", False), (3, "task", "t", "old", False), (4, "task", "t", "h", True)], "entry_id long, kind string, dep_id string, hash string, lost boolean")
    now = spark.createDataFrame([("task", "t", "h")], "kind string, dep_id string, hash string")
    got = {r.entry_id: (r.reason, r.changed) for r in packs.typed_validity(entries, log, now, "v2", 100).collect()}
    assert got == {1: ("dependency_mismatch", ""), 2: (None, ""), 3: ("source_changed", "task"), 4: ("missing_dependencies", "")}


def test_packs_are_laid_beside_the_one_before(spark):
    order = spark.createDataFrame([(1, 2), (2, None)], "pack_id long, next_id long")
    items = spark.createDataFrame([(1, 1, 7, 5), (1, 2, 8, 5), (2, 1, 7, 5), (2, 3, 9, 5)], "pack_id long, place int, memory_id long, tokens long")
    got = {(r.request_id, r.place): (r.item, r.tokens, r.here, r.old) for r in packs.sections(order, items).collect()}
    assert got == {(1, 1): (7, 5, True, None), (1, 2): (8, 5, True, None), (2, 1): (7, 5, True, 7), (2, 2): (None, None, False, 8), (2, 3): (9, 5, True, None)}


def test_two_sides_differ(spark):
    a = spark.createDataFrame([(1, 1), (1, 1), (1, 2), (2, 5)], "k long, v long")
    b = spark.createDataFrame([(1, 1), (1, 3), (3, 9), (2, 5)], "k long, v long")
    assert {(r.k, r.differing) for r in packs.differing(a, b, "k", "v").collect()} == {(1, 2), (3, 1)}

"""Names of any length, proper nouns and the edges of a text, by plain regular expressions."""

import random
import re

from pyspark.sql import functions as F

from lorebase.operators import entities as E

NAMES = "entity_id string, name string, kind string, alias int, registered int, rank int"


def test_mentions_are_those_of_a_search_for_each_name(spark):
    rng = random.Random(6)
    words = ["red", "Red", "fox", "foxes", "node.js", "node", "js", "c++", "New", "york", "new-york", "über", "a_b", "a", "b"]
    texts = [(i, "".join(rng.choice(words) + rng.choice([" ", ". ", ", ", "-", "  ", "\n"]) for _ in range(rng.randint(0, 40)))) for i in range(120)] + [(900, None), (901, ""), (902, "red " * 5000)]
    names = ["red", "red fox", "red fox red fox", "node.js", "new york", "new-york", "über", "a", "a_b", "fox, red", "york", "absent name"]
    frame = spark.createDataFrame([(f"e{k}", n, "x", 0, 0, k) for k, n in enumerate(names)], NAMES)
    got = {(r.id, r.name) for r in E.mentions(spark.createDataFrame(texts, "id long, text string"), frame).collect()}
    want = {(i, n) for i, t in texts for n in names if re.search(r"(?<!\w)" + re.escape(n) + r"(?!\w)", t or "", re.I)}
    assert got == want and {n for _, n in got} >= {"red fox", "new-york", "node.js", "fox, red"}


def test_detection_order_confidence_and_edges(spark):
    names = spark.createDataFrame(
        [("ema", "Ema", "person", 0, 0, 0), ("ema", "Emma Lee", "person", 1, 0, 1), ("prism", "Prism", "project", 0, 0, 2), ("core", "core engine", "tool", 0, 1, 3), ("core", "core", "tool", 1, 1, 4)], NAMES
    )
    texts = spark.createDataFrame([(1, "Today Emma Lee decided Prism stays small. The core runs. It met Zorba there."), (2, "Nothing to see."), (3, "the core engine needs Ema and Zorba, the library Ema"), (4, None)], "id long, text string")
    rows = [(r.id, r.turn, r.entity_id, r.kind, r.confidence, r.is_new, r.edge) for r in E.detected(texts, names).orderBy("id", "turn").collect()]
    assert rows == [
        (1, 1, "ema", "person", 0.85, False, "decided_about"), (1, 2, "prism", "project", 0.9, False, "decided_about"), (1, 3, "core", "tool", 0.8, False, "mentions"),
        (1, 4, "emma", "person", 0.5, True, "decided_about"), (1, 5, "lee", "person", 0.5, True, "decided_about"), (1, 6, "zorba", "person", 0.5, True, "mentions"),
        (3, 1, "ema", "person", 0.9, False, "depends_on"), (3, 2, "core", "tool", 0.85, False, "depends_on"), (3, 3, "zorba", "person", 0.5, True, "depends_on"),
    ]
    new, edges = E.wired(texts, names)
    assert {(r.entity_id, r.tier, r.memory_id) for r in new.collect()} == {("emma", "cold", 1), ("lee", "cold", 1), ("zorba", "cold", 1)}
    edges = {(r.src, r.dst, r.kind): (r.confidence, r.memory_id) for r in edges.collect()}
    assert edges["ema", "prism", "decided_about"] == (0.85, 1) and edges["core", "ema", "mentions"] == edges["ema", "core", "mentions"] == (0.8, 1)
    assert edges["core", "zorba", "depends_on"] == (0.85, 3) and ("prism", "prism", "mentions") not in edges and ("core", "ema", "decided_about") not in edges


def test_ten_of_a_text_are_linked(spark):
    names = spark.createDataFrame([(f"e{k:02}", f"name{k:02}", "x", 0, 0, k) for k in range(14)], NAMES)
    texts = spark.createDataFrame([(1, " ".join(f"name{k:02}" for k in range(13, -1, -1)))], "id long, text string")
    edges = E.wired(texts, names)[1]
    assert edges.count() == 90 and edges.where(F.col("src") > "e09").count() == 0

"""Every query that has SQL gives DuckDB's rows; the others hold their own properties."""

import glob
import json
import os
import random

import duckdb
import pytest

from lorebase.operators import fold, graph, search, sequence
from lorebase.plans.catalog import ORACLE_SQL, QUERIES
from lorebase.streaming import ingest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


def plain(rows):
    clean = lambda x: None if x is None else round(float(x), 5) + 0.0 if isinstance(x, float) else str(x)
    return sorted((tuple(clean(x) for x in r) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_rows(spark, duck, name):
    got = QUERIES[name](spark, SF)
    names = sorted(got.columns)
    want = duck.sql(f"SELECT {', '.join(names)} FROM ({ORACLE_SQL[name]}) q")
    assert plain(got.select(*names).collect()) == plain(want.fetchall())


def chunks_by_hand(text, target, overlap, threshold):
    """The rule word by word: pack while it fits, then step back until the overlap is reached."""
    text = (text or "").strip()
    if len(text) <= threshold * 4:
        return [text] if text else []
    words, out, i = text.split(), [], 0
    while True:
        j, size = i, 0
        while j < len(words) and (j == i or size + 1 + len(words[j]) <= target * 4):
            size += len(words[j]) + (j > i)
            j += 1
        out.append(" ".join(words[i:j]))
        if j == len(words):
            return out
        k, kept = j, 0
        while k - 1 > i and kept < overlap * 4:
            k -= 1
            kept += len(words[k]) + 1
        i = max(k, i + 1)


def test_chunks(spark):
    rng = random.Random(4)
    texts = [None, "", "  \n ", "short  text ", "x" * 9000, " a b " * 40, "y" * 300 + " z"]
    texts += [" ".join("w" * rng.randint(1, 40) for _ in range(rng.randint(1, 400))) for _ in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, content string")
    for target, overlap, single in ((64, 8, 64), (16, 15, 4), (5, 0, 1), (512, 64, 512)):
        rows = sorted(fold.chunks(docs, target, overlap, single).collect())
        assert [(r.id, r.chunk_index, r.chunk) for r in rows] == [(i, n, c) for i, t in enumerate(texts) for n, c in enumerate(chunks_by_hand(t, target, overlap, single))]


def test_budget_skips_and_goes_on(spark):
    df = spark.createDataFrame([("a", i, s) for i, s in enumerate([5, 9, 3, 2, 1])] + [("b", 0, 11)], "k string, n long, s long")
    got = {(r.k, r.n) for r in sequence.within_budget(df, ["k"], ["n"], "s", 10).collect() if r.taken}
    assert got == {("a", 0), ("a", 2), ("a", 3)}


def test_cosine_edges(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 2.0]), (3, [-1.0, 0.0]), (4, [0.0, 0.0]), (5, None)], "id long, vec array<double>")
    q = spark.createDataFrame([(0, [3.0, 0.0])], "query_id long, vec array<double>")
    assert [(r.id, r.score) for r in search.nearest(v, q, 9).orderBy("rank").collect()] == [(1, 1.0), (2, 0.0), (4, 0.0), (3, -1.0)]


def test_hops(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("x", "y")], "src string, dst string")
    got = graph.hops(e, spark.createDataFrame([("a",)], "id string"), 2)
    assert {(r.id, r.distance) for r in got.collect()} == {("a", 0), ("b", 1), ("c", 2)}


def test_ingest_twice_is_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    good = {"session": "s", "content": "hello there", "ts": "2024-01-01T00:01:00"}
    lines = [{"event_id": "1", "session": "s", "content": "fix the bug", "ts": "2024-01-01T00:00:00"}] * 2 + [good, good, {"content": " ", "ts": "2024-01-01"}, {"content": "x" * 100_001, "ts": "2024-01-01"}, {"content": "timeless"}]
    (tmp_path / "in/a.txt").write_text("\n".join(map(json.dumps, lines)) + "\nnot json\n[1]\n")
    for _ in range(2):
        for start in (ingest.ingest, ingest.dead_letters):
            start(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / start.__name__)).awaitTermination()
    found = spark.read.parquet(str(tmp_path / "out/events")).collect()
    assert sorted(r.gate.decision for r in found) == ["ACTIVE", "SKIP"]
    letters = spark.read.parquet(str(tmp_path / "out/dead")).collect()
    assert sorted(r.reason.split()[0] for r in letters) == ["content", "content", "payload", "payload", "ts"] and {r.subject for r in letters} == {"memory.capture"}

"""Substring dedup, near-dedup and components against brute force."""

import hashlib
import random
import re
from collections import defaultdict

import pytest

from lorebase.llm import components, near_dedup, substring_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def texts():
    """Random texts, exact and near copies at many distances, shared passages, long, short, empty and null texts."""
    rng = random.Random(11)
    vocab = [f"w{i}" for i in range(300)]
    out = [" ".join(rng.choices(vocab, k=rng.randint(1, 160))) for _ in range(60)]
    base = rng.choices(vocab, k=120)
    for k in range(70):
        copy = list(base)
        for _ in range(k % 14):
            copy[rng.randrange(120)] = rng.choice(vocab)
        out.append("  ".join(copy) if k % 3 else " ".join(copy).upper())
    passage = " ".join(rng.choices(vocab, k=55))
    out += [f"{' '.join(rng.choices(vocab, k=30))}\n{passage} {' '.join(rng.choices(vocab, k=30))}" for _ in range(12)]
    out += [None, "", " \n\t ", "one two", "One TWO", "a b c d e", " ".join(rng.choices(vocab, k=20_000)), ("x y z " * 400).strip(), out[0], out[0], "é ß à " * 30]
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, 5, "k") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows + [rows[3]], "doc_id long, text string, n_words int, kept string").repartition(7).cache()


def test_substring(docs, texts):
    seen, gone = {}, defaultdict(set)
    own = [WORD.findall(t or "") for t in texts]
    for d, w in enumerate(own):
        for i in range(len(w) - 19):
            key = tuple(w[i : i + 20])
            if key in seen:
                gone[d] |= set(range(i, i + 20))
            seen.setdefault(key, (d, i))
    rows = substring_dedup.dedup(docs).collect()
    assert len(rows) == len(texts) + 1
    for r in rows:
        kept = " ".join(w for i, w in enumerate(own[r.doc_id]) if i not in gone[r.doc_id])
        assert (r.n_words, r.n_removed, r.kept_sha256) == (len(own[r.doc_id]), len(gone[r.doc_id]), hashlib.sha256(kept.encode()).hexdigest())
        covered = [j for f in r.factors for j in range(f.start, f.start + f.length)]
        assert sorted(covered) == sorted(gone[r.doc_id])
        # Each factor stands, word for word, at an earlier place of the reference.
        for f in r.factors:
            assert own[r.doc_id][f.start : f.start + f.length] == own[f.doc][f.place : f.place + f.length] and (f.doc, f.place) < (r.doc_id, f.start)
    assert substring_dedup.dedup(docs.limit(0)).count() == 0


def shingles(t):
    w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_near(docs, texts):
    sets = [shingles(t) for t in texts]
    best = list(range(len(texts)))
    changed = True
    links = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j])]
    while changed:
        changed = False
        for i, j in links:
            low = min(best[i], best[j])
            changed |= (best[i], best[j]) != (low, low)
            best[i] = best[j] = low
    rows = near_dedup.near_duplicates(docs).collect()
    assert len(rows) == len(texts) + 1
    for r in rows:
        assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), best[r.doc_id], best[r.doc_id] == r.doc_id)
    assert near_dedup.near_duplicates(docs.limit(0)).count() == 0


def test_stage_threshold(spark):
    """The pipeline stage drops pairs from 0.80 on, of which op8's threshold leaves those below 0.85."""
    rng = random.Random(6)
    texts, near = [], {}
    for k in range(40):
        base = [f"v{rng.randrange(10**6)}" for _ in range(200)]
        copy = list(base)
        for i in range(k % 8):
            copy[10 + 20 * i] = "changed"
        texts += [" ".join(base), " ".join(copy)]
        a, b = map(shingles, texts[-2:])
        near[2 * k + 1] = 100 * len(a & b) / len(a | b)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert any(80 <= s < 85 for s in near.values()) and any(s < 80 for s in near.values())
    for percent, got in ((85, near_dedup.near_duplicates(df).where("not kept")), (80, df.join(near_dedup.clean(df), "doc_id", "left_anti"))):
        assert {r.doc_id for r in got.collect()} == {d for d, s in near.items() if s >= percent}
    assert [near_dedup.may_differ(p) for p in (85, 80)] == [54, 65]


def test_null_ids(spark):
    df = spark.createDataFrame([(None, "a b c d e f"), (None, "a b c d e f"), (1, "a b c d e f")], "doc_id long, text string")
    assert all(r.kept for r in near_dedup.near_duplicates(df).collect())
    assert substring_dedup.dedup(df).where("doc_id is null").count() == 2


def test_repeated_ids_lose_no_text(spark):
    """Rows are dropped, not ids: another text under a dropped copy's doc_id stays, whatever the columns are called."""
    a, b, c = "one two three four five six", "seven eight nine ten eleven twelve", "alpha beta gamma delta epsilon zeta"
    rows = [(3, a), (5, a), (5, b), (7, c), (7, c.upper()), (7, b), (9, b), (2, ""), (2, ""), (None, a), (4, None), (8, c), (6, "x y"), (6, "x y")]
    df = spark.createDataFrame([(i, t, 1, 2, 3, "o") for i, t in rows], "doc_id long, text string, node int, key int, component int, _own string").repartition(3)
    left = near_dedup.clean(df)
    assert left.columns == df.columns
    got = sorted(((r.doc_id, r.text) for r in left.collect()), key=str)
    low = min((c, c.upper()), key=lambda t: spark.createDataFrame([(t,)], "t string").selectExpr("xxhash64(t)").first()[0])
    assert got == sorted([(3, a), (5, b), (7, low), (2, ""), (2, ""), (None, a), (4, None), (6, "x y")], key=str)
    found = {(r.doc_id, r.component_id) for r in near_dedup.near_duplicates(df).collect() if r.doc_id == 5}
    assert found == {(5, 3), (5, 5)}


def test_factors_reach_furthest():
    found = [(0, 30, 1, 100), (5, 27, 2, 0), (12, 40, 3, 50), (35, 60, 1, 7), (70, 95, 4, 0)]
    assert substring_dedup.factors(found) == [(0, 30, 1, 100), (30, 10, 3, 68), (40, 20, 1, 12), (70, 25, 4, 0)]
    assert substring_dedup.factors([]) == []


def test_repeated_ids_keep_their_own_words(spark):
    """Texts under one doc_id are told apart: the answers of one delete nothing from another."""
    rng = random.Random(8)
    a, b = (" ".join(f"{x}{rng.randrange(10**6)}" for _ in range(60)) for x in "ab")
    rows = [(3, a), (5, a), (5, b), (5, b), (6, b)]
    got = sorted((r.doc_id, r.n_removed) for r in substring_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(3, 0), (5, 0), (5, 0), (5, 60), (6, 60)]


def test_components(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(100, 160)] + [(200, i) for i in range(201, 260)] + [(rng.randrange(300, 400), rng.randrange(300, 400)) for _ in range(60)]
    best = {v: v for e in edges for v in e}
    for _ in range(200):
        for a, b in edges:
            best[a] = best[b] = min(best[a], best[b])
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    loops = {a for a, b in edges if a == b} - {v for a, b in edges if a != b for v in (a, b)}
    assert got == {v: c for v, c in best.items() if v not in loops}

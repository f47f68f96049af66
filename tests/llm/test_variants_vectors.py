"""Spelling variants, ball k-means and KD-tree search against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from lorebase.llm import ball_kmeans, kdtree, spelling


def _words(rows):
    counts = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            counts[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 31 == 0 else run] += 1
    return {w: n for w, n in counts.items() if n >= 2 and len(w) >= 7}


def _one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def _variants(rows):
    count = _words(rows)
    near = {w: [x for x in count if x != w and _one_edit(w, x)] for w in count}
    best = {w: min(x, key=lambda o: (-count[o], o)) for w, x in near.items() if x}
    form = {w: x for w, x in best.items() if count[x] >= 10 * count[w]}
    out = []
    for w, n in count.items():
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n, len(near[w]), count.get(form.get(w))))
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def texts():
    """Words and their misspellings, words of few letters that repeat, runs of one letter, accents, capitals, a very long run."""
    rng = random.Random(5)
    letters = "abcdeéÿÀz"
    out, base = [], ["".join(rng.choices(letters, k=rng.randint(7, 14))) for _ in range(25)]
    for _ in range(160):
        text = []
        for _ in range(40):
            w = rng.choice(base[: rng.choice((3, 25))])
            for _ in range(rng.choice((0, 0, 0, 1, 1, 2))):
                i = rng.randrange(len(w))
                w = rng.choice((w[:i] + w[i + 1 :], w[:i] + rng.choice(letters) + w[i:], w[:i] + rng.choice(letters) + w[i + 1 :]))
            text.append(w.upper() if rng.random() < 0.1 else w)
        out.append(" ".join(text))
    out += ["aaaaaaa aaaaaaaa aaaaaaaaa aaaabaaa baaaaaaa aaaaaaab " * 3, "abababab babababa abababa abababababab abababbabab " * 3, None, "", "1 2 ., kurz", "x" * 300_000 + " " + "x" * 300_000 + "y"]
    return [(i, t) for i, t in enumerate(out)] + [(None, out[0]), (3, out[3]), (3, out[4])]


def test_variants(spark, texts, monkeypatch):
    docs = spark.createDataFrame([(d, t, 1, "w") for d, t in texts], "doc_id long, text string, n int, word string").repartition(5)
    want = _variants(texts)
    rows = lambda: sorted((tuple(r[c] for c in ("word", "form", "root", "n", "n_near", "form_n")) for r in spelling.variants(docs).collect()), key=repr)
    assert rows() == want and any(w[1] for w in want) and any(w[1] and w[2] != w[1] for w in want)
    # Long lists in parts.
    monkeypatch.setattr(spelling, "BLOCK", 8)
    assert rows() == want
    assert spelling.variants(docs.limit(0)).count() == 0


def test_first_grams_hold_two_apart():
    """Near words share one of their first grams, whatever the order of the grams."""
    rng = np.random.default_rng(3)
    for _ in range(300):
        a = rng.integers(97, 100, rng.integers(7, 12)).astype(np.uint8)
        i = rng.integers(len(a))
        b = np.insert(a, i, 97) if rng.random() < 0.5 else np.concatenate((a[:i], [a[i] ^ 3], a[i + 1 :]))
        b, order = b.astype(np.uint8), rng.permutation(1 << 12)
        found = []
        for w in (a, b):
            row, place, code, first = spelling._grams(w, np.array([0, len(w)]))
            lead, needed = spelling._leading(row, place, order[code & 4095], first)
            found.append({(int(code[k]), int(place[k])) for k in lead[needed]})
        longer = len(b) - len(a)
        assert any((c, p + s) in found[1] for c, p in found[0] for s in range(longer + 1))


def _kmeans(rows, k, rounds, dims):
    kept = [(i, np.floor(np.array(v, np.float64) * 256).astype(np.int64)) for i, v in rows if v is not None and len(v) == dims and None not in v and np.isfinite(np.array(v, float)).all()]
    h = lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1].tolist())
    cs = [r[1].tolist() for r in sorted(kept, key=h)[:k]]
    assign = lambda: [min((sum((int(a) - b) ** 2 for a, b in zip(x, c, strict=True)), j) for j, c in enumerate(cs)) for _, x in kept]
    for _ in range(rounds):
        at = assign()
        for j in range(len(cs)):
            own = [x for (_, x), (_, c) in zip(kept, at, strict=True) if c == j]
            if own:
                cs[j] = [int(s) // len(own) for s in np.sum(own, 0)]
    at = assign()
    sums = defaultdict(int)
    for d, c in at:
        sums[c] += d
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in cs]
    return sorted(((i, c, d, sums[c], sum(sums.values()), digest[c]) for (i, _), (d, c) in zip(kept, at, strict=True)), key=repr)


@pytest.fixture(scope="module")
def points():
    """Clusters, a coarse grid full of ties, one vector many times, and rows that take no part."""
    rng = np.random.default_rng(7)
    middle = rng.normal(size=(6, 4))
    rows = [(i, (middle[i % 6] + rng.normal(size=4) / 8).tolist()) for i in range(300)]
    rows += [(300 + i, (rng.integers(-2, 3, 4) / 256).tolist()) for i in range(200)]
    rows += [(500 + i, [0.25, -0.5, 0.0, 1.0]) for i in range(150)]
    bad = [None, [], [1.0, 2.0], [1.0, None, 2.0, 3.0], [float("nan"), 0.0, 0.0, 0.0], [float("inf"), 0.0, 0.0, 0.0]]
    return rows + [(700 + 100 * i, v) for i, v in enumerate(bad)] + [(None, [0.5, 0.5, 0.5, 0.5]), (100, rows[100][1]), (100, rows[7][1]), (1500, [1e30, -1e30, 0.0, 1.0])]


def _frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, 2.0) for i, v in rows], "vec_id long, embedding array<double>, cluster int, rank double").repartition(5)


@pytest.mark.parametrize("k", [1, 9, 40])
def test_ball_kmeans(spark, points, k):
    rows = [r for r in points if r[0] != 1500]
    got = ball_kmeans.cluster(_frame(spark, rows), k=k, rounds=3, dims=4)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == _kmeans(rows, k, 3, 4)


def test_ball_kmeans_edges(spark, points):
    assert ball_kmeans.cluster(_frame(spark, points), k=5, rounds=2, dims=4).where("vec_id = 1500").count() == 1
    few = ball_kmeans.cluster(_frame(spark, points[:3]), k=40, dims=4).collect()
    assert sorted(r.cluster for r in few) == [0, 1, 2] and {r.inertia for r in few} == {0}
    assert ball_kmeans.cluster(_frame(spark, points).limit(0), dims=4).collect() == []


def test_balls_prune_and_agree():
    """Members of the core are compared with nothing, others with the neighbours of their annulus alone."""
    rng = np.random.default_rng(1)
    centroids = rng.integers(-900, 900, (12, 3))
    x = centroids[rng.integers(0, 12, 4000)] + rng.integers(-250, 250, (4000, 3))
    from_all = ball_kmeans.Balls(centroids.tolist(), None)
    want, _ = ball_kmeans._moved(from_all, x, np.full(len(x), -1))
    start = np.where(rng.random(len(x)) < 0.2, rng.integers(0, 12, len(x)), want)
    radii = [int(np.sqrt(((x[start == i] - centroids[i]) ** 2).sum(1).max())) + 1 for i in range(12)]
    balls = ball_kmeans.Balls(centroids.tolist(), radii)
    got, distance = ball_kmeans._moved(balls, x, start)
    assert (got == want).all() and (distance == ((x - centroids[got]) ** 2).sum(1)).all()
    tight = ball_kmeans.Balls(centroids.tolist(), [100] * 12)
    assert sum(map(len, tight.near)) < sum(map(len, from_all.near))


def _topk(rows, k, every):
    kept = [(n, i, np.clip(np.floor(np.array(v, np.float64) * 1024), -kdtree.MOST, kdtree.MOST).astype(np.int64)) for n, (i, v) in enumerate(rows) if i is not None and v is not None and None not in v and np.isfinite(np.array(v, float)).all()]
    out = []
    for n, i, q in kept:
        if i % every == 0:
            best = sorted((-int(q @ x), j) for m, j, x in kept if m != n and len(x) == len(q))[:k]
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(best)]
    return sorted(out)


@pytest.mark.parametrize("shard, block", [(8192, 8192), (70, 3)])
def test_exact_topk(spark, points, monkeypatch, shard, block):
    monkeypatch.setattr(kdtree, "SHARD", shard)
    monkeypatch.setattr(kdtree, "BLOCK", block)
    got = kdtree.search(_frame(spark, points), k=10, every=50)
    assert sorted(map(tuple, got.collect())) == _topk(points, 10, 50)
    assert kdtree.search(_frame(spark, points).limit(0)).count() == 0


def test_tree_prunes(monkeypatch):
    """Boxes bound their vectors tightly; with a near kth score only a part of the leaves is read."""
    rng = np.random.default_rng(2)
    x = (rng.normal(size=(16, 6))[rng.integers(0, 16, 5000)] * 1000 + rng.normal(size=(5000, 6)) * 30).astype(np.int32)
    parts = kdtree.built(np.arange(5000), np.arange(5000), x)
    tree = kdtree.Tree(6, **{p: np.ascontiguousarray(parts[p], kdtree.PARTS[p]).tobytes() for p in kdtree.PARTS})
    for (lo, hi, *_), low, high in zip(tree.nodes, tree.low, tree.high, strict=True):
        assert (tree.vectors[lo:hi].min(0) == low).all() and (tree.vectors[lo:hi].max(0) == high).all()
    read, product = [], kdtree.product
    bound = tree.bounds(x[:1])[0]
    monkeypatch.setattr(kdtree, "product", lambda a, b: read.append(len(b)) or product(a, b))
    found = tree.best(x[0], bound, 10, 0, (-kdtree.NONE, -kdtree.NONE))
    assert found == sorted((-int(x[0].astype(int) @ x[j]), j) for j in range(1, 5000))[:10]
    assert sum(read) < 2500
    # Nothing comes before a kth that is better than all.
    assert tree.best(x[0], bound, 10, 0, (found[0][0] - 1, 0)) == []

"""Brute-force versions of line dedup and decontamination."""

import random

from lorebase.llm import decontam, line_dedup
from tests.llm import plain


def _same(got, docs):
    """Counts, kept text and runs of each row; each run stands line for line at its source, an earlier place."""
    want, runs = plain.without_copied_lines(docs), plain.copied_runs(docs)
    texts = {(d, plain.text_key(t)): t.split("\n") for d, t in docs if t is not None}
    for r in got:
        d, t = r.doc_id, r.text
        assert (r.n_lines, r.n_removed, r.kept_text) == want[d, t], d
        found = [(x.start, x.length) for x in r.runs or ()]
        assert found == runs.get((d, t), []) and r.longest == max((n for _, n in found), default=0), d
        for x in r.runs or ():
            at = x.source
            assert texts[at.doc_id, at.key][at.start : at.start + x.length] == t.split("\n")[x.start : x.start + x.length]
            assert (at.doc_id if at.doc_id is not None else -1, at.key, at.start) < (d if d is not None else -1, plain.text_key(t), x.start)


def test_line_dedup(spark):
    rng = random.Random(3)
    pool = [f"line {i}." for i in range(25)] + ["", "  "]
    docs = {i: "\n".join(rng.choices(pool, k=rng.randint(1, 14))) for i in range(60)}
    docs |= {60: None, 61: "", 62: "\n\n\n", 63: "x\ny\n" * 45, 64: "a\nb", 65: "a\nb", 66: "same\nsame\nsame\nsame", 67: "q\n\n\n\n\nr", 68: "p\nq\n\n\n\n\nr\ns"}
    # Runs of many lengths, cut out of one text at many places.
    whole = [f"part {i}" for i in range(300)]
    for i in range(69, 110):
        at = rng.randrange(280)
        docs[i] = "\n".join([f"own {i}", *whole[at : at + rng.randint(1, 130)], f"end {i}", *whole[:5]])
    rows = [(i, t, "e", i) for i, t in docs.items()]
    df = spark.createDataFrame([(i, i, t, k, n) for i, t, k, n in rows + [rows[64]]], "other long, doc_id long, text string, kept_text string, n_lines int")
    got = line_dedup.dedup(df).collect()
    assert len(got) == len(rows) + 1 and max(r.longest for r in got) > 64
    _same(got, list(docs.items()))
    assert line_dedup.dedup(df.limit(0)).count() == 0
    left = line_dedup.clean(df)
    assert left.columns == df.columns and 65 not in {r.doc_id for r in left.collect()}


def test_runs_have_one_source(spark):
    """Windows of different sources are runs of their own; null ids and texts under one id are told apart."""
    docs = [(1, "A\nB"), (2, "B\nC"), (3, "A\nB\nC"), (4, "A\nB\nC"), (None, "B\nC\nD"), (5, "C\nD\nE"), (5, "D\nE\nF"), (6, "A\nB\nC\nD\nE\nF")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = line_dedup.dedup(df).collect()
    _same(got, docs)
    three, four = ([r for r in got if r.doc_id == i][0] for i in (3, 4))
    assert three.longest == 2 and len(three.runs) == 2 and three.n_removed == 3
    assert four.longest == 3 and [(x.start, x.length, x.source.doc_id) for x in four.runs] == [(0, 3, 3)]


def test_very_many_lines(spark):
    """A document of 50,000 lines, copied with a line changed, and one line very often."""
    text = [f"line {i % 30_011} of many" for i in range(50_000)]
    other = [*text[:20_000], "changed", *text[20_001:]]
    df = spark.createDataFrame([(1, "\n".join(text)), (2, "\n".join(other)), (3, "same\n" * 20_000)], "doc_id long, text string")
    got = {r.doc_id: r for r in line_dedup.dedup(df).collect()}
    # The first 30,011 lines are new; what follows repeats them.
    assert got[1].n_removed == 19_989 and [(x.start, x.length) for x in got[1].runs] == [(30_011, 19_989)]
    assert [(x.start, x.length) for x in got[2].runs] == [(0, 20_000), (20_001, 29_999)] and got[2].kept_text == "changed"
    assert [(x.start, x.length) for x in got[3].runs] == [(1, 19_999)]


def test_long_single_lines(spark):
    """A copied line of 20 words or more goes wherever it stands; a shorter one stays."""
    rng = random.Random(9)
    pool = [" ".join(rng.choices("abcdefgh", k=n)) for n in (3, 18, 19, 20, 21, 60, 60, 680)] + ["  " + "w\t" * 19 + "w ", "w " * 19, "x" * 90]
    docs = {0: "head\n" + pool[5] + "\ntail", 1: pool[5] + "\nother", 2: pool[7], 3: pool[7], 4: None, 5: "a\n" + pool[4] + "\nb\n" + pool[4] + "\nc"}
    docs |= {i: "\n".join(x for k in range(rng.randint(1, 9)) for x in (rng.choice(pool), f"own {i} {k}")) for i in range(6, 80)}
    want, seen = {}, set()
    for d in sorted(docs):
        lines = (docs[d] or "").split("\n") if docs[d] is not None else []
        gone = set()
        for i, x in enumerate(lines):
            if len(x.split()) >= 20:
                if x in seen:
                    gone.add(i)
                seen.add(x)
        want[d] = (len(lines), len(gone), "\n".join(x for i, x in enumerate(lines) if i not in gone))
    df = spark.createDataFrame([*docs.items(), (3, docs[3])], "doc_id long, text string").repartition(5)
    got = line_dedup.dedup(df).collect()
    assert len(got) == len(docs) + 1
    for r in got:
        assert (r.n_lines, r.n_removed, r.kept_text) == want[r.doc_id], r.doc_id
    assert want[1] == (2, 1, "other") and want[3][1] == 1 and want[5][1] == 1
    assert 3 not in {r.doc_id for r in line_dedup.clean(df).collect()}


def test_leaks(spark):
    rng = random.Random(5)
    vocab = [f"w{i}" for i in range(400)]
    items = [(i, " ".join(rng.choices(vocab, k=rng.randint(8, 60)))) for i in range(30)] + [(90, "too short"), (91, None)]
    docs, want = [], set()
    for d in range(120):
        w = rng.choices(vocab, k=rng.randint(0, 200))
        if d % 3 == 0:
            item, text = items[d % 30]
            part = text.upper().split() if d % 2 else [x + "," for x in text.split()]
            for k in range(d % 4 if len(part) > 20 else 0):
                part[(7 * k + 5) % len(part)] = "changed"
            at = rng.randint(0, len(w))
            w[at:at] = part
            want.add((d, item))
        docs.append((d, " ".join(w)))
    docs += [(500, None), (501, ""), (502, " ".join(rng.choices(vocab, k=40_000))), docs[3]]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as item_id", "'x' as seed")
    bench = spark.createDataFrame(items + [items[0]], "item_id long, text string").selectExpr("*", "2 as doc_id")
    got = decontam.leaks(df, bench)
    assert {(r.doc_id, r.item_id) for r in got.collect()} == want
    assert got.count() == len(want)
    # Place and count against every diagonal of the item over the document.
    texts, names = dict(docs), dict(items)
    for r in got.collect():
        d, t = plain.tokens(texts[r.doc_id]), plain.tokens(names[r.item_id])
        best = max((sum(x == y for x, y in zip(d[max(k, 0) :], t[max(-k, 0) :])), -max(k, 0), max(k, 0), min(k + len(t), len(d))) for k in range(1 - len(t), len(d)))
        assert (r.matched, r.start, r.end) == (best[0], *best[2:]), (r, best)
    assert decontam.leaks(df.limit(0), bench).count() == 0 and decontam.leaks(df, bench.limit(0)).count() == 0
    left = decontam.clean(df, bench)
    assert left.columns == df.columns and left.count() == len(docs) - len(want) - 1


def test_masks_keep_a_seed():
    """A 20-word stretch with any two changes keeps a seed."""
    from itertools import combinations

    for gone in combinations(range(20), 2):
        assert any(all(bit == "0" or k + i not in gone for i, bit in enumerate(m)) for m in decontam.MASKS for k in range(20 - len(m) + 1))

"""The five stages over a planted table, row by row against plain Python."""

import random

import pytest

import corpus_pipeline
from tests.llm import plain

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns whose names the stages use inside, or give to their results.
CLASHES = (
    "_own _text _words _lines _starts _pairs _hashes _left _good _key _id _doc _settled lines starts runs level rank place key keep node component row least first "
    "seed pos words item part same m n_words kept clean_text n_lines n_removed longest kept_text"
).split()


def planted(rng):
    vocab = [f"w{i}" for i in range(900)]
    sentence = lambda n: " ".join(rng.choices(vocab, k=n)).capitalize() + "."
    items = [(i, sentence(rng.randint(14, 40))) for i in range(6)] + [(6, "yes it is so"), (7, "only six words are in here"), (8, None)]
    passage = sentence(60)
    texts = ["\n".join(sentence(rng.randint(6, 30)) for _ in range(rng.randint(2, 6))) for _ in range(40)]
    texts += [texts[0], texts[0] + " Added here.", texts[1].replace("w", "W"), "\n".join([sentence(12), passage]), "\n".join([sentence(25), passage, sentence(9)])]
    words = texts[2].split(" ")
    words[len(words) // 2] = "changed"
    texts += [" ".join(words), "\n".join([sentence(20), items[0][1], sentence(20)]), sentence(30) + " " + items[1][1].replace(items[1][1].split()[7], "other", 1)]
    texts += [None, "", "too short", "Home | About | News | Contact | More\n" + sentence(40), ("again and again it is here " * 9).strip(), "Yes. It is so!", sentence(30) + " only six words are in here ok."]
    texts += ["ALL CAPITALS " * 8, sentence(15) + "\n" + "no end of this line that has many words", "Click here!!! Now!!! Buy!!!\n" * 5, texts[4], "\n".join(texts[5].split("\n")[:2] + [sentence(14)])]
    rows = [(i, t, "en", [None, "a", "b", "ü"][i % 4], len(t or "")) for i, t in enumerate(texts)]
    rows += [(7, texts[0], "en", "a", 1), (7, sentence(30), "en", "b", 1), (None, texts[3], "en", "a", 1), (None, sentence(22) + " " + items[2][1], "en", "a", 1), rows[9], (500, sentence(20_000), "en", "b", 1)]
    return rows, items


def by_hand(rows, items):
    """(doc_id, text, source) after each stage, and what the mix takes of the last."""
    stages = []
    now = [(d, plain.judged(t)[1], s) for d, t, _, s, _ in rows if plain.judged(t)[0]]
    stages.append(now)
    lines = plain.without_copied_lines([(d, t) for d, t, _ in now])
    now = [(d, lines[d, t][2], s) for d, t, s in now if not lines[d, t][1] or plain.words(lines[d, t][2])]
    stages.append(now)
    named = sorted({(d, t) for d, t, _ in now if d is not None and plain.words(t)}, key=lambda r: (r[0], plain.text_key(r[1])))
    best = plain.components([plain.shingles(t) for _, t in named], 80)
    keep, left = {r for i, r in enumerate(named) if best[i] == i}, []
    for d, t, s in now:
        if d is None or not plain.words(t) or (d, t) in keep:
            left.append((d, t, s))
            keep.discard((d, t))
    stages.append(left)
    now = [r for r in left if not any(plain.leaked(r[1], x) for _, x in items)]
    stages.append(now)
    return stages, {r: n for r, n in plain.mixed(now).items() if n}


@pytest.fixture(scope="module")
def bench_dir(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("sf"))
    rows, items = planted(random.Random(21))
    spark.createDataFrame(rows, SCHEMA).repartition(4).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, rows, items


def rows_of(df):
    return sorted(((r.doc_id, r.text, r.source) for r in df.collect()), key=str)


def test_pipeline_against_plain_python(spark, bench_dir):
    folder, rows, items = bench_dir
    stages, taken = by_hand(rows, items)
    kept = spark.read.parquet(f"{folder}/documents.parquet")
    sizes = [len(rows)]
    for (name, stage), want in zip(corpus_pipeline.STAGES[:-1], stages):
        kept = stage(spark, kept, folder)
        assert kept.columns == [c.split()[0] for c in SCHEMA.split(", ")], name
        assert rows_of(kept) == sorted(want, key=str), name
        kept = spark.createDataFrame(kept.collect(), kept.schema)
        sizes.append(len(want))
    # Every stage decides something.
    assert all(a > b for a, b in zip(sizes, sizes[1:])), sizes
    last = {(r.doc_id, r.text, r.source): r.taken for r in corpus_pipeline.run(spark, folder).collect()}
    assert last == taken


@pytest.mark.parametrize("k", range(5))
def test_stages_with_clashing_and_no_rows(spark, bench_dir, k):
    """Columns named like those inside or like results come out as they went in; an empty table stays one."""
    folder, rows, _ = bench_dir
    name, stage = corpus_pipeline.STAGES[k]
    docs = spark.createDataFrame(rows[:12], SCHEMA).selectExpr("*", *[f"concat('{c} of ', doc_id) AS `{c}`" for c in CLASHES], "1 AS `a.b`")
    got = stage(spark, docs, folder)
    assert got.columns[: len(docs.columns)] == docs.columns, name
    found = got.collect()
    assert found and all(r[c] == f"{c} of {r.doc_id}" for r in found for c in CLASHES), name
    assert stage(spark, docs.limit(0), folder).count() == 0


def test_scratch_is_emptied(spark, bench_dir):
    import os

    from lorebase.llm.common import materialize, scratch, shared_dir

    with scratch(spark):
        inner = materialize(spark.range(3), "inner")
        path = inner.inputFiles()[0]
        assert os.path.exists(path.removeprefix("file:"))
    assert not os.path.exists(path.removeprefix("file:")) and os.path.exists(shared_dir(spark))

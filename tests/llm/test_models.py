"""Token counts against the library; classifiers on held-out rows, their algorithms against enumeration and differences."""

import itertools
import math
import random
import time
import zlib

import numpy as np
import pytest

from lorebase.llm import language_id, line_crf, token_counts
from lorebase.llm.common import table

P = pytest.importorskip("public_tokenizers")
SF = "/root/testdata/sf0.01"
ODD = [None, "", " ", "'s", "x'", "a" * 3000, " " * 500, "w " * 20_000]


def test_tokens(spark):
    from tokenizers import Tokenizer

    path = P.path("byte_bpe_50k.json")
    rng = random.Random(1)
    parts = ["a", "s", "re", "ll", "'", "'", " ", "  ", "\n", "\t", "12", "é", "中文", "🙂", "!", "<|endoftext|>", "<|endof", "\x85", "\x1c", "Ⅷ", "the", "DON'T", "I'll", "\x00"]
    texts = ODD + ["".join(rng.choices(parts, k=rng.randint(0, 50))) for _ in range(600)]
    tool = Tokenizer.from_file(path)
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, n_tokens int")
    for r in token_counts.count_tokens(df, path).collect():
        t = texts[r.doc_id] or ""
        assert (r.n_bytes, r.n_tokens) == (len(t.encode()), len(tool.encode(t, add_special_tokens=False).ids)), t
        assert r.over_limit == (r.n_tokens > 1024)
    assert token_counts.count_tokens(df.limit(0), path).count() == 0


def held_out(i):
    return zlib.crc32(str(i).encode()) % 4 == 2


def test_language(spark):
    docs = table(spark, SF, "documents")
    truth = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    rows = language_id.identify(docs).collect()
    assert len(rows) == len(truth) and all(r.held_out == held_out(r.doc_id) and 0 <= r.score <= 1 for r in rows)
    tried = [r.lang_pred == truth[r.doc_id] for r in rows if r.held_out]
    assert sum(tried) >= 0.95 * len(tried)
    odd = spark.createDataFrame([(i, t, None) for i, t in enumerate([*ODD, "12 !!"])], "doc_id long, text string, lang string")
    assert {r.lang_pred for r in language_id.identify(odd).collect()} == {"und"}


def test_quality(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    truth = {r.doc_id: r.quality for r in labels.collect()}
    rows = line_crf.score_quality(docs, labels).collect()
    tried = [r.predicted == truth[r.doc_id] for r in rows if r.held_out and r.doc_id in truth]
    assert len(rows) == docs.count() and sum(tried) >= 0.95 * len(tried)
    odd = spark.createDataFrame([(i, t, 1, 2) for i, t in enumerate(ODD)], "doc_id long, text string, quality int, score int")
    assert all(0 <= r.score <= 1 for r in line_crf.score_quality(odd, labels).collect())
    assert {r.score for r in line_crf.score_quality(odd, labels.limit(0)).collect()} == {0.5}
    assert line_crf.score_quality(odd.limit(0), labels).count() == 0


def test_marginals_by_enumeration():
    """Forward-backward against the sum over every labelling of short chains."""
    rng = np.random.default_rng(2)
    lengths, steps, move = [1, 3, 6, 5], 6, rng.normal(size=(2, 2))
    real = np.arange(steps) < np.array(lengths)[:, None]
    emit = rng.normal(size=(4, steps, 2)) * real[..., None]
    marginal, pair, z = line_crf.forward_backward(emit, real, move)
    for k, n in enumerate(lengths):
        weight, by_step, by_move = 0.0, np.zeros((n, 2)), np.zeros((2, 2))
        for y in itertools.product((0, 1), repeat=n):
            w = math.exp(sum(emit[k, t, y[t]] for t in range(n)) + sum(move[a, b] for a, b in zip(y, y[1:])))
            weight += w
            for t in range(n):
                by_step[t, y[t]] += w
            for a, b in zip(y, y[1:]):
                by_move[a, b] += w
        assert z[k] == pytest.approx(math.log(weight))
        assert np.allclose(marginal[k, :n], by_step / weight) and np.allclose(pair[k], by_move / weight)


def test_gradient_by_differences():
    """Backpropagation through time against differences of the loss, for every kind of weight."""
    net = language_id.ByteGru(["a", "b", "c"])
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    rng = np.random.default_rng(3)
    x, label = rng.integers(97, 103, (9, 4)).astype(np.uint8), np.array([0, 1, 2, 1])
    x[6:, 2] = 0
    _, grad = net.loss(x, label)
    for k, v in net.p.items():
        at = np.unravel_index(np.argmax(abs(grad[k])), v.shape)
        for place in {at, tuple(int(rng.integers(n)) for n in v.shape)}:
            kept, ends = v[place], []
            for step in (1e-5, -1e-5):
                v[place] = kept + step
                ends.append(net.loss(x, label)[0])
            v[place] = kept
            assert grad[k][place] == pytest.approx((ends[0] - ends[1]) / 2e-5, abs=1e-7), k


def test_spread_lines():
    assert line_crf.spread_lines(7).tolist() == list(range(7))
    far = line_crf.spread_lines(10_000)
    assert len(far) <= line_crf.SAMPLE_LINES and far[0] == 0 and far[-1] == 9_999 and np.diff(far).max() > 1000


def test_unbroken_text_in_time():
    """A megabyte without a blank is counted in seconds, and as the library counts it."""
    from tokenizers import Tokenizer

    path = P.path("byte_bpe_50k.json")
    tool, count = Tokenizer.from_file(path), token_counts.counter(path)
    rng = random.Random(5)
    for alphabet, n in (("abcdefghijklmnopqrstuvwxyz", 1_000_000), ("中文字符数据", 40_000), ("ab", 30_000), ("é", 5_000), ("x", 101), ("the", 100)):
        text = "".join(rng.choices(alphabet, k=n))
        start = time.perf_counter()
        assert count.count([text])[0] == len(tool.encode(text, add_special_tokens=False).ids)
        assert time.perf_counter() - start < 30

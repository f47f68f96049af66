"""Quality classifier: a linear-chain conditional random field over the lines of a document.

Every line is labelled good or bad.  A line's features (case, marks, digits, repeats, words) stand beside those
of its neighbours; transitions tie labels together.  Forward-backward gives the marginal chance that a line is
good, and a document's score is their mean weighted by length.

Training takes a bounded sample of labelled documents (``SAMPLE``: those with the least hash of doc_id and text, of
all that may be learned from).  A document of more than ``SAMPLE_LINES`` lines gives ``STRETCHES`` stretches of
neighbouring lines, spread evenly from its first line to its last, that many lines in all; shorter ones give all
theirs.  Each line bears its document's label.  Only features come to the driver, as bytes: at most
SAMPLE * SAMPLE_LINES lines.  Scores always come from all lines.

Defined results: null and empty texts are one empty line and get its score; rows without a label are scored like
others; a document with several labels counts with the lowest; without any label, or with one kind only, every
score is that share (0.5 without labels); repeated rows get the same score each; extra columns are ignored; an
empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorebase.llm.common import sample_of, text_column
from lorebase.llm.wordhash import mix, slices, words

#: Bounds of the training sample: documents, lines of one document, and stretches in which those lie.
SAMPLE, SAMPLE_LINES, STRETCHES = 4000, 200, 8
SCHEMA = "doc_id long, score double"
_ASCII = np.arange(256)
#: Classes of bytes that are counted in a line.
_COUNTED = [
    (_ASCII >= 65) & (_ASCII <= 90),
    (_ASCII >= 97) & (_ASCII <= 122),
    (_ASCII >= 48) & (_ASCII <= 57),
    np.isin(_ASCII, [33, 63]),
    np.isin(_ASCII, [44, 46, 58, 59]),
    np.isin(_ASCII, [124, 62, 60, 35, 42, 36, 37, 38, 64, 61, 95, 123, 125, 91, 93, 92, 47]),
    _ASCII >= 128,
]
_SPREAD = np.uint64(0x9E3779B97F4A7C15)
N_OWN = len(_COUNTED) + 11


def line_features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of each line with its neighbours', its length in bytes (1 at least), first line of each text (and the end)."""
    hashes, _, data, starts, _ = words(texts, lower=True)
    codes = np.frombuffer(data, np.uint8)
    sizes = np.array([len(t.encode("utf-8", "surrogatepass")) + 1 for t in texts])
    ends = np.cumsum(sizes) - 1
    stops = np.union1d(np.flatnonzero(codes == 10), ends)
    begins = np.concatenate(([0], stops[:-1] + 1))
    bounds = np.concatenate(([0], np.searchsorted(stops, ends) + 1))
    length = np.maximum(stops - begins, 1)
    rows = []
    for kind in _COUNTED:
        total = np.concatenate(([0], np.cumsum(kind[codes])))
        rows.append((total[stops] - total[begins]) / length)
    line = np.searchsorted(stops, starts)
    n = np.bincount(line, minlength=len(stops))
    again = np.zeros(len(hashes))
    if len(hashes) > 1:
        again[1:] = (hashes[1:] == hashes[:-1]) & (line[1:] == line[:-1])
    owner = np.searchsorted(bounds, np.arange(len(stops)), side="right") - 1
    some = np.maximum(n, 1)
    # Words of a line, and lines of a text, are told apart by one mixed hash of both.
    _, one_each = np.unique(mix(hashes + line.astype(np.uint64) * _SPREAD), return_index=True)
    distinct = np.bincount(line[one_each], minlength=len(stops))
    # A line equal to another of its text: equal sums of word hashes.
    digest = np.zeros(len(stops), np.uint64)
    np.add.at(digest, line, hashes)
    _, back, count = np.unique(mix(digest + owner.astype(np.uint64) * _SPREAD), return_inverse=True, return_counts=True)
    twin = (count[back] > 1) & (n > 0)
    last = codes[np.maximum(stops - 1, begins)]
    in_text = np.add.reduceat(n, bounds[:-1])[owner]
    rows += [
        np.log1p(n), np.log1p(length) / 4, length / some / 10, np.bincount(line, again, len(stops)) / some, distinct / some, twin,
        np.isin(last, [46, 33, 63]), n == 0, np.log1p(in_text) / 4, np.log1p(np.diff(bounds)[owner]) / 3,
        np.minimum(1, 8 / (1 + in_text)),
    ]
    own = np.stack([np.asarray(r, np.float32) for r in rows], 1)
    before, after = np.roll(own, 1, axis=0), np.roll(own, -1, axis=0)
    before[bounds[:-1]] = 0
    after[bounds[1:] - 1] = 0
    return np.concatenate((own, before, after), 1), length.astype(np.float64), bounds


def _blocks(bounds: np.ndarray, most: int = 200_000) -> Iterator[np.ndarray]:
    """Texts of like numbers of lines, in blocks of a bounded number of cells."""
    order = np.argsort(np.diff(bounds), kind="stable")
    counts, first = np.diff(bounds)[order], 0
    for i in range(len(order)):
        if i > first and (counts[i] * (i - first + 1) > most or counts[i] > 2 * counts[first] + 4):
            yield order[first:i]
            first = i
    if len(order):
        yield order[first:]


def _laid(block: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Line index [text, step] and which cells are lines."""
    counts = np.diff(bounds)[block]
    step = np.arange(counts.max())
    real = step < counts[:, None]
    return np.where(real, bounds[block][:, None] + step, bounds[block][:, None]), real


def forward_backward(emit: np.ndarray, real: np.ndarray, move: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Marginals [text, step, 2], pair marginals summed over steps [text, 2, 2] and log partition of chains."""
    texts, steps = real.shape
    alpha = np.empty((texts, steps, 2))
    beta = np.zeros((texts, steps, 2))
    alpha[:, 0] = emit[:, 0]
    for t in range(1, steps):
        x = alpha[:, t - 1, :, None] + move
        alpha[:, t] = np.where(real[:, t, None], np.logaddexp(x[:, 0], x[:, 1]) + emit[:, t], alpha[:, t - 1])
    for t in range(steps - 2, -1, -1):
        x = move + (emit[:, t + 1] + beta[:, t + 1])[:, None, :]
        beta[:, t] = np.where(real[:, t + 1, None], np.logaddexp(x[..., 0], x[..., 1]), 0.0)
    z = np.logaddexp(alpha[:, -1, 0], alpha[:, -1, 1])
    marginal = np.exp(alpha + beta - z[:, None, None])
    if steps == 1:
        return marginal, np.zeros((texts, 2, 2)), z
    pair = np.exp(alpha[:, :-1, :, None] + move + (emit[:, 1:] + beta[:, 1:])[:, :, None, :] - z[:, None, None, None])
    return marginal, (pair * real[:, 1:, None, None]).sum(1), z


class LineCrf:
    """Weights for "good" against "bad", and transitions between lines."""

    def __init__(self, n_features: int):
        self.weights = np.zeros(n_features + 1)
        self.move = np.zeros((2, 2))
        self.mean, self.scale = np.zeros(n_features), np.ones(n_features)

    def _emit(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -6, 6) @ self.weights[:-1] + self.weights[-1]

    def fit(self, x: np.ndarray, bounds: np.ndarray, label: np.ndarray, rounds: int = 250, rate: float = 0.05, ridge: float = 0.002) -> LineCrf:
        """Gradient ascent (Adam) on the mean log likelihood of the label sequences, each text counting once."""
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-3
        blocks = [(b, *_laid(b, bounds)) for b in _blocks(bounds)]
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        theta, first, second = np.zeros(len(self.weights) + 4), 0.0, 0.0
        for step in range(1, rounds + 1):
            self.weights, self.move = theta[:-4], theta[-4:].reshape(2, 2)
            score = z @ self.weights[:-1] + self.weights[-1]
            slope = -ridge * theta
            for block, at, real in blocks:
                emit = np.stack((np.zeros(at.shape), score[at]), -1) * real[..., None]
                marginal, pair, _ = forward_backward(emit, real, self.move)
                share = 1 / np.maximum(real.sum(1), 1) / len(label)
                miss = (label[block][:, None] - marginal[..., 1]) * real * share[:, None]
                slope[: len(self.weights) - 1] += np.bincount(at[real], miss[real], len(z)) @ z
                slope[len(self.weights) - 1] += miss.sum()
                stays = np.zeros((len(block), 2, 2))
                stays[np.arange(len(block)), label[block].astype(int), label[block].astype(int)] = real.sum(1) - 1
                slope[-4:] += ((stays - pair) * share[:, None, None]).sum(0).ravel()
            first = 0.9 * first + 0.1 * slope
            second = 0.99 * second + 0.01 * slope**2
            theta = theta + rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
        self.weights, self.move = theta[:-4], theta[-4:].reshape(2, 2)
        return self

    def scores(self, texts: list[str]) -> np.ndarray:
        x, length, bounds = line_features(texts)
        emit, out = self._emit(x), np.empty(len(texts))
        for block in _blocks(bounds):
            at, real = _laid(block, bounds)
            marginal, _, _ = forward_backward(np.stack((np.zeros(at.shape), emit[at]), -1) * real[..., None], real, self.move)
            weight = length[at] * real
            out[block] = (marginal[..., 1] * weight).sum(1) / weight.sum(1)
        return np.clip(out, 0.0, 1.0)


def held_out(doc_id="doc_id"):
    """Documents that nothing is learned from: crc32(doc_id as text) mod 4 is 2."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def spread_lines(n: int) -> np.ndarray:
    """Lines of a text of n lines that are learned from."""
    if n <= SAMPLE_LINES:
        return np.arange(n)
    long = SAMPLE_LINES // STRETCHES
    starts = np.linspace(0, n - long, STRETCHES).astype(int)
    return np.unique(starts[:, None] + np.arange(long))


def _features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        texts = pdf["text"].tolist()
        for a, b in slices(texts):
            x, _, bounds = line_features(texts[a:b])
            yield pd.DataFrame({
                "doc_id": pdf["doc_id"].to_numpy()[a:b], "label": pdf["label"].to_numpy()[a:b],
                "x": [x[p + spread_lines(q - p)].astype(np.float32).tobytes() for p, q in zip(bounds[:-1], bounds[1:], strict=True)],
            })


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> LineCrf | float:
    """A model from labelled documents, or the share of good ones where there is one kind only."""
    usable = (
        labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & ~held_out())
        .groupBy("doc_id").agg(F.min("quality").cast("double").alias("label"))
    )
    texts = docs.select("doc_id", text_column(docs).alias("text"), F.xxhash64(text_column(docs)).alias("key"))
    picked = sample_of(texts.select("doc_id", "key").join(usable, "doc_id"), labels.count(), sample)
    # The sample is bounded, so it may be sent to every task.
    known = texts.join(F.broadcast(picked), ["doc_id", "key"]).select("doc_id", "label", "text")
    found = known.mapInPandas(_features, "doc_id long, label double, x binary").distinct().collect()
    rows = sorted(found, key=lambda r: (r.doc_id, bytes(r.x)))
    label = np.array([r.label for r in rows])
    if not len(rows) or label.min() == label.max():
        return float(label[0]) if len(rows) else 0.5
    x = [np.frombuffer(bytes(r.x), np.float32).reshape(-1, 3 * N_OWN) for r in rows]
    return LineCrf(3 * N_OWN).fit(np.concatenate(x).astype(np.float64), np.concatenate(([0], np.cumsum([len(p) for p in x]))), label)


def score_quality(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted: one row per row of ``docs`` (doc_id, text)."""
    model = train(docs, labels, sample)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts = pdf["text"].tolist()
            parts = [model.scores(texts[a:b]) if isinstance(model, LineCrf) else np.full(b - a, model) for a, b in slices(texts)]
            yield pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"), "score": np.concatenate([np.empty(0), *parts])})

    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_column(docs).alias("text")).mapInPandas(run, SCHEMA)
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))

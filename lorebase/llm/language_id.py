"""Language ID: a bidirectional gated recurrent network over bytes, in numpy.

A text is cut into segments of ``STEPS`` bytes, all of them; the network runs forward and backward over each,
labels every position with language chances, and a document's chances are the mean over its positions.

Training takes a bounded sample (``SAMPLE`` documents with the least hash of doc_id and text, ``SEGMENTS`` segments of
each, spread over the text) and backpropagates through time on the driver; only these segments come there.  The
sample is picked by ids and hashes, so no text travels for it.

Defined results: null texts and texts without a letter are ``und`` with score 0; without anything to learn from
so are all; repeated rows get the same result each; extra columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorebase.llm.common import sample_of, text_column
from lorebase.llm.line_crf import held_out
from lorebase.llm.wordhash import slices

STEPS, HIDDEN = 64, 8
#: Bounds of the training sample.
SAMPLE, SEGMENTS = 3000, 6
SCHEMA = "doc_id long, lang_pred string, score double"
LETTER = regex.compile(r"\p{L}")


def _sigmoid(x: np.ndarray) -> np.ndarray:
    np.multiply(x, np.float32(0.5), out=x)
    np.tanh(x, out=x)
    x += np.float32(1)
    x *= np.float32(0.5)
    return x


def segments(data: bytes) -> np.ndarray:
    """The bytes of a text in rows of STEPS; the last is filled with zeros."""
    codes = np.zeros(-(-len(data) // STEPS) * STEPS, np.uint8)
    codes[: len(data)] = np.frombuffer(data, np.uint8)
    return codes.reshape(-1, STEPS)


class ByteGru:
    """One gated recurrent layer in each direction and a shared output layer."""

    def __init__(self, languages: list[str], seed: int = 4):
        rng = np.random.default_rng(seed)
        self.languages = languages
        self.p: dict[str, np.ndarray] = {}
        for d in "fb":
            for gate in "rzc":
                self.p[f"{d}e{gate}"] = rng.normal(0, 0.3, (256, HIDDEN)).astype(np.float32)
                self.p[f"{d}u{gate}"] = rng.normal(0, 0.35, (HIDDEN, HIDDEN)).astype(np.float32)
            self.p[f"{d}q"] = np.zeros(HIDDEN, np.float32)
        self.p["v"] = rng.normal(0, 0.3, (2 * HIDDEN, len(languages))).astype(np.float32)
        self.p["o"] = np.zeros(len(languages), np.float32)

    def _run(self, d: str, x: np.ndarray, keep: bool = False):
        """Hidden states [step, lane, unit] over bytes [step, lane] from first to last; keep: what the gradient needs."""
        p = self.p
        er, ez, ec, ur, uz, uc, q0 = (p[d + k] for k in ("er", "ez", "ec", "ur", "uz", "uc", "q"))
        states = np.empty((len(x) + 1, x.shape[1], HIDDEN), q0.dtype)
        states[0] = 0
        kept = []
        for t, codes in enumerate(x):
            h = states[t]
            r = er[codes]
            r += h @ ur
            _sigmoid(r)
            z = ez[codes]
            z += h @ uz
            _sigmoid(z)
            q = h @ uc
            q += q0
            c = ec[codes]
            c += r * q
            np.tanh(c, out=c)
            new = states[t + 1]
            np.subtract(c, h, out=new)
            new *= z
            new += h
            if keep:
                kept.append((r, z, q, c))
        return states, kept

    def _back(self, d: str, x: np.ndarray, states: np.ndarray, kept: list, given: np.ndarray, grad: dict[str, np.ndarray]) -> None:
        """Backpropagation through time; ``given``: the loss's slope at each step's state."""
        p = self.p
        slopes = {k: np.empty_like(given) for k in "rzc"}
        flow = np.zeros_like(given[0])
        for t in range(len(x) - 1, -1, -1):
            r, z, q, c = kept[t]
            h, total = states[t], given[t] + flow
            dc = total * z * (1 - c * c)
            dq = dc * r
            dr = dc * q * r * (1 - r)
            dz = total * (c - h) * z * (1 - z)
            flow = total * (1 - z) + dq @ p[d + "uc"].T + dr @ p[d + "ur"].T + dz @ p[d + "uz"].T
            grad[d + "uc"] += h.T @ dq
            grad[d + "ur"] += h.T @ dr
            grad[d + "uz"] += h.T @ dz
            grad[d + "q"] += dq.sum(0)
            slopes["r"][t], slopes["z"][t], slopes["c"][t] = dr, dz, dc
        flat = x.ravel()
        for gate, s in slopes.items():
            s = s.reshape(-1, HIDDEN)
            for j in range(HIDDEN):
                grad[f"{d}e{gate}"][:, j] += np.bincount(flat, s[:, j], 256).astype(s.dtype)

    def _chances(self, f: np.ndarray, b: np.ndarray) -> np.ndarray:
        y = f @ self.p["v"][:HIDDEN]
        y += b @ self.p["v"][HIDDEN:]
        y += self.p["o"]
        y -= y.max(-1, keepdims=True)
        np.exp(y, out=y)
        y /= y.sum(-1, keepdims=True)
        return y

    def loss(self, x: np.ndarray, label: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Cross entropy over all positions [step, lane] and its gradient; zeros fill up segments and count nothing."""
        f, kf = self._run("f", x, True)
        b, kb = self._run("b", x[::-1], True)
        ahead, behind = f[1:], b[1:][::-1]
        y = self._chances(ahead, behind)
        lane, weight = np.arange(x.shape[1]), (x != 0) / y.dtype.type(x.size)
        value = float(-(np.log(y[:, lane, label]) * weight).sum())
        y[:, lane, label] -= 1
        y *= weight[..., None]
        grad = {k: np.zeros_like(v) for k, v in self.p.items()}
        flat = y.reshape(-1, y.shape[-1])
        grad["v"] = np.concatenate((ahead.reshape(-1, HIDDEN).T @ flat, behind.reshape(-1, HIDDEN).T @ flat))
        grad["o"] = flat.sum(0)
        self._back("f", x, f, kf, y @ self.p["v"][:HIDDEN].T, grad)
        self._back("b", x[::-1], b, kb, (y @ self.p["v"][HIDDEN:].T)[::-1], grad)
        return value, grad

    def fit(self, rows: np.ndarray, label: np.ndarray, rounds: int = 500, batch: int = 256, rate: float = 0.02) -> ByteGru:
        """rows: segments [n, STEPS]; label: language of each.  Adam with a rate that falls to a twentieth."""
        rng = np.random.default_rng(1)
        first = {k: np.zeros_like(v) for k, v in self.p.items()}
        second = {k: np.zeros_like(v) for k, v in self.p.items()}
        for step in range(1, rounds + 1):
            pick = rng.integers(0, len(rows), batch)
            _, grad = self.loss(np.ascontiguousarray(rows[pick].T), label[pick])
            now = rate * (1 - 0.95 * step / rounds)
            for k, g in grad.items():
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.99 * second[k] + 0.01 * g * g
                self.p[k] = (self.p[k] - now * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
        return self

    def sums(self, rows: np.ndarray) -> np.ndarray:
        """Language chances summed over the positions of each segment [n, language]."""
        out = np.empty((len(rows), len(self.languages)), np.float32)
        for i in range(0, len(rows), 2048):
            x = np.ascontiguousarray(rows[i : i + 2048].T)
            f, _ = self._run("f", x)
            b, _ = self._run("b", x[::-1])
            total = np.zeros((x.shape[1], len(self.languages)), np.float32)
            for t in range(STEPS):
                y = self._chances(f[t + 1], b[STEPS - t])
                y *= (x[t] != 0)[:, None]
                total += y
            out[i : i + 2048] = total
        return out

    def predict(self, texts: list[str]) -> np.ndarray:
        """Mean chances over all positions of each text [n, language]."""
        cut = [segments(t.encode("utf-8", "surrogatepass")) for t in texts]
        bounds = np.concatenate(([0], np.cumsum([len(c) for c in cut])))
        if not bounds[-1]:
            return np.zeros((len(texts), len(self.languages)))
        total = np.concatenate((np.zeros((1, len(self.languages))), np.cumsum(self.sums(np.concatenate(cut)), axis=0, dtype=np.float64)))
        total = total[bounds[1:]] - total[bounds[:-1]]
        return total / np.maximum(total.sum(1, keepdims=True), 1e-9)


def _sampled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        out = []
        for doc, lang, text in zip(pdf["doc_id"], pdf["lang"], pdf["text"], strict=True):
            rows = segments(text.encode("utf-8", "surrogatepass"))
            for i in np.unique(np.linspace(0, len(rows) - 1, SEGMENTS).astype(int)):
                out.append((doc, int(i), lang, rows[i].tobytes()))
        yield pd.DataFrame(out, columns=["doc_id", "at", "lang", "codes"])


def train(docs: DataFrame, sample: int = SAMPLE) -> ByteGru | None:
    """A model from the sample, or None without anything to learn from."""
    usable = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & F.col("text").rlike(r"\p{L}") & ~held_out()).select(
        "doc_id", "lang", "text", F.xxhash64("text").alias("key")
    )
    picked = sample_of(usable.select("doc_id", "key", "lang"), docs.count(), sample)
    # The sample is bounded, so it may be sent to every task.
    known = usable.join(F.broadcast(picked), ["doc_id", "key", "lang"]).select("doc_id", "lang", "text")
    found = known.mapInPandas(_sampled, "doc_id long, at int, lang string, codes binary").distinct().collect()
    rows = sorted(found, key=lambda r: (r.doc_id, r.at, r.lang, bytes(r.codes)))
    if not rows:
        return None
    languages = sorted({r.lang for r in rows})
    place = {x: i for i, x in enumerate(languages)}
    codes = np.stack([np.frombuffer(bytes(r.codes), np.uint8) for r in rows])
    return ByteGru(languages).fit(codes, np.array([place[r.lang] for r in rows]))


def identify(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, lang_pred, score: one row per row of ``docs`` (doc_id, text, lang)."""
    model = train(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang"), sample)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts = pdf["text"].tolist()
            names, scores = [], []
            for a, b in slices(texts):
                part = texts[a:b]
                chance = model.predict(part) if model else np.zeros((len(part), 1))
                for t, c in zip(part, chance, strict=True):
                    known = model is not None and LETTER.search(t) is not None
                    names.append(model.languages[int(c.argmax())] if known else "und")
                    scores.append(float(c.max()) if known else 0.0)
            yield pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"), "lang_pred": names, "score": np.clip(scores, 0.0, 1.0)})

    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_column(docs).alias("text")).mapInPandas(run, SCHEMA)
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")

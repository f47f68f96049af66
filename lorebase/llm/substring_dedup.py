"""Substring dedup by relative Lempel-Ziv parsing against every indexed block of the whole table.

The reference is every document.  Its index holds entries, cut into blocks by the hash of their anchor, so a
document's stretches are looked up in the blocks that their hashes name, and all blocks are consulted without
pairing documents with blocks.

Index.  A window is ``WINDOW`` consecutive words of one document, and its anchor the least five-word phrase in it by
hash (a minimizer), so equal windows share the anchor and its place.  Neighbouring windows with the same anchor
form one entry, with the hash of all words they span; entries part the windows of a document.  Entries whose
anchor occurs once in the table are dropped at once: no window of theirs repeats.

Matches.  Equal entries form a class, and each member but the first has the first as its reference place: document
and word.  Where one anchor has several classes, a match may end inside an entry: there the windows of the first
member of each class are looked up one by one, and each later one gets the place where it starts first.

Factors.  A document is parsed from left to right.  Matches that go on in the reference where they go on in the
document are one; at each word the match is taken that reaches furthest among those places, and the factor (start, length, reference
document, reference start) ends where that match ends.  As each entry refers to its first place alone, a stretch that stands whole in
a later document only is covered by several factors, one for each first place (X, Y and X Y before X Y: three factors); which words
are covered, and so what is deleted, does not depend on it.  A factor is a duplicate span if its whole match has
``WINDOW`` words or more; at a boundary that match may begin before the factor, in words that the factor before it
has taken, so what a cut leaves short is still judged in full.  Words between factors are literals.  Duplicate
spans are deleted: they hold just the words covered by a window that starts earlier.

Answers return to documents as lists, so groups are bounded by one document's length.  Counting and first
occurrences use aggregations with partial sums; a phrase that a third of all rows share costs each task one row,
and joins stand on written tables, so hot keys can be split.  Windows are told apart by 128 bits of hash.

Defined results: null and empty texts have no words; a text with fewer words than a window is kept whole, its
words joined by one space; rows that repeat doc_id and text are one document, so neither starts before the other;
of different texts under one doc_id the one with the smaller hash starts first; a null doc_id sorts first; extra
columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorebase.llm.common import materialize, text_column
from lorebase.llm.wordhash import Runs, grams, mix, slices, words

WINDOW = 20
PHRASE = 5
ENTRY = "doc_id long, key long, a long, ctx long, at int, n int"
#: A null doc_id, which sorts before all others.
NO_ID = -(1 << 63)
def entries(hashes: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """anchor, context, first window and number of windows of each entry of a text's word hashes."""
    n = len(hashes) - window + 1
    if n <= 0:
        return (np.empty(0, np.uint64), np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64))
    phrases = grams(hashes, PHRASE)
    place = np.lib.stride_tricks.sliding_window_view(phrases, window - PHRASE + 1).argmin(axis=1) + np.arange(n)
    first = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
    after = np.concatenate((first[1:], [n]))
    anchor = place[first]
    context = mix(Runs(hashes)(first, after + window - 1) + (anchor - first).astype(np.uint64))
    return phrases[anchor], context, first, after - first


def _hashed(pdf: pd.DataFrame) -> Iterator[tuple[int, np.ndarray]]:
    texts = pdf["text"].tolist()
    for first, last in slices(texts):
        hashes, bounds, *_ = words(texts[first:last])
        for i in range(first, last):
            yield i, hashes[bounds[i - first] : bounds[i - first + 1]]


def _anchors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        out: list[np.ndarray] = [np.empty(0, np.uint64)]
        size = 0
        for _, hashes in _hashed(pdf):
            out.append(entries(hashes)[0])
            if (size := size + len(out[-1])) > 200_000:
                yield pd.DataFrame({"a": np.concatenate(out).view(np.int64)})
                out, size = out[:1], 0
        yield pd.DataFrame({"a": np.concatenate(out).view(np.int64)})


def _entries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        ids, keys = pdf["doc_id"].to_numpy(), pdf["key"].to_numpy()
        out: list[tuple] = []
        size = 0

        def table(out=out):
            a, ctx, at, n = (np.concatenate(x) for x in zip(*[x[2:] for x in out], strict=True))
            sizes = [len(x[2]) for x in out]
            doc, key = (np.repeat([x[k] for x in out], sizes) for k in (0, 1))
            return pd.DataFrame({"doc_id": doc, "key": key, "a": a.view(np.int64), "ctx": ctx.view(np.int64), "at": at.astype(np.int32), "n": n.astype(np.int32)})

        for i, hashes in _hashed(pdf):
            out.append((ids[i], keys[i], *entries(hashes)))
            if (size := size + len(out[-1][2])) > 200_000:
                yield table()
                out.clear()
                size = 0
        if out:
            yield table()


def _packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Texts, compressed for the way to their answers."""
    tool = zstandard.ZstdCompressor(level=1)
    for pdf in batches:
        yield pd.DataFrame({"doc_id": pdf["doc_id"], "key": pdf["key"], "packed": [tool.compress((t or "").encode("utf-8", "surrogatepass")) for t in pdf["text"]]})


def _unpack(data: bytes) -> str:
    return zstandard.ZstdDecompressor().decompress(data).decode("utf-8", "surrogatepass")


def _boundary_windows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """128-bit hashes of the windows to look up: doc_id, key, w, v, at."""
    for pdf in batches:
        for doc, key, data, asked in zip(pdf["doc_id"], pdf["key"], pdf["packed"], pdf["asked"], strict=True):
            hashes = words([_unpack(data)])[0]
            at = np.concatenate([np.arange(x >> 5, (x >> 5) + (x & 31)) for x in np.asarray(asked, np.int64).tolist()])
            w, v = Runs(hashes)(at, at + WINDOW), Runs(mix(hashes + np.uint64(1)))(at, at + WINDOW)
            yield pd.DataFrame({"doc_id": np.full(len(at), doc), "key": np.full(len(at), key), "w": w.view(np.int64), "v": v.view(np.int64), "at": at.astype(np.int32)})


def matches(at: np.ndarray, n: np.ndarray, doc: np.ndarray, place: np.ndarray, n_windows: int, window: int = WINDOW) -> list[tuple[int, int, int, int]]:
    """(start, end, reference document, reference start), in words, of the matches that go on as far as they can.

    Windows at .. at + n of the document stand in the reference document at ``place`` and after it.
    """
    known = np.zeros(n_windows, bool)
    source, shift = np.zeros(n_windows, np.int64), np.zeros(n_windows, np.int64)
    for i, k, d, p in zip(at.tolist(), n.tolist(), doc.tolist(), place.tolist(), strict=True):
        known[i : i + k], source[i : i + k], shift[i : i + k] = True, d, p - i
    where = np.flatnonzero(known)
    if not len(where):
        return []
    same = (where[1:] == where[:-1] + 1) & (source[where[1:]] == source[where[:-1]]) & (shift[where[1:]] == shift[where[:-1]])
    first = where[np.concatenate(([True], ~same))]
    last = where[np.concatenate((~same, [True]))]
    return [(int(s), int(e) + window, int(source[s]), int(s + shift[s])) for s, e in zip(first, last, strict=True)]


def factors(found: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    """(start, length, reference document, reference start): from left to right the match that reaches furthest."""
    out, done, i = [], 0, 0
    while i < len(found):
        best = None
        while i < len(found) and found[i][0] <= done:
            if found[i][1] > done and (best is None or found[i][1] > best[1]):
                best = found[i]
            i += 1
        if best is None:
            if i < len(found):
                done = found[i][0]
            continue
        start, end, doc, place = best
        out.append((done, end - done, doc, place + done - start))
        done = end
    return out


def _deleted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        out = []
        for doc, data, told in zip(pdf["doc_id"], pdf["packed"], pdf["told"], strict=True):
            own = data and _unpack(data).encode("utf-8", "surrogatepass").split() or []
            found = []
            if told is not None and len(told):
                columns = (np.array([x[c] for x in told], np.int64) for c in ("at", "n", "doc", "place"))
                found = factors(matches(*columns, len(own) - WINDOW + 1))
            gone = np.zeros(len(own), bool)
            for start, length, *_ in found:
                gone[start : start + length] = True
            kept = [w for w, g in zip(own, gone.tolist(), strict=True) if not g] if found else own
            out.append((doc, len(own), int(gone.sum()), hashlib.sha256(b" ".join(kept)).hexdigest(), [dict(zip(("start", "length", "doc", "place"), f, strict=True)) for f in found]))
        yield pd.DataFrame(out, columns=["doc_id", "n_words", "n_removed", "kept_sha256", "factors"])


def _answers(slim: DataFrame, packed: DataFrame) -> DataFrame:
    """doc_id, key, at, n, doc, place: windows at .. at + n of a document stand earlier, in ``doc`` from word ``place`` on."""
    often = materialize(slim.mapInPandas(_anchors, "a long").groupBy("a").count().where("count > 1").select("a"), "anchors")
    seen = materialize(slim.mapInPandas(_entries, ENTRY).join(often, "a", "left_semi"), "entries")
    classes = materialize(
        seen.groupBy("a", "ctx").agg(F.min(F.struct("doc_id", "key", "at", "n")).alias("f"), F.count("*").alias("members")), "classes"
    )
    here = F.struct("doc_id", "key", "at")
    told = lambda n: (
        F.col("doc_id"), F.col("key"), F.col("at"), n.alias("n"), F.col("f.doc_id").alias("doc"), F.col("f.at").alias("place")
    )
    of_classes = seen.join(classes.where("members > 1").drop("members"), ["a", "ctx"]).where(here != F.struct("f.doc_id", "f.key", "f.at")).select(*told(F.col("n")))
    # Anchors with several classes: single windows of the first members.
    split = materialize(classes.groupBy("a").agg(F.count("*").alias("_n")).where("_n > 1").select("a"), "split")
    asked = classes.join(split, "a", "left_semi").select("f.*").groupBy("doc_id", "key").agg(
        F.collect_list(F.shiftleft(F.col("at").cast("long"), 5) + F.col("n")).alias("asked")
    )
    looked_up = materialize(packed.join(asked, ["doc_id", "key"]).mapInPandas(_boundary_windows, "doc_id long, key long, w long, v long, at int"), "windows")
    starts = materialize(
        looked_up.groupBy("w", "v").agg(F.min(here).alias("f"), F.count("*").alias("_n")).where("_n > 1").drop("_n"), "starts"
    )
    return of_classes.unionByName(looked_up.join(starts, ["w", "v"]).where(here != F.col("f")).select(*told(F.lit(1))))


def dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, factors (start, length, doc, place): one row per row of ``docs``."""
    text = text_column(docs)
    slim = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), F.xxhash64(text).alias("key"), text.alias("text"))
    packed = slim.mapInPandas(_packed, "doc_id long, key long, packed binary")
    told = materialize(
        _answers(slim, packed).groupBy("doc_id", "key").agg(F.collect_set(F.struct("at", "n", "doc", "place")).alias("told")), "answers"
    )
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string, factors array<struct<start:int,length:int,doc:long,place:int>>"
    out = packed.join(told, ["doc_id", "key"], "left").mapInPandas(_deleted, schema)
    unset = lambda c: F.when(c != NO_ID, c)
    return out.withColumn("doc_id", unset(F.col("doc_id"))).withColumn(
        "factors", F.transform("factors", lambda f: f.withField("doc", unset(f["doc"])))
    )

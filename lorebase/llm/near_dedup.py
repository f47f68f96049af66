"""MinHash near-dedup: universal hash minima, banding, signature verification, connected components.

Texts with equal shingle sets form one class, found by a 128-bit digest of the set, and only one
representative per class goes on.  160 minima give 32 bands of five; a pair shares no band with a chance of 7e-9
at a similarity of 0.85 (op8) and of 3e-6 at 0.80 (``clean``).  Representatives that share a band are candidates:

1. Each is first compared with one partner only, the least member of most of its buckets (its pivot there).
   Confirmed links are contracted to components.
2. Then with the pivots of its other buckets, where those are in another component.
3. Then every pair that still shares a bucket but not a component is compared, in blocks of members: block
   against block in one task, which hands on only pairs that a sketch of the sets allows.  No candidate is
   dropped: links inside a component add nothing, and all others are looked at.  A bucket in which m components
   are left costs about m**2 / 2 comparisons of signatures, dealt out by pairs of blocks; after the first two steps
   only texts that share five minima by chance are left in one.

A sketch counts the shingles in 256 parts of the hash range; sets that differ by more than a link allows there
differ by more in full, so it never loses a link.  Other pairs are compared by signature (four bits of each minimum; a pair at the threshold fails with a chance of
less than 1e-10) and what passes is confirmed on the full sets.

Sets travel only for pairs that pass the signature, so an exact copy or a chance hit costs a few bytes.

Defined results: null or empty text has no shingles and is linked with nothing (its own component, kept); with
fewer words than a shingle the whole sequence is the only one; vertices are sets of shingles, not doc_ids, so
rows that share a doc_id but not their text are judged by their own texts, and rows that repeat both are one;
a component is named by its smallest doc_id; a null doc_id is linked with nothing, its component is null and
it is kept; extra columns pass through ``clean``, which drops rows, not ids, and keeps one of the rows that
repeat doc_id and text (any, if their other columns differ); an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorebase.llm.common import materialize, own_columns, text_column, with_own
from lorebase.llm.components import components
from lorebase.llm.wordhash import grams, mix, slices, words

SHINGLE = 5
BANDS, ROWS = 32, 5
HASHES = BANDS * ROWS
_RNG = np.random.default_rng(8)
#: Multiply-shift hashing: odd multipliers and offsets modulo 2**64, of which the upper bits are used.
_A = _RNG.integers(0, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _RNG.integers(0, 1 << 63, HASHES, dtype=np.uint64)
#: Similarity, in hundredths, from which the pipeline stage drops copies (op8 has its own, 85).
STAGE_PERCENT = 80
PROFILE = "doc_id long, key long, n long, k1 long, k2 long, bands array<long>, sig array<long>, sketch binary"
#: Members of one block of a bucket, about.
BLOCK = 256


def may_differ(percent: int) -> int:
    """Signature nibbles that may differ: a pair at the threshold has more with a chance of less than 1e-10 (54 at 85, 65 at 80)."""
    p = (100 - percent) / 100 * 15 / 16
    return next(d for d in range(HASHES + 1) if sum(comb(HASHES, k) * p**k * (1 - p) ** (HASHES - k) for k in range(d + 1, HASHES + 1)) < 1e-10)


def shingles(hashes: np.ndarray) -> np.ndarray:
    """Sorted distinct shingle hashes of a text's word hashes."""
    if not len(hashes):
        return hashes
    return np.unique(grams(hashes, min(SHINGLE, len(hashes))))


def minima(found: np.ndarray) -> np.ndarray:
    """The least value of each hash function over a set, in blocks that stay in the processor's cache."""
    least = np.full(HASHES, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(found), 256):
        block = np.multiply.outer(_A, found[i : i + 256])
        block += _B[:, None]
        np.minimum(least, block.min(axis=1), out=least)
    return least


def _sketch(found: np.ndarray) -> bytes:
    """How many shingles fall into each of 256 parts of the hash range (255 at most): two sets differ by at least the sum of differences."""
    return np.minimum(np.bincount((found >> np.uint64(56)).astype(np.int64), minlength=256), 255).astype(np.uint8).tobytes()


def _sets(texts: list[str | None]) -> Iterator[np.ndarray]:
    for first, last in slices(texts):
        hashes, bounds, *_ = words(texts[first:last], lower=True)
        for i in range(last - first):
            yield shingles(hashes[bounds[i] : bounds[i + 1]])


def _profiles(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    nibbles = np.arange(16, dtype=np.uint64) * np.uint64(4)
    bands = np.arange(BANDS, dtype=np.uint64)
    for pdf in batches:
        out = []
        for found in _sets(pdf["text"].tolist()):
            if not len(found):
                out.append((0, 0, 0, None, None, None))
                continue
            least = minima(found)
            top = mix(least >> np.uint64(20)).reshape(BANDS, ROWS)
            band = bands.copy()
            for k in range(ROWS):
                band = mix(band * np.uint64(0xD6E8FEB86659FD93) + top[:, k])
            sig = ((top.reshape(-1, 16) & np.uint64(15)) << nibbles).sum(axis=1, dtype=np.uint64)
            once = mix(found)
            out.append((len(found), once.sum(dtype=np.uint64).astype(np.int64), mix(once + np.uint64(1)).sum(dtype=np.uint64).astype(np.int64), band.view(np.int64), sig.view(np.int64), _sketch(found)))
        yield pd.DataFrame(out, columns=["n", "k1", "k2", "bands", "sig", "sketch"]).assign(doc_id=pdf["doc_id"].astype("Int64").to_numpy(), key=pdf["key"].to_numpy())[["doc_id", "key", "n", "k1", "k2", "bands", "sig", "sketch"]]


def _full_sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        # A thousand sets at a time: they are larger than their texts.
        for i in range(0, len(pdf), 1000):
            part = pdf.iloc[i : i + 1000]
            yield pd.DataFrame({"node": part["node"].to_numpy(), "shingles": [s.view(np.int64) for s in _sets(part["text"].tolist())]})


def _differ(a: Column, b: Column) -> Column:
    """Number of nibbles in which two signatures differ."""
    total = F.lit(0)
    for k in range(HASHES // 16):
        x = F.get(a, F.lit(k)).bitwiseXOR(F.get(b, F.lit(k)))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 1))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 2)).bitwiseAND(F.lit(0x1111111111111111))
        total = total + F.bit_count(x)
    return total


def _liked(pairs: DataFrame, signatures: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) that size and signature allow."""
    left = signatures.select(F.col("node").alias("a"), F.col("n").alias("_na"), F.col("sig").alias("_sa"))
    right = signatures.select(F.col("node").alias("b"), F.col("n").alias("_nb"), F.col("sig").alias("_sb"))
    return (
        pairs.join(left, "a")
        .join(right, "b")
        .where(F.least("_na", "_nb") * 100 >= F.greatest("_na", "_nb") * percent)
        .where(_differ(F.col("_sa"), F.col("_sb")) <= may_differ(percent))
        .select("a", "b")
    )


def _apart(pairs: DataFrame, found: DataFrame) -> DataFrame:
    """Pairs (a, b) that no component (node, component) holds both of."""
    of = lambda side: found.select(F.col("node").alias(side), F.col("component").alias(f"_c{side}"))
    placed = pairs.join(of("a"), "a", "left").join(of("b"), "b", "left")
    return placed.where(F.coalesce("_ca", "a") != F.coalesce("_cb", "b")).select("a", "b")


def _pairs_of_blocks(percent: int):
    """Compare two blocks of one bucket: pairs in different components that size, signature and sketch allow.

    A pair that shares several buckets comes from the first of them only.
    """
    most = may_differ(percent)

    def laid(block):
        column = lambda k: [m[k] for m in block]
        return (
            np.array(column("node"), np.int64), np.array(column("component"), np.int64), np.array(column("n"), np.int64),
            np.stack([np.asarray(x, np.int64) for x in column("sig")]).view(np.uint64), np.stack([np.asarray(x, np.int64) for x in column("bands")]),
            np.stack([np.frombuffer(x, np.uint8) for x in column("sketch")]).astype(np.int16),
        )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for band, i, j, x, y in zip(pdf["band"], pdf["i"], pdf["j"], pdf["x"], pdf["y"], strict=True):
                (na, ca, sa, ga, ba, ka), (nb, cb, sb, gb, bb, kb) = laid(x), laid(y)
                good = (ca[:, None] != cb) & (np.minimum(sa[:, None], sb) * 100 >= np.maximum(sa[:, None], sb) * percent)
                if i == j:
                    good &= na[:, None] < nb
                differ = np.zeros(good.shape, np.uint8)
                for k in range(ga.shape[1]):
                    z = ga[:, k][:, None] ^ gb[:, k]
                    z |= z >> np.uint64(1)
                    z |= z >> np.uint64(2)
                    differ += np.bitwise_count(z & np.uint64(0x1111111111111111))
                p, q = np.nonzero(good & (differ <= most))
                for first in range(0, len(p), 20_000):
                    u, v = p[first : first + 20_000], q[first : first + 20_000]
                    near = np.abs(ka[u] - kb[v]).sum(1) * (100 + percent) <= (sa[u] + sb[v]) * (100 - percent)
                    u, v = u[near], v[near]
                    shared = ba[u] == bb[v]
                    once = ba[u, shared.argmax(1)] == band
                    u, v = na[u[once]], nb[v[once]]
                    yield pd.DataFrame({"a": np.minimum(u, v), "b": np.maximum(u, v)})

    return run


def _across(members: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of different components in one bucket: members (band, node, component) in blocks, block against block."""
    sizes = materialize(members.groupBy("band").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")), "sizes")
    held = members.join(sizes, "band").join(reps, "node").withColumn("i", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
    blocks = materialize(held.groupBy("band", "i").agg(F.collect_list(F.struct("node", "component", "n", "sig", "bands", "sketch")).alias("x")), "blocks")
    other = blocks.select("band", F.col("i").alias("j"), F.col("x").alias("y"))
    return blocks.join(other, "band").where("i <= j").select("band", "i", "j", "x", "y").mapInPandas(_pairs_of_blocks(percent), "a long, b long").distinct()


def _confirmed(pairs: DataFrame, docs: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """Edges (u, v): pairs whose full sets are similar enough."""
    nodes = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    wanted = reps.join(nodes, "node", "left_semi").select("node", "doc_id", "key")
    texts = docs.join(wanted, ["doc_id", "key"]).dropDuplicates(["doc_id", "key"]).select("node", "text")
    sets = materialize(texts.mapInPandas(_full_sets, "node long, shingles array<long>"), "sets")
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("_x")), "a").join(
        sets.select(F.col("node").alias("b"), F.col("shingles").alias("_y")), "b"
    )
    common = F.size(F.array_intersect("_x", "_y"))
    return both.where(common * 100 >= (F.size("_x") + F.size("_y") - common) * percent).select(F.col("a").alias("u"), F.col("b").alias("v"))


def grouped(docs: DataFrame, percent: int = 85) -> DataFrame:
    """doc_id, key, n, row, least, component_id, first: rows of ``docs``, the id of each row, and of its component
    the smallest doc_id and, of the rows with that doc_id, the one to keep."""
    text = text_column(docs)
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("key"), text.alias("text"))
    # Rows are numbered once, in the written table; a class of equal sets is named by its least row.
    profile = materialize(slim.mapInPandas(_profiles, PROFILE).withColumn("row", F.monotonically_increasing_id()), "profile")
    shingled = profile.where("n > 0 and doc_id is not null")
    # Sides that are aggregated are written first: a join of two plain exchanges can split a hot key.
    classes = materialize(
        shingled.groupBy("k1", "k2", "n").agg(F.min("row").alias("node"), F.min("doc_id").alias("least"), F.count("*").alias("_rows")).where("_rows > 1").drop("_rows"), "copies"
    )
    own = lambda c: F.when((F.col("row") == F.coalesce("node", "row")) & F.col("doc_id").isNotNull(), F.col(c)).alias(c)
    classed = materialize(
        profile.join(classes, ["k1", "k2", "n"], "left").select(
            "doc_id", "key", "n", "row",
            F.when(F.col("doc_id").isNull(), F.col("row")).otherwise(F.coalesce("node", "row")).alias("node"),
            F.when(F.col("doc_id").isNotNull(), F.coalesce("least", "doc_id")).alias("least"),
            own("bands"), own("sig"), own("sketch"),
        ),
        "classes",
    )
    reps = classed.where("bands is not null")
    signatures = reps.select("node", "n", "sig")
    banded = reps.select("node", F.explode("bands").alias("band"))
    buckets = materialize(
        banded.groupBy("band").agg(F.min("node").alias("pivot"), F.max("node").alias("_last")).where("pivot < _last").drop("_last"), "pivots"
    )
    members = materialize(banded.join(buckets, "band"), "buckets")
    stars = materialize(
        members.where("node <> pivot").groupBy(F.col("pivot").alias("a"), F.col("node").alias("b")).agg(F.count("*").alias("shared")), "stars"
    )
    # One partner for each: the pivot of most of its buckets.
    best = stars.groupBy("b").agg(F.min(F.struct(-F.col("shared"), "a"))["a"].alias("a")).select("a", "b")
    pairs = materialize(_liked(best, signatures, percent), "pairs")
    edges = materialize(_confirmed(pairs, slim, reps, percent), "links")
    found = materialize(components(edges), "components")
    # Its other pivots, where they are not yet in its component.
    pairs = materialize(_liked(_apart(stars.select("a", "b"), found), signatures, percent).join(pairs, ["a", "b"], "left_anti"), "pairs")
    if not pairs.isEmpty():
        edges = materialize(edges.unionByName(_confirmed(pairs, slim, reps, percent)), "links")
        found = materialize(components(edges), "components")
    # What still shares a bucket but not a component.
    placed = members.join(found, "node", "left").select("band", "node", F.coalesce("component", "node").alias("component"))
    mixed = materialize(placed.groupBy("band").agg(F.min("component").alias("_low"), F.max("component").alias("_high")).where("_low < _high").select("band"), "mixed")
    open_ = placed.join(mixed, "band")
    rest = _across(open_, reps.select("node", "n", "sig", "bands", "sketch"), percent)
    pairs = materialize(rest.join(stars, ["a", "b"], "left_anti"), "pairs")
    if not pairs.isEmpty():
        found = materialize(components(edges.unionByName(_confirmed(pairs, slim, reps, percent))), "components")
    # Of each component the smallest doc_id, and of each class the first row that has its smallest doc_id.
    linked = reps.select("node", "least").join(found.select("node", "component").distinct(), "node")
    names = linked.join(linked.groupBy("component").agg(F.min("least").alias("component_id")), "component").select("node", "component", "component_id")
    return classed.join(names, "node", "left").select(
        "doc_id", "key", "n", "row", F.coalesce("component", "node").alias("component"), F.coalesce("component_id", "least").alias("component_id")
    )


def near_duplicates(docs: DataFrame, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row per row of ``docs`` (doc_id, text)."""
    return grouped(docs, percent).select(
        "doc_id", F.col("n").alias("n_shingles"), "component_id",
        F.coalesce(F.col("component_id") == F.col("doc_id"), F.lit(True)).alias("kept"),
    )


def clean(docs: DataFrame) -> DataFrame:
    """Pipeline stage: one row of each group (similarity 0.80 or more); the columns of ``docs``.

    The row that stays is one with the group's smallest doc_id.  Rows without words, or without a doc_id, stay.
    """
    rows = materialize(grouped(docs, STAGE_PERCENT).where("n > 0 and doc_id is not null"), "grouped")
    # Where one doc_id has several texts of a group, the least text hash stays.
    first = materialize(
        rows.where("doc_id = component_id").groupBy("component").agg(F.min("key").alias("kept_key"), F.count("*").alias("_n")).where("_n > 1").drop("_n"), "kept-keys"
    )
    dropped = rows.join(first, "component", "left").where((F.col("doc_id") != F.col("component_id")) | (F.col("key") != F.coalesce("kept_key", "key")))
    gone = dropped.select("doc_id", F.col("key").alias("_key")).distinct().select(F.col("doc_id").alias("_doc"), "_key")
    # Rows that repeat doc_id and text are few and meet by themselves; the rest needs no shuffle of texts.
    twice = materialize(rows.groupBy("doc_id", "key").agg(F.count("*").alias("_n")).where("_n > 1").select(F.col("doc_id").alias("_doc"), F.col("key").alias("_key")), "repeats")
    once = twice.join(gone, ["_doc", "_key"], "left_anti")
    held = own_columns(docs, F.col("doc_id").cast("long").alias("_id"), F.xxhash64(text_column(docs)).alias("_text_key"))
    at = (F.col("_id") == F.col("_doc")) & (F.col("_text_key") == F.col("_key"))
    left = held.join(gone.unionByName(once), at, "left_anti")
    one_each = held.join(once, at, "left_semi").dropDuplicates(["_id", "_text_key"])
    return with_own(left.unionByName(one_each), docs.columns)

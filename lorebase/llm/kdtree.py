"""Exact top-k by inner product with a KD-tree for each shard.

Rows are dealt to shards by a hash.  Each shard's tree splits at the median of the widest side, by position, so it is balanced
whatever repeats, and keeps for every node the tight bounding box of its vectors and the least id in it.  A query goes
through a tree best first: the box bounds the score from above (the larger of q*low and q*high in each dimension), and the
traversal ends at the first node that cannot come before the kth answer, by score and then by id; a box of equal vectors
that ties with it ends there too, so very many copies of one vector are not read.

A query is first answered in its own shard, from the tree's own leaves.  Its kth score and id then travel with it to all
other shards, which return only what comes before them.  Queries go in blocks, and a task holds one block and one tree at a
time, so what travels is (shards x blocks) of both; no pair leaves a task but a query's k best there.

Integers are exact (``vectors.product``).  Defined results: vectors that are null or hold a null or non-finite component, and
rows with a null id, take no part; vectors are compared with those of their own length; integers beyond 2**26 either way are held at
that bound; a query leaves out its own row alone, so other rows of its id or of the same numbers are answers,
and rows that repeat a query's id are queries of their own; an empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lorebase.llm.common import materialize, scratch
from lorebase.llm.vectors import blocks_of, finite, matrix, product, scaled

MOST = 1 << 26
#: Vectors of a shard, of a leaf, and queries of a block, about; queries whose bounds are taken at once.
SHARD, LEAF, BLOCK, STEP = 8192, 128, 8192, 512
#: A tree as bytes: ids, row numbers and vectors in the order of the leaves; of each node its stretch, children, box and least id.
PARTS = {"ids": "<i8", "rows": "<i8", "vectors": "<i4", "nodes": "<i4", "low": "<i4", "high": "<i4", "least": "<i8"}
TREE = "dims int, shard int, " + ", ".join(f"{p} binary" for p in PARTS)
ASKED = "dims int, shard int, row long, query_id long, q binary, kth long, kth_id long, ids array<long>, scores array<long>"
HIT = "row long, query_id long, vec_id long, score long"
#: Stands for no kth answer yet.
NONE = np.iinfo(np.int64).min


def built(ids: np.ndarray, rows: np.ndarray, x: np.ndarray) -> dict[str, np.ndarray]:
    """A tree over the rows of ``x``; node 0 is the root, a node without children has -1."""
    order, nodes, low, high, least = np.arange(len(x)), [], [], [], []
    open_ = [(0, len(x), -1, 0)]
    while open_:
        lo, hi, parent, side = open_.pop()
        at, mine = len(nodes), order[lo:hi]
        if parent >= 0:
            nodes[parent][2 + side] = at
        nodes.append([lo, hi, -1, -1])
        low.append(x[mine].min(0) if x.shape[1] else x[0])
        high.append(x[mine].max(0) if x.shape[1] else x[0])
        least.append(ids[mine].min())
        if hi - lo > LEAF and (high[-1] > low[-1]).any():
            widest = int(np.argmax(high[-1].astype(np.int64) - low[-1]))
            half = (hi - lo) // 2
            order[lo:hi] = mine[np.argpartition(x[mine, widest], half)]
            open_ += [(lo, lo + half, at, 0), (lo + half, hi, at, 1)]
    return {"ids": ids[order], "rows": rows[order], "vectors": x[order], "nodes": np.array(nodes), "low": np.array(low), "high": np.array(high), "least": np.array(least)}


class Tree:
    def __init__(self, dims: int, **parts: bytes):
        self.__dict__ |= {p: np.frombuffer(parts[p], PARTS[p]) for p in PARTS}
        self.dims = dims
        self.vectors, self.low, self.high = (a.reshape(-1, dims) if dims else a.reshape(len(n), 0) for a, n in ((self.vectors, self.ids), (self.low, self.least), (self.high, self.least)))
        self.nodes = self.nodes.reshape(-1, 4).tolist()
        self.keys = self.least.tolist()

    def bounds(self, q: np.ndarray) -> list[list[int]]:
        """Of each query and node, a score that no vector in the box exceeds."""
        return (product(np.maximum(q, 0), self.high) + product(np.minimum(q, 0), self.low)).tolist()

    def best(self, q: np.ndarray, bound: list[int], k: int, own: int, kth: tuple[int, int]) -> list[tuple[int, int]]:
        """(-score, id) of the k best, in order, that come before ``kth``; the row ``own`` is left out."""
        found: list[tuple[int, int]] = []
        limit = kth
        heap = [(-bound[0], self.keys[0], 0)]
        while heap:
            over, key, node = heapq.heappop(heap)
            # Nothing behind it in the heap can come before the limit either.
            if (over, key) > limit:
                break
            lo, hi, left, right = self.nodes[node]
            if left >= 0:
                for child in (left, right):
                    if (-bound[child], self.keys[child]) <= limit:
                        heapq.heappush(heap, (-bound[child], self.keys[child], child))
                continue
            score = product(q[None, :], self.vectors[lo:hi])[0]
            fine = np.flatnonzero((-score <= limit[0]) & (self.rows[lo:hi] != own))
            if len(fine):
                # Of equal scores the least ids: no more than k of a leaf can count.
                fine = fine[np.lexsort((self.ids[lo:hi][fine], -score[fine]))[:k]]
                found = sorted(found + [(-int(score[i]), int(self.ids[lo + i])) for i in fine])[:k]
                if len(found) == k:
                    limit = min(limit, found[-1])
        return [f for f in found if f <= kth]


def _planted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One tree for each (dims, shard), whose rows come one after another."""
    held: list[tuple] = []
    last = None

    def tree() -> pa.RecordBatch:
        ids, rows, x = (np.concatenate([h[i] for h in held]) for i in range(3))
        parts = built(ids, rows, x)
        return pa.RecordBatch.from_pylist([{"dims": last[0], "shard": last[1]} | {p: np.ascontiguousarray(parts[p], PARTS[p]).tobytes() for p in PARTS}], pa.schema([("dims", pa.int32()), ("shard", pa.int32()), *[(p, pa.binary()) for p in PARTS]]))

    for batch in batches:
        dims, shard = np.asarray(batch.column("dims")), np.asarray(batch.column("shard"))
        cuts = [0, *(np.flatnonzero((dims[1:] != dims[:-1]) | (shard[1:] != shard[:-1])) + 1).tolist(), len(dims)]
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            if lo == hi:
                continue
            key, part = (int(dims[lo]), int(shard[lo])), batch.slice(lo, hi - lo)
            if last not in (None, key):
                yield tree()
                held = []
            last = key
            x = matrix(part.column("v"), key[0]) if key[0] else np.zeros((hi - lo, 0), np.int32)
            held.append((np.asarray(part.column("vec_id")), np.asarray(part.column("row")), x))
    if held:
        yield tree()


def _trees(batch: pa.RecordBatch) -> Iterator[tuple[dict, Tree]]:
    for i in range(batch.num_rows):
        r = {c: batch.column(c)[i].as_py() for c in batch.schema.names}
        yield r, Tree(r["dims"], **{p: r[p] for p in PARTS})


def _at_home(k: int, every: int):
    """Each query of a shard with its answers there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r, tree in _trees(batch):
                asked = np.flatnonzero(tree.ids % every == 0)
                out = []
                for first in range(0, len(asked), STEP):
                    some = asked[first : first + STEP]
                    for i, bound in zip(some, tree.bounds(tree.vectors[some]), strict=True):
                        found = tree.best(tree.vectors[i], bound, k, int(tree.rows[i]), (-NONE, -NONE))
                        kth = found[-1] if len(found) == k else (-NONE, -NONE)
                        out.append({
                            "dims": r["dims"], "shard": r["shard"], "row": int(tree.rows[i]), "query_id": int(tree.ids[i]), "q": tree.vectors[i].tobytes(),
                            "kth": -kth[0], "kth_id": kth[1] if len(found) == k else NONE, "ids": [f[1] for f in found], "scores": [-f[0] for f in found],
                        })
                if out:
                    yield pa.RecordBatch.from_pylist(out, _ASKED)

    return run


_LONGS = pa.list_(pa.int64())
_ASKED = pa.schema([("dims", pa.int32()), ("shard", pa.int32()), ("row", pa.int64()), ("query_id", pa.int64()), ("q", pa.binary()), ("kth", pa.int64()), ("kth_id", pa.int64()), ("ids", _LONGS), ("scores", _LONGS)])
_HIT = pa.schema([(c, pa.int64()) for c in ("row", "query_id", "vec_id", "score")])


def _abroad(k: int):
    """Answers to a block of queries in a shard that is not their own, before each one's kth so far."""

    def run(trees: pa.Table, asked: pa.Table) -> pa.Table:
        hits = []
        for batch in trees.to_batches() if asked.num_rows else ():
            for r, tree in _trees(batch):
                kth, kth_id, rows, ids = (asked.column(c).to_pylist() for c in ("kth", "kth_id", "row", "query_id"))
                q = np.frombuffer(b"".join(asked.column("q").to_pylist()), "<i4").reshape(len(rows), r["dims"])
                for first in range(0, len(rows), STEP):
                    for i, bound in enumerate(tree.bounds(q[first : first + STEP]), first):
                        limit = (-NONE, -NONE) if kth_id[i] == NONE else (-kth[i], kth_id[i])
                        hits += [(rows[i], ids[i], f[1], -f[0]) for f in tree.best(q[i], bound, k, -1, limit)]
        return pa.Table.from_arrays([pa.array(c, pa.int64()) for c in zip(*hits, strict=True)] or [pa.array([], pa.int64())] * 4, schema=_HIT)

    return run


def search(vectors: DataFrame, k: int = 10, every: int = 100, scale: int = 1024) -> DataFrame:
    """query_id, rank, vec_id, score: the k best of all rows (vec_id, embedding) for each row whose id ``every`` divides."""
    spark = vectors.sparkSession
    with scratch(spark):
        fit = F.col("vec_id").isNotNull() & finite(F.col("embedding"))
        kept = vectors.where(fit).select(F.col("vec_id").cast("long").alias("vec_id"), scaled(F.col("embedding"), scale, MOST).alias("v"), F.size("embedding").alias("dims"))
        # Rows are numbered once, in the written table.
        rows = materialize(kept.withColumn("row", F.monotonically_increasing_id()), "numbered")
        shards = blocks_of(rows, SHARD)
        dealt = rows.withColumn("shard", F.pmod(F.xxhash64("row"), F.lit(shards)).cast("int"))
        trees = materialize(dealt.repartition("dims", "shard").sortWithinPartitions("dims", "shard").mapInArrow(_planted, TREE), "trees")
        asked = materialize(trees.mapInArrow(_at_home(k, every), ASKED), "asked")
        blocks = blocks_of(asked, BLOCK)
        # Block against shard: both are copied to where they meet, one of each at a time.
        whole = trees.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        sent = asked.select("dims", F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int").alias("block"), F.col("shard").alias("home"), "row", "query_id", "q", "kth", "kth_id")
        sent = sent.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).where("shard <> home").drop("home")
        at = ("dims", "shard", "block")
        abroad = whole.groupBy(*at).cogroup(sent.groupBy(*at)).applyInArrow(_abroad(k), HIT)
        home = asked.select("row", "query_id", F.explode(F.arrays_zip("ids", "scores")).alias("h")).select("row", "query_id", F.col("h.ids").alias("vec_id"), F.col("h.scores").alias("score"))
        order = Window.partitionBy("row").orderBy(F.desc("score"), "vec_id")
        ranked = home.unionByName(abroad).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        return materialize(ranked.select("query_id", "rank", "vec_id", "score"), "nearest", keep=True)

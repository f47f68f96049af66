"""Ball k-means: clusters are balls, and a vector is compared only with centroids that its place in its ball allows.

A cluster is a ball: its centroid and a radius that no member exceeds.  Centroid j is a neighbour of ball i only if
half the distance of their centroids is within the radius of i.  With the neighbours in order of distance, a member
nearer to its centroid than half the way to the first neighbour lies in the stable core and stays without a
comparison; the others lie in annuli, one for each neighbour, and a member of annulus t is compared with the first t
neighbours alone.  A tie at exactly half the way is compared too, so the result is that of comparing with all.

Distances are squared and integers, so every test is exact.  A round is one pass: rows keep their cluster and distance, sums
and radii are partial aggregates, and k rows of them come to the driver, which places the centroids and the neighbours.
The radius after a move is bounded by the radius before it and the length of the move, so no extra pass finds it.

Defined results: vectors that are null, of another length, or with a null or non-finite component take no part; integers beyond
2**27 either way are held at that bound, as squared distances of larger ones fit no long; with fewer vectors than
centroids every vector is one; rows that repeat an id count as often as they stand there (as centroids the lesser vector is first),
and a null id comes last in the choice; equal centroids leave the larger number empty, and an empty one stays; an empty table
gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorebase.llm.common import materialize, scratch
from lorebase.llm.vectors import finite, matrix, product, scaled

MOST = 1 << 27
STATE = "vec_id long, v array<int>, cluster int, distance long"


class Balls:
    """Centroids, and of each the neighbours in order of distance; radii of None mean every other centroid."""

    def __init__(self, centroids: list[list[int]], radii: list[int] | None):
        self.centroids = np.array(centroids, np.int64)
        self.norms = (self.centroids**2).sum(1)
        between = self.norms[:, None] + self.norms - 2 * product(self.centroids, self.centroids)
        self.near, self.gaps = [], []
        for i, row in enumerate(between):
            order = np.argsort(row, kind="stable")
            order = order[order != i]
            if radii is not None:
                order = order[[int(row[j]) <= 4 * radii[i] ** 2 for j in order]] if len(order) else order
            self.near.append(order)
            self.gaps.append(row[order])

    def distances(self, x: np.ndarray, of: np.ndarray | list[int]) -> np.ndarray:
        return (x**2).sum(1)[:, None] + self.norms[of] - 2 * product(x, self.centroids[of])


def _nearest(distance: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The smallest number among the nearest of the centroids ``of``, and the distance."""
    least = distance.min(1)
    return np.where(distance == least[:, None], of, np.iinfo(np.int64).max).min(1), least


def _moved(balls: Balls, x: np.ndarray, cluster: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cluster and distance of vectors whose cluster was ``cluster`` (-1: none yet)."""
    out, best = cluster.copy(), np.zeros(len(x), np.int64)
    for i in np.unique(cluster):
        members = np.flatnonzero(cluster == i)
        if i < 0:
            every = np.arange(len(balls.centroids))
            out[members], best[members] = _nearest(balls.distances(x[members], every), every)
            continue
        own = balls.distances(x[members], [i])[:, 0]
        best[members] = own
        # The annulus: how many neighbours lie within twice the way to the own centroid; 0 is the stable core.
        annulus = np.searchsorted(balls.gaps[i], 4 * own, "right")
        inner = 0
        while inner < len(balls.near[i]):
            # Annuli are compared in bands that double, each with the neighbours of its outermost.
            outer = min(len(balls.near[i]), max(1, 2 * inner))
            some = members[(annulus > inner) & (annulus <= outer)]
            if len(some):
                of = np.concatenate(([i], balls.near[i][:outer]))
                out[some], best[some] = _nearest(balls.distances(x[some], of), of)
            inner = outer
    return out, best


def _pass(balls: Balls, dims: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column("v"), dims).astype(np.int64)
            cluster, distance = _moved(balls, x, np.asarray(batch.column("cluster")).astype(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("v"), pa.array(cluster.astype(np.int32)), pa.array(distance)], ["vec_id", "v", "cluster", "distance"])

    return run


def cluster(vectors: DataFrame, k: int = 40, rounds: int = 5, dims: int = 64, scale: int = 256, seed: str = "2") -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every vector (vec_id, embedding)."""
    spark = vectors.sparkSession
    with scratch(spark):
        fit = (F.size("embedding") == dims) & finite(F.col("embedding"))
        start = vectors.where(fit).select(F.col("vec_id").cast("long").alias("vec_id"), scaled(F.col("embedding"), scale, MOST).alias("v"), F.lit(-1).alias("cluster"), F.lit(0).cast("long").alias("distance"))
        state = materialize(start, "vectors")
        chosen = state.select(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")).cast("binary"), 256).alias("h"), "v").orderBy(F.col("h").asc_nulls_last(), "v").limit(k)
        centroids = [list(r.v) for r in chosen.collect()]  # k rows
        radii, totals = None, {}
        for turn in range(rounds + 1 if centroids else 0):
            state = materialize(state.mapInArrow(_pass(Balls(centroids, radii), dims), STATE), "assigned", keep=turn == rounds)
            sums = [F.sum(F.get("v", F.lit(i)).cast("long")) for i in range(dims)] if turn < rounds else []
            found = state.groupBy("cluster").agg(F.count("*").alias("n"), F.max("distance").alias("far"), F.sum("distance").alias("inertia"), F.array(*sums).alias("sums")).collect()  # k rows at most
            totals = {r.cluster: r.inertia for r in found}
            if turn < rounds:
                placed, radii = [list(c) for c in centroids], [0] * len(centroids)
                for r in found:
                    placed[r.cluster] = [s // r.n for s in r.sums]
                    move = sum((a - b) ** 2 for a, b in zip(placed[r.cluster], centroids[r.cluster], strict=True))
                    radii[r.cluster] = isqrt(r.far) + 1 + isqrt(move) + 1
                centroids = placed
    if not centroids:
        return vectors.limit(0).select(F.col("vec_id").cast("long").alias("vec_id"), *[F.lit(None).cast(t).alias(c) for c, t in (("cluster", "int"), ("distance", "long"), ("cluster_inertia", "long"), ("inertia", "long"), ("centroid_sha256", "string"))])
    digest = lambda c: hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()
    rows = [(i, totals[i], sum(totals.values()), digest(c)) for i, c in enumerate(centroids) if i in totals]
    figures = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    # k rows, broadcast.
    return state.select("vec_id", "cluster", "distance").join(F.broadcast(figures), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")

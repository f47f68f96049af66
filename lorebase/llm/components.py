"""Connected components by alternating large-star and small-star."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorebase.llm.common import materialize


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step over edges (u, v).

    Large: each vertex hands its larger neighbours to its least neighbour (or itself).  Small: each vertex
    hands its smaller neighbours, and itself, to the least of them.  The least neighbour comes from an
    aggregation with partial sums, so a vertex with very many neighbours is no single task's load, and the
    join back is an inner join whose large partitions Spark can split.
    """
    if large:
        sides = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        sides = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = materialize(sides.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
    near = sides.join(least, "u")
    if large:
        return near.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    handed = near.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return handed.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """node, component (its least member) of every vertex in edges (u, v); loops are ignored.

    Ends when a round changes nothing: each round writes its edges to the shared folder, and the comparison is
    of their number and a sum of hashes.
    """
    edges = materialize(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    print_of = lambda e: tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    seen = print_of(edges)
    for _ in range(rounds if seen[0] else 0):
        edges = materialize(_star(_star(edges, True), False), "edges")
        now = print_of(edges)
        if now == seen:
            break
        seen = now
    else:
        if seen[0]:
            raise RuntimeError(f"no fixed point after {rounds} rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )

"""Breadth-first search over edge tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorebase.sources.scratch import materialize


def hops(edges: DataFrame, start: DataFrame, depth: int) -> DataFrame:
    """id, distance: vertices within ``depth`` undirected hops of start (id), the start included at 0."""
    both = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    reached = [start.select("id", F.lit(0).alias("distance"))]
    for step in range(1, depth + 1):
        front = both.join(reached[-1].withColumnRenamed("id", "src"), "src").select(F.col("dst").alias("id")).distinct()
        seen = reduce(DataFrame.unionByName, reached).select("id")
        reached.append(front.join(seen, "id", "left_anti").withColumn("distance", F.lit(step)))
    return reduce(DataFrame.unionByName, reached)


def _either_way(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()


#: Edges of a task that takes a step.
STEPPED = 1 << 16


def around(edges: DataFrame, starts: DataFrame, depth: int) -> DataFrame:
    """start, id, distance: the vertices within ``depth`` undirected hops of each start (src), itself included at 0.

    A step joins the front with the edges and keeps the least distance of each pair.  Pairs grow with edges, so both are
    dealt to as many tasks as these need, whatever Spark would put together.
    """
    both = materialize(_either_way(edges), "either-way")
    tasks = both.count() // STEPPED + 1
    reached = starts.select(F.col("src").alias("start"), F.col("src").alias("id"), F.lit(0).alias("distance"))
    front = reached
    for step in range(1, depth + 1):
        met = front.select("start", "id").repartition(tasks, "id").join(both.repartition(tasks, "src"), F.col("id") == F.col("src"))
        laid = met.select("start", F.col("dst").alias("id"), F.lit(step).alias("distance")).unionByName(reached)
        least = laid.repartition(tasks, "start", "id").groupBy("start", "id").agg(F.min("distance").alias("distance"))
        front = materialize(least.where(F.col("distance") == step), f"hop-{step}")
        reached = reached.unionByName(front)
    return reached


def paths(edges: DataFrame, most: int) -> DataFrame:
    """start, id, distance, path (vertices, by '>'): a shortest path between vertices two hops or more apart, ``most`` at most.

    Of several shortest paths the first by spelling.  Each round carries one path for each pair of vertices.
    """
    both = materialize(_either_way(edges), "either-way")
    front = both.select(F.col("src").alias("start"), F.col("src").alias("id"), F.col("src").alias("path"), F.lit(0).alias("distance")).distinct()
    reached = front
    for step in range(1, most + 1):
        longer = front.join(both, F.col("id") == F.col("src")).select("start", F.col("dst").alias("id"), F.concat_ws(">", "path", "dst").alias("path"))
        new = longer.groupBy("start", "id").agg(F.min("path").alias("path")).join(reached, ["start", "id"], "left_anti")
        front = materialize(new.withColumn("distance", F.lit(step)), f"paths-{step}")
        reached = reached.unionByName(front)
    return reached.where("distance > 1")

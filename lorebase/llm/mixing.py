"""Mix sources to target weights by hash-threshold histograms.

Sizes (words) are summed by source and hash bucket.  A source whose target is ``copies + rest`` times its
size takes every document ``copies`` times, and once more those whose hash lies under a threshold.  The
threshold is found in nested steps: a histogram of 1,024 buckets finds the boundary bucket, and only the
rows of that bucket are summed again over its 1,024 parts, and so on; nothing is sorted.  The final
boundary part is taken if that brings the source nearer to its target.

Hashes are 40 bits of an MD5 digest of doc_id and text, so reruns agree, whatever the partitions.  Rows that repeat both share a
hash and are taken together.

Defined results: null or empty text has size 0 and takes 0, and a very long one is counted whole; a null source is a source of its own, listed
last; sources without words have target 0; extra columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorebase.llm.common import materialize, own_columns, text_column, where_settled, with_own, words

BITS = 10
LEVELS = 4


def targets(sizes: DataFrame, weights=(5, 2, 1), total_percent: int = 150, cap: int = 2) -> DataFrame:
    """source, source_size, target from one row (source, source_size) per source.

    Shares are proportional to weights, stopped at ``cap`` times the size, and what is cut off is shared
    again: the level at which ``sum(min(cap * size, level * weight))`` is the total.  Sources reach their cap in
    the order of cap / weight, so running sums over that order give the level.  The windows without a
    partition see one row per source.
    """
    order = Window.orderBy(F.col("source").cast("binary").asc_nulls_last())
    wheel = F.array(*[F.lit(float(w)) for w in weights])
    ranked = sizes.withColumn("weight", F.get(wheel, (F.row_number().over(order) - 1) % len(weights))).withColumn(
        "cap", F.col("source_size").cast("double") * cap
    )
    everything = Window.partitionBy()
    by_cap = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").cast("binary").asc_nulls_last())
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    after = by_cap.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    levels = (
        ranked.withColumn("total", F.sum("source_size").over(everything).cast("double") * total_percent / 100)
        .withColumn("level", (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after))
        # The first source whose cap is not under its level ends the capped ones.
        .withColumn("open", F.min(F.when(F.col("cap") >= F.col("level") * F.col("weight"), F.struct(F.col("cap") / F.col("weight"), "level"))).over(everything))
    )
    return levels.select(
        "source", "source_size",
        F.least(F.col("cap"), F.coalesce(F.col("open")["level"] * F.col("weight"), F.col("cap"))).alias("target"),
    )


def _hash(doc_id: Column, text: Column) -> Column:
    """BITS * LEVELS bits of the MD5 digest of doc_id and text."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", doc_id.cast("string"), text).cast("binary")), 1, BITS * LEVELS // 4), 16, 10).cast("long")


def _same(a, b):
    return a.eqNullSafe(b)


def _figures(docs: DataFrame) -> list[Column]:
    """source, size and hash of each row."""
    text = text_column(docs)
    return [F.col("source").cast("string").alias("source"), F.size(words(F.col("text"))).cast("long").alias("size"), _hash(F.col("doc_id"), text).alias("hash")]


def thresholds(slim: DataFrame, weights=(5, 2, 1), total_percent: int = 150, cap: int = 2) -> DataFrame:
    """source, source_size, target, base, threshold: one row per source, from rows (source, size, hash)."""
    per_source = targets(slim.groupBy("source").agg(F.sum("size").alias("source_size")), weights, total_percent, cap)
    plan = materialize(
        per_source.withColumn("base", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
        .withColumn("budget", F.col("target") - F.col("base") * F.col("source_size"))
        .withColumn("prefix", F.lit(0).cast("long")),
        "mix-plan",
    )
    for level in range(LEVELS):
        # prefix: the upper bits of the threshold found so far; budget: words still to take inside that bucket.
        shift = BITS * (LEVELS - level - 1)
        inside = slim.join(plan.select("source", "prefix"), _same(slim["source"], plan["source"])).where(
            F.shiftright(slim["hash"], shift + BITS) == plan["prefix"]
        ).select(slim["source"], F.shiftright(slim["hash"], shift).alias("bucket"), "size")
        sums = inside.groupBy("source", "bucket").agg(F.sum("size").alias("size"))
        running = Window.partitionBy("source").orderBy("bucket")
        steps = (
            sums.withColumn("upto", F.sum("size").over(running))
            .join(plan.withColumnRenamed("source", "_s"), _same(F.col("source"), F.col("_s")))
        )
        fits = steps.where(F.col("upto") <= F.col("budget")).groupBy("source").agg(F.max("upto").alias("under"))
        # The boundary is the first bucket that passes the budget, else the end of the range.
        over = steps.where(F.col("upto") > F.col("budget")).groupBy("source").agg(
            F.min("bucket").alias("bucket"), F.min(F.struct("bucket", "size"))["size"].alias("edge")
        )
        f, o = fits.alias("f"), over.alias("o")
        plan = materialize(
            plan.alias("p")
            .join(f, _same(F.col("p.source"), F.col("f.source")), "left")
            .join(o, _same(F.col("p.source"), F.col("o.source")), "left")
            .select(
                "p.source", "p.source_size", "p.target", "p.base",
                (F.col("p.budget") - F.coalesce("f.under", F.lit(0))).alias("budget"),
                F.coalesce(F.col("o.bucket"), (F.col("p.prefix") + 1) * (1 << BITS)).alias("prefix"),
                F.coalesce("o.edge", F.lit(0)).cast("long").alias("edge"),
            ),
            "mix-plan",
        )
        if level < LEVELS - 1:
            plan = plan.drop("edge")
    return plan.withColumn("threshold", F.col("prefix") + F.when(F.col("edge") < 2 * F.col("budget"), 1).otherwise(0))


def _taken(base: Column, size: Column, more: Column, cap: int) -> Column:
    return (size * (base + F.when(more & (base < cap), 1).otherwise(0))).alias("taken")


def mix(docs: DataFrame, weights=(5, 2, 1), total_percent: int = 150, cap: int = 2) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken, source."""
    slim = materialize(docs.select("doc_id", *_figures(docs)), "mix")
    chosen = thresholds(slim, weights, total_percent, cap).withColumnRenamed("source", "_s")
    return slim.join(chosen, _same(F.col("source"), F.col("_s"))).select(
        "doc_id", "size", "source_size", "target", _taken(F.col("base"), F.col("size"), F.col("hash") < F.col("threshold"), cap), "source"
    )


def mixed(docs: DataFrame, cap: int = 2) -> DataFrame:
    """Pipeline stage: rows of which the mix takes words, with size, source_size, target and taken.

    Columns of ``docs`` that have these names are replaced.  Texts are not shuffled: the thresholds come from sizes and
    hashes, and a row is judged where it stands, by the one row of its source.
    """
    slim = materialize(docs.select(*_figures(docs)), "mix")
    chosen = thresholds(slim, cap=cap).select(F.struct("source", "source_size", "target", "base", "threshold").alias("_plan"))
    held = own_columns(docs, F.struct(*_figures(docs)).alias("_row"))
    rows = held.join(chosen, _same(F.col("_row.source"), F.col("_plan.source")))
    taken = _taken(F.col("_plan.base"), F.col("_row.size"), F.col("_row.hash") < F.col("_plan.threshold"), cap)
    rows = where_settled(rows.withColumn("_taken", taken), F.col("_taken") > 0)
    return with_own(rows, docs.columns, size=F.col("_row.size"), source_size=F.col("_plan.source_size"), target=F.col("_plan.target"), taken=F.col("_taken"))

"""Helpers shared by the corpus operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lorebase.sources.scratch import materialize, scratch, shared_dir

__all__ = ["materialize", "scratch", "shared_dir"]

#: ASCII white space that separates words: space and U+0009 to U+000D.
SPACE_CLASS = r"[\x20\x09-\x0D]"
WORD_CLASS = r"[^\x20\x09-\x0D]"


def words(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text, in order; null gives an empty array."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE_CLASS + "+"), "")


def own_columns(docs: DataFrame, *also: Column) -> DataFrame:
    """``_own``, a struct of all columns of ``docs``, and ``also``: whatever users call theirs, no name clashes."""
    return docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("_own"), *also)


def with_own(rows: DataFrame, columns: list[str], **new: Column) -> DataFrame:
    """The columns of ``_own`` in their order, those in ``new`` replaced or added."""
    given = [new.pop(c).alias(c) if c in new else F.col(f"_own.`{c}`").alias(c) for c in columns]
    return rows.select(*given, *[v.alias(k) for k, v in new.items()])


#: Size of a bit set, as a power of two: 2**23 bits are 1 MB, whatever the input.
SET_BITS = 23


def _slot(value: Column) -> Column:
    return F.shiftrightunsigned(value, 64 - (SET_BITS - 6)).cast("int")


def _mask(value: Column) -> Column:
    """Three bits of a word of 64, from the lower bits of the value."""
    one = lambda by: F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(value, by).bitwiseAND(63).cast("int"))
    return one(0).bitwiseOR(one(6)).bitwiseOR(one(12))


def bit_set(values: DataFrame) -> Column:
    """A set of the longs in the only column of ``values``: an array of 2**(SET_BITS - 6) words, as a scalar subquery.

    Of fixed size; like a Bloom filter it may take a value for a member, never the other way round.
    """
    (name,) = values.columns
    words = values.groupBy(_slot(F.col(name)).alias("slot")).agg(F.bit_or(_mask(F.col(name))).alias("word"))
    every = values.sparkSession.range(1 << (SET_BITS - 6)).select(F.col("id").cast("int").alias("slot"))
    filled = every.join(words, "slot", "left").agg(F.sort_array(F.collect_list(F.struct("slot", F.coalesce("word", F.lit(0).cast("long")).alias("word")))).alias("all"))
    return filled.select(F.col("all.word")).scalar()


def may_hold(members: Column, value: Column) -> Column:
    """Whether a bit set may hold a value; the set is named once, as each mention of it goes to every task."""
    mask = _mask(value)
    return F.get(members, _slot(value)).bitwiseAND(mask) == mask


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_column(docs: DataFrame) -> Column:
    """The text, with null as the empty string."""
    return F.coalesce(F.col("text").cast("string"), F.lit(""))


def where_settled(df: DataFrame, condition: Column) -> DataFrame:
    """A filter that stays above the columns it reads.

    The optimiser writes the definitions of computed columns into a filter and pushes it down; for columns
    built on one another by higher-order functions that multiplies the work with every level.  It leaves a
    filter above a column that is not deterministic, such as a row number.
    """
    return df.withColumn("_settled", F.monotonically_increasing_id()).where(condition & (F.col("_settled") >= 0)).drop("_settled")


def sample_of(rows: DataFrame, total: int, size: int) -> DataFrame:
    """At most ``size`` distinct rows (doc_id, key, ...) of about ``total``: those with the least hash, in every run the same.

    Twenty times as many rows as asked for are looked at, so copies of one row do not fill the sample.
    """
    share = int(min(1.0, 20 * size / max(total, 1)) * (1 << 30))
    near = rows.where(F.pmod(F.xxhash64(F.lit(3), "doc_id", "key"), F.lit(1 << 30)) < share)
    return near.distinct().orderBy(F.xxhash64("doc_id", "key"), *rows.columns).limit(size)

"""Benchmark decontamination by spaced seeds.

Words are lower-cased and stripped of marks at both ends.  A mask picks some of the words of a span and
ignores the others, so a changed word breaks only the seeds that look at it.  Each position of every document
gives one hash per mask; those that equal a hash of a benchmark item are hits on a diagonal (position in the
document less position in the item).  Around each diagonal the item and the document are laid side by side:
the item is leaked if some stretch of ``window`` words (the whole item, if shorter) agrees in ``min_percent`` of its words.

The plan is the same at every size: seeds of documents pass a bit set of fixed size built from the benchmark's
seeds, and what it lets through meets them in a join by shuffle.  A second bit set, of the documents with hits,
keeps the texts of the others out of the second shuffle.  A benchmark of far more than a million words fills the
first, and billions of documents with hits the second: more rows then travel, with the same result.  Of a
document only the words beside the item go on to the comparison.

Defined results: null and empty texts have no words and no hits; items of fewer words than the shortest mask
(six) are leaked only by a document that is the item and nothing else, as the words of a short item stand
in many texts by chance; rows that repeat a doc_id and text are one document; rows that share a doc_id with
different texts, and rows without a doc_id, are judged by their own texts, and so are items; extra columns are
ignored; an empty table on either side gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorebase.llm.common import SPACE_CLASS, bit_set, materialize, may_hold, own_columns, text_column, with_own

#: The masks.  Any 13 words with two changed ones, or 20 with four, keep a seed in most cases.
MASKS = ("111111", "1101011", "11100111", "110010011")
SHORTEST, LONGEST = min(map(len, MASKS)), max(map(len, MASKS))


def tokens(text: Column) -> Column:
    """Lower-case words without marks at their ends; words of marks only vanish."""
    bare = F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}\x20\x09-\x0D]+(?=[\x20\x09-\x0D]|$)|(?<=[\x20\x09-\x0D]|^)[^\p{L}\p{N}\x20\x09-\x0D]+", "")
    return F.array_remove(F.split(bare, SPACE_CLASS + "+"), "")


def _seeds(rows: DataFrame, keep: list[str]) -> DataFrame:
    """keep, pos, seed: the hash of each mask at each position where its span fits; of fewer words one hash of all."""
    # Words as integers, shifted copies side by side: one row per position, hashed in generated code.
    ids = rows.withColumn("_ids", F.transform("words", lambda w: F.hash(w)))
    shifted = F.arrays_zip(
        *[(F.slice("_ids", F.lit(k + 1), F.greatest(F.size("_ids") - k, F.lit(0))) if k else F.col("_ids")).alias(f"w{k}") for k in range(LONGEST)]
    )
    laid = ids.select(*keep, F.posexplode(shifted).alias("pos", "z"))
    hashes = [
        F.when(F.col(f"z.w{len(m) - 1}").isNotNull(), F.xxhash64(F.lit(n), *[F.col(f"z.w{k}") for k, bit in enumerate(m) if bit == "1"]))
        for n, m in enumerate(MASKS)
    ]
    whole = F.col(f"z.w{SHORTEST - 1}").isNull() & (F.col("pos") == 0)
    hashes[0] = F.coalesce(hashes[0], F.when(whole, F.xxhash64(F.lit(len(MASKS)), *[F.col(f"z.w{k}") for k in range(SHORTEST - 1)])))
    return laid.select(*keep, "pos", F.explode(F.array(*hashes)).alias("seed")).where("seed is not null")


def _leaks(docs: DataFrame, benchmark: DataFrame, window: int, min_percent: int) -> DataFrame:
    """doc_id, key (hash of the text), item_id, start, end, matched."""
    text = text_column(docs)
    items = materialize(
        benchmark.select("item_id", tokens(F.coalesce(F.col("text"), F.lit(""))).alias("words"))
        .withColumn("item", F.xxhash64("item_id", F.array_join("words", " ")))
        .where(F.size("words") > 0),
        "bench",
    ).dropDuplicates(["item"])
    known = materialize(
        _seeds(items.withColumn("length", F.size("words")), ["item", "length"]).select("item", "length", F.col("pos").alias("item_pos"), "seed"), "bench-seeds"
    )
    here = _seeds(docs.select("doc_id", F.xxhash64(text).alias("key"), tokens(text).alias("words")), ["doc_id", "key"])
    hits = materialize(
        here.where(may_hold(bit_set(known.select("seed")), F.col("seed")))
        .join(known.hint("merge"), "seed")
        .select("doc_id", "key", "item", "length", (F.col("pos") - F.col("item_pos")).alias("diagonal"))
        .distinct(),
        "hits",
    )
    marked = hits.groupBy("doc_id", "key").agg(F.collect_set(F.struct("item", "length", "diagonal")).alias("marks"))
    keyed = docs.select(F.col("doc_id").alias("_id"), text.alias("text"), F.xxhash64(text).alias("_key"))
    begin, end = F.greatest(F.col("m.diagonal"), F.lit(0)), F.least(F.col("m.diagonal") + F.col("m.length"), F.size("words"))
    laid = (
        # By shuffle at every size: which documents have hits is not bounded, so it is never broadcast.
        keyed.where(may_hold(bit_set(hits.select("key")), F.col("_key")))
        .join(marked.hint("merge"), F.col("_id").eqNullSafe(F.col("doc_id")) & (F.col("_key") == F.col("key")))
        .dropDuplicates(["doc_id", "key"])
        .select("doc_id", "key", tokens(F.col("text")).alias("words"), "marks")
        .select("doc_id", "key", "words", F.explode("marks").alias("m"))
        .select("doc_id", "key", "m.*", begin.alias("from"), end.alias("to"), F.slice("words", begin + 1, F.greatest(end - begin, F.lit(0))).alias("part"))
    )
    pairs = (
        laid.join(items.hint("merge"), "item")
        .withColumn(
            "same",
            F.zip_with("part", F.slice("words", F.col("from") - F.col("diagonal") + 1, F.size("part")), lambda a, b: (a == b).cast("int")),
        )
        .withColumn("width", F.least(F.lit(window), F.col("length")))
        # The stretch that agrees most.
        .withColumn(
            "best",
            F.array_max(
                F.transform(
                    F.sequence(F.lit(1), F.greatest(F.size("same") - F.col("width") + 1, F.lit(1))),
                    lambda i: F.aggregate(F.slice("same", i, F.col("width")), F.lit(0), lambda acc, x: acc + x),
                )
            ),
        )
        .where(F.col("best") * 100 >= F.col("width") * min_percent)
    )
    found = pairs.select("doc_id", "key", "item_id", "from", "to", F.aggregate("same", F.lit(0), lambda acc, x: acc + x).alias("matched"))
    return found.groupBy("doc_id", "key", "item_id").agg(F.max(F.struct("matched", -F.col("from"), "from", "to")).alias("m")).select(
        "doc_id", "key", "item_id", F.col("m.from").alias("start"), F.col("m.to").alias("end"), "m.matched"
    )


def leaks(docs: DataFrame, benchmark: DataFrame, window: int = 16, min_percent: int = 80) -> DataFrame:
    """doc_id, item_id, start, end, matched: one row per leaked item and document, at its best place (words)."""
    return _leaks(docs, benchmark, window, min_percent).drop("key")


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Pipeline stage: rows whose text holds no leaked item; the columns of ``docs``."""
    leaked = _leaks(docs, benchmark, 16, 80).select(F.col("doc_id").alias("_doc"), "key").distinct()
    held = own_columns(docs, F.col("doc_id").alias("_id"), F.xxhash64(text_column(docs)).alias("_key"))
    return with_own(held.join(leaked, F.col("_id").eqNullSafe(F.col("_doc")) & (F.col("_key") == F.col("key")), "left_anti"), docs.columns)

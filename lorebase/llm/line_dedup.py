"""Line dedup: a suffix array over line-ID sequences by distributed prefix doubling, and its common-prefix intervals.

A document's text is a sequence of lines; a line's ID is a 128-bit hash.  A suffix is a place in such a sequence
and runs to the end of its document.  Ranks order all suffixes by their first 2**h lines: those of h = 0 come
from a range-partitioned sort of the line IDs, and those of h + 1 from a sort of pairs of ranks, of a suffix and of
the one 2**h lines after it in the same document.  A rank is a number that grows with its sort key from partition
to partition, so no task sees the whole order.

Suffixes with equal rank at h are an interval of the suffix array in which neighbours share a prefix of 2**h lines
or more (a longest-common-prefix interval).  An interval of one suffix ends there: only suffixes that share
theirs go on, so the table shrinks with every round, and doubling ends when no interval is left, however long
the longest repeat is.

The deepest interval at a power of two of which a suffix is not the first member bounds the length of its longest earlier
copy from both sides.  The exact length is found by halving: an interval of L lines splits into those of L + 2**k
lines by the ranks of level k at L lines further on.  A suffix that is not the first member of its part goes on with
the longer prefix; the first members of all parts, each for its part, go on with the shorter one.  So every suffix
is looked for once, and the interval where it ends gives its longest copied run and one source: the
first place of exactly these lines.  Runs of a document that lie in another of its runs are left out; what is left are its
maximal copied runs, which may overlap.

A copied run of ``min_lines`` lines or more is deleted, and so is a copied line of ``line_words`` words or more;
shorter single lines that many documents share stay.  Earlier means: smaller doc_id (null first), then smaller
text hash, then earlier line; so of several texts under one doc_id one is the first.

Defined results: null text has no lines; blank lines count as lines, but a run without words is never deleted; a document may have any number of lines;
rows that repeat both doc_id and text are one document and get the same result; extra columns pass through,
and those that have a result's name are replaced; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorebase.llm.common import SPACE_CLASS, WORD_CLASS, materialize, own_columns, text_column, where_settled, with_own

#: Lines from which a run counts, and words from which a single line does, as many as the passages of op1 have.
MIN_LINES, LINE_WORDS = 2, 20


def _is_long(line: Column, line_words: int) -> Column:
    """Whether a line has so many words; such a line has a character and a space for each but the last."""
    pattern = rf"^{SPACE_CLASS}*+(?:{WORD_CLASS}++{SPACE_CLASS}++){{{line_words - 1}}}{WORD_CLASS}"
    return (F.length(line) >= 2 * line_words - 1) & line.rlike(pattern)


def _ranked(suffixes: DataFrame, sort_key: list[str], name: str) -> DataFrame:
    """sort_key, first and next: first member and rank of each interval of two suffixes or more, in the order of the key."""
    groups = suffixes.groupBy(*sort_key).agg(F.min("place").alias("first"), F.max("place").alias("_last")).where("first < _last").drop("_last")
    return materialize(groups.repartitionByRange(*sort_key).sortWithinPartitions(*sort_key).withColumn("next", F.monotonically_increasing_id()), name)


def _levels(docs: DataFrame, line_words: int) -> list[DataFrame]:
    """For each h the suffixes in intervals of 2**h lines: place (doc_id, key, start), rank, first (place), worded, long.

    ``worded``: some line of the prefix has words; ``long``: its first line has ``line_words`` words or more.
    """
    text = text_column(docs)
    lines = (
        docs.where(F.col("text").isNotNull())
        .select("doc_id", F.xxhash64(text).alias("key"), F.posexplode(F.split(text, "\n")).alias("start", "line"))
        .select(
            F.struct("doc_id", "key", "start").alias("place"), F.xxhash64("line").alias("a"), F.xxhash64(F.lit(7), "line").alias("b"),
            F.col("line").rlike(WORD_CLASS).alias("worded"), _is_long(F.col("line"), line_words).alias("long"),
        )
    )
    # Rows that repeat doc_id and text hold the same places: an interval of one place is none.
    names = _ranked(lines, ["a", "b"], "line-ranks")
    levels = [materialize(lines.join(names, ["a", "b"]).select("place", F.col("next").alias("rank"), "first", "worded", "long").distinct(), "suffixes-0")]
    while True:
        level = len(levels) - 1
        # The rank of the suffix 2**level lines further on, where that is in an interval too.
        ahead = Window.partitionBy("place.doc_id", "place.key").orderBy("place.start").rangeBetween(1 << level, 1 << level)
        pairs = materialize(
            levels[-1].select("place", "rank", F.first("rank").over(ahead).alias("then"), (F.col("worded") | F.first("worded").over(ahead)).alias("worded"), "long").where("then is not null"),
            f"pairs-{level}",
        )
        names = _ranked(pairs, ["rank", "then"], f"ranks-{level + 1}")
        if names.isEmpty():
            return levels
        levels.append(materialize(pairs.join(names, ["rank", "then"]).select("place", F.col("next").alias("rank"), "first", "worded", "long"), f"suffixes-{level + 1}"))


def _later(level: DataFrame) -> DataFrame:
    return level.where(~F.col("place").eqNullSafe(F.col("first")))


def longest_copies(docs: DataFrame, line_words: int = LINE_WORDS) -> DataFrame:
    """place, first, size, worded, long: suffixes with the length and the first place of their longest earlier copy.

    Of suffixes that share one line only with earlier ones, those are left out whose line is not long.
    """
    levels = _levels(docs, line_words)
    open_ = None
    for k in reversed(range(len(levels))):
        if open_ is not None:
            # Rank and words of the 2**k lines behind the prefix, where they are in an interval.
            behind = F.struct("place.doc_id", "place.key", (F.col("place.start") + F.col("size")).alias("start"))
            level = levels[k].select(F.col("place").alias("_at"), "rank", F.col("worded").alias("_worded"))
            met = materialize(open_.withColumn("_at", behind).join(level, "_at", "left").drop("_at"), f"met-{k}")
            parts = met.where("rank is not null").groupBy("first", "size", "rank").agg(F.min("place").alias("_first"), F.max("place").alias("_last"))
            split = met.join(materialize(parts.where("_first < _last").drop("_last"), f"parts-{k}"), ["first", "size", "rank"], "left")
            longer = split.where("_first is not null").select("place", F.col("_first").alias("first"), (F.col("size") + (1 << k)).alias("size"), (F.col("worded") | F.col("_worded")).alias("worded"), "long")
            shorter = split.where(F.col("_first").isNull() | F.col("_first").eqNullSafe(F.col("place"))).select("place", "first", "size", "worded", "long")
            open_ = longer.unionByName(shorter)
        # Members of the intervals of 2**k lines whose longest copy is not longer, and the first of each longer interval.
        own = levels[k] if k else _later(levels[0]).where("long")
        if k + 1 < len(levels):
            own = own.join(_later(levels[k + 1]).select("place"), "place", "left_anti")
        own = own.select("place", "first", F.lit(1 << k).alias("size"), "worded", "long")
        open_ = materialize(own if open_ is None else open_.unionByName(own), f"open-{k}")
    return _later(open_)


def copied_runs(docs: DataFrame, min_lines: int = MIN_LINES, line_words: int = LINE_WORDS) -> DataFrame:
    """doc_id, key, runs: of each document its maximal copied runs (start, length, source) in order; none lies in another."""
    whole = (F.col("size") >= min_lines) & F.col("worded")
    spans = (
        longest_copies(docs, line_words).where(whole | F.col("long"))
        .select("place.*", F.when(whole, F.col("size")).otherwise(1).alias("length"), F.col("first").alias("source"))
    )
    before = Window.partitionBy("doc_id", "key").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    reached = F.max(F.col("start") + F.col("length")).over(before)
    runs = spans.withColumn("_reached", reached).where(F.col("_reached").isNull() | (F.col("start") + F.col("length") > F.col("_reached")))
    return runs.groupBy("doc_id", "key").agg(F.sort_array(F.collect_list(F.struct("start", "length", "source"))).alias("runs"))


def _deduped(docs: DataFrame, min_lines: int, line_words: int) -> DataFrame:
    """_own, _text, n_lines, n_removed, longest, runs, kept_text: one row per row of ``docs``."""
    marks = copied_runs(docs.select("doc_id", F.col("text").cast("string").alias("text")), min_lines, line_words)
    held = own_columns(docs, F.col("doc_id").alias("_id"), docs["text"].cast("string").alias("_text"), F.xxhash64(text_column(docs)).alias("_key"))
    rows = held.join(marks, F.col("_id").eqNullSafe(F.col("doc_id")) & (F.col("_key") == F.col("key")), "left").select(
        "_own", "_text",
        F.when(F.col("_text").isNull(), F.array().cast("array<string>")).otherwise(F.split("_text", "\n")).alias("_lines"),
        "runs",
    )
    begins = F.transform("runs", lambda r: r["start"])
    ends = F.transform("runs", lambda r: r["start"] + r["length"])
    # Kept lines are the stretches between runs; where runs overlap there is none.
    between = F.arrays_zip(F.concat(F.array(F.lit(0)), ends).alias("f"), F.concat(begins, F.array(F.size("_lines"))).alias("t"))
    kept = F.flatten(F.transform(F.filter(between, lambda x: x["t"] > x["f"]), lambda x: F.slice("_lines", x["f"] + 1, x["t"] - x["f"])))
    lengths = F.transform("runs", lambda r: r["length"])
    # What a run adds to the lines that the one before it reached.
    again = F.zip_with(F.slice(ends, 1, F.greatest(F.size("runs") - 1, F.lit(0))), F.slice(begins, 2, F.greatest(F.size("runs") - 1, F.lit(0))), lambda e, b: F.greatest(e - b, F.lit(0)))
    total = lambda a: F.aggregate(a, F.lit(0), lambda n, x: n + x)
    return rows.select(
        "_own", "_text",
        F.size("_lines").cast("long").alias("n_lines"),
        F.coalesce(total(lengths) - total(again), F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce(F.array_max(lengths), F.lit(0)).alias("longest"),
        "runs",
        F.when(F.col("runs").isNull(), F.coalesce("_text", F.lit(""))).otherwise(F.array_join(kept, "\n")).alias("kept_text"),
    )


def dedup(docs: DataFrame, min_lines: int = MIN_LINES, line_words: int = LINE_WORDS) -> DataFrame:
    """Each document with n_lines, n_removed, longest (copied run), runs (start, length, source; null if none) and kept_text."""
    results = ("n_lines", "n_removed", "longest", "runs", "kept_text")
    return with_own(_deduped(docs, min_lines, line_words), docs.columns, **{c: F.col(c) for c in results})


def clean(docs: DataFrame) -> DataFrame:
    """Pipeline stage: documents without later copies of runs; those that only held copies go; the columns of ``docs``."""
    rows = where_settled(_deduped(docs, MIN_LINES, LINE_WORDS), (F.col("n_removed") == 0) | F.col("kept_text").rlike(WORD_CLASS))
    text = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("_text"))
    counted = {"n_chars": F.length(text).cast("long")} if "n_chars" in docs.columns else {}
    return with_own(rows, docs.columns, text=text, **counted)

"""Folds over ordered events whose next state depends on what was accepted before: limits, state machines, allocation.

Rows are hashed by key and sorted by Spark, which spills; the fold reads them batch by batch and holds the state of
one key only, so neither a long history nor a hot key grows a task's memory.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lorebase.sources.scratch import tasks_for

#: Statuses that a hand-off may take from each status; all others end it.
TRANSITIONS = {
    "draft": ("ready", "cancelled"),
    "ready": ("claimed", "rejected", "expired", "cancelled", "superseded"),
    "claimed": ("in_progress", "blocked", "completed", "cancelled", "expired"),
    "in_progress": ("blocked", "completed", "cancelled", "expired"),
    "blocked": ("in_progress", "completed", "cancelled", "expired"),
}

#: Shares of a context's token budget, and the tokens of text delivered inline at most.
RETRIEVAL_SHARE, REFERENCE_SHARE, INLINE_TOKENS = 0.45, 0.15, 180


#: Rows of a task that packs.
PACKED = 1 << 17


def fold(df: DataFrame, key: list[str], order: list[str], start: Callable, step: Callable, out: str, kind: str, tasks: int | None = None) -> DataFrame:
    """df and a column ``out``: step(state, row) -> (state, value) over each key's rows in order, in as many tasks as Spark or the caller sees fit."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + f", `{out}` {kind}"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, state = None, None
        for pdf in batches:
            values = []
            for row in pdf.itertuples(index=False):
                now = tuple(getattr(row, k) for k in key)
                if now != last:
                    last, state = now, start()
                state, value = step(state, row)
                values.append(value)
            pdf[out] = values
            yield pdf

    return df.repartition(*([tasks] if tasks else []), *key).sortWithinPartitions(*key, *order).mapInPandas(run, schema)


def rate_limited(calls: DataFrame, limit: int, seconds: int = 60) -> DataFrame:
    """calls(caller long, at long, call_id long) and ``admitted``: fewer than ``limit`` admitted in the last ``seconds``.

    Rejected calls do not count.  A gap of ``seconds`` empties the window, so a caller's calls are cut at gaps and
    the pieces are folded apart.  Rows without caller or time are not admitted.
    """
    own = Window.partitionBy("caller").orderBy("at", "call_id")
    gap = (F.col("at") - F.lag("at").over(own) >= seconds).cast("int")
    known = calls.where("caller IS NOT NULL AND at IS NOT NULL")
    pieces = known.withColumn("_gap", F.coalesce(gap, F.lit(0))).withColumn("piece", F.sum("_gap").over(own)).drop("_gap")

    def step(window, row):
        while window and window[0] <= row.at - seconds:
            window.popleft()
        if len(window) >= limit:
            return window, False
        window.append(row.at)
        return window, True

    done = fold(pieces, ["caller", "piece"], ["at", "call_id"], deque, step, "admitted", "boolean").drop("piece")
    return done.unionByName(calls.where("caller IS NULL OR at IS NULL").withColumn("admitted", F.lit(False)))


#: Statuses that nothing follows by a wish, and wishes that need the source to be as it was.
TERMINAL = ("completed", "rejected", "expired", "cancelled", "superseded")
FRESH_ONLY = ("claimed", "in_progress", "blocked")


def as_of(steps: DataFrame, log: DataFrame, key: str, at: str, value: str, out: str) -> DataFrame:
    """``steps`` with the newest ``value`` of the log (key, at, value) at the time of each, null before the first.

    Both sides are laid in one order of time, a log entry before a step of the same time, and the last entry is carried
    on: no pair of rows is formed.
    """
    columns = steps.columns
    laid = steps.select(F.col(key).alias("_key"), F.col(at).alias("_at"), F.lit(1).alias("_side"), F.lit(None).cast(log.schema[value].dataType).alias("_value"), F.struct(*columns).alias("_row"))
    entries = log.select(F.col(key).alias("_key"), F.col(at).alias("_at"), F.lit(0).alias("_side"), F.col(value).alias("_value"), F.lit(None).cast(laid.schema["_row"].dataType).alias("_row"))
    # Of entries of one time the greatest value counts.
    order = Window.partitionBy("_key").orderBy("_at", "_side", F.col("_value").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    carried = laid.unionByName(entries).withColumn("_last", F.last("_value", ignorenulls=True).over(order))
    return carried.where("_side = 1").select("_row.*", F.col("_last").alias(out))


def handoff_states(steps: DataFrame, handoffs: DataFrame | None = None, checkpoints: DataFrame | None = None) -> DataFrame:
    """steps(handoff_id, seq, wanted, at) with ``status`` and ``reason`` after each: what it wanted, or what became of it.

    handoffs: handoff_id, task_id, checkpoint, expires_at; checkpoints: task_id, at, version.  A hand-off that has run out
    by the time of a step expires; one whose task has a newer checkpoint by then than the hand-off was made from is superseded
    when somebody claims it or works on it; a change that the state machine forbids leaves the status.  Without
    handoffs only the state machine decides.
    """
    columns = steps.columns
    if handoffs is None:
        none = F.lit(None).cast("long")
        rows = steps.withColumns({"x_made": none, "x_until": none, "x_now": none, "x_time": none})
    else:
        own = handoffs.select("handoff_id", "task_id", F.col("checkpoint").alias("x_made"), F.col("expires_at").alias("x_until"))
        dated = as_of(steps.join(own, "handoff_id"), checkpoints, "task_id", "at", "version", "x_now")
        rows = dated.select(*columns, "x_made", "x_until", "x_now", F.col("at").alias("x_time"))

    def judged(status, row):
        if row.wanted != "expired" and status not in TERMINAL and pd.notna(row.x_until) and row.x_until <= row.x_time:
            return "expired", {"status": "expired", "reason": "ttl_elapsed"}
        if row.wanted in FRESH_ONLY and pd.notna(row.x_now) and row.x_now != row.x_made:
            return "superseded", {"status": "superseded", "reason": "source_state_changed"}
        if row.wanted in TRANSITIONS.get(status, ()):
            return row.wanted, {"status": row.wanted, "reason": None}
        return status, {"status": status, "reason": "conflict"}

    folded = fold(rows, ["handoff_id"], ["seq"], lambda: "draft", judged, "x_out", "struct<status:string,reason:string>")
    return folded.select(*columns, "x_out.status", "x_out.reason")


def within_budget(items: DataFrame, key: list[str], order: list[str], size: str, budget: int) -> DataFrame:
    """items and ``taken``: in order, each item that still fits into its key's budget; one that does not is passed over."""

    def step(used, row):
        fits = used + getattr(row, size) <= budget
        return used + getattr(row, size) * fits, bool(fits)

    return fold(items, key, order, lambda: 0, step, "taken", "boolean")


def allocate(candidates: DataFrame, budget: int) -> DataFrame:
    """candidates(request string, place long, id long, category string, content_tokens long, summary_tokens long,
    reference_tokens long, text_key string, needs_check boolean), and ``disposition``.

    In order of place: repeats of a delivered text are omitted; the content, else the summary, goes inline while the
    share of the budget lasts; evidence that needs a check and a category's third item can only be referred to;
    what fits nowhere is omitted.  A null summary_tokens means that there is no summary apart from the content.
    """

    def step(state, row):
        used, referred, seen, per_category = state
        only_reference = bool(row.needs_check) or per_category.get(row.category, 0) >= 2
        room = RETRIEVAL_SHARE * budget - used
        disposition = "omitted"
        if row.text_key and row.text_key in seen:
            return state, disposition
        for name, size in (("inline", row.content_tokens), ("summary", row.summary_tokens)):
            if not only_reference and pd.notna(size) and size <= min(INLINE_TOKENS, room):
                disposition, used = name, used + size
                seen.add(row.text_key)
                break
        else:
            if referred + row.reference_tokens <= REFERENCE_SHARE * budget:
                disposition, referred = "reference", referred + row.reference_tokens
        if disposition != "omitted":
            per_category[row.category] = per_category.get(row.category, 0) + 1
        return (used, referred, seen, per_category), disposition

    return fold(candidates, ["request"], ["place"], lambda: (0, 0, set(), {}), step, "disposition", "string")


#: Shares of a budget kept for continuity, for skills and for the answer.
CONTINUITY_SHARE, SKILL_SHARE, RESERVE_SHARE = 0.30, 0.15, 0.10


def limits(requests: DataFrame) -> DataFrame:
    """What is left of each request's budget for skills, retrieval and references, once what must be there is in it.

    requests: request, budget, mandatory_tokens, continuity_tokens, continuity_brief_tokens (its first three entries), and
    references (whether the client takes them).  Mandatory content is never cut; continuity is shortened when it passes its
    share; skills, retrieval and references share what remains after them and the reserve.
    """
    share = lambda of: F.floor(F.col("budget") * of).cast("long")
    compacted = F.col("continuity_tokens") > share(CONTINUITY_SHARE)
    rows = requests.withColumn("compacted", compacted).withColumn("continuity", F.when(compacted, F.col("continuity_brief_tokens")).otherwise(F.col("continuity_tokens")))
    remaining = F.greatest(F.lit(0), F.col("budget") - F.col("mandatory_tokens") - F.col("continuity") - share(RESERVE_SHARE))
    rows = rows.withColumn("remaining", remaining)
    rows = rows.withColumn("reference_limit", F.least("remaining", share(REFERENCE_SHARE))).withColumn("skill_limit", F.least("remaining", share(SKILL_SHARE)))
    left = F.greatest(F.lit(0), F.col("remaining") - F.col("reference_limit") - F.col("skill_limit"))
    return rows.select(
        "request", "budget", "mandatory_tokens", F.col("continuity").alias("continuity_tokens"), "compacted", (F.col("mandatory_tokens") > F.col("budget")).alias("over_budget"), share(RESERVE_SHARE).alias("reserve_tokens"),
        "reference_limit", "skill_limit", F.least(left, share(RETRIEVAL_SHARE)).alias("retrieval_limit"), "references",
    )


def pack(requests: DataFrame, items: DataFrame) -> DataFrame:
    """Every item of every request with ``disposition`` and ``tokens`` (what it takes of the budget).

    items: request long, kind ('skill' or 'memory'), place, category, content_tokens, summary_tokens (null: none), reference_tokens,
    text_key, needs_check.  Skills come first, then memories in order of place.  Content goes inline while its share lasts, else
    the summary, else a reference.  A memory whose text was delivered is omitted, and one that needs a check, or the third of
    its category, can only be referred to.  The texts that a request remembers are those delivered inline, which its
    budget bounds.
    """
    columns = items.columns
    # Items are dealt once, to tasks of about ``PACKED`` rows, for the join and for the fold.
    tasks = tasks_for(items, PACKED)
    rows = items.repartition(tasks, "request").join(limits(requests).select("request", "reference_limit", "skill_limit", "retrieval_limit", "references"), "request")
    rows = rows.withColumn("x_turn", (F.col("kind") != "skill").cast("int"))

    def step(state, row):
        skills, retrieved, referred, seen, per_category = state
        skill = row.kind == "skill"
        used, limit = (skills, row.skill_limit) if skill else (retrieved, row.retrieval_limit)
        barred = not skill and (bool(row.needs_check) or per_category.get(row.category, 0) >= 2)
        out, tokens = "omitted", 0
        if not skill and row.text_key and row.text_key in seen:
            return state, {"disposition": out, "tokens": tokens}
        if not barred and row.content_tokens <= INLINE_TOKENS and used + row.content_tokens <= limit:
            out, tokens = "inline", row.content_tokens
        elif not barred and pd.notna(row.summary_tokens) and (skill or row.summary_tokens <= INLINE_TOKENS) and used + row.summary_tokens <= limit:
            out, tokens = "summary", row.summary_tokens
        elif row.references and referred + row.reference_tokens <= row.reference_limit:
            out, tokens = "reference", row.reference_tokens
        if out == "reference":
            referred += tokens
        elif skill:
            skills += tokens
        else:
            retrieved += tokens
            if out != "omitted":
                seen.add(row.text_key)
        if out != "omitted" and not skill:
            per_category[row.category] = per_category.get(row.category, 0) + 1
        return (skills, retrieved, referred, seen, per_category), {"disposition": out, "tokens": int(tokens)}

    folded = fold(rows, ["request"], ["x_turn", "place"], lambda: (0, 0, 0, set(), {}), step, "x_out", "struct<disposition:string,tokens:bigint>", tasks)
    return folded.select(*columns, "x_out.disposition", "x_out.tokens")


def token_usage(requests: DataFrame, packed: DataFrame) -> DataFrame:
    """Of each request what its pack takes: mandatory, continuity, skills, retrieval, references, and what was omitted."""
    part = lambda c: F.sum(F.when(c, F.col("tokens")).otherwise(0)).alias
    inline, skill = F.col("disposition").isin("inline", "summary"), F.col("kind") == "skill"
    sums = packed.groupBy("request").agg(
        part(inline & skill)("skill_tokens"), part(inline & ~skill)("retrieval_tokens"), part(F.col("disposition") == "reference")("reference_tokens"),
        F.sum(F.when(F.col("disposition") == "omitted", F.col("content_tokens")).otherwise(0)).alias("omitted_tokens"),
    )
    rows = limits(requests).join(sums, "request", "left").na.fill(0, sums.columns[1:])
    total = sum((F.col(c) for c in ("continuity_tokens", "skill_tokens", "retrieval_tokens", "reference_tokens")), F.col("mandatory_tokens"))
    return rows.select("request", "budget", "mandatory_tokens", "continuity_tokens", *sums.columns[1:], "reserve_tokens", total.alias("estimated_total"), "compacted", "over_budget")

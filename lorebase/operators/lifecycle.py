"""Facts, lifecycles, utility and ingestion as windows and aggregations over logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DAY = 86400
#: Weights of the utility score's components.
WEIGHTS = {
    "initial_importance": 1.0, "successful_reuse": 0.12, "cross_session_reuse": 0.06, "cross_agent_reuse": 0.05, "task_success": 0.18, "trust": 0.04, "freshness": 0.08,
    "pinned": 0.5, "staleness_penalty": 0.12, "duplicate_penalty": 0.08, "ignored_penalty": 0.04, "correction_penalty": 0.30, "contradiction_penalty": 0.25,
}
#: What a memory is worth when it is admitted, and what its agent's trust counts.
ADMISSION = {"cold": 0.08, "active": 0.22, "persist": 0.32}
TRUST = {"low": 0.0, "standard": 0.5, "trusted": 1.0}


def supersession(facts: DataFrame) -> DataFrame:
    """Facts with ``superseded_at``: a fact ends when the next one on its key says something else.

    An equal value on the same key adds another current fact, and a later change ends only the newest of them.
    """
    order = Window.partitionBy("entity_id", "claim_key").orderBy("observed_at", "fact_id")
    changes = F.lead("claim_value").over(order) != F.col("claim_value")
    return facts.withColumn("superseded_at", F.when(changes, F.lead("observed_at").over(order)))


def transitions(memories: DataFrame, log: DataFrame, scores: DataFrame, review_seconds: int, stable_from: float = 0.6) -> DataFrame:
    """The audit of a log (memory_id, step, at, action): state before and after, pin and expiry after each step.

    pin ends the expiry; unpin gives ``stable`` or ``active`` by score and a new review date; demote gives ``cold``, takes
    the pin and leaves the expiry; restore gives ``active``, and a new review date unless the memory is pinned.
    """
    seen = log.join(memories.select(F.col("id").alias("memory_id"), F.col("lifecycle").alias("_first"), "expires_at"), "memory_id").join(scores.select("memory_id", "score"), "memory_id", "left")
    order = Window.partitionBy("memory_id").orderBy("step")
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    action = F.col("action")
    state = F.when(action == "pin", "pinned").when(action == "demote", "cold").when(action == "restore", "active").otherwise(F.when(F.col("score") >= stable_from, "stable").otherwise("active"))
    holds = F.when(action == "pin", True).when(action.isin("unpin", "demote"), False)
    begun = F.col("_first") == "pinned"
    pinned = F.coalesce(F.last(holds, ignorenulls=True).over(upto), begun)
    rows = seen.withColumn("new_state", state).withColumn("pinned", pinned)
    # What sets the expiry: a pin sets none, a new review date sets one; a demotion keeps what there was.
    setter = F.when(action != "demote", F.struct(F.when(~F.col("pinned"), F.col("at") + review_seconds).alias("at")))
    kept = F.coalesce(F.last(setter, ignorenulls=True).over(upto), F.struct(F.when(~begun, F.col("expires_at")).alias("at")))
    return rows.select(
        "memory_id", "step", F.coalesce(F.lag("new_state").over(order), F.col("_first")).alias("previous_state"), "new_state", "pinned", kept["at"].alias("expires_at")
    )


def utility(memories: DataFrame, usage: DataFrame, packs: DataFrame, outcomes: DataFrame, agents: DataFrame, now: int) -> DataFrame:
    """memory_id, the 13 components and score of each memory.

    usage (pack_id, memory_id, agent_id, usage_type, used_at, duplicate, contradiction) belongs to packs (pack_id,
    task_id, session_id), and these to outcomes by task, and by session where the outcome names one.  Corrections and
    rework are summed over joined rows, so a pack with several uses counts its outcomes as often.
    """
    used = usage.join(packs.select("pack_id", "task_id", "session_id"), "pack_id")
    n = lambda kind: F.count_if(F.col("usage_type") == kind).alias(kind)
    useful = F.col("usage_type").isin("expanded", "used")
    counts = used.groupBy("memory_id").agg(
        *[n(k) for k in ("selected", "injected", "expanded", "used", "ignored", "rejected", "corrected")],
        F.count_distinct(F.when(useful, F.col("session_id"))).alias("sessions"),
        F.count_distinct(F.when(useful, F.col("agent_id"))).alias("agents"),
        F.count_if("duplicate").alias("duplicates"),
        F.count_if("contradiction").alias("contradictions"),
        F.max(F.when(useful, F.col("used_at"))).alias("last_used_at"),
    )
    judged = used.where(useful).alias("u").join(
        outcomes.alias("o"), (F.col("u.task_id") == F.col("o.task_id")) & (F.col("o.session_id").isNull() | (F.col("u.session_id") == F.col("o.session_id")))
    )
    results = judged.groupBy("u.memory_id").agg(
        F.count_distinct(F.when((F.col("o.successful") == 1) & (F.col("u.usage_type") == "used"), F.col("o.outcome_id"))).alias("successes"),
        F.sum("o.corrections").alias("corrections"),
        F.sum("o.rework").alias("rework"),
    )
    trust = agents.select(F.col("name").alias("agent"), F.coalesce(*[F.when(F.col("trust_level") == k, v) for k, v in TRUST.items()], F.lit(0.5)).alias("_trust"))
    rows = (
        memories.select(F.col("id").alias("memory_id"), "tier", "agent", "created_at", (F.col("lifecycle") == "pinned").alias("is_pinned"))
        .join(counts, "memory_id", "left").join(results, "memory_id", "left").join(trust, "agent", "left")
        .na.fill(0, [c for c in (*counts.columns, *results.columns) if c not in ("memory_id", "last_used_at")])
    )
    c, top = F.col, lambda x: F.least(x, F.lit(3))
    age = F.greatest(F.floor((now - c("created_at")) / DAY), F.lit(0))
    raw = {
        "initial_importance": F.coalesce(*[F.when(c("tier") == k, v) for k, v in ADMISSION.items()], F.lit(0.15)),
        "successful_reuse": top(c("used") + c("expanded")) + top(c("selected")) * 0.1 + top(c("injected")) * 0.15,
        "cross_session_reuse": F.greatest(top(c("sessions") - 1), F.lit(0)),
        "cross_agent_reuse": F.greatest(top(c("agents") - 1), F.lit(0)),
        "task_success": top(c("successes")),
        "trust": F.coalesce(c("_trust"), F.lit(0.5)),
        "freshness": F.greatest(F.lit(0.0), 1 - age / 365),
        "pinned": c("is_pinned").cast("double"),
        "staleness_penalty": (now - F.coalesce("last_used_at", "created_at") >= 180 * DAY).cast("double"),
        "duplicate_penalty": top(c("duplicates")),
        "ignored_penalty": F.greatest(c("ignored") - c("used"), F.lit(0)) + c("rejected") * 2,
        "correction_penalty": c("corrected") + c("corrections"),
        "contradiction_penalty": c("contradictions") + c("rework"),
    }
    parts = rows.select("memory_id", *[(v.cast("double") * WEIGHTS[k]).alias(k) for k, v in raw.items()])
    signed = [-F.col(k) if k.endswith("_penalty") else F.col(k) for k in raw]
    return parts.withColumn("score", F.least(F.greatest(sum(signed[1:], signed[0]), F.lit(0.0)), F.lit(1.0)))


def reservations(incoming: DataFrame, ledger: DataFrame, now: int, stale_after: int = 300) -> DataFrame:
    """event_id, reserved, attempt of each event: new, failed, or left in processing for more than ``stale_after`` seconds."""
    held = ledger.select("event_id", "status", "updated_at")
    late = (F.col("status") == "processing") & (F.col("updated_at") < now - stale_after)
    new = F.col("status").isNull()
    return incoming.select("event_id").distinct().join(held, "event_id", "left").select(
        "event_id", (new | (F.col("status") == "failed") | late).alias("reserved"), F.when(new, "new").otherwise(F.col("status")).alias("found")
    )


def enqueued(captures: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(raw captures, outbox jobs) to append for captures (event_id, content, ...) that ``known`` (event_id) does not hold.

    Both come from the same rows, so a batch writes both or, when it is repeated, neither again.
    """
    fresh = captures.dropDuplicates(["event_id"]).join(known.select("event_id"), "event_id", "left_anti")
    raw = fresh.withColumn("status", F.lit("queued"))
    jobs = fresh.select(F.concat(F.lit("job_"), F.sha2(F.col("event_id").cast("string"), 256).substr(1, 24)).alias("job_id"), "event_id", F.lit("pending").alias("status"), F.lit(0).alias("attempts"))
    return raw, jobs


def eligible(memories: DataFrame, now: int, include_cold: bool = False) -> Column:
    """Whether a memory may be returned; a table without a lifecycle is judged by its expiry alone."""
    alive = F.col("expires_at").isNull() | (F.col("expires_at") > now)
    if "lifecycle" not in memories.columns:
        return alive
    if include_cold:
        return alive | (F.col("lifecycle") == "cold")
    return alive & ~F.col("lifecycle").isin("cold", "archived")

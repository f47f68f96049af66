"""Queries over states kept as tables; each has SQL written apart from it, from the rule and not from the plan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorebase.operators import lifecycle
from lorebase.sources.views import NOW, view

REVIEW = 30 * 86400


def _views(spark: SparkSession, sf_dir: str, *names: str) -> list[DataFrame]:
    return [view(spark, sf_dir, n) for n in names]


def fact_scd2(spark, sf_dir):
    return lifecycle.supersession(view(spark, sf_dir, "facts")).select("fact_id", "entity_id", "claim_key", "superseded_at")


def fact_stats(spark, sf_dir):
    ended = F.col("superseded_at").isNotNull()
    return lifecycle.supersession(view(spark, sf_dir, "facts")).agg(
        F.count("*").alias("total"), F.count_if(~ended).alias("current_facts"), F.count_if(ended).alias("superseded")
    )


def contradictions(spark, sf_dir):
    now = lifecycle.supersession(view(spark, sf_dir, "facts")).where("superseded_at is null")
    return now.groupBy("entity_id", "claim_key").agg(F.count_distinct("claim_value").alias("n")).where("n > 1")


def _utility(spark, sf_dir):
    return lifecycle.utility(*_views(spark, sf_dir, "memories", "pack_usage", "packs", "task_outcomes", "agents"), now=NOW)


def utility_score(spark, sf_dir):
    parts = _utility(spark, sf_dir)
    return parts.select("memory_id", *[F.round(c, 6).alias(c) for c in parts.columns[1:]])


def utility_inputs(spark, sf_dir):
    """Joined rows of usage, packs and outcomes for each memory."""
    usage, packs, outcomes = _views(spark, sf_dir, "pack_usage", "packs", "task_outcomes")
    p = usage.join(packs, "pack_id").alias("p")
    o = outcomes.alias("o")
    met = p.join(o, (F.col("p.task_id") == F.col("o.task_id")) & (F.col("o.session_id").isNull() | (F.col("p.session_id") == F.col("o.session_id"))))
    return met.groupBy("p.memory_id").agg(F.count("*").alias("joined_rows"), F.sum("o.corrections").alias("corrections"))


def lifecycle_state(spark, sf_dir):
    memories, log = _views(spark, sf_dir, "memories", "lifecycle_log")
    return lifecycle.transitions(memories, log, _utility(spark, sf_dir).select("memory_id", F.round("score", 6).alias("score")), REVIEW)


def reserve_events(spark, sf_dir):
    return lifecycle.reservations(*_views(spark, sf_dir, "incoming", "ingest_ledger"), now=NOW)


def enqueue_capture(spark, sf_dir):
    """Raw captures and the jobs beside them, of events that the ledger does not know."""
    captures = view(spark, sf_dir, "incoming").select("event_id", F.concat_ws(" ", "event_type", "user_id").alias("content"))
    raw, jobs = lifecycle.enqueued(captures, view(spark, sf_dir, "ingest_ledger"))
    return raw.select("event_id", "content", F.col("status").alias("capture_status")).join(jobs.withColumnRenamed("status", "job_status"), "event_id")


QUERIES = {f.__name__: f for f in (fact_scd2, fact_stats, contradictions, utility_score, utility_inputs, lifecycle_state, reserve_events, enqueue_capture)}

_SCD2 = """
numbered AS (SELECT *, row_number() OVER (PARTITION BY entity_id, claim_key ORDER BY observed_at, fact_id) AS k FROM facts),
ended AS (SELECT a.fact_id, a.entity_id, a.claim_key, a.claim_value, b.observed_at AS superseded_at FROM numbered a
 LEFT JOIN numbered b ON b.entity_id = a.entity_id AND b.claim_key = a.claim_key AND b.k = a.k + 1 AND b.claim_value <> a.claim_value)"""

_MET = """
met AS (SELECT u.memory_id, u.usage_type, o.outcome_id, o.successful, o.corrections, o.rework FROM task_outcomes o JOIN packs p ON p.task_id = o.task_id AND (o.session_id IS NULL OR p.session_id = o.session_id) JOIN pack_usage u ON u.pack_id = p.pack_id)"""

_UTILITY = f"""{_MET},
uses AS (SELECT u.*, p.session_id FROM pack_usage u JOIN packs p ON p.pack_id = u.pack_id),
counts AS (SELECT memory_id, count(*) FILTER (usage_type = 'selected') AS selected, count(*) FILTER (usage_type = 'injected') AS injected, count(*) FILTER (usage_type = 'expanded') AS expanded,
 count(*) FILTER (usage_type = 'used') AS used, count(*) FILTER (usage_type = 'ignored') AS ignored, count(*) FILTER (usage_type = 'rejected') AS rejected, count(*) FILTER (usage_type = 'corrected') AS corrected,
 count(*) FILTER (duplicate) AS dup, count(*) FILTER (contradiction) AS contra FROM uses GROUP BY memory_id),
reach AS (SELECT memory_id, count(DISTINCT session_id) AS sessions, count(DISTINCT agent_id) AS agents, max(used_at) AS last_used FROM uses WHERE usage_type IN ('expanded', 'used') GROUP BY memory_id),
wins AS (SELECT memory_id, count(*) AS n FROM (SELECT DISTINCT memory_id, outcome_id FROM met WHERE successful = 1 AND usage_type = 'used') q GROUP BY memory_id),
fines AS (SELECT memory_id, sum(corrections) AS corrections, sum(rework) AS rework FROM met WHERE usage_type IN ('used', 'expanded') GROUP BY memory_id),
parts AS (SELECT m.id AS memory_id,
 CASE m.tier WHEN 'cold' THEN 0.08e0 WHEN 'active' THEN 0.22e0 WHEN 'persist' THEN 0.32e0 ELSE 0.15e0 END AS initial_importance,
 (least(coalesce(used, 0) + coalesce(expanded, 0), 3) + least(coalesce(selected, 0), 3) * 0.1e0 + least(coalesce(injected, 0), 3) * 0.15e0) * 0.12e0 AS successful_reuse,
 greatest(0, least(coalesce(sessions, 0) - 1, 3)) * 0.06e0 AS cross_session_reuse, greatest(0, least(coalesce(agents, 0) - 1, 3)) * 0.05e0 AS cross_agent_reuse,
 least(coalesce(w.n, 0), 3) * 0.18e0 AS task_success, CASE a.trust_level WHEN 'low' THEN 0.0e0 WHEN 'trusted' THEN 1.0e0 ELSE 0.5e0 END * 0.04e0 AS trust,
 greatest(0.0e0, 1 - greatest(0, floor(({NOW} - m.created_at) / 86400e0)) / 365e0) * 0.08e0 AS freshness, CASE WHEN m.lifecycle = 'pinned' THEN 0.5e0 ELSE 0.0e0 END AS pinned,
 CASE WHEN {NOW} - coalesce(last_used, m.created_at) >= 15552000 THEN 0.12e0 ELSE 0.0e0 END AS staleness_penalty, least(coalesce(dup, 0), 3) * 0.08e0 AS duplicate_penalty,
 (greatest(0, coalesce(ignored, 0) - coalesce(used, 0)) + 2 * coalesce(rejected, 0)) * 0.04e0 AS ignored_penalty, (coalesce(corrected, 0) + coalesce(corrections, 0)) * 0.30e0 AS correction_penalty,
 (coalesce(contra, 0) + coalesce(rework, 0)) * 0.25e0 AS contradiction_penalty
 FROM memories m LEFT JOIN counts c ON c.memory_id = m.id LEFT JOIN reach r ON r.memory_id = m.id LEFT JOIN wins w ON w.memory_id = m.id LEFT JOIN fines f ON f.memory_id = m.id LEFT JOIN agents a ON a.name = m.agent),
scored AS (SELECT *, least(1.0e0, greatest(0.0e0, initial_importance + successful_reuse + cross_session_reuse + cross_agent_reuse + task_success + trust + freshness + pinned
 - staleness_penalty - duplicate_penalty - ignored_penalty - correction_penalty - contradiction_penalty)) AS score FROM parts)"""

ORACLE_SQL = {
    "fact_scd2": f"WITH {_SCD2} SELECT fact_id, entity_id, claim_key, superseded_at FROM ended",
    "fact_stats": f"WITH {_SCD2} SELECT count(*) AS total, sum(CASE WHEN superseded_at IS NULL THEN 1 ELSE 0 END)::BIGINT AS current_facts, count(superseded_at) AS superseded FROM ended",
    "contradictions": f"WITH {_SCD2} SELECT entity_id, claim_key, count(DISTINCT claim_value) AS n FROM ended WHERE superseded_at IS NULL GROUP BY ALL HAVING min(claim_value) <> max(claim_value)",
    "utility_score": f"WITH {_UTILITY} SELECT memory_id, " + ", ".join(f"round({k}, 6) AS {k}" for k in (*lifecycle.WEIGHTS, "score")) + " FROM scored",
    "utility_inputs": f"WITH {_MET} SELECT memory_id, count(*) AS joined_rows, sum(corrections)::BIGINT AS corrections FROM met GROUP BY memory_id",
    "lifecycle_state": f"""WITH RECURSIVE {_UTILITY},
steps AS (SELECT l.*, round(s.score, 6) AS score, row_number() OVER (PARTITION BY l.memory_id ORDER BY l.step) AS k FROM lifecycle_log l JOIN scored s ON s.memory_id = l.memory_id),
walk AS (SELECT id AS memory_id, 0::BIGINT AS k, NULL::BIGINT AS step, NULL::VARCHAR AS previous_state, lifecycle AS new_state, lifecycle = 'pinned' AS pinned, CASE WHEN lifecycle <> 'pinned' THEN expires_at END::BIGINT AS expires_at FROM memories
 UNION ALL SELECT s.memory_id, s.k, s.step, w.new_state,
 CASE s.action WHEN 'pin' THEN 'pinned' WHEN 'demote' THEN 'cold' WHEN 'restore' THEN 'active' ELSE CASE WHEN s.score >= 0.6e0 THEN 'stable' ELSE 'active' END END,
 CASE s.action WHEN 'pin' THEN true WHEN 'restore' THEN w.pinned ELSE false END,
 CASE WHEN s.action = 'pin' OR (s.action = 'restore' AND w.pinned) THEN NULL WHEN s.action = 'demote' THEN w.expires_at ELSE s.at + {REVIEW} END
 FROM walk w JOIN steps s ON s.memory_id = w.memory_id AND s.k = w.k + 1)
SELECT memory_id, step, previous_state, new_state, pinned, expires_at FROM walk WHERE k > 0""",
    "reserve_events": f"SELECT DISTINCT i.event_id, CASE WHEN l.event_id IS NULL OR l.status = 'failed' THEN true ELSE l.status = 'processing' AND {NOW} - l.updated_at > 300 END AS reserved, coalesce(l.status, 'new') AS found FROM incoming i LEFT JOIN ingest_ledger l ON l.event_id = i.event_id",
    "enqueue_capture": "SELECT event_id, concat(event_type, ' ', user_id) AS content, 'queued' AS capture_status, concat('job_', sha256(event_id::VARCHAR)[:24]) AS job_id, 'pending' AS job_status, 0 AS attempts FROM incoming WHERE event_id NOT IN (SELECT event_id FROM ingest_ledger)",
}

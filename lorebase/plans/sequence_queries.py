"""Queries from stateful folds.  Their SQL is a recursive query that carries the state from row to row."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorebase.functions import text as T
from lorebase.operators import sequence
from lorebase.sources.views import view

LIMIT, SECONDS, BUDGET = 2, 3600, 400


def rate_limit(spark: SparkSession, d: str) -> DataFrame:
    """Calls of each user, two an hour admitted."""
    calls = view(spark, d, "usage_log").select(F.col("session_id").cast("long").alias("caller"), F.col("used_at").cast("long").alias("at"), F.col("usage_id").cast("long").alias("call_id"))
    return sequence.rate_limited(calls, LIMIT, SECONDS).withColumnRenamed("at", "called_at")


def handoff_fsm(spark: SparkSession, d: str) -> DataFrame:
    """Status of each hand-off after every step that someone asked for; it may have run out, or its task moved on, by then."""
    return sequence.handoff_states(view(spark, d, "handoff_steps"), view(spark, d, "handoff_terms"), view(spark, d, "task_checkpoints")).drop("at")


def _packs(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    requests = view(spark, d, "pack_requests").withColumnRenamed("references_taken", "references")
    return requests, sequence.pack(requests, view(spark, d, "pack_entries"))


def context_pack(spark: SparkSession, d: str) -> DataFrame:
    """Disposition of every skill and memory of every request, after what must be there."""
    return _packs(spark, d)[1].select("request", "place", "kind", "disposition", "tokens")


def context_usage(spark: SparkSession, d: str) -> DataFrame:
    """What each pack takes of its budget, part by part."""
    return sequence.token_usage(*_packs(spark, d))


def skill_budget(spark: SparkSession, d: str) -> DataFrame:
    """Memories of each project and category whose summaries a budget takes: one that does not fit is left out, later ones may fit."""
    m = view(spark, d, "memories").select("project", "category", F.col("id").cast("long").alias("id"), T.token_estimate(F.col("summary")).alias("tokens"))
    return sequence.within_budget(m, ["project", "category"], ["id"], "tokens", BUDGET).select("project", "category", "id", "taken")


def context_allocate(spark: SparkSession, d: str) -> DataFrame:
    """Disposition of every memory for a request by its agent in its category's project, budget 4,000 tokens."""
    m = view(spark, d, "memories").select(
        F.concat_ws("/", "project", "agent").alias("request"), (-F.col("accessed_at")).cast("long").alias("recency"), F.col("id").cast("long").alias("id"), "category",
        T.token_estimate(F.col("content")).cast("long").alias("content_tokens"),
        F.when(F.col("summary") != F.col("content"), T.token_estimate(F.col("summary"))).cast("long").alias("summary_tokens"),
        (T.token_estimate(F.col("summary")) + 20).cast("long").alias("reference_tokens"), F.lower(F.trim("summary")).alias("text_key"), (F.col("id") % 7 == 0).alias("needs_check"),
    )
    ordered = m.withColumn("place", (F.col("recency") * 1000003 + F.col("id")).cast("long")).drop("recency")
    return sequence.allocate(ordered.na.fill(0, ["content_tokens", "reference_tokens"]), 4000).select("request", "id", "category", "disposition")


QUERIES = {f.__name__: f for f in (rate_limit, handoff_fsm, skill_budget, context_allocate, context_pack, context_usage)}

_legal = " OR ".join(f"(s.status = '{a}' AND n.wanted IN ({', '.join(repr(b) for b in to)}))" for a, to in sequence.TRANSITIONS.items())
_PACKED = """l AS (SELECT *, greatest(0, budget - mandatory_tokens - continuity - budget // 10) AS remaining FROM
 (SELECT *, continuity_tokens > budget * 3 // 10 AS compacted, CASE WHEN continuity_tokens > budget * 3 // 10 THEN continuity_brief_tokens ELSE continuity_tokens END AS continuity FROM pack_requests) r0),
r AS (SELECT *, least(remaining, budget * 15 // 100) AS each_limit, least(greatest(0, remaining - 2 * least(remaining, budget * 15 // 100)), budget * 45 // 100) AS retrieval_limit FROM l),
n AS (SELECT e.*, each_limit, retrieval_limit, references_taken, row_number() OVER (PARTITION BY request ORDER BY kind DESC, place) AS k FROM pack_entries e JOIN r USING (request)),
walk AS (SELECT request, 0::BIGINT AS k, NULL::BIGINT AS place, NULL::VARCHAR AS kind, 0::BIGINT AS content_tokens, NULL::VARCHAR AS disposition, 0::BIGINT AS tokens, 0::BIGINT AS skills, 0::BIGINT AS retrieved, 0::BIGINT AS referred, []::VARCHAR[] AS seen, []::VARCHAR[] AS given FROM n WHERE k = 1
 UNION ALL SELECT request, k, place, kind, content_tokens, d, tokens, skills + CASE WHEN kind = 'skill' AND d IN ('inline', 'summary') THEN tokens ELSE 0 END, retrieved + CASE WHEN kind = 'memory' AND d IN ('inline', 'summary') THEN tokens ELSE 0 END,
 referred + CASE WHEN d = 'reference' THEN tokens ELSE 0 END, CASE WHEN kind = 'memory' AND d IN ('inline', 'summary') THEN list_append(seen, text_key) ELSE seen END, CASE WHEN kind = 'memory' AND d <> 'omitted' THEN list_append(given, category) ELSE given END FROM
 (SELECT *, CASE d WHEN 'inline' THEN content_tokens WHEN 'summary' THEN summary_tokens WHEN 'reference' THEN reference_tokens ELSE 0 END AS tokens FROM
 (SELECT *, CASE WHEN kind = 'skill' THEN CASE WHEN content_tokens <= 180 AND skills + content_tokens <= each_limit THEN 'inline' WHEN skills + summary_tokens <= each_limit THEN 'summary' WHEN may_refer THEN 'reference' ELSE 'omitted' END
  WHEN list_contains(seen, text_key) THEN 'omitted' WHEN may AND content_tokens <= 180 AND retrieved + content_tokens <= retrieval_limit THEN 'inline' WHEN may AND summary_tokens <= 180 AND retrieved + summary_tokens <= retrieval_limit THEN 'summary' WHEN may_refer THEN 'reference' ELSE 'omitted' END AS d FROM
 (SELECT n.*, w.skills, w.retrieved, w.referred, w.seen, w.given, NOT n.needs_check AND len(list_filter(w.given, lambda c: c = n.category)) < 2 AS may, n.references_taken AND w.referred + n.reference_tokens <= n.each_limit AS may_refer FROM walk w JOIN n ON n.request = w.request AND n.k = w.k + 1) a) b) c)"""
ORACLE_SQL = {
    "rate_limit": f"""WITH RECURSIVE n AS (SELECT session_id AS caller, used_at, usage_id AS call_id, row_number() OVER (PARTITION BY session_id ORDER BY used_at, usage_id) AS k FROM usage_log),
walk AS (SELECT caller, 0::BIGINT AS k, NULL::BIGINT AS used_at, NULL::BIGINT AS call_id, true AS admitted, []::BIGINT[] AS kept FROM n WHERE k = 1
 UNION ALL SELECT n.caller, n.k, n.used_at, n.call_id, len(list_filter(w.kept, lambda t: t > n.used_at - {SECONDS})) < {LIMIT},
 CASE WHEN len(list_filter(w.kept, lambda t: t > n.used_at - {SECONDS})) < {LIMIT} THEN list_append(list_filter(w.kept, lambda t: t > n.used_at - {SECONDS}), n.used_at) ELSE w.kept END FROM walk w JOIN n ON n.caller = w.caller AND n.k = w.k + 1)
SELECT caller, used_at AS called_at, call_id, admitted FROM walk WHERE k > 0""",
    "handoff_fsm": f"""WITH RECURSIVE dated AS (SELECT s.*, t.task_id, t.checkpoint, t.expires_at FROM handoff_steps s JOIN handoff_terms t ON t.handoff_id = s.handoff_id),
n AS (SELECT d.*, c.version AS newest, row_number() OVER (PARTITION BY d.handoff_id ORDER BY seq) AS k FROM dated d ASOF LEFT JOIN task_checkpoints c ON c.task_id = d.task_id AND d.at >= c.at),
walk AS (SELECT handoff_id, 0::BIGINT AS k, NULL::BIGINT AS seq, NULL::VARCHAR AS wanted, 'draft' AS status, NULL::VARCHAR AS reason FROM n WHERE k = 1
 UNION ALL SELECT handoff_id, k, seq, wanted, CASE coalesce(reason, '') WHEN 'ttl_elapsed' THEN 'expired' WHEN 'source_state_changed' THEN 'superseded' WHEN 'conflict' THEN before ELSE wanted END, reason FROM
 (SELECT n.handoff_id, n.k, n.seq, n.wanted, s.status AS before, CASE WHEN n.wanted <> 'expired' AND s.status IN ('draft', 'ready', 'claimed', 'in_progress', 'blocked') AND n.expires_at <= n.at THEN 'ttl_elapsed'
  WHEN n.wanted IN ('claimed', 'in_progress', 'blocked') AND n.newest <> n.checkpoint THEN 'source_state_changed' WHEN {_legal} THEN NULL ELSE 'conflict' END AS reason FROM walk s JOIN n ON n.handoff_id = s.handoff_id AND n.k = s.k + 1) a)
SELECT handoff_id, seq, wanted, status, reason FROM walk WHERE k > 0""",
    "context_pack": f"WITH RECURSIVE {_PACKED} SELECT request, place, kind, disposition, tokens FROM walk WHERE k > 0",
    "context_usage": f"""WITH RECURSIVE {_PACKED}, sums AS (SELECT request, sum(CASE WHEN kind = 'skill' AND disposition IN ('inline', 'summary') THEN tokens ELSE 0 END)::BIGINT AS skill_tokens, sum(CASE WHEN kind = 'memory' AND disposition IN ('inline', 'summary') THEN tokens ELSE 0 END)::BIGINT AS retrieval_tokens,
 sum(CASE WHEN disposition = 'reference' THEN tokens ELSE 0 END)::BIGINT AS reference_tokens, sum(CASE WHEN disposition = 'omitted' THEN content_tokens ELSE 0 END)::BIGINT AS omitted_tokens FROM walk WHERE k > 0 GROUP BY request)
SELECT request, budget, mandatory_tokens, continuity AS continuity_tokens, coalesce(skill_tokens, 0) AS skill_tokens, coalesce(retrieval_tokens, 0) AS retrieval_tokens, coalesce(reference_tokens, 0) AS reference_tokens, coalesce(omitted_tokens, 0) AS omitted_tokens, budget // 10 AS reserve_tokens,
 mandatory_tokens + continuity + coalesce(skill_tokens, 0) + coalesce(retrieval_tokens, 0) + coalesce(reference_tokens, 0) AS estimated_total, compacted, mandatory_tokens > budget AS over_budget FROM r LEFT JOIN sums USING (request)""",
    "skill_budget": f"""WITH RECURSIVE n AS (SELECT project, category, id, ceil(octet_length(encode(coalesce(summary, ''))) / 4)::BIGINT AS t, row_number() OVER (PARTITION BY project, category ORDER BY id) AS k FROM memories),
walk AS (SELECT project, category, 0::BIGINT AS k, NULL::BIGINT AS id, false AS taken, 0::BIGINT AS used FROM n WHERE k = 1
 UNION ALL SELECT n.project, n.category, n.k, n.id, w.used + n.t <= {BUDGET}, CASE WHEN w.used + n.t <= {BUDGET} THEN w.used + n.t ELSE w.used END FROM walk w JOIN n ON n.project = w.project AND n.category = w.category AND n.k = w.k + 1)
SELECT project, category, id, taken FROM walk WHERE k > 0""",
    "context_allocate": """WITH RECURSIVE m AS (SELECT concat(project, '/', agent) AS request, id, category, ceil(octet_length(encode(coalesce(content, ''))) / 4)::BIGINT AS whole, ceil(octet_length(encode(coalesce(summary, ''))) / 4)::BIGINT AS brief,
 content <> summary AS shortened, lower(trim(summary)) AS words, id % 7 = 0 AS odd, row_number() OVER (PARTITION BY concat(project, '/', agent) ORDER BY accessed_at DESC, id) AS k FROM memories),
walk AS (SELECT request, 0::BIGINT AS k, NULL::BIGINT AS id, NULL::VARCHAR AS category, NULL::VARCHAR AS disposition, 0::BIGINT AS used, 0::BIGINT AS referred, []::VARCHAR[] AS seen, []::VARCHAR[] AS given FROM m WHERE k = 1
 UNION ALL SELECT request, k, id, category, d, used + CASE d WHEN 'inline' THEN whole WHEN 'summary' THEN brief ELSE 0 END, referred + CASE d WHEN 'reference' THEN brief + 20 ELSE 0 END,
 CASE WHEN d IN ('inline', 'summary') THEN list_append(seen, words) ELSE seen END, CASE WHEN d <> 'omitted' THEN list_append(given, category) ELSE given END FROM
 (SELECT *, CASE WHEN words <> '' AND list_contains(seen, words) THEN 'omitted' WHEN may AND whole <= least(180, 1800 - used) THEN 'inline' WHEN may AND shortened AND brief <= least(180, 1800 - used) THEN 'summary' WHEN referred + brief + 20 <= 600 THEN 'reference' ELSE 'omitted' END AS d FROM
 (SELECT m.request, m.k, m.id, m.category, m.whole, m.brief, m.shortened, m.words, w.used, w.referred, w.seen, w.given, NOT m.odd AND len(list_filter(w.given, lambda c: c = m.category)) < 2 AS may FROM walk w JOIN m ON m.request = w.request AND m.k = w.k + 1) a) b)
SELECT request, id, category, disposition FROM walk WHERE k > 0""",
}

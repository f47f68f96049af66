"""Retention, retries, resolution, statistics and the maintenance run; each has SQL written apart from it, from the rule."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorebase.operators import maintenance as M
from lorebase.operators import search
from lorebase.plans import pack_queries
from lorebase.sources.scratch import shared_dir
from lorebase.sources.views import NOW, view

MODEL = "model-b"


def like_v1(spark, d):
    """Memories whose text or summary holds a word; ASCII case is folded, other letters are not."""
    low = lambda c: F.translate(F.col(c), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return view(spark, d, "memories").where(low("content").contains("with") | low("summary").contains("with")).select("id")


def _uses(spark, d) -> DataFrame:
    """Uses of memories; one in a pack whose task came out well, in its session if it has one, is a success."""
    usage, packs, outcomes = (view(spark, d, v) for v in ("pack_usage", "packs", "task_outcomes"))
    well = outcomes.where("successful = 1").select("task_id", F.col("session_id").alias("_session")).distinct()
    good = packs.join(well, "task_id").where(F.col("_session").isNull() | (F.col("_session") == F.col("session_id"))).select("pack_id", F.lit(True).alias("_good")).distinct()
    return usage.join(good, "pack_id", "left").select("memory_id", "usage_type", "used_at", ((F.col("usage_type") == "used") & F.coalesce("_good", F.lit(False))).alias("successful"))


def retention_expiry(spark, d):
    return M.retention(view(spark, d, "memories"), _uses(spark, d))


def outbox_transition(spark, d):
    return M.failed_jobs(view(spark, d, "jobs").where("status = 'processing'"), NOW)


def outbox_oldest_due(spark, d):
    return M.oldest_due(view(spark, d, "jobs"), NOW)


def _facts(spark, d):
    return M.with_supersession(view(spark, d, "facts"))


def fact_resolve(spark, d):
    return M.disputes(_facts(spark, d)).select("fact_id", "entity_id", "claim_key", "wins")


def pattern_detect(spark, d):
    """The ten entities that most memories speak of, three memories at least."""
    links = view(spark, d, "memory_links")
    return links.groupBy("entity_id").agg(F.count("*").alias("mentions")).where("mentions >= 3").orderBy(F.desc("mentions"), "entity_id").limit(10)


def truth_rewrite(spark, d):
    return M.untold(view(spark, d, "entity_state")).select("id")


def stale_embeddings(spark, d):
    return M.stale(view(spark, d, "memories"), _embeddings(spark, d), MODEL).select("id", "why")


def purge(spark, d):
    """What goes with the memories that have run out for good, table by table."""
    gone = M.run_out(view(spark, d, "memories"), NOW).select(F.col("id").alias("memory_id"))
    hung = {"memories": gone} | {t: rows.join(gone, "memory_id", "left_semi") for t, rows in _dependents(spark, d).items()}
    return reduce(DataFrame.unionByName, [rows.agg(F.lit(t).alias("table_name"), F.count("*").alias("n")) for t, rows in hung.items()])


def _counted(*parts: tuple[str, DataFrame]) -> DataFrame:
    """section, kind, n."""
    return reduce(DataFrame.unionByName, [rows.select(F.lit(s).alias("section"), F.col(rows.columns[0]).cast("string").alias("kind"), F.col(rows.columns[1]).cast("long").alias("n")) for s, rows in parts])


def _by(rows: DataFrame, column: str) -> DataFrame:
    return rows.groupBy(column).agg(F.count("*").alias("n"))


def _one(rows: DataFrame, name: str, n=None) -> DataFrame:
    return rows.agg(F.lit(name).alias("kind"), (F.count("*") if n is None else n).alias("n"))


def graph_stats(spark, d):
    entities, edges = view(spark, d, "entities"), view(spark, d, "strong_edges")
    ends = edges.select(F.col("src").alias("id")).unionByName(edges.select(F.col("dst").alias("id"))).distinct()
    return _counted(
        ("entities by type", _by(entities, "kind")), ("edges by type", _by(view(spark, d, "edges"), "kind")), ("total", _one(entities, "entities")), ("total", _one(view(spark, d, "edges"), "edges")),
        ("total", _one(view(spark, d, "memory_links"), "links")), ("total", _one(entities.join(ends, "id", "left_anti"), "orphans")),
    )


def telemetry_stats(spark, d):
    usage = view(spark, d, "pack_usage")
    return _counted(
        ("usage", _by(usage, "usage_type")), ("lifecycle", _by(view(spark, d, "memories"), "lifecycle")),
        ("flags", _one(usage, "duplicate", F.count_if("duplicate"))), ("flags", _one(usage, "contradiction", F.count_if("contradiction"))),
        ("results", _one(view(spark, d, "candidates"), "selected", F.count_if("selected"))), ("results", _one(view(spark, d, "candidates"), "relevant", F.count_if("relevant"))),
    )


def v2_stats(spark, d):
    return view(spark, d, "memory_book").agg(
        F.count("*").alias("total"), F.count_if(F.col("compiled_truth") != "").alias("with_truth"), F.count_if(F.col("timeline") != "").alias("with_timeline"), F.count_if(F.col("dream_count") > 0).alias("dreamt")
    )


def skill_stats(spark, d):
    reviews, uses = view(spark, d, "skill_reviews"), view(spark, d, "skill_uses")
    return _counted(
        ("status", _by(view(spark, d, "skills"), "status")), ("total", _one(view(spark, d, "skill_drafts"), "versions")),
        *[("reviews", _one(reviews.where(F.col("decision") == x), x)) for x in ("approved", "rejected")], *[("uses", _one(uses.where(F.col("usage") == x), x)) for x in ("injected", "used")],
    )


def handoff_stats(spark, d):
    """Hand-offs by status, and the age of the oldest that waits."""
    rows = view(spark, d, "handoffs")
    waits = F.when(F.col("status").isin("draft", "ready"), F.col("created_at"))
    return _counted(("status", _by(rows, "status")), ("oldest pending", _one(rows, "seconds", F.greatest(F.lit(0), F.coalesce(NOW - F.min(waits), F.lit(0))))))


def handoff_version_status(spark, d):
    """Each version of a hand-off: superseded unless it is the newest, which has the hand-off's own status."""
    versions = view(spark, d, "handoff_versions")
    newest = versions.groupBy("handoff_id").agg(F.max("version").alias("_newest"))
    rows = versions.join(newest, "handoff_id").join(view(spark, d, "handoffs").select("handoff_id", F.col("status").alias("_status")), "handoff_id")
    return rows.select("handoff_id", "version", F.when(F.col("version") < F.col("_newest"), "superseded").otherwise(F.col("_status")).alias("status"))


def cag_stats(spark, d):
    """Deliveries by mode, cache entries by status, and deliveries that nobody answered."""
    pending = pack_queries.delivery_pending(spark, d)
    return _counted(("deliveries", _by(pack_queries.delivery_mode(spark, d), "mode")), ("cache", _by(view(spark, d, "cache_entries"), "status")), ("total", _one(pending, "feedback pending")))


def feedback_pending(spark, d):
    """Packs of which nothing was used, ignored, rejected or corrected yet."""
    told = view(spark, d, "pack_usage").where(F.col("usage_type").isin("used", "ignored", "rejected", "corrected")).select("pack_id")
    return view(spark, d, "packs").select("pack_id").join(told, "pack_id", "left_anti")


def _embeddings(spark, d):
    """Stored vectors with the digest of the text that they were made from."""
    return view(spark, d, "embedding_state").select("memory_id", "status", "model", F.sha2(F.coalesce("text_then", F.lit("")), 256).alias("content_hash"))


def _dependents(spark, d) -> dict[str, DataFrame]:
    return {"embeddings": _embeddings(spark, d).withColumn("vec", F.array().cast("array<double>")), "chunks": view(spark, d, "chunk_vectors").select("chunk_id", "memory_id", "model"), "links": view(spark, d, "memory_links"), "usage": view(spark, d, "pack_usage")}


def _tables(spark, d) -> dict[str, DataFrame]:
    return {"memories": view(spark, d, "memories"), "entities": view(spark, d, "entity_state"), "facts": _facts(spark, d), **_dependents(spark, d)}


def maintenance_run(spark, d):
    """The tables after each phase: rows that it changed, by table and change, and the rows that are left.

    The tables are copied to versioned snapshots in the shared folder, which the phases change one after another.
    A phase that fails ends the query, after the phases behind it, with an error: counts without it are no result.
    """
    tables = _tables(spark, d)
    store = M.opened(spark, f"{shared_dir(spark)}/lorebase-snapshots-{uuid.uuid4().hex}", tables)
    report = M.run(store, {
        "truth_rewrite": M.truth_rewrite, "fact_resolve": M.fact_resolve(NOW), "embed_stale": M.embed_stale(MODEL, search.hash_embedded),
        "purge": M.purge(NOW, ("embeddings", "chunks", "links", "usage")),
    })
    M.whole(report)
    changed = store.table("audit").groupBy("phase", "table_name", "change").agg(F.count("*").alias("n"))
    left = [store.table(t).agg(F.lit("after").alias("phase"), F.lit(t).alias("table_name"), F.lit("rows").alias("change"), F.count("*").alias("n")) for t in tables]
    open_facts = M.disputes(store.table("facts")).agg(F.lit("after").alias("phase"), F.lit("facts").alias("table_name"), F.lit("disputed").alias("change"), F.count("*").alias("n"))
    return reduce(DataFrame.unionByName, [changed, *left, open_facts])


QUERIES = {f.__name__: f for f in (
    like_v1, retention_expiry, outbox_transition, outbox_oldest_due, fact_resolve, pattern_detect, truth_rewrite, stale_embeddings, purge, graph_stats, telemetry_stats, v2_stats,
    skill_stats, handoff_stats, handoff_version_status, cag_stats, feedback_pending, maintenance_run,
)}

_SCD2 = """nexts AS (SELECT a.*, (SELECT min((b.observed_at, b.fact_id, b.claim_value)) FROM facts b WHERE b.entity_id = a.entity_id AND b.claim_key = a.claim_key AND (b.observed_at, b.fact_id) > (a.observed_at, a.fact_id)) AS n FROM facts a),
current_facts AS (SELECT * FROM nexts WHERE n IS NULL OR n[3] = claim_value),
disputed AS (SELECT entity_id, claim_key FROM current_facts GROUP BY ALL HAVING count(DISTINCT claim_value) > 1),
told AS (SELECT c.*, row_number() OVER (PARTITION BY entity_id, claim_key ORDER BY confidence DESC, observed_at DESC, fact_id DESC) AS place FROM current_facts c SEMI JOIN disputed USING (entity_id, claim_key))"""
_STALE = f"""stales AS (SELECT id, CASE WHEN memory_id IS NULL THEN 'missing' WHEN status IS DISTINCT FROM 'ready' THEN 'not ready' WHEN model IS DISTINCT FROM '{MODEL}' THEN 'model'
 WHEN sha256(coalesce(text_then, '')) <> sha256(coalesce(content, '')) THEN 'content' END AS why FROM memories LEFT JOIN embedding_state ON memory_id = id)"""
_GONE = f"gone AS (SELECT id FROM memories WHERE expires_at < {NOW - 72 * 3600})"
_REWRITTEN = "rewritten AS (SELECT id FROM entity_state WHERE tier = 'persist' AND timeline <> '' AND length(timeline) > length(compiled_truth) + 50 AND left(array_to_string(string_split(trim(timeline), chr(10))[1:3], ' '), 500) <> compiled_truth)"
_MODES = "sent AS (" + pack_queries.ORACLE_SQL["delivery_mode"] + ")"
_tables_after = {
    "memories": "SELECT count(*) FROM memories m WHERE id NOT IN (SELECT id FROM gone)", "entities": "SELECT count(*) FROM entity_state", "facts": "SELECT count(*) FROM facts",
    "embeddings": "SELECT count(*) FROM (SELECT memory_id FROM embedding_state UNION SELECT id FROM stales WHERE why IS NOT NULL) WHERE memory_id NOT IN (SELECT id FROM gone)",
    "chunks": "SELECT count(*) FROM chunk_vectors WHERE memory_id NOT IN (SELECT id FROM gone)", "links": "SELECT count(*) FROM memory_links WHERE memory_id NOT IN (SELECT id FROM gone)", "usage": "SELECT count(*) FROM pack_usage WHERE memory_id NOT IN (SELECT id FROM gone)",
}
_hung = {"embeddings": "(SELECT memory_id FROM embedding_state UNION SELECT id FROM stales WHERE why IS NOT NULL)", "chunks": "chunk_vectors", "links": "memory_links", "usage": "pack_usage"}

ORACLE_SQL = {
    "like_v1": "SELECT id FROM memories WHERE regexp_matches(content, '[wW][iI][tT][hH]') OR regexp_matches(summary, '[wW][iI][tT][hH]')",
    "retention_expiry": f"""WITH good AS (SELECT DISTINCT pack_id FROM packs p JOIN task_outcomes o ON o.task_id = p.task_id AND o.successful = 1 AND (o.session_id IS NULL OR o.session_id = p.session_id)),
uses AS (SELECT u.memory_id, used_at, usage_type IN ('expanded', 'used') AS reviewed, CASE WHEN usage_type = 'used' AND pack_id IN (SELECT pack_id FROM good) THEN {90 * 86400} WHEN usage_type = 'used' THEN {30 * 86400} WHEN usage_type = 'expanded' THEN {14 * 86400} WHEN usage_type = 'injected' THEN {3 * 86400} WHEN usage_type = 'selected' THEN 86400 END AS keeps FROM pack_usage u)
SELECT id, CASE WHEN lifecycle = 'pinned' THEN NULL ELSE greatest(expires_at, max(used_at + keeps)) END AS expires_at, max(CASE WHEN reviewed THEN used_at + {30 * 86400} END) AS review_at FROM memories JOIN uses ON memory_id = id GROUP BY id, lifecycle, expires_at""",
    "outbox_transition": f"""WITH delays(n, s) AS (VALUES (0, 1), (1, 1), (2, 2), (3, 4), (4, 8), (5, 16), (6, 32), (7, 64), (8, 128), (9, 256))
SELECT job_id, CASE WHEN s IS NULL THEN 'dead' ELSE 'retry' END AS status, {NOW} + s AS available_at FROM jobs LEFT JOIN delays ON n = attempts WHERE status = 'processing'""",
    "outbox_oldest_due": f"""SELECT greatest(0, {NOW} - min(due)) AS age FROM (SELECT available_at AS due FROM jobs WHERE status IN ('pending', 'retry') AND available_at <= {NOW} UNION ALL SELECT lease_until FROM jobs WHERE status = 'processing' AND lease_until <= {NOW})""",
    "fact_resolve": f"WITH {_SCD2} SELECT fact_id, entity_id, claim_key, place = 1 AS wins FROM told",
    "pattern_detect": "SELECT entity_id, count(*) AS mentions FROM memory_links GROUP BY entity_id HAVING count(*) > 2 ORDER BY mentions DESC, entity_id LIMIT 10",
    "truth_rewrite": "SELECT id FROM entity_state WHERE tier = 'persist' AND timeline <> '' AND length(timeline) - length(compiled_truth) > 50",
    "stale_embeddings": f"WITH {_STALE} SELECT * FROM stales WHERE why IS NOT NULL",
    "purge": f"WITH {_GONE} SELECT 'memories' AS table_name, count(*) AS n FROM gone " + " ".join(f"UNION ALL SELECT '{t}', count(*) FROM {s} WHERE memory_id IN (SELECT id FROM gone)" for t, s in {**_hung, "embeddings": "embedding_state"}.items()),
    "graph_stats": """SELECT 'entities by type' AS section, kind, count(*) AS n FROM entities GROUP BY kind UNION ALL SELECT 'edges by type', kind, count(*) FROM edges GROUP BY kind
UNION ALL SELECT 'total', 'entities', count(*) FROM entities UNION ALL SELECT 'total', 'edges', count(*) FROM edges UNION ALL SELECT 'total', 'links', count(*) FROM memory_links
UNION ALL SELECT 'total', 'orphans', count(*) FROM entities WHERE id NOT IN (SELECT src FROM strong_edges) AND id NOT IN (SELECT dst FROM strong_edges)""",
    "telemetry_stats": """SELECT 'usage' AS section, usage_type AS kind, count(*) AS n FROM pack_usage GROUP BY usage_type UNION ALL SELECT 'lifecycle', lifecycle, count(*) FROM memories GROUP BY lifecycle
UNION ALL SELECT 'flags', 'duplicate', sum(duplicate::INT)::BIGINT FROM pack_usage UNION ALL SELECT 'flags', 'contradiction', sum(contradiction::INT)::BIGINT FROM pack_usage
UNION ALL SELECT 'results', 'selected', sum(selected::INT)::BIGINT FROM candidates UNION ALL SELECT 'results', 'relevant', sum(relevant::INT)::BIGINT FROM candidates""",
    "v2_stats": "SELECT count(*) AS total, count(nullif(compiled_truth, '')) AS with_truth, count(nullif(timeline, '')) AS with_timeline, count(*) FILTER (dream_count > 0) AS dreamt FROM memory_book",
    "skill_stats": """SELECT 'status' AS section, status AS kind, count(*) AS n FROM skills GROUP BY status UNION ALL SELECT 'total', 'versions', count(*) FROM skill_drafts
UNION ALL SELECT 'reviews', x, (SELECT count(*) FROM skill_reviews WHERE decision = x) FROM (VALUES ('approved'), ('rejected')) t(x) UNION ALL SELECT 'uses', x, (SELECT count(*) FROM skill_uses WHERE usage = x) FROM (VALUES ('injected'), ('used')) t(x)""",
    "handoff_stats": f"SELECT 'status' AS section, status AS kind, count(*) AS n FROM handoffs GROUP BY status UNION ALL SELECT 'oldest pending', 'seconds', greatest(0, coalesce({NOW} - min(created_at), 0)) FROM handoffs WHERE status IN ('draft', 'ready')",
    "handoff_version_status": "SELECT v.handoff_id, v.version, CASE WHEN EXISTS (SELECT 1 FROM handoff_versions w WHERE w.handoff_id = v.handoff_id AND w.version > v.version) THEN 'superseded' ELSE h.status END AS status FROM handoff_versions v JOIN handoffs h ON h.handoff_id = v.handoff_id",
    "cag_stats": f"""WITH {_MODES} SELECT 'deliveries' AS section, mode AS kind, count(*) AS n FROM sent GROUP BY mode UNION ALL SELECT 'cache', status, count(*) FROM cache_entries GROUP BY status
UNION ALL SELECT 'total', 'feedback pending', count(*) FROM packs p WHERE NOT EXISTS (SELECT 1 FROM pack_usage u WHERE u.pack_id = p.pack_id AND u.usage_type NOT IN ('selected', 'injected', 'expanded'))""",
    "feedback_pending": "SELECT pack_id FROM packs EXCEPT SELECT pack_id FROM pack_usage WHERE usage_type IN ('used', 'ignored', 'rejected', 'corrected')",
    "maintenance_run": f"WITH {_SCD2}, {_STALE}, {_GONE}, {_REWRITTEN}, changes AS (SELECT 'truth_rewrite' AS phase, 'entities' AS table_name, 'truth rewritten' AS change, count(*) AS n FROM rewritten UNION ALL SELECT 'fact_resolve', 'facts', 'superseded', count(*) FROM told WHERE place > 1"
    " UNION ALL SELECT 'embed_stale', 'embeddings', 'embedded', count(*) FROM stales WHERE why IS NOT NULL UNION ALL SELECT 'purge', 'memories', 'deleted', count(*) FROM gone "
    + " ".join(f"UNION ALL SELECT 'purge', '{t}', 'deleted with its memory', count(*) FROM {s} WHERE memory_id IN (SELECT id FROM gone)" for t, s in _hung.items())
    + ") SELECT * FROM changes WHERE n > 0 "
    + " ".join(f"UNION ALL SELECT 'after', '{t}', 'rows', ({q})" for t, q in _tables_after.items())
    + " UNION ALL SELECT 'after', 'facts', 'disputed', 0",
}

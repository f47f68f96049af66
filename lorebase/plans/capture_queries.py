"""Gates, capture, chunking, ingestion and the maintenance run; SQL is written from the rules, apart from the plans."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lorebase.functions import gates
from lorebase.operators import capture as C
from lorebase.operators import fold, lifecycle, search
from lorebase.plans import textbook
from lorebase.plans.dialect import spelled
from lorebase.sources.scratch import materialize, shared_dir
from lorebase.sources.views import NOW, run_sql, view
from lorebase.streaming import ingest

MODEL = "model-b"


def gate_heuristic(spark, d):
    return view(spark, d, "utterances").select("id", "part", gates.rules(F.col("text")).alias("g")).select("id", "part", "g.decision", "g.confidence")


def gate_parse(spark, d):
    return view(spark, d, "model_answers").select("id", gates.from_answer(F.col("answer"))["decision"].alias("decision"))


def _scores():
    return {k: F.col(f"{k.lower()}_score") for k in gates.LABELS}


def gate_softmax(spark, d):
    g = view(spark, d, "model_answers").select("id", gates.from_scores(_scores()).alias("g"))
    return g.select("id", "g.decision", F.round("g.confidence", 6).alias("confidence"))


def gate_chain(spark, d):
    asked = {"answer": gates.GATES["answer"](F.col("answer")), "scores": gates.GATES["scores"](_scores()), "rules": gates.GATES["rules"](F.col("text"))}
    g = view(spark, d, "model_answers").select("id", gates.chain(asked).alias("g"))
    return g.select("id", "g.decision", F.round("g.confidence", 6).alias("confidence"), "g.backend", "g.fell_back")


def gate_summary(spark, d):
    """Answers of the chain by gate: how many, how sure, and the shares that fell back and that were skipped."""
    share = lambda c: F.round(F.count_if(c) / F.greatest(F.count("*"), F.lit(1)), 3)
    return gate_chain(spark, d).groupBy("backend").agg(
        F.count("*").alias("n"), F.round(F.avg("confidence"), 6).alias("mean"), share(F.col("fell_back")).alias("fallback_rate"), share(F.col("decision") == "SKIP").alias("skip_rate")
    )


def validate_enums(spark, d):
    e = view(spark, d, "extractions")
    return e.select("id", gates.valid(F.col("category"), gates.CATEGORIES, "project").alias("category"), gates.valid(F.col("tier"), gates.TIERS, "active").alias("tier"))


def stub_extract(spark, d):
    m = view(spark, d, "memories").select("id", gates.EXTRACTORS["first_lines"](F.col("content"), gates.rules(F.col("content"))["decision"]).alias("e"))
    return m.select("id", "e.*")


def capture_pipeline(spark, d):
    notes = view(spark, d, "notes").join(view(spark, d, "captures"), "id")
    return C.capture(notes, view(spark, d, "registry"))


def chunk_text(spark, d):
    return fold.chunks(view(spark, d, "memories"))


def _unchunked(spark, d):
    """Memories without a chunk of the current model."""
    own = view(spark, d, "chunk_vectors").where(F.col("model") == MODEL).select(F.col("memory_id").alias("id")).distinct()
    return view(spark, d, "memories").join(own, "id", "left_anti")


def chunk_backfill(spark, d):
    """Chunks and vectors for the newest hundred memories that have none of the current model."""
    newest = _unchunked(spark, d).orderBy(F.desc("created_at"), "id").limit(100).select("id", "content")
    pieces = fold.chunks(newest)
    vectors = search.hash_embedded(pieces.select(F.struct("id", "chunk_index").alias("id"), F.col("chunk").alias("content")))
    return pieces.join(vectors.select("id.id", "id.chunk_index", F.size("vec").alias("dims")), ["id", "chunk_index"]).groupBy("id").agg(
        F.count("*").alias("n_chunks"), F.sum(F.length("chunk")).alias("n_chars"), F.min("dims").alias("dims")
    )


def _phases(spark, d):
    sql = lambda text: lambda: run_sql(spark, d, text)
    return {
        "entity_sweep": lambda: C.entities(view(spark, d, "notes"), view(spark, d, "registry")),
        "backlink_audit": sql("SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F'"),
        "truth_rewrite": sql("SELECT id FROM memories WHERE tier = 'persist' AND length(content) > length(summary) + 50"),
        "pattern_detect": sql("SELECT category, project FROM memories GROUP BY category, project HAVING count(*) >= 3"),
        "fact_resolve": lambda: lifecycle.supersession(view(spark, d, "facts")).where("superseded_at IS NULL").groupBy("entity_id", "claim_key").agg(F.count_distinct("claim_value").alias("n")).where("n > 1"),
        "orphan_detect": sql("SELECT e.id FROM entities e LEFT JOIN edges a ON a.src = e.id LEFT JOIN edges b ON b.dst = e.id WHERE a.src IS NULL AND b.dst IS NULL"),
        "embed_stale": sql(f"SELECT memory_id FROM stored_embeddings WHERE status <> 'ready' OR model <> '{MODEL}'"),
        "chunk_backfill": lambda: _unchunked(spark, d),
        "purge": sql(f"SELECT id FROM memories WHERE expires_at < {NOW} - 72 * 3600"),
    }


def dream_report(spark, d):
    """The maintenance run: rows found by each phase, and their sum."""
    rows = C.maintenance(_phases(spark, d), dry_run=True)
    report = spark.createDataFrame(rows, "place int, phase string, status string, found long, changed boolean")
    total = report.agg(F.lit(0).alias("place"), F.lit("total").alias("phase"), F.when(F.count_if(F.col("status") != "ok") > 0, "partial").otherwise("ok").alias("status"), F.sum("found").alias("found"), F.lit(False).alias("changed"))
    return report.unionByName(total)


def stream_ingest(spark, d):
    """Conversation turns as a stream of JSON lines, all sent twice; events accepted once, and a dead letter for each bad line.

    Times run against the order of the files, over days, and a batch takes two files: late events must stay, and a line
    that comes again batches later must go.  The lines, the sink and the checkpoint lie in the shared folder; a repeated run takes new ones.
    """
    turns = spark.read.parquet(f"{d}/conversations.parquet")
    line = F.to_json(F.struct(F.col("text").alias("content"), F.col("role").alias("agent"), F.col("conv_id").cast("string").alias("session"), "turn", F.date_format(F.timestamp_seconds(NOW - F.pmod(F.hash("conv_id", "turn"), F.lit(40)) * 3600), "yyyy-MM-dd'T'HH:mm:ss").alias("ts")))
    sent = materialize(turns.select(line.alias("value")).unionByName(turns.select(line.alias("value"))).unionByName(spark.range(1).select(F.lit("not json").alias("value"))), "stream-lines")
    folder = f"{shared_dir(spark)}/lorebase-stream-{uuid.uuid4().hex}"
    sent.repartition(4, F.rand(1)).write.text(f"{folder}/in")
    for start, state in ((ingest.ingest, "state"), (ingest.dead_letters, "dead-state")):
        start(spark, f"{folder}/in", f"{folder}/out", f"{folder}/{state}", files=2).awaitTermination()
    good = spark.read.parquet(f"{folder}/out/events").select("session", "turn", F.col("gate.decision").alias("decision"), F.lit(None).cast("string").alias("reason"))
    dead = spark.read.parquet(f"{folder}/out/dead").select(F.lit(None).cast("string").alias("session"), F.lit(None).cast("long").alias("turn"), F.lit("DEAD").alias("decision"), "reason")
    return good.unionByName(dead)


def delivery_retry(spark, d):
    """What becomes of each delivery that failed: its next try, or a dead letter after the tenth."""
    rows = view(spark, d, "deliveries").where("failed")
    return rows.select("event_id", *ingest.redelivery(F.col("delivered"), F.col("at")))


QUERIES = {f.__name__: f for f in (
    gate_heuristic, gate_parse, gate_softmax, gate_chain, gate_summary, validate_enums, stub_extract, capture_pipeline, chunk_text, chunk_backfill, dream_report, stream_ingest, delivery_retry,
)}

_q = lambda x: x.replace("'", "''")
_trimmed = "regexp_replace(lower({0}), '^[ \\t\\n\\x0b\\f\\r]+|[ \\t\\n\\x0b\\f\\r]+$', '', 'g')"


def _rules(text: str) -> tuple[str, str]:
    """Decision and confidence of a text by rules, as CASE expressions."""
    low = _trimmed.format(text)
    word = lambda words: f"regexp_matches({low}, '(^|[^\\p{{L}}\\p{{N}}_])({_q('|'.join(words))})([^\\p{{L}}\\p{{N}}_]|$)')"
    tests = [
        f"{low} IN ({', '.join(repr(w) for w in gates.SKIP_REPLIES)}) OR (length({low}) BETWEEN 1 AND 5 AND instr({low}, chr(10)) = 0)",
        word(gates.PERSIST),
        word(gates.ACTIVE) + f" OR regexp_matches({low}, '[\\p{{L}}\\p{{N}}_] build([^\\p{{L}}\\p{{N}}_]|$)')",
        f"regexp_matches({low}, '\\?$') OR regexp_matches({low}, '^({'|'.join(gates.COLD_START)})([^\\p{{L}}\\p{{N}}_]|$)')",
        f"length({text}) < 20", f"length({text}) < 50", "true",
    ]
    case = lambda values: "CASE " + " ".join(f"WHEN {t} THEN {v}" for t, v in zip(tests, values, strict=True)) + " END"
    return case(["'SKIP'", "'PERSIST'", "'ACTIVE'", "'COLD'", "'SKIP'", "'COLD'", "'ACTIVE'"]), case([f"{x}e0" for x in (0.85, 0.75, 0.7, 0.65, 0.6, 0.55, 0.6)])


_parsed = "CASE WHEN answer IS NULL THEN NULL WHEN upper(answer) LIKE '%SKIP%' THEN 'SKIP' WHEN upper(answer) LIKE '%COLD%' THEN 'COLD' WHEN upper(answer) LIKE '%ACTIVE%' THEN 'ACTIVE' WHEN upper(answer) LIKE '%PERSIST%' THEN 'PERSIST' ELSE 'COLD' END"
_SOFT = """chances AS (SELECT *, exp(skip_score) / total AS s, exp(cold_score) / total AS c, exp(active_score) / total AS a, exp(persist_score) / total AS p FROM
 (SELECT *, exp(skip_score) + exp(cold_score) + exp(active_score) + exp(persist_score) AS total FROM model_answers)),
soft AS (SELECT id, answer, text, CASE WHEN s IS NULL THEN NULL WHEN s >= greatest(c, a, p) AND s >= 0.7 THEN 'SKIP' WHEN c >= a AND c >= p THEN 'COLD' WHEN a >= p THEN 'ACTIVE' ELSE 'PERSIST' END AS decision,
 CASE WHEN s IS NULL THEN NULL WHEN s >= greatest(c, a, p) AND s >= 0.7 THEN round(s, 6) ELSE round(greatest(c, a, p), 6) END AS confidence FROM chances)"""
_d, _c = _rules("text")
_CHAIN = f"""{_SOFT}, chained AS (SELECT id, coalesce({_parsed}, decision, {_d}) AS decision, CASE WHEN answer IS NOT NULL THEN 0.95e0 WHEN decision IS NOT NULL THEN confidence ELSE {_c} END AS confidence,
 CASE WHEN answer IS NOT NULL THEN 'answer' WHEN decision IS NOT NULL THEN 'scores' ELSE 'rules' END AS backend, answer IS NULL AS fell_back FROM soft)"""
_nd, _nc = _rules("note")
_md, _ = _rules("content")
_cd, _ = _rules("text")
_ents = spelled(f"SELECT DISTINCT t.id, r.entity_id FROM ({textbook._tokens}) t JOIN registry r ON r.name = t.w", 2)
_phase = {
    "entity_sweep": _ents,
    "backlink_audit": spelled(textbook.BOOK["backlink_audit"], 2),
    "truth_rewrite": "SELECT id FROM memories WHERE tier = 'persist' AND length(content) - length(summary) > 50",
    "pattern_detect": "SELECT DISTINCT category, project FROM (SELECT category, project, row_number() OVER (PARTITION BY category, project ORDER BY id) AS k FROM memories) p WHERE k = 3",
    "fact_resolve": "SELECT entity_id, claim_key FROM (SELECT *, lead(claim_value) OVER (PARTITION BY entity_id, claim_key ORDER BY observed_at, fact_id) AS nxt FROM facts) f WHERE nxt IS NULL OR nxt = claim_value GROUP BY entity_id, claim_key HAVING min(claim_value) <> max(claim_value)",
    "orphan_detect": "SELECT id FROM entities WHERE id NOT IN (SELECT src FROM edges) AND id NOT IN (SELECT dst FROM edges)",
    "embed_stale": f"SELECT memory_id FROM stored_embeddings WHERE NOT (status = 'ready' AND model = '{MODEL}')",
    "chunk_backfill": f"SELECT id FROM memories WHERE id NOT IN (SELECT memory_id FROM chunk_vectors WHERE model = '{MODEL}')",
    "purge": f"SELECT id FROM memories WHERE {NOW} - expires_at > 259200",
}

ORACLE_SQL = {
    "gate_heuristic": f"SELECT id, part, {_d} AS decision, {_c} AS confidence FROM utterances",
    "gate_parse": f"SELECT id, {_parsed} AS decision FROM model_answers",
    "gate_softmax": f"WITH {_SOFT} SELECT id, decision, confidence FROM soft",
    "gate_chain": f"WITH {_CHAIN} SELECT * FROM chained",
    "gate_summary": f"WITH {_CHAIN} SELECT backend, count(*) AS n, round(avg(confidence), 6) AS mean, round(avg(CASE WHEN fell_back THEN 1e0 ELSE 0e0 END), 3) AS fallback_rate, round(avg(CASE WHEN decision = 'SKIP' THEN 1e0 ELSE 0e0 END), 3) AS skip_rate FROM chained GROUP BY backend",
    "validate_enums": "SELECT id, CASE WHEN list_contains(['project', 'person', 'preference', 'decision', 'task', 'strategy', 'session'], lower(category)) THEN lower(category) ELSE 'project' END AS category, CASE WHEN list_contains(['cold', 'active', 'persist'], lower(tier)) THEN lower(tier) ELSE 'active' END AS tier FROM extractions",
    "stub_extract": f"SELECT id, content[:200] AS summary, 'project' AS category, CASE WHEN g = 'SKIP' THEN 'active' ELSE lower(g) END AS tier FROM (SELECT id, content, {_md} AS g FROM memories) q",
    "capture_pipeline": f"""WITH judged AS (SELECT id, note, {_nd} AS decision, {_nc} AS confidence FROM notes), e AS (SELECT id, count(*) AS n FROM ({_ents}) x GROUP BY id),
f AS (SELECT id, count(*) AS n FROM ({spelled(textbook.BOOK['fact_extract'], 2)}) y GROUP BY id)
SELECT j.id, decision, confidence, 'rules' AS backend, CASE WHEN decision <> 'SKIP' THEN coalesce(requested_category, 'project') END AS category, CASE WHEN decision <> 'SKIP' THEN coalesce(requested_tier, lower(decision)) END AS tier,
 CASE WHEN decision <> 'SKIP' THEN note[:200] END AS summary, CASE WHEN decision = 'SKIP' THEN 0 ELSE coalesce(e.n, 0) END AS n_entities,
 CASE WHEN decision = 'SKIP' THEN 0 ELSE least(coalesce(e.n, 0), 10) * (least(coalesce(e.n, 0), 10) - 1) // 2 END AS edges_created, CASE WHEN decision = 'SKIP' THEN 0 ELSE coalesce(f.n, 0) END AS facts_created,
 CASE WHEN decision = 'SKIP' THEN 'skipped' ELSE 'complete' END AS status FROM judged j JOIN captures c ON c.id = j.id LEFT JOIN e ON e.id = j.id LEFT JOIN f ON f.id = j.id""",
    "dream_report": "WITH n AS (" + " UNION ALL ".join(f"SELECT {i} AS place, '{k}' AS phase, (SELECT count(*) FROM ({v}) p{i}) AS found" for i, (k, v) in enumerate(_phase.items(), start=1)) + ") SELECT place, phase, 'ok' AS status, found, false AS changed FROM n UNION ALL SELECT 0, 'total', 'ok', sum(found)::BIGINT, false FROM n",
    "stream_ingest": f"""WITH turns AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations) SELECT conv_id::VARCHAR AS session, turn, {_cd} AS decision, NULL AS reason FROM turns WHERE trim(text) <> ''
UNION ALL SELECT NULL, NULL, 'DEAD', 'content must be a non-empty string' FROM conversations, range(2) WHERE coalesce(trim(text), '') = '' UNION ALL SELECT NULL, NULL, 'DEAD', 'payload must be an object'""",
    "delivery_retry": f"SELECT event_id, CASE WHEN delivered < 10 THEN {NOW} + CASE delivered WHEN 1 THEN 2 WHEN 2 THEN 4 WHEN 3 THEN 8 WHEN 4 THEN 16 WHEN 5 THEN 32 WHEN 6 THEN 64 WHEN 7 THEN 128 ELSE 256 END END AS next_try, delivered >= 10 AS dead FROM deliveries WHERE failed",
}

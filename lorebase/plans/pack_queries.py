"""Queries on packs, deliveries, skills, hand-offs and imports; each has SQL written from its rule, apart from the plan."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lorebase.functions import text as T
from lorebase.operators import lifecycle
from lorebase.operators import packs as P
from lorebase.sources.views import NOW, view

REPOSITORY, POLICY, OBJECTIVE = "Brand#3", "context-v2", "red large steel work of a kind"
K = 3


def shadow_rank(spark, d):
    return P.shadow(view(spark, d, "candidates")).select("run_id", "memory_id", "prod_place", "prod", "shadow", "delta", "move")


def shadow_report(spark, d):
    """Where both ranks put each memory, with its tier and lifecycle, and moves counted."""
    ranks = P.shadow(view(spark, d, "candidates")).join(view(spark, d, "memories").select(F.col("id").alias("memory_id"), "tier", "lifecycle"), "memory_id")
    return ranks.groupBy("tier", "lifecycle", "move").agg(F.count("*").alias("n"), F.sum("delta").alias("delta"))


def utility_rerank(spark, d):
    return P.reranked(view(spark, d, "candidates"), 0.1).select("run_id", "memory_id", "prod_place", F.col("final"), "place")


def retrieval_log(spark, d):
    """Every candidate with its place; the same run logged again with other ids is a conflict."""
    c = view(spark, d, "candidates")
    ids = F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("prod_place", "memory_id"))), lambda x: x["memory_id"].cast("string")), ","), 256)
    return c.groupBy("run_id").agg(F.count("*").alias("n"), ids.alias("ids_digest"))


def ir_metrics(spark, d):
    q = P.quality(P.shadow(view(spark, d, "candidates")), K, "prod")
    mean = lambda c: F.round(F.avg(c), 6).alias(c)
    return q.agg(mean("precision"), mean("recall"), mean("reciprocal_rank"), mean("selection_rate"), F.sum("leaked").alias("leaked"))


def pack_consistency(spark, d):
    """Packs whose delivered items are not the selected ones of their run."""
    items = view(spark, d, "pack_items").where("disposition <> 'omitted'").select("pack_id", "memory_id")
    chosen = view(spark, d, "candidates").where("selected").select(F.col("run_id").alias("pack_id"), "memory_id")
    return P.differing(items, chosen, "pack_id", "memory_id")


def _skills(spark, d):
    skills = view(spark, d, "skills")
    status = P.skill_status(skills, view(spark, d, "skill_reviews"), view(spark, d, "agents"))
    stale = P.stale_skills(view(spark, d, "skill_sources"), view(spark, d, "source_now"))
    return skills, status, stale


def review_status(spark, d):
    return _skills(spark, d)[1]


def skill_stale(spark, d):
    return _skills(spark, d)[2]


def skill_eligible(spark, d):
    return P.usable(*_skills(spark, d), REPOSITORY).select("skill_id", "repository")


def skill_versions(spark, d):
    return P.skill_versions(view(spark, d, "skill_drafts"))


def skill_rank(spark, d):
    """Skills of a repository or of none by repository, terms of the objective in their text, successful uses and id, all falling."""
    uses = view(spark, d, "skill_uses").groupBy("skill_id").agg(F.count_if(F.col("usage") == "used").alias("uses"))
    hay = F.lower(F.concat_ws(" ", "name", "kind"))
    terms = sorted({t for t in OBJECTIVE.split() if len(t) > 2})
    overlap = sum((F.contains(hay, F.lit(t)).cast("int") for t in terms[1:]), F.contains(hay, F.lit(terms[0])).cast("int"))
    rows = view(spark, d, "skills").where(F.col("repository").isNull() | (F.col("repository") == REPOSITORY)).join(uses, "skill_id", "left")
    rows = rows.select("skill_id", F.col("repository").isNotNull().cast("int").alias("here"), overlap.alias("overlap"), F.coalesce("uses", F.lit(0)).alias("uses"))
    return P.ranked(rows, [F.desc(c) for c in ("here", "overlap", "uses", "skill_id")])


def client_skill_state(spark, d):
    skills, status, stale = _skills(spark, d)
    versions = P.skill_versions(view(spark, d, "skill_drafts")).groupBy("skill_id").agg(F.max("version").alias("version"))
    offered = P.usable(skills, status, stale, REPOSITORY).select("skill_id").join(versions, "skill_id")
    known = view(spark, d, "client_skills")
    clients = view(spark, d, "client_offers").join(offered, "skill_id")
    in_use = skills.where(~F.col("status").isin(*P.UNUSABLE)).select("skill_id")
    return P.client_copies(clients.select("client_id", "skill_id", "version"), known, in_use)


def cache_key(spark, d):
    """Digest of all that a delivery depends on: policy, task, session, objective and budget; what clients can do is left out."""
    p = view(spark, d, "packs").join(view(spark, d, "tasks").select("task_id", "objective", "repository"), "task_id")
    return p.select("pack_id", F.concat(F.lit("sha256:"), T.stable_digest(
        policy=F.col("policy"), task=F.col("task_id"), session=F.coalesce(F.col("session_id").cast("string"), F.lit("none")), objective=F.col("objective"), repository=F.col("repository"), max_tokens=F.lit(4000),
    )).alias("cache_key"))


def cache_validity(spark, d):
    return P.cache_validity(view(spark, d, "cache_entries"), view(spark, d, "cache_dependencies"), view(spark, d, "source_now"), POLICY, NOW)


def cache_typed_validity(spark, d):
    """Whether cached packs still hold, over all kinds of sources that they depend on."""
    return P.typed_validity(view(spark, d, "cache_entries"), view(spark, d, "dependency_log"), view(spark, d, "dependency_now"), POLICY, NOW)


def _sections(spark, d):
    """Places of each pack and of the pack that its task had before."""
    order = Window.partitionBy("task_id").orderBy("pack_id")
    packs = view(spark, d, "packs").select("pack_id", F.lead("pack_id").over(order).alias("next_id"))
    return P.sections(packs, view(spark, d, "pack_items"))


def context_delta(spark, d):
    return P.section_delta(_sections(spark, d))


def _delivered(spark, d, *more):
    """Mode and sizes of each delivery, and aggregates of its sections as asked for."""
    new = ~F.coalesce(F.col("item") == F.col("old"), F.lit(False))
    sums = _sections(spark, d).groupBy("request_id").agg(
        F.sum("tokens").alias("full_tokens"), (F.coalesce(F.sum(F.when(new, F.col("tokens"))), F.lit(0)) + 5).alias("delta_tokens"), F.count_if("here").alias("n"),
        F.count_if(F.col("old").isNull() | F.col("item").isNull() | (F.col("item") != F.col("old"))).alias("changes"), *more,
    )
    refresh = cache_validity(spark, d).select(F.col("entry_id").alias("request_id"), F.coalesce((F.col("reason") == "policy_changed").cast("int"), F.lit(0)).alias("refresh"))
    return sums.where("n > 0").join(view(spark, d, "client_states"), "request_id").join(refresh, "request_id")


def delivery_mode(spark, d):
    return P.delivery_mode(_delivered(spark, d))


def render_delivery(spark, d):
    """What a client is sent: the pack, bullets of what changed, a list to fetch anew, or nothing."""
    line = lambda x: F.concat(F.lit("- "), x["place"].cast("string"), F.lit(": "), x["item"].cast("string"))
    entry, new = F.struct("place", "item"), ~F.coalesce(F.col("item") == F.col("old"), F.lit(False))
    rows = P.delivery_mode(_delivered(spark, d, F.sort_array(F.collect_list(F.when(F.col("here"), entry))).alias("all"), F.sort_array(F.collect_list(F.when(F.col("here") & new, entry))).alias("new")), "all", "new")
    text = lambda c: F.array_join(F.transform(c, line), "\n")
    body = F.when(F.col("mode") == "no_change", "").when(F.col("mode") == "refresh_required", F.concat(F.lit("refresh: "), F.size("all").cast("string"))).when(F.col("mode") == "delta", text("new")).otherwise(text("all"))
    return rows.select("request_id", "mode", body.alias("body"))


def delivery_pending(spark, d):
    """Packs that no usage has come back for."""
    done = view(spark, d, "pack_usage").where("usage_type IN ('used', 'ignored', 'rejected', 'corrected')").select("pack_id")
    return view(spark, d, "packs").join(done, "pack_id", "left_anti").select("pack_id", "task_id")


def resolve_event_source(spark, d):
    """Usage events by the task and session of their pack, for tasks of one repository."""
    t = view(spark, d, "tasks").where("repository = 'BUILDING'").select("task_id", "owner_id")
    return view(spark, d, "pack_usage").join(view(spark, d, "packs").select("pack_id", "task_id", "session_id"), "pack_id").join(t, "task_id").select("pack_id", "memory_id", "usage_type", "used_at", "task_id", "session_id", "owner_id")


def handoff_build(spark, d):
    """One current hand-off for each task and target; earlier versions are superseded."""
    own = Window.partitionBy("task_id", "target_agent")
    h = view(spark, d, "handoffs").withColumn("version", F.row_number().over(own.orderBy("handoff_id")))
    return h.select("handoff_id", "task_id", "target_agent", "version", F.when(F.col("version") < F.max("version").over(own), "superseded").otherwise(F.col("status")).alias("status"))


def handoff_visible(spark, d):
    me = F.lit(7)
    return view(spark, d, "handoffs").where((F.col("source_agent") == me) | (F.col("target_agent") == me) | (F.col("requester") == me)).select("handoff_id", "status")


def trust_provenance(spark, d):
    s = view(spark, d, "sources").join(view(spark, d, "agents").select("agent_id", "trust_level"), "agent_id", "left")
    found = P.authority(F.concat("kind", "url"), F.col("trust_level"), F.col("agent_id") == 3)
    return s.select("source_id", found.alias("t"), F.coalesce("trust_level", F.lit("standard")).alias("source_trust_level")).select("source_id", "t.*", "source_trust_level")


def validation_requests(spark, d):
    """What someone should look at: open decisions, rejected uses, external sources, facts that contradict one another."""
    m, u = view(spark, d, "memories"), view(spark, d, "pack_usage")
    facts = lifecycle.supersession(view(spark, d, "facts")).where("superseded_at IS NULL")
    split = facts.groupBy("entity_id", "claim_key").agg(F.count_distinct("claim_value").alias("n")).where("n > 1")
    row = lambda df, kind, key: df.select(F.lit(kind).alias("kind"), F.col(key).cast("long").alias("id"))
    return (
        row(m.where("category = 'decision' AND lifecycle = 'active'"), "decision", "id")
        .unionByName(row(u.where("usage_type = 'rejected'"), "event", "pack_id"))
        .unionByName(row(trust_provenance(spark, d).where("verification = 'unverified' AND source_type = 'external'"), "external", "source_id"))
        .unionByName(row(facts.join(split, ["entity_id", "claim_key"], "left_semi"), "contradiction", "fact_id"))
    )


def import_plan(spark, d):
    """Verdicts with rows, bytes and the range of dates."""
    present = view(spark, d, "stored_embeddings").where("status = 'pending'").select(F.col("memory_id").alias("id"))
    plan = P.import_plan(view(spark, d, "memories"), present, 1706745600)
    return plan.groupBy("verdict").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"), F.min("created_at").alias("earliest"), F.max("created_at").alias("latest"))


def dedup_exact(spark, d):
    """First memory of each text, and whether its first 120 characters stand in an earlier one."""
    plan = P.import_plan(view(spark, d, "memories"), view(spark, d, "memories").where("id < 0"), 0)
    return plan.where("verdict IN ('import', 'near_duplicate')").select("id", (F.col("verdict") == "near_duplicate").alias("near"))


def legacy_source(spark, d):
    """A foreign table: the wanted columns that it has."""
    old = spark.read.parquet(f"{d}/conversations.parquet")
    return P.conformed(old, ["conv_id", "turn", "text", "summary", "agent"], ["conv_id", "text"])


def upsert_conflicts(spark, d):
    return P.replays(view(spark, d, "arrivals"), view(spark, d, "memories"), "id", ["content", "agent"])


def idempotency_classify(spark, d):
    """Outcomes that came before: the same task and result again is a replay, another result a conflict."""
    o = view(spark, d, "task_outcomes").withColumnRenamed("task_id", "k")
    first = o.groupBy("k").agg(F.min_by(F.struct("successful", "corrections", "rework"), "outcome_id").alias("f")).select("k", "f.*")
    return P.replays(o, first, "k", ["successful", "corrections", "rework"])


def apply_enrichment(spark, d):
    """Categories and tiers from the extractor; pinned memories keep their lifecycle."""
    e = view(spark, d, "extractions").select("id", F.col("category").alias("_c"), F.col("tier").alias("_t"))
    m = view(spark, d, "memories").join(e, "id", "left")
    tier = F.when(F.lower("_t").isin("cold", "active", "persist"), F.lower("_t")).otherwise(F.col("tier"))
    life = F.when(F.col("lifecycle") == "pinned", "pinned").when(F.col("_t").isNull(), F.col("lifecycle")).when(tier == "cold", "ephemeral").when(tier == "persist", "stable").otherwise("active")
    return m.select("id", F.lower(F.coalesce("_c", "category")).alias("category"), tier.alias("tier"), life.alias("lifecycle"))


def delete_cascade(spark, d):
    """Rows that stay in each table when the archived memories are deleted."""
    gone = view(spark, d, "memories").where("lifecycle = 'archived'").select(F.col("id").alias("memory_id"))
    tables = ("usage_log", "pack_items", "chunk_vectors", "stored_embeddings", "lifecycle_log")
    out = None
    for t in tables:
        kept = view(spark, d, t).join(gone, "memory_id", "left_anti").groupBy("memory_id").agg(F.count("*").alias("left_rows")).withColumn("relation", F.lit(t))
        out = kept if out is None else out.unionByName(kept)
    return out


def eligible_degraded(spark, d):
    """Eligibility in a store that has no lifecycle yet."""
    m = view(spark, d, "memories").drop("lifecycle")
    return m.select("id", lifecycle.eligible(m, NOW).alias("eligible"))


def scope_formal(spark, d):
    """Memories of a scope; keys that are not given do not count."""
    scope = {"project": "p1", "agent": None, "category": "task"}
    m = view(spark, d, "memories")
    for k, v in scope.items():
        m = m if v is None else m.where(F.col(k) == v)
    return m.select("id")


def orphan_entities(spark, d):
    """Entities that no strong edge touches."""
    e, x = view(spark, d, "entities"), view(spark, d, "strong_edges")
    return e.join(x.select(F.col("src").alias("id")), "id", "left_anti").join(x.select(F.col("dst").alias("id")), "id", "left_anti").select("id")


def claim_jobs(spark, d):
    """Jobs that a worker may take now: due ones, and those whose lease has run out; oldest first, with the lease it gets."""
    due = (F.col("status").isin("pending", "retry") & (F.col("available_at") <= NOW)) | ((F.col("status") == "processing") & (F.col("lease_until") <= NOW))
    e = view(spark, d, "incoming").select(F.col("event_id").alias("job_id"), "event_type")
    return view(spark, d, "jobs").where(due).join(e, "job_id").select("job_id", "event_type", (F.col("status") == "processing").alias("reclaimed"), (F.col("attempts") + 1).alias("attempts"), F.lit(NOW + 60).alias("lease_until"))


def edge_upsert(spark, d):
    """Edges by kind after ignoring repeats and refusing unknown kinds; every attempt at a known kind counts as created."""
    known = ("t0", "t1", "t2", "t3")
    tries = view(spark, d, "edge_attempts")
    return tries.groupBy("src", "kind").agg(F.count_distinct("dst").alias("stored"), F.count("*").alias("attempted")).select(
        "src", "kind", F.when(F.col("kind").isin(*known), F.col("stored")).otherwise(0).alias("stored"), F.when(F.col("kind").isin(*known), F.col("attempted")).otherwise(0).alias("created")
    )


def entity_delete(spark, d):
    """What is left of each relation when an entity is deleted with its edges and facts."""
    gone = "s7"
    left = view(spark, d, "edges").where((F.col("src") != gone) & (F.col("dst") != gone)).groupBy(F.lit("edges").alias("relation")).agg(F.count("*").alias("n"))
    entities = view(spark, d, "entities").where(F.col("id") != gone).groupBy(F.lit("entities").alias("relation")).agg(F.count("*").alias("n"))
    facts = view(spark, d, "facts").where(F.concat(F.lit("s"), F.col("entity_id").cast("string")) != gone).groupBy(F.lit("facts").alias("relation")).agg(F.count("*").alias("n"))
    return left.unionByName(entities).unionByName(facts)


def unknown_sections(spark, d):
    """Dispositions of a pack that the policy does not know."""
    packs = view(spark, d, "pack_items").groupBy("pack_id").agg(F.collect_set("disposition").alias("given"))
    return packs.select("pack_id", F.array_join(T.unknown(F.col("given"), ("inline", "reference")), ",").alias("unknown"))


def as_text(spark, d):
    """Text of values that are objects or plain."""
    c = spark.read.parquet(f"{d}/conversations.parquet").where("text IS NOT NULL")
    value = F.when(F.col("role") == "user", F.to_json(F.struct(F.lit(" ").alias("text"), F.col("text").alias("summary")))).otherwise(F.col("text"))
    return c.select("conv_id", "turn", "role", F.length(T.as_text(value)).alias("n_chars"))


QUERIES = {f.__name__: f for f in (
    shadow_rank, shadow_report, utility_rerank, retrieval_log, ir_metrics, pack_consistency, review_status, skill_stale, skill_eligible, skill_versions, skill_rank, client_skill_state,
    cache_key, cache_validity, cache_typed_validity, context_delta, delivery_mode, render_delivery, delivery_pending, resolve_event_source, handoff_build, handoff_visible, trust_provenance, validation_requests,
    import_plan, dedup_exact, legacy_source, upsert_conflicts, idempotency_classify, apply_enrichment, delete_cascade, eligible_degraded, scope_formal, orphan_entities, claim_jobs,
    edge_upsert, entity_delete, unknown_sections, as_text,
)}

_SHADOW = """prods AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY score DESC, prod_place) AS prod FROM candidates),
shadows AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY 0.9e0 * score + 0.1e0 * utility DESC, prod) AS shadow FROM prods),
moves AS (SELECT *, prod - shadow AS delta, CASE sign(prod - shadow) WHEN 1 THEN 'promote' WHEN -1 THEN 'demote' ELSE 'unchanged' END AS move FROM shadows)"""
_STATUS = """heard AS (SELECT r.*, row_number() OVER (PARTITION BY r.skill_id ORDER BY review_id) AS k FROM skill_reviews r JOIN skills s ON s.skill_id = r.skill_id LEFT JOIN agents a ON a.agent_id = r.reviewer_id WHERE r.reviewer_id = s.owner_id OR a.trust_level = 'trusted'),
ends AS (SELECT skill_id, min(k) AS k FROM heard WHERE decision IN ('approved', 'rejected') GROUP BY skill_id),
counted AS (SELECT h.* FROM heard h LEFT JOIN ends e ON e.skill_id = h.skill_id WHERE h.k <= coalesce(e.k, h.k)),
statuses AS (SELECT s.skill_id, CASE WHEN d.decision IN ('approved', 'rejected') THEN d.decision ELSE 'pending_approval' END AS status, coalesce(n, 0) AS heard FROM skills s
 LEFT JOIN (SELECT skill_id, arg_max(decision, k) AS decision, count(*) AS n FROM counted GROUP BY skill_id) d ON d.skill_id = s.skill_id)"""
_STALE = """stales AS (SELECT r.skill_id, count(*) FILTER (n.hash IS NULL) AS gone, count(*) FILTER (n.hash <> r.recorded_hash) AS changed, bool_or(n.hash IS DISTINCT FROM r.recorded_hash) AS stale
 FROM skill_sources r LEFT JOIN source_now n ON n.source_id = r.source_id GROUP BY r.skill_id)"""
_USABLE = f"""{_STATUS}, {_STALE}, usables AS (SELECT s.skill_id, repository FROM skills s JOIN statuses t ON t.skill_id = s.skill_id WHERE t.status = 'approved' AND coalesce(repository, '{REPOSITORY}') = '{REPOSITORY}'
 AND s.status = 'active' AND s.skill_id NOT IN (SELECT skill_id FROM stales WHERE stale))"""
_VERSIONS = "versions AS (SELECT skill_id, draft_id, row_number() OVER (PARTITION BY skill_id ORDER BY draft_id) AS k, concat(content, '|', evidence) AS c FROM skill_drafts), replayed AS (SELECT a.skill_id, a.draft_id, a.k, b.c IS NOT NULL AS replay FROM versions a LEFT JOIN versions b ON b.skill_id = a.skill_id AND b.k = a.k - 1 AND b.c = a.c), numbered AS (SELECT *, sum(CASE WHEN replay THEN 0 ELSE 1 END) OVER (PARTITION BY skill_id ORDER BY k)::BIGINT AS version FROM replayed)"
_VALID = f"""bads AS (SELECT d.entry_id, count(*) FILTER (n.hash IS DISTINCT FROM d.hash OR n.hash IS NULL) AS bad FROM cache_dependencies d LEFT JOIN source_now n ON n.source_id = d.source_id GROUP BY d.entry_id),
checked AS (SELECT e.entry_id, CASE WHEN status <> 'fresh' THEN status WHEN expires_at <= {NOW} THEN 'ttl_expired' WHEN policy_version <> '{POLICY}' THEN 'policy_changed' WHEN b.entry_id IS NULL THEN 'missing_dependencies' WHEN bad > 0 THEN 'source_changed' END AS reason
 FROM cache_entries e LEFT JOIN bads b ON b.entry_id = e.entry_id)"""
_SECTIONS = """items AS (SELECT pack_id, place, min(memory_id) AS item, min(tokens) AS tokens FROM pack_items GROUP BY ALL),
chain AS (SELECT p.pack_id, (SELECT max(q.pack_id) FROM packs q WHERE q.task_id = p.task_id AND q.pack_id < p.pack_id) AS before FROM packs p),
sections AS (SELECT coalesce(a.request_id, b.request_id) AS request_id, coalesce(a.place, b.place) AS place, a.item AS now_item, b.item AS old_item, a.tokens FROM
 (SELECT c.pack_id AS request_id, i.* FROM chain c JOIN items i ON i.pack_id = c.pack_id) a FULL JOIN (SELECT c.pack_id AS request_id, i.* FROM chain c JOIN items i ON i.pack_id = c.before) b ON a.request_id = b.request_id AND a.place = b.place),
deltas AS (SELECT request_id, count(*) FILTER (old_item IS NULL) AS added, count(*) FILTER (now_item IS NULL) AS removed, count(*) FILTER (now_item <> old_item) AS changed, count(*) FILTER (now_item = old_item) AS same,
 sum(tokens)::BIGINT AS full_tokens, coalesce(sum(CASE WHEN now_item IS DISTINCT FROM old_item THEN tokens END), 0)::BIGINT + 5 AS delta_tokens FROM sections GROUP BY request_id)"""
_MODES = f"""{_VALID}, {_SECTIONS}, firsts AS (SELECT s.request_id, d.full_tokens, d.delta_tokens, CASE WHEN NOT (has_state AND delta_capable) THEN 'full' WHEN cache_fallback LIKE 'cache_lookup_failed:%' OR known_checkpoint > checkpoint THEN 'fallback_full'
 WHEN known_pack IS NULL THEN 'full' WHEN reason = 'policy_changed' THEN 'refresh_required' WHEN added + removed + changed = 0 THEN 'no_change' ELSE 'delta' END AS m FROM client_states s JOIN deltas d ON d.request_id = s.request_id JOIN checked c ON c.entry_id = s.request_id WHERE full_tokens IS NOT NULL),
modes AS (SELECT *, CASE WHEN m = 'delta' AND delta_tokens > 0.7e0 * full_tokens THEN 'full' ELSE m END AS mode FROM firsts), given AS (SELECT *, CASE WHEN mode LIKE '%full' THEN full_tokens ELSE delta_tokens END AS delivered FROM modes)"""
_TRUST = """trusts AS (SELECT source_id, agent_id, coalesce(trust_level, 'standard') AS source_trust_level, CASE WHEN kind IN ('git:', 'file:', 'repository:') THEN 'repository' WHEN regexp_matches(lower(concat(kind, url)), 'tool:|test:|command:') THEN 'tool'
 WHEN kind = 'external:' THEN 'external' WHEN agent_id = 3 THEN 'user' WHEN trust_level = 'trusted' THEN 'trusted' ELSE 'agent' END AS t FROM sources LEFT JOIN agents USING (agent_id))"""
_FIRST = "firsts AS (SELECT id, created_at, expires_at, octet_length(encode(content)) AS bytes, row_number() OVER (PARTITION BY content ORDER BY created_at, id) AS kt, row_number() OVER (PARTITION BY content[:120] ORDER BY created_at, id) AS ks, coalesce(content, '') = '' AS bad FROM memories)"
_fields = lambda t: f"concat({t}.successful, '|', {t}.corrections, '|', {t}.rework)"
_terms = sorted({t for t in OBJECTIVE.split() if len(t) > 2})

ORACLE_SQL = {
    "shadow_rank": f"WITH {_SHADOW} SELECT run_id, memory_id, prod_place, prod, shadow, delta, move FROM moves",
    "shadow_report": f"WITH {_SHADOW} SELECT tier, lifecycle, move, count(*) AS n, sum(delta)::BIGINT AS delta FROM moves JOIN memories ON id = memory_id GROUP BY ALL",
    "utility_rerank": "SELECT run_id, memory_id, prod_place, final, row_number() OVER (PARTITION BY run_id ORDER BY final DESC, memory_id, prod_place) AS place FROM (SELECT *, round(0.9e0 * score + 0.1e0 * utility, 9) AS final FROM candidates) c",
    "retrieval_log": "SELECT run_id, count(*) AS n, sha256(string_agg(memory_id::VARCHAR, ',' ORDER BY prod_place, memory_id)) AS ids_digest FROM candidates GROUP BY run_id",
    "ir_metrics": f"""WITH {_SHADOW}, runs AS (SELECT run_id, sum(CASE WHEN prod <= {K} AND relevant THEN 1 ELSE 0 END) AS hits, sum(CASE WHEN relevant THEN 1 ELSE 0 END) AS relevant, min(CASE WHEN relevant THEN prod END) AS first_hit,
 sum(CASE WHEN prod <= {K} AND selected THEN 1 ELSE 0 END) AS chosen, sum(CASE WHEN prod <= {K} AND other_scope THEN 1 ELSE 0 END) AS leaked FROM moves GROUP BY run_id)
SELECT round(avg(hits / {K}e0), 6) AS precision, round(avg(hits / greatest(relevant, 1)), 6) AS recall, round(avg(coalesce(1e0 / first_hit, 0)), 6) AS reciprocal_rank, round(avg(chosen / {K}e0), 6) AS selection_rate, sum(leaked)::BIGINT AS leaked FROM runs""",
    "pack_consistency": "WITH i AS (SELECT DISTINCT pack_id, memory_id FROM pack_items WHERE disposition IN ('inline', 'reference')), c AS (SELECT DISTINCT run_id AS pack_id, memory_id FROM candidates WHERE selected) SELECT pack_id, count(*) AS differing FROM ((SELECT * FROM i EXCEPT SELECT * FROM c) UNION ALL (SELECT * FROM c EXCEPT SELECT * FROM i)) x GROUP BY pack_id",
    "review_status": f"WITH {_STATUS} SELECT skill_id, status, heard FROM statuses",
    "skill_stale": f"WITH {_STALE} SELECT skill_id, gone, changed, stale FROM stales",
    "skill_eligible": f"WITH {_USABLE} SELECT skill_id, repository FROM usables",
    "skill_versions": f"WITH {_VERSIONS} SELECT skill_id, draft_id, version, replay FROM numbered",
    "skill_rank": "SELECT skill_id, here, overlap, uses, row_number() OVER (ORDER BY here DESC, overlap DESC, uses DESC, skill_id DESC) AS place FROM (SELECT skill_id, CASE WHEN repository IS NULL THEN 0 ELSE 1 END AS here, "
    + " + ".join(f"(lower(concat(name, ' ', kind)) LIKE '%{t}%')::INT" for t in _terms)
    + f" AS overlap, (SELECT count(*) FROM skill_uses u WHERE u.skill_id = s.skill_id AND usage = 'used') AS uses FROM skills s WHERE repository IS NULL OR repository = '{REPOSITORY}') r",
    "client_skill_state": f"""WITH {_USABLE}, {_VERSIONS}, latest AS (SELECT skill_id, max(version) AS version FROM numbered GROUP BY skill_id), due AS (SELECT k.client_id, k.skill_id, l.version FROM client_offers k JOIN usables u ON u.skill_id = k.skill_id JOIN latest l ON l.skill_id = k.skill_id)
SELECT coalesce(d.client_id, k.client_id) AS client_id, coalesce(d.skill_id, k.skill_id) AS skill_id, CASE WHEN k.version IS NULL THEN 'missing' WHEN d.version IS NULL THEN CASE WHEN s.status = 'active' THEN 'removed' ELSE 'stale_client' END WHEN k.version > d.version THEN 'stale_client' WHEN k.version < d.version THEN 'updated' ELSE 'unchanged' END AS state
FROM due d FULL JOIN client_skills k ON k.client_id = d.client_id AND k.skill_id = d.skill_id JOIN skills s ON s.skill_id = coalesce(d.skill_id, k.skill_id)""",
    "cache_key": """SELECT pack_id, concat('sha256:', sha256(concat('{"max_tokens":4000,"objective":"', objective, '","policy":"', policy, '","repository":"', repository, '","session":"', coalesce(session_id::VARCHAR, 'none'), '","task":', p.task_id, '}'))) AS cache_key FROM packs p JOIN tasks t ON t.task_id = p.task_id""",
    "cache_validity": f"WITH {_VALID} SELECT entry_id, reason IS NULL AS valid, reason FROM checked",
    "cache_typed_validity": f"""WITH prints AS (SELECT entry_id, string_agg(concat(kind, ':', dep_id, ':', hash), ',' ORDER BY kind, dep_id, hash) AS whole, string_agg(concat(kind, ':', dep_id, ':', hash), ',' ORDER BY kind, dep_id, hash) FILTER (NOT lost) AS rest FROM dependency_log GROUP BY entry_id),
bad AS (SELECT l.entry_id, string_agg(DISTINCT l.kind, ',' ORDER BY l.kind) AS changed FROM dependency_log l LEFT JOIN dependency_now n ON n.kind = l.kind AND n.dep_id = l.dep_id WHERE NOT lost AND n.hash IS DISTINCT FROM l.hash GROUP BY l.entry_id),
checked AS (SELECT e.entry_id, coalesce(b.changed, '') AS changed, CASE WHEN status <> 'fresh' THEN status WHEN expires_at <= {NOW} THEN 'ttl_expired' WHEN policy_version <> '{POLICY}' THEN 'policy_changed' WHEN rest IS NULL THEN 'missing_dependencies' WHEN b.entry_id IS NOT NULL THEN 'source_changed' WHEN whole <> rest THEN 'dependency_mismatch' END AS reason
 FROM cache_entries e LEFT JOIN prints p ON p.entry_id = e.entry_id LEFT JOIN bad b ON b.entry_id = e.entry_id) SELECT entry_id, reason IS NULL AS valid, reason, changed FROM checked""",
    "context_delta": f"WITH {_SECTIONS} SELECT request_id, added, removed, changed, same FROM deltas",
    "delivery_mode": f"WITH {_MODES} SELECT request_id, mode, delivered, greatest(0, full_tokens - delivered) AS avoided, round(greatest(0, full_tokens - delivered) / full_tokens, 6) AS ratio FROM given",
    "render_delivery": f"""WITH {_MODES}, texts AS (SELECT request_id, count(now_item) AS n, string_agg(concat('- ', place, ': ', now_item), chr(10) ORDER BY place) FILTER (now_item IS NOT NULL) AS whole,
 string_agg(concat('- ', place, ': ', now_item), chr(10) ORDER BY place) FILTER (now_item IS NOT NULL AND now_item IS DISTINCT FROM old_item) AS part FROM sections GROUP BY request_id)
SELECT g.request_id, mode, CASE mode WHEN 'no_change' THEN '' WHEN 'refresh_required' THEN concat('refresh: ', n) WHEN 'delta' THEN coalesce(part, '') ELSE whole END AS body FROM given g JOIN texts t ON t.request_id = g.request_id""",
    "delivery_pending": "SELECT pack_id, task_id FROM packs p WHERE NOT EXISTS (SELECT 1 FROM pack_usage u WHERE u.pack_id = p.pack_id AND u.usage_type NOT IN ('selected', 'injected', 'expanded'))",
    "resolve_event_source": "SELECT u.pack_id, u.memory_id, u.usage_type, u.used_at, p.task_id, p.session_id, t.owner_id FROM tasks t, packs p, pack_usage u WHERE u.pack_id = p.pack_id AND t.task_id = p.task_id AND t.repository = 'BUILDING'",
    "handoff_build": "SELECT h.handoff_id, h.task_id, h.target_agent, (SELECT count(*) FROM handoffs o WHERE o.task_id = h.task_id AND o.target_agent = h.target_agent AND o.handoff_id <= h.handoff_id)::INT AS version, CASE WHEN EXISTS (SELECT 1 FROM handoffs o WHERE o.task_id = h.task_id AND o.target_agent = h.target_agent AND o.handoff_id > h.handoff_id) THEN 'superseded' ELSE h.status END AS status FROM handoffs h",
    "handoff_visible": "SELECT handoff_id, status FROM handoffs WHERE 7 IN (source_agent, target_agent, coalesce(requester, -1))",
    "trust_provenance": f"""WITH {_TRUST} SELECT source_id, CASE t WHEN 'repository' THEN 'repository_evidence' WHEN 'tool' THEN 'successful_tool_output' WHEN 'external' THEN 'external_content' WHEN 'user' THEN 'user_factual_statement' WHEN 'trusted' THEN 'trusted_agent_conclusion' ELSE 'unverified_agent_statement' END AS authority,
 CASE t WHEN 'repository' THEN 'verified' WHEN 'tool' THEN 'verified' WHEN 'user' THEN 'stated' WHEN 'trusted' THEN 'agent_attested' ELSE 'unverified' END AS verification, CASE t WHEN 'trusted' THEN 'agent' ELSE t END AS source_type, source_trust_level FROM trusts""",
    "validation_requests": f"""WITH {_TRUST}, nexts AS (SELECT *, lead(claim_value) OVER (PARTITION BY entity_id, claim_key ORDER BY observed_at, fact_id) AS nxt FROM facts), currents AS (SELECT * FROM nexts WHERE nxt IS NULL OR nxt = claim_value)
SELECT 'decision' AS kind, id FROM memories WHERE category = 'decision' AND lifecycle = 'active' UNION ALL SELECT 'event', pack_id FROM pack_usage WHERE usage_type = 'rejected' UNION ALL SELECT 'external', source_id FROM trusts WHERE t = 'external'
UNION ALL SELECT 'contradiction', a.fact_id FROM currents a WHERE EXISTS (SELECT 1 FROM currents b WHERE b.entity_id = a.entity_id AND b.claim_key = a.claim_key AND b.claim_value <> a.claim_value)""",
    "import_plan": f"""WITH {_FIRST} SELECT verdict, count(*) AS n, sum(bytes)::BIGINT AS bytes, min(created_at) AS earliest, max(created_at) AS latest FROM (SELECT *, CASE WHEN bad THEN 'invalid' WHEN id IN (SELECT memory_id FROM stored_embeddings WHERE status = 'pending') THEN 'already_present'
 WHEN expires_at < 1706745600 THEN 'expired' WHEN kt > 1 THEN 'exact_duplicate' WHEN ks > 1 THEN 'near_duplicate' ELSE 'import' END AS verdict FROM firsts) v GROUP BY verdict""",
    "dedup_exact": f"WITH {_FIRST} SELECT id, ks > 1 AS near FROM firsts WHERE NOT bad AND kt = 1 AND coalesce(expires_at, 0) >= 0",
    "legacy_source": "SELECT conv_id, turn, text FROM conversations",
    "upsert_conflicts": "SELECT a.id, CASE WHEN m.id IS NULL THEN 'new' WHEN a.content IS NOT DISTINCT FROM m.content AND a.agent IS NOT DISTINCT FROM m.agent THEN 'replay' ELSE 'conflict' END AS verdict FROM arrivals a LEFT JOIN memories m ON m.id = a.id",
    "idempotency_classify": f"SELECT task_id AS k, CASE WHEN count(DISTINCT {_fields('o')}) > 1 THEN 'conflict' ELSE 'replay' END AS verdict FROM task_outcomes o GROUP BY task_id",
    "apply_enrichment": """WITH e AS (SELECT m.id, m.lifecycle, x.id AS xid, lower(coalesce(x.category, m.category)) AS category, CASE WHEN lower(x.tier) IN ('cold', 'active', 'persist') THEN lower(x.tier) ELSE m.tier END AS tier FROM memories m LEFT JOIN extractions x ON x.id = m.id)
SELECT id, category, tier, CASE WHEN lifecycle = 'pinned' OR xid IS NULL THEN lifecycle ELSE CASE tier WHEN 'cold' THEN 'ephemeral' WHEN 'persist' THEN 'stable' ELSE 'active' END END AS lifecycle FROM e""",
    "delete_cascade": " UNION ALL ".join(f"SELECT '{t}' AS relation, memory_id, count(*) AS left_rows FROM {t} WHERE memory_id NOT IN (SELECT id FROM memories WHERE lifecycle = 'archived') GROUP BY memory_id" for t in ("usage_log", "pack_items", "chunk_vectors", "stored_embeddings", "lifecycle_log")),
    "eligible_degraded": f"SELECT id, coalesce(expires_at > {NOW}, true) AS eligible FROM memories",
    "scope_formal": "SELECT id FROM memories WHERE (project, category) = ('p1', 'task')",
    "orphan_entities": "SELECT id FROM entities WHERE id NOT IN (SELECT src FROM strong_edges UNION SELECT dst FROM strong_edges)",
    "claim_jobs": f"SELECT j.job_id, event_type, status = 'processing' AS reclaimed, attempts + 1 AS attempts, {NOW + 60} AS lease_until FROM jobs j JOIN incoming ON event_id = job_id WHERE CASE status WHEN 'pending' THEN available_at <= {NOW} WHEN 'retry' THEN available_at <= {NOW} WHEN 'processing' THEN lease_until <= {NOW} ELSE false END",
    "edge_upsert": "SELECT src, kind, CASE WHEN kind = 't4' THEN 0 ELSE count(DISTINCT dst) END AS stored, CASE WHEN kind = 't4' THEN 0 ELSE count(*) END AS created FROM edge_attempts GROUP BY src, kind",
    "entity_delete": "SELECT 'edges' AS relation, count(*) AS n FROM edges WHERE 's7' NOT IN (src, dst) UNION ALL SELECT 'entities', count(*) FROM entities WHERE id <> 's7' UNION ALL SELECT 'facts', count(*) FROM facts WHERE entity_id <> 7",
    "unknown_sections": "SELECT pack_id, CASE WHEN bool_or(disposition = 'omitted') THEN 'omitted' ELSE '' END AS unknown FROM pack_items GROUP BY pack_id",
    "as_text": "SELECT conv_id, turn, role, length(trim(text)) AS n_chars FROM conversations WHERE text IS NOT NULL",
}

"""Domain tables of the memory engine, as views over the driver's tables.

Each view is one SELECT in the dialect that Spark and DuckDB share, so that a query and its check read the same
rows.  ``now`` is a constant: no operator reads the clock.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

BASE = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
EPOCH = 1704067200
NOW = EPOCH + 35 * 86400

#: Memory categories, and seconds that a tier lives (persist: for ever).
CATEGORIES = ("project", "person", "preference", "decision", "task", "strategy", "session")
TTL = {"cold": 86400, "active": 2592000}

#: Sentences that open the notes, and the entities they speak of: (entity, name, type, 1 for an alias).
NOTES = (
    "Nora decided that Harbor stays small.", "Today Tomas works on Lantern search. Harbor waits.", "Lantern uses Kiln for events.", "ok",
    "Harbor switched to Kiln storage last week!", "We fixed nothing; the weather is nice.", "Eleonora was confirmed as reviewer of Quarry.", "The Kiln service needs Harbor and is linked to Lantern.",
)
REGISTRY = (("nora", "nora", "person", 0), ("nora", "eleonora", "person", 1), ("tomas", "tomas", "person", 0), ("harbor", "harbor", "project", 0), ("lantern", "lantern", "project", 0), ("kiln", "kiln", "tool", 0))

#: Names of any number of words: (entity, name, type, 1 for an alias, 1 for an entity that was registered, place).
NAMES = (
    ("nora", "nora", "person", 0, 0, 0), ("nora", "eleonora", "person", 1, 0, 1), ("harbor", "harbor", "project", 0, 0, 2), ("weather", "weather is nice", "concept", 1, 0, 3),
    ("lantern", "Lantern search", "project", 0, 1, 4), ("lantern", "lantern", "project", 1, 1, 5), ("kiln", "Kiln storage", "tool", 0, 1, 6), ("kiln", "the kiln service", "tool", 1, 1, 7), ("quarry-works", "Quarry works", "project", 0, 1, 8),
)

#: One text for each branch of a gate's rules.
OPENINGS = (
    "ok", "We decided to keep the old rule", "please fix the release-less thing now", "what is the plan for today then", "is this it?", "a short line", "Got it ", "I prefer tea",
    "some words about the weather here", "thanks", "words that say nothing at all about anything that matters to anyone here", "Version 2 is out", "create a ticket", "hm", "👍",
    "a design pattern was found for this", "let us build that thing over there today", "build that thing over there today then", "do we want it", "my name stands there",
)
#: Entities with aliases (divided by |) and what is known of them.
ENTITY_BOOK = (
    ("nora", "Nora", "Eleonora|Nori|Leni|Elle", "Was the one that decided on the harbor"), ("harbor", "Harbor", "Port", "The and that is of the in it to was for on with by"),
    ("lantern", "Lantern", "", ""), ("kiln", "Kiln", "Oven|Stove", "Storage that the harbor uses"),
)

_category = "CASE doc_id % 7 " + " ".join(f"WHEN {i} THEN '{c}'" for i, c in enumerate(CATEGORIES)) + " END"
VIEWS = {
    "memories": f"""
SELECT id, content, summary, tier, category, project, agent, workspace_id, created_at, accessed_at, expires_at, lifecycle FROM (
 SELECT t.*, created_at + (id % 97) * 60 AS accessed_at,
  CASE tier WHEN 'cold' THEN created_at + {TTL['cold']} WHEN 'active' THEN created_at + {TTL['active']} END AS expires_at,
  CASE WHEN id % 19 = 0 THEN 'pinned' WHEN id % 17 = 0 THEN 'archived' WHEN id % 13 = 0 THEN 'cold'
   WHEN tier = 'cold' THEN 'ephemeral' WHEN tier = 'persist' THEN 'stable' ELSE 'active' END AS lifecycle
 FROM (SELECT doc_id AS id, text AS content, substr(text, 1, 200) AS summary,
  CASE doc_id % 4 WHEN 0 THEN 'persist' WHEN 3 THEN 'cold' ELSE 'active' END AS tier, {_category} AS category,
  CASE WHEN doc_id % 5 = 0 THEN '' ELSE concat('p', CAST(doc_id % 3 AS VARCHAR(9))) END AS project, source AS agent, concat('w', CAST(doc_id % 2 AS VARCHAR(9))) AS workspace_id,
  {EPOCH} + (doc_id % 800) * 3600 AS created_at FROM documents) t) u""",
    "facts": "SELECT o_orderkey AS fact_id, o_custkey AS entity_id, o_orderpriority AS claim_key, o_orderstatus AS claim_value, CAST((o_orderkey % 10) / 10.0 AS DOUBLE) AS confidence, CAST(o_orderdate AS DATE) AS observed_at FROM orders",
    "edges": "SELECT DISTINCT concat('s', CAST(l_suppkey AS VARCHAR(20))) AS src, concat('p', CAST(l_partkey AS VARCHAR(20))) AS dst, concat('t', CAST(l_linenumber % 5 AS VARCHAR(2))) AS kind FROM lineitem",
    "entities": "SELECT concat('s', CAST(s_suppkey AS VARCHAR(20))) AS id, s_name AS name, 'supplier' AS kind FROM supplier UNION ALL SELECT concat('p', CAST(p_partkey AS VARCHAR(20))), p_name, 'part' FROM part",
    "jobs": f"SELECT event_id AS job_id, event_id % 12 AS attempts, CASE event_id % 5 WHEN 0 THEN 'pending' WHEN 1 THEN 'retry' WHEN 2 THEN 'processing' WHEN 3 THEN 'completed' ELSE 'dead' END AS status, {NOW} + (event_id % 200) - 100 AS available_at, {NOW} + (event_id % 90) - 60 AS lease_until, {EPOCH} + event_id AS created_at FROM events",
    "usage_log": f"SELECT event_id AS usage_id, event_id % 400 AS memory_id, user_id AS session_id, user_id % 7 AS agent_id, CASE event_type WHEN 'click' THEN 'used' WHEN 'error' THEN 'rejected' WHEN 'purchase' THEN 'expanded' WHEN 'view' THEN 'selected' ELSE 'ignored' END AS usage_type, {EPOCH} + event_id * 60 AS used_at FROM events",
    "notes": "SELECT conv_id * 1000 + turn AS id, concat(CASE (conv_id + turn) % "
    + f"{len(NOTES)} " + " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(NOTES)) + " END, ' ', coalesce(text, '')) AS note FROM conversations",
    "registry": " UNION ALL ".join(f"SELECT '{e}' AS entity_id, '{n}' AS name, '{k}' AS kind, {a} AS is_alias" for e, n, k, a in REGISTRY),
    "entity_names": " UNION ALL ".join(f"SELECT '{e}' AS entity_id, '{n}' AS name, '{k}' AS kind, {a} AS alias, {r} AS registered, {p} AS rank" for e, n, k, a, r, p in NAMES),
    # Agents, tasks and repositories
    "agents": "SELECT n_nationkey AS agent_id, concat('src', CAST(n_nationkey AS VARCHAR(9))) AS name, CASE n_regionkey WHEN 0 THEN 'trusted' WHEN 1 THEN 'low' ELSE 'standard' END AS trust_level, n_regionkey AS workspace_id FROM nation",
    "tasks": "SELECT c_custkey AS task_id, c_nationkey AS owner_id, c_mktsegment AS repository, CASE WHEN c_acctbal < 0 THEN 'cancelled' WHEN c_acctbal > 9000 THEN 'completed' ELSE 'open' END AS status, concat(c_mktsegment, ' red large steel work') AS objective FROM customer",
    "sources": "SELECT page_id AS source_id, url, CASE WHEN url LIKE 'http:%' THEN 'external:' WHEN url LIKE '%/en/%' THEN 'git:' WHEN url LIKE '%.org%' THEN 'tool:' ELSE 'chat:' END AS kind, CAST(length(url) % 25 AS INTEGER) AS agent_id FROM pages",
    # Context packs: what was delivered, what became of it, and how the tasks went
    "packs": f"SELECT o_orderkey AS pack_id, o_custkey AS task_id, CASE WHEN o_totalprice < 20000 THEN NULL ELSE o_custkey % 211 END AS session_id, {EPOCH} + o_orderkey * 60 AS created_at, substr(o_orderpriority, 3) AS policy FROM orders",
    "pack_items": "SELECT l_orderkey AS pack_id, l_linenumber AS place, l_partkey AS memory_id, CASE l_returnflag WHEN 'A' THEN 'inline' WHEN 'N' THEN 'reference' ELSE 'omitted' END AS disposition, CAST(floor(l_quantity) AS BIGINT) AS tokens, l_linestatus = 'F' AS mandatory FROM lineitem",
    "pack_usage": f"SELECT l_orderkey AS pack_id, l_partkey AS memory_id, l_suppkey % 25 AS agent_id, CASE l_linenumber WHEN 1 THEN 'selected' WHEN 2 THEN 'injected' WHEN 3 THEN 'expanded' WHEN 4 THEN 'used' WHEN 5 THEN 'ignored' WHEN 6 THEN 'rejected' ELSE 'corrected' END AS usage_type, {EPOCH} + l_orderkey * 60 + l_linenumber AS used_at, l_discount >= 0.09 AS duplicate, l_tax >= 0.07 AS contradiction FROM lineitem",
    "task_outcomes": "SELECT o_orderkey AS outcome_id, o_custkey AS task_id, CASE o_orderpriority WHEN '1-URGENT' THEN NULL ELSE o_custkey % 211 END AS session_id, CASE o_orderstatus WHEN 'F' THEN 1 ELSE 0 END AS successful, CASE WHEN o_totalprice > 400000 THEN 2 WHEN o_totalprice > 300000 THEN 1 ELSE 0 END AS corrections, CASE o_orderpriority WHEN '5-LOW' THEN 1 ELSE 0 END AS rework FROM orders WHERE o_totalprice > 250000",
    # Retrieval runs: candidates in a run, with their scores and what was chosen
    "candidates": "SELECT l_orderkey AS run_id, l_linenumber AS prod_place, l_partkey AS memory_id, l_extendedprice / 100000 AS score, l_discount * 10 AS utility, l_returnflag = 'A' AS selected, l_linestatus = 'F' AS relevant, l_suppkey % 3 = 0 AS other_scope FROM lineitem",
    # Skills: drafts in order, reviews of them, uses, and the clients' copies
    "skills": "SELECT p_partkey AS skill_id, p_name AS name, p_type AS kind, CASE WHEN p_size > 47 THEN 'deprecated' WHEN p_size > 44 THEN 'archived' ELSE 'active' END AS status, CASE WHEN p_retailprice > 1500 THEN NULL ELSE p_brand END AS repository, CAST(p_size % 25 AS BIGINT) AS owner_id FROM part",
    "skill_drafts": "SELECT l_partkey AS skill_id, ((l_orderkey * 10 + l_linenumber) * 100000 + l_suppkey) * 100 + CAST(floor(l_quantity) AS BIGINT) AS draft_id, concat('steps: ', CASE WHEN l_quantity > 25 THEN 'measure, cut' ELSE 'cut, measure' END) AS content, concat('from ', l_linestatus) AS evidence FROM lineitem",
    "skill_reviews": "SELECT l_partkey AS skill_id, ((l_orderkey * 10 + l_linenumber) * 100000 + l_suppkey) * 100 + CAST(floor(l_quantity) AS BIGINT) AS review_id, l_suppkey % 25 AS reviewer_id, CASE l_returnflag WHEN 'A' THEN 'approved' WHEN 'R' THEN 'rejected' ELSE 'changes_requested' END AS decision FROM lineitem",
    "skill_uses": "SELECT l_partkey AS skill_id, CASE l_linestatus WHEN 'F' THEN 'used' ELSE 'injected' END AS usage FROM lineitem",
    "skill_sources": "SELECT l_partkey AS skill_id, l_suppkey AS source_id, md5(max(CASE WHEN l_discount > 0.09 AND l_tax > 0.07 THEN concat(s_name, ' before') ELSE s_name END)) AS recorded_hash FROM lineitem JOIN supplier ON s_suppkey = l_suppkey GROUP BY l_partkey, l_suppkey",
    "source_now": "SELECT s_suppkey AS source_id, CASE WHEN s_acctbal < -900 THEN NULL ELSE md5(s_name) END AS hash FROM supplier",
    "client_skills": "SELECT c_custkey % 50 AS client_id, p_partkey AS skill_id, c_nationkey % 4 + 1 AS version FROM customer JOIN part ON p_partkey = c_custkey",
    "client_offers": "SELECT DISTINCT c_custkey % 50 AS client_id, c_custkey + k AS skill_id FROM customer, (SELECT 0 AS k UNION ALL SELECT 1) n",
    # Delivery: cached packs with what they depend on, and what clients ask with
    "cache_entries": f"SELECT o_orderkey AS entry_id, CASE o_orderstatus WHEN 'P' THEN 'fresh' WHEN 'F' THEN 'fresh' ELSE 'invalid' END AS status, CASE WHEN o_totalprice > 450000 THEN {NOW} - 60 WHEN o_totalprice > 100000 THEN {NOW} + 3600 END AS expires_at, CASE o_orderpriority WHEN '5-LOW' THEN 'context-v1' ELSE 'context-v2' END AS policy_version FROM orders",
    "cache_dependencies": "SELECT l_orderkey AS entry_id, 'supplier' AS kind, l_suppkey AS source_id, md5(max(CASE WHEN l_discount > 0.09 THEN concat(s_name, ' before') ELSE s_name END)) AS hash FROM lineitem JOIN supplier ON s_suppkey = l_suppkey GROUP BY l_orderkey, l_suppkey",
    "client_states": "SELECT o_orderkey AS request_id, o_custkey AS client_id, o_orderstatus <> 'F' AS has_state, o_orderpriority NOT IN ('4-NOT SPECIFIED') AS delta_capable, CASE o_orderpriority WHEN '2-HIGH' THEN 9 ELSE 3 END AS known_checkpoint, 5 AS checkpoint, CASE WHEN o_totalprice > 50000 THEN o_orderkey END AS known_pack, CASE WHEN o_orderpriority = '3-MEDIUM' AND o_totalprice < 100000 THEN 'cache_lookup_failed:timeout' END AS cache_fallback FROM orders",
    # What cached packs depend on: sources of each kind as they are, and as they were when a pack was cached
    "dependency_now": f"""SELECT 'task' AS kind, CAST(task_id AS VARCHAR(20)) AS dep_id, md5(concat(status, '|', objective)) AS hash FROM tasks
 UNION ALL SELECT 'session_checkpoint', CAST(session_id AS VARCHAR(20)), md5(CAST(version AS VARCHAR(20))) FROM session_heads
 UNION ALL SELECT 'decision', CAST(session_id AS VARCHAR(20)), md5(max(completed)) FROM session_saves GROUP BY session_id
 UNION ALL SELECT 'constraint', CAST(session_id AS VARCHAR(20)), md5(max(remaining)) FROM session_saves GROUP BY session_id
 UNION ALL SELECT 'validation_state', CAST(pack_id AS VARCHAR(20)), md5(CAST(count(CASE WHEN mandatory THEN 1 END) AS VARCHAR(20))) FROM pack_items GROUP BY pack_id
 UNION ALL SELECT 'repository_commit', repository, md5(repository) FROM tasks GROUP BY repository
 UNION ALL SELECT 'policy', policy, md5(policy) FROM packs GROUP BY policy UNION ALL SELECT 'token_estimator', 'context', md5('bytes/4')
 UNION ALL SELECT 'memory', project, md5(concat(CAST(count(*) AS VARCHAR(20)), ':', CAST(max(accessed_at) AS VARCHAR(20)))) FROM memories GROUP BY project
 UNION ALL SELECT 'skill', CAST(skill_id AS VARCHAR(20)), md5(concat(status, '|', kind)) FROM skills
 UNION ALL SELECT 'handoff', CAST(handoff_id AS VARCHAR(20)), md5(status) FROM handoffs""",
    "dependency_ids": """SELECT pack_id AS entry_id, 'task' AS kind, CAST(task_id AS VARCHAR(20)) AS dep_id FROM packs UNION ALL SELECT pack_id, k, CAST(session_id AS VARCHAR(20)) FROM packs, (SELECT 'session_checkpoint' AS k UNION ALL SELECT 'decision' UNION ALL SELECT 'constraint') ks WHERE session_id < 45
 UNION ALL SELECT pack_id, 'validation_state', CAST(pack_id AS VARCHAR(20)) FROM packs UNION ALL SELECT pack_id, 'repository_commit', repository FROM packs p JOIN tasks t ON t.task_id = p.task_id UNION ALL SELECT pack_id, 'policy', policy FROM packs
 UNION ALL SELECT pack_id, 'token_estimator', 'context' FROM packs UNION ALL SELECT pack_id, 'memory', concat('p', CAST(pack_id % 3 AS VARCHAR(9))) FROM packs UNION ALL SELECT pack_id, 'skill', CAST(task_id AS VARCHAR(20)) FROM packs UNION ALL SELECT pack_id, 'handoff', CAST(pack_id AS VARCHAR(20)) FROM packs""",
    "dependency_log": "SELECT i.entry_id, i.kind, i.dep_id, CASE WHEN (i.entry_id * 31 + length(i.kind) * 7) % 97 = 0 THEN md5('as it was') ELSE hash END AS hash, i.entry_id % 41 = 0 AND i.kind = 'memory' AS lost FROM dependency_ids i JOIN dependency_now n ON n.kind = i.kind AND n.dep_id = i.dep_id",
    # Hand-offs
    "handoffs": f"SELECT o_orderkey AS handoff_id, o_custkey AS task_id, CAST(o_custkey % 25 AS BIGINT) AS source_agent, CAST(floor(o_totalprice) % 25 AS BIGINT) AS target_agent, CASE o_orderstatus WHEN 'P' THEN CAST(o_orderkey % 25 AS BIGINT) END AS requester, CASE o_orderstatus WHEN 'P' THEN 'ready' WHEN 'F' THEN 'completed' ELSE 'claimed' END AS status, {EPOCH} + o_orderkey * 60 AS created_at FROM orders",
    "handoff_versions": "SELECT DISTINCT l_orderkey AS handoff_id, l_linenumber AS version FROM lineitem",
    # Stored chunks and vectors of memories
    "chunk_vectors": "SELECT vec_id AS chunk_id, vec_id % 200 AS memory_id, embedding, CASE WHEN label < 7 THEN 'model-b' ELSE 'model-a' END AS model FROM embeddings",
    "stored_embeddings": "SELECT doc_id AS memory_id, CASE WHEN quality = 1 THEN 'ready' ELSE 'pending' END AS status, CASE WHEN toxic = 1 THEN 'model-a' ELSE 'model-b' END AS model FROM labels",
    "embedding_state": "SELECT l.doc_id AS memory_id, CASE WHEN quality = 1 THEN 'ready' ELSE 'pending' END AS status, CASE WHEN toxic = 1 THEN 'model-a' ELSE 'model-b' END AS model, CASE WHEN l.doc_id % 11 = 0 THEN concat(coalesce(text, ''), ' before') ELSE text END AS text_then FROM labels l JOIN documents t ON t.doc_id = l.doc_id",
    "memory_links": "SELECT DISTINCT doc_id AS memory_id, concat(source, ':', lang) AS entity_id FROM documents",
    "memory_book": "SELECT doc_id AS id, CASE WHEN doc_id % 3 = 0 THEN substr(text, 1, 80) ELSE '' END AS compiled_truth, CASE WHEN n_chars > 900 THEN substr(text, 81, 200) ELSE '' END AS timeline, doc_id % 4 AS dream_count FROM documents",
    "entity_state": "SELECT concat('s', CAST(s_suppkey AS VARCHAR(20))) AS id, s_name AS name, CASE WHEN s_acctbal > 4000 THEN 'persist' WHEN s_acctbal > 0 THEN 'active' ELSE 'cold' END AS tier, CASE WHEN s_nationkey > 6 THEN concat('- began', chr(10), repeat(concat('- shipped an order on time', chr(10)), CAST(s_nationkey % 5 + 1 AS INTEGER))) ELSE '' END AS timeline, concat('supplier ', s_name, CASE WHEN s_acctbal > 8000 THEN repeat(' trusted', 9) ELSE '' END) AS compiled_truth FROM supplier",
    # Sessions: their log, the checkpoints that are kept of it, and clients that ask for what they missed
    "session_log": "SELECT session_id, usage_id AS event_id, row_number() OVER (PARTITION BY session_id ORDER BY used_at, usage_id) AS seq FROM usage_log",
    "session_heads": "SELECT session_id, CAST(floor(max(seq) / 8) AS BIGINT) AS version FROM session_log GROUP BY session_id",
    "session_saves": "SELECT l.session_id, CAST(floor(seq / 8) AS BIGINT) AS version, CAST(seq AS BIGINT) AS source_sequence, concat('set up|task ', CAST(CAST(floor(seq / 8) AS BIGINT) AS VARCHAR(9)), '|task ', CAST(CAST(floor(seq / 16) AS BIGINT) AS VARCHAR(9)), '|task ', CAST(event_id % 4 AS VARCHAR(9))) AS completed, CASE WHEN event_id % 3 = 0 THEN 'tests|docs' ELSE 'docs' END AS remaining FROM session_log l JOIN session_heads h ON h.session_id = l.session_id WHERE seq % 8 = 0 AND (seq % 32 > 0 OR floor(seq / 8) > h.version - 3)",
    "delta_requests": "SELECT c_custkey AS request_id, c_custkey % 60 AS session_id, CAST(floor(c_custkey / 60) AS BIGINT) % 12 AS known_version FROM customer",
    "conversation_lines": "SELECT conv_id AS session_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS line, role, text FROM conversations",
    "transcript_cursors": "SELECT conv_id AS session_id, CAST(conv_id % 9 AS BIGINT) AS lines FROM conversations WHERE conv_id % 3 = 0 GROUP BY conv_id UNION ALL SELECT -1, 4",
    # Life of memories: what agents did to them
    "lifecycle_log": f"SELECT l_partkey AS memory_id, ((l_orderkey * 10 + l_linenumber) * 100000 + l_suppkey) * 100 + CAST(floor(l_quantity) AS BIGINT) AS step, {EPOCH} + l_orderkey * 60 + l_linenumber AS at, CASE WHEN l_returnflag = 'A' AND l_linestatus = 'F' THEN 'pin' WHEN l_returnflag = 'A' THEN 'unpin' WHEN l_returnflag = 'R' THEN 'demote' ELSE 'restore' END AS action FROM lineitem WHERE l_quantity > 40",
    # Ingestion: events that arrive, and the ledger of those seen
    "incoming": "SELECT event_id, user_id, event_type FROM events",
    "ingest_ledger": f"SELECT event_id, CASE event_type WHEN 'error' THEN 'failed' WHEN 'click' THEN 'processing' ELSE 'complete' END AS status, {NOW} - CAST(floor(value * 10) AS BIGINT) AS updated_at FROM events WHERE value < 80",
    # Searches, the entities that they name, and links between topics
    "searches": " UNION ALL ".join(f"SELECT {i} AS query_id, '{n}' AS text" for i, n in enumerate(NOTES)),
    "hard_searches": "SELECT item_id AS query_id, text FROM benchmark UNION ALL SELECT 900001, '. ' UNION ALL SELECT 900002, 'qzxv' UNION ALL SELECT 900003, ', '",
    # Requests with a scope of their own; searches for words that stand one after another; words that requests begin with, as entities
    "requests": "SELECT item_id AS query_id, text, CASE WHEN item_id % 3 > 0 THEN concat('p', CAST(item_id % 3 AS VARCHAR(9))) END AS project, CASE WHEN item_id % 7 = 1 THEN concat('src', CAST(item_id % 20 AS VARCHAR(9))) END AS agent, CASE item_id % 4 WHEN 1 THEN 'w0' WHEN 2 THEN 'w1' END AS workspace_id, item_id % 5 = 0 AS include_cold FROM benchmark",
    "phrase_searches": "SELECT item_id AS query_id, replace(replace(text, ' th', '-th'), ' o', '_o.') AS text FROM benchmark",
    "entity_book": " UNION ALL ".join(f"SELECT '{n}' AS name, '{t}' AS title, '{a}' AS aliases, '{x}' AS truth" for n, t, a, x in ENTITY_BOOK)
    + " UNION ALL SELECT lower(word), min(word), min(concat(replace(substr(text, 40, 30), ' ', '|'), '|')), min(substr(text, 90, 120)) FROM (SELECT text, regexp_extract(text, '^[A-Za-z]+', 0) AS word FROM benchmark) b WHERE length(word) > 2 AND lower(word) NOT IN ('nora', 'harbor', 'lantern', 'kiln') GROUP BY lower(word)",
    "topic_edges": f"SELECT DISTINCT concat('src', CAST(l_suppkey % 20 AS VARCHAR(9)), ':', {_category.replace('doc_id', 'l_partkey')}) AS src, concat('src', CAST(l_orderkey % 20 AS VARCHAR(9)), ':', {_category.replace('doc_id', 'l_orderkey')}) AS dst FROM lineitem WHERE l_quantity = 50 AND l_linenumber = 1",
    # Texts to be judged: what was said, and its opening alone; what models answered; what extractors gave
    "utterances": "SELECT conv_id * 1000 + turn AS id, 'said' AS part, coalesce(text, '') AS text FROM conversations UNION ALL SELECT conv_id * 1000 + turn, 'opening', CASE (conv_id + turn) % "
    + f"{len(OPENINGS)} " + " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(OPENINGS)) + " END FROM conversations",
    "model_answers": "SELECT event_id AS id, CASE event_type WHEN 'click' THEN 'Label: persist.' WHEN 'view' THEN 'active or cold' WHEN 'signup' THEN 'I would skip this' WHEN 'purchase' THEN concat('level ', CAST(user_id AS VARCHAR(9))) END AS answer, CASE WHEN value < 90 THEN value / 20 END AS skip_score, user_id / 50E0 AS cold_score, (100 - value) / 40 AS active_score, 1.25E0 AS persist_score, concat('event ', event_type, ' by ', CAST(user_id AS VARCHAR(9))) AS text FROM events",
    "extractions": "SELECT p_partkey AS id, CASE p_type WHEN 'ECONOMY' THEN 'Decision' WHEN 'PROMO' THEN 'TASK' WHEN 'SMALL' THEN 'person' ELSE p_type END AS category, CASE WHEN p_size > 30 THEN 'Persist' WHEN p_size > 10 THEN 'cold' ELSE p_brand END AS tier FROM part",
    "captures": "SELECT conv_id * 1000 + turn AS id, CASE role WHEN 'assistant' THEN 'decision' END AS requested_category, CASE WHEN turn = 0 THEN 'persist' END AS requested_tier FROM conversations",
    "deliveries": f"SELECT event_id, user_id % 12 + 1 AS delivered, event_type = 'error' AS failed, {NOW} AS at FROM events",
    "arrivals": "SELECT doc_id AS id, CASE WHEN n_chars > 3000 THEN concat(text, ' more') ELSE text END AS content, source AS agent FROM documents UNION ALL SELECT page_id + 100000000000, url, 'src0' FROM pages",
    "edge_attempts": "SELECT concat('s', CAST(l_suppkey AS VARCHAR(20))) AS src, concat('p', CAST(l_partkey AS VARCHAR(20))) AS dst, concat('t', CAST(l_linenumber % 5 AS VARCHAR(2))) AS kind FROM lineitem",
    "strong_edges": "SELECT DISTINCT concat('s', CAST(l_suppkey AS VARCHAR(20))) AS src, concat('p', CAST(l_partkey AS VARCHAR(20))) AS dst FROM lineitem WHERE l_quantity >= 45",
    "handoff_steps": f"SELECT l_orderkey AS handoff_id, (l_linenumber * 1000000 + l_partkey) * 100000 + l_suppkey AS seq, CASE WHEN l_linenumber = 1 THEN 'ready' WHEN l_linenumber = 2 THEN 'claimed' WHEN l_returnflag = 'A' THEN 'in_progress' WHEN l_quantity > 45 THEN 'cancelled' WHEN l_returnflag = 'R' THEN 'blocked' WHEN l_linestatus = 'F' THEN 'completed' ELSE 'expired' END AS wanted, {EPOCH} + l_orderkey * 60 + l_linenumber * 21600 AS at FROM lineitem",
    "task_checkpoints": f"SELECT o_custkey AS task_id, {EPOCH} + o_orderkey * 60 AS at, o_orderkey AS version FROM orders",
    "handoff_terms": f"SELECT o_orderkey AS handoff_id, o_custkey AS task_id, o_orderkey AS checkpoint, CASE o_orderpriority WHEN '1-URGENT' THEN {EPOCH} + o_orderkey * 60 + 43200 WHEN '5-LOW' THEN NULL ELSE {EPOCH} + o_orderkey * 60 + 86400 END AS expires_at FROM orders",
    # Context packs to be made: what each request must hold, and the skills and memories that it may
    "pack_requests": "SELECT o_orderkey AS request, 300 + o_orderkey % 7 * 150 AS budget, 60 + o_custkey % 300 AS mandatory_tokens, o_custkey % 190 AS continuity_tokens, CASE WHEN o_custkey % 190 < 40 THEN o_custkey % 190 ELSE 40 END AS continuity_brief_tokens, o_orderpriority <> '4-NOT SPECIFIED' AS references_taken FROM orders",
    "pack_entries": "SELECT l_orderkey AS request, CASE WHEN l_linenumber = 1 THEN 'skill' ELSE 'memory' END AS kind, ((l_linenumber * 100000 + l_partkey) * 10000 + l_suppkey) * 100 + CAST(floor(l_quantity) AS BIGINT) AS place, l_returnflag AS category, CAST(floor(l_quantity) AS BIGINT) * 6 AS content_tokens, CASE WHEN l_discount > 0.02 THEN CAST(floor(l_quantity) AS BIGINT) * 2 END AS summary_tokens, 15 + l_linenumber * 3 AS reference_tokens, concat('text ', CAST(l_partkey % 9 AS VARCHAR(9))) AS text_key, l_tax > 0.06 AS needs_check FROM lineitem",
    "entity_pages": f"SELECT concat('s', CAST(s_suppkey AS VARCHAR(20))) AS id, concat('supplier ', s_name) AS known, {EPOCH} AS updated_at, {EPOCH} + CAST(floor(s_acctbal) AS BIGINT) AS edited_at, concat('# ', s_name, chr(10), chr(10), '## Executive Summary', chr(10), chr(10), CASE WHEN s_acctbal > 5000 THEN 'A trusted ' ELSE '' END, 'supplier ', s_name, chr(10), CASE WHEN s_nationkey > 12 THEN concat(chr(10), '## Timeline', chr(10), '- began', chr(10)) ELSE '' END, '---', chr(10)) AS page FROM supplier",
    "outcomes": "SELECT doc_id AS memory_id, quality AS successful, toxic AS corrections FROM labels",
}


def _depth(name: str) -> tuple[int, int]:
    """How many views deep a view stands, and its place in the list."""
    below = [v for v in VIEWS if v != name and re.search(rf"\b{v}\b", VIEWS[name])]
    return 1 + max((_depth(v)[0] for v in below), default=0), list(VIEWS).index(name)


def with_views(sql: str) -> str:
    """Put the definitions of the views that ``sql`` names in front of it."""
    named = {v for v in VIEWS if re.search(rf"\b{v}\b", sql)}
    while True:
        inside = {v for v in VIEWS if any(v != n and re.search(rf"\b{v}\b", VIEWS[n]) for n in named)} - named
        if not inside:
            break
        named |= inside
    if not named:
        return sql
    # A view stands behind those that it reads.
    named = sorted(named, key=_depth)
    ctes = ", ".join(f"{v} AS ({VIEWS[v]})" for v in named)
    body = sql.lstrip()
    if body.upper().startswith("WITH RECURSIVE"):
        return f"WITH RECURSIVE {ctes}, {body[14:]}"
    return f"WITH {ctes}, {body[4:]}" if body.upper().startswith("WITH") else f"WITH {ctes} {body}"


def run_sql(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """Run a query over the driver's tables and the views; Parquet scans keep pushdown and pruning."""
    text = with_views(sql).replace("{", "{{").replace("}", "}}")
    needed = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in BASE if re.search(rf"\b{t}\b", text)}
    for name in needed:
        text = re.sub(rf"(?i)\b(FROM|JOIN)\s+{name}\b", rf"\1 {{{name}}}", text)
    return spark.sql(text, **needed)


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One domain table."""
    return run_sql(spark, sf_dir, f"SELECT * FROM {name}")

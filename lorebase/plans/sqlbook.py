"""Queries that are plain SQL in both engines: filters, joins, aggregates, windows, set operations, maintenance."""

from __future__ import annotations

from lorebase.sources.views import NOW, TTL

ELIGIBLE = f"lifecycle NOT IN ('cold', 'archived') AND (expires_at IS NULL OR expires_at > {NOW})"

BOOK: dict[str, str] = {
    # Scans and sources
    "scan_filter": "SELECT id, tier, category FROM memories WHERE tier = 'active' AND category = 'decision'",
    "access_counts": "SELECT memory_id, count(*) AS access_count, max(used_at) AS accessed_at FROM usage_log WHERE usage_type IN ('selected', 'used') GROUP BY memory_id",
    "count_all": "SELECT count(*) AS n FROM memories",
    "tier_ttl": f"SELECT id, tier, CASE tier WHEN 'cold' THEN created_at + {TTL['cold']} WHEN 'active' THEN created_at + {TTL['active']} END AS expires_at, CASE tier WHEN 'cold' THEN 'ephemeral' WHEN 'persist' THEN 'stable' ELSE 'active' END AS lifecycle FROM memories",
    "dedup_turn_key": "SELECT conv_id, turn, min(role) AS role, count(*) AS copies FROM conversations GROUP BY conv_id, turn",
    "last_turn": "SELECT conv_id, turn, text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role, text) AS k FROM conversations WHERE length(text) >= 20) t WHERE k = 1",
    "project_fields": "SELECT id, summary, tier FROM memories",
    # Predicates
    "scope_legacy": "SELECT id, project FROM memories WHERE project = 'p1' OR project = ''",
    "eligible_default": f"SELECT id, {ELIGIBLE} AS eligible FROM memories",
    "eligible_cold": f"SELECT id, (expires_at IS NULL OR expires_at > {NOW}) OR lifecycle = 'cold' AS eligible FROM memories",
    "like_fallback": "SELECT id, 0.5E0 AS score FROM memories WHERE translate(content, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') LIKE '%tion the%'",
    "entity_search": "SELECT id, name, kind FROM entities WHERE lower(name) LIKE '%red%' AND kind = 'part'",
    "cache_scope": "SELECT id FROM memories WHERE nullif(project, '') IS NOT DISTINCT FROM NULL AND agent IS NOT DISTINCT FROM 'src5'",
    "outbox_due": f"SELECT job_id, status FROM jobs WHERE (status IN ('pending', 'retry') AND available_at <= {NOW}) OR (status = 'processing' AND lease_until <= {NOW})",
    # Joins
    "memory_entities": "SELECT l_orderkey AS memory_id, p_partkey AS entity_id, p_name FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_size < 10",
    "entity_memories_topk": "SELECT entity_id, memory_id FROM (SELECT l_partkey AS entity_id, l_orderkey AS memory_id, row_number() OVER (PARTITION BY l_partkey ORDER BY l_shipdate DESC, l_orderkey, l_linenumber) AS k FROM lineitem) t WHERE k <= 5",
    "unlinked_memories": "SELECT m.id FROM memories m WHERE m.tier IN ('active', 'persist') AND NOT EXISTS (SELECT 1 FROM usage_log u WHERE u.memory_id = m.id) ORDER BY m.created_at DESC, m.id LIMIT 100",
    "stale_chunks": "SELECT m.id FROM memories m WHERE NOT EXISTS (SELECT 1 FROM chunk_vectors v WHERE v.memory_id = m.id AND v.model = 'model-b')",
    "orphan_chunks": "SELECT v.chunk_id FROM chunk_vectors v LEFT JOIN (SELECT id FROM memories WHERE lifecycle <> 'archived') m ON v.memory_id = m.id WHERE m.id IS NULL",
    "integrity_orphans": "SELECT 'usage' AS relation, count(*) AS orphans FROM usage_log u WHERE NOT EXISTS (SELECT 1 FROM memories m WHERE m.id = u.memory_id) UNION ALL SELECT 'edge', count(*) FROM edges x WHERE NOT EXISTS (SELECT 1 FROM entities e WHERE e.id = x.dst)",
    "session_participants": "SELECT DISTINCT u.session_id, u.agent_id, n.n_name FROM usage_log u JOIN nation n ON n.n_nationkey = u.agent_id",
    "comention_edges": "SELECT DISTINCT a.l_partkey AS src, b.l_partkey AS dst FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber < b.l_linenumber WHERE a.l_partkey <> b.l_partkey",
    "typed_edges": "SELECT DISTINCT a.l_suppkey AS src, b.l_partkey AS dst, a.l_linenumber % 5 AS kind FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_partkey <> b.l_partkey WHERE a.l_linenumber % 5 <> 0 AND a.l_linenumber = 1",
    "fk_repair": "SELECT count(*) AS purged FROM usage_log u LEFT JOIN memories m ON m.id = u.memory_id WHERE m.id IS NULL",
    # Aggregates
    "operational_stats": "SELECT s.status, coalesce(n, 0) AS n FROM (SELECT 'pending' AS status UNION ALL SELECT 'retry' UNION ALL SELECT 'processing' UNION ALL SELECT 'completed' UNION ALL SELECT 'dead') s LEFT JOIN (SELECT status, count(*) AS n FROM jobs GROUP BY status) j ON j.status = s.status",
    "pack_items": "SELECT l_orderkey AS pack_id, l_returnflag AS disposition, count(*) AS n FROM lineitem GROUP BY l_orderkey, l_returnflag",
    "embedding_models": "SELECT count(DISTINCT model) AS models, min(model) AS first_model, max(model) AS last_model FROM chunk_vectors",
    # Windows and ordering
    "event_sequence": "SELECT session_id, usage_id, row_number() OVER (PARTITION BY session_id ORDER BY used_at, usage_id) AS seq FROM usage_log",
    "entity_facts": "SELECT claim_key, observed_at, claim_value, fact_id FROM facts WHERE entity_id = 42 ORDER BY claim_key, observed_at DESC",
    "recent_topk": "SELECT id, accessed_at FROM memories ORDER BY accessed_at DESC, id LIMIT 20",
    # Sets and graph
    "edges_both": "SELECT src, dst, kind FROM edges WHERE src = 's3' UNION SELECT src, dst, kind FROM edges WHERE dst = 'p10'",
    # Maintenance
    "consolidate": f"SELECT id, CASE WHEN lifecycle NOT IN ('pinned', 'cold', 'archived') AND expires_at < {NOW} THEN 'cold' ELSE lifecycle END AS lifecycle FROM memories",
    "dead_letters": "SELECT job_id, 'pending' AS status, 0 AS attempts FROM jobs WHERE status = 'dead'",
    "retry_delay": "SELECT job_id, least(300, CAST(power(2, least(attempts, 8)) AS BIGINT)) AS delay FROM jobs",
    "scope_mismatch": "SELECT t.task_id, t.owner_id FROM tasks t JOIN agents a ON a.agent_id = t.owner_id JOIN customer c ON c.c_custkey = t.task_id WHERE a.workspace_id <> CASE c.c_mktsegment WHEN 'BUILDING' THEN 0 WHEN 'MACHINERY' THEN 1 WHEN 'HOUSEHOLD' THEN 2 ELSE 3 END",
    "import_captures": "SELECT c.conv_id, c.turn, m.id AS memory_id FROM conversations c LEFT JOIN memories m ON m.id = c.conv_id * 3",
}

"""SQL queries on notes: gates, entities, edges, facts, identifiers.

The text is Spark SQL; ``catalog`` rewrites the few functions that DuckDB spells otherwise.  ``sentences(x)`` and
``rest(x)`` (an array without its first element) and ``squeeze(x)`` (runs of blanks to one) stand for expressions
that differ between the two.
"""

from __future__ import annotations

from lorebase.sources.views import CATEGORIES

#: Words that the rule gate looks for, as substrings of the lower-cased text.
GATE_PERSIST = ("decided", "decision", "chose", "confirmed", "ruling", "defined", "architected")
GATE_ACTIVE = ("implementing", "working on", "building", "shipping", "fixing", "testing", "deploy")
GATE_SKIP = ("ok", "thanks", "got it", "sure", "yep", "cool", "nice", "lol", "haha")

#: Words that tell the type of an unknown entity, first match wins.
TYPE_WORDS = {
    "project": ("project", "repo", "repository", "codebase"),
    "person": ("person", "he", "she", "they", "him", "her"),
    "decision": ("decided", "decision", "chose", "ruling"),
    "concept": ("concept", "pattern", "framework", "architecture"),
    "tool": ("tool", "library", "service", "database"),
}

#: Phrases that name an edge, first match wins.
EDGE_WORDS = {
    "decided_about": "decided|decides|chose|confirmed|ruling",
    "works_on": "works?[ ]+on|implementing|building|shipping",
    "depends_on": "depends?[ ]+on|requires?|needs?|uses?",
    "related_to": "related[ ]+to|connected[ ]+to|linked[ ]+to",
}

#: Patterns of claims: who, and what of them.
CLAIMS = {
    "description": "(?i)([A-Z][A-Za-z0-9_-]+)[ ]+(?:is|was)[ ]+([^.!?]{3,160})",
    "uses": "(?i)([A-Z][A-Za-z0-9_-]+)[ ]+uses[ ]+([^.!?]{2,120})",
    "technology": "(?i)([A-Z][A-Za-z0-9_-]+)[ ]+switched[ ]+to[ ]+([^.!?]{2,120})",
    "decision": "(?i)([A-Z][A-Za-z0-9_-]+)[ ]+decided[ ]+([^.!?]{3,160})",
}

NOT_NAMES = ("the", "and", "but", "for", "this", "that", "with", "from", "not", "yes")


def _any(column, words):
    return "(" + " OR ".join(f"{column} LIKE '%{w}%'" for w in words) + ")"


def _listed(words):
    return "(" + ", ".join(f"'{w}'" for w in words) + ")"


def _gate(skip_short, persist, active, skip, other):
    return (
        f"CASE WHEN length(t) < 5 THEN {skip_short} WHEN {_any('t', GATE_PERSIST)} THEN {persist} WHEN {_any('t', GATE_ACTIVE)} THEN {active} "
        f"WHEN t IN {_listed(GATE_SKIP)} OR length(t) < 15 THEN {skip} ELSE {other} END"
    )


def _claim(key, pattern):
    found = f"SELECT id, explode(regexp_extract_all(note, '{pattern}', 0)) AS m FROM notes"
    return f"SELECT id, '{key}' AS claim_key, lower(regexp_extract(m, '{pattern}', 1)) AS name, squeeze(regexp_extract(m, '{pattern}', 2)) AS claim_value FROM ({found}) f_{key}"


_tokens = "SELECT DISTINCT id, w FROM (SELECT id, explode(regexp_extract_all(lower(note), '[a-z0-9_]+', 0)) AS w FROM notes) t0"
_known = f"SELECT DISTINCT t.id, n.note, r.entity_id, t.w AS name FROM ({_tokens}) t JOIN registry r ON r.name = t.w JOIN notes n ON n.id = t.id"
_words = "SELECT id, explode(rest(split(s, ' '))) AS w FROM (SELECT id, explode(sentences(note)) AS s FROM notes) s0"
_proper = f"SELECT DISTINCT id, lower(c) AS name FROM (SELECT id, btrim(w, '.,;:!?\")') AS c FROM ({_words}) w0) c0 WHERE regexp_extract(c, '^[A-Z]', 0) <> '' AND length(c) > 2 AND lower(c) NOT IN {_listed(NOT_NAMES)}"
_edge = "CASE " + " ".join(f"WHEN regexp_extract(s, '(^|[^a-z0-9_])({p})([^a-z0-9_]|$)', 0) <> '' THEN '{k}'" for k, p in EDGE_WORDS.items()) + " ELSE 'mentions' END"

BOOK: dict[str, str] = {
    # Gates
    "gate_fallback": f"SELECT id, {_gate(*map(repr, ('SKIP', 'PERSIST', 'ACTIVE', 'SKIP', 'COLD')))} AS decision, {_gate('0.9E0', '0.7E0', '0.7E0', '0.8E0', '0.5E0')} AS confidence FROM (SELECT id, lower(trim(note)) AS t FROM notes) n",
    # Entities
    "entity_known": f"SELECT t.id, r.entity_id, min(r.kind) AS kind, max(CASE WHEN r.is_alias = 0 THEN 0.9E0 ELSE 0.85E0 END) AS confidence FROM ({_tokens}) t JOIN registry r ON r.name = t.w GROUP BY t.id, r.entity_id",
    "entity_proper": f"SELECT id, name, 0.5E0 AS confidence FROM ({_proper}) p",
    "edge_type": f"SELECT id, entity_id, name, {_edge} AS edge FROM (SELECT id, entity_id, name, lower(coalesce(nullif(regexp_extract(note, concat('(?i)[^.!?]*', name, '[^.!?]*[.!?]+'), 0), ''), note)) AS s FROM ({_known}) k) e",
    "snippet": f"SELECT id, name, CASE WHEN p = 0 THEN substr(note, 1, 200) ELSE concat(CASE WHEN p > 51 THEN '...' ELSE '' END, trim(substr(note, greatest(p - 50, 1), least(p - 1, 50) + length(name) + 50)), CASE WHEN p + length(name) + 49 < length(note) THEN '...' ELSE '' END) END AS snippet FROM (SELECT *, instr(lower(note), name) AS p FROM ({_known}) k) s",
    "classify_unknown": "SELECT id, CASE " + " ".join(f"WHEN {_any('t', w)} THEN '{k}'" for k, w in TYPE_WORDS.items()) + " ELSE 'concept' END AS kind FROM (SELECT id, lower(note) AS t FROM notes) n",
    "entity_upsert": f"SELECT p.name, CASE WHEN r.entity_id IS NULL THEN 'create' WHEN r.is_alias = 1 THEN 'alias' ELSE 'touch' END AS action, coalesce(r.entity_id, p.name) AS entity_id FROM (SELECT DISTINCT name FROM ({_proper}) q) p LEFT JOIN registry r ON r.name = p.name",
    "wire_graph": f"SELECT DISTINCT a.id, a.entity_id AS src, b.entity_id AS dst FROM ({_known}) a JOIN ({_known}) b ON a.id = b.id AND a.entity_id <> b.entity_id",
    "fact_extract": "SELECT f.id, r.entity_id, f.claim_key, min(f.claim_value) AS claim_value, 0.8E0 AS confidence, concat('note:', CAST(f.id AS VARCHAR(20)), '|', r.entity_id, '|', f.claim_key, '|', lower(f.claim_value)) AS derivation_key FROM ("
    + " UNION ALL ".join(_claim(k, v) for k, v in CLAIMS.items())
    + ") f JOIN registry r ON r.name = f.name WHERE f.claim_value <> '' GROUP BY f.id, r.entity_id, f.claim_key, lower(f.claim_value)",
    "timeline_build": "SELECT entity_id, listagg(line, chr(10)) WITHIN GROUP (ORDER BY line DESC) AS timeline FROM (SELECT DISTINCT entity_id, concat('- **', CAST(observed_at AS VARCHAR(10)), '** | ', claim_value, ' [Source: ', claim_key, ']') AS line FROM facts) t GROUP BY entity_id",
    "backlink_audit": "SELECT l.o_custkey AS entity_id, l.o_orderkey AS memory_id FROM orders l LEFT JOIN (SELECT o_custkey, listagg(concat('[', CAST(o_orderkey AS VARCHAR(20)), ']'), ' ') WITHIN GROUP (ORDER BY o_orderkey) AS timeline FROM orders WHERE o_orderstatus = 'F' GROUP BY o_custkey) t ON t.o_custkey = l.o_custkey WHERE instr(coalesce(t.timeline, ''), concat('[', CAST(l.o_orderkey AS VARCHAR(20)), ']')) = 0",
    "entity_markdown": "SELECT id, concat('entities/', CASE kind WHEN 'person' THEN 'people' WHEN 'part' THEN 'tools' ELSE 'concepts' END, '/', id, '.md') AS path, concat('# ', name, chr(10), chr(10), '## Executive Summary', chr(10), chr(10), kind, ' ', name, chr(10), '---', chr(10)) AS page FROM entities",
    # Identifiers
    "event_id": "SELECT conv_id, turn, role, coalesce(CASE WHEN turn % 4 = 0 THEN concat('given_', CAST(conv_id AS VARCHAR(20))) END, concat('nats_', sha2(concat(coalesce(role, ''), '|', CAST(conv_id AS VARCHAR(20)), '|', CAST(turn AS VARCHAR(20)), '|', coalesce(text, '')), 256))) AS event_id FROM conversations",
    "stable_digest": "SELECT id, concat('sha256:', sha2(concat('{\"agent\":\"', coalesce(agent, ''), '\",\"category\":\"', category, '\",\"id\":', CAST(id AS VARCHAR(20)), '}'), 256)) AS digest FROM memories",
    "reference_id": "SELECT id, concat('ref_', substr(sha2(CAST(id AS VARCHAR(20)), 256), 1, 24)) AS reference_id FROM memories",
    "repo_id": "SELECT s_suppkey, concat('git:', substr(sha2(regexp_replace(regexp_replace(url, '://[^/@]*@', '://'), '[.]git$', ''), 256), 1, 24)) AS repo_id FROM (SELECT s_suppkey, concat('https://', CASE WHEN s_suppkey % 2 = 0 THEN 'user:word@' ELSE '' END, 'git.example/', lower(s_name), CASE WHEN s_suppkey % 3 = 0 THEN '.git' ELSE '' END) AS url FROM supplier) u",
}

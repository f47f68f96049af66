"""Queries on entities, their pages and contexts, and on embedding in batches; SQL written from the rules."""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from lorebase.functions import text as T
from lorebase.operators import entities, lifecycle, packs, search
from lorebase.sources.views import view


def entity_resolve(spark, d):
    """What each word of a note names: by slug, then by name, by alias, by the aliases in the book."""
    words = view(spark, d, "notes").select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower("note"), F.lit("[a-z0-9_]+"), F.lit(0)))).alias("w")).distinct()
    r = view(spark, d, "registry")
    by_slug = r.select(F.col("entity_id").alias("slug"), F.col("entity_id").alias("_1")).distinct()
    names = lambda flag, c: r.where(F.col("is_alias") == flag).select(F.col("name").alias("w"), F.col("entity_id").alias(c))
    book = view(spark, d, "entity_book").select(F.col("name").alias("_4"), F.explode(F.array_remove(F.split(F.lower("aliases"), "[|]"), "")).alias("w"))
    book = book.groupBy("w").agg(F.min("_4").alias("_4"))
    found = words.withColumn("slug", T.slugify(F.col("w"))).join(by_slug, "slug", "left").join(names(0, "_2"), "w", "left").join(names(1, "_3"), "w", "left").join(book, "w", "left")
    how = F.when(F.col("_1").isNotNull(), "slug").when(F.col("_2").isNotNull(), "name").when(F.col("_3").isNotNull(), "alias").when(F.col("_4").isNotNull(), "book").otherwise("none")
    return found.select("w", F.coalesce("_1", "_2", "_3", "_4").alias("entity_id"), how.alias("found_by"))


def graph_context(spark, d):
    """The edges at each topic, as lines with arrows."""
    e = view(spark, d, "topic_edges").where("src <> dst")
    line = F.concat("src", F.lit(" --> "), "dst").alias("line")
    at = e.select(F.col("src").alias("topic"), line).unionByName(e.select(F.col("dst").alias("topic"), line)).distinct()
    return at.groupBy("topic").agg(F.array_join(F.sort_array(F.collect_list("line")), "\n").alias("context"))


def context_v1(spark, d):
    """For each project five open threads, and for every entity its current facts."""
    m = view(spark, d, "memories").where("lifecycle = 'active'")
    order = Window.partitionBy("project").orderBy(F.desc("accessed_at"), "id")
    threads = m.withColumn("k", F.row_number().over(order)).where("k <= 5").select("project", F.lit("thread").alias("kind"), "k", F.substring("content", 1, 200).alias("line"))
    facts = lifecycle.supersession(view(spark, d, "facts")).where("superseded_at IS NULL")
    own = Window.partitionBy("entity_id").orderBy("claim_key", F.desc("observed_at"), "fact_id")
    known = facts.withColumn("k", F.row_number().over(own)).select(F.concat(F.lit("p"), F.col("entity_id").cast("string")).alias("project"), F.lit("fact").alias("kind"), "k", F.concat_ws(": ", "claim_key", "claim_value").alias("line"))
    return threads.unionByName(known)


def markdown_import(spark, d):
    """Summaries from pages that were edited after the entity was saved, where they say something else."""
    p = view(spark, d, "entity_pages")
    truth = F.regexp_replace(F.regexp_extract("page", r"## Executive Summary\n+((?:(?!##|---)[^\n]*\n)*)", 1), r"^\s+|\s+$", "")
    return p.where("edited_at > updated_at").select("id", truth.alias("truth"), "known").where("truth <> '' AND truth <> known").select("id", "truth")


def latest_checkpoint(spark, d):
    """Newest version of each skill, with the draft that it came from."""
    v = packs.skill_versions(view(spark, d, "skill_drafts"))
    return v.groupBy("skill_id").agg(F.max("version").alias("version"), F.max("draft_id").alias("draft_id"))


def _hashed(texts: list[str]) -> np.ndarray:
    raw = np.stack([np.frombuffer(hashlib.sha256(t.encode()).digest(), np.uint8) for t in texts]) / 127.5 - 1
    return raw / np.linalg.norm(raw, axis=1, keepdims=True)


def batch_embed(spark, d):
    """Vectors from a provider that takes texts in batches."""
    v = search.embedded(view(spark, d, "memories"), _hashed, 32)
    return v.select("id", F.posexplode("vec").alias("dim", "x")).select("id", "dim", F.round("x", 6).alias("x"))


def _noted(spark, d):
    return view(spark, d, "notes").select("id", F.col("note").alias("text")), view(spark, d, "entity_names")


def entity_detect(spark, d):
    """Entities of every note, by names of any length, in order, with what the note says of them."""
    return entities.detected(*_noted(spark, d))


def entity_wiring(spark, d):
    """Edges that the notes wire, each as the first of them gives it."""
    return entities.wired(*_noted(spark, d))[1]


def entity_created(spark, d):
    """Entities that the notes are the first to name."""
    return entities.wired(*_noted(spark, d))[0]


QUERIES = {f.__name__: f for f in (entity_resolve, graph_context, context_v1, markdown_import, latest_checkpoint, batch_embed, entity_detect, entity_wiring, entity_created)}

_DETECTED = r"""n AS (SELECT id, coalesce(note, '') AS t FROM notes),
hit AS (SELECT id, entity_id, kind, alias, registered, rank, name, CASE WHEN registered + alias = 0 THEN 0.9e0 WHEN registered + alias = 2 THEN 0.8e0 ELSE 0.85e0 END AS confidence FROM n JOIN entity_names ON regexp_matches(lower(t), '(^|[^\p{L}\p{N}_])' || lower(name) || '([^\p{L}\p{N}_]|$)')),
known AS (SELECT DISTINCT ON (id, entity_id) *, false AS is_new FROM hit ORDER BY id, entity_id, confidence DESC, alias, rank),
sent AS (SELECT id, unnest(l) AS s, generate_subscripts(l, 1) AS si FROM (SELECT id, string_split(regexp_replace(t, '([.!?])\s+', '\1' || chr(57344), 'g'), chr(57344)) AS l FROM n)),
word AS (SELECT id, si, unnest(w)[1:] AS w, generate_subscripts(w, 1) AS wi FROM (SELECT id, si, list_filter(string_split_regex(s, '\s+'), lambda x: x <> '') AS w FROM sent)),
bare AS (SELECT id, si, wi, trim(w, '.,;:!?")''(') AS w FROM word WHERE wi > 1),
noun AS (SELECT id, lower(w) AS name, min((si, wi)) AS place FROM bare WHERE regexp_matches(w, '^\p{Lu}') AND length(w) > 2 AND lower(w) NOT IN ('the', 'and', 'but', 'for', 'this', 'that', 'with', 'from', 'not', 'yes') GROUP BY id, lower(w)),
called AS (SELECT p.id, p.name, p.place, e.entity_id AS e, e.kind FROM noun p LEFT JOIN (SELECT DISTINCT ON (lower(name)) lower(name) AS name, entity_id, kind FROM entity_names ORDER BY lower(name), registered, alias, rank) e USING (name)),
both_kinds AS (SELECT id, registered AS o, rank, NULL AS place, entity_id, kind, confidence, is_new, lower(name) AS name FROM known
 UNION ALL SELECT id, 2, 0, place, coalesce(e, name), kind, 0.5e0, e IS NULL, name FROM called c WHERE NOT EXISTS (SELECT 1 FROM known k WHERE k.id = c.id AND k.entity_id = coalesce(c.e, c.name))),
said AS (SELECT b.*, n.t, coalesce((SELECT first(lower(s) ORDER BY i) FROM (SELECT unnest(x) AS s, generate_subscripts(x, 1) AS i FROM (SELECT regexp_extract_all(n.t, '[^.!?]+[.!?]+') AS x)) WHERE regexp_matches(lower(s), '(^|[^\p{L}\p{N}_])' || b.name || '([^\p{L}\p{N}_]|$)')), lower(n.t)) AS told FROM both_kinds b JOIN n USING (id)),
found AS (SELECT id, row_number() OVER (PARTITION BY id ORDER BY o, rank, place, entity_id) AS turn, entity_id, confidence, is_new,
 coalesce(kind, CASE WHEN regexp_matches(lower(t), 'project|repo|codebase') THEN 'project' WHEN regexp_matches(lower(t), 'person|he|they|him') THEN 'person' WHEN regexp_matches(lower(t), 'decided|decision|chose|ruling') THEN 'decision' WHEN regexp_matches(lower(t), 'concept|pattern|framework|architecture') THEN 'concept' WHEN regexp_matches(lower(t), 'tool|library|service|database') THEN 'tool' ELSE 'concept' END) AS kind,
 CASE WHEN regexp_matches(told, '\b(decided|decides|chose|confirmed|ruling)\b') THEN 'decided_about' WHEN regexp_matches(told, '\b(works? +on|implementing|building|shipping)\b') THEN 'works_on' WHEN regexp_matches(told, '\b(depends? +on|requires?|needs?|uses?)\b') THEN 'depends_on' WHEN regexp_matches(told, '\b(related|connected|linked) +to\b') THEN 'related_to' ELSE 'mentions' END AS edge FROM said)""".replace("\\\\", "\\")

ORACLE_SQL = {
    "entity_detect": f"WITH {_DETECTED} SELECT id, turn::INT AS turn, entity_id, kind, confidence, is_new, edge FROM found",
    "entity_created": f"WITH {_DETECTED} SELECT DISTINCT ON (entity_id) entity_id, kind, CASE WHEN confidence >= 0.7 THEN 'active' ELSE 'cold' END AS tier, id AS memory_id FROM found WHERE is_new ORDER BY entity_id, id",
    "entity_wiring": f"""WITH {_DETECTED}, pairs AS (SELECT a.id, a.entity_id AS src, b.entity_id AS dst, a.edge, a.turn AS i, b.turn AS j, a.confidence AS x, b.confidence AS y FROM found a JOIN found b ON a.id = b.id AND a.entity_id <> b.entity_id),
made AS (SELECT src, dst, edge AS kind, x AS confidence, id FROM pairs WHERE edge <> 'mentions' UNION ALL SELECT src, dst, 'mentions', least(x, y), id FROM pairs WHERE i <= 10 AND j <= 10)
SELECT DISTINCT ON (src, dst, kind) src, dst, kind, confidence, id AS memory_id FROM made ORDER BY src, dst, kind, id, confidence""",
    "entity_resolve": r"""WITH words AS (SELECT DISTINCT unnest(regexp_extract_all(lower(note), '[a-z0-9_]+')) AS w FROM notes), book AS (SELECT lower(a) AS w, min(name) AS e FROM (SELECT name, unnest(string_split(aliases, '|')) AS a FROM entity_book) x WHERE a <> '' GROUP BY 1),
hits AS (SELECT w, (SELECT min(entity_id) FROM registry WHERE entity_id = replace(w, '_', '')) AS a, (SELECT min(entity_id) FROM registry r WHERE r.name = w AND is_alias = 0) AS b, (SELECT min(entity_id) FROM registry r WHERE r.name = w AND is_alias = 1) AS c, (SELECT e FROM book WHERE book.w = words.w) AS e FROM words)
SELECT w, coalesce(a, b, c, e) AS entity_id, CASE WHEN a IS NOT NULL THEN 'slug' WHEN b IS NOT NULL THEN 'name' WHEN c IS NOT NULL THEN 'alias' WHEN e IS NOT NULL THEN 'book' ELSE 'none' END AS found_by FROM hits""",
    "graph_context": "SELECT topic, string_agg(line, chr(10) ORDER BY line) AS context FROM (SELECT v.topic, concat(e.src, ' --> ', e.dst) AS line FROM (SELECT src AS topic FROM topic_edges UNION SELECT dst FROM topic_edges) v JOIN topic_edges e ON v.topic IN (e.src, e.dst) WHERE e.src <> e.dst) q GROUP BY topic",
    "context_v1": """WITH n AS (SELECT *, lead(claim_value) OVER (PARTITION BY entity_id, claim_key ORDER BY observed_at, fact_id) AS nxt FROM facts)
SELECT project, 'thread' AS kind, k, content[:200] AS line FROM (SELECT *, row_number() OVER (PARTITION BY project ORDER BY accessed_at DESC, id) AS k FROM memories WHERE lifecycle = 'active') t WHERE k <= 5
UNION ALL SELECT concat('p', entity_id), 'fact', row_number() OVER (PARTITION BY entity_id ORDER BY claim_key, observed_at DESC, fact_id), concat(claim_key, ': ', claim_value) FROM n WHERE nxt IS NULL OR nxt = claim_value""",
    "markdown_import": "SELECT id, truth FROM (SELECT id, known, trim(split_part(split_part(split_part(page, '## Executive Summary' || chr(10), 2), '---', 1), '##', 1), ' ' || chr(10)) AS truth FROM entity_pages WHERE updated_at < edited_at) p WHERE truth NOT IN ('', known)",
    "latest_checkpoint": "WITH v AS (SELECT skill_id, draft_id, concat(content, '|', evidence) AS c, lag(concat(content, '|', evidence)) OVER (PARTITION BY skill_id ORDER BY draft_id) AS b FROM skill_drafts) SELECT skill_id, sum(CASE WHEN c = b THEN 0 ELSE 1 END)::BIGINT AS version, max(draft_id) AS draft_id FROM v GROUP BY skill_id",
    "batch_embed": """SELECT id, (spot - 1)::INT AS dim, round(x / size, 6) AS x FROM (SELECT id, size, unnest(v) AS x, generate_subscripts(v, 1) AS spot FROM (SELECT id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS size FROM
 (SELECT id, list_transform(range(32), lambda i: ('0x' || substr(h, i * 2 + 1, 2))::INT / 127.5e0 - 1) AS v FROM (SELECT id, sha256(coalesce(content, '')) AS h FROM memories))))""",
}

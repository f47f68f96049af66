"""Search queries: keyword, vector, fused, graph-augmented and deep, over all memories and whole queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from lorebase.functions import text as T
from lorebase.operators import graph, search
from lorebase.sources.views import NOW, view

MODEL = "model-b"


def _asked(spark, d, name="benchmark"):
    if name == "benchmark":
        return spark.read.parquet(f"{d}/benchmark.parquet").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    return view(spark, d, name).select("query_id", F.col("text").alias("query"))


def _memories(spark, d):
    return view(spark, d, "memories")


def _index(spark, d):
    """The keyword index of all memories, built by the first search of the session over these tables."""
    return search.index_of(d, _memories(spark, d))


def _requests(spark, d):
    """Searches with a scope of their own."""
    return view(spark, d, "requests").withColumnRenamed("text", "query")


def _vectors(spark, d):
    return spark.read.parquet(f"{d}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))


def _query_vectors(spark, d):
    return _vectors(spark, d).where("id % 50 = 0").select((F.col("id") / 50).cast("long").alias("query_id"), "vec")


def _links(spark, d):
    return _memories(spark, d).select("id", F.concat_ws(":", "agent", "category").alias("entity_id"))


def _chunks(spark, d):
    return view(spark, d, "chunk_vectors").withColumnRenamed("embedding", "vec")


def query_tokens(spark, d):
    return _asked(spark, d).select("query_id", F.array_join(T.query_tokens(F.col("query")), " ").alias("tokens"))


def doc_tokens(spark, d):
    tokens = _memories(spark, d).select(F.explode(T.doc_tokens(F.col("content"))).alias("token"))
    return tokens.groupBy("token").agg(F.count("*").alias("n"))


def _shown(hits):
    """Rank, score and the score as it is shown: 1 / (1 + score), which is smaller for better matches."""
    return hits.select("query_id", "id", "score", "rank", F.round(1 / (1 + F.col("score")), 6).alias("keyword_score"))


def bm25_topk(spark, d):
    return _shown(search.bm25(_memories(spark, d), _asked(spark, d), 10, _index(spark, d)))


def bm25_phrases(spark, d):
    """Terms with marks inside count where their parts stand one after another, in tf and in df."""
    return _shown(search.bm25(_memories(spark, d), _asked(spark, d, "phrase_searches"), 10, _index(spark, d)))


def bm25_scoped(spark, d):
    """Each request within its own scope; statistics are those of all memories."""
    return _shown(search.bm25(_memories(spark, d), _requests(spark, d), 10, _index(spark, d), NOW))


def bm25_filtered(spark, d):
    asked = _asked(spark, d).withColumn("tier", F.lit("active")).withColumn("category", F.lit("decision"))
    return search.bm25(_memories(spark, d), asked, 10, _index(spark, d)).select("query_id", "id", "score", "rank")


def fts_v2(spark, d):
    return search.keyword(_memories(spark, d), _asked(spark, d, "hard_searches"), 10, _index(spark, d))


def vector_topk(spark, d):
    return search.vector(_vectors(spark, d), _memories(spark, d), _query_vectors(spark, d), 10)


def _scoped_vectors(spark, d):
    return _query_vectors(spark, d).join(_requests(spark, d).drop("query"), "query_id")


def vector_scoped(spark, d):
    """The best admitted vectors of each request that has one: the scope is part of the search, not of what comes after it."""
    return search.vector(_vectors(spark, d), _memories(spark, d), _scoped_vectors(spark, d), 10, now=NOW)


def chunk_topk(spark, d):
    return search.chunked(_chunks(spark, d), _memories(spark, d), _query_vectors(spark, d), MODEL, 10)


def chunk_scoped(spark, d):
    """Best chunks first, then those whose memory the request admits."""
    return search.chunked(_chunks(spark, d), _memories(spark, d), _scoped_vectors(spark, d), MODEL, 10, now=NOW)


def vector_merge(spark, d):
    m, q = _memories(spark, d), _query_vectors(spark, d)
    return search.merged(search.vector(_vectors(spark, d), m, q), search.chunked(_chunks(spark, d), m, q, MODEL), 10)


def rrf_fuse(spark, d):
    m = _memories(spark, d)
    return search.fuse([search.bm25(m, _asked(spark, d), index=_index(spark, d)), search.vector(_vectors(spark, d), m, _query_vectors(spark, d))], m)


def search_balanced(spark, d):
    """Every list within the request's scope, and what the graph adds within its formal keys; cold memories only where asked for."""
    m = _memories(spark, d)
    return search.balanced(m, _requests(spark, d), _vectors(spark, d), _query_vectors(spark, d), _links(spark, d), view(spark, d, "topic_edges"), index=_index(spark, d), now=NOW)


def balanced_no_vector(spark, d):
    return search.balanced(_memories(spark, d), _requests(spark, d), None, None, _links(spark, d), view(spark, d, "topic_edges"), index=_index(spark, d), now=NOW)


def graph_augment(spark, d):
    """What one hop over the graph adds to each request's vector list, among what it admits."""
    m = _memories(spark, d)
    direct = search.materialize(search.vector(_vectors(spark, d), m, _scoped_vectors(spark, d), 10, now=NOW).drop("rank"), "direct")
    requests = _requests(spark, d).drop("query")
    return search.graph_augment(direct, _links(spark, d), m, view(spark, d, "topic_edges"), requests, NOW).where("by_graph").drop("by_graph")


def search_deep(spark, d):
    """Requests and their expansions, by keywords and by the vectors of their texts."""
    book = view(spark, d, "entity_book")
    entities = book.select("name", "title", F.array_remove(F.split("aliases", "[|]"), "").alias("aliases"), "truth")
    m = _memories(spark, d)
    return search.deep(
        m, _requests(spark, d), entities, _links(spark, d), view(spark, d, "topic_edges"), vectors=search.hash_embedded(m), embed=search.hash_embedded,
        index=_index(spark, d), now=NOW,
    )


def hash_embed(spark, d):
    return search.hash_embedded(_memories(spark, d)).select("id", F.posexplode("vec").alias("dim", "x")).select("id", "dim", F.round("x", 6).alias("x"))


def cosine_pairs(spark, d):
    """Cosine of each vector with the next one; vectors of label 0 are cut short, and unequal lengths give 0."""
    cut = spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", F.when(F.col("label") == 0, F.slice("embedding", 1, 10)).otherwise(F.col("embedding")).alias("vec"))
    nxt = cut.select((F.col("vec_id") - 1).alias("vec_id"), F.col("vec").alias("other"))
    dot = F.aggregate(F.zip_with("vec", "other", lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda s, x: s + x)
    size = search.norm("vec") * search.norm("other")
    fine = (F.size("vec") == F.size("other")) & (size > 0)
    return cut.join(nxt, "vec_id").select("vec_id", F.round(F.when(fine, dot / size).otherwise(0.0), 6).alias("cosine"))


def l2_normalize(spark, d):
    """Norm of each vector and whether it may be stored, with the digest of its memory's text."""
    m = _memories(spark, d).select("id", F.sha2(F.coalesce("content", F.lit("")), 256).alias("content_hash"))
    return _vectors(spark, d).join(m, "id").select("id", F.round(search.norm("vec"), 6).alias("norm"), search.normalized("vec").isNotNull().alias("valid"), "content_hash")


def neighbors_2hop(spark, d):
    """Suppliers and parts within two undirected hops of every supplier, over the edges of kind t1."""
    edges = view(spark, d, "edges").where("kind = 't1'").select("src", "dst")
    return graph.around(edges, edges.where("src LIKE 's%'").select("src").distinct(), 2)


def shortest_path(spark, d):
    """Edges on a shortest path, four hops at most, between each two topics that one hop over the graph does not join."""
    return graph.paths(view(spark, d, "topic_edges").where("src <> dst").select("src", "dst"), 4)


QUERIES = {f.__name__: f for f in (
    query_tokens, doc_tokens, bm25_topk, bm25_phrases, bm25_scoped, bm25_filtered, fts_v2, vector_topk, vector_scoped, chunk_topk, chunk_scoped, vector_merge, rrf_fuse, search_balanced, balanced_no_vector,
    graph_augment, search_deep, hash_embed, cosine_pairs, l2_normalize, neighbors_2hop, shortest_path,
)}

_stops = ", ".join(f"'{w}'" for w in T.STOPWORDS)
_tokens = lambda text: f"list_filter(string_split_regex(translate(lower(coalesce({text}, '')), '{T.MARKED}', '{T.PLAIN}'), '[^\\p{{L}}\\p{{N}}]+'), lambda t: t <> '')"
_DOC = f"toks AS (SELECT id, {_tokens('content')} AS w FROM memories)"
_BENCH = "asked AS (SELECT item_id AS query_id, text FROM benchmark)"
_BOOST = "CASE tier WHEN 'persist' THEN 1.5e0 WHEN 'active' THEN 1.0e0 WHEN 'cold' THEN 0.5e0 WHEN 'skip' THEN 0.1e0 ELSE 1.0e0 END"
_QRY = f"""q0 AS (SELECT query_id, list_filter(regexp_extract_all(text, '[A-Za-z0-9][\\p{{L}}\\p{{N}}_.-]*'), lambda t: length(t) > 1) AS a FROM asked),
q1 AS (SELECT query_id, a, list_filter(a, lambda t: lower(t) NOT IN ({_stops})) AS b FROM q0),
q2 AS (SELECT query_id, (CASE WHEN len(b) > 0 THEN b ELSE a END)[1:32] AS t FROM q1)"""
_BM25 = f"""{_DOC}, {_QRY},
terms AS (SELECT DISTINCT query_id, p FROM (SELECT query_id, {_tokens('x')} AS p FROM (SELECT query_id, unnest(t) AS x FROM q2)) WHERE len(p) > 0),
occ AS MATERIALIZED (SELECT id, unnest(w) AS token, generate_subscripts(w, 1) AS pos FROM toks),
part AS (SELECT p, unnest(p) AS token, generate_subscripts(p, 1) AS place FROM (SELECT DISTINCT p FROM terms)),
whole AS (SELECT p, id, pos - place AS start FROM occ JOIN part USING (token) GROUP BY p, id, pos - place HAVING count(*) = len(p)),
post AS MATERIALIZED (SELECT p, id, count(*) AS tf FROM whole GROUP BY p, id),
sizes AS (SELECT id, len(w) AS dl FROM toks), st AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM sizes),
idf AS (SELECT p, greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) AS idf FROM (SELECT p, count(*) AS df FROM post GROUP BY p), st),
scored AS (SELECT query_id, id, round(sum(idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) AS score FROM terms JOIN post USING (p) JOIN idf USING (p) JOIN sizes USING (id), st GROUP BY query_id, id)"""
_ALIVE = f"(m.expires_at IS NULL OR m.expires_at > {NOW})"
_ELIGIBLE = f"CASE WHEN q.include_cold THEN {_ALIVE} OR m.lifecycle = 'cold' ELSE m.lifecycle NOT IN ('cold', 'archived') AND {_ALIVE} END"
_FORMAL = f"(q.workspace_id IS NULL OR m.workspace_id = q.workspace_id) AND {_ELIGIBLE}"
_SCOPE = f"(q.project IS NULL OR m.project IN (q.project, '')) AND (q.agent IS NULL OR m.agent IN (q.agent, '')) AND {_FORMAL}"
_rank = lambda source, k, order="score DESC, id": f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY {order}) AS rank FROM {source}) WHERE rank <= {k}"
_similar = "round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])), 6) + 0.0"
_VEC = f"""sims AS (SELECT CAST(q.vec_id / 50 AS BIGINT) AS query_id, e.vec_id AS id, {_similar} AS score FROM embeddings q, embeddings e WHERE q.vec_id % 50 = 0),
vec AS (SELECT query_id, id, score * {_BOOST} AS score FROM ({_rank('sims', 500)}) JOIN memories USING (id))"""
_VEC_OWN = f"""sims AS (SELECT s.query_id, s.id, s.score FROM (SELECT CAST(q.vec_id / 50 AS BIGINT) AS query_id, e.vec_id AS id, {_similar} AS score FROM embeddings q, embeddings e WHERE q.vec_id % 50 = 0) s
 JOIN requests q USING (query_id) JOIN memories m USING (id) WHERE {_SCOPE}),
vec AS (SELECT query_id, id, score * {_BOOST} AS score FROM ({_rank('sims', 500)}) JOIN memories USING (id))"""
_CHUNKS = f"""csims AS (SELECT CAST(q.vec_id / 50 AS BIGINT) AS query_id, e.chunk_id AS id, e.memory_id, {_similar} AS score FROM embeddings q, chunk_vectors e WHERE q.vec_id % 50 = 0 AND e.model = '{MODEL}'),
parents AS (SELECT query_id, memory_id AS id, max(score) AS best FROM ({_rank('csims', 2000)}) GROUP BY ALL)"""
_CHUNK = f"{_CHUNKS}, chunk AS (SELECT query_id, id, best * {_BOOST} AS score FROM parents JOIN memories USING (id))"
_CHUNK_OWN = f"{_CHUNKS}, chunk AS (SELECT query_id, id, best * {_BOOST} AS score FROM parents JOIN requests q USING (query_id) JOIN memories m USING (id) WHERE {_SCOPE})"
_OWN = f"own AS (SELECT s.query_id, s.id, s.score FROM scored s JOIN requests q USING (query_id) JOIN memories m USING (id) WHERE {_SCOPE})"
_LINKS = "links AS (SELECT id, concat(agent, ':', category) AS entity_id, created_at FROM memories)"


def _augmented(direct: str, requests: str = "requests") -> str:
    return f"""{_LINKS},
seeded AS (SELECT DISTINCT query_id, entity_id FROM ({_rank(direct, 5)}) JOIN links USING (id)),
reached AS (SELECT * FROM seeded UNION SELECT query_id, dst FROM seeded JOIN topic_edges ON src = entity_id UNION SELECT query_id, src FROM seeded JOIN topic_edges ON dst = entity_id),
newest AS (SELECT query_id, entity_id, l.id, row_number() OVER (PARTITION BY query_id, entity_id ORDER BY l.created_at DESC, l.id) AS k FROM reached JOIN links l USING (entity_id) JOIN memories m ON m.id = l.id JOIN {requests} q USING (query_id) WHERE {_FORMAL}),
extra AS (SELECT query_id, id FROM newest WHERE k <= 5 EXCEPT SELECT query_id, id FROM {direct}),
added AS (SELECT query_id, id, low / 2 AS score FROM extra JOIN (SELECT query_id, min(score) AS low FROM {direct} GROUP BY query_id) USING (query_id))"""


def _fused(lists: str) -> str:
    return f"lists AS ({lists}), fused AS (SELECT query_id, id, round(sum({_BOOST} / (60 + rank)), 6) AS score, count(*) AS sources FROM lists JOIN memories USING (id) GROUP BY query_id, id)"


_top = lambda source: f"SELECT query_id, id, rank FROM ({_rank(source, 30)})"
_TWO = f"{_BM25}, {_VEC}, {_fused(_top('scored') + ' UNION ALL ' + _top('vec'))}"
_ASKED = "asked AS (SELECT query_id, text FROM requests)"
_TWO_OWN = f"""{_BM25}, {_OWN}, {_VEC_OWN}, {_fused(_top('own') + ' UNION ALL ' + _top('vec') + ' UNION ALL SELECT * FROM (' + _top('own') + ') WHERE query_id NOT IN (SELECT CAST(vec_id / 50 AS BIGINT) FROM embeddings WHERE vec_id % 50 = 0)')}"""
_ONE_TWICE = f"{_BM25}, {_OWN}, {_fused(_top('own') + ' UNION ALL ' + _top('own'))}"
_BOTH = "everything AS (SELECT query_id, id, score, false AS by_graph FROM fused UNION ALL SELECT query_id, id, score, true FROM added)"
_WIDER = r"""found AS (SELECT query_id, text, spot, title, string_split(aliases, '|') AS aliases, trim(truth) AS truth FROM
 (SELECT query_id, text, unnest(t) AS token, generate_subscripts(t, 1) AS spot FROM (SELECT query_id, text, regexp_extract_all(text, '[A-Za-z][\w.-]{2,}') AS t FROM requests)) JOIN entity_book ON name = lower(rtrim(token, '.'))),
said AS (SELECT query_id, text, spot, 0 AS part, [title] AS w FROM found UNION ALL SELECT query_id, text, spot, 1, list_filter(aliases, lambda x: x <> '')[1:3] FROM found
 UNION ALL SELECT query_id, text, spot, 2, string_split_regex(truth, '\s+')[1:12] FROM found WHERE truth <> ''),
one AS (SELECT query_id, text, spot, part, unnest(w) AS word, generate_subscripts(w, 1) AS k FROM said),
once AS (SELECT query_id, text, word, min(spot * 1000 + part * 100 + k) AS place FROM one GROUP BY ALL),
wider AS (SELECT query_id, text, string_agg(word, ' ' ORDER BY place) AS wide FROM once GROUP BY query_id, text),
asked AS (SELECT query_id * 2 AS query_id, text FROM requests UNION ALL SELECT query_id * 2 + 1, wide FROM wider WHERE lower(wide) <> lower(text)),
runs_of AS (SELECT a.query_id, r.project, r.agent, r.workspace_id, r.include_cold FROM asked a JOIN requests r ON r.query_id = a.query_id // 2)"""
_fold = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_byte = "('0x' || substr(h, i * 2 + 1, 2))::INT / 127.5e0 - 1"

_hop = lambda n: (
    f"l{n} AS (SELECT start, dst AS id, min(concat(path, '>', dst)) AS path, {n} AS distance FROM l{n - 1} JOIN b ON b.src = l{n - 1}.id WHERE NOT EXISTS (SELECT 1 FROM ("
    + " UNION ALL ".join(f"SELECT start, id FROM l{k}" for k in range(n))
    + f") r WHERE r.start = l{n - 1}.start AND r.id = b.dst) GROUP BY start, dst)"
)
_PATHS = f"""WITH b AS (SELECT src, dst FROM topic_edges WHERE src <> dst UNION SELECT dst, src FROM topic_edges WHERE src <> dst),
l0 AS (SELECT DISTINCT src AS start, src AS id, src AS path, 0 AS distance FROM b), {", ".join(map(_hop, range(1, 5)))}
SELECT * FROM l2 UNION ALL SELECT * FROM l3 UNION ALL SELECT * FROM l4"""

ORACLE_SQL = {
    "query_tokens": f"WITH {_BENCH}, {_QRY} SELECT query_id, array_to_string(t, ' ') AS tokens FROM q2",
    "doc_tokens": f"WITH {_DOC} SELECT token, count(*) AS n FROM (SELECT unnest(w) AS token FROM toks) GROUP BY token",
    "bm25_topk": f"WITH {_BENCH}, {_BM25} SELECT query_id, id, score, rank, round(1 / (1 + score), 6) AS keyword_score FROM ({_rank('scored', 10)})",
    "bm25_phrases": f"WITH asked AS (SELECT * FROM phrase_searches), {_BM25} SELECT query_id, id, score, rank, round(1 / (1 + score), 6) AS keyword_score FROM ({_rank('scored', 10)})",
    "bm25_scoped": f"WITH {_ASKED}, {_BM25}, {_OWN} SELECT query_id, id, score, rank, round(1 / (1 + score), 6) AS keyword_score FROM ({_rank('own', 10)})",
    "bm25_filtered": f"WITH {_BENCH}, {_BM25}, kept AS (SELECT s.* FROM scored s JOIN memories m USING (id) WHERE tier = 'active' AND category = 'decision') SELECT query_id, id, score, rank FROM ({_rank('kept', 10)})",
    "fts_v2": f"""WITH asked AS (SELECT * FROM hard_searches), {_BM25}, hits AS (SELECT s.*, accessed_at FROM scored s JOIN memories USING (id)),
likes AS (SELECT query_id, id, 0.5e0 AS score, accessed_at FROM asked, memories WHERE query_id NOT IN (SELECT query_id FROM scored)
 AND ({_fold.format('content')} LIKE concat('%', {_fold.format('text')}, '%') OR {_fold.format('summary')} LIKE concat('%', {_fold.format('text')}, '%')))
SELECT query_id, id, score, rank FROM ({_rank('(SELECT * FROM hits UNION ALL SELECT query_id, id, score, accessed_at FROM likes)', 10, 'score DESC, accessed_at DESC, id')})""",
    "vector_topk": f"WITH {_VEC} SELECT query_id, id, score, rank FROM ({_rank('vec', 10)})",
    "chunk_topk": f"WITH {_CHUNK} SELECT query_id, id, score, rank FROM ({_rank('chunk', 10)})",
    "vector_scoped": f"WITH {_VEC_OWN} SELECT query_id, id, score, rank FROM ({_rank('vec', 10)})",
    "chunk_scoped": f"WITH {_CHUNK_OWN} SELECT query_id, id, score, rank FROM ({_rank('chunk', 10)})",
    "vector_merge": f"""WITH {_VEC}, {_CHUNK}, both_kinds AS (SELECT query_id, id, score, 'whole' AS origin FROM ({_rank('vec', 30)}) UNION ALL SELECT query_id, id, score, 'chunk' FROM ({_rank('chunk', 30)})),
best AS (SELECT * FROM both_kinds QUALIFY row_number() OVER (PARTITION BY query_id, id ORDER BY score DESC, origin DESC) = 1) SELECT query_id, id, score, origin, rank FROM ({_rank('best', 10)})""",
    "rrf_fuse": f"WITH {_BENCH}, {_TWO} SELECT query_id, id, score, sources FROM fused",
    "search_balanced": f"WITH {_ASKED}, {_TWO_OWN}, {_augmented('fused')}, {_BOTH} SELECT query_id, id, score, by_graph, rank FROM ({_rank('everything', 20)})",
    "balanced_no_vector": f"WITH {_ASKED}, {_ONE_TWICE}, {_augmented('fused')}, {_BOTH} SELECT query_id, id, score, by_graph, rank FROM ({_rank('everything', 20)})",
    "graph_augment": f"WITH {_VEC_OWN}, direct AS (SELECT query_id, id, score FROM ({_rank('vec', 10)})), {_augmented('direct')} SELECT query_id, id, score FROM added",
    "search_deep": f"""WITH {_WIDER}, {_BM25}, own AS (SELECT s.query_id, s.id, s.score FROM scored s JOIN runs_of q USING (query_id) JOIN memories m USING (id) WHERE {_SCOPE}),
bytes AS (SELECT id, list_transform(range(32), lambda i: {_byte}) AS v FROM (SELECT id, sha256(coalesce(content, '')) AS h FROM memories)),
asked_bytes AS (SELECT query_id, list_transform(range(32), lambda i: {_byte}) AS v FROM (SELECT query_id, sha256(text) AS h FROM asked)),
sims AS (SELECT query_id, m.id, round(list_cosine_similarity(a.v, b.v), 6) + 0.0 AS score FROM asked_bytes a JOIN runs_of q USING (query_id), bytes b JOIN memories m USING (id) WHERE {_SCOPE}),
vec AS (SELECT query_id, id, score * {_BOOST} AS score FROM ({_rank('sims', 500)}) JOIN memories USING (id)),
{_fused(_top('own') + ' UNION ALL ' + _top('vec'))}, {_augmented('fused', 'runs_of')}, {_BOTH}, runs AS ({_rank('everything', 30)}),
again AS (SELECT query_id // 2 AS query_id, id, round(sum({_BOOST} / (60 + rank)), 6) AS score FROM runs JOIN memories USING (id) GROUP BY ALL) SELECT query_id, id, score, rank FROM ({_rank('again', 10)})""",
    "hash_embed": f"""SELECT id, (spot - 1)::INT AS dim, round(x / size, 6) AS x FROM (SELECT id, size, unnest(v) AS x, generate_subscripts(v, 1) AS spot FROM
 (SELECT id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS size FROM (SELECT id, list_transform(range(32), lambda i: {_byte}) AS v FROM (SELECT id, sha256(coalesce(content, '')) AS h FROM memories))))""",
    "cosine_pairs": """WITH v AS (SELECT vec_id, CAST(CASE WHEN label = 0 THEN embedding[1:10] ELSE embedding END AS DOUBLE[]) AS x FROM embeddings)
SELECT a.vec_id, CASE WHEN len(a.x) <> len(b.x) THEN 0.0e0 ELSE round(list_cosine_similarity(a.x, b.x), 6) END AS cosine FROM v a JOIN v b ON b.vec_id = a.vec_id + 1""",
    "l2_normalize": "SELECT vec_id AS id, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 6) AS norm, len(embedding) > 0 AND list_max(list_transform(embedding, lambda x: abs(x))) > 0 AS valid, sha256(coalesce(content, '')) AS content_hash FROM embeddings JOIN memories ON id = vec_id",
    "neighbors_2hop": """WITH e AS (SELECT src, dst FROM edges WHERE kind = 't1'), b AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e), s AS (SELECT DISTINCT src FROM e WHERE src LIKE 's%'),
h AS (SELECT src AS start, src AS id, 0 AS distance FROM s UNION ALL SELECT s.src, b.dst, 1 FROM s JOIN b USING (src) UNION ALL SELECT s.src, c.dst, 2 FROM s JOIN b USING (src) JOIN b c ON c.src = b.dst)
SELECT start, id, min(distance) AS distance FROM h GROUP BY start, id""",
    "shortest_path": _PATHS,
}

"""The operators as queries over the driver's tables, with SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lorebase.llm import quality_rules
from lorebase.llm.common import table


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lorebase.llm import secrets

    return secrets.scan(table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"
    )


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lorebase.llm import mixing

    return mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source")).select(
        "doc_id", "size", "source_size", "target", "taken"
    )


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lorebase.llm import decontam

    return decontam.leaks(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("item_id", "text"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from lorebase.llm import line_dedup

    return line_dedup.dedup(table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id", "n_lines", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"),
        F.coalesce(F.size("runs"), F.lit(0)).alias("n_runs"), "longest",
    )


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lorebase.llm import substring_dedup

    return substring_dedup.dedup(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lorebase.llm import near_dedup

    return near_dedup.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lorebase.llm import line_crf

    return line_crf.score_quality(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels").select("doc_id", "quality"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lorebase.llm import language_id

    return language_id.identify(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from lorebase.llm import token_counts

    return token_counts.count_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lorebase.llm import spelling

    return spelling.variants(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op12_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lorebase.llm import ball_kmeans

    return ball_kmeans.cluster(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def op13_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lorebase.llm import kdtree

    return kdtree.search(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


QUERIES = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_decontamination": op2_decontamination,
    "op3_quality_classifier": op3_quality_classifier,
    "op4_language_id": op4_language_id,
    "op5_line_dedup": op5_line_dedup,
    "op6_quality_rules": op6_quality_rules,
    "op7_token_counts": op7_token_counts,
    "op8_near_dedup": op8_near_dedup,
    "op9_secrets": op9_secrets,
    "op10_mixing": op10_mixing,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_centroid_clustering": op12_centroid_clustering,
    "op13_exact_topk": op13_exact_topk,
}

_WORD = r"[^\x20\x09-\x0D]"


def _words(text: str) -> str:
    """Words of a text, as DuckDB counts them."""
    return rf"list_filter(string_split_regex({text}, '[\x20\x09-\x0D]+'), lambda w: w <> '')"


def _bare(text: str) -> str:
    return rf"regexp_replace({text}, '[\x20\x09-\x0D]+', '', 'g')"


#: crc32 of a text's UTF-8 bytes, from the 256 entries of its table, which the polynomial gives.
_CRC_TABLE = "crc AS (SELECT [list_reduce([i, 0, 1, 2, 3, 4, 5, 6, 7], lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) for i in range(256)] AS t)"
_crc = lambda text: (
    f"xor(list_reduce([4294967295] || list_transform(range(1, strlen({text}) * 2, 2), lambda i: ('0x' || substr(hex(encode({text})), i, 2))::BIGINT), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295)"
)
_whole = lambda scale: f"list_transform(embedding, lambda x: floor(CAST(x AS DOUBLE) * {scale})::BIGINT)"
_FIT = "len(embedding) = len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x)))"


def _kmeans(k: int, rounds: int) -> str:
    """Lloyd's rounds, each vector against every centroid."""
    steps = []
    for r in range(rounds + 1):
        steps.append(f"d{r} AS (SELECT vec_id, c, sum((x.x - m.x) * (x.x - m.x))::BIGINT AS distance FROM x JOIN m{r} m USING (i) GROUP BY vec_id, c)")
        steps.append(f"a{r} AS MATERIALIZED (SELECT vec_id, arg_min(c, distance * {k} + c) AS c, min(distance) AS distance FROM d{r} GROUP BY vec_id)")
        if r < rounds:
            steps.append(f"s{r} AS (SELECT c, i, sum(x)::BIGINT AS s, count(*) AS n FROM x JOIN a{r} USING (vec_id) GROUP BY c, i)")
            steps.append(f"m{r + 1} AS MATERIALIZED (SELECT c, i, coalesce((s - ((s % n) + n) % n) // n, x) AS x FROM m{r} LEFT JOIN s{r} USING (c, i))")
    return ", ".join(steps)


_ENDS = quality_rules.ENDS.replace("'", "''")
_WORDS = _words("coalesce(text, '')")

ORACLE_SQL: dict[str, str] = {
    "op1_substring_dedup": f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d WHERE len(w) >= 20)),
late AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS k FROM win) WHERE k > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS j FROM late),
one AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS j FROM d),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY j) AS t FROM one ANTI JOIN gone USING (doc_id, j) GROUP BY doc_id),
n AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n.n, 0)::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN kept USING (doc_id)""",
    "op5_line_dedup": f"""
WITH d AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL),
one AS MATERIALIZED (SELECT doc_id, x, md5(x) AS m, i, len({_words('x')}) AS w, sum(CASE WHEN regexp_matches(x, '{_WORD}') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS worded FROM (SELECT doc_id, unnest(l) AS x, generate_subscripts(l, 1) AS i FROM d)),
met AS (SELECT a.doc_id, a.i, b.doc_id AS other, a.i - b.i AS slope FROM one a JOIN one b ON a.m = b.m AND (b.doc_id < a.doc_id OR (b.doc_id = a.doc_id AND b.i < a.i))),
island AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, other, slope ORDER BY i) AS g FROM met),
copy AS (SELECT doc_id, i, max(e) AS e FROM (SELECT doc_id, i, max(i) OVER (PARTITION BY doc_id, other, slope, g) + 1 AS e FROM island) GROUP BY doc_id, i),
span AS (SELECT doc_id, i, CASE WHEN e - i >= 2 AND z.worded - s.worded + CASE WHEN regexp_matches(s.x, '{_WORD}') THEN 1 ELSE 0 END > 0 THEN e WHEN s.w >= 20 THEN i + 1 END AS e
 FROM copy JOIN one s USING (doc_id, i) JOIN (SELECT doc_id, i + 1 AS e, worded FROM one) z USING (doc_id, e)),
runs AS (SELECT doc_id, i, e FROM (SELECT *, max(e) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM span WHERE e IS NOT NULL) WHERE before IS NULL OR e > before),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, e)) AS i FROM runs),
kept AS (SELECT doc_id, string_agg(x, chr(10) ORDER BY i) AS t FROM one ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id),
n AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id),
r AS (SELECT doc_id, count(*) AS runs, max(e - i) AS longest FROM runs GROUP BY doc_id)
SELECT doc_id, coalesce(len(l), 0)::BIGINT AS n_lines, coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256, coalesce(runs, 0)::INT AS n_runs, coalesce(longest, 0)::INT AS longest
FROM documents LEFT JOIN d USING (doc_id) LEFT JOIN n USING (doc_id) LEFT JOIN kept USING (doc_id) LEFT JOIN r USING (doc_id)""",
    "op6_quality_rules": rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, {_WORDS} AS w FROM documents),
win AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 4], ' ')) AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, s) AS c FROM win) WHERE c > 1),
r AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS j FROM twice) GROUP BY doc_id),
paragraphs AS (SELECT doc_id, unnest(string_split(regexp_replace(t, '\n(\p{{Ll}})', chr(57344) || '\1', 'g'), chr(10))) AS p FROM d),
lines AS (SELECT doc_id, unnest(string_split(p, chr(57344))) AS l, instr('{_ENDS}', right(rtrim(p, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 1)) > 0 AS ended FROM paragraphs),
f AS (SELECT doc_id, l, ended, len({_bare('l')}) AS chars, len(string_split(l, ' ')) AS parts, right(rtrim(l, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 1) AS z,
 len(regexp_replace(l, '[^\p{{L}}]+', '', 'g')) AS letters, len(regexp_replace(l, '[^\p{{Lu}}]+', '', 'g')) AS capitals FROM lines WHERE regexp_matches(l, '{_WORD}')),
j AS (SELECT doc_id, l, chars, len(regexp_extract_all(l, '[!?]{{2,}}|\.{{4,}}')) * 3 > parts OR len(regexp_extract_all(l, '{quality_rules.SYMBOLS}')) * 10 > chars
 OR (letters >= 10 AND capitals * 10 > letters * 7) OR len(regexp_extract_all(l, ' [|>»·] ')) >= 3 OR (parts >= {quality_rules.SENTENCE_WORDS} AND instr('{_ENDS}', z) = 0 AND NOT ended)
 OR regexp_matches(lower(l), '{quality_rules.FURNITURE}') AS fails FROM f),
g AS (SELECT doc_id, count(*) - count(DISTINCT l) AS dup, sum(CASE WHEN fails THEN 0 ELSE chars END) AS rest FROM j GROUP BY doc_id),
b AS (SELECT d.doc_id, len(w)::BIGINT AS n_words, len({_bare('t')})::BIGINT AS word_chars, len(regexp_extract_all(t, '{quality_rules.SYMBOLS}'))::BIGINT AS n_symbols,
 coalesce(dup, 0)::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words, coalesce(rest, 0) AS rest FROM d LEFT JOIN r USING (doc_id) LEFT JOIN g USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
 NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND (word_chars - rest) * 100 <= 50 * word_chars AS kept FROM b""",
    "op8_near_dedup": r"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, md5(array_to_string(w[i:i + 4], ' ')) AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id AS v, doc_id AS r FROM documents UNION SELECT b, r FROM reach JOIN both_ways ON v = a),
comp AS (SELECT v, min(r) AS c FROM reach GROUP BY v)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, c AS component_id, c = doc_id AS kept
FROM documents LEFT JOIN n USING (doc_id) JOIN comp ON v = doc_id""",
    "op10_mixing": f"""
WITH d AS (SELECT doc_id, source, len({_WORDS})::BIGINT AS size, ('0x' || md5(concat_ws(':', doc_id, coalesce(text, '')))[:10])::BIGINT AS h FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, [5e0, 2e0, 1e0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight FROM d GROUP BY source),
r AS (SELECT *, 2e0 * source_size AS cap, 2e0 * source_size / weight AS ratio, (SELECT sum(source_size) FROM s)::DOUBLE * 150 / 100 AS total FROM s),
levels AS (SELECT ratio, (total - coalesce((SELECT sum(cap) FROM r x WHERE x.ratio < r.ratio), 0e0)) / (SELECT sum(weight) FROM r x WHERE x.ratio >= r.ratio) AS level FROM r),
one AS (SELECT min(level) AS level FROM levels WHERE ratio = (SELECT min(ratio) FROM levels WHERE level <= ratio)),
t AS (SELECT source, source_size, coalesce(least(cap, level * weight), cap) AS target FROM r, one),
b AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS base FROM t),
g AS (SELECT source, h, sum(size) AS n FROM d GROUP BY source, h),
u AS (SELECT source, h, n, sum(n) OVER (PARTITION BY source ORDER BY h) - n AS before FROM g),
x AS (SELECT u.source, h, before + n <= budget OR (before <= budget AND n < 2 * (budget - before)) AS more FROM u JOIN (SELECT source, target - base * source_size AS budget FROM b) q ON q.source IS NOT DISTINCT FROM u.source)
SELECT d.doc_id, d.size, b.source_size, b.target, (d.size * (base + CASE WHEN more AND base < 2 THEN 1 ELSE 0 END))::BIGINT AS taken
FROM d JOIN b ON b.source IS NOT DISTINCT FROM d.source JOIN x ON x.source IS NOT DISTINCT FROM d.source AND x.h = d.h""",
    "op11_spelling_variants": f"""
WITH RECURSIVE {_CRC_TABLE},
runs AS (SELECT doc_id, translate(r, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS r, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-zÀ-ÿ]+')) AS r FROM documents) WHERE length(r) >= 7 GROUP BY ALL),
h AS (SELECT r, n, {_crc("concat(coalesce(doc_id::VARCHAR, ''), ':', r)")} AS h FROM runs, crc),
w AS MATERIALIZED (SELECT word, sum(n)::BIGINT AS n FROM (SELECT CASE WHEN h % 31 = 0 THEN concat(r[:h % length(r)], r[h % length(r) + 2:]) ELSE r END AS word, n FROM h) WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
cut AS (SELECT word, n, i, concat(word[:i], word[i + 2:]) AS rest FROM (SELECT word, n, unnest(range(length(word))) AS i FROM w)),
near AS MATERIALIZED (SELECT a.word, b.word AS other, b.n AS m FROM cut a JOIN cut b USING (i, rest) WHERE a.word <> b.word
 UNION SELECT a.word, b.word, b.n FROM cut a JOIN w b ON b.word = a.rest UNION SELECT b.word, a.word, a.n FROM cut a JOIN w b ON b.word = a.rest),
best AS (SELECT word, count(*) AS n_near, first(other ORDER BY m DESC, other) AS other, max(m) AS m FROM near GROUP BY word),
f AS MATERIALIZED (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 10 * n THEN other END AS form, CASE WHEN m >= 10 * n THEN m END AS form_n FROM w LEFT JOIN best USING (word)),
walk AS (SELECT word, word AS root FROM f UNION ALL SELECT walk.word, f.form FROM walk JOIN f ON f.word = walk.root WHERE f.form IS NOT NULL)
SELECT f.word, f.form, walk.root, f.n, f.n_near, f.form_n FROM f JOIN walk USING (word) JOIN f e ON e.word = walk.root WHERE e.form IS NULL""",
    "op12_centroid_clustering": f"""
WITH v AS (SELECT vec_id, {_whole(256)} AS v FROM embeddings WHERE len(embedding) = 64 AND {_FIT}),
x AS MATERIALIZED (SELECT vec_id, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM v),
m0 AS MATERIALIZED (SELECT c, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM (SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id)) - 1 AS c, v FROM v) WHERE c < 40),
{_kmeans(40, 5)},
g AS (SELECT c, sha256(string_agg(x::VARCHAR, ',' ORDER BY i)) AS centroid_sha256 FROM m5 GROUP BY c)
SELECT vec_id, c::INT AS cluster, distance, (sum(distance) OVER (PARTITION BY c))::BIGINT AS cluster_inertia, (sum(distance) OVER ())::BIGINT AS inertia, centroid_sha256 FROM a5 JOIN g USING (c)""",
    "op13_exact_topk": f"""
WITH v AS (SELECT vec_id, list_transform({_whole(1024)}, lambda x: x::DOUBLE) AS v FROM embeddings WHERE vec_id IS NOT NULL AND {_FIT}),
s AS (SELECT q.vec_id AS query_id, e.vec_id, list_dot_product(q.v, e.v)::BIGINT AS score FROM v q JOIN v e ON q.vec_id <> e.vec_id AND len(q.v) = len(e.v) WHERE q.vec_id % 100 = 0)
SELECT query_id, rank::INT AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 10""",
}

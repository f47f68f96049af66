"""Secret scan with multipart credential linking.

Base kinds are found wherever they stand.  Weak parts (bare mixed-case keys of 32 or more characters, and
endpoint addresses) say little alone: they are reported only if a complementary part stands within
``scope`` code points of them, found by an interval join over (document, scope bucket).  An access
identifier completes a bare key; an access identifier, an assignment, a hex run or a linked bare key completes an
endpoint.

Positions are code points and come from the gaps between matches, so the scan is one row-local expression
per kind, and its time grows with the text, however many matches it has; only rows with parts reach the join.  The join groups the anchors of a bucket first, so its size
is linear in the parts.

Defined results: null and empty texts have no spans and the digest of an empty string; rows that repeat a
doc_id and text get the same result each; a very long text is scanned whole; extra columns are ignored; empty tables give empty tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorebase.llm.common import materialize, text_column

#: The base kinds, in the order in which ties are listed.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{32,}"
#: The weak parts.  A key begins where its own characters do, so KEY=value, name_value and a.value count.
BARE_KEY = r"(?<![A-Za-z0-9+/])(?=[A-Za-z0-9+/]*[a-z])(?=[A-Za-z0-9+/]*[A-Z])(?=[A-Za-z0-9+/]*[0-9])[A-Za-z0-9+/]{32,}"
ENDPOINT = r"https?://[A-Za-z0-9.-]+(?::[0-9]+)?[A-Za-z0-9_./-]*"
KINDS = ("assign", "access", "hex", "key", "endpoint")

SPAN = "array<struct<kind:int,start:int,end:int>>"


#: Matches summed up at a time.
CHUNK = 256


def _with(value: Column, use) -> Column:
    """``use(value)`` with the value worked out once, however often a lambda in it reads it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _spans(text: Column, pattern: str, kind: int, keep) -> Column:
    """Spans of the leftmost, non-overlapping matches for which ``keep(match)`` holds.

    ``split`` and ``regexp_extract_all`` walk the same matches: gap k precedes match k.  Places are running sums of the
    lengths of both, taken in two steps, within chunks and over the chunks: one array that grows by a match at a time
    would be copied for each.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    sizes = _with(found, lambda m: F.zip_with(m, F.slice(F.split(text, pattern, -1), 1, F.size(m)), lambda m, g: F.struct(F.length(g).alias("g"), F.length(m).alias("m"), keep(m).alias("keep"))))
    span = lambda at, p: F.struct(F.lit(kind).alias("kind"), (at + p["g"]).alias("start"), (at + p["g"] + p["m"]).alias("end"))

    def of_chunk(chunk: Column, at: Column) -> Column:
        step = lambda acc, p: F.struct(
            (acc["at"] + p["g"] + p["m"]).alias("at"), F.when(p["keep"], F.concat(acc["out"], F.array(span(acc["at"], p)))).otherwise(acc["out"]).alias("out")
        )
        return F.aggregate(chunk, F.struct(at.alias("at"), F.array().cast(SPAN).alias("out")), step, lambda acc: acc["out"])

    def placed(chunks: Column) -> Column:
        total = lambda c: F.aggregate(c, F.lit(0), lambda n, p: n + p["g"] + p["m"])
        begins = F.aggregate(
            chunks, F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out")),
            lambda acc, c: F.struct((acc["at"] + total(c)).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")), lambda acc: acc["out"],
        )
        return F.flatten(F.zip_with(chunks, begins, of_chunk))

    cut = lambda all_: F.transform(F.sequence(F.lit(0), F.floor((F.size(all_) - 1) / CHUNK).cast("int")), lambda c: F.slice(all_, c * CHUNK + 1, F.lit(CHUNK)))
    return F.when(text.rlike(pattern), _with(_with(sizes, cut), placed)).otherwise(F.array().cast(SPAN))


def _listed(spans: Column) -> Column:
    """``kind:start:end`` by start, then kind, comma-joined."""
    ordered = F.sort_array(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))))
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(ordered, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def scan(docs: DataFrame, scope: int = 400) -> DataFrame:
    """One row per document: doc_id, counts, base digest, all spans as text and as an array."""
    text = text_column(docs)
    always = lambda m: F.lit(True)
    # One scan of the texts: what it finds is narrow, and is read again for linking.
    found = materialize(docs.select(
        "doc_id",
        F.xxhash64(text).alias("_key"),
        _spans(text, ASSIGN, 0, lambda m: F.length(F.regexp_extract(m, ASSIGN, 2)) >= 8).alias("a"),
        _spans(text, ACCESS, 1, lambda m: F.length(m) >= 16).alias("c"),
        _spans(text, HEX, 2, always).alias("h"),
        _spans(text, BARE_KEY, 3, always).alias("k"),
        _spans(text, ENDPOINT, 4, always).alias("e"),
    ), "spans")
    base = found.select(
        "doc_id", "_key",
        F.size("a").cast("long").alias("n_assign"),
        F.size("c").cast("long").alias("n_access"),
        F.size("h").cast("long").alias("n_hex"),
        F.concat("a", "c", "h").alias("_base"),
    )
    # Repeated rows are the same document: their parts count once.
    parts = (
        found.where(F.size("a") + F.size("c") + F.size("h") > 0).where(F.size("k") + F.size("e") > 0)
        .select("doc_id", "_key", F.explode(F.concat("a", "c", "h", "k", "e")).alias("s"))
        .select("doc_id", "_key", "s.*").distinct()
    )
    linked = link(parts, scope).groupBy("doc_id", "_key").agg(F.collect_list(F.struct("kind", "start", "end")).alias("_linked"))
    joined = base.join(linked, on=[base["doc_id"].eqNullSafe(linked["doc_id"]), base["_key"] == linked["_key"]], how="left").select(
        base["*"], F.coalesce(linked["_linked"], F.array().cast(SPAN)).alias("_linked")
    )
    return joined.select(
        "doc_id", "n_assign", "n_access", "n_hex",
        F.sha2(_listed(F.col("_base")).cast("binary"), 256).alias("base_sha256"),
        _listed(F.concat("_base", "_linked")).alias("spans"),
        F.size("_linked").cast("long").alias("n_linked"),
    )


def link(parts: DataFrame, scope: int) -> DataFrame:
    """Weak parts (doc_id, _key, kind, start, end) that a complementary part completes."""
    keys = parts.where("kind = 3")
    endpoints = parts.where("kind = 4")
    by_access = near(keys, parts.where("kind = 1"), scope)
    complements = parts.where("kind in (0, 1, 2)").unionByName(by_access)
    return by_access.unionByName(near(endpoints, complements, scope))


def near(weak: DataFrame, anchors: DataFrame, scope: int) -> DataFrame:
    """Rows of ``weak`` with an anchor of the same document that starts within ``scope`` code points.

    Anchors are grouped to one row per bucket of ``scope`` code points, each with the lowest and the highest
    start.  A weak part looks into its bucket and both neighbours: the nearest anchor before it is the
    highest of a lower bucket or lies in its own, where starts are compared singly (at most ``scope``).
    """
    buckets = anchors.groupBy("doc_id", "_key", F.floor(F.col("start") / scope).alias("bucket")).agg(
        F.collect_set("start").alias("starts")
    )
    looked = weak.withColumn("home", F.floor(F.col("start") / scope)).withColumn(
        "bucket", F.explode(F.sequence(F.col("home") - 1, F.col("home") + 1))
    )
    hit = looked.alias("w").join(
        buckets.alias("b"),
        (F.col("w.doc_id").eqNullSafe(F.col("b.doc_id"))) & (F.col("w._key") == F.col("b._key")) & (F.col("w.bucket") == F.col("b.bucket"))
        & F.exists("b.starts", lambda s: F.abs(s - F.col("w.start")) <= scope),
    )
    return hit.select("w.doc_id", "w._key", "w.kind", "w.start", "w.end").distinct()

"""Text functions as Column expressions: tokens, slugs, estimates, digests."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that a search leaves out.
STOPWORDS = (
    "a an the and or but of to in on at for is are was were be been being with as by that this it its from we i you "
    "he she they do does did what which who whom about into over after before between not no so if than then there "
    "here when where how our your their up out just"
).split()
MAX_QUERY_TOKENS = 32
#: Letters with marks and the plain letters that they match.
MARKED, PLAIN = "àáâäãåçèéêëìíîïñòóôöõùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy"


def doc_tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits, without diacritics."""
    return F.array_remove(F.split(F.translate(F.lower(F.coalesce(text, F.lit(""))), MARKED, PLAIN), r"[^\p{L}\p{N}]+"), "")


def query_tokens(query: Column) -> Column:
    """Up to 32 search terms: words of two characters or more that are no stop words, unless all are."""
    found = F.filter(F.regexp_extract_all(F.coalesce(query, F.lit("")), F.lit(r"[A-Za-z0-9][\p{L}\p{N}_.-]*"), F.lit(0)), lambda t: F.length(t) > 1)
    stops = F.array(*[F.lit(w) for w in STOPWORDS])
    telling = F.filter(found, lambda t: ~F.array_contains(stops, F.lower(t)))
    return F.slice(F.when(F.size(telling) > 0, telling).otherwise(found), 1, MAX_QUERY_TOKENS)


def token_estimate(text: Column) -> Column:
    """A quarter of the UTF-8 bytes, rounded up; 0 for an empty text."""
    return F.ceil(F.octet_length(F.coalesce(text, F.lit(""))) / 4).cast("long")


def slugify(name: Column) -> Column:
    kept = F.regexp_replace(F.trim(F.lower(name)), r"[^a-z0-9\s-]", "")
    return F.substring(F.regexp_replace(F.regexp_replace(kept, r"[\s_]+", "-"), "^-+|-+$", ""), 1, 60)


def stable_digest(**fields: Column) -> Column:
    """sha256 of a JSON object with its keys in order."""
    return F.sha2(F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)])), 256)


def as_text(value: Column) -> Column:
    """Text of a JSON value: of an object the first of a few keys that holds a text, else the value itself."""
    keys = ("text", "decision", "constraint", "summary", "title", "question")
    return F.coalesce(*[F.nullif(F.trim(F.get_json_object(value, f"$.{k}")), F.lit("")) for k in keys], F.trim(value))


def clamped(limit: int, most: int = 100) -> int:
    """A result limit between 1 and ``most``."""
    return max(1, min(int(limit), most))


def unknown(given: Column, known: tuple[str, ...]) -> Column:
    """Names in an array that are none of the known ones, in order."""
    return F.array_sort(F.array_except(given, F.array(*[F.lit(k) for k in known])))

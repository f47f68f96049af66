"""Gates that decide how important a text is, kept in a registry and asked in order until one answers.

A gate is a function from Columns to a struct(decision, confidence) that is null where it has no answer.  So are
embedders (text to vector) and extractors (text and decision to struct): each registry holds functions by name.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Whole replies that mean nothing, and patterns by decision, looked for in the lower-cased text.
SKIP_REPLIES = (
    "ok okay k gotcha sure yep yup yeah nope nah hmm hm lol ha thx thanks ty 👍 😊 🙌 ✅ ❤️ 🔥 💪 💯 🎉 😉 👋 yes no maybe right correct wrong true false".split()
    + ["got it"]
)
PERSIST = (
    "decision|decided|architecture|design pattern|agreed|rule|policy|preference|always|never",
    "name is|i am|i prefer|i want|my name|remember this|important|critical|must|don't forget",
    "project|milestone|deadline|launch|release|version",
)
ACTIVE = (
    "fix|implement|create|update|change|refactor|debug|deploy|test|merge|push|branch|commit|pr|issue|task|ticket",
    "todo|blocker|progress|status|review|approve|request",
    "error|bug|crash|fail|broken|issue|problem",
)
#: Only behind another word.
ACTIVE_AFTER = "build"
COLD_START = ("what|how|when|where|why|who|is|can|do|does|did|will|would|should|could", "hmm|interesting|oh|ah|well")
LABELS = ("SKIP", "COLD", "ACTIVE", "PERSIST")

_LETTER = r"[\p{L}\p{N}_]"
_OPEN, _SHUT = r"(^|[^\p{L}\p{N}_])", r"([^\p{L}\p{N}_]|$)"
PERSIST_PATTERN = f"{_OPEN}({'|'.join(PERSIST)}){_SHUT}"
ACTIVE_PATTERN = f"{_OPEN}({'|'.join(ACTIVE)}){_SHUT}|{_LETTER} {ACTIVE_AFTER}{_SHUT}"
COLD_PATTERN = rf"\?$|^({'|'.join(COLD_START)}){_SHUT}"
TRIM = "^[ \\t\\n\\x0b\\f\\r]+|[ \\t\\n\\x0b\\f\\r]+$"


def _result(decision: str, confidence: float) -> Column:
    return F.struct(F.lit(decision).alias("decision"), F.lit(confidence).alias("confidence"))


def rules(text: Column) -> Column:
    """Gate by patterns; lengths are of the text as it came."""
    raw = F.coalesce(text, F.lit(""))
    low = F.regexp_replace(F.lower(raw), TRIM, "")
    short = F.length(low).between(1, 5) & ~F.contains(low, F.lit("\n"))
    return (
        F.when(low.isin(SKIP_REPLIES) | short, _result("SKIP", 0.85))
        .when(low.rlike(PERSIST_PATTERN), _result("PERSIST", 0.75))
        .when(low.rlike(ACTIVE_PATTERN), _result("ACTIVE", 0.70))
        .when(low.rlike(COLD_PATTERN), _result("COLD", 0.65))
        .when(F.length(raw) < 20, _result("SKIP", 0.60))
        .when(F.length(raw) < 50, _result("COLD", 0.55))
        .otherwise(_result("ACTIVE", 0.60))
    )


def from_answer(answer: Column, confidence: float = 0.95) -> Column:
    """Gate by a model's answer: the first label, in a fixed order, that the answer has; COLD without one, null without an answer."""
    up = F.upper(answer)
    found = reduce(lambda out, k: F.when(F.contains(up, F.lit(k)), k).otherwise(out), reversed(LABELS), F.lit("COLD"))
    return F.when(answer.isNotNull(), F.struct(found.alias("decision"), F.lit(confidence).alias("confidence")))


def from_scores(scores: dict[str, Column], skip_from: float = 0.7) -> Column:
    """Gate by softmax over a score for each label; SKIP needs ``skip_from``, else the best other label stands."""
    top = F.greatest(*scores.values())
    parts = {k: F.exp(v - top) for k, v in scores.items()}
    total = reduce(lambda a, b: a + b, parts.values())
    chances = {k: v / total for k, v in parts.items()}
    others = [k for k in scores if k != "SKIP"]
    best = F.greatest(*[chances[k] for k in others])
    name = reduce(lambda out, k: F.when(chances[k] == best, k).otherwise(out), reversed(others), F.lit(None).cast("string"))
    skips = (chances["SKIP"] >= best) & (chances["SKIP"] >= skip_from)
    known = reduce(lambda a, b: a & b, [v.isNotNull() for v in scores.values()])
    return F.when(known, F.when(skips, F.struct(F.lit("SKIP").alias("decision"), chances["SKIP"].alias("confidence"))).otherwise(F.struct(name.alias("decision"), best.alias("confidence"))))


#: Functions by name; add one with ``GATES["name"] = function``.  Rules answer every text, so they are asked last.
GATES: dict[str, Callable[..., Column]] = {"answer": from_answer, "scores": from_scores, "rules": rules}


def chain(asked: dict[str, Column]) -> Column:
    """struct(decision, confidence, backend, fell_back) of the first gate that answers; ACTIVE with 0.5 where none does."""
    first = next(iter(asked))
    out = F.struct(F.lit("ACTIVE").alias("decision"), F.lit(0.5).alias("confidence"), F.lit("default").alias("backend"), F.lit(True).alias("fell_back"))
    for name, result in reversed(asked.items()):
        told = F.struct(result["decision"].alias("decision"), result["confidence"].alias("confidence"), F.lit(name).alias("backend"), F.lit(name != first).alias("fell_back"))
        out = F.when(result.isNotNull(), told).otherwise(out)
    return out


#: Categories and tiers that an extractor may give, and what stands in for others.
CATEGORIES, TIERS = ("project", "person", "preference", "decision", "task", "strategy", "session"), ("cold", "active", "persist")


def valid(value: Column, allowed: tuple[str, ...], otherwise: str) -> Column:
    low = F.lower(value)
    return F.when(low.isin(*allowed), low).otherwise(otherwise)


def first_lines(text: Column, decision: Column) -> Column:
    """Extractor without a model: the first 200 characters, category project, the tier that the gate decided."""
    tier = F.lower(decision)
    return F.struct(F.substring(text, 1, 200).alias("summary"), F.lit("project").alias("category"), F.when(tier.isin(*TIERS), tier).otherwise("active").alias("tier"))


EXTRACTORS: dict[str, Callable[..., Column]] = {"first_lines": first_lines}

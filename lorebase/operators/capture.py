"""Capture of texts as one plan, and the maintenance run over what was captured."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorebase.functions import gates

#: Patterns of claims: who, and what of them.
CLAIMS = {
    "description": "(?i)([A-Z][A-Za-z0-9_-]+)[ ]+(?:is|was)[ ]+([^.!?]{3,160})",
    "uses": "(?i)([A-Z][A-Za-z0-9_-]+)[ ]+uses[ ]+([^.!?]{2,120})",
    "technology": "(?i)([A-Z][A-Za-z0-9_-]+)[ ]+switched[ ]+to[ ]+([^.!?]{2,120})",
    "decision": "(?i)([A-Z][A-Za-z0-9_-]+)[ ]+decided[ ]+([^.!?]{3,160})",
}


def entities(notes: DataFrame, registry: DataFrame) -> DataFrame:
    """id, entity_id: the registered entities whose name or alias is a word of a note (id, note)."""
    tokens = notes.select("id", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("note"), F.lit("[a-z0-9_]+"), F.lit(0)))).alias("name"))
    return tokens.join(registry.select("name", "entity_id"), "name").select("id", "entity_id").distinct()


def facts(notes: DataFrame, registry: DataFrame) -> DataFrame:
    """id, entity_id, claim_key, claim_value: claims about registered entities, each value once."""
    tidy = lambda m, p: F.trim(F.regexp_replace(F.regexp_extract(m, p, 2), "[ \n\t]+", " "))
    # One pass over the notes for all patterns: a union of one branch for each reads them as often.
    said = [
        F.transform(F.regexp_extract_all("note", F.lit(p), F.lit(0)), lambda m: F.struct(F.lit(k).alias("claim_key"), F.lower(F.regexp_extract(m, p, 1)).alias("name"), tidy(m, p).alias("claim_value")))
        for k, p in CLAIMS.items()
    ]
    found = notes.select("id", F.explode(F.flatten(F.array(*said))).alias("c")).select("id", "c.*")
    every = found.where("claim_value <> ''").join(registry.select("name", "entity_id"), "name")
    return every.groupBy("id", "entity_id", "claim_key", F.lower("claim_value").alias("_k")).agg(F.min("claim_value").alias("claim_value")).drop("_k")


def capture(notes: DataFrame, registry: DataFrame, extractor: str = "first_lines") -> DataFrame:
    """What becomes of each note (id, note, requested_category, requested_tier).

    The gate decides; what it skips ends there.  Category and tier are what was asked for, else what the extractor
    says.  The first ten entities are linked each with each, a pair counting once; facts are those of the registered
    entities.
    """
    judged = notes.withColumn("g", gates.chain({"rules": gates.GATES["rules"](F.col("note"))}))
    e = judged.withColumn("e", gates.EXTRACTORS[extractor](F.col("note"), F.col("g.decision")))
    linked = entities(notes, registry).groupBy("id").agg(F.count("*").alias("n_entities"))
    claimed = facts(notes, registry).groupBy("id").agg(F.count("*").alias("n_facts"))
    skipped = F.col("g.decision") == "SKIP"
    # Skipped notes are told apart in the row, not in a branch of a union.
    taken = lambda c: F.when(~skipped, c)
    n = lambda c: F.coalesce(taken(F.col(c)), F.lit(0)).cast("long")
    paired = F.least(n("n_entities"), F.lit(10))
    pairs = F.floor(paired * (paired - 1) / 2).cast("long")
    return e.join(linked, "id", "left").join(claimed, "id", "left").select(
        "id", "g.decision", "g.confidence", "g.backend",
        taken(F.coalesce("requested_category", "e.category")).alias("category"),
        taken(F.coalesce("requested_tier", "e.tier")).alias("tier"), taken(F.col("e.summary")).alias("summary"),
        n("n_entities").alias("n_entities"), pairs.alias("edges_created"), n("n_facts").alias("facts_created"),
        F.when(skipped, "skipped").otherwise("complete").alias("status"),
    )


def maintenance(phases: dict[str, Callable[[], DataFrame]], dry_run: bool = False) -> list[tuple[int, str, str, int, bool]]:
    """(place, phase, status, rows, changes made) of each phase in order; a phase that fails is reported and the others go on.

    Each phase is a DataFrame of the rows that it found; only their number comes to the driver.
    """
    out = []
    for place, (name, phase) in enumerate(phases.items(), start=1):
        try:
            out.append((place, name, "ok", phase().count(), not dry_run))
        except Exception:  # noqa: BLE001
            out.append((place, name, "fail", 0, False))
    return out

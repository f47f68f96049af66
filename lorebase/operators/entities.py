"""Entities in texts: a dictionary of names of any length, proper nouns, and the edges that a text wires."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorebase.sources.scratch import materialize

#: What a name is made of; a name stands where it neither follows nor is followed by such a character.
LETTERS = r"[\p{L}\p{N}_]+"
#: Confidence of a name and of an alias, of entities that are built in and of those that were registered, and of a proper noun.
CONFIDENCE = {(0, 0): 0.9, (0, 1): 0.85, (1, 0): 0.85, (1, 1): 0.8}
PROPER_CONFIDENCE, ACTIVE_FROM = 0.5, 0.7
#: Entities of a text that are linked as mentioned together.
MENTIONED = 10
#: Phrases that name an edge, the first that the sentence holds.
EDGE_PHRASES = (
    ("decided_about", r"\b(decided|decides|chose|confirmed|ruling)\b"),
    ("works_on", r"\b(works?\s+on|implementing|building|shipping)\b"),
    ("depends_on", r"\b(depends?\s+on|requires?|needs?|uses?)\b"),
    ("related_to", r"\b(related\s+to|connected\s+to|linked\s+to)\b"),
)
#: Words that tell the type of an unknown entity, the first that the text holds, and words that are no names.
TYPE_WORDS = (
    ("project", ("project", "repo", "repository", "codebase")), ("person", ("person", "he", "she", "they", "him", "her")), ("decision", ("decided", "decision", "chose", "ruling")),
    ("concept", ("concept", "pattern", "framework", "architecture")), ("tool", ("tool", "library", "service", "database")),
)
NOT_NAMES = ("the", "and", "but", "for", "this", "that", "with", "from", "not", "yes")


def mentions(texts: DataFrame, names: DataFrame) -> DataFrame:
    """id, place, and the columns of ``names`` (name, ...) for every name in every text (id, text), ASCII and other case folded.

    A trie by first words: each word of a text that begins some name is joined with the names that begin so, and the
    words and gaps that follow it are compared with the rest of the name.  Names may have any number of words and any marks
    between them; the work is a row for each word of the texts, and none is formed for pairs of texts and names.
    """
    known = names.withColumn("_name", F.lower("name")).withColumn("_words", F.regexp_extract_all("_name", F.lit(LETTERS), F.lit(0))).where(F.size("_words") > 0)
    longest = known.agg(F.max(F.size("_words"))).first()[0] or 1  # one number
    first = known.withColumn("_first", F.get("_words", F.lit(0))).drop("_words")
    cut = texts.select("id", F.lower(F.coalesce("text", F.lit(""))).alias("_t"))
    cut = cut.select("id", F.regexp_extract_all("_t", F.lit(LETTERS), F.lit(0)).alias("_w"), F.split("_t", LETTERS, -1).alias("_g"))
    tail = lambda i: F.array_join(F.zip_with(F.slice("_w", i + 1, F.lit(longest)), F.slice("_g", i + 2, F.lit(longest)), lambda w, g: F.concat(w, F.coalesce(g, F.lit("")))), "")
    rows = cut.select("id", F.posexplode(F.transform("_w", lambda w, i: F.struct(w.alias("w"), tail(i).alias("tail")))).alias("place", "x"))
    met = rows.select("id", "place", F.col("x.w").alias("_first"), F.col("x.tail").alias("_tail")).join(first, "_first")
    ends = F.substr("_tail", F.length("_name") + 1, F.lit(1))
    return met.where(F.startswith("_tail", F.col("_name")) & ~ends.rlike(LETTERS)).select("id", "place", *names.columns)


def proper_nouns(texts: DataFrame) -> DataFrame:
    """id, place, name: words with a capital that do not begin a sentence, lower-cased, where each stands first."""
    sentences = texts.select("id", F.posexplode(F.split("text", r"(?<=[.!?])\s+")).alias("s", "sentence"))
    words = sentences.select("id", "s", F.posexplode(F.filter(F.split("sentence", r"\s+"), lambda w: w != "")).alias("w", "word")).where("w > 0")
    bare = words.withColumn("word", F.btrim("word", F.lit(".,;:!?\")'(")))
    fine = bare.where(F.col("word").rlike(r"^\p{Lu}") & (F.length("word") > 2)).withColumn("name", F.lower("word")).where(~F.col("name").isin(*NOT_NAMES))
    return fine.groupBy("id", "name").agg(F.min(F.struct("s", "w")).alias("place"))


def edge_of(text: Column, name: Column) -> Column:
    """The edge that the first sentence with a name speaks of, or the whole text if no sentence holds it."""
    word = F.concat(F.lit(r"(?i)(?<![\p{L}\p{N}_])\Q"), name, F.lit(r"\E(?![\p{L}\p{N}_])"))
    held = F.filter(F.regexp_extract_all(text, F.lit(r"[^.!?]+[.!?]+"), F.lit(0)), lambda s: F.rlike(s, word))
    told = F.lower(F.coalesce(F.get(held, F.lit(0)), text))
    kind = F.lit("mentions")
    for edge, pattern in reversed(EDGE_PHRASES):
        kind = F.when(told.rlike(pattern), edge).otherwise(kind)
    return kind


def kind_of(text: Column) -> Column:
    """The type of an unknown entity, by words that the text holds anywhere."""
    kind, low = F.lit("concept"), F.lower(text)
    for name, words in reversed(TYPE_WORDS):
        kind = F.when(low.rlike("|".join(words)), name).otherwise(kind)
    return kind


def detected(texts: DataFrame, names: DataFrame) -> DataFrame:
    """id, turn, entity_id, kind, confidence, is_new, edge of the entities of each text, each once, in order of ``turn``.

    names: entity_id, name, kind, alias (1: another name of it), registered (0: built in), rank.  Built-in entities come first, then
    registered ones, by rank, with the confidence of the best name that stands in the text; then proper nouns in the
    order of the text, which are new unless some entity has that name.
    """
    sure = F.lit(None).cast("double")
    for (registered, alias), value in CONFIDENCE.items():
        sure = F.when((F.col("registered") == registered) & (F.col("alias") == alias), value).otherwise(sure)
    found = mentions(texts, names).withColumn("confidence", sure)
    best = found.groupBy("id", "entity_id").agg(F.min(F.struct(-F.col("confidence"), "alias", "rank", "name", "kind", "registered")).alias("m"))
    known = best.select("id", F.struct("m.registered", "m.rank", F.lit(0).alias("s"), F.lit(0).alias("w")).alias("_order"), "entity_id", "m.kind", (-F.col("m.col1")).alias("confidence"), F.lit(False).alias("is_new"), F.col("m.name").alias("_name"))
    own = names.groupBy(F.lower("name").alias("name")).agg(F.min(F.struct("registered", "alias", "rank", "entity_id", "kind")).alias("_e"))
    nouns = proper_nouns(texts).join(own, "name", "left")
    named = nouns.select(
        "id", F.struct(F.lit(2).alias("registered"), F.lit(0).alias("rank"), "place.s", "place.w").alias("_order"), F.coalesce("_e.entity_id", "name").alias("entity_id"),
        F.col("_e.kind").alias("kind"), F.lit(PROPER_CONFIDENCE).alias("confidence"), F.col("_e").isNull().alias("is_new"), F.col("name").alias("_name"),
    )
    fresh = named.join(known.select("id", "entity_id"), ["id", "entity_id"], "left_anti").select(*known.columns)
    told = known.unionByName(fresh).join(texts.select("id", F.coalesce("text", F.lit("")).alias("_text")), "id")
    order = Window.partitionBy("id").orderBy("_order", "entity_id")
    return told.select(
        "id", F.row_number().over(order).alias("turn"), "entity_id", F.coalesce("kind", kind_of(F.col("_text"))).alias("kind"), "confidence", "is_new", edge_of(F.col("_text"), F.col("_name")).alias("edge")
    )


def wired(texts: DataFrame, names: DataFrame) -> tuple[DataFrame, DataFrame]:
    """New entities (entity_id, kind, tier, memory_id), and edges (src, dst, kind, confidence, memory_id), each as the first text gives it.

    An entity of which a sentence says what it does has an edge of that kind to every other entity of the text; the first
    ten of a text are linked both ways as mentioned together, as surely as the less sure of the two.  An entity that is new
    is active if it is sure enough, else cold.
    """
    found = materialize(detected(texts, names), "detected")
    new = found.where("is_new").groupBy("entity_id").agg(F.min(F.struct("id", "kind", "confidence")).alias("m"))
    tier = F.when(F.col("m.confidence") >= ACTIVE_FROM, "active").otherwise("cold")
    entities = new.select("entity_id", "m.kind", tier.alias("tier"), F.col("m.id").alias("memory_id"))
    a = found.select("id", F.col("turn").alias("_i"), F.col("entity_id").alias("src"), F.col("edge").alias("kind"), F.col("confidence").alias("_a"))
    b = found.select("id", F.col("turn").alias("_j"), F.col("entity_id").alias("dst"), F.col("confidence").alias("_b"))
    typed = a.where("kind <> 'mentions'").join(b, "id").where("src <> dst").select("src", "dst", "kind", F.col("_a").alias("confidence"), "id")
    both = a.where(F.col("_i") <= MENTIONED).join(b.where(F.col("_j") <= MENTIONED), "id").where("src <> dst")
    spoken = both.select("src", "dst", F.lit("mentions").alias("kind"), F.least("_a", "_b").alias("confidence"), "id")
    first = typed.unionByName(spoken).groupBy("src", "dst", "kind").agg(F.min(F.struct("id", "confidence")).alias("m"))
    return entities, first.select("src", "dst", "kind", "m.confidence", F.col("m.id").alias("memory_id"))

"""Quality rules, line first: failing lines go, then documents that lost too much text.

Each line is judged by itself: runs of marks, symbol and capital shares and sentences without an end
(punctuation), separator chains (navigation) and fixed phrases in four languages (boilerplate).  Lines that go on with a small
letter are one paragraph, wrapped at some width: of such lines none needs an end mark if the paragraph has one.  A document is rejected if it has too few words or too many
repeated words (base rules), or if its failing lines held more than ``max_lost`` of its word characters.

Everything is computed inside the row of a document: no shuffle, no Python.

Defined results: null or empty text has no words and fails the base rules; repeated rows are judged one by
one; other columns of the input pass through, and those that have a result's name are replaced by ``judge``
and left alone by ``clean``; an empty table gives an empty table; texts of any length are judged whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorebase.llm.common import SPACE_CLASS, WORD_CLASS, own_columns, text_column, where_settled, with_own, words

WINDOW = 5

#: Phrases that mark a line as page furniture, in English, German, French and Spanish, matched in lower case.
BOILERPLATE = (
    "all rights reserved", "click here", "cookie policy", "enable javascript", "licensed under", "privacy policy",
    "released under the", "subscribe to our", "terms of service", "terms of use",
    "alle rechte vorbehalten", "hier klicken", "cookie-richtlinie", "datenschutzerklärung", "lizenziert unter", "nutzungsbedingungen",
    "tous droits réservés", "cliquez ici", "politique de confidentialité", "conditions générales", "sous licence",
    "todos los derechos reservados", "haga clic aquí", "política de privacidad", "términos de uso", "bajo licencia",
)
#: They begin where a word does, which also spares the search most places.
FURNITURE = r"(^|\P{L})(" + "|".join(BOILERPLATE) + ")"
#: Symbols that prose hardly uses, and marks that end a line of prose.
SYMBOLS = "[#*$%&|<>]"
ENDS = ".!?:;…\"'”’»)]}。！？؟।"
#: Words from which a line must end in one of them.
SENTENCE_WORDS = 5
SPACES = " \t\n\x0b\x0c\r"


def _without_space(text: Column) -> Column:
    return F.regexp_replace(text, SPACE_CLASS + "+", "")


#: Where a paragraph ends: a line break, unless the next line begins with a small letter.
PARAGRAPH = r"\n(?!\p{Ll})"


def ended(text: Column) -> Column:
    """Whether the last mark of a text is one that ends a sentence."""
    return F.right(F.rtrim(text, F.lit(SPACES)), F.lit(1)).isin(*ENDS)


def line_fails(line: Column, paragraph_ended: Column | None = None) -> Column:
    """True for a line with words that any line rule rejects; a line without words passes.

    ``paragraph_ended``: whether the paragraph ends as a sentence does, of which the line is a part.

    Rare signs are looked for first, and counted only where they stand: ``&`` and ``when`` end early.
    """
    parts = F.size(F.split(line, " "))
    count = lambda pattern: F.regexp_count(line, F.lit(pattern))
    rarely = lambda sign, rule: F.when(line.rlike(sign), rule).otherwise(F.lit(False))
    letters = F.length(F.regexp_replace(line, r"[^\p{L}]+", ""))
    capitals = F.length(F.regexp_replace(line, r"[^\p{Lu}]+", ""))
    # Punctuation: runs of marks, symbols, capitals (of which two must then be neighbours), sentences without an end.
    marks = rarely(r"[!?]{2}|\.{4}", count(r"[!?]{2,}|\.{4,}") * 3 > parts)
    symbols = rarely(SYMBOLS, count(SYMBOLS) * 10 > F.length(_without_space(line)))
    shouting = rarely(r"\p{Lu}\P{L}*\p{Lu}", (letters >= 10) & (capitals * 10 > letters * 7))
    endless = ~ended(line) & (parts >= SENTENCE_WORDS)
    if paragraph_ended is not None:
        endless = ~paragraph_ended & endless
    navigation = rarely(r"[|>»·]", count(r" [|>»·] ") >= 3)
    furniture = F.lower(line).rlike(FURNITURE)
    return line.rlike(WORD_CLASS) & (endless | symbols | navigation | marks | shouting | furniture)


def _shifted(array: str, by: int) -> Column:
    return F.slice(array, F.lit(by + 1), F.greatest(F.size(array) - by, F.lit(0)))


def _pairwise(left: str, right: str, by: int) -> Column:
    """Hash of each element of ``left`` with the one of ``right`` that stands ``by`` places further on."""
    return F.when(
        F.size(right) > by, F.zip_with(F.slice(left, F.lit(1), F.greatest(F.size(right) - by, F.lit(0))), _shifted(right, by), lambda a, b: F.xxhash64(a, b))
    ).otherwise(F.array().cast("array<bigint>"))


RESULTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "clean_text")


def _judged(docs: DataFrame, max_lost_percent: int, min_words: int, max_repeat_percent: int) -> DataFrame:
    """``_own`` and RESULTS."""
    return (
        own_columns(docs, text_column(docs).alias("_text"))
        .withColumn("_words", words(F.col("_text")))
        .withColumn("n_words", F.size("_words").cast("long"))
        .withColumn("word_chars", F.length(_without_space(F.col("_text"))).cast("long"))
        .withColumn("n_symbols", F.regexp_count("_text", F.lit(SYMBOLS)).cast("long"))
        # Hash of the window of five words at each position: of two, of four, of five.
        .withColumn("_one", F.transform("_words", lambda w: F.xxhash64(w)))
        .drop("_words")
        .withColumn("_two", _pairwise("_one", "_one", 1))
        .withColumn("_four", _pairwise("_two", "_two", 2))
        .withColumn("_hashes", _pairwise("_four", "_one", WINDOW - 1))
        .drop("_one", "_two", "_four")
        .withColumn("_repeats", F.size(F.array_distinct("_hashes")) < F.size("_hashes"))
        # Only texts with a repeated window sort theirs: equal hashes meet, and neighbours tell.
        .withColumn(
            "_pairs",
            F.when(
                F.col("_repeats"),
                F.sort_array(F.transform("_hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
            ),
        )
        .drop("_hashes")
        .withColumn(
            "_starts",
            F.sort_array(
                F.transform(
                    F.filter(
                        F.transform(
                            "_pairs",
                            lambda p, i: F.struct(
                                p["i"].alias("i"),
                                (
                                    F.coalesce(F.get("_pairs", i - 1)["h"] == p["h"], F.lit(False))
                                    | F.coalesce(F.get("_pairs", i + 1)["h"] == p["h"], F.lit(False))
                                ).alias("twice"),
                            ),
                        ),
                        lambda p: p["twice"],
                    ),
                    lambda p: p["i"],
                )
            ),
        )
        .drop("_pairs")
        .withColumn("n_repeat_words", F.coalesce(F.expr(
            f"aggregate(_starts, named_struct('n', 0L, 'last', -{WINDOW}),"
            f" (a, p) -> named_struct('n', a.n + least({WINDOW}, p - a.last), 'last', p), a -> a.n)"
        ), F.lit(0).cast("long")))
        .withColumn("_lines", F.split("_text", "\n"))
        .withColumn("_with_words", F.filter("_lines", lambda s: s.rlike(WORD_CLASS)))
        .withColumn("n_dup_lines", (F.size("_with_words") - F.size(F.array_distinct("_with_words"))).cast("long"))
        .withColumn("_paragraphs", F.transform(F.split("_text", PARAGRAPH), lambda p: F.struct(F.split(p, "\n").alias("lines"), ended(p).alias("ended"))))
        .withColumn("_good", F.flatten(F.transform("_paragraphs", lambda p: F.filter(p["lines"], lambda s: ~line_fails(s, p["ended"])))))
        .withColumn("clean_text", F.array_join("_good", "\n"))
        .withColumn("_left", F.length(_without_space(F.col("clean_text"))))
        .withColumn(
            "base_failed",
            (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words")),
        )
        .withColumn(
            "kept",
            ~F.col("base_failed") & ((F.col("word_chars") - F.col("_left")) * 100 <= max_lost_percent * F.col("word_chars")),
        )
    )


def judge(docs: DataFrame, max_lost_percent: int = 50, min_words: int = 10, max_repeat_percent: int = 20) -> DataFrame:
    """Each document with the counts, ``base_failed``, ``kept`` and ``clean_text`` (passing lines only)."""
    return with_own(_judged(docs, max_lost_percent, min_words, max_repeat_percent), docs.columns, **{c: F.col(c) for c in RESULTS})


def clean(docs: DataFrame) -> DataFrame:
    """Pipeline stage: documents that pass, with their passing lines; the columns of ``docs``."""
    rows = where_settled(_judged(docs, 50, 10, 20), F.col("kept"))
    counted = {"n_chars": F.length("clean_text").cast("long")} if "n_chars" in docs.columns else {}
    return with_own(rows, docs.columns, text=F.col("clean_text"), **counted)

"""Spelling variant grouping: a positional q-gram index with a count filter.

Words are maximal runs of Latin letters; two words are near if one inserted, deleted or replaced letter makes one
the other.  One edit changes at most q of a word's q-grams (q is 3) and moves those behind it by one place, so near
words of which the longer has L letters share at least L - 2q + 1 grams, at places that differ by one at most.

**Index.**  Merging short postings lists only, as long as the bound allows it, loses no pair: with the grams of all words
in one order (rare first), a word's first grams up to the first two that do not overlap cannot all be changed by one
edit, so near words share one of these (four at most).  A postings list is (gram, length, place); a word of length L is
entered in its own lists and looks up those of length L - 1, at the same place and one before.  Lists go to tasks
by key; one of more than ``BLOCK`` entries is split, part against part.

**Merge.**  Inside a list its entries are indexed again by all their grams, in the order of that list (what all
share comes last), and again only the shortest lists are merged.  The merge takes a batch of words at once: the postings
that each looks up are laid end to end and one sort merges them (numpy's, in place of a heap for every word).
Pairs that reach the overlap bound are verified letter by letter.

Frequencies are counts in 2**16 slots of a hash, whatever the number of grams: the order is the same for all words,
which is all that must hold.  Letters have code points up to U+00FF, so a word travels as one byte a letter.

Defined results: null texts have no words, a null doc_id is spelled as nothing in the hash; rows that repeat count again;
runs of any length are whole words; extra columns are ignored; an empty table gives an empty table; ties between forms go to
the first in code-point order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorebase.llm.common import materialize, scratch, text_column

Q = 3
LEAST = 7
#: Of a word's grams the first so many hold two that do not overlap.
FIRST = Q + 1
SLOTS = 1 << 16
#: Entries of one part of a postings list.
BLOCK = 4096
#: Entries and pairs looked at in one step of a task.
STEP, PAIRS = 100_000, 2_000_000
ENTRY = "cell long, probe boolean, word binary, n long"
PAIR = "a binary, na long, b binary, nb long"


def words(docs: DataFrame, drop_one_in: int = 31, least: int = LEAST, occurrences: int = 2) -> DataFrame:
    """word, n: runs of letters with ASCII case folded, a letter left out where the hash of doc_id and run says so."""
    runs = docs.select(
        F.col("doc_id").cast("string").alias("doc"),
        # A run is greedy and found from the left, so one of at least so many letters is found whole.
        F.explode(F.regexp_extract_all(text_column(docs), F.lit(r"([A-Za-zÀ-ÿ]{%d,})" % least), F.lit(1))).alias("run"),
    )
    folded = F.when(F.col("run").rlike("[A-Z]"), F.translate("run", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).otherwise(F.col("run"))
    hashed = runs.select(folded.alias("run"), F.coalesce("doc", F.lit("")).alias("doc")).withColumn("h", F.crc32(F.concat("doc", F.lit(":"), "run").cast("binary")))
    at = (F.col("h") % F.length("run")).cast("int")
    shorter = F.concat(F.substr("run", F.lit(1), at), F.substr("run", at + 2))
    word = F.when(F.col("h") % drop_one_in == 0, shorter).otherwise(F.col("run"))
    return hashed.select(word.alias("word")).where(F.length("word") >= least).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= occurrences)


def _letters(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all words of a column, and where each begins (and the end)."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    kind = np.int64 if pa.types.is_large_binary(column.type) else np.int32
    bounds = np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8)
    return data[bounds[0] : bounds[-1]], bounds - bounds[0]


def _grams(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, place and code (its bytes) of each gram of each word, and each word's first gram."""
    many = np.maximum(np.diff(bounds) - Q + 1, 0)
    first = np.cumsum(many) - many
    row = np.repeat(np.arange(len(many)), many)
    place = np.arange(many.sum()) - first[row]
    at = bounds[:-1][row] + place
    code = np.zeros(len(at), np.int64)
    for k in range(Q):
        code = code << 8 | data[at + k]
    return row, place, code, first


def _slot(code: np.ndarray) -> np.ndarray:
    return (code * 0x9E3779B1 >> 13) & (SLOTS - 1)


def _leading(row: np.ndarray, place: np.ndarray, rank: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of each word's first grams by rank, in ``FIRST`` columns, and which of them are needed.

    Needed are all up to the first two that do not overlap; grams of equal rank are taken by place.
    """
    order = np.argsort(row << 32 | rank, kind="stable")
    lead = order[first[:, None] + np.arange(FIRST)]
    spots = place[lead]
    spread = np.maximum.accumulate(spots, 1) - np.minimum.accumulate(spots, 1)
    needed = np.ones(lead.shape, bool)
    needed[:, 1:] = spread[:, :-1] < Q
    return lead, needed


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        *_, code, _ = _grams(*_letters(batch.column("word")))
        slot, n = np.unique(_slot(code), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(slot.astype(np.int32)), pa.array(n)], ["slot", "n"])


def _entered(often):
    """The lists that each word is entered in and those that it looks up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_slot = often.value.astype(np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            word, n = batch.column("word"), batch.column("n")
            data, bounds = _letters(word)
            row, place, code, first = _grams(data, bounds)
            # Common slots last; grams of one slot by their code, in eight bits less so that the row fits beside it.
            _, rank = np.unique(np.minimum(by_slot[_slot(code)], (1 << 38) - 1) << 24 | code, return_inverse=True)
            lead, needed = _leading(row, place, rank, first)
            at = lead[needed]
            gram, spot, size = code[at], place[at], np.diff(bounds)[row[at]]
            for probe, shorter, back in ((False, 0, 0), (True, 1, 0), (True, 1, 1)):
                fine = spot >= back
                cell = _mixed(gram, size - shorter, spot - back)[fine]
                kept = pa.array(row[at][fine])
                yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(np.full(len(cell), probe)), word.take(kept), n.take(kept)], ["cell", "probe", "word", "n"])

    return run


def _mixed(gram: np.ndarray, size: np.ndarray, place: np.ndarray) -> np.ndarray:
    """64-bit key of a list; two lists that share one only meet for nothing, as pairs are verified."""
    x = gram.astype(np.uint64)
    for y in (size, place):
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + y.astype(np.uint64)
    return ((x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)).view(np.int64)


def _expanded(start: np.ndarray, many: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every (i, start[i] + k), k under many[i]."""
    i = np.repeat(np.arange(len(many)), many)
    return i, start[i] + np.arange(len(i)) - (np.cumsum(many) - many)[i]


def _steps(many: np.ndarray) -> Iterator[tuple[int, int]]:
    """Stretches of about ``PAIRS`` pairs."""
    upto, first = np.cumsum(many), 0
    while first < len(many):
        last = max(first + 1, int(np.searchsorted(upto, (upto[first - 1] if first else 0) + PAIRS, "right")))
        yield first, last
        first = last


def _candidates(group: np.ndarray, probe: np.ndarray, data: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows (entry, other) of one group whose shortest lists meet; the other is an entry too, or a probe."""
    row, place, code, first = _grams(data, bounds)
    kinds, kind, often = np.unique(group[row] << 24 | code, return_inverse=True, return_counts=True)
    rank = np.empty(len(kinds), np.int64)
    rank[np.lexsort((kinds, often))] = np.arange(len(kinds))
    lead, needed = _leading(row, place, rank[kind], first)
    at = lead[needed]
    key, of, looks = kind[at] << 24 | place[at], row[at], probe[row[at]]
    own = np.flatnonzero(~looks)
    own = own[np.argsort(key[own], kind="stable")]
    keys, entries = key[own], of[own]
    # Entries among themselves: each with those behind it in its list.
    lists = [(entries, np.arange(len(keys)) + 1, np.searchsorted(keys, keys, "right") - np.arange(len(keys)) - 1)]
    asked = np.flatnonzero(looks)
    for back in (0, 1):
        some = asked[place[at[asked]] >= back]
        low = np.searchsorted(keys, key[some] - back, "left")
        lists.append((of[some], low, np.searchsorted(keys, key[some] - back, "right") - low))
    for who, start, many in lists:
        for lo, hi in _steps(many):
            i, j = _expanded(start[lo:hi], many[lo:hi])
            if len(i):
                pairs = np.unique(entries[j] * len(group) + who[lo:hi][i])
                yield pairs // len(group), pairs % len(group)


def _near(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Which rows of two matrices of letters, the second as wide or wider by one, are one edit apart."""
    size, wider = x.shape[1], y.shape[1] - x.shape[1]
    bound = y.shape[1] - 2 * Q + 1
    same = [x == y[:, k : k + size] for k in range(wider + 1)]
    shared = np.zeros((len(x), size - Q + 1), bool)
    for eq in same:
        whole = eq[:, : size - Q + 1].copy()
        for k in range(1, Q):
            whole &= eq[:, k : size - Q + 1 + k]
        shared |= whole
    fine = shared.sum(1) >= bound
    if not wider:
        return fine & (size - same[0].sum(1) == 1)
    # Letters that agree from the front, and from the back.
    front = np.where(same[0].all(1), size, np.argmin(same[0], 1))
    back = np.where(same[1].all(1), size, np.argmin(same[1][:, ::-1], 1))
    return fine & (front + back >= size)


def _verified(table: pa.Table, cells: np.ndarray) -> Iterator[pa.RecordBatch]:
    group = np.cumsum(np.concatenate(([0], (cells[:, 1:] != cells[:, :-1]).any(0)))) if cells.shape[1] else np.empty(0, int)
    probe = np.asarray(table.column("probe"))
    # A list without entries, or with one row, holds no pair.
    live = (np.bincount(group, ~probe) > 0)[group] & (np.bincount(group) > 1)[group]
    table, group, probe = table.filter(pa.array(live)), group[live], probe[live]
    word, n = table.column("word").combine_chunks(), table.column("n").combine_chunks()
    data, bounds = _letters(word)
    size = np.diff(bounds)
    if not len(size):
        return
    for a, b in _candidates(group, probe, data, bounds):
        grown = size[b] - size[a]
        for wide in np.unique(size[a]):
            for more in (0, 1):
                some = np.flatnonzero((size[a] == wide) & (grown == more))
                for k in range(0, len(some), step := max(1, 20_000_000 // int(wide))):
                    i, j = a[some[k : k + step]], b[some[k : k + step]]
                    good = _near(data[bounds[i][:, None] + np.arange(wide)], data[bounds[j][:, None] + np.arange(wide + more)])
                    i, j = pa.array(i[good]), pa.array(j[good])
                    yield pa.RecordBatch.from_arrays([word.take(i), n.take(i), word.take(j), n.take(j)], ["a", "na", "b", "nb"])


def _searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Near pairs of each (cell, i, j), whose rows come one after another."""
    held: list[pa.RecordBatch] = []
    keys = lambda t: np.stack([np.asarray(t.column(c)) for c in ("cell", "i", "j")])
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) < STEP:
            continue
        table = pa.Table.from_batches(held)
        cells = keys(table)
        cut = np.flatnonzero((cells[:, -1:] != cells).any(0))
        cut = int(cut[-1]) + 1 if len(cut) else 0
        if cut:
            yield from _verified(table.slice(0, cut), cells[:, :cut])
        held = table.slice(cut).to_batches()
    if held:
        table = pa.Table.from_batches(held)
        yield from _verified(table, keys(table))


def near_pairs(found: DataFrame) -> DataFrame:
    """a, na, b, nb: every pair of words (word, n) that are one edit apart, once; a is not the longer."""
    spark = found.sparkSession
    coded = found.select(F.encode("word", "ISO-8859-1").alias("word"), "n")
    counts = coded.select("word").mapInArrow(_counted, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).collect()  # one row a slot at most
    often = np.zeros(SLOTS, np.int64)
    for slot, n in counts:
        often[slot] = n
    entries = coded.mapInArrow(_entered(spark.sparkContext.broadcast(often)), ENTRY)
    large = materialize(entries.groupBy("cell").agg(F.count("*").alias("rows")).where(F.col("rows") > BLOCK).select("cell", F.ceil(F.col("rows") / BLOCK).cast("int").alias("parts")), "hot-lists")
    part = F.pmod(F.xxhash64("word"), "parts").cast("int")
    every = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda k: F.struct(F.least(k, part).alias("i"), F.greatest(k, part).alias("j")))
    alone = F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("j")))
    dealt = entries.join(large, "cell", "left").select("cell", F.explode(F.when(F.col("parts").isNull(), alone).otherwise(every)).alias("at"), "probe", "word", "n")
    lists = dealt.select("cell", "at.i", "at.j", "probe", "word", "n").repartition("cell", "i", "j").sortWithinPartitions("cell", "i", "j")
    # Words that replace a letter of each other meet in either order.
    pairs = lists.mapInArrow(_searched, PAIR)
    swap = (F.length("a") == F.length("b")) & (F.col("a") > F.col("b"))
    turned = lambda x, y: F.when(swap, F.col(y)).otherwise(F.col(x)).alias(x)
    return pairs.select(turned("a", "b"), turned("na", "nb"), turned("b", "a"), turned("nb", "na")).dropDuplicates(["a", "b"])


def _roots(forms: DataFrame) -> DataFrame:
    """word, root of every word that has a form (word, form): the steps followed double each round.

    A form occurs ten times as often as its word, so a path has a step for each power of ten of a count at most.
    """
    reach = materialize(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        on = reach.select(F.col("word").alias("_word"), F.col("root").alias("_next"))
        further = materialize(reach.join(on, F.col("root") == F.col("_word"), "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_moved")), "roots")
        if further.where("_moved").isEmpty():
            return further.select("word", "root")
        reach = further.select("word", "root")


def variants(docs: DataFrame, times: int = 10) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of ``docs`` (doc_id, text)."""
    with scratch(docs.sparkSession):
        found = materialize(words(docs), "words")
        text = lambda c: F.decode(c, "ISO-8859-1")
        pairs = materialize(near_pairs(found), "near")
        one = pairs.select(text("a").alias("word"), text("b").alias("other"), F.col("nb").alias("m"))
        both = one.unionByName(pairs.select(text("b").alias("word"), text("a").alias("other"), F.col("na").alias("m")))
        best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("m")).alias("less"), "other")).alias("best"))
        often = -F.col("best.less")
        form = F.when(often >= times * F.col("n"), F.struct(F.col("best.other").alias("form"), often.alias("form_n")))
        judged = found.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), form.alias("f"))
        judged = materialize(judged.select("word", "n", "n_near", "f.form", "f.form_n"), "forms")
        roots = _roots(judged.where("form is not null").select("word", "form"))
        rows = judged.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
        return materialize(rows, "variants", keep=True)

"""Token counts of a byte-level BPE vocabulary by a compiled finite-state transducer.

The splitter of the vocabulary (contractions, letters, numbers, marks, white space) is compiled to a
deterministic transducer over ten character symbols and nine states; its transitions say whether a phrase
begins.  A batch of texts is cut into chunks.  Each chunk first yields its state map, the end state for every
start state; a parallel prefix scan composes the maps, which gives every chunk its true start state; then all
chunks are walked again side by side and their transitions write out the phrase starts.

The transition that ends a phrase emits the number of tokens of that phrase.  Those weights are compiled from
the merge list: all phrases of a batch that are not in the table yet are merged together, rank by rank, and
their counts enter a table of fixed size.  A phrase of more than ``LONG`` bytes (unbroken text) is merged by itself,
over a heap of its pairs, in n log n steps.  A text's count is the sum over its transitions.

Special strings of the vocabulary inside a text are one token each and end the phrase before them, as the
library does by default.

Defined results: null and empty texts have no bytes and no tokens; repeated rows get the same result each; extra
columns are ignored; an empty table gives an empty table; very long texts are walked in chunks like others.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame

from lorebase.llm.common import text_column
from lorebase.llm.wordhash import mix, powers

#: Symbols: what the splitter sees of a character and of the two after it.
LETTER, NUMBER, MARK, SHORT, LONG, INNER, SPACE, WHITE, END = range(9)
N_SYMBOLS = 9
#: States: nothing open, in a run, a space that waits for its phrase, in a contraction with one or two letters to come, closed.
START, IN_LETTERS, IN_NUMBERS, IN_MARKS, IN_WHITE, WAITING, ONE_LEFT, TWO_LEFT, CLOSED = range(9)
N_STATES = 9
CHUNK = 256
SCHEMA = "doc_id long, n_bytes long, n_tokens long"


def compile_splitter() -> tuple[np.ndarray, np.ndarray]:
    """next state and phrase start for state * N_SYMBOLS + symbol."""
    then = np.zeros((N_STATES, N_SYMBOLS), np.uint8)
    begins = np.ones((N_STATES, N_SYMBOLS), bool)
    for symbol, run in ((LETTER, IN_LETTERS), (NUMBER, IN_NUMBERS), (MARK, IN_MARKS)):
        then[:, symbol] = run
        begins[[run, WAITING], symbol] = False
    # A quote that could open a contraction does so only where a phrase starts.
    for symbol, inside in ((SHORT, ONE_LEFT), (LONG, TWO_LEFT)):
        then[:, symbol] = inside
        then[[IN_MARKS, WAITING], symbol] = IN_MARKS
        begins[[IN_MARKS, WAITING], symbol] = False
    then[TWO_LEFT, LETTER], then[ONE_LEFT, LETTER] = ONE_LEFT, CLOSED
    begins[[TWO_LEFT, ONE_LEFT], LETTER] = False
    # White space: the last one before other text stands apart, and a space goes with what follows.
    then[:, INNER], then[:, SPACE], then[:, WHITE], then[:, END] = IN_WHITE, WAITING, CLOSED, START
    begins[IN_WHITE, INNER] = False
    return then.ravel(), begins.ravel()


@lru_cache(1)
def character_classes() -> np.ndarray:
    """LETTER, NUMBER, MARK or INNER (white space) of each code point; one more entry ends a text."""
    table = np.full(0x110001, MARK, np.uint8)
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (INNER, r"\p{White_Space}+")):
        for m in regex.finditer(pattern, every):
            low, high = (x if x < 0xD800 else x + 0x800 for x in (m.start(), m.end() - 1))
            table[low : high + 1] = kind
    table[0xD800:0xE000] = MARK
    table[0x110000] = END
    return table


def symbols(points: np.ndarray) -> np.ndarray:
    """Symbol of each code point; 0x110000 ends a text."""
    kinds = character_classes()[points]
    one, two = np.append(points[1:], 0), np.append(points[2:], (0, 0))
    quote = points == 39
    if quote.any():
        short = quote & np.isin(one, [ord(c) for c in "stmd"])
        long = quote & (((one == 114) | (one == 118)) & (two == 101) | (one == 108) & (two == 108))
        kinds[short] = SHORT
        kinds[long] = LONG
    after = np.append(kinds[1:], END)
    last = (kinds == INNER) & (after != INNER) & (after != END)
    kinds[last] = np.where(points[last] == 32, SPACE, WHITE)
    return kinds


def prefix_scan(maps: np.ndarray) -> np.ndarray:
    """Row i of the result is maps[0] followed by ... maps[i]; log2(rows) rounds over all rows at once."""
    done, step = maps.copy(), 1
    while step < len(done):
        done[step:] = np.take_along_axis(done[step:], done[:-step], axis=1)
        step *= 2
    return done


def phrase_starts(symbol: np.ndarray) -> np.ndarray:
    """Whether a phrase begins at each position."""
    then, begins = compile_splitter()
    lanes = -(-len(symbol) // CHUNK)
    grid = np.full(lanes * CHUNK, END, np.uint8)
    grid[: len(symbol)] = symbol
    grid = np.ascontiguousarray(grid.reshape(lanes, CHUNK).T)
    state = np.repeat(np.arange(N_STATES, dtype=np.uint8)[:, None], lanes, axis=1)
    for row in grid:
        state = then[state * np.uint8(N_SYMBOLS) + row]
    maps = prefix_scan(np.ascontiguousarray(state.T))
    state = np.concatenate(([np.uint8(START)], maps[:-1, START]))
    out = np.empty(grid.shape, bool)
    for j, row in enumerate(grid):
        at = state * np.uint8(N_SYMBOLS) + row
        out[j] = begins[at]
        state = then[at]
    return np.ascontiguousarray(out.T).ravel()[: len(symbol)]


class Merges:
    """The merge list as layered hash tables: (left, right) -> rank and merged token."""

    BITS = 19
    LONG = 100
    NEVER = np.int32(2**31 - 1)

    def __init__(self, vocabulary: str):
        with open(vocabulary, encoding="utf-8") as f:
            spec = json.load(f)
        ids = spec["model"]["vocab"]
        self.specials = [t["content"] for t in spec["added_tokens"]]
        # Byte-level alphabets write a byte as itself if it prints, else as the next code point from 256 on.
        prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in prints]
        names = {b: chr(b) for b in prints} | {b: chr(256 + i) for i, b in enumerate(hidden)}
        self.first = np.array([ids[names[b]] for b in range(256)], np.int64)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        left = np.array([ids[a] for a, _ in pairs], np.uint64)
        right = np.array([ids[b] for _, b in pairs], np.uint64)
        key, rank = left << np.uint64(32) | right, np.arange(len(pairs), dtype=np.int32)
        merged = np.array([ids[a + b] for a, b in pairs], np.int64)
        self.merged = merged
        self.pairs = dict(zip((left << np.uint64(24) | right).tolist(), range(len(pairs)), strict=True))
        self.layers: list[tuple[np.ndarray, np.ndarray]] = []
        todo = np.arange(len(key))
        while len(todo):
            keys = np.full(1 << self.BITS, np.iinfo(np.uint64).max, np.uint64)
            ranks = np.full(1 << self.BITS, self.NEVER, np.int32)
            slot = self._slot(key[todo], len(self.layers))
            _, chosen = np.unique(slot, return_index=True)
            keys[slot[chosen]], ranks[slot[chosen]] = key[todo[chosen]], rank[todo[chosen]]
            self.layers.append((keys, ranks))
            todo = np.delete(todo, chosen)

    def _slot(self, key: np.ndarray, layer: int) -> np.ndarray:
        return (mix(key + np.uint64(layer)) >> np.uint64(64 - self.BITS)).astype(np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.uint64) << np.uint64(32) | right.astype(np.uint64)
        out = np.full(len(key), self.NEVER, np.int32)
        for n, (keys, ranks) in enumerate(self.layers):
            slot = self._slot(key, n)
            out = np.where(keys[slot] == key, ranks[slot], out)
        return out

    def long_count(self, data: bytes) -> int:
        """Number of tokens of one phrase: pairs leave a heap by rank, then place, and tokens form a linked list."""
        start = self.first[np.frombuffer(data, np.uint8)]
        ranks = self.rank(start[:-1], start[1:]).astype(np.int64)
        places = np.flatnonzero(ranks != self.NEVER)
        # Sorted, so already a heap.
        heap = np.sort(ranks[places] << 40 | places).tolist()
        token, rank_of, merged = start.tolist(), self.pairs.get, self.merged.tolist()
        n = left = len(token)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        pop, push = heapq.heappop, heapq.heappush
        while heap:
            x = pop(heap)
            i, rank = x & 0xFFFFFFFFFF, x >> 40
            j = after[i]
            # Out of date if the token is gone or has another neighbour by now.
            if j == n or token[i] < 0 or rank_of(token[i] << 24 | token[j]) != rank:
                continue
            now = token[i] = merged[rank]
            token[j] = -1
            left -= 1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (r := rank_of(now << 24 | token[k])) is not None:
                    push(heap, r << 40 | i)
            h = before[i]
            if h >= 0 and (r := rank_of(token[h] << 24 | now)) is not None:
                push(heap, r << 40 | h)
        return left

    def counts(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Number of tokens of each phrase data[start : start + length]."""
        out = np.empty(len(starts), np.int64)
        long = lengths > self.LONG
        out[~long] = self._short_counts(data, starts[~long], lengths[~long])
        out[long] = [self.long_count(data[s : s + n].tobytes()) for s, n in zip(starts[long], lengths[long], strict=True)]
        return out

    def _short_counts(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Number of tokens of short phrases, all merged together."""
        out = lengths.astype(np.int64).copy()
        phrase = np.repeat(np.arange(len(starts)), lengths)
        at = np.arange(len(phrase)) - np.repeat(np.cumsum(lengths) - lengths, lengths) + np.repeat(starts, lengths)
        token = self.first[data[at]]
        while len(token) > 1:
            same = phrase[1:] == phrase[:-1]
            rank = np.full(len(token), self.NEVER, np.int32)
            rank[:-1][same] = self.rank(token[:-1][same], token[1:][same])
            heads = np.flatnonzero(np.concatenate(([True], ~same)))
            best = np.minimum.reduceat(rank, heads)
            sizes = np.diff(np.append(heads, len(token)))
            if (best == self.NEVER).any():
                # Phrases without a merge are done.
                open_ = best != self.NEVER
                stays = np.repeat(open_, sizes)
                token, phrase, rank = token[stays], phrase[stays], rank[stays]
                best, sizes = best[open_], sizes[open_]
                if not len(token):
                    break
            hit = rank == np.repeat(best, sizes)
            # Of overlapping pairs every second one is merged, from the left.
            index = np.arange(len(hit))
            since = index - np.maximum.accumulate(np.where(hit, -1, index))
            hit &= since % 2 == 1
            token[hit] = self.merged[rank[hit]]
            gone = np.concatenate(([False], hit[:-1]))
            np.subtract.at(out, phrase[gone], 1)
            token, phrase = token[~gone], phrase[~gone]
        return out


class Counter:
    """Counts tokens of texts; keeps the weights of phrases seen before in a table of fixed size."""

    SLOTS = 1 << 20

    def __init__(self, vocabulary: str):
        self.merges = Merges(vocabulary)
        self.special = re.compile("|".join(map(re.escape, self.merges.specials))) if self.merges.specials else None
        self.keys = np.zeros(self.SLOTS, np.uint64)
        self.weights = np.zeros(self.SLOTS, np.int64)

    def _weights(self, hashes: np.ndarray, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        distinct, where, back = np.unique(hashes, return_index=True, return_inverse=True)
        slot = (distinct & np.uint64(self.SLOTS - 1)).astype(np.int64)
        known = self.keys[slot] == distinct
        weight = np.where(known, self.weights[slot], 0)
        new = np.flatnonzero(~known)
        if len(new):
            weight[new] = self.merges.counts(data, starts[where[new]], lengths[where[new]])
            self.keys[slot[new]], self.weights[slot[new]] = distinct[new], weight[new]
        return weight[back]

    def count(self, texts: list[str]) -> np.ndarray:
        pieces, owner, extra = [], [], np.zeros(len(texts), np.int64)
        for i, t in enumerate(texts):
            parts = self.special.split(t) if self.special and self.special.search(t) else [t]
            extra[i] = len(parts) - 1
            pieces += parts
            owner += [i] * len(parts)
        # Texts end to end, each followed by one end symbol, which is a phrase of one byte that counts nothing.
        points = np.frombuffer("\0".join([*pieces, ""]).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        ends = np.cumsum([len(p) + 1 for p in pieces]) - 1
        points[ends] = 0x110000
        data = np.frombuffer("\0".join([*pieces, ""]).encode("utf-8", "surrogatepass"), np.uint8)
        starts = np.flatnonzero(phrase_starts(symbols(points)))
        width = 1 + (points >= 0x80).astype(np.int8) + (points >= 0x800) + (points >= 0x10000)
        width[ends] = 1
        offset = np.concatenate(([0], np.cumsum(width, dtype=np.int64)))
        at, lengths = offset[starts], np.diff(np.append(offset[starts], len(data)))
        place = np.arange(len(data)) - np.repeat(at, lengths)
        letters = _TABLE[data] * powers(0x9E3779B97F4A7C15, int(lengths.max()))[place]
        hashes = mix(np.add.reduceat(letters, at) + lengths.astype(np.uint64)) | np.uint64(1)
        weight = self._weights(hashes, data, at, lengths)
        weight[points[starts] == 0x110000] = 0
        per_piece = np.add.reduceat(weight, np.searchsorted(starts, ends - [len(p) for p in pieces]))
        np.add.at(extra, owner, per_piece)
        return extra


_TABLE = np.random.default_rng(7).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


@lru_cache(2)
def counter(vocabulary: str) -> Counter:
    """One compiled counter for each worker process and vocabulary."""
    return Counter(vocabulary)


def count_tokens(docs: DataFrame, vocabulary: str, limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit: one row per row of ``docs`` (doc_id, text)."""
    from pyspark.sql import functions as F

    from lorebase.llm.wordhash import slices

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        count = counter(vocabulary).count
        for pdf in batches:
            texts = pdf["text"].tolist()
            tokens = [count(texts[a:b]) for a, b in slices(texts)]
            sizes = [len(t.encode("utf-8", "surrogatepass")) for t in texts]
            yield pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"), "n_bytes": sizes, "n_tokens": np.concatenate([np.empty(0, np.int64), *tokens])})

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_column(docs).alias("text"))
    return slim.mapInPandas(run, SCHEMA).withColumn("over_limit", F.col("n_tokens") > limit)

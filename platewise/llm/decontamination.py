"""Benchmark phrases found in documents through an FM-index per training shard.

A shard is a few megabytes of documents. Its words are numbered, the documents stand one
after another with a separator between them, and a suffix array of this text gives its
Burrows-Wheeler transform. A wavelet matrix over the transform counts a word in any prefix
by ranks of bits, one level for each bit of the word's number. A phrase of the benchmark is
searched backwards, word by word, for all phrases at once; what is left is the interval of
rows whose suffixes begin with it. Rows whose text position is a multiple of ``sample`` keep
it; from any other row, steps of the last-to-first mapping lead to such a row. The places
found become spans of words, merged per document. A shard that lacks words of every phrase
has no occurrence and needs no index.

The benchmark is a stated set of queries. It is read in blocks of at most
``BLOCK_BYTES`` of text, one at a time, and each block is broadcast; a benchmark of more than one
block passes over the documents once for each. No row depends on another document, so hot
sources or groups of copies need nothing special.

Null and empty texts have no words and are never hit; items without words match nothing,
and items without an id are searched and removed but not counted. Equal phrases of several
items count for each of them, items with equal ids once. Columns added replace those of
the same name.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from platewise.llm.common import (
    arrow_schema,
    importable,
    replaced,
    slices,
    staged,
    table,
    with_columns,
)
from platewise.llm.words import ALNUM, Words, covered, without

WINDOW_WORDS = 10
SHARD_BYTES = 4 << 20
BLOCK_BYTES = 8 << 20
SAMPLE = 16


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Order of all suffixes of ``text``, whose last symbol is its only zero.

    The first sort looks at three symbols; each further round at twice as many as the one
    before, and only among suffixes that are still equal.
    """
    n = len(text)
    padded = np.concatenate([text.astype(np.int64), np.zeros(3, np.int64)])
    bits = max(1, int(text.max()).bit_length())
    if 3 * bits <= 63:
        key, seen = (padded[:n] << 2 * bits) | (padded[1 : n + 1] << bits) | padded[2 : n + 2], 3
    else:
        key, seen = padded[:n], 1
    order = np.argsort(key, kind="stable")
    sorted_key = key[order]
    new = np.append(True, sorted_key[1:] != sorted_key[:-1])
    rank = np.zeros(2 * n + 1, np.int64)  # beyond the text: zero
    places = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank[order] = places + 1
    open_places = np.arange(n)
    while True:
        open_places = open_places[~(new & np.append(new[1:], True))]
        if not len(open_places):
            return order
        rows = order[open_places]
        first = rank[rows]
        second = rank[np.minimum(rows + seen, 2 * n)]
        by = np.lexsort((second, first)) if n >= 1 << 31 else np.argsort(first << 32 | second, kind="stable")
        rows, first, second = rows[by], first[by], second[by]
        order[open_places] = rows
        new = np.append(True, (first[1:] != first[:-1]) | (second[1:] != second[:-1]))
        rank[rows] = np.maximum.accumulate(np.where(new, open_places, 0)) + 1
        seen *= 2


@dataclass
class FMIndex:
    """Index of a text of word numbers from 1 on; see ``build``."""

    zeros: list[int]  #: wavelet matrix: clear bits of each level, the highest bit first
    ones: list[np.ndarray]  #: set bits before each place of a level
    first: np.ndarray  #: rows that begin with a smaller symbol, by symbol
    begins: np.ndarray  #: where a symbol's places begin below the last level
    marked: np.ndarray  #: sampled rows before each row
    sampled: np.ndarray  #: text positions of the sampled rows, in order of rows

    @classmethod
    def build(cls, text: np.ndarray, sample: int = SAMPLE) -> FMIndex:
        """``text``: symbols of at least 1. A zero is added as its end."""
        text = np.append(text, 0)
        order = suffix_array(text)
        symbols = text[order - 1]
        size = int(text.max()) + 1
        first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=size))])
        zeros, ones = [], []
        for level in reversed(range(max(1, (size - 1).bit_length()))):
            bit = (symbols >> level) & 1
            sums = np.zeros(len(bit) + 1, np.int32)
            np.cumsum(bit, out=sums[1:])
            ones.append(sums)
            zeros.append(len(bit) - int(sums[-1]))
            symbols = np.concatenate([symbols[bit == 0], symbols[bit == 1]])
        kept = order % sample == 0
        marked = np.concatenate([[0], np.cumsum(kept)])
        index = cls(zeros, ones, first, np.zeros(size, np.int64), marked, order[kept])
        index.begins = index._down(np.arange(size), np.zeros(size, np.int64))
        return index

    def _down(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        levels = len(self.ones)
        for k, (zeros, ones) in enumerate(zip(self.zeros, self.ones, strict=True)):
            before = ones[at]
            at = np.where((symbols >> (levels - 1 - k)) & 1, zeros + before, at - before)
        return at

    def rank(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol is in the transform before a place."""
        return self._down(symbols, at) - self.begins[symbols]

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of rows whose suffixes begin with the phrases; their symbols stand at
        the end of the rows of ``phrases``, and -1 is a symbol that the text lacks."""
        low = np.zeros(len(phrases), np.int64)
        high = np.full(len(phrases), len(self.marked) - 1, np.int64)
        for back in range(1, phrases.shape[1] + 1):
            live = np.flatnonzero((lengths >= back) & (low < high))
            symbols = phrases[live, -back]
            high[live[symbols < 0]] = low[live[symbols < 0]]
            live, symbols = live[symbols >= 0], symbols[symbols >= 0]
            for bound in (low, high):
                bound[live] = self.first[symbols] + self.rank(symbols, bound[live])
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of rows."""
        out, steps = np.empty(len(rows), np.int64), 0
        waiting, at = np.arange(len(rows)), rows.copy()
        while len(waiting):
            known = self.marked[at + 1] > self.marked[at]
            out[waiting[known]] = self.sampled[self.marked[at[known]]] + steps
            waiting, at = waiting[~known], at[~known]
            symbols, place = np.zeros(len(at), np.int64), at
            for zeros, ones in zip(self.zeros, self.ones, strict=True):
                before = ones[place]
                bit = ones[place + 1] - before
                symbols = symbols << 1 | bit
                place = np.where(bit, zeros + before, place - before)
            at = self.first[symbols] + place - self.begins[symbols]
            steps += 1
        return out


@dataclass
class Phrases:
    """Distinct phrases of a block of items."""

    vocabulary: dict[bytes, int]
    symbols: np.ndarray  #: a row per phrase, at the end of the row
    lengths: np.ndarray
    items: list[list[int]]  #: ids of the items of each phrase


def phrases_of(items: list[tuple[int | None, str]], window: int = WINDOW_WORDS) -> Phrases:
    """All windows of the items; a shorter item is one window."""
    found: dict[tuple[bytes, ...], set[int | None]] = {}
    for item, text in items:
        words = (text or "").encode().translate(ALNUM).split()
        for i in range(max(1, len(words) - window + 1) if words else 0):
            found.setdefault(tuple(words[i : i + window]), set()).add(item)
    vocabulary: dict[bytes, int] = {}
    symbols = np.full((len(found), window), -1, np.int64)
    for row, phrase in zip(symbols, found, strict=True):
        row[window - len(phrase) :] = [vocabulary.setdefault(w, len(vocabulary)) for w in phrase]
    ids = [sorted(i for i in s if i is not None) for s in found.values()]
    return Phrases(vocabulary, symbols, np.array([len(p) for p in found], np.int64), ids)


def occurrences(words: Words, phrases: Phrases) -> tuple[np.ndarray, np.ndarray]:
    """(first word, number of the phrase) of all occurrences in the texts of ``words``."""
    none = np.zeros(0, np.int64), np.zeros(0, np.int64)
    if not len(words) or not len(phrases.lengths):
        return none
    keys, at, numbers = np.unique(words.hashes(), return_index=True, return_inverse=True)
    # Word numbers from 2 on; 1 stands after each text.
    counts = np.diff(words.first)
    place = np.arange(len(words)) + np.repeat(np.arange(len(counts)), counts)
    text = np.ones(len(words) + len(counts), np.int64)
    text[place] = numbers + 2
    known = np.full(len(phrases.vocabulary) + 1, -1, np.int64)  # the last is for symbol -1
    spans = zip(words.starts[at].tolist(), words.ends[at].tolist(), strict=True)
    for number, (a, b) in enumerate(spans):
        symbol = phrases.vocabulary.get(words.joined[a:b])
        if symbol is not None:
            known[symbol] = number + 2
    symbols = known[phrases.symbols]
    inside = np.arange(symbols.shape[1]) >= symbols.shape[1] - phrases.lengths[:, None]
    able = np.flatnonzero(((symbols >= 0) | ~inside).all(axis=1))
    if not len(able):
        return none
    index = FMIndex.build(text)
    low, high = index.search(symbols[able], phrases.lengths[able])
    n = high - low
    rows = np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    position = index.locate(rows)
    return np.searchsorted(place, position), np.repeat(able, n)


def _search(
    batches: Iterator[pa.RecordBatch], block, schema: pa.Schema, more: bool, cut: bool
) -> Iterator[pa.RecordBatch]:
    """``more``: the rows have spans and items of blocks before. ``cut``: the words of all
    spans are cut out of the texts."""
    phrases: Phrases = block.value
    for batch, texts in slices(batches, "text", SHARD_BYTES):
        words = Words.of(texts, ALNUM)
        starts, numbers = occurrences(words, phrases)
        row = np.searchsorted(words.first, starts, side="right") - 1
        n_words = np.diff(words.first)
        spans: list[list[dict]] = [[] for _ in texts]
        items: list[list[int]] = [[] for _ in texts]
        before = batch.column("removal").to_pylist() if more else spans
        known = batch.column("items").to_pylist() if more else items
        hit = set(np.unique(row).tolist())
        by = np.argsort(row, kind="stable")
        cuts = np.searchsorted(row[by], np.arange(len(texts) + 1))
        for i in range(len(texts)):
            if i not in hit:
                spans[i], items[i] = before[i], known[i]
                continue
            own = by[cuts[i] : cuts[i + 1]]
            at = starts[own] - words.first[i]
            lengths = phrases.lengths[numbers[own]]
            at = np.concatenate([at, np.array([s["begin"] for s in before[i]], np.int64)])
            lengths = np.concatenate(
                [lengths, np.array([s["end"] - s["begin"] for s in before[i]], np.int64)]
            )
            inside = covered(int(n_words[i]), at, lengths).view(np.int8)
            steps = np.flatnonzero(np.diff(np.concatenate([[0], inside, [0]])))
            spans[i] = [{"begin": int(a), "end": int(b)} for a, b in steps.reshape(-1, 2)]
            found = {x for p in np.unique(numbers[own]).tolist() for x in phrases.items[p]}
            items[i] = sorted(found.union(known[i]))
        kept = batch.column("text")
        if cut:
            runs = [[(s["begin"], s["end"]) for s in x] for x in spans]
            kept = [
                without(texts[i], r, ALNUM).decode() if r else t
                for i, (r, t) in enumerate(zip(runs, kept.to_pylist(), strict=True))
            ]
        yield replaced(
            batch,
            schema,
            text=kept,
            n_words=n_words,
            n_hit=[sum(s["end"] - s["begin"] for s in x) for x in spans],
            removal=pa.array(spans, schema.field("removal").type),
            items=pa.array(items, schema.field("items").type),
        )


def blocks_of(benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> Iterator[list[tuple]]:
    """Items (item_id, text) in blocks of bounded text; the driver holds one at a time."""
    block, held = [], 0
    for r in benchmark.select(F.col("item_id").cast("long"), "text").toLocalIterator():
        size = len((r[1] or "").encode())
        if block and held + size > block_bytes:
            yield block
            block, held = [], 0
        block.append((r[0], r[1]))
        held += size
    yield block


def find_leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = WINDOW_WORDS,
    block_bytes: int = BLOCK_BYTES,
    cut: bool = False,
) -> DataFrame:
    """All documents with ``n_words``, ``n_hit``, ``removal`` (spans of hit words) and
    ``items`` (ids of the items found, in order). With ``cut`` the spans are cut out of the
    texts; that is done in the last search, so that a task needs one Python worker."""
    schema = with_columns(
        docs,
        ("n_words", "long"),
        ("n_hit", "long"),
        ("removal", "array<struct<begin: int, end: int>>"),
        ("items", "array<bigint>"),
    )
    found = docs.drop("n_words", "n_hit", "removal", "items")
    blocks, number = blocks_of(benchmark, block_bytes), 0
    block: list[tuple] | None = next(blocks)
    while block is not None:
        after = next(blocks, None)
        if number:
            found = staged(found, "decontamination")
        phrases = docs.sparkSession.sparkContext.broadcast(phrases_of(block, window))
        how = {"more": number > 0, "cut": cut and after is None}
        search = partial(_search, block=phrases, schema=arrow_schema(schema), **how)
        found = importable(found).mapInArrow(search, schema)
        block, number = after, number + 1
    return found


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_leaks(docs, table(spark, sf_dir, "benchmark"))
    listed = F.array_join(F.sort_array(F.transform("items", lambda x: x.cast("string"))), ",")
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(listed, 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )

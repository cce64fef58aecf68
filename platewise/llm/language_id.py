"""Language identification by cross-parsing.

A suffix automaton of labelled text of a language accepts exactly what occurs in it. A
document is parsed from left to right into the longest phrases that the automaton of a
language accepts; a letter that the language lacks is a phrase of its own. The fewer phrases
a language needs, the better it describes the document. Phrases times the logarithm of the
length of the labelled text, by the length of the document, estimate bits per letter;
the language of the fewest wins, the first by name of equals.

Letters are compared in lower case; whatever lies between letters counts as one blank. Texts
are parsed in blocks of ``BLOCK`` letters, all of them, and all blocks of a batch side by
side, one letter at a time. Learning takes at most ``TRAIN_ROWS`` documents of each
language, in the order of a hash of the id, ``TRAIN_CUT`` letters of each and
``TRAIN_LETTERS`` in all; that bounds the automata, which every task gets.

Null texts and texts without a letter are ``und`` with score 0. Without learned languages
every text is. Documents without an id are predicted, never learned from. Columns added
replace those of the same name.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from platewise.llm.common import (
    arrow_schema,
    ascii_crc32,
    importable,
    replaced,
    slices,
    table,
    with_columns,
)

TRAIN_ROWS = 64
TRAIN_CUT = 1000
TRAIN_LETTERS = 20_000
BLOCK = 1024
UNKNOWN = "und"


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """For each code point its letter in lower case, or 0 if it is none."""
    out = np.zeros(0x110000, np.uint32)
    for c in range(0x110000):
        x = chr(c)
        if x.isalpha():
            low = x.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


def normalised(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Letters of all texts, 0 for a blank between them, and the first place of each text."""
    sizes = np.array([len(t) for t in texts], np.int64)
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    low = letters()[points]
    ends = np.cumsum(sizes)
    first = np.zeros(len(low) + 1, bool)
    first[ends - sizes] = True
    # A blank stays only right after a letter of the same text.
    kept = low > 0
    kept[1:] |= (low[:-1] > 0) & ~first[1 : len(low)]
    places = np.concatenate([[0], np.cumsum(kept)])
    return low[kept], places[np.concatenate([[0], ends])]


def suffix_automaton(text: list[int], symbols: int) -> np.ndarray:
    """Transitions by state and symbol, -1 for none; state 0 is the start."""
    goes: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in text:
        new = len(goes)
        goes.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in goes[p]:
            goes[p][c] = new
            p = link[p]
        if p >= 0:
            q = goes[p][c]
            if length[p] + 1 == length[q]:
                link[new] = q
            else:
                split = len(goes)
                goes.append(dict(goes[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and goes[p].get(c) == q:
                    goes[p][c] = split
                    p = link[p]
                link[q] = link[new] = split
        last = new
    out = np.full((len(goes), symbols), -1, np.int32)
    for state, to in enumerate(goes):
        out[state, list(to)] = list(to.values())
    return out


@dataclass
class Model:
    alphabet: np.ndarray  #: letters in order; symbol 0 is a blank, the last any other letter
    names: list[str]
    tables: list[np.ndarray]  #: by language: transitions, with a last state that has none
    bits: np.ndarray  #: by language: the logarithm of the length of its text

    @classmethod
    def of(cls, learned: dict[str, list[str]]) -> Model:
        """``learned``: texts of each language."""
        names = sorted(learned)
        texts = [_joined(learned[n]) for n in names]
        alphabet = np.unique(np.concatenate([np.zeros(0, np.uint32), *texts]))
        alphabet = alphabet[alphabet > 0]
        model = cls(alphabet, names, [], np.array([math.log2(len(t) + 2) for t in texts]))
        for t in texts:
            goes = suffix_automaton(model.symbols(t).tolist(), len(alphabet) + 2)
            model.tables.append(np.vstack([goes, np.full((1, goes.shape[1]), -1, np.int32)]))
        return model

    def symbols(self, low: np.ndarray) -> np.ndarray:
        if not len(self.alphabet):
            return np.where(low > 0, 1, 0).astype(np.int64)
        at = np.minimum(np.searchsorted(self.alphabet, low), len(self.alphabet) - 1)
        known = self.alphabet[at] == low
        return np.where(low == 0, 0, np.where(known, at + 1, len(self.alphabet) + 1))

    def phrases(self, low: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Phrases that each language needs for each text."""
        sizes = np.diff(first)
        n_blocks = -(-sizes // BLOCK)
        text = np.repeat(np.arange(len(sizes)), n_blocks)
        number = np.arange(len(text)) - np.repeat(np.cumsum(n_blocks) - n_blocks, n_blocks)
        begin = first[text] + number * BLOCK
        length = np.minimum(first[text + 1] - begin, BLOCK)
        order = np.argsort(-length, kind="stable")
        text, begin, length = text[order], begin[order], length[order]
        symbols = np.append(self.symbols(low), 0)
        steps = int(length[0]) if len(length) else 0
        active = np.searchsorted(-length, -np.arange(steps), side="left")
        out = np.zeros((len(self.names), len(sizes)), np.int64)
        for k, goes in enumerate(self.tables):
            width, nowhere = goes.shape[1], len(goes) - 1
            flat = goes.ravel()
            restart = np.where(goes[0] < 0, nowhere, goes[0])
            state = np.full(len(length), nowhere, np.int64)
            count = np.zeros(len(length), np.int64)
            for step in range(steps):
                n = active[step]
                c = symbols[begin[:n] + step]
                to = flat[state[:n] * width + c]
                ended = to < 0
                count[:n] += ended
                state[:n] = np.where(ended, restart[c], to)
            out[k] = np.bincount(text, weights=count, minlength=len(sizes))
        return out

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """Language and margin of each text."""
        low, first = normalised(texts)
        sizes = np.diff(first)
        lettered = np.add.reduceat(np.append(low > 0, False), first[:-1], dtype=np.int64) > 0
        lettered &= sizes > 0
        if not self.names:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        bits = self.phrases(low, first) * self.bits[:, None] / np.maximum(sizes, 1)
        best = bits.argmin(axis=0)
        ordered = np.sort(bits, axis=0)
        margin = np.ones(len(texts))
        if len(bits) > 1:
            margin = (ordered[1] - ordered[0]) / np.maximum(ordered[1], 1e-9)
        names = [self.names[b] if ok else UNKNOWN for b, ok in zip(best, lettered, strict=True)]
        return names, np.where(lettered, np.clip(margin, 0, 1), 0.0)


def _joined(texts: list[str]) -> np.ndarray:
    """The first letters of each text, one after another with a blank between."""
    parts, held = [], 0
    for t in texts:
        low, _ = normalised([t])
        part = np.append(low[: min(TRAIN_CUT, TRAIN_LETTERS - held)], np.uint32(0))
        parts.append(part)
        held += len(part)
        if held >= TRAIN_LETTERS:
            break
    return np.concatenate([np.zeros(0, np.uint32), *parts])


def learned(docs: DataFrame) -> Model:
    """Ids of texts with a letter are chosen by language and hash first; only the letters of
    their texts are taken, and these are cut after all else between them has become a blank."""
    lettered = F.col("text").rlike(r"\p{L}")
    usable = docs.filter(F.col("lang").isNotNull() & (ascii_crc32(F.col("doc_id")) % 5 != 0) & lettered)
    by_hash = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    chosen = (
        usable.select("doc_id", "lang")
        .withColumn("n", F.row_number().over(by_hash))
        .filter(F.col("n") <= TRAIN_ROWS)
    )
    # Rows with equal ids may meet each other's language; both conditions must hold.
    # Bounded by TRAIN_ROWS for each language, as the automata are: no text is shuffled.
    texts = docs.select("doc_id", "lang", "text").join(F.broadcast(chosen), ["doc_id", "lang"])
    by_lang: dict[str, list[str]] = {}
    only_letters = F.ltrim(F.regexp_replace("text", r"[^\p{L}]+", " "))
    found = texts.select("lang", "n", F.substring(only_letters, 1, TRAIN_CUT).alias("text"))
    for r in found.orderBy("lang", "n", "text").toLocalIterator():
        if r["text"]:
            by_lang.setdefault(r["lang"], []).append(r["text"])
    return Model.of(by_lang)


def identify(docs: DataFrame) -> DataFrame:
    """All documents with ``lang_pred`` and ``score``."""
    # Bounded by the parameters for each language.
    model = docs.sparkSession.sparkContext.broadcast(learned(docs))
    schema = with_columns(docs, ("lang_pred", "string"), ("score", "double"))
    predict = partial(_predict, model=model, schema=arrow_schema(schema))
    return importable(docs).mapInArrow(predict, schema)


def _predict(batches: Iterator[pa.RecordBatch], model, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for batch, texts in slices(batches, "text"):
        names, scores = model.value.predict([t.decode() for t in texts])
        yield replaced(batch, schema, lang_pred=names, score=scores)


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return identify(docs).select(
        "doc_id",
        F.coalesce(ascii_crc32(F.col("doc_id")) % 5 == 0, F.lit(False)).alias("held_out"),
        "lang_pred",
        "score",
    )

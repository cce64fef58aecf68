"""Removal of passages that occur more than once in the corpus.

A window is ``window`` consecutive words. A word is removed if a window that covers it
starts at another place too, in the same or another document.

1. Phrases. Each window names one phrase of ``phrase`` words in it, that of the smallest
   hash, the first of equals. Equal windows name equal phrases, so a window can only
   recur if its phrase is named at two places. Documents name one phrase in about
   fourteen words; their keys are counted, and those named twice recur.
2. Automata. Documents are dealt into parts of about ``rows_per_part`` rows, and so are
   the recurring keys that a part named. A task compiles an Aho-Corasick automaton from
   the recurring phrases of its part and streams the documents of the part through it,
   which locates every occurrence of every phrase. The windows that hold an occurrence
   of the phrase they name are candidates, and their keys are counted over all parts.
3. Removal. Keys of windows that start at two places or more go back to the parts that
   sent them, and the parts cut the covered words out of their documents.

Keys are 64-bit hashes, exchanged between buckets of keys and parts of documents in
arrays. A key that a slice of documents has twice is known to recur: the parts that have it
are told at once, and its bucket gets one entry for the whole slice. So a passage in a third
of all documents costs its bucket one entry per slice, not one per document.

A null text has no words; the document stays with nothing removed. Rows with equal ids
are documents of their own. Columns added replace those of the same name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from platewise.llm.common import (
    arrow_schema,
    checkpointed,
    importable,
    replaced,
    shuffle_partitions,
    slices,
    with_columns,
)
from platewise.llm.words import Words, covered, run_hashes, without

WINDOW_WORDS = 35
PHRASE_WORDS = 8
ROWS_PER_PART = 1000

KEYS = "bucket int, part int, keys binary, parts binary"
BACK = "part int, keys binary"
_KEYS = pa.schema(
    [("bucket", pa.int32()), ("part", pa.int32()), ("keys", pa.binary()), ("parts", pa.binary())]
)
_BACK = pa.schema([("part", pa.int32()), ("keys", pa.binary())])


def named_phrases(
    words: Words, hashes: np.ndarray, window: int, phrase: int
) -> tuple[np.ndarray, np.ndarray]:
    """The windows of all texts by their first word, and the first word of the phrase
    that each names; ``hashes`` are those of all runs of ``phrase`` words."""
    starts = np.flatnonzero(words.left() >= window)
    if not len(starts):
        return starts, starts
    span = window - phrase + 1
    best, at, width = hashes, np.arange(len(hashes)), 1
    while width < span:
        step = min(width, span - width)
        later, later_at = best[step:], at[step:]
        smaller = later < best[: len(later)]
        best = np.where(smaller, later, best[: len(later)])
        at = np.where(smaller, later_at, at[: len(later_at)])
        width += step
    return starts, at[starts]


def dealt(docs: DataFrame, rows_per_part: int) -> tuple[DataFrame, int]:
    """``docs`` with a column of the part, and the number of parts: documents are dealt
    by their content and id, so that no source or group of copies shares one."""
    parts = max(1, -(-docs.count() // rows_per_part))
    number = F.pmod(F.xxhash64("doc_id", "text"), F.lit(parts))
    return docs.withColumn("__part", number.cast("int")), parts


def packed_keys(part: np.ndarray, keys: np.ndarray, buckets: int) -> pa.RecordBatch:
    """Rows of KEYS from the part and key of each place.

    A key of one place goes to its bucket with its part. A key of more places is known to
    recur: it goes to its bucket once, without a part, and every part that has it is told
    by a row that only passes through a bucket chosen by the part.
    """
    order = np.lexsort((part, keys))
    part, keys = part[order].astype(np.int32), keys[order]
    new = np.append(True, keys[1:] != keys[:-1])
    at = np.flatnonzero(new)
    many = np.diff(np.append(at, len(keys))) > 1
    recurs = np.repeat(many, np.diff(np.append(at, len(keys))))
    told = recurs & (new | np.append(True, part[1:] != part[:-1]))
    sent, sender = keys[at], np.where(many, np.int32(-1), part[at]).astype(np.int32)
    bucket = (sent % np.uint64(buckets)).astype(np.int32)
    rows = [(b, None, k, p) for b, k, p in _split(bucket, sent, sender)]
    rows += [(p % buckets, p, k, None) for p, k in _split(part[told], keys[told])]
    columns = [list(c) for c in zip(*rows, strict=True)]
    return pa.RecordBatch.from_arrays(
        [pa.array(c, f.type) for c, f in zip(columns, _KEYS, strict=True)], schema=_KEYS
    )


def _split(by: np.ndarray, *arrays: np.ndarray) -> Iterator[tuple]:
    """Each value of ``by`` with the bytes of its share of each array."""
    order = np.argsort(by, kind="stable")
    by = by[order]
    at = np.flatnonzero(np.append(True, by[1:] != by[:-1])) if len(by) else by
    arrays = [a[order] for a in arrays]
    for x, y in zip(at.tolist(), [*at[1:].tolist(), len(by)], strict=False):
        yield int(by[x]), *[a[x:y].tobytes() for a in arrays]


def recurring_keys(sent: DataFrame) -> DataFrame:
    """BACK rows: the keys of two places or more, for each part that sent them.

    Buckets are dealt by hash and hold about as many keys as a part has."""
    return importable(sent).groupBy("bucket").applyInArrow(_recurring, BACK)


def _recurring(table: pa.Table) -> pa.Table:
    told = table.column("part").is_valid()
    out = [(p, k) for p, k in zip(*[table.filter(told).column(c).to_pylist() for c in ("part", "keys")], strict=True)]
    asked = table.filter(pa.compute.invert(told))
    keys = np.frombuffer(b"".join(asked.column("keys").to_pylist()), np.uint64)
    parts = np.frombuffer(b"".join(asked.column("parts").to_pylist()), np.int32)
    order = np.argsort(keys, kind="stable")
    keys, parts = keys[order], parts[order]
    same = keys[1:] == keys[:-1]
    recurs = (np.append(False, same) | np.append(same, False)) & (parts >= 0)
    out += _split(parts[recurs], keys[recurs])
    columns = [list(c) for c in zip(*out, strict=True)] or [[], []]
    return pa.table([pa.array(c, f.type) for c, f in zip(columns, _BACK, strict=True)], schema=_BACK)


def by_part(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """Documents and keys in one stream, dealt by part: the keys of a part come first."""
    blank = [F.lit(None).cast(f.dataType).alias(f.name) for f in docs.schema.fields if f.name != "__part"]
    first = keys.select(F.col("part").alias("__part"), *blank, F.col("keys").alias("__keys"))
    rows = docs.withColumn("__keys", F.lit(None).cast("binary"))
    both = first.select(rows.columns).unionByName(rows)
    return both.repartition(shuffle_partitions(docs), "__part").sortWithinPartitions(
        "__part", F.col("__keys").isNull()
    )


def parts_of(
    batches: Iterator[pa.RecordBatch], most_bytes: int = 1 << 20
) -> Iterator[tuple[np.ndarray, bool, pa.RecordBatch, list[bytes]]]:
    """Slices of documents of one part each, with the sorted keys of the part and
    whether it is the part's first slice."""
    part, found, known, first = None, [], np.zeros(0, np.uint64), True
    for batch, texts in slices(batches, "text", most_bytes):
        numbers = batch.column("__part").to_numpy()
        keys = batch.column("__keys").to_pylist()
        cuts = np.flatnonzero(np.diff(numbers)) + 1
        for a, b in zip([0, *cuts], [*cuts, len(numbers)], strict=True):
            if numbers[a] != part:
                part, found, first = numbers[a], [], True
            while a < b and keys[a] is not None:
                found.append(keys[a])
                a += 1
            if a < b:
                if first:
                    known = np.unique(np.frombuffer(b"".join(found), np.uint64))
                yield known, first, batch.slice(a, b - a), texts[a:b]
                first = False


def among(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which values are in the sorted ``known``."""
    if not len(known):
        return np.zeros(len(values), bool)
    at = np.minimum(np.searchsorted(known, values), len(known) - 1)
    return known[at] == values


def _send_phrases(
    batches: Iterator[pa.RecordBatch], window: int, phrase: int, buckets: int
) -> Iterator[pa.RecordBatch]:
    for batch, texts in slices(batches, "text"):
        words = Words.of(texts)
        hashes = run_hashes(words.hashes(), phrase)
        _, named = named_phrases(words, hashes, window, phrase)
        if len(named):
            named = named[np.append(True, named[1:] != named[:-1])]
            row = np.searchsorted(words.first, named, side="right") - 1
            yield packed_keys(batch.column("__part").to_numpy()[row], hashes[named], buckets)


def _send_windows(
    batches: Iterator[pa.RecordBatch], window: int, phrase: int, buckets: int
) -> Iterator[pa.RecordBatch]:
    """Compiles the automaton of each part and streams its documents through it."""
    for part, slices_of_part in _whole_parts(batches):
        patterns: dict[bytes, int] = {}
        read = []
        for known, texts in slices_of_part:
            words = Words.of(texts)
            hashes = run_hashes(words.hashes(), phrase)
            starts, named = named_phrases(words, hashes, window, phrase)
            if len(starts):
                first = np.append(True, named[1:] != named[:-1])
                for p in named[first][among(hashes[named[first]], known)].tolist():
                    patterns.setdefault(words.run(p, phrase), len(patterns))
            read.append(words.joined)
        if not patterns:
            continue
        automaton = compiled(patterns)
        sent = []
        for joined in read:
            words = Words.of(joined.split(b"\n"))
            found = occurrences(automaton, words, phrase)
            starts, named = named_phrases(
                words, run_hashes(words.hashes(), phrase), window, phrase
            )
            candidates = starts[found[named]] if len(starts) else starts
            sent.append(run_hashes(words.hashes(), window)[candidates])
        keys = np.concatenate(sent)
        if len(keys):
            yield packed_keys(np.full(len(keys), part, np.int32), keys, buckets)


def _whole_parts(
    batches: Iterator[pa.RecordBatch],
) -> Iterator[tuple[int, list[tuple[np.ndarray, list[bytes]]]]]:
    """The slices of each part together; a part has a bounded number of documents."""
    number, held = None, []
    for known, first, batch, texts in parts_of(batches):
        if first and held:
            yield number, held
            held = []
        number = batch.column("__part")[0].as_py()
        held.append((known, texts))
    if held:
        yield number, held


def compiled(phrases) -> ahocorasick.Automaton:
    """Automaton of phrases between blanks, over bytes read as Latin-1."""
    automaton = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
    for p in phrases:
        automaton.add_word(f" {p.decode('latin-1')} ")
    automaton.make_automaton()
    return automaton


def occurrences(automaton: ahocorasick.Automaton, words: Words, phrase: int) -> np.ndarray:
    """Which words begin an occurrence of one of the automaton's phrases. Texts are apart
    by line feeds, which no phrase holds, so every text is read as " text "."""
    text = f" {words.joined.decode('latin-1')} ".replace("\n", " \n ")
    # A text before has put two more characters in front of each word of the next ones.
    row = np.repeat(np.arange(len(words.first) - 1), np.diff(words.first))
    ends = words.ends + 1 + 2 * row
    hits = np.fromiter((end for end, _ in automaton.iter(text)), np.int64)
    out = np.zeros(len(words) + 1, bool)
    out[np.searchsorted(ends, hits) - phrase + 1] = True
    return out


def _remove(
    batches: Iterator[pa.RecordBatch], window: int, schema: pa.Schema
) -> Iterator[pa.RecordBatch]:
    for known, _, batch, texts in parts_of(batches):
        words = Words.of(texts)
        keys = run_hashes(words.hashes(), window)
        starts = np.flatnonzero(words.left() >= window)
        gone = covered(len(words), starts[among(keys[starts], known)], window)
        kept, spans, n_removed = [], [], []
        for i, text in enumerate(texts):
            a, b = words.first[i], words.first[i + 1]
            own = gone[a:b]
            steps = np.flatnonzero(np.diff(np.concatenate([[0], own.view(np.int8), [0]])))
            runs = steps.reshape(-1, 2)
            kept.append(without(text, runs.tolist()) if len(runs) else text)
            spans.append([{"begin": int(x), "end": int(y)} for x, y in runs])
            n_removed.append(int(own.sum()))
        null = batch.column("text").is_null().to_pylist()
        yield replaced(
            batch.drop_columns(["__part", "__keys"]),
            schema,
            text=[None if none else k.decode() for none, k in zip(null, kept, strict=True)],
            n_words=np.diff(words.first),
            n_removed=n_removed,
            removed=pa.array(spans, schema.field("removed").type),
        )


def remove_repeats(
    docs: DataFrame,
    window: int = WINDOW_WORDS,
    phrase: int = PHRASE_WORDS,
    rows_per_part: int = ROWS_PER_PART,
) -> DataFrame:
    """All documents with the text that stays, ``n_words`` of the input, ``n_removed``
    and ``removed``, the spans of words (begin, end) that went."""
    schema = with_columns(
        docs,
        ("n_words", "long"),
        ("n_removed", "long"),
        ("removed", "array<struct<begin: int, end: int>>"),
    )
    rows, parts = dealt(docs, rows_per_part)
    texts = rows.select("__part", "text")
    send = partial(_send_phrases, window=window, phrase=phrase, buckets=parts)
    phrases = recurring_keys(importable(texts).mapInArrow(send, KEYS))
    send = partial(_send_windows, window=window, phrase=phrase, buckets=parts)
    sent = importable(by_part(texts, checkpointed(phrases))).mapInArrow(send, KEYS)
    windows = recurring_keys(sent)
    remove = partial(_remove, window=window, schema=arrow_schema(schema))
    return importable(by_part(rows, windows)).mapInArrow(remove, schema)


def _sha256(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for batch, texts in slices(batches, "text"):
        digests = [hashlib.sha256(b" ".join(t.split())).hexdigest() for t in texts]
        yield replaced(batch, schema, kept_sha256=pa.array(digests))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    done = remove_repeats(docs).select("doc_id", "text", "n_words", "n_removed")
    schema = with_columns(done.drop("text"), ("kept_sha256", "string"))
    return importable(done).mapInArrow(partial(_sha256, schema=arrow_schema(schema)), schema)

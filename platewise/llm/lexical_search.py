"""Ranked lexical search with range-maximum tables over posting lists.

**Index.** Documents are cut into shards of about ``SHARD_BYTES`` of text, each a row: its
documents in ascending order of id, their lengths, its terms, and for each term the documents
that hold it and how often. The index is written once and serves any queries.

**Weights.** Counts over all shards give the number of documents, their length and, for the terms
asked for, the documents that hold them. All else is integer arithmetic, see ``impacts``.

**Search.** In a shard every posting list of the query has a sparse table that tells the greatest
impact of any range of documents, and where it is, from two entries. The sum of these over the
terms bounds the score of every document of an interval. Intervals are taken best first: the
document where one term has its greatest impact is scored, and cuts the interval into the two
beside it, which get bounds of their own. An item is done when no interval can give a
document that ranks before the last of its ``k`` best. These carry over from shard to
shard of a task; the best of all tasks are merged in two steps. All items of a block are
searched side by side, one interval of each in turn.

Queries are handled in blocks of about ``QUERY_BYTES`` of terms, which with their weights is what
the tasks and the driver get of them; an item is never divided. Each block reads the index once for counts
and once for the search.

Null texts have no terms. A document without terms counts for nothing. Rows with equal ids
are documents of their own; those without an id rank behind others of the same score. Rows of
the query table with equal ids (also absent ones) are one item with the terms of all.
Empty tables, and items whose terms no document holds, give no rows. A long text is read in
pieces and never cut off. Other columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from platewise.llm.common import arrow_schema, importable, new_folder, slices, staged, table
from platewise.llm.words import ALNUM

SHARD_BYTES = 8 << 20
#: A text is read in pieces of so many bytes.
PIECE_BYTES = 4 << 20
QUERY_BYTES = 1 << 20
K = 50
#: Parts into which the best of the tasks of an item are merged first.
MERGE_PARTS = 64

#: ``ids`` and ``lengths`` are 64-bit integers, ``has_id`` bytes. Term ``t`` is ``terms`` from
#: ``term_ends[t - 1]`` to ``term_ends[t]`` and has the postings from ``ends[t - 1]`` to ``ends[t]``,
#: given as places among the documents and frequencies in integers as wide as need be.
INDEX = (
    "n_docs long, n_terms long, ids binary, has_id binary, lengths binary, terms binary,"
    " term_ends binary, ends binary, places binary, frequencies binary"
)


def build_index(docs: DataFrame, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """The index of all documents (doc_id, text) as a written table, one row per shard."""
    schema = T.StructType.fromDDL(INDEX)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    run = partial(_shards, shard_bytes=shard_bytes, schema=arrow_schema(schema))
    return staged(importable(rows).mapInArrow(run, schema), "lexical-index")


def _shards(
    batches: Iterator[pa.RecordBatch], shard_bytes: int, schema: pa.Schema
) -> Iterator[pa.RecordBatch]:
    held, ids, size = [], [], 0
    for batch, texts in slices(batches, "text"):
        for terms, counts in _counted(texts):
            held.append((terms, counts + np.array([[0], [len(ids)], [0]])))
        ids.extend(batch.column("doc_id").to_pylist())
        size += sum(map(len, texts))
        if size >= shard_bytes:
            yield _shard(held, ids, schema)
            held, ids, size = [], [], 0
    if ids:
        yield _shard(held, ids, schema)


def _counted(texts: list[bytes]) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """Distinct terms and (term, text, frequency) of texts, or of pieces of a long one."""
    small = [t if len(t) <= PIECE_BYTES else b"" for t in texts]
    yield _count(small, np.arange(len(texts)))
    for i, t in enumerate(texts):
        begin = 0
        while len(t) > PIECE_BYTES and begin < len(t):
            end = min(begin + PIECE_BYTES, len(t))
            while end < len(t) and ALNUM[t[end]] != 32:
                end += 1
            yield _count([t[begin:end]], np.array([i]))
            begin = end


def _count(texts: list[bytes], numbers: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    raw = np.frombuffer(b" ".join(texts).translate(ALNUM) + b" ", np.uint8)
    inside = raw != 32
    edges = np.flatnonzero(np.diff(inside, prepend=False))
    starts, ends = edges[::2], edges[1::2]
    offsets = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int32)
    buffers = [None, pa.py_buffer(offsets), pa.py_buffer(raw[inside])]
    words = pa.Array.from_buffers(pa.binary(), len(starts), buffers).dictionary_encode()
    sizes = np.array([len(t) + 1 for t in texts], np.int64)
    text = np.searchsorted(np.cumsum(sizes), starts, side="right")
    key = words.indices.to_numpy().astype(np.int64) * len(texts) + text
    key, n = np.unique(key, return_counts=True)
    return words.dictionary, np.stack([key // len(texts), numbers[key % len(texts)], n])


def _shard(held: list, ids: list, schema: pa.Schema) -> pa.RecordBatch:
    offsets = np.cumsum([0, *(len(terms) for terms, _ in held)])
    all_terms = pa.chunked_array([t for t, _ in held], pa.binary()).combine_chunks().dictionary_encode()
    number = all_terms.indices.to_numpy().astype(np.int64)
    counts = np.concatenate([c + np.array([[o], [0], [0]]) for (_, c), o in zip(held, offsets)], axis=1)
    term, doc, n = number[counts[0]], counts[1], counts[2]
    lengths = np.bincount(doc, weights=n, minlength=len(ids)).astype(np.int64)
    # Documents with terms, in the order in which equal scores rank.
    has_id = np.array([i is not None for i in ids])
    plain = np.array([0 if i is None else i for i in ids], np.int64)
    order = np.lexsort([plain, ~has_id])
    order = order[lengths[order] > 0]
    place = np.full(len(ids), -1, np.int64)
    place[order] = np.arange(len(order))
    # Pieces of one text may hold a term each.
    key, group = np.unique(term * max(1, len(order)) + place[doc], return_inverse=True)
    total = np.bincount(group, weights=n, minlength=len(key)).astype(np.int64)
    terms = all_terms.dictionary
    ends = np.searchsorted(key, (np.arange(len(terms)) + 1) * max(1, len(order)))
    joined = b"".join(terms.to_pylist())
    term_ends = np.cumsum(pa.compute.binary_length(terms).to_numpy())
    values = [
        len(order), int(lengths.sum()), plain[order].tobytes(), has_id[order].astype(np.uint8).tobytes(),
        lengths[order].tobytes(), joined, _narrow(term_ends), _narrow(ends),
        _narrow(key % max(1, len(order))), _narrow(total),
    ]
    return pa.RecordBatch.from_arrays(
        [pa.array([v], f.type) for v, f in zip(values, schema, strict=True)], schema=schema
    )


def _narrow(values: np.ndarray) -> bytes:
    """Integers in the fewest bytes that hold them all, after a byte that tells how many."""
    kind = np.min_scalar_type(int(values.max()) if len(values) else 0)
    return bytes([kind.itemsize]) + values.astype(kind).tobytes()


def _wide(blob: bytes) -> np.ndarray:
    return np.frombuffer(blob, f"<u{blob[0]}", offset=1).astype(np.int64)


def _terms(blob: bytes, ends: np.ndarray) -> pa.Array:
    offsets = np.concatenate([[0], ends]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(blob)])


def query_terms(queries: DataFrame) -> DataFrame:
    """(item_id, term) once each; only A-Z are put in lower case."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    low = F.translate(F.col("text"), upper, lower)
    words = F.regexp_extract_all(low, F.lit(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), F.lit(0))
    return queries.select("item_id", F.explode(words).alias("term")).distinct()


@dataclass
class Block:
    """Items of one block of queries."""

    items: list  #: their ids
    terms: pa.Array
    of_item: list[np.ndarray]  #: numbers of the terms of each item, ascending
    weights: np.ndarray | None = None


def search(index: DataFrame, queries: DataFrame, k: int = K, query_bytes: int = QUERY_BYTES) -> DataFrame:
    """item_id, rank, doc_id, score: the ``k`` best documents of each item."""
    asked = staged(query_terms(queries), "lexical-queries")
    size = F.sum(F.octet_length("term") + 8).alias("size")
    # One row each about the whole index and the whole query table.
    about = index.agg(F.sum("n_docs").alias("docs"), F.sum("n_terms").alias("terms")).first()
    total = asked.agg(size).first()["size"] or 0
    n_blocks = -(-total // query_bytes)
    spark = index.sparkSession
    id_type = asked.schema["item_id"].dataType
    schema = T.StructType([T.StructField("item_id", id_type)]).add("doc_id", "long").add("score", "long")
    folder = new_folder(spark, "lexical-found")
    spark.createDataFrame([], schema).write.parquet(folder)
    for number in range(n_blocks):
        of_block = F.pmod(F.xxhash64("item_id"), F.lit(n_blocks)) == number
        block = _block(asked.filter(of_block))
        if block.items and about["docs"]:
            block.weights = _weights(index, block.terms, about["docs"])
            shared = spark.sparkContext.broadcast(block)
            run = partial(
                _search, block=shared, k=k, docs=about["docs"], length=about["terms"],
                schema=arrow_schema(schema),
            )
            importable(index).mapInArrow(run, schema).write.mode("append").parquet(folder)
    found = spark.read.schema(schema).parquet(folder)
    return _best(found, k)


def _block(asked: DataFrame) -> Block:
    rows = asked.orderBy("item_id", "term").toArrow()
    terms = rows["term"].cast(pa.binary()).combine_chunks().dictionary_encode()
    number = terms.indices.to_numpy()
    ids = rows["item_id"].to_pylist()
    edges = [i for i in range(len(ids) + 1) if i in (0, len(ids)) or ids[i] != ids[i - 1]]
    parts = [slice(a, b) for a, b in zip(edges, edges[1:]) if a < b]
    return Block([ids[p.start] for p in parts], terms.dictionary, [np.sort(number[p]) for p in parts])


def _weights(index: DataFrame, terms: pa.Array, docs: int) -> np.ndarray:
    """The weight of each term of a block; counts are summed up before they are shuffled
    and are as many as the terms of the block."""
    schema = T.StructType.fromDDL("term long, n long")
    asked = index.sparkSession.sparkContext.broadcast(terms)
    count = partial(_holding, terms=asked, schema=arrow_schema(schema))
    counts = importable(index.select("terms", "term_ends", "ends")).mapInArrow(count, schema)
    held = np.zeros(len(terms), np.int64)
    for term, n in counts.groupBy("term").agg(F.sum("n")).collect():
        held[term] = n
    return np.floor(1000 * np.log((2 * docs + 2) / (2 * held + 1))).astype(np.int64)


def _holding(batches: Iterator[pa.RecordBatch], terms, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(len(terms.value), np.int64)
    for batch in batches:
        for row in batch.to_pylist():
            found, begins, ends = _asked(row, terms.value)
            counts[found] += ends - begins
    some = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(counts[some])], schema=schema)


def _asked(row: dict, terms: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers of the terms asked for that a shard holds, in ascending order, and the range
    of the postings of each."""
    own = _terms(row["terms"], _wide(row["term_ends"]))
    number = pa.compute.index_in(own, value_set=terms).fill_null(-1).to_numpy()
    at = np.flatnonzero(number >= 0)
    at = at[np.argsort(number[at])]
    ends = np.concatenate([[0], _wide(row["ends"])])
    return number[at], ends[at], ends[at + 1]


def impacts(weight: np.ndarray, tf: np.ndarray, n: np.ndarray, docs: int, length: int) -> np.ndarray:
    """What a term of this weight adds to the score of a document of ``n`` terms that holds
    it ``tf`` times, among ``docs`` documents of ``length`` terms in all."""
    m = 50 + (50 * n * docs) // length
    return weight * ((1_000_000_000 * tf) // (1000 * tf + 20 * m))


class Postings:
    """Posting lists of one shard, one after another, with their range-maximum table."""

    def __init__(self, row: dict, block: Block, docs: int, length: int) -> None:
        self.ids = np.frombuffer(row["ids"], np.int64)
        self.has_id = np.frombuffer(row["has_id"], np.uint8)
        lengths = np.frombuffer(row["lengths"], np.int64)
        self.terms, begins, ends = _asked(row, block.terms)
        n = ends - begins
        self.ends = np.cumsum(n)
        self.begins = self.ends - n
        at = np.repeat(begins - self.begins, n) + np.arange(int(n.sum()))
        self.docs = _wide(row["places"])[at]
        tf = _wide(row["frequencies"])[at]
        term = np.repeat(np.arange(len(n)), n)
        weight = block.weights[self.terms][term]
        self.impact = impacts(weight, tf, lengths[self.docs], docs, length)
        self.width = len(self.ids) + 1
        self.key = term * self.width + self.docs
        # level[j][i]: where the greatest impact of the 2**j postings from i on is.
        self.level = [np.arange(len(self.impact), dtype=np.int32)]
        size = 1
        while 2 * size <= (int(n.max()) if len(n) else 0):
            last = self.level[-1]
            a, b = last[:-size], last[size:]
            self.level.append(np.where(self.impact[a] >= self.impact[b], a, b))
            size *= 2

    def greatest(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Where the greatest impact of each range is; ranges are not empty and within a list."""
        j = np.frexp((end - begin).astype(np.float64))[1] - 1
        out = np.empty(len(begin), np.int64)
        for level in np.unique(j):
            some = j == level
            a = self.level[level][begin[some]]
            b = self.level[level][end[some] - (1 << int(level))]
            out[some] = np.where(self.impact[a] >= self.impact[b], a, b)
        return out


class Best:
    """The ``k`` best documents of an item so far: (score, minus the order of the id)."""

    def __init__(self, k: int) -> None:
        self.k, self.heap = k, []

    def least(self) -> int:
        """A document of a lower score does not get in."""
        return self.heap[0][0] if len(self.heap) == self.k else 1

    def offer(self, score: int, doc: int | None) -> None:
        entry = (score, -(1 << 63) if doc is None else -doc, doc)
        if len(self.heap) < self.k:
            heapq.heappush(self.heap, entry)
        elif entry[:2] > self.heap[0][:2]:
            heapq.heapreplace(self.heap, entry)


def search_shard(lists: Postings, of_item: list[np.ndarray], best: list[Best]) -> None:
    """Offers to each item the documents of a shard that may be among its best."""
    least = [b.least() for b in best]
    queues: list[list] = [[] for _ in best]
    ticket = 0

    def put(items: list[int], own: np.ndarray, begin: np.ndarray, end: np.ndarray, sizes: np.ndarray) -> None:
        """Bounds intervals, each of ``sizes`` ranges of posting lists, and queues those that
        may hold a document that counts."""
        nonlocal ticket
        first = np.cumsum(sizes) - sizes
        top = lists.greatest(begin, end)
        worth = lists.impact[top]
        bounds = np.add.reduceat(worth, first).tolist()
        greatest = np.flatnonzero(worth == np.repeat(np.maximum.reduceat(worth, first), sizes))
        splits = lists.docs[top[greatest[np.searchsorted(greatest, first)]]].tolist()
        for item, bound, split, f, n in zip(items, bounds, splits, first.tolist(), sizes.tolist(), strict=True):
            if bound >= least[item]:
                part = slice(f, f + n)
                heapq.heappush(queues[item], (-bound, ticket, own[part], begin[part], end[part], split))
                ticket += 1

    owns = [np.flatnonzero(np.isin(lists.terms, terms, assume_unique=True)) for terms in of_item]
    items = [i for i, own in enumerate(owns) if len(own)]
    if not items:
        return
    own = np.concatenate([owns[i] for i in items])
    put(items, own, lists.begins[own], lists.ends[own], np.array([len(owns[i]) for i in items]))
    while True:
        # One interval of each item: score the document that splits it.
        items, taken = [], []
        for item, queue in enumerate(queues):
            if queue and -queue[0][0] >= least[item]:
                items.append(item)
                taken.append(heapq.heappop(queue))
        if not items:
            return
        sizes = np.array([len(t[2]) for t in taken])
        first = np.cumsum(sizes) - sizes
        own, begin, end = (np.concatenate([t[i] for t in taken]) for i in (2, 3, 4))
        docs = np.array([t[5] for t in taken])
        split = np.repeat(docs, sizes)
        at = np.searchsorted(lists.key, own * lists.width + split)
        holds = at < end
        holds[holds] = lists.docs[at[holds]] == split[holds]
        gained = np.zeros(len(at), np.int64)
        gained[holds] = lists.impact[at[holds]]
        scores = np.add.reduceat(gained, first).tolist()
        named = zip(items, scores, lists.ids[docs].tolist(), lists.has_id[docs].tolist(), strict=True)
        for item, score, doc, has_id in named:
            if score >= least[item]:
                best[item].offer(score, doc if has_id else None)
                least[item] = best[item].least()
        # What is left of the split document, and what is right of it.
        group = np.repeat(np.arange(len(items)), sizes)
        both = [np.concatenate(x) for x in ((group, group + len(items)), (own, own), (begin, at + holds), (at, end))]
        some = both[2] < both[3]
        group, own, begin, end = (x[some] for x in both)
        sizes = np.bincount(group, minlength=2 * len(items))
        if len(own):
            put([i for i, n in zip(items + items, sizes.tolist(), strict=True) if n], own, begin, end, sizes[sizes > 0])


def _search(
    batches: Iterator[pa.RecordBatch], block, k: int, docs: int, length: int, schema: pa.Schema
) -> Iterator[pa.RecordBatch]:
    asked = block.value
    best = [Best(k) for _ in asked.items]
    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1).to_pylist()[0]
            search_shard(Postings(row, asked, docs, length), asked.of_item, best)
    rows = [(item, doc, score) for item, b in zip(asked.items, best, strict=True) for score, _, doc in b.heap]
    if rows:
        columns = zip(*rows, strict=True)
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema
        )


def _best(found: DataFrame, k: int) -> DataFrame:
    """The ``k`` best of each item: first within parts of its rows, then of what is left."""
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    part = F.pmod(F.xxhash64("doc_id", "score"), F.lit(MERGE_PARTS))
    by_part = Window.partitionBy("item_id", "part").orderBy(*order)
    some = found.withColumn("part", part).withColumn("n", F.row_number().over(by_part)).filter(F.col("n") <= k)
    by_item = Window.partitionBy("item_id").orderBy(*order)
    return (
        some.withColumn("rank", F.row_number().over(by_item))
        .filter(F.col("rank") <= k)
        .select("item_id", "rank", "doc_id", "score")
    )


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = build_index(table(spark, sf_dir, "documents"))
    return search(index, table(spark, sf_dir, "benchmark"))

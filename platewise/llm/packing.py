"""Documents packed into sequences of at most ``capacity`` tokens.

Shortest-pack-first over the histogram of lengths. A document of more than ``capacity``
tokens is cut into full pieces and a rest. The number of pieces of each length is known
from counts, and packs are planned from those counts alone: lengths are placed from the
longest to the shortest, each into the shortest packs that have room, and packs that are
filled alike are kept as one pattern with a count. The plan then lists, for each length,
which ranks go to which pattern, and every piece finds its sequence by its rank among
the pieces of its length.

Null texts count as empty: such a document has the end id alone. Rows with equal ids are
separate documents. Tables without rows give no sequence.
"""

from __future__ import annotations

import heapq
import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from platewise.llm import tokens
from platewise.llm.common import arrow_schema, importable, replaced, slices, staged, with_columns

CAPACITY = 2048
#: What a piece carries of its ids.
KEPT = {"ids": "array<int>", "ids_crc32": "long"}


@dataclass
class Run:
    """Ranks from ``rank`` on, ``count`` of them, of one length: one in each of the
    sequences from ``sequence`` on, at ``offset``."""

    length: int
    rank: int
    count: int
    sequence: int
    offset: int


def plan_packs(histogram: dict[int, int], capacity: int = CAPACITY) -> list[Run]:
    """Where the pieces of each length go, as runs of equal placement.

    Sequences that are filled alike are numbered in a row: a group (first sequence,
    count) of packs with the same fill. Placing a length splits at most one group, and
    the work depends on the number of lengths and groups, not on that of pieces.
    """
    runs: list[Run] = []
    groups: dict[int, list[tuple[int, int]]] = defaultdict(list)  # fill: [(first, count)]
    fills: list[int] = []  # heap of the fills that have groups
    sequences = 0

    def put(fill: int, first: int, count: int) -> None:
        if count and fill < capacity:
            if not groups[fill]:
                heapq.heappush(fills, fill)
            groups[fill].append((first, count))

    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            while fills and not groups[fills[0]]:
                heapq.heappop(fills)
            if fills and fills[0] + length <= capacity:
                fill = fills[0]
                first, count = groups[fill].pop()
                used = min(count, left)
                put(fill, first + used, count - used)
                runs.append(Run(length, rank, used, first, fill))
                put(fill + length, first, used)
                rank, left = rank + used, left - used
                continue
            # No pack has room: each new one is filled before the next is opened.
            each = min(capacity // length, left)
            opened = left // each
            for k in range(each):
                runs.append(Run(length, rank, opened, sequences, k * length))
                rank += opened
            put(each * length, sequences, opened)
            sequences += opened
            left -= opened * each
    return runs


PIECES = "doc_id long, start long, length int, doc_tokens long, part int, local_rank long"


def pieces_of(
    docs: DataFrame,
    capacity: int = CAPACITY,
    tokenizer: str | None = None,
    end_id: int = 1,
    keep: str = "ids",
) -> DataFrame:
    """Pieces with their ``ids``, or with the unsigned crc32 of the ids (``keep`` is
    ``"ids_crc32"``). ``local_rank`` counts pieces of equal length in a task.

    The rows are staged before anything is counted, so ranks never change."""
    schema = T.StructType.fromDDL(f"{PIECES}, {keep} {KEPT[keep]}")
    cut = partial(
        _cut,
        path=tokenizer or tokens.default_path(),
        end_id=end_id,
        capacity=capacity,
        schema=arrow_schema(schema),
    )
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return staged(importable(texts).mapInArrow(cut, schema), "pieces")


def _cut(
    batches: Iterator[pa.RecordBatch], path: str, end_id: int, capacity: int, schema: pa.Schema
) -> Iterator[pa.RecordBatch]:
    encoder = tokens.encoder(path)
    part, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
    end = np.array([end_id], np.uint32).tobytes()
    for batch, texts in slices(batches, "text", tokens.BLOCK_BYTES):
        ids = [x + end for x in encoder.encode(texts)]
        n = np.array([len(x) // 4 for x in ids], np.int64)
        pieces = -(-n // capacity)
        row = np.repeat(np.arange(len(n)), pieces)
        start = (np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * capacity
        length = np.minimum(n[row] - start, capacity)
        order = np.argsort(length, kind="stable")
        ordered = length[order]
        within = np.arange(len(order)) - np.searchsorted(ordered, ordered)
        rank = np.empty(len(order), np.int64)
        rank[order] = seen[ordered] + within
        seen += np.bincount(length, minlength=capacity + 1)
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id").take(pa.array(row)),
                pa.array(start),
                pa.array(length.astype(np.int32)),
                pa.array(n[row]),
                pa.array(np.full(len(row), part, np.int32)),
                pa.array(rank),
                _kept(b"".join(ids), length, schema.field(-1)),
            ],
            schema=schema,
        )


def _kept(ids: bytes, length: np.ndarray, field: pa.Field) -> pa.Array:
    """Lists of ids, or their checksums, of pieces that lie one after another."""
    offsets = np.concatenate([[0], np.cumsum(length)])
    if field.name == "ids":
        values = pa.array(np.frombuffer(ids, np.int32))
        return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), values).cast(field.type)
    view, at = memoryview(ids), (offsets * 4).tolist()
    return pa.array([zlib.crc32(view[a:b]) for a, b in zip(at, at[1:], strict=False)], field.type)


def place(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to pieces (part, length, local_rank, ...).

    Counts per task and length are summed up along the tasks, so that a rank among all
    pieces of a length needs no sort of them. The plan comes from one count per length:
    at most ``capacity`` rows reach the driver, whatever the corpus, and it goes back as
    a few runs per length.
    """
    counts = pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n"))
    before = (
        Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = counts.select(
        "part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ranks_before")
    )
    totals = counts.groupBy("length").agg(F.sum("n").alias("n")).collect()
    runs = plan_packs({r["length"]: r["n"] for r in totals}, capacity)
    plan = _Plan.of(runs)
    schema = with_columns(
        pieces.drop("part", "local_rank"), ("sequence_id", "long"), ("offset", "int")
    )
    ranked = (
        pieces.join(offsets, ["part", "length"])
        .withColumn("local_rank", F.col("local_rank") + F.col("ranks_before"))
        .drop("ranks_before", "part")
    )
    assign = partial(_assign, plan=plan, schema=arrow_schema(schema))
    return importable(ranked).mapInArrow(assign, schema)


@dataclass
class _Plan:
    """Runs in arrays, ordered by length and rank."""

    key: np.ndarray  #: length * 2**40 + rank
    rank: np.ndarray
    sequence: np.ndarray
    offset: np.ndarray

    @classmethod
    def of(cls, runs: list[Run]) -> _Plan:
        rows = sorted((r.length, r.rank, r.sequence, r.offset) for r in runs)
        a = np.array(rows, np.int64).reshape(-1, 4)
        return cls((a[:, 0] << 40) + a[:, 1], a[:, 1], a[:, 2], a[:, 3])


def _assign(
    batches: Iterator[pa.RecordBatch], plan: _Plan, schema: pa.Schema
) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        length = batch.column("length").to_numpy().astype(np.int64)
        rank = batch.column("local_rank").to_numpy()
        at = np.searchsorted(plan.key, (length << 40) + rank, side="right") - 1
        yield replaced(
            batch,
            schema,
            sequence_id=plan.sequence[at] + rank - plan.rank[at],
            offset=plan.offset[at].astype(np.int32),
        )


def pack_documents(
    docs: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None, end_id: int = 1
) -> DataFrame:
    """One row per piece: doc_id, start, length, doc_tokens, ids, sequence_id, offset."""
    return place(pieces_of(docs, capacity, tokenizer, end_id), capacity)


def sequences(packed: DataFrame, capacity: int = CAPACITY, pad_id: int = 1) -> DataFrame:
    """Whole sequences: sequence_id, length, ids padded to ``capacity``, and the pieces.

    A sequence has at most ``capacity`` pieces, so its list is bounded.
    """
    parts = F.sort_array(F.collect_list(F.struct("offset", "doc_id", "start", "length", "ids")))
    rows = packed.groupBy("sequence_id").agg(
        F.sum("length").cast("int").alias("length"), parts.alias("parts")
    )
    ids = F.flatten(F.col("parts.ids"))
    padding = F.array_repeat(F.lit(pad_id), F.lit(capacity) - F.col("length"))
    return rows.select(
        "sequence_id",
        "length",
        F.concat(ids, padding).alias("ids"),
        F.transform("parts", lambda p: p.dropFields("ids")).alias("pieces"),
    )


def packed_digests(docs: DataFrame) -> DataFrame:
    """The packed pieces with a checksum of their ids in place of the ids."""
    return place(pieces_of(docs, keep="ids_crc32"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packed_digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return packed.withColumns({c: F.col(c).cast("long") for c in ("length", "offset")})

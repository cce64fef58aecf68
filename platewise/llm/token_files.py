"""Token ids of a corpus as sorted Parquet files with list columns.

File format, version 1. A folder holds ``tokens`` and ``manifest``, both Parquet.

* ``tokens``: one row per document, in ascending order of its id within a file and from
  file to file: the document's other columns, ``n_tokens``, ``start_in_shard`` (ids of
  the documents before it in the same file) and the list column ``tokens``. Integers are
  written with delta encoding, or with dictionaries; row groups and pages are small and
  each page has its bounds in the page index, so that a reader who wants few documents,
  or only the columns about them, reads little else.
* ``manifest``: one row per file (shard): its number, documents, ids, first and last
  document id, and ``start``, the ids of all shards before.

Every id has its place in one long stream of ids: ``start`` of its shard, plus
``start_in_shard``, plus its place in the list.

Null texts count as empty, so such a document has the end id alone. Documents without an
id come first; rows with equal ids are ordered by text and stay separate rows. An empty
table gives a folder with an empty manifest. Columns of the input called like one of
the columns above are left out.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from platewise.llm import tokens
from platewise.llm.common import (
    arrow_schema,
    importable,
    new_folder,
    replaced,
    shuffle_partitions,
    slices,
    with_columns,
)

ROW_GROUP_BYTES = 8 << 20
PAGE_BYTES = 64 << 10
PAGE_ROWS = 2000

MANIFEST = "shard int, n_docs long, n_tokens long, first_id long, last_id long, start long"


def write_tokens(
    docs: DataFrame,
    path: str,
    tokenizer: str | None = None,
    end_id: int = 0,
    encoding: str = "delta",
    row_group_bytes: int = ROW_GROUP_BYTES,
    page_bytes: int = PAGE_BYTES,
    page_rows: int = PAGE_ROWS,
) -> None:
    """Encodes ``text`` of every document and writes the folder ``path``.

    Texts are dealt into ranges of ``doc_id`` and sorted before they are encoded: the
    sampling that finds the ranges then reads plain columns, and each task encodes and
    numbers one range in order. The number of shards is that of the shuffle partitions.
    """
    if encoding not in ("delta", "dictionary"):
        raise ValueError("encoding is 'delta' or 'dictionary'")
    spark = docs.sparkSession
    ordered = docs.repartitionByRange(shuffle_partitions(docs), "doc_id").sortWithinPartitions(
        "doc_id", "text"
    )
    schema = with_columns(
        docs.drop("text"),
        ("shard", "int"),
        ("n_tokens", "long"),
        ("start_in_shard", "long"),
        ("tokens", "array<int>"),
    )
    encode = partial(
        _encode, path=tokenizer or tokens.default_path(), end_id=end_id, schema=arrow_schema(schema)
    )
    (
        importable(ordered)
        .mapInArrow(encode, schema)
        .write.option("parquet.writer.version", "PARQUET_2_0")
        .option("parquet.enable.dictionary", str(encoding == "dictionary").lower())
        .option("parquet.block.size", row_group_bytes)
        .option("parquet.page.size", page_bytes)
        .option("parquet.page.row.count.limit", page_rows)
        .parquet(f"{path}/tokens")
    )
    written = spark.read.schema(schema).parquet(f"{path}/tokens")
    shards = written.groupBy("shard").agg(
        F.count(F.lit(1)).alias("n_docs"),
        F.sum("n_tokens").alias("n_tokens"),
        F.min("doc_id").cast("long").alias("first_id"),
        F.max("doc_id").cast("long").alias("last_id"),
    )
    # One row per file: a window over all of them is small.
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    (
        shards.withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))
        .select("shard", "n_docs", "n_tokens", "first_id", "last_id", "start")
        .write.parquet(f"{path}/manifest")
    )


def _encode(
    batches: Iterator[pa.RecordBatch], path: str, end_id: int, schema: pa.Schema
) -> Iterator[pa.RecordBatch]:
    encoder = tokens.encoder(path)
    shard, start = TaskContext.get().partitionId(), 0
    for batch, texts in slices(batches, "text", tokens.BLOCK_BYTES):
        ids = encoder.encode(texts)
        n = np.array([len(x) // 4 + 1 for x in ids], np.int64)
        ends = np.cumsum(n)
        end = np.array([end_id], np.uint32).tobytes()
        values = np.frombuffer(end.join([*ids, b""]), np.int32)
        offsets = np.concatenate([[0], ends]).astype(np.int32)
        yield replaced(
            batch,
            schema,
            shard=np.full(len(n), shard, np.int32),
            n_tokens=n,
            start_in_shard=start + ends - n,
            tokens=pa.ListArray.from_arrays(pa.array(offsets), pa.array(values)).cast(
                schema.field("tokens").type
            ),
        )
        start += int(ends[-1])


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """The documents of a folder with ``start``, their place in the stream of all ids.

    Column selection and filters on ``doc_id`` reach the scan. The manifest has one row
    per file and is joined as it is; Spark broadcasts it only if it is small.
    """
    starts = spark.read.schema(MANIFEST).parquet(f"{path}/manifest").select("shard", "start")
    return (
        spark.read.parquet(f"{path}/tokens")
        .join(starts, "shard")
        .withColumn("start", F.col("start") + F.col("start_in_shard"))
    )


def read_span(spark: SparkSession, path: str, begin: int, end: int) -> DataFrame:
    """Ids at the places ``begin`` to ``end`` (without ``end``) of the stream, as rows
    (doc_id, start, tokens) cut to that span. Only shards that overlap it are read."""
    manifest = spark.read.schema(MANIFEST).parquet(f"{path}/manifest")
    near = manifest.filter((F.col("start") < end) & (F.col("start") + F.col("n_tokens") > begin))
    docs = spark.read.parquet(f"{path}/tokens").join(near.select("shard", "start"), "shard")
    place = F.col("start") + F.col("start_in_shard")
    cut = F.greatest(F.lit(begin) - place, F.lit(0))
    kept = F.least(F.lit(end) - place, F.col("n_tokens")) - cut
    return (
        docs.filter((place < end) & (place + F.col("n_tokens") > begin))
        .withColumn("tokens", F.slice("tokens", (cut + 1).cast("int"), kept.cast("int")))
        .select("doc_id", (place + cut).alias("start"), "tokens")
    )


def with_crc32(df: DataFrame, column: str, name: str) -> DataFrame:
    """Adds the unsigned crc32 of a list of ids as little-endian 32-bit integers in
    place of the list."""
    schema = with_columns(df.drop(column), (name, "long"))
    digest = partial(_crc32, column=column, name=name, schema=arrow_schema(schema))
    return importable(df).mapInArrow(digest, schema)


def _crc32(
    batches: Iterator[pa.RecordBatch], column: str, name: str, schema: pa.Schema
) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column(column)
        values = lists.values.to_numpy().astype("<u4").tobytes()
        at = (lists.offsets.to_numpy().astype(np.int64) * 4).tolist()
        view = memoryview(values)
        sums = [zlib.crc32(view[a:b]) for a, b in zip(at, at[1:], strict=False)]
        yield replaced(batch, schema, **{name: pa.array(sums, pa.int64())})


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes all documents in the file format and gives what the files hold."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(
        F.col("doc_id").cast(T.LongType()).alias("doc_id"), "text"
    )
    path = new_folder(spark, "token-files")
    write_tokens(docs, path)
    back = read_tokens(spark, path).select("doc_id", "start", "n_tokens", "tokens")
    return with_crc32(back, "tokens", "ids_crc32")

"""Near-duplicates by SimHash fingerprints and meet-in-the-middle ball hashing.

A fingerprint has 64 bits; two documents are linked if theirs differ in at most
``max_bits`` bits, which must be even. Every distinct fingerprint emits all variants
within half that distance. Two fingerprints are linked exactly if some variant is
emitted by both, and all that emit one variant are linked with each other, as each is
within half the distance of it. So the fingerprints of a variant are not paired with
each other but with the one of the smallest document id among them; these links are
verified bit by bit, and have the same components as all links.

Null and empty texts have fingerprint zero and are linked like any other. A row without
an id has a fingerprint but no component, and links nothing. Rows with equal ids are one
node of the graph. Columns ``fingerprint`` and ``component_id`` of the input are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from platewise.functions.skew import join_side
from platewise.llm.common import (
    arrow_schema,
    checkpointed,
    fresh_name,
    importable,
    replaced,
    shuffle_partitions,
    slices,
    staged,
    with_columns,
)
from platewise.llm.components import smallest_reachable
from platewise.llm.words import Words

SHINGLE_WORDS = 3
MAX_BITS = 2
SEED = 42


def fingerprints(docs: DataFrame, shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed 64-bit integer."""
    schema = T.StructType.fromDDL("doc_id long, fp long")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    run = partial(_fingerprint_batches, k=shingle_words, schema=arrow_schema(schema))
    return importable(rows).mapInArrow(run, schema)


def _fingerprint_batches(
    batches: Iterator[pa.RecordBatch], k: int, schema: pa.Schema
) -> Iterator[pa.RecordBatch]:
    for batch, texts in slices(batches, "text"):
        fps = simhashes(texts, k).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fps)], schema=schema)


def simhashes(texts: list[bytes], k: int = SHINGLE_WORDS) -> np.ndarray:
    """Fingerprints of UTF-8 texts: a bit is set if it is in over half of the hashes of
    all shingles of ``k`` words, repeats included."""
    words = Words.of([t.lower() for t in texts])  # of bytes: A-Z only
    counts = np.diff(words.first)
    shingles = np.where(counts >= k, counts - k + 1, np.minimum(counts, 1))
    last = shingles.cumsum()
    row = np.repeat(np.arange(len(texts)), shingles)
    begin = words.first[row] + np.arange(len(row)) - (last - shingles)[row]
    end = np.minimum(begin + k, words.first[row + 1]) - 1
    joined, digest = words.joined, xxhash.xxh64_intdigest
    spans = zip(words.starts[begin].tolist(), words.ends[end].tolist(), strict=True)
    hashes = np.array([digest(joined[a:b], SEED) for a, b in spans], np.uint64)
    out = np.zeros(len(texts), np.uint64)
    if len(hashes):
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        full = np.flatnonzero(shingles)
        ones = np.add.reduceat(bits, (last - shingles)[full], axis=0, dtype=np.int64)
        majority = 2 * ones > shingles[full][:, None]
        out[full] = np.packbits(majority, axis=1, bitorder="little").view(np.uint64)[:, 0]
    return out


def ball(radius: int) -> list[int]:
    """All signed 64-bit masks of at most ``radius`` bits."""
    masks = [sum(1 << b for b in bits) for n in range(radius + 1) for bits in combinations(range(64), n)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def fingerprint_links(nodes: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """Edges (a, b) between the ids of ``nodes`` (fp, rep), one row per fingerprint,
    with the same components as all pairs within ``max_bits``."""
    if max_bits < 0 or max_bits % 2:
        raise ValueError("max_bits must be even")
    masks = F.array(*[F.lit(m).cast("long") for m in ball(max_bits // 2)])
    # The nodes are few bytes in few partitions, and become many rows.
    spread = nodes.repartition(shuffle_partitions(nodes))
    variants = spread.select(
        "rep", "fp", F.explode(F.transform(masks, lambda m: F.col("fp").bitwiseXOR(m))).alias("variant")
    )
    centre = F.min(F.struct("rep", "fp")).over(Window.partitionBy("variant"))
    met = variants.withColumn("centre", centre).filter(F.col("rep") != F.col("centre.rep"))
    return (
        met.select("rep", "fp", "centre.*")
        .toDF("a", "fp_a", "b", "fp_b")
        .distinct()
        .filter(F.bit_count(F.col("fp_a").bitwiseXOR(F.col("fp_b"))) <= max_bits)
        .select("a", "b")
    )


def near_duplicates(
    docs: DataFrame, shingle_words: int = SHINGLE_WORDS, max_bits: int = MAX_BITS
) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id: the smallest id reachable."""
    fps = checkpointed(fingerprints(docs, shingle_words))
    nodes = checkpointed(
        fps.filter("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("rep"))
    )
    roots = smallest_reachable(fingerprint_links(nodes, max_bits))
    components = nodes.join(roots, nodes["rep"] == roots["node"], "left").select(
        "fp", F.coalesce("root", "rep").alias("component_id")
    )
    return fps.join(join_side(components), "fp", "left").select(
        "doc_id",
        F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
        F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"),
    )


def keep_first(docs: DataFrame, shingle_words: int = SHINGLE_WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """The document of the smallest id of each group of near-duplicates, with all its columns.

    A group is what links of fingerprints reach; an id links nothing. So rows of one id whose texts are
    no near-duplicates are different documents and stay, and of rows that are alike one
    stays. Rows without an id stay. Which row of a group stays is settled on narrow rows; texts are
    only shuffled by the number of their row, which has no hot values.
    """
    fp, row = fresh_name(docs, "__fp"), fresh_name(docs, "__row")
    schema = with_columns(docs, (fp, "long"))
    run = partial(_add_fingerprints, name=fp, k=shingle_words, schema=arrow_schema(schema))
    numbered = importable(docs).mapInArrow(run, schema).withColumn(row, F.monotonically_increasing_id())
    marked = staged(numbered, "simhash-documents")
    narrow = marked.filter("doc_id is not null").select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.xxhash64("text").alias("said"),
        F.col(fp).alias("fp"),
        F.col(row).alias("row"),
    )
    nodes = checkpointed(narrow.select("fp", F.col("fp").alias("rep")).distinct())
    roots = smallest_reachable(fingerprint_links(nodes, max_bits)).withColumnsRenamed({"node": "fp", "root": "group"})
    grouped = narrow.join(join_side(roots), "fp", "left").withColumn("group", F.coalesce("group", "fp"))
    first = grouped.groupBy("group").agg(F.min(F.struct("doc_id", "said", "fp", "row")).alias("first"))
    gone = grouped.join(join_side(first), "group").filter(F.col("row") != F.col("first.row"))
    losers = gone.select(F.col("row").alias(row))
    return marked.join(losers, row, "left_anti").select(*docs.columns)


def _add_fingerprints(
    batches: Iterator[pa.RecordBatch], name: str, k: int, schema: pa.Schema
) -> Iterator[pa.RecordBatch]:
    for batch, texts in slices(batches, "text"):
        yield replaced(batch, schema, **{name: simhashes(texts, k).view(np.int64)})


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))

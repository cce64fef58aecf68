"""From raw documents to packed training sequences, stage by stage.

Every stage takes all documents that its predecessor kept, and its decisions take effect:
toxic documents go, one document of each group of near-duplicates stays, repeated passages
and passages of the benchmark are cut out of the texts, and what is left is packed. All
stages but the last give the columns of ``documents``; ``n_chars`` follows the text.
Documents whose text becomes empty stay, as documents of no words.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from platewise.llm import decontamination, packing, simhash, substring_dedup, toxicity
from platewise.llm.common import staged, table


def _like(docs: DataFrame, changed: DataFrame) -> DataFrame:
    """The columns of ``docs`` with the changed texts and their lengths."""
    if "n_chars" in docs.columns:
        changed = changed.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return changed.select(*docs.columns)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents below the toxicity threshold of their language."""
    scored = toxicity.score_documents(docs, table(spark, sf_dir, "labels"))
    return scored.filter("score < threshold").select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each group of near-duplicates."""
    return simhash.keep_first(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that occur more than once."""
    return _like(docs, substring_dedup.remove_repeats(docs))


def cut_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of the benchmark."""
    benchmark = table(spark, sf_dir, "benchmark")
    return _like(docs, decontamination.find_leaks(docs, benchmark, cut=True))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents, each with its place in a sequence."""
    return packing.packed_digests(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("simhash near-dedup", drop_near_duplicates),
    ("substring dedup", cut_repeats),
    ("benchmark decontamination", cut_benchmark),
    ("packing", pack),
]

#: A trained network, reachability and tokenizers have no SQL form; the tests hold the
#: stages against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each reads what the one before wrote."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return docs

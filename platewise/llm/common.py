"""Tables, shared storage and Arrow batches for the operators of this subpackage."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

PACKAGE_ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; without that setting (tests, a local
    session) one below the warehouse, which all executors share as well."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    return (shared or spark.conf.get("spark.sql.warehouse.dir") + "/_shared").rstrip("/")


def new_folder(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


def staged(df: DataFrame, label: str) -> DataFrame:
    """The rows written as Parquet to the shared folder and read back.

    This cuts the lineage: later stages read files that outlive any executor.
    """
    path = new_folder(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def checkpointed(df: DataFrame) -> DataFrame:
    """``checkpoint()`` in the shared folder; Spark's cleaner may delete it after use."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def importable(df: DataFrame) -> DataFrame:
    """Lets Python workers import this package from where the driver has it.

    The task functions are pickled by reference, so a worker keeps its caches from
    task to task. Executors without that path need the package installed.
    """
    environment = df.sparkSession.sparkContext.environment
    paths = environment.get("PYTHONPATH", "").split(os.pathsep)
    if PACKAGE_ROOT not in paths:
        environment["PYTHONPATH"] = os.pathsep.join(p for p in [PACKAGE_ROOT, *paths] if p)
    return df


def with_columns(df: DataFrame, *added: tuple[str, str]) -> T.StructType:
    """Schema of ``df`` without the columns named in ``added``, and then those."""
    names = {name for name, _ in added}
    schema = T.StructType([f for f in df.schema.fields if f.name not in names])
    for name, kind in added:
        schema = schema.add(T.StructType.fromDDL(f"{name} {kind}").fields[0])
    return schema


def fresh_name(df: DataFrame, name: str) -> str:
    """``name`` with underscores until no column of ``df`` is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def shuffle_partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def ascii_crc32(doc_id: Column) -> Column:
    """crc32 of an id written as text, the rule that splits learning from held-out rows."""
    return F.crc32(doc_id.cast("string").cast("binary"))


def slices(
    batches: Iterator[pa.RecordBatch], column: str, most_bytes: int = 1 << 20
) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Batches cut so that each holds about ``most_bytes`` of text, or one row, with
    the texts as bytes (null as empty)."""
    for batch in batches:
        texts = batch.column(column).fill_null("")
        lengths = pa.compute.binary_length(texts).to_numpy()
        begin, held = 0, 0
        for i, n in enumerate(lengths):
            if i > begin and held + n > most_bytes:
                yield batch.slice(begin, i - begin), _bytes(texts.slice(begin, i - begin))
                begin, held = i, 0
            held += int(n)
        if begin < len(lengths):
            yield batch.slice(begin), _bytes(texts.slice(begin))
    pa.default_memory_pool().release_unused()


def _bytes(texts: pa.Array) -> list[bytes]:
    return texts.cast(pa.binary()).to_pylist()


def replaced(batch: pa.RecordBatch, schema: pa.Schema, **columns) -> pa.RecordBatch:
    """The batch with columns put in place or added, as ``schema`` orders them."""
    arrays = []
    for field in schema:
        if field.name in columns:
            value = columns[field.name]
            arrays.append(value if isinstance(value, pa.Array) else pa.array(value, field.type))
        else:
            arrays.append(batch.column(field.name).cast(field.type))
    return pa.RecordBatch.from_arrays(arrays, schema=schema)


def arrow_schema(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)

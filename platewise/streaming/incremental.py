"""Runs that are added as their files arrive.

A stream of files is read in batches. Of each batch only its own runs are decoded, flagged and
counted: a run is one file, so what concerns one run never changes again. What concerns all runs
is kept as partial states of each batch (numbers, means, sums of squared deviations, extremes)
that are merged when they are read, without looking at a well again.

Below the output folder every table has a folder per batch, which is written anew if a batch is
repeated after a failure, and ``committed/<batch>`` tells that a batch is complete. Readers
take the batches up to the last complete one. The stream's own checkpoint remembers the files
that were read; a file that changes later is not read again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from platewise.functions.text import is_positive, percent, result_is, round_even, strip
from platewise.operators import flags, runs, stats
from platewise.operators.wells import wells_from_sheet_rows
from platewise.schema import WELLS
from platewise.sources import workbooks
from platewise.sources.tables import table_exists, write_table

_FILES = "path string, modificationTime timestamp, length long, content binary"
_MEASURES = ("target_cq", "ic_cq")


class RunsSeenBefore(ValueError):
    """A batch has wells of a run that an earlier batch has brought."""


def partial_stats(wells: DataFrame) -> DataFrame:
    """Mergeable statistics per sample type (kind ``sample``) and per type of control."""
    kind = F.when(F.col("is_control"), "control").otherwise("sample")
    key = F.when(F.col("is_control"), strip(F.col("content"))).otherwise(F.col("sample_type"))
    hit = F.when(F.col("is_control"), result_is(F.col("result"), "valid ctrl")).otherwise(is_positive(F.col("result")))
    parts = []
    for m in _MEASURES:
        parts += [
            F.count(m).alias(f"n_{m}"),
            F.avg(m).alias(f"mean_{m}"),
            (F.var_pop(m) * F.count(m)).alias(f"m2_{m}"),
            F.min(m).alias(f"min_{m}"),
            F.max(m).alias(f"max_{m}"),
        ]
    return (
        wells.select(kind.alias("kind"), key.alias("key"), "well", hit.alias("hit"), *_MEASURES)
        .groupBy("kind", "key")
        .agg(F.count(F.lit(1)).alias("n_rows"), F.count("well").alias("n_wells"), stats.count_where(F.col("hit")).alias("n_hits"), *parts)
    )


def merge_stats(parts: DataFrame) -> DataFrame:
    """Partial statistics of any batches, merged to those of all their wells, again mergeable.

    Deviations are taken from the common mean, so nothing is lost to cancellation."""
    of_key = Window.partitionBy("kind", "key")
    merged, columns = parts, [F.sum(c).alias(c) for c in ("n_rows", "n_wells", "n_hits")]
    for m in _MEASURES:
        n, mean, all_mean = F.col(f"n_{m}"), F.col(f"mean_{m}"), F.col(f"all_{m}")
        merged = merged.withColumn(f"all_{m}", F.try_divide(F.sum(n * mean).over(of_key), F.sum(n).over(of_key)))
        columns += [
            F.sum(n).alias(f"n_{m}"),
            F.first(all_mean).alias(f"mean_{m}"),
            F.sum(F.col(f"m2_{m}") + n * (mean - all_mean) * (mean - all_mean)).alias(f"m2_{m}"),
            F.min(f"min_{m}").alias(f"min_{m}"),
            F.max(f"max_{m}").alias(f"max_{m}"),
        ]
    return merged.groupBy("kind", "key").agg(*columns)


def _mean(measure: str) -> Column:
    return round_even(F.col(f"mean_{measure}"), 3).alias(f"mean_{measure}")


def _sd(measure: str) -> Column:
    n = F.col(f"n_{measure}")
    return round_even(F.sqrt(F.when(n > 1, F.col(f"m2_{measure}") / (n - 1))), 3).alias(f"sd_{measure}")


def add_batch(wells: DataFrame, out: str, batch: int) -> None:
    """Adds the wells of new runs as a batch; repeating a batch replaces it.

    Raises ``RunsSeenBefore`` if an earlier batch has one of the runs.
    """
    spark = wells.sparkSession
    folder = _Batches(spark, out)
    write_table(wells.select(*WELLS.names), folder.path("wells", batch))
    own = spark.read.schema(WELLS).parquet(folder.path("wells", batch))
    ids = own.select("run_id").distinct()
    write_table(ids, folder.path("runs", batch))
    earlier = folder.read("runs", ids.schema, before=batch)
    again = earlier.join(spark.read.schema(ids.schema).parquet(folder.path("runs", batch)), "run_id", "left_semi")
    if (found := again.first()) is not None:
        raise RunsSeenBefore(f"run {found['run_id']} came in batch {found['batch']} already")
    means = own.filter("not is_control and target_cq is not null and run_id is not null and sample_type is not null")
    for name, table in {
        "flag_rows": flags.flag_rows(own),
        "run_comparison": runs.run_comparison_long(own),
        "run_means": means.groupBy("run_id", "sample_type").agg(F.avg("target_cq").alias("run_mean_cq")),
        "stats_parts": partial_stats(own),
    }.items():
        write_table(table, folder.path(name, batch))
    folder.commit(batch)


class _Batches:
    """The folders of an output folder."""

    def __init__(self, spark: SparkSession, out: str) -> None:
        self.spark, self.out = spark, out.rstrip("/")

    def path(self, name: str, batch: int) -> str:
        return f"{self.out}/{name}/batch={batch}"

    def commit(self, batch: int) -> None:
        hadoop = self.spark._jvm.org.apache.hadoop.fs
        path = hadoop.Path(f"{self.out}/committed/{batch}")
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).create(path, True).close()

    def last(self) -> int:
        """The last complete batch, -1 if there is none. Batches are complete in order."""
        if not table_exists(self.spark, f"{self.out}/committed"):
            return -1
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.out}/committed")
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return max((int(f.getPath().getName()) for f in fs.listStatus(path)), default=-1)

    def read(self, name: str, schema: T.StructType, before: int | None = None) -> DataFrame:
        """Rows of the complete batches (of those before one), with their batch."""
        end = self.last() + 1 if before is None else min(before, self.last() + 1)
        whole = T.StructType([*schema.fields, T.StructField("batch", T.LongType())])
        if end <= 0:
            return self.spark.createDataFrame([], whole)
        return self.spark.read.schema(whole).parquet(f"{self.out}/{name}").filter(F.col("batch") < end)


def _schema(spark: SparkSession, operator) -> T.StructType:
    return operator(spark.createDataFrame([], WELLS)).schema


def wells(spark: SparkSession, out: str) -> DataFrame:
    return _Batches(spark, out).read("wells", WELLS).drop("batch")


def flag_rows(spark: SparkSession, out: str) -> DataFrame:
    return _Batches(spark, out).read("flag_rows", _schema(spark, flags.flag_rows)).drop("batch")


def run_comparison(spark: SparkSession, out: str) -> DataFrame:
    return _Batches(spark, out).read("run_comparison", _schema(spark, runs.run_comparison_long)).drop("batch")


def interrun_cv(spark: SparkSession, out: str) -> DataFrame:
    """From the mean of each run and type, which the batches hold."""
    schema = T.StructType().add("run_id", "string").add("sample_type", "string").add("run_mean_cq", "double")
    return runs.cv_of_run_means(_Batches(spark, out).read("run_means", schema))


def merged(spark: SparkSession, out: str) -> DataFrame:
    return merge_stats(_Batches(spark, out).read("stats_parts", _schema(spark, partial_stats)))


def sample_type_stats(spark: SparkSession, out: str) -> DataFrame:
    """As ``stats.sample_type_stats`` of all wells so far."""
    of_samples = merged(spark, out).filter("kind = 'sample' and key is not null")
    extremes = [round_even(F.col(f"{e}_target_cq"), 3).alias(f"{e}_target_cq") for e in ("min", "max")]
    return of_samples.select(
        F.col("key").alias("sample_type"),
        "n_wells",
        F.col("n_hits").alias("n_positive"),
        (F.col("n_rows") - F.col("n_hits")).alias("n_negative"),
        "n_target_cq",
        _mean("target_cq"),
        _sd("target_cq"),
        *extremes,
        _mean("ic_cq"),
        _sd("ic_cq"),
        round_even(percent(F.col("n_hits"), F.col("n_wells")), 1).alias("positivity_rate_pct"),
    ).orderBy("sample_type")


def control_stats(spark: SparkSession, out: str) -> DataFrame:
    """As ``stats.control_stats`` of all wells so far."""
    return (
        merged(spark, out)
        .filter("kind = 'control'")
        .select(
            F.col("key").alias("ctrl_type"),
            F.col("n_wells").alias("n_controls"),
            F.col("n_hits").alias("n_valid"),
            _mean("target_cq"),
            _sd("target_cq"),
            _mean("ic_cq"),
            _sd("ic_cq"),
        )
        .orderBy("ctrl_type")
    )


def follow(
    spark: SparkSession, exports: str, out: str, max_files: int = 10_000, once: bool = True
) -> StreamingQuery:
    """Reads the exports below a folder as they come, ``max_files`` in a batch; ``once`` ends when
    all that are there have been read. Unfit files are listed in ``issues``."""
    root = workbooks.qualified(spark, exports)
    folder = _Batches(spark, out)
    files = (
        spark.readStream.format("binaryFile")
        .schema(_FILES)
        .option("pathGlobFilter", "*.[xX][lL][sS][xX]")
        .option("recursiveFileLookup", "true")
        .option("maxFilesPerTrigger", max_files)
        .load(exports)
    )

    def add(batch_files: DataFrame, batch: int) -> None:
        decoded = workbooks.decode_workbooks(batch_files, root)
        write_table(decoded, folder.path("sheet_rows", batch))
        rows = spark.read.schema(decoded.schema).parquet(folder.path("sheet_rows", batch))
        write_table(workbooks.structure_issues(workbooks.structure_facts(rows)), folder.path("issues", batch))
        add_batch(wells_from_sheet_rows(rows), out, batch)

    writer = files.writeStream.foreachBatch(add).option("checkpointLocation", f"{out}/_stream")
    return (writer.trigger(availableNow=True) if once else writer).start()

"""Reading parsed runs and writing result tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from platewise.functions.text import is_control, nan_to_null, to_number
from platewise.schema import RUN_FIELDS, WELLS
from platewise.sources import publishing

# Keep blanks around texts and line breaks inside them; double a quote to escape it.
_CSV = {
    "header": True,
    "escape": '"',
    "ignoreLeadingWhiteSpace": False,
    "ignoreTrailingWhiteSpace": False,
}

#: How wells in run order are written: row groups of a few thousand plates.
_RUN_ORDER = {
    "parquet.block.size": 16 << 20,
    "parquet.bloom.filter.enabled#run_id": "true",
    "parquet.bloom.filter.adaptive.enabled": "true",
    "parquet.enable.dictionary#run_id": "false",
}

_TEXT_NEVER_NULL = [*RUN_FIELDS, "sample_label_clean"]


def load_wells(spark: SparkSession, folder: str, fmt: str = "parquet") -> DataFrame:
    """Wells written by ``write_wells``, with the fixed schema and by column name. ``folder`` is
    that table, or an output folder with a published set that has ``wells``."""
    if publishing.current(spark, folder) is not None:
        folder, fmt = publishing.table_path(spark, folder, "wells")
    if fmt == "parquet":
        return spark.read.schema(WELLS).parquet(folder)
    return _typed(spark.read.options(**_CSV, multiLine=True, enforceSchema=False).csv(folder))


def load_parsed_files(spark: SparkSession, folder: str, pattern: str = "*_parsed.csv") -> DataFrame:
    """Wells of all files of that name, one file per run, joined up by column name.

    Spark's reader gives the fields of all files by position, the header of each as its
    first row. These files have no row number; a file that may have line breaks inside
    quotes is read by one task from its first row to its last, so the ids that Spark gives rows while it
    scans keep their order. A window by file, which one task has read already, turns
    them into row numbers and spreads the header over the rows. Columns may differ per file in number
    and order; of equal names the last counts. A file that is not UTF-8 ends the job
    with its name. The header is the first line that is not empty, without line breaks in it.
    """
    where = {"pathGlobFilter": pattern, "recursiveFileLookup": "true"}
    lines = spark.read.options(**where).text(folder).filter("length(value) > 0")
    first = lines.select(
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("line"),
        "value",
    )
    heads = first.groupBy("path").agg(F.min_by("value", F.struct("block", "line")).alias("head"))
    width = heads.agg(F.max(F.regexp_count("head", F.lit(",")))).first()[0]
    if width is None:  # else there are files, and listing all of them once more is spared
        files = spark.read.format("binaryFile").options(**where).load(folder)
        if files.select("path").isEmpty():
            raise FileNotFoundError(f"no {pattern} below {folder}")
    names = [f"c{i}" for i in range((width or 0) + 1)]
    schema = ", ".join(f"{n} string" for n in names)
    path, cells = F.col("_metadata.file_path"), F.array(*[F.nullif(F.col(n), F.lit("")) for n in names])
    fields = (
        spark.read.options(**{**_CSV, "header": False, "multiLine": True}, **where)
        .schema(schema)
        .csv(folder)
        .select(path.alias("path"), F.monotonically_increasing_id().alias("place"), cells.alias("cells"))
    )
    by_file = Window.partitionBy("path").orderBy("place")
    # The mark that decoders put for bytes that are not UTF-8.
    odd = F.exists("cells", lambda c: F.coalesce(c.contains("\ufffd"), F.lit(False)))
    told = F.raise_error(F.concat("path", F.lit(" cannot be read: not UTF-8"))).cast("array<string>")
    numbered = fields.select(
        (F.row_number().over(by_file) - 2).alias("row_idx"),
        F.when(odd, told).otherwise(F.col("cells")).alias("cells"),
        F.reverse(F.first("cells").over(by_file)).alias("names"),
    ).filter("row_idx >= 0")
    plain = F.transform("names", lambda n: F.regexp_replace(n, "^\ufeff", ""))
    at = [F.array_position("names", F.lit(f.name)).alias(f.name) for f in WELLS if f.name != "row_idx"]
    # From the right of the reversed header to the left of the fields.
    column = {
        f.name: F.when(F.col(f"at.{f.name}") > 0, F.get("cells", (len(names) - F.col(f"at.{f.name}")).cast("int")))
        for f in WELLS
        if f.name != "row_idx"
    }
    mapped = numbered.withColumn("names", plain).withColumn("at", F.struct(*at)).withColumns(column)
    return _typed(mapped.select(*column, "row_idx"))


def _typed(text: DataFrame) -> DataFrame:
    """Text columns to the fixed schema; absent columns become NULL."""
    present = set(text.columns)

    def column(field):
        name, kind = field.name, field.dataType.simpleString()
        value = F.col(name) if name in present else F.lit(None).cast("string")
        if kind == "double":
            return nan_to_null(to_number(value))
        if kind == "string":
            return F.coalesce(value, F.lit("")) if name in _TEXT_NEVER_NULL else value
        if name == "is_control":
            # An absent or unreadable mark must not take the well out of all statistics.
            content = F.col("content") if "content" in present else F.lit(None).cast("string")
            return F.coalesce(value.try_cast(kind), is_control(content))
        return value.try_cast(kind)

    return text.select(*[column(f).alias(f.name) for f in WELLS])


def write_table(df: DataFrame, folder: str, fmt: str = "parquet") -> None:
    """Write a result table, replacing an older one. CSV files carry a header."""
    writer = df.write.mode("overwrite")
    if fmt == "csv":
        writer = writer.options(**_CSV)
    writer.format(fmt).save(folder)


def table_exists(spark: SparkSession, folder: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def write_one_file(df: DataFrame, path: str) -> None:
    """Write a small result table as one CSV file of exactly that name."""
    spark = df.sparkSession
    parts = f"{path}__parts"
    df.coalesce(1).write.mode("overwrite").options(**_CSV).csv(parts)
    hadoop = spark._jvm.org.apache.hadoop.fs
    folder = hadoop.Path(parts)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    part = next(f.getPath() for f in fs.listStatus(folder) if f.getPath().getName().startswith("part-"))
    fs.delete(hadoop.Path(path), True)
    fs.rename(part, hadoop.Path(path))
    fs.delete(folder, True)


def remove_table(spark: SparkSession, folder: str) -> None:
    """Remove a table of an earlier run, if there is one."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def write_wells(wells: DataFrame, folder: str, fmt: str = "parquet") -> None:
    """Write the table of wells in run order across its files, and beside it, as
    ``<folder>_files``, the runs that each file spans.

    Rows are dealt into ranges of (run, row), so a run lies in one file, or in
    neighbouring ones if it is large: a run of a third of all wells is spread over a third
    of the files. A folder per run would mean millions of tiny files. Within a file, small row
    groups with statistics and a Bloom filter let a filter on runs skip the others.
    """
    remove_table(wells.sparkSession, f"{folder}_files")
    ordered = wells.repartitionByRange("run_id", "row_idx").sortWithinPartitions("run_id", "row_idx")
    if fmt != "parquet":
        write_table(ordered, folder, fmt)
        return
    writer = ordered.write.mode("overwrite").options(**_RUN_ORDER)
    writer.parquet(folder)
    write_table(file_spans(wells.sparkSession.read.schema(WELLS).parquet(folder)), f"{folder}_files")


def file_spans(wells: DataFrame) -> DataFrame:
    """First and last run and number of rows of each file; reads the run column only. Runs
    without an id are counted apart."""
    return wells.groupBy(F.col("_metadata.file_path").alias("path")).agg(
        F.min("run_id").alias("first_run"),
        F.max("run_id").alias("last_run"),
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(F.col("run_id").isNull()).alias("n_without_run"),
    )


def load_runs(spark: SparkSession, folder: str, run_ids: list[str]) -> DataFrame:
    """The wells of some runs. Only files that may hold one of them are opened, as far as
    ``write_wells`` left their spans; there are as many of these as the runs fill, and one
    or two more for each run."""
    wanted = F.col("run_id").isin(run_ids)
    if publishing.current(spark, folder) is not None:
        folder = publishing.table_path(spark, folder, "wells")[0]
    if not table_exists(spark, f"{folder}_files"):
        return load_wells(spark, folder).filter(wanted)
    asked = F.array(*[F.lit(r) for r in run_ids]) if run_ids else F.array().cast("array<string>")
    inside = F.exists(asked, lambda r: r.between(F.col("first_run"), F.col("last_run")))
    paths = [r["path"] for r in spark.read.parquet(f"{folder}_files").filter(inside).select("path").collect()]
    if not paths:
        return spark.createDataFrame([], WELLS)
    return spark.read.schema(WELLS).parquet(*paths).filter(wanted)

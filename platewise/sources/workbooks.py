"""Spreadsheet exports as a table of sheet rows, and the tables found in them."""

from __future__ import annotations

import re

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F

from platewise.functions.text import folded, strip
from platewise.schema import (
    HEADER_SCAN_ROWS,
    MISSING_WORDS,
    REQUIRED_COLUMNS,
    RESULT_COLUMNS,
    RUN_INFO_KEYS,
    SHEET_ROWS,
)
from platewise.sources import workbook_source, xlsx_decode

# Ship the decoder with the tasks, so workers need no installed package.
cloudpickle.register_pickle_by_value(xlsx_decode)

#: Bytes of a file that the decoder gets in one row; more where a file has too many such pieces.
PIECE_BYTES = 1 << 10
MOST_PIECES = 128


def read_workbooks(spark: SparkSession, folder: str, reader: str = "auto") -> DataFrame:
    """Sheet rows of all ``*.xlsx`` files below ``folder``, in any letter case.

    ``reader`` is ``ranges`` for ``sources.workbook_source``, where memory does not depend on the
    size of a file, or ``whole``, where Spark hands each file over as one value of at most
    2 GiB, for stores that only Spark can open and for paths with wildcards; ``auto``
    chooses by the path.
    """
    root = qualified(spark, folder)
    if reader not in ("auto", "ranges", "whole"):
        raise ValueError("reader is auto, ranges or whole")
    plain = not re.search(r"[*?\[{]", folder) and root.partition(":")[0] in workbook_source.SCHEMES
    if reader == "ranges" or (reader == "auto" and plain):
        workbook_source.register(spark)
        rows = spark.read.format(workbook_source.FORMAT).load(root)
        return rows.withColumn("run_id", run_id_of(F.col("path"), root))
    files = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", "*.[xX][lL][sS][xX]")
        .option("recursiveFileLookup", "true")
        .load(folder)
    )
    return decode_workbooks(files, root)


def qualified(spark: SparkSession, folder: str) -> str:
    """The folder as the paths of its files begin; up to the first wildcard, if any."""
    plain = re.split(r"/[^/]*[*?\[{]", folder, maxsplit=1)[0] or "/"
    path = spark._jvm.org.apache.hadoop.fs.Path(plain)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString().rstrip("/")


def decode_workbooks(files: DataFrame, folder: str | None = None) -> DataFrame:
    """Sheet rows of workbooks given as (path, content), with the run of each file.

    The decoder gets files in pieces: Spark hands over batches of a number of rows, which
    would else grow with the files.
    """
    size = F.expr(f"cast(greatest({PIECE_BYTES}, length(content) div {MOST_PIECES} + 1) as int)")
    last = F.expr("cast(greatest(0, (length(content) - 1) div size) as int)")
    sized = files.select("path", "content", size.alias("size")).withColumn("last", last)
    numbered = sized.withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("last"))))
    pieces = numbered.select(
        "path",
        F.substring("content", F.col("piece") * F.col("size") + 1, F.col("size")).alias("content"),
        (F.col("piece") == F.col("last")).alias("last"),
    )
    rows = pieces.mapInArrow(xlsx_decode.decode_batches, SHEET_ROWS)
    return rows.withColumn("run_id", run_id_of(F.col("path"), folder))


def _by_file() -> WindowSpec:
    """All rows of a file.

    The file format allows at most 1,048,576 per sheet, and one task has decoded
    them already: this key cannot grow with the data.
    """
    return Window.partitionBy("path")


def run_id_of(path: Column, folder: str | None = None) -> Column:
    """The path below ``folder`` without extension; the plain file name elsewhere.

    Files of equal names in different folders are different runs, and a run keeps its
    id when files are added.
    """
    name = F.regexp_extract(path, r"([^/]+?)(\.[^./]*)?$", 1)
    if folder is None:
        return name
    below = F.substr(path, F.lit(len(folder) + 2))
    return F.when(path.startswith(folder + "/"), F.regexp_replace(below, r"(?<=[^/])\.[^./]*$", "")).otherwise(name)


def cells(sheet_rows: DataFrame) -> DataFrame:
    """Long form: one row per non-empty cell."""
    return (
        sheet_rows.filter(F.col("row_idx").isNotNull())
        .select(
            "path",
            "run_id",
            "sheet_idx",
            "sheet_name",
            "row_idx",
            F.posexplode("values").alias("col_idx", "value"),
        )
        .filter(F.col("value").isNotNull())
    )


def _column_position(target: str) -> Column:
    """1-based position of the first header word of a results column, 0 if absent."""
    if target == "ic_cq":
        named = F.transform("words", lambda w: (w.contains("i.c") | w.contains("ic")) & w.contains("cq"))
        return F.array_position(named, F.lit(True)).cast("int")
    word = {"target_cq": "cq", "sample_label": "sample"}.get(target, target)
    return F.array_position("words", F.lit(word)).cast("int")


def _error_where(condition: Column) -> Column:
    return F.max(F.when(condition, F.col("error"))).over(_by_file())


def locate_tables(sheet_rows: DataFrame) -> DataFrame:
    """Sheet rows with what their whole workbook tells, in one pass by file.

    Adds ``n_sheets``, ``results_idx`` (the first of two sheets with a cell ``well`` in its
    first 30 rows; else the first sheet with one anywhere; else 0), ``run_info_idx`` (the
    first other sheet, NULL with one sheet), ``header`` (first header row of the results
    sheet and the column positions in it) and ``file_error``.
    """
    near_top = (F.col("sheet_idx") < 2) & (F.col("row_idx") < HEADER_SCAN_ROWS) & F.col("has_well")
    of_results = F.col("sheet_idx") == F.col("results_idx")
    header = F.struct("row_idx", *[_column_position(c).alias(c) for c in RESULT_COLUMNS])
    return (
        sheet_rows.withColumn("values", F.transform("values", lambda v: F.when(~v.isin(MISSING_WORDS), v)))
        .withColumn("words", F.transform("values", folded))
        .withColumn("has_well", F.coalesce(F.array_contains("words", "well"), F.lit(False)))
        .withColumns(
            {
                "n_sheets": F.coalesce(F.max("sheet_idx").over(_by_file()) + 1, F.lit(0)),
                "results_idx": F.coalesce(
                    F.min(F.when(near_top, F.col("sheet_idx"))).over(_by_file()),
                    F.min(F.when(F.col("has_well"), F.col("sheet_idx"))).over(_by_file()),
                    F.lit(0),
                ),
            }
        )
        .withColumns(
            {
                "run_info_idx": F.when(
                    F.col("n_sheets") >= 2, F.when(F.col("results_idx") == 0, 1).otherwise(0)
                ),
                "header": F.min(F.when(of_results & F.col("has_well"), header)).over(_by_file()),
                "file_error": F.coalesce(
                    _error_where(F.col("sheet_idx").isNull()), _error_where(of_results)
                ),
            }
        )
        .drop("words", "has_well")
    )


def sheet_roles(sheet_rows: DataFrame) -> DataFrame:
    """Which sheet holds the results and which the run information, per file."""
    return (
        locate_tables(sheet_rows)
        .filter(F.col("n_sheets") > 0)
        .groupBy("path", "run_id")
        .agg(F.first("results_idx").alias("results_idx"), F.first("run_info_idx").alias("run_info_idx"))
    )


def _info_entry() -> Column:
    return F.coalesce(
        (F.col("sheet_idx") == F.col("run_info_idx"))
        & F.get("values", F.lit(0)).isNotNull()
        & F.get("values", F.lit(1)).isNotNull(),
        F.lit(False),
    )


def _info_value(key: str) -> Column:
    """Value of the last entry with this key (aggregate)."""
    matches = _info_entry() & (strip(F.get("values", F.lit(0))) == key)
    return F.max_by(strip(F.get("values", F.lit(1))), F.when(matches, F.col("row_idx")))


def run_info(sheet_rows: DataFrame) -> DataFrame:
    """The four run fields of each file, '' where the key is absent."""
    fields = [F.coalesce(_info_value(key), F.lit("")).alias(name) for name, key in RUN_INFO_KEYS.items()]
    return locate_tables(sheet_rows).groupBy("path", "run_id").agg(*fields)


def run_info_entries(sheet_rows: DataFrame) -> DataFrame:
    """All key/value entries of the run information sheets; the last of a key wins."""
    return (
        locate_tables(sheet_rows)
        .filter(_info_entry())
        .groupBy("path", "run_id", strip(F.get("values", F.lit(0))).alias("key"))
        .agg(F.max_by(strip(F.get("values", F.lit(1))), "row_idx").alias("value"))
    )


def _field(target: str) -> Column:
    """Cell of a data row that belongs to a results column, NULL if not mapped."""
    return F.get("values", F.col(f"header.{target}") - 1)


def _is_data_row() -> Column:
    return F.coalesce(
        (F.col("sheet_idx") == F.col("results_idx"))
        & (F.col("row_idx") > F.col("header.row_idx"))
        & F.col("file_error").isNull(),
        F.lit(False),
    )


def _data_rows(located: DataFrame, *kept: str) -> DataFrame:
    columns = [_field(c).alias(c) for c in RESULT_COLUMNS]
    file_order = (F.col("row_idx") - F.col("header.row_idx") - 1).alias("row_idx")
    return located.filter(_is_data_row()).select("path", "run_id", file_order, *columns, *kept)


def results_table(sheet_rows: DataFrame) -> DataFrame:
    """Rows below the header with the seven known columns as text.

    Files without a header row or with an unreadable results sheet have no rows
    here; ``checks.structure_issues`` names them.
    """
    return _data_rows(locate_tables(sheet_rows))


def results_with_run_info(sheet_rows: DataFrame) -> DataFrame:
    """``results_table`` and ``run_info`` side by side, still in one shuffle by file."""
    located = locate_tables(sheet_rows)
    fields = {name: F.coalesce(_info_value(key).over(_by_file()), F.lit("")) for name, key in RUN_INFO_KEYS.items()}
    return _data_rows(located.withColumns(fields), *fields)


def structure_facts(sheet_rows: DataFrame) -> DataFrame:
    """Per file: sheets, their roles, mapped columns and number of data rows."""
    mapped = [F.first(F.coalesce(F.col(f"header.{c}") > 0, F.lit(False))) for c in RESULT_COLUMNS]
    return locate_tables(sheet_rows).groupBy("path", "run_id").agg(
        F.first("n_sheets").alias("n_sheets"),
        F.first("results_idx").alias("results_idx"),
        F.first("run_info_idx").alias("run_info_idx"),
        F.first(F.col("header").isNotNull()).alias("has_header"),
        F.first("file_error").alias("file_error"),
        *[flag.alias(f"has_{c}") for flag, c in zip(mapped, RESULT_COLUMNS)],
        F.count(F.when(_is_data_row() & _field("well").isNotNull(), F.lit(1))).alias("data_rows"),
    )


def _issues(facts: DataFrame) -> DataFrame:
    """Facts with the list of issues of each file. Files of one run id are counted over
    that id; it is the file's own in all but the reported cases."""

    def issue(when: Column, severity: str, text: Column | str) -> Column:
        text = F.lit(text) if isinstance(text, str) else text
        return F.when(when, F.struct(F.lit(severity).alias("severity"), text.alias("issue")))

    readable = F.col("file_error").isNull()
    usable = readable & (F.col("n_sheets") > 0) & F.col("has_header")
    unread = F.concat(F.lit("Workbook cannot be read: "), F.col("file_error"))
    found = [
        issue(F.col("file_error") == "no sheets", "CRITICAL", "Workbook has no sheets."),
        issue(F.col("file_error") != "no sheets", "CRITICAL", unread),
        issue(readable & ~F.col("has_header"), "CRITICAL", "Could not locate header row containing 'Well'."),
        issue(
            usable & F.col("run_info_idx").isNull(),
            "WARNING",
            "Run Information sheet not found; metadata will be blank.",
        ),
        *[
            issue(usable & ~F.col(f"has_{c}"), "CRITICAL", f"Expected column '{c}' not found in results sheet.")
            for c in REQUIRED_COLUMNS
        ],
        issue(F.col("files") > 1, "CRITICAL", "Run id is used by more than one file."),
    ]
    files = F.count(F.lit(1)).over(Window.partitionBy("run_id"))
    return facts.withColumn("files", files).withColumn("issues", F.array_compact(F.array(*found)))


def structure_issues(facts: DataFrame) -> DataFrame:
    """Problems of each file as (path, run_id, severity, issue)."""
    return _issues(facts).select("path", "run_id", F.inline("issues"))


def structure_report(facts: DataFrame) -> DataFrame:
    """One row per file: data rows, number of issues, and whether it passes."""
    n_issues = F.size("issues").cast("long")
    return _issues(facts).select(
        "path", "run_id", "n_sheets", "data_rows", n_issues.alias("n_issues"), (n_issues == 0).alias("passed")
    )

"""Plate runs derived from a generic ``events`` table.

Every 96 consecutive events make one run and every event one well, so the derived
tables grow with ``events``. The mapping covers the cases that matter to the
operators: junk numbers, absent values, odd case and blanks, wells off the plate,
duplicate wells, runs with too few or constant internal controls.
"""

from __future__ import annotations


from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from checks import xlsx_encode

cloudpickle.register_pickle_by_value(xlsx_encode)

WELLS_PER_RUN = 96

# A given schema spares the job that would look it up in the files.
_EVENTS = "event_id bigint, event_type string, value double, props string"


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.schema(_EVENTS).parquet(f"{sf_dir}/events.parquet")


def _run_id(run_no: Column) -> Column:
    return F.concat(F.lit("run_"), F.lpad(run_no.cast("string"), 6, "0"))


def _numbered(source: DataFrame) -> DataFrame:
    return source.select(
        F.expr(f"event_id div {WELLS_PER_RUN}").alias("run_no"),
        (F.col("event_id") % WELLS_PER_RUN).cast("int").alias("pos"),
        F.regexp_extract("props", "[0-9]+", 0).cast("int").alias("k"),
        F.round(F.col("value") * 100).cast("bigint").alias("cents"),
        "event_type",
    ).withColumn("run_id", _run_id(F.col("run_no")))


def raw_results(source: DataFrame) -> DataFrame:
    """Well rows as an export would hold them, numbers still as text or raw double."""
    run_digit, pos, k, kind = F.col("run_no") % 10, F.col("pos"), F.col("k"), F.col("event_type")
    letter = F.chr(F.lit(65) + F.expr("pos div 12"))
    well = (
        F.when((run_digit == 9) & (pos == 1), "A01")
        .when((run_digit == 6) & (pos == 2), "A13")
        .when((run_digit == 6) & (pos == 3), "a04")
        .otherwise(F.concat(letter, F.lpad((pos % 12 + 1).cast("string"), 2, "0")))
    )
    content = F.when(pos == 94, "Pos Ctrl").when(pos == 95, " neg ctrl ").otherwise("Unkn")
    label = (
        F.when(pos == 94, "Pos Control")
        .when(pos == 95, "Neg Control")
        .when(k == 10, "")
        .when(k == 11, F.lit(None))
        .when(kind == "click", "Manual   Pos")
        .when(kind == "purchase", "Lysis 1.25  mL Control")
        .when(kind == "view", "Auto Neg")
        .when(kind == "signup", "Manual Neg")
        .otherwise("Lysis 5 ml Control")
    )
    result = (
        F.when(pos >= 94, "Valid Ctrl")
        .when(k < 3, F.lit(None))
        .when(k < 8, "Inhibition")
        .when(kind == "click", "Positive")
        .when(kind == "purchase", " positive ")
        .otherwise("Negative")
    )
    cq = (F.lit(20.0) + (F.col("cents") % 2000) / F.lit(100.0)).cast("string")
    target = (
        F.when(pos == 94, cq)
        .when((pos == 95) | (k < 3), F.lit(None))
        .when(k < 8, "N/A")
        .when(kind.isin("click", "purchase"), cq)
    )
    ic = (
        F.when((run_digit == 7) & (pos > 1), F.lit(None))
        .when(run_digit == 8, F.lit(28.0))
        .when(k == 99, F.lit(36.0))
        .otherwise(F.lit(28.0) + (k - 50) / F.lit(100.0))
    )
    return _numbered(source).select(
        "run_no",
        "run_id",
        F.col("pos").alias("row_idx"),
        well.alias("well"),
        content.alias("content"),
        label.alias("sample_label"),
        target.alias("target_cq"),
        ic.alias("ic_cq"),
        F.lit(None).cast("string").alias("sq"),
        result.alias("result"),
    )


def _runs(source: DataFrame) -> DataFrame:
    return _numbered(source).select("run_no", "run_id").distinct()


def run_fields(source: DataFrame) -> DataFrame:
    """Run information, one row per run."""
    run_no = F.col("run_no")
    return (
        _runs(source)
        .select(
            "run_id",
            F.lit("2024-01-01").alias("run_date"),
            F.lit("").alias("assay_name"),
            F.when(run_no % 5 == 0, "lot_last")
            .otherwise(F.concat(F.lit("lot_"), (run_no % 5).cast("string")))
            .alias("lot_number"),
            F.when(run_no % 4 == 0, "")
            .otherwise(F.concat(F.lit("ext_"), run_no.cast("string")))
            .alias("extraction_lot"),
        )
    )


def _number_cell(value: Column) -> Column:
    """Text a number cell is read back as: no fraction on whole numbers."""
    whole = value == F.floor(value)
    return F.when(whole, value.cast("bigint").cast("string")).otherwise(value.cast("string"))


def sheet_rows(source: DataFrame) -> DataFrame:
    """The runs laid out as two-sheet workbooks, in the form the decoder returns.

    Sheet order, title row, spacer column and left-out columns vary with the run.
    """
    run_no, text = F.col("run_no"), "string"
    results_idx = (run_no % 2).cast("int")
    title_rows = F.when(run_no % 3 == 0, 1).otherwise(0)
    path = F.concat(F.lit("file:/exports/"), F.col("run_id"), F.lit(".xlsx"))
    nothing = F.array().cast("array<string>")
    spacer = F.when(run_no % 3 == 0, F.array(F.lit(None).cast(text))).otherwise(nothing)

    def optional(left_out: Column, value: Column) -> Column:
        return F.when(left_out, nothing).otherwise(F.array(value))

    def laid_out(named: list[Column], sq: Column, result: Column) -> Column:
        return F.concat(
            spacer, F.array(*named), optional(run_no % 4 == 1, sq), optional(run_no % 20 == 19, result)
        )

    raw = raw_results(source)
    target = F.col("target_cq")
    target_cell = F.when(target == "N/A", target).otherwise(_number_cell(target.try_cast("double")))
    labels = ["well", "content", "sample_label"]
    wells = raw.select(
        path.alias("path"),
        results_idx.alias("sheet_idx"),
        F.lit("Results").alias("sheet_name"),
        (F.col("row_idx") + title_rows + 1).cast("int").alias("row_idx"),
        laid_out(
            [F.nullif(F.col(c), F.lit("")) for c in labels] + [target_cell, _number_cell(F.col("ic_cq"))],
            F.col("sq"),
            F.col("result"),
        ).alias("values"),
    )

    heads = [F.lit(h) for h in ("Well", "Content", "Sample", "Cq", "I.C. Cq")]
    head_values = laid_out(heads, F.lit("SQ"), F.lit("Result"))

    def pair(key: str, value: Column) -> Column:
        return F.array(F.lit(key), value)

    lot = F.concat(F.lit("lot_"), (run_no % 5).cast(text))
    info = F.array_compact(
        F.array(
            pair("Run Started", F.lit(" 2024-01-01 ")),
            pair("Lot Number", lot),
            F.when(run_no % 5 == 0, pair("Lot Number", F.lit("lot_last"))),
            F.when(run_no % 4 != 0, pair("Extraction Lot Number", F.concat(F.lit("ext_"), run_no.cast(text)))),
        )
    )

    def row(sheet_idx: Column, name: str, row_idx: Column, values: Column) -> Column:
        return F.struct(
            sheet_idx.alias("sheet_idx"),
            F.lit(name).alias("sheet_name"),
            row_idx.cast("int").alias("row_idx"),
            values.alias("values"),
        )

    none = F.lit(None)
    no_values = none.cast("array<string>")
    title = F.when(run_no % 3 == 0, row(results_idx, "Results", F.lit(0), F.array(none.cast(text), F.lit("Plate results"))))
    per_run = F.concat(
        F.array_compact(
            F.array(
                row(results_idx, "Results", none, no_values),
                row(1 - results_idx, "Run Information", none, no_values),
                title,
                row(results_idx, "Results", title_rows, head_values),
            )
        ),
        F.transform(info, lambda pair_, i: row(1 - results_idx, "Run Information", i, pair_)),
    )
    others = (
        _runs(source)
        .select(path.alias("path"), F.explode(per_run).alias("r"))
        .select("path", "r.*")
    )
    named = F.regexp_extract("path", r"([^/]+)\.xlsx$", 1)
    return (
        wells.unionByName(others)
        .withColumn("error", F.lit(None).cast("string"))
        .withColumn("run_id", named)
    )


def workbook_files(source: DataFrame) -> DataFrame:
    """The same workbooks as (path, content) with real file bytes."""
    return sheet_rows(source).groupBy("path").applyInPandas(xlsx_encode.encode_file, "path string, content binary")

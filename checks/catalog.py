"""Named queries over the plate runs derived from an ``events`` table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from platewise.functions import text
from platewise.operators import boxes, feeds, flags, plates, runs, stats, wells
from platewise.plans import jobs
from platewise.schema import RUN_FIELDS, WELLS
from platewise.session import scratch_folder
from checks import plate_events
from platewise.sources import publishing, tables, workbooks
from platewise.streaming import incremental

# The sample types the mapping of events gives, for tables with a column per type.
SAMPLE_TYPES = [
    "Auto_Neg",
    "Lysis_1.25mL_Control",
    "Lysis_5mL_Control",
    "Manual_Neg",
    "Manual_Pos",
    "Unknown",
]

# Runs that a reader asks for by name; the last one does not exist.
SELECTED_RUNS = ["run_000000", "run_000003", "run_000021", "no such run"]

Query = Callable[[SparkSession, str], DataFrame]


def raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plate_events.raw_results(plate_events.events(spark, sf_dir)).drop("run_no")


def clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wells without run fields and replicate numbers."""
    return wells.clean_wells(raw(spark, sf_dir))


def full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole table of wells."""
    fields = plate_events.run_fields(plate_events.events(spark, sf_dir))
    numbered = wells.replicate_numbers(clean(spark, sf_dir))
    return wells.attach_run_info(numbered, fields).select(*WELLS.names)


def sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sheet rows that went through real workbook bytes."""
    files = plate_events.workbook_files(plate_events.events(spark, sf_dir))
    return workbooks.decode_workbooks(files)


def laid_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same sheet rows without the detour over bytes."""
    return plate_events.sheet_rows(plate_events.events(spark, sf_dir))


def _on_clean(operator: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: operator(clean(spark, sf_dir))


def _on_flags(operator: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: operator(flags.flag_rows(clean(spark, sf_dir)))


def _on_stats(operator: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: operator(stats.sample_type_stats(clean(spark, sf_dir)))


def _dotless(df: DataFrame) -> DataFrame:
    """Column names that need no quoting; the library keeps the dots."""
    return df.toDF(*[c.replace(".", "_") for c in df.columns])


def _on_types(operator: Callable[..., DataFrame]) -> Query:
    return lambda spark, sf_dir: _dotless(operator(clean(spark, sf_dir), SAMPLE_TYPES))


def _annotated(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = full(spark, sf_dir)
    return flags.annotate_wells(base, flags.flag_rows(clean(spark, sf_dir)))


def _cq_by_plate_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = clean(spark, sf_dir)
    return feeds.cq_by_plate_row(flags.annotate_wells(base, flags.flag_rows(base)))


def _run_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = flags.mark_ic_failures(full(spark, sf_dir), flags.flag_rows(clean(spark, sf_dir)))
    return stats.run_detail(marked)


def _ic_fail_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = clean(spark, sf_dir)
    return flags.mark_ic_failures(base, flags.flag_rows(base)).select("run_id", "row_idx", "well", "ic_failed")


def _key_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = clean(spark, sf_dir)
    return stats.key_metrics(base, flags.flag_rows(base))


def _attach_run_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = plate_events.run_fields(plate_events.events(spark, sf_dir))
    return wells.attach_run_info(clean(spark, sf_dir), fields).select("run_id", "row_idx", "well", *RUN_FIELDS)


def _numeric_coerce(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wells.coerce_numbers(raw(spark, sf_dir)).select("run_id", "row_idx", "target_cq", "ic_cq", "sq")


def _is_positive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw(spark, sf_dir).select(
        "run_id", "row_idx", "result", text.is_positive(F.col("result")).alias("is_positive")
    )


def _has_target_cq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean(spark, sf_dir).select("run_id", "row_idx", F.col("target_cq").isNotNull().alias("has_target_cq"))


def _results_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wells.coerce_numbers(workbooks.results_table(laid_out(spark, sf_dir)))


def _wells_from_workbooks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wells.wells_from_sheet_rows(sheets(spark, sf_dir))


def _validate_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return workbooks.structure_issues(workbooks.structure_facts(laid_out(spark, sf_dir)))


def _structure_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return workbooks.structure_report(workbooks.structure_facts(laid_out(spark, sf_dir)))


def _load_runs(fmt: str) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        folder = f"{scratch_folder(spark)}/wells"
        tables.write_wells(full(spark, sf_dir), folder, fmt)
        return tables.load_wells(spark, folder, fmt)

    return query


#: Folders of trial files, by application and source: written once, read by every run of the query.
_TRIAL_FILES: dict[tuple[str, str], str] = {}


def _parsed_files(spark: SparkSession, sf_dir: str) -> str:
    """One CSV file per run; every other run lacks columns."""
    key = spark.sparkContext.applicationId, sf_dir
    if key in _TRIAL_FILES:
        return _TRIAL_FILES[key]
    folder = f"{scratch_folder(spark)}/parsed"
    base = full(spark, sf_dir).withColumn("odd", F.regexp_like("run_id", F.lit("[13579]$")))
    names = [c for c in WELLS.names if c != "row_idx"]
    blanks = {"ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}
    how = {"quoteAll": "true", "escape": '"', "nullValue": "", "emptyValue": "", **blanks}
    kinds = (~F.col("odd"), names), (F.col("odd"), [c for c in names if c not in ("sq", "assay_name", "is_control")])

    def by_kind(value: Callable[[list[str]], Column]) -> Column:
        return F.coalesce(*[F.when(kind, value(columns)) for kind, columns in kinds])

    line = by_kind(lambda columns: F.to_csv(F.struct(*[F.col(c).cast("string").alias(c) for c in columns]), how))
    lines = F.sort_array(F.collect_list(F.struct("row_idx", line.alias("line"))))["line"]
    # One pass for both kinds, and one record, which is a run, per file: to list a folder
    # per run took most of the time, a task each.
    (
        base.filter("odd is not null")
        .groupBy("odd", "run_id")
        .agg(lines.alias("lines"))
        .select("odd", F.concat_ws("\n", by_kind(lambda columns: F.lit(",".join(columns))), "lines").alias("value"))
        .write.partitionBy("odd")
        .option("maxRecordsPerFile", 1)
        .text(folder)
    )
    _TRIAL_FILES[key] = folder
    return folder


def _load_parsed_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.load_parsed_files(spark, _parsed_files(spark, sf_dir), "*.txt")


def content_digest(df: DataFrame) -> DataFrame:
    """Number of rows, and the sum over them of the first 32 bits of the md5 of their values as
    text, columns in order of name; numbers with a point count in millionths."""

    def shown(field) -> Column:
        value = F.col(f"`{field.name}`")
        if field.dataType.simpleString() == "double":
            value = F.round(value * 1_000_000).cast("bigint")
        return F.coalesce(value.cast("string"), F.lit("~"))

    line = F.concat_ws("|", *[shown(f) for f in sorted(df.schema, key=lambda f: f.name)])
    first = F.conv(F.substring(F.md5(line), 1, 8), 16, 10).cast("bigint")
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.coalesce(F.sum(first), F.lit(0)).alias("content"))


def _write_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Publish all tables, resolve the published set, and digest what its tables hold."""
    folder = scratch_folder(spark)
    tables.write_wells(full(spark, sf_dir), f"{folder}/parsed")
    written = jobs.write_outputs(spark, tables.load_wells(spark, f"{folder}/parsed"), f"{folder}/out")
    digests = [
        content_digest(publishing.published(spark, f"{folder}/out", name)).select(
            F.lit(name).alias("table_name"), "n_rows", "content"
        )
        for name in written
    ]
    result = digests[0]
    for one in digests[1:]:
        result = result.unionByName(one)
    return result


def _load_selected_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{scratch_folder(spark)}/wells"
    tables.write_wells(full(spark, sf_dir), folder)
    return tables.load_runs(spark, folder, SELECTED_RUNS)


def _incremental(table: Callable[[SparkSession, str], DataFrame]) -> Query:
    """The runs come in four batches, dealt by a hash; the last one is repeated."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = f"{scratch_folder(spark)}/incremental"
        base = full(spark, sf_dir)
        for batch in (0, 1, 2, 3, 3):
            incremental.add_batch(base.filter(F.pmod(F.xxhash64("run_id"), F.lit(4)) == batch), out, batch)
        return table(spark, out)

    return query


def _sketched_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the quartiles of sketches lie within one percent, or one value, of their rank."""
    base = clean(spark, sf_dir)
    boxed = boxes.cq_box_stats(base, sketch_size=800).select("sample_type", "n", "q1", "median", "q3")
    value = F.col("target_cq")
    ranked = [
        column
        for name in ("q1", "median", "q3")
        for column in (
            F.count(F.when(value < F.col(name), F.lit(1))).alias(f"{name}_below"),
            F.count(F.when(value <= F.col(name), F.lit(1))).alias(f"{name}_upto"),
        )
    ]
    counted = base.filter("not is_control and target_cq is not null").join(boxed, "sample_type").groupBy("sample_type", "n").agg(*ranked)

    def near(name: str, share: float) -> Column:
        n = F.col("n")
        return ((F.col(f"{name}_below") <= n * (share + 0.01) + 1) & (F.col(f"{name}_upto") >= n * (share - 0.01) - 1)).alias(f"{name}_near")

    return counted.select("sample_type", "n", near("q1", 0.25), near("median", 0.5), near("q3", 0.75))


def _plate_accounting(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = clean(spark, sf_dir)
    return plates.plate_accounting(base, plates.split_by_place(base, f"{scratch_folder(spark)}/plate_wells"))


def _select(operator: Callable[[DataFrame], DataFrame], *columns: str) -> Query:
    return lambda spark, sf_dir: operator(clean(spark, sf_dir)).select("run_id", "row_idx", *columns)


def queries() -> dict[str, Query]:
    return {
        # reading and checking
        "workbook_cells": lambda s, d: workbooks.cells(sheets(s, d)),
        "sheet_roles": lambda s, d: workbooks.sheet_roles(laid_out(s, d)),
        "run_info": lambda s, d: workbooks.run_info(laid_out(s, d)),
        "run_info_entries": lambda s, d: workbooks.run_info_entries(laid_out(s, d)),
        "results_table": _results_table,
        "wells_from_workbooks": _wells_from_workbooks,
        "validate_structure": _validate_structure,
        "structure_report": _structure_report,
        "load_runs": _load_runs("parquet"),
        "load_runs_csv": _load_runs("csv"),
        "load_parsed_runs": _load_parsed_runs,
        "load_selected_runs": _load_selected_runs,
        "write_outputs": _write_outputs,
        # row-wise steps
        "sample_type": _select(lambda w: w, "sample_label", "sample_type", "sample_label_clean"),
        "is_control": _select(lambda w: w, "content", "is_control"),
        "numeric_coerce": _numeric_coerce,
        "drop_blank_wells": lambda s, d: wells.drop_blank_wells(raw(s, d)).select("run_id", "row_idx", "well"),
        "is_positive": _is_positive,
        "has_target_cq": _has_target_cq,
        "well_position": _select(plates.well_position, "well", "plate_row", "plate_col", "on_plate"),
        "off_plate_wells": _on_clean(plates.off_plate_wells),
        "plate_accounting": _plate_accounting,
        "plate_order": _select(plates.plate_order, "well", "order_row", "order_col"),
        "well_label": _on_clean(lambda w: feeds.well_labels(w).select("run_id", "row_idx", "well", "label")),
        "result_code": _on_clean(
            lambda w: feeds.well_labels(w).select("run_id", "row_idx", "result_code", "result_class")
        ),
        # numbering and run fields
        "replicate_numbers": lambda s, d: wells.replicate_numbers(clean(s, d)).select(
            "run_id", "row_idx", "sample_type", "replicate"
        ),
        "attach_run_info": _attach_run_info,
        # quality flags
        "borderline_flags": _on_clean(lambda w: flags.qc_flags(flags.borderline_flags(w))),
        "ic_outlier_flags": _on_clean(lambda w: flags.qc_flags(flags.ic_outlier_flags(w))),
        "qc_flags": _on_flags(flags.qc_flags),
        "annotated_wells": _annotated,
        "ic_fail_lookup": _ic_fail_lookup,
        "flag_reason_counts": _on_flags(flags.flag_reason_counts),
        "flags_display": _on_flags(flags.flags_display),
        # statistics
        "sample_type_stats": _on_clean(stats.sample_type_stats),
        "control_stats": _on_clean(stats.control_stats),
        "key_metrics": _key_metrics,
        "parse_summary": _on_clean(stats.parse_summary),
        "grand_band": _on_clean(stats.grand_band),
        "dimension_lists": _on_clean(stats.dimension_lists),
        "stats_display": lambda s, d: _dotless(_on_stats(stats.stats_display)(s, d)),
        "stats_text": _on_stats(stats.stats_text),
        "run_detail": _run_detail,
        "run_detail_display": lambda s, d: _dotless(stats.run_detail_display(_run_detail(s, d))),
        # runs
        "interrun_cv": _on_clean(runs.interrun_cv),
        "run_comparison_long": _on_clean(runs.run_comparison_long),
        "run_positivity_long": _on_clean(runs.run_positivity_long),
        "types_left_out": lambda s, d: runs.left_out(clean(s, d), SAMPLE_TYPES).select("run_id", "row_idx", "sample_type"),
        "run_comparison": _on_types(runs.run_comparison),
        "run_positivity_matrix": _on_types(runs.run_positivity_matrix),
        # runs that come in batches
        "incremental_stats": _incremental(incremental.sample_type_stats),
        "incremental_controls": _incremental(incremental.control_stats),
        "incremental_cv": _incremental(incremental.interrun_cv),
        "incremental_flags": _incremental(lambda s, o: flags.qc_flags(incremental.flag_rows(s, o))),
        # plates
        "last_write_wins": _on_clean(plates.last_write_wins),
        "plate_result_grid": _on_clean(plates.plate_result_grid),
        "plate_cq_grid": _on_clean(plates.plate_cq_grid),
        "plate_cq_scale": _on_clean(plates.plate_cq_scale),
        "plate_layout": _on_clean(plates.plate_layout),
        # charts
        "positivity_bar": _on_stats(feeds.positivity_bar),
        "cq_scatter": _on_clean(feeds.cq_scatter),
        "cq_by_plate_row": _cq_by_plate_row,
        "cq_by_sample_type": _on_clean(feeds.cq_by_sample_type),
        "cq_box_stats": _on_clean(boxes.cq_box_stats),
        "cq_box_sketches": _sketched_boxes,
        "interrun_cv_bar": _on_clean(lambda w: runs.interrun_cv_bar(runs.interrun_cv(w))),
    }

"""The steps from spreadsheet exports to result tables.

Each step writes its tables and the next reads them, so a lost executor costs no
more than the step it was in, and no table is computed twice. The tables of a step are
published together (``sources.publishing``): readers never see those of two jobs side by side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from platewise.operators import boxes, feeds, flags, plates, runs, stats
from platewise.operators.wells import wells_from_sheet_rows
from platewise.sources import workbooks
from platewise.sources.publishing import Publication
from platewise.sources.tables import load_wells, write_one_file, write_table, write_wells


#: Result tables that are small by nature: a row per sample type, control or reason.
SMALL_TABLES = {"summary_statistics", "control_statistics", "interrun_cv", "stats_display", "stats_text", "key_metrics"}


def _write(job: Publication, name: str, table: DataFrame, fmt: str = "parquet") -> None:
    """Writes a table of the set; ``csv-files`` gives small ones as a single named file."""
    if fmt == "csv-files":
        if name in SMALL_TABLES:
            path = job.path(f"{name}.csv", "csv")
            job.tables[name] = job.tables.pop(f"{name}.csv")
            write_one_file(table, path)
            return
        fmt = "csv"
    write_table(table, job.path(name, fmt), fmt)


def decode(spark: SparkSession, exports: str, job: Publication) -> DataFrame:
    """Decode all exports once; later steps read the written sheet rows."""
    write_table(workbooks.read_workbooks(spark, exports), job.path("sheet_rows"))
    rows = job.read("sheet_rows")
    if rows.isEmpty():
        raise FileNotFoundError(f"no .xlsx files below {exports}")
    return rows


def facts_of(sheet_rows: DataFrame, job: Publication) -> DataFrame:
    """One row per file, written first: issues and report then read that small table."""
    write_table(workbooks.structure_facts(sheet_rows), job.path("structure_facts"))
    return job.read("structure_facts")


def check(spark: SparkSession, exports: str, out: str) -> dict[str, DataFrame]:
    """Validate the exports without parsing them: issues and a verdict per file."""
    job = Publication(spark, out)
    facts = facts_of(decode(spark, exports, job), job)
    tables = {"issues": workbooks.structure_issues(facts), "structure_report": workbooks.structure_report(facts)}
    for name, table in tables.items():
        _write(job, name, table)
    job.publish()
    return {name: job.read(name) for name in tables}


def parse(spark: SparkSession, exports: str, out: str, fmt: str = "parquet") -> tuple[DataFrame, bool]:
    """Exports to the table of wells, and whether every file could be used; ``issues``
    lists what is wrong with the others."""
    job = Publication(spark, out)
    kind = "csv" if fmt == "csv-files" else fmt
    sheet_rows = decode(spark, exports, job)
    write_wells(wells_from_sheet_rows(sheet_rows), job.path("wells", kind), kind)
    if kind == "parquet":
        job.path("wells_files")
    issues = workbooks.structure_issues(facts_of(sheet_rows, job))
    _write(job, "issues", issues, kind)
    job.publish()
    return load_wells(spark, out), issues.filter("severity = 'CRITICAL'").isEmpty()


def write_outputs(
    spark: SparkSession, wells: DataFrame, out: str, fmt: str = "parquet", types: list[str] | None = None
) -> list[str]:
    """Flags, annotated wells and the statistics tables, published as a new set; returns the
    tables of it.

    Runs are compared in long form: sample types are free texts, and as columns they
    would have to pass the driver. With ``types`` the wide form of these is written too, and
    beside it the wells of types that it leaves out. Annotated wells are written in run
    order, so that readers skip row groups by run. Control statistics and inter-run CV are
    in the set only if they have rows.
    """
    job = Publication(spark, out)
    write_table(flags.flag_rows(wells), job.path("flag_rows"))
    flagged = job.read("flag_rows")
    annotated = flags.annotate_wells(wells, flagged)
    tables = {
        "qc_flags": flags.qc_flags(flagged.sortWithinPartitions(*flags.flag_order())),
        "all_runs_combined": annotated.repartitionByRange("run_id", "row_idx").sortWithinPartitions("run_id", "row_idx"),
        "summary_statistics": stats.sample_type_stats(wells),
        "run_comparison": runs.run_comparison_long(wells),
    }
    if types:
        tables["run_comparison_wide"] = runs.run_comparison(wells, types)
        tables["run_comparison_left_out"] = runs.left_out(wells, types)
    for name, small in {
        "control_statistics": stats.control_stats(wells),
        "interrun_cv": runs.interrun_cv(wells),
    }.items():
        # A handful of rows: kept so that the test and the write compute them once.
        kept = small.persist()
        if kept.isEmpty():
            kept.unpersist()
        else:
            tables[name] = kept
    for name, table in tables.items():
        _write(job, name, table, fmt)
        table.unpersist()
    job.publish()
    return sorted(tables)


def write_chart_tables(spark: SparkSession, wells: DataFrame, out: str, fmt: str = "parquet") -> list[str]:
    """The tables behind the charts, added to the set that ``write_outputs`` published, whose
    flags they use.

    Wells are split into those on the plate and those off it in one write; the grids show the
    former, ``off_plate_wells`` lists the latter, and ``plate_accounting`` tells of each run
    that nothing is missing. A run in which it does not add up ends the job.
    """
    job = Publication(spark, out, take_over=True)
    flagged = job.read("flag_rows")
    placed = plates.split_by_place(wells, job.path("plate_wells"))
    tables = {
        "positivity_bar": feeds.positivity_bar(stats.sample_type_stats(wells)),
        "cq_scatter": feeds.cq_scatter(wells),
        "plate_result_grid": plates.plate_result_grid(placed),
        "plate_cq_grid": plates.plate_cq_grid(placed),
        "plate_cq_scale": plates.plate_cq_scale(placed),
        "off_plate_wells": plates.off_plate_wells(placed),
        "plate_accounting": plates.plate_accounting(wells, placed),
        "run_positivity": runs.run_positivity_long(wells),
        "dimension_lists": stats.dimension_lists(wells),
        "cq_by_plate_row": feeds.cq_by_plate_row(flags.annotate_wells(wells, flagged)),
        "cq_by_sample_type": feeds.cq_by_sample_type(wells),
        "cq_box_stats": boxes.cq_box_stats(wells),
        "grand_band": stats.grand_band(wells),
        "interrun_cv_bar": runs.interrun_cv_bar(runs.interrun_cv(wells)),
    }
    for name, table in tables.items():
        _write(job, name, table, fmt)
    accounts = spark.read.schema(tables["plate_accounting"].schema).options(header=True)
    path = f"{job.out}/{job.tables['plate_accounting']['path']}"
    odd = accounts.format(job.tables["plate_accounting"]["format"]).load(path).filter("not balanced").first()
    if odd is not None:
        raise RuntimeError(f"wells of run {odd['run_id']} are neither on the plate nor rejected")
    job.publish()
    return sorted(tables)


def write_report_tables(spark: SparkSession, wells: DataFrame, out: str, fmt: str = "parquet") -> list[str]:
    """The tables of the report, added to the set that ``write_outputs`` published, whose
    flags they use."""
    job = Publication(spark, out, take_over=True)
    flagged = job.read("flag_rows")
    summary = stats.sample_type_stats(wells)
    tables = {
        "key_metrics": stats.key_metrics(wells, flagged),
        "stats_display": stats.stats_display(summary),
        "stats_text": stats.stats_text(summary),
        "run_detail": stats.run_detail_display(stats.run_detail(flags.mark_ic_failures(wells, flagged))),
        "flags_display": flags.flags_display(flagged.sortWithinPartitions(*flags.flag_order())),
        "plate_layout": plates.plate_layout(wells).sortWithinPartitions("run_id", "plate_row"),
        "parse_summary": stats.parse_summary(wells).sortWithinPartitions("run_id"),
        "flag_reason_counts": flags.flag_reason_counts(flagged).orderBy(*flags.flag_order()),
    }
    for name, table in tables.items():
        _write(job, name, table, fmt)
    job.publish()
    return sorted(tables)

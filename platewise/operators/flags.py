"""Quality flags and the wells that carry them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from platewise.functions.skew import join_side
from platewise.functions.text import fixed, is_borderline
from platewise.schema import (
    BORDERLINE_REASON,
    FLAG_HEADINGS,
    IC_MIN_VALUES,
    IC_REASON_MARK,
    IC_SD_LIMIT,
    QC_FLAGS,
)

# Internal form of a flag: the public columns, its kind (0 borderline, 1 internal
# control) and the file order of its well. Both fix the order of reasons.
_FLAG_ROW = [*QC_FLAGS, "kind", "row_idx"]


def borderline_flags(wells: DataFrame) -> DataFrame:
    """Sample wells with a target Cq above 35: a filter that reaches the scan."""
    return (
        wells.filter(~F.col("is_control") & is_borderline(F.col("target_cq")))
        .withColumn("flag_reason", F.lit(BORDERLINE_REASON))
        .withColumn("kind", F.lit(0))
        .select(*_FLAG_ROW)
    )


def ic_run_stats(wells: DataFrame) -> DataFrame:
    """Mean and SD of the internal control over the sample wells of each run.

    Only runs that can be judged: enough values and some spread.
    """
    return (
        wells.filter(~F.col("is_control") & F.col("ic_cq").isNotNull() & F.col("run_id").isNotNull())
        .groupBy("run_id")
        .agg(
            F.count("ic_cq").alias("ic_values"),
            F.avg("ic_cq").alias("ic_mean"),
            F.stddev_samp("ic_cq").alias("ic_sd"),
        )
        .filter((F.col("ic_values") >= IC_MIN_VALUES) & (F.col("ic_sd") > 0))
        .drop("ic_values")
    )


def _ic_reason() -> Column:
    return F.concat(
        F.lit("IC extraction failure: I.C. Cq="),
        fixed(F.col("ic_cq"), 2),
        F.lit(" (plate mean="),
        fixed(F.col("ic_mean"), 2),
        F.lit(", SD="),
        fixed(F.col("ic_sd"), 2),
        F.lit(")"),
    )


def _is_ic_outlier() -> Column:
    return F.abs(F.col("ic_cq") - F.col("ic_mean")) > IC_SD_LIMIT * F.col("ic_sd")


def ic_outlier_flags(wells: DataFrame) -> DataFrame:
    """Sample wells whose internal control is over 2 SD off the mean of their run.

    Statistics are combined before their shuffle and joined back, rather than
    taken over a window, so that no single task has to hold a whole run: adaptive
    execution splits the join where a run is hot.
    """
    measured = wells.filter(~F.col("is_control") & F.col("ic_cq").isNotNull())
    return (
        measured.select("run_id", "well", "sample_type", "row_idx", "ic_cq")
        .join(join_side(ic_run_stats(wells)), "run_id")
        .filter(_is_ic_outlier())
        .withColumn("flag_reason", _ic_reason())
        .withColumn("kind", F.lit(1))
        .select(*_FLAG_ROW)
    )


def flag_rows(wells: DataFrame) -> DataFrame:
    """All flags in internal form. The wells are read twice: for the statistics of the
    runs, and for all their flags at once."""
    judged = (
        wells.filter(~F.col("is_control") & (F.col("ic_cq").isNotNull() | is_borderline(F.col("target_cq"))))
        .select("run_id", "well", "sample_type", "row_idx", "target_cq", "ic_cq")
        .join(join_side(ic_run_stats(wells)), "run_id", "left")
    )

    def flag(when: Column, reason: Column, kind: int) -> Column:
        return F.when(when, F.struct(reason.alias("flag_reason"), F.lit(kind).alias("kind")))

    found = F.array_compact(
        F.array(
            flag(is_borderline(F.col("target_cq")), F.lit(BORDERLINE_REASON), 0),
            flag(_is_ic_outlier(), _ic_reason(), 1),
        )
    )
    return judged.select("run_id", "well", "sample_type", "row_idx", F.inline(found)).select(*_FLAG_ROW)


def qc_flags(flags: DataFrame) -> DataFrame:
    """Public form of the flag list."""
    return flags.select(*QC_FLAGS)


def flag_order() -> list[str]:
    """Sort columns of the flag list: by kind, then run, then file order."""
    return ["kind", "run_id", "row_idx"]


def flag_texts(flags: DataFrame) -> DataFrame:
    """All reasons of a (run, well) in one text, borderline first, then by file order.

    Borderline reasons are all alike, so they are counted instead of collected.
    """
    borderline = F.count(F.when(F.col("kind") == 0, F.lit(1)))
    ic_reasons = F.array_sort(
        F.collect_list(F.when(F.col("kind") == 1, F.struct("row_idx", "flag_reason")))
    )
    return flags.groupBy("run_id", "well").agg(
        F.array_join(
            F.concat(
                F.array_repeat(F.lit(BORDERLINE_REASON), borderline.cast("int")),
                F.transform(ic_reasons, lambda r: r.flag_reason),
            ),
            "; ",
        ).alias("qc_flag")
    )


def annotate_wells(wells: DataFrame, flags: DataFrame) -> DataFrame:
    """Add ``qc_flag`` to every row of a flagged (run, well), '' elsewhere."""
    return wells.join(join_side(flag_texts(flags)), ["run_id", "well"], "left").withColumn(
        "qc_flag", F.coalesce("qc_flag", F.lit(""))
    )


def ic_failed_wells(flags: DataFrame) -> DataFrame:
    """Distinct (run, well) with an internal control flag."""
    return flags.filter(F.col("flag_reason").contains(IC_REASON_MARK)).select("run_id", "well").distinct()


def mark_ic_failures(wells: DataFrame, flags: DataFrame) -> DataFrame:
    """Add ``ic_failed``: is the (run, well) among the internal control failures?"""
    failed = join_side(ic_failed_wells(flags)).withColumn("ic_failed", F.lit(True))
    return wells.join(failed, ["run_id", "well"], "left").withColumn(
        "ic_failed", F.coalesce("ic_failed", F.lit(False))
    )


def flag_reason_counts(flags: DataFrame) -> DataFrame:
    """Flags per reason text, with the place of its first flag to sort by."""
    first = F.min(F.struct("kind", "run_id", "row_idx"))
    return (
        flags.groupBy("flag_reason")
        .agg(F.count(F.lit(1)).alias("n_flags"), first.alias("first"))
        .select(
            "flag_reason",
            "n_flags",
            F.col("first.kind").alias("kind"),
            F.col("first.run_id").alias("run_id"),
            F.col("first.row_idx").alias("row_idx"),
        )
    )


def flags_display(flags: DataFrame) -> DataFrame:
    return qc_flags(flags).withColumnsRenamed(FLAG_HEADINGS)

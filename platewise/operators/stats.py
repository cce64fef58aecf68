"""Statistics over all runs. Every aggregate is combined before its shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from platewise.functions.text import (
    fixed,
    is_positive,
    percent,
    result_is,
    round_even,
    stable,
    strip,
)
from platewise.schema import BORDERLINE_CQ, DETAIL_HEADINGS, STATS_HEADINGS


def sample_wells(wells: DataFrame) -> DataFrame:
    return wells.filter(~F.col("is_control"))


def with_target_cq(wells: DataFrame) -> DataFrame:
    """Sample wells that have a target Cq, the base of the Cq charts."""
    return sample_wells(wells).filter(F.col("target_cq").isNotNull())


def count_where(condition: Column) -> Column:
    return F.count(F.when(condition, F.lit(1)))


def _mean_and_sd(name: str) -> list[Column]:
    return [
        round_even(F.avg(name), 3).alias(f"mean_{name}"),
        round_even(F.stddev_samp(name), 3).alias(f"sd_{name}"),
    ]


def sample_type_stats(wells: DataFrame) -> DataFrame:
    """Counts, positivity and Cq statistics of the sample wells per sample type."""
    return (
        sample_wells(wells)
        .filter(F.col("sample_type").isNotNull())
        .groupBy("sample_type")
        .agg(
            F.count("well").alias("n_wells"),
            count_where(is_positive(F.col("result"))).alias("n_positive"),
            F.count(F.lit(1)).alias("n_rows"),
            F.count("target_cq").alias("n_target_cq"),
            *_mean_and_sd("target_cq"),
            round_even(F.min("target_cq"), 3).alias("min_target_cq"),
            round_even(F.max("target_cq"), 3).alias("max_target_cq"),
            *_mean_and_sd("ic_cq"),
        )
        .select(
            "sample_type",
            "n_wells",
            "n_positive",
            (F.col("n_rows") - F.col("n_positive")).alias("n_negative"),
            "n_target_cq",
            *[f"{s}_target_cq" for s in ("mean", "sd", "min", "max")],
            "mean_ic_cq",
            "sd_ic_cq",
            round_even(percent(F.col("n_positive"), F.col("n_wells")), 1).alias("positivity_rate_pct"),
        )
        .orderBy("sample_type")
    )


def control_stats(wells: DataFrame) -> DataFrame:
    """Counts and Cq statistics of the plate controls per control type."""
    return (
        wells.filter("is_control")
        .groupBy(strip(F.col("content")).alias("ctrl_type"))
        .agg(
            F.count("well").alias("n_controls"),
            count_where(result_is(F.col("result"), "valid ctrl")).alias("n_valid"),
            *_mean_and_sd("target_cq"),
            *_mean_and_sd("ic_cq"),
        )
        .orderBy("ctrl_type")
    )


def _run_and_type_counts(wells: DataFrame) -> DataFrame:
    """Wells per run and sample type; controls have no type. Input of distinct counts."""
    sample = ~F.col("is_control")
    return wells.groupBy("run_id", F.when(sample, F.col("sample_type")).alias("sample_type")).agg(
        F.count(F.lit(1)).alias("wells"),
        count_where(~sample).alias("controls"),
        count_where(sample & is_positive(F.col("result"))).alias("positives"),
    )


def key_metrics(wells: DataFrame, flags: DataFrame) -> DataFrame:
    """One row: runs, sample wells, positives, rate, sample types and flags.

    Distinct counts run on the small table of (run, type) pairs, not on wells.
    """
    n_flags = flags.agg(F.count(F.lit(1)).alias("n_flags")).scalar()
    samples = F.sum(F.col("wells") - F.col("controls"))
    return (
        _run_and_type_counts(wells)
        .agg(
            F.countDistinct("run_id").alias("n_runs"),
            F.coalesce(samples, F.lit(0)).alias("n_samples"),
            F.coalesce(F.sum("positives"), F.lit(0)).alias("n_positive"),
            F.countDistinct("sample_type").alias("n_sample_types"),
        )
        .withColumn(
            "positivity_rate_pct",
            F.coalesce(round_even(percent(F.col("n_positive"), F.col("n_samples")), 1), F.lit(0.0)),
        )
        .withColumn("n_flags", n_flags)
    )


def parse_summary(wells: DataFrame) -> DataFrame:
    """Per run: wells, controls and distinct sample types of the sample wells."""
    return (
        _run_and_type_counts(wells)
        .groupBy("run_id")
        .agg(
            F.sum("wells").alias("n_wells"),
            F.sum("controls").alias("n_controls"),
            F.count("sample_type").alias("n_sample_types"),
        )
    )


def grand_band(wells: DataFrame) -> DataFrame:
    """Mean and SD of the target Cq over all sample wells, and the band of 2 SD."""
    mean, sd = F.col("grand_mean"), F.col("grand_sd")
    return (
        with_target_cq(wells)
        .agg(
            F.count("target_cq").alias("n_wells"),
            F.avg("target_cq").alias("grand_mean"),
            F.stddev_samp("target_cq").alias("grand_sd"),
            F.min("target_cq").alias("lowest"),
        )
        .select(
            "n_wells",
            stable(mean).alias("grand_mean"),
            stable(sd).alias("grand_sd"),
            stable(mean - 2 * sd).alias("band_low"),
            stable(mean + 2 * sd).alias("band_high"),
            stable(F.col("lowest") - 0.5 * sd).alias("label_level"),
        )
    )


def dimension_lists(wells: DataFrame) -> DataFrame:
    """Sorted distinct values: all runs, all sample types, and those in the Cq charts."""
    sample = ~F.col("is_control")
    plotted = sample & F.col("has_cq")

    def member(dimension: str, value: str, condition: Column) -> Column:
        return F.when(
            condition & F.col(value).isNotNull(),
            F.struct(F.lit(dimension).alias("dimension"), F.col(value).alias("value")),
        )

    lists = F.array(
        member("run", "run_id", F.lit(True)),
        member("sample_type", "sample_type", sample),
        member("plotted_run", "run_id", plotted),
        member("plotted_sample_type", "sample_type", plotted),
    )
    return (
        wells.select("run_id", "sample_type", "is_control", F.col("target_cq").isNotNull().alias("has_cq"))
        .distinct()
        .select(F.explode(F.array_compact(lists)).alias("member"))
        .select("member.*")
        .distinct()
        .orderBy("dimension", "value")
    )


def stats_display(stats: DataFrame) -> DataFrame:
    """Sample type statistics under their display names."""
    return stats.select(*STATS_HEADINGS).withColumnsRenamed(STATS_HEADINGS)


def stats_text(stats: DataFrame) -> DataFrame:
    """Sample type statistics as the texts of a report table."""
    dash = F.lit("—")
    return stats.select(
        "sample_type",
        F.concat_ws("/", "n_positive", "n_wells").alias("positive"),
        F.concat(fixed(F.col("positivity_rate_pct"), 1), F.lit("%")).alias("positivity"),
        F.coalesce(fixed(F.col("mean_target_cq"), 3), dash).alias("mean_target_cq"),
        F.coalesce(fixed(F.col("sd_target_cq"), 3), dash).alias("sd_target_cq"),
    )


def run_detail(marked: DataFrame) -> DataFrame:
    """Detail view of wells marked by ``flags.mark_ic_failures``, with a status per row."""
    word = F.lower(strip(F.col("result")))
    return marked.select(
        *DETAIL_HEADINGS,
        F.when(word.isin("positive", "negative", "inhibition"), word).alias("result_status"),
        F.when(F.col("target_cq") > BORDERLINE_CQ, "borderline").alias("cq_status"),
        F.when(F.col("ic_failed"), "ic_failure").alias("ic_status"),
    )


def run_detail_display(detail: DataFrame) -> DataFrame:
    """The detail view under its display names; the status columns keep theirs."""
    return detail.withColumnsRenamed(DETAIL_HEADINGS)

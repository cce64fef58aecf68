"""Comparison between runs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from platewise.functions.text import is_positive, percent, round_even, stable
from platewise.operators.stats import count_where, sample_wells
from platewise.schema import CV_LIMIT_PCT, MIN_RUNS


def run_comparison_long(wells: DataFrame) -> DataFrame:
    """Positives and wells per run and sample type: the form that scales."""
    return (
        sample_wells(wells)
        .filter(F.col("run_id").isNotNull() & F.col("sample_type").isNotNull())
        .groupBy("run_id", "sample_type")
        .agg(
            count_where(is_positive(F.col("result"))).alias("n_positive"),
            F.count(F.lit(1)).alias("n_wells"),
        )
    )


def run_positivity_long(wells: DataFrame) -> DataFrame:
    """Positivity in per cent per run and sample type, if there are two runs or more."""
    several = wells.agg((F.min("run_id") < F.max("run_id")).alias("several")).scalar()
    share = stable(F.lit(100.0) * F.col("n_positive") / F.col("n_wells"))
    return run_comparison_long(wells).filter(several).select("run_id", "sample_type", share.alias("positivity_pct"))


def _check_names(sample_types: Sequence[str]) -> None:
    """Sample types that cannot all be columns of one table raise an error."""
    seen: dict[str, str] = {"run_id": "run_id"}
    for name in sample_types:
        if name is None:
            raise ValueError("a sample type without a name cannot be a column")
        if name.lower() in seen:
            raise ValueError(f"columns {seen[name.lower()]!r} and {name!r} cannot be told apart")
        seen[name.lower()] = name


def left_out(wells: DataFrame, sample_types: Sequence[str]) -> DataFrame:
    """Wells whose sample type is in no column of a wide table of ``sample_types``."""
    return sample_wells(wells).filter(~F.col("sample_type").isin(*sample_types))


def run_comparison(wells: DataFrame, sample_types: Sequence[str]) -> DataFrame:
    """One row per run: ``sum_<type>`` for all types, then ``count_<type>``.

    The caller names the types; ``left_out`` tells what they miss, and
    ``run_comparison_long`` needs no such list. A type without wells in the run is NULL. All columns come from one aggregate,
    so there is one shuffle of one row per run and task.
    """
    _check_names(sample_types)
    samples = sample_wells(wells)
    positive = is_positive(F.col("result"))

    def of_type(name: str, value):
        return F.sum(F.when(F.col("sample_type") == name, value))

    return (
        samples.filter(F.col("run_id").isNotNull() & F.col("sample_type").isNotNull())
        .groupBy("run_id")
        .agg(
            *[of_type(t, positive.cast("int")).alias(f"sum_{t}") for t in sample_types],
            *[of_type(t, F.lit(1)).alias(f"count_{t}") for t in sample_types],
        )
    )


def run_positivity_matrix(wells: DataFrame, sample_types: Sequence[str]) -> DataFrame:
    """Positivity in per cent per run, one column per type, if there are two runs or more.

    Controls count as wells of a run here. Lowest and highest run id differ exactly
    if there are two, which needs no distinct count.
    """
    _check_names(sample_types)
    several = wells.agg((F.min("run_id") < F.max("run_id")).alias("several")).scalar()
    share = F.when(is_positive(F.col("result")), 100.0).otherwise(0.0)
    return (
        sample_wells(wells)
        .filter(F.col("run_id").isNotNull() & F.col("sample_type").isNotNull())
        .filter(several)
        .groupBy("run_id")
        .agg(*[stable(F.avg(F.when(F.col("sample_type") == t, share))).alias(t) for t in sample_types])
    )


def interrun_cv(wells: DataFrame) -> DataFrame:
    """Mean, SD and CV% of the run means of the target Cq, types with two runs or more."""
    per_run = (
        sample_wells(wells)
        .filter(F.col("target_cq").isNotNull() & F.col("run_id").isNotNull() & F.col("sample_type").isNotNull())
        .groupBy("run_id", "sample_type")
        .agg(F.avg("target_cq").alias("run_mean_cq"))
    )
    return cv_of_run_means(per_run)


def cv_of_run_means(per_run: DataFrame) -> DataFrame:
    """The same from the mean of each run and type (run_id, sample_type, run_mean_cq)."""
    mean, sd = F.col("mean_cq"), F.col("sd_cq")
    return (
        per_run.groupBy("sample_type")
        .agg(
            F.count("run_mean_cq").alias("n_runs"),
            F.avg("run_mean_cq").alias("mean_cq"),
            F.stddev_samp("run_mean_cq").alias("sd_cq"),
        )
        .filter(F.col("n_runs") >= MIN_RUNS)
        .select(
            "sample_type",
            "n_runs",
            round_even(mean, 3).alias("mean_cq"),
            round_even(sd, 3).alias("sd_cq"),
            round_even(percent(sd, mean), 1).alias("cv_pct"),
        )
        .orderBy("sample_type")
    )


def interrun_cv_bar(cv: DataFrame) -> DataFrame:
    """CV chart: bars, their labels and the line of acceptable CV."""
    return cv.select(
        "sample_type",
        "cv_pct",
        F.format_string("%.1f%%", "cv_pct").alias("bar_label"),
        F.lit(CV_LIMIT_PCT).alias("limit_pct"),
        (F.col("cv_pct") > CV_LIMIT_PCT).alias("above_limit"),
    )

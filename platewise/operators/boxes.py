"""Exact box plot statistics per sample type, for groups of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from platewise.functions.skew import join_side
from platewise.functions.text import stable
from platewise.operators.stats import with_target_cq

# Width 1/1000 of a cycle: few bands per sample type, few distinct values per band.
_BANDS_PER_CYCLE = 1000
_QUARTILES = {"q1": 0.25, "median": 0.5, "q3": 0.75}
_WHISKER_REACH = 1.5
# Ranks at which a sketch is asked for the values that whiskers may end at.
_SKETCH_RANKS = [i / 400 for i in range(401)]


def _counted_values(points: DataFrame) -> DataFrame:
    """Distinct values of each type with their number, counted before the shuffle."""
    return points.groupBy("sample_type", "target_cq").agg(F.count(F.lit(1)).alias("n"))


def _ranked_values(counted: DataFrame) -> DataFrame:
    """The distinct values with the ranks [start, end) they take within their type.

    Ranks are summed up in two levels, over bands of values and inside each band,
    so that no task has to sort a whole sample type.
    """
    banded = counted.withColumn("band", F.floor(F.col("target_cq") * _BANDS_PER_CYCLE))
    by_type = Window.partitionBy("sample_type")
    earlier = by_type.orderBy("band").rowsBetween(Window.unboundedPreceding, -1)
    bands = (
        banded.groupBy("sample_type", "band")
        .agg(F.sum("n").alias("in_band"))
        .select(
            "sample_type",
            "band",
            F.coalesce(F.sum("in_band").over(earlier), F.lit(0)).alias("before"),
            F.sum("in_band").over(by_type).alias("total"),
        )
    )
    in_band = Window.partitionBy("sample_type", "band").orderBy("target_cq")
    upto = F.sum("n").over(in_band.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    # Every band is there, so the left join drops nothing; an inner one would add
    # a filter below the counts and keep Spark from computing them only once.
    return (
        banded.withColumn("upto", upto)
        .join(bands, ["sample_type", "band"], "left")
        .select(
            "sample_type",
            "target_cq",
            "total",
            (F.col("before") + F.col("upto") - F.col("n")).alias("start"),
            (F.col("before") + F.col("upto")).alias("end"),
        )
    )


def _value_at(rank: Column) -> Column:
    here = (F.col("start") <= rank) & (rank < F.col("end"))
    return F.max(F.when(here, F.col("target_cq")))


def _quartiles(ranked: DataFrame) -> DataFrame:
    """Linear interpolation between the two values around each quartile."""
    columns = []
    for name, share in _QUARTILES.items():
        at = (F.col("total") - 1) * F.lit(share)
        columns += [_value_at(F.floor(at)).alias(f"{name}_low"), _value_at(F.ceil(at)).alias(f"{name}_high")]
    found = ranked.groupBy("sample_type").agg(F.max("total").alias("total"), *columns)

    def between(name: str, share: float) -> Column:
        at = (F.col("total") - 1) * F.lit(share)
        low, high = F.col(f"{name}_low"), F.col(f"{name}_high")
        return (low + (high - low) * (at - F.floor(at))).alias(name)

    return found.select("sample_type", *[between(*q) for q in _QUARTILES.items()])


def cq_sketches(wells: DataFrame, k: int) -> DataFrame:
    """A quantile sketch of the target Cq of each run and sample type, with number and
    extremes. Sketches of any runs can be merged; ``k`` sets their size and precision."""
    return (
        with_target_cq(wells)
        .filter(F.col("sample_type").isNotNull())
        .groupBy("run_id", "sample_type")
        .agg(
            F.count("target_cq").alias("n"),
            F.min("target_cq").alias("lowest"),
            F.max("target_cq").alias("highest"),
            F.kll_sketch_agg_double("target_cq", k).alias("sketch"),
        )
    )


def box_stats_of_sketches(sketches: DataFrame, k: int) -> DataFrame:
    """``cq_box_stats`` of the runs whose sketches are given. Quartiles and inner whisker ends are
    values of about the right rank; ends that are an extreme are exact."""
    merged = sketches.groupBy("sample_type").agg(
        F.sum("n").alias("n"),
        F.min("lowest").alias("lowest"),
        F.max("highest").alias("highest"),
        F.kll_merge_agg_double("sketch", k).alias("sketch"),
    )
    found = merged.withColumns(
        {name: F.kll_sketch_get_quantile_double("sketch", F.lit(share)) for name, share in _QUARTILES.items()}
    ).withColumn("grid", F.kll_sketch_get_quantile_double("sketch", F.array(*map(F.lit, _SKETCH_RANKS))))
    reach = _WHISKER_REACH * (F.col("q3") - F.col("q1"))
    low = F.array_min(F.filter("grid", lambda v: v >= F.col("q1") - reach))
    high = F.array_max(F.filter("grid", lambda v: v <= F.col("q3") + reach))
    several = F.col("n") >= 2

    def box(value: Column, name: str) -> Column:
        return F.when(several, stable(value)).alias(name)

    return found.withColumns(
        {
            "low": F.when(F.col("lowest") >= F.col("q1") - reach, F.col("lowest")).otherwise(low),
            "high": F.when(F.col("highest") <= F.col("q3") + reach, F.col("highest")).otherwise(high),
        }
    ).select(
        "sample_type",
        "n",
        *[box(F.col(name), name) for name in _QUARTILES],
        box(F.least("low", "q1"), "whisker_low"),
        box(F.greatest("high", "q3"), "whisker_high"),
    )


def cq_box_stats(wells: DataFrame, sketch_size: int | None = None) -> DataFrame:
    """Quartiles and whisker ends of the target Cq; NULL with fewer than two values.

    Whiskers end at the farthest values within 1.5 times the quartile distance. With
    ``sketch_size`` the result comes from sketches of that size instead of all distinct
    values: ranks are off by about 2.3 / ``sketch_size`` at most, in all but rare cases.
    """
    if sketch_size is not None:
        return box_stats_of_sketches(cq_sketches(wells, sketch_size), sketch_size)
    counted = _counted_values(with_target_cq(wells).filter(F.col("sample_type").isNotNull()))
    quartiles = _quartiles(_ranked_values(counted))
    reach = _WHISKER_REACH * (F.col("q3") - F.col("q1"))
    value = F.col("target_cq")
    ends = (
        counted.join(join_side(quartiles), "sample_type")
        .groupBy("sample_type", "q1", "median", "q3")
        .agg(
            F.sum("n").alias("n"),
            F.min(F.when(value >= F.col("q1") - reach, value)).alias("low"),
            F.max(F.when(value <= F.col("q3") + reach, value)).alias("high"),
        )
    )
    several = F.col("n") >= 2

    def box(value_: Column, name: str) -> Column:
        return F.when(several, stable(value_)).alias(name)

    return ends.select(
        "sample_type",
        "n",
        box(F.col("q1"), "q1"),
        box(F.col("median"), "median"),
        box(F.col("q3"), "q3"),
        box(F.least("low", "q1"), "whisker_low"),
        box(F.greatest("high", "q3"), "whisker_high"),
    )

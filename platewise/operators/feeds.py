"""Tables behind the charts. Row-wise except for single-row scalars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from platewise.functions import plate
from platewise.functions.text import fixed, stable, strip
from platewise.operators.plates import well_position
from platewise.operators.stats import grand_band, with_target_cq
from platewise.schema import PLATE_COLUMNS, SCATTER_RESULTS


def positivity_bar(stats: DataFrame) -> DataFrame:
    """Bars of the positivity chart and their labels."""
    counts = F.concat_ws("/", "n_positive", "n_wells")
    rate = F.concat(F.lit("("), fixed(F.col("positivity_rate_pct"), 1), F.lit("%)"))
    return stats.select(
        "sample_type",
        "n_positive",
        "n_wells",
        "positivity_rate_pct",
        F.concat_ws("\n", counts, rate).alias("bar_label"),
    )


def cq_scatter(wells: DataFrame) -> DataFrame:
    """Target against internal control Cq by result; other results are not drawn."""
    word = strip(F.col("result"))
    return (
        with_target_cq(wells)
        .filter(F.col("ic_cq").isNotNull() & word.isin(SCATTER_RESULTS))
        .select(word.alias("result"), "target_cq", "ic_cq")
    )


def cq_by_plate_row(annotated: DataFrame) -> DataFrame:
    """Cq by plate row, spread along the row by column; needs ``qc_flag``.

    The spread follows any column number, inside the plate or not.
    """
    spread = (F.col("plate_col") - 6.5) / float(PLATE_COLUMNS) * 0.76
    return (
        well_position(with_target_cq(annotated).filter(plate.has_position(F.col("well"))))
        .select(
            "run_id",
            "well",
            "plate_row",
            stable(plate.letter_index(F.col("plate_row")) + spread).alias("x_pos"),
            "target_cq",
            F.lower("qc_flag").contains("borderline").alias("borderline"),
        )
    )


def cq_by_sample_type(wells: DataFrame) -> DataFrame:
    """Points of the Cq chart by sample type with the band over all wells.

    The boxes behind the points are ``boxes.cq_box_stats``.
    """
    points = with_target_cq(wells).select("sample_type", "run_id", "well", "row_idx", "target_cq")
    band = grand_band(wells)
    return points.withColumns(
        {name: band.select(name).scalar() for name in ("grand_mean", "band_low", "band_high")}
    )


def well_labels(wells: DataFrame) -> DataFrame:
    """Display label, result code and result class of every well."""
    return wells.select(
        "run_id",
        "row_idx",
        "well",
        plate.well_label(F.col("sample_label"), F.col("content")).alias("label"),
        plate.result_code(F.col("result")).alias("result_code"),
        plate.result_class(F.col("result")).alias("result_class"),
    )


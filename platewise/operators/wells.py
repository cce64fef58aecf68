"""From raw result rows to the table of wells."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from platewise.functions import text
from platewise.functions.numbering import running_number
from platewise.schema import RUN_FIELDS, WELLS
from platewise.sources import workbooks


def coerce_numbers(raw: DataFrame) -> DataFrame:
    """Cq and quantity columns as double, junk and NaN as NULL."""

    def number(name: str):
        is_text = isinstance(raw.schema[name].dataType, T.StringType)
        return text.to_number(F.col(name)) if is_text else text.nan_to_null(F.col(name))

    return raw.withColumns({name: number(name) for name in ("target_cq", "ic_cq", "sq")})


def drop_blank_wells(raw: DataFrame) -> DataFrame:
    return raw.filter(F.col("well").isNotNull())


def classify_samples(raw: DataFrame) -> DataFrame:
    """Add the cleaned label and the sample type."""
    return raw.withColumn("sample_label_clean", text.sample_label_clean(F.col("sample_label"))).withColumn(
        "sample_type", text.sample_type(F.col("sample_label_clean"))
    )


def mark_controls(raw: DataFrame) -> DataFrame:
    return raw.withColumn("is_control", text.is_control(F.col("content")))


def clean_wells(raw: DataFrame) -> DataFrame:
    """All row-wise steps: no shuffle, and columns that are not used cost nothing."""
    return mark_controls(classify_samples(drop_blank_wells(coerce_numbers(raw))))


def attach_run_info(wells: DataFrame, run_info: DataFrame) -> DataFrame:
    """Put the run fields on every well, '' where the run has none.

    ``run_info`` has one row per run, so it grows with the data: the join gets no
    broadcast hint and is left to adaptive execution, which also splits runs that
    hold a large share of the wells.
    """
    fields = run_info.select("run_id", *RUN_FIELDS)
    return wells.join(fields, "run_id", "left").withColumns(
        {name: F.coalesce(name, F.lit("")) for name in RUN_FIELDS}
    )


def replicate_numbers(wells: DataFrame) -> DataFrame:
    """Number the wells of a sample type within their run, in file order."""
    return running_number(wells, ["run_id", "sample_type"], "row_idx", "replicate")


def wells_from_sheet_rows(sheet_rows: DataFrame) -> DataFrame:
    """The table of wells, in one shuffle by file.

    Run fields and replicate numbers are windows over the rows of one file, which
    the file format bounds, so they reuse the partitioning that found the tables.
    """
    cleaned = clean_wells(workbooks.results_with_run_info(sheet_rows))
    order = Window.partitionBy("path", "sample_type").orderBy("row_idx")
    return (
        cleaned.withColumn("replicate", F.row_number().over(order))
        .select(*[F.col(f.name).cast(f.dataType) for f in WELLS])
    )

"""8 x 12 plate grids per run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from platewise.functions import plate
from platewise.functions.text import is_positive
from platewise.schema import PLATE_COLUMNS, PLATE_ROWS

_CELL = ["run_id", "plate_row", "plate_col"]


def well_position(wells: DataFrame) -> DataFrame:
    """Add the plate row letter, the column number and whether the plate has that place."""
    well = F.col("well")
    return wells.withColumns(
        {
            "plate_row": plate.plate_letter(well),
            "plate_col": plate.plate_number(well),
            "on_plate": plate.on_plate(well),
        }
    )


def placed_wells(wells: DataFrame) -> DataFrame:
    return well_position(wells.filter(plate.on_plate(F.col("well"))))


def off_plate_wells(wells: DataFrame) -> DataFrame:
    """Wells the grids leave out: no position, or one outside A1 to H12. Of wells that
    ``split_by_place`` wrote only these are read."""
    on_plate = F.col("on_plate") if "on_plate" in wells.columns else plate.on_plate(F.col("well"))
    return wells.filter(~on_plate).select("run_id", "row_idx", "well")


def split_by_place(wells: DataFrame, folder: str) -> DataFrame:
    """Writes what grids need of the wells, those on the plate and those off it apart, in one
    pass, and gives it back. Each of the two is read without the other."""
    columns = ["run_id", "row_idx", "well", "content", "sample_label", "target_cq", "result"]
    marked = wells.select(*columns, plate.on_plate(F.col("well")).alias("on_plate"))
    marked.write.mode("overwrite").partitionBy("on_plate").parquet(folder)
    schema = marked.schema
    return wells.sparkSession.read.schema(schema).parquet(folder)


def plate_accounting(wells: DataFrame, placed: DataFrame) -> DataFrame:
    """Where the wells of each run went: those that claim a plate place, the places they fill,
    those that a later row of the same place hides, and those off the plate. ``placed`` is
    what ``split_by_place`` gave; ``balanced`` tells that with it no well of the input is missing.
    """
    claims = last_write_wins(placed).select("run_id", F.col("n_rows").alias("n_claims"), F.lit(1).alias("n_places"))
    none = F.lit(0)
    parts = [
        wells.select("run_id", F.lit(1).alias("n_wells"), none.alias("n_claims"), none.alias("n_places"), none.alias("n_off")),
        claims.select("run_id", none, "n_claims", "n_places", none),
        off_plate_wells(placed).select("run_id", none, none, none, F.lit(1)),
    ]
    together = parts[0].union(parts[1]).union(parts[2])
    return together.groupBy("run_id").agg(
        F.sum("n_wells").alias("n_wells"),
        F.sum("n_claims").alias("n_claims"),
        F.sum("n_places").alias("n_places"),
        (F.sum("n_claims") - F.sum("n_places")).alias("n_hidden"),
        F.sum("n_off").alias("n_off_plate"),
        (F.sum("n_claims") + F.sum("n_off") == F.sum("n_wells")).alias("balanced"),
    )


def plate_order(wells: DataFrame) -> DataFrame:
    """Add sort columns of the row-major plate order; wells without position come last."""
    return wells.withColumns(
        {
            "order_row": F.coalesce(plate.plate_letter(F.col("well")), F.lit("Z")),
            "order_col": F.coalesce(plate.plate_number(F.col("well")), F.lit(999)),
        }
    )


def _label() -> Column:
    return plate.well_label(F.col("sample_label"), F.col("content"))


def _last(value: Column, when: Column | None = None) -> Column:
    """Value of the last row in file order (of those that meet ``when``)."""
    order = F.col("row_idx") if when is None else F.when(when, F.col("row_idx"))
    return F.max_by(value, order)


def last_write_wins(wells: DataFrame) -> DataFrame:
    """The row that holds each plate place, and how many rows claim it."""
    return placed_wells(wells).groupBy(*_CELL).agg(
        F.max("row_idx").alias("row_idx"), F.count(F.lit(1)).alias("n_rows")
    )


def plate_result_grid(wells: DataFrame) -> DataFrame:
    """Result code and label of each used plate place; controls are included."""
    code = plate.result_code(F.col("result"))
    winner = _last(F.struct(code.alias("result_code"), _label().alias("label")))
    return placed_wells(wells).groupBy(*_CELL).agg(winner.alias("w")).select(*_CELL, "w.*")


def _cq_cells(wells: DataFrame) -> DataFrame:
    """Target Cq, label and positive mark of each place, with the colour scale of its run.

    Wells off the plate form a group without place: they still decide whether the
    run has any Cq. After the aggregate a run has at most 97 rows, so the window
    over a run is small.
    """
    has_cq = F.col("target_cq").isNotNull()
    inside = F.col("on_plate")
    cells = (
        well_position(wells)
        .groupBy(
            "run_id",
            F.when(inside, F.col("plate_row")).alias("plate_row"),
            F.when(inside, F.col("plate_col")).alias("plate_col"),
        )
        .agg(
            _last(F.struct("target_cq", _label().alias("label")), has_cq).alias("w"),
            F.max(is_positive(F.col("result"))).alias("is_positive"),
            F.max(has_cq).alias("has_cq"),
        )
    )
    run = Window.partitionBy("run_id")
    shown = F.when(F.col("plate_row").isNotNull(), F.col("w.target_cq"))
    return cells.select(
        *_CELL,
        F.col("w.target_cq").alias("target_cq"),
        F.col("w.label").alias("label"),
        "is_positive",
        F.max("has_cq").over(run).alias("run_has_cq"),
        (F.min(shown).over(run) - 1).alias("scale_min"),
        (F.max(shown).over(run) + 1).alias("scale_max"),
    ).filter("run_has_cq")


def plate_cq_grid(wells: DataFrame) -> DataFrame:
    """Places with a Cq or a positive call, of runs that have any Cq."""
    used = F.col("plate_row").isNotNull() & (F.col("target_cq").isNotNull() | F.col("is_positive"))
    return _cq_cells(wells).filter(used).drop("run_has_cq")


def plate_cq_scale(wells: DataFrame) -> DataFrame:
    """Colour limits per run: one below the lowest and one above the highest Cq shown."""
    return _cq_cells(wells).groupBy("run_id").agg(
        F.first("scale_min").alias("scale_min"), F.first("scale_max").alias("scale_max")
    )


def plate_layout(wells: DataFrame) -> DataFrame:
    """Eight rows per run with label and result class of the 12 columns.

    Runs bring their eight empty rows into the aggregate themselves, so there is
    neither a cross join nor a join with a scaffold.
    """
    letters = F.array(*[F.lit(c) for c in PLATE_ROWS])
    nothing = {"plate_col": "int", "row_idx": "int", "label": "string", "class": "string"}
    empty_rows = (
        wells.select("run_id")
        .filter(F.col("run_id").isNotNull())
        .distinct()
        .select("run_id", F.explode(letters).alias("plate_row"))
        .withColumns({name: F.lit(None).cast(kind) for name, kind in nothing.items()})
    )
    filled = placed_wells(wells).select(
        *_CELL, "row_idx", _label().alias("label"), plate.result_class(F.col("result")).alias("class")
    )
    columns = range(1, PLATE_COLUMNS + 1)
    winners = [
        _last(F.struct("label", "class"), F.col("plate_col") == c).alias(f"w_{c}") for c in columns
    ]
    return (
        filled.unionByName(empty_rows)
        .groupBy("run_id", "plate_row")
        .agg(*winners)
        .select(
            "run_id",
            "plate_row",
            *[F.coalesce(f"w_{c}.label", F.lit("")).alias(f"label_{c:02d}") for c in columns],
            *[F.coalesce(f"w_{c}.class", F.lit("empty")).alias(f"class_{c:02d}") for c in columns],
        )
    )

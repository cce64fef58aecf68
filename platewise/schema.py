"""Table schemas and the fixed vocabulary of plate runs."""

from __future__ import annotations

from pyspark.sql import types as T


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, dtype) for name, dtype in fields])


# One row per row of a worksheet. A row without row_idx stands for the sheet
# itself, so empty sheets are known too; one without sheet_idx for a workbook
# that could not be opened.
SHEET_ROWS = _struct(
    ("path", T.StringType()),
    ("sheet_idx", T.IntegerType()),
    ("sheet_name", T.StringType()),
    ("row_idx", T.IntegerType()),
    ("values", T.ArrayType(T.StringType())),
    ("error", T.StringType()),
)

# Names of the columns of the tables.
RUN_FIELDS = ["run_date", "assay_name", "lot_number", "extraction_lot"]

RESULT_COLUMNS = ["well", "content", "sample_label", "target_cq", "ic_cq", "sq", "result"]

WELLS = _struct(
    ("run_id", T.StringType()),
    ("run_date", T.StringType()),
    ("assay_name", T.StringType()),
    ("lot_number", T.StringType()),
    ("extraction_lot", T.StringType()),
    ("well", T.StringType()),
    ("content", T.StringType()),
    ("sample_label", T.StringType()),
    ("target_cq", T.DoubleType()),
    ("ic_cq", T.DoubleType()),
    ("sq", T.DoubleType()),
    ("result", T.StringType()),
    ("sample_type", T.StringType()),
    ("sample_label_clean", T.StringType()),
    ("replicate", T.IntegerType()),
    ("is_control", T.BooleanType()),
    ("row_idx", T.IntegerType()),
)

QC_FLAGS = ["run_id", "well", "sample_type", "flag_reason"]

# Names, words and limits the results depend on.
RUN_INFO_KEYS = {
    "run_date": "Run Started",
    "assay_name": "Assay Name",
    "lot_number": "Lot Number",
    "extraction_lot": "Extraction Lot Number",
}
CONTROL_CONTENTS = ["pos ctrl", "neg ctrl"]
RESULT_CODES = {"positive": -1, "negative": 0, "valid ctrl": 1, "inhibition": 2}
SCATTER_RESULTS = ["Positive", "Negative", "Valid Ctrl", "Unknown"]
REQUIRED_COLUMNS = ["well", "target_cq", "ic_cq", "result"]
BORDERLINE_CQ = 35.0
BORDERLINE_REASON = "Borderline: Target Cq > 35"
IC_REASON_MARK = "IC extraction"
IC_SD_LIMIT = 2.0
IC_MIN_VALUES = 3
MIN_RUNS = 2
CV_LIMIT_PCT = 20.0
PLATE_ROWS = "ABCDEFGH"
PLATE_COLUMNS = 12
HEADER_SCAN_ROWS = 30
# Display names of the columns of report tables.
STATS_HEADINGS = {
    "sample_type": "Sample Type",
    "n_wells": "N Wells",
    "n_positive": "N Positive",
    "n_negative": "N Negative",
    "positivity_rate_pct": "Positivity %",
    "mean_target_cq": "Mean Target Cq",
    "sd_target_cq": "SD Target Cq",
    "mean_ic_cq": "Mean I.C. Cq",
    "sd_ic_cq": "SD I.C. Cq",
}
DETAIL_HEADINGS = {
    "run_id": "Run ID",
    "run_date": "Run Date",
    "assay_name": "Assay Name",
    "lot_number": "Lot Number",
    "extraction_lot": "Extraction Lot",
    "well": "Well",
    "content": "Content",
    "sample_label": "Sample Label",
    "sample_type": "Sample Type",
    "replicate": "Replicate",
    "target_cq": "Target Cq",
    "ic_cq": "I.C. Cq",
    "result": "Result",
}
FLAG_HEADINGS = {
    "run_id": "Run ID",
    "well": "Well",
    "sample_type": "Sample Type",
    "flag_reason": "Flag Reason",
}
# Cell texts that spreadsheet readers for pandas take as missing.
MISSING_WORDS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]

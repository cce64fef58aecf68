"""One run of 18 wells with known results, from the spreadsheet file to every table."""

import pytest

from platewise.operators import flags, runs, stats
from platewise.operators.wells import wells_from_sheet_rows
from platewise.sources.workbooks import read_workbooks
from checks.xlsx_encode import encode

# The documented trial run.
HEADER = ["Well", "Content", "Sample", "Cq", "I.C. Cq", "SQ", "Result"]
WELLS = [
    ["A01", "Unkn", "Manual_Pos", "22.5", "28.1", None, "Positive"],
    ["A02", "Unkn", "Manual_Pos", "23.1", "27.9", None, "Positive"],
    ["A03", "Unkn", "Manual_Pos", "22.8", "28.3", None, "Positive"],
    ["A04", "Unkn", "Manual_Pos", "23.4", "28.0", None, "Positive"],
    ["B01", "Unkn", "Manual_Neg", None, "28.2", None, "Negative"],
    ["B02", "Unkn", "Manual_Neg", None, "27.8", None, "Negative"],
    ["B03", "Unkn", "Manual_Neg", None, "28.4", None, "Negative"],
    ["B04", "Unkn", "Manual_Neg", None, "28.1", None, "Negative"],
    ["C01", "Unkn", "Auto_Pos", "24.2", "28.0", None, "Positive"],
    ["C02", "Unkn", "Auto_Pos", "23.8", "27.9", None, "Positive"],
    ["C03", "Unkn", "Auto_Pos", "24.5", "28.2", None, "Positive"],
    ["C04", "Unkn", "Auto_Pos", "36.1", "28.1", None, "Positive"],
    ["D01", "Unkn", "Auto_Neg", None, "28.3", None, "Negative"],
    ["D02", "Unkn", "Auto_Neg", None, "27.7", None, "Negative"],
    ["D03", "Unkn", "Auto_Neg", None, "28.0", None, "Negative"],
    ["D04", "Unkn", "Auto_Neg", None, "37.8", None, "Negative"],
    ["E01", "Pos Ctrl", "Pos Control", "20.1", "28.0", None, "Valid Ctrl"],
    ["E02", "Neg Ctrl", "Neg Control", None, "28.1", None, "Valid Ctrl"],
]
RUN_INFO = [
    ["Run Started", "2026-03-13 09:00:00"],
    ["Assay Name", "TBV_CellQuant_Test"],
    ["Lot Number", "LOT-TEST-001"],
    ["Extraction Lot Number", "EXT-TEST-001"],
    ["Operator", "Test User"],
]


@pytest.fixture(scope="module")
def wells(spark, tmp_path_factory):
    results = dict(enumerate([HEADER, *WELLS]))
    folder = tmp_path_factory.mktemp("exports")
    content = encode([("Results", results), ("Run Information", dict(enumerate(RUN_INFO)))])
    (folder / "test_run_001.xlsx").write_bytes(content)
    return wells_from_sheet_rows(read_workbooks(spark, str(folder))).persist()


@pytest.fixture(scope="module")
def flagged(wells):
    return flags.flag_rows(wells)


def test_wells(wells, rows_of):
    rows = rows_of(wells.orderBy("row_idx"))
    assert len(rows) == 18
    assert {(r["run_id"], r["run_date"], r["assay_name"], r["lot_number"], r["extraction_lot"]) for r in rows} == {
        ("test_run_001", "2026-03-13 09:00:00", "TBV_CellQuant_Test", "LOT-TEST-001", "EXT-TEST-001")
    }
    assert [r["replicate"] for r in rows] == [1, 2, 3, 4] * 4 + [1, 1]
    assert [r["sample_type"] for r in rows[-2:]] == ["Pos_Control", "Neg_Control"]
    assert [r["is_control"] for r in rows] == [False] * 16 + [True] * 2


def test_sample_type_stats(wells):
    rows = [tuple(r) for r in stats.sample_type_stats(wells).collect()]
    assert rows == [
        ("Auto_Neg", 4, 0, 4, 0, None, None, None, None, 30.45, 4.906, 0.0),
        ("Auto_Pos", 4, 4, 0, 4, 27.15, 5.974, 23.8, 36.1, 28.05, 0.129, 100.0),
        ("Manual_Neg", 4, 0, 4, 0, None, None, None, None, 28.125, 0.25, 0.0),
        ("Manual_Pos", 4, 4, 0, 4, 22.95, 0.387, 22.5, 23.4, 28.075, 0.171, 100.0),
    ]


def test_flags(flagged):
    rows = [tuple(r) for r in flags.qc_flags(flagged.orderBy(*flags.flag_order())).collect()]
    assert rows == [
        ("test_run_001", "C04", "Auto_Pos", "Borderline: Target Cq > 35"),
        (
            "test_run_001",
            "D04",
            "Auto_Neg",
            "IC extraction failure: I.C. Cq=37.80 (plate mean=28.68, SD=2.44)",
        ),
    ]


def test_annotated(wells, flagged):
    rows = flags.annotate_wells(wells, flagged).collect()
    assert len(rows) == 18
    assert sorted(r.well for r in rows if r.qc_flag) == ["C04", "D04"]


def test_control_stats(wells):
    assert [tuple(r) for r in stats.control_stats(wells).collect()] == [
        ("Neg Ctrl", 1, 1, None, None, 28.1, None),
        ("Pos Ctrl", 1, 1, 20.1, None, 28.0, None),
    ]


def test_runs(wells):
    types = ["Auto_Neg", "Auto_Pos", "Manual_Neg", "Manual_Pos"]
    assert runs.left_out(wells, types).count() == 0
    row = runs.run_comparison(wells, types).collect()
    assert [tuple(r) for r in row] == [("test_run_001", 0, 4, 0, 4, 4, 4, 4, 4)]
    assert runs.interrun_cv(wells).count() == 0
    assert runs.run_positivity_matrix(wells, types).count() == 0


def test_key_metrics(wells, flagged, rows_of):
    assert rows_of(stats.key_metrics(wells, flagged)) == [
        {
            "n_runs": 1, "n_samples": 16, "n_positive": 8, "n_sample_types": 4,
            "positivity_rate_pct": 50.0, "n_flags": 2,
        }
    ]

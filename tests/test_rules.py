"""One case per rule for absent values, numbers and rounding, and per known oddity."""

import math

import pytest
from pyspark.sql import functions as F

from platewise.functions import plate, text
from platewise.operators import boxes, feeds, flags, plates, runs, stats
from platewise.operators import wells as wells_ops


@pytest.fixture(scope="module")
def values(spark):
    """Values of a text expression for each input."""

    def apply(function, inputs, kind="string"):
        df = spark.createDataFrame([(i, v) for i, v in enumerate(inputs)], f"i int, v {kind}")
        rows = df.select("i", function(F.col("v")).alias("out")).orderBy("i").collect()
        return [r.out for r in rows]

    return apply


def test_nan_becomes_null_and_is_not_borderline(spark, values):
    assert values(text.nan_to_null, [math.nan, 1.5, None], "double") == [None, 1.5, None]
    raw = spark.createDataFrame([("r", 0, math.nan, "nan", None)], "run_id string, row_idx int, target_cq double, ic_cq string, sq string")
    row = wells_ops.coerce_numbers(raw).collect()[0]
    assert (row.target_cq, row.ic_cq, row.sq) == (None, None, None)


def test_numbers(values):
    inputs = ["20.5", " 7 ", "N/A", "abc", "1.0d", "1e2", "", None, ".5", "-3", "1_0", "0x1"]
    assert values(text.to_number, inputs) == [20.5, 7.0, None, None, None, 100.0, None, None, 0.5, -3.0, None, None]


def test_missing_result_is_not_positive(make_wells):
    row = stats.sample_type_stats(
        make_wells([{"result": None}, {"result": "Inhibition"}, {"result": " POSITIVE\t"}, {"result": "\xa0positive"}])
    ).collect()[0]
    assert (row.n_positive, row.n_negative) == (2, 2)


def test_strip_takes_all_white_space(values):
    assert values(text.strip, ["\t a b \n", "\xa0x　", "", None]) == ["a b", "x", "", None]


def test_round_half_to_even(values):
    assert values(lambda c: text.round_even(c, 1), [6.25, 6.35, 0.05], "double") == [6.2, 6.4, 0.0]
    assert values(lambda c: text.fixed(c, 2), [0.125, 28.675, 37.8, None], "double") == ["0.12", "28.68", "37.80", None]


def test_rate_is_rounded_half_to_even(make_wells):
    one_of_16 = [{"result": "Positive"}] + [{"result": "Negative"}] * 15
    assert stats.sample_type_stats(make_wells(one_of_16)).collect()[0].positivity_rate_pct == 6.2


def test_sd_of_one_value_is_null(make_wells):
    row = stats.sample_type_stats(make_wells([{"target_cq": 20.0}])).collect()[0]
    assert (row.mean_target_cq, row.sd_target_cq) == (20.0, None)


def test_no_wells_at_all(make_wells):
    empty = make_wells([{}]).filter("false")
    row = stats.key_metrics(empty, flags.flag_rows(empty)).collect()[0]
    assert (row.n_runs, row.n_samples, row.positivity_rate_pct, row.n_flags) == (0, 0, 0.0, 0)
    assert stats.control_stats(empty).count() == 0
    assert runs.interrun_cv(empty).count() == 0


def test_null_keys_are_left_out(make_wells):
    wells = make_wells([{"sample_type": None}, {"run_id": None, "target_cq": 1.0}, {"target_cq": 2.0}])
    assert stats.sample_type_stats(wells).count() == 1
    assert runs.run_comparison_long(wells).count() == 1
    assert runs.interrun_cv(wells).count() == 0


def test_sample_labels(values):
    inputs = ["Lysis  5 ml\tControl", "2.5 ml  lysis", "Manual\xa0\xa0Pos", " ", None, "5mL", "x5. MLy"]
    clean = ["Lysis 5mL Control", "2.5mL lysis", "Manual Pos", "", "", "5mL", "x5.mLy"]
    assert values(text.sample_label_clean, inputs) == clean
    types = ["Lysis_5mL_Control", "2.5mL_lysis", "Manual_Pos", "Unknown", "Unknown", "5mL", "x5.mLy"]
    assert values(lambda c: text.sample_type(text.sample_label_clean(c)), inputs) == types


def test_controls(values):
    assert values(text.is_control, ["Pos Ctrl", " neg ctrl ", "Unkn", None, ""]) == [True, True, False, False, False]


def test_control_types_keep_their_case(make_wells):
    wells = make_wells([{"content": c, "is_control": True} for c in ("Pos Ctrl", "pos ctrl", " Pos Ctrl ")])
    assert [(r.ctrl_type, r.n_controls) for r in stats.control_stats(wells).collect()] == [("Pos Ctrl", 2), ("pos ctrl", 1)]


def ic_wells(*ics, **more):
    return [{"well": f"A{i + 1:02d}", "ic_cq": ic, **more} for i, ic in enumerate(ics)]


@pytest.mark.parametrize(
    ("ics", "n_flags"),
    [
        ([28.0, 28.0, 28.0, 28.0, 60.0], 0),  # five values cannot be over 2 SD off
        ([28.0, 28.0, 28.0, 28.0, 28.0, 60.0], 1),
        ([28.0, 60.0], 0),
        ([28.0] * 8, 0),
        ([None] * 6 + [28.0, 60.0], 0),
    ],
)
def test_ic_outliers(make_wells, ics, n_flags):
    assert flags.ic_outlier_flags(make_wells(ic_wells(*ics))).count() == n_flags


def test_ic_statistics_leave_controls_out(make_wells):
    wells = make_wells(ic_wells(*[28.0] * 5, 60.0) + ic_wells(*[60.0] * 20, is_control=True))
    assert [r.well for r in flags.ic_outlier_flags(wells).collect()] == ["A06"]


def test_borderline_skips_controls_but_detail_does_not(make_wells):
    wells = make_wells([{"target_cq": 35.0}, {"target_cq": 35.1}, {"target_cq": 36.0, "is_control": True}])
    flagged = flags.flag_rows(wells)
    assert [r.row_idx for r in flagged.collect()] == [1]
    detail = stats.run_detail(flags.mark_ic_failures(wells, flagged)).collect()
    assert sorted((r.target_cq, r.cq_status) for r in detail) == [(35.0, None), (35.1, "borderline"), (36.0, "borderline")]


def test_flag_text_of_duplicate_wells(make_wells):
    rows = ic_wells(*[28.0] * 8) + [
        {"well": "B01", "target_cq": 36.0, "ic_cq": 60.0},
        {"well": "B01", "target_cq": 37.0, "ic_cq": 28.0},
        {"well": "B01", "is_control": True},
    ]
    wells = make_wells(rows)
    annotated = flags.annotate_wells(wells, flags.flag_rows(wells)).collect()
    texts = {r.qc_flag for r in annotated if r.well == "B01"}
    borderline = "Borderline: Target Cq > 35"
    assert len(annotated) == 11
    assert texts == {f"{borderline}; {borderline}; IC extraction failure: I.C. Cq=60.00 (plate mean=31.20, SD=10.12)"}
    assert {r.qc_flag for r in annotated if r.well != "B01"} == {""}


def test_flags_without_any(make_wells):
    wells = make_wells([{"target_cq": 20.0}])
    assert [r.qc_flag for r in flags.annotate_wells(wells, flags.flag_rows(wells)).collect()] == [""]


def test_positions(values):
    wells = ["A01", "a04", "H12", "A13", "A00", "I01", "B1x", " C2 ", "A012", "A120", "", None]
    assert values(plate.plate_letter, wells) == ["A", "A", "H", "A", "A", None, "B", "C", "A", "A", None, None]
    assert values(plate.plate_number, wells) == [1, 4, 12, 13, 0, None, 1, 2, 12, 120, None, None]
    on = [True, True, True, False, False, False, True, True, True, False, False, False]
    assert values(plate.on_plate, wells) == on


def test_plate_order(make_wells):
    wells = make_wells([{"well": w} for w in ("junk", "H12", "a02", "A10")])
    ordered = plates.plate_order(wells).orderBy("order_row", "order_col").collect()
    assert [r.well for r in ordered] == ["a02", "A10", "H12", "junk"]


def test_labels(make_wells):
    wells = make_wells(
        [
            {"sample_label": " S1 "},
            {"sample_label": " ", "content": " Unkn "},
            {"sample_label": "nan", "content": None},
            {"sample_label": None, "content": "Pos Ctrl"},
        ]
    )
    assert [r.label for r in feeds.well_labels(wells).orderBy("row_idx").collect()] == ["S1", "Unkn", "", "Pos Ctrl"]


def test_last_row_wins_on_a_plate_place(make_wells):
    wells = make_wells(
        [
            {"well": "A01", "result": "Positive", "sample_label": "first", "target_cq": 21.0},
            {"well": "a1", "result": "odd", "sample_label": "last"},
            {"well": "A13", "result": "Positive", "target_cq": 50.0},
        ]
    )
    grid = plates.plate_result_grid(wells).collect()
    assert [(r.plate_row, r.plate_col, r.result_code, r.label) for r in grid] == [("A", 1, None, "last")]
    cq = plates.plate_cq_grid(wells).collect()
    assert [(r.target_cq, r.label, r.is_positive, r.scale_min, r.scale_max) for r in cq] == [(21.0, "first", True, 20.0, 22.0)]
    layout = plates.plate_layout(wells).orderBy("plate_row").collect()
    assert len(layout) == 8
    assert (layout[0].label_01, layout[0].class_01, layout[0].label_02, layout[7].class_12) == ("last", "empty", "", "empty")
    assert [r.well for r in plates.off_plate_wells(wells).collect()] == ["A13"]


def test_runs_without_cq_have_no_cq_grid(make_wells):
    wells = make_wells([{"run_id": "none", "result": "Positive"}, {"run_id": "off", "well": "A13", "target_cq": 30.0}])
    assert plates.plate_cq_grid(wells).count() == 0
    assert [tuple(r) for r in plates.plate_cq_scale(wells).collect()] == [("off", None, None)]


def test_cq_by_plate_row_takes_any_column(make_wells):
    wells = make_wells([{"well": "b13", "target_cq": 36.0}, {"well": "x", "target_cq": 20.0}])
    rows = feeds.cq_by_plate_row(flags.annotate_wells(wells, flags.flag_rows(wells))).collect()
    assert [(r.plate_row, r.x_pos, r.borderline) for r in rows] == [("B", round(1 + 6.5 / 12 * 0.76, 9), True)]


def test_scatter_keeps_the_case_of_results(make_wells):
    wells = make_wells([{"result": r, "target_cq": 20.0, "ic_cq": 28.0} for r in (" Positive ", "positive", "Unknown", None)])
    assert sorted(r.result for r in feeds.cq_scatter(wells).collect()) == ["Positive", "Unknown"]


def test_positivity_matrix_counts_runs_of_controls(make_wells):
    rows = [{"run_id": "a", "result": "Positive"}, {"run_id": "b", "is_control": True}]
    assert [tuple(r) for r in runs.run_positivity_matrix(make_wells(rows), ["X", "Y"]).collect()] == [("a", 100.0, None)]
    assert runs.run_positivity_matrix(make_wells(rows[:1]), ["X"]).count() == 0


def test_run_comparison_leaves_absent_pairs_null(make_wells):
    wells = make_wells([{"run_id": "a"}, {"run_id": "b", "sample_type": "Y", "result": "positive"}])
    rows = runs.run_comparison(wells, ["X", "Y"]).orderBy("run_id").collect()
    assert [tuple(r) for r in rows] == [("a", 0, None, 1, None), ("b", None, 1, None, 1)]


def test_interrun_cv_needs_two_runs_with_a_mean(make_wells):
    wells = make_wells(
        [
            {"run_id": "a", "target_cq": 20.0}, {"run_id": "a", "target_cq": 22.0}, {"run_id": "b", "target_cq": 31.0},
            {"run_id": "a", "sample_type": "Y", "target_cq": 20.0}, {"run_id": "b", "sample_type": "Y"},
        ]
    )
    assert [tuple(r) for r in runs.interrun_cv(wells).collect()] == [("X", 2, 26.0, 7.071, 27.2)]
    bar = runs.interrun_cv_bar(runs.interrun_cv(wells)).collect()[0]
    assert (bar.bar_label, bar.limit_pct, bar.above_limit) == ("27.2%", 20.0, True)


def test_box_needs_two_values(make_wells):
    rows = [tuple(r) for r in boxes.cq_box_stats(make_wells([{"target_cq": 20.0}])).collect()]
    assert rows == [("X", 1, None, None, None, None, None)]


def test_stats_texts(make_wells):
    summary = stats.sample_type_stats(make_wells([{"result": "Positive", "target_cq": 20.0}, {}]))
    assert tuple(stats.stats_text(summary).collect()[0]) == ("X", "1/2", "50.0%", "20.000", "—")
    assert feeds.positivity_bar(summary).collect()[0].bar_label == "1/2\n(50.0%)"
    assert stats.stats_display(summary).columns[-2:] == ["Mean I.C. Cq", "SD I.C. Cq"]


def test_null_keys_are_numbered_over_blocks(spark):
    from platewise.functions.numbering import running_number

    rows = [(None, i) for i in range(10)] + [("a", i) for i in range(6)]
    numbered = running_number(spark.createDataFrame(rows, "k string, o int"), ["k"], "o", "n", block_rows=4)
    assert all(r.n == r.o + 1 for r in numbered.collect()) and numbered.count() == 16

"""The command line steps, one after the other, on files."""

import os
import csv

import pytest

from platewise.__main__ import main
from platewise.sources import publishing, tables
from platewise.sources.publishing import published
from checks.xlsx_encode import encode

HEADER = ["Well", "Content", "Sample", "Cq", "I.C. Cq", "SQ", "Result"]


@pytest.fixture(scope="module")
def exports(tmp_path_factory):
    folder = tmp_path_factory.mktemp("exports")
    for n in (1, 2):
        data = [["A01", "Unkn", "S 1", f"2{n}", "28.5", None, "Positive"], ["A02", "Pos Ctrl", "C", "20", "28", None, "Valid Ctrl"]]
        content = encode([("R", dict(enumerate([HEADER, *data]))), ("I", {0: ["Lot Number", "007x"]})])
        (folder / f"run {n}.xlsx").write_bytes(content)
    return folder


def test_steps(spark, exports, tmp_path):
    out = str(tmp_path / "out")
    assert main(["check", str(exports), f"{out}/check"]) == 0
    assert main(["parse", str(exports), f"{out}/parsed"]) == 0
    wells = published(spark, f"{out}/parsed", "wells")
    assert sorted({r.run_id for r in wells.collect()}) == ["run 1", "run 2"]
    for step in ("analyze", "charts", "report"):
        assert main([step, f"{out}/parsed", f"{out}/tables", "--format", "csv"]) == 0
    cv = published(spark, f"{out}/tables", "interrun_cv", header=True).collect()
    assert [tuple(r) for r in cv] == [("S_1", "2", "21.5", "0.707", "3.3")]
    assert published(spark, f"{out}/tables", "plate_layout", header=True).count() == 16
    assert published(spark, f"{out}/tables", "plate_accounting", header=True).filter("balanced = 'true'").count() == 2
    names = set(publishing.current(spark, f"{out}/tables").tables)
    assert {"off_plate_wells", "plate_cq_scale", "dimension_lists", "flag_rows", "run_detail"} <= names


def test_small_tables_as_files_and_wide_comparison(spark, exports, tmp_path):
    out = str(tmp_path / "out")
    assert main(["parse", str(exports), f"{out}/parsed"]) == 0
    arguments = ["--format", "csv-files", "--types", "S_1", "other"]
    assert main(["analyze", f"{out}/parsed", f"{out}/tables", *arguments]) == 0
    path, _ = publishing.table_path(spark, f"{out}/tables", "summary_statistics")
    with open(path) as f:
        rows = list(csv.DictReader(f))
    assert path.endswith("/summary_statistics.csv") and [r["sample_type"] for r in rows] == ["S_1"]
    wide = published(spark, f"{out}/tables", "run_comparison_wide", header=True)
    assert wide.count() == 2 and any("S_1" in c for c in wide.columns)
    assert published(spark, f"{out}/tables", "run_comparison_left_out", header=True).count() == 0


def test_check_fails_on_issues(spark, exports, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "bad.xlsx").write_bytes(b"junk")
    assert main(["check", str(tmp_path / "in"), str(tmp_path / "out")]) == 1


def test_optional_tables_are_left_out(spark, make_wells, tmp_path):
    from platewise.plans import jobs

    written = jobs.write_outputs(spark, make_wells([{"target_cq": 20.0}]), str(tmp_path))
    assert written == ["all_runs_combined", "qc_flags", "run_comparison", "summary_statistics"]


def test_csv_keeps_texts(spark, make_wells, tmp_path):
    label = ' a "b", \\ c\nd '
    tables.write_wells(make_wells([{"sample_label": label, "lot_number": "001"}]), str(tmp_path / "w"), "csv")
    row = tables.load_wells(spark, str(tmp_path / "w"), "csv").collect()[0]
    assert (row.sample_label, row.lot_number, row.run_date) == (label, "001", "")


def test_parsed_files_join_up_by_column_name(spark, tmp_path):
    with open(tmp_path / "a_parsed.csv", "w", newline="") as f:
        csv.writer(f).writerows(
            [["run_id", "well", "target_cq", "lot_number", "is_control", "replicate", "sample_label"],
             ["a", "A01", "20.5", "001", "True", "1", "x\ny"], ["a", "A02", "junk", "001", "False", "2", ""]]
        )
    with open(tmp_path / "b_parsed.csv", "w", newline="") as f:
        csv.writer(f).writerows([["well", "run_id", "is_control"], ["B01", "b", "False"]])
    (tmp_path / "other.csv").write_text("x\n1\n")
    rows = tables.load_parsed_files(spark, str(tmp_path)).orderBy("run_id", "row_idx").collect()
    assert [(r.run_id, r.well, r.target_cq, r.lot_number, r.is_control, r.row_idx) for r in rows] == [
        ("a", "A01", 20.5, "001", True, 0), ("a", "A02", None, "001", False, 1), ("b", "B01", None, "", False, 0),
    ]
    assert [r.sample_label for r in rows] == ["x\ny", None, None]


def test_no_files_is_an_error(spark, tmp_path):
    with pytest.raises(Exception):
        tables.load_wells(spark, str(tmp_path / "nothing")).count()
    with pytest.raises(FileNotFoundError):
        tables.load_parsed_files(spark, str(tmp_path))
    with pytest.raises(FileNotFoundError):
        main(["parse", str(tmp_path), str(tmp_path / "out")])


def test_parse_fails_on_unfit_files(spark, exports, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    for f in exports.iterdir():
        (folder / f.name).write_bytes(f.read_bytes())
    assert main(["parse", str(folder), str(tmp_path / "good")]) == 0
    (folder / "headless.xlsx").write_bytes(encode([("R", {0: ["x"]}), ("I", {})]))
    assert main(["parse", str(folder), str(tmp_path / "bad")]) == 1
    assert published(spark, str(tmp_path / "bad"), "wells").count() == 4


def test_types_of_any_name_and_number(spark, make_wells, tmp_path):
    """Names that differ in case only, and very many types, are rows of the long table."""
    from platewise.operators import runs
    from platewise.plans import jobs

    names = ["Manual_Pos", "manual_pos", "run_id"] + [f"t{i}" for i in range(10_000)]
    wells = make_wells([{"sample_type": n, "run_id": f"r{i % 3}"} for i, n in enumerate(names)])
    jobs.write_outputs(spark, wells, str(tmp_path / "out"))
    jobs.write_chart_tables(spark, wells, str(tmp_path / "out"))
    for table in ("run_comparison", "run_positivity"):
        assert published(spark, str(tmp_path / "out"), table).count() == len(names)
    for clash in (["Manual_Pos", "manual_pos"], ["run_id"], [None]):
        with pytest.raises(ValueError):
            runs.run_comparison(wells, clash)
    assert runs.left_out(wells, names[3:]).count() == 3


def test_tables_of_an_earlier_call_are_not_in_the_set(spark, make_wells, tmp_path):
    from platewise.plans import jobs

    control = {"is_control": True, "content": "Pos Ctrl"}
    assert "control_statistics" in jobs.write_outputs(spark, make_wells([{}, control]), str(tmp_path))
    assert "control_statistics" not in jobs.write_outputs(spark, make_wells([{}]), str(tmp_path))
    with pytest.raises(FileNotFoundError):
        published(spark, str(tmp_path), "control_statistics")


def test_combined_table_is_in_run_order(spark, make_wells, tmp_path):
    from platewise.plans import jobs

    wells = make_wells([{"run_id": f"r{i % 7}", "well": f"A{i:02d}"} for i in range(70)]).repartition(5)
    jobs.write_outputs(spark, wells, str(tmp_path))
    rows = published(spark, str(tmp_path), "all_runs_combined").select("run_id", "row_idx").collect()
    assert [tuple(r) for r in rows] == sorted(tuple(r) for r in rows)


def test_wells_without_a_control_mark(spark, tmp_path):
    (tmp_path / "a_parsed.csv").write_text("run_id,well,content,is_control\na,A01,Unkn,\na,A02,Pos Ctrl,odd\na,A03,,True\n")
    rows = tables.load_parsed_files(spark, str(tmp_path)).orderBy("row_idx").collect()
    assert [r.is_control for r in rows] == [False, True, True]


def test_unreadable_parsed_files_are_named(spark, tmp_path):
    (tmp_path / "bad_parsed.csv").write_bytes(b"run_id,well\na,\xff\xfe\n")
    with pytest.raises(Exception, match="bad_parsed.csv cannot be read"):
        tables.load_parsed_files(spark, str(tmp_path)).collect()


def test_parsed_files_of_any_header(spark, tmp_path):
    """Byte order mark, quoted line breaks and quotes, blank lines, short and long rows, columns
    twice, unknown columns, and very wide headers."""
    wide = ",".join(["well", *[f"x{i}" for i in range(300)], "run_id"])
    files = {
        "a": '﻿run_id,well,sample_label\r\na,A01,"x ""y"",\nz"\r\n\r\na,A02\r\na,A03,l,more\r\n',
        "b": wide + "\n" + ",".join(["B01", *["v"] * 300, "b"]) + "\n",
        "c": "well,run_id,well\nC00,c,C01\n",
        "d": "run_id,well\n",
        "e": "",
    }
    for name, text in files.items():
        (tmp_path / f"{name}_parsed.csv").write_text(text, newline="")
    got = tables.load_parsed_files(spark, str(tmp_path))
    rows = got.select("run_id", "row_idx", "well", "sample_label").orderBy("run_id", "row_idx").collect()
    assert [tuple(r) for r in rows] == [
        ("a", 0, "A01", 'x "y",\nz'), ("a", 1, "A02", None), ("a", 2, "A03", "l"), ("b", 0, "B01", None), ("c", 0, "C01", None),
    ]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "InArrow" not in plan and "Python" not in plan


def test_a_large_parsed_file_keeps_its_order(spark, tmp_path):
    lines = [f'big,A{i % 12 + 1:02d},"{i}\n"' for i in range(20_000)]
    (tmp_path / "big_parsed.csv").write_text("run_id,well,sample_label\n" + "\n".join(lines) + "\n")
    (tmp_path / "small_parsed.csv").write_text("run_id,well\nsmall,A01\n")
    rows = tables.load_parsed_files(spark, str(tmp_path)).filter("run_id = 'big'").select("row_idx", "sample_label").collect()
    assert sorted((r.row_idx, r.sample_label) for r in rows) == [(i, f"{i}\n") for i in range(20_000)]


def test_trial_files_lie_in_two_folders(spark):
    """One file per run, but no folder per run: each folder is a task of the listing."""
    from checks import catalog

    sf = "/root/testdata/sf0.001"
    folder = catalog._parsed_files(spark, sf)
    names = [os.path.join(at, f) for at, _, files in os.walk(folder.removeprefix("file:")) for f in files if f.endswith(".txt")]
    assert len(names) == catalog.full(spark, sf).select("run_id").distinct().count() > 4
    assert len({os.path.dirname(f) for f in names}) == 2

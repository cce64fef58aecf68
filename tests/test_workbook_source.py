"""Exports read by ranges against exports read as a whole."""

import os
import tracemalloc

import pytest

from checks.xlsx_encode import encode
from platewise.operators.wells import wells_from_sheet_rows
from platewise.sources import workbook_source, workbooks, xlsx_decode

HEADER = ["Well", "Content", "Sample", "Cq", "I.C. Cq", "SQ", "Result"]
WELL = ["A01", "Unkn", "S", "20.5", "28", None, "Positive"]


def book(n=1, labels=10**9, **how):
    rows = [[f"A{i % 12 + 1:02d}", *WELL[1:2], f"label {i % labels}", *WELL[3:]] for i in range(n)]
    return encode([("R", dict(enumerate([HEADER, *rows]))), ("I", {0: ["Run Started", "today"]})], **how)


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("exports")
    (root / "sub dir").mkdir()
    (root / "_hidden").mkdir()
    files = {
        "a.xlsx": book(3), "B.XLSX": book(2, shared=True), "sub dir/a.xlsx": book(4, odd_names=True), "broken.xlsx": b"junk",
        "empty.xlsx": b"", "cut.xlsx": book(5)[:300], "_hidden/no.xlsx": book(), ".no.xlsx": book(), "other.txt": b"x",
    }
    for name, content in files.items():
        (root / name).write_bytes(content)
    return str(root)


def texts(df):
    return sorted(map(str, df.collect()))


def test_ranges_equal_whole(spark, folder):
    whole = workbooks.read_workbooks(spark, folder, "whole")
    by_ranges = workbooks.read_workbooks(spark, folder, "ranges")
    assert by_ranges.columns == whole.columns
    # Spark leaves out files of no bytes, which are unfit as well.
    told = by_ranges.filter("run_id = 'empty'").collect()
    assert len(told) == 1 and told[0].error
    assert texts(by_ranges.filter("run_id <> 'empty'")) == texts(whole)
    assert texts(workbooks.cells(by_ranges)) == texts(workbooks.cells(whole))
    wells = wells_from_sheet_rows(workbooks.read_workbooks(spark, folder))
    assert sorted({r.run_id for r in wells.collect()}) == ["B", "a", "sub dir/a"]
    issues = workbooks.structure_issues(workbooks.structure_facts(by_ranges)).collect()
    assert sorted((r.run_id, r.severity) for r in issues) == [(n, "CRITICAL") for n in ("broken", "cut", "empty")]


def test_paths_choose_the_reader(spark, folder):
    def plan(df):
        return df._jdf.queryExecution().analyzed().toString()

    assert "plate_workbooks" in plan(workbooks.read_workbooks(spark, folder))
    assert "plate_workbooks" not in plan(workbooks.read_workbooks(spark, folder + "/*.xlsx"))
    starred = workbooks.read_workbooks(spark, folder + "/*.xlsx")
    assert sorted({r.run_id for r in starred.select("run_id").collect()}) == ["a", "broken", "cut"]
    with pytest.raises(ValueError):
        workbooks.read_workbooks(spark, folder, "other")


def test_partitions_by_size():
    files = [(f"f{i}", size) for i, size in enumerate([100, 5, 7, 3, 250, 60])]
    parts = workbook_source.packed([(n, s << 20) for n, s in files], 64 << 20)
    assert sorted(f for p in parts for f, _ in p) == [f"f{i}" for i in range(6)]
    assert [[f for f, _ in p] for p in parts] == [["f4"], ["f0"], ["f5"], ["f2", "f1", "f3"]]
    assert workbook_source.packed([], 5) == []


def test_an_empty_folder(spark, tmp_path):
    assert workbooks.read_workbooks(spark, str(tmp_path), "ranges").count() == 0


def test_a_file_with_too_many_texts_is_one_critical_row(spark, tmp_path):
    (tmp_path / "big.xlsx").write_bytes(book(5000, shared=True))
    (tmp_path / "small.xlsx").write_bytes(book(5, shared=True))
    workbook_source.register(spark)
    reader = spark.read.format(workbook_source.FORMAT).option("maxStringBytes", 100_000)
    rows = reader.load(workbooks.qualified(spark, str(tmp_path)))
    (told,) = rows.filter("error is not null").collect()
    assert told.path.endswith("big.xlsx") and "texts is larger" in told.error and told.sheet_idx is None
    assert rows.filter("path like '%big.xlsx'").count() == 1
    named = rows.withColumn("run_id", workbooks.run_id_of(rows.path))
    issues = workbooks.structure_issues(workbooks.structure_facts(named)).collect()
    assert [(r.run_id, r.severity) for r in issues] == [("big", "CRITICAL")]


def test_memory_does_not_grow_with_the_file(tmp_path):
    """Ten times the rows: the file is never held, nor are its rows."""
    peaks = []
    for n in (10_000, 50_000):
        path = tmp_path / f"{n}.xlsx"
        path.write_bytes(book(n, labels=50))
        tracemalloc.start()
        with open(path, "rb") as file:
            seen = sum(b.num_rows for b in xlsx_decode.in_batches(xlsx_decode.sheet_rows("x", file)))
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
        assert seen == n + 1 + 1 + 2
    assert os.path.getsize(path) > 300_000
    assert peaks[1] < 1.2 * peaks[0]

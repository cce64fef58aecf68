"""Runs that come in batches against the same runs at once."""

import pytest

from checks.xlsx_encode import encode
from platewise.operators import flags, runs, stats
from platewise.streaming import incremental

HEADER = ["Well", "Content", "Sample", "Cq", "I.C. Cq", "SQ", "Result"]


def rows(df):
    return sorted(map(str, df.collect()))


def same_as_at_once(spark, out, wells):
    assert rows(incremental.wells(spark, out)) == rows(wells)
    for ours, whole in (
        (incremental.sample_type_stats, stats.sample_type_stats(wells)),
        (incremental.control_stats, stats.control_stats(wells)),
        (incremental.interrun_cv, runs.interrun_cv(wells)),
        (incremental.run_comparison, runs.run_comparison_long(wells)),
        (incremental.flag_rows, flags.flag_rows(wells)),
    ):
        got = ours(spark, out)
        assert got.columns == whole.columns
        assert rows(got) == rows(whole)


@pytest.fixture
def wells(make_wells):
    made = []
    for i in range(60):
        kind = {"is_control": True, "content": "Pos Ctrl", "result": "Valid Ctrl"} if i % 11 == 0 else {"result": "Positive"}
        cq = None if i % 7 == 0 else 20.0 + (i * 37 % 190) / 10
        made.append({"run_id": f"r{i % 5}", "target_cq": cq, "ic_cq": 28.0 + (9 if i == 8 else i % 3), "sample_type": "ab"[i % 2], **kind})
    return make_wells(made)


def test_batches_in_any_cut(spark, wells, tmp_path):
    for cut, parts in enumerate((["r0", "r1 r2 r3 r4"], ["r3 r4", "r0 r1", "r2"], ["r0 r1 r2 r3 r4"], ["r0 r1 r2 r3 r4", ""])):
        out = str(tmp_path / str(cut))
        for batch, part in enumerate(parts):
            incremental.add_batch(wells.filter(wells.run_id.isin(part.split())), out, batch)
        same_as_at_once(spark, out, wells)


def test_a_repeated_batch_changes_nothing(spark, wells, tmp_path):
    out = str(tmp_path)
    first, second = wells.filter("run_id < 'r2'"), wells.filter("run_id >= 'r2'")
    for df, batch in ((first, 0), (second, 1), (second, 1), (first, 0)):
        incremental.add_batch(df, out, batch)
    same_as_at_once(spark, out, wells)


def test_an_unfinished_batch_is_not_seen(spark, wells, tmp_path, monkeypatch):
    out = str(tmp_path)
    first, second = wells.filter("run_id < 'r2'"), wells.filter("run_id >= 'r2'")
    incremental.add_batch(first, out, 0)

    def dying(df):
        raise OSError("lost")

    with monkeypatch.context() as m:
        m.setattr(incremental, "partial_stats", dying)
        with pytest.raises(OSError):
            incremental.add_batch(second, out, 1)
    same_as_at_once(spark, out, first)
    incremental.add_batch(second, out, 1)
    same_as_at_once(spark, out, wells)


def test_a_run_comes_once(spark, wells, tmp_path):
    out = str(tmp_path)
    incremental.add_batch(wells.filter("run_id < 'r2'"), out, 0)
    with pytest.raises(incremental.RunsSeenBefore, match="r1"):
        incremental.add_batch(wells.filter("run_id >= 'r1'"), out, 1)
    same_as_at_once(spark, out, wells.filter("run_id < 'r2'"))


def test_nothing_yet(spark, tmp_path):
    assert incremental.sample_type_stats(spark, str(tmp_path)).count() == 0
    assert incremental.wells(spark, str(tmp_path)).count() == 0


def test_files_that_arrive(spark, tmp_path):
    """Two arrivals, several batches each, equal all files at once; a third call finds nothing new."""
    from platewise.operators.wells import wells_from_sheet_rows
    from platewise.sources.workbooks import read_workbooks

    exports, out = tmp_path / "in", str(tmp_path / "out")
    exports.mkdir()

    def arrive(numbers):
        for n in numbers:
            data = [[f"A{i + 1:02d}", "Unkn", "S 1", f"2{n}.{i}", f"28.{n}", None, "Positive"] for i in range(4)]
            data.append(["H01", "Pos Ctrl", "C", "20", "28", None, "Valid Ctrl"])
            (exports / f"run {n}.xlsx").write_bytes(encode([("R", dict(enumerate([HEADER, *data]))), ("I", {0: ["Lot Number", "7"]})]))

    for numbers in (range(3), range(3, 5), []):
        arrive(numbers)
        incremental.follow(spark, str(exports), out, max_files=2).awaitTermination()
    (exports / "bad.xlsx").write_bytes(b"junk")
    incremental.follow(spark, str(exports), out, max_files=2).awaitTermination()
    same_as_at_once(spark, out, wells_from_sheet_rows(read_workbooks(spark, str(exports))))
    assert incremental.wells(spark, out).count() == 25
    assert spark.read.parquet(f"{out}/issues").select("severity").distinct().collect()[0][0] == "CRITICAL"

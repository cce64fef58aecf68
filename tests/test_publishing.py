"""Sets of tables that appear as a whole, and the order of the wells in their files."""

import pytest

from platewise.plans import jobs
from platewise.sources import publishing, tables
from platewise.sources.publishing import Publication, published


def plates(make_wells, n, cq=20.0):
    return make_wells([{"run_id": f"r{i % 2}", "well": f"A{i + 1:02d}", "target_cq": cq} for i in range(n)])


def n_wells(spark, out, name):
    return published(spark, out, name).agg({"n_wells": "sum"}).first()[0]


def test_a_job_that_dies_midway_changes_nothing(spark, make_wells, tmp_path, monkeypatch):
    """Whatever table it dies at, readers keep one consistent set."""
    out = str(tmp_path)
    names = jobs.write_outputs(spark, plates(make_wells, 4), out)
    jobs.write_chart_tables(spark, plates(make_wells, 4), out)
    before = publishing.current(spark, out)
    whole = jobs.write_table
    for last in range(1, len(names) + 1):
        left = [last]

        def dying(df, folder, fmt="parquet"):
            if not left[0]:
                raise OSError("lost")
            left[0] -= 1
            whole(df, folder, fmt)

        monkeypatch.setattr(jobs, "write_table", dying)
        with pytest.raises(OSError):
            jobs.write_outputs(spark, plates(make_wells, 6, 36.0), out)
        assert publishing.current(spark, out) == before
    monkeypatch.setattr(jobs, "write_table", whole)
    assert published(spark, out, "all_runs_combined").count() == n_wells(spark, out, "run_comparison") == 4
    assert published(spark, out, "flag_rows").count() == 0
    jobs.write_outputs(spark, plates(make_wells, 6, 36.0), out)
    assert published(spark, out, "all_runs_combined").count() == n_wells(spark, out, "run_comparison") == 6
    assert published(spark, out, "flag_rows").count() == 6


def test_an_analysis_starts_a_set_that_charts_and_report_add_to(spark, make_wells, tmp_path):
    out = str(tmp_path)
    jobs.write_outputs(spark, plates(make_wells, 4), out)
    jobs.write_chart_tables(spark, plates(make_wells, 4), out)
    jobs.write_report_tables(spark, plates(make_wells, 4), out)
    now = publishing.current(spark, out)
    assert (now.number, now.based_on) == (3, 2)
    assert {"summary_statistics", "cq_scatter", "run_detail"} <= set(now.tables)
    jobs.write_outputs(spark, plates(make_wells, 6), out)
    now = publishing.current(spark, out)
    assert (now.number, now.based_on) == (4, None) and "cq_scatter" not in now.tables


def test_conflicts(spark, tmp_path):
    out = str(tmp_path)
    one = spark.range(1)
    first, second = Publication(spark, out), Publication(spark, out)
    for job in (first, second):
        tables.write_table(one, job.path("a"))
    assert (first.publish().number, second.publish().number) == (1, 2)
    adding, late = Publication(spark, out, take_over=True), Publication(spark, out, take_over=True)
    for job in (adding, late):
        tables.write_table(one, job.path("b"))
    assert adding.publish().number == 3
    with pytest.raises(publishing.Conflict):
        late.publish()
    assert publishing.current(spark, out).tables["b"] == adding.tables["b"]
    assert not [p for p in (tmp_path / "manifests").iterdir() if p.name.startswith("_")]


def test_expire(spark, tmp_path):
    out = str(tmp_path)
    assert publishing.expire(spark, out) == []
    dead = Publication(spark, out)
    tables.write_table(spark.range(1), dead.path("a"))
    for n in range(1, 4):
        job = Publication(spark, out)
        tables.write_table(spark.range(n), job.path("a"))
        job.publish()
    kept = Publication(spark, out, take_over=True)
    tables.write_table(spark.range(9), kept.path("b"))
    kept.publish()
    removed = publishing.expire(spark, out, keep=1)
    assert len(removed) == 3 and dead.version.split("/")[1] in removed
    assert published(spark, out, "a").count() == 3 and published(spark, out, "b").count() == 9
    with pytest.raises(ValueError):
        publishing.expire(spark, out, keep=0)


def test_nothing_published(spark, tmp_path):
    assert publishing.current(spark, str(tmp_path)) is None
    with pytest.raises(FileNotFoundError):
        published(spark, str(tmp_path), "wells")
    with pytest.raises(FileNotFoundError):
        jobs.write_report_tables(spark, spark.range(1), str(tmp_path))


# The order of the wells


@pytest.fixture
def many(make_wells):
    """40 small runs and one that has more than half of all wells, dealt at random."""
    small = [{"run_id": f"r{i:03d}", "row_idx": j} for i in range(40) for j in range(20)]
    hot = [{"run_id": "r020x", "row_idx": j} for j in range(1200)]
    return make_wells([*small, *hot, {"run_id": None, "row_idx": 1}]).repartition(7)


@pytest.fixture
def fine(spark):
    """Files that stay apart however small."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def files(df):
    return {r[0] for r in df.select("_metadata.file_path").distinct().collect()}


def test_a_run_is_read_from_its_files_only(spark, many, fine, tmp_path):
    folder = str(tmp_path / "wells")
    tables.write_wells(many, folder)
    whole = tables.load_wells(spark, folder)
    assert sorted(map(str, whole.collect())) == sorted(map(str, many.collect()))
    assert len(files(whole)) == 4
    for run, least, most in (("r001", 1, 2), ("r039", 1, 2), ("r020x", 2, 4)):
        some = tables.load_runs(spark, folder, [run])
        assert least <= len(some.inputFiles()) <= most
        assert {r.run_id for r in some.collect()} == {run}
        assert some.count() == whole.filter(whole.run_id == run).count()
    assert tables.load_runs(spark, folder, ["r001", "r002", "nowhere"]).count() == 40
    assert tables.load_runs(spark, folder, ["a", "zz"]).count() == tables.load_runs(spark, folder, []).count() == 0
    # The large run fills at least two files; each of the others but the edges lies in one.
    spans = spark.read.parquet(f"{folder}_files").collect()
    assert sum(r.first_run <= "r020x" <= r.last_run for r in spans) >= 2
    assert sum(r.n_rows for r in spans) == 2001 and sum(r.n_without_run for r in spans) == 1


def test_row_groups_tell_runs_apart(spark, many, fine, tmp_path):
    """Statistics and a Bloom filter on the run, and a filter that reaches the scan."""
    folder = str(tmp_path / "wells")
    tables.write_wells(many.filter("run_id is not null"), folder)
    jvm = spark._jvm
    spans = []
    for path in files(tables.load_wells(spark, folder)):
        file = jvm.org.apache.parquet.hadoop.util.HadoopInputFile.fromPath(
            jvm.org.apache.hadoop.fs.Path(path), spark._jsc.hadoopConfiguration()
        )
        reader = jvm.org.apache.parquet.hadoop.ParquetFileReader.open(file)
        for group in reader.getFooter().getBlocks():
            column = next(c for c in group.getColumns() if c.getPath().toDotString() == "run_id")
            assert column.getBloomFilterOffset() > 0
            stats = column.getStatistics()
            spans.append((stats.minAsString(), stats.maxAsString()))
        reader.close()
    spans.sort()
    assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:]))
    plan = tables.load_runs(spark, folder, ["r001"])._jdf.queryExecution().explainString(
        jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    )
    assert "PushedFilters: [In(run_id, [r001])]" in plan or "EqualTo(run_id,r001)" in plan


def test_an_unfinished_write_leaves_no_stale_spans(spark, many, tmp_path, monkeypatch):
    folder = str(tmp_path / "wells")
    tables.write_wells(many, folder)

    def dying(*args):
        raise OSError("lost")

    monkeypatch.setattr(tables, "file_spans", dying)
    with pytest.raises(OSError):
        tables.write_wells(many.filter("run_id <> 'r001'"), folder)
    assert tables.load_runs(spark, folder, ["r001", "r002"]).count() == 20


def test_wells_are_on_the_plate_or_rejected(spark, make_wells, tmp_path):
    """Rows in grid claims and rejects make up the input; hidden ones are told."""
    from platewise.operators import plates as p

    names = ["A01", "a1", "A13", "H12", "", "X1", "B 02", "A01", None]
    wells = make_wells([{"well": w, "run_id": f"r{i % 2}"} for i, w in enumerate(names * 3)])
    placed = p.split_by_place(wells, str(tmp_path / "split"))
    accounts = {r.run_id: r for r in p.plate_accounting(wells, placed).collect()}
    assert sum(r.n_wells for r in accounts.values()) == 27 and all(r.balanced for r in accounts.values())
    off = p.off_plate_wells(placed)
    assert sum(r.n_off_plate for r in accounts.values()) == off.count() == p.off_plate_wells(wells).count()
    assert sum(r.n_places for r in accounts.values()) == p.last_write_wins(wells).count()
    assert all(r.n_claims == r.n_places + r.n_hidden for r in accounts.values())
    lost = p.plate_accounting(wells, placed.filter("well <> 'A13'")).filter("not balanced")
    assert lost.count() > 0
    scan = off._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(on_plate" in scan or "PartitionFilters: [" in scan and "on_plate" in scan


def test_charts_publish_rejects(spark, make_wells, tmp_path):
    wells = make_wells([{"well": w} for w in ("A01", "A13", "H12", "Q9")])
    jobs.write_outputs(spark, wells, str(tmp_path))
    jobs.write_chart_tables(spark, wells, str(tmp_path))
    assert sorted(r.well for r in published(spark, str(tmp_path), "off_plate_wells").collect()) == ["A13", "Q9"]
    account = published(spark, str(tmp_path), "plate_accounting").collect()
    assert [(r.n_wells, r.n_claims, r.n_off_plate) for r in account] == [(4, 2, 2)]

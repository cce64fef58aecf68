"""What the physical plans must look like to hold at scale."""

import re

import pytest
from pyspark.sql import functions as F

from platewise.operators import boxes, flags, plates, runs, stats, wells as wells_ops
from checks import catalog
from platewise.sources import tables, workbooks

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("wells"))
    tables.write_wells(catalog.full(spark, SF_DIR), folder + "/w")
    return tables.load_wells(spark, folder + "/w")


@pytest.fixture()
def unhinted(spark):
    """No side small enough to broadcast, as with large tables."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def shuffles(df):
    return re.findall(r"Exchange hashpartitioning\(([^)]*?), \d+\)", re.sub(r"#\d+L?", "", plan(df)))


OPERATORS = {
    "sample_type_stats": stats.sample_type_stats,
    "key_metrics": lambda w: stats.key_metrics(w, flags.flag_rows(w)),
    "annotated": lambda w: flags.annotate_wells(w, flags.flag_rows(w)),
    "run_detail": lambda w: stats.run_detail(flags.mark_ic_failures(w, flags.flag_rows(w))),
    "positivity": lambda w: runs.run_positivity_matrix(w, catalog.SAMPLE_TYPES),
    "layout": plates.plate_layout,
    "boxes": boxes.cq_box_stats,
    "replicates": lambda w: wells_ops.replicate_numbers(w.drop("replicate")),
}


@pytest.mark.parametrize("name", list(OPERATORS))
def test_no_cross_joins_and_no_python(stored, unhinted, name):
    text = plan(OPERATORS[name](stored))
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "Python", "BroadcastHashJoin"):
        assert bad not in text


def test_one_shuffle_per_aggregate(stored):
    assert shuffles(stats.sample_type_stats(stored)) == ["sample_type"]
    assert shuffles(runs.run_comparison(stored, catalog.SAMPLE_TYPES)) == ["run_id"]
    assert shuffles(plates.plate_result_grid(stored)) == ["run_id, plate_row, plate_col"]


def test_workbooks_need_one_shuffle_by_file(spark, tmp_path):
    catalog.laid_out(spark, SF_DIR).write.parquet(str(tmp_path / "rows"))
    sheet_rows = spark.read.parquet(str(tmp_path / "rows"))
    assert shuffles(wells_ops.wells_from_sheet_rows(sheet_rows)) == ["path"]
    assert shuffles(workbooks.structure_facts(sheet_rows)) == ["path"]


def test_the_structure_check_reads_sheet_rows_once(spark, unhinted, tmp_path):
    catalog.laid_out(spark, SF_DIR).write.parquet(str(tmp_path / "rows"))
    facts = workbooks.structure_facts(spark.read.parquet(str(tmp_path / "rows")))
    for df in (workbooks.structure_issues(facts), workbooks.structure_report(facts)):
        assert plan(df).count("FileScan") == 1


def test_flags_read_the_wells_twice(stored, unhinted):
    assert plan(flags.flag_rows(stored)).count("FileScan") == 2


def test_windows_never_span_a_run_of_wells(stored):
    for operator in (flags.ic_outlier_flags, boxes.cq_box_stats, plates.plate_layout):
        assert not re.search(r"Window .*\[run_id#\d+\]", plan(operator(stored)))


def test_filters_and_columns_reach_the_scan(stored):
    text = plan(flags.borderline_flags(stored))
    assert "GreaterThan(target_cq,35.0)" in text and "Not(EqualTo(is_control,true))" in text
    schema = re.search(r"ReadSchema: struct<(.*?)>", plan(stats.grand_band(stored))).group(1)
    assert sorted(c.split(":")[0] for c in schema.split(",")) == ["is_control", "target_cq"]


def test_unused_replicates_cost_nothing(spark):
    df = stats.sample_type_stats(catalog.clean(spark, SF_DIR))
    assert len(shuffles(df)) == 1


def test_box_statistics_count_values_once(stored, unhinted):
    df = boxes.cq_box_stats(stored)
    df.collect()
    text = df._jdf.queryExecution().executedPlan().toString()
    final = text.split("== Initial Plan ==")[0]
    assert final.count("FileScan") == 1


def test_a_hot_run_is_split_at_run_time(spark, unhinted, tmp_path):
    """A run with a third of all wells does not end up in one task of the join."""
    hot = F.col("id") % 3 == 0
    folder = str(tmp_path / "w")
    spark.range(0, 60000, 1, 8).select(
        F.when(hot, "hot").otherwise(F.concat(F.lit("run_"), (F.col("id") % 600).cast("string"))).alias("run_id"),
        F.concat(F.lit("A"), F.col("id").cast("string")).alias("well"),
        F.lit("X").alias("sample_type"),
        (28 + F.randn(2)).alias("ic_cq"),
        F.lit(False).alias("is_control"),
        F.col("id").cast("int").alias("row_idx"),
    ).write.parquet(folder)
    small = {
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "50k",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "50k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.shuffle.partitions": "16",
    }
    before = {key: spark.conf.get(key) for key in small}
    for key, value in small.items():
        spark.conf.set(key, value)
    try:
        for operator in (
            flags.ic_outlier_flags,
            lambda w: flags.flag_texts(flags.flag_rows(w.withColumn("target_cq", F.lit(36.0)))),
        ):
            df = operator(spark.read.parquet(folder))
            df.collect()
            assert "SortMergeJoin(skew=true)" in plan(df).split("== Initial Plan ==")[0]
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)

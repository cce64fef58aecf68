"""Results on random and on lopsided data against plain Python."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from platewise.functions.numbering import running_number
from platewise.operators import boxes, flags, plates, runs, stats, wells as wells_ops

RESULTS = ["Positive", " positive ", "Negative", "Inhibition", "Valid Ctrl", None]


@pytest.fixture(scope="module")
def rows():
    """A third of all wells belongs to one run, half of those to one sample type."""
    rng = random.Random(7)
    made = []
    for i in range(3000):
        hot = i % 3 == 0
        run = "hot" if hot else f"run_{rng.randrange(30):02d}"
        made.append(
            {
                "run_id": run,
                "row_idx": i,
                "well": rng.choice("ABCDEFGHI") + f"{rng.randrange(1, 14):02d}",
                "sample_type": "hot" if hot and i % 2 else rng.choice(["P", "Q", "R"]),
                "target_cq": rng.choice([None, rng.uniform(15, 40), round(rng.uniform(15, 40), 1)]),
                "ic_cq": rng.choice([None, rng.gauss(28, 0.4), rng.gauss(28, 3)]),
                "result": rng.choice(RESULTS),
                "is_control": rng.random() < 0.05,
            }
        )
    return made


@pytest.fixture(scope="module")
def wells(make_wells, rows):
    return make_wells(rows).persist()


def samples(rows):
    return [r for r in rows if not r["is_control"]]


@pytest.mark.parametrize("block_rows", [1, 7, 500, 65536])
def test_replicate_numbers(wells, rows, block_rows):
    numbered = running_number(wells.drop("replicate"), ["run_id", "sample_type"], "row_idx", "replicate", block_rows)
    got = {r.row_idx: r.replicate for r in numbered.collect()}
    seen, expected = Counter(), {}
    for r in rows:
        seen[r["run_id"], r["sample_type"]] += 1
        expected[r["row_idx"]] = seen[r["run_id"], r["sample_type"]]
    assert got == expected


def test_ic_outliers(wells, rows):
    by_run = defaultdict(list)
    for r in samples(rows):
        if r["ic_cq"] is not None:
            by_run[r["run_id"]].append(r)
    expected = set()
    for found in by_run.values():
        values = np.array([r["ic_cq"] for r in found])
        if len(values) >= 3 and values.std(ddof=1) > 0:
            far = abs(values - values.mean()) > 2 * values.std(ddof=1)
            expected |= {r["row_idx"] for r, f in zip(found, far) if f}
    assert {r.row_idx for r in flags.ic_outlier_flags(wells).collect()} == expected


def test_annotation_keeps_rows_and_order_of_reasons(wells, rows):
    flagged = flags.flag_rows(wells)
    reasons = defaultdict(list)
    for f in flagged.orderBy(*flags.flag_order()).collect():
        reasons[f.run_id, f.well].append(f.flag_reason)
    got = flags.annotate_wells(wells, flagged).collect()
    assert sorted(r.row_idx for r in got) == list(range(len(rows)))
    assert all(r.qc_flag == "; ".join(reasons[r.run_id, r.well]) for r in got)
    controls = {r["row_idx"] for r in rows if r["is_control"]}
    assert not controls & {f.row_idx for f in flagged.collect()}


def test_box_statistics(wells, rows):
    by_type = defaultdict(list)
    for r in samples(rows):
        if r["target_cq"] is not None:
            by_type[r["sample_type"]].append(r["target_cq"])
    got = {r.sample_type: r for r in boxes.cq_box_stats(wells).collect()}
    assert set(got) == set(by_type)
    for name, values in by_type.items():
        v = np.array(values)
        q1, median, q3 = np.percentile(v, [25, 50, 75])
        low = min(v[v >= q1 - 1.5 * (q3 - q1)].min(), q1)
        high = max(v[v <= q3 + 1.5 * (q3 - q1)].max(), q3)
        row = got[name]
        assert row.n == len(v)
        assert [row.q1, row.median, row.q3, row.whisker_low, row.whisker_high] == pytest.approx(
            [q1, median, q3, low, high], abs=2e-9
        )


def test_counts_add_up(wells, rows):
    summary = stats.sample_type_stats(wells).collect()
    assert all(r.n_positive + r.n_negative == r.n_wells for r in summary)
    total = sum(r.n_wells for r in summary)
    assert total == len(samples(rows))
    assert runs.run_comparison_long(wells).agg(F.sum("n_wells")).collect()[0][0] == total
    assert plates.off_plate_wells(wells).count() + plates.placed_wells(wells).count() == len(rows)


def test_partitioning_does_not_matter(wells):
    shuffled = wells.repartition(13, F.rand(3))
    for table in (
        stats.sample_type_stats,
        runs.interrun_cv,
        stats.grand_band,
        plates.plate_layout,
        plates.plate_cq_grid,
        boxes.cq_box_stats,
        lambda w: flags.annotate_wells(w, flags.flag_rows(w)),
        lambda w: flags.flag_reason_counts(flags.flag_rows(w)),
        lambda w: wells_ops.replicate_numbers(w.drop("replicate")),
    ):
        assert Counter(table(wells).collect()) == Counter(table(shuffled).collect())


def test_sketched_boxes_are_near_the_exact_ones(spark):
    """Rank errors of quartiles and whiskers on lopsided data, for all runs and for some."""
    rows = [(f"r{i % 7}", "T", math.exp(random.Random(i).gauss(3, 0.4)), False, "x") for i in range(20_000)]
    rows += [("r1", "U", 20.0, False, "x")] * 3000 + [("r2", "U", 21.0 + i, False, "x") for i in range(3)] + [("r3", "V", 5.0, False, "x")]
    wells = spark.createDataFrame(rows, "run_id string, sample_type string, target_cq double, is_control boolean, well string")
    for some in (wells, wells.filter("run_id in ('r1', 'r2')")):
        values = {}
        for r in some.collect():
            values.setdefault(r.sample_type, []).append(r.target_cq)
        sketches = boxes.cq_sketches(wells, 400).filter(F.col("run_id").isin([r[0] for r in some.select("run_id").distinct().collect()]))
        exact = {r.sample_type: r for r in boxes.cq_box_stats(some).collect()}
        near = {r.sample_type: r for r in boxes.box_stats_of_sketches(sketches, 400).collect()}
        assert near.keys() == exact.keys()
        for kind, own in values.items():
            assert near[kind].n == exact[kind].n == len(own)
            if len(own) < 2:
                assert near[kind].q1 is None and near[kind].whisker_high is None
                continue
            for name in ("q1", "median", "q3", "whisker_low", "whisker_high"):
                got, true = near[kind][name], exact[kind][name]
                low, high = sorted((got, true))
                between = sum(low < v < high for v in own)
                assert between <= 0.01 * len(own), (kind, name, got, true)
    assert boxes.cq_box_stats(wells, 400).columns == boxes.cq_box_stats(wells).columns

"""Hard negatives against all scores, and trees against all rows."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from platewise.llm import hard_negatives as h


def brute(rows, low=80, n_positives=5, n_negatives=5):
    good = []
    for number, (i, label, v) in enumerate(rows):
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        good.append((i, label, [math.floor(256 * x) for x in v]))
    out = []
    for i, label, v in good:
        if i % 10:
            continue
        scored = sorted((-sum(a * b for a, b in zip(v, w)), j, m) for j, m, w in good)
        positives = [(j, -s) for s, j, m in scored if m == label and j != i][:n_positives]
        for j, s in positives:
            found = [(n, -t) for t, n, m in scored if m != label and low * s <= -100 * t <= 100 * s][:n_negatives]
            out += [(i, j, rank, n, s, t) for rank, (n, t) in enumerate(found, 1)]
    return sorted(out)


def vectors(rng, n, width, copies=0):
    rows = []
    for i in range(n):
        rows.append((i, rng.choice([0, 0, 0, 1, 2]), [rng.gauss(0.1, 0.3) for _ in range(width)]))
    return rows + [(n + i, i % 2, rows[3][2]) for i in range(copies)]


ODD = [
    (None, 1, [0.5] * 6), (900, None, [0.5] * 6), (910, 1, None), (920, 1, [0.5, None] + [0.1] * 4),
    (930, 1, [float("nan")] * 6), (940, 1, [float("inf")] * 6), (950, 0, []), (960, 0, [0.4, 0.4]), (970, 9, [0.3] * 6),
    (30, 0, [0.2] * 6), (31, 1, [0.2] * 6), (31, 1, [0.2] * 6),
]


@pytest.mark.parametrize("block_rows, sample", [(8192, 4096), (40, 64)])
def test_all_scores(spark, monkeypatch, block_rows, sample):
    monkeypatch.setattr(h, "BLOCK_ROWS", block_rows)
    monkeypatch.setattr(h, "SAMPLE_ROWS", sample)
    monkeypatch.setattr(h, "QUERY_ROWS", 16 if sample == 64 else 1 << 16)
    rows = vectors(random.Random(sample), 300, 6, copies=150) + ODD
    table = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, label int, embedding array<double>, rank string")
    got = h.mine(table.repartition(3), F.col("vec_id") % 10 == 0).collect()
    assert sorted(tuple(r) for r in got) == brute(rows)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "vec_id long, label int, embedding array<float>")
    assert h.mine(none, F.lit(True)).count() == 0
    one = spark.createDataFrame([(1, 1, [0.5])], "vec_id long, label int, embedding array<float>")
    assert h.mine(one, F.lit(True)).count() == 0
    assert h.mine(one, F.lit(False)).count() == 0


def test_huge_components(spark):
    rows = [(0, 0, [3e6, 1.0]), (1, 0, [2e6, 3.0]), (2, 1, [2e6, 2.0]), (3, 1, [1.9e6, 2.0]), (4, 1, [2e6, 3.0])]
    table = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    got = h.mine(table, F.col("vec_id") % 10 == 0).collect()
    assert sorted(tuple(r) for r in got) == brute(rows)


def test_subtrees_left_out_hold_nothing(monkeypatch):
    """Every row of a window is found, and on clustered rows most subtrees are left out."""
    monkeypatch.setattr(h, "LEAF_ROWS", 8)
    rng = np.random.default_rng(5)
    centres = rng.normal(0, 200, (20, 8))
    rows = np.rint(centres[rng.integers(0, 20, 3000)] + rng.normal(0, 6, (3000, 8)))
    ids, labels = np.arange(3000), rng.integers(0, 3, 3000)
    tree = h.BlockTree(ids, labels, rows)
    queries = np.rint(centres[:10] + 3)
    scores = (queries @ rows.T).astype(np.int64)
    high = np.sort(scores, axis=1)[:, -40]
    low = np.maximum(np.sort(scores, axis=1)[:, -90], 0)
    leaves = []
    plain = h.Search._leaf
    monkeypatch.setattr(h.Search, "_leaf", lambda self, b, e, some: (leaves.append((e - b) * len(some)), plain(self, b, e, some)))
    asked = {"vec_id": np.full(10, -1), "label": np.full(10, -1), "vector": queries, "low": low, "high": high}
    query, row, score = h.Search(tree, asked, 5, False).found()
    expected = {}
    for q in range(10):
        window = np.flatnonzero((scores[q] >= low[q]) & (scores[q] <= high[q]))
        expected[q] = sorted(window, key=lambda i: (-scores[q][i], i))[:5]
    assert {q: tree.ids[row[query == q]].tolist() for q in range(10)} == {q: list(map(int, e)) for q, e in expected.items()}
    assert sum(leaves) < 0.3 * 10 * 3000

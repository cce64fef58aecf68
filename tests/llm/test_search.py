"""Decontamination against brute force, and the index against plain search."""

import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from platewise.llm import decontamination


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 4), min_size=0, max_size=60), st.integers(1, 5))
def test_index(symbols, sample):
    text = np.array(symbols, np.int64)
    whole = symbols + [0]
    order = sorted(range(len(whole)), key=lambda i: whole[i:])
    assert decontamination.suffix_array(np.append(text, 0)).tolist() == order
    index = decontamination.FMIndex.build(text, sample)
    assert index.locate(np.arange(len(whole))).tolist() == order
    phrases = [(a, b, c) for a in (1, 2, 5) for b in (1, 3) for c in (2, 4)]
    rows = np.array([[x if x in symbols else -1 for x in p] for p in phrases])
    low, high = index.search(rows, np.full(len(rows), 3))
    for p, a, b in zip(phrases, low, high, strict=True):
        found = sorted(index.locate(np.arange(a, b)).tolist())
        assert found == [i for i in range(len(whole)) if tuple(whole[i : i + 3]) == p]


def test_copies_in_a_shard():
    rng = np.random.default_rng(2)
    part = rng.integers(2, 9, 700)
    text = np.concatenate([np.append(part, 1)] * 20 + [np.full(500, 3), np.append(part, 1)])
    order = decontamination.suffix_array(np.append(text, 0))
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    # Neighbours are in order: equal first symbols are followed by suffixes in order.
    whole = np.append(text, 0)
    a, b = order[:-1], order[1:]
    assert (whole[a] <= whole[b]).all()
    same = whole[a] == whole[b]
    assert (rank[a[same] + 1] < rank[b[same] + 1]).all()


@pytest.fixture(scope="module")
def benchmark_rows(texts):
    rng = random.Random(8)
    rows = []
    for item in range(30):
        words = (texts[rng.randrange(40)][1]).split()
        at = rng.randrange(len(words))
        rows.append((item, " ".join(words[at : at + rng.choice([1, 4, 10, 14, 40])])))
    rows += [(90, "nowhere to be found among them all or so we hope"), (91, None), (92, " ., "), (None, rows[0][1])]
    return rows + [(1, rows[2][1]), rows[3], (93, "again " * 12)]


@pytest.mark.parametrize("block_bytes", [1 << 20, 300])
def test_leaks(spark, docs, texts, benchmark_rows, alnum_words, block_bytes, leaks):
    benchmark = spark.createDataFrame(benchmark_rows, "item_id long, text string")
    found = decontamination.find_leaks(docs.drop("items"), benchmark, block_bytes=block_bytes).collect()
    got = Counter()
    for r in found:
        hit = frozenset(k for s in r["removal"] for k in range(s["begin"], s["end"]))
        assert len(hit) == r["n_hit"]
        got[r["doc_id"], r["n_words"], hit, tuple(r["items"])] += 1
    assert got == Counter(leaks(texts, benchmark_rows, alnum_words))


@pytest.mark.parametrize("block_bytes", [1 << 20, 900])
def test_cut_texts(spark, docs, texts, benchmark_rows, alnum_words, block_bytes, leaks):
    benchmark = spark.createDataFrame(benchmark_rows, "item_id long, text string")
    cut = decontamination.find_leaks(docs, benchmark, block_bytes=block_bytes, cut=True)
    want = Counter()
    for (i, t, _), (_, _, hit, _) in zip(texts, leaks(texts, benchmark_rows, alnum_words), strict=True):
        want[i, t is None, tuple(w for k, w in enumerate(alnum_words(t)) if k not in hit)] += 1
        if not hit:
            want["same", t] += 1
    got = Counter()
    for r in cut.collect():
        got[r["doc_id"], r["text"] is None, tuple(alnum_words(r["text"]))] += 1
        if not r["n_hit"]:
            got["same", r["text"]] += 1
    assert got == want


def test_odd_tables(spark, docs, no_docs):
    empty = spark.createDataFrame([], "item_id long, text string")
    assert decontamination.find_leaks(docs, empty).filter("n_hit = 0").count() == docs.count()
    some = spark.createDataFrame([(1, "the of on")], "item_id long, text string")
    assert decontamination.find_leaks(no_docs, some).count() == 0

"""SimHash groups and substring dedup against brute force."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from platewise.llm import simhash, substring_dedup
from platewise.llm.components import smallest_reachable


def test_near_duplicates(docs, texts, ascii_lower, plain_words, fingerprint, groups):
    fps = {}
    for i, t, _ in texts:
        fps.setdefault(i, []).append(fingerprint(plain_words(ascii_lower(t))))
    want_of = groups({i: f for i, f in fps.items() if i is not None}) | {None: None}
    want = Counter((i, f"{f:016x}", want_of[i]) for i, all_f in fps.items() for f in all_f)
    got = Counter(tuple(r) for r in simhash.near_duplicates(docs).collect())
    # Equal ids are one node: the two texts of id 7 have the smallest id of both.
    assert got.keys() - want.keys() <= {x for x in got if x[0] == 7}
    assert {x for x in got if x[0] != 7} == {x for x in want if x[0] != 7}
    assert sum(got.values()) == len(texts)


def test_one_of_each_group_stays(docs, texts, ascii_lower, plain_words, fingerprint, groups):
    """A group is of fingerprints; rows of one id whose texts are far apart are in several."""
    kept = simhash.keep_first(docs)
    assert kept.columns == docs.columns
    rows = [(i, fingerprint(plain_words(ascii_lower(t)))) for i, t, _ in texts if i is not None]
    root = groups({f: [f] for _, f in rows})
    want = Counter()
    for group in set(root.values()):
        want[min(i for i, f in rows if root[f] == group)] += 1
    assert want[7] > 1
    ids = Counter(r["doc_id"] for r in kept.select("doc_id").collect())
    assert ids == want + Counter({None: 2})


def test_no_documents(no_docs):
    assert simhash.near_duplicates(no_docs).count() == 0 and simhash.keep_first(no_docs).count() == 0
    assert substring_dedup.remove_repeats(no_docs).count() == 0


@pytest.mark.parametrize("edges", [[], [(1, 1)], [(i, i + 1) for i in range(40)], [(0, i) for i in range(50)]])
def test_components(spark, edges):
    rng = random.Random(3)
    edges = edges + [(rng.randint(100, 160), rng.randint(100, 160)) for _ in range(30 if len(edges) > 1 else 0)]
    found = smallest_reachable(spark.createDataFrame(edges, "a long, b long"))
    got = {r["node"]: r["root"] for r in found.collect()}
    root = {x: x for e in edges for x in e}
    for _ in root:
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    assert got == {x: r for x, r in root.items() if x != r}


def test_distant_fingerprints_meet(spark):
    """All pairs within four bits have one component, as by comparing all."""
    rng = random.Random(4)
    fps = list({rng.getrandbits(7) << 3 for _ in range(25)} | {rng.getrandbits(64) for _ in range(25)})
    rows = [(f - (1 << 64) if f >> 63 else f, i) for i, f in enumerate(fps)]
    nodes = spark.createDataFrame(rows, "fp long, rep long")
    for bits in (0, 2, 4):
        links = simhash.fingerprint_links(nodes, bits).collect()
        assert all((fps[r["a"]] ^ fps[r["b"]]).bit_count() <= bits for r in links)
        root = list(range(len(fps)))
        want = list(range(len(fps)))
        for _ in fps:
            for r in links:
                root[r["a"]] = root[r["b"]] = min(root[r["a"]], root[r["b"]])
            for a, x in enumerate(fps):
                for b, y in enumerate(fps):
                    if (x ^ y).bit_count() <= bits:
                        want[a] = want[b] = min(want[a], want[b])
        assert root == want
    with pytest.raises(ValueError):
        simhash.fingerprint_links(nodes, 3)


@pytest.mark.parametrize("window,phrase,rows_per_part", [(35, 8, 1000), (35, 8, 7), (12, 5, 10), (6, 6, 1000)])
def test_remove_repeats(docs, texts, plain_words, window, phrase, rows_per_part, removed):
    lists = [plain_words(t) for _, t, _ in texts]
    want = Counter()
    for (i, t, _), w, gone in zip(texts, lists, removed(lists, window), strict=True):
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        want[i, None if t is None else kept, len(w), len(gone)] += 1
    result = substring_dedup.remove_repeats(docs, window, phrase, rows_per_part)
    assert set(docs.columns) <= set(result.columns)
    got = Counter()
    for r in result.collect():
        text = None if r["text"] is None else " ".join(plain_words(r["text"]))
        got[r["doc_id"], text, r["n_words"], r["n_removed"]] += 1
        assert r["n_removed"] == sum(s["end"] - s["begin"] for s in r["removed"])
    assert got == want


def test_untouched_texts_stay_as_they_are(docs):
    result = substring_dedup.remove_repeats(docs.filter("doc_id in (401, 503, 504)"))
    same = result.join(docs.select("doc_id", F.col("text").alias("before")), "doc_id")
    assert same.filter("text = before and n_removed = 0").count() == 3

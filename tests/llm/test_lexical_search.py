"""Ranked search against all scores computed one by one."""

import math
import random
from collections import Counter, defaultdict

import pytest

from platewise.llm import lexical_search
from platewise.llm.lexical_search import build_index, search


def brute(words, texts, items, k):
    docs = [(i, Counter(words(t))) for i, t, *_ in texts]
    docs = [(i, c, sum(c.values())) for i, c in docs if c]
    held = Counter(w for _, c, _ in docs for w in c)
    length = sum(n for *_, n in docs)
    asked = defaultdict(set)
    for i, t in items:
        asked[i].update(words(t))
    out = []
    for item, terms in asked.items():
        scored = []
        for i, c, n in docs:
            m = 50 + (50 * n * len(docs)) // length
            score = sum(
                math.floor(1000 * math.log((2 * len(docs) + 2) / (2 * held[w] + 1))) * (10**9 * c[w] // (1000 * c[w] + 20 * m))
                for w in terms
                if c[w]
            )
            if score > 0:
                scored.append((-score, i is None, i or 0))
        for rank, (score, no_id, i) in enumerate(sorted(scored)[:k], 1):
            out.append((item, rank, None if no_id else i, -score))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def items(texts):
    rng = random.Random(9)
    rows = [(i, " ".join((texts[rng.randrange(40)][1] or "").split()[:12])) for i in range(12)]
    return rows + [(3, "the again word é"), (None, "again"), (None, "the"), (50, None), (51, ""), (52, "nowhere"), (53, "THE the")]


def rows_of(found):
    return sorted((tuple(r) for r in found.collect()), key=str)


@pytest.mark.parametrize("k, shard_bytes, query_bytes", [(50, 1 << 20, 1 << 20), (3, 300, 60)])
def test_all_scores(spark, docs, texts, items, alnum_words, k, shard_bytes, query_bytes):
    asked = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id int, text string, score string")
    index = build_index(docs, shard_bytes)
    assert index.count() >= 3
    assert rows_of(search(index, asked, k, query_bytes)) == brute(alnum_words, texts, items, k)


def test_ties_and_repeated_rows(spark, alnum_words):
    rng = random.Random(1)
    texts = [(rng.randrange(300), " ".join(rng.choice("ab cd ef gh ij kl".split()) for _ in range(rng.choice([2, 3, 5])))) for _ in range(900)]
    texts += [(7, "ab cd")] * 200 + [(None, "ab cd")] * 60
    items = [(i, " ".join(rng.sample("ab cd ef gh ij kl zz".split(), 3))) for i in range(8)]
    index = build_index(spark.createDataFrame(texts, "doc_id long, text string").repartition(4), 900)
    asked = spark.createDataFrame(items, "item_id long, text string")
    assert rows_of(search(index, asked, 20)) == brute(alnum_words, texts, items, 20)


def test_empty_tables(spark, docs, no_docs):
    some = spark.createDataFrame([(1, "the")], "item_id long, text string")
    assert search(build_index(no_docs), some).count() == 0
    assert search(build_index(docs), some.limit(0)).count() == 0
    assert search(build_index(docs.filter("false").unionByName(docs.limit(0))), some.limit(0)).count() == 0


def test_a_long_text_is_counted_in_pieces(monkeypatch, alnum_words):
    monkeypatch.setattr(lexical_search, "PIECE_BYTES", 50)
    rng = random.Random(2)
    long = " ".join(rng.choice(["ab", "é", "Cd", "x1"]) for _ in range(400)) + "y" * 120
    texts = [b"ab cd", long.encode(), b"", b"cd"]
    held = Counter()
    for terms, counts in lexical_search._counted(texts):
        names = terms.to_pylist()
        for term, text, n in counts.T.tolist():
            held[text, names[term].decode()] += n
    assert held == Counter((i, w) for i, t in enumerate(texts) for w in alnum_words(t.decode()))

"""The pipeline on the given tables, each stage against a plain version of it."""

from collections import Counter

import corpus_pipeline
import pytest

from platewise.llm import queries, toxicity
from platewise.llm.common import table

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Input and output rows of every stage, by name."""
    folder = tmp_path_factory.mktemp("pipeline")
    docs, out = table(spark, SF, "documents"), {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(f"{folder}/{k}")
        after = spark.read.parquet(f"{folder}/{k}")
        out[name] = docs, after
        docs = after
    return out


def test_stages_keep_the_columns(stages):
    for name, (before, after) in list(stages.items())[:-1]:
        assert after.schema == before.schema, name
        assert all(r["n_chars"] == len(r["text"]) for r in after.filter("text is not null").collect())


def rows_of(df):
    return Counter((r["doc_id"], r["text"]) for r in df.collect())


def test_toxicity(stages, spark):
    before, after = map(rows_of, stages["toxicity"])
    assert not after - before
    labels = {r["doc_id"]: r["toxic"] for r in table(spark, SF, "labels").collect()}
    gone = before - after
    clean = [i for i, _ in before if labels.get(i) == 0]
    assert sum(labels.get(i) == 0 for i, _ in gone) <= 0.05 * len(clean)


def test_toxicity_learns_from_every_label(stages, spark, monkeypatch):
    """The stage takes no part in the bounded sample for trials."""
    monkeypatch.setattr(toxicity, "TRAIN_ROWS", 1)
    monkeypatch.setattr(toxicity, "learning_sample", None)
    monkeypatch.setattr(toxicity, "trained", None)
    before, after = stages["toxicity"]
    assert rows_of(corpus_pipeline.drop_toxic(spark, before, SF)) == rows_of(after)


def test_near_duplicates(stages, ascii_lower, plain_words, fingerprint, groups):
    before, after = stages["simhash near-dedup"]
    fps = {r["doc_id"]: [fingerprint(plain_words(ascii_lower(r["text"])))] for r in before.collect()}
    assert {r["doc_id"] for r in after.collect()} == set(groups(fps).values())


def test_repeats(stages, plain_words, removed):
    before, after = stages["substring dedup"]
    rows = [(r["doc_id"], plain_words(r["text"])) for r in before.collect()]
    gone = removed([w for _, w in rows], 35)
    want = Counter((i, tuple(x for k, x in enumerate(w) if k not in g)) for (i, w), g in zip(rows, gone, strict=True))
    assert Counter((r["doc_id"], tuple(plain_words(r["text"]))) for r in after.collect()) == want


def test_benchmark(stages, spark, alnum_words, leaks):
    before, after = stages["benchmark decontamination"]
    items = [tuple(r) for r in table(spark, SF, "benchmark").select("item_id", "text").collect()]
    texts = [(r["doc_id"], r["text"], None) for r in before.collect()]
    want = Counter()
    for (i, t, _), (_, _, hit, _) in zip(texts, leaks(texts, items, alnum_words), strict=True):
        want[i, tuple(w for k, w in enumerate(alnum_words(t)) if k not in hit)] += 1
    assert Counter((r["doc_id"], tuple(alnum_words(r["text"]))) for r in after.collect()) == want


def test_packing(stages):
    before, after = stages["packing"]
    pieces = after.collect()
    assert {r["doc_id"] for r in pieces} == {r["doc_id"] for r in before.collect()}
    ends = Counter()
    for r in pieces:
        ends[r["doc_id"], r["doc_tokens"]] += r["length"]
    assert all(n == total for (_, total), n in ends.items())


def test_run_gives_the_last_stage(stages, spark):
    last = stages["packing"][1]
    again = corpus_pipeline.run(spark, SF)
    key = ["doc_id", "start", "length", "doc_tokens", "ids_crc32"]
    assert Counter(map(tuple, again.select(key).collect())) == Counter(map(tuple, last.select(key).collect()))


def test_odd_documents_pass_all_stages(spark, docs, no_docs):
    for rows in (docs, no_docs):
        for _, stage in corpus_pipeline.STAGES:
            rows = stage(spark, rows, SF)
        rows.count()


def test_rows_of_one_id_with_other_texts_pass_the_stages(spark):
    """Only alike rows are one; the stages after it keep what is left as well."""
    import random

    rng = random.Random(3)
    texts = [" ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(60)) for _ in range(6)]
    rows = [(7, texts[0]), (7, texts[1]), (7, texts[1]), (7, texts[2]), (8, texts[2]), (9, texts[3]), (None, texts[4]), (None, texts[4])]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars int")
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, SF)
    assert rows_of(kept) == Counter([(7, texts[0]), (7, texts[1]), (7, texts[2]), (9, texts[3]), (None, texts[4]), (None, texts[4])])
    packed = corpus_pipeline.pack(spark, kept, SF)
    assert packed.filter("start = 0").count() == 6


def test_every_operator_has_a_query():
    names = list(queries.queries())
    assert [n.split("_")[0] for n in names] == [f"op{k}" for k in range(1, 14)]

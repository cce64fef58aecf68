"""Toxicity and language identification: held-out accuracy, and parsing by brute force."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from platewise.llm import language_id, toxicity
from platewise.llm.common import table

SYLLABLES = {"aa": "ka lo mi ru sen tak".split(), "bb": "öst gra vil hen bo ly".split(), "cc": "zu pex qi wan dro fe".split()}
TOXIC = ["grubfoul", "vilescum", "stinkrot"]


def invented(rng, lang, n):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(9)
    rows, labels = [], []
    for i in range(900):
        lang = rng.choice(sorted(SYLLABLES))
        words = invented(rng, lang, rng.randint(5, 120)).split()
        bad = rng.random() < 0.25
        if bad:
            for _ in range(rng.randint(1, 4)):
                words.insert(rng.randrange(len(words)), rng.choice(TOXIC))
        rows.append((i, " ".join(words), lang if i % 9 else None))
        labels.append((i, int(bad)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    return docs, spark.createDataFrame(labels, "doc_id long, toxic int")


def crc(i, n):
    return zlib.crc32(str(i).encode()) % n


def test_toxicity_held_out(corpus):
    docs, labels = corpus
    scored = toxicity.score_documents(docs, labels).join(labels, "doc_id").collect()
    held = [r for r in scored if crc(r["doc_id"], 3) == 1]
    hits = sum(r["score"] >= 0.7 and r["toxic"] for r in held)
    assert hits / sum(r["toxic"] for r in held) > 0.9
    assert hits / sum(r["score"] >= 0.7 for r in held) > 0.9
    assert all(0 <= r["score"] <= 1 for r in scored)


def test_held_out_labels_are_not_read(corpus):
    docs, labels = corpus
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    other = labels.withColumn("toxic", F.when(held, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a = {r["doc_id"]: r["score"] for r in toxicity.score_documents(docs, labels).collect()}
    b = {r["doc_id"]: r["score"] for r in toxicity.score_documents(docs, other).collect()}
    assert a == b


def test_scores_see_the_text_alone(corpus):
    docs, labels = corpus
    part = docs.filter("doc_id < 40")
    changed = part.select((F.col("doc_id") + 100000).alias("doc_id"), "text", F.lit("xx").alias("lang"))
    both = toxicity.score_documents(docs.unionByName(changed), labels)
    scores = {r["doc_id"]: r["score"] for r in both.collect()}
    assert all(scores[i] == scores[i + 100000] for i in range(40))


def test_thresholds_weigh_the_classes():
    """Half of the sample is toxic, a tenth of all labels: scores of 0.55 that are toxic in
    half of the sample are mostly false alarms."""
    scores = np.array([0.8] * 40 + [0.55] * 40 + [0.1] * 40)
    toxic = np.array([1] * 40 + [1, 0] * 20 + [0] * 40)
    lang = ["aa"] * 120
    assert toxicity._thresholds(scores, toxic, lang, {"aa": (60, 60)}) == {"aa": 0.55}
    assert toxicity._thresholds(scores, toxic, lang, {"aa": (900, 100)}) == {"aa": 0.7}


def test_shares_of_all_labels(corpus, monkeypatch):
    """A sample of equal classes is weighted by all labels that may be learned from."""
    monkeypatch.setattr(toxicity, "TRAIN_ROWS", 75)
    docs, labels = corpus
    sample, shares, by_lang = toxicity.learning_sample(docs, labels)
    assert sample.toxic.mean() == 0.5
    rows = [r for r in docs.join(labels, "doc_id").collect() if crc(r["doc_id"], 3) != 1]
    assert shares == tuple(sum(r["toxic"] == c for r in rows) for c in (0, 1))
    assert by_lang and all(sum(r["toxic"] == c and r["lang"] == k for r in rows) == by_lang[k][c] for k in by_lang for c in (0, 1))
    net = toxicity.trained(sample, shares, by_lang)
    assert all(0.5 <= t <= 0.9 for t in net.thresholds.values())


def test_sample_takes_the_first_hashes_of_each_class(corpus, monkeypatch):
    """The same rows as by ordering all labels of a class."""
    monkeypatch.setattr(toxicity, "TRAIN_ROWS", 40)
    docs, labels = corpus
    rows = docs.join(labels, "doc_id").select("doc_id", "text", "toxic", F.xxhash64("doc_id").alias("h")).collect()
    rows = sorted((r["h"], r["doc_id"], r["toxic"], r["text"]) for r in rows if crc(r["doc_id"], 3) != 1)
    first = {c: [r for r in rows if r[2] == c][:40] for c in (0, 1)}
    want = [(c, first[c][n], (n + 1) % 5 == 0) for n in range(40) for c in (0, 1)]
    sample = toxicity.learning_sample(docs, labels)[0]
    buckets, cuts = toxicity.bucket_lists([r[3].encode() for _, r, _ in want])
    assert list(sample.toxic) == [c for c, _, _ in want] and len(set(sample.toxic)) == 2
    assert list(sample.buckets) == list(buckets) and list(sample.first) == list(cuts)
    assert list(sample.held) == [h for _, _, h in want]


def test_a_very_long_document_does_not_end_the_sample(spark, corpus, monkeypatch):
    monkeypatch.setattr(toxicity, "TRAIN_WORDS", 60_000)
    docs, labels = corpus
    usual = toxicity.learning_sample(docs, labels)[0]
    first = labels.filter("toxic = 1 and crc32(cast(cast(doc_id as string) as binary)) % 3 != 1")
    long = first.orderBy(F.xxhash64("doc_id"), "doc_id").first()["doc_id"]
    text = F.when(F.col("doc_id") == long, F.lit("ka " * 60_001)).otherwise(F.col("text"))
    sample = toxicity.learning_sample(docs.withColumn("text", text), labels)[0]
    assert len(sample.toxic) == len(usual.toxic) - 1 > 500


def test_every_label_is_learned_from(corpus, monkeypatch):
    """Bounds of the sample on the driver change no score, and all documents count."""
    docs, labels = corpus
    usual = {r["doc_id"]: r["score"] for r in toxicity.score_documents(docs, labels).collect()}
    monkeypatch.setattr(toxicity, "TRAIN_ROWS", 30)
    monkeypatch.setattr(toxicity, "TRAIN_WORDS", 3000)
    assert {r["doc_id"]: r["score"] for r in toxicity.score_documents(docs, labels).collect()} == usual
    usable, shares = toxicity._usable(labels)
    rows = toxicity.learning_rows(docs, usable, 3)
    assert rows.count() == sum(shares) and rows.rdd.getNumPartitions() == 3
    assert 0.15 < rows.filter("held").count() / sum(shares) < 0.25


def test_buckets_and_odds_of_all_documents(corpus):
    docs, labels = corpus
    usable, _ = toxicity._usable(labels)
    rows = toxicity.learning_rows(docs, usable, 4)
    learn = [(r["toxic"], set(toxicity._unpacked(r["buckets"]))) for r in rows.filter("not held").collect()]
    n = [sum(y == c for y, _ in learn) for c in (0, 1)]
    net = toxicity._begun(rows, *n)
    counts = [np.bincount([b for y, x in learn if y == c for b in x], minlength=1 << toxicity.BUCKET_BITS) for c in (0, 1)]
    frequent = np.flatnonzero(counts[0] + counts[1] >= toxicity.LEAST_DOCUMENTS)
    assert list(np.flatnonzero(net.row_of)) == list(frequent) and len(frequent) > 50
    odds = np.log((counts[1][frequent] + 0.5) / (n[1] + 1)) - np.log((counts[0][frequent] + 0.5) / (n[0] + 1))
    assert net.embeddings[1:, 0] == pytest.approx(np.clip(odds, -3, 4), abs=1e-5)


def test_training_in_parts(corpus, monkeypatch):
    """Several parts learn what one does, in any order of the rows, and twice the same."""
    monkeypatch.setattr(toxicity, "PART_ROWS", 100)
    docs, labels = corpus
    scored = toxicity.score_documents(docs, labels).join(labels, "doc_id").collect()
    held = [r for r in scored if crc(r["doc_id"], 3) == 1]
    hits = sum(r["score"] >= 0.7 and r["toxic"] for r in held)
    assert hits / sum(r["toxic"] for r in held) > 0.9
    assert hits / sum(r["score"] >= 0.7 for r in held) > 0.9
    again = toxicity.score_documents(docs.repartition(3, "text"), labels.repartition(2)).collect()
    # The same network; sums within a batch of other texts may end in another last bit.
    scores = {r["doc_id"]: r["score"] for r in scored}
    assert all(r["score"] == pytest.approx(scores[r["doc_id"]], rel=1e-5) for r in again)


def test_thresholds_of_counts(spark, corpus):
    """Thresholds by language from counts are those of the documents one by one."""
    rng = np.random.default_rng(4)
    n = 600
    toxic, logits = rng.integers(0, 2, n), rng.normal(0, 2, n)
    logits += toxic
    lang = [["aa", "bb", None, ""][i % 4] for i in range(n)]
    judged = spark.createDataFrame(list(zip(lang, toxic.tolist(), logits.tolist())), "lang string, toxic int, logit double")
    rows = judged.unionByName(judged.filter("toxic = 0"))
    shares = {x: tuple(int((toxic[[k == x for k in lang]] == c).sum()) * (2 - c) for c in (0, 1)) for x in ("aa", "bb")}
    want = toxicity._thresholds(toxicity.sigmoid(1.5 * logits + 0.3), toxic, lang, shares)
    assert toxicity._language_thresholds(rows, judged, (1.5, 0.3)) == want and len(want) == 2


def test_no_network_is_reported(corpus, monkeypatch):
    docs, labels = corpus
    monkeypatch.setattr(toxicity, "TRAIN_WORDS", 0)
    with pytest.warns(RuntimeWarning, match="no network"):
        scored = toxicity.score_documents(docs, labels)
    assert scored.filter("score != 0").count() == 0


def test_convolution_by_brute_force():
    """Maxima of all filters over a text, computed place by place."""
    rng = np.random.default_rng(1)
    net = toxicity.Network.start(np.zeros(1 << toxicity.BUCKET_BITS, np.int32), np.append(0, rng.normal(size=6)))
    texts = [rng.integers(0, 7, n) for n in (0, 1, 2, 9)]
    net.row_of = np.arange(1 << toxicity.BUCKET_BITS, dtype=np.int32) % 7
    first = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    got, _ = net.pooled(*net.rows(np.concatenate(texts).astype(np.int64), first))
    for row, t in zip(got, texts, strict=True):
        padded = np.concatenate([t if len(t) else [0], [0, 0]]).astype(int)
        want = []
        for f in net.filters:
            for one in f:
                places = range(max(1, len(t)))
                want.append(max(float((net.embeddings[padded[p : p + len(one)]] * one).sum()) for p in places))
        assert row == pytest.approx(want, abs=1e-5)


def test_gradients_by_differences():
    rng = np.random.default_rng(3)
    net = toxicity.Network.start(np.arange(1 << toxicity.BUCKET_BITS, dtype=np.int32) % 9, np.append(0, rng.normal(size=8)))
    net.embeddings = net.embeddings.astype(np.float64)
    net.filters = [f.astype(np.float64) for f in net.filters]
    lists = [rng.integers(0, 9, n) for n in (3, 8, 5)]
    first = np.concatenate([[0], np.cumsum([len(x) for x in lists])])
    y = np.array([0, 1, 1])
    sample = toxicity.Sample(np.concatenate(lists), first, y, ["a"] * 3, np.zeros(3, bool))
    index, weight = np.arange(3), {0: 1.5, 1: 0.75}

    def loss():
        net._tables = None
        p = toxicity.sigmoid(net.logits(*net.rows(*sample.some(index))).astype(np.float64))
        return float(np.mean(np.where(y == 1, -0.75 * np.log(p), -1.5 * np.log(1 - p))))

    net._tables = None
    gradients = toxicity._gradients(net, sample, index, weight)
    for values, g in zip([net.embeddings, *net.filters], gradients, strict=False):
        flat, at = values.reshape(-1), np.argsort(-np.abs(g.reshape(-1)))[:4]
        for k in at:
            flat[k] += 1e-5
            up = loss()
            flat[k] -= 2e-5
            down = loss()
            flat[k] += 1e-5
            assert g.reshape(-1)[k] == pytest.approx((up - down) / 2e-5, rel=0.05, abs=1e-4)


def test_toxicity_of_odd_tables(spark, docs, no_docs):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    one = spark.createDataFrame([(3, 1), (5, 1), (None, 0), (8, None)], "doc_id long, toxic int")
    for labels in (none, one):
        scored = toxicity.score_documents(docs, labels)
        assert scored.count() == docs.count() and scored.filter("score != 0").count() == 0
    assert toxicity.score_documents(no_docs, none).count() == 0
    mixed = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, toxic int")
    assert toxicity.score_documents(docs, mixed).filter("score between 0 and 1").count() == docs.count()


def test_languages_held_out(corpus):
    docs, _ = corpus
    rows = language_id.identify(docs).filter("lang is not null").collect()
    held = [r for r in rows if crc(r["doc_id"], 5) == 0]
    assert sum(r["lang"] == r["lang_pred"] for r in held) > 0.97 * len(held)
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_held_out_languages_are_not_read(corpus):
    docs, _ = corpus
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    other = docs.withColumn("lang", F.when(held, F.lit("zz")).otherwise(F.col("lang")))
    a = {(r["doc_id"], r["lang_pred"], r["score"]) for r in language_id.identify(docs).collect()}
    b = {(r["doc_id"], r["lang_pred"], r["score"]) for r in language_id.identify(other).collect()}
    assert a == b


def test_phrases_by_brute_force(monkeypatch):
    """The longest phrase that occurs in the labelled text, again and again."""
    monkeypatch.setattr(language_id, "BLOCK", 16)
    rng = random.Random(6)
    learned = {k: ["".join(rng.choice(letters) for _ in range(60))] for k, letters in (("x", "abc "), ("y", "abd "))}
    model = language_id.Model.of(learned)
    texts = ["".join(rng.choice("abcdé ,") for _ in range(rng.randint(0, 50))) for _ in range(60)]
    low, first = language_id.normalised(texts)
    got = model.phrases(low, first)
    for k, name in enumerate(model.names):
        source = "".join(chr(c) if c else " " for c in language_id._joined(learned[name]))
        for i in range(len(texts)):
            letters = "".join(chr(c) if c else " " for c in low[first[i] : first[i + 1]])
            want = 0
            for block in (letters[b : b + 16] for b in range(0, len(letters), 16)):
                at = 0
                while at < len(block):
                    n = 1
                    while at + n < len(block) and block[at : at + n + 1] in source:
                        n += 1
                    at, want = at + n, want + 1
            assert got[k][i] == want


def test_texts_without_letters(docs, no_docs):
    found = {(r["doc_id"], r["lang_pred"]) for r in language_id.identify(docs).collect() if r["doc_id"] in (500, 501, 502)}
    assert found == {(500, "und"), (501, "und"), (502, "und")}
    assert language_id.identify(docs).count() == docs.count()
    assert language_id.identify(no_docs).count() == 0
    names, scores = language_id.Model.of({"x": ["abc"]}).predict(["12 !", "ab", "", "漢字"])
    assert names == ["und", "x", "und", "x"] and scores[0] == 0


def test_on_given_tables(spark):
    """Accuracy on rows that nothing was learned from."""
    sf = "/root/testdata/sf0.01"
    rows = language_id.op7_language_id(spark, sf).join(table(spark, sf, "documents").select("doc_id", "lang"), "doc_id")
    held = rows.filter("held_out and lang is not null").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in held) > 0.97 * len(held)
    scored = toxicity.op6_toxicity(spark, sf).join(table(spark, sf, "labels"), "doc_id")
    held = scored.filter("held_out").collect()
    toxic = [r["score"] for r in held if r["toxic"]]
    clean = [r["score"] for r in held if not r["toxic"]]
    auc = np.mean([(a > b) + 0.5 * (a == b) for a in toxic for b in clean])
    assert auc > 0.85


def test_languages_with_few_usable_texts(spark):
    """Rows without letters take no place of others, and digits in front of a text none of its letters."""
    rows = [(i, None if i % 2 else " 12 ?", "xx") for i in range(600)]
    rows += [(1000 + i, "0 " * 5000 + "abc def " * 30, "xx") for i in range(60)]
    rows += [(2000 + i, "ghi jkl " * 30, "yy") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.learned(docs)
    assert model.names == ["xx", "yy"]
    assert "".join(map(chr, model.alphabet)) == "abcdefghijkl"
    # 60 texts of each language less a fifth held out, 240 letters and blanks each, up to the bound.
    assert all(b > 12 for b in model.bits)
    found = {r["lang_pred"] for r in language_id.identify(docs.filter("doc_id >= 1000 and doc_id < 2000")).collect()}
    assert found == {"xx"}

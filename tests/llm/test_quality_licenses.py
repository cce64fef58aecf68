"""Quality rules and license scan against brute force."""

import random
import re
from collections import Counter
from math import comb

import pytest
from pyspark.sql import functions as F

from platewise.llm import license_scan, quality_rules


def repeat_words(words):
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    twice = Counter(windows)
    return len({i + k for i, w in enumerate(windows) if twice[w] > 1 for k in range(5)})


def test_figures(docs, texts, plain_words):
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    extra = docs.unionByName(
        docs.limit(1).withColumn("text", F.lit("a# $b\n|x\na# $b\n \n\n a#\n\r\na# $b " + "q w e r t " * 4))
    )
    got = Counter(tuple(r) for r in quality_rules.figures(extra).select("doc_id", *names).collect())
    want = Counter()
    for r in extra.select("doc_id", "text").collect():
        words, text = plain_words(r["text"]), r["text"] or ""
        lines = [x for x in text.split("\n") if plain_words(x)]
        n = repeat_words(words)
        want[
            r["doc_id"], len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)),
            len(lines) - len(set(lines)), n, len(words) < 10 or 100 * n > 20 * len(words),
        ] += 1
    assert got == want


@pytest.mark.parametrize("n,k,p", [(10, 0, 0.1), (100, 3, 0.05), (500, 2, 0.02), (7, 6, 0.5), (40, 0, 0.01)])
def test_binomial_tail(spark, n, k, p):
    row = spark.range(1).select(quality_rules.binomial_tail(F.lit(n).cast("long"), F.lit(k).cast("long"), p)).first()
    exact = sum(comb(n, j) * p**j * (1 - p) ** (n - j) for j in range(k + 1))
    assert row[0] == pytest.approx(1.0 if k > n * p else exact, rel=1e-9)


def test_cutoffs_are_certified_by_stratum(spark):
    """A stratum of many good documents gets the cutoff that parts good and bad; one with
    few labels gets none, and neither does a rule that would reject good documents."""
    rng = random.Random(2)
    rows, labels = [], []
    for i in range(9000):
        lang = "en" if i < 8900 else "xx"
        bad = i % 9 == 0
        rows.append((i, "own" if i % 7 else None, lang, 100, 500, 80 if bad else rng.randint(0, 9), 0, 10, 0, 0, False))
        labels.append((i, 0 if bad else 1))
    schema = (
        "doc_id long, failed_rules string, lang string, n_words long, word_chars long, n_symbols long,"
        " n_dup_lines long, n_lines long, n_repeat_words long, n_capitals long, base_failed boolean"
    )
    measured = spark.createDataFrame(rows, schema)
    cutoffs = quality_rules.certified_cutoffs(measured, spark.createDataFrame(labels, "doc_id long, quality int"))
    found = {r["stratum"]: r["cutoffs"] for r in cutoffs.collect()}
    assert found == {"en": {"symbols": 0.75}}
    judged = quality_rules.judged(measured, cutoffs)
    rejected = {r["doc_id"] for r in judged.filter("not kept").collect()}
    assert rejected == {i for i in range(8900) if i % 9 == 0}


def test_strata_without_labels_and_null_strata(spark, docs, no_docs):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    for table in (docs, no_docs):
        measured = quality_rules.figures(table)
        judged = quality_rules.judged(measured, quality_rules.certified_cutoffs(measured, labels))
        assert judged.count() == table.count()
        assert judged.filter("kept = base_failed").count() == 0


def expansions(parsed):
    """Texts that an expression matches, with every choice of its branches and options; a
    set of letters stands for its first one."""
    out = [""]
    for op, value in parsed:
        name = str(op)
        if name == "LITERAL":
            some = [chr(value)]
        elif name == "IN":
            kind, what = value[0]
            some = [{"LITERAL": lambda: chr(what), "RANGE": lambda: chr(what[0])}.get(str(kind), lambda: "x")()]
        elif name == "SUBPATTERN":
            some = expansions(value[3])
        elif name == "BRANCH":
            some = [x for branch in value[1] for x in expansions(branch)]
        else:
            assert name == "MAX_REPEAT", name
            some = {x * n for n in {value[0], max(1, value[0])} for x in expansions(value[2])}
        out = [a + b for a in out for b in some]
    return out


def test_keyword_of_every_alternative():
    """Whatever a rule matches has its keyword, by whichever alternative. Grants hold the
    names of the tags."""
    gate = license_scan.gate_words()
    for level, label, _, keyword, body in license_scan.rules():
        if level == 3:
            continue
        for plain in expansions(re._parser.parse(body)):
            assert re.fullmatch(body, plain) and keyword in plain, (level, label, plain)
            assert any(g in plain for g in gate), (level, label, plain)


def test_responsible_ai(spark, rail):
    rows = spark.createDataFrame(list(enumerate(rail)), "doc_id long, text string")
    found = {r["doc_id"]: [(d["label"], d["level"]) for d in r["detections"]] for r in license_scan.scan(rows).collect()}
    assert found == {0: [("openrail", 2)], 1: [("openrail", 3)], 2: [("openrail", 4)], 3: [("openrail", 3)]}


def places(words, phrase):
    phrase = phrase.split()
    return [i for i in range(len(words)) if words[i : i + len(phrase)] == phrase]


def test_license_base(spark, docs, texts, alnum_words, licenses):
    more = spark.createDataFrame([(900 + i, t) for i, t in enumerate(licenses)], "doc_id long, text string")
    rows = docs.select("doc_id", "text").unionByName(more)
    got = Counter(
        (r["doc_id"], r["n_words"], tuple(sorted((b["start"], b["label"]) for b in r["base"])))
        for r in license_scan.scan(rows).collect()
    )
    want = Counter()
    for i, t in [(i, t) for i, t, _ in texts] + [(900 + i, t) for i, t in enumerate(licenses)]:
        words = alnum_words(t)
        found = [(p, label) for phrase, label in license_scan.BASE.items() for p in places(words, phrase)]
        want[i, len(words), tuple(sorted(found))] += 1
    assert got == want


def test_license_detections_equal_brute_force(spark, alnum_words, licenses):
    """All rules by Python's regular expressions, and suppression by comparing all pairs."""
    rows = [(i, t) for i, t in enumerate(licenses + [" ".join(licenses) * 3])]
    scanned = license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string"))
    got = {r["doc_id"]: sorted((d["start"], d["stop"], d["level"], d["rule"]) for d in r["detections"]) for r in scanned.collect()}
    for i, text in rows:
        norm = " " + " ".join(alnum_words(text)) + " "
        found = []
        for rule, (level, _, _, _, body) in enumerate(license_scan.rules()):
            for m in re.finditer(rf"(?<= )(?:{body})(?= )", norm):
                start = norm[: m.start()].count(" ") - 1
                found.append((start, start + m[0].count(" ") + 1, level, rule))
        kept = [
            d
            for d in found
            if not any(
                o != d and o[0] <= d[0] and o[1] >= d[1] and o[2] <= d[2]
                and ((o[0], o[1]) != (d[0], d[1]) or (o[2], o[3]) < (d[2], d[3]))
                for o in found
            )
        ]
        assert got[i] == sorted(kept)
    labels = {r["doc_id"]: {d["label"] for d in r["detections"]} for r in scanned.collect()}
    assert labels[0] == {"gpl", "gpl-3.0"} and labels[1] == {"cc-by-nc"} and labels[5] == set()


def test_every_rule_is_reached(spark):
    """The keyword of a rule, and a word of the gate, are in whatever the rule matches."""
    gate = license_scan.gate_words()
    for _, label, _, keyword, body in license_scan.rules():
        plain = re.sub(r"\(\?:([^()|]*)\|[^()]*\)\??", r"\1", body)
        if re.search(rf"^(?:{body})$", plain):
            assert keyword in plain and any(g in plain for g in gate), (label, plain)

"""Quality rules whose cutoffs are certified on labelled holdouts.

Each rule compares one figure of a document with a cutoff. A stratum (here the language)
has cutoffs of its own. From a fixed list of candidates, a cutoff may be used only if the
labelled good documents of the stratum show that it rejects few good ones: with n good
documents of which k are rejected, the exact binomial test must reject the hypothesis that
the share of good documents rejected is ``false_rejection / rules`` or more. The tests of a
rule go from the most lenient cutoff to the strictest and stop at the first that fails
(fixed sequence), and the error probability ``delta`` is divided by the number of strata
and rules (Bonferroni). So with probability 1 - delta no stratum loses more than
``false_rejection`` of its good documents by these rules. Of the certified cutoffs of a
rule, the one counts that rejects the most labelled bad documents less good ones, the most
lenient of equals; none if that number is not above zero.

Everything is DataFrame expressions. Only figures are kept of the documents, and they are
computed once; cutoffs are chosen on counts with one row per stratum, rule and candidate.

Null and empty texts have no words and fail the base rule. A null language is a stratum
of its own. Documents that fail the base rule take no part in
the choice. A stratum without labelled documents has the base rule alone. Several
labels of one id each count for each of its rows. Columns added replace those of the
same name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from platewise.llm.common import checkpointed, table

FALSE_REJECTION = 0.02
DELTA = 0.1

#: rule: (figure, cutoffs from lenient to strict). A document is rejected above the cutoff.
RULES: dict[str, tuple[str, list[float]]] = {
    "symbols": ("n_symbols / n_words", [3.0, 2.0, 1.5, 1.0, 0.75, 0.5, 0.4, 0.3, 0.2, 0.1]),
    "repeats": ("n_repeat_words / n_words", [0.95, 0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.2, 0.1]),
    "lines": ("n_dup_lines / n_lines", [0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.2, 0.1]),
    "length": ("word_chars / n_words", [40.0, 30.0, 25.0, 20.0, 17.0, 15.0, 13.0, 12.0, 11.0, 10.0]),
    "capitals": ("n_capitals / word_chars", [0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15]),
}

_BLANKS = " \t\n\x0b\f\r"
_WINDOW = 5


def figures(docs: DataFrame) -> DataFrame:
    """Adds the figures that the rules use, ``base_failed`` among them."""
    text = F.coalesce(F.col("text"), F.lit(""))
    trimmed = F.btrim(text, F.lit(_BLANKS))
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(_BLANKS)) != "")
    nothing = F.array().cast("array<string>")
    read = docs.withColumns(
        {
            "__words": F.when(trimmed == "", nothing).otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+")),
            "__lines": lines,
            "n_symbols": _removed(text, r"[#*$%&|<>]"),
            "n_capitals": _removed(text, r"\p{Lu}"),
        }
    )
    hashed = read.withColumns(
        {
            "n_words": F.size("__words").cast("long"),
            "word_chars": F.length(F.array_join("__words", "")).cast("long"),
            "n_lines": F.size("__lines").cast("long"),
            "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"),
            "__hashes": F.transform("__words", lambda w: F.xxhash64(w)),
        }
    ).drop("__words", "__lines")
    last = F.size("__hashes") - _WINDOW
    window = F.when(
        last >= 0,
        F.transform(
            F.sequence(F.lit(0), last),
            lambda i: F.xxhash64(*[F.get("__hashes", i + k) for k in range(_WINDOW)]),
        ),
    ).otherwise(F.array().cast("array<bigint>"))
    counted = (
        hashed.withColumn("__windows", window)
        .drop("__hashes")
        .withColumn("n_repeat_words", _repeat_words(F.col("__windows")).cast("long"))
        .drop("__windows")
    )
    few = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return counted.withColumn("base_failed", few)


def _removed(text: Column, pattern: str) -> Column:
    return (F.length(text) - F.length(F.regexp_replace(text, pattern, ""))).cast("long")


def _repeat_words(windows: Column) -> Column:
    """Words in windows that the text has twice or more.

    Windows are compared by hash. A text without repeats is known by the number of its
    distinct windows; otherwise sorting brings equal ones together.
    """
    ordered = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def counted(pairs: Column) -> Column:
        twice = F.filter(
            pairs,
            lambda p, j: (F.get(pairs, j - 1)["h"] == p["h"]).eqNullSafe(F.lit(True))
            | (F.get(pairs, j + 1)["h"] == p["h"]).eqNullSafe(F.lit(True)),
        )
        return _bind(F.sort_array(F.transform(twice, lambda p: p["i"])), _covered)

    return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0)).otherwise(
        _bind(ordered, counted)
    )


def _covered(starts: Column) -> Column:
    reach = F.transform(
        starts, lambda s, j: F.least(F.lit(_WINDOW), F.coalesce(F.get(starts, j + 1) - s, F.lit(_WINDOW)))
    )
    return F.aggregate(reach, F.lit(0), lambda a, x: a + x)


def _bind(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def rule_value(rule: str) -> Column:
    top, bottom = RULES[rule][0].split(" / ")
    return F.when(F.col(bottom) > 0, F.col(top) / F.col(bottom)).otherwise(F.lit(0.0))


def binomial_tail(n: Column, k: Column, p: float) -> Column:
    """P(X <= k) for X binomial with n trials of probability p; 1 where k > n p, which
    no test would reject anyway. Terms are added in logarithms of their ratios."""
    import math

    odds = F.lit(math.log(p) - math.log1p(-p))
    first = n * F.lit(math.log1p(-p))
    steps = F.when(k >= 1, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<bigint>"))
    total = F.aggregate(
        steps,
        F.struct(first.alias("term"), F.exp(first).alias("sum")),
        lambda a, j: _bind(
            a["term"] + F.log((n - j + 1) / j) + odds,
            lambda t: F.struct(t.alias("term"), (a["sum"] + F.exp(t)).alias("sum")),
        ),
        lambda a: a["sum"],
    )
    return F.when(k > n * p, F.lit(1.0)).otherwise(total)


def certified_cutoffs(
    measured: DataFrame,
    labels: DataFrame,
    stratum: str = "lang",
    false_rejection: float = FALSE_REJECTION,
    delta: float = DELTA,
) -> DataFrame:
    """(stratum, cutoffs): for each stratum a map of rule and cutoff.

    ``labels`` has doc_id and quality, 1 for good."""
    marked = measured.filter(~F.col("base_failed")).join(
        labels.select("doc_id", "quality").filter("quality in (0, 1)"), "doc_id"
    )
    counts = checkpointed(
        marked.groupBy(F.col(stratum).alias("stratum")).agg(
            F.sum(F.col("quality").cast("long")).alias("n"),
            *[
                F.sum(F.when((rule_value(r) > c) & (F.col("quality") == q), 1).otherwise(0)).alias(f"{r}_{i}_{q}")
                for r, (_, cutoffs) in RULES.items()
                for i, c in enumerate(cutoffs)
                for q in (0, 1)
            ],
        )
    )
    candidates = F.array(
        *[
            F.struct(
                F.lit(r).alias("rule"),
                F.lit(i).alias("step"),
                F.lit(c).alias("cutoff"),
                F.col(f"{r}_{i}_0").alias("bad"),
                F.col(f"{r}_{i}_1").alias("good"),
            )
            for r, (_, cutoffs) in RULES.items()
            for i, c in enumerate(cutoffs)
        ]
    )
    level = delta / (max(1, counts.count()) * len(RULES))
    tested = counts.select("stratum", "n", F.inline(candidates)).withColumn(
        "passed", binomial_tail(F.col("n"), F.col("good"), false_rejection / len(RULES)) <= level
    )
    sequence = Window.partitionBy("stratum", "rule").orderBy("step")
    gain = F.col("bad") - F.col("good")
    best = (
        tested.withColumn("certified", F.min("passed").over(sequence))
        .filter(F.col("certified") & (gain > 0))
        .groupBy("stratum", "rule")
        .agg(F.max_by("cutoff", F.struct(gain, -F.col("step"))).alias("cutoff"))
    )
    return best.groupBy("stratum").agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("rule", "cutoff")))).alias("cutoffs")
    )


def judged(measured: DataFrame, cutoffs: DataFrame, stratum: str = "lang") -> DataFrame:
    """Adds ``failed_rules`` and ``kept`` to documents with figures."""
    rows = measured.drop("failed_rules", "kept").join(
        cutoffs, measured[stratum].eqNullSafe(cutoffs["stratum"]), "left"
    )
    failed = F.array_compact(
        F.array(
            *[
                F.when(rule_value(r) > F.try_element_at("cutoffs", F.lit(r)), F.lit(r))
                for r in RULES
            ]
        )
    )
    return (
        rows.withColumn("failed_rules", failed)
        .withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0))
        .drop("stratum", "cutoffs")
    )


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    measured = checkpointed(figures(docs).drop("text"))
    cutoffs = certified_cutoffs(measured, table(spark, sf_dir, "labels"))
    return judged(measured, cutoffs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept", F.array_join("failed_rules", ",").alias("failed_rules"),
    )

"""License detection by ordered signature rules, in DataFrame expressions alone.

A text is read as words in lower case, joined by one blank. Rules are regular expressions
over that, in four levels: distinctive sentences of a license, identifiers in tags, phrases
that grant a license, and plain names. A rule is tried only on texts that contain its
keyword, and only texts with some keyword are normalised at all.

Detections may overlap. One is suppressed if it lies within another of a better level, or
of its own level (the longer, then the first rule, wins). They are taken in order of their
start, the longest first, so that whatever contains a detection comes before it, and the
furthest end seen on each level decides.

Null and empty texts have no words and no detection. Work is per row: no row depends on
another, so repeated rows and equal ids get equal results. Columns added replace those of
the same name.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from platewise.llm.common import table

WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

# Phrases that every scan reports, and their labels.
BASE = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

#: Level: confidence of a detection.
LEVELS = {1: 1.0, 2: 0.95, 3: 0.9, 4: 0.6}

#: Distinctive sentences: (label, keyword, expression).
SENTENCES = [
    ("mit", "permission", r"permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("mit", "software", r"the software is provided as is without warranty of any kind express or implied"),
    ("isc", "permission", r"permission to use copy modify and (?:or )?distribute this software for any purpose with or without fee is hereby granted"),
    ("bsd", "redistribution", r"redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd-3-clause", "endorse", r"neither the name of (?:\S+ ){1,12}nor the names of its contributors may be used to endorse or promote"),
    ("apache-2.0", "licensed", r"licensed under the apache license version 2 0"),
    ("apache-2.0", "license", r"you may not use this file except in compliance with the license"),
    ("gpl", "software", r"free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("lgpl", "software", r"free software you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public license"),
    ("agpl", "software", r"free software you can redistribute it and or modify it under the terms of the gnu affero general public license"),
    ("gpl-3.0", "license", r"gnu general public license (?:version|v) ?3(?: 0)?"),
    ("gpl-2.0", "license", r"gnu general public license (?:version|v) ?2(?: 0)?"),
    ("mpl-2.0", "mozilla", r"this source code form is subject to the terms of the mozilla public license v(?:ersion)? ?2 0"),
    ("epl", "eclipse", r"this program and the accompanying materials are made available under the terms of the eclipse public license"),
    ("unlicense", "unencumbered", r"this is free and unencumbered software released into the public domain"),
    ("wtfpl", "want", r"do what the fuck you want to public license"),
    ("zlib", "software", r"this software is provided as is without any express or implied warranty in no event will the authors be held liable"),
    ("bsl-1.0", "boost", r"boost software license version 1 0"),
    ("cc0-1.0", "creative", r"creative commons (?:cc0|zero) (?:1 0 )?universal"),
    ("cc-by-4.0", "creative", r"creative commons attribution 4 0 international(?: public license)?"),
    ("cc-by-sa-4.0", "creative", r"creative commons attribution share ?alike 4 0 international(?: public license)?"),
    ("cc-by-nc-4.0", "creative", r"creative commons attribution non ?commercial 4 0 international(?: public license)?"),
    ("cc-by-nd-4.0", "creative", r"creative commons attribution no ?derivatives 4 0 international(?: public license)?"),
    ("ofl-1.1", "font", r"this font software is licensed under the sil open font license version 1 1"),
    ("artistic-2.0", "artistic", r"you are permitted to use and distribute the package under the artistic license 2 0"),
    ("public-domain", "domain", r"(?:has been |is hereby |are )?(?:placed|released|dedicated) (?:in|into|to) the public domain"),
    ("proprietary", "rights", r"all rights reserved"),
]

#: Names: (label, keyword, expression). Each gives a rule for grants, tags and plain names.
NAMES = [
    ("mit", "mit", r"mit(?: expat)?"),
    ("mit-0", "mit", r"mit (?:no attribution|0)"),
    ("x11", "x11", r"x11"),
    ("apache-1.1", "apache", r"apache(?: software)?(?: license)?(?: version)? 1 1"),
    ("apache-2.0", "apache", r"apache(?: software)?(?: license)?(?: version| v)? ?2(?: 0)?"),
    ("apache", "apache", r"apache(?: software)?"),
    ("gpl-1.0", "gpl", r"gpl(?: version| v)? ?1(?: 0)?(?: only| or later)?"),
    ("gpl-2.0", "gpl", r"gpl(?: version| v)? ?2(?: 0)?(?: only| or later)?"),
    ("gpl-3.0", "gpl", r"gpl(?: version| v)? ?3(?: 0)?(?: only| or later)?"),
    ("gpl", "gnu", r"gnu (?:gpl|general public)"),
    ("lgpl-2.0", "lgpl", r"lgpl(?: version| v)? ?2 0(?: only| or later)?"),
    ("lgpl-2.1", "lgpl", r"lgpl(?: version| v)? ?2 1(?: only| or later)?"),
    ("lgpl-3.0", "lgpl", r"lgpl(?: version| v)? ?3(?: 0)?(?: only| or later)?"),
    ("lgpl", "gnu", r"gnu (?:lgpl|(?:lesser|library) general public)"),
    ("agpl-3.0", "agpl", r"agpl(?: version| v)? ?3(?: 0)?(?: only| or later)?"),
    ("agpl", "gnu", r"gnu (?:agpl|affero general public)"),
    ("gfdl", "gnu", r"gnu free documentation"),
    ("bsd-2-clause", "bsd", r"(?:simplified bsd|bsd 2 clause)"),
    ("bsd-3-clause", "bsd", r"(?:new bsd|modified bsd|bsd 3 clause)"),
    ("bsd-4-clause", "bsd", r"(?:original bsd|bsd 4 clause)"),
    ("0bsd", "bsd", r"(?:0bsd|bsd zero clause)"),
    ("bsd", "bsd", r"bsd"),
    ("mpl-1.1", "mpl", r"mpl(?: version| v)? ?1 1"),
    ("mpl-2.0", "mpl", r"mpl(?: version| v)? ?2(?: 0)?"),
    ("mpl", "mozilla", r"mozilla public"),
    ("epl-1.0", "epl", r"epl(?: version| v)? ?1 0"),
    ("epl-2.0", "epl", r"epl(?: version| v)? ?2 0"),
    ("epl", "eclipse", r"eclipse public"),
    ("cddl", "cddl", r"cddl(?: 1 [01])?"),
    ("cddl", "distribution", r"common development and distribution"),
    ("eupl", "eupl", r"eupl(?: 1 [012])?"),
    ("eupl", "european", r"european union public"),
    ("isc", "isc", r"isc"),
    ("zlib", "zlib", r"zlib(?: libpng)?"),
    ("bsl-1.0", "boost", r"boost software"),
    ("unlicense", "unlicense", r"unlicense"),
    ("wtfpl", "wtfpl", r"wtfpl"),
    ("artistic-2.0", "artistic", r"artistic(?: 2 0)?"),
    ("ofl-1.1", "font", r"(?:sil )?open font"),
    ("ms-pl", "microsoft", r"microsoft public"),
    ("ms-rl", "microsoft", r"microsoft reciprocal"),
    ("python-2.0", "python", r"python software foundation"),
    ("php-3.0", "php", r"php(?: 3 0)?"),
    ("ruby", "ruby", r"ruby"),
    ("openssl", "openssl", r"openssl"),
    ("postgresql", "postgresql", r"postgresql"),
    ("ncsa", "ncsa", r"(?:university of illinois )?ncsa(?: open source)?"),
    ("upl-1.0", "permissive", r"universal permissive"),
    ("afl-3.0", "academic", r"academic free(?: 3 0)?"),
    ("osl-3.0", "open", r"open software(?: 3 0)?"),
    ("odbl", "odbl", r"odbl(?: 1 0)?"),
    ("odbl", "database", r"open database"),
    ("odc-by", "odc", r"odc by(?: 1 0)?"),
    ("pddl", "pddl", r"pddl(?: 1 0)?"),
    ("cc0-1.0", "cc0", r"cc0(?: 1 0)?"),
    ("cc-by-nc-nd", "cc", r"cc by nc nd(?: [1-4] [05])?"),
    ("cc-by-nc-sa", "cc", r"cc by nc sa(?: [1-4] [05])?"),
    ("cc-by-nc", "cc", r"cc by nc(?: [1-4] [05])?"),
    ("cc-by-nd", "cc", r"cc by nd(?: [1-4] [05])?"),
    ("cc-by-sa", "cc", r"cc by sa(?: [1-4] [05])?"),
    ("cc-by", "cc", r"cc by(?: [1-4] [05])?"),
    ("cc", "creative", r"creative commons"),
    ("gpl-exception", "exception", r"classpath exception"),
    ("sspl", "sspl", r"sspl(?: 1 0)?"),
    ("sspl", "server", r"server side public"),
    ("busl", "business", r"business source"),
    ("elastic-2.0", "elastic", r"elastic(?: 2 0)?"),
    ("json", "json", r"json"),
    ("llama", "llama", r"llama(?: [23])? community"),
    ("openrail", "ai", r"(?:open ?rail(?: m)?|responsible ai)"),
    ("fair", "fair", r"fair"),
    ("vim", "vim", r"vim"),
    ("beerware", "beer", r"beer ?ware"),
]

#: Names that are ordinary words or letters alone count only before "license".
_PLAIN_NEEDS_LICENSE = {
    "mit", "apache", "gpl", "lgpl", "agpl", "bsd", "mpl", "epl", "isc", "zlib", "bsl-1.0", "x11", "eupl", "fair",
    "artistic-2.0", "php-3.0", "ruby", "openssl", "postgresql", "ncsa", "python-2.0", "ms-pl", "ms-rl", "upl-1.0",
    "afl-3.0", "osl-3.0", "odbl", "ofl-1.1", "json", "vim", "elastic-2.0", "busl", "llama", "openrail", "cc", "cddl",
    "sspl", "gfdl", "mit-0", "mpl-1.1", "mpl-2.0", "epl-1.0", "epl-2.0", "odc-by",
}
_LICENSE = r"(?: licen[sc]es?)"
_GRANT_WORDS = [
    "released", "licensed", "licenced", "distributed", "available", "published", "provided", "covered", "shared", "offered",
]
_GRANT = (
    rf"(?:{'|'.join(_GRANT_WORDS)})"
    r" (?:under|subject to|according to) (?:the )?(?:terms of )?(?:the )?"
)


def rules() -> list[tuple[int, str, float, str, str]]:
    """(level, label, confidence, keyword, expression), in order."""
    out = [(1, label, keyword, body) for label, keyword, body in SENTENCES]
    for label, keyword, name in NAMES:
        out.append((2, label, keyword, rf"spdx license identifier {name}"))
    for label, keyword, name in NAMES:
        out.append((3, label, keyword, rf"{_GRANT}{name}{_LICENSE}?"))
    for label, keyword, name in NAMES:
        need = _LICENSE + ("" if label in _PLAIN_NEEDS_LICENSE else "?")
        out.append((4, label, keyword, name + need))
    return [(level, label, LEVELS[level], keyword, body) for level, label, keyword, body in out]


def gate_words() -> list[str]:
    """Words of which every text with a base phrase or a detection contains one: those of
    the base phrases and grants, "licen", and the keywords of rules that can do without."""
    words = {"gnu", "licen", "cc", *_GRANT_WORDS}
    for level, _, _, keyword, body in rules():
        needed = re.sub(r"\(\?:[^()]*\)\?", "", body)
        if level != 3 and "licen" not in needed:
            words.add(keyword)
    return sorted(w for w in words if not any(o != w and o in w for o in words))


def _between(body: str) -> str:
    return f"(?<= )(?:{body})(?= )"


def _n_blanks(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))


def spans(norm: Column, expression: Column) -> Column:
    """Matches in words between blanks as structs (start, stop) of word numbers, in order.

    What lies between two matches begins and ends with a blank and so has one word less
    than blanks; a match has one more.
    """
    gaps = F.transform(F.split(norm, expression, -1), lambda x: _n_blanks(x) - 1)
    found = F.transform(F.regexp_extract_all(norm, expression, 0), lambda x: _n_blanks(x) + 1)
    empty = F.array().cast("array<struct<start: int, stop: int>>")
    walked = F.aggregate(
        F.zip_with(F.slice(gaps, F.lit(1), F.size(found)), found, lambda g, n: F.struct(g.alias("g"), n.alias("n"))),
        F.struct(F.lit(0).alias("at"), empty.alias("out")),
        lambda a, m: F.struct(
            (a["at"] + m["g"] + m["n"]).alias("at"),
            F.concat(
                a["out"],
                F.array(
                    F.struct(
                        (a["at"] + m["g"]).alias("start"), (a["at"] + m["g"] + m["n"]).alias("stop")
                    )
                ),
            ).alias("out"),
        ),
        lambda a: a["out"],
    )
    return F.when(F.regexp_like(norm, expression), walked).otherwise(empty)


def _detections(norm: Column) -> Column:
    """All matches of all rules whose keyword is there, by start and then the longest."""
    table_of_rules = F.array(
        *[
            F.struct(
                F.lit(level).alias("level"),
                F.lit(i).alias("rule"),
                F.lit(label).alias("label"),
                F.lit(confidence).alias("confidence"),
                F.lit(keyword).alias("keyword"),
                F.lit(_between(body)).alias("expression"),
            )
            for i, (level, label, confidence, keyword, body) in enumerate(rules())
        ]
    )
    tried = F.filter(table_of_rules, lambda r: F.contains(norm, r["keyword"]))
    found = F.transform(
        tried,
        lambda r: F.transform(
            spans(norm, r["expression"]),
            lambda s: F.struct(
                s["start"].alias("start"),
                (-s["stop"]).alias("minus_stop"),
                r["level"].alias("level"),
                r["rule"].alias("rule"),
                r["label"].alias("label"),
                r["confidence"].alias("confidence"),
            ),
        ),
    )
    return F.sort_array(F.flatten(found))


def _kept(detections: Column) -> Column:
    """Detections that no other one suppresses."""
    levels = sorted(LEVELS)
    kind = "array<struct<start: int, stop: int, level: int, rule: int, label: string, confidence: double>>"
    start = F.struct(*[F.lit(-1).alias(f"end{i}") for i in levels], F.array().cast(kind).alias("out"))

    def step(a: Column, d: Column) -> Column:
        stop = -d["minus_stop"]
        inside = F.lit(False)
        for i in levels:
            inside = inside | ((d["level"] >= i) & (a[f"end{i}"] >= stop))
        row = F.struct(
            d["start"].alias("start"),
            stop.alias("stop"),
            *[d[c].alias(c) for c in ("level", "rule", "label", "confidence")],
        )
        return F.struct(
            *[
                F.when(d["level"] == i, F.greatest(a[f"end{i}"], stop)).otherwise(a[f"end{i}"]).alias(f"end{i}")
                for i in levels
            ],
            F.when(inside, a["out"]).otherwise(F.concat(a["out"], F.array(row))).alias("out"),
        )

    return F.aggregate(detections, start, step, lambda a: a["out"])


def scan(docs: DataFrame) -> DataFrame:
    """Adds ``n_words``, ``base`` (places of the base phrases as start and label),
    ``detections`` (start, stop, level, rule, label, confidence) and ``license_score``."""
    text = F.coalesce(F.col("text"), F.lit(""))
    some = F.lit(False)
    for word in gate_words():
        some = some | F.contains("__low", F.lit(word))
    letters = "abcdefghijklmnopqrstuvwxyz"
    words = F.regexp_extract_all(F.translate(text, letters.upper(), letters), F.lit(WORD), 0)
    norm = F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" "))
    # A column of its own, so that texts are put in lower case once and not for each word.
    read = docs.withColumn("__low", F.lower(text)).withColumns(
        {"n_words": F.regexp_count(text, F.lit(WORD)).cast("long"), "__norm": F.when(some, norm)}
    ).drop("__low")
    norm = F.col("__norm")
    base = F.concat(*[_places(norm, phrase, label) for phrase, label in BASE.items()])
    none = "array<struct<start: bigint, label: string>>"
    found = read.withColumn(
        "base", F.when(norm.isNotNull(), base).otherwise(F.array().cast(none))
    ).withColumn("__detections", F.when(norm.isNotNull(), _detections(norm)))
    empty = F.array().cast(
        "array<struct<start: int, stop: int, level: int, rule: int, label: string, confidence: double>>"
    )
    return (
        found.drop("__norm")
        .withColumn("detections", F.coalesce(_kept(F.col("__detections")), empty))
        .drop("__detections")
        .withColumn("license_score", F.coalesce(F.array_max("detections.confidence"), F.lit(0.0)))
    )


def _places(norm: Column, phrase: str, label: str) -> Column:
    return F.transform(
        spans(norm, F.lit(_between(phrase))),
        lambda s: F.struct(s["start"].cast("long").alias("start"), F.lit(label).alias("label")),
    )


def _listed(labels: Column) -> Column:
    return F.array_join(F.sort_array(F.array_distinct(labels)), ",")


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    scanned = scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return scanned.select(
        "doc_id",
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min("base.start").alias("first_word"),
        F.array_max("base.start").alias("last_word"),
        _listed(F.col("base.label")).alias("base_labels"),
        _listed(F.concat("base.label", "detections.label")).alias("labels"),
        F.col("license_score").alias("score"),
    )

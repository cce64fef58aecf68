import random
import re
from collections import Counter, defaultdict

import pytest
import xxhash

WORDS = ["der", "stone", "réve", "ing", "the", "of", "on", "sky", "größe", "x1", "idiot", "and"]


def prose(rng, n):
    """n words with a few line breaks and signs."""
    out = []
    for _ in range(n):
        word = "".join(rng.choice(WORDS) for _ in range(rng.randint(1, 3)))
        out.append(word.capitalize() if rng.random() < 0.2 else word)
        out.append(rng.choice([" "] * 12 + ["\n", ". ", ", ", "  ", "\t", "\n\n"]))
    return "".join(out)


@pytest.fixture(scope="session")
def texts():
    """(doc_id, text, lang): null and empty texts, rows without an id, repeated rows, equal
    ids, near copies, shared passages, a text that repeats itself and a long one."""
    rng = random.Random(5)
    base = [prose(rng, rng.randint(1, 160)) for _ in range(40)]
    passage = prose(rng, 60)
    rows = [(i, t, rng.choice(["en", "de", None])) for i, t in enumerate(base)]
    rows += [(100 + i, base[i], "en") for i in range(0, 40, 5)]
    rows += [(200 + i, base[i].replace("the", "The ", 1), "en") for i in range(1, 40, 7)]
    rows += [(300 + i, base[i] + " " + passage, "de") for i in range(6)]
    rows += [(400, " ".join(["again"] * 90), "en"), (401, prose(rng, 9000), "en")]
    rows += [(500, None, "en"), (501, "", None), (502, " \n\t ", "en"), (503, "  \x1c é", "fr")]
    rows += [(504, "word", "en"), (505, "Licensed under CC BY-NC 4.0. MIT  License; mit license", "en")]
    rows += [(3, base[3], "en"), (7, prose(rng, 50), "en"), (7, prose(rng, 50), "en")]
    rows += [(None, base[2], "en"), (None, None, None)]
    return rows


@pytest.fixture(scope="session")
def docs(spark, texts):
    """The rows with columns called like some that operators add, and one of lists."""
    rows = [(i, t, l, "src0", len(t or ""), "own", [1], True, 9) for i, t, l in texts]
    schema = (
        "doc_id long, text string, lang string, source string, n_chars long,"
        " score string, items array<int>, kept boolean, n_words int"
    )
    return spark.createDataFrame(rows, schema).repartition(3).cache()


@pytest.fixture(scope="session")
def no_docs(docs):
    return docs.limit(0)


@pytest.fixture(scope="session")
def ascii_lower():
    return lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


@pytest.fixture(scope="session")
def plain_words():
    """Words between ASCII white space."""
    return lambda t: re.findall(r"[^\x20\x09-\x0D]+", t or "")


@pytest.fixture(scope="session")
def alnum_words(ascii_lower):
    return lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", ascii_lower(t))


def _fingerprint(words):
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.fixture(scope="session")
def fingerprint():
    return _fingerprint


def _groups(fps):
    """Smallest id reachable, by comparing all pairs."""
    root = {i: i for i in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in fps:
        for b in fps:
            if any((x ^ y).bit_count() <= 2 for x in fps[a] for y in fps[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in fps}


@pytest.fixture(scope="session")
def groups():
    return _groups


def _removed(lists, window):
    """Places of all words that go, by text."""
    counts = Counter(tuple(w[i : i + window]) for w in lists for i in range(len(w) - window + 1))
    return [
        {i + k for i in range(len(w) - window + 1) if counts[tuple(w[i : i + window])] > 1 for k in range(window)}
        for w in lists
    ]


@pytest.fixture(scope="session")
def removed():
    return _removed


def _brute(texts, benchmark, words_of, window=10):
    items = defaultdict(set)
    for item, t in benchmark:
        w = words_of(t)
        for i in range(max(1, len(w) - window + 1) if w else 0):
            items[tuple(w[i : i + window])].add(item)
    out = []
    for i, t, _ in texts:
        w = words_of(t)
        hit, found = set(), set()
        for n in {len(p) for p in items}:
            for k in range(len(w) - n + 1):
                own = items.get(tuple(w[k : k + n]))
                if own:
                    hit.update(range(k, k + n))
                    found |= own
        out.append((i, len(w), frozenset(hit), tuple(sorted(found - {None}))))
    return out


@pytest.fixture(scope="session")
def leaks():
    return _brute


RAIL = [
    "SPDX-License-Identifier: Responsible AI",
    "The model is licensed under the Responsible AI License.",
    "see the Responsible AI license",
    "released under OpenRAIL-M",
]

LICENSES = [
    "This work is licensed under the GNU General Public License, version 3.",
    "Licensed under CC BY-NC 4.0.",
    "SPDX-License-Identifier: Apache-2.0 and the MIT License",
    "mit license mit license MIT LICENSE",
    "Copyright. All rights reserved.",
    "permit licenses and limit license",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software",
]


@pytest.fixture(scope="session")
def rail():
    return RAIL


@pytest.fixture(scope="session")
def licenses():
    return LICENSES

"""The streaming transducer against the tokenizers library, and its lookahead against all continuations."""

import hashlib
import itertools
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from platewise.llm import bpe_stream


@pytest.fixture(scope="module")
def own():
    return bpe_stream.codec(bpe_stream.default_path())


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe_stream.default_path())


def ids(blob):
    return np.frombuffer(blob, "<u4").tolist()


ODD = [
    "", " ", "ΑΣ ΟΔΟΣ. İstanbul ﬁ é à́ é\x1c\x1fb c\x85d　e f", "a" * 5000, "aab" * 3000 + "'s",
    "<|endoftext|>x <|startoftext|>Y<|endoftext", "日本語のテキスト、" * 300, "ᲉꟜ\U00010d50x 👍🏽💪",
    "it's we'll I'm'd 12345 ½ Ⅷ '", "̇́ xͅ", "x y\u0085z \x0b\x0c w", "ͰΩΣς",
]


def test_odd_texts(own, library):
    texts = [t.encode() for t in ODD]
    whole = [library.encode(t, add_special_tokens=False).ids for t in ODD]
    assert [ids(x) for x in own.encode(texts)] == whole
    assert [ids(b"".join(own.blocks(t))) for t in texts] == whole
    for x in whole:
        blocks = [np.array(x[i : i + 7], "<u4").tobytes() for i in range(0, len(x), 7)]
        assert "".join(own.decoded(blocks)) == library.decode(x, skip_special_tokens=False)


def test_blocks_of_a_long_text(own, library, monkeypatch):
    monkeypatch.setattr(bpe_stream, "BLOCK_BYTES", 40)
    for t in ODD:
        assert ids(b"".join(own.blocks(t.encode()))) == library.encode(t, add_special_tokens=False).ids


CHARACTERS = st.sampled_from(list(" \n\t\x0b\x1cabzAZ019éÉΣσ漢🙂'._-!<|>́  ") + ["'ll", "<|endoftext|>", "ing", "İ"])


@settings(max_examples=400, deadline=None)
@given(st.lists(CHARACTERS, max_size=30))
def test_ids_of_the_library(parts):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(bpe_stream.default_path())
    text = "".join(parts)
    got = ids(bpe_stream.codec(bpe_stream.default_path()).encode([text.encode()])[0])
    assert got == library.encode(text, add_special_tokens=False).ids


def random_merges(rng):
    tokens, merges = list("ab"), []
    for _ in range(rng.randint(1, 9)):
        u, v = rng.choice(tokens), rng.choice(tokens)
        if u + v not in tokens:
            merges.append((u, v))
            tokens.append(u + v)
    return bpe_stream.Merges(merges)


def naive(merges, symbols):
    tokens = list(symbols)
    for u, v in merges.ranks:
        i = 0
        while i + 1 < len(tokens):
            if (tokens[i], tokens[i + 1]) == (u, v):
                tokens[i : i + 2] = [u + v]
            i += 1
    return tokens


def test_lookahead_is_sufficient():
    """No continuation changes a token that ends by the lookahead before the end."""
    rng = random.Random(3)
    used = set()
    for _ in range(150):
        merges = random_merges(rng)
        for _ in range(8):
            text = "".join(rng.choice("ab") for _ in range(rng.randint(1, 25)))
            tokens = merges.merged(list(text))
            assert tokens == merges._queued(list(text)) == naive(merges, text)
            end, stable = 0, []
            for token in tokens:
                end += len(token)
                if end <= len(text) - merges.lookahead:
                    stable.append(token)
            used.add(len(stable) > 0)
            for n in range(1, 6):
                for more in itertools.product("ab", repeat=n):
                    assert merges.merged(list(text + "".join(more)))[: len(stable)] == stable
    assert used == {True, False}


def test_transducer_emits_early_and_holds_little():
    rng = random.Random(4)
    for _ in range(60):
        merges = random_merges(rng)
        machine = bpe_stream.Transducer(merges)
        text = "".join(rng.choice("ab") for _ in range(600))
        out, most = [], 0
        for symbol in text:
            out += machine.feed(symbol)
            most = max(most, len(machine.held))
        assert most <= machine.window and out
        assert out + machine.finish() == naive(merges, text)
        assert machine.held == []


def test_unfit_merge_lists_are_refused():
    with pytest.raises(ValueError):
        bpe_stream.Merges([("ab", "c"), ("a", "b")])
    with pytest.raises(ValueError):
        bpe_stream.Merges([("a", "b"), ("ab", "c"), ("b", "c"), ("a", "bc")])


def test_unknown_ids_are_skipped(own, library):
    some = [320, 10**6, 49407, 2**31, 518]
    assert "".join(own.decoded([np.array(some, "<u4").tobytes()])) == library.decode([320, 49407, 518], skip_special_tokens=False)


def test_documents(spark, docs, no_docs, texts, library):
    whole = [library.encode(t or "", add_special_tokens=False).ids for _, t, _ in texts]
    encoded = bpe_stream.encode_documents(docs)
    assert encoded.columns == [*docs.columns, "tokens"]
    decoded = bpe_stream.decode_documents(encoded)
    got = sorted((r["doc_id"] or -1, r["tokens"], r["decoded"]) for r in decoded.collect())
    expected = [(i or -1, x, library.decode(x, skip_special_tokens=False)) for (i, _, _), x in zip(texts, whole, strict=True)]
    assert got == sorted(expected)
    digests = bpe_stream.round_trip(docs).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()

    def sha(b):
        return hashlib.sha256(b).hexdigest()

    assert sorted((r[0] or -1, *r[1:]) for r in digests) == sorted(
        (i, len(x), sha(np.array(x, "<u4").tobytes()), sha(t.encode())) for i, x, t in expected
    )
    for run in (bpe_stream.encode_documents, bpe_stream.round_trip):
        assert run(no_docs).count() == 0


def test_null_lists_decode_to_nothing(spark):
    rows = spark.createDataFrame([(1, None), (2, []), (3, [320])], "i long, tokens array<int>")
    assert [r["decoded"] for r in bpe_stream.decode_documents(rows).orderBy("i").collect()] == ["", "", "a</w>"]

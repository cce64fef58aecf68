"""Token files and packing against the tokenizer itself."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from platewise.llm import packing, token_files, tokens
from platewise.llm.common import new_folder


@pytest.fixture(scope="module")
def whole():
    """Ids of a whole text by the library in one call."""
    encoder = tokens.Encoder(tokens.default_path())
    return lambda t: encoder.tokenizer.encode(t or "", add_special_tokens=False).ids


CHARACTERS = st.sampled_from(list(" \n\t\r\x0b\x1c  abzAZ019é漢🙂'._-!<|>") + ["'ll", "<|endoftext|>", "  ", "\n\n"])


@settings(max_examples=400, deadline=None)
@given(st.lists(CHARACTERS, max_size=25))
def test_chunks_give_the_ids_of_the_whole(parts):
    encoder = tokens.encoder(tokens.default_path())
    text = "".join(parts)
    ids = np.frombuffer(encoder.encode([text.encode()])[0], np.uint32).tolist()
    assert ids == encoder.tokenizer.encode(text, add_special_tokens=False).ids


def test_caches_start_anew(whole, texts, monkeypatch):
    monkeypatch.setattr(tokens, "CACHED", 50)
    encoder = tokens.Encoder(tokens.default_path())
    for _, t, _ in texts:
        assert np.frombuffer(encoder.encode([(t or "").encode()])[0], np.uint32).tolist() == whole(t)


def ordered(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))


@pytest.mark.parametrize("encoding", ["delta", "dictionary"])
def test_token_files(spark, docs, texts, whole, encoding):
    path = new_folder(spark, "test-tokens")
    token_files.write_tokens(docs, path, encoding=encoding, row_group_bytes=1 << 16)
    rows = ordered(texts)
    got = token_files.read_tokens(spark, path).orderBy("start").collect()
    start = 0
    for r, (i, t, lang) in zip(got, rows, strict=True):
        ids = whole(t) + [0]
        assert (r["doc_id"], r["start"], r["n_tokens"], r["tokens"], r["lang"]) == (i, start, len(ids), ids, lang)
        start += len(ids)
    digests = token_files.with_crc32(token_files.read_tokens(spark, path), "tokens", "c")
    for r in digests.collect():
        own = next(g for g in got if g["start"] == r["start"])["tokens"]
        assert r["c"] == zlib.crc32(np.array(own, "<u4").tobytes())
    stream = [x for r in got for x in r["tokens"]]
    for a, b in ((0, 1), (5, 900), (start - 3, start + 9), (start, start + 1)):
        span = token_files.read_span(spark, path, a, b).orderBy("start").collect()
        assert [x for r in span for x in r["tokens"]] == stream[a:b]
        assert all(stream[r["start"]] == r["tokens"][0] for r in span)


def test_files_hold_encodings_and_page_indexes(spark, docs):
    import glob

    import pyarrow.parquet as pq

    for encoding, word in (("delta", "DELTA_BINARY_PACKED"), ("dictionary", "RLE_DICTIONARY")):
        path = new_folder(spark, "test-encoding")
        token_files.write_tokens(docs, path, encoding=encoding)
        for f in glob.glob(f"{path.removeprefix('file:')}/tokens/*.parquet"):
            group = pq.ParquetFile(f).metadata.row_group(0)
            columns = [group.column(i) for i in range(group.num_columns)]
            lists = next(c for c in columns if c.path_in_schema.startswith("tokens"))
            assert word in lists.encodings
            assert all(c.has_offset_index and c.has_column_index for c in columns if c.path_in_schema == "n_tokens")


def test_empty_tables(spark, no_docs):
    path = new_folder(spark, "test-empty")
    token_files.write_tokens(no_docs, path)
    assert token_files.read_tokens(spark, path).count() == 0
    assert packing.pack_documents(no_docs).count() == 0


def checked_plan(histogram, capacity):
    """Sequences of a plan as lists of (offset, length); every rank is placed once."""
    ranks, sequences = defaultdict(list), defaultdict(list)
    for r in packing.plan_packs(histogram, capacity):
        for k in range(r.count):
            ranks[r.length].append(r.rank + k)
            sequences[r.sequence + k].append((r.offset, r.length))
    assert {n: sorted(x) for n, x in ranks.items()} == {n: list(range(c)) for n, c in histogram.items()}
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return sequences


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 60), max_size=30))
def test_plans_are_whole(histogram):
    checked_plan(histogram, 64)


def test_plans_pad_little():
    rng = random.Random(1)
    histogram = Counter(rng.randint(1, 2048) for _ in range(20000))
    sequences = checked_plan(histogram, 2048)
    assert sum(n * c for n, c in histogram.items()) > 0.97 * 2048 * len(sequences)
    many = packing.plan_packs({1: 10**9, 2048: 10**8}, 2048)
    assert len(many) < 3000


def test_pack_documents(docs, texts, whole):
    capacity = 64
    packed = packing.pack_documents(docs, capacity).collect()
    sequences = defaultdict(list)
    for r in packed:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
        assert r["length"] == len(r["ids"])
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    want = Counter()
    for i, t, _ in texts:
        ids = whole(t) + [1]
        for k in range(0, len(ids), capacity):
            want[i, k, tuple(ids[k : k + capacity]), len(ids)] += 1
    assert Counter((r["doc_id"], r["start"], tuple(r["ids"]), r["doc_tokens"]) for r in packed) == want
    total = sum(r["length"] for r in packed)
    assert total > 0.9 * capacity * len(sequences)


def test_sequences_are_padded(docs):
    packed = packing.pack_documents(docs, 64)
    for r in packing.sequences(packed, 64, pad_id=9).collect():
        assert len(r["ids"]) == 64 and r["ids"][r["length"] :] == [9] * (64 - r["length"])
        assert sum(p["length"] for p in r["pieces"]) == r["length"]

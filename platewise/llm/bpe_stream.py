"""BPE encoding by a streaming transducer with bounded lookahead, and its inverse.

**Lookahead.** A merge list whose merges only use what earlier ones made works like one
pass over the text per merge, in order. Compare the passes over a text ``w`` and over any
text that goes on after ``w``. Before the first pass both have a boundary at the end of
``w`` and agree up to it. A merge ``u v`` can only break this where ``u`` ends at the last
common boundary and ``v`` follows it in one of the two; then they agree up to the place
before ``u``. The next break needs a later merge ``u' v'`` whose ``u'`` ends at that place and
whose ``v'`` begins there, so ``v'`` has ``u`` at its left edge. The lookahead of the list is
the greatest sum of the lengths of the ``u`` along such a chain of merges, which one pass over
the list computes. A token of ``w`` that ends by that much before the end of ``w`` is a token
of every text that begins with ``w``: it is stable.

**Encoder.** The transducer holds symbols that are not yet emitted. Once there are enough, they
are merged, the stable tokens are emitted and their symbols forgotten, since what follows a
token boundary does not depend on what was before it. It so keeps a fixed number of
symbols, however long a word is. The last symbol of a word carries the suffix that the
vocabulary writes at the end of words; it is fed when the word ends. Texts are read in blocks
cut at white space; words and stretches without white space seen before come from bounded
caches, which only save time.

**Decoder.** Ids become the bytes of their vocabulary entries, and an incremental UTF-8 machine,
which keeps at most three bytes, turns them into text. Entries are joined by a blank where the
file names no decoder, as the tokenizers library does; else by that of the file.

Null texts count as empty and have no ids. Special tokens written in a text are read as the
library reads them by default. Documents are rows: equal or absent ids change nothing, and
every column stays; columns called like those added are replaced. Empty tables give empty
tables. A merge list that is not ordered as above, and a file with steps other than those
known here, are refused with ``ValueError``.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import json
import re
import sys
import unicodedata
from array import array
from collections.abc import Iterable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from platewise.llm.common import (
    arrow_schema,
    importable,
    replaced,
    slices,
    table,
    with_columns,
)
from platewise.llm.tokens import Kept, byte_letters, class_changes
from platewise.llm.words import distinct, spread, table_of

DEFAULT_TOKENIZER = "word_bpe_49k.json"
#: Chunks, and words, of each of the two generations that a worker keeps.
CACHED = 500_000
BLOCK_BYTES = 4 << 20
#: Ids that are decoded at a time.
BLOCK_IDS = 1 << 16

_BLANK = re.compile(rb"[ \t\n\r\f\v]")
#: White space becomes a blank.
_TABLE = table_of(lambda c: c != 32 and not 9 <= c <= 13, lower=False)
#: Characters on whose properties all Unicode versions in use agree.
_OLD = re.compile(r"[\x00-\u0557]*")


class Merges:
    """A merge list with its ranks and its lookahead, in symbols."""

    def __init__(self, merges: list[tuple[str, str]], suffix: str = "") -> None:
        self.ranks = {pair: i for i, pair in enumerate(merges)}
        self.suffix = suffix
        made = {u + v: i for i, (u, v) in enumerate(merges)}
        if len(made) < len(merges):
            raise ValueError("two merges make the same token")
        for i, (u, v) in enumerate(merges):
            for x in (u, v):
                if made.get(x, -1) >= i:
                    raise ValueError(f"merge {i} uses {x!r} before it is made")
        size: dict[str, int] = {}

        def length(x: str) -> int:
            return size.get(x, 1)

        left: dict[str, str] = {}
        #: The greatest sum of lengths of a chain whose last merge has this left side.
        reach: dict[str, int] = {}
        self.lookahead = 0
        for u, v in merges:
            size[u + v] = length(u) + length(v)
            left[u + v] = u
            before, edge = 0, v
            while edge is not None:
                before = max(before, reach.get(edge, 0))
                edge = left.get(edge)
            reach[u] = max(reach.get(u, 0), length(u) + before)
            self.lookahead = max(self.lookahead, reach[u])
        self.longest = max(size.values(), default=1)
        self.size = size

    def merged(self, symbols: list[str]) -> list[str]:
        """Tokens of a run of symbols: the first merge of the list goes first, from left to
        right. Short runs by scans, longer ones by a queue of pairs."""
        if len(symbols) > 24:
            return self._queued(symbols)
        rank_of, none = self.ranks.get, len(self.ranks)
        tokens = list(symbols)
        ranks = [rank_of(pair, none) for pair in zip(tokens, tokens[1:])]
        while ranks and (best := min(ranks)) < none:
            i = ranks.index(best)
            tokens[i] += tokens.pop(i + 1)
            del ranks[i]
            if i < len(ranks):
                ranks[i] = rank_of((tokens[i], tokens[i + 1]), none)
            if i:
                ranks[i - 1] = rank_of((tokens[i - 1], tokens[i]), none)
        return tokens

    def _queued(self, symbols: list[str]) -> list[str]:
        ranks, n = self.ranks, len(symbols)
        token: list[str | None] = list(symbols)
        after = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        queue = [(r, i, i + 1) for i in range(n - 1) if (r := ranks.get((token[i], token[i + 1]))) is not None]
        heapq.heapify(queue)
        while queue:
            rank, i, j = heapq.heappop(queue)
            # A place that was merged on has another neighbour or another token by now.
            if token[i] is None or after[i] != j or ranks.get((token[i], token[j])) != rank:
                continue
            token[i] += token[j]
            token[j] = None
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := ranks.get((token[i], token[k]))) is not None:
                    heapq.heappush(queue, (r, i, k))
            if (h := before[i]) >= 0 and (r := ranks.get((token[h], token[i]))) is not None:
                heapq.heappush(queue, (r, h, i))
        return [t for t in token if t is not None]


class Transducer:
    """Symbols in, stable tokens out. Holds at most ``window`` symbols and one block."""

    def __init__(self, merges: Merges) -> None:
        self.merges = merges
        self.window = 2 * (merges.lookahead + merges.longest)
        self.held: list[str] = []

    def feed(self, symbols: str) -> list[str]:
        """Takes symbols and gives the tokens that no later symbol can change. The last
        symbol is held back: it may turn out to be the end of the word."""
        out: list[str] = []
        merges = self.merges
        for begin in range(0, len(symbols), self.window):
            self.held.extend(symbols[begin : begin + self.window])
            while len(self.held) > self.window:
                end, stable = 0, self.window - merges.lookahead
                for token in merges.merged(self.held[: self.window]):
                    if end + merges.size.get(token, 1) > stable:
                        break
                    end += merges.size.get(token, 1)
                    out.append(token)
                del self.held[:end]
        return out

    def finish(self) -> list[str]:
        """The end of the word: the rest of its tokens."""
        rest, self.held = self.held, []
        if not rest:
            return []
        rest[-1] += self.merges.suffix
        return self.merges.merged(rest)


class Codec:
    """Encoder and decoder of a tokenizer file for words in lower case."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            described = json.load(f)
        model = described["model"]
        self._check(described)
        self.suffix = model.get("end_of_word_suffix") or ""
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.merges = Merges(pairs, self.suffix)
        self.vocabulary: dict[str, int] = model["vocab"]
        self.added = {t["content"].encode(): t["id"] for t in described.get("added_tokens", [])}
        self.cut_added = (
            re.compile(b"|".join(re.escape(a) for a in sorted(self.added, key=len, reverse=True)))
            if self.added
            else None
        )
        words = next(s for s in described["pre_tokenizer"]["pretokenizers"] if s["type"] == "Split")
        self.pattern = regex.compile(words["pattern"]["Regex"])
        # The same for lower-case ASCII text, for the faster module.
        plain = words["pattern"]["Regex"].replace(r"[\p{L}]", "[a-z]").replace(r"[\p{N}]", "[0-9]")
        plain = plain.replace(r"\p{L}", "a-z").replace(r"\p{N}", "0-9")
        if "\\p" in plain:
            raise ValueError("the tokenizer file has a pattern that is not known here")
        self.plain_pattern = re.compile(plain, re.ASCII)
        self.letters = str.maketrans(byte_letters())
        self.path = path
        self.library = None
        self.transducer = Transducer(self.merges)
        self.chunks = Kept(self._chunk)
        self.words = Kept(self._word)
        by_id = {i: t.encode() for t, i in self.vocabulary.items()} | {i: t for t, i in self.added.items()}
        self.known = np.zeros(max(by_id, default=-1) + 1, bool)
        self.known[list(by_id)] = True
        self.texts = [by_id.get(i, b"") for i in range(len(self.known))]

    @staticmethod
    def _check(described: dict) -> None:
        model, normal, pre = described["model"], described["normalizer"], described["pre_tokenizer"]
        steps = [s["type"] for s in (normal or {}).get("normalizers", [])]
        cuts = [s["type"] for s in (pre or {}).get("pretokenizers", [])]
        plain = not (
            model.get("dropout") or model.get("byte_fallback") or model.get("ignore_merges")
            or model.get("unk_token") or model.get("continuing_subword_prefix")
        )
        added = all(
            not (t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"])
            for t in described.get("added_tokens", [])
        )
        if (
            model["type"] != "BPE" or not plain or not added
            or steps != ["NFC", "Replace", "Lowercase"] or cuts != ["Split", "ByteLevel"]
            or described.get("decoder") is not None
        ):
            raise ValueError("the tokenizer file has steps that are not known here")

    # Encoding

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Ids of texts as little-endian unsigned 32-bit integers."""
        plain = [len(t) <= BLOCK_BYTES and not (self.cut_added and self.cut_added.search(t)) for t in texts]
        together = iter(self._together([t for t, p in zip(texts, plain, strict=True) if p]))
        return [next(together) if p else b"".join(self.blocks(t)) for t, p in zip(texts, plain, strict=True)]

    def blocks(self, text: bytes) -> Iterator[bytes]:
        """Ids of a text, block by block."""
        at, end = 0, len(text)
        while at < end:
            found = self.cut_added.search(text, at) if self.cut_added else None
            stop = found.start() if found else end
            while at < stop:
                cut = stop
                if stop - at > BLOCK_BYTES:
                    blank = _BLANK.search(text, at + BLOCK_BYTES, stop)
                    cut = blank.start() if blank else stop
                yield self._together([text[at:cut]])[0]
                at = cut
            if found:
                yield _packed([self.added[found[0]]])
                at = found.end()

    def _together(self, texts: list[bytes]) -> list[bytes]:
        """Each distinct stretch without white space, cut where ASCII letters, digits and signs
        meet, is encoded once for all its places."""
        self.chunks, self.words = self.chunks.bounded(CACHED), self.words.bounded(CACHED)
        raw = np.frombuffer(b"".join(texts).translate(_TABLE), np.uint8)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        ends = np.cumsum(sizes)
        inside = raw != 32
        begins = class_changes(raw)
        begins[1:] |= ~inside[:-1]
        begins[(ends - sizes)[sizes > 0]] = True
        starts = np.flatnonzero(begins & inside)
        places = np.concatenate([[0], np.cumsum(inside)])[np.append(starts, len(raw))]
        chunks, which = distinct(raw[inside], places)
        ids, n = spread([self.chunks[c] for c in chunks], which)
        before = np.concatenate([[0], np.cumsum(n)])
        stops = (before[np.searchsorted(starts, ends)] * 4).tolist()
        data = ids.tobytes()
        return [data[a:b] for a, b in zip([0, *stops], stops, strict=False)]

    def _chunk(self, chunk: bytes) -> bytes:
        """Ids of such a stretch. Nothing in it composes, or makes a word, with what lies
        beyond."""
        text, pattern = chunk.decode(), self.plain_pattern
        if not text.isascii():
            if not _OLD.fullmatch(text) and any(unicodedata.category(c) == "Cn" for c in set(text)):
                return b"".join(map(self._symbols, self._by_library(text)))
            # In lower case letter by letter: the form of sigma at the end of a word is not used.
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
            pattern = self.pattern
        elif text.isalpha():
            return self.words[text.lower()]
        return b"".join([self.words[m[0]] for m in pattern.finditer(text.lower())])

    def _by_library(self, text: str) -> Iterable[str]:
        """Symbols of the words of a text with characters that this Python does not know and
        the library may."""
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_file(self.path)
        normal = self.library.normalizer.normalize_str(text)
        return [word for word, _ in self.library.pre_tokenizer.pre_tokenize_str(normal)]

    def _word(self, word: str) -> bytes:
        if not (word.isascii() and word.isprintable()):
            word = word.encode().decode("latin-1").translate(self.letters)
        return self._symbols(word)

    def _symbols(self, symbols: str) -> bytes:
        ids = self.vocabulary
        tokens = self.transducer.feed(symbols) + self.transducer.finish()
        return _packed([ids[t] for t in tokens if t in ids])

    # Decoding

    def decoded(self, blocks: Iterable[bytes]) -> Iterator[str]:
        """Text of a stream of ids, block by block; blocks may end anywhere between ids."""
        machine = codecs.getincrementaldecoder("utf-8")("replace")
        first = True
        for block in blocks:
            whole = np.frombuffer(block, "<u4")
            for begin in range(0, len(whole), BLOCK_IDS):
                ids = whole[begin : begin + BLOCK_IDS]
                if ids.max() >= len(self.known) or not self.known[ids].all():
                    ids = ids[ids < len(self.known)]
                    ids = ids[self.known[ids]]
                if len(ids):
                    joined = b" ".join(map(self.texts.__getitem__, ids.tolist()))
                    yield machine.decode(joined if first else b" " + joined)
                    first = False
        yield machine.decode(b"", final=True)


def _packed(ids: list[int]) -> bytes:
    packed = array("I", ids)
    if sys.byteorder == "big":
        packed.byteswap()
    return packed.tobytes()


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(DEFAULT_TOKENIZER)


_CODECS: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """The worker's codec for a tokenizer file."""
    if path not in _CODECS:
        _CODECS[path] = Codec(path)
    return _CODECS[path]


def encode_documents(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """All documents with ``tokens``, the list of ids of ``text``."""
    schema = with_columns(docs, ("tokens", "array<int>"))
    run = partial(_encode, path=tokenizer or default_path(), schema=arrow_schema(schema))
    return importable(docs).mapInArrow(run, schema)


def _encode(batches: Iterator[pa.RecordBatch], path: str, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    own = codec(path)
    for batch, texts in slices(batches, "text", BLOCK_BYTES):
        ids = own.encode(texts)
        offsets = np.concatenate([[0], np.cumsum([len(x) // 4 for x in ids])]).astype(np.int32)
        values = np.frombuffer(b"".join(ids), np.int32)
        lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))
        yield replaced(batch, schema, tokens=lists.cast(schema.field("tokens").type))


def decode_documents(encoded: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """The rows with ``decoded``, the text of the list ``tokens`` (null: empty)."""
    schema = with_columns(encoded, ("decoded", "string"))
    run = partial(_decode, path=tokenizer or default_path(), schema=arrow_schema(schema))
    return importable(encoded).mapInArrow(run, schema)


def _decode(batches: Iterator[pa.RecordBatch], path: str, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    own = codec(path)
    for batch in batches:
        lists = batch.column("tokens")
        for i in range(len(lists)):
            # A row at a time: a text may be long.
            ids = lists[i].values.to_numpy() if lists[i].is_valid else np.zeros(0, np.int32)
            text = "".join(own.decoded([ids.astype("<u4").tobytes()]))
            yield replaced(batch.slice(i, 1), schema, decoded=[text])


def round_trip(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Every document encoded and decoded again in one stream, of which nothing but
    ``n_tokens``, ``ids_sha256`` and ``decoded_sha256`` is kept, in place of ``text``."""
    added = (("n_tokens", "long"), ("ids_sha256", "string"), ("decoded_sha256", "string"))
    schema = with_columns(docs.drop("text"), *added)
    run = partial(_round_trip, path=tokenizer or default_path(), schema=arrow_schema(schema))
    return importable(docs).mapInArrow(run, schema)


def _round_trip(
    batches: Iterator[pa.RecordBatch], path: str, schema: pa.Schema
) -> Iterator[pa.RecordBatch]:
    own = codec(path)
    for batch, texts in slices(batches, "text", BLOCK_BYTES):
        if len(texts) == 1:
            found = [_digests(own, own.blocks(texts[0]))]
        else:
            found = [_digests(own, [ids]) for ids in own.encode(texts)]
        n, ids, decoded = zip(*found, strict=True)
        yield replaced(batch, schema, n_tokens=list(n), ids_sha256=list(ids), decoded_sha256=list(decoded))


def _digests(own: Codec, blocks: Iterable[bytes]) -> tuple[int, str, str]:
    """About a stream of ids: their number, and checksums of them and of the decoded text."""
    of_ids, of_text, size = hashlib.sha256(), hashlib.sha256(), 0

    def passing() -> Iterator[bytes]:
        nonlocal size
        for block in blocks:
            of_ids.update(block)
            size += len(block)
            yield block

    for piece in own.decoded(passing()):
        of_text.update(piece.encode())
    return size // 4, of_ids.hexdigest(), of_text.hexdigest()


def op12_bpe_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return round_trip(docs).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")

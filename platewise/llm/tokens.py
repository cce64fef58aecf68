"""Token ids of whole texts by a byte-level tokenizer, with caches of what it gave.

Texts are cut before every blank or line feed that follows a visible character, and where
ASCII letters, digits and signs meet. A byte-level pattern gives the last character of white
space to what follows or makes it a piece of its own, and keeps those three apart, so the ids of
a text are those of its chunks one after another. Each distinct
chunk of a batch of texts is encoded once, and its ids are laid out for all its places at once;
most chunks come again in later batches. A new chunk is split by the tokenizer's pattern, and
the model is asked for new pieces only.
"""

from __future__ import annotations

import os
import re
from array import array

import numpy as np
import regex

from platewise.llm.words import distinct, spread

DEFAULT_TOKENIZER = "byte_bpe_50k.json"
#: Chunks, and pieces, of each of the two generations that a worker keeps: at more, the
#: older goes and what comes again is taken over. Only speed depends on it.
CACHED = 500_000
#: Longer chunks and pieces are not kept.
CACHED_BYTES = 128
#: Texts are encoded together up to so many bytes, a longer one in blocks of them.
BLOCK_BYTES = 4 << 20

#: A place where a text may be cut, found from bytes alone.
_CUT = re.compile(rb"(?<=[\x21-\x7e])[ \n]")
#: Characters on whose class every Unicode version agrees.
_PLAIN = regex.compile(r"[\x00-\u024f]*")
#: The tokenizer's pattern for ASCII text.
_ASCII = re.compile(
    r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+", re.ASCII
)


class Kept(dict):
    """What ``make`` gives, kept for short keys, in two generations."""

    def __init__(self, make, before: dict | None = None) -> None:
        self.make, self.before = make, before or {}

    def __missing__(self, key):
        found = self.before.get(key)
        if found is None:
            found = self.make(key)
        if len(key) <= CACHED_BYTES:
            self[key] = found
        return found

    def bounded(self, most: int) -> Kept:
        """This, or a new generation if there are more entries."""
        return Kept(self.make, dict(self)) if len(self) > most else self


def _class(byte: int) -> int:
    """1 for letters, 2 for digits, 3 for signs that are pieces whatever follows; else 0."""
    if not 33 <= byte <= 126 or byte == 39:
        return 0
    return 1 if chr(byte).isalpha() else 2 if chr(byte).isdigit() else 3


_CLASS = np.array([_class(b) for b in range(256)], np.uint8)


def class_changes(raw: np.ndarray) -> np.ndarray:
    """Where a letter, digit or sign of ASCII follows one of another of these classes."""
    kind = _CLASS[raw]
    out = np.zeros(len(raw), bool)
    out[1:] = (kind[1:] != kind[:-1]) & (kind[1:] > 0) & (kind[:-1] > 0)
    return out


def cuts(raw: np.ndarray) -> np.ndarray:
    """Which places may be cut: before blanks and line feeds that follow a visible character, and
    between letters, digits and signs of ASCII, which the pattern never puts in one piece, but
    beside no apostrophe. Where the character before a blank may be white space beyond ASCII
    there is no cut, which is always right."""
    cut = class_changes(raw)
    at = np.flatnonzero((raw == 32) | (raw == 10))
    at = at[at > 0]
    last = raw[at - 1]
    visible = (last > 32) & (last != 127)
    high = np.flatnonzero(last >= 128)
    before = at[high]
    # Lead bytes of all white space beyond ASCII.
    two, three = raw[np.maximum(before - 2, 0)], raw[np.maximum(before - 3, 0)]
    visible[high] = (two != 0xC2) & ((three < 0xE1) | (three > 0xE3))
    cut[at[visible]] = True
    return cut


class Encoder:
    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import json

        import public_tokenizers
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        with open(path, encoding="utf-8") as f:
            described = json.load(f)
        step = described.get("pre_tokenizer") or {}
        #: Whether pieces can be cut here; otherwise the library gets whole texts.
        self.byte_level = (
            step.get("type") == "ByteLevel"
            and step.get("use_regex", True)
            and not step.get("add_prefix_space")
            and described.get("normalizer") is None
        )
        self.added = [t["content"].encode() for t in described.get("added_tokens", [])]
        self.pattern = regex.compile(public_tokenizers.PATTERN)
        self.letters = str.maketrans(byte_letters())
        self.blank = chr(self.letters[32])
        self.chunks = Kept(self._chunk)
        self.pieces = Kept(self._piece)

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        plain = [self.byte_level and not any(a in t for a in self.added) for t in texts]
        short = [i for i, t in enumerate(texts) if plain[i] and len(t) <= BLOCK_BYTES]
        out = dict(zip(short, self._together([texts[i] for i in short]), strict=True))
        for i, text in enumerate(texts):
            if not plain[i]:
                out[i] = self._whole(text.decode())
            elif i not in out:
                out[i] = b"".join([self._together([b])[0] for b in _blocks(text)])
        return [out[i] for i in range(len(texts))]

    def _together(self, texts: list[bytes]) -> list[bytes]:
        self.chunks, self.pieces = self.chunks.bounded(CACHED), self.pieces.bounded(CACHED)
        joined = b"".join(texts)
        ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))
        edge = np.append(cuts(np.frombuffer(joined, np.uint8)), True)
        edge[0] = True
        edge[ends] = True
        places = np.flatnonzero(edge)
        chunks, which = distinct(joined, places)
        ids, n = spread([self.chunks[c] for c in chunks], which)
        # Ids before each place, and so before the end of each text.
        before = np.concatenate([[0], np.cumsum(n)])
        stops = before[np.searchsorted(places, ends)] * 4
        data = ids.tobytes()
        return [data[a:b] for a, b in zip([0, *stops[:-1]], stops, strict=False)]

    def _whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _chunk(self, chunk: bytes) -> bytes:
        text = chunk.decode()
        if text.isascii():
            found = _ASCII.findall(text)
        elif _PLAIN.fullmatch(text):
            found = self.pattern.findall(text)
        else:
            return self._whole(text)
        if len(found) == 1:
            return self._piece(text)
        return b"".join([self.pieces[p] for p in found])

    def _piece(self, piece: str) -> bytes:
        if piece.isascii() and piece.isprintable():
            letters = piece.replace(" ", self.blank)
        else:
            letters = piece.encode().decode("latin-1").translate(self.letters)
        return array("I", [t.id for t in self.model.tokenize(letters)]).tobytes()


def _blocks(text: bytes) -> list[bytes]:
    """The text in blocks, each ending where it may be cut."""
    out, begin = [], 0
    while begin < len(text):
        cut = _CUT.search(text, begin + BLOCK_BYTES)
        end = cut.start() if cut else len(text)
        out.append(text[begin:end])
        begin = end
    return out


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(DEFAULT_TOKENIZER)


def byte_letters() -> dict[int, int]:
    """The letter that byte-level vocabularies write for each byte: itself if it is
    visible in Latin-1, else the next one from 256 on."""
    visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in visible]
    return {b: 256 + i for i, b in enumerate(hidden)}


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder for a tokenizer file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]

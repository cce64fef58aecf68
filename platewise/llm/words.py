"""Words of many texts at once, and hashes of words and of runs of words, in numpy.

Hashes are polynomials modulo 2**64 over random values, mixed at the end. They choose
candidates and keys; what depends on them says so.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa

_BASE = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0xC2B2AE3D27D4EB4F)
#: Bytes, or words, that are hashed at a time.
_BLOCK = 1 << 19


def distinct(data: bytes | np.ndarray, offsets: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    """The distinct ones of the runs of bytes between ``offsets``, and which of them each is."""
    buffers = [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data)]
    runs = pa.Array.from_buffers(pa.binary(), len(offsets) - 1, buffers).dictionary_encode()
    return runs.dictionary.to_pylist(), runs.indices.to_numpy()


def spread(parts: list[bytes], which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of a sequence of parts, given by number, from the ids of each part as 32-bit
    integers; and how many ids each element of the sequence has."""
    sizes = np.fromiter(map(len, parts), np.int64, len(parts)) // 4
    values = np.frombuffer(b"".join(parts), "<u4")
    first = np.cumsum(sizes) - sizes
    n = sizes[which]
    at = np.repeat(first[which] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
    return values[at], n


def table_of(word_byte, lower: bool) -> bytes:
    """256 bytes for ``bytes.translate``: separators become a blank, words stay."""
    out = bytearray(b" " * 256)
    for b in range(256):
        c = b + 32 if lower and 65 <= b <= 90 else b
        if word_byte(c):
            out[b] = c
    return bytes(out)


#: Words of ASCII letters and digits and of all that is beyond ASCII, A-Z in lower case.
ALNUM = table_of(lambda c: c >= 128 or 48 <= c <= 57 or 97 <= c <= 122, lower=True)


@lru_cache(maxsize=None)
def _byte_values() -> np.ndarray:
    return np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64)


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(base: np.uint64, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and its inverse modulo 2**64 for i < n."""
    key = int(base)
    if key not in _POWERS or len(_POWERS[key][0]) < n:
        size = 1 << max(16, (n - 1).bit_length())
        both = []
        for b in (base, np.uint64(pow(key, -1, 2**64))):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            both.append(np.multiply.accumulate(p))
        _POWERS[key] = tuple(both)
    up, down = _POWERS[key]
    return up[:n], down[:n]


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


@dataclass
class Words:
    """Words of a list of texts, one after another."""

    joined: bytes  #: words joined by one blank, texts by one line feed
    starts: np.ndarray  #: first byte of each word in ``joined``
    ends: np.ndarray
    first: np.ndarray  #: index of the first word of each text, and the number of all words

    @classmethod
    def of(cls, texts: list[bytes], table: bytes | None = None) -> Words:
        """``table`` None: words between ASCII white space, else a table of ``table_of``."""
        lists = [(t if table is None else t.translate(table)).split() for t in texts]
        first = np.zeros(len(texts) + 1, np.int64)
        np.cumsum([len(x) for x in lists], out=first[1:])
        joined = b"\n".join([b" ".join(x) for x in lists])
        raw = np.frombuffer(joined, np.uint8)
        ends = np.append(np.flatnonzero((raw == 32) | (raw == 10)), len(raw))
        starts = np.empty_like(ends)
        starts[0] = 0
        starts[1:] = ends[:-1] + 1
        full = starts < ends
        return cls(joined, starts[full], ends[full], first)

    def __len__(self) -> int:
        return len(self.starts)

    def hashes(self) -> np.ndarray:
        """One hash per word. Bytes are read in blocks, so that the working memory does
        not grow with a text."""
        raw = np.frombuffer(self.joined, np.uint8)
        out = np.empty(len(self), np.uint64)
        begin = 0
        while begin < len(self):
            base = int(self.starts[begin])
            end = max(begin + 1, int(np.searchsorted(self.ends, base + _BLOCK, side="right")))
            starts, ends = self.starts[begin:end] - base, self.ends[begin:end] - base
            block = raw[base : base + int(ends[-1])]
            up, down = _powers(_BASE, len(block) + 1)
            sums = np.zeros(len(block) + 1, np.uint64)
            np.cumsum(_byte_values()[block] * up[:-1], out=sums[1:])
            out[begin:end] = mixed((sums[ends] - sums[starts]) * down[starts])
            begin = end
        return out

    def left(self) -> np.ndarray:
        """Words from each word to the end of its text, itself included."""
        counts = np.diff(self.first)
        return np.repeat(self.first[1:], counts) - np.arange(len(self))

    def run(self, word: int, n: int) -> bytes:
        """``n`` words from ``word`` on, joined by one blank."""
        return self.joined[self.starts[word] : self.ends[word + n - 1]]


def run_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """A hash of each ``n`` consecutive words; the last n - 1 places have none."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64)
    out = np.empty(len(hashes) - n + 1, np.uint64)
    up, down = _powers(_STEP, min(len(hashes), _BLOCK + n) + 1)
    for begin in range(0, len(out), _BLOCK):
        part = hashes[begin : begin + _BLOCK + n - 1]
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(part * up[: len(part)], out=sums[1:])
        runs = len(part) - n + 1
        out[begin : begin + runs] = mixed((sums[n:] - sums[:-n]) * down[:runs])
    return out


def covered(length: int, starts: np.ndarray, n: np.ndarray | int) -> np.ndarray:
    """Which of ``length`` places lie in one of the runs of ``n`` from ``starts``."""
    steps = np.zeros(length + 1, np.int64)
    np.add.at(steps, starts, 1)
    np.add.at(steps, starts + n, -1)
    return np.cumsum(steps[:-1]) > 0


#: Which bytes belong to words between ASCII white space.
_VISIBLE = np.array([not (b == 32 or 9 <= b <= 13) for b in range(256)])


def without(text: bytes, runs: list[tuple[int, int]], table: bytes | None = None) -> bytes:
    """The text without the words of ``runs`` (begin, end), each run cut up to the next
    word that stays. ``table`` as in ``Words.of``."""
    raw = np.frombuffer(text, np.uint8)
    inside = _VISIBLE if table is None else np.frombuffer(table, np.uint8) != 32
    word = np.concatenate([[False], inside[raw]])
    starts = np.append(np.flatnonzero(~word[:-1] & word[1:]), len(text)).tolist()
    out, at = [], 0
    for begin, end in runs:
        out.append(text[at : starts[begin]])
        at = starts[end]
    return b"".join([*out, text[at:]])

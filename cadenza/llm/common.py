"""What the text operators share: row tags and word hashing over Arrow batches.

Words are hashed from the UTF-8 buffer of a whole slice of rows at once, so no Python object is
made per word. Two independent 64-bit families are available; operators that must not confuse two
texts use both.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bytes of text that are worked on together inside a task.
SLICE_BYTES = 2_000_000
#: Bits of a row's text hash that tell rows with one doc_id apart.
TEXT_BITS = 31
_SPACE = bytes(range(0x09, 0x0E)) + b" "


# ---------------------------------------------------------------- rows
def row_tag(text: Column) -> Column:
    """A hash of the text below 2**TEXT_BITS: with doc_id it names a row, even if ids repeat."""
    return F.xxhash64(F.coalesce(text, F.lit(""))).bitwiseAND(F.lit((1 << TEXT_BITS) - 1))


# ---------------------------------------------------------------- words of a slice of rows
@dataclass(frozen=True)
class Alphabet:
    """Which bytes belong to words, and whether A-Z are lower-cased before hashing."""

    word_bytes: bytes
    lower: bool

    @property
    def tables(self) -> tuple[np.ndarray, np.ndarray]:
        return _tables(self)


@lru_cache(maxsize=None)
def _tables(alphabet: Alphabet) -> tuple[np.ndarray, np.ndarray]:
    inside = np.zeros(256, bool)
    inside[np.frombuffer(alphabet.word_bytes, np.uint8)] = True
    to = np.arange(256, dtype=np.uint8)
    if alphabet.lower:
        to[ord("A") : ord("Z") + 1] += 32
    return inside, to


_BLANK_SPLIT = bytes(b for b in range(256) if b not in _SPACE)
#: Words [^\x20\x09-\x0D]+ as they are, and with A-Z lower-cased.
PLAIN = Alphabet(_BLANK_SPLIT, False)
FOLDED = Alphabet(_BLANK_SPLIT, True)
#: Words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after lower-casing A-Z: letters, digits and all above ASCII.
ALNUM = Alphabet(bytes([*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 256)]), True)

_BASE = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F], np.uint64)
_BYTE_CODES = np.random.Generator(np.random.PCG64(20240101)).integers(1, 2**63, (2, 256), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _inverse(x: int) -> int:
    return pow(x, -1, 1 << 64)


class _Powers:
    """Powers of an odd base and of its inverse modulo 2**64, grown as needed."""

    def __init__(self, base: int):
        self.base, self.up, self.down = base, np.ones(1, np.uint64), np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        while len(self.up) < n:
            m = len(self.up)
            step, back = pow(self.base, m, 1 << 64), pow(_inverse(self.base), m, 1 << 64)
            self.up = np.concatenate([self.up, self.up * np.uint64(step)])
            self.down = np.concatenate([self.down, self.down * np.uint64(back)])
        return self.up[:n], self.down[:n]


_POWERS = [_Powers(int(b)) for b in _BASE]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, family: int = 0) -> np.ndarray:
    """A 64-bit hash of each span data[start:end], from one running sum over the buffer."""
    up, down = _POWERS[family].upto(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE_CODES[family][data] * up[:-1], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64) * np.uint64(0x94D049BB133111EB))


def sequence_hashes(codes: np.ndarray, k: int, family: int = 0) -> np.ndarray:
    """A hash of every k consecutive codes (none if there are fewer)."""
    n = len(codes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    base = np.uint64(0xD6E8FEB86659FD93 if family == 0 else 0xA0761D6478BD642F)
    for j in range(k):
        out = out * base + codes[j : j + n]
    return mix(out + np.uint64(k))


@dataclass
class Words:
    """The words of a slice of rows: one entry per word, rows in order."""

    data: np.ndarray  # bytes, lower-cased if the alphabet says so
    bounds: np.ndarray  # row i holds data[bounds[i]:bounds[i+1]]
    starts: np.ndarray
    ends: np.ndarray
    row: np.ndarray  # row of each word
    first: np.ndarray  # row i holds the words first[i]:first[i+1]

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def hashes(self, family: int = 0) -> np.ndarray:
        return span_hashes(self.data, self.starts, self.ends, family)

    def whole(self, k: int) -> np.ndarray:
        """Whether the k words from each word on lie in one row (for len - k + 1 starts)."""
        n = len(self.row) - k + 1
        return self.row[:n] == self.row[k - 1 :] if n > 0 else np.zeros(0, bool)


def words_of(data: np.ndarray, bounds: np.ndarray, alphabet: Alphabet) -> Words:
    inside, to = alphabet.tables
    data = to[data]
    mask = inside[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[bounds] = True  # a word never runs on into the next row
    before = np.zeros(len(data) + 1, bool)
    before[1:] = mask
    after = np.zeros(len(data) + 1, bool)
    after[:-1] = mask
    starts = np.flatnonzero(after & (~before | edge))
    ends = np.flatnonzero(before & (~after | edge))
    first = np.searchsorted(starts, bounds)
    row = np.repeat(np.arange(len(bounds) - 1), np.diff(first))
    return Words(data, bounds, starts, ends, row, first)


def slices(text: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of rows (from, to, bytes, bounds) of about SLICE_BYTES; null texts are empty."""
    if isinstance(text, pa.ChunkedArray):
        text = text.combine_chunks()
    text = text.fill_null("").cast(pa.large_string())
    if not len(text):
        return
    _, offsets, buffer = text.buffers()
    offsets = np.frombuffer(offsets, np.int64)[text.offset : text.offset + len(text) + 1]
    data = np.frombuffer(buffer, np.uint8) if buffer is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(text):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + SLICE_BYTES, side="right")) - 1)
        yield at, to, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


def sums(values: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    """Sum of values by row."""
    return np.bincount(row, values, n).astype(np.int64)


def covered(hit: np.ndarray, k: int) -> np.ndarray:
    """Which of len(hit) + k - 1 places lie in a window of k that starts at a hit."""
    step = np.zeros(len(hit) + k, np.int64)
    step[: len(hit)] += hit
    step[k : k + len(hit)] -= hit
    return np.cumsum(step)[:-1] > 0 if len(hit) else np.zeros(0, bool)


def lists(values: pa.Array, counts: np.ndarray) -> pa.Array:
    """A list column: the values dealt out by the counts."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), values)


def range_hashes(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray, family: int = 0) -> np.ndarray:
    """A hash of the codes of each range [start, end)."""
    up, down = _POWERS[family].upto(len(codes) + 1)
    total = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(codes * up[:-1], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))

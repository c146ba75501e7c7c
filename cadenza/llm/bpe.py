"""Byte-level BPE over Arrow batches, from a public vocabulary file.

A text is split into pieces (a word with its leading space, a number, a run of signs, blanks) and
each distinct piece is encoded once; tokens of the texts are then gathered by piece. The split is
done for a whole slice of rows at once on character classes; `tests/llm` hold it equal to the
`tokenizers` library on the same vocabulary.
"""

from __future__ import annotations

import base64
import math
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa

from cadenza.llm.common import span_hashes

LETTER, NUMBER, BLANK, SIGN = 0, 1, 2, 3
#: Fixed values of the vocabulary's pattern: endings split off at an apostrophe.
ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")
#: White space of the pattern's \s (Unicode White_Space).
BLANKS = (*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
#: Distinct pieces kept encoded in a task; beyond it the store is begun anew.
STORE = 1_000_000


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    kinds = {"L": LETTER, "N": NUMBER}
    table = np.fromiter((kinds.get(unicodedata.category(chr(c))[0], SIGN) for c in range(0x110000)), np.uint8, 0x110000)
    table[list(BLANKS)] = BLANK
    return table


def pieces(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Byte positions where pieces start, for the UTF-8 rows data[bounds[i]:bounds[i+1]]."""
    if not len(data):
        return np.zeros(0, np.int64)
    points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    lead = np.flatnonzero((data & 0xC0) != 0x80)  # byte of each character
    n = len(points)
    kind = _classes()[points]
    row_start = np.zeros(n + 1, bool)
    row_start[np.searchsorted(lead, bounds)] = True
    row_end = row_start[1:].copy()
    row_end[-1] = True
    first = row_start[:n]
    change = first.copy()
    change[1:] |= kind[1:] != kind[:-1]  # starts of runs of one class
    start = change & (kind != BLANK)
    blank = kind == BLANK
    # blanks: a run begins a piece; its last character leaves it if text follows in the row
    start |= change & blank
    next_text = np.zeros(n, bool)
    next_text[:-1] = blank[:-1] & ~blank[1:] & ~row_end[:-1]
    start |= next_text
    # a plain space before text opens the text's piece
    space = next_text & (points == 0x20)
    start[1:][space[:-1]] = False
    # endings after an apostrophe that opens a run of signs and isn't led by a space
    quote = np.flatnonzero((points == 0x27) & change)
    quote = quote[(quote + 1 < n)]
    quote = quote[~row_end[quote] & start[quote]]
    if len(quote):
        padded = np.append(points, [0, 0]).astype(np.uint32)
        ended = np.append(row_end, [True, True])
        for ending in ENDINGS:
            a = padded[quote + 1] == ord(ending[0])
            size = 1
            if len(ending) == 2:
                a &= ~ended[quote + 1] & (padded[quote + 2] == ord(ending[1]))
                size = 2
            hit = quote[a]
            start[hit + 1] = False
            after = hit + 1 + size
            inside = after[after < n]
            start[inside[~row_start[inside]]] |= kind[inside[~row_start[inside]]] == LETTER
    return lead[start]


class Encoder:
    """Token ids of the rows of a slice. One per task: it keeps what it has encoded."""

    def __init__(self, path: str):
        import tiktoken
        from public_tokenizers import PATTERN

        with open(path, "rb") as file:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
        self.encoding = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.size = np.zeros(max(ranks.values()) + 1, np.int64)  # bytes of each token
        self.fragment = np.zeros(len(self.size), bool)  # tokens that aren't whole characters
        self.sign = np.zeros(len(self.size), bool)  # ASCII tokens of signs alone
        for token, rank in ranks.items():
            self.size[rank] = len(token)
            self.sign[rank] = token.isascii() and bool(token.strip()) and not any(chr(x).isalnum() for x in token)
            try:
                token.decode()
            except UnicodeDecodeError:
                self.fragment[rank] = True
        self._reset()

    def _reset(self) -> None:
        self.keys, self.at, self.n = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)

    def _learn(self, data: np.ndarray, keys: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        raw = data.tobytes()
        found = [self.encoding.encode_ordinary(raw[a:b].decode()) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
        n = np.fromiter(map(len, found), np.int64, len(found))
        at = len(self.ids) + np.cumsum(n) - n
        self.ids = np.concatenate([self.ids, np.fromiter((x for ids in found for x in ids), np.uint32, int(n.sum()))])
        place = np.searchsorted(self.keys, keys)
        self.keys, self.at, self.n = np.insert(self.keys, place, keys), np.insert(self.at, place, at), np.insert(self.n, place, n)

    def encode(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, first): row i has ids[first[i]:first[i+1]]."""
        starts = pieces(data, bounds)
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(len(bounds), np.int64)
        ends = np.append(starts[1:], len(data))
        keys, one, back = np.unique(span_hashes(data, starts, ends), return_index=True, return_inverse=True)
        if len(self.keys) + len(keys) > STORE:
            self._reset()
        place = np.minimum(np.searchsorted(self.keys, keys), max(0, len(self.keys) - 1))
        known = self.keys[place] == keys if len(self.keys) else np.zeros(len(keys), bool)
        if not known.all():
            new = one[~known]
            self._learn(data, keys[~known], starts[new], ends[new])
            place = np.searchsorted(self.keys, keys)
        place = place[back]
        n, at = self.n[place], self.at[place]
        total = np.concatenate([[0], np.cumsum(n)])
        ids = self.ids[np.repeat(at - total[:-1], n) + np.arange(total[-1])]
        return ids, total[np.searchsorted(starts, bounds)]


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def vocabulary(name: str = "byte_bpe_50k.tiktoken") -> str:
    """Path of a public vocabulary file (the same ids as byte_bpe_50k.json)."""
    import public_tokenizers

    return public_tokenizers.path(name)


def entropies(ids: np.ndarray, first: np.ndarray, vocab: int) -> np.ndarray:
    """Entropy in bits of the tokens of each row over that of as many distinct ones (1: all differ)."""
    rows = len(first) - 1
    n = np.diff(first)
    row = np.repeat(np.arange(rows), n)
    key, count = np.unique(row * vocab + ids, return_counts=True)
    of = key // vocab
    part = np.bincount(of, count * np.log2(count), rows)
    with np.errstate(divide="ignore", invalid="ignore"):
        bits = np.log2(n) - part / n
        return np.where(n > 1, bits / np.log2(n), 1.0)


def as_double(values: np.ndarray) -> pa.Array:
    return pa.array([None if math.isnan(x) else x for x in values.tolist()], pa.float64())

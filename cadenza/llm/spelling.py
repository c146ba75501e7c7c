"""Spelling variants: words one edit apart, found by FM-index search schemes over the whole vocabulary.

Two words are near if they differ by exactly one inserted, deleted or replaced code point. One error leaves
one half of a word as it is, so two searches find all: match the left half exactly and extend to the right
with one error, or match the right half exactly and extend to the left with one error. The two directions of
the bidirectional index are kept apart, as neither search turns round: one orders the delimited vocabulary by
its words, the other by its words read backwards, and both are searched alike.

Each order is range-partitioned and cut into blocks of at most BLOCK words. A block's index is the BWT of its
delimited words with bit vectors for ranks; a pattern is an interval of suffix ranks. A query goes to every
block whose range meets its exact half: mostly its own block, where it is already; only queries whose half
runs over a block's edge are sent (foreign ones). A block with many of them is copied, and they are dealt
to the copies, so a task holds one block and a slice of queries at a time however common a half is.

All queries of a slice step together. The exact layer's intervals of one depth are disjoint, so their
continuations are listed once for all queries with one beginning. States with the error spent are matched
exactly to the word's end. Each near word is found once: a replacement differs from the word's letter, of
equal letters the first one is deleted, an inserted letter differs from the next one, and the second search
leaves out what begins with the query's left half, which the first has found.

A word's form is its near word of largest n (ties: the smallest in code-point order) if that n is at least
`factor` times the word's; its root is the last form reached by following forms (n grows tenfold with each,
so there are few; they are followed by doubling).

Defined cases: null and empty words are dropped; rows that repeat a word are one word with the sum of their
n; a row with null n counts nothing; an empty table gives an empty one; further columns are left out.
Words of any script and length are taken whole; a very long one costs its length in steps of its slice.
"""

from __future__ import annotations

import math
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.storage import dropped, stored

#: Words of a block, queries that step together, and foreign queries of one copy of a block.
BLOCK, SLICE, FOREIGN = 65_536, 16_384, 131_072
#: Symbols up to which a block keeps a bit vector for each.
SYMBOLS = 512
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LETTERS = "[A-Za-zÀ-ÿ]"


# ---------------------------------------------------------------- words of texts
def letter_runs(docs: DataFrame, least: int = 1) -> DataFrame:
    """doc_id and run: each maximal run of letters of at least `least` code points, A-Z lower-cased; a row
    per occurrence. Null texts have none."""
    runs = F.regexp_extract_all("text", F.lit(f"{LETTERS}{{{least},}}"), F.lit(0))
    return docs.select("doc_id", F.explode(runs).alias("_run")).select("doc_id", F.translate("_run", UPPER, LOWER).alias("run"))


def word_counts(words: DataFrame, least_chars: int = 7, least_count: int = 2) -> DataFrame:
    """word and n of the words (a row per occurrence) that are long and frequent enough."""
    counted = words.where(F.char_length("word") >= least_chars).groupBy("word").agg(F.count("*").alias("n"))
    return counted.where(F.col("n") >= least_count)


# ---------------------------------------------------------------- index of a block
def _code_points(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All code points of the words one after another, and where each word begins."""
    first = np.concatenate([[0], np.cumsum([len(w) for w in words])]).astype(np.int64)
    return np.frombuffer("".join(words).encode("utf-32-le"), np.uint32), first


class BlockIndex:
    """Suffix ranks of the reversed, delimited words of a block, so that extending a pattern to the right is
    a backward step. Words are in order and distinct; symbol 0 is the delimiter."""

    def __init__(self, words: list[str]):
        points, first = _code_points(words)
        self.symbols, codes = np.unique(points, return_inverse=True)
        size = np.diff(first)
        n = len(points) + len(words)
        self.n_words = len(words)
        ends = first[1:] + np.arange(len(words))  # of the delimiters
        text = np.zeros(n, np.int64)
        word = np.repeat(np.arange(len(words)), size)
        within = np.arange(len(points)) - first[:-1][word]
        text[ends[word] - 1 - within] = codes + 1
        word_of = np.repeat(np.arange(len(words)), size + 1)
        order = self._suffix_order(text, ends[word_of], int(size.max(initial=0)))
        before = np.where(order > 0, text[order - 1], 0)
        self.bwt = before
        self.at_start = word_of[order[before == 0]]  # the k-th delimiter of the BWT: a whole word
        counts = np.bincount(text, minlength=len(self.symbols) + 1)
        self.below = np.concatenate([[0], np.cumsum(counts)])
        self._make_ranks(n)

    @staticmethod
    def _suffix_order(text: np.ndarray, end: np.ndarray, longest: int) -> np.ndarray:
        """Order of the suffixes up to their delimiter, equal ones in order of their words."""
        rank, step, at = text, 1, np.arange(len(text))
        while step <= longest:
            after = np.where(at + step <= end, rank[np.minimum(at + step, len(text) - 1)], 0)
            _, rank = np.unique(rank * (int(rank.max()) + 1) + after, return_inverse=True)
            step *= 2
        return np.argsort(rank, kind="stable")

    def _make_ranks(self, n: int) -> None:
        sigma = len(self.symbols) + 1
        self.places = None
        if sigma > SYMBOLS:  # many symbols: their places in order, found by halving
            by_symbol = np.argsort(self.bwt, kind="stable")
            self.places, self.stride = self.bwt[by_symbol] * (n + 1) + by_symbol, n + 1
            return
        self.blocks = n // 64 + 1
        self.bits = np.zeros((sigma, self.blocks), np.uint64)
        padded = np.zeros(self.blocks * 64, np.int64) - 1
        padded[:n] = self.bwt
        for s in range(sigma):
            self.bits[s] = np.packbits(padded == s, bitorder="little").view(np.uint64)
        self.ahead = np.zeros((sigma, self.blocks), np.int32)
        self.ahead[:, 1:] = np.cumsum(np.bitwise_count(self.bits[:, :-1]), axis=1)
        self.bits, self.ahead = self.bits.ravel(), self.ahead.ravel()

    def rank(self, symbol: np.ndarray, upto: np.ndarray) -> np.ndarray:
        """How often the symbol stands in the first `upto` places of the BWT."""
        if self.places is not None:
            return np.searchsorted(self.places, symbol * self.stride + upto) - self.below[symbol]
        cell = symbol * self.blocks + (upto >> 6)
        mask = (np.uint64(1) << (upto & 63).astype(np.uint64)) - np.uint64(1)
        return self.ahead[cell] + np.bitwise_count(self.bits[cell] & mask)

    def extend(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        base = self.below[symbol]
        return base + self.rank(symbol, low), base + self.rank(symbol, high)

    def children(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The letters that follow in disjoint intervals: counts by interval, and symbol, low, high of each."""
        width = high - low
        of = np.repeat(np.arange(len(low)), width)
        rows = np.arange(len(of)) + np.repeat(low - (np.cumsum(width) - width), width)
        sigma = len(self.symbols) + 1
        found = np.unique(of * sigma + self.bwt[rows])
        parent, symbol = found // sigma, found % sigma
        parent, symbol = parent[symbol > 0], symbol[symbol > 0]
        return np.bincount(parent, minlength=len(low)), symbol, *self.extend(symbol, low[parent], high[parent])

    def encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of the words (-1: not in the block), and where each word begins."""
        points, first = _code_points(words)
        at = np.minimum(np.searchsorted(self.symbols, points), max(len(self.symbols) - 1, 0))
        return np.where(self.symbols[at] == points, at + 1, -1) if len(self.symbols) else np.full(len(points), -1), first

    def near(self, queries: list[str], exact: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, word) of the block's words that begin with the query's first `exact` letters and are one
        error from it; each pair once."""
        code, first = self.encode(queries)
        size = np.diff(first)
        live = np.arange(len(queries))  # queries of the exact layer
        low, high = np.zeros(len(queries), np.int64), np.full(len(queries), self.n_words, np.int64)
        nothing = np.zeros(0, np.int64)
        spent = (nothing, nothing, nothing)  # states with the error behind them: query, low, high
        found: list[tuple[np.ndarray, np.ndarray]] = []
        for depth in range(int(size.max(initial=0)) + 1):
            at_depth, at_next = [spent], []
            open_ = exact[live] <= depth
            q, q_low, q_high = live[open_], low[open_], high[open_]
            if len(q):
                more = size[q] > depth
                own = np.where(more, code[np.minimum(first[q] + depth, len(code) - 1)], 0)
                starts, index, of = np.unique(q_low, return_index=True, return_inverse=True)
                counts, symbol, c_low, c_high = self.children(starts, q_high[index])
                begin = np.cumsum(counts) - counts
                times = counts[of]
                state = np.repeat(np.arange(len(q)), times)
                child = np.arange(len(state)) + np.repeat(begin[of] - (np.cumsum(times) - times), times)
                other = symbol[child] != own[state]
                state, child = state[other], child[other]
                at_depth.append((q[state], c_low[child], c_high[child]))  # inserted before `depth`
                replaced = more[state]
                at_next.append((q[state[replaced]], c_low[child[replaced]], c_high[child[replaced]]))
                before = code[np.maximum(first[q] + depth - 1, 0)]
                gone = more & ((exact[q] == depth) | (before != own))
                at_next.append((q[gone], q_low[gone], q_high[gone]))
            s, s_low, s_high = (np.concatenate(x) for x in zip(*at_depth, strict=True))
            done = size[s] == depth
            ends, word_low, word_high = s[done], self.rank(0 * s[done], s_low[done]), self.rank(0 * s[done], s_high[done])
            whole = word_high > word_low
            found.append((ends[whole], self.at_start[word_low[whole]]))
            at_next.append(self._step(code, first, depth, s[~done], s_low[~done], s_high[~done]))
            spent = tuple(np.concatenate(x) for x in zip(*at_next, strict=True))
            further = size[live] > depth
            live, low, high = self._step(code, first, depth, live[further], low[further], high[further])
            if not len(live) and not len(spent[0]):
                break
        return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (nothing, nothing)

    def _step(self, code, first, depth, q, low, high):
        symbol = code[first[q] + depth]
        known = symbol >= 0
        q, symbol = q[known], symbol[known]
        low, high = self.extend(symbol, low[known], high[known])
        some = high > low
        return q[some], low[some], high[some]


# ---------------------------------------------------------------- blocks and queries on Spark
def exact_part(size: np.ndarray, way: int) -> np.ndarray:
    """Letters of the half that is matched exactly: the left one forwards (0), the right one backwards (1)."""
    return size // 2 if way == 0 else size - size // 2


def _cut(batches: Iterator[pa.RecordBatch], block: int) -> Iterator[pa.RecordBatch]:
    """Number the blocks of a sorted partition; a block never holds both ways."""
    seen = 0
    for batch in batches:
        part, way = (batch.column(i).to_numpy().astype(np.int64) for i in (0, 1))
        numbers = (part << 24) + (way << 23) + (seen + np.arange(len(part))) // block
        seen += len(part)
        yield pa.RecordBatch.from_arrays([pa.array(numbers), *batch.columns[1:]], names=["block", "way", "key", "n"])


def _send(batches: Iterator[pa.RecordBatch], bounds: dict[int, list[tuple[str, str, int]]]) -> Iterator[pa.RecordBatch]:
    """Queries for further blocks that their exact half runs into."""
    firsts, lasts = ({w: [x[i] for x in b] for w, b in bounds.items()} for i in (0, 1))
    for batch in batches:
        own, ways, keys, _ = (c.to_pylist() for c in batch.columns)
        rows, to = [], []
        for i, (at, way, key) in enumerate(zip(own, ways, keys, strict=True)):
            half = key[: exact_part(len(key), way)]
            for b in range(bisect_left(lasts[way], half), bisect_right(firsts[way], half + chr(0x10FFFF))):
                if bounds[way][b][2] != at:
                    rows.append(i), to.append(bounds[way][b][2])
        sent = batch.take(pa.array(rows, pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array(to, pa.int64()), *sent.columns[1:]], names=["block", "way", "key", "n"])


class _Open:
    """The block that a task is at: its words first, then its queries."""

    def __init__(self, way: int, answers_own: bool):
        self.way, self.answers_own, self.keys, self.ns, self.index = way, answers_own, [], [], None

    def answers(self, queries: list[str]) -> Iterator[pa.RecordBatch]:
        if self.index is None:
            self.index = BlockIndex(self.keys)
            self.words = [k[::-1] for k in self.keys] if self.way else self.keys
            self.n = np.concatenate(self.ns)
            self.order = np.empty(len(self.keys), np.int64)
            self.order[sorted(range(len(self.keys)), key=self.words.__getitem__)] = np.arange(len(self.keys))
        for at in range(0, len(queries), SLICE):
            part = queries[at : at + SLICE]
            exact = exact_part(np.array([len(x) for x in part], np.int64), self.way)
            q, word = self.index.near(part, exact)
            if self.way:  # what begins with the left half is found forwards
                tail = [x[e:] for x, e in zip(part, exact.tolist(), strict=True)]
                new = np.array([not self.keys[w].endswith(tail[i]) for i, w in zip(q.tolist(), word.tolist(), strict=True)], bool)
                q, word = q[new], word[new]
            by = np.lexsort((self.order[word], -self.n[word], q))
            q, word = q[by], word[by]
            head = np.flatnonzero(np.append(True, q[1:] != q[:-1])) if len(q) else np.zeros(0, np.int64)
            names = [part[i][::-1] if self.way else part[i] for i in q[head].tolist()]
            best = word[head]
            counts = np.diff(np.append(head, len(q)))
            columns = [pa.array(names, pa.string()), pa.array(counts.astype(np.int64)), pa.array(self.n[best]), pa.array([self.words[w] for w in best.tolist()], pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["word", "n_near", "best_n", "best"])

    def end(self) -> Iterator[pa.RecordBatch]:
        if self.answers_own and self.keys:
            yield from self.answers(self.keys)


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """block, copy, kind, way, key, n sorted by block, copy and kind: 0 words of the block, 1 foreign queries."""
    now, of = None, None
    for batch in batches:
        block, copy, kind, way = (batch.column(i).to_numpy().astype(np.int64) for i in range(4))
        n = batch.column(5).to_numpy().astype(np.int64)
        group = np.flatnonzero(np.append(True, (block[1:] != block[:-1]) | (copy[1:] != copy[:-1]) | (kind[1:] != kind[:-1]))) if len(block) else []
        for a, b in zip(group, np.append(group[1:], len(block)), strict=True):
            if of != (block[a], copy[a]):
                if now is not None:
                    yield from now.end()
                now, of = _Open(int(way[a]), bool(copy[a] == 0)), (block[a], copy[a])
            keys = batch.column(4).slice(a, b - a).to_pylist()
            if kind[a]:
                yield from now.answers(keys)
            else:
                now.keys += keys
                now.ns.append(n[a:b])
    if now is not None:
        yield from now.end()


def near_words(vocabulary: DataFrame, block: int = BLOCK, foreign: int = FOREIGN) -> DataFrame:
    """vocabulary: distinct word, n (stored: it is read several times). A row for each word with near words,
    in one of the two searches and one block: word, n_near, best_n, best; sums and the best are still to be
    taken over them."""
    spark = vocabulary.sparkSession
    ways = vocabulary.select(F.lit(0).alias("way"), F.col("word").alias("key"), "n").unionByName(vocabulary.select(F.lit(1).alias("way"), F.reverse("word").alias("key"), "n"))
    blocks = max(1, math.ceil(2 * vocabulary.count() / block))
    ordered = ways.repartitionByRange(blocks, "way", "key").sortWithinPartitions("way", "key").select(F.spark_partition_id().alias("part"), "way", "key", "n")
    cut = stored(ordered.mapInArrow(lambda it: _cut(it, block), "block long, way int, key string, n long"), "spelling-blocks")
    ends = cut.groupBy("way", "block").agg(F.min("key").alias("first"), F.max("key").alias("last"))
    bounds: dict[int, list[tuple[str, str, int]]] = {0: [], 1: []}
    for r in ends.collect():  # one row per block
        bounds[r.way].append((r.first, r.last, r.block))
    for listed in bounds.values():
        listed.sort()
    sent = stored(cut.mapInArrow(lambda it: _send(it, bounds), cut.schema), "spelling-queries")
    copies = F.broadcast(sent.groupBy("block").agg(F.ceil(F.count("*") / foreign).cast("int").alias("copies")))  # a row per block at most
    each = F.explode(F.sequence(F.lit(0), F.coalesce("copies", F.lit(1)) - 1)).alias("copy")
    words = cut.join(copies, "block", "left").select("block", each, F.lit(0).alias("kind"), "way", "key", "n")
    asked = sent.join(copies, "block").select("block", F.pmod(F.xxhash64("key"), "copies").cast("int").alias("copy"), F.lit(1).alias("kind"), "way", "key", "n")
    tasks = max(len(bounds[0]) + len(bounds[1]), 1)
    together = words.unionByName(asked).repartitionByRange(tasks, "block", "copy").sortWithinPartitions("block", "copy", "kind", "key")
    found = stored(together.mapInArrow(_search, "word string, n_near long, best_n long, best string"), "spelling-near")
    dropped(cut, sent)
    return found


def roots(forms: DataFrame) -> DataFrame:
    """forms: word, n, form. The root of every form that has a form itself: form, root. Chains have at most
    one link for each factor of ten; each round doubles what is followed."""
    own = forms.select("form").where("form is not null").distinct()
    step = forms.where("form is not null").select(F.col("word").alias("from"), F.col("form").alias("to")).join(own.withColumnRenamed("form", "from"), "from", "left_semi")
    now = stored(step, "spelling-roots")
    while True:
        ahead = now.select(F.col("from").alias("to"), F.col("to").alias("_next"))
        new = stored(now.join(ahead, "to", "left").select("from", F.coalesce("_next", "to").alias("to"), F.col("_next").isNotNull().alias("_moved")), "spelling-roots")
        dropped(now)
        moved = new.where("_moved").limit(1).count()
        now = new.select("from", "to")
        if not moved:
            return now.select(F.col("from").alias("form"), F.col("to").alias("root"))


def spelling_variants(words: DataFrame, factor: int = 10) -> DataFrame:
    """words: word, n. Returns word, n, n_near, form, form_n and root of each word."""
    clean = words.where("word is not null and word <> ''").groupBy("word").agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("n"))
    vocabulary = stored(clean, "spelling-words")
    found = near_words(vocabulary)
    best: Column = F.when(F.col("best").isNotNull(), F.struct((-F.col("best_n")).alias("n"), F.col("best").alias("word")))
    known = vocabulary.select("word", "n", F.lit(0).cast("long").alias("n_near"), F.lit(None).cast("long").alias("best_n"), F.lit(None).cast("string").alias("best"))
    both = known.unionByName(found.withColumn("n", F.lit(None).cast("long")))
    summed = both.groupBy("word").agg(F.max("n").alias("n"), F.sum("n_near").alias("n_near"), F.min(best).alias("_best"))
    is_form = -F.col("_best.n") >= factor * F.col("n")
    forms = stored(summed.select("word", "n", "n_near", F.when(is_form, F.col("_best.word")).alias("form"), F.when(is_form, -F.col("_best.n")).alias("form_n")), "spelling-forms")
    dropped(vocabulary, found)
    end = roots(forms)
    return forms.join(end, "form", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "form", "word").alias("root"))

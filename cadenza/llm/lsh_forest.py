"""MinHash near-duplicates with an LSH forest.

A document is its set of distinct k-word shingles. Each tree of the forest sorts the documents by
another signature order (eight 16-bit MinHash values); documents that share at least `DEPTH` leading
values form a region, whose rows are neighbours in the order. Candidates are rows of a region that agree
in enough of 128 MinHash bits; they are confirmed on the full sets, and links are closed to components.

Equal sets are found by their 128-bit set hash beforehand and linked to the smallest doc_id, so
copies never meet in the forest.

First round: every pair of a region of up to `REGION` rows is compared. A row with many look-alikes
carries on only the first and the nearest of them, which ties groups of near copies together without
listing their pairs. Second round: documents for which look-alikes were left out meet once more, now
only with those of other components; few are listed, and where they are many the documents go on to an
exact join (set_join). So do all documents of a denser region: there the order is deep, rows stream
through a window of the nearest prefixes to tie what is close, and the exact join finds the rest.

Chance of missing a link at similarity s outside the exact join: (1 - s**DEPTH)**TREES, below 2e-5 at 0.8
and 1e-9 at 0.9, and below 2e-6 at 0.8 by the estimate from bits.

Defined cases: texts with fewer than k words have the whole sequence as one shingle; without words
(or null) the set is empty and linked with nothing; a row without doc_id is never linked and has no
component; rows that repeat a doc_id are one document with the links of each of its texts; columns named
like an output column are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cadenza.llm.common import FOLDED, Words, lists, mix, sequence_hashes, slices, words_of
from cadenza.llm.components import connected_components
from cadenza.llm.set_join import exact_links
from cadenza.storage import dropped, stored

TREES, VALUES, DEPTH = 16, 8, 3
#: Bits of the sketch: one of each MinHash value.
SKETCH = TREES * VALUES
#: Rows of a region that are compared with one another; overlap of the window in a denser one.
REGION, OVERLAP = 16_384, 512
#: Standard deviations by which an estimate may fall short of the threshold.
SLACK = 5.0
#: Up to so many earlier look-alikes of a row in a region are listed; else so many of the nearest.
FEW, NEAREST = 8, 2

_MULTIPLIERS = np.random.Generator(np.random.PCG64(7)).integers(1, 2**63, SKETCH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


# ---------------------------------------------------------------- signatures
def shingle_sets(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, first): the distinct shingles of row i are hashes[first[i]:first[i+1]], sorted."""
    codes = w.hashes()
    full = sequence_hashes(codes, k)
    counts = w.counts
    out, sizes = [], np.zeros(len(counts), np.int64)
    for r, (a, n) in enumerate(zip(w.first[:-1].tolist(), counts.tolist(), strict=True)):
        if n >= k:
            found = np.unique(full[a : a + n - k + 1])
        elif n:
            found = sequence_hashes(codes[a : a + n], n)
        else:
            continue
        sizes[r] = len(found)
        out.append(found)
    return np.concatenate(out) if out else np.zeros(0, np.uint64), np.concatenate([[0], np.cumsum(sizes)])


_SIGNED = "_cz_doc long, _cz_n long, _cz_s1 long, _cz_s2 long, _cz_keys binary, _cz_bits binary"


def _signatures(k: int, own: list[str]):
    """The columns to keep, and a row's set size, set hash, forest keys and bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = lambda name: batch.column(batch.schema.get_field_index(name))  # noqa: E731, B023
            for at, to, data, bounds in slices(column("_cz_text")):
                hashes, first = shingle_sets(words_of(data, bounds, FOLDED), k)
                n = np.diff(first)
                rows, filled = to - at, np.flatnonzero(n)
                sums = np.zeros((2, rows), np.uint64)
                values = np.zeros((rows, SKETCH), np.uint64)
                if len(filled):
                    where = first[:-1][filled]
                    sums[0, filled] = np.add.reduceat(hashes, where)
                    sums[1, filled] = np.add.reduceat(mix(hashes ^ np.uint64(0xA5A5A5A5A5A5A5A5)), where)
                    for j, a in enumerate(_MULTIPLIERS):
                        values[filled, j] = np.minimum.reduceat(hashes * a, where)
                values = mix(values)
                keys = (values >> np.uint64(48)).astype(">u2").reshape(rows, TREES, VALUES)
                bits = np.packbits((values & np.uint64(1)).astype(bool), axis=1)
                made = [pa.array(n), pa.array(sums[0].view(np.int64)), pa.array(sums[1].view(np.int64)), _binary(keys), _binary(bits)]
                kept = [column(c).slice(at, rows) for c in (*own, "_cz_doc")]
                yield pa.RecordBatch.from_arrays([*kept, *made], names=[*own, *(x.split()[0] for x in _SIGNED.split(", "))])

    return run


def _binary(rows: np.ndarray) -> pa.Array:
    size = rows[0].nbytes if len(rows) else 1
    offsets = np.arange(len(rows) + 1, dtype=np.int32) * size
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(rows.tobytes())])


def _bytes(column: pa.Array, size: int) -> np.ndarray:
    """A binary column of one size as a matrix."""
    _, offsets, data = column.buffers()
    begin = np.frombuffer(offsets, np.int32)[column.offset] if len(column) else 0
    return np.frombuffer(data, np.uint8)[begin : begin + len(column) * size].reshape(len(column), size)


#: Bytes of a key (tree and values), and of its head, which names the region.
_KEY, _HEAD = 1 + 2 * VALUES, 1 + 2 * DEPTH
_TREE = "key binary, doc long, bits binary, part long"


def _tree_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row (key, doc, bits, part) per document and tree; the key leads with the tree."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        keys = _bytes(batch.column(1), TREES * VALUES * 2).reshape(n, TREES, VALUES * 2)
        tree = np.broadcast_to(np.arange(TREES, dtype=np.uint8)[None, :, None], (n, TREES, 1))
        index = pa.array(np.repeat(np.arange(n), TREES))
        rows = [_binary(np.concatenate([tree, keys], axis=2).reshape(n * TREES, -1)), *(batch.column(i).take(index) for i in (0, 2, 3))]
        yield pa.RecordBatch.from_arrays(rows, names=["key", "doc", "bits", "part"])


# ---------------------------------------------------------------- regions of a sorted tree
#: Kinds of rows that a pass emits: a candidate pair, a row of a region that may go on in another partition,
#: a document with look-alikes left out, one for the exact join, and the head of a dense region.
PAIR, EDGE, MORE, CROWD, DENSE = range(5)
_SEEN = "kind tinyint, a long, b long, alike int, key binary, bits binary, part long"
_NAMES = [x.split()[0] for x in _SEEN.split(", ")]


def _emit(kind: int, a=None, b=None, alike=None, key=None, bits=None, part=None) -> pa.RecordBatch:
    n = len(next(x for x in (a, key) if x is not None))
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.int64())
    given = (a, b, alike, key, bits, part)
    full = [pa.nulls(n, t) if x is None else _binary(x) if t == pa.binary() else pa.array(x, t) for x, t in zip(given, kinds, strict=True)]
    return pa.RecordBatch.from_arrays([pa.array(np.full(n, kind, np.int8)), *full], names=_NAMES)


def _heads(keys: np.ndarray) -> np.ndarray:
    """The tree and the leading values of keys as one number."""
    out = np.zeros(len(keys), np.int64)
    for j in range(_HEAD):
        out = out * 256 + keys[:, j]
    return out


def _agreeing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """In how many bits rows of a agree with rows of b (each two words of 64 bits)."""
    return SKETCH - (np.bitwise_count(a[..., 0] ^ b[..., 0]) + np.bitwise_count(a[..., 1] ^ b[..., 1]))


class _Rows:
    """Rows of a tree, as arrays. own: what must differ in a pair (the document, later its part)."""

    def __init__(self, key, doc, bits, own):
        self.key, self.doc, self.bits, self.own = key, doc, bits, own

    @staticmethod
    def of(batch: pa.RecordBatch, second: bool) -> _Rows:
        doc = batch.column(1).fill_null(0).to_numpy(zero_copy_only=False)
        bits = np.ascontiguousarray(_bytes(batch.column(2), SKETCH // 8)).view(np.uint64)
        return _Rows(_bytes(batch.column(0), _KEY), doc, bits, batch.column(3).to_numpy(zero_copy_only=False) if second else doc)

    @staticmethod
    def joined(parts: list[_Rows]) -> _Rows:
        return parts[0] if len(parts) == 1 else _Rows(*(np.concatenate([getattr(p, c) for p in parts]) for c in ("key", "doc", "bits", "own")))

    def cut(self, start: int, stop: int | None = None) -> _Rows:
        return _Rows(*(x[start:stop] for x in (self.key, self.doc, self.bits, self.own)))

    def taken(self, where: np.ndarray) -> _Rows:
        return _Rows(*(x[where] for x in (self.key, self.doc, self.bits, self.own)))

    def __len__(self) -> int:
        return len(self.doc)


def _few_pairs(rows: _Rows, size: np.ndarray, least: int) -> Iterator[pa.RecordBatch]:
    """All candidates of regions of at most FEW + 1 rows; size: of each row's region, rows in order."""
    place = np.arange(len(rows)) - np.repeat(np.cumsum(size) - size, size)
    left = np.repeat(size, size) - place
    for step in range(1, FEW + 1):
        i = np.flatnonzero(left > step)
        if not len(i):
            return
        alike = _agreeing(rows.bits[i], rows.bits[i + step])
        ok = (alike >= least) & (rows.own[i] != rows.own[i + step])
        if ok.any():
            yield _pairs(rows.doc[i[ok]], rows.doc[i[ok] + step], alike[ok])


def _pairs(a: np.ndarray, b: np.ndarray, alike: np.ndarray) -> pa.RecordBatch:
    return _emit(PAIR, np.minimum(a, b), np.maximum(a, b), alike)


def _all_pairs(rows: _Rows, fresh: int, least: int, second: bool) -> Iterator[pa.RecordBatch]:
    """Candidates of a block of which the later row is at `fresh` or beyond. A row with more than FEW
    earlier ones lists the first and the nearest, or, in the second round, goes to the exact join."""
    m = len(rows)
    _, own = np.unique(rows.own, return_inverse=True)
    own = own.astype(np.int32)
    step = max(1, 4_000_000 // max(1, m))
    for i in range(fresh, m, step):
        stop = min(m, i + step)
        alike = _agreeing(rows.bits[i:stop, None], rows.bits[None, :stop])
        ok = (alike >= least) & (np.arange(stop) < np.arange(i, stop)[:, None])
        if not ok.any():
            continue
        ok &= own[None, :stop] != own[i:stop, None]
        n = ok.sum(axis=1)
        r, c = np.nonzero(ok & (n <= FEW)[:, None])
        if len(r):
            yield _pairs(rows.doc[c], rows.doc[i + r], alike[r, c])
        many = np.flatnonzero(n > FEW)
        if not len(many):
            continue
        ok, alike = ok[many], np.where(ok[many], alike[many], 0).astype(np.uint8)
        yield _emit(CROWD if second else MORE, np.unique(np.concatenate([rows.doc[:stop][ok.any(axis=0)], rows.doc[i + many]])))
        if second:
            continue
        line = np.arange(len(many))
        chosen = [ok.argmax(axis=1)]
        value = [alike[line, chosen[0]]]
        for _ in range(NEAREST):
            near = alike.argmax(axis=1)
            chosen.append(near)
            value.append(alike[line, near])
            alike[line, near] = 0
        c, alike = np.concatenate(chosen), np.concatenate(value)
        b = np.tile(rows.doc[i + many], len(chosen))
        yield _pairs(rows.doc[c][alike > 0], b[alike > 0], alike[alike > 0])


class _Region:
    """A region while its rows stream by. first: it may have begun in an earlier partition."""

    def __init__(self, head: int, first: bool = False):
        self.head, self.first = head, first
        self.parts: list[_Rows] = []
        self.n, self.fresh, self.dense = 0, 0, False

    def add(self, rows: _Rows, least: int) -> Iterator[pa.RecordBatch]:
        self.parts.append(rows)
        self.n += len(rows)
        while self.n > REGION:  # dense: a window of rows with the longest common prefixes
            self.dense = True
            held = _Rows.joined(self.parts)
            yield from self._window(held.cut(0, REGION), least)
            self.parts = [held.cut(REGION - OVERLAP)]
            self.n, self.fresh = self.n - REGION + OVERLAP, OVERLAP

    def _window(self, rows: _Rows, least: int) -> Iterator[pa.RecordBatch]:
        yield from _all_pairs(rows, self.fresh, least, False)
        yield _emit(CROWD, rows.doc[self.fresh :])

    def closed(self, least: int, second: bool, edge: bool) -> Iterator[pa.RecordBatch]:
        rows = _Rows.joined(self.parts) if self.parts else None
        if self.dense:
            if rows is not None and len(rows) > self.fresh:
                yield from self._window(rows, least)
            mark = np.array([*self.head.to_bytes(_HEAD, "big"), *bytes(_KEY - _HEAD)], np.uint8)[None]
            yield _emit(DENSE, key=mark, bits=np.zeros((1, SKETCH // 8), np.uint8))
        elif edge:
            yield _emit(EDGE, rows.doc, key=rows.key, bits=rows.bits)
        elif len(rows) > 1:
            yield from _all_pairs(rows, 0, least, second)


def _neighbours(least: int, edges: bool = False, second: bool = False):
    """Streams sorted tree rows, region by region. With `edges` the first and the last region of the
    partition are passed on, as they may go on beyond it. A row without doc says that its region is
    dense elsewhere."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: _Region | None = None
        begun = False
        for batch in batches:
            if not batch.num_rows:
                continue
            rows, marks = _Rows.of(batch, second), np.asarray(batch.column(1).is_null())
            heads = _heads(rows.key)
            cuts = np.concatenate([[0], np.flatnonzero(heads[1:] != heads[:-1]) + 1, [len(heads)]])
            k, at = len(cuts) - 1, 0
            marked = np.add.reduceat(marks.astype(np.int64), cuts[:-1]) > 0
            if now is not None and now.head != heads[0]:
                yield from now.closed(least, second, edges and now.first)
                now = None

            def grown(region: _Region, run: int) -> Iterator[pa.RecordBatch]:
                own = rows.cut(cuts[run], cuts[run + 1])  # noqa: B023
                if marked[run]:  # noqa: B023
                    region.dense = True
                    own = own.taken(~marks[cuts[run] : cuts[run + 1]])  # noqa: B023
                yield from region.add(own, least)

            if now is None and not begun:
                now, begun = _Region(int(heads[0]), True), True
            if now is not None:
                yield from grown(now, 0)
                if k == 1:
                    continue
                yield from now.closed(least, second, edges and now.first)
                at = 1
            size = np.diff(cuts)[at : k - 1]
            small = (size > 1) & (size <= FEW + 1) & ~marked[at : k - 1]
            if small.any():
                own = rows.cut(cuts[at], cuts[k - 1]).taken(np.repeat(small, size))
                yield from _few_pairs(own, size[small], least)
            for run in (at + np.flatnonzero((size > 1) & ~small | marked[at : k - 1])).tolist():
                region = _Region(int(heads[cuts[run]]))
                yield from grown(region, run)
                yield from region.closed(least, second, False)
            now = _Region(int(heads[cuts[k - 1]]))
            yield from grown(now, k - 1)
        if now is not None:
            yield from now.closed(least, second, edges)

    return run


# ---------------------------------------------------------------- rounds
def least_bits(similarity: float) -> int:
    """Bits in which a pair at the similarity agrees, but for SLACK standard deviations: values agree by
    being equal, or in half of the other cases."""
    agree = 0.5 + similarity / 2
    return int(np.floor(SKETCH * agree - SLACK * np.sqrt(SKETCH * agree * (1 - agree))))


def _trees(signatures: DataFrame, part: str) -> DataFrame:
    return signatures.select("doc", "keys", "bits", F.col(part).alias("part")).mapInArrow(_tree_rows, _TREE)


def first_round(signatures: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """What the passes over all trees emit: over the partitions, and over regions across their bounds.
    signatures: doc, keys, bits."""
    ordered = _trees(signatures, "doc").repartitionByRange("key", "doc").sortWithinPartitions("key", "doc")
    seen = stored(ordered.mapInArrow(_neighbours(least, edges=True), _SEEN), "neighbours")
    margins = seen.where(F.col("kind").isin(EDGE, DENSE)).select("key", F.col("a").alias("doc"), "bits", F.col("a").alias("part"))
    dealt = margins.repartition(F.substring("key", 1, _HEAD)).sortWithinPartitions("key", "doc")
    return seen, stored(dealt.mapInArrow(_neighbours(least), _SEEN), "margins")


def second_round(signatures: DataFrame, dense: DataFrame, least: int) -> DataFrame:
    """The same over documents with a part, for pairs of different parts; dense regions are left out, so
    that none is larger than REGION. signatures: doc, keys, bits, part."""
    head = F.substring("key", 1, _HEAD)
    rows = _trees(signatures, "part").withColumn("head", head).join(dense.select(head.alias("head")).distinct(), "head", "left_anti")
    dealt = rows.select("key", "doc", "bits", "part", "head").repartition("head").sortWithinPartitions("key", "doc").drop("head")
    return stored(dealt.mapInArrow(_neighbours(least, second=True), _SEEN), "again")


def _sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, to, data, bounds in slices(batch.column(1)):
                hashes, first = shingle_sets(words_of(data, bounds, FOLDED), k)
                shingles = lists(pa.array(hashes.view(np.int64)), np.diff(first))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, to - at), shingles], names=["doc", "shingles"])

    return run


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets reach percent / 100 of Jaccard similarity."""
    one = sets.select(F.col("doc").alias("a"), F.col("shingles").alias("sa"))
    two = sets.select(F.col("doc").alias("b"), F.col("shingles").alias("sb"))
    shared = F.size(F.array_intersect("sa", "sb"))
    enough = 100 * shared >= percent * (F.size("sa") + F.size("sb") - shared)
    return pairs.select("a", "b").join(one, "a").join(two, "b").where(enough).select("a", "b").distinct()


def links_of(forest: DataFrame, texts: DataFrame, k: int, percent: int) -> tuple[DataFrame, list[DataFrame]]:
    """(a, b) links that join what is linked, and the tables they are read from. forest: doc, keys, bits of
    different sets; texts: doc, text."""
    least = least_bits(percent / 100)
    seen, margins = first_round(forest, least)
    both = seen.unionByName(margins)
    of_kind = lambda rows, *kinds: rows.where(F.col("kind").isin(*kinds))
    pairs = stored(of_kind(both, PAIR).groupBy("a", "b").agg(F.max("alike").alias("alike")), "pairs")
    more = stored(of_kind(both, MORE, CROWD).select(F.col("a").alias("doc")).distinct(), "more")
    members = pairs.select(F.explode(F.array("a", "b")).alias("doc")).unionByName(more).distinct()
    # members grow with the documents: the same merge join at every size, never a broadcast
    sets = stored(texts.join(members.hint("merge"), "doc", "left_semi").select("doc", "text").mapInArrow(_sets(k), "doc long, shingles array<bigint>"), "sets")
    nearest, lowest = F.max_by("a", F.struct("alike", -F.col("a"))), F.min("a")
    best = pairs.groupBy("b").agg(F.array_distinct(F.array(nearest, lowest)).alias("best")).select(F.explode("best").alias("a"), "b")
    first = stored(confirmed(best, sets, percent), "links")
    found = connected_components(first)
    of = lambda side: found.select(F.col("node").alias(side), F.col("component").alias(f"of_{side}"))
    apart = lambda rows: rows.join(of("a"), "a", "left").join(of("b"), "b", "left").where("coalesce(of_a, a) <> coalesce(of_b, b)").select("a", "b")
    left = apart(pairs).join(best, ["a", "b"], "left_anti")
    tables = [seen, margins, pairs, more, sets, first, found]
    crowd = of_kind(both, CROWD)
    if not more.isEmpty():
        parts = more.join(of("doc"), "doc", "left").select("doc", F.coalesce("of_doc", "doc").alias("part"))
        again = second_round(forest.join(parts, "doc"), of_kind(both, DENSE), least)
        tables.append(again)
        left = left.unionByName(of_kind(again, PAIR).select("a", "b").distinct().join(pairs, ["a", "b"], "left_anti")).distinct()
        crowd = crowd.unionByName(of_kind(again, CROWD))
    links = found.select(F.col("component").alias("a"), F.col("node").alias("b")).unionByName(confirmed(left, sets, percent))
    dense = stored(crowd.select(F.col("a").alias("doc")).distinct(), "crowd")
    tables.append(dense)
    if not dense.isEmpty():
        mass = found.groupBy(F.col("component").alias("part")).agg((F.count("*") + 1).alias("mass"))
        joined = sets.join(dense, "doc", "left_semi").join(of("doc"), "doc", "left").withColumn("part", F.coalesce("of_doc", "doc"))
        placed = stored(joined.join(mass, "part", "left").select("doc", "part", F.coalesce("mass", F.lit(1)).cast("long").alias("mass"), "shingles"), "placed")
        exact = exact_links(placed, percent)
        tables += [placed, exact]
        links = links.unionByName(exact)
    return links, tables


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """docs without the text, with n_shingles, component_id and kept (doc_id = component_id)."""
    own = [c for c in docs.columns if c not in ("n_shingles", "component_id", "kept", "text")]
    doc = F.col("doc_id").cast("long")
    schema = T.StructType([docs.schema[c] for c in own] + list(T._parse_datatype_string(_SIGNED)))
    read = docs.select(*own, doc.alias("_cz_doc"), F.coalesce("text", F.lit("")).alias("_cz_text"))
    base = stored(read.mapInArrow(_signatures(k, own), schema), "signatures")
    rows = base.where("_cz_doc is not null and _cz_n > 0")
    # one row for each set; equal sets have equal keys and bits
    sets = ("_cz_s1", "_cz_s2", "_cz_n")
    grouped = rows.groupBy(*sets).agg(F.min("_cz_doc").alias("doc"), F.first("_cz_keys").alias("keys"), F.first("_cz_bits").alias("bits"))
    forest = stored(grouped, "forest")
    texts = docs.where(doc.isNotNull()).select(doc.alias("doc"), F.coalesce("text", F.lit("")).alias("text"))
    links, tables = links_of(forest.select("doc", "keys", "bits"), texts, k, percent)
    copies = rows.select(*sets, "_cz_doc").join(forest.select(*sets, "doc"), list(sets)).where("_cz_doc <> doc")
    components = connected_components(links.unionByName(copies.select(F.col("doc").alias("a"), F.col("_cz_doc").alias("b"))))
    dropped(*tables, forest)
    joined = base.select(*own, "_cz_doc", "_cz_n").join(components, F.col("_cz_doc") == F.col("node"), "left")
    component = F.coalesce("component", "_cz_doc")
    kept = F.coalesce(F.col("_cz_doc") == component, F.lit(True))
    return joined.select(*own, F.col("_cz_n").alias("n_shingles"), component.alias("component_id"), kept.alias("kept"))


def drop_near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """docs with one document of each group of near-duplicates: the one with the smallest doc_id."""
    marks = near_duplicates(docs.select("doc_id", "text"), k, percent).where("not kept").select(F.col("doc_id").alias("_cz_gone")).distinct()
    return docs.join(marks.hint("merge"), docs["doc_id"] == marks["_cz_gone"], "left_anti")

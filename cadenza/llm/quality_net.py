"""Quality classifier: random-indexing word vectors, pooled per document, a two-layer network, a temperature.

Words are runs of letters, of digits or of other signs, case kept. Each word has an index vector of `DIM`
numbers with a few +1 and -1, drawn from its hash; its word vector is the sum of the index vectors of the
words within WINDOW places, over all texts. Words are kept by hash bucket, so the table has a fixed size at
every scale and no word is left out: words that share a bucket share a vector, in which the frequent ones
weigh most. The sums are whole numbers, so any partitioning gives the same vectors.

A document is the mean and the spread of its words' vectors (without the corpus mean, of length one), a
word of share p of the corpus weighing RARE / (RARE + p); how alike neighbouring words are (the mean cosines
of words one and two places apart); and the logarithm of its number of words. A two-layer network on
standardised features is trained in the driver on at most `most` labelled documents (TRAINING_ROWS), taken in
order of a hash of their ids; a fifth of these set the temperature that calibrates the probabilities and are
not trained on. Scores are made where the documents are.

Defined cases: null and empty texts pool to zeros and get the score of zeros; rows without doc_id are never
learned from and count as held out; rows that repeat a doc_id get a score each and, with one label, are each
learned from; documents whose labels contradict each other are not learned from; without a label of either
kind every score is the share of good labels (0.5 if there are none); columns named like an output column
are replaced. A text is worked on in chunks of words: beside its bytes a long one takes no more than others.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, DoubleType, FloatType, StructField, StructType

from cadenza.llm.common import Words, slices, span_hashes

#: Buckets of words, length of a vector, index numbers of a word, words of context on either side.
BUCKETS, DIM, MARKS, WINDOW = 65_536, 64, 4, 2
#: Share of the corpus at which a word weighs half.
RARE = 1e-3
#: Labelled documents that are learned from at most, hidden units, passes, rows of a step, rate, decay.
TRAINING_ROWS, HIDDEN, PASSES, STEP_ROWS, RATE, DECAY = 20_000, 32, 40, 128, 2e-3, 1e-3
#: Words that are worked on together.
CHUNK = 16_384

_KIND = np.full(256, 3, np.int8)  # letters 1 (all beyond ASCII too), digits 2, signs 3, white space 0
for _kind, _bytes in ((0, [*range(0x09, 0x0E), 0x20]), (2, range(0x30, 0x3A)), (1, [*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 256)])):
    _KIND[list(_bytes)] = _kind


def words_and_signs(data: np.ndarray, bounds: np.ndarray) -> Words:
    """Maximal runs of one kind of characters; none runs on into the next row."""
    kind = _KIND[data]
    edge = np.ones(len(data) + 1, bool)
    edge[1:-1] = kind[1:] != kind[:-1]
    edge[bounds] = True
    at = np.flatnonzero(edge)
    worded = kind[at[:-1]] > 0 if len(at) > 1 else np.zeros(0, bool)
    starts, ends = at[:-1][worded], at[1:][worded]
    first = np.searchsorted(starts, bounds)
    return Words(data, bounds, starts, ends, np.repeat(np.arange(len(bounds) - 1), np.diff(first)), first)


# ---------------------------------------------------------------- word vectors
def index_vectors(hashes: np.ndarray) -> np.ndarray:
    """The index vector of each word: MARKS times +1 or -1 at places drawn from its hash."""
    out = np.zeros((len(hashes), DIM), np.int8)
    rows = np.arange(len(hashes))
    for m in range(MARKS):
        place = ((hashes >> np.uint64(8 * m + 16)) % np.uint64(DIM)).astype(np.int64)
        out[rows, place] += (((hashes >> np.uint64(56 + m)) & np.uint64(1)).astype(np.int8) << 1) - 1
    return out


def _context_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """bucket, n and the sums of a task's texts."""
    total, n = np.zeros((BUCKETS, DIM), np.int64), np.zeros(BUCKETS, np.int64)
    for batch in batches:
        for _, _, data, bounds in slices(batch.column(0)):
            w = words_and_signs(data, bounds)
            hashes = span_hashes(data, w.starts, w.ends)
            bucket = (hashes % np.uint64(BUCKETS)).astype(np.int64)
            n += np.bincount(bucket, minlength=BUCKETS)
            for at in range(0, len(bucket), CHUNK):
                part = slice(at, at + CHUNK + WINDOW)  # a pair counts where its first word stands
                row, own, (distinct, word) = w.row[part], bucket[part], np.unique(hashes[part], return_inverse=True)
                index = index_vectors(distinct)[word]
                around = np.zeros(index.shape, np.int8)  # at most 2 WINDOW MARKS
                for d in range(1, WINDOW + 1):
                    m = min(CHUNK, len(word) - d)
                    if m <= 0:
                        break
                    same = (row[:m] == row[d : m + d])[:, None]
                    around[:m] += index[d : m + d] * same
                    around[d : m + d] += index[:m] * same
                order = np.argsort(own, kind="stable")
                heads = np.flatnonzero(np.append(True, own[order][1:] != own[order][:-1]))
                total[own[order][heads]] += np.add.reduceat(around[order].astype(np.int32), heads, axis=0)
    some = np.flatnonzero(n)
    for at in range(0, len(some), 8192):
        rows = some[at : at + 8192]
        columns = [pa.array(rows.astype(np.int32)), pa.array(n[rows]), *(pa.array(total[rows, i]) for i in range(DIM))]
        yield pa.RecordBatch.from_arrays(columns, names=_SUMS)


_SUMS = ["bucket", "n", *(f"v{i}" for i in range(DIM))]


@dataclass(frozen=True)
class WordVectors:
    vectors: np.ndarray  # BUCKETS x DIM
    weight: np.ndarray  # BUCKETS


def word_vectors(docs: DataFrame) -> WordVectors:
    """Vectors and weights of all words of the texts. BUCKETS rows of fixed length reach the driver."""
    schema = "bucket int, " + ", ".join(f"{c} long" for c in _SUMS[1:])
    summed = docs.select("text").mapInArrow(_context_sums, schema).groupBy("bucket").agg(*(F.sum(c).alias(c) for c in _SUMS[1:]))
    table = summed.toArrow()
    at = table["bucket"].to_numpy()
    n, total = np.zeros(BUCKETS), np.zeros((BUCKETS, DIM))
    n[at] = table["n"].to_numpy()
    for i in range(DIM):
        total[at, i] = table[f"v{i}"].to_numpy()
    mean = total / np.maximum(n, 1)[:, None]
    mean[n > 0] -= total.sum(axis=0) / max(n.sum(), 1)
    length = np.sqrt((mean * mean).sum(axis=1))[:, None]
    share = n / max(n.sum(), 1)
    return WordVectors((mean / np.where(length > 0, length, 1)).astype(np.float32), (RARE / (RARE + share)).astype(np.float32))


#: Numbers of a pooled document.
FEATURES = 2 * DIM + 3


def pooled(data: np.ndarray, bounds: np.ndarray, known: WordVectors) -> np.ndarray:
    """Mean and spread of the word vectors, likeness of neighbours and length of each row: rows x FEATURES."""
    w = words_and_signs(data, bounds)
    bucket = (span_hashes(data, w.starts, w.ends) % np.uint64(BUCKETS)).astype(np.int64)
    rows = len(bounds) - 1
    weight, first, second, alike = np.zeros(rows), np.zeros((rows, DIM)), np.zeros((rows, DIM)), np.zeros((rows, 2))
    for at in range(0, len(bucket), CHUNK):
        ahead = known.vectors[bucket[at : at + CHUNK + 2]]
        for d in (1, 2):
            m = min(CHUNK, len(ahead) - d)
            if m > 0:
                here = w.row[at : at + m]
                cosine = np.einsum("ij,ij->i", ahead[:m], ahead[d : m + d]) * (here == w.row[at + d : at + m + d])
                alike[:, d - 1] += np.bincount(here, cosine, rows)
        own, row = bucket[at : at + CHUNK], w.row[at : at + CHUNK]
        vectors, heavy = known.vectors[own], known.weight[own][:, None]
        heads = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
        of = row[heads]
        weighed = vectors * heavy
        weight[of] += np.add.reduceat(heavy[:, 0], heads)
        first[of] += np.add.reduceat(weighed, heads, axis=0)
        second[of] += np.add.reduceat(np.multiply(weighed, vectors, out=weighed), heads, axis=0)
    mean = first / np.where(weight > 0, weight, 1)[:, None]
    spread = np.sqrt(np.maximum(second / np.where(weight > 0, weight, 1)[:, None] - mean * mean, 0))
    alike /= np.maximum(w.counts[:, None] - np.array([1, 2]), 1)
    return np.concatenate([mean, spread, alike, np.log1p(w.counts)[:, None]], axis=1)


# ---------------------------------------------------------------- network
@dataclass(frozen=True)
class Network:
    """Scores of pooled rows: two layers on standardised features, logits over a temperature."""

    centre: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.centre) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2

    def scores(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(self.logits(x) / self.temperature)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def constant(share: float) -> Network:
    """A network with one score for all."""
    share = min(max(share, 1e-6), 1 - 1e-6)
    return Network(np.zeros(1), np.ones(1), np.zeros((FEATURES, 1)), np.zeros(1), np.zeros(1), float(np.log(share / (1 - share))))


def fit_network(x: np.ndarray, y: np.ndarray, hidden: int = HIDDEN, passes: int = PASSES, seed: int = 1) -> Network:
    """Adam on the cross-entropy, rows in an order drawn from the seed; rates fall to nothing."""
    rng = np.random.Generator(np.random.PCG64(seed))
    centre, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-6)
    z = (x - centre) / scale
    p = [rng.normal(0, z.shape[1] ** -0.5, (z.shape[1], hidden)), np.zeros(hidden), rng.normal(0, hidden**-0.5, hidden), np.array(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))]
    m, v, t = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
    steps = passes * -(-len(z) // STEP_ROWS)
    for _ in range(passes):
        order = rng.permutation(len(z))
        for at in range(0, len(z), STEP_ROWS):
            rows = order[at : at + STEP_ROWS]
            h = np.tanh(z[rows] @ p[0] + p[1])
            off = (_sigmoid(h @ p[2] + p[3]) - y[rows]) / len(rows)
            back = off[:, None] * p[2] * (1 - h * h)
            grads = [z[rows].T @ back + DECAY * p[0], back.sum(axis=0), h.T @ off + DECAY * p[2], off.sum()]
            t += 1
            rate = RATE * (1 - t / (steps + 1))
            for i, g in enumerate(grads):
                m[i], v[i] = 0.9 * m[i] + 0.1 * g, 0.999 * v[i] + 0.001 * g * g
                p[i] = p[i] - rate * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
    return Network(centre, scale, p[0], p[1], p[2], float(p[3]))


def calibrated(net: Network, x: np.ndarray, y: np.ndarray) -> Network:
    """The temperature of least cross-entropy on rows that were not trained on."""
    z = net.logits(x)
    loss = [np.logaddexp(0, np.where(y > 0, -z, z) / t).mean() for t in _TEMPERATURES]
    return Network(net.centre, net.scale, net.w1, net.b1, net.w2, net.b2, float(_TEMPERATURES[int(np.argmin(loss))]))


_TEMPERATURES = np.exp(np.linspace(np.log(0.1), np.log(20), 400))


# ---------------------------------------------------------------- documents
def fold_of(doc_id: Column) -> Column:
    """The crc32 of doc_id as text, modulo 5; null without doc_id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5


def _mapped(docs: DataFrame, name: str, kind, work) -> DataFrame:
    """docs with a column that `work` makes of (bytes, bounds)."""
    kept = [c for c in docs.columns if c != name]
    schema = StructType([*(docs.schema[c] for c in kept), StructField(name, kind)])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [work(data, bounds) for _, _, data, bounds in slices(batch.column("text"))]
            new = pa.chunked_array(made, arrow.field(name).type).combine_chunks() if made else pa.array([], arrow.field(name).type)
            yield pa.RecordBatch.from_arrays([*(batch.column(c).cast(arrow.field(c).type) for c in kept), new], schema=arrow)

    return docs.select(*kept).mapInArrow(run, schema)


def pool(docs: DataFrame, known: WordVectors) -> DataFrame:
    """docs and features, the pooled word vectors of the text."""
    shared = docs.sparkSession.sparkContext.broadcast(known)  # BUCKETS x DIM numbers at every scale

    def work(data: np.ndarray, bounds: np.ndarray) -> pa.Array:
        x = pooled(data, bounds, shared.value)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.astype(np.float32).ravel()))

    return _mapped(docs, "features", ArrayType(FloatType()), work)


def score(docs: DataFrame, known: WordVectors, net: Network) -> DataFrame:
    """docs and score."""
    shared = docs.sparkSession.sparkContext.broadcast((known, net))
    return _mapped(docs, "score", DoubleType(), lambda data, bounds: pa.array(shared.value[1].scores(pooled(data, bounds, shared.value[0]))))


def training_rows(docs: DataFrame, labels: DataFrame, most: int = TRAINING_ROWS) -> DataFrame:
    """doc_id, text and label (0 or 1) of at most `most` labelled ids outside the held-out fold."""
    agreed = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("label"), F.max("quality").alias("_most")).where("label = _most")
    chosen = agreed.where(fold_of(F.col("doc_id")) != 0).orderBy(F.xxhash64(F.col("doc_id")), "doc_id").limit(most).select("doc_id", "label")
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # `most` rows at most


def fit(docs: DataFrame, labels: DataFrame, known: WordVectors, most: int = TRAINING_ROWS) -> Network:
    rows = pool(training_rows(docs, labels, most), known).select(F.xxhash64(F.col("doc_id"), F.lit(1)).alias("place"), "label", "features").toArrow()
    y = rows["label"].to_numpy().astype(float)
    if len(y) < 10 or y.min() == y.max():
        return constant(y.mean() if len(y) else 0.5)
    x = pc.list_flatten(rows["features"]).to_numpy().reshape(len(y), -1).astype(float)
    place = rows["place"].to_numpy()
    order = np.lexsort((*x.T[:2], y, place))  # the same rows in the same order on every run
    x, y, aside = x[order], y[order], place[order] % 5 == 0
    if len(set(y[~aside])) < 2 or not aside.any():
        return fit_network(x, y)
    return calibrated(fit_network(x[~aside], y[~aside]), x[aside], y[aside])


def quality_scores(docs: DataFrame, labels: DataFrame, most: int = TRAINING_ROWS, threshold: float = 0.3) -> DataFrame:
    """docs and held_out, score and predicted (1 if the score reaches the threshold)."""
    known = word_vectors(docs)
    net = fit(docs, labels, known, most)
    held = F.coalesce(fold_of(F.col("doc_id")) == 0, F.lit(True))
    return score(docs, known, net).withColumns({"held_out": held, "predicted": (F.col("score") >= threshold).cast("int")})

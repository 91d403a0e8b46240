"""A quality classifier on random-indexing word vectors.

Every word has a fixed sparse index vector of +1 and -1. A word's vector is the sum of the index vectors of its neighbours over
the whole corpus. Vectors of all words are held in a count sketch of fixed size (``TABLES`` x ``BUCKETS`` x ``CONTEXT``): each
table adds a word's vector to a bucket with a random sign, and the mean over the tables of what its buckets hold, with its signs,
estimates it. Other words of a bucket come with random signs, so they blur a rare word's vector but do not shift it. A
document is the mean of its words' unit vectors, beside the means of their index vectors by spelling and by shape (letters, digits and signs, runs folded). A
network with one hidden layer, in numpy, turns that into a score, and a temperature fitted on rows that it was not trained
on calibrates it.

The table is summed in every task and then by block of buckets, streaming, so memory does not grow with the input. The
network alone is fitted on the driver, on at most ``max_train`` labelled rows, those with the smallest hash of their id.

Null and empty texts are zero vectors and are scored like any other; a text of any length is one row's work, at about 60 bytes
of memory a byte. A document with several labels has the largest; null labels are none. Rows that repeat an id with a label
all teach, the first ``max_train`` by hash and text. Without labels of both kinds, as in an empty table, the score is the share
of label 1, or 0.5. Equal texts get equal scores; null ids have no label; other columns are ignored, and kept by ``passing``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.textvec import U64, Words, chunks, hashes, mix, words

TABLES, BUCKETS, CONTEXT, OWN = 2, 16384, 64, 96
BLOCK = 256
SPARSE = 4
#: Words whose vectors are held at once, in a few arrays of 4 MB.
PART = 1 << 14
SIZE = CONTEXT + 2 * OWN
#: A labelled sample of this many rows fits in a few MB on the driver.
MAX_TRAIN = 8192

_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[65:91] = 65
_SHAPE[97:123] = 97
_SHAPE[48:58] = 48
_SHAPE[128:] = 97


def index(h: np.ndarray, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of the index vectors of word hashes: two (n, SPARSE) arrays."""
    step = mix(h[:, None] + np.arange(1, SPARSE + 1, dtype=U64)[None, :] * U64(0x9E3779B97F4A7C15))
    return ((step >> U64(1)) % U64(dim)).astype(np.int64), ((step & U64(1)).astype(np.int8) * 2 - 1)


def _shapes(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Hash of each word's shape: runs of one kind of byte count once."""
    w = words(_SHAPE[data], off, lower=False)
    keep = np.ones(len(w.bytes), bool)
    keep[1:] = w.bytes[1:] != w.bytes[:-1]
    keep[w.at] = True
    at = np.cumsum(keep)[w.at] - 1
    flat = w.bytes[keep]
    return hashes(Words(flat, at, np.diff(np.append(at, len(flat))), w.row, w.count))


def slots(h: np.ndarray, table: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and sign of each word hash in a table, buckets of all tables numbered through."""
    x = mix(h ^ U64(0xC2B2AE3D27D4EB4F * (table + 1) % (1 << 64)))
    return (x % U64(BUCKETS)).astype(np.int64) + table * BUCKETS, ((x >> U64(63)).astype(np.int8) * 2 - 1)


def neighbours(data: np.ndarray, off: np.ndarray, sketch: np.ndarray) -> None:
    """Add the index vectors of each word's neighbours to its buckets."""
    w = words(data, off)
    if len(w.at) < 2:
        return
    h = hashes(w)
    same = w.row[1:] == w.row[:-1]
    left = np.flatnonzero(same)
    here, there = np.concatenate([left, left + 1]), np.concatenate([left + 1, left])
    place, sign = index(h, CONTEXT)
    for table in range(TABLES):
        bucket, own = slots(h, table)
        at = (bucket[here] - table * BUCKETS)[:, None] * CONTEXT + place[there]
        part = sketch[table * BUCKETS * CONTEXT : (table + 1) * BUCKETS * CONTEXT]
        part += np.bincount(at.ravel(), (sign[there] * own[here][:, None]).ravel(), minlength=BUCKETS * CONTEXT)


def vectors_of(h: np.ndarray, sketch: np.ndarray) -> np.ndarray:
    """Unit vectors of word hashes, as the sketch estimates them."""
    total = np.zeros((len(h), CONTEXT), np.float32)
    for table in range(TABLES):
        bucket, own = slots(h, table)
        total += sketch[bucket] * own[:, None]
    return total / np.maximum(np.linalg.norm(total, axis=1, keepdims=True), 1)


def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The blocks of the sketch of a task's texts."""
    table = np.zeros(TABLES * BUCKETS * CONTEXT)
    for batch in batches:
        for _, _, data, off in chunks(batch.column(0)):
            neighbours(data, off, table)
    blocks = table.reshape(-1, BLOCK * CONTEXT)
    some = np.flatnonzero(blocks.any(axis=1))
    if len(some):
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([_pack(blocks[i].astype(np.int64)) for i in some], pa.binary())], names=["block", "v"])


def word_vectors(docs: DataFrame, *, text_col: str = "text") -> np.ndarray:
    """The sketch of all words' vectors, from all rows."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                sums[block] = sums.get(block, 0) + np.frombuffer(v, np.int32 if len(v) == 4 * BLOCK * CONTEXT else np.int64)
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([v.astype(np.int64).tobytes() for v in sums.values()], pa.binary())], names=["block", "v"])

    parts = docs.select(F.col(text_col).alias("text")).mapInArrow(gather, "block int, v binary")
    table = np.zeros((TABLES * BUCKETS // BLOCK, BLOCK * CONTEXT))
    for r in parts.repartition("block").mapInArrow(add, "block int, v binary").collect():  # TABLES x BUCKETS x CONTEXT numbers in all
        table[r.block] += np.frombuffer(r.v, np.int64)
    return table.reshape(TABLES * BUCKETS, CONTEXT).astype(np.float32)


def _pack(v: np.ndarray) -> bytes:
    return (v.astype(np.int32) if np.abs(v).max() < 2**31 else v).tobytes()


def _cuts(count: np.ndarray) -> Iterator[slice]:
    """Cuts the words of rows into whole rows of at most ``PART`` words in all; a longer row is cut every ``PART`` words."""
    ends = np.cumsum(count)
    a, n = 0, int(ends[-1]) if len(ends) else 0
    while a < n:
        whole = int(np.searchsorted(ends, a + PART, side="right"))
        b = int(ends[whole - 1]) if whole else 0
        b = b if b > a else a + PART
        yield slice(a, b)
        a = b


def pool(data: np.ndarray, off: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Document vectors: one row of ``SIZE`` numbers each."""
    n = len(off) - 1
    w = words(data, off)
    out = np.zeros((n, SIZE), np.float32)
    if not len(w.at):
        return out
    h = hashes(w)
    for part in _cuts(w.count):  # bounds the words' vectors in memory
        rows, at = np.unique(w.row[part], return_index=True)
        kinds, of = np.unique(h[part], return_inverse=True)
        out[rows, :CONTEXT] += np.add.reduceat(vectors_of(kinds, vectors)[of], at, axis=0)
    for lo, keys in ((CONTEXT, h), (CONTEXT + OWN, _shapes(data, off))):
        place, sign = index(keys, OWN)
        flat = np.bincount((w.row[:, None] * OWN + place).ravel(), sign.ravel(), minlength=n * OWN)
        out[:, lo : lo + OWN] = flat.reshape(n, OWN)
    return out / np.maximum(w.count, 1).astype(np.float32)[:, None]


class Network:
    """Two layers, ``SIZE`` to ``hidden`` to 1, trained by Adam on the logistic loss; then one temperature."""

    def __init__(self, x: np.ndarray, y: np.ndarray, *, hidden: int = 32, epochs: int = 60, seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        self.prior = float(y.mean()) if len(y) else 0.5
        self.fitted = len(y) >= 10 and 0 < self.prior < 1
        if not self.fitted:
            return
        order = rng.permutation(len(y))
        cut = max(1, len(y) // 5)
        held, used = order[:cut], order[cut:]
        self.mean, self.scale = x[used].mean(axis=0), x[used].std(axis=0) + 1e-3
        z = ((x - self.mean) / self.scale).astype(np.float32)
        p = [rng.normal(0, 1 / np.sqrt(SIZE), (SIZE, hidden)), np.zeros(hidden), rng.normal(0, 1 / np.sqrt(hidden), hidden), np.zeros(1)]
        p = [a.astype(np.float32) for a in p]
        m, v, t = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
        for _ in range(epochs):
            for at in np.array_split(rng.permutation(used), max(1, len(used) // 128)):
                a = np.maximum(z[at] @ p[0] + p[1], 0)
                d = (1 / (1 + np.exp(-np.clip(a @ p[2] + p[3], -30, 30))) - y[at]) / len(at)
                back = np.outer(d, p[2]) * (a > 0)
                grads = [z[at].T @ back + 1e-3 * p[0], back.sum(axis=0), a.T @ d + 1e-3 * p[2], d.sum(keepdims=True)]
                t += 1
                for i, g in enumerate(grads):
                    m[i] = 0.9 * m[i] + 0.1 * g
                    v[i] = 0.999 * v[i] + 0.001 * g * g
                    p[i] = p[i] - 0.003 * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
        self.p, self.temperature = p, 1.0
        logits, target = self.logits(x[held]), y[held]
        loss = lambda s: np.mean(np.logaddexp(0, -np.where(target > 0, 1, -1) * logits / s))
        self.temperature = float(min(np.exp(np.linspace(-1.5, 3, 91)), key=loss))

    def logits(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.mean) / self.scale
        return np.clip((np.maximum(z @ self.p[0] + self.p[1], 0) @ self.p[2] + self.p[3]).astype(np.float64), -500, 500)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Calibrated probability of label 1."""
        if not self.fitted:
            return np.full(len(x), self.prior)
        return 1 / (1 + np.exp(-self.logits(x) / self.temperature))


def fit(docs: DataFrame, labels: DataFrame, train: Column, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_train: int = MAX_TRAIN) -> tuple[np.ndarray, Network]:
    """Word vectors of all of ``docs`` and a network fitted on labelled rows where ``train`` holds (over ``id_col``)."""
    vectors = word_vectors(docs, text_col=text_col)
    known = labels.where(train & F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("__id")).agg(F.max(label_col).alias("__y"))
    rows = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"))
    there = rows.select("__id").distinct().join(known, "__id")
    sample = there.orderBy(F.xxhash64("__id"), "__id").limit(max_train)
    sent = docs.sparkSession.sparkContext.broadcast(vectors)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, off in chunks(batch.column(2)):
                x = pool(data, off, sent.value)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a).cast(pa.float64()), pa.array([r.tobytes() for r in x], pa.binary())], names=["id", "y", "x"])

    kind = docs.schema[id_col].dataType.simpleString()
    chosen = rows.join(F.broadcast(sample), "__id").select("__id", "__y", "__text").mapInArrow(features, f"id {kind}, y double, x binary")  # max_train rows at most
    first = chosen.orderBy(F.xxhash64("id"), "id", "x").limit(max_train)  # repeated ids may bring more rows than labels
    got = sorted(((r.id, r.x, r.y) for r in first.collect()), key=lambda r: (r[0], r[1]))
    x = np.frombuffer(b"".join(r[1] for r in got), np.float32).reshape(len(got), SIZE)
    return vectors, Network(x, np.array([float(r[2] > 0) for r in got]))


def passing(docs: DataFrame, model: tuple[np.ndarray, Network], *, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that the model predicts to have label 1, with their columns."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors, network = sent.value
        for batch in batches:
            texts = batch.column(0).field(text_col)
            for a, b, data, off in chunks(texts):
                good = network.score(pool(data, off, vectors)) >= 0.5
                yield batch.slice(a, b - a).filter(pa.array(good))

    rows = docs.select(F.struct("*").alias("doc"))
    return rows.mapInArrow(run, rows.schema).select("doc.*")


def score(docs: DataFrame, model: tuple[np.ndarray, Network], keep: list[Column], *, text_col: str = "text") -> DataFrame:
    """The columns ``keep``, ``score`` and ``predicted`` of every row."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors, network = sent.value
        for batch in batches:
            for a, b, data, off in chunks(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(network.score(pool(data, off, vectors)), pa.float64())], names=["keep", "score"])

    rows = docs.select(F.struct(*keep).alias("keep"), F.col(text_col).alias("text"))
    out = rows.mapInArrow(run, f"keep {rows.schema['keep'].dataType.simpleString()}, score double")
    return out.select("keep.*", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))

"""Language-model scores from a log-frequency Bloom filter.

Tokens are lower-cased words and one end per text, known by 64-bit hashes. All words and all adjacent pairs of the training
texts are counted: tasks sum what they can hold, and the rest is summed by a shuffle on the key's top bits (its bucket), whose
number grows with the text. The filter holds quantised counts: an n-gram with count c is entered once for each level up to
``1 + floor(log(c) / log(STEP))``, and a count is read back by probing level after level until one is missing. Each bucket
has a filter of its own, sized by the sum of its levels, so nothing is left out and no worker holds the whole.

Texts are scored in parts of a few MB: a part asks each bucket for its distinct words and pairs, sorted, and gets counts back
in the same order, so only counts travel back.

A token's probability is that of its word, smoothed by adding 1/2 to each count as in the base score; the count of the pair
with its predecessor is smoothed towards it with ``PRIOR`` pseudo-counts, so probabilities sum to 1 up to quantisation. A
text's first token follows a start. As every word is followed by one token, a word's count is its total as predecessor.

The base score needs exact counts, which the buckets keep beside their filters for words.

Null and empty texts are one end token. Rows are scored one by one, so repeated rows agree, and each counts in training.
Without training rows every token is unknown. Null ids count as training rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.durable import release, save
from tidemark.llm.textvec import U64, chunks, hashes, mix, words

END = np.array([0x1D8E4E27C47D124F], U64)
START = np.array([0x0EB44ACCAB455D16], U64)
PRIOR = 500.0
STEP = 1.5
SEGMENT_BITS = 16
BITS_PER_ENTRY = 12
_CHUNK = 1 << 21
#: Distinct keys that a counting task holds before it passes them on.
_HELD = 1 << 21
#: Text per bucket, as a power of two, and the least buckets.
_BUCKET_BYTES, _LEAST_BITS = 23, 4
#: Bits that tell a bucket's pairs apart in its filter; a bucket's size is bounded, so this adds little to the filter's own errors.
_PAIR_BITS = 32
_PROBES = 1 << 16


def level(count: np.ndarray) -> np.ndarray:
    """Quantised count: 0 for none."""
    return np.where(count > 0, 1 + np.floor(np.log(np.maximum(count, 1)) / np.log(STEP) + 1e-9), 0).astype(np.int64)


_LEVELS = level(np.arange(1, 4096))
#: The count that a level stands for: the mean of its whole numbers, or the middle of its range.
COUNT_OF = np.array([0.0] + [float(np.mean(np.flatnonzero(_LEVELS == j) + 1)) if (_LEVELS == j).any() else STEP ** (j - 0.5) for j in range(1, 100)])
# Steps under 2 leave levels without whole numbers; no count ends there.


def pair_key(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Key of a pair of words."""
    return mix(first * U64(0xA24BAED4963EE407) + second)


def _spots(keys: np.ndarray, j: int) -> np.ndarray:
    """Four places of (key, level) in its segment."""
    h = mix(keys + U64((j * 0x9FB21C651E98DF25) % (1 << 64)))
    return np.stack([((h >> U64(16 * i)) & U64(0xFFFF)).astype(np.int64) for i in range(4)])


def _segment(keys: np.ndarray, segments: int) -> np.ndarray:
    return (mix(keys ^ U64(0x5555555555555555)) % U64(segments)).astype(np.int64)


class Filter:
    """The filter's bits, segment by segment."""

    def __init__(self, bits: np.ndarray) -> None:
        self.bits = bits

    def read(self, keys: np.ndarray) -> np.ndarray:
        """Counts of keys, by repeated probes."""
        return COUNT_OF[self.levels(keys)]

    def levels(self, keys: np.ndarray) -> np.ndarray:
        """Quantised counts of keys."""
        return np.concatenate([self._levels(keys[a : a + _PROBES]) for a in range(0, max(len(keys), 1), _PROBES)])

    def _levels(self, keys: np.ndarray) -> np.ndarray:
        out = np.zeros(len(keys), np.int64)
        base = _segment(keys, len(self.bits) >> (SEGMENT_BITS - 3)) << SEGMENT_BITS
        left = np.arange(len(keys))
        for j in range(1, len(COUNT_OF)):
            at = _spots(keys[left], j) + base[left]
            left = left[((self.bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1).all(axis=0)]
            if not len(left):
                break
            out[left] = j
        return out


class Tokens(NamedTuple):
    """Tokens of some texts in order, ends included: hash, text, and how many each text has."""

    h: np.ndarray
    row: np.ndarray
    count: np.ndarray


def tokens(data: np.ndarray, off: np.ndarray) -> Tokens:
    w = words(data, off)
    n = len(off) - 1
    count = w.count + 1
    end = np.cumsum(count) - 1
    h = np.empty(int(count.sum()), U64)
    inner = np.ones(len(h), bool)
    inner[end] = False
    h[inner], h[~inner] = hashes(w), END
    return Tokens(h, np.repeat(np.arange(n), count), count)


def fill(keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The bits of a filter that holds the counts of distinct keys."""
    top = level(counts)
    segments = max(1, -(-BITS_PER_ENTRY * int(top.sum()) >> SEGMENT_BITS))
    bits, base = np.zeros(segments << SEGMENT_BITS, bool), _segment(keys, segments) << SEGMENT_BITS
    for j in range(1, int(top.max(initial=0)) + 1):
        at = np.flatnonzero(top >= j)
        bits[(_spots(keys[at], j) + base[at]).ravel()] = True
    return np.packbits(bits, bitorder="little")


def _planes(x: np.ndarray) -> bytes:
    """64-bit numbers with their first bytes first, then all second bytes, ...: the empty high ones compress well."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8).T).tobytes()


def _numbers(blob: bytes, dtype: type = np.int64) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(blob, np.uint8).reshape(8, -1).T).reshape(-1).view(dtype)


def _pack(keys: np.ndarray) -> bytes:
    """Sorted keys by their differences."""
    return _planes(np.diff(keys, prepend=U64(0)))


def _unpack(blob: bytes) -> np.ndarray:
    return np.cumsum(_numbers(blob, U64), dtype=U64)


def _sum(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the sums of their counts."""
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])[: len(keys)])
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def _cuts(keys: np.ndarray, bits: int, rest: int | None = None) -> np.ndarray:
    """Where the buckets of sorted keys, their bits above the last ``rest``, start and end."""
    inner = np.searchsorted(keys, np.arange(1, 1 << bits).astype(U64) << U64(64 - bits if rest is None else rest))
    return np.concatenate([[0], inner, [len(keys)]])


def _place(sorted_: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Index of each hash in a sorted array, -1 if it is not there."""
    if not len(sorted_):
        return np.full(len(h), -1)
    at = np.minimum(np.searchsorted(sorted_, h), len(sorted_) - 1)
    return np.where(sorted_[at] == h, at, -1)


def pairs(t: Tokens) -> np.ndarray:
    """Key of each token with the one before it."""
    before = np.empty_like(t.h)
    before[1:] = t.h[:-1]
    before[np.cumsum(t.count) - t.count] = START
    return pair_key(before, t.h)


def _short(keys: np.ndarray, bits: int) -> np.ndarray:
    """Keys of pairs as filters know them: the bucket and ``_PAIR_BITS`` more."""
    return keys >> U64(64 - bits - _PAIR_BITS)


def ngram_counts(texts: DataFrame, bits: int) -> DataFrame:
    """``bucket``, and its words and pairs with their counts, packed, of the column ``text``; a bucket has several rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[list, list] = ([], [])

        def out() -> pa.RecordBatch:
            columns = []
            for kind in held:
                h, c = _sum(np.concatenate([x for x, _ in kind]), np.concatenate([c for _, c in kind]))
                cuts = _cuts(h, bits)
                columns.append([_pack(h[a:b]) for a, b in zip(cuts, cuts[1:])])
                columns.append([_planes(c[a:b]) for a, b in zip(cuts, cuts[1:])])
                kind.clear()
            return pa.RecordBatch.from_arrays([pa.array(range(1 << bits), pa.int32()), *[pa.array(c, pa.binary()) for c in columns]], names=["bucket", "words", "word_counts", "pairs", "pair_counts"])

        size = 0
        for batch in batches:
            for _, _, data, off in chunks(batch.column(0), _CHUNK):
                t = tokens(data, off)
                for kind, h in zip(held, (t.h, pairs(t))):
                    kind.append(np.unique(h, return_counts=True))
                    size += len(kind[-1][0])
                if size > _HELD:
                    yield out()
                    size = 0
        if size:
            yield out()

    return texts.mapInArrow(run, "bucket int, words binary, word_counts binary, pairs binary, pair_counts binary")


def filters(counts: DataFrame, bits: int) -> DataFrame:
    """Of each bucket its exact word counts, its filter of words and pairs, and how many tokens and kinds of words it has."""

    def run(rows: pa.Table) -> pa.Table:
        kinds = []
        for name in ("word", "pair"):
            h = [_unpack(x) for x in rows[f"{name}s"].to_pylist()]
            kinds.append(_sum(np.concatenate(h), np.concatenate([_numbers(x) for x in rows[f"{name}_counts"].to_pylist()])))
        (h, c), (pair, n) = kinds
        short, n = _sum(_short(pair, bits), n)
        filled = fill(np.append(h, short), np.append(c, n)).tobytes()
        values = {"bucket": rows["bucket"][0].as_py(), "words": _pack(h), "counts": _planes(c), "bits": filled, "tokens": int(c.sum()), "types": len(h)}
        return pa.Table.from_pylist([values], schema)

    schema = pa.schema([("bucket", pa.int32()), ("words", pa.binary()), ("counts", pa.binary()), ("bits", pa.binary()), ("tokens", pa.int64()), ("types", pa.int64())])
    return counts.groupBy("bucket").applyInArrow(run, "bucket int, words binary, counts binary, bits binary, tokens bigint, types bigint")


def build(entries: DataFrame) -> np.ndarray:
    """The bits of one filter that holds the counts ``c`` of the distinct keys ``h`` of a small table, all levels of them."""
    rows = entries.select("h", "c").toArrow()
    return fill(rows["h"].to_numpy().view(U64), rows["c"].to_numpy())


class Model(NamedTuple):
    """The totals of the training texts, and how many bits of a key are its bucket."""

    tokens: int
    types: int
    bits: int


def train(docs: DataFrame, where: Column, *, text_col: str = "text") -> tuple[Model, DataFrame]:
    """The model and the table of its buckets, from the rows where the condition holds."""
    texts = docs.where(F.coalesce(where, F.lit(True))).select(F.col(text_col).alias("text"))
    size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    bits = max(_LEAST_BITS, (int(size) >> _BUCKET_BYTES).bit_length())
    made = save(filters(ngram_counts(texts, bits), bits), "lm-filters")
    n, v = (x or 0 for x in made.agg(F.sum("tokens"), F.sum("types")).first())
    release(docs.sparkSession)
    return Model(n, v, bits), made


def _zip(data: np.ndarray, off: np.ndarray) -> tuple[bytes, bytes]:
    return pa.Codec("zstd").compress(data.tobytes(), asbytes=True), off.tobytes()


def _unzip(data: bytes, off: bytes) -> Tokens:
    """Tokens of a part."""
    off = np.frombuffer(off, np.int64)
    return tokens(np.frombuffer(pa.Codec("zstd").decompress(data, int(off[-1])), np.uint8), off)


def _ask(parts: DataFrame, bits: int) -> DataFrame:
    """What each part asks of each bucket: its distinct words and pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, off in zip(*(batch.column(i).to_pylist() for i in range(3))):
                t = _unzip(data, off)
                columns = []
                for h, rest in ((np.unique(t.h), None), (np.unique(_short(pairs(t), bits)), _PAIR_BITS)):
                    cuts = _cuts(h, bits, rest)
                    columns.append(pa.array([_pack(h[a:b]) for a, b in zip(cuts, cuts[1:])], pa.binary()))
                n = 1 << bits
                yield pa.RecordBatch.from_arrays([pa.array(range(n), pa.int32()), pa.array(np.full(n, part)), *columns], names=["bucket", "part", "words", "pairs"])

    return parts.select("part", "data", "off").mapInArrow(run, "bucket int, part bigint, words binary, pairs binary").where("length(words) > 0 or length(pairs) > 0")


def _answer(asked: DataFrame, made: DataFrame) -> DataFrame:
    """The exact counts and levels of words and the levels of pairs, in the order asked."""

    def run(asks: pa.Table, bucket: pa.Table) -> pa.Table:
        known = _unpack(bucket["words"][0].as_py()) if len(bucket) else np.zeros(0, U64)
        counts = _numbers(bucket["counts"][0].as_py()) if len(bucket) else np.zeros(0, np.int64)
        filter_ = Filter(np.frombuffer(bucket["bits"][0].as_py(), np.uint8)) if len(bucket) else None
        out: dict[str, list[bytes]] = {"counts": [], "words": [], "pairs": []}
        for name in ("words", "pairs"):
            held = [_unpack(x) for x in asks[name].to_pylist()]
            h = np.concatenate([*held, np.zeros(0, U64)])
            ends = np.cumsum([len(x) for x in held])
            levels = (filter_.levels(h) if filter_ else np.zeros(len(h))).astype(np.uint8)
            out[name] = [levels[b - len(x) : b].tobytes() for x, b in zip(held, ends)]
            if name == "words":
                at = _place(known, h)
                exact = np.where(at >= 0, counts[at], 0) if len(counts) else np.zeros(len(h), np.int64)
                out["counts"] = [_planes(exact[b - len(x) : b]) for x, b in zip(held, ends)]
        return pa.table([asks["part"], asks["bucket"], *[pa.array(x, pa.binary()) for x in out.values()]], names=["part", "bucket", *out])

    return asked.groupBy("bucket").cogroup(made.groupBy("bucket")).applyInArrow(run, "part bigint, bucket int, counts binary, words binary, pairs binary")


def _judge(model: Model, t: Tokens, exact: np.ndarray, words_: np.ndarray, pairs_: np.ndarray) -> tuple[np.ndarray, ...]:
    """Tokens, known tokens, base score and score of each text, from the counts and levels of the distinct words and pairs."""
    n, whole = len(t.count), model.tokens + 0.5 * (model.types + 1)
    kinds, at = np.unique(t.h, return_inverse=True)
    _, pair = np.unique(_short(pairs(t), model.bits), return_inverse=True)
    count = COUNT_OF[words_][at]
    total = np.empty_like(count)
    total[1:] = count[:-1]
    total[np.cumsum(t.count) - t.count] = COUNT_OF[words_][np.searchsorted(kinds, END)]  # a start for each end
    seen = np.minimum(COUNT_OF[pairs_][pair], np.minimum(count, total))  # a pair is no more frequent than its words
    p = (count + 0.5) / whole
    mixed = np.minimum((seen + PRIOR * p) / (total + PRIOR), 1.0)
    return (
        t.count,
        np.bincount(t.row, (exact > 0)[at], minlength=n).astype(np.int64),
        np.bincount(t.row, np.log10((exact + 0.5) / whole)[at], minlength=n),
        np.bincount(t.row, np.log10(mixed), minlength=n),
    )


def score(docs: DataFrame, model: Model, made: DataFrame, keep: list[Column], *, text_col: str = "text") -> DataFrame:
    """The columns ``keep``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score`` and ``score`` of every row."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, off in chunks(batch.column(1), _CHUNK):
                kept = pa.ListArray.from_arrays(pa.array([0, b - a], pa.int32()), pa.concat_arrays([batch.column(0).slice(a, b - a)]))
                yield pa.RecordBatch.from_arrays([kept, *[pa.array([x], pa.binary()) for x in _zip(data, off)]], names=["keep", "data", "off"])

    def run(part: pa.Table, answers: pa.Table) -> pa.Table:
        answers = answers.sort_by("bucket")
        exact = np.concatenate([_numbers(x) for x in answers["counts"].to_pylist()])
        words_, pairs_ = (np.frombuffer(b"".join(answers[name].to_pylist()), np.uint8) for name in ("words", "pairs"))
        t = _unzip(part["data"][0].as_py(), part["off"][0].as_py())
        values = _judge(model, t, exact, words_, pairs_)
        return pa.table([part["keep"].combine_chunks().flatten(), *map(pa.array, values)], names=["keep", "n_tokens", "n_known", "base_score", "score"])

    rows = docs.select(F.struct(*keep).alias("keep"), F.col(text_col).alias("text"))
    kind = rows.schema["keep"].dataType.simpleString()
    parts = save(rows.mapInArrow(cut, f"keep array<{kind}>, data binary, off binary").select(F.monotonically_increasing_id().alias("part"), "data", "off", "keep"), "lm-parts")
    release(docs.sparkSession)
    answers = save(_answer(_ask(parts, model.bits), made), "lm-answers")
    parts.agg(F.count("*")).first()  # once the listeners have let go of the plan above, its shuffle files can be deleted
    release(docs.sparkSession)
    judged = parts.groupBy("part").cogroup(answers.groupBy("part")).applyInArrow(run, f"keep {kind}, n_tokens bigint, n_known bigint, base_score double, score double")
    return judged.select("keep.*", "n_tokens", "n_known", F.lit(model.tokens).cast("bigint").alias("train_tokens"), "base_score", "score")

"""Language identification with hyperdimensional profiles.

Each letter, by its lower-case code point, has a random vector of +1 and -1. A letter trigram is the product of its three letter vectors, the first shifted
twice and the second once, so that order counts. A text is the sum of its trigram vectors, a language the sum of its
training texts; a text gets the language whose prototype has the largest cosine with it.

Bundling is a sum, so a prototype is the product of the language's trigram counts and the trigram vectors: training ships
one count per language and trigram and task, and prototypes are as many vectors as there are languages.

Null texts and texts without a letter are ``und`` with score 0, as is every text if nothing was learned, say from an empty
table. Ties go to the first language in order. A text of any length is one row's work, at about 60 bytes of memory a letter.
Rows are judged one by one, so repeated rows agree; other columns are ignored. Null ids teach and are not held out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.textvec import chunks, mix

#: Bits of a code point in a trigram's code; 0 stands for the edge of a word.
POINT = 21
DIM = 1024
#: Rows summed at once, which bounds the dense counts of a batch.
ROWS = 64
#: Trigrams whose vectors are held at once.
KINDS = 4096
#: Most languages that prototypes are sent to the workers for: 2 kB each.
MAX_LANGUAGES = 20_000


def letter_vectors(points: np.ndarray, dim: int = DIM) -> np.ndarray:
    """The random vectors of letters; a rule makes them from code points, so every worker has the same ones."""
    seeds = points.astype(np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15) + np.arange(dim // 64, dtype=np.uint64)[None, :] * np.uint64(0xD1342543DE82EF95)
    return np.unpackbits(mix(seeds + np.uint64(0x5851F42D4C957F2D)).view(np.uint8), axis=1).astype(np.int8) * 2 - 1


def trigram_vectors(codes: np.ndarray, dim: int = DIM) -> np.ndarray:
    """Bound vectors of trigram codes."""
    last = (1 << POINT) - 1
    points, at = np.unique(np.stack([codes >> (2 * POINT), (codes >> POINT) & last, codes & last]), return_inverse=True)
    letters, (a, b, c) = letter_vectors(points, dim), at.reshape(3, -1)
    return (np.roll(letters, 2, axis=1)[a] * np.roll(letters, 1, axis=1)[b] * letters[c]).astype(np.float32)


def _fold_table() -> np.ndarray:
    """Lower-case code point of every letter of the basic plane; 0 for what is no letter."""
    table = np.zeros(0x10000, np.int64)
    for point in range(0x10000):
        char = chr(point)
        if char.isalpha():
            table[point] = ord(char.lower()[0])
    return table


_fold: np.ndarray | None = None


def trigrams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Row and code of every letter trigram; words are padded with an edge on both sides."""
    global _fold
    if _fold is None:
        _fold = _fold_table()
    rows = [(t or "") + " " for t in texts.to_pylist()]
    sizes = np.array([len(t) for t in rows])
    points = np.frombuffer("".join(rows).encode("utf-32-le", "surrogatepass"), np.uint32)
    code = _fold[np.minimum(points, 0xFFFF)].copy()
    for i in np.flatnonzero(points > 0xFFFF):  # letters beyond the basic plane are rare
        code[i] = ord(chr(points[i]).lower()[0]) if chr(points[i]).isalpha() else 0
    row = np.repeat(np.arange(len(rows)), sizes)
    keep = np.ones(len(code), bool)
    keep[1:] = (code[1:] != 0) | (code[:-1] != 0)  # one edge between words
    code, row = code[keep], row[keep]
    before, after = np.zeros_like(code), np.zeros_like(code)
    before[1:], after[:-1] = code[:-1], code[1:]
    letter = code != 0
    return row[letter], ((before << (2 * POINT)) | (code << POINT) | after)[letter]


def learn(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``lang``, ``trigram``, ``n``: the counts that make the prototypes. Rows without text or language teach nothing."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, tuple[np.ndarray, np.ndarray]] = {}

        def add(lang: str, codes: np.ndarray, n: np.ndarray) -> None:
            if lang in seen:
                codes, n = np.concatenate([seen[lang][0], codes]), np.concatenate([seen[lang][1], n])
            kinds, at = np.unique(codes, return_inverse=True)
            seen[lang] = kinds, np.bincount(at, n, minlength=len(kinds)).astype(np.int64)

        for batch in batches:
            langs = batch.column(1).to_pylist()
            for a, b, _, _ in chunks(batch.column(0)):
                row, code = trigrams(batch.column(0).slice(a, b - a))
                of = np.array(langs[a:b], object)
                for lang in set(langs[a:b]):
                    kinds, n = np.unique(code[(of == lang)[row]], return_counts=True)
                    add(lang, kinds, n)
            if len(seen) > 1000:
                yield from flush(seen)
        yield from flush(seen)

    def flush(seen: dict) -> Iterator[pa.RecordBatch]:
        for lang, (codes, n) in seen.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(codes), pa.string()), pa.array(codes), pa.array(n)], names=["lang", "trigram", "n"])
        seen.clear()

    rows = docs.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    return rows.mapInArrow(count, "lang string, trigram bigint, n bigint").groupBy("lang", "trigram").agg(F.sum("n").alias("n"))


def prototypes(counts: DataFrame, dim: int = DIM) -> tuple[list[str], np.ndarray]:
    """Languages in order and their unit prototypes. Each task sums what it holds; a language gets one vector a task."""

    def bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            langs, codes, n = np.array(batch.column(0).to_pylist(), object), batch.column(1).to_numpy(), batch.column(2).to_numpy()
            for lang in set(langs):
                mine = langs == lang
                for at in range(0, int(mine.sum()), KINDS):
                    part = np.flatnonzero(mine)[at : at + KINDS]
                    sums[lang] = sums.get(lang, 0) + n[part].astype(np.float64) @ trigram_vectors(codes[part], dim)
        for lang, v in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([v.tolist()], pa.list_(pa.float64()))], names=["lang", "v"])

    parts = counts.mapInArrow(bundle, "lang string, v array<double>")
    summed = parts.select("lang", F.posexplode("v").alias("i", "x")).groupBy("lang", "i").agg(F.sum("x").alias("x")).groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("i", "x"))).alias("v"))
    rows = summed.select("lang", F.col("v.x").alias("v")).limit(MAX_LANGUAGES + 1).collect()
    if len(rows) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages: lang holds something else")
    rows.sort(key=lambda r: r.lang)
    vectors = np.array([r.v for r in rows]).reshape(len(rows), dim)
    return [r.lang for r in rows], (vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)).astype(np.float32)


def predict(docs: DataFrame, langs: list[str], protos: np.ndarray, keep: list[Column], *, text_col: str = "text") -> DataFrame:
    """The columns ``keep``, then ``lang_pred`` and ``score``, the cosine cut to 0..1."""
    sent = docs.sparkSession.sparkContext.broadcast((langs, protos))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, protos = sent.value
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                best, score = judge(part.column(1), langs, protos)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(best, pa.string()), pa.array(score, pa.float64())], names=["keep", "lang_pred", "score"])

    rows = docs.select(F.struct(*keep).alias("keep"), F.col(text_col).alias("text"))
    out = rows.mapInArrow(run, f"keep {rows.schema['keep'].dataType.simpleString()}, lang_pred string, score double")
    return out.select("keep.*", "lang_pred", "score")


def judge(texts: pa.Array, langs: list[str], protos: np.ndarray) -> tuple[list[str], np.ndarray]:
    """Language and score of each text."""
    n = len(texts)
    row, code = trigrams(texts)
    if not len(code) or not langs:
        return ["und"] * n, np.zeros(n)
    kinds, at = np.unique(code, return_inverse=True)
    vectors = np.zeros((n, protos.shape[1]), np.float32)
    for lo in range(0, len(kinds), KINDS):  # bounds the table of trigram vectors
        mine = (at >= lo) & (at < lo + KINDS)
        size = min(KINDS, len(kinds) - lo)
        dense = np.bincount(row[mine] * size + at[mine] - lo, minlength=n * size).astype(np.float32).reshape(n, size)
        vectors += dense @ trigram_vectors(kinds[lo : lo + KINDS], protos.shape[1])
    norm = np.linalg.norm(vectors, axis=1)
    cosine = (vectors @ protos.T) / np.maximum(norm, 1e-12)[:, None]
    best = cosine.argmax(axis=1)
    seen = np.bincount(row, minlength=n) > 0
    score = np.where(seen, np.clip(cosine[np.arange(n), best], 0, 1), 0).astype(np.float64)
    return [langs[b] if s else "und" for b, s in zip(best, seen, strict=True)], score


def identify(docs: DataFrame, train: Column, keep: list[Column], *, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Learn from the rows where ``train`` holds, then judge every row."""
    langs, protos = prototypes(learn(docs.where(F.coalesce(train, F.lit(True))), text_col=text_col, lang_col=lang_col))
    return predict(docs, langs, protos, keep, text_col=text_col)

"""Document fingerprints: sketches of all shingle hashes below a threshold.

A text's shingles are its windows of ``SHINGLE`` lower-cased words (fewer words make one shingle). A fingerprint keeps every
48-bit shingle hash below ``fraction`` of the range, and the smallest hash in any case, as 12 hexadecimal digits each, in
order. Fingerprints of parts merge by the union of their hashes; as the threshold is fixed, the share of one text's hashes
that another's has estimates containment, however unequal the texts are.

Null texts are empty; texts without words have the empty fingerprint. Two empty fingerprints are alike (1), an empty and
another are not (0). Equal texts have equal fingerprints. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.textvec import U64, chunks, hashes, shingles, words

SHINGLE = 5
#: A quarter keeps the error of a likeness near 0.04 for texts of a few hundred words.
FRACTION = 1 / 4
_HEX = np.frombuffer(b"0123456789abcdef", np.uint8)


def sketch(data: np.ndarray, off: np.ndarray, *, fraction: float = FRACTION, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Kept hashes of all rows end to end, ascending within a row, and how many each row has."""
    n = len(off) - 1
    w = words(data, off)
    h, row = shingles(hashes(w), w.count, k)
    h = h >> U64(16)
    low = np.full(n, np.iinfo(np.uint64).max, U64)
    np.minimum.at(low, row, h)
    keep = (h < U64(int(fraction * 2**48))) | (h == low[row])
    h, row = h[keep], row[keep]
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    return h[new], np.bincount(row[new], minlength=n)


def text_of(h: np.ndarray, count: np.ndarray) -> list[str]:
    """Fingerprints as strings."""
    digits = np.empty((len(h), 12), np.uint8)
    for i in range(12):
        digits[:, i] = _HEX[((h >> U64(44 - 4 * i)) & U64(15)).astype(np.int64)]
    flat = digits.tobytes().decode("ascii")
    end = 12 * np.cumsum(count)
    return [flat[a:b] for a, b in zip((end - 12 * count).tolist(), end.tolist(), strict=True)]


def _below(a: np.ndarray, b: np.ndarray, fraction: float) -> tuple[np.ndarray, np.ndarray]:
    """Both sketches on common ground: hashes below the threshold, or the smallest ones if there are none."""
    limit = U64(int(fraction * 2**48))
    x, y = a[a < limit], b[b < limit]
    return (x, y) if len(x) or len(y) else (a, b)


def likeness(a: np.ndarray, b: np.ndarray, fraction: float = FRACTION) -> float:
    """Estimated Jaccard similarity of two sketches."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    x, y = _below(a, b, fraction)
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / (len(x) + len(y) - both)


def containment(a: np.ndarray, b: np.ndarray, fraction: float = FRACTION) -> float:
    """Estimated share of ``a``'s shingles that ``b`` has."""
    if not len(a):
        return 1.0
    x, y = _below(a, b, fraction)
    return len(np.intersect1d(x, y, assume_unique=True)) / len(x) if len(x) else 0.0


def hashes_of(fingerprint: str) -> np.ndarray:
    """The hashes of a fingerprint string."""
    return np.array([int(fingerprint[i : i + 12], 16) for i in range(0, len(fingerprint), 12)], U64)


def merge(a: str, b: str) -> str:
    """The fingerprint of two texts' shingles together."""
    h = np.union1d(hashes_of(a), hashes_of(b))
    keep = h[(h < U64(int(FRACTION * 2**48))) | (h == h.min(initial=2**63))]
    return text_of(keep, np.array([len(keep)]))[0]


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", fraction: float = FRACTION) -> DataFrame:
    """``id_col`` and ``fingerprint`` of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, off in chunks(batch.column(1)):
                prints = text_of(*sketch(data, off, fraction=fraction))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(prints, pa.string())], names=["id", "fingerprint"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {kind}, fingerprint string").withColumnRenamed("id", id_col)


def ordered_neighbours(docs: DataFrame, *, id_col: str, text_col: str, buckets: int) -> DataFrame:
    """Rows dealt by ranges of ``id_col`` and sorted, largest id first, each range followed by a copy of the row after it.

    The ranges come from a quantile sketch of the ids alone, so the texts are shuffled once. Columns: ``bucket``, ``copy``,
    ``id``, ``text``. The range of the smallest ids is followed by a copy of the largest. Null ids count as the smallest.
    """
    lowest = -(2**63)
    rows = docs.select(F.coalesce(F.col(id_col).cast("bigint"), F.lit(lowest)).alias("id"), F.col(text_col).alias("text"))
    ids = rows.select("id")
    cuts = ids.agg(F.percentile_approx("id", [i / buckets for i in range(1, buckets)], 100 * buckets).alias("c")).first().c if buckets > 1 else []
    edges = np.array(sorted(set(cuts or [])), np.int64)

    @F.pandas_udf("int")
    def bucket(of: pd.Series) -> pd.Series:
        return pd.Series(len(edges) - np.searchsorted(edges, of.to_numpy(), side="left"))  # 0 holds the largest ids

    tops = ids.groupBy(bucket("id").alias("b")).agg(F.max("id").alias("top")).orderBy("b").collect()  # a row a bucket
    follows = {r.top: tops[i - 1].b for i, r in enumerate(tops)}  # the row at the top of a range follows the range before

    @F.pandas_udf("int")
    def follower(of: pd.Series) -> pd.Series:
        return of.map(follows).astype("Int32")

    own = F.struct(bucket("id").alias("bucket"), F.lit(False).alias("copy"))
    again = F.struct(follower("id").alias("bucket"), F.lit(True).alias("copy"))
    dealt = rows.select(F.explode(F.array(own, again)).alias("p"), "id", "text").where("p.bucket is not null").select("p.*", "id", "text")
    return dealt.repartition(max(1, buckets // 8), "bucket").sortWithinPartitions("bucket", "copy", F.desc("id"), F.col("text").asc_nulls_first())


def edited_pairs(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", fraction: float = FRACTION) -> DataFrame:
    """Fingerprints of every text and of its edited text, with their likeness and that of the next document's.

    The edited text has its last third of code points replaced by as many of the next document's first ones; documents are
    in descending order of ``id_col`` (rows of one id by their texts), and the last is followed by the first. Columns:
    ``id_col``, ``n_chars``, ``edited_sha256``, ``fingerprint``, ``edited_fingerprint``, ``near_edited``, ``near_next``.
    """
    spark = docs.sparkSession
    buckets = 8 * max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = ordered_neighbours(docs, id_col=id_col, text_col=text_col, buckets=buckets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []  # rows of one bucket whose next is not yet seen: the last one only
        for batch in batches:
            for a, b, _, _ in chunks(batch.column(3), 1 << 19):
                part = batch.slice(a, b - a)
                rows = held + list(zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2).to_pylist(), [t or "" for t in part.column(3).to_pylist()], strict=True))
                pairs = [i for i, (x, y) in enumerate(zip(rows, rows[1:])) if x[0] == y[0] and not x[1]]
                held = rows[-1:]
                if pairs:
                    yield judged(rows, pairs)

    def sketches(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        parts = [sketch(data, off, fraction=fraction) for _, _, data, off in chunks(pa.array(texts, pa.string()))]
        return np.concatenate([h for h, _ in parts]), np.concatenate([n for _, n in parts])

    def judged(rows: list[tuple], pairs: list[int]) -> pa.RecordBatch:
        texts, edited = [r[3] for r in rows], []
        for i in pairs:
            k = len(texts[i]) // 3
            edited.append(texts[i][: len(texts[i]) - k] + texts[i + 1][:k])
        (h, n), (g, m) = sketches(texts), sketches(edited)
        all_, ours = np.split(h, np.cumsum(n)[:-1]), np.split(g, np.cumsum(m)[:-1])
        prints = text_of(h, n)
        return pa.RecordBatch.from_arrays(
            [
                pa.array([rows[i][2] for i in pairs], pa.int64()),
                pa.array([len(texts[i]) for i in pairs], pa.int64()),
                pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited]),
                pa.array([prints[i] for i in pairs]),
                pa.array(text_of(g, m)),
                pa.array([likeness(all_[i], e, fraction) for i, e in zip(pairs, ours, strict=True)], pa.float64()),
                pa.array([likeness(all_[i], all_[i + 1], fraction) for i in pairs], pa.float64()),
            ],
            names=["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
        )

    out = dealt.mapInArrow(run, "id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
    return out.withColumn("id", F.nullif("id", F.lit(-(2**63)))).withColumnRenamed("id", id_col)

"""Whole columns of text as flat numpy arrays: words, word hashes and shingle hashes without a Python loop per word.

Words are maximal runs outside ``[\\x20\\x09-\\x0D]``; as those six are ASCII, byte positions in UTF-8 are enough. A word is
known by a 64-bit hash, which mixes its bytes in blocks of eight under a fixed key; long words are hashed by blake2b.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
GAP = np.zeros(256, bool)
GAP[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_KEY = U64(0x9E3779B97F4A7C15)
_ROUND = U64(0xA0761D6478BD642F)
_SHINGLE = U64(0xD6E8FEB86659FD93)
#: Bytes of a word beyond which a digest is cheaper than block rounds, which run once for all words of a batch.
_LONG = 256


def mix(x: np.ndarray) -> np.ndarray:
    """Finisher that spreads every input bit over all 64 output bits."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def raw(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and row offsets of a string column; null rows are empty."""
    col = pc.fill_null(col.cast(pa.large_string()), "")
    off = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    data = col.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), off


def chunks(col: pa.Array, limit: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Consecutive rows ``[a, b)`` of about ``limit`` bytes, with their bytes and offsets; a longer row stands alone."""
    if not len(col):
        return
    data, off = raw(col)
    a, n = 0, len(col)
    while a < n:
        b = max(a + 1, int(np.searchsorted(off, off[a] + limit, side="right")) - 1)
        yield a, b, data[off[a] : off[b]], off[a : b + 1] - off[a]
        a = b


class Words(NamedTuple):
    """Words of some rows, in order: bytes, offsets into them, lengths, row of each word, words of each row."""

    bytes: np.ndarray
    at: np.ndarray
    size: np.ndarray
    row: np.ndarray
    count: np.ndarray


def words(data: np.ndarray, off: np.ndarray, lower: bool = True) -> Words:
    """Cut the rows into words; ``lower`` maps A-Z to a-z."""
    rows = len(off) - 1
    data = LOWER[data] if lower else data
    inside = ~GAP[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    heads = off[:-1][off[:-1] < len(data)]
    first[heads] = inside[heads]
    start = np.flatnonzero(first)
    at = np.cumsum(inside)[start] - 1 if len(start) else start
    flat = data[inside]
    row = np.searchsorted(off, start, side="right") - 1
    return Words(flat, at, np.diff(np.append(at, len(flat))), row, np.bincount(row, minlength=rows))


def hashes(w: Words) -> np.ndarray:
    """A 64-bit hash of each word: its length and its blocks of eight bytes, mixed one after the other."""
    if not len(w.at):
        return np.zeros(0, U64)
    padded = np.concatenate([w.bytes, np.zeros(8, np.uint8)])
    blocks = np.ndarray(len(w.bytes), U64, padded, strides=(1,))  # the eight bytes from each place on
    h = mix(w.size.astype(U64) + _KEY)
    short = w.size <= _LONG
    for r in range(-(-int(w.size[short].max(initial=0)) // 8)):
        alive = np.flatnonzero(short & (w.size > 8 * r))
        block, rest = blocks[w.at[alive] + 8 * r], 8 * np.minimum(w.size[alive] - 8 * r, 8)
        block &= ~U64(0) >> (64 - rest).astype(U64)
        h[alive] = mix((h[alive] ^ block) * _ROUND + U64(r))
    for i in np.flatnonzero(~short):
        h[i] = U64(int.from_bytes(hashlib.blake2b(w.bytes[w.at[i] : w.at[i] + w.size[i]], digest_size=8, key=b"tidemark").digest(), "little"))
    return h


def shingles(h: np.ndarray, count: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all ``k``-word windows and the row of each; fewer words make one shingle of the whole sequence."""
    rows = np.arange(len(count))
    first = np.cumsum(count) - count
    out, of = [], []
    for m in range(1, k + 1):
        if m == k:
            full = np.maximum(count - k + 1, 0)
            row = np.repeat(rows, full)
            at = np.arange(len(row)) - np.repeat(np.cumsum(full) - full, full) + np.repeat(first, full)
        else:
            row = rows[count == m]
            at = first[row]
        if len(row):
            value = np.full(len(row), m, U64)
            for j in range(m):
                value = value * _SHINGLE + h[at + j]
            out.append(mix(value))
            of.append(row)
    if not out:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    return np.concatenate(out), np.concatenate(of)


def ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Indices of the concatenated ranges ``[start, start + size)``."""
    total = int(sizes.sum())
    return np.arange(total) + np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)

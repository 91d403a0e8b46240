"""SentencePiece BPE in flat numpy arrays, exact to the library.

A text becomes code points with ``▁`` for spaces and one ``▁`` in front. It is cut where no piece of the vocabulary holds
the two neighbouring characters, so no merge can cross a cut. The distinct words of a batch are encoded together: in every
round each word takes its best pair, the leftmost of equals, all words at once; arrays are compacted and finished words
leave, until no pair remains. Characters that are left and have no piece become byte pieces. Decoding gathers the bytes of
the pieces and takes one leading space away.

Null texts are empty; an empty text has only the begin and end ids and decodes to an empty text. Rows are handled one by
one, so ties and repeated rows need no rule; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.textvec import U64, Words, chunks, hashes, ragged

SPACE = 0x2581
_NONE = np.iinfo(np.int32).max
_MUL = U64(0x9E3779B97F4A7C15)


class Pieces:
    """A model's vocabulary as lookup tables."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.bos, self.eos = sp.bos_id(), sp.eos_id()
        normal = [i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i))]
        text = {i: sp.id_to_piece(i) for i in normal}
        self.byte = np.zeros(256, np.int64)
        for i in range(n):
            if sp.is_byte(i):
                self.byte[int(sp.id_to_piece(i)[3:-1], 16)] = i
        order = {s: r for r, s in enumerate(sorted({sp.get_score(i) for i in normal}, reverse=True))}
        symbol = {s: i for i, s in text.items()}
        for s in text.values():  # characters of pieces that are no pieces themselves
            for c in s:
                symbol.setdefault(c, len(symbol) + n)
        self.extra = n
        self.codes = np.array(sorted(ord(s) for s in symbol if len(s) == 1), np.int64)
        self.code_ids = np.array([symbol[chr(c)] for c in self.codes], np.int64)
        keys, merged, ranks = [], [], []
        for i, s in text.items():
            for k in range(1, len(s)):
                if s[:k] in symbol and s[k:] in symbol:
                    keys.append((symbol[s[:k]] << 32) | symbol[s[k:]])
                    merged.append(i)
                    ranks.append(order[sp.get_score(i)])
        self._hash(np.array(keys, U64), np.array(merged, np.int64), np.array(ranks, np.int32))
        near = {(ord(a) << 32) | ord(b) for s in text.values() for a, b in zip(s, s[1:])}
        self.near = np.array(sorted(near), np.int64)
        low = 0x300
        self.near_low = np.zeros((low, low), bool)
        for a, b in ((v >> 32, v & 0xFFFFFFFF) for v in near):
            a, b = (0 if x == SPACE else x for x in (a, b))
            if a < low and b < low:
                self.near_low[a, b] = True
        raw = [b""] * n
        for i, s in text.items():
            raw[i] = s.replace("▁", " ").encode()
        for value, i in enumerate(self.byte):
            if sp.is_byte(int(i)):
                raw[i] = bytes([value])
        unknown = sp.unk_id()
        if unknown >= 0:
            raw[unknown] = sp.decode([unknown]).encode() if sp.decode([unknown]) else " ⁇ ".encode()
        self.raw_size = np.array([len(r) for r in raw], np.int64)
        self.raw_at = np.cumsum(self.raw_size) - self.raw_size
        self.raw = np.frombuffer(b"".join(raw), np.uint8)

    def _hash(self, keys: np.ndarray, merged: np.ndarray, ranks: np.ndarray) -> None:
        """Open addressing with a bounded number of probes."""
        bits = 20
        while True:
            size = 1 << bits
            slot = ((keys * _MUL) >> U64(64 - bits)).astype(np.int64)
            table = np.full(size + 64, -1, np.int64)
            left, step = np.arange(len(keys)), 0
            while len(left) and step < 64:
                at = slot[left] + step
                free = table[at] < 0
                took, first = np.unique(at[free], return_index=True)
                table[took] = left[free][first]
                left, step = left[table[at] != left], step + 1
            if not len(left):
                break
            bits += 1
        self.shift, self.steps = U64(64 - bits), step
        self.keys = np.where(table >= 0, keys[table], ~U64(0)) if len(keys) else np.full(len(table), ~U64(0), U64)
        self.merged = np.where(table >= 0, merged[table], -1) if len(keys) else np.full(len(table), -1)
        self.ranks = np.where(table >= 0, ranks[table], _NONE).astype(np.int32) if len(keys) else np.full(len(table), _NONE, np.int32)

    def pairs(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and merged id of neighbouring symbols; a symbol below 0 pairs with nothing."""
        key = (a.astype(U64) << U64(32)) | b.astype(U64)
        at = ((key * _MUL) >> self.shift).astype(np.int64)
        rank, to = np.full(len(a), _NONE, np.int32), np.full(len(a), -1, np.int64)
        open_ = np.flatnonzero((a >= 0) & (b >= 0))
        for step in range(self.steps):
            if not len(open_):
                break
            slot = at[open_] + step
            found = self.keys[slot]
            hit = found == key[open_]
            rank[open_[hit]], to[open_[hit]] = self.ranks[slot[hit]], self.merged[slot[hit]]
            open_ = open_[~hit & (found != ~U64(0))]
        return rank, to

    def touching(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether some piece holds the two characters side by side."""
        x, y = np.where(a == SPACE, 0, a), np.where(b == SPACE, 0, b)
        out = np.zeros(len(a), bool)
        low = (x < 0x300) & (y < 0x300) & (a != 0) & (b != 0)
        out[low] = self.near_low[x[low], y[low]]
        rest = np.flatnonzero(~low)
        if len(rest) and len(self.near):
            key = (a[rest].astype(np.int64) << 32) | b[rest].astype(np.int64)
            at = np.minimum(np.searchsorted(self.near, key), len(self.near) - 1)
            out[rest] = self.near[at] == key
        return out

    def symbols(self, codes: np.ndarray) -> np.ndarray:
        """Symbol of each character, or -1 - code point."""
        at = np.minimum(np.searchsorted(self.codes, codes), len(self.codes) - 1)
        return np.where(self.codes[at] == codes, self.code_ids[at], -1 - codes.astype(np.int64))

    def merge(self, sym: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merge rounds over words laid end to end: symbols and sizes of the words when no pair remains."""
        done_sym, done_word, live = [], [], np.arange(len(size))
        out_size = size.copy()
        last = np.zeros(len(sym), bool)
        last[np.cumsum(size) - 1] = True
        rank, to = np.full(len(sym), _NONE, np.int32), np.full(len(sym), -1, np.int64)
        inner = np.flatnonzero(~last)
        rank[inner], to[inner] = self.pairs(sym[inner], sym[inner + 1])
        while len(live):
            start = np.cumsum(size) - size
            best = np.minimum.reduceat(rank, start)
            going = best != _NONE
            if not going.all():
                stop = ~going
                done_sym.append(sym[np.repeat(stop, size)])
                done_word.append(np.repeat(live[stop], size[stop]))
                out_size[live[stop]] = size[stop]
                stay = np.repeat(going, size)
                sym, rank, to, live, size, best = sym[stay], rank[stay], to[stay], live[going], size[going], best[going]
                if not len(live):
                    break
                start = np.cumsum(size) - size
            hits = np.flatnonzero(rank == np.repeat(best, size))
            word = np.searchsorted(start, hits, side="right") - 1
            first = np.ones(len(hits), bool)
            first[1:] = word[1:] != word[:-1]
            at = hits[first]  # one a word, in order
            sym[at] = to[at]
            stays = np.ones(len(sym), bool)
            stays[at + 1] = False
            shift = np.cumsum(stays) - 1
            sym, rank, to = sym[stays], rank[stays], to[stays]
            at, size = shift[at], size - 1
            start = np.cumsum(size) - size
            end = start + size - 1
            rank[end] = _NONE
            left, right = at[at > start] - 1, at[at < end]
            again = np.concatenate([left, right])
            rank[again], to[again] = self.pairs(sym[again], sym[again + 1])
        if not done_sym:
            return sym, out_size
        word = np.concatenate(done_word)
        return np.concatenate(done_sym)[np.argsort(word, kind="stable")], out_size

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, without begin and end, and how many each text has."""
        rows = ["▁" + t.replace(" ", "▁") if t else "" for t in texts]
        length = np.array([len(r) for r in rows], np.int64)
        codes = np.frombuffer("".join(rows).encode("utf-32-le"), np.uint32).astype(np.int64)
        if not len(codes):
            return np.zeros(0, np.int64), np.zeros(len(texts), np.int64)
        cut = np.ones(len(codes), bool)
        cut[1:] = ~self.touching(codes[:-1], codes[1:])
        heads = np.cumsum(length) - length
        cut[heads[length > 0]] = True
        start = np.flatnonzero(cut)
        size = np.diff(np.append(start, len(codes)))
        row = np.searchsorted(np.cumsum(length), start, side="right")
        first, inverse = self._distinct(codes, start, size)
        own = size[first]
        sym, n = self.merge(self.symbols(codes[ragged(start[first], own)]), own)
        ids, n = self._bytes(sym, n)
        at = np.cumsum(n) - n
        counts = np.bincount(row, n[inverse], minlength=len(texts)).astype(np.int64)
        return ids[ragged(at[inverse], n[inverse])], counts

    def _distinct(self, codes: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The first of each kind of word, and the kind of every word.

        Words are sorted by a hash of their characters and then compared with the first of their hash, character by character;
        one that differs from it is a kind of its own.
        """
        key = hashes(Words(np.ascontiguousarray(codes, "<u4").view(np.uint8), 4 * start, 4 * size, start, size))
        _, first, inverse = np.unique(key, return_index=True, return_inverse=True)
        there = first[inverse]
        odd = size[there] != size
        alike = np.flatnonzero(~odd)
        own = size[alike]
        equal = codes[ragged(start[alike], own)] == codes[ragged(start[there[alike]], own)]
        odd[alike] = ~np.logical_and.reduceat(equal, np.cumsum(own) - own)
        more = np.flatnonzero(odd)
        inverse[more] = len(first) + np.arange(len(more))
        return np.append(first, more), inverse

    def _bytes(self, sym: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Replace characters without a piece by the pieces of their bytes."""
        odd = (sym < 0) | (sym >= self.extra)
        if not odd.any():
            return sym, n
        chars = {i: c for c, i in zip(self.codes.tolist(), self.code_ids.tolist(), strict=True) if i >= self.extra}
        raw = [chr(chars[s] if s >= self.extra else -1 - s).encode() for s in sym[odd].tolist()]
        wide = np.ones(len(sym), np.int64)
        wide[odd] = [len(r) for r in raw]
        out = np.repeat(sym, wide)
        out[np.repeat(odd, wide)] = self.byte[np.frombuffer(b"".join(raw), np.uint8)]
        word = np.repeat(np.arange(len(n)), n)
        return out, np.bincount(word, wide, minlength=len(n)).astype(np.int64)

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[bytes]:
        """UTF-8 of each text whose ids stand end to end; control ids have no text."""
        size = self.raw_size[ids]
        flat = self.raw[ragged(self.raw_at[ids], size)].tobytes()
        ends = np.cumsum(np.bincount(np.repeat(np.arange(len(counts)), counts), size, minlength=len(counts)).astype(np.int64))
        out, a = [], 0
        for b in ends.tolist():
            out.append(flat[a + 1 : b] if flat[a : a + 1] == b" " and b > a else flat[a:b])
            a = b
        return out


def encode_decode(docs: DataFrame, model: str, *, id_col: str = "doc_id", text_col: str = "text", output: str = "digest") -> DataFrame:
    """Encode every text with begin and end ids and decode the ids again.

    ``output='digest'`` returns ``id_col``, ``n_tokens``, ``ids_sha256`` and ``decoded_sha256``; ``'full'`` returns ``ids``
    (array) and ``decoded`` (text) instead of the digests, ``'ids'`` the ids and the digests. ``model`` is a path that every worker can open.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    rest = {"digest": "ids_sha256 string, decoded_sha256 string", "full": "ids array<int>, decoded string", "ids": "ids array<int>, ids_sha256 string, decoded_sha256 string"}[output]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces(model)
        for batch in batches:
            for a, b, _, _ in chunks(batch.column(1)):
                ids, counts = pieces.encode([t or "" for t in batch.column(1).slice(a, b - a).to_pylist()])
                full = np.empty(len(ids) + 2 * len(counts), np.int64)
                end = np.cumsum(counts + 2)
                full[end - counts - 2], full[end - 1] = pieces.bos, pieces.eos
                full[ragged(end - counts - 1, counts)] = ids
                decoded = pieces.decode(full, counts + 2)
                flat, lo = full.astype("<u4"), end - counts - 2
                spans = zip(lo.tolist(), end.tolist(), strict=True)
                cols = []
                if output != "digest":
                    cols.append(pa.ListArray.from_arrays(pa.array(np.append(0, end), pa.int32()), pa.array(full, pa.int32())))
                if output == "full":
                    cols.append(pa.array([d.decode(errors="replace") for d in decoded], pa.string()))
                else:
                    cols += [pa.array([hashlib.sha256(flat[x:y]).hexdigest() for x, y in spans]), pa.array([hashlib.sha256(d).hexdigest() for d in decoded])]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(counts + 2, pa.int64()), *cols], names=["id", "n_tokens", *(c.split()[0] for c in rest.split(", "))])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {kind}, n_tokens bigint, {rest}").withColumnRenamed("id", id_col)

"""Token counts without token ids.

Texts are cut into pre-tokens, and a part of a few MB of texts keeps how often each occurs in each document. A part asks each
bucket of pre-tokens, by a hash, for the counts of its distinct ones. A bucket, whose number grows with the text, encodes every
distinct pre-token that any part asks for once and answers with numbers of pieces. The answers are joined to the frequencies
of the part, multiplied and summed by document, so ids are never kept and texts are neither shuffled nor written.
Strings of special tokens count as one token each, the library's default.

Null and empty texts have 0 tokens. A text of any length is one row's work, at about 60 bytes of memory a byte. Rows are counted
one by one, so ties and repeated rows agree; an empty table gives an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.durable import release, save
from tidemark.llm.textvec import chunks

#: Bytes of text in a part, and in the share of a bucket as a power of two; the least buckets.
_PART, _BUCKET_BYTES, _LEAST_BITS = 4 << 20, 23, 4
_pre: dict[str, PreTokens] = {}


class PreTokens:
    """Cuts texts into special strings and pre-tokens, and counts the pieces of pre-tokens."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.cut = regex.compile("|".join(map(regex.escape, self.special))) if self.special else None
        self.find = regex.compile(public_tokenizers.PATTERN).findall
        # Letters and blanks are classed alike by both regex engines here; other texts are cut by the library itself.
        self.plain = regex.compile(r"[\x09-\x0D\x20-\x7E\xA0-ɏ‐-‧‰-›€]*").fullmatch

    def of(self, text: str) -> tuple[int, list[str]]:
        """Special strings in the text, and the pre-tokens of the rest."""
        parts = self.cut.split(text) if self.cut and any(s in text for s in self.special) else [text]
        found: list[str] = []
        for part in parts:
            found += self.find(part) if self.plain(part) else [part[a:b] for _, (a, b) in self.tokenizer.pre_tokenizer.pre_tokenize_str(part)]
        return len(parts) - 1, found

    def pieces(self, distinct: list[str]) -> np.ndarray:
        """How many pieces each pre-token has."""
        out = []
        for at in range(0, len(distinct), 4096):
            out += [len(e) for e in self.tokenizer.encode_batch_fast(distinct[at : at + 4096], add_special_tokens=False)]
        return np.array(out, np.int32)


def pre_tokens(path: str) -> PreTokens:
    """The tokenizer of a path, opened once a worker."""
    if path not in _pre:
        _pre[path] = PreTokens(path)
    return _pre[path]


class _Places(dict):
    """Numbers what it is asked for in order of first sight."""

    def __missing__(self, key: str) -> int:
        self[key] = n = len(self)
        return n


def frequencies(cutter: PreTokens, texts: list[str], bits: int) -> tuple[list[int], list[np.ndarray], list[np.ndarray], list[tuple[int, list[str]]]]:
    """Of each text its special strings, and places and frequencies of its pre-tokens; and the distinct pre-tokens by bucket.

    Places count through the buckets in order, so the answers of all buckets end to end are the table to look them up in.
    """
    places, special, kinds, counts = _Places(), [], [], []
    for text in texts:
        n, found = cutter.of(text)
        place, count = np.unique(np.fromiter(map(places.__getitem__, found), np.int64, len(found)), return_counts=True)
        special.append(n)
        kinds.append(place)
        counts.append(count.astype(np.int32))
    distinct = np.array(list(places), object)
    bucket = np.array([zlib.crc32(p.encode()) >> (32 - bits) for p in places], np.int64)
    order = np.argsort(bucket, kind="stable")
    moved = np.empty(len(order), np.int32)
    moved[order] = np.arange(len(order))
    asked = [(int(b), distinct[at].tolist()) for b, at in zip(*_runs(bucket[order], order))]
    return special, [moved[k] for k in kinds], counts, asked


def _runs(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Distinct sorted keys, and the values of each."""
    cuts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])[: len(keys)])
    return keys[cuts], np.split(values, cuts[1:]) if len(cuts) else []


def _pack(x: np.ndarray) -> bytes:
    """32-bit numbers with their first bytes first, then all second bytes, ..., compressed: the high ones are mostly 0."""
    return pa.Codec("zstd").compress(np.ascontiguousarray(x.view(np.uint8).reshape(-1, 4).T).tobytes(), asbytes=True)


def _unpack(blob: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.Codec("zstd").decompress(blob, 4 * n), np.uint8).reshape(4, n)
    return np.ascontiguousarray(planes.T).reshape(-1).view(np.int32)


def count_tokens(docs: DataFrame, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text", limit: int = 1024) -> DataFrame:
    """``id_col``, ``n_bytes``, ``n_tokens`` and ``over_limit`` (more than ``limit`` tokens) of every row.

    ``tokenizer`` is the path of a byte-level BPE file of the tokenizers library that every worker can open.
    """
    size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    bits = max(_LEAST_BITS, (int(size) >> _BUCKET_BYTES).bit_length())

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter = pre_tokens(tokenizer)
        for batch in batches:
            for a, b, _, _ in chunks(batch.column(1), _PART):
                special, kinds, counts, asked = frequencies(cutter, [t or "" for t in batch.column(1).slice(a, b - a).to_pylist()], bits)
                lists = lambda values, kind: pa.array([values], pa.list_(kind))
                keep = pa.ListArray.from_arrays(pa.array([0, b - a], pa.int32()), pa.concat_arrays([batch.column(0).slice(a, b - a)]))
                asks = pa.array([[{"bucket": k, "tokens": v} for k, v in asked]], pa.list_(pa.struct([("bucket", pa.int32()), ("tokens", pa.list_(pa.string()))])))
                none = np.zeros(0, np.int32)
                yield pa.RecordBatch.from_arrays(
                    [keep, lists(special, pa.int32()), lists([len(k) for k in kinds], pa.int32()), *[pa.array([_pack(np.concatenate([none, *x]))], pa.binary()) for x in (kinds, counts)], asks],
                    names=["keep", "special", "kinds", "places", "counts", "asks"],
                )

    def answer(asks: pa.Table) -> pa.Table:
        lists = asks["tokens"].combine_chunks()
        coded = lists.flatten().dictionary_encode()
        pieces = pre_tokens(tokenizer).pieces(coded.dictionary.to_pylist())[coded.indices.to_numpy()]
        offsets = np.append(0, np.cumsum(pc.list_value_length(lists).to_numpy()))
        return pa.table([asks["part"], asks["bucket"], pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(pieces, pa.int32()))], names=["part", "bucket", "pieces"])

    def total(part: pa.Table, answers: pa.Table) -> pa.Table:
        value = lambda c: part[c].combine_chunks().flatten()
        known = answers.sort_by("bucket")["pieces"].combine_chunks().flatten().to_numpy() if len(answers) else np.zeros(0, np.int32)
        kinds = value("kinds").to_numpy()
        places, counts = (_unpack(part[c][0].as_py(), int(kinds.sum())) for c in ("places", "counts"))
        own = known[places].astype(np.int64) * counts
        sums = np.bincount(np.repeat(np.arange(len(kinds)), kinds), own, minlength=len(kinds)).astype(np.int64)
        return pa.table([value("keep"), pa.array(sums + value("special").to_numpy())], names=["keep", "n_tokens"])

    rows = docs.select(F.struct(F.col(id_col).alias("id"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes")).alias("keep"), F.col(text_col).alias("text"))
    kind = rows.schema["keep"].dataType.simpleString()
    schema = f"keep array<{kind}>, special array<int>, kinds array<int>, places binary, counts binary, asks array<struct<bucket:int,tokens:array<string>>>"
    parts = save(rows.mapInArrow(cut, schema).select(F.monotonically_increasing_id().alias("part"), "*"), "token-parts", "zstd")
    asked = parts.select("part", F.explode("asks").alias("a")).select("part", "a.bucket", "a.tokens")
    answers = save(asked.groupBy("bucket").applyInArrow(answer, "part bigint, bucket int, pieces array<int>"), "token-answers")
    parts.agg(F.count("*")).first()  # once the listeners have let go of the plan above, its shuffle files can be deleted
    release(docs.sparkSession)
    counted = parts.drop("asks").groupBy("part").cogroup(answers.groupBy("part")).applyInArrow(total, f"keep {kind}, n_tokens bigint")
    return counted.select(F.col("keep.id").alias(id_col), F.col("keep.n_bytes").alias("n_bytes"), "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))

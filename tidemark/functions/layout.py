"""Addresses of bytes in chunks and blocks, as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CHUNK = 64 << 20
BLOCK = 4 << 20
CHUNKS_PER_INODE = 1_000_000_000


def div(a: Column, b: Column | int) -> Column:
    """Whole-number division."""
    return F.call_function("div", a, b if isinstance(b, Column) else F.lit(b).cast("bigint"))


def chunk_index(offset: Column, chunk: int = CHUNK) -> Column:
    return div(offset, chunk)


def within_chunk(offset: Column, chunk: int = CHUNK) -> Column:
    return offset % chunk


def block_index(offset: Column, block: int = BLOCK) -> Column:
    return div(offset, block)


def within_block(offset: Column, block: int = BLOCK) -> Column:
    return offset % block


def blocks_for(size: Column, block: int = BLOCK) -> Column:
    """Blocks that hold ``size`` bytes from block 0 on."""
    return div(size + (block - 1), block)


def chunk_id(inode: Column, index: Column) -> Column:
    """Id of an inode's chunk; null if it does not fit 64 bits."""
    return F.try_add(F.try_multiply(inode, F.lit(CHUNKS_PER_INODE).cast("bigint")), index)


def chunk_owner(id_: Column) -> Column:
    return div(id_, CHUNKS_PER_INODE)


def chunk_number(id_: Column) -> Column:
    return id_ % CHUNKS_PER_INODE


def split_blocks(ranges: DataFrame, offset: str, length: str, block: int = BLOCK) -> DataFrame:
    """One row for each block that a range touches: ``block``, ``block_off``, ``block_len``; empty ranges have none."""
    first, last = block_index(F.col(offset), block), block_index(F.col(offset) + F.col(length) - 1, block)
    rows = ranges.where(F.col(length) > 0).withColumn("block", F.explode(F.sequence(first, last)))
    lo = F.greatest(F.col(offset), F.col("block") * block)
    hi = F.least(F.col(offset) + F.col(length), (F.col("block") + 1) * block)
    return rows.withColumn("block_off", lo - F.col("block") * block).withColumn("block_len", hi - lo)


def chunk_range(index: Column, chunk: int = CHUNK) -> tuple[Column, Column]:
    """The bytes ``[lo, hi)`` of a chunk in its file."""
    return index * chunk, (index + 1) * chunk

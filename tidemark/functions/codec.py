"""Keys of stored objects and the packed record of a delayed slice, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: a packed record is id (8 bytes), offset (8) and size (4), each little-endian.
RECORD = 20


def slice_key(slice_id: Column) -> Column:
    return F.concat(F.lit("slices/"), slice_id.cast("string"))


def block_key(slice_id: Column, index: Column) -> Column:
    return F.concat_ws("/", slice_id.cast("string"), index.cast("string"))


def cache_name(key: Column) -> Column:
    """File name of a cached key."""
    return F.sha2(key, 256)


def _little(value: Column, size: int) -> Column:
    """Hexadecimal digits of a whole number, last byte first."""
    digits = F.lpad(F.hex(value), 2 * size, F.lit("0"))
    return F.concat(*[F.substring(digits, 2 * i + 1, 2) for i in reversed(range(size))])


def _number(data: Column, at: Column, size: int) -> Column:
    big = F.concat(*[F.hex(F.substring(data, at + (i + 1), F.lit(1))) for i in reversed(range(size))])
    return F.conv(big, 16, 10).cast("decimal(20,0)")


def pack(slice_id: Column, offset: Column, size: Column) -> Column:
    """One packed record; sizes beyond 32 bits are clamped."""
    return F.unhex(F.concat(_little(slice_id, 8), _little(offset, 8), _little(F.least(size, F.lit(2**32 - 1)), 4)))


def unpack(data: Column) -> Column:
    """Records of packed bytes as an array of ``slice_id``, ``off``, ``size`` (decimals, as they may exceed 63 bits); null if
    the length is no multiple of a record."""
    n = F.octet_length(data)
    starts = F.when(n > 0, F.sequence(F.lit(0), n - RECORD, F.lit(RECORD))).otherwise(F.array().cast("array<int>"))
    record = lambda at: F.struct(_number(data, at, 8).alias("slice_id"), _number(data, at + 8, 8).alias("off"), _number(data, at + 16, 4).alias("size"))
    return F.when(n % RECORD == 0, F.transform(starts, record))


def sealed_name(name: Column) -> Column:
    """The numbers in a sealed record's file name ``inode_chunk_seq_epoch_a_b.sealed``; null if the name is of another form."""
    parts = F.split(F.regexp_extract(name, r"^(.*)\.sealed$", 1), "_")
    fields = ["inode", "chunk_id", "local_seq", "epoch", "first", "second"]
    plain = lambda i: F.when(F.get(parts, F.lit(i)).rlike(r"^\+?[0-9]+$"), F.get(parts, F.lit(i)).try_cast("decimal(20,0)"))
    numbers = [F.when(plain(i).between(F.lit(0), F.lit(str(2**64 - 1)).cast("decimal(20,0)")), plain(i)).alias(f) for i, f in enumerate(fields)]
    good = F.size(parts) == len(fields)
    for n in numbers:
        good = good & n.isNotNull()
    return F.when(good, F.struct(*[n.alias(f) for n, f in zip(numbers, fields, strict=True)]))

"""Attributes of nodes from the rows and records that stores keep: size, 512-byte blocks and kind."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import blocks_512, file_type

#: Fixed value: the size that every directory reports.
DIR_SIZE = 4096
#: Kinds of entries by their stored number.
ENTRY_KINDS = ["file", "dir", "symlink", "fifo", "socket", "char", "block"]
#: Features that a store can claim, and those that the SQL store does not.
FEATURES = [
    "namespace", "file_data", "batch_stat", "hardlinks", "symlinks", "rename_exchange", "open_close_tracking", "stat_fs", "sessions",
    "global_locks", "plocks", "flocks", "xattr", "acl", "quota", "dump_load", "compaction", "watch_invalidation",
]
SQL_LACKS = ["flocks", "quota", "dump_load", "watch_invalidation"]


def of_files(rows: DataFrame) -> DataFrame:
    """``inode``, ``size``, ``blocks``, ``kind`` of file rows ``inode``, ``size``, ``mode``, ``target``: a symlink has the bytes of its target."""
    link = F.col("target").isNotNull()
    size = F.when(link, F.octet_length("target").cast("bigint")).otherwise(F.col("size"))
    return rows.select("inode", size.alias("size"), blocks_512(size).alias("blocks"), F.when(link, "symlink").otherwise(file_type(F.col("mode"))).alias("kind"))


def of_dirs(rows: DataFrame) -> DataFrame:
    """The same columns of directory rows ``inode``."""
    size = F.lit(DIR_SIZE).cast("bigint")
    return rows.select("inode", size.alias("size"), blocks_512(size).alias("blocks"), F.lit("dir").alias("kind"))


def kind_of(entry_kind: Column, is_file: Column, target: Column | None = None) -> Column:
    """Kind of a record: the stored one, else what older records say; a forward entry has no target to look at."""
    plain = F.lit("file") if target is None else F.when(target.isNotNull(), "symlink").otherwise("file")
    return F.coalesce(entry_kind, F.when(is_file, plain).otherwise("dir"))


def of_records(rows: DataFrame) -> DataFrame:
    """The same columns of key-value records ``inode``, ``entry_kind``, ``is_file``, ``size``, ``target``, with nulls in old ones."""
    kind = kind_of(F.col("entry_kind"), F.col("is_file"), F.col("target"))
    size = F.when(F.col("target").isNotNull(), F.octet_length("target")).when(kind == "dir", DIR_SIZE).otherwise(F.greatest(F.coalesce("size", F.lit(0)), F.lit(0))).cast("bigint")
    return rows.select("inode", size.alias("size"), blocks_512(size).alias("blocks"), kind.alias("kind"))


def features(backends: DataFrame) -> DataFrame:
    """``backend``, ``feature`` and ``claimed`` of backends ``backend``, ``lacks`` (an array of features)."""
    return backends.select("backend", "lacks", F.explode(F.lit(FEATURES)).alias("feature")).select("backend", "feature", (~F.array_contains("lacks", F.col("feature"))).alias("claimed"))

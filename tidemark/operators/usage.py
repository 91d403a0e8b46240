"""Space and inodes in use, and the capacity that is reported for them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Capacity and free inodes reported before they grow.
TOTAL_SPACE = 1 << 50
FREE_INODES = 10 << 20


def used_bytes(size: Column, blocks: Column | None = None) -> Column:
    """Bytes that a node occupies: its 512-byte blocks if it has any, else its size."""
    return size if blocks is None else F.when(blocks > 0, blocks * 512).otherwise(size)


def usage(files: DataFrame, dirs: DataFrame, *, variant: str = "sql") -> DataFrame:
    """One row ``used_space``, ``used_inodes``. Live files are not deleted and have links; all directories count.

    With ``variant='all_nodes'`` directories bring their bytes too, as some stores report.
    """
    live = files.where("not deleted and nlink > 0").select("size", F.lit(1).alias("n"))
    own = F.col("size") if variant == "all_nodes" else F.lit(0).cast("bigint")
    rows = live.unionByName(dirs.select(own.alias("size"), F.lit(1).alias("n")))
    return rows.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("used_space"), F.count("*").alias("used_inodes"))


def capacity(used: DataFrame) -> DataFrame:
    """``total_space`` (doubled until 8 tenths hold what is used), ``available_space`` and ``available_inodes`` (doubled until a
    quarter of the used ones).

    Spaces are unsigned 64-bit numbers, so they are decimals: doubling ends at the largest of those, and what is used may be more.
    """
    space, inodes = F.col("used_space").cast("decimal(38,0)"), F.col("used_inodes").cast("decimal(38,0)")

    def first(start: int, most: int, holds) -> Column:
        sizes = F.array(*[F.lit(str(start << k)).cast("decimal(38,0)") for k in range(64) if start << k <= most])
        return F.get(F.filter(sizes, lambda size: F.coalesce(holds(size), F.lit(True))), F.lit(0))

    largest = F.lit(str((1 << 64) - 1)).cast("decimal(38,0)")
    total = F.greatest(F.coalesce(first(TOTAL_SPACE, 1 << 63, lambda size: size * 8 >= space * 10), largest), space)
    free = first(FREE_INODES, 1 << 62, lambda size: inodes <= size * 4).cast("bigint")
    return used.withColumn("total_space", total).withColumn("available_space", F.col("total_space") - space).withColumn("available_inodes", free)


def size_after(writes: DataFrame, old: DataFrame) -> DataFrame:
    """File sizes after writes: the largest end of any, or the old size."""
    ends = writes.groupBy("inode").agg(F.max(F.col("off") + F.col("len")).alias("end"))
    return old.join(ends, "inode", "left").select("inode", F.greatest("size", F.coalesce("end", "size")).alias("size"))


def usage_of_nodes(nodes: DataFrame) -> DataFrame:
    """One row ``used_space``, ``used_inodes`` of stores that keep all nodes alike (``kind``, ``size``, ``blocks``, ``deleted``, ``nlink``).

    Nodes that are deleted or have no link do not count; directories count as inodes but not with their bytes.
    """
    live = nodes.where("not deleted and nlink > 0")
    own = F.when(F.col("kind") != "dir", used_bytes(F.col("size"), F.col("blocks")))
    return live.agg(F.coalesce(F.sum(own), F.lit(0)).alias("used_space"), F.count("*").alias("used_inodes"))


def next_ids(dirs: DataFrame, files: DataFrame, slices: DataFrame) -> DataFrame:
    """One row ``next_inode`` (at least 2, as the root is 1) and ``next_slice`` after the largest that are stored."""
    top = lambda rows, c, kind: rows.agg(F.max(c).alias("top")).select(F.lit(kind).alias("kind"), "top")
    tops = top(dirs, "inode", "inode").unionByName(top(files, "inode", "inode")).unionByName(top(slices, "slice_id", "slice"))
    most = lambda kind, least: F.greatest(F.coalesce(F.max(F.when(F.col("kind") == kind, F.col("top"))), F.lit(0)), F.lit(least)) + 1
    return tops.agg(most("inode", 1).alias("next_inode"), most("slice", 0).alias("next_slice"))

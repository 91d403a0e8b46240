"""What is due: delayed deletes, orphans, expired sessions and locks. Times are columns or given, never read from a clock."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.layout import blocks_for


def ready(delayed: DataFrame, cutoff: int, limit: int | None = None) -> DataFrame:
    """Delayed slices made at or before the cutoff that wait for deletion, and the state that they enter."""
    due = delayed.where((F.col("created_at") <= cutoff) & F.col("status").isin("pending", "meta_deleted"))
    due = due if limit is None else due.orderBy("id").limit(limit)
    return due.withColumn("next_status", F.lit("meta_deleted"))


def orphans(uncommitted: DataFrame, committed: DataFrame, cutoff: int) -> DataFrame:
    """Slices marked as orphans, and pending ones made before the cutoff that were never committed."""
    old = uncommitted.where((F.col("status") == "pending") & (F.col("created_at") < cutoff))
    return old.join(committed.select("slice_id").distinct(), "slice_id", "left_anti").select(uncommitted.columns).unionByName(uncommitted.where("status = 'orphan'"))


def leftovers(uncommitted: DataFrame, committed: DataFrame, cutoff: int) -> DataFrame:
    """Pending slices made before the cutoff that were committed after all, whose tracking can go."""
    return uncommitted.where((F.col("status") == "pending") & (F.col("created_at") < cutoff)).join(committed.select("slice_id").distinct(), "slice_id", "left_semi").select(uncommitted.columns)


def confirmed(delayed: DataFrame, ids: DataFrame) -> DataFrame:
    """What remains when the given ids are deleted."""
    return delayed.join(ids.select("id").distinct(), "id", "left_anti")


def gc_plan(delayed: DataFrame, uncommitted: DataFrame, committed: DataFrame, *, delay_cutoff: int, orphan_cutoff: int, block: int) -> DataFrame:
    """``slice_id``, ``cause`` and ``n_blocks`` (from block 0) of all that may be deleted now."""
    due = ready(delayed, delay_cutoff).select("slice_id", "size", F.lit("delayed").alias("cause"))
    lost = orphans(uncommitted, committed, orphan_cutoff).select("slice_id", "size", F.lit("orphan").alias("cause"))
    return due.unionByName(lost).select("slice_id", "cause", blocks_for(F.col("size"), block).alias("n_blocks"))


def expiry(beats: DataFrame, keep: int = 300_000) -> DataFrame:
    """``session`` and ``expire`` from heartbeats ``session``, ``at`` (ms)."""
    return beats.groupBy("session").agg((F.max("at") + keep).alias("expire"))


def expired(sessions: DataFrame, now: int) -> DataFrame:
    return sessions.where(F.col("expire") < now)


def surviving_locks(locks: DataFrame, sessions: DataFrame, now: int) -> DataFrame:
    """Locks of sessions that have not expired."""
    return locks.join(expired(sessions, now).select("session"), "session", "left_anti")


def held(named: DataFrame, now: int) -> DataFrame:
    """``held`` (expiry after now) of named locks; one that is not held can be taken."""
    return named.withColumn("held", F.col("expire") > now)


def lru_evictions(files: DataFrame, to_free: int, ranges: int = 4096) -> DataFrame:
    """The least recently used files (``path``, ``size``, ``atime``) whose removal frees enough, with bytes freed before each.

    Sizes are summed by ranges of access time before the running sum, which so sees ``ranges`` rows; files are ordered within
    their range alone, and only in those ranges that are reached.
    """
    lo, hi = files.agg(F.min("atime"), F.max("atime")).first()
    width = ((hi or 0) - (lo or 0)) // ranges + 1
    ranged = files.withColumn("range", F.call_function("div", F.col("atime") - F.lit(lo or 0), F.lit(width).cast("bigint")))
    sums = ranged.groupBy("range").agg(F.sum("size").alias("s"))
    before = sums.withColumn("prior", F.coalesce(F.sum("s").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).where(F.col("prior") < to_free)
    here = Window.partitionBy("range").orderBy("atime", "path").rowsBetween(Window.unboundedPreceding, -1)
    ranked = ranged.join(before.select("range", "prior"), "range").withColumn("freed_before", F.col("prior") + F.coalesce(F.sum("size").over(here), F.lit(0)))
    return ranked.where(F.col("freed_before") < to_free).select("path", "size", "atime", "freed_before")

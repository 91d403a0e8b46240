"""Access activity: window frequencies, adaptive promotion, hit rates, read-ahead sessions, memory pressure."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def window_counts(accesses: DataFrame, bucket: int, buckets: int, key: str = "key", ts: str = "ts") -> DataFrame:
    """``key``, ``bucket`` (with accesses) and ``n``, the accesses of the ``buckets`` buckets that end there; ``ts`` in seconds.

    Time decides which buckets are in the window, also after idle gaps.
    """
    counted = accesses.groupBy(key, F.call_function("div", F.col(ts), F.lit(bucket).cast("bigint")).alias("bucket")).agg(F.count("*").alias("c"))
    recent = Window.partitionBy(key).orderBy("bucket").rangeBetween(-(buckets - 1), 0)
    return counted.select(key, "bucket", F.sum("c").over(recent).alias("n"))


def frequencies(accesses: DataFrame, now: int, *, short: int = 60, medium: int = 360, short_weight: float = 0.7, medium_weight: float = 0.3, key: str = "key", ts: str = "ts") -> DataFrame:
    """``key``, ``short_freq``, ``medium_freq`` and ``weighted`` at time ``now``, in accesses per second.

    The short window has buckets of 1 s, the medium one of 5 s; the last bucket is the one that holds ``now``.
    """
    div = lambda c, n: F.call_function("div", c, F.lit(n).cast("bigint"))
    in_short = F.col(ts).between(now - short + 1, now)
    in_medium = div(F.col(ts), 5).between(now // 5 - medium // 5 + 1, now // 5) & (F.col(ts) <= now)
    freq = accesses.groupBy(key).agg((F.count_if(in_short) / F.lit(float(short))).alias("short_freq"), (F.count_if(in_medium) / F.lit(float(medium))).alias("medium_freq"))
    total = short_weight + medium_weight
    weighted = F.lit(0.0) if total == 0 else F.col("short_freq") * (short_weight / total) + F.col("medium_freq") * (medium_weight / total)
    return freq.withColumn("weighted", weighted)


def threshold(base: float, hit_rate: Column, utilization: Column, load: Column, *, load_limit: float = 0.8, hit_limit: float = 0.6) -> Column:
    """The promotion threshold for a state of the cache, within 2..50."""
    by_hits = F.when(hit_rate < 0.3, 0.5).when(hit_rate < hit_limit, 0.75).when(hit_rate > 0.8, 0.9).otherwise(1.0)
    by_space = F.when(utilization > 0.95, 1.6).when(utilization > 0.85, 1.3).otherwise(1.0)
    by_load = F.when(load > load_limit, 1.2).otherwise(1.0)
    return F.least(F.greatest(F.lit(base) * by_hits * by_space * by_load, F.lit(2.0)), F.lit(50.0))


def load(utilization: Column, request_rate: Column) -> Column:
    """System load from cache use and requests per second."""
    return utilization * 0.7 + F.least(request_rate / 100.0, F.lit(1.0)) * 0.3


def hit_rate(hits: Column, total: Column) -> Column:
    """Share of hits in whole ten-thousandths; 0 without requests."""
    return F.coalesce(F.expr("0.0") + F.call_function("div", hits * 10000, F.nullif(total, F.lit(0))) / 10000.0, F.lit(0.0))


def running_hit_rate(requests: DataFrame, at: str = "ts", hit: str = "hit", by: str = "key") -> DataFrame:
    """The hit rate after each request of a key."""
    w = Window.partitionBy(by).orderBy(at)
    hits, total = F.sum(F.col(hit).cast("bigint")).over(w), F.count("*").over(w)
    return requests.withColumn("hit_rate", F.call_function("div", hits * 10000, total) / 10000.0)


def idle_keys(accesses: DataFrame, now: int, limit: int, key: str = "key", ts: str = "ts") -> DataFrame:
    """Keys whose last access is at least ``limit`` ago, which are forgotten."""
    return accesses.groupBy(key).agg(F.max(ts).alias("last")).where(F.greatest(F.lit(now) - F.col("last"), F.lit(0)) >= limit)


def pressure(used_share: Column) -> Column:
    """Steps of memory pressure by the share in use."""
    return F.when(used_share >= 0.95, "critical").when(used_share >= 0.80, "high").when(used_share >= 0.60, "elevated").otherwise("normal")


class _Session:
    """The read-ahead state of one file: two slots, each following one sequential stream."""

    def __init__(self, block: int, most: int, budget: int, as_observed: bool) -> None:
        self.block, self.most, self.budget, self.as_observed = block, most, budget, as_observed
        self.slots = [{"ahead": 0, "end": 0, "total": 0, "at": 0}, {"ahead": 0, "end": 0, "total": 0, "at": 0}]
        self.turn = 0

    def read(self, off: int, length: int) -> int:
        """The window after the next read."""
        self.turn += 1
        slots, block, most, turn = self.slots, self.block, self.most, self.turn
        ahead_of = lambda s: s["total"] > 0 and s["end"] <= off <= s["end"] + s["ahead"] + block
        behind = lambda s: s["total"] > 0 and max(s["end"] - max(s["ahead"] // 8, block), 0) <= off < s["end"]
        far = 0 if slots[0]["end"] > slots[1]["end"] else 1
        near = 0 if slots[0]["end"] < slots[1]["end"] else 1
        order = [(ahead_of, far), (ahead_of, 1 - far), (behind, near), (behind, 1 - near)]
        match = next((i for fits, i in order if fits(slots[i])), None)
        if match is None or self.as_observed:  # observed behaviour: the slot to fall back on is reset even when another matches
            spare = next((i for i in (0, 1) if slots[i]["total"] == 0), 0 if slots[0]["at"] < slots[1]["at"] else 1)
            slots[spare] = {"ahead": 0, "end": off, "total": 0, "at": turn}
            match = spare if match is None else match
        s = slots[match]
        if off + length > s["end"]:
            s["total"] += off + length - s["end"]
            s["end"] = off + length
        s["at"] = turn
        if s["ahead"] == 0 and block <= most and (off == 0 or (s["total"] > length and s["total"] >= block)):
            s["ahead"] = min(block, most)
        elif s["ahead"] < most and s["total"] >= s["ahead"] and self.budget > 4 * s["ahead"]:
            s["ahead"] = min(2 * s["ahead"], most)
        elif s["ahead"] >= block and (self.budget < s["ahead"] // 2 or s["total"] < s["ahead"] // 4):
            s["ahead"] //= 2
        return s["ahead"]


def read_ahead(reads: DataFrame, *, block: int = 4 << 20, most: int = 32 << 20, budget: int = 256 << 20, as_observed: bool = True) -> DataFrame:
    """``inode``, ``seq``, ``ahead``: the read-ahead window after each read; reads of a file in order of ``seq``.

    The state of a file depends on the order of its reads, so a file's reads are sorted in one task; only its state is held.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, session = None, None
        for batch in batches:
            ahead = []
            for inode, off, length in zip(*(batch.column(c).to_pylist() for c in ("inode", "off", "len")), strict=True):
                if session is None or inode != file:
                    file, session = inode, _Session(block, most, budget, as_observed)
                ahead.append(session.read(off, length))
            yield pa.RecordBatch.from_arrays([batch.column("inode"), batch.column("seq"), pa.array(ahead, pa.int64())], names=["inode", "seq", "ahead"])

    ordered = reads.select(F.col("inode").cast("bigint"), F.col("seq").cast("bigint"), "off", "len").repartition("inode").sortWithinPartitions("inode", F.asc_nulls_last("seq"))
    return ordered.mapInArrow(run, "inode bigint, seq bigint, ahead bigint")


def prefetch(state: DataFrame, block: int = 4 << 20) -> DataFrame:
    """The range to fetch after a read, from ``off``, ``len``, ``file_size`` and ``ahead`` of a session that ends with the read."""
    up = lambda c: F.call_function("div", c + (block - 1), F.lit(block).cast("bigint")) * block
    end = F.col("off") + F.col("len")
    rows = state.where((F.col("len") > 0) & (end < F.col("file_size")) & (F.col("ahead") >= block)).withColumn("start", up(end)).where("start < file_size")
    asked = F.least(F.greatest("len", F.lit(block)), F.col("ahead"))
    stop = F.least(up(F.col("start") + F.least(asked, F.col("file_size") - F.col("start"))), F.col("file_size"))
    return rows.withColumn("n", stop - F.col("start")).where("n > 0")

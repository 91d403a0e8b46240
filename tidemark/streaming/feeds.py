"""Continuous forms: change feeds, window counts, late-write suppression and read-ahead on streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def parse_changes(changes: DataFrame) -> DataFrame:
    """Cache events of store changes ``op`` (PUT or DELETE), ``key`` and ``value``; the same on a stream and on a table.

    Keys ``f:{parent}:{name}`` add or remove a child, ``r:{inode}`` updates an inode; what cannot be parsed falls back to
    invalidating the directory or inode, and unknown keys are left out. Names may hold colons.
    """
    parts = F.split("key", ":", 3)
    kind, number = F.get(parts, F.lit(0)), F.get(parts, F.lit(1)).try_cast("bigint")
    inode_key = F.get(F.split("key", ":"), F.lit(1)).try_cast("bigint")
    inode = F.get_json_object("value", "$.inode").try_cast("bigint")
    size = F.get_json_object("value", "$.size").try_cast("bigint")
    forward, reverse, put = (kind == "f") & (F.size(parts) == 3) & number.isNotNull(), (kind == "r") & inode_key.isNotNull(), F.col("op") == "PUT"
    event = (
        F.when(forward & put & inode.isNotNull(), "add_child").when(forward & put, "invalidate_children").when(forward, "remove_child")
        .when(reverse & put & size.isNotNull(), "update_inode").when(reverse, "invalidate_inode")
    )
    named = event.isin("add_child", "remove_child")
    out = changes.withColumn("event", event).withColumn("subject", F.when(forward, number).when(reverse, inode_key))
    out = out.withColumn("name", F.when(named, F.get(parts, F.lit(2)))).withColumn("child", F.when(event == "add_child", inode)).withColumn("size", F.when(event == "update_inode", size))
    return out.where("event is not null").select(*[c for c in changes.columns if c not in ("op", "key", "value", "event", "subject", "name", "child", "size")], "event", "subject", "name", "child", "size")


def latest_children(events: DataFrame, order: str = "seq") -> DataFrame:
    """Children that remain after all add and remove events, by the last event of each name."""
    last = events.where("event in ('add_child', 'remove_child')").groupBy("subject", "name").agg(F.max_by(F.struct("event", "child"), order).alias("e"))
    return last.where("e.event = 'add_child'").select(F.col("subject").alias("parent"), "name", F.col("e.child").alias("inode"))


def windowed_counts(stream: DataFrame, ts: str, keys: list[str], window: str = "60 seconds", slide: str = "1 second", late: str = "10 seconds") -> DataFrame:
    """Accesses by key in sliding event-time windows, with a watermark."""
    timed = stream.withColumn("__ts", F.col(ts).cast("timestamp")).withWatermark("__ts", late)
    return timed.groupBy(F.window("__ts", window, slide), *keys).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *keys, "n")


def session_windows(stream: DataFrame, ts: str, key: str, gap: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Sessions that end when no heartbeat comes for ``gap``."""
    timed = stream.withColumn("__ts", F.col(ts).cast("timestamp")).withWatermark("__ts", late)
    return timed.groupBy(F.session_window("__ts", gap).alias("w"), key).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def first_requests(stream: DataFrame, ts: str, keys: list[str], within: str = "1 minute") -> DataFrame:
    """Prefetch requests without repeats of one that is still under way."""
    return stream.withColumn("__ts", F.col(ts).cast("timestamp")).withWatermark("__ts", within).dropDuplicatesWithinWatermark(keys).drop("__ts")


def pieces_allowed(ranges: list[tuple[int, int, int]], lo: int, hi: int, unique: int) -> tuple[list[tuple[int, int]], list[tuple[int, int, int]]]:
    """The parts of ``[lo, hi)`` that no range with a larger request number covers, and the ranges after the write."""
    cuts = sorted({lo, hi, *(x for a, b, _ in ranges for x in (a, b) if lo < x < hi)})
    free, after = [], [(a, min(b, lo), u) for a, b, u in ranges if a < lo] + [(max(a, hi), b, u) for a, b, u in ranges if b > hi]
    for a, b in zip(cuts, cuts[1:]):
        past = max((u for x, y, u in ranges if x < b and a < y), default=0)
        if past <= unique:
            free.append((a, b))
        after.append((a, b, max(past, unique)))
    join = lambda rows: _merge(sorted(rows))
    return [(a, b) for a, b, *_ in join([(*r, 0) for r in free])], join(after)


def _merge(rows: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    out: list[tuple[int, int, int]] = []
    for a, b, u in rows:
        if out and out[-1][1] == a and out[-1][2] == u:
            out[-1] = (out[-1][0], b, u)
        elif a < b:
            out.append((a, b, u))
    return out


def late_writes(stream: DataFrame) -> DataFrame:
    """On a stream of writes ``chunk_id``, ``seq``, ``unique``, ``off``, ``len``: the parts ``lo``, ``hi`` of each that may pass."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        ranges = [tuple(r) for r in zip(*state.get)] if state.exists else []
        rows = pd.concat(list(batches)).sort_values("seq")
        out = []
        for seq, unique, off, length in rows[["seq", "unique", "off", "len"]].itertuples(index=False):
            if length <= 0:
                continue
            free = [(off, off + length)]
            if unique:
                free, ranges = pieces_allowed(ranges, off, off + length, unique)
            out += [(key[0], seq, a, b) for a, b in free]
        state.update(tuple([int(x) for x in c] for c in zip(*ranges)) if ranges else ([], [], []))
        yield pd.DataFrame(out, columns=["chunk_id", "seq", "lo", "hi"])

    return stream.groupBy("chunk_id").applyInPandasWithState(run, "chunk_id bigint, seq bigint, lo bigint, hi bigint", "a array<bigint>, b array<bigint>, u array<bigint>", "append", GroupStateTimeout.NoTimeout)


def pressure_events(stream: DataFrame, used: Column, total: Column) -> DataFrame:
    """Rows with the step of memory pressure that their share in use stands for."""
    from tidemark.operators.activity import pressure

    return stream.withColumn("pressure", pressure(used / total))

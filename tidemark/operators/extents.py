"""Byte extents: overlays in which the newest write wins, coverage, fragmentation and compaction.

Slices have ``slice_id``, ``chunk_id``, ``off`` and ``len`` and cover ``[off, off + len)``. Which of two slices is newer is a
column of the caller's choice, as reads go by append order and compaction by slice id.

Joins by overlap are cut into blocks of the address range: a slice meets only those that touch its blocks, so the work in a
chunk grows with its overlaps and not with the square of its slices, and one large chunk spreads over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.layout import div, split_blocks

SPAN = 16 << 10
#: Slices of which one task finds what is visible.
TASK_ROWS = 1 << 16


def fragmentation(slices: DataFrame) -> DataFrame:
    """``chunk_id``, ``n_slices``, ``total``, ``covered`` and ``fragmentation``: the share of bytes that others cover too.

    Covered bytes come from a sweep: a slice adds what lies beyond the largest end of those that start before it.
    """
    before = Window.partitionBy("chunk_id").orderBy("off", "end").rowsBetween(Window.unboundedPreceding, -1)
    reach = slices.withColumn("end", F.col("off") + F.col("len")).withColumn("reach", F.max("end").over(before))
    added = F.greatest(F.col("end") - F.greatest("off", F.coalesce("reach", "off")), F.lit(0))
    sums = reach.groupBy("chunk_id").agg(F.count("*").alias("n_slices"), F.sum("len").alias("total"), F.sum(added).alias("covered"))
    return sums.withColumn("fragmentation", F.round(F.coalesce(F.try_divide(F.col("total") - F.col("covered"), F.col("total")), F.lit(0.0)), 9))


def decide(analysis: DataFrame, *, min_count: int = 3, min_share: float = 0.1, sync_count: int = 200) -> DataFrame:
    """``should_compact`` and ``sync`` for each analysed chunk."""
    should = (F.col("n_slices") >= min_count) & (F.col("fragmentation") >= min_share)
    return analysis.withColumn("should_compact", should).withColumn("sync", should & (F.col("n_slices") >= sync_count))


def _in_spans(slices: DataFrame, span: int) -> DataFrame:
    """Pieces of slices by span of the address range."""
    cut = split_blocks(slices, "off", "len", span)
    return cut.withColumn("lo", F.col("block") * span + F.col("block_off")).withColumn("hi", F.col("lo") + F.col("block_len")).drop("block_off", "block_len")


def visible(slices: DataFrame, newest: str = "slice_id", keys: tuple[str, ...] = ("chunk_id",), value: str = "slice_id", span: int = SPAN) -> DataFrame:
    """``keys``, ``lo``, ``hi`` and ``value``: which slice serves each byte; neighbours with one value are one row.

    Ranges meet what lies over them, so rows are dealt to tasks by their number before they multiply.
    """
    place = [*keys, "block"]
    rows = slices.where("len > 0")
    tasks = rows.count() // TASK_ROWS + 1
    pieces = _in_spans(rows, span).select(*place, "lo", "hi", newest, F.col(value).alias("__v")).repartition(tasks, *place)
    edges = pieces.select(*place, F.explode(F.array("lo", "hi")).alias("lo")).distinct()
    steps = edges.withColumn("to", F.lead("lo").over(Window.partitionBy(*place).orderBy("lo"))).where("to is not null")
    spans = pieces.select(*place, F.col("lo").alias("a"), F.col("hi").alias("b"), newest, "__v")
    won = steps.join(spans, place).where("a <= lo and b >= to").groupBy(*place, "lo", "to").agg(F.max_by("__v", newest).alias(value))
    return merge_runs(won.drop("block"), list(keys), "lo", "to", [value])


def merge_runs(ranges: DataFrame, keys: list[str], lo: str, hi: str, same: list[str]) -> DataFrame:
    """Adjacent disjoint ranges with equal ``same`` columns as one; columns ``keys``, ``lo``, ``hi``, ``same``."""
    order = Window.partitionBy(*keys).orderBy(lo)
    joined = F.lag(hi).over(order) == F.col(lo)
    for c in same:
        joined = joined & F.lag(c).over(order).eqNullSafe(F.col(c))
    runs = ranges.withColumn("__new", F.when(F.coalesce(joined, F.lit(False)), 0).otherwise(1)).withColumn("__run", F.sum("__new").over(order))
    return runs.groupBy(*keys, "__run", *same).agg(F.min(lo).alias("lo"), F.max(hi).alias("hi")).select(*keys, "lo", "hi", *same)


def not_covered(slices: DataFrame, newest: str = "slice_id", span: int = SPAN) -> DataFrame:
    """The slices that no single newer slice of their chunk contains."""
    at = slices.withColumn("block", div(F.col("off"), span)).withColumn("end", F.col("off") + F.col("len"))
    over = split_blocks(slices, "off", "len", span).select(F.col("chunk_id").alias("c"), F.col("block").alias("k"), F.col("off").alias("o"), (F.col("off") + F.col("len")).alias("e"), F.col(newest).alias("n"))
    inside = (F.col("chunk_id") == F.col("c")) & (F.col("block") == F.col("k")) & (F.col("n") > F.col(newest)) & (F.col("o") <= F.col("off")) & (F.col("e") >= F.col("end"))
    return at.join(over, inside, "left_anti").select(slices.columns)


def replaced(original: DataFrame, merged: DataFrame, key: str = "slice_id") -> DataFrame:
    """Keys of ``original`` that ``merged`` lacks, as often as they occur."""
    return original.select(key).join(merged.select(key).distinct(), key, "left_anti")


def light_plan(slices: DataFrame) -> DataFrame:
    """``chunk_id``, ``n_before``, ``n_after``, ``n_removed`` if covered slices are dropped."""
    left = not_covered(slices).groupBy("chunk_id").agg(F.count("*").alias("n_after"))
    return slices.groupBy("chunk_id").agg(F.count("*").alias("n_before")).join(left, "chunk_id", "left").select("chunk_id", "n_before", "n_after", (F.col("n_before") - F.col("n_after")).alias("n_removed"))


def compaction_plan(slices: DataFrame, *, light_count: int = 2, heavy_share: float = 0.3, heavy_count: int = 30, force_share: float = 0.5) -> DataFrame:
    """``chunk_id``, ``action`` (skip, light or heavy) and ``removed`` of a light pass and, if still needed, a heavy one."""
    first = fragmentation(slices).select("chunk_id", F.col("n_slices").alias("n1"), F.col("fragmentation").alias("f1"))
    after = fragmentation(not_covered(slices)).select("chunk_id", F.col("n_slices").alias("n2"), F.col("fragmentation").alias("f2"))
    both = first.join(after, "chunk_id")
    removed = F.when(F.col("n1") >= light_count, F.col("n1") - F.col("n2")).otherwise(0)
    heavy_first = (F.col("f1") >= heavy_share) | (F.col("n1") >= heavy_count)
    heavy_after = ((F.col("f2") >= heavy_share) | (F.col("n2") >= heavy_count) | (F.col("f2") >= force_share)) & (F.col("n2") > 1)
    heavy = F.when(removed > 0, heavy_after).otherwise(heavy_first)
    action = F.when(F.col("n1") <= 1, "skip").when(heavy, "heavy").when(removed > 0, "light").otherwise("skip")
    return both.select("chunk_id", action.alias("action"), F.when(F.col("n1") > 1, removed).otherwise(0).cast("bigint").alias("removed"))


def fetch_plan(slices: DataFrame, block: int, newest: str = "slice_id") -> DataFrame:
    """Blocks to read for every visible range: ``chunk_id``, ``lo``, ``slice_id``, ``block``, ``block_off``, ``block_len``."""
    start = slices.select("chunk_id", "slice_id", F.col("off").alias("base"))
    seen = visible(slices, newest).join(start, ["chunk_id", "slice_id"]).select("chunk_id", "lo", "slice_id", (F.col("lo") - F.col("base")).alias("rel"), (F.col("hi") - F.col("lo")).alias("n"))
    return split_blocks(seen, "rel", "n", block).drop("rel", "n")


def truncate(slices: DataFrame, cutoff: Column) -> DataFrame:
    """Slices of a chunk cut at an offset: ``action`` (keep, drop or shorten) and ``new_len``."""
    end = F.col("off") + F.col("len")
    action = F.when(F.col("off") >= cutoff, "drop").when(end > cutoff, "shorten").otherwise("keep")
    return slices.withColumn("action", action).withColumn("new_len", F.when(F.col("off") >= cutoff, 0).otherwise(F.least(end, cutoff) - F.col("off")))


def truncate_chunks(sizes: DataFrame, chunk: int) -> DataFrame:
    """From ``old_size`` and ``new_size``: the chunk that is cut, the cut, and the chunks ``[drop_start, drop_end)`` to drop."""
    cut, at = div(F.col("new_size"), chunk), F.col("new_size") % chunk
    return (
        sizes.where("new_size < old_size").withColumn("cut_chunk", cut).withColumn("cut_off", at)
        .withColumn("drop_start", F.when(at == 0, cut).otherwise(cut + 1)).withColumn("drop_end", div(F.col("old_size") + (chunk - 1), chunk))
    )


def coalesce_runs(slices: DataFrame, *, allow_overlap: bool = False) -> DataFrame:
    """Runs of two or more adjacent slices of a chunk: ``chunk_id``, ``lo``, ``hi``, ``n``, the first of each chunk that no
    other slice overlaps. With ``allow_overlap`` a slice also extends a run that reaches beyond its start."""
    order = Window.partitionBy("chunk_id").orderBy("off", "end", "slice_id")
    rows = slices.where("len > 0").withColumn("end", F.col("off") + F.col("len"))
    if allow_overlap:
        reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
        extends = F.col("off") <= reach
    else:
        extends = F.col("off") == F.lag("end").over(order)
    runs = rows.withColumn("run", F.sum(F.when(F.coalesce(extends, F.lit(False)), 0).otherwise(1)).over(order))
    made = runs.groupBy("chunk_id", "run").agg(F.min("off").alias("lo"), F.max("end").alias("hi"), F.count("*").alias("n")).where("n >= 2")
    other = runs.select(F.col("chunk_id").alias("c"), F.col("run").alias("r"), "off", "end")
    clash = (F.col("chunk_id") == F.col("c")) & (F.col("run") != F.col("r")) & (F.col("off") < F.col("hi")) & (F.col("lo") < F.col("end"))
    free = made.join(other, clash, "left_anti")
    return free.withColumn("k", F.row_number().over(Window.partitionBy("chunk_id").orderBy("lo", "hi", "run"))).where("k = 1").select("chunk_id", "lo", "hi", "n")


def append_order(slices: DataFrame, order: str = "slice_id") -> DataFrame:
    """The slices of each chunk with their ``place`` in the order in which they were appended."""
    return slices.withColumn("place", F.row_number().over(Window.partitionBy("chunk_id").orderBy(order)).cast("bigint"))


def chunk_ids(slices: DataFrame, after: int | None = None, limit: int | None = None) -> DataFrame:
    """Distinct ``chunk_id`` in order, the first ``limit`` above the cursor ``after``; the last one is the next cursor."""
    rows = slices.select("chunk_id").distinct()
    rows = rows if after is None else rows.where(F.col("chunk_id") > after)
    return rows if limit is None else rows.orderBy("chunk_id").limit(limit)


def unchanged(expected: DataFrame, current: DataFrame) -> DataFrame:
    """``chunk_id`` and ``unchanged`` of every expected chunk: whether it still has just the slices that a plan was made from."""
    key = ["chunk_id", "slice_id"]
    left, right = (df.select(*key, F.struct("off", "len").alias(c)) for df, c in ((expected, "was"), (current, "is")))
    both = left.join(right, key, "full_outer").groupBy("chunk_id").agg(F.count("was").alias("asked"), F.bool_and(F.coalesce(F.col("was") == F.col("is"), F.lit(False))).alias("unchanged"))
    return both.where("asked > 0").select("chunk_id", "unchanged")


def heavy_plan(slices: DataFrame, chosen: DataFrame, next_slice: int, chunk: int) -> DataFrame:
    """Of every chosen chunk ``new_slice`` (numbers from ``next_slice`` on in order of chunks), ``off``, ``len`` and ``delayed``, the ids it replaces.

    New numbers are given out by ranges of chunks, a count of each before those within it, so no task orders all of them.
    """
    ids = slices.join(chosen.select("chunk_id").distinct(), "chunk_id", "left_semi").groupBy("chunk_id").agg(F.sort_array(F.collect_list("slice_id")).alias("delayed"))
    return numbered(ids, "chunk_id").select("chunk_id", (F.col("number") + next_slice).alias("new_slice"), F.lit(0).cast("bigint").alias("off"), F.lit(chunk).cast("bigint").alias("len"), "delayed")


def numbered(rows: DataFrame, order: str, span: int = 1 << 12) -> DataFrame:
    """``rows`` with ``number``, their place from 0 in the order of a whole-number column without repeats."""
    ranged = rows.withColumn("__range", div(F.col(order), span))
    counts = ranged.groupBy("__range").agg(F.count("*").alias("n"))
    before = counts.withColumn("__before", F.coalesce(F.sum("n").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    here = F.row_number().over(Window.partitionBy("__range").orderBy(order)) - 1
    return ranged.withColumn("__here", here).join(before, "__range").withColumn("number", F.col("__before") + F.col("__here")).drop("__range", "__before", "__here")


def overlay_dirty(committed: DataFrame, dirty: DataFrame) -> DataFrame:
    """``chunk_id``, ``lo``, ``hi``, ``source`` and ``slice_id``: which slice serves each byte when unsaved writes lie over saved ones.

    Saved slices go by ``slice_id``; unsaved ones by ``write_order``, those without one (0) first, and by ``position`` among equals.
    """
    saved = committed.select("chunk_id", "off", "len", F.struct(F.lit(0).alias("over"), F.lit(0).alias("ordered"), F.lit(0).cast("bigint").alias("o"), F.col("slice_id").cast("bigint").alias("p")).alias("age"), F.struct(F.lit("saved").alias("source"), "slice_id").alias("v"))
    order = F.col("write_order").cast("bigint")
    fresh = dirty.select("chunk_id", "off", "len", F.struct(F.lit(1).alias("over"), (order != 0).cast("int").alias("ordered"), order.alias("o"), F.col("position").cast("bigint").alias("p")).alias("age"), F.struct(F.lit("dirty").alias("source"), "slice_id").alias("v"))
    return visible(saved.unionByName(fresh), "age", value="v").select("chunk_id", "lo", "hi", "v.*")


def assembled(pages: DataFrame, page: int, block: int) -> DataFrame:
    """``file``, ``block`` and ``pages`` (write numbers in order) of the blocks that have all their pages.

    ``pages`` has ``file``, ``off``, ``unique`` and ``seq`` (arrival): an older write than the page's is refused, an equal one
    replaces it, so the largest number stays, and of equals the last to arrive.
    """
    last = pages.groupBy("file", "off").agg(F.max(F.struct("unique", "seq")).alias("w"))
    made = last.groupBy("file", div(F.col("off"), block).alias("block")).agg(F.count("*").alias("n"), F.sort_array(F.collect_list(F.struct("off", F.col("w.seq").alias("seq")))).alias("p"))
    return made.where(F.col("n") == block // page).select("file", "block", F.col("p.seq").alias("pages"))


def subtract(ranges: DataFrame, cuts: DataFrame, key: str = "chunk_id", span: int = SPAN) -> DataFrame:
    """``key``, ``lo``, ``hi``: the bytes of ``ranges`` (``off``, ``len``) that no range of ``cuts`` has, adjacent ones merged."""
    rows = ranges.select(key, "off", "len", F.lit(0).alias("cut")).unionByName(cuts.select(key, "off", "len", F.lit(1).alias("cut")))
    return visible(rows, "cut", (key,), "cut", span).where("cut = 0").select(key, "lo", "hi")

"""Reports on benchmark runs and counters: totals, ratios, comparison, stability, hot spots, rates.

Metrics are rows ``kind``, ``item``, ``metric`` with a number ``num`` or a text ``txt`` and a ``unit``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.text import delta_percent, readable_latency

MIB, GIB = float(1 << 20), float(1 << 30)
#: Ratio, the counters over and under the line (names as in counter files, after their prefix), what the lower
#: one is divided by, and the unit.
RATIOS = [
    ("upload_byte_amp", "s3_put_bytes_total", "fuse_write_bytes_total", 1.0, "ratio"),
    ("writeback_upload_byte_amp", "writeback_recent_uploaded_bytes", "fuse_write_bytes_total", 1.0, "ratio"),
    ("s3_put_avg_object_mib", "s3_put_bytes_total", "s3_put_ops_total", 1 / MIB, "MiB/op"),
    ("s3_get_avg_object_mib", "s3_get_bytes_total", "s3_get_ops_total", 1 / MIB, "MiB/op"),
    ("put_ops_per_gib_written", "s3_put_ops_total", "fuse_write_bytes_total", GIB, "ops/GiB"),
    ("get_ops_per_gib_read", "s3_get_ops_total", "fuse_read_bytes_total", GIB, "ops/GiB"),
    ("writeback_avg_live_slice_mib", "writeback_live_dirty_bytes", "writeback_live_slices", 1 / MIB, "MiB/slice"),
    ("writeback_avg_recent_pending_slice_mib", "writeback_recent_pending_upload_bytes", "writeback_recent_pending_upload_slices", 1 / MIB, "MiB/slice"),
    ("writeback_avg_upload_batch_mib", "writeback_upload_batch_bytes_total", "writeback_upload_batch_ops_total", 1 / MIB, "MiB/op"),
    ("writeback_avg_upload_batch_blocks", "writeback_upload_batch_blocks_total", "writeback_upload_batch_ops_total", 1.0, "blocks/op"),
    ("writeback_single_block_batch_ratio", "writeback_upload_batch_single_block_ops_total", "writeback_upload_batch_ops_total", 1.0, "ratio"),
    ("writeback_partial_tail_ratio", "writeback_upload_partial_tail_ops_total", "writeback_upload_batch_ops_total", 1.0, "ratio"),
    ("s3_puts_per_upload_batch", "s3_put_ops_total", "writeback_upload_batch_ops_total", 1.0, "ops/batch"),
]
#: The place of each kind of metric in reports; others come after them.
KIND_ORDER = {"summary": 0, "fio": 1, "runtime": 2, "drain": 3, "stats": 4, "amplification": 5}
#: Percentiles of a latency table, as job results name them.
PERCENTILES = {"p1": "1.000000", "p5": "5.000000", "p25": "25.000000", "p50": "50.000000", "p75": "75.000000", "p90": "90.000000", "p95": "95.000000", "p99": "99.000000", "p99.9": "99.900000"}


def op_totals(jobs: DataFrame) -> DataFrame:
    """Totals by ``item`` and ``op`` of job rows: sums, mean latency weighted by samples, largest percentiles and runtime."""
    n = F.when(F.col("n") > 0, F.col("n"))
    mean = F.coalesce(F.try_divide(F.sum(F.col("mean") * n), F.sum(n)), F.lit(0.0))
    return jobs.groupBy("item", "op").agg(
        F.sum("io_bytes").alias("io_bytes"), F.sum("total_ios").alias("total_ios"), F.sum("bw_bytes").alias("bw_bytes"), F.sum("iops").alias("iops"), mean.alias("mean_ns"),
        *[F.coalesce(F.max(p), F.lit(0.0)).alias(f"{p}_ns") for p in ("p95", "p99", "p999")], F.coalesce(F.max(F.when(F.col("runtime") > 0, F.col("runtime"))), F.lit(0)).alias("runtime_ms"),
    )


def weighted_mean(rows: DataFrame, by: list[str], value: str, weight: str) -> DataFrame:
    """Mean of ``value`` weighted by ``weight``; 0 without weight."""
    mean = F.coalesce(F.try_divide(F.sum(F.col(value) * F.col(weight)), F.sum(weight)), F.lit(0.0))
    return rows.groupBy(*by).agg(F.count("*").alias("n"), mean.alias("mean"))


def ratios(counters: DataFrame, table: list[tuple[str, str, str, float]]) -> DataFrame:
    """``item``, ``metric``, ``num`` from counters ``item``, ``name``, ``value``; a ratio needs both and a positive denominator."""
    wanted = sorted({c for _, a, b, _ in table for c in (a, b)})
    wide = counters.groupBy("item").pivot("name", wanted).agg(F.max("value"))
    each = [F.struct(F.lit(name).alias("metric"), F.when(F.col(b) > 0, F.col(a) / (F.col(b) / F.lit(scale))).alias("num")) for name, a, b, scale in table]
    return wide.select("item", F.explode(F.array(*each)).alias("r")).select("item", "r.*").where("num is not null")


def missing(counters: DataFrame, critical: list[str]) -> DataFrame:
    """``item`` and ``missing``: critical counters that an item lacks, comma-separated in the given order, or ``none``."""
    lacks = F.array_except(F.lit(critical), F.collect_set("name"))
    rows = counters.groupBy("item").agg(lacks.alias("m"))
    return rows.select("item", F.when(F.size("m") == 0, "none").otherwise(F.array_join("m", ",")).alias("missing"))


def compare(base: DataFrame, new: DataFrame) -> DataFrame:
    """Metrics of two runs side by side: common keys, and gaps of either; gaps that are ``none`` in both are left out."""
    keys = ["kind", "item", "metric"]
    b, c = (df.select(*keys, F.col("num").alias(f"{x}_num"), F.col("txt").alias(f"{x}_txt"), F.col("unit").alias(f"{x}_unit"), F.lit(True).alias(f"in_{x}")) for df, x in ((base, "b"), (new, "c")))
    both = b.join(c, keys, "full_outer").where("(in_b and in_c) or kind = 'gap'")
    said = lambda x: F.when(F.col(f"in_{x}").isNull(), "not_reported").otherwise(F.col(f"{x}_txt"))
    rows = both.select(*keys, "b_num", "c_num", said("b").alias("b_txt"), said("c").alias("c_txt"), F.coalesce(F.nullif("c_unit", F.lit("")), "b_unit").alias("unit"))
    rows = rows.where(~((F.col("kind") == "gap") & F.coalesce((F.col("b_txt") == "none") & (F.col("c_txt") == "none"), F.lit(False))))
    return rows.withColumn("delta_pct", F.coalesce(delta_percent(F.col("b_num"), F.col("c_num")), F.lit("")))


def stability(metrics: DataFrame, by: list[str], value: str = "value", min_samples: int = 2) -> DataFrame:
    """Spread over runs: ``n``, ``mean``, sample ``stdev`` (0 for one run), ``cv_pct``, ``minimum``, ``maximum``."""
    v = F.col(value)
    finite = metrics.where(v.isNotNull() & ~F.isnan(v.cast("double")) & (F.abs(v.cast("double")) < float("inf")))
    stats = finite.groupBy(*by).agg(F.count("*").alias("n"), F.avg(v).alias("mean"), F.coalesce(F.stddev_samp(v), F.lit(0.0)).alias("stdev"), F.min(v).alias("minimum"), F.max(v).alias("maximum"))
    return stats.where(F.col("n") >= min_samples).withColumn("cv_pct", F.coalesce(F.abs(F.try_divide(F.col("stdev"), F.col("mean")) * 100), F.lit(0.0)))


def unstable(stable: DataFrame, threshold: float, k: int = 25) -> DataFrame:
    """The ``k`` metrics that vary most, at or above a coefficient of variation."""
    return stable.where(F.col("cv_pct") >= threshold).orderBy(F.desc("cv_pct"), *[c for c in ("kind", "item", "metric") if c in stable.columns]).limit(k)


def _frame(raw: Column) -> Column:
    """A frame without its arguments and offset: cut at the last ``(``, then at the last ``+``."""
    return F.trim(F.regexp_replace(F.regexp_replace(raw, r"\([^(]*$", ""), r"\+[^+]*$", ""))


def hot_frames(stacks: DataFrame, k: int = 15, *, leaves: bool = False) -> DataFrame:
    """The ``k`` frames with most samples, each occurrence in a stack counted; of equals, the first by name."""
    frames = F.split("stack", ";")
    raw = stacks.select(F.element_at(frames, -1).alias("f"), "n") if leaves else stacks.select(F.explode(frames).alias("f"), "n")
    named = raw.select(_frame(F.col("f")).alias("frame"), "n").where("frame <> '' and not startswith(frame, '[')")
    return named.groupBy("frame").agg(F.sum("n").alias("samples")).orderBy(F.desc("samples"), "frame").limit(k)


def keyword_share(stacks: DataFrame, keywords: list[str]) -> DataFrame:
    """One row: ``samples``, ``matched`` and ``share`` in per cent of stacks that contain any keyword."""
    hit = F.lit(False)
    for word in keywords:
        hit = hit | F.contains("stack", F.lit(word))
    sums = stacks.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("samples"), F.coalesce(F.sum(F.when(hit, F.col("n"))), F.lit(0)).alias("matched"))
    return sums.withColumn("share", F.coalesce(F.try_divide(F.col("matched") * 100.0, F.col("samples")), F.lit(0.0)))


def off_cpu(stacks: DataFrame, k: int = 3000) -> DataFrame:
    """Blocked stacks folded from the root down, most frequent first."""
    folded = F.array_join(F.reverse(F.split("stack", ";")), ";")
    return stacks.groupBy(folded.alias("stack")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "stack").limit(k)


def rates(counters: DataFrame, metric: str = "metric", at: str = "seq", value: str = "value") -> DataFrame:
    """Increase since the previous reading (0 after a reset) and its rate per unit of time."""
    w = Window.partitionBy(metric).orderBy(at)
    before = F.lag(value).over(w)
    grown = F.when(before.isNotNull(), F.greatest(F.col(value) - before, F.lit(0)))
    return counters.withColumn("delta", grown).withColumn("rate", F.try_divide(F.col("delta"), F.col(at) - F.lag(at).over(w))).where("delta is not null")


def mean_latency(intervals: DataFrame, total: str, ops: str) -> DataFrame:
    """Latency per operation in each interval; null without operations."""
    return intervals.withColumn("latency", F.try_divide(F.col(total), F.col(ops)))


def runtimes(metrics: DataFrame) -> DataFrame:
    """Metrics derived from wall, active, job and drain seconds of each item."""
    pick = lambda kind, name: F.max(F.when((F.col("kind") == kind) & (F.col("metric") == name), F.col("num")))
    wide = metrics.groupBy("item").agg(
        pick("summary", "tool_wall_s").alias("wall"), pick("fio", "active_io_runtime_s").alias("active"), pick("fio", "raw_job_runtime_s").alias("job"),
        pick("drain", "post_write_drain_s").alias("drain"), pick("fio", "read_io_mib").alias("read"), pick("fio", "write_io_mib").alias("write"),
    )
    over = lambda a, b: F.when(b > 0, a / b)
    c = F.col
    made = [
        ("wall_active_tail_s", c("wall") - c("active"), "s"), ("wall_active_ratio", over(c("wall"), c("active")), "ratio"),
        ("wall_job_runtime_tail_s", c("wall") - c("job"), "s"), ("wall_job_runtime_ratio", over(c("wall"), c("job")), "ratio"),
        ("active_plus_drain_s", c("active") + c("drain"), "s"), ("drain_active_ratio", over(c("drain"), c("active")), "ratio"),
        *[(f"{x}_effective_wall_bw_mib_s", over(c(x), c("wall")), "MiB/s") for x in ("read", "write")],
        *[(f"{x}_effective_active_plus_drain_bw_mib_s", over(c(x), c("active") + c("drain")), "MiB/s") for x in ("read", "write")],
    ]
    rows = wide.select("item", F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), v.alias("num"), F.lit(u).alias("unit")) for n, v, u in made])).alias("m"))
    return rows.select(F.lit("runtime").alias("kind"), "item", "m.*").where("num is not null")


def amplification(counters: DataFrame, prefix: str = "") -> DataFrame:
    """The 13 ratios of counters ``item``, ``name``, ``value`` as metrics; ``prefix`` is what names begin with in the files."""
    plain = counters.withColumn("name", F.regexp_replace("name", f"^{prefix}", ""))
    units = {name: unit for name, *_, unit in RATIOS}
    of_unit = F.element_at(F.create_map(*[F.lit(x) for pair in units.items() for x in pair]), F.col("metric"))
    return ratios(plain, [r[:4] for r in RATIOS]).select(F.lit("amplification").alias("kind"), "item", "metric", "num", of_unit.alias("unit"))


def in_kind_order(metrics: DataFrame) -> DataFrame:
    """Metrics in the order of reports: by kind, item and metric."""
    place = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in KIND_ORDER.items() for x in pair]), F.col("kind")), F.lit(99))
    return metrics.withColumn("place", place).orderBy("place", "item", "metric")


def percentile_table(latencies: DataFrame) -> DataFrame:
    """``item``, ``op`` and readable ``p1`` to ``p99.9`` of rows ``item``, ``op``, ``percentile`` (a map in ns); items without any are left out."""
    got = latencies.where(F.size("percentile") > 0)
    return got.select("item", "op", *[readable_latency(F.coalesce(F.try_element_at("percentile", F.lit(k)), F.lit(0.0))).alias(name) for name, k in PERCENTILES.items()])


def workload_compare(base: DataFrame, new: DataFrame) -> DataFrame:
    """``item``, ``metric``, ``before``, ``after`` and ``delta`` of workloads in both runs (``item``, ``read_bw``, ``write_bw``, ``read_p99``,
    ``write_p99``): bandwidths where both are positive, latencies where the first is."""
    named = [("Read BW", "read_bw", True), ("Write BW", "write_bw", True), ("Read P99", "read_p99", False), ("Write P99", "write_p99", False)]
    both = base.alias("b").join(new.alias("c"), "item")
    rows = []
    for name, c, both_positive in named:
        b, n = F.coalesce(F.col(f"b.{c}"), F.lit(0.0)), F.coalesce(F.col(f"c.{c}"), F.lit(0.0))
        delta = (n - b) / b * 100.0
        said = F.concat(F.when(delta > 0, "+").otherwise(""), F.format_string("%.1f%%", delta))
        there = (b > 0) & (n > 0) if both_positive else (b > 0) & F.col(f"b.{c}").isNotNull() & F.col(f"c.{c}").isNotNull()
        rows.append(F.when(there, F.struct(F.lit(name).alias("metric"), b.alias("before"), n.alias("after"), said.alias("delta"))))
    return both.select("item", F.explode(F.filter(F.array(*rows), lambda r: r.isNotNull())).alias("r")).select("item", "r.*")


def first_of_each(rows: DataFrame, title: str, *order: str) -> DataFrame:
    """One row a title, the first in order, numbered by it."""
    kept = rows.withColumn("__k", F.row_number().over(Window.partitionBy(title).orderBy(*order))).where("__k = 1").drop("__k")
    return kept.withColumn("number", F.row_number().over(Window.orderBy(*order)).cast("bigint"))

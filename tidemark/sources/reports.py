"""Readers and writers of benchmark artefacts: job results, summaries, counters, folded stacks, scheduler traces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_DIRECTION = "struct<io_bytes:double,total_ios:double,bw_bytes:double,iops:double,runtime:double,clat_ns:struct<N:double,mean:double,percentile:map<string,double>>>"
JOBS = f"struct<jobs:array<struct<jobname:string,read:{_DIRECTION},write:{_DIRECTION}>>>"


def percentile(values: Column, key: str) -> Column:
    """A percentile by its long name (``95.000000``), else its short one; zero and missing fall through to 0."""
    return F.coalesce(F.nullif(values[f"{float(key):.6f}"], F.lit(0.0)), values[key], F.lit(0.0))


def whole_files(spark: SparkSession, path: str) -> DataFrame:
    """``file`` and ``value`` (all of its text)."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), "value")


def item_of(file: Column) -> Column:
    """Item name of a file: without folder, ``stats-`` in front, ``-after`` and the ending."""
    name = F.regexp_extract(file, r"([^/]+)$", 1)
    return F.regexp_replace(F.regexp_replace(name, r"(-after)?\.(txt|json)$", ""), r"^stats-", "")


def fio_jobs(files: DataFrame) -> DataFrame:
    """Job rows of JSON results, one for each job and direction; text before the first ``{`` is skipped."""
    body = F.from_json(F.expr("substring(value, greatest(instr(value, '{'), 1))"), JOBS)
    jobs = files.select(item_of(F.col("file")).alias("item"), F.explode(body["jobs"]).alias("j"))
    ops = jobs.select("item", F.col("j.jobname").alias("job"), F.explode(F.array(*[F.struct(F.lit(d).alias("op"), F.col(f"j.{d}").alias("d")) for d in ("read", "write")])).alias("o"))
    d = F.col("o.d")
    of = d["clat_ns"]["percentile"]
    return ops.where(d.isNotNull()).select(
        "item", "job", F.col("o.op").alias("op"), d["io_bytes"].alias("io_bytes"), d["total_ios"].alias("total_ios"), d["bw_bytes"].alias("bw_bytes"), d["iops"].alias("iops"), d["runtime"].alias("runtime"),
        d["clat_ns"]["N"].alias("n"), d["clat_ns"]["mean"].alias("mean"), *[percentile(of, k).alias(n) for k, n in (("95", "p95"), ("99", "p99"), ("99.9", "p999"))],
    )


def fio_latencies(files: DataFrame) -> DataFrame:
    """``item``, ``op`` and ``percentile`` (a map in ns) of the first job of each JSON result."""
    body = F.from_json(F.expr("substring(value, greatest(instr(value, '{'), 1))"), JOBS)
    first = files.select(item_of(F.col("file")).alias("item"), F.get(body["jobs"], F.lit(0)).alias("j"))
    each = F.explode(F.array(*[F.struct(F.lit(d).alias("op"), F.col(f"j.{d}.clat_ns.percentile").alias("percentile")) for d in ("read", "write")]))
    return first.select("item", each.alias("o")).select("item", "o.*").where("percentile is not null")


def seconds(text: Column) -> tuple[Column, Column]:
    """Seconds and whether they are a timeout, of ``12.5`` or ``timeout:30``; null for anything else and below 0."""
    value = F.regexp_replace(text, "^timeout:", "").try_cast("double")
    return F.when(value >= 0, value), F.when(value >= 0, F.startswith(text, F.lit("timeout:")))


def tsv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", header=True, inferSchema=False)


def summary_metrics(rows: DataFrame) -> DataFrame:
    """Status and wall seconds of tools (``tool``, ``status``, ``seconds``) as metrics."""
    at_least = F.col("seconds").try_cast("double")
    each = F.array(
        F.struct(F.lit("status").alias("metric"), F.lit(None).cast("double").alias("num"), F.nullif("status", F.lit("")).alias("txt"), F.lit("").alias("unit")),
        F.struct(F.lit("tool_wall_s").alias("metric"), F.when(at_least >= 0, at_least).alias("num"), F.lit(None).cast("string").alias("txt"), F.lit("s").alias("unit")),
    )
    return rows.where("tool <> ''").select(F.lit("summary").alias("kind"), F.col("tool").alias("item"), F.explode(each).alias("m")).select("kind", "item", "m.*").where("num is not null or txt is not null")


def drain_metrics(rows: DataFrame) -> DataFrame:
    """Drain seconds and remaining MiB of tools as metrics."""
    s, late = seconds(F.coalesce(*[F.nullif(c, F.lit("")) for c in ("post_write_drain_s", "post_fio_drain_s") if c in rows.columns]))
    left = [("pending_bytes", "drain_pending_mib"), ("dirty_bytes", "drain_dirty_mib"), ("buffer_dirty_bytes", "drain_buffer_dirty_mib")]
    mib = lambda c: F.when(F.col(c).try_cast("double") >= 0, F.col(c).try_cast("double") / float(1 << 20))
    each = [("post_write_drain_s", s, "s"), ("post_write_drain_timeout", late.cast("double"), "bool"), *[(n, mib(c), "MiB") for c, n in left if c in rows.columns]]
    made = F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), v.alias("num"), F.lit(u).alias("unit")) for n, v, u in each]))
    return rows.where("tool <> ''").select(F.lit("drain").alias("kind"), F.col("tool").alias("item"), made.alias("m")).select("kind", "item", "m.*").where("num is not null")


def live_counters(files: DataFrame, prefix: str = "") -> DataFrame:
    """The same as ``counters`` for unsigned whole numbers, of which none loses digits; lines with other values are skipped."""
    return counters(files, prefix, "decimal(20,0)")


def counters(files: DataFrame, prefix: str = "", kind: str = "double") -> DataFrame:
    """``item``, ``name`` and ``value`` of counter lines ``name value``; the last line of a name wins, others are skipped."""
    lines = files.select(item_of(F.col("file")).alias("item"), F.posexplode(F.split("value", "\n")).alias("line", "raw"))
    parts = F.split(F.trim("raw"), r"\s+")
    rows = lines.select("item", "line", F.get(parts, F.lit(0)).alias("name"), F.get(parts, F.lit(1)).try_cast(kind).alias("value"))
    return rows.where(F.startswith("name", F.lit(prefix)) & ~F.startswith("name", F.lit("#")) & F.col("value").isNotNull()).groupBy("item", "name").agg(F.max_by("value", "line").alias("value"))


def folded_stacks(lines: DataFrame) -> DataFrame:
    """``stack`` and ``n`` of lines ``a;b;c 12``; others are skipped."""
    return lines.select(F.regexp_extract("value", r"^(.*) (\d+)\s*$", 1).alias("stack"), F.regexp_extract("value", r"^(.*) (\d+)\s*$", 2).try_cast("bigint").alias("n")).where("n is not null")


def operation_rates(lines: DataFrame) -> DataFrame:
    """``op``, ``ops_per_s`` and ``us_per_op`` of log lines that hold them."""
    rate, cost = F.regexp_extract("value", r"ops/sec=\s*([0-9.]+)", 1).try_cast("double"), F.regexp_extract("value", r"([0-9.]+)\s*usec/op", 1).try_cast("double")
    return lines.select(F.regexp_extract("value", r"^\s*(\w+)", 1).alias("op"), rate.alias("ops_per_s"), cost.alias("us_per_op")).where("ops_per_s is not null or us_per_op is not null")


def switch_stacks(files: DataFrame) -> DataFrame:
    """``stack`` of each context switch in a trace: the frames on the lines after it, innermost first.

    A file is cut where lines with a switch begin, so each of its events is one row, without a shuffle.
    """
    events = files.select("file", F.explode(F.split("value", r"(?:^|\n)(?=[^\n]*sched_switch)")).alias("event")).where(F.contains("event", F.lit("sched_switch")))
    frame = lambda raw: F.regexp_extract(raw, r"^\s+[0-9a-f]+ (\S+?)(\+0x[0-9a-f]+)? ", 1)
    frames = events.select("file", F.filter(F.transform(F.split("event", "\n"), frame), lambda name: name != "").alias("f"))
    return frames.where(F.size("f") > 0).select("file", F.array_join("f", ";").alias("stack"))


def write_report(rows: DataFrame, path: str, decimals: int = 3) -> None:
    """Tab-separated report with fixed decimals."""
    text = [F.format_string(f"%.{decimals}f", c).alias(c) if t in ("double", "float") else F.col(c) for c, t in rows.dtypes]
    rows.select(*text).write.csv(path, sep="\t", header=True)


def write_counters(rows: DataFrame, path: str) -> None:
    """Counters as text lines ``name value``."""
    rows.select(F.concat_ws(" ", "name", F.col("value").cast("string"))).write.text(path)


def markdown(rows: DataFrame, most: int = 1000) -> str:
    """The first rows as a Markdown table, for reports of a bounded size."""
    lines = ["| " + " | ".join(rows.columns) + " |", "| " + " | ".join("---" for _ in rows.columns) + " |"]
    cell = lambda v: f"{v:.3f}" if isinstance(v, float) else "" if v is None else str(v)
    return "\n".join(lines + ["| " + " | ".join(cell(v) for v in r) + " |" for r in rows.limit(most).collect()])

"""Queries of reports over files that they write from the tables, of ratios and tables of workloads, and their SQL twins."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import text
from tidemark.operators import telemetry
from tidemark.plans.registry import query
from tidemark.sources import reports
from tidemark.sources.scratch import folder as scratch
from tidemark.sources.tables import table, view
from tidemark.streaming import feeds

# Ratios and tables

_NAMES = sorted({c for _, a, b, *_ in telemetry.RATIOS for c in (a, b)})
_LIST = ", ".join(f"'{n}'" for n in _NAMES)
COUNTERS = f"c AS (SELECT 'u' || CAST(user_id % 10 AS VARCHAR) AS item, ([{_LIST}])[CAST(event_id % {len(_NAMES)} AS INTEGER) + 1] AS name, CAST(sum(event_id % 13 * (user_id % 10)) AS DOUBLE) AS value FROM events GROUP BY ALL)"
_TABLE = ", ".join(f"('{m}', '{a}', '{b}', {d!r}, '{u}')" for m, a, b, d, u in telemetry.RATIOS)


@query("tele_amplification", f"""WITH {COUNTERS}, r(metric, over, under, d, unit) AS (VALUES {_TABLE})
SELECT 'amplification' AS kind, a.item, r.metric, round(a.value / (b.value / CAST(r.d AS DOUBLE)), 6) AS num, r.unit FROM r JOIN c a ON a.name = r.over JOIN c b ON b.item = a.item AND b.name = r.under WHERE b.value > 0""")  # fmt: skip
def tele_amplification(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "events")
    name = F.concat(F.lit("fs_"), F.get(F.lit(_NAMES), (F.col("event_id") % len(_NAMES)).cast("int")))
    rows = e.groupBy(F.concat(F.lit("u"), (F.col("user_id") % 10).cast("string")).alias("item"), name.alias("name")).agg(F.sum(F.col("event_id") % 13 * (F.col("user_id") % 10)).cast("double").alias("value"))
    return telemetry.amplification(rows, "fs_").withColumn("num", F.round("num", 6))


@query("tele_kind_order", """WITH m AS (SELECT ['stats', 'fio', 'summary', 'gap', 'drain', 'amplification', 'runtime'][CAST(event_id % 7 AS INTEGER) + 1] AS kind, event_type AS item, CAST(event_id AS VARCHAR) AS metric FROM events)
SELECT kind, item, metric, CASE kind WHEN 'summary' THEN 0 WHEN 'fio' THEN 1 WHEN 'runtime' THEN 2 WHEN 'drain' THEN 3 WHEN 'stats' THEN 4 WHEN 'amplification' THEN 5 ELSE 99 END AS place FROM m ORDER BY place, item, metric""")  # fmt: skip
def tele_kind_order(spark: SparkSession, folder: str) -> DataFrame:
    kinds = F.lit(["stats", "fio", "summary", "gap", "drain", "amplification", "runtime"])
    rows = table(spark, folder, "events").select(F.get(kinds, (F.col("event_id") % 7).cast("int")).alias("kind"), F.col("event_type").alias("item"), F.col("event_id").cast("string").alias("metric"))
    return telemetry.in_kind_order(rows)


@query("tele_first_of_each", """WITH s AS (SELECT o_orderpriority || CAST(o_custkey % 50 AS VARCHAR) AS title, o_orderkey % 5 AS priority, o_orderkey FROM orders), k AS (SELECT *, row_number() OVER (PARTITION BY title ORDER BY priority, o_orderkey) AS k FROM s)
SELECT title, priority, o_orderkey, row_number() OVER (ORDER BY priority, o_orderkey) AS number FROM k WHERE k = 1""")  # fmt: skip
def tele_first_of_each(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "orders").select(F.concat("o_orderpriority", (F.col("o_custkey") % 50).cast("string")).alias("title"), (F.col("o_orderkey") % 5).alias("priority"), "o_orderkey")
    return telemetry.first_of_each(rows, "title", "priority", "o_orderkey")


def _workloads(spark: SparkSession, folder: str, run: int) -> DataFrame:
    rows = table(spark, folder, "lineitem").where(F.col("l_linenumber") == run).groupBy((F.col("l_suppkey") % 40).alias("item"))
    one = rows.agg(F.sum(F.floor(F.col("l_quantity"))).cast("double").alias("read_bw"), F.sum(F.floor(F.col("l_extendedprice"))).cast("double").alias("write_bw"), F.max("l_partkey").cast("double").alias("read_p99"), F.min("l_partkey").cast("double").alias("write_p99"))
    gap = F.col("item") % 9 == run
    return one.select(F.concat(F.lit("w"), F.col("item").cast("string")).alias("item"), F.when(gap, 0.0).otherwise(F.col("read_bw")).alias("read_bw"), "write_bw", F.when(~gap, F.col("read_p99")).alias("read_p99"), "write_p99")


_RUN = """SELECT 'w' || CAST(i AS VARCHAR) AS item, CASE WHEN i % 9 = {run} THEN 0 ELSE rb END AS rb, wb, CASE WHEN i % 9 = {run} THEN NULL ELSE rp END AS rp, wp FROM (SELECT l_suppkey % 40 AS i, CAST(sum(floor(l_quantity)) AS DOUBLE) AS rb,
CAST(sum(floor(l_extendedprice)) AS DOUBLE) AS wb, CAST(max(l_partkey) AS DOUBLE) AS rp, CAST(min(l_partkey) AS DOUBLE) AS wp FROM lineitem WHERE l_linenumber = {run} GROUP BY 1)"""


@query("tele_workload_compare", f"WITH b AS ({_RUN.format(run=1)}), c AS ({_RUN.format(run=2)}), " + """m AS (SELECT item, 'Read BW' AS metric, b.rb AS before, c.rb AS after FROM b JOIN c USING (item) WHERE b.rb > 0 AND c.rb > 0 UNION ALL SELECT item, 'Write BW', b.wb, c.wb FROM b JOIN c USING (item) WHERE b.wb > 0 AND c.wb > 0
UNION ALL SELECT item, 'Read P99', b.rp, c.rp FROM b JOIN c USING (item) WHERE b.rp > 0 AND c.rp IS NOT NULL UNION ALL SELECT item, 'Write P99', b.wp, c.wp FROM b JOIN c USING (item) WHERE b.wp > 0)
SELECT item, metric, before, after, CASE WHEN after > before THEN '+' ELSE '' END || printf('%.1f%%', (after - before) / before * 100.0) AS delta FROM m""")  # fmt: skip
def tele_workload_compare(spark: SparkSession, folder: str) -> DataFrame:
    return telemetry.workload_compare(_workloads(spark, folder, 1), _workloads(spark, folder, 2))


@query("tele_latency_formats", """WITH v AS (SELECT event_id, CAST(event_id % 7 AS DOUBLE) * pow(10, event_id % 10) AS ns FROM events) SELECT event_id, CASE WHEN ns = 0 THEN '-' WHEN ns < 100000 THEN printf('%.1f µs', ns / 1000) WHEN ns < 1e9 THEN printf('%.2f ms', ns / 1000000) ELSE printf('%.2f s', ns / 1000000000) END AS latency FROM v""")
def tele_latency_formats(spark: SparkSession, folder: str) -> DataFrame:
    ns = (F.col("event_id") % 7).cast("double") * F.pow(F.lit(10.0), F.col("event_id") % 10)
    return table(spark, folder, "events").select("event_id", text.readable_latency(ns).alias("latency"))


@query("tele_interval_latency", "SELECT user_id AS item, CAST(sum(value) AS DOUBLE) AS total, count(*) - 3 AS ops, CASE WHEN count(*) <> 3 THEN round(sum(value) / (count(*) - 3), 6) END AS latency FROM (SELECT user_id, floor(value) AS value FROM events) GROUP BY user_id")
def tele_interval_latency(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "events").groupBy(F.col("user_id").alias("item")).agg(F.sum(F.floor("value")).cast("double").alias("total"), (F.count("*") - 3).alias("ops"))
    return telemetry.mean_latency(rows, "total", "ops").withColumn("latency", F.round("latency", 6))


# Files that are written from the tables and read back


def _written(lines: DataFrame, name: str, by: str) -> str:
    """One text file a value of ``by``, with its ``lines`` in order of ``at``; the folder."""
    path = f"{scratch(lines.sparkSession)}/{name}-{uuid.uuid4().hex}"
    lines.repartition(by).sortWithinPartitions(by, "at").select(by, "line").write.partitionBy(by).text(path)
    return path


def _files(spark: SparkSession, path: str, by: str) -> DataFrame:
    """``file`` (named like the value) and ``value`` of what ``_written`` wrote."""
    got = spark.read.text(path + "/*", wholetext=True).select(F.input_file_name().alias("file"), "value")
    return got.select(F.concat(F.lit("x/stats-"), F.regexp_extract("file", f"{by}=([^/]+)/", 1), F.lit("-after.txt")).alias("file"), "value")


def _jobs(spark: SparkSession, folder: str) -> DataFrame:
    j = table(spark, folder, "lineitem").groupBy(F.col("l_returnflag").alias("item"), F.col("l_linenumber").alias("run")).agg(F.count("*").alias("n"), F.sum(F.col("l_partkey")).alias("b"), F.max("l_suppkey").alias("r"))
    side = lambda k: F.format_string(f'{{"io_bytes":%d,"total_ios":%d,"bw_bytes":%d,"iops":%d,"runtime":%d,"clat_ns":{{"N":%d,"mean":%d,"percentile":{{"1.000000":%d,"95.000000":%d,"99.000000":%d,"99.900000":0,"99.9":%d}}}}}}', *[F.col(c) * k for c in ("b", "n", "b", "n", "r", "n", "r", "n", "r", "b", "b")])
    body = F.concat(F.lit('note: started {"jobs":[{"jobname":"job'), F.col("run").cast("string"), F.lit('","read":'), side(1), F.lit(',"write":'), side(2), F.lit("}]}"))
    body = F.regexp_replace(body, "^note: started ", "note: started\n")
    return j.select(F.concat("item", F.col("run").cast("string")).alias("job"), F.lit(0).alias("at"), body.alias("line"))


_J = "j AS (SELECT l_returnflag || CAST(l_linenumber AS VARCHAR) AS item, l_linenumber AS run, count(*) AS n, CAST(sum(l_partkey) AS BIGINT) AS b, max(l_suppkey) AS r FROM lineitem GROUP BY ALL), s AS (SELECT *, unnest([1, 2]) AS k FROM j)"


@query("source_fio_jobs", f"WITH {_J} SELECT item, 'job' || CAST(run AS VARCHAR) AS job, CASE k WHEN 1 THEN 'read' ELSE 'write' END AS op, CAST(b * k AS DOUBLE) AS io_bytes, CAST(n * k AS DOUBLE) AS total_ios, CAST(r * k AS DOUBLE) AS runtime, CAST(r * k AS DOUBLE) AS mean, CAST(r * k AS DOUBLE) AS p95, CAST(b * k AS DOUBLE) AS p99, CAST(b * k AS DOUBLE) AS p999 FROM s")
def source_fio_jobs(spark: SparkSession, folder: str) -> DataFrame:
    path = _written(_jobs(spark, folder), "fio", "job")
    return reports.fio_jobs(_files(spark, path, "job")).select("item", "job", "op", "io_bytes", "total_ios", "runtime", "mean", "p95", "p99", "p999")


@query("tele_percentile_table", f"WITH {_J}, f AS (SELECT item, k, CAST(n * k AS DOUBLE) AS p1, CAST(r * k AS DOUBLE) AS p95, CAST(b * k AS DOUBLE) AS p99 FROM s), " + """t AS (SELECT *, p1 AS v1, p95 AS v2, p99 AS v3 FROM f)
SELECT item, CASE k WHEN 1 THEN 'read' ELSE 'write' END AS op, """ + ", ".join(f"CASE WHEN {c} = 0 THEN '-' WHEN {c} < 100000 THEN printf('%.1f µs', {c} / 1000) WHEN {c} < 1e9 THEN printf('%.2f ms', {c} / 1000000) ELSE printf('%.2f s', {c} / 1000000000) END AS {n}" for n, c in (("p1", "v1"), ("p95", "v2"), ("p99", "v3"))) + ", '-' AS p50 FROM t")  # fmt: skip
def tele_percentile_table(spark: SparkSession, folder: str) -> DataFrame:
    path = _written(_jobs(spark, folder), "fio", "job")
    return telemetry.percentile_table(reports.fio_latencies(_files(spark, path, "job"))).select("item", "op", "p1", "p95", "p99", "p50")


@query("source_counters", "SELECT item, name, CAST(v AS DOUBLE) AS value FROM (SELECT event_type AS item, 'c_' || CAST(user_id AS VARCHAR) AS name, arg_max(event_id * 3, event_id) AS v FROM events GROUP BY ALL)")
def source_counters(spark: SparkSession, folder: str) -> DataFrame:
    e = F.col("event_id")
    line = F.when(e % 17 == 0, F.concat(F.lit("# note\n  c_"), F.col("user_id").cast("string"), F.lit("  "), (e * 3).cast("string"))).otherwise(F.concat_ws(" ", F.concat(F.lit("c_"), F.col("user_id").cast("string")), (e * 3).cast("string")))
    path = _written(table(spark, folder, "events").select(F.col("event_type").alias("kind"), e.alias("at"), line.alias("line")), "counters", "kind")
    return reports.counters(_files(spark, path, "kind"), "c_")


@query("source_live_counters", "SELECT event_type AS item, 'c_' || CAST(user_id AS VARCHAR) AS name, CAST(9007199254740993 + max(event_id) AS VARCHAR) AS value FROM events GROUP BY ALL")
def source_live_counters(spark: SparkSession, folder: str) -> DataFrame:
    value = (F.lit(9007199254740993) + F.col("event_id")).cast("string")
    rows = table(spark, folder, "events").select(F.col("event_type").alias("kind"), F.col("event_id").alias("at"), F.concat_ws(" ", F.concat(F.lit("c_"), F.col("user_id").cast("string")), value).alias("line"))
    return reports.live_counters(_files(spark, _written(rows, "live", "kind"), "kind"), "c_").withColumn("value", F.col("value").cast("string"))


@query("source_folded_stacks", "SELECT stack, CAST(sum(n) AS BIGINT) AS n FROM stacks GROUP BY stack", ("stacks",))
def source_folded_stacks(spark: SparkSession, folder: str) -> DataFrame:
    path = f"{scratch(spark)}/folded-{uuid.uuid4().hex}"
    view(spark, folder, "stacks").select(F.concat_ws(" ", "stack", F.col("n").cast("string"))).write.text(path)
    return reports.folded_stacks(spark.read.text(path)).groupBy("stack").agg(F.sum("n").alias("n"))


@query("source_operation_rates", "SELECT event_type || CAST(event_id AS VARCHAR) AS op, CAST(event_id * 10 AS DOUBLE) AS ops_per_s, CASE WHEN event_id % 2 = 0 THEN CAST(event_id AS DOUBLE) END AS us_per_op FROM events WHERE event_id % 3 > 0")
def source_operation_rates(spark: SparkSession, folder: str) -> DataFrame:
    path, e = f"{scratch(spark)}/rates-{uuid.uuid4().hex}", F.col("event_id")
    said = F.concat(F.col("event_type"), e.cast("string"), F.lit(": ops/sec= "), (e * 10).cast("string"), F.when(e % 2 == 0, F.concat(F.lit(" , "), e.cast("string"), F.lit(" usec/op"))).otherwise(""))
    table(spark, folder, "events").select(F.when(e % 3 == 0, F.lit("starting")).otherwise(said)).write.text(path)
    return reports.operation_rates(spark.read.text(path))


@query("source_summaries", "SELECT 'summary' AS kind, 't' || CAST(event_id AS VARCHAR) AS item, 'status' AS metric, CAST(NULL AS DOUBLE) AS num, event_type AS txt, '' AS unit FROM events UNION ALL SELECT 'summary', 't' || CAST(event_id AS VARCHAR), 'tool_wall_s', CAST(event_id AS DOUBLE) / 4, NULL, 's' FROM events WHERE event_id % 5 > 0")
def source_summaries(spark: SparkSession, folder: str) -> DataFrame:
    path, e = f"{scratch(spark)}/summary-{uuid.uuid4().hex}", F.col("event_id")
    rows = table(spark, folder, "events").select(F.concat(F.lit("t"), e.cast("string")).alias("tool"), F.col("event_type").alias("status"), F.when(e % 5 == 0, F.lit("-")).otherwise((e / 4).cast("string")).alias("seconds"))
    rows.write.csv(path, sep="\t", header=True)
    return reports.summary_metrics(reports.tsv(spark, path))


@query("source_drains", """WITH d AS (SELECT 't' || CAST(event_id AS VARCHAR) AS item, event_id AS e FROM events), m AS (SELECT item, 'post_write_drain_s' AS metric, CAST(e AS DOUBLE) / 2 AS num, 's' AS unit FROM d UNION ALL SELECT item, 'post_write_drain_timeout', CASE WHEN e % 7 = 0 THEN 1.0 ELSE 0.0 END, 'bool' FROM d
UNION ALL SELECT item, 'drain_pending_mib', CAST(e AS DOUBLE), 'MiB' FROM d WHERE e % 3 > 0) SELECT 'drain' AS kind, * FROM m""")  # fmt: skip
def source_drains(spark: SparkSession, folder: str) -> DataFrame:
    path, e = f"{scratch(spark)}/drain-{uuid.uuid4().hex}", F.col("event_id")
    took = F.concat(F.when(e % 7 == 0, "timeout:").otherwise(""), (e / 2).cast("string"))
    table(spark, folder, "events").select(F.concat(F.lit("t"), e.cast("string")).alias("tool"), took.alias("post_write_drain_s"), F.when(e % 3 > 0, (e * (1 << 20)).cast("string")).otherwise("x").alias("pending_bytes")).write.csv(path, sep="\t", header=True)
    return reports.drain_metrics(reports.tsv(spark, path))


@query("source_switch_stacks", """SELECT 'f' || CAST(user_id AS VARCHAR) || ';g' || CAST(event_id AS VARCHAR) AS stack FROM events""")
def source_switch_stacks(spark: SparkSession, folder: str) -> DataFrame:
    e = F.col("event_id").cast("string")
    line = F.concat(F.lit("app 1 [000] 1.0: sched:sched_switch: a\n    ffff81 f"), F.col("user_id").cast("string"), F.lit("+0x1a ([kernel])\n    ffff82 g"), e, F.lit(" (/bin/app)\n"))
    kind = F.concat_ws("-", "event_type", F.shiftright("event_id", 18).cast("string"))  # a trace of a kind goes on in further files
    path = _written(table(spark, folder, "events").select(kind.alias("kind"), F.col("event_id").alias("at"), line.alias("line")), "trace", "kind")
    return reports.switch_stacks(_files(spark, path, "kind")).select("stack")


@query("sink_report", "SELECT item, printf('%.3f', avg(value)) AS mean FROM metrics WHERE metric = 'quantity' GROUP BY item", ("metrics",))
def sink_report(spark: SparkSession, folder: str) -> DataFrame:
    path = f"{scratch(spark)}/report-{uuid.uuid4().hex}"
    reports.write_report(view(spark, folder, "metrics").where("metric = 'quantity'").groupBy("item").agg(F.avg("value").alias("mean")), path)
    return reports.tsv(spark, path)


@query("sink_counters", "SELECT 'c' || CAST(user_id AS VARCHAR) AS name, CAST(count(*) AS DOUBLE) AS value FROM events GROUP BY user_id")
def sink_counters(spark: SparkSession, folder: str) -> DataFrame:
    path = f"{scratch(spark)}/sink-{uuid.uuid4().hex}"
    reports.write_counters(table(spark, folder, "events").groupBy(F.concat(F.lit("c"), F.col("user_id").cast("string")).alias("name")).agg(F.count("*").alias("value")), path)
    return reports.counters(reports.whole_files(spark, path)).groupBy("name").agg(F.max("value").alias("value"))


# Streams, as tables


@query("stream_request_windows", "SELECT CAST(event_id // 60 * 60 AS BIGINT) AS start, event_type AS kind, count(*) AS n FROM events GROUP BY ALL")
def stream_request_windows(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "events").select(F.timestamp_seconds("event_id").alias("at"), F.col("event_type").alias("kind"))
    return feeds.windowed_counts(rows, "at", ["kind"], "60 seconds", "60 seconds").select(F.unix_timestamp("start").alias("start"), "kind", "n")


@query("stream_session_windows", """WITH s AS (SELECT user_id, event_id AS t, CASE WHEN event_id - lag(event_id) OVER w <= 300 THEN 0 ELSE 1 END AS f FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)), r AS (SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY t) AS run FROM s)
SELECT user_id, min(t) AS start, max(t) + 300 AS end, count(*) AS n FROM r GROUP BY user_id, run""")  # fmt: skip
def stream_session_windows(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "events").select(F.timestamp_seconds("event_id").alias("at"), "user_id")
    return feeds.session_windows(rows, "at", "user_id").select("user_id", F.unix_timestamp("start").alias("start"), F.unix_timestamp("end").alias("end"), "n")

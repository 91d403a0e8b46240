import json

import pytest
from pyspark.sql import functions as F

from tidemark.functions import text
from tidemark.operators import activity, fleet, telemetry
from tidemark.sources import reports


def test_fio_results(spark, tmp_path):
    op = lambda n, mean, p95: {"io_bytes": 10, "total_ios": 2, "bw_bytes": 5, "iops": 1.5, "runtime": 100, "clat_ns": {"N": n, "mean": mean, "percentile": {"95.000000": p95, "99": 7}}}
    body = {"jobs": [{"jobname": "a", "read": op(1, 10, 4)}, {"jobname": "b", "read": op(3, 50, 9)}]}
    (tmp_path / "seqread.json").write_text("note: warm\n" + json.dumps(body))
    jobs = reports.fio_jobs(reports.whole_files(spark, str(tmp_path)))
    total = telemetry.op_totals(jobs).where("op = 'read'").first()
    assert (total["item"], total.io_bytes, total.mean_ns, total.p95_ns, total.p99_ns, total.p999_ns) == ("seqread", 20, 40, 9, 7, 0)


def test_summaries_and_drains(spark, tmp_path):
    (tmp_path / "s.tsv").write_text("tool\tstatus\tseconds\nfio\tpass\t12.5\nbad\tfail\t-1\n")
    rows = reports.summary_metrics(reports.tsv(spark, str(tmp_path / "s.tsv"))).collect()
    assert sorted((r["item"], r.metric, r.num, r.txt) for r in rows) == [("bad", "status", None, "fail"), ("fio", "status", None, "pass"), ("fio", "tool_wall_s", 12.5, None)]
    (tmp_path / "d.tsv").write_text("tool\tpost_fio_drain_s\tpending_bytes\nfio\ttimeout:30\t1048576\n")
    rows = reports.drain_metrics(reports.tsv(spark, str(tmp_path / "d.tsv"))).collect()
    assert sorted((r.metric, r.num) for r in rows) == [("drain_pending_mib", 1.0), ("post_write_drain_s", 30.0), ("post_write_drain_timeout", 1.0)]


def test_counters_last_line_wins(spark, tmp_path):
    (tmp_path / "stats-seq-after.txt").write_text("Thu\n# x\nfs_a 1\nfs_b nope\nfs_a 3\n")
    rows = reports.counters(reports.whole_files(spark, str(tmp_path)), "fs_").collect()
    assert [(r["item"], r.name, r.value) for r in rows] == [("seq", "fs_a", 3.0)]


def test_stacks_logs_and_traces(spark, tmp_path):
    lines = spark.createDataFrame([("a;b (x)+1;[k] 5",), ("no count",)], "value string")
    assert [(r.stack, r.n) for r in reports.folded_stacks(lines).collect()] == [("a;b (x)+1;[k]", 5)]
    assert [(r.frame, r.samples) for r in telemetry.hot_frames(reports.folded_stacks(lines)).collect()] == [("a", 5), ("b", 5)]
    log = spark.createDataFrame([("create ops/sec= 10.5 95.2 usec/op",), ("x",)], "value string")
    assert [tuple(r) for r in reports.operation_rates(log).collect()] == [("create", 10.5, 95.2)]
    (tmp_path / "t.txt").write_text("p 1 [0] 1.0: sched:sched_switch: a\n\t7f00 schedule+0x1 (k)\n\t7f01 read (c)\n\n")
    assert [r.stack for r in reports.switch_stacks(reports.whole_files(spark, str(tmp_path / "t.txt"))).collect()] == ["schedule;read"]


def test_switch_stacks_of_odd_traces_without_a_shuffle(spark):
    texts = [
        "# head\n 7f00 early (k)\na sched_switch: sched_switch\n\t7f00 x+0x1 (k)\nnone\n\t7f01 y (c)\nb sched:sched_switch\nc sched:sched_switch\n 7f02 z (d)",
        "sched_switch\n 7f00 w (k)\r\n 7f01 v (k)\n", "", None, "no events\n 7f00 u (k)", "\n\n  ab 1 sched_switch\n 7f03 t (k)",
    ]
    files = spark.createDataFrame([(f"f{i}", t) for i, t in enumerate(texts)], "file string, value string")
    got = reports.switch_stacks(files)
    assert sorted((r.file, r.stack) for r in got.collect()) == [("f0", "x;y"), ("f0", "z"), ("f1", "w;v"), ("f5", "1;t")]
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()


def test_report_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", 1.23456)], "item string, num double")
    reports.write_report(df, str(tmp_path / "r"))
    assert spark.read.csv(str(tmp_path / "r"), sep="\t", header=True).first().num == "1.235"
    reports.write_counters(df.withColumnRenamed("item", "name").withColumnRenamed("num", "value"), str(tmp_path / "c"))
    assert spark.read.text(str(tmp_path / "c")).first().value == "a 1.23456"
    assert reports.markdown(df).splitlines()[-1] == "| a | 1.235 |"


@pytest.mark.parametrize(("base", "new", "said"), [(0.0, 0.0, "+0.0"), (0.0, 1.0, ""), (2.0, 3.0, "+50.0"), (4.0, 3.0, "-25.0"), (None, 1.0, None)])
def test_delta(spark, base, new, said):
    df = spark.createDataFrame([(base, new)], "a double, b double")
    assert df.select(text.delta_percent(F.col("a"), F.col("b"))).first()[0] == said


def test_rates_after_a_reset(spark):
    df = spark.createDataFrame([("m", 1, 10), ("m", 3, 30), ("m", 4, 5)], "metric string, seq bigint, value bigint")
    assert [(r.delta, r.rate) for r in telemetry.rates(df).orderBy("seq").collect()] == [(20, 10.0), (0, 0.0)]


def test_stability_of_one_run_and_of_odd_values(spark):
    df = spark.createDataFrame([("a", "x", 1.0), ("b", "x", float("inf")), ("b", "x", 2.0), ("b", "x", 2.0)], "item string, metric string, value double")
    rows = {r["item"]: r for r in telemetry.stability(df, ["item", "metric"], min_samples=1).collect()}
    assert (rows["a"].stdev, rows["b"].n, rows["b"].cv_pct) == (0.0, 2, 0.0)


def test_derived_runtimes(spark):
    rows = [("summary", "f", "tool_wall_s", 12.0), ("fio", "f", "active_io_runtime_s", 10.0), ("drain", "f", "post_write_drain_s", 2.0), ("fio", "f", "write_io_mib", 120.0)]
    got = {r.metric: r.num for r in telemetry.runtimes(spark.createDataFrame(rows, "kind string, item string, metric string, num double")).collect()}
    assert got == {"wall_active_tail_s": 2.0, "wall_active_ratio": 1.2, "active_plus_drain_s": 12.0, "drain_active_ratio": 0.2, "write_effective_wall_bw_mib_s": 10.0, "write_effective_active_plus_drain_bw_mib_s": 10.0}


@pytest.mark.parametrize(("path", "want"), [("/a/./b/../c", "/a/c"), ("/../..", "/"), ("a//b/", "/a/b"), ("", "/")])
def test_normal_path(spark, path, want):
    assert spark.createDataFrame([(path,)], "p string").select(text.normal_path(F.col("p"))).first()[0] == want


def test_read_ahead_grows_on_a_sequential_stream(spark):
    reads = spark.createDataFrame([(1, i, i * 4096, 4096) for i in range(8)], "inode bigint, seq bigint, off bigint, len bigint")
    sane = [r.ahead for r in activity.read_ahead(reads, block=4096, most=65536, budget=1 << 20, as_observed=False).orderBy("seq").collect()]
    assert sane == sorted(sane) and sane[-1] > sane[0] >= 4096
    assert activity.read_ahead(reads, block=4096, most=65536, budget=1 << 20).count() == 8


def test_pods_by_claim_inline_volume_and_readiness(spark):
    rows = [
        ("class", '{"metadata":{"name":"c1"},"provisioner":"fs.driver"}'),
        ("claim", '{"metadata":{"namespace":"a","name":"p"},"spec":{"storageClassName":"c1"}}'),
        ("claim", '{"metadata":{"namespace":"b","name":"p"},"spec":{"storageClassName":"zz"}}'),
        ("pod", '{"metadata":{"namespace":"a","name":"x"},"spec":{"volumes":[{"name":"v","persistentVolumeClaim":{"claimName":"p"}}]},"status":{"phase":"Running","conditions":[{"type":"Ready","status":"False"}]}}'),
        ("pod", '{"metadata":{"namespace":"b","name":"y"},"spec":{"volumes":[{"name":"v","persistentVolumeClaim":{"claimName":"p"}}]},"status":{"phase":"Running"}}'),
        ("pod", '{"metadata":{"namespace":"b","name":"z"},"spec":{"volumes":[{"name":"v","csi":{"driver":"fs.driver"}}]},"status":{"phase":"Running"}}'),
    ]
    objects = spark.createDataFrame(rows, "kind string, body string")
    assert sorted((r.name, r.ready) for r in fleet.pods(objects, "fs.driver", "fsmark").collect()) == [("x", False), ("z", True)]
    assert tuple(fleet.summary(objects, "fs.driver", "fsmark").first()) == (1, 0, 1, 2, 1)


def test_read_ahead_streams_a_hot_file(spark):
    rows = [(i % 5 and 1, i, (i * 4099) % 65536 if i % 3 else i * 100, 100) for i in range(400)]
    reads = spark.createDataFrame(rows, "inode bigint, seq bigint, off bigint, len bigint")
    whole = sorted(activity.read_ahead(reads, block=4096, most=65536, budget=1 << 20).collect())
    key, was = "spark.sql.execution.arrow.maxRecordsPerBatch", spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set(key, "7")
    try:
        small = activity.read_ahead(reads, block=4096, most=65536, budget=1 << 20)
        assert sorted(small.collect()) == whole
        assert "FlatMapGroups" not in small._jdf.queryExecution().toString()
    finally:
        spark.conf.set(key, was)

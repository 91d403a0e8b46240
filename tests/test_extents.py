import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.functions import layout
from tidemark.operators import access, extents

SCHEMA = "slice_id bigint, chunk_id bigint, off bigint, len bigint"
SLOW = settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))


def slices(spark, *ranges):
    return spark.createDataFrame([(i, 1, a, b - a) for i, (a, b) in enumerate(ranges)], SCHEMA)


@pytest.mark.parametrize(
    ("ranges", "share"),
    [([(0, 100), (100, 200)], 0.0), ([(0, 100), (50, 150)], 0.25), ([(0, 100), (0, 100)], 0.5), ([(0, 100), (25, 75)], 50 / 150), ([(0, 100), (50, 150), (100, 200)], 100 / 300), ([(5, 5), (9, 9)], 0.0)],
)
def test_fragmentation(spark, ranges, share):
    assert extents.fragmentation(slices(spark, *ranges)).first().fragmentation == pytest.approx(share)


@pytest.mark.parametrize(
    ("ranges", "left"),
    [([(0, 100), (50, 150)], [0, 1]), ([(10, 20), (0, 100)], [1]), ([(0, 100), (0, 100)], [1]), ([(10, 20), (5, 50), (0, 100)], [2]), ([(0, 100), (10, 20)], [0, 1])],
)
def test_not_covered(spark, ranges, left):
    assert sorted(r.slice_id for r in extents.not_covered(slices(spark, *ranges), span=16).collect()) == left


def test_split_blocks(spark):
    df = spark.createDataFrame([(10, 30)], "off bigint, len bigint")
    assert [tuple(r)[2:] for r in layout.split_blocks(df, "off", "len", 16).orderBy("block").collect()] == [(0, 10, 6), (1, 0, 16), (2, 0, 8)]
    assert layout.split_blocks(spark.createDataFrame([(10, 0)], "off bigint, len bigint"), "off", "len", 16).count() == 0


def overlay(ops, size=200):
    """Who holds each byte after all operations, the last one first."""
    held = [None] * size
    for i, (a, n, v) in enumerate(ops):
        for x in range(a, a + n):
            held[x] = v if v is not None else i
    return held


def spans(held):
    out = []
    for x, v in enumerate(held):
        if v is not None:
            if out and out[-1][1] == x and out[-1][2] == v:
                out[-1][1] = x + 1
            else:
                out.append([x, x + 1, v])
    return [tuple(s) for s in out]


@SLOW
@given(st.lists(st.tuples(st.integers(0, 120), st.integers(0, 60)), min_size=1, max_size=12))
def test_visible_against_bytes(spark, ranges):
    df = spark.createDataFrame([(i, 1, a, n) for i, (a, n) in enumerate(ranges)], SCHEMA)
    got = sorted((r.lo, r.hi, r.slice_id) for r in extents.visible(df, span=32).collect())
    assert got == spans(overlay([(a, n, None) for a, n in ranges]))


@SLOW
@given(st.lists(st.tuples(st.integers(0, 100), st.integers(1, 50), st.integers(0, 2)), min_size=1, max_size=12))
def test_locks_against_bytes(spark, ops):
    df = spark.createDataFrame([(1, 1, i, t, a, a + n) for i, (a, n, t) in enumerate(ops)], "inode bigint, owner bigint, seq bigint, lock_type int, start_off bigint, end_off bigint")
    got = sorted((r.lo, r.hi, r.lock_type) for r in access.locked_ranges(df).collect())
    held = [None if v == access.UNLOCK else v for v in overlay(ops)]
    assert got == spans(held)


def test_late_writes_keep_only_what_is_new(spark):
    writes = [(1, 1, 5, 0, 100), (1, 2, 3, 50, 100), (1, 3, 0, 0, 10), (1, 4, 9, 20, 20), (1, 5, 5, 0, 50)]
    got = access.allowed_writes(spark.createDataFrame(writes, "chunk_id bigint, seq bigint, unique bigint, off bigint, len bigint"))
    assert sorted((r.seq, r.lo, r.hi) for r in got.collect()) == [(1, 0, 100), (2, 100, 150), (3, 0, 10), (4, 20, 40), (5, 0, 20), (5, 40, 50)]


def test_compaction_thresholds(spark):
    rows = spark.createDataFrame([(1, 2, 0.9), (2, 3, 0.05), (3, 3, 0.1), (4, 200, 0.5)], "chunk_id bigint, n_slices bigint, fragmentation double")
    assert [(r.should_compact, r.sync) for r in extents.decide(rows).orderBy("chunk_id").collect()] == [(False, False), (False, False), (True, False), (True, True)]


def test_truncate(spark):
    df = slices(spark, (0, 10), (5, 25), (20, 30))
    assert [(r.action, r.new_len) for r in extents.truncate(df, F.lit(20)).orderBy("slice_id").collect()] == [("keep", 10), ("shorten", 15), ("drop", 0)]


def test_chunk_ids_do_not_wrap(spark):
    row = spark.range(1).select(layout.chunk_id(F.lit(7).cast("bigint"), F.lit(3).cast("bigint")).alias("a"), layout.chunk_id(F.lit(2**62), F.lit(1).cast("bigint")).alias("b")).first()
    assert (row.a, row.b) == (7_000_000_003, None)


def test_visible_deals_rows_by_their_number(spark, monkeypatch):
    rows = spark.createDataFrame([(i, i % 3, i * 7919 % 65536, 1 + i * 104729 % 8192) for i in range(300)], "slice_id bigint, chunk_id bigint, off bigint, len bigint")
    want = sorted(map(tuple, extents.visible(rows).collect()))
    monkeypatch.setattr(extents, "TASK_ROWS", 40, raising=False)
    few = extents.visible(rows)
    assert sorted(map(tuple, few.collect())) == want
    assert ", 8), REPARTITION_BY_NUM" in few._jdf.queryExecution().executedPlan().toString()

from decimal import Decimal

import duckdb

from tidemark.operators import usage
from tidemark.plans.catalog import QUERIES


def test_capacity_beyond_signed_64_bits(spark):
    used = [0, 1 << 50, 3_689_348_814_741_910_323, 3_689_348_814_741_910_324, 7_378_697_629_483_820_646, 7_378_697_629_483_820_647, 12 * 10**18, 72 * 10**18]
    rows = spark.createDataFrame([(Decimal(u), 9000) for u in used], "used_space decimal(38,0), used_inodes bigint")
    got = {int(r.used_space): (int(r.total_space), int(r.available_space)) for r in usage.capacity(rows).collect()}
    largest = (1 << 64) - 1
    total = [1 << 50, 1 << 51, 1 << 62, 1 << 63, 1 << 63, largest, largest, 72 * 10**18]
    assert [got[u] for u in used] == [(t, t - u) for t, u in zip(total, used)]


def test_capacity_of_no_usage_and_of_many_inodes(spark):
    rows = spark.createDataFrame([(None, None), (5, 10 * (4 << 20)), (5, 10 * (4 << 20) + 1), (5, (1 << 63) - 1)], "used_space bigint, used_inodes bigint")
    got = [(r.total_space, r.available_inodes) for r in usage.capacity(rows).collect()]
    assert got == [(1 << 50, 10 << 20), (1 << 50, 10 << 20), (1 << 50, 20 << 20), (1 << 50, 10 << 58)]


def test_capacity_query_takes_late_events(spark, tmp_path):
    duckdb.sql(f"COPY (SELECT event_id FROM (VALUES (1::BIGINT), (4_000_000), (5_999_999), (36_000_000)) AS e(event_id)) TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    got = {r.id: int(r.total_space - r.available_space) for r in QUERIES["usage_capacity_growth"](spark, str(tmp_path)).collect()}
    assert got == {i: i * 2 * 10**12 for i in (1, 4_000_000, 5_999_999, 36_000_000)}

import pytest

from tests.oracle import same
from tidemark.plans.catalog import QUERIES, SQL
from tidemark.sources.tables import view


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, sf, name):
    same(QUERIES[name](spark, sf), SQL[name], sf)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_queries_without_sql_run(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0


def test_whole_queries_ask_for_every_entry(spark, sf):
    dentry, due = view(spark, sf, "dentry"), view(spark, sf, "uncommitted").where("created_at <= 300000 and status = 'pending'")
    n = dentry.count()
    more = {"ns_lookup_all": 1, "ns_batch_stat_all": 1, "ns_lookup_path_all": 2, "ns_rename_allowed_all": 0, "ns_readdir_all": 0}
    assert {q: QUERIES[q](spark, sf).count() - n for q in more} == more
    assert QUERIES["gc_delayed_ready_all"](spark, sf).count() == due.count()

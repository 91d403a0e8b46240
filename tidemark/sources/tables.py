"""Tables of a folder, and views of them in the shapes of filesystem metadata and telemetry.

Each view is one query that Spark and any SQL engine read alike; ``{name}`` stands for a table.
"""

from __future__ import annotations

import re
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

VIEWS = {
    "slices": "select event_id as slice_id, user_id as chunk_id, (event_id*7919)%65536 as off, 1+(event_id*104729)%8192 as len from {events}",
    "dentry": "select cast(1 as bigint) as parent, r_name as name, cast(10+r_regionkey as bigint) as inode, 1 as type from {region}"
    " union all select cast(10+n_regionkey as bigint), n_name, cast(1000+n_nationkey as bigint), 1 from {nation}"
    " union all select cast(1000+c_nationkey as bigint), c_name, 1000000+c_custkey, 1 from {customer}"
    " union all select 1000000+o_custkey, concat('o',cast(o_orderkey as string)), 1000000000+o_orderkey, 0 from {orders}",
    "file_attr": "select 1000000000+o_orderkey as inode, cast(round(o_totalprice*100) as bigint) as size,"
    " case o_orderpriority when '1-URGENT' then 33188 when '2-HIGH' then 33184 else 33152 end as mode, cast(o_custkey%7 as int) as uid, cast(o_custkey%3 as int) as gid,"
    " case when o_orderstatus='F' then 0 else 1 end as nlink, (o_orderstatus='F') as deleted from {orders}",
    "locks": "select user_id as inode, event_id%5 as owner, event_id as seq, case event_type when 'purchase' then 1 when 'error' then 2 else 0 end as lock_type,"
    " (event_id*31)%1000 as start_off, (event_id*31)%1000+1+(event_id*17)%100 as end_off from {events}",
    "uncommitted": "select event_id as id, event_id as slice_id, user_id as chunk_id, 1+(event_id*104729)%8192 as size,"
    " case when event_id%11=0 then 'orphan' else 'pending' end as status, event_id*60 as created_at from {events} where event_id%3=0",
    "committed": "select event_id as slice_id from {events} where event_id%2=0",
    "xattr": "select doc_id as inode, 'quality' as name, cast(quality as string) as value from {labels} union all select doc_id, 'toxic', cast(toxic as string) from {labels}",
    "metrics": "select l_linenumber as run, l_returnflag as item, 'quantity' as metric, l_quantity as value from {lineitem}"
    " union all select l_linenumber, l_returnflag, 'price', l_extendedprice from {lineitem}",
    "counters": "select event_type as metric, event_id as seq, sum(cast(round(value*100) as bigint)) over (partition by event_type order by event_id rows between unbounded preceding and current row) as value from {events}",
    "stacks": "select page_id, replace(regexp_replace(url,'^https?://',''),'/',';') as stack, 1+page_id%17 as n from {pages}",
    "accesses": "select event_id, concat('k',cast(user_id%20 as string)) as key, event_id as ts, (event_type<>'error') as hit, 1+(event_id*37)%4096 as size from {events}",
    "reads": "select user_id as inode, event_id as seq, (event_id*4099)%1048576 as off, 1+(event_id*7)%65536 as len from {events}",
    "changes": "select event_id as seq, case when event_id%4=0 then 'DELETE' else 'PUT' end as op,"
    " case event_id%3 when 0 then concat('f:',cast(user_id as string),':',event_type,':',cast(event_id as string)) when 1 then concat('r:',cast(user_id as string)) else concat('x:',event_type) end as key,"
    " case when event_id%5=0 then 'broken' else concat('{{\"inode\":',cast(event_id as string),',\"size\":',cast(user_id as string),'}}') end as value from {events}",
}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One Parquet table of the folder; Python workers of a local session are told where the driver found this package."""
    spark.sparkContext.environment.setdefault("PYTHONPATH", str(Path(__file__).parents[2]))
    return spark.read.parquet(f"{folder}/{name}.parquet")


def view(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A derived view of the folder's tables."""
    used = set(re.findall(r"(?<!\{)\{(\w+)\}", VIEWS[name]))
    return spark.sql(VIEWS[name], **{t: table(spark, folder, t) for t in used})


def with_views(*names: str) -> str:
    """The views as common tables of an SQL text."""
    used = {t for n in names for t in re.findall(r"(?<!\{)\{(\w+)\}", VIEWS[n])}
    return "WITH " + ", ".join(f"{n} AS ({VIEWS[n].format(**{t: t for t in used})})" for n in names)

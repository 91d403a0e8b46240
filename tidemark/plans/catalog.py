"""Queries over the views of a folder, and their SQL twins; ``metadata`` and ``reporting`` register more."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import codec, layout, text
from tidemark.operators import access, activity, extents, fleet, lifecycle, namespace, telemetry, usage
from tidemark.plans.registry import QUERIES, SQL, query
from tidemark.sources.scratch import keep
from tidemark.sources.tables import table, view
from tidemark.streaming import feeds

# Extents

FRAG = """+ reach AS (SELECT *, off + len AS e, max(off + len) OVER (PARTITION BY chunk_id ORDER BY off, off + len ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM slices),
frag AS (SELECT chunk_id, count(*) AS n_slices, CAST(sum(len) AS BIGINT) AS total, CAST(sum(greatest(e - greatest(off, coalesce(r, off)), 0)) AS BIGINT) AS covered FROM reach GROUP BY chunk_id),
analysis AS (SELECT *, round(CASE WHEN total > 0 THEN (total - covered) / CAST(total AS DOUBLE) ELSE 0 END, 9) AS fragmentation FROM frag)"""
LEFT = """left_over AS (SELECT * FROM slices a WHERE NOT EXISTS (SELECT 1 FROM slices b WHERE b.chunk_id = a.chunk_id AND b.slice_id > a.slice_id AND b.off <= a.off AND b.off + b.len >= a.off + a.len))"""
VISIBLE = """edges AS (SELECT chunk_id, off AS p FROM slices UNION SELECT chunk_id, off + len FROM slices),
steps AS (SELECT chunk_id, p, lead(p) OVER (PARTITION BY chunk_id ORDER BY p) AS q FROM edges),
won AS (SELECT s.chunk_id, s.p, s.q, max(x.slice_id) AS slice_id FROM steps s JOIN slices x ON x.chunk_id = s.chunk_id AND x.off <= s.p AND x.off + x.len >= s.q WHERE s.q IS NOT NULL GROUP BY s.chunk_id, s.p, s.q),
flags AS (SELECT *, CASE WHEN lag(q) OVER w = p AND lag(slice_id) OVER w = slice_id THEN 0 ELSE 1 END AS f FROM won WINDOW w AS (PARTITION BY chunk_id ORDER BY p)),
runs AS (SELECT *, sum(f) OVER (PARTITION BY chunk_id ORDER BY p) AS run FROM flags),
seen AS (SELECT chunk_id, min(p) AS lo, max(q) AS hi, slice_id FROM runs GROUP BY chunk_id, run, slice_id)"""


@query("extent_fragmentation", FRAG + " SELECT chunk_id, n_slices, total, covered, fragmentation FROM analysis", ("slices",))
def extent_fragmentation(spark: SparkSession, folder: str) -> DataFrame:
    return extents.fragmentation(view(spark, folder, "slices"))


@query("extent_chunk_analysis", FRAG + " SELECT count(*) AS chunks, CAST(sum(n_slices) AS BIGINT) AS slices, CAST(sum(total) AS BIGINT) AS total, round(max(fragmentation), 9) AS worst FROM analysis", ("slices",))
def extent_chunk_analysis(spark: SparkSession, folder: str) -> DataFrame:
    rows = extents.fragmentation(view(spark, folder, "slices"))
    return rows.agg(F.count("*").alias("chunks"), F.sum("n_slices").alias("slices"), F.sum("total").alias("total"), F.round(F.max("fragmentation"), 9).alias("worst"))


@query("extent_compaction_decision", FRAG + " SELECT chunk_id, n_slices, fragmentation, n_slices >= 3 AND fragmentation >= 0.1 AS should_compact, n_slices >= 40 AND fragmentation >= 0.1 AS sync FROM analysis", ("slices",))
def extent_compaction_decision(spark: SparkSession, folder: str) -> DataFrame:
    return extents.decide(extents.fragmentation(view(spark, folder, "slices")), sync_count=40).select("chunk_id", "n_slices", "fragmentation", "should_compact", "sync")


@query("extent_visible", "+ " + VISIBLE + " SELECT chunk_id, lo, hi, slice_id FROM seen", ("slices",))
def extent_visible(spark: SparkSession, folder: str) -> DataFrame:
    return extents.visible(view(spark, folder, "slices"))


@query("extent_fully_covered", "+ " + LEFT + " SELECT chunk_id, slice_id, off, len FROM left_over", ("slices",))
def extent_fully_covered(spark: SparkSession, folder: str) -> DataFrame:
    return extents.not_covered(view(spark, folder, "slices")).select("chunk_id", "slice_id", "off", "len")


@query("extent_replaced_ids", "+ " + LEFT + " SELECT slice_id FROM slices WHERE slice_id NOT IN (SELECT slice_id FROM left_over)", ("slices",))
def extent_replaced_ids(spark: SparkSession, folder: str) -> DataFrame:
    slices = view(spark, folder, "slices")
    return extents.replaced(slices, extents.not_covered(slices))


@query("extent_light_plan", "+ " + LEFT + """ SELECT a.chunk_id, count(*) AS n_before, CAST(count(b.slice_id) AS BIGINT) AS n_after, CAST(count(*) - count(b.slice_id) AS BIGINT) AS n_removed
FROM slices a LEFT JOIN left_over b ON a.chunk_id = b.chunk_id AND a.slice_id = b.slice_id GROUP BY a.chunk_id""", ("slices",))  # fmt: skip
def extent_light_plan(spark: SparkSession, folder: str) -> DataFrame:
    return extents.light_plan(view(spark, folder, "slices"))


@query("extent_compaction_plan", FRAG + ", " + LEFT + """,
reach2 AS (SELECT *, off + len AS e, max(off + len) OVER (PARTITION BY chunk_id ORDER BY off, off + len ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM left_over),
after AS (SELECT chunk_id, count(*) AS n2, (sum(len) - sum(greatest(e - greatest(off, coalesce(r, off)), 0))) / CAST(sum(len) AS DOUBLE) AS f2 FROM reach2 GROUP BY chunk_id),
both_ AS (SELECT a.chunk_id, a.n_slices AS n1, a.fragmentation AS f1, b.n2, round(b.f2, 9) AS f2, CASE WHEN a.n_slices >= 2 THEN a.n_slices - b.n2 ELSE 0 END AS removed FROM analysis a JOIN after b ON a.chunk_id = b.chunk_id)
SELECT chunk_id, CASE WHEN n1 <= 1 THEN 'skip' WHEN CASE WHEN removed > 0 THEN (f2 >= 0.3 OR n2 >= 30) AND n2 > 1 ELSE f1 >= 0.3 OR n1 >= 30 END THEN 'heavy' WHEN removed > 0 THEN 'light' ELSE 'skip' END AS action,
CAST(CASE WHEN n1 > 1 THEN removed ELSE 0 END AS BIGINT) AS removed FROM both_""", ("slices",))  # fmt: skip
def extent_compaction_plan(spark: SparkSession, folder: str) -> DataFrame:
    return extents.compaction_plan(view(spark, folder, "slices"))


SPLIT = "CAST(unnest(generate_series({off} // {b}, ({off} + {len} - 1) // {b})) AS BIGINT)"


@query("extent_block_split", "+ cut AS (SELECT chunk_id, slice_id, off, len, " + SPLIT.format(off="off", len="len", b=4096) + """ AS block FROM slices WHERE len > 0)
SELECT chunk_id, slice_id, block, greatest(off, block * 4096) - block * 4096 AS block_off, least(off + len, (block + 1) * 4096) - greatest(off, block * 4096) AS block_len FROM cut""", ("slices",))  # fmt: skip
def extent_block_split(spark: SparkSession, folder: str) -> DataFrame:
    return layout.split_blocks(view(spark, folder, "slices"), "off", "len", 4096).select("chunk_id", "slice_id", "block", "block_off", "block_len")


@query("extent_block_fetch_plan", "+ " + VISIBLE + """, rel AS (SELECT v.chunk_id, v.slice_id, v.lo, v.lo - s.off AS a, v.hi - v.lo AS n FROM seen v JOIN slices s ON s.chunk_id = v.chunk_id AND s.slice_id = v.slice_id),
cut AS (SELECT *, """ + SPLIT.format(off="a", len="n", b=1024) + """ AS block FROM rel)
SELECT chunk_id, slice_id, lo, block, greatest(a, block * 1024) - block * 1024 AS block_off, least(a + n, (block + 1) * 1024) - greatest(a, block * 1024) AS block_len FROM cut""", ("slices",))  # fmt: skip
def extent_block_fetch_plan(spark: SparkSession, folder: str) -> DataFrame:
    return extents.fetch_plan(view(spark, folder, "slices"), 1024)


@query("extent_truncate", """SELECT chunk_id, slice_id, CASE WHEN off >= 40000 THEN 'drop' WHEN off + len > 40000 THEN 'shorten' ELSE 'keep' END AS action,
CASE WHEN off >= 40000 THEN 0 ELSE least(off + len, 40000) - off END AS new_len FROM slices""", ("slices",))  # fmt: skip
def extent_truncate(spark: SparkSession, folder: str) -> DataFrame:
    return extents.truncate(view(spark, folder, "slices"), F.lit(40000)).select("chunk_id", "slice_id", "action", "new_len")


@query("extent_truncate_chunks", """+ sizes AS (SELECT inode, size AS old_size, size // 3 AS new_size FROM file_attr)
SELECT inode, new_size // 1048576 AS cut_chunk, new_size % 1048576 AS cut_off, new_size // 1048576 + CASE WHEN new_size % 1048576 = 0 THEN 0 ELSE 1 END AS drop_start, (old_size + 1048575) // 1048576 AS drop_end
FROM sizes WHERE new_size < old_size""", ("file_attr",))  # fmt: skip
def extent_truncate_chunks(spark: SparkSession, folder: str) -> DataFrame:
    sizes = view(spark, folder, "file_attr").select("inode", F.col("size").alias("old_size"), layout.div(F.col("size"), 3).alias("new_size"))
    return extents.truncate_chunks(sizes, 1 << 20).select("inode", "cut_chunk", "cut_off", "drop_start", "drop_end")


@query("chunk_id_codec", "SELECT slice_id, chunk_id * 1000000000 + off // 4096 AS id, chunk_id AS inode, off // 4096 AS number FROM slices", ("slices",))
def chunk_id_codec(spark: SparkSession, folder: str) -> DataFrame:
    ids = view(spark, folder, "slices").select("slice_id", layout.chunk_id(F.col("chunk_id"), layout.div(F.col("off"), 4096)).alias("id"))
    return ids.select("slice_id", "id", layout.chunk_owner(F.col("id")).alias("inode"), layout.chunk_number(F.col("id")).alias("number"))


@query("layout_indexing", "SELECT slice_id, off // 16384 AS chunk_index, off % 16384 AS in_chunk, off // 4096 AS block_index, off % 4096 AS in_block, (len + 4095) // 4096 AS blocks FROM slices", ("slices",))
def layout_indexing(spark: SparkSession, folder: str) -> DataFrame:
    off = F.col("off")
    return view(spark, folder, "slices").select(
        "slice_id", layout.chunk_index(off, 16384).alias("chunk_index"), layout.within_chunk(off, 16384).alias("in_chunk"), layout.block_index(off, 4096).alias("block_index"), layout.within_block(off, 4096).alias("in_block"), layout.blocks_for(F.col("len"), 4096).alias("blocks")
    )


@query("write_coalesce_runs", """+ r AS (SELECT *, off + len AS e, max(off + len) OVER (PARTITION BY chunk_id ORDER BY off, off + len, slice_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM slices),
g AS (SELECT *, sum(CASE WHEN off <= p THEN 0 ELSE 1 END) OVER (PARTITION BY chunk_id ORDER BY off, e, slice_id) AS run FROM r),
m AS (SELECT chunk_id, run, min(off) AS lo, max(e) AS hi, count(*) AS n FROM g GROUP BY chunk_id, run HAVING count(*) >= 2)
SELECT chunk_id, lo, hi, n FROM (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY lo) AS k FROM m) WHERE k = 1""", ("slices",))  # fmt: skip
def write_coalesce_runs(spark: SparkSession, folder: str) -> DataFrame:
    return extents.coalesce_runs(view(spark, folder, "slices"), allow_overlap=True)


# Namespace


@query("ns_lookup", "SELECT d.parent, d.name, d.inode, d.type FROM dentry d UNION ALL SELECT 1, 'missing', NULL, NULL", ("dentry",))
def ns_lookup(spark: SparkSession, folder: str) -> DataFrame:
    dentry = view(spark, folder, "dentry")
    asked = dentry.select("parent", "name").unionByName(spark.sql("select cast(1 as bigint) as parent, 'missing' as name"))
    return namespace.lookup(dentry, asked)


@query("ns_lookup_folded", "SELECT parent, upper(name) AS name, inode FROM dentry WHERE type = 0 UNION ALL SELECT 1, 'nowhere', NULL", ("dentry",))
def ns_lookup_folded(spark: SparkSession, folder: str) -> DataFrame:
    dentry = view(spark, folder, "dentry")
    asked = dentry.where("type = 0").select("parent", F.upper("name").alias("name")).unionByName(spark.sql("select cast(1 as bigint) as parent, 'nowhere' as name"))
    return namespace.lookup_folded(dentry, asked).select("parent", "name", "inode")


@query("ns_readdir", "SELECT parent, name, inode, row_number() OVER (PARTITION BY parent ORDER BY name) AS place FROM dentry", ("dentry",))
def ns_readdir(spark: SparkSession, folder: str) -> DataFrame:
    dentry = view(spark, folder, "dentry")
    return namespace.readdir(dentry, dentry.select("parent")).select("parent", "name", "inode", "place")


@query("ns_batch_stat", """+ d AS (SELECT inode, CAST(4096 AS BIGINT) AS size, 'dir' AS kind FROM dentry WHERE type = 1), f AS (SELECT inode, size, 'file' AS kind FROM file_attr WHERE inode NOT IN (SELECT inode FROM d)),
asked AS (SELECT inode AS place, inode FROM dentry UNION ALL SELECT 0, 7)
SELECT a.place, a.inode, k.size, k.kind FROM asked a LEFT JOIN (SELECT * FROM d UNION ALL SELECT * FROM f) k ON k.inode = a.inode""", ("dentry", "file_attr"))  # fmt: skip
def ns_batch_stat(spark: SparkSession, folder: str) -> DataFrame:
    dentry = view(spark, folder, "dentry")
    dirs = dentry.where("type = 1").select("inode", F.lit(4096).cast("bigint").alias("size"))
    asked = dentry.select(F.col("inode").alias("place"), "inode").unionByName(spark.sql("select cast(0 as bigint) as place, cast(7 as bigint) as inode"))
    return namespace.batch_stat(dirs, view(spark, folder, "file_attr").select("inode", "size"), asked).select("place", "inode", "size", "kind")


@query("ns_child_counts", "SELECT parent, count(*) AS n_children, count(*) FILTER (WHERE type = 1) AS n_dirs FROM dentry GROUP BY parent", ("dentry",))
def ns_child_counts(spark: SparkSession, folder: str) -> DataFrame:
    return namespace.child_counts(view(spark, folder, "dentry"))


@query("ns_empty_dirs", "SELECT inode, name FROM dentry WHERE type = 1 AND inode NOT IN (SELECT parent FROM dentry)", ("dentry",))
def ns_empty_dirs(spark: SparkSession, folder: str) -> DataFrame:
    return namespace.empty_dirs(view(spark, folder, "dentry"))


@query("ns_link_counts", "SELECT inode, count(*) AS n_links, min(parent) AS parent, min(name) AS name FROM dentry GROUP BY inode", ("dentry",))
def ns_link_counts(spark: SparkSession, folder: str) -> DataFrame:
    return namespace.link_counts(view(spark, folder, "dentry"))


@query("ns_dangling", "SELECT d.inode, d.parent, d.name FROM dentry d WHERE d.inode NOT IN (SELECT inode FROM file_attr)", ("dentry", "file_attr"))
def ns_dangling(spark: SparkSession, folder: str) -> DataFrame:
    return namespace.dangling(view(spark, folder, "dentry"), view(spark, folder, "file_attr")).select("inode", "parent", "name")


PATHS = """p1 AS (SELECT inode, '/' || name AS path FROM dentry WHERE parent = 1), p2 AS (SELECT d.inode, p.path || '/' || d.name AS path FROM dentry d JOIN p1 p ON d.parent = p.inode),
p3 AS (SELECT d.inode, p.path || '/' || d.name AS path FROM dentry d JOIN p2 p ON d.parent = p.inode), p4 AS (SELECT d.inode, p.path || '/' || d.name AS path FROM dentry d JOIN p3 p ON d.parent = p.inode),
paths AS (SELECT * FROM p1 UNION ALL SELECT * FROM p2 UNION ALL SELECT * FROM p3 UNION ALL SELECT * FROM p4)"""


@query("ns_paths_up", "+ " + PATHS + " SELECT inode, path FROM paths", ("dentry",))
def ns_paths_up(spark: SparkSession, folder: str) -> DataFrame:
    dentry = view(spark, folder, "dentry")
    return namespace.paths_up(dentry)


@query("ns_lookup_path", "+ " + PATHS + " SELECT p.path, p.inode, d.type FROM paths p JOIN dentry d ON d.inode = p.inode UNION ALL SELECT '/no/where', NULL, NULL UNION ALL SELECT '/', 1, 1", ("dentry",))
def ns_lookup_path(spark: SparkSession, folder: str) -> DataFrame:
    dentry = view(spark, folder, "dentry")
    asked = keep(namespace.paths_up(dentry).select("path"), "paths").unionByName(spark.sql("select '/no/where' as path union all select '/'"))
    return namespace.walk(dentry, asked)


@query("ns_prefix_match", "+ " + PATHS + " SELECT inode, path FROM paths WHERE path = '/ASIA' OR starts_with(path, '/ASIA/')", ("dentry",))
def ns_prefix_match(spark: SparkSession, folder: str) -> DataFrame:
    dentry = view(spark, folder, "dentry")
    return namespace.paths_up(dentry).where(text.under(F.col("path"), F.lit("/ASIA")))


@query("ns_path_normalise", "SELECT page_id, '/' || array_to_string(list_filter(string_split(stack, ';'), lambda p: p <> ''), '/') AS path FROM stacks", ("stacks",))
def ns_path_normalise(spark: SparkSession, folder: str) -> DataFrame:
    stacks = view(spark, folder, "stacks")
    crooked = F.concat(F.lit("/../x/./../"), F.replace("stack", F.lit(";"), F.lit("//")), F.lit("/./y/.."))
    return stacks.select("page_id", text.normal_path(crooked).alias("path"))


@query("ns_listing_with_acl", """+ acls AS (SELECT 1000000000 + inode AS inode FROM xattr WHERE name = 'toxic' AND value <> '')
SELECT d.parent, d.name, d.inode, a.size, a.mode, d.inode IN (SELECT inode FROM acls) AS has_acl FROM dentry d JOIN file_attr a ON a.inode = d.inode""", ("dentry", "file_attr", "xattr"))  # fmt: skip
def ns_listing_with_acl(spark: SparkSession, folder: str) -> DataFrame:
    acls = view(spark, folder, "xattr").where("name = 'toxic'").select((F.col("inode") + 1000000000).alias("inode"), "value")
    return namespace.listing(view(spark, folder, "dentry"), view(spark, folder, "file_attr"), acls).select("parent", "name", "inode", "size", "mode", "has_acl")


@query("ns_trash_listing", """+ o AS (SELECT 1000000000 + inode AS inode, '/was/' || value AS path FROM xattr WHERE name = 'quality')
SELECT a.inode, a.size, coalesce(o.path, 'inode:' || CAST(a.inode AS VARCHAR)) AS path, CAST(a.inode AS VARCHAR) AS order_key FROM file_attr a LEFT JOIN o ON o.inode = a.inode WHERE a.deleted""", ("file_attr", "xattr"))  # fmt: skip
def ns_trash_listing(spark: SparkSession, folder: str) -> DataFrame:
    origins = view(spark, folder, "xattr").where("name = 'quality'").select((F.col("inode") + 1000000000).alias("inode"), F.concat(F.lit('{"path":"/was/'), "value", F.lit('"}')).alias("value"))
    return namespace.trash(view(spark, folder, "file_attr"), origins)


@query("ns_rename_allowed", """+ m AS (SELECT a.inode AS src_inode, a.type AS src_type, b.inode AS dst_inode, b.type AS dst_type FROM dentry a LEFT JOIN dentry b ON b.inode = a.inode + 1)
SELECT src_inode, dst_inode, CASE WHEN dst_inode IS NULL THEN 'ok' WHEN src_inode = dst_inode THEN 'same' WHEN src_type = 1 AND dst_type <> 1 THEN 'not a directory' WHEN src_type <> 1 AND dst_type = 1 THEN 'is a directory'
WHEN dst_type = 1 AND dst_inode IN (SELECT parent FROM dentry) THEN 'not empty' ELSE 'ok' END AS verdict FROM m""", ("dentry",))  # fmt: skip
def ns_rename_allowed(spark: SparkSession, folder: str) -> DataFrame:
    dentry = view(spark, folder, "dentry")
    a = dentry.select(F.col("inode").alias("src_inode"), F.col("type").alias("src_type"))
    b = dentry.select((F.col("inode") - 1).alias("src_inode"), F.col("inode").alias("dst_inode"), F.col("type").alias("dst_type"))
    return namespace.rename_allowed(a.join(b, "src_inode", "left"), dentry).select("src_inode", "dst_inode", "verdict")


@query("ns_name_validity", """WITH n AS (SELECT doc_id AS id, text AS name FROM documents UNION ALL SELECT -page_id, CASE page_id % 4 WHEN 0 THEN '.' WHEN 1 THEN '..' WHEN 2 THEN repeat('é', CAST(page_id % 300 AS INTEGER)) ELSE url END FROM pages)
SELECT id, name, strlen(name) BETWEEN 1 AND 255 AND NOT contains(name, '/') AS valid FROM n""")
def ns_name_validity(spark: SparkSession, folder: str) -> DataFrame:
    p = F.col("page_id") % 4
    made = F.when(p == 0, ".").when(p == 1, "..").when(p == 2, F.expr("repeat('é', cast(page_id % 300 as int))")).otherwise(F.col("url"))
    names = table(spark, folder, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("name")).unionByName(table(spark, folder, "pages").select((-F.col("page_id")).alias("id"), made.alias("name")))
    return names.select("id", "name", text.valid_name(F.col("name")).alias("valid"))


# Usage

USED = "+ live AS (SELECT size FROM file_attr WHERE NOT deleted AND nlink > 0), dirs AS (SELECT CAST(4096 AS BIGINT) AS size FROM dentry WHERE type = 1)"


@query("usage_statfs_sql", USED + " SELECT CAST((SELECT sum(size) FROM live) AS BIGINT) AS used_space, (SELECT count(*) FROM live) + (SELECT count(*) FROM dirs) AS used_inodes", ("file_attr", "dentry"))
def usage_statfs_sql(spark: SparkSession, folder: str) -> DataFrame:
    return usage.usage(view(spark, folder, "file_attr"), _dirs(spark, folder))


@query("usage_statfs_all_nodes", USED + " SELECT CAST((SELECT sum(size) FROM live) + (SELECT sum(size) FROM dirs) AS BIGINT) AS used_space, (SELECT count(*) FROM live) + (SELECT count(*) FROM dirs) AS used_inodes", ("file_attr", "dentry"))
def usage_statfs_all_nodes(spark: SparkSession, folder: str) -> DataFrame:
    return usage.usage(view(spark, folder, "file_attr"), _dirs(spark, folder), variant="all_nodes")


def _dirs(spark: SparkSession, folder: str) -> DataFrame:
    return view(spark, folder, "dentry").where("type = 1").select(F.lit(4096).cast("bigint").alias("size"))


@query("usage_capacity_growth", """WITH u AS (SELECT event_id AS id, event_id * 2000000000000 AS used_space, event_id * 9000 AS used_inodes FROM events),
k AS (SELECT *, CAST(CASE WHEN used_space * 10.0 > 1125899906842624.0 * 8 THEN ceil(log2(used_space * 10.0 / (1125899906842624.0 * 8))) ELSE 0 END AS INTEGER) AS k, CAST(CASE WHEN used_inodes > 41943040 THEN ceil(log2(used_inodes / 41943040.0)) ELSE 0 END AS INTEGER) AS j FROM u)
SELECT id, 1125899906842624 << k AS total_space, (1125899906842624 << k) - used_space AS available_space, CAST(10485760 AS BIGINT) << j AS available_inodes FROM k""")  # fmt: skip
def usage_capacity_growth(spark: SparkSession, folder: str) -> DataFrame:
    used = table(spark, folder, "events").select(F.col("event_id").alias("id"), (F.col("event_id").cast("decimal(38,0)") * F.lit(2_000_000_000_000)).alias("used_space"), (F.col("event_id") * 9000).alias("used_inodes"))
    return usage.capacity(used).select("id", "total_space", "available_space", "available_inodes")


@query("usage_size_after_writes", "SELECT a.inode, greatest(a.size, coalesce(w.e, a.size)) AS size FROM file_attr a LEFT JOIN (SELECT 1000000000 + inode AS inode, max(off + len) * 1000 AS e FROM reads GROUP BY 1) w ON w.inode = a.inode", ("file_attr", "reads"))
def usage_size_after_writes(spark: SparkSession, folder: str) -> DataFrame:
    writes = view(spark, folder, "reads").select((F.col("inode") + 1000000000).alias("inode"), (F.col("off") * 1000).alias("off"), (F.col("len") * 1000).alias("len"))
    return usage.size_after(writes, view(spark, folder, "file_attr").select("inode", "size"))


# Lifecycle


@query("gc_delayed_ready", "SELECT id, slice_id, size, 'meta_deleted' AS next_status FROM uncommitted WHERE status IN ('pending', 'meta_deleted') AND created_at <= 300000", ("uncommitted",))
def gc_delayed_ready(spark: SparkSession, folder: str) -> DataFrame:
    return lifecycle.ready(view(spark, folder, "uncommitted"), 300000).select("id", "slice_id", "size", "next_status")


ORPHANS = """lost AS (SELECT slice_id, size FROM uncommitted u WHERE status = 'pending' AND created_at < 400000 AND slice_id NOT IN (SELECT slice_id FROM committed) UNION ALL SELECT slice_id, size FROM uncommitted WHERE status = 'orphan')"""


@query("gc_orphans", "+ " + ORPHANS + " SELECT slice_id, size FROM lost", ("uncommitted", "committed"))
def gc_orphans(spark: SparkSession, folder: str) -> DataFrame:
    return lifecycle.orphans(view(spark, folder, "uncommitted"), view(spark, folder, "committed"), 400000).select("slice_id", "size")


@query("gc_committed_leftovers", "SELECT id, slice_id FROM uncommitted WHERE status = 'pending' AND created_at < 400000 AND slice_id IN (SELECT slice_id FROM committed)", ("uncommitted", "committed"))
def gc_committed_leftovers(spark: SparkSession, folder: str) -> DataFrame:
    return lifecycle.leftovers(view(spark, folder, "uncommitted"), view(spark, folder, "committed"), 400000).select("id", "slice_id")


@query("gc_confirmed", "SELECT id, status FROM uncommitted WHERE slice_id NOT IN (SELECT slice_id FROM committed)", ("uncommitted", "committed"))
def gc_confirmed(spark: SparkSession, folder: str) -> DataFrame:
    return lifecycle.confirmed(view(spark, folder, "uncommitted"), view(spark, folder, "committed").withColumnRenamed("slice_id", "id")).select("id", "status")


@query("gc_plan", "+ " + ORPHANS + """ SELECT slice_id, 'delayed' AS cause, (size + 1023) // 1024 AS n_blocks FROM uncommitted WHERE status IN ('pending', 'meta_deleted') AND created_at <= 100000
UNION ALL SELECT slice_id, 'orphan', (size + 1023) // 1024 FROM lost""", ("uncommitted", "committed"))  # fmt: skip
def gc_plan(spark: SparkSession, folder: str) -> DataFrame:
    pending = view(spark, folder, "uncommitted")
    return lifecycle.gc_plan(pending, pending, view(spark, folder, "committed"), delay_cutoff=100000, orphan_cutoff=400000, block=1024)


SESSIONS = "s AS (SELECT user_id AS session, max(event_id * 100) + 300000 AS expire FROM events GROUP BY user_id)"


def _sessions(spark: SparkSession, folder: str) -> DataFrame:
    return lifecycle.expiry(table(spark, folder, "events").select(F.col("user_id").alias("session"), (F.col("event_id") * 100).alias("at")))


@query("session_expired", "WITH " + SESSIONS + " SELECT session, expire FROM s WHERE expire < 1290000")
def session_expired(spark: SparkSession, folder: str) -> DataFrame:
    return lifecycle.expired(_sessions(spark, folder), 1290000)


@query("session_locks", "WITH " + SESSIONS + " SELECT event_id, user_id AS session FROM events WHERE user_id NOT IN (SELECT session FROM s WHERE expire < 1290000)")
def session_locks(spark: SparkSession, folder: str) -> DataFrame:
    return lifecycle.surviving_locks(table(spark, folder, "events").select("event_id", F.col("user_id").alias("session")), _sessions(spark, folder), 1290000)


@query("named_lock_held", "WITH " + SESSIONS + " SELECT session, expire > 1290000 AS held FROM s")
def named_lock_held(spark: SparkSession, folder: str) -> DataFrame:
    return lifecycle.held(_sessions(spark, folder), 1290000).select("session", "held")


@query("cache_lru_evict", """+ f AS (SELECT event_id AS path, size, ts // 7 AS atime FROM accesses), r AS (SELECT *, coalesce(sum(size) OVER (ORDER BY atime, path ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM f)
SELECT path, size, atime, CAST(b AS BIGINT) AS freed_before FROM r WHERE b < 1000000""", ("accesses",))  # fmt: skip
def cache_lru_evict(spark: SparkSession, folder: str) -> DataFrame:
    files = view(spark, folder, "accesses").select(F.col("event_id").alias("path"), "size", layout.div(F.col("ts"), 7).alias("atime"))
    return lifecycle.lru_evictions(files, 1_000_000)


# Access


@query("lock_conflicts", """SELECT q.inode, q.seq, h.seq AS held_seq, h.owner AS held_owner FROM locks q JOIN locks h ON q.inode = h.inode AND q.owner <> h.owner AND q.end_off > h.start_off AND q.start_off < h.end_off
WHERE q.lock_type < 2 AND h.lock_type < 2 AND (q.lock_type = 1 OR h.lock_type = 1)""", ("locks",))  # fmt: skip
def lock_conflicts(spark: SparkSession, folder: str) -> DataFrame:
    locks = view(spark, folder, "locks")
    return access.conflicts(locks, locks).select("inode", "seq", "held_seq", "held_owner")


@query("lock_blocking_first", """+ c AS (SELECT q.inode, q.seq, h.seq AS held_seq, h.owner AS held_owner, h.start_off, h.end_off, h.lock_type AS held_type, row_number() OVER (PARTITION BY q.inode, q.seq ORDER BY h.seq) AS k
FROM locks q JOIN locks h ON q.inode = h.inode AND q.owner <> h.owner AND q.end_off > h.start_off AND q.start_off < h.end_off WHERE q.lock_type < 2 AND h.lock_type < 2 AND (q.lock_type = 1 OR h.lock_type = 1))
SELECT inode, seq, held_seq, held_owner, start_off, end_off, held_type FROM c WHERE k = 1""", ("locks",))  # fmt: skip
def lock_blocking_first(spark: SparkSession, folder: str) -> DataFrame:
    locks = view(spark, folder, "locks")
    return access.blocking(locks, locks)


def _overlay_sql(rows: str, keys: str, value: str) -> str:
    """Newest-wins overlay of ``rows`` (``keys``, ``a``, ``b``, ``ord``, ``v``) as SQL, ending in ``seen``."""
    on = " AND ".join(f"x.{k} = s.{k}" for k in keys.split(", "))
    s_keys = ", ".join(f"s.{k}" for k in keys.split(", "))
    return f"""src AS ({rows}), edges AS (SELECT {keys}, a AS p FROM src UNION SELECT {keys}, b FROM src), steps AS (SELECT *, lead(p) OVER (PARTITION BY {keys} ORDER BY p) AS q FROM edges),
won AS (SELECT {s_keys}, s.p, s.q, {value} AS v FROM steps s JOIN src x ON {on} AND x.a <= s.p AND x.b >= s.q WHERE s.q IS NOT NULL GROUP BY {s_keys}, s.p, s.q)"""


@query("lock_set_update", "+ " + _overlay_sql("SELECT inode, owner, start_off AS a, end_off AS b, seq AS ord, lock_type AS v FROM locks", "inode, owner", "arg_max(x.v, x.ord)") + """,
f AS (SELECT *, CASE WHEN lag(q) OVER w = p AND lag(v) OVER w = v THEN 0 ELSE 1 END AS f FROM won WHERE v <> 2 WINDOW w AS (PARTITION BY inode, owner ORDER BY p)),
r AS (SELECT *, sum(f) OVER (PARTITION BY inode, owner ORDER BY p) AS run FROM f) SELECT inode, owner, min(p) AS lo, max(q) AS hi, v AS lock_type FROM r GROUP BY inode, owner, run, v""", ("locks",))  # fmt: skip
def lock_set_update(spark: SparkSession, folder: str) -> DataFrame:
    return access.locked_ranges(view(spark, folder, "locks"))


@query("late_write_allowed", """+ w AS (SELECT chunk_id, slice_id AS seq, (slice_id * 7919) % 1009 AS u, off, off + len AS e FROM slices), edges AS (SELECT chunk_id, off AS p FROM w WHERE u <> 0 UNION SELECT chunk_id, e FROM w WHERE u <> 0),
steps AS (SELECT *, lead(p) OVER (PARTITION BY chunk_id ORDER BY p) AS q FROM edges), hit AS (SELECT s.chunk_id, s.p, s.q, w.seq, w.u, max(w.u) OVER (PARTITION BY s.chunk_id, s.p ORDER BY w.seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS past
FROM steps s JOIN w ON w.chunk_id = s.chunk_id AND w.u <> 0 AND w.off <= s.p AND w.e >= s.q), ok AS (SELECT chunk_id, seq, p, q FROM hit WHERE past IS NULL OR past <= u UNION ALL SELECT chunk_id, seq, off, e FROM w WHERE u = 0),
f AS (SELECT *, CASE WHEN lag(q) OVER (PARTITION BY chunk_id, seq ORDER BY p) = p THEN 0 ELSE 1 END AS f FROM ok), r AS (SELECT *, sum(f) OVER (PARTITION BY chunk_id, seq ORDER BY p) AS run FROM f)
SELECT chunk_id, seq, min(p) AS lo, max(q) AS hi FROM r GROUP BY chunk_id, seq, run""", ("slices",))  # fmt: skip
def late_write_allowed(spark: SparkSession, folder: str) -> DataFrame:
    return access.allowed_writes(_writes(spark, folder))


def _writes(spark: SparkSession, folder: str) -> DataFrame:
    return view(spark, folder, "slices").select("chunk_id", F.col("slice_id").alias("seq"), ((F.col("slice_id") * 7919) % 1009).alias("unique"), "off", "len")


@query("access_mode_check", """SELECT inode, u.uid AS asker, CASE WHEN u.uid = 0 THEN true WHEN u.uid = a.uid THEN (mode & 256) <> 0 WHEN a.gid = u.uid % 3 THEN (mode & 32) <> 0 ELSE (mode & 4) <> 0 END AS may_read,
CASE WHEN u.uid = 0 THEN true WHEN u.uid = a.uid THEN (mode & 128) <> 0 WHEN a.gid = u.uid % 3 THEN (mode & 16) <> 0 ELSE (mode & 2) <> 0 END AS may_write FROM file_attr a JOIN (SELECT CAST(n_nationkey AS INTEGER) AS uid FROM nation WHERE n_nationkey < 5) u ON true""", ("file_attr",))  # fmt: skip
def access_mode_check(spark: SparkSession, folder: str) -> DataFrame:
    asked = view(spark, folder, "file_attr").withColumn("asker", F.explode(F.sequence(F.lit(0), F.lit(4))))
    may = lambda right: access.allowed(right, F.col("asker"), F.array(F.col("asker") % 3), F.col("mode"), F.col("uid"), F.col("gid"))
    return asked.select("inode", "asker", may("read").alias("may_read"), may("write").alias("may_write"))


MODES = "WITH m AS (SELECT event_id AS id, CAST((event_id * 4096 + event_id * 7) % 65536 AS INTEGER) AS mode FROM events)"


@query("mode_to_type", MODES + """ SELECT id, mode, CASE mode & 61440 WHEN 32768 THEN 'file' WHEN 16384 THEN 'dir' WHEN 40960 THEN 'symlink' WHEN 4096 THEN 'fifo' WHEN 49152 THEN 'socket' WHEN 8192 THEN 'char' WHEN 24576 THEN 'block' END AS type,
(mode & 16384) <> 0 AS loose_dir, (mode & 32768) <> 0 AS loose_file, (mode & 61440) | 420 AS changed, mode & 62463 AS written FROM m""")  # fmt: skip
def mode_to_type(spark: SparkSession, folder: str) -> DataFrame:
    m = table(spark, folder, "events").select(F.col("event_id").alias("id"), ((F.col("event_id") * 4096 + F.col("event_id") * 7) % 65536).cast("int").alias("mode"))
    mode = F.col("mode")
    return m.select("id", "mode", text.file_type(mode).alias("type"), text.loose_is_directory(mode).alias("loose_dir"), text.loose_is_file(mode).alias("loose_file"), text.chmod(mode, F.lit(0o644)).alias("changed"), text.without_set_ids(mode).alias("written"))


ACLS = """SELECT event_id // 4 AS acl, CAST(event_id % 4 AS INTEGER) AS place, CASE WHEN event_id % 97 = 0 THEN 'other' WHEN event_id // 4 % 5 = 0 THEN 'default' ELSE 'access' END AS scope,
CASE event_id % 4 WHEN 0 THEN 'user_obj' WHEN 1 THEN 'group_obj' WHEN 2 THEN CASE WHEN event_id % 3 = 0 THEN 'mask' ELSE 'other' END ELSE 'user' END AS tag,
CASE WHEN event_id % 4 = 3 AND event_id % 7 > 0 THEN CAST(event_id AS INTEGER) END AS id, CASE WHEN event_id % 11 = 0 THEN 'rwxx' ELSE 'r-x' END AS perm FROM {events}"""


@query("acl_validate", "WITH a AS (" + ACLS.format(events="events") + """), e AS (SELECT *, CASE WHEN scope NOT IN ('access', 'default') THEN 'scope' WHEN perm <> 'r-x' THEN 'perm' WHEN tag = 'user' AND id IS NULL THEN 'id missing' WHEN tag <> 'user' AND id IS NOT NULL THEN 'id given' END AS e FROM a)
SELECT acl, coalesce(arg_min(e, place) FILTER (WHERE e IS NOT NULL), CASE WHEN max(CAST(scope = 'access' AS INTEGER)) = 1 AND NOT (max(CAST(scope = 'access' AND tag = 'user_obj' AS INTEGER)) = 1 AND max(CAST(scope = 'access' AND tag = 'group_obj' AS INTEGER)) = 1 AND max(CAST(scope = 'access' AND tag = 'other' AS INTEGER)) = 1) THEN 'base entries' END) AS error FROM e GROUP BY acl""")  # fmt: skip
def acl_validate(spark: SparkSession, folder: str) -> DataFrame:
    return access.acl_errors(spark.sql(ACLS.replace("//", "div"), events=table(spark, folder, "events")))


# Telemetry

SPREAD = "s AS (SELECT item, metric, count(*) AS n, round(avg(value), 6) AS mean, round(coalesce(stddev_samp(value), 0), 6) AS stdev, min(value) AS minimum, max(value) AS maximum, round(coalesce(abs(stddev_samp(value) / avg(value) * 100), 0), 6) AS cv_pct FROM {src} GROUP BY item, metric)"


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


@query("tele_stability", "+ " + SPREAD.format(src="metrics") + " SELECT * FROM s WHERE n >= 2", ("metrics",))
def tele_stability(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(telemetry.stability(view(spark, folder, "metrics"), ["item", "metric"]), "mean", "stdev", "cv_pct")


@query("tele_top_unstable", "+ t AS (SELECT item || CAST(run AS VARCHAR) AS item, metric, value FROM metrics), " + SPREAD.format(src="t") + " SELECT item, metric, cv_pct FROM s WHERE cv_pct >= 10 ORDER BY cv_pct DESC, item, metric LIMIT 25", ("metrics",))
def tele_top_unstable(spark: SparkSession, folder: str) -> DataFrame:
    rows = view(spark, folder, "metrics").withColumn("item", F.concat("item", F.col("run").cast("string")))
    return telemetry.unstable(_rounded(telemetry.stability(rows, ["item", "metric"]), "cv_pct"), 10).select("item", "metric", "cv_pct")


def _run(spark: SparkSession, folder: str, run: int) -> DataFrame:
    """One run's metrics, with a gap row for every item."""
    rows = view(spark, folder, "metrics").where(F.col("run") == run)
    nums = rows.groupBy(F.lit("stats").alias("kind"), "item", "metric").agg(F.round(F.avg("value"), 6).alias("num")).withColumn("txt", F.lit(None).cast("string")).withColumn("unit", F.lit("x"))
    gaps = rows.select(F.lit("gap").alias("kind"), "item", F.lit("missing").alias("metric"), F.lit(None).cast("double").alias("num"), F.when((F.col("item") == "A") | (F.lit(run) == 1), "none").otherwise("lines").alias("txt"), F.lit("").alias("unit")).distinct()
    return nums.unionByName(gaps.where((F.col("item") != "R") | (F.lit(run) == 1)))


@query("tele_run_compare", """+ a AS (SELECT item, metric, round(avg(value), 6) AS num FROM metrics WHERE run = 1 GROUP BY ALL), b AS (SELECT item, metric, round(avg(value), 6) AS num FROM metrics WHERE run = 2 GROUP BY ALL)
SELECT 'stats' AS kind, a.item, a.metric, a.num AS b_num, b.num AS c_num, CAST(NULL AS VARCHAR) AS b_txt, CAST(NULL AS VARCHAR) AS c_txt, 'x' AS unit, CASE WHEN b.num >= a.num THEN '+' ELSE '' END || printf('%.1f', (b.num - a.num) / a.num * 100) AS delta_pct FROM a JOIN b USING (item, metric)
UNION ALL SELECT 'gap', item, 'missing', NULL, NULL, 'none', CASE WHEN item = 'R' THEN 'not_reported' ELSE 'lines' END, '', '' FROM (SELECT DISTINCT item FROM metrics WHERE item <> 'A')""", ("metrics",))  # fmt: skip
def tele_run_compare(spark: SparkSession, folder: str) -> DataFrame:
    return telemetry.compare(_run(spark, folder, 1), _run(spark, folder, 2)).select("kind", "item", "metric", "b_num", "c_num", "b_txt", "c_txt", "unit", "delta_pct")


@query("tele_weighted_mean", "SELECT l_returnflag AS item, count(*) AS n, round(sum(l_extendedprice * l_quantity) / sum(l_quantity), 6) AS mean FROM lineitem GROUP BY 1")
def tele_weighted_mean(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(telemetry.weighted_mean(table(spark, folder, "lineitem").withColumnRenamed("l_returnflag", "item"), ["item"], "l_extendedprice", "l_quantity"), "mean")


@query("tele_op_totals", """SELECT l_returnflag AS item, l_linestatus AS op, round(sum(l_quantity), 3) AS io_bytes, round(sum(l_extendedprice), 3) AS bw_bytes, round(sum(l_tax * l_quantity) / sum(l_quantity), 9) AS mean_ns, max(l_discount) AS p95_ns, max(l_partkey) AS runtime_ms FROM lineitem GROUP BY 1, 2""")
def tele_op_totals(spark: SparkSession, folder: str) -> DataFrame:
    jobs = table(spark, folder, "lineitem").select(
        F.col("l_returnflag").alias("item"), F.col("l_linestatus").alias("op"), F.col("l_quantity").alias("io_bytes"), F.lit(1.0).alias("total_ios"), F.col("l_extendedprice").alias("bw_bytes"), F.lit(0.0).alias("iops"),
        F.col("l_quantity").alias("n"), F.col("l_tax").alias("mean"), F.col("l_discount").alias("p95"), F.lit(0.0).alias("p99"), F.lit(0.0).alias("p999"), F.col("l_partkey").alias("runtime"),
    )
    t = telemetry.op_totals(jobs)
    return t.select("item", "op", F.round("io_bytes", 3).alias("io_bytes"), F.round("bw_bytes", 3).alias("bw_bytes"), F.round("mean_ns", 9).alias("mean_ns"), "p95_ns", "runtime_ms")


NAMED = "SELECT concat('u', cast(user_id % 10 as string)) AS item, event_type AS name, sum(round(value * 100)) AS value FROM {events} WHERE user_id % 10 > 0 OR event_type <> 'error' GROUP BY 1, 2"
EVENT_RATIOS = [("purchase_per_view", "purchase", "view", 1.0), ("click_per_error_k", "click", "error", 1000.0), ("none_such", "nothing", "view", 1.0)]
CRITICAL = ["click", "error", "purchase", "nothing"]


def _named(spark: SparkSession, folder: str) -> DataFrame:
    return spark.sql(NAMED, events=table(spark, folder, "events"))


@query("tele_ratios", "WITH c AS (" + NAMED.format(events="events") + """) SELECT a.item, 'purchase_per_view' AS metric, round(a.value / b.value, 6) AS num FROM c a JOIN c b ON a.item = b.item AND a.name = 'purchase' AND b.name = 'view' AND b.value > 0
UNION ALL SELECT a.item, 'click_per_error_k', round(a.value / (b.value / 1000), 6) FROM c a JOIN c b ON a.item = b.item AND a.name = 'click' AND b.name = 'error' AND b.value > 0""")  # fmt: skip
def tele_ratios(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(telemetry.ratios(_named(spark, folder), EVENT_RATIOS), "num")


@query("tele_missing", "WITH c AS (" + NAMED.format(events="events") + "), w AS (SELECT * FROM (VALUES (1, 'click'), (2, 'error'), (3, 'purchase'), (4, 'nothing')) AS t(k, name)) SELECT i.item, string_agg(w.name, ',' ORDER BY w.k) AS missing FROM (SELECT DISTINCT item FROM c) i JOIN w ON true WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.item = i.item AND c.name = w.name) GROUP BY i.item")
def tele_missing(spark: SparkSession, folder: str) -> DataFrame:
    return telemetry.missing(_named(spark, folder), CRITICAL)


FRAMES = "f AS (SELECT {frame} AS raw, n FROM stacks), g AS (SELECT trim(regexp_replace(regexp_replace(raw, '\\([^(]*$', ''), '\\+[^+]*$', '')) AS frame, n FROM f)"


@query("tele_hotspots", "+ " + FRAMES.format(frame="unnest(string_split(stack, ';'))") + " SELECT frame, CAST(sum(n) AS BIGINT) AS samples FROM g WHERE frame <> '' AND NOT starts_with(frame, '[') GROUP BY frame ORDER BY samples DESC, frame LIMIT 15", ("stacks",))
def tele_hotspots(spark: SparkSession, folder: str) -> DataFrame:
    return telemetry.hot_frames(view(spark, folder, "stacks"))


@query("tele_leaf_hotspots", "+ " + FRAMES.format(frame="string_split(stack, ';')[-1]") + " SELECT frame, CAST(sum(n) AS BIGINT) AS samples FROM g WHERE frame <> '' AND NOT starts_with(frame, '[') GROUP BY frame ORDER BY samples DESC, frame LIMIT 10", ("stacks",))
def tele_leaf_hotspots(spark: SparkSession, folder: str) -> DataFrame:
    return telemetry.hot_frames(view(spark, folder, "stacks"), 10, leaves=True)


@query("tele_keyword_share", "SELECT CAST(sum(n) AS BIGINT) AS samples, CAST(sum(CASE WHEN contains(stack, 'spam') OR contains(stack, '.net') THEN n ELSE 0 END) AS BIGINT) AS matched, round(sum(CASE WHEN contains(stack, 'spam') OR contains(stack, '.net') THEN n ELSE 0 END) * 100.0 / sum(n), 6) AS share FROM stacks", ("stacks",))
def tele_keyword_share(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(telemetry.keyword_share(view(spark, folder, "stacks"), ["spam", ".net"]), "share")


@query("tele_off_cpu", "SELECT list_aggregate(list_reverse(string_split(stack, ';')), 'string_agg', ';') AS stack, count(*) AS n FROM stacks GROUP BY 1 ORDER BY n DESC, 1 LIMIT 3000", ("stacks",))
def tele_off_cpu(spark: SparkSession, folder: str) -> DataFrame:
    return telemetry.off_cpu(view(spark, folder, "stacks"))


@query("tele_counter_rates", """+ d AS (SELECT metric, seq, CASE WHEN lag(value) OVER w IS NOT NULL THEN greatest(value - lag(value) OVER w, 0) END AS delta, seq - lag(seq) OVER w AS dt FROM counters WINDOW w AS (PARTITION BY metric ORDER BY seq))
SELECT metric, seq, CAST(delta AS BIGINT) AS delta, round(delta / CAST(dt AS DOUBLE), 6) AS rate FROM d WHERE delta IS NOT NULL""", ("counters",))  # fmt: skip
def tele_counter_rates(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(telemetry.rates(view(spark, folder, "counters")), "rate").select("metric", "seq", "delta", "rate")


@query("tele_formats", """WITH v AS (SELECT event_id, value + 0.0123 AS v FROM events) SELECT event_id, CASE WHEN v * 1e6 / 1048576 >= 1024 THEN printf('%.2f GiB/s', v * 1e6 / 1048576 / 1024) ELSE printf('%.1f MiB/s', v * 1e6 / 1048576) END AS bandwidth,
CASE WHEN v >= 1000 THEN printf('%.1fK', v / 1000) ELSE printf('%.1f', v) END AS rate FROM v""")  # fmt: skip
def tele_formats(spark: SparkSession, folder: str) -> DataFrame:
    v = F.col("value") + 0.0123  # no halves, which the two engines' formatters round differently
    return table(spark, folder, "events").select("event_id", text.readable_bandwidth(v * 1e6).alias("bandwidth"), text.readable_rate(v).alias("rate"))


# Activity


@query("cache_window_counts", """+ b AS (SELECT key, ts // 5 AS bucket, count(*) AS c FROM accesses GROUP BY ALL) SELECT key, bucket, CAST(sum(c) OVER (PARTITION BY key ORDER BY bucket RANGE BETWEEN 11 PRECEDING AND CURRENT ROW) AS BIGINT) AS n FROM b""", ("accesses",))
def cache_window_counts(spark: SparkSession, folder: str) -> DataFrame:
    return activity.window_counts(view(spark, folder, "accesses"), 5, 12)


FREQ = "f AS (SELECT key, count(*) FILTER (WHERE ts BETWEEN 5941 AND 6000) / 60.0 AS s, count(*) FILTER (WHERE ts // 5 BETWEEN 1129 AND 1200 AND ts <= 6000) / 360.0 AS m FROM accesses GROUP BY key)"


@query("cache_window_frequency", "+ " + FREQ + " SELECT key, round(CAST(s AS DOUBLE), 9) AS short_freq, round(CAST(m AS DOUBLE), 9) AS medium_freq, round(CAST(s AS DOUBLE) * 0.7 + CAST(m AS DOUBLE) * 0.3, 9) AS weighted FROM f", ("accesses",))
def cache_window_frequency(spark: SparkSession, folder: str) -> DataFrame:
    f = activity.frequencies(view(spark, folder, "accesses"), 6000)
    return f.select("key", *[F.round(c, 9).alias(c) for c in ("short_freq", "medium_freq", "weighted")])


@query("cache_promotion", """+ h AS (SELECT key, CAST(sum(CAST(hit AS INTEGER)) * 10000 // count(*) AS BIGINT) / 10000.0 AS rate, count(*) AS n FROM accesses GROUP BY key), t AS (SELECT key, CAST(rate AS DOUBLE) AS hit_rate, least(greatest(10.0 *
CASE WHEN rate < 0.3 THEN 0.5 WHEN rate < 0.6 THEN 0.75 WHEN rate > 0.8 THEN 0.9 ELSE 1.0 END * CASE WHEN n % 100 > 95 THEN 1.6 WHEN n % 100 > 85 THEN 1.3 ELSE 1.0 END * CASE WHEN n % 100 / 100.0 * 0.7 + 0.3 > 0.8 THEN 1.2 ELSE 1.0 END, 2.0), 50.0) AS threshold, n FROM h)
SELECT key, hit_rate, round(CAST(threshold AS DOUBLE), 6) AS threshold, n / 60.0 >= threshold AS promote FROM t""", ("accesses",))  # fmt: skip
def cache_promotion(spark: SparkSession, folder: str) -> DataFrame:
    h = view(spark, folder, "accesses").groupBy("key").agg(activity.hit_rate(F.sum(F.col("hit").cast("bigint")), F.count("*")).alias("hit_rate"), F.count("*").alias("n"))
    used = (F.col("n") % 100) / 100.0
    t = activity.threshold(10.0, F.col("hit_rate"), used, activity.load(used, F.lit(100.0)))
    return h.withColumn("threshold", t).select("key", "hit_rate", F.round("threshold", 6).alias("threshold"), (F.col("n") / 60.0 >= F.col("threshold")).alias("promote"))


@query("cache_running_hit_rate", "SELECT event_id, CAST(sum(CAST(hit AS INTEGER)) OVER (PARTITION BY key ORDER BY ts) * 10000 // count(*) OVER (PARTITION BY key ORDER BY ts) AS BIGINT) / 10000.0 AS hit_rate FROM accesses", ("accesses",))
def cache_running_hit_rate(spark: SparkSession, folder: str) -> DataFrame:
    return activity.running_hit_rate(view(spark, folder, "accesses")).select("event_id", "hit_rate")


@query("cache_idle_keys", "SELECT key, max(ts) AS last FROM accesses GROUP BY key HAVING greatest(10000 - max(ts), 0) >= 20", ("accesses",))
def cache_idle_keys(spark: SparkSession, folder: str) -> DataFrame:
    return activity.idle_keys(view(spark, folder, "accesses"), 10000, 20)


@query("memory_pressure", """WITH u AS (SELECT event_id, (event_id * 37) % 101 / 100.0 AS s FROM events) SELECT event_id, CASE WHEN s >= 0.95 THEN 'critical' WHEN s >= 0.80 THEN 'high' WHEN s >= 0.60 THEN 'elevated' ELSE 'normal' END AS pressure FROM u""")
def memory_pressure(spark: SparkSession, folder: str) -> DataFrame:
    return feeds.pressure_events(table(spark, folder, "events"), (F.col("event_id") * 37) % 101, F.lit(100)).select("event_id", "pressure")


@query("readahead_sessions")
def readahead_sessions(spark: SparkSession, folder: str) -> DataFrame:
    return activity.read_ahead(view(spark, folder, "reads"), block=4096, most=1 << 20, budget=8 << 20)


@query("readahead_prefetch", """+ s AS (SELECT inode, seq, off, len, (off + len + 4095) // 4096 * 4096 AS start, CAST(1048576 AS BIGINT) AS fs FROM reads WHERE off + len < 1048576),
r AS (SELECT *, least(greatest(len, 4096), 16384) AS a FROM s WHERE start < fs) SELECT inode, seq, start, least((start + least(a, fs - start) + 4095) // 4096 * 4096, fs) - start AS n FROM r""", ("reads",))  # fmt: skip
def readahead_prefetch(spark: SparkSession, folder: str) -> DataFrame:
    state = view(spark, folder, "reads").withColumn("file_size", F.lit(1 << 20).cast("bigint")).withColumn("ahead", F.lit(16384).cast("bigint"))
    return activity.prefetch(state, 4096).select("inode", "seq", "start", "n")


CHANGES = """+ p AS (SELECT seq, op, split_part(key, ':', 1) AS k, try_cast(split_part(key, ':', 2) AS BIGINT) AS n, substr(key, length(split_part(key, ':', 1)) + length(split_part(key, ':', 2)) + 3) AS rest, value <> 'broken' AS good, value FROM changes),
e AS (SELECT seq, CASE WHEN k = 'f' AND op = 'PUT' AND good THEN 'add_child' WHEN k = 'f' AND op = 'PUT' THEN 'invalidate_children' WHEN k = 'f' THEN 'remove_child' WHEN k = 'r' AND op = 'PUT' AND good THEN 'update_inode' WHEN k = 'r' THEN 'invalidate_inode' END AS event, n AS subject, rest, value FROM p),
ev AS (SELECT seq, event, subject, CASE WHEN event IN ('add_child', 'remove_child') THEN rest END AS name, CASE WHEN event = 'add_child' THEN CAST(regexp_extract(value, '"inode":([0-9]+)', 1) AS BIGINT) END AS child, CASE WHEN event = 'update_inode' THEN CAST(regexp_extract(value, '"size":([0-9]+)', 1) AS BIGINT) END AS size FROM e WHERE event IS NOT NULL)"""


@query("change_feed_parse", CHANGES + " SELECT * FROM ev", ("changes",))
def change_feed_parse(spark: SparkSession, folder: str) -> DataFrame:
    return feeds.parse_changes(view(spark, folder, "changes"))


@query("change_feed_children", CHANGES + ", c AS (SELECT *, row_number() OVER (PARTITION BY subject, name ORDER BY seq DESC) AS k FROM ev WHERE event IN ('add_child', 'remove_child')) SELECT subject AS parent, name, child AS inode FROM c WHERE k = 1 AND event = 'add_child'", ("changes",))
def change_feed_children(spark: SparkSession, folder: str) -> DataFrame:
    return feeds.latest_children(feeds.parse_changes(view(spark, folder, "changes")))


# Fleet

OBJECTS = """SELECT kind, body FROM (SELECT 'class' AS kind, concat('{{"metadata":{{"name":"c', cast(n_nationkey as string), '"}},"provisioner":"', case when n_nationkey % 3 = 0 then 'fs.driver' else 'other' end, '"}}') AS body FROM {nation}
UNION ALL SELECT 'volume', concat('{{"metadata":{{"name":"v', cast(s_suppkey as string), '"}},"spec":{{"storageClassName":"c', cast(s_suppkey % 25 as string), '"}}}}') FROM {supplier}
UNION ALL SELECT 'claim', concat('{{"metadata":{{"namespace":"n', cast(p_size % 4 as string), '","name":"p', cast(p_partkey as string), '"}},"spec":{{"volumeName":"v', cast(p_partkey % 150 as string), '"}}}}') FROM {part}
UNION ALL SELECT 'pod', concat('{{"metadata":{{"namespace":"n', cast(p_size % 4 as string), '","name":"q', cast(p_partkey as string), '"}},"spec":{{"volumes":[{{"name":"d","persistentVolumeClaim":{{"claimName":"p', cast(p_partkey as string), '"}}}}]}},"status":{{"phase":"', case when p_partkey % 5 = 0 then 'Pending' else 'Running' end, '"}}}}') FROM {part}) AS o"""
FLEET = "WITH c AS (SELECT n_nationkey AS k FROM nation WHERE n_nationkey % 3 = 0), v AS (SELECT s_suppkey AS k FROM supplier WHERE s_suppkey % 25 IN (SELECT k FROM c)), p AS (SELECT p_partkey AS k, p_size % 4 AS n FROM part WHERE p_partkey % 150 IN (SELECT k FROM v))"


def _objects(spark: SparkSession, folder: str) -> DataFrame:
    return spark.sql(OBJECTS, **{t: table(spark, folder, t) for t in ("nation", "supplier", "part")})


@query("fleet_semi_join", FLEET + " SELECT 'n' || CAST(n AS VARCHAR) AS namespace, 'q' || CAST(k AS VARCHAR) AS name, k % 5 <> 0 AS ready FROM p")
def fleet_semi_join(spark: SparkSession, folder: str) -> DataFrame:
    return fleet.pods(_objects(spark, folder), "fs.driver", "fsmark")


@query("fleet_summary", FLEET + " SELECT (SELECT count(*) FROM c) AS classes, (SELECT count(*) FROM v) AS volumes, (SELECT count(*) FROM p) AS claims, (SELECT count(*) FROM p) AS pods, (SELECT count(*) FROM p WHERE k % 5 = 0) AS unhealthy")
def fleet_summary(spark: SparkSession, folder: str) -> DataFrame:
    return fleet.summary(_objects(spark, folder), "fs.driver", "fsmark")


# Codecs and updates


@query("delayed_record_codec", "SELECT slice_id, off, len AS size FROM slices", ("slices",))
def delayed_record_codec(spark: SparkSession, folder: str) -> DataFrame:
    packed = view(spark, folder, "slices").select(codec.pack(F.col("slice_id"), F.col("off"), F.col("len")).alias("b"))
    one = packed.select(F.explode(codec.unpack(F.col("b"))).alias("r")).select("r.*")
    return one.select(*[F.col(c).cast("bigint").alias(c) for c in ("slice_id", "off", "size")])


@query("object_keys", "SELECT slice_id, 'slices/' || CAST(slice_id AS VARCHAR) AS object, CAST(slice_id AS VARCHAR) || '/' || CAST(off // 4096 AS VARCHAR) AS block, sha256('slices/' || CAST(slice_id AS VARCHAR)) AS cached FROM slices", ("slices",))
def object_keys(spark: SparkSession, folder: str) -> DataFrame:
    key = codec.slice_key(F.col("slice_id"))
    return view(spark, folder, "slices").select("slice_id", key.alias("object"), codec.block_key(F.col("slice_id"), layout.div(F.col("off"), 4096)).alias("block"), codec.cache_name(key).alias("cached"))


@query("ns_set_xattrs", """+ a AS (SELECT event_id % 300 AS inode, CASE WHEN event_id % 2 = 0 THEN 'toxic' ELSE 'colour' END AS name, CASE event_id % 3 WHEN 0 THEN 'create' WHEN 1 THEN 'replace' END AS flag, event_id FROM events)
SELECT event_id, CASE WHEN k AND flag = 'create' THEN 'exists' WHEN NOT k AND flag = 'replace' THEN 'missing' WHEN k THEN 'update' ELSE 'insert' END AS outcome
FROM (SELECT a.*, EXISTS (SELECT 1 FROM xattr x WHERE x.inode = a.inode AND x.name = a.name) AS k FROM a)""", ("xattr",))  # fmt: skip
def ns_set_xattrs(spark: SparkSession, folder: str) -> DataFrame:
    e = F.col("event_id")
    asked = table(spark, folder, "events").select("event_id", (e % 300).alias("inode"), F.when(e % 2 == 0, "toxic").otherwise("colour").alias("name"), F.when(e % 3 == 0, "create").when(e % 3 == 1, "replace").alias("flag"))
    return namespace.set_xattrs(asked, view(spark, folder, "xattr")).select("event_id", "outcome")


@query("ns_set_attrs", "SELECT inode, CASE WHEN inode % 3 = 0 THEN 7 ELSE size END AS size, CASE WHEN inode % 5 = 0 THEN 33279 ELSE mode END AS mode FROM file_attr", ("file_attr",))
def ns_set_attrs(spark: SparkSession, folder: str) -> DataFrame:
    attrs = view(spark, folder, "file_attr").select("inode", "size", "mode")
    changes = attrs.select("inode", F.when(F.col("inode") % 3 == 0, F.lit(7).cast("bigint")).alias("size"), F.when(F.col("inode") % 5 == 0, 33279).alias("mode"))
    return namespace.set_attrs(attrs, changes, ["size", "mode"])


@query("ns_fallocate", """+ had AS (SELECT inode, size, CASE WHEN inode % 3 > 0 THEN size // 512 + 7 ELSE (size + 511) // 512 END AS blocks FROM file_attr)
SELECT a.inode, greatest(a.size, coalesce(max(r.off + r.len), a.size)) AS size, CAST(a.blocks + coalesce(sum(((r.off + r.len + 4095) // 4096 - r.off // 4096) * 8), 0) AS BIGINT) AS blocks
FROM had a LEFT JOIN reads r ON r.inode + 1000000000 = a.inode GROUP BY a.inode, a.size, a.blocks""", ("file_attr", "reads"))  # fmt: skip
def ns_fallocate(spark: SparkSession, folder: str) -> DataFrame:
    asked = view(spark, folder, "reads").withColumn("inode", F.col("inode") + 1000000000)
    attrs = view(spark, folder, "file_attr").select("inode", "size", F.when(F.col("inode") % 3 > 0, layout.div(F.col("size"), 512) + 7).alias("blocks"))
    return namespace.fallocate(asked, attrs)


@query("acl_upsert", """WITH r AS (SELECT n_nationkey AS inode, 0 AS acl_type, n_regionkey AS qualifier, 4 AS permissions, -1 AS seq FROM nation UNION ALL SELECT event_id % 40, 0, event_id % 5, CAST(event_id % 8 AS INTEGER), event_id FROM events)
SELECT inode, acl_type, qualifier, arg_max(permissions, seq) AS permissions FROM r GROUP BY inode, acl_type, qualifier""")  # fmt: skip
def acl_upsert(spark: SparkSession, folder: str) -> DataFrame:
    rules = table(spark, folder, "nation").select(F.col("n_nationkey").cast("bigint").alias("inode"), F.lit(0).alias("acl_type"), F.col("n_regionkey").cast("bigint").alias("qualifier"), F.lit(4).alias("permissions"))
    e = F.col("event_id")
    updates = table(spark, folder, "events").select((e % 40).alias("inode"), F.lit(0).alias("acl_type"), (e % 5).alias("qualifier"), (e % 8).cast("int").alias("permissions"), e.alias("seq"))
    return access.upsert_acl(rules, updates)


@query("tele_runtimes", """+ m AS (SELECT item || CAST(run AS VARCHAR) AS item, avg(value) FILTER (WHERE metric = 'price') AS wall, avg(value) FILTER (WHERE metric = 'quantity') AS active FROM metrics GROUP BY 1)
SELECT 'runtime' AS kind, item, 'wall_active_tail_s' AS metric, round(wall - active, 6) AS num, 's' AS unit FROM m UNION ALL SELECT 'runtime', item, 'wall_active_ratio', round(wall / active, 6), 'ratio' FROM m""", ("metrics",))  # fmt: skip
def tele_runtimes(spark: SparkSession, folder: str) -> DataFrame:
    rows = view(spark, folder, "metrics").groupBy(F.concat("item", F.col("run").cast("string")).alias("item"), "metric").agg(F.avg("value").alias("num"))
    wall = F.col("metric") == "price"
    named = rows.select(F.when(wall, "summary").otherwise("fio").alias("kind"), "item", F.when(wall, "tool_wall_s").otherwise("active_io_runtime_s").alias("metric"), "num")
    return _rounded(telemetry.runtimes(named), "num")


#: Names that these queries had while the plain ones asked for a part of the entries.
for _name in ("ns_lookup", "ns_batch_stat", "ns_lookup_path", "ns_rename_allowed", "ns_readdir", "gc_delayed_ready"):
    QUERIES[f"{_name}_all"], SQL[f"{_name}_all"] = QUERIES[_name], SQL[_name]

from tidemark.plans import metadata, reporting  # noqa: E402  they register into the same tables

__all__ = ["QUERIES", "SQL", "metadata", "reporting"]

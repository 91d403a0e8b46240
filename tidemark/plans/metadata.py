"""Queries of stores: attributes, names, links, slices of chunks, unsaved writes, and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import codec, layout, text
from tidemark.operators import access, attributes, extents, namespace, usage
from tidemark.plans.registry import query
from tidemark.sources.tables import table, view


# Attributes


TARGETS = "t AS (SELECT inode, size, mode, CASE WHEN inode % 11 = 0 THEN '/été/' || CAST(inode AS VARCHAR) END AS target FROM file_attr)"


def _with_targets(spark: SparkSession, folder: str) -> DataFrame:
    target = F.when(F.col("inode") % 11 == 0, F.concat(F.lit("/été/"), F.col("inode").cast("string")))
    return view(spark, folder, "file_attr").select("inode", "size", "mode", target.alias("target"))


@query("attr_of_files", "+ " + TARGETS + """, s AS (SELECT *, CASE WHEN target IS NULL THEN size ELSE strlen(target) END AS n FROM t)
SELECT inode, n AS size, (n + 511) // 512 AS blocks, CASE WHEN target IS NULL THEN 'file' ELSE 'symlink' END AS kind FROM s""", ("file_attr",))  # fmt: skip
def attr_of_files(spark: SparkSession, folder: str) -> DataFrame:
    return attributes.of_files(_with_targets(spark, folder))


@query("attr_of_dirs", "SELECT inode, CAST(4096 AS BIGINT) AS size, CAST(8 AS BIGINT) AS blocks, 'dir' AS kind FROM dentry WHERE type = 1", ("dentry",))
def attr_of_dirs(spark: SparkSession, folder: str) -> DataFrame:
    return attributes.of_dirs(view(spark, folder, "dentry").where("type = 1"))


RECORDS = """r AS (SELECT event_id AS inode, CASE event_id % 5 WHEN 0 THEN 'fifo' WHEN 1 THEN 'dir' WHEN 2 THEN 'file' END AS entry_kind, event_id % 3 > 0 AS is_file,
CASE WHEN event_id % 7 > 0 THEN event_id * 100 - 5000 END AS size, CASE WHEN event_id % 13 = 0 THEN 'ü' || CAST(event_id AS VARCHAR) END AS target FROM events)"""


def _records(spark: SparkSession, folder: str) -> DataFrame:
    e = F.col("event_id")
    return table(spark, folder, "events").select(
        e.alias("inode"), F.when(e % 5 == 0, "fifo").when(e % 5 == 1, "dir").when(e % 5 == 2, "file").alias("entry_kind"), (e % 3 > 0).alias("is_file"),
        F.when(e % 7 > 0, e * 100 - 5000).alias("size"), F.when(e % 13 == 0, F.concat(F.lit("ü"), e.cast("string"))).alias("target"),
    )


@query("attr_of_records", "WITH " + RECORDS + """, k AS (SELECT *, CASE WHEN entry_kind IS NOT NULL THEN entry_kind WHEN NOT is_file THEN 'dir' WHEN target IS NOT NULL THEN 'symlink' ELSE 'file' END AS kind FROM r),
s AS (SELECT inode, kind, CASE WHEN target IS NOT NULL THEN strlen(target) WHEN kind = 'dir' THEN 4096 WHEN size > 0 THEN size ELSE 0 END AS size FROM k) SELECT inode, size, (size + 511) // 512 AS blocks, kind FROM s""")  # fmt: skip
def attr_of_records(spark: SparkSession, folder: str) -> DataFrame:
    return attributes.of_records(_records(spark, folder))


@query("attr_forward_kind", "WITH " + RECORDS + " SELECT inode, CASE WHEN entry_kind IS NOT NULL THEN entry_kind WHEN is_file THEN 'file' ELSE 'dir' END AS kind FROM r")
def attr_forward_kind(spark: SparkSession, folder: str) -> DataFrame:
    return _records(spark, folder).select("inode", attributes.kind_of(F.col("entry_kind"), F.col("is_file")).alias("kind"))


@query("attr_special", "WITH m AS (SELECT event_id AS id, CAST(event_id * 4096 % 65536 AS INTEGER) AS mode FROM events) SELECT id, CASE WHEN mode & 61440 IN (4096, 49152, 8192, 24576) THEN true WHEN mode & 61440 IN (32768, 16384, 40960) THEN false END AS special FROM m")
def attr_special(spark: SparkSession, folder: str) -> DataFrame:
    m = table(spark, folder, "events").select(F.col("event_id").alias("id"), (F.col("event_id") * 4096 % 65536).cast("int").alias("mode"))
    return m.select("id", text.is_special(F.col("mode")).alias("special"))


@query("store_features", "SELECT 'sql' AS backend, count(*) AS features, count(*) FILTER (WHERE f IN ('flocks', 'quota', 'dump_load', 'watch_invalidation')) AS lacking FROM (SELECT unnest(['namespace', 'file_data', 'batch_stat', 'hardlinks', 'symlinks', 'rename_exchange', 'open_close_tracking', 'stat_fs', 'sessions', 'global_locks', 'plocks', 'flocks', 'xattr', 'acl', 'quota', 'dump_load', 'compaction', 'watch_invalidation']) AS f)")
def store_features(spark: SparkSession, folder: str) -> DataFrame:
    backends = spark.range(1).select(F.lit("sql").alias("backend"), F.lit(attributes.SQL_LACKS).alias("lacks"))
    return attributes.features(backends).groupBy("backend").agg(F.count("*").alias("features"), F.count_if(~F.col("claimed")).alias("lacking"))


# Names and links

LINKS = """nations AS (SELECT n_nationkey AS k, n_name AS name, r_name AS region FROM nation JOIN region ON n_regionkey = r_regionkey)"""


def _links(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """The tree with a link to every nation below the root, one beside it, a link to that, and one to itself."""
    n, r = table(spark, folder, "nation"), table(spark, folder, "region")
    each = n.join(r, n.n_regionkey == r.r_regionkey).select(F.col("n_nationkey").cast("bigint").alias("k"), F.col("n_name").alias("name"), F.col("r_name").alias("region"), (F.lit(10) + F.col("r_regionkey")).cast("bigint").alias("in_region"))
    root = F.lit(1).cast("bigint")
    made = [
        (root, F.concat(F.lit("to_"), "name"), 5000, F.concat(F.lit("/"), "region", F.lit("/"), "name")),
        (F.col("in_region"), F.concat(F.lit("by_"), "name"), 6000, F.concat(F.lit("./x/../"), "name")),
        (root, F.concat(F.lit("via_"), "name"), 7000, F.concat("region", F.lit("/by_"), "name")),
        (root, F.concat(F.lit("loop_"), "name"), 8000, F.concat(F.lit("/loop_"), "name")),
    ]
    rows = each.select(F.explode(F.array(*[F.struct(p.alias("parent"), nm.alias("name"), (F.col("k") + at).alias("inode"), t.alias("target")) for p, nm, at, t in made])).alias("l")).select("l.*")
    tree = view(spark, folder, "dentry").unionByName(rows.select("parent", "name", "inode", F.lit(2).alias("type")))
    return tree, rows.select("inode", "target")


def _link_paths(spark: SparkSession, folder: str) -> DataFrame:
    c, n, r = (table(spark, folder, t) for t in ("customer", "nation", "region"))
    each = c.join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    forms = [F.concat(F.lit("/to_"), "n_name"), F.concat(F.lit("/"), "r_name", F.lit("/by_"), "n_name"), F.concat(F.lit("/via_"), "n_name"), F.concat(F.lit("/loop_"), "n_name"), F.concat(F.lit("//"), "r_name", F.lit("/"), "n_name")]
    deep = each.select(F.explode(F.array(*[F.concat(f, F.lit("/"), "c_name") for f in forms])).alias("path"))
    ends = each.select(F.explode(F.array(*forms)).alias("path")).distinct()
    return deep.unionByName(ends).unionByName(spark.sql("select '/no/where' as path union all select '/'"))


def _resolve_sql(follow: bool) -> str:
    tail = "'too many links', NULL" if follow else "'ok', 8000 + k"
    end = {"to": "1000 + k" if follow else "5000 + k", "by": "1000 + k" if follow else "6000 + k", "via": "1000 + k" if follow else "7000 + k"}
    return f"""WITH {LINKS}, c AS (SELECT n.*, c_custkey + 1000000 AS inode, c_name FROM customer JOIN nations n ON c_nationkey = k),
used AS (SELECT DISTINCT k, name, region FROM c),
p(path, outcome, inode) AS (SELECT '/to_' || name || '/' || c_name, 'ok', inode FROM c UNION ALL SELECT '/' || region || '/by_' || name || '/' || c_name, 'ok', inode FROM c UNION ALL SELECT '/via_' || name || '/' || c_name, 'ok', inode FROM c
UNION ALL SELECT '/loop_' || name || '/' || c_name, 'too many links', NULL FROM c UNION ALL SELECT '//' || region || '/' || name || '/' || c_name, 'ok', inode FROM c
UNION ALL SELECT '/to_' || name, 'ok', {end["to"]} FROM used UNION ALL SELECT '/' || region || '/by_' || name, 'ok', {end["by"]} FROM used UNION ALL SELECT '/via_' || name, 'ok', {end["via"]} FROM used
UNION ALL SELECT '/loop_' || name, {tail} FROM used UNION ALL SELECT '//' || region || '/' || name, 'ok', 1000 + k FROM used UNION ALL SELECT '/no/where', 'missing', NULL UNION ALL SELECT '/', 'ok', 1) SELECT DISTINCT path, inode, outcome FROM p"""


@query("ns_resolve_follow", _resolve_sql(True))
def ns_resolve_follow(spark: SparkSession, folder: str) -> DataFrame:
    tree, targets = _links(spark, folder)
    return namespace.resolve(tree, targets, _link_paths(spark, folder), max_links=8)


@query("ns_resolve_tail", _resolve_sql(False))
def ns_resolve_tail(spark: SparkSession, folder: str) -> DataFrame:
    tree, targets = _links(spark, folder)
    return namespace.resolve(tree, targets, _link_paths(spark, folder), follow=False, max_links=8)


MORE = "more AS (SELECT parent, name, inode, type FROM dentry UNION ALL SELECT 1, 'again-' || name, inode, type FROM dentry WHERE type = 0 AND inode % 3 = 0)"


def _more(spark: SparkSession, folder: str) -> DataFrame:
    """The tree with a second link below the root for every third file."""
    dentry = view(spark, folder, "dentry")
    return dentry.unionByName(dentry.where("type = 0 and inode % 3 = 0").select(F.lit(1).cast("bigint").alias("parent"), F.concat(F.lit("again-"), "name").alias("name"), "inode", "type"))


@query("ns_names", "+ " + MORE + " SELECT inode, parent, name, row_number() OVER (PARTITION BY inode ORDER BY parent, name) AS place FROM more UNION ALL SELECT 1, NULL, '/', 1", ("dentry",))
def ns_names(spark: SparkSession, folder: str) -> DataFrame:
    more = _more(spark, folder)
    return namespace.names(more, more.select("inode").unionByName(spark.sql("select cast(1 as bigint) as inode")))


@query("ns_path_split", "SELECT page_id, '/a/' || CAST(page_id AS VARCHAR) AS parent, stack AS name FROM (SELECT page_id, string_split(stack, ';')[1] AS stack FROM stacks)", ("stacks",))
def ns_path_split(spark: SparkSession, folder: str) -> DataFrame:
    rows = view(spark, folder, "stacks").select("page_id", F.concat(F.lit("/a/"), F.col("page_id").cast("string"), F.lit("/"), F.get(F.split("stack", ";"), F.lit(0))).alias("path"))
    parent, name = text.parent_and_name(F.col("path"))
    return rows.select("page_id", parent.alias("parent"), name.alias("name"))


@query("xattr_list", "SELECT inode, string_agg(name, ',' ORDER BY name) AS names, max(value) FILTER (WHERE name = 'toxic') AS toxic FROM xattr GROUP BY inode", ("xattr",))
def xattr_list(spark: SparkSession, folder: str) -> DataFrame:
    got = namespace.xattrs(view(spark, folder, "xattr").dropDuplicates(["inode", "name"]))
    return got.select("inode", F.array_join("names", ",").alias("names"), F.try_element_at("values", F.lit("toxic")).alias("toxic"))


OPS = """ops AS (SELECT event_id AS seq, CASE WHEN event_id % 4 = 0 THEN 'unlink' WHEN event_id % 31 = 0 THEN 'mkdir' WHEN event_id % 3 = 0 THEN 'link' ELSE 'create' END AS op, CAST(1 AS BIGINT) AS parent, 'n' || CAST(event_id * 7919 % 97 AS VARCHAR) AS name,
9000000 + event_id AS inode, CASE WHEN event_id % 4 > 0 AND event_id % 31 = 0 THEN 1 ELSE 0 END AS type FROM events),
old AS (SELECT CAST(1 AS BIGINT) AS parent, 'n' || CAST(n_nationkey AS VARCHAR) AS name, CAST(n_nationkey AS BIGINT) AS inode, CASE WHEN n_nationkey = 5 THEN 1 ELSE 0 END AS type FROM nation)"""
# Walked one operation after the other: what holds the name before each.
STEPS = "WITH RECURSIVE " + OPS + """, every AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY seq) AS k FROM ops),
w(name, k, seq, outcome, inode, type) AS (
  SELECT n.name, CAST(0 AS BIGINT), CAST(-1 AS BIGINT), 'start', o.inode, o.type FROM (SELECT name FROM every UNION SELECT name FROM old) n LEFT JOIN old o ON o.name = n.name
  UNION ALL
  SELECT w.name, e.k, e.seq, CASE WHEN e.op = 'unlink' THEN CASE WHEN w.inode IS NULL THEN 'missing' WHEN w.type = 1 THEN 'is a directory' ELSE 'ok' END WHEN w.inode IS NULL THEN 'ok' ELSE 'exists' END,
    CASE WHEN e.op = 'unlink' THEN CASE WHEN w.type = 1 THEN w.inode END ELSE coalesce(w.inode, e.inode) END,
    CASE WHEN e.op = 'unlink' THEN CASE WHEN w.type = 1 THEN 1 END WHEN w.inode IS NULL THEN e.type ELSE w.type END
  FROM w JOIN every e ON e.name = w.name AND e.k = w.k + 1)"""


def _replayed(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    e = F.col("event_id")
    op = F.when(e % 4 == 0, "unlink").when(e % 31 == 0, "mkdir").when(e % 3 == 0, "link").otherwise("create")
    root = F.lit(1).cast("bigint").alias("parent")
    ops = table(spark, folder, "events").select(e.alias("seq"), op.alias("op"), root, F.concat(F.lit("n"), (e * 7919 % 97).cast("string")).alias("name"), (e + 9000000).alias("inode"), ((e % 4 > 0) & (e % 31 == 0)).cast("int").alias("type"))
    k = F.col("n_nationkey")
    old = table(spark, folder, "nation").select(root, F.concat(F.lit("n"), k.cast("string")).alias("name"), k.cast("bigint").alias("inode"), (k == 5).cast("int").alias("type"))
    return namespace.replay(old, ops)


@query("ns_replay_outcomes", STEPS + " SELECT seq, outcome FROM w WHERE k > 0")
def ns_replay_outcomes(spark: SparkSession, folder: str) -> DataFrame:
    return _replayed(spark, folder)[1]


@query("ns_replay_entries", STEPS + " SELECT CAST(1 AS BIGINT) AS parent, name, max_by(inode, k) AS inode, max_by(type, k) AS type FROM (SELECT *, max(k) OVER (PARTITION BY name) AS last FROM w) WHERE k = last AND inode IS NOT NULL GROUP BY name")
def ns_replay_entries(spark: SparkSession, folder: str) -> DataFrame:
    return _replayed(spark, folder)[0]


@query("ns_unlink", "+ " + MORE + """, gone AS (SELECT * FROM more WHERE type = 0 AND (inode % 2 = 0 AND parent > 1 OR inode % 5 = 0 AND parent = 1)), f AS (SELECT inode, count(*) AS nlink, min(parent) AS one FROM more WHERE type = 0 GROUP BY inode),
l AS (SELECT f.inode, f.nlink - g.n AS n, r.one FROM f JOIN (SELECT inode, count(*) AS n FROM gone GROUP BY inode) g USING (inode) LEFT JOIN (SELECT inode, min(parent) AS one FROM more m WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.parent = m.parent AND g.name = m.name) GROUP BY inode) r USING (inode))
SELECT inode, n AS nlink, n = 0 AS deleted, CASE WHEN n = 0 THEN 0 ELSE one END AS parent FROM l""", ("dentry",))  # fmt: skip
def ns_unlink(spark: SparkSession, folder: str) -> DataFrame:
    more = _more(spark, folder)
    files = more.where("type = 0").groupBy("inode").agg(F.count("*").alias("nlink"), F.min("parent").alias("parent"))
    return namespace.link_changes(files, more, more.where("type = 0 and (inode % 2 = 0 and parent > 1 or inode % 5 = 0 and parent = 1)"))


@query("ns_rename", """+ m AS (SELECT a.inode AS id, a.inode AS src, a.type AS st, b.inode AS dst, b.type AS dt, CASE a.inode % 3 WHEN 0 THEN 'exchange' WHEN 1 THEN 'noreplace' END AS flag FROM dentry a LEFT JOIN dentry b ON b.inode = a.inode + 1),
o AS (SELECT *, CASE WHEN flag = 'exchange' THEN CASE WHEN dst IS NULL THEN 'missing' ELSE 'ok' END WHEN flag = 'noreplace' AND dst IS NOT NULL THEN 'exists' WHEN dst IS NULL THEN 'ok' WHEN st = 1 AND dt <> 1 THEN 'not a directory' WHEN st <> 1 AND dt = 1 THEN 'is a directory'
WHEN dt = 1 AND dst IN (SELECT parent FROM dentry) THEN 'not empty' ELSE 'ok' END AS outcome FROM m)
SELECT id, outcome, CASE WHEN outcome <> 'ok' THEN src WHEN flag = 'exchange' THEN dst END AS src_after, CASE WHEN outcome = 'ok' THEN src ELSE dst END AS dst_after FROM o""", ("dentry",))  # fmt: skip
def ns_rename(spark: SparkSession, folder: str) -> DataFrame:
    dentry = view(spark, folder, "dentry")
    b = dentry.select((F.col("inode") - 1).alias("id"), F.col("parent").alias("dst_parent"), F.col("name").alias("dst_name"))
    moves = dentry.select(F.col("inode").alias("id"), F.col("parent").alias("src_parent"), F.col("name").alias("src_name"), F.when(F.col("inode") % 3 == 0, "exchange").when(F.col("inode") % 3 == 1, "noreplace").alias("flag")).join(b, "id", "left")
    return namespace.renamed(moves=moves, dentry=dentry)


# Slices


@query("chunk_ids", "SELECT DISTINCT chunk_id FROM slices", ("slices",))
def chunk_ids(spark: SparkSession, folder: str) -> DataFrame:
    return extents.chunk_ids(view(spark, folder, "slices"))


@query("chunk_ids_page", "SELECT DISTINCT chunk_id FROM slices WHERE chunk_id > 10 ORDER BY chunk_id LIMIT 8", ("slices",))
def chunk_ids_page(spark: SparkSession, folder: str) -> DataFrame:
    return extents.chunk_ids(view(spark, folder, "slices"), after=10, limit=8)


@query("ns_readdir_page", "SELECT name, inode FROM dentry WHERE name > 'Customer#000000040' ORDER BY name LIMIT 30", ("dentry",))
def ns_readdir_page(spark: SparkSession, folder: str) -> DataFrame:
    return namespace.page(view(spark, folder, "dentry").select("name", "inode"), "name", "Customer#000000040", 30)


@query("slices_append_order", "SELECT chunk_id, slice_id, off, len, row_number() OVER (PARTITION BY chunk_id ORDER BY slice_id) AS place FROM slices", ("slices",))
def slices_append_order(spark: SparkSession, folder: str) -> DataFrame:
    return extents.append_order(view(spark, folder, "slices")).select("chunk_id", "slice_id", "off", "len", "place")


@query("compact_version_check", """+ cur AS (SELECT chunk_id, slice_id, off, len + CASE WHEN slice_id % 89 = 0 AND chunk_id % 2 = 0 THEN 1 ELSE 0 END AS len FROM slices WHERE NOT (slice_id % 97 = 0 AND chunk_id % 3 = 0) UNION ALL SELECT chunk_id, slice_id + 1000000000, off, len FROM slices WHERE slice_id % 101 = 0 AND chunk_id % 5 = 0)
SELECT e.chunk_id, e.n = c.n AND e.same = e.n AS unchanged FROM (SELECT s.chunk_id, count(*) AS n, count(c.slice_id) AS same FROM slices s LEFT JOIN cur c ON c.slice_id = s.slice_id AND c.chunk_id = s.chunk_id AND c.off = s.off AND c.len = s.len GROUP BY s.chunk_id) e
LEFT JOIN (SELECT chunk_id, count(*) AS n FROM cur GROUP BY chunk_id) c ON c.chunk_id = e.chunk_id""", ("slices",))  # fmt: skip
def compact_version_check(spark: SparkSession, folder: str) -> DataFrame:
    slices = view(spark, folder, "slices")
    odd = F.when((F.col("slice_id") % 89 == 0) & (F.col("chunk_id") % 2 == 0), 1).otherwise(0)
    current = slices.where("not (slice_id % 97 = 0 and chunk_id % 3 = 0)").withColumn("len", F.col("len") + odd)
    added = slices.where("slice_id % 101 = 0 and chunk_id % 5 = 0").withColumn("slice_id", F.col("slice_id") + 1000000000)
    return extents.unchanged(slices, current.unionByName(added))


@query("compact_heavy_plan", """+ c AS (SELECT chunk_id, string_agg(CAST(slice_id AS VARCHAR), ',' ORDER BY slice_id) AS delayed FROM slices GROUP BY chunk_id HAVING count(*) >= 30)
SELECT chunk_id, 1000000 + row_number() OVER (ORDER BY chunk_id) - 1 AS new_slice, CAST(0 AS BIGINT) AS off, CAST(67108864 AS BIGINT) AS len, delayed FROM c""", ("slices",))  # fmt: skip
def compact_heavy_plan(spark: SparkSession, folder: str) -> DataFrame:
    slices = view(spark, folder, "slices")
    chosen = slices.groupBy("chunk_id").count().where("count >= 30")
    return extents.heavy_plan(slices, chosen, 1000000, layout.CHUNK).withColumn("delayed", F.array_join("delayed", ","))


@query("chunk_byte_range", "SELECT slice_id, off // 16384 * 16384 AS lo, (off // 16384 + 1) * 16384 AS hi FROM slices", ("slices",))
def chunk_byte_range(spark: SparkSession, folder: str) -> DataFrame:
    lo, hi = layout.chunk_range(layout.chunk_index(F.col("off"), 16384), 16384)
    return view(spark, folder, "slices").select("slice_id", lo.alias("lo"), hi.alias("hi"))


@query("write_coalesce_strict", """+ r AS (SELECT *, off + len AS e, lag(off + len) OVER (PARTITION BY chunk_id ORDER BY off, off + len, slice_id) AS p FROM (SELECT slice_id, chunk_id * 1000 + off // 4096 AS chunk_id, off // 1024 * 1024 AS off, CASE WHEN slice_id % 5 = 0 THEN 1500 ELSE 1024 END AS len FROM slices)),
g AS (SELECT *, sum(CASE WHEN off = p THEN 0 ELSE 1 END) OVER (PARTITION BY chunk_id ORDER BY off, e, slice_id) AS run FROM r), m AS (SELECT chunk_id, run, min(off) AS lo, max(e) AS hi, count(*) AS n FROM g GROUP BY chunk_id, run HAVING count(*) >= 2),
free AS (SELECT * FROM m WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.chunk_id = m.chunk_id AND g.run <> m.run AND g.off < m.hi AND m.lo < g.e))
SELECT chunk_id, lo, hi, n FROM (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY lo, hi, run) AS k FROM free) WHERE k = 1""", ("slices",))  # fmt: skip
def write_coalesce_strict(spark: SparkSession, folder: str) -> DataFrame:
    off = layout.div(F.col("off"), 1024) * 1024
    rows = view(spark, folder, "slices").select("slice_id", (F.col("chunk_id") * 1000 + layout.div(F.col("off"), 4096)).alias("chunk_id"), off.alias("off"), F.when(F.col("slice_id") % 5 == 0, 1500).otherwise(1024).alias("len"))
    return extents.coalesce_runs(rows)


DIRTY = "d AS (SELECT chunk_id, slice_id, (off * 31) % 65536 AS off, len // 2 + 1 AS len, CASE WHEN slice_id % 4 = 0 THEN 0 ELSE slice_id * 7919 % 1000003 END AS write_order, slice_id AS position FROM slices WHERE slice_id % 3 = 0)"


@query("read_overlay", "+ " + DIRTY + """, src AS (SELECT chunk_id, off AS a, off + len AS b, 0 AS f, 0 AS z, 0 AS o, slice_id AS p, 'saved' AS source, slice_id FROM slices UNION ALL SELECT chunk_id, off, off + len, 1, CAST(write_order <> 0 AS INTEGER), write_order, position, 'dirty', slice_id FROM d),
edges AS (SELECT chunk_id, a AS p FROM src UNION SELECT chunk_id, b FROM src), steps AS (SELECT *, lead(p) OVER (PARTITION BY chunk_id ORDER BY p) AS q FROM edges),
won AS (SELECT s.chunk_id, s.p AS lo, s.q AS hi, max({'f': x.f, 'z': x.z, 'o': x.o, 'p': x.p, 'source': x.source, 'slice_id': x.slice_id}) AS v FROM steps s JOIN src x ON x.chunk_id = s.chunk_id AND x.a <= s.p AND x.b >= s.q WHERE s.q IS NOT NULL GROUP BY s.chunk_id, s.p, s.q),
f AS (SELECT chunk_id, lo, hi, v.source AS source, v.slice_id AS slice_id, CASE WHEN lag(hi) OVER w = lo AND lag(v.source) OVER w = v.source AND lag(v.slice_id) OVER w = v.slice_id THEN 0 ELSE 1 END AS f FROM won WINDOW w AS (PARTITION BY chunk_id ORDER BY lo)),
r AS (SELECT *, sum(f) OVER (PARTITION BY chunk_id ORDER BY lo) AS run FROM f) SELECT chunk_id, min(lo) AS lo, max(hi) AS hi, source, slice_id FROM r GROUP BY chunk_id, run, source, slice_id""", ("slices",))  # fmt: skip
def read_overlay(spark: SparkSession, folder: str) -> DataFrame:
    slices, s = view(spark, folder, "slices"), F.col("slice_id")
    dirty = slices.where("slice_id % 3 = 0").select("chunk_id", "slice_id", (F.col("off") * 31 % 65536).alias("off"), (layout.div(F.col("len"), 2) + 1).alias("len"), F.when(s % 4 == 0, 0).otherwise(s * 7919 % 1000003).alias("write_order"), s.alias("position"))
    return extents.overlay_dirty(slices, dirty)


@query("write_block_assembly", """+ p AS (SELECT inode AS file, off // 262144 * 4096 AS off, seq * 7919 % 101 AS u, seq FROM reads), l AS (SELECT file, off, arg_max(seq, u * 1000000000 + seq) AS seq FROM p GROUP BY file, off)
SELECT file, off // 8192 AS block, string_agg(CAST(seq AS VARCHAR), ',' ORDER BY off) AS pages FROM l GROUP BY file, off // 8192 HAVING count(*) = 2""", ("reads",))  # fmt: skip
def write_block_assembly(spark: SparkSession, folder: str) -> DataFrame:
    pages = view(spark, folder, "reads").select(F.col("inode").alias("file"), (layout.div(F.col("off"), 262144) * 4096).alias("off"), (F.col("seq") * 7919 % 101).alias("unique"), "seq")
    return extents.assembled(pages, 4096, 8192).withColumn("pages", F.array_join("pages", ","))


@query("extent_subtract", """+ x AS (SELECT chunk_id, off AS a, off + len AS b, CAST(slice_id % 4 = 0 AS INTEGER) AS cut FROM slices), edges AS (SELECT chunk_id, a AS p FROM x UNION SELECT chunk_id, b FROM x), steps AS (SELECT *, lead(p) OVER (PARTITION BY chunk_id ORDER BY p) AS q FROM edges),
free AS (SELECT s.chunk_id, s.p, s.q FROM steps s WHERE s.q IS NOT NULL AND EXISTS (SELECT 1 FROM x WHERE x.chunk_id = s.chunk_id AND cut = 0 AND a <= s.p AND b >= s.q) AND NOT EXISTS (SELECT 1 FROM x WHERE x.chunk_id = s.chunk_id AND cut = 1 AND a <= s.p AND b >= s.q)),
r AS (SELECT *, sum(f) OVER (PARTITION BY chunk_id ORDER BY p) AS run FROM (SELECT *, CASE WHEN lag(q) OVER (PARTITION BY chunk_id ORDER BY p) = p THEN 0 ELSE 1 END AS f FROM free)) SELECT chunk_id, min(p) AS lo, max(q) AS hi FROM r GROUP BY chunk_id, run""", ("slices",))  # fmt: skip
def extent_subtract(spark: SparkSession, folder: str) -> DataFrame:
    slices = view(spark, folder, "slices")
    return extents.subtract(slices.where("slice_id % 4 > 0"), slices.where("slice_id % 4 = 0"))


# Usage, ids, names of files, permissions


@query("usage_of_nodes", """+ n AS (SELECT 'file' AS kind, size, CASE WHEN inode % 2 = 0 THEN size // 512 ELSE 0 END AS blocks, deleted, nlink FROM file_attr UNION ALL SELECT 'dir', 4096, 8, inode % 7 = 0, 2 FROM dentry WHERE type = 1)
SELECT CAST(sum(CASE WHEN kind = 'dir' THEN 0 WHEN blocks > 0 THEN blocks * 512 ELSE size END) AS BIGINT) AS used_space, count(*) AS used_inodes FROM n WHERE NOT deleted AND nlink > 0""", ("file_attr", "dentry"))  # fmt: skip
def usage_of_nodes(spark: SparkSession, folder: str) -> DataFrame:
    files = view(spark, folder, "file_attr").select(F.lit("file").alias("kind"), "size", F.when(F.col("inode") % 2 == 0, layout.div(F.col("size"), 512)).otherwise(0).alias("blocks"), "deleted", "nlink")
    dirs = view(spark, folder, "dentry").where("type = 1").select(F.lit("dir").alias("kind"), F.lit(4096).cast("bigint").alias("size"), F.lit(8).cast("bigint").alias("blocks"), (F.col("inode") % 7 == 0).alias("deleted"), F.lit(2).alias("nlink"))
    return usage.usage_of_nodes(files.unionByName(dirs))


@query("store_next_ids", "SELECT greatest((SELECT max(inode) FROM dentry WHERE type = 1), (SELECT max(inode) FROM file_attr)) + 1 AS next_inode, (SELECT max(slice_id) FROM slices) + 1 AS next_slice", ("dentry", "file_attr", "slices"))
def store_next_ids(spark: SparkSession, folder: str) -> DataFrame:
    return usage.next_ids(view(spark, folder, "dentry").where("type = 1"), view(spark, folder, "file_attr"), view(spark, folder, "slices"))


@query("cache_sealed_names", """+ n AS (SELECT slice_id, CAST(chunk_id AS VARCHAR) || '_' || CAST(slice_id AS VARCHAR) || '_7_1_' || CAST(off AS VARCHAR) || CASE WHEN slice_id % 5 = 0 THEN '' ELSE '_' || CAST(len AS VARCHAR) END || CASE WHEN slice_id % 7 = 0 THEN '.open' ELSE '.sealed' END AS name, chunk_id, off, len FROM slices)
SELECT slice_id, CASE WHEN ok THEN chunk_id END AS inode, CASE WHEN ok THEN slice_id END AS chunk_id, CASE WHEN ok THEN off END AS first, CASE WHEN ok THEN len END AS second FROM (SELECT *, slice_id % 5 > 0 AND slice_id % 7 > 0 AS ok FROM n)""", ("slices",))  # fmt: skip
def cache_sealed_names(spark: SparkSession, folder: str) -> DataFrame:
    s = F.col("slice_id")
    name = F.concat(F.concat_ws("_", F.col("chunk_id").cast("string"), s.cast("string"), F.lit("7"), F.lit("1"), F.col("off").cast("string"), F.when(s % 5 > 0, F.col("len").cast("string"))), F.when(s % 7 == 0, ".open").otherwise(".sealed"))
    got = view(spark, folder, "slices").select("slice_id", codec.sealed_name(name).alias("n"))
    return got.select("slice_id", *[F.col(f"n.{c}").cast("bigint").alias(c) for c in ("inode", "chunk_id", "first", "second")])


@query("access_acl_check", """SELECT inode, u.uid AS asker, u.uid = 0 OR (u.uid = 2 AND inode % 3 = 0) OR (u.uid % 3 = 1 OR u.uid % 2 = 1) AND inode % 5 = 0 OR CASE WHEN u.uid = a.uid THEN (mode & 64) <> 0 WHEN a.gid IN (u.uid % 3, u.uid % 2) THEN (mode & 8) <> 0 ELSE (mode & 1) <> 0 END AS may_execute
FROM file_attr a JOIN (SELECT CAST(n_nationkey AS INTEGER) AS uid FROM nation WHERE n_nationkey < 5) u ON true""", ("file_attr",))  # fmt: skip
def access_acl_check(spark: SparkSession, folder: str) -> DataFrame:
    asked = view(spark, folder, "file_attr").withColumn("asker", F.explode(F.sequence(F.lit(0), F.lit(4))))
    entry = lambda kind, who, flags: F.struct(F.lit(kind).alias("kind"), F.lit(who).alias("id"), F.lit(flags).alias("flags"))
    acl = F.filter(F.array(F.when(F.col("inode") % 3 == 0, entry("user", 2, 5)), F.when(F.col("inode") % 5 == 0, entry("group", 1, 1)), entry("other", 0, 2)), lambda e: e.isNotNull())
    gids = F.array(F.col("asker") % 3, F.col("asker") % 2)
    return asked.select("inode", "asker", access.allowed("execute", F.col("asker"), gids, F.col("mode"), F.col("uid"), F.col("gid"), acl).alias("may_execute"))

"""The directory tree: lookups, listings, paths up and down.

Entries have ``parent``, ``name``, ``inode`` and ``type`` (1: directory); the root is inode 1. Questions come as tables and are
answered together, one join a path level, so the number of jobs follows the depth of the tree and not the number of paths.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.text import normal_path, path_parts
from tidemark.sources.scratch import keep

ROOT = 1
#: Paths that one task makes distinct.
TASK_PATHS = 1 << 18


def lookup(dentry: DataFrame, asked: DataFrame) -> DataFrame:
    """``parent``, ``name`` and ``inode`` (null if missing) of each asked pair."""
    return asked.select("parent", "name").join(dentry.select("parent", "name", "inode", "type"), ["parent", "name"], "left")


def lookup_folded(dentry: DataFrame, asked: DataFrame) -> DataFrame:
    """Lookups that ignore the case of A-Z; the first name in order wins."""
    fold = lambda c: F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    first = dentry.groupBy("parent", fold(F.col("name")).alias("folded")).agg(F.min_by("inode", "name").alias("inode"))
    return asked.withColumn("folded", fold(F.col("name"))).join(first, ["parent", "folded"], "left").drop("folded")


def readdir(dentry: DataFrame, parents: DataFrame) -> DataFrame:
    """Entries of the directories ``parents.parent`` with their place in name order."""
    place = F.row_number().over(Window.partitionBy("parent").orderBy("name")).cast("bigint")
    return dentry.join(parents.select("parent").distinct(), "parent", "left_semi").withColumn("place", place)


def page(rows: DataFrame, key: str, after, limit: int) -> DataFrame:
    """The next ``limit`` rows in order of ``key`` after a cursor."""
    return rows.where(F.col(key) > after).orderBy(key).limit(limit)


def batch_stat(dirs: DataFrame, files: DataFrame, asked: DataFrame) -> DataFrame:
    """Attributes for ``asked`` (``place``, ``inode``), in place; missing inodes have nulls, a directory wins over a file."""
    known = dirs.withColumn("kind", F.lit("dir")).unionByName(files.join(dirs.select("inode"), "inode", "left_anti").withColumn("kind", F.lit("file")))
    return asked.join(known, "inode", "left")


def child_counts(dentry: DataFrame) -> DataFrame:
    return dentry.groupBy("parent").agg(F.count("*").alias("n_children"), F.count_if(F.col("type") == 1).alias("n_dirs"))


def empty_dirs(dentry: DataFrame) -> DataFrame:
    """Directories without entries, which alone may be removed."""
    return dentry.where("type = 1").select("inode", "name").join(dentry.select(F.col("parent").alias("inode")), "inode", "left_anti")


def link_counts(dentry: DataFrame) -> DataFrame:
    """Entries that name each inode."""
    return dentry.groupBy("inode").agg(F.count("*").alias("n_links"), F.min(F.struct("parent", "name")).alias("first")).select("inode", "n_links", "first.parent", "first.name")


def dangling(dentry: DataFrame, known: DataFrame) -> DataFrame:
    """Entries whose inode has no attributes."""
    return dentry.join(known.select("inode"), "inode", "left_anti")


def paths_up(dentry: DataFrame, asked: DataFrame | None = None, max_depth: int | None = None) -> DataFrame:
    """``inode`` and ``path`` of every way from the root to the asked inodes, or to all; broken chains and cycles are left out.

    Ways may be as deep as the tree, or ``max_depth`` if given. The paths of directories, which are few, are made level by
    level from the root, each level from the one before; all entries are then joined with their directory once.
    """
    dirs = keep(dentry.join(dentry.select(F.col("parent").alias("inode")).distinct(), "inode", "left_semi").select(F.col("parent").alias("up"), "name", F.col("inode").alias("at")), "dirs")
    level = keep(dentry.sparkSession.sql(f"select cast({ROOT} as bigint) as at, '' as path, array(cast({ROOT} as bigint)) as seen"), "level")
    found, depth = level, 1
    while (max_depth is None or depth < max_depth) and not level.isEmpty():
        step = level.select(F.col("at").alias("up"), F.col("path").alias("above"), "seen").join(dirs, "up").where(~F.array_contains("seen", F.col("at")))
        level = keep(step.select("at", F.concat("above", F.lit("/"), "name").alias("path"), F.concat("seen", F.array("at")).alias("seen")), "level")
        found, depth = found.unionByName(level), depth + 1
    entries = dentry if asked is None else dentry.join(asked.select("inode").distinct(), "inode", "left_semi")
    under = entries.select("inode", F.col("parent").alias("at"), "name").join(found, "at").where(~F.array_contains("seen", F.col("inode"))).select("inode", F.concat("path", F.lit("/"), "name").alias("path"))
    root = (dentry if asked is None else asked).where(F.col("inode") == ROOT).select("inode", F.lit("/").alias("path"))
    return under.unionByName(root).distinct()


def walk(dentry: DataFrame, asked: DataFrame) -> DataFrame:
    """``path``, ``inode`` and ``type`` of each asked path; null inode if a part is missing or lies under a non-directory.

    Paths share their directories: those of all paths are found first, the directories of these before, and so on, each once.
    """
    down = dentry.select(F.col("parent").alias("at"), F.col("name").alias("part"), "inode", "type")
    parts = path_parts(F.col("path"))
    paths = asked.select("path").distinct()
    level = paths.select("path", F.array_join(parts, "/").alias("way"))
    levels = []
    while True:  # ends with the longest path's parts
        below = level.where("way <> ''").withColumn("part", F.substring_index("way", "/", -1)).withColumn("above", F.expr("substring(way, 1, length(way) - length(part) - 1)"))
        levels.append(below)
        level = keep(below.select(F.col("above").alias("way")).distinct(), "ways")
        if level.where("way <> ''").isEmpty():
            break
    root = dentry.sparkSession.sql(f"select '' as above, cast({ROOT} as bigint) as at")
    found = root
    for below in reversed(levels[1:]):
        hit = below.join(found, "above").join(down, ["at", "part"]).where(F.coalesce("type", F.lit(0)) == 1)
        found = keep(hit.select(F.col("way").alias("above"), F.col("inode").alias("at")), "walk").unionByName(root)
    done = levels[0].join(found, "above").join(down, ["at", "part"]).select("path", "inode", "type")
    done = done.unionByName(paths.where(F.size(parts) == 0).select("path", F.lit(ROOT).cast("bigint").alias("inode"), F.lit(1).alias("type")))
    return paths.join(done, "path", "left")


def resolve(dentry: DataFrame, targets: DataFrame, asked: DataFrame, *, follow: bool = True, max_links: int = 40) -> DataFrame:
    """``path``, ``inode`` and ``outcome`` (ok, missing, not a directory, too many links) of each asked path, through symbolic links.

    ``targets`` has ``inode`` and ``target`` of links. A link in the middle of a path is always followed, one at its end if
    ``follow``. A followed link starts the walk anew from the root: a relative target counts from the directory that holds the
    link, and what is left of the path comes after it. All paths take their next step together, one join a step.
    """
    down = dentry.join(targets.select("inode", "target"), "inode", "left").select(F.col("parent").alias("at"), F.col("name").alias("part"), F.col("inode").alias("to"), F.col("type").alias("to_type"), "target")
    down = keep(down, "entries")  # every step reads it
    tasks = asked.count() // TASK_PATHS + 1
    paths = asked.select("path").repartition(tasks, "path").distinct()  # dealt out first, as few tasks may read many paths
    columns = ["path", "parts", "at", "type", "i", "links"]
    verdict = F.when(F.col("links") >= max_links, "too many links").when(F.col("i") >= F.size("parts"), "ok").when(F.coalesce("type", F.lit(0)) != 1, "not a directory")
    start = paths.select("path", path_parts(F.col("path")).alias("parts"), F.lit(ROOT).cast("bigint").alias("at"), F.lit(1).alias("type"), F.lit(0).alias("i"), F.lit(0).alias("links"))
    judged = keep(start.withColumn("outcome", verdict), "resolve")
    done = judged.where("outcome is not null").select("path", F.when(F.col("outcome") == "ok", F.col("at")).alias("inode"), "outcome")
    live = judged.where("outcome is null").select(*columns)
    while not live.isEmpty():  # ends with the longest path, or with the limit of links
        step = live.withColumn("part", F.get("parts", F.col("i"))).join(down, ["at", "part"], "left")
        tail = F.col("i") + 1 == F.size("parts")
        jump = F.col("target").isNotNull() & (~tail | F.lit(follow))
        base = F.concat(F.lit("/"), F.array_join(F.slice("parts", F.lit(1), F.col("i")), "/"))
        whole = F.concat_ws("/", F.when(~F.startswith("target", F.lit("/")), base), "target", F.array_join(F.slice("parts", F.col("i") + 2, F.size("parts")), "/"))
        after = F.when(jump, F.struct(path_parts(normal_path(whole)).alias("parts"), F.lit(ROOT).cast("bigint").alias("at"), F.lit(1).alias("type"), F.lit(0).alias("i"), (F.col("links") + 1).alias("links")))
        after = after.otherwise(F.struct("parts", F.col("to").alias("at"), F.col("to_type").alias("type"), (F.col("i") + 1).alias("i"), "links"))
        moved = step.select("path", after.alias("s"), F.when(F.col("to").isNull(), "missing").alias("lost")).select("path", "s.*", "lost")
        judged = keep(moved.select(*columns, F.coalesce("lost", verdict).alias("outcome")), "resolve")  # written once, whether a path ends or goes on
        ended = judged.where("outcome is not null").select("path", F.when(F.col("outcome") == "ok", F.col("at")).alias("inode"), "outcome")
        done, live = done.unionByName(ended), judged.where("outcome is null").select(*columns)
    return done


def names(dentry: DataFrame, asked: DataFrame) -> DataFrame:
    """``inode``, ``parent``, ``name`` and ``place`` of all names of the asked inodes, by parent and name; the root's is ``/`` without
    a parent, and a directory has one name."""
    wanted = asked.select("inode").distinct()
    w = Window.partitionBy("inode").orderBy("parent", "name")
    found = dentry.where(F.col("inode") != ROOT).join(wanted, "inode", "left_semi").withColumn("place", F.row_number().over(w).cast("bigint"))
    found = found.where((F.col("type") != 1) | (F.col("place") == 1)).select("inode", "parent", "name", "place")
    return found.unionByName(wanted.where(F.col("inode") == ROOT).select("inode", F.lit(None).cast("bigint").alias("parent"), F.lit("/").alias("name"), F.lit(1).cast("bigint").alias("place")))


def xattrs(known: DataFrame) -> DataFrame:
    """``inode``, ``names`` in order and ``values`` by name."""
    pairs = F.sort_array(F.collect_list(F.struct("name", "value")))
    return known.groupBy("inode").agg(pairs.alias("p")).select("inode", F.col("p.name").alias("names"), F.map_from_entries("p").alias("values"))


def replay(dentry: DataFrame, ops: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The entries after operations ``seq``, ``op`` (create, mkdir, link, unlink), ``parent``, ``name``, ``inode``, ``type``, and the
    ``outcome`` of each ``seq``.

    After an operation a name is there, or is gone, whether it succeeded or not, so an outcome depends only on the one before
    it on that name. Creating fails on a name that is there (exists), unlinking on one that is not (missing). A directory is
    the exception: from the first that takes a name on, nothing here removes it (is a directory).
    """
    first = dentry.select(F.lit(-1).cast("bigint").alias("seq"), F.lit("there").alias("op"), "parent", "name", "inode", "type")
    rows = ops.select(F.col("seq").cast("bigint").alias("seq"), "op", "parent", "name", "inode", "type").unionByName(first)
    name = Window.partitionBy("parent", "name")
    makes, last = F.col("op") != "unlink", F.lag("op").over(name.orderBy("seq"))
    rows = rows.withColumn("__absent", last.isNull() | (last == "unlink")).withColumn("__run", F.sum(F.when(last == "unlink", 1).otherwise(0)).over(name.orderBy("seq")))
    took = makes & F.col("__absent") & (F.col("type") == 1)
    rows = rows.withColumn("__dir", F.min(F.when(took, F.struct("seq", "inode", "type"))).over(name))
    rows = rows.withColumn("__holder", F.min(F.when(makes, F.struct("seq", "inode", "type"))).over(Window.partitionBy("parent", "name", "__run")))
    fixed = F.coalesce(F.col("seq") > F.col("__dir.seq"), F.lit(False))
    outcome = F.when(fixed & ~makes, "is a directory").when(makes, F.when(F.col("__absent") & ~fixed, "ok").otherwise("exists")).otherwise(F.when(F.col("__absent"), "missing").otherwise("ok"))
    ends = rows.groupBy("parent", "name").agg(F.max_by(F.when(makes, F.col("__holder")), "seq").alias("file"), F.first("__dir").alias("dir"))
    held = F.coalesce("dir", "file")
    entries = ends.where(held.isNotNull()).select("parent", "name", held.getField("inode").alias("inode"), held.getField("type").alias("type"))
    return entries, rows.where("op <> 'there'").select("seq", outcome.alias("outcome"))


def link_changes(files: DataFrame, dentry: DataFrame, ops: DataFrame) -> DataFrame:
    """``inode``, ``nlink``, ``deleted`` and ``parent`` of files after unlinking the entries ``ops`` (``parent``, ``name``).

    A file without entries is deleted, with no links and parent 0; one with one left has its directory for a parent; one with
    more keeps the parent it had.
    """
    gone = dentry.join(ops.select("parent", "name").distinct(), ["parent", "name"], "left_semi").where("type <> 1").groupBy("inode").agg(F.count("*").alias("n"))
    left = dentry.join(ops.select("parent", "name").distinct(), ["parent", "name"], "left_anti").groupBy("inode").agg(F.min("parent").alias("one"))
    rows = files.join(gone, "inode").join(left, "inode", "left")
    n = F.greatest(F.col("nlink") - F.col("n"), F.lit(0)).cast("bigint")
    return rows.select("inode", n.alias("nlink"), (n == 0).alias("deleted"), F.when(n == 0, 0).when(n == 1, F.coalesce("one", "parent")).otherwise(F.col("parent")).cast("bigint").alias("parent"))


def listing(dentry: DataFrame, attrs: DataFrame, acls: DataFrame) -> DataFrame:
    """Entries with their attributes and ``has_acl``; ``acls`` has ``inode`` and ``value``."""
    marked = acls.where(F.length("value") > 0).select("inode").distinct().withColumn("has_acl", F.lit(True))
    return dentry.join(attrs, "inode").join(marked, "inode", "left").withColumn("has_acl", F.coalesce("has_acl", F.lit(False)))


def trash(attrs: DataFrame, origins: DataFrame) -> DataFrame:
    """Deleted inodes with the path they had (``origins``: ``inode``, ``value`` as JSON), else one made of the id."""
    gone = attrs.where("deleted")
    path = F.coalesce(F.get_json_object("value", "$.path"), F.concat(F.lit("inode:"), F.col("inode").cast("string")))
    return gone.join(origins.select("inode", "value"), "inode", "left").select("inode", "size", path.alias("path"), F.col("inode").cast("string").alias("order_key"))


def rename_allowed(moves: DataFrame, dentry: DataFrame) -> DataFrame:
    """``verdict`` of each move (``src_inode``, ``src_type``, ``dst_inode``, ``dst_type``; nulls: no target)."""
    full = dentry.select(F.col("parent").alias("dst_inode")).distinct().withColumn("__full", F.lit(True))
    verdict = (
        F.when(F.col("dst_inode").isNull(), "ok").when(F.col("src_inode") == F.col("dst_inode"), "same")
        .when((F.col("src_type") == 1) & (F.col("dst_type") != 1), "not a directory").when((F.col("src_type") != 1) & (F.col("dst_type") == 1), "is a directory")
        .when((F.col("dst_type") == 1) & F.col("__full"), "not empty").otherwise("ok")
    )
    return moves.join(full, "dst_inode", "left").withColumn("verdict", verdict).drop("__full")


def set_xattrs(asked: DataFrame, known: DataFrame) -> DataFrame:
    """``outcome`` of setting attributes (``inode``, ``name``, ``flag``: create, replace or null): insert, update, exists or missing."""
    there = known.select("inode", "name").distinct().withColumn("__there", F.lit(True))
    has = F.coalesce("__there", F.lit(False))
    outcome = F.when(has & (F.col("flag") == "create"), "exists").when(~has & (F.col("flag") == "replace"), "missing").when(has, "update").otherwise("insert")
    return asked.join(there, ["inode", "name"], "left").withColumn("outcome", outcome).drop("__there")


def set_attrs(attrs: DataFrame, changes: DataFrame, columns: list[str]) -> DataFrame:
    """Attributes with the given columns replaced where a change has a value."""
    new = changes.select("inode", *[F.col(c).alias(f"__{c}") for c in columns])
    return attrs.join(new, "inode", "left").withColumns({c: F.coalesce(f"__{c}", c) for c in columns}).drop(*[f"__{c}" for c in columns])


def renamed(dentry: DataFrame, moves: DataFrame) -> DataFrame:
    """``id``, ``outcome`` and the inodes ``src_after``, ``dst_after`` under both names after each move, each judged alone.

    ``moves`` has ``id``, ``src_parent``, ``src_name``, ``dst_parent``, ``dst_name`` and ``flag``: null replaces a target, ``noreplace``
    fails if there is one (exists), ``exchange`` swaps both and fails without one (missing).
    """
    side = lambda x: dentry.select(F.col("parent").alias(f"{x}_parent"), F.col("name").alias(f"{x}_name"), F.col("inode").alias(f"{x}_inode"), F.col("type").alias(f"{x}_type"))
    rows = moves.join(side("src"), ["src_parent", "src_name"], "left").join(side("dst"), ["dst_parent", "dst_name"], "left")
    plain = rename_allowed(rows, dentry)
    none = F.col("dst_inode").isNull()
    swap, strict = F.coalesce(F.col("flag") == "exchange", F.lit(False)), F.coalesce(F.col("flag") == "noreplace", F.lit(False))
    outcome = F.when(F.col("src_inode").isNull() | (swap & none), "missing").when(swap, "ok").when(strict & ~none, "exists").otherwise(F.col("verdict"))
    done = plain.withColumn("outcome", outcome)
    ok = F.col("outcome") == "ok"
    src = F.when(~ok, F.col("src_inode")).when(swap, F.col("dst_inode"))
    return done.select("id", "outcome", src.alias("src_after"), F.when(ok, F.col("src_inode")).otherwise(F.col("dst_inode")).alias("dst_after"))


def fallocate(asked: DataFrame, attrs: DataFrame, block: int = 4096) -> DataFrame:
    """``size`` and ``blocks`` (of 512 bytes) after reserving ranges: the largest end, and the aligned span of every call added to
    the blocks that the file had, or without a record of them those of its size."""
    div = lambda c, by: F.call_function("div", c, F.lit(by).cast("bigint"))
    end = F.col("off") + F.col("len")
    span = (div(end + (block - 1), block) - div(F.col("off"), block)) * (block // 512)
    sums = asked.where("len > 0").groupBy("inode").agg(F.max(end).alias("end"), F.sum(span).alias("added"))
    had = F.coalesce("blocks", div(F.col("size") + 511, 512)) if "blocks" in attrs.columns else div(F.col("size") + 511, 512)
    return attrs.join(sums, "inode", "left").select("inode", F.greatest("size", F.coalesce("end", "size")).alias("size"), (had + F.coalesce("added", F.lit(0))).alias("blocks"))

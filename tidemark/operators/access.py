"""Permissions and byte-range locks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.extents import merge_runs, visible

READ, WRITE, UNLOCK = 0, 1, 2
#: Permission bits of owner, group and others by right, and the right's ACL flag.
MASKS = {"read": (0o400, 0o040, 0o004, 4), "write": (0o200, 0o020, 0o002, 2), "execute": (0o100, 0o010, 0o001, 1)}


def allowed(right: str, uid: Column, gids: Column, mode: Column, owner: Column, group: Column, acl: Column | None = None) -> Column:
    """Whether a user may: root always, an ACL entry can only grant, else the first of owner, group and others that fits.

    ``gids`` is an array; ``acl`` an array of ``struct<kind, id, flags>`` with kinds user, group and other.
    """
    of_owner, of_group, of_other, flag = MASKS[right]
    has = lambda m: mode.bitwiseAND(m) != 0
    classed = F.when(uid == owner, has(of_owner)).when(F.array_contains(gids, group), has(of_group)).otherwise(has(of_other))
    granted = F.lit(False)
    if acl is not None:
        fits = lambda e: ((e["kind"] == "user") & (e["id"] == uid)) | ((e["kind"] == "group") & F.array_contains(gids, e["id"])) | (e["kind"] == "other")
        granted = F.coalesce(F.exists(acl, lambda e: fits(e) & (e["flags"].bitwiseAND(flag) == flag)), F.lit(False))
    return (uid == 0) | granted | classed


def acl_entry_error(scope: Column, tag: Column, id_: Column, perm: Column) -> Column:
    """What is wrong with an ACL entry; null if nothing is."""
    named = tag.isin("user", "group")
    return (
        F.when(~scope.isin("access", "default"), "scope").when(~tag.isin("user_obj", "user", "group_obj", "group", "mask", "other"), "tag")
        .when(~perm.rlike("^[r-][w-][x-]$"), "perm").when(named & id_.isNull(), "id missing").when(~named & id_.isNotNull(), "id given")
    )


def acl_errors(entries: DataFrame) -> DataFrame:
    """``acl`` and ``error`` of each ACL (rows ``acl``, ``place``, ``scope``, ``tag``, ``id``, ``perm``): the first wrong entry,
    else missing base entries of an access ACL; null if it is valid."""
    marked = entries.withColumn("e", acl_entry_error(F.col("scope"), F.col("tag"), F.col("id"), F.col("perm")))
    has = lambda t: F.max(((F.col("scope") == "access") & (F.col("tag") == t)).cast("int")) == 1
    base = has("user_obj") & has("group_obj") & has("other")
    some = F.max((F.col("scope") == "access").cast("int")) == 1
    return marked.groupBy("acl").agg(F.min_by("e", F.when(F.col("e").isNotNull(), F.col("place"))).alias("first"), (some & ~base).alias("short")).select("acl", F.coalesce("first", F.when(F.col("short"), "base entries")).alias("error"))


#: Width of the spans by which locks meet, and how many of them a lock may touch before it counts as wide.
LOCK_SPAN, WIDE = 4 << 10, 16


def conflicts(asked: DataFrame, held: DataFrame) -> DataFrame:
    """``seq`` of asked and held locks of one inode that overlap, of different owners, one of them a writer.

    Locks meet in the spans of the file that they touch, each pair in the first that both do, so work in a busy file follows
    its overlaps. Wide locks, which overlap most others, meet the locks of their file.
    """
    spans = F.sequence(F.floor(F.col("start_off") / LOCK_SPAN), F.floor((F.col("end_off") - 1) / LOCK_SPAN))
    wide = F.col("end_off") - F.col("start_off") > WIDE * LOCK_SPAN
    q, h = ({"all": t, "wide": t.where(wide), "short": t.where(~wide).withColumn("span", F.explode(spans))} for t in (df.where(F.col("lock_type").isin(READ, WRITE) & (F.col("end_off") > F.col("start_off"))) for df in (asked, held)))

    def met(a: DataFrame, b: DataFrame, by_span: bool) -> DataFrame:
        one, two = a.alias("q"), b.alias("h")
        clash = (F.col("q.inode") == F.col("h.inode")) & (F.col("q.owner") != F.col("h.owner")) & ((F.col("q.lock_type") == WRITE) | (F.col("h.lock_type") == WRITE))
        clash = clash & (F.col("q.end_off") > F.col("h.start_off")) & (F.col("q.start_off") < F.col("h.end_off"))
        if by_span:
            clash = clash & (F.col("q.span") == F.col("h.span")) & (F.col("q.span") == F.floor(F.greatest("q.start_off", "h.start_off") / LOCK_SPAN))
        pairs = one.join(two, clash)
        return pairs.select(F.col("q.inode"), F.col("q.seq").alias("seq"), F.col("h.seq").alias("held_seq"), F.col("h.owner").alias("held_owner"), F.col("h.start_off"), F.col("h.end_off"), F.col("h.lock_type").alias("held_type"))

    narrow = asked.where(~wide & F.col("lock_type").isin(READ, WRITE) & (F.col("end_off") > F.col("start_off")))
    return met(q["short"], h["short"], True).unionByName(met(q["wide"], h["all"], False)).unionByName(met(narrow, h["wide"], False))


def blocking(asked: DataFrame, held: DataFrame) -> DataFrame:
    """The first held lock that blocks each asked one."""
    one = conflicts(asked, held).groupBy("inode", "seq").agg(F.min(F.struct("held_seq", "held_owner", "start_off", "end_off", "held_type")).alias("b"))
    return one.select("inode", "seq", "b.*")


def locked_ranges(ops: DataFrame) -> DataFrame:
    """What each owner holds after its lock and unlock operations in order of ``seq``.

    A later operation replaces what it covers, so the newest one on each byte decides; unlocked bytes drop out and adjacent
    ranges of one type (and pid, if there is one) merge.
    """
    keys = ("inode", "owner")
    tag = ["lock_type", *(["pid"] if "pid" in ops.columns else [])]
    rows = ops.select(*keys, "seq", F.col("start_off").alias("off"), (F.col("end_off") - F.col("start_off")).alias("len"), F.struct(*tag).alias("tag"))
    won = visible(rows, "seq", keys, "tag", span=1 << 10).select(*keys, "lo", "hi", "tag.*").where(F.col("lock_type") != UNLOCK)
    return merge_runs(won, list(keys), "lo", "hi", tag)


def allowed_writes(writes: DataFrame) -> DataFrame:
    """The parts of each write that no newer request had covered when it arrived.

    ``writes`` has ``chunk_id``, ``seq`` (arrival), ``unique`` (request number; 0 always passes and leaves no trace), ``off`` and
    ``len``. Each elementary range keeps a running maximum of request numbers in order of arrival.
    """
    from tidemark.operators.extents import SPAN, _in_spans

    place = ["chunk_id", "block"]
    traced = writes.where("len > 0 and unique <> 0")
    pieces = _in_spans(traced, SPAN).select(*place, "lo", "hi", "seq", "unique")
    edges = pieces.select(*place, "lo").union(pieces.select(*place, F.col("hi").alias("lo"))).distinct()
    steps = edges.withColumn("to", F.lead("lo").over(Window.partitionBy(*place).orderBy("lo"))).where("to is not null")
    rows = steps.join(pieces.select(*place, F.col("lo").alias("a"), F.col("hi").alias("b"), "seq", "unique"), place).where("a <= lo and b >= to")
    past = F.max("unique").over(Window.partitionBy(*place, "lo").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1))
    kept = rows.withColumn("past", past).where("past is null or past <= unique").select("chunk_id", "seq", "lo", F.col("to").alias("hi"))
    free = writes.where("len > 0 and unique = 0").select("chunk_id", "seq", F.col("off").alias("lo"), (F.col("off") + F.col("len")).alias("hi"))
    return merge_runs(kept.unionByName(free), ["chunk_id", "seq"], "lo", "hi", [])


def upsert_acl(rules: DataFrame, updates: DataFrame) -> DataFrame:
    """ACL rules after updates (``inode``, ``acl_type``, ``qualifier``, ``permissions``, ``seq``): the last of each key, else the old."""
    key = ["inode", "acl_type", "qualifier"]
    rows = rules.select(*key, "permissions", F.lit(-1).cast("bigint").alias("seq")).unionByName(updates.select(*key, "permissions", F.col("seq").cast("bigint").alias("seq")))
    return rows.groupBy(*key).agg(F.max_by("permissions", "seq").alias("permissions"))

"""N-gram Jaccard join: documents linked by the similarity of their shingle sets, and the groups that the links make.

Sets are compared as sets of 64-bit shingle hashes; equal sets are one node. The join is exact, in these steps:

1. Signatures. Sizes are cut into classes so narrow that linked sets are in the same or neighbouring classes. A class has so
   many parts of the hash range that two linked sets must agree in a part that is not empty: they differ in at most H hashes,
   each of which spoils one part, and there are H + 1 parts and some more for those empty in both. A set signs each of its
   parts in its own and the next lower class; only nodes with a common signature can be linked. A signature covers about five
   shingles, so a passage that many documents share, but little else, brings them together rarely.
2. Groups. Each node joins the group of one of its signatures, first the one that a seeded order puts first, so similar nodes
   meet, and in later rounds the one that most nodes have, so large families of texts do; a group is cut into blocks of at most ``BLOCK`` nodes and ``BLOCK_TOKENS`` tokens. In a block, a matrix of tokens against
   subgroups holds the union of each subgroup's tokens; the overlap of a node with a union bounds its overlap with every
   member, and only subgroups that the bound does not exclude are opened. Signatures are the tokens of a first matrix, which
   leaves the few nodes that may link; the shingles of those are the tokens of a second. A node of each linked part then
   stands for it in the next round, until rounds find no more, so a large group of copies shrinks by the size of a block
   each time.
3. Between groups. Where a signature still has nodes of different parts, those of the smaller part are queries to the blocks
   that have nodes of the larger. The matrix of signatures against blocks is a table, and a query's overlap with a block is a
   sum over its join. Blocks that this bound does not exclude have the union of their tokens stored, one row each; queries
   are held against the unions, and only blocks that qualify are opened and their members compared.

Nothing is collected and no pair within a group becomes a row: only links leave a block, one for each linked part.
Signatures with so many nodes that they would burden one task are found in a sample, which decides where rows go but not
what comes out; their rows are dealt over ``SALT`` tasks.

Null texts and texts without words have no shingles and link with nothing. Fewer words than ``k`` make one shingle of them
all. Repeated rows and equal texts are one node and so in one group, as are ties: a link needs at least ``percent``. Rows
with a null id have a null component and link nothing. A text of any length is one row's work, at about 50 bytes of memory
a byte of it. An empty table gives an empty result; other columns are ignored, and kept by ``one_of_each``.

Two sets are one node if two independent hashes of them agree; a node whose second hashes differ makes the join start over
with another seed. Shingles are known by their hash alone.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.durable import release, save
from tidemark.llm.graph import components
from tidemark.llm.session import batches_of
from tidemark.llm.textvec import U64, chunks, hashes, mix, shingles, words

BLOCK = 1024
BLOCK_TOKENS = 1 << 20
#: Nodes of a subgroup in a block.
SUBGROUP = 32
_COLUMNS = 1 << 12
#: Bytes of an Arrow batch; executors hold several copies of one, outside the heap and in workers.
BATCH = 2 << 20
#: Sets that a task remembers having signed, so that copies sign once a task.
_SEEN = 1 << 20
#: Tasks over which the rows of a hot key are dealt.
SALT = 16
#: One in so many documents looks for hot signatures; one is hot if so many of these have it.
_SAMPLED, _HOT = 64, 32
#: Documents whose tokens are wanted that are named to all workers (about 30 MB); more of them meet their texts in a shuffle.
MAX_SENT_IDS = 1 << 18


def sets(data: np.ndarray, off: np.ndarray, k: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all rows, ascending within a row, how many each row has, and two hashes of each set."""
    w = words(data, off)
    h, row = shingles(hashes(w), w.count, k)
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    h, row = h[new], row[new]
    n = np.bincount(row, minlength=len(off) - 1)
    total = np.zeros((2, len(n)), U64)
    some = np.flatnonzero(n)
    if len(some):
        at = (np.cumsum(n) - n)[some]
        total[0, some] = np.add.reduceat(mix(h ^ U64(0x2545F4914F6CDD1D + seed)), at)
        total[1, some] = np.bitwise_xor.reduceat(mix(h * U64(0xE7037ED1A0B428DB)), at)
    return h, n, mix(total[0] + n.astype(U64)), total[1]


class Classes:
    """Classes of set sizes for a threshold in per cent, and the parts and spare parts of each."""

    def __init__(self, percent: int, largest: int) -> None:
        edges, parts, spare, live, most = [1], [], [], [], []
        while edges[-1] <= largest:
            edges.append(max(edges[-1] + 1, -(-100 * edges[-1] // percent)))
            differ = (edges[-1] - 1) * (100 - percent) // percent
            more = 1 + (differ + 1) // 32
            parts.append(differ + 1 + more)
            spare.append(more)
            live.append(differ > 0)
            most.append(differ)
        self.percent, self.edges, self.most = percent, np.array(edges), np.array(most)
        self.parts, self.spare, self.live = np.array(parts), np.array(spare), np.array(live)

    def of(self, n: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.edges, n, side="right") - 1

    def least(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Fewest common signatures of linked sets of sizes ``a`` and ``b``, or more than they can have if sizes rule it out.

        They agree in all parts of the smaller one's class but one for each hash in which they differ, and at most the
        spare parts are not signed because they are empty.
        """
        small, large = np.minimum(a, b), np.maximum(a, b)
        differ = (a + b) * (100 - self.percent) // (100 + self.percent)
        return np.where(100 * small < self.percent * large, 1 << 40, 1 + self.most[self.of(small)] - differ)


def signatures(h: np.ndarray, n: np.ndarray, classes: Classes) -> tuple[np.ndarray, np.ndarray]:
    """Signatures of the sets that stand end to end in ``h``, and the row of each."""
    row = np.repeat(np.arange(len(n)), n)
    own = np.maximum(classes.of(n), 0)
    out, of = [], []
    for cls in (own, own - 1):
        live = (n > 0) & (cls >= 0) & classes.live[np.maximum(cls, 0)]
        keep = live[row]
        if not keep.any():
            continue
        r, x = row[keep], h[keep]
        parts = classes.parts[np.maximum(cls, 0)]
        part = ((x >> U64(32)) * parts[r].astype(U64)) >> U64(32)
        new = np.ones(len(r), bool)
        new[1:] = (r[1:] != r[:-1]) | (part[1:] != part[:-1])
        at = np.flatnonzero(new)
        content = np.add.reduceat(mix(x), at)
        r, part = r[at], part[at]
        seed = cls.astype(np.int64).astype(U64) * U64(0x9E3779B97F4A7C15)
        out.append(mix(mix(content) + seed[r] + part * U64(0xC2B2AE3D27D4EB4F)))
        of.append(r)
        used = np.bincount(r, minlength=len(n))
        for i in np.flatnonzero(live & (parts - used > classes.spare[np.maximum(cls, 0)])):  # rare: sign the empty parts too
            empty = np.setdiff1d(np.arange(parts[i]), part[r == i].astype(np.int64)).astype(U64)
            out.append(mix(mix(np.zeros(len(empty), U64)) + seed[i] + empty * U64(0xC2B2AE3D27D4EB4F)))
            of.append(np.full(len(empty), i))
    if not out:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    return np.concatenate(out), np.concatenate(of)


def least_in(n: Column, lo: Column, hi: Column, classes: Classes) -> Column:
    """A lower bound of ``Classes.least`` for a set of size ``n`` and any of sizes ``lo`` to ``hi``."""
    most = lambda c: F.element_at(F.lit(classes.most.tolist()), F.size(F.filter(F.lit(classes.edges.tolist()), lambda e: e <= c)))
    small = F.greatest(lo, F.ceil(n * classes.percent / 100.0)).cast("bigint")
    large = F.least(hi, F.floor(n * 100.0 / classes.percent)).cast("bigint")
    differ = lambda b: F.call_function("div", (n + b) * (100 - classes.percent), F.lit(100 + classes.percent).cast("bigint"))
    # Above n the bound falls with the other size; below it, the smallest class is set against the largest size.
    above = 1 + most(F.least(n, large)) - differ(large)
    below = F.when(small < n, 1 + most(small) - differ(F.least(n, hi)))
    return F.least(above, below)


def needed(a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """Common shingles that sets of sizes ``a`` and ``b`` need to be linked."""
    return -(-percent * (a + b) // (100 + percent))


def _i64(h: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(h).view(np.int64))


def nodes(rows: DataFrame, k: int, seed: int) -> DataFrame:
    """``id``, ``n``, ``node`` and ``second`` (two hashes of the set) of rows ``id``, ``text``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, off in chunks(batch.column(1)):
                _, n, node, second = sets(data, off, k, seed)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(n.astype(np.int64)), _i64(node), _i64(second)], names=["id", "n", "node", "second"])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, n bigint, node bigint, second bigint")


def signed(rows: DataFrame, k: int, seed: int, percent: int, largest: int, hot: np.ndarray) -> DataFrame:
    """``sig``, ``node`` and ``hot`` for the signatures of every text, copies once a task."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes, seen = Classes(percent, largest), set()
        for batch in batches:
            for _, _, data, off in chunks(batch.column(1)):
                h, n, node, _ = sets(data, off, k, seed)
                fresh = np.zeros(len(n), bool)
                for i, x in enumerate(node.tolist()):
                    if n[i] and x not in seen:
                        fresh[i] = True
                        seen.add(x)
                if len(seen) > _SEEN:
                    seen.clear()
                sig, row = signatures(h[np.repeat(fresh, n)], np.where(fresh, n, 0), classes)
                yield pa.RecordBatch.from_arrays([_i64(sig), _i64(node[row]), pa.array(np.isin(sig.view(np.int64), hot))], names=["sig", "node", "hot"])

    return rows.mapInArrow(sign, "sig bigint, node bigint, hot boolean")


def hot_signatures(rows: DataFrame, sign: Callable[[DataFrame, np.ndarray], DataFrame]) -> np.ndarray:
    """Signatures with so many nodes that one task would have far more than its share of rows; at most eight a partition."""
    spark = rows.sparkSession
    found = save(sign(rows.where(F.pmod(F.xxhash64("id"), F.lit(_SAMPLED)) == 0), np.zeros(0, np.int64)).distinct().groupBy("sig").count(), "sampled")
    total = found.agg(F.sum("count")).first()[0] or 0
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    top = found.where(F.col("count") >= max(_HOT, total // (8 * tasks))).select("sig").limit(8 * tasks).collect()
    return np.sort(np.array([r.sig for r in top], np.int64))


def salt(spread: Column, hot: Column | None = None) -> Column:
    """The task among ``SALT`` of a row of a hot key."""
    mine = F.pmod(F.xxhash64(spread), F.lit(SALT)).cast("int")
    return mine if hot is None else F.when(hot, mine).otherwise(0)


def with_facts(rows: DataFrame, facts: DataFrame, key: str, spread: str, hot: str | None = None, how: str = "inner") -> DataFrame:
    """``rows`` joined with the facts of their key, one row a key; the rows of a key (a hot one, if told) are dealt over ``SALT`` tasks."""
    every = F.sequence(F.lit(0), F.lit(SALT - 1))
    copied = facts.withColumn("__salt", F.explode(every if hot is None else F.when(F.col(hot), every).otherwise(F.array(F.lit(0)))))
    copied = copied if hot is None else copied.drop(hot)
    return rows.withColumn("__salt", salt(F.col(spread), None if hot is None else F.col(hot))).join(copied, [key, "__salt"], how).drop("__salt")


def shared(signed_rows: DataFrame) -> DataFrame:
    """``sig``, ``node``, ``hot`` for every signature that several nodes have."""

    def several(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sig, node, hot, known = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool), False  # the last row, whose successor is unseen
        out = lambda keep: pa.RecordBatch.from_arrays([pa.array(sig[keep]), pa.array(node[keep]), pa.array(hot[keep])], names=["sig", "node", "hot"])
        for batch in batches:
            sig, node, hot = (np.append(x, batch.column(i).to_numpy(zero_copy_only=False)) for i, x in enumerate((sig, node, hot)))
            if not len(sig):
                continue
            fresh = np.ones(len(sig), bool)
            fresh[1:] = (sig[1:] != sig[:-1]) | (node[1:] != node[:-1])
            sig, node, hot = sig[fresh], node[fresh], hot[fresh]
            same = sig[1:] == sig[:-1]
            keep = hot.copy()  # several nodes of the sample had it
            keep[1:] |= same
            keep[:-1] |= same
            keep[0] |= known
            last = keep[-1]
            keep[-1] = False
            yield out(keep)
            sig, node, hot, known = sig[-1:], node[-1:], hot[-1:], bool(last)
        if known:
            yield out(np.ones(len(sig), bool))

    dealt = signed_rows.withColumn("salt", salt(F.col("node"), F.col("hot"))).repartition("sig", "salt").select("sig", "node", "hot")
    return dealt.sortWithinPartitions("sig", "node").mapInArrow(several, "sig bigint, node bigint, hot boolean")


def classed(rows: DataFrame) -> DataFrame:
    """``sig``, ``node``, ``hot``, ``w`` and ``held`` of one signature for all that the same nodes have, ``w`` of them; ``held`` nodes."""
    held = rows.groupBy("sig", "hot").agg(F.count("*").alias("n"), F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("who"))
    one = held.groupBy("n", "who").agg(F.min_by(F.struct("sig", "hot"), "sig").alias("s"), F.count("*").alias("w")).select("s.*", "w", F.col("n").alias("held"))
    return with_facts(rows, one, "sig", "node", hot="hot")


def signed_sets(rows: DataFrame, firsts: DataFrame) -> DataFrame:
    """``node``, ``id``, ``n``, ``sigs`` (``sig``, ``w``, ``hot``, ``held``): the classes of signatures that a node shares; ``all``: how many."""
    each = rows.groupBy("node").agg(F.collect_list(F.struct("sig", "w", "hot", "held")).alias("sigs"), F.sum("w").alias("all"))
    return each.join(firsts.select("node", "id", "n"), "node").select("node", "id", "n", "all", "sigs")


def _flat(lists: pa.Array | pa.ChunkedArray) -> tuple[pa.Array, np.ndarray]:
    """The values of a column of lists end to end, and the row of each."""
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    return lists.flatten(), np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))


def overlaps(features: list[np.ndarray], rows: np.ndarray, into: np.ndarray, unions: int, weights: np.ndarray | None = None) -> np.ndarray:
    """Sizes of the overlaps of nodes ``rows`` with unions: node i belongs to union ``into[i]``, or to none below 0.

    ``weights`` has what each feature counts, for all features end to end; 1 without it.
    """
    n = len(features)
    member = np.repeat(np.arange(n), [len(f) for f in features])
    _, first, column, held = np.unique(np.concatenate(features), return_index=True, return_inverse=True, return_counts=True)
    common = held[column] > 1  # what one node alone has is no overlap of two
    kept = np.flatnonzero(held > 1)
    column, member = np.searchsorted(kept, column[common]), member[common]
    columns = len(kept)
    weight = np.ones(columns, np.float32) if weights is None else weights[first[kept]].astype(np.float32)
    out = np.zeros((len(rows), unions), np.float32)
    for lo in range(0, columns, _COLUMNS):
        part = (column >= lo) & (column < lo + _COLUMNS)
        own = np.zeros((n, min(_COLUMNS, columns - lo)), np.float32)
        own[member[part], column[part] - lo] = 1
        union = np.zeros((unions, own.shape[1]), np.float32)
        inside = part & (into[member] >= 0)
        union[into[member[inside]], column[inside] - lo] = 1
        out += own[rows] @ (union * weight[lo : lo + _COLUMNS]).T
    return out


def each_with(features: list[np.ndarray], rows: np.ndarray, columns: np.ndarray, weights: np.ndarray | None = None) -> np.ndarray:
    """Sizes of the overlaps of nodes ``rows`` with nodes ``columns``."""
    into = np.full(len(features), -1)
    into[columns] = np.arange(len(columns))
    return overlaps(features, rows, into, len(columns), weights)


def open_groups(group: np.ndarray, features: list[np.ndarray], need: np.ndarray, weights: np.ndarray | None = None) -> np.ndarray:
    """Which nodes of a block have ``need[i, j]`` features in common, by a token-group matrix: a symmetric table.

    Each group's features are united; a node's overlap with the union bounds that with any member, and only groups that the
    bound does not exclude are opened.
    """
    n = len(group)
    groups, of = np.unique(group, return_inverse=True)
    unions = np.arange(len(groups))
    order = np.argsort(of, kind="stable")
    least = np.minimum.reduceat(need[:, order], np.searchsorted(of[order], unions), axis=1)
    opened = overlaps(features, np.arange(n), of, len(groups), weights) >= least
    query, inside = np.flatnonzero(opened.any(axis=1)), np.flatnonzero(opened.any(axis=0)[of])
    good = np.zeros((n, n), bool)
    if len(query):
        good[np.ix_(query, inside)] = opened[query][:, of[inside]] & (each_with(features, query, inside, weights) >= need[np.ix_(query, inside)])
    good |= good.T
    np.fill_diagonal(good, False)
    return good


def subgroups(features: list[np.ndarray]) -> np.ndarray:
    """Subgroup of each node of a block: neighbours in the order of their smallest token, which similar sets often share."""
    place = np.empty(len(features), np.int64)
    place[np.argsort([f[0] if len(f) else 0 for f in features], kind="stable")] = np.arange(len(features))
    return place // SUBGROUP


def parts_of(linked: np.ndarray) -> np.ndarray:
    """The first node of each node's connected part."""
    n = len(linked)
    near, label = linked | np.eye(n, dtype=bool), np.arange(n)
    while True:
        new = np.where(near, label[None, :], n).min(axis=1)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def by_block(df: DataFrame, f: Callable[[pa.Table], pa.Table], schema: str) -> DataFrame:
    """``f`` of the rows of each ``home``, ``blk``, ``slice``, which stream past in order; a block is small, blocks are many.

    A node that comes twice, by repeated rows, counts once.
    """
    keys = ["home", "blk", "slice"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last, before = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            at = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in (*keys, "kind", "node")], axis=1)
            if before is not None:
                at = np.concatenate([before[None], at])
            fresh = np.append(before is None, (at[1:] != at[:-1]).any(axis=1))[-batch.num_rows :]
            before = at[-1]
            batch, at = batch.filter(pa.array(fresh)), at[-batch.num_rows :][fresh]
            if not batch.num_rows:
                continue
            cuts = [0, *(np.flatnonzero((at[1:, :3] != at[:-1, :3]).any(axis=1)) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts, cuts[1:]):
                key = tuple(at[a, :3])
                if held and key != last:
                    yield from f(pa.Table.from_batches(held)).to_batches()
                    held = []
                held.append(batch.slice(a, b - a))
                last = key
        if held:
            yield from f(pa.Table.from_batches(held)).to_batches()

    return df.repartition(*keys).sortWithinPartitions(*keys, "kind", "node").mapInArrow(run, schema)


_PLACE = "struct<home:bigint,blk:int,slice:int,kind:int,node:bigint,tag:bigint>"


def fetched(rows: DataFrame, wanted: DataFrame, k: int, seed: int) -> DataFrame:
    """``home``, ``blk``, ``slice``, ``kind``, ``node``, ``tag`` and ``tokens`` (hashes, ascending, as bytes) of what is wanted.

    ``wanted`` has these columns and ``id``, a document whose set is the node. Texts stay where they are if the documents are
    few enough to be named to all workers; only tokens travel, once to each block that wants them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, off in chunks(batch.column(0)):
                h, n, node, _ = sets(data, off, k, seed)
                end = np.cumsum(n)
                places, row = _flat(batch.column(1).slice(a, b - a))
                right = np.flatnonzero(places.field("node").to_numpy() == node.view(np.int64)[row])  # repeated ids may have several texts
                tokens = [h[end[i] - n[i] : end[i]].tobytes() for i in row[right].tolist()]
                kept = places.take(pa.array(right))
                yield pa.RecordBatch.from_arrays([*[kept.field(c) for c in ("home", "blk", "slice", "kind", "node", "tag")], pa.array(tokens, pa.binary())], names=["home", "blk", "slice", "kind", "node", "tag", "tokens"])

    asked = save(wanted.groupBy("id").agg(F.collect_list(F.struct("home", "blk", F.col("slice").cast("int").alias("slice"), F.col("kind").cast("int").alias("kind"), "node", F.col("tag").cast("bigint").alias("tag")).cast(_PLACE)).alias("places")), "wanted")
    few = asked.count() <= MAX_SENT_IDS
    there = rows.join(F.broadcast(asked) if few else asked, "id").select("text", "places")
    return there.mapInArrow(run, "home bigint, blk int, slice int, kind int, node bigint, tag bigint, tokens binary")


def _sets_of(table: pa.Table) -> tuple[list[np.ndarray], np.ndarray]:
    found = [np.frombuffer(t, U64) for t in table["tokens"].to_pylist()]
    return found, np.array([len(t) for t in found], np.int64)


def gathered(homed: DataFrame) -> DataFrame:
    """Moves homes to where most nodes with their signature live, so that a family of texts fills few blocks.

    Such a home is never a rarer signature, so moves have no cycle; three steps of a chain are taken together.
    """
    lived = homed.select("home", F.explode("sigs.sig").alias("sig")).groupBy("sig", "home").agg(F.count("*").alias("n"))
    best = lived.join(homed.select(F.col("home").alias("sig")).distinct(), "sig", "left_semi").groupBy("sig").agg(F.max(F.struct("n", "home")).getField("home").alias("to"))
    step = save(best.where("sig <> to").select(F.col("sig").alias("home"), "to"), "moves")
    whole = step
    for _ in range(2):
        whole = whole.join(step.select(F.col("home").alias("to"), F.col("to").alias("next")), "to", "left").select("home", F.coalesce("next", "to").alias("to"))
    return with_facts(homed, whole, "home", "node", how="left").withColumn("home", F.coalesce("to", "home")).drop("to")


def placed(active: DataFrame, seed: int, common: bool) -> DataFrame:
    """``active`` with ``home`` (the signature whose group a node joins, by a seeded order or the ``common`` ones first) and
    ``blk`` (its block there)."""
    order = lambda s: F.struct((-s["held"] if common else F.lit(0).cast("bigint")).alias("h"), F.xxhash64(s["sig"], F.lit(seed)).alias("o"), s["sig"].alias("sig"))
    first = F.array_min(F.transform("sigs", order))
    homed = active.withColumn("home", first.getField("sig"))
    homed = gathered(homed) if common else homed
    blocks = F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n") / BLOCK_TOKENS)).cast("int")
    large = homed.groupBy("home").agg(blocks.alias("blocks")).where("blocks > 1")
    return with_facts(homed, large, "home", "node", how="left").withColumn("blk", F.coalesce(F.pmod(F.xxhash64("node", F.lit(seed)), F.col("blocks")), F.lit(0)).cast("int")).drop("blocks")


def links_in_blocks(rows: DataFrame, active: DataFrame, k: int, seed: int, percent: int, largest: int) -> DataFrame:
    """``node`` and ``root``, a node of its part, of all nodes that link inside their blocks (``active`` with ``home``, ``blk``)."""
    classes = Classes(percent, largest)

    def sift(table: pa.Table) -> pa.Table:
        n = table["n"].to_numpy()
        keep = np.zeros(len(n), bool)
        if len(n) > 1:
            need = classes.least(n[:, None], n[None, :])
            np.fill_diagonal(need, 1 << 40)
            flat, row = _flat(table["sigs"])
            sigs = np.split(flat.field("sig").to_numpy(), np.flatnonzero(np.diff(row)) + 1)  # every node has some
            keep = open_groups(subgroups([np.sort(x) for x in sigs]), sigs, need, flat.field("w").to_numpy()).any(axis=1)
        return table.select(["home", "blk", "node", "id"]).filter(pa.array(keep))

    def verify(table: pa.Table) -> pa.Table:
        node = table["node"].to_numpy()
        found, n = _sets_of(table)
        part = parts_of(open_groups(subgroups(found), found, needed(n[:, None], n[None, :], percent)))
        some = np.bincount(part, minlength=len(part))[part] > 1
        return pa.table({"node": pa.array(node[some], pa.int64()), "root": pa.array(node[part][some], pa.int64())})

    kind = active.schema["id"].dataType.simpleString()
    dealt = active.select("home", "blk", F.lit(0).alias("slice"), F.lit(0).alias("kind"), "node", "id", "n", F.transform("sigs", lambda s: F.struct(s["sig"].alias("sig"), s["w"].alias("w"))).alias("sigs"))
    able = save(by_block(dealt, sift, f"home bigint, blk int, node bigint, id {kind}"), "able")
    wanted = able.select("id", "home", "blk", F.lit(0).alias("slice"), F.lit(0).alias("kind"), "node", F.lit(0).alias("tag"))
    return save(by_block(fetched(rows, wanted, k, seed), verify, "node bigint, root bigint"), "linked")


def least_for(n: Column, lo: Column, percent: int) -> Column:
    """Fewest common shingles of a set of size ``n`` and a linked one of at least ``lo``."""
    small = F.greatest(lo, F.ceil(n * percent / 100.0))
    return F.ceil(percent * (n + small) / (100.0 + percent) - 1e-9).cast("bigint")


def asked_blocks(members: DataFrame, percent: int, largest: int) -> DataFrame:
    """``node``, ``id``, ``n``, ``home``, ``blk``, ``lo``: queries and the blocks of larger parts that the signatures do not exclude.

    ``members`` has all nodes with ``sigs``, ``all``, ``n``, ``home``, ``blk`` and ``rank``, which is equal in a part and
    grows with its size. The matrix of signatures and blocks says where a block has a signature; a query's overlap with the
    block is a sum over the rows that they share.
    """
    each = members.select("node", "id", "n", "all", "home", "blk", "rank", F.explode("sigs").alias("s")).select("node", "id", "n", "all", "home", "blk", "rank", "s.*")
    facts = each.groupBy("sig", "hot").agg(F.min("rank").alias("low"), F.max("rank").alias("high"), F.min("n").alias("lo"), F.max("n").alias("hi")).where("low < high").drop("low", "high")
    mixed = with_facts(each, facts, "sig", "node", hot="hot")
    classes = Classes(percent, largest)
    mixed = save(mixed.where(F.col("all") >= least_in(F.col("n"), F.col("lo"), F.col("hi"), classes)).drop("lo", "hi", "all"), "mixed")
    matrix = mixed.groupBy("sig", "hot", "home", "blk").agg(F.max("rank").alias("top"), F.min("n").alias("lo"), F.max("n").alias("hi"))
    every = F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(SALT - 1))).otherwise(F.array(F.lit(0)))
    copied = matrix.select("sig", "home", "blk", "top", "lo", "hi", F.explode(every).alias("salt"))
    queries = mixed.select("sig", "node", "id", "n", "w", "rank", salt(F.col("node"), F.col("hot")).alias("salt"))
    fits = (F.col("rank") < F.col("top")) & (F.col("hi") * 100 >= F.col("n") * percent) & (F.col("lo") * percent <= F.col("n") * 100)
    met = queries.join(copied, ["sig", "salt"]).where(fits)
    sums = met.groupBy("node", "home", "blk").agg(F.first("id").alias("id"), F.first("n").alias("n"), F.sum("w").alias("both"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    return sums.where(F.col("both") >= least_in(F.col("n"), F.col("lo"), F.col("hi"), classes)).select("node", "id", "n", "home", "blk", "lo")


def links_between(rows: DataFrame, members: DataFrame, k: int, seed: int, percent: int, largest: int) -> DataFrame:
    """``a``, ``b``: a link of each query with each part of other blocks (``members``: see ``asked_blocks``, with ``comp``)."""

    def unite(table: pa.Table) -> pa.Table:
        union = np.unique(np.concatenate(_sets_of(table)[0]))
        return pa.table({"home": table["home"][:1], "blk": table["blk"][:1], "tokens": pa.array([union.tobytes()], pa.binary())})

    def bound(table: pa.Table) -> pa.Table:
        found, n = _sets_of(table)
        union, queries = found[0], table.slice(1)  # the union comes first
        flat, row = np.concatenate(found[1:] or [np.zeros(0, U64)]), np.repeat(np.arange(len(found) - 1), n[1:])
        at = np.minimum(np.searchsorted(union, flat), len(union) - 1)
        good = np.bincount(row, union[at] == flat, minlength=len(found) - 1) >= queries["tag"].to_numpy()
        return queries.select(["home", "blk", "slice", "node"]).filter(pa.array(good))

    def compare(table: pa.Table) -> pa.Table:
        node, kind, comp = (table[c].to_numpy() for c in ("node", "kind", "tag"))
        found, n = _sets_of(table)
        inside, query = np.flatnonzero(kind == 0), np.flatnonzero(kind == 1)
        x = y = np.zeros(0, np.int64)
        if len(inside) and len(query):
            good = each_with(found, query, inside) >= needed(n[query][:, None], n[inside][None, :], percent)
            good &= comp[query][:, None] != comp[inside][None, :]
            x, y = np.nonzero(good)
            _, one = np.unique(np.stack([x, comp[inside][y]]), axis=1, return_index=True)
            x, y = x[one], y[one]
        return pa.table({"a": pa.array(node[query[x]], pa.int64()), "b": pa.array(node[inside[y]], pa.int64())})

    ids = members.select("node", "id", "home", "blk", "comp")
    asked = save(asked_blocks(members, percent, largest), "asked")
    many = asked.groupBy("home", "blk").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("slices"))
    many = save(many, "slices")
    sliced = asked.join(many, ["home", "blk"]).withColumn("slice", F.pmod(F.xxhash64("node"), F.col("slices")).cast("int")).drop("slices")
    sliced = save(sliced, "sliced")
    inside = ids.join(many.select("home", "blk"), ["home", "blk"]).select("id", "home", "blk", F.lit(0).alias("slice"), F.lit(0).alias("kind"), "node", F.lit(0).alias("tag"))
    unions = save(by_block(fetched(rows, inside, k, seed), unite, "home bigint, blk int, tokens binary"), "unions")
    queries = sliced.select("id", "home", "blk", "slice", F.lit(1).alias("kind"), "node", least_for(F.col("n"), F.col("lo"), percent).alias("tag"))
    held = unions.join(many, ["home", "blk"]).select("home", "blk", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"), F.lit(0).alias("kind"), F.lit(0).cast("bigint").alias("node"), F.lit(0).cast("bigint").alias("tag"), "tokens")
    open_ = save(by_block(fetched(rows, queries, k, seed).unionByName(held), bound, "home bigint, blk int, slice int, node bigint"), "opened")
    release(rows.sparkSession)
    asking = open_.join(ids.select("node", "id", "comp"), "node").select("id", "home", "blk", "slice", F.lit(1).alias("kind"), "node", F.col("comp").alias("tag"))
    answering = ids.join(open_.select("home", "blk", "slice").distinct(), ["home", "blk"]).select("id", "home", "blk", "slice", F.lit(0).alias("kind"), "node", F.col("comp").alias("tag"))
    return save(by_block(fetched(rows, asking.unionByName(answering), k, seed), compare, "a bigint, b bigint"), "links")


def labels(rows: DataFrame, firsts: DataFrame, k: int, seed: int, percent: int, largest: int) -> DataFrame:
    """``node`` and ``comp``, one node of its group, of every node that links to another."""
    sign = lambda some, hot: signed(some, k, seed, percent, largest, hot)
    several = save(shared(sign(rows, hot_signatures(rows, sign))), "signatures")
    release(rows.sparkSession)  # the signatures' shuffle is the largest
    every = save(signed_sets(classed(several), firsts), "signed")
    found = links_in_blocks(rows, placed(every, seed, False), k, seed, percent, largest)
    nodes_ = save(placed(every, seed, True), "homes")
    active, rounds, turn = nodes_.join(found.where("node <> root").select("node"), "node", "left_anti"), [found], 0
    while not turn or not found.isEmpty():  # ends as every round leaves fewer parts
        turn += 1
        found = links_in_blocks(rows, active, k, seed, percent, largest)
        rounds.append(found)
        active = save(placed(every.join(found.select(F.col("root").alias("node")).distinct(), "node", "left_semi"), seed + turn, True), "active")
    release(rows.sparkSession)
    near = rounds.pop()
    for lower in reversed(rounds):  # a root has at most a block of nodes
        up = near.select(F.col("node").alias("root"), F.col("root").alias("top"))
        near = lower.join(up, "root", "left").select("node", F.coalesce("top", "root").alias("root")).unionByName(near.join(lower, "node", "left_anti"))
    near = save(near.withColumnRenamed("root", "comp"), "near")
    sizes = near.groupBy("comp").agg(F.count("*").alias("size"))
    ranked = with_facts(near, sizes, "comp", "node").select("node", "comp", F.struct("size", "comp").alias("rank"))
    alone = F.struct(F.lit(1).cast("bigint").alias("size"), F.col("node").alias("comp"))
    members = nodes_.join(ranked, "node", "left").withColumn("comp", F.coalesce("comp", "node")).withColumn("rank", F.coalesce("rank", alone))
    edges = links_between(rows, save(members, "members"), k, seed, percent, largest)
    merged = edges.join(near.select(F.col("node").alias("a"), F.col("comp").alias("x")), "a", "left").join(near.select(F.col("node").alias("b"), F.col("comp").alias("y")), "b", "left")
    over = components(merged.select(F.coalesce("x", "a").alias("a"), F.coalesce("y", "b").alias("b")))
    up = over.select(F.col("node").alias("comp"), F.col("comp").alias("top"))
    whole = near.unionByName(over.select("node", F.col("node").alias("comp")).join(near, "node", "left_anti"))
    return with_facts(whole, up, "comp", "node", how="left").select("node", F.coalesce("top", "comp").alias("comp"))


def join(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """``id_col``, ``n_shingles`` and ``component_id`` (the smallest id that links reach) of every row.

    Two documents link if their sets of ``k``-word shingles have a Jaccard similarity of at least ``percent`` in 100.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    named, seed, clash = rows.where("id is not null"), 0, True
    with batches_of(docs.sparkSession, BATCH):  # all Python work ends here, as its results are saved
        while clash:
            known = save(nodes(rows, k, seed), "nodes")
            firsts = save(known.where("n > 0 and id is not null").groupBy("node").agg(F.min("id").alias("id"), F.first("n").alias("n"), F.count("*").alias("docs"), (F.min("second") != F.max("second")).alias("clash")), "firsts")
            largest, clash = firsts.agg(F.max("n"), F.max("clash")).first()
            seed += bool(clash)
        whole = save(labels(named, firsts, k, seed, percent, int(largest or 0)), "whole")
    least = with_facts(firsts.join(whole, "node"), firsts.join(whole, "node").groupBy("comp").agg(F.min("id").alias("least")), "comp", "node").select("node", "least")
    copies = firsts.where("docs > 1").join(whole, "node", "left_anti").select("node", F.col("id").alias("least"))
    out = with_facts(known, least.unionByName(copies), "node", "id", how="left")
    alone = (F.col("n") == 0) | F.col("id").isNull()
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(alone, F.col("id")).otherwise(F.coalesce("least", "id")).alias("component_id"))


def one_of_each(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` without the documents that link to one with a smaller id; of repeated rows one stays."""
    found = join(docs, id_col=id_col, text_col=text_col, k=k, percent=percent)
    losers = found.where(F.col("component_id") < F.col(id_col)).select(id_col).distinct()
    left = docs.join(losers, id_col, "left_anti").select(docs.columns)
    repeated = docs.groupBy(id_col).count().where("count > 1").select(id_col)
    if repeated.isEmpty():
        return left
    again = save(repeated, "repeated")
    same = lambda how: left.join(again, left[id_col].eqNullSafe(again[id_col]), how)
    return same("left_anti").unionByName(same("left_semi").dropDuplicates())

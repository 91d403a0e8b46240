"""Connected components of an edge table by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.durable import save


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``comp`` of every node of the undirected edges ``a``, ``b`` (bigint); ``comp`` is one of its nodes.

    A round draws a new random order of the nodes and merges each node into the first of itself and its neighbours, which
    leaves a constant part of the nodes, in expectation, whatever the graph's shape. Every round is written out, and a node's
    neighbours are aggregated before the shuffle, so one node may have any number of them.
    """
    pairs = save(edges.where("a <> b").select("a", "b").distinct(), "edges")
    labels, turn = None, 0
    while not pairs.isEmpty():
        turn += 1
        order = lambda c: F.struct(F.xxhash64(F.lit(turn), c).alias("p"), F.col(c).alias("n"))  # noqa: E731, B023
        both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        moves = save(both.groupBy("a").agg(F.min(order("b")).alias("m")).select(F.col("a").alias("node"), F.least("m", order("a")).getField("n").alias("to")), "moves")
        labels = moves.select("node", F.col("to").alias("comp")) if labels is None else labels.join(moves, labels.comp == moves.node, "left").select(labels.node, F.coalesce("to", "comp").alias("comp"))
        labels = save(labels, "labels")
        left = pairs.join(moves.select(F.col("node").alias("a"), F.col("to").alias("x")), "a").join(moves.select(F.col("node").alias("b"), F.col("to").alias("y")), "b")
        pairs = save(left.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
    return labels if labels is not None else pairs.select(F.col("a").alias("node"), F.col("b").alias("comp"))

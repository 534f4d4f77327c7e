"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.llm.common import free_memory, materialize


def _state(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(
        F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b") % 1_000_003), F.lit(0))
    ).first()
    return row[0], row[1]


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of undirected edges (a, b); root: its component's least node.

    Each round hangs all larger neighbours of a node, then the node itself and its smaller
    neighbours, on the least of them, until every edge joins a node to its root. Rounds grow
    with the logarithm of a component's width; each is written out, so none recomputes
    another. A node with very many neighbours is one key of an inner join whose rows
    adaptive execution splits, and minima are taken before the shuffle. No edges, or nulls:
    no rows. Self-links give their node alone.
    """
    edges = edges.select("a", "b").where("a IS NOT NULL AND b IS NOT NULL")
    lone = edges.where("a = b").select(F.col("a").alias("node"), F.col("a").alias("root"))
    edges = materialize(
        edges.where("a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct(),
        "edges",
    )
    before = _state(edges)
    while before[0]:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m"))
        large = (
            both.join(least, "a")
            .where("b > a")
            .select(F.col("b").alias("a"), F.least("a", "m").alias("b"))
            .distinct()
        )
        # after a large star every edge points from a node to a smaller one
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = least.select("a", F.col("m").alias("b")).unionByName(
            large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        )
        edges = materialize(small.distinct(), "stars")
        after = _state(edges)
        free_memory(edges.sparkSession)
        if after == before:
            break
        before = after
    nodes = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return nodes.unionByName(roots).unionByName(lone).groupBy("node").agg(F.min("root").alias("root"))

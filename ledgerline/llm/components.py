"""Connected components by alternating large-star and small-star rounds.

Each round is a minimum per node (combined before the shuffle) and a join back, so
no neighbourhood is ever gathered in a task; edges are cut from their lineage in the
shared folder after each round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import scratch, stored


def _stars(edges: DataFrame, both_ways: bool) -> DataFrame:
    """One star operation on edges (a, b)."""
    if both_ways:
        around = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        around = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    # stored, so that the join back deals out both sides anew and a star's centre can be split
    least = stored(around.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "least")
    joined = around.join(least, "a")
    if both_ways:
        moved = joined.filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        moved = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(least.select("a", F.col("m").alias("b")))
    return moved.filter("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of ``edges`` (a long, b long); component is its least node.

    Loops, repeated edges and both directions are allowed; an edge with a null end is
    no edge. No edges give an empty frame. Each node is in exactly one row.
    """
    with scratch() as keep:
        return keep(_components(edges))


def _components(edges: DataFrame) -> DataFrame:
    now = stored(edges.select("a", "b").filter("a <> b").distinct(), "edges")
    before = None
    while True:
        # a fixed point of both operations is a set of stars around least nodes
        signature = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if signature[0] == 0 or signature == before:
            both = now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
            return stored(both, "components")
        before = signature
        now = stored(_stars(_stars(now, True), False), "edges")

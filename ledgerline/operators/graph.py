"""Reachability over edges, round by round."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: Removes the shuffle files of an execution when it ends.
_SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut(df: DataFrame, label: str = "walk") -> DataFrame:
    """A frame with its lineage cut: written to the folder that the cluster shares, where there is one.

    The shuffle files behind it go when it is written.
    """
    spark = df.sparkSession
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the cluster shares")
        return df.cache()
    path = f"{shared.rstrip('/')}/ledgerline/{label}-{uuid.uuid4().hex}"
    old = spark.conf.get(_SHUFFLE_CLEANUP)
    spark.conf.set(_SHUFFLE_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(_SHUFFLE_CLEANUP, old)
    return spark.read.schema(df.schema).parquet(path)


def walk(edges: DataFrame, seeds: DataFrame, max_depth: int | None = None) -> DataFrame:
    """(node, depth) of all nodes reached from ``seeds`` (node), which stand at depth 1; least depth, each node once.

    With ``max_depth`` the nodes at depth max_depth + 1 are reached but not followed, and
    have ``beyond`` true. Cycles end, as a node is followed once. Each round joins the
    edges with the last round's nodes and takes away what is known.
    """
    edges = cut(edges.select("src", "dst").distinct())  # once, not in every round
    reached = cut(seeds.select("node").distinct().withColumn("depth", F.lit(1)))
    frontier, rounds, depth = reached, [reached], 1
    while max_depth is None or depth <= max_depth:
        new = edges.join(frontier.select(F.col("node").alias("src")), "src").select(F.col("dst").alias("node")).distinct()
        known = rounds[0] if len(rounds) == 1 else _union(rounds)
        frontier = cut(new.join(known.select("node"), "node", "left_anti").withColumn("depth", F.lit(depth + 1)))
        if not frontier.take(1):
            break
        rounds.append(frontier)
        depth += 1
        if len(rounds) > 16:
            rounds = [cut(_union(rounds))]
    limit = max_depth if max_depth is not None else 1 << 30
    return _union(rounds).withColumn("beyond", F.col("depth") > limit)


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def impact(edges: DataFrame, seeds: DataFrame, max_depth: int | None = None) -> DataFrame:
    """One row: reached, beyond, truncated (there are seeds, but none may be followed)."""
    found = walk(edges, seeds, max_depth)
    return found.agg(F.count_if(~F.col("beyond")).alias("reached"), F.count_if("beyond").alias("beyond")).withColumn("truncated", (F.col("reached") == 0) & (F.col("beyond") > 0))

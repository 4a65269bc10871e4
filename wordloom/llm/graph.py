"""Connected components of an edge table, on DataFrames only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, functions as F

from ..functions.workdir import settle


def _stored(edges: DataFrame) -> tuple[DataFrame, tuple]:
    """The edges in the shared folder, with their number and a sum of their hashes."""
    seen = Observation()
    pair = F.xxhash64("a", "b").cast("decimal(38,0)")
    edges = settle(edges.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(pair).alias("s")), "edges")
    return edges, (seen.get["n"], seen.get["s"])


def connected_components(edges: DataFrame) -> DataFrame:
    """``node``, ``component`` (the smallest node reachable) of edges ``a``, ``b`` (long).

    Alternates two contractions until nothing moves: every node's larger neighbours attach to the
    smallest neighbour, then every node's smaller neighbours do. The number of rounds grows with
    the logarithm of the longest path; each round is written to the shared folder, so a lost
    executor costs one round at most.
    """
    edges = edges.where("a is not null and b is not null and a <> b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    )
    edges, before = _stored(edges.distinct())
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        lowest = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(lowest, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = small.where("a <> b").unionByName(lowest.select("a", F.col("m").alias("b")))
        edges, after = _stored(small.distinct())
        if after == before:
            break
        before = after
    members = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return members.unionByName(roots)

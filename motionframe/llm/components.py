"""Connected components by alternating star contraction, entirely in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import Scratch

MAX_ROUNDS = 60


def connected_components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """``node, root``: the smallest node reachable from each node that has an edge (``a``, ``b``, any order, repeats allowed).

    Each round hangs every node's larger neighbours, then its smaller ones, onto its smallest neighbour, until
    the edge set no longer changes (a logarithmic number of rounds). Every round's edges are written to the
    shared folder, so lineage stays short and a lost executor costs one round at most.
    """
    work = edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    work, before = scratch.save("links-0", work), None
    for i in range(1, MAX_ROUNDS):
        both = work.select("u", "v").union(work.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where(F.col("v") > F.col("u")).join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        after = scratch.save(f"links-{i}", small.where(F.col("u") != F.col("v")).distinct())
        state = after.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        scratch.drop(f"links-{i - 1}")
        work = after
        if state == before:
            return after.select(F.col("u").alias("node"), F.col("v").alias("root")).union(after.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        before = state
    raise RuntimeError("components did not settle")

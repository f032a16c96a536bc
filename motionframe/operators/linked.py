"""Trees as graphs: branches of one majority on a level are joined where one node splits the two together well."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def offered_branches(branches: DataFrame) -> DataFrame:
    """``tree, node, majority, quality``: of each split node the branch with the smaller share of other labels (the right one of equals), which it offers for a link.

    ``branches``: ``tree, node, n, top, majority, quality`` with the quality of the split that they come from; children of i are 2i and 2i + 1.
    """
    risk = (F.col("n") - F.col("top")) / F.col("n")
    best = branches.groupBy("tree", F.shiftright("node", 1).alias("_parent")).agg(F.min_by(F.struct("node", "majority", "quality"), F.struct(risk, -F.col("node"))).alias("b"))
    return best.select("tree", "b.node", "b.majority", "b.quality")


def match(found: DataFrame) -> DataFrame:
    """``tree, node, to``: of the pairs ``tree, majority, a, b, quality`` the best first, each branch in one link at most; b goes to a. Ties go to the smaller nodes.

    A group holds the pairs of one tree's branches of one majority on one level: nodes, not samples.
    """

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        taken: set[int] = set()
        out = []
        for r in pdf.sort_values(["quality", "a", "b"], ascending=[False, True, True]).itertuples():
            if not {r.a, r.b} & taken:
                taken |= {r.a, r.b}
                out.append((r.tree, r.b, r.a))
        return pd.DataFrame(out, columns=["tree", "node", "to"])

    return found.groupBy("tree", "majority").applyInPandas(choose, "tree int, node long, to long")


def link_branches(moved: DataFrame, splits: DataFrame, width: int, look: int, seed: int, search: Callable[[DataFrame, list[str]], DataFrame], few: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``tree, node, to``: which branches of a level become one node.

    ``moved`` are the samples ``tree, node, label, w, x`` in the nodes that the level's ``splits`` (``tree, node, quality``) make. Two offered branches of a tree
    with one majority are joined if the best split of their samples together, over ``look`` features of smallest hash, is better than
    the worse of the splits that they come from. ``search`` finds the best cuts of melted samples by the given columns.
    """
    counted = moved.groupBy("tree", "node", "label").agg(F.sum("w").alias("c"))
    facts = counted.groupBy("tree", "node").agg(F.sum("c").alias("n"), F.max("c").alias("top"), F.min_by("label", F.struct(-F.col("c"), F.col("label"))).alias("majority"))
    parents = splits.select("tree", F.col("node").alias("_parent"), "quality")
    offered = offered_branches(facts.withColumn("_parent", F.shiftright("node", 1)).join(few(parents), ["tree", "_parent"]).drop("_parent")).checkpoint()
    a = offered.select("tree", "majority", F.col("node").alias("a"), F.col("quality").alias("_qa"))
    b = offered.select("tree", "majority", F.col("node").alias("b"), F.col("quality").alias("_qb"))
    pairs = a.join(b, ["tree", "majority"]).where(F.col("a") < F.col("b"))
    wanted = F.slice(F.array_sort(F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda f: F.struct(F.xxhash64(f, "tree", "a", "b", F.lit(seed)), f.alias("f")))), 1, look)
    pairs = pairs.select("tree", "majority", "a", "b", F.least("_qa", "_qb").alias("least"), F.transform(wanted, lambda s: s["f"]).alias("fs")).checkpoint()
    ends = pairs.select("tree", "a", "b", "fs", F.explode(F.array("a", "b")).alias("node"))
    melted = moved.join(few(ends), ["tree", "node"]).select("tree", "a", "b", "label", "w", F.explode(F.transform("fs", lambda f: F.struct(f.alias("f"), F.get("x", f).alias("v")))).alias("p"))
    cuts = search(melted.select("tree", "a", "b", "label", "w", "p.f", "p.v").checkpoint(), ["tree", "a", "b", "f"])
    better = cuts.groupBy("tree", "a", "b").agg(F.max("quality").alias("quality")).join(few(pairs.drop("fs")), ["tree", "a", "b"]).where(F.round("quality", 9) > F.round("least", 9))
    return match(better.select("tree", "majority", "a", "b", F.round("quality", 9).alias("quality"))).checkpoint()

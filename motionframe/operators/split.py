"""Split search, labels' statistics, votes and level-wise trees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import cuts


def label_histogram(samples: DataFrame, by: list[str], label: str, labels: list) -> DataFrame:
    """``by, label, n`` with a row (0) for each declared label."""
    found = samples.groupBy(*by, label).agg(F.count("*").alias("n"))
    groups = samples.select(*by).distinct().withColumn(label, F.explode(F.array(*map(F.lit, labels))))
    return groups.join(found, [*by, label], "left").select(*by, label, F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def majority(samples: DataFrame, by: list[str], label: str) -> DataFrame:
    """``by, majority, n, risk, local_risk``: the most frequent label (ties: the smallest), the others' count and share."""
    counted = samples.groupBy(*by, label).agg(F.count("*").alias("c"))
    best = counted.groupBy(*by).agg(F.sum("c").alias("n"), F.max("c").alias("top"), F.min_by(label, F.struct(-F.col("c"), F.col(label))).alias("majority"))
    return best.select(*by, "majority", "n", (F.col("n") - F.col("top")).alias("risk"), ((F.col("n") - F.col("top")) / F.col("n")).alias("local_risk"))


def best_split(long: DataFrame, by: list[str], x: str, label: str, labels: list, buckets: int = cuts.BINS, weight: str | None = None) -> DataFrame:
    """``by, threshold, quality``: the cut of each feature that maximises sum L_c^2 / L + sum R_c^2 / R; ties go to the smaller threshold.

    ``long`` has one row per sample and feature (``by``); missing values and rows of other labels take no part; neighbouring values must differ by
    more than twice the float epsilon to be cut between, at their midpoint. A feature's values are counted by ``buckets`` bins, and only bins that may hold the best cut are
    sorted (``cuts.best_cuts``), so a feature over all samples is never one task's work.
    """
    found = cuts.best_cuts(long, by, x, label, labels, [(0, list(range(len(labels))))], [weight] if weight else None, max(buckets, cuts.BINS))
    return found.select(*by, "threshold", "quality")


def branch(x: Column, threshold: Column, default: str = "right") -> Column:
    """``left`` up to the threshold, ``right`` above it, ``default`` for missing values."""
    return F.when(x.isNull() | F.isnan(x), F.lit(default)).when(x <= threshold, "left").otherwise("right")


def vote(predictions: DataFrame, by: list[str], label: str) -> DataFrame:
    """``by, votes, predicted``: the label most trees give; the smallest of equals."""
    counted = predictions.groupBy(*by, label).agg(F.count("*").alias("votes"))
    return counted.groupBy(*by).agg(F.max("votes").alias("votes"), F.min_by(label, F.struct(-F.col("votes"), F.col(label))).alias("predicted"))


def evaluate(predictions: DataFrame, label: str, predicted: str) -> DataFrame:
    """One row: ``n, correct, accuracy``."""
    return predictions.agg(F.count("*").alias("n"), F.sum((F.col(label) == F.col(predicted)).cast("long")).alias("correct")).withColumn("accuracy", F.col("correct") / F.col("n"))


def pair_quality(long: DataFrame, by: list[str], x: str, label: str, shuffles: int = 4, seed: int = 1) -> DataFrame:
    """``by, quality``: the best cut's quality between two classes (``label`` 0 or 1) of equal size, averaged over ``shuffles`` draws.

    Each draw keeps as many rows of both classes as the smaller one has, those of smallest hash.
    """
    known = long.where(F.col(x).isNotNull() & ~F.isnan(x))
    least = known.groupBy(*by, label).agg(F.count("*").alias("n")).groupBy(*by).agg(F.min("n").alias("_least"), F.count("*").alias("_classes")).where(F.col("_classes") == 2)
    drawn = known.withColumn("_draw", F.explode(F.sequence(F.lit(0), F.lit(shuffles - 1))))
    order = Window.partitionBy(*by, "_draw", label).orderBy(F.xxhash64(x, "_draw", F.lit(seed)), x)
    taken = drawn.withColumn("_r", F.row_number().over(order)).join(least, by).where(F.col("_r") <= F.col("_least"))
    return best_split(taken, [*by, "_draw"], x, label, [0, 1], 8).groupBy(*by).agg(F.avg("quality").alias("quality"))


class Forest:
    """Trees as one table ``tree, node, feature, threshold, default_left, label, n, risk, left, right`` (a leaf's feature is null).

    Children of i are 2i and 2i + 1, but for branches that are linked: two of a level that are one node, that of the smaller number, where
    ``left`` or ``right`` of both their parents lead.

    To predict, a forest of at most ``MOST`` nodes (33 bytes each) is sent to every task; a larger one is walked level by level with joins.
    """

    MOST = 1_000_000
    SCHEMA = "tree int, node long, feature int, threshold double, default_left boolean, label {label}, n double, risk double, left long, right long"

    def __init__(self, nodes: DataFrame):
        self.nodes = nodes

    def save(self, path: str) -> None:
        self.nodes.write.mode("overwrite").partitionBy("tree").parquet(path)

    @classmethod
    def load(cls, spark, path: str) -> Forest:
        stored = spark.read.parquet(path)
        return cls(stored.select(*[c.split(" ")[0] for c in cls.SCHEMA.split(", ")]))

    def keep(self, trees: list[int]) -> Forest:
        """The forest of the given trees only."""
        return Forest(self.nodes.where(F.col("tree").isin(trees)))

    def trees(self) -> list[int]:
        return sorted(r["tree"] for r in self.nodes.select("tree").distinct().collect())

    def depths(self) -> dict[int, int]:
        """How many splits the longest path of each tree has."""
        longest = F.max(F.floor(F.log2(F.col("node").cast("double")) + F.lit(1e-9))).cast("int")
        return {r["tree"]: r["depth"] for r in self.nodes.groupBy("tree").agg(longest.alias("depth")).collect()}

    def arrays(self) -> list[tuple]:
        """Per tree, sorted by node: node, feature (-1 for a leaf), threshold, default_left, label, left, right."""
        import numpy as np

        out = []
        for _, t in self.nodes.toPandas().sort_values("node").groupby("tree"):
            feature, left = t["feature"].astype("Float64").fillna(-1), t["default_left"].astype("boolean").fillna(False)
            down = [t[c].astype("Int64").fillna(0).to_numpy(np.int64) for c in ("left", "right")]
            out.append((t["node"].to_numpy(np.int64), feature.to_numpy(np.int64), t["threshold"].astype(float).fillna(0.0).to_numpy(), left.to_numpy(bool), t["label"].to_numpy(), *down))
        return out

    def component(self, samples: DataFrame, key: list[str], features: str) -> DataFrame:
        """``key, given``: every tree's label, in the order of the trees. Missing values go the way of the node's larger side. ``key`` tells the samples apart."""
        cast = samples.select(*key, F.transform(features, lambda v: v.cast("double")).alias(features))
        return self._sent(cast, key, features) if self.nodes.count() <= self.MOST else self._walked(cast, key, features)

    def _walked(self, samples: DataFrame, key: list[str], features: str) -> DataFrame:
        """``component`` by joins: a sample is one row per tree that goes down a level at a time. A level's nodes are sent to every task while they are few."""
        from ..session import checkpoint_dir

        checkpoint_dir(samples.sparkSession)
        live = samples.withColumn("tree", F.explode(F.array(*[F.lit(t) for t in self.trees()]))).withColumn("node", F.lit(1).cast("long")).checkpoint()
        ended, level = None, 0
        while not live.isEmpty():
            here = self.nodes.where((F.col("node") >= 1 << level) & (F.col("node") < 1 << (level + 1))).select("tree", "node", "feature", "threshold", "default_left", "label", "left", "right")
            met = live.join(few(here), ["tree", "node"]).checkpoint()
            done = met.where("feature IS NULL").select(*key, "tree", "label")
            ended = done if ended is None else ended.union(done)
            v = F.get(features, F.col("feature"))
            left = F.when(v.isNull() | F.isnan(v), F.col("default_left")).otherwise(v <= F.col("threshold"))
            live, level = met.where("feature IS NOT NULL").select(*key, features, "tree", F.when(left, F.col("left")).otherwise(F.col("right")).alias("node")), level + 1
        held = ended.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("tree", "label"))).alias("g"))
        return held.select(*key, F.transform("g", lambda g: g["label"]).alias("given"))

    def _sent(self, samples: DataFrame, key: list[str], features: str) -> DataFrame:
        """``component`` with the whole forest in every task."""
        import numpy as np
        import pandas as pd

        held = samples.sparkSession.sparkContext.broadcast(self.arrays())
        kind = self.nodes.schema["label"].dataType.simpleString()
        kinds = ", ".join(f"{k} {samples.schema[k].dataType.simpleString()}" for k in key)

        def run(batches):
            for pdf in batches:
                if not len(pdf):
                    continue
                x = np.stack([np.array(v, dtype=np.float64) for v in pdf[features]])
                given = []
                for node, feature, threshold, left, label, *ways in held.value:
                    at = np.zeros(len(x), np.int64)  # the root is the first row
                    live = np.flatnonzero(feature[at] >= 0)
                    while len(live):
                        f = at[live]
                        v = x[live, feature[f]]
                        down = np.where(np.isnan(v), left[f], v <= threshold[f])
                        at[live] = np.searchsorted(node, np.where(down, ways[0][f], ways[1][f]))
                        live = live[feature[at[live]] >= 0]
                    given.append(label[at])
                yield pdf[key].assign(given=list(np.stack(given, axis=1)) if given else [[] for _ in range(len(pdf))])

        return samples.mapInPandas(run, f"{kinds}, given array<{kind}>")

    def predict(self, samples: DataFrame, key: list[str], features: str) -> DataFrame:
        """``key, votes, predicted``: the label most trees give, the smallest of equals; votes are counted inside the row."""
        counts = F.transform(F.array_distinct("given"), lambda l: F.struct((-F.size(F.filter("given", lambda x: x == l))).alias("minus"), l.alias("label")))
        best = self.component(samples, key, features).withColumn("best", F.array_min(counts))
        return best.select(*key, (-F.col("best.minus")).cast("long").alias("votes"), F.col("best.label").alias("predicted"))

    def probabilities(self, samples: DataFrame, key: list[str], features: str, labels: list) -> DataFrame:
        """``key, probability``: the share of trees for each of ``labels``, in their order."""
        share = lambda l: F.size(F.filter("given", lambda x: x == F.lit(l))) / F.nullif(F.size("given"), F.lit(0))
        return self.component(samples, key, features).select(*key, F.array(*[share(l) for l in labels]).alias("probability"))


def mtry(width: int) -> int:
    """How many features a node looks at: the square root of all, rounded."""
    return max(1, int(width**0.5 + 0.5))


def least_samples(rows: int) -> int:
    """Below how many samples a node is not split: a hundredth of all, between 1 and 100."""
    return min(100, max(1, rows // 100))


#: Rows of a table that is sent to every task to be joined; rows whose draws one task makes, and how many such groups there are at most.
FEW, BLOCK, BLOCKS = 100_000, 10_000, 65_536


def few(table: DataFrame) -> DataFrame:
    """``table`` marked to be sent to every task if it is of at most ``FEW`` rows, counted first."""
    return F.broadcast(table) if table.limit(FEW + 1).count() <= FEW else table


def bootstrap_weights(samples: DataFrame, key: str, trees: list[int], seed: int = 1) -> DataFrame:
    """``key, weights``: how often each of ``trees`` draws the row; a tree's weights are as many draws with replacement as there are rows.

    Rows are dealt to blocks by hash. A tree's draws are split over the blocks by one multinomial draw of their sizes, which every task repeats
    from the tree's seed, and a block's share over its rows by another. ``key`` tells rows apart; only keys are moved.
    """
    import numpy as np
    import pandas as pd

    keys = samples.select(key)
    blocks = min(BLOCKS, -(-max(1, keys.count()) // BLOCK))
    dealt = keys.withColumn("_block", F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int"))
    sizes = np.zeros(blocks, np.int64)
    for r in dealt.groupBy("_block").count().collect():  # BLOCKS rows at most
        sizes[r["_block"]] = r["count"]
    total = int(sizes.sum())

    def draw(pdf: pd.DataFrame) -> pd.DataFrame:
        block, n = int(pdf["_block"].iloc[0]), len(pdf)
        pdf = pdf.sort_values(key, kind="stable")
        weights = np.empty((n, len(trees)), np.int32)
        for i, t in enumerate(trees):
            share = np.random.default_rng([seed, t]).multinomial(total, sizes / total)[block]
            weights[:, i] = np.random.default_rng([seed, t, block]).multinomial(share, np.full(n, 1 / n))
        return pd.DataFrame({key: pdf[key], "weights": list(weights)})

    kind = samples.schema[key].dataType.simpleString()
    return dealt.groupBy("_block").applyInPandas(draw, f"{key} {kind}, weights array<int>")


def grow_trees(samples: DataFrame, key: str, features: str, label: str, width: int, labels: list, trees: list[int], depth: int, least: int = 2, look: int | None = None, seed: int = 1, bootstrap: bool = True, linked: bool = False) -> Forest:
    """The given trees, grown together level by level: one split search a level over the open nodes of all of them.

    Each tree draws as many rows as there are with replacement (``bootstrap_weights``). A row carries its node; the splits of a level come to it by a join, so
    a level is a fixed number of jobs however many trees there are; splits of few nodes are sent to every task, so that no node is a hot key. Every node looks at ``look`` features (those of smallest hash; default
    ``mtry``). A node is a leaf when it is pure, has ``least`` samples or fewer, has no cut, or is ``depth`` levels down. Missing values go to its larger
    side (right of equals). Ties between features go to the smaller one. With ``linked`` branches of a level may become one node (``linked.link_branches``).
    """
    from ..session import checkpoint_dir
    from .linked import link_branches

    spark = samples.sparkSession
    checkpoint_dir(spark)
    look = look or mtry(width)
    rows = samples.select(F.transform(features, lambda v: v.cast("double")).alias("x"), F.col(label).alias("label"), F.col(key))
    weighed = rows.join(bootstrap_weights(samples, key, trees, seed), key) if bootstrap else rows.withColumn("weights", F.array(*[F.lit(1)] * len(trees)))
    numbered = weighed.select("x", "label", F.explode(F.arrays_zip(F.array(*[F.lit(t).cast("int") for t in trees]).alias("tree"), F.col("weights").alias("w"))).alias("d"))
    live = numbered.select(F.col("d.tree").alias("tree"), F.lit(1).cast("long").alias("node"), "label", F.col("d.w").cast("double").alias("w"), "x").where("w > 0").checkpoint()
    at, done = ["tree", "node"], None
    for level in range(depth + 1):
        counted = live.groupBy(*at, "label").agg(F.sum("w").alias("c"))
        facts = counted.groupBy(*at).agg(F.sum("c").alias("n"), F.max("c").alias("top"), F.min_by("label", F.struct(-F.col("c"), F.col("label"))).alias("label")).checkpoint()
        splits = None
        if level < depth:
            opened = facts.where((F.col("n") > least) & (F.col("n") > F.col("top")))
            wanted = F.slice(F.array_sort(F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda f: F.struct(F.xxhash64(f, "tree", "node", F.lit(seed)), f.alias("f")))), 1, look)
            asked = opened.select(*at, F.transform(wanted, lambda s: s["f"]).alias("fs"))
            melted = live.join(few(asked), at).select(*at, "label", "w", F.explode(F.transform("fs", lambda f: F.struct(f.alias("f"), F.get("x", f).alias("v")))).alias("p")).select(*at, "label", "w", F.col("p.f").alias("f"), F.col("p.v").alias("v"))
            melted = melted.checkpoint()
            cuts = best_split(melted, [*at, "f"], "v", "label", labels, 16, "w")
            best = cuts.groupBy(*at).agg(F.min_by(F.struct("f", "threshold"), F.struct(-F.round("quality", 9), F.col("f"))).alias("s"), F.max("quality").alias("quality"))
            sides = melted.join(few(best.checkpoint()), at).where(F.col("f") == F.col("s.f")).groupBy(*at).agg(F.first("s").alias("s"), F.first("quality").alias("quality"), F.sum(F.when(F.col("v") <= F.col("s.threshold"), F.col("w")).when(F.col("v") > F.col("s.threshold"), -F.col("w")).otherwise(0.0)).alias("lean"))
            splits = sides.select(*at, F.col("s.f").alias("feature"), F.col("s.threshold").alias("threshold"), (F.col("lean") > 0).alias("default_left"), "quality").checkpoint()
        last = splits is None or splits.isEmpty()
        if not last:
            v = F.get("x", F.col("feature"))
            left = F.when(v.isNull() | F.isnan(v), F.col("default_left")).otherwise(v <= F.col("threshold"))
            live = live.join(few(splits), at).select("tree", (2 * F.col("node") + F.when(left, 0).otherwise(1)).cast("long").alias("node"), "label", "w", "x").checkpoint()
            splits = splits.withColumns({"left": 2 * F.col("node"), "right": 2 * F.col("node") + 1})
            if linked and level + 1 < depth:
                links = link_branches(live, splits, width, look, seed, lambda m, by: best_split(m, by, "v", "label", labels, 16, "w"), few)
                live = live.join(few(links), at, "left").withColumn("node", F.coalesce("to", "node")).drop("to").checkpoint()
                for way in ("left", "right"):
                    splits = splits.join(few(links.withColumnRenamed("node", way)), ["tree", way], "left").withColumn(way, F.coalesce("to", way)).drop("to")
            nodes = facts.join(splits, at, "left")
        else:
            nodes = facts.withColumns({c: F.lit(None).cast(kind) for c, kind in (("feature", "int"), ("threshold", "double"), ("default_left", "boolean"), ("left", "long"), ("right", "long"))})
        nodes = nodes.select("tree", "node", F.col("feature").cast("int").alias("feature"), "threshold", "default_left", "label", "n", (F.col("n") - F.col("top")).alias("risk"), "left", "right")
        done = nodes if done is None else done.union(nodes)
        if last:
            break
    return Forest(done.checkpoint())


def grow_forest(samples: DataFrame, key: str, features: str, label: str, width: int, labels: list, trees: int, depth: int, seed: int = 1, chunk: int | None = None, tolerance: float = 5e-4, least: int = 2, look: int | None = None, tries: int = 3) -> Forest:
    """A forest of at most ``trees`` trees, ``chunk`` of them grown at a time (default: all).

    A tree whose longest path has fewer than half of ``depth`` splits is not accepted, and another is grown in its place, up to ``tries`` times as
    many as asked for; if none is accepted that is an error. After each chunk the training accuracy is looked at, and growing ends when its mean over six looks moves by less than ``tolerance``.
    """
    seen: list[float] = []
    out, accepted, first = None, 0, 0
    while accepted < trees and first < tries * trees:
        size = min(chunk or trees, trees - accepted, tries * trees - first)
        more = grow_trees(samples, key, features, label, width, labels, list(range(first, first + size)), depth, least, look, seed)
        first += size
        deep = [t for t, d in more.depths().items() if d >= depth // 2]
        if not deep:
            continue
        more, accepted = more.keep(deep), accepted + len(deep)
        out = more if out is None else Forest(out.nodes.union(more.nodes))
        if chunk:
            seen.append(evaluate(predict_forest(samples, [key, label], features, out), label, "predicted").first().accuracy or 0.0)
            if len(seen) > 6 and abs(sum(seen[-6:]) - sum(seen[-7:-1])) / 6 < tolerance:
                break
    if out is None:
        raise ValueError(f"none of {first} trees has a path of {depth // 2} splits")
    return out


def predict_forest(samples: DataFrame, key: list[str], features: str, forest: Forest) -> DataFrame:
    return forest.predict(samples, key, features)

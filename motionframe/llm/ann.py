"""Approximate nearest neighbours over balanced posting lists with boundary replication.

A bounded sample gives the first centroids; a navigable graph over them stays in memory. Every distinct vector is posted
under its nearest centroid and under each other one about as near (boundary vectors live in several lists). Lists that come out
long are split again by centroids of their own, level by level, until lists are short: their number follows the table's
size, the work of a query does not. A query walks the centroid graph, keeps the lists within a distance ratio of the
best, goes down the levels in the same way, and compares exactly inside the lists that are left.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .storage import Scratch, table


@dataclass(frozen=True)
class Index:
    """``sample`` rows fit at most ``most_lists`` centroids; lists aim at ``list_rows`` vectors.

    A list of more than four times as many is split into at most ``fan`` others, by centroids of at most ``32 * fan`` of its rows (in
    expectation); at most ``levels`` times, after which a list that is still long is searched in parts.
    A vector is posted to up to ``replicas`` lists within ``boundary`` times its nearest centroid's distance (two on lower levels); a query
    reads up to ``probes`` lists within ``ratio`` times its nearest one's, and more than that until they hold enough vectors.
    Distances are Euclidean between unit vectors.
    """

    sample: int = 20_000
    most_lists: int = 1024
    list_rows: int = 400
    replicas: int = 4
    boundary: float = 1.15
    probes: int = 64
    ratio: float = 1.6
    degree: int = 16
    beam: int = 96
    fan: int = 256
    levels: int = 4
    seed: int = 7


def balanced_centroids(unit: np.ndarray, k: int, seed: int, rounds: int = 8) -> np.ndarray:
    """k-means on unit vectors whose assignment is charged for crowding, so that lists come out about equally long."""
    rng = np.random.default_rng(seed)
    centres = unit[rng.choice(len(unit), k, replace=False)].copy()
    load = np.full(k, len(unit) / k)
    for _ in range(rounds):
        cost = 2 - 2 * unit @ centres.T
        cost *= 1 + 0.15 * (load / load.mean() - 1).clip(-1, 3)
        own = cost.argmin(axis=1)
        load = np.bincount(own, minlength=k).astype(float)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, unit)
        empty = load == 0
        sums[empty] = unit[rng.choice(len(unit), int(empty.sum()))]
        centres = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    return centres


def neighbour_graph(centres: np.ndarray, degree: int) -> np.ndarray:
    """Each centroid's nearest others (``degree`` of them, itself where there are fewer), plus one long link of a ring."""
    k = len(centres)
    near = np.argsort(2 - 2 * centres @ centres.T, axis=1, kind="stable")[:, 1 : degree + 1]
    if near.shape[1] < degree:
        near = np.hstack([near, np.repeat(np.arange(k)[:, None], degree - near.shape[1], axis=1)])
    return np.hstack([near, ((np.arange(k) + max(1, k // 2)) % k)[:, None], ((np.arange(k) + 1) % k)[:, None]])


def graph_search(unit: np.ndarray, centres: np.ndarray, graph: np.ndarray, beam: int, want: int) -> tuple[np.ndarray, np.ndarray]:
    """Best-first search of the centroid graph for all rows at once: ``(lists, squared distances)``, nearest first.

    All rows keep a beam of visited centroids and expand the nearest unexpanded ones until none is left in the beam.
    """
    n, k = len(unit), len(centres)
    beam = min(beam, k)
    want = min(want, beam)
    entries = np.unique(np.linspace(0, k - 1, min(k, 24)).astype(np.int64))
    distance = np.full((n, k), np.inf, dtype=np.float32)  # of visited centroids; k is bounded by the index
    expanded = np.zeros((n, k), dtype=bool)
    distance[:, entries] = 2 - 2 * unit @ centres[entries].T
    rows = np.arange(n)
    while len(rows):
        frontier = np.where(expanded[rows], np.inf, distance[rows])
        best = frontier.argmin(axis=1)
        edge = np.partition(distance[rows], beam - 1, axis=1)[:, beam - 1]
        alive = np.isfinite(frontier[np.arange(len(rows)), best]) & (frontier[np.arange(len(rows)), best] <= edge)
        rows, best = rows[alive], best[alive]
        if not len(rows):
            break
        expanded[rows, best] = True
        around = graph[best]
        distance[rows[:, None], around] = 2 - 2 * np.einsum("nd,ngd->ng", unit[rows], centres[around])
    order = np.argsort(distance, axis=1, kind="stable")[:, :want]
    return order, np.maximum(np.take_along_axis(distance, order, axis=1), 0)


def usable(embedding: Column) -> Column:
    """Not null, not empty, without null, NaN or infinite components, and not zero."""
    bad = F.exists(embedding, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return embedding.isNotNull() & (F.size(embedding) > 0) & ~bad & F.exists(embedding, lambda x: x != 0)


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64)


def _unit(m: np.ndarray) -> np.ndarray:
    return m / np.linalg.norm(m, axis=1, keepdims=True)


#: Rows of one list that one task routes or searches at once.
TOGETHER = 20_000


class Lists:
    """Postings ``list, ids, v`` and queries ``list, query_id, v, d`` (distance to the list's centroid) of one level of the index."""

    def __init__(self, postings: DataFrame, asked: DataFrame, sizes: DataFrame):
        self.postings, self.asked, self.sizes = postings, asked, sizes

    def rows_read(self) -> tuple[int, int, float]:
        """``(lists, queries, mean lists that a query reads)``."""
        n, q, rows = self.sizes.count(), self.asked.select("query_id").distinct().count(), self.asked.count()
        return n, q, rows / max(1, q)


def _sized(postings: DataFrame) -> DataFrame:
    return postings.groupBy("list").agg(F.count("*").alias("n"))


def refined(now: Lists, index: Index, scratch: Scratch, level: int) -> Lists | None:
    """The next level: long lists replaced by those of their own centroids; None if no list is long.

    Centroids of a list are one row, sent to the parts of at most about ``TOGETHER`` vectors in which its vectors and queries are routed.
    """
    long = now.sizes.where(F.col("n") > 4 * index.list_rows)
    if long.isEmpty():
        return None
    sampled = now.postings.join(long, "list").where(F.pmod(F.xxhash64("ids", F.lit(level)), F.lit(1 << 20)) < F.lit((1 << 20) * 32.0 * index.fan) / F.col("n"))

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        unit = _unit(_matrix(pdf["v"]))
        k = int(max(2, min(index.fan, -(-int(pdf["n"].iat[0]) // index.list_rows), len(unit) // 4 or 1)))
        k = min(k, len(unit))
        centres = balanced_centroids(unit, k, index.seed + level).astype(np.float32)
        return pd.DataFrame({"list": [pdf["list"].iat[0]], "n": [pdf["n"].iat[0]], "centres": [centres.tobytes()], "k": [k]})

    fitted = scratch.save(f"centres-{level}", sampled.groupBy("list").applyInPandas(fit, "list long, n long, centres binary, k int"))
    parts = F.greatest(F.lit(1), F.ceil(F.col("n") / F.lit(TOGETHER))).cast("int")
    sent = fitted.withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1)))

    def near(v: pd.Series, centres: bytes, k: int) -> np.ndarray:
        unit = _unit(_matrix(v))
        return np.sqrt(np.maximum(2 - 2 * unit @ np.frombuffer(centres, np.float32).reshape(k, -1).T.astype(np.float64), 0))

    def post(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame([], columns=["list", "ids", "v"])
        d = near(left["v"], right["centres"].iat[0], int(right["k"].iat[0]))
        want = min(2, d.shape[1])
        first = np.argpartition(d, want - 1, axis=1)[:, :want]
        own = np.take_along_axis(d, first, axis=1)
        row, col = np.nonzero(own <= own.min(axis=1, keepdims=True) * index.boundary + 1e-12)
        return pd.DataFrame({"list": int(right["list"].iat[0]) * index.fan + first[row, col] + 1, "ids": left["ids"].to_numpy()[row], "v": left["v"].to_numpy()[row]})

    def ask(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame([], columns=["list", "query_id", "v", "d"])
        d = near(left["v"], right["centres"].iat[0], int(right["k"].iat[0]))
        want = min(index.probes, d.shape[1])
        first = np.argpartition(d, want - 1, axis=1)[:, :want]
        own = np.take_along_axis(d, first, axis=1)
        row, col = np.nonzero(own <= own.min(axis=1, keepdims=True) * index.ratio + 1e-12)
        return pd.DataFrame({"list": int(right["list"].iat[0]) * index.fan + first[row, col] + 1, "query_id": left["query_id"].to_numpy()[row], "v": left["v"].to_numpy()[row], "d": own[row, col]})

    def routed(rows: DataFrame, key: str, route, kind: str) -> DataFrame:
        dealt = rows.join(fitted.select("list", "n"), "list").withColumn("part", F.pmod(F.xxhash64(key), parts).cast("int")).drop("n")
        return dealt.groupBy("list", "part").cogroup(sent.groupBy("list", "part")).applyInPandas(route, kind)

    # A level's lists are numbered apart from the other levels': list * fan + 1 .. list * fan + fan, short ones as list * fan.
    renamed = (F.col("list") * index.fan).alias("list")
    short = now.postings.join(fitted.select("list"), "list", "left_anti").select(renamed, "ids", "v")
    postings = scratch.save(f"postings-{level}", short.union(routed(now.postings, "ids", post, "list long, ids array<long>, v array<double>")))
    kept = now.asked.join(fitted.select("list"), "list", "left_anti").select(renamed, "query_id", "v", "d")
    asked = kept.union(routed(now.asked, "query_id", ask, "list long, query_id long, v array<double>, d double"))
    order = Window.partitionBy("query_id", "v").orderBy("d", "list")
    asked = asked.withColumn("r", F.row_number().over(order)).withColumn("best", F.min("d").over(Window.partitionBy("query_id", "v")))
    asked = scratch.save(f"asked-{level}", asked.where((F.col("r") <= index.probes) & (F.col("d") <= F.col("best") * index.ratio + 1e-9) | (F.col("r") <= 2)).select("list", "query_id", "v", "d"))
    return Lists(postings, asked, scratch.save(f"sizes-{level}", _sized(postings)))


def build(clean: DataFrame, queries: DataFrame, k: int, index: Index, scratch: Scratch) -> Lists:
    """The index of ``clean`` (``vec_id, v, h``, vectors of one length) with the queries (``query_id, v``) routed to the lists they read."""
    spark = clean.sparkSession
    first = Window.partitionBy("h", "v").orderBy("vec_id")
    kept = clean.distinct().withColumn("r", F.row_number().over(first)).where(F.col("r") <= k + 1)  # a group limit before the shuffle
    distinct = scratch.save("distinct", kept.groupBy("h", "v").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")))
    unit = _unit(np.array([r["v"] for r in distinct.orderBy("h").limit(index.sample).select("v").collect()], dtype=np.float64))
    rows = distinct.count()
    lists = int(max(1, min(index.most_lists, -(-rows // index.list_rows), len(unit) // 4 or 1)))
    centres = balanced_centroids(unit, lists, index.seed)
    shared = spark.sparkContext.broadcast((centres, neighbour_graph(centres, index.degree)))  # most_lists rows at most

    def post(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for lo in range(0, len(batch), 2000):
                part = batch.iloc[lo : lo + 2000]
                found, d2 = graph_search(_unit(_matrix(part["v"])), *shared.value, index.beam, index.replicas)
                d = np.sqrt(d2)
                row, col = np.nonzero(d <= np.maximum(d[:, :1] * index.boundary, 1e-9))
                yield pd.DataFrame({"list": found[row, col], "ids": part["ids"].to_numpy()[row], "v": part["v"].to_numpy()[row]})

    postings = scratch.save("postings", distinct.select("ids", "v").mapInPandas(post, "list long, ids array<long>, v array<double>"))
    sizes = scratch.save("sizes", _sized(postings))
    length = np.zeros(lists)
    for r in sizes.collect():  # most_lists rows at most
        length[r["list"]] = r["n"]
    enough = (k + 1) * index.replicas  # a vector is in so many lists at most

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for lo in range(0, len(batch), 2000):
                part = batch.iloc[lo : lo + 2000]
                found, d2 = graph_search(_unit(_matrix(part["v"])), *shared.value, index.beam, index.probes)
                d = np.sqrt(d2)
                held = np.cumsum(length[found], axis=1) - length[found]  # in the nearer lists
                row, col = np.nonzero((d <= np.maximum(d[:, :1] * index.ratio, 1e-9)) | (held < enough))
                yield pd.DataFrame({"list": found[row, col], "query_id": part["query_id"].to_numpy()[row], "v": part["v"].to_numpy()[row], "d": d[row, col]})

    asked = scratch.save("asked", queries.mapInPandas(ask, "list long, query_id long, v array<double>, d double"))
    now = Lists(postings, asked, sizes)
    for level in range(1, index.levels + 1):
        deeper = refined(now, index, scratch, level)
        if deeper is None:
            break
        now = deeper
    return now


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5, index: Index = Index()) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` largest cosines found for each row of ``queries`` among ``vectors``' other ids.

    Both have ``vec_id, embedding``. Every usable row is indexed; unusable ones (and null ids, and vectors of another length than the
    most common one) take no part. Equal vectors share one posting that keeps the ``k + 1`` smallest ids, which is all
    that ties to the smaller id can ever return, so copies of one vector never crowd a list. Rows that repeat an id
    with another vector count once, by their best score. Fewer candidates than ``k`` give fewer ranks; an empty table gives no rows.
    Other columns are ignored. The index is dropped once the rows are written.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "ann")
    clean = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    clean = clean.where(F.col("vec_id").isNotNull() & usable(F.col("v")))
    sizes = clean.groupBy(F.size("v").alias("n")).agg(F.count("*").alias("c")).orderBy(F.desc("c"), F.desc("n")).first()
    if sizes is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim = sizes["n"]
    asked = queries.select(F.col("vec_id").cast("long").alias("query_id"), F.col("embedding").cast("array<double>").alias("v"))
    asked = asked.where(F.col("query_id").isNotNull() & usable(F.col("v")) & (F.size("v") == dim)).distinct()
    lists = build(clean.where(F.size("v") == dim).withColumn("h", F.xxhash64("v")), asked, k, index, scratch)
    parts = scratch.save("parts", lists.sizes.select("list", F.ceil(F.col("n") / F.lit(TOGETHER)).cast("int").alias("parts")))
    split_postings = lists.postings.join(parts, "list").withColumn("part", F.pmod(F.xxhash64("ids"), F.col("parts")).cast("int")).select("list", "part", "ids", "v")
    split_asked = lists.asked.join(parts, "list").select("list", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "query_id", "v")

    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        if len(left) and len(right):
            q, p, ids = _matrix(left["v"]), _matrix(right["v"]), right["ids"].to_numpy()
            qn, pn = np.linalg.norm(q, axis=1), np.linalg.norm(p, axis=1)
            for lo in range(0, len(q), 512):
                score = (q[lo : lo + 512] @ p.T) / (qn[lo : lo + 512, None] * pn)
                most = min(len(p), k + 1)
                edge = np.partition(score, len(p) - most, axis=1)[:, len(p) - most] - 1e-12
                for i, j in zip(*np.nonzero(score >= edge[:, None])):
                    exact = float(np.dot(q[lo + i], p[j]) / (qn[lo + i] * pn[j]))
                    out += [(left["query_id"].iat[lo + i], x, exact) for x in ids[j] if x != left["query_id"].iat[lo + i]]
        found = pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})
        return found.sort_values(["query_id", "score", "vec_id"], ascending=[True, False, True]).drop_duplicates(["query_id", "vec_id"]).groupby("query_id").head(k)

    found = split_asked.groupBy("list", "part").cogroup(split_postings.groupBy("list", "part")).applyInPandas(search, "query_id long, vec_id long, score double")
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    rows = scratch.save("rows", best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"))
    scratch.drop_all_but("rows")
    return rows


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.where(F.col("vec_id") % 50 == 0))

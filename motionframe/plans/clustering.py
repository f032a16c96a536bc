"""Queries over ``embeddings`` read as series: distances, clusters, shapes, series functions; and a joint forest from the star schema."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import tables
from ..operators import cluster, fields, templates, tiles, warped_join
from .samples import KEY_EVENTS, PERSISTENCE

BY = ["label"]


def _series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet")


def _round(c, digits: int = 6):
    return F.round(c, digits) + F.lit(0.0)


def _points(spark, sf_dir) -> tuple[DataFrame, list[str], str, str]:
    return _series(spark, sf_dir), BY, "vec_id", "embedding"


L1 = tiles.by_l1(6)


def dist_matrix_l1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiles.matrix(*_points(spark, sf_dir), L1)


def knn_mean_dist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster.knn_mean(tiles.nearest(*_points(spark, sf_dir), L1, 3), BY, 3, False).withColumn("mean", _round(F.col("mean")))


def eps_minpts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiles.estimate_eps(*_points(spark, sf_dir), L1).select("label", _round(F.col("eps")).alias("eps"), "min_pts")


EPS = 7.8


def radius_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiles.counts(*_points(spark, sf_dir), L1, EPS)


def dbscan_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiles.dbscan(*_points(spark, sf_dir), L1, EPS, 3)


def label_distance_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distance of every two labels of the series around the circle of labels, and how many series have both kinds."""
    sizes = _series(spark, sf_dir).groupBy("label").agg(F.count("*").alias("n"))
    grid = sizes.select((F.col("label") + 1).alias("l1"), "n", F.explode(F.sequence(F.lit(1), F.lit(10))).alias("l2"))
    both = grid.join(sizes.select((F.col("label") + 1).alias("l2"), F.col("n").alias("m")), "l2")
    return both.select("l1", "l2", _round(cluster.label_distance(10, 2.718281828459045)).alias("distance"), (F.col("n") + F.col("m")).alias("series"))


def _samples(df: DataFrame, values) -> DataFrame:
    return df.select("vec_id", F.posexplode(values).alias("pos", "x")).withColumn("x", _round(F.col("x")))


def detrend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _samples(_series(spark, sf_dir), cluster.detrend(F.col("embedding")))


def edge_blend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _samples(_series(spark, sf_dir), cluster.edge_blend(F.col("embedding"), 0.1))


def median_argmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.transform("embedding", lambda v: F.round(v.cast("double"), 2))
    return _series(spark, sf_dir).select("vec_id", cluster.median_upper(x).alias("median_upper"), cluster.arg_last(x, True).alias("argmax_last"), cluster.arg_last(x, False).alias("argmin_last"))


def tile_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each series read as a cycle: the mean of the five samples around every position."""
    around = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.aggregate(F.array(*[F.get("embedding", F.pmod(i + F.lit(k), F.lit(64))).cast("double") for k in range(-2, 3)]), F.lit(0.0), lambda s, v: s + v) / 5.0)
    return _samples(_series(spark, sf_dir), around)


def dtw_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Warping cost of all pairs of series of a class."""
    return tiles.matrix(*_points(spark, sf_dir), tiles.by_warping(6)).withColumnRenamed("d", "cost")


def _signed(spark, sf_dir) -> DataFrame:
    """The series with a label for each sample: 1 to 3 by its size."""
    x = F.transform("embedding", lambda v: v.cast("double"))
    return _series(spark, sf_dir).select("label", "vec_id", x.alias("x")).withColumn("marks", F.transform("x", lambda v: F.when(v < -0.05, 1).when(v > 0.05, 3).otherwise(2)))


def dtw_labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with samples that count by their labels' distance around a circle of three."""
    measure = tiles.by_warping(6, "marks", cluster.label_table(3, 2.0))
    return tiles.matrix(_signed(spark, sf_dir), BY, "vec_id", "x", measure, ["marks"]).withColumnRenamed("d", "cost")


def dtw_exponential(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with the asymmetric exponential cost."""
    return tiles.matrix(*_points(spark, sf_dir), tiles.by_warping(6, lam=0.5)).withColumnRenamed("d", "cost")


def dtw_eps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The radius that warping distances suggest for each class."""
    return tiles.estimate_eps(*_points(spark, sf_dir), tiles.by_warping(6)).select("label", _round(F.col("eps")).alias("eps"), "min_pts")


#: A radius under warping.
WARPED_EPS = 0.0505


def warped_radius(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pairs of series of a class within a radius of warping cost."""
    found = warped_join.tiled_within(_series(spark, sf_dir), BY, "vec_id", "embedding", WARPED_EPS)
    return found.select("label", "a", "b", _round(F.col("d")).alias("cost"))


def warped_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Density clusters of warped series at a given radius."""
    return warped_join.radius_clusters(_series(spark, sf_dir), BY, "vec_id", "embedding", WARPED_EPS, 3)


def warped_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Density clusters of warping distances at the radius that they suggest."""
    measure, points = tiles.by_warping(6), _points(spark, sf_dir)
    settings = tiles.estimate_eps(*points, measure, classes=points[0]).withColumn("eps", _round(F.col("eps")))
    return tiles.radius_clusters(*points, measure, settings)


def warped_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole chain: label-aware warping distances, their radius, density clusters, a mean shape with labels per cluster."""
    found = templates.clustered_templates(_signed(spark, sf_dir), BY, "vec_id", "x", "marks", cluster.label_table(3, 2.0))
    return found.select("label", "cluster", "members", F.posexplode(F.arrays_zip("values", "labels")).alias("frame", "p")).select("label", "cluster", "frame", _round(F.col("p.values")).alias("value"), F.col("p.labels").alias("mark"), "members")


def dba_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The classes' mean shapes."""
    return cluster.barycentres(_series(spark, sf_dir), "label", "vec_id", "embedding").withColumn("value", _round(F.col("value")))


def template_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The classes' shapes and a label for each frame, voted by the samples that warp to it; warping looks at labels, too."""
    rows = _signed(spark, sf_dir).withColumnRenamed("label", "class")
    found = templates.labelled_barycentres(rows, "class", "vec_id", "x", "marks", cluster.label_table(3, 2.0))
    return found.withColumns({c: _round(F.col(c)) for c in ("value", "share")})


def spline_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fifth sample taken out and put back on the spline through the others."""
    gaps = F.transform("embedding", lambda v, i: F.when(i % 5 != 0, v.cast("double")))
    return cluster.fill_series(_series(spark, sf_dir).withColumn("v", gaps), ["vec_id"], "v").select("vec_id", F.transform("filled", lambda v: _round(v)).alias("filled"))


def linear_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same on straight lines; the first sample lies on the line through the next two."""
    gaps = F.transform("embedding", lambda v, i: F.when(i % 5 != 0, v.cast("double")))
    rows = cluster.fill_series(_series(spark, sf_dir).withColumn("v", gaps), ["vec_id"], "v", linear=True)
    return _samples(rows, F.col("filled"))


def global_minimum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _series(spark, sf_dir).select("vec_id", cluster.lowest(F.col("embedding")).alias("pos"))


def key_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In how many series two positions, at least two apart, are both persistent extrema."""
    from ..operators import pairs

    events = cluster.persistent_events(_series(spark, sf_dir), ["vec_id"], "embedding")
    return pairs.pair_support(events, ["vec_id"], "pos", 2)


def lateral_key_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``key_events`` by a table function beside every series."""
    tables.register(spark)
    series = _series(spark, sf_dir)
    return spark.sql("SELECT a, b, count(*) AS support FROM {series} AS s, LATERAL key_pairs(s.embedding, 2) GROUP BY a, b", series=series)


def partitioned_persistence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``persistence_pairs`` by a table function over partitions of samples."""
    tables.register(spark)
    samples = _series(spark, sf_dir).select("vec_id", F.posexplode("embedding").alias("pos", "x")).withColumn("x", F.col("x").cast("double"))
    found = spark.sql("SELECT * FROM persistence_pairs(TABLE(SELECT vec_id, pos, x FROM {samples}) PARTITION BY vec_id ORDER BY pos)", samples=samples)
    return found.select(F.col("key").alias("vec_id"), "minimum", "maximum", _round(F.col("persistence")).alias("persistence"))


def persistence_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(key, *p) for key, values in zip(pdf["vec_id"], pdf["embedding"]) for p in cluster.persistence(np.asarray(values, dtype=np.float64))]
            yield pd.DataFrame(rows, columns=["vec_id", "minimum", "maximum", "persistence"])

    found = _series(spark, sf_dir).select("vec_id", "embedding").mapInPandas(run, "vec_id long, minimum int, maximum int, persistence double")
    return found.withColumn("persistence", _round(F.col("persistence")))


#: Eight frames of eight channels.
FRAMES, CHANNELS = 8, 8


def field_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The factors of the sparse unit that tells the classes apart by left less right halves."""
    halves = _series(spark, sf_dir).select("vec_id", "label", F.slice("embedding", 1, 32).alias("x"), F.slice("embedding", 33, 32).alias("y"))
    found = fields.unit_factors(halves, "vec_id", "label", "x", "y", fields.Unit(epochs=200))
    return found.withColumns({c: _round(F.col(c)) for c in ("factor", "split", "quality")})


def _framed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _series(spark, sf_dir).select("vec_id", "label", F.array(*[F.slice("embedding", CHANNELS * i + 1, CHANNELS) for i in range(FRAMES)]).alias("frames"))


def field_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sparse units of every pair of frames in random subspaces of their channels."""
    pairs = [(a, b) for a in range(FRAMES) for b in range(a + 1, FRAMES)]
    found = fields.search_fields(_framed(spark, sf_dir), "vec_id", "label", "frames", pairs, settings=fields.Unit(epochs=200))
    return found.withColumns({c: _round(F.col(c)) for c in ("sparsity", "split", "quality")} | {"factors": F.transform("factors", lambda f: _round(f))})


def joint_forest_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions, nations and customers as a joint forest: every joint's depth and root (three levels, each one join)."""
    region = spark.read.parquet(f"{sf_dir}/region.parquet").select(F.concat(F.lit("r"), "r_regionkey").alias("joint"), F.concat(F.lit("r"), "r_regionkey").alias("root"))
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.concat(F.lit("n"), "n_nationkey").alias("joint"), F.concat(F.lit("r"), "n_regionkey").alias("parent"))
    leaf = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.concat(F.lit("c"), "c_custkey").alias("joint"), F.concat(F.lit("n"), "c_nationkey").alias("parent"))
    edges, level, out = nation.union(leaf), region, region.withColumn("depth", F.lit(0))
    for depth in (1, 2):
        level = edges.join(level.select(F.col("joint").alias("parent"), "root"), "parent").select("joint", "root")
        out = out.union(level.withColumn("depth", F.lit(depth)))
    return out


QUERIES = {
    f.__name__: f
    for f in (
        dist_matrix_l1, knn_mean_dist, eps_minpts, radius_neighbours, dbscan_clusters, label_distance_map, detrend, edge_blend, median_argmax, tile_windows, dtw_pairs, dtw_labelled, dtw_exponential, dtw_eps, warped_radius, warped_density, warped_clusters, warped_templates,
        dba_templates, template_labels, spline_fill, linear_fill, global_minimum, key_events, lateral_key_events, partitioned_persistence, persistence_pairs, field_units, field_search, joint_forest_depth,
    )
}

_D = "d AS (SELECT l.label, l.vec_id AS a, r.vec_id AS b, round(list_sum(list_transform(list_zip(l.embedding, r.embedding), lambda p: abs(CAST(p[1] AS DOUBLE) - CAST(p[2] AS DOUBLE)))), 6) + 0.0 AS d FROM embeddings l JOIN embeddings r ON l.label = r.label AND l.vec_id < r.vec_id)"
_W = f"{_D}, w AS (SELECT label, a, b, d FROM d UNION ALL SELECT label, b, a, d FROM d)"
_X = "list_transform(embedding, lambda v: CAST(v AS DOUBLE))"
_OUT = "SELECT vec_id, CAST(unnest(range(64)) AS INT) AS pos, unnest(list_transform(y, lambda v: round(v, 6) + 0.0)) AS x FROM y"


def _warped_sql(cell: str) -> str:
    """Warping costs ``d(label, a, b, d)`` of whole series: the cost table's diagonals one after the other, the last two kept per pair. ``cell`` is the cost of samples i and j.

    Diagonal n holds the cells i + j = n from ``lo(n)`` on; what lies beside the table is null, which ``least`` passes over.
    """
    lo = lambda n: f"greatest(1, {n} - 64)"
    marked = "kp" in cell
    marks = ", list_transform(x, lambda v: CASE WHEN v < -0.05 THEN 1 WHEN v > 0.05 THEN 3 ELSE 2 END) AS k" if marked else ""
    kept = "label, a, b, x, y" + (", kp, kq" if marked else "")
    before = f"least(p[i - {lo('(n - 1)')}], c[i - {lo('n')}], c[i - {lo('n')} + 1])"
    return f"""s AS (SELECT label, vec_id, list_transform(embedding, lambda v: CAST(v AS DOUBLE)) AS x FROM embeddings), m AS (SELECT *{marks} FROM s),
      q AS (SELECT l.label, l.vec_id AS a, r.vec_id AS b, l.x AS x, r.x AS y{", l.k AS kp, r.k AS kq" if marked else ""} FROM m l JOIN m r ON l.label = r.label AND l.vec_id < r.vec_id),
      t({kept}, n, p, c) USING KEY (a, b) AS (SELECT {kept}, 2, CAST([] AS DOUBLE[]), [{cell.replace("[i]", "[1]").replace("[j]", "[1]")}] FROM q
        UNION SELECT {kept}, n + 1, c, list_transform(range({lo("(n + 1)")}, least(64, n) + 1), lambda i: {cell.replace("[j]", "[n + 1 - i]")} + {before}) FROM t WHERE n < 128),
      d AS (SELECT label, a, b, round(c[1] / (64 * sqrt(2)), 6) + 0.0 AS d FROM t WHERE n = 128)"""


_CIRCLE = "pow(2.0, CASE WHEN abs(kp[i] - kq[j]) > 1 THEN 3 - abs(kp[i] - kq[j]) ELSE abs(kp[i] - kq[j]) END)"
_PLAIN = _warped_sql("abs(x[i] - y[j])")
_EPS = """w AS (SELECT label, a, b, d FROM d UNION ALL SELECT label, b, a, d FROM d), e AS (SELECT *, min(d) OVER p AS lo, max(d) OVER p AS hi FROM w WINDOW p AS (PARTITION BY label, a)),
      z AS (SELECT label, a, floor((d - lo) / nullif(hi - lo, 0) * 100) AS bin, avg(d) AS m FROM e WHERE d >= lo + (hi - lo) * 0.012 AND d <= hi - (hi - lo) * 0.012 GROUP BY ALL),
      r AS (SELECT *, row_number() OVER (PARTITION BY label, a ORDER BY m) AS r FROM z), h AS (SELECT label, a, k, avg(m) AS mean FROM r, range(3, 6) AS x(k) WHERE r <= k GROUP BY ALL),
      v AS (SELECT label, k, avg(mean) AS eps FROM h GROUP BY ALL), eps AS (SELECT label, round(min(eps), 6) + 0.0 AS eps, CAST(arg_min(k, (eps, k)) AS INT) AS min_pts FROM v GROUP BY label)"""

ORACLE_SQL = {
    "dtw_pairs": f"WITH RECURSIVE {_PLAIN} SELECT label, a, b, d AS cost FROM d",
    "warped_radius": f"WITH RECURSIVE {_PLAIN} SELECT label, a, b, d AS cost FROM d WHERE d <= {WARPED_EPS!r}",
    "dtw_labelled": f"WITH RECURSIVE {_warped_sql(f'abs((x[i] - y[j]) * {_CIRCLE})')} SELECT label, a, b, d AS cost FROM d",
    "dtw_exponential": f"WITH RECURSIVE {_warped_sql('exp(-(x[i] - y[j]) / 0.5)')} SELECT label, a, b, d AS cost FROM d",
    "dtw_eps": f"WITH RECURSIVE {_PLAIN}, {_EPS} SELECT label, eps, min_pts FROM eps",
    "warped_clusters": f"""WITH RECURSIVE {_PLAIN}, {_EPS}, n AS (SELECT w.label, w.a, w.b FROM w JOIN eps USING (label) WHERE d <= eps), c AS (SELECT n.label, n.a FROM n JOIN eps USING (label) GROUP BY n.label, n.a, min_pts HAVING count(*) + 1 >= min_pts),
      l AS (SELECT n.a, n.b FROM n WHERE n.a IN (SELECT a FROM c) AND n.b IN (SELECT a FROM c)), reach(a, b) AS (SELECT a, a FROM c UNION SELECT reach.a, l.b FROM reach JOIN l ON reach.b = l.a), root AS (SELECT a, min(b) AS root FROM reach GROUP BY a),
      o AS (SELECT p.label, p.vec_id AS a, coalesce((SELECT root FROM root WHERE root.a = p.vec_id), (SELECT min(root) FROM n JOIN root ON n.b = root.a WHERE n.a = p.vec_id)) AS cluster FROM embeddings p),
      k AS (SELECT o.label, cluster FROM o JOIN eps USING (label) WHERE cluster IS NOT NULL GROUP BY o.label, cluster, min_pts HAVING count(*) > min_pts), kept AS (SELECT o.* FROM o JOIN k ON o.label = k.label AND o.cluster = k.cluster)
      SELECT label, a, cluster FROM kept UNION ALL SELECT label, vec_id, 2 FROM embeddings WHERE label NOT IN (SELECT label FROM kept)""",
    "persistence_pairs": f"WITH {PERSISTENCE} SELECT vec_id, minimum, maximum, round(persistence, 6) + 0.0 AS persistence FROM found",
    "partitioned_persistence": f"WITH {PERSISTENCE} SELECT vec_id, minimum, maximum, round(persistence, 6) + 0.0 AS persistence FROM found",
    "lateral_key_events": f"WITH {PERSISTENCE}, {KEY_EVENTS} SELECT l.pos AS a, r.pos AS b, count(*) AS support FROM ev l JOIN ev r ON l.vec_id = r.vec_id AND r.pos >= l.pos + 2 GROUP BY l.pos, r.pos",
    "key_events": f"WITH {PERSISTENCE}, {KEY_EVENTS} SELECT l.pos AS a, r.pos AS b, count(*) AS support FROM ev l JOIN ev r ON l.vec_id = r.vec_id AND r.pos >= l.pos + 2 GROUP BY l.pos, r.pos",
    "linear_fill": f"WITH y AS (SELECT vec_id, list_transform(range(1, 65), lambda i: CASE WHEN i % 5 <> 1 THEN CAST(embedding[i] AS DOUBLE) WHEN i = 1 THEN 2 * CAST(embedding[2] AS DOUBLE) - CAST(embedding[3] AS DOUBLE) ELSE (CAST(embedding[i - 1] AS DOUBLE) + CAST(embedding[i + 1] AS DOUBLE)) / 2 END) AS y FROM embeddings) {_OUT}",
    "global_minimum": "SELECT vec_id, CAST(list_position(embedding, list_min(embedding)) - 1 AS INT) AS pos FROM embeddings",
    "dist_matrix_l1": f"WITH {_D} SELECT * FROM d",
    "knn_mean_dist": f"WITH {_W}, k AS (SELECT *, row_number() OVER (PARTITION BY label, a ORDER BY d, b) AS r FROM w) SELECT label, a, round(avg(d), 6) + 0.0 AS mean FROM k WHERE r <= 3 GROUP BY label, a",
    "eps_minpts": f"""WITH {_W}, e AS (SELECT *, min(d) OVER p AS lo, max(d) OVER p AS hi FROM w WINDOW p AS (PARTITION BY label, a)),
      m AS (SELECT label, a, floor((d - lo) / nullif(hi - lo, 0) * 100) AS bin, avg(d) AS m FROM e WHERE d >= lo + (hi - lo) * 0.012 AND d <= hi - (hi - lo) * 0.012 GROUP BY ALL),
      r AS (SELECT *, row_number() OVER (PARTITION BY label, a ORDER BY m) AS r FROM m), t AS (SELECT label, a, k, avg(m) AS mean FROM r, range(3, 6) AS x(k) WHERE r <= k GROUP BY ALL),
      g AS (SELECT label, k, avg(mean) AS eps FROM t GROUP BY ALL) SELECT label, round(min(eps), 6) + 0.0 AS eps, CAST(arg_min(k, (eps, k)) AS INT) AS min_pts FROM g GROUP BY label""",
    "radius_neighbours": f"WITH {_W} SELECT label, a, count(*) AS n FROM w WHERE d <= {EPS} GROUP BY label, a",
    "dbscan_clusters": f"""WITH RECURSIVE {_W}, n AS (SELECT * FROM w WHERE d <= {EPS}), c AS (SELECT label, a FROM n GROUP BY label, a HAVING count(*) + 1 >= 3), e AS (SELECT n.a, n.b FROM n WHERE n.a IN (SELECT a FROM c) AND n.b IN (SELECT a FROM c)),
      reach(a, b) AS (SELECT a, a FROM c UNION SELECT r.a, e.b FROM reach r JOIN e ON r.b = e.a), root AS (SELECT a, min(b) AS root FROM reach GROUP BY a),
      m AS (SELECT p.label, p.vec_id AS a, coalesce((SELECT root FROM root WHERE root.a = p.vec_id), (SELECT min(root) FROM n JOIN root ON n.b = root.a WHERE n.a = p.vec_id)) AS cluster FROM embeddings p),
      k AS (SELECT label, cluster FROM m WHERE cluster IS NOT NULL GROUP BY ALL HAVING count(*) > 3), kept AS (SELECT m.* FROM m JOIN k ON m.label = k.label AND m.cluster = k.cluster)
      SELECT label, a, cluster FROM kept UNION ALL SELECT label, vec_id, 2 FROM embeddings WHERE label NOT IN (SELECT label FROM kept)""",
    "label_distance_map": "WITH c AS (SELECT label + 1 AS l, count(*) AS n FROM embeddings GROUP BY label) SELECT CAST(x.l AS INT) AS l1, CAST(y.l AS INT) AS l2, round(pow(2.718281828459045, CAST(CASE WHEN abs(x.l - y.l) > 5 THEN 10 - abs(x.l - y.l) ELSE abs(x.l - y.l) END AS DOUBLE)), 6) + 0.0 AS distance, x.n + y.n AS series FROM c x CROSS JOIN c y",
    "detrend": f"WITH y AS (SELECT vec_id, list_transform({_X}, lambda v, i: v - (CAST(embedding[64] AS DOUBLE) - CAST(embedding[1] AS DOUBLE)) / 64 * (i - 1)) AS y FROM embeddings) {_OUT}",
    "edge_blend": f"WITH m AS (SELECT vec_id, {_X} AS x, (CAST(embedding[1] AS DOUBLE) + CAST(embedding[64] AS DOUBLE)) / 2 AS mid FROM embeddings), y AS (SELECT vec_id, list_transform(x, lambda v, i: CASE WHEN least(i - 1, 64 - i) < 6 THEN mid + (v - mid) * least(i - 1, 64 - i) / 6 ELSE v END) AS y FROM m) {_OUT}",
    "median_argmax": f"WITH m AS (SELECT vec_id, list_transform({_X}, lambda v: round(v, 2)) AS x FROM embeddings) SELECT vec_id, list_sort(x)[33] AS median_upper, CAST(64 - list_position(list_reverse(x), list_max(x)) AS INT) AS argmax_last, CAST(64 - list_position(list_reverse(x), list_min(x)) AS INT) AS argmin_last FROM m",
    "tile_windows": f"WITH m AS (SELECT vec_id, {_X} AS x FROM embeddings), y AS (SELECT vec_id, list_transform(range(64), lambda i: (x[(i + 62) % 64 + 1] + x[(i + 63) % 64 + 1] + x[i + 1] + x[(i + 1) % 64 + 1] + x[(i + 2) % 64 + 1]) / 5) AS y FROM m) {_OUT}",
    "joint_forest_depth": "WITH RECURSIVE e AS (SELECT 'n' || n_nationkey AS joint, 'r' || n_regionkey AS parent FROM nation UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey FROM customer), t(joint, root, depth) AS (SELECT 'r' || r_regionkey, 'r' || r_regionkey, 0 FROM region UNION ALL SELECT e.joint, t.root, t.depth + 1 FROM t JOIN e ON e.parent = t.joint) SELECT joint, root, depth FROM t",
}

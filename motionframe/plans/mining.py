"""Queries over ``embeddings`` read as series with class labels, and over ``lineitem`` as labelled samples: pairs, splits, votes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema
from ..operators import mining as class_mining
from ..operators import cuts, pairs, split

FIELDS = [(i, [(7 * i + 3 * k) % 32 for k in range(4)], [0.5, -1.0, 2.0, 0.25]) for i in range(8)]
FLAGS = ["A", "N", "R"]


def _series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet")


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet")


def _round(c, digits: int = 6):
    return F.round(c, digits) + F.lit(0.0)


def _extrema(spark, sf_dir):
    return pairs.local_extrema(schema.components(_series(spark, sf_dir)), ["vec_id", "label"], "pos", "x")


def extrema_local(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _extrema(spark, sf_dir).select("vec_id", "pos", _round(F.col("x")).alias("x"), "kind")


def _pairs(spark, sf_dir):
    return pairs.pair_support(_extrema(spark, sf_dir), ["vec_id"], "pos", 2)


def event_pairs_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir)


def endpoint_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.endpoint_support(_pairs(spark, sf_dir)).withColumn("mean_support", _round(F.col("mean_support")))


def friend_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which pairs of positions share an endpoint, of those of above mean support."""
    found = _pairs(spark, sf_dir)
    mean = found.agg(F.avg("support").alias("mean"))
    return pairs.friends(found.join(F.broadcast(mean)).where(F.col("support") > F.col("mean")))  # one row


def pair_friends(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.friend_counts(_pairs(spark, sf_dir))


def allocation_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A budget of 100 pairs shared by the classes in proportion to their pairs' mean support; each takes its best."""
    rows = pairs.pair_support(_extrema(spark, sf_dir), ["vec_id", "label"], "pos", 2, ["label"])
    groups = pairs.allocate(rows.groupBy("label").agg(F.avg("support").alias("mean")), "mean", 100)
    return pairs.top_by_share(rows, groups, ["label"], [F.desc("support"), F.col("a"), F.col("b")]).select("label", "a", "b", "support", F.col("rank").cast("int").alias("rank"))


def pair_offsets_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of offsets up to eight samples from a place, and at how many places of the series both are extrema."""
    seen = pairs.offset_support(_extrema(spark, sf_dir), ["vec_id"], "pos", 8, 64)
    return pairs.offset_grid(spark, 8).join(seen, ["a", "b"], "left").select("a", "b", "kind", F.coalesce("support", F.lit(0)).cast("long").alias("support"))


def pair_diff_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pairs.apply_fields(_series(spark, sf_dir), ["vec_id"], F.slice("embedding", 1, 32), F.slice("embedding", 33, 32), FIELDS)
    return rows.withColumn("feature", _round(F.col("feature")))


def anti_similar_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each series' four largest positions as a candidate field; those too like a better one of their class go."""
    by_size = F.slice(F.reverse(F.array_sort(F.transform("embedding", lambda x, i: F.struct(F.abs(x.cast("double")).alias("m"), i.alias("i"))))), 1, 4)
    rows = _series(spark, sf_dir).select("vec_id", "label", by_size.alias("top"))
    rows = rows.select("vec_id", "label", F.transform("top", lambda t: t["i"]).alias("indices"), _round(F.aggregate("top", F.lit(0.0), lambda a, t: a + t["m"])).alias("quality"))
    return pairs.drop_similar(rows, ["label"], "vec_id", "indices", "quality").select("label", "vec_id", "quality")


def field_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidate fields at least half as good as the best; the classes share 60 places by their mean quality and take their sparsest."""
    size = F.transform("embedding", lambda x: F.abs(x.cast("double")))
    rows = _series(spark, sf_dir).select("label", "vec_id", _round(F.aggregate(size, F.lit(0.0), lambda a, x: a + x)).alias("quality"), (F.size(F.filter(size, lambda x: x > 0.1)) / 64.0).alias("sparsity"))
    best = rows.agg(F.max("quality").alias("best"))
    kept = rows.join(F.broadcast(best)).where(F.col("quality") >= F.col("best") * 0.5).drop("best")  # one row
    shares = pairs.allocate(kept.groupBy("label").agg(_round(F.avg("quality")).alias("mean")), "mean", 60)
    return pairs.top_by_share(kept, shares, ["label"], [F.col("sparsity"), F.desc("quality"), F.col("vec_id")]).withColumn("rank", F.col("rank").cast("int"))


def clean_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per class how many feature rows are whole, and the mean feature with missing ones as 0; every 50th quantity is missing."""
    x = F.array(F.when(F.col("l_quantity") != 50, F.col("l_quantity").cast("double")), F.col("l_discount"), F.when(F.col("l_tax") == 0.08, F.lit(float("nan"))).otherwise(F.col("l_tax")))
    bad = lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))
    rows = _items(spark, sf_dir).select("l_returnflag", x.alias("x")).withColumn("whole", (~F.exists("x", bad)).cast("int")).withColumn("z", F.transform("x", lambda v: F.when(bad(v), F.lit(0.0)).otherwise(v)))
    return rows.groupBy("l_returnflag").agg(F.sum("whole").alias("whole"), F.count("*").alias("n"), *[_round(F.avg(F.get("z", F.lit(i)))).alias(f"mean_{i}") for i in range(3)])


def frame_partition_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples at the positions that the pairs of largest support use."""
    best = _pairs(spark, sf_dir).orderBy(F.desc("support"), "a", "b").limit(10)
    used = best.select(F.explode(F.array("a", "b")).alias("pos")).distinct()
    return schema.components(_series(spark, sf_dir)).join(used, "pos", "left_semi").select("vec_id", "pos", _round(F.col("x")).alias("x"))


def label_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split.label_histogram(_items(spark, sf_dir), ["l_linestatus"], "l_returnflag", [*FLAGS, "X"])


def majority_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split.majority(_items(spark, sf_dir), ["l_quantity"], "l_returnflag").withColumn("local_risk", _round(F.col("local_risk")))


def best_split_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = split.best_split(schema.components(_series(spark, sf_dir)), ["pos"], "x", "label", list(range(10)))
    return found.select("pos", _round(F.col("threshold")).alias("threshold"), _round(F.col("quality")).alias("quality"))


def _melted(spark, sf_dir):
    columns = ("l_quantity", "l_discount", "l_tax", "l_extendedprice")
    one = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("x")) for c in columns])
    return _items(spark, sf_dir).select("l_returnflag", F.explode(one).alias("v")).select("l_returnflag", "v.feature", "v.x")


def best_split_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = split.best_split(_melted(spark, sf_dir), ["feature"], "x", "l_returnflag", FLAGS)
    return found.select("feature", _round(F.col("threshold")).alias("threshold"), _round(F.col("quality"), 4).alias("quality"))


def two_class_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best cut's quality of every position for every pair of classes."""
    found = cuts.pair_cuts(schema.components(_series(spark, sf_dir)), ["pos"], "x", "label", list(range(10)))
    return found.select("pos", "l1", "l2", _round(F.col("quality")).alias("quality"))


#: Offsets of candidate pairs from a place, in samples; labels of samples by their size; places that the channels share.
OFFSETS, MARKS, BUDGET = [(-24, -8), (-16, 16), (-8, 0), (-3, 12), (0, 20), (8, 28)], [1, 2, 3], 25


def _shapes(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """The series as closed shapes of their class's channel with a label at each sample, and every channel's candidate pairs."""
    marks = F.transform("embedding", lambda v: F.when(v.cast("double") < -0.05, 1).when(v.cast("double") > 0.05, 3).otherwise(2))
    shapes = _series(spark, sf_dir).select(F.col("label").alias("channel"), "vec_id", "embedding", marks.alias("marks"))
    offered = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in OFFSETS]))
    return shapes, shapes.select("channel").distinct().withColumn("o", offered).select("channel", "o.a", "o.b")


def pair_slopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each candidate pair's three slopes, per class of samples: how many, their mean and ends."""
    shapes, candidates = _shapes(spark, sf_dir)
    slopes = class_mining.window_slopes(shapes, candidates, "channel", "vec_id", "embedding", "marks")
    found = slopes.groupBy("channel", "a", "b", "kind", F.col("label").alias("mark")).agg(F.count("*").alias("n"), F.avg("x").alias("mean"), F.min("x").alias("least"), F.max("x").alias("most"))
    return found.withColumns({c: _round(F.col(c)) for c in ("mean", "least", "most")})


def _class_qualities(spark, sf_dir, draws: int = 0) -> tuple[DataFrame, DataFrame]:
    shapes, candidates = _shapes(spark, sf_dir)
    slopes = class_mining.window_slopes(shapes, candidates, "channel", "vec_id", "embedding", "marks")
    return candidates, class_mining.class_quality(slopes, ["channel", "a", "b"], ["vec_id", "at", "kind"], "label", "x", MARKS, draws)


def pair_class_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well each candidate pair's slopes part every two classes of samples."""
    return _class_qualities(spark, sf_dir)[1].withColumn("quality", _round(F.col("quality"), 4))


def mined_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The candidates' qualities summed, the channels' means, and each channel's best by its share of the budget."""
    candidates, found = _class_qualities(spark, sf_dir)
    totals = class_mining.summed_quality(found, candidates, "channel").withColumn("total", _round(F.col("total"), 4))
    return class_mining.select_pairs(totals, "channel", BUDGET).withColumn("rank", F.col("rank").cast("int"))


def drawn_class_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same qualities over draws that take as many rows of each class."""
    return _class_qualities(spark, sf_dir, 4)[1].withColumn("quality", _round(F.col("quality"), 4))


def branch_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    side = split.branch(F.when(F.col("l_quantity") != 7, F.col("l_quantity").cast("double")), F.lit(25.5))
    return _items(spark, sf_dir).groupBy(side.alias("side"), "l_returnflag").agg(F.count("*").alias("n"))


def _stumps(spark, sf_dir):
    stump = lambda c, t, a, b: F.when(F.col(c) <= t, a).otherwise(b)
    given = F.array(stump("l_quantity", 25, "A", "N"), stump("l_discount", 0.05, "N", "R"), stump("l_tax", 0.04, "R", "A"))
    return _items(spark, sf_dir).select("l_orderkey", "l_linenumber", "l_returnflag", F.posexplode(given).alias("tree", "label"))


def _voted(spark, sf_dir):
    return split.vote(_stumps(spark, sf_dir), ["l_orderkey", "l_linenumber", "l_returnflag"], "label")


def vote_majority(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _voted(spark, sf_dir).select("l_orderkey", "l_linenumber", "votes", "predicted")


def vote_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stumps(spark, sf_dir).groupBy("l_returnflag").pivot("label", FLAGS).agg(F.count(F.lit(1))).na.fill(0)


def accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split.evaluate(_voted(spark, sf_dir), "l_returnflag", "predicted").withColumn("accuracy", _round(F.col("accuracy")))


def marginals(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = _voted(spark, sf_dir).select(F.explode(F.array(F.struct(F.lit("label").alias("side"), F.col("l_returnflag").alias("value")), F.struct(F.lit("predicted").alias("side"), F.col("predicted").alias("value")))).alias("m"))
    return both.groupBy(F.col("m.side").alias("side"), F.col("m.value").alias("value")).agg(F.count("*").alias("n"))


def forest_predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A small forest over the series' samples, grown level by level, and its votes."""
    rows = _series(spark, sf_dir)
    forest = split.grow_forest(rows, "vec_id", "embedding", "label", 64, list(range(10)), trees=3, depth=3)
    return split.predict_forest(rows, ["vec_id", "label"], "embedding", forest)


QUERIES = {
    f.__name__: f
    for f in (
        extrema_local, event_pairs_support, endpoint_support, pair_friends, friend_pairs, allocation_topk, pair_offsets_grid, pair_diff_features, anti_similar_fields, field_filter, clean_samples, frame_partition_semi, label_histogram,
        majority_risk, best_split_embeddings, best_split_lineitem, two_class_quality, pair_slopes, pair_class_quality, mined_pairs, drawn_class_quality, branch_assign, vote_majority, vote_counts, accuracy, marginals, forest_predict,
    )
}

_P = "p AS (SELECT vec_id, label, CAST(unnest(range(64)) AS INT) AS pos, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings)"
_E = f"{_P}, e AS (SELECT * FROM (SELECT *, CASE WHEN x > lag(x) OVER w AND x > lead(x) OVER w THEN 'max' WHEN x < lag(x) OVER w AND x < lead(x) OVER w THEN 'min' END AS kind FROM p WINDOW w AS (PARTITION BY vec_id ORDER BY pos)) WHERE kind IS NOT NULL)"
_S = f"{_E}, s AS (SELECT l.pos AS a, r.pos AS b, count(*) AS support FROM e l JOIN e r ON l.vec_id = r.vec_id AND r.pos >= l.pos + 2 GROUP BY l.pos, r.pos)"
_STUMPS = """v AS (SELECT l_orderkey, l_linenumber, l_returnflag, unnest([CASE WHEN l_quantity <= 25 THEN 'A' ELSE 'N' END, CASE WHEN l_discount <= 0.05 THEN 'N' ELSE 'R' END, CASE WHEN l_tax <= 0.04 THEN 'R' ELSE 'A' END]) AS label FROM lineitem),
c AS (SELECT l_orderkey, l_linenumber, l_returnflag, label, count(*) AS votes FROM v GROUP BY ALL),
b AS (SELECT l_orderkey, l_linenumber, l_returnflag, max(votes) AS votes, arg_min(label, (-votes, label)) AS predicted FROM c GROUP BY l_orderkey, l_linenumber, l_returnflag)"""


def _split_sql(source: str, by: str, label: str, digits: int) -> str:
    return f"""src AS ({source}), n AS (SELECT {by}, {label} AS lab, count(*) AS tot FROM src GROUP BY {by}, {label}), z AS (SELECT {by}, sum(tot * tot) AS sq, sum(tot) AS tot FROM n GROUP BY {by}),
    r AS (SELECT *, {label} AS lab, row_number() OVER (PARTITION BY {by}, {label} ORDER BY x) AS k, row_number() OVER w AS i, lead(x) OVER w AS nx FROM src WINDOW w AS (PARTITION BY {by} ORDER BY x, {label})),
    q AS (SELECT r.*, n.tot AS nt, z.sq, z.tot AS total FROM r JOIN n USING ({by}, lab) JOIN z USING ({by})),
    a AS (SELECT *, CAST(sum(2 * k - 1) OVER w AS DOUBLE) AS ls, CAST(sq - sum(2 * (nt - k) + 1) OVER w AS DOUBLE) AS rs FROM q WINDOW w AS (PARTITION BY {by} ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
    cuts AS (SELECT {by}, (x + nx) / 2 AS threshold, ls / i + rs / (total - i) AS quality FROM a WHERE nx > x + 2 * 1.1920929e-07),
    best AS (SELECT {by}, round(arg_min(threshold, (-round(quality, 9), threshold)), 6) + 0.0 AS threshold, round(max(quality), {digits}) + 0.0 AS quality FROM cuts GROUP BY {by})"""


_WRAP = lambda c: f"(CASE WHEN i / 63.0 + {c} / 64.0 > 1.0 THEN i / 63.0 + {c} / 64.0 - 1.0 WHEN i / 63.0 + {c} / 64.0 < 0.0 THEN i / 63.0 + {c} / 64.0 + 1.0 ELSE i / 63.0 + {c} / 64.0 END)"
_OFF = lambda c: f"least(greatest(CAST(trunc({_WRAP(c)} * 63) AS INT), 0), 63)"
_SLOPE = lambda i, j: f"(CAST(embedding[{i} + 1] AS DOUBLE) - CAST(embedding[{j} + 1] AS DOUBLE)) / nullif({i} / 64.0 - {j} / 64.0, 0)"
_SLOPES = f"""offered AS (SELECT * FROM (VALUES {", ".join(f"({a}, {b})" for a, b in OFFSETS)}) AS o(a, b)),
  placed AS (SELECT label AS channel, a, b, i, embedding, {_OFF("a")} AS l, {_OFF("b")} AS r, CASE WHEN CAST(embedding[i + 1] AS DOUBLE) < -0.05 THEN 1 WHEN CAST(embedding[i + 1] AS DOUBLE) > 0.05 THEN 3 ELSE 2 END AS mark FROM embeddings, offered, (SELECT CAST(x AS INT) AS i FROM range(64) AS g(x))),
  slopes AS (SELECT channel, a, b, mark, kind, x FROM (SELECT channel, a, b, mark, 'left' AS kind, {_SLOPE("l", "i")} AS x FROM placed UNION ALL SELECT channel, a, b, mark, 'right', {_SLOPE("i", "r")} FROM placed UNION ALL SELECT channel, a, b, mark, 'all', {_SLOPE("l", "r")} FROM placed) WHERE x IS NOT NULL)"""
_QUALITIES = f"""{_SLOPES}, {_split_sql("SELECT channel, a, b, x, CAST(least(mark, o) AS INT) AS l1, CAST(greatest(mark, o) AS INT) AS l2, CAST(mark < o AS INT) AS fst FROM slopes, range(1, 4) AS y(o) WHERE o <> mark", "channel, a, b, l1, l2", "fst", 9)}"""

ORACLE_SQL = {
    "pair_slopes": f"WITH {_SLOPES} SELECT channel, a, b, kind, mark, count(*) AS n, round(avg(x), 6) + 0.0 AS mean, round(min(x), 6) + 0.0 AS least, round(max(x), 6) + 0.0 AS most FROM slopes GROUP BY ALL",
    "pair_class_quality": f"WITH {_QUALITIES} SELECT channel, a, b, l1, l2, round(quality, 4) + 0.0 AS quality FROM best",
    "mined_pairs": f"""WITH {_QUALITIES}, totals AS (SELECT channel, a, b, round(sum(quality), 4) + 0.0 AS total FROM best GROUP BY channel, a, b), means AS (SELECT channel, avg(total) AS mean FROM totals GROUP BY channel),
      shares AS (SELECT channel, CAST(floor(mean / (SELECT sum(mean) FROM means) * {BUDGET} + 0.5) AS BIGINT) AS share FROM means),
      ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY channel ORDER BY total DESC, a, b) AS INT) AS rank FROM totals) SELECT channel, a, b, total, rank FROM ranked JOIN shares USING (channel) WHERE rank <= share""",
    "extrema_local": f"WITH {_E} SELECT vec_id, pos, round(x, 6) + 0.0 AS x, kind FROM e",
    "event_pairs_support": f"WITH {_S} SELECT a, b, support FROM s",
    "endpoint_support": f"WITH {_S} SELECT pos, count(*) AS pairs, round(avg(support), 6) + 0.0 AS mean_support FROM (SELECT unnest([a, b]) AS pos, support FROM s) GROUP BY pos",
    "friend_pairs": f"WITH {_S}, k AS (SELECT a, b FROM s WHERE support > (SELECT avg(support) FROM s)) SELECT l.a, l.b, r.a AS c, r.b AS d FROM k l JOIN k r ON (l.a = r.a OR l.a = r.b OR l.b = r.a OR l.b = r.b) AND NOT (l.a = r.a AND l.b = r.b)",
    "pair_friends": f"WITH {_S} SELECT l.a, l.b, count(r.a) AS friends FROM s l LEFT JOIN s r ON (l.a = r.a OR l.a = r.b OR l.b = r.a OR l.b = r.b) AND NOT (l.a = r.a AND l.b = r.b) GROUP BY l.a, l.b",
    "allocation_topk": f"""WITH {_E}, g AS (SELECT l.label, l.pos AS a, r.pos AS b, count(*) AS support FROM e l JOIN e r ON l.vec_id = r.vec_id AND r.pos >= l.pos + 2 GROUP BY l.label, l.pos, r.pos),
      m AS (SELECT label, avg(support) AS mean FROM g GROUP BY label), k AS (SELECT label, CAST(floor(mean / (SELECT sum(mean) FROM m) * 100 + 0.5) AS BIGINT) AS share FROM m),
      o AS (SELECT *, CAST(row_number() OVER (PARTITION BY label ORDER BY support DESC, a, b) AS INT) AS rank FROM g) SELECT label, a, b, support, rank FROM o JOIN k USING (label) WHERE rank <= share""",
    "pair_offsets_grid": f"""WITH {_E}, g AS (SELECT CAST(i AS INT) AS i FROM range(-8, 9) AS x(i)), s AS (SELECT l.pos - p.i AS a, r.pos - p.i AS b, count(*) AS support FROM e l JOIN e r ON l.vec_id = r.vec_id AND l.pos < r.pos JOIN range(64) AS p(i) ON abs(l.pos - p.i) <= 8 AND abs(r.pos - p.i) <= 8 GROUP BY ALL)
      SELECT l.i AS a, r.i AS b, CASE WHEN r.i <= 0 THEN 'left' WHEN l.i >= 0 THEN 'right' ELSE 'all' END AS kind, coalesce(support, 0) AS support FROM g l JOIN g r ON l.i < r.i LEFT JOIN s ON s.a = l.i AND s.b = r.i""",
    "pair_diff_features": " UNION ALL ".join("SELECT vec_id, {} AS field, round({}, 6) + 0.0 AS feature FROM embeddings".format(i, " + ".join(f"(CAST(embedding[{k + 1}] AS DOUBLE) - CAST(embedding[{k + 33}] AS DOUBLE)) * {f}" for k, f in zip(at, by))) for i, at, by in FIELDS),
    "anti_similar_fields": f"""WITH {_P}, t AS (SELECT vec_id, label, pos, abs(x) AS m, row_number() OVER (PARTITION BY vec_id ORDER BY abs(x) DESC, pos DESC) AS k FROM p), c AS (SELECT vec_id, label, list(pos) AS ix, round(sum(m ORDER BY k), 6) + 0.0 AS quality FROM t WHERE k <= 4 GROUP BY vec_id, label)
      SELECT label, vec_id, quality FROM c WHERE NOT EXISTS (SELECT 1 FROM c o WHERE o.label = c.label AND (o.quality > c.quality OR (o.quality = c.quality AND o.vec_id < c.vec_id)) AND len(list_intersect(o.ix, c.ix)) / 4.0 > 0.25)""",
    "field_filter": """WITH r AS (SELECT label, vec_id, round(list_sum(list_transform(embedding, lambda v: abs(CAST(v AS DOUBLE)))), 6) + 0.0 AS quality, len(list_filter(embedding, lambda v: abs(CAST(v AS DOUBLE)) > 0.1)) / 64.0 AS sparsity FROM embeddings),
      k AS (SELECT * FROM r WHERE quality >= (SELECT max(quality) FROM r) * 0.5), m AS (SELECT label, round(avg(quality), 6) + 0.0 AS mean FROM k GROUP BY label), s AS (SELECT label, CAST(floor(mean / (SELECT sum(mean) FROM m) * 60 + 0.5) AS BIGINT) AS share FROM m),
      o AS (SELECT *, CAST(row_number() OVER (PARTITION BY label ORDER BY sparsity, quality DESC, vec_id) AS INT) AS rank FROM k) SELECT label, vec_id, quality, sparsity, rank FROM o JOIN s USING (label) WHERE rank <= share""",
    "clean_samples": "SELECT l_returnflag, CAST(sum(CAST(l_quantity <> 50 AND l_tax <> 0.08 AS INT)) AS BIGINT) AS whole, count(*) AS n, round(avg(CASE WHEN l_quantity = 50 THEN 0 ELSE l_quantity END), 6) + 0.0 AS mean_0, round(avg(l_discount), 6) + 0.0 AS mean_1, round(avg(CASE WHEN l_tax = 0.08 THEN 0 ELSE l_tax END), 6) + 0.0 AS mean_2 FROM lineitem GROUP BY l_returnflag",
    "frame_partition_semi": f"WITH {_S}, t AS (SELECT a, b FROM s ORDER BY support DESC, a, b LIMIT 10) SELECT vec_id, pos, round(x, 6) + 0.0 AS x FROM p WHERE pos IN (SELECT a FROM t UNION SELECT b FROM t)",
    "label_histogram": "WITH l AS (SELECT unnest(['A', 'N', 'R', 'X']) AS l_returnflag) SELECT s.l_linestatus, l.l_returnflag, count(i.l_orderkey) AS n FROM (SELECT DISTINCT l_linestatus FROM lineitem) s CROSS JOIN l LEFT JOIN lineitem i ON i.l_linestatus = s.l_linestatus AND i.l_returnflag = l.l_returnflag GROUP BY s.l_linestatus, l.l_returnflag",
    "majority_risk": "WITH c AS (SELECT l_quantity, l_returnflag, count(*) AS c FROM lineitem GROUP BY ALL) SELECT l_quantity, arg_min(l_returnflag, (-c, l_returnflag)) AS majority, CAST(sum(c) AS BIGINT) AS n, CAST(sum(c) - max(c) AS BIGINT) AS risk, round((sum(c) - max(c)) / sum(c), 6) + 0.0 AS local_risk FROM c GROUP BY l_quantity",
    "best_split_embeddings": f"WITH {_P}, {_split_sql('SELECT pos, x, label FROM p', 'pos', 'label', 6)} SELECT * FROM best",
    "best_split_lineitem": "WITH " + _split_sql(" UNION ALL ".join(f"SELECT '{c}' AS feature, CAST({c} AS DOUBLE) AS x, l_returnflag FROM lineitem" for c in ("l_quantity", "l_discount", "l_tax", "l_extendedprice")), "feature", "l_returnflag", 4) + " SELECT * FROM best",
    "two_class_quality": f"WITH {_P}, {_split_sql('SELECT pos, x, least(label, o) AS l1, greatest(label, o) AS l2, CAST(label < o AS INT) AS fst FROM p, range(10) AS y(o) WHERE o <> label', 'pos, l1, l2', 'fst', 6)} SELECT pos, CAST(l1 AS INT) AS l1, CAST(l2 AS INT) AS l2, quality FROM best",
    "branch_assign": "SELECT CASE WHEN l_quantity = 7 THEN 'right' WHEN l_quantity <= 25.5 THEN 'left' ELSE 'right' END AS side, l_returnflag, count(*) AS n FROM lineitem GROUP BY ALL",
    "vote_majority": f"WITH {_STUMPS} SELECT l_orderkey, l_linenumber, votes, predicted FROM b",
    "vote_counts": f"WITH {_STUMPS} SELECT l_returnflag, " + ", ".join(f'count(*) FILTER (label = \'{f}\') AS "{f}"' for f in FLAGS) + " FROM v GROUP BY l_returnflag",
    "accuracy": f"WITH {_STUMPS} SELECT count(*) AS n, CAST(sum(CAST(l_returnflag = predicted AS INT)) AS BIGINT) AS correct, round(avg(CAST(l_returnflag = predicted AS INT)), 6) + 0.0 AS accuracy FROM b",
    "marginals": f"WITH {_STUMPS} SELECT 'label' AS side, l_returnflag AS value, count(*) AS n FROM b GROUP BY ALL UNION ALL SELECT 'predicted', predicted, count(*) FROM b GROUP BY ALL",
}

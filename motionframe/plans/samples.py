"""Queries of rows, labels, fields and windows: filters, joins by ordinal, persistent extrema, fields from tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema
from ..operators import cluster, cycles, pairs, skeleton, split


def _series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schema.markers(spark.read.parquet(f"{sf_dir}/events.parquet"))


def _round(c, digits: int = 6):
    return F.round(c, digits) + F.lit(0.0)


def valid_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose label is not negative, labels counted from 3."""
    rows = _series(spark, sf_dir).select("vec_id", (F.col("label") - 3).alias("label"))
    return rows.where("label >= 0")


def pair_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Series 100 to 199 of a numbered input."""
    return pairs.batch(_series(spark, sf_dir).select("vec_id", "label"), "vec_id", 100, 200)


def eligible_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of the users that have 60 events or more, of all five kinds."""
    rows = _events(spark, sf_dir).select("seq_id", F.col("event_id").alias("frame"), F.col("mark").alias("joint_id"))
    return skeleton.eligible(rows, "seq_id", 5, 60).groupBy("seq_id").agg(F.count("*").alias("n"))


def window_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events within ten days of their user's third one, and how much of that window has passed."""
    from pyspark.sql import Window

    rows = _events(spark, sf_dir).withColumn("start", F.nth_value("t", 3).over(Window.partitionBy("seq_id").orderBy("t").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    return cycles.in_window(rows.withColumn("duration", F.lit(864_000_000.0)), "t", "start", "duration").select("event_id", _round(F.col("share")).alias("share"))


def asof_left_fuzzy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each purchase's nearest view before it, or after it within an hour."""
    return _fuzzy(spark, sf_dir, "left")


def asof_right_fuzzy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fuzzy(spark, sf_dir, "right")


def _fuzzy(spark, sf_dir, side: str) -> DataFrame:
    rows = _events(spark, sf_dir)
    buys, views = rows.where("mark = 3").select("seq_id", "t", "event_id"), rows.where("mark = 2").select("seq_id", "t", F.col("event_id").alias("view_id"))
    found = cycles.asof_nearest(buys, views, ["seq_id"], "t", "event_id", "view_id", 3_600_000.0, side)
    return found.select("event_id", "view_id", _round(F.col("gap"), 3).alias("gap"))


def root_velocity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each class's series read as one track of points, a series a moment: the distance of its ends over the time between."""
    rows = _series(spark, sf_dir).select("label", F.col("vec_id").cast("double").alias("t"), *[F.when(F.get("embedding", F.lit(3)) > -0.1, F.get("embedding", F.lit(i)).cast("double")).alias(c) for i, c in enumerate("xyz")])
    return cycles.path_velocity(rows, ["label"], "t", ["x", "y", "z"]).select("label", _round(F.col("velocity"), 9).alias("velocity"))


def cycle_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From every position of a cyclic series: the samples around it, weighed by their place."""
    rows = _series(spark, sf_dir).select("vec_id", F.explode(cycles.cycle_windows(F.col("embedding"))).alias("w"))
    weighed = F.aggregate(F.transform("w.window", lambda x, i: x.cast("double") * (i + 1)), F.lit(0.0), lambda s, x: s + x)
    return rows.select("vec_id", F.col("w.start").alias("start"), _round(weighed).alias("weighed"))


def factor_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A series' four largest samples as factors, in the order of their positions."""
    top = F.slice(F.reverse(F.array_sort(F.transform("embedding", lambda x, i: F.struct(x.cast("double").alias("x"), i.alias("i"))))), 1, 4)
    rows = _series(spark, sf_dir).select("vec_id", top.alias("top"))
    ordered = pairs.by_index(F.transform("top", lambda t: t["i"]), F.transform("top", lambda t: t["x"]))
    return rows.select("vec_id", F.posexplode(ordered).alias("nth", "f")).select("vec_id", "nth", F.col("f.index").alias("position"), _round(F.col("f.factor")).alias("factor"))


def logistic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _series(spark, sf_dir).select("vec_id", F.posexplode("embedding").alias("pos", "x")).select("vec_id", "pos", _round(pairs.logistic(F.col("x").cast("double") * 10)).alias("y"))


def extrema_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The union of a series' minima and maxima, and whether it has as many positions as both together."""
    found = pairs.local_extrema(schema.components(_series(spark, sf_dir)), ["vec_id"], "pos", "x").groupBy("vec_id").agg(
        *[F.array_sort(F.collect_list(F.when(F.col("kind") == k, F.col("pos")))).alias(k) for k in ("min", "max")]
    )
    both = F.array_sort(F.array_union("min", "max"))
    return found.select("vec_id", F.array_join(both.cast("array<string>"), ",").alias("positions"), (F.size(both) == F.size("min") + F.size("max")).alias("distinct"))


def frame_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples 5 and 40 of the same series side by side, less each other."""
    points = schema.components(_series(spark, sf_dir))
    joined = pairs.frame_pairs(points.where("pos = 5"), points.where("pos = 40"), "vec_id", "x")
    return joined.select("vec_id", _round(F.col("left") - F.col("right")).alias("apart"))


def _fields(spark: SparkSession) -> DataFrame:
    """Sixteen fields for each of two frame pairs, by a rule."""
    grid = spark.range(32).select((F.col("id") % 2).cast("int").alias("pair"), F.floor(F.col("id") / 2).cast("int").alias("field"))
    k = F.sequence(F.lit(0), F.lit(3))
    return grid.select("pair", "field", F.transform(k, lambda i: F.pmod(F.col("field") * 5 + i * 3 + F.col("pair"), F.lit(16))).alias("indices"), F.transform(k, lambda i: (i - 1.5) * (F.col("pair") + 1)).alias("factors"))


def field_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two frame pairs of a series (its quarters) under the fields of a table."""
    part = lambda i: F.slice("embedding", 16 * i + 1, 16)
    frames = _series(spark, sf_dir).select("vec_id", F.explode(F.array(*[F.struct(F.lit(i).alias("pair"), part(2 * i).alias("left"), part(2 * i + 1).alias("right")) for i in (0, 1)])).alias("p")).select("vec_id", "p.*")
    return pairs.apply_field_table(frames, ["vec_id"], _fields(spark)).select("vec_id", "pair", "field", _round(F.col("feature")).alias("feature"))


def _candidates(spark, sf_dir) -> DataFrame:
    """A candidate field a series: its frame pair by its id, its four largest positions, their size."""
    by_size = F.slice(F.reverse(F.array_sort(F.transform("embedding", lambda x, i: F.struct(F.abs(x.cast("double")).alias("m"), i.alias("i"))))), 1, 4)
    rows = _series(spark, sf_dir).select("vec_id", (F.col("vec_id") % 7).cast("int").alias("a"), (7 + F.col("vec_id") % 11).cast("int").alias("b"), by_size.alias("top"))
    return rows.select("vec_id", "a", "b", F.transform("top", lambda t: t["i"]).alias("indices"), _round(F.aggregate("top", F.lit(0.0), lambda s, t: s + t["m"])).alias("quality"))


def candidate_passes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates left by both similarity passes and the quality floor."""
    return pairs.reduce_candidates(_candidates(spark, sf_dir), "vec_id", "a", "b", "indices", "quality", 0.8).select("vec_id", "a", "b", "quality")


def field_heat_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.heat_map(_candidates(spark, sf_dir), "a", "b", "indices")


def persistence_over(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many valleys of a series are at least so persistent, for a few thresholds."""
    from .clustering import persistence_pairs

    found = persistence_pairs(spark, sf_dir).withColumn("threshold", F.explode(F.array(*map(F.lit, (0.05, 0.1, 0.2)))))
    return found.where(F.col("persistence") >= F.col("threshold")).groupBy("vec_id", "threshold").agg(F.count("*").alias("n"))


def balanced_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best cut's quality between neighbouring classes, of draws with as many rows of both."""
    points = schema.components(_series(spark, sf_dir))
    both = points.select("pos", "x", F.explode(F.array(F.struct(F.col("label").alias("l1"), F.lit(0).alias("side")), F.struct((F.col("label") - 1).alias("l1"), F.lit(1).alias("side")))).alias("p")).select("pos", "x", "p.l1", "p.side").where("l1 between 0 and 8")
    return split.pair_quality(both, ["pos", "l1"], "x", "side").withColumn("quality", _round(F.col("quality")))


QUERIES = {
    f.__name__: f
    for f in (
        valid_labels, pair_batch, eligible_sequences, window_time, asof_left_fuzzy, asof_right_fuzzy, root_velocity, cycle_windows, factor_sort, logistic, extrema_union, frame_join, field_features, candidate_passes,
        field_heat_map, persistence_over, balanced_quality,
    )
}

_P = "p AS (SELECT vec_id, label, CAST(unnest(range(64)) AS INT) AS pos, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings)"
#: Valleys and the peaks at which they meet a lower one: on each side the peak on the way to the nearest lower sample, and the lower of both.
PERSISTENCE = f"""{_P}, lm AS (SELECT vec_id, pos, x FROM (SELECT *, lag(x) OVER w AS l, lead(x) OVER w AS r FROM p WINDOW w AS (PARTITION BY vec_id ORDER BY pos)) WHERE (l IS NULL OR l > x) AND (r IS NULL OR r >= x)),
  lo AS (SELECT lm.vec_id, lm.pos, any_value(lm.x) AS x, max(p.pos) FILTER (p.pos < lm.pos AND p.x <= lm.x) AS l, min(p.pos) FILTER (p.pos > lm.pos AND p.x < lm.x) AS r FROM lm JOIN p USING (vec_id) GROUP BY lm.vec_id, lm.pos),
  pk AS (SELECT lo.vec_id, lo.pos, any_value(lo.x) AS x, max((p.x, p.pos)) FILTER (l IS NOT NULL AND p.pos > l AND p.pos < lo.pos) AS a, max((p.x, p.pos)) FILTER (r IS NOT NULL AND p.pos > lo.pos AND p.pos < r) AS b FROM lo JOIN p ON p.vec_id = lo.vec_id WHERE l IS NOT NULL OR r IS NOT NULL GROUP BY lo.vec_id, lo.pos),
  pairs AS (SELECT vec_id, pos AS minimum, least(coalesce(a, b), coalesce(b, a)) AS top, x FROM pk),
  found AS (SELECT vec_id, minimum, CAST(top[2] AS INT) AS maximum, top[1] - x AS persistence FROM pairs)"""
KEY_EVENTS = """kf AS (SELECT vec_id, (list(persistence ORDER BY persistence) FILTER (persistence >= 1e-4))[CAST(floor(count(*) FILTER (persistence >= 1e-4) / 2) AS INT) + 1] AS middle FROM found GROUP BY vec_id),
  ev AS (SELECT DISTINCT vec_id, unnest([minimum, maximum]) AS pos FROM found JOIN kf USING (vec_id) WHERE persistence > middle AND minimum NOT IN (0, 63) AND maximum NOT IN (0, 63))"""
_T = "t AS (SELECT user_id, event_id, event_type, epoch_us(ts) / 1000.0 AS t FROM events)"


def _fuzzy_sql(before: str, after: str) -> str:
    return f"""WITH {_T}, j AS (SELECT a.event_id, b.event_id AS view_id, abs(a.t - b.t) AS gap, b.t AS bt FROM t a LEFT JOIN t b ON a.user_id = b.user_id AND b.event_type = 'view' AND ((b.t <= a.t AND {before}) OR (b.t > a.t AND {after})) WHERE a.event_type = 'purchase'),
      r AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY gap, bt, view_id) AS k FROM j) SELECT event_id, view_id, round(gap, 3) + 0.0 AS gap FROM r WHERE k = 1"""


_CAND = f"""{_P}, t AS (SELECT vec_id, pos, abs(x) AS m, row_number() OVER (PARTITION BY vec_id ORDER BY abs(x) DESC, pos DESC) AS k FROM p),
  c AS (SELECT vec_id, CAST(vec_id % 7 AS INT) AS a, CAST(7 + vec_id % 11 AS INT) AS b, list(pos) AS ix, round(sum(m ORDER BY k), 6) + 0.0 AS quality FROM t WHERE k <= 4 GROUP BY vec_id)"""

ORACLE_SQL = {
    "valid_labels": "SELECT vec_id, label - 3 AS label FROM embeddings WHERE label >= 3",
    "pair_batch": "SELECT vec_id, label FROM embeddings WHERE vec_id BETWEEN 100 AND 199",
    "eligible_sequences": "SELECT user_id AS seq_id, count(*) AS n FROM events GROUP BY user_id HAVING count(DISTINCT event_id) >= 60 AND count(DISTINCT event_type) >= 5",
    "window_time": f"WITH {_T}, s AS (SELECT *, nth_value(t, 3) OVER (PARTITION BY user_id ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS start FROM t) SELECT event_id, round((t - start) / 864000000.0, 6) + 0.0 AS share FROM s WHERE t - start BETWEEN 0 AND 864000000.0",
    "asof_left_fuzzy": _fuzzy_sql("true", "b.t - a.t < 3600000.0"),
    "asof_right_fuzzy": _fuzzy_sql("a.t - b.t < 3600000.0", "true"),
    "root_velocity": """WITH s AS (SELECT label, vec_id, [CAST(embedding[1] AS DOUBLE), CAST(embedding[2] AS DOUBLE), CAST(embedding[3] AS DOUBLE)] AS q FROM embeddings WHERE embedding[4] > CAST(-0.1 AS DOUBLE)), e AS (SELECT label, arg_min(q, vec_id) AS a, arg_max(q, vec_id) AS b, max(vec_id) - min(vec_id) AS d FROM s GROUP BY label),
      v AS (SELECT label, round(sqrt((b[1] - a[1]) * (b[1] - a[1]) + (b[2] - a[2]) * (b[2] - a[2]) + (b[3] - a[3]) * (b[3] - a[3])) / nullif(d, 0), 9) + 0.0 AS velocity FROM e) SELECT l.label, velocity FROM (SELECT DISTINCT label FROM embeddings) l LEFT JOIN v USING (label)""",
    "cycle_windows": "SELECT vec_id, CAST(s AS INT) AS start, round(list_sum(list_transform(range(64), lambda k: CAST(embedding[(s + k + 32) % 64 + 1] AS DOUBLE) * (k + 1))), 6) + 0.0 AS weighed FROM embeddings, range(64) AS r(s)",
    "factor_sort": f"WITH {_P}, t AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY x DESC, pos DESC) AS k FROM p) SELECT vec_id, CAST(row_number() OVER (PARTITION BY vec_id ORDER BY pos) - 1 AS INT) AS nth, pos AS position, round(x, 6) + 0.0 AS factor FROM t WHERE k <= 4",
    "logistic": f"WITH {_P} SELECT vec_id, pos, round(1 / (1 + exp(-x * 10)), 6) + 0.0 AS y FROM p",
    "extrema_union": f"WITH {_P}, e AS (SELECT vec_id, pos FROM (SELECT *, lag(x) OVER w AS l, lead(x) OVER w AS r FROM p WINDOW w AS (PARTITION BY vec_id ORDER BY pos)) WHERE (x > l AND x > r) OR (x < l AND x < r)) SELECT vec_id, string_agg(pos, ',' ORDER BY pos) AS positions, true AS distinct FROM e GROUP BY vec_id",
    "frame_join": "SELECT vec_id, round(CAST(embedding[6] AS DOUBLE) - CAST(embedding[41] AS DOUBLE), 6) + 0.0 AS apart FROM embeddings",
    "field_features": "SELECT vec_id, CAST(pair AS INT) AS pair, CAST(field AS INT) AS field, round(list_sum(list_transform(range(4), lambda i: (CAST(embedding[32 * pair + (field * 5 + i * 3 + pair) % 16 + 1] AS DOUBLE) - CAST(embedding[32 * pair + 16 + (field * 5 + i * 3 + pair) % 16 + 1] AS DOUBLE)) * (i - 1.5) * (pair + 1))), 6) + 0.0 AS feature FROM embeddings, range(2) AS a(pair), range(16) AS b(field)",
    "candidate_passes": f"""WITH {_CAND}, one AS (SELECT * FROM c WHERE NOT EXISTS (SELECT 1 FROM c o WHERE o.a = c.a AND o.b = c.b AND (o.quality > c.quality OR (o.quality = c.quality AND o.vec_id < c.vec_id)) AND len(list_intersect(o.ix, c.ix)) / 4.0 > 0.25)),
      two AS (SELECT * FROM one c WHERE NOT EXISTS (SELECT 1 FROM one o WHERE (o.a IN (c.a, c.b) OR o.b IN (c.a, c.b)) AND (o.quality > c.quality OR (o.quality = c.quality AND o.vec_id < c.vec_id)) AND len(list_intersect(o.ix, c.ix)) / 4.0 > 0.25))
      SELECT vec_id, a, b, quality FROM two WHERE quality >= (SELECT max(quality) FROM two) * 0.8""",
    "field_heat_map": f"WITH {_CAND} SELECT frame, channel, count(*) AS n FROM (SELECT unnest([a, b]) AS frame, ix FROM c), unnest(ix) AS u(channel) GROUP BY frame, channel",
    "persistence_over": f"WITH {PERSISTENCE} SELECT vec_id, threshold, count(*) AS n FROM found, (VALUES (0.05::DOUBLE), (0.1::DOUBLE), (0.2::DOUBLE)) AS v(threshold) WHERE round(persistence, 6) >= threshold GROUP BY vec_id, threshold",
}

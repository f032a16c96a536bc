"""Queries over ``events``: trajectories, joins in time, cycles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema
from ..operators import cycles, trajectory

BY = ["seq_id"]
PHASES = len(schema.CYCLE_EVENTS)


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def _round(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c), 6) + F.lit(0.0) for c in columns})


def gap_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trajectory.detect_gaps(schema.trajectories(_events(spark, sf_dir)), BY, "t", "v")


def gap_fill_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    filled = trajectory.fill_gaps(schema.trajectories(_events(spark, sf_dir)), BY, "t", "v")
    return _round(filled.select("seq_id", "event_id", "t", "filled"), "filled")


def _hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trajectories in hours of 2024, small numbers that both engines round alike."""
    return schema.trajectories(_events(spark, sf_dir)).withColumn("t", F.col("t") / 3_600_000.0 - 473352.0)


def resample_up4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(trajectory.resample(_hours(spark, sf_dir), BY, "t", "v", 30, 120), "t", "v")


def resample_3_to_2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(trajectory.resample(_hours(spark, sf_dir), BY, "t", "v", 3, 2), "t", "v")


def time_normalise_100(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(trajectory.time_normalise(_hours(spark, sf_dir), BY, "t", "v", 100), "t", "v")


def knot_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    seconds = schema.trajectories(_events(spark, sf_dir)).withColumn("t", F.col("t") / 3_600_000.0)
    return _round(trajectory.knot_derivatives(seconds, BY, "t", "v"), "t", "v", "velocity", "acceleration", "jerk")


def lowess_smooth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(trajectory.lowess(_hours(spark, sf_dir), BY, "t", "v", 0.2), "t", "v", "smooth").select("seq_id", "t", "v", "smooth")


def _purchases_views(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    marks = schema.markers(_events(spark, sf_dir))
    return marks.where("mark = 3"), marks.where("mark = 2").withColumnRenamed("event_id", "view_id")


def asof_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    left, right = _purchases_views(spark, sf_dir)
    return cycles.asof_nearest(left, right, BY, "t", "event_id", "view_id")


def asof_tolerance(spark: SparkSession, sf_dir: str) -> DataFrame:
    left, right = _purchases_views(spark, sf_dir)
    return cycles.asof_nearest(left, right, BY, "t", "event_id", "view_id", 3_600_000.0)


def interval_phase(spark: SparkSession, sf_dir: str) -> DataFrame:
    marks = schema.markers(_events(spark, sf_dir))
    return cycles.interval_phase(marks, marks.select("seq_id", "event_id", "t"), BY, PHASES)


def _segmented(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cycles.segment_cycles(schema.markers(_events(spark, sf_dir)).withColumn("v", F.when(F.col("mark") != 5, F.col("v"))), BY, "t", "mark")


def cycle_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _segmented(spark, sf_dir).select("seq_id", "event_id", "t", "mark", "cycle")


def _facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cycles.cycle_facts(_segmented(spark, sf_dir), BY, "t", "v")


def cycle_velocity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(_facts(spark, sf_dir).withColumn("velocity", F.col("velocity") * 3_600_000.0), "velocity")


def cycle_complete(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cycles.complete_cycles(_facts(spark, sf_dir), 400.0).select("seq_id", "cycle", "frames", "duration")


def duration_regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    hours = _facts(spark, sf_dir).withColumn("velocity", F.col("velocity") * 3_600_000.0).withColumn("duration", F.col("duration") / 3_600_000.0)
    return _round(cycles.predict_duration(hours, BY), "ratio", "predicted")


def range_owner(spark: SparkSession, sf_dir: str) -> DataFrame:
    segmented = _segmented(spark, sf_dir)
    ranges = cycles.cycle_facts(segmented, BY, "t", "v").where("cycle > 0")
    return cycles.range_owner(segmented.select("seq_id", "event_id", "t"), ranges, BY, "t", "start_t", "end_t", "cycle", 86_400_000.0)


def mask_unavailable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Differences to the next event; where it is missing, a small value of the sign that the order of their marks has."""
    from pyspark.sql import Window

    order = Window.partitionBy("seq_id").orderBy("t")
    marks = schema.markers(_events(spark, sf_dir)).withColumn("v", F.when(F.col("mark") != 5, F.col("v")))
    near = marks.withColumn("next_v", F.lead("v").over(order)).withColumn("next_mark", F.lead("mark").over(order))
    masked = F.coalesce(F.col("v") - F.col("next_v"), F.when(F.col("mark") < F.col("next_mark"), F.lit(-0.02)).otherwise(F.lit(0.02)))
    return _round(near.select("seq_id", "event_id", masked.alias("feature")), "feature")


QUERIES = {f.__name__: f for f in (gap_detect, gap_fill_linear, resample_up4, resample_3_to_2, time_normalise_100, knot_derivatives, lowess_smooth, asof_nearest, asof_tolerance, interval_phase, cycle_segments, cycle_velocity, cycle_complete, duration_regression, range_owner, mask_unavailable)}

_TRAJ = "traj AS (SELECT user_id AS seq_id, event_id, epoch_us(ts) / 1000.0 AS t, CASE WHEN event_type <> 'error' THEN value END AS v FROM events)"
_MARKS = "marks AS (SELECT user_id AS seq_id, event_id, epoch_us(ts) / 1000.0 AS t, value AS v, CAST(list_position(['click', 'view', 'purchase', 'signup', 'error'], event_type) AS INT) AS mark FROM events)"
_HOURS = _TRAJ.replace("epoch_us(ts) / 1000.0", "epoch_us(ts) / 1000.0 / 3600000.0 - 473352.0")
_NEAR = """last_value(CASE WHEN v IS NOT NULL THEN t END IGNORE NULLS) OVER p AS t0, last_value(v IGNORE NULLS) OVER p AS v0,
  first_value(CASE WHEN v IS NOT NULL THEN t END IGNORE NULLS) OVER n AS t1, first_value(v IGNORE NULLS) OVER n AS v1"""
_WIN = "WINDOW p AS (PARTITION BY seq_id ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), n AS (PARTITION BY seq_id ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"
_FILLED = f"filled AS (SELECT seq_id, event_id, t, coalesce(v, v0 + (v1 - v0) * (t - t0) / nullif(t1 - t0, 0)) AS f FROM (SELECT *, {_NEAR} FROM traj {_WIN}))"
_CYCLES = f"""{_MARKS}, seg AS (SELECT seq_id, event_id, t, mark, CASE WHEN mark <> 5 THEN v END AS v,
  CAST(sum(o) OVER (PARTITION BY seq_id ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS INT) AS cycle
  FROM (SELECT *, CASE WHEN mark = 1 AND coalesce(lag(mark) OVER (PARTITION BY seq_id ORDER BY t), 0) <> 1 THEN 1 ELSE 0 END AS o FROM marks)),
facts AS (SELECT seq_id, cycle, count(*) AS frames, count(v) AS valid, min(t) AS start_t, max(t) AS end_t, max(t) - min(t) AS duration,
  abs(arg_max(v, t) FILTER (v IS NOT NULL) - arg_min(v, t) FILTER (v IS NOT NULL)) / nullif(max(t) FILTER (v IS NOT NULL) - min(t) FILTER (v IS NOT NULL), 0) AS velocity FROM seg GROUP BY seq_id, cycle)"""


def _resample_sql(up: int, down: int) -> str:
    return f"""WITH {_HOURS}, {_FILLED}, s AS (SELECT seq_id, t, f, row_number() OVER w AS n, lead(t) OVER w AS t1, lead(f) OVER w AS f1 FROM filled WINDOW w AS (PARTITION BY seq_id ORDER BY t)),
    g AS (SELECT s.*, i, (n - 1) * {up} + i AS k FROM s, generate_series(0, {up - 1}) AS x(i) WHERE t1 IS NOT NULL OR i = 0)
    SELECT seq_id, CAST(k // {down} AS BIGINT) AS nth, round(CASE WHEN i = 0 THEN t ELSE t + (t1 - t) * (i / {up}.0) END, 6) + 0.0 AS t, round(CASE WHEN i = 0 THEN f ELSE f + (f1 - f) * (i / {up}.0) END, 6) + 0.0 AS v FROM g WHERE k % {down} = 0"""


def _asof_sql(limit: str) -> str:
    return f"""WITH {_MARKS}, pairs AS (SELECT l.seq_id, l.event_id, r.event_id AS view_id, abs(l.t - r.t) AS gap, row_number() OVER (PARTITION BY l.event_id ORDER BY abs(l.t - r.t), r.t, r.event_id) AS k
      FROM (SELECT * FROM marks WHERE mark = 3) l LEFT JOIN (SELECT * FROM marks WHERE mark = 2) r ON l.seq_id = r.seq_id)
    SELECT seq_id, event_id, CASE WHEN {limit} THEN view_id END AS view_id, CASE WHEN {limit} THEN gap END AS gap FROM pairs WHERE k = 1"""


ORACLE_SQL = {
    "gap_detect": f"WITH {_TRAJ}, r AS (SELECT seq_id, t, v, row_number() OVER (PARTITION BY seq_id ORDER BY t) - row_number() OVER (PARTITION BY seq_id, v IS NULL ORDER BY t) AS g FROM traj) SELECT seq_id, min(t) AS start_t, max(t) AS end_t, count(*) AS points FROM r WHERE v IS NULL GROUP BY seq_id, g",
    "gap_fill_linear": f"WITH {_TRAJ}, {_FILLED} SELECT seq_id, event_id, t, round(f, 6) + 0.0 AS filled FROM filled",
    "resample_up4": _resample_sql(4, 1),
    "resample_3_to_2": _resample_sql(2, 3),
    "time_normalise_100": f"""WITH {_HOURS}, span AS (SELECT seq_id, min(t) AS a, max(t) AS b FROM traj GROUP BY seq_id),
      q AS (SELECT seq_id, i AS nth, a + i * (b - a) / 101.0 AS t FROM span, generate_series(1, 100) AS x(i)), k AS (SELECT seq_id, t, v FROM traj WHERE v IS NOT NULL),
      z AS (SELECT q.seq_id, q.nth, q.t, p.t AS t0, p.v AS v0, n.t AS t1, n.v AS v1 FROM q ASOF LEFT JOIN k p ON q.seq_id = p.seq_id AND q.t >= p.t ASOF LEFT JOIN k n ON q.seq_id = n.seq_id AND q.t <= n.t)
      SELECT seq_id, CAST(nth AS BIGINT) AS nth, round(t, 6) + 0.0 AS t, round(CASE WHEN t0 = t1 THEN v0 ELSE v0 + (v1 - v0) * ((t - t0) / (t1 - t0)) END, 6) + 0.0 AS v FROM z""",
    "knot_derivatives": f"""WITH {_TRAJ}, k AS (SELECT seq_id, t / 3600000.0 AS t, v FROM traj WHERE v IS NOT NULL), w1 AS (SELECT *, (v - lag(v) OVER w) / nullif(t - lag(t) OVER w, 0) AS velocity FROM k WINDOW w AS (PARTITION BY seq_id ORDER BY t)),
      w2 AS (SELECT *, (velocity - lag(velocity) OVER w) / nullif(t - lag(t) OVER w, 0) AS acceleration FROM w1 WINDOW w AS (PARTITION BY seq_id ORDER BY t)),
      w3 AS (SELECT *, (acceleration - lag(acceleration) OVER w) / nullif(t - lag(t) OVER w, 0) AS jerk FROM w2 WINDOW w AS (PARTITION BY seq_id ORDER BY t))
      SELECT seq_id, round(t, 6) + 0.0 AS t, round(v, 6) + 0.0 AS v, round(velocity, 6) + 0.0 AS velocity, round(acceleration, 6) + 0.0 AS acceleration, round(jerk, 6) + 0.0 AS jerk FROM w3""",
    "lowess_smooth": f"""WITH {_TRAJ}, k AS (SELECT seq_id, t / 3600000.0 - 473352.0 AS t, v, count(*) OVER (PARTITION BY seq_id) AS n FROM traj WHERE v IS NOT NULL),
      p AS (SELECT a.seq_id, a.t, a.v, b.t - a.t AS x, b.v AS y, abs(b.t - a.t) AS d, greatest(2, least(a.n, CAST(floor(a.n * 0.2 + 1e-10) AS BIGINT))) AS m, row_number() OVER (PARTITION BY a.seq_id, a.t ORDER BY abs(b.t - a.t), b.t) AS q FROM k a JOIN k b ON a.seq_id = b.seq_id),
      h AS (SELECT *, max(d) OVER (PARTITION BY seq_id, t) AS h FROM p WHERE q <= m),
      w AS (SELECT *, coalesce(CASE WHEN d / nullif(h, 0) <= 0.001 THEN 1.0 WHEN d / nullif(h, 0) >= 0.999 THEN 0.0 ELSE pow(1 - pow(d / nullif(h, 0), 3), 3) END, 1.0) AS w FROM h),
      s AS (SELECT seq_id, t, v, sum(w) AS w, sum(w * x) AS wx, sum(w * x * x) AS wxx, sum(w * y) AS wy, sum(w * x * y) AS wxy FROM w GROUP BY seq_id, t, v)
      SELECT seq_id, round(t, 6) + 0.0 AS t, round(v, 6) + 0.0 AS v, round(coalesce((wxx * wy - wx * wxy) / CASE WHEN w * wxx - wx * wx > 1e-9 * w * wxx THEN w * wxx - wx * wx END, wy / w), 6) + 0.0 AS smooth FROM s""",
    "asof_nearest": _asof_sql("true"),
    "asof_tolerance": _asof_sql("gap <= 3600000.0"),
    "interval_phase": f"""WITH {_MARKS}, i AS (SELECT seq_id, t AS a, lead(t) OVER w AS b, CASE WHEN lead(mark) OVER w = mark % 5 + 1 THEN mark END AS phase FROM marks WINDOW w AS (PARTITION BY seq_id ORDER BY t, mark))
      SELECT m.seq_id, m.event_id, m.t, i.phase FROM marks m JOIN i ON m.seq_id = i.seq_id AND m.t >= i.a AND (m.t < i.b OR i.b IS NULL)""",
    "cycle_segments": f"WITH {_CYCLES} SELECT seq_id, event_id, t, mark, cycle FROM seg",
    "cycle_velocity": f"WITH {_CYCLES} SELECT seq_id, cycle, frames, valid, start_t, end_t, duration, round(velocity * 3600000.0, 6) + 0.0 AS velocity FROM facts",
    "cycle_complete": f"WITH {_CYCLES} SELECT seq_id, cycle, frames, duration FROM facts WHERE cycle > 0 AND frames = valid AND duration > 400.0",
    "duration_regression": f"WITH {_CYCLES} SELECT seq_id, count(*) AS cycles, round(avg(duration / 3600000.0 / (velocity * 3600000.0)), 6) + 0.0 AS ratio, round(avg(duration / 3600000.0 / (velocity * 3600000.0)) * avg(velocity * 3600000.0), 6) + 0.0 AS predicted FROM facts WHERE velocity > 0 AND cycle > 0 GROUP BY seq_id",
    "range_owner": f"WITH {_CYCLES} SELECT s.seq_id, s.event_id, s.t, min(f.cycle) AS cycle FROM seg s JOIN facts f ON s.seq_id = f.seq_id AND f.cycle > 0 AND s.t BETWEEN f.start_t AND f.end_t GROUP BY s.seq_id, s.event_id, s.t",
    "mask_unavailable": f"WITH {_MARKS}, n AS (SELECT seq_id, event_id, CASE WHEN mark <> 5 THEN v END AS v, mark, lead(CASE WHEN mark <> 5 THEN v END) OVER w AS nv, lead(mark) OVER w AS nm FROM marks WINDOW w AS (PARTITION BY seq_id ORDER BY t)) SELECT seq_id, event_id, round(coalesce(v - nv, CASE WHEN mark < nm THEN -0.02 ELSE 0.02 END), 6) + 0.0 AS feature FROM n",
}

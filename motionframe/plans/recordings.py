"""Queries over ``events`` read as recordings of one channel: warped phase windows and their samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema
from ..operators import phases, standardise
from ..session import checkpoint_dir

BY = ["seq_id"]
#: In hours: how far from an instant its frame may be, and how much time a task sorts at once.
TOLERANCE, WIDTH, LEAST = 9.0, 96.0, 400.0 / 3_600_000.0
#: (channel, u, v): shares of a cycle from the frame.
PAIRS = [(0, -0.5, 0.0), (0, -0.25, 0.25), (0, 0.0, 0.5), (0, 0.5, -0.5), (0, 0.125, -0.375)]


def _frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``seq_id, event_id, t, v, mark``: hours of 2024, values missing at errors."""
    marks = schema.markers(spark.read.parquet(f"{sf_dir}/events.parquet"))
    return marks.withColumn("t", F.col("t") / 3_600_000.0 - 473352.0).withColumn("v", F.when(F.col("mark") != 5, F.col("v")))


def _round(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c), 6) + F.lit(0.0) for c in columns})


def _owned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The frames by cycle, written once, as all later steps read them."""
    checkpoint_dir(spark)
    return phases.own_cycles(_frames(spark, sf_dir), BY, "t", "mark").checkpoint()


def _windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    owned = _owned(spark, sf_dir)
    return phases.phase_windows(owned, phases.cycle_durations(owned, BY, "t", ["v"], LEAST).checkpoint(), BY, "t", TOLERANCE, WIDTH)


def cycle_durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All cycles, the open ones at the ends with predicted durations."""
    found = phases.cycle_durations(phases.own_cycles(_frames(spark, sf_dir), BY, "t", "mark"), BY, "t", ["v"], LEAST)
    return _round(found, "start_t", "end_t", "duration").select("seq_id", "cycle", "start_t", "end_t", "whole", "duration")


def phase_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half a warped cycle back and ahead of every event."""
    return _round(_windows(spark, sf_dir), "window_start", "window_end").select("seq_id", "event_id", "cycle", "whole", "window_start", "window_end")


def phase_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled rows of the frames of all cycles, open ends included."""
    frames = _frames(spark, sf_dir).select("seq_id", "t", F.array("v").alias("values"))
    rows = phases.phase_samples(_windows(spark, sf_dir).checkpoint(), frames, BY, ["event_id"], "t", "values", PAIRS, TOLERANCE, WIDTH)
    return rows.select("seq_id", "event_id", "cycle", "whole", F.col("mark").alias("label"), *[(F.round(F.col("features")[i], 6) + F.lit(0.0)).alias(f"f{i}") for i in range(len(PAIRS))])


#: Even times of a cycle, and hours of a trajectory that a smoothed point is fitted to.
LENGTH, REACH = 16, 60.0


def standard_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every cycle at even times: whole ones and the open last one from their start on, the open first one back from its end."""
    owned = _owned(spark, sf_dir)
    cycles = standardise.anchors(phases.cycle_durations(owned, BY, "t", ["v"], LEAST)).checkpoint()
    frames = phases.members(owned, BY, "t").withColumn("values", F.array("v"))
    rows = standardise.standardise(frames, cycles, BY, "t", "values", "mark", LENGTH, TOLERANCE, len(schema.CYCLE_EVENTS), REACH)
    return _round(rows.withColumn("value", F.get("values", F.lit(0))), "share", "value").select("seq_id", "cycle", "nth", "share", "value", "label")


QUERIES = {f.__name__: f for f in (cycle_durations, phase_windows, phase_samples, standard_cycles)}

_DURATIONS = f"""frames AS (SELECT user_id AS seq_id, event_id, epoch_us(ts) / 1000.0 / 3600000.0 - 473352.0 AS t, CASE WHEN event_type <> 'error' THEN value END AS v,
    CAST(list_position(['click', 'view', 'purchase', 'signup', 'error'], event_type) AS INT) AS mark FROM events),
  opened AS (SELECT *, CASE WHEN mark = 1 AND coalesce(lag(mark) OVER w, 0) <> 1 THEN 1 ELSE 0 END AS o FROM frames WINDOW w AS (PARTITION BY seq_id ORDER BY t)),
  counted AS (SELECT *, coalesce(sum(o) OVER (PARTITION BY seq_id ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) - first_value(o) OVER (PARTITION BY seq_id ORDER BY t) AS c,
    sum(o) OVER (PARTITION BY seq_id) AS n, min(t) OVER (PARTITION BY seq_id) AS first_t, max(t) OVER (PARTITION BY seq_id) AS last_t FROM opened),
  own AS (SELECT *, CAST(greatest(c, 0) AS INT) AS cycle FROM counted WHERE n > 1),
  member AS (SELECT seq_id, cycle, t, v, o FROM own UNION ALL SELECT seq_id, cycle + 1, t, v, o FROM own WHERE o = 1 AND t > first_t AND t < last_t),
  spans AS (SELECT seq_id, cycle, min(t) AS start_t, max(t) AS end_t, arg_min(o, t) = 1 AND arg_max(o, t) = 1 AS whole,
    abs(arg_max(v, t) FILTER (v IS NOT NULL) - arg_min(v, t) FILTER (v IS NOT NULL)) / nullif(max(t) FILTER (v IS NOT NULL) - min(t) FILTER (v IS NOT NULL), 0) AS velocity FROM member GROUP BY seq_id, cycle),
  means AS (SELECT seq_id, avg((end_t - start_t) / velocity) FILTER (velocity > 0) AS ratio, avg(end_t - start_t) AS mean FROM spans WHERE whole AND end_t - start_t > {LEAST!r} AND velocity IS NOT NULL GROUP BY seq_id),
  lengths AS (SELECT spans.*, CASE WHEN whole THEN end_t - start_t ELSE coalesce(velocity * ratio, mean) END AS duration FROM spans LEFT JOIN means USING (seq_id)),
  cyc AS (SELECT *, lag(duration) OVER w AS before, lead(duration) OVER w AS following FROM lengths WINDOW w AS (PARTITION BY seq_id ORDER BY cycle))"""


def _warp(t: str) -> str:
    return f"CASE WHEN {t} < start_t AND before IS NOT NULL THEN start_t - (start_t - ({t})) / duration * before WHEN {t} > end_t AND following IS NOT NULL THEN end_t + (({t}) - end_t) / duration * following ELSE {t} END"


_WINDOWS = f"""{_DURATIONS},
  halves AS (SELECT own.*, start_t, end_t, whole, duration, before, following, {_warp("t - duration * 0.5")} AS l, {_warp("t + duration * 0.5")} AS r FROM own JOIN cyc USING (seq_id, cycle)),
  wins AS (SELECT h.*,
    CASE WHEN first_t <= l THEN (SELECT arg_min(f.t, (abs(f.t - l), f.t)) FROM frames f WHERE f.seq_id = h.seq_id AND f.t - l < {TOLERANCE!r}) ELSE first_t END AS a,
    CASE WHEN last_t >= r THEN (SELECT arg_min(f.t, (abs(f.t - r), f.t)) FROM frames f WHERE f.seq_id = h.seq_id AND r - f.t < {TOLERANCE!r}) ELSE last_t END AS b
    FROM halves h WHERE first_t <= l OR last_t >= r)"""


def _feature(i: int, u: float, v: float) -> str:
    at = lambda s: f"""(SELECT arg_min(struct_pack(v := f.v, near := abs(f.t - x) <= {TOLERANCE!r}), (abs(f.t - x), f.t)) FROM (SELECT {_warp(f"w.t + {s!r} * duration")} AS x) q, frames f WHERE f.seq_id = w.seq_id AND f.t BETWEEN w.a AND w.b)"""
    return f"{at(u)} AS u{i}, {at(v)} AS v{i}"


_VALUES = ", ".join(_feature(i, u, v) for i, (_, u, v) in enumerate(PAIRS))
_REAL = [f"CASE WHEN u{i}.near AND v{i}.near THEN u{i}.v - v{i}.v END AS d{i}" for i in range(len(PAIRS))]
_NEAREST = lambda frames: f"""(SELECT arg_min(struct_pack(gap := abs(f.t - a.t), t := f.t, v := f.v, label := f.label), (abs(f.t - a.t), f.t)) FROM {frames} f WHERE f.seq_id = a.seq_id AND f.cycle = a.cycle)"""
_STANDARD = f"""{_DURATIONS},
  anchored AS (SELECT *, CASE WHEN cycle = 0 AND NOT whole THEN end_t - duration ELSE start_t END AS anchor FROM cyc WHERE duration > 0),
  own_frames AS (SELECT m.seq_id, m.cycle, m.t, m.v, e.mark AS label FROM member m JOIN anchored USING (seq_id, cycle) JOIN frames e ON e.seq_id = m.seq_id AND e.t = m.t),
  asked AS (SELECT * FROM (SELECT seq_id, cycle, anchor, duration, i AS nth, round(anchor + i * (duration / {LENGTH}.0), 6) AS t FROM anchored, generate_series(0, {LENGTH - 1}) AS g(i)) WHERE t >= 0),
  near AS (SELECT a.*, {_NEAREST("own_frames")} AS m, t - lag(t) OVER (PARTITION BY seq_id, cycle ORDER BY nth) AS since FROM asked a),
  tied AS (SELECT *, coalesce(bool_or(m.gap < {TOLERANCE!r}) OVER (PARTITION BY seq_id, cycle ORDER BY nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS led, coalesce(since < {TOLERANCE!r}, true) AS carries FROM near),
  copied AS (SELECT *, CASE WHEN m.gap < {TOLERANCE!r} AND (NOT led OR NOT carries OR m.gap <= since) THEN struct_pack(v := m.v, label := m.label) END AS own FROM tied),
  copies AS (SELECT seq_id, cycle, t, CASE WHEN carries THEN last_value(own IGNORE NULLS) OVER (PARTITION BY seq_id, cycle ORDER BY nth ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) ELSE own END AS c FROM copied),
  every AS (SELECT seq_id, cycle, t, v, label FROM own_frames UNION ALL SELECT seq_id, cycle, t, c.v, c.label FROM copies WHERE c IS NOT NULL),
  knots AS (SELECT *, last_value(CASE WHEN v IS NOT NULL THEN t END IGNORE NULLS) OVER p AS t0, last_value(v IGNORE NULLS) OVER p AS v0, first_value(CASE WHEN v IS NOT NULL THEN t END IGNORE NULLS) OVER n AS t1, first_value(v IGNORE NULLS) OVER n AS v1 FROM every
    WINDOW p AS (PARTITION BY seq_id, cycle ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), n AS (PARTITION BY seq_id, cycle ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
  filled AS (SELECT seq_id, cycle, t, coalesce(v, v0 + (v1 - v0) * ((t - t0) / nullif(t1 - t0, 0)), CASE WHEN t0 = t1 THEN v0 END) AS v FROM knots),
  points AS (SELECT *, count(*) OVER w AS n, coalesce({REACH!r} / nullif(max(t) OVER w - min(t) OVER w, 0), 1.0) AS span, row_number() OVER (PARTITION BY seq_id, cycle ORDER BY t) AS r FROM filled WHERE v IS NOT NULL WINDOW w AS (PARTITION BY seq_id, cycle)),
  pairs AS (SELECT a.seq_id, a.cycle, a.t, a.r, b.t - a.t AS x, b.v AS y, abs(b.t - a.t) AS d, greatest(2, least(a.n, CAST(floor(a.n * a.span + 1e-10) AS BIGINT))) AS k, row_number() OVER (PARTITION BY a.seq_id, a.cycle, a.r ORDER BY abs(b.t - a.t), b.t) AS q
    FROM points a JOIN points b ON a.seq_id = b.seq_id AND a.cycle = b.cycle),
  reached AS (SELECT *, max(d) OVER (PARTITION BY seq_id, cycle, r) AS h FROM pairs WHERE q <= k),
  weighed AS (SELECT *, coalesce(CASE WHEN d / nullif(h, 0) <= 0.001 THEN 1.0 WHEN d / nullif(h, 0) >= 0.999 THEN 0.0 ELSE pow(1 - pow(d / nullif(h, 0), 3), 3) END, 1.0) AS w FROM reached),
  sums AS (SELECT seq_id, cycle, r, t, sum(w) AS w, sum(w * x) AS wx, sum(w * x * x) AS wxx, sum(w * y) AS wy, sum(w * x * y) AS wxy FROM weighed GROUP BY seq_id, cycle, r, t),
  smooth AS (SELECT seq_id, cycle, t, min(coalesce((wxx * wy - wx * wxy) / CASE WHEN w * wxx - wx * wx > 1e-9 * w * wxx THEN w * wxx - wx * wx END, wy / w)) AS v FROM sums GROUP BY seq_id, cycle, t),
  settled AS (SELECT e.seq_id, e.cycle, e.t, s.v, min(label) AS label FROM every e LEFT JOIN smooth s USING (seq_id, cycle, t) GROUP BY e.seq_id, e.cycle, e.t, s.v),
  last_pick AS (SELECT seq_id, cycle, nth, t, anchor, duration, CASE WHEN m.gap < {2 * TOLERANCE!r} THEN m END AS m FROM (SELECT a.*, {_NEAREST("settled")} AS m FROM asked a)),
  shares AS (SELECT *, coalesce(greatest((m.t - anchor) / duration, 0.0), (t - anchor) / duration) AS share FROM last_pick)"""

ORACLE_SQL = {
    "standard_cycles": f"""WITH {_STANDARD} SELECT seq_id, cycle, CAST(nth AS INT) AS nth, round(share, 6) + 0.0 AS share, round(m.v, 6) + 0.0 AS value,
      CASE WHEN nth = min(nth) OVER w AND nth < max(nth) OVER w THEN 1 WHEN nth = max(nth) OVER w AND nth > min(nth) OVER w THEN {len(schema.CYCLE_EVENTS)} ELSE m.label END AS label FROM shares WHERE share <= 1.0 WINDOW w AS (PARTITION BY seq_id, cycle)""",
    "cycle_durations": f"WITH {_DURATIONS} SELECT seq_id, cycle, round(start_t, 6) + 0.0 AS start_t, round(end_t, 6) + 0.0 AS end_t, whole, round(duration, 6) + 0.0 AS duration FROM cyc",
    "phase_windows": f"WITH {_WINDOWS} SELECT seq_id, event_id, cycle, whole, round(a, 6) + 0.0 AS window_start, round(b, 6) + 0.0 AS window_end FROM wins",
    "phase_samples": f"""WITH {_WINDOWS}, seen AS (SELECT seq_id, event_id, cycle, whole, mark, {_VALUES} FROM wins w), real AS (SELECT *, {", ".join(_REAL)} FROM seen)
      SELECT seq_id, event_id, cycle, whole, mark AS label, {", ".join(f"round(coalesce(d{i}, {-phases.MASK if u < v else phases.MASK!r}), 6) + 0.0 AS f{i}" for i, (_, u, v) in enumerate(PAIRS))}
      FROM real WHERE coalesce({", ".join(f"d{i}" for i in range(len(PAIRS)))}) IS NOT NULL""",
}

"""Queries over ``embeddings`` read as skeleton frames (21 points each)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..operators import skeleton

FLOOR = (0.1, 0.9, 0.2, 0.5)
BONES = [(0, 1), (1, 2), (2, 3), (4, 5)]


def _frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet")


def _floor() -> g.Plane:
    return tuple(F.lit(x) for x in FLOOR)


def _round(c):
    return F.round(c, 6) + F.lit(0.0)


def kinematics_12(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = skeleton.channel_rows(_frames(spark, sf_dir), ["vec_id"], skeleton.kinematics_12(F.col("embedding"), _floor()))
    return rows.withColumn("value", _round(F.col("value")))


def joint_angles(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = [skeleton.joint(F.col("embedding"), i) for i in range(3)]
    named = {
        "plain": g.joint_angle(*p), "supplementary": g.joint_angle(*p, supplementary=True), "relative": g.joint_angle(*p, relative=True), "both": g.joint_angle(*p, supplementary=True, relative=True),
        "flat": g.angle2d(*[q[:2] for q in p]), "chord": g.angle_between(g.sub(p[0], p[1]), g.sub(p[2], p[1])),
    }
    return _frames(spark, sf_dir).select("vec_id", *[_round(c).alias(n) for n, c in named.items()])


def floor_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, q = skeleton.joint(F.col("embedding"), 0), skeleton.joint(F.col("embedding"), 1)
    foot, hit = g.project(_floor(), p), g.intersect(_floor(), p, q)
    return _frames(spark, sf_dir).select(
        "vec_id", _round(g.plane_distance(_floor(), p)).alias("distance"), _round(g.plane_distance(_floor(), p, signed=True)).alias("height"), _round(g.plane_angle(_floor(), g.sub(q, p))).alias("slope"),
        *[_round(c).alias(f"foot_{n}") for c, n in zip(foot, "xyz")], *[F.round(c, 3).alias(f"hit_{n}") for c, n in zip(hit, "xyz")],
    )


def so3_log_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = skeleton.bone_rotations(_frames(spark, sf_dir), ["vec_id"], "embedding", BONES)
    return rows.select("vec_id", "a", "b", *[_round(F.col(c)).alias(c) for c in "xyz"])


def so3_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Axis-angle to matrix and back; the angle and the turned first bone, which must be the second one's direction."""
    named = lambda v: F.struct(*[c.alias(n) for c, n in zip(v, "xyz")])  # noqa: E731  computed once, not inlined
    of = lambda name: tuple(F.col(f"{name}.{c}") for c in "xyz")
    p = [skeleton.joint(F.col("embedding"), i) for i in range(4)]
    ways = _frames(spark, sf_dir).select("vec_id", named(g.sub(p[1], p[0])).alias("a"), named(g.sub(p[3], p[2])).alias("b"))
    units = ways.select("vec_id", named(g.unit(of("a"))).alias("u"), named(g.unit(of("b"))).alias("v"))
    axis, angle = g.rotation_between(of("u"), of("v"))
    turns = units.select("vec_id", "u", named(axis).alias("axis"), angle.alias("angle"))
    matrices = turns.select("vec_id", "u", "angle", F.array(*g.rotation_matrix(of("axis"), F.col("angle"))).alias("m"))
    m = tuple(F.get("m", F.lit(i)) for i in range(9))
    _, back = g.matrix_rotation(m)
    turned = tuple(g.dot(m[3 * i : 3 * i + 3], of("u")) for i in range(3))
    return matrices.select("vec_id", _round(F.col("angle")).alias("angle"), _round(back).alias("back"), *[_round(c).alias(f"turned_{n}") for c, n in zip(turned, "xyz")])


def root_centre_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = _frames(spark, sf_dir).select(F.col("label").alias("seq"), F.col("vec_id").alias("frame"), F.explode(F.sequence(F.lit(0), F.lit(20))).alias("joint_id"), "embedding")
    at = lambda k: F.get("embedding", (F.col("joint_id") * 3 + k).cast("int")).cast("double")
    scaled = skeleton.centre_and_scale(points.select("seq", "frame", "joint_id", at(0).alias("x"), at(1).alias("y"), at(2).alias("z")), "seq", "frame", 0, 20)
    return scaled.select("seq", "frame", "joint_id", *[_round(F.col(c)).alias(c) for c in "xyz"])


QUERIES = {f.__name__: f for f in (kinematics_12, joint_angles, floor_distance, so3_log_features, so3_round_trip, root_centre_scale)}

_J = "j AS (SELECT vec_id, label, " + ", ".join(f"CAST(embedding[{3 * i + k + 1}] AS DOUBLE) AS {c}{i}" for i in range(21) for k, c in enumerate("xyz")) + " FROM embeddings)"
_N = f"sqrt({FLOOR[0] ** 2} + {FLOOR[1] ** 2} + {FLOOR[2] ** 2})"


def _far(i: int) -> str:
    return f"(({FLOOR[0]} * x{i} + {FLOOR[1]} * y{i} + {FLOOR[2]} * z{i} + {FLOOR[3]}) / {_N})"


def _d(a: int, b: int) -> tuple[str, ...]:
    return tuple(f"({c}{a} - {c}{b})" for c in "xyz")


def _dot(u, v) -> str:
    return "(" + " + ".join(f"{a} * {b}" for a, b in zip(u, v)) + ")"


def _ang(u, v) -> str:
    return f"degrees(acos(greatest(-1.0, least(1.0, {_dot(u, v)} / nullif(sqrt({_dot(u, u)}) * sqrt({_dot(v, v)}), 0)))))"


_UP = tuple(str(x) for x in FLOOR[:3])
_H = f"nullif(abs{_far(0)}, 0)"
_KIN = [
    f"sqrt({_dot(_d(3, 5), _d(3, 5))}) / {_H}", f"(180 - {_ang(_d(0, 1), _d(2, 1))}) / 180", f"{_ang(_UP, _d(1, 0))} / 180", *[f"least(0.0, {_far(i)}) / {_H}" for i in (3, 4, 5, 6)],
    f"{_ang(_d(3, 0), _d(5, 0))} / 180", f"{_ang(_d(1, 2), _d(3, 2))} / 180", f"(90 - {_ang(_UP, _d(1, 2))}) / 180", f"(90 - {_ang(_UP, _d(3, 4))}) / 180", f"(90 - {_ang(_UP, _d(5, 6))}) / 180",
]
_FLAT = "degrees(atan2((x0 - x1) * (y2 - y1) - (y0 - y1) * (x2 - x1), (x0 - x1) * (x2 - x1) + (y0 - y1) * (y2 - y1)))"
_A = _ang(_d(0, 1), _d(2, 1))
_S = f"(-({FLOOR[0]} * x0 + {FLOOR[1]} * y0 + {FLOOR[2]} * z0 + {FLOOR[3]}) / nullif({_dot(_UP, _d(1, 0))}, 0))"
_UNIT = lambda v: tuple(f"({c} / nullif(sqrt({_dot(v, v)}), 0))" for c in v)
_B = "w AS (" + " UNION ALL ".join(f"SELECT vec_id, {i} AS i, x{q} - x{p} AS x, y{q} - y{p} AS y, z{q} - z{p} AS z FROM j" for i, (p, q) in enumerate(BONES)) + ")"
_R6 = lambda e, n: f"round({e}, 6) + 0.0 AS {n}"

ORACLE_SQL = {
    "kinematics_12": f"WITH {_J}, k AS (SELECT vec_id, unnest([{', '.join(_KIN)}]) AS value, unnest(range(1, 13)) AS channel, list_contains(list_transform([{', '.join(_KIN)}], lambda x: x IS NULL), true) AS bad FROM j) SELECT vec_id, CAST(channel AS INT) AS channel, round(value, 6) + 0.0 AS value FROM k WHERE NOT bad",
    "joint_angles": f"WITH {_J} SELECT vec_id, {_R6(_A, 'plain')}, {_R6(f'abs(180 - {_A})', 'supplementary')}, {_R6(f'-({_A})', 'relative')}, {_R6(f'180 - {_A}', '\"both\"')}, {_R6(f'CASE WHEN {_FLAT} < 0 THEN {_FLAT} + 360 ELSE {_FLAT} END', 'flat')}, {_R6(_A, 'chord')} FROM j",
    "floor_distance": f"WITH {_J} SELECT vec_id, {_R6(f'abs{_far(0)}', 'distance')}, {_R6(_far(0), 'height')}, {_R6(f'90 - {_ang(_UP, _d(1, 0))}', 'slope')}, "
    + ", ".join(_R6(f"{c}0 - {f} * {_far(0)} / {_N}", f"foot_{c}") for c, f in zip("xyz", FLOOR)) + ", " + ", ".join(f"round({c}0 + {_S} * ({c}1 - {c}0), 3) AS hit_{c}" for c in "xyz") + " FROM j",
    "so3_log_features": f"""WITH {_J}, {_B}, c AS (SELECT u.vec_id, u.i AS a, v.i AS b, u.y * v.z - u.z * v.y AS cx, u.z * v.x - u.x * v.z AS cy, u.x * v.y - u.y * v.x AS cz,
      acos(greatest(-1.0, least(1.0, (u.x * v.x + u.y * v.y + u.z * v.z) / (sqrt(u.x * u.x + u.y * u.y + u.z * u.z) * sqrt(v.x * v.x + v.y * v.y + v.z * v.z))))) AS ang FROM w u JOIN w v ON u.vec_id = v.vec_id AND u.i <> v.i)
      SELECT vec_id, a, b, {', '.join(_R6(f'coalesce(c{n} / nullif(sqrt(cx * cx + cy * cy + cz * cz), 0) * ang, 0)', n) for n in 'xyz')} FROM c""",
    "so3_round_trip": f"WITH {_J} SELECT vec_id, {_R6(f'radians({_ang(_d(1, 0), _d(3, 2))})', 'angle')}, {_R6(f'radians({_ang(_d(1, 0), _d(3, 2))})', 'back')}, {', '.join(_R6(c, f'turned_{n}') for c, n in zip(_UNIT(_d(3, 2)), 'xyz'))} FROM j",
    "root_centre_scale": f"WITH {_J}, m AS (SELECT label, avg(sqrt({_dot(_d(20, 0), _d(20, 0))})) AS bone FROM j GROUP BY label), p AS ("
    + " UNION ALL ".join(f"SELECT j.label AS seq, vec_id AS frame, {i} AS joint_id, (x{i} - x0) / bone AS x, (y{i} - y0) / bone AS y, (z{i} - z0) / bone AS z FROM j JOIN m ON j.label = m.label" for i in range(21)) + f") SELECT seq, frame, joint_id, {', '.join(_R6(c, c) for c in 'xyz')} FROM p",
}

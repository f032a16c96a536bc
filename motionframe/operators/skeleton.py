"""Skeleton frames: kinematic channels, centring and scaling, relative bone rotations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as g

#: Joints by role within a frame's joint array.
ROLES = {"hip": 0, "knee": 1, "ankle": 2, "toe": 3, "heel": 4, "other_toe": 5, "other_heel": 6}


def joint(joints: Column, i: int) -> g.Vector:
    """The i-th point of a flat array x0, y0, z0, x1, .."""
    return tuple(F.get(joints, F.lit(3 * i + k)).cast("double") for k in range(3))


def kinematics_12(joints: Column, floor: g.Plane, roles: dict[str, int] = ROLES) -> list[Column]:
    """Twelve gait channels of one frame, lengths over the hip's height and angles over 180 degrees.

    1 distance of the feet; 2 knee flexion; 3 thigh against the vertical; 4-7 toe, heel, other toe and other heel below the
    floor (0 above); 8 hip between the feet; 9 ankle; 10 shank against the floor; 11 and 12 the feet against the floor.
    """
    p = {name: joint(joints, i) for name, i in roles.items()}
    height = F.nullif(g.plane_distance(floor, p["hip"]), F.lit(0.0))
    below = lambda name: F.least(F.lit(0.0), g.plane_distance(floor, p[name], signed=True)) / height
    up = floor[:3]
    return [
        g.norm(g.sub(p["toe"], p["other_toe"])) / height,
        g.joint_angle(p["hip"], p["knee"], p["ankle"], supplementary=True, relative=True) / 180,
        g.angle3d(up, g.sub(p["knee"], p["hip"])) / 180,
        below("toe"), below("heel"), below("other_toe"), below("other_heel"),
        g.joint_angle(p["toe"], p["hip"], p["other_toe"]) / 180,
        g.joint_angle(p["knee"], p["ankle"], p["toe"]) / 180,
        g.plane_angle(floor, g.sub(p["knee"], p["ankle"])) / 180,
        g.plane_angle(floor, g.sub(p["toe"], p["heel"])) / 180,
        g.plane_angle(floor, g.sub(p["other_toe"], p["other_heel"])) / 180,
    ]


def channel_rows(frames: DataFrame, keys: list[str], channels: list[Column]) -> DataFrame:
    """``keys, channel, value``: one row per frame and channel; frames that miss one of them are dropped whole."""
    wide = frames.select(*keys, F.array(*channels).alias("c")).where(~F.exists("c", lambda x: x.isNull() | F.isnan(x)))
    return wide.select(*keys, F.posexplode("c").alias("channel", "value")).withColumn("channel", F.col("channel") + 1)


def centre_and_scale(points: DataFrame, sequence: str, frame: str, root: int, far: int) -> DataFrame:
    """``points`` (``sequence, frame, joint_id, x, y, z``) less the frame's root joint, over the sequence's mean distance of ``root`` and ``far``.

    The root stays where it is (at the origin). Two windows over one partitioning, no self-join.
    """
    frames = Window.partitionBy(sequence, frame)
    at = lambda j, c: F.max(F.when(F.col("joint_id") == j, F.col(c))).over(frames)
    centred = points.withColumns({f"r{c}": at(root, c) for c in "xyz"} | {f"f{c}": at(far, c) for c in "xyz"})
    length = g.norm(tuple(F.col(f"f{c}") - F.col(f"r{c}") for c in "xyz"))
    mean = F.avg(F.when(F.col("joint_id") == root, length)).over(Window.partitionBy(sequence))
    return centred.withColumn("bone", mean).select(sequence, frame, "joint_id", *[((F.col(c) - F.col(f"r{c}")) / F.nullif(F.col("bone"), F.lit(0.0))).alias(c) for c in "xyz"])


def bone_rotations(frames: DataFrame, keys: list[str], joints: str, bones: list[tuple[int, int]]) -> DataFrame:
    """``keys, a, b, x, y, z``: for every ordered pair of bones the rotation from bone a's direction to bone b's as axis times angle.

    Directions are made unit vectors per bone before bones are paired; of a pair only a dot and a cross product are worked out, in steps that
    generated code evaluates once. Zero for parallel bones, null where one has no length.
    """
    size = lambda v: F.nullif(g.norm(v), F.lit(0.0))
    ways = F.array(*[F.struct(F.lit(i).alias("i"), *[(t - s).alias(n) for s, t, n in zip(joint(F.col(joints), p), joint(F.col(joints), q), "xyz")]) for i, (p, q) in enumerate(bones)])
    one = frames.select(*keys, F.explode(ways).alias("w")).select(*keys, "w.i", "w.x", "w.y", "w.z").withColumn("n", size((F.col("x"), F.col("y"), F.col("z"))))
    units = F.struct("i", *[(F.col(c) / F.col("n")).alias(c) for c in "xyz"])
    held = one.groupBy(*keys).agg(F.array_sort(F.collect_list(units)).alias("w"))
    both = held.select(*keys, "w", F.explode("w").alias("u")).select(*keys, "u", F.explode("w").alias("v")).where("u.i <> v.i")
    u, v = (tuple(F.col(f"{n}.{c}") for c in "xyz") for n in "uv")
    turned = both.select(*keys, F.col("u.i").alias("a"), F.col("v.i").alias("b"), g.dot(u, v).alias("_cos"), *[c.alias(f"_{n}") for c, n in zip(g.cross(u, v), "xyz")])
    axis = tuple(F.col(f"_{c}") for c in "xyz")
    sized = turned.withColumn("_sin", g.norm(axis)).withColumn("_angle", F.acos(g._clip(F.col("_cos"))))
    part = lambda c: F.when(F.col("_cos").isNotNull(), F.coalesce(F.col(f"_{c}") / F.nullif(F.col("_sin"), F.lit(0.0)) * F.col("_angle"), F.lit(0.0))).alias(c)
    return sized.select(*keys, "a", "b", *[part(c) for c in "xyz"])


def eligible(frames: DataFrame, sequence: str, joints: int, least_frames: int = 1) -> DataFrame:
    """Frames of the sequences that have ``least_frames`` frames or more and all ``joints`` joints; sequences without an id go."""
    facts = frames.where(F.col(sequence).isNotNull()).groupBy(sequence).agg(F.count_distinct("frame").alias("_frames"), F.count_distinct("joint_id").alias("_joints"))
    return frames.join(facts.where((F.col("_frames") >= least_frames) & (F.col("_joints") >= joints)).select(sequence), sequence, "left_semi")

"""From action recordings to key event pairs and samples of frame pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import cluster, gait, pairs, skeleton, trajectory


def normalise(frames: DataFrame, frames_wanted: int, bones: list[tuple[int, int]], joints: int, root: int = 0, far: int = 1, rate: float = 30.0) -> DataFrame:
    """``seq_id, action, frame, channel, value``: rotations between all ordered pairs of bones at ``frames_wanted`` even times of every recording.

    Joints' gaps are filled along their trajectories, recordings brought to one length, centred on the root and scaled by the mean length from
    ``root`` to ``far``. Three channels a pair of bones. Recordings that lack joints or have fewer than two frames are left out.
    """
    whole = skeleton.eligible(frames, "seq_id", joints, 2).withColumn("t", F.col("frame") * (1000.0 / rate))
    filled = gait.fill_points(whole)
    by, even = ["seq_id", "joint_id"], None
    for axis in "xyz":
        one = trajectory.time_normalise(filled, by, "t", axis, frames_wanted).select(*by, (F.col("nth") - 1).cast("int").alias("frame"), F.col("v").alias(axis))
        even = one if even is None else even.join(one, [*by, "frame"])
    scaled = skeleton.centre_and_scale(even, "seq_id", "frame", root, far)
    flat = scaled.groupBy("seq_id", "frame").agg(F.array_sort(F.collect_list(F.struct("joint_id", "x", "y", "z"))).alias("p")).where(F.size("p") == joints)
    flat = flat.select("seq_id", "frame", F.flatten(F.transform("p", lambda q: F.array(q["x"], q["y"], q["z"]))).alias("joints"))
    turned = skeleton.bone_rotations(flat, ["seq_id", "frame"], "joints", bones)
    first = (F.col("a") * len(bones) + F.col("b")) * 3
    rows = turned.select("seq_id", "frame", F.explode(F.array(*[F.struct((first + i).alias("channel"), F.col(c).alias("value")) for i, c in enumerate("xyz")])).alias("c")).select("seq_id", "frame", "c.channel", "c.value")
    return rows.join(frames.select("seq_id", "action").distinct(), "seq_id")


def event_pairs(normal: DataFrame, length: int, neighbour: int = 2) -> DataFrame:
    """``a, b, support``: in how many channels of recordings two instants, ``neighbour`` apart, are both persistent extrema. Gaps are filled by splines."""
    places = F.sequence(F.lit(0), F.lit(length - 1))
    held = normal.groupBy("seq_id", "channel").agg(F.map_from_entries(F.collect_list(F.struct("frame", "value"))).alias("m"))
    series = held.select("seq_id", "channel", F.transform(places, lambda i: F.try_element_at("m", i)).alias("v"))
    filled = cluster.fill_series(series, ["seq_id", "channel"], "v").where(~F.exists("filled", F.isnan))
    events = cluster.persistent_events(filled, ["seq_id", "channel"], "filled")
    return pairs.pair_support(events, ["seq_id", "channel"], "pos", neighbour)


def key_pairs(supports: DataFrame, compress: int = 3) -> DataFrame:
    """The best event pairs, none within ``compress`` of a better one that shares an instant."""
    return gait.prune_pairs(supports, compress)


def write_frames(normal: DataFrame, chosen: DataFrame, path: str) -> None:
    """The slices of the instants that the chosen pairs use, one folder a frame, and the numbered pairs beside them."""
    used = chosen.select(F.explode(F.array("a", "b")).alias("frame")).distinct()
    slices = normal.join(used, "frame", "left_semi").groupBy("seq_id", "action", "frame").agg(F.array_sort(F.collect_list(F.struct("channel", "value"))).alias("c"))
    slices.select("seq_id", "action", "frame", F.transform("c", lambda c: c["value"]).alias("features")).write.mode("overwrite").partitionBy("frame").parquet(f"{path}/frames")
    chosen.select(F.xxhash64("a", "b").alias("pair"), "a", "b", "support").write.mode("overwrite").parquet(f"{path}/pairs")


def read_pair_samples(spark, path: str) -> DataFrame:
    """``pair, seq_id, label, left, right``: every recording's two slices of every stored pair, by two equality joins; rows that are not whole go."""
    frames, chosen = spark.read.parquet(f"{path}/frames"), spark.read.parquet(f"{path}/pairs")
    left = frames.select("seq_id", F.col("action").alias("label"), F.col("frame").alias("a"), F.col("features").alias("left"))
    right = frames.select("seq_id", F.col("frame").alias("b"), F.col("features").alias("right"))
    bad = lambda c: F.exists(c, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return chosen.join(left, "a").join(right, ["seq_id", "b"]).where(~bad("left") & ~bad("right")).select("pair", "seq_id", "label", "left", "right")

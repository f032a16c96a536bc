"""From skeleton recordings to a trained classifier of phases: each step takes DataFrames and gives one."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..session import checkpoint_dir
from . import cluster, cycles, mining, phases, skeleton, split, standardise, templates, trajectory


def fill_points(frames: DataFrame) -> DataFrame:
    """``seq_id, frame, t, joint_id, x, y, z``: every joint's missing coordinates filled along its trajectory."""
    by = ["seq_id", "joint_id"]
    out = frames.select("seq_id", "frame", "t", "joint_id", "x", "y", "z")
    for axis in "xyz":
        out = trajectory.fill_gaps(out, by, "t", axis).withColumn(axis, F.col("filled")).drop("filled")
    return out


def label_frames(frames: DataFrame, events: DataFrame, phases: int) -> DataFrame:
    """``seq_id, frame, t, event_id, phase, cycle``: each event goes to its nearest frame, phases hold until the next event, event 1 opens a cycle."""
    times = frames.select("seq_id", "frame", "t").distinct().withColumn("frame", F.col("frame").cast("long"))
    marks = events.select("seq_id", "t", F.col("event_id").cast("int").alias("event_id")).withColumn("n", F.xxhash64("t", "event_id"))
    near = cycles.asof_nearest(marks, times, ["seq_id"], "t", "n", "frame").join(marks.drop("t"), ["seq_id", "n"]).groupBy("seq_id", "frame").agg(F.max("event_id").alias("event_id"))
    marked = times.join(near, ["seq_id", "frame"], "left")
    phased = cycles.interval_phase(marked.where("event_id is not null").select("seq_id", "t", F.col("event_id").alias("mark")), marked, ["seq_id"], phases)
    order = Window.partitionBy("seq_id").orderBy("t")
    opens = (F.coalesce(F.col("event_id"), F.lit(0)) == 1) & ~(F.coalesce(F.lag("event_id").over(order), F.lit(0)) == 1)
    return phased.withColumn("cycle", F.sum(opens.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)).cast("int"))


def channel_table(points: DataFrame, labelled: DataFrame, floor: tuple[float, float, float, float], joints: int, roles: dict[str, int] = skeleton.ROLES) -> DataFrame:
    """``seq_id, cycle, frame, t, channel, value, phase`` of the twelve channels; frames without all joints or outside cycles are dropped."""
    flat = points.groupBy("seq_id", "frame").agg(F.array_sort(F.collect_list(F.struct("joint_id", "x", "y", "z"))).alias("p")).where(F.size("p") == joints)
    flat = flat.select("seq_id", F.col("frame").cast("long").alias("frame"), F.flatten(F.transform("p", lambda q: F.array(q["x"], q["y"], q["z"]))).alias("joints"))
    framed = flat.join(labelled.where("cycle > 0"), ["seq_id", "frame"])
    plane: g.Plane = tuple(F.lit(float(x)) for x in floor)
    return skeleton.channel_rows(framed, ["seq_id", "cycle", "frame", "t", "phase"], skeleton.kinematics_12(F.col("joints"), plane, roles))


def resample_points(points: DataFrame, rate: int, target: int, reach: float = standardise.REACH) -> DataFrame:
    """``fill_points``' rows smoothed over ``reach`` milliseconds and taken from ``rate`` to ``target`` frames a second; ``frame`` counts anew.

    Coordinates that are still missing, before a joint's first known point or after its last, stay missing.
    """
    by = ["seq_id", "joint_id", "axis"]
    each = points.select("seq_id", "joint_id", "t", F.posexplode(F.array("x", "y", "z")).alias("axis", "v"))
    smooth = trajectory.smooth_reach(each, by, "t", "v", reach).select(*by, "t", "smooth")
    joined = each.drop("v").join(smooth, [*by, "t"], "left")
    fast = trajectory.resample(joined, by, "t", "smooth", rate, target)
    at = lambda i: F.max(F.when(F.col("axis") == i, F.col("v")))
    return fast.groupBy("seq_id", "joint_id", "nth").agg(F.min("t").alias("t"), at(0).alias("x"), at(1).alias("y"), at(2).alias("z")).select("seq_id", F.col("nth").alias("frame"), "t", "joint_id", "x", "y", "z")


def joint_arrays(points: DataFrame, joints: int) -> DataFrame:
    """``seq_id, frame, joints``: x0, y0, z0, x1, .. of every frame, null where a joint is missing."""
    held = points.groupBy("seq_id", "frame").agg(F.map_from_entries(F.collect_list(F.struct("joint_id", F.array("x", "y", "z").alias("p")))).alias("at"))
    flat = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(joints - 1)), lambda j: F.coalesce(F.try_element_at("at", j), F.array(*[F.lit(None).cast("double")] * 3))))
    return held.select("seq_id", F.col("frame").cast("long").alias("frame"), flat.alias("joints"))


def _owned(points: DataFrame, labelled: DataFrame, joints: int, root: int) -> DataFrame:
    """Frames that lie in a phase, with their joints, their root joint's coordinates and their cycle; written once, as every later step reads them."""
    checkpoint_dir(points.sparkSession)
    framed = joint_arrays(points, joints).join(labelled.where("phase IS NOT NULL").select("seq_id", "frame", "t", "event_id", "phase"), ["seq_id", "frame"])
    framed = framed.withColumns({c: F.get("joints", F.lit(3 * root + i)) for i, c in enumerate(("root_x", "root_y", "root_z"))})
    return phases.own_cycles(framed, ["seq_id"], "t", "event_id").checkpoint()


def _channels(joints: str, floor: tuple[float, float, float, float], roles: dict[str, int]) -> Column:
    plane: g.Plane = tuple(F.lit(float(x)) for x in floor)
    return F.transform(F.array(*skeleton.kinematics_12(F.col(joints), plane, roles)), lambda c: F.when(~F.isnan(c), c))


def normalise_cycles(points: DataFrame, labelled: DataFrame, floor: tuple[float, float, float, float], joints: int, length: int, labels: int, rate: int = 30, roles: dict[str, int] = skeleton.ROLES) -> DataFrame:
    """``seq_id, cycle, channel, values, labels``: the twelve channels of every whole cycle at ``length`` even times, and the phases there.

    Joints are standardised first (``standardise``, nearest frames within a period of ``rate``), channels worked out after; cycles that lack a channel anywhere are dropped.
    """
    owned = _owned(points, labelled, joints, roles["hip"])
    whole = standardise.anchors(phases.cycle_durations(owned, ["seq_id"], "t", ["root_x", "root_y", "root_z"], 0.0)).where("whole").checkpoint()
    rows = standardise.standardise(phases.members(owned, ["seq_id"], "t"), whole, ["seq_id"], "t", "joints", "phase", length, 1000.0 / rate, labels)
    rows = rows.withColumn("channels", _channels("values", floor, roles))
    held = rows.groupBy("seq_id", "cycle").agg(F.array_sort(F.collect_list(F.struct("nth", "channels", "label"))).alias("p"))
    full = held.where((F.size("p") == length) & ~F.exists("p", lambda q: F.exists(q["channels"], lambda c: c.isNull())))
    asked = full.select("seq_id", "cycle", "p", F.explode(F.sequence(F.lit(1), F.lit(12))).alias("channel"))
    return asked.select("seq_id", "cycle", "channel", F.transform("p", lambda q: F.get(q["channels"], F.col("channel") - 1)).alias("values"), F.transform("p", lambda q: q["label"]).alias("labels"))


def template_cycles(normal: DataFrame, labels: int, base: float = 2.0, lam: float = 10.0, rounds: int = 100, edge: float = 0.1, order: int = 5, aware: bool = True) -> DataFrame:
    """``channel, cluster, values, labels, members``: each channel's clusters of cycles as closed mean shapes with phases.

    Cycles are clustered by warping distances, label-aware or not, at the radius that these suggest (``templates.clustered_templates``).
    """
    keyed = normal.withColumn("key", F.xxhash64("seq_id", "cycle"))
    return templates.clustered_templates(keyed, ["channel"], "key", "values", "labels", cluster.label_table(labels, base), lam, order, rounds=rounds, edge=edge, aware=aware)


def mine_pairs(shapes: DataFrame, budget: int, labels: list[int], neighbour: int = 2, draws: int = 4) -> DataFrame:
    """``channel, a, b, total, rank``: pairs of offsets from a frame, the budget shared by the channels by their mean class quality.

    Candidates are the pairs of persistent events around each place of the ``template_cycles`` shapes; a pair's total is how well the three slopes that it gives at every
    place part every two phases.
    """
    checkpoint_dir(shapes.sparkSession)
    held = shapes.checkpoint()
    candidates = mining.key_pairs(held, ["channel", "cluster"], "values", neighbour).select("channel", "a", "b").distinct().checkpoint()
    slopes = mining.window_slopes(held, candidates, "channel", "cluster", "values", "labels")
    found = mining.class_quality(slopes, ["channel", "a", "b"], ["cluster", "at", "kind"], "label", "x", labels, draws)
    return mining.select_pairs(mining.summed_quality(found, candidates, "channel"), "channel", budget)


def prune_pairs(supports: DataFrame, neighbour: int = 3) -> DataFrame:
    """``a, b, support``: for each first position its best pairs that lie ``neighbour`` apart, then the same for each second position.

    A position keeps as many pairs as there are pairs per distinct position on average (rounded), best support first, ties to the
    smaller position. A position has fewer pairs than a series has samples, so a group is small.
    """
    out = supports.select("a", "b", "support")
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in out.schema)
    for own, other in (("a", "b"), ("b", "a")):
        most = F.greatest(F.lit(1), F.floor(F.count("*") / F.greatest(F.lit(1), F.count_distinct(own)) + 0.5)).cast("int")

        def keep(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf, most = pdf.drop(columns="_most").sort_values(["support", other], ascending=[False, True]), pdf["_most"].iloc[0]  # noqa: B023
            taken: list[int] = []
            rows = []
            for i, x in enumerate(pdf[other]):  # noqa: B023
                if len(taken) < most and all(abs(x - y) > neighbour for y in taken):  # noqa: B023
                    taken.append(x)
                    rows.append(i)
            return pdf.iloc[rows]

        out = out.join(F.broadcast(out.agg(most.alias("_most")))).groupBy(own).applyInPandas(keep, kinds)  # one row
    return out


def phase_samples(points: DataFrame, labelled: DataFrame, floor: tuple[float, float, float, float], joints: int, mined: list[tuple[int, int, int]], length: int, rate: int = 120, least: float = 400.0, roles: dict[str, int] = skeleton.ROLES) -> DataFrame:
    """``seq_id, cycle, frame, features, label``: at every frame in a phase, for each mined pair, the channel's difference between the two instants around it.

    ``mined`` is a bounded list of (channel, a, b), offsets from the frame in parts of ``length`` of its cycle. Instants reach into the neighbouring cycles
    with their durations; open first and last cycles have predicted ones (``phases``). Frames for which no feature can be had are dropped.
    """
    owned = _owned(points, labelled, joints, roles["hip"]).withColumn("channels", _channels("joints", floor, roles)).drop("joints")
    durations = phases.cycle_durations(owned, ["seq_id"], "t", ["root_x", "root_y", "root_z"], least).checkpoint()
    period = 1000.0 / rate
    windows = phases.phase_windows(owned.drop("channels"), durations, ["seq_id"], "t", period, 10_000.0).checkpoint()
    shares = [(channel - 1, a / length, b / length) for channel, a, b in mined]
    rows = phases.phase_samples(windows, owned, ["seq_id"], ["frame"], "t", "channels", shares, period, 10_000.0)
    return rows.select("seq_id", "cycle", "frame", "features", F.col("phase").alias("label"))


def train_and_evaluate(samples: DataFrame, labels: list[int], width: int, trees: int, depth: int, held_out) -> tuple[split.Forest, DataFrame]:
    """A forest grown on the samples that ``held_out`` (a Column) does not pick, and its accuracy on those it does."""
    keyed = samples.withColumn("key", F.xxhash64("seq_id", "cycle", "frame"))
    chosen = keyed.where(~held_out)
    forest = split.grow_forest(chosen, "key", "features", "label", width, labels, trees, depth, least=split.least_samples(chosen.count()))
    voted = split.predict_forest(keyed.where(held_out), ["key", "label"], "features", forest)
    return forest, split.evaluate(voted, "label", "predicted")

"""Neighbours in time, cycles with open ends, warped windows and samples."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from motionframe.operators import cycles, phases, standardise


@pytest.mark.parametrize("width", [0.5, 7.0, 1e9])
def test_neighbours_in_buckets(spark, width):
    rng = np.random.default_rng(1)
    frames = [(int(rng.integers(3)), float(rng.integers(200)) / 4, int(rng.integers(100))) for _ in range(150)]
    asked = [(int(rng.integers(4)), float(rng.integers(-20, 240)) / 4, i) for i in range(200)]
    found = cycles.around(spark.createDataFrame(asked, "s int, t double, n int"), spark.createDataFrame(frames, "s int, t double, v int"), ["s"], "t", ["v"], width).collect()
    assert len(found) == 200
    for r in found:
        mine = [(t, v) for s, t, v in frames if s == r.s]
        before, after = [x for x in mine if x[0] <= r.t], [x for x in mine if x[0] >= r.t]
        near = min((t for t, _ in after), default=None)
        assert (tuple(r.before) if r.before else None) == max(before, default=None)
        assert (tuple(r.after) if r.after else None) == max((x for x in after if x[0] == near), default=None)


MARKS = [None, 2, 1, None, 2, 1, 1, 2, None, 1, 3]
VALUES = [3.0, 1.0, 4.0, 1.0, 5.0, 9.0, None, 6.0, 5.0, 3.0, 5.0]


@pytest.fixture(scope="module")
def owned(spark):
    rows = [(1, 10.0 * i, m, VALUES[i]) for i, m in enumerate(MARKS)] + [(2, 5.0 * i, 1 if i in (0, 4, 8) else 2, float(i)) for i in range(9)] + [(3, float(i), 1 if i == 2 else 2, 0.0) for i in range(5)]
    return phases.own_cycles(spark.createDataFrame(rows, "s int, t double, mark int, v double"), ["s"], "t", "mark")


def test_cycles_have_both_borders(owned):
    found = {s: [(r.cycle, r.splits) for r in owned.where(F.col("s") == s).orderBy("t").collect()] for s in (1, 2, 3)}
    assert [c for c, _ in found[1]] == [0, 0, 0, 1, 1, 1, 2, 2, 2, 2, 3] and [i for i, (_, o) in enumerate(found[1]) if o] == [2, 5, 9]
    assert [c for c, _ in found[2]] == [0] * 5 + [1] * 4 and not found[3]
    spans = {(r.s, r.cycle): (r.start_t, r.end_t, r.whole) for r in phases.cycle_durations(owned, ["s"], "t", ["v"], 0.0).collect()}
    assert spans == {(1, 0): (0.0, 20.0, False), (1, 1): (20.0, 50.0, True), (1, 2): (50.0, 90.0, True), (1, 3): (90.0, 100.0, False), (2, 0): (0.0, 20.0, True), (2, 1): (20.0, 40.0, True)}


def test_open_cycles_have_predicted_durations(owned):
    found = {r.cycle: r for r in phases.cycle_durations(owned, ["s"], "t", ["v"], 0.0).where("s = 1").collect()}
    ratio = (30 / (5 / 30) + 40 / (6 / 40)) / 2  # the whole cycles' durations over their velocities
    assert found[0].duration == pytest.approx(1 / 20 * ratio) and found[3].duration == pytest.approx(2 / 10 * ratio)
    assert found[1].prev_duration == found[0].duration and found[0].next_duration == 30.0 and found[3].next_duration is None
    assert (found[2].first_t, found[2].last_t) == (0.0, 100.0)
    still = phases.cycle_durations(owned.withColumn("v", F.lit(1.0)), ["s"], "t", ["v"], 35.0).where("s = 1").collect()
    assert {r.cycle: r.duration for r in still} == {0: 40.0, 1: 30.0, 2: 40.0, 3: 40.0}  # the mean of those longer than 35
    short = phases.cycle_durations(owned, ["s"], "t", ["v"], 1000.0).where("s = 1").collect()
    assert {r.cycle: r.duration for r in short} == {0: None, 1: 30.0, 2: 40.0, 3: None}


def test_samples_reach_into_neighbours(owned):
    durations = phases.cycle_durations(owned, ["s"], "t", ["v"], 0.0)
    given = {"duration": F.when(F.col("whole"), F.col("duration")).otherwise(20.0), "prev_duration": F.when(F.col("cycle") == 1, 20.0).otherwise(F.col("prev_duration")), "next_duration": F.when(F.col("cycle") == 2, 20.0).otherwise(F.col("next_duration"))}
    windows = phases.phase_windows(owned.where("s = 1"), durations.withColumns(given), ["s"], "t", 3.0, 25.0)
    assert {r.t: (r.window_start, r.window_end) for r in windows.where("t IN (0, 30, 60)").collect()} == {0.0: (0.0, 10.0), 30.0: (10.0, 50.0), 60.0: (40.0, 80.0)}
    rows = phases.phase_samples(windows.withColumn("k", F.col("t")), owned.select("s", "t", F.array("v", F.lit(1.0)).alias("x")), ["s"], ["k"], "t", "x", [(0, 0.25, -0.25), (1, -0.5, 0.0), (0, 0.0, 0.5)], 3.0, 25.0)
    found = {r.t: r.features for r in rows.collect()}
    assert found[70.0] == [phases.MASK, 0.0, 6.0 - 3.0] and found[90.0] == [phases.MASK, 0.0, 3.0 - 5.0] and 0.0 in found


def test_even_times_of_sparse_cycles(spark):
    """Copies are carried over gaps shorter than the tolerance from one to the next; beyond it the second pass takes a frame up to twice as far."""
    frames = spark.createDataFrame([(0, 1, t, [v, None], p) for t, v, p in ((0.0, 1.0, 1), (10.0, 2.0, 2), (60.0, 3.0, 2), (100.0, 4.0, 3))], "s int, cycle int, t double, x array<double>, p int")
    cycle = spark.createDataFrame([(0, 1, 0.0, 100.0, 100.0, True)], "s int, cycle int, start_t double, end_t double, duration double, whole boolean")
    rows = standardise.standardise(frames, standardise.anchors(cycle), ["s"], "t", "x", "p", 10, 10.5, 3, 1e-6).orderBy("nth").collect()
    assert [r.label for r in rows] == [1, 2, 2, 2, 2, 2, 2, 2, 2, 3] and [round(r.share, 6) for r in rows] == [i / 10 for i in range(10)]
    assert [r["values"][0] for r in rows] == [1.0, 2.0, 2.0, 2.0, 2.0, 3.0, 3.0, 3.0, 3.0, 4.0] and all(r["values"][1] is None for r in rows)
    far = standardise.standardise(frames, standardise.anchors(cycle), ["s"], "t", "x", "p", 10, 9.0, 3, 1e-6).orderBy("nth").collect()
    assert [r["values"][0] if r["values"] else None for r in far] == [1.0, 2.0, 2.0, None, None, 3.0, 3.0, 3.0, None, 4.0]
    back = cycle.withColumn("cycle", F.lit(0)).withColumn("whole", F.lit(False)).withColumn("duration", F.lit(200.0))
    assert standardise.anchors(back).first().anchor == -100.0
    assert [r.nth for r in standardise.standardise(frames.withColumn("cycle", F.lit(0)), standardise.anchors(back), ["s"], "t", "x", "p", 10, 10.5, 3, 1e-6).orderBy("nth").collect()] == [5, 6, 7, 8, 9]

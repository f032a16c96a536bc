"""Cycles at even times: what a cycle's rows cost to move."""

from __future__ import annotations

from pyspark.sql import functions as F

from motionframe.operators import cycles, standardise


def _rows(spark):
    frames = [(s, c, 10.0 * c + k, [float(k % 3), None if k % 4 == 1 else 1.0 * s], 1 + k % 5) for s in range(3) for c in range(4) for k in range(10)]
    frames = spark.createDataFrame(frames, "seq long, cycle int, t double, values array<double>, mark int")
    facts = frames.groupBy("seq", "cycle").agg(F.min("t").alias("start_t"), F.max("t").alias("end_t")).withColumns({"whole": F.lit(True), "duration": F.col("end_t") - F.col("start_t")})
    return frames, facts


def test_rows_are_moved_to_their_cycle_once(spark):
    frames, facts = _rows(spark)
    found = standardise.standardise(frames, standardise.anchors(facts), ["seq"], "t", "values", "mark", 8, 3.0, 5, 4.0)
    assert found.where("values[0] IS NOT NULL").count() == 3 * 4 * 8
    plan = found._jdf.queryExecution().executedPlan().toString().split("+- == Initial Plan ==")[-1]
    assert plan.count("Exchange hashpartitioning") <= 12  # 51 when every lookup had buckets and every step its own partitions


def test_without_buckets_the_same_neighbours_are_found(spark):
    asked = spark.createDataFrame([(1, -4.0), (1, 0.5), (1, 2.0), (1, 9.0), (1, None), (2, 1.0)], "k int, t double")
    frames = spark.createDataFrame([(1, -3.0, "a"), (1, 2.0, "b"), (1, 2.0, "c"), (1, 5.0, "d")], "k int, t double, v string")
    one, many = ({tuple(r) for r in cycles.around(asked, frames, ["k"], "t", ["v"], width).collect()} for width in (None, 1.5))
    assert one == many and len(one) == 6

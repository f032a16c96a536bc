"""Streams out of order give what the batch gives."""

import pytest
from pyspark.sql import functions as F

from motionframe import schema
from motionframe.operators import split, trajectory
from motionframe.streaming import stateful
from tests.conftest import SF


@pytest.fixture(scope="module")
def shuffled(spark, tmp_path_factory):
    """The events in eight files: each a window of time, its rows in no order, the rows near its ends swapped with the neighbouring files'."""
    path = str(tmp_path_factory.mktemp("events") / "in")
    events = spark.read.parquet(f"{SF}/events.parquet").where("user_id < 6")
    rows = events.select(F.col("user_id").alias("seq_id"), "event_id", "ts", F.when(F.col("event_type") != "error", F.col("value")).alias("v"))
    days = F.floor((F.unix_millis(F.col("ts").cast("timestamp")) + F.pmod(F.xxhash64("event_id"), F.lit(40)) * 1_800_000) / (4 * 86_400_000))  # up to 20 hours late
    ordered = rows.withColumn("file", days).orderBy("file", F.xxhash64("event_id"))
    for i, name in enumerate(sorted(r.file for r in ordered.select("file").distinct().collect())):
        ordered.where(F.col("file") == name).drop("file").coalesce(1).write.mode("append").parquet(f"{path}/part={i:02d}")
    return path, rows


def drained(spark, stream, name):
    query = stream.writeStream.outputMode("append").format("memory").queryName(name).start()
    query.processAllAvailable()
    query.stop()
    return spark.table(name).collect()


@pytest.fixture()
def rocks(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", stateful.PROVIDER)
    yield
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def batch(rows):
    known = schema.trajectories(rows.select(F.col("seq_id").alias("user_id"), "event_id", "ts", F.lit("x").alias("event_type"), F.col("v").alias("value")))
    return {r.event_id: (r.seq_id, r.filled) for r in trajectory.fill_gaps(known, ["seq_id"], "t", "v").collect()}


@pytest.mark.parametrize("patience", [None, 0])
def test_filled_streams_equal_the_batch(spark, rocks, shuffled, patience):
    path, rows = shuffled
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(f"{path}/*")
    found = drained(spark, stateful.fill_gaps(stream, "1 day", patience), f"filled_{patience}")
    expected, ids = batch(rows), [r.event_id for r in found]
    assert len(ids) == len(set(ids)) and len(ids) > 0.7 * len(expected)
    end = rows.agg(F.max("ts")).first()[0]
    sure = {r.event_id for r in rows.where((F.col("ts") < F.lit(end) - F.expr("INTERVAL 3 DAYS")) & F.col("v").isNotNull()).collect()}
    assert sure <= set(ids)
    for r in found:
        seq_id, filled = expected[r.event_id]
        assert r.seq_id == seq_id
        if patience is None or r.filled is not None:
            assert r.filled == pytest.approx(filled) if filled is not None else r.filled is None
    missing = {r.event_id for r in rows.where("v IS NULL").collect()} & set(ids)
    assert missing and (patience == 0 or any(expected[i][1] is not None for i in missing))


def test_scored_stream_equals_the_batch(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet")
    forest = split.grow_trees(rows.where("vec_id % 4 = 0"), "vec_id", "embedding", "label", 64, list(range(10)), [0, 1], 2)
    stream = spark.readStream.schema(rows.schema).option("pathGlobFilter", "embeddings.parquet").parquet(SF)
    found = drained(spark, stateful.score(stream, ["vec_id"], "embedding", forest), "scored")
    assert sorted(map(tuple, found)) == sorted(map(tuple, forest.predict(rows, ["vec_id"], "embedding").collect())) and len(found) == rows.count()

import numpy as np
import pytest
from pyspark.sql import functions as F

from motionframe.operators import actions, gait
from motionframe.sources import containers, samples
from motionframe.streaming import timeline
from tests.conftest import SF

JOINTS = 7


def recording(seq_id, seconds=4.0, rate=30, step=1.0):
    """A walker: sinusoidal legs over the floor y = 0, four events a step, some points missing."""
    rng = np.random.default_rng(seq_id)
    t = np.arange(0, seconds, 1 / rate)
    phase = 2 * np.pi * t / step
    p = np.zeros((len(t), JOINTS, 3))
    p[:, 0] = np.stack([0.5 * t, 1 + 0.02 * np.sin(2 * phase), 0 * t], axis=1)
    swing = 0.4 * np.sin(phase)
    for j, (x, y) in enumerate([(0.2, 0.5), (0.45, 0.12), (0.6, 0.03), (0.4, 0.05)], 1):
        p[:, j] = np.stack([0.5 * t + x * swing + 0.05 * j, y + 0.1 * np.maximum(0, np.cos(phase)), 0 * t + 0.1], axis=1)
    for j, y in ((5, 0.03), (6, 0.05)):
        p[:, j] = np.stack([0.5 * t - 0.6 * swing, y + 0.1 * np.maximum(0, -np.cos(phase)), 0 * t - 0.1], axis=1)
    p += rng.normal(0, 0.002, p.shape)
    p[10:13, 2] = np.nan
    events = [(1000 * (k * step / 4), k % 4 + 1) for k in range(int(4 * seconds / step))]
    return containers.encode_sequence(seq_id, seq_id % 2, list(range(JOINTS)), (0, 1, 0, 0), 1000 * t, p, None, events)


@pytest.fixture(scope="module")
def recorded(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("rec") / "walk")
    chunks = spark.createDataFrame([(bytearray(recording(i)),) for i in range(4)], "payload binary")
    spark.dataSource.register(containers.ContainerSource)
    chunks.repartition(2).write.format("container").option("header", "WALK").option("version", "1").mode("append").save(path)
    return containers.read_sequences(spark, path, JOINTS, "WALK")


def test_container_round_trip(spark, recorded, tmp_path):
    frames, events = recorded
    assert frames.count() == 4 * 120 * JOINTS and events.count() == 4 * 16
    assert frames.where("x is null").count() == 4 * 3
    (tmp_path / "one").write_bytes(containers.encode("X", 3, {"k": b"v"}, [b"a", b"", b"bc"]))
    with open(tmp_path / "one", "rb") as f:
        assert containers.read_head(f)[:3] == ("X", 3, {"k": b"v"})
    assert [bytes(r.payload) for r in containers.read_container(spark, str(tmp_path / "one")).orderBy("chunk").collect()] == [b"a", b"", b"bc"]
    with pytest.raises(Exception, match="container"):
        containers.read_container(spark, str(tmp_path / "one"), "Y").collect()


FLOOR = (0, 1, 0, 0)


@pytest.fixture(scope="module")
def points(spark, recorded):
    frames, _ = recorded
    filled = gait.fill_points(frames)
    assert filled.where("x is null").count() == 0
    fast = gait.resample_points(filled, 30, 120).cache()
    assert fast.count() == 4 * JOINTS * (119 * 4 + 1) and fast.where("x is null").count() == 0
    return fast


def test_from_recording_to_classifier(spark, recorded, points, tmp_path):
    labelled = gait.label_frames(points, recorded[1], 4).cache()
    assert labelled.count() == 4 * 477 and labelled.agg(F.max("cycle")).first()[0] == 4
    normal = gait.normalise_cycles(points, labelled, FLOOR, JOINTS, 20, 4).cache()
    assert normal.count() == 4 * 3 * 12 and normal.where(F.size("values") != 20).count() == 0
    assert all(r.labels[0] == 1 and r.labels[-1] == 4 and r.labels[1:-1] == sorted(r.labels[1:-1]) for r in normal.collect())
    templates = gait.template_cycles(normal, 4).cache()
    assert {r.channel for r in templates.collect()} == set(range(1, 13)) and all(len(r["values"]) == len(r.labels) == 20 and set(r.labels) <= {1, 2, 3, 4} for r in templates.collect())
    assert all(abs(r["values"][0] - r["values"][-1]) < 1e-9 for r in templates.collect())
    mined = gait.mine_pairs(templates, 12, [1, 2, 3, 4]).cache()
    chosen = [(r.channel, r.a, r.b) for r in mined.orderBy("channel", "a", "b").collect()]
    assert 6 <= len(chosen) <= 18 and all(-10 <= a < b <= 10 and b - a >= 2 for _, a, b in chosen) and mined.where("total <= 0").count() == 0
    rows = gait.phase_samples(points, labelled, FLOOR, JOINTS, chosen, 20)
    samples.write_samples(rows, str(tmp_path / "samples"))
    stored = samples.read_samples(spark, str(tmp_path / "samples"))
    assert stored.count() == stored.select("seq_id", "frame").distinct().count() > 4 * 420
    assert {r.cycle for r in stored.select("cycle").distinct().collect()} == {0, 1, 2, 3}  # the last one is open
    _, score = gait.train_and_evaluate(stored, [1, 2, 3, 4], len(chosen), 5, 4, F.col("seq_id") == 3)
    assert score.first().accuracy > 0.6


def test_smoothing_keeps_lines(spark):
    rows = [(1, 0, i, 33.0 * i, 2.0 * i, None if i in (4, 5) else 1.0, -0.5 * i) for i in range(40)]
    frames = spark.createDataFrame(rows, "seq_id long, joint_id int, frame int, t double, x double, y double, z double")
    fast = gait.resample_points(gait.fill_points(frames), 30, 120).collect()
    assert len(fast) == 39 * 4 + 1
    assert all(abs(r.x - 2 * r.t / 33) < 1e-9 and abs(r.y - 1) < 1e-9 and abs(r.z + 0.5 * r.t / 33) < 1e-9 for r in fast)


def test_pruned_pairs_are_apart(spark):
    rows = [(a, b, (7 * a + 3 * b) % 11) for a in range(12) for b in range(a + 2, 12)]
    kept = gait.prune_pairs(spark.createDataFrame(rows, "a int, b int, support int"), 2).collect()
    for r in kept:
        assert all(r is s or r.a != s.a or abs(r.b - s.b) > 2 for s in kept)
    assert 0 < len(kept) < len(rows)


def drained(stream, name, mode):
    query = stream.writeStream.outputMode(mode).format("memory").queryName(name).start()
    query.processAllAvailable()
    query.stop()


def test_streams_equal_batches(spark):
    events = spark.read.parquet(f"{SF}/events.parquet")
    stream = spark.readStream.schema(events.schema).option("pathGlobFilter", "events.parquet").parquet(SF)
    drained(timeline.window_facts(stream, length="1 day"), "w", "complete")
    expected = {(r.start, r.event_type): r.n for r in timeline.window_facts(events, length="1 day").collect()}
    assert {(r.start, r.event_type): r.n for r in spark.table("w").collect()} == expected
    drained(timeline.cycles(stream), "c", "append")
    from motionframe import schema
    from motionframe.operators import cycles

    batch = cycles.segment_cycles(schema.markers(events), ["seq_id"], "t", "mark").where("cycle > 0").groupBy("seq_id", "cycle").count()
    whole = {(r.seq_id, r.cycle): r["count"] for r in batch.collect()}
    found = {(r.user_id, r.cycle): r.events for r in spark.table("c").collect()}
    assert found and all(whole[k] == n for k, n in found.items())
    assert timeline.sessions(events).agg(F.sum("n")).first()[0] == events.count()


def test_action_recordings_to_pair_samples(spark, tmp_path):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(25, 3))

    def body(action, k):
        p = base.copy()
        p[2:6] += 0.8 * np.array([np.sin((action + 1) * k / 6), np.cos(k / (3 + action)), 0.3 * np.sin(k / 4)])
        return p

    chunks = [containers.encode_action(1, 2, s, 0, s % 2, [None if k == 7 else body(s % 2, k) for k in range(40)]) for s in range(4)]
    chunks += [containers.encode_action(1, 2, 9, 0, 1, None), containers.encode_action(1, 2, 9, 0, 1, [base[:24]])]
    (tmp_path / "a").write_bytes(containers.encode("STRUCT", 1, {}, chunks))
    frames = containers.read_actions(spark, str(tmp_path / "a"), "STRUCT")
    assert frames.count() == 4 * 40 * 25 and frames.where("x is null").count() == 4 * 25 and {r.subject for r in frames.select("subject").distinct().collect()} == {0, 1, 2, 3}
    bones = [(0, 2), (1, 3), (4, 6)]
    normal = actions.normalise(frames, 20, bones, 25).cache()
    assert normal.count() == 4 * 20 * 6 * 3 and normal.where("value is null").count() == 0
    supports = actions.event_pairs(normal, 20)
    chosen = actions.key_pairs(supports).cache()
    assert 0 < chosen.count() <= supports.count()
    actions.write_frames(normal, chosen, str(tmp_path / "out"))
    found = actions.read_pair_samples(spark, str(tmp_path / "out"))
    assert found.count() == 4 * chosen.count() and found.where("size(left) <> 18 or size(right) <> 18").count() == 0


def test_tensor_files(spark, tmp_path):
    values = np.arange(24, dtype=np.float32).reshape(2, 3, 4)
    (tmp_path / "t").write_bytes(containers.encode_tensor(values))
    rows = containers.read_tensors(spark, str(tmp_path / "t")).collect()
    assert len(rows) == 24 and all(values[tuple(r.position)] == r.value for r in rows)
    assert np.array_equal(containers.decode_tensor(containers.encode_tensor(np.array([[1, -2]]), 6)), [[1, -2]])
    with pytest.raises(ValueError):
        containers.decode_tensor(b"RSDN....")

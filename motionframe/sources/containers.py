"""Chunked record containers as a Spark data source, and the sequences stored in them.

Layout (little endian): header string, int32 version; uint32 count of items, each a key string, a uint64 size and bytes; uint64 count of chunks
and an int64 position for each; chunks, each a uint64 size and bytes. A string is a uint32 byte length and UTF-16-LE.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage


def _string(text: str) -> bytes:
    raw = text.encode("utf-16-le")
    return struct.pack("<I", len(raw)) + raw


def encode(header: str, version: int, items: dict[str, bytes], chunks: list[bytes]) -> bytes:
    """One container's bytes."""
    out = _string(header) + struct.pack("<i", version) + struct.pack("<I", len(items))
    out += b"".join(_string(k) + struct.pack("<Q", len(v)) + v for k, v in items.items())
    at = len(out) + 8 + 8 * len(chunks)
    places = []
    for c in chunks:
        places.append(at)
        at += 8 + len(c)
    return out + struct.pack("<Q", len(chunks)) + struct.pack(f"<{len(places)}q", *places) + b"".join(struct.pack("<Q", len(c)) + c for c in chunks)


def read_head(file) -> tuple[str, int, dict[str, bytes], list[int]]:
    """Header, version, items and chunk positions from an open file."""

    def take(kind: str):
        return struct.unpack(f"<{kind}", file.read(struct.calcsize(f"<{kind}")))

    text = lambda: file.read(take("I")[0]).decode("utf-16-le")
    header, (version,) = text(), take("i")
    items = {}
    for _ in range(take("I")[0]):
        key = text()
        items[key] = file.read(take("Q")[0])
    (count,) = take("Q")
    return header, version, items, list(take(f"{count}q"))


def _files(path: str):
    from pyarrow import fs

    system, base = fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")
    found = system.get_file_info(base)
    if found.type == fs.FileType.File:
        return system, [base]
    return system, sorted(i.path for i in system.get_file_info(fs.FileSelector(base)) if i.is_file and not i.base_name.startswith(("_", ".")))


class _Part(InputPartition):
    def __init__(self, path: str, first: int, last: int):
        self.path, self.first, self.last = path, first, last


class ContainerSource(DataSource):
    """``spark.read.format("container").option("header", ..).load(path)``: ``path, chunk, payload``; a partition holds ``chunks`` (64) chunks of a file.

    Writing takes the column ``payload`` and options ``header``, ``version``: one container per task.
    """

    @classmethod
    def name(cls) -> str:
        return "container"

    def schema(self) -> str:
        return "path string, chunk int, payload binary"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options, schema.fieldNames().index("payload"))


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options = dict(options)

    def partitions(self) -> list[InputPartition]:
        system, paths = _files(self.options["path"])
        step, out = int(self.options.get("chunks", 64)), []
        for path in paths:
            with system.open_input_file(path) as f:
                header, _, _, places = read_head(f)
            if self.options.get("header") not in (None, header):
                raise ValueError(f"{path} is a {header!r} container")
            out += [_Part(path, i, min(i + step, len(places))) for i in range(0, len(places), step)]
        return out

    def read(self, part: _Part) -> Iterator[tuple]:
        system, _ = _files(self.options["path"])
        with system.open_input_file(part.path) as f:
            places = read_head(f)[3]
            for i in range(part.first, part.last):
                f.seek(places[i])
                yield part.path, i, f.read(struct.unpack("<Q", f.read(8))[0])


class _Writer(DataSourceWriter):
    def __init__(self, options: dict[str, str], column: int):
        self.options, self.column = dict(options), column

    def write(self, rows) -> WriterCommitMessage:
        from pyarrow import fs
        from pyspark import TaskContext

        chunks = [bytes(r[self.column]) for r in rows]
        if chunks:
            path = self.options["path"]
            system, base = fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")
            system.create_dir(base)
            name = f"{base}/part-{TaskContext.get().partitionId():05d}"
            with system.open_output_stream(f"{name}.tmp") as f:
                f.write(encode(self.options.get("header", ""), int(self.options.get("version", 1)), {}, chunks))
            system.move(f"{name}.tmp", name)
        return WriterCommitMessage()


def read_container(spark: SparkSession, path: str, header: str | None = None) -> DataFrame:
    spark.dataSource.register(ContainerSource)
    reader = spark.read.format("container")
    return (reader.option("header", header) if header else reader).load(path)


def encode_sequence(seq_id: int, subject: int, joints: list[int], floor: tuple | None, times: np.ndarray, points: np.ndarray, labels=None, events=None) -> bytes:
    """One recording: ids, floor plane, times (ms), points[frame, joint, 3], frame labels, (event time, id) pairs."""
    out = struct.pack("<qqi", seq_id, subject, len(joints)) + np.asarray(joints, "<i4").tobytes() + struct.pack("<?", floor is not None)
    out += struct.pack("<4f", *floor) if floor is not None else b""
    out += struct.pack("<Q", len(times))
    if len(times):
        out += np.asarray(times, "<f4").tobytes() + np.asarray(points, "<f4").tobytes() + struct.pack("<?", labels is not None)
        out += np.asarray(labels, "<i4").tobytes() if labels is not None else b""
        out += struct.pack("<?", events is not None)
        if events is not None:
            out += struct.pack("<i", len(events)) + np.asarray([t for t, _ in events], "<f4").tobytes() + np.asarray([e for _, e in events], "<i4").tobytes()
    return out


def decode_sequence(raw: bytes, joints: int) -> dict:
    """The reverse; ``joints`` is how many points a frame has."""
    at = 0

    def take(kind: str, n: int = 1) -> np.ndarray:
        nonlocal at
        got = np.frombuffer(raw, kind, n, at)
        at += got.nbytes
        return got

    seq_id, subject = (int(x) for x in take("<i8", 2))
    own = take("<i4", int(take("<i4")[0]))
    floor = [float(x) for x in take("<f4", 4)] if take("?")[0] else None
    n = int(take("<u8")[0])
    times, points, labels, events = np.zeros(0), np.zeros((0, joints, 3)), None, []
    if n:
        times, points = take("<f4", n).astype(float), take("<f4", n * joints * 3).astype(float).reshape(n, joints, 3)
        labels = take("<i4", n) if take("?")[0] else None
        if take("?")[0]:
            count = int(take("<i4")[0])
            events = list(zip(take("<f4", count).astype(float), take("<i4", count).tolist()))
    return {"seq_id": seq_id, "subject": subject, "joints": own, "floor": floor, "times": times, "points": points, "labels": labels, "events": events}


def read_sequences(spark: SparkSession, path: str, joints: int, header: str | None = None) -> tuple[DataFrame, DataFrame]:
    """``(frames, events)`` of the recordings in a container; a point of NaNs is missing (nulls)."""
    chunks = read_container(spark, path, header).select("payload")

    def frames(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for raw in pdf["payload"]:
                s = decode_sequence(raw, joints)
                n = len(s["times"])
                p = s["points"].reshape(-1, 3)
                label = np.repeat(s["labels"], joints) if s["labels"] is not None else [None] * (n * joints)
                yield pd.DataFrame({"seq_id": s["seq_id"], "frame": np.repeat(np.arange(n), joints), "t": np.repeat(s["times"], joints), "joint_id": np.tile(np.arange(joints), n), "x": p[:, 0], "y": p[:, 1], "z": p[:, 2], "label": pd.array(label, dtype="Int32")})

    def events(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for raw in pdf["payload"]:
                s = decode_sequence(raw, joints)
                yield pd.DataFrame([(s["seq_id"], t, e) for t, e in s["events"]], columns=["seq_id", "t", "event_id"])

    from ..schema import EVENTS, FRAMES, null_if_nan

    tidy = chunks.mapInPandas(frames, FRAMES)
    return tidy.withColumns({c: null_if_nan(tidy[c]) for c in "xyz"}), chunks.mapInPandas(events, EVENTS)


#: Joints of an action recording.
ACTION_JOINTS = 25


def encode_action(setup: int, view: int, subject: int, replication: int, action: int, frames: list[np.ndarray | None] | None) -> bytes:
    """One action recording: ids, the action's label, and per frame the body's points (joints, 3) or None; ``frames`` None: no data."""
    out = struct.pack("<6i", setup, view, subject, replication, action, len(frames or [])) + struct.pack("<?", frames is not None)
    for body in frames or []:
        out += struct.pack("<?", body is not None)
        if body is not None:
            out += struct.pack("<i", len(body)) + np.asarray(body, "<f4").tobytes()
    return out


def decode_action(raw: bytes) -> dict | None:
    """The reverse; None for a recording without data or with a body of other than 25 joints. A frame without a body is all NaN."""
    setup, view, subject, replication, action, n = struct.unpack_from("<6i", raw)
    at = 24
    if not raw[at]:
        return None
    at += 1
    points = np.full((n, ACTION_JOINTS, 3), np.nan)
    for i in range(n):
        has_body, at = raw[at], at + 1
        if has_body:
            (joints,) = struct.unpack_from("<i", raw, at)
            if joints != ACTION_JOINTS:
                return None
            points[i] = np.frombuffer(raw, "<f4", joints * 3, at + 4).reshape(joints, 3)
            at += 4 + 12 * joints
    return {"setup": setup, "view": view, "subject": subject, "replication": replication, "action": action, "points": points}


def read_actions(spark: SparkSession, path: str, header: str | None = None) -> DataFrame:
    """``seq_id, setup, view, subject, replication, action, frame, joint_id, x, y, z`` of the action recordings that have 25 joints throughout.

    ``seq_id`` is a hash of the file and the chunk; missing bodies are nulls.
    """
    rows = read_container(spark, path, header).select(F.xxhash64("path", "chunk").alias("seq_id"), "payload")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for seq_id, raw in zip(pdf["seq_id"], pdf["payload"]):
                s = decode_action(raw)
                if s is not None:
                    p = s.pop("points")
                    n = len(p)
                    flat = p.reshape(-1, 3)
                    yield pd.DataFrame({"seq_id": seq_id, **s, "frame": np.repeat(np.arange(n), ACTION_JOINTS), "joint_id": np.tile(np.arange(ACTION_JOINTS), n), "x": flat[:, 0], "y": flat[:, 1], "z": flat[:, 2]})

    from ..schema import null_if_nan

    ids = ("setup", "view", "subject", "replication", "action", "frame", "joint_id")
    found = rows.mapInPandas(run, "seq_id long, " + ", ".join(f"{c} int" for c in ids) + ", x double, y double, z double")
    return found.withColumns({c: null_if_nan(found[c]) for c in "xyz"})


#: Element types of tensor files by their number. Fixed values.
TENSOR_TYPES = {1: "?", 2: "<i1", 3: "<u1", 4: "<i2", 5: "<u2", 6: "<i4", 7: "<u4", 8: "<i8", 9: "<u8", 10: "<f4", 11: "<f8"}


def encode_tensor(values: np.ndarray, kind: int = 10, version: int = 1) -> bytes:
    return b"RSDNBUFF" + struct.pack("<4i", version, kind, 2, values.ndim) + struct.pack(f"<{values.ndim}i", *values.shape) + np.ascontiguousarray(values, TENSOR_TYPES[kind]).tobytes()


def decode_tensor(raw: bytes) -> np.ndarray:
    """A tensor file: two marks of four bytes, version, element type, buffer type (1: 4-byte floats whatever the element type says), dimensions, sizes, data."""
    if raw[:8] != b"RSDNBUFF":
        raise ValueError("not a tensor file")
    _, kind, buffer, dims = struct.unpack_from("<4i", raw, 8)
    shape = struct.unpack_from(f"<{dims}i", raw, 24)
    element = "<f4" if buffer == 1 else TENSOR_TYPES[kind]
    return np.frombuffer(raw, element, int(np.prod(shape)), 24 + 4 * dims).reshape(shape)


def numbered_files(spark: SparkSession, path: str, ending: str = "") -> DataFrame:
    """``id, path, bytes`` of the files below ``path`` whose name starts with a number and ends in ``ending``; listed, not read."""
    name = F.element_at(F.split("path", "/"), -1)
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", F.col("length").alias("bytes"))
    return listed.where(name.endswith(ending) & name.rlike("^[0-9]+")).select(F.regexp_extract(name, "^([0-9]+)", 1).cast("long").alias("id"), "path", "bytes")


def read_tensors(spark: SparkSession, path: str) -> DataFrame:
    """``path, position, value``: every element of the tensor files below ``path`` with its place (one number per dimension)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, raw in zip(pdf["path"], pdf["content"]):
                flat = decode_tensor(raw)
                for lo in range(0, flat.size, 1 << 16):
                    part = flat.reshape(-1)[lo : lo + (1 << 16)]
                    place = np.stack(np.unravel_index(np.arange(lo, lo + len(part)), flat.shape), axis=1).astype(np.int32)
                    yield pd.DataFrame({"path": name, "position": list(place), "value": part.astype(np.float64)})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, position array<int>, value double")

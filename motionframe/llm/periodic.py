"""Periodic runs of words by a vectorised scan of all lags.

A text's words are numbered, and the array of numbers is compared with itself shifted by every lag up to ``n / min_exp``. A stretch of
equal places of one lag is a stretch of words with that period, as long as the lag and the places together, and no word next to it
extends it. Lags that are multiples of a run's smallest period find the same stretch again; the smallest lag names it.

Most texts are scanned where they are read. Those of more than ``LONG`` bytes become document-lag ranges of ``LAGS`` lags, which
Spark deals out to all machines; what the ranges find meets by document. Both ways give the same rows.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import Scratch, id_and_text, table

MIN_EXP, MIN_LENGTH = 4, 6
#: Bytes of text above which a document's lags are dealt out, lags in a range, compared places held at once, bytes of texts in a batch.
LONG, LAGS, BLOCK, BATCH = 1 << 16, 4096, 1 << 20, 8 << 20

Runs = np.ndarray  # rows of start, length, period
_RUNS = "array<struct<start: long, length: long, period: long>>"
_ARROW_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def numbered(words: list[bytes]) -> np.ndarray:
    seen: dict[bytes, int] = {}
    return np.array([seen.setdefault(w, len(seen)) for w in words], np.int32)


def scan(ids: np.ndarray, lo: int, hi: int, min_exp: int = MIN_EXP, min_length: int = MIN_LENGTH) -> Runs:
    """What lags ``lo`` to ``hi - 1`` (as far as the array allows) find, by lag: stretches that are long enough for their lag."""
    n, found = len(ids), [np.empty((0, 3), np.int64)]
    hi = min(hi, n // min_exp + 1)
    if lo >= hi:
        return found[0]
    shifted = np.lib.stride_tricks.sliding_window_view(np.concatenate([ids, np.full(hi, -1, np.int32)]), n)  # beyond the end nothing is equal
    block = max(1, BLOCK // n)
    for first in range(lo, hi, block):
        last = min(first + block, hi)
        same = shifted[first:last] == ids
        for lag, row in zip(range(first, last), same):
            need = max((min_exp - 1) * lag, min_length - lag)
            if np.count_nonzero(row) < need:
                continue
            turns = np.flatnonzero(np.diff(row.view(np.int8), prepend=0, append=0))
            starts, places = turns[::2], turns[1::2] - turns[::2]
            keep = places >= need
            if keep.any():
                found.append(np.column_stack([starts[keep], places[keep] + lag, np.full(keep.sum(), lag)]))
    return np.concatenate(found)


def smallest(runs: Runs) -> Runs:
    """Each stretch once, with its smallest period, by start and period."""
    runs = runs[np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0]))]
    first = np.ones(len(runs), bool)
    first[1:] = (runs[1:, :2] != runs[:-1, :2]).any(axis=1)
    runs = runs[first]
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def collapse(words: list[bytes], runs: Runs) -> bytes:
    """The words without those that a run contains after its first period."""
    depth = np.zeros(len(words) + 1, np.int64)
    np.add.at(depth, runs[:, 0] + runs[:, 2], 1)
    np.add.at(depth, runs[:, 0] + runs[:, 1], -1)
    covered = np.cumsum(depth[:-1]) > 0
    return b" ".join([w for w, gone in zip(words, covered.tolist()) if not gone]) if len(runs) else b" ".join(words)


Rewrite = Callable[[int | None, list[bytes]], list[bytes]]


def _batches(rows: Iterator[tuple[int | None, Runs, bytes]], with_text: bool) -> Iterator[pa.RecordBatch]:
    """Arrow batches of about ``BATCH`` bytes."""

    def batch(ids, runs, digests, texts):
        offsets = np.concatenate([[0], np.cumsum([len(r) for r in runs])]).astype(np.int32)
        flat = np.concatenate(runs)
        structs = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(flat[:, i])) for i in range(3)], fields=list(_ARROW_RUNS.value_type))
        columns = {"doc_id": pa.array(ids, pa.int64()), "runs": pa.ListArray.from_arrays(pa.array(offsets), structs), "collapsed_sha256": pa.array(digests, pa.string())}
        return pa.RecordBatch.from_pydict(columns | ({"collapsed": pa.array(texts, pa.binary()).cast(pa.string())} if with_text else {}))

    held, size = ([], [], [], []), 0
    for doc_id, runs, text in rows:
        for column, value in zip(held, (doc_id, runs, hashlib.sha256(text).hexdigest(), text if with_text else None)):
            column.append(value)
        size += len(held[3][-1] or b"") + runs.nbytes + 200
        if size > BATCH:
            yield batch(*held)
            held, size = ([], [], [], []), 0
    if held[0]:
        yield batch(*held)


def _columns(batch: pa.RecordBatch, *names: str) -> Iterator[tuple]:
    """The batch's rows, texts as bytes, a few at a time."""
    for lo in range(0, batch.num_rows, 100):
        part = batch.slice(lo, 100)
        yield from zip(*[(part[n].cast(pa.binary()) if pa.types.is_string(part[n].type) else part[n]).to_pylist() for n in names])


def find_runs(docs: DataFrame, min_exp: int = MIN_EXP, min_length: int = MIN_LENGTH, rewrite: Rewrite | None = None, with_text: bool = True, long: int = LONG, lags: int = LAGS) -> DataFrame:
    """``doc_id, runs, collapsed_sha256`` (and ``collapsed`` with ``with_text``), one row per input row.

    ``runs`` are by start and period; ``collapsed`` is the text's words without their repetitions, joined by a blank.

    A run is as long as ``min_length`` words and ``min_exp`` times its smallest period. ``rewrite`` gives other words for a document's. Null texts are
    empty, and a text without words has no runs and collapses to nothing. Repeated rows and null ids are scanned each. Extra columns are ignored;
    an empty table gives no rows.
    """
    texts = id_and_text(docs)
    schema = f"doc_id long, runs {_RUNS}, collapsed_sha256 string" + (", collapsed string" if with_text else "")

    def words_of(doc_id: int | None, text: bytes) -> list[bytes]:
        words = text.split()  # of bytes: at blanks and the five controls from tab on
        return rewrite(doc_id, words) if rewrite else words

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for batch in batches:
                for doc_id, text in _columns(batch, "doc_id", "text"):
                    words = words_of(doc_id, text)
                    runs = smallest(scan(numbered(words), 1, len(words), min_exp, min_length))
                    yield doc_id, runs, collapse(words, runs)

        return _batches(rows(), with_text)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for tag, doc_id, text in _columns(batch, "tag", "doc_id", "text"):
                words = words_of(doc_id, text)
                yield pa.RecordBatch.from_arrays([pa.array([tag], pa.int64()), pa.array([doc_id], pa.int64()), pa.array([len(words)], pa.int64()), pa.array([b" ".join(words)], pa.binary()).cast(pa.string())], names=["tag", "doc_id", "n", "words"])

    def ranged(group: pa.Table) -> pa.Table:
        tags, lows, texts = (group[c].to_pylist() for c in ("tag", "lo", "words"))
        found = [(tag, scan(numbered(text.encode().split()), lo, lo + lags, min_exp, min_length)) for tag, lo, text in zip(tags, lows, texts)]
        flat = np.concatenate([r for _, r in found])
        return pa.table({"tag": pa.array(np.repeat(np.array(tags, np.int64), [len(r) for _, r in found])), **{c: pa.array(np.ascontiguousarray(flat[:, i])) for i, c in enumerate(("start", "length", "period"))}})

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for batch in batches:
                for doc_id, text, found in _columns(batch, "doc_id", "words", "found"):
                    runs = np.array([(r["start"], r["length"], r["period"]) for r in found or []], np.int64).reshape(-1, 3)
                    yield doc_id, smallest(runs), collapse(text.split(), smallest(runs))

        return _batches(rows(), with_text)

    near = texts.where(F.octet_length("text") <= long).mapInArrow(whole, schema)
    scratch = Scratch(docs.sparkSession, "periodic")
    far = texts.where(F.octet_length("text") > long).withColumn("tag", F.monotonically_increasing_id())
    far = scratch.save("long", far.mapInArrow(split, "tag long, doc_id long, n long, words string"))
    if far.isEmpty():
        return near
    last = F.greatest(F.lit(1), F.floor(F.col("n") / F.lit(min_exp)))
    ranges = far.select("tag", "words", F.explode(F.sequence(F.lit(1).cast("long"), last, F.lit(lags).cast("long"))).alias("lo"))
    found = ranges.groupBy("tag", "lo").applyInArrow(ranged, "tag long, start long, length long, period long")
    found = found.groupBy("tag", "start", "length").agg(F.min("period").alias("period")).groupBy("tag").agg(F.collect_list(F.struct("start", "length", "period")).alias("found"))
    found = scratch.save("found", found)
    return near.union(far.join(found, "tag", "left").mapInArrow(joined, schema))


def planted(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The query's own repetitions: a tenth of the ids (by crc32 of the decimal id; never a null one) repeat a period up to their end."""
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if doc_id is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    period = words[a : a + p]
    return words[:a] + (period * -(-(n - a) // p))[: n - a]


def summary(found: DataFrame) -> DataFrame:
    """Digests of ``find_runs``' rows, and of each document the run with the greatest exponent: the first of equals by start, then period."""
    best = F.expr("aggregate(runs, cast(null AS struct<start: long, length: long, period: long>), (b, r) -> CASE WHEN b IS NULL OR r.length * b.period > b.length * r.period THEN r ELSE b END)")
    lines = F.array_join(F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))), "")
    rows = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(lines, 256).alias("runs_sha256"), "collapsed_sha256")
    exponent = F.expr("best.length * 1000 div best.period")
    return rows.select("doc_id", "n_runs", "best.start", "best.length", "best.period", exponent.alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary(find_runs(table(spark, sf_dir, "documents"), rewrite=planted, with_text=False))


#: The same rows as DuckDB SQL: all equal pairs of words up to a quarter of the text apart, and the islands of each lag.
ORACLE_SQL = r"""
    WITH c AS (SELECT doc_id, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda x: [ascii(x)::BIGINT, 0, 0, 0, 0, 0, 0, 0]))),
        lambda v, b: xor(xor(v, b) >> 1, 3988292384 * (xor(v, b) & 1)))) AS h FROM documents),
    d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
    g AS (SELECT doc_id, w, len(w) AS n, h % 10 = 0 AND len(w) > 0 AS planted, h // 10 AS g, (h // 10) % greatest(len(w), 1) AS a FROM d JOIN c USING (doc_id)),
    t AS (SELECT doc_id, n, planted, a, 1 + (n - a) // (3 + g % 8) AS p, unnest(w) AS w, unnest(range(n)) AS i FROM g),
    e AS (SELECT t.doc_id, t.n, t.i, s.w FROM t JOIN t AS s ON s.doc_id = t.doc_id AND s.i = CASE WHEN t.planted AND t.i >= t.a THEN t.a + (t.i - t.a) % t.p ELSE t.i END),
    q AS (SELECT l.doc_id, l.i, r.i - l.i AS q FROM e AS l JOIN e AS r ON l.doc_id = r.doc_id AND l.w = r.w AND r.i > l.i AND r.i - l.i <= l.n // 4),
    s AS (SELECT doc_id, q, i, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM q),
    f AS (SELECT doc_id, q, min(i) AS start, count(*) + q AS length FROM s GROUP BY doc_id, q, island HAVING count(*) + q >= greatest(6, 4 * q)),
    r AS (SELECT doc_id, start, length, min(q) AS period FROM f GROUP BY doc_id, start, length),
    k AS (SELECT e.doc_id, string_agg(w, ' ' ORDER BY i) AS kept FROM e WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.doc_id = e.doc_id AND e.i >= r.start + r.period AND e.i < r.start + r.length) GROUP BY e.doc_id),
    b AS (SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines FROM r GROUP BY doc_id),
    o AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY length::DOUBLE / period DESC, start, period) AS place FROM r)
    SELECT documents.doc_id, coalesce(n_runs, 0) AS n_runs, start, length, period, 1000 * length // period AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
    FROM documents LEFT JOIN b USING (doc_id) LEFT JOIN k USING (doc_id) LEFT JOIN o ON o.doc_id = documents.doc_id AND place = 1
"""

"""What a set of filters removes in every order: the trie of their permutations, walked depth first over persisted survivors.

A node of the trie is a prefix of an order. Which rows survive it depends on the set of its filters alone, so nodes of one set share one
state: its survivors are persisted when the walk first comes there, all edges out of it are counted on them, and every later
visit finds the state in the memo. The survivors of a state go when the walk leaves it, so at most one state per filter is held.
Texts are judged once; survivors carry the verdicts.
"""

from __future__ import annotations

import operator
from collections.abc import Iterator
from functools import reduce
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .spread import lookup
from .storage import Scratch, table

#: Orders are n! for n filters, so are the result's rows for each part. Parts that a task counts before it sends what it has.
MOST_FILTERS, MOST_PARTS = 6, 20_000


def _edges(batches: Iterator[pa.RecordBatch], n: int, marks: int, state: int) -> Iterator[pa.RecordBatch]:
    """What each task counts on its survivors of ``state``: ``part, filter, kept, removed, lost``, for each filter that is not in it."""
    filters = [i for i in range(n) if not state >> i & 1]
    counts: dict[str, np.ndarray] = {}  # by filter: kept, removed, and removed with each mark

    def told() -> pa.RecordBatch:
        parts, tables = list(counts), np.stack(list(counts.values())).reshape(-1, 2 + marks)
        lost = pa.ListArray.from_arrays(pa.array(np.arange(len(tables) + 1, dtype=np.int32) * marks), pa.array(tables[:, 2:].ravel()))
        columns = [pa.array([p for p in parts for _ in filters], pa.string()), pa.array(np.tile(np.array(filters, np.int32), len(parts))), pa.array(tables[:, 0].copy()), pa.array(tables[:, 1].copy()), lost]
        return pa.RecordBatch.from_arrays(columns, names=["part", "filter", "kept", "removed", "lost"])

    for batch in batches:
        codes = batch["part"].dictionary_encode()
        parts, code = codes.dictionary.to_pylist(), codes.indices.to_numpy(zero_copy_only=False)
        fails, marked = batch["fails"].to_numpy(), batch["marks"].to_numpy()
        table = np.zeros((len(parts), len(filters), 2 + marks), np.int64)
        for k, i in enumerate(filters):
            gone = (fails >> i & 1).astype(bool)
            table[:, k, 0], table[:, k, 1] = np.bincount(code[~gone], minlength=len(parts)), np.bincount(code[gone], minlength=len(parts))
            for m in range(marks):
                table[:, k, 2 + m] = np.bincount(code[gone & (marked >> m & 1).astype(bool)], minlength=len(parts))
        for part, counted in zip(parts, table):
            counts[part] = counts[part] + counted if part in counts else counted
        if len(counts) > MOST_PARTS:
            yield told()
            counts.clear()
    if counts:
        yield told()


def walk(judged: DataFrame, n: int, marks: int, scratch: Scratch) -> DataFrame:
    """``part, state, filter, kept, removed, lost``: the edges out of every state. ``judged`` has ``part``, and ``fails`` and ``marks`` as bits.

    Tasks count what they hold, and one shuffle at the end adds the counts of all states up.
    """
    memo: set[int] = set()
    full = (1 << n) - 1

    def visit(state: int, survivors: DataFrame) -> None:
        memo.add(state)
        alive = survivors.persist(StorageLevel.MEMORY_AND_DISK)
        scratch.save(f"edges/state={state}", alive.mapInArrow(lambda batches: _edges(batches, n, marks, state), "part string, filter int, kept long, removed long, lost array<long>"))
        for i in range(n):
            after = state | 1 << i
            if after not in memo and after != full:  # no edge leaves the full set
                visit(after, alive.where(F.col("fails").bitwiseAND(F.lit(1 << i)) == 0))
        alive.unpersist()

    visit(0, judged)
    edges = judged.sparkSession.read.schema("part string, filter int, kept long, removed long, lost array<long>, state int").parquet(f"{scratch.root}/edges")
    sums = [F.sum("kept").alias("kept"), F.sum("removed").alias("removed"), *[F.sum(F.col("lost")[m]).alias(f"lost_{m}") for m in range(marks)]]
    counted = scratch.save("counted", edges.groupBy("part", "state", "filter").agg(*sums))
    scratch.drop("edges")
    return counted


def audit(judged: DataFrame, filters: dict[str, str], marks: dict[str, str], part: str, scratch: Scratch) -> DataFrame:
    """``part, filter_order, step, kept, removed, redundant, unique_fails, <mark>_lost.., shapley``: a row per part, order of ``filters`` and step.

    ``filters`` says when a row fails, ``marks`` which rows are asked after, as SQL conditions; null is no, and a null ``part`` is the empty string. A part has all its
    rows, zeros included. ``shapley`` is what the step's filter removes, summed over all orders. An empty table gives no rows.
    """
    if not 1 <= len(filters) <= MOST_FILTERS:
        raise ValueError(f"1 to {MOST_FILTERS} filters have an audit")
    names, n = list(filters), len(filters)
    sure = lambda c: F.coalesce(F.expr(c), F.lit(False))
    bits = lambda conditions: reduce(operator.add, [F.when(sure(c), 1 << i).otherwise(0) for i, c in enumerate(conditions)], F.lit(0))
    verdicts = judged.select(F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), bits(filters.values()).alias("fails"), bits(marks.values()).alias("marks"))
    edges = walk(scratch.save("verdicts", verdicts), n, len(marks), scratch)
    size = F.bit_count("state")
    orders_through = F.element_at(F.array(*[F.lit(factorial(k) * factorial(n - 1 - k)) for k in range(n)]), (size + 1).cast("int"))
    alone = F.expr(f"state = {(1 << n) - 1} - shiftleft(1, `filter`)")
    of = lambda c: F.sum(F.when(c, F.col("removed")).otherwise(F.lit(0)))
    totals = edges.groupBy("part", "filter").agg(of(F.col("state") == 0).alias("fails"), of(alone).alias("unique_fails"), F.sum(F.col("removed") * orders_through).alias("shapley"))
    values = F.struct("kept", "removed", *[f"lost_{m}" for m in range(len(marks))])
    known = edges.groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct(F.col("state") * n + F.col("filter"), values))).alias("at"))  # n * 2**(n-1) edges at most
    steps = [("".join(names[i] for i in p), k + 1, i, sum(1 << j for j in p[:k]) * n + i) for p in permutations(range(n)) for k, i in enumerate(p)]
    orders = judged.sparkSession.createDataFrame(steps, "filter_order string, step int, filter int, edge int")  # n! * n rows
    rows = totals.join(known, "part").join(F.broadcast(orders), "filter").withColumn("v", F.col("at")[F.col("edge")])
    zero = lambda c: F.coalesce(F.col(f"v.{c}"), F.lit(0).cast("long"))
    return rows.select(
        "part", "filter_order", "step", zero("kept").alias("kept"), zero("removed").alias("removed"), (F.col("fails") - zero("removed")).alias("redundant"), "unique_fails",
        *[zero(f"lost_{i}").alias(f"{m}_lost") for i, m in enumerate(marks)], "shapley",
    )


_CAPITALS, _SPACE, _MARKS = "[^A-Z]+", r"[\x20\x09-\x0D]+", "[#$%&*|]"
FILTERS = {"A": "n_words < 200", "B": "100 * n_distinct < 50 * n_words", "C": "100 * n_capitals > 2 * n_chars", "D": "has_mark", "E": "doc_id > first_id"}
FLAGS = {"good": "good", "toxic": "toxic"}


def measured(docs: DataFrame, labels: DataFrame, scratch: Scratch) -> DataFrame:
    """``doc_id, source, n_words, n_distinct, n_capitals, n_chars, has_mark, first_id, good, toxic``: what ``FILTERS`` and the marks are told by.

    ``first_id`` is the smallest doc_id with the same text, null for a text that only one row has; a null doc_id is neither smaller nor larger
    than another. Null texts are empty. A document is good or toxic if any label of its id says so.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    words = F.array_remove(F.split(text, _SPACE), "")
    read = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("sha"),
        F.size(words).cast("long").alias("n_words"), F.size(F.array_distinct(words)).cast("long").alias("n_distinct"),
        F.char_length(F.regexp_replace(text, _CAPITALS, "")).cast("long").alias("n_capitals"), F.char_length(text).cast("long").alias("n_chars"), F.rlike(text, F.lit(_MARKS)).alias("has_mark"),
    )
    rows = scratch.save("read", read)
    n = rows.count()
    firsts = rows.groupBy("sha").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("copies")).where(F.col("copies") > 1)
    rows = scratch.save("placed", lookup(rows, firsts, "sha", "copies", n).drop("sha", "copies"))
    scratch.drop("read")
    told = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    told = told.join(rows.groupBy("doc_id").agg(F.count("*").alias("with_id")), "doc_id")
    return lookup(rows, told, "doc_id", "with_id", n).drop("with_id")


def audit_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``audit`` of the five ``FILTERS`` by source: short, repetitive, capitals, marks, copies of a smaller doc_id. Extra columns are ignored."""
    scratch = Scratch(docs.sparkSession, "audit")
    rows = audit(measured(docs, labels, scratch), FILTERS, FLAGS, "source", scratch)
    scratch.drop("placed", "verdicts")
    return rows


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


ORACLE_SQL = r"""
    WITH RECURSIVE told AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
    d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
    v AS (SELECT part, (len(w) < 200)::INT + 2 * (100 * len(list_distinct(w)) < 50 * len(w))::INT + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t))::INT
        + 8 * regexp_matches(t, '[#$%&*|]')::INT + 16 * coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false)::INT AS fails, coalesce(good, false)::INT AS good, coalesce(toxic, false)::INT AS toxic
      FROM d LEFT JOIN told USING (doc_id)),
    m AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM v GROUP BY part, fails),
    letters AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) AS l(letter, bit)),
    prefixes AS (SELECT '' AS p, 0 AS used UNION ALL SELECT p || letter, used + bit FROM prefixes JOIN letters ON used & bit = 0),
    steps AS (SELECT o.p AS filter_order, length(q.p) + 1 AS step, q.used AS before, bit FROM prefixes o JOIN prefixes q ON length(q.p) < 5 AND starts_with(o.p, q.p) JOIN letters ON letter = substr(o.p, length(q.p) + 1, 1) WHERE length(o.p) = 5),
    r AS (SELECT part, filter_order, step, bit, sum(CASE WHEN fails & (before | bit) = 0 THEN n ELSE 0 END) AS kept, sum(CASE WHEN fails & before = 0 AND fails & bit > 0 THEN n ELSE 0 END) AS removed,
        sum(CASE WHEN fails & before > 0 AND fails & bit > 0 THEN n ELSE 0 END) AS redundant, sum(CASE WHEN fails = bit THEN n ELSE 0 END) AS unique_fails,
        sum(CASE WHEN fails & before = 0 AND fails & bit > 0 THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN fails & before = 0 AND fails & bit > 0 THEN toxic ELSE 0 END) AS toxic_lost
      FROM m CROSS JOIN steps GROUP BY part, filter_order, step, bit)
    SELECT part, filter_order, CAST(step AS INT) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
      CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley FROM r
"""

"""Best-fit packing of token pieces into sequences by minimum bin slack.

The packer sees only how many pieces there are of each length, a table of at
most ``capacity`` rows however large the corpus is. For one bin it takes the longest
piece left and lets a bitset subset-sum over the available lengths find the
combination that leaves the least slack; that combination is taken out as
often as it can be. Spark then ranks the pieces of each length and reads each
piece's place off the resulting intervals.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import bpe
from .storage import Scratch, id_and_text, table

CAPACITY = 2048
END = 0


def fullest(counts: dict[int, int], room: int) -> dict[int, int]:
    """Lengths (with multiplicity, within ``counts``) whose sum is the largest possible one up to ``room``.

    Bit s of the bitset says that some combination sums to s. Longer lengths are tried first and the search
    ends as soon as ``room`` itself is reachable.
    """
    mask, reach, steps = (1 << room + 1) - 1, 1, []
    for length in sorted((x for x in counts if x <= room), reverse=True):
        left, take = min(counts[length], room // length), 1
        while left and not reach >> room & 1:
            n = min(take, left)
            grown = (reach | reach << n * length) & mask
            if grown != reach:
                steps.append((length, n, reach))
                reach = grown
            left -= n
            take *= 2
        if reach >> room & 1:
            break
    total, chosen = reach.bit_length() - 1, {}
    for length, n, before in reversed(steps):
        if not before >> total & 1:
            total -= n * length
            chosen[length] = chosen.get(length, 0) + n
    return chosen


def minimum_bin_slack(counts: dict[int, int], capacity: int) -> list[tuple[int, dict[int, int]]]:
    """``(how many bins, {length: pieces in each})`` until no piece is left."""
    left, plan = {k: v for k, v in counts.items() if v}, []
    while left:
        longest = max(left)
        rest = dict(left)
        rest[longest] -= 1
        combination = fullest({k: v for k, v in rest.items() if v}, capacity - longest)
        combination[longest] = combination.get(longest, 0) + 1
        bins = min(left[k] // n for k, n in combination.items())
        plan.append((bins, combination))
        for k, n in combination.items():
            left[k] -= n * bins
            if not left[k]:
                del left[k]
    return plan


def placements(plan: list[tuple[int, dict[int, int]]]) -> dict[int, np.ndarray]:
    """For each length the intervals of its pieces' ranks: rows of first rank, pieces per bin, first bin, offset in the bin."""
    out: dict[int, list] = {}
    used: dict[int, int] = {}
    first_bin = 0
    for bins, combination in plan:
        offset = 0
        for length in sorted(combination, reverse=True):
            n = combination[length]
            out.setdefault(length, []).append((used.get(length, 0), n, first_bin, offset))
            used[length] = used.get(length, 0) + n * bins
            offset += n * length
        first_bin += bins
    return {k: np.array(v, dtype=np.int64) for k, v in out.items()}


def token_pieces(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, task, nth``: every document cut into pieces of at most ``capacity`` tokens.

    ``nth`` counts the pieces of one length within the task that wrote them. A longer document's first piece takes
    the remainder, so that all its other pieces are full. Map-only.
    """
    path = vocabulary or bpe.default_vocabulary()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import tiktoken

        coder = bpe.codec(path, encoder=False)
        ranked = tiktoken.Encoding("ranks", pat_str=bpe.WORD, mergeable_ranks=coder.vocabulary.id_of, special_tokens={})
        special, task, seen = coder.special, TaskContext.get().partitionId(), {}
        for batch in batches:
            out = []
            for doc_id, text in zip(batch["doc_id"], batch["text"]):
                if special is not None and special.search(text):
                    parts = [np.array([coder.vocabulary.special[p]] if i % 2 else ranked.encode_ordinary(p), dtype="<u4") for i, p in enumerate(special.split(text))]
                    ids = np.concatenate([*parts, [END]]).astype("<u4")
                else:
                    ids = np.append(ranked.encode_to_numpy(text, disallowed_special=()), END).astype("<u4")
                n = len(ids)
                start, end, piece = 0, n % capacity or min(capacity, n), 0
                while start < n:
                    length = end - start
                    out.append((doc_id, piece, start, length, zlib.crc32(ids[start:end].tobytes()), task, seen.get(length, 0)))
                    seen[length] = seen.get(length, 0) + 1
                    start, end, piece = end, end + capacity, piece + 1
            yield pd.DataFrame(out, columns=["doc_id", "piece", "start", "length", "ids_crc32", "task", "nth"]).astype({"doc_id": "Int64"})

    return id_and_text(docs).mapInPandas(run, "doc_id long, piece int, start long, length long, ids_crc32 long, task int, nth long")


def pack_documents(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset``: each piece's place; sequences have no gaps and start at 0.

    A null or empty text is the end token alone; repeated rows are packed each; extra columns are ignored;
    an empty table gives no rows. Ties: pieces of equal length take their places by task and order of reading.
    What reaches the driver is the count per length (at most ``capacity`` rows). Ranks within a length come from
    counts per (task, length), so a length that very many pieces share is never gathered.
    """
    scratch = Scratch(docs.sparkSession, "packing")
    pieces = scratch.save("pieces", token_pieces(docs, vocabulary, capacity))
    per_task = pieces.groupBy("length", "task").agg(F.count("*").alias("n"))
    counts = {r["length"]: r["n"] for r in per_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    where = placements(minimum_bin_slack(counts, capacity))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    firsts = per_task.select("length", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ranks_before"))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sequence, offset = np.zeros(len(batch), np.int64), np.zeros(len(batch), np.int64)
            rank, lengths = batch.pop("rank").to_numpy(), batch["length"].to_numpy()
            order = np.argsort(lengths, kind="stable")
            cuts = np.flatnonzero(np.diff(lengths[order])) + 1
            for at in np.split(order, cuts) if len(order) else ():
                length = int(lengths[at[0]])
                rows = where[length]
                r = rank[at]
                first, per_bin, first_bin, base = rows[np.searchsorted(rows[:, 0], r, side="right") - 1].T
                sequence[at] = first_bin + (r - first) // per_bin
                offset[at] = base + (r - first) % per_bin * length
            yield batch.assign(sequence_id=sequence, offset=offset)

    ranked = pieces.join(firsts, ["length", "task"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("nth") + F.col("ranks_before")).alias("rank"))
    rows = ranked.mapInPandas(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
    rows = scratch.save("rows", rows)
    scratch.drop_all_but("rows")
    return rows


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))

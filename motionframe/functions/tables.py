"""Table functions for SQL: persistence of a partition's samples, key pairs of a series."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from ..operators.cluster import events_of, persistence


class KeyPairs:
    """``key_pairs(values, neighbour)``: the pairs of persistent events of a series, ``neighbour`` apart at least. A null series has none; missing samples are no events."""

    def eval(self, values: list, neighbour: int) -> Iterator[tuple[int, int]]:
        if values is None or any(v is None or v != v for v in values):
            return
        events = events_of(np.asarray(values, np.float64))
        for i, a in enumerate(events):
            for b in events[i + 1 :]:
                if b - a >= neighbour:
                    yield a, b


class PersistencePairs:
    """``persistence_pairs(TABLE(key, pos, x) PARTITION BY key ORDER BY pos)``: each partition's paired extrema. Rows without a sample are left out."""

    def __init__(self):
        self.key, self.places, self.samples = None, [], []

    def eval(self, row) -> None:
        self.key = row[0]
        if row[2] is not None and row[2] == row[2]:
            self.places.append(row[1])
            self.samples.append(row[2])

    def terminate(self) -> Iterator[tuple[int, int, int, float]]:
        for low, high, height in persistence(np.asarray(self.samples, np.float64)):
            yield self.key, self.places[low], self.places[high], float(height)


def register(spark: SparkSession) -> None:
    """Name both for the SQL of this session."""
    spark.udtf.register("key_pairs", udtf(KeyPairs, returnType="a: int, b: int"))
    spark.udtf.register("persistence_pairs", udtf(PersistencePairs, returnType="key: bigint, minimum: int, maximum: int, persistence: double"))

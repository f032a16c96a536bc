"""Joins that one key with a third of all rows does not pile up in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is common when more rows than this, and than an ``MOST``-th of all rows, have it; so there are ``MOST`` common keys at most.
LEAST, MOST = 100, 10_000


def lookup(rows: DataFrame, groups: DataFrame, key: str, size: str, n_rows: int) -> DataFrame:
    """``rows`` left joined to ``groups``, which has one row per non-null ``key`` and in ``size`` how many of the ``n_rows`` rows have it.

    Rows of common keys stay where they are: their groups, at most ``MOST`` by the arithmetic above, are broadcast. So do rows without
    a key, which match nothing. The others are shuffled, and no key brings a task more than a ``MOST``-th of the rows (or ``LEAST``).
    """
    share = max(LEAST, n_rows // MOST)
    told = rows.join(F.broadcast(groups.where(F.col(size) > share)), key, "left")
    still = F.col(size).isNull() & F.col(key).isNotNull()
    rest = told.where(still).select(*rows.columns).join(groups.where(F.col(size) <= share), key, "left")
    return told.where(~still).unionByName(rest)

"""Tables of the engine, how missing values come in, and how the test tables stand in for recordings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, IntegerType, LongType, StringType, StructField, StructType


def _table(*fields: tuple[str, object]) -> StructType:
    return StructType([StructField(name, kind) for name, kind in fields])


FRAMES = _table(("seq_id", LongType()), ("frame", IntegerType()), ("t", DoubleType()), ("joint_id", IntegerType()), ("x", DoubleType()), ("y", DoubleType()), ("z", DoubleType()), ("label", IntegerType()))
EVENTS = _table(("seq_id", LongType()), ("t", DoubleType()), ("event_id", IntegerType()))
SKELETON = _table(("joint_id", IntegerType()), ("name", StringType()), ("parent_id", IntegerType()), ("is_root", BooleanType()))

#: Fields of a frame pair as a model has them, candidates of the search, class qualities of pairs of offsets and the chosen pairs.
FIELDS = _table(("pair", IntegerType()), ("field", IntegerType()), ("indices", ArrayType(IntegerType())), ("factors", ArrayType(DoubleType())), ("sparsity", DoubleType()), ("split", DoubleType()), ("quality", DoubleType()))
FIELD_CANDIDATES = _table(("a", IntegerType()), ("b", IntegerType()), ("branch", IntegerType()), ("indices", ArrayType(IntegerType())), ("factors", ArrayType(DoubleType())), ("sparsity", DoubleType()), ("split", DoubleType()), ("quality", DoubleType()))
PAIR_QUALITIES = _table(("channel", IntegerType()), ("a", IntegerType()), ("b", IntegerType()), ("l1", IntegerType()), ("l2", IntegerType()), ("quality", DoubleType()))
MINED_PAIRS = _table(("channel", IntegerType()), ("a", IntegerType()), ("b", IntegerType()), ("total", DoubleType()))

#: Event names in cycle order: 1, 2, .. ; the last one is followed by the first.
CYCLE_EVENTS = ("click", "view", "purchase", "signup", "error")


def null_if_nan(c: Column) -> Column:
    """NaN marks a missing value in recordings; here a missing value is NULL."""
    return F.when(~F.isnan(c), c)


def missing_point(x: Column, y: Column, z: Column) -> Column:
    """A point is missing when all its components are."""
    return x.isNull() & y.isNull() & z.isNull()


def require(df: DataFrame, *columns: str) -> DataFrame:
    """``df`` itself; an error that names the columns it lacks."""
    lacking = [c for c in columns if c not in df.columns]
    if lacking:
        raise ValueError(f"missing columns: {', '.join(lacking)}")
    return df


def millis(ts: Column) -> Column:
    """Milliseconds since 1970 of a timestamp without time zone, in any session time zone."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts.cast("timestamp_ntz")) / F.lit(1000.0)


def trajectories(events: DataFrame) -> DataFrame:
    """``seq_id, event_id, t, v``: each user's values over time, missing at errors."""
    return events.select(F.col("user_id").alias("seq_id"), "event_id", millis(F.col("ts")).alias("t"), F.when(F.col("event_type") != "error", F.col("value")).alias("v"))


def markers(events: DataFrame) -> DataFrame:
    """``seq_id, event_id, t, v, mark``: each user's events numbered by their place in the cycle."""
    number = F.array_position(F.array(*map(F.lit, CYCLE_EVENTS)), F.col("event_type")).cast("int")
    return events.select(F.col("user_id").alias("seq_id"), "event_id", millis(F.col("ts")).alias("t"), F.col("value").alias("v"), number.alias("mark"))


def components(embeddings: DataFrame) -> DataFrame:
    """``vec_id, label, pos, x``: the samples of each series, positions from 0."""
    return embeddings.select("vec_id", "label", F.posexplode(F.transform("embedding", lambda x: x.cast("double"))).alias("pos", "x"))

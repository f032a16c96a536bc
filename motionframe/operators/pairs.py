"""Pairs of instants: extrema, supports, allocation, and features of pairs."""

from __future__ import annotations

from itertools import combinations
from math import comb

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def local_extrema(points: DataFrame, by: list[str], pos: str, x: str) -> DataFrame:
    """``by, pos, x, kind``: inner points larger (``max``) or smaller (``min``) than both neighbours."""
    order = Window.partitionBy(*by).orderBy(pos)
    near = points.withColumn("_a", F.lag(x).over(order)).withColumn("_b", F.lead(x).over(order))
    kind = F.when((F.col(x) > F.col("_a")) & (F.col(x) > F.col("_b")), "max").when((F.col(x) < F.col("_a")) & (F.col(x) < F.col("_b")), "min")
    return near.withColumn("kind", kind).where(F.col("kind").isNotNull()).select(*by, pos, x, "kind")


def pair_support(extrema: DataFrame, by: list[str], pos: str, least_gap: int, keep: list[str] = ()) -> DataFrame:
    """``keep, a, b, support``: in how many series both positions (at least ``least_gap`` apart) are extrema.

    Each series' positions are gathered (their number is the series' length at most) and paired inside the row, so nothing is joined.
    """
    held = extrema.groupBy(*by).agg(F.array_sort(F.collect_list(pos)).alias("p"))
    pairs = held.select(*keep, "p", F.explode("p").alias("a")).select(*keep, "a", F.explode(F.filter("p", lambda b: b >= F.col("a") + least_gap)).alias("b"))
    return pairs.groupBy(*keep, "a", "b").agg(F.count("*").alias("support"))


def endpoint_support(pairs: DataFrame) -> DataFrame:
    """``pos, pairs, mean_support`` over the pairs that each position ends."""
    return pairs.select(F.explode(F.array("a", "b")).alias("pos"), "support").groupBy("pos").agg(F.count("*").alias("pairs"), F.avg("support").alias("mean_support"))


def friend_counts(pairs: DataFrame) -> DataFrame:
    """``a, b, friends``: how many other pairs share an endpoint; counted from the endpoints' degrees, without joining pairs to pairs."""
    degree = pairs.select(F.explode(F.array("a", "b")).alias("pos")).groupBy("pos").agg(F.count("*").alias("d"))
    left, right = degree.select(F.col("pos").alias("a"), F.col("d").alias("da")), degree.select(F.col("pos").alias("b"), F.col("d").alias("db"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", (F.col("da") + F.col("db") - 2).alias("friends"))


def friends(pairs: DataFrame) -> DataFrame:
    """``a, b, c, d``: the other pairs ``c, d`` that share an endpoint with the pair ``a, b``, each once.

    Pairs of positions are at most half the square of a series' length, however many series there are, and so are their endpoints' lists.
    """
    ends = pairs.select("a", "b", F.explode(F.array("a", "b")).alias("_end"))
    other = ends.select(F.col("a").alias("c"), F.col("b").alias("d"), "_end")
    return ends.join(other, "_end").where((F.col("a") != F.col("c")) | (F.col("b") != F.col("d"))).select("a", "b", "c", "d").distinct()


def allocate(groups: DataFrame, weight: str, budget: int) -> DataFrame:
    """``share``: the budget in proportion to ``weight``, rounded half up."""
    total = groups.agg(F.sum(weight).alias("_total"))
    return groups.join(F.broadcast(total)).withColumn("share", F.floor(F.col(weight) / F.nullif(F.col("_total"), F.lit(0.0)) * budget + 0.5).cast("long")).drop("_total")  # one row


def top_by_share(rows: DataFrame, groups: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """Each group's first ``share`` rows in ``order``, with their ``rank``."""
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    return ranked.join(groups.select(*by, "share"), by).where(F.col("rank") <= F.col("share")).drop("share")


def offset_grid(spark, radius: int) -> DataFrame:
    """``a, b, kind``: all pairs of distinct offsets from -radius to radius; left if none is after the centre, right if none before it, else all."""
    grid = spark.range(-radius, radius + 1).select(F.col("id").cast("int").alias("a"))
    pairs = grid.select("a", F.explode(F.sequence(F.col("a") + 1, F.lit(radius + 1))).alias("b")).where(F.col("b") <= radius)
    return pairs.withColumn("kind", F.when(F.col("b") <= 0, "left").when(F.col("a") >= 0, "right").otherwise("all"))


def offset_support(events: DataFrame, by: list[str], pos: str, radius: int, length: int) -> DataFrame:
    """``a, b, support``: at how many places (0 to ``length`` - 1) of the series the positions ``a`` and ``b`` off, at most ``radius`` away, both have an event.

    A series has fewer events than samples, so its list is short; each event meets only those within twice the radius.
    """
    held = events.groupBy(*by).agg(F.array_sort(F.collect_set(pos)).alias("_p"))
    first = held.select(*by, "_p", F.explode("_p").alias("_x"))
    both = first.select("_x", F.explode(F.filter("_p", lambda y: (y > F.col("_x")) & (y - F.col("_x") <= 2 * radius))).alias("_y"))
    at = both.withColumn("_at", F.explode(F.filter(F.sequence(F.col("_y") - radius, F.col("_x") + radius), lambda p: (p >= 0) & (p < length))))
    return at.groupBy((F.col("_x") - F.col("_at")).cast("int").alias("a"), (F.col("_y") - F.col("_at")).cast("int").alias("b")).agg(F.count("*").alias("support"))


def apply_fields(frames: DataFrame, keys: list[str], left: Column, right: Column, fields: list[tuple[int, list[int], list[float]]]) -> DataFrame:
    """``keys, field, feature``: for each field the factors' sum of left less right at its indices; not a number or infinite becomes 0."""
    one = lambda i, at, by: F.struct(F.lit(i).alias("field"), sum((F.get(left, F.lit(k)).cast("double") - F.get(right, F.lit(k)).cast("double")) * F.lit(f) for k, f in zip(at, by)).alias("feature"))
    rows = frames.select(*keys, F.explode(F.array(*[one(*f) for f in fields])).alias("f"))
    value = F.col("f.feature")
    return rows.select(*keys, F.col("f.field").alias("field"), F.when(F.isnan(value) | (F.abs(value) == float("inf")) | value.isNull(), F.lit(0.0)).otherwise(value).alias("feature"))


#: Sets of shared indices that a candidate is posted under at most.
SETS = 64


def _best_of_sets(candidates: DataFrame, by: list[str], key: str, indices: str, quality: str, size: int, need: int) -> DataFrame:
    """``drop_similar`` where all candidates have ``size`` indices and similar ones share ``need`` of them."""
    at = lambda k: F.get("_ix", F.lit(k))
    sets = F.array(*[F.array(*[at(k) for k in some]) for some in combinations(range(size), need)])
    ranked = candidates.where(F.col(quality).isNotNull() & (F.size(indices) > 0)).select(*by, key, quality, F.array_sort(indices).alias("_ix"))
    posted = ranked.select(*by, key, quality, F.explode(sets).alias("_set"))
    first = F.struct(F.when(F.isnan(quality), 0).otherwise(1), -F.col(quality), F.col(key))  # a quality that is no number is above all others
    held = posted.groupBy(*by, "_set").agg(F.min_by(key, first).alias("_k"))
    beaten = posted.join(held, [*by, "_set"]).where(F.col(key) != F.col("_k"))
    return candidates.join(beaten.select(*by, key).distinct(), [*by, key], "left_anti")


def drop_similar(candidates: DataFrame, by: list[str], key: str, indices: str, quality: str, limit: float = 0.25) -> DataFrame:
    """Candidates to which no better one of their group is similar: shared indices over the larger set above ``limit``. Ties: the smaller key is better.

    Indices of a candidate are distinct. A candidate is posted under its rarest indices only, so many that whoever is similar to it has one of them posted, too; an
    index that most candidates have brings none of them together. Those that meet are compared whole.

    Where all candidates have one number of indices, and few sets of as many as similar ones share, no pairs are made at all: a candidate goes if any such
    set of its own has a better one, and each set's best is one aggregate.
    """
    sizes = candidates.where(F.size(indices) > 0).agg(F.min(F.size(indices)).alias("least"), F.max(F.size(indices)).alias("most")).first()
    if sizes["least"] is not None and sizes["least"] == sizes["most"]:
        need = int(sizes["most"] * limit + 1e-9) + 1
        if need > sizes["most"]:
            return candidates
        if comb(sizes["most"], need) <= SETS:
            return _best_of_sets(candidates, by, key, indices, quality, sizes["most"], need)
    sized = candidates.select(*by, key, quality, F.col(indices).alias("_ix"), F.size(indices).alias("_n"))
    each = sized.select(*by, key, "_n", F.explode("_ix").alias("_i"))
    spread = each.groupBy(*by, "_i").agg(F.count("*").alias("_df"))
    rare = Window.partitionBy(*by, key).orderBy("_df", "_i")
    least = F.floor(F.col("_n") * F.lit(limit) + F.lit(1e-9)) + 1  # indices that it shares with any that is similar to it
    posted = each.join(spread, [*by, "_i"]).withColumn("_r", F.row_number().over(rare)).where((F.col("_r") <= F.col("_n") - least + 1) & (F.col("_df") > 1)).select(*by, "_i", key)
    met = posted.join(posted.withColumnRenamed(key, "_k"), [*by, "_i"]).where(F.col(key) != F.col("_k")).select(*by, key, "_k").distinct()
    other = sized.select(*by, F.col(key).alias("_k"), F.col(quality).alias("_q"), F.col("_ix").alias("_jx"), F.col("_n").alias("_m"))
    better = (F.col("_q") > F.col(quality)) | ((F.col("_q") == F.col(quality)) & (F.col("_k") < F.col(key)))
    beaten = met.join(sized, [*by, key]).join(other, [*by, "_k"]).where(better & (F.size(F.array_intersect("_ix", "_jx")) / F.greatest("_n", "_m") > limit))
    return candidates.join(beaten.select(*by, key).distinct(), [*by, key], "left_anti")


def by_index(indices: Column, factors: Column) -> Column:
    """Factors and their indices in the order of the indices, as structs ``index, factor``."""
    return F.array_sort(F.zip_with(indices, factors, lambda i, f: F.struct(i.alias("index"), f.alias("factor"))))


def logistic(c: Column) -> Column:
    return 1 / (1 + F.exp(-c))


def batch(rows: DataFrame, number: str, first: int, last: int) -> DataFrame:
    """The rows numbered ``first`` up to, not including, ``last``; a negative ``last`` is no bound."""
    return rows.where((F.col(number) >= first) & ((F.col(number) < last) | F.lit(last < 0)))


def frame_pairs(left: DataFrame, right: DataFrame, key: str, values: str) -> DataFrame:
    """``key, left, right``: two frame slices of the same sequences side by side."""
    return left.select(key, F.col(values).alias("left")).join(right.select(key, F.col(values).alias("right")), key)


def apply_field_table(frames: DataFrame, keys: list[str], fields: DataFrame) -> DataFrame:
    """``keys, pair, field, feature``: every frame pair's linear features. ``frames``: ``keys, pair, left, right``; ``fields``: ``pair, field, indices, factors``.

    A pair's fields meet its frames by an equality join. What is not a number or infinite counts as 0.
    """
    apart = F.zip_with("indices", "factors", lambda i, f: (F.get("left", i.cast("int")).cast("double") - F.get("right", i.cast("int")).cast("double")) * f)
    value = F.aggregate(apart, F.lit(0.0), lambda s, x: s + x)
    rows = frames.join(fields, "pair").select(*keys, "pair", "field", value.alias("feature"))
    bad = F.isnan("feature") | (F.abs("feature") == float("inf")) | F.col("feature").isNull()
    return rows.withColumn("feature", F.when(bad, F.lit(0.0)).otherwise(F.col("feature")))


def reduce_candidates(candidates: DataFrame, key: str, a: str, b: str, indices: str, quality: str, share: float, limit: float = 0.25) -> DataFrame:
    """Candidate fields of frame pairs in two passes: similar ones of the same pair, then similar ones of pairs that share an endpoint; last a quality floor.

    The second pass looks only at what the first one left. ``share`` of the best quality is the floor.
    """
    own = drop_similar(candidates, [a, b], key, indices, quality, limit)
    ends = own.withColumn("_end", F.explode(F.array_distinct(F.array(a, b))))
    held = drop_similar(ends, ["_end"], key, indices, quality, limit)
    beaten = ends.select(key, "_end").join(held.select(key, "_end"), [key, "_end"], "left_anti").select(key).distinct()
    left = own.join(beaten, key, "left_anti")
    best = left.agg(F.max(quality).alias("_best"))
    return left.join(F.broadcast(best)).where(F.col(quality) >= F.col("_best") * share).drop("_best")  # one row


def heat_map(candidates: DataFrame, a: str, b: str, indices: str) -> DataFrame:
    """``frame, channel, n``: how many fields look at a channel at a frame."""
    return candidates.select(F.explode(F.array(a, b)).alias("frame"), indices).select("frame", F.explode(indices).alias("channel")).groupBy("frame", "channel").agg(F.count("*").alias("n"))

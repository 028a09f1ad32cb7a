"""Exponentially decayed count, sum, mean and rate; decayed top-k; samples biased to the recent.

Every weight is the exponential of an age that is never negative, so nothing overflows, whatever the times.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..params import DecayParams, ReservoirParams


def _weights(df: DataFrame, params: DecayParams, keys: list[str], slice_of: int, what: Column) -> DataFrame:
    """Per slice of time, the sums decayed to the slice's last time: they merge by one factor."""
    sliced = df.withColumn("slice", F.call_function("div", F.col("t"), F.lit(slice_of)))
    end = (F.col("slice") + 1) * slice_of
    weight = F.exp((F.col("t") - end) * params.rate)
    return sliced.groupBy(*keys, "slice").agg(F.sum(weight).alias("c"), F.sum(weight * what).alias("s"), F.max("t").alias("last_t"))


def decayed(df: DataFrame, params: DecayParams, at: int | None = None, keys: tuple[str, ...] = ("grp",), value: str = "value") -> DataFrame:
    """``keys``, now, count, sum, mean and rate, decayed to ``at`` or to the group's last time.

    A group's events are summed by slices of a half-life before the shuffle.  ``at`` before a group's last time is an error.
    """
    slice_of = max(int(params.half_life), 1)
    parts = _weights(df, params, list(keys), slice_of, F.col(value))
    last = F.max("last_t").over(Window.partitionBy(*keys))
    now = last if at is None else F.when(last <= at, F.lit(at)).otherwise(F.raise_error(F.lit("a query before the last event")).cast("long"))
    factor = F.exp(((F.col("slice") + 1) * slice_of - F.col("now")) * params.rate)
    found = parts.withColumn("now", now).groupBy(*keys).agg(F.max("now").alias("now"), F.sum(F.col("c") * factor).alias("count"), F.sum(F.col("s") * factor).alias("sum"))
    # the mean doesn't depend on the time: both sums fade alike; when both have faded to 0 it is 0 as for no events
    return found.select("*", F.when(F.col("count") > 0, F.col("sum") / F.col("count")).otherwise(0.0).alias("mean"), (F.col("count") * params.rate).alias("rate"))


def decayed_top(df: DataFrame, params: DecayParams, k: int, at: int) -> DataFrame:
    """grp, rank, key, score: each group's k keys of the largest decayed weight at ``at``; ties to the smaller key."""
    scored = df.groupBy("grp", "key").agg(F.sum(F.col("weight") * F.exp((F.col("t") - at) * params.rate)).alias("score"))
    rank = F.row_number().over(Window.partitionBy("grp").orderBy(F.desc(F.round("score", 9)), "key"))
    return scored.withColumn("rank", rank).filter(F.col("rank") <= k).select("grp", "rank", "key", "score")


def hashed_uniform(seed: int, *parts: Column) -> Column:
    """In (0, 1), from an md5, so that a row's draw is the same in every run and engine."""
    text = F.concat_ws(":", F.lit(seed), *[p.cast("string") for p in parts])
    return (F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("double") + 0.5) / float(16**12)


def reservoir(df: DataFrame, params: ReservoirParams) -> DataFrame:
    """grp, rank, seq, value: k rows of each group, an older row being kept with a probability that halves each half-life.

    A row's priority is ln(-ln u) - rate * t, smaller being better: the exponential-key order in logarithms, which has no
    landmark to move.  It merges: the best k of the union are among each part's best k, and Spark drops the others before
    the shuffle.
    """
    u = hashed_uniform(params.seed, F.col("grp"), F.col("seq"))
    ranked = df.withColumn("priority", F.log(-F.log(u)) - F.col("t") * params.rate)
    rank = F.row_number().over(Window.partitionBy("grp").orderBy("priority", "seq"))
    return ranked.withColumn("rank", rank).filter(F.col("rank") <= params.k).select("grp", "rank", "seq", "t", "value")


def top_keys(df: DataFrame, k: int) -> DataFrame:
    """grp, rank, key, count: each group's k keys of the largest total weight; ties to the smaller key."""
    total = df.groupBy("grp", "key").agg(F.sum("weight").alias("count"))
    rank = F.row_number().over(Window.partitionBy("grp").orderBy(F.desc("count"), "key"))
    return total.withColumn("rank", rank).filter(F.col("rank") <= k).select("grp", "rank", "key", "count")

"""Distinct keys over the last window, or any shorter one, by HyperLogLog registers.

A register of a window is the largest rank in it, so one aggregation gives the registers of any window; a histogram of
them, at most 66 numbers a group, gives the estimate by Ertl's improved raw estimator.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import SECOND, lane
from ..params import DistinctParams
from .clock import clocks, every_group, inside


def leading_zeros(x: Column) -> Column:
    """Of a LONG from 0 to 2^32 - 1, among 32 bits."""
    return F.when(x == 0, 32).otherwise(32 - F.length(F.bin(x)))


def register(key: Column, params: DistinctParams) -> tuple[Column, Column]:
    """(register, rank) of a key: the first p bits of one hash, and where the first 1 stands in the rest of two."""
    h, g = lane(key, params.seed), lane(key, params.seed ^ SECOND)
    rest = F.shiftleft(h, params.p).bitwiseAND(F.lit(0xFFFFFFFF))
    rank = F.when(rest != 0, leading_zeros(rest) + 1).otherwise(32 - params.p + leading_zeros(g) + 1)
    return F.shiftright(h, 32 - params.p).cast("int"), rank.cast("int")


def registers(df: DataFrame, params: DistinctParams, at: int | None = None, sub: int | None = None) -> DataFrame:
    """grp, register, rank over (now - w, now]."""
    w = params.window if sub is None else sub
    if not 0 < w <= params.window:
        raise ValueError("a sub-window is above 0 and at most the window")
    index, rank = register(F.col("key"), params)
    rows, _ = inside(df.select("grp", "t", "key"), w, at)
    return rows.groupBy("grp", index.alias("register")).agg(F.max(rank).alias("rank"))


def _sigma(x: float) -> float:
    if x == 1:
        return math.inf
    total, y = x, 1.0
    while True:
        x *= x
        was = total
        total += x * y
        y += y
        if total == was:
            return total


def _tau(x: float) -> float:
    if x in (0.0, 1.0):
        return 0.0
    total, y = 1 - x, 1.0
    while True:
        x = math.sqrt(x)
        y /= 2
        was = total
        total -= (1 - x) ** 2 * y
        if total == was:
            return total / 3


def ertl(histogram: np.ndarray, m: int) -> float:
    """The estimate from how many of m registers have each rank (0 to q + 1)."""
    q = len(histogram) - 2
    z = m * _tau(1 - histogram[q + 1] / m)
    for k in range(q, 0, -1):
        z = (z + histogram[k]) / 2
    z += m * _sigma(histogram[0] / m)
    return m * m / (2 * math.log(2)) / z


def counts(df: DataFrame, params: DistinctParams, at: int | None = None, sub: int | None = None) -> DataFrame:
    """grp, estimate: the number of distinct keys, rounded; 0 for a group without events in the window."""
    m, top = params.registers, 65 - params.p
    bins = registers(df, params, at, sub).groupBy("grp", "rank").agg(F.count(F.lit(1)).alias("n"))
    packed = bins.groupBy("grp").agg(F.map_from_entries(F.collect_list(F.struct("rank", "n"))).alias("h"))  # 66 entries at most

    @F.pandas_udf("long")
    def estimate(h: pd.Series) -> pd.Series:
        out = []
        for own in h:
            histogram = np.zeros(top + 1)
            for rank, n in own.items():
                histogram[rank] = n
            histogram[0] = m - histogram.sum()
            out.append(round(ertl(histogram, m)))
        return pd.Series(out, dtype="int64")

    found = packed.select("grp", estimate("h").alias("estimate"))
    return found if at is None else every_group(clocks(df, at), found, {"estimate": F.lit(0)})

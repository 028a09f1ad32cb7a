"""Estimates of any keys from HeavyKeeper: the sketch is folded in the order of events, and read as rows.

A group's fold holds its d * w cells and k leaders, whatever the number of keys.  The keys asked for never pass through it:
each goes to its d cells by a join, and its estimate is the most that a cell with its fingerprint holds.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import GOLDEN, MASK, SECOND, finalized, lane
from ..params import HeavyKeeperParams
from .batch import fold_groups
from .folds import HeavyKeeper


def cells(df: DataFrame, params: HeavyKeeperParams) -> DataFrame:
    """grp, row, col, mark, n of the cells that hold something."""

    def read(state):
        row, col = np.nonzero(state.counts)
        return zip(row.tolist(), col.tolist(), state.marks[row, col].tolist(), state.counts[row, col].tolist(), strict=True)

    return fold_groups(df, lambda: HeavyKeeper(params), lambda s, e: s.add(e.key, e.weight), read, "row int, col long, mark long, n long", ("t", "seq", "key", "weight"))


def estimates(df: DataFrame, keys: DataFrame, params: HeavyKeeperParams) -> DataFrame:
    """grp, key, estimate of each pair (grp, key) in ``keys``; 0 for a key that holds no cell of its group."""
    asked = keys.select("grp", "key").distinct()
    base = lane(F.col("key"), params.seed ^ SECOND)
    spread = asked.withColumns({"base": base, "own": lane(F.col("key"), params.seed)}).withColumn("row", F.explode(F.array(*[F.lit(i) for i in range(params.d)])))
    step = (F.col("row").cast("long") * GOLDEN).bitwiseAND(F.lit(MASK))
    spread = spread.withColumn("col", finalized(F.col("base").bitwiseXOR(step)) % params.w)
    to = cells(df, params).toDF("of", "in_row", "in_col", "mark", "n")
    same = F.col("grp").eqNullSafe(F.col("of")) & (F.col("row") == F.col("in_row")) & (F.col("col") == F.col("in_col")) & (F.col("own") == F.col("mark"))
    return spread.join(to, same, "left").groupBy("grp", "key").agg(F.coalesce(F.max("n"), F.lit(0)).alias("estimate"))

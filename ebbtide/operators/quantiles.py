"""Quantiles of bounded relative error over the last window: logarithmic bins on a pane grid.

A positive value's bin is ceil(ln v / ln gamma); a bin's value 2 gamma^bin / (gamma + 1) is within alpha of all in it.  A
pane keeps its ``bins`` highest bins, lower ones being folded into the lowest of them, and so does their union.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..params import PaneWindow, QuantileParams
from .clock import clocks, every_group
from .panes import live, pane_partials


def bins(df: DataFrame, params: QuantileParams) -> DataFrame:
    """grp, pane, bin (null for zeros), n, last_t, collapsed.

    A negative or non-finite value is an error, and so is a positive one outside a declared range or the indexable one.
    """
    v = F.col("value")
    checked = F.when((v >= 0) & (v < F.lit(math.inf)), v).otherwise(F.raise_error(F.lit("a value must be finite and at least 0")).cast("double"))
    if params.range is not None:
        inside = (v == 0) | v.between(*[F.lit(float(x)) for x in params.range])
        checked = F.when(inside, checked).otherwise(F.raise_error(F.lit("a value is outside the declared range")).cast("double"))
    key = F.ceil(F.log(checked) * (1 / math.log(params.gamma)))
    bin_of = F.when(v > 0, F.when(key.between(*params.keys), key).otherwise(F.raise_error(F.lit("a value is too small or too large for a bin")).cast("long")))
    grid = PaneWindow(params.window, params.panes)
    counted = pane_partials(df.withColumn("bin", F.when(checked >= 0, bin_of)), grid, F.count(F.lit(1)).alias("n"), keys=("bin",))
    top = F.max("bin").over(Window.partitionBy("grp", "pane"))
    return _folded(counted, top, params, ["grp", "pane"])


def _folded(counted: DataFrame, top, params: QuantileParams, keys: list[str]) -> DataFrame:
    floor = top - (params.bins - 1)
    if params.strict:
        lower = F.when(F.col("bin") < floor, F.raise_error(F.lit("the values span more bins than there are")).cast("long")).otherwise(F.col("bin"))
    else:
        lower = F.when(F.col("bin").isNotNull(), F.greatest("bin", floor))
    marked = counted.withColumn("collapsed", F.coalesce(F.col("bin") < floor, F.lit(False)) if "collapsed" not in counted.columns else F.col("collapsed") | F.coalesce(F.col("bin") < floor, F.lit(False)))
    return marked.withColumn("bin", lower).groupBy(*keys, "bin").agg(F.sum("n").alias("n"), F.max("last_t").alias("last_t"), F.max("collapsed").alias("collapsed"))


def merged(df: DataFrame, params: QuantileParams, at: int | None = None, sub: int | None = None) -> DataFrame:
    """grp, bin, n, collapsed over the covered span."""
    alive = live(bins(df, params), PaneWindow(params.window, params.panes), at, sub)
    summed = alive.groupBy("grp", "bin").agg(F.sum("n").alias("n"), F.max("last_t").alias("last_t"), F.max("collapsed").alias("collapsed"))
    return _folded(summed, F.max("bin").over(Window.partitionBy("grp")), params, ["grp"])


def quantiles(df: DataFrame, params: QuantileParams, qs: list[float], at: int | None = None, sub: int | None = None) -> DataFrame:
    """grp, q, quantile, count: for each q the value of rank floor(q (count - 1)); a q outside 0..1 gives NaN.

    With ``at`` past all of a group's panes its quantiles are NaN and its count is 0.
    """
    order = Window.partitionBy("grp").orderBy(F.asc_nulls_first("bin"))
    ranked = merged(df, params, at, sub).select("grp", "bin", "n", F.sum("n").over(order).alias("upto"), F.sum("n").over(Window.partitionBy("grp")).alias("count"))
    asked = ranked.withColumn("q", F.explode(F.array(*[F.lit(float(q)) for q in qs])))
    good = F.col("q").between(0, 1)
    rank = F.when(good, F.floor(F.col("q") * (F.col("count") - 1))).otherwise(0)  # one row for each q, good or not
    hit = asked.filter((F.col("upto") > rank) & (F.col("upto") - F.col("n") <= rank))
    value = F.when(F.col("bin").isNull(), 0.0).otherwise(2 * F.pow(F.lit(params.gamma), F.col("bin")) / (params.gamma + 1))
    nan = F.lit(float("nan"))
    found = hit.select("grp", "q", F.when(good, value).otherwise(nan).alias("quantile"), "count")
    if at is None:
        return found
    asked = clocks(df, at).select("grp", F.explode(F.array(*[F.lit(float(q)) for q in qs])).alias("q"))
    of = found.withColumnsRenamed({"grp": "of", "q": "for"})
    joined = asked.join(of, F.col("grp").eqNullSafe(F.col("of")) & (F.col("q") == F.col("for")), "left")
    return joined.select("grp", "q", F.coalesce("quantile", nan).alias("quantile"), F.coalesce("count", F.lit(0)).alias("count"))


def count(df: DataFrame, params: QuantileParams, at: int | None = None, sub: int | None = None) -> DataFrame:
    """grp, count, zeros, bins, collapsed over the covered span; 0 and false for a group that has left it."""
    found = merged(df, params, at, sub).groupBy("grp").agg(F.sum("n").alias("count"), F.sum(F.when(F.col("bin").isNull(), F.col("n")).otherwise(0)).alias("zeros"), F.count("bin").alias("bins"), F.max("collapsed").alias("collapsed"))
    zero = F.lit(0)
    return found if at is None else every_group(clocks(df, at), found, {"count": zero, "zeros": zero, "bins": zero, "collapsed": F.lit(False)})

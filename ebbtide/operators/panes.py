"""Exact count, sum, mean, min and max over the panes that the last window touches.

A pane is a cell of an absolute grid; a pane counts while any part of it is younger than the window, so the covered span
is the window or up to a pane more.  Rows are summed by group and pane before the shuffle, so a hot group is a few pane
rows; a group's last time decides where its window ends unless ``at`` says so.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.timegrid import floored, pane
from ..params import PaneWindow
from .clock import clocks, every_group, moved


def pane_partials(df: DataFrame, params: PaneWindow, *aggregates: Column, keys: tuple[str, ...] = ()) -> DataFrame:
    """``aggregates`` by ``grp``, pane and ``keys``, with the last time of each as last_t."""
    return df.groupBy("grp", pane(F.col("t"), params.window, params.panes).alias("pane"), *keys).agg(*aggregates, F.max("t").alias("last_t"))


def live(partials: DataFrame, params: PaneWindow, at: int | None = None, sub: int | None = None) -> DataFrame:
    """The panes that a window of ``sub`` (at most the whole window) touches at ``at``, or at each group's last time.

    Adds ``now``.  ``at`` is the same clock move for every group and must not lie before its last time.
    """
    span = params.window if sub is None else sub
    if not 0 < span <= params.window:
        raise ValueError("a sub-window is above 0 and at most the window")
    timed = partials.withColumn("now", moved(F.max("last_t").over(Window.partitionBy("grp")), at))
    return timed.filter(F.col("pane") >= floored((F.col("now") - span) * params.panes, params.window))


def five_partials(df: DataFrame, params: PaneWindow) -> DataFrame:
    return pane_partials(df, params, F.count("value").alias("n"), F.sum("value").alias("s"), F.min("value").alias("lo"), F.max("value").alias("hi"))


def _five(rows: DataFrame) -> DataFrame:
    return rows.select("*", (F.col("sum") / F.col("count")).alias("mean"))


def snapshot(df: DataFrame, params: PaneWindow, at: int | None = None, sub: int | None = None) -> DataFrame:
    """grp, now, count, sum, min, max, mean of each group's covered span.

    With ``at`` in the far future a group whose panes have all left has count 0, sum 0 and NaN for the rest.
    """
    partials = five_partials(df, params)
    found = live(partials, params, at, sub).groupBy("grp").agg(F.max("now").alias("now"), F.sum("n").alias("count"), F.sum("s").alias("sum"), F.min("lo").alias("min"), F.max("hi").alias("max"))
    if at is None:
        return _five(found)
    nan = F.lit(float("nan"))
    known = every_group(clocks(partials, at, "last_t"), _five(found), {"now": F.lit(at).cast("long"), "count": F.lit(0), "sum": F.lit(0.0), "min": nan, "max": nan, "mean": nan})
    return known.select("grp", "now", "count", "sum", "min", "max", "mean")


def running(df: DataFrame, params: PaneWindow) -> DataFrame:
    """grp, pane and the five aggregates as they stand at the end of each pane that has events."""
    span = Window.partitionBy("grp").orderBy("pane").rangeBetween(-params.panes, 0)
    over = five_partials(df, params).select("grp", "pane", F.sum("n").over(span).alias("count"), F.sum("s").over(span).alias("sum"), F.min("lo").over(span).alias("min"), F.max("hi").over(span).alias("max"))
    return _five(over)

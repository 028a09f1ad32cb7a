"""Exact sliding counts, sums and distinct counts by window frames, and their like for the last N items.

A frame is cut into spans of its own length, and each span is handed the rows of the one before as history, so a task sorts
two spans of a group and not a group.  Windows that end at a group's last time are filters and aggregates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.timegrid import floored
from .clock import every_group, inside

CELL = 3_600_000_000  # an hour: the span of time in which rows are ranked by one task


def _spans(df: DataFrame, at: str, length: int) -> DataFrame:
    """Each row as itself in its span and as history in the next one."""
    own = floored(F.col(at), length)
    twice = F.array(F.struct(own.alias("span"), F.lit(True).alias("own")), F.struct((own + 1).alias("span"), F.lit(False).alias("own")))
    return df.withColumn("in", F.explode(twice)).select("*", "in.span", "in.own").drop("in")


def _over(rows: DataFrame, frame) -> DataFrame:
    found = rows.select("grp", "seq", "t", "own", F.count("value").over(frame).alias("count"), F.sum("value").over(frame).alias("sum"), F.avg("value").over(frame).alias("mean"))
    return found.filter("own").drop("own")


def sliding(df: DataFrame, window: int) -> DataFrame:
    """Each row with the count, sum and mean of its group's last ``window``, its own time included."""
    frame = Window.partitionBy("grp", "span").orderBy("t").rangeBetween(-(window - 1), 0)  # (t - window, t] of integer times
    return _over(_spans(df.select("grp", "seq", "t", "value"), "t", window), frame)


def numbered(df: DataFrame, cell: int = CELL) -> DataFrame:
    """``df`` with nth: 1, 2, 3, ... in the order of (t, seq) of each group.

    A row's number is its rank in its cell of time and the counts of the cells before.
    """
    celled = df.withColumn("cell", floored(F.col("t"), cell))
    counts = celled.groupBy(F.col("grp").alias("of"), F.col("cell").alias("in")).agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("of").orderBy("in").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("of", "in", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    ranked = celled.withColumn("rank_in", F.row_number().over(Window.partitionBy("grp", "cell").orderBy("t", "seq")))
    joined = ranked.join(offsets, F.col("grp").eqNullSafe(F.col("of")) & (F.col("cell") == F.col("in")))
    return joined.withColumn("nth", F.col("before") + F.col("rank_in")).drop("of", "in", "before", "rank_in", "cell")


def last_items(df: DataFrame, n: int) -> DataFrame:
    """Each row with the count, sum and mean of its group's last ``n`` items."""
    frame = Window.partitionBy("grp", "span").orderBy("nth").rowsBetween(-(n - 1), 0)
    return _over(_spans(numbered(df.select("grp", "seq", "t", "value")), "nth", n), frame)


def last_window(df: DataFrame, window: int, at: int | None = None) -> DataFrame:
    """grp, count and sum in (now - window, now], now being ``at`` or the group's last time; 0 for a group without events there."""
    rows, now = inside(df.select("grp", "t", "value"), window, at)
    found = rows.groupBy("grp").agg(F.count("value").alias("count"), F.sum("value").alias("sum"))
    return found if at is None else every_group(now, found, {"count": F.lit(0), "sum": F.lit(0.0)})


def last_distinct(df: DataFrame, window: int, at: int | None = None) -> DataFrame:
    """grp and the exact number of keys in the last ``window``."""
    rows, now = inside(df.select("grp", "t", "key"), window, at)
    found = rows.groupBy("grp").agg(F.count_distinct("key").alias("distinct"))
    return found if at is None else every_group(now, found, {"distinct": F.lit(0)})


def by_count(df: DataFrame) -> DataFrame:
    """The rows with t replaced by 1, 2, 3, ... in the order of (t, seq) of each group: windows of the last N items."""
    return numbered(df).withColumn("t", F.col("nth").cast("long")).drop("nth")


def running_decayed(df: DataFrame, rate: float, half_life: int) -> DataFrame:
    """grp, seq, t, count, sum: the decayed sums as they stand after each event.

    Rows are summed in the order of (t, seq) inside a slice of a half-life; what the slices before leave, of which the last
    64 matter to a double, comes from one row a slice.
    """
    sliced = df.select("grp", "seq", "t", "value", floored(F.col("t"), half_life).alias("slice"))
    start = F.col("slice") * half_life
    grown = F.exp((F.col("t") - start) * rate)  # from 1 to 2
    ends = sliced.groupBy("grp", "slice").agg(F.sum(grown).alias("c"), F.sum(grown * F.col("value")).alias("s"))
    lately = Window.partitionBy("grp").orderBy("slice").rangeBetween(-64, -1)
    held = ends.withColumn("held", F.collect_list(F.struct("slice", "c", "s")).over(lately))
    faded = lambda name: F.aggregate("held", F.lit(0.0), lambda a, x: a + x[name] * F.exp((x["slice"] - F.col("slice")) * (rate * half_life)))
    carried = held.select(F.col("grp").alias("of"), F.col("slice").alias("in"), faded("c").alias("c0"), faded("s").alias("s0"))
    frame = Window.partitionBy("grp", "slice").orderBy("t", "seq").rowsBetween(Window.unboundedPreceding, 0)
    inner = sliced.select("*", F.sum(grown).over(frame).alias("c"), F.sum(grown * F.col("value")).over(frame).alias("s"))
    joined = inner.join(carried, F.col("grp").eqNullSafe(F.col("of")) & (F.col("slice") == F.col("in")))
    at: Column = F.exp((start - F.col("t")) * rate)
    return joined.select("grp", "seq", "t", ((F.col("c0") + F.col("c")) * at).alias("count"), ((F.col("s0") + F.col("s")) * at).alias("sum"))

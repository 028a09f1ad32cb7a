"""The last time of each group, as the moment that windows over raw rows end at."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def moved(last: Column, at: int | None) -> Column:
    """``last``, or ``at``, which must not lie before it."""
    return last if at is None else F.when(last <= at, F.lit(at).cast("long")).otherwise(F.raise_error(F.lit("the clock can't move back")).cast("long"))


def clocks(df: DataFrame, at: int | None = None, last: str = "t") -> DataFrame:
    """grp, now: a row a group, from maxima that are combined before the shuffle."""
    return df.groupBy("grp").agg(F.max(last).alias("last")).select("grp", moved(F.col("last"), at).alias("now"))


def inside(df: DataFrame, window: int, at: int | None = None) -> tuple[DataFrame, DataFrame]:
    """The rows in (now - window, now] of their group, and the groups' clocks.

    The clocks are joined to the rows by broadcast where they are small and else by a join that splits hot groups, so no task
    takes a group whole.
    """
    now = clocks(df, at)
    to = now.select(F.col("grp").alias("of"), "now")
    rows = df.join(to, F.col("grp").eqNullSafe(F.col("of"))).filter((F.col("t") > F.col("now") - window) & (F.col("t") <= F.col("now")))
    return rows.drop("of"), now


def every_group(now: DataFrame, found: DataFrame, empty: dict[str, Column]) -> DataFrame:
    """``found`` (a row a group or none) for all groups; those without events in the window have the values of ``empty``."""
    of = found.withColumnRenamed("grp", "of")
    joined = now.select("grp").join(of, F.col("grp").eqNullSafe(F.col("of")), "left")
    return joined.select("grp", *[F.coalesce(c, x).alias(c) if (x := empty.get(c)) is not None else c for c in found.columns if c != "grp"])

"""Connected components of links that no single task could hold."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved


def components(links: DataFrame) -> DataFrame:
    """(v, root) for every vertex of the links (a, b) that isn't the smallest of its component.

    Every vertex hooks onto its smallest smaller neighbour, chains of hooks are halved until all end in roots, and the
    links between different roots go round again.  Minima are combined before each shuffle, so a hub with any number of
    links is no group of its own.
    """
    edges = saved(links.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).filter("hi > lo").distinct())
    labels = None
    while not edges.isEmpty():
        hooks = saved(edges.groupBy("hi").agg(F.min("lo").alias("root")).withColumnRenamed("hi", "v"))
        while True:
            above = hooks.select(F.col("v").alias("root"), F.col("root").alias("next"))
            jumped = saved(hooks.join(above, "root", "left").select("v", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
            moved = not jumped.filter("moved").isEmpty()
            hooks = jumped.select("v", "root")
            if not moved:
                break
        hi, lo = (hooks.select(F.col("v").alias(c), F.col("root").alias(f"{c}_root")) for c in ("hi", "lo"))
        renamed = edges.join(hi, "hi").join(lo, "lo", "left").select(F.col("hi_root").alias("a"), F.coalesce("lo_root", "lo").alias("b"))
        edges = saved(renamed.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).filter("hi > lo").distinct())
        if labels is None:
            labels = hooks
        else:
            again = hooks.select(F.col("v").alias("root"), F.col("root").alias("next"))
            labels = saved(labels.join(again, "root", "left").select("v", F.coalesce("next", "root").alias("root")).unionByName(hooks))
    return labels if labels is not None else edges.select(F.col("hi").alias("v"), F.col("lo").alias("root"))

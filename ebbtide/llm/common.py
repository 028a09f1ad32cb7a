"""What several operators of this package share: scratch tables, bounded samples, ranks that never gather a key."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.shared import deleted_at_end, deleted_now, shared_dir

_own: ContextVar[list[str] | None] = ContextVar("_own", default=None)  # tables of the settled() that runs


def saved(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    Cuts the lineage: a lost executor costs a reread, not a recomputation.  The table goes when the driver's JVM ends, or
    after the ``settled`` around it.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/ebbtide-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    deleted_at_end(spark, path)
    if (own := _own.get()) is not None:
        own.append(path)
    return spark.read.schema(df.schema).parquet(path)


def settled(make: Callable[[], DataFrame]) -> DataFrame:
    """What ``make`` returns, saved; the tables saved on the way and the shuffle files of its jobs go.

    Spark deletes a shuffle's files once the driver's garbage collector finds its plan gone.  Plans of long jobs are old by
    then, which only a full collection looks at: without one the files of all jobs pile up, the more the longer they take.
    """
    outer, own = _own.get(), []
    token = _own.set(own)
    try:
        found = saved(make())
    finally:
        _own.reset(token)
    if outer is not None:
        outer.append(own[-1])
    for path in own[:-1]:
        deleted_now(found.sparkSession, path)
    found.sparkSession._jvm.System.gc()
    return found


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def held_out(doc_id: Column) -> Column:
    """True for the rows that no model may learn from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def bounded_sample(df: DataFrame, key: Column, bound: int) -> DataFrame:
    """At most about ``bound`` rows, chosen by a hash of ``key`` alone, so the choice is the same in every run."""
    total = df.count()
    if total <= bound:
        return df
    width = 1 << 30
    return df.filter(F.pmod(F.xxhash64(key, F.lit("sample")), F.lit(width)) < int(width * bound / total))


def salts_for(rows: int) -> int:
    """So many cells a key that none holds over about a million rows."""
    return max(16, -(-rows // 1_000_000))


def positions(df: DataFrame, keys: list[str], cells: list[str], order: list[str], name: str) -> DataFrame:
    """Number the rows of each ``keys`` group from 0 without a gap, in the order of ``cells``, then ``order``.

    Only the rows of one cell meet in a task; a group's cells are numbered by their counts.  ``df`` is read twice.
    """
    counts = df.groupBy(*keys, *cells).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy(*cells).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    inside = df.withColumn("_row", F.row_number().over(Window.partitionBy(*keys, *cells).orderBy(*order)))
    return inside.join(offsets, [*keys, *cells]).withColumn(name, F.col("_before") + F.col("_row") - 1).drop("_before", "_row")

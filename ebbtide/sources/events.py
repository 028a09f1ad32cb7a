"""Event tables as the operators take them: grp, t (integer time), seq (tie-breaker), value, key, weight."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.timegrid import micros


def events(spark: SparkSession, sf_dir: str, by: str = "user_id") -> DataFrame:
    """The ``events`` table; only the columns that a query goes on with are read."""
    table = spark.read.parquet(f"{sf_dir}/events.parquet")
    weight = F.get_json_object("props", "$.k").cast("long") + 1
    return table.select(F.col(by).alias("grp"), micros(F.col("ts")).alias("t"), F.col("event_id").alias("seq"), "value", F.col("user_id").alias("key"), weight.alias("weight"))


def event_stream(spark: SparkSession, sf_dir: str, by: str = "user_id", watermark: str = "1 day") -> DataFrame:
    """The same rows as a stream of files, with the event time and its watermark."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    weight = F.get_json_object("props", "$.k").cast("long") + 1
    table = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return table.select(F.col(by).alias("grp"), F.timestamp_micros(micros(F.col("ts"))).alias("ts"), micros(F.col("ts")).alias("t"), F.col("event_id").alias("seq"), "value", F.col("user_id").alias("key"), weight.alias("weight")).withWatermark("ts", watermark)

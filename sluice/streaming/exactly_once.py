"""The exactly-once read over an unbounded stream of batches: an extension of the batch read."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that all executors share; the warehouse where spark.checkpoint.dir is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{base.rstrip('/')}/sluice/{name}-{uuid.uuid4().hex}"


def exactly_once(batches: DataFrame, event_time: str, lateness: str, stream: tuple[str, ...] = ("reducer_id",), winner: int = 0) -> DataFrame:
    """Batches of the winning attempt, each once within ``lateness``; state older than that is dropped."""
    kept = batches.where(F.col("attempt_id") == winner).withWatermark(event_time, lateness)
    return kept.dropDuplicatesWithinWatermark([*stream, "map_id", "batch_id"])


def batch_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a stream of pushed batches, some pushed twice."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    e = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    copies = F.sequence(F.lit(0), F.when(F.col("event_id") % 80 == 0, 1).otherwise(0))
    return e.select(
        F.col("ts").cast("timestamp").alias("ts"), F.pmod("event_id", F.lit(4)).cast("int").alias("map_id"), F.lit(0).alias("attempt_id"),
        F.pmod("user_id", F.lit(8)).cast("int").alias("reducer_id"), F.col("event_id").alias("batch_id"), "value", F.explode(copies).alias("copy"),
    )


def _streamed(batches: DataFrame) -> DataFrame:
    """What comes out of the exactly-once read after all that is available has streamed through."""
    spark = batches.sparkSession
    out, state = scratch(spark, "stream"), scratch(spark, "stream-state")
    rows = exactly_once(batches, "ts", "3650 days")
    run = rows.select("reducer_id", "batch_id", "value").writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.parquet(out)


def dedup_stream_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and sum of all reducers."""
    return _streamed(batch_stream(spark, sf_dir)).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total"))


def dedup_stream_by_reducer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each reducer's rows and sum."""
    return _streamed(batch_stream(spark, sf_dir)).groupBy("reducer_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total"))

"""A deterministic shuffle made of the events table, with what goes wrong in one.

Every event is a batch; some are pushed twice to one file, some also by an
attempt that loses, and some fail in epoch 0 and are pushed again in epoch 1,
their first copies blacklisted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MAPPERS, REDUCERS = 4, 8
TWICE, LOSING, RETRIED = 80, 50, 90


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def base_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    return e.select(
        F.pmod("event_id", F.lit(MAPPERS)).cast("int").alias("map_id"), F.lit(0).alias("attempt_id"), F.pmod("user_id", F.lit(REDUCERS)).cast("int").alias("reducer_id"),
        F.lit(0).alias("epoch_id"), F.col("event_id").alias("batch_id"), F.length("props").cast("bigint").alias("n_bytes"), "value",
    )


def batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One scan; a row's copies come from one generator. copy tells a file's two writes of a batch apart."""
    kind = "array<struct<attempt:int,epoch:int,copy:int>>"
    copy = lambda when, a, e, c: F.when(when, F.expr(f"array(struct({a} as attempt, {e} as epoch, {c} as copy))")).otherwise(F.array().cast(kind))
    b = F.col("batch_id")
    copies = F.concat(copy(F.lit(True), 0, 0, 0), copy(b % TWICE == 0, 0, 0, 1), copy(b % LOSING == 0, 1, 0, 0), copy(b % RETRIED == 0, 0, 1, 0))
    rows = base_batches(spark, sf_dir).withColumn("c", F.explode(copies))
    return rows.withColumns({"attempt_id": F.col("c.attempt"), "epoch_id": F.col("c.epoch"), "copy": F.col("c.copy")}).drop("c")


def attempts(spark: SparkSession) -> DataFrame:
    """Attempt 0 of every mapper wins."""
    return spark.range(MAPPERS).select(F.col("id").cast("int").alias("map_id"), F.lit(0).alias("attempt_id"))


def blacklist(spark: SparkSession, sf_dir: str) -> DataFrame:
    failed = base_batches(spark, sf_dir).where(F.col("batch_id") % RETRIED == 0)
    return failed.select("reducer_id", "epoch_id", "map_id", "attempt_id", "batch_id")


def commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two replicas of each file of the shuffle; replica 0 of reducer 1 broke, both of reducer 3's epoch 1, and reducer 5's epoch 1 is empty."""
    files = batches(spark, sf_dir).groupBy("reducer_id", "epoch_id").agg(F.sum("n_bytes").alias("n"))
    files = files.withColumn("replica", F.explode(F.array(F.lit(0), F.lit(1))))
    broken = ((F.col("reducer_id") == 1) & (F.col("replica") == 0)) | ((F.col("reducer_id") == 3) & (F.col("epoch_id") == 1))
    length = F.when(broken, -1).when((F.col("reducer_id") == 5) & (F.col("epoch_id") == 1), 0).otherwise(F.col("n"))
    path = F.concat_ws("-", "reducer_id", "epoch_id", F.concat(F.lit("r"), F.col("replica").cast("string")), F.lit("data"))
    return files.select("reducer_id", "epoch_id", "replica", F.when(~broken, path).alias("file_path"), length.cast("bigint").alias("file_length"))

"""The registry of workers, applications and shuffles: an append-only table a kind, read as the last record of each key."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KINDS = ("workers", "applications", "shuffles", "lock", "expiredTime")
RECORD = "key string, ts bigint, value string, live boolean"


class Registry:
    """Writers append and never change a file, so no record needs a lock; equal times are told apart by value."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, kind: str) -> str:
        if kind not in KINDS:
            raise ValueError(f"unknown kind {kind!r}")
        return f"{self.root}/{kind}"

    def put(self, kind: str, records: DataFrame) -> None:
        """records: (key, ts, value), value being JSON; ``live`` is false in a record that takes the key away."""
        rows = records if "live" in records.columns else records.withColumn("live", F.lit(True))
        rows.select("key", F.col("ts").cast("bigint").alias("ts"), "value", "live").write.mode("append").parquet(self._path(kind))

    def latest(self, kind: str) -> DataFrame:
        """(key, ts, value): the last record of each key that was not taken away."""
        rows = self.spark.read.schema(RECORD).parquet(self._path(kind))
        last = rows.groupBy("key").agg(F.max(F.struct("ts", "value", "live")).alias("r"))
        return last.where("r.live").select("key", "r.ts", "r.value")

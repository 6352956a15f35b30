"""Sizes and counts that planning and people look at."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F


def partition_sizes(batches: DataFrame) -> DataFrame:
    """(map_id, reducer_id, n_batches, n_bytes)."""
    return batches.groupBy("map_id", "reducer_id").agg(F.count(F.lit(1)).alias("n_batches"), F.sum("n_bytes").alias("n_bytes"))


def size_profile(rows: DataFrame, key: str, size: str) -> DataFrame:
    """Count, sum, least, most and approximate quartiles of sizes a key."""
    q = F.percentile_approx(size, [0.25, 0.5, 0.75], 10_000)
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.sum(size).alias("total"), F.min(size).alias("least"), F.max(size).alias("most"), q.alias("quartiles"))


def observed(df: DataFrame, name: str, size: str) -> tuple[DataFrame, Observation]:
    """The rows, and counters that any action on them fills in passing."""
    seen = Observation(name)
    return df.observe(seen, F.count(F.lit(1)).alias("rows"), F.sum(size).alias("bytes"), F.max(size).alias("largest")), seen


def store_totals(committed: DataFrame) -> DataFrame:
    """Bytes and files of a shuffle, one replica of each file."""
    one = committed.where(F.col("file_length") >= 0).groupBy("reducer_id", "epoch_id").agg(F.max("file_length").alias("n"))
    return one.agg(F.count(F.lit(1)).alias("n_files"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_bytes"))


def as_metrics(profile: DataFrame, prefix: str, key: str) -> DataFrame:
    """(name, value): a row for each number of a profile, named prefix.key.column, as sinks take them."""
    numbers = [c for c, t in profile.dtypes if c != key and t in ("int", "bigint", "double")]
    pairs = F.array(*(F.struct(F.concat_ws(".", F.lit(prefix), F.col(key).cast("string"), F.lit(c)).alias("name"), F.col(c).cast("double").alias("value")) for c in numbers))
    return profile.select(F.inline(pairs))


def sink(rows: DataFrame, kind: str, path: str | None = None) -> None:
    """Reports (name, value) rows: csv and json lines to a folder, or the console. Other kinds are Spark's own sinks, set in metrics.properties."""
    if kind == "console":
        rows.show(truncate=False)
    elif kind in ("csv", "json") and path:
        rows.write.mode("append").format(kind).save(path)
    else:
        raise ValueError(kind)

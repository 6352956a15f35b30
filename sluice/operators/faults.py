"""Seeded faults: pushes that fail, the same ones in every run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: One push in so many fails, in epochs with an even number.
RATE = 2000


def fails(seed: int, epoch: Column, *key: Column, rate: int = RATE) -> Column:
    """Whether a push fails: decided by a digest of the seed and its key, so no run differs from another."""
    told = F.concat_ws(":", F.lit(str(seed)), *(k.cast("string") for k in key), epoch.cast("string"))
    return (epoch % 2 == 0) & (F.conv(F.substring(F.md5(told), 1, 8), 16, 10).cast("bigint") % rate == 0)


def with_faults(batches: DataFrame, seed: int, rate: int = RATE) -> tuple[DataFrame, DataFrame]:
    """(batches, blacklist): each failed push is followed by another in the next epoch, and its first copy blacklisted."""
    failed = fails(seed, F.col("epoch_id"), F.col("map_id"), F.col("batch_id"), rate=rate)
    epochs = F.when(failed, F.array(F.col("epoch_id"), F.col("epoch_id") + 1)).otherwise(F.array(F.col("epoch_id")))
    pushed = batches.withColumn("epoch_id", F.explode(epochs)).select(*batches.columns)
    return pushed, batches.where(failed).select("reducer_id", "epoch_id", "map_id", "attempt_id", "batch_id")

"""Aggregation on either side of the exchange."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def combine_by_key(df: DataFrame, keys: list[str], *aggs: Column) -> DataFrame:
    """Map-side combine, one exchange of combined rows, merge. Spark plans partial and final aggregation."""
    if not aggs:
        raise ValueError("map-side combine needs an aggregate")
    return df.groupBy(*keys).agg(*aggs)


def reduce_side(df: DataFrame, n: int, keys: list[str], *aggs: Column) -> DataFrame:
    """Rows are exchanged as they are and aggregated once: for keys that hardly repeat within a task."""
    return df.repartition(n, *keys).groupBy(*keys).agg(*aggs)


def salted_sum(df: DataFrame, keys: list[str], value: str, out: str, salts: int = 16) -> DataFrame:
    """A sum in two exchanges, the first by key and salt: for aggregates whose partial step cannot shrink a hot key.

    The salt is a row's place in its task, so equal values spread too; whatever a row's salt, the sum is the same.
    """
    salted = df.withColumn("__salt", F.pmod(F.monotonically_increasing_id(), F.lit(salts))).groupBy(*keys, "__salt").agg(F.sum(value).alias("__part"))
    return salted.groupBy(*keys).agg(F.sum("__part").alias(out))

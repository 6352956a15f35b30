"""Partitioning and order: what a row's key decides about where it goes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def modulo_partition(key: Column, n: int) -> Column:
    """The partition of a non-negative integer key."""
    return F.pmod(key, F.lit(n)).cast("int")


def hash_exchange(df: DataFrame, n: int, *keys: str) -> DataFrame:
    return df.repartition(n, *keys)


def range_exchange(df: DataFrame, n: int, *keys: str, sort: bool = True) -> DataFrame:
    """Partitions in key order; with ``sort``, rows of a partition too, which orders the whole."""
    out = df.repartitionByRange(n, *keys)
    return out.sortWithinPartitions(*keys) if sort else out


def sorted_exchange(df: DataFrame, n: int, keys: list[str], order: list[str]) -> DataFrame:
    """One shuffle by keys, then rows of each partition by keys and order."""
    return df.repartition(n, *keys).sortWithinPartitions(*keys, *order)


def range_partition(key: Column, bounds: list) -> Column:
    """The number of bounds at or below the key: fixed ranges, without sampling."""
    return sum([(key >= F.lit(b)).cast("int") for b in bounds], F.lit(0))


def bucket_of(key: Column, bounds: list) -> Column:
    """The number of sorted bounds at or below the key, by halving: deterministic ranges for any number of bounds."""
    every, n = F.array(*map(F.lit, bounds)), len(bounds)
    halves = F.array(*(F.lit(1 << i) for i in reversed(range(n.bit_length()))))
    step = lambda at, h: F.when((at + h <= n) & (F.get(every, at + h - 1) <= key), at + h).otherwise(at)
    return F.aggregate(halves, F.lit(0), step) if n else F.lit(0)


def prefixed(df: DataFrame, group: list[str], order: list[str], **sums: Column) -> DataFrame:
    """Adds, for each name, the sum of a column over the rows of the group that come before this one.

    A group of any size is cut into ranges of the first order column, whose
    bounds are quantiles of the table; windows run within a range, and a table
    with a row a group and range carries the sums of the ranges before. Rows that
    share a value of that column are one range, so it should tell most apart; it
    is a number or a time.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cuts = df.agg(F.percentile_approx(order[0], [i / parts for i in range(1, parts)] or [0.5], 1000).alias("q")).first()["q"]
    rows = df.withColumn("__range", bucket_of(F.col(order[0]), sorted(set(cuts or []))))
    keys = [*group, "__range"]
    held = rows.groupBy(*keys).agg(*(F.sum(c).alias(f"__{n}") for n, c in sums.items()))
    before = W.partitionBy(*group).orderBy("__range").rowsBetween(W.unboundedPreceding, -1)
    held = held.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], *(F.coalesce(F.sum(f"__{n}").over(before), F.lit(0)).alias(f"__{n}") for n in sums))
    on = [rows[k].eqNullSafe(held[f"__k{i}"]) for i, k in enumerate(keys)]
    inside = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    out = rows.withColumns({n: F.coalesce(F.sum(c).over(inside), F.lit(0)) for n, c in sums.items()}).join(held, on)
    return out.select(*df.columns, *((F.col(n) + F.col(f"__{n}")).alias(n) for n in sums))


def partition_rank(df: DataFrame, partition: str, *order: str) -> DataFrame:
    """Adds ``rank`` from 1 within each partition."""
    return prefixed(df, [partition], list(order), rank=F.lit(1)).withColumn("rank", (F.col("rank") + 1).cast("bigint"))


def round_robin(df: DataFrame, k: int, partition: str, *order: str) -> DataFrame:
    """Adds ``slot``: the rows of each partition are dealt to k places in turn."""
    return prefixed(df, [partition], list(order), slot=F.lit(1)).withColumn("slot", F.pmod("slot", F.lit(k)).cast("int"))


def coalesced_ranges(sizes: DataFrame, target: int) -> DataFrame:
    """sizes: (reducer_id, n_bytes). Adds ``task``: neighbours share a read until the running size passes ``target``.

    The table has a row a partition, which bounds its one window.
    """
    before = F.sum("n_bytes").over(W.orderBy("reducer_id").rowsBetween(W.unboundedPreceding, -1))
    return sizes.withColumn("task", F.floor(F.coalesce(before, F.lit(0)) / target).cast("bigint"))

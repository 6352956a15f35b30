"""Which workers hold which partitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def group_length(partitions: int, max_per_group: int, workers: int) -> int:
    """Partitions of a group: spread over all pairs of workers, as far as the bound lets."""
    if workers < 2:
        raise ValueError("two replicas need two workers")
    pairs = workers * (workers - 1) // 2
    return max(1, partitions // workers) if partitions < pairs else min(partitions // pairs, max_per_group)


def partition_groups(spark: SparkSession, partitions: int, max_per_group: int, workers: int) -> DataFrame:
    """(group_id, epoch_id, start_partition, end_partition, pair): group i holds [i * length, (i + 1) * length); pairs of workers go round."""
    length = group_length(partitions, max_per_group, workers)
    groups = -(-partitions // length)
    i = F.col("id")
    return spark.range(groups).select(
        i.cast("int").alias("group_id"), F.lit(0).alias("epoch_id"), (i * length).cast("int").alias("start_partition"),
        F.least((i + 1) * length, F.lit(partitions)).cast("int").alias("end_partition"), F.pmod(i, F.lit(workers * (workers - 1) // 2)).cast("int").alias("pair"),
    )


def replica_pairs(workers: DataFrame, index: str, name: str) -> DataFrame:
    """All pairs (a, b) of workers with a's index below b's. Pairs are generated from indexes and looked up, not crossed."""
    n = workers.agg(F.max(index)).first()[0]
    if n is None:
        return workers.select(F.col(name).alias("a"), F.col(name).alias("b"))
    later = F.explode(F.when(F.col(index) < n, F.sequence(F.col(index) + 1, F.lit(n))).otherwise(F.array().cast(f"array<{workers.schema[index].dataType.simpleString()}>")))
    left = workers.select(F.col(name).alias("a"), later.alias("__j"))
    return left.join(workers.select(F.col(index).alias("__j"), F.col(name).alias("b")), "__j").select("a", "b")


def group_of(reducer, length: int):
    """A reducer's group."""
    return F.floor(reducer / length).cast("int")


def reallocate(groups: DataFrame, failed: DataFrame, pairs: int | None = None) -> DataFrame:
    """failed: (group_id, epoch_id) that pushers saw. A current epoch is followed by the next; a stale one gets the current.

    pairs: how many pairs of workers there are; a group that moves gets another
    of them, dealt by its id and epoch. Without it, or with one pair, it stays.
    """
    seen = failed.groupBy("group_id").agg(F.max("epoch_id").alias("seen"))
    moved = groups.join(seen, "group_id", "left")
    bump = F.coalesce(F.col("seen") >= F.col("epoch_id"), F.lit(False))
    out = moved.withColumn("__bump", bump).withColumn("epoch_id", F.col("epoch_id") + bump.cast("int")).drop("seen")
    if pairs and pairs > 1:
        step = 1 + F.pmod(F.col("group_id") * 31 + F.col("epoch_id") * 17, F.lit(pairs - 1))
        out = out.withColumn("pair", F.when(F.col("__bump"), F.pmod(F.col("pair") + step, F.lit(pairs)).cast("int")).otherwise(F.col("pair")))
    return out.drop("__bump")


def workers_wanted(n: int, extra_ratio: float = 1.5, most: int = 1000) -> int:
    return min(max(2, int(n * extra_ratio)), most)


def initial_workers_of(instances: Column, least: Column, most: Column) -> Column:
    """``initial_workers`` of columns; a null number of instances means dynamic allocation."""
    dynamic = F.floor((F.floor(most / 50) + least) / 10)
    return F.greatest(F.lit(2), F.when(instances.isNotNull(), F.floor(instances / 20)).otherwise(dynamic).cast("int"))


def allocate_workers(workers: DataFrame, n: int, load: str, name: str, extra_ratio: float = 1.5, most: int = 1000) -> DataFrame:
    """The workers for n partitions: as many as are wanted, least loaded first, or all there are."""
    return least_loaded(workers, workers_wanted(n, extra_ratio, most), load, name)


def initial_workers(instances: int | None = None, least: int = 0, most: int = 0) -> int:
    """An estimate before the first shuffle: from fixed executors, or from the bounds of dynamic allocation."""
    return max(2, instances // 20 if instances is not None else (most // 50 + least) // 10)


def least_loaded(workers: DataFrame, n: int, load: str, name: str) -> DataFrame:
    """The n workers with the least load, ties by name: a top-k, not a sort of all."""
    return workers.orderBy(load, name).limit(n)

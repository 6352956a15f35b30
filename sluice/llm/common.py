"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space as the contracts define it, and the words between it.
WS = r"[\x20\x09-\x0D]"
NOT_WS = r"[^\x20\x09-\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once, also inside nested lambdas.

    Catalyst inlines a projected column into a lambda and would evaluate it per
    element; the variable of a one-element ``transform`` is bound once.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z, and no other letter."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text: Column) -> Column:
    """The words of a text in order; null and white space give an empty array."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), f"{WS}+", -1), "")


def exclusive_prefix_sums(lengths: Column, chunk: int = 512) -> Column:
    """For an array<bigint>, the sum of what stands before each element.

    A fold that appends copies its array each time, so it runs over chunks and
    then over the chunks' sums: n * chunk copies instead of n * n.
    """

    def fold(xs: Column) -> Column:
        zero = F.struct(F.lit(0).cast("bigint").alias("s"), F.array().cast("array<bigint>").alias("a"))
        return F.aggregate(
            xs, zero, lambda acc, x: F.struct((acc["s"] + x).alias("s"), F.array_append(acc["a"], acc["s"]).alias("a"))
        )

    def by_chunks(xs: Column) -> Column:
        starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.size(xs) - 1) / chunk).cast("int")))
        return let(
            F.transform(starts, lambda c: fold(F.slice(xs, c * chunk + 1, F.lit(chunk)))),
            lambda cs: let(
                fold(F.transform(cs, lambda c: c["s"]))["a"],
                lambda offs: F.flatten(F.transform(cs, lambda c, i: F.transform(c["a"], lambda x: x + F.get(offs, i)))),
            ),
        )

    return let(lengths, by_chunks)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir; set here only where it is unset (tests on one machine)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        have = spark.sparkContext._jsc.sc().getCheckpointDir()
        if have.isDefined():
            return have.get()
        found = spark.conf.get("spark.sql.warehouse.dir") + "/_scratch"
        spark.sparkContext.setCheckpointDir(found)
    return found


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/sluice/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Cuts lineage: writes Parquet to the shared folder and reads it again, so a lost executor costs no recomputation."""
    path = scratch(df.sparkSession, name)
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path) if not partition_by else df.sparkSession.read.parquet(path)


def removed(spark: SparkSession, *paths: str) -> None:
    """Deletes scratch that nothing reads any more, wherever the shared folder is."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(conf).delete(where, True)


class Scratch:
    """Tables written on the way to a result, which go once it is written."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.paths = spark, []

    def written(self, df: DataFrame, name: str) -> DataFrame:
        path = scratch(self.spark, name)
        df.write.option("compression", "zstd").parquet(path)
        self.paths.append(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def clear(self) -> None:
        removed(self.spark, *self.paths)
        self.paths = []


def count_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))

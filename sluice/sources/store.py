"""Batches as Parquet, one directory a reducer and epoch, so a read of some reducers lists and opens only theirs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_batches(batches: DataFrame, path: str, codec: str = "lz4_raw", max_records: int = 0, replication: int = 0, checksums: bool = True) -> None:
    """Rows of a reducer meet in one task and one file an epoch; AQE splits a hot reducer's rebalance.

    replication and checksums place the files in a distributed file system: how
    many copies its blocks have, and whether it keeps checksums besides Parquet's.
    """
    out = batches.hint("rebalance", "reducer_id", "epoch_id").write.mode("overwrite").option("compression", codec)
    out = out.options(**placement(replication, checksums))
    (out.option("maxRecordsPerFile", max_records) if max_records else out).partitionBy("reducer_id", "epoch_id").parquet(path)


def placement(replication: int = 0, checksums: bool = True) -> dict[str, str]:
    """Options of a writer that its file system reads from its Hadoop configuration."""
    return ({"dfs.replication": str(replication)} if replication else {}) | ({} if checksums else {"dfs.checksum.type": "NULL"})


def shuffle_dir(root: str, shuffle_key: str) -> str:
    return f"{root.rstrip('/')}/{shuffle_key}"


def recycle(spark: SparkSession, root: str, shuffle_keys: list[str]) -> list[str]:
    """Deletes the folders of shuffles that are over; those that were there. The list is that of expired shuffles, a folder each."""
    jvm, conf, gone = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration(), []
    for key in shuffle_keys:
        path = jvm.org.apache.hadoop.fs.Path(shuffle_dir(root, key))
        if path.getFileSystem(conf).delete(path, True):
            gone.append(key)
    return gone


def recycle_app(spark: SparkSession, root: str, app_id: str) -> list[str]:
    """Deletes the folders of all shuffles of an application."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    top = jvm.org.apache.hadoop.fs.Path(root)
    fs = top.getFileSystem(conf)
    names = [f.getPath().getName() for f in fs.listStatus(top)] if fs.exists(top) else []
    return recycle(spark, root, sorted(n for n in names if n.rpartition("-")[0] == app_id))


def read_reducers(spark: SparkSession, path: str, schema: str, start: int, end: int) -> DataFrame:
    """Reducers from start up to, not with, end; by partition pruning."""
    return spark.read.schema(schema).parquet(path).where((F.col("reducer_id") >= start) & (F.col("reducer_id") < end))


def read_epoch(spark: SparkSession, path: str, schema: str, reducer: int, epoch: int) -> DataFrame:
    return spark.read.schema(schema).parquet(path).where((F.col("reducer_id") == reducer) & (F.col("epoch_id") == epoch))


def empty(spark: SparkSession, schema: str) -> DataFrame:
    """A shuffle without mappers."""
    return spark.createDataFrame([], schema)

"""From finished mappers to readable files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.model import EPOCH


def winning_attempts(ends: DataFrame) -> DataFrame:
    """ends: (map_id, attempt_id, end_seq). The first attempt that ended wins."""
    return ends.groupBy("map_id").agg(F.min_by("attempt_id", F.struct("end_seq", "attempt_id")).alias("attempt_id"))


def all_ended(attempts: DataFrame, n_mappers: int) -> DataFrame:
    """One row: ended, all_ended."""
    n = F.count_distinct("map_id")
    return attempts.agg(n.alias("ended"), (n == n_mappers).alias("all_ended"))


def written_epochs(batches: DataFrame, attempts: DataFrame) -> DataFrame:
    """(reducer_id, epoch_id) that winners wrote to. Losers' reports change nothing."""
    return batches.join(attempts.select("map_id", "attempt_id"), ["map_id", "attempt_id"], "left_semi").select(*EPOCH).distinct()


def readable(committed: DataFrame) -> DataFrame:
    """Commits with a path to a data file."""
    return committed.where(F.col("file_path").isNotNull() & F.col("file_path").endswith("data"))


def lost_epochs(written: DataFrame, committed: DataFrame) -> DataFrame:
    """Written epochs without a replica that was closed well; one good replica is enough."""
    good = committed.where(F.col("file_length") >= 0).select(*EPOCH)
    return written.join(good, list(EPOCH), "left_anti")


def file_groups(committed: DataFrame, n_reducers: int) -> DataFrame:
    """(reducer_id, files): for every reducer its non-empty files, in order; reducers without any have none."""
    files = readable(committed).where(F.col("file_length") > 0)
    per = files.groupBy("reducer_id").agg(F.sort_array(F.collect_set(F.struct("epoch_id", "replica", "file_path", "file_length"))).alias("files"))
    every = committed.sparkSession.range(n_reducers).select(F.col("id").cast("int").alias("reducer_id"))
    return every.join(per, "reducer_id", "left").withColumn("files", F.coalesce("files", F.array().cast(per.schema["files"].dataType)))


def stage_status(all_ended: Column, lost: Column, waited_ms: Column, timeout_ms: int) -> Column:
    """What a reader learns of a stage."""
    return (
        F.when(~all_ended & (waited_ms > timeout_ms), "TIMEOUT").when(~all_ended, "RUNNING")
        .when(lost > 0, "DATA_LOST").otherwise("FINISHED")
    )


def write_succeeded(codes: DataFrame, replicas: int = 2) -> DataFrame:
    """codes: (batch.., replica, code): 0 written, 1 written but the file wants to rotate, more is failure. Write-all: the sum is at most the replicas, and all answered."""
    keys = [c for c in codes.columns if c not in ("replica", "code")]
    total = codes.groupBy(*keys).agg(F.sum("code").cast("bigint").alias("code_sum"), F.count(F.lit(1)).alias("answers"), F.max("code").alias("worst"))
    return total.withColumn("ok", (F.col("code_sum") <= replicas) & (F.col("answers") == replicas) & (F.col("worst") <= 1)).withColumn("rotate", F.col("ok") & (F.col("code_sum") > 0)).drop("worst")


def stage_ends(ends: DataFrame, n_mappers: int) -> DataFrame:
    """Adds to each (map_id, attempt_id, end_seq) whether it ``wins`` its mapper, and whether it ``triggers`` the stage's end: the win after which all mappers have ended."""
    won = winning_attempts(ends).withColumn("wins", F.lit(True))
    out = ends.join(won, ["map_id", "attempt_id"], "left")
    first = ends.groupBy("map_id").agg(F.min("end_seq").alias("first"))
    last = first.agg(F.max("first").alias("__last"), F.count(F.lit(1)).alias("__n"))
    rows = out.join(first, "map_id").join(F.broadcast(last))  # one row
    wins = F.coalesce("wins", F.lit(False)) & (F.col("end_seq") == F.col("first"))
    return rows.select("map_id", "attempt_id", "end_seq", wins.alias("wins"), (wins & (F.col("end_seq") == F.col("__last")) & (F.col("__n") == n_mappers)).alias("triggers"))


def lookup(ends: DataFrame, batches: DataFrame, committed: DataFrame, n_mappers: int, n_reducers: int, waited_ms: int = 0, timeout_ms: int = 600_000) -> DataFrame:
    """(reducer_id, status, files): what a reader of each reducer learns of a stage. Files are listed only when the stage has ended well.

    Loss is decided by reducer: one lost file fails only those who would read it.
    """
    won = winning_attempts(ends)
    ended = all_ended(won, n_mappers).first()["all_ended"]
    lost = lost_epochs(written_epochs(batches, won), committed).groupBy("reducer_id").agg(F.count(F.lit(1)).alias("lost"))
    groups = file_groups(committed, n_reducers).join(lost, "reducer_id", "left")
    status = stage_status(F.lit(ended), F.coalesce("lost", F.lit(0)), F.lit(waited_ms), timeout_ms)
    none = F.array().cast(groups.schema["files"].dataType)
    return groups.withColumn("status", status).select("reducer_id", "status", F.when(F.col("status") == "FINISHED", F.col("files")).otherwise(none).alias("files"))

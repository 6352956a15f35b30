"""Reading committed batches exactly once.

A batch may be in several files: pushed twice, pushed by an attempt that lost,
or pushed again in a later epoch after a failure. Filters come in a fixed order:
attempt, range of mappers, blacklist, duplicates.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sluice.model import BATCH_ID, EPOCH


def attempt_filter(batches: DataFrame, attempts: DataFrame) -> DataFrame:
    """Batches of each mapper's winning attempt. attempts: (map_id, attempt_id), one row a mapper."""
    return batches.join(attempts.select("map_id", "attempt_id"), ["map_id", "attempt_id"], "left_semi")


def map_range(batches: DataFrame, start: int, end: int) -> DataFrame:
    """Mappers from start up to, not with, end."""
    return batches.where((F.col("map_id") >= start) & (F.col("map_id") < end))


def reducer_range(batches: DataFrame, start: int, end: int) -> DataFrame:
    return batches.where((F.col("reducer_id") >= start) & (F.col("reducer_id") < end))


def blacklist_filter(batches: DataFrame, blacklist: DataFrame) -> DataFrame:
    """Without the copies of batches whose push failed."""
    return batches.join(blacklist.select(*BATCH_ID), list(BATCH_ID), "left_anti")


def dedup(batches: DataFrame, stream: list[str] | None = None, order: tuple[str, ...] = ("epoch_id",)) -> DataFrame:
    """One row a (stream, mapper, batch): the first by ``order``.

    A minimum of structs, so duplicates within a task are gone before the
    exchange; a window would send and sort them all.
    """
    keys = [*(stream or ["reducer_id"]), "map_id", "batch_id"]
    rest = [c for c in batches.columns if c not in keys]
    first = F.min_by(F.struct(*rest), F.struct(*order, *[c for c in rest if c not in order]))
    return batches.groupBy(*keys).agg(first.alias("__r")).select(*[F.col(c) if c in keys else F.col(f"__r.{c}").alias(c) for c in batches.columns])


def exactly_once(batches: DataFrame, attempts: DataFrame, blacklist: DataFrame | None, maps: tuple[int, int] | None = None, stream: list[str] | None = None) -> DataFrame:
    out = attempt_filter(batches, attempts)
    if maps:
        out = map_range(out, *maps)
    if blacklist is not None:
        out = blacklist_filter(out, blacklist)
    return dedup(out, stream)


def epoch_positions(batches: DataFrame) -> DataFrame:
    """(reducer_id, epoch_id, position): files in order, from 0. One row a file, which bounds the window; replicas share a place."""
    files = batches.select(*EPOCH).distinct()
    return files.withColumn("position", F.row_number().over(W.orderBy(*EPOCH)) - 1)


def split_read(batches: DataFrame, step: int, index: int, blacklist_on: bool = True) -> DataFrame:
    """The index-th of ``step`` readers of a skewed read: every step-th file. More readers than files read nothing."""
    if not blacklist_on:
        raise ValueError("split readers remove duplicates each for itself: failed batches must be blacklisted")
    mine = epoch_positions(batches).where(F.col("position") % step == index).select(*EPOCH)
    return batches.join(mine, list(EPOCH), "left_semi")


def with_reader(batches: DataFrame, step: int) -> DataFrame:
    """All readers of a split at once: adds ``reader``."""
    return batches.join(epoch_positions(batches).select(*EPOCH, (F.col("position") % step).alias("reader")), list(EPOCH))


def choose_replica(committed: DataFrame) -> DataFrame:
    """One readable replica of each file: the least of those with bytes."""
    rest = [c for c in committed.columns if c not in EPOCH]
    good = committed.where(F.col("file_length") > 0)
    return good.groupBy(*EPOCH).agg(F.min_by(F.struct(*rest), "replica").alias("__r")).select(*EPOCH, *[F.col(f"__r.{c}").alias(c) for c in rest])


def chunk_table(files: DataFrame, chunk: int) -> DataFrame:
    """files: (file_path, file_length). (file_path, chunk_idx, start_off, end_off, file_length): even cuts, the last one shorter; no chunk for an empty file."""
    n = F.when(F.col("file_length") > 0, F.ceil(F.col("file_length") / chunk)).otherwise(0).cast("int")
    each = F.explode(F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))).alias("chunk_idx")
    start = F.col("chunk_idx").cast("bigint") * chunk
    return files.select("file_path", each, "file_length").select("file_path", "chunk_idx", start.alias("start_off"), F.least(start + chunk, "file_length").alias("end_off"), "file_length")


def chunks_from(chunks: DataFrame, first: int) -> DataFrame:
    """A file's chunks from an index on, as a reader that starts again asks for them. Chunks that do not end where their file does are an error."""
    ends = chunks.groupBy("file_path").agg(F.max("end_off").alias("__end"))
    told = F.raise_error(F.concat(F.lit("chunks do not cover "), "file_path"))
    whole = chunks.join(ends, "file_path").withColumn("end_off", F.when(F.col("__end") == F.col("file_length"), F.col("end_off")).otherwise(told.cast("bigint")))
    return whole.where(F.col("chunk_idx") >= first).drop("__end")


def open_reader(
    batches: DataFrame, attempts: DataFrame, blacklist: DataFrame | None = None, reducers: tuple[int, int] | None = None,
    maps: tuple[int, int] | None = None, split: tuple[int, int] | None = None, n_mappers: int | None = None,
) -> DataFrame:
    """One call for every kind of read: whole reducers, a range of mappers, or one of the ``split`` = (readers, index) of a skewed reducer.

    A shuffle without mappers gives no rows. A range of mappers and a split exclude each other.
    """
    if maps and split:
        raise ValueError("a split reads all mappers")
    if n_mappers == 0:
        return batches.limit(0)
    rows = reducer_range(batches, *reducers) if reducers else batches
    if split:
        rows = split_read(rows, *split, blacklist_on=blacklist is not None)
    return exactly_once(rows, attempts, blacklist, maps)

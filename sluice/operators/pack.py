"""Sequential packing of a mapper's output.

Counters and offsets are prefix sums, cut into ranges of the order so that one
group of any size runs in many tasks. Folds (a step depends on the last) run in
order over a group, which is the output of one map attempt or the files of one
partition group: rows are dealt by group, sorted, and streamed. A task holds one
Arrow batch and the state of one group, and takes a step a pack, found by binary
search in running sums, not a step a row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from sluice.operators.exchange import prefixed


def batch_ids(rows: DataFrame, *order: str) -> DataFrame:
    """Adds ``batch_no``: a counter from 1 for each (map_id, attempt_id)."""
    return prefixed(rows, ["map_id", "attempt_id"], list(order), batch_no=F.lit(1)).withColumn("batch_no", (F.col("batch_no") + 1).cast("bigint"))


def frame_offsets(rows: DataFrame, group: list[str], order: list[str], size: str = "n_bytes") -> DataFrame:
    """Adds ``start_off``: bytes of the group before this row."""
    return prefixed(rows, group, order, start_off=F.col(size))


def spill_runs(rows: DataFrame, group: list[str], order: list[str], records: int) -> DataFrame:
    """Adds ``run``: a spill after so many records."""
    return prefixed(rows, group, order, run=F.lit(1)).withColumn("run", F.floor(F.col("run") / records).cast("bigint"))


def _folded(rows: DataFrame, group: list[str], order: list[str], columns: list[str], out: str, start: tuple, fold: Callable[..., tuple[np.ndarray, tuple]]) -> DataFrame:
    schema = StructType([*rows.schema.fields, StructField(out, LongType())])
    ordered = rows.repartition(*group).sortWithinPartitions(*group, *order)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, state = None, start
        for part in parts:
            # A null key is a group too.
            codes = part.groupby(group, sort=False, dropna=False).ngroup().to_numpy()
            cuts = np.r_[0, np.flatnonzero(codes[1:] != codes[:-1]) + 1, len(part)] if len(part) else np.zeros(1, int)
            found = np.empty(len(part), np.int64)
            values = [part[c].to_numpy() for c in columns]
            keys = part[group]
            for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                key = tuple(None if pd.isna(x) else x for x in keys.iloc[i])
                state = state if key == at else start
                at = key
                found[i:j], state = fold(state, *(v[i:j] for v in values))
            yield part.assign(**{out: found})

    return ordered.mapInPandas(run, schema)


def _by_sums(rows: DataFrame, group: list[str], order: list[str], size: str, out: str, reach: Callable[[int, int, np.ndarray, int], tuple[int, int, int]], boundary: str | None = None) -> DataFrame:
    """A fold whose state is a number and the bytes held under it.

    reach(number, held, upto, i) tells how many rows from the i-th on share a
    number, which, and the bytes held after them, or -1 if the last closes it.
    upto are running sums, with upto[i] before row i.
    """

    def fold(state: tuple, sizes: np.ndarray, *bounds: np.ndarray) -> tuple[np.ndarray, tuple]:
        no, held, last = state
        sizes = sizes.astype(np.int64)
        upto = np.r_[0, np.cumsum(sizes)]
        found = np.empty(len(sizes), np.int64)
        i = 0
        ends = np.r_[np.flatnonzero(bounds[0][1:] != bounds[0][:-1]) + 1, len(sizes)] if bounds else np.array([len(sizes)])
        for end in ends.tolist():
            if bounds and last is not None and bounds[0][i] != last:
                no, held = (no + 1, 0) if held else (no, 0)
            while i < end:
                n, no, held = reach(no, held, upto[: end + 1], i)
                found[i : i + n] = no
                i += n
                if held < 0:  # closed by its last row
                    no, held = no + 1, 0
            last = bounds[0][end - 1] if bounds else None
        return found, (no, held, last)

    return _folded(rows, group, order, [size, *([boundary] if boundary else [])], out, (0, 0, None), fold)


def pack_greedy(rows: DataFrame, group: list[str], order: list[str], buffer: int, size: str = "n_bytes", boundary: str | None = None) -> DataFrame:
    """Adds ``pack``: rows fill a push buffer; one that does not fit opens the next, and one larger than the buffer goes alone.

    boundary: a column by which rows are ordered first; where it changes, what is held goes too.
    """

    def reach(no: int, held: int, upto: np.ndarray, i: int) -> tuple[int, int, int]:
        n = int(np.searchsorted(upto, upto[i] + buffer - held, side="right")) - 1 - i
        if n <= 0:
            if held:
                return reach(no + 1, 0, upto, i)
            n = 1
        return n, no, held + int(upto[i + n] - upto[i])

    return _by_sums(rows, group, order, size, "pack", reach, boundary)


def split_chunks(rows: DataFrame, group: list[str], order: list[str], chunk: int, size: str = "n_bytes") -> DataFrame:
    """Adds ``chunk_no``: a chunk ends with the write that reaches its boundary, and the next boundary counts from there."""

    def reach(no: int, held: int, upto: np.ndarray, i: int) -> tuple[int, int, int]:
        j = max(i + 1, int(np.searchsorted(upto, upto[i] + chunk - held, side="left")))
        return (j - i, no, -1) if j < len(upto) else (len(upto) - 1 - i, no, held + int(upto[-1] - upto[i]))

    return _by_sums(rows, group, order, size, "chunk_no", reach)


def flushes(rows: DataFrame, group: list[str], order: list[str], buffer: int, size: str = "n_bytes") -> DataFrame:
    """Adds ``flush``: what is buffered goes before a write that would fill the buffer; a write as large as the buffer goes by itself."""

    def reach(no: int, held: int, upto: np.ndarray, i: int) -> tuple[int, int, int]:
        n = int(np.searchsorted(upto, upto[i] + buffer - held, side="left")) - 1 - i
        if n <= 0:
            return reach(no + 1, 0, upto, i) if held else (1, no, -1)
        return n, no, held + int(upto[i + n] - upto[i])

    return _by_sums(rows, group, order, size, "flush", reach)


def spills(rows: DataFrame, group: list[str], order: list[str], records: int, limit: int, size: str = "n_bytes") -> DataFrame:
    """Adds ``spill``: a record first spills what is held, if that has so many records or so many bytes already."""

    def fold(state: tuple, sizes: np.ndarray) -> tuple[np.ndarray, tuple]:
        no, held, count = state
        upto = np.r_[0, np.cumsum(sizes.astype(np.int64))]
        found = np.empty(len(sizes), np.int64)
        i = 0
        while i < len(sizes):
            if count and (count >= records or held >= limit):
                no, held, count = no + 1, 0, 0
            by_bytes = max(i + 1, int(np.searchsorted(upto, upto[i] + limit - held, side="left")))
            j = min(len(sizes), i + records - count, by_bytes)
            found[i:j] = no
            held, count, i = held + int(upto[j] - upto[i]), count + j - i, j
        return found, (no, held, count)

    return _folded(rows, group, order, [size], "spill", (0, 0, 0), fold)


def rotate_epochs(rows: DataFrame, group: list[str], order: list[str], threshold: int, policy: str = "on_cross", size: str = "n_bytes") -> DataFrame:
    """Adds ``epoch``: a file rotates when its bytes pass the threshold.

    on_cross: the crossing batch is the last of its epoch. serial_push: one more
    batch lands in the file before its writer hears of the rotation.
    """
    if policy not in ("on_cross", "serial_push"):
        raise ValueError(policy)

    def reach(no: int, held: int, upto: np.ndarray, i: int) -> tuple[int, int, int]:
        if held > threshold:
            return 1, no, -1
        n = int(np.searchsorted(upto, upto[i] + threshold - held, side="right")) - i
        if i + n >= len(upto):
            return len(upto) - 1 - i, no, held + int(upto[-1] - upto[i])
        n = max(n, 1)
        return n, no, -1 if policy == "on_cross" else held + int(upto[i + n] - upto[i])

    return _by_sums(rows, group, order, size, "epoch", reach)


def rotate_groups(rows: DataFrame, group: list[str], order: list[str], member: str, threshold: int, size: str = "n_bytes") -> DataFrame:
    """Adds ``epoch``: files are those of a group's members, one each an epoch; the first that passes the threshold moves the whole group to its next epoch."""

    def fold(state: tuple, sizes: np.ndarray, members: np.ndarray) -> tuple[np.ndarray, tuple]:
        epoch, held = state[0], dict(state[1])
        found = np.empty(len(sizes), np.int64)
        i, step = 0, 256
        while i < len(sizes):
            n, m = sizes[i : i + step].astype(np.int64), members[i : i + step]
            o = np.argsort(m, kind="stable")
            first = np.r_[True, m[o][1:] != m[o][:-1]]
            sums = np.cumsum(n[o])
            start = np.flatnonzero(first)
            before = np.array([held.get(x, 0) for x in m[o][start].tolist()], np.int64) - np.r_[0, sums[start[1:] - 1]]
            upto = np.empty(len(n), np.int64)
            upto[o] = sums + np.repeat(before, np.diff(np.r_[start, len(n)]))
            over = np.flatnonzero(upto > threshold)
            if len(over):
                j = int(over[0]) + 1
                found[i : i + j], held, epoch, step = epoch, {}, epoch + 1, 256
            else:
                j = len(n)
                found[i : i + j] = epoch
                last = o[np.r_[start[1:] - 1, len(n) - 1]]
                held.update(zip(m[last].tolist(), upto[last].tolist(), strict=True))
                step *= 2
            i += j
        return found, (epoch, held)

    return _folded(rows, group, order, [size, member], "epoch", (0, {}), fold)


def effective_threshold(client: int, server: int) -> int:
    return max(client, server)


def valid_push(segments: DataFrame) -> DataFrame:
    """segments: (push_id, reducer_id, group_id, offset, n_bytes). (push_id, valid): all of one group, and without gaps from 0."""
    after = F.lag(F.col("offset") + F.col("n_bytes"), 1, 0).over(W.partitionBy("push_id").orderBy("offset", "reducer_id"))
    checked = segments.withColumn("__joined", F.col("offset") == after)
    return checked.groupBy("push_id").agg(((F.min("group_id") == F.max("group_id")) & F.bool_and("__joined")).alias("valid"))


def valid_arrays(pushes: DataFrame, reducers: str = "reducers", offsets: str = "offsets", lengths: str = "lengths", group_length: int = 1) -> DataFrame:
    """Adds ``valid`` to pushes of several segments: arrays of one length, not empty, segments without gaps from 0, and all reducers of one partition group."""
    n = F.size(offsets)
    same = (F.size(reducers) == n) & (F.size(lengths) == n) & (n > 0)
    ends = F.transform(offsets, lambda o, i: o + F.get(lengths, i))
    joined = F.forall(F.transform(offsets, lambda o, i: o == F.when(i == 0, 0).otherwise(F.get(ends, i - 1))), lambda ok: F.coalesce(ok, F.lit(False)))
    one = F.size(F.array_distinct(F.transform(reducers, lambda r: F.floor(r / group_length)))) == 1
    return pushes.withColumn("valid", F.coalesce(same & joined & one, F.lit(False)))

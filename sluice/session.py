"""One shuffle from registration to removal, as a Spark user drives it.

The session plans (groups, workers, epochs), writes batches as Parquet in a
folder of the shuffle, decides what a reader may see, and reads. What it holds is
metadata; rows stay in DataFrames and files.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.conf import Settings, size_bytes, time_ms
from sluice.model import EPOCH
from sluice.operators import assign, commit, lifecycle, pack, read
from sluice.sources import store


@dataclass
class Shuffle:
    key: str
    n_mappers: int
    n_reducers: int
    groups: DataFrame
    n_pairs: int
    schema: str = ""
    ends: DataFrame | None = None
    failed: DataFrame | None = None


@dataclass
class ShuffleSession:
    spark: SparkSession
    root: str
    app_id: str
    settings: Settings = field(default_factory=Settings)
    shuffles: dict[str, Shuffle] = field(default_factory=dict)

    def allocate(self, workers: DataFrame, partitions: int, load: str, name: str) -> DataFrame:
        """The workers for so many partitions: as many as the settings want, least loaded first."""
        return assign.allocate_workers(workers, partitions, load, name, self.settings.extra_ratio, self.settings.max_workers)

    def register(self, shuffle_id: int, n_mappers: int, n_reducers: int, n_workers: int) -> Shuffle:
        """Plans a shuffle's partition groups; registering again gives what was planned."""
        key = f"{self.app_id}-{shuffle_id}"
        if key not in self.shuffles:
            groups = assign.partition_groups(self.spark, n_reducers, self.settings.max_partitions_per_group, n_workers)
            self.shuffles[key] = Shuffle(key, n_mappers, n_reducers, groups, n_workers * (n_workers - 1) // 2)
        return self.shuffles[key]

    def reallocate(self, shuffle: Shuffle, failed: DataFrame) -> DataFrame:
        """failed: (group_id, epoch_id) that pushers saw. The groups, those of a current epoch moved to the next and to another pair of workers."""
        shuffle.groups = assign.reallocate(shuffle.groups, failed, shuffle.n_pairs)
        return shuffle.groups

    def packed(self, batches: DataFrame, order: list[str]) -> DataFrame:
        """Batches of each mapper by the packs they are pushed in: the buffer's size, and groups of partitions kept apart."""
        lengths = batches.withColumn("group_id", assign.group_of(F.col("reducer_id"), self.settings.max_partitions_per_group))
        return pack.pack_greedy(lengths, ["map_id", "attempt_id"], ["group_id", *order], size_bytes(self.settings.push_buffer), boundary="group_id")

    def spilled(self, batches: DataFrame, order: list[str]) -> DataFrame:
        """Batches of each mapper by the spills that its records and bytes force."""
        return pack.spills(batches, ["map_id", "attempt_id"], order, self.settings.spill_records, size_bytes(self.settings.spill_size))

    def rotated(self, batches: DataFrame, order: list[str]) -> DataFrame:
        """Batches by the epoch of their partition group: it moves when one of its files has grown too large."""
        groups = batches.withColumn("group_id", assign.group_of(F.col("reducer_id"), self.settings.max_partitions_per_group))
        return pack.rotate_groups(groups.drop("epoch_id"), ["group_id"], order, "reducer_id", size_bytes(self.settings.epoch_rotate)).withColumnRenamed("epoch", "epoch_id")

    def flushed(self, batches: DataFrame, order: list[str]) -> DataFrame:
        """Batches of each file by the writes that its buffer makes of them."""
        return pack.flushes(batches, list(EPOCH), order, size_bytes(self.settings.flush_buffer))

    def chunks(self, files: DataFrame) -> DataFrame:
        """The chunks in which files are fetched."""
        return read.chunk_table(files, size_bytes(self.settings.fetch_chunk))

    def live_workers(self, beats: DataFrame, key: str, now_ms: int) -> DataFrame:
        """Workers whose last beat is recent enough. beats: (key, ts in milliseconds)."""
        return lifecycle.alive(lifecycle.last_heartbeats(beats, key), now_ms, time_ms(self.settings.worker_timeout))

    def expired_apps(self, beats: DataFrame, now_ms: int) -> DataFrame:
        """Applications that were not heard of for too long. beats: (app_id, ts in milliseconds)."""
        return lifecycle.expired(lifecycle.last_heartbeats(beats, "app_id"), now_ms, time_ms(self.settings.app_timeout))

    def removable(self, unregistered: DataFrame, now_ms: int) -> DataFrame:
        """Shuffles whose removal has waited long enough. unregistered: (shuffle_key, ts in milliseconds)."""
        return lifecycle.removable(unregistered, now_ms, time_ms(self.settings.remove_delay))

    def write(self, shuffle: Shuffle, batches: DataFrame, ends: DataFrame, failed: DataFrame | None = None) -> None:
        """ends: (map_id, attempt_id, end_seq) of the mappers that ended; failed: pushes that are blacklisted."""
        shuffle.schema = ", ".join(f"{n} {t}" for n, t in batches.dtypes)
        shuffle.ends, shuffle.failed = ends, failed if self.settings.blacklist else None
        codec = "lz4_raw" if self.settings.codec == "lz4" else self.settings.codec
        store.write_batches(batches, store.shuffle_dir(self.root, shuffle.key), codec, self.settings.spill_records, self.settings.replicas)

    def _stored(self, shuffle: Shuffle) -> DataFrame:
        if not shuffle.schema:
            raise ValueError(f"nothing was written to {shuffle.key}")
        return self.spark.read.schema(shuffle.schema).parquet(store.shuffle_dir(self.root, shuffle.key))

    def status(self, shuffle: Shuffle, waited: str = "0s") -> str:
        """What a reader learns: RUNNING, TIMEOUT, DATA_LOST or FINISHED."""
        if shuffle.ends is None:
            ended, lost = shuffle.n_mappers == 0, 0
        else:
            won = commit.winning_attempts(shuffle.ends)
            ended = commit.all_ended(won, shuffle.n_mappers).first()["all_ended"]
            rows = self._stored(shuffle)
            there = rows.groupBy(*EPOCH).agg(F.sum("n_bytes").alias("file_length"))
            lost = commit.lost_epochs(commit.written_epochs(rows, won), there).count() if ended else 0
        told = commit.stage_status(F.lit(ended), F.lit(lost), F.lit(time_ms(waited)), time_ms(self.settings.stage_end_timeout))
        return self.spark.range(1).select(told.alias("s")).first()["s"]

    def read(self, shuffle: Shuffle, reducers: tuple[int, int] | None = None, maps: tuple[int, int] | None = None, split: tuple[int, int] | None = None) -> DataFrame:
        """Rows exactly once. An error while mappers have not all ended, or if files are lost."""
        told = self.status(shuffle)
        if told != "FINISHED":
            raise RuntimeError(f"{shuffle.key}: {told}")
        if shuffle.n_mappers == 0:
            return store.empty(self.spark, shuffle.schema or "reducer_id int, map_id int, batch_id bigint")
        return read.open_reader(self._stored(shuffle), commit.winning_attempts(shuffle.ends), shuffle.failed, reducers, maps, split)

    def destroy(self, shuffle: Shuffle) -> bool:
        """Removes a shuffle's files and forgets it; whether there were files."""
        self.shuffles.pop(shuffle.key, None)
        return bool(store.recycle(self.spark, self.root, [shuffle.key]))

    def stop(self) -> list[str]:
        """Removes the files of all the application's shuffles."""
        self.shuffles.clear()
        return store.recycle_app(self.spark, self.root, self.app_id)

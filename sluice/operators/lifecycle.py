"""What may be removed, and who is gone. Time is a parameter, never the clock."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def last_heartbeats(beats: DataFrame, key: str, ts: str = "ts") -> DataFrame:
    return beats.groupBy(key).agg(F.max(ts).alias("last"))


def expired(last: DataFrame, now: int, timeout: int) -> DataFrame:
    """Rows whose last beat is older than the timeout."""
    return last.where(F.col("last") < now - timeout)


def alive(last: DataFrame, now: int, timeout: int) -> DataFrame:
    return last.where(F.col("last") + timeout > now)


def expired_shuffles(reported: DataFrame, registered: DataFrame) -> DataFrame:
    """Shuffle keys that workers still report and no one registers."""
    return reported.select("shuffle_key").distinct().join(registered.select("shuffle_key"), "shuffle_key", "left_anti")


def expired_apps(finished: DataFrame, live: DataFrame, expiring: DataFrame) -> DataFrame:
    """Finished applications without a live shuffle or one that waits for removal."""
    return finished.select("app_id").distinct().join(live.select("app_id"), "app_id", "left_anti").join(expiring.select("app_id"), "app_id", "left_anti")


def removable(unregistered: DataFrame, now: int, delay: int) -> DataFrame:
    """unregistered: (shuffle_key, ts). Those whose delay is over."""
    return unregistered.where(F.col("ts") <= now - delay)


def live_addresses(assigned: DataFrame, workers: DataFrame) -> DataFrame:
    """Assigned (host, push_port) that a worker still serves."""
    return assigned.join(workers.select("host", "push_port"), ["host", "push_port"], "left_semi")

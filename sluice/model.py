"""Schemas of the dataflow's metadata."""

from __future__ import annotations

BATCHES = "shuffle_key string, reducer_id int, epoch_id int, map_id int, attempt_id int, batch_id bigint, n_bytes bigint, payload string"
ATTEMPTS = "shuffle_key string, map_id int, attempt_id int, end_seq bigint"
BLACKLIST = "shuffle_key string, reducer_id int, epoch_id int, map_id int, attempt_id int, batch_id bigint"
PARTITION_GROUPS = "shuffle_key string, group_id int, epoch_id int, start_partition int, end_partition int, workers array<string>"
WRITTEN_EPOCHS = "shuffle_key string, map_id int, attempt_id int, reducer_id int, epoch_id int"
COMMITTED = "shuffle_key string, reducer_id int, epoch_id int, replica int, host string, port int, mode string, file_path string, file_length bigint"
CHUNKS = "file_path string, chunk_idx int, start_off bigint, end_off bigint"
WORKERS = "name string, host string, rpc_port int, push_port int, fetch_port int, rtt_avg bigint, last_heartbeat bigint"
HEARTBEATS = "app_id string, ts bigint"

#: A batch, whatever file holds it.
BATCH_ID = ("reducer_id", "epoch_id", "map_id", "attempt_id", "batch_id")
EPOCH = ("reducer_id", "epoch_id")
#: Commit lengths: -1 says that closing the file failed, 0 that it is empty.
FAILED_LENGTH = -1

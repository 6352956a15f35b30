"""Queries over the dataflow's operators, each with the same result as SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.functions import codec, keys, units
from sluice.operators import assign, combine, commit, exchange, lifecycle, metrics, pack, read
from sluice.sources import store, workload
from sluice.streaming import exactly_once as streaming

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: The workload of sluice.sources.workload in SQL.
_WITH = """
WITH base AS (SELECT (event_id % 4)::INT AS map_id, 0 AS attempt_id, (user_id % 8)::INT AS reducer_id, 0 AS epoch_id, event_id AS batch_id, length(props)::BIGINT AS n_bytes, value FROM events),
batches AS (SELECT *, 0 AS copy FROM base UNION ALL SELECT *, 1 FROM base WHERE batch_id % 80 = 0
  UNION ALL SELECT * REPLACE (1 AS attempt_id), 0 FROM base WHERE batch_id % 50 = 0 UNION ALL SELECT * REPLACE (1 AS epoch_id), 0 FROM base WHERE batch_id % 90 = 0),
blacklist AS (SELECT * FROM base WHERE batch_id % 90 = 0),
won AS (SELECT * FROM batches WHERE attempt_id = 0),
good AS (SELECT * FROM won ANTI JOIN blacklist USING (reducer_id, epoch_id, map_id, attempt_id, batch_id)),
once AS (SELECT * FROM good QUALIFY row_number() OVER (PARTITION BY reducer_id, map_id, batch_id ORDER BY epoch_id, copy) = 1),
pos AS (SELECT reducer_id, epoch_id, row_number() OVER (ORDER BY reducer_id, epoch_id) - 1 AS position FROM (SELECT DISTINCT reducer_id, epoch_id FROM batches)),
files AS (SELECT reducer_id, epoch_id, sum(n_bytes) AS n, unnest([0, 1]) AS replica FROM batches GROUP BY reducer_id, epoch_id),
commits AS (SELECT reducer_id, epoch_id, replica, (reducer_id = 1 AND replica = 0) OR (reducer_id = 3 AND epoch_id = 1) AS broken,
  CASE WHEN (reducer_id = 1 AND replica = 0) OR (reducer_id = 3 AND epoch_id = 1) THEN -1 WHEN reducer_id = 5 AND epoch_id = 1 THEN 0 ELSE n END::BIGINT AS file_length,
  CASE WHEN NOT ((reducer_id = 1 AND replica = 0) OR (reducer_id = 3 AND epoch_id = 1)) THEN reducer_id || '-' || epoch_id || '-r' || replica || '-data' END AS file_path FROM files)
"""


def query(sql: str | None = None, workload_sql: bool = True):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = (_WITH if workload_sql else "") + sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _n(out: str = "n"):
    return F.count(F.lit(1)).alias(out)


def _money(c, out: str):
    return F.round(F.sum(c), 2).alias(out)


# Exchange and combine


@query("SELECT (l_orderkey % 16)::INT AS part, count(*) AS n, round(sum(l_extendedprice), 2) AS price FROM lineitem GROUP BY 1", False)
def exchange_modulo_counts(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(exchange.modulo_partition(F.col("l_orderkey"), 16).alias("part"), "l_extendedprice")
    return combine.combine_by_key(rows, ["part"], _n(), _money("l_extendedprice", "price"))


@query("SELECT CASE WHEN o_totalprice >= 400000 THEN 3 WHEN o_totalprice >= 250000 THEN 2 WHEN o_totalprice >= 100000 THEN 1 ELSE 0 END AS part, count(*) AS n, min(o_orderkey) AS first_key, max(o_orderkey) AS last_key FROM orders GROUP BY 1", False)
def exchange_range_counts(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(exchange.range_partition(F.col("o_totalprice"), [100_000, 250_000, 400_000]).alias("part"), "o_orderkey")
    return rows.groupBy("part").agg(_n(), F.min("o_orderkey").alias("first_key"), F.max("o_orderkey").alias("last_key"))


@query("SELECT count(*) AS n, count(DISTINCT o_custkey) AS customers, 0::BIGINT AS split_keys FROM orders", False)
def exchange_hash_colocates(spark, sf_dir):
    """Each key is in one partition of a hash exchange."""
    rows = exchange.hash_exchange(table(spark, sf_dir, "orders").select("o_custkey"), 16, "o_custkey").withColumn("p", F.spark_partition_id())
    per = rows.groupBy("o_custkey").agg(_n(), F.min("p").alias("a"), F.max("p").alias("b"))
    return per.agg(F.sum("n").alias("n"), _n("customers"), F.sum((F.col("a") != F.col("b")).cast("bigint")).alias("split_keys"))


@query("SELECT count(*) AS n, 0::BIGINT AS inversions FROM orders", False)
def exchange_range_sorted(spark, sf_dir):
    """A range exchange with sorted partitions orders the whole: no row precedes a lower key."""
    rows = exchange.range_exchange(table(spark, sf_dir, "orders").select("o_orderkey"), 8, "o_orderkey").withColumn("p", F.spark_partition_id())
    per = rows.groupBy("p").agg(_n(), F.min("o_orderkey").alias("low"), F.max("o_orderkey").alias("high"))
    from pyspark.sql import Window as W

    before = F.max("high").over(W.orderBy("p").rowsBetween(W.unboundedPreceding, -1))
    return per.withColumn("before", before).agg(F.sum("n").alias("n"), F.coalesce(F.sum((F.col("low") < F.col("before")).cast("bigint")), F.lit(0)).alias("inversions"))


@query("SELECT l_suppkey, sum(l_quantity) AS qty, count(*) AS n FROM lineitem GROUP BY 1", False)
def map_side_combine_sum(spark, sf_dir):
    return combine.combine_by_key(table(spark, sf_dir, "lineitem"), ["l_suppkey"], F.sum("l_quantity").alias("qty"), _n())


@query("SELECT o_custkey, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1", False)
def reduce_side_agg(spark, sf_dir):
    return combine.reduce_side(table(spark, sf_dir, "orders"), 16, ["o_custkey"], _n(), _money("o_totalprice", "total"))


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, sum(l_quantity) AS qty, min(l_extendedprice) AS least, max(l_extendedprice) AS most, round(avg(l_discount), 6) AS disc FROM lineitem GROUP BY 1, 2", False)
def combine_multi_agg(spark, sf_dir):
    return combine.combine_by_key(
        table(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus"],
        _n(), F.sum("l_quantity").alias("qty"), F.min("l_extendedprice").alias("least"), F.max("l_extendedprice").alias("most"), F.round(F.avg("l_discount"), 6).alias("disc"),
    )


@query("SELECT l_returnflag, sum(l_quantity) AS qty FROM lineitem GROUP BY 1", False)
def combine_salted_sum(spark, sf_dir):
    return combine.salted_sum(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_quantity", "qty")


@query("SELECT o_orderkey, (o_orderkey % 8)::INT AS part, row_number() OVER (PARTITION BY o_orderkey % 8 ORDER BY o_totalprice, o_orderkey) AS rank FROM orders", False)
def sort_within_partition_rank(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", exchange.modulo_partition(F.col("o_orderkey"), 8).alias("part"), "o_totalprice")
    return exchange.partition_rank(rows, "part", "o_totalprice", "o_orderkey").drop("o_totalprice")


@query("SELECT o_orderkey, ((row_number() OVER (PARTITION BY o_orderkey % 8 ORDER BY o_orderkey) - 1) % 3)::INT AS slot FROM orders", False)
def round_robin_placement(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", exchange.modulo_partition(F.col("o_orderkey"), 8).alias("part"))
    return exchange.round_robin(rows, 3, "part", "o_orderkey").drop("part")


@query("SELECT reducer_id, n_bytes, floor(coalesce(sum(n_bytes) OVER (ORDER BY reducer_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / 20000)::BIGINT AS task FROM (SELECT reducer_id, sum(n_bytes)::BIGINT AS n_bytes FROM batches GROUP BY 1)")
def coalesced_read_ranges(spark, sf_dir):
    sizes = workload.batches(spark, sf_dir).groupBy("reducer_id").agg(F.sum("n_bytes").alias("n_bytes"))
    return exchange.coalesced_ranges(sizes, 20_000)


# Packing


@query("SELECT batch_id, map_id, row_number() OVER (PARTITION BY map_id, attempt_id ORDER BY batch_id) AS batch_no FROM base")
def batch_ids(spark, sf_dir):
    return pack.batch_ids(workload.base_batches(spark, sf_dir), "batch_id").select("batch_id", "map_id", "batch_no")


@query("SELECT batch_id, sum(n_bytes) OVER (PARTITION BY map_id ORDER BY batch_id) - n_bytes AS start_off FROM base")
def frame_offsets(spark, sf_dir):
    return pack.frame_offsets(workload.base_batches(spark, sf_dir), ["map_id"], ["batch_id"]).select("batch_id", "start_off")


@query("SELECT batch_id, ((row_number() OVER (PARTITION BY map_id ORDER BY batch_id) - 1) // 100)::BIGINT AS run FROM base")
def spill_runs(spark, sf_dir):
    return pack.spill_runs(workload.base_batches(spark, sf_dir), ["map_id"], ["batch_id"], 100).select("batch_id", "run")


def _fold_sql(out: str, first: str, nxt: str) -> str:
    """A fold by recursion: (no, held, state); ``first`` and ``nxt`` give a row's (number, held after it, state after it)."""
    return f"""
, r AS (SELECT *, row_number() OVER (PARTITION BY map_id ORDER BY batch_id) AS rn FROM base),
f AS (WITH RECURSIVE f(map_id, rn, batch_id, no, held, st) AS (
  SELECT map_id, rn, batch_id, {first} FROM r WHERE rn = 1
  UNION ALL SELECT r.map_id, r.rn, r.batch_id, {nxt} FROM f JOIN r ON r.map_id = f.map_id AND r.rn = f.rn + 1) SELECT * FROM f)
SELECT batch_id, no::BIGINT AS {out} FROM f"""


def _folded(spark, sf_dir, fold, limit, **more):
    rows = workload.base_batches(spark, sf_dir).select("map_id", "batch_id", "n_bytes")
    return fold(rows, ["map_id"], ["batch_id"], limit, **more).drop("map_id", "n_bytes")


@query(_fold_sql("pack", "0::BIGINT, n_bytes, 0", "f.no + (f.held + r.n_bytes > 200)::INT, CASE WHEN f.held + r.n_bytes > 200 THEN r.n_bytes ELSE f.held + r.n_bytes END, 0"))
def batch_pack_greedy(spark, sf_dir):
    return _folded(spark, sf_dir, pack.pack_greedy, 200)


@query(_fold_sql("chunk_no", "0::BIGINT, CASE WHEN n_bytes >= 300 THEN 0 ELSE n_bytes END, (n_bytes >= 300)::INT", "f.no + f.st, CASE WHEN f.held + r.n_bytes >= 300 THEN 0 ELSE f.held + r.n_bytes END, (f.held + r.n_bytes >= 300)::INT"))
def chunk_split(spark, sf_dir):
    return _folded(spark, sf_dir, pack.split_chunks, 300)


@query(_fold_sql("flush", "0::BIGINT, n_bytes, 0", "f.no + (f.held + r.n_bytes >= 256)::INT, CASE WHEN f.held + r.n_bytes >= 256 THEN r.n_bytes ELSE f.held + r.n_bytes END, 0"))
def buffer_flush(spark, sf_dir):
    return _folded(spark, sf_dir, pack.flushes, 256)


@query(_fold_sql("epoch", "0::BIGINT, CASE WHEN n_bytes > 1000 THEN 0 ELSE n_bytes END, (n_bytes > 1000)::INT", "f.no + f.st, CASE WHEN f.held + r.n_bytes > 1000 THEN 0 ELSE f.held + r.n_bytes END, (f.held + r.n_bytes > 1000)::INT"))
def epoch_rotation(spark, sf_dir):
    return _folded(spark, sf_dir, pack.rotate_epochs, pack.effective_threshold(800, 1000))


@query(_fold_sql("epoch", "0::BIGINT, n_bytes, (n_bytes > 1000)::INT", "CASE WHEN f.st = 2 THEN f.no + 1 ELSE f.no END, CASE WHEN f.st = 1 THEN 0 WHEN f.st = 2 THEN r.n_bytes ELSE f.held + r.n_bytes END, CASE WHEN f.st = 1 THEN 2 WHEN f.st = 2 THEN (r.n_bytes > 1000)::INT ELSE (f.held + r.n_bytes > 1000)::INT END"))
def epoch_rotation_serial(spark, sf_dir):
    return _folded(spark, sf_dir, pack.rotate_epochs, 1000, policy="serial_push")


@query("SELECT map_id AS push_id, count(DISTINCT reducer_id // 4) = 1 AS valid FROM base GROUP BY 1")
def push_validation(spark, sf_dir):
    rows = pack.frame_offsets(workload.base_batches(spark, sf_dir), ["map_id"], ["batch_id"]).withColumnRenamed("start_off", "offset")
    segments = rows.select(F.col("map_id").alias("push_id"), "reducer_id", assign.group_of(F.col("reducer_id"), 4).alias("group_id"), "offset", "n_bytes")
    return pack.valid_push(segments)


# Assignment

_GROUPS = "SELECT i::INT AS group_id, 0 AS epoch_id, (i * 66)::INT AS start_partition, least((i + 1) * 66, 1002)::INT AS end_partition, (i % 15)::INT AS pair FROM range(16) t(i)"


@query(_GROUPS, False)
def group_assignment(spark, sf_dir):
    return assign.partition_groups(spark, 1002, 1000, 6)


@query("SELECT a.r_name AS a, b.r_name AS b FROM region a JOIN region b ON a.r_regionkey < b.r_regionkey", False)
def replica_tuples(spark, sf_dir):
    """Pairs grow with the square of the workers; both queries take a table that is small as a whole."""
    return assign.replica_pairs(table(spark, sf_dir, "region").select("r_regionkey", "r_name"), "r_regionkey", "r_name")


@query("SELECT a.n_name AS a, b.n_name AS b FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey", False)
def replica_tuples_whole(spark, sf_dir):
    """Over a table that is small as a whole."""
    return assign.replica_pairs(table(spark, sf_dir, "nation").select("n_nationkey", "n_name"), "n_nationkey", "n_name")


@query(f"SELECT group_id, epoch_id + (group_id % 3 = 0)::INT AS epoch_id, start_partition, end_partition, pair FROM ({_GROUPS})", False)
def group_reallocate(spark, sf_dir):
    groups = assign.partition_groups(spark, 1002, 1000, 6)
    failed = groups.select("group_id", F.when(F.col("group_id") % 3 == 0, 0).otherwise(-1).alias("epoch_id"))
    return assign.reallocate(groups, failed)


@query("SELECT s_suppkey, s_name FROM supplier ORDER BY s_acctbal, s_suppkey LIMIT 7", False)
def worker_topk(spark, sf_dir):
    return assign.least_loaded(table(spark, sf_dir, "supplier"), 7, "s_acctbal", "s_suppkey").select("s_suppkey", "s_name")


@query("SELECT reducer_id, group_id, start_partition, end_partition FROM (SELECT DISTINCT reducer_id, reducer_id // 3 AS group_id FROM base), LATERAL (SELECT group_id * 3 AS start_partition, least(group_id * 3 + 3, 8) AS end_partition)")
def reducer_group_lookup(spark, sf_dir):
    groups = spark.range(3).select(F.col("id").cast("int").alias("group_id"), (F.col("id") * 3).cast("int").alias("start_partition"), F.least(F.col("id") * 3 + 3, F.lit(8)).cast("int").alias("end_partition"))
    reducers = workload.base_batches(spark, sf_dir).select("reducer_id").distinct()
    return reducers.withColumn("group_id", assign.group_of(F.col("reducer_id"), 3)).join(groups, "group_id").select("reducer_id", "group_id", "start_partition", "end_partition")


# Commit

_ENDS = ", ends AS (SELECT (event_id % 4)::INT AS map_id, (user_id % 3)::INT AS attempt_id, event_id AS end_seq FROM events)"


def _ends(spark, sf_dir):
    e = workload.events(spark, sf_dir)
    return e.select(F.pmod("event_id", F.lit(4)).cast("int").alias("map_id"), F.pmod("user_id", F.lit(3)).cast("int").alias("attempt_id"), F.col("event_id").alias("end_seq"))


@query(_ENDS + " SELECT map_id, arg_min(attempt_id, end_seq) AS attempt_id FROM ends GROUP BY 1")
def winning_attempts(spark, sf_dir):
    return commit.winning_attempts(_ends(spark, sf_dir))


@query(_ENDS + " SELECT count(DISTINCT map_id) AS ended, count(DISTINCT map_id) = 4 AS all_ended FROM ends")
def all_mappers_ended(spark, sf_dir):
    return commit.all_ended(commit.winning_attempts(_ends(spark, sf_dir)), 4)


@query("SELECT DISTINCT reducer_id, epoch_id FROM won")
def written_epochs(spark, sf_dir):
    return commit.written_epochs(workload.batches(spark, sf_dir), workload.attempts(spark))


@query("SELECT DISTINCT reducer_id, epoch_id FROM won ANTI JOIN (SELECT * FROM commits WHERE file_length >= 0) USING (reducer_id, epoch_id)")
def data_loss_check(spark, sf_dir):
    written = commit.written_epochs(workload.batches(spark, sf_dir), workload.attempts(spark))
    return commit.lost_epochs(written, workload.commits(spark, sf_dir))


@query("SELECT i::INT AS reducer_id, coalesce(string_agg(epoch_id || '/' || replica || '/' || file_path || '/' || file_length, ' ' ORDER BY epoch_id, replica), '') AS files FROM range(10) t(i) LEFT JOIN (SELECT * FROM commits WHERE file_length > 0) c ON c.reducer_id = i GROUP BY 1")
def file_groups(spark, sf_dir):
    out = commit.file_groups(workload.commits(spark, sf_dir), 10)
    told = F.transform("files", lambda f: F.concat_ws("/", f["epoch_id"].cast("string"), f["replica"].cast("string"), f["file_path"], f["file_length"].cast("string")))
    return out.select("reducer_id", F.array_join(told, " ").alias("files"))


@query("SELECT i AS id, CASE WHEN i % 2 = 0 AND i * 100 > 600 THEN 'TIMEOUT' WHEN i % 2 = 0 THEN 'RUNNING' WHEN i % 3 > 0 THEN 'DATA_LOST' ELSE 'FINISHED' END AS status FROM range(24) t(i)", False)
def stage_status(spark, sf_dir):
    i = F.col("id")
    return spark.range(24).select("id", commit.stage_status(i % 2 != 0, i % 3, i * 100, 600).alias("status"))


@query("SELECT reducer_id, epoch_id, replica, file_path, file_length FROM commits WHERE file_length > 0 QUALIFY row_number() OVER (PARTITION BY reducer_id, epoch_id ORDER BY replica) = 1")
def replica_choice(spark, sf_dir):
    return read.choose_replica(workload.commits(spark, sf_dir)).select("reducer_id", "epoch_id", "replica", "file_path", "file_length")


@query(", c AS (SELECT batch_id, unnest([(batch_id % 40 = 0)::INT, CASE WHEN batch_id % 70 = 0 THEN 9 ELSE (batch_id % 60 = 0)::INT END]) AS code FROM base) SELECT batch_id, sum(code)::BIGINT AS code_sum, count(*) AS answers, sum(code) <= 2 AS ok, sum(code) BETWEEN 1 AND 2 AS rotate FROM c GROUP BY 1")
def write_all_success(spark, sf_dir):
    b = F.col("batch_id")
    code = F.array((b % 40 == 0).cast("int"), F.when(b % 70 == 0, 9).otherwise((b % 60 == 0).cast("int")))
    return commit.write_succeeded(workload.base_batches(spark, sf_dir).select("batch_id", F.posexplode(code).alias("replica", "code")))


@query("SELECT count(*) AS n_files, sum(n)::BIGINT AS n_bytes FROM (SELECT max(file_length) AS n FROM commits WHERE file_length >= 0 GROUP BY reducer_id, epoch_id)")
def store_totals(spark, sf_dir):
    return metrics.store_totals(workload.commits(spark, sf_dir))


# Reading


@query("SELECT map_id, reducer_id, epoch_id, count(*) AS n FROM won GROUP BY ALL")
def attempt_filter(spark, sf_dir):
    return read.attempt_filter(workload.batches(spark, sf_dir), workload.attempts(spark)).groupBy("map_id", "reducer_id", "epoch_id").agg(_n())


@query("SELECT map_id, attempt_id, reducer_id, epoch_id, count(*) AS n FROM batches ANTI JOIN blacklist USING (reducer_id, epoch_id, map_id, attempt_id, batch_id) GROUP BY ALL")
def blacklist_filter(spark, sf_dir):
    kept = read.blacklist_filter(workload.batches(spark, sf_dir), workload.blacklist(spark, sf_dir))
    return kept.groupBy("map_id", "attempt_id", "reducer_id", "epoch_id").agg(_n())


@query("SELECT map_id, batch_id, epoch_id, copy FROM batches WHERE map_id >= 1 AND map_id < 3 AND reducer_id BETWEEN 2 AND 5")
def map_range_read(spark, sf_dir):
    return read.reducer_range(read.map_range(workload.batches(spark, sf_dir), 1, 3), 2, 6).select("map_id", "batch_id", "epoch_id", "copy")


@query("SELECT reducer_id, count(*) AS n, round(sum(value), 2) AS total FROM once GROUP BY 1")
def dedup_read_sum(spark, sf_dir):
    once = read.exactly_once(workload.batches(spark, sf_dir), workload.attempts(spark), workload.blacklist(spark, sf_dir))
    return once.groupBy("reducer_id").agg(_n(), _money("value", "total"))


@query("SELECT reducer_id, map_id, batch_id, epoch_id, n_bytes FROM once WHERE map_id < 3")
def exactly_once_read(spark, sf_dir):
    once = read.exactly_once(workload.batches(spark, sf_dir), workload.attempts(spark), workload.blacklist(spark, sf_dir), (0, 3))
    return once.select("reducer_id", "map_id", "batch_id", "epoch_id", "n_bytes")


@query("SELECT reducer_id, epoch_id, map_id, batch_id FROM once JOIN pos USING (reducer_id, epoch_id) WHERE position % 3 = 1")
def skew_split_read(spark, sf_dir):
    part = read.split_read(workload.batches(spark, sf_dir), 3, 1)
    return read.exactly_once(part, workload.attempts(spark), workload.blacklist(spark, sf_dir)).select("reducer_id", "epoch_id", "map_id", "batch_id")


@query("SELECT count(*) AS n, round(sum(value), 2) AS total FROM base")
def split_read_union_equals_whole(spark, sf_dir):
    rows = read.with_reader(workload.batches(spark, sf_dir), 2)
    return read.exactly_once(rows, workload.attempts(spark), workload.blacklist(spark, sf_dir), stream=["reducer_id", "reader"]).agg(_n(), _money("value", "total"))


@query(", w AS (SELECT DISTINCT position % 2 AS reader, reducer_id, map_id, batch_id, value FROM won JOIN pos USING (reducer_id, epoch_id)) SELECT count(*) AS n, round(sum(value), 2) AS total FROM w")
def split_read_without_blacklist(spark, sf_dir):
    """Readers remove duplicates each for itself: copies in two epochs stay."""
    rows = read.with_reader(workload.batches(spark, sf_dir), 2)
    return read.exactly_once(rows, workload.attempts(spark), None, stream=["reducer_id", "reader"]).agg(_n(), _money("value", "total"))


@query("SELECT count(*) AS n, round(sum(value), 2) AS total FROM base")
def stream_exactly_once(spark, sf_dir):
    return streaming.dedup_stream_totals(spark, sf_dir)


@query("SELECT reducer_id, count(*) AS n, round(sum(value), 2) AS total FROM base GROUP BY 1")
def stream_exactly_once_whole(spark, sf_dir):
    return streaming.dedup_stream_by_reducer(spark, sf_dir)


# Life cycle


_LAST = ", last AS (SELECT user_id, max(ts) AS m FROM events GROUP BY 1), now AS (SELECT max(ts) AS t FROM events)"


def _last(spark, sf_dir):
    beats = workload.events(spark, sf_dir).select("user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("ts"))
    return lifecycle.last_heartbeats(beats, "user_id"), beats.agg(F.max("ts")).first()[0]


@query(_LAST + " SELECT user_id FROM last, now WHERE epoch_us(m) < epoch_us(t) - 864000000000")
def expired_workers(spark, sf_dir):
    last, now = _last(spark, sf_dir)
    return lifecycle.expired(last, now, 10 * 86_400_000_000).select("user_id")


@query("SELECT DISTINCT 'app-' || (user_id % 50) || '-' || (event_id % 7) AS shuffle_key FROM events WHERE user_id % 50 >= 20 OR event_id % 7 >= 3", False)
def expired_shuffles(spark, sf_dir):
    e = workload.events(spark, sf_dir)
    key = keys.shuffle_key(F.concat(F.lit("app-"), (F.col("user_id") % 50).cast("string")), F.col("event_id") % 7)
    registered = spark.range(20).crossJoin(spark.range(3).withColumnRenamed("id", "s")).select(keys.shuffle_key(F.concat(F.lit("app-"), F.col("id").cast("string")), F.col("s")).alias("shuffle_key"))
    return lifecycle.expired_shuffles(e.select(key.alias("shuffle_key")), registered)


@query("SELECT DISTINCT user_id % 100 AS app_id FROM events WHERE user_id % 100 % 3 > 0 AND user_id % 100 % 5 > 0", False)
def expired_apps(spark, sf_dir):
    apps = workload.events(spark, sf_dir).select((F.col("user_id") % 100).alias("app_id"))
    return lifecycle.expired_apps(apps, apps.where("app_id % 3 = 0"), apps.where("app_id % 5 = 0"))


@query("SELECT 'app-' || user_id || '-' || event_id AS shuffle_key FROM events, (SELECT max(event_id) AS m FROM events) WHERE event_id <= m - 60", False)
def removable_shuffles(spark, sf_dir):
    e = workload.events(spark, sf_dir).select(keys.shuffle_key(F.concat(F.lit("app-"), F.col("user_id").cast("string")), F.col("event_id")).alias("shuffle_key"), F.col("event_id").alias("ts"))
    return lifecycle.removable(e, e.agg(F.max("ts")).first()[0] or 0, 60).select("shuffle_key")


# Scalars


@query("SELECT event_id, 'app-' || (user_id % 9) AS app, (event_id % 11)::INT AS shuffle, user_id % 9 = 1 AS of_app_1, (user_id % 8) || '-' || 0 AS epoch_key FROM events", False)
def key_parse(spark, sf_dir):
    e = workload.events(spark, sf_dir).withColumn("key", keys.shuffle_key(F.concat(F.lit("app-"), (F.col("user_id") % 9).cast("string")), F.col("event_id") % 11))
    return e.select("event_id", keys.app_of(F.col("key")).alias("app"), keys.shuffle_of(F.col("key")).alias("shuffle"), keys.of_app(F.col("key"), "app-1").alias("of_app_1"), keys.epoch_key(F.col("user_id") % 8, F.lit(0)).alias("epoch_key"))


@query("SELECT event_id, part * 1099511627776 + page * 134217728 + off AS pointer, part, page, off FROM (SELECT event_id, event_id % 8388608 AS part, user_id % 8192 AS page, event_id * 7 % 134217728 AS off FROM events)", False)
def pointer_pack(spark, sf_dir):
    # As values: a partition whose pointer is positive, and an offset in a page.
    part, off = F.pmod("event_id", F.lit(1 << keys.PARTITION_BITS - 1)), F.pmod(F.col("event_id") * 7, F.lit(1 << keys.OFFSET_BITS))
    packed = workload.events(spark, sf_dir).select("event_id", keys.pack_pointer(part, F.pmod("user_id", F.lit(1 << keys.PAGE_BITS)), off).alias("pointer"))
    return packed.select("event_id", "pointer", *(c.alias(n) for c, n in zip(keys.unpack_pointer(F.col("pointer")), ("part", "page", "off"), strict=True)))


@query("SELECT i AS id, i * [1, 1024, 1048576, 1073741824][(i % 4 + 1)::INT] AS bytes, i * [1, 1000, 60000, 86400000][(i % 4 + 1)::INT] AS ms FROM range(1, 200) t(i)", False)
def size_parse(spark, sf_dir):
    i = F.col("id")
    pick = lambda *u: F.element_at(F.array(*map(F.lit, u)), (i % 4 + 1).cast("int"))
    rows = spark.range(1, 200).select("id", F.concat(i.cast("string"), pick("b", "kb", "m", "G")).alias("s"), F.concat(i.cast("string"), pick("ms", "s", "min", "d")).alias("t"))
    return rows.select("id", units.size_bytes(F.col("s")).alias("bytes"), units.time_ms(F.col("t")).alias("ms"))


@query("SELECT s_suppkey, 'host-' || s_suppkey AS host, (9000 + s_suppkey % 1000)::INT AS port FROM supplier", False)
def address_parse(spark, sf_dir):
    url = F.concat(F.lit("sluice://host-"), F.col("s_suppkey").cast("string"), F.lit(":"), (9000 + F.col("s_suppkey") % 1000).cast("string"))
    host, port = units.address(url)
    return table(spark, sf_dir, "supplier").select("s_suppkey", host.alias("host"), port.alias("port"))


@query("SELECT event_id, json_extract(props, '$.k')::BIGINT AS k, '{\"name\":\"w' || user_id || '\",\"rtt\":' || event_id || '}' AS told FROM events", False)
def worker_json_roundtrip(spark, sf_dir):
    e = workload.events(spark, sf_dir)
    worker = F.to_json(F.struct(F.concat(F.lit("w"), F.col("user_id").cast("string")).alias("name"), F.col("event_id").alias("rtt")))
    back = F.from_json(worker, "name string, rtt bigint")
    return e.select("event_id", F.get_json_object("props", "$.k").cast("bigint").alias("k"), F.to_json(back).alias("told"))


# Metrics and storage


@query("SELECT map_id, reducer_id, count(*) AS n_batches, sum(n_bytes)::BIGINT AS n_bytes FROM batches GROUP BY ALL")
def partition_size_stats(spark, sf_dir):
    return metrics.partition_sizes(workload.batches(spark, sf_dir))


@query("SELECT reducer_id, count(*) AS n, sum(n_bytes)::BIGINT AS total, min(n_bytes) AS least, max(n_bytes) AS most FROM batches GROUP BY 1")
def size_profile(spark, sf_dir):
    return metrics.size_profile(workload.batches(spark, sf_dir), "reducer_id", "n_bytes").drop("quartiles")


@query("SELECT lang, count(*) AS n, sum(strlen(text))::BIGINT AS raw_bytes, 0::BIGINT AS damaged FROM documents GROUP BY 1", False)
def codec_size_stats(spark, sf_dir):
    """Blocks come back as they were; ``codec_lz4_sizes`` tells what they take."""
    docs = table(spark, sf_dir, "documents").select("lang", F.col("text").cast("binary").alias("raw"))
    back = docs.withColumn("back", codec.decompressed(codec.compressed(F.col("raw"), "zstd")))
    return back.groupBy("lang").agg(_n(), F.sum(F.octet_length("raw").cast("bigint")).alias("raw_bytes"), F.sum((F.col("raw") != F.col("back")).cast("bigint")).alias("damaged"))


@query("SELECT reducer_id, epoch_id, count(*) AS n, sum(n_bytes)::BIGINT AS n_bytes FROM batches WHERE reducer_id BETWEEN 2 AND 5 GROUP BY ALL")
def store_roundtrip(spark, sf_dir):
    path = streaming.scratch(spark, "store")
    rows = workload.batches(spark, sf_dir)
    store.write_batches(rows, path)
    schema = ", ".join(f"{n} {t}" for n, t in rows.dtypes)
    return store.read_reducers(spark, path, schema, 2, 6).groupBy("reducer_id", "epoch_id").agg(_n(), F.sum("n_bytes").alias("n_bytes"))


# Host workloads that ride on the exchange


@query("SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc, round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 2) AS sum_charge, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2", False)
def host_pricing_summary(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").where("l_shipdate <= timestamp_ntz'1998-09-02'")
    net = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return li.groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("sum_qty"), _money("l_extendedprice", "sum_base"), _money(net, "sum_disc"), _money(net * (1 + F.col("l_tax")), "sum_charge"), _n())


@query("SELECT l_orderkey, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, o_orderdate FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey WHERE c_mktsegment = 'BUILDING' GROUP BY l_orderkey, o_orderdate ORDER BY revenue DESC, l_orderkey LIMIT 10", False)
def host_order_revenue_topk(spark, sf_dir):
    c = table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select("c_custkey")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("net"))
    joined = o.join(c, F.col("o_custkey") == F.col("c_custkey"), "left_semi").join(li, F.col("l_orderkey") == F.col("o_orderkey"))
    return joined.groupBy("l_orderkey", "o_orderdate").agg(_money("net", "revenue")).orderBy(F.desc("revenue"), "l_orderkey").limit(10)


@query("SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey AND c_nationkey = s_nationkey JOIN nation ON s_nationkey = n_nationkey GROUP BY 1", False)
def host_local_supplier_volume(spark, sf_dir):
    t = lambda n: table(spark, sf_dir, n)
    rows = t("customer").join(t("orders"), F.col("c_custkey") == F.col("o_custkey")).join(t("lineitem"), F.col("l_orderkey") == F.col("o_orderkey"))
    rows = rows.join(t("supplier"), (F.col("l_suppkey") == F.col("s_suppkey")) & (F.col("c_nationkey") == F.col("s_nationkey"))).join(t("nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return rows.groupBy("n_name").agg(_money(F.col("l_extendedprice") * (1 - F.col("l_discount")), "revenue"))


@query("SELECT s_nationkey, count(*) AS n, sum(l_quantity) AS qty FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1", False)
def host_skewed_join(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_quantity")
    # Combined before the join: what is left of a hot key is a row.
    per = li.groupBy("l_suppkey").agg(F.sum("l_quantity").alias("q"), _n("c"))
    return per.join(table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey")).groupBy("s_nationkey").agg(F.sum("c").alias("n"), F.sum("q").alias("qty"))


@query("SELECT o_orderpriority, count(*) AS n FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 45) GROUP BY 1", False)
def host_semi_join(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").where("l_quantity > 45").select("l_orderkey")
    return table(spark, sf_dir, "orders").join(li, F.col("o_orderkey") == F.col("l_orderkey"), "left_semi").groupBy("o_orderpriority").agg(_n())


@query("SELECT c_mktsegment, count(*) AS n FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) GROUP BY 1", False)
def host_anti_join(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_custkey")
    return table(spark, sf_dir, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left_anti").groupBy("c_mktsegment").agg(_n())


@query("SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)", False)
def host_rollup(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").rollup("l_returnflag", "l_linestatus").agg(_n())


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) <= 2", False)
def host_window_topk(spark, sf_dir):
    from pyspark.sql import Window as W

    rn = F.row_number().over(W.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey"))
    return table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice").withColumn("rn", rn).where("rn <= 2").drop("rn")

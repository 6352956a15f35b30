"""Queries over the operators that stand around a shuffle: readers, packs by group, registry, sessions, codecs, faults."""

from __future__ import annotations

from pyspark.sql import functions as F

from sluice.functions import codec, keys, units
from sluice.operators import assign, commit, exchange, faults, lifecycle, metrics, pack, read
from sluice.plans.catalogue import _ENDS, _LAST, _ends, _folded, _last, _money, _n, query, table
from sluice.session import ShuffleSession
from sluice.sources import frames, registry, store, workload
from sluice.streaming.exactly_once import scratch


def _schema(df) -> str:
    return ", ".join(f"{n} {t}" for n, t in df.dtypes)


# Reading


@query(
    """, lost AS (SELECT reducer_id, count(*) AS n FROM (SELECT DISTINCT reducer_id, epoch_id FROM won) ANTI JOIN (SELECT * FROM commits WHERE file_length >= 0) USING (reducer_id, epoch_id) GROUP BY 1)
SELECT i::INT AS reducer_id, CASE WHEN lost.n > 0 THEN 'DATA_LOST' ELSE 'FINISHED' END AS status,
  CASE WHEN lost.n > 0 THEN 0 ELSE (SELECT count(*) FROM commits c WHERE c.reducer_id = i AND file_length > 0) END AS n_files
FROM range(8) t(i) LEFT JOIN lost ON lost.reducer_id = i"""
)
def file_lookup(spark, sf_dir):
    """Files of each reducer, once the stage has ended and only if none of its files is lost."""
    ends = workload.attempts(spark).withColumn("end_seq", F.col("map_id").cast("bigint"))
    found = commit.lookup(ends, workload.batches(spark, sf_dir), workload.commits(spark, sf_dir), workload.MAPPERS, workload.REDUCERS)
    return found.select("reducer_id", "status", F.size("files").cast("bigint").alias("n_files"))


@query(
    """SELECT 'whole' AS kind, count(*) AS n, round(coalesce(sum(value), 0), 2) AS total FROM once UNION ALL
SELECT 'maps', count(*), round(coalesce(sum(value), 0), 2) FROM once WHERE map_id >= 1 AND map_id < 3 UNION ALL
SELECT 'split', count(*), round(coalesce(sum(value), 0), 2) FROM once JOIN pos USING (reducer_id, epoch_id) WHERE position % 4 = 2 UNION ALL
SELECT 'none', 0, 0"""
)
def reader_kinds(spark, sf_dir):
    """One reader for whole reducers, a range of mappers, a part of a split, and a shuffle without mappers."""
    rows, won, bad = workload.batches(spark, sf_dir), workload.attempts(spark), workload.blacklist(spark, sf_dir)
    kinds = {"whole": {}, "maps": {"maps": (1, 3)}, "split": {"split": (4, 2)}, "none": {"n_mappers": 0}}
    out = None
    for kind, how in kinds.items():
        total = read.open_reader(rows, won, bad, **how).agg(_n(), F.round(F.coalesce(F.sum("value"), F.lit(0.0)), 2).alias("total")).withColumn("kind", F.lit(kind))
        out = total if out is None else out.unionByName(total)
    return out


@query("SELECT map_id, attempt_id, batch_id, n_bytes FROM base")
def frame_scan(spark, sf_dir):
    """Frames of a file's batches come back one by one."""
    e = workload.events(spark, sf_dir)
    body = F.col("props").cast("binary")
    one = e.select(
        F.concat_ws("-", F.pmod("user_id", F.lit(8)).cast("string"), F.floor(F.col("event_id") / 64).cast("string")).alias("path"),
        F.struct("event_id", frames.framed(F.pmod("event_id", F.lit(4)), F.lit(0), F.col("event_id"), body).alias("f")).alias("f"),
    )
    # At most 64 frames a file.
    files = one.groupBy("path").agg(F.sort_array(F.collect_list("f")).alias("fs")).select("path", F.unhex(F.array_join(F.transform("fs", lambda f: F.hex(f["f"])), "")).alias("content"))
    return frames.read_frames(files).select("map_id", "attempt_id", "batch_id", F.octet_length("body").cast("bigint").alias("n_bytes"))


@query(
    """SELECT file_path, i::INT AS chunk_idx, (i * 4096)::BIGINT AS start_off, least((i + 1) * 4096, file_length)::BIGINT AS end_off
FROM (SELECT file_path, file_length, unnest(range(0, (file_length + 4095) // 4096)) AS i FROM commits WHERE file_length > 0) WHERE i >= 2"""
)
def chunk_restart(spark, sf_dir):
    """A file's chunks from the third on, as a reader asks for that lost its server after two."""
    chunks = read.chunk_table(commit.readable(workload.commits(spark, sf_dir)), 4096)
    return read.chunks_from(chunks, 2).select("file_path", "chunk_idx", "start_off", "end_off")


@query("SELECT map_id, batch_id, n_bytes FROM batches WHERE reducer_id = 2 AND epoch_id = 1")
def epoch_read(spark, sf_dir):
    """One file of a stored shuffle, for another engine's reader."""
    rows, path = workload.batches(spark, sf_dir), scratch(spark, "epoch")
    store.write_batches(rows, path)
    return store.read_epoch(spark, path, _schema(rows), 2, 1).select("map_id", "batch_id", "n_bytes")


@query("SELECT reducer_id, batch_id FROM batches WHERE false")
def empty_shuffle(spark, sf_dir):
    """A shuffle without mappers has no rows and its columns."""
    return store.empty(spark, _schema(workload.batches(spark, sf_dir))).select("reducer_id", "batch_id")


@query("SELECT reducer_id, epoch_id, replica, reducer_id || '-' || epoch_id || '-r' || replica || '-data' AS name FROM commits")
def file_names(spark, sf_dir):
    return workload.commits(spark, sf_dir).select("reducer_id", "epoch_id", "replica", keys.file_name(F.col("reducer_id"), F.col("epoch_id"), F.col("replica")).alias("name"))


@query("SELECT event_id, 'app-' || (user_id % 9) || '-3-' || (event_id % 4) || '-0' AS mapper, 'app-' || (user_id % 9) || '-3-' || (user_id % 8 // 4) || '-1' AS grp FROM events", False)
def mapper_and_group_keys(spark, sf_dir):
    key = keys.shuffle_key(F.concat(F.lit("app-"), (F.col("user_id") % 9).cast("string")), F.lit(3))
    e = workload.events(spark, sf_dir)
    return e.select("event_id", keys.mapper_key(key, F.col("event_id") % 4, F.lit(0)).alias("mapper"), keys.group_key(key, assign.group_of(F.col("user_id") % 8, 4), F.lit(1)).alias("grp"))


# Writing


@query("SELECT map_id * 2 + reducer_id // 4 AS push_id, map_id NOT IN (1, 2) AS valid FROM (SELECT DISTINCT map_id, reducer_id FROM base) GROUP BY map_id, reducer_id // 4")
def push_arrays_validation(spark, sf_dir):
    """Pushes of one group's segments are valid; those with a gap (mapper 1) and with a length too few (mapper 2) are not."""
    sizes = workload.base_batches(spark, sf_dir).withColumn("group_id", assign.group_of(F.col("reducer_id"), 4)).groupBy("map_id", "group_id", "reducer_id").agg(F.sum("n_bytes").alias("n"))
    # At most four segments a push.
    per = sizes.groupBy("map_id", "group_id").agg(F.sort_array(F.collect_list(F.struct("reducer_id", "n"))).alias("s"))
    before = F.transform("s", lambda _, i: F.aggregate(F.slice("s", 1, i), F.lit(0).cast("bigint"), lambda a, x: a + x["n"]))
    lengths = F.transform("s", lambda x: x["n"])
    pushes = per.select(
        (F.col("map_id") * 2 + F.col("group_id")).alias("push_id"), F.transform("s", lambda x: x["reducer_id"]).alias("reducers"),
        F.when(F.col("map_id") == 1, F.transform(before, lambda o: o + 1)).otherwise(before).alias("offsets"),
        F.when(F.col("map_id") == 2, F.slice(lengths, 1, F.size(lengths) - 1)).otherwise(lengths).alias("lengths"),
    )
    return pack.valid_arrays(pushes, group_length=4).select("push_id", "valid")


@query("SELECT reducer_id, count(*) AS n, sum(n_bytes)::BIGINT AS n_bytes FROM base GROUP BY 1")
def dfs_placement(spark, sf_dir):
    """Files placed with a replication and without the file system's checksums hold the same rows."""
    rows, path = workload.base_batches(spark, sf_dir), scratch(spark, "dfs")
    store.write_batches(rows, path, replication=2, checksums=False)
    return store.read_reducers(spark, path, _schema(rows), 0, workload.REDUCERS).groupBy("reducer_id").agg(_n(), F.sum("n_bytes").alias("n_bytes"))


_PACK_GROUPS = """
, r AS (SELECT *, reducer_id // 4 AS g, row_number() OVER (PARTITION BY map_id ORDER BY reducer_id // 4, batch_id) AS rn FROM base),
f AS (WITH RECURSIVE f(map_id, rn, batch_id, g, no, held) AS (
  SELECT map_id, rn, batch_id, g, 0, n_bytes FROM r WHERE rn = 1
  UNION ALL SELECT r.map_id, r.rn, r.batch_id, r.g, f.no + (r.g <> f.g OR f.held + r.n_bytes > 200)::INT, CASE WHEN r.g <> f.g OR f.held + r.n_bytes > 200 THEN r.n_bytes ELSE f.held + r.n_bytes END
  FROM f JOIN r ON r.map_id = f.map_id AND r.rn = f.rn + 1) SELECT * FROM f)
SELECT batch_id, no::BIGINT AS pack FROM f"""


@query(_PACK_GROUPS)
def batch_pack_groups(spark, sf_dir):
    """A pack holds batches of one partition group."""
    rows = workload.base_batches(spark, sf_dir).select("map_id", "batch_id", "n_bytes", assign.group_of(F.col("reducer_id"), 4).alias("g"))
    return pack.pack_greedy(rows, ["map_id"], ["g", "batch_id"], 200, boundary="g").select("batch_id", "pack")


@query(
    """, r AS (SELECT *, row_number() OVER (PARTITION BY map_id ORDER BY batch_id) AS rn FROM base),
f AS (WITH RECURSIVE f(map_id, rn, batch_id, no, held, n) AS (
  SELECT map_id, rn, batch_id, 0, n_bytes, 1 FROM r WHERE rn = 1
  UNION ALL SELECT r.map_id, r.rn, r.batch_id, f.no + (f.n >= 40 OR f.held >= 500)::INT, CASE WHEN f.n >= 40 OR f.held >= 500 THEN r.n_bytes ELSE f.held + r.n_bytes END, CASE WHEN f.n >= 40 OR f.held >= 500 THEN 1 ELSE f.n + 1 END
  FROM f JOIN r ON r.map_id = f.map_id AND r.rn = f.rn + 1) SELECT * FROM f)
SELECT batch_id, no::BIGINT AS spill FROM f"""
)
def spill_by_size(spark, sf_dir):
    """A spill after 40 records or 500 bytes, whichever comes first."""
    return _folded(spark, sf_dir, lambda *a: pack.spills(*a[:3], 40, a[3]), 500)


@query(
    """, r AS (SELECT *, reducer_id // 4 AS g, row_number() OVER (PARTITION BY reducer_id // 4 ORDER BY batch_id) AS rn FROM base),
f AS (WITH RECURSIVE f(g, rn, batch_id, epoch, held, over) AS (
  SELECT g, rn, batch_id, 0, map {reducer_id: n_bytes}, n_bytes > 1000 FROM r WHERE rn = 1
  UNION ALL SELECT r.g, r.rn, r.batch_id, f.epoch + f.over::INT,
    CASE WHEN f.over THEN map {r.reducer_id: r.n_bytes} ELSE map_concat(f.held, map {r.reducer_id: coalesce(f.held[r.reducer_id], 0) + r.n_bytes}) END,
    CASE WHEN f.over THEN 0 ELSE coalesce(f.held[r.reducer_id], 0) END + r.n_bytes > 1000
  FROM f JOIN r ON r.g = f.g AND r.rn = f.rn + 1) SELECT * FROM f)
SELECT batch_id, epoch::BIGINT AS epoch FROM f"""
)
def epoch_rotation_groups(spark, sf_dir):
    """Files are those of a reducer; the first that grows too large moves all reducers of its group."""
    rows = workload.base_batches(spark, sf_dir).select("batch_id", "reducer_id", "n_bytes", assign.group_of(F.col("reducer_id"), 4).alias("g"))
    return pack.rotate_groups(rows, ["g"], ["batch_id"], "reducer_id", 1000).select("batch_id", "epoch")


# Assignment


@query(
    """SELECT group_id, CASE WHEN group_id % 3 = 0 THEN 1 ELSE 0 END AS epoch_id, start_partition, end_partition,
  CASE WHEN group_id % 3 = 0 THEN (pair + 1 + (group_id * 31 + 17) % 14) % 15 ELSE pair END AS pair
FROM (SELECT i::INT AS group_id, (i * 66)::INT AS start_partition, least((i + 1) * 66, 1002)::INT AS end_partition, (i % 15)::INT AS pair FROM range(16) t(i))""",
    False,
)
def group_reallocate_moves(spark, sf_dir):
    """A group that fails gets the next epoch and another pair of workers."""
    groups = assign.partition_groups(spark, 1002, 1000, 6)
    failed = groups.select("group_id", F.when(F.col("group_id") % 3 == 0, 0).otherwise(-1).alias("epoch_id"))
    return assign.reallocate(groups, failed, 15)


@query("SELECT s_suppkey FROM supplier ORDER BY s_acctbal, s_suppkey LIMIT 9", False)
def worker_allocation(spark, sf_dir):
    """Workers for six partitions: half as many again, least loaded first."""
    return assign.allocate_workers(table(spark, sf_dir, "supplier").select("s_suppkey", "s_acctbal"), 6, "s_acctbal", "s_suppkey").select("s_suppkey")


@query("SELECT i AS id, greatest(2, CASE WHEN i % 2 = 0 THEN i // 20 ELSE (i * 4 // 50 + i) // 10 END)::INT AS workers FROM range(500) t(i)", False)
def worker_estimates(spark, sf_dir):
    """Fixed executors for even ids; for odd ones bounds of dynamic allocation, the upper one four times the lower."""
    i = F.col("id")
    return spark.range(500).select("id", assign.initial_workers_of(F.when(i % 2 == 0, i), i, i * 4).alias("workers"))


@query("SELECT o_orderkey, 'host-' || (o_custkey % 50) AS host, (9000 + o_orderkey % 7)::INT AS push_port FROM orders WHERE o_orderkey % 7 < 5", False)
def live_addresses(spark, sf_dir):
    """Of assigned addresses those that a worker serves: fifty hosts, with five of seven ports."""
    assigned = table(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("host-"), (F.col("o_custkey") % 50).cast("string")).alias("host"), (9000 + F.col("o_orderkey") % 7).cast("int").alias("push_port"))
    workers = spark.range(250).select(F.concat(F.lit("host-"), (F.col("id") % 50).cast("string")).alias("host"), (9000 + F.floor(F.col("id") / 50)).cast("int").alias("push_port"))
    return lifecycle.live_addresses(assigned, workers)


@query(_LAST + " SELECT user_id FROM last, now WHERE epoch_us(m) + 864000000000 > epoch_us(t)")
def live_workers(spark, sf_dir):
    last, now = _last(spark, sf_dir)
    return lifecycle.alive(last, now, 10 * 86_400_000_000).select("user_id")


@query(_ENDS + ", f AS (SELECT map_id, min(end_seq) AS first FROM ends GROUP BY 1) SELECT map_id, attempt_id, end_seq, end_seq = first AS wins, end_seq = first AND first = (SELECT max(first) FROM f) AND (SELECT count(*) FROM f) = 4 AS triggers FROM ends JOIN f USING (map_id)")
def stage_end_trigger(spark, sf_dir):
    """Which end of an attempt ends the stage."""
    return commit.stage_ends(_ends(spark, sf_dir), 4)


# Sessions, registry, faults


@query("SELECT reducer_id, count(*) AS n, round(sum(value), 2) AS total FROM once GROUP BY 1")
def session_roundtrip(spark, sf_dir):
    """Registered, written, committed and read through one session."""
    session = ShuffleSession(spark, scratch(spark, "session"), "app-1")
    shuffle = session.register(7, workload.MAPPERS, workload.REDUCERS, 6)
    ends = workload.attempts(spark).withColumn("end_seq", F.col("map_id").cast("bigint"))
    session.write(shuffle, workload.batches(spark, sf_dir), ends, workload.blacklist(spark, sf_dir))
    return session.read(shuffle).groupBy("reducer_id").agg(_n(), _money("value", "total"))


@query("SELECT 'app-1-' || i AS shuffle_key FROM range(4) t(i) WHERE i % 2 = 1", False)
def recycled_shuffles(spark, sf_dir):
    """Folders of shuffles that no one registers go, the others stay."""
    root = scratch(spark, "recycle")
    for i in range(4):
        spark.range(1).write.parquet(store.shuffle_dir(root, f"app-1-{i}"))
    reported = spark.range(4).select(F.concat(F.lit("app-1-"), F.col("id").cast("string")).alias("shuffle_key"))
    over = lifecycle.expired_shuffles(reported, reported.where("shuffle_key IN ('app-1-1', 'app-1-3')"))
    gone = store.recycle(spark, root, [r.shuffle_key for r in over.collect()])  # one row a shuffle
    return reported.where(~F.col("shuffle_key").isin(gone))


@query("SELECT 'w-' || user_id AS key, max(event_id) AS ts, '{\"rtt\":' || max(event_id) % 100 || '}' AS value FROM events GROUP BY user_id HAVING max(event_id) % 5 > 0", False)
def registry_latest(spark, sf_dir):
    """Each worker's last record; those whose last record takes them away are gone."""
    e = workload.events(spark, sf_dir)
    value = F.to_json(F.struct((F.col("event_id") % 100).alias("rtt")))
    records = e.select(F.concat(F.lit("w-"), F.col("user_id").cast("string")).alias("key"), F.col("event_id").alias("ts"), value.alias("value"), (F.col("event_id") % 5 > 0).alias("live"))
    book = registry.Registry(spark, scratch(spark, "registry"))
    book.put("workers", records.where("event_id % 2 = 0"))
    book.put("workers", records.where("event_id % 2 = 1"))
    return book.latest("workers")


@query("SELECT batch_id FROM base WHERE ('0x' || substr(md5('11:' || map_id || ':' || batch_id || ':' || epoch_id), 1, 8))::BIGINT % 50 = 0")
def seeded_faults(spark, sf_dir):
    """The pushes that fail under a seed."""
    return faults.with_faults(workload.base_batches(spark, sf_dir), 11, 50)[1].select("batch_id")


@query("SELECT reducer_id, count(*) AS n, round(sum(value), 2) AS total FROM base GROUP BY 1")
def faults_change_no_result(spark, sf_dir):
    """Every failed push comes again in the next epoch, and the read has each batch once."""
    pushed, bad = faults.with_faults(workload.base_batches(spark, sf_dir), 12, 30)
    return read.open_reader(pushed, workload.attempts(spark), bad).groupBy("reducer_id").agg(_n(), _money("value", "total"))


# Codecs, metrics, scalars


@query("SELECT lang, count(*) AS n, sum(strlen(text))::BIGINT AS raw_bytes, true AS stored_less, 0::BIGINT AS damaged FROM documents GROUP BY 1", False)
def codec_lz4_sizes(spark, sf_dir):
    """Raw and stored bytes, as the blocks' headers tell them."""
    docs = table(spark, sf_dir, "documents").select("lang", F.col("text").cast("binary").alias("raw"))
    blocks = docs.select("lang", codec.checked(F.col("raw"), "lz4").alias("c"))
    raw, stored = codec.block_sizes(F.col("c.block"))
    per = blocks.select("lang", raw.alias("r"), stored.alias("s"), (~F.col("c.intact")).cast("bigint").alias("d"))
    return per.groupBy("lang").agg(_n(), F.sum("r").alias("raw_bytes"), (F.sum("s") < F.sum("r")).alias("stored_less"), F.sum("d").alias("damaged"))


@query("SELECT o_orderkey, true AS kept, 'none' AS codec FROM orders", False)
def codec_raw_fallback(spark, sf_dir):
    """A digest does not compress and is stored as it is."""
    raw = F.unhex(F.sha2(F.col("o_orderkey").cast("string"), 256))
    blocks = table(spark, sf_dir, "orders").select("o_orderkey", codec.checked(raw, "zstd").alias("c"))
    return blocks.select("o_orderkey", F.col("c.intact").alias("kept"), codec.block_codec(F.col("c.block")).alias("codec"))


@query("SELECT count(*) AS n, sum(strlen(props))::BIGINT AS raw_bytes, 0::BIGINT AS damaged FROM events", False)
def codec_dictionary(spark, sf_dir):
    """Small payloads under a dictionary that was trained on a bounded sample of them."""
    e = workload.events(spark, sf_dir).select(F.col("props").cast("binary").alias("raw"))
    # The dictionary learns from at most 2,000 payloads; every payload is packed.
    sample = [bytes(r.raw) for r in e.where("raw IS NOT NULL").limit(2000).collect()]
    words = codec.train_dictionary([b"%d" % i + x for i, x in enumerate(sample)] or [b"x" * 64] * 64, 2048)
    back = e.withColumn("back", codec.unpacked_with_dictionary(codec.packed_with_dictionary(F.col("raw"), words), words))
    return back.agg(_n(), F.sum(F.octet_length("raw").cast("bigint")).alias("raw_bytes"), F.sum((F.col("raw") != F.col("back")).cast("bigint")).alias("damaged"))


@query("SELECT reducer_id, quantile_disc(n_bytes, [0.25, 0.5, 0.75])[1] AS q1, quantile_disc(n_bytes, [0.25, 0.5, 0.75])[2] AS q2, quantile_disc(n_bytes, [0.25, 0.5, 0.75])[3] AS q3 FROM batches GROUP BY 1")
def size_quartiles(spark, sf_dir):
    profile = metrics.size_profile(workload.batches(spark, sf_dir), "reducer_id", "n_bytes")
    return profile.select("reducer_id", *(F.col("quartiles")[i].alias(f"q{i + 1}") for i in range(3)))


@query(
    """, p AS (SELECT reducer_id, count(*)::DOUBLE AS n, sum(n_bytes)::DOUBLE AS total, min(n_bytes)::DOUBLE AS least, max(n_bytes)::DOUBLE AS most FROM batches GROUP BY 1)
SELECT 'sizes.' || reducer_id || '.' || k AS name, v AS value FROM (SELECT reducer_id, unnest(['n', 'total', 'least', 'most']) AS k, unnest([n, total, least, most]) AS v FROM p)"""
)
def metrics_csv_sink(spark, sf_dir):
    """Numbers of a profile, reported to a CSV sink and read back."""
    path = scratch(spark, "metrics")
    metrics.sink(metrics.as_metrics(metrics.size_profile(workload.batches(spark, sf_dir), "reducer_id", "n_bytes"), "sizes", "reducer_id"), "csv", path)
    return spark.read.schema("name string, value double").csv(path)


@query("SELECT event_id, CASE WHEN event_id = 0 THEN 64 ELSE 64 - length(bin(event_id)) END::INT AS zeros, ['a', 'b', 'c'][(event_id % 3 + 1)::INT] AS nth FROM events", False)
def bits_and_places(spark, sf_dir):
    """Leading zeros of ids, and an element by the place of another array's."""
    e = workload.events(spark, sf_dir)
    nth = keys.nth_of(F.array(F.lit(0), F.lit(1), F.lit(2)), (F.col("event_id") % 3).cast("int"), F.array(F.lit("a"), F.lit("b"), F.lit("c")))
    return e.select("event_id", keys.leading_zeros(F.col("event_id"), 64).alias("zeros"), nth.alias("nth"))


@query("SELECT count(*) AS n, count(DISTINCT o_custkey) AS customers, 0::BIGINT AS torn, 0::BIGINT AS inversions FROM orders", False)
def exchange_sorted_runs(spark, sf_dir):
    """One exchange by key, and each key's rows in order within one task."""
    rows = exchange.sorted_exchange(table(spark, sf_dir, "orders").select("o_custkey", "o_totalprice"), 16, ["o_custkey"], ["o_totalprice"])
    at = rows.select("o_custkey", "o_totalprice", F.monotonically_increasing_id().alias("at"), F.spark_partition_id().alias("p"))
    per = at.groupBy("o_custkey").agg(_n(), F.min("p").alias("a"), F.max("p").alias("b"), F.transform(F.sort_array(F.collect_list(F.struct("at", "o_totalprice"))), lambda x: x["o_totalprice"]).alias("seen"))
    down = F.size(F.filter("seen", lambda x, i: (i > 0) & (x < F.get("seen", i - 1)))).cast("bigint")
    return per.agg(F.sum("n").alias("n"), _n("customers"), F.sum((F.col("a") != F.col("b")).cast("bigint")).alias("torn"), F.sum(down).alias("inversions"))


@query("SELECT count(*) AS n, true AS in_range, true AS spread FROM orders", False)
def non_negative_hashes(spark, sf_dir):
    """Hashes are from 0 up, and deal keys to all of 16 places."""
    h = table(spark, sf_dir, "orders").select(keys.non_negative_hash(F.col("o_orderkey")).alias("h"))
    return h.agg(_n(), (F.min("h") >= 0).alias("in_range"), (F.count_distinct(F.col("h") % 16) == 16).alias("spread"))


@query("SELECT i AS id, CASE WHEN i * i * i < 2048 THEN printf('%d B', i * i * i) WHEN i * i * i < 2097152 THEN printf('%.1f KiB', floor(i * i * i / 102.4 + 0.5) / 10) ELSE printf('%.1f MiB', floor(i * i * i / 104857.6 + 0.5) / 10) END AS told FROM range(1000) t(i)", False)
def size_texts(spark, sf_dir):
    i = F.col("id")
    return spark.range(1000).select("id", units.size_text(i * i * i).alias("told"))


@query("SELECT l_suppkey, o_orderstatus, count(*) AS n, sum(l_quantity) AS qty FROM (SELECT *, CASE WHEN l_orderkey % 3 = 0 THEN 1 ELSE l_orderkey END AS k FROM lineitem) JOIN orders ON k = o_orderkey GROUP BY 1, 2", False)
def skewed_join_rows(spark, sf_dir):
    """A third of all rows have one key; they are joined row by row, and AQE splits their partition."""
    li = table(spark, sf_dir, "lineitem").select(F.when(F.col("l_orderkey") % 3 == 0, 1).otherwise(F.col("l_orderkey")).alias("k"), "l_suppkey", "l_quantity")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus").hint("merge")
    return li.join(o, F.col("k") == F.col("o_orderkey")).groupBy("l_suppkey", "o_orderstatus").agg(_n(), F.sum("l_quantity").alias("qty"))


@query("SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey % 4 ORDER BY o_orderkey) AS rank FROM orders", False)
def ranks_of_large_groups(spark, sf_dir):
    """Four groups hold all rows; each is ranked in ranges, by many tasks."""
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", exchange.modulo_partition(F.col("o_custkey"), 4).alias("part"))
    return exchange.partition_rank(rows, "part", "o_orderkey").drop("part")

import collections
import random
import re
import time
from pathlib import Path

import pyarrow as pa
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sluice import conf, model, session
from sluice.functions import codec, units
from sluice.operators import assign, commit, exchange, metrics, pack, read
from sluice.plans import catalogue, services  # noqa: F401
from sluice.sources import frames, registry, store


@pytest.mark.parametrize(("n", "most", "workers", "groups", "last"), [
    (1002, 20, 6, 51, (1000, 1002)), (1002, 1000, 6, 16, (990, 1002)), (12, 1000, 6, 6, (10, 12)), (5, 100, 6, 5, (4, 5)), (1002, 1000, 3, 3, (668, 1002)),
])
def test_group_sizes(spark, n, most, workers, groups, last):
    rows = assign.partition_groups(spark, n, most, workers).orderBy("group_id").collect()
    assert len(rows) == groups and (rows[-1].start_partition, rows[-1].end_partition) == last
    assert [r.end_partition for r in rows[:-1]] == [r.start_partition for r in rows[1:]]


def test_too_few_workers():
    with pytest.raises(ValueError, match="two workers"):
        assign.group_length(10, 10, 1)


def test_worker_estimates():
    assert assign.workers_wanted(1) == 2 and assign.workers_wanted(100) == 150 and assign.workers_wanted(10_000) == 1000
    assert assign.initial_workers(instances=200) == 10 and assign.initial_workers(least=10, most=2000) == 5


def test_replica_pairs(spark):
    w = spark.createDataFrame([(0, "a"), (1, "b"), (2, "c")], "i int, n string")
    assert {(r.a, r.b) for r in assign.replica_pairs(w, "i", "n").collect()} == {("a", "b"), ("a", "c"), ("b", "c")}
    assert assign.replica_pairs(w.limit(0), "i", "n").count() == 0


def test_stage_end(spark):
    """Three mappers; mapper 0 ends with attempt 0 and late again with attempt 2, mapper 1 with 4, mapper 2 with 1."""
    ends = spark.createDataFrame([(0, 0, 1), (1, 4, 2), (0, 2, 3), (2, 1, 4)], "map_id int, attempt_id int, end_seq bigint")
    won = commit.winning_attempts(ends)
    assert {(r.map_id, r.attempt_id) for r in won.collect()} == {(0, 0), (1, 4), (2, 1)}
    assert commit.all_ended(won, 3).first().all_ended and not commit.all_ended(won, 4).first().all_ended


def test_one_good_replica_is_no_loss(spark):
    written = spark.createDataFrame([(1, 0), (2, 0), (3, 0)], "reducer_id int, epoch_id int")
    done = spark.createDataFrame([(1, 0, -1), (1, 0, 5), (2, 0, -1), (2, 0, -1)], "reducer_id int, epoch_id int, file_length bigint")
    assert sorted(r.reducer_id for r in commit.lost_epochs(written, done).collect()) == [2, 3]


def test_dedup_keeps_the_earliest_epoch(spark):
    rows = spark.createDataFrame([(0, 1, 0, 7, "b"), (0, 0, 0, 7, "a"), (0, 0, 0, 7, "a"), (1, 0, 0, 7, "c")], "reducer_id int, epoch_id int, map_id int, batch_id int, x string")
    assert sorted(r.x for r in read.dedup(rows).collect()) == ["a", "c"]
    assert read.dedup(rows.limit(0)).count() == 0


def test_split_reads_need_the_blacklist(spark):
    with pytest.raises(ValueError, match="blacklisted"):
        read.split_read(spark.createDataFrame([], model.BATCHES), 2, 0, blacklist_on=False)


def test_more_readers_than_files(spark):
    rows = spark.createDataFrame([(0, 0, 1), (0, 1, 2)], "reducer_id int, epoch_id int, x int")
    got = [read.split_read(rows, 5, i).count() for i in range(5)]
    assert got == [1, 1, 0, 0, 0]


def _fold(spark, f, sizes, *args, **more):
    rows = spark.createDataFrame([(0, i, n) for i, n in enumerate(sizes)], "g int, i int, n_bytes bigint")
    out = f(rows, ["g"], ["i"], *args, **more)
    return [r[3] for r in out.orderBy("i").collect()]


def test_folds(spark):
    assert _fold(spark, pack.pack_greedy, [4, 4, 4, 20, 1], 10) == [0, 0, 1, 2, 3]
    assert _fold(spark, pack.split_chunks, [4, 4, 4, 20, 1], 10) == [0, 0, 0, 1, 2]
    assert _fold(spark, pack.flushes, [4, 4, 4, 20, 1], 10) == [0, 0, 1, 2, 3]
    assert _fold(spark, pack.rotate_epochs, [6, 6, 6, 6, 6], 10) == [0, 0, 1, 1, 2]
    assert _fold(spark, pack.rotate_epochs, [6, 6, 6, 6, 6], 10, policy="serial_push") == [0, 0, 0, 1, 1]


def test_folds_of_many_batches_and_groups(spark):
    """Against a step a row, with Arrow batches that cut groups."""
    rng = random.Random(3)
    rows = [(g, i, rng.choice([0, 1, 2, 3, 5, 8, 30]), rng.randrange(3)) for g in (1, None, 2) for i in range(400)]
    df = spark.createDataFrame(rows, "g int, i int, n_bytes bigint, m int")
    per = {g: [(n, m) for h, _, n, m in rows if h == g] for g in (1, None, 2)}

    def greedy(xs):
        no = held = 0
        for n, _ in xs:
            if held and held + n > 10:
                no, held = no + 1, 0
            held += n
            yield no

    def spill(xs):
        no = held = count = 0
        for n, _ in xs:
            if count and (count >= 6 or held >= 20):
                no, held, count = no + 1, 0, 0
            held, count = held + n, count + 1
            yield no

    def chunk(xs):
        no = held = 0
        for n, _ in xs:
            yield no
            held += n
            if held >= 12:
                no, held = no + 1, 0

    def flush(xs):
        no = held = 0
        for n, _ in xs:
            if held and held + n >= 9:
                no, held = no + 1, 0
            yield no
            no, held = (no + 1, 0) if n >= 9 else (no, held + n)

    def rotate(xs, serial=False):
        no = held = 0
        over = False
        for n, _ in xs:
            yield no
            if over:
                no, held, over = no + 1, 0, False
                continue
            held += n
            over = held > 15
            if over and not serial:
                no, held, over = no + 1, 0, False

    def group(xs):
        no, held = 0, {}
        for n, m in xs:
            yield no
            held[m] = held.get(m, 0) + n
            if held[m] > 25:
                no, held = no + 1, {}

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "97")
    try:
        for f, args, step in [
            (pack.pack_greedy, (10,), greedy), (pack.spills, (6, 20), spill), (pack.split_chunks, (12,), chunk), (pack.flushes, (9,), flush), (pack.rotate_epochs, (15,), rotate),
            (lambda *a: pack.rotate_epochs(*a, policy="serial_push"), (15,), lambda xs: rotate(xs, True)), (lambda r, g, o, t: pack.rotate_groups(r, g, o, "m", t), (25,), group),
        ]:
            out = f(df, ["g"], ["i"], *args).orderBy("i").collect()
            for g in per:
                assert [r[-1] for r in out if r.g == g] == list(step(per[g])), (step.__name__, g)
        packed = pack.pack_greedy(df, ["g"], ["m", "i"], 10, boundary="m").collect()
        members = collections.defaultdict(set)
        for r in packed:
            members[r.g, r.pack].add(r.m)
        assert all(len(x) == 1 for x in members.values()) and len(members) == len({(r.g, r.pack) for r in packed})
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_rotation_moves_the_whole_group(spark):
    """Member 1 passes the threshold, and member 0's next batch is in the new epoch too."""
    rows = spark.createDataFrame([(0, i, m, n) for i, (m, n) in enumerate([(0, 4), (1, 9), (1, 3), (0, 4), (0, 4), (0, 4), (1, 1)])], "g int, i int, m int, n_bytes bigint")
    assert [r.epoch for r in pack.rotate_groups(rows, ["g"], ["i"], "m", 10).orderBy("i").collect()] == [0, 0, 0, 1, 1, 1, 2]


def test_reallocated_groups_get_another_pair(spark):
    groups = assign.partition_groups(spark, 100, 10, 5)
    moved = assign.reallocate(groups, groups.select("group_id", "epoch_id"), 10)
    both = {r.group_id: (r.epoch_id, r.pair) for r in moved.collect()}
    old = {r.group_id: r.pair for r in groups.collect()}
    assert all(e == 1 and p != old[g] and 0 <= p < 10 for g, (e, p) in both.items())
    assert {r.pair for r in assign.reallocate(groups, groups.select("group_id", (F.col("epoch_id") - 1).alias("epoch_id")), 10).collect()} == set(old.values())


def test_prefixes_of_ranges(spark):
    rng = random.Random(4)
    rows = [(rng.choice([1, 1, 1, None]), x, rng.randrange(9)) for x in rng.sample(range(10**6), 500)]
    out = exchange.prefixed(spark.createDataFrame(rows, "g int, o bigint, n bigint"), ["g"], ["o"], s=F.col("n"), c=F.lit(1)).collect()
    for g in (1, None):
        want = sorted(r for r in rows if r[0] == g) if g else sorted((r for r in rows if r[0] is None), key=lambda r: r[1])
        got = sorted((r for r in out if r.g == g), key=lambda r: r.o)
        assert [(r.c, r.s) for r in got] == [(i, sum(x[2] for x in want[:i])) for i in range(len(want))]
    assert exchange.prefixed(spark.createDataFrame([], "g int, o bigint"), ["g"], ["o"], c=F.lit(1)).count() == 0


def test_valid_arrays(spark):
    rows = [([0, 1], [0, 5], [5, 2]), ([0, 1], [0, 6], [5, 2]), ([0, 4], [0, 5], [5, 2]), ([0], [0, 5], [5, 2]), ([], [], []), (None, [0], [1]), ([0], [1], [2])]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id int, reducers array<int>, offsets array<bigint>, lengths array<bigint>")
    assert [r.valid for r in pack.valid_arrays(df, group_length=4).orderBy("id").collect()] == [True] + [False] * 6


def test_skewed_join_is_split(spark, tmp_path):
    conf = {"spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "8k", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "8k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5", "spark.sql.shuffle.partitions": "12"}
    before = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        # One row group is one task, and a partition is split along the tasks that wrote it: the table in eight files.
        spark.read.parquet("/root/testdata/sf0.01/lineitem.parquet").repartition(8).write.parquet(f"{tmp_path}/lineitem.parquet")
        spark.read.parquet("/root/testdata/sf0.01/orders.parquet").write.parquet(f"{tmp_path}/orders.parquet")
        df = catalogue.QUERIES["skewed_join_rows"](spark, str(tmp_path))
        df.collect()
        assert "skew=true" in df._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_session(spark, tmp_path):
    """Before all mappers have ended nothing is read; failed groups move; a removed shuffle leaves no files."""
    s = session.ShuffleSession(spark, str(tmp_path / "root"), "app", conf.Settings.of({"sluice.max_partitions_per_group": "2"}))
    sh = s.register(1, 2, 4, 3)
    assert s.register(1, 2, 4, 3) is sh and s.status(sh) == "RUNNING" and s.status(sh, "700s") == "TIMEOUT"
    rows = spark.createDataFrame([(0, 0, m, 0, b, 5) for m in (0, 1) for b in range(3)] + [(0, 0, 0, 1, 0, 5)], "reducer_id int, epoch_id int, map_id int, attempt_id int, batch_id bigint, n_bytes bigint")
    ends = [(0, 0, 1), (0, 1, 2), (1, 0, 3)]
    schema = "map_id int, attempt_id int, end_seq bigint"
    s.write(sh, rows, spark.createDataFrame(ends[:2], schema), rows.limit(0))
    with pytest.raises(RuntimeError, match="RUNNING"):
        s.read(sh)
    s.write(sh, rows, spark.createDataFrame(ends, schema), rows.limit(0))
    assert s.status(sh) == "FINISHED" and s.read(sh).count() == 6 and s.read(sh, maps=(0, 1)).count() == 3
    assert s.packed(rows, ["batch_id"]).select("pack").distinct().count() == 1
    moved = s.reallocate(sh, sh.groups.select("group_id", "epoch_id").limit(1))
    assert sorted(r.epoch_id for r in moved.collect()) == [0] * (moved.count() - 1) + [1]
    assert s.destroy(sh) and not s.destroy(sh)
    none = s.register(2, 0, 4, 3)
    assert s.status(none) == "FINISHED" and s.read(none).count() == 0
    other = s.register(3, 2, 4, 3)
    s.write(other, rows, spark.createDataFrame(ends, schema), rows.limit(0))
    assert s.stop() == ["app-3"]


def test_sessions_follow_their_settings(spark, tmp_path):
    own = {"max_partitions_per_group": "2", "push_buffer": "8b", "spill_size": "10b", "spill_records": "3", "epoch_rotate": "9b", "flush_buffer": "7b", "fetch_chunk": "4b", "worker_timeout": "2s", "app_timeout": "3s", "remove_delay": "1s"}
    s = session.ShuffleSession(spark, str(tmp_path), "app", conf.Settings.of({f"sluice.{k}": v for k, v in own.items()}))
    rows = spark.createDataFrame([(r, 0, 0, 0, b, 5) for b, r in enumerate([0, 1, 0, 2, 0, 1])], "reducer_id int, epoch_id int, map_id int, attempt_id int, batch_id bigint, n_bytes bigint")
    by = lambda df, c: [r[c] for r in df.orderBy("batch_id").collect()]
    assert by(s.packed(rows, ["batch_id"]), "pack") == [0, 1, 2, 5, 3, 4]
    assert by(s.spilled(rows, ["batch_id"]), "spill") == [0, 0, 1, 1, 2, 2]
    assert by(s.rotated(rows, ["batch_id"]), "epoch_id") == [0, 0, 0, 0, 1, 1]
    assert by(s.flushed(rows, ["batch_id"]), "flush") == [0, 0, 1, 0, 2, 1]
    assert s.chunks(spark.createDataFrame([("a", 9)], "file_path string, file_length bigint")).count() == 3
    beats = spark.createDataFrame([("a", 1000), ("b", 5000)], "app_id string, ts bigint")
    assert [r.app_id for r in s.live_workers(beats, "app_id", 6000).collect()] == ["b"] and [r.app_id for r in s.expired_apps(beats, 6000).collect()] == ["a"]
    assert s.removable(beats.withColumnRenamed("app_id", "shuffle_key"), 2500).count() == 1


def test_chunks_must_cover_their_file(spark):
    files = spark.createDataFrame([("a", 10), ("b", 0), ("c", 4)], "file_path string, file_length bigint")
    chunks = read.chunk_table(files, 4)
    assert sorted((r.file_path, r.chunk_idx, r.start_off, r.end_off) for r in read.chunks_from(chunks, 0).collect()) == [("a", 0, 0, 4), ("a", 1, 4, 8), ("a", 2, 8, 10), ("c", 0, 0, 4)]
    with pytest.raises(Exception, match="do not cover"):
        read.chunks_from(chunks.where("chunk_idx < 2"), 0).collect()


def test_readers(spark):
    rows = spark.createDataFrame([], model.BATCHES)
    with pytest.raises(ValueError, match="all mappers"):
        read.open_reader(rows, rows, rows, maps=(0, 1), split=(2, 0))
    assert read.open_reader(rows, rows, n_mappers=0).columns == rows.columns


def test_placement_and_sinks(spark, tmp_path):
    assert store.placement(2, False) == {"dfs.replication": "2", "dfs.checksum.type": "NULL"} and store.placement() == {}
    rows = spark.createDataFrame([("a.n", 1.0)], "name string, value double")
    for kind in ("csv", "json"):
        metrics.sink(rows, kind, str(tmp_path / kind))
        assert spark.read.schema("name string, value double").format(kind).load(str(tmp_path / kind)).count() == 1
    with pytest.raises(ValueError):
        metrics.sink(rows, "carrier pigeon")


def test_registry_kinds(spark, tmp_path):
    book = registry.Registry(spark, str(tmp_path))
    book.put("lock", spark.createDataFrame([("a", 1, "{}"), ("a", 2, '{"x":1}')], "key string, ts bigint, value string"))
    assert [tuple(r) for r in book.latest("lock").collect()] == [("a", 2, '{"x":1}')]
    with pytest.raises(ValueError, match="kind"):
        book.latest("queues")


def test_push_validation(spark):
    rows = spark.createDataFrame([(1, 0, 0, 0, 5), (1, 1, 0, 5, 5), (2, 0, 0, 0, 5), (2, 1, 0, 6, 5), (3, 0, 0, 0, 5), (3, 9, 1, 5, 5)], "push_id int, reducer_id int, group_id int, offset bigint, n_bytes bigint")
    assert {r.push_id: r.valid for r in pack.valid_push(rows).collect()} == {1: True, 2: False, 3: False}


@given(st.binary(max_size=3000), st.sampled_from(["lz4", "zstd"]))
def test_codec_round_trip(data, name):
    assert codec.unpack(codec.pack(data, name)) == data


def test_codec_errors():
    block, at = codec.pack(b"abc" * 500), codec.HEADER.size
    with pytest.raises(ValueError, match="checksum"):
        codec.unpack(block[:at] + bytes([block[at] ^ 1]) + block[at + 1 :])
    with pytest.raises(ValueError, match="checksum"):
        codec.unpack(block[:-1])
    for cut in (b"", block[:10], b"x" + block[1:], block[:4] + b"\x09" + block[5:]):
        with pytest.raises(ValueError, match="not a block"):
            codec.unpack(cut)
    with pytest.raises(ValueError, match="unknown"):
        codec.pack(b"x", "zip")
    assert codec.CODECS[codec.pack(b"abc")[4]] == "none"


def test_block_headers(spark):
    raw = [b"", b"abc", b"abc" * 5000]
    df = spark.createDataFrame([(x,) for x in raw], "raw binary").withColumn("block", codec.compressed(F.col("raw"), "zstd"))
    size, stored = codec.block_sizes(F.col("block"))
    rows = df.select(F.octet_length("raw").alias("n"), size.alias("r"), stored.alias("s"), codec.block_codec(F.col("block")).alias("c")).orderBy("n").collect()
    assert [(r.r, r.c) for r in rows] == [(0, "none"), (3, "none"), (15_000, "zstd")]
    assert rows[0].s == 0 and rows[1].s == 3 and rows[2].s < 200


def _most_mb(mark):
    """The peak memory of a Python worker with ``mark`` in its environment."""
    found = []
    for p in Path("/proc").glob("[0-9]*"):
        try:
            if mark in (p / "environ").read_bytes():
                found.append(int(re.search(r"VmHWM:\s+(\d+)", (p / "status").read_text())[1]) / 1024)
        except (OSError, TypeError):  # it ended meanwhile
            continue
    return max(found)


def test_codec_worker_holds_pieces(spark, monkeypatch):
    """A batch of small blocks with 400 MB in them: a worker never holds all of it."""
    block = codec.pack(b"ab" * 500_000, "zstd")
    monkeypatch.setitem(spark.sparkContext.environment, "SLUICE_TEST", "pieces")
    rows = spark.range(0, 400, 1, 1).select(codec.decompressed(F.lit(block)).alias("raw"))
    assert rows.agg(F.sum(F.octet_length("raw").cast("bigint"))).collect()[0][0] == 400_000_000
    assert _most_mb(b"SLUICE_TEST=pieces") < 300


def test_lz4_sizes_of_long_texts(spark, tmp_path, monkeypatch):
    """Batches of 64 MB, as texts of 1 MB fill them: blocks and what they give back are not held beside their batch."""
    text = F.repeat(F.sha2(F.col("id").cast("string"), 256), 15_625)
    spark.range(0, 200, 1, 1).select(F.lit("en").alias("lang"), text.alias("text")).write.parquet(str(tmp_path / "documents.parquet"))
    monkeypatch.setitem(spark.sparkContext.environment, "SLUICE_TEST", "lz4")
    assert [tuple(r) for r in catalogue.QUERIES["codec_lz4_sizes"](spark, str(tmp_path)).collect()] == [("en", 200, 200_000_000, True, 0)]
    assert _most_mb(b"SLUICE_TEST=lz4") < 300


@pytest.mark.parametrize("name", ["codec_lz4_sizes", "codec_raw_fallback"])
def test_blocks_are_read_back_in_one_worker(spark, name):
    """One Python worker a task: blocks do not go to a second one to be read back."""
    plan = catalogue.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("EvalPython") == 1


def test_codec_checked(spark, monkeypatch):
    """Blocks as ``compressed`` makes them, over several pieces, nulls in their places; a block that gives back other bytes is told."""
    raw = F.when(F.col("id") % 7 > 1, F.concat(F.col("id").cast("string"), F.repeat(F.sha2(F.col("id").cast("string"), 256), 20_000))).when(F.col("id") % 7 == 1, "")
    df = spark.range(0, 60, 1, 2).withColumn("raw", raw.cast("binary"))
    for c in ("lz4", "zstd"):
        got = df.select("raw", codec.compressed(F.col("raw"), c).alias("block"), codec.checked(F.col("raw"), c).alias("c"))
        assert got.where("NOT c.block <=> block OR NOT c.intact <=> if(raw IS NULL, NULL, true)").count() == 0 and got.where("c IS NULL").count() == 9
    assert df.limit(0).select(codec.checked(F.col("raw"))).count() == 0
    values = pa.array([b"a" * 10, None, codec.pack(random.Random(3).randbytes(codec.PIECE)), b""])
    sizes = [len(p) for p in codec.pieces(values, codec.check, codec.CHECKED, lambda y: len(y["block"]))]
    assert sizes == [3, 1]
    monkeypatch.setattr(codec, "unpack", lambda block: b"other")
    assert codec.check(b"abc")["intact"] is False


def test_codec_pieces_keep_rows(spark):
    """Nulls, empty values and answers of several pieces stay beside their rows."""
    raw = F.when(F.col("id") % 7 > 1, F.concat(F.col("id").cast("string"), F.repeat(F.lit("x"), 400_000))).when(F.col("id") % 7 == 1, "")
    df = spark.range(0, 60, 1, 2).withColumn("raw", raw.cast("binary"))
    for c in ("lz4", "zstd"):
        back = df.withColumn("back", codec.decompressed(codec.compressed(F.col("raw"), c)))
        assert back.where(~F.col("back").eqNullSafe(F.col("raw"))).count() == 0 and back.where("back is null").count() == 9
    assert df.limit(0).select(codec.compressed(F.col("raw"))).count() == 0


def test_codec_dictionary():
    samples = [f'{{"user": {i}, "kind": "click", "value": {i * 7}}}'.encode() for i in range(3000)]
    d = codec.train_dictionary(samples)
    packed = codec.pack_with_dictionary(samples[5], d)
    assert codec.unpack_with_dictionary(packed, d) == samples[5] and len(packed) < len(samples[5])


def test_frames(spark, tmp_path):
    data = frames.frame(1, 0, 7, b"abc") + frames.frame(1, 2, 8, b"")
    (tmp_path / "0-0-r0-data").write_bytes(data)
    rows = frames.read_frames(spark.read.format("binaryFile").load(str(tmp_path))).collect()
    assert [(r.map_id, r.attempt_id, r.batch_id, bytes(r.body)) for r in rows] == [(1, 0, 7, b"abc"), (1, 2, 8, b"")]
    with pytest.raises(ValueError, match="cut"):
        list(frames.frames_of(data[:-20]))


def test_frames_of_many_and_of_large_files(spark):
    """20,000 files of one frame, in one task: a file costs no batch of its own. Files of several batches, and empty ones, keep their rows."""
    one = frames.framed(F.lit(1), F.lit(0), F.col("id"), F.lit(b"abc"))
    small = spark.range(0, 20_000, 1, 1).select(F.col("id").cast("string").alias("path"), one.alias("content"))
    began = time.perf_counter()
    got = frames.read_frames(small).agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("path") == F.col("batch_id").cast("string")).cast("int")).alias("same"), F.sum(F.octet_length("body")).alias("size"))
    assert tuple(got.collect()[0]) == (20_000, 20_000, 60_000)
    assert time.perf_counter() - began < 8
    many = b"".join(frames.frame(2, 1, i, b"") for i in range(25_000))
    large = b"".join(frames.frame(3, 1, i, bytes([i]) * 700_000) for i in range(5))
    rows = frames.read_frames(spark.createDataFrame([("a", many), ("b", b""), ("c", large)], "path string, content binary").coalesce(1))
    want = [("a", 25_000, 25_000, 0), ("c", 5, 5, 3_500_000)]
    got = rows.groupBy("path").agg(F.count(F.lit(1)), F.count_distinct("batch_id"), F.sum(F.octet_length("body"))).orderBy("path").collect()
    assert [tuple(r) for r in got] == want
    assert rows.where("path = 'c' and body <> unhex(repeat(lpad(hex(batch_id), 2, '0'), 700000))").count() == 0


def test_settings():
    s = conf.Settings.of({"sluice.push_buffer": "8m", "sluice.blacklist": "false", "other": "x"})
    assert conf.size_bytes(s.push_buffer) == 8 << 20 and not s.blacklist and conf.time_ms(s.app_timeout) == 120_000
    with pytest.raises(KeyError):
        conf.Settings.of({"sluice.nope": "1"})
    with pytest.raises(ValueError):
        conf.size_bytes("4x")


def test_units(spark):
    df = spark.createDataFrame([("4m", "2min", 5000), ("x", "", 5)], "s string, t string, n bigint")
    r = df.select(units.size_bytes(F.col("s")).alias("s"), units.time_ms(F.col("t")).alias("t"), units.size_text(F.col("n")).alias("n")).collect()
    assert [tuple(x) for x in r] == [(4 << 20, 120_000, "4.9 KiB"), (None, None, "5 B")]


def test_observed(spark):
    df, seen = metrics.observed(spark.range(10).withColumn("n", F.col("id")), "sizes", "n")
    df.write.format("noop").mode("overwrite").save()
    assert seen.get == {"rows": 10, "bytes": 45, "largest": 9}


def test_store_prunes_reducers(spark, tmp_path):
    rows = spark.range(100).select((F.col("id") % 5).cast("int").alias("reducer_id"), F.lit(0).alias("epoch_id"), F.col("id").alias("n_bytes"))
    store.write_batches(rows, str(tmp_path / "s"))
    got = store.read_reducers(spark, str(tmp_path / "s"), "reducer_id int, epoch_id int, n_bytes bigint", 1, 3)
    assert got.count() == 40
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(reducer_id" in plan
    assert store.empty(spark, model.BATCHES).count() == 0


def test_combine_is_map_side(spark):
    df = exchange.hash_exchange(spark.range(10), 4, "id").groupBy((F.col("id") % 2).alias("k")).agg(F.sum("id"))
    assert "partial_sum" in df._jdf.queryExecution().executedPlan().toString()


def test_pointers_of_all_events(spark, tmp_path):
    ids = [0, 7_999_999, 8_000_000, 8_388_608, 20_000_000, 3_000_000_000]
    spark.createDataFrame([(i, 5) for i in ids], "event_id bigint, user_id bigint").write.parquet(f"{tmp_path}/events.parquet")
    rows = {r.event_id: (r.part, r.page, r.off) for r in catalogue.QUERIES["pointer_pack"](spark, str(tmp_path)).collect()}
    assert rows == {i: (i % 2**23, 5, i * 7 % 2**27) for i in ids}


def test_pairs_and_streams_of_whole_tables(spark):
    assert catalogue.QUERIES["replica_tuples_whole"](spark, "/root/testdata/sf0.001").count() == 25 * 24 // 2
    rows = catalogue.QUERIES["stream_exactly_once_whole"](spark, "/root/testdata/sf0.001").collect()
    assert {r.reducer_id for r in rows} == set(range(8)) and sum(r.n for r in rows) == spark.read.parquet("/root/testdata/sf0.001/events.parquet").count()

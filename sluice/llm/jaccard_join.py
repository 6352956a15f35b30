"""Exact Jaccard self-join of shingle sets, down to connected components.

Set relations are used twice. Equal sets are joined as one. Highly similar sets
are first tied to a leader, and what the leader's comparison gave decides most
of what remains: sets that are already connected are never compared again.

1. ``set_rows``: one row a document: size and name of its set; and the shingles
   that repeat within a stretch of documents, which are put last in the order
   of shingles. Any order gives exact results; this one keeps lists short.
2. ``postings``: two sets that reach the threshold share a shingle among the
   first n - ceil(t n) + 1 of each. These prefixes go, as blocks of numpy
   records, to ranges of shingle hashes, where lists are made by one sort.
3. Lists of at most ``SHORT`` sets give all pairs that their sizes allow, with
   the number of shared prefix shingles as a bound; longer ones give ties of
   each set to the list's leaders. Entries stand by size and position: those of
   unfitting size, and blocks whose positions come too late, are skipped.
4. ``compared`` ships a pair's texts to its hub (dealt to many tasks if the hub
   has many partners) and counts the overlap exactly.
5. Components of the links; then, while a long list still holds sets of
   several components, another round of leaders, and at last all its pairs
   across components that sizes and positions allow.

No step gathers a list of documents, links or components on the driver. The
broadcast of frequent shingles has at most ``MAX_FREQUENT`` entries; the filter
of ids has at most ``MAX_FILTER_BITS`` bits. What is written on the way is
deleted once the result is written. Names of sets and shingles have 64 bits:
among n sets a false merge is expected once n reaches some 10 ** 9.5.

Defined results: null and empty texts have the empty set and are linked with
nothing; rows with one id are separate rows; a null id never names a component
unless all its ids are null; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.llm.common import Scratch, count_partitions, table, written
from sluice.llm.shingles import mixed, set_key, shingle_sets, stretches

WORDS, PERCENT = 5, 75
SHORT = 24
LEADERS = 2
#: Rounds of leaders at most; fewer, if the pairs that are left are no more than so many a posting.
ROUNDS = 2
PAIRS_PER_POSTING = 8
#: Entries of a list's block.
BLOCK = 64
#: Sets that one task of a hub compares.
HUB_ROWS = 1024
MAX_FREQUENT = 2_000_000
#: Local repeats from which a shingle counts as frequent.
FREQUENT = 8
#: Shingles that a task holds while it looks for repeats.
STRETCH = 4_000_000
#: Bits of the filter of ids: eight an id, and this many at most (32 MB). A full filter lets texts pass that nobody asks for, and loses none.
MAX_FILTER_BITS = 1 << 28
#: Stands for a null id inside the join.
NO_ID = -(1 << 63)
_POSTING = np.dtype([("token", "<u8"), ("key", "<i8"), ("n", "<i4"), ("pos", "<i4")])


def prefix_length(n: int, percent: int = PERCENT) -> int:
    return n - -(-percent * n // 100) + 1


def overlap_needed(nx, ny, percent: int = PERCENT):
    """The least intersection of sets of these sizes that reaches the threshold: 100 i >= p (nx + ny - i)."""
    return -(-percent * (nx + ny) // (100 + percent))


def _set_rows(percent: int, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        n_held = 0
        names = ["doc_id", "text_hash", "n", "key", "token", "count"]

        def repeats() -> pa.RecordBatch:
            tokens, counts = np.unique(np.concatenate(held), return_counts=True)
            tokens, counts = tokens[counts > 1], counts[counts > 1]
            none = pa.nulls(len(tokens), pa.int64())
            return pa.RecordBatch.from_arrays([none, none, none, none, pa.array(tokens.view(np.int64)), pa.array(counts.astype(np.int64))], names)

        seen: set[int] = set()
        for rows, texts in (x for batch in batches for x in stretches(batch)):
            sets = shingle_sets(texts, size)
            keys = [set_key(s) if len(s) else None for s in sets]
            none = pa.nulls(len(sets), pa.int64())
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("text_hash"), pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.int64()), none, none], names)
            for k, s in zip(keys, sets, strict=True):
                if k is not None and k not in seen:
                    seen.add(k)
                    held.append(s)
                    n_held += len(s)
            if n_held >= STRETCH:
                yield repeats()
                held, n_held = [], 0
                seen = set()
        if held:
            yield repeats()

    return run


def _postings(frequent, buckets: int, percent: int, size: int):
    """(bucket, records) rows: the prefixes of a task's distinct sets, by range of shingle hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often, seen = frequent.value, set()
        for texts in (t for batch in batches for _, t in stretches(batch)):
            parts = []
            for s in shingle_sets(texts, size):
                if not len(s):
                    continue
                key = set_key(s)
                if key in seen:
                    continue
                seen.add(key)
                p = prefix_length(len(s), percent)
                if len(often):
                    at = np.minimum(np.searchsorted(often, s), len(often) - 1)
                    last = often[at] == s
                    s = np.concatenate([s[~last], s[last]])
                rows = np.empty(p, _POSTING)
                rows["token"], rows["key"], rows["n"], rows["pos"] = s[:p], key, len(s), np.arange(p)
                parts.append(rows)
            if not parts:
                continue
            rows = np.concatenate(parts)
            # The low bits deal; the order of a set runs over the whole hash.
            b = (rows["token"] % np.uint64(buckets)).astype(np.int64)
            o = np.argsort(b, kind="stable")
            rows, b = rows[o], b[o]
            cut = np.flatnonzero(np.r_[True, b[1:] != b[:-1]])
            ends = np.r_[cut[1:], len(rows)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(b[cut]), pa.array([rows[i:j].tobytes() for i, j in zip(cut, ends, strict=True)], pa.binary())], ["bucket", "records"]
            )

    return run


def _lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Postings whose shingle two sets or more share: (token, key, n, pos, size of the list)."""
    blobs = [x.as_py() for batch in batches for x in batch.column("records")]
    rows = np.frombuffer(b"".join(blobs), _POSTING)
    del blobs
    if not len(rows):
        return
    rows = rows[np.lexsort((rows["key"], rows["n"], rows["token"]))]
    same_token = np.r_[False, rows["token"][1:] == rows["token"][:-1]]
    rows = rows[~(same_token & np.r_[False, rows["key"][1:] == rows["key"][:-1]])]  # one set from several tasks
    start = np.flatnonzero(np.r_[True, rows["token"][1:] != rows["token"][:-1]])
    length = np.diff(np.r_[start, len(rows)])
    keep = np.repeat(length > 1, length)
    rows, sizes = rows[keep], np.repeat(length, length)[keep]
    for i in range(0, len(rows), 100_000):
        r = rows[i : i + 100_000]
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.ascontiguousarray(r["token"]).view(np.int64)), pa.array(np.ascontiguousarray(r["key"])), pa.array(r["n"].astype(np.int64)), pa.array(r["pos"].astype(np.int64)), pa.array(sizes[i : i + 100_000])],
            ["token", "key", "n", "pos", "size"],
        )


def _verify(size: int):
    """Rows sorted by (hub, deal, is_hub first): streams partners past their hub's set. (x, y, overlap, nx, ny)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, hub = None, None
        for rows, texts in (x for batch in batches for x in stretches(batch)):
            out = []
            for y, deal, is_hub, x, s in zip(*(rows.column(c).to_pylist() for c in ("hub", "deal", "is_hub", "key")), shingle_sets(texts, size), strict=True):
                if set_key(s) != (y if is_hub else x):
                    continue  # a row of a repeated id with another text
                if is_hub:
                    at, hub = (y, deal), s
                elif at == (y, deal):
                    i = np.searchsorted(hub, s)
                    out.append((x, y, int((hub[np.minimum(i, len(hub) - 1)] == s).sum()), len(s), len(hub)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], pa.int64()) for i in range(5)], ["x", "y", "overlap", "nx", "ny"])

    return run


def _filter_of(ids: DataFrame) -> np.ndarray:
    """A Bloom filter of ids; made by a bitwise or over its words."""
    size = min(MAX_FILTER_BITS, 1 << max(16, (8 * ids.count()).bit_length()))
    bits = ids.select(F.explode(F.array(*(F.pmod(F.xxhash64("doc_id", F.lit(s)), F.lit(size)) for s in (1, 2)))).alias("b"))
    words = bits.groupBy(F.shiftright("b", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(b & 63 as int))")).alias("v"))
    found = words.toArrow()  # at most MAX_FILTER_BITS / 64 rows
    out = np.zeros(size // 64, np.int64)
    out[found.column("w").to_numpy()] = found.column("v").to_numpy()
    return out


def compared(pairs: DataFrame, docs: DataFrame, reps: DataFrame, size: int, steps: Scratch) -> DataFrame:
    """pairs: distinct (x, y) names of sets. Adds the overlap and both sizes."""
    spark = docs.sparkSession
    deal = F.pmod(F.xxhash64("x"), F.greatest(F.ceil(F.col("partners") / HUB_ROWS), F.lit(1))).cast("int")
    loads = pairs.groupBy("y").agg(F.count(F.lit(1)).alias("partners"))
    dealt = steps.written(pairs.join(loads, "y").select("x", "y", deal.alias("deal")), "jaccard-pairs")
    hubs = dealt.select(F.col("y").alias("key"), F.col("y").alias("hub"), "deal", F.lit(True).alias("is_hub")).distinct()
    asked = dealt.select(F.col("x").alias("key"), F.col("y").alias("hub"), "deal", F.lit(False).alias("is_hub")).unionByName(hubs)
    asked = steps.written(asked.join(reps, "key").select("key", "hub", "deal", "is_hub", "doc_id"), "jaccard-asked")
    words = _filter_of(asked.select("doc_id").distinct())
    bits = spark.sparkContext.broadcast(words)
    hashed = docs.select("doc_id", "text", *(F.pmod(F.xxhash64("doc_id", F.lit(s)), F.lit(64 * len(words))).alias(f"h{s}") for s in (1, 2)))

    def may(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = bits.value.view(np.uint64)
        for batch in batches:
            keep = np.ones(batch.num_rows, bool)
            for c in ("h1", "h2"):
                h = batch.column(c).to_numpy().astype(np.uint64)
                keep &= (words[(h >> np.uint64(6)).astype(np.int64)] >> (h & np.uint64(63))) & np.uint64(1) == 1
            yield batch.select(["doc_id", "text"]).filter(pa.array(keep))

    few = hashed.mapInArrow(may, "doc_id bigint, text string")
    sent = asked.join(few, "doc_id").select("hub", "deal", "is_hub", "key", "text")
    by_hub = sent.repartition(count_partitions(spark), "hub", "deal").sortWithinPartitions("hub", "deal", F.col("is_hub").desc(), "key")
    return steps.written(by_hub.mapInArrow(_verify(size), "x bigint, y bigint, overlap bigint, nx bigint, ny bigint").distinct(), "jaccard-compared")


def components(links: DataFrame, steps: Scratch | None = None) -> DataFrame:
    """links: (x, y). (key, label): label is the least key that links reach.

    Every key takes the least of itself and its neighbours, and links are
    contracted to what their ends took, until none is left between two names; so
    each round joins only the links that the last has not settled.
    """
    steps = steps or Scratch(links.sparkSession)

    def between(x: Column, y: Column, df: DataFrame) -> DataFrame:
        ends = df.select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))
        return steps.written(ends.where("a < b").distinct(), "links")

    edges, labels = between(F.col("x"), F.col("y"), links), None
    while labels is None or not edges.isEmpty():
        both = edges.select(F.col("a").alias("key"), F.col("b").alias("o")).unionByName(edges.select(F.col("b").alias("key"), F.col("a").alias("o")))
        took = steps.written(both.groupBy("key").agg(F.min("o").alias("o")).select("key", F.least("key", "o").alias("label")), "labels")
        labels = took if labels is None else steps.written(_relabelled(labels, took), "labels")
        side = lambda c, took=took: took.select(F.col("key").alias(c), F.col("label").alias(f"l{c}"))
        edges = between(F.col("la"), F.col("lb"), edges.join(side("a"), "a").join(side("b"), "b"))
    return labels


def _relabelled(labels: DataFrame, took: DataFrame) -> DataFrame:
    """labels, where a label that ``took`` has as a key becomes what it took."""
    new = took.select(F.col("key").alias("label"), F.col("label").alias("new"))
    return labels.join(new, "label", "left").select("key", F.coalesce("new", "label").alias("label"))


def joined(labels: DataFrame, links: DataFrame, steps: Scratch) -> DataFrame:
    """labels: components so far; links: (x, y), new ones. The components of all: only links between two components are followed."""
    side = lambda c: labels.select(F.col("key").alias(c), F.col("label").alias(f"l{c}"))
    named = links.join(side("x"), "x", "left").join(side("y"), "y", "left").select(F.coalesce("lx", "x").alias("x"), F.coalesce("ly", "y").alias("y"))
    took = components(named, steps)
    alone = took.join(labels.select("key"), "key", "left_anti")
    return steps.written(_relabelled(labels, took).unionByName(alone.select("key", "label")), "labels")


def _pairs(long_lists: bool, leaders: int | None, percent: int, spread: bool = False):
    """Rows sorted by (token, n, key), a list within one partition. (x, y), and for short lists one row a shared shingle.

    leaders: ties of each set to so many sets of the list from other components; None: all pairs across components.
    spread: leaders are members of the list's largest component, others in each list, so that a set outside of it meets
    very many of them in one round, at the cost of a few pairs a posting.
    """

    def may_link(i: int, j, n: np.ndarray, near: np.ndarray):
        """What the comparisons with the list's leader say of i and j: shared shingles stand in the leader or outside of it."""
        known = (near[i] >= 0) & (near[j] >= 0)
        most = np.minimum(near[j] + n[i] - near[i], near[i] + n[j] - near[j])
        return ~known | (most >= overlap_needed(n[i], n[j], percent))

    def one(token, key, n, pos, comp, near) -> tuple[np.ndarray, np.ndarray]:
        none = np.zeros(0, np.int64)
        if leaders is not None:
            xs, ys = [none], [none]
            picked, used = [], set()
            if spread:
                names, sizes = np.unique(comp, return_counts=True)
                members = np.flatnonzero(comp == names[np.argmax(sizes)])
                picked = members[np.argsort(mixed(key[members].view(np.uint64) ^ token.view(np.uint64)[0]), kind="stable")[:leaders]].tolist()
            for i in () if spread else np.argsort(key, kind="stable"):
                if comp[i] not in used:
                    picked.append(i)
                    used.add(comp[i])
                    if len(picked) == leaders:
                        break
            for i in picked:
                fits = (comp != comp[i]) & (100 * np.minimum(n, n[i]) >= percent * np.maximum(n, n[i])) & may_link(i, slice(None), n, near)
                xs.append(key[fits])
                ys.append(np.full(int(fits.sum()), key[i]))
            return np.concatenate(xs), np.concatenate(ys)
        xs, ys = [none], [none]
        # Entries stand by size and position. Partners of fitting size are one stretch; of its blocks, those are skipped whose
        # least position leaves too few shingles after it: the first shared shingle of a pair bounds what can follow it in both.
        o = np.lexsort((pos, n))
        key, n, comp, near, rest = key[o], n[o], comp[o], near[o], (n - pos - 1)[o]
        upto = np.searchsorted(n, n * 100 // percent, side="right")
        firsts = np.arange(0, len(key), BLOCK)
        least_n, most_rest = n[firsts], np.maximum.reduceat(rest, firsts)
        for i in range(len(key)):
            j = np.arange(i + 1, upto[i])
            if long_lists:
                b = np.arange((i + 1) // BLOCK, -(-upto[i] // BLOCK))
                b = b[1 + np.minimum(rest[i], most_rest[b]) >= overlap_needed(n[i], np.maximum(least_n[b], n[i]))]
                j = (b[:, None] * BLOCK + np.arange(BLOCK)).ravel()
                j = j[(j > i) & (j < upto[i])]
                j = j[1 + np.minimum(rest[i], rest[j]) >= overlap_needed(n[i], n[j])]
                j = j[may_link(i, j, n, near)]
            ks = key[j[comp[j] != comp[i]]]
            xs.append(np.maximum(ks, key[i]))
            ys.append(np.minimum(ks, key[i]))
        return np.concatenate(xs), np.concatenate(ys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []  # the last list so far, by batch
        cols = ("token", "key", "n", "pos", "comp", "near")

        def emit(a: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            start = np.flatnonzero(np.r_[True, a[0][1:] != a[0][:-1]])
            out, held = [], 0
            for i, j in zip(start, np.r_[start[1:], len(a[0])], strict=True):
                got = one(*(c[i:j] for c in a))
                out.append(got)
                held += len(got[0])
                if held > 200_000:
                    yield _two(out)
                    out, held = [], 0
            if held:
                yield _two(out)

        for batch in batches:
            a = [batch.column(c).to_numpy(zero_copy_only=False) for c in cols]
            if not len(a[0]):
                continue
            if held and a[0][-1] == held[0][0][0]:
                held.append(a)
                continue
            a = [np.concatenate(parts) for parts in zip(*held, a, strict=True)]
            cut = int(np.searchsorted(a[0], a[0][-1]))  # the last list may go on
            if cut:
                yield from emit([c[:cut] for c in a])
            held = [[c[cut:] for c in a]]
        if held:
            yield from emit([np.concatenate(parts) for parts in zip(*held, strict=True)])

    return run


def _two(out: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    x, y = (np.concatenate([o[k] for o in out]) for k in (0, 1))
    return pa.RecordBatch.from_arrays([pa.array(np.maximum(x, y)), pa.array(np.minimum(x, y))], ["x", "y"])


def _emitted(lists: DataFrame, long_lists: bool, leaders: int | None, percent: int, spread: bool = False) -> DataFrame:
    rows = lists.select("token", "key", "n", "pos", "comp", "near")
    by_list = rows.repartition(count_partitions(lists.sparkSession), "token").sortWithinPartitions("token", "n", "key")
    return by_list.mapInArrow(_pairs(long_lists, leaders, percent, spread), "x bigint, y bigint")


def jaccard_groups(docs: DataFrame, size: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """docs: (doc_id, text). (doc_id, n_shingles, component_id, text_hash, component), a row for each row.

    text_hash is xxhash64 of the text and tells rows with one id apart; component
    names the component whatever ids its rows have, and is null for an empty set.
    """
    spark, steps = docs.sparkSession, Scratch(docs.sparkSession)
    docs = docs.select(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NO_ID)).alias("doc_id"), "text", F.xxhash64("text").alias("text_hash"))
    schema = "doc_id bigint, text_hash bigint, n bigint, key bigint, token bigint, count bigint"
    read = steps.written(docs.mapInArrow(_set_rows(percent, size), schema), "jaccard-sets")
    rows = read.where("token IS NULL").select("doc_id", "text_hash", "n", "key")
    real = lambda c: F.nullif(F.col(c), F.lit(NO_ID))
    repeats = read.where("token IS NOT NULL").groupBy("token").agg(F.sum("count").alias("c"))
    total = repeats.agg(F.sum("c")).first()[0] or 0
    # At most MAX_FREQUENT shingles can have so many of the counted repeats.
    least = max(FREQUENT, -(-total // MAX_FREQUENT))
    frequent = repeats.where(F.col("c") >= least).select("token").toArrow().column("token").to_numpy().view(np.uint64)
    frequent = spark.sparkContext.broadcast(np.sort(frequent))
    parts = count_partitions(spark)
    blobs = docs.mapInArrow(_postings(frequent, 8 * parts, percent, size), "bucket bigint, records binary").repartition(parts, "bucket")
    lists = steps.written(blobs.mapInArrow(_lists, "token bigint, key bigint, n bigint, pos bigint, size bigint"), "jaccard-lists")
    reps = rows.where("key IS NOT NULL").groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"))

    alone = {"comp": F.col("key"), "near": F.lit(-1).cast("bigint")}
    short = lists.where(F.col("size") <= SHORT).withColumns(alone)
    long_ = steps.written(lists.where(F.col("size") > SHORT).select("token", "key", "n", "pos"), "jaccard-long")
    shared = _emitted(short, False, None, percent).groupBy("x", "y").agg(F.count(F.lit(1)).alias("c"))
    # What the prefixes share, long lists counted in full, and what may follow the prefixes bound the overlap.
    more = long_.groupBy("key").agg(F.count(F.lit(1)).alias("b"))
    known = reps.select("key", "n").join(more, "key", "left").select("key", "n", F.coalesce("b", F.lit(0)).alias("b"))
    side = lambda c: known.select(F.col("key").alias(c), F.col("n").alias(f"n{c}"), F.col("b").alias(f"b{c}"))
    sized = shared.join(side("x"), "x").join(side("y"), "y")
    after = lambda c: F.ceil(percent * F.col(f"n{c}") / 100) - 1
    needed = F.ceil(percent * (F.col("nx") + F.col("ny")) / (100 + percent))
    close = sized.where(F.col("c") + F.least("bx", "by") + F.greatest(after("x"), after("y")) >= needed).select("x", "y")
    ties = steps.written(_emitted(long_.withColumns(alone), True, LEADERS, percent).distinct(), "jaccard-ties")
    linked = F.expr(f"100 * overlap >= {percent} * (nx + ny - overlap)")
    known_ = compared(steps.written(close.union(ties).distinct(), "jaccard-close"), docs, reps, size, steps)
    labels = components(known_.where(linked), steps)

    turn = 0
    # A list's first leader is its least key; what each set shares with it decides later pairs without their texts.
    leads = long_.groupBy("token").agg(F.min("key").alias("lead"))
    while not long_.isEmpty():
        comp = steps.written(long_.join(labels, "key", "left").select("token", "key", "n", "pos", F.coalesce("label", "key").alias("comp")), "jaccard-long")
        per = comp.groupBy("token", "comp").agg(F.count(F.lit(1)).alias("c")).groupBy("token")
        per = steps.written(per.agg(F.sum("c").alias("l"), F.sum(F.col("c") * F.col("c")).alias("s")).where("s < l * l"), "jaccard-open")
        # Lists within one component have nothing to add: answers follow from their leader's.
        size_, pairs = per.agg(F.sum("l"), F.sum(F.expr("(l * l - s) / 2"))).first()
        if size_ is None:
            break
        last = turn == ROUNDS or pairs <= PAIRS_PER_POSTING * size_
        open_ = comp.join(per.select("token"), "token", "left_semi").join(leads, "token")
        shares = known_.select(F.col("x").alias("key"), F.col("y").alias("lead"), F.col("overlap").alias("near"))
        near = F.when(F.col("key") == F.col("lead"), F.col("n")).otherwise(F.coalesce("near", F.lit(-1)))
        open_ = open_.join(shares, ["key", "lead"], "left").withColumn("near", near)
        turn += 1
        more = _emitted(open_, True, None if last else LEADERS, percent, not last).distinct().join(known_, ["x", "y"], "left_anti")
        more = steps.written(more, "jaccard-more")
        if not more.isEmpty():
            fresh = compared(more, docs, reps, size, steps)
            known_ = known_.unionByName(fresh)
            labels = joined(labels, fresh.where(linked), steps)
        if last:
            break

    named = rows.join(labels, "key", "left").select("doc_id", "text_hash", "n", "key", F.coalesce("label", "key").alias("label"))
    least_id = steps.written(named.where("label IS NOT NULL").groupBy("label").agg(F.min(real("doc_id")).alias("component_id")), "jaccard-names")
    own = F.when(F.col("key").isNull(), real("doc_id")).otherwise(F.col("component_id"))
    out = named.join(least_id, "label", "left").select(real("doc_id").alias("doc_id"), F.col("n").alias("n_shingles"), own.alias("component_id"), "text_hash", F.col("label").alias("component"))
    out = written(out, "jaccard")
    frequent.unpersist()
    steps.clear()
    return out


def jaccard_components(docs: DataFrame, size: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """docs: (doc_id, text). (doc_id, n_shingles, component_id), a row for each row."""
    return jaccard_groups(docs, size, percent).select("doc_id", "n_shingles", "component_id")


def op9_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents").select("doc_id", "text"))


OP9_SQL = r"""
WITH w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM w),
t AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM s),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, a.n + b.n AS n, count(*) AS i FROM t a JOIN t b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM i WHERE 100 * i >= 75 * (n - i)),
r AS (WITH RECURSIVE reach(a, b) AS (SELECT doc_id, doc_id FROM s UNION SELECT reach.a, l.b FROM reach JOIN l ON reach.b = l.a) SELECT a, min(b) AS c FROM reach GROUP BY a)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, r.c AS component_id FROM s JOIN r ON r.a = s.doc_id"""

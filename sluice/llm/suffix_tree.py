"""LM scoring with a probabilistic suffix tree over bytes, kept in parts.

A text is the bytes of its lower-cased words, joined by single spaces, and an
end mark. The tree's states are contexts of at most ``DEPTH`` bytes. Contexts of
at most ``HEAD`` bytes are all states. A longer one is a state if it occurs at
least ``LEAST`` times and its next-byte distribution diverges from its suffix's
(a likelihood-ratio test with BIC's price a parameter), or if a longer state
needs it. Distributions are smoothed by Witten-Bell toward the suffix, down to a
uniform mixture at the root, so each is proper and the score is a
log-probability of the whole text. A byte is scored in the longest state that is
a suffix of what precedes it.

The tree grows with the corpus, so it is in no one place. Texts are dealt to
chunks; a chunk asks for each gram (context and byte) that it holds, once, with
its count in training texts. Grams meet by the last ``PART`` bytes of their
context: all states longer than that lie whole in one part, where they are grown
and every gram that was asked for is scored; the answers go back to the chunks.
A part is a few grams of every chunk, in blocks of bytes. Only the head is
broadcast: contexts of at most two bytes, so 256 ** 3 entries at any size.

Token counts for the base score stay in a table; at most ``MAX_COMMON`` tokens
can be frequent enough to be broadcast, the others are joined.

Defined results: null and empty texts are one end mark; a null id is the text
"null" for the fold; repeated rows each get a row and count each, and those with
one id and text share a chunk; without training texts every byte is equally
likely and the base score is 0.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.llm.common import Scratch, count_partitions, table, written
from sluice.llm.shingles import stretches, word_hashes

DEPTH = 6
#: Contexts of so many bytes are all states, and broadcast; grams meet by one byte more.
HEAD = 2
PART = HEAD + 1
#: Occurrences that a longer context must have.
LEAST = 2
#: Bytes of a chunk of texts at most, though one text may be longer; and at least, where fewer chunks would leave tasks idle.
CHUNK, LEAST_CHUNK = 8_000_000, 2_000_000
#: Parts for each partition of a shuffle.
SPREAD = 8
#: Tokens that can each be 1 / MAX_COMMON of all tokens: the broadcast part of the token counts.
MAX_COMMON = 1_000_000
FOLDS = 10
_LOWER = np.frombuffer(bytes(range(256)).lower(), np.uint8)
_SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
END = 0x0A
#: Distinct grams or tokens that a task holds before it passes its counts on.
HELD = 3_000_000


def held_out(doc_id):
    """The test fold: crc32 of the id as text, modulo FOLDS, is 0."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("null")).cast("binary")) % FOLDS == 0


def grams(texts: list[str | None], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """All (context, byte) grams of some texts as integers, oldest byte highest, and where each text's begin."""
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    b = np.frombuffer(b"\n".join([b"", *raw, b""]), np.uint8)
    begins = np.r_[1, 1 + np.cumsum([len(r) + 1 for r in raw])]
    space = _SPACE[b]
    word = np.flatnonzero(space[:-1] & ~space[1:])  # the white space before each word
    row = np.searchsorted(begins, word + 1, side="right") - 1
    gap = word[1:][row[1:] == row[:-1]]  # between two words of a text
    keep = ~space
    keep[gap] = True
    at = np.flatnonzero(keep)
    value = _LOWER[b[at]]
    value[space[at]] = 0x20
    row = np.searchsorted(begins, at, side="right") - 1
    sizes = np.bincount(row, minlength=len(raw)) + 1
    # Text i's bytes stand behind i + 1 pads, which no context crosses, and are followed by an end mark.
    out = np.full(int(sizes.sum()) + len(raw) * depth, END, np.uint64)
    out[np.arange(len(at)) + (row + 1) * depth + row] = value
    kept = np.ones(len(out), bool)
    ends = np.cumsum(sizes)
    pads = (ends - sizes)[:, None] + np.arange(len(raw))[:, None] * depth + np.arange(depth)
    kept[pads.ravel()] = False
    for k in (1, 2, 4):  # eight bytes in three steps
        out[k:] |= out[:-k] << np.uint64(8 * k)
    g = out[kept]
    return g & np.uint64((1 << 8 * (depth + 1)) - 1), ends - sizes


def _combined(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, counts = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
    codes, found = pd.factorize(keys)
    return found, np.bincount(codes, counts).astype(np.int64)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(kind, key, count) over training texts: kind 0 tokens by hash, 1 grams of the head; and kind 2, the bytes of all texts."""
    held: tuple[list, list] = ([], [])
    size = 0

    def passed(kind: int) -> Iterator[pa.RecordBatch]:
        k, c = _combined(held[kind])
        held[kind].clear()
        for i in range(0, len(k), 500_000):
            key = k[i : i + 500_000]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key), kind, np.int32)), pa.array(key.view(np.int64)), pa.array(c[i : i + 500_000])], ["kind", "key", "count"])

    for part, texts in (x for batch in batches for x in stretches(batch)):
        size += sum(len(t or "") + 1 for t in texts)
        texts = [t for t, out in zip(texts, part.column("held_out").to_pylist(), strict=True) if not out]
        if not texts:
            continue
        for kind, found in ((0, word_hashes(texts)[0]), (1, grams(texts, HEAD)[0])):
            codes, names = pd.factorize(found)
            held[kind].append((names, np.bincount(codes, minlength=len(names)).astype(np.int64)))
        for kind in (0, 1):
            if sum(len(p[0]) for p in held[kind]) >= HELD:
                held[kind][:] = [_combined(held[kind])]
                if len(held[kind][0][0]) >= HELD // 2:
                    yield from passed(kind)
    for kind in (0, 1):
        if held[kind]:
            yield from passed(kind)
    yield pa.RecordBatch.from_arrays([pa.array([2], pa.int32()), pa.array([0], pa.int64()), pa.array([size], pa.int64())], ["kind", "key", "count"])


@dataclass
class SuffixTree:
    """For each depth: kept contexts, sorted; what each leaves to its suffix (log10); its grams, sorted; their log10 probabilities."""

    depth: int
    contexts: list[np.ndarray]
    left: list[np.ndarray]
    entries: list[np.ndarray]
    logp: list[np.ndarray]

    def score(self, g: np.ndarray) -> np.ndarray:
        """log10 P of each gram's last byte in the longest state that its context ends with."""
        out, todo = np.zeros(len(g)), np.arange(len(g))
        acc = np.zeros(len(g))
        for d in range(self.depth, -1, -1):
            low = g[todo] & np.uint64((1 << (8 * (d + 1))) - 1)
            ctx, known = low >> np.uint64(8), self.contexts[d]
            if not len(known):
                continue
            at = np.minimum(np.searchsorted(known, ctx), len(known) - 1)
            state = known[at] == ctx
            e = np.minimum(np.searchsorted(self.entries[d], low), len(self.entries[d]) - 1)
            hit = state & (self.entries[d][e] == low)
            out[todo[hit]] = acc[todo[hit]] + self.logp[d][e[hit]]
            miss = state & ~hit
            acc[todo[miss]] += self.left[d][at[miss]]
            todo = todo[~hit]
        return out


def _level(key: np.ndarray, count: np.ndarray, k: int) -> dict[str, np.ndarray]:
    """The contexts of k bytes of some grams: keys (context and byte), sorted, with counts; ``start`` and ``node`` tell where each context's keys stand."""
    low = key & np.uint64((1 << 8 * (k + 1)) - 1)
    names, codes = np.unique(low, return_inverse=True)
    n = np.bincount(codes, count, minlength=len(names))
    c = names >> np.uint64(8)
    start = np.flatnonzero(np.r_[True, c[1:] != c[:-1]]) if len(c) else np.zeros(0, int)
    node = np.repeat(np.arange(len(start)), np.diff(np.r_[start, len(c)]))
    total = np.add.reduceat(n, start) if len(start) else np.zeros(0)
    return {"key": names, "n": n, "start": start, "node": node, "total": total}


def grow_head(key: np.ndarray, count: np.ndarray) -> SuffixTree:
    """All contexts of at most HEAD bytes, from the counts of grams of that depth."""
    tree = SuffixTree(HEAD, [], [], [], [])
    p_above = np.zeros(0)
    for k in range(HEAD + 1):
        x = _level(key, count, k)
        if k == 0:  # every byte has some chance
            full = np.zeros(256)
            full[x["key"].astype(int)] = x["n"]
            keys, p, ctx, left = np.arange(256, dtype=np.uint64), (full + 1.0 / 256) / (full.sum() + 1.0), np.zeros(1, np.uint64), np.ones(1)
        else:
            keys, ctx = x["key"], x["key"][x["start"]] >> np.uint64(8)
            kinds = np.bincount(x["node"], minlength=len(ctx)).astype(float)
            up = p_above[np.searchsorted(tree.entries[k - 1], keys & np.uint64((1 << 8 * k) - 1))]
            p = (x["n"] + kinds[x["node"]] * up) / (x["total"] + kinds)[x["node"]]
            left = kinds / (x["total"] + kinds)
        tree.contexts.append(ctx)
        tree.left.append(np.log10(np.maximum(left, 1e-300)))
        tree.entries.append(keys)
        tree.logp.append(np.log10(p))
        p_above = p
    return tree


def grow(key: np.ndarray, count: np.ndarray, head: SuffixTree, depth: int, least: int = LEAST) -> SuffixTree:
    """The head and the longer states of some grams (context of ``depth`` bytes and the next), whose contexts' counts are all among them."""
    tree = SuffixTree(depth, list(head.contexts), list(head.left), list(head.entries), list(head.logp))
    above_key, above_p = head.entries[HEAD], 10.0 ** head.logp[HEAD]
    levels = []
    for k in range(HEAD + 1, depth + 1):
        x = _level(key, count, k)
        enough = x["total"] >= least
        rows = enough[x["node"]]
        keys, n = x["key"][rows], x["n"][rows]
        node = (np.cumsum(enough) - 1)[x["node"][rows]]
        total = x["total"][enough]
        start = np.flatnonzero(np.r_[True, node[1:] != node[:-1]]) if len(node) else np.zeros(0, int)
        kinds = np.bincount(node, minlength=len(total)).astype(float)
        up = above_p[np.searchsorted(above_key, keys & np.uint64((1 << 8 * k) - 1))]
        p = (n + kinds[node] * up) / (total + kinds)[node]
        gain = 2 * np.add.reduceat(n * np.log(n / total[node] / up), start) if len(start) else np.zeros(0)
        levels.append({"ctx": keys[start] >> np.uint64(8), "key": keys, "node": node, "p": p, "left": kinds / (total + kinds), "keep": gain > kinds * np.log(total)})
        above_key, above_p = keys, p
    for k in range(len(levels) - 1, 0, -1):  # suffixes of what is kept
        up = np.unique(levels[k]["ctx"][levels[k]["keep"]] & np.uint64((1 << 8 * (HEAD + k)) - 1))
        levels[k - 1]["keep"][np.searchsorted(levels[k - 1]["ctx"], up)] = True
    for x in levels:
        keep = x["keep"][x["node"]]
        tree.contexts.append(x["ctx"][x["keep"]])
        tree.left.append(np.log10(x["left"][x["keep"]]))
        tree.entries.append(x["key"][keep])
        tree.logp.append(np.log10(x["p"][keep]))
    return tree


# What chunks and parts tell each other


def _by_part(keys: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of sorted grams by part, and where each part begins."""
    h = ((keys >> np.uint64(8)) & np.uint64((1 << 8 * PART) - 1)) * np.uint64(0x9E3779B97F4A7C15)
    part = ((h >> np.uint64(40)) % np.uint64(parts)).astype(np.int32)
    order = np.argsort(part.astype(np.uint16) if parts < 1 << 16 else part, kind="stable")
    return order, np.searchsorted(part[order], np.arange(parts + 1))


def _packed(values: np.ndarray) -> bytes:
    """Bytes of one significance stand together, which compresses."""
    return pa.compress(np.ascontiguousarray(values.view(np.uint8).reshape(len(values), -1).T).tobytes(), codec="zstd", asbytes=True)


def _unpacked(data: bytes, n: int, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    raw = pa.decompress(data, decompressed_size=n * size, codec="zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, n).T).view(kind).ravel()


def _tallied(g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct grams, ascending, and how often each stands there."""
    g = np.sort(g)
    first = np.flatnonzero(np.r_[True, g[1:] != g[:-1]]) if len(g) else np.zeros(0, int)
    return g[first], np.diff(np.r_[first, len(g)])


def _asked(parts: int, depth: int):
    """Rows sorted by chunk. (part, chunk, n, grams, counts): each chunk's distinct grams by part, ascending, as differences; counts in its training texts."""

    def told(chunk: int, held: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        keys = np.concatenate([x[0] for x in held])
        order = np.argsort(keys)
        counts = np.concatenate([x[1] for x in held])[order]
        keys = keys[order]
        first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        keys, counts = keys[first], np.add.reduceat(counts, first).astype(np.uint32)
        order, begins = _by_part(keys, parts)
        keys, counts = keys[order], counts[order]
        some = np.flatnonzero(np.diff(begins))
        cuts = list(zip(begins[some].tolist(), begins[some + 1].tolist(), strict=True))
        return pa.RecordBatch.from_arrays(
            [pa.array(some.astype(np.int32)), pa.array(np.full(len(some), chunk, np.int32)), pa.array([j - i for i, j in cuts], pa.int32()),
             pa.array([_packed(np.diff(keys[i:j], prepend=np.uint64(0))) for i, j in cuts], pa.binary()), pa.array([_packed(counts[i:j]) for i, j in cuts], pa.binary())],
            ["part", "chunk", "n", "grams", "counts"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        at = None
        for rows, texts in (x for batch in batches for x in stretches(batch)):
            chunks = rows.column("chunk").to_numpy()
            out = rows.column("held_out").to_numpy(zero_copy_only=False)
            g, starts = grams(texts, depth)
            ends = np.r_[starts[1:], len(g)]
            cuts = np.r_[0, np.flatnonzero(chunks[1:] != chunks[:-1]) + 1, len(chunks)]
            for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                if chunks[i] != at:
                    if held:
                        yield told(at, held)
                    at, held = int(chunks[i]), []
                own = g[starts[i] : ends[j - 1]]
                counted = np.repeat(~out[i:j], ends[i:j] - starts[i:j])
                held.append(_tallied(own[counted]))
                asked = _tallied(own[~counted])[0]
                held.append((asked, np.zeros(len(asked), np.int64)))
        if held:
            yield told(at, held)

    return run


def _answered(head, depth: int, least: int):
    """Rows sorted by part: what _asked tells. (chunk, part, logp): grows the part's states and scores its grams, in the order in which each chunk asked."""

    def answer(rows: list[tuple[int, int, np.ndarray, np.ndarray]], part: int) -> pa.RecordBatch:
        keys, counts = np.concatenate([r[1] for r in rows]), np.concatenate([r[2] for r in rows])
        names, codes = np.unique(keys, return_inverse=True)
        total = np.bincount(codes, counts, minlength=len(names))
        seen = total > 0
        tree = grow(names[seen], total[seen], head.value, depth, least)
        logp = tree.score(names).astype(np.float32)[codes]
        ends = np.cumsum([len(r[1]) for r in rows])
        told = [_packed(logp[e - len(r[1]) : e]) for r, e in zip(rows, ends.tolist(), strict=True)]
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([part] * len(rows), pa.int32()), pa.array([len(r[1]) for r in rows], pa.int32()), pa.array(told, pa.binary())], ["chunk", "part", "n", "logp"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []
        for batch in batches:
            for part, chunk, n, keys, counts in zip(*(batch.column(c).to_pylist() for c in ("part", "chunk", "n", "grams", "counts")), strict=True):
                if part != at:
                    if held:
                        yield answer(held, at)
                    at, held = part, []
                held.append((chunk, np.cumsum(_unpacked(keys, n, np.uint64)), _unpacked(counts, n, np.uint32)))
        if held:
            yield answer(held, at)

    return run


_ROWS = pa.schema([("rid", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_common", pa.int64()), ("base_common", pa.float64()), ("score", pa.float64()), ("token", pa.int64()), ("tf", pa.int64())])


def _scored(common, parts: int, depth: int):
    """Of a chunk's texts and answers: a row a text (token null), and a row for each of its uncommon tokens (doc_id null); ``rid`` names a row of the input."""

    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        keys, logs = common.value
        out, held = [], []
        rid0 = docs.column("chunk")[0].as_py() << 40 if docs.num_rows else 0
        n_rows = 0
        for batch in docs.combine_chunks().to_batches():
            for part, texts in stretches(batch):
                g, starts = grams(texts, depth)
                codes, names = pd.factorize(g)
                held.append((codes.astype(np.int32), names, starts))
                n = len(texts)
                found, sizes = word_hashes(texts)
                words, kinds = pd.factorize(found)
                at = np.full(len(kinds), -1)
                if len(keys):
                    p = np.minimum(np.searchsorted(keys, kinds), len(keys) - 1)
                    at = np.where(keys[p] == kinds, p, -1)
                doc = np.repeat(np.arange(n), sizes)
                place = at[words]
                seen = place >= 0
                n_common = np.bincount(doc[seen], minlength=n)
                base = np.bincount(doc[seen], logs[place[seen]], minlength=n) if seen.any() else np.zeros(n)
                rid = rid0 + n_rows + np.arange(n)
                n_rows += n
                out.append([pa.array(rid), part.column("doc_id"), part.column("held_out"), pa.array(sizes + 1), pa.array(n_common), pa.array(base), None, pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64())])
                rare = doc[~seen] * len(kinds) + words[~seen]
                if len(rare):
                    pair, tf = np.unique(rare, return_counts=True)
                    none = [pa.nulls(len(pair), _ROWS.field(i).type) for i in range(1, 7)]
                    out.append([pa.array(rid[pair // len(kinds)]), *none, pa.array(kinds[pair % len(kinds)].view(np.int64)), pa.array(tf)])
        if not held:
            return _ROWS.empty_table()
        found = np.concatenate([h[1] for h in held])
        by_gram = np.argsort(found)
        first = np.r_[True, np.diff(found[by_gram]) != 0]
        place = np.empty(len(found), np.int64)
        place[by_gram] = np.cumsum(first) - 1
        names = found[by_gram[first]]
        order, _ = _by_part(names, parts)
        rows = sorted(zip(*(answers.column(c).to_pylist() for c in ("part", "n", "logp")), strict=True))
        logp = np.empty(len(names))
        logp[order] = np.concatenate([_unpacked(x, n, np.float32) for _, n, x in rows])
        cuts = np.cumsum([0, *(len(h[1]) for h in held)]).tolist()
        scores = iter([np.add.reduceat(logp[place[i:j]][codes], starts) for i, j, (codes, _, starts) in zip(cuts[:-1], cuts[1:], held, strict=True)])
        for x in out:
            if x[6] is None:
                x[6] = pa.array(next(scores))
        return pa.Table.from_batches([pa.RecordBatch.from_arrays(x, schema=_ROWS) for x in out])

    return run


def lm_scores(docs: DataFrame, depth: int = DEPTH, least: int = LEAST) -> DataFrame:
    """docs: (doc_id, text). One row each: held_out, n_tokens, n_known, train_tokens, base_score and score. depth: from PART to 7."""
    if not PART <= depth <= 7:
        raise ValueError(f"depth {depth}")
    spark, steps = docs.sparkSession, Scratch(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", held_out(F.col("doc_id")).alias("held_out"))
    sums = docs.select("text", "held_out").mapInArrow(_count, "kind int, key bigint, count bigint").groupBy("kind", "key").agg(F.sum("count").alias("count"))
    counts = steps.written(sums, "lm-counts")
    tokens = counts.where("kind = 0").select("key", "count")
    seen = tokens.agg(F.coalesce(F.sum("count"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()
    ends = docs.where(~F.col("held_out")).count()
    total, kinds = seen["n"] + ends, seen["v"] + (ends > 0)
    whole = math.log10(total + 0.1 * (kinds + 1))
    # Contexts of at most two bytes and the next: no corpus has more than 256 ** 3.
    t = counts.where("kind = 1").select("key", "count").toArrow()
    head = spark.sparkContext.broadcast(grow_head(t.column("key").to_numpy().astype(np.uint64), t.column("count").to_numpy()))
    # No more than MAX_COMMON tokens can each have so large a share of all.
    enough = max(2, -(-total // MAX_COMMON))
    often = tokens.where(F.col("count") >= enough).toArrow()
    key, count = often.column("key").to_numpy().view(np.uint64), often.column("count").to_numpy()
    o = np.argsort(key)
    common = spark.sparkContext.broadcast((key[o], np.log10(count[o] + 0.1) - whole))
    size = counts.where("kind = 2").agg(F.coalesce(F.sum("count"), F.lit(0))).first()[0]
    n, parts = count_partitions(spark), SPREAD * count_partitions(spark)
    chunks = max(1, -(-size // CHUNK), min(n, size // LEAST_CHUNK))
    # One exchange of texts: the plan reads it for what chunks ask, and again for what they are answered.
    n = max(chunks, n)
    dealt = docs.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "text"), F.lit(chunks)).cast("int")).repartition(n, "chunk")
    asked = dealt.sortWithinPartitions("chunk").mapInArrow(_asked(parts, depth), "part int, chunk int, n int, grams binary, counts binary")
    by_part = asked.repartition(count_partitions(spark), "part").sortWithinPartitions("part", "chunk")
    answers = by_part.mapInArrow(_answered(head, depth, least), "chunk int, part int, n int, logp binary")
    schema = "rid bigint, doc_id bigint, held_out boolean, n_tokens bigint, n_common bigint, base_common double, score double, token bigint, tf bigint"
    both = steps.written(dealt.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(_scored(common, parts, depth), schema), "lm-rows")
    log_p = F.log10(F.coalesce("count", F.lit(0)) + F.lit(0.1)) - F.lit(whole)
    rare = both.where("token IS NOT NULL").select("rid", "token", "tf").join(tokens.where(F.col("count") < enough).withColumnRenamed("key", "token"), "token", "left")
    per = rare.groupBy("rid").agg(F.sum(F.col("tf") * log_p).alias("base_rare"), F.sum(F.when(F.col("count") > 0, F.col("tf")).otherwise(0)).alias("known_rare"))
    end = math.log10(ends + 0.1) - whole
    rows = both.where("token IS NULL").join(per, "rid", "left")
    out = rows.select(
        "doc_id", "held_out", "n_tokens",
        (F.col("n_common") + F.coalesce("known_rare", F.lit(0)) + F.lit(int(ends > 0))).cast("bigint").alias("n_known"),
        F.lit(total).cast("bigint").alias("train_tokens"),
        (F.col("base_common") + F.coalesce("base_rare", F.lit(0.0)) + F.lit(end)).alias("base_score"), "score",
    )
    out = written(out, "lm-scores")
    steps.clear()
    return out


def op2_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(table(spark, sf_dir, "documents").select("doc_id", "text"))

"""SentencePiece encoding and decoding, with distinct sampled segmentations.

The pieces of a public SentencePiece vocabulary span a lattice over each text:
a node a code point, an edge a piece, or the bytes of a code point that no piece
holds. An edge weighs theta times the log of its piece's Zipf share by rank. The
operator draws, for each row, the top k of all segmentations by Gumbel-perturbed
log-probability, which is sampling k without replacement, by perturbed A-star:

* backward sums over the lattice are exact heuristics, so the first goal popped,
  a plain forward sample, has the root's Gumbel value;
* what remains of a popped region is parted by where a segmentation first leaves
  the popped one; each part's best value is a Gumbel of its mass, cut off at the
  popped value; the next goal lies in the part with the greatest;
* the (k+1)-th value is the threshold kappa, and a sample's inclusion score is
  P(perturbed value > kappa) = 1 - exp(-exp(log p - kappa)).

Random numbers are hashes of (row key, sample, word, step), so results do not
depend on batches, partitions or retries. No piece spans the start of a word, so
lattices are built once a distinct word and chunk, by numpy over all positions.
The driver reads the model and broadcasts it.

Defined results: null and empty texts have the one empty segmentation; a text
with fewer than k segmentations gets as many rows as it has; a null key is the
text "null"; rows with one key and text get equal samples; memory is bounded by
the chunk, or by the longest text if it is longer.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.llm.common import table

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Bytes that a model's file may have; it is broadcast.
MAX_MODEL = 64 << 20
SAMPLES = 2
THETA = 0.6
#: Ranks are shifted by this much, which flattens the head of the Zipf curve.
RANK_SHIFT = 10.0
#: Code points that are segmented at a time.
CHUNK = 1_500_000
#: Sums along a text are made of integer multiples of this, which are exact in any order: 2 ** 63 of them are 3e7 nats.
_GRAIN = 2.0**-38
SPACE = "▁"
_UNIT = re.compile(f"{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n")
_U = np.uint64


class Vocabulary:
    """Pieces of a model, given as the bytes of its file, as a trie in an open-addressed table."""

    def __init__(self, model: bytes) -> None:
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        n = self.sp.get_piece_size()
        self.bytes_of = [b""] * n
        normal: list[tuple[str, int]] = []
        self.byte_id = np.zeros(256, np.int32)
        for i in range(n):
            if self.sp.is_byte(i):
                b = int(self.sp.id_to_piece(i)[3:5], 16)
                self.byte_id[b], self.bytes_of[i] = i, bytes([b])
            elif not (self.sp.is_control(i) or self.sp.is_unknown(i) or self.sp.is_unused(i)):
                p = self.sp.id_to_piece(i)
                self.bytes_of[i] = p.encode()
                if not _UNIT.fullmatch(p) or (p[0] != SPACE and SPACE in p) or len(p.lstrip(SPACE)) + 1 < len(p) != p.count(SPACE):
                    raise ValueError(f"piece {p!r} spans the start of a word")
                normal.append((p, i))
        self.n_bytes = np.array([len(b) for b in self.bytes_of], np.int64)
        self.begins, self.all_bytes = np.cumsum(self.n_bytes) - self.n_bytes, np.frombuffer(b"".join(self.bytes_of), np.uint8)
        rank = np.arange(len(normal)) + RANK_SHIFT
        self.log_p = np.full(n, -np.inf)
        self.log_p[[i for _, i in normal]] = -np.log(rank) - np.log((1 / rank).sum())
        #: A byte costs more than the rarest piece.
        self.log_byte = -np.log(rank[-1]) - np.log((1 / rank).sum()) - 1.0
        nodes: dict[tuple[int, int], int] = {}
        self.ends = [-1]
        for p, i in normal:
            at = 0
            for c in map(ord, p):
                nxt = nodes.get((at, c))
                if nxt is None:
                    nxt = nodes[at, c] = len(self.ends)
                    self.ends.append(-1)
                at = nxt
            self.ends[at] = i
        self.ends = np.array(self.ends, np.int32)
        bits = max(10, int(np.ceil(np.log2(len(nodes) * 3 + 1))))
        self.shift, self.mask = _U(64 - bits), (1 << bits) - 1
        self.keys, self.child = np.full(1 << bits, -1, np.int64), np.full(1 << bits, -1, np.int32)
        for (a, c), child in nodes.items():
            h = ((a << 21 | c) * 0x9E3779B97F4A7C15 & (1 << 64) - 1) >> (64 - bits)
            while self.keys[h] >= 0:
                h = h + 1 & self.mask
            self.keys[h], self.child[h] = a << 21 | c, child

    def step(self, node: np.ndarray, cp: np.ndarray) -> np.ndarray:
        """The children of trie nodes by code points, -1 for none."""
        key = node.astype(np.int64) << 21 | cp
        h = ((key.view(_U) * _U(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)
        k = self.keys[h]
        out = np.where(k == key, self.child[h], -1)
        todo = np.flatnonzero((k != key) & (k >= 0))
        while len(todo):
            h[todo] = (h[todo] + 1) & self.mask
            k = self.keys[h[todo]]
            hit = k == key[todo]
            out[todo[hit]] = self.child[h[todo[hit]]]
            todo = todo[~hit & (k >= 0)]
        return out

    def decode(self, ids) -> str:
        """The text of some pieces: marks become spaces, and the one in front goes."""
        raw = b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")
        return raw.replace(SPACE, " ")[1:]

    def spells(self, ids: np.ndarray, n_ids: np.ndarray, raw: list[bytes]) -> np.ndarray:
        """Which texts the bytes of their pieces are; ids of one text follow those of another."""
        sizes = self.n_bytes[ids]
        made = self.all_bytes[_ragged(self.begins[ids], sizes)]
        ends = np.r_[0, np.cumsum(sizes)][np.cumsum(n_ids)]
        n_made = np.diff(np.r_[0, ends])
        n_raw = np.array([len(r) for r in raw], np.int64)
        same = n_made == n_raw
        if same.all():
            wrong = np.flatnonzero(made != np.frombuffer(b"".join(raw), np.uint8))
            same[np.searchsorted(ends, wrong, side="right")] = False
            return same
        return np.array([ok and made[e - m : e].tobytes() == r for ok, e, m, r in zip(same.tolist(), ends.tolist(), n_made.tolist(), raw, strict=True)], bool)

    def normalize(self, text: str) -> str:
        return self.sp.normalize(text) if text else ""


def model_bytes(path: str) -> bytes:
    """The model's file, which only the driver has to have; an error for one that is too large to broadcast."""
    with open(path, "rb") as file:
        data = file.read(MAX_MODEL + 1)
    if len(data) > MAX_MODEL:
        raise ValueError(f"{path} has more than {MAX_MODEL} bytes")
    return data


@cache
def vocabulary_of(model: bytes) -> Vocabulary:
    """One a worker."""
    return Vocabulary(model)


def vocabulary(path: str) -> Vocabulary:
    return vocabulary_of(model_bytes(path))


@np.errstate(over="ignore")
def _mixed(state: np.ndarray, nth: int, part) -> np.ndarray:
    """A state of the hash with its nth part taken in."""
    x = state + (np.asarray(part).astype(np.int64).view(_U) + _U(nth)) * _U(0x9E3779B97F4A7C15)
    t = x >> _U(30)
    x ^= t
    x *= _U(0xBF58476D1CE4E5B9)
    np.right_shift(x, _U(27), out=t)
    x ^= t
    x *= _U(0x94D049BB133111EB)
    np.right_shift(x, _U(31), out=t)
    x ^= t
    return x


def _fraction(state: np.ndarray) -> np.ndarray:
    """In (0, 1)."""
    x = (state >> _U(11)).astype(float)
    x += 0.5
    x *= 2.0**-53
    return x


def _uniform(seed: np.ndarray, *parts) -> np.ndarray:
    """In (0, 1), a hash of its arguments."""
    for i, p in enumerate(parts):
        seed = _mixed(seed, i + 1, p)
    return _fraction(seed)


def _units(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Where pieces cannot cross: code points of all texts, units a text, and begins and sizes of the units.

    A unit is a line end, or a word with the marks in front of it, or marks without a word.
    """
    cps = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = np.array([len(t) for t in texts], np.int64)
    first = np.zeros(len(cps) + 1, bool)
    first[np.cumsum(sizes) - sizes] = True
    first = first[:-1]
    line, mark = cps == 0x0A, cps == ord(SPACE)
    first |= line
    first[1:] |= line[:-1] | mark[1:] & ~mark[:-1]
    begins = np.flatnonzero(first)
    per_text = np.diff(np.searchsorted(begins, np.r_[0, np.cumsum(sizes)]))
    return cps, per_text, begins, np.diff(np.r_[begins, len(cps)])


@cache
def _powers(bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd multiplier and of its inverse, up to 2 ** bits of them."""
    out = []
    for base in (0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)):
        p = np.ones(1, _U)
        for k in range(bits):
            p = np.concatenate([p, p * _U(pow(base, 1 << k, 1 << 64))])
        out.append(p)
    return out[0], out[1]


@np.errstate(over="ignore")
def _distinct(cps: np.ndarray, begins: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each unit the number of its content, and for each content the first unit that has it. By 64-bit hashes; the round trip would show a collision."""
    up, down = _powers(max(16, len(cps).bit_length()))
    values = cps.astype(_U)
    values += _U(1)
    values *= _U(0xD6E8FEB86659FD93)
    values ^= values >> _U(32)
    values *= up[: len(cps)]
    sums = np.cumsum(values)
    h = sums[begins + sizes - 1]
    h[1:] -= sums[begins[1:] - 1]
    h = _mixed(h * down[begins], 1, sizes)
    codes, found = pd.factorize(h)
    firsts = np.empty(len(found), np.int64)
    firsts[codes[::-1]] = np.arange(len(codes))[::-1]
    return codes, firsts


class Lattice:
    """Lattices of some distinct words side by side; nodes stand by their distance from their word's end."""

    def __init__(self, v: Vocabulary, cps: np.ndarray, sizes: np.ndarray, theta: float) -> None:
        """cps: the words' code points one after another; sizes: how many each has."""
        n = len(cps)
        stop = np.repeat(np.cumsum(sizes), sizes)
        left = stop - np.arange(n)  # code points up to the word's end
        order = np.argsort(left.astype(np.uint16) if n and left.max() < 1 << 16 else left, kind="stable")
        rank = np.empty(n, np.int64)
        rank[order] = np.arange(n)
        found: list[tuple[np.ndarray, int, np.ndarray]] = []
        at, node = np.arange(n), np.zeros(n, np.int32)
        single = np.zeros(n, bool)
        k = 0
        while len(at):
            node = v.step(node, cps[at + k])
            alive = node >= 0
            at, node = at[alive], node[alive]
            k += 1
            ids = v.ends[node]
            good = ids >= 0
            found.append((at[good], k, ids[good]))
            if k == 1:
                single[at[good]] = True
            more = left[at] > k
            at, node = at[more], node[more]
        bare = np.flatnonzero(~single)
        degree = np.zeros(n, np.int64)
        for a, _, _ in found:
            degree[a] += 1
        degree[bare] += 1
        self.first = np.r_[0, np.cumsum(degree[order])]
        m = int(self.first[-1])
        self.piece, self.end = np.empty(m, np.int64), np.empty(m, np.int64)
        self.w, self.count = np.empty(m), np.ones(m, np.int64)
        fill = self.first[rank].copy()
        # A node's longest pieces come first: they are the likeliest.
        for a, k, ids in reversed(found):
            e = fill[a]
            self.piece[e], self.w[e] = ids, theta * v.log_p[ids]
            self.end[e] = np.where(left[a] > k, rank[np.minimum(a + k, n - 1)], -1)
            fill[a] += 1
        utf8 = [chr(c).encode("utf-8", "surrogatepass") for c in cps[bare]]
        n_bytes = np.array([len(b) for b in utf8], np.int64)
        self.fallback = v.byte_id[np.frombuffer(b"".join(utf8), np.uint8)]
        e = fill[bare]
        # A code point without a piece: minus one, minus where its bytes begin.
        self.piece[e] = -1 - (np.cumsum(n_bytes) - n_bytes)
        self.count[e], self.w[e] = n_bytes, theta * v.log_byte * n_bytes
        self.end[e] = np.where(left[bare] > 1, rank[np.minimum(bare + 1, n - 1)], -1)
        owner = np.repeat(np.arange(n), np.diff(self.first))
        beta = np.zeros(n + 1)  # the last is the end of every word
        cuts = np.searchsorted(left[order], np.arange(1, (int(left.max()) if n else 0) + 2))
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            lo, hi = self.first[a], self.first[b]
            if lo == hi:
                continue
            x = self.w[lo:hi] + beta[self.end[lo:hi]]
            offs = self.first[a:b] - lo
            top = np.maximum.reduceat(x, offs)
            beta[a:b] = top + np.log(np.add.reduceat(np.exp(x - top[owner[lo:hi] - a]), offs))
        self.log_p = np.minimum(self.w + beta[self.end] - beta[owner], 0.0)
        self.p = np.exp(self.log_p)
        self.grains = np.rint(self.log_p / _GRAIN).astype(np.int64)
        self.degree = degree[order]
        # What a node's other edges hold; -inf where there are none.
        self.log_rest = np.log1p(-np.minimum(self.p, 1 - 1e-16))
        self.log_rest[(self.p >= 1 - 1e-15) | (self.degree[owner] == 1)] = -np.inf
        # Sums within a node only: what else is in the chunk must not touch their last bits.
        self.upto = self.p.copy()
        wide = np.flatnonzero(self.degree > 1)
        k = 1
        while len(wide):
            e = self.first[wide] + k
            self.upto[e] += self.upto[e - 1]
            k += 1
            wide = wide[self.degree[wide] > k]
        self.upto[self.first[1:] - 1] = 2.0  # the last edge takes what rounding leaves
        self.owner = owner
        self.start = rank[np.cumsum(sizes) - sizes] if n else np.zeros(0, np.int64)

    def sample(self, node: np.ndarray, seed: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Forward samples from nodes to their words' ends: all edges, and how many each start has. seed: the hash of row key and turn."""
        steps: list[tuple[np.ndarray, np.ndarray]] = []
        at = np.flatnonzero(node >= 0)
        count = np.zeros(len(node), np.int64)
        node = node[at]
        state = _mixed(seed, 2, word)
        while len(at):
            u = _fraction(_mixed(state[at], 3, len(steps)))
            e = self.first[node]
            todo = np.flatnonzero(self.upto[e] <= u)
            while len(todo):
                e[todo] += 1
                todo = todo[self.upto[e[todo]] <= u[todo]]
            steps.append((at, e))
            count[at] += 1
            node = self.end[e]
            on = node >= 0
            at, node = at[on], node[on]
        offset = np.cumsum(count) - count
        out = np.empty(int(count.sum()), np.int64)
        for i, (a, e) in enumerate(steps):
            out[offset[a] + i] = e
        return out, count


def _segment_max(values: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Greatest value and its place within each segment; -inf and -1 where there is none."""
    best, at = np.full(len(sizes), -np.inf), np.full(len(sizes), -1)
    some = np.flatnonzero(sizes)
    if len(some):
        offs = (np.cumsum(sizes) - sizes)[some]
        best[some] = np.maximum.reduceat(values, offs)
        is_best = values == np.repeat(best, sizes)
        at[some] = np.minimum.reduceat(np.where(is_best, np.arange(len(values)), len(values)), offs) - offs
    return best, at


def _ragged(begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places begins[i] .. begins[i] + sizes[i] - 1, for each i in turn."""
    return np.arange(int(sizes.sum())) + np.repeat(begins - (np.cumsum(sizes) - sizes), sizes)


class _Path:
    """A popped segmentation of each text of a chunk: edges, its value, and the values of the parts that it leaves."""

    def __init__(self, lat: Lattice, edges: np.ndarray, sizes: np.ndarray, word: np.ndarray, g: np.ndarray, branch: np.ndarray, gone: list, seed: np.ndarray) -> None:
        """seed: the hash of row key and turn."""
        self.edges, self.sizes, self.word, self.g, self.branch, self.gone = edges, sizes, word, g, branch, gone
        self.offset = np.cumsum(sizes) - sizes
        row = np.repeat(np.arange(len(sizes)), sizes)
        # Whole numbers may run over: differences within a text are right, and do not depend on its neighbours.
        grains = lat.grains[edges]
        upto = np.r_[0, np.cumsum(grains)]
        base = upto[self.offset]
        self.log_p = (upto[self.offset + sizes] - base) * _GRAIN
        place = np.arange(len(edges)) - self.offset[row]
        left = np.flatnonzero(branch >= 0)
        at = self.offset[left] + branch[left]
        out = lat.p[edges[at]] + np.array([sum(lat.p[list(gone[d])]) for d in left.tolist()])
        # Where there is something to leave: a node of one edge has nothing else. Parts before the branch belong to other paths.
        rest = lat.log_rest[edges]
        rest[at] = np.log1p(-np.minimum(out, 1 - 1e-16))
        rest[at[(out >= 1 - 1e-15) | (lat.degree[lat.owner[edges[at]]] == 1)]] = -np.inf
        rest[place < np.maximum(branch, 0)[row]] = -np.inf
        open_ = np.flatnonzero(rest > -np.inf)
        r = row[open_]
        e = _fraction(_mixed(_mixed(seed[r], 2, 1_000_003 + place[open_]), 3, -1))
        # log of the mass of a part, less log of an exponential: its Gumbel before it is cut off at g, which keeps the order.
        np.log(e, out=e)
        np.negative(e, out=e)
        np.log(e, out=e)
        self.race = np.full(len(edges), -np.inf)
        self.race[open_] = (upto[open_] - base[r]) * _GRAIN + rest[open_] - e

    def top(self) -> tuple[np.ndarray, np.ndarray]:
        """The value and the place of each text's greatest part; -inf and -1 where nothing is left."""
        best, at = _segment_max(self.race, self.sizes)
        return np.where(best > -np.inf, -np.logaddexp(-self.g, -best), -np.inf), at


def _leave(lat: Lattice, path: _Path, d: np.ndarray, t: np.ndarray, seeds: np.ndarray, turn: int) -> tuple[np.ndarray, list[tuple[int, ...]]]:
    """For texts d that leave a path at its edge t: another edge of that node, by its share of what is not gone; and what is gone then."""
    edge = path.edges[path.offset[d] + t]
    own = lat.owner[edge]
    first, degree = lat.first[own], lat.degree[own]
    gone = [(e, *(path.gone[i] if b else ())) for e, i, b in zip(edge.tolist(), d.tolist(), (t == path.branch[d]).tolist(), strict=True)]
    n_gone = np.array([len(x) for x in gone], np.int64)
    flat = np.array([e for x in gone for e in x], np.int64)
    which = np.repeat(np.arange(len(d)), n_gone)
    # One column a place within the node, so that a text's sums do not depend on its neighbours.
    share = np.zeros((len(d), int(degree.max(initial=0))))
    for k in range(share.shape[1]):
        some = degree > k
        share[some, k] = lat.p[first[some] + k]
    share[which, flat - first[which]] = 0.0
    upto = np.cumsum(share, axis=1)
    u = _uniform(seeds[d], turn, t, -2) * upto[:, -1]
    chosen = (upto <= u[:, None]).sum(axis=1)
    # What rounding leaves goes to the last edge that has a share.
    last = share.shape[1] - 1 - np.argmax(share[:, ::-1] > 0, axis=1)
    return first + np.minimum(chosen, last), gone


def sample_segmentations(v: Vocabulary, texts: list[str], seeds: np.ndarray, k: int, theta: float) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each sample from 1: (number, texts that have it, their ids one after another, how many each has, log p, inclusion score). texts are normalised."""
    cps, n_words, begins, unit_sizes = _units(texts)
    codes, firsts = _distinct(cps, begins, unit_sizes)
    lat = Lattice(v, cps[_ragged(begins[firsts], unit_sizes[firsts])].astype(np.int64), unit_sizes[firsts], theta)
    n = len(texts)
    text_of = np.repeat(np.arange(n), n_words)
    first_word = np.cumsum(n_words) - n_words
    word = np.arange(len(codes)) - first_word[text_of]
    state = _mixed(seeds, 1, 0)
    edges, count = lat.sample(lat.start[codes], state[text_of], word)
    sizes = np.bincount(text_of, count, minlength=n).astype(np.int64)
    g = -np.log(-np.log(_uniform(seeds, 0, -1)))
    paths = [_Path(lat, edges, sizes, np.repeat(word, count), g, np.full(n, -1), [()] * n, state)]
    for turn in range(1, k + 1):
        tops = [p.top() for p in paths]
        which = np.argmax(np.stack([t[0] for t in tops]), axis=0)
        value = np.stack([t[0] for t in tops])[which, np.arange(n)]
        if turn == k or not (value > -np.inf).any():
            break
        branch, gone = np.full(n, -1), [()] * n
        chosen, at_word = np.zeros(n, np.int64), np.zeros(n, np.int64)
        for s, p in enumerate(paths):
            d = np.flatnonzero((which == s) & (value > -np.inf))
            if not len(d):
                continue
            t = tops[s][1][d]
            p.race[p.offset[d] + t] = -np.inf
            chosen[d], found = _leave(lat, p, d, t, seeds, turn)
            for i, x in zip(d.tolist(), found, strict=True):
                gone[i] = x
            branch[d], at_word[d] = t, p.word[p.offset[d] + t]
        on = np.flatnonzero(branch >= 0)
        # What follows the branch: the rest of its word, and the words after it.
        n_rest = n_words[on] - at_word[on]
        heads = np.cumsum(n_rest) - n_rest
        places = _ragged(first_word[on] + at_word[on], n_rest)
        node = lat.start[codes[places]]
        node[heads] = lat.end[chosen[on]]
        row_, nth_ = np.repeat(on, n_rest), word[places]
        state = _mixed(seeds, 1, turn)
        more, count = lat.sample(node, state[row_], nth_)
        added = np.bincount(row_, count, minlength=n).astype(np.int64)
        kept = np.maximum(branch, 0)
        sizes = np.where(branch >= 0, branch + 1 + added, 0)
        offset = np.cumsum(sizes) - sizes
        edges, words = np.empty(int(sizes.sum()), np.int64), np.empty(int(sizes.sum()), np.int64)
        for s, p in enumerate(paths):
            d = on[which[on] == s]
            to, source = _ragged(offset[d], kept[d]), _ragged(p.offset[d], kept[d])
            edges[to], words[to] = p.edges[source], p.word[source]
        edges[offset[on] + branch[on]], words[offset[on] + branch[on]] = chosen[on], at_word[on]
        to = _ragged(offset[on] + branch[on] + 1, added[on])
        edges[to], words[to] = more, np.repeat(nth_, count)
        paths.append(_Path(lat, edges, sizes, words, value, branch, gone, state))
    for s, p in enumerate(paths, 1):
        ids = lat.piece[p.edges]
        bare = np.flatnonzero(ids < 0)
        n_ids = p.sizes
        if len(bare):
            per = lat.count[p.edges]
            within = _ragged(np.zeros(len(bare), np.int64), per[bare])
            n_ids = np.bincount(np.repeat(np.arange(n), p.sizes), per, minlength=n).astype(np.int64)
            starts = (np.cumsum(per) - per)[bare]
            from_ = np.repeat(-1 - ids[bare], per[bare])
            ids = np.repeat(ids, per)
            ids[_ragged(starts, per[bare])] = lat.fallback[from_ + within]
        has = np.arange(n) if s == 1 else np.flatnonzero(p.branch >= 0)
        with np.errstate(over="ignore"):
            inclusion = -np.expm1(-np.exp(p.log_p - value))
        yield s, has, ids.astype(np.int32), n_ids[has], p.log_p[has], inclusion[has]


def _seed(key) -> int:
    return xxhash.xxh64_intdigest(b"null" if key is None else str(key).encode())


def _encode(model, k: int, theta: float, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from sluice.llm.pieces import vocabulary_of

        v = vocabulary_of(model.value)

        def flush(keys: list, texts: list[str]) -> pa.RecordBatch:
            seeds = np.array([_seed(x) for x in keys], np.uint64)
            raw = [t.encode("utf-8", "surrogatepass") for t in texts]
            cols: list[list] = [[] for _ in range(7)]
            flat: list[np.ndarray] = []
            for s, has, ids, n_ids, log_p, inclusion in sample_segmentations(v, texts, seeds, k, theta):
                own = has.tolist()
                ends = np.cumsum(n_ids).tolist()
                blob = memoryview(ids.tobytes())
                digests = [hashlib.sha256(blob[4 * (e - m) : 4 * e]).hexdigest() for e, m in zip(ends, n_ids.tolist(), strict=True)]
                same = v.spells(ids, n_ids, [raw[d] for d in own])
                for d in np.flatnonzero(~same).tolist():  # marks and spaces are one to the decoder
                    same[d] = v.decode(ids[ends[d] - n_ids[d] : ends[d]].tolist()) == texts[own[d]].replace(SPACE, " ")[1:]
                for c, x in zip(cols, ([keys[d] for d in own], [s] * len(own), n_ids.tolist(), log_p.tolist(), inclusion.tolist(), digests, same.tolist()), strict=True):
                    c.extend(x)
                if with_ids:
                    flat.append(ids)
            arrays = [pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.string(), pa.bool_()), strict=True)]
            names = ["key", "sample", "n_pieces", "log_prob", "inclusion", "ids_sha256", "round_trip"]
            if with_ids:
                offsets = np.r_[0, np.cumsum(np.array(cols[2], np.int64))].astype(np.int32)
                arrays.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(flat) if flat else np.zeros(0, np.int32))))
                names.append("ids")
            return pa.RecordBatch.from_arrays(arrays, names)

        for batch in batches:
            keys, texts, size = [], [], 0
            ids, column = batch.column("key"), batch.column("text")
            for i in range(batch.num_rows):
                keys.append(ids[i].as_py())
                texts.append(v.normalize(column[i].as_py() or ""))
                size += len(texts[-1])
                if size >= CHUNK:
                    yield flush(keys, texts)
                    keys, texts, size = [], [], 0
            if keys:
                yield flush(keys, texts)

    return run


def sampled_encodings(docs: DataFrame, id_col: str = "doc_id", text: str = "text", k: int = SAMPLES, theta: float = THETA, path: str = MODEL, with_ids: bool = True) -> DataFrame:
    """(id, sample, n_pieces, log_prob, inclusion, ids_sha256, round_trip[, ids]): up to k rows a row. round_trip: decoding gives the normalised text."""
    schema = "key bigint, sample bigint, n_pieces bigint, log_prob double, inclusion double, ids_sha256 string, round_trip boolean" + ", ids array<int>" * with_ids
    rows = docs.select(F.col(id_col).cast("bigint").alias("key"), F.col(text).alias("text"))
    model = docs.sparkSession.sparkContext.broadcast(model_bytes(path))
    return rows.mapInArrow(_encode(model, k, theta, with_ids), schema).withColumnRenamed("key", id_col)


def decoded(df: DataFrame, ids: str = "ids", out: str = "decoded", path: str = MODEL) -> DataFrame:
    """Adds ``out``: the text of an array of piece ids; null for null."""

    model = df.sparkSession.sparkContext.broadcast(model_bytes(path))

    @F.pandas_udf("string")
    def run(column: pd.Series) -> pd.Series:
        from sluice.llm.pieces import vocabulary_of

        v = vocabulary_of(model.value)
        return column.map(lambda x: None if x is None else v.decode(list(x)))

    return df.withColumn(out, run(F.col(ids)))


def best_encoding(df: DataFrame, text: str = "text", out: str = "ids", path: str = MODEL) -> DataFrame:
    """Adds ``out``: the vocabulary's own encoding; null and empty texts give an empty array."""

    model = df.sparkSession.sparkContext.broadcast(model_bytes(path))

    @F.pandas_udf("array<int>")
    def run(column: pd.Series) -> pd.Series:
        from sluice.llm.pieces import vocabulary_of

        return pd.Series(vocabulary_of(model.value).sp.encode(column.fillna("").tolist(), num_threads=1), index=column.index)

    return df.withColumn(out, run(F.col(text)))


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampled_encodings(table(spark, sf_dir, "documents").select("doc_id", "text"))

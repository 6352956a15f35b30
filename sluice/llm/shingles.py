"""Word hashes and word-shingle sets in numpy, for the Python operators.

A word's hash is a polynomial in an odd multiplier over a table of random 64-bit
values, one a byte with A-Z equal to a-z; differences of running sums give all
words of a stretch of text at once, without a Python object a word.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
#: Odd multipliers for the places of a window.
_PLACES = tuple(_U(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F))
_VALUES = np.array([xxhash.xxh64_intdigest(bytes([b]).lower()) for b in range(256)], np.uint64)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes of text that are hashed at a time; one text may be longer.
STRETCH = 1_000_000


@cache
def _powers(bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the multiplier and of its inverse, up to 2 ** bits of them."""
    out = []
    for base in (_BASE, _INVERSE):
        p = np.ones(1, np.uint64)
        for k in range(bits):
            p = np.concatenate([p, p * _U(pow(base, 1 << k, 1 << 64))])
        out.append(p)
    return out[0], out[1]


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(32))) * _U(0xD6E8FEB86659FD93)
    h = (h ^ (h >> _U(29))) * _U(0xBF58476D1CE4E5B9)
    return h ^ (h >> _U(32))


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all words of some texts, and how many each text has."""
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    b = np.frombuffer(b"\n".join([b"", *raw, b""]), np.uint8)
    space = _SPACE[b]
    starts = np.flatnonzero(space[:-1] & ~space[1:]) + 1
    ends = np.flatnonzero(~space[:-1] & space[1:]) + 1
    up, down = _powers(max(16, int(len(b)).bit_length()))
    sums = np.cumsum(_VALUES[b] * up[: len(b)])
    h = (sums[ends - 1] - sums[starts - 1]) * down[starts]
    h = mixed(h + (ends - starts).astype(np.uint64) * _U(0xA0761D6478BD642F))
    begins = np.r_[1, 1 + np.cumsum([len(r) + 1 for r in raw])]
    return h, np.diff(np.searchsorted(starts, begins))


def shingle_sets(texts: list[str | None], size: int = 5) -> list[np.ndarray]:
    """Each text's sorted distinct shingles; fewer words than ``size`` make one shingle, none make none."""
    h, counts = word_hashes(texts)
    n = max(0, len(h) - size + 1)
    windows = np.zeros(n, np.uint64)
    for k in range(size):
        windows += mixed(h[k : k + n] + _U(k)) * _PLACES[k % 5]
    windows = mixed(windows)
    out, at = [], 0
    for c in counts.tolist():
        if c >= size:
            out.append(np.unique(windows[at : at + c - size + 1]))
        elif c:
            out.append(np.array([xxhash.xxh3_64_intdigest(b"%d " % c + h[at : at + c].tobytes())], np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
        at += c
    return out


def stretches(batch: pa.RecordBatch, column: str = "text") -> Iterator[tuple[pa.RecordBatch, list[str | None]]]:
    """A batch's rows by stretches of text."""
    sizes = pa.compute.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
    part = (np.cumsum(sizes) - sizes) // STRETCH
    cuts = np.r_[0, np.flatnonzero(part[1:] != part[:-1]) + 1, len(part)] if len(part) else np.zeros(0, int)
    for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        rows = batch.slice(i, j - i)
        yield rows, rows.column(column).to_pylist()


def set_key(tokens: np.ndarray) -> int:
    """A signed 64-bit name of a set."""
    return int(np.int64(np.uint64(xxhash.xxh3_64_intdigest(tokens.tobytes()))))

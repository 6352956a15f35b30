"""Compressed blocks: a header with the raw size and a checksum, then the body, stored as it is if compression does not pay.

Spark compresses its own shuffles and files; this is for payloads that travel
as binary columns. It runs in Arrow batches, without pandas, and answers each
in pieces: a worker holds Spark's batch, the one before it and one piece, however
many rows it gets.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
import xxhash
from pyspark.sql import Column
from pyspark.sql import functions as F

MARK = b"slc2"
#: mark, codec's place in CODECS, raw size, checksum of what is stored; the body follows to the block's end.
HEADER = struct.Struct(">4sBQQ")
CODECS = ("none", "lz4", "zstd")
_ARROW = {"lz4": "lz4_raw", "zstd": "zstd"}
#: What ``checked`` answers.
CHECKED = pa.struct([("block", pa.binary()), ("intact", pa.bool_())])
#: Bytes after which a piece of a batch's answer is sent.
PIECE = 1 << 20


def pack(data: bytes, codec: str = "lz4") -> bytes:
    if codec not in _ARROW:
        raise ValueError(f"unknown codec {codec!r}")
    body = pa.compress(data, codec=_ARROW[codec], asbytes=True) if data else data
    if len(body) >= len(data):
        codec, body = "none", data
    return HEADER.pack(MARK, CODECS.index(codec), len(data), xxhash.xxh3_64_intdigest(body)) + body


def unpack(block: bytes) -> bytes:
    """The raw bytes; an error for a block that is cut, altered or of another format."""
    if len(block) < HEADER.size or block[:4] != MARK or block[4] >= len(CODECS):
        raise ValueError("not a block")
    _, codec, size, checksum = HEADER.unpack_from(block)
    body = block[HEADER.size :]
    if xxhash.xxh3_64_intdigest(body) != checksum:
        raise ValueError("block fails its checksum")
    data = body if codec == 0 else pa.decompress(body, decompressed_size=size, codec=_ARROW[CODECS[codec]], asbytes=True)
    if len(data) != size:
        raise ValueError("block fails its size")
    return data


def block_sizes(block: Column) -> tuple[Column, Column]:
    """(raw, stored) bytes of a block, read from its header; what it saves is their difference."""
    raw = F.conv(F.hex(F.substring(block, 6, 8)), 16, 10).cast("bigint")
    return raw, (F.octet_length(block) - HEADER.size).cast("bigint")


def block_codec(block: Column) -> Column:
    """The name of the codec that a block was stored with: "none" where compression did not pay."""
    return F.get(F.array(*map(F.lit, CODECS)), F.conv(F.hex(F.substring(block, 5, 1)), 16, 10).cast("int"))


def pieces(values: pa.Array, f: Callable[[bytes], Any], kind: pa.DataType = pa.binary(), size: Callable[[Any], int] = len) -> Iterator[pa.Array]:
    """``f`` of each value in order, nulls as they are, in arrays of ``kind`` that end with the answer that reaches PIECE bytes."""
    out, total = [], 0
    for x in values:
        y = f(x.as_py()) if x.is_valid else None
        out.append(y)
        total += 0 if y is None else size(y)
        if total >= PIECE:
            yield pa.array(out, kind)
            out, total = [], 0
    if out:
        yield pa.array(out, kind)


def _mapped(column: Column, make: Callable[[], Callable[[bytes], bytes]]) -> Column:
    """``make()`` of each value; it is called once a task."""

    @F.arrow_udf("binary")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        f = make()
        for values in batches:
            yield from pieces(values, f)

    return run(column)


def compressed(column: Column, codec: str = "lz4") -> Column:
    return _mapped(column.cast("binary"), lambda: lambda x: pack(x, codec))


def decompressed(column: Column) -> Column:
    return _mapped(column, lambda: unpack)


def check(data: bytes, codec: str = "lz4") -> dict[str, Any]:
    block = pack(data, codec)
    return {"block": block, "intact": unpack(block) == data}


def checked(column: Column, codec: str = "lz4") -> Column:
    """(block, intact): ``compressed``, and whether ``decompressed`` gives the value back; null for null.

    Both are done in one Python worker a task. As two columns, with the block used by itself too, they take two.
    """

    @F.arrow_udf("block binary, intact boolean")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for values in batches:
            yield from pieces(values, lambda x: check(x, codec), CHECKED, lambda y: len(y["block"]))

    return run(column.cast("binary"))


def train_dictionary(samples: list[bytes], size: int = 16_384) -> bytes:
    """A zstd dictionary from sample payloads."""
    import zstandard

    return zstandard.train_dictionary(size, samples).as_bytes()


def pack_with_dictionary(data: bytes, dictionary: bytes, level: int = 3) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(dictionary)).compress(data)


def unpack_with_dictionary(data: bytes, dictionary: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary)).decompress(data)


def packed_with_dictionary(column: Column, dictionary: bytes, level: int = 3) -> Column:
    """``pack_with_dictionary`` of a column; the dictionary goes with the plan and has at most the size it was trained to."""

    def make() -> Callable[[bytes], bytes]:
        import zstandard

        return zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(dictionary)).compress

    return _mapped(column.cast("binary"), make)


def unpacked_with_dictionary(column: Column, dictionary: bytes) -> Column:
    def make() -> Callable[[bytes], bytes]:
        import zstandard

        return zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary)).decompress

    return _mapped(column, make)

"""Binary frames: a header of four integers (map, attempt, batch, length) before each body."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HEADER = struct.Struct("<iiii")
#: A batch of frames is sent once it has so many rows, or bodies of so many bytes.
BATCH_ROWS, BATCH_BYTES = 10_000, 1 << 20
_ROW = pa.schema([("path", pa.string()), ("map_id", pa.int32()), ("attempt_id", pa.int32()), ("batch_id", pa.int64()), ("body", pa.binary())])


def frame(map_id: int, attempt_id: int, batch_id: int, body: bytes) -> bytes:
    return HEADER.pack(map_id, attempt_id, batch_id, len(body)) + body


def _little(n: Column) -> Column:
    h = F.lpad(F.hex(n.cast("bigint")), 8, "0")
    return F.concat(*(F.substring(h, i, 2) for i in (7, 5, 3, 1)))


def framed(map_id: Column, attempt_id: Column, batch_id: Column, body: Column) -> Column:
    """``frame`` of columns: non-negative ids, and a body of bytes."""
    return F.unhex(F.concat(_little(map_id), _little(attempt_id), _little(batch_id), _little(F.octet_length(body)), F.hex(body)))


def frames_of(data: bytes) -> Iterator[tuple[int, int, int, bytes]]:
    """An error for a frame that is cut."""
    at = 0
    while at < len(data):
        if at + HEADER.size > len(data):
            raise ValueError("a frame's header is cut")
        m, a, b, n = HEADER.unpack_from(data, at)
        at += HEADER.size
        if n < 0 or at + n > len(data):
            raise ValueError("a frame's body is cut")
        yield m, a, b, data[at : at + n]
        at += n


def read_frames(files: DataFrame, content: str = "content") -> DataFrame:
    """files: as spark.read.format("binaryFile") gives them. (path, map_id, attempt_id, batch_id, body).

    Batches go across files, and a large file gives many: neither small files nor large ones cost more than their frames.
    """

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for part in parts:
            for path, data in zip(part.column("path"), part.column(content), strict=True):
                path = path.as_py()
                for f in frames_of(data.as_py()):
                    rows.append((path, *f))
                    size += len(f[3])
                    if len(rows) >= BATCH_ROWS or size >= BATCH_BYTES:
                        yield _batch(rows)
                        rows, size = [], 0
        if rows:
            yield _batch(rows)

    return files.select("path", content).mapInArrow(run, "path string, map_id int, attempt_id int, batch_id bigint, body binary")


def _batch(rows: list[tuple[str, int, int, int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _ROW.types, strict=True)], schema=_ROW)

"""Keys as strings, and the packed record pointer."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bits of a record pointer: partition, page, offset in the page.
PARTITION_BITS, PAGE_BITS, OFFSET_BITS = 24, 13, 27


def shuffle_key(app: Column, shuffle: Column) -> Column:
    return F.concat_ws("-", app, shuffle.cast("string"))


def app_of(key: Column) -> Column:
    """All before the last dash; application ids may hold dashes."""
    return F.regexp_extract(key, "^(.*)-[^-]*$", 1)


def shuffle_of(key: Column) -> Column:
    return F.substring_index(key, "-", -1).cast("int")


def of_app(key: Column, app: str) -> Column:
    """Whether a shuffle key belongs to an application; with the dash, so "app1" is not found in "app10-3"."""
    return key.startswith(f"{app}-")


def epoch_key(reducer: Column, epoch: Column) -> Column:
    return F.concat_ws("-", reducer.cast("string"), epoch.cast("string"))


def mapper_key(key: Column, map_id: Column, attempt: Column) -> Column:
    return F.concat_ws("-", key, map_id.cast("string"), attempt.cast("string"))


def group_key(key: Column, group: Column, epoch: Column) -> Column:
    return F.concat_ws("-", key, group.cast("string"), epoch.cast("string"))


def file_name(reducer: Column, epoch: Column, replica: Column) -> Column:
    return F.concat(epoch_key(reducer, epoch), F.lit("-r"), replica.cast("string"), F.lit("-data"))


def pack_pointer(partition: Column, page: Column, offset: Column) -> Column:
    wide = lambda c: c.cast("bigint")
    return F.shiftleft(wide(partition), PAGE_BITS + OFFSET_BITS).bitwiseOR(F.shiftleft(wide(page), OFFSET_BITS)).bitwiseOR(wide(offset))


def unpack_pointer(pointer: Column) -> tuple[Column, Column, Column]:
    """(partition, page, offset)."""
    mask = lambda bits: F.lit((1 << bits) - 1)
    return (
        F.shiftrightunsigned(pointer, PAGE_BITS + OFFSET_BITS).bitwiseAND(mask(PARTITION_BITS)),
        F.shiftrightunsigned(pointer, OFFSET_BITS).bitwiseAND(mask(PAGE_BITS)),
        pointer.bitwiseAND(mask(OFFSET_BITS)),
    )


def non_negative_hash(*columns: Column) -> Column:
    """A hash from 0 up; the one value without a positive counterpart becomes 0."""
    h = F.hash(*columns)
    return F.when(h == -(1 << 31), 0).otherwise(F.abs(F.greatest(h, F.lit(-(1 << 31) + 1))))


def leading_zeros(x: Column, bits: int = 32) -> Column:
    """Zero bits in front of a non-negative number; of 0, all of them."""
    return F.when(x == 0, bits).otherwise(bits - F.length(F.bin(x)))


def nth_of(values: Column, wanted: Column, others: Column) -> Column:
    """The element of ``others`` that stands where ``wanted`` stands in ``values``; null if it is not there."""
    at = F.array_position(values, wanted)
    return F.when(at > 0, F.get(others, (at - 1).cast("int")))

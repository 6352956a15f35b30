"""Sizes, times and addresses in columns of text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_SIZE_SHIFT = {"b": 0, "k": 10, "m": 20, "g": 30, "t": 40, "p": 50}
_TIME_MS = {"ms": 1, "s": 1000, "m": 60_000, "min": 60_000, "h": 3_600_000, "d": 86_400_000}


def size_bytes(text: Column) -> Column:
    """"4m" or "4mb" -> bytes; null for what is no size."""
    t = F.lower(F.trim(text))
    number = F.regexp_extract(t, r"^([0-9]+)\s*([bkmgtp]?)b?$", 1)
    unit = F.regexp_extract(t, r"^([0-9]+)\s*([bkmgtp]?)b?$", 2)
    shift = F.lit(0)
    for u, s in _SIZE_SHIFT.items():
        shift = F.when(unit == u, s).otherwise(shift)
    return F.when(number != "", number.try_cast("bigint") * F.pow(F.lit(2.0), shift).cast("bigint"))


def time_ms(text: Column) -> Column:
    """"120s" -> milliseconds; null for what is no time."""
    t = F.lower(F.trim(text))
    number, unit = (F.regexp_extract(t, r"^(-?[0-9]+)\s*(ms|s|min|m|h|d)?$", i) for i in (1, 2))
    factor = F.lit(1)
    for u, f in _TIME_MS.items():
        factor = F.when(unit == u, f).otherwise(factor)
    return F.when(number != "", number.try_cast("bigint") * factor)


def size_text(n: Column) -> Column:
    """Bytes -> "4.0 MiB", in the largest unit of which there are two."""
    out = F.format_string("%d B", n)
    for i, unit in enumerate(("KiB", "MiB", "GiB", "TiB", "PiB"), 1):
        out = F.when(n >= 2 << (10 * i), F.format_string(f"%.1f {unit}", n / float(1 << (10 * i)))).otherwise(out)
    return out


def address(url: Column, scheme: str = "sluice") -> tuple[Column, Column]:
    """(host, port) of scheme://host:port; null for anything else."""
    pattern = rf"^{scheme}://([^:/?#@]+):([0-9]{{1,5}})$"
    host, port = F.regexp_extract(url, pattern, 1), F.regexp_extract(url, pattern, 2)
    good = (host != "") & (port.try_cast("int") <= 65535)
    return F.when(good, host), F.when(good, port.try_cast("int"))

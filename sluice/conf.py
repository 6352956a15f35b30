"""Semantic settings of the dataflow, and the unit strings they are written in."""

from __future__ import annotations

import re
from dataclasses import dataclass, fields

_SIZE = {"": 1, "b": 1, "k": 1 << 10, "kb": 1 << 10, "m": 1 << 20, "mb": 1 << 20, "g": 1 << 30, "gb": 1 << 30, "t": 1 << 40, "tb": 1 << 40, "p": 1 << 50, "pb": 1 << 50}
_TIME_MS = {"": 1, "us": 0.001, "ms": 1, "s": 1000, "m": 60_000, "min": 60_000, "h": 3_600_000, "d": 86_400_000}


def size_bytes(text: str) -> int:
    """"4m" -> 4194304. A bare number is bytes."""
    m = re.fullmatch(r"\s*([0-9]+)\s*([a-z]*)\s*", text.lower())
    if not m or m[2] not in _SIZE:
        raise ValueError(f"not a size: {text!r}")
    return int(m[1]) * _SIZE[m[2]]


def time_ms(text: str) -> int:
    """"120s" -> 120000. A bare number is milliseconds."""
    m = re.fullmatch(r"\s*(-?[0-9]+)\s*([a-z]*)\s*", text.lower())
    if not m or m[2] not in _TIME_MS:
        raise ValueError(f"not a time: {text!r}")
    return int(int(m[1]) * _TIME_MS[m[2]])


@dataclass(frozen=True)
class Settings:
    """Defaults of what changes results; physical tuning is Spark's own configuration."""

    max_partitions_per_group: int = 100
    push_buffer: str = "4m"
    epoch_rotate: str = "1g"
    fetch_chunk: str = "8m"
    flush_buffer: str = "256k"
    spill_size: str = "256m"
    spill_records: int = 1_000_000
    blacklist: bool = True
    replicas: int = 2
    codec: str = "lz4"
    app_timeout: str = "120s"
    worker_timeout: str = "120s"
    remove_delay: str = "60s"
    stage_end_timeout: str = "600s"
    extra_ratio: float = 1.5
    max_workers: int = 1000

    @classmethod
    def of(cls, conf: dict[str, str], prefix: str = "sluice.") -> Settings:
        """From strings such as {"sluice.push_buffer": "8m"}; unknown keys under the prefix are errors."""
        kinds = {f.name: type(f.default) for f in fields(cls)}
        got = {}
        for key, value in conf.items():
            if not key.startswith(prefix):
                continue
            name = key.removeprefix(prefix)
            if name not in kinds:
                raise KeyError(key)
            got[name] = value.lower() == "true" if kinds[name] is bool else kinds[name](value)
        return cls(**got)

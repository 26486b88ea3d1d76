"""Configuration: defaults, and the bounds that make it usable."""

from __future__ import annotations

import dataclasses
import json
import unicodedata
from dataclasses import dataclass, field
from functools import cached_property
from pathlib import Path

from .errors import ConfigError
from .model import KEY_TYPES, RESERVED, KeyDef, SeriesSpec
from .timeutil import parse_rfc3339

#: Header sizes of the wire formats, and about a hundred years.
SEGMENT_HEADER, BATCH_HEADER = 14, 10
MAX_INTERVAL_MS = 100 * 365 * 24 * 60 * 60 * 1000
#: Names of codecs, with Spark's.
COMPRESSION = {"lz4_raw": "lz4_raw", "lz4": "lz4_raw", "uncompressed": "uncompressed", "none": "uncompressed"}


@dataclass
class Server:
    ingest_endpoint: str = "tcp://127.0.0.1:5555"
    control_endpoint: str = "tcp://127.0.0.1:5556"
    rcv_hwm: int = 100_000
    max_batch_bytes: int = 8 << 20


@dataclass
class Limits:
    max_record_bytes: int = 16_384
    reject_max_bytes: int = 64 << 20
    ts_min: str = "2000-01-01T00:00:00Z"
    ts_max_skew_ms: int = 86_400_000
    validate_json: bool = False

    @cached_property
    def ts_min_us(self) -> int:
        return parse_rfc3339(self.ts_min)


@dataclass
class Wal:
    fsync_interval_ms: int = 10
    fsync_bytes: int = 4 << 20
    segment_max_bytes: int = 64 << 20


@dataclass
class Flush:
    interval_ms: int = 3_600_000
    on_startup: bool = True
    compression: str = "lz4_raw"
    row_group_rows: int = 131_072
    merge_fan_in: int = 64
    memory_budget_bytes: int = 256 << 20


@dataclass
class Config:
    data_dir: str = "./data"
    server: Server = field(default_factory=Server)
    limits: Limits = field(default_factory=Limits)
    wal: Wal = field(default_factory=Wal)
    flush: Flush = field(default_factory=Flush)
    series: list[SeriesSpec] = field(default_factory=list)

    @classmethod
    def load(cls, path: str) -> Config:
        try:
            text = Path(path).read_text()
        except OSError as e:
            raise ConfigError(f"cannot read {path}: {e}") from e
        return cls.parse(text)

    @classmethod
    def parse(cls, text: str) -> Config:
        try:
            raw = json.loads(text)
        except ValueError as e:
            raise ConfigError(f"not JSON: {e}") from e
        sections = {"server": Server, "limits": Limits, "wal": Wal, "flush": Flush}
        config = _fill(cls, {k: v for k, v in _dict(raw, "config").items() if k not in (*sections, "series")}, "config", skip=(*sections, "series"))
        for name, kind in sections.items():
            if name in raw:
                setattr(config, name, _fill(kind, _dict(raw[name], name), name))
        config.series = [_series(s) for s in _list(raw.get("series", []), "series")]
        config.validate()
        return config

    def validate(self) -> None:
        _ = self.limits.ts_min_us
        record, f, w = self.limits.max_record_bytes, self.flush, self.wal
        rules = [
            (record > 0, "limits.max_record_bytes must be above 0"),
            (f.merge_fan_in >= 2, "flush.merge_fan_in must be 2 or more"),
            (f.memory_budget_bytes > 0, "flush.memory_budget_bytes must be above 0"),
            (f.row_group_rows > 0, "flush.row_group_rows must be above 0"),
            (0 <= f.interval_ms <= MAX_INTERVAL_MS, f"flush.interval_ms must be at most {MAX_INTERVAL_MS}; 0 turns the timer off"),
            (w.fsync_interval_ms > 0, "wal.fsync_interval_ms must be above 0"),
            (w.fsync_bytes > 0, "wal.fsync_bytes must be above 0"),
            (w.segment_max_bytes >= record + SEGMENT_HEADER, "wal.segment_max_bytes must hold the largest record"),
            (self.server.max_batch_bytes > 0, "server.max_batch_bytes must be above 0"),
            (self.server.max_batch_bytes >= record + BATCH_HEADER, "server.max_batch_bytes must hold the largest record"),
            (f.compression in COMPRESSION, f"flush.compression must be one of {', '.join(COMPRESSION)}"),
            (self.limits.ts_max_skew_ms >= 0, "limits.ts_max_skew_ms must not be negative"),
            (self.limits.reject_max_bytes >= 0, "limits.reject_max_bytes must not be negative"),
        ]
        for holds, message in rules:
            if not holds:
                raise ConfigError(message)
        names = [s.name for s in self.series]
        for s in self.series:
            check_series_name(s.name)
            keys = [k.name for k in s.keys]
            if "" in keys:
                raise ConfigError(f"series {s.name!r} has a key without a name")
            if taken := [k for k in keys if k in RESERVED]:
                raise ConfigError(f"series {s.name!r}: {taken[0]!r} is the name of a fixed column; those are {', '.join(RESERVED)}")
            if len(set(keys)) < len(keys):
                raise ConfigError(f"series {s.name!r} declares a key twice")
        if len({n.lower() for n in names}) < len(names):
            raise ConfigError("two series have one name, case aside, and would share a directory")

    def find_series(self, name: str) -> SeriesSpec | None:
        return next((s for s in self.series if s.name == name), None)


def check_series_name(name: str) -> None:
    """Names are directories."""
    if not name or name in (".", "..") or "/" in name or "\\" in name or len(name.encode()) > 65_535 or any(unicodedata.category(c) == "Cc" for c in name):
        raise ConfigError(f"series name {name!r} cannot be a directory: it is empty, too long, a path, or has control characters")


def _dict(raw: object, what: str) -> dict:
    if not isinstance(raw, dict):
        raise ConfigError(f"{what} must be an object")
    return raw


def _list(raw: object, what: str) -> list:
    if not isinstance(raw, list):
        raise ConfigError(f"{what} must be a list")
    return raw


def _fill(kind: type, raw: dict, what: str, skip: tuple[str, ...] = ()):
    known = {f.name: f for f in dataclasses.fields(kind) if f.name not in skip}
    for name, value in raw.items():
        if name not in known:
            raise ConfigError(f"{what} has no field {name!r}")
        wanted = {"int": int, "str": str, "bool": bool}[str(known[name].type)]
        if type(value) is not wanted:
            raise ConfigError(f"{what}.{name} must be of type {known[name].type}")
    return kind(**raw)


def _series(raw: object) -> SeriesSpec:
    raw = _dict(raw, "series")
    if set(raw) - {"name", "keys"} or not isinstance(raw.get("name"), str):
        raise ConfigError(f"a series has a name and keys, not {sorted(raw)}")
    keys = []
    for k in _list(raw.get("keys", []), "keys"):
        k = _dict(k, "key")
        if set(k) - {"name", "type", "nullable"} or not isinstance(k.get("name"), str) or k.get("type") not in KEY_TYPES or not isinstance(k.get("nullable", False), bool):
            raise ConfigError(f"series {raw['name']!r}: a key has a name, a type of {', '.join(KEY_TYPES)}, and perhaps nullable, not {k}")
        keys.append(KeyDef(k["name"], k["type"], k.get("nullable", False)))
    return SeriesSpec(raw["name"], tuple(keys))

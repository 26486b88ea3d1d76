"""Errors that the engine raises."""

from __future__ import annotations


class LakeError(Exception):
    """Any error of this package."""


class UnknownSeries(LakeError):
    def __init__(self, name: str):
        super().__init__(f"series {name!r} is not declared")


class KeyArity(LakeError):
    def __init__(self, series: str, expected: int, got: int):
        super().__init__(f"series {series!r} declares {expected} keys, the record has {got}")


class TypeMismatch(LakeError):
    def __init__(self, series: str, key: str, expected: str, got: str | None):
        super().__init__(f"series {series!r}, key {key!r}: expected {expected}, got {got or 'null'}")


class TsOutOfRange(LakeError):
    def __init__(self, ts: int, low: int, high: int):
        super().__init__(f"timestamp {ts} is outside {low} to {high}; the unit is microseconds")


class RecordTooLarge(LakeError):
    def __init__(self, size: int, limit: int):
        super().__init__(f"record of {size} bytes is over the limit of {limit}")


class FieldTooLong(LakeError):
    def __init__(self, series: str, limit: int):
        super().__init__(f"series {series!r}: a text or the number of pairs is over {limit}")


class BatchTooLarge(LakeError):
    def __init__(self, size: int, limit: int):
        super().__init__(f"batch of {size} bytes is over the limit of {limit}")


class ConfigError(LakeError):
    pass


class Locked(LakeError):
    pass


class ManifestError(LakeError):
    pass

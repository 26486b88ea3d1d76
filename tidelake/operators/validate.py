"""Validation of records as columns: a reason to reject, or null."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.records import encoded_size
from ..model import TAGS, KeyDef

#: The last microsecond of year 9999: later ones have no text that sorts.
LAST_US = 253_402_300_799_999_999
#: Bytes of a series name, an id, or a name or value of ``extra``, and pairs of ``extra``, at most.
FIELD_LIMIT = 65_535


@dataclass(frozen=True)
class WINDOW:
    """Timestamps that are taken, both ends included; ``high`` is None while the clock is not set."""

    low: int
    high: int | None

    @classmethod
    def at(cls, now_us: int, ts_min_us: int, skew_ms: int) -> WINDOW:
        return cls(ts_min_us, None if now_us < ts_min_us else min(now_us + skew_ms * 1000, LAST_US))


def accept_window(ts_us: Column, window: WINDOW) -> Column:
    return ts_us.between(window.low, LAST_US if window.high is None else window.high)


def unit_of(ts_us: Column, window: WINDOW) -> Column:
    """The unit in which a rejected time would be in the window, if any."""
    high = LAST_US if window.high is None else window.high
    inside = lambda c: c.between(window.low, high)
    return (
        F.when(inside(ts_us), "us")
        .when(inside(F.when(ts_us <= LAST_US // 1000, ts_us * 1000)), "ms")
        .when(inside(F.when(ts_us <= LAST_US // 1_000_000, ts_us * 1_000_000)), "s")
        .when(inside(F.floor(ts_us / 1000).cast("long")), "ns")
        .otherwise("none")
    )


def _fits(value: Column, key: KeyDef, strict: bool) -> Column:
    """``strict`` holds nulls against keys that are not nullable."""
    null = F.lit(key.nullable or not strict)
    return F.when(value["tag"] == TAGS["null"], null).otherwise(value["tag"] == TAGS[key.type])


def key_fits(at: int, key: KeyDef, strict: bool = True) -> Column:
    """Whether the key at that place has the type it should have."""
    return _fits(F.get("keys", F.lit(at)), key, strict)


def reject_reason(schemas: dict[tuple[str, int], tuple[KeyDef, ...]], window: WINDOW | None = None, max_bytes: int | None = None, strict: bool = True) -> Column:
    """Why a record cannot be taken, or null; needs the columns of model.RECORD.

    ``schemas`` has the keys of each known series and epoch. The order of the
    checks is fixed: schema, time, number of keys, their types, field lengths,
    size of the record. Without ``window`` or ``max_bytes`` those checks are off,
    as they are when landed records are flushed.
    """
    known, arity, fits = F.lit(False), F.lit(False), F.lit(False)
    for (series, epoch), keys in schemas.items():
        mine = (F.col("series") == series) & (F.col("epoch") == epoch)
        right = F.size("keys") == len(keys)
        typed = F.lit(True)
        for i, key in enumerate(keys):
            typed = typed & F.coalesce(_fits(F.get("keys", F.lit(i)), key, strict), F.lit(False))
        known, arity, fits = known | mine, arity | (mine & right), fits | (mine & right & typed)
    length = F.greatest(F.octet_length("series"), F.octet_length("id"))
    long = (length > FIELD_LIMIT) | (F.size("extra") > FIELD_LIMIT) | F.exists("extra", lambda e: (F.octet_length(e["k"]) > FIELD_LIMIT) | (F.octet_length(e["v"]) > FIELD_LIMIT))
    reason = F.when(~F.coalesce(known, F.lit(False)), "schema")
    if window:
        reason = reason.when(~F.coalesce(accept_window(F.col("ts_us"), window), F.lit(False)), "ts")
    else:
        reason = reason.when(F.col("ts_us").isNull() | ~F.col("ts_us").between(0, LAST_US), "ts")
    reason = reason.when(~F.coalesce(arity, F.lit(False)), "arity").when(~F.coalesce(fits, F.lit(False)), "type").when(F.coalesce(long, F.lit(False)), "field")
    if max_bytes is not None:
        reason = reason.when(encoded_size() > max_bytes, "size")
    return reason


def split(records: DataFrame, reason: Column) -> tuple[DataFrame, DataFrame]:
    """Accepted records, and rejected ones with their ``reason``."""
    judged = records.withColumn("reason", reason)
    return judged.filter("reason is null").drop("reason"), judged.filter("reason is not null")

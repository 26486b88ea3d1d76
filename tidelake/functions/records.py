"""Columns over records. The session's time zone must be UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..model import KEY_TYPES, TAGS, VALUE


def micros(ts: str | Column) -> Column:
    """Microseconds since 1970 of a timestamp."""
    column = F.col(ts) if isinstance(ts, str) else ts
    return F.unix_micros(column.cast("timestamp"))


def to_timestamp(us: str | Column) -> Column:
    return F.timestamp_micros(us)


def hour(us: str | Column) -> Column:
    """``YYYY-MM-DDTHH``; texts order as times do."""
    return F.date_format(F.timestamp_micros(us), "yyyy-MM-dd'T'HH")


def rfc3339(us: str | Column) -> Column:
    return F.date_format(F.timestamp_micros(us), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def canonical_extra(pairs: str | Column) -> Column:
    """A map from pairs ``k, v``: sorted, and of pairs with one name the one with the smallest value."""
    ordered = F.array_sort(F.coalesce(F.col(pairs) if isinstance(pairs, str) else pairs, F.array().cast("array<struct<k:string,v:string>>")))
    first = F.filter(ordered, lambda x, i: (i == 0) | (x["k"] != F.get(ordered, i - 1)["k"]))
    return F.map_from_entries(first)


def value_of(column: str | Column, type_: str) -> Column:
    """A tagged value from a column of a key's type; null is the null value."""
    c = F.col(column) if isinstance(column, str) else column
    fields = {"bool": "b", "i64": "i", "f64": "f", "string": "s"}
    parts = [F.when(c.isNull(), TAGS["null"]).otherwise(TAGS[type_]).cast("int").alias("tag")]
    parts += [(c if t == type_ else F.lit(None)).cast(KEY_TYPES[t]).alias(f) for t, f in fields.items()]
    return F.struct(*parts).cast(VALUE)


def key_value(value: Column, type_: str) -> Column:
    """The typed content of a tagged value that is of that type or null."""
    return value[{"bool": "b", "i64": "i", "f64": "f", "string": "s"}[type_]]


def text_of(column: str | Column, type_: str) -> Column:
    """A value of a key's type as text, as readers of the lake print it: a number without an idle fraction, a time in microseconds, null for null."""
    c = F.col(column) if isinstance(column, str) else column
    if type_ == "ts":
        return micros(c).cast("string")
    if type_ != "f64":
        return c.cast("string")
    shortest = c.cast("string")
    whole = (F.abs(c) < 1e15) & (F.floor(c) == c)
    plain = F.when((c == 0) & shortest.startswith("-"), "-0").when(whole, c.cast("long").cast("string"))
    trimmed = lambda digits: F.rtrim(F.rtrim(shortest.cast(digits).cast("string"), F.lit("0")), F.lit("."))
    large = F.when(F.abs(c) < 1e27, trimmed("decimal(38,10)")).when(F.abs(c) < 1e37, shortest.cast("decimal(38,0)").cast("string"))
    small = F.when(F.abs(c) > 1e-20, trimmed("decimal(38,37)"))
    named = F.when(F.isnan(c), "NaN").when(c == float("inf"), "inf").when(c == float("-inf"), "-inf")
    return F.coalesce(named, plain, F.when(~shortest.contains("E"), shortest), F.when(F.abs(c) >= 1, large), F.when(F.abs(c) < 1, small), shortest)


def encoded_size(nulls: bool = False) -> Column:
    """Bytes that a record takes on the wire; needs ``series, id, keys, extra, data``.

    Eight for the frame, then time, epoch, series, id, keys by their types,
    pairs of ``extra`` as given, and data. ``extra`` is counted once canonical.
    Null if one of them is null, or with ``nulls`` the size of the others.
    """
    known = (lambda c: F.coalesce(c, F.lit(0).cast("long"))) if nulls else (lambda c: c)
    length = lambda c: known(F.octet_length(c).cast("long"))
    each = F.transform("keys", lambda v: F.when(v["tag"] == 0, 1).when(v["tag"] == 1, 2).when(v["tag"].isin(2, 3), 9).otherwise(5 + length(v["s"])).cast("long"))
    keys = known(F.aggregate(each, F.lit(0).cast("long"), lambda a, x: a + x))
    pairs = F.transform(F.map_entries(canonical_extra("extra")), lambda e: 4 + length(e["key"]) + length(e["value"]))
    extra = known(F.aggregate(pairs, F.lit(0).cast("long"), lambda a, x: a + x))
    return F.lit(8 + 8 + 4 + 2 + 2 + 2 + 4).cast("long") + length("series") + length("id") + keys + extra + length("data")

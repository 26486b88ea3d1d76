"""Series, keys and the schemas they give."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T

#: Key types by their names in a config, with the column type of each.
KEY_TYPES: dict[str, T.DataType] = {"string": T.StringType(), "i64": T.LongType(), "f64": T.DoubleType(), "bool": T.BooleanType()}
#: Wire tags of values, and names that a key may not have.
TAGS = {"null": 0, "bool": 1, "i64": 2, "f64": 3, "string": 4}
RESERVED = ("ts", "id", "extra", "data")

#: A value of any key type; ``tag`` says which field counts.
VALUE = "struct<tag:int,b:boolean,i:bigint,f:double,s:string>"
#: Records as they arrive. ``seg`` and ``off`` are the order of arrival.
RECORD = f"series string, epoch int, ts_us bigint, id string, keys array<{VALUE}>, extra array<struct<k:string,v:string>>, data string"
#: ``size`` is what a record takes on the wire; segments that landed before there was one have nulls.
LANDED = f"{RECORD}, seg bigint, off bigint, size bigint"


@dataclass(frozen=True)
class KeyDef:
    name: str
    type: str
    nullable: bool = False

    def to_json(self) -> dict:
        return {"name": self.name, "type": self.type, "nullable": self.nullable}


@dataclass(frozen=True)
class SeriesSpec:
    name: str
    keys: tuple[KeyDef, ...] = ()


@dataclass(frozen=True)
class EpochSchema:
    """The keys of a series from some point on."""

    epoch: int
    keys: tuple[KeyDef, ...] = field(default=())

    @property
    def layout(self) -> tuple[tuple[str, str], ...]:
        return tuple((k.name, k.type) for k in self.keys)


def storage_schema(keys: tuple[KeyDef, ...] | list[KeyDef]) -> T.StructType:
    """Columns of a file: fixed ones are never null, keys always may be."""
    return T.StructType(
        [
            T.StructField("ts", T.TimestampType(), False),
            T.StructField("id", T.StringType(), False),
            *[T.StructField(k.name, KEY_TYPES[k.type], True) for k in keys],
            T.StructField("extra", T.MapType(T.StringType(), T.StringType(), True), False),
            T.StructField("data", T.StringType(), False),
        ]
    )


def union_keys(history: list[EpochSchema]) -> tuple[list[KeyDef], set[str]]:
    """Keys of all epochs as first seen, and the names of those that every epoch has."""
    seen = {k.name: k for epoch in reversed(history) for k in reversed(epoch.keys)}
    order = dict.fromkeys(k.name for epoch in history for k in epoch.keys)
    everywhere = set(order).intersection(*[{k.name for k in e.keys} for e in history]) if history else set()
    return [seen[name] for name in order], everywhere

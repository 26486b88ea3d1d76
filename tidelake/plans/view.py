"""Views that join the epochs of a series: one scan with every key, promoted and demoted keys coalesced."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..model import KEY_TYPES, EpochSchema, storage_schema, union_keys
from ..timeutil import hour_partition

#: What a text must not look like to be a double: a suffix that only one engine takes.
_NOT_A_NUMBER = r"(?i)^\s*[-+]?[0-9.][0-9.e+-]*[fd]\s*$"
_SQL_TYPES = {"string": "VARCHAR", "i64": "BIGINT", "f64": "DOUBLE", "bool": "BOOLEAN"}


def from_text(text: Column, type_: str) -> Column:
    """``text`` as a key's type, or null; never an error."""
    if type_ == "string":
        return text
    if type_ == "f64":
        text = F.when(~text.rlike(_NOT_A_NUMBER), text)
    return text.try_cast(KEY_TYPES[type_])


def coalesce_epochs(rows: DataFrame, history: list[EpochSchema]) -> DataFrame:
    """``ts, id``, the keys of all epochs as first seen, ``extra, data``, from rows that have all keys.

    A key that some epoch lacks is taken from ``extra`` where its column is
    null, since that is where its values went in those epochs.
    """
    keys, everywhere = union_keys(history)
    columns = [F.col(f"`{k.name}`") if k.name in everywhere else F.coalesce(F.col(f"`{k.name}`"), from_text(F.try_element_at("extra", F.lit(k.name)), k.type)).alias(k.name) for k in keys]
    return rows.select("ts", "id", *columns, "extra", "data")


def read_series(spark: SparkSession, path: str, history: list[EpochSchema], has_files: bool) -> DataFrame:
    """All files below ``path`` as one scan; a file without a column reads nulls."""
    keys, _ = union_keys(history)
    schema = T.StructType([*storage_schema(keys).fields, T.StructField("hour", T.StringType(), True)])
    if not has_files:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("recursiveFileLookup", "false").option("pathGlobFilter", "*.parquet").parquet(path)


def hour_bounds(ts_from: int | None, ts_to: int | None) -> Column:
    """Partitions that can hold times from ``ts_from`` to ``ts_to`` (microseconds, both included)."""
    bound = F.lit(True)
    if ts_from is not None:
        bound = bound & (F.col("hour") >= hour_partition(ts_from))
    if ts_to is not None:
        bound = bound & (F.col("hour") <= hour_partition(ts_to))
    return bound


def series_view(spark: SparkSession, path: str, history: list[EpochSchema], has_files: bool = True) -> DataFrame:
    return coalesce_epochs(read_series(spark, path, history, has_files), history)


def scan(spark: SparkSession, path: str, history: list[EpochSchema], ts_from: int | None = None, ts_to: int | None = None, has_files: bool = True) -> DataFrame:
    """The view over a span of time; only its hours' directories are listed and read, and times are pushed down."""
    rows = read_series(spark, path, history, has_files).filter(hour_bounds(ts_from, ts_to))
    if ts_from is not None:
        rows = rows.filter(F.col("ts") >= F.timestamp_micros(F.lit(ts_from)))
    if ts_to is not None:
        rows = rows.filter(F.col("ts") <= F.timestamp_micros(F.lit(ts_to)))
    return coalesce_epochs(rows, history)


def _ident(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def view_sql(series: str, history: list[EpochSchema]) -> str:
    """The view for readers that take DuckDB's SQL, started in the data directory."""
    keys, everywhere = union_keys(history)
    columns = ["ts", "id"]
    for k in keys:
        typed = _ident(k.name)
        columns.append(typed if k.name in everywhere else f"coalesce({typed}, try_cast(extra[{_text(k.name)}] AS {_SQL_TYPES[k.type]})) AS {typed}")
    columns += ["extra", "data"]
    source = _text(f"series/{series}/**/*.parquet")
    epochs = ", ".join(str(e.epoch) for e in history) or "none"
    return f"-- Written by each flush. Paths are relative to the data directory. Epochs: {epochs}\nCREATE OR REPLACE VIEW {_ident(series)} AS\nSELECT {', '.join(columns)}\nFROM read_parquet({source}, hive_partitioning = 1, union_by_name = 1);\n"

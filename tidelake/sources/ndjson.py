"""Lines of JSON: ``{"ts", "id"?, "keys"?: [scalar], "extra"?: {text: text}, "data"?}``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import TAGS, VALUE

_LINE = "ts variant, id string, keys array<variant>, extra map<string,string>, data string, _bad string"


def classify(value: Column) -> Column:
    """A tagged value from a JSON scalar, by its spelling alone: whole numbers in range are i64, other numbers f64.

    Lists and objects have tag -1.
    """
    kind = F.schema_of_variant(value)
    number = kind.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)")
    whole = kind == "BIGINT"
    tag = F.when(kind == "VOID", TAGS["null"]).when(kind == "BOOLEAN", TAGS["bool"]).when(whole, TAGS["i64"]).when(number, TAGS["f64"]).when(kind == "STRING", TAGS["string"]).otherwise(-1)
    get = lambda t: F.try_variant_get(value, "$", t)
    return F.struct(tag.cast("int").alias("tag"), F.when(kind == "BOOLEAN", get("boolean")).alias("b"), F.when(whole, get("bigint")).alias("i"), F.when(number & ~whole, get("double")).alias("f"), F.when(kind == "STRING", get("string")).alias("s")).cast(VALUE)


def parse_lines(lines: DataFrame, series: str, epoch: int) -> tuple[DataFrame, DataFrame]:
    """Records, and lines that cannot be read with a ``reason``; needs a column ``value``. Blank lines are skipped.

    ``ts`` is required and a whole number. Unknown fields are ignored. A name
    that ``extra`` has twice keeps its last value.
    """
    present = lines.filter(F.trim("value") != "")
    line = F.from_json("value", _LINE, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad", "mapKeyDedupPolicy": "LAST_WIN"})
    parsed = present.select("value", line.alias("j")).select("value", "j.*")
    keys = F.transform(F.coalesce("keys", F.array().cast("array<variant>")), lambda v: F.when(v.isNull(), F.from_json(F.lit("{}"), VALUE).withField("tag", F.lit(0))).otherwise(classify(v)))
    parsed = parsed.withColumn("tagged", keys).withColumn("ts_us", F.when(F.schema_of_variant("ts") == "BIGINT", F.try_variant_get("ts", "$", "bigint")))
    reason = F.when(F.col("_bad").isNotNull(), "json").when(F.col("ts_us").isNull() | (F.col("ts_us") < 0), "ts").when(F.exists("tagged", lambda v: v["tag"] < 0), "keys")
    judged = parsed.withColumn("reason", reason)
    pairs = F.transform(F.map_entries("extra"), lambda e: F.struct(e["key"].alias("k"), F.coalesce(e["value"], F.lit("")).alias("v")))
    good = judged.filter("reason is null").select(
        F.lit(series).alias("series"), F.lit(epoch).alias("epoch"), "ts_us", F.coalesce("id", F.lit("")).alias("id"), F.col("tagged").alias("keys"),
        F.coalesce(pairs, F.array().cast("array<struct<k:string,v:string>>")).alias("extra"), F.coalesce("data", F.lit("")).alias("data"),
    )
    return good, judged.filter("reason is not null").select("value", "reason")


def read_ndjson(spark: SparkSession, path: str, series: str, epoch: int) -> tuple[DataFrame, DataFrame]:
    return parse_lines(spark.read.text(path), series, epoch)

"""The flush as a plan: typed columns, one row per key, sorted within hours."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.records import canonical_extra, hour, key_value, to_timestamp
from ..model import KeyDef


def deduplicate(rows: DataFrame, *by: str, order: tuple[str, ...] = ("seg", "off")) -> DataFrame:
    """Of rows that agree in ``by`` the first to arrive."""
    arrival = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return rows.withColumn("_arrival", arrival).filter("_arrival = 1").drop("_arrival")


def to_storage(landed: DataFrame, keys: tuple[KeyDef, ...] | list[KeyDef]) -> DataFrame:
    """Records of one series and epoch with typed keys: storage columns, ``hour``, and ``seg, off``.

    The defaults of what is never null make it so in the schema too.
    """
    typed = [key_value(F.get("keys", F.lit(i)), k.type).alias(k.name) for i, k in enumerate(keys)]
    return landed.select(
        F.coalesce(to_timestamp("ts_us"), F.timestamp_micros(F.lit(0))).alias("ts"), F.coalesce("id", F.lit("")).alias("id"), *typed, F.coalesce(canonical_extra("extra"), F.create_map().cast("map<string,string>")).alias("extra"), F.coalesce("data", F.lit("")).alias("data"), hour("ts_us").alias("hour"), "seg", "off"
    )


def landed_groups(judged: DataFrame, rows_per_task: int, bytes_per_task: int) -> list[dict]:
    """Per series and epoch of landed records with their ``_reason`` and ``size``: ``n``, how many are ``bad``, the ``tasks`` that all of them need, and the ``hot`` hours of more records or bytes than one task should sort with the tasks they need. One pass, and a row for each."""
    hours = judged.groupBy("series", "epoch", hour("ts_us").alias("hour")).agg(F.count("*").alias("n"), F.count("_reason").alias("bad"), F.sum("size").alias("bytes"))
    share = hours.withColumn("share", F.greatest(F.col("n") / rows_per_task, F.col("bytes") / bytes_per_task)).withColumn("tasks", F.ceil("share"))
    hot = F.collect_list(F.when((F.col("tasks") > 1) & F.col("hour").isNotNull(), F.struct("hour", "tasks")))
    need = F.ceil(F.sum(F.when(F.col("tasks") > 1, F.col("tasks")).otherwise(F.col("share"))))
    rows = share.groupBy("series", "epoch").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"), need.alias("tasks"), hot.alias("hot")).filter("series is not null").orderBy("series", "epoch").collect()
    return [r.asDict() | {"hot": {h["hour"]: h["tasks"] for h in r["hot"]}} for r in rows]


def sort_for_storage(rows: DataFrame, partitions: int | None = None, hot: dict[str, int] | None = None) -> DataFrame:
    """One row for each (hour, ts, id), sorted by them within hours.

    One exchange, by hour: as the hour follows from the time, the window over
    (hour, ts, id) needs no other, and its sort is the order of the files. A
    ``hot`` hour is dealt over so many tasks by a hash of time and id, so rows
    that are alike still meet, and each of its files is sorted.
    """
    by = ["hour"]
    if hot:
        tasks = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for item in hot.items() for x in item]), F.col("hour")), F.lit(1))
        rows = rows.withColumn("_part", F.pmod(F.xxhash64("ts", "id"), tasks))
        by.append("_part")
    dealt = rows.repartition(partitions, *by) if partitions else rows.repartition(*by)
    # The names of this list are also the order of the sort: the part comes last.
    window = Window.partitionBy("hour", "ts", "id", *by[1:]).orderBy("seg", "off")
    return dealt.withColumn("_arrival", F.row_number().over(window)).filter("_arrival = 1").drop("_arrival", "_part")


def flush_counts(decoded: int, rejected: int, written: int) -> dict[str, int]:
    return {"rows": written, "deduplicated": decoded - rejected - written, "rejected": rejected}

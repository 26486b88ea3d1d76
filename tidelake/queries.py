"""Queries over the driver's tables, one for each operator, and their SQL."""

from __future__ import annotations

import atexit
import contextlib
import uuid
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import store
from .config import Config
from .engine import Engine
from .errors import LakeError
from .files import Files, shared_folder
from .functions.records import canonical_extra, encoded_size, hour, micros, rfc3339, text_of, value_of
from .model import RECORD, EpochSchema, KeyDef, SeriesSpec
from .operators.flush import deduplicate, sort_for_storage, to_storage
from .operators.validate import LAST_US, WINDOW, accept_window, reject_reason, unit_of
from .plans.view import coalesce_epochs, hour_bounds
from .sources.ndjson import classify

#: Literals of the queries: a start, a clock and a skew inside the data's month, in microseconds.
TS_MIN, NOW, SKEW_MS = 1_704_499_200_000_000, 1_706_140_800_000_000, 86_400_000
BOUNDS = WINDOW.at(NOW, TS_MIN, SKEW_MS)
_NONE = "array<struct<k:string,v:string>>"
_KEYS = "array<struct<tag:int,b:boolean,i:bigint,f:double,s:string>>"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def _query(sql: str | None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts_us", micros("ts"))


def records(e: DataFrame, keys: list[tuple[str, str]], id_: Column | str = "event_id", series: str = "events", epoch: Column | int = 0, extra: Column | None = None) -> DataFrame:
    """Events as records, with ``seg, off`` by event id."""
    values = F.array(*[value_of(c, t) for c, t in keys]) if keys else F.array().cast(_KEYS)
    return e.select(
        F.lit(series).alias("series"), (F.lit(epoch) if isinstance(epoch, int) else epoch).alias("epoch"), "ts_us", (F.col(id_) if isinstance(id_, str) else id_).cast("string").alias("id"), values.alias("keys"),
        (F.array() if extra is None else extra).cast(_NONE).alias("extra"), F.col("props").alias("data"), (1 + F.floor(F.col("event_id") / 1000)).cast("bigint").alias("seg"), F.col("event_id").alias("off"),
    )


def _pair(k: str, v: Column) -> Column:
    return F.struct(F.lit(k).alias("k"), v.cast("string").alias("v"))


def collisions(e: DataFrame) -> DataFrame:
    """Events with times cut to the hour and their type as id, so that many collide."""
    return e.withColumn("ts_us", F.col("ts_us") - F.col("ts_us") % 3_600_000_000)


KEYS = (KeyDef("event_type", "string"), KeyDef("value", "f64", True))
_COLLIDING = "SELECT event_id, epoch_us(date_trunc('hour', ts)) AS ts_us, event_type AS id, value, 1 + event_id // 1000 AS seg, event_id AS off FROM events"


@_query("SELECT event_id, epoch_us(ts) AS ts_us, CAST(event_id AS VARCHAR) AS id, event_type, value, CAST(user_id AS VARCHAR) AS user_text, props AS data FROM events")
def record_shape(spark, sf_dir):
    e = events(spark, sf_dir)
    r = records(e, [("event_type", "string"), ("value", "f64")], extra=F.array(_pair("user_id", F.col("user_id"))))
    return to_storage(r, KEYS).select(F.col("off").alias("event_id"), F.unix_micros("ts").alias("ts_us"), "id", "event_type", "value", F.try_element_at("extra", F.lit("user_id")).alias("user_text"), "data")


@_query(f"SELECT event_id, epoch_us(ts) AS ts_us FROM events WHERE epoch_us(ts) BETWEEN {BOUNDS.low} AND {BOUNDS.high}")
def accept_window_rows(spark, sf_dir):
    return events(spark, sf_dir).filter(accept_window(F.col("ts_us"), BOUNDS)).select("event_id", "ts_us")


@_query(f"SELECT CASE WHEN epoch_us(ts) BETWEEN {BOUNDS.low} AND {BOUNDS.high} THEN 'accepted' ELSE 'ts' END AS verdict, count(*) AS n FROM events GROUP BY 1")
def accept_window_counts(spark, sf_dir):
    r = records(events(spark, sf_dir), [("event_type", "string")]).withColumn("verdict", F.coalesce(reject_reason({("events", 0): KEYS[:1]}, BOUNDS), F.lit("accepted")))
    return r.groupBy("verdict").agg(F.count("*").alias("n"))


@_query(
    f"""WITH s AS (SELECT event_id, unnest([epoch_us(ts) // 1000000, epoch_us(ts) // 1000, epoch_us(ts), epoch_us(ts) * 1000]) AS t, unnest(['s','ms','us','ns']) AS given FROM events)
SELECT event_id, given, CASE WHEN t BETWEEN {BOUNDS.low} AND {BOUNDS.high} THEN 'us' WHEN t <= {LAST_US // 1000} AND t * 1000 BETWEEN {BOUNDS.low} AND {BOUNDS.high} THEN 'ms'
WHEN t <= {LAST_US // 1000000} AND t * 1000000 BETWEEN {BOUNDS.low} AND {BOUNDS.high} THEN 's' WHEN t // 1000 BETWEEN {BOUNDS.low} AND {BOUNDS.high} THEN 'ns' ELSE 'none' END AS unit FROM s"""
)
def unit_check(spark, sf_dir):
    us = F.col("ts_us")
    scaled = F.array(*[F.struct(F.lit(n).alias("given"), c.cast("bigint").alias("t")) for n, c in (("s", F.floor(us / 1_000_000)), ("ms", F.floor(us / 1000)), ("us", us), ("ns", us * 1000))])
    return events(spark, sf_dir).select("event_id", F.inline(scaled)).select("event_id", "given", unit_of(F.col("t"), BOUNDS).alias("unit"))


@_query(f"SELECT event_id, epoch_us(ts) >= {TS_MIN} AS taken_unset, epoch_us(ts) >= {NOW} AND epoch_us(ts) <= {NOW + SKEW_MS * 1000} AS taken_set FROM events")
def clock_unset_window(spark, sf_dir):
    unset, late = WINDOW.at(TS_MIN - 1, TS_MIN, SKEW_MS), WINDOW.at(NOW, NOW, SKEW_MS)
    return events(spark, sf_dir).select("event_id", accept_window(F.col("ts_us"), unset).alias("taken_unset"), accept_window(F.col("ts_us"), late).alias("taken_set"))


@_query(
    """SELECT count(*) FILTER (event_id % 3 = 0) AS typed_rejects, 0::BIGINT AS raw_rejects, count(*) FILTER (event_id % 5 = 0) AS mistyped, count(*) FILTER (event_id % 7 = 0) AS short FROM events"""
)
def type_null_check(spark, sf_dir):
    e = events(spark, sf_dir).withColumn("sparse", F.when(F.col("event_id") % 3 != 0, F.col("event_type")))
    schemas = {("events", 0): KEYS[:1]}
    judged = records(e, [("sparse", "string")])
    mixed = F.when(F.col("off") % 5 == 0, F.transform("keys", lambda v: v.withField("tag", F.lit(2)))).otherwise(F.col("keys"))
    whole = records(e, [("event_type", "string")])
    bad = lambda df, strict=True: F.count(F.when(reject_reason(schemas, strict=strict).isNotNull(), 1)).cast("bigint")
    a = judged.agg(bad(judged).alias("typed_rejects"), bad(judged, False).alias("raw_rejects"))
    b = whole.withColumn("keys", mixed).agg(bad(whole).alias("mistyped"))
    c = whole.withColumn("keys", F.when(F.col("off") % 7 == 0, F.array_repeat(F.get("keys", F.lit(0)), 2)).otherwise(F.col("keys"))).agg(bad(whole).alias("short"))
    return a.join(b).join(c)  # three single rows


@_query(
    """SELECT doc_id, 30 + 4 + octet_length(encode(CAST(doc_id AS VARCHAR))) + 5 + octet_length(encode(lang)) + 4 + 6 + octet_length(encode(source)) + octet_length(encode(text)) AS size,
30 + 4 + octet_length(encode(CAST(doc_id AS VARCHAR))) + 5 + octet_length(encode(lang)) + 4 + 6 + octet_length(encode(source)) + octet_length(encode(text)) > 16384 AS too_large FROM documents"""
)
def size_limit(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    r = d.select("doc_id", F.lit("docs").alias("series"), F.col("doc_id").cast("string").alias("id"), F.array(value_of("lang", "string")).alias("keys"), F.array(_pair("source", F.col("source"))).alias("extra"), F.col("text").alias("data"))
    return r.select("doc_id", encoded_size().alias("size")).withColumn("too_large", F.col("size") > 16_384)


@_query("SELECT doc_id, octet_length(encode(text)) > 4096 AS long_name, octet_length(encode(text)) * 4 > 65535 AS rejected FROM documents")
def field_limits(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumns({"ts_us": F.lit(NOW), "props": F.lit(""), "event_id": F.col("doc_id")})
    r = records(d, [], id_=F.repeat("text", F.lit(4)))
    return r.select(F.col("off").alias("doc_id"), (F.octet_length("id") > 4 * 4096).alias("long_name"), F.coalesce(reject_reason({("events", 0): ()}) == "field", F.lit(False)).alias("rejected"))


@_query("SELECT CASE WHEN event_id % 10 = 9 THEN 'schema' ELSE 'known' END AS verdict, count(*) AS n FROM events GROUP BY 1")
def epoch_known(spark, sf_dir):
    epoch = F.when(F.col("event_id") % 10 == 9, 7).otherwise(F.col("event_id") % 2).cast("int")
    r = records(events(spark, sf_dir), [("event_type", "string")], epoch=epoch)
    reason = reject_reason({("events", 0): KEYS[:1], ("events", 1): KEYS[:1]})
    return r.select(F.coalesce(reason, F.lit("known")).alias("verdict")).groupBy("verdict").agg(F.count("*").alias("n"))


@_query("WITH s AS (SELECT 1 + event_id // 1000 AS seg FROM events), m AS (SELECT max(seg) AS active FROM s) SELECT seg, count(*) AS n FROM s, m WHERE seg > active // 4 AND seg < active GROUP BY 1")
def segment_eligible(spark, sf_dir):
    """The last segment is being written, and the first quarter was flushed."""
    rows = records(events(spark, sf_dir), [])
    found = [r["seg"] for r in rows.select("seg").distinct().collect()]  # a number per segment
    active = max(found, default=0)
    return rows.filter(F.col("seg").isin(store.eligible(found, active // 4, active))).groupBy("seg").agg(F.count("*").alias("n"))


@_query("SELECT strftime(ts, '%Y-%m-%dT%H') AS hour, count(*) AS n FROM events GROUP BY 1")
def hour_partition(spark, sf_dir):
    return events(spark, sf_dir).groupBy(hour("ts_us").alias("hour")).agg(F.count("*").alias("n"))


@_query("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ') AS text FROM events")
def rfc3339_format(spark, sf_dir):
    return events(spark, sf_dir).select("event_id", rfc3339("ts_us").alias("text"))


@_query(
    """WITH p AS (SELECT event_id, unnest(['z', 'k', 'z', 'u']) AS k, unnest([CAST(event_id % 17 AS VARCHAR), event_type, CAST(event_id % 13 AS VARCHAR), CAST(user_id AS VARCHAR)]) AS v FROM events)
SELECT event_id, k, min(v) AS v FROM p GROUP BY 1, 2"""
)
def extra_canonical(spark, sf_dir):
    pairs = F.array(_pair("z", F.col("event_id") % 17), _pair("k", F.col("event_type")), _pair("z", F.col("event_id") % 13), _pair("u", F.col("user_id")))
    return events(spark, sf_dir).withColumn("pairs", pairs).select("event_id", F.explode(canonical_extra("pairs")).alias("k", "v"))


def _first(by: str, order: str = "seg, off", extra: str = "") -> str:
    return f"SELECT event_id, ts_us, id, value FROM (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY {order}) AS rn FROM (SELECT *{extra} FROM ({_COLLIDING}))) WHERE rn = 1"


def _colliding(spark, sf_dir) -> DataFrame:
    return records(collisions(events(spark, sf_dir)), [("event_type", "string"), ("value", "f64")], id_="event_type")


@_query(_first("ts_us, id"))
def dedup_first_arrival(spark, sf_dir):
    rows = sort_for_storage(to_storage(_colliding(spark, sf_dir), KEYS))
    return rows.select(F.col("off").alias("event_id"), F.unix_micros("ts").alias("ts_us"), "id", "value")


@_query(f"SELECT event_id, ts_us, '' AS id, value FROM (SELECT *, row_number() OVER (PARTITION BY ts_us ORDER BY seg, off) AS rn FROM ({_COLLIDING})) WHERE rn = 1")
def dedup_empty_id(spark, sf_dir):
    rows = sort_for_storage(to_storage(_colliding(spark, sf_dir).withColumn("id", F.lit("")), KEYS))
    return rows.select(F.col("off").alias("event_id"), F.unix_micros("ts").alias("ts_us"), "id", "value")


@_query(_first("ts_us, id, event_id % 2"))
def dedup_per_epoch(spark, sf_dir):
    rows = _colliding(spark, sf_dir).withColumn("epoch", (F.col("off") % 2).cast("int"))
    kept = deduplicate(rows, "series", "epoch", "ts_us", "id")
    return kept.select(F.col("off").alias("event_id"), "ts_us", "id", F.get("keys", F.lit(1))["f"].alias("value"))


@_query(_first("ts_us, id, seg // 4"))
def dedup_per_flush(spark, sf_dir):
    rows = _colliding(spark, sf_dir).withColumn("flush", F.floor(F.col("seg") / 4))
    return deduplicate(rows, "series", "epoch", "flush", "ts_us", "id").select(F.col("off").alias("event_id"), "ts_us", "id", F.get("keys", F.lit(1))["f"].alias("value"))


_RECORDS_BY_USER = "SELECT event_id, ts, strftime(ts, '%Y-%m-%dT%H') AS hour, CAST(user_id AS VARCHAR) AS id FROM events"


@_query(f"SELECT event_id, hour, row_number() OVER (PARTITION BY hour ORDER BY ts, id, event_id) AS position FROM ({_RECORDS_BY_USER})")
def sorted_position(spark, sf_dir):
    rows = sort_for_storage(to_storage(records(events(spark, sf_dir), [], id_="user_id"), ()))
    return rows.select(F.col("off").alias("event_id"), "hour", F.row_number().over(Window.partitionBy("hour").orderBy("ts", "id", "seg", "off")).alias("position"))


@_query(
    f"""SELECT event_id, ts_us, id, value FROM (SELECT *, row_number() OVER (PARTITION BY ts_us, id ORDER BY run, off) AS rn FROM
(SELECT *, 1 AS run FROM ({_COLLIDING}) WHERE event_id % 3 = 0 UNION ALL SELECT *, 2 AS run FROM ({_COLLIDING}) WHERE event_id % 3 <> 0)) WHERE rn = 1"""
)
def merge_runs(spark, sf_dir):
    rows = _colliding(spark, sf_dir)
    runs = rows.filter("off % 3 = 0").withColumn("seg", F.lit(1).cast("bigint")).union(rows.filter("off % 3 <> 0").withColumn("seg", F.lit(2).cast("bigint")))
    return sort_for_storage(to_storage(runs, KEYS)).select(F.col("off").alias("event_id"), F.unix_micros("ts").alias("ts_us"), "id", "value")


_DECODED = f"SELECT count(*) FROM ({_COLLIDING})"
_GOOD = f"SELECT * FROM ({_COLLIDING}) WHERE event_id % 10 <> 0"
_WRITTEN = f"SELECT count(*) FROM (SELECT DISTINCT ts_us, id FROM ({_GOOD}))"


def _lake(spark: SparkSession) -> str:
    """A new directory in the session's shared folder; it goes when the driver ends, as results are read from it later."""
    path = f"{shared_folder(spark)}/lake-{uuid.uuid4().hex}"
    atexit.register(_drop, spark, path)
    return path


def _drop(spark: SparkSession, path: str) -> None:
    if spark.sparkContext._jsc is not None:  # not stopped
        with contextlib.suppress(Exception):  # the session may be gone, and with it the way to its files
            Files(spark, path).delete()


def _engine(spark, *series, at: str | None = None, **flush):
    config = Config(data_dir=at or _lake(spark), series=[SeriesSpec(name, keys) for name, keys in series])
    config.flush.on_startup = False
    for name, value in flush.items():
        setattr(config.flush, name, value)
    return Engine(spark, config)


#: Queries on real files cut times to a quarter of a day, which is an hour in which all its rows are.
_QUARTER = "time_bucket(INTERVAL 6 HOURS, ts, TIMESTAMP '2000-01-01')"
LATER = NOW + 10**13


def _quarters(e: DataFrame) -> DataFrame:
    return e.withColumn("ts_us", F.col("ts_us") - F.col("ts_us") % 21_600_000_000)


def _files(engine: Engine, name: str) -> DataFrame:
    """Rows of the published files of a series, with the ``hour`` of their directory, ``first, last, epoch`` of their name, and their place in the file."""

    @F.pandas_udf("first long, last long, epoch long")
    def named(names: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([store.parse_output(n) for n in names], columns=["first", "last", "epoch"])

    rows = engine.spark.read.parquet(engine.files.path("series", name))
    return rows.select("ts", "id", "hour", "_metadata.file_name", "_metadata.row_index").withColumn("named", named("file_name")).select("*", "named.*").drop("named")


@_query(
    f"""WITH r AS (SELECT {_QUARTER} AS ts, event_id, (row_number() OVER (PARTITION BY {_QUARTER} ORDER BY CAST(event_id AS VARCHAR)) - 1) // 8 AS row_group FROM events)
SELECT strftime(ts, '%Y-%m-%dT%H') AS hour, row_group, count(*) AS n, min(CAST(event_id AS VARCHAR)) AS first_id, max(CAST(event_id AS VARCHAR)) AS last_id FROM r GROUP BY 1, 2"""
)
def row_group_stats(spark, sf_dir):
    """Groups of eight rows of the files that a flush wrote, by their places in them."""
    with _engine(spark, ("events", ()), row_group_rows=8) as engine:
        engine.append_raw(records(_quarters(events(spark, sf_dir)), []), LATER)
        engine.flush()
        rows = _files(engine, "events").withColumn("row_group", F.floor(F.col("row_index") / 8))
        return rows.groupBy("hour", "row_group").agg(F.count("*").alias("n"), F.min("id").alias("first_id"), F.max("id").alias("last_id"))


@_query(f"SELECT CASE WHEN event_id % 2 = 0 THEN 'even' ELSE 'odd' END AS series, event_id // 2 % 2 AS epoch, strftime({_QUARTER}, '%Y-%m-%dT%H') AS hour, count(*) AS n FROM events GROUP BY 1, 2, 3")
def hour_split_files(spark, sf_dir):
    """One flush of two series in two epochs each: every hour of each has its own file."""
    path = _lake(spark)
    _engine(spark, ("even", ()), ("odd", ()), at=path).close()
    with _engine(spark, ("even", KEYS[1:]), ("odd", KEYS[1:]), at=path) as engine:  # a new key: epoch 1
        second = F.floor(F.col("event_id") / 2) % 2 == 1
        r = records(_quarters(events(spark, sf_dir)), [("value", "f64")], epoch=second.cast("int"))
        r = r.withColumn("keys", F.when(F.col("epoch") == 1, F.col("keys")).otherwise(F.slice("keys", 1, 0))).withColumn("series", F.when(F.col("off") % 2 == 0, "even").otherwise("odd"))
        engine.append_raw(r, LATER)
        engine.flush()
        each = [_files(engine, name).groupBy("epoch", "hour").agg(F.count("*").alias("n")).select(F.lit(name).alias("series"), "epoch", "hour", "n") for name in ("even", "odd")]
        return each[0].union(each[1])


@_query(f"SELECT ({_WRITTEN}) AS written, (SELECT count(*) FROM ({_GOOD})) - ({_WRITTEN}) AS deduplicated, ({_DECODED}) - (SELECT count(*) FROM ({_GOOD})) AS rejected")
def flush_outcome(spark, sf_dir):
    """What a flush says of itself: every tenth record has its keys in the wrong order."""
    with _engine(spark, ("events", KEYS)) as engine:
        r = _colliding(spark, sf_dir)
        engine.append_raw(r.withColumn("keys", F.when(F.col("off") % 10 == 0, F.reverse("keys")).otherwise(F.col("keys"))), LATER)
        done = engine.flush()
        return spark.createDataFrame([(done.rows, done.deduplicated, done.rejected)], "written long, deduplicated long, rejected long")


_SIZE = "30 + 4 + octet_length(encode(CAST(doc_id AS VARCHAR))) + octet_length(encode(text))"


@_query(f"SELECT count(*) FILTER ({_SIZE} <= 4096) AS accepted, count(*) FILTER ({_SIZE} > 4096) AS rejected, count(*) FILTER ({_SIZE} <= 4096) AS flushed FROM documents")
def raw_size_limit(spark, sf_dir):
    """Raw records over the limit are counted and left out."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    r = d.select(F.lit("docs").alias("series"), F.lit(0).alias("epoch"), F.lit(NOW).alias("ts_us"), F.col("doc_id").cast("string").alias("id"), F.array().cast(_KEYS).alias("keys"), F.array().cast(_NONE).alias("extra"), F.col("text").alias("data"))
    config = Config(data_dir=_lake(spark), series=[SeriesSpec("docs")])
    config.flush.on_startup, config.limits.max_record_bytes = False, 4096
    with Engine(spark, config) as engine:
        done = engine.append_raw(r, LATER)
        return spark.createDataFrame([(done.accepted, engine.counts.rejected_size, engine.flush().rows)], "accepted long, rejected long, flushed long")


@_query(
    f"""SELECT 'time' AS fault, 'TsOutOfRange' AS raised, 1 AS rejected_ts, 0 AS rejected_size, 0 AS appended UNION ALL SELECT 'type', 'TypeMismatch value', 0, 0, 0 UNION ALL SELECT 'size', 'RecordTooLarge', 0, 1, 0
UNION ALL SELECT 'none', '', 0, 0, count(*) FROM events"""
)
def append_faults(spark, sf_dir):
    """Of typed appends with one bad row all rows are refused, the fault is named and counted once."""
    e = events(spark, sf_dir).select("ts_us", F.col("event_id").cast("string").alias("id"), "event_type", "value", F.col("props").alias("data"))
    keys = (KeyDef("event_type", "string"), KeyDef("value", "f64"))
    last = F.col("id") == "0"
    faults = {"time": e.withColumn("ts_us", F.when(last, 5).otherwise(F.col("ts_us"))), "type": e.withColumn("value", F.when(~last, F.col("value"))), "size": e.withColumn("data", F.when(last, F.repeat(F.lit("x"), F.lit(20_000))).otherwise(F.col("data"))), "none": e}
    found = []
    for fault, rows in faults.items():
        with _engine(spark, ("events", keys)) as engine:
            raised = ""
            try:
                engine.append("events", rows, LATER)
            except LakeError as error:
                raised = type(error).__name__ + (" value" if "'value'" in str(error) else "")
            found.append((fault, raised, engine.counts.rejected_ts, engine.counts.rejected_size, engine.counts.appended))
    return spark.createDataFrame(found, "fault string, raised string, rejected_ts int, rejected_size int, appended long")


@_query("SELECT event_id, CAST(epoch_us(ts) AS VARCHAR) AS ts, CAST(event_id AS VARCHAR) AS i, CASE WHEN value / 4 = floor(value / 4) THEN CAST(CAST(value / 4 AS BIGINT) AS VARCHAR) ELSE CAST(value / 4 AS VARCHAR) END AS f, CASE WHEN event_id % 2 = 0 THEN 'true' ELSE 'false' END AS b FROM events")
def render_text(spark, sf_dir):
    e = events(spark, sf_dir)
    return e.select("event_id", text_of("ts", "ts").alias("ts"), text_of("event_id", "i64").alias("i"), text_of(F.col("value") / 4, "f64").alias("f"), text_of(F.col("event_id") % 2 == 0, "bool").alias("b"))


#: Rows that one task sorts before they are appended.
_RANGE_ROWS = 250_000


@_query(_first("ts_us, id").replace("event_id, ts_us, id, value", "ts_us, id, value"))
def flush_roundtrip(spark, sf_dir):
    e = collisions(events(spark, sf_dir))
    # Rows arrive by event id: ranges of ids, each small enough for one task to sort, in the order of the tasks.
    e = e.repartitionByRange(max(1, -(-e.count() // _RANGE_ROWS)), "event_id").sortWithinPartitions("event_id")
    with _engine(spark, ("events", KEYS)) as engine:
        engine.append("events", e.select("ts_us", F.col("event_type").alias("id"), "event_type", "value"), NOW + 10**13)
        engine.flush()
        return engine.table("events").select(F.unix_micros("ts").alias("ts_us"), "id", "value")


E0, E1 = EpochSchema(0, KEYS[:1]), EpochSchema(1, (KEYS[0], KeyDef("value", "f64", True), KeyDef("user_id", "i64", True)))


def _epoch_rows(e: DataFrame, promoted: bool = True) -> DataFrame:
    """Even events as epoch 0 with ``value`` and ``user_id`` in extra, odd ones as epoch 1 with both as keys; or the reverse."""
    old = F.col("event_id") % 2 == (0 if promoted else 1)
    pairs = F.array(_pair("user_id", F.col("user_id")), _pair("value", F.col("value")))
    return e.select(
        F.timestamp_micros("ts_us").alias("ts"), F.col("event_id").cast("string").alias("id"), "event_type", F.when(~old, F.col("value")).alias("value"), F.when(~old, F.col("user_id")).alias("user_id"),
        F.when(old, canonical_extra(pairs)).otherwise(F.create_map().cast("map<string,string>")).alias("extra"), F.col("props").alias("data"),
    )


@_query("SELECT CAST(event_id AS VARCHAR) AS id, event_type, value, user_id, event_id % 2 = 0 AS in_extra FROM events")
def view_promoted_key(spark, sf_dir):
    v = coalesce_epochs(_epoch_rows(events(spark, sf_dir)), [E0, E1])
    return v.select("id", "event_type", "value", "user_id", (F.size("extra") > 0).alias("in_extra"))


@_query("SELECT CAST(event_id AS VARCHAR) AS id, event_type, value, user_id, event_id % 2 = 1 AS in_extra FROM events")
def view_demoted_key(spark, sf_dir):
    v = coalesce_epochs(_epoch_rows(events(spark, sf_dir), False), [EpochSchema(0, E1.keys), EpochSchema(1, E0.keys)])
    return v.select("id", "event_type", "value", "user_id", (F.size("extra") > 0).alias("in_extra"))


def _from_extra(e: DataFrame, **pairs: Column) -> DataFrame:
    typed = (KeyDef("b", "bool", True), KeyDef("f", "f64", True), KeyDef("i", "i64", True), KeyDef("s", "string", True))
    extra = canonical_extra(F.array(*[_pair(k, v) for k, v in pairs.items()]))
    rows = e.select(F.timestamp_micros("ts_us").alias("ts"), F.col("event_id").cast("string").alias("id"), *[F.lit(None).cast({"bool": "boolean", "f64": "double", "i64": "bigint", "string": "string"}[k.type]).alias(k.name) for k in typed], extra.alias("extra"), F.lit("").alias("data"))
    return coalesce_epochs(rows, [EpochSchema(0, ()), EpochSchema(1, typed)]).select("id", "b", "f", "i", "s")


@_query("SELECT CAST(event_id AS VARCHAR) AS id, event_id % 2 = 0 AS b, CAST(event_id AS DOUBLE) / 4 AS f, user_id - 50 AS i, event_type AS s FROM events")
def view_all_types(spark, sf_dir):
    return _from_extra(events(spark, sf_dir), b=F.when(F.col("event_id") % 2 == 0, "true").otherwise("false"), f=F.col("event_id") / 4, i=F.col("user_id") - 50, s=F.col("event_type"))


@_query(
    """SELECT CAST(event_id AS VARCHAR) AS id, CASE WHEN event_id % 3 = 0 THEN true END AS b, CASE WHEN event_id % 3 = 0 THEN 2.5::DOUBLE END AS f, CASE WHEN event_id % 3 = 0 THEN 7::BIGINT END AS i, CASE WHEN event_id % 3 = 0 THEN '7' ELSE 'x7' END AS s FROM events"""
)
def view_unparseable_null(spark, sf_dir):
    pick = lambda good, bad: F.when(F.col("event_id") % 3 == 0, good).otherwise(bad)
    return _from_extra(events(spark, sf_dir), b=pick("true", "maybe"), f=pick("2.5", "1.5d"), i=pick("7", "seven"), s=pick("7", "x7"))


@_query(
    """SELECT CAST(event_id AS VARCHAR) AS id, CASE WHEN event_id % 3 < 2 THEN event_type END AS event_type, CASE WHEN event_id % 3 > 0 THEN value END AS value, CASE WHEN event_id % 3 = 2 THEN user_id END AS user_id FROM events"""
)
def view_union_by_name(spark, sf_dir):
    history = [EpochSchema(0, KEYS[:1]), EpochSchema(1, KEYS), EpochSchema(2, (KeyDef("value", "f64", True), KeyDef("user_id", "i64", True)))]
    e = events(spark, sf_dir)
    base = e.select("event_id", F.timestamp_micros("ts_us").alias("ts"), F.col("event_id").cast("string").alias("id"), F.create_map().cast("map<string,string>").alias("extra"), F.col("props").alias("data"), "event_type", "value", "user_id")
    parts = [base.filter(F.col("event_id") % 3 == s.epoch).select("ts", "id", *[k.name for k in s.keys], "extra", "data") for s in history]
    union = parts[0].unionByName(parts[1], allowMissingColumns=True).unionByName(parts[2], allowMissingColumns=True)
    return coalesce_epochs(union, history).select("id", "event_type", "value", "user_id")


SPAN = (1_704_891_600_000_000, 1_705_500_000_000_000)


@_query(f"SELECT CAST(event_id AS VARCHAR) AS id, epoch_us(ts) AS ts_us, value FROM events WHERE epoch_us(ts) BETWEEN {SPAN[0]} AND {SPAN[1]}")
def view_time_range(spark, sf_dir):
    e = events(spark, sf_dir)
    rows = to_storage(records(e, [("event_type", "string"), ("value", "f64")]), KEYS).filter(hour_bounds(*SPAN)).filter(F.unix_micros("ts").between(*SPAN))
    return coalesce_epochs(rows, [EpochSchema(0, KEYS)]).select("id", F.unix_micros("ts").alias("ts_us"), "value")


def _summary(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count("*").alias("n"), F.unix_micros(F.min("ts")).alias("first_us"), F.unix_micros(F.max("ts")).alias("last_us"))


@_query("SELECT count(*) AS n, epoch_us(min(ts)) AS first_us, epoch_us(max(ts)) AS last_us FROM events")
def reader_summary(spark, sf_dir):
    return _summary(to_storage(records(events(spark, sf_dir), []), ()))


@_query(f"SELECT strftime({_QUARTER}, '%Y-%m-%dT%H') AS hour, count(DISTINCT CASE WHEN event_id % 50 = 0 THEN 1 ELSE 0 END) AS files, count(*) AS n FROM events GROUP BY 1")
def late_data_hours(spark, sf_dir):
    """Every fiftieth event arrives with a later flush, and goes to its own old hour as another file."""
    with _engine(spark, ("events", ())) as engine:
        r = records(_quarters(events(spark, sf_dir)), [])
        for late in (False, True):
            engine.append_raw(r.filter((F.col("off") % 50 == 0) == late), LATER)
            engine.flush()
        return _files(engine, "events").groupBy("hour").agg(F.countDistinct("file_name").alias("files"), F.count("*").alias("n"))


_NAMES = """SELECT event_id, CASE event_id % 5 WHEN 0 THEN lpad(CAST(event_id AS VARCHAR), 10, '0') || '-' || lpad(CAST(event_id + 2 AS VARCHAR), 10, '0') || '.e' || CAST(event_id % 3 AS VARCHAR) || '.parquet'
WHEN 1 THEN CAST(event_id AS VARCHAR) || '-7.e0.parquet' WHEN 2 THEN '0' || lpad(CAST(event_id AS VARCHAR), 10, '0') || '-' || lpad(CAST(event_id AS VARCHAR), 10, '0') || '.e0.parquet' WHEN 3 THEN 'part-' || CAST(event_id AS VARCHAR) || '.parquet'
ELSE '1' || lpad(CAST(event_id AS VARCHAR), 10, '0') || '-1' || lpad(CAST(event_id AS VARCHAR), 10, '0') || '.e12.parquet' END AS name FROM events"""


@_query(
    rf"""SELECT event_id, name, CASE WHEN NOT regexp_full_match(name, '([0-9]{{10}}|[1-9][0-9]{{10,}})-([0-9]{{10}}|[1-9][0-9]{{10,}})\.e[0-9]+(-[0-9]+)?\.parquet') THEN 'foreign'
WHEN CAST(regexp_extract(name, '-([0-9]+)\.e', 1) AS BIGINT) <= 500 THEN 'committed' ELSE 'uncommitted' END AS verdict FROM ({_NAMES})"""
)
def sweep_classify(spark, sf_dir):
    n, pad = F.col("event_id"), lambda c: F.lpad(c.cast("string"), 10, "0")
    name = (
        F.when(n % 5 == 0, F.concat(pad(n), F.lit("-"), pad(n + 2), F.lit(".e"), (n % 3).cast("string"), F.lit(".parquet")))
        .when(n % 5 == 1, F.concat(n.cast("string"), F.lit("-7.e0.parquet")))
        .when(n % 5 == 2, F.concat(F.lit("0"), pad(n), F.lit("-"), pad(n), F.lit(".e0.parquet")))
        .when(n % 5 == 3, F.concat(F.lit("part-"), n.cast("string"), F.lit(".parquet")))
        .otherwise(F.concat(F.lit("1"), pad(n), F.lit("-1"), pad(n), F.lit(".e12.parquet")))
    )

    @F.pandas_udf("string")
    def verdict(names: pd.Series) -> pd.Series:
        return names.map(lambda x: store.classify(x, 500))

    return events(spark, sf_dir).select("event_id", name.alias("name")).select("event_id", "name", verdict("name").alias("verdict"))


@_query(
    """SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'i64' WHEN 1 THEN 'f64' WHEN 2 THEN 'string' WHEN 3 THEN 'bool' ELSE 'null' END AS kind, CASE event_id % 5 WHEN 0 THEN CAST(json_extract(props, '$.k') AS BIGINT) END AS i FROM events"""
)
def ndjson_keys(spark, sf_dir):
    k, n = F.get_json_object("props", "$.k"), F.col("event_id") % 5
    text = F.when(n == 0, k).when(n == 1, F.concat(k, F.lit(".5"))).when(n == 2, F.concat(F.lit('"'), k, F.lit('"'))).when(n == 3, "true").otherwise("null")
    tagged = events(spark, sf_dir).select("event_id", classify(F.parse_json(text)).alias("v"))
    names = F.element_at(F.array(*map(F.lit, ("null", "bool", "i64", "f64", "string"))), F.col("v.tag") + 1)
    return tagged.select("event_id", names.alias("kind"), F.col("v.i").alias("i"))


@_query(_first("ts_us, id, event_id % 2").replace("event_id, ts_us, id, value", "ts_us, id, value"))
def streaming_flush(spark, sf_dir):
    """Two series' records through a file stream into an engine, and read back."""
    from .streaming import ingest_stream

    rows = _colliding(spark, sf_dir).withColumn("series", F.when(F.col("off") % 2 == 0, "even").otherwise("odd"))
    with _engine(spark, ("even", KEYS), ("odd", KEYS)) as engine:
        inbox = engine.files.path("inbox")
        rows.drop("seg").write.parquet(inbox)
        stream = spark.readStream.schema(f"{RECORD}, off bigint").parquet(inbox)  # of several files none is first, so records keep their order
        ingest_stream(engine, stream, engine.files.path("checkpoint"), f"s{uuid.uuid4().hex[:8]}", now_us=NOW + 10**13, order="off").awaitTermination()
        engine.flush()
        return engine.table("even").union(engine.table("odd")).select(F.unix_micros("ts").alias("ts_us"), "id", "value")


@_query(
    """WITH c AS (SELECT event_id, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(props) + 1), lambda i : ascii(props[i])::BIGINT)),
lambda c, x : list_reduce(list_prepend(xor(c, x), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda a, b : CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)) AS c FROM events)
SELECT event_id, xor(c, 4294967295) AS crc FROM c"""
)
def crc32_data(spark, sf_dir):
    return events(spark, sf_dir).select("event_id", F.crc32(F.col("props").cast("binary")).alias("crc"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events validated, with a part of them arriving twice, flushed in plan, and summed up by hour."""
    e = events(spark, sf_dir)
    r = records(e, [("event_type", "string"), ("value", "f64")], extra=F.array(_pair("user_id", F.col("user_id"))))
    again = r.filter("off % 7 = 0").withColumn("seg", F.col("seg") + 1_000_000)
    good = r.union(again).filter(reject_reason({("events", 0): KEYS}, BOUNDS, 16_384).isNull())
    rows = sort_for_storage(to_storage(good, KEYS))
    return rows.groupBy("hour").agg(F.count("*").alias("n"), F.unix_micros(F.min("ts")).alias("first_us"), F.unix_micros(F.max("ts")).alias("last_us"))


QUERIES["flush_by_hour"] = flagship
ORACLE_SQL["flush_by_hour"] = f"SELECT strftime(ts, '%Y-%m-%dT%H') AS hour, count(*) AS n, epoch_us(min(ts)) AS first_us, epoch_us(max(ts)) AS last_us FROM events WHERE epoch_us(ts) BETWEEN {BOUNDS.low} AND {BOUNDS.high} GROUP BY 1"

"""Every query with SQL gives the rows that DuckDB gives."""

import math
from pathlib import Path

import duckdb
import pytest

from tidelake.queries import ORACLE_SQL, QUERIES, flagship

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="needs the driver's tables")


def plain(rows):
    def one(x):
        return ("nan",) if isinstance(x, float) and math.isnan(x) else round(x, 9) if isinstance(x, float) else x

    return sorted([tuple(one(x) for x in r) for r in rows], key=repr)


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for p in Path(DATA).glob("*.parquet"):
        c.execute(f"create view {p.stem} as select * from '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query(spark, db, name):
    got = QUERIES[name](spark, DATA)
    want = db.sql(ORACLE_SQL[name])
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    rows = plain(got.select(*columns).collect())
    assert rows == plain(db.sql(f"select {', '.join(columns)} from ({ORACLE_SQL[name]})").fetchall())


def test_every_query_has_sql_and_checksums_are_the_usual_ones(spark):
    import zlib

    assert set(QUERIES) == set(ORACLE_SQL)
    assert spark.sql("select crc32(cast('123456789' as binary)) c").first()["c"] == zlib.crc32(b"123456789") == 0xCBF43926


def test_the_flush_has_one_exchange_and_one_sort(spark):
    from tidelake.operators.flush import sort_for_storage, to_storage
    from tidelake.queries import KEYS, events, records

    plan = sort_for_storage(to_storage(records(events(spark, DATA), [("event_type", "string"), ("value", "f64")]), KEYS))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.count("Sort [") == 1
    assert flagship(spark, DATA).count() > 0


def test_the_round_trip_is_appended_by_several_tasks_in_order(spark, db, monkeypatch):
    from tidelake import queries
    from tidelake.engine import Engine

    ranges, append = [], Engine.append

    def watched(self, name, df, now_us=None):
        ranges.extend(df.rdd.mapPartitions(lambda rows: [len(list(rows))]).collect())
        return append(self, name, df, now_us)

    monkeypatch.setattr(queries, "_RANGE_ROWS", 100, raising=False)
    monkeypatch.setattr(Engine, "append", watched)
    got = QUERIES["flush_roundtrip"](spark, DATA).select("id", "ts_us", "value").collect()
    assert plain(got) == plain(db.sql(f"select id, ts_us, value from ({ORACLE_SQL['flush_roundtrip']})").fetchall())
    assert sum(ranges) == db.sql("select count(*) from events").fetchall()[0][0] and max(ranges) < sum(ranges) / 2


def test_a_typed_append_lands_without_a_sort(spark, tmp_path):
    from tidelake.config import Config
    from tidelake.engine import Engine
    from tidelake.model import SeriesSpec

    config = Config(data_dir=str(tmp_path), series=[SeriesSpec("a=b c")])
    config.flush.on_startup = False
    with Engine(spark, config) as engine:
        store = spark._jsparkSession.sharedState().statusStore()
        before = store.executionsCount()
        assert engine.append("a=b c", spark.range(10).selectExpr("id + 1700000000000000 ts_us", "cast(id as string) id"), 1_700_000_100_000_000) == 10
        texts = [store.executionsList(i, 1).head().physicalPlanDescription() for i in range(before, store.executionsCount())]
        writes = [t for t in texts if "WriteFiles" in t]
        assert len(writes) == 1 and "Sort" not in writes[0]
        assert engine.flush().rows == 10 and engine.table("a=b c").count() == 10


def test_a_stream_of_several_files_keeps_the_order_of_its_records(spark, db, tmp_path, monkeypatch):
    from tidelake import streaming

    files, texts, ingest, conf = [], [], streaming.ingest_stream, "spark.sql.maxConcurrentOutputFileWriters"
    plans = spark._jsparkSession.sharedState().statusStore()
    before, kept = plans.executionsCount(), spark.conf.get(conf)

    def watched(engine, *args, **more):
        files.extend(p for p in engine.files.walk("inbox") if p.endswith(".parquet"))
        started = ingest(engine, *args, **more)
        started.awaitTermination()
        texts.extend(plans.executionsList(i, 1).head().physicalPlanDescription() for i in range(before, plans.executionsCount()))
        return started

    spark.read.parquet(f"{DATA}/events.parquet").repartition(3, "user_id").write.parquet(f"{tmp_path}/events.parquet")
    monkeypatch.setattr(streaming, "ingest_stream", watched)
    got = QUERIES["streaming_flush"](spark, str(tmp_path)).select("id", "ts_us", "value").collect()
    assert plain(got) == plain(db.sql(f"select id, ts_us, value from ({ORACLE_SQL['streaming_flush']})").fetchall())
    assert len(files) == 3 and spark.conf.get(conf) == kept
    landed = [t for t in texts if "/wal/_tmp" in t]
    assert len(landed) == 1 and "Sort" not in landed[0]

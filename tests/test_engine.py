"""End to end: append, flush, read, crash, evolve."""

import json

import duckdb
import pytest
from pyspark.sql import functions as F

from tidelake import store
from tidelake.config import Config
from tidelake.engine import Engine
from tidelake.errors import FieldTooLong, KeyArity, Locked, ManifestError, RecordTooLarge, TsOutOfRange, TypeMismatch, UnknownSeries
from tidelake.model import KeyDef, SeriesSpec
from tidelake.sources.ndjson import parse_lines
from tidelake.streaming import ingest_stream

T13 = 1_786_194_000_000_000
NOW = T13 + 3_600_000_000 * 5
HOUR = 3_600_000_000


def config(path, *series, **flush):
    c = Config(data_dir=str(path))
    c.series = list(series) or [SeriesSpec("trades", (KeyDef("symbol", "string"), KeyDef("size", "i64", True))), SeriesSpec("quotes")]
    c.flush.on_startup = False
    for k, v in flush.items():
        setattr(c.flush, k, v)
    return c


def rows(spark, data, schema="ts_us long, id string, symbol string, size long"):
    return spark.createDataFrame(data, schema).coalesce(1)


def published(engine):
    return [p for p in engine.files.walk("series") if p.endswith(".parquet")]


def test_append_flush_read(spark, tmp_path):
    with Engine(spark, config(tmp_path)) as e:
        e.append("trades", rows(spark, [(T13 + i, f"id-{i}", "A", i) for i in range(100)]), NOW)
        done = e.flush()
        assert (done.committed, done.rows, done.deduplicated, done.rejected) == (True, 100, 0, 0)
        assert e.table("trades").count() == 100 and e.table("trades").columns == ["ts", "id", "symbol", "size", "extra", "data"]
        assert e.table("quotes").count() == 0
        assert [p.split("/")[1] for p in published(e)] == ["trades"]
        assert not store.segments(e.files) and not e.flush().committed


def test_duplicates_go_and_hours_get_their_own_files(spark, tmp_path):
    readings = [(k, hour, minute, gauge) for k in range(3) for hour in range(4) for minute in (5, 40) for gauge in ("north", "south")[: 1 + hour % 2]]
    with Engine(spark, config(tmp_path)) as e:
        for k in range(3):  # the same times and gauges three times, with other values
            e.append("trades", rows(spark, [(T13 + hour * HOUR + minute * 60_000_000, gauge, "m", 100 * k) for n, hour, minute, gauge in readings if n == k]), NOW)
        done = e.flush()
        each = len(readings) // 3
        assert (done.rows, done.deduplicated, done.files) == (each, 2 * each, 4)
        assert {p.rsplit("/", 1)[1] for p in published(e)} == {store.output_name(1, 3, 0)} and len(published(e)) == 4
        assert {r["size"] for r in e.table("trades").select("size").collect()} == {0}  # the first to arrive
        # A later flush is not compared with earlier ones; its rows go to their old hours as other files.
        e.append("trades", rows(spark, [(T13 + 5 * 60_000_000, "north", "m", 7), (T13 + 3 * HOUR, "late", "m", 7)]), NOW)
        done = e.flush()
        assert (done.rows, done.deduplicated, done.files) == (2, 0, 2) and len(published(e)) == 6
        assert e.table("trades").filter("id = 'north' and minute(ts) = 5 and hour(ts) = 13").count() == 2


def test_only_microseconds_are_taken(spark, tmp_path):
    with Engine(spark, config(tmp_path)) as e:
        for ts in (T13 // 1_000_000, T13 // 1000, T13 * 1000):
            with pytest.raises(TsOutOfRange):
                e.append("trades", rows(spark, [(ts, "x", "A", 1)]), NOW)
        assert e.append("trades", rows(spark, [(T13, "x", "A", 1)]), NOW) == 1
        assert e.stats()["rejected_ts"] == 3 and e.stats()["appended"] == 1 and e.stats()["pending_segments"] == 1


def test_faults_of_typed_appends(spark, tmp_path):
    with Engine(spark, config(tmp_path)) as e:
        with pytest.raises(UnknownSeries):
            e.append("none", rows(spark, []), NOW)
        with pytest.raises(KeyArity):
            e.append("trades", rows(spark, [(T13, "x", "A", 1)]).drop("size"), NOW)
        with pytest.raises(TypeMismatch):
            e.append("trades", rows(spark, [(T13, "x", "A", 1)]).withColumn("size", F.lit("1")), NOW)
        with pytest.raises(TypeMismatch, match="symbol"):
            e.append("trades", rows(spark, [(T13, "x", "A", 1), (T13, "y", None, 1)]), NOW)
        with pytest.raises(RecordTooLarge):
            e.append("trades", rows(spark, [(T13, "x" * 20_000, "A", 1)]), NOW)
        with pytest.raises(FieldTooLong):
            e.append("trades", rows(spark, [(T13, "x" * 70_000, "A", 1)]), NOW)
        with pytest.raises(TsOutOfRange):  # three times and a type: one fault is raised, and counted
            e.append("trades", rows(spark, [(1, "a", "A", 1), (2, "b", "A", 1), (3, "c", "A", 1), (T13, "d", None, 1)]), NOW)
        assert (e.counts.rejected_ts, e.counts.rejected_size, e.counts.appended) == (1, 1, 0)
        assert e.append("trades", rows(spark, []), NOW) == 0 and not store.segments(e.files)


def test_the_key_at_fault_is_named(spark, tmp_path):
    with Engine(spark, config(tmp_path, SeriesSpec("s", (KeyDef("one", "i64"), KeyDef("two", "i64"), KeyDef("three", "i64", True))))) as e:
        df = spark.createDataFrame([(T13, 1, 2, None), (T13, 1, None, 3)], "ts_us long, one long, two long, three long")
        with pytest.raises(TypeMismatch, match="'two'"):
            e.append("s", df, NOW)


def raw(e, spark, data):
    from tidelake.model import RECORD

    value = lambda tag, **v: {"tag": tag, "b": None, "i": None, "f": None, "s": None} | v
    return spark.createDataFrame([(s, ep, ts, i, [value(**k) for k in keys], [], "") for s, ep, ts, i, keys in data], RECORD).coalesce(1)


def test_bad_records_do_not_fail_a_flush(spark, tmp_path):
    sym, null, num = {"tag": 4, "s": "A"}, {"tag": 0}, {"tag": 2, "i": 5}
    with Engine(spark, config(tmp_path)) as e:
        done = e.append_raw(raw(e, spark, [("trades", 0, T13, "good", [sym, num]), ("trades", 0, T13, "typed", [num, num]), ("trades", 0, T13, "null", [null, null]), ("trades", 9, T13, "epoch", []), ("none", 0, T13, "series", []), ("trades", 0, 5, "ts", [sym, num])]), NOW)
        assert (done.accepted, done.rejected) == (3, 3)
        assert (e.counts.rejected_ts, e.counts.rejected_series, e.counts.rejected_frames) == (1, 2, 3)
        done = e.flush()
        assert (done.rows, done.rejected) == (2, 1)  # a null passes for a key that is not nullable
        kept = spark.read.parquet(e.files.path("rejects"))
        assert [r["reason"] for r in kept.select("reason").collect()] == ["type"]
        e.append_raw(raw(e, spark, [("trades", 0, T13, "typed", [num, num])]), NOW)
        done = e.flush()
        assert done.committed and (done.rows, done.rejected) == (0, 1)


def test_raw_records_over_the_limit_are_rejected(spark, tmp_path):
    key = [{"tag": 4, "s": "A"}, {"tag": 2, "i": 5}]
    with Engine(spark, config(tmp_path)) as e:
        done = e.append_raw(raw(e, spark, [("trades", 0, T13, "x" * 20_000, key), ("trades", 0, T13, "good", key)]), NOW)
        assert (done.accepted, done.rejected) == (1, 1)
        assert (e.counts.rejected_ts, e.counts.rejected_size, e.counts.rejected_series, e.counts.rejected_frames) == (0, 1, 0, 1)
        assert e.flush().rows == 1


def test_reject_cap(spark, tmp_path):
    c = config(tmp_path)
    c.limits.reject_max_bytes = 0
    with Engine(spark, c) as e:
        e.append_raw(raw(e, spark, [("trades", 0, T13, "typed", [])]), NOW)
        assert e.flush().rejected == 1 and not e.files.exists("rejects")


def test_rejects_stay_below_their_cap(spark, tmp_path):
    c = config(tmp_path)
    c.limits.reject_max_bytes = 100
    with Engine(spark, c) as e:
        e.append_raw(raw(e, spark, [("trades", 0, T13, f"bad{i}", []) for i in range(50)]), NOW)
        assert e.flush().rejected == 50 and spark.read.parquet(e.files.path("rejects")).count() == 100 // (8 + 22 + len("trades") + len("bad10"))


def test_rejects_and_views_are_best_effort(spark, tmp_path):
    with Engine(spark, config(tmp_path)) as e:
        e.files.write("in the way", "rejects")
        e.files.mkdirs("series", "trades", "view.sql", "in the way")
        e.append_raw(raw(e, spark, [("trades", 0, T13, "bad", []), ("trades", 0, T13, "good", [{"tag": 4, "s": "A"}, {"tag": 0}])]), NOW)
        done = e.flush()
        assert done.committed and (done.rows, done.rejected, e.counts.flush_failures) == (1, 1, 0)


def test_frames_of_clients(spark, tmp_path):
    from tidelake.sources import encode_frame

    frame = lambda ts, id_, keys, epoch=0, series="trades": encode_frame(ts, epoch, series, id_, keys, [("k", "v")], "d")
    good = [frame(T13 + i, f"i{i}", ["A", i]) for i in range(4)]
    broken = bytearray(frame(T13, "broken", ["A", 1]))
    broken[12] ^= 1
    inbox = tmp_path / "inbox"
    inbox.mkdir()
    (inbox / "a.bin").write_bytes(b"".join(good[:2]) + frame(5, "old", ["A", 1]) + frame(T13, "x", ["A", 1], 3) + frame(T13, "y", [], 0, "none"))
    (inbox / "b.bin").write_bytes(good[2] + bytes(broken) + good[3])
    (inbox / "c.bin").write_bytes(frame(T13, "z" * 17_000, ["A", 1]))
    (inbox / "d.bin").write_bytes(good[3][:30])
    with Engine(spark, config(tmp_path / "lake")) as e:
        done = e.append_frames(str(inbox), NOW, source="client-1")
        lost = len(broken) + len(good[3]) + len(frame(T13, "z" * 17_000, ["A", 1])) + 30
        assert (done.accepted, done.rejected, done.discarded_bytes) == (3, 6, lost)
        assert (e.counts.rejected_ts, e.counts.rejected_series, e.counts.rejected_frames) == (1, 2, 6)
        assert e.append_frames(str(inbox), NOW, source="client-1").accepted == 0
        assert e.flush().rows == 3 and e.table("trades").filter("extra['k'] = 'v' and data = 'd'").count() == 3


def test_failures_are_counted_until_a_flush_succeeds(spark, tmp_path, monkeypatch):
    with Engine(spark, config(tmp_path)) as e:
        e.append("trades", rows(spark, [(T13, "a", "A", 1)]), NOW)
        with monkeypatch.context() as m:
            m.setattr(store, "stage", lambda *_: 1 / 0)
            for _ in range(2):
                with pytest.raises(ZeroDivisionError):
                    e.flush()
        assert e.stats()["flush_failures"] == 2 and e.stats()["segment"] == 2
        assert e.flush().rows == 1 and e.stats()["flush_failures"] == 0


def test_appends_do_not_wait_for_a_flush(spark, tmp_path, monkeypatch):
    import threading

    reached, go_on, stage = threading.Event(), threading.Event(), store.stage
    with Engine(spark, config(tmp_path)) as e:
        e.append("trades", rows(spark, [(T13, "a", "A", 1)]), NOW)
        monkeypatch.setattr(store, "stage", lambda *a: reached.set() or go_on.wait(60) and stage(*a))
        flush = threading.Thread(target=e.flush)
        flush.start()
        assert reached.wait(60)
        assert e.append("trades", rows(spark, [(T13, "b", "A", 1)]), NOW) == 1 and flush.is_alive()
        go_on.set()
        flush.join(60)
        assert e.table("trades").count() == 1 and e.flush().rows == 1


def test_an_engine_that_lost_its_lock_commits_nothing(spark, tmp_path):
    with Engine(spark, config(tmp_path)) as e:
        e.append("trades", rows(spark, [(T13, "a", "A", 1)]), NOW)
        other = store.Lock(e.files, force=True)
        with pytest.raises(Locked):
            e.flush()
        assert e.manifest.load(e.files).last_flushed_segment == 0 and not published(e)
        other.release()


def test_only_one_of_many_takes_the_lock(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    from tidelake.files import Files

    files = Files(spark, str(tmp_path))

    def take(_):
        try:
            return store.Lock(files)
        except Locked:
            return None

    with ThreadPoolExecutor(8) as pool:
        held = [x for x in pool.map(take, range(8)) if x]
    assert len(held) == 1
    held[0].release()


def test_flush_at_the_start_if_one_is_overdue(spark, tmp_path):
    c = config(tmp_path)
    with Engine(spark, c) as e:
        e.append("trades", rows(spark, [(T13, "a", "A", 1)]), NOW)
    c.flush.on_startup = True
    with Engine(spark, c) as e:
        assert e.counts.rows_flushed == 1 and e.table("trades").count() == 1
        e.append("trades", rows(spark, [(T13, "b", "A", 1)]), NOW)
    with Engine(spark, c) as e:  # the last flush is not an interval ago
        assert e.counts.flushes == 0 and len(store.segments(e.files)) == 1


def test_names_of_landed_batches_are_kept_once_each(spark, tmp_path):
    key = [{"tag": 4, "s": "A"}, {"tag": 2, "i": 5}]
    with Engine(spark, config(tmp_path)) as e:
        for k in range(4):
            for name in ("x", "y"):
                assert e.append_raw(raw(e, spark, [("trades", 0, T13 + k, name, key)]), NOW, f"{name}-{k}").accepted == 1
            if k % 2:
                e.flush()
        e.append_raw(raw(e, spark, [("trades", 0, T13, "z", key)]), NOW, "once")
        assert e.files.names("sources") == ["x-3", "y-3"]
    with Engine(spark, config(tmp_path)) as e:
        assert [s in e.sources for s in ("x-0", "x-3", "x-4", "y-2", "once", "z-0")] == [True, True, False, True, True, False]


def test_schema_epochs_and_views(spark, tmp_path):
    keys = lambda *k: SeriesSpec("trades", k)
    symbol, venue = KeyDef("symbol", "string", True), KeyDef("venue", "i64", True)
    with Engine(spark, config(tmp_path, keys(symbol))) as e:
        e.append("trades", spark.createDataFrame([(T13, "a", "S", {"venue": "7"}), (T13 + 1, "b", "S", {"venue": "x"})], "ts_us long, id string, symbol string, extra map<string,string>"), NOW)
        e.flush()
    with Engine(spark, config(tmp_path, keys(symbol, venue))) as e:
        assert e.manifest.current("trades").epoch == 1
        e.append("trades", spark.createDataFrame([(T13, "a", "S", 8), (T13 + HOUR, "c", "S", 9)], "ts_us long, id string, symbol string, venue long"), NOW)
        e.flush()
        found = {(r["id"], r["venue"]) for r in e.table("trades").collect()}
        assert found == {("a", 7), ("b", None), ("a", 8), ("c", 9)}
        assert {r["id"] for r in e.scan("trades", T13 + HOUR, None).collect()} == {"c"}
        plan = e.scan("trades", T13 + HOUR, None)._jdf.queryExecution().toString()
        assert "PartitionFilters: [isnotnull(hour" in plan
        sql = e.files.read("series/trades/view.sql").replace("series/trades/**", f"{tmp_path}/series/trades/**")
        db = duckdb.connect()
        db.execute(sql)
        assert set(db.sql("select id, venue from trades").fetchall()) == found
    with Engine(spark, config(tmp_path, keys(symbol))) as e:  # back to the old layout: a new epoch
        assert e.manifest.current("trades").epoch == 2
    with pytest.raises(ManifestError):
        Engine(spark, config(tmp_path, keys(KeyDef("venue", "string"))))
    with Engine(spark, config(tmp_path, keys(KeyDef("symbol", "string", False)))) as e:  # nullable alone
        assert e.manifest.current("trades").epoch == 2


def test_crashes(spark, tmp_path):
    with Engine(spark, config(tmp_path)) as e:
        e.append("trades", rows(spark, [(T13, "a", "A", 1), (T13 + HOUR, "b", "A", 1)]), NOW)
        e.flush()
        one = published(e)[0]
        name = one.rsplit("/", 1)[1]
        hour = one.split("hour=")[1].split("/")[0]
        staged = f"tmp/trades/{name.removesuffix('.parquet')}/hour={hour}"
        e.files.mkdirs(staged)
        e.files.rename(one, f"{staged}/part-0.parquet")  # as if a publish had not been reached
        e.files.write("x", f"series/trades/hour={hour}/0000000002-0000000002.e0.parquet")  # as if a commit had not
        e.files.write("x", f"series/trades/hour={hour}/stranger.parquet.keep")
        e.files.mkdirs("wal/_tmp-1")
    with Engine(spark, config(tmp_path)) as e:
        assert e.files.exists(one) and len(published(e)) == 2 and e.files.exists(f"series/trades/hour={hour}/stranger.parquet.keep")
        assert e.table("trades").count() == 2 and e.next_segment == 2 and not e.files.names("wal")
        e.append("trades", rows(spark, [(T13, "c", "A", 1)]), NOW)
        e.files.write("no parquet", "wal/seg=0000000003/series=trades/epoch=0/part-0.parquet")
        assert e.flush().rows == 1 and "seg=0000000003.corrupt" in e.files.names("wal")
    (tmp_path / "manifest.json").unlink()
    with pytest.raises(ManifestError):
        Engine(spark, config(tmp_path))
    assert len([p for p in tmp_path.rglob("*.e0.parquet")]) == 3


def test_a_failed_publish_is_made_up_for(spark, tmp_path):
    with Engine(spark, config(tmp_path)) as e:
        e.append("trades", rows(spark, [(T13, "a", "A", 1), (T13 + HOUR, "b", "A", 1)]), NOW)
        blocked = "series/trades/hour=2026-08-08T14"
        e.files.write("in the way", blocked)
        with pytest.raises(Exception):  # noqa: B017
            e.flush()
        e.files.delete(blocked)
        e.append("trades", rows(spark, [(T13, "c", "A", 1)]), NOW)
        e.flush()
        assert sorted(r["id"] for r in e.table("trades").collect()) == ["a", "b", "c"]


def test_lock(spark, tmp_path):
    with Engine(spark, config(tmp_path)):
        with pytest.raises(Locked):
            Engine(spark, config(tmp_path))
        Engine(spark, config(tmp_path), force_unlock=True).close()
    Engine(spark, config(tmp_path)).close()


def test_control(spark, tmp_path):
    e = Engine(spark, config(tmp_path))
    assert e.control("ping")["status"] == "pong" and e.control("flush")["committed"] is False
    assert e.control("schema")["series"][0]["epoch"] == 0 and e.control("stats")["pending_segments"] == 0
    assert e.control("reload-config")["status"] == "error" and e.control("shutdown")["status"] == "shutting-down"


@pytest.mark.parametrize("partitions,aqe", [(1, "false"), (32, "true")])
def test_output_does_not_depend_on_partitions(spark, tmp_path, partitions, aqe):
    data = [(T13 + (i * 37 % 97) * 60_000_000, f"i{i % 11}", "A", i) for i in range(300)]
    old = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.enabled")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        spark.conf.set("spark.sql.adaptive.enabled", aqe)
        with Engine(spark, config(tmp_path)) as e:
            for k in range(3):
                e.append("trades", rows(spark, data[k::3]), NOW)
            e.flush()
            best = {}
            for k in range(3):
                for ts, i, s, n in data[k::3]:
                    best.setdefault((ts, i), n)
            got = {(r["us"], r["id"]): r["size"] for r in e.table("trades").withColumn("us", F.unix_micros("ts")).collect()}
            assert got == best
            for p in published(e):
                file = spark.read.parquet(e.files.path(p)).select(F.unix_micros("ts"), "id").collect()
                assert [tuple(r) for r in file] == sorted(tuple(r) for r in file)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old[0])
        spark.conf.set("spark.sql.adaptive.enabled", old[1])


def test_a_hot_hour_is_sorted_by_several_tasks(spark, tmp_path):
    with Engine(spark, config(tmp_path), rows_per_task=50) as e:
        for k in range(2):
            e.append("trades", rows(spark, [(T13 + i % 150, f"{i % 3}", "A", k) for i in range(300)] + [(T13 + HOUR, "late", "A", k)]), NOW)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        done = e.flush()
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        names = [p.rsplit("/", 1)[1] for p in published(e)]
        assert (done.rows, done.deduplicated) == (151, 451) and "0000000001-0000000002.e0.parquet" in names and "0000000001-0000000002.e0-1.parquet" in names
        assert e.table("trades").filter("size = 1").count() == 0
        for p in published(e):
            file = [tuple(r) for r in spark.read.parquet(e.files.path(p)).select(F.unix_micros("ts"), "id").collect()]
            assert file == sorted(file)


def test_an_hour_of_many_bytes_is_sorted_by_several_tasks(spark, tmp_path):
    with Engine(spark, config(tmp_path), bytes_per_task=20_000) as e:
        e.append("trades", rows(spark, [(T13 + i, f"{i}", "A", i) for i in range(40)]).withColumn("data", F.repeat(F.lit("x"), F.lit(2000))), NOW)
        e.append("trades", rows(spark, [(T13 + HOUR + i, f"{i}", "A", i) for i in range(40)]), NOW)
        done = e.flush()
        hours = [p.rsplit("/", 2)[1] for p in published(e)]
        assert done.rows == 80 and sorted(map(hours.count, set(hours)))[0] == 1 and max(map(hours.count, set(hours))) > 1
        assert e.table("trades").select("id", "ts").distinct().count() == 80


def test_file_layout(spark, tmp_path):
    import pyarrow.parquet as pq

    with Engine(spark, config(tmp_path, row_group_rows=3)) as e:
        e.append("trades", rows(spark, [(T13 + i, f"{i}", "A", i) for i in range(10)]), NOW)
        e.flush()
        file = pq.ParquetFile(f"{tmp_path}/{published(e)[0]}")
        assert [file.metadata.row_group(i).num_rows for i in range(file.num_row_groups)] == [3, 3, 3, 1]
        columns = {file.metadata.row_group(0).column(i).path_in_schema: file.metadata.row_group(0).column(i) for i in range(file.metadata.num_columns)}
        assert list(columns) == ["ts", "id", "symbol", "size", "extra.key_value.key", "extra.key_value.value", "data"]
        assert "DELTA_BINARY_PACKED" in columns["ts"].encodings and not any("DICTIONARY" in x for x in columns["id"].encodings)
        assert columns["data"].statistics is None or not columns["data"].statistics.has_min_max
        assert columns["ts"].compression == "LZ4"
        kept = json.loads(file.metadata.metadata[b"org.apache.spark.sql.parquet.row.metadata"])
        assert kept["fields"][0]["metadata"] == {"series": "trades", "epoch": 0}
        schema = file.schema
        assert schema.column(0).max_definition_level == 0 and schema.column(2).max_definition_level == 1


def test_stream_equals_batch_and_lands_once(spark, tmp_path):
    inbox, e = tmp_path / "inbox", Engine(spark, config(tmp_path / "lake"))
    lines = [json.dumps({"ts": T13 + i % 7, "id": f"{i % 5}", "keys": ["A", i], "extra": {"k": "v"}}) for i in range(40)]
    inbox.mkdir()
    for k in range(2):
        (inbox / f"{k}.txt").write_text("\n".join(lines[k * 20 : k * 20 + 20]))
    stream, _ = parse_lines(spark.readStream.text(str(inbox)), "trades", 0)
    q = ingest_stream(e, stream, str(tmp_path / "cp"), now_us=NOW)
    q.awaitTermination(120)
    assert e.counts.appended == 40
    again = parse_lines(spark.createDataFrame([(x,) for x in lines], "value string"), "trades", 0)[0]
    (landed,) = e.sources.numbers
    assert e.append_raw(again, NOW, source=f"{landed}-0").accepted == 0
    e.flush()
    assert e.append_raw(again, NOW, source=f"{landed}-0").accepted == 0
    assert e.table("trades").count() == len({(i % 7, i % 5) for i in range(40)})
    e.close()


def test_timer_and_drain(spark, tmp_path):
    import time

    from tidelake.streaming import drain

    inbox = tmp_path / "inbox"
    inbox.mkdir()
    (inbox / "0.txt").write_text(json.dumps({"ts": T13, "id": "a", "keys": ["A", 1]}))
    with Engine(spark, config(tmp_path / "lake", interval_ms=1500)) as e:
        stream, _ = parse_lines(spark.readStream.option("maxFilesPerTrigger", 1).text(str(inbox)), "trades", 0)
        assert drain(ingest_stream(e, stream, str(tmp_path / "cp"), "drained", interval="1 second", now_us=NOW), 60)
        assert e.counts.appended == 1
        until = time.time() + 60
        while not e.counts.flushes and time.time() < until:
            time.sleep(0.2)
        assert e.table("trades").count() == 1

"""Config, times, manifest, codec, lines of JSON and validation."""

import calendar
import json
import random
import struct
import zlib
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidelake import store
from tidelake.config import BATCH_HEADER, MAX_INTERVAL_MS, SEGMENT_HEADER, Config
from tidelake.errors import ConfigError, ManifestError
from tidelake.files import Files
from tidelake.functions.records import canonical_extra, encoded_size, value_of
from tidelake.manifest import Manifest
from tidelake.model import RESERVED, KeyDef, SeriesSpec, union_keys
from tidelake.operators.validate import WINDOW
from tidelake.plans.view import from_text, view_sql
from tidelake.sources import decode_frames, encode_frame, parse_lines, read_frames
from tidelake.timeutil import days_to_ymd, format_rfc3339, hour_partition, parse_rfc3339, ymd_to_days

T13 = 1_786_194_000_000_000

#: The smallest value that each number of a configuration may have.
SMALLEST = {
    ("limits", "max_record_bytes"): 1, ("limits", "ts_max_skew_ms"): 0, ("limits", "reject_max_bytes"): 0, ("flush", "merge_fan_in"): 2, ("flush", "memory_budget_bytes"): 1, ("flush", "row_group_rows"): 1,
    ("flush", "interval_ms"): 0, ("wal", "fsync_interval_ms"): 1, ("wal", "fsync_bytes"): 1,
}


def refused(**document):
    with pytest.raises(ConfigError):
        Config.parse(json.dumps(document))


@pytest.mark.parametrize(("section", "field"), SMALLEST)
def test_numbers_have_a_smallest_value(section, field):
    least = SMALLEST[section, field]
    Config.parse(json.dumps({section: {field: least}}))
    refused(**{section: {field: least - 1}})
    for kind in (str(least), float(least), None, True, [least]):
        refused(**{section: {field: kind}})


def test_buffers_hold_the_largest_record():
    for section, field, header in (("wal", "segment_max_bytes", SEGMENT_HEADER), ("server", "max_batch_bytes", BATCH_HEADER)):
        for record in (700, 90_001):
            Config.parse(json.dumps({section: {field: record + header}, "limits": {"max_record_bytes": record}}))
            refused(**{section: {field: record + header - 1}, "limits": {"max_record_bytes": record}})
    Config.parse(json.dumps({"flush": {"interval_ms": MAX_INTERVAL_MS}}))
    refused(flush={"interval_ms": MAX_INTERVAL_MS + 1})


def test_names_that_cannot_be_used():
    key = {"name": "depth", "type": "bool"}
    series = lambda *names, keys=(key,): {"series": [{"name": n, "keys": list(keys)} for n in names]}
    Config.parse(json.dumps(series("tide gauge", "Über-Pegel", "...", "pegel 2")))
    for names in (["", "x"], ["."], [".."], ["a/b"], ["a\\b"], ["tab\there"], ["nul\x00"], ["ü" * 40_000], ["pegel", "PEGEL"], ["pegel", "pegel"]):
        refused(**series(*names))
    refused(**series("p", keys=[key, key]))
    for wrong in ({"name": ""}, {"type": "decimal"}, {"type": None}, {"name": 7}, {"nullable": "no"}, {"unit": "m"}):
        refused(**series("p", keys=[key | wrong]))
    for missing in key:
        refused(**series("p", keys=[{k: v for k, v in key.items() if k != missing}]))


def test_fields_and_values_that_are_not_known():
    for section in ("server", "limits", "wal", "flush"):
        refused(**{section: {"surplus": 1}})
        refused(**{section: []})
    refused(surplus={})
    refused(flush={"compression": "lzma"})
    refused(flush={"on_startup": "yes"})
    refused(limits={"ts_min": "noon"})
    for text in ("[1]", "3", "{", ""):
        with pytest.raises(ConfigError):
            Config.parse(text)


def test_good_configs(tmp_path):
    c = Config.parse('{"series":[{"name":"s","keys":[{"name":"k","type":"f64","nullable":true}]}],"flush":{"compression":"none","interval_ms":0}}')
    assert c.series[0].keys[0] == KeyDef("k", "f64", True) and c.limits.max_record_bytes == 16_384 and c.limits.ts_min_us == 946_684_800_000_000
    for name in RESERVED:
        with pytest.raises(ConfigError):
            Config.parse(json.dumps({"series": [{"name": "s", "keys": [{"name": name, "type": "i64"}]}]}))
    with pytest.raises(ConfigError):
        Config.load(str(tmp_path / "none.json"))


def test_times():
    rng = random.Random(0)
    for _ in range(300):
        days = rng.randrange(0, 90_000_000)
        assert ymd_to_days(*days_to_ymd(days)) == days
        us = days * 86_400_000_000 + rng.randrange(86_400_000_000)
        assert parse_rfc3339(format_rfc3339(us)) == us
    for _ in range(300):  # the standard library knows the years up to 9999
        us = rng.randrange(253_402_300_800_000_000)
        text = (datetime(1970, 1, 1) + timedelta(microseconds=us)).isoformat(timespec="microseconds") + "Z"
        assert format_rfc3339(us) == text and parse_rfc3339(text) == us and hour_partition(us) == text[:13]


def test_times_that_are_none():
    parts = {"year": ("2031", ["1969", "0000", "999", "250001"]), "month": ("07", ["00", "13", "7"]), "day": ("15", ["00", "32", "5"]), "hour": ("06", ["24", "6"]), "minute": ("41", ["60", "4"]), "second": ("09", ["60", "61", "9"]), "end": ("Z", ["", "z", "+00:00", ".Z", ".1234567Z", " Z"])}
    write = lambda p: f"{p['year']}-{p['month']}-{p['day']}T{p['hour']}:{p['minute']}:{p['second']}{p['end']}"
    good = {k: v[0] for k, v in parts.items()}
    assert parse_rfc3339(write(good)) == 1_941_864_069_000_000 + 0 * len(good)
    for name, (_, wrong) in parts.items():
        for value in wrong:
            with pytest.raises(ConfigError):
                parse_rfc3339(write(good | {name: value}))
    for year in range(2019, 2105, 5):
        for month in range(1, 13):
            last = calendar.monthrange(year, month)[1]
            parse_rfc3339(f"{year}-{month:02}-{last}T00:00:00Z")
            with pytest.raises(ConfigError):
                parse_rfc3339(f"{year}-{month:02}-{last + 1}T00:00:00Z")


def test_window_is_open_above_while_the_clock_is_not_set():
    assert WINDOW.at(5, 10, 1) == WINDOW(10, None) and WINDOW.at(10, 10, 1) == WINDOW(10, 1010)


def test_epochs(spark, tmp_path):
    a, b = KeyDef("a", "i64"), KeyDef("b", "string", True)
    m = Manifest()
    assert m.reconcile([SeriesSpec("s", (a,))]) and not m.reconcile([SeriesSpec("s", (a,))])
    assert m.reconcile([SeriesSpec("s", (a, b))]) and m.reconcile([SeriesSpec("s", (b, a))]) and m.reconcile([SeriesSpec("s", (a,))])
    assert [e.epoch for e in m.series["s"]] == [0, 1, 2, 3]
    assert m.reconcile([SeriesSpec("s", (KeyDef("a", "i64", True),))]) and m.current("s").epoch == 3
    with pytest.raises(ManifestError):  # two epochs back, and nothing else is adopted
        m.reconcile([SeriesSpec("new", ()), SeriesSpec("s", (KeyDef("b", "i64"),))])
    assert "new" not in m.series and not m.reconcile([])
    files = Files(spark, str(tmp_path))
    assert Manifest.load(files) is None
    m.last_flushed_segment = 7
    m.commit(files)
    m.commit(files)
    assert Manifest.load(files) == m and files.names() == ["manifest.json"]
    raw = json.loads(files.read("manifest.json")) | {"later": 1}
    files.replace("manifest.json", json.dumps(raw))
    assert Manifest.load(files) == m
    files.replace("manifest.json", json.dumps(raw | {"format": 2}))
    with pytest.raises(ManifestError):
        Manifest.load(files)
    keys, everywhere = union_keys(m.series["s"])
    assert [k.name for k in keys] == ["a", "b"] and everywhere == {"a"}


def test_names():
    assert store.segment_name(7) == "seg=0000000007" and store.parse_segment("seg=0000000007") == 7
    assert [store.parse_segment(n) for n in ("seg=7", "seg=00000000007", "seg=12345678901", "seg=0000000007.corrupt", "x")] == [None, None, 12345678901, None, None]
    assert store.output_name(1, 2, 3) == "0000000001-0000000002.e3.parquet" and store.output_name(1, 2, 3, 4) == "0000000001-0000000002.e3-4.parquet"
    assert [store.classify(n, 5) for n in ("0000000001-0000000005.e0.parquet", "0000000001-0000000006.e0.parquet", "part-0.parquet", "1-5.e0.parquet")] == ["committed", "uncommitted", "foreign", "foreign"]


FRAME = (T13, 1, "trades", "é1", ["A", 5, -0.0, True, None], [("z", "9"), ("k", "1"), ("z", "8")], "payload")


def test_frames_round_trip(spark, tmp_path):
    frame = encode_frame(*FRAME)
    row = next(decode_frames(frame, {("trades", 1): 5}, 1 << 14))
    assert row["fault"] is None and row["extra"] == [{"k": "k", "v": "1"}, {"k": "z", "v": "8"}] and row["data"] == "payload" and row["id"] == "é1"
    assert [v["tag"] for v in row["keys"]] == [4, 2, 3, 1, 0] and struct.pack("<d", row["keys"][2]["f"]) == struct.pack("<d", -0.0)
    value = lambda x, t: value_of(F.lit(x).cast({"string": "string", "i64": "bigint", "f64": "double", "bool": "boolean"}[t]), t)
    pairs = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(v).alias("v")) for k, v in FRAME[5]])
    one = spark.range(1).select(F.lit("trades").alias("series"), F.lit("é1").alias("id"), F.array(value("A", "string"), value(5, "i64"), value(-0.0, "f64"), value(True, "bool"), value(None, "string")).alias("keys"), pairs.alias("extra"), F.lit("payload").alias("data"))
    assert one.select(encoded_size().alias("n")).first()["n"] == len(frame)
    (tmp_path / "a.bin").write_bytes(b"x" * 14 + frame * 3)
    got = read_frames(spark, str(tmp_path), {("trades", 1): 5}, header=14).collect()
    assert [r["off"] for r in got] == [14, 14 + len(frame), 14 + 2 * len(frame)] and all(r["fault"] is None for r in got)


def test_every_flip_and_cut_of_a_frame_is_found():
    frame = encode_frame(*FRAME)
    arity = {("trades", 1): 5}
    for i in range(len(frame)):
        rows = list(decode_frames(frame[:i], arity, 1 << 14))
        assert i == 0 or rows[-1]["fault"].startswith("truncated")
        for bit in range(8):
            bad = bytearray(frame)
            bad[i] ^= 1 << bit
            assert next(decode_frames(bytes(bad), arity, 1 << 14))["fault"]
    poison = bytearray(frame)
    poison[20] ^= 1
    rows = list(decode_frames(frame + bytes(poison) + frame, arity, 1 << 14))
    assert [r["fault"] for r in rows] == [None, "corrupt: checksum", None]
    assert list(decode_frames(frame, {}, 1 << 14))[0]["fault"] == "unknown schema"
    assert list(decode_frames(frame, {("trades", 1): 4}, 1 << 14))[0]["fault"].startswith("corrupt")
    assert zlib.crc32(b"123456789") == 0xCBF43926


def test_lines(spark):
    lines = ['{"ts": %d, "id": "a", "keys": ["x", 1, 1.5, true, null, 99999999999999999999], "extra": {"k": "v"}, "data": "d", "more": 1}' % T13, "", "  ", "not json", '{"id": "b"}', '{"ts": 1.5}', '{"ts": 5, "keys": [[1]]}', '{"ts": 5, "keys": [{"a": 1}]}', '{"ts": 5}']
    good, bad = parse_lines(spark.createDataFrame([(x,) for x in lines], "value string"), "s", 3)
    rows = {r["ts_us"]: r for r in good.collect()}
    assert sorted(rows) == [5, T13] and [v["tag"] for v in rows[T13]["keys"]] == [4, 2, 3, 1, 0, 3] and rows[5]["keys"] == [] and rows[5]["id"] == "" and rows[T13]["epoch"] == 3
    assert sorted(r["reason"] for r in bad.collect()) == ["json", "keys", "keys", "ts", "ts"]


def test_canonical_extra(spark):
    df = spark.createDataFrame([([("z", "9"), ("k", "1"), ("z", "8")],), ([],), ([("k", "")],), (None,)], "e array<struct<k:string,v:string>>")
    assert [r[0] for r in df.select(canonical_extra("e")).collect()] == [{"k": "1", "z": "8"}, {}, {"k": ""}, {}]


def test_text_to_types(spark):
    df = spark.createDataFrame([("7",), ("1.5d",), ("1e3",), ("x",), ("",), (None,), ("9223372036854775808",)], "t string")
    assert [r[0] for r in df.select(from_text(F.col("t"), "i64")).collect()] == [7, None, None, None, None, None, None]
    assert [r[0] for r in df.select(from_text(F.col("t"), "f64")).collect()] == [7.0, None, 1000.0, None, None, None, 9223372036854775808.0]


def test_view_text_is_quoted():
    from tidelake.model import EpochSchema

    sql = view_sql("o'x", [EpochSchema(0, ()), EpochSchema(1, (KeyDef('a"b', "bool"),))])
    assert '"a""b"' in sql and "AS BOOLEAN" in sql and "'series/o''x/**/*.parquet'" in sql


def test_cli(spark, tmp_path, capsys):
    from tidelake.__main__ import main

    (tmp_path / "c.json").write_text(json.dumps({"series": [{"name": "s", "keys": [{"name": "k", "type": "i64"}]}], "flush": {"on_startup": False}}))
    (tmp_path / "lines").write_text('{"ts": 1700000000000000, "keys": [1]}\nbad\n')
    base = ["--config", str(tmp_path / "c.json"), "--data", str(tmp_path / "lake")]
    assert main([*base, "send", "s", str(tmp_path / "lines")]) == 0
    assert json.loads(capsys.readouterr().out) == {"status": "sent", "accepted": 1, "rejected": 0, "unreadable": 1}
    assert main([*base, "flush"]) == 0 and json.loads(capsys.readouterr().out)["rows"] == 1
    assert main([*base, "schema"]) == 0 and json.loads(capsys.readouterr().out)["series"][0]["name"] == "s"
    assert main([*base, "send", "none", "x"]) == 1


def test_a_cluster_must_name_a_shared_folder(spark):
    from types import SimpleNamespace

    from tidelake.files import shared_folder

    assert shared_folder(spark) == spark.sparkContext.getConf().get("spark.checkpoint.dir")
    bare = lambda master: SimpleNamespace(sparkContext=SimpleNamespace(master=master, getConf=dict))
    assert shared_folder(bare("local[2]"))
    for master in ("spark://one:7077", "yarn", "k8s://x"):
        with pytest.raises(ValueError, match="checkpoint"):
            shared_folder(bare(master))


def test_values_as_text(spark):
    from tidelake.functions.records import text_of

    values = {1.0: "1", -2.5: "-2.5", 0.1: "0.1", 1e14: "100000000000000", 1e21: "1000000000000000000000", 1.5e-7: "0.00000015", float("inf"): "inf", -0.0: "-0", 123456789.25: "123456789.25"}
    rows = spark.createDataFrame([(v,) for v in values] + [(None,)], "f double").select("f", text_of("f", "f64").alias("t")).collect()
    assert {repr(r["f"]): r["t"] for r in rows} == {repr(k): v for k, v in values.items()} | {"None": None}
    assert spark.range(1).select(text_of(F.lit(True), "bool").alias("b"), text_of(F.lit(7), "i64").alias("i")).first() == ("true", "7")

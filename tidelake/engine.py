"""The engine: appends land as batches, flushes turn them into sorted, deduplicated Parquet by hour."""

from __future__ import annotations

import json
import logging
import threading
import time
import uuid
from collections.abc import Iterable
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from . import __version__, store
from .config import COMPRESSION, Config
from .errors import FieldTooLong, KeyArity, LakeError, RecordTooLarge, TsOutOfRange, TypeMismatch, UnknownSeries
from .files import Files
from .functions.records import encoded_size, micros, value_of
from .manifest import Manifest
from .model import KEY_TYPES, LANDED, RECORD, SeriesSpec
from .operators.flush import flush_counts, landed_groups, sort_for_storage, to_storage
from .operators.validate import FIELD_LIMIT, LAST_US, WINDOW, key_fits, reject_reason
from .plans.view import scan, series_view, view_sql
from .sources.frames import read_frames

log = logging.getLogger(__name__)


@dataclass
class Stats:
    """Counts since the engine was opened; ``flush_failures`` are those since the last flush that succeeded. Rejects at a flush are in its outcome, not here."""

    appended: int = 0
    rejected_ts: int = 0
    rejected_size: int = 0
    rejected_series: int = 0
    rejected_frames: int = 0
    flushes: int = 0
    flush_failures: int = 0
    rows_flushed: int = 0
    deduplicated: int = 0


@dataclass
class RawIngest:
    """``discarded_bytes`` follow a frame that cannot be read: where the next one begins is not known."""

    accepted: int
    rejected: int
    discarded_bytes: int = 0


@dataclass
class FlushOutcome:
    committed: bool
    rows: int = 0
    deduplicated: int = 0
    rejected: int = 0
    files: int = 0
    first_segment: int = 0
    last_segment: int = 0


class Engine:
    """Opens a data directory: lock, manifest, schemas, sweep, recovery, and a flush if one is overdue."""

    def __init__(self, spark: SparkSession, config: Config, force_unlock: bool = False, rows_per_task: int = 20_000_000, bytes_per_task: int = 64 << 20):
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        config.validate()
        self.spark, self.config, self.counts = spark, config, Stats()
        self.files = Files(spark, config.data_dir)
        self.files.mkdirs("")
        self.lock = store.Lock(self.files, force_unlock)
        self.rows_per_task, self.bytes_per_task = rows_per_task, bytes_per_task  # an hour of more is sorted by several tasks
        self.single, self.landing, self.timer = threading.RLock(), threading.Lock(), None
        try:
            store.require_manifest(self.files)
            self.manifest = Manifest.load(self.files) or Manifest()
            if self.manifest.reconcile(config.series) or not self.files.exists("manifest.json"):
                self.manifest.commit(self.files)  # before any record has a new epoch
            store.sweep(self.files, self.manifest.last_flushed_segment)
            self.next_segment = store.recover(self.files, self.manifest.last_flushed_segment)
            self.sources = store.Sources(self.files)
            if config.flush.on_startup and store.segments(self.files) and self.overdue():
                self.flush()
            self.start_timer()
        except BaseException:
            self.lock.release()
            raise

    # -- what is declared

    @property
    def data_dir(self) -> str:
        return self.files.root

    def series(self, name: str) -> SeriesSpec:
        found = self.config.find_series(name)
        if not found:
            raise UnknownSeries(name)
        return found

    def schema(self) -> list[dict]:
        return [{"name": s.name, "epoch": self.manifest.current(s.name).epoch, "keys": [k.to_json() for k in s.keys]} for s in self.config.series]

    def accept_window(self, now_us: int | None = None) -> WINDOW:
        now = time.time_ns() // 1000 if now_us is None else now_us
        return WINDOW.at(now, self.config.limits.ts_min_us, self.config.limits.ts_max_skew_ms)

    # -- ingest

    def records(self, name: str, df: DataFrame) -> DataFrame:
        """Records from typed columns: ``ts`` (a timestamp) or ``ts_us``, the keys, and perhaps ``id, extra, data``."""
        spec, types = self.series(name), {f.name: f.dataType for f in df.schema.fields}
        if missing := [k.name for k in spec.keys if k.name not in types]:
            raise KeyArity(name, len(spec.keys), len(spec.keys) - len(missing))
        for k in spec.keys:
            if types[k.name] != KEY_TYPES[k.type]:
                raise TypeMismatch(name, k.name, k.type, types[k.name].simpleString())
        text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) if c in types else F.lit("")
        pairs = F.transform(F.map_entries("extra"), lambda e: F.struct(e["key"].alias("k"), F.coalesce(e["value"], F.lit("")).alias("v"))) if "extra" in types and types["extra"].typeName() == "map" else F.col("extra") if "extra" in types else F.lit(None)
        none = F.array().cast("array<struct<k:string,v:string>>")
        values = F.array(*[value_of(f"`{k.name}`", k.type) for k in spec.keys]) if spec.keys else F.array()
        return df.select(
            F.lit(name).alias("series"), F.lit(self.manifest.current(name).epoch).alias("epoch"), (F.col("ts_us").cast("bigint") if "ts_us" in types else micros("ts")).alias("ts_us"), text("id").alias("id"),
            values.cast(_type_of("keys")).alias("keys"), F.coalesce(pairs.cast(_type_of("extra")), none).alias("extra"), text("data").alias("data"),
        )

    def append(self, name: str, df: DataFrame, now_us: int | None = None) -> int:
        """Lands all rows of ``df``, or none: a fault is raised, and counted once. Of several kinds of faults the one that is checked first."""
        records = self.records(name, df)
        epoch, spec = self.manifest.current(name), self.series(name)
        window, limit = self.accept_window(now_us), self.config.limits.max_record_bytes
        reason = reject_reason({(name, epoch.epoch): spec.keys}, window, limit)
        seen, segment = self._land(records, reason, keys=spec.keys, only=(name, epoch.epoch))
        if seen["rejected"]:
            self.files.delete("wal", segment)
            if seen["bad_ts"]:
                self.counts.rejected_ts += 1
                raise TsOutOfRange(seen["ts"], window.low, LAST_US if window.high is None else window.high)
            for i, key in enumerate(spec.keys):
                if seen[f"bad_key_{i}"]:
                    raise TypeMismatch(name, key.name, key.type, None)
            if seen["bad_field"]:
                raise FieldTooLong(name, FIELD_LIMIT)
            self.counts.rejected_size += 1
            raise RecordTooLarge(seen["size"], limit)
        self._publish(segment, seen["accepted"])
        return seen["accepted"]

    append_batch = append

    def append_raw(self, records: DataFrame, now_us: int | None = None, source: str | None = None, order: str | None = None) -> RawIngest:
        """Lands the records (columns of model.RECORD) that can be taken and counts the others.

        A known series with its current or an earlier epoch and a size within the
        limit are enough: keys are checked at the flush. ``source`` names the
        batch, as "name-number"; one that has landed before, or has a smaller
        number than one of its name that has, is not landed again. ``order``
        names a column of whole numbers, no two alike and none null, by which
        the records of this batch arrived; without it that is the order of the
        rows.
        """
        if source and source in self.sources:
            return RawIngest(0, 0)
        window = self.accept_window(now_us)
        known = F.lit(False)
        for s in self.config.series:
            known = known | ((F.col("series") == s.name) & (F.col("epoch") <= self.manifest.current(s.name).epoch))
        too_large = F.coalesce(encoded_size() > self.config.limits.max_record_bytes, F.lit(False))
        reason = F.when(too_large, "size").when(~F.coalesce(F.col("ts_us").between(window.low, LAST_US if window.high is None else window.high), F.lit(False)), "ts").when(~F.coalesce(known, F.lit(False)), "schema")
        seen, segment = self._land(records, reason, source, order=order)
        self._publish(segment, seen["accepted"], source)
        self.counts.rejected_ts += seen["bad_ts"]
        self.counts.rejected_size += seen["bad_size"]
        self.counts.rejected_series += seen["bad_schema"]
        self.counts.rejected_frames += seen["rejected"]
        return RawIngest(seen["accepted"], seen["rejected"])

    def append_frames(self, path: str, now_us: int | None = None, source: str | None = None) -> RawIngest:
        """append_raw() the frames of all files that match ``path``, each a batch as a client sends it.

        Of a batch nothing is read behind a frame whose length or checksum is
        wrong. Frames of unknown series, and those whose keys cannot be read, are
        rejected; the rest lands.
        """
        arities = {at: len(keys) for at, keys in self.manifest.schemas().items()}
        frames = read_frames(self.spark, path, arities, self.config.limits.max_record_bytes, batch=True)
        seen = Observation()
        bad = F.col("fault").isNotNull()
        frames = frames.observe(seen, F.count(F.when(bad, 1)).alias("bad"), F.count(F.when(F.col("fault") == "unknown schema", 1)).alias("unknown"), F.coalesce(F.sum("lost"), F.lit(0)).alias("lost"))
        done = self.append_raw(frames.filter(~bad), now_us, source)
        if source and not done.accepted and not done.rejected and source in self.sources:
            return done
        found = seen.get
        self.counts.rejected_series += found["unknown"]
        self.counts.rejected_frames += found["bad"]
        return RawIngest(done.accepted, done.rejected + found["bad"], found["lost"])

    def _land(self, records: DataFrame, reason: Column, source: str | None = None, keys: tuple = (), only: tuple[str, int] | None = None, order: str | None = None) -> tuple[dict, str]:
        """Writes what has no ``reason`` to a directory that does not count yet, and what was seen meanwhile. ``only`` is the series and epoch of all records, if they have one."""
        seen, segment = Observation(), f"_tmp-{uuid.uuid4().hex}"
        judged = records.select(*_names(RECORD), *([F.col(order).cast("bigint").alias("off")] if order else [])).withColumn("_reason", reason)
        bad = lambda r: F.count(F.when(F.col("_reason") == r, 1)).alias(f"bad_{r}")
        by_key = [F.count(F.when((F.col("_reason") == "type") & ~F.coalesce(key_fits(i, k), F.lit(False)), 1)).alias(f"bad_key_{i}") for i, k in enumerate(keys)]
        judged = judged.observe(
            seen, F.count(F.when(F.col("_reason").isNull(), 1)).alias("accepted"), F.count("_reason").alias("rejected"), *map(bad, ("ts", "size", "schema", "field")), *by_key,
            F.max(F.when(F.col("_reason") == "ts", F.col("ts_us"))).alias("ts"), F.max(F.when(F.col("_reason") == "size", encoded_size())).alias("size"),
        )
        kept = judged.filter("_reason is null").drop("_reason").withColumn("size", encoded_size(nulls=True))
        if not order:
            kept = kept.withColumn("off", F.monotonically_increasing_id())
        if only:  # literals right below the write: no task sorts its rows by them
            kept = kept.withColumns({"series": F.lit(only[0]), "epoch": F.lit(only[1])})
        kept.write.partitionBy("series", "epoch").parquet(self.files.path("wal", segment))
        if source:
            self.files.write(json.dumps(source), "wal", segment, "_source.json")
        return seen.get, segment

    def _publish(self, segment: str, rows: int, source: str | None = None) -> None:
        """Makes a landed directory a segment. A flush that runs meanwhile is not waited for."""
        if not rows:
            self.files.delete("wal", segment)
            return
        with self.landing:
            self.files.rename(f"wal/{segment}", f"wal/{store.segment_name(self.next_segment)}")
            self.next_segment += 1
            self.counts.appended += rows
            if source:
                self.sources.add(source)

    # -- flush

    def overdue(self, now_us: int | None = None) -> bool:
        now = time.time_ns() // 1000 if now_us is None else now_us
        return self.manifest.last_flush_at is None or now - self.manifest.last_flush_at >= self.config.flush.interval_ms * 1000

    def flush(self) -> FlushOutcome:
        """Publishes all landed segments; one flush at a time."""
        with self.single:
            if self.counts.flush_failures:
                store.sweep(self.files, self.manifest.last_flushed_segment)
            try:
                outcome = self._flush()
            except BaseException:
                self.counts.flush_failures += 1
                raise
            self.counts.flush_failures = 0
            self.counts.flushes += outcome.committed
            self.counts.rows_flushed += outcome.rows
            self.counts.deduplicated += outcome.deduplicated
            return outcome

    def _readable(self) -> list[int]:
        """Eligible segments in order; unreadable ones are set aside, or end the list if they cannot be."""
        found = []
        for segment in store.eligible(store.segments(self.files), self.manifest.last_flushed_segment):
            try:
                self.spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").parquet(self.files.path("wal", store.segment_name(segment))).schema
                found.append(segment)
            except Exception:  # noqa: BLE001  whatever makes a footer unreadable
                if not store.quarantine(self.files, segment):
                    break
        return found

    def landed(self, segments: Iterable[int]) -> DataFrame:
        """Landed records of some segments; ``seg, series, epoch`` prune directories. A ``size`` that is not known is the largest there may be."""
        paths = [self.files.path("wal", store.segment_name(s)) for s in segments]
        found = self.spark.read.schema(LANDED).option("basePath", self.files.path("wal")).parquet(*paths)
        return found.withColumn("size", F.coalesce("size", F.lit(self.config.limits.max_record_bytes).cast("bigint")))

    def _flush(self) -> FlushOutcome:
        segments = self._readable()
        if not segments:
            return FlushOutcome(False)
        first, last = segments[0], segments[-1]
        staged, touched, total = [], set(), {"rows": 0, "deduplicated": 0, "rejected": 0}
        landed, schemas = self.landed(segments), self.manifest.schemas()
        reason = reject_reason(schemas, strict=False)
        rejects = landed.withColumn("_reason", reason).filter("_reason is not null").drop("size")
        for group in landed_groups(landed.withColumn("_reason", reason), self.rows_per_task, self.bytes_per_task):
            series, epoch = group["series"], group["epoch"]
            keys = schemas.get((series, epoch))
            touched |= {series} & set(self.manifest.series)
            written = 0
            if keys is not None and group["bad"] < group["n"]:
                good = landed.filter((F.col("series") == series) & (F.col("epoch") == epoch)).filter(reject_reason({(series, epoch): keys}, strict=False).isNull())
                written = self._write(series, good, keys, group["tasks"], group["hot"], staged, (first, last, epoch))
            counts = flush_counts(group["n"], group["bad"], written)
            total = {k: total[k] + counts[k] for k in total}
        if not total["rows"] and not total["rejected"]:
            return FlushOutcome(False)
        if total["rejected"]:
            self._reject(rejects, last)
        self.manifest.last_flushed_segment = max(self.manifest.last_flushed_segment, last)
        self.manifest.last_flush_at = time.time_ns() // 1000
        self.sources.keep(segments)
        self.lock.check()
        self.manifest.commit(self.files)  # the commit point
        files = sum(store.promote(self.files, path) for path in staged)
        for s in segments:
            self.files.delete("wal", store.segment_name(s))
        for series in touched:
            try:
                self.files.mkdirs("series", series)
                self.files.write(view_sql(series, self.manifest.series[series]), "series", series, "view.sql")
            except Exception as e:  # noqa: BLE001  the flush is committed, and the next one writes it again
                log.warning("the view of %s was not written: %s", series, e)
        return FlushOutcome(True, **total, files=files, first_segment=first, last_segment=last)

    def _write(self, series: str, good: DataFrame, keys: tuple, tasks: int, hot: dict[str, int], staged: list[str], span: tuple[int, int, int]) -> int:
        """Writes one series and epoch by hour and stages it; the number of rows."""
        wrote = Observation()
        # At least a fixed number of tasks: opening a file an hour is most of a small flush, and one task would do it all.
        tasks = max(tasks, int(self.spark.conf.get("spark.sql.shuffle.partitions")))
        rows = sort_for_storage(to_storage(good, keys), tasks, hot).drop("seg", "off").observe(wrote, F.count("*").alias("n"))
        # Spark keeps the schema of a file, with what is said of its columns, in the footer.
        rows = rows.withMetadata("ts", {"series": series, "epoch": span[2]})
        written = f"tmp/{series}/write-{uuid.uuid4().hex}"
        writer = rows.write.partitionBy("hour").option("compression", COMPRESSION[self.config.flush.compression])
        for option, value in _PARQUET.items():
            writer = writer.option(option, value)
        self.spark.conf.set("spark.sql.parquet.outputTimestampType", "TIMESTAMP_MICROS")
        writer.option("parquet.block.row.count.limit", str(self.config.flush.row_group_rows)).parquet(self.files.path(written))
        staged.append(store.stage(self.files, series, written, *span))
        return wrote.get["n"]

    def _reject(self, rows: DataFrame, segment: int) -> None:
        """Keeps rejected records, as many as fit below the cap by their encoded size; a failure is logged only."""
        try:
            room = self.config.limits.reject_max_bytes - self.files.bytes_in("rejects")
            size = F.coalesce(encoded_size(), F.lit(0))
            all_, largest = rows.agg(F.coalesce(F.sum(size), F.lit(0)), F.coalesce(F.max(size), F.lit(0))).first()
            if all_ > room:
                log.warning("rejects are at their cap: further ones are counted only")
                if room < largest:
                    return
                rows = rows.limit(room // largest)
            rows.withColumnRenamed("_reason", "reason").write.mode("append").parquet(self.files.path("rejects", store.segment_name(segment)))
        except Exception as e:  # noqa: BLE001  what was rejected is counted in any case
            log.warning("rejected records were not kept: %s", e)

    # -- reading

    def _series_files(self, name: str) -> bool:
        return any(n.startswith("hour=") for n in self.files.names("series", name))

    def table(self, name: str) -> DataFrame:
        """All published rows of a series, all epochs joined."""
        if name not in self.manifest.series:
            raise UnknownSeries(name)
        return series_view(self.spark, self.files.path("series", name), self.manifest.series[name], self._series_files(name))

    def scan(self, name: str, ts_from: int | None = None, ts_to: int | None = None) -> DataFrame:
        if name not in self.manifest.series:
            raise UnknownSeries(name)
        return scan(self.spark, self.files.path("series", name), self.manifest.series[name], ts_from, ts_to, self._series_files(name))

    def create_views(self) -> None:
        for name in self.manifest.series:
            self.table(name).createOrReplaceTempView(f"`{name.replace('`', '``')}`")

    # -- control

    def stats(self) -> dict:
        pending = store.segments(self.files)
        return asdict(self.counts) | {"pending_segments": len(pending), "pending_bytes": self.files.bytes_in("wal"), "segment": self.next_segment, "last_flushed_segment": self.manifest.last_flushed_segment, "last_flush_at": self.manifest.last_flush_at}

    def control(self, op: str) -> dict:
        """Replies of the control operations; an error is a reply."""
        try:
            if op == "ping":
                return {"status": "pong", "version": __version__}
            if op == "stats":
                return {"status": "stats", **self.stats()}
            if op == "flush":
                return {"status": "flushed", **asdict(self.flush())}
            if op == "schema":
                return {"status": "schema", "series": self.schema(), "max_batch_bytes": self.config.server.max_batch_bytes}
            if op == "shutdown":
                self.close()
                return {"status": "shutting-down"}
            return {"status": "error", "message": f"{op} is not implemented"}
        except LakeError as e:
            return {"status": "error", "message": str(e)}

    def start_timer(self) -> None:
        """Flushes every ``flush.interval_ms`` in the background; 0 turns it off."""
        if self.config.flush.interval_ms and not self.timer:
            self.timer_stop = threading.Event()

            def run() -> None:
                while not self.timer_stop.wait(self.config.flush.interval_ms / 1000):
                    try:
                        self.flush()
                    except Exception:  # noqa: BLE001  counted; the next flush sweeps and tries again
                        continue

            self.timer = threading.Thread(target=run, daemon=True)
            self.timer.start()

    def close(self) -> None:
        if self.timer:
            self.timer_stop.set()
            self.timer.join()
            self.timer = None
        self.lock.release()

    def __enter__(self) -> Engine:
        return self

    def __exit__(self, *_: object) -> None:
        self.close()


#: Writer options: tasks may move files into place, as nothing counts before the manifest says so; times as deltas, no dictionaries for columns that hardly repeat, no statistics of payloads.
_PARQUET = {"mapreduce.fileoutputcommitter.algorithm.version": "2", "parquet.writer.version": "PARQUET_2_0", "parquet.enable.dictionary#ts": "false", "parquet.enable.dictionary#id": "false", "parquet.enable.dictionary#data": "false", "parquet.column.statistics.enabled#data": "false", "parquet.block.size": str(1 << 30)}


def _names(schema: str) -> list[str]:
    from pyspark.sql.types import StructType

    return StructType.fromDDL(schema).names


def _type_of(column: str):
    from pyspark.sql.types import StructType

    return StructType.fromDDL(RECORD)[column].dataType

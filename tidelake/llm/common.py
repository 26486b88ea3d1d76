"""Helpers that the corpus operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..files import shared_folder

#: Rows of a side table that may be broadcast after its rows were counted.
#: Such tables have a handful of numbers a row, so this stays within tens of MB.
BROADCAST_ROWS = 100_000
#: Bytes of texts, and rows, that a Python function has in hand at a time.
PIECE_BYTES, PIECE_ROWS = 1 << 20, 4096
#: A setting of Spark's and its own default.
BATCH_BYTES, DEFAULT_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"


def materialise(df: DataFrame, few: bool = False) -> DataFrame:
    """Checkpoint ``df``, so that its rows are computed once, in the session's shared folder.

    A file per partition is what costs most of a small checkpoint, so there are
    some for each core at most, and of tables of a row per source or the like
    (``few``) one for several cores.
    """
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    files = max(1, context.defaultParallelism // 4) if few else 4 * context.defaultParallelism
    return df.coalesce(files).checkpoint(eager=True)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def held_out(modulus: int, remainder: int, column: str = "doc_id") -> Column:
    """True where crc32 of the id as text leaves ``remainder``; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(column).cast("string")) % modulus == remainder, F.lit(False))


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Whether ``df`` has at most ``rows`` rows; reads no more than that."""
    return df.limit(rows + 1).count() <= rows


def maybe_broadcast(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it was counted to be small, else unchanged."""
    return F.broadcast(df) if small(df, rows) else df


def unused(df: DataFrame, n: int) -> list[str]:
    """``n`` column names that ``df`` does not have, in any case of letters."""
    taken = {c.lower() for c in df.columns}
    return [name for k in range(n + len(taken)) if (name := f"_c{k}") not in taken][:n]


def in_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: T.StructType | str) -> DataFrame:
    """``df.mapInArrow``, by batches of at most PIECE_BYTES unless the session sets bytes of its own.

    Batches of Spark's default size cost an executor some hundred MB outside its
    heap. The value is the same for all operators, so it does not matter which
    of several pending plans is run first.
    """
    conf = df.sparkSession.conf
    if conf.get(BATCH_BYTES) == DEFAULT_BYTES:
        conf.set(BATCH_BYTES, str(PIECE_BYTES))
    return df.mapInArrow(run, schema)


_kept: dict[object, object] = {}


def kept(key: object, make: Callable[[], object]) -> object:
    """What ``make`` gives, kept in a Python worker until another key is asked for: workers serve one operator after the other."""
    if key not in _kept:
        _kept.clear()
        _kept[key] = make()
    return _kept[key]


def pieces(batches: Iterator[pa.RecordBatch], size: int = PIECE_BYTES, rows: int = PIECE_ROWS) -> Iterator[pa.RecordBatch]:
    """Arrow batches cut into slices of about ``size`` bytes and at most ``rows`` rows, so that what is made of a slice stays small; a longer row is a slice of its own."""
    for batch in batches:
        at = 0
        while at < batch.num_rows:
            n = min(rows, batch.num_rows - at)
            while n > 1 and batch.slice(at, n).nbytes > size:
                n = max(1, n // 2)
            yield batch.slice(at, n)
            at += n


def sorted_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple[np.ndarray, ...]]]:
    """From batches of numbers sorted by their first column to lists of groups, each the columns of the rows with one value in the first; a group may go on in the next batch."""
    held: list[list[np.ndarray]] = []

    def cut(columns: list[np.ndarray]) -> list[tuple[np.ndarray, ...]]:
        bounds = [0, *(np.flatnonzero(np.diff(columns[0])) + 1).tolist(), len(columns[0])]
        return [tuple(c[a:b] for c in columns) for a, b in zip(bounds, bounds[1:], strict=False)]

    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        last = int(np.flatnonzero(np.diff(columns[0]))[-1]) + 1 if len(columns[0]) > 1 and (columns[0] != columns[0][0]).any() else 0
        if held and held[-1][0][-1] != columns[0][0]:
            yield cut([np.concatenate(x) for x in zip(*held, strict=True)])
            held = []
        if last:
            held.append([c[:last] for c in columns])
            yield cut([np.concatenate(x) for x in zip(*held, strict=True)])
            held = []
        held.append([c[last:] for c in columns])
    if held:
        yield cut([np.concatenate(x) for x in zip(*held, strict=True)])

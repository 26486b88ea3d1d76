"""A uniform shuffle of documents into shards of exact sizes (operator 8).

The rows are dealt by a hypergeometric communication matrix. ``parts`` logical
source partitions are formed by a hash of the row; how many rows each of them
sends to each shard is drawn exactly, from the multivariate hypergeometric law
that a uniform permutation of all rows would follow. Each source partition is
permuted locally and cut at those counts, the pieces are exchanged, and each
shard is permuted again. The driver sees only the row count of each source
partition; everything on rows is DataFrame code.
"""

from __future__ import annotations

import json
import math
import random

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialise

#: Rows that one task permutes: source partitions and slices of shards have about so many,
#: and more only where there would be over MAX_PARTS of them, to bound the matrix on the driver.
ROWS_PER_PART = 50_000
MAX_PARTS = 20_000


def hypergeometric(rng: random.Random, good: int, bad: int, draws: int) -> int:
    """How many of ``draws`` draws without replacement are good: inversion of the law, in double precision, from the mode outwards."""
    low, high = max(0, draws - bad), min(draws, good)
    if low == high:
        return low
    mode = min(high, max(low, (draws + 1) * (good + 1) // (good + bad + 2)))
    log_choose = lambda n, k: math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)
    at_mode = math.exp(log_choose(good, mode) + log_choose(bad, draws - mode) - log_choose(good + bad, draws))
    left = rng.random() - at_mode
    if left <= 0:
        return mode
    up, down, p_up, p_down = mode, mode, at_mode, at_mode
    while up < high or down > low:
        if up < high:
            p_up *= (good - up) * (draws - up) / ((up + 1) * (bad - draws + up + 1))
            up += 1
            left -= p_up
            if left <= 0:
                return up
        if down > low:
            p_down *= down * (bad - draws + down) / ((good - down + 1) * (draws - down + 1))
            down -= 1
            left -= p_down
            if left <= 0:
                return down
    return mode


def shard_sizes(rows: int, shards: int) -> list[int]:
    """Row counts at most one apart, the larger first."""
    return [rows // shards + (s < rows % shards) for s in range(shards)]


def communication_matrix(counts: list[int], sizes: list[int], seed: int) -> list[list[int]]:
    """Row p, column s: rows that source partition p sends to shard s. Margins are ``counts`` and ``sizes``."""
    rng, room, matrix = random.Random(seed), list(sizes), []
    for count in counts:
        row, left, total = [], count, sum(room)
        for space in room:
            total -= space
            n = hypergeometric(rng, space, total, left)
            row.append(n)
            left -= n
        room = [space - n for space, n in zip(room, row, strict=True)]
        matrix.append(row)
    return matrix


def uniform_shards(docs: DataFrame, shards: int = 8, seed: int = 17, rows_per_part: int = ROWS_PER_PART, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Deal every row to a shard and a slot; law ``rows``.

    Returns ``id_col, size, text_crc32, law, shard, slot, grown_shard``. ``size``
    is the UTF-8 length plus 1 and ``text_crc32`` the unsigned checksum, a null
    text counting as empty. Shard sizes differ by one at most and slots run from
    0 without gaps. A null id is dealt like any other; rows that agree in id and
    text are interchangeable, so a rerun gives the same rows. An empty table
    gives no rows. Other columns are ignored. With fewer rows than shards some
    shards stay empty.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(F.col(id_col), (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    base = materialise(base.withColumn("near", F.xxhash64(F.lit(seed), id_col, "text_crc32", "size")).withColumn("far", F.xxhash64(F.lit(seed + 1), id_col, "text_crc32", "size")))
    rows = base.count()
    parts = min(MAX_PARTS, max(1, math.ceil(rows / rows_per_part), min(shards, rows)))
    part = F.pmod(F.xxhash64(F.lit(seed + 2), "near"), F.lit(parts)).cast("int")
    base = base.withColumn("part", part)
    counts = dict(base.groupBy("part").count().collect())
    order = sorted(counts)
    matrix = communication_matrix([counts[p] for p in order], shard_sizes(rows, shards), seed)
    cuts = [{"part": p, "cuts": [sum(row[: s + 1]) for s in range(shards)]} for p, row in zip(order, matrix, strict=True)]
    cuts_df = docs.sparkSession.range(1).select(F.inline(F.from_json(F.lit(json.dumps(cuts)), "array<struct<part:int,cuts:array<bigint>>>")))
    permuted = base.withColumn("at", F.row_number().over(Window.partitionBy("part").orderBy("near", id_col, "text_crc32")) - 1)
    sent = permuted.join(cuts_df, "part").withColumn("shard", F.size(F.filter("cuts", lambda c: c <= F.col("at"))).cast("int"))
    # The second permutation: slices of each shard by the leading bits of ``far``, ordered within by all of it.
    slices = max(1, math.ceil(rows / shards / rows_per_part))
    sent = sent.withColumn("slice", F.floor((F.shiftrightunsigned("far", 33) * slices) / F.lit(2**31)).cast("int"))
    sent = sent.select(id_col, "size", "text_crc32", "far", "shard", "slice", "near")
    ahead = sent.groupBy("shard", "slice").agg(F.count("*").alias("n"))
    ahead = ahead.withColumn("before", F.sum("n").over(Window.partitionBy("shard").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1))).select("shard", "slice", F.coalesce("before", F.lit(0)).alias("before"))
    placed = sent.withColumn("within", F.row_number().over(Window.partitionBy("shard", "slice").orderBy("far", id_col, "text_crc32")) - 1)
    return placed.join(ahead, ["shard", "slice"]).select(
        id_col, "size", "text_crc32", F.lit("rows").alias("law"), "shard", (F.col("before") + F.col("within")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )

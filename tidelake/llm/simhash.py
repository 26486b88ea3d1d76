"""SimHash near-duplicates by BK-trees (operator 9).

A fingerprint has 64 bits, each the majority of that bit in the hashes of all
word shingles. Documents link at RADIUS or fewer differing bits. Copies are
folded first: links are sought between distinct fingerprints only. Two
fingerprints that differ in at most two bits agree in two of four 16-bit blocks
at least, so each fingerprint goes to six shards, one for each pair of its
blocks, and meets there all those it may link to. A shard's BK-tree has its
children keyed by the Hamming distance to their parent; a search follows only
edges within the radius. What a shard gives is no list of pairs but a forest
that joins what is linked, so its size is linear in the shard. Components are
then found by alternating large and small stars.

The trees aren't broadcast whole: the fingerprints of all documents have no size
bound. A tree is built where its shard is, and each query is sent to the six
shards that can hold its answers.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import in_arrow, materialise, maybe_broadcast, pieces, sorted_groups, unused

SHINGLE, RADIUS, SEED = 3, 2, 42
BLOCKS = [0xFFFF << shift for shift in (0, 16, 32, 48)]
#: Buckets of ids by which all tasks are told which rows may go: so many small numbers are broadcast at most.
BUCKETS = 1 << 20


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The signed 64-bit SimHash of a text; 0 if it has no words."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    if len(words) <= shingle:
        return int.from_bytes(xxhash.xxh64_digest(b" ".join(words), SEED), "big", signed=True)
    digest, join = xxhash.xxh64_digest, b" ".join
    ones, total, step = np.zeros(64, np.int64), len(words) - shingle + 1, 1 << 15
    for at in range(0, total, step):  # in blocks, as texts can be long
        part = words[at : at + step + shingle - 1]
        packed = b"".join([digest(join(x), SEED) for x in zip(*[part[k:] for k in range(shingle)], strict=False)])
        ones += np.unpackbits(np.frombuffer(packed, np.uint8)).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > total).tobytes(), "big", signed=True)


class BKTree:
    """Children keyed by their integer Hamming distance to the parent."""

    def __init__(self) -> None:
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def search(self, value: int, radius: int, first: bool = False) -> list[int]:
        """Places of all values within the radius, or of the ``first`` one met; follows only edges that can lead to some."""
        found, todo = [], [0] if self.values else []
        while todo:
            at = todo.pop()
            distance = (self.values[at] ^ value).bit_count()
            if distance <= radius:
                found.append(at)
                if first:
                    break
            children = self.children[at]
            if len(children) <= 2 * radius + 1:
                todo += [c for d, c in children.items() if abs(d - distance) <= radius]
            else:
                todo += [children[d] for d in range(distance - radius, distance + radius + 1) if d in children]
        return found

    def add(self, value: int) -> None:
        self.values.append(value)
        self.children.append({})
        at, new = 0, len(self.values) - 1
        while new:
            children = self.children[at]
            distance = (self.values[at] ^ value).bit_count()
            if distance not in children:
                children[distance] = new
                break
            at = children[distance]


def linked(values: list[int], radius: int = RADIUS, every: bool = True) -> list[tuple[int, int]]:
    """Pairs of ``values`` (distinct, unsigned) within the radius: a forest that joins all that such pairs connect.

    While one component holds the whole tree, the first value met joins it, so
    a shard of near copies costs its size and not its square. Unless ``every``,
    the first one met is enough in any case; some links are then not seen.
    """
    tree, roots, parts, found = BKTree(), list(range(len(values))), 0, []

    def root(i: int) -> int:
        while roots[i] != i:
            roots[i] = roots[roots[i]]
            i = roots[i]
        return i

    for i, value in enumerate(values):
        near = tree.search(value, radius, first=not every or parts == 1)
        parts += 1
        for place in near:
            mine, other = root(i), root(place)
            if other != mine:
                roots[max(mine, other)] = min(mine, other)
                parts -= 1
                found.append((value, values[place]))
        tree.add(value)
    return found


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """``id_col, fp`` with ``fp`` a long, for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([fingerprint(t, shingle) for t in batch.column(1).to_pylist()], pa.int64())], names=[id_col, "fp"])

    slim = docs.select(id_col, text_col)
    return in_arrow(slim, run, slim.select(id_col).schema.add("fp", "long"))


def _shard_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows (shard, fingerprint) sorted by shard to the links of each shard."""
    for shards in sorted_groups(batches):
        found = [pair for _, values in shards if len(values) > 1 for pair in linked([int(x) for x in np.unique(values.view(np.uint64))])]
        pairs = np.array(found, np.uint64).reshape(-1, 2).view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["u", "v"])


def links(distinct: DataFrame) -> DataFrame:
    """Edges ``u, v`` between distinct fingerprints ``fp`` that connect all within the radius."""
    shards = [(F.col("fp").bitwiseAND(F.lit(np.uint64(BLOCKS[a] | BLOCKS[b]).view(np.int64).item())), k) for k, (a, b) in enumerate(combinations(range(4), 2))]
    routed = distinct.select("fp", F.explode(F.array(*[F.xxhash64(block, F.lit(k)) for block, k in shards])).alias("shard"))
    # A shard whose name is alike by chance only has more to compare: the distance decides.
    return in_arrow(routed.repartition("shard").sortWithinPartitions("shard").select("shard", "fp"), _shard_links, "u long, v long")


def components(edges: DataFrame, step: int = 0) -> DataFrame:
    """``node, root`` for every node of ``edges`` (``u, v``): the smallest node that it reaches.

    Alternates large stars (each neighbour above a node is tied to the smallest
    neighbour) and small stars (each one below is) until nothing changes. Minima
    are folded before they are shuffled, so a hub costs no more than its edges.
    """
    edges = materialise(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = None
    while True:
        both = edges.union(edges.select("v", "u"))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        tied = large.join(least, "u")
        edges = materialise(tied.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct())
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.groupBy("u").agg(F.min("v").alias("root")).withColumnRenamed("u", "node")
        before = now


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, fingerprint, component_id`` for each row.

    Rows link if their fingerprints differ in two bits at most, and
    ``component_id`` is the smallest id that links reach. A text without words
    (null, empty, white space) has fingerprint zero and links like any other.
    Null ids are never the smallest; a component of nothing else has a null
    one. Repeated rows give repeated rows, an empty table none.
    """
    prints = materialise(fingerprints(docs, id_col, text_col))
    folded = materialise(prints.groupBy("fp").agg(F.min(id_col).alias("least")))
    roots = components(links(folded))
    mapped = materialise(folded.join(roots, folded["fp"] == roots["node"], "left").select("fp", F.coalesce("root", "fp").alias("root"), "least"))
    # Written before it is joined, so that a component of many fingerprints can be split among tasks.
    named = materialise(mapped.groupBy("root").agg(F.min("least").alias("component_id")))
    known = materialise(mapped.join(named, "root").select("fp", "component_id"))
    joined = prints.join(maybe_broadcast(known), "fp")
    return joined.select(id_col, F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def with_fingerprint(docs: DataFrame, column: str, text_col: str = "text", of: Callable[[str | None], int] = fingerprint) -> DataFrame:
    """``docs`` with the fingerprint of each row as a last column."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            found = pa.array([of(t) for t in batch.column(at).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, found], names=[*batch.schema.names, column])

    return in_arrow(docs, run, T.StructType([*docs.schema.fields, T.StructField(column, T.LongType())]))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component, that of the smallest id; the columns of ``docs``.

    Rows that repeat an id are one document: one of them stays. A row without an
    id stays if nothing in its component has one, one row for each fingerprint.
    """
    found = near_duplicates(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "id", "text")
    found = materialise(found.select("id", "component_id", F.conv("fingerprint", 16, -10).cast("long").alias("fp")))
    own = found.filter("id = component_id").select("id").distinct()
    dropped = found.filter("id is not null").select("id").distinct().join(own, "id", "left_anti")
    return keep_rows(docs, found.select("id"), dropped, found.filter("component_id is null").select("fp").distinct(), fingerprint, id_col, text_col)


def keep_rows(docs: DataFrame, ids: DataFrame, dropped: DataFrame, nameless: DataFrame, of: Callable[[str | None], int], id_col: str, text_col: str) -> DataFrame:
    """``docs`` less the rows whose ``id`` is in ``dropped``, one row for each id, and of those without an id one for each ``fp`` of ``nameless``, which ``of`` gives for a text.

    ``ids`` has the id of every row. What is to go, or to be looked at because
    its id repeats, is told to all tasks by the bucket of its id, at most
    BUCKETS of them; only rows of those buckets are moved.
    """
    key, bucket, fp = unused(docs, 3)
    suspects = materialise(ids.groupBy("id").count().filter("count > 1 and id is not null").select("id", F.lit(False).alias("go")).union(dropped.select("id", F.lit(True).alias("go"))))
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(BUCKETS)).cast("int")
    buckets = F.broadcast(materialise(suspects.select(place("id").alias(bucket)).distinct(), few=True))
    named = docs.filter(F.col(id_col).isNotNull()).withColumn(bucket, place(id_col))
    clear = named.join(buckets, bucket, "left_anti").drop(bucket)
    gone = suspects.filter("go").select(F.col("id").alias(key))
    looked_at = named.join(buckets, bucket, "left_semi").drop(bucket)
    looked_at = looked_at.join(gone, looked_at[id_col] == gone[key], "left_anti").dropDuplicates([id_col])
    rows = clear.union(looked_at)
    nameless = materialise(nameless.select(F.col("fp").alias(fp)), few=True)
    if nameless.isEmpty():
        return rows
    extra = with_fingerprint(docs.filter(F.col(id_col).isNull()), fp, text_col, of).join(nameless, fp, "left_semi").dropDuplicates([fp])
    return rows.union(extra.select(*[F.col(f"`{c}`") for c in docs.columns]))

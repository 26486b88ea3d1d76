"""Approximate nearest neighbours by a forest of random-projection trees (operator 10).

Every tree splits space by hyperplanes, each halfway between two sampled
vectors. The trees are fitted on a bounded sample and are all that is sent to
the tasks; every row is then put into one leaf of each tree. A query searches
all trees through one shared priority queue, which opens the half-space whose
boundary is nearest next. Its candidates are all rows of the opened leaves; they
meet it there, are ranked by exact cosine, and the best of all leaves are kept.

How far the queue is followed is measured and not set: vectors of the sample are
searched for in the sample, and the search goes on until TARGET of their true
neighbours are found. Data with structure need few leaves for that; neighbours
in a larger table are nearer than in the sample, so no fewer are found there.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import in_arrow, materialise, pieces

#: Vectors that the trees are fitted on, about; rows of the sample in a leaf at most; trees.
SAMPLE, LEAF, TREES = 20_000, 128, 10
#: Share of the true neighbours of PROBES vectors of the sample that a search must find.
TARGET, PROBES = 0.96, 300
#: Index rows of a leaf in one group, about: a larger leaf is split, and its queries are sent to each part.
GROUP = 4096
#: Queries that are compared with a group at a time.
BLOCK = 64


@dataclass
class Tree:
    """Node ``i`` sends vectors to ``left[i]`` or ``right[i]``, by the side of its plane; negative numbers are leaves."""

    normals: np.ndarray
    left: list[int]
    right: list[int]
    sizes: list[int]  # of the sample in each leaf

    @classmethod
    def grow(cls, x: np.ndarray, rng: np.random.Generator) -> Tree:
        normals, left, right, sizes = [], [], [], []

        def split(rows: np.ndarray) -> int:
            if len(rows) > LEAF:
                for _ in range(4):
                    a, b = x[rng.choice(rows, 2, replace=False)]
                    side = x[rows] @ (a - b) > 0
                    if min(side.sum(), (~side).sum()) >= len(rows) // 20:
                        break
                else:  # nearly all alike: any plane through the origin
                    a, b = rng.standard_normal((2, x.shape[1]))
                    side = x[rows] @ (a - b) > 0
                if side.any() and not side.all():
                    at = len(normals)
                    normals.append((a - b) / np.linalg.norm(a - b))
                    left.append(0)
                    right.append(0)
                    left[at] = split(rows[side])
                    right[at] = split(rows[~side])
                    return at
            sizes.append(len(rows))
            return -len(sizes)

        root = split(np.arange(len(x)))
        if root < 0:  # one leaf: a node that sends all there
            return cls(np.zeros((1, x.shape[1])), [root], [root], sizes)
        return cls(np.array(normals), left, right, sizes)

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row."""
        left, right = np.array(self.left), np.array(self.right)
        at = np.zeros(len(x), np.int64)
        while (inner := np.flatnonzero(at >= 0)).size:
            node = at[inner]
            side = np.einsum("ij,ij->i", x[inner], self.normals[node]) > 0
            at[inner] = np.where(side, left[node], right[node])
        return -at - 1


def search(forest: list[Tree], query: np.ndarray, want: float) -> list[tuple[int, int]]:
    """(tree, leaf) in the order of the shared queue, until the leaves hold ``want`` of the sample, copies in several trees counted."""
    margins = [tree.normals @ query for tree in forest]
    queue = [(-np.inf, t, 0) for t in range(len(forest))]
    found, held = [], 0
    while queue and held < want:
        bound, t, node = heapq.heappop(queue)
        tree = forest[t]
        if node < 0:
            found.append((t, -node - 1))
            held += tree.sizes[-node - 1]
            continue
        margin = margins[t][node]
        near, far = (tree.left[node], tree.right[node]) if margin > 0 else (tree.right[node], tree.left[node])
        heapq.heappush(queue, (bound, t, near))
        if far != near:
            heapq.heappush(queue, (max(bound, abs(margin)), t, far))
    return found


def calibrate(forest: list[Tree], x: np.ndarray, k: int, rng: np.random.Generator, target: float = TARGET, probes: int = PROBES) -> float:
    """How much of the sample ``x`` the leaves of a search must hold to find ``target`` of the ``k`` nearest of its vectors."""
    asked = rng.choice(len(x), min(probes, len(x)), replace=False)
    leaves = np.stack([tree.leaves(x) for tree in forest])
    needed = []
    for i in asked:
        near = x @ x[i]
        near[i] = -np.inf
        true = np.argsort(-near, kind="stable")[: min(k, len(x) - 1)]
        opened = search(forest, x[i], np.inf)
        held = dict(zip(opened, np.cumsum([forest[t].sizes[leaf] for t, leaf in opened]).tolist(), strict=True))
        needed += [min(held[t, leaves[t, j]] for t in range(len(forest))) for j in true.tolist()]
    return float(np.quantile(needed, target, method="higher")) if needed else 1.0


def _usable(vector: str) -> Column:
    """Neither null nor zero, and all components are finite numbers."""
    v = F.col(vector).cast("array<double>")
    return F.coalesce(F.forall(v, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf"))) & F.exists(v, lambda e: e != 0), F.lit(False))


def _top(rows: DataFrame, k: int) -> DataFrame:
    """The k best of each query by score, then by their smallest ids."""
    order = Window.partitionBy("query").orderBy(F.desc("score"), "least")
    return rows.withColumn("_rank", F.row_number().over(order)).filter(F.col("_rank") <= k).drop("_rank")


def _matrix(column: pa.Array, kind: str, width: int) -> np.ndarray:
    """Packed vectors as rows of doubles."""
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, width).astype(np.float64)


def best_of(q: np.ndarray, x: np.ndarray, least: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, cosine) of the ``k`` nearest rows of ``x`` to each query, equal ones by ``least``."""
    norms, lengths = np.sqrt((x * x).sum(1)), np.sqrt((q * q).sum(1))
    rough = (q / lengths[:, None]) @ (x / norms[:, None]).T
    k = min(k, len(x))
    floor = np.partition(rough, len(x) - k, axis=1)[:, len(x) - k] - 1e-9  # rounding differs by far less
    at, row = np.nonzero(rough >= floor[:, None])
    exact = (x[row] * q[at]).sum(1) / (norms[row] * lengths[at])
    order = np.lexsort((least[row], -exact, at))
    at, row, exact = at[order], row[order], exact[order]
    first = np.searchsorted(at, at)
    keep = np.arange(len(at)) - first < k
    return at[keep], row[keep], exact[keep]


def _matches(k: int, kind: str, width: int):
    """For rows of (key, asks, name, least, v) sorted by the first two: the ``k`` best rows of its group for each query in it. A group's rows are in hand at once, its queries go by."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows, group = None, [], None
        for batch in pieces(batches):
            keys, asks, names, least = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
            v = _matrix(batch.column(4), kind, width)
            cuts = np.flatnonzero((np.diff(keys) != 0) | (np.diff(asks.astype(np.int8)) != 0)) + 1
            out = []
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(keys)], strict=True):
                if keys[a] != key:
                    key, rows, group = keys[a], [], None
                if not asks[a]:
                    rows.append((names[a:b], least[a:b], v[a:b]))
                elif rows:
                    if group is None:
                        group = [np.concatenate(c) for c in zip(*rows, strict=True)]
                    for i in range(a, b, BLOCK):
                        at, row, score = best_of(v[i : min(b, i + BLOCK)], group[2], group[1], k)
                        out.append((names[i : min(b, i + BLOCK)][at], group[0][row], score))
            if out:
                columns = [np.concatenate(c) for c in zip(*out, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["query", "class", "score"])

    return run


def nearest(vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", target: float = TARGET, trees: int = TREES, seed: int = 11) -> DataFrame:
    """``query_id, rank, vec_id, score`` of the ``k`` nearest found of each query row, by cosine.

    Equal vectors are folded into a class first: a class is searched, and looked
    for, once, and stands for the smallest ``k + 1`` ids in it, which is all that
    a list of ``k`` without the query itself can show. Candidates with equal
    scores come by id. Vectors that are null, zero or hold null, NaN or infinite
    components take no part, nor do null ids. Of rows that repeat an id each
    vector counts; a pair of ids has its best score, and a query never finds its
    own id. Shorter vectors count as if zeros followed. An empty table gives no
    rows; other columns are ignored.
    """
    spark = vectors.sparkSession
    narrow = vectors.schema[vector_col].dataType.elementType.typeName() == "float"
    rows = vectors.filter(_usable(vector_col) & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    width = rows.agg(F.max(F.size("v"))).first()[0]
    if not width:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    padded = F.concat(F.transform("v", lambda e: e + F.lit(0.0)), F.array_repeat(F.lit(0.0), F.lit(width) - F.size("v")))
    rows = rows.withColumn("v", padded).withColumn("class", F.xxhash64("v")).withColumn("check", F.xxhash64(F.lit(1), "v"))
    kind = "<f4" if narrow else "<f8"

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            v = batch.column(4).flatten().to_numpy().astype(kind).reshape(-1, width)
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array([x.tobytes() for x in v], pa.binary())], names=["id", "asks", "class", "check", "v"])

    rows = materialise(in_arrow(rows.select("id", "asks", "class", "check", "v"), pack, "id long, asks boolean, class long, check long, v binary"))
    by_class = Window.partitionBy("class", "check").orderBy("id")
    members = rows.select("class", "check", "id").distinct().withColumn("at", F.row_number().over(by_class)).filter(F.col("at") <= k + 1).drop("at")
    folded = rows.withColumn("at", F.row_number().over(Window.partitionBy("class", "check").orderBy("id", "asks"))).filter("at = 1")
    named = materialise(folded.select("class", "check", F.monotonically_increasing_id().alias("name"), F.col("id").alias("least"), "v"))
    size = named.count()
    drawn = named.filter(F.pmod(F.xxhash64(F.lit(seed), "class"), F.lit(1 << 20)) < min(1.0, SAMPLE / size) * (1 << 20)).select("class", "v")
    sample = [v for _, v in sorted(drawn.collect())] or [named.first()["v"]]  # about SAMPLE vectors
    x = np.frombuffer(b"".join(sample), kind).reshape(-1, width).astype(np.float64)
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    rng = np.random.default_rng(seed)
    fitted = [Tree.grow(x, rng) for _ in range(trees)]
    want = calibrate(fitted, x, k, rng, target)
    forest = spark.sparkContext.broadcast(fitted)  # of the sample's size

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            v = _matrix(batch.column(2), kind, width)
            v /= np.linalg.norm(v, axis=1, keepdims=True)
            for t, tree in enumerate(forest.value):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(v), t, np.int32)), pa.array(tree.leaves(v).astype(np.int32)), *batch.columns], names=["tree", "leaf", "name", "least", "v"])

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            v = _matrix(batch.column(2), kind, width)
            for i, q in enumerate(v / np.linalg.norm(v, axis=1, keepdims=True)):
                opened = search(forest.value, q, want)
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in opened], pa.int32()), pa.array([x[1] for x in opened], pa.int32()), *[pa.array([c[i].as_py()] * len(opened), c.type) for c in batch.columns]], names=["tree", "leaf", "name", "least", "v"])

    shape = "tree int, leaf int, name long, least long, v binary"
    asking = rows.filter("asks").select("class", "check").distinct()
    queries = named.join(asking, ["class", "check"])
    index = materialise(in_arrow(named.select("name", "least", "v"), place, shape))
    # Leaves that many rows fall into are split; the counts are a row per leaf.
    parts = materialise(index.groupBy("tree", "leaf").count().select("tree", "leaf", F.ceil(F.col("count") / GROUP).cast("int").alias("parts")), few=True)
    key = F.xxhash64("tree", "leaf", "part")
    dealt = index.join(F.broadcast(parts), ["tree", "leaf"]).withColumn("part", F.pmod(F.xxhash64("name"), F.col("parts")).cast("int"))
    probes = in_arrow(queries.select("name", "least", "v"), ask, shape).join(F.broadcast(parts), ["tree", "leaf"]).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    met = dealt.select(key.alias("key"), F.lit(False).alias("asks"), "name", "least", "v").union(probes.select(key.alias("key"), F.lit(True).alias("asks"), "name", "least", "v"))
    found = in_arrow(met.repartition("key").sortWithinPartitions("key", "asks"), _matches(k + 1, kind, width), "query long, class long, score double")
    found = found.groupBy("query", "class").agg(F.max("score").alias("score"))  # a class is met in several trees
    least = named.select(F.col("name").alias("class"), "least")
    best = _top(found.join(least, "class"), k + 1)
    ids = materialise(named.select("name", "class", "check").join(members, ["class", "check"]).select("name", F.col("id").alias("member")))
    pairs = best.withColumnRenamed("class", "name").join(ids, "name").select(F.col("query").alias("q"), "score", F.col("member").alias("vec_id"))
    askers = rows.filter("asks").select("id", "class", "check").distinct().join(named.select("name", "class", "check"), ["class", "check"]).select(F.col("id").alias("query_id"), F.col("name").alias("q"))
    # A class that half of the queries share has k + 1 classes of at most k + 1 ids each, so this grows as the queries do.
    full = pairs.join(askers, "q").filter("vec_id <> query_id").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return full.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

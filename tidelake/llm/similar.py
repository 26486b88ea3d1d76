"""Near copies by the similarity of their shingles: the pipeline's stage of operator 9.

Two texts are near copies if their sets of five-word shingles have a Jaccard
similarity of 0.8 or more. Such sets differ in about 10 of the 64 bits of their
SimHashes, and in 24 once in tens of thousands at most, too many for blocks and
trees over all fingerprints to find. So candidates come from two sides:

- the operator's own links: BK-trees over shards of all fingerprints, at 2 bits;
- shards of documents that share a shingle. With all shingles in one order, two
  sets that are so alike share one within the first fifth of each. Any order
  does; common shingles come last, as a sample of documents has them, so that a
  common line brings few together. BK-trees find those within NEAR bits.

All candidates are compared exactly: by sketches first, which rule out none that
are alike, and then by the sets themselves.

Equal sets are folded first. At first a tree gives a forest of likely pairs and
not all of them, then the few nearest pairs of each text are looked at; shards
are split at random to a bounded size. What that links needs no more comparing:
at the end only those that share a shingle and are not
joined yet are searched for all pairs, in parts of a shard two by two. At WIDE
bits a tree follows nearly all edges, so this is a scan of fingerprints, and a
pair leaves its shard only if sizes and sketches allow it too. So a large group
of near copies costs its size and not its square.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from . import simhash
from .common import in_arrow, materialise, pieces, sorted_groups
from .simhash import SEED, components, keep_rows, linked

SHINGLE = 5
#: About so many documents show which shingles are common: those that so many of them have. Only the order depends on it.
SAMPLE_DOCS, COMMON = 10_000, 4
#: Bits in which fingerprints of likely near copies differ at most, and of any near copies.
NEAR, WIDE = 8, 24
#: Bits of the sketches by which shards rule out pairs; wider ones are folded.
WIDTHS = (256, 512, 1024)
#: Rows of a shard that one tree holds; shards are split so far.
TREE_ROWS = 2048
#: Pairs that a task holds, to give each of them once.
HELD_PAIRS = 100_000
#: Pairs of a node and shard that are compared before all are.
NEAREST = 4
SHARD = ("key", "side", "node", "size", "fp", "root", "sketch")
#: Bits of a set's name by which those to be compared are picked where their texts are.
NAME_BITS = 23
#: Bytes of each hash that is compared.
HASH_BYTES = 5


def shingles(text: str | None) -> np.ndarray:
    """The hashes of a text's shingles, sorted, each once; of a text of fewer words, that of all of it."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.int64)
    digest, join, found, step = xxhash.xxh64_digest, b" ".join, [], 1 << 15
    for at in range(0, max(1, len(words) - SHINGLE + 1), step):  # in blocks, as texts can be long
        part = words[at : at + step + SHINGLE - 1]
        runs = zip(*[part[k:] for k in range(SHINGLE)], strict=False) if len(words) > SHINGLE else [part]
        found.append(np.unique(np.frombuffer(b"".join([digest(join(x), SEED) for x in runs]), np.int64)))
    return found[0] if len(found) == 1 else np.unique(np.concatenate(found))


def name(found: np.ndarray) -> int:
    """A signed 64-bit hash of a set of shingles."""
    return int.from_bytes(xxhash.xxh64_digest(found.tobytes(), SEED), "big", signed=True)


def name_of(text: str | None) -> int:
    return name(shingles(text))


def simhash_of(found: np.ndarray) -> int:
    """The signed 64-bit SimHash of a set of shingles."""
    ones, step = np.zeros(64, np.int64), 1 << 15
    for at in range(0, len(found), step):
        ones += np.unpackbits(found[at : at + step].view(np.uint8)).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(found)).tobytes(), "big", signed=True)


def prefix(found: np.ndarray, common: np.ndarray) -> np.ndarray:
    """The first of a set's shingles, of which any set that is alike but not equal has one among its own first ones."""
    n = len(found)
    if n < 4:
        return found[:0]
    last = common[np.searchsorted(common, found).clip(max=len(common) - 1)] == found if len(common) else np.zeros(n, bool)
    return np.concatenate([found[~last], found[last]])[: n - (4 * n + 4) // 5 + 1]


def sketch(found: np.ndarray) -> bytes:
    """Parities of the numbers of shingles in four times as many buckets or more: those of two sets differ in no more bits than the sets do in shingles, and in hardly fewer."""
    width = max(WIDTHS[0], 4 << (len(found) - 1).bit_length()) if len(found) else WIDTHS[0]
    return np.packbits((np.bincount(found & (width - 1), minlength=width) & 1).astype(np.uint8)).tobytes()


def may_be_alike(a: bytes, b: bytes, sizes: int) -> bool:
    """False only for sketches of sets that differ too much; ``sizes`` is the sum of theirs."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    width = min(len(x), len(y))
    x, y = np.bitwise_xor.reduce(x.reshape(-1, width), axis=0), np.bitwise_xor.reduce(y.reshape(-1, width), axis=0)
    return 9 * int(np.bitwise_count(x ^ y).sum()) <= sizes


def _common(docs: DataFrame, id_col: str, text_col: str) -> np.ndarray:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            for text in batch.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(shingles(text))], names=["h"])

    share = max(1, docs.count() // SAMPLE_DOCS)
    some = docs.filter(F.pmod(F.xxhash64(id_col), F.lit(share)) == 0).select(text_col)
    often = in_arrow(some, run, "h long").groupBy("h").count().filter(F.col("count") >= COMMON).select("h")
    return np.sort(often.toArrow().column(0).to_numpy())  # of a sample of fixed size


def _named(docs: DataFrame, id_col: str, text_col: str, common: np.ndarray) -> DataFrame:
    """``id, node, size, fp, prefix, sketch`` for each row; the last two only once for each name and task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in pieces(batches):
            nodes, sizes, prints, firsts, sketches = [], [], [], [], []
            for text in batch.column(1).to_pylist():
                found = shingles(text)
                node = name(found)
                nodes.append(node)
                sizes.append(len(found))
                prints.append(simhash_of(found) if node not in seen else 0)
                firsts.append([] if node in seen else prefix(found, common))
                sketches.append(None if node in seen else sketch(found))
                seen.add(node)
            columns = [pa.array(nodes, pa.int64()), pa.array(sizes, pa.int32()), pa.array(prints, pa.int64()), pa.array(firsts, pa.list_(pa.int64())), pa.array(sketches, pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["id", "node", "size", "fp", "prefix", "sketch"])

    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return in_arrow(slim, run, slim.select("id").schema.add("node", "long").add("size", "integer").add("fp", "long").add("prefix", T.ArrayType(T.LongType())).add("sketch", T.BinaryType()))


def _sets(docs: DataFrame, text_col: str, nodes: DataFrame) -> DataFrame:
    """``node, found`` for each of ``nodes`` (and few others), with the packed hashes of its set."""
    at = F.shiftrightunsigned("node", 64 - NAME_BITS)
    bits = np.zeros(1 << NAME_BITS >> 3, np.uint8)
    each = 4096  # bytes of one of Spark's bitmaps, numbered from 1 as its positions are from 0
    for row in nodes.select((at + 1).alias("k")).groupBy(F.bitmap_bucket_number("k").alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("k")).alias("m")).collect():  # at most 1 MB
        bits[(row["b"] - 1) * each : row["b"] * each] = np.frombuffer(row["m"], np.uint8)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in pieces(batches):
            names, sets = [], []
            for text in batch.column(0).to_pylist():
                found = shingles(text)
                node = name(found)
                k = (node & (2**64 - 1)) >> (64 - NAME_BITS)
                if node not in seen and bits[k >> 3] >> (k & 7) & 1:
                    seen.add(node)
                    names.append(node)
                    sets.append(pack(found))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(sets, pa.binary())], names=["node", "found"])

    return in_arrow(docs.select(text_col), run, "node long, found binary").dropDuplicates(["node"])


def pack(found: np.ndarray) -> bytes:
    """The hashes of a set by HASH_BYTES bytes each."""
    return np.ascontiguousarray(found.astype("<i8").view(np.uint8).reshape(-1, 8)[:, :HASH_BYTES]).tobytes()


def alike(a: bytes, b: bytes) -> bool:
    """Whether two packed sets have a similarity of 0.8 or more."""
    x, y = (np.pad(np.frombuffer(s, np.uint8).reshape(-1, HASH_BYTES), ((0, 0), (0, 8 - HASH_BYTES))).view("<i8").ravel() for s in (a, b))
    return 9 * len(np.intersect1d(x, y)) >= 4 * (len(x) + len(y))


def narrow(sketch: str) -> Column:
    """A sketch cut to the bytes of the largest of WIDTHS by folding; narrower ones as they are."""
    most = WIDTHS[-1] // 8

    @F.pandas_udf("binary")
    def fold(values: pd.Series) -> pd.Series:
        return values.map(lambda x: x if len(x) <= most else np.bitwise_xor.reduce(np.frombuffer(x, np.uint8).reshape(-1, most), axis=0).tobytes())

    return fold(sketch)


def _judged(pairs: DataFrame, judge, two: str) -> DataFrame:
    """Those of ``pairs`` (``u, v``) for which ``judge`` of their columns is true."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            yield batch.select([0, 1]).filter(pa.array([judge(*x) for x in zip(*(c.to_pylist() for c in batch.columns[2:]), strict=True)], pa.bool_()))

    return materialise(in_arrow(pairs.select("u", "v", *two.split()), run, "u long, v long"))


def _alike(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, text_col: str) -> DataFrame:
    """Those of ``pairs`` (``u, v``) whose sets have a similarity of 0.8 or more."""
    ends = lambda p: p.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    known = materialise(nodes.select("node", "size", "sketch").join(ends(pairs), "node", "left_semi"))
    one, two = (known.select(F.col("node").alias(c), F.col("sketch").alias(f"s{c}"), F.col("size").alias(f"n{c}")) for c in "uv")
    possible = _judged(pairs.join(two, "v").join(one, "u").withColumn("sizes", F.expr("nu + nv")), may_be_alike, "su sv sizes")
    if possible.isEmpty():
        return possible
    sets = _sets(docs, text_col, ends(possible))
    one, two = (sets.select(F.col("node").alias(c), F.col("found").alias(f"s{c}")) for c in "uv")
    return _judged(possible.join(two, "v").join(one, "u"), alike, "su sv")


def _forest(rows: DataFrame) -> DataFrame:
    """Likely pairs ``u, v`` of each shard of ``key, node, fp, root``, sorted: of a forest, those whose roots differ."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shards in sorted_groups(batches):
            found = []
            for _, nodes, prints, roots in shards:
                if len(nodes) > 1:
                    rows = list(zip(nodes.tolist(), prints.view(np.uint64).tolist(), roots.tolist(), strict=True))
                    named = {p: (n, r) for n, p, r in rows}
                    pairs = [((n, r), named[p]) for n, p, r in rows] + [(named[a], named[b]) for a, b in linked(list(named), NEAR, every=False)]
                    found += [(a, b) for (a, x), (b, y) in pairs if x != y]
            yield _pairs(found)

    return in_arrow(rows, run, "u long, v long")


def _pairs(found: list[tuple[int, int]] | np.ndarray) -> pa.RecordBatch:
    pairs = np.array(found, np.int64).reshape(-1, 2)
    return pa.RecordBatch.from_arrays([pa.array(pairs.max(axis=1)), pa.array(pairs.min(axis=1))], names=["u", "v"])


def folded(sketches: list[bytes]) -> list[np.ndarray]:
    """Sketches as rows of bits of each of WIDTHS; of narrower ones the row is empty. A sketch folded to a smaller width is one too."""
    out = []
    for width in WIDTHS:
        rows = np.zeros((len(sketches), width // 64), np.uint64)
        for i, x in enumerate(sketches):
            if 8 * len(x) >= width:
                rows[i] = np.bitwise_xor.reduce(np.frombuffer(x, np.uint64).reshape(-1, width // 64), axis=0)
        out.append(rows)
    return out


def close_pairs(sides: np.ndarray, sizes: np.ndarray, prints: np.ndarray, roots: np.ndarray, sketches: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Places of all pairs that may be alike and whose roots differ: by fingerprints, sizes and sketches. Of two sides, pairs across alone."""
    rows, widths = folded(sketches), np.array([min(8 * len(x), WIDTHS[-1]) for x in sketches])
    across = sides[0] != sides[-1]
    first, second = [], []
    for at in range(0, len(prints), 256):
        i = np.arange(at, min(at + 256, len(prints)))[:, None]
        j = np.arange(len(prints))[None, :]
        far = np.bitwise_count(prints.view(np.uint64)[i] ^ prints.view(np.uint64)[j]) > WIDE
        ok = ~far & (roots[i] != roots[j]) & ((sides[i] < sides[j]) if across else (i < j)) & (5 * np.minimum(sizes[i], sizes[j]) >= 4 * np.maximum(sizes[i], sizes[j]))
        a, b = np.nonzero(ok)
        first.append(a + at)
        second.append(b)
    a, b = np.concatenate(first), np.concatenate(second)
    keep = np.ones(len(a), bool)
    common = np.minimum(widths[a], widths[b])
    for width, bits in zip(WIDTHS, rows, strict=True):
        some = np.flatnonzero(common == width)
        for k in range(0, len(some), 1 << 16):
            part = some[k : k + (1 << 16)]
            differ = np.bitwise_count(bits[a[part]] ^ bits[b[part]]).sum(axis=1)
            keep[part] = 9 * differ <= sizes[a[part]] + sizes[b[part]]
    return a[keep], b[keep]


def nearest_pairs(a: np.ndarray, b: np.ndarray, prints: np.ndarray, most: int) -> np.ndarray:
    """Which of the pairs are among the ``most`` of one of their ends that differ in the fewest bits."""
    bits = np.bitwise_count(prints.view(np.uint64)[a] ^ prints.view(np.uint64)[b])
    end, pair, far = np.concatenate([a, b]), np.tile(np.arange(len(a)), 2), np.tile(bits, 2)
    order = np.lexsort((pair, far, end))
    rank = np.arange(len(end)) - np.searchsorted(end[order], end[order])
    keep = np.zeros(len(a), bool)
    keep[pair[order][rank < most]] = True
    return keep


def _unjoined(rows: DataFrame, most: int | None = None) -> DataFrame:
    """Pairs ``u, v`` that may be alike and whose roots differ, of each shard of ``key, side, node, size, fp, root, sketch``, sorted; of two sides, pairs across alone. All of them, or the ``most`` nearest of each node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((0, 2), np.int64)  # a pair that shares many shingles is in many shards: once for each task, or nearly
        for shards in sorted_groups(batches):
            for _, sides, nodes, sizes, prints, roots, sketches in shards:
                if len(nodes) > 1:
                    a, b = close_pairs(sides, sizes.astype(np.int64), prints, roots, sketches)
                    if most and len(a):
                        keep = nearest_pairs(a, b, prints, most)
                        a, b = a[keep], b[keep]
                    held = np.concatenate([held, np.sort(np.stack([nodes[a], nodes[b]], axis=1), axis=1)])
                    if len(held) > HELD_PAIRS:
                        held = np.unique(held, axis=0)
                        if len(held) > HELD_PAIRS // 2:
                            yield _pairs(held)
                            held = held[:0]
        yield _pairs(np.unique(held, axis=0))

    return in_arrow(rows, run, "u long, v long")


def links(named: DataFrame, docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Edges ``u, v`` between names of sets that connect all that are alike."""
    first = named.filter("sketch is not null")
    nodes = materialise(first.select("node", "size", "fp", "sketch").dropDuplicates(["node"]))
    group = Window.partitionBy("h")
    places = first.select(F.explode("prefix").alias("h"), "node").repartition("h")
    parts = F.ceil(F.count("*").over(group) / TREE_ROWS).cast("int")
    shared = places.withColumn("low", F.min("node").over(group)).withColumn("high", F.max("node").over(group)).filter("low <> high").select("h", "node").distinct()
    # Shingles of the same sets, as those of one passage, need one shard among them.
    same_sets = F.xxhash64(F.bit_xor(F.xxhash64("node")).over(group), F.count("*").over(group))
    shared = shared.select(same_sets.alias("g"), "node", parts.alias("parts")).distinct().withColumnRenamed("g", "h")
    places = materialise(shared.join(nodes.select("node", "size", "fp"), "node"))

    by_print = materialise(nodes.filter("size > 0").groupBy("fp").agg(F.min("node").alias("least")))
    named_by = lambda c: by_print.select(F.col("fp").alias(c), F.col("least").alias(f"n{c}"))
    trees = simhash.links(by_print.select("fp")).join(named_by("v"), "v").join(named_by("u"), "u").select(F.col("nu").alias("u"), F.col("nv").alias("v"))
    same = nodes.filter("size > 0").join(by_print, "fp").filter("node <> least").select(F.col("node").alias("u"), F.col("least").alias("v"))
    candidates = trees.union(same).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    sketches = nodes.select("node", narrow("sketch").alias("sketch"))
    part = F.pmod(F.xxhash64(F.lit(0), "node"), F.col("parts"))
    dealt = places.select(F.xxhash64("h", part).alias("key"), "node", "fp", F.col("node").alias("root"))
    likely = _forest(dealt.repartition("key").sortWithinPartitions("key", "fp", "node"))
    edges, seed = _alike(materialise(likely.union(candidates).distinct()), nodes, docs, text_col), 0
    while True:
        # Only shards that are not of one component yet; of large ones a part each time, as nodes are dealt anew.
        rooted = places.drop("parts").join(components(edges), "node", "left").withColumn("root", F.coalesce("root", "node"))
        mixed = rooted.withColumn("low", F.min("root").over(group)).withColumn("high", F.max("root").over(group)).withColumn("parts", parts)
        open_ = materialise(mixed.filter("low <> high").drop("low", "high"))
        if open_.isEmpty():
            return edges
        if seed and (found == 0 or open_.filter("parts > 1").isEmpty()):
            break
        seed += 1
        part = F.pmod(F.xxhash64(F.lit(seed), "node"), F.col("parts"))
        dealt = open_.select(F.xxhash64("h", part).alias("key"), F.lit(0).alias("side"), "node", "size", "fp", "root").join(sketches, "node").select(*SHARD)
        near = materialise(_unjoined(dealt.repartition("key").sortWithinPartitions("key", "fp", "node"), NEAREST).distinct())
        more = _alike(near, nodes, docs, text_col)
        edges, found = materialise(edges.union(more)), more.count()
    mine, other = F.pmod(F.xxhash64("node"), F.col("parts")), F.explode(F.expr("sequence(0, parts - 1)"))
    dealt = open_.withColumn("mine", mine).withColumn("other", other)
    key = F.xxhash64("h", F.least("mine", "other"), F.greatest("mine", "other"))
    dealt = dealt.select(key.alias("key"), (F.col("mine") > F.col("other")).cast("int").alias("side"), "node", "size", "fp", "root").join(sketches, "node").select(*SHARD)
    pairs = materialise(_unjoined(dealt.repartition("key").sortWithinPartitions("key", "side", "fp", "node")).distinct())
    return materialise(edges.union(_alike(pairs, nodes, docs, text_col)))


def keep_one_alike(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group of near copies, that of the smallest id; the columns of ``docs``.

    A group is what links reach. Letters A to Z count as small ones and all white
    space as one space. Texts without words (null, empty, white space) are alike.
    Rows that repeat an id are one document: one of them stays. A group in which
    no row has an id keeps one row. An empty table gives no rows.
    """
    named = materialise(_named(docs, id_col, text_col, _common(docs, id_col, text_col)))
    roots = components(links(named, docs, text_col))
    folded = named.groupBy("node").agg(F.min("id").alias("least")).join(roots, "node", "left")
    mapped = materialise(folded.select("node", F.coalesce("root", "node").alias("root"), "least"))
    groups = materialise(mapped.groupBy("root").agg(F.min("least").alias("least"), F.min("node").alias("node")))
    own = groups.filter("least is not null").select(F.col("least").alias("id")).distinct()
    dropped = named.filter("id is not null").select("id").distinct().join(own, "id", "left_anti")
    return keep_rows(docs, named.select("id"), dropped, groups.filter("least is null").select(F.col("node").alias("fp")), name_of, id_col, text_col)

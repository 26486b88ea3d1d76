"""Near copies by their shingles, against all pairs."""

import random
from pathlib import Path

import numpy as np
import pytest

from tidelake.llm import similar

DATA = "/root/testdata/sf0.01"
needs_data = pytest.mark.skipif(not Path(DATA).exists(), reason="needs the driver's tables")


def kept_by_hand(rows):
    sets, roots = {}, {}
    for i, text in rows:
        words = (text or "").lower().split()
        sets[i] = {" ".join(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()
    ids = sorted(sets)

    def root(i):
        while roots.get(i, i) != i:
            i = roots[i]
        return i

    for i in ids:
        for j in ids:
            if j < i and root(i) != root(j):
                common = len(sets[i] & sets[j])
                if sets[i] == sets[j] or 5 * common >= 4 * (len(sets[i]) + len(sets[j]) - common) > 0:
                    a, b = root(i), root(j)
                    roots[max(a, b)] = min(a, b)
    return {i for i in ids if root(i) == i}


def made_up(n=6):
    rng = random.Random(8)
    fresh = lambda k: [f"{rng.choice('abcdefgh')}{rng.randrange(4000)}" for _ in range(k)]
    line, rows = fresh(12), []
    for _ in range(n):
        base = fresh(rng.randrange(20, 120))
        for edits in (0, 0, 1, 1, 2, 3, 4, 6):
            words = list(base)
            for _ in range(edits):
                words[rng.randrange(len(words))] = fresh(1)[0]
            rows.append(" ".join(words))
        rows += [" ".join(line + fresh(k)) for k in (0, 1, 2, 3, 5, 40)]
    rows += [None, "", " \n", "one two", "One  TWO", "one two three four five", "one two three four five six"]
    rng.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize(("tree", "common"), [(2048, 4), (16, 10**9)])
def test_all_near_copies_are_found(spark, monkeypatch, tree, common):
    monkeypatch.setattr(similar, "TREE_ROWS", tree)  # shards in many parts
    monkeypatch.setattr(similar, "COMMON", common)
    rows = made_up()
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    kept = kept_by_hand(rows)
    assert {r["doc_id"] for r in similar.keep_one_alike(d).collect()} == kept and len(kept) < len(rows) - 30


def test_sketches_rule_out_nothing_alike():
    rng, out = np.random.default_rng(1), 0
    for n in (4, 9, 64, 65, 300, 1030, 5000):
        for share in (0.7, 0.8, 0.81, 0.9, 1.0, 0.0):
            x = rng.integers(-(2**63), 2**63, n)
            y = np.concatenate([x[: round(share * n)], rng.integers(-(2**63), 2**63, rng.integers(0, 1 + n // 5))])
            common = len(np.intersect1d(x, y))
            may = similar.may_be_alike(similar.sketch(x), similar.sketch(y), len(x) + len(y))
            assert may or 5 * common < 4 * (len(x) + len(y) - common)
            out += not may
    assert out > 5


def test_rows_without_ids_and_repeated_ids(spark):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(None, text), (None, text + " more"), (3, "a b c"), (3, "a b c"), (None, "A b C"), (None, None)]
    kept = similar.keep_one_alike(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"] or 0, (r["text"] or "")[:5]) for r in kept) == [(0, ""), (0, "w0 w1"), (3, "a b c")]
    assert similar.keep_one_alike(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@needs_data
def test_the_stage_removes_near_copies(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    kept = {r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs, DATA).collect()}
    for low, high in [(643, 770), (582, 875), (709, 944), (2, 56), (1, 255)]:  # the pairs of different texts that are alike
        assert not {low, high} <= kept


def test_shards_give_all_pairs_that_may_be_alike():
    rng, sets = np.random.default_rng(5), []
    for n in (3, 8, 40, 130, 600, 1500):
        base = rng.integers(-(2**63), 2**63, n)
        for k in (0, 0, 1, n // 20, n // 9, n // 4, n // 2):
            sets.append(np.unique(np.concatenate([base[k:], rng.integers(-(2**63), 2**63, k // 2)])))
    sizes, prints = np.array([len(x) for x in sets]), np.array([similar.simhash_of(x) for x in sets])
    sketches = [similar.sketch(x)[:] for x in sets]
    cut = [s if len(s) <= 64 else np.bitwise_xor.reduce(np.frombuffer(s, np.uint8).reshape(-1, 64), axis=0).tobytes() for s in sketches]
    for sides in (np.zeros(len(sets), int), (np.arange(len(sets)) % 2)):
        order = np.argsort(sides, kind="stable")
        a, b = similar.close_pairs(sides[order], sizes[order], prints[order], np.arange(len(sets)), [cut[i] for i in order])
        found = {frozenset((int(order[x]), int(order[y]))) for x, y in zip(a, b, strict=True)}
        every = {frozenset((i, j)) for i in range(len(sets)) for j in range(i) if sides[i] != sides[j] or not sides.any()}
        alike = {p for p in every if similar.alike(*[similar.pack(sets[i]) for i in p])}
        assert alike <= found <= every and len(found) < len(every) / 3


def test_packed_sets_are_compared_as_sets():
    rng = np.random.default_rng(4)
    for n in (0, 1, 4, 5, 9, 400):
        for k in (0, 1, n // 10, n // 5 + 1):
            x = np.unique(rng.integers(-(2**63), 2**63, n))
            y = np.unique(np.concatenate([x[k:], rng.integers(-(2**63), 2**63, k // 2)]))
            common = len(np.intersect1d(x, y))
            assert similar.alike(similar.pack(x), similar.pack(y)) == (5 * common >= 4 * (len(x) + len(y) - common))


def test_columns_may_have_any_name(spark):
    names = ["doc_id", "text", "id", "node", "fp", "_kept", "_fp", "_c0", "_C1", "u", "v", "root", "least"]
    rows = [(i, t, *["x"] * (len(names) - 2)) for i, t in [(1, "a b c d e f"), (2, "a b c d e f"), (3, None), (None, "a b c"), (2, "z")]]
    kept = similar.keep_one_alike(spark.createDataFrame(rows, ["doc_id long, text string", *[f"`{n}` string" for n in names[2:]]] and ", ".join(["doc_id long", "text string", *[f"`{n}` string" for n in names[2:]]])))
    assert kept.columns == names and sorted((r["doc_id"] or 0) for r in kept.collect()) in ([0, 1, 3], [0, 1, 2, 3])

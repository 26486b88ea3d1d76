"""Document fingerprints by a Merkle tree over paragraphs and sections (operator 6).

Leaves are runs of words of a paragraph (1, 2 and 4 words, then LEAF_WORDS each,
so that short texts have some too; what has no space in UNIT characters is cut
there), paragraphs are lines, and a section ends at an empty line or where a
paragraph's digest says so, so that an insertion moves the bounds of its own
section only. Every inner node is the digest of its children's digests. A
fingerprint is text:

    root / section , paragraph : leaves , paragraph : leaves / section ...

Equal roots mean equal texts. Two texts are compared from the root down: equal
sections are taken as they are, then equal paragraphs of the sections that are
left, then equal leaves of the paragraphs that are left. What remains is where
they differ.
"""

from __future__ import annotations

import hashlib
import json
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import zip_longest

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import in_arrow, pieces

LEAF_WORDS, UNIT = 8, 32
#: Hex digits that a fingerprint shows of the root, of a section or paragraph, and of a leaf.
ROOT_HEX, NODE_HEX, LEAF_HEX = 32, 8, 6
#: A paragraph ends its section if the first byte of its digest is a multiple of this.
SECTION_MOD = 8


_UNITS = re.compile(rf"[^ ]{{1,{UNIT}}} ?| ")


def _digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


def fingerprint(text: str) -> str:
    """The tree of a text. Every character is under some leaf: nothing is normalised."""
    sections: list[str] = []
    section_digests: list[bytes] = []
    paragraphs: list[str] = []
    digests: list[bytes] = []

    def close() -> None:
        node = _digest(b"s" + b"".join(digests))
        section_digests.append(node)
        sections.append(node.hex()[:NODE_HEX] + "," + ",".join(paragraphs))
        paragraphs.clear()
        digests.clear()

    if text:
        for line in text.split("\n"):
            words = _UNITS.findall(line) or [""]
            cuts = [c for c in (0, 1, 3) if c < len(words)] + list(range(7, len(words), LEAF_WORDS))
            leaves = [_digest("".join(words[a:b]).encode()) for a, b in zip_longest(cuts, cuts[1:])]
            node = _digest(b"p" + b"".join(leaves))
            digests.append(node)
            paragraphs.append(node.hex()[:NODE_HEX] + ":" + "".join([x.hex()[:LEAF_HEX] for x in leaves]))
            if not line or node[0] % SECTION_MOD == 0:
                close()
        if digests:
            close()
    return "/".join([_digest(b"r" + b"".join(section_digests)).hex()[:ROOT_HEX], *sections])


def _branches(print_: str) -> list[tuple[str, list[str]]]:
    """Each section's digest and its paragraphs, each still one text."""
    return [(x[:NODE_HEX], x[NODE_HEX + 1 :].split(",")) for x in print_.split("/")[1:]]


def _leaves(paragraph: str) -> list[str]:
    return [paragraph[i : i + LEAF_HEX] for i in range(NODE_HEX + 1, len(paragraph), LEAF_HEX)]


def _count(paragraphs: list[str]) -> int:
    """Leaves of paragraphs."""
    return sum(len(p) - NODE_HEX - 1 for p in paragraphs) // LEAF_HEX


@dataclass
class Comparison:
    """What two trees share, and where the second one differs: its paragraphs that are not in the first one, counted through all sections."""

    common: int
    total: int
    differing: list[int]

    @property
    def likeness(self) -> float:
        """Twice the common leaves over all; 1 for equal texts."""
        return 2 * self.common / self.total if self.total else 1.0

    @property
    def edits(self) -> str:
        """The differing paragraphs as ranges "first-last", joined by commas."""
        ranges: list[list[int]] = []
        for i in self.differing:
            if ranges and ranges[-1][1] == i - 1:
                ranges[-1][1] = i
            else:
                ranges.append([i, i])
        return ",".join(f"{a}-{b}" for a, b in ranges)


def compare(a: str, b: str) -> Comparison:
    """Descends two trees together; an equal node is not opened."""
    if a[:ROOT_HEX] == b[:ROOT_HEX]:
        n = sum(_count(p) for _, p in _branches(a))
        return Comparison(n, 2 * n, [])
    old, new = _branches(a), _branches(b)
    total = sum(_count(p) for _, p in old) + sum(_count(p) for _, p in new)
    here, there = Counter(s for s, _ in new), Counter(s for s, _ in old)
    shared = here & there
    skip, common, left = Counter(shared), 0, []
    for node, paragraphs in old:
        if skip[node] > 0:
            skip[node] -= 1
        else:
            left += paragraphs
    ours = Counter(left)
    skip, open_, at = Counter(shared), [], 0
    for node, paragraphs in new:
        if skip[node] > 0:
            skip[node] -= 1
            common += _count(paragraphs)
        else:
            for i, p in enumerate(paragraphs, at):
                if ours[p] > 0:
                    ours[p] -= 1
                    common += _count([p])
                else:
                    open_.append((i, p))
        at += len(paragraphs)
    if open_:
        rest = Counter(x for p, n in ours.items() for x in _leaves(p) * n)
        common += sum((rest & Counter(x for _, p in open_ for x in _leaves(p))).values())
    return Comparison(common, total, [i for i, _ in open_])


def likeness(a: str, b: str) -> float:
    return compare(a, b).likeness


def edited(text: str, following: str) -> str:
    """``text`` with its last half replaced by the beginning of ``following``."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


KEY = "struct<none:boolean,down:bigint,hash:bigint>"


def _range_of(bounds: Column, n: int) -> Column:
    """How many of ``n`` ascending bounds are at or below the key. Two short scans, not one long one."""
    if not n:
        return F.lit(0)
    step = math.isqrt(n) + 1
    below = lambda values: F.size(F.filter(values, lambda b: b <= F.col("key")))
    group = below(F.filter(bounds, lambda _, i: i % step == 0))
    return F.when(group == 0, 0).otherwise((group - 1) * step + below(F.slice(bounds, (group - 1) * step + 1, step)))


def deal_with_next(docs: DataFrame, id_col: str, text_col: str, parts: int) -> DataFrame:
    """Rows dealt to ``parts`` ranges of ids in descending order, each followed by the first rows of the next range.

    Gives ``id, text, own``, sorted in each partition by range; ``own`` is false
    for what is there only to follow. The last range is followed by the first.
    Rows of one id, or of none, are ordered and dealt by a hash of their text, so
    an id that many rows have takes several ranges. Bounds come from a sample of
    ids and hashes, and each text is moved once.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(text_col, F.lit("")).alias("text"))
    key = F.struct(F.col("id").isNull().alias("none"), F.coalesce(F.bitwise_not("id"), F.lit(0)).cast("long").alias("down"), F.xxhash64("text").alias("hash"))
    keyed = rows.withColumn("key", key)
    share = min(1.0, min(100 * parts, 1_000_000) / max(1, docs.count()))
    drawn = keyed.filter(F.pmod(F.xxhash64(F.lit(3), "key"), F.lit(1 << 20)) < share * (1 << 20)).select("key.*").distinct()
    sample = sorted(tuple(r) for r in drawn.collect()) if parts > 1 else []  # about 100 for each range, a million at most
    cuts = sorted({sample[len(sample) * i // parts] for i in range(1, parts)}) if sample else []
    bounds = F.from_json(F.lit(json.dumps([{"none": n, "down": d, "hash": h} for n, d, h in cuts])), f"array<{KEY}>")
    ranged = keyed.withColumn("range", _range_of(bounds, len(cuts)).cast("int"))
    heads = ranged.groupBy("range").agg(F.min("key").alias("head")).orderBy("range").collect()  # a row per range
    follows = json.dumps([{"head": nxt["head"].asDict(), "before": row["range"]} for row, nxt in zip(heads, heads[1:] + heads[:1], strict=True)])
    follows = docs.sparkSession.range(1).select(F.inline(F.from_json(F.lit(follows), f"array<struct<head:{KEY},before:int>>")))
    ranged = ranged.join(F.broadcast(follows), F.col("key") == F.col("head"), "left")  # as many rows as ranges
    to = F.array_compact(F.array(F.struct("range", F.lit(True).alias("own")), F.when(F.col("before").isNotNull(), F.struct(F.col("before").alias("range"), F.lit(False).alias("own")))))
    dealt = ranged.select("id", "text", "key", F.inline(to))
    return dealt.repartitionById(len(cuts) + 1, "range").sortWithinPartitions("range", F.desc("own"), "key", "text").select("id", "text", "own")


PRINTS = "n_chars long, edited_text string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, edits string"


def fingerprint_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of each text and of its edited text, and how alike they are.

    Returns ``id_col, n_chars, edited_text, fingerprint, edited_fingerprint,
    near_edited, near_next, edits``; ``edits`` names the paragraphs of the edited
    text that the tree finds changed. Ids are whole numbers; what cannot be read
    as one is null. The next document is the next one in descending order of
    ids, null ids last, rows of one id ordered by a hash of their text; after
    the last comes the first, so a single document is its own next one. A null
    text counts as empty; two empty texts are alike (1), an empty and another
    one are not (0). Texts of any length are fingerprinted whole. Repeated rows give
    repeated rows, an empty table none; other columns are ignored.
    """
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting = None
        for batch in pieces(batches):
            out = []
            for id_, text, own in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                now = (id_, text, fingerprint(text)) if own or waiting else None
                if waiting:
                    out.append(_compared(waiting, now))
                waiting = now if own else None
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=arrow)

    arrow = pa.schema([("id", pa.int64()), ("n_chars", pa.int64()), *[(c, pa.string()) for c in ("edited_text", "fingerprint", "edited_fingerprint")], ("near_edited", pa.float64()), ("near_next", pa.float64()), ("edits", pa.string())])
    dealt = deal_with_next(docs, id_col, text_col, parts)
    return in_arrow(dealt, run, f"id long, {PRINTS}").withColumnRenamed("id", id_col)


def _compared(row: tuple[int, str, str], following: tuple[int, str, str]) -> dict:
    id_, text, print_ = row
    new = edited(text, following[1])
    new_print = fingerprint(new)
    change = compare(print_, new_print)
    return {"id": id_, "n_chars": len(text), "edited_text": new, "fingerprint": print_, "edited_fingerprint": new_print, "near_edited": change.likeness, "near_next": likeness(print_, following[2]), "edits": change.edits}

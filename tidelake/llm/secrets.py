"""Secret scans with corpus-wide ownership frequency (operator 7).

Patterns find candidates in each text. Every candidate value is hashed, and the
hashes are counted over the corpus by distinct repositories (documents) and
owners (sources). A value that many owners or many repositories have is a widely
copied example; one that stays with one or two owners, in few repositories, and
looks random is a live credential of theirs. The verdict also admits long
random-looking values that no pattern names: those become spans of their own
kind, ``owned``. Slugs, paths and numbered names are none: they are words when
they are cut at hyphens, underscores and slashes.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import in_arrow, materialise, maybe_broadcast, pieces, unused

#: The three base patterns, in the order of their kinds.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
KINDS = ("assign", "access", "hex", "owned")
#: What a text must contain to have an assignment.
_WORDS = ("password", "passwd", "secret", "token", "api")
_LONG = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
#: A value is live if so many owners and repositories have it at most, and a random one must have so many bits of entropy a character.
MAX_OWNERS, MAX_REPOSITORIES, MIN_ENTROPY = 2, 50, 3.0
#: A value that no pattern names must hold a part of so many letters and digits, that change so often from one to the other.
PART, CHANGES = 16, 4
#: Spans of a corpus that may be broadcast to its rows, after they were counted; each has four numbers.
BROADCAST_SPANS = 100_000


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(start, kind, end, value) of the base matches that are long enough; value is the credential."""
    found = []
    folded = text.lower()
    if any(w in folded for w in _WORDS):
        found += [(m.start(), 0, m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end(), m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    if _LONG.search(text):
        found += [(m.start(), 2, m.end(), m[0]) for m in _HEX_RUN.finditer(text)]
    return sorted(found)


#: The same as HEX with shorter matches dropped, since runs are matched whole.
_HEX_RUN = re.compile(r"[0-9a-f]{24,}")


def looks_random(value: str) -> bool:
    """Letters and digits, and many different ones."""
    if not (any(c.isdigit() for c in value) and any(c.isalpha() for c in value)):
        return False
    n = len(value)
    return -sum(k / n * math.log2(k / n) for k in Counter(value).values()) >= MIN_ENTROPY


_PARTS = re.compile(rf"[A-Za-z0-9+=]{{{PART},}}")
_CHANGE = re.compile(r"[A-Za-z](?=[0-9])|[0-9](?=[A-Za-z])")


def looks_like_a_key(value: str) -> bool:
    """Random, in a part that is not put together from words and numbers."""
    return any(looks_random(p) and len(_CHANGE.findall(p)) >= CHANGES for p in _PARTS.findall(value))


def other_candidates(text: str, base: list[tuple[int, int, int, str]]) -> list[tuple[int, int, int, str]]:
    """Long random-looking values that lie outside all base spans."""
    if not (matches := list(_LONG.finditer(text))):
        return []
    found, at, reach = [], 0, 0
    for m in matches:  # both are in order, so the base spans are gone through once
        while at < len(base) and base[at][0] < m.end():
            reach = max(reach, base[at][2])
            at += 1
        if reach <= m.start() and looks_like_a_key(m[0]):
            found.append((m.start(), 3, m.end(), m[0]))
    return found


def _name(value: str) -> str:
    return hashlib.sha256(value.encode()).hexdigest()[:32]


CANDIDATES = "array<struct<start:int,kind:int,stop:int,hash:string,random:boolean>>"


def candidates(docs: DataFrame, id_col: str, owner_col: str, text_col: str) -> DataFrame:
    """``row, id_col, owner, print, found`` for each row; ``print`` is a hash of its text and ``found`` has the candidates in order. Hashes only, no values."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fields = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("stop", pa.int32()), ("hash", pa.string()), ("random", pa.bool_())]))
        for batch in pieces(batches):
            found = []
            for text in batch.column(3).to_pylist():
                base = base_spans(text or "")
                spans = sorted(base + other_candidates(text or "", base))
                found.append([{"start": a, "kind": k, "stop": b, "hash": _name(v), "random": looks_random(v)} for a, k, b, v in spans])
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(found, fields)], names=[id_col, "owner", "print", "found"])

    slim = docs.select(F.col(id_col), F.col(owner_col).cast("string").alias("owner"), F.xxhash64(text_col).alias("print"), F.col(text_col).alias("text"))
    return materialise(in_arrow(slim, run, f"`{id_col}` {dict(slim.dtypes)[id_col]}, owner string, print long, found {CANDIDATES}")).withColumn("row", F.monotonically_increasing_id())


def ownership(found: DataFrame) -> DataFrame:
    """``hash, repositories, owners, live`` for each candidate value of the corpus.

    Each row is a repository; a null owner is an owner. Folded by (hash, owner)
    before it is shuffled by hash, so a value in a third of all rows costs one
    row for each task and owner.
    """
    once = found.select("owner", F.explode(F.array_distinct(F.transform("found", lambda x: F.struct(x["hash"].alias("hash"), x["random"].alias("random"))))).alias("c"))
    each = once.groupBy("c.hash", "owner").agg(F.count("*").alias("repositories"), F.first("c.random").alias("random"))
    total = each.groupBy("hash").agg(F.sum("repositories").alias("repositories"), F.count("*").alias("owners"), F.first("random").alias("random"))
    return total.select("hash", "repositories", "owners", ((F.col("owners") <= MAX_OWNERS) & (F.col("repositories") <= MAX_REPOSITORIES) & F.col("random")).alias("live"))


def _joined(spans: Column) -> Column:
    named = F.transform(spans, lambda x: F.concat_ws(":", F.element_at(F.array(*map(F.lit, KINDS)), x["kind"] + 1), x["start"], x["stop"]))
    return F.array_join(named, ",")


def scan(docs: DataFrame, id_col: str = "doc_id", owner_col: str = "source", text_col: str = "text") -> DataFrame:
    """Secrets of each row: ``id_col, n_assign, n_access, n_hex, base, spans, n_live, n_copied, judged, print``.

    ``base`` and ``spans`` name kind:start:end in code points, by start and then
    kind; ``judged`` has them as structs with their verdict. Base spans always
    stay; a value no base pattern names is a span only if it is judged live. A
    null or empty text has none. Repeated rows count as repositories of their
    own. An empty table gives no rows; other columns are ignored.
    """
    rows = candidates(docs, id_col, owner_col, text_col)
    verdicts = materialise(ownership(rows))
    some = rows.filter(F.size("found") > 0)
    each = some.select("row", F.inline("found")).join(maybe_broadcast(verdicts), "hash").filter((F.col("kind") < 3) | F.col("live"))
    spans = each.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "kind", "stop", "live"))).alias("judged"))  # of one text
    none = F.array().cast("array<struct<start:int,kind:int,stop:int,live:boolean>>")
    full = some.join(spans, "row", "left").select(id_col, "print", F.coalesce("judged", none).alias("judged")).union(rows.filter(F.size("found") == 0).select(id_col, "print", none))
    base = F.filter("judged", lambda x: x["kind"] < 3)
    count = lambda kind: F.size(F.filter("judged", lambda x: x["kind"] == kind)).cast("long")
    live = F.size(F.filter("judged", lambda x: x["live"])).cast("long")
    return full.select(id_col, count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), _joined(base).alias("base"), _joined(F.col("judged")).alias("spans"), live.alias("n_live"), (F.size("judged") - live).alias("n_copied"), "judged", "print")


def _mask(text: str, judged: list[dict]) -> str:
    """``text`` with its spans replaced; overlapping ones are replaced as one, live if any of them is."""
    out, at, merged = [], 0, []
    for span in judged:
        if merged and span["start"] < merged[-1]["stop"]:
            merged[-1] = merged[-1] | {"stop": max(merged[-1]["stop"], span["stop"]), "live": merged[-1]["live"] or span["live"]}
        else:
            merged.append(span)
    for span in merged:
        out += [text[at : span["start"]], f"<{'secret' if span['live'] else 'example'}:{KINDS[span['kind']]}>"]
        at = span["stop"]
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, id_col: str = "doc_id", owner_col: str = "source", text_col: str = "text") -> DataFrame:
    """``docs`` with every secret replaced by its kind and verdict; all rows and columns stay.

    Spans are matched to rows by id and text, so repeated and null ids do no harm.
    A null text stays null.
    """
    found = scan(docs, id_col, owner_col, text_col)
    id_, print_, judged_ = unused(docs, 3)
    spans = materialise(found.filter(F.size("judged") > 0).select(F.col(id_col).alias(id_), F.col("print").alias(print_), F.col("judged").alias(judged_)).dropDuplicates([id_, print_]))
    if spans.agg(F.coalesce(F.sum(F.size(judged_)), F.lit(0))).first()[0] <= BROADCAST_SPANS:
        spans = F.broadcast(spans)
    joined = docs.join(spans, docs[id_col].eqNullSafe(spans[id_]) & (F.xxhash64(docs[text_col]) == spans[print_]), "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            texts, judged = batch.column(at).to_pylist(), batch.column(batch.num_columns - 1).to_pylist()
            masked = [_mask(t, j) if t and j else t for t, j in zip(texts, judged, strict=True)]
            columns = [pa.array(masked, pa.string()) if i == at else batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    at, names = docs.columns.index(text_col), docs.columns
    return in_arrow(joined.select(*[F.col(f"`{c}`") for c in docs.columns], judged_), run, docs.schema)

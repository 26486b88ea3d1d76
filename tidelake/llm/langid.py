"""Language identification by bit-sliced Bloom filters over n-grams (operator 1).

One table of bit masks serves all languages: bit ``l`` of entry ``i`` is bit
``i`` of language ``l``'s Bloom filter. The bitwise AND of an n-gram's entries
has a bit for each language that holds the n-gram. A text's n-grams are looked
up, the bits counted per language, each count corrected for that filter's false
positives, and the largest wins.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, in_arrow, pieces

#: Characters of an n-gram, hash functions of a filter, and filter bits for each n-gram held.
ORDERS, HASHES, BITS_PER_GRAM = (2, 3, 4), 2, 10
#: Training takes about so many documents of each language, of at most so many characters.
SAMPLE_DOCS, SAMPLE_CHARS = 600, 50_000
#: A language holds an n-gram if at least MIN_DOCS of its sampled documents do, and
#: a share of them that is at least MIN_SHARE of the largest share of any language.
MIN_DOCS, MIN_SHARE = 2, 0.34
#: Characters that are looked up at a time.
BLOCK = 1 << 18

_LETTER = regex.compile(r"\p{L}")
_GAPS = regex.compile(r"[^\p{L}]+")
_FACTOR = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5], np.uint64)


def grams(text: str) -> Iterator[np.ndarray]:
    """Hashes of all n-grams of the letters of a text, words parted by one space, in blocks."""
    letters = " " + _GAPS.sub(" ", text.lower()).strip() + " "
    points = np.frombuffer(letters.encode("utf-32-le"), np.uint32)
    overlap = max(ORDERS) - 1
    for start in range(0, max(1, len(points) - overlap), BLOCK):
        block = points[start : start + BLOCK + overlap].astype(np.uint64)
        last = start + BLOCK + overlap >= len(points)
        for n in ORDERS:
            size = len(block) - n + 1 if last else BLOCK
            if size <= 0:
                continue
            h = np.full(size, n, np.uint64)
            for k in range(n):
                h += (block[k : k + size] + np.uint64(1)) * _FACTOR[k]
                h ^= h >> np.uint64(29)
                h *= _FACTOR[0]
            yield h ^ (h >> np.uint64(32))


@dataclass
class Filters:
    """``table[i]`` has in bit ``l`` of its bytes whether language ``l``'s filter has bit ``i`` set."""

    languages: list[str]
    table: np.ndarray  # positions x bytes
    false_rate: np.ndarray  # of each language
    default: str  # the language of most training documents

    @staticmethod
    def places(hashes: np.ndarray, size: int) -> list[np.ndarray]:
        low, high = hashes & np.uint64(0xFFFFFFFF), hashes >> np.uint64(32)
        return [((low + np.uint64(k) * (high | np.uint64(1))) & np.uint64(size - 1)).astype(np.int64) for k in range(HASHES)]

    @classmethod
    def build(cls, held: dict[str, np.ndarray], default: str) -> Filters:
        languages = sorted(held)
        most = max((len(x) for x in held.values()), default=1)
        size = 1 << max(10, int(np.ceil(np.log2(max(1, most) * BITS_PER_GRAM))))
        table = np.zeros((size, (len(languages) + 7) // 8), np.uint8)
        for i, language in enumerate(languages):
            for at in cls.places(held[language], size):
                table[at, i // 8] |= np.uint8(1 << i % 8)
        fill = np.array([np.count_nonzero(table[:, i // 8] & (1 << i % 8)) / size for i in range(len(languages))])
        return cls(languages, table, fill**HASHES, default)

    def counts(self, text: str) -> tuple[np.ndarray, int]:
        """How many n-grams each language is said to hold, and of how many."""
        total, found = 0, np.zeros(8 * self.table.shape[1], np.int64)
        bits = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little")
        for hashes in grams(text):
            total += len(hashes)
            places = self.places(hashes, len(self.table))
            for byte in range(self.table.shape[1]):
                column = self.table[:, byte]
                mask = column[places[0]]
                for at in places[1:]:
                    mask &= column[at]
                found[8 * byte : 8 * byte + 8] += np.bincount(mask, minlength=256) @ bits
        return found[: len(self.languages)], total

    def predict(self, text: str | None) -> tuple[str, float]:
        """The language and a score: its corrected count over those of the two best. ``und`` and 0 without a letter."""
        if not text or not self.languages or not _LETTER.search(text):
            return "und", 0.0
        found, total = self.counts(text)
        true = np.maximum(0, (found - total * self.false_rate) / (1 - self.false_rate))
        best = int(np.argmax(true))
        if true[best] <= 0:
            return self.default, 0.0
        second = np.max(np.delete(true, best), initial=0.0)
        return self.languages[best], float(true[best] / (true[best] + second))


def train(labelled: DataFrame, lang_col: str, text_col: str, id_col: str, sample_docs: int = SAMPLE_DOCS) -> Filters:
    """Filters from about ``sample_docs`` documents of each language, chosen by a hash of their text.

    N-grams are counted where the documents are; the driver gets those that at
    least MIN_DOCS sampled documents of a language have.
    """
    known = labelled.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & (F.length(text_col) <= SAMPLE_CHARS))
    per = {r[0]: r[1] for r in known.groupBy(F.col(lang_col).cast("string")).count().collect()}  # a row per language
    if not per:
        return Filters([], np.zeros((1024, 1), np.uint8), np.zeros(0), "und")
    alone = [lang for lang, n in per.items() if n < MIN_DOCS]  # what a language of one document has counts
    share = F.create_map(*[F.lit(x) for lang, n in per.items() for x in (lang, min(1.0, sample_docs / n))])[F.col(lang_col).cast("string")]
    drawn = F.pmod(F.xxhash64(F.lit(5), text_col, id_col), F.lit(1 << 20)) < share * (1 << 20)
    sample = known.filter(drawn).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            by: dict[str, list[np.ndarray]] = {}
            docs: dict[str, int] = {}
            for lang, text in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if _LETTER.search(text):
                    by.setdefault(lang, []).append(np.unique(np.concatenate(list(grams(text)))))
                    docs[lang] = docs.get(lang, 0) + 1
            for lang, sets in by.items():
                values, n = np.unique(np.concatenate(sets), return_counts=True)
                for at in range(0, len(values), 50_000):
                    part = values[at : at + 50_000].view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(part)), pa.array(part), pa.array(n[at : at + 50_000].astype(np.int64))], names=["lang", "gram", "n"])
                yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([None], pa.int64()), pa.array([docs[lang]], pa.int64())], names=["lang", "gram", "n"])

    counted = in_arrow(sample, run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).filter((F.col("n") >= MIN_DOCS) | F.col("lang").isin(alone) | F.col("gram").isNull())
    table = counted.toArrow()  # n-grams of a bounded sample
    langs, values, n = np.array(table["lang"].to_pylist(), object), table["gram"], table["n"].to_numpy()
    is_total = np.asarray(values.is_null())
    grams_ = values.fill_null(0).to_numpy().view(np.uint64)
    docs = {lang: int(n[is_total & (langs == lang)].sum()) for lang in set(langs)}
    docs = {lang: k for lang, k in docs.items() if k}
    keep = ~is_total
    langs, grams_, shares = langs[keep], grams_[keep], n[keep] / np.array([docs[x] for x in langs[keep]])
    unique, inverse = np.unique(grams_, return_inverse=True)
    top = np.zeros(len(unique))
    np.maximum.at(top, inverse, shares)
    held = {lang: grams_[(langs == lang) & (shares >= MIN_SHARE * top[inverse])] for lang in docs}
    return Filters.build(held, max(per, key=lambda x: (per[x], x)))


def identify(docs: DataFrame, filters: Filters, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, lang_pred, score`` for each row of ``docs``.

    ``score`` is 0 to 1. A text that is null or has no letter is ``und`` with
    score 0, and so is every text if nothing was learned. A text whose n-grams
    no language holds gets the language of most training documents and score 0;
    between equal counts the first language in order wins. Whole texts are
    read, in blocks. Repeated rows give repeated rows; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(filters)  # n-grams of a bounded sample

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            found = [shared.value.predict(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())], names=[id_col, "lang_pred", "score"])

    slim = docs.select(id_col, text_col)
    return in_arrow(slim, run, slim.select(id_col).schema.add("lang_pred", "string").add("score", "double"))


def train_and_identify(docs: DataFrame, modulus: int = 4, remainder: int = 2, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """identify() all of ``docs``, learning from the rows that are not held out."""
    filters = train(docs.filter(~held_out(modulus, remainder, id_col)), lang_col, text_col, id_col)
    found = identify(docs, filters, id_col, text_col)
    return found.select(id_col, held_out(modulus, remainder, id_col).alias("held_out"), "lang_pred", "score")

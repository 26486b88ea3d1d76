"""Quality classification by a regularised quadratic discriminant (operator 4).

Each text becomes a short vector of transformed statistics. Per class, their
mean and covariance are learned; the covariance is shrunk towards the pooled one
and towards a multiple of the identity. A score is the posterior from the
difference of the two Gaussian log densities, each a Mahalanobis distance
through a Cholesky factor that is worked out once.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, in_arrow, materialise, pieces

#: Shares of the pooled covariance and of the identity in each class's covariance.
POOLED, RIDGE = 0.1, 0.02
#: The log density difference is divided by this before it becomes a probability: statistics overlap in what they say.
TEMPERATURE = 4.0
#: Bytes that are compressed at a time to see how much a text repeats itself.
BLOCK = 1 << 16

_SYMBOL = re.compile(r"[^\w\s]")
_ODD = re.compile(r"[#$%&*!|<>{}\[\]\\^~_=+@]")
STATISTICS = ("chars", "words", "word_length", "long_words", "letters", "upper", "digits", "symbols", "odd", "distinct_words", "top_word", "repeats", "distinct_lines", "line_words", "sentence_words", "caps_words", "compressed")


def statistics(text: str | None) -> list[float]:
    """The transformed statistics of a whole text, all finite."""
    text = text or ""
    n = len(text)
    words = text.split()
    w = len(words)
    logit = lambda share: math.log((share * 0.98 + 0.01) / (1 - share * 0.98 - 0.01))
    counts = Counter(words)
    lines = [x for x in text.split("\n") if x.strip()]
    letters = sum(map(str.isalpha, text)) if not text.isascii() else len(text) - len(text.translate(_LETTERS))
    upper = len(_UPPER.findall(text))
    digits = len(_DIGIT.findall(text))
    symbols, odd = len(_SYMBOL.findall(text)), len(_ODD.findall(text))
    ends = text.count(".") + text.count("!") + text.count("?")
    data = text.encode()
    packed = sum(len(zlib.compress(data[i : i + BLOCK], 1)) for i in range(0, len(data), BLOCK))
    share = lambda a, b: min(1.0, a / b) if b else 0.0
    return [
        math.log1p(n),
        math.log1p(w),
        math.log1p(sum(map(len, words)) / w if w else 0.0),
        logit(share(sum(len(x) > 12 for x in words), w)),
        logit(share(letters, n)),
        logit(share(upper, n)),
        logit(share(digits, n)),
        logit(share(symbols, n)),
        logit(share(odd, n)),
        logit(share(len(counts), w)),
        logit(share(max(counts.values(), default=0), w)),
        logit(share(sum(a == b for a, b in zip(words, words[1:], strict=False)), w)),
        logit(share(len(set(lines)), len(lines))),
        math.log1p(w / max(1, len(lines))),
        math.log1p(w / max(1, ends)),
        logit(share(sum(x.isupper() and len(x) > 1 for x in words), w)),
        math.log(max(1, packed) / max(1, len(data))),
    ]


_LETTERS = str.maketrans("", "", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")
_UPPER, _DIGIT = re.compile(r"[A-ZÀ-ÖØ-Þ]"), re.compile(r"[0-9]")


def document_statistics(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id_col, x`` with the statistics of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            x = [statistics(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x, pa.list_(pa.float64()))], names=[id_col, "x"])

    slim = docs.select(id_col, text_col)
    return in_arrow(slim, run, f"`{id_col}` {dict(slim.dtypes)[id_col]}, x array<double>")


@dataclass
class Discriminant:
    """Means and inverse Cholesky factors of the two classes, cached, with log determinants and priors."""

    means: np.ndarray
    whiten: np.ndarray
    constants: np.ndarray
    prior: float

    @classmethod
    def fit(cls, n: np.ndarray, sums: np.ndarray, squares: np.ndarray) -> Discriminant:
        """From each class's count, sums and sums of products. A class without rows takes the other's moments."""
        d, total = sums.shape[1], n.sum()
        prior = (n[1] + 1) / (total + 2)
        if total == 0:
            return cls(np.zeros((2, d)), np.stack([np.eye(d)] * 2), np.zeros(2), prior)
        mean = np.stack([sums[c] / n[c] if n[c] else sums.sum(0) / total for c in (0, 1)])
        pooled = sum(squares[c] - n[c] * np.outer(mean[c], mean[c]) if n[c] else 0 for c in (0, 1)) / total
        scale = np.trace(pooled) / d + 1e-9
        whiten, constants = [], []
        for c in (0, 1):
            own = squares[c] / n[c] - np.outer(mean[c], mean[c]) if n[c] > 1 else pooled
            few = d / (d + n[c])  # the fewer rows, the more is borrowed
            a = min(1.0, POOLED + few)
            shrunk = (1 - RIDGE) * ((1 - a) * own + a * pooled) + RIDGE * (np.diag(np.diag(pooled)) + 0.05 * scale * np.eye(d))
            factor = np.linalg.cholesky(shrunk + 1e-9 * np.eye(d))
            whiten.append(np.linalg.inv(factor))
            constants.append(-np.log(np.diag(factor)).sum())
        return cls(mean, np.stack(whiten), np.array(constants), prior)

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Probability of class 1 for each row."""
        log = [self.constants[c] - 0.5 * (((x - self.means[c]) @ self.whiten[c].T) ** 2).sum(1) for c in (0, 1)]
        z = (log[1] - log[0]) / TEMPERATURE + math.log(self.prior / (1 - self.prior))
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def fit(labelled: DataFrame) -> Discriminant:
    """From ``x, label`` (0 or 1). Only counts, sums and sums of products of each class are gathered, a row per task and class."""
    d = len(STATISTICS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, 1 + d + d * d))
        for batch in batches:
            if batch.num_rows:
                x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
                y = batch.column(1).to_numpy(zero_copy_only=False)
                for c in (0, 1):
                    own = x[y == c]
                    total[c] += np.concatenate([[len(own)], own.sum(0), (own.T @ own).ravel()])
        yield pa.RecordBatch.from_arrays([pa.array([0, 1]), pa.array(total.tolist(), pa.list_(pa.float64()))], names=["label", "moments"])

    parts = in_arrow(labelled.select("x", F.col("label").cast("int").alias("label")), run, "label long, moments array<double>")
    rows = parts.select("label", F.posexplode("moments")).groupBy("label", "pos").agg(F.sum("col").alias("v")).collect()  # as many as moments
    m = np.zeros((2, 1 + d + d * d))
    for r in rows:
        m[r["label"], r["pos"]] = r["v"]
    return Discriminant.fit(m[:, 0], m[:, 1 : 1 + d], m[:, 1 + d :].reshape(2, d, d))


def score_quality(docs: DataFrame, labels: DataFrame, modulus: int = 5, remainder: int = 0, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """``id_col, held_out, score, predicted`` for each row of ``docs``; learns from the labels that are not held out.

    Moments are taken over all labelled rows. Null labels and labels other than
    0 and 1 are left out; a document labelled twice counts twice. A null text
    counts as empty and is scored like one. Without any labels every score is a
    half. Repeated rows give repeated rows; other columns are ignored.
    """
    x = materialise(document_statistics(docs, id_col, text_col))
    known = labels.filter(F.col(label_col).isin(0, 1) & ~held_out(modulus, remainder, id_col)).select(F.col(id_col).alias("_id"), F.col(label_col).alias("label"))
    model = fit(x.join(known, x[id_col] == known["_id"]))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # some hundred numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, len(STATISTICS))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(shared.value.scores(rows))], names=[id_col, "score"])

    scored = in_arrow(x, run, x.select(id_col).schema.add("score", "double"))
    return scored.select(id_col, held_out(modulus, remainder, id_col).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))

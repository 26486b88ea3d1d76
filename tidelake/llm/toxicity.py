"""Toxicity by a bidirectional gated recurrent network with attention pooling (operator 2).

Inputs are words and their characters. A small bidirectional GRU with attention
pooling reads the characters of a word; its output joins the word's embedding,
if the word was learned, and a second one reads windows of WINDOW words. Windows
overlap by half, all windows of a text are scored, and the text takes the
highest. Training is in numpy, on the driver, from a bounded sample of labelled
documents: of each toxic document the window that looks worst is learned as
toxic, first by the words that toxic documents favour, later by the network.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, in_arrow, kept, pieces

#: Words of a window, words from one window to the next, characters of a word; longer ones are read as several.
WINDOW, STRIDE, LETTERS = 32, 16, 16
#: Sizes: embeddings of characters and words, and hidden states over each, one direction.
CHAR_DIM, WORD_DIM, CHAR_HIDDEN, WORD_HIDDEN = 8, 8, 8, 12
#: Training takes about so many documents of either label, of at most so many characters, and so many words.
SAMPLE_TOXIC, SAMPLE_CLEAN, SAMPLE_CHARS, VOCABULARY = 1500, 2500, 20_000, 20_000
EPOCHS, BATCH, RATE = 8, 128, 0.01
#: Words whose inputs a worker keeps, and windows that it scores at a time.
KEEP_WORDS, AT_ONCE = 60_000, 1024
#: Characters are told apart by their code modulo this.
ALPHABET = 512

_WORD = re.compile(rf"[^\W_]{{1,{LETTERS}}}")


def words_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def _gate(x: np.ndarray) -> np.ndarray:
    """A sigmoid of straight lines, much cheaper than a smooth one."""
    x = x * np.float32(0.25)
    x += np.float32(0.5)
    return np.clip(x, 0, 1, out=x)


def _gate_slope(y: np.ndarray) -> np.ndarray:
    return np.float32(0.25) * ((y > 0) & (y < 1))


def _outer(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sum over all but the last axis of outer products."""
    return a.reshape(-1, a.shape[-1]).T @ b.reshape(-1, b.shape[-1])


def _scatter(index: np.ndarray, rows: np.ndarray, size: int) -> np.ndarray:
    """Sums of ``rows`` by ``index``."""
    order = np.argsort(index, kind="stable")
    index, rows = index[order], rows[order]
    first = np.flatnonzero(np.concatenate([[True], index[1:] != index[:-1]]))
    out = np.zeros((size, rows.shape[-1]), np.float32)
    out[index[first]] = np.add.reduceat(rows, first)
    return out


class BiGRU:
    """A GRU each way and attention pooling, with its gradients. Parameters are in ``p`` under ``name``."""

    def __init__(self, p: dict[str, np.ndarray], name: str, size: int, hidden: int, rng: np.random.Generator):
        self.p, self.name, self.hidden = p, name, hidden
        for way in "fb":
            p[f"{name}W{way}"] = (rng.standard_normal((size, 3 * hidden)) / np.sqrt(size)).astype(np.float32)
            p[f"{name}U{way}"] = (rng.standard_normal((hidden, 3 * hidden)) / np.sqrt(hidden)).astype(np.float32)
            p[f"{name}c{way}"] = np.zeros(3 * hidden, np.float32)
        p[f"{name}A"] = (rng.standard_normal((2 * hidden, hidden)) / np.sqrt(2 * hidden)).astype(np.float32)
        p[f"{name}a"] = np.zeros(hidden, np.float32)
        p[f"{name}v"] = (rng.standard_normal(hidden) / np.sqrt(hidden)).astype(np.float32)

    def project(self, x: np.ndarray) -> np.ndarray:
        """What the inputs add to the gates, both ways."""
        p, n = self.p, self.name
        return np.concatenate([x @ p[f"{n}Wf"] + p[f"{n}cf"], x @ p[f"{n}Wb"] + p[f"{n}cb"]], axis=-1)

    def _run(self, gates: np.ndarray, mask: np.ndarray, way: str, keep: bool) -> tuple[np.ndarray, list]:
        """gates: time x rows x 3 hidden; mask: time x rows x 1."""
        H, u = self.hidden, self.p[f"{self.name}U{way}"]
        steps = range(len(gates)) if way == "f" else range(len(gates) - 1, -1, -1)
        h = np.zeros((gates.shape[1], H), np.float32)
        out, kept = np.empty((*gates.shape[:2], H), np.float32), []
        for t in steps:
            a = h @ u
            zr = _gate(gates[t, :, : 2 * H] + a[:, : 2 * H])
            z, r = zr[:, :H], zr[:, H:]
            c = r * a[:, 2 * H :]
            c += gates[t, :, 2 * H :]
            np.tanh(c, out=c)
            if keep:
                kept.append((t, h, z, r, c, a[:, 2 * H :]))
            new = c - h  # the step is (1 - z) (c - h), and none where nothing is read
            new *= mask[t] - mask[t] * z
            new += h
            out[t] = h = new
        return out, kept

    def forward(self, gates: np.ndarray, mask: np.ndarray, keep: bool = False):
        """The pooled state of each row, from projected inputs, and what the gradients need."""
        H, p, n = self.hidden, self.p, self.name
        mask = mask[..., None]
        f, kept_f = self._run(gates[..., : 3 * H], mask, "f", keep)
        b, kept_b = self._run(gates[..., 3 * H :], mask, "b", keep)
        h = np.concatenate([f, b], axis=-1)
        e = np.tanh(h @ p[f"{n}A"] + p[f"{n}a"])
        s = np.where(mask[..., 0] > 0, e @ p[f"{n}v"], -1e9)
        s = np.exp(s - s.max(axis=0))
        weight = s / s.sum(axis=0)
        pooled = np.einsum("tn,tnh->nh", weight, h)
        return pooled, (mask, h, e, weight, kept_f, kept_b) if keep else None

    def backward(self, x: np.ndarray, saved, d_pooled: np.ndarray, grads: dict[str, np.ndarray]) -> np.ndarray:
        """Adds to ``grads``; gives the gradient of the inputs ``x``."""
        H, p, n = self.hidden, self.p, self.name
        mask, h, e, weight, kept_f, kept_b = saved
        dh = weight[..., None] * d_pooled
        dw = np.einsum("nh,tnh->tn", d_pooled, h)
        ds = weight * (dw - (weight * dw).sum(axis=0))
        grads[f"{n}v"] += np.einsum("tn,tnh->h", ds, e)
        de = ds[..., None] * p[f"{n}v"] * (1 - e * e)
        grads[f"{n}A"] += _outer(h, de)
        grads[f"{n}a"] += de.sum(axis=(0, 1))
        dh += de @ p[f"{n}A"].T
        dx = np.zeros_like(x)
        for way, kept, part in (("f", kept_f, slice(0, H)), ("b", kept_b, slice(H, 2 * H))):
            u, carry = p[f"{n}U{way}"], np.zeros_like(dh[0, :, :H])
            d_gates = np.zeros((*x.shape[:2], 3 * H), np.float32)
            for t, before, z, r, c, a in reversed(kept):
                total = dh[t, :, part] + carry
                own = total * mask[t]
                dz, dc = own * (before - c) * _gate_slope(z), own * (1 - z) * (1 - c * c)
                dr = dc * a * _gate_slope(r)
                da = np.concatenate([dz, dr, dc * r], axis=-1)
                d_gates[t] = np.concatenate([dz, dr, dc], axis=-1)
                grads[f"{n}U{way}"] += before.T @ da
                carry = own * z + total * (1 - mask[t]) + da @ u.T
            grads[f"{n}W{way}"] += _outer(x, d_gates)
            grads[f"{n}c{way}"] += d_gates.sum(axis=(0, 1))
            dx += d_gates @ p[f"{n}W{way}"].T
        return dx


class Network:
    """The two levels, a logistic output and a calibration of document scores."""

    def __init__(self, vocabulary: list[str], seed: int = 3):
        rng = np.random.default_rng(seed)
        self.index = {w: i + 1 for i, w in enumerate(vocabulary)}  # 0: any other word
        self.p: dict[str, np.ndarray] = {}
        self.p["C"] = (0.3 * rng.standard_normal((ALPHABET, CHAR_DIM))).astype(np.float32)
        self.p["E"] = (0.1 * rng.standard_normal((len(vocabulary) + 1, WORD_DIM))).astype(np.float32)
        self.p["E"][0] = 0
        self.chars = BiGRU(self.p, "c", CHAR_DIM, CHAR_HIDDEN, rng)
        self.words = BiGRU(self.p, "w", WORD_DIM + 2 * CHAR_HIDDEN, WORD_HIDDEN, rng)
        self.p["o"] = np.zeros(2 * WORD_HIDDEN, np.float32)
        self.p["ob"] = np.zeros(1, np.float32)
        self.slope, self.shift = 1.0, 0.0

    @staticmethod
    def spell(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Characters of words, time x words, and their mask."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        filled = np.arange(lengths.max()) < lengths[:, None]
        codes = np.zeros(filled.shape, np.int64)
        codes[filled] = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32) % ALPHABET
        return np.ascontiguousarray(codes.T), np.ascontiguousarray(filled.T, np.float32)

    def inputs(self, words: list[str]) -> np.ndarray:
        """Projected inputs of words to the upper level."""
        out = np.empty((len(words), 6 * WORD_HIDDEN), np.float32)
        order = sorted(range(len(words)), key=lambda i: len(words[i]))  # words of a like length together
        for at in range(0, len(order), 2048):
            some = order[at : at + 2048]
            codes, mask = self.spell([words[i] for i in some])
            pooled, _ = self.chars.forward(self.chars.project(self.p["C"])[codes], mask)
            known = self.p["E"][[self.index.get(words[i], 0) for i in some]]
            out[some] = self.words.project(np.concatenate([known, pooled], axis=-1))
        return out

    def logits(self, gates: np.ndarray, mask: np.ndarray) -> np.ndarray:
        pooled, _ = self.words.forward(gates, mask)
        return pooled @ self.p["o"] + self.p["ob"]

    def gradients(self, windows: list[list[str]], target: np.ndarray, weight: np.ndarray, unknown: np.ndarray | None = None) -> tuple[float, dict[str, np.ndarray]]:
        """Loss of a batch and the gradients of all parameters. ``unknown``: random numbers; words with one under a half are read by characters alone."""
        p = self.p
        grads = {k: np.zeros_like(v) for k, v in p.items()}
        distinct = {w: i for i, w in enumerate(dict.fromkeys(w for x in windows for w in x))}
        codes, char_mask = self.spell(list(distinct))
        c_in = p["C"][codes]
        c_out, c_saved = self.chars.forward(self.chars.project(c_in), char_mask, keep=True)
        ids = np.array([self.index.get(w, 0) for w in distinct])
        if unknown is not None:
            ids[unknown[: len(ids)] < 0.5] = 0
        table = np.concatenate([p["E"][ids], c_out], axis=-1)
        at = np.zeros((max(map(len, windows)), len(windows)), np.int64)
        mask = np.zeros(at.shape, np.float32)
        for i, x in enumerate(windows):
            at[: len(x), i] = [distinct[w] for w in x]
            mask[: len(x), i] = 1
        x = table[at]
        pooled, saved = self.words.forward(self.words.project(x), mask, keep=True)
        z = pooled @ p["o"] + p["ob"]
        y = _sigmoid(z)
        loss = float(-(weight * (target * np.log(y + 1e-7) + (1 - target) * np.log(1 - y + 1e-7))).mean())
        dz = (weight * (y - target) / len(target)).astype(np.float32)
        grads["o"] += pooled.T @ dz
        grads["ob"] += dz.sum()
        dx = self.words.backward(x, saved, dz[:, None] * p["o"], grads) * mask[..., None]
        d_table = _scatter(at.ravel(), dx.reshape(-1, dx.shape[-1]), len(table))
        grads["E"] += _scatter(ids, d_table[:, :WORD_DIM], len(p["E"]))
        grads["E"][0] = 0
        dc = self.chars.backward(c_in, c_saved, d_table[:, WORD_DIM:], grads)
        grads["C"] += _scatter(codes.ravel(), dc.reshape(-1, CHAR_DIM), ALPHABET)
        return loss, grads

    def calibrated(self, logit: np.ndarray) -> np.ndarray:
        return _sigmoid(np.clip(self.slope * logit + self.shift, -60, 60))


def windows_of(words: list[str]) -> list[list[str]]:
    return [words[i : i + WINDOW] for i in range(0, max(1, len(words) - WINDOW + STRIDE), STRIDE)] if words else []


class _Places(dict):
    """Numbers words from 1 on as they come, and lists those that are new."""

    def __init__(self) -> None:
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        self.new.append(word)
        self[word] = at = len(self) + 1
        return at


class Scorer:
    """Scores texts by a network, keeping the inputs of words for a while."""

    def __init__(self, network: Network):
        self.network = network
        self.reset()

    def reset(self) -> None:
        self.at = _Places()
        self.table = np.zeros((4096, 6 * WORD_HIDDEN), np.float32)  # row 0: nothing

    def logits(self, texts: list[list[str]]) -> np.ndarray:
        """The highest window of each text; -inf without words."""
        if len(self.at) > KEEP_WORDS:
            self.reset()
        start = len(self.at) + 1
        places = [np.array(list(map(self.at.__getitem__, x)), np.int32) for x in texts]
        if new := self.at.new:
            if start + len(new) > len(self.table):
                self.table = np.concatenate([self.table[:start], np.zeros((len(new) + len(self.table), self.table.shape[1]), np.float32)])
            self.table[start : start + len(new)] = self.network.inputs(new)
            new.clear()
        rows, owner = [], []
        for i, ids in enumerate(places):
            if len(ids):
                n = max(1, -(-(len(ids) - WINDOW) // STRIDE) + 1)
                padded = np.zeros((n - 1) * STRIDE + WINDOW, np.int32)
                padded[: len(ids)] = ids
                rows.append(np.lib.stride_tricks.sliding_window_view(padded, WINDOW)[::STRIDE])
                owner += [i] * n
        best = np.full(len(texts), -np.inf)
        if rows:
            ids, owner = np.concatenate(rows), np.array(owner)
            for at in range(0, len(ids), AT_ONCE):
                some = ids[at : at + AT_ONCE].T
                np.maximum.at(best, owner[at : at + AT_ONCE], self.network.logits(self.table[some], (some > 0).astype(np.float32)))
        return best

    def scores(self, texts: list[str | None]) -> np.ndarray:
        """0 for a text without words."""
        logits, at, words, held = np.empty(len(texts)), 0, [], 0
        for i, text in enumerate(texts):
            words.append(words_of(text))
            held += len(words[-1])
            if held > 100_000 or i == len(texts) - 1:
                logits[at : i + 1] = self.logits(words)
                at, words, held = i + 1, [], 0
        return np.where(np.isneginf(logits), 0.0, self.network.calibrated(np.where(np.isneginf(logits), 0, logits)))


def _stems(word: str) -> list[str]:
    return [word + "$", *[word[:k] for k in range(3, min(8, len(word)) + 1)]]


def train(texts: list[str], toxic: list[int], epochs: int = EPOCHS, seed: int = 3) -> Network | None:
    """A network from labelled texts; None unless both labels are there. The same input gives the same network."""
    one: dict[str, str] = {}  # of each word a single copy, as texts repeat them
    docs = [([one.setdefault(w, w) for w in words_of(t)], y) for t, y in zip(texts, toxic, strict=True)]
    docs = [(w, y) for w, y in docs if w]
    y = np.array([d[1] for d in docs])
    if not docs or y.min() == y.max():
        return None
    rng = np.random.default_rng(seed)
    # Words and their beginnings, as other endings of a word tell as much.
    having, stems = [Counter(), Counter()], [Counter(), Counter()]
    for w, label in docs:
        having[label].update(set(w))
        stems[label].update({x for word in set(w) for x in _stems(word)})
    n = [int((y == c).sum()) for c in (0, 1)]
    odds = {w: max(0.0, np.log((k + 0.5) / (n[1] + 1)) - np.log((stems[0][w] + 0.5) / (n[0] + 1))) for w, k in stems[1].items() if k >= 3}
    hint = {w: max(odds.get(x, 0.0) for x in _stems(w)) for w in having[0] | having[1]}
    both = having[0] + having[1]
    vocabulary = [w for w, k in sorted(both.items(), key=lambda x: (-x[1], x[0])) if k >= 3][:VOCABULARY]
    network = Network(vocabulary, seed)
    parts = [windows_of(w) for w, _ in docs]
    worst = [max(range(len(p)), key=lambda i, p=p: sum(hint[w] ** 2 for w in sorted(set(p[i])))) for p in parts]
    del one, having, stems, odds, hint, both
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in network.p.items()}
    step, weight = 0, np.where(y == 1, len(y) / (2 * n[1]), len(y) / (2 * n[0]))
    least = max(epochs * len(docs) // BATCH, 200)  # small samples are gone through more often
    rounds = -(-least * BATCH // len(docs))
    for epoch in range(rounds):
        if epoch and epoch % -(-rounds // 3) == 0:
            worst = [int(np.argmax(x)) for x in _window_logits(network, parts)]
        for some in np.array_split(rng.permutation(len(docs)), max(1, len(docs) // BATCH)):
            # Clean documents show their worst window half of the time, and any other one else.
            picked = [parts[i][worst[i] if y[i] or rng.random() < 0.5 else rng.integers(len(parts[i]))] for i in some]
            _, grads = network.gradients(picked, y[some].astype(np.float32), weight[some].astype(np.float32), rng.random(BATCH * 2 * WINDOW))
            step += 1
            norm = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
            for k, g in grads.items():
                g = g * min(1.0, 5 / (norm + 1e-9)) + (1e-5 * network.p[k] if k != "ob" else 0)
                m, v = moments[k]
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                network.p[k] -= RATE * min(1.0, 2 - 2 * step / (least + 1)) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    _calibrate(network, np.array([x.max() for x in _window_logits(network, parts)]), y)
    return network


def _window_logits(network: Network, parts: list[list[list[str]]]) -> list[np.ndarray]:
    words = list(dict.fromkeys(w for p in parts for x in p for w in x))
    at = {w: i + 1 for i, w in enumerate(words)}
    table = np.concatenate([np.zeros((1, 6 * WORD_HIDDEN), np.float32), network.inputs(words)])
    ids = np.zeros((sum(map(len, parts)), WINDOW), np.int32)
    for i, x in enumerate(x for p in parts for x in p):
        ids[i, : len(x)] = [at[w] for w in x]
    z = np.concatenate([network.logits(table[ids[i : i + AT_ONCE].T], (ids[i : i + AT_ONCE].T > 0).astype(np.float32)) for i in range(0, len(ids), AT_ONCE)])
    return np.split(z, np.cumsum([len(p) for p in parts])[:-1])


def _calibrate(network: Network, logits: np.ndarray, y: np.ndarray) -> None:
    """Slope and shift that put the best cut between the labels (by balanced errors) at a score of 0.7."""
    order = np.argsort(logits)
    z, labels = logits[order], y[order]
    missed = np.concatenate([[0], np.cumsum(labels)]) / labels.sum()
    raised = 1 - np.concatenate([[0], np.cumsum(1 - labels)]) / (1 - labels).sum()
    cost = missed + 2 * raised
    at = np.flatnonzero(cost <= cost.min() + 1e-12)
    edges = np.concatenate([[z[0] - 1], z, [z[-1] + 1]])
    cut = float(np.mean([(edges[i] + edges[i + 1]) / 2 for i in at]))
    spread = max(1e-3, float(np.std(z)))
    network.slope = 2.0 / spread
    network.shift = float(np.log(0.7 / 0.3)) - network.slope * cut


def train_on(docs: DataFrame, labels: DataFrame, modulus: int = 3, remainder: int = 1, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: tuple[int, int] = (SAMPLE_CLEAN, SAMPLE_TOXIC)) -> Network | None:
    """A network from about ``sample`` labelled documents, clean and toxic, that are not held out.

    At most twice as many are taken however often ids repeat. Null labels and
    labels other than 0 and 1 are left out, and so are null ids and texts; without both labels there is none.
    """
    known = labels.filter(F.col(label_col).isin(0, 1) & ~held_out(modulus, remainder, id_col)).select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_label")).distinct()
    counts = {r[0]: r[1] for r in known.groupBy("_label").count().collect()}  # two rows
    share = F.when(F.col("_label") == 1, min(1.0, sample[1] / max(1, counts.get(1, 0)))).otherwise(min(1.0, sample[0] / max(1, counts.get(0, 0))))
    most = 2 * sum(sample)  # twice what is expected, as ids can repeat
    drawn = known.filter(F.pmod(F.xxhash64(F.lit(9), "_id"), F.lit(1 << 20)) < share * (1 << 20)).orderBy(F.xxhash64("_id"), "_label").limit(most)
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).filter(F.length("_text") <= SAMPLE_CHARS)
    rows = texts.join(F.broadcast(drawn), "_id").select("_id", "_label", "_text")
    if docs.select(F.col(id_col).alias("_id")).join(F.broadcast(drawn), "_id").count() > most:
        rows = rows.orderBy(F.xxhash64("_id", "_text"), "_label").limit(most)
    table = sorted(zip(*[c.to_pylist() for c in rows.toArrow().columns], strict=True))  # the bounded sample
    return train([r[2] for r in table], [r[1] for r in table])


def _scorer(shared) -> Scorer | None:
    if shared.value is None:
        return None
    key, network = shared.value
    return kept(("scorer", key), lambda: Scorer(network))


def _share(docs: DataFrame, network: Network | None):
    return docs.sparkSession.sparkContext.broadcast(network and (f"{id(network)}-{network.shift!r}-{network.slope!r}", network))  # of fixed size


def score_toxicity(docs: DataFrame, network: Network | None, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, score, predicted`` for each row of ``docs``.

    All windows of the whole text are scored, the highest counts. A text without
    words (null, empty, symbols) has score 0, and so has every text if there is
    no network. Repeated rows give repeated rows; other columns are ignored.
    """
    shared = _share(docs, network)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _scorer(shared)
        for batch in pieces(batches):
            scores = scorer.scores(batch.column(1).to_pylist()) if scorer else np.zeros(batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores), pa.array((scores >= threshold).astype(np.int32))], names=[id_col, "score", "predicted"])

    slim = docs.select(id_col, text_col)
    return in_arrow(slim, run, slim.select(id_col).schema.add("score", "double").add("predicted", "integer"))


def drop_toxic(docs: DataFrame, network: Network | None, threshold: float = 0.7, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that score below the threshold, with their columns."""
    shared, at = _share(docs, network), docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _scorer(shared)
        for batch in pieces(batches):
            yield batch.filter(pa.array(scorer.scores(batch.column(at).to_pylist()) < threshold)) if scorer and batch.num_rows else batch

    return in_arrow(docs, run, docs.schema)


def train_and_score(docs: DataFrame, labels: DataFrame, modulus: int = 3, remainder: int = 1, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, held_out, score, predicted``: score_toxicity() of all ``docs`` by train_on() the rest of the labels."""
    scored = score_toxicity(docs, train_on(docs, labels, modulus, remainder, id_col, text_col), threshold, id_col, text_col)
    return scored.select(id_col, held_out(modulus, remainder, id_col).alias("held_out"), "score", "predicted")

"""Quality classifier by attention-based multiple-instance learning.

A document is a bag of passages of 64 words. Each passage is encoded from its own text: shares of character classes,
word lengths, how often its words repeat within it and in the whole document. A small network maps encodings to
representations, gated attention (tanh times sigmoid) weighs them, and a logistic head scores the weighted sum, so
document labels alone teach which passages matter. The network is trained here, on a bounded sample of labelled
documents; every passage of every document is scored in the tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, doc_columns, rows_of, texts

CLASSES = 8
FEATURES = CLASSES + 9


def _classes() -> np.ndarray:
    """Byte -> class: 0 white space, 1 lower case and bytes over 127, 2 upper case, 3 digit, 4 !, 5 symbols, 6 sentence marks, 7 other."""
    c = np.full(256, 7, np.uint8)
    c[[32, 9, 10, 11, 12, 13]] = 0
    c[97:123] = 1
    c[128:] = 1
    c[65:91] = 2
    c[48:58] = 3
    c[33] = 4
    c[list(b"#*$%&|<>@^~_=+\\")] = 5
    c[list(b".,;:?'\"()-")] = 6
    return c


CLASS = _classes()


def passages(text: str, size: int = 64) -> np.ndarray:
    """One row of features for each passage; one row of zeros for a text without words."""
    raw = text.encode("utf-8", "surrogatepass")
    kind = CLASS[np.frombuffer(raw, np.uint8)]
    word = kind > 0
    starts = np.flatnonzero(word & ~np.concatenate([[False], word[:-1]]))
    n = len(starts)
    if not n:
        return np.zeros((1, FEATURES), np.float32)
    cut = starts[::size]
    p = len(cut)
    counts = np.empty((p, CLASSES))
    for c in range(CLASSES):
        counts[:, c] = np.add.reduceat(kind == c, cut, dtype=np.int64)
    words = np.minimum(size, n - size * np.arange(p))
    chars = np.maximum(counts[:, 1:].sum(axis=1), 1)
    h = np.fromiter(map(hash, raw.split()), np.int64, n)
    padded = np.empty(p * size, np.int64)
    padded[:n] = h
    padded[n:] = np.arange(p * size - n)  # each distinct, subtracted below
    rows = np.sort(padded.reshape(p, size), axis=1)
    distinct = 1 + (rows[:, 1:] != rows[:, :-1]).sum(axis=1) - (size - words)
    _, inverse, total = np.unique(h, return_inverse=True, return_counts=True)
    often = np.add.reduceat(total[inverse], np.arange(0, n, size)) / words
    lines = np.add.reduceat(np.frombuffer(raw, np.uint8) == 10, cut, dtype=np.int64)
    out = np.concatenate([
        counts / chars[:, None],
        np.stack([
            np.log1p(chars / words), distinct / words, np.log1p(often), often / n, counts[:, 4] / words, counts[:, 5] / words,
            counts[:, 6] / words, lines / words, np.log1p(words) / 5,
        ], axis=1),
    ], axis=1)
    return out.astype(np.float32)


class Network:
    """z = sum a_i h_i; h = tanh(x W + c); a = softmax(w . tanh(h V) * sigmoid(h U)); score = sigmoid(z . s + t)."""

    def __init__(self, hidden: int = 16, gate: int = 8, seed: int = 1):
        r = np.random.default_rng(seed)
        init = lambda *shape: r.normal(0, 1 / np.sqrt(shape[0]), shape)
        self.mean, self.scale = np.zeros(FEATURES), np.ones(FEATURES)
        self.p = {"W": init(FEATURES, hidden), "c": np.zeros(hidden), "V": init(hidden, gate), "U": init(hidden, gate), "w": init(gate), "s": init(hidden), "t": np.zeros(1)}

    def forward(self, x: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, dict]:
        """Scores of bags; starts: first row of each bag in x."""
        p = self.p
        x = np.clip((x - self.mean) / self.scale, -8, 8)
        h = np.tanh(x @ p["W"] + p["c"])
        a1, a2 = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-np.clip(h @ p["U"], -30, 30)))
        e = np.exp(np.clip((a1 * a2) @ p["w"], -30, 30))
        of = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(x))))
        a = e / np.add.reduceat(e, starts)[of]
        z = np.add.reduceat(a[:, None] * h, starts, axis=0)
        y = 1 / (1 + np.exp(-np.clip(z @ p["s"] + p["t"][0], -30, 30)))
        return y, {"x": x, "h": h, "a1": a1, "a2": a2, "a": a, "z": z, "of": of}

    def gradients(self, y: np.ndarray, truth: np.ndarray, k: dict, starts: np.ndarray) -> dict[str, np.ndarray]:
        p = self.p
        d = (y - truth) / len(y)
        dz = d[:, None] * p["s"]
        dh = k["a"][:, None] * dz[k["of"]]
        da = (dz[k["of"]] * k["h"]).sum(axis=1)
        de = k["a"] * (da - np.add.reduceat(k["a"] * da, starts)[k["of"]])
        g1, g2 = de[:, None] * p["w"] * k["a2"] * (1 - k["a1"] ** 2), de[:, None] * p["w"] * k["a1"] * k["a2"] * (1 - k["a2"])
        dh = dh + g1 @ p["V"].T + g2 @ p["U"].T
        du = dh * (1 - k["h"] ** 2)
        return {"W": k["x"].T @ du, "c": du.sum(axis=0), "V": k["h"].T @ g1, "U": k["h"].T @ g2, "w": (k["a1"] * k["a2"]).T @ de, "s": k["z"].T @ d, "t": np.array([d.sum()])}

    def train(self, bags: list[np.ndarray], truth: np.ndarray, epochs: int = 30, batch: int = 256, rate: float = 0.01, seed: int = 1) -> Network:
        """Adam on mini-batches of bags."""
        if not len(bags):
            return self
        every = np.concatenate(bags)
        self.mean, self.scale = every.mean(axis=0, dtype=np.float64), every.std(axis=0, dtype=np.float64) + 1e-3
        share = np.clip(truth.mean(), 0.02, 0.98)
        self.p["t"][:] = np.log(share / (1 - share))
        m, v, step = {k: 0.0 for k in self.p}, {k: 0.0 for k in self.p}, 0
        r = np.random.default_rng(seed)
        for _ in range(max(epochs, 3000 * 8 // max(len(bags), 1) if len(bags) < 3000 else epochs)):
            order = r.permutation(len(bags))
            for i in range(0, len(order), batch):
                at = order[i : i + batch]
                starts = np.cumsum([0] + [len(bags[j]) for j in at[:-1]])
                y, kept = self.forward(np.concatenate([bags[j] for j in at]), starts)
                step += 1
                for k, g in self.gradients(y, truth[at], kept, starts).items():
                    g = g + 1e-4 * self.p[k]
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.999 * v[k] + 0.001 * g * g
                    self.p[k] = self.p[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
        return self


def fitted(docs: DataFrame, labels: DataFrame, learn: F.Column | None = None, most: int = 10_000) -> Network:
    """Train on rows of labels (doc_id, quality) that learn admits, at most ``most`` (those first by a hash of doc_id)."""
    lab = labels.filter((F.lit(True) if learn is None else learn) & F.col("quality").isNotNull()).select("doc_id", F.col("quality").cast("int").alias("y")).dropDuplicates(["doc_id"])
    lab = lab.orderBy(F.xxhash64("doc_id", F.lit(11)), "doc_id").limit(most)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_of(batches):
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), column(batch, "y"), pa.array([passages(t).tobytes() for t in texts(batch)], pa.binary())], names=["doc_id", "y", "x"])

    few = doc_columns(docs, "doc_id", "text").join(F.broadcast(lab), "doc_id")  # at most ``most`` rows of two numbers
    rows = sorted(few.mapInArrow(encode, "doc_id bigint, y int, x binary").collect(), key=lambda r: (r["doc_id"], r["x"]))
    return Network().train([np.frombuffer(r["x"], np.float32).reshape(-1, FEATURES) for r in rows], np.array([r["y"] for r in rows], np.float64))


def score(docs: DataFrame, labels: DataFrame, learn: F.Column | None = None, most: int = 10_000) -> DataFrame:
    """(doc_id, score, n_passages, attention) for every row of docs: the probability of label 1, from the whole text.

    attention: the largest weight of a passage. Null, empty and wordless texts are a bag of one empty passage. A doc_id
    may repeat or be null; each row is scored by itself. Without labels the network is untrained. Other columns are
    ignored; an empty table gives no rows.
    """
    net = fitted(docs, labels, learn, most)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_of(batches, 2_000_000):
            bags = [passages(t) for t in texts(batch)]
            sizes = np.array([len(b) for b in bags])
            starts = np.cumsum(sizes) - sizes
            y, kept = net.forward(np.concatenate(bags), starts)
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), pa.array(y), pa.array(sizes), pa.array(np.maximum.reduceat(kept["a"], starts))], names=["doc_id", "score", "n_passages", "attention"])

    return doc_columns(docs, "doc_id", "text").mapInArrow(run, "doc_id bigint, score double, n_passages bigint, attention double")

"""Toxicity by noisy-channel deobfuscation: restore disguised words, then score the restored text.

A disguised word is a lattice: each written character may stand for itself or for letters it resembles, a run of one
character may stand for one or two of it, and single characters set apart by spaces or punctuation may belong to one
word. The Viterbi path through the lattice under a character trigram model of the corpus, with a cost for each change,
is the restored word. A word of letters without long runs has only one path and stays as it is.

The language model's counts come from all documents: each distinct word is counted by Spark, and words turn into
trigram counts with the word's (damped) frequency. The scorer is a logistic model over hashed words and word beginnings
of the restored text, trained on labelled rows by full-batch gradient steps in which every row takes part.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, doc_columns, rows_of, staged, texts, unstage

#: Letters that a written character may stand for (fixed values).
LOOKS_LIKE = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "*": "aeiou", "#": "h",
}
EDGE = "\x02"
#: Tokens that may be disguised: a look-alike beside letters, a run of three, letters set apart by punctuation.
_ODD = re.compile(rf"[{re.escape(''.join(LOOKS_LIKE))}]|(\w)\1\1|\w[.\-_]\w[.\-_]\w")
#: Three or more single characters (a letter among them) set apart by spaces.
_ONE = rf"(?:[^\W_]|[{re.escape(''.join(LOOKS_LIKE))}])"
_APART = re.compile(rf"(?<!\S){_ONE}(?: {_ONE}){{2,}}(?!\S)")
_LONG = re.compile(r"(\w|[^\w\s])\1{3,}")
_OUTER = ".,;:?\"'()[]{}…-_"
_TAIL = re.compile(r"(?:!+|\*{3,}|\${3,}|#{3,})$")


#: Sizes, as powers of two, of the tables of counts: of three characters, the first two, the last two, the middle one, the
#: last one, and all (one row).
TABLES = {"tri": 20, "bi": 18, "pair": 18, "ends": 16, "uni": 16, "total": 0}


def parts_of(gram: str) -> dict[str, str]:
    return {"tri": gram, "bi": gram[:2], "pair": gram[1:], "ends": gram[1], "uni": gram[2], "total": ""}


class CharModel:
    """Log probabilities of a character after two others, interpolated with shorter contexts.

    Counts are kept in tables of fixed size, by the hash of the characters, so the model is as large for an alphabet of
    20,000 signs as for one of 30; contexts of one place in a table share a count.
    """

    def __init__(self, counts: dict[str, float] | None = None, cells: dict[str, tuple[np.ndarray, np.ndarray]] | None = None):
        """From counts of three-character grams, or from cells (places and sums of each table)."""
        if cells is None:
            sums: dict[str, dict[int, float]] = {t: {} for t in TABLES}
            for gram, n in (counts or {}).items():
                for t, part in parts_of(gram).items():
                    at = xxhash.xxh64_intdigest(part, 42) & ((1 << TABLES[t]) - 1)
                    sums[t][at] = sums[t].get(at, 0.0) + n
            cells = {t: (np.array(list(x), np.int64), np.array(list(x.values()), np.float64)) for t, x in sums.items()}
        self.cells, self.kept, self.tables = cells, {}, None

    def __getstate__(self) -> dict:
        return {"cells": self.cells, "kept": {}, "tables": None}

    def _count(self, table: str, part: str) -> float:
        return self.tables[table][xxhash.xxh64_intdigest(part, 42) & ((1 << TABLES[table]) - 1)]

    def log(self, a: str, b: str, c: str) -> float:
        gram = a + b + c
        out = self.kept.get(gram)
        if out is None:
            if self.tables is None:
                self.tables = {}
                for t, (at, n) in self.cells.items():
                    self.tables[t] = np.zeros(1 << TABLES[t])
                    self.tables[t][at] = n
            if len(self.kept) > 500_000:
                self.kept.clear()
            total = self._count("total", "") or 1.0
            p1 = self._count("uni", c) / total + 0.1 / (total + 1)
            p2 = (self._count("pair", b + c) + 2 * p1) / (self._count("ends", b) + 2)
            p3 = (self._count("tri", gram) + 2 * p2) / (self._count("bi", a + b) + 2)
            out = self.kept[gram] = math.log(p3)
        return out

    def word(self, w: str) -> float:
        s = EDGE + EDGE + w + EDGE
        return sum(self.log(*s[i : i + 3]) for i in range(len(s) - 2))


def restore(written: str, model: CharModel, change: float = 1.0, shorten: float = 0.3, skip: float = 0.7) -> str:
    """The likeliest word behind a written one (words, where a space inside is kept as their border): Viterbi over states
    of the last two characters. A word of one letter beside a border costs extra: spaced words consist of such."""
    best: dict[str, tuple[float, tuple | None]] = {EDGE + EDGE: (0.0, None)}  # score, (what came before, last letters)
    i, n = 0, len(written)
    while i < n:
        ch, run = written[i], 1
        while i + run < n and written[i + run] == ch:
            run += 1
        options: list[tuple[str, float]] = []
        if ch in " .-_" and 0 < i and i + run < n:
            options.append(("", skip))
            if ch == " ":
                options.append((" ", 0.0))
        else:
            for letter in ([ch] if ch.isalpha() else []) + list(LOOKS_LIKE.get(ch, "")):
                cost = 0.0 if letter == ch else change
                options.append((letter * min(run, 2), cost + shorten * (run > 2)))
                if run > 1:
                    options.append((letter, cost + shorten))
            if not ch.isalpha():
                options.append((ch * run, 4.0 * change))
                if ch in "*!+(#-_":
                    options.append(("", 2 * change))
        new: dict[str, tuple[float, tuple | None]] = {}
        for state, (score, out) in best.items():
            for add, cost in options:
                s, p, x = score - cost, state, (out, add) if add else out
                if add == " ":
                    s, p, add = s + model.log(p[0], p[1], EDGE) - 3.0 * change * (p[0] == EDGE), EDGE + EDGE, ""
                for c in add:
                    s += model.log(p[0], p[1], c)
                    p = p[1] + c
                if p not in new or s > new[p][0]:
                    new[p] = (s, x)
        best = new
        i += run
    ends = [(s + model.log(p[0], p[1], EDGE) - 3.0 * change * (p[0] == EDGE and " " in written), x) for p, (s, x) in best.items()]
    top = max(s for s, _ in ends)
    return max(_spelled(x) for s, x in ends if s == top)


def _spelled(x: tuple | None) -> str:
    parts = []
    while x is not None:
        x, add = x
        parts.append(add)
    return "".join(reversed(parts))


def restored_token(token: str, model: CharModel) -> str:
    """A lower-case token without outer punctuation, its disguise removed if it may have one."""
    core = token.strip(_OUTER)
    if core and not core[-1].isalnum():
        core = _TAIL.sub("", core)
    if len(core) > 60:
        core = _LONG.sub(r"\1\1\1", core)  # longer runs stand for no more than a run of three
    if not 3 <= len(core) <= 60 or not _ODD.search(core) or not any(c.isalpha() for c in core):
        return core
    return restore(core, model)


#: Multipliers of the features "at least 2, 3, 4 different words begin so" (odd, so that none loses a bit).
_TIMES = (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D)


class Scorer:
    """Feature numbers of whole texts. Tokens repeat a lot; what each stands for is kept in a bounded dict.

    ``only``: the features that matter; others are left out, as are beginnings of which no feature matters.
    """

    def __init__(self, model: CharModel, bits: int, only: set[int] | None = None, most: int = 300_000):
        self.model, self.mask, self.most, self.kept, self.only, self.begins = model, (1 << bits) - 1, most, {}, only, None
        if only is not None:
            every = np.arange(1 << bits)
            told = np.isin(every, list(only))
            for m in _TIMES:
                told |= np.isin(every * m & self.mask, list(only))
            self.begins = set(np.flatnonzero(told).tolist())

    def token(self, token: str) -> tuple[int, ...]:
        """The features of the word behind a token."""
        word, begins = self.split(token)
        return word + begins

    def split(self, token: str) -> tuple[tuple[int, ...], tuple[int, ...]]:
        """Of the word behind a token: its own feature, and those of its beginnings."""
        w = restored_token(token, self.model)
        number = lambda g: xxhash.xxh32_intdigest(g) & self.mask
        word, begins = (number(w),) if w else (), tuple({number("^" + w[:n]) for n in (3, 4, 5, 7)}) if w else ()
        if self.only is not None:
            word, begins = tuple(x for x in word if x in self.only), tuple(x for x in begins if x in self.begins)
        if len(self.kept) < self.most and len(token) < 40:
            self.kept[token] = word, begins
        return word, begins

    def features(self, text: str) -> np.ndarray:
        """Hashed words and word beginnings of the restored text, each once; of a beginning that 2, 3 or 4 different
        tokens share also that it is so common."""
        text = text.lower()
        tokens = set(text.split())
        for m in _APART.finditer(text):
            if any(c.isalpha() for c in m.group()):
                tokens.update(restore(m.group(), self.model).split())
        ids: set[int] = set()
        shared: dict[int, int] = {}
        kept = self.kept
        for t in tokens:
            word, begins = kept[t] if t in kept else self.split(t)
            ids.update(word)
            for x in begins:
                shared[x] = shared.get(x, 0) + 1
        for x, n in shared.items():
            ids.add(x)
            for m in _TIMES[: n - 1]:
                ids.add(x * m & self.mask)
        if self.only is not None:
            ids &= self.only
        return np.sort(np.fromiter(ids, np.int64, len(ids)))


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n): every word of all texts, in lower case, with the number of documents that have it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, int] = {}

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["word", "n"])

        for batch in rows_of(batches):
            for t in texts(batch):
                for w in _plain(t):
                    seen[w] = seen.get(w, 0) + 1
            if len(seen) > 300_000:
                yield out()
                seen = {}
        yield out()

    return docs.select("text").mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def _plain(text: str) -> set[str]:
    return {w for x in set(text.lower().split()) if len(w := x.strip(_OUTER)) < 30 and w.isalpha()}


def char_counts(words: DataFrame) -> DataFrame:
    """(gram, n): character trigrams of the words with edges, each word weighted by 1 + log2 of its count."""
    padded = words.select(F.concat(F.lit(EDGE * 2), "word", F.lit(EDGE)).alias("s"), (1 + F.log2("n")).alias("n"))
    return padded.select("n", F.explode(F.transform(F.sequence(F.lit(1), F.char_length("s") - 2), lambda i: F.substring("s", i, F.lit(3)))).alias("gram")).groupBy("gram").agg(F.sum("n").alias("n"))


def tell(ones: np.ndarray, total: np.ndarray, p: float, q: float) -> tuple[np.ndarray, np.ndarray]:
    """Of features with ``ones`` toxic rows out of ``total``: whether each tells, and its log odds; p and q rows in all.

    Telling features are those whose share of ones is five standard errors off, and whose odds differ by a factor e.
    """
    odds = np.log((ones + 0.5) / (p + 1)) - np.log((total - ones + 0.5) / (q + 1))
    share = p / (p + q)
    surprise = (ones - total * share) / np.sqrt(total * share * (1 - share) + 1e-9)
    return (np.abs(surprise) > 5.0) & (np.abs(odds) > 1.0), odds


def fit(x: list[np.ndarray], y: np.ndarray, odds: np.ndarray, steps: int = 300) -> tuple[np.ndarray, float]:
    """Weights of a logistic model over features numbered from 0, each of which starts from its log odds: AdaGrad on the
    full set, with a small ridge."""
    size = len(odds)
    at = np.concatenate([*x, np.empty(0, np.int64)]).astype(np.int64)
    of = np.repeat(np.arange(len(x)), [len(r) for r in x])
    w, b, g2, gb = 0.3 * odds, math.log(y.sum() / (len(y) - y.sum())), np.full(size, 1e-6), 1e-6
    for _ in range(steps):
        z = b + np.bincount(of, w[at], len(y))
        e = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y
        g = np.bincount(at, e[of], size) / len(y) + 1e-6 * w
        g2 += g * g
        w = w - 0.3 * g / np.sqrt(g2)
        gb += e.mean() ** 2
        b -= 0.1 * e.mean() / math.sqrt(gb)
    return w, b


def language_model(docs: DataFrame) -> CharModel:
    """Counted over all documents. Spark adds the grams' counts up in the model's tables, whose filled places come to the
    driver: at most about 1.7 million, whatever the alphabet."""
    grams = char_counts(word_counts(docs))
    cut = {"tri": F.col("gram"), "bi": F.substring("gram", 1, 2), "pair": F.substring("gram", 2, 2), "ends": F.substring("gram", 2, 1), "uni": F.substring("gram", 3, 1), "total": F.lit("")}
    places = F.array(*[F.struct(F.lit(t).alias("t"), F.xxhash64(c).bitwiseAND(F.lit((1 << TABLES[t]) - 1).cast("bigint")).alias("at")) for t, c in cut.items()])
    sums = grams.select("n", F.explode(places).alias("x")).groupBy("x.t", "x.at").agg(F.sum("n").alias("n")).toArrow().sort_by([("t", "ascending"), ("at", "ascending")])
    table, at, n = np.array(sums["t"].to_pylist()), sums["at"].to_numpy(), sums["n"].to_numpy()
    return CharModel(cells={t: (at[table == t], n[table == t]) for t in TABLES})


def training_rows(docs: DataFrame, labels: DataFrame, target: str, learn: F.Column, most: int) -> DataFrame:
    """(doc_id, text, y) of labelled rows to learn from; of more than ``most``, those first by a hash of doc_id.

    Of several labels of one doc_id the smallest counts, null doc_ids never. If a doc_id repeats in docs, its row with
    the smallest text counts.
    """
    lab = labels.filter(learn & F.col(target).isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id")).agg(F.min(F.col(target).cast("int")).alias("y"))
    lab = lab.orderBy(F.xxhash64("doc_id", F.lit(7)), "doc_id").limit(most)
    found = docs.join(F.broadcast(lab), "doc_id")  # at most ``most`` rows of two numbers
    return found.groupBy("doc_id", "y").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))


class Fitted:
    """A trained scorer; travels to the tasks."""

    def __init__(self, model: CharModel, w: np.ndarray, b: float, bits: int):
        self.model, self.at, self.w, self.b, self.bits = model, np.flatnonzero(w), w[w != 0], b, bits

    def ready(self) -> tuple[Scorer, np.ndarray]:
        w = np.zeros(1 << self.bits)
        w[self.at] = self.w
        return Scorer(self.model, self.bits, set(self.at.tolist())), w

    def probabilities(self, ready: tuple[Scorer, np.ndarray], batch: list[str]) -> np.ndarray:
        of, w = ready
        z = np.array([self.b + w[of.features(t)].sum() for t in batch], np.float64)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fitted(docs: DataFrame, labels: DataFrame, learn: F.Column | None = None, most: int = 20_000, bits: int = 18) -> Fitted:
    """Train on rows of labels (doc_id, toxic) that learn admits (a condition on doc_id; default: all), at most ``most``.

    Features of these rows are staged and counted by Spark; only the telling ones and, of each row, which of them it has
    come to the driver.
    """
    docs = doc_columns(docs, "doc_id", "text")
    model = language_model(docs)

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = Scorer(model, bits)
        for batch in rows_of(batches):
            x = [of.features(t).astype("<i4").tobytes() for t in texts(batch)]
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), pa.array(x, pa.binary()), column(batch, "y")], names=["doc_id", "x", "y"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ones, total = np.zeros(1 << bits, np.int64), np.zeros(1 << bits, np.int64)
        for batch in batches:
            for x, y in zip(column(batch, "x").to_pylist(), column(batch, "y").to_pylist(), strict=True):
                at = np.frombuffer(x, "<i4")  # each feature once
                total[at] += 1
                ones[at] += y
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(ones[at]), pa.array(total[at])], names=["feature", "ones", "total"])

    rows = staged(training_rows(docs, labels, "toxic", F.lit(True) if learn is None else learn, most).mapInArrow(extract, "doc_id bigint, x binary, y int"), "training")
    n, p = rows.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0))).first()
    if not p or p == n:
        return Fitted(model, np.zeros(1 << bits), 2.0 if p else -2.0, bits)
    counts = rows.mapInArrow(count, "feature bigint, ones bigint, total bigint").groupBy("feature").agg(F.sum("ones").alias("ones"), F.sum("total").alias("total")).toArrow()  # at most 2^bits rows of three numbers
    feature, ones, total = (counts[c].to_numpy() for c in ("feature", "ones", "total"))
    telling, odds = tell(ones, total, p, n - p)
    order = np.argsort(feature[telling])
    known, odds = feature[telling][order], odds[telling][order]

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = np.full(1 << bits, -1, np.int32)
        number[known] = np.arange(len(known))
        for batch in batches:
            x = [number[np.frombuffer(x, "<i4")] for x in column(batch, "x").to_pylist()]
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), pa.array([v[v >= 0].tobytes() for v in x], pa.binary()), column(batch, "y")], names=["doc_id", "x", "y"])

    told = rows.mapInArrow(reduce, "doc_id bigint, x binary, y int").toArrow().sort_by("doc_id")  # at most ``most`` rows
    unstage(rows)
    w = np.zeros(1 << bits)
    w[known], b = fit([np.frombuffer(x, np.int32) for x in told["x"].to_pylist()], told["y"].to_numpy().astype(np.float64), odds)
    return Fitted(model, w, b, bits)


def score(docs: DataFrame, labels: DataFrame, learn: F.Column | None = None, most: int = 20_000, bits: int = 18) -> DataFrame:
    """(doc_id, score) for every row of docs: the probability that it is toxic, from its whole restored text.

    Null, empty and wordless texts get the score of a text without features. A doc_id may repeat or be null; each row
    is scored by itself; equal texts score alike. Without usable labels every score is low. Other columns are ignored; an empty table gives no
    rows. ``most`` bounds the labelled rows used to fit.
    """
    by = fitted(docs, labels, learn, most, bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready = by.ready()
        for batch in rows_of(batches):
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), pa.array(by.probabilities(ready, texts(batch)))], names=["doc_id", "score"])

    return doc_columns(docs, "doc_id", "text").mapInArrow(run, "doc_id bigint, score double")


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, learn: F.Column | None = None, most: int = 20_000, bits: int = 18) -> DataFrame:
    """The rows of docs (all their columns) that score below the threshold."""
    by = fitted(docs, labels, learn, most, bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready = by.ready()
        for batch in rows_of(batches):
            yield batch.filter(pa.array(by.probabilities(ready, texts(batch)) < threshold))

    return docs.mapInArrow(run, docs.schema)

"""Quality rules as a short-circuit cascade.

Each rule looks at one document's statistics and may reject it. On a sample of documents every rule runs on its own;
its time and how many it rejects are summed over the tasks. Rules then run in descending order of rejections per
cost, and a document's remaining rules are skipped at the first rejection. The order changes what a run costs, never
its verdicts: a document stays if no rule rejects it.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, doc_columns, rows_of, texts

SPACE = b" \t\n\x0b\x0c\r"
SYMBOLS = b"#*$%&|<>"


class Document:
    """A text and what rules ask of it; statistics are computed when first asked for."""

    def __init__(self, text: str):
        self.text, self.raw = text, text.encode("utf-8", "surrogatepass")
        self.words = self.raw.split()
        self.n_words = len(self.words)
        self._distinct = None

    @property
    def distinct(self) -> set[bytes]:
        if self._distinct is None:
            self._distinct = set(self.words)
        return self._distinct

    def word_chars(self) -> int:
        return len(self.text) - sum(self.raw.count(SPACE[i : i + 1]) for i in range(len(SPACE)))

    def n_symbols(self) -> int:
        return sum(self.raw.count(SYMBOLS[i : i + 1]) for i in range(len(SYMBOLS)))

    def lines(self) -> list[bytes]:
        return [x for x in self.raw.split(b"\n") if x.strip(SPACE)]

    def n_dup_lines(self) -> int:
        lines = self.lines()
        return len(lines) - len(set(lines))

    def n_repeat_words(self, size: int = 5) -> int:
        """Words in windows of ``size`` words that occur twice or more in the text."""
        if self.n_words < size + 1:
            return 0
        h = np.fromiter(map(hash, self.words), np.int64, self.n_words).view(np.uint64)
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
        windows = np.zeros(self.n_words - size + 1, np.uint64)
        for i in range(size):
            windows = windows * np.uint64(0xD6E8FEB86659FD93) + h[i : i + len(windows)]
        order = np.argsort(windows)
        s = windows[order]
        same = s[1:] == s[:-1]
        if not same.any():
            return 0
        twice = np.zeros(len(windows), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        edge = np.zeros(self.n_words + 1, np.int32)
        at = np.flatnonzero(twice)
        np.add.at(edge, at, 1)
        np.add.at(edge, at + size, -1)
        return int((np.cumsum(edge[:-1]) > 0).sum())


def _share(part: float, whole: float) -> float:
    return part / whole if whole else 0.0


#: (name, rule): a rule is true where it rejects.
RULES: list[tuple[str, Callable[[Document], bool]]] = [
    ("too_few_words", lambda d: d.n_words < 10),
    ("repeated_windows", lambda d: 100 * d.n_repeat_words() > 20 * d.n_words),
    ("word_length", lambda d: not 2 <= _share(d.word_chars(), d.n_words) <= 20),
    ("symbols", lambda d: d.n_symbols() > 0.1 * d.n_words),
    ("exclamations", lambda d: d.raw.count(b"!") > 0.2 * d.n_words),
    ("capitals", lambda d: sum(w.isupper() and len(w) > 1 for w in d.words) > 0.5 * d.n_words),
    ("repeated_lines", lambda d: d.n_dup_lines() > 0.5 * max(len(d.lines()), 1)),
    ("few_distinct_words", lambda d: d.n_words >= 50 and len(d.distinct) < 0.05 * min(d.n_words, 1000)),
    ("digits", lambda d: sum(d.raw.count(b"%d" % i) for i in range(10)) > 0.5 * max(len(d.raw), 1)),
    ("ellipses", lambda d: sum(x.rstrip().endswith((b"...", b"\xe2\x80\xa6")) for x in d.lines()) > 0.3 * max(len(d.lines()), 1)),
    ("bullets", lambda d: sum(x.lstrip().startswith((b"-", b"*", b"\xe2\x80\xa2")) for x in d.lines()) > 0.9 * max(len(d.lines()), 1)),
]


def ordered_rules(docs: DataFrame, rules: list[tuple[str, Callable[[Document], bool]]], sample: int = 2000, seed: int = 7) -> list[tuple[str, Callable[[Document], bool]]]:
    """The rules by rejections per second on a sample of about that many documents (ties and an empty sample: as given)."""
    total = docs.count()
    if not total:
        return rules

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spent, rejected = [0.0] * len(rules), [0] * len(rules)
        for batch in rows_of(batches):
            for t in texts(batch):
                for i, (_, rule) in enumerate(rules):
                    d = Document(t)
                    began = time.perf_counter()
                    rejected[i] += bool(rule(d))
                    spent[i] += time.perf_counter() - began
        yield pa.RecordBatch.from_arrays([pa.array(range(len(rules)), pa.int32()), pa.array(spent), pa.array(rejected, pa.int64())], names=["rule", "spent", "rejected"])

    some = docs.sample(min(1.0, sample / total), seed) if total > sample else docs
    sums = some.mapInArrow(measure, "rule int, spent double, rejected bigint").groupBy("rule").agg(F.sum("spent").alias("spent"), F.sum("rejected").alias("rejected"))
    gain = {r["rule"]: r["rejected"] / max(r["spent"], 1e-9) for r in sums.collect()}  # one row per rule
    return [rules[i] for i in sorted(range(len(rules)), key=lambda i: (-gain.get(i, 0.0), i))]


def judge(docs: DataFrame, rules: list[tuple[str, Callable[[Document], bool]]] | None = None, sample: int = 2000) -> DataFrame:
    """One row per row of docs: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept.

    base_failed: under 10 words, or over a fifth of the words in repeated five-word windows. kept: false if base_failed,
    else whether no rule of the cascade rejects. Words are runs of anything but ASCII white space. Null text has no
    words and fails. Null and repeated doc_ids are rows like any others; other columns are ignored; an empty table gives
    no rows.
    """
    docs = doc_columns(docs, "doc_id", "text")
    cascade = [r for _, r in ordered_rules(docs, rules or RULES, sample)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_of(batches):
            rows = []
            for t in texts(batch):
                d = Document(t)
                repeated = d.n_repeat_words()
                failed = d.n_words < 10 or 100 * repeated > 20 * d.n_words
                rows.append((d.n_words, d.word_chars(), d.n_symbols(), d.n_dup_lines(), repeated, failed, not failed and not any(rule(d) for rule in cascade)))
            cols = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), *(pa.array(c, pa.int64()) for c in cols[:5]), *(pa.array(c, pa.bool_()) for c in cols[5:])], names=["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"])

    return docs.mapInArrow(run, "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean")

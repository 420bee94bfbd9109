"""Benchmark decontamination by pigeonhole edit matching.

A test item of m characters may appear in a document with up to k = floor(rate * m) edits. Cut into k + 1 pieces, at
least one piece then appears unchanged. One Aho-Corasick automaton finds all pieces of all items in one pass over a
document; around each hit Myers' bit-parallel algorithm verifies longer and longer parts of the item within their share
of the budget, and at last (hits of an item on nearby diagonals together) computes the smallest edit distance between
the item and any substring. Both sides are compared in lower case with runs of white
space as one space.

The items are the small side: they travel to the tasks in shards of bounded size, each of which reads the documents
once. Documents are not shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, doc_columns, rows_of, texts

#: Items of fewer characters are found without edits and as whole words only.
SHORT = 20
MATCHES = "doc_id bigint, item_id bigint, distance int, start int, end int"


def normal(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def split(start: int, end: int, k: int) -> list[list[tuple[int, int, int]]]:
    """Cut item[start:end] with error budget k into k + 1 pieces, by halving.

    Where A and B have budgets a and b with a + b + 1 = k, a match of AB within k edits matches A within a or B within b.
    So each match has a piece without errors all of whose parents match within their own budgets. Returns, for each
    piece, itself and its parents up to the whole, as (start, end, budget).
    """
    if k <= 0:
        return [[(start, end, 0)]]
    a = (k - 1) // 2
    cut = start + (end - start) * (a + 1) // (k + 1)
    return [[*path, (start, end, k)] for path in split(start, cut, a) + split(cut, end, k - 1 - a)]


def masks(item: str) -> dict[str, int]:
    eq: dict[str, int] = {}
    for i, c in enumerate(item):
        eq[c] = eq.get(c, 0) | 1 << i
    return eq


def myers(item: str, text: str, k: int, eq: dict[str, int] | None = None) -> tuple[int, int] | None:
    """(distance, end) of the substring of text closest to item, the first such end; None if none is within k edits."""
    m = len(item)
    eq = masks(item) if eq is None else eq
    full, top = (1 << m) - 1, 1 << m - 1
    pv, mv, score, best = full, 0, m, None
    for end, c in enumerate(text, 1):
        e = eq.get(c, 0)
        xv = e | mv
        xh = (((e & pv) + pv) ^ pv) | e
        ph = mv | (full & ~(xh | pv))
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph = ph << 1 & full
        pv = (mh << 1 & full) | (full & ~(xv | ph))
        mv = ph & xv
        if score <= k and (best is None or score < best[0]):
            best = score, end
    return best


def _joined(a: str, b: str) -> bool:
    """Whether two neighbouring characters belong to one word; scripts written without spaces have no such words."""
    return a.isalnum() and b.isalnum() and max(a, b) < "\u2e80"


class Matcher:
    def __init__(self, items: list[tuple[int, str]], rate: float):
        import ahocorasick

        self.items = [(i, t, int(rate * len(t)) if len(t) >= SHORT else 0) for i, t in items]
        self.masks: dict[tuple[int, int, int], dict[str, int]] = {}
        at: dict[str, list[tuple[int, list[tuple[int, int, int]]]]] = {}
        for n, (_, t, k) in enumerate(self.items):
            for path in split(0, len(t), k):
                at.setdefault(t[path[0][0] : path[0][1]], []).append((n, path))
        self.automaton = ahocorasick.Automaton()
        for piece, where in at.items():
            self.automaton.add_word(piece, (len(piece), where))
        if at:
            self.automaton.make_automaton()
        self.empty = not at

    def parents_match(self, text: str, n: int, diagonal: int, path: list[tuple[int, int, int]]) -> bool:
        """Whether every parent of a piece but the whole matches within its budget around the place of the hit."""
        item = self.items[n][1]
        for start, end, k in path[1:-1]:
            eq = self.masks.get((n, start, end))
            if eq is None:
                eq = self.masks[n, start, end] = masks(item[start:end])
            if myers(item[start:end], text[max(0, diagonal + start - k) : diagonal + end + k], k, eq) is None:
                return False
        return True

    def matches(self, text: str) -> Iterator[tuple[int, int, int, int]]:
        """(item_id, distance, start, end) of each item found: its closest place, in the normal form of the text."""
        text = normal(text)
        if self.empty or not text:
            return
        diagonals: dict[int, set[int]] = {}
        for end, (size, where) in self.automaton.iter(text):
            first = end + 1 - size
            for n, path in where:
                offset = path[0][0]
                if len(self.items[n][1]) < SHORT and (_joined(text[first - 1 : first], text[first]) or _joined(text[end], text[end + 1 : end + 2])):
                    continue  # a short item is found as whole words only
                if first - offset not in diagonals.get(n, ()) and self.parents_match(text, n, first - offset, path):
                    diagonals.setdefault(n, set()).add(first - offset)
        for n, found in diagonals.items():
            item, t, k = self.items[n]
            best = None
            low = high = None
            for d in [*sorted(found), None]:
                if low is not None and (d is None or d - high > 2 * k + 1):
                    a = max(0, low - k)
                    hit = myers(t, text[a : high + len(t) + k], k)
                    if hit and (best is None or hit[0] < best[0]):
                        best = hit[0], a + hit[1]
                    low = d
                if low is None:
                    low = d
                high = d
            if best:
                back = myers(t[::-1], text[max(0, best[1] - len(t) - k) : best[1]][::-1], k)
                yield item, best[0], best[1] - (back[1] if back else len(t)), best[1]


def shards(items: DataFrame, least: int, most_chars: int) -> Iterator[list[tuple[int, str]]]:
    """The items in lists of bounded text; those under ``least`` characters are left out."""
    now, size = [], 0
    for r in items.select(F.col("item_id").cast("bigint"), "text").dropDuplicates().orderBy("item_id", "text").toLocalIterator():
        t = normal(r["text"])
        if len(t) >= least:
            now.append((r["item_id"], t))
            size += len(t)
            if size >= most_chars:
                yield now
                now, size = [], 0
    yield now


def matches(docs: DataFrame, items: DataFrame, rate: float = 0.1, least: int = 1, most_chars: int = 4_000_000) -> DataFrame:
    """(doc_id, item_id, distance, start, end): each item within its error budget of a part of each document.

    start and end are places in the document's normal form. Items of under 20 characters are found only without
    edits and as whole words; those of under ``least`` characters, null and empty ones are left out. Null and empty texts match nothing. Repeated doc_ids and items give rows of their own (equal rows of
    items count once); null ids stay null. Other columns are ignored.
    """
    docs, out = doc_columns(docs, "doc_id", "text"), None
    for shard in shards(items, least, most_chars):

        def run(batches: Iterator[pa.RecordBatch], shard: list = shard) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(shard, rate)
            for batch in rows_of(batches):
                found = [(d, *m) for d, t in zip(column(batch, "doc_id").to_pylist(), texts(batch), strict=True) for m in matcher.matches(t)]
                cols = list(zip(*found, strict=True)) or [[]] * 5
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["doc_id", "item_id", "distance", "start", "end"])

        part = docs.mapInArrow(run, MATCHES)
        out = part if out is None else out.union(part)
    return out


def decontaminated(docs: DataFrame, items: DataFrame, rate: float = 0.1, least: int = 1, most_chars: int = 4_000_000) -> DataFrame:
    """The rows of docs (all their columns) that contain no item within its error budget (``matches``).

    Null and empty texts contain none and stay; null and repeated doc_ids are rows like any others; empty tables change
    nothing.
    """
    for shard in shards(items, least, most_chars):

        def keep(batches: Iterator[pa.RecordBatch], shard: list = shard) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(shard, rate)
            for batch in rows_of(batches):
                yield batch.filter(pa.array([next(matcher.matches(t), None) is None for t in texts(batch)], pa.bool_()))

        docs = docs.mapInArrow(keep, docs.schema)
    return docs

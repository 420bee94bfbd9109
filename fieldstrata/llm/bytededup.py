"""Substring deduplication over bytes, by threshold-bounded interval expansion on a Burrows-Wheeler transform.

Runs of windows that can repeat (``repeats``) are gathered in buckets of bounded size, so that all places of a repeated
string lie in one bucket. Each bucket's suffixes are sorted and its transform is taken. Then intervals of the suffix
array are extended backwards breadth-first: level l holds the intervals of all strings of length l that occur twice or
more, each extension by one character on the left gives an interval of level l + 1, and intervals of one suffix are
dropped. (The sorting by doubling gives the levels up to 128 at once: 4, 8, ... 128; single steps follow.) The common prefixes so come up in order of their length, and the search ends at the least length that
matters: the suffixes in level ``window``'s intervals are the places of repeated strings.

A minimum with more regions than a bucket may hold (the borders of a very frequent passage) is split by the hash of each
single window instead, counted with partial aggregation.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, staged
from .repeats import NO_ID, PLACES, covered, keyed, mixed, repeated_runs, runs, with_texts


def suffix_order(x: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(order of all suffixes of x, low, high, depth), by doubling; x holds values from 0 to 65,534.

    Only suffixes that still tie are sorted again. low and high are the intervals of two or more suffixes that begin
    alike for ``depth`` characters, the largest power of two (from 4 on) within length: sorting on does not move them.
    """
    n = len(x)
    wide = np.concatenate([x.astype(np.int64) + 1, np.zeros(3, np.int64)])
    key = (wide[:n] << 48) | (wide[1 : n + 1] << 32) | (wide[2 : n + 2] << 16) | wide[3:]
    order = np.argsort(key)
    slots = np.arange(n)
    rank = np.empty(n + 1, np.int64)
    rank[n] = -1
    s, tied, step = key[order], order, 4
    low = high = np.empty(0, np.int64)
    depth = 0
    while True:
        new = np.concatenate([[True], s[1:] != s[:-1]]) if len(s) else np.empty(0, bool)
        first = np.flatnonzero(new)
        sizes = np.diff(np.append(first, len(s)))
        rank[tied] = np.repeat(slots[first], sizes)
        if step <= length:
            low, depth = slots[first][sizes > 1], step
            high = low + sizes[sizes > 1] - 1
        many = np.repeat(sizes > 1, sizes)
        tied, slots = tied[many], slots[many]
        if not len(tied):
            return order, low, high, depth
        key = rank[tied] * (n + 1) + rank[np.minimum(tied + step, n)] + 1
        by = np.argsort(key)
        tied, s = tied[by], key[by]
        order[slots] = tied
        step *= 2


def repeated_starts(x: np.ndarray, length: int) -> np.ndarray:
    """Whether the string of that length that starts at each place of x occurs twice or more (breadth-first expansion).

    The intervals of the longest power of two within length come with the suffix order; from there on each level extends
    all intervals by the one character before.
    """
    n = len(x)
    out = np.zeros(n, bool)
    if n < 2:
        return out
    order, low, high, depth = suffix_order(x, length)
    place = np.empty(n, np.int32)
    place[order] = np.arange(n, dtype=np.int32)
    before = np.where(order > 0, order - 1, n - 1)
    char, step_left = x[before].astype(np.int32), place[before]  # the transform, and where its suffixes stand
    run = np.concatenate([[0], np.cumsum(char[1:] != char[:-1])]).astype(np.int32)
    low, high = low.astype(np.int32), high.astype(np.int32)
    if length < 4:
        low, high, depth = np.array([0], np.int32), np.array([n - 1], np.int32), 0
    for _ in range(length - depth):
        if not len(low):
            return out
        one = run[low] == run[high]  # a single character stands before all suffixes of the interval
        if one.all():
            low, high = step_left[low], step_left[high]
            continue
        a, b = low[~one], high[~one]
        low, high = step_left[low[one]], step_left[high[one]]
        sizes = b - a + 1
        of = np.repeat(np.arange(len(a)), sizes)
        at = np.arange(len(of)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + a[of]
        key = of.astype(np.int64) * (int(x.max()) + 1) + char[at]
        by = np.argsort(key, kind="stable")
        key, at = key[by], at[by]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        last = np.append(first[1:], len(key)) - 1
        two = last > first
        low = np.concatenate([low, step_left[at[first[two]]]])
        high = np.concatenate([high, step_left[at[last[two]]]])
    if len(low):
        edge = np.zeros(n + 1, np.int64)
        np.add.at(edge, low, 1)
        np.add.at(edge, high.astype(np.int64) + 1, -1)
        out[order[np.cumsum(edge[:-1]) > 0]] = True
    return out


def splitter() -> Callable[[str], tuple[np.ndarray, Callable[[int, int], bytes]]]:
    values = mixed(np.arange(1, 257, dtype=np.uint64), 11)

    def split(text: str) -> tuple[np.ndarray, Callable[[int, int], bytes]]:
        raw = text.encode("utf-8", "surrogatepass")
        return values[np.frombuffer(raw, np.uint8)], lambda i, j: raw[i:j]

    return split


def _runs_of_true(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    a = np.flatnonzero(edge == 1)
    return a, np.flatnonzero(edge == -1) - a


def _places(docs: list, ties: list, starts: list, sizes: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(ties, pa.int64()), pa.array(starts, pa.int32()), pa.array(sizes, pa.int32())], names=["doc", "tie", "a", "n"])


def repeated_places(docs: DataFrame, window: int = 200, k: int = 64, most: int = 2000, bucket_bytes: int = 500_000) -> DataFrame:
    """PLACES (doc, tie, a, n): n consecutive starts from byte a on of strings of ``window`` bytes that start elsewhere too."""
    alike, first, single = repeated_runs(runs(docs, splitter(), window, k))

    def regions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d = zstandard.ZstdDecompressor()
        for batch in batches:
            for r in batch.to_pylist():
                raw, at = d.decompress(r["z"]), r["at"]
                yield pa.RecordBatch.from_arrays([pa.array([x["m"] for x in at], pa.int64()), pa.array([x["others"] for x in at], pa.int64()), pa.array([r["doc"]] * len(at), pa.int64()), pa.array([r["tie"]] * len(at), pa.int64()), pa.array([x["a"] for x in at], pa.int32()), pa.array([raw[x["a"] : x["a"] + x["n"] - 1 + window] for x in at], pa.binary())], names=["m", "others", "doc", "tie", "a", "raw"])

    cut = staged(with_texts(docs, single, ["m", "others", "a", "n"], "inner").select("doc", "tie", "z", "at").mapInArrow(regions, "m bigint, others bigint, doc bigint, tie bigint, a int, raw binary"), "regions")
    total, largest = cut.agg(F.sum(F.length("raw")), F.max("others")).first()
    buckets = 1 + (total or 0) // bucket_bytes

    def expand(group: pa.Table) -> pa.Table:
        group = group.sort_by("m")
        ms, at = group["m"].to_numpy(), 0
        parts = []
        while at < len(ms):  # whole minima together; separators must fit into 16 bits
            end = len(ms) if len(ms) - at <= 30_000 else int(np.searchsorted(ms, ms[at + 30_000 - 1], "left"))
            end = end if end > at else int(np.searchsorted(ms, ms[at], "right"))
            parts.append(expand_part(group.slice(at, end - at)))
            at = end
        return pa.Table.from_batches(parts)

    def expand_part(group: pa.Table) -> pa.RecordBatch:
        raws = [np.frombuffer(x, np.uint8).astype(np.int64) for x in group["raw"].to_pylist()]
        ends = np.cumsum([len(x) + 1 for x in raws])
        x = np.concatenate([y for i, r in enumerate(raws) for y in (r, [256 + i])])
        twice = repeated_starts(x, window)
        ds, ties, starts, sizes = [], [], [], []
        for d, tie, a, end, r in zip(group["doc"].to_pylist(), group["tie"].to_pylist(), group["a"].to_pylist(), ends.tolist(), raws, strict=True):
            begin = end - 1 - len(r)
            at, n = _runs_of_true(twice[begin : begin + len(r) - window + 1])
            for i, j in zip(at.tolist(), n.tolist(), strict=True):
                ds.append(d)
                ties.append(tie)
                starts.append(a + i)
                sizes.append(j)
        return _places(ds, ties, starts, sizes)

    few = cut.filter(F.col("others") <= most).withColumn("bucket", F.pmod("m", F.lit(buckets)))
    out = few.groupBy("bucket").applyInArrow(expand, PLACES).union(alike).union(first)
    if (largest or 0) > most:

        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for m, d, tie, a, raw in zip(*(column(batch, c).to_pylist() for c in ("m", "doc", "tie", "a", "raw")), strict=True):
                    n = len(raw) - window + 1
                    h = [xxhash.xxh64_intdigest(raw[i : i + window], 9) - (1 << 63) for i in range(n)]
                    yield pa.RecordBatch.from_arrays([pa.array([m] * n, pa.int64()), pa.array(h, pa.int64()), pa.array([d] * n, pa.int64()), pa.array([tie] * n, pa.int64()), pa.array(range(a, a + n), pa.int32())], names=["m", "h", "doc", "tie", "a"])

        single_windows = staged(cut.filter(F.col("others") > most).mapInArrow(each, "m bigint, h bigint, doc bigint, tie bigint, a int"), "windows")
        twice = single_windows.groupBy("m", "h").count().filter("count > 1")
        out = out.union(single_windows.join(twice, ["m", "h"]).select("doc", "tie", "a", F.lit(1).alias("n")))
    return out


def dedup_bytes(docs: DataFrame, window: int = 200) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept) for every row: the text's UTF-8 bytes without those that
    a string of ``window`` bytes covers which also starts anywhere else, the same document included.

    Strings are judged on the input; overlapping ones count. n_spans: maximal removed runs. kept: the remaining bytes;
    kept_sha256 its digest. Null is empty; texts shorter than the window keep everything. Null doc_ids are one doc_id.
    Rows that repeat a doc_id are copies like any others. Other columns are ignored; an empty table gives no rows.
    """
    docs = keyed(docs)
    gone = staged(repeated_places(docs, window), "removed")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d = zstandard.ZstdDecompressor()
        for batch in batches:
            ids, sizes, removed, spans, digests, kept = [], [], [], [], [], []
            for doc, z, at in zip(*(column(batch, c).to_pylist() for c in ("doc", "z", "at")), strict=True):
                raw = d.decompress(z)
                text, n, k = raw, 0, 0
                if at:
                    mask = covered(at, len(raw), window)
                    n, k = int(mask.sum()), len(_runs_of_true(mask)[0])
                    text = np.frombuffer(raw, np.uint8)[~mask].tobytes()
                ids.append(None if doc == NO_ID else doc)
                sizes.append(len(raw))
                removed.append(n)
                spans.append(k)
                digests.append(hashlib.sha256(text).hexdigest())
                kept.append(text)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *(pa.array(x, pa.int64()) for x in (sizes, removed, spans)), pa.array(digests, pa.string()), pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    whole = with_texts(docs, gone, ["a", "n"], "left").select("doc", "z", "at")
    return whole.mapInArrow(cut, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary")

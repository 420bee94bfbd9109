"""What substring deduplication over bytes and over words shares: finding places where whole windows repeat.

Each window (a fixed number of consecutive symbols of one document) is sampled by its smallest k-gram hash. Equal windows
have equal minima, and consecutive windows with the same minimum form a run, so one row per run stands for dozens of windows:
(m, region): the minimum and a hash of all the symbols that the run's windows cover. Only runs whose minimum
occurs elsewhere can hold repeated windows; of runs with equal regions all windows repeat; only of the rest one
representative per region is looked at window by window (as is a run that may hold a window twice by itself).

Every step counts with partial aggregation or is an equi-join, so a very frequent passage is one row per task in the
counts, and its rows in a join can be split. Equal regions within a batch are collapsed before any shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, doc_columns, rows_of, staged, texts

RUNS = "m bigint, region bigint, doc bigint, tie bigint, a int, n int, times int, own boolean"
PLACES = "doc bigint, tie bigint, a int, n int"
NO_ID = -(1 << 63)


def mixed(x: np.ndarray, salt: int) -> np.ndarray:
    """A 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15 + 2 * salt & 0xFFFFFFFFFFFFFFFF)
    return (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


def grams(x: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all k consecutive entries, by doubling."""
    out, size, done = None, 1, 0
    while True:
        if k & size:
            if out is None:
                out = x
            else:
                n = len(x) - done
                out = mixed(out[:n] + np.uint64(size), size) + x[done : done + n] if n > 0 else x[:0]
            done += size
        if done == k:
            return mixed(out[: max(0, len(out))], k)
        half = len(x) - size
        if half <= 0:
            return x[:0]
        x = mixed(x[:half], size) + x[size:]
        size *= 2


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    size = 1
    while 2 * size <= w:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    return x if size == w else np.minimum(x[: len(x) - (w - size)], x[w - size :])


def runs_of(symbols: np.ndarray, window: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(minimum, first window, number of windows, own) of each run of windows with one minimum.

    No run is longer than window - k + 1. own: the minimum occurs twice where windows of one run reach, so that a run
    may hold a window twice.
    """
    w = window - k + 1
    if len(symbols) < window:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool)
    g = grams(symbols, k)
    m = sliding_min(g, w)
    starts = np.concatenate([[0], np.flatnonzero(m[1:] != m[:-1]) + 1])
    sizes = np.diff(np.append(starts, len(m)))
    # an entry is a minimum of some window if it equals the largest minimum of the windows that hold it
    edge = np.zeros(w - 1, np.uint64)
    at = np.flatnonzero(g == ~sliding_min(~np.concatenate([edge, m, edge]), w))
    value = g[at]
    close = value[1:][(value[1:] == value[:-1]) & (at[1:] - at[:-1] <= w)]
    own = np.isin(m[starts], close) if len(close) else np.zeros(len(starts), bool)
    if (sizes > w).any():
        parts = -(-sizes // w)
        of = np.repeat(np.arange(len(starts)), parts)
        step = np.arange(len(of)) - np.repeat(np.cumsum(parts) - parts, parts)
        starts, sizes, own = starts[of] + step * w, np.minimum(w, sizes[of] - step * w), own[of]
    return m[starts], starts, sizes, own


def keyed(docs: DataFrame) -> DataFrame:
    """(doc, tie, text): doc stands for null ids too; rows that repeat a doc_id with another text differ in tie."""
    docs = doc_columns(docs, "doc_id", "text")
    return docs.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("tie"), "text")


def runs(docs: DataFrame, split: Callable[[str], tuple[np.ndarray, Callable[[int, int], bytes]]], window: int, k: int) -> DataFrame:
    """RUNS of all texts. split: text -> (64-bit symbols, slice of symbols as bytes).

    times counts the equal regions of a batch; times 0 marks a run that an earlier one of the batch equals.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_of(batches):
            ms, regions, ds, ties, starts, sizes, owns = [], [], [], [], [], [], []
            for d, tie, t in zip(column(batch, "doc").to_pylist(), column(batch, "tie").to_pylist(), texts(batch), strict=True):
                symbols, part = split(t)
                m, a, n, own = runs_of(symbols, window, k)
                if len(m):
                    ms.append(m)
                    starts.append(a)
                    sizes.append(n)
                    owns.append(own)
                    regions.append(np.array([xxhash.xxh64_intdigest(part(i, j)) for i, j in zip(a.tolist(), (a + n + (window - 1)).tolist(), strict=True)], np.uint64))
                    ds.append(np.full(len(m), d, np.int64))
                    ties.append(np.full(len(m), tie, np.int64))
            if not ms:
                continue
            m, region, d, tie, a, n, own = (np.concatenate(x) for x in (ms, regions, ds, ties, starts, sizes, owns))
            order = np.lexsort((a, tie, d, region, m))
            m, region, d, tie, a, n, own = (x[order] for x in (m, region, d, tie, a, n, own))
            new = np.concatenate([[True], (m[1:] != m[:-1]) | (region[1:] != region[:-1])])
            at = np.flatnonzero(new)
            times = np.zeros(len(m), np.int32)
            times[at] = np.diff(np.append(at, len(m)))
            again = np.concatenate([[False], (d[1:] == d[:-1]) & (tie[1:] == tie[:-1]) & (a[1:] == a[:-1])])
            m = np.where(new, m, mixed(m + a.astype(np.uint64) + d.view(np.uint64), 5))  # a spread key: nothing is looked up by it
            if (again & ~new).any():  # a repeated row of one document: counted, but no place of its own
                m, region, d, tie, a, n, times, own = (x[new | ~again] for x in (m, region, d, tie, a, n, times, own))
            yield pa.RecordBatch.from_arrays([pa.array(m.view(np.int64)), pa.array(region.view(np.int64)), pa.array(d), pa.array(tie), pa.array(a.astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(times), pa.array(own)], names=["m", "region", "doc", "tie", "a", "n", "times", "own"])

    return docs.mapInArrow(run, RUNS)


def repeated_runs(found: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of RUNS: (alike, first, single).

    alike: PLACES of runs that an earlier run with an equal region precedes. first: PLACES of the first of two or more
    equal ones. single: (m, others, doc, tie, a, n), the first run of each region, where the minimum has other regions or repeats within one.
    """
    counted = found.filter("times > 0").groupBy("m").agg(F.sum("times").alias("all"), F.max("own").alias("any_own")).filter("all > 1 or any_own")
    kept = staged(found.join(counted, "m", "left").filter("times = 0 or all is not null").drop("all", "any_own"), "runs")
    named = kept.filter("times > 0")
    place = F.struct("doc", "tie", "a")
    regions = staged(named.groupBy("m", "region").agg(F.min(place).alias("f"), F.sum("times").alias("times"), F.min("n").alias("n"), F.max("own").alias("own")), "regions")
    many = regions.groupBy("m").agg(F.count("*").alias("others"), F.max("own").alias("any_own")).filter("others > 1 or any_own").drop("any_own")
    single = regions.join(many, "m").select("m", "others", "f.doc", "f.tie", "f.a", "n")
    later = named.join(regions.select("m", "region", "f"), ["m", "region"]).filter(place != F.col("f"))
    alike = kept.filter("times = 0").select("doc", "tie", "a", "n").union(later.select("doc", "tie", "a", "n"))
    first = regions.filter("times > 1").select("f.doc", "f.tie", "f.a", "n")
    return alike, first, single


def squeezed(docs: DataFrame) -> DataFrame:
    """(doc, tie, z): texts as compressed bytes, to cross the network."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = zstandard.ZstdCompressor(level=3)
        for batch in rows_of(batches):
            yield pa.RecordBatch.from_arrays([column(batch, "doc"), column(batch, "tie"), pa.array([c.compress(t.encode("utf-8", "surrogatepass")) for t in texts(batch)], pa.binary())], names=["doc", "tie", "z"])

    return docs.mapInArrow(run, "doc bigint, tie bigint, z binary")


def with_texts(docs: DataFrame, places: DataFrame, fields: list[str], how: str) -> DataFrame:
    """docs' compressed texts with the list of their places (one row per document that has any, or per row of docs)."""
    lists = places.groupBy("doc", "tie").agg(F.collect_list(F.struct(*fields)).alias("at"))
    return squeezed(docs).join(lists, ["doc", "tie"], how)


def covered(at: list[dict] | None, size: int, window: int) -> np.ndarray:
    """Which of size symbols a window covers that starts in one of the places (a, n)."""
    edge = np.zeros(size + 1, np.int32)
    if at:
        a = np.fromiter((x["a"] for x in at), np.int64, len(at))
        n = np.fromiter((x["n"] for x in at), np.int64, len(at))
        np.add.at(edge, a, 1)
        np.add.at(edge, a + n - 1 + window, -1)
    return np.cumsum(edge[:-1]) > 0

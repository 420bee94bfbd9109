"""Substring deduplication over words, by level-wise doubling.

Windows of half the length come first: of every window of ``window`` words, the half-length window with the smallest
hash is its sample, and only samples that repeat at that length are extended to twice it. What survives is compared
at the full length; a window goes if its word sequence also starts earlier (smaller doc_id, or earlier in the document).
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
from .repeats import NO_ID, covered, keyed, mixed, repeated_runs, runs, with_texts

_POWER, _INVERSE = 0x9E3779B97F4A7C15 | 1, pow(0x9E3779B97F4A7C15 | 1, -1, 1 << 64)


class Powers:
    """Powers of an odd number and of its inverse modulo 2^64, as far as needed."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def __call__(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            n = max(n, 2 * len(self.up), 1 << 16)
            self.up = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n - 1, _POWER, np.uint64)]), dtype=np.uint64)
            self.down = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n - 1, _INVERSE, np.uint64)]), dtype=np.uint64)
        return self.up, self.down


def splitter() -> Callable[[str], tuple[np.ndarray, Callable[[int, int], bytes]]]:
    powers = Powers()

    def split(text: str) -> tuple[np.ndarray, Callable[[int, int], bytes]]:
        parts = text.encode("utf-8", "surrogatepass").split()
        joined = b" ".join(parts)
        ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
        starts = np.concatenate([[0], ends[:-1] + 1]) if len(parts) else ends
        up, down = powers(len(joined) + 1)
        sums = np.concatenate([[np.uint64(0)], np.cumsum((np.frombuffer(joined, np.uint8).astype(np.uint64) + np.uint64(1)) * up[: len(joined)], dtype=np.uint64)])
        symbols = mixed((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64), 3)
        return symbols, lambda i, j: joined[starts[i] : ends[j - 1]]

    return split


def removed_windows(docs: DataFrame, window: int = 20) -> DataFrame:
    """PLACES (doc, tie, a, n): n consecutive windows from word a on, each of which starts earlier too."""
    split = splitter()
    alike, _, single = repeated_runs(runs(docs, split, window, window // 2))

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d = zstandard.ZstdDecompressor()
        for batch in batches:
            for r in batch.to_pylist():
                _, part = split(d.decompress(r["z"]).decode("utf-8", "surrogatepass"))
                rows = [(x["m"], xxhash.xxh64_intdigest(part(a, a + window), 9) - (1 << 63), a) for x in r["at"] for a in range(x["a"], x["a"] + x["n"])]
                m, h, a = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(m, pa.int64()), pa.array(h, pa.int64()), pa.array([r["doc"]] * len(a), pa.int64()), pa.array([r["tie"]] * len(a), pa.int64()), pa.array(a, pa.int32())], names=["m", "h", "doc", "tie", "a"])

    wide = staged(with_texts(docs, single, ["m", "a", "n"], "inner").select("doc", "tie", "z", "at").mapInArrow(extend, "m bigint, h bigint, doc bigint, tie bigint, a int"), "windows")
    place = F.struct("doc", "tie", "a")
    first = wide.groupBy("m", "h").agg(F.min(place).alias("f"), F.count("*").alias("times")).filter("times > 1").drop("times")
    later = wide.join(first, ["m", "h"]).filter(place != F.col("f")).select("doc", "tie", "a", F.lit(1).alias("n"))
    return alike.union(later)


def dedup_words(docs: DataFrame, window: int = 20) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, kept) for every row: the text's words without those that a window covers
    whose word sequence also starts earlier (smaller doc_id, or same document and earlier start).

    Words are runs of anything but ASCII white space; windows are judged on the input. kept: the remaining words, joined
    by one space; kept_sha256 its digest. Null and short texts keep everything. Null doc_ids come first, as one doc_id.
    Rows that repeat a doc_id and its text are one document; rows that repeat a doc_id with another text count in an
    order that a hash of the text fixes. Other columns are ignored; an empty table gives no rows.
    """
    docs = keyed(docs)
    gone = staged(removed_windows(docs, window), "removed")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d = zstandard.ZstdDecompressor()
        for batch in batches:
            ids, words, removed, digests, kept = [], [], [], [], []
            for doc, z, at in zip(*(column(batch, c).to_pylist() for c in ("doc", "z", "at")), strict=True):
                parts = d.decompress(z).split()
                text = b" ".join(parts)
                n = 0
                if at:
                    mask = covered(at, len(parts), window)
                    n = int(mask.sum())
                    text = b" ".join([p for p, m in zip(parts, mask.tolist(), strict=True) if not m])
                ids.append(None if doc == NO_ID else doc)
                words.append(len(parts))
                removed.append(n)
                digests.append(hashlib.sha256(text).hexdigest())
                kept.append(text.decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(words, pa.int64()), pa.array(removed, pa.int64()), pa.array(digests, pa.string()), pa.array(kept, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept"])

    whole = with_texts(docs, gone, ["a", "n"], "left").select("doc", "z", "at")
    return whole.mapInArrow(cut, "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string, kept string")

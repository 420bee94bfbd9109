"""Packing: mixture-controlled windows by deficit round-robin over source queues.

Each source is a queue of tokens. Every window of ``length`` tokens takes from each queue its share of the target
mixture (by default the corpus' own token shares, so that all queues end together); what a queue is owed after a
window (its deficit) is carried into the next. Windows come in blocks. What each queue has given at the start of a
block is a divisor apportionment of all earlier tokens, so deficits carry from block to block in closed form, and any
task can run the rounds of just the blocks that its documents touch, without another task's results.

Two passes over the documents, neither of which shuffles text or token ids: the first encodes and stages ids with each
document's place in its task's part of the queue; a table of (task, queue) sums turns that into a place in the whole
queue; the second reads the staged ids and cuts each document at the windows' borders.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import column, doc_columns, rows_of, staged, texts
from .tokens import default_encoder

PIECES = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint, source string"


class Schedule:
    """Which tokens of which queue each window takes: a function of the queues' sizes and weights only."""

    def __init__(self, totals: list[int], weights: list[float] | None = None, length: int = 2048, block: int = 512):
        self.totals = np.array(totals, np.int64)
        self.weights = np.array(weights if weights is not None else totals, np.float64)
        self.weights = np.maximum(self.weights, 1e-12)
        self.length, self.block = length, block
        self.tokens = int(self.totals.sum())
        self.per_block = length * block
        self.n_blocks = -(-self.tokens // self.per_block) if self.tokens else 0
        self.given = lru_cache(4096)(self._given)
        self.rounds = lru_cache(64)(self._rounds)

    def _count(self, t: float) -> np.ndarray:
        """Tokens of each queue whose priority (2i+1)/weight is at most t."""
        c = np.minimum(np.floor((t * self.weights + 1) / 2), self.totals).astype(np.int64)
        c = np.maximum(c, 0)
        c += (c < self.totals) & ((2 * c + 1) / self.weights <= t)
        c -= (c > 0) & ((2 * c - 1) / self.weights > t)
        return c

    def _given(self, k: int) -> np.ndarray:
        """Tokens that each queue has given before block k: the k * per_block first by priority, ties by queue."""
        want = min(k * self.per_block, self.tokens)
        if want == self.tokens:
            return self.totals
        low, high = 0.0, float(((2 * self.totals + 1) / self.weights).max())
        for _ in range(80):
            mid = (low + high) / 2
            if int(self._count(mid).sum()) <= want:
                low = mid
            else:
                high = mid
        c = self._count(low)
        while (short := want - int(c.sum())) > 0:
            priority = np.where(c < self.totals, (2 * c + 1) / self.weights, np.inf)
            c[np.argsort(priority, kind="stable")[:1]] += 1
        return c

    def _rounds(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Of block k: tokens that each queue has given before each of its windows, and where its part stands in each window."""
        start, end = self.given(k), self.given(k + 1)
        left = end - start
        n = -(-int(left.sum()) // self.length)
        cum, at = np.empty((len(left), n + 1), np.int64), np.empty((len(left), n), np.int64)
        cum[:, 0] = start
        ideal = np.minimum(self.weights * (k * self.per_block / self.weights.sum()), self.totals)
        deficit = ideal - start
        deficit -= deficit.mean()
        for w in range(n):
            size = min(self.length, int(left.sum()))
            live = np.where(left > 0, self.weights, 0.0)
            deficit = deficit + live * (size / live.sum())
            take = np.clip(np.floor(deficit), 0, left).astype(np.int64)
            while (short := size - int(take.sum())) != 0:
                owed = deficit - take
                if short > 0:
                    order = np.argsort(-owed, kind="stable")
                    order = order[(left - take)[order] > 0]
                    if short >= len(order):
                        take[order] += np.minimum((left - take)[order], short // len(order))
                    else:
                        take[order[:short]] += 1
                else:
                    order = np.argsort(owed, kind="stable")
                    order = order[take[order] > 0]
                    take[order[: -short]] -= 1
            deficit, left = deficit - take, left - take
            cum[:, w + 1] = cum[:, w] + take
            at[:, w] = np.cumsum(take) - take
        return cum, at

    def block_of(self, queue: int, position: int) -> int:
        """The block that takes this token of the queue."""
        low, high = 0, self.n_blocks
        while high - low > 1:
            mid = (low + high) // 2
            if self.given(mid)[queue] <= position:
                low = mid
            else:
                high = mid
        return low

    def cut(self, queue: int, position: int, n: int) -> Iterator[tuple[int, int, int, int]]:
        """(start in the n tokens, length, window, offset) of each piece of the queue's tokens from position on."""
        k, end, begin = self.block_of(queue, position), position + n, position
        while position < end:
            cum, at = self.rounds(k)
            c = cum[queue]
            a = max(0, int(np.searchsorted(c, position, "right")) - 1)
            b = int(np.searchsorted(c, end, "left"))
            edges = np.clip(c[a : b + 1], position, end)
            for w in np.flatnonzero(np.diff(edges)):
                s = int(edges[w])
                yield s - begin, int(edges[w + 1]) - s, k * self.block + a + int(w), int(at[queue, a + w] + s - c[a + w])
            position = max(position, min(end, int(c[-1])))
            k += 1


def with_queues(rows: DataFrame, weighted: list[str], queues: int = 4096) -> DataFrame:
    """rows with their queue: "=" and the source, or beyond that many sources "#" and a bucket for the smaller ones.

    Half of the queues are then buckets. Sources with a weight of their own and the largest by bytes of text keep
    their queues: at most ``length`` sources can have a share worth a token a window.
    """
    own = F.concat(F.lit("="), "source")
    if rows.select("source").distinct().limit(queues + 1).count() <= queues:
        return rows.withColumn("queue", own)
    sizes = rows.groupBy("source").agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 1).alias("size"))
    named = sizes.orderBy(F.desc("size"), "source").limit(queues // 2).select("source")
    if weighted:
        named = named.union(rows.sparkSession.createDataFrame([(w,) for w in weighted], "source string"))
    named = F.broadcast(named.distinct().withColumn("named", F.lit(True)))  # names only, half the queues and the given weights
    bucket = F.format_string("#%05d", F.pmod(F.xxhash64("source"), F.lit(queues // 2)))
    return rows.join(named, "source", "left").withColumn("queue", F.when(F.col("named"), own).otherwise(bucket)).drop("named")


def encoded(docs: DataFrame, encoder: Callable = default_encoder, end_id: int = 1, weighted: list[str] | None = None, most: int = 2048) -> DataFrame:
    """(queue, doc_id, chunk, start, n, ids): ids of each text and end_id as little-endian uint16; start counts the
    tokens of the same queue that the same task has seen before, chunk is that task."""
    rows = doc_columns(docs, "doc_id", "text", "source").withColumn("source", F.coalesce("source", F.lit("")))

    def encode(batches):
        enc, chunk, seen = encoder(), TaskContext.get().partitionId(), {}
        for batch in rows_of(batches):
            ids, starts, sizes = [], [], []
            names = column(batch, "queue").to_pylist()
            for q, t in zip(names, texts(batch), strict=True):
                x = np.append(enc.encode(t), np.uint16(end_id))
                ids.append(x.tobytes())
                sizes.append(len(x))
                starts.append(seen.get(q, 0))
                seen[q] = seen.get(q, 0) + len(x)
            yield pa.RecordBatch.from_arrays([column(batch, "queue"), column(batch, "source"), column(batch, "doc_id"), pa.array([chunk] * len(ids), pa.int32()), pa.array(starts, pa.int64()), pa.array(sizes, pa.int64()), pa.array(ids, pa.binary())], names=["queue", "source", "doc_id", "chunk", "start", "n", "ids"])

    return with_queues(rows, weighted or [], 2 * max(2048, most)).mapInArrow(encode, "queue string, source string, doc_id bigint, chunk int, start bigint, n bigint, ids binary")


def pack(spark: SparkSession, docs: DataFrame, weights: dict[str, float] | None = None, length: int = 2048, block: int = 512, encoder: Callable = default_encoder, end_id: int = 1) -> DataFrame:
    """Pieces of all documents in windows of ``length`` tokens; each token lies in exactly one piece.

    weights: target share of each source (missing ones: their token count); default: the corpus' own shares. Every
    window but the last is full. A queue that ends early leaves its share to the others.
    Null text is empty (only the end id); a null source is ''; null and repeated doc_ids are kept as rows of their own;
    an empty table gives no rows; columns other than doc_id, text and source are ignored.
    Beyond 4,096 sources (twice ``length``, if that is more) only the smaller ones without a weight share queues, by
    hash; such a queue's weight is the sum of its members' (their token counts).
    """
    tokens = staged(encoded(docs, encoder, end_id, list(weights or ()), length), "tokens")
    sums = tokens.groupBy("queue", "chunk").agg(F.sum("n").alias("n"))
    before = Window.partitionBy("queue").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = staged(sums.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))), "offsets")
    totals = {r["queue"]: r["n"] for r in offsets.groupBy("queue").agg(F.sum("n").alias("n")).collect()}  # at most 4,096 rows and one for each weight
    names = sorted(totals)
    index = {q: i for i, q in enumerate(names)}
    sizes = [totals[q] for q in names]
    shares = None if weights is None else [float(weights.get(q[1:], totals[q]) if q[0] == "=" else totals[q]) for q in names]

    def cut(batches):
        plan = Schedule(sizes, shares, length, block)
        for batch in rows_of(batches, text="ids"):
            out: list[list] = [[] for _ in range(8)]
            for q, source, doc, at, n, ids in zip(*(column(batch, c).to_pylist() for c in ("queue", "source", "doc_id", "at", "n", "ids")), strict=True):
                raw = memoryview(np.frombuffer(ids, "<u2").astype("<u4").tobytes())
                for start, size, window, offset in plan.cut(index[q], at, n):
                    for column_, value in zip(out, (doc, start, size, zlib.crc32(raw[4 * start : 4 * (start + size)]), n, window, offset, source), strict=True):
                        column_.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.string() if i == 7 else pa.int64()) for i, x in enumerate(out)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "source"])

    placed = tokens.join(offsets.select("queue", "chunk", "before"), ["queue", "chunk"]).withColumn("at", F.col("start") + F.col("before"))
    return placed.select("queue", "source", "doc_id", "at", "n", "ids").mapInArrow(cut, PIECES)

"""SimHash near-duplicates: fingerprints of word shingles, linked where few bits differ.

Candidates come from a segment-popcount embedding: a fingerprint becomes the vector of the bit counts of its 16
four-bit segments. The Manhattan distance of two such vectors is at most the number of bits in which the fingerprints
differ, so a range join of the vectors under that distance finds every link. The join runs on a unit grid: a vector is
put into its own cell and into the cells one step away; two vectors at distance two or less share a cell. A cell with
few fingerprints is joined with itself and each pair is verified exactly. In a cell with many, every member is put
into the cells of its one-bit neighbours instead: fingerprints differ in two bits or fewer exactly if they share such
a cell, all of whose members are linked, so one link from each member to the cell's smallest suffices. No group's pairs are
enumerated, and no link is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, doc_columns, numbered, rows_of, staged, texts
from .components import components

SEGMENTS, SEGMENT_BITS = 16, 4


def fingerprint(text: str, words: int = 3, seed: int = 42) -> int:
    """64-bit SimHash: a bit is set if it is in over half the hashes of all word shingles, repeats included."""
    import xxhash

    parts = text.encode("utf-8", "surrogatepass").lower().split()  # bytes.lower() and split() know ASCII only
    if not parts:
        return 0
    hashed = xxhash.xxh64_intdigest
    if len(parts) <= words:
        return hashed(b" ".join(parts), seed)
    joined = b" ".join(parts)
    ends = np.cumsum([len(p) + 1 for p in parts])
    starts = np.concatenate([[0], ends[: -words]]).tolist()
    stops = (ends[words - 1 :] - 1).tolist()
    ones, n = np.zeros(64, np.int64), len(starts)
    for i in range(0, n, 65536):
        h = np.array([hashed(joined[a:b], seed) for a, b in zip(starts[i : i + 65536], stops[i : i + 65536], strict=True)], np.uint64)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, words: int = 3, seed: int = 42) -> DataFrame:
    """docs (doc_id, text, any further columns) with fp, the fingerprint as a signed long, in place of the text. Null and
    wordless texts have fingerprint zero."""
    others = [(n, kind) for n, kind in docs.dtypes if n != "text"]
    names = [n for n, _ in others]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_of(batches):
            fp = np.array([fingerprint(t, words, seed) for t in texts(batch)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*(column(batch, n) for n in names), pa.array(fp)], names=[*names, "fp"])

    return docs.mapInArrow(run, ", ".join(f"`{n}` {kind}" for n, kind in [*others, ("fp", "bigint")]))


def _cells(column: str) -> F.Column:
    """Keys of a fingerprint's popcount vector (packed, three bits a segment) and of the vectors one step away."""
    counts = [F.bit_count(F.shiftrightunsigned(F.col(column), SEGMENT_BITS * i).bitwiseAND(F.lit(15))) for i in range(SEGMENTS)]
    packed = sum((F.shiftleft(c.cast("long"), 3 * i) for i, c in enumerate(counts)), F.lit(0).cast("long"))
    keys = [packed]
    for i, c in enumerate(counts):
        keys += [F.when(c < SEGMENT_BITS, packed + F.lit(1 << 3 * i)), F.when(c > 0, packed - F.lit(1 << 3 * i))]
    return F.filter(F.array(*keys), lambda k: k.isNotNull())


def links(fps: DataFrame, most: int = 32) -> DataFrame:
    """(a, b) between distinct fingerprints (column fp) that differ in at most two bits: all such pairs from cells of at
    most ``most`` fingerprints, and from larger cells pairs that connect the same fingerprints."""
    parts = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = F.xxhash64("fp")  # an expression of its own: dealing by fp itself would count as done and be coalesced
    placed = fps.repartition(parts, spread).select("fp", F.explode(_cells("fp")).alias("cell"))
    sizes = placed.groupBy("cell").count().filter("count > 1")
    placed = staged(placed.join(sizes, "cell"), "cells")
    few = placed.filter(F.col("count") <= most)
    pairs = few.select("cell", F.col("fp").alias("a")).join(few.select("cell", F.col("fp").alias("b")), "cell").filter("a < b and bit_count(a ^ b) <= 2").select("a", "b")
    many = placed.filter(F.col("count") > most).select("fp").distinct().repartition(parts, spread)
    flips = F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit((1 << i) - (1 << 64) if i == 63 else 1 << i)) for i in range(64)])
    near = many.select("fp", F.explode(flips).alias("key"))
    low = near.groupBy("key").agg(F.min("fp").alias("low"), F.count("*").alias("n")).filter("n > 1").drop("n")
    stars = near.join(low, "key").filter("fp <> low").select(F.col("fp").alias("a"), F.col("low").alias("b"))
    return pairs.union(stars).distinct()


def near_duplicates(docs: DataFrame, words: int = 3, seed: int = 42) -> DataFrame:
    """One row per row of docs: doc_id, fingerprint (16 hex digits), component_id, fp.

    component_id: the smallest doc_id reachable over links of two or fewer differing bits, its own included. Texts
    without words (null and empty ones too) have fingerprint zero, linked like any other. A null doc_id takes part as a
    row, but is no component's name unless all are null. An empty table gives no rows; other columns are ignored.
    """
    fps = staged(fingerprints(doc_columns(docs, "doc_id", "text"), words, seed), "fingerprints")
    of = _groups(fps).select("fp", "component_id")
    return fps.join(of, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _groups(fps: DataFrame) -> DataFrame:
    """(fp, root, component_id): of each distinct fingerprint its group (the smallest fingerprint) and the group's smallest doc_id."""
    groups = fps.groupBy("fp").agg(F.min("doc_id").alias("low"))
    linked = components(links(groups.select("fp")))
    named = staged(groups.join(linked.select(F.col("node").alias("fp"), F.col("component").alias("root")), "fp", "left").withColumn("root", F.coalesce("root", "fp")), "groups")
    smallest = named.groupBy("root").agg(F.min("low").alias("component_id"))
    return named.join(smallest, "root").select("fp", "root", "component_id")


def one_of_each(docs: DataFrame, words: int = 3, seed: int = 42) -> DataFrame:
    """One row (all its columns) of each group of near copies: the one with the smallest doc_id.

    Rows without doc_id come last; of rows of a group with the same doc_id one stays. Rows of one doc_id (or none) in
    different groups have nothing to do with each other. Null and empty texts are one group.
    """
    columns = docs.columns
    docs, row = numbered(docs)
    ids = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col(row).alias("row"))
    fps = staged(fingerprints(ids, words, seed), "fingerprints")
    of = fps.join(_groups(fps).select("fp", "root"), "fp").groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "row")).alias("first"))
    return docs.join(of.select(F.col("first.row").alias(row)), row, "left_semi").select(*columns)

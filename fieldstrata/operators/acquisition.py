"""Which rows to label next: separation of clusterings, and similarity to prototypes of a class."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.keyed import key
from .materialise import kept

EPS = 1e-12


def silhouettes(df: DataFrame, ident: str, vector: str, clusterings: list[str], sample: int | None = 10_000, seed: int = 0, block: int = 1024) -> DataFrame:
    """(clustering, n, silhouette): the mean silhouette of each clustering (a column of df), by Euclidean distances.

    A row's value is (b - a) / max(a, b): a is the mean distance to its cluster's other rows (0 if it has none), b the
    smallest mean distance to another cluster's rows. A clustering of one cluster has 0. Of more than ``sample`` rows
    the ones with the smallest keys are taken. Rows meet in pairs of blocks, each one matrix product in one task, which
    returns sums of distances by row and cluster; all clusterings share the distances.
    """
    rows = df.select(F.col(ident).alias("i"), F.col(vector).cast("array<double>").alias("v"), F.array(*[F.col(c).cast("string") for c in clusterings]).alias("c"))
    if sample is not None:
        rows = rows.orderBy(key(seed, "i"), "i").limit(sample)
    rows = kept(rows)
    blocks = max(1, -(-rows.count() // block))
    dealt = rows.withColumn("b", F.pmod(F.xxhash64("i"), F.lit(blocks)).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    left, right = dealt.withColumnRenamed("b", "p").withColumn("q", every), dealt.withColumnRenamed("b", "q").withColumn("p", every)

    def sums(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(x) and len(y):
            a, b = np.stack(x["v"].tolist()), np.stack(y["v"].tolist())
            middle = b.mean(0)
            a, b = a - middle, b - middle
            d = np.sqrt(np.maximum((a**2).sum(1)[:, None] + (b**2).sum(1)[None] - 2 * a @ b.T, 0))
            d[x["i"].to_numpy()[:, None] == y["i"].to_numpy()[None]] = 0
            own, others = np.array(x["c"].tolist(), object), np.array(y["c"].tolist(), object)
            for k, name in enumerate(clusterings):
                for c in set(others[:, k].tolist()):
                    of = others[:, k] == c
                    out.append(pd.DataFrame({"clustering": name, "i": x["i"], "own": own[:, k], "cluster": c, "total": d[:, of].sum(1), "n": int(of.sum())}))
        return pd.concat(out) if out else pd.DataFrame({"clustering": [], "i": [], "own": [], "cluster": [], "total": [], "n": []})

    kind = dict(df.dtypes)[ident]
    part = left.groupBy("p", "q").cogroup(right.groupBy("p", "q")).applyInPandas(sums, f"clustering string, i {kind}, own string, cluster string, total double, n long")
    cells = part.groupBy("clustering", "i", "own", "cluster").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
    same = F.col("own").eqNullSafe(F.col("cluster"))
    a = F.sum(F.when(same, F.when(F.col("n") > 1, F.col("total") / (F.col("n") - 1)).otherwise(0.0)))
    ab = cells.groupBy("clustering", "i").agg(a.alias("a"), F.min(F.when(~same, F.col("total") / F.col("n"))).alias("b"))
    value = F.when(F.col("b").isNull(), 0.0).otherwise((F.col("b") - F.col("a")) / F.greatest("a", "b", F.lit(EPS)))
    return ab.groupBy("clustering").agg(F.count("*").alias("n"), F.avg(value).alias("silhouette"))


def least_separated(scores: DataFrame) -> DataFrame:
    """The clustering whose silhouette is nearest to 0 (not the largest; the first by name of equals)."""
    return scores.groupBy().agg(F.min_by(F.struct("clustering", "silhouette"), F.struct(F.round(F.abs("silhouette"), 9), "clustering")).alias("s")).select("s.*")


def _unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), EPS)


def similarity_to(directions: np.ndarray):
    """Column function: the largest cosine similarity of a vector to any direction (of length 1); null for null vectors.
    Zero vectors have 0, and so has every vector where there is no direction."""

    @F.pandas_udf("double")
    def largest(v: pd.Series) -> pd.Series:
        out = pd.Series(np.nan, index=v.index).where(v.isna(), 0.0)
        there = np.flatnonzero(v.notna())
        if len(there) and len(directions):
            out.iloc[there] = (_unit(np.stack(v.iloc[there].tolist()).astype(float)) @ directions.T).max(1)
        return out.astype(object).where(v.notna(), None)

    return largest


def prototypes(df: DataFrame, ident: str, vector: str, k: int = 3, rounds: int = 10, seed: int = 0) -> np.ndarray:
    """k directions (unit vectors, a row each) of the rows' vectors, by spherical k-means.

    The first are the k rows with the smallest keys; each round gives every row to the most similar one (to nine places;
    the first of equals) and moves it to its rows' normalised sum. One without rows stays. Fewer rows than k give as many
    prototypes. A round is one scan, whose tasks return a sum a prototype; only k vectors are ever on the driver.
    """
    rows = df.filter(F.col(vector).isNotNull()).select(ident, F.col(vector).cast("array<double>").alias("v"))
    now = _unit(np.array([r.v for r in rows.orderBy(key(seed, ident), ident).limit(k).collect()], float)) if k else np.empty((0, 0))

    def nearest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = np.zeros_like(now)
        for batch in batches:
            if len(batch):
                x = _unit(np.stack(batch["v"].tolist()))
                np.add.at(sums, np.round(x @ now.T, 9).argmax(1), x)
        c, d = np.nonzero(sums)
        yield pd.DataFrame({"c": c, "d": d, "x": sums[c, d]})

    for _ in range(rounds if now.size else 0):
        moved = np.zeros_like(now)
        for r in rows.select("v").mapInPandas(nearest, "c int, d int, x double").groupBy("c", "d").agg(F.sum("x").alias("x")).collect():  # k vectors
            moved[r.c, r.d] = r.x
        length = np.linalg.norm(moved, axis=1, keepdims=True)
        new = np.where(length > EPS, moved / np.maximum(length, EPS), now)
        if np.array_equal(new, now):
            break
        now = new
    return now


def prototype_scores(df: DataFrame, vector: str, directions: np.ndarray, destination: Column, novelty: Column, drop: Column, weights: tuple[float, float, float] = (1.0, 1.0, 0.0), floor: float = 0.3, least_drop: float = 0.05) -> DataFrame:
    """df with ``similarity`` (the largest to any prototype), ``eligible`` and ``acquisition``.

    A row is eligible if its similarity is at least ``floor`` and ``drop`` above ``least_drop``; acquisition is the
    weighted mean of similarity, destination and novelty, and null for others: they are left out before any ranking.
    """
    out = df.withColumn("similarity", similarity_to(directions)(F.col(vector).cast("array<double>")))
    out = out.withColumn("eligible", (F.col("similarity") >= floor) & (drop > least_drop))
    a, b, c = weights
    return out.withColumn("acquisition", F.when(F.col("eligible"), (F.col("similarity") * a + destination * b + novelty * c) / (a + b + c)))

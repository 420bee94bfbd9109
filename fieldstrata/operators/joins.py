"""Joins with the checks that survey tables need."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stratum_lookup(zones: DataFrame, zone: str, classes: int) -> DataFrame:
    """Each zone with each class, and an id from both: an explode of a short range, not a join."""
    out = zones.withColumn("cls", F.explode(F.sequence(F.lit(1), F.lit(classes))))
    return out.withColumn("stratum_id", F.col(zone) * classes + F.col("cls"))


def keep_first(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The row of each key with the smallest order (a combined aggregate, no sort)."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("r_")).select(*keys, "r_.*")


def violations(df: DataFrame, keys: list[str]) -> DataFrame:
    """How many keys occur more than once."""
    return df.groupBy(*keys).count().filter("count > 1").agg(F.count("*").alias("violations")).select(F.lit(",".join(keys)).alias("key"), "violations")


def many_to_one(df: DataFrame, lookup: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """A join whose right side must have each key once; a repeated key raises when the plan runs."""
    n = [c for c in lookup.columns if c not in keys]
    one = lookup.groupBy(*keys).agg(F.count("*").alias("n_"), *[F.first(c).alias(c) for c in n])
    one = one.withColumn("n_", F.when(F.col("n_") > 1, F.raise_error(F.lit("repeated key in a lookup")).cast("long")).otherwise(F.col("n_"))).filter("n_ = 1").drop("n_")
    return df.join(one, keys, how)


def replaced(df: DataFrame, redo: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key is not redone, and all redone rows."""
    return df.join(redo.select(*keys).distinct(), keys, "left_anti").unionByName(redo)


def exclude(df: DataFrame, key: str, taken: DataFrame, taken_key: str) -> DataFrame:
    """Rows whose key, as text, is not taken."""
    return df.withColumn("k_", F.col(key).cast("string")).join(taken.select(F.col(taken_key).cast("string").alias("k_")).distinct(), "k_", "left_anti").drop("k_")


def membership(df: DataFrame, members: DataFrame, keys: list[str]) -> DataFrame:
    """How many rows there are and how many match; none at all raises."""
    j = df.join(members.select(*keys).distinct().withColumn("m_", F.lit(1)), keys, "left").agg(F.count("*").alias("n"), F.count("m_").alias("matched"))
    return j.withColumn("matched", F.when(F.col("matched") == 0, F.raise_error(F.lit("no row matches")).cast("long")).otherwise(F.col("matched")))


def attach(df: DataFrame, features: DataFrame, keys: list[str]) -> DataFrame:
    """Features by key; mask is 1 where there are any, else 0."""
    return df.join(features.withColumn("mask_", F.lit(1)), keys, "left").withColumn("mask", F.coalesce("mask_", F.lit(0))).drop("mask_")


def impute_by_fold(df: DataFrame, fold: str, value: str) -> DataFrame:
    """Missing values become the mean of the other folds' rows."""
    f = df.groupBy(fold).agg(F.sum(value).alias("fs_"), F.count(value).alias("fn_"))
    t = f.agg(F.sum("fs_").alias("s_"), F.sum("fn_").alias("n_"))
    means = f.crossJoin(F.broadcast(t)).select(fold, ((F.col("s_") - F.col("fs_")) / (F.col("n_") - F.col("fn_"))).alias("m_"))  # one row
    return df.join(means, fold).withColumn(value, F.coalesce(value, "m_")).drop("m_")


def nearest_reference(df: DataFrame, reference: DataFrame, ident: str, vector: str, most: int = 4096) -> DataFrame:
    """The smallest cosine distance from each row to any reference row; no rows if there is no reference.

    Rows and references are dealt into blocks of about ``most`` vectors; each pair of blocks is one matrix product in one
    task, and the blocks' minima are combined by id. The work is rows times references.
    """
    import numpy as np

    rows, refs = (max(1, -(-x.count() // most)) for x in (df, reference))
    dealt = lambda x, n, name: x.withColumn(name, F.pmod(F.xxhash64(vector), F.lit(n)).cast("int"))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = dealt(df.select(ident, vector), rows, "row_block").withColumn("ref_block", every(refs))
    right = dealt(reference.select(vector), refs, "ref_block").withColumn("row_block", every(rows))

    def nearest(x: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        if not len(x) or not len(r):
            return pd.DataFrame({ident: [], "distance": []})
        a, b = (np.array(t[vector].tolist(), np.float64) for t in (x, r))
        a, b = (t / np.maximum(np.linalg.norm(t, axis=1, keepdims=True), 1e-12) for t in (a, b))
        best = np.concatenate([(a[at : at + 512] @ b.T).max(axis=1) for at in range(0, len(a), 512)])
        return pd.DataFrame({ident: x[ident].to_numpy(), "distance": 1 - best})

    keys = ("row_block", "ref_block")
    out = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(nearest, f"{ident} {dict(df.dtypes)[ident]}, distance double")
    return out.groupBy(ident).agg(F.min("distance").alias("distance"))


def within_radius(df: DataFrame, ident: str, x: str, y: str, radius: float) -> DataFrame:
    """Pairs of different rows within the radius: each row meets the rows of grid cells a quarter as wide, its own and up to
    four away. The pairs grow with the square of the rows; they are made in many tasks and held in none."""
    from .materialise import tasks

    n, width, reach = tasks(df), radius / 4 * (1 + 1e-9), range(-4, 5)  # a hair wider, so that rounding moves no row beyond the fourth cell
    a = df.withColumn("cx_", F.floor(F.col(x) / width)).withColumn("cy_", F.floor(F.col(y) / width))
    offsets = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in reach for j in reach])
    b = a.select(F.col(ident).alias("other"), F.col(x).alias("ox_"), F.col(y).alias("oy_"), "cx_", "cy_", F.explode(offsets).alias("o_"))
    b = b.select("other", "ox_", "oy_", (F.col("cx_") + F.col("o_.i")).alias("cx_"), (F.col("cy_") + F.col("o_.j")).alias("cy_"))
    met = a.select(ident, x, y, "cx_", "cy_").repartition(n, "cx_", "cy_").join(b.repartition(n, "cx_", "cy_"), ["cx_", "cy_"])
    return met.filter((F.col(ident) != F.col("other")) & (F.hypot(F.col(x) - F.col("ox_"), F.col(y) - F.col("oy_")) <= radius)).select(ident, "other")


def paired_arms(df: DataFrame, arm: str, base: str, keys: list[str], metric: str, by: list[str]) -> DataFrame:
    """Each arm's difference from the baseline arm on equal keys: mean, deviation, standard error, wins and pairs."""
    b = df.filter(F.col(arm) == base).select(*keys, F.col(metric).alias("b_"))
    j = df.filter(F.col(arm) != base).join(b, keys).withColumn("d_", F.col(metric) - F.col("b_"))
    return j.groupBy(arm, *by).agg(F.avg("d_").alias("delta"), F.stddev_samp("d_").alias("sd"), (F.stddev_samp("d_") / F.sqrt(F.count("*"))).alias("se"), F.count_if(F.col("d_") > 0).alias("wins"), F.count("*").alias("n"))


def neighbours(df: DataFrame, ident: str, vector: str, k: int, block: int = 4096) -> DataFrame:
    """(ident, other, similarity): the k most similar other rows by cosine, ties to the smaller id.

    Rows are dealt into blocks by id; each pair of blocks is one matrix product in one task, whose k best per row meet in
    a top-k. The number of block pairs grows with the square of the rows: meant for labelled samples, not whole pools.
    """
    import numpy as np
    from pyspark.sql import Window

    n = max(1, -(-df.count() // block))
    kind = dict(df.dtypes)[ident]
    b = df.select(ident, vector, F.pmod(F.xxhash64(ident), F.lit(n)).cast("int").alias("block"))
    left = b.select(ident, vector, "block", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("with_"))
    right = b.select(ident, vector, F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("block"), F.col("block").alias("with_"))

    def best(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        if not len(x) or not len(y):
            return pd.DataFrame({ident: [], "other": [], "similarity": []})
        a, c = (np.array(t[vector].tolist(), np.float64) for t in (x, y))
        a, c = (t / np.maximum(np.linalg.norm(t, axis=1, keepdims=True), 1e-12) for t in (a, c))
        ids, own, found = y[ident].to_numpy(), x[ident].to_numpy(), []
        for at in range(0, len(x), 512):
            s = np.round(a[at : at + 512] @ c.T, 9)
            s[own[at : at + 512, None] == ids[None, :]] = -2.0
            last = np.partition(s, -min(k, len(y)), axis=1)[:, -min(k, len(y))]
            i, j = np.nonzero((s >= last[:, None]) & (s > -2))  # the k best, and what ties with the last of them
            order = np.lexsort((ids[j], -s[i, j], i))
            i, j = i[order], j[order]
            top = np.arange(len(i)) - np.searchsorted(i, i) < k
            found.append(pd.DataFrame({ident: own[at + i[top]], "other": ids[j[top]], "similarity": s[i[top], j[top]]}))
        return pd.concat(found)

    part = left.groupBy("block", "with_").cogroup(right.groupBy("block", "with_")).applyInPandas(best, f"{ident} {kind}, other {kind}, similarity double")
    w = Window.partitionBy(ident).orderBy(F.desc("similarity"), "other")
    return part.withColumn("rn_", F.row_number().over(w)).filter(F.col("rn_") <= k).drop("rn_")

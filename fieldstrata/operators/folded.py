"""Transforms fitted without the fold that they are applied to: principal components and ridge imputation of vectors.

Sums of vectors and of their products are added up by fold in one scan of the rows; what a fold's model is fitted on is
the total less the fold's own sums. Models are solved on the driver from those matrices, whose size depends on the
vectors' length and the number of folds only.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Sums = tuple[float, np.ndarray, np.ndarray]


def _clean(*vectors: str) -> Column:
    """Vectors behind one another; a null or NaN component counts as 0."""
    return F.transform(F.concat(*[F.col(v).cast("array<double>") for v in vectors]), lambda x: F.when(x.isNull() | F.isnan(x), 0.0).otherwise(x))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.empty((0, 0))


def fold_sums(df: DataFrame, fold: str, vectors: list[str], covered: Column) -> tuple[dict[object, Sums], np.ndarray]:
    """By fold: the number of covered rows, the sum of their vectors less a shift, and the sum of those's products.

    The shift, the mean of at most 1,000 rows, is near enough to the mean that the products lose no digits to it.
    """
    rows = df.filter(covered & F.col(fold).isNotNull()).select(F.col(fold).alias("fold"), _clean(*vectors).alias("v"))
    some = [r.v for r in rows.limit(1000).collect()]
    if not some:
        return {}, np.zeros(0)
    shift = np.mean(some, 0)
    kind = dict(df.dtypes)[fold]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict = {}
        for batch in batches:
            x, folds = _matrix(batch.column(1)) - (shift if batch.num_rows else 0), np.array(batch.column(0).to_pylist(), object)
            for f in set(folds.tolist()):
                own = x[folds == f]
                n, s, g = sums.get(f, (0, 0.0, 0.0))
                sums[f] = (n + len(own), s + own.sum(0), g + own.T @ own)
        for f, (n, s, g) in sums.items():
            yield pa.RecordBatch.from_pylist([{"fold": f, "v": np.concatenate([[n], s, g.ravel()]).tolist()}], schema=pa.schema([("fold", batch.schema.field(0).type), ("v", pa.list_(pa.float64()))]))

    parts = rows.mapInArrow(add, f"fold {kind}, v array<double>").select("fold", F.posexplode("v").alias("i", "x"))
    cells: dict = {}
    for r in parts.groupBy("fold", "i").agg(F.sum("x").alias("x")).collect():  # folds x length squared
        cells.setdefault(r.fold, {})[r.i] = r.x
    d = len(shift)
    out = {}
    for f, own in cells.items():
        v = np.array([own[i] for i in range(1 + d + d * d)])
        out[f] = (v[0], v[1 : 1 + d], v[1 + d :].reshape(d, d))
    return out, shift


def without(sums: dict[object, Sums], fold: object) -> tuple[float, np.ndarray, np.ndarray]:
    """Rows, mean (less the shift) and centred products of all folds but one."""
    n, s, g = (sum(x[i] for f, x in sums.items() if f != fold) for i in range(3))
    if not n:
        raise ValueError(f"no covered row outside fold {fold}")
    return n, s / n, g - np.outer(s, s) / n


def _by_fold(df: DataFrame, fold: str, inputs: list[str], needed: Column, name: str, models: dict[object, Callable[[np.ndarray], np.ndarray]], run: object | None) -> DataFrame:
    """df with the array ``name``: the model of a row's own fold (or of fold ``run``) on its inputs, null unless needed."""
    if run is not None:
        models = {run: models[run]}
    key = F.lit(run) if run is not None else F.col(fold)

    @F.pandas_udf("array<double>")
    def applied(v: pd.Series, f: pd.Series) -> pd.Series:
        out = pd.Series([None] * len(v), index=v.index, dtype=object)
        for value, own in f.groupby(f).groups.items():
            rows = [i for i in own if v[i] is not None]
            if value in models and rows:
                out[rows] = pd.Series(list(models[value](np.stack([v[i] for i in rows]))), index=rows)
        return out

    return df.withColumn(name, applied(F.when(needed, _clean(*inputs)), key))


def fold_pca(df: DataFrame, fold: str, vector: str, covered: Column, components: int, name: str = "pca", run: object | None = None) -> DataFrame:
    """df with the array ``name``: the first principal components of the vectors, fitted on covered rows of other folds.

    A component's entry of largest size is positive (the first of equals). Rows that are not covered, or whose fold is
    null, have null; a null component of a covered row counts as 0. ``run``: all rows by the model that leaves out that
    fold, as for a training run.
    """
    sums, shift = fold_sums(df, fold, [vector], covered)
    models = {}
    for f in sums:
        _, mean, products = without(sums, f)
        _, axes = np.linalg.eigh(products)
        axes = axes[:, ::-1][:, :components]
        axes = axes * np.sign(axes[np.abs(np.round(axes, 12)).argmax(0), np.arange(axes.shape[1])])
        models[f] = lambda x, m=mean + shift, a=axes: (x - m) @ a
    return _by_fold(df, fold, [vector], covered, name, models, run)


def ridge(products: np.ndarray, mean: np.ndarray, d: int, alpha: float) -> tuple[np.ndarray, np.ndarray]:
    """Weights and intercepts of the entries from d on by the first d, from centred products; intercepts are free."""
    weights = np.linalg.solve(products[:d, :d] + alpha * np.eye(d), products[:d, d:])
    return weights, mean[d:] - mean[:d] @ weights


def fold_ridge(df: DataFrame, fold: str, known: str, wanted: str, covered: Column, alpha: float = 10.0, run: object | None = None) -> DataFrame:
    """df with ``wanted`` filled in where it is not covered, and the flag ``synthetic`` (1 there, else 0).

    The vector is predicted from ``known`` by ridge regression fitted on covered rows of other folds. Null components
    count as 0, in covered rows too. Rows without fold stay null. ``run`` as in ``fold_pca``.
    """
    sums, shift = fold_sums(df, fold, [known, wanted], covered)
    folds = sorted(sums) if run is None else [run]
    d = df.filter(covered).select(F.size(known)).first()
    models = {}
    for f in folds:
        _, mean, products = without(sums, f)
        weights, rest = ridge(products, mean + shift, d[0], alpha)
        models[f] = lambda x, w=weights, b=rest: x @ w + b
    out = _by_fold(df, fold, [known], ~covered, "filled_", models, run)
    return out.withColumn(wanted, F.when(covered, _clean(wanted)).otherwise(F.col("filled_"))).withColumn("synthetic", (~covered).cast("int")).drop("filled_")

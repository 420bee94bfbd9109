"""Decision costs chosen without the rows they are applied to.

A cost multiplies a class's probability before the largest is taken. For each held-out fold the costs that give the best
score on the other folds are found by coordinate ascent. A step tries all multipliers of one class for all folds in one
scan: with the other costs fixed, the class wins from some multiplier on, so a row is counted once for each held-out
fold by its true class, its best other class and how many multipliers let the class win. Those counts (folds x classes
x classes x multipliers at most) come to the driver, where each multiplier's score follows from them.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import argmax
from .conformal import shortfall

#: The multipliers 0.8, 1.0, ..., 3.0.
GRID = [round(0.8 + 0.2 * i, 2) for i in range(12)]

Confusion = dict[tuple[int, int], int]


def macro_f1(conf: Confusion, classes: list[int] | None = None) -> float:
    """Mean F1 over the classes (default: all) that the truth has; 0 if it has none of them."""
    support, called = defaultdict(int), defaultdict(int)
    for (t, p), n in conf.items():
        support[t] += n
        called[p] += n
    present = sorted(c for c in support if support[c] and (classes is None or c in classes))
    return sum(2 * conf.get((c, c), 0) / max(support[c] + called[c], 1) for c in present) / max(len(present), 1)


def _counted(df: DataFrame, probs: list[str], truth: str, fold: str | None, costs: dict, j: int, grid: list[float]) -> dict[object, dict[float, Confusion]]:
    """For each held-out fold and multiplier of class j the confusion counts of all other folds."""
    # the costs are a folded literal, not part of the generated code, which is then the same in every step of a class
    tried = F.array(*[F.struct(F.lit(f).alias("outer"), F.array(*map(F.lit, cost)).alias("w")) for f, cost in costs.items()])
    needed = [truth, *probs, *([fold] if fold else [])]
    rows = df.select(*needed).dropna().withColumn("c_", F.explode(tried))
    if fold:
        rows = rows.filter(F.col(fold) != F.col("c_.outer"))
    scaled = F.array(*[F.lit(-1.0) if i == j else F.col(p) * F.col("c_.w")[i] for i, p in enumerate(probs)])
    rows = rows.select(F.col(truth).alias("truth"), "c_.outer", F.col(probs[j]).alias("own"), scaled.alias("s"))
    rows = rows.select("truth", "outer", "own", F.array_max("s").alias("top"), argmax(F.col("s")).alias("other"))
    wins = sum(((F.col("own") * m > F.col("top")) | ((F.col("own") * m == F.col("top")) & (F.col("other") > j))).cast("int") for m in grid)
    out: dict = {f: {m: defaultdict(int) for m in grid} for f in costs}
    for r in rows.groupBy("truth", "outer", "other", wins.alias("wins")).agg(F.count("*").alias("n")).collect():
        for k, m in enumerate(grid):
            out[r.outer][m][int(r.truth), j if k >= len(grid) - r.wins else r.other] += r.n
    return out


def nested_costs(
    df: DataFrame, probs: list[str], truth: str, fold: str | None, targets: list[int] | dict | None = None, grid: list[float] | None = None, passes: int = 2,
    objective: Callable[[Confusion], float] = macro_f1,
) -> dict[object, list[float]]:
    """The costs of all classes by held-out fold; without ``fold`` one list under None, fitted on all rows.

    ``targets`` are the classes that may have a cost other than 1 (default: all; a dict has its own for each fold), tried
    in order, ``passes`` times. A multiplier is taken if the objective becomes larger (to nine places); the smallest of
    equals. Classes are numbered by ``probs``; rows with a null among the columns are left out.
    """
    grid = sorted(grid or GRID)
    folds = [None] if fold is None else sorted(r[0] for r in df.select(fold).distinct().dropna().collect())  # a row a fold
    costs = {f: [1.0] * len(probs) for f in folds}
    each = {f: (targets.get(f, []) if isinstance(targets, dict) else list(range(len(probs))) if targets is None else targets) for f in folds}
    for _ in range(passes):
        before = {f: list(c) for f, c in costs.items()}
        for turn in range(max(map(len, each.values()), default=0)):
            for j in sorted({each[f][turn] for f in folds if len(each[f]) > turn}):
                trying = {f: costs[f] for f in folds if len(each[f]) > turn and each[f][turn] == j}
                tried = sorted({*grid, *(c[j] for c in trying.values())})
                for f, by_cost in _counted(df, probs, truth, fold, trying, j, tried).items():
                    score = {m: round(objective(by_cost[m]), 9) for m in tried}
                    top = max(grid, key=lambda m: (score[m], -m))
                    if score[top] > score[costs[f][j]]:
                        costs[f][j] = top
        if costs == before:
            break
    return costs


def gated(df: DataFrame, probs: list[str], fold: str | None, costs: dict[object, list[float]], name: str = "label") -> DataFrame:
    """df with the class of the largest cost-weighted probability, each row by the costs of its own fold."""
    label: Callable[[list[float]], Column] = lambda c: argmax(F.array(*[F.col(p) * m for p, m in zip(probs, c, strict=True)]))
    if fold is None:
        return df.withColumn(name, label(costs[None]))
    return df.withColumn(name, F.coalesce(*[F.when(F.col(fold) == f, label(c)) for f, c in costs.items()]))


def focus_costs(df: DataFrame, probs: list[str], truth: str, fold: str, score: Column, alpha: float = 0.1, classes: int = 4, **options) -> tuple[dict[object, list[int]], dict[object, list[float]]]:
    """(targets, costs) by held-out fold: the classes whose calibrated coverage falls shortest get costs of their own.

    ``score`` is the nonconformity of a row's true class. Classes are ordered by their shortfall, the first of equals
    first, and the first ``classes`` of them are tuned in that order.
    """
    rows = shortfall(df, fold, truth, score, alpha).collect()  # folds x classes
    targets = {f: [r.cls for r in sorted((r for r in rows if r.outer == f), key=lambda r: (-round(r.shortfall, 9), r.cls))][:classes] for f in {r.outer for r in rows}}
    return targets, nested_costs(df, probs, truth, fold, targets, **options)

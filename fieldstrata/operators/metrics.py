"""Classification metrics, calibration, conformal thresholds and decision gates over posterior tables.

Everything starts from a confusion count or a grouped scan of the rows; thresholds and grids are exploded into rows, so a
sweep is one pass.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F



def everything():
    """The window of all rows (of a small table of counts)."""
    return Window.partitionBy()


def confusion(df: DataFrame, truth: str, pred: str, by: list[str] | None = None) -> DataFrame:
    return df.groupBy(*(by or []), F.col(truth).alias("truth"), F.col(pred).alias("pred")).agg(F.count("*").alias("n"))


def prf(tp: Column, fp: Column, fn: Column) -> tuple[Column, Column, Column]:
    """Precision, recall and F1, denominators at least 1."""
    p, r = tp / F.greatest(tp + fp, F.lit(1)), tp / F.greatest(tp + fn, F.lit(1))
    return p, r, 2 * tp / F.greatest(2 * tp + fp + fn, F.lit(1))


def per_class(conf: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Of each class present in the truth: support, precision, recall, F1 (from a confusion table)."""
    by = by or []
    t = conf.groupBy(*by, F.col("truth").alias("cls")).agg(F.sum("n").alias("support"), F.sum(F.when(F.col("truth") == F.col("pred"), F.col("n")).otherwise(0)).alias("tp"))
    p = conf.groupBy(*by, F.col("pred").alias("cls")).agg(F.sum("n").alias("called"))
    j = t.join(p, [*by, "cls"], "left").fillna(0, ["called"])
    precision, recall, f1 = prf(F.col("tp"), F.col("called") - F.col("tp"), F.col("support") - F.col("tp"))
    return j.select(*by, "cls", "support", precision.alias("precision"), recall.alias("recall"), f1.alias("f1"))


def overall(conf: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Accuracy, balanced accuracy (mean recall) and macro-F1."""
    by = by or []
    acc = conf.groupBy(*by).agg((F.sum(F.when(F.col("truth") == F.col("pred"), F.col("n")).otherwise(0)) / F.sum("n")).alias("accuracy"))
    mac = per_class(conf, by).groupBy(*by).agg(F.avg("recall").alias("balanced"), F.avg("f1").alias("macro_f1"))
    return acc.join(mac, by) if by else acc.crossJoin(F.broadcast(mac))  # one row each


def binary(df: DataFrame, truth: Column, pred: Column, by: list[str] | None = None) -> DataFrame:
    s = df.groupBy(*(by or [])).agg(F.count_if(truth & pred).alias("tp"), F.count_if(~truth & pred).alias("fp"), F.count_if(truth & ~pred).alias("fn"))
    p, r, f = prf(F.col("tp"), F.col("fp"), F.col("fn"))
    return s.select(*(by or []), p.alias("precision"), r.alias("recall"), f.alias("f1"))


def sweep(df: DataFrame, truth: Column, score: Column, grid: list[float], by: list[str] | None = None) -> DataFrame:
    """Precision, recall and F1 of score >= t for every t of the grid, in one scan.

    Rows are first counted by how many thresholds they pass, so the grid multiplies that small table, not the rows.
    """
    by = by or []
    passed = sum((F.when(score >= t, 1).otherwise(0) for t in sorted(grid)), F.lit(0))
    bins = df.groupBy(*by, passed.alias("k"), truth.alias("y")).agg(F.count("*").alias("n"))
    t = bins.withColumn("t", F.explode(F.array(*[F.struct(F.lit(i + 1).alias("i"), F.lit(float(x)).alias("t")) for i, x in enumerate(sorted(grid))])))
    on = F.col("k") >= F.col("t.i")
    n = F.col("n")
    s = t.groupBy(*by, F.col("t.t").alias("t")).agg(F.sum(F.when(F.col("y") & on, n).otherwise(0)).alias("tp"), F.sum(F.when(~F.col("y") & on, n).otherwise(0)).alias("fp"), F.sum(F.when(F.col("y") & ~on, n).otherwise(0)).alias("fn"))
    p, r, f = prf(F.col("tp"), F.col("fp"), F.col("fn"))
    return s.select(*by, "t", "tp", "fp", "fn", p.alias("precision"), r.alias("recall"), f.alias("f1"))


def best(df: DataFrame, value: str, order: str, by: list[str] | None = None) -> DataFrame:
    """The row with the largest value (to nine places); the first by order wins ties."""
    return df.groupBy(*(by or [])).agg(F.max_by(F.struct(*df.columns), F.struct(F.round(value, 9), -F.col(order))).alias("b_")).select("b_.*")


def probability_scores(df: DataFrame, probs: list[str], truth: str, by: list[str] | None = None) -> DataFrame:
    """Brier score, negative log likelihood, nominal CRPS (half of Brier), accuracy (first maximum wins)."""
    at = lambda i: F.when(F.col(truth) == i, 1.0).otherwise(0.0)
    brier = sum(((F.col(p) - at(i)) ** 2 for i, p in enumerate(probs)), F.lit(0.0))
    own = sum((F.col(p) * at(i) for i, p in enumerate(probs)), F.lit(0.0))
    arr = F.array(*probs)
    hit = (F.array_position(arr, F.array_max(arr)) - 1 == F.col(truth)).cast("double")
    return df.groupBy(*(by or [])).agg(F.avg(brier).alias("brier"), F.avg(-F.ln(F.greatest(own, F.lit(1e-12)))).alias("nll"), (F.avg(brier) / 2).alias("crps"), F.avg(hit).alias("accuracy"))


def calibration_error(df: DataFrame, p: Column, hit: Column, bins: int = 15) -> DataFrame:
    """Expected calibration error over right-closed bins; p = 0 falls in none but counts in the total."""
    b = df.select(p.alias("p"), hit.cast("double").alias("hit"), F.ceil(F.round(p * bins, 9)).alias("bin"))
    g = b.groupBy("bin").agg(F.count("*").alias("n"), F.avg("p").alias("conf"), F.avg("hit").alias("acc"))
    return g.agg((F.sum(F.when(F.col("bin") > 0, F.col("n") * F.abs(F.col("conf") - F.col("acc"))).otherwise(0.0)) / F.sum("n")).alias("ece"))


def auc(df: DataFrame, score: str, positive: str) -> DataFrame:
    """Rank statistic with mid-ranks, from counts by score."""
    from .windows import prefix_sums

    g = df.groupBy(score).agg(F.count("*").alias("n"), F.count_if(F.col(positive)).alias("pos"))
    r = prefix_sums(g, [], score, "n", "before").withColumn("mid", F.col("before") + (F.col("n") + 1) / 2.0)
    s = r.agg(F.sum(F.col("pos") * F.col("mid")).alias("R"), F.sum("pos").alias("P"), (F.sum("n") - F.sum("pos")).alias("N"))
    return s.select(((F.col("R") - F.col("P") * (F.col("P") + 1) / 2) / (F.col("P") * F.col("N"))).alias("auc"))


def error_by_stratum(df: DataFrame, by: str, error: Column, least: int) -> DataFrame:
    """Error rate of each stratum; strata of fewer rows get the overall rate."""
    g = df.groupBy(by).agg(F.count("*").alias("n"), F.sum(error.cast("double")).alias("e"))
    t = g.agg((F.sum("e") / F.sum("n")).alias("all_"))
    return g.crossJoin(F.broadcast(t)).select(by, "n", F.when(F.col("n") >= least, F.col("e") / F.col("n")).otherwise(F.col("all_")).alias("rate"))  # one row


def gini(df: DataFrame, block: str) -> DataFrame:
    """Concentration of row counts over blocks."""
    c = df.groupBy(block).agg(F.count("*").alias("c"))
    r = c.withColumn("i", F.row_number().over(Window.orderBy("c", block)))
    return r.agg((2 * F.sum(F.col("i") * F.col("c")) / (F.count("*") * F.sum("c")) - (F.count("*") + 1) / F.count("*")).alias("gini"))


def weighted_quantiles(counts: DataFrame, score: str, weight: str, alphas: list[float], by: list[str] | None = None) -> DataFrame:
    """(by, alpha, n, q): split-conformal thresholds of counted scores, for several levels at once.

    q is the ceil((n+1)(1-alpha))-th smallest of the n scores, infinite where there are too few. ``weight`` says how often a
    row's score occurs; scores are never expanded into rows, nor sorted in one task.
    """
    by = by or []
    from .windows import prefix_sums

    run = prefix_sums(counts.groupBy(*by, score).agg(F.sum(weight).alias("c_")), by, score, "c_", "b_")
    n = run.groupBy(*by).agg(F.sum("c_").alias("n"))
    level = F.explode(F.array(*[F.struct(F.lit(float(a)).alias("a"), F.ceil(F.round((F.col("n") + 1) * (1 - a), 9)).alias("k")) for a in alphas]))
    j = (run.join(n, by) if by else run.crossJoin(F.broadcast(n))).withColumn("l_", level)  # one row
    hit = F.when((F.col("b_") < F.col("l_.k")) & (F.col("b_") + F.col("c_") >= F.col("l_.k")), F.col(score))
    return j.groupBy(*by, F.col("l_.a").alias("alpha")).agg(F.first("n").alias("n"), F.coalesce(F.max(hit), F.lit(float("inf"))).alias("q"))


def split_quantile(df: DataFrame, score: str, alpha: float, by: list[str] | None = None) -> DataFrame:
    """(by, n, q): the split-conformal threshold of the rows' scores (``weighted_quantiles``)."""
    by = by or []
    return weighted_quantiles(df.groupBy(*by, score).agg(F.count("*").alias("w_")), score, "w_", [alpha], by).drop("alpha")


def aps_score(probs: list[str], cls: int, u: Column) -> Column:
    """Adaptive score of a class: mass of likelier classes, and u times its own (ties: earlier classes first)."""
    own = F.col(probs[cls])
    more = sum((F.when((F.col(p) > own) | ((F.col(p) == own) & F.lit(i < cls)), F.col(p)).otherwise(0.0) for i, p in enumerate(probs) if i != cls), F.lit(0.0))
    return more + u * own


def set_metrics(df: DataFrame, size: str, covered: str, by: list[str] | None = None) -> DataFrame:
    return df.groupBy(*(by or [])).agg(F.count("*").alias("n"), F.avg(F.col(covered).cast("double")).alias("coverage"), F.avg(size).alias("mean_size"), F.avg((F.col(size) == 1).cast("double")).alias("singletons"), F.avg((F.col(size) == 0).cast("double")).alias("empty"), F.percentile(size, F.lit(0.9)).alias("p90_size"))


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(X <= k) of a binomial number with k <= n p. Terms fall from k downwards; they are added until the rest, at most
    a geometric series, is below double precision, which takes some multiple of the root of n."""
    import math

    import numpy as np

    if p >= 1:
        return 0.0
    top = math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(p) + (n - k) * math.log1p(-p)
    odds, total, term, i = (1 - p) / p, 1.0, 1.0, k
    while i > 0:
        at = np.arange(i, max(i - 4096, 0), -1, dtype=np.float64)
        ratios = at / (n - at + 1) * odds
        terms = term * np.cumprod(ratios)
        total, term, i = total + float(terms.sum()), float(terms[-1]), i - len(at)
        r = float(ratios[-1])
        if r < 1 and term * r / (1 - r) < 1e-17 * total:
            break
    return math.exp(top) * total


def binomial_upper(k: int, n: int, delta: float) -> float:
    """Clopper-Pearson upper bound by bisection on the binomial distribution; 1 for k >= n or n = 0."""
    if n == 0 or k >= n:
        return 1.0
    low, high = k / n, 1.0
    for _ in range(60):
        p = (low + high) / 2
        low, high = (p, high) if binomial_tail(k, n, p) > delta else (low, p)
    return (low + high) / 2


def temperature_fit(df: DataFrame, logits: list[str], truth: str, low: float = 0.1, high: float = 10.0, points: int = 9, rounds: int = 5) -> float:
    """The temperature with the least negative log likelihood: each round scores a grid in one scan and narrows it."""
    for _ in range(rounds):
        grid = [low * (high / low) ** (i / (points - 1)) for i in range(points)]
        aggs = []
        for i, t in enumerate(grid):
            top = F.greatest(*[F.col(z) / t for z in logits])
            lse = top + F.ln(sum((F.exp(F.col(z) / t - top) for z in logits), F.lit(0.0)))
            own = sum((F.when(F.col(truth) == j, F.col(z) / t).otherwise(0.0) for j, z in enumerate(logits)), F.lit(0.0))
            aggs.append(F.avg(lse - own).alias(f"g{i}"))
        row = df.agg(*aggs).first()
        at = min(range(points), key=lambda i: row[i])
        low, high = grid[max(0, at - 1)], grid[min(points - 1, at + 1)]
    return (low * high) ** 0.5


def cluster_weights(df: DataFrame, cluster: str, noise: int = -1, noise_weight: float = 1.0) -> DataFrame:
    """1 / (number of clusters * cluster size), noise rows as clusters of one, summing to 1."""
    n = df.groupBy(cluster).agg(F.count("*").alias("c_"))
    k = n.agg(F.sum(F.when(F.col(cluster) == noise, F.col("c_")).otherwise(1)).alias("K_"))
    raw = F.when(F.col(cluster) == noise, noise_weight / F.col("K_")).otherwise(1 / (F.col("K_") * F.col("c_")))
    w = n.crossJoin(F.broadcast(k)).withColumn("w_", raw)  # one row
    total = w.agg(F.sum(F.col("w_") * F.col("c_")).alias("t_"))
    return df.join(w.crossJoin(F.broadcast(total)).select(cluster, (F.col("w_") / F.col("t_")).alias("weight")), cluster)  # one row


def vendi(df: DataFrame, vector: str, by: list[str] | None = None) -> DataFrame:
    """exp of the entropy of the normalised Gram matrix's eigenvalues; the Gram matrix is summed per task, then solved."""
    import numpy as np
    import pandas as pd

    by = by or []
    kinds = dict(df.dtypes)
    head = "".join(f"{b} {kinds[b]}, " for b in by)

    def grams(batches):
        for b in batches:
            for k, g in b.groupby(by, dropna=False) if by else [((), b)]:
                x = np.array(g[vector].tolist(), np.float64)
                x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
                yield pd.DataFrame({**{c: [v] for c, v in zip(by, k if isinstance(k, tuple) else (k,), strict=True)}, "n": [len(x)], "gram": [(x.T @ x).ravel()]})

    parts = df.select(*by, vector).mapInPandas(grams, head + "n long, gram array<double>")
    cells = parts.select(*by, "n", F.posexplode("gram").alias("i", "g")).groupBy(*by, "i").agg(F.sum("n").alias("n"), F.sum("g").alias("g"))

    def solve(g: pd.DataFrame) -> pd.DataFrame:
        d = int(round(len(g) ** 0.5))
        m = g.sort_values("i")["g"].to_numpy().reshape(d, d) / g["n"].iloc[0]
        e = np.clip(np.linalg.eigvalsh(m), 0, None)
        e = e[e > 1e-12]
        return pd.DataFrame({**{c: [g[c].iloc[0]] for c in by}, "n": [int(g["n"].iloc[0])], "vendi": [float(np.exp(-(e * np.log(e)).sum()))]})

    keyed = cells if by else cells.withColumn("k_", F.lit(0))
    return keyed.groupBy(*(by or ["k_"])).applyInPandas(solve, head + "n long, vendi double")  # a matrix of one dimension squared a group


def binomial_upper_column(k: str, n: str, delta: float) -> Column:
    """``binomial_upper`` of two columns, for tables of one row a group."""

    @F.pandas_udf("double")
    def upper(ks: pd.Series, ns: pd.Series) -> pd.Series:
        return pd.Series([binomial_upper(int(a), int(b), delta) for a, b in zip(ks, ns, strict=True)], dtype="float64")

    return upper(k, n)


def stable_modes(conf: DataFrame, stable: int, other: int) -> DataFrame:
    """Macro F1 over the classes in the truth, and where rows of two stable classes go: kept, to the other, to a change."""
    n = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    is_, was, pred = F.col("truth") == stable, F.col("truth") == other, F.col("pred")
    modes = conf.agg(
        F.try_divide(n(is_ & (pred == stable)), n(is_)).alias("stable_recall"), F.try_divide(n(is_ & (pred == other)), n(is_)).alias("stable_as_other"),
        F.try_divide(n(is_ & ~pred.isin(stable, other)), n(is_)).alias("stable_as_change"), F.try_divide(n(was & (pred == stable)), n(was)).alias("other_as_stable"),
    )
    return per_class(conf).filter("support > 0").agg(F.avg("f1").alias("macro_f1")).crossJoin(F.broadcast(modes))  # one row each


def shares_by_axis(df: DataFrame, axes: dict[str, Column]) -> DataFrame:
    """(axis, value, n, share): rows by each axis's values, and their share of the axis; null values count to no axis."""
    cells = F.array(*[F.struct(F.lit(a).alias("axis"), c.alias("value")) for a, c in axes.items()])
    g = df.select(F.explode(cells).alias("e")).select("e.*").filter("value is not null").groupBy("axis", "value").agg(F.count("*").alias("n"))
    return g.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("axis")))  # a row a value


def conformal_sets(calibration: DataFrame, rows: DataFrame, scores: str, truth: str, classes: int, alpha: float) -> DataFrame:
    """rows with size and covered of their conformal sets, by one threshold a class from the calibration rows.

    ``scores`` is an array with a score for each class. A class with too few calibration rows has an infinite threshold
    and is in every set; ``infinite`` counts such classes.
    """
    own = calibration.select(F.col(truth).alias("k_"), F.get(scores, F.col(truth)).alias("s_"))
    q = split_quantile(own, "s_", alpha, ["k_"])
    inf = F.lit(float("inf"))
    wide = q.agg(F.array(*[F.coalesce(F.max(F.when(F.col("k_") == k, F.col("q"))), inf) for k in range(classes)]).alias("q_"))
    inside = lambda k: F.get(scores, k) <= F.get("q_", k)
    size = sum((inside(F.lit(k)).cast("int") for k in range(1, classes)), inside(F.lit(0)).cast("int"))
    out = rows.crossJoin(F.broadcast(wide))  # one row
    return out.withColumns({"size": size, "covered": inside(F.col(truth)), "infinite": F.size(F.filter("q_", lambda x: x == inf))}).drop("q_")


def confident_class(df: DataFrame, probs: list[str], truth: str) -> DataFrame:
    """df with ``confident``: the likeliest class among those at or above their mean probability on their own rows, or null.

    Pruning drops rows whose confident class differs from the given one; relabelling takes it where there is one.
    """
    from ..functions.scalar import argmax

    own = F.get(F.array(*probs), F.col(truth))
    thr = df.agg(*[F.avg(F.when(F.col(truth) == i, own)).alias(f"t{i}_") for i in range(len(probs))])
    sure = F.array(*[F.when(F.col(p) >= F.col(f"t{i}_"), F.col(p)).otherwise(-1.0) for i, p in enumerate(probs)])
    out = df.crossJoin(F.broadcast(thr)).withColumn("confident", F.when(F.array_max(sure) >= 0, argmax(sure)))  # one row
    return out.drop(*[f"t{i}_" for i in range(len(probs))])

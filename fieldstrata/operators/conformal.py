"""Conformal thresholds from counts by score: nested choices over folds, shortfalls of coverage, and e-values.

Calibration rows are counted by fold, class and score once. Leaving folds out, and grids of levels, multiply that table;
the rows themselves are read again only to be labelled.
"""

from __future__ import annotations

import math
from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .metrics import best, per_class, weighted_quantiles
from .windows import prefix_sums


def score_counts(df: DataFrame, fold: str, truth: str, score: Column) -> DataFrame:
    """(fold, cls, s, n): rows by fold, class and score; rows without one of them are left out."""
    return df.select(F.col(fold).alias("fold"), F.col(truth).alias("cls"), score.alias("s")).dropna().groupBy("fold", "cls", "s").agg(F.count("*").alias("n"))


def _folds(counts: DataFrame) -> list:
    return sorted(r.fold for r in counts.select("fold").distinct().collect())  # a row a fold


def without_pairs(counts: DataFrame, folds: list) -> DataFrame:
    """counts once for every pair of other folds (lo < hi): what is left to calibrate on when both are left out."""
    pairs = F.array(*[F.struct(F.lit(a).alias("lo"), F.lit(b).alias("hi")) for i, a in enumerate(folds) for b in folds[i + 1 :]])
    return counts.withColumn("p_", F.explode(pairs)).select("p_.lo", "p_.hi", "fold", "cls", "s", "n").filter("fold <> lo and fold <> hi")


def directed(thresholds: DataFrame) -> DataFrame:
    """Thresholds of pairs as (outer, inner) in both orders: calibrated without either, outer the fold that is held out."""
    both = F.array(F.struct(F.col("lo").alias("outer"), F.col("hi").alias("inner")), F.struct(F.col("hi").alias("outer"), F.col("lo").alias("inner")))
    return thresholds.withColumn("d_", F.explode(both)).select("d_.outer", "d_.inner", *[c for c in thresholds.columns if c not in ("lo", "hi")])


def shortfall(df: DataFrame, fold: str, truth: str, score: Column, alpha: float) -> DataFrame:
    """(outer, cls, shortfall): how far each class's coverage is below 1 - alpha, measured out of sample.

    For a held-out fold, each other fold is covered by the class threshold (at most 1) of the remaining ones; the
    coverages are averaged over those folds that have rows of the class and a threshold.
    """
    counts = score_counts(df, fold, truth, score)
    q = directed(weighted_quantiles(without_pairs(counts, _folds(counts)), "s", "n", [alpha], ["lo", "hi", "cls"]).drop("n"))
    met = counts.join(q, [counts["fold"] == q["inner"], counts["cls"] == q["cls"]]).select("outer", "inner", counts["cls"].alias("cls"), "n", (F.col("s") <= F.least("q", F.lit(1.0))).alias("in_"))
    covered = met.groupBy("outer", "inner", "cls").agg((F.sum(F.when(F.col("in_"), F.col("n")).otherwise(0)) / F.sum("n")).alias("c"))
    return covered.groupBy("outer", "cls").agg((F.lit(1 - alpha) - F.avg("c")).alias("shortfall"))


def deepest(scores: Column, thresholds: Column, classes: int, mode: str = "margin") -> Column:
    """The class furthest inside its threshold (position from 0, the first of equals); thresholds count as at most 1.

    ``margin``: least score minus threshold. ``ratio``: largest (1 - score) / (1 - threshold), the latter at least 0.001.
    """
    each = [(F.get(scores, F.lit(k)), F.least(F.get(thresholds, F.lit(k)), F.lit(1.0))) for k in range(classes)]
    if mode == "margin":
        gap = F.array(*[q - s for s, q in each])
    elif mode == "ratio":
        gap = F.array(*[(1 - s) / F.greatest(1 - q, F.lit(1e-3)) for s, q in each])
    else:
        raise ValueError(f"unknown read: {mode}")
    return F.array_position(gap, F.array_max(gap)).cast("int") - 1


def _wide(q: DataFrame, by: list[str], classes: int) -> DataFrame:
    """Thresholds of all classes as one array; a class without calibration rows has an infinite one."""
    return q.groupBy(*by).agg(F.array(*[F.coalesce(F.max(F.when(F.col("cls") == k, F.col("q"))), F.lit(float("inf"))) for k in range(classes)]).alias("q"))


def nested_alpha(df: DataFrame, fold: str, truth: str, scores: str, classes: int, alphas: list[float], mode: str = "margin") -> tuple[DataFrame, DataFrame]:
    """Labels by thresholds whose level is chosen without the fold they are for.

    ``scores`` is an array of one score a class. For each held-out fold and level, every other fold is labelled by the
    thresholds of the remaining ones, and the level with the best macro F1 over all of these (the first of equals) is
    calibrated on all of them and applied. Returns (df with ``alpha`` and ``label``, chosen levels by fold:
    outer, alpha, macro_f1).
    """
    own = F.get(F.col(scores), F.col(truth))
    counts = score_counts(df, fold, truth, own)
    folds = _folds(counts)
    q = _wide(directed(weighted_quantiles(without_pairs(counts, folds), "s", "n", alphas, ["lo", "hi", "cls"])), ["outer", "inner", "alpha"], classes)
    choices = q.groupBy("inner").agg(F.collect_list(F.struct("outer", "alpha", "q")).alias("choices"))  # folds x levels
    rows = df.select(F.col(fold).alias("inner"), F.col(truth).alias("truth"), F.col(scores).alias("s_")).dropna()
    called = rows.join(F.broadcast(choices), "inner").select("truth", "s_", F.explode("choices").alias("x"))  # a row a fold
    pred = deepest(F.col("s_"), F.col("x.q"), classes, mode)
    conf = called.groupBy("x.outer", "x.alpha", "truth", pred.alias("pred")).agg(F.count("*").alias("n"))
    levels = per_class(conf, ["outer", "alpha"]).groupBy("outer", "alpha").agg(F.avg("f1").alias("macro_f1"))
    chosen = best(levels, "macro_f1", "alpha", ["outer"])
    held = counts.withColumn("outer", F.explode(F.array(*[F.lit(f) for f in folds]))).filter("fold <> outer")
    final = _wide(weighted_quantiles(held, "s", "n", alphas, ["outer", "cls"]).join(chosen.select("outer", "alpha"), ["outer", "alpha"]), ["outer", "alpha"], classes)
    final = final.select(F.col("outer").alias(fold), "alpha", F.col("q").alias("q_"))
    labelled = df.join(F.broadcast(final), fold).withColumn("label", deepest(F.col(scores), F.col("q_"), classes, mode)).drop("q_")  # a row a fold
    return labelled, chosen


@cache
def p_to_e(m: int, alpha: float, place: float = 0.5) -> tuple[float, float] | None:
    """(C, s) of the calibrator from p-values on the grid 1/(m+1), ..., 1 to e-values, or None where there is none.

    The calibrator is F(p) = (1 + exp(C(alpha - s))) / (alpha (1 + exp(C(p - s)))); C makes its mean over the grid 1. s
    lies at ``place`` between alpha and the next grid point, so there is none if alpha(m+1) is whole. The mean falls
    in C; C is found by bisection of its logarithm.
    """
    top = math.ceil(alpha * (m + 1)) / (m + 1) if m >= 1 else 0.0
    if not top > alpha:
        return None
    s = alpha + place * (top - alpha)

    def excess(c: float) -> float:
        return grid_sum(m, c, alpha, s) / (m + 1) - 1

    low, high = -8.0, 3.0
    while excess(10**high) > 0 and high < 12:
        high += 1
    if excess(10**low) < 0 or excess(10**high) > 0:
        return None
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if excess(10**mid) > 0 else (low, mid)
    return 10 ** ((low + high) / 2), s


def _soft(x: float) -> float:
    return max(x, 0.0) + math.log1p(math.exp(-abs(x)))


def log_e(p: float, c: float, alpha: float, s: float) -> float:
    return -math.log(alpha) + _soft(c * (alpha - s)) - _soft(c * (p - s))


def grid_sum(m: int, c: float, alpha: float, s: float, direct: int = 200_000) -> float:
    """The calibrator's values summed over the grid 1/(m+1), ..., 1, at a cost that does not grow with m.

    With the step h = c / (m+1) the sum is that of 1 / (1 + exp(x)) at x = h - c s, 2 h - c s, ..., c - c s. Terms beyond
    45 on either side are 1 or 0 to double precision, so up to ``direct`` terms are added one by one; where more lie
    between, h is so small that the trapezoidal rule with two correction terms is exact to double precision as well.
    """
    h, most = c / (m + 1), _soft(c * (alpha - s)) - math.log(alpha)
    first, last = max(1, math.ceil((c * s - 45) / h)), min(m + 1, math.floor((c * s + 45) / h))
    saturated = min(first - 1, m + 1)
    if last - first < direct:
        return math.exp(most) * saturated + math.fsum(math.exp(most - _soft(h * k - c * s)) for k in range(first, last + 1))
    a, b = h * first - c * s, h * last - c * s
    at = lambda x: math.exp(-_soft(x))
    slope = lambda x: -at(x) * (1 - at(x))
    third = lambda x: slope(x) * (1 - 6 * at(x) * (1 - at(x)))
    # over a short way the closed form would lose digits, and Simpson's rule is exact
    area = (_soft(-a) - _soft(-b)) / h if b - a > 1e-3 else (last - first) * (at(a) + 4 * at((a + b) / 2) + at(b)) / 6
    between = area + (at(a) + at(b)) / 2 + h / 12 * (slope(b) - slope(a)) - h**3 / 720 * (third(b) - third(a))
    return math.exp(most) * (saturated + between)


def e_values(calibration: DataFrame, test: DataFrame, alpha: float, by_class: bool = True, place: float = 0.5) -> DataFrame:
    """test rows (any columns with fold, cls, s: one row per fold model and class) with p and e.

    ``calibration`` has a row per calibration row: fold, cls (its class), s (its score under the fold's model). p counts
    the calibration scores of the fold (and class) that are at least the row's own, plus one. e is the calibrator's value
    of p; where a fold (and class) has no calibrator it is 1, no evidence against the class. p comes from one running
    count over the scores of both tables, and calibrators from the groups' sizes, of which there are folds times classes.
    """
    keys = ["fold", "cls"] if by_class else ["fold"]
    cal, asked = calibration.groupBy(*keys, "s").agg(F.count("*").alias("n_")), test.select(*keys, "s").distinct().withColumn("n_", F.lit(0).cast("long"))
    at = prefix_sums(cal.unionByName(asked).groupBy(*keys, "s").agg(F.sum("n_").alias("n_")), keys, "s", "n_", "below_").select(*keys, "s", "below_")
    sizes = cal.groupBy(*keys).agg(F.sum("n_").alias("m_"))
    found = {m: p_to_e(m, alpha, place) for m in {r.m_ for r in sizes.select("m_").distinct().collect()}}  # at most a size a fold and class
    found = {m: x for m, x in found.items() if x}
    m = F.coalesce("m_", F.lit(0))
    of = lambda i: F.coalesce(*[F.when(m == k, F.lit(x[i])) for k, x in found.items()], F.lit(None).cast("double"))
    values = at.join(F.broadcast(sizes), keys, "left").withColumn("p", (1 + m - F.col("below_")) / (m + 1)).withColumn("c_", of(0)).withColumn("t_", of(1))  # a row a group
    soft = lambda x: F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))
    e = F.exp(-math.log(alpha) + soft(F.col("c_") * (alpha - F.col("t_"))) - soft(F.col("c_") * (F.col("p") - F.col("t_"))))
    return test.join(values.select(*keys, "s", "p", F.when(F.col("c_").isNull(), 1.0).otherwise(e).alias("e")), [*keys, "s"])


def _running(values: DataFrame, row: str) -> tuple[DataFrame, Column, Column]:
    """values gathered once by row and class, and the mean and the largest running mean (folds in order) of their e."""
    ordered = values.groupBy(row, "cls").agg(F.sort_array(F.collect_list(F.struct("fold", "e"))).alias("v"))  # a value a fold
    zero = F.struct(F.lit(0.0).alias("sum"), F.lit(0).alias("n"), F.lit(0.0).alias("top"))
    step = lambda a, x: F.struct((a["sum"] + x["e"]).alias("sum"), (a["n"] + 1).alias("n"), F.greatest(a["top"], (a["sum"] + x["e"]) / (a["n"] + 1)).alias("top"))
    return ordered.withColumn("run_", F.aggregate("v", zero, step)), F.col("run_.sum") / F.col("run_.n"), F.col("run_.top")


def e_value_sets(values: DataFrame, row: str, alpha: float, variant: str, u: Column | None = None) -> DataFrame:
    """(row, cls, e, inside): whether each class is in a row's set, by the e-values of all folds.

    ``rand``: the mean e-value is below u / alpha, with one u on [0, 1) a row (given over the row's column). ``max``: the
    largest running mean, folds in order, is below 1 / alpha.
    """
    if variant == "rand":
        e = values.groupBy(row, "cls").agg(F.avg("e").alias("e"))
        return e.withColumn("inside", F.col("e") < u / alpha)
    if variant != "max":
        raise ValueError(f"unknown variant: {variant}")
    ordered, _, top = _running(values, row)
    return ordered.select(row, "cls", top.alias("e")).withColumn("inside", F.col("e") < 1 / alpha)


def e_value_both(values: DataFrame, row: str, alpha: float, u: Column) -> DataFrame:
    """(variant, row, cls, e, inside) of both variants of ``e_value_sets``, from one grouping of the values."""
    ordered, mean, top = _running(values, row)
    each = ordered.select(row, "cls", mean.alias("mean_"), top.alias("top_"))
    one = lambda variant, e, below: F.struct(F.lit(variant).alias("variant"), F.col(e).alias("e"), (F.col(e) < below).alias("inside"))
    return each.withColumn("x_", F.explode(F.array(one("rand", "mean_", u / alpha), one("max", "top_", F.lit(1 / alpha))))).select("x_.variant", row, "cls", "x_.e", "x_.inside")

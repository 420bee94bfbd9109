"""Decision costs, conformal levels and e-values against plain loops over a small table."""

import math
import random

import pytest
from pyspark.sql import functions as F

from fieldstrata.operators import conformal, gates
from fieldstrata.operators import metrics as M

PROBS = ["p0", "p1", "p2"]


def table(n=400, folds=4, seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        truth = rng.choices([0, 1, 2], [6, 3, 1])[0]
        w = [rng.random() + (0.5 if k == truth else 0) + (0.4 if k == 0 else 0) for k in range(3)]
        rows.append((i, i % folds, truth, *[round(x / sum(w), 2) for x in w]))
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, "id int, fold int, truth int, p0 double, p1 double, p2 double").repartition(3)


def macro(pairs, classes=(0, 1, 2)):
    f = []
    for c in classes:
        support, called, tp = sum(t == c for t, _ in pairs), sum(p == c for _, p in pairs), sum(t == p == c for t, p in pairs)
        if support:
            f.append(2 * tp / max(support + called, 1))
    return sum(f) / max(len(f), 1)


def largest(values):
    return max(range(len(values)), key=lambda k: (values[k], -k))


def brute_costs(rows, targets, passes, objective):
    def score(own, costs):
        return round(objective([(r[2], largest([p * c for p, c in zip(r[3:], costs, strict=True)])) for r in own]), 9)

    out = {}
    for fold in sorted({r[1] for r in rows}):
        own = [r for r in rows if r[1] != fold]
        costs = [1.0, 1.0, 1.0]
        best = score(own, costs)
        for _ in range(passes):
            for j in targets:
                for m in gates.GRID:
                    trial = costs[:j] + [m] + costs[j + 1 :]
                    if score(own, trial) > best:
                        best, costs = score(own, trial), trial
        out[fold] = costs
    return out


@pytest.mark.parametrize("targets", [[0, 1, 2], [2], [2, 1]])
def test_costs(spark, targets):
    rows = table()
    nulls = [(1000, 1, None, 0.2, 0.3, 0.5), (1001, None, 1, 0.2, 0.3, 0.5), (1002, 2, 1, None, 0.3, 0.5)]
    assert gates.nested_costs(frame(spark, rows + nulls), PROBS, "truth", "fold", targets) == brute_costs(rows, targets, 2, macro)


def test_costs_by_focus(spark):
    """Another objective; the held-out fold's own rows change nothing."""
    rows = table(seed=2)
    focus = lambda conf: gates.macro_f1(conf, [1, 2])
    costs = gates.nested_costs(frame(spark, rows), PROBS, "truth", "fold", [1, 2], objective=focus)
    assert costs == brute_costs(rows, [1, 2], 2, lambda pairs: macro(pairs, (1, 2)))
    other = [r if r[1] != 3 else (r[0], 3, (r[2] + 1) % 3, *r[3:]) for r in rows]
    assert gates.nested_costs(frame(spark, other), PROBS, "truth", "fold", [1, 2], objective=focus)[3] == costs[3]


def test_gated(spark):
    rows = table(40)
    costs = {0: [1.0, 2.0, 1.0], 1: [1.0, 1.0, 3.0], 2: [0.8, 1.0, 1.0], 3: [1.0, 1.0, 1.0]}
    got = {r.id: r.label for r in gates.gated(frame(spark, rows), PROBS, "fold", costs).collect()}
    assert got == {r[0]: largest([p * c for p, c in zip(r[3:], costs[r[1]], strict=True)]) for r in rows}


def quantile(scores, alpha):
    k = math.ceil(round((len(scores) + 1) * (1 - alpha), 9))
    return sorted(scores)[k - 1] if k <= len(scores) else math.inf


def test_weighted_quantiles(spark):
    rng = random.Random(3)
    rows = [(rng.choice("ab"), rng.randint(0, 9) / 10, rng.randint(1, 4)) for _ in range(60)] + [("c", 0.5, 1)]
    got = {(r.g, r.alpha): (r.n, r.q) for r in M.weighted_quantiles(spark.createDataFrame(rows, "g string, s double, n int"), "s", "n", [0.05, 0.3], ["g"]).collect()}
    for g in "abc":
        every = [s for h, s, n in rows if h == g for _ in range(n)]
        for alpha in (0.05, 0.3):
            assert got[g, alpha] == (len(every), quantile(every, alpha))


@pytest.mark.parametrize("mode", ["margin", "ratio"])
def test_nested_alpha(spark, mode):
    rows = table(300)
    alphas = [0.02, 0.1, 0.3, 0.5]
    df = frame(spark, rows).withColumn("scores", F.array(*[F.round(1 - F.col(p), 6) for p in PROBS]))
    labelled, chosen = conformal.nested_alpha(df, "fold", "truth", "scores", 3, alphas, mode)
    s = lambda r: [round(1 - p, 6) for p in r[3:]]

    def labels(cal, out, alpha):
        q = [min(quantile([s(r)[k] for r in cal if r[2] == k], alpha), 1.0) for k in range(3)]
        gap = (lambda x, t: t - x) if mode == "margin" else (lambda x, t: (1 - x) / max(1 - t, 1e-3))
        return [(r[0], r[2], largest([gap(x, t) for x, t in zip(s(r), q, strict=True)])) for r in out]

    want, levels = {}, {}
    for fold in range(4):
        cal = [r for r in rows if r[1] != fold]
        best = None
        for alpha in alphas:
            inner = [x for k in range(4) if k != fold for x in labels([r for r in cal if r[1] != k], [r for r in cal if r[1] == k], alpha)]
            got = round(macro([(t, p) for _, t, p in inner]), 9)
            if best is None or got > best[0]:
                best = (got, alpha)
        levels[fold] = best[1]
        want |= {i: p for i, _, p in labels(cal, [r for r in rows if r[1] == fold], best[1])}
    assert {r.outer: r.alpha for r in chosen.collect()} == levels
    assert {r.id: r.label for r in labelled.collect()} == want


def test_shortfall(spark):
    rows = table(300)
    got = {(r.outer, r.cls): r.shortfall for r in conformal.shortfall(frame(spark, rows), "fold", "truth", F.round(1 - F.get(F.array(*PROBS), F.col("truth")), 6), 0.1).collect()}
    own = lambda r: round(1 - r[3 + r[2]], 6)
    for fold in range(4):
        for k in range(3):
            shares = []
            for inner in range(4):
                if inner != fold:
                    q = min(quantile([own(r) for r in rows if r[1] not in (fold, inner) and r[2] == k], 0.1), 1.0)
                    out = [own(r) <= q for r in rows if r[1] == inner and r[2] == k]
                    shares.append(sum(out) / len(out))
            assert got[fold, k] == pytest.approx(0.9 - sum(shares) / len(shares))


def test_calibrator():
    """Mean one on the grid of p-values, 1 / alpha at alpha; none where alpha (m + 1) is whole or m is 0."""
    for m, alpha in ((12, 0.1), (45, 0.1), (7, 0.3), (333, 0.05)):
        c, s = conformal.p_to_e(m, alpha)
        mean = sum(math.exp(conformal.log_e(k / (m + 1), c, alpha, s)) for k in range(1, m + 2)) / (m + 1)
        assert mean == pytest.approx(1, abs=1e-6) and alpha < s < math.ceil(alpha * (m + 1)) / (m + 1)
        assert math.exp(conformal.log_e(alpha, c, alpha, s)) == pytest.approx(1 / alpha)
    assert conformal.p_to_e(9, 0.1) is None and conformal.p_to_e(0, 0.1) is None


@pytest.mark.parametrize("by_class", [True, False])
def test_e_values(spark, by_class):
    """p, e and both kinds of sets by a plain loop; a class without calibration rows has e = 1 and is in every set."""
    rng = random.Random(5)
    alpha = 0.15
    cal = [(k, rng.choice([0, 1]), round(rng.random(), 2)) for k in range(3) for _ in range(25)]
    test = [(i, k, c, round(rng.random(), 2)) for i in range(40) for k in range(3) for c in range(3)]
    values = conformal.e_values(spark.createDataFrame(cal, "fold int, cls int, s double"), spark.createDataFrame(test, "row int, fold int, cls int, s double"), alpha, by_class)
    want = {}
    for i, k, c, s in test:
        own = [x for f, y, x in cal if f == k and (y == c or not by_class)]
        p = (1 + sum(x >= s for x in own)) / (len(own) + 1)
        found = conformal.p_to_e(len(own), alpha)
        want[i, k, c] = (p, math.exp(conformal.log_e(p, found[0], alpha, found[1])) if found else 1.0)
    got = {(r.row, r.fold, r.cls): (r.p, r.e) for r in values.collect()}
    assert got.keys() == want.keys() and all(got[x] == pytest.approx(want[x]) for x in want)
    u = F.col("row") / 40.0
    rand = {(r.row, r.cls): r.inside for r in conformal.e_value_sets(values, "row", alpha, "rand", u).collect()}
    top = {(r.row, r.cls): r.inside for r in conformal.e_value_sets(values, "row", alpha, "max").collect()}
    for i in range(40):
        for c in range(3):
            e = [want[i, k, c][1] for k in range(3)]
            assert rand[i, c] == (sum(e) / 3 < i / 40 / alpha)
            assert top[i, c] == (max(sum(e[: t + 1]) / (t + 1) for t in range(3)) < 1 / alpha)
            if by_class and c == 2:
                assert e == [1.0] * 3 and top[i, c]


def test_e_value_coverage(spark):
    """Sets of exchangeable rows hold the true class at least 1 - alpha of the time (within sampling error)."""
    rng = random.Random(9)
    alpha, n = 0.2, 2000
    cal = [(k, rng.randrange(2), round(rng.random(), 4)) for k in range(4) for _ in range(203)]
    test = [(i, k, i % 2, s) for i in range(n) for k, s in enumerate([round(rng.random(), 4)] * 4)]
    values = conformal.e_values(spark.createDataFrame(cal, "fold int, cls int, s double"), spark.createDataFrame(test, "row int, fold int, cls int, s double"), alpha)
    for variant, u in (("rand", F.rand(4)), ("max", None)):
        inside = conformal.e_value_sets(values, "row", alpha, variant, u).agg(F.avg(F.col("inside").cast("double"))).first()[0]
        assert inside >= 1 - alpha - 3 * math.sqrt(alpha * (1 - alpha) / n)

"""Estimators against their formulas in numpy, written down independently of the operators and of their SQL."""

import numpy as np
import pytest

from fieldstrata.operators import design as D

AREAS = {"a": 5.0, "b": 2.0, "c": 1.0}  # areas smaller than the samples: a finite population correction would show


@pytest.fixture(scope="module")
def tables(spark):
    r = np.random.default_rng(3)
    lab = [(h, int(y), float(np.clip(0.6 * y + 0.3 * r.random(), 0, 1))) for h, n in (("a", 30), ("b", 20), ("c", 12)) for y in r.integers(0, 2, n)]
    pred = [(h, float(x)) for h, n in (("a", 200), ("b", 90), ("c", 50)) for x in r.random(n)]
    areas = spark.createDataFrame(list(AREAS.items()), "stratum string, area double")
    return lab, pred, spark.createDataFrame([(h, float(y), x) for h, y, x in lab], "stratum string, y double, x double"), spark.createDataFrame(pred, "stratum string, x double"), areas


def parts(lab, pred, h):
    y, x = np.array([r[1] for r in lab if r[0] == h], float), np.array([r[2] for r in lab if r[0] == h])
    return y, x, np.array([r[1] for r in pred if r[0] == h])


def test_ppi_has_no_finite_population_correction(spark, tables):
    lab, pred, labels, predicted, areas = tables
    total, num, den = sum(AREAS.values()), 0.0, 0.0
    for h, a in AREAS.items():
        y, x, u = parts(lab, pred, h)
        num += (a / total) ** 2 * np.cov(y, x)[0, 1] / len(y)
        den += (a / total) ** 2 * (x.var(ddof=1) / len(y) + u.var(ddof=1) / len(u))
    lam = float(np.clip(num / den, 0, 1))
    est = var = 0.0
    for h, a in AREAS.items():
        y, x, u = parts(lab, pred, h)
        est += a / total * (lam * u.mean() + (y - lam * x).mean())
        var += (a / total) ** 2 * ((y - lam * x).var(ddof=1) / len(y) + lam**2 * u.var(ddof=1) / len(u))
    stats, proxy = D.stratum_stats(labels, "y", "x"), D.proxy_summary(predicted, "x")
    got = D.stratified_ppi(stats, proxy, areas, D.lam_stratified(stats, proxy, areas)).first()
    assert np.allclose([got["lam"], got["est"], got["se"]], [lam, est, var**0.5])
    split = {r["stratum"]: r for r in D.variance_decomposition(stats, proxy, areas, D.lam_stratified(stats, proxy, areas)).collect()}
    assert np.isclose(sum(r["label_var"] + r["predicted_var"] for r in split.values()), var)
    assert np.isclose(sum(r["total_share"] for r in split.values()), 1) and np.isclose(max(r["cum_share"] for r in split.values()), 1)


def test_ratio(spark, tables):
    lab, pred, labels, _, areas = tables
    top = sum(a * parts(lab, pred, h)[0].mean() for h, a in AREAS.items())
    low = sum(a * parts(lab, pred, h)[1].mean() for h, a in AREAS.items())
    ratio = top / low
    var = sum(a**2 * (parts(lab, pred, h)[0] - ratio * parts(lab, pred, h)[1]).var(ddof=1) / len(parts(lab, pred, h)[0]) for h, a in AREAS.items()) / low**2
    got = D.stratified_ratio(D.stratum_stats(labels, "y", "x"), areas).first()
    assert np.allclose([got["est"], got["se"]], [ratio, var**0.5])


def test_vector_ppi(spark, tables):
    lab, pred, labels, predicted, areas = tables
    ys, xs = ["y0", "y1"], ["x0", "x1"]
    two = labels.selectExpr("stratum", "y as y0", "1 - y as y1", "x as x0", "1 - x as x1")
    only = predicted.selectExpr("stratum", "x as x0", "1 - x as x1")
    lams = spark.createDataFrame([(0, 0.7), (1, 0.2)], "k int, lam double")
    p, s, lam, total = np.zeros(2), np.zeros((2, 2)), np.array([0.7, 0.2]), sum(AREAS.values())
    for h, a in AREAS.items():
        y, x, u = parts(lab, pred, h)
        rest, u2 = np.c_[y, 1 - y] - lam * np.c_[x, 1 - x], np.c_[u, 1 - u]
        p += a / total * (lam * u2.mean(axis=0) + rest.mean(axis=0))
        s += (a / total) ** 2 * (np.cov(rest, rowvar=False) / len(y) + np.outer(lam, lam) * np.cov(u2, rowvar=False) / len(u))
    got = {(r["k"], r["l"]): r for r in D.ppi_multinomial(two, only, areas, ys, xs, lams).collect()}
    assert np.allclose([[got[i, j]["cov"] for j in range(2)] for i in range(2)], s) and np.allclose([got[i, i]["p_k"] for i in range(2)], p)
    stats, proxy = D.stratum_stats(labels, "y", "x"), D.proxy_summary(predicted, "x")
    tuned = {r["k"]: r["lam"] for r in D.lam_classes(two, only, areas, ys, xs).collect()}
    assert np.isclose(tuned[0], D.lam_stratified(stats, proxy, areas).first()["lam"])


def test_missing_strata_raise(spark, tables):
    _, _, labels, predicted, areas = tables
    stats, proxy = D.stratum_stats(labels, "y", "x"), D.proxy_summary(predicted, "x")
    lam = spark.createDataFrame([(0.5,)], "lam double")
    for s, p in ((stats.filter("stratum <> 'b'"), proxy), (stats, proxy.filter("stratum <> 'b'"))):
        with pytest.raises(Exception, match="stratum without"):
            D.stratified_ppi(s, p, areas, lam).collect()
    with pytest.raises(Exception, match="denominator is not positive"):
        D.stratified_ratio(D.stratum_stats(labels.selectExpr("stratum", "y", "0.0D as x"), "y", "x"), areas).collect()

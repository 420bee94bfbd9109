"""Fold-safe transforms, silhouettes, prototypes, the audit draw and leave-location-time-out, against numpy and plain loops."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldstrata.operators import acquisition, audit, folded, validation


def vectors(spark, n=300, dx=5, dy=3, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(3, 1, (n, dx)) * np.arange(1, dx + 1)
    y = x @ rng.normal(0, 1, (dx, dy)) + rng.normal(0, 0.5, (n, dy)) + 7
    covered = rng.random(n) < 0.6
    fold = rng.integers(0, 4, n)
    rows = [(i, int(fold[i]), bool(covered[i]), x[i].tolist(), y[i].tolist() if covered[i] else None) for i in range(n)]
    return spark.createDataFrame(rows, "id int, fold int, covered boolean, x array<double>, y array<double>").repartition(3), x, y, covered, fold


@pytest.mark.parametrize("run", [None, 2])
def test_pca(spark, run):
    df, x, _, covered, fold = vectors(spark)
    got = {r.id: r.pca for r in folded.fold_pca(df, "fold", "x", F.col("covered"), 3, run=run).collect()}
    for i in range(len(x)):
        if not covered[i]:
            assert got[i] is None
            continue
        train = x[covered & (fold != (fold[i] if run is None else run))]
        _, _, axes = np.linalg.svd(train - train.mean(0), full_matrices=False)
        axes = axes[:3] * np.sign(axes[np.arange(3), np.abs(axes[:3]).argmax(1)])[:, None]
        assert np.allclose(got[i], axes @ (x[i] - train.mean(0)), atol=1e-8)


def test_ridge(spark):
    """Weights as numpy's to nine digits; covered rows stay, others are flagged; nulls count as 0."""
    df, x, y, covered, fold = vectors(spark)
    out = {r.id: r for r in folded.fold_ridge(df, "fold", "x", "y", F.col("covered"), 10.0).collect()}
    for i in range(len(x)):
        assert out[i].synthetic == int(not covered[i])
        if covered[i]:
            assert out[i].y == y[i].tolist()
            continue
        own = covered & (fold != fold[i])
        mx, my = x[own].mean(0), y[own].mean(0)
        w = np.linalg.solve((x[own] - mx).T @ (x[own] - mx) + 10 * np.eye(x.shape[1]), (x[own] - mx).T @ (y[own] - my))
        assert np.allclose(out[i].y, (x[i] - mx) @ w + my, atol=1e-9, rtol=1e-9)
    sums, shift = folded.fold_sums(df, "fold", ["x", "y"], F.col("covered"))
    _, mean, products = folded.without(sums, 1)
    weights, _ = folded.ridge(products, mean + shift, 5, 10.0)
    own = covered & (fold != 1)
    mx, my = x[own].mean(0), y[own].mean(0)
    assert np.allclose(weights, np.linalg.solve((x[own] - mx).T @ (x[own] - mx) + 10 * np.eye(5), (x[own] - mx).T @ (y[own] - my)), atol=1e-9)
    nulls = df.withColumn("x", F.when(F.col("id") == 3, F.transform("x", lambda v: F.lit(None).cast("double"))).otherwise(F.col("x")))
    assert folded.fold_ridge(nulls, "fold", "x", "y", F.col("covered")).filter("y is null").count() == 0


def brute_silhouette(x, labels):
    d = np.linalg.norm(x[:, None] - x[None], axis=-1)
    s = []
    for i in range(len(x)):
        own = labels == labels[i]
        others = [d[i, labels == c].mean() for c in set(labels.tolist()) if c != labels[i]]
        a = d[i, own].sum() / (own.sum() - 1) if own.sum() > 1 else 0.0
        s.append((min(others) - a) / max(a, min(others), 1e-12) if others else 0.0)
    return float(np.mean(s))


def test_silhouettes(spark):
    """Two separate groups, a clustering across them, one with single rows, and one cluster; in several blocks."""
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(0, 0.3, (40, 5)), rng.normal(4, 0.3, (40, 5))])
    labels = {"groups": np.repeat([0, 1], 40), "across": np.arange(80) % 2, "single": np.minimum(np.arange(80), 3), "one": np.zeros(80, int)}
    df = spark.createDataFrame([(i, x[i].tolist(), *[int(v[i]) for v in labels.values()]) for i in range(80)], "id int, v array<double>, groups int, across int, single int, one int")
    scores = acquisition.silhouettes(df, "id", "v", list(labels), block=17)
    got = {r.clustering: (r.n, r.silhouette) for r in scores.collect()}
    for name, own in labels.items():
        assert got[name] == (80, pytest.approx(brute_silhouette(x, own), abs=1e-9))
    assert got["groups"][1] > 0.8 and got["one"][1] == 0
    sampled = acquisition.silhouettes(df, "id", "v", ["groups"], sample=30).first()
    assert sampled.n == 30


def test_clustering_nearest_to_zero_is_chosen(spark):
    """Not the best separated one."""
    r = acquisition.least_separated(spark.createDataFrame([("k8", 0.71), ("k64", 0.05), ("density", -0.40)], "clustering string, silhouette double")).first()
    assert (r.clustering, r.silhouette) == ("k64", 0.05)


def test_prototypes(spark):
    """Three directions are found again; similarity is the largest of the three; the floor comes before the score."""
    rng = np.random.default_rng(2)
    axes = np.eye(6)[:3]
    x = np.concatenate([a * 5 + rng.normal(0, 0.2, (30, 6)) for a in axes]) * rng.uniform(0.5, 2, (90, 1))
    df = spark.createDataFrame([(i, x[i].tolist(), 0.1 * (i % 3), 0.5, 0.25) for i in range(90)] + [(99, [0.0] * 6, 1.0, 1.0, 1.0)], "id int, v array<double>, lost double, dest double, nov double")
    found = acquisition.prototypes(df.filter("id < 90"), "id", "v", 3, 10, seed=4)
    assert np.allclose(np.linalg.norm(found, axis=1), 1)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    for r in acquisition.prototype_scores(df, "v", found, F.col("dest"), F.col("nov"), F.col("lost"), (2.0, 1.0, 1.0), 0.5).collect():
        want = (found @ unit[r.id]).max() if r.id < 90 else 0.0
        assert r.similarity == pytest.approx(want) and r.eligible == (want >= 0.5 and r.lost > 0.05)
        assert r.acquisition == (pytest.approx((want * 2 + 0.5 + 0.25) / 4) if r.eligible else None)
    assert len(acquisition.prototypes(df.limit(2), "id", "v", 3)) == 2


def pool(spark, sizes):
    return spark.createDataFrame([(f"{k}{i}", k) for k, n in sizes.items() for i in range(n)], "plot string, s string")


def test_floored_draw(spark):
    """The total, floors, one inclusion probability a stratum, a stratum below the floor taken whole, the same rows again."""
    sizes = {"big": 200, "mid": 60, "small": 5}
    draw = lambda seed: audit.floored_draw(pool(spark, sizes), "plot", "s", 50, 10, seed).collect()
    out = draw(1)
    assert len(out) == 50 == len({r.plot for r in out})
    for s, size in sizes.items():
        own = [r for r in out if r.s == s]
        assert len(own) >= min(10, size) and {round(r.incl_prob, 12) for r in own} == {round(len(own) / size, 12)}
    assert sum(r.s == "small" for r in out) == 5
    assert sorted(draw(1)) == sorted(out) and sorted(draw(2)) != sorted(out)
    with pytest.raises(Exception, match="floors exceed"):
        audit.floored_draw(pool(spark, sizes), "plot", "s", 20, 10, 1).collect()


LEGEND, CANNOT = ["A", "B"], "cannot"


def audited(spark, dis, cand, experts=8, readers=6, floor=2):
    d = spark.createDataFrame(dis, "pool string, plot int, assigned string")
    c = spark.createDataFrame(cand, "pool string, plot int, assigned string, u double, st string")
    return audit.audit_draw(d, c, F.col("u"), "st", experts, readers, floor, LEGEND, CANNOT, 5)


@pytest.fixture(scope="module")
def candidates():
    rng = random.Random(7)
    return [(rng.choice(["orig", "b1"]) if i > 20 else "orig", i, rng.choice(["A -> B", "B -> B"]), rng.random(), rng.choice("xy")) for i in range(60)]


def test_audit_draw(spark, candidates):
    """All disagreements, then the most uncertain others; the reader set is disjoint and from the main pool; ranks 1 to n."""
    dis = [("orig", 3, "A -> B|B -> B"), ("b1", 3, "cannot|A -> A"), ("orig", 4, "A -> A")]
    out = audited(spark, dis, candidates).collect()
    sup, reg = [r for r in out if r.set == "sup"], [r for r in out if r.set == "reg"]
    assert len(sup) == 8 and len(reg) == 6 and len({r.id for r in out}) == 14
    assert {(r.pool, r.plot) for r in sup if r.stratum == "disagreement"} == {("orig", "3"), ("b1", "3"), ("orig", "4")}
    rest = sorted((c for c in candidates if (c[0], c[1]) not in {(p, i) for p, i, _ in dis}), key=lambda c: -c[3])
    assert {(r.pool, r.plot) for r in sup if r.stratum == "uncertain"} == {(c[0], str(c[1])) for c in rest[:5]}
    used = {r.plot for r in sup if r.pool == "orig"}
    assert all(r.pool == "orig" and r.plot not in used for r in reg)
    strata = {str(c[1]): c[4] for c in candidates}
    assert all(sum(strata[r.plot] == s for r in reg) >= 2 for s in "xy")
    assert sorted(r.rank for r in sup) == list(range(1, 9)) and sorted(r.rank for r in reg) == list(range(1, 7))
    assert sorted(audited(spark, dis, candidates).collect()) == sorted(out)


def test_audit_fails_in_the_plan(spark, candidates):
    with pytest.raises(Exception, match="more disagreements"):
        audited(spark, [("orig", i, "A -> B") for i in range(9)], candidates).collect()
    with pytest.raises(Exception, match="no transition: A -> C"):
        audited(spark, [("orig", 1, "A -> C")], candidates).collect()
    with pytest.raises(Exception, match="twice"):
        audited(spark, [("orig", 1, "A -> B"), ("orig", 1, "B -> B")], candidates).collect()


KINDS = "loc int, year int, state int, kind string, changed boolean, f double, g double"


def table(rng, n, kinds=("observed", "pseudo")):
    return [(rng.randint(0, 11), rng.choice([2018, 2021, 2024]), s := rng.randint(0, 2), rng.choice(kinds), rng.random() < 0.4, s + rng.gauss(0, 0.7), rng.gauss(0, 1)) for _ in range(n)]


def test_leave_out(spark):
    """Predictions and reads by a plain loop; pseudo rows take the first model's states; the time cut holds."""
    rng = random.Random(3)
    pool_, test = table(rng, 400), table(rng, 150)
    folds = {loc: loc % 3 for loc in range(12)}
    fold_df = spark.createDataFrame(list(folds.items()), "loc int, fold int")
    scored = validation.leave_out(spark.createDataFrame(pool_, KINDS), spark.createDataFrame(test, KINDS), fold_df, 3, ["f", "g"])

    def fit(rows):
        return {c: [sum(r[k] for r in rows if r[2] == c) / max(sum(r[2] == c for r in rows), 1) for k in (5, 6)] for c in {r[2] for r in rows}}

    def near(means, r):
        return min((round((r[5] - m[0]) ** 2 + (r[6] - m[1]) ** 2, 9), c) for c, m in means.items())[1]

    want = []
    for k in range(3):
        train = [r for r in pool_ if folds[r[0]] != k and r[1] != 2024]
        first = fit([r for r in train if r[3] != "pseudo"])
        means = fit([r if r[3] != "pseudo" else (*r[:2], near(first, r), *r[3:]) for r in train])
        want += [(r, k, near(means, r), len(train)) for r in test if r[3] == "observed" and r[1] == 2024 and folds[r[0]] == k]
    got = scored.collect()
    assert sorted((r.f, r.fold, r.prediction, r.n_train) for r in got) == sorted((r[5], k, p, n) for r, k, p, n in want)
    by = {r.read: r for r in validation.reads(scored).collect()}
    assert by["all"].n == len(want) == by["changed"].n + by["stable"].n
    assert by["all"].accuracy == pytest.approx(sum(r[2] == p for r, _, p, _ in want) / len(want))
    assert sum(r.n for r in validation.fold_rows(scored).collect()) == len(want)


def test_leave_out_checks(spark):
    rng = random.Random(4)
    rows = spark.createDataFrame(table(rng, 200), KINDS)
    some = spark.createDataFrame([(i, i % 2) for i in range(11)], "loc int, fold int")
    with pytest.raises(Exception, match="location without fold"):
        validation.leave_out(rows, rows, some, 2, ["f", "g"]).collect()
    train, test = spark.createDataFrame([(1, 2018), (2, 2024)], "loc int, year int"), spark.createDataFrame([(2, 2024), (3, 2024)], "loc int, year int")
    assert tuple(validation.leaks(train, test, "loc", "year", True).first()) == (1, 1)
    assert tuple(validation.leaks(train, test, "loc", "year", False).first()) == (1, 0)


def test_leave_out_with_spark_ml(spark):
    rng = random.Random(5)
    whole = spark.createDataFrame([(i, i % 3) for i in range(12)], "loc int, fold int")
    scored = validation.leave_out(spark.createDataFrame(table(rng, 300), KINDS), spark.createDataFrame(table(rng, 100), KINDS), whole, 3, ["f", "g"], validation.spark_ml("logistic"))
    assert validation.reads(scored).filter("read = 'all'").first().accuracy > 0.45


def test_leave_out_reads_its_tables_once(spark):
    """The folds read what was written once, not the given tables again for each fold."""
    rng = random.Random(5)
    pool_, test = (spark.createDataFrame(table(rng, n), KINDS) for n in (300, 100))
    whole = spark.createDataFrame([(loc, loc % 3) for loc in range(12)], "loc int, fold int")
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    scored = validation.leave_out(pool_, test, whole, 3, ["f", "g"])
    assert "LogicalRDD" in plan(pool_) and "LogicalRDD" not in plan(scored)

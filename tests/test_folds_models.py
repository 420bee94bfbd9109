"""Classifiers side by side: one scaling, one reading of the test rows, and what each gives alone."""

import random

from fieldstrata.operators import models


def test_side_by_side_is_what_each_gives_alone(spark):
    rng = random.Random(41)
    rows = [(float(x > 0.3 + rng.gauss(0, 0.3)), x, y, i % 2) for i in range(400) for x, y in [(rng.random(), rng.gauss(5, 2))]]
    df = spark.createDataFrame(rows, "label double, x double, y double, fold int")
    train, test = df.filter("fold = 0"), df.filter("fold = 1")
    names = sorted(models.MODELS)
    both = models.side_by_side(train, test, ["x", "y"], names)
    got = {(r.x, r.y): [r[n] for n in names] for r in both.collect()}
    assert both.columns == [*test.columns, *names] and len(got) == 200
    for k, name in enumerate(names):
        alone = models.pipeline(["x", "y"], name).fit(train).transform(test)
        assert all(got[r.x, r.y][k] == r.prediction for r in alone.collect())

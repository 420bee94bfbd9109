"""Spacing against a plain pass over all points, and the binomial bound against its definition."""

import math
import random

from pyspark.sql import functions as F

from fieldstrata.operators import metrics, spacing


def near(a, b, km):
    dx, dy = (a[1] - b[1]) * math.cos(math.radians(a[2])) * 111.32, (a[2] - b[2]) * 110.57
    return dx * dx + dy * dy < km * km


def pass_over(points, km, kept=(), most=10**9):
    out = []
    for p in sorted(points, key=lambda p: (-p[3], p[0])):
        if len(out) < most and not any(near(p, q, km) for q in [*kept, *out]):
            out.append(p)
    return out


def points(n, seed=3):
    r = random.Random(seed)
    rows = [(i, r.uniform(-12, 12), r.uniform(40, 60), float(r.randint(0, 30)), str(r.randint(0, 2))) for i in range(n)]
    rows += [(n + i, r.uniform(-180, 180), r.choice([-1, 1]) * r.uniform(86, 90), float(i % 3), "0") for i in range(60)]  # near the poles
    return [*rows, (n + 60, *rows[0][1:]), (n + 61, *rows[0][1:])]  # equal rows


COLUMNS = "id long, lon double, lat double, score double, wc string"


def test_spread_is_the_plain_pass(spark):
    rows = points(400)
    got = spacing.spread(spark.createDataFrame(rows, COLUMNS), "id", "score", "lon", "lat", 150.0)
    assert sorted(r["id"] for r in got.collect()) == sorted(p[0] for p in pass_over(rows, 150.0))
    assert spacing.spread(spark.createDataFrame([], COLUMNS), "id", "score", "lon", "lat", 150.0).count() == 0


def test_strata_keep_their_distance_from_each_other(spark):
    rows, quotas, kept = points(300, 5), {"1": 8, "0": 12, "2": 5}, []
    for wc, most in quotas.items():
        kept += pass_over([p for p in rows if p[4] == wc], 200.0, kept, most)
    got = spacing.spread_by_stratum(spark.createDataFrame(rows, COLUMNS), "id", "wc", "score", "lon", "lat", quotas, 200.0)
    assert sorted(r["id"] for r in got.collect()) == sorted(p[0] for p in kept)


def test_upper_bound(spark):
    rows = [(0, 0), (0, 5), (3, 10), (40, 200), (7, 7)]
    got = spark.createDataFrame(rows, "k long, n long").withColumn("u", metrics.binomial_upper_column("k", "n", 0.1)).collect()
    for r in got:
        k, n, u = r["k"], r["n"], r["u"]
        if n == 0 or k >= n:
            assert u == 1.0
        else:
            assert abs(sum(math.comb(n, i) * u**i * (1 - u) ** (n - i) for i in range(k + 1)) - 0.1) < 1e-6


def test_cells_hold_all_near_points(spark):
    rows = points(200, 9)
    df = spark.createDataFrame(rows, COLUMNS)
    others = [p for p in rows if p[0] % 4 == 0]
    got = spacing.too_close(df.filter(F.col("id") % 4 != 0), spark.createDataFrame(others, COLUMNS), "id", "lon", "lat", 90.0)
    assert sorted(r["id"] for r in got.collect()) == sorted(p[0] for p in rows if p[0] % 4 and any(near(p, q, 90.0) for q in others))

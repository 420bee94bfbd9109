"""Bounded forms against plain ones on small inputs, and on sizes that the plain ones do not finish."""

import math
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldstrata import plans
from fieldstrata.operators import conformal as C
from fieldstrata.operators import joins as J
from fieldstrata.operators import metrics as M
from fieldstrata.operators import pools as P
from fieldstrata.operators import rasters as R
from fieldstrata.operators import spacing
from fieldstrata.plans.roles import predicted


@pytest.mark.parametrize("direct", [200_000, 500])
def test_calibrator_sums(direct):
    """The sum over the grid is that of its terms, whether they are added or integrated."""
    for m in (1, 53, 997, 20_003):
        for alpha in (0.03, 0.1, 0.5):
            s = alpha + 0.5 * (math.ceil(alpha * (m + 1)) / (m + 1) - alpha)
            for c in (1e-8, 1e-3, 1.0, 30.0, 1e3, 1e5):
                if direct == 500 and c / (m + 1) > 0.2:
                    continue
                plain = math.fsum(math.exp(C.log_e(k / (m + 1), c, alpha, s)) for k in range(1, m + 2))
                assert C.grid_sum(m, c, alpha, s, direct) == pytest.approx(plain, rel=1e-12, abs=1e-12)


def test_calibrator_of_many_rows():
    """2.4 million calibration rows in a class take no longer than few; a sum over them took minutes."""
    began = time.perf_counter()
    c, s = C.p_to_e(2_400_001, 0.1)
    assert time.perf_counter() - began < 5 and abs(C.grid_sum(2_400_001, c, 0.1, s) / 2_400_002 - 1) < 1e-9


def test_both_variants(spark):
    rows = [(r, k, c, 0.3 * (r + 1) * (k + 1) + c) for r in range(6) for k in range(1, 5) for c in range(3)]
    values = spark.createDataFrame(rows, "row int, fold int, cls int, e double")
    u = F.col("row") / 6.0
    both = {(r.variant, r.row, r.cls): (round(r.e, 9), r.inside) for r in C.e_value_both(values, "row", 0.1, u).collect()}
    for variant in ("rand", "max"):
        for r in C.e_value_sets(values, "row", 0.1, variant, u).collect():
            assert both.pop((variant, r.row, r.cls)) == (round(r.e, 9), r.inside)
    assert not both


def test_binomial_bounds():
    """The tail is that of its terms; a bound over millions of rows comes at once, where all terms took minutes."""
    for k, n in ((0, 10), (3, 40), (500, 1000), (9000, 20_000)):
        for p in (k / n, (k / n + 1) / 2, min(0.99, k / n + 0.01)):
            logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) for i in range(k + 1)]
            if p > 0:
                assert M.binomial_tail(k, n, p) == pytest.approx(sum(math.exp(c + i * math.log(p) + (n - i) * math.log1p(-p)) for i, c in enumerate(logs)), rel=1e-9, abs=1e-12)
    began = time.perf_counter()
    assert 0.37037 < M.binomial_upper(20_000_000, 54_000_000, 0.1) < 0.3706 and time.perf_counter() - began < 5


def test_incomplete_plots(spark):
    """A plot has rows in the years that it has, and no others."""
    plot = "loc_id string, lon double, lat double, block_id string, states map<int,string>, embeddings map<int,array<double>>, changed boolean"
    rows = [("full", 0.0, 0.0, "b", dict.fromkeys(range(2018, 2022), "s"), {y: [1.0] for y in range(2018, 2022)}, False), ("cut", 0.0, 0.0, "b", {2018: "s", 2019: "s"}, {2018: [1.0], 2019: [1.0]}, None)]
    plots = spark.createDataFrame(rows, plot)
    assert sorted((r.loc_id, r.year) for r in P.endpoints(plots, 2018, 2021).collect()) == [("cut", 2018), ("full", 2018), ("full", 2021)]
    gap = spark.createDataFrame([("gap", 0.0, 0.0, "b", {2018: "s", 2020: "s", 2021: "s"}, {2018: [1.0], 2020: [1.0], 2021: [1.0]}, False)], plot)
    assert [r.year for r in P.stable_years(gap, 2018, [2019, 2020]).collect()] == [2020] and P.pseudo_years(gap.withColumn("changed", ~F.col("changed")), [2019, 2020]).count() == 1


def test_summary_without_pairs(spark):
    """The line of all batches is there when no point was read twice."""
    assert [(r.batch_id, r.n, r.agreed, r.lo, r.hi) for r in plans.QUERIES["l22_repeat_summary"](spark, "/root/testdata/sf0.1").collect()] == [("all", 0, None, 0.0, 1.0)]


def test_map_of_one_class(spark):
    rows = [(m, i, j, (i + j) % 2 if m == "a" else 1) for m in "ab" for i in range(4) for j in range(4)]
    assert [r.map_id for r in R.high_frequency_ratio(spark.createDataFrame(rows, "map_id string, row int, col int, code int"), [0, 1]).collect()] == ["a"]


def test_predicted_rows_stay_where_they_are(spark):
    """The last labelled key of each stratum goes to the rows; the rows are not dealt out by their few strata."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = predicted(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan


def test_crowded_points(spark):
    """Points that share a place with others are settled without their pairs, of which there are 1.6 thousand million."""
    near = spark.range(40_000).select("id", (F.rand(1) * 0.5).alias("lon"), (40 + F.rand(2) * 0.5).alias("lat"))
    began = time.perf_counter()
    assert spacing.too_close(near, near, "id", "lon", "lat", 300.0).count() == 40_000 and time.perf_counter() - began < 30
    rng = random.Random(3)
    spots = [(i, rng.uniform(-180, 180), rng.choice([rng.uniform(-90, 90), rng.uniform(-2, 2), 89.9])) for i in range(400)]
    a, b = spots[:300], spots[300:]
    want = {i for i, x, y in a if any(((x - u) * math.cos(math.radians(y)) * 111.32) ** 2 + ((y - v) * 110.57) ** 2 < 300.0**2 for _, u, v in b)}
    frame = lambda rows: spark.createDataFrame(rows, "id long, lon double, lat double")
    assert {r.id for r in spacing.too_close(frame(a), frame(b), "id", "lon", "lat", 300.0).collect()} == want and 0 < len(want) < 300


def test_pairs_in_many_tasks(spark):
    rows = [(i, (i * 37 % 1000) / 10.0, float(i % 25)) for i in range(300)]
    pairs = J.within_radius(spark.createDataFrame(rows, "id long, x double, y double"), "id", "x", "y", 10.0)
    assert {(r.id, r.other) for r in pairs.collect()} == {(a[0], b[0]) for a in rows for b in rows if a[0] != b[0] and math.hypot(a[1] - b[1], a[2] - b[2]) <= 10}
    assert pairs.rdd.getNumPartitions() >= 32


def test_neighbours_of_copies(spark):
    """The best of each row, ties to the smaller id, over several blocks and slices with many equal vectors."""
    rows = [(i, [float(i % 7), float(i % 3), 1.0]) for i in range(1300)]
    got = {}
    for r in J.neighbours(spark.createDataFrame(rows, "id long, v array<double>"), "id", "v", 4, 600).collect():
        got.setdefault(r.id, []).append((-round(r.similarity, 9), r.other))
    x = np.array([v for _, v in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    s = np.round(x @ x.T, 8)
    assert len(got) == 1300 and all(sorted(got[i]) == got[i] or len(got[i]) == 4 for i in got)
    for i in range(0, 1300, 50):
        assert sorted(j for _, j in got[i]) == sorted(sorted((j for j in range(1300) if j != i), key=lambda j: (-s[i, j], j))[:4])

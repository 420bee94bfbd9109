"""Known cases and identities of operators that SQL does not cover."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldstrata.functions import scalar as S
from fieldstrata.operators import design as D
from fieldstrata.operators import labels as L
from fieldstrata.operators import metrics as M
from fieldstrata.operators import rasters as R
from fieldstrata.operators import sampling as A
from fieldstrata.operators import windows as W
from fieldstrata.streaming import label_stream


def test_ratio_hand_case(spark):
    df = spark.createDataFrame([("a", 1.0, 1.0), ("a", 0.0, 1.0), ("b", 0.0, 1.0), ("b", 0.0, 0.0)], "stratum string, y double, x double")
    area = spark.createDataFrame([("a", 1.0), ("b", 3.0)], "stratum string, area double")
    r = D.stratified_ratio(D.stratum_stats(df, "y", "x"), area).first()
    assert r["est"] == pytest.approx(0.2)


def test_constant_proxy_gives_the_classical_estimate(spark):
    rows = [(s, y, float(s == "b")) for s, ys in (("a", (0, 1, 0, 1)), ("b", (1, 1, 0, 1))) for y in map(float, ys)]
    df = spark.createDataFrame(rows, "stratum string, y double, yhat double")
    area = spark.createDataFrame([("a", 1e6), ("b", 3e6)], "stratum string, area double")
    proxy = spark.createDataFrame([("a", 100, 0.0, 0.0), ("b", 100, 1.0, 0.0)], "stratum string, pn long, pm double, pv double")
    stats = D.stratum_stats(df, "y", "yhat")
    lam = D.lam_stratified(stats, proxy, area)
    assert lam.first()["lam"] == 0
    assert D.stratified_ppi(stats, proxy, area, lam).first()["est"] == pytest.approx(D.stratified_prop(stats, area).first()["est"])


def test_missing_stratum(spark):
    df = spark.createDataFrame([("a", 1.0, 1.0), ("a", 0.0, 1.0)], "stratum string, y double, x double")
    area = spark.createDataFrame([("a", 1.0), ("b", 3.0)], "stratum string, area double")
    stats = D.stratum_stats(df, "y", "x")
    assert D.stratified_prop(stats, area).first()["est"] == 0.5
    assert [r[0] for r in D.missing_strata(stats, area).collect()] == ["b"]
    with pytest.raises(Exception, match="stratum without rows"):
        D.stratified_ratio(stats, area).collect()


def test_verdicts(spark):
    c = L.CANNOT
    rows = [("x", "y", "x", "disputed"), (None, "x", "x", "disputed"), (c, c, "x", "uninterpretable"), ("x", "x", "x", "confirmed"), ("y", "y", "x", "corrected"), ("x", "x", "x|y", "resolved")]
    df = spark.createDataFrame(rows, "a string, b string, assigned string, want string")
    got = df.select(L.verdict(F.col("a"), F.col("b"), F.split("assigned", r"\|")).alias("v"), "want").collect()
    assert all(r["v"] == r["want"] for r in got)


def test_first_mode_ties_go_to_the_first(spark):
    df = spark.createDataFrame([(1, "nature", 0), (1, "crop", 1), (1, "crop", 2), (1, "nature", 3), (2, None, 0)], "k int, v string, s int")
    assert [(r["k"], r["v"]) for r in L.first_mode(df, ["k"], "v", "s").collect()] == [(1, "nature")]


def test_numbers_and_ranks(spark):
    df = spark.createDataFrame([(i, (i * 7) % 13) for i in range(100)], "i int, v int").repartition(5)
    got = {r["i"]: r["rank"] for r in W.numbered(df, [F.col("v"), F.col("i")]).collect()}
    assert [got[i] for i in sorted(range(100), key=lambda i: ((i * 7) % 13, i))] == list(range(1, 101))
    pct = {r["v"]: r["pct"] for r in W.percentile_rank(spark.createDataFrame([(1,), (2,), (2,), (4,)], "v int"), "v").collect()}
    assert pct == {1: 0.25, 2: 0.625, 4: 1.0}


def test_allocation_sums_and_refuses(spark):
    a = spark.createDataFrame([("a", 5.0), ("b", 3.0), ("c", 0.1)], "stratum string, area double")
    got = {r["stratum"]: r["quota"] for r in A.allocate(a, 20, 2).collect()}
    assert sum(got.values()) == 20 and min(got.values()) >= 2
    with pytest.raises(Exception, match="below the minimum"):
        A.allocate(a, 5, 2).collect()


def test_greedy_selections(spark):
    v = spark.createDataFrame([(0, [0.0, 0.0]), (1, [10.0, 0.0]), (2, [0.0, 9.0]), (3, [0.1, 0.1])], "id long, v array<double>")
    assert {r["id"] for r in A.k_center(v, "id", "v", 3).collect()} == {1, 2, 0} or {r["id"] for r in A.k_center(v, "id", "v", 3).collect()} == {1, 2, 3}
    c = spark.createDataFrame([(0, 9.0, 0.0), (1, 5.0, 5.0), (2, 0.0, 9.0)], "id long, a double, b double")
    assert [r["id"] for r in A.class_balance(c, "id", ["a", "b"], 2).orderBy("pick").collect()][0] == 1
    folds = {r["b"]: r["fold"] for r in A.pack_blocks(spark.createDataFrame([("x",)] * 5 + [("y",)] * 3 + [("z",)] * 2, "b string"), "b", 2).collect()}
    assert folds["y"] == folds["z"] != folds["x"]


def test_binomial_bound():
    assert M.binomial_upper(0, 10, 0.05) == pytest.approx(1 - 0.05**0.1, abs=1e-9)
    assert M.binomial_upper(3, 3, 0.1) == 1.0 and M.binomial_upper(0, 0, 0.1) == 1.0


def test_temperature_and_vendi(spark):
    rng = np.random.default_rng(1)
    z = rng.normal(size=(3000, 3)) * 2
    p = np.exp(z) / np.exp(z).sum(axis=1, keepdims=True)
    y = [int(rng.choice(3, p=q)) for q in p]
    df = spark.createDataFrame([(t, *map(float, 2 * r)) for t, r in zip(y, z, strict=True)], "y int, a double, b double, c double")
    assert M.temperature_fit(df, ["a", "b", "c"], "y") == pytest.approx(2.0, abs=0.25)
    e = spark.createDataFrame([([1.0, 0.0],), ([0.0, 1.0],), ([1.0, 0.0],), ([0.0, 2.0],)], "v array<double>")
    assert M.vendi(e, "v").first()["vendi"] == pytest.approx(2.0)


def test_infinite_quantile_when_too_few(spark):
    df = spark.createDataFrame([(0.1,), (0.2,)], "s double")
    assert math.isinf(M.split_quantile(df, "s", 0.1).first()["q"])


def test_segments_are_connected_components(spark):
    rng = np.random.default_rng(3)
    g = rng.integers(0, 2, (12, 15))
    df = spark.createDataFrame([("m", i, j, int(g[i, j])) for i in range(12) for j in range(15)], "map_id string, row long, col long, code int")
    got = sorted(r["size"] for r in R.segments(df).collect())
    seen, sizes = set(), []
    for i in range(12):
        for j in range(15):
            if (i, j) not in seen:
                stack, n = [(i, j)], 0
                seen.add((i, j))
                while stack:
                    a, b = stack.pop()
                    n += 1
                    for c, d in ((a + 1, b), (a - 1, b), (a, b + 1), (a, b - 1)):
                        if 0 <= c < 12 and 0 <= d < 15 and (c, d) not in seen and g[c, d] == g[a, b]:
                            seen.add((c, d))
                            stack.append((c, d))
                sizes.append(n)
    assert got == sorted(sizes)


def test_utm_cell_known_point(spark):
    r = spark.createDataFrame([(9.0, 48.0)], "lon double, lat double").select(S.utm_epsg(F.col("lon"), F.col("lat")).alias("e"), S.utm_cell("lon", "lat", S.utm_epsg(F.col("lon"), F.col("lat"))).alias("c")).first()
    assert r["e"] == 32632 and r["c"]["x"] == 500000 and abs(r["c"]["y"] - 5316300) < 500


def test_unknown_class_raises(spark):
    df = spark.createDataFrame([("lava",)], "c string")
    with pytest.raises(Exception, match="unknown class"):
        df.select(S.coarsen(F.col("c"))).collect()


def test_upsert_over_batches(spark, tmp_path):
    source, out = tmp_path / "in", str(tmp_path / "out")
    rows = lambda *r: spark.createDataFrame(list(r), "campaign string, batch_id string, point_id string, expert_id string, transition string, labelled_at timestamp, seq long")
    rows(("c", "b", "1", "e", "x", None, 1), ("c", "b", "2", "e", "x", None, 2)).coalesce(1).write.parquet(str(source / "a"))
    for part in ("a", "b"):
        if part == "b":
            rows(("c", "b", "1", "e", "y", None, 3), ("c", "b", "1", "e", "z", None, 4)).coalesce(1).write.parquet(str(source / "b"))
        stream = spark.readStream.schema(label_stream.SCHEMA).parquet(str(source / "*"))
        label_stream.upsert_stream(stream, out, str(tmp_path / "ck")).awaitTermination()
    got = {r["point_id"]: r["transition"] for r in label_stream.current(spark, out).collect()}
    assert got == {"1": "z", "2": "x"}

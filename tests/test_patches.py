"""Window features of pixel tables against plain loops; legend bands and scaled guides."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldstrata.operators import patches as P
from fieldstrata.operators import windows as W

PX = "map_id string, row int, col int, blue double, green double, red double, nir double"


def pixels(rng, maps, rows, cols, missing=0.1, nulls=0.1):
    out = []
    for m in maps:
        for r in range(rows):
            for c in range(cols):
                if rng.random() >= missing:
                    bands = [round(rng.uniform(50, 3000), 1) for _ in range(4)]
                    if rng.random() < nulls:
                        bands[rng.randrange(4)] = None
                    out.append((m, r, c, *bands))
    return out


def grid(rows, name, m, height, width):
    g = np.full((height, width), np.nan)
    for own, r, c, *bands in rows:
        b = [np.nan if x is None else x for x in bands]
        if own == m:
            blue, green, red, nir = b
            g[r, c] = {"blue": blue, "nir": nir, "brightness": sum(b) / 4, "ndvi": (nir - red) / (nir + red + 1e-6), "ci": (red - blue) / (red + blue + 1e-6)}[name]
    return g


def around(g, r, c, size):
    first = -((size - 1) // 2)
    h, w = g.shape
    return np.array([[g[min(max(r + i, 0), h - 1), min(max(c + j, 0), w - 1)] for j in range(first, first + size)] for i in range(first, first + size)])


def same(a, b):
    return (a is None or math.isnan(a)) and math.isnan(b) or a == pytest.approx(b, abs=1e-7, rel=1e-9)


@pytest.mark.parametrize("tile", [8, 64])
def test_pixel_features(spark, tile):
    """Maps of odd size, absent pixels and bands, borders repeated, tiles that cut windows, an even window."""
    rows = pixels(random.Random(1), ["a", "b"], 19, 13)
    names = ["c_ndvi", "m3_ndvi", "s3_ndvi", "m9_ci", "s9_brightness", "lc_ndvi", "g_ndvi", "g_blue", "bf3", "bf6"]
    df = spark.createDataFrame(rows, PX).repartition(3)
    got = {(r.map_id, r.row, r.col): r for r in P.pixel_features(df, names, tile, (3, 9), (3, 6)).collect()}
    assert len(got) == len(rows)
    for m in "ab":
        own = [(r, c) for x, r, c, *_ in rows if x == m]
        top, left = min(r for r, _ in own), min(c for _, c in own)
        height, width = max(r for r, _ in own) + 1, max(c for _, c in own) + 1
        g = {n: grid(rows, n, m, height, width)[top:, left:] for n in ("ndvi", "ci", "brightness", "blue")}
        for r, c in own:
            row, at = got[m, r, c], (r - top, c - left)
            three, nine = around(g["ndvi"], *at, 3), around(g["ndvi"], *at, 9)
            assert same(row.c_ndvi, g["ndvi"][at])
            assert same(row.m3_ndvi, np.nanmean(three) if np.isfinite(three).any() else np.nan) and same(row.s3_ndvi, np.nanstd(three) if np.isfinite(three).any() else np.nan)
            assert same(row.m9_ci, np.nanmean(around(g["ci"], *at, 9))) and same(row.s9_brightness, np.nanstd(around(g["brightness"], *at, 9)))
            assert same(row.lc_ndvi, g["ndvi"][at] - np.nanmean(nine))
            for name, x in (("g_ndvi", three), ("g_blue", around(g["blue"], *at, 3))):
                gx, gy = (x[:, 2] - x[:, 0]) @ [1, 2, 1], (x[2] - x[0]) @ [1, 2, 1]
                assert same(row[name], math.hypot(gx, gy) if np.isfinite(x).all() else np.nan)
            for name, size in (("bf3", 3), ("bf6", 6)):
                assert same(row[name], (around(g["ndvi"], *at, size) < P.VEGETATION).mean())


def test_all_features(spark):
    """Every name by default, an empty table, and a window's cost that does not depend on its size."""
    df = spark.createDataFrame(pixels(random.Random(2), ["a"], 5, 5, 0, 0), PX)
    out = P.pixel_features(df)
    assert len(out.columns) == 3 + 11 * (1 + 6 + 1 + 1) + 5 and out.count() == 25
    assert P.pixel_features(df.limit(0), ["bf64"]).count() == 0
    x = np.random.default_rng(0).random((2, 90, 70))
    for size in (3, 8, 25, 64):
        brute = np.array([[[x[k, r : r + size, c : c + size].mean() for c in range(x.shape[2] - size + 1)] for r in range(x.shape[1] - size + 1)] for k in range(2)])
        assert np.allclose(P.window_means(x, size), brute)


def test_patch_features(spark):
    """Centre windows, gradient, pooled cells and built shares of 64 x 64 patches."""
    rng = random.Random(3)
    rows = [(p, y, r, c, b, g, n, i) for p in (1, 2) for y in (2018, 2024) for _, r, c, b, g, n, i in pixels(rng, ["x"], 64, 64, 0.05, 0.03)]
    df = spark.createDataFrame(rows, "plot int, year int, row int, col int, blue double, green double, red double, nir double")
    got = {(r.plot, r.year, r.channel): r for r in P.patch_features(df, ["plot", "year"]).collect()}
    assert len(got) == 4 * 11
    shares = {(r.plot, r.year): r for r in P.built_shares(df, ["plot", "year"]).collect()}
    for p in (1, 2):
        for y in (2018, 2024):
            own = [("x", *r[2:]) for r in rows if r[0] == p and r[1] == y]
            for name in ("ndvi", "ci", "blue"):
                g, row = grid(own, name, "x", 64, 64), got[p, y, name]
                assert same(row.c, g[31, 31])
                for w in (3, 9, 25):
                    low = (64 - w) // 2
                    block = g[low : low + w, low : low + w]
                    assert same(row[f"m{w}"], np.nanmean(block)) and same(row[f"s{w}"], np.nanstd(block))
                x = g[30:33, 30:33]
                gx, gy = (x[:, 2] - x[:, 0]) @ [1, 2, 1], (x[2] - x[0]) @ [1, 2, 1]
                assert same(row.g, math.hypot(gx, gy))
                if name != "ci":
                    assert np.allclose(row.pooled, np.nanmean(g.reshape(8, 8, 8, 8), axis=(1, 3)).ravel())
                else:
                    assert row.pooled is None
            ndvi = grid(own, "ndvi", "x", 64, 64)
            for w in P.BUILT_WINDOWS:
                low = (64 - w) // 2
                assert same(shares[p, y][f"bf{w}"], (ndvi[low : low + w, low : low + w] < P.VEGETATION).mean())
    both = {r.plot: r.c for r in P.endpoint_differences(P.patch_features(df, ["plot", "year"]).filter("channel = 'blue'"), ["plot"], "year", 2018, 2024, ["c"]).collect()}
    for p in (1, 2):
        a, b = (got[p, y, "blue"].c for y in (2018, 2024))
        assert both[p] == (None if a is None or b is None else pytest.approx(b - a))


def test_presence(spark):
    rows = [(1, y, 31, 31, 1.0, 1.0, 1.0, 1.0) for y in (2018, 2024)] + [(2, 2018, 31, 31, 1.0, 1.0, 1.0, 1.0), (2, 2024, 31, 31, 1.0, None, 1.0, 1.0), (3, 2018, 31, 31, 1.0, 1.0, 1.0, 1.0), (3, 2024, 5, 5, 1.0, 1.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "plot int, year int, row int, col int, blue double, green double, red double, nir double")
    assert {r.plot: r.present for r in P.presence(df, "plot", "year", [2018, 2024]).collect()} == {1: 1.0, 2: 0.0, 3: 0.0}


def test_bands_by_name(spark):
    bands = spark.createDataFrame([("b", 0.1), ("a", 0.2)], "band string, p double")
    legend = spark.createDataFrame([(3, "a"), (5, "b"), (7, "c")], "code int, name string")
    assert {(r.band, r.code) for r in P.aligned_bands(bands, legend).collect()} == {("a", 3), ("b", 5)}
    with pytest.raises(Exception, match="no class of the map: zzz"):
        P.aligned_bands(spark.createDataFrame([("zzz", 0.1)], "band string, p double"), legend).collect()


def test_guide(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice([None, -1.0, 0.0, *[round(rng.uniform(1, 100), 1)] * 6]), rng.random() < 0.8) for i in range(500)]
    df = spark.createDataFrame(rows, "i int, v double, ok boolean").repartition(5)
    low, high = np.percentile([v for _, v, ok in rows if ok and v is not None and v > 0], [2, 98])
    got = {r.i: r.guide for r in P.scaled_guide(df, "v", F.col("ok")).collect()}
    for i, v, _ in rows:
        assert got[i] is None if v is None else got[i] == pytest.approx(min(max((v - low) / (high - low), 0), 1))
    with pytest.raises(Exception, match="no valid pixels"):
        P.scaled_guide(df, "v", F.lit(False)).collect()


def test_exact_percentiles(spark):
    rng = random.Random(5)
    values = [rng.randint(0, 30) / 2 for _ in range(333)]
    r = W.exact_percentiles(spark.createDataFrame([(v,) for v in [*values, None]], "v double").repartition(4), "v", [0.0, 0.02, 0.5, 0.98, 1.0]).first()
    assert r.n == 333 and [r[f"q{i}"] for i in range(5)] == pytest.approx(list(np.percentile(values, [0, 2, 50, 98, 100])))
    assert tuple(W.exact_percentiles(spark.createDataFrame([], "v double"), "v", [0.5]).first()) == (0, None)

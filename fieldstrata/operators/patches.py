"""Spectral channels and window features of pixel tables (four reflectance bands a pixel; an absent one is null).

``pixel_features`` gives every pixel its windows: pixels are dealt to square tiles with a margin (halo) as wide as the
largest window needs, and each tile works on running sums, so a window's cost does not depend on its size and no task
holds more than a tile. ``patch_features`` gives the centre of each patch the same windows by one grouped scan.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import spectral

BANDS = ["blue", "green", "red", "nir"]
#: The channels whose pooled cells are kept, and all of them.
BASE = [*BANDS, "ndvi", "ndwi", "brightness"]
CHANNELS = [*BASE, "evi2", "grvi", "bsi", "ci"]
SCALES = (3, 9, 25)
BUILT_WINDOWS = (3, 5, 9, 25, 64)
#: Vegetation has an index of at least that.
VEGETATION = 0.31


def channels() -> dict[str, Column]:
    """Columns of all channels from the four bands; null where a band that they need is."""
    return {b: F.col(b).cast("double") for b in BANDS} | spectral(*[F.col(b).cast("double") for b in BANDS])


def reach(size: int) -> tuple[int, int]:
    """First and last offset of a window: a square of even size has one more cell after its centre than before."""
    first = -((size - 1) // 2)
    return first, first + size - 1


def window_means(values: np.ndarray, size: int) -> np.ndarray:
    """Means of every full window of a two-dimensional array (last two axes) by running sums along rows, then columns;
    as many cells less as the window is longer than one."""
    for axis in (-1, -2):
        run = np.cumsum(values, axis)
        head = np.take(run, [size - 1], axis)
        n = values.shape[axis]
        ahead, behind = np.take(run, np.arange(size, n), axis), np.take(run, np.arange(n - size), axis)
        values = np.concatenate([head, ahead - behind], axis)
    return values / size**2


def tile_features(cube: np.ndarray, halo: int, scales: tuple[int, ...] = SCALES, built: tuple[int, ...] = BUILT_WINDOWS) -> dict[str, np.ndarray]:
    """Features of a tile's own cells from channels (channel, row, col) that reach ``halo`` cells beyond them on all sides.

    Means and deviations leave out absent cells and are null where all are; Sobel gradients are null where one of the
    nine is; for built shares an absent cell is a cell that is not built.
    """
    n = cube.shape[-1] - 2 * halo

    def means(values: np.ndarray, size: int) -> np.ndarray:
        first, last = reach(size)
        return window_means(values[..., halo + first : halo + n + last, halo + first : halo + n + last], size)

    there, own = np.isfinite(cube), cube[:, halo : halo + n, halo : halo + n]
    # differences from a middle value keep the squares' sums exact enough
    centre = np.nan_to_num(np.nanmedian(np.where(there, cube, np.nan).reshape(len(cube), -1), 1)) if there.any() else np.zeros(len(cube))
    filled = np.where(there, cube - centre[:, None, None], 0.0)
    out = {f"c_{name}": own[i] for i, name in enumerate(CHANNELS)}
    for size in scales:
        # a share under half a cell is none
        count, first, second = means(there.astype(float), size), means(filled, size), means(filled**2, size)
        count = np.where(count * size**2 > 0.5, count, np.nan)
        mean = first / count
        deviation = np.sqrt(np.maximum(second / count - mean**2, 0))
        out |= {f"m{size}_{name}": mean[i] + centre[i] for i, name in enumerate(CHANNELS)} | {f"s{size}_{name}": deviation[i] for i, name in enumerate(CHANNELS)}
    if 9 in scales:
        out |= {f"lc_{name}": own[i] - out[f"m9_{name}"] for i, name in enumerate(CHANNELS)}
    at = lambda r, c: cube[:, halo + r : halo + n + r, halo + c : halo + n + c]
    right, down = (sum(w * (at(*((k, 1) if axis else (1, k))) - at(*((k, -1) if axis else (-1, k)))) for k, w in ((-1, 1), (0, 2), (1, 1))) for axis in (1, 0))
    gradient = np.where(np.isfinite(own), np.sqrt(right**2 + down**2), np.nan)
    out |= {f"g_{name}": gradient[i] for i, name in enumerate(CHANNELS)}
    bare = (cube[CHANNELS.index("ndvi")] < VEGETATION).astype(float)  # False where absent
    return out | {f"bf{size}": means(bare, size) for size in built}


def pixel_features(px: DataFrame, names: list[str] | None = None, tile: int = 128, scales: tuple[int, ...] = SCALES, built: tuple[int, ...] = BUILT_WINDOWS) -> DataFrame:
    """map_id, row, col and the named features (default: all) of every pixel row of px (map_id, row, col, four bands).

    c_, m3_, s3_, ..., lc_, g_ with a channel's name: the value, window mean and deviation, value less the mean of 9 x 9,
    Sobel gradient; bf3, ...: share of the window with little vegetation. Beyond a map's border its outermost rows and
    columns are repeated. A pixel that is not in the table is absent, as is one with null bands.
    """
    halo = max(1, *(last for s in (*scales, *built) for last in (reach(s)[1], -reach(s)[0])))
    if tile < halo:
        raise ValueError("a tile must be at least as wide as its margin")
    every = [f"{kind}_{c}" for kind in ["c", *(f"{k}{s}" for s in scales for k in "ms"), *(["lc"] if 9 in scales else []), "g"] for c in CHANNELS] + [f"bf{s}" for s in built]
    names = names or every
    rows = px.select("map_id", F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), *[c.alias(n) for n, c in channels().items()])
    extent = rows.groupBy("map_id").agg(F.min("row").alias("r0"), F.max("row").alias("r1"), F.min("col").alias("c0"), F.max("col").alias("c1"))
    span = lambda x: F.explode(F.sequence(F.floor((F.col(x) - halo) / tile), F.floor((F.col(x) + halo) / tile)))
    dealt = rows.withColumn("tr_", span("row")).withColumn("tc_", span("col")).join(extent, "map_id")  # a row a map

    def features(df: pd.DataFrame) -> pd.DataFrame:
        one = df.iloc[0]
        top, left = int(one.tr_) * tile, int(one.tc_) * tile
        grid = np.full((len(CHANNELS), tile + 2 * halo, tile + 2 * halo), np.nan)
        r, c = df["row"].to_numpy() - top + halo, df["col"].to_numpy() - left + halo
        inside = (r >= 0) & (r < grid.shape[1]) & (c >= 0) & (c < grid.shape[2])
        grid[:, r[inside], c[inside]] = df.loc[inside, CHANNELS].to_numpy(float).T
        pick = lambda first, low, high: np.clip(np.arange(grid.shape[1]), max(low - first + halo, 0), min(high - first + halo, grid.shape[1] - 1))
        grid = grid[:, pick(top, int(one.r0), int(one.r1))][:, :, pick(left, int(one.c0), int(one.c1))]
        own = (r >= halo) & (r < halo + tile) & (c >= halo) & (c < halo + tile)
        found = tile_features(grid, halo, scales, built) if own.any() else {}
        r, c = r[own] - halo, c[own] - halo
        at = df.loc[own, ["map_id", "row", "col"]].reset_index(drop=True)
        return pd.concat([at, pd.DataFrame({n: found[n][r, c] if found else np.empty(0) for n in names})], axis=1)

    kinds = dict(px.dtypes)
    out = dealt.groupBy("map_id", "tr_", "tc_").applyInPandas(features, f"map_id {kinds['map_id']}, row long, col long, " + ", ".join(f"{n} double" for n in names))
    return out.select("map_id", "row", "col", *[F.nanvl(n, F.lit(None).cast("double")).alias(n) for n in names])


def patch_features(px: DataFrame, by: list[str], size: int = 64, cells: int = 8, scales: tuple[int, ...] = SCALES) -> DataFrame:
    """One row a patch (columns ``by``) and channel: centre, m3, s3, ..., local contrast lc, gradient g at the centre, and
    pooled (cells x cells means in rows, null where all pixels of a cell are; for base channels only).

    px has patch columns, row and col from 0 to size - 1, and the bands. A window is that of ``reach`` around the centre
    at (size - 1) // 2 for odd windows. One scan: pixels are put in long form by channel, and every window, the gradient
    and the cells are conditional aggregates, combined map-side.
    """
    long = px.select(*by, "row", "col", F.explode(F.array(*[F.struct(F.lit(n).alias("channel"), c.alias("v")) for n, c in channels().items()])).alias("x")).select(*by, "row", "col", "x.channel", "x.v")

    def inside(w: int) -> Column:
        low = (size - w) // 2
        return F.col("row").between(low, low + w - 1) & F.col("col").between(low, low + w - 1)

    low = (size - 3) // 2
    r, c = F.col("row") - (low + 1), F.col("col") - (low + 1)
    weight = lambda along, across: F.when(F.abs(across) == 0, 2 * along).otherwise(along)
    aggs = [F.max(F.when(inside(1), F.col("v"))).alias("c")]
    for w in scales:
        aggs += [F.avg(F.when(inside(w), F.col("v"))).alias(f"m{w}"), F.stddev_pop(F.when(inside(w), F.col("v"))).alias(f"s{w}")]
    aggs += [F.sum(F.when(inside(3), F.col("v") * weight(c, r))).alias("gx_"), F.sum(F.when(inside(3), F.col("v") * weight(r, c))).alias("gy_")]
    # of the nine only the centre may be absent
    aggs.append(F.count(F.when(inside(3) & ~inside(1), F.col("v"))).alias("n_"))
    step = size // cells
    base = F.col("channel").isin(*BASE)
    cell = F.floor(F.col("row") / step) * cells + F.floor(F.col("col") / step)
    pooled = [F.avg(F.when(base & (cell == k), F.col("v"))) for k in range(cells * cells)]
    out = long.groupBy(*by, "channel").agg(*aggs, F.array(*pooled).alias("pooled"))
    gradient = F.when(F.col("n_") == 8, F.sqrt(F.col("gx_") ** 2 + F.col("gy_") ** 2)).alias("g")
    contrast = [(F.col("c") - F.col("m9")).alias("lc")] if 9 in scales else []
    return out.select(*by, "channel", "c", *[f"{k}{w}" for w in scales for k in "ms"], *contrast, gradient, F.when(base, F.col("pooled")).alias("pooled"))


def built_shares(px: DataFrame, by: list[str], size: int = 64, windows: tuple[int, ...] = BUILT_WINDOWS) -> DataFrame:
    """One row a patch: bf3, bf5, ...: the share of the centre window's cells with little vegetation. An absent cell, in
    the table or not, counts as one that is not built."""
    low = lambda w: (size - w) // 2
    bare = (channels()["ndvi"] < VEGETATION).cast("int")
    inside = lambda w: F.col("row").between(low(w), low(w) + w - 1) & F.col("col").between(low(w), low(w) + w - 1)
    return px.groupBy(*by).agg(*[(F.coalesce(F.sum(F.when(inside(w), bare)), F.lit(0)) / w**2).alias(f"bf{w}") for w in windows])


def endpoint_differences(features: DataFrame, by: list[str], year: str, first: int, last: int, values: list[str]) -> DataFrame:
    """Each value of the last year less that of the first, for keys that have both years (by one grouped scan)."""
    at = lambda v, y: F.max(F.when(F.col(year) == y, F.col(v)))
    both = features.filter(F.col(year).isin(first, last)).groupBy(*by).agg(*[(at(v, last) - at(v, first)).alias(v) for v in values], F.count_distinct(year).alias("n_"))
    return both.filter("n_ = 2").drop("n_")


def presence(px: DataFrame, plot: str, year: str, years: list[int], size: int = 64) -> DataFrame:
    """plot and ``present``: 1 where the centre pixel has all four bands in all the years, else 0."""
    middle = (size - 1) // 2
    whole = (F.col("row") == middle) & (F.col("col") == middle) & F.col(year).isin(*years)
    for b in BANDS:
        whole = whole & F.col(b).isNotNull()
    found = px.groupBy(plot).agg(F.count_distinct(F.when(whole, F.col(year))).alias("n_"))
    return found.select(plot, (F.col("n_") == len(years)).cast("double").alias("present"))


def aligned_bands(bands: DataFrame, legend: DataFrame) -> DataFrame:
    """Posterior bands (band, and any other columns) with the map's ``code`` of the class that the band is named after.

    Bands go by name, never by position. A band that the legend (code, name) has not fails the query.
    """
    known = legend.select(F.col("name").alias("band"), "code")
    missing = F.raise_error(F.concat(F.lit("posterior band is no class of the map: "), F.coalesce("band", F.lit("null")))).cast(dict(legend.dtypes)["code"])
    return bands.join(known, "band", "left").withColumn("code", F.coalesce("code", missing))


def scaled_guide(px: DataFrame, value: str, valid: Column, low: float = 0.02, high: float = 0.98, name: str = "guide") -> DataFrame:
    """px with its guide image scaled to 0..1 between two exact percentiles of the valid, positive values; values beyond
    them are clipped, null stays null. No such value fails the query."""
    from .windows import exact_percentiles

    v = F.col(value).cast("double")
    bounds = exact_percentiles(px.select(F.when(valid & (v > 0) & (v < float("inf")), v).alias("v")), "v", [low, high])
    sure = F.when(F.col("n") == 0, F.raise_error("guide has no valid pixels").cast("double")).otherwise(F.col("q0"))
    bounds = bounds.select(sure.alias("q0_"), F.col("q1").alias("q1_"))
    scaled = (v - F.col("q0_")) / F.greatest(F.col("q1_") - F.col("q0_"), F.lit(1e-6))
    return px.crossJoin(F.broadcast(bounds)).withColumn(name, F.when(v.isNotNull(), F.least(F.greatest(scaled, F.lit(0.0)), F.lit(1.0)))).drop("q0_", "q1_")  # one row

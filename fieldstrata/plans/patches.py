"""Queries of spectral window features; pixels come from lineitem."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import patches as P
from .registry import query, read

_BANDS = "avg(l_discount) * 3970.37::double + 100 as blue, avg(l_tax) * 5011.13::double + 150 as green, avg(l_quantity) * 29.713::double as red, avg(l_extendedprice) / 19.717::double as nir"


def pixels(spark, d, **keys):
    """Bands by pixel: means over the rows that fall on it."""
    mean = {"blue": F.avg("l_discount") * 3970.37 + 100, "green": F.avg("l_tax") * 5011.13 + 150, "red": F.avg("l_quantity") * 29.713, "nir": F.avg("l_extendedprice") / 19.717}
    return read(spark, d, "lineitem").groupBy(*[c.alias(n) for n, c in keys.items()]).agg(*[c.alias(n) for n, c in mean.items()])


def grid(spark, d):
    return pixels(spark, d, map_id=F.col("l_linenumber") % 2, row=F.col("l_partkey") % 100, col=F.col("l_orderkey") % 100)


_NDVI, _BSI = "(nir - red) / (nir + red + 1e-6)", "((red + blue) - (nir + green)) / ((red + blue) + (nir + green) + 1e-6)"
_GRID = f"""px as (select l_linenumber % 2 as map_id, l_partkey % 100 as row, l_orderkey % 100 as col, {_BANDS} from lineitem group by all), ext as (select map_id, min(row) as r0, max(row) as r1, min(col) as c0, max(col) as c1 from px group by 1),
pad as materialized (select e.map_id, i as row, j as col, {_NDVI} as ndvi, {_BSI} as bsi, coalesce(({_NDVI} < 0.31)::int, 0) as bare
 from ext e, (select unnest(range(-40, 141)) as i), (select unnest(range(-40, 141)) as j) left join px p on p.map_id = e.map_id and p.row = greatest(r0, least(r1, i)) and p.col = greatest(c0, least(c1, j)) where i between r0 - 32 and r1 + 32 and j between c0 - 32 and c1 + 32)"""


def _window(name: str, value: str, size: int) -> str:
    """Sums over a square window on the padded grid, along rows and then columns."""
    first, last = P.reach(size)
    frame = f"rows between {-first} preceding and {last} following"
    rows = f"select map_id, row, col, sum({value}) over w as s, sum({value} * {value}) over w as q, count({value}) over w as n from pad window w as (partition by map_id, row order by col {frame})"
    return f"{name} as (select map_id, row, col, sum(s) over w as s, sum(q) over w as q, sum(n) over w as n from ({rows}) window w as (partition by map_id, col order by row {frame}))"


_MEANS = [("ndvi", 3), ("ndvi", 9), ("ndvi", 25), ("bsi", 9)]
_BUILT = [3, 9, 64]
_NAMES = ["c_ndvi", "g_ndvi", "lc_ndvi"] + [f"{k}{w}_{v}" for v, w in _MEANS for k in "ms"] + [f"bf{w}" for w in _BUILT]
_WINDOWS = ", ".join([_window(f"{v}{w}", v, w) for v, w in _MEANS] + [_window(f"b{w}", "bare", w) for w in _BUILT])
_SOBEL = """gy as (select map_id, row, col, ndvi, lag(ndvi) over r + 2 * ndvi + lead(ndvi) over r as v, lead(ndvi) over r - lag(ndvi) over r as h from pad window r as (partition by map_id, col order by row)),
gr as (select map_id, row, col, case when ndvi is not null then sqrt((lead(v) over c - lag(v) over c) * (lead(v) over c - lag(v) over c) + (lag(h) over c + 2 * h + lead(h) over c) * (lag(h) over c + 2 * h + lead(h) over c)) end as g from gy window c as (partition by map_id, row order by col))"""
_STATS = ", ".join(f"round({v}{w}.s / {v}{w}.n, 6) as m{w}_{v}, round(sqrt(greatest({v}{w}.q / {v}{w}.n - pow({v}{w}.s / {v}{w}.n, 2), 0)), 6) as s{w}_{v}" for v, w in _MEANS)


@query("r23_pixel_features", f"with {_GRID}, {_WINDOWS}, {_SOBEL} select map_id, row, col, round(pad.ndvi, 6) as c_ndvi, round(g, 6) as g_ndvi, round(pad.ndvi - ndvi9.s / ndvi9.n, 6) as lc_ndvi, {_STATS}, " + ", ".join(f"round(b{w}.s / {w * w}.0::double, 6) as bf{w}" for w in _BUILT) + " from px join pad using (map_id, row, col) join gr using (map_id, row, col) " + " ".join(f"join {v}{w} using (map_id, row, col)" for v, w in [*_MEANS, *(("b", w) for w in _BUILT)]))
def r23(spark, d):
    return P.pixel_features(grid(spark, d), _NAMES, tile=48)


def plots(spark, d):
    return pixels(spark, d, plot=F.col("l_suppkey") % 4, year=F.lit(2018) + 6 * (F.col("l_linenumber") % 2), row=F.col("l_partkey") % 64, col=F.col("l_orderkey") % 64)


_PLOTS = f"px as (select l_suppkey % 4 as plot, 2018 + 6 * (l_linenumber % 2) as year, l_partkey % 64 as row, l_orderkey % 64 as col, {_BANDS} from lineitem group by all)"
_INDEX = {
    **{b: b for b in P.BANDS}, "ndvi": _NDVI, "ndwi": "(green - nir) / (green + nir + 1e-6)", "brightness": "(blue + green + red + nir) / 4", "evi2": "2.5 * (nir * 1e-4 - red * 1e-4) / (nir * 1e-4 + 2.4 * (red * 1e-4) + 1)",
    "grvi": "(green - red) / (green + red + 1e-6)", "bsi": _BSI, "ci": "(red - blue) / (red + blue + 1e-6)",
}
_LONG = "lg as (" + " union all ".join(f"select plot, year, row, col, '{n}' as channel, {c} as v from px" for n, c in _INDEX.items()) + ")"


def _inside(w: int) -> str:
    low = (64 - w) // 2
    return f"row between {low} and {low + w - 1} and col between {low} and {low + w - 1}"


_GX, _GY = "v * (col - 31) * case when row = 31 then 2 else 1 end", "v * (row - 31) * case when col = 31 then 2 else 1 end"
_FEATURES = f"""ft as (select plot, year, channel, max(v) filter (row = 31 and col = 31) as c, {', '.join(f'avg(v) filter ({_inside(w)}) as m{w}, stddev_pop(v) filter ({_inside(w)}) as s{w}' for w in P.SCALES)},
 case when count(v) filter ({_inside(3)} and not (row = 31 and col = 31)) = 8 then sqrt(pow(sum({_GX}) filter ({_inside(3)}), 2) + pow(sum({_GY}) filter ({_inside(3)}), 2)) end as g from lg group by all)"""
_VALUES = ["c", *[f"{k}{w}" for w in P.SCALES for k in "ms"], "lc", "g"]


@query("r10_patch_features", f"with {_PLOTS}, {_LONG}, {_FEATURES} select plot, year, channel, " + ", ".join(f"round({'c - m9' if v == 'lc' else v}, 6) as {v}" for v in _VALUES) + " from ft")
def r10(spark, d):
    return P.patch_features(plots(spark, d), ["plot", "year"]).drop("pooled")


@query("r10_endpoint_differences", f"with {_PLOTS}, {_LONG}, {_FEATURES} select a.plot, channel, " + ", ".join(f"round(b.{v} - a.{v}, 6) as {v}" for v in ("c", "m9", "s9", "m25")) + " from ft a join ft b using (plot, channel) where a.year = 2018 and b.year = 2024")
def r10_differences(spark, d):
    return P.endpoint_differences(P.patch_features(plots(spark, d), ["plot", "year"]), ["plot", "channel"], "year", 2018, 2024, ["c", "m9", "s9", "m25"])


@query("r10_pooled_cells", f"with {_PLOTS}, {_LONG} select plot, year, channel, (row // 8) * 8 + col // 8 as cell, round(avg(v), 6) as v from lg where channel in ({', '.join(repr(c) for c in P.BASE)}) group by all")
def r10_pooled(spark, d):
    f = P.patch_features(plots(spark, d), ["plot", "year"])
    return f.select("plot", "year", "channel", F.posexplode("pooled").alias("cell", "v")).filter("v is not null")


@query("r10_built_shares", f"with {_PLOTS} select plot, year, " + ", ".join(f"round(coalesce(sum(({_NDVI} < 0.31)::int) filter ({_inside(w)}), 0) / {w * w}.0::double, 6) as bf{w}" for w in P.BUILT_WINDOWS) + " from px group by all")
def r10_built(spark, d):
    return P.built_shares(plots(spark, d), ["plot", "year"])


@query("r11_presence", f"with {_PLOTS} select plot, (count(distinct year) filter (row = 31 and col = 31 and blue is not null and green is not null and red is not null and nir is not null) = 2)::int::double as present from px group by 1")
def r11(spark, d):
    return P.presence(plots(spark, d), "plot", "year", [2018, 2024])


@query("r24_aligned_bands", "with lg as (select distinct 10 + l_linenumber % 3 as code, 'class ' || (l_linenumber % 3) as name from lineitem), b as (select 'class ' || (l_partkey % 3) as band, l_quantity / 50 as p from lineitem) select code, band, count(*) as n, round(avg(p), 6) as p from b join lg on name = band group by 1, 2")
def r24_bands(spark, d):
    li = read(spark, d, "lineitem")
    legend = li.select((F.col("l_linenumber") % 3 + 10).alias("code"), F.concat(F.lit("class "), (F.col("l_linenumber") % 3).cast("string")).alias("name")).distinct()
    bands = li.select(F.concat(F.lit("class "), (F.col("l_partkey") % 3).cast("string")).alias("band"), (F.col("l_quantity") / 50).alias("p"))
    return P.aligned_bands(bands, legend).groupBy("code", "band").agg(F.count("*").alias("n"), F.avg("p").alias("p"))


@query("r24_scaled_guide", "with g as (select l_returnflag, l_extendedprice - 2000 as v, l_linenumber < 6 as valid from lineitem), q as (select quantile_cont(v, 0.02) as lo, quantile_cont(v, 0.98) as hi from g where valid and v > 0) select l_returnflag, count(*) as n, round(avg(least(greatest((v - lo) / greatest(hi - lo, 1e-6), 0), 1)), 6) as guide from g, q group by 1")
def r24_guide(spark, d):
    g = read(spark, d, "lineitem").select("l_returnflag", (F.col("l_extendedprice") - 2000).alias("v"), "l_linenumber")
    return P.scaled_guide(g, "v", F.col("l_linenumber") < 6).groupBy("l_returnflag").agg(F.count("*").alias("n"), F.avg("guide").alias("guide"))

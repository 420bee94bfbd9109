"""Classified rasters as pixel tables (map_id, row, col, code): agreement, edges, windows, segments.

Neighbours are found with windows partitioned by one row or one column of one map, so no task holds a map.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

NODATA = 255


def joined(a: DataFrame, b: DataFrame) -> DataFrame:
    """Pixels valid in both maps of one grid, with both codes."""
    x = a.filter(F.col("code") != NODATA).select("row", "col", F.col("code").alias("a"))
    return x.join(b.filter(F.col("code") != NODATA).select("row", "col", F.col("code").alias("b")), ["row", "col"])


def class_iou(pairs: DataFrame) -> DataFrame:
    """Pixels of each class in either map and both, and intersection over union (null for an empty union)."""
    n = pairs.groupBy("a", "b").agg(F.count("*").alias("n"))
    long = n.select(F.explode(F.array(F.struct(F.col("a").alias("code"), F.col("n").alias("na"), F.lit(0).cast("long").alias("nb"), F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(0).alias("both")), F.struct(F.col("b").alias("code"), F.lit(0).cast("long").alias("na"), F.col("n").alias("nb"), F.lit(0).cast("long").alias("both")))).alias("e")).select("e.*")
    s = long.groupBy("code").agg(F.sum("na").alias("n_a"), F.sum("nb").alias("n_b"), F.sum("both").alias("both"))
    union = F.col("n_a") + F.col("n_b") - F.col("both")
    return s.withColumn("iou", F.when(union > 0, F.col("both") / union))


def edges(px: DataFrame) -> DataFrame:
    """Each pixel with whether its right or lower neighbour, or the one it is that neighbour of, differs (both valid)."""
    out = px.filter(F.col("code") != NODATA)
    flags = []
    for line, along in (("row", "col"), ("col", "row")):
        w = Window.partitionBy("map_id", line).orderBy(along)
        for i, (step, neighbour) in enumerate(((1, F.lead), (-1, F.lag))):
            flag = f"{along}{i}_"
            out = out.withColumn(flag, F.coalesce((neighbour(along).over(w) == F.col(along) + step) & (neighbour("code").over(w) != F.col("code")), F.lit(False)))
            flags.append(flag)
    edge = F.col(flags[0])
    for f in flags[1:]:
        edge = edge | F.col(f)
    return out.withColumn("edge", edge).drop(*flags)


def box(px: DataFrame, value: Column, radius: int, name: str) -> DataFrame:
    """The mean of value over the (2r+1)^2 window, of the pixels that are there.

    Each pixel first adds to the 2r + 1 rows that reach it (combined map-side), then sums run along each row by ranges of
    columns, so gaps in the table stay gaps.
    """
    v = px.select("map_id", F.explode(F.sequence(F.col("row") - radius, F.col("row") + radius)).alias("row"), "col", value.cast("double").alias("v_"))
    sums = v.groupBy("map_id", "row", "col").agg(F.sum("v_").alias("s_"), F.count("v_").alias("n_"))
    along = Window.partitionBy("map_id", "row").orderBy("col").rangeBetween(-radius, radius)
    means = sums.withColumn(name, F.sum("s_").over(along) / F.sum("n_").over(along)).select("map_id", "row", "col", name)
    return px.join(means, ["map_id", "row", "col"])


def high_frequency_ratio(px: DataFrame, codes: list[int]) -> DataFrame:
    """Per map: the share of one-hot variance that a 3 x 3 mean takes away, averaged over classes that vary; a map where none
    does has no row."""
    out = None
    for c in codes:
        hot = (F.col("code") == c).cast("double")
        s = box(px.filter(F.col("code") != NODATA), hot, 1, "mean_").groupBy("map_id").agg(F.var_pop(hot).alias("v"), F.var_pop("mean_").alias("m")).withColumn("ratio", F.when(F.col("v") > 0, 1 - F.col("m") / F.col("v")))
        out = s if out is None else out.unionByName(s)
    return out.filter("ratio is not null").groupBy("map_id").agg(F.avg("ratio").alias("high_frequency"))


def segments(px: DataFrame) -> DataFrame:
    """(map_id, code, segment, size) of 4-connected components of equal codes, by the distributed union of neighbour pairs,
    repeated until nothing changes."""
    from .materialise import kept

    ident = F.col("row") * (1 << 32) + F.col("col")
    p = px.filter(F.col("code") != NODATA).select("map_id", "row", "col", "code", ident.alias("id"))
    pairs = None
    for line, along in (("row", "col"), ("col", "row")):
        w = Window.partitionBy("map_id", line).orderBy(along)
        step = p.withColumn("next_", F.when((F.lead(along).over(w) == F.col(along) + 1) & (F.lead("code").over(w) == F.col("code")), F.lead("id").over(w))).filter("next_ is not null").select("map_id", F.col("next_").alias("a"), F.col("id").alias("b"))
        pairs = step if pairs is None else pairs.union(step)
    now, last = kept(pairs), None
    while True:
        both = now.union(now.select("map_id", F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("map_id", "a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        large = both.join(low, ["map_id", "a"]).filter("b > a").select("map_id", F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("map_id", "a").agg(F.min("b").alias("m"))
        small = large.join(least, ["map_id", "a"]).select("map_id", F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("map_id", "e.a", "e.b").filter("a > b").distinct()
        now = kept(small)
        state = now.agg(F.count("*"), F.sum(F.xxhash64("map_id", "a", "b").cast("decimal(38,0)"))).first()
        if state == last:
            break
        last = state
    root = p.join(now.select("map_id", F.col("a").alias("id"), F.col("b").alias("root")), ["map_id", "id"], "left")
    return root.groupBy("map_id", "code", F.coalesce("root", "id").alias("segment")).agg(F.count("*").alias("size"))


def delta(pairs: DataFrame) -> DataFrame:
    """Of two change masks (codes 0 and 1): stable, kept, added, removed pixels."""
    kind = F.when((F.col("a") == 0) & (F.col("b") == 0), "stable").when((F.col("a") == 1) & (F.col("b") == 1), "kept").when(F.col("b") == 1, "added").otherwise("removed")
    return pairs.groupBy(kind.alias("delta")).agg(F.count("*").alias("n"))


def dense_series(obs: DataFrame, point: str, time: str, values: list[str]) -> DataFrame:
    """Each point's observations in time order, incomplete ones dropped."""
    full = obs.dropna(subset=values)
    return full.groupBy(point).agg(F.sort_array(F.collect_list(F.struct(time, *values))).alias("series"))


def annual_composite(obs: DataFrame, point: str, year: str, values: list[str], years: list[int]) -> DataFrame:
    """Median of each value and the scene count for every point and year; empty years are null and 0."""
    c = obs.groupBy(point, year).agg(*[F.percentile(v, F.lit(0.5)).alias(v) for v in values], F.count("*").alias("scenes"))
    axis = obs.select(point).distinct().withColumn(year, F.explode(F.array(*[F.lit(y) for y in years])))
    return axis.join(c, [point, year], "left").fillna(0, ["scenes"])


def pick_seasonal(scenes: DataFrame, by: list[str], season: str, cloud: str, ident: str, per_group: int) -> DataFrame:
    """The least cloudy scene of each season first, then the least cloudy of the rest, up to per_group."""
    first = F.row_number().over(Window.partitionBy(*by, season).orderBy(cloud, ident))
    s = scenes.withColumn("again_", (first > 1).cast("int"))
    return s.withColumn("rn_", F.row_number().over(Window.partitionBy(*by).orderBy("again_", cloud, ident))).filter(F.col("rn_") <= per_group).drop("again_", "rn_")


def forward_edges(px: DataFrame) -> DataFrame:
    """Each valid pixel with whether its right and its lower neighbour are valid and differ."""
    out = px.filter(F.col("code") != NODATA)
    for name, line, along in (("right_differs", "row", "col"), ("lower_differs", "col", "row")):
        w = Window.partitionBy("map_id", line).orderBy(along)
        out = out.withColumn(name, F.coalesce((F.lead(along).over(w) == F.col(along) + 1) & (F.lead("code").over(w) != F.col("code")), F.lit(False)))
    return out

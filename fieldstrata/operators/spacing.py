"""Minimum distances between points, by grid cells no narrower than the distance."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .materialise import kept, tasks

#: Kilometres in a degree, as the distances are defined.
KM_LON, KM_LAT = 111.32, 110.57


def _column(lon: Column, band: Column, km: float) -> Column:
    """The cell along a band of latitudes: as wide as the distance where meridians are closest, one band around included."""
    step = km / KM_LAT
    far = F.least(F.greatest(F.abs((band - 1) * step), F.abs((band + 2) * step)), F.lit(90.0))
    width = F.lit(km) / (KM_LON * F.cos(F.radians(far)))
    return F.when((far >= 90) | (width >= 360), F.lit(0)).otherwise(F.floor(lon / width)).cast("long")


def celled(df: DataFrame, lon: str, lat: str, km: float) -> DataFrame:
    """df with its own cell (band_, cell_)."""
    out = df.withColumn("band_", F.floor(F.col(lat) / (km / KM_LAT)).cast("long"))
    return out.withColumn("cell_", _column(F.col(lon), F.col("band_"), km))


def around(df: DataFrame, lon: str, lat: str, km: float) -> DataFrame:
    """df once for each of the nine cells that can hold a point within the distance."""
    own = F.floor(F.col(lat) / (km / KM_LAT)).cast("long")
    out = df.withColumn("band_", F.explode(F.sequence(own - 1, own + 1))).withColumn("own_", _column(F.col(lon), F.col("band_"), km))
    return out.withColumn("cell_", F.explode(F.sequence(F.col("own_") - 1, F.col("own_") + 1))).drop("own_")


def _small(df: DataFrame, lon: str, lat: str, km: float) -> DataFrame:
    """df with cells (b_, c_) so small that any two points of one lie within km / sqrt(2)."""
    out = df.withColumn("b_", F.floor(F.col(lat) / (km / 2 / KM_LAT)).cast("long"))
    low, high = F.col("b_") * (km / 2 / KM_LAT), (F.col("b_") + 1) * (km / 2 / KM_LAT)
    near = F.least(F.when((low <= 0) & (high >= 0), F.lit(0.0)).otherwise(F.least(F.abs(low), F.abs(high))), F.lit(90.0))
    return out.withColumn("c_", F.floor(F.col(lon) / (F.lit(km / 2) / (KM_LON * F.cos(F.radians(near))))).cast("long"))


def too_close(df: DataFrame, others: DataFrame, ident: str, lon: str, lat: str, km: float) -> DataFrame:
    """The idents of df's points that lie within km of one of the others (equirectangular, at the point's own latitude).

    A point that shares a small cell with one of the others is too close without a look at their distance; only points
    of small cells without others meet the others of the nine cells around. These are dealt out by a fixed number of
    partitions, since what they take is in the pairs and not in the bytes.
    """
    p, o = df.select(ident, lon, lat), others.select(F.col(lon).alias("lon_"), F.col(lat).alias("lat_"))
    marked = _small(p, lon, lat, km).join(_small(o, "lon_", "lat_", km).select("b_", "c_").distinct().withColumn("same_", F.lit(True)), ["b_", "c_"], "left")
    dx = (F.col(lon) - F.col("lon_")) * F.cos(F.radians(lat)) * KM_LON
    dy = (F.col(lat) - F.col("lat_")) * KM_LAT
    n = tasks(df)
    apart = around(marked.filter("same_ is null").select(ident, lon, lat), lon, lat, km).repartition(n, "band_", "cell_")
    met = apart.join(celled(o, "lon_", "lat_", km).repartition(n, "band_", "cell_"), ["band_", "cell_"]).filter(dx * dx + dy * dy < km * km)
    return marked.filter("same_").select(ident).unionByName(met.select(ident)).distinct()


def spread(df: DataFrame, ident: str, score: str, lon: str, lat: str, km: float, most: int | None = None) -> DataFrame:
    """The points that a pass from the highest score down keeps (ties by ident), each at least km from all kept before.

    In rounds: points that come first among all undecided ones of their nine cells are kept, which the cells' best ranks
    tell without listing pairs; points too close to them go. Rounds end when every point is decided. With ``most``, only
    the first so many are wanted: once that many are kept, no point that ranks after them can be among the first.
    """
    first_of = lambda rows: rows if most is None else rows.orderBy(F.desc(score), ident).limit(most)
    if not (km > 0 and math.isfinite(km)):
        return first_of(df)
    left, chosen = kept(df.filter(F.col(lon).isNotNull() & F.col(lat).isNotNull()).withColumn("rank_", F.struct((-F.col(score)).alias("s"), F.col(ident).alias("i")))), None
    while not left.isEmpty():
        best = celled(left, lon, lat, km).groupBy("band_", "cell_").agg(F.min("rank_").alias("best_"))
        first = around(left.select(ident, lon, lat, "rank_"), lon, lat, km).join(best, ["band_", "cell_"]).groupBy(ident, "rank_").agg(F.min("best_").alias("best_"))
        now = kept(left.join(first.filter("best_ = rank_").select(ident), ident, "left_semi"))
        chosen = now if chosen is None else chosen.unionByName(now)
        rest = left.join(now.select(ident), ident, "left_anti")
        if most is not None:
            last = chosen.orderBy("rank_").limit(most).agg(F.count("*").alias("n_"), F.max("rank_").alias("last_"))
            rest = rest.crossJoin(F.broadcast(last)).filter((F.col("n_") < most) | (F.col("rank_") < F.col("last_"))).drop("n_", "last_")  # one row
        left = kept(rest.join(too_close(rest, now, ident, lon, lat, km), ident, "left_anti"))
    return first_of((left if chosen is None else chosen).drop("rank_"))


def spread_by_stratum(df: DataFrame, ident: str, stratum: str, score: str, lon: str, lat: str, quotas: dict[str, int], km: float) -> DataFrame:
    """Each stratum's highest scores in turn, up to its quota, at least km from all chosen before (other strata's, too).

    The selection is as small as the quotas; the quotas are a short table.
    """
    out = None
    for name, most in quotas.items():
        pool = df.filter(F.col(stratum) == name)
        if out is not None:
            pool = pool.join(too_close(pool, out, ident, lon, lat, km), ident, "left_anti")
        top = kept(spread(pool, ident, score, lon, lat, km, most))
        out = top if out is None else out.unionByName(top)
    return out

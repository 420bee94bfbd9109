"""Column functions: legends, transitions, geography, indices, posterior vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Legend values and their coarse classes (fixed values).
COARSE = {
    "nature": "Nature", "nature - forest": "Nature", "nature - other": "Nature", "nature (not cropland / artificial)": "Nature",
    "cropland": "Cropland", "artificial": "Artificial",
}
#: Second legend: both vegetation classes as one (fixed values).
MERGED = {"Nature": "Vegetation", "Cropland": "Vegetation", "Artificial": "Artificial"}


def lookup(c: Column, table: dict) -> Column:
    """The table's value, null where there is none."""
    return F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[c]


def coarsen(c: Column) -> Column:
    """Trim, lower, map; a value outside the vocabulary raises when the plan runs."""
    out = lookup(F.lower(F.trim(c)), COARSE)
    return F.when(c.isNull(), None).when(out.isNull(), F.raise_error(F.concat(F.lit("unknown class: "), c)).cast("string")).otherwise(out)


def coarse_text(c: Column) -> Column:
    return F.regexp_replace(c, r"Nature - \w+", "Nature")


def transition(before: Column, after: Column) -> Column:
    return F.concat(before, F.lit(" -> "), after)


def is_change(label: Column) -> Column:
    parts = F.split(label, " -> ")
    return (label == "other") | (F.get(parts, F.lit(0)) != F.coalesce(F.get(parts, F.lit(1)), F.get(parts, F.lit(0))))


def to_merged(label: Column) -> Column:
    parts = F.split(label, " -> ")
    return F.when(label == "other", label).otherwise(transition(lookup(parts[0], MERGED), lookup(parts[1], MERGED)))


def pool_rare(df: DataFrame, column: str, least: int) -> DataFrame:
    """Classes with fewer rows than that become 'other': counts by class joined back, not a window over whole classes."""
    n = df.groupBy(column).agg(F.count("*").alias("n_"))
    return df.join(n, column, "left").withColumn(column, F.when(F.col("n_") >= least, F.col(column)).otherwise("other")).drop("n_")


def abbreviation(name: Column) -> Column:
    """First two letters of each word."""
    return F.array_join(F.transform(F.regexp_extract_all(name, F.lit(r"(\w+)"), F.lit(1)), lambda w: F.left(w, F.lit(2))), "")


def block_id(lon: Column, lat: Column, size: float) -> Column:
    x, y = F.floor(lon / size) * size, F.floor(lat / size) * size
    return F.format_string("x%+07.1f_y%+06.1f", x, y)


def utm_epsg(lon: Column, lat: Column) -> Column:
    """Zone by longitude with the exceptions of south-west Norway and Svalbard; north 326xx, south 327xx."""
    zone = (F.floor((lon + 180) / 6) % 60 + 1).cast("int")
    zone = F.when((lat >= 56) & (lat < 64) & (lon >= 3) & (lon < 12), 32).when((lat >= 72) & (lat < 84) & (lon >= 0) & (lon < 9), 31).when((lat >= 72) & (lat < 84) & (lon >= 9) & (lon < 21), 33).when((lat >= 72) & (lat < 84) & (lon >= 21) & (lon < 33), 35).when((lat >= 72) & (lat < 84) & (lon >= 33) & (lon < 42), 37).otherwise(zone)
    return zone + F.when(lat >= 0, 32600).otherwise(32700)


def growing_season(lat: Column) -> Column:
    """(first month, last month, year offset): whole year in the tropics, June-September north, December-March south."""
    f = lambda a, b, y: F.struct(F.lit(a).alias("first"), F.lit(b).alias("last"), F.lit(y).alias("offset"))
    return F.when(F.abs(lat) < 23.5, f(1, 12, 0)).when(lat > 0, f(6, 9, 0)).otherwise(f(12, 3, -1))


def unit_sphere(lon: Column, lat: Column) -> tuple[Column, Column, Column]:
    a, b = F.radians(lon), F.radians(lat)
    return F.cos(b) * F.cos(a), F.cos(b) * F.sin(a), F.sin(b)


def normalised_difference(a: Column, b: Column) -> Column:
    return F.when(a + b != 0, F.round((a - b) / (a + b), 4))


def spectral(blue: Column, green: Column, red: Column, nir: Column, eps: float = 1e-6) -> dict[str, Column]:
    """Indices of reflectances stored as whole numbers of 1/10,000; only evi2 needs that scale."""
    r, n = red * 1e-4, nir * 1e-4
    return {
        "ndvi": (nir - red) / (nir + red + eps), "ndwi": (green - nir) / (green + nir + eps), "brightness": (blue + green + red + nir) / 4,
        "evi2": 2.5 * (n - r) / (n + 2.4 * r + 1), "grvi": (green - red) / (green + red + eps),
        "bsi": ((red + blue) - (nir + green)) / ((red + blue) + (nir + green) + eps), "ci": (red - blue) / (red + blue + eps),
    }


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def l2_normalised(a: Column) -> Column:
    n = norm(a)
    return F.when(n > 0, F.transform(a, lambda x: x.cast("double") / n)).otherwise(F.transform(a, lambda x: x.cast("double")))


def cosine_distance(a: Column, b: Column) -> Column:
    return 1 - dot(a, b) / F.greatest(norm(a) * norm(b), F.lit(1e-12))


def change_scalars(a: Column, b: Column) -> dict[str, Column]:
    d = F.zip_with(a, b, lambda x, y: y.cast("double") - x.cast("double"))
    return {
        "cosine": cosine_distance(a, b), "l2": norm(d), "l1": F.aggregate(d, F.lit(0.0), lambda s, x: s + F.abs(x)),
        "chebyshev": F.array_max(F.transform(d, lambda x: F.abs(x))), "norm_change": norm(b) - norm(a),
    }


def band_products(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))


def band_differences(a: Column, b: Column, eps: float = 1e-6) -> Column:
    return F.zip_with(a, b, lambda x, y: (y.cast("double") - x.cast("double")) / (F.abs(x.cast("double")) + F.abs(y.cast("double")) + eps))


def entropy(p: Column) -> Column:
    """Normalised by the number of classes; zero probabilities add nothing."""
    h = F.aggregate(p, F.lit(0.0), lambda s, x: s - F.when(x > 0, x * F.ln(x)).otherwise(0.0))
    return h / F.ln(F.size(p).cast("double"))


def least_confidence(p: Column) -> Column:
    return 1 - F.array_max(p)


def margin(p: Column) -> Column:
    s = F.sort_array(p, False)
    return F.get(s, F.lit(0)) - F.get(s, F.lit(1))


def argmax(p: Column) -> Column:
    """Position from 0; the first maximum wins."""
    return F.array_position(p, F.array_max(p)).cast("int") - 1


def set_size(p: Column, q: Column) -> Column:
    """Classes whose probability is at least 1 - q (q: one threshold, or an array of one per class)."""
    return F.size(F.filter(F.zip_with(p, q, lambda x, y: x >= 1 - y), lambda b: b))


def deficit_yield(counts: Column, deficit: list[float], precision: list[float], min_px: float, most: int) -> Column:
    total = sum(deficit)
    if total <= 0:
        return F.lit(0.0)
    weights = F.array(*[F.lit(d * p / total) for d, p in zip(deficit, precision, strict=True)])
    return F.aggregate(F.zip_with(counts, weights, lambda c, w: F.least(F.lit(float(most)), F.floor(c / min_px).cast("double")) * w), F.lit(0.0), lambda s, x: s + x)


def complexity(counts: Column, ignore: int | None = None) -> Column:
    """Normalised entropy of a class histogram, without one class."""
    c = F.filter(counts, lambda _, i: i != ignore) if ignore is not None else counts
    total = F.aggregate(c, F.lit(0.0), lambda s, x: s + x)
    return F.when(total > 0, entropy(F.transform(c, lambda x: x / total))).otherwise(0.0)


def blend(a: Column, b: Column, lam: float) -> Column:
    return lam * a + (1 - lam) * b


def gated_label(p: Column, change: list[bool], threshold: float) -> Column:
    """Best change class if the mass on change classes reaches the threshold, else the best stable class (position)."""
    flags = F.array(*[F.lit(float(c)) for c in change])
    mass = dot(p, flags)
    only = lambda keep: argmax(F.zip_with(p, flags, lambda x, f: F.when(f == keep, x).otherwise(-1.0)))
    return F.when(mass >= threshold, only(1.0)).otherwise(only(0.0))


def cost_argmax(p: Column, costs: list[float]) -> Column:
    return argmax(F.zip_with(p, F.array(*[F.lit(c) for c in costs]), lambda x, c: x * c))


@F.pandas_udf(T.StructType([T.StructField("epsg", T.IntegerType()), T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())]))
def utm_cell(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    """The lower left corner of the 10 m grid cell of (lon, lat) in the given UTM zone (WGS84 transverse Mercator series)."""
    a, f, k0 = 6378137.0, 1 / 298.257223563, 0.9996  # the ellipsoid and scale (fixed values)
    n = f / (2 - f)
    A = a / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240)
    e = 2 * np.sqrt(n) / (1 + n)
    for lon, lat, epsg in batches:
        lam = np.radians(lon - (6.0 * (epsg % 100) - 183))
        phi = np.radians(lat)
        t = np.sinh(np.arctanh(np.sin(phi)) - e * np.arctanh(e * np.sin(phi)))
        xi, eta = np.arctan2(t, np.cos(lam)), np.arctanh(np.sin(lam) / np.sqrt(1 + t * t))
        x = 500000 + k0 * A * (eta + sum(c * np.cos(2 * (j + 1) * xi) * np.sinh(2 * (j + 1) * eta) for j, c in enumerate(alpha)))
        y = k0 * A * (xi + sum(c * np.sin(2 * (j + 1) * xi) * np.cosh(2 * (j + 1) * eta) for j, c in enumerate(alpha)))
        y = np.where(epsg >= 32700, y + 10_000_000, y)
        yield pd.DataFrame({"epsg": epsg.astype("int32"), "x": np.floor(x / 10) * 10, "y": np.floor(y / 10) * 10})

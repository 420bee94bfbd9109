"""Training pools of states by location and year: arms, controls, external pools, export, and cleaning of labels.

A pool row has loc_id, lon, lat, block_id, year, state, kind (observed, assumed, synthetic, pseudo), source, changed and
features (an array). Plots come one row each, with a state and a feature array for each year.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.keyed import key, uniform
from ..functions.scalar import argmax, change_scalars
from .windows import exact_percentiles, loo_medoid

HEAD = ["loc_id", "lon", "lat", "block_id"]
COLUMNS = [*HEAD, "year", "state", "kind", "source", "changed", "features"]


def _rows(plots: DataFrame, years: list[int], state: Column | None, kind: str, source: str, features: Column | None = None) -> DataFrame:
    """Plots once for every year, by an explode: ``state`` (default: the year's own, from the map ``states``) and features
    (default: the year's own, from the map ``embeddings``, and only the years that it has)."""
    each = plots.withColumn("year", F.explode(F.array(*map(F.lit, years))))
    if features is None:
        each = each.filter(F.map_contains_key("embeddings", F.col("year")))
    own = F.element_at("states", F.col("year")) if state is None else state
    return each.select(*HEAD, "year", own.alias("state"), F.lit(kind).alias("kind"), F.lit(source).alias("source"), "changed", (F.element_at("embeddings", F.col("year")) if features is None else features).alias("features"))


def endpoints(plots: DataFrame, first: int, last: int, source: str = "plots") -> DataFrame:
    """Every plot in its first and last year, with the states observed there."""
    return _rows(plots, [first, last], None, "observed", source)


def stable_years(plots: DataFrame, first: int, between: list[int], source: str = "plots") -> DataFrame:
    """Unchanged plots in the years between, with the first year's state, assumed."""
    return _rows(plots.filter(~F.col("changed")), between, F.element_at("states", F.lit(first)), "assumed", source)


def year_spread(plots: DataFrame, years: list[int]) -> Column:
    """Per feature: the mean over unchanged plots of the deviation of the years around the plot's own mean, as a literal.

    One row of as many numbers as there are features comes to the driver.
    """
    long = plots.filter(~F.col("changed")).select("loc_id", F.explode(F.array(*[F.element_at("embeddings", F.lit(y)) for y in years])).alias("v"))
    each = long.select("loc_id", F.posexplode("v").alias("i", "x")).groupBy("loc_id", "i").agg(F.stddev_pop("x").alias("s"))
    found = {r.i: r.s for r in each.groupBy("i").agg(F.avg("s").alias("s")).collect()}
    return F.array(*[F.lit(float(found[i])) for i in sorted(found)])


def normal(seed: int, *ids: Column | str) -> Column:
    """A standard normal number by seed and ids (two uniform numbers, Box and Muller)."""
    a, b = uniform(seed, *ids), uniform(seed + 1, *ids)
    return F.sqrt(-2 * F.ln(1 - a)) * F.cos(b * (2 * math.pi))


def stable_copies(plots: DataFrame, first: int, between: list[int], spread: Column | None = None, seed: int = 0, source: str = "plots") -> DataFrame:
    """The control of ``stable_years``: as many rows, but each with the first year's features, to which ``spread`` adds
    normal noise of that deviation by feature."""
    base = F.element_at("embeddings", F.lit(first))
    if spread is not None:
        noisy = F.transform(base, lambda x, i: F.struct(x.alias("x"), i.alias("i")))
        base = F.transform(noisy, lambda e: e["x"] + F.get(spread, e["i"]) * normal(seed, F.col("loc_id"), F.col("year"), e["i"]))
    return _rows(plots.filter(~F.col("changed")), between, F.element_at("states", F.lit(first)), "synthetic", source, base)


def pseudo_years(plots: DataFrame, between: list[int], source: str = "plots") -> DataFrame:
    """Changed plots in the years between, without a state: a fold's first model fills it in."""
    return _rows(plots.filter("changed"), between, F.lit(None).cast("string"), "pseudo", source)


def external(pool: DataFrame, name: str, year: int) -> DataFrame:
    """Another data set's points (loc_id, lon, lat, block_id, state, features) as observed, unchanged rows of its year. The
    name goes before loc_id, so that two sets' ids stay apart."""
    return pool.select(F.concat_ws(":", F.lit(name), "loc_id").alias("loc_id"), *HEAD[1:], F.lit(year).alias("year"), "state", F.lit("observed").alias("kind"), F.lit(name).alias("source"), F.lit(False).alias("changed"), "features")


def resampled(pool: DataFrame, count: DataFrame, seed: int, inside: Column | None = None) -> DataFrame:
    """As many rows as the one-row table ``count`` (n) says, drawn with replacement from the pool's rows (``inside``).

    Row i of the result takes the row whose number, in key order, a keyed random number gives; each copy has a loc_id of
    its own and kind synthetic, so folds do not lump copies together. An empty pool fails the query.
    """
    from .windows import numbered

    rows = numbered((pool if inside is None else pool.filter(inside)).withColumn("k_", key(seed, "loc_id", "year")), [F.col("k_"), F.col("loc_id"), F.col("year")], "rn_").drop("k_")
    have = rows.agg(F.count("*").alias("have_"))
    slots = count.select(F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("slot_")).crossJoin(F.broadcast(have))  # one row
    drawn = slots.withColumn("rn_", (F.floor(uniform(seed + 1, "slot_") * F.col("have_")) + 1).cast("long"))
    found = drawn.join(rows.withColumn("there_", F.lit(True)), "rn_", "left")
    place = F.when(F.col("there_"), F.concat(F.col("loc_id").cast("string"), F.lit("#dup"), F.col("slot_").cast("string"))).otherwise(F.raise_error("no row to resample"))
    out = found.withColumn("loc_id", place).withColumn("kind", F.lit("synthetic")).drop("there_")
    return out.drop("slot_", "rn_", "have_")


def footprint_control(pool: DataFrame, footprint: DataFrame, seed: int) -> DataFrame:
    """The pool's rows in the footprint's blocks, resampled to the footprint's number of rows."""
    inside = pool.join(footprint.select("block_id").distinct(), "block_id", "left_semi").select(*pool.columns)
    return resampled(inside, footprint.agg(F.count("*").alias("n")), seed)


def state_control(pool: DataFrame, state: str, count: DataFrame, seed: int) -> DataFrame:
    """The pool's rows of one state, resampled to a number of rows (one row, n)."""
    return resampled(pool, count, seed, F.col("state") == state)


def exported(pool: DataFrame, size: int) -> DataFrame:
    """sid (source:loc_id:year), state, place, source, year, kind and one column for each feature; pseudo rows have no
    state and are left out."""
    real = pool.filter("kind <> 'pseudo'")
    return real.select(F.concat_ws(":", "source", F.col("loc_id").cast("string"), F.col("year").cast("string")).alias("sid"), "state", "lon", "lat", "block_id", "source", "year", "kind", *[F.get("features", F.lit(i)).alias(f"f{i:02d}") for i in range(size)])


def tagged(units: DataFrame, fine: str, coarse: str, by_fine: dict[int, str], by_coarse: dict[int, str], drop: list[int], quality: Column, covers: Column) -> DataFrame:
    """Units of good quality that cover the year, with the state of their class: the fine class decides where it is in its
    map, the coarse one elsewhere; units of dropped coarse classes or of neither map are left out."""
    of = lambda column, classes: F.coalesce(*[F.when(F.col(column) == k, F.lit(v)) for k, v in classes.items()], F.lit(None).cast("string"))
    kept = units.filter(quality & covers & ~F.coalesce(F.col(coarse).isin(drop), F.lit(False)))
    return kept.withColumn("state", F.coalesce(of(fine, by_fine), of(coarse, by_coarse))).filter("state is not null")


def tagged_by_second(points: DataFrame, second: DataFrame, ident: str, cls: str, states: dict[str, str], quality: Column) -> DataFrame:
    """Points of good quality whose class in a second source (ident, cls) has a state; others are left out."""
    found = points.filter(quality).join(second.select(ident, cls), ident)
    named = F.coalesce(*[F.when(F.col(cls) == k, F.lit(v)) for k, v in states.items()], F.lit(None).cast("string"))
    return found.withColumn("state", named).filter("state is not null")


def one_a_place(points: DataFrame, order: str, x: str = "lon", y: str = "lat") -> DataFrame:
    """Of the points at one place the one with the smallest ``order``."""
    from .joins import keep_first

    return keep_first(points, [x, y], order)


def with_trajectories(plots: DataFrame, years: list[int]) -> DataFrame:
    """Plots with all years' embeddings, once each (the smallest row of a loc_id), with the five change scalars of the
    first and last year and the leave-one-out medoid anomaly: its largest value, mean, and the year of the largest."""
    from .joins import keep_first

    full = plots
    for y in years:
        full = full.filter(F.element_at("embeddings", F.lit(y)).isNotNull() & ~F.exists(F.element_at("embeddings", F.lit(y)), lambda x: x.isNull() | F.isnan(x)))
    once = keep_first(full.withColumn("order_", F.xxhash64(*[F.element_at("embeddings", F.lit(y)) for y in years])), ["loc_id"], "order_").drop("order_")
    a, b = (F.element_at("embeddings", F.lit(y)) for y in (years[0], years[-1]))
    once = once.withColumns(change_scalars(a, b))
    long = once.select("loc_id", F.explode(F.array(*[F.struct(F.lit(y).alias("year"), F.element_at("embeddings", F.lit(y)).alias("v")) for y in years])).alias("e")).select("loc_id", "e.year", "e.v")
    each = loo_medoid(long, "loc_id", "year", "v").groupBy("loc_id").agg(F.max("anomaly").alias("loo_max"), F.avg("anomaly").alias("loo_mean"), F.max_by("year", F.struct(F.round("anomaly", 12), -F.col("year"))).alias("loo_year"))
    return once.join(each, "loc_id", "left")


def confident_flags(df: DataFrame, probs: list[str], truth: str, name: str = "flag") -> DataFrame:
    """df with a flag where the likeliest class is not the given one and has at least that class's mean probability on its
    own rows (1 for a class without rows), and with the likeliest class (``pred_``)."""
    own = F.get(F.array(*probs), F.col(truth))
    thr = df.agg(F.array(*[F.coalesce(F.avg(F.when(F.col(truth) == i, own)), F.lit(1.0)) for i in range(len(probs))]).alias("thr_"))
    pred = argmax(F.array(*probs))
    out = df.crossJoin(F.broadcast(thr)).withColumn("pred_", pred)  # one row
    return out.withColumn(name, (F.col("pred_") != F.col(truth)) & (F.greatest(*probs) >= F.get("thr_", F.col("pred_")))).drop("thr_")


def unsure_flags(df: DataFrame, probs: list[str], truth: str, share: float, name: str = "flag") -> DataFrame:
    """df with a flag on the share of rows whose given class has the lowest probability (linear quantile, ties included)."""
    own = F.get(F.array(*probs), F.col(truth))
    cut = exact_percentiles(df.select(own.alias("p_")), "p_", [share]).select(F.col("q0").alias("cut_"))
    return df.crossJoin(F.broadcast(cut)).withColumn(name, own <= F.col("cut_")).drop("cut_")  # one row


def pruned(flagged: DataFrame, name: str = "flag") -> DataFrame:
    """The rows that are not flagged."""
    return flagged.filter(~F.col(name)).drop(name)


def relabelled(flagged: DataFrame, truth: str, name: str = "flag") -> DataFrame:
    """All rows, flagged ones with their likeliest class as label."""
    return flagged.withColumn(truth, F.when(F.col(name), F.col("pred_")).otherwise(F.col(truth)))

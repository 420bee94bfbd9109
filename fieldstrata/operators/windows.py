"""Ranks, running values and neighbours in order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def percentile_rank(df: DataFrame, value: str, by: list[str] | None = None, name: str = "pct") -> DataFrame:
    """rank / n with average ties. Counts by value are ranked, not rows, so rows are never sorted in one task.

    The running count is over distinct values: where those are many, a range-partitioned prefix sum does the same.
    """
    by = by or []
    n = df.groupBy(*by, value).agg(F.count("*").alias("c_"))
    run = prefix_sums(n, by, value, "c_", "before_")
    total = df.groupBy(*by).agg(F.count("*").alias("t_"))
    share = (F.col("before_") + (F.col("c_") + 1) / 2.0) / F.col("t_")
    t = run.join(total, by) if by else run.crossJoin(F.broadcast(total))  # one row
    return df.join(t.select(*by, value, share.alias(name)), [*by, value], "left")


def prefix_sums(df: DataFrame, by: list[str], order: str, value: str, name: str) -> DataFrame:
    """The sum of value over all earlier rows (by, order), in two levels: within range partitions, and over their totals."""
    ranged = df.repartitionByRange(*by, order).withColumn("part_", F.spark_partition_id())
    from .materialise import kept

    ranged = kept(ranged)
    inside = Window.partitionBy("part_", *by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy("part_", *by).agg(F.sum(value).alias("s_"))
    before = Window.partitionBy(*by).orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.withColumn("o_", F.coalesce(F.sum("s_").over(before), F.lit(0))).drop("s_")
    out = ranged.withColumn("i_", F.coalesce(F.sum(value).over(inside), F.lit(0))).join(F.broadcast(offsets), ["part_", *by])  # a row for each partition and group
    return out.withColumn(name, F.col("i_") + F.col("o_")).drop("i_", "o_", "part_")


def exact_percentiles(df: DataFrame, value: str, shares: list[float]) -> DataFrame:
    """One row: n, and q0, q1, ... at the given shares (linear between neighbours), null for an empty table.

    Found from counts by value and their running sum, so no task sorts or holds all rows. Null values are left out.
    """
    counts = df.filter(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("c_"))
    run = prefix_sums(counts, [], value, "c_", "b_")
    n = run.agg(F.coalesce(F.sum("c_"), F.lit(0)).alias("n"))
    at = lambda k: F.max(F.when((F.col("b_") <= k) & (F.col("b_") + F.col("c_") > k), F.col(value)))
    aggs = []
    for i, s in enumerate(shares):
        place = (F.col("n") - 1) * s
        aggs += [at(F.floor(place)).alias(f"lo{i}"), at(F.ceil(place)).alias(f"hi{i}"), F.first(place - F.floor(place)).alias(f"w{i}")]
    found = run.crossJoin(F.broadcast(n)).agg(*aggs)  # one row
    mix = lambda i: F.col(f"lo{i}") + (F.col(f"hi{i}") - F.col(f"lo{i}")) * F.col(f"w{i}")
    return n.crossJoin(found).select("n", *[mix(i).alias(f"q{i}") for i in range(len(shares))])


def numbered(df: DataFrame, order: list, name: str = "rank") -> DataFrame:
    """1, 2, ... over all rows in that order, by a range partitioning, per-partition numbers and partition offsets."""
    from .materialise import kept

    ranged = kept(df.repartitionByRange(*order).withColumn("part_", F.spark_partition_id()))
    counts = ranged.groupBy("part_").agg(F.count("*").alias("c_"))
    offsets = counts.withColumn("o_", F.coalesce(F.sum("c_").over(Window.orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("c_")
    inside = ranged.withColumn("i_", F.row_number().over(Window.partitionBy("part_").orderBy(*order)))
    return inside.join(F.broadcast(offsets), "part_").withColumn(name, (F.col("i_") + F.col("o_")).cast("long")).drop("part_", "i_", "o_")  # a row for each partition


def rank_mean(df: DataFrame, scores: list[str], seq: str, weights: list[float] | None = None) -> DataFrame:
    """Weighted mean of ordinal ranks scaled to 0..1; ties by seq."""
    weights = weights or [1.0] * len(scores)
    n = df.agg(F.count("*").alias("n_"))
    out = df
    for i, s in enumerate(scores):
        out = numbered(out, [F.col(s), F.col(seq)], f"r{i}_")
    terms = [w * (F.col(f"r{i}_") - 1) / F.greatest(F.col("n_") - 1, F.lit(1)) for i, w in enumerate(weights)]
    return out.crossJoin(F.broadcast(n)).withColumn("rank_mean", sum(terms[1:], terms[0]) / sum(weights)).drop("n_", *[f"r{i}_" for i in range(len(scores))])  # one row


def zscore(df: DataFrame, by: str, value: str) -> DataFrame:
    """Within-class z; null where the class's deviation is 0 or undefined."""
    s = df.groupBy(by).agg(F.avg(value).alias("m_"), F.stddev_samp(value).alias("s_"))
    return df.join(s, by).withColumn("z", F.when(F.col("s_") > 0, (F.col(value) - F.col("m_")) / F.col("s_"))).drop("m_", "s_")


def segments(df: DataFrame, by: list[str], order: str, value: str) -> DataFrame:
    """A new segment where value does not exceed the one before; each row's segment and its largest value + 1."""
    w = Window.partitionBy(*by).orderBy(order)
    start = F.coalesce((F.col(value) <= F.lag(value).over(w)).cast("int"), F.lit(0))
    out = df.withColumn("start_", start).withColumn("segment", F.sum("start_").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return out.withColumn("folds", F.max(value).over(Window.partitionBy(*by, "segment")) + 1).drop("start_")


def year_spread(df: DataFrame, plot: str, dim: str, value: str) -> DataFrame:
    """Per dimension: the mean over plots of the population deviation around the plot's own mean."""
    return df.groupBy(plot, dim).agg(F.stddev_pop(value).alias("s_")).groupBy(dim).agg(F.avg("s_").alias("spread"))


def loo_medoid(df: DataFrame, plot: str, year: str, vector: str) -> DataFrame:
    """Per left-out year: the distance to the medoid of the plot's other years (ties to the lowest year).

    Pairs are formed within a plot's few years only; plots with under three years are left out.
    """
    from ..functions.scalar import cosine_distance

    a = df.select(plot, F.col(year).alias("ya"), F.col(vector).alias("va"))
    b = df.select(plot, F.col(year).alias("yb"), F.col(vector).alias("vb"))
    d = a.join(b, plot).select(plot, "ya", "yb", cosine_distance(F.col("va"), F.col("vb")).alias("d"))
    row = d.groupBy(plot, "ya").agg(F.sum("d").alias("row"), F.count("*").alias("n")).filter("n >= 3")
    cand = d.filter("ya <> yb").join(row.select(plot, "ya", "row"), [plot, "ya"])
    return cand.groupBy(plot, F.col("yb").alias(year)).agg(F.min_by("d", F.struct(F.round(F.col("row") - F.col("d"), 12), F.col("ya"))).alias("anomaly"))

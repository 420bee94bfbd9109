"""Label rounds: readings (campaign, batch, point, expert, call) cleaned, counted and compared."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY = ["campaign", "batch_id", "point_id", "expert_id"]
CANNOT = "cannot interpret"


def blank_to_null(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    t = F.trim(c)
    return F.when((t == "") | (F.lower(t) == "nan"), None).otherwise(t)


def call(c: Column | str) -> Column:
    """A call; null, blank and 'nan' read as not interpretable."""
    return F.coalesce(blank_to_null(c), F.lit(CANNOT))


def keep_last(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key in that order."""
    return df.withColumn("rn_", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("rn_ = 1").drop("rn_")


def newest(readings: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """The newest call of each key: a missing time counts as newest, ties go to the later arrival."""
    return keep_last(readings, keys or KEY, F.col("labelled_at").desc_nulls_first(), F.desc("seq"))


def first_mode(df: DataFrame, keys: list[str], value: str, seq: str) -> DataFrame:
    """The most frequent value of each key; ties go to the one seen first; nulls do not count."""
    n = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("n_"), F.min(seq).alias("s_"))
    return n.groupBy(*keys).agg(F.max_by(value, F.struct("n_", -F.col("s_"))).alias(value))


def yield_by(readings: DataFrame, by: str, classes: list[str]) -> DataFrame:
    """Of distinct points attempted, the share that got each class; classes never called are 0."""
    point = F.struct("batch_id", "point_id")
    aggs = [F.count_distinct(point).alias("attempted")]
    aggs += [F.count_distinct(F.when(F.col("transition") == c, point)).alias(f"n_{c}") for c in classes]
    out = readings.groupBy(by).agg(*aggs)
    return out.select(by, "attempted", *[(F.col(f"n_{c}") / F.col("attempted")).alias(f"rate_{c}") for c in classes])


def enrichment(yields: DataFrame, by: str, baseline: str, rate: str) -> DataFrame:
    """Rate over the baseline channel's rate (null if that is absent or 0), and whether it is at least double."""
    base = yields.agg(F.max(F.when(F.col(by) == baseline, F.col(rate))).alias("base_"))
    e = F.when(F.col("base_") > 0, F.col(rate) / F.col("base_"))
    return yields.crossJoin(F.broadcast(base)).select(by, e.alias("enrichment"), (e >= 2).alias("passes"))  # one row


def agreement_points(readings: DataFrame) -> DataFrame:
    """Points read by two or more experts: number of distinct calls and the calls."""
    g = readings.groupBy("batch_id", "point_id").agg(F.count_distinct("expert_id").alias("experts"), F.sort_array(F.collect_set(call("transition"))).alias("calls"))
    return g.filter("experts >= 2").select("batch_id", "point_id", "experts", F.size("calls").alias("n_calls"), F.array_join("calls", " | ").alias("calls"))


def agreement(readings: DataFrame) -> DataFrame:
    p = agreement_points(readings)
    return p.agg(F.count("*").alias("n"), F.sum((F.col("n_calls") == 1).cast("long")).alias("agreed"), F.avg((F.col("n_calls") == 1).cast("double")).alias("rate"))


def calibration(readings: DataFrame, reference: DataFrame) -> DataFrame:
    """Per expert: calls on calibration points and how many match the reference call."""
    j = readings.join(reference, "point_id")
    return j.groupBy("expert_id").agg(F.count("*").alias("n"), F.avg((call("transition") == call("reference")).cast("double")).alias("rate"))


def confusions(readings: DataFrame, reference: DataFrame, k: int) -> DataFrame:
    """The k commonest pairs of reference and another call."""
    j = readings.join(reference, "point_id").select(call("reference").alias("reference"), call("transition").alias("called")).filter("reference <> called")
    return j.groupBy("reference", "called").count().orderBy(F.desc("count"), "reference", "called").limit(k)


def round_one(readings: DataFrame, readers: list[str]) -> DataFrame:
    """One row per point, one column per reader, blank calls as not interpretable; unread is null."""
    return readings.groupBy("batch_id", "point_id").pivot("expert_id", readers).agg(F.max(call("transition")))


def disagreements(wide: DataFrame, a: str, b: str) -> DataFrame:
    return wide.filter(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))


def conflicting(df: DataFrame, key: str, value: str) -> DataFrame:
    """Keys with more than one distinct value."""
    return df.groupBy(key).agg(F.count_distinct(value).alias("n")).filter("n > 1")


def verdict(a: Column, b: Column, assigned: Column) -> Column:
    """Of two final calls: disputed if missing or different; then uninterpretable, resolved (two labels assigned), confirmed or corrected."""
    return (
        F.when(a.isNull() | b.isNull() | (a != b), "disputed").when(a == CANNOT, "uninterpretable")
        .when(F.size(assigned) > 1, "resolved").when(F.array_contains(assigned, a), "confirmed").otherwise("corrected")
    )


def per_point(rows: DataFrame, readers: tuple[str, str]) -> DataFrame:
    """One audit record per point: each reader's newest final call, the assigned set, the verdict and the final label."""
    pick = lambda r: F.max_by(F.when(F.col("expert_id") == r, F.col("final")), F.when(F.col("expert_id") == r, F.col("seq")))
    g = rows.groupBy("point_id").agg(pick(readers[0]).alias("final1"), pick(readers[1]).alias("final2"), F.max("assigned").alias("assigned"))
    v = verdict(F.col("final1"), F.col("final2"), F.split("assigned", r"\|"))
    return g.withColumn("verdict", v).withColumn("label", F.when(F.col("verdict") != "disputed", F.col("final1")))


def reason(blind: Column, final: Column, assigned: Column, given: Column) -> Column:
    """'' if the final call is on file ('revised' if the blind one differed), else the given reason or 'not_given'."""
    on_file = F.array_contains(assigned, final)
    return F.when(on_file & (blind != final), "revised").when(on_file, "").otherwise(F.coalesce(blank_to_null(given), F.lit("not_given")))


def cohen_kappa(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Observed and expected agreement and kappa (null where expected agreement is 1)."""
    n = pairs.groupBy(a, b).count()
    total = n.agg(F.sum("count").alias("n"), F.sum(F.when(F.col(a) == F.col(b), F.col("count")).otherwise(0)).alias("same"))
    ra, rb = n.groupBy(F.col(a).alias("c")).agg(F.sum("count").alias("na")), n.groupBy(F.col(b).alias("c")).agg(F.sum("count").alias("nb"))
    chance = ra.join(rb, "c").agg(F.sum(F.col("na") * F.col("nb")).alias("x"))
    po, pe = F.col("same") / F.col("n"), F.coalesce("x", F.lit(0)) / (F.col("n") * F.col("n"))
    return total.crossJoin(F.broadcast(chance)).select("n", po.alias("observed"), pe.alias("expected"), F.when(pe < 1, (po - pe) / (1 - pe)).alias("kappa"))  # one row


def paired_reads(readings: DataFrame, key: list[str], value: str, seq: str) -> DataFrame:
    """The two readings of each key that has exactly two, on one row."""
    g = readings.groupBy(*key).agg(F.count("*").alias("n"), F.min_by(F.coalesce(value, F.lit("")), seq).alias("first_"), F.max_by(F.coalesce(value, F.lit("")), seq).alias("second_"))
    return g.filter("n = 2").select(*key, F.nullif(F.col("first_"), F.lit("")).alias("first"), F.nullif(F.col("second_"), F.lit("")).alias("second"))


def status(readings: DataFrame) -> DataFrame:
    """Per batch: rows, distinct points, changed calls and a map of rows by expert."""
    by = readings.groupBy("batch_id", "expert_id").agg(F.count("*").alias("c"), F.sum(F.col("transition").isNotNull().cast("long")).alias("called"))
    return by.groupBy("batch_id").agg(F.sum("c").alias("n"), F.sum("called").alias("called"), F.array_join(F.sort_array(F.collect_list(F.concat_ws(":", "expert_id", F.col("c").cast("string")))), ",").alias("experts"))


def symmetric_difference(a: str, b: str) -> Column:
    """What only one of two sets holds, sorted."""
    return F.array_sort(F.array_union(F.array_except(a, b), F.array_except(b, a)))


def pool_arms(years: DataFrame, plot: str, year: str, state: str) -> DataFrame:
    """(arm, plot, year, state): each plot's first and last year, and all years of plots whose state never changes.

    Plots seen in one year only are in neither arm.
    """
    g = years.groupBy(plot).agg(F.min(year).alias("a_"), F.max(year).alias("b_"), F.min(state).alias("lo_"), F.max(state).alias("hi_"))
    rows = years.join(g.filter("a_ < b_"), plot)
    ends, stable = (F.col(year) == F.col("a_")) | (F.col(year) == F.col("b_")), F.col("lo_") == F.col("hi_")
    arms = F.array_compact(F.array(F.when(ends, "endpoints"), F.when(stable, "stable_years")))
    return rows.select(F.explode(arms).alias("arm"), plot, year, state)

"""Assembly of an audit: an expert set (disagreements, filled up by uncertainty) and a random reader set, disjoint."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keyed import key
from .sampling import top_per_group


def floored_quotas(sizes: DataFrame, by: str, size: str, total: int, floor: int) -> DataFrame:
    """(by, size, quota): ``floor`` of each stratum, or all of it, and the rest in proportion to what is left in each by
    largest remainder (the first by name of equals). A floor that does not fit the total fails the query."""
    every = Window.partitionBy()
    q = sizes.select(by, F.col(size).alias("size")).withColumn("take_", F.least("size", F.lit(floor))).withColumn("room_", F.col("size") - F.col("take_"))
    q = q.withColumn("left_", F.lit(total) - F.sum("take_").over(every))
    q = q.withColumn("left_", F.when(F.col("left_") < 0, F.raise_error(F.lit("the floors exceed the total")).cast("long")).otherwise(F.col("left_")))
    q = q.withColumn("x_", F.coalesce(F.try_divide(F.col("room_"), F.sum("room_").over(every)) * F.col("left_"), F.lit(0.0))).withColumn("f_", F.floor("x_"))
    q = q.withColumn("more_", F.col("left_") - F.sum("f_").over(every)).withColumn("o_", F.row_number().over(Window.orderBy(F.desc(F.round(F.col("x_") - F.col("f_"), 9)), by)))  # a row a stratum
    return q.select(by, "size", (F.col("take_") + F.least(F.col("f_") + (F.col("o_") <= F.col("more_")).cast("int"), "room_")).cast("long").alias("quota"))


def floored_draw(df: DataFrame, ident: str, by: str, total: int, floor: int, seed: int) -> DataFrame:
    """df's drawn rows with ``incl_prob``, the share of their stratum that is drawn: those with the smallest keys."""
    quotas = floored_quotas(df.groupBy(by).agg(F.count("*").alias("n_")), by, "n_", total, floor)
    picked = top_per_group(df.withColumn("u_", key(seed, ident)), [by], [F.col("u_"), F.col(ident)], total)
    numbered = picked.withColumn("rn_", F.row_number().over(Window.partitionBy(by).orderBy("u_", ident)))
    return numbered.join(quotas, by).filter("rn_ <= quota").withColumn("incl_prob", F.col("quota") / F.col("size")).drop("u_", "rn_", "size", "quota")


def guarded(rows: DataFrame, legend: list[str], cannot: str) -> DataFrame:
    """rows (set, id, assigned) unless an id is in both sets or twice in one, or a label on file is no transition between
    legend classes: any of these fails the query where it runs."""
    one = rows.groupBy("id").agg(F.count("*").alias("n")).agg(F.coalesce(F.max("n"), F.lit(0)).alias("most_"))
    ends = lambda a: F.split(a, " -> ", -1)
    fine = F.forall(F.split("assigned", r"\|", -1), lambda a: (a == cannot) | ((F.size(ends(a)) == 2) & F.forall(ends(a), lambda x: x.isin(legend))))
    out = rows.crossJoin(F.broadcast(one))  # one row
    out = out.withColumn("id", F.when(F.col("most_") > 1, F.raise_error(F.lit("an id is in both sets, or twice in one"))).otherwise(F.col("id")))
    return out.withColumn("assigned", F.when(F.coalesce(fine, F.lit(False)), F.col("assigned")).otherwise(F.raise_error(F.concat(F.lit("label on file is no transition: "), F.coalesce("assigned", F.lit("null")))))).drop("most_")


def audit_draw(disagreements: DataFrame, candidates: DataFrame, score: Column, stratum: str, experts: int, readers: int, floor: int, legend: list[str], cannot: str, seed: int, main_pool: str = "orig") -> DataFrame:
    """(set, id, pool, plot, stratum, assigned, incl_prob, rank): both sets in the order that readers see them.

    ``disagreements`` and ``candidates`` have pool, plot and assigned, candidates also the stratum column. The expert set
    ``sup`` is every disagreement (pool and plot once), then the candidates with the largest score (ties by key) that are
    not among them, up to ``experts`` rows; more disagreements than that fail the query. The reader set ``reg`` is
    ``floored_draw`` of the main pool's candidates that no expert has. A point's id is pool_plot, so equal plot names
    of two pools stay apart; each set's order is a keyed shuffle, which shows no stratum.
    """
    apart = disagreements.select("pool", F.col("plot").cast("string").alias("plot"), "assigned")
    pool = candidates.select("pool", F.col("plot").cast("string").alias("plot"), "assigned", score.alias("score_"), F.col(stratum).alias("stratum_t_"))
    taken = apart.agg(F.count("*").alias("taken_")).withColumn("taken_", F.when(F.col("taken_") > experts, F.raise_error(F.lit("more disagreements than places")).cast("long")).otherwise(F.col("taken_")))
    # enough rows to fill the set even if every disagreement is among them
    order = [F.desc("score_"), key(seed, "pool", "plot"), F.col("pool"), F.col("plot")]
    fill = pool.orderBy(*order).limit(experts).join(apart.select("pool", "plot"), ["pool", "plot"], "left_anti")
    fill = fill.withColumn("n_", F.row_number().over(Window.orderBy(*order))).crossJoin(F.broadcast(taken)).filter(F.col("n_") <= experts - F.col("taken_"))  # at most the set's size; one row
    sup = apart.crossJoin(F.broadcast(taken)).filter("taken_ >= 0").select("pool", "plot", "assigned", F.lit("disagreement").alias("stratum")).unionByName(fill.select("pool", "plot", "assigned", F.lit("uncertain").alias("stratum")))  # one row
    sup = sup.select(F.lit("sup").alias("set"), "pool", "plot", "stratum", "assigned", F.lit(1.0).alias("incl_prob"))
    rest = pool.filter(F.col("pool") == main_pool).join(sup.filter(F.col("pool") == main_pool).select("plot"), "plot", "left_anti")
    reg = floored_draw(rest, "plot", "stratum_t_", readers, floor, seed + 1).select(F.lit("reg").alias("set"), "pool", "plot", F.lit("random").alias("stratum"), "assigned", "incl_prob")
    named = sup.unionByName(reg).withColumn("id", F.concat_ws("_", "pool", "plot"))
    shuffled = Window.partitionBy("set").orderBy(key(seed + 2, "set", "id"), "id")  # a set is small
    return guarded(named, legend, cannot).withColumn("rank", F.row_number().over(shuffled))

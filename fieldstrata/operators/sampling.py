"""Allocation, reproducible draws, rankings and greedy selections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keyed import key, uniform


def allocate(areas: DataFrame, total: int, minimum: int, area: str = "area", name: str = "stratum") -> DataFrame:
    """Largest-remainder allocation of total in proportion to area, at least minimum each (one row per stratum)."""
    every = Window.partitionBy()
    a = areas.withColumn("share_", F.col(area) / F.sum(area).over(every)).withColumn("k_", F.count("*").over(every))
    spare = F.lit(total) - F.col("k_") * minimum
    a = a.withColumn("x_", F.when(spare >= 0, F.col("share_") * spare).otherwise(F.raise_error(F.lit("total is below the minimum")).cast("double")))
    a = a.withColumn("f_", F.floor("x_")).withColumn("left_", (spare - F.sum("f_").over(every)).cast("int"))
    a = a.withColumn("o_", F.row_number().over(Window.orderBy(F.desc(F.round(F.col("x_") - F.col("f_"), 9)), name)))
    return a.withColumn("quota", (F.col("f_") + minimum + (F.col("o_") <= F.col("left_")).cast("int")).cast("long")).drop("share_", "k_", "x_", "f_", "left_", "o_")


def allocate_cells(cells: DataFrame, quotas: DataFrame, stratum: str, cell: str, area: str) -> DataFrame:
    """Each stratum's quota over its cells by largest remainder; cells without area get none."""
    w = Window.partitionBy(stratum)
    a = cells.filter(F.col(area) > 0).join(quotas.select(stratum, "quota"), stratum)
    a = a.withColumn("x_", F.col(area) / F.sum(area).over(w) * F.col("quota")).withColumn("f_", F.floor("x_"))
    a = a.withColumn("left_", F.col("quota") - F.sum("f_").over(w)).withColumn("o_", F.row_number().over(w.orderBy(F.desc(F.round(F.col("x_") - F.col("f_"), 9)), cell)))
    return a.select(stratum, cell, (F.col("f_") + (F.col("o_") <= F.col("left_")).cast("int")).cast("long").alias("n"))


def top_per_group(df: DataFrame, by: list[str], order: list[Column], most: int | Column) -> DataFrame:
    """The first rows of each group (a group limit, applied before the shuffle where most is a number)."""
    return df.withColumn("rn_", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("rn_") <= most).drop("rn_")


def stratified_draw(df: DataFrame, by: str, quotas: DataFrame, seed: int, ident: str, cap: int) -> DataFrame:
    """quota random rows of each stratum with their inclusion probability quota / n; cap bounds every quota."""
    n = df.groupBy(by).agg(F.count("*").alias("n_")).join(quotas.select(by, "quota"), by).withColumn("k_", F.least("quota", "n_"))
    picked = top_per_group(df.withColumn("u_", key(seed, ident)), [by], [F.col("u_"), F.col(ident)], cap)
    numbered = picked.withColumn("rn_", F.row_number().over(Window.partitionBy(by).orderBy("u_", ident)))
    return numbered.join(n, by).filter("rn_ <= k_").withColumn("incl_prob", F.col("k_") / F.col("n_")).drop("u_", "rn_", "n_", "k_", "quota")


def weighted_draw(df: DataFrame, weight: str, n: int, seed: int, ident: str) -> DataFrame:
    """Without replacement, with probability by weight: the n smallest -ln(u)/w."""
    k = F.round(-F.ln(1 - uniform(seed, ident)) / F.col(weight), 9)
    return df.withColumn("key_", k).orderBy("key_", ident).limit(n).drop("key_")


def equal_area_points(df: DataFrame, ident: str, seed: int, south: float = -60.0, north: float = 84.0) -> DataFrame:
    """A point for each id: uniform longitude, latitude uniform in its sine."""
    import math

    a, b = math.sin(math.radians(south)), math.sin(math.radians(north))
    return df.withColumn("lon", uniform(seed, ident) * 360 - 180).withColumn("lat", F.degrees(F.asin(a + uniform(seed + 1, ident) * (b - a))))


def spaced(df: DataFrame, by: list[str], x: str, y: str, cell: int, seed: int, ident: str, most: int) -> DataFrame:
    """One random row of each spacing cell, then at most that many random rows a group."""
    grid = df.withColumn("cx_", F.floor(F.col(x) / cell)).withColumn("cy_", F.floor(F.col(y) / cell)).withColumn("u_", key(seed, ident))
    one = grid.groupBy(*by, "cx_", "cy_").agg(F.min_by(F.struct(*df.columns), F.struct("u_", ident)).alias("s_"), F.min("u_").alias("u_")).select("s_.*", "u_")
    return top_per_group(one, by, [F.col("u_"), F.col(ident)], most).drop("u_")


def round_robin(df: DataFrame, rank: str, readers: list[str]) -> DataFrame:
    """The reader of each rank in turn, and the next in the roster as second reader."""
    roster = F.array(*[F.lit(r) for r in readers])
    i = (F.col(rank) % len(readers)).cast("int")
    return df.withColumn("reader", F.get(roster, i)).withColumn("second", F.get(roster, ((i + 1) % len(readers)).cast("int")))


def diverse_order(df: DataFrame, cluster: str, seed: int, ident: str, budget: int) -> DataFrame:
    """Round-robin over clusters: a random order of members in each, a random order of clusters at each depth."""
    inside = top_per_group(df.withColumn("u_", key(seed, ident)), [cluster], [F.col("u_"), F.col(ident)], budget)
    depth = inside.withColumn("depth", F.row_number().over(Window.partitionBy(cluster).orderBy("u_", ident)))
    return depth.withColumn("c_", key(seed + 1, cluster)).orderBy("depth", "c_", cluster).limit(budget).drop("u_", "c_")


def k_center(df: DataFrame, ident: str, vector: str, budget: int, every: int = 16) -> DataFrame:
    """Greedy k-centre: each pick is the row farthest (Euclidean) from all earlier picks, the first from the mean.

    One job per pick, an aggregate and a broadcast of one vector; distances are kept as a table every few picks.
    """
    from ..functions.scalar import dot
    from .materialise import kept

    size = len(df.select(vector).first()[0])
    means = df.select(*[F.avg(F.col(vector)[i]).alias(f"m{i}") for i in range(size)]).first()
    now = list(means)
    picks, rows = [], df.select(ident, vector).withColumn("d_", F.lit(float("inf")))
    for i in range(budget):
        at = F.array(*[F.lit(float(x)) for x in now])
        diff = F.zip_with(F.col(vector), at, lambda a, b: a.cast("double") - b)
        far = F.round(dot(diff, diff), 12)
        if i <= 1:  # the mean seeds the first pick only
            rows = df.select(ident, vector).withColumn("d_", far)
        else:
            rows = rows.withColumn("d_", F.least("d_", far))
        if i and i % every == 0:
            rows = kept(rows)
        best = rows.agg(F.max_by(F.struct(ident, vector), F.struct("d_", -F.col(ident))).alias("b")).first()["b"]
        picks.append((best[0], i + 1))
        now = list(best[1])
    return df.sparkSession.createDataFrame(picks, f"{ident} long, pick int")


def class_balance(df: DataFrame, ident: str, counts: list[str], budget: int) -> DataFrame:
    """Greedy: each pick makes the running class histogram's entropy largest (ties to the smallest id)."""
    run, picks = [0.0] * len(counts), []
    for i in range(budget):
        cum = [F.col(c) + r for c, r in zip(counts, run, strict=True)]
        total = sum(cum[1:], cum[0])
        h = sum((-F.when(c > 0, c / total * F.ln(c / total)).otherwise(0.0) for c in cum), F.lit(0.0))
        left = df.filter(~F.col(ident).isin([p for p, _ in picks])) if picks else df
        best = left.agg(F.max_by(F.struct(ident, *counts), F.struct(F.round(h, 12), -F.col(ident))).alias("b")).first()["b"]
        if best is None:
            break
        run = [r + best[c] for r, c in zip(run, counts, strict=True)]
        picks.append((best[ident], i + 1))
    return df.sparkSession.createDataFrame(picks, f"{ident} long, pick int")


def hash_fold(ident: str, folds: int, seed: int) -> Column:
    return (key(seed, ident) % folds).cast("int")


def pack_blocks(df: DataFrame, block: str, folds: int) -> DataFrame:
    """(block, fold): largest block first into the emptiest fold. Blocks are a bounded vocabulary (their counts are collected)."""
    load, out = [0] * folds, []
    for r in df.groupBy(block).count().orderBy(F.desc("count"), block).collect():
        f = min(range(folds), key=lambda i: (load[i], i))
        load[f] += r["count"]
        out.append((r[block], f))
    return df.sparkSession.createDataFrame(out, [block, "fold"]) if out else df.select(block).limit(0).withColumn("fold", F.lit(0))


def shared_rows(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Keys on both sides: empty where two draws are disjoint, or no location leaks."""
    return a.select(*keys).distinct().join(b.select(*keys).distinct(), keys, "left_semi")

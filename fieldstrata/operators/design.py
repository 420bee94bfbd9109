"""Design-based estimation: one grouped scan gives each stratum's sufficient statistics, a small final pass the estimate.

Only ``stratum_stats`` reads rows; everything after it works on one row per stratum. Strata are a bounded vocabulary, and
the grouping is combined map-side, so a stratum with most of the rows is one partial row per task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Z95 = 1.959963984540054


def everything():
    """The window of all rows (of a table with one row per stratum)."""
    return Window.partitionBy()


def stratum_stats(df: DataFrame, y: str = "y", x: str | None = None, stratum: str = "stratum") -> DataFrame:
    """(stratum, n, my, vy[, mx, vx, cxy]): counts, means, sample variances and covariance; 0 where one row gives none."""
    aggs = [F.count("*").alias("n"), F.avg(y).alias("my"), F.coalesce(F.var_samp(y), F.lit(0.0)).alias("vy")]
    if x:
        aggs += [F.avg(x).alias("mx"), F.coalesce(F.var_samp(x), F.lit(0.0)).alias("vx"), F.coalesce(F.covar_samp(y, x), F.lit(0.0)).alias("cxy")]
    return df.groupBy(F.col(stratum).alias("stratum")).agg(*aggs)


def proxy_summary(df: DataFrame, proxy: str, stratum: str = "stratum") -> DataFrame:
    """(stratum, pn, pm, pv) of the predicted-only table: the one large scan."""
    return df.groupBy(F.col(stratum).alias("stratum")).agg(F.count("*").alias("pn"), F.avg(proxy).alias("pm"), F.coalesce(F.var_samp(proxy), F.lit(0.0)).alias("pv"))


def with_interval(df: DataFrame, z: float = Z95) -> DataFrame:
    return df.withColumn("lo", F.col("est") - z * F.col("se")).withColumn("hi", F.col("est") + z * F.col("se"))


def weighted(stats: DataFrame, areas: DataFrame) -> DataFrame:
    """Strata present on both sides, with w = area / sum of those areas."""
    return stats.join(areas, "stratum").withColumn("w", F.col("area") / F.sum("area").over(everything()))


def missing_strata(stats: DataFrame, areas: DataFrame) -> DataFrame:
    """Strata with an area but no rows."""
    return areas.join(stats, "stratum", "left_anti").select("stratum")


def complete(stats: DataFrame, areas: DataFrame) -> DataFrame:
    """stats with areas; a stratum with an area but without rows raises when the plan runs."""
    joined = areas.join(stats, "stratum", "left")
    return joined.withColumn("n", F.when(F.col("n").isNull(), F.raise_error(F.concat(F.lit("stratum without rows: "), "stratum")).cast("long")).otherwise(F.col("n"))).withColumn("w", F.col("area") / F.sum("area").over(everything()))


def fpc(n: str = "n", area: str = "area") -> Column:
    return F.greatest(F.lit(0.0), 1 - F.col(n) / F.col(area))


def stratified_prop(stats: DataFrame, areas: DataFrame) -> DataFrame:
    """est, se, lo, hi with finite population correction; strata missing on either side are left out."""
    w = weighted(stats, areas)
    return with_interval(w.agg(F.sum(F.col("w") * F.col("my")).alias("est"), F.sqrt(F.sum(F.col("w") ** 2 * F.col("vy") / F.col("n") * fpc())).alias("se")))


def olofsson_prop(stats: DataFrame, areas: DataFrame, bernoulli: bool = True) -> DataFrame:
    """Weights over all areas, sampled or not; variance p(1-p)/(n-1), or s2/n."""
    total = areas.agg(F.sum("area").alias("total"))
    w = stats.join(areas, "stratum").crossJoin(F.broadcast(total)).withColumn("w", F.col("area") / F.col("total"))  # one row
    var = F.col("my") * (1 - F.col("my")) / F.greatest(F.col("n") - 1, F.lit(1)) if bernoulli else F.col("vy") / F.col("n")
    return with_interval(w.agg(F.sum(F.col("w") * F.col("my")).alias("est"), F.sqrt(F.sum(F.col("w") ** 2 * var)).alias("se")))


def hajek_prop(df: DataFrame, y: str = "y", w: str = "w") -> DataFrame:
    """Weighted ratio with linearised variance sum r^2/(sum w)^2 n/(n-1), from five sums of one scan."""
    yy, ww = F.col(y), F.col(w)
    s = df.agg(F.count("*").alias("n"), F.sum(ww).alias("sw"), F.sum(ww * yy).alias("swy"), F.sum(ww * ww).alias("sw2"), F.sum(ww * ww * yy).alias("sw2y"), F.sum(ww * ww * yy * yy).alias("sw2y2"))
    p = F.col("swy") / F.col("sw")
    r2 = F.col("sw2y2") - 2 * p * F.col("sw2y") + p * p * F.col("sw2")
    return with_interval(s.select(p.alias("est"), F.sqrt(r2 / F.col("sw") ** 2 * F.col("n") / (F.col("n") - 1)).alias("se")))


def naive_prop(df: DataFrame, y: str = "y") -> DataFrame:
    s = df.agg(F.avg(y).alias("est"), F.count("*").alias("n"))
    return s.select("est", F.sqrt(F.col("est") * (1 - F.col("est")) / F.col("n")).alias("se"))


def optimal_lam(df: DataFrame, y: str, yhat: str, w: str) -> DataFrame:
    """Weighted cov/var in population moments, clipped to [0, 1]; 0 where the proxy is constant."""
    a, b, ww = F.col(y), F.col(yhat), F.col(w)
    s = df.agg(F.sum(ww).alias("s"), F.sum(ww * a).alias("sa"), F.sum(ww * b).alias("sb"), F.sum(ww * a * b).alias("sab"), F.sum(ww * b * b).alias("sbb"))
    cov = F.col("sab") / F.col("s") - F.col("sa") / F.col("s") * F.col("sb") / F.col("s")
    var = F.col("sbb") / F.col("s") - (F.col("sb") / F.col("s")) ** 2
    return s.select(F.when(var > 1e-15, F.greatest(F.lit(0.0), F.least(F.lit(1.0), cov / var))).otherwise(0.0).alias("lam"))


def difference_prop(df: DataFrame, population_mean: float | Column, lam: float = 1.0, y: str = "y", yhat: str = "yhat", w: str = "w") -> DataFrame:
    """lam * map mean + weighted mean of y - lam * yhat, weights normalised to mean 1; variance of the rectifier."""
    mean_w = df.agg(F.avg(w).alias("mw"))
    r = df.crossJoin(F.broadcast(mean_w)).select((F.col(w) / F.col("mw") * (F.col(y) - lam * F.col(yhat))).alias("r"))  # one row
    m = F.lit(population_mean) if isinstance(population_mean, float) else population_mean
    return with_interval(r.agg((m * lam + F.avg("r")).alias("est"), F.sqrt(F.var_samp("r") / F.count("*")).alias("se")))


def with_proxy(w: DataFrame, proxy: DataFrame) -> DataFrame:
    """w with each stratum's predicted-only summary; a stratum that has none raises when the plan runs."""
    joined = w.join(proxy, "stratum", "left")
    return joined.withColumn("pn", F.when(F.col("pn").isNull(), F.raise_error(F.concat(F.lit("stratum without predicted-only rows: "), "stratum")).cast("long")).otherwise(F.col("pn")))


def lam_stratified(stats: DataFrame, proxy: DataFrame, areas: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Variance-minimising lambda over strata, for each value of ``by`` if stats has such columns; strata of one row are
    skipped, strata without predicted-only rows add no proxy variance; constant proxies give 0."""
    w = stats.join(areas.withColumn("w", F.col("area") / F.sum("area").over(everything())), "stratum").join(proxy, ["stratum", *(c for c in by or [] if c in proxy.columns)], "left").filter("n >= 2")
    w2 = F.col("w") ** 2
    s = w.groupBy(*(by or [])).agg(F.sum(w2 * F.col("cxy") / F.col("n")).alias("num"), F.sum(w2 * (F.col("vx") / F.col("n") + F.coalesce(F.col("pv") / F.col("pn"), F.lit(0.0)))).alias("den"))
    return s.select(*(by or []), F.when(F.col("den") > 1e-15, F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("num") / F.col("den")))).otherwise(0.0).alias("lam"))


def stratified_ppi(stats: DataFrame, proxy: DataFrame, areas: DataFrame, lam: DataFrame) -> DataFrame:
    """Stratified prediction-powered proportion; lam: one row. A stratum with an area raises if it has no labels or no
    predicted-only rows. No finite population correction: labels are few against the area they stand for."""
    w = with_proxy(complete(stats, areas), proxy).crossJoin(F.broadcast(lam))  # one row
    L = F.col("lam")
    mean = F.col("my") + L * (F.col("pm") - F.col("mx"))
    var = (F.col("vy") - 2 * L * F.col("cxy") + L * L * F.col("vx")) / F.col("n") + L * L * F.col("pv") / F.col("pn")
    return with_interval(w.agg(F.first("lam").alias("lam"), F.sum(F.col("w") * mean).alias("est"), F.sqrt(F.greatest(F.lit(0.0), F.sum(F.col("w") ** 2 * var))).alias("se")))


def _covariances(df: DataFrame, columns: list[str], n: str, mean: str, cov: str) -> DataFrame:
    """Per stratum: rows n, means mean0, mean1, ... and sample covariances cov0_0, cov0_1, ... of the columns."""
    k = len(columns)
    aggs = [F.count("*").alias(n)] + [F.avg(c).alias(f"{mean}{i}") for i, c in enumerate(columns)]
    return df.groupBy("stratum").agg(*aggs, *[F.coalesce(F.covar_samp(columns[i], columns[j]), F.lit(0.0)).alias(f"{cov}{i}_{j}") for i in range(k) for j in range(i, k)])


def ppi_multinomial(labelled: DataFrame, predicted: DataFrame, areas: DataFrame, ys: list[str], xs: list[str], lams: DataFrame) -> DataFrame:
    """(k, l, p_k, p_l, cov): prediction-powered composition of classes 0, 1, ... and its covariance.

    ys and xs: truth and proxy columns of the classes; lams: rows (k, lam), one for each class. A stratum with an area raises
    without labels or without predicted-only rows.
    """
    n = len(ys)
    lam = lams.agg(*[F.max(F.when(F.col("k") == i, F.col("lam"))).alias(f"l{i}") for i in range(n)])
    rest = labelled.crossJoin(F.broadcast(lam)).select("stratum", *[(F.col(y) - F.col(f"l{i}") * F.col(x)).alias(f"r{i}") for i, (y, x) in enumerate(zip(ys, xs, strict=True))])  # one row
    stats = _covariances(rest, [f"r{i}" for i in range(n)], "n", "m", "c")
    w = with_proxy(complete(stats, areas), _covariances(predicted, xs, "pn", "pm", "pc")).crossJoin(F.broadcast(lam))  # one row
    mean = lambda i: F.col(f"m{i}") + F.col(f"l{i}") * F.col(f"pm{i}")
    both = lambda i, j: F.col(f"c{min(i, j)}_{max(i, j)}") / F.col("n") + F.col(f"l{i}") * F.col(f"l{j}") * F.col(f"pc{min(i, j)}_{max(i, j)}") / F.col("pn")
    cells = F.array(*[F.struct(F.lit(i).alias("k"), F.lit(j).alias("l"), mean(i).alias("mk"), mean(j).alias("ml"), both(i, j).alias("c")) for i in range(n) for j in range(n)])
    long = w.select("w", F.explode(cells).alias("e")).select("w", "e.*")
    return long.groupBy("k", "l").agg(F.sum(F.col("w") * F.col("mk")).alias("p_k"), F.sum(F.col("w") * F.col("ml")).alias("p_l"), F.sum(F.col("w") ** 2 * F.col("c")).alias("cov"))


def lam_classes(labelled: DataFrame, predicted: DataFrame, areas: DataFrame, ys: list[str], xs: list[str]) -> DataFrame:
    """(k, lam): the variance-minimising lambda of each class by itself."""
    pairs = F.explode(F.array(*[F.struct(F.lit(i).alias("k"), F.col(y).alias("y"), F.col(x).alias("x")) for i, (y, x) in enumerate(zip(ys, xs, strict=True))])).alias("e")
    only = F.explode(F.array(*[F.struct(F.lit(i).alias("k"), F.col(x).alias("x")) for i, x in enumerate(xs)])).alias("e")
    stats = labelled.select("stratum", pairs).select("stratum", "e.*").groupBy("stratum", "k").agg(F.count("*").alias("n"), F.coalesce(F.var_samp("x"), F.lit(0.0)).alias("vx"), F.coalesce(F.covar_samp("y", "x"), F.lit(0.0)).alias("cxy"))
    proxy = predicted.select("stratum", only).select("stratum", "e.*").groupBy("stratum", "k").agg(F.count("*").alias("pn"), F.coalesce(F.var_samp("x"), F.lit(0.0)).alias("pv"))
    return lam_stratified(stats, proxy, areas, ["k"])


def ppi_known_mean(stats: DataFrame, areas: DataFrame, lam: float, population_mean: float) -> DataFrame:
    """With the map's overall mean known: lam * mean + stratified rectifier."""
    w = weighted(stats, areas)
    var = (F.col("vy") - 2 * lam * F.col("cxy") + lam * lam * F.col("vx")) / F.col("n")
    return with_interval(w.agg((F.sum(F.col("w") * (F.col("my") - lam * F.col("mx"))) + lam * population_mean).alias("est"), F.sqrt(F.sum(F.col("w") ** 2 * var)).alias("se")))


def predicted_area(proxy: DataFrame, areas: DataFrame) -> DataFrame:
    w = proxy.join(areas, "stratum").withColumn("w", F.col("area") / F.sum("area").over(everything()))
    return w.agg(F.sum(F.col("w") * F.col("pm")).alias("est"), F.sum(F.col("area") * F.col("pm")).alias("area"))


def multinomial(df: DataFrame, areas: DataFrame, columns: list[str], stratum: str = "stratum") -> DataFrame:
    """(k, l, p_k, p_l, cov): stratified composition and its covariance, one grouped scan with K(K+1)/2 covariances."""
    n = len(columns)
    aggs = [F.count("*").alias("n")] + [F.avg(c).alias(f"m{i}") for i, c in enumerate(columns)]
    aggs += [F.coalesce(F.covar_samp(columns[i], columns[j]), F.lit(0.0)).alias(f"c{i}_{j}") for i in range(n) for j in range(i, n)]
    w = weighted(df.groupBy(F.col(stratum).alias("stratum")).agg(*aggs), areas)
    cells = F.array(*[F.struct(F.lit(i).alias("k"), F.lit(j).alias("l"), F.col(f"m{i}").alias("mk"), F.col(f"m{j}").alias("ml"), F.col(f"c{min(i, j)}_{max(i, j)}").alias("c")) for i in range(n) for j in range(n)])
    long = w.select("w", "n", "area", F.explode(cells).alias("e")).select("w", "n", "area", "e.*")
    return long.groupBy("k", "l").agg(F.sum(F.col("w") * F.col("mk")).alias("p_k"), F.sum(F.col("w") * F.col("ml")).alias("p_l"), F.sum(F.col("w") ** 2 * F.col("c") / F.col("n") * fpc()).alias("cov"))


def contrast(composition: DataFrame, c: dict[int, float]) -> DataFrame:
    """c'p and its standard error from the long composition; c is a short vector."""
    pairs = F.create_map(*[x for k, v in c.items() for x in (F.lit(k), F.lit(float(v)))])
    ck, cl = F.coalesce(pairs[F.col("k")], F.lit(0.0)), F.coalesce(pairs[F.col("l")], F.lit(0.0))
    return with_interval(composition.agg(F.sum(F.when(F.col("k") == F.col("l"), ck * F.col("p_k")).otherwise(0.0)).alias("est"), F.sqrt(F.greatest(F.lit(0.0), F.sum(ck * cl * F.col("cov")))).alias("se")))


def share(composition: DataFrame, num: list[int], den: list[int]) -> DataFrame:
    """sum of num over sum of den with a delta-method interval; a denominator that is not positive raises."""
    in_num = lambda c: F.when(F.col(c).isin(num), 1.0).otherwise(0.0)
    in_den = lambda c: F.when(F.col(c).isin(den), 1.0).otherwise(0.0)
    diag = F.when(F.col("k") == F.col("l"), F.col("p_k")).otherwise(0.0)
    s = composition.agg(F.sum(in_num("k") * diag).alias("a"), F.sum(in_den("k") * diag).alias("b"), F.sum(in_num("k") * in_num("l") * F.col("cov")).alias("vaa"), F.sum(in_num("k") * in_den("l") * F.col("cov")).alias("vab"), F.sum(in_den("k") * in_den("l") * F.col("cov")).alias("vbb"))
    r = F.col("a") / F.col("b")
    est = F.when(F.col("b") > 0, r).otherwise(F.raise_error(F.lit("denominator is not positive")).cast("double"))
    return with_interval(s.select(est.alias("est"), F.sqrt(F.greatest(F.lit(0.0), F.col("vaa") - 2 * r * F.col("vab") + r * r * F.col("vbb"))) .alias("sn"), "b").select("est", (F.col("sn") / F.col("b")).alias("se")))


def stratified_ratio(stats: DataFrame, areas: DataFrame) -> DataFrame:
    """Combined ratio sum A my / sum A mx with linearised variance; a stratum without rows or a denominator that is not
    positive raises."""
    w = complete(stats, areas)
    t = w.agg(F.sum(F.col("area") * F.col("my")).alias("Y"), F.sum(F.col("area") * F.col("mx")).alias("X"))
    t = t.withColumn("X", F.when(F.col("X") > 0, F.col("X")).otherwise(F.raise_error(F.lit("denominator is not positive")).cast("double")))
    R = F.col("Y") / F.col("X")
    v = F.col("area") ** 2 * (F.col("vy") + R * R * F.col("vx") - 2 * R * F.col("cxy")) / F.col("n")
    return with_interval(w.crossJoin(F.broadcast(t)).groupBy("Y", "X").agg(F.sum(v).alias("v")).select(R.alias("est"), (F.sqrt(F.greatest(F.lit(0.0), F.col("v"))) / F.col("X")).alias("se")))  # one row


def variance_decomposition(stats: DataFrame, proxy: DataFrame, areas: DataFrame, lam: DataFrame) -> DataFrame:
    """Per stratum: what labels and the predicted-only sample add to the variance, shares (null if the total is 0) and
    running share. A stratum with an area raises without labels; without predicted-only rows it adds no proxy variance."""
    w = complete(stats, areas).join(proxy, "stratum", "left").crossJoin(F.broadcast(lam))  # one row
    L = F.col("lam")
    lab = F.col("w") ** 2 * (F.col("vy") - 2 * L * F.col("cxy") + L * L * F.col("vx")) / F.col("n")
    pred = F.coalesce(F.col("w") ** 2 * L * L * F.col("pv") / F.col("pn"), F.lit(0.0))
    t = w.select("stratum", lab.alias("label_var"), pred.alias("predicted_var"))
    total = F.col("label_var") + F.col("predicted_var")
    t = t.withColumn("label_share", F.try_divide("label_var", F.sum("label_var").over(everything()))).withColumn("total_share", F.try_divide(total, F.sum(total).over(everything())))
    run = Window.orderBy(F.desc("label_var"), "stratum").rowsBetween(Window.unboundedPreceding, 0)
    return t.withColumn("cum_share", F.sum("label_share").over(run)).withColumn("rank", F.row_number().over(Window.orderBy(F.desc("label_var"), "stratum")))


def design_weights(df: DataFrame, areas: DataFrame) -> DataFrame:
    """n_h range and spread of w = area / n."""
    w = df.groupBy("stratum").agg(F.count("*").alias("n")).join(areas, "stratum").withColumn("w", F.col("area") / F.col("n"))
    return w.agg(F.min("n").alias("min_n"), F.max("n").alias("max_n"), F.min("w").alias("min_w"), F.max("w").alias("max_w"), (F.max("w") / F.min("w")).alias("spread"))


def transition_matrix(df: DataFrame, areas: DataFrame, before: str, after: str) -> DataFrame:
    """Unweighted and design-weighted share of every off-diagonal transition seen."""
    n = df.groupBy("stratum").agg(F.count("*").alias("n"))
    by = df.filter(F.col(before) != F.col(after)).groupBy(before, after, "stratum").agg(F.count("*").alias("c"))
    total = n.join(areas, "stratum").agg(F.sum("n").alias("tn"), F.sum("area").alias("ta"))
    j = by.join(n, "stratum").join(areas, "stratum").crossJoin(F.broadcast(total))  # one row
    return j.groupBy(before, after).agg((F.sum("c") / F.first("tn")).alias("raw_share"), F.sum(F.col("area") / F.col("ta") * F.col("c") / F.col("n")).alias("weighted_share"))


def composition(counts: DataFrame, unit: str, cls: str, px: str, classes: DataFrame) -> DataFrame:
    """Single-stage ratio composition over patches, missing classes as 0: share, between-patch se, effective n, patches present."""
    units = counts.groupBy(unit).agg(F.sum(px).alias("total"))
    dense = units.crossJoin(F.broadcast(classes)).join(counts.select(unit, cls, px), [unit, cls], "left").fillna(0, [px])  # classes: a short list
    t = units.agg(F.sum("total").alias("T"), F.count("*").alias("m"))
    p = dense.groupBy(cls).agg(F.sum(px).alias("sp"), F.sum(F.col(px) * F.col(px)).alias("spp"), F.sum(F.col(px) * F.col("total")).alias("spt"), F.sum(F.col("total") * F.col("total")).alias("stt"), F.sum(F.when(F.col(px) > 0, 1).otherwise(0)).alias("present")).crossJoin(F.broadcast(t))  # one row
    r = F.col("sp") / F.col("T")
    var = (F.col("spp") - 2 * r * F.col("spt") + r * r * F.col("stt")) / F.col("T") ** 2 * F.col("m") / (F.col("m") - 1)
    out = p.select(cls, r.alias("share"), F.sqrt(F.greatest(F.lit(0.0), var)).alias("se"), "present", F.col("m").alias("usable"))
    return out.withColumn("n_eff", F.when(F.col("se") > 0, F.col("share") * (1 - F.col("share")) / F.col("se") ** 2)).withColumn("lo", F.greatest(F.lit(0.0), F.col("share") - Z95 * F.col("se")))


def patch_yield(counts: DataFrame, unit: str, cls: str, px: str, min_px: int, max_points: int, patches: DataFrame, classes: DataFrame) -> DataFrame:
    """Mean and se over patches of min(max_points, floor(px / min_px)) per class."""
    dense = patches.select(unit).distinct().crossJoin(F.broadcast(classes)).join(counts, [unit, cls], "left").fillna(0, [px])  # classes: a short list
    pts = F.least(F.lit(max_points), F.floor(F.col(px) / min_px)).cast("double")
    return dense.groupBy(cls).agg(F.avg(pts).alias("mean_points"), (F.stddev_samp(pts) / F.sqrt(F.count("*"))).alias("se"))


def sizing(yields: DataFrame, need: float) -> DataFrame:
    """Patches needed for a number of points, and an upper bound from the yield's lower limit; infinite when unbounded."""
    inf = F.lit(float("inf"))
    low = F.col("mean_points") - Z95 * F.col("se")
    return yields.withColumn("patches", F.when(F.col("mean_points") > 0, F.ceil(need / F.col("mean_points")).cast("double")).otherwise(inf)).withColumn("upper", F.when(low > 0, F.ceil(need / low).cast("double")).otherwise(inf))


def map_efficiency(df: DataFrame, map_stratum: str, y: str) -> DataFrame:
    """Simple-random over stratified standard deviation: sqrt(p(1-p)) / sum W sqrt(p_h(1-p_h)); infinite for a pure map."""
    h = df.groupBy(map_stratum).agg(F.count("*").alias("n"), F.avg(y).alias("p"), F.sum(y).alias("s"))
    t = h.agg(F.sum("n").alias("N"), F.sum("s").alias("S"), F.sum(F.col("n") * F.sqrt(F.col("p") * (1 - F.col("p")))).alias("t"))
    p = F.col("S") / F.col("N")
    strat = F.col("t") / F.col("N")
    return t.select(F.sqrt(p * (1 - p)).alias("srs"), strat.alias("stratified"), F.when(strat > 0, F.sqrt(p * (1 - p)) / strat).otherwise(F.lit(float("inf"))).alias("efficiency"))


def ht_error_rate(df: DataFrame, error: str, prob: str, by: list[str] | None = None) -> DataFrame:
    """Horvitz-Thompson ratio sum e/pi over sum 1/pi."""
    return df.groupBy(*(by or [])).agg((F.sum(F.col(error) / F.col(prob)) / F.sum(1 / F.col(prob))).alias("rate"))


def wilson(k: Column, n: Column, z: float = Z95) -> tuple[Column, Column]:
    """Score interval, clipped to [0, 1]; (0, 0) for n = 0."""
    p, z2 = k / n, z * z
    mid, half = (p + z2 / (2 * n)) / (1 + z2 / n), z * F.sqrt(p * (1 - p) / n + z2 / (4 * n * n)) / (1 + z2 / n)
    return F.when(n > 0, F.greatest(F.lit(0.0), mid - half)).otherwise(0.0), F.when(n > 0, F.least(F.lit(1.0), mid + half)).otherwise(0.0)


def bootstrap_draws(df: DataFrame, stratum: str, key_seed: int, draws: int, values: list[str], order: list[str]) -> DataFrame:
    """(draw, stratum, values): n_h rows of each stratum with replacement, in each draw.

    Rows are numbered within strata; slot i of a draw takes the row whose number a keyed hash of (seed, draw, stratum, i)
    gives, so draws do not depend on partitioning. Meant for labelled samples (thousands of rows): rows times draws.
    """
    from ..functions.keyed import uniform

    numbered = df.withColumn("rn", F.row_number().over(Window.partitionBy(stratum).orderBy(*order)))
    n = df.groupBy(stratum).agg(F.count("*").alias("n"))
    slots = n.select(stratum, "n", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))).alias("slot"), F.lit(draws).alias("d")).select(stratum, "n", "slot", F.explode(F.sequence(F.lit(1), F.col("d"))).alias("draw"))
    picked = slots.withColumn("rn", (F.floor(uniform(key_seed, "draw", stratum, "slot") * F.col("n")) + 1).cast("int"))
    return picked.join(numbered.select(stratum, "rn", *values), [stratum, "rn"]).select("draw", stratum, *values)


def ppi_draws(by: DataFrame, proxy: DataFrame, areas: DataFrame) -> DataFrame:
    """(draw, lam, est): the prediction-powered estimate of each draw, lambda tuned anew in each.

    by: n, my, mx, vx, cxy of each draw and stratum. The predicted-only side is every unlabelled row and keeps its means.
    """
    lam = lam_stratified(by, proxy, areas, ["draw"])
    w = areas.withColumn("w", F.col("area") / F.sum("area").over(everything()))
    all_ = by.join(w, "stratum").join(proxy, "stratum").join(lam, "draw")
    return all_.groupBy("draw").agg(F.first("lam").alias("lam"), F.sum(F.col("w") * (F.col("my") + F.col("lam") * (F.col("pm") - F.col("mx")))).alias("est"))


def bootstrap_summary(draws: DataFrame, value: str, point: float | None = None) -> DataFrame:
    """Percentile interval (linear), standard error and, given a point estimate, bias."""
    out = draws.agg(F.count("*").alias("draws"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("se"), F.percentile(value, F.lit(0.025)).alias("lo"), F.percentile(value, F.lit(0.5)).alias("median"), F.percentile(value, F.lit(0.975)).alias("hi"))
    return out if point is None else out.withColumn("bias", F.col("mean") - point)


def bootstrap_interval(df: DataFrame, stratum: str, areas: DataFrame, value: str, seed: int, draws: int, order: list[str], level: float = 0.95) -> DataFrame:
    """One row: draws, est (the stratified proportion), lo and hi (its percentile interval over stratified resamples)."""
    w = areas.withColumn("w_", F.col("area") / F.sum("area").over(everything())).select(stratum, "w_")  # a row a stratum
    weighted = lambda means, by: means.join(w, stratum).groupBy(*by).agg(F.sum(F.col("w_") * F.col("m_")).alias("est"))
    each = weighted(bootstrap_draws(df, stratum, seed, draws, [value], order).groupBy("draw", stratum).agg(F.avg(value).alias("m_")), ["draw"])
    tail = (1 - level) / 2
    bounds = each.agg(F.count("*").alias("draws"), F.percentile("est", F.lit(tail)).alias("lo"), F.percentile("est", F.lit(1 - tail)).alias("hi"))  # a row a draw
    return bounds.crossJoin(weighted(df.groupBy(stratum).agg(F.avg(value).alias("m_")), [])).select("draws", "est", "lo", "hi")  # one row each


def composition_report(composition: DataFrame, a: int, b: int) -> DataFrame:
    """(item, est, se): areas of two classes, their shares of both together, and the shares' difference.

    The shares add up to 1, so the difference has twice the standard error of either.
    """
    one, two = (share(composition, [k], [a, b]).select("est", "se") for k in (a, b))
    area = composition.filter(F.col("k").isin(a, b) & (F.col("k") == F.col("l"))).select(F.concat(F.lit("area_"), "k").alias("item"), F.col("p_k").alias("est"), F.sqrt(F.greatest(F.lit(0.0), "cov")).alias("se"))
    named = [s.select(F.lit(f"share_{k}").alias("item"), "est", "se") for k, s in ((a, one), (b, two))]
    difference = one.crossJoin(F.broadcast(two.select(F.col("est").alias("other")))).select(F.lit(f"share_{a}_minus_{b}").alias("item"), (F.col("est") - F.col("other")).alias("est"), (2 * F.col("se")).alias("se"))  # one row each
    return area.unionByName(named[0]).unionByName(named[1]).unionByName(difference)


def cumulative_share(df: DataFrame, value: str, ident: str) -> DataFrame:
    """Each row's share of the total and the share of it and all larger ones; for tables of one row a stratum."""
    down = Window.orderBy(F.desc(value), ident).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    total = F.sum(value).over(everything())
    return df.withColumn("share", F.try_divide(value, total)).withColumn("cumulative", F.try_divide(F.sum(value).over(down), total))

"""Queries of the design-based estimators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import design as D
from .registry import query, rounded
from .roles import POP, areas, labelled, population, predicted

_CI = "est, se, est - 1.959963984540054 * se as lo, est + 1.959963984540054 * se as hi"


def _ci(inner: str, more: str = "") -> str:
    return f"with {POP}, t as ({inner}) select {more}round(est, 6) as est, round(se, 6) as se, round(est - 1.959963984540054 * se, 6) as lo, round(est + 1.959963984540054 * se, 6) as hi from t"


def _stats(spark, d, x="yhat"):
    return D.stratum_stats(labelled(spark, d), "y", x)


@query("a0_stratum_stats", f"with {POP} select stratum, n, round(my, 6) as my, round(vy, 6) as vy, round(mx, 6) as mx, round(vx, 6) as vx, round(cxy, 6) as cxy from (select stratum, count(*) as n, avg(y) as my, var_samp(y) as vy, avg(yhat) as mx, var_samp(yhat) as vx, covar_samp(y, yhat) as cxy from pop group by 1)")
def a0(spark, d):
    return D.stratum_stats(population(spark, d), "y", "yhat")


@query("a1_stratified_prop", _ci("select sum(w * my) as est, sqrt(sum(w * w * vy / n * greatest(0, 1 - n / area))) as se from w"))
def a1(spark, d):
    return D.stratified_prop(_stats(spark, d), areas(spark, d))


@query("a2_stratified_bernoulli", _ci("select sum(w * my) as est, sqrt(sum(w * w * my * (1 - my) / (n - 1))) as se from (select w.*, area / (select sum(area) from areas) as w2 from w)"))
def a2(spark, d):
    return D.olofsson_prop(_stats(spark, d), areas(spark, d))


@query("a3_stratified_no_fpc", _ci("select sum(w * my) as est, sqrt(sum(w * w * vy / n)) as se from w"))
def a3(spark, d):
    return D.olofsson_prop(_stats(spark, d), areas(spark, d), bernoulli=False)


def _with_w(spark, d):
    lab = labelled(spark, d)
    n = lab.groupBy("stratum").agg(F.count("*").alias("n"))
    return lab.join(n.join(areas(spark, d), "stratum").select("stratum", (F.col("area") / F.col("n")).alias("w")), "stratum")


_LW = "lw as (select labelled.*, area / n as w from labelled join st using (stratum) join areas using (stratum))"


@query("a4_hajek", f"with {POP}, {_LW}, p as (select sum(w * y) / sum(w) as est from lw), t as (select any_value(est) as est, sqrt(sum(w * w * (y - est) * (y - est)) / (sum(w) * sum(w)) * count(*) / (count(*) - 1)) as se from lw, p) select round(est, 6) as est, round(se, 6) as se, round(est - 1.959963984540054 * se, 6) as lo, round(est + 1.959963984540054 * se, 6) as hi from t")
def a4(spark, d):
    return D.hajek_prop(_with_w(spark, d))


@query("a5_naive", f"with {POP} select round(avg(y), 6) as est, round(sqrt(avg(y) * (1 - avg(y)) / count(*)), 6) as se from labelled")
def a5(spark, d):
    return D.naive_prop(labelled(spark, d))


@query("a6_difference", f"with {POP}, {_LW}, t as (select 0.5 + avg(r) as est, sqrt(var_samp(r) / count(*)) as se from (select w / avg(w) over () * (y - yhat) as r from lw)) select round(est, 6) as est, round(se, 6) as se, round(est - 1.959963984540054 * se, 6) as lo, round(est + 1.959963984540054 * se, 6) as hi from t")
def a6(spark, d):
    return D.difference_prop(_with_w(spark, d), 0.5)


@query("a7_optimal_lam", f"with {POP}, {_LW} select round(greatest(0, least(1, (sum(w * y * score) / sum(w) - sum(w * y) / sum(w) * sum(w * score) / sum(w)) / (sum(w * score * score) / sum(w) - (sum(w * score) / sum(w)) ** 2))), 6) as lam from lw")
def a7(spark, d):
    return D.optimal_lam(_with_w(spark, d), "y", "score", "w")


_LAM = "lam as (select greatest(0, least(1, sum(w * w * cxy / n) / sum(w * w * (vx / n + pv / pn)))) as lam from {w} join {p} using (stratum))"
_PPI = "select any_value(lam) as lam, sum(w * (my + lam * (pm - mx))) as est, sqrt(sum(w * w * ((vy - 2 * lam * cxy + lam * lam * vx) / n + lam * lam * pv / pn))) as se from {w} join {p} using (stratum), lam"


def _ppi_sql(w: str, p: str, lam: str | None = None) -> str:
    return f"with {POP}, {lam or _LAM.format(w=w, p=p)}, t as ({_PPI.format(w=w, p=p)}) select round(lam, 6) as lam, round(est, 6) as est, round(se, 6) as se, round(est - 1.959963984540054 * se, 6) as lo, round(est + 1.959963984540054 * se, 6) as hi from t"


def _ppi(spark, d, x, fixed=None):
    stats, proxy, area = _stats(spark, d, x), D.proxy_summary(predicted(spark, d), x), areas(spark, d)
    lam = D.lam_stratified(stats, proxy, area) if fixed is None else spark.range(1).select(F.lit(fixed).alias("lam"))
    return D.stratified_ppi(stats, proxy, area, lam)


@query("a8_ppi_tuned", _ppi_sql("w", "px"))
def a8(spark, d):
    return _ppi(spark, d, "yhat")


@query("a8_ppi_tuned_score", _ppi_sql("ws", "ps"))
def a8s(spark, d):
    return _ppi(spark, d, "score")


@query("a8_ppi_fixed", _ppi_sql("w", "px", "lam as (select 1.0::double as lam)"))
def a8f(spark, d):
    return _ppi(spark, d, "yhat", 1.0)


@query("a9_lam_stratified", f"with {POP}, {_LAM.format(w='ws', p='ps')} select round(lam, 6) as lam from lam")
def a9(spark, d):
    return D.lam_stratified(_stats(spark, d, "score"), D.proxy_summary(predicted(spark, d), "score"), areas(spark, d))


@query("a10_ppi_known_mean", _ci("select sum(w * (my - 0.4 * mx)) + 0.4 * 0.6 as est, sqrt(sum(w * w * (vy - 0.8 * cxy + 0.16 * vx) / n)) as se from w"))
def a10(spark, d):
    return D.ppi_known_mean(_stats(spark, d), areas(spark, d), 0.4, 0.6)


@query("a11_proxy_summary", f"with {POP} select stratum, count(*) as pn, round(avg(score), 6) as pm, round(coalesce(var_samp(score), 0), 6) as pv from pop group by 1")
def a11(spark, d):
    return D.proxy_summary(population(spark, d), "score")


@query("a12_predicted_area", f"with {POP} select round(sum(area * pm) / sum(area), 6) as est, round(sum(area * pm), 6) as area from ps join areas using (stratum)")
def a12(spark, d):
    return D.predicted_area(D.proxy_summary(predicted(spark, d), "score"), areas(spark, d))


def _composition(spark, d):
    lab = labelled(spark, d)
    for i, c in enumerate(("Nature", "Cropland", "Artificial")):
        lab = lab.withColumn(f"c{i}", (F.col("after") == c).cast("double"))
    return D.multinomial(lab, areas(spark, d), ["c0", "c1", "c2"])


_LONG = "cl as (select stratum, id, k as c, (case when k = 0 then after = 'Nature' when k = 1 then after = 'Cropland' else after = 'Artificial' end)::double as v from labelled, (select unnest([0, 1, 2]) as k)), pr as (select a.stratum, a.c as k, b.c as l, avg(a.v) as mk, avg(b.v) as ml, covar_samp(a.v, b.v) as c, count(*) as n from cl a join cl b using (stratum, id) group by 1, 2, 3), comp as (select k, l, sum(w * mk) as p_k, sum(w * ml) as p_l, sum(w * w * pr.c / pr.n * greatest(0, 1 - pr.n / area)) as cov from pr join w using (stratum) group by 1, 2)".replace("id, k as c", "id, kk.k as c").replace("case when k = 0", "case when kk.k = 0").replace("when k = 1", "when kk.k = 1").replace("as k) )", "as k) kk)").replace("(select unnest([0, 1, 2]) as k)),", "(select unnest([0, 1, 2]) as k) kk),")


@query("a13_multinomial", f"with {POP}, {_LONG} select k::bigint as k, l::bigint as l, round(p_k, 6) as p_k, round(p_l, 6) as p_l, round(cov, 6) + 0.0 as cov from comp")
def a13(spark, d):
    return _composition(spark, d)


_CLASSES = ("Nature", "Cropland", "Artificial")


def _one_hot(df):
    return df.select("stratum", *[(F.col(c) == v).cast("double").alias(f"{n}{i}") for c, n in (("after", "y"), ("before", "x")) for i, v in enumerate(_CLASSES)])


_KS = "(values (0, 'Nature'), (1, 'Cropland'), (2, 'Artificial'))"
_VECTOR = f"""lc as (select stratum, id, k0 as k, (after = c)::double as y, (before = c)::double as x from labelled, {_KS} kk(k0, c)), pc as (select stratum, id, k0 as k, (before = c)::double as x from predicted, {_KS} kk(k0, c)),
kl as (select k, stratum, count(*) as n, var_samp(x) as vx, covar_samp(y, x) as cxy from lc group by 1, 2), kp as (select k, stratum, count(*) as pn, avg(x) as pm, var_samp(x) as pv from pc group by 1, 2),
aw as (select stratum, area / sum(area) over () as w from areas), tuned as (select k, coalesce(greatest(0, least(1, sum(w * w * cxy / n) / nullif(sum(w * w * (vx / n + pv / pn)), 0))), 0) as lam from kl join kp using (k, stratum) join aw using (stratum) group by 1)"""
_VECTOR_PPI = """rs as (select stratum, id, k, lam, y - lam * x as r from lc join {lam} using (k)), rc as (select a.stratum, a.k, b.k as l, any_value(a.lam) as lk, any_value(b.lam) as ll, count(*) as n, avg(a.r) as mk, avg(b.r) as ml, covar_samp(a.r, b.r) as c from rs a join rs b using (stratum, id) group by 1, 2, 3),
xc as (select * from (select a.stratum, a.k, b.k as l, count(*) as pn, avg(a.x) as pa, avg(b.x) as pb, covar_samp(a.x, b.x) as c from pc a join pc b using (stratum, id) group by 1, 2, 3) t)"""
_VECTOR_OUT = "select k::bigint as k, l::bigint as l, round(sum(w * (mk + lk * pa)), 6) as p_k, round(sum(w * (ml + ll * pb)), 6) as p_l, round(sum(w * w * (rc.c / n + lk * ll * xc.c / pn)), 6) + 0.0 as cov from rc join xc using (stratum, k, l) join aw using (stratum) group by 1, 2"


def _vector(spark, d, lams=None):
    lab, pred, area = _one_hot(labelled(spark, d)), _one_hot(predicted(spark, d)), areas(spark, d)
    ys, xs = [f"y{i}" for i in range(3)], [f"x{i}" for i in range(3)]
    lam = D.lam_classes(lab, pred, area, ys, xs) if lams is None else spark.range(3).select(F.col("id").cast("int").alias("k"), F.lit(lams).alias("lam"))
    return D.ppi_multinomial(lab, pred, area, ys, xs, lam)


@query("a14_vector_ppi", f"with {POP}, {_VECTOR}, half as (select k0 as k, 0.5::double as lam from {_KS} kk(k0, c)), {_VECTOR_PPI.format(lam='half')} {_VECTOR_OUT}")
def a14(spark, d):
    return _vector(spark, d, 0.5)


@query("a14_vector_ppi_tuned", f"with {POP}, {_VECTOR}, {_VECTOR_PPI.format(lam='tuned')} {_VECTOR_OUT}")
def a14t(spark, d):
    return _vector(spark, d)


@query("a15_class_lams", f"with {POP}, {_VECTOR} select k::bigint as k, round(lam, 6) as lam from tuned")
def a15(spark, d):
    return D.lam_classes(_one_hot(labelled(spark, d)), _one_hot(predicted(spark, d)), areas(spark, d), [f"y{i}" for i in range(3)], [f"x{i}" for i in range(3)])


@query("a16_scalar_baseline", f"with {POP}, {_VECTOR}, {_VECTOR_PPI.format(lam='tuned')}, o as ({_VECTOR_OUT}) select k, p_k, cov from o where k = l")
def a16(spark, d):
    return _vector(spark, d).filter("k = l").select("k", "p_k", "cov")


@query("a17_contrast", f"with {POP}, {_LONG}, t as (select sum(case when k = l then ck * p_k else 0 end) as est, sqrt(greatest(0, sum(ck * c2 * cov))) as se from (select *, case k when 0 then 1 when 1 then -1 else 0 end as ck, case l when 0 then 1 when 1 then -1 else 0 end as c2 from comp)) select round(est, 6) as est, round(se, 6) as se, round(est - 1.959963984540054 * se, 6) as lo, round(est + 1.959963984540054 * se, 6) as hi from t")
def a17(spark, d):
    return D.contrast(_composition(spark, d), {0: 1.0, 1: -1.0})


@query("a18_share", f"with {POP}, {_LONG}, s as (select sum(case when k = l and k = 1 then p_k else 0 end) as a, sum(case when k = l and k in (1, 2) then p_k else 0 end) as b, sum(case when k = 1 and l = 1 then cov else 0 end) as vaa, sum(case when k = 1 and l in (1, 2) then cov else 0 end) as vab, sum(case when k in (1, 2) and l in (1, 2) then cov else 0 end) as vbb from comp), t as (select a / b as est, sqrt(greatest(0, vaa - 2 * a / b * vab + (a / b) ** 2 * vbb)) / b as se from s) select round(est, 6) as est, round(se, 6) as se, round(est - 1.959963984540054 * se, 6) as lo, round(est + 1.959963984540054 * se, 6) as hi from t")
def a18(spark, d):
    return D.share(_composition(spark, d), [1], [1, 2])


@query("a20_stratified_ratio", _ci("select any_value(R) as est, sqrt(sum(area * area * (vy + R * R * vx - 2 * R * cxy) / n)) / any_value(X) as se from (select w.*, sum(area * my) over () / sum(area * mx) over () as R, sum(area * mx) over () as X from w)"))
def a20(spark, d):
    return D.stratified_ratio(_stats(spark, d), areas(spark, d))


@query("a21_variance_decomposition", f"with {POP}, {_LAM.format(w='ws', p='ps')}, t as (select stratum, w * w * (vy - 2 * lam * cxy + lam * lam * vx) / n as label_var, w * w * lam * lam * pv / pn as predicted_var from ws join ps using (stratum), lam) select stratum, round(label_var, 6) as label_var, round(predicted_var, 6) as predicted_var, round(label_var / nullif(sum(label_var) over (), 0), 6) as label_share, round((label_var + predicted_var) / nullif(sum(label_var + predicted_var) over (), 0), 6) as total_share, round(sum(label_var) over (order by label_var desc, stratum rows unbounded preceding) / nullif(sum(label_var) over (), 0), 6) as cum_share, row_number() over (order by label_var desc, stratum) as rank from t")
def a21(spark, d):
    stats, proxy, area = _stats(spark, d, "score"), D.proxy_summary(predicted(spark, d), "score"), areas(spark, d)
    return D.variance_decomposition(stats, proxy, area, D.lam_stratified(stats, proxy, area))


def _methods_sql() -> str:
    parts = [("classical", "none", "select 0.0 as lam, sum(w * my) as est, sqrt(sum(w * w * vy / n * greatest(0, 1 - n / area))) as se from w")]
    for name, w, p in (("hard", "w", "px"), ("score", "ws", "ps")):
        for method, lam in (("fixed", "(select 1.0::double as lam)"), ("tuned", "(" + _LAM.format(w=w, p=p).split(" as (", 1)[1])):
            parts.append((method, name, _PPI.format(w=w, p=p)[: -len("lam")] + lam + " lam"))
    return f"with {POP}, t as (" + " union all ".join(f"select '{m}' as method, '{x}' as proxy, * from ({s})" for m, x, s in parts) + ") select method, proxy, round(lam, 6) as lam, round(est, 6) as est, round(se, 6) as se from t"


@query("a22_method_comparison", _methods_sql())
def a22(spark, d):
    stats, area = _stats(spark, d), areas(spark, d)
    out = D.stratified_prop(stats, area).select(F.lit("classical").alias("method"), F.lit("none").alias("proxy"), F.lit(0.0).alias("lam"), "est", "se")
    for name, x in (("hard", "yhat"), ("score", "score")):
        for method, fixed in (("fixed", 1.0), ("tuned", None)):
            out = out.unionByName(_ppi(spark, d, x, fixed).select(F.lit(method).alias("method"), F.lit(name).alias("proxy"), "lam", "est", "se"))
    return out


@query("a23_transition_matrix", f"with {POP}, nn as (select stratum, count(*) as n from pop group by 1), tt as (select sum(n) as tn, sum(area) as ta from nn join areas using (stratum)) select before, after, round(sum(c) / any_value(tn), 6) as raw_share, round(sum(area / ta * c / n), 6) as weighted_share from (select before, after, stratum, count(*) as c from pop where before <> after group by 1, 2, 3) join nn using (stratum) join areas using (stratum), tt group by 1, 2")
def a23(spark, d):
    return D.transition_matrix(population(spark, d), areas(spark, d), "before", "after")


@query("a24_design_weights", f"with {POP}, x as (select n, area / n as w from (select stratum, count(*) as n from pop group by 1) join areas using (stratum)) select min(n) as min_n, max(n) as max_n, round(min(w), 6) as min_w, round(max(w), 6) as max_w, round(max(w) / min(w), 6) as spread from x")
def a24(spark, d):
    return D.design_weights(population(spark, d), areas(spark, d))


_PATCH = "pc as (select o_custkey % 100 as patch, o_orderpriority as cls, count(*) as px from orders group by 1, 2), pt as (select patch, sum(px) as total from pc group by 1), cls as (select distinct o_orderpriority as cls from orders), dense as (select pt.patch, cls.cls, coalesce(px, 0) as px, total from pt cross join cls left join pc on pc.patch = pt.patch and pc.cls = cls.cls)"


def _patches(spark, d):
    from .registry import read

    o = read(spark, d, "orders")
    return o.groupBy((F.col("o_custkey") % 100).alias("patch"), F.col("o_orderpriority").alias("cls")).agg(F.count("*").alias("px")), o.select(F.col("o_orderpriority").alias("cls")).distinct()


@query("a25_composition", f"with {_PATCH}, tt as (select sum(total) as T, count(*) as m from pt), p as (select cls, sum(px) / any_value(T) as share, sum(px * px) as spp, sum(px * total) as spt, sum(total * total) as stt, any_value(T) as T, any_value(m) as m, sum((px > 0)::int) as present from dense, tt group by 1), q as (select cls, share, sqrt(greatest(0, (spp - 2 * share * spt + share * share * stt) / (T::double * T) * m / (m - 1))) as se, present, m as usable from p) select cls, round(share, 6) as share, round(se, 6) as se, present::bigint as present, usable, round(case when se > 0 then share * (1 - share) / (se * se) end, 6) as n_eff, round(greatest(0, share - 1.959963984540054 * se), 6) as lo from q")
def a25(spark, d):
    counts, classes = _patches(spark, d)
    return D.composition(counts, "patch", "cls", "px", classes)


_YIELD = f"{_PATCH}, y as (select cls, avg(least(4, floor(px / 3))::double) as mean_points, stddev_samp(least(4, floor(px / 3))::double) / sqrt(count(*)) as se from dense group by 1)"


@query("a26_patch_yield", f"with {_YIELD} select cls, round(mean_points, 6) as mean_points, round(se, 6) as se from y")
def a26(spark, d):
    counts, classes = _patches(spark, d)
    return D.patch_yield(counts, "patch", "cls", "px", 3, 4, counts, classes)


@query("a27_sizing", f"with {_YIELD} select cls, round(mean_points, 6) as mean_points, round(se, 6) as se, case when mean_points > 0 then ceil(500 / mean_points) else 'inf'::double end as patches, case when mean_points - 1.959963984540054 * se > 0 then ceil(500 / (mean_points - 1.959963984540054 * se)) else 'inf'::double end as upper from y")
def a27(spark, d):
    counts, classes = _patches(spark, d)
    return D.sizing(D.patch_yield(counts, "patch", "cls", "px", 3, 4, counts, classes), 500.0)


@query("a28_map_efficiency", f"with {POP}, h as (select before, count(*) as n, avg(y) as p, sum(y) as s from pop group by 1), t as (select sqrt(sum(s) / sum(n) * (1 - sum(s) / sum(n))) as srs, sum(n * sqrt(p * (1 - p))) / sum(n) as stratified from h) select round(srs, 6) as srs, round(stratified, 6) as stratified, round(srs / stratified, 6) as efficiency from t")
def a28(spark, d):
    return D.map_efficiency(population(spark, d), "before", "y")


@query("a29_ht_error_rate", f"with {POP}, x as (select labelled.stratum, y, 100.0 / n as pi from labelled join (select stratum, count(*) as n from pop group by 1) using (stratum)) select stratum, round(sum(y / pi) / sum(1 / pi), 6) as rate from x group by 1")
def a29(spark, d):
    n = population(spark, d).groupBy("stratum").agg(F.count("*").alias("N"))
    return D.ht_error_rate(labelled(spark, d).join(n, "stratum").withColumn("pi", 100.0 / F.col("N")), "y", "pi", ["stratum"])


@query("a30_wilson", f"with {POP}, s as (select stratum, sum(y) as k, count(*) as n from labelled group by 1), q as (select *, k / n as p, 3.8414588206941254 as z2 from s) select stratum, round(greatest(0, (p + z2 / (2 * n)) / (1 + z2 / n) - 1.959963984540054 * sqrt(p * (1 - p) / n + z2 / (4.0 * n * n)) / (1 + z2 / n)), 6) as lo, round(least(1, (p + z2 / (2 * n)) / (1 + z2 / n) + 1.959963984540054 * sqrt(p * (1 - p) / n + z2 / (4.0 * n * n)) / (1 + z2 / n)), 6) as hi from q")
def a30(spark, d):
    s = labelled(spark, d).groupBy("stratum").agg(F.sum("y").alias("k"), F.count("*").alias("n"))
    lo, hi = D.wilson(F.col("k"), F.col("n"))
    return s.select("stratum", lo.alias("lo"), hi.alias("hi"))


_SLOTS = "slots as (select draw, stratum, slot, n, floor(('0x' || substr(md5(concat_ws('|', '11', draw, stratum, slot)), 1, 13))::bigint / 4503599627370496.0 * n) + 1 as rn from st, (select unnest(range(1, 101)) as slot) a, (select unnest(range(1, 101)) as draw) b where slot <= n), ds as (select draw, s.stratum, count(*) as n, avg(l.y) as my, avg(l.yhat) as mx, coalesce(var_samp(l.yhat), 0) as vx, coalesce(covar_samp(l.y, l.yhat), 0) as cxy from slots s join labelled l on l.stratum = s.stratum and l.r = s.rn group by 1, 2), dw as (select ds.*, px.*, area / (select sum(area) from areas) as w from ds join px using (stratum) join areas using (stratum)), dl as (select draw, coalesce(greatest(0, least(1, sum(w * w * cxy / n) / nullif(sum(w * w * (vx / n + pv / pn)), 0))), 0) as lam from dw group by 1)"


@query("b1_bootstrap_draws", f"with {POP}, {_SLOTS} select draw, round(any_value(lam), 6) as lam, round(sum(w * (my + lam * (pm - mx))), 6) as est from dw join dl using (draw) group by 1")
def b1(spark, d):
    drawn, area = D.bootstrap_draws(labelled(spark, d), "stratum", 11, 100, ["y", "yhat"], ["k", "id"]), areas(spark, d)
    by = drawn.groupBy("draw", "stratum").agg(F.count("*").alias("n"), F.avg("y").alias("my"), F.avg("yhat").alias("mx"), F.coalesce(F.var_samp("yhat"), F.lit(0.0)).alias("vx"), F.coalesce(F.covar_samp("y", "yhat"), F.lit(0.0)).alias("cxy"))
    return D.ppi_draws(by, D.proxy_summary(predicted(spark, d), "yhat"), area)


_BOOT = f"with {POP}, slots as (select draw, stratum, slot, n, floor(('0x' || substr(md5(concat_ws('|', '13', draw, stratum, slot)), 1, 13))::bigint / 4503599627370496.0 * n) + 1 as rn from st, (select unnest(range(1, 101)) as slot) a, (select unnest(range(1, 101)) as draw) b where slot <= n), dr as (select draw, sum(area / (select sum(area) from areas) * my) as est from (select draw, s.stratum, avg(l.y) as my from slots s join labelled l on l.stratum = s.stratum and l.r = s.rn group by 1, 2) join areas using (stratum) group by 1)"


@query("b2_bootstrap_summary", f"{_BOOT} select count(*) as draws, round(avg(est), 6) as mean, round(stddev_samp(est), 6) as se, round(quantile_cont(est, 0.025), 6) as lo, round(quantile_cont(est, 0.5), 6) as median, round(quantile_cont(est, 0.975), 6) as hi from dr")
def b2(spark, d):
    draws = D.bootstrap_draws(labelled(spark, d), "stratum", 13, 100, ["y"], ["k", "id"])
    w = areas(spark, d).withColumn("w", F.col("area") / F.sum("area").over(D.everything()))
    est = draws.groupBy("draw", "stratum").agg(F.avg("y").alias("my")).join(w, "stratum").groupBy("draw").agg(F.sum(F.col("w") * F.col("my")).alias("est"))
    return D.bootstrap_summary(est, "est")


@query("b3_bootstrap_ratio", _BOOT.rsplit(", dr as", 1)[0] + ", dr as (select draw, sum(y) / sum(yhat) as ratio from slots s join labelled l on l.stratum = s.stratum and l.r = s.rn group by 1) select count(*) as draws, round(avg(ratio), 6) as mean, round(stddev_samp(ratio), 6) as se, round(quantile_cont(ratio, 0.025), 6) as lo, round(quantile_cont(ratio, 0.5), 6) as median, round(quantile_cont(ratio, 0.975), 6) as hi from dr")
def b3(spark, d):
    draws = D.bootstrap_draws(labelled(spark, d), "stratum", 13, 100, ["y", "yhat"], ["k", "id"])
    return D.bootstrap_summary(draws.groupBy("draw").agg((F.sum("y") / F.sum("yhat")).alias("ratio")), "ratio")

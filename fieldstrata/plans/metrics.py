"""Queries of metrics, conformal sets, gates and clusters."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalar as S
from ..functions.keyed import uniform
from ..operators import joins as J
from ..operators import metrics as M
from .registry import query, read
from .roles import POSTERIORS, posteriors

PRED = "case when p0 >= p1 and p0 >= p2 then 0 when p1 >= p2 then 1 else 2 end"
_CONF = f"conf as (select truth, {PRED} as pred, count(*) as n from post group by 1, 2)"
_PC = "t as (select truth as cls, sum(n) as support, sum(case when truth = pred then n else 0 end) as tp from conf group by 1), q as (select pred as cls, sum(n) as called from conf group by 1), pc as (select cls, support::bigint as support, tp / greatest(coalesce(called, 0), 1) as precision, tp / greatest(support, 1) as recall, 2 * tp / greatest(coalesce(called, 0) + support, 1) as f1 from t left join q using (cls))"


def P():
    return F.array("p0", "p1", "p2")


def table(spark, d):
    return posteriors(spark, d).withColumn("pred", S.argmax(P()))


@query("m1_per_class", f"with {POSTERIORS}, {_CONF}, {_PC} select cls, support, round(precision, 6) as precision, round(recall, 6) as recall, round(f1, 6) as f1 from pc")
def m1(spark, d):
    return M.per_class(M.confusion(table(spark, d), "truth", "pred"))


@query("m2_binary_change", f"with {POSTERIORS}, b as (select sum((truth > 0 and p1 + p2 >= 0.6)::int) as tp, sum((truth = 0 and p1 + p2 >= 0.6)::int) as fp, sum((truth > 0 and p1 + p2 < 0.6)::int) as fn from post) select round(tp / greatest(tp + fp, 1), 6) as precision, round(tp / greatest(tp + fn, 1), 6) as recall, round(2 * tp / greatest(2 * tp + fp + fn, 1), 6) as f1 from b")
def m2(spark, d):
    return M.binary(table(spark, d), F.col("truth") > 0, F.col("p1") + F.col("p2") >= 0.6)


@query("m3_overall", f"with {POSTERIORS}, {_CONF}, {_PC}, a as (select sum(case when truth = pred then n else 0 end) / sum(n) as accuracy from conf) select round(any_value(accuracy), 6) as accuracy, round(avg(recall), 6) as balanced, round(avg(f1), 6) as macro_f1 from pc, a")
def m3(spark, d):
    return M.overall(M.confusion(table(spark, d), "truth", "pred"))


@query("m5_by_availability", f"with {POSTERIORS} select fold % 2 as mask, count(*) as n, round(case when count(*) >= 20 then avg(({PRED} = truth)::int) end, 6) as accuracy from post group by 1")
def m5(spark, d):
    t = table(spark, d)
    return t.groupBy((F.col("fold") % 2).alias("mask")).agg(F.count("*").alias("n"), F.when(F.count("*") >= 20, F.avg((F.col("pred") == F.col("truth")).cast("double"))).alias("accuracy"))


GRID = [i / 20 for i in range(1, 20)]
_SW = "g as (select unnest(range(1, 20)) / 20.0::double as t), sw as (select t, sum((truth > 0 and p1 + p2 >= t)::int) as tp, sum((truth = 0 and p1 + p2 >= t)::int) as fp, sum((truth > 0 and p1 + p2 < t)::int) as fn from post, g group by 1)"


@query("m7_threshold_sweep", f"with {POSTERIORS}, {_SW} select round(t, 6) as t, tp::bigint as tp, fp::bigint as fp, fn::bigint as fn, round(tp / greatest(tp + fp, 1), 6) as precision, round(tp / greatest(tp + fn, 1), 6) as recall, round(2 * tp / greatest(2 * tp + fp + fn, 1), 6) as f1 from sw")
def m7(spark, d):
    return M.sweep(table(spark, d), F.col("truth") > 0, F.col("p1") + F.col("p2"), GRID)


@query("m7_best_threshold", f"with {POSTERIORS}, {_SW} select round(t, 6) as t, round(2 * tp / greatest(2 * tp + fp + fn, 1), 6) as f1 from sw order by round(2 * tp / greatest(2 * tp + fp + fn, 1), 9) desc, t limit 1")
def m7b(spark, d):
    return M.best(M.sweep(table(spark, d), F.col("truth") > 0, F.col("p1") + F.col("p2"), GRID), "f1", "t").select("t", "f1")


@query("m9_confusion_rates", f"with {POSTERIORS}, {_CONF} select truth, pred, n, round(n / sum(n) over (partition by truth), 6) as row_rate, round(n / sum(n) over (partition by pred), 6) as col_rate from conf")
def m9(spark, d):
    from pyspark.sql import Window

    c = M.confusion(table(spark, d), "truth", "pred")
    return c.withColumn("row_rate", F.col("n") / F.sum("n").over(Window.partitionBy("truth"))).withColumn("col_rate", F.col("n") / F.sum("n").over(Window.partitionBy("pred")))


@query("m10_state_reads", f"with {POSTERIORS} select coalesce((fold = 0)::varchar, 'all') as read, count(*) as n, round(avg(({PRED} = truth)::int), 6) as accuracy from post group by grouping sets ((fold = 0), ())")
def m10(spark, d):
    t = table(spark, d).withColumn("changed", F.col("fold") == 0)
    return t.groupingSets([[F.col("changed")], []], F.col("changed")).agg(F.count("*").alias("n"), F.avg((F.col("pred") == F.col("truth")).cast("double")).alias("accuracy")).select(F.coalesce(F.col("changed").cast("string"), F.lit("all")).alias("read"), "n", "accuracy")


@query("m11_mask_agreement", f"with {POSTERIORS}, m as (select sum((p1 > 0.3 and p2 > 0.3)::int) as a, sum((p1 > 0.3 and p2 <= 0.3)::int) as b, sum((p1 <= 0.3 and p2 > 0.3)::int) as c, sum((p1 <= 0.3 and p2 <= 0.3)::int) as e, count(*)::double as n from post) select a::bigint as both, b::bigint as first_only, c::bigint as second_only, e::bigint as neither, round(((a + e) / n - ((a + b) / n * (a + c) / n + (c + e) / n * (b + e) / n)) / (1 - ((a + b) / n * (a + c) / n + (c + e) / n * (b + e) / n)), 6) as kappa, round(2 * a / (2 * a + b + c), 6) as f1 from m")
def m11(spark, d):
    x, y = F.col("p1") > 0.3, F.col("p2") > 0.3
    s = table(spark, d).agg(F.count_if(x & y).alias("both"), F.count_if(x & ~y).alias("first_only"), F.count_if(~x & y).alias("second_only"), F.count_if(~x & ~y).alias("neither"))
    a, b, c, e = F.col("both"), F.col("first_only"), F.col("second_only"), F.col("neither")
    n = a + b + c + e
    pe = (a + b) / n * (a + c) / n + (c + e) / n * (b + e) / n
    return s.withColumn("kappa", ((a + e) / n - pe) / (1 - pe)).withColumn("f1", 2 * a / (2 * a + b + c))


@query("m12_seed_summary", f"with {POSTERIORS}, s as (select fold, avg(({PRED} = truth)::int) as acc from post group by 1) select round(avg(acc), 6) as mean, round(stddev_pop(acc), 6) as sd from s")
def m12(spark, d):
    s = table(spark, d).groupBy("fold").agg(F.avg((F.col("pred") == F.col("truth")).cast("double")).alias("acc"))
    return s.agg(F.avg("acc").alias("mean"), F.stddev_pop("acc").alias("sd"))


_BR = "((p0 - (truth = 0)::int) ** 2 + (p1 - (truth = 1)::int) ** 2 + (p2 - (truth = 2)::int) ** 2)"


@query("m13_probability_scores", f"with {POSTERIORS} select fold, round(avg({_BR}), 6) as brier, round(avg(-ln(greatest(case truth when 0 then p0 when 1 then p1 else p2 end, 1e-12))), 6) as nll, round(avg({_BR}) / 2, 6) as crps, round(avg(({PRED} = truth)::int), 6) as accuracy from post group by 1")
def m13(spark, d):
    return M.probability_scores(table(spark, d), ["p0", "p1", "p2"], "truth", ["fold"])


@query("m14_ordinal_crps", f"with {POSTERIORS} select fold, round(avg((p0 - (truth <= 0)::int) ** 2 + (p0 + p1 - (truth <= 1)::int) ** 2), 6) as crps from post group by 1")
def m14(spark, d):
    c = (F.col("p0") - (F.col("truth") <= 0).cast("double")) ** 2 + (F.col("p0") + F.col("p1") - (F.col("truth") <= 1).cast("double")) ** 2
    return table(spark, d).groupBy("fold").agg(F.avg(c).alias("crps"))


@query("m15_ece", f"with {POSTERIORS}, b as (select greatest(p0, p1, p2) as p, ({PRED} = truth)::int as hit, ceil(round(greatest(p0, p1, p2) * 15, 9)) as bin from post), g as (select bin, count(*) as n, avg(p) as c, avg(hit) as a from b group by 1) select round(sum(case when bin > 0 then n * abs(c - a) else 0 end) / sum(n), 6) as ece from g")
def m15(spark, d):
    return M.calibration_error(table(spark, d), F.greatest("p0", "p1", "p2"), F.col("pred") == F.col("truth"))


@query("m16_temperature")
def m16(spark, d):
    t = table(spark, d).select("truth", *[F.ln(p).alias(f"z{i}") for i, p in enumerate(("p0", "p1", "p2"))])
    return spark.range(1).select(F.lit(M.temperature_fit(t, ["z0", "z1", "z2"], "truth")).alias("temperature"))


@query("m18_auc", f"with {POSTERIORS}, r as (select truth > 0 as y, rank() over (order by round(p0, 3)) + (count(*) over (partition by round(p0, 3)) - 1) / 2.0 as r from post), s as (select sum(case when y then r end) as R, count(*) filter (y) as P, count(*) filter (not y) as N from r) select round((R - P * (P + 1) / 2) / (P::double * N), 6) as auc from s")
def m18(spark, d):
    return M.auc(table(spark, d).select(F.round("p0", 3).alias("s"), (F.col("truth") > 0).alias("y")), "s", "y")


@query("m19_error_by_stratum", "with g as (select p_brand, count(*) as n, sum((l_discount > 0.05)::int)::double as e from lineitem join part on p_partkey = l_partkey group by 1) select p_brand, n, round(case when n >= 2400 then e / n else (select sum(e) / sum(n) from g) end, 6) as rate from g")
def m19(spark, d):
    li = read(spark, d, "lineitem").join(read(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return M.error_by_stratum(li, "p_brand", F.col("l_discount") > 0.05, 2400)


@query("m20_coverage_table", "with a as (select l_returnflag as s, count(*)::double as n from lineitem where l_linenumber = 1 group by 1), b as (select l_returnflag as s, count(*)::double as m from lineitem group by 1) select s, round(n / sum(n) over (), 6) as label_share, round(m / sum(m) over (), 6) as land_share, round(n / sum(n) over () / (m / sum(m) over ()), 6) as ratio from a join b using (s)")
def m20(spark, d):
    li = read(spark, d, "lineitem").select(F.col("l_returnflag").alias("s"), "l_linenumber")
    g = li.groupBy("s").agg(F.count_if(F.col("l_linenumber") == 1).alias("n"), F.count("*").alias("m"))
    a, b = F.col("n") / F.sum("n").over(M.everything()), F.col("m") / F.sum("m").over(M.everything())
    return g.select("s", a.alias("label_share"), b.alias("land_share"), (a / b).alias("ratio"))


@query("m21_gini", "with c as (select o_custkey, count(*) as c from orders group by 1), r as (select c, row_number() over (order by c, o_custkey) as i from c) select round(2 * sum(i * c) / (count(*) * sum(c)) - (count(*) + 1) / count(*), 6) as gini from r")
def m21(spark, d):
    return M.gini(read(spark, d, "orders"), "o_custkey")


@query("m22_centroids", "with e as (select vec_id, label, i, (embedding::double[])[i] as v from embeddings, (select unnest(range(1, 65)) as i)), c as (select label, i, avg(v) as m from e group by 1, 2) select e.label, round(avg(dist), 6) as mean_distance from (select e.vec_id, e.label, sqrt(sum((v - m) ** 2)) as dist from e join c using (label, i) group by 1, 2) e group by 1")
def m22(spark, d):
    e = read(spark, d, "embeddings").select("vec_id", "label", F.posexplode("embedding").alias("i", "v"))
    c = e.groupBy("label", "i").agg(F.avg(F.col("v").cast("double")).alias("m"))
    dist = e.join(c, ["label", "i"]).groupBy("vec_id", "label").agg(F.sqrt(F.sum((F.col("v").cast("double") - F.col("m")) ** 2)).alias("dist"))
    return dist.groupBy("label").agg(F.avg("dist").alias("mean_distance"))


@query("m23_misread_confidence", f"with {POSTERIORS}, x as (select greatest(p0, p1, p2) as p from post where {PRED} <> truth) select round(quantile_cont(p, 0.25), 6) as q25, round(quantile_cont(p, 0.5), 6) as q50, round(quantile_cont(p, 0.75), 6) as q75, round(avg((p < 0.5)::int), 6) as near from x")
def m23(spark, d):
    x = table(spark, d).filter("pred <> truth").select(F.greatest("p0", "p1", "p2").alias("p"))
    return x.agg(*[F.percentile("p", F.lit(q)).alias(f"q{round(q * 100)}") for q in (0.25, 0.5, 0.75)], F.avg((F.col("p") < 0.5).cast("double")).alias("near"))


@query("m25_paired_arms", "with t as (select o_orderpriority as arm, year(o_orderdate) as round, o_orderstatus as fold, avg(o_totalprice) as m from orders group by 1, 2, 3), q as (select a.arm, avg(a.m - b.m) as delta, stddev_samp(a.m - b.m) as sd, sum((a.m > b.m)::int)::bigint as wins, count(*) as n from t a join t b using (round, fold) where b.arm = '5-LOW' and a.arm <> '5-LOW' group by 1) select arm, round(delta, 3) as delta, round(sd, 3) as sd, round(sd / sqrt(n), 3) as se, wins, n, abs(delta) < sd / sqrt(n) as inside_floor from q")
def m25(spark, d):
    t = read(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("arm"), F.year("o_orderdate").alias("round"), F.col("o_orderstatus").alias("fold")).agg(F.avg("o_totalprice").alias("m"))
    q = J.paired_arms(t, "arm", "5-LOW", ["round", "fold"], "m", [])
    return q.withColumn("inside_floor", F.abs("delta") < F.col("se")).withColumns({c: F.round(c, 3) for c in ("delta", "sd", "se")})


@query("m26_seed_averaged_ledger", "with t as (select o_orderpriority as arm, o_custkey % 5 as seed, arg_max(o_totalprice, o_orderkey) as v from orders group by 1, 2) select arm, count(distinct seed) as seeds, round(avg(v), 4) as mean, round(stddev_samp(v), 4) as sd from t group by 1")
def m26(spark, d):
    t = read(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("arm"), (F.col("o_custkey") % 5).alias("seed")).agg(F.max_by("o_totalprice", "o_orderkey").alias("v"))
    return t.groupBy("arm").agg(F.count_distinct("seed").alias("seeds"), F.round(F.avg("v"), 4).alias("mean"), F.round(F.stddev_samp("v"), 4).alias("sd"))


@query("m29_confident_joint", f"with {POSTERIORS}, t as (select truth, avg(case truth when 0 then p0 when 1 then p1 else p2 end) as thr from post group by 1), w as (select max(case when truth = 0 then thr end) as t0, max(case when truth = 1 then thr end) as t1, max(case when truth = 2 then thr end) as t2 from t), c as (select truth, case when p0 >= t0 and p0 >= case when p1 >= t1 then p1 else -1 end and p0 >= case when p2 >= t2 then p2 else -1 end then 0 when p1 >= t1 and p1 >= case when p2 >= t2 then p2 else -1 end then 1 when p2 >= t2 then 2 end as conf from post, w) select truth, conf, count(*) as n from c group by 1, 2")
def m29(spark, d):
    t = table(spark, d)
    own = F.get(P(), F.col("truth"))
    thr = t.agg(*[F.avg(F.when(F.col("truth") == i, own)).alias(f"t{i}") for i in range(3)])
    sure = F.array(*[F.when(F.col(f"p{i}") >= F.col(f"t{i}"), F.col(f"p{i}")).otherwise(-1.0) for i in range(3)])
    conf = F.when(F.array_max(sure) >= 0, S.argmax(sure))
    return t.crossJoin(F.broadcast(thr)).groupBy("truth", conf.alias("conf")).agg(F.count("*").alias("n"))  # one row


@query("m30_fold_counts", f"with {POSTERIORS} select fold, truth, count(*) as n from post group by 1, 2 having count(*) > 10")
def m30(spark, d):
    return table(spark, d).groupBy("fold", "truth").agg(F.count("*").alias("n")).filter("n > 10")


@query("m31_curve_rows", f"with {POSTERIORS}, {_CONF}, {_PC} select cls::varchar as cls, round(f1, 6) as f1 from pc union all select 'MACRO', round(avg(f1), 6) from pc")
def m31(spark, d):
    pc = M.per_class(M.confusion(table(spark, d), "truth", "pred"))
    return pc.select(F.col("cls").cast("string").alias("cls"), "f1").unionByName(pc.agg(F.avg("f1").alias("f1")).withColumn("cls", F.lit("MACRO")))


@query("m34_pool_shares", "select l_shipmode_ as cls, count(*) as n, round(count(*) / sum(count(*)) over (), 6) as share from (select l_returnflag || l_linestatus as l_shipmode_ from lineitem) group by 1")
def m34(spark, d):
    g = read(spark, d, "lineitem").groupBy(F.concat("l_returnflag", "l_linestatus").alias("cls")).agg(F.count("*").alias("n"))
    return g.withColumn("share", F.col("n") / F.sum("n").over(M.everything()))


@query("c1_cluster_weights", "with n as (select label, count(*) as c from embeddings group by 1), k as (select sum(case when label = 0 then c else 1 end) as K from n), w as (select label, c, case when label = 0 then 0.5 / K else 1 / (K * c) end as w from n, k) select label, round(w / (select sum(w * c) from w), 8) as weight from w")
def c1(spark, d):
    return M.cluster_weights(read(spark, d, "embeddings").select("label"), "label", 0, 0.5).distinct().withColumn("weight", F.round("weight", 8))


@query("c2_feature_activation", "with s as (select vec_id, list_avg(embedding::double[]) as a, stddev_pop(v) as b from (select vec_id, embedding, unnest(embedding::double[]) as v from embeddings) group by vec_id, embedding), r as (select vec_id, a / b as x from s) select vec_id, round(1 - (x - min(x) over ()) / (max(x) over () - min(x) over ()), 6) as activation from r")
def c2(spark, d):
    e = read(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("e"))
    add = lambda c: F.aggregate(c, F.lit(0.0), lambda s, x: s + x)
    m = add(F.col("e")) / F.size("e")
    x = e.select("vec_id", m.alias("m"), "e").select("vec_id", (F.col("m") / F.sqrt(add(F.transform("e", lambda v: (v - F.col("m")) * (v - F.col("m")))) / F.size("e"))).alias("x"))
    r = x.agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    return x.crossJoin(F.broadcast(r)).select("vec_id", F.when(F.col("hi") > F.col("lo"), 1 - (F.col("x") - F.col("lo")) / (F.col("hi") - F.col("lo"))).otherwise(0.0).alias("activation"))  # one row


@query("c3_vendi")
def c3(spark, d):
    return M.vendi(read(spark, d, "embeddings"), "embedding")


@query("c4_vendi_by_cluster")
def c4(spark, d):
    return M.vendi(read(spark, d, "embeddings"), "embedding", ["label"])


@query("c6_clusters")
def c6(spark, d):
    from pyspark.ml.clustering import BisectingKMeans
    from pyspark.ml.functions import array_to_vector

    e = read(spark, d, "embeddings").select("vec_id", array_to_vector(F.transform("embedding", lambda x: x.cast("double"))).alias("features"))
    return BisectingKMeans(k=8, seed=1).fit(e).transform(e).groupBy("prediction").agg(F.count("*").alias("n"))


@query("c7_novelty", "with n as (select vec_id, label, min(1 - list_dot_product(q, r) / (sqrt(list_dot_product(q, q)) * sqrt(list_dot_product(r, r)))) as dist from (select vec_id, label, embedding::double[] as q from embeddings where label <> 0), (select embedding::double[] as r from embeddings where label = 0) group by 1, 2) select label, round(quantile_cont(dist, 0.9), 6) as p90, round(avg(dist), 6) as mean from n group by 1")
def c7(spark, d):
    e = read(spark, d, "embeddings")
    n = J.nearest_reference(e.filter("label <> 0"), e.filter("label = 0"), "vec_id", "embedding")
    return n.join(e.select("vec_id", "label"), "vec_id").groupBy("label").agg(F.percentile("distance", F.lit(0.9)).alias("p90"), F.avg("distance").alias("mean"))


_MEM = "mem as (select truth, fold, avg(p0) as p0, avg(p1) as p1, avg(p2) as p2 from post group by 1, 2)"


@query("c8_bald", f"with {POSTERIORS}, {_MEM}, h as (select truth, avg(p0) as a, avg(p1) as b, avg(p2) as c, avg(-(p0 * ln(p0) + p1 * ln(p1) + p2 * ln(p2))) as mh from mem group by 1) select truth, round(greatest(0, least(1, (-(a * ln(a) + b * ln(b) + c * ln(c)) - mh) / ln(3))), 6) as bald from h")
def c8(spark, d):
    mem = posteriors(spark, d).groupBy("truth", "fold").agg(*[F.avg(p).alias(p) for p in ("p0", "p1", "p2")])
    h = mem.groupBy("truth").agg(*[F.avg(p).alias(p) for p in ("p0", "p1", "p2")], F.avg(S.entropy(P())).alias("mh"))
    return h.select("truth", F.greatest(F.lit(0.0), F.least(F.lit(1.0), S.entropy(P()) - F.col("mh"))).alias("bald"))


_LAC = "round(1 - case truth when 0 then p0 when 1 then p1 else p2 end, 6)"


@query("c14_split_quantile", f"with {POSTERIORS}, r as (select {_LAC} as s, row_number() over (order by {_LAC}) as rn, count(*) over () as n from post) select max(n) as n, max(case when rn = ceil(round((n + 1) * 0.9, 9)) then s end) as q from r")
def c14(spark, d):
    t = posteriors(spark, d).select(F.round(1 - F.get(P(), F.col("truth")), 6).alias("s"))
    return M.split_quantile(t, "s", 0.1)


@query("c11_class_quantiles", f"with {POSTERIORS}, r as (select truth, {_LAC} as s, row_number() over (partition by truth order by {_LAC}) as rn, count(*) over (partition by truth) as n from post) select truth, max(n) as n, max(case when rn = ceil(round((n + 1) * 0.9, 9)) then s end) as q from r group by 1")
def c11(spark, d):
    t = posteriors(spark, d).select("truth", F.round(1 - F.get(P(), F.col("truth")), 6).alias("s"))
    return M.split_quantile(t, "s", 0.1, ["truth"])


@query("c12_aps_scores", f"with {POSTERIORS}, u as (select *, ('0x' || substr(md5('51|' || id), 1, 13))::bigint / 4503599627370496.0 as u from post) select truth, round(avg(case when p1 > p0 then p1 else 0 end + case when p2 > p0 then p2 else 0 end + u * p0), 6) as s0, round(avg(case when p0 >= p1 then p0 else 0 end + case when p2 > p1 then p2 else 0 end + u * p1), 6) as s1, round(avg(case when p0 >= p2 then p0 else 0 end + case when p1 >= p2 then p1 else 0 end + u * p2), 6) as s2 from u group by 1")
def c12(spark, d):
    u = uniform(51, "id")
    return posteriors(spark, d).groupBy("truth").agg(*[F.avg(M.aps_score(["p0", "p1", "p2"], i, u)).alias(f"s{i}") for i in range(3)])


_NEST = f"cal as (select f.k as fold, {_LAC} as s from post, (select unnest(range(0, 5)) as k) f where post.fold <> f.k), rk as (select fold, s, row_number() over (partition by fold order by s) as rn, count(*) over (partition by fold) as n from cal), q as (select fold, max(case when rn = ceil(round((n + 1) * 0.9, 9)) then s end) as q from rk group by 1), st as (select post.fold, (round(1 - p0, 6) <= q)::int + (round(1 - p1, 6) <= q)::int + (round(1 - p2, 6) <= q)::int as size, {_LAC} <= q as covered from post join q using (fold))"


def nested_sets(spark, d):
    t = posteriors(spark, d)
    own = F.round(1 - F.get(P(), F.col("truth")), 6)
    cal = t.select("fold", own.alias("s")).groupBy("fold", "s").agg(F.count("*").alias("n"))
    cal = cal.select(F.explode(F.array(*[F.lit(i) for i in range(5)])).alias("k"), "fold", "s", "n").filter("k <> fold")
    q = M.weighted_quantiles(cal.drop("fold").withColumnRenamed("k", "fold"), "s", "n", [0.1], ["fold"]).select("fold", "q")
    return t.join(F.broadcast(q), "fold").select("fold", "truth", sum(((F.round(1 - F.col(p), 6) <= F.col("q")).cast("int") for p in ("p0", "p1", "p2")), F.lit(0)).alias("size"), (own <= F.col("q")).alias("covered"))  # a row for each fold


@query("c15_nested_conformal", f"with {POSTERIORS}, {_NEST} select fold, count(*) as n, round(avg(covered::int), 6) as coverage, round(avg(size), 6) as mean_size, round(avg((size = 1)::int), 6) as singletons, round(avg((size = 0)::int), 6) as empty, round(quantile_cont(size, 0.9), 6) as p90_size from st group by 1")
def c15(spark, d):
    return M.set_metrics(nested_sets(spark, d), "size", "covered", ["fold"])


@query("m17_set_metrics", f"with {POSTERIORS}, {_NEST} select truth_ as truth, count(*) as n, round(avg(covered::int), 6) as coverage, round(avg(size), 6) as mean_size, round(avg((size = 1)::int), 6) as singletons, round(avg((size = 0)::int), 6) as empty, round(quantile_cont(size, 0.9), 6) as p90_size from (select post.truth as truth_, (round(1 - p0, 6) <= q)::int + (round(1 - p1, 6) <= q)::int + (round(1 - p2, 6) <= q)::int as size, {_LAC} <= q as covered from post join q using (fold)) group by 1")
def m17(spark, d):
    return M.set_metrics(nested_sets(spark, d), "size", "covered", ["truth"])


@query("c22_risk_gate", f"""with recursive {POSTERIORS}, g as (select unnest(range(1, 20)) / 20.0::double as t), k as (select t, count(*) filter (truth > 0) as n, count(*) filter (truth > 0 and p1 + p2 < t) as f from post, g group by 1),
b as (select t, n, f, f / n as lo, 1.0::double as hi, 0 as i from k where f < n union all select t, n, f, case when up then mid else lo end, case when up then hi else mid end, i + 1 from (select *, (lo + hi) / 2 as mid,
 list_sum(list_transform(range(0, f + 1), lambda j: exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln((lo + hi) / 2) + (n - j) * ln(1 - (lo + hi) / 2)))) > 0.1 as up from b where i < 40))
select max(t) as t from b where i = 40 and (lo + hi) / 2 <= 0.2""")
def c22(spark, d):
    s = M.sweep(posteriors(spark, d), F.col("truth") > 0, F.col("p1") + F.col("p2"), GRID)
    bounds = s.select("t", "fn", (F.col("tp") + F.col("fn")).alias("n")).withColumn("bound", M.binomial_upper_column("fn", "n", 0.1))  # a row a threshold
    return bounds.filter("bound <= 0.2").agg(F.max("t").alias("t"))


@query("c23_nested_gate", f"with {POSTERIORS}, g as (select unnest(range(1, 20)) / 20.0::double as t), o as (select f.k as fold, t, sum((truth > 0 and p1 + p2 >= t)::int) as tp, sum((truth = 0 and p1 + p2 >= t)::int) as fp, sum((truth > 0 and p1 + p2 < t)::int) as fn from post, g, (select unnest(range(0, 5)) as k) f where post.fold <> f.k group by 1, 2), r as (select *, row_number() over (partition by fold order by round(2 * tp / greatest(2 * tp + fp + fn, 1), 9) desc, t) as rn from o) select fold, round(t, 6) as t from r where rn = 1")
def c23(spark, d):
    s = M.sweep(posteriors(spark, d), F.col("truth") > 0, F.col("p1") + F.col("p2"), GRID, ["fold"])
    total = s.groupBy("t").agg(*[F.sum(c).alias(f"{c}_") for c in ("tp", "fp", "fn")])
    j = s.join(total, "t").select("fold", "t", *[(F.col(f"{c}_") - F.col(c)).alias(c) for c in ("tp", "fp", "fn")])
    f1 = M.prf(F.col("tp"), F.col("fp"), F.col("fn"))[2]
    return M.best(j.withColumn("f1", f1), "f1", "t", ["fold"]).select("fold", "t")


@query("c31_class_weights", "with n as (select l_returnflag as cls, count(*) as n from lineitem group by 1), w as (select cls, n, (1 - 0.999) / (1 - power(0.999, n)) as e from n) select cls, round(sum(n) over () / (3.0 * n), 6) as inverse, round(e / avg(e) over (), 6) as effective from w")
def c31(spark, d):
    n = read(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("cls")).agg(F.count("*").alias("n")).withColumn("e", (1 - 0.999) / (1 - F.pow(F.lit(0.999), F.col("n"))))
    k = F.count("*").over(M.everything())
    return n.select("cls", (F.sum("n").over(M.everything()) / (k * F.col("n"))).alias("inverse"), (F.col("e") / F.avg("e").over(M.everything())).alias("effective"))


@query("c32_row_weights", "with w as (select o_custkey, 1.0 / count(*) over (partition by o_custkey) as w from orders) select o_custkey, round(avg(w) / (select avg(w) from w), 6) as weight from w group by 1")
def c32(spark, d):
    n = read(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"))
    t = n.agg((F.count("*") / F.sum("n")).alias("m"))
    return n.crossJoin(F.broadcast(t)).select("o_custkey", (1 / F.col("n") / F.col("m")).alias("weight"))  # one row


@query("c38_chunk_blocks", "select o_custkey % 20 as block, (row_number() over (partition by o_custkey % 20 order by o_orderkey) - 1) // 300 as part, o_orderkey from orders")
def c38(spark, d):
    from pyspark.sql import Window

    o = read(spark, d, "orders").select((F.col("o_custkey") % 20).alias("block"), "o_orderkey")
    return o.withColumn("part", F.floor((F.row_number().over(Window.partitionBy("block").orderBy("o_orderkey")) - 1) / 300))


@query("c27_blocked_cv")
def c27(spark, d):
    from ..operators.models import out_of_fold

    li = read(spark, d, "lineitem").select((F.col("l_discount") >= 0.05).cast("double").alias("label"), (F.col("l_orderkey") % 3).alias("fold"), "l_quantity", "l_tax", "l_extendedprice")
    oof = out_of_fold(li, ["l_quantity", "l_tax", "l_extendedprice"], "label", "fold", 3)
    return oof.groupBy("fold").agg(F.count("*").alias("n"), F.avg((F.col("prediction") == F.col("label")).cast("double")).alias("accuracy"))

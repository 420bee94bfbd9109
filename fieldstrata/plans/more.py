"""Queries of further survey operators: calls, conformal variants, ensembles, samples, raster features."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..functions.keyed import key
from ..operators import joins as J
from ..operators import labels as L
from ..operators import metrics as M
from ..operators import sampling as A
from ..operators import windows as W
from .metrics import PRED, P, table
from .rasters import _PX, maps
from .registry import query, read
from .roles import POP, POSTERIORS, READINGS, posteriors, population, readings
from .sampling import K


@query("p13_usable", f"with {READINGS} select expert_id, count(*) as n from readings where transition is not null and transition <> '' group by 1")
def p13(spark, d):
    return readings(spark, d).filter(L.blank_to_null("transition").isNotNull()).groupBy("expert_id").agg(F.count("*").alias("n"))


@query("p15_norm_call", "select case when event_type in ('error', 'view') then 'cannot interpret' else event_type end as call, count(*) as n from events group by 1")
def p15(spark, d):
    raw = F.when(F.col("event_type") == "error", "  ").when(F.col("event_type") == "view", "nan").otherwise(F.concat(F.lit(" "), "event_type"))
    return read(spark, d, "events").groupBy(L.call(raw).alias("call")).agg(F.count("*").alias("n"))


@query("p16_parse_assigned", "select unnest(list_filter(list_transform(string_split(event_type || ' | |' || (user_id % 2), '|'), lambda x: trim(x)), lambda x: x <> '')) as part, count(*) as n from events group by 1")
def p16(spark, d):
    parts = F.filter(F.transform(F.split(F.concat("event_type", F.lit(" | |"), (F.col("user_id") % 2).cast("string")), r"\|"), lambda x: F.trim(x)), lambda x: x != "")
    return read(spark, d, "events").select(F.explode(parts).alias("part")).groupBy("part").agg(F.count("*").alias("n"))


@query("m6_focus_metrics", f"with {POSTERIORS}, x as (select truth, {PRED} as pred from post) select k as cls, round(case when sum((truth = k)::int) > 0 then 2 * sum((truth = k and pred = k)::int) / greatest(sum((truth = k)::int) + sum((pred = k)::int), 1) end, 6) as f1 from x, (select unnest([1, 2, 9]) as k) group by 1")
def m6(spark, d):
    c = M.confusion(table(spark, d), "truth", "pred")
    names = spark.range(1).select(F.explode(F.array(F.lit(1), F.lit(2), F.lit(9))).alias("cls"))
    return names.join(M.per_class(c).select("cls", "f1"), "cls", "left")


@query("m8_stable_confusions", f"with {POSTERIORS}, x as (select truth, {PRED} as pred from post) select truth, count(*) as n, round(avg((pred <> truth and pred = 0)::int), 6) as to_stable, round(avg((pred <> truth and pred > 0)::int), 6) as to_change from x group by 1")
def m8(spark, d):
    wrong = F.col("pred") != F.col("truth")
    return table(spark, d).groupBy("truth").agg(F.count("*").alias("n"), F.avg((wrong & (F.col("pred") == 0)).cast("double")).alias("to_stable"), F.avg((wrong & (F.col("pred") > 0)).cast("double")).alias("to_change"))


@query("m24_curve_slopes", f"with {POSTERIORS}, a as (select truth, fold, avg(({PRED} = truth)::int) as v from post group by 1, 2) select truth, round(regr_slope(v, fold), 6) as slope, round(min(v), 6) as low, round(max(v), 6) as high, case when max(v) - min(v) < 0.01 then 'flat' when regr_slope(v, fold) > 0 then 'rising' else 'falling' end as verdict from a group by 1")
def m24(spark, d):
    a = table(spark, d).groupBy("truth", "fold").agg(F.avg((F.col("pred") == F.col("truth")).cast("double")).alias("v"))
    s = a.groupBy("truth").agg(F.regr_slope("v", "fold").alias("slope"), F.min("v").alias("low"), F.max("v").alias("high"))
    return s.withColumn("verdict", F.when(F.col("high") - F.col("low") < 0.01, "flat").when(F.col("slope") > 0, "rising").otherwise("falling"))


@query("m27_label_state", f"with {POSTERIORS}, s as (select fold, {PRED} as cls, count(*) as support, avg(({PRED} = truth)::int) as precision from post group by 1, 2) select cls, round(avg(support), 4) as support, round(avg(precision), 6) as precision from s group by 1")
def m27(spark, d):
    s = table(spark, d).groupBy("fold", F.col("pred").alias("cls")).agg(F.count("*").alias("support"), F.avg((F.col("pred") == F.col("truth")).cast("double")).alias("precision"))
    return s.groupBy("cls").agg(F.round(F.avg("support"), 4).alias("support"), F.avg("precision").alias("precision"))


@query("m28_mann_whitney", "with r as (select o_orderstatus = 'F' as g, rank() over (order by o_custkey % 50) + (count(*) over (partition by o_custkey % 50) - 1) / 2.0 as r from orders), s as (select sum(r) filter (g) as R, count(*) filter (g) as a, count(*) filter (not g) as b from r), t as (select sum(c ** 3 - c) as ties from (select count(*)::double as c from orders group by o_custkey % 50)) select round((R - a * (a + 1) / 2.0 - a * b / 2.0) / sqrt(a::double * b / 12 * ((a + b + 1) - ties / ((a + b)::double * (a + b - 1)))), 6) as z from s, t")
def m28(spark, d):
    g = read(spark, d, "orders").groupBy((F.col("o_custkey") % 50).alias("v")).agg(F.count("*").alias("n"), F.count_if(F.col("o_orderstatus") == "F").alias("p"))
    r = W.prefix_sums(g, [], "v", "n", "before").withColumn("mid", F.col("before") + (F.col("n") + 1) / 2.0)
    s = r.agg(F.sum(F.col("p") * F.col("mid")).alias("R"), F.sum("p").cast("double").alias("a"), F.sum(F.col("n") - F.col("p")).cast("double").alias("b"), F.sum(F.pow("n", F.lit(3)) - F.col("n")).alias("ties"))
    a, b = F.col("a"), F.col("b")
    return s.select(((F.col("R") - a * (a + 1) / 2 - a * b / 2) / F.sqrt(a * b / 12 * ((a + b + 1) - F.col("ties") / ((a + b) * (a + b - 1))))).alias("z"))


@query("m33_metric_row", f"with {POSTERIORS}, x as (select truth, {PRED} as pred, fold from post), b as (select sum((truth > 0 and pred > 0)::int) as tp, sum((truth = 0 and pred > 0)::int) as fp, sum((truth > 0 and pred = 0)::int) as fn, avg((pred = truth)::int) as acc from x) select round(2 * tp / greatest(2 * tp + fp + fn, 1), 6) as change_f1, round(acc, 6) as accuracy from b")
def m33(spark, d):
    t = table(spark, d)
    b = M.binary(t, F.col("truth") > 0, F.col("pred") > 0).select(F.col("f1").alias("change_f1"))
    return b.crossJoin(F.broadcast(M.overall(M.confusion(t, "truth", "pred")).select("accuracy")))  # one row each


@query("c10_strategy_hybrid", "with n as (select o_orderkey, (row_number() over (order by o_totalprice, o_orderkey) - 1) / (count(*) over () - 1) as a, (row_number() over (order by o_custkey % 97, o_orderkey) - 1) / (count(*) over () - 1) as b from orders) select o_orderkey, round((a + b) / 2, 6) as score from n order by round((a + b) / 2, 9) desc, o_orderkey limit 60")
def c10(spark, d):
    o = read(spark, d, "orders").select("o_orderkey", "o_totalprice", (F.col("o_custkey") % 97).alias("v"))
    return W.rank_mean(o, ["o_totalprice", "v"], "o_orderkey").orderBy(F.desc(F.round("rank_mean", 9)), "o_orderkey").limit(60).select("o_orderkey", F.col("rank_mean").alias("score"))


_OWN = "case truth when 0 then p0 when 1 then p1 else p2 end"
_RANKED = "(p0 >= {p})::int + (p1 >= {p})::int + (p2 >= {p})::int".format(p=f"({_OWN})")


@query("c13_raps_scores", f"with {POSTERIORS} select fold, round(avg(case when p0 > ({_OWN}) then p0 else 0 end + case when p1 > ({_OWN}) then p1 else 0 end + case when p2 > ({_OWN}) then p2 else 0 end + 0.1 * greatest(0, {_RANKED} - 1)), 6) as raps, round(avg(greatest(p0, p1, p2) - ({_OWN})), 6) as margin, round(avg({_RANKED}), 6) as topk from post group by 1")
def c13(spark, d):
    own = F.get(P(), F.col("truth"))
    more = sum((F.when(F.col(p) > own, F.col(p)).otherwise(0.0) for p in ("p0", "p1", "p2")), F.lit(0.0))
    rank = sum(((F.col(p) >= own).cast("int") for p in ("p0", "p1", "p2")), F.lit(0))
    return posteriors(spark, d).groupBy("fold").agg(F.avg(more + 0.1 * F.greatest(F.lit(0), rank - 1)).alias("raps"), F.avg(F.greatest("p0", "p1", "p2") - own).alias("margin"), F.avg(rank).alias("topk"))


_LAC = f"round(1 - {_OWN}, 3)"


@query("c17_cross_conformal", f"with {POSTERIORS}, cal as (select {_LAC} as s, count(*) as n from post where fold <> 0 group by 1), tot as (select sum(n) as n from cal), t as (select id, truth, {_LAC} as s from post where fold = 0), p as (select t.id, (coalesce(sum(cal.n), 0) + 1) / (max(tot.n) + 1) as p from t left join cal on cal.s >= t.s, tot group by 1) select count(*) as n, round(avg((p > 0.1)::int), 6) as coverage, round(avg(p), 6) as mean_p from p".replace("left join cal on cal.s >= t.s, tot", "cross join tot left join cal on cal.s >= t.s"))
def c17(spark, d):
    t = posteriors(spark, d).select("fold", F.round(1 - F.get(P(), F.col("truth")), 3).alias("s"))
    both = t.groupBy("s").agg(F.count_if(F.col("fold") != 0).alias("c"), F.count_if(F.col("fold") == 0).alias("t"))
    run = W.prefix_sums(both, [], "s", "c", "below")
    n = both.agg(F.sum("c").alias("n"))
    p = run.crossJoin(F.broadcast(n)).withColumn("p", (F.col("n") - F.col("below") + 1) / (F.col("n") + 1))  # one row
    return p.agg(F.sum("t").alias("n"), (F.sum(F.when(F.col("p") > 0.1, F.col("t")).otherwise(0)) / F.sum("t")).alias("coverage"), (F.sum(F.col("p") * F.col("t")) / F.sum("t")).alias("mean_p"))


@query("c19_threshold_labels", f"with {POSTERIORS} select case when p0 - 0.5 >= p1 - 0.3 and p0 - 0.5 >= p2 - 0.2 then 0 when p1 - 0.3 >= p2 - 0.2 then 1 else 2 end as label, count(*) as n from post group by 1")
def c19(spark, d):
    margin = F.array(F.col("p0") - 0.5, F.col("p1") - 0.3, F.col("p2") - 0.2)
    return posteriors(spark, d).groupBy(S.argmax(margin).alias("label")).agg(F.count("*").alias("n"))


@query("c20_precautionary", f"with {POSTERIORS} select case when p1 >= 0.35 or p2 >= 0.35 then case when p2 > p1 then 2 else 1 end else 0 end as label, count(*) as n from post group by 1")
def c20(spark, d):
    change = F.exists(F.array("p1", "p2"), lambda p: p >= 0.35)
    return posteriors(spark, d).groupBy(F.when(change, S.argmax(F.array("p1", "p2")) + 1).otherwise(0).alias("label")).agg(F.count("*").alias("n"))


@query("c28_classifiers")
def c28(spark, d):
    from ..operators.models import MODELS, side_by_side

    li = read(spark, d, "lineitem").select((F.col("l_discount") >= 0.05).cast("double").alias("label"), "l_quantity", "l_tax", "l_extendedprice", (F.col("l_orderkey") % 2).alias("fold"))
    names = sorted(MODELS)
    test = side_by_side(li.filter("fold = 0"), li.filter("fold = 1"), ["l_quantity", "l_tax", "l_extendedprice"], names)
    right = test.agg(*[F.avg((F.col(name) == F.col("label")).cast("double")).alias(name) for name in names])
    return right.select(F.inline(F.array(*[F.struct(F.lit(name).alias("model"), F.col(name).alias("accuracy")) for name in names])))


@query("c42_routing", f"with {POSTERIORS} select fold % 2 as covered, round(avg(case when fold % 2 = 1 then p1 else p0 end), 6) as p from post group by 1")
def c42(spark, d):
    t = posteriors(spark, d).withColumn("covered", F.col("fold") % 2)
    both = t.filter("covered = 1").select("covered", F.col("p1").alias("p")).unionByName(t.filter("covered = 0").select("covered", F.col("p0").alias("p")))
    return both.groupBy("covered").agg(F.avg("p").alias("p"))


@query("c43_view_average", f"with {POSTERIORS}, v as (select id, p0 as p from post union all select id, p1 from post where fold > 2) select round(avg(m), 6) as mean, round(max(m), 6) as largest from (select id, avg(p) as m from v group by 1)")
def c43(spark, d):
    t = posteriors(spark, d)
    v = t.select("id", F.col("p0").alias("p")).union(t.filter("fold > 2").select("id", "p1"))
    return v.groupBy("id").agg(F.avg("p").alias("m")).agg(F.avg("m").alias("mean"), F.max("m").alias("largest"))


@query("c44_leave_one_out_ensemble", f"with {POSTERIORS} select truth, k as left_out, round(avg(p0), 6) as p0 from post, (select unnest(range(0, 5)) as k) where fold <> k group by 1, 2")
def c44(spark, d):
    g = posteriors(spark, d).groupBy("truth", "fold").agg(F.sum("p0").alias("s"), F.count("*").alias("n"))
    t = g.groupBy("truth").agg(F.sum("s").alias("all_s"), F.sum("n").alias("all_n"))
    return g.join(t, "truth").select("truth", F.col("fold").alias("left_out"), ((F.col("all_s") - F.col("s")) / (F.col("all_n") - F.col("n"))).alias("p0"))


@query("c47_composition", f"with {POSTERIORS} select fold, round(avg((p1 + p2) * (p1 * p1) / (p1 * p1 + p2 * p2)), 6) as p1 from post group by 1")
def c47(spark, d):
    sharp = (F.col("p1") + F.col("p2")) * F.col("p1") ** 2 / (F.col("p1") ** 2 + F.col("p2") ** 2)
    return posteriors(spark, d).groupBy("fold").agg(F.avg(sharp).alias("p1"))


@query("c48_deploy_threshold", f"with {POSTERIORS}, r as (select {_LAC} as s, row_number() over (order by {_LAC}) as rn, count(*) over () as n from post where fold = 0), q as (select max(case when rn = ceil(round((n + 1) * 0.9, 9)) then s end) as q from r) select (round(1 - p0, 3) <= q)::int + (round(1 - p1, 3) <= q)::int + (round(1 - p2, 3) <= q)::int as size, count(*) as n from post, q where fold > 0 group by 1")
def c48(spark, d):
    t = posteriors(spark, d)
    q = M.split_quantile(t.filter("fold = 0").select(F.round(1 - F.get(P(), F.col("truth")), 3).alias("s")), "s", 0.1)
    size = sum(((F.round(1 - F.col(p), 3) <= F.col("q")).cast("int") for p in ("p0", "p1", "p2")), F.lit(0))
    return t.filter("fold > 0").crossJoin(F.broadcast(q.select("q"))).groupBy(size.alias("size")).agg(F.count("*").alias("n"))  # one row


@query("j17_footprint", "with y as (select l_partkey, year(l_shipdate) as y, min(l_orderkey) as first from lineitem where l_quantity > 25 and l_discount between 0.02 and 0.08 group by 1, 2) select a.l_partkey, a.first as a, b.first as b from y a join y b using (l_partkey) where a.y = 1998 and b.y = 1999")
def j17(spark, d):
    y = read(spark, d, "lineitem").filter("l_quantity > 25 and l_discount between 0.02 and 0.08").groupBy("l_partkey", F.year("l_shipdate").alias("y")).agg(F.min("l_orderkey").alias("first"))
    return y.filter("y = 1998").select("l_partkey", F.col("first").alias("a")).join(y.filter("y = 1999").select("l_partkey", F.col("first").alias("b")), "l_partkey")


@query("j21_draw_covariates", "select p_size, count(*) as n from (select distinct l_partkey from lineitem where l_quantity > 49) join part on p_partkey = l_partkey group by 1")
def j21(spark, d):
    draw = read(spark, d, "lineitem").filter("l_quantity > 49").select(F.col("l_partkey").alias("p_partkey")).distinct()
    return draw.join(read(spark, d, "part"), "p_partkey").groupBy("p_size").agg(F.count("*").alias("n"))


@query("j24_calibration_pool", "select coalesce(c_mktsegment_, 'unknown') as cover, count(*) as n from orders left join (select c_custkey, c_nationkey::varchar as c_mktsegment_ from customer where c_acctbal > 0) on c_custkey = o_custkey group by 1")
def j24(spark, d):
    c = read(spark, d, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").cast("string").alias("cover"))
    return read(spark, d, "orders").join(c, "o_custkey", "left").groupBy(F.coalesce("cover", F.lit("unknown")).alias("cover")).agg(F.count("*").alias("n"))


@query("s18_uncertain_fill", f"with {POP}, t as (select id from pop where stratum = 'A_F'), r as (select id, stratum, score from pop where id not in (select id from t)) select id from r order by score desc, {K(61, 'id')}, id limit 40")
def s18(spark, d):
    p = population(spark, d)
    return p.join(p.filter("stratum = 'A_F'").select("id"), "id", "left_anti").orderBy(F.desc("score"), key(61, "id"), "id").limit(40).select("id")


@query("s27_resample_pool", f"with {POP}, r as (select id, stratum, row_number() over (partition by stratum order by id) - 1 as rn, count(*) over (partition by stratum) as n from pop), sn as (select stratum, max(n) as n from r group by 1), sl as (select stratum, i, ('0x' || substr(md5('62|' || stratum || '|' || i), 1, 13))::bigint % n as rn from sn, (select unnest(range(1, 51)) as i)) select r.id || '#dup' || i as id, stratum from sl join r using (stratum, rn)")
def s27(spark, d):
    p = population(spark, d).select("id", "stratum")
    r = p.withColumn("rn", F.row_number().over(Window.partitionBy("stratum").orderBy("id")) - 1)
    n = p.groupBy("stratum").agg(F.count("*").alias("n"))
    w = n.select("stratum", "n", F.explode(F.sequence(F.lit(1), F.lit(50))).alias("i")).withColumn("rn", (key(62, "stratum", "i") % F.col("n")).cast("int"))
    return w.join(r, ["stratum", "rn"]).select(F.concat("id", F.lit("#dup"), "i").alias("id"), "stratum")


@query("s28_pixel_subsample", f"with {_PX} select map_id, row, col from va where map_id = 'a' order by {K(63, 'row * 1000 + col')}, row, col limit 200")
def s28(spark, d):
    return maps(spark, d).filter("map_id = 'a' and code <> 255").orderBy(key(63, F.col("row") * 1000 + F.col("col")), "row", "col").limit(200).select("map_id", "row", "col")


@query("s31_spatial_folds")
def s31(spark, d):
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler

    from .scalars import points

    x, y, z = S.unit_sphere(F.col("lon"), F.col("lat"))
    p = VectorAssembler(inputCols=["x", "y", "z"], outputCol="features").transform(points(spark, d).select("c_custkey", "lon", x.alias("x"), y.alias("y"), z.alias("z")))
    f = KMeans(k=5, seed=3).fit(p).transform(p)
    west = f.groupBy("prediction").agg(F.avg("lon").alias("lon"), F.count("*").alias("n"))
    return west.select((F.row_number().over(Window.orderBy("lon")) - 1).alias("fold"), "n")  # five rows


@query("s32_grouped_folds", f"with {POSTERIORS}, b as (select fold as block, truth, count(*) as n from post group by 1, 2) select block % 3 as part, truth, sum(n)::bigint as n from b group by 1, 2")
def s32(spark, d):
    b = posteriors(spark, d).groupBy(F.col("fold").alias("block"), "truth").agg(F.count("*").alias("n"))
    return b.groupBy((F.col("block") % 3).alias("part"), "truth").agg(F.sum("n").alias("n"))


@query("r7_boundary_alignment", f"with {_PX}, g as (select p.map_id, p.row, p.col, abs(coalesce(r.code, p.code) - coalesce(l.code, p.code)) / 2.0 as g, exists (select 1 from va q where q.map_id = p.map_id and q.code <> p.code and abs(q.row - p.row) + abs(q.col - p.col) = 1) as edge from va p left join va r on r.map_id = p.map_id and r.row = p.row and r.col = p.col + 1 left join va l on l.map_id = p.map_id and l.row = p.row and l.col = p.col - 1) select map_id, round(avg(case when edge then g end) / avg(g), 6) as alignment from g group by 1")
def r7(spark, d):
    from ..operators import rasters as R

    e = R.edges(maps(spark, d))
    w = Window.partitionBy("map_id", "row").orderBy("col")
    at = lambda f, step: F.when(f("col").over(w) == F.col("col") + step, f("code").over(w))
    g = F.abs(F.coalesce(at(F.lead, 1), F.col("code")) - F.coalesce(at(F.lag, -1), F.col("code"))) / 2.0
    s = e.select("map_id", "edge", g.alias("g"))
    return s.groupBy("map_id").agg((F.avg(F.when(F.col("edge"), F.col("g"))) / F.avg("g")).alias("alignment"))


@query("r15_point_evidence", "select l_suppkey as point, mode_ as modal, round(avg(l_discount), 6) as p from lineitem join (select l_suppkey as k, l_linenumber as mode_ from (select l_suppkey, l_linenumber, row_number() over (partition by l_suppkey order by count(*) desc, l_linenumber) as rn from lineitem group by 1, 2) where rn = 1) on k = l_suppkey group by 1, 2")
def r15(spark, d):
    li = read(spark, d, "lineitem")
    m = li.groupBy("l_suppkey", "l_linenumber").agg(F.count("*").alias("n")).groupBy("l_suppkey").agg(F.max_by("l_linenumber", F.struct("n", -F.col("l_linenumber"))).alias("modal"))
    return li.groupBy("l_suppkey").agg(F.avg("l_discount").alias("p")).join(m, "l_suppkey").select(F.col("l_suppkey").alias("point"), "modal", "p")


@query("r20_map_agreement", f"with {_PX} select code, round(count(*) filter (map_id = 'a') / count(*), 6) as share_a, count(*) as n from va group by 1")
def r20(spark, d):
    return maps(spark, d).filter("code <> 255").groupBy("code").agg((F.count_if(F.col("map_id") == "a") / F.count("*")).alias("share_a"), F.count("*").alias("n"))


@query("j14_neighbour_purity", "with e as (select vec_id, label, embedding::double[] as v from embeddings), n as (select a.vec_id, a.label, b.label as other, row_number() over (partition by a.vec_id order by round(list_dot_product(a.v, b.v) / sqrt(list_dot_product(a.v, a.v) * list_dot_product(b.v, b.v)), 9) desc, b.vec_id) as rn from e a join e b on a.vec_id <> b.vec_id) select label, round(avg((label = other)::int), 6) as purity from n where rn <= 5 group by 1")
def j14(spark, d):
    e = read(spark, d, "embeddings")
    n = J.neighbours(e, "vec_id", "embedding", 5)
    lab = e.select("vec_id", "label")
    return n.join(lab, "vec_id").join(lab.select(F.col("vec_id").alias("other"), F.col("label").alias("other_label")), "other").groupBy("label").agg(F.avg((F.col("label") == F.col("other_label")).cast("double")).alias("purity"))

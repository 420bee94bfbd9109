"""Queries of composition reports, spacing, coverage, audits, label pools and further file sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import design as D
from ..operators import labels as L
from ..operators import metrics as M
from ..operators import rasters as R
from ..operators import sampling as A
from ..operators import spacing
from ..sources import tables
from .design import _LONG, _composition
from .labels import _AUDIT, _audit
from .metrics import _CONF, _LAC, _PC, PRED, P, table
from .rasters import _PX, maps
from .registry import query, read
from .roles import POP, POSTERIORS, READINGS, population, posteriors, readings
from .sampling import K
from .streams import scratch

_SHARES = "b as (select sum(p_k) filter (k = l and k < 2) as tot, sum(cov) filter (k < 2 and l < 2) as vbb from comp), sh as (select c.k, any_value(p_k) filter (k = l) / any_value(tot) as r, any_value(tot) as tot, sum(cov) filter (l = c.k) as vaa, sum(cov) filter (l < 2) as vab, any_value(vbb) as vbb from comp c, b where k < 2 group by 1), se as (select k, r, sqrt(greatest(0, vaa - 2 * r * vab + r * r * vbb)) / tot as s from sh), rep as (select 'area_' || k as item, p_k as est, sqrt(greatest(0, cov)) as se from comp where k = l and k < 2 union all select 'share_' || k, r, s from se union all select 'share_0_minus_1', (select r from se where k = 0) - (select r from se where k = 1), 2 * (select s from se where k = 0))"


@query("a19_composition_report", f"with {POP}, {_LONG}, {_SHARES} select item, round(est, 6) as est, round(se, 6) as se from rep")
def a19(spark, d):
    return D.composition_report(_composition(spark, d), 0, 1)


@query("a31_binomial_upper")
def a31(spark, d):
    counts = population(spark, d).groupBy("stratum").agg(F.sum("y").cast("long").alias("k"), F.count("*").alias("n"))
    return counts.withColumn("upper", M.binomial_upper_column("k", "n", 0.1))


@query("m4_class_modes", f"with {POSTERIORS}, {_CONF}, {_PC}, a as (select sum(n) filter (truth = 0 and pred = 0) / sum(n) filter (truth = 0) as s_kept, sum(n) filter (truth = 0 and pred = 1) / sum(n) filter (truth = 0) as s_other, coalesce(sum(n) filter (truth = 0 and pred > 1), 0) / sum(n) filter (truth = 0) as s_change, sum(n) filter (truth = 1 and pred = 0) / sum(n) filter (truth = 1) as o_kept from conf) select round(avg(f1), 6) as macro_f1, round(any_value(s_kept), 6) as stable_recall, round(any_value(s_other), 6) as stable_as_other, round(any_value(s_change), 6) as stable_as_change, round(any_value(o_kept), 6) as other_as_stable from pc, a")
def m4(spark, d):
    return M.stable_modes(M.confusion(table(spark, d), "truth", "pred"), 0, 1)


_DRAW = f"draw as (select c_custkey, c_nationkey, degrees(asin(sin(radians(-60)) + {K(38, 'c_custkey')} / 4503599627370496.0 * (sin(radians(84)) - sin(radians(-60))))) as lat, {K(37, 'c_custkey')} / 4503599627370496.0 * 360 - 180 as lon, c_acctbal from customer)"


@query("m32_land_share", f"with {_DRAW}, land as (select * from draw where c_acctbal >= 0), ax as (select 'zone' as axis, floor(lat / 30)::bigint::varchar as value from land union all select 'nation', c_nationkey::varchar from land) select axis, value, count(*) as n, round(count(*) / sum(count(*)) over (partition by axis), 6) as share from ax group by 1, 2")
def m32(spark, d):
    draw = A.equal_area_points(read(spark, d, "customer"), "c_custkey", 37).filter("c_acctbal >= 0")
    return M.shares_by_axis(draw, {"zone": F.floor(F.col("lat") / 30).cast("string"), "nation": F.col("c_nationkey").cast("string")})


@query("j15_minimum_distance", f"with {_DRAW} select c_custkey from draw a where c_custkey % 10 <> 0 and not exists (select 1 from draw b where b.c_custkey % 10 = 0 and pow((a.lon - b.lon) * cos(radians(a.lat)) * 111.32, 2) + pow((a.lat - b.lat) * 110.57, 2) < 300.0 * 300.0)")
def j15(spark, d):
    p = A.equal_area_points(read(spark, d, "customer"), "c_custkey", 37)
    pool = p.filter("c_custkey % 10 <> 0")
    return pool.join(spacing.too_close(pool, p.filter("c_custkey % 10 = 0"), "c_custkey", "lon", "lat", 300.0), "c_custkey", "left_anti").select("c_custkey")


@query("s11_novel_spread")
def s11(spark, d):
    p = A.equal_area_points(read(spark, d, "customer"), "c_custkey", 37).withColumn("wc", (F.col("c_nationkey") % 3).cast("string"))
    out = spacing.spread_by_stratum(p, "c_custkey", "wc", "c_acctbal", "lon", "lat", {"0": 20, "1": 20, "2": 20}, 300.0)
    return out.select("c_custkey", "wc", "c_acctbal", "lon", "lat")


@query("j25_covariates", f"with {POSTERIORS}, t as (select split_part(id, '-', 3)::bigint as partkey, ({PRED} <> truth)::int as wrong from post), c as (select p_partkey, min(p_size) as size from part where p_size % 5 > 0 group by 1) select coalesce(c.size // 10, -1)::bigint as bin, count(*) as n, round(avg(wrong), 6) as error from t left join c on partkey = p_partkey group by 1")
def j25(spark, d):
    t = table(spark, d).select(F.split("id", "-")[2].cast("long").alias("p_partkey"), (F.col("pred") != F.col("truth")).cast("double").alias("wrong"))
    c = read(spark, d, "part").filter("p_size % 5 > 0").groupBy("p_partkey").agg(F.min("p_size").alias("size"))
    return t.join(c, "p_partkey", "left").groupBy(F.coalesce(F.floor(F.col("size") / 10), F.lit(-1)).alias("bin")).agg(F.count("*").alias("n"), F.avg("wrong").alias("error"))


_SETS = "s as (select id, list_filter([0, 1, 2], lambda k: [p0, p1, p2][k + 1] >= 0.3) as a, list_filter([0, 1, 2], lambda k: [p0, p1, p2][k + 1] >= 0.2) as b from post)"


@query("u7_set_difference", f"with {POSTERIORS}, {_SETS} select list_aggregate(a, 'string_agg', '|') as sure, list_aggregate(list_filter(b, lambda k: not list_contains(a, k)), 'string_agg', '|') as between_, count(*) as n from s group by 1, 2")
def u7(spark, d):
    at_least = lambda t: F.filter(F.array(*[F.when(F.col(f"p{i}") >= t, F.lit(str(i))) for i in range(3)]), lambda x: x.isNotNull())
    s = posteriors(spark, d).select(at_least(0.3).alias("a"), at_least(0.2).alias("b"))
    text = lambda c: F.when(F.size(c) > 0, F.array_join(c, "|"))
    return s.groupBy(text(F.col("a")).alias("sure"), text(L.symmetric_difference("a", "b")).alias("between_")).agg(F.count("*").alias("n"))


@query("w6_cumulative_share", f"with {POP}, v as (select stratum, var_samp(score) as v from pop group by 1) select stratum, round(v / sum(v) over (), 6) as share, round(sum(v) over (order by v desc, stratum) / sum(v) over (), 6) as cumulative from v")
def w6(spark, d):
    return D.cumulative_share(population(spark, d).groupBy("stratum").agg(F.var_samp("score").alias("v")), "v", "stratum").select("stratum", "share", "cumulative")


@query("w11_neighbour_edges", f"with {_PX}, e as (select p.map_id, exists (select 1 from va q where q.map_id = p.map_id and q.row = p.row and q.col = p.col + 1 and q.code <> p.code) as r, exists (select 1 from va q where q.map_id = p.map_id and q.row = p.row + 1 and q.col = p.col and q.code <> p.code) as l from va p) select map_id, count(*) as n, count(*) filter (r) as right_, count(*) filter (l) as lower_ from e group by 1")
def w11(spark, d):
    return R.forward_edges(maps(spark, d)).groupBy("map_id").agg(F.count("*").alias("n"), F.count_if("right_differs").alias("right_"), F.count_if("lower_differs").alias("lower_"))


@query("p17_verdict", f"with {READINGS}, {_AUDIT} select point_id, verdict from vv")
def p17(spark, d):
    return L.per_point(_audit(spark, d), ("e0", "e1")).select("point_id", L.verdict(F.col("final1"), F.col("final2"), F.split("assigned", r"\|")).alias("verdict"))


@query("p18_mismatch_reason", f"with {READINGS}, {_AUDIT}, b as (select point_id, expert_id, arg_min(coalesce(transition, 'cannot interpret'), seq) as blind, arg_max(value, seq) as value from readings group by 1, 2) select point_id, a.expert_id, case when list_contains(string_split(assigned, '|'), final) then case when blind <> final then 'revised' else '' end when value < 10 then 'mixed pixel' else 'not_given' end as reason from aud a join b using (point_id, expert_id)")
def p18(spark, d):
    blind = readings(spark, d).groupBy("point_id", "expert_id").agg(F.min_by(L.call("transition"), "seq").alias("blind"), F.max_by("value", "seq").alias("value"))
    given = F.when(F.col("value") < 10, "mixed pixel").otherwise(" ")
    return _audit(spark, d).join(blind, ["point_id", "expert_id"]).select("point_id", "expert_id", L.reason(F.col("blind"), F.col("final"), F.split("assigned", r"\|"), given).alias("reason"))


@query("c16_pooled_sets", f"with {POSTERIORS}, cal as (select truth, {_LAC} as s, row_number() over (partition by truth order by {_LAC}) as rn, count(*) over (partition by truth) as n from post where fold < 3), q as (select truth as k, max(case when rn = ceil(round((n + 1) * 0.9, 9)) then s end) as q from cal group by 1), qs as (select coalesce(max(q) filter (k = 0), 'inf'::double) as q0, coalesce(max(q) filter (k = 1), 'inf'::double) as q1, coalesce(max(q) filter (k = 2), 'inf'::double) as q2 from q), t as (select (round(1 - p0, 6) <= q0)::int + (round(1 - p1, 6) <= q1)::int + (round(1 - p2, 6) <= q2)::int as size, {_LAC} <= case truth when 0 then q0 when 1 then q1 else q2 end as covered, isinf(q0)::int + isinf(q1)::int + isinf(q2)::int as infinite from post, qs where fold >= 3) select size::bigint as size, count(*) as n, round(avg(covered::int), 6) as coverage, max(infinite)::bigint as infinite from t group by 1")
def c16(spark, d):
    t = posteriors(spark, d)
    scored = t.select("truth", "fold", F.array(*[F.round(1 - F.col(f"p{i}"), 6) for i in range(3)]).alias("s"))
    sets = M.conformal_sets(scored.filter("fold < 3"), scored.filter("fold >= 3"), "s", "truth", 3, 0.1)
    return sets.groupBy("size").agg(F.count("*").alias("n"), F.avg(F.col("covered").cast("double")).alias("coverage"), F.max("infinite").alias("infinite"))


@query("c35_complete_plots", "with y as (select l_orderkey, max(l_quantity) filter (l_linenumber = 1) as a, max(l_quantity) filter (l_linenumber = 2) as b, max(l_quantity) filter (l_linenumber = 3) as c from lineitem group by 1) select floor(a / 20)::bigint as first, floor(c / 20)::bigint as last, floor(a / 20) <> floor(c / 20) as changed, count(*) as n from y where a is not null and b is not null and c is not null group by 1, 2, 3")
def c35(spark, d):
    wide = read(spark, d, "lineitem").groupBy("l_orderkey").agg(*[F.max(F.when(F.col("l_linenumber") == i, F.col("l_quantity"))).alias(f"y{i}") for i in (1, 2, 3)])
    state = lambda c: F.floor(F.col(c) / 20)
    return wide.dropna().groupBy(state("y1").alias("first"), state("y3").alias("last"), (state("y1") != state("y3")).alias("changed")).agg(F.count("*").alias("n"))


@query("c34_pool_rows", "with y as (select l_orderkey, l_linenumber as year, max(l_quantity) as q, floor(max(l_quantity) / 20)::bigint as s from lineitem where l_linenumber <= 4 group by 1, 2), o as (select *, first_value(s) over w as s0, lag(s) over w as before, row_number() over w as i, count(*) over (partition by l_orderkey) as n, min(s) over (partition by l_orderkey) as lo, max(s) over (partition by l_orderkey) as hi from y window w as (partition by l_orderkey order by year)) select arm, s as state, count(*) as n from (select 'endpoints' as arm, s from o where n > 1 and (i = 1 or i = n) union all select 'stable_years', s from o where n > 1 and lo = hi) group by 1, 2")
def c34(spark, d):
    y = read(spark, d, "lineitem").filter("l_linenumber <= 4").groupBy("l_orderkey", F.col("l_linenumber").alias("year")).agg(F.floor(F.max("l_quantity") / 20).alias("state"))
    return L.pool_arms(y, "l_orderkey", "year", "state").groupBy("arm", "state").agg(F.count("*").alias("n"))


@query("c41_lumped_legend", f"with {POP} select fold, label, count(*) as n from (select case when before = after then 'Stable -> Stable' else before || ' -> ' || after end as label, cell % 5 as fold from pop) group by 1, 2")
def c41(spark, d):
    p = population(spark, d).withColumn("fold", F.col("cell") % 5)
    label = F.when(F.col("before") == F.col("after"), "Stable -> Stable").otherwise(F.concat_ws(" -> ", "before", "after"))
    return p.groupBy("fold", label.alias("label")).agg(F.count("*").alias("n"))


_THR = "t as (select truth, avg(case truth when 0 then p0 when 1 then p1 else p2 end) as thr from post group by 1), w as (select max(case when truth = 0 then thr end) as t0, max(case when truth = 1 then thr end) as t1, max(case when truth = 2 then thr end) as t2 from t), c as (select id, truth, case when p0 >= t0 and p0 >= case when p1 >= t1 then p1 else -1 end and p0 >= case when p2 >= t2 then p2 else -1 end then 0 when p1 >= t1 and p1 >= case when p2 >= t2 then p2 else -1 end then 1 when p2 >= t2 then 2 end as conf from post, w)"


@query("c39_relabelled", f"with {POSTERIORS}, {_THR} select coalesce(conf, truth)::bigint as label, count(*) as n, count(*) filter (conf <> truth) as moved from c group by 1")
def c39(spark, d):
    c = M.confident_class(table(spark, d), ["p0", "p1", "p2"], "truth")
    return c.groupBy(F.coalesce("confident", "truth").alias("label")).agg(F.count("*").alias("n"), F.count_if(F.col("confident") != F.col("truth")).alias("moved"))


@query("io2_cached_areas", "select s_nationkey::bigint as id, round(sum(round(s_acctbal, 2)), 6) as m2 from supplier group by 1 having sum(round(s_acctbal, 2)) > 0")
def io2(spark, d):
    shards, cache = scratch(spark), scratch(spark)
    read(spark, d, "supplier").select(F.col("s_nationkey").cast("string").alias("stratum"), F.round("s_acctbal", 2).cast("decimal(18,2)").cast("string").alias("area")).repartition(4).write.option("header", True).csv(shards)
    tables.cached_areas(spark, shards, cache)
    return tables.cached_areas(spark, shards + "-gone", cache)  # the second call reads the cache alone


@query("io3_cell_areas", "select case when s_suppkey % 2 = 0 then 'c' || s_nationkey else 'shard' end as cell, round(sum(round(s_acctbal, 2)), 6) as m2 from supplier group by 1")
def io3(spark, d):
    folder = scratch(spark)
    s = read(spark, d, "supplier")
    s.select(F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit("c"), "s_nationkey")).alias("cell"), F.round("s_acctbal", 2).cast("decimal(18,2)").cast("string").alias("area")).write.option("header", True).csv(folder)
    return tables.cell_areas(spark, folder).groupBy(F.when(F.col("cell").startswith("part-"), "shard").otherwise(F.col("cell")).alias("cell")).agg(F.sum("m2").alias("m2"))


@query("io8_quoted_text", "select doc_id::varchar as doc_id, md5(text) as digest from documents where text is not null and text <> ''")
def io8(spark, d):
    folder = scratch(spark) + ".csv"
    out = read(spark, d, "documents").filter("text is not null and text <> ''").select(F.col("doc_id").cast("string").alias("doc_id"), "text", "lang")
    out.write.option("header", True).option("quoteAll", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(folder)
    return tables.candidates(spark, folder).select("doc_id", F.md5("text").alias("digest"))


@query("io16_legend", "select p_partkey as code, 'size ' || p_size as label from part")
def io16(spark, d):
    folder = scratch(spark)
    p = read(spark, d, "part")
    tag = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit('<item value="'), "p_partkey", F.lit('" label="size '), "p_size", F.lit('"/>'))).otherwise(F.concat(F.lit('<item label="size '), "p_size", F.lit('" alpha="255" value="'), "p_partkey", F.lit('"/>')))
    p.select(tag.alias("value")).write.text(folder)
    return tables.legend(spark, folder)


@query("io9_normalised_points", "with x as (select s_suppkey, s_acctbal, row_number() over (order by s_suppkey) - 1 as i from supplier) select case when s_suppkey % 3 = 0 then 'p' || s_suppkey when s_suppkey % 3 = 1 then 'q' || s_suppkey else 'b7_' || lpad(i::varchar, greatest(4, length(i::varchar))::int, '0') end as id, round(s_acctbal / 100, 4) as lon, case when s_suppkey % 2 = 0 then s_suppkey else i + 1 end::double as rank, 5.0::double as cell_km, case when s_suppkey % 4 = 0 then 'x' || s_suppkey end as extra from x where s_suppkey % 5 <> 0")
def io9(spark, d):
    s = read(spark, d, "supplier").withColumn("seq", F.col("s_suppkey"))
    key = F.col("s_suppkey")
    raw = s.select("seq", F.when(key % 3 == 0, F.concat(F.lit("p"), key)).alias("id"), F.when(key % 3 == 1, F.concat(F.lit("q"), key)).alias("plot_id"), F.round(F.col("s_acctbal") / 100, 4).cast("string").alias("longitude"), F.when(key % 5 == 0, "n/a").otherwise("12.5").alias("y"), F.when(key % 2 == 0, key.cast("string")).otherwise("").alias("rank"), F.when(key % 4 == 0, F.concat(F.lit("x"), key)).alias("habitat"))
    return tables.normalised_points(raw, "b7", "seq").select("id", "lon", "rank", "cell_km", F.col("meta")["habitat"].alias("extra"))


@query("io20_ledger_migration", "select o_orderstatus as arm, count(*) as n, 0::bigint as scored, count(distinct case when o_orderkey % 2 = 0 then 'unstated' end) as splits from orders group by 1")
def io20(spark, d):
    old = read(spark, d, "orders").select(F.col("o_orderstatus").alias("arm"), "o_orderkey")
    new = tables.migrated(old, {"score": ("double", None), "split": ("string", "unstated")})
    return new.groupBy("arm").agg(F.count("*").alias("n"), F.count("score").alias("scored"), F.count_distinct(F.when(F.col("o_orderkey") % 2 == 0, F.col("split"))).alias("splits"))

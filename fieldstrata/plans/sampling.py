"""Queries of ranks, allocations, draws, set operations and joins."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..functions.keyed import key
from ..operators import joins as J
from ..operators import sampling as A
from ..operators import windows as W
from .registry import query, read
from .roles import POP, READINGS, areas, labelled, population, predicted, readings


def K(seed: int, ident: str) -> str:
    return f"('0x' || substr(md5('{seed}|' || {ident}), 1, 13))::bigint"


@query("w1_keep_last", f"with {READINGS} select point_id, seq from (select *, row_number() over (partition by point_id order by seq desc) as rn from readings) where rn = 1")
def w1(spark, d):
    return readings(spark, d).groupBy("point_id").agg(F.max("seq").alias("seq"))


@query("w2_percentile_rank", "select o_orderpriority, o_custkey % 7 as v, round(avg(p), 6) as pct from (select *, (rank() over (partition by o_orderpriority order by o_custkey % 7) + (count(*) over (partition by o_orderpriority, o_custkey % 7) - 1) / 2.0) / count(*) over (partition by o_orderpriority) as p from orders) group by 1, 2")
def w2(spark, d):
    o = read(spark, d, "orders").select("o_orderpriority", (F.col("o_custkey") % 7).alias("v"))
    return W.percentile_rank(o, "v", ["o_orderpriority"]).groupBy("o_orderpriority", "v").agg(F.avg("pct").alias("pct"))


@query("w3_rank_mean", "with n as (select c_custkey, (row_number() over (order by c_acctbal, c_custkey) - 1) / (count(*) over () - 1) as a, (row_number() over (order by c_nationkey, c_custkey) - 1) / (count(*) over () - 1) as b from customer) select c_custkey, round((a + 2 * b) / 3, 6) as rank_mean from n")
def w3(spark, d):
    return W.rank_mean(read(spark, d, "customer"), ["c_acctbal", "c_nationkey"], "c_custkey", [1.0, 2.0]).select("c_custkey", "rank_mean")


@query("w4_order_to_score", "with o as (select c_custkey, row_number() over (order by c_acctbal desc, c_custkey) - 1 as r from customer), t as (select count(*) as n from customer) select c.c_custkey, round(case when r < 50 then 1 - r / n else 0 end, 6) as score from customer c join o using (c_custkey), t")
def w4(spark, d):
    c = read(spark, d, "customer")
    top = c.orderBy(F.desc("c_acctbal"), "c_custkey").limit(50).select("c_custkey", (F.row_number().over(Window.orderBy(F.desc("c_acctbal"), "c_custkey")) - 1).alias("r"))
    n = c.agg(F.count("*").alias("n"))
    return c.join(F.broadcast(top), "c_custkey", "left").crossJoin(F.broadcast(n)).select("c_custkey", F.coalesce(1 - F.col("r") / F.col("n"), F.lit(0.0)).alias("score"))  # 50 rows, one row


@query("w5_rank_stamp", "select s_suppkey, row_number() over (order by s_acctbal desc, s_suppkey) as rank from supplier")
def w5(spark, d):
    return W.numbered(read(spark, d, "supplier"), [F.desc("s_acctbal"), F.col("s_suppkey")]).select("s_suppkey", "rank")


@query("w7_zscore", "select n_regionkey, round(sum(abs(z)), 5) as s from (select n_regionkey, (s_acctbal - avg(s_acctbal) over (partition by n_regionkey)) / stddev_samp(s_acctbal) over (partition by n_regionkey) as z from supplier join nation on n_nationkey = s_nationkey) group by 1")
def w7(spark, d):
    s = read(spark, d, "supplier").join(read(spark, d, "nation"), F.col("n_nationkey") == F.col("s_nationkey"))
    return W.zscore(s, "n_regionkey", "s_acctbal").groupBy("n_regionkey").agg(F.round(F.sum(F.abs("z")), 5).alias("s"))


@query("w8_segments", "with o as (select o_custkey, o_orderkey, o_orderkey % 5 as fold, lag(o_orderkey % 5) over (partition by o_custkey order by o_orderkey) as before from orders), s as (select *, sum(coalesce((fold <= before)::int, 0)) over (partition by o_custkey order by o_orderkey rows unbounded preceding) as segment from o) select o_custkey, segment::bigint as segment, count(*) as n, max(fold) + 1 as folds from s group by 1, 2")
def w8(spark, d):
    o = read(spark, d, "orders").withColumn("fold", F.col("o_orderkey") % 5)
    return W.segments(o, ["o_custkey"], "o_orderkey", "fold").groupBy("o_custkey", "segment").agg(F.count("*").alias("n"), F.max("folds").alias("folds"))


@query("w9_year_spread", "select dim, round(avg(s), 6) as spread from (select l_suppkey, year(l_shipdate) % 3 as dim, stddev_pop(l_quantity) as s from lineitem group by 1, 2) group by 1")
def w9(spark, d):
    li = read(spark, d, "lineitem").withColumn("dim", F.year("l_shipdate") % 3)
    return W.year_spread(li, "l_suppkey", "dim", "l_quantity")


_TRAJ = "tr as (select vec_id // 5 as plot, vec_id % 5 as year, embedding::double[] as v from embeddings), pd as (select a.plot, a.year as ya, b.year as yb, 1 - list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v))) as dist from tr a join tr b using (plot)), rw as (select plot, ya, sum(dist) as total from pd group by 1, 2)"


@query("w10_loo_medoid", f"with {_TRAJ}, c as (select pd.plot, pd.yb as year, pd.ya, pd.dist, row_number() over (partition by pd.plot, pd.yb order by round(total - dist, 12), pd.ya) as rn from pd join rw on rw.plot = pd.plot and rw.ya = pd.ya where pd.ya <> pd.yb) select plot, year, round(dist, 6) as anomaly from c where rn = 1")
def w10(spark, d):
    e = read(spark, d, "embeddings").select(F.floor(F.col("vec_id") / 5).alias("plot"), (F.col("vec_id") % 5).alias("year"), "embedding")
    return W.loo_medoid(e, "plot", "year", "embedding")


_ALLOC = "al as (select stratum, area, area / sum(area) over () * (300 - count(*) over () * 5) as x from areas), qt as (select stratum, (floor(x) + 5 + (row_number() over (order by round(x - floor(x), 9) desc, stratum) <= 300 - 5 * (count(*) over ()) - sum(floor(x)) over ())::int)::bigint as quota from al)"


@query("s1_allocate", f"with {POP}, {_ALLOC} select stratum, quota from qt")
def s1(spark, d):
    return A.allocate(areas(spark, d), 300, 5).select("stratum", "quota")


@query("s2_allocate_cells", f"with {POP}, {_ALLOC}, c as (select stratum, cell % 9 as cell, count(*)::double as a from pop group by 1, 2), x as (select c.*, a / sum(a) over (partition by stratum) * quota as x, quota from c join qt using (stratum)) select stratum, cell, (floor(x) + (row_number() over (partition by stratum order by round(x - floor(x), 9) desc, cell) <= quota - sum(floor(x)) over (partition by stratum))::int)::bigint as n from x")
def s2(spark, d):
    cells = population(spark, d).groupBy("stratum", (F.col("cell") % 9).alias("cell")).agg(F.count("*").cast("double").alias("a"))
    return A.allocate_cells(cells, A.allocate(areas(spark, d), 300, 5), "stratum", "cell", "a")


@query("s3_stratified_draw", f"with {POP}, {_ALLOC}, n as (select stratum, count(*) as n from pop group by 1), r as (select *, row_number() over (partition by stratum order by {K(31, 'id')}, id) as rn from pop) select id, stratum, round(least(quota, n) / n, 6) as incl_prob from r join n using (stratum) join qt using (stratum) where rn <= least(quota, n)")
def s3(spark, d):
    return A.stratified_draw(population(spark, d), "stratum", A.allocate(areas(spark, d), 300, 5), 31, "id", 300).select("id", "stratum", "incl_prob")


@query("s4_deficit_allocation", "with l as (select l_returnflag as s, count(*)::double as n from lineitem where l_linenumber = 1 group by 1), t as (select l_returnflag as s, count(*)::double as m, avg((l_discount > 0.05)::int) as err from lineitem group by 1), x as (select s, greatest(0, m / sum(m) over () - n / sum(n) over () + 0.02) * err as w from l join t using (s)), y as (select s, w / sum(w) over () * 100 as x from x) select s as stratum, (floor(x) + (row_number() over (order by round(x - floor(x), 9) desc, s) <= 100 - sum(floor(x)) over ())::int)::bigint as quota from y")
def s4(spark, d):
    li = read(spark, d, "lineitem").withColumn("stratum", F.col("l_returnflag"))
    n = li.filter("l_linenumber = 1").groupBy("stratum").agg(F.count("*").alias("n"))
    t = li.groupBy("stratum").agg(F.count("*").alias("m"), F.avg((F.col("l_discount") > 0.05).cast("double")).alias("err"))
    every = Window.partitionBy()
    gap = F.col("m") / F.sum("m").over(every) - F.col("n") / F.sum("n").over(every) + 0.02
    return A.allocate(n.join(t, "stratum").withColumn("w", F.greatest(F.lit(0.0), gap) * F.col("err")), 100, 0, "w").select("stratum", "quota")


@query("s5_nested_subset", f"with {POP} select stratum, id from (select *, row_number() over (partition by stratum order by {K(33, 'id')}, id) as rn from pop) where rn <= 40")
def s5(spark, d):
    return A.top_per_group(population(spark, d).withColumn("k", key(33, "id")), ["stratum"], [F.col("k"), F.col("id")], 40).select("stratum", "id")


@query("s6_cell_draw", f"with {POP} select stratum, cell, id from (select *, row_number() over (partition by stratum, cell order by {K(34, 'id')}, id) as rn from pop) where rn <= 2")
def s6(spark, d):
    return A.top_per_group(population(spark, d).withColumn("k", key(34, "id")), ["stratum", "cell"], [F.col("k"), F.col("id")], 2).select("stratum", "cell", "id")


@query("s7_state_quota", f"select o_orderstatus, o_orderkey from (select *, row_number() over (partition by o_orderstatus order by {K(35, 'o_orderkey')}, o_orderkey) as rn from orders) where rn <= 50")
def s7(spark, d):
    return A.top_per_group(read(spark, d, "orders").withColumn("k", key(35, "o_orderkey")), ["o_orderstatus"], [F.col("k"), F.col("o_orderkey")], 50).select("o_orderstatus", "o_orderkey")


@query("s8_weighted_draw", f"select o_orderkey from (select o_orderkey, round(-ln(1 - {K(36, 'o_orderkey')} / 4503599627370496.0) / o_totalprice, 9) as k from orders) order by k, o_orderkey limit 80")
def s8(spark, d):
    return A.weighted_draw(read(spark, d, "orders"), "o_totalprice", 80, 36, "o_orderkey").select("o_orderkey")


@query("s9_equal_area_points", f"select c_custkey, round({K(37, 'c_custkey')} / 4503599627370496.0 * 360 - 180, 6) as lon, round(degrees(asin(sin(radians(-60)) + {K(38, 'c_custkey')} / 4503599627370496.0 * (sin(radians(84)) - sin(radians(-60))))), 6) as lat from customer")
def s9(spark, d):
    return A.equal_area_points(read(spark, d, "customer"), "c_custkey", 37).select("c_custkey", "lon", "lat")


@query("s10_capped_pool", f"with {POP} select stratum, count(*) as n from (select *, row_number() over (partition by stratum order by {K(39, 'id')}, id) as rn from pop) where rn <= greatest(40 * 8, 200) group by 1")
def s10(spark, d):
    return A.top_per_group(population(spark, d).withColumn("k", key(39, "id")), ["stratum"], [F.col("k"), F.col("id")], 320).groupBy("stratum").agg(F.count("*").alias("n"))


def _far(budget: int) -> str:
    """Greedy picks written out: the first is the row farthest from the mean, each other one the farthest from all before."""
    apart = "round(list_sum(list_transform(range(1, 65), lambda i: (e.v[i] - k.v[i]) * (e.v[i] - k.v[i]))), 12)"
    steps = ["e as materialized (select vec_id, embedding::double[] as v from embeddings)", "k as (select list(m order by i) as v from (select i, avg(v[i]) as m from e, (select unnest(range(1, 65)) as i) group by 1))", f"d0 as (select e.vec_id, e.v, {apart} as d from e, k)"]
    for n in range(budget):
        steps.append(f"k{n} as materialized (select vec_id, v from d{n} order by d desc, vec_id limit 1)")
        far = apart.replace("k.v", f"k{n}.v")
        steps.append(f"d{n + 1} as materialized (select e.vec_id, e.v, {far if n == 0 else f'least(e.d, {far})'} as d from d{n} e, k{n})")
    return "with " + ", ".join(steps) + " " + " union all ".join(f"select vec_id, {n + 1}::bigint as pick from k{n}" for n in range(budget))


@query("s12_k_center", _far(8))
def s12(spark, d):
    return A.k_center(read(spark, d, "embeddings"), "vec_id", "embedding", 8)


def _balance(budget: int) -> str:
    """Greedy picks written out: k0, k1, ... are the picks, s0, s1, ... the running class counts before each."""
    cols = [f"c{i}" for i in range(1, 6)]
    steps = ["p as materialized (select o_custkey % 100 as patch, " + ", ".join(f"count(*) filter (o_orderpriority like '{i}%')::double as c{i}" for i in range(1, 6)) + " from orders group by 1)", "s0 as (select " + ", ".join(f"0.0::double as r{i}" for i in range(1, 6)) + ")"]
    for n in range(budget):
        total = " + ".join(f"(c{i} + r{i})" for i in range(1, 6))
        entropy = " + ".join(["0.0", *[f"case when c{i} + r{i} > 0 then -((c{i} + r{i}) / ({total}) * ln((c{i} + r{i}) / ({total}))) else 0 end" for i in range(1, 6)]])
        gone = " and ".join(f"patch <> (select patch from k{m})" for m in range(n)) or "true"
        steps += [f"k{n} as materialized (select patch, {', '.join(cols)} from p, s{n} where {gone} order by round({entropy}, 12) desc, patch limit 1)", f"s{n + 1} as materialized (select " + ", ".join(f"r{i} + c{i} as r{i}" for i in range(1, 6)) + f" from s{n}, k{n})"]
    return "with " + ", ".join(steps) + " " + " union all ".join(f"select patch, {n + 1}::bigint as pick from k{n}" for n in range(budget))


@query("s13_class_balance", _balance(6))
def s13(spark, d):
    p = read(spark, d, "orders").groupBy((F.col("o_custkey") % 100).alias("patch")).agg(*[F.count_if(F.col("o_orderpriority").startswith(str(i))).cast("double").alias(f"c{i}") for i in range(1, 6)])
    return A.class_balance(p, "patch", [f"c{i}" for i in range(1, 6)], 6)


@query("s14_diverse_order", f"with i as (select o_orderkey, o_orderpriority, row_number() over (partition by o_orderpriority order by {K(41, 'o_orderkey')}, o_orderkey) as depth from orders) select o_orderkey, o_orderpriority, depth from i order by depth, {K(42, 'o_orderpriority')}, o_orderpriority limit 33")
def s14(spark, d):
    return A.diverse_order(read(spark, d, "orders"), "o_orderpriority", 41, "o_orderkey", 33).select("o_orderkey", "o_orderpriority", "depth")


@query("s15_cutoff_hybrid", "with a as (select c_custkey from customer order by c_acctbal desc, c_custkey limit 20), b as (select c_custkey from customer where c_custkey not in (select c_custkey from a) order by c_acctbal, c_custkey limit 20) select c_custkey, 'a' as part from a union all select c_custkey, 'b' from b")
def s15(spark, d):
    c = read(spark, d, "customer")
    a = c.orderBy(F.desc("c_acctbal"), "c_custkey").limit(20).select("c_custkey", F.lit("a").alias("part"))
    b = c.join(F.broadcast(a), "c_custkey", "left_anti").orderBy("c_acctbal", "c_custkey").limit(20)  # 20 rows
    return a.union(b.select("c_custkey", F.lit("b").alias("part")))


@query("s16_sampling_surface", "with p as (select s_suppkey, exp(s_acctbal / 5000) as e from supplier), q as (select s_suppkey, greatest(e / sum(e) over (), 0.001) as p from p) select s_suppkey, round(p / sum(p) over (), 6) as p from q")
def s16(spark, d):
    every = Window.partitionBy()  # one row per cell of the surface; sums only
    p = read(spark, d, "supplier").select("s_suppkey", F.exp(F.col("s_acctbal") / 5000).alias("e"))
    q = p.select("s_suppkey", F.greatest(F.col("e") / F.sum("e").over(every), F.lit(0.001)).alias("p"))
    return q.select("s_suppkey", (F.col("p") / F.sum("p").over(every)).alias("p"))


@query("s17_pick_batch", f"select o_orderkey from orders order by round(o_totalprice / 50000) desc, {K(43, 'o_orderkey')}, o_orderkey limit 25")
def s17(spark, d):
    return read(spark, d, "orders").orderBy(F.desc(F.round(F.col("o_totalprice") / 50000)), key(43, "o_orderkey"), "o_orderkey").limit(25).select("o_orderkey")


@query("s20_rare_class_quota", f"with a as (select *, row_number() over (partition by o_orderpriority order by o_totalprice desc, o_orderkey) as big from orders), b as (select *, row_number() over (partition by o_orderpriority order by {K(44, 'o_orderkey')}, o_orderkey) as rn from a where big <= 30) select o_orderpriority, o_orderkey from b where rn <= 10")
def s20(spark, d):
    big = A.top_per_group(read(spark, d, "orders"), ["o_orderpriority"], [F.desc("o_totalprice"), F.col("o_orderkey")], 30)
    return A.top_per_group(big.withColumn("k", key(44, "o_orderkey")), ["o_orderpriority"], [F.col("k"), F.col("o_orderkey")], 10).select("o_orderpriority", "o_orderkey")


@query("s21_spaced_draw", f"with g as (select *, o_custkey // 50 as cx, (o_orderkey % 100) // 20 as cy, {K(45, 'o_orderkey')} as u from orders), o as (select * from (select *, row_number() over (partition by o_orderstatus, cx, cy order by u, o_orderkey) as rn from g) where rn = 1), m as (select o_orderstatus, o_orderkey, row_number() over (partition by o_orderstatus order by u, o_orderkey) as r2 from o) select o_orderstatus, o_orderkey from m where r2 <= 12")
def s21(spark, d):
    o = read(spark, d, "orders").select("o_orderstatus", "o_orderkey", F.col("o_custkey").alias("x"), ((F.col("o_orderkey") % 100) * 50 / 20).alias("y"))
    return A.spaced(o, ["o_orderstatus"], "x", "y", 50, 45, "o_orderkey", 12).select("o_orderstatus", "o_orderkey")


@query("s22_eligible_rank", "with p as (select o_custkey % 100 as patch, count(*) as n, avg(o_totalprice) as v from orders group by 1) select patch, round(case when n >= 100 then v end, 4) as score from p order by score desc nulls last, patch limit 40")
def s22(spark, d):
    p = read(spark, d, "orders").groupBy((F.col("o_custkey") % 100).alias("patch")).agg(F.count("*").alias("n"), F.avg("o_totalprice").alias("v"))
    return p.select("patch", F.round(F.when(F.col("n") >= 100, F.col("v")), 4).alias("score")).orderBy(F.desc_nulls_last("score"), "patch").limit(40)


@query("s23_cut_batches", "select c_custkey, (row_number() over (order by c_acctbal desc, c_custkey) - 1) // 100 as batch from customer")
def s23(spark, d):
    return W.numbered(read(spark, d, "customer"), [F.desc("c_acctbal"), F.col("c_custkey")]).select("c_custkey", F.floor((F.col("rank") - 1) / 100).alias("batch"))


@query("s24_round_robin", "select c_custkey, 'r' || (c_custkey % 3) as reader, 'r' || ((c_custkey + 1) % 3) as second from customer")
def s24(spark, d):
    return A.round_robin(read(spark, d, "customer"), "c_custkey", ["r0", "r1", "r2"]).select("c_custkey", "reader", "second")


@query("s25_expert_permutation", f"select k as batch, e, row_number() over (partition by k, e order by ('0x' || substr(md5('c1|' || k || '|' || e || '|' || o_orderkey), 1, 13))::bigint, o_orderkey) as place, o_orderkey from (select o_orderkey, o_custkey % 50 as k, unnest(['e0', 'e1']) as e from orders)")
def s25(spark, d):
    o = read(spark, d, "orders").select("o_orderkey", (F.col("o_custkey") % 50).alias("batch"), F.explode(F.array(F.lit("e0"), F.lit("e1"))).alias("e"))
    return o.withColumn("place", F.row_number().over(Window.partitionBy("batch", "e").orderBy(key("c1", "batch", "e", "o_orderkey"), "o_orderkey")))


@query("s26_nested_fractions", f"with r as (select o_orderpriority, o_orderkey, row_number() over (partition by o_orderpriority order by {K(46, 'o_orderkey')}, o_orderkey) as rn, count(*) over (partition by o_orderpriority) as n from orders) select f, o_orderpriority, count(*) as n from r, (select unnest([0.1, 0.25]::double[]) as f) where rn <= greatest(10, round(f * n)) group by 1, 2")
def s26(spark, d):
    o = read(spark, d, "orders")
    n = o.groupBy("o_orderpriority").agg(F.count("*").alias("n"))
    r = o.withColumn("k", key(46, "o_orderkey")).withColumn("rn", F.row_number().over(Window.partitionBy("o_orderpriority").orderBy("k", "o_orderkey"))).join(n, "o_orderpriority")
    f = r.withColumn("f", F.explode(F.array(F.lit(0.1), F.lit(0.25))))
    return f.filter(F.col("rn") <= F.greatest(F.lit(10.0), F.round(F.col("f") * F.col("n")))).groupBy("f", "o_orderpriority").agg(F.count("*").alias("n"))


_PACK = """with recursive b as (select o_custkey % 40 as block, count(*) as n, row_number() over (order by count(*) desc, o_custkey % 40) as i from orders group by 1),
r as (select 0::bigint as i, [0, 0, 0, 0, 0]::bigint[] as l, null::bigint as block, null::bigint as fold
 union all select i, list_transform(range(1, 6), lambda k: l[k] + case when k = f then n else 0 end), block, f - 1 from (select b.i, b.n, b.block, l, list_position(l, list_min(l)) as f from r join b on b.i = r.i + 1))
select block, fold from r where i > 0"""


@query("s29_block_folds", _PACK)
def s29(spark, d):
    return A.pack_blocks(read(spark, d, "orders").withColumn("block", F.col("o_custkey") % 40), "block", 5)


@query("s30_hash_folds", f"select {K(47, 'o_orderkey')} % 5 as fold, count(*) as n from orders group by 1")
def s30(spark, d):
    return read(spark, d, "orders").groupBy(A.hash_fold("o_orderkey", 5, 47).alias("fold")).agg(F.count("*").alias("n"))


@query("s33_leak_check", "select count(*) as shared from (select distinct o_custkey from orders where o_orderkey % 2 = 0 intersect select distinct o_custkey from orders where o_orderkey % 2 = 1)")
def s33(spark, d):
    o = read(spark, d, "orders")
    return A.shared_rows(o.filter("o_orderkey % 2 = 0"), o.filter("o_orderkey % 2 = 1"), ["o_custkey"]).agg(F.count("*").alias("shared"))


@query("u1_concatenate", "select count(*) as n, count(s_acctbal) as with_a, count(c_acctbal) as with_c from (select s_nationkey as k, s_acctbal, null as c_acctbal from supplier union all select c_nationkey, null, c_acctbal from customer)")
def u1(spark, d):
    s, c = read(spark, d, "supplier").select(F.col("s_nationkey").alias("k"), "s_acctbal"), read(spark, d, "customer").select(F.col("c_nationkey").alias("k"), "c_acctbal")
    return s.unionByName(c, allowMissingColumns=True).agg(F.count("*").alias("n"), F.count("s_acctbal").alias("with_a"), F.count("c_acctbal").alias("with_c"))


@query("u2_set_difference", "select l_partkey from lineitem where l_quantity > 45 except select l_partkey from lineitem where l_discount > 0.09")
def u2(spark, d):
    li = read(spark, d, "lineitem")
    return li.filter("l_quantity > 45").select("l_partkey").subtract(li.filter("l_discount > 0.09").select("l_partkey"))


@query("u3_intersection", "select l_partkey from lineitem where year(l_shipdate) = 1998 intersect select l_partkey from lineitem where year(l_shipdate) = 1999")
def u3(spark, d):
    li = read(spark, d, "lineitem")
    return li.filter("year(l_shipdate) = 1998").select("l_partkey").intersect(li.filter("year(l_shipdate) = 1999").select("l_partkey"))


@query("u4_keep_first", "select o_custkey, arg_min(o_orderkey, o_orderkey) as o_orderkey from orders group by 1")
def u4(spark, d):
    return J.keep_first(read(spark, d, "orders").select("o_custkey", "o_orderkey"), ["o_custkey"], "o_orderkey")


@query("u5_prefixed_ids", "select pool, count(*) as n, count(distinct id) as ids from (select 'c' as pool, 'c_' || c_custkey as id from customer union all select 's', 's_' || s_suppkey from supplier) group by 1")
def u5(spark, d):
    c, s = read(spark, d, "customer").select(F.lit("c").alias("pool"), F.concat_ws("_", F.lit("c"), "c_custkey").alias("id")), read(spark, d, "supplier").select(F.lit("s").alias("pool"), F.concat_ws("_", F.lit("s"), "s_suppkey").alias("id"))
    return c.union(s).groupBy("pool").agg(F.count("*").alias("n"), F.count_distinct("id").alias("ids"))


@query("u6_disjoint_draws", "select 0 as shared")
def u6(spark, d):
    return A.shared_rows(labelled(spark, d), predicted(spark, d), ["id"]).agg(F.count("*").alias("shared"))


@query("j1_stratum_lookup", "select n_name, cls, n_regionkey * 5 + cls as stratum_id from nation, (select unnest(range(1, 6)) as cls)")
def j1(spark, d):
    return J.stratum_lookup(read(spark, d, "nation").select("n_name", "n_regionkey"), "n_regionkey", 5).select("n_name", "cls", "stratum_id")


@query("j2_design_join", "select n_name, count(*) as n, count(s_suppkey) as matched from lineitem left join (select min(s_suppkey) as s_suppkey, s_suppkey as k, min(s_nationkey) as nk from supplier where s_acctbal > 0 group by 2) on l_suppkey = k left join nation on n_nationkey = nk group by 1")
def j2(spark, d):
    s = J.keep_first(read(spark, d, "supplier").filter("s_acctbal > 0").select("s_suppkey", "s_nationkey"), ["s_suppkey"], "s_nationkey")
    j = read(spark, d, "lineitem").join(s, F.col("l_suppkey") == F.col("s_suppkey"), "left").join(read(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"), "left")
    return j.groupBy("n_name").agg(F.count("*").alias("n"), F.count("s_suppkey").alias("matched"))


@query("j3_many_to_one", "select p_brand, count(*) as n from lineitem join part on p_partkey = l_partkey group by 1")
def j3(spark, d):
    p = read(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    return J.many_to_one(read(spark, d, "lineitem").select("l_partkey"), p, ["l_partkey"]).groupBy("p_brand").agg(F.count("*").alias("n"))


@query("j4_semi", "select count(*) as n from orders where o_custkey in (select c_custkey from customer where c_acctbal > 5000)")
def j4(spark, d):
    c = read(spark, d, "customer").filter("c_acctbal > 5000").select(F.col("c_custkey").alias("o_custkey"))
    return read(spark, d, "orders").join(c, "o_custkey", "left_semi").agg(F.count("*").alias("n"))


@query("j5_completeness", "select c_custkey from customer where c_custkey not in (select o_custkey from orders where o_orderstatus = 'F')")
def j5(spark, d):
    return read(spark, d, "customer").select("c_custkey").join(read(spark, d, "orders").filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti")


@query("j6_replacement", f"with {READINGS} select point_id, sum(seq)::bigint as s from (select point_id, seq from readings where point_id not in (select point_id from readings where seq % 400 < 20) union all select point_id, -seq from readings where seq % 400 < 20) group by 1")
def j6(spark, d):
    r = readings(spark, d)
    redo = r.filter("seq % 400 < 20").select("point_id", (-F.col("seq")).alias("seq"))
    return J.replaced(r.select("point_id", "seq"), redo, ["point_id"]).groupBy("point_id").agg(F.sum("seq").alias("s"))


@query("j7_exclude_labelled", f"with {READINGS} select count(*) as n from customer where c_custkey::varchar not in (select point_id from readings)")
def j7(spark, d):
    return J.exclude(read(spark, d, "customer"), "c_custkey", readings(spark, d), "point_id").agg(F.count("*").alias("n"))


@query("j8_fallback_join", "select coalesce(o_orderstatus, 'none') as s, count(*) as n from customer left join (select o_custkey, arg_max(o_orderstatus, o_orderkey) as o_orderstatus from orders group by 1) on o_custkey = c_custkey group by 1")
def j8(spark, d):
    last = read(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max_by("o_orderstatus", "o_orderkey").alias("s"))
    return read(spark, d, "customer").join(last, "c_custkey", "left").groupBy(F.coalesce("s", F.lit("none")).alias("s")).agg(F.count("*").alias("n"))


@query("j9_cardinality", "select 'o_custkey' as key, count(*) as violations from (select o_custkey from orders group by 1 having count(*) > 1) union all select 'o_orderkey', count(*) from (select o_orderkey from orders group by 1 having count(*) > 1)")
def j9(spark, d):
    o = read(spark, d, "orders")
    return J.violations(o, ["o_custkey"]).union(J.violations(o, ["o_orderkey"]))


@query("j10_membership", "select count(*) as n, count(s_suppkey) as matched from part left join supplier on s_suppkey = p_partkey")
def j10(spark, d):
    return J.membership(read(spark, d, "part"), read(spark, d, "supplier").select(F.col("s_suppkey").alias("p_partkey")), ["p_partkey"])


@query("j11_feature_attach", "select coalesce(mask, 0) as mask, count(*) as n from customer left join (select l_suppkey, 1 as mask from lineitem where l_quantity > 49 group by 1) on l_suppkey = c_custkey group by 1")
def j11(spark, d):
    f = read(spark, d, "lineitem").filter("l_quantity > 49").select(F.col("l_suppkey").alias("c_custkey")).distinct()
    return J.attach(read(spark, d, "customer"), f, ["c_custkey"]).groupBy("mask").agg(F.count("*").alias("n"))


@query("j12_fold_impute", "with t as (select o_orderkey % 3 as fold, case when o_orderkey % 4 > 0 then o_totalprice end as v from orders), s as (select sum(v) as sv, count(v) as nv from t), f as (select fold, sum(v) as fv, count(v) as fn from t group by 1) select t.fold, round(avg(coalesce(v, (sv - fv) / (nv - fn))), 4) as m from t join f using (fold), s group by 1")
def j12(spark, d):
    t = read(spark, d, "orders").select((F.col("o_orderkey") % 3).alias("fold"), F.when(F.col("o_orderkey") % 4 > 0, F.col("o_totalprice")).alias("v"))
    return J.impute_by_fold(t, "fold", "v").groupBy("fold").agg(F.round(F.avg("v"), 4).alias("m"))


@query("j13_nearest_reference", "select vec_id, round(min(1 - list_dot_product(q, r) / (sqrt(list_dot_product(q, q)) * sqrt(list_dot_product(r, r)))), 6) as distance from (select vec_id, embedding::double[] as q from embeddings where label <> 0), (select embedding::double[] as r from embeddings where label = 0) group by 1")
def j13(spark, d):
    e = read(spark, d, "embeddings")
    return J.nearest_reference(e.filter("label <> 0"), e.filter("label = 0"), "vec_id", "embedding")


@query("j16_radius", "select a.s_suppkey, count(*) as n from supplier a join supplier b on sqrt((a.s_acctbal - b.s_acctbal) ** 2 + (a.s_nationkey - b.s_nationkey) ** 2) <= 300 and a.s_suppkey <> b.s_suppkey group by 1")
def j16(spark, d):
    s = read(spark, d, "supplier").select("s_suppkey", F.col("s_acctbal").alias("x"), F.col("s_nationkey").cast("double").alias("y"))
    return J.within_radius(s, "s_suppkey", "x", "y", 300.0).groupBy("s_suppkey").agg(F.count("*").alias("n"))


@query("j18_block_filter", "select count(*) as n from orders where o_custkey % 40 in (select o_custkey % 40 from orders where o_orderkey % 97 = 0)")
def j18(spark, d):
    o = read(spark, d, "orders").withColumn("block", F.col("o_custkey") % 40)
    return o.join(o.filter("o_orderkey % 97 = 0").select("block").distinct(), "block", "left_semi").agg(F.count("*").alias("n"))


@query("j20_arm_vs_baseline", "with t as (select o_orderpriority as arm, year(o_orderdate) as round, o_orderstatus as fold, avg(o_totalprice) as m from orders group by 1, 2, 3) select a.arm, a.round, round(avg(a.m - b.m), 4) as delta, sum((a.m > b.m)::int)::bigint as wins, count(*) as n from t a join t b using (round, fold) where b.arm = '5-LOW' and a.arm <> '5-LOW' group by 1, 2")
def j20(spark, d):
    t = read(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("arm"), F.year("o_orderdate").alias("round"), F.col("o_orderstatus").alias("fold")).agg(F.avg("o_totalprice").alias("m"))
    return J.paired_arms(t, "arm", "5-LOW", ["round", "fold"], "m", ["round"]).withColumn("delta", F.round("delta", 4)).select("arm", "round", "delta", "wins", "n")


@query("j22_code_lookup", "select case n_regionkey when 0 then 'low' when 1 then 'mid' end as name, count(*) as n from nation group by 1")
def j22(spark, d):
    return read(spark, d, "nation").groupBy(S.lookup(F.col("n_regionkey").cast("int"), {0: "low", 1: "mid"}).alias("name")).agg(F.count("*").alias("n"))

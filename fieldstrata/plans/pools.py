"""Queries of training pools, their export, trajectories, cleaning, label import and nested evidence."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import design as D
from ..operators import pools as P
from ..sources import tables
from ..streaming import label_stream
from .registry import query, read
from .roles import POP, POSTERIORS, READINGS, areas, labelled, population, posteriors, readings
from .streams import scratch

YEARS = [2018, 2019, 2020, 2021]


def K(seed: int, ident: str) -> str:
    return f"('0x' || substr(md5(concat_ws('|', {seed}, {ident})), 1, 13))::bigint"


def plots(spark, d):
    """Four vectors behind one another are one plot's years; labels are its states."""
    e = read(spark, d, "embeddings").withColumn("plot", F.floor(F.col("vec_id") / 4)).withColumn("year", (F.col("vec_id") % 4 + 2018).cast("int"))
    state = F.concat(F.lit("s"), (F.floor(F.col("label") / 4)).cast("string"))
    pairs = lambda v: F.map_from_entries(F.collect_list(F.struct("year", v)))
    g = e.withColumn("state", state).withColumn("v", F.transform(F.slice("embedding", 1, 4), lambda x: x.cast("double"))).groupBy("plot").agg(pairs("state").alias("states"), pairs("v").alias("embeddings"))
    place = F.col("plot") % 30
    at = lambda y: F.element_at("states", F.lit(y))
    return g.select(F.concat(F.lit("p"), F.col("plot").cast("string")).alias("loc_id"), (place * 2.5).alias("lon"), (place * 1.5).alias("lat"), F.concat(F.lit("b"), (place % 6).cast("string")).alias("block_id"), "states", "embeddings", (at(2018) != at(2021)).alias("changed"))


def other(spark, d):
    """Another data set: one year's points."""
    e = read(spark, d, "embeddings").filter("vec_id % 2 = 0")
    place = F.col("vec_id") % 40
    return e.select(F.col("vec_id").cast("string").alias("loc_id"), (place * 2.0).alias("lon"), (place * 1.0).alias("lat"), F.concat(F.lit("b"), (place % 8).cast("string")).alias("block_id"), F.concat(F.lit("s"), F.floor(F.col("label") / 4).cast("string")).alias("state"), F.transform(F.slice("embedding", 1, 4), lambda x: x.cast("double")).alias("features"))


_PLOTS = """e as (select vec_id // 4 as plot, vec_id % 4 + 2018 as year, 's' || (label // 4) as state, embedding[1:4]::double[] as v from embeddings),
pl as (select 'p' || plot as loc_id, (plot % 30) * 2.5::double as lon, (plot % 30) * 1.5::double as lat, 'b' || (plot % 30 % 6) as block_id, max(state) filter (year = 2018) as s18, max(state) filter (year = 2021) as s21, max(state) filter (year = 2018) <> max(state) filter (year = 2021) as changed from e group by plot),
lg as (select pl.*, e.year, e.state as own, e.v from pl join e on 'p' || e.plot = pl.loc_id),
ends as (select loc_id, lon, lat, block_id, year, own as state, 'observed' as kind, 'plots' as source, changed, v from lg where year in (2018, 2021)),
stable as (select loc_id, lon, lat, block_id, year, s18 as state, 'assumed' as kind, 'plots' as source, changed, v from lg where year in (2019, 2020) and not changed),
pseudo as (select loc_id, lon, lat, block_id, year, null::varchar as state, 'pseudo' as kind, 'plots' as source, changed, v from lg where year in (2019, 2020) and changed),
sd as (select i, avg(s) as s from (select loc_id, i, stddev_pop(v[i]) as s from lg, (select unnest([1, 2, 3, 4]) as i) where not changed group by 1, 2) group by 1),
ot as (select 'other:' || vec_id as loc_id, (vec_id % 40) * 2.0::double as lon, (vec_id % 40) * 1.0::double as lat, 'b' || (vec_id % 40 % 8) as block_id, 2018 as year, 's' || (label // 4) as state, 'observed' as kind, 'other' as source, false as changed, embedding[1:4]::double[] as v from embeddings where vec_id % 2 = 0)"""
_BASE = "(select v as w, loc_id as l from lg where year = 2018)"


def _u(seed: int, ident: str) -> str:
    return f"({K(seed, ident)} / 4503599627370496.0::double)"


_ID = "concat_ws('|', t.loc_id, t.year, i - 1)"
_NOISE = f"sqrt(-2 * ln(1 - {_u(91, _ID)})) * cos({_u(92, _ID)} * 2 * pi())"
_SUMS = "count(*) as n, round(sum(v[1]), 6) as f0, round(sum(v[4]), 6) as f3"


def summed(pool):
    f = lambda i: F.sum(F.get("features", F.lit(i)))
    return pool.groupBy("kind", F.coalesce("state", F.lit("-")).alias("state"), "year").agg(F.count("*").alias("n"), f(0).alias("f0"), f(3).alias("f3"))


@query("c34_arms", f"with {_PLOTS} select kind, coalesce(state, '-') as state, year::bigint as year, {_SUMS} from (select * from ends union all select * from stable union all select * from pseudo) group by 1, 2, 3")
def c34_arms(spark, d):
    p = plots(spark, d)
    return summed(P.endpoints(p, 2018, 2021).unionByName(P.stable_years(p, 2018, [2019, 2020])).unionByName(P.pseudo_years(p, [2019, 2020])))


@query("c34_copies", f"with {_PLOTS} select 'synthetic' as kind, state, year::bigint as year, count(*) as n, round(sum(w[1]), 6) as f0, round(sum(w[4]), 6) as f3 from stable join {_BASE} on l = loc_id group by 2, 3")
def c34_copies(spark, d):
    return summed(P.stable_copies(plots(spark, d), 2018, [2019, 2020]))


@query("c34_jittered", f"with {_PLOTS}, j as (select t.loc_id, t.state, t.year, list(w[i] + s * {_NOISE} order by i) as v from stable t join {_BASE} on l = t.loc_id, sd group by 1, 2, 3) select 'synthetic' as kind, state, year::bigint as year, {_SUMS} from j group by 2, 3")
def c34_jittered(spark, d):
    p = plots(spark, d)
    return summed(P.stable_copies(p, 2018, [2019, 2020], P.year_spread(p, YEARS), 91))


def _drawn(name: str, source: str, count: str, seed: int) -> str:
    ident = "concat_ws('|', loc_id, year)"
    return f"n{name} as (select *, row_number() over (order by {K(seed, ident)}, loc_id, year) as rn, count(*) over () as have from {source}), {name} as (select n{name}.* replace (loc_id || '#dup' || slot as loc_id) from (select unnest(range(1, ({count}) + 1)) as slot) join n{name} on rn = floor({_u(seed + 1, 'slot')} * have) + 1)"


@query("c34_resampled", f"with {_PLOTS}, {_drawn('fp', '(select * from ot where block_id in (select block_id from ends))', 'select count(*) from ends', 93)}, {_drawn('st', chr(40) + 'select * from ot where state = ' + chr(39) + 's1' + chr(39) + chr(41), 'select count(*) from stable', 95)} select 'footprint' as control, block_id, state, count(*) as n, count(distinct loc_id) as places, round(sum(v[1]), 6) as f0 from fp group by 2, 3 union all select 'state', block_id, state, count(*), count(distinct loc_id), round(sum(v[1]), 6) from st group by 2, 3")
def c34_resampled(spark, d):
    p, pool = plots(spark, d), P.external(other(spark, d), "other", 2018)
    a = P.footprint_control(pool, P.endpoints(p, 2018, 2021), 93).withColumn("control", F.lit("footprint"))
    b = P.state_control(pool, "s1", P.stable_years(p, 2018, [2019, 2020]).agg(F.count("*").alias("n")), 95).withColumn("control", F.lit("state"))
    return a.unionByName(b).groupBy("control", "block_id", "state").agg(F.count("*").alias("n"), F.count_distinct("loc_id").alias("places"), F.sum(F.get("features", F.lit(0))).alias("f0"))


@query("c36_exported_pool", f"with {_PLOTS} select source || ':' || loc_id || ':' || year as sid, state, lon, lat, block_id, source, year::bigint as year, kind, round(v[1], 6) as f00, round(v[2], 6) as f01, round(v[3], 6) as f02, round(v[4], 6) as f03 from (select * from ends union all select * from stable union all select * from pseudo) where kind <> 'pseudo'")
def c36(spark, d):
    p = plots(spark, d)
    return P.exported(P.endpoints(p, 2018, 2021).unionByName(P.stable_years(p, 2018, [2019, 2020])).unionByName(P.pseudo_years(p, [2019, 2020])), 4)


@query("c37_two_level_pool", "with u as (select l_linenumber as fine, l_suppkey % 6 as coarse, year(l_shipdate) as y, l_returnflag as flag from lineitem), t as (select case fine when 1 then 'crop' when 2 then 'grass' else case coarse when 0 then 'built' when 1 then 'trees' end end as state from u where flag <> 'N' and y <= 1996 and coarse not in (4, 5)) select state, count(*) as n from t where state is not null group by 1")
def c37_two_level(spark, d):
    u = read(spark, d, "lineitem").select(F.col("l_linenumber").alias("fine"), (F.col("l_suppkey") % 6).alias("coarse"), F.year("l_shipdate").alias("y"), "l_returnflag")
    return P.tagged(u, "fine", "coarse", {1: "crop", 2: "grass"}, {0: "built", 1: "trees"}, [4, 5], F.col("l_returnflag") != "N", F.col("y") <= 1996).groupBy("state").agg(F.count("*").alias("n"))


@query("c37_second_source", "with p as (select o_orderkey as id, o_custkey % 50 as lon, o_custkey % 7 as lat from orders where o_orderstatus <> 'P'), t as (select p.*, case f when 'A' then 'crop' when 'R' then 'trees' end as state from p join (select l_orderkey, max(l_returnflag) as f from lineitem group by 1) on l_orderkey = id), k as (select *, row_number() over (partition by lon, lat order by id) as rn from t where state is not null) select state, count(*) as n, sum(id)::bigint as ids from k where rn = 1 group by 1")
def c37_second(spark, d):
    p = read(spark, d, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 50).alias("lon"), (F.col("o_custkey") % 7).alias("lat"), "o_orderstatus")
    second = read(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.max("l_returnflag").alias("l_returnflag"))
    t = P.tagged_by_second(p, second, "id", "l_returnflag", {"A": "crop", "R": "trees"}, F.col("o_orderstatus") != "P")
    return P.one_a_place(t, "id").groupBy("state").agg(F.count("*").alias("n"), F.sum("id").alias("ids"))


_COS = "1 - list_dot_product(a.v, b.v) / greatest(sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v)), 1e-12)"


@query("j26_trajectories", f"with {_PLOTS}, pd as (select a.loc_id, a.year as ya, b.year as yb, {_COS} as dist from lg a join lg b using (loc_id)), rw as (select loc_id, ya, sum(dist) as total, count(*) as n from pd group by 1, 2), c as (select pd.loc_id, pd.yb as year, pd.dist, row_number() over (partition by pd.loc_id, pd.yb order by round(total - dist, 12), pd.ya) as rn from pd join rw on rw.loc_id = pd.loc_id and rw.ya = pd.ya where pd.ya <> pd.yb and n >= 3), lo as (select loc_id, max(dist) as loo_max, avg(dist) as loo_mean, arg_max(year, round(dist, 12) * 1e6 - year / 1e6) as loo_year from c where rn = 1 group by 1), sc as (select a.loc_id, {_COS} as cosine, sqrt(list_sum(list_transform(range(1, 5), lambda i: pow(b.v[i] - a.v[i], 2)))) as l2 from lg a join lg b using (loc_id) where a.year = 2018 and b.year = 2021) select loc_id, round(cosine, 6) as cosine, round(l2, 6) as l2, round(loo_max, 6) as loo_max, round(loo_mean, 6) as loo_mean, loo_year::bigint as loo_year from sc join lo using (loc_id)")
def j26(spark, d):
    return P.with_trajectories(plots(spark, d), YEARS).select("loc_id", "cosine", "l2", "loo_max", "loo_mean", "loo_year")


_FLAGS = "th as (select avg(p0) filter (truth = 0) as t0, avg(p1) filter (truth = 1) as t1, avg(p2) filter (truth = 2) as t2 from post), pr as (select post.*, case when p0 >= p1 and p0 >= p2 then 0 when p1 >= p2 then 1 else 2 end as pred from post), fl as (select pr.*, pred <> truth and greatest(p0, p1, p2) >= case pred when 0 then t0 when 1 then t1 else t2 end as joint, case truth when 0 then p0 when 1 then p1 else p2 end as own from pr, th), cu as (select quantile_cont(own, 0.1) as q10, quantile_cont(own, 0.2) as q20 from fl)"


@query("c39_cleaned", f"with {POSTERIORS}, {_FLAGS} select 'prune_unsure_10' as method, truth::bigint as label, count(*) as n from fl, cu where own > q10 group by 2 union all select 'prune_unsure_20', truth, count(*) from fl, cu where own > q20 group by 2 union all select 'prune_confident', truth, count(*) from fl where not joint group by 2 union all select 'relabel_confident', case when joint then pred else truth end, count(*) from fl group by 2")
def c39(spark, d):
    t, probs = posteriors(spark, d), ["p0", "p1", "p2"]
    sure = P.confident_flags(t, probs, "truth")
    arms = {"prune_unsure_10": P.pruned(P.unsure_flags(t, probs, "truth", 0.1)), "prune_unsure_20": P.pruned(P.unsure_flags(t, probs, "truth", 0.2)), "prune_confident": P.pruned(sure), "relabel_confident": P.relabelled(sure, "truth")}
    out = None
    for name, rows in arms.items():
        one = rows.groupBy(F.col("truth").alias("label")).agg(F.count("*").alias("n")).select(F.lit(name).alias("method"), "label", "n")
        out = one if out is None else out.unionByName(one)
    return out


@query("b4_bootstrap_interval", f"with {POP}, slots as (select draw, stratum, n, floor(('0x' || substr(md5(concat_ws('|', '17', draw, stratum, slot)), 1, 13))::bigint / 4503599627370496.0 * n) + 1 as rn from st, (select unnest(range(1, 101)) as slot) a, (select unnest(range(1, 201)) as draw) b where slot <= n), dr as (select draw, sum(area / (select sum(area) from areas) * my) as est from (select draw, s.stratum, avg(l.y) as my from slots s join labelled l on l.stratum = s.stratum and l.r = s.rn group by 1, 2) join areas using (stratum) group by 1), p as (select sum(area / (select sum(area) from areas) * my) as est from st join areas using (stratum)) select count(*) as draws, round(any_value(p.est), 6) as est, round(quantile_cont(dr.est, 0.025), 6) as lo, round(quantile_cont(dr.est, 0.975), 6) as hi from dr, p")
def b4(spark, d):
    return D.bootstrap_interval(labelled(spark, d), "stratum", areas(spark, d), "y", 17, 200, ["k", "id"])


@query("io18_label_import", "with x as (select (event_id % 400)::varchar as point_id, coalesce(event_type, '') as transition, cast(json_extract_string(props, '$.k') as bigint) as k, value, user_id % 4 as e, event_id from events), y as (select *, row_number() over (partition by k // 10, point_id, e order by event_id desc) as rn from x) select 'e' || e as expert_id, count(*) as n, count(*) filter (transition <> 'error') as called, sum(k)::bigint as confidence from y where rn = 1 group by 1")
def io18(spark, d):
    ev = read(spark, d, "events")
    k = F.get_json_object("props", "$.k").cast("long")
    out = ev.select(F.lit("c1").alias("campaign"), F.floor(k / 10).alias("batch_id"), (F.col("event_id") % 400).cast("string").alias("point_id"), F.concat(F.lit("e"), (F.col("user_id") % 4).cast("string")).alias("expert_id"), F.when(F.col("event_type") != "error", F.col("event_type")).alias("transition"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("labelled_at"), k.alias("confidence"), F.lit("a|b, \"c\"").alias("flags"), F.col("event_id").alias("seq"))
    folder = scratch(spark)
    tables.label_export_csv(out, folder)
    rows = tables.imported_labels(spark, folder, order="seq")
    return rows.groupBy("expert_id").agg(F.count("*").alias("n"), F.count("transition").alias("called"), F.sum("confidence").cast("long").alias("confidence"))


@query("r16_nested_evidence", "with p as (select o_custkey % 25 as batch_id, o_orderkey as id from orders), v as (select l_orderkey as id, count(distinct l_linenumber || '_' || l_partkey) as values, count(distinct year(l_shipdate)) as years from lineitem group by 1) select batch_id, count(*) as points, coalesce(sum(v.values), 0)::bigint as values, coalesce(sum(v.years), 0)::bigint as years, count(v.id) as found from p left join v using (id) group by 1")
def r16(spark, d):
    points = read(spark, d, "orders").select((F.col("o_custkey") % 25).alias("batch_id"), F.col("o_orderkey").alias("id"))
    li = read(spark, d, "lineitem")
    values = li.select(F.col("l_orderkey").alias("id"), F.concat_ws("_", "l_linenumber", "l_partkey").alias("key"), F.col("l_quantity").alias("value"))
    series = li.groupBy(F.col("l_orderkey").alias("id"), F.year("l_shipdate").alias("year")).agg(F.avg("l_tax").alias("ndvi"))
    b = tables.nested_evidence(points, "batch_id", "id", values, series, "year")
    each = F.aggregate("points", F.lit(0).cast("long"), lambda s, p: s + F.coalesce(F.size(p["evidence"]["v"]), F.lit(0)))
    years = F.aggregate("points", F.lit(0).cast("long"), lambda s, p: s + F.coalesce(F.size(p["evidence"]["t"]), F.lit(0)))
    return b.select("batch_id", F.size("points").alias("points"), each.alias("values"), years.alias("years"), F.size(F.filter("points", lambda p: F.size(p["evidence"]["v"]) > 0)).alias("found"))


@query("io14_result_tables", f"with {POP} select kind, stratum, n, round(y, 6) as y from (select stratum, count(*) as n, avg(y) as y from pop group by 1), (select unnest(['csv', 'json', 'parquet']) as kind)")
def io14(spark, d):
    rows = population(spark, d).groupBy("stratum").agg(F.count("*").alias("n"), F.avg("y").alias("y"))
    folder, out = scratch(spark), None
    for kind in ("csv", "json", "parquet"):
        tables.write_result(rows, f"{folder}/{kind}", kind)
        back = spark.read.schema(rows.schema).option("header", True).format(kind).load(f"{folder}/{kind}").select(F.lit(kind).alias("kind"), "stratum", "n", "y")
        out = back if out is None else out.unionByName(back)
    return out


@query("io19_quoted_export", "select doc_id, text is null or text = '' as blank, coalesce(length(text), 0) as n, md5(coalesce(text, '')) as digest from documents")
def io19(spark, d):
    folder = scratch(spark)
    tables.label_export_csv(read(spark, d, "documents").select("doc_id", "text", F.lit('say "a, b"').alias("note")), folder)
    back = spark.read.option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').option("maxCharsPerColumn", -1).csv(folder)
    return back.filter("note = 'say \"a, b\"'").select(F.col("doc_id").cast("long").alias("doc_id"), (F.coalesce("text", F.lit("")) == "").alias("blank"), F.length(F.coalesce("text", F.lit(""))).alias("n"), F.md5(F.coalesce("text", F.lit(""))).alias("digest"))


@query("st7_widened_table", f"with {READINGS}, a as (select * from readings where seq % 2 = 0), b as (select * from readings where seq % 2 = 1), l as (select *, true as wide from (select *, row_number() over (partition by campaign, batch_id, point_id, expert_id order by seq desc) as rn from b) where rn = 1), o as (select *, false as wide from (select *, row_number() over (partition by campaign, batch_id, point_id, expert_id order by seq desc) as rn from a) where rn = 1 and (campaign, batch_id, point_id, expert_id) not in (select (campaign, batch_id, point_id, expert_id) from b where batch_id is not null)) select expert_id, count(*) as n, count(*) filter (wide) as widened, round(sum(case when wide then value end), 6) as value from (select * from l union all select * from o) group by 1")
def st7(spark, d):
    rows = readings(spark, d)
    narrow = [f.split()[0] for f in label_stream.SCHEMA.split(", ")]
    first = label_stream.merged(None, rows.filter("seq % 2 = 0").select(*narrow))
    wide = label_stream.merged(first, rows.filter("seq % 2 = 1").select(*narrow, "value", F.lit(True).alias("wide")))
    return wide.groupBy("expert_id").agg(F.count("*").alias("n"), F.count_if(F.coalesce("wide", F.lit(False))).alias("widened"), F.sum("value").alias("value"))


@query("st3_acknowledged", f"with {READINGS} select batch_id, count(*) as accepted, count(distinct point_id) as points, min(seq) as first, max(seq) as last from readings where point_id is not null and labelled_at is not null and batch_id is not null group by 1")
def st3(spark, d):
    acks = label_stream.acknowledged(readings(spark, d), "batch_id")
    ids = F.transform("accepted", lambda x: x["seq"])
    return acks.select("batch_id", F.size("accepted").alias("accepted"), F.size(F.array_distinct(F.transform("accepted", lambda x: x["point_id"]))).alias("points"), F.array_min(ids).alias("first"), F.array_max(ids).alias("last"))

"""Queries of column functions over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalar as S
from ..functions.keyed import uniform
from ..operators import design as D
from .registry import query, read
from .roles import POP, POSTERIORS, population, posteriors


@query("p1_coarsen", "select o_orderpriority as raw, case o_orderpriority when '1-URGENT' then 'Nature' when '2-HIGH' then 'Cropland' else 'Artificial' end as coarse, count(*) as n from orders group by 1, 2")
def p1(spark, d):
    raw = F.when(F.col("o_orderpriority") == "1-URGENT", " Nature - Forest").when(F.col("o_orderpriority") == "2-HIGH", "CROPLAND ").otherwise("artificial")
    return read(spark, d, "orders").select(F.col("o_orderpriority").alias("raw"), S.coarsen(raw).alias("coarse")).groupBy("raw", "coarse").agg(F.count("*").alias("n"))


@query("p2_regex_coarse", "select regexp_replace('Nature - ' || o_orderstatus || ' -> ' || o_orderpriority, 'Nature - \\w+', 'Nature') as t, count(*) as n from orders group by 1")
def p2(spark, d):
    t = S.coarse_text(S.transition(F.concat(F.lit("Nature - "), "o_orderstatus"), F.col("o_orderpriority")))
    return read(spark, d, "orders").groupBy(t.alias("t")).agg(F.count("*").alias("n"))


_TR = "tr as (select id, stratum, before || ' -> ' || after as t from pop)"


@query("p3_rare_pool", f"with {POP}, {_TR}, n as (select t, count(*) as n from tr group by 1) select case when n >= (select max(n) / 2 from n) then t else 'other' end as t, sum(n)::bigint as n from n group by 1")
def p3(spark, d):
    t = population(spark, d).select(S.transition(F.col("before"), F.col("after")).alias("t"))
    least = t.groupBy("t").count().agg(F.max("count") / 2).first()[0]
    return S.pool_rare(t, "t", least).groupBy("t").agg(F.count("*").alias("n"))


@query("p4_is_change", f"with {POP}, {_TR} select t, split_part(t, ' -> ', 1) <> split_part(t, ' -> ', 2) as change, count(*) as n from tr group by 1, 2")
def p4(spark, d):
    t = population(spark, d).select(S.transition(F.col("before"), F.col("after")).alias("t"))
    return t.groupBy("t", S.is_change(F.col("t")).alias("change")).agg(F.count("*").alias("n"))


@query("p5_merged_legend", f"with {POP} select case before when 'Artificial' then 'Artificial' else 'Vegetation' end || ' -> ' || case after when 'Artificial' then 'Artificial' else 'Vegetation' end as t, count(*) as n from pop group by 1")
def p5(spark, d):
    t = S.to_merged(S.transition(F.col("before"), F.col("after")))
    return population(spark, d).groupBy(t.alias("t")).agg(F.count("*").alias("n"))


@query("p6_truth_indicator", f"with {POP} select stratum, round(avg((before = 'Artificial' and after = 'Nature')::int), 6) as p from pop group by 1")
def p6(spark, d):
    y = ((F.lower(F.trim("before")) == "artificial") & F.lower("after").startswith("nature")).cast("double")
    return population(spark, d).groupBy("stratum").agg(F.avg(y).alias("p"))


@query("p7_exit_indicators", f"with {POP} select stratum, sum((after = 'Nature')::int)::bigint as to_nature, sum((after = 'Cropland')::int)::bigint as to_cropland from pop where before = 'Artificial' group by 1")
def p7(spark, d):
    p = population(spark, d).filter("before = 'Artificial'")
    return p.groupBy("stratum").agg(F.count_if(F.col("after") == "Nature").alias("to_nature"), F.count_if(F.col("after") == "Cropland").alias("to_cropland"))


@query("p8_reference_class", f"with {POP} select case when score = 1 then 'uncertain' when before = 'Artificial' and after <> 'Artificial' then 'built_loss' else 'stable_stable' end as c, count(*) as n from pop group by 1")
def p8(spark, d):
    c = F.when(F.col("score") == 1, "uncertain").when((F.col("before") == "Artificial") & (F.col("after") != "Artificial"), "built_loss").otherwise("stable_stable")
    return population(spark, d).groupBy(c.alias("c")).agg(F.count("*").alias("n"))


@query("p9_class_indicator", f"with {POP}, k as (select unnest(['any change', 'Nature -> Cropland']) as klass) select klass, round(avg(case when klass = 'any change' then (before <> after)::int else (before || ' -> ' || after = klass)::int end), 6) as p from pop, k group by 1")
def p9(spark, d):
    t = population(spark, d).select(S.transition(F.col("before"), F.col("after")).alias("t"), F.explode(F.array(F.lit("any change"), F.lit("Nature -> Cropland"))).alias("klass"))
    return t.groupBy("klass").agg(F.avg(F.when(F.col("klass") == "any change", S.is_change(F.col("t"))).otherwise(F.col("t") == F.col("klass")).cast("double")).alias("p"))


@query("p10_abbreviation", "select n_name, array_to_string(list_transform(regexp_extract_all(n_name, '\\w+'), lambda w: left(w, 2)), '') as abbr from nation")
def p10(spark, d):
    return read(spark, d, "nation").select("n_name", S.abbreviation(F.col("n_name")).alias("abbr"))


@query("p11_normalised_candidates", "select count(*) as n, round(sum(lon), 6) as lon, round(sum(lat::double), 6) as lat from (select c_acctbal as lon, c_custkey % 90 as lat from customer) where lon is not null and lat is not null")
def p11(spark, d):
    c = read(spark, d, "customer").select(F.col("c_acctbal").cast("string").alias("x"), (F.col("c_custkey") % 90).cast("string").alias("y"))
    c = c.withColumnsRenamed({"x": "lon", "y": "lat"}).select(F.expr("try_cast(lon as double)").alias("lon"), F.expr("try_cast(lat as double)").alias("lat")).dropna()
    return c.agg(F.count("*").alias("n"), F.sum("lon").alias("lon"), F.sum("lat").alias("lat"))


@query("p12_meta_fold", "select o_orderpriority as channel, count(*) as n, sum((o_orderstatus <> 'O')::int)::bigint as status_kept, sum(1)::bigint as price_kept from orders group by 1")
def p12(spark, d):
    meta = F.map_filter(F.create_map(F.lit("status"), F.when(F.col("o_orderstatus") != "O", F.col("o_orderstatus")), F.lit("price"), F.col("o_totalprice").cast("string"), F.lit("blank"), F.lit("")), lambda k, v: v.isNotNull() & (v != ""))
    o = read(spark, d, "orders").select(F.col("o_orderpriority").alias("channel"), meta.alias("meta"))
    return o.groupBy("channel").agg(F.count("*").alias("n"), F.count_if(F.map_contains_key("meta", "status")).alias("status_kept"), F.count_if(F.map_contains_key("meta", "price")).alias("price_kept"))


@query("p14_split_filters", "select coalesce(sum((user_id % 3 = 1)::int), 0)::bigint as calibration, sum((event_type like 'p%')::int)::bigint as audit, count(*) as n from events")
def p14(spark, d):
    e = read(spark, d, "events").select((F.col("user_id") % 3).cast("string").alias("calibration"), F.regexp_replace("event_type", "^p", "aud_").alias("batch_id"))
    return e.agg(F.count_if(F.coalesce(F.expr("try_cast(calibration as int)"), F.lit(0)) == 1).alias("calibration"), F.count_if(F.col("batch_id").startswith("aud_")).alias("audit"), F.count("*").alias("n"))


@query("p19_map_class", "select case when l_discount >= 0.09 then 5 when l_tax >= 0.07 then 4 when l_quantity >= 40 then 3 when l_quantity >= 30 then 2 else 1 end as cls, count(*) as n from lineitem group by 1")
def p19(spark, d):
    c = F.coalesce(F.when(F.col("l_discount") >= 0.09, 5), F.when(F.col("l_tax") >= 0.07, 4), F.when(F.col("l_quantity") >= 40, 3), F.when(F.col("l_quantity") >= 30, 2), F.lit(1))
    return read(spark, d, "lineitem").groupBy(c.alias("cls")).agg(F.count("*").alias("n"))


@query("p20_proxy_simplex", "with t as (select l_returnflag, greatest(0, least(10, l_quantity - 5)) / 10 as a, greatest(0, least(1, l_discount * 10)) as b from lineitem), u as (select l_returnflag, greatest(a, 1e-6) as a, greatest(b, 1e-6) as b, greatest(1 - a - b, 1e-6) as c from t) select l_returnflag, round(avg(a / (a + b + c)), 6) as art, round(avg(b / (a + b + c)), 6) as crop, round(avg(c / (a + b + c)), 6) as nature from u group by 1")
def p20(spark, d):
    clamp = lambda x, lo, hi: F.greatest(F.lit(float(lo)), F.least(F.lit(float(hi)), x))
    a, b = clamp(F.col("l_quantity") - 5, 0, 10) / 10, clamp(F.col("l_discount") * 10, 0, 1)
    t = read(spark, d, "lineitem").select("l_returnflag", F.greatest(a, F.lit(1e-6)).alias("a"), F.greatest(b, F.lit(1e-6)).alias("b"), F.greatest(1 - a - b, F.lit(1e-6)).alias("c"))
    s = F.col("a") + F.col("b") + F.col("c")
    return t.groupBy("l_returnflag").agg(F.avg(F.col("a") / s).alias("art"), F.avg(F.col("b") / s).alias("crop"), F.avg(F.col("c") / s).alias("nature"))


_LL = "ll as (select c_custkey, ('0x' || substr(md5('21|' || c_custkey), 1, 13))::bigint / 4503599627370496.0 * 360 - 180 as lon, ('0x' || substr(md5('22|' || c_custkey), 1, 13))::bigint / 4503599627370496.0 * 160 - 80 as lat from customer)"


def points(spark, d):
    return read(spark, d, "customer").select("c_custkey", (uniform(21, "c_custkey") * 360 - 180).alias("lon"), (uniform(22, "c_custkey") * 160 - 80).alias("lat"))


@query("p21_block_id", f"with {_LL} select printf('x%+07.1f_y%+06.1f', floor(lon / 5) * 5, floor(lat / 5) * 5) as block, count(*) as n from ll group by 1")
def p21(spark, d):
    return points(spark, d).groupBy(S.block_id(F.col("lon"), F.col("lat"), 5.0).alias("block")).agg(F.count("*").alias("n"))


@query("p22_centroid", "select c_custkey, round((c_custkey + c_custkey + 2 + c_custkey + 1) / 3.0, 6) as lon, round((0 + 0 + 3) / 3.0, 6) as lat from customer")
def p22(spark, d):
    geo = F.format_string('{"type":"Polygon","coordinates":[[[%d,0],[%d,0],[%d,3]]]}', "c_custkey", F.col("c_custkey") + 2, F.col("c_custkey") + 1)
    pts = F.flatten(F.from_json(geo, "coordinates array<array<array<double>>>")["coordinates"])
    mean = lambda i: F.aggregate(pts, F.lit(0.0), lambda s, p: s + p[i]) / F.size(pts)
    return read(spark, d, "customer").select("c_custkey", mean(0).alias("lon"), mean(1).alias("lat"))


_ZONE = "case when lat >= 56 and lat < 64 and lon >= 3 and lon < 12 then 32 when lat >= 72 and lat < 84 and lon >= 0 and lon < 9 then 31 when lat >= 72 and lat < 84 and lon >= 9 and lon < 21 then 33 when lat >= 72 and lat < 84 and lon >= 21 and lon < 33 then 35 when lat >= 72 and lat < 84 and lon >= 33 and lon < 42 then 37 else floor((lon + 180) / 6)::bigint % 60 + 1 end + case when lat >= 0 then 32600 else 32700 end"


@query("p23_utm_epsg", f"with {_LL} select ({_ZONE})::bigint as epsg, count(*) as n from ll group by 1")
def p23(spark, d):
    return points(spark, d).groupBy(S.utm_epsg(F.col("lon"), F.col("lat")).alias("epsg")).agg(F.count("*").alias("n"))


@query("p24_utm_cells")
def p24(spark, d):
    p = points(spark, d)
    cell = p.select("c_custkey", S.utm_cell("lon", "lat", S.utm_epsg(F.col("lon"), F.col("lat"))).alias("cell"))
    return cell.groupBy("cell.epsg", "cell.x", "cell.y").agg(F.count("*").alias("points"))


@query("p25_growing_season", f"with {_LL} select case when abs(lat) < 23.5 then 1 when lat > 0 then 6 else 12 end as first, case when abs(lat) < 23.5 then 12 when lat > 0 then 9 else 3 end as last, case when abs(lat) < 23.5 then 0 when lat > 0 then 0 else -1 end as \"offset\", count(*) as n from ll group by 1, 2, 3")
def p25(spark, d):
    return points(spark, d).select(S.growing_season(F.col("lat")).alias("s")).groupBy("s.first", "s.last", "s.offset").agg(F.count("*").alias("n"))


@query("p26_unit_sphere", f"with {_LL} select c_custkey, round(cos(radians(lat)) * cos(radians(lon)), 6) + 0.0 as x, round(cos(radians(lat)) * sin(radians(lon)), 6) + 0.0 as y, round(sin(radians(lat)), 6) + 0.0 as z from ll")
def p26(spark, d):
    x, y, z = S.unit_sphere(F.col("lon"), F.col("lat"))
    return points(spark, d).select("c_custkey", x.alias("x"), y.alias("y"), z.alias("z"))


@query("p27_normalised_difference", "select l_returnflag, round(sum(case when l_discount + l_tax <> 0 then round((l_discount - l_tax) / (l_discount + l_tax), 4) end), 6) as s, count(*) filter (l_discount + l_tax = 0) as undefined from lineitem group by 1")
def p27(spark, d):
    nd = S.normalised_difference(F.col("l_discount"), F.col("l_tax"))
    return read(spark, d, "lineitem").groupBy("l_returnflag").agg(F.sum(nd).alias("s"), F.count_if(nd.isNull()).alias("undefined"))


@query("p28_spectral", "with t as (select l_returnflag, l_linenumber * 100.0::double as b, l_quantity * 20 as g, l_quantity * 30 as r, l_extendedprice * 0.05::double as n from lineitem) select l_returnflag, round(avg((n - r) / (n + r + 1e-6)), 6) as ndvi, round(avg((g - n) / (g + n + 1e-6)), 6) as ndwi, round(avg((b + g + r + n) / 4), 6) as brightness, round(avg(2.5 * (n * 1e-4 - r * 1e-4) / (n * 1e-4 + 2.4 * (r * 1e-4) + 1)), 6) as evi2, round(avg((g - r) / (g + r + 1e-6)), 6) as grvi, round(avg(((r + b) - (n + g)) / ((r + b) + (n + g) + 1e-6)), 6) as bsi, round(avg((r - b) / (r + b + 1e-6)), 6) as ci from t group by 1")
def p28(spark, d):
    c = S.spectral(F.col("l_linenumber") * 100, F.col("l_quantity") * 20, F.col("l_quantity") * 30, F.col("l_extendedprice") * 0.05)
    return read(spark, d, "lineitem").groupBy("l_returnflag").agg(*[F.avg(v).alias(k) for k, v in c.items()])


_EP = "ep as (select a.vec_id, a.embedding::double[] as a, b.embedding::double[] as b from embeddings a join embeddings b on b.vec_id = a.vec_id + 250)"


def vector_pairs(spark, d):
    e = read(spark, d, "embeddings")
    return e.select("vec_id", F.col("embedding").alias("a")).join(e.select((F.col("vec_id") - 250).alias("vec_id"), F.col("embedding").alias("b")), "vec_id")


_L2 = "sqrt(list_sum(list_transform(range(1, 65), lambda i: (b[i] - a[i]) * (b[i] - a[i]))))"


@query("p29_l2_normalise", "select vec_id, round(list_sum(list_transform(embedding::double[], lambda x: x / sqrt(list_sum(list_transform(embedding::double[], lambda y: y * y))))), 5) as s from embeddings")
def p29(spark, d):
    return read(spark, d, "embeddings").select("vec_id", F.round(F.aggregate(S.l2_normalised(F.col("embedding")), F.lit(0.0), lambda s, x: s + x), 5).alias("s"))


@query("p30_change_scalars", f"with {_EP}, q as (select vec_id, 1 - list_dot_product(a, b) / (sqrt(list_dot_product(a, a)) * sqrt(list_dot_product(b, b))) as cosine, {_L2} as l2, list_sum(list_transform(range(1, 65), lambda i: abs(b[i] - a[i]))) as l1, list_max(list_transform(range(1, 65), lambda i: abs(b[i] - a[i]))) as chebyshev, sqrt(list_dot_product(b, b)) - sqrt(list_dot_product(a, a)) as norm_change from ep) select vec_id, round(cosine, 6) as cosine, round(l2, 6) as l2, round(l1, 6) as l1, round(chebyshev, 6) as chebyshev, round(norm_change, 6) + 0.0 as norm_change from q")
def p30(spark, d):
    c = S.change_scalars(F.col("a"), F.col("b"))
    return vector_pairs(spark, d).select("vec_id", *[v.alias(k) for k, v in c.items()])


@query("p31_band_features", f"with {_EP} select vec_id, round(list_sum(list_transform(range(1, 65), lambda i: a[i] * b[i])), 6) as dot, round(list_sum(list_transform(range(1, 65), lambda i: (b[i] - a[i]) / (abs(a[i]) + abs(b[i]) + 1e-6))), 6) as nd from ep")
def p31(spark, d):
    add = lambda c: F.aggregate(c, F.lit(0.0), lambda s, x: s + x)
    return vector_pairs(spark, d).select("vec_id", add(S.band_products(F.col("a"), F.col("b"))).alias("dot"), add(S.band_differences(F.col("a"), F.col("b"))).alias("nd"))


_ENT = "(-(case when p0 > 0 then p0 * ln(p0) else 0 end + case when p1 > 0 then p1 * ln(p1) else 0 end + case when p2 > 0 then p2 * ln(p2) else 0 end) / ln(3))"


def P():
    return F.array("p0", "p1", "p2")


@query("p32_posterior_scores", f"with {POSTERIORS} select truth, round(avg({_ENT}), 6) as entropy, round(avg(1 - greatest(p0, p1, p2)), 6) as least_confidence, round(avg(greatest(p0, p1, p2) - (p0 + p1 + p2 - greatest(p0, p1, p2) - least(p0, p1, p2))), 6) as margin from post group by 1")
def p32(spark, d):
    return posteriors(spark, d).groupBy("truth").agg(F.avg(S.entropy(P())).alias("entropy"), F.avg(S.least_confidence(P())).alias("least_confidence"), F.avg(S.margin(P())).alias("margin"))


@query("p33_set_size", f"with {POSTERIORS} select (p0 >= 0.5)::int + (p1 >= 0.6)::int + (p2 >= 0.7)::int as size, count(*) as n, sum((p0 >= 0.5)::int)::bigint as with0 from post group by 1")
def p33(spark, d):
    q = F.array(F.lit(0.5), F.lit(0.4), F.lit(0.3))
    return posteriors(spark, d).groupBy(S.set_size(P(), q).alias("size")).agg(F.count("*").alias("n"), F.count_if(F.col("p0") >= 0.5).alias("with0"))


@query("p34_deficit_yield", "with p as (select o_custkey % 100 as patch, count(*) filter (o_orderpriority = '1-URGENT') as a, count(*) filter (o_orderpriority = '2-HIGH') as b from orders group by 1) select patch, round(least(4, floor(a / 5)) * 0.9 * 3 / 5 + least(4, floor(b / 5)) * 0.5 * 2 / 5, 6) as y from p")
def p34(spark, d):
    p = read(spark, d, "orders").groupBy((F.col("o_custkey") % 100).alias("patch")).agg(F.count_if(F.col("o_orderpriority") == "1-URGENT").alias("a"), F.count_if(F.col("o_orderpriority") == "2-HIGH").alias("b"))
    return p.select("patch", S.deficit_yield(F.array(F.col("a").cast("double"), F.col("b").cast("double")), [3.0, 2.0], [0.9, 0.5], 5.0, 4).alias("y"))


@query("p35_complexity", "with p as (select o_custkey % 100 as patch, count(*) filter (o_orderpriority = '1-URGENT') as a, count(*) filter (o_orderpriority = '2-HIGH') as b from orders group by 1) select patch, round(-(case when a > 0 then a / (a + b) * ln(a / (a + b)) else 0 end + case when b > 0 then b / (a + b) * ln(b / (a + b)) else 0 end) / ln(2), 6) + 0.0 as h from p where a + b > 0")
def p35(spark, d):
    p = read(spark, d, "orders").groupBy((F.col("o_custkey") % 100).alias("patch")).agg(F.count_if(F.col("o_orderpriority") == "1-URGENT").alias("a"), F.count_if(F.col("o_orderpriority") == "2-HIGH").alias("b"), F.count("*").alias("c")).filter("a + b > 0")
    return p.select("patch", S.complexity(F.array(F.col("a").cast("double"), F.col("b").cast("double"), F.col("c").cast("double")), ignore=2).alias("h"))


@query("p36_blend", f"with {POSTERIORS} select truth, round(avg(0.3 * p0 + 0.7 * p1), 6) as s from post group by 1")
def p36(spark, d):
    return posteriors(spark, d).groupBy("truth").agg(F.avg(S.blend(F.col("p0"), F.col("p1"), 0.3)).alias("s"))


@query("p37_gated_label", f"with {POSTERIORS} select truth, case when p1 + p2 >= 0.6 then case when p2 > p1 then 2 else 1 end else 0 end as label, count(*) as n from post group by 1, 2")
def p37(spark, d):
    return posteriors(spark, d).groupBy("truth", S.gated_label(P(), [False, True, True], 0.6).alias("label")).agg(F.count("*").alias("n"))


@query("p38_cost_argmax", f"with {POSTERIORS} select case when p0 * 0.5 >= p1 * 1.0 and p0 * 0.5 >= p2 * 2.0 then 0 when p1 * 1.0 >= p2 * 2.0 then 1 else 2 end as label, count(*) as n from post group by 1")
def p38(spark, d):
    return posteriors(spark, d).groupBy(S.cost_argmax(P(), [0.5, 1.0, 2.0]).alias("label")).agg(F.count("*").alias("n"))


@query("p39_restricted_argmax", f"with {POSTERIORS} select case when p2 > p1 then 2 else 1 end as label, count(*) as n from post group by 1")
def p39(spark, d):
    return posteriors(spark, d).groupBy((S.argmax(F.array("p1", "p2")) + 1).alias("label")).agg(F.count("*").alias("n"))


@query("p40_change_codes", f"with {POSTERIORS} select case when truth = 0 then 255 when p1 > p2 then 1 else 0 end as code, case when truth = 0 then 255 else least(4, floor({_ENT} * 5))::bigint end as bin, count(*) as n from post group by 1, 2")
def p40(spark, d):
    valid = F.col("truth") != 0
    code = F.when(~valid, 255).when(F.col("p1") > F.col("p2"), 1).otherwise(0)
    bins = F.when(~valid, 255).otherwise(F.least(F.lit(4), F.floor(S.entropy(P()) * 5)))
    return posteriors(spark, d).groupBy(code.alias("code"), bins.alias("bin")).agg(F.count("*").alias("n"))


@query("p41_terrain_bins", "select case when l_quantity <= 10 then '0-10' when l_quantity <= 25 then '10-25' else '25+' end as bin, count(*) as n from lineitem group by 1")
def p41(spark, d):
    q = F.col("l_quantity")
    return read(spark, d, "lineitem").groupBy(F.when(q <= 10, "0-10").when(q <= 25, "10-25").otherwise("25+").alias("bin")).agg(F.count("*").alias("n"))


@query("p42_severity", f"with {POP} select before, after, (case after when 'Nature' then 2 when 'Cropland' then 1 else 0 end) - (case before when 'Nature' then 2 when 'Cropland' then 1 else 0 end) as delta, count(*) as n from pop group by 1, 2, 3")
def p42(spark, d):
    scale = {"Nature": 2, "Cropland": 1, "Artificial": 0}
    return population(spark, d).groupBy("before", "after", (S.lookup(F.col("after"), scale) - S.lookup(F.col("before"), scale)).alias("delta")).agg(F.count("*").alias("n"))


@query("p43_queue", "with b as (select event_id % 400 as point, list_distinct(list(user_id % 4)) as readers from events group by 1) select case when len(readers) = 4 then 'all' when list_contains(readers, 1) then 'mine' when list_contains(readers, 2) then 'second' end as queue, count(*) as n from b group by 1")
def p43(spark, d):
    b = read(spark, d, "events").groupBy((F.col("event_id") % 400).alias("point")).agg(F.collect_set(F.col("user_id") % 4).alias("readers"))
    full = F.forall(F.array(*[F.lit(i).cast("long") for i in range(4)]), lambda e: F.array_contains("readers", e))
    q = F.when(full, "all").when(F.array_contains("readers", F.lit(1).cast("long")), "mine").when(F.array_contains("readers", F.lit(2).cast("long")), "second")
    return b.groupBy(q.alias("queue")).agg(F.count("*").alias("n"))


@query("p44_plot_weights", f"with {POP}, n as (select before, stratum, count(*) as n, sum(count(*)) over (partition by before) as nb from pop group by 1, 2), x as (select before, stratum, n, 1 / sqrt(nb) * case when stratum like 'A%' then 2.0 else 1.0 end as w from n) select before, stratum, round(w / (sum(n * w) over ()) * (sum(n) over ()), 6) as weight from x")
def p44(spark, d):
    p = population(spark, d)
    n = p.groupBy("before", "stratum").agg(F.count("*").alias("n"))
    nb = n.groupBy("before").agg(F.sum("n").alias("nb"))
    x = n.join(nb, "before").withColumn("w", 1 / F.sqrt("nb") * F.when(F.col("stratum").startswith("A"), 2.0).otherwise(1.0))
    return x.select("before", "stratum", (F.col("w") / F.sum(F.col("n") * F.col("w")).over(D.everything()) * F.sum("n").over(D.everything())).alias("weight"))


@query("p45_patch_pixels", f"with {_LL} select floor(floor(lon * 1000) / 500)::bigint as px, floor(floor(lat * 1000) / 500)::bigint as py, count(*) as n, min(floor(lon * 1000)::bigint % 500) as c0 from ll where lon >= 0 and lat >= 0 group by 1, 2")
def p45(spark, d):
    x, y = F.floor(F.col("lon") * 1000), F.floor(F.col("lat") * 1000)
    return points(spark, d).filter("lon >= 0 and lat >= 0").select(F.floor(x / 500).alias("px"), F.floor(y / 500).alias("py"), (x % 500).alias("c")).groupBy("px", "py").agg(F.count("*").alias("n"), F.min("c").alias("c0"))


@query("p46_coverage_gap", "select p_size % 5 as g, count(*) as n from part left join (select distinct on (s_suppkey) s_suppkey, s_acctbal from supplier order by s_suppkey, s_acctbal) t on s_suppkey = p_partkey where coalesce(s_acctbal, 0) > 1000 or p_size % 5 = 2 group by 1")
def p46(spark, d):
    slope = read(spark, d, "supplier").groupBy(F.col("s_suppkey").alias("p_partkey")).agg(F.min("s_acctbal").alias("slope"))
    p = read(spark, d, "part").join(slope, "p_partkey", "left").filter((F.coalesce("slope", F.lit(0.0)) > 1000) | (F.col("p_size") % 5 == 2))
    return p.groupBy((F.col("p_size") % 5).alias("g")).agg(F.count("*").alias("n"))

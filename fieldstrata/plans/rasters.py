"""Queries of rasters and image series; pixels and scenes come from lineitem."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import rasters as R
from .registry import query, read


def maps(spark, d):
    """Two classified maps on a 100 x 100 grid: the smallest and the largest line number of the rows that fall on a pixel."""
    li = read(spark, d, "lineitem").groupBy((F.col("l_partkey") % 100).alias("row"), (F.col("l_orderkey") % 100).alias("col")).agg(F.min("l_linenumber").alias("lo"), F.max("l_linenumber").alias("hi"))
    return li.select("row", "col", F.explode(F.array(F.struct(F.lit("a").alias("map_id"), F.col("lo").alias("code")), F.struct(F.lit("b").alias("map_id"), F.col("hi").alias("code")))).alias("m")).select("m.map_id", "row", "col", F.when(F.col("m.code") == 7, R.NODATA).otherwise(F.col("m.code") % 3).alias("code"))


_PX = "px0 as (select l_partkey % 100 as row, l_orderkey % 100 as col, min(l_linenumber) as lo, max(l_linenumber) as hi from lineitem group by 1, 2), px as (select 'a' as map_id, row, col, case when lo = 7 then 255 else lo % 3 end as code from px0 union all select 'b', row, col, case when hi = 7 then 255 else hi % 3 end from px0), va as (select * from px where code <> 255), ab as (select x.row, x.col, x.code as a, y.code as b from va x join va y using (row, col) where x.map_id = 'a' and y.map_id = 'b')"


def pair(spark, d):
    m = maps(spark, d)
    return R.joined(m.filter("map_id = 'a'"), m.filter("map_id = 'b'"))


@query("r1_class_iou", f"with {_PX}, c as (select unnest([0, 1, 2]) as code), s as (select code, count(*) filter (a = code) as n_a, count(*) filter (b = code) as n_b, count(*) filter (a = code and b = code) as bb from ab, c group by 1) select code, n_a, n_b, bb as \"both\", round(bb / (n_a + n_b - bb), 6) as iou from s")
def r1(spark, d):
    return R.class_iou(pair(spark, d))


@query("r2_change_masks", f"with {_PX} select count(*) filter (a = 1 or b = 1) as any_, count(*) filter (a = 1 and b = 1) as \"both\" from ab")
def r2(spark, d):
    return pair(spark, d).agg(F.count_if((F.col("a") == 1) | (F.col("b") == 1)).alias("any_"), F.count_if((F.col("a") == 1) & (F.col("b") == 1)).alias("both"))


@query("r3_edge_density", f"with {_PX}, e as (select p.map_id, p.code, exists (select 1 from va q where q.map_id = p.map_id and q.code <> p.code and abs(q.row - p.row) + abs(q.col - p.col) = 1) as edge from va p) select map_id, count(*) as n, round(avg(edge::int), 6) as density, count(distinct code) as classes from e group by 1")
def r3(spark, d):
    return R.edges(maps(spark, d)).groupBy("map_id").agg(F.count("*").alias("n"), F.avg(F.col("edge").cast("double")).alias("density"), F.count_distinct("code").alias("classes"))


@query("r4_segments")
def r4(spark, d):
    s = R.segments(maps(spark, d))
    return s.groupBy("map_id").agg(F.count("*").alias("segments"), F.percentile("size", F.lit(0.5)).alias("median_size"), F.max("size").alias("largest"))


@query("r5_high_frequency", f"with {_PX}, h as (select p.map_id, c, p.row, p.col, (p.code = c)::int as v from va p, (select unnest([0, 1, 2]) as c)), m as (select h.map_id, h.c, h.row, h.col, any_value(h.v) as v, avg(q.v) as m from h join h q on q.map_id = h.map_id and q.c = h.c and q.row between h.row - 1 and h.row + 1 and q.col between h.col - 1 and h.col + 1 group by 1, 2, 3, 4), r as (select map_id, c, 1 - var_pop(m) / var_pop(v) as ratio from m group by 1, 2 having var_pop(v) > 0) select map_id, round(avg(ratio), 6) as high_frequency from r group by 1")
def r5(spark, d):
    return R.high_frequency_ratio(maps(spark, d), [0, 1, 2])


@query("r6_box_mean", f"with {_PX}, m as (select p.map_id, p.row, p.col, avg(q.code) as m from va p join va q on q.map_id = p.map_id and q.row between p.row - 2 and p.row + 2 and q.col between p.col - 2 and p.col + 2 group by 1, 2, 3) select map_id, row, round(avg(m), 6) as mean from m group by 1, 2")
def r6(spark, d):
    return R.box(maps(spark, d).filter(F.col("code") != R.NODATA), F.col("code"), 2, "m").groupBy("map_id", "row").agg(F.avg("m").alias("mean"))


@query("r8_change_fraction", f"with {_PX} select map_id, round(avg((code = 1)::int), 6) as fraction, count(*) as valid from va group by 1")
def r8(spark, d):
    return maps(spark, d).filter(F.col("code") != R.NODATA).groupBy("map_id").agg(F.avg((F.col("code") == 1).cast("double")).alias("fraction"), F.count("*").alias("valid"))


@query("r9_patch_statistics", f"with {_PX}, pt as (select distinct map_id, row // 10 as pr, col // 10 as pc from px) select pt.map_id, pr, pc, count(v.code) as valid, count(*) filter (v.code = 1) as px_1, round(coalesce(quantile_cont(v.code, 0.999), 0), 6) as p999 from pt left join va v on v.map_id = pt.map_id and v.row // 10 = pr and v.col // 10 = pc group by 1, 2, 3")
def r9(spark, d):
    m = maps(spark, d).withColumn("pr", F.floor(F.col("row") / 10)).withColumn("pc", F.floor(F.col("col") / 10))
    v = F.when(F.col("code") != R.NODATA, F.col("code"))
    return m.groupBy("map_id", "pr", "pc").agg(F.count(v).alias("valid"), F.count_if(v == 1).alias("px_1"), F.coalesce(F.percentile(v, F.lit(0.999)), F.lit(0.0)).alias("p999"))


@query("r22_delta_map", f"with {_PX}, m as (select (a = 1)::int as a, (b = 1)::int as b from ab) select case when a = 0 and b = 0 then 'stable' when a = 1 and b = 1 then 'kept' when b = 1 then 'added' else 'removed' end as delta, count(*) as n from m group by 1")
def r22(spark, d):
    return R.delta(pair(spark, d).select((F.col("a") == 1).cast("int").alias("a"), (F.col("b") == 1).cast("int").alias("b")))


@query("j23_pixel_join", f"with {_PX} select a, b, count(*) as n from ab group by 1, 2")
def j23(spark, d):
    return pair(spark, d).groupBy("a", "b").agg(F.count("*").alias("n"))


def scenes(spark, d):
    li = read(spark, d, "lineitem")
    return li.select((F.col("l_partkey") % 200).alias("point"), F.col("l_shipdate").alias("t"), F.year("l_shipdate").alias("year"), F.when(F.col("l_tax") > 0, (F.col("l_quantity") - F.col("l_linenumber")) / (F.col("l_quantity") + F.col("l_linenumber"))).alias("ndvi"), F.col("l_discount").alias("cloud"), F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("id"), F.quarter("l_shipdate").alias("season"))


_SC = "sc as (select l_partkey % 200 as point, l_shipdate as t, year(l_shipdate) as year, case when l_tax > 0 then (l_quantity - l_linenumber) / (l_quantity + l_linenumber) end as ndvi, l_discount as cloud, concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) as id, quarter(l_shipdate) as season from lineitem)"


@query("r13_dense_series", f"with {_SC} select point, count(*) as n, round(arg_min(ndvi, t), 6) > -2 as has_first, strftime(min(t), '%Y-%m-%d') as first_t from sc where ndvi is not null and cloud < 0.085 group by 1")
def r13(spark, d):
    s = R.dense_series(scenes(spark, d).filter("cloud < 0.085"), "point", "t", ["ndvi"])
    return s.select("point", F.size("series").alias("n"), (F.col("series")[0]["ndvi"] > -2).alias("has_first"), F.date_format(F.col("series")[0]["t"], "yyyy-MM-dd").alias("first_t"))


@query("r14_annual_composite", f"with {_SC}, c as (select point, year, quantile_cont(ndvi, 0.5) as ndvi, count(*) as scenes from sc where cloud < 0.05 group by 1, 2) select p.point, y.year, round(ndvi, 6) as ndvi, coalesce(scenes, 0) as scenes from (select distinct point from sc where cloud < 0.05) p cross join (select unnest(range(1993, 2002)) as year) y left join c using (point, year)")
def r14(spark, d):
    return R.annual_composite(scenes(spark, d).filter("cloud < 0.05"), "point", "year", ["ndvi"], list(range(1993, 2002)))


@query("r18_pick_seasonal", f"with {_SC}, a as (select *, row_number() over (partition by point, year, season order by cloud, id) > 1 as again from sc), b as (select *, row_number() over (partition by point, year order by again::int, cloud, id) as rn from a) select point, year, id from b where rn <= 5")
def r18(spark, d):
    return R.pick_seasonal(scenes(spark, d), ["point", "year"], "season", "cloud", "id", 5).select("point", "year", "id")


@query("r17_display_bounds", f"with {_SC}, y as (select point, year, quantile_cont(ndvi, 0.02) as lo, quantile_cont(ndvi, 0.98) as hi from sc where ndvi is not null group by 1, 2), m as (select point, list_sort(list(lo))[count(*) // 2 + 1] as lo, list_sort(list(hi))[count(*) // 2 + 1] as hi from y group by 1) select point, round(lo, 6) as lo, round(greatest(hi, lo + 0.1), 6) as hi from m")
def r17(spark, d):
    y = scenes(spark, d).filter("ndvi is not null").groupBy("point", "year").agg(F.percentile("ndvi", F.lit(0.02)).alias("lo"), F.percentile("ndvi", F.lit(0.98)).alias("hi"))
    upper = lambda c: F.sort_array(F.collect_list(c))[F.floor(F.count("*") / 2).cast("int")]  # noqa: E731  the upper median, of a few years
    m = y.groupBy("point").agg(upper("lo").alias("lo"), upper("hi").alias("hi"))
    return m.select("point", "lo", F.greatest("hi", F.col("lo") + 0.1).alias("hi"))


@query("r19_pixel_median", "select l_suppkey % 50 as point, l_linenumber as col, round(quantile_cont(l_quantity, 0.5), 6) as median, count(*) as depth from lineitem group by 1, 2")
def r19(spark, d):
    return read(spark, d, "lineitem").groupBy((F.col("l_suppkey") % 50).alias("point"), F.col("l_linenumber").alias("col")).agg(F.percentile("l_quantity", F.lit(0.5)).alias("median"), F.count("*").alias("depth"))

"""The given tables in the roles that survey operators work on, as DataFrames and as SQL common table expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.keyed import key
from .registry import read

LABELLED = 100


def population(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as plots: stratum, id, cell, before/after classes, truth y, hard proxy yhat, soft proxy score."""
    li = read(spark, sf_dir, "lineitem")
    return li.select(
        F.concat_ws("_", "l_returnflag", "l_linestatus").alias("stratum"),
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("id"),
        F.col("l_suppkey").alias("cell"),
        (F.col("l_discount") >= 0.05).cast("double").alias("y"),
        (F.col("l_tax") >= 0.04).cast("double").alias("yhat"),
        F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("l_discount") * 10)).alias("score"),
        F.when(F.col("l_linenumber") <= 2, "Nature").when(F.col("l_linenumber") <= 4, "Cropland").otherwise("Artificial").alias("before"),
        F.when(F.col("l_partkey") % 3 == 0, "Nature").when(F.col("l_partkey") % 3 == 1, "Cropland").otherwise("Artificial").alias("after"),
    )


POP = """pop as (select l_returnflag || '_' || l_linestatus as stratum, concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) as id,
 l_suppkey as cell, (l_discount >= 0.05)::double as y, (l_tax >= 0.04)::double as yhat, least(1.0, greatest(0.0, l_discount * 10))::double as score,
 case when l_linenumber <= 2 then 'Nature' when l_linenumber <= 4 then 'Cropland' else 'Artificial' end as before,
 case when l_partkey % 3 = 0 then 'Nature' when l_partkey % 3 = 1 then 'Cropland' else 'Artificial' end as after from lineitem),
areas as (select l_returnflag || '_' || l_linestatus as stratum, sum(l_extendedprice::decimal(18, 2))::double / 1e6 as area from lineitem group by 1),
keyed as (select *, ('0x' || substr(md5('7|' || id), 1, 13))::bigint as k from pop),
ranked as (select *, row_number() over (partition by stratum order by k, id) as r from keyed),
labelled as (select * from ranked where r <= 100), predicted as (select * from ranked where r > 100),
st as (select stratum, count(*) as n, avg(y) as my, coalesce(var_samp(y), 0) as vy, avg(yhat) as mx, coalesce(var_samp(yhat), 0) as vx, coalesce(covar_samp(y, yhat), 0) as cxy from labelled group by 1),
ss as (select stratum, count(*) as n, avg(y) as my, coalesce(var_samp(y), 0) as vy, avg(score) as mx, coalesce(var_samp(score), 0) as vx, coalesce(covar_samp(y, score), 0) as cxy from labelled group by 1),
px as (select stratum, count(*) as pn, avg(yhat) as pm, coalesce(var_samp(yhat), 0) as pv from predicted group by 1),
ps as (select stratum, count(*) as pn, avg(score) as pm, coalesce(var_samp(score), 0) as pv from predicted group by 1),
w as (select st.*, area, area / sum(area) over () as w from st join areas using (stratum)),
ws as (select ss.*, area, area / sum(area) over () as w from ss join areas using (stratum))"""


def areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read(spark, sf_dir, "lineitem")
    return li.groupBy(F.concat_ws("_", "l_returnflag", "l_linestatus").alias("stratum")).agg((F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("double") / 1e6).alias("area"))


def keyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return population(spark, sf_dir).withColumn("k", key(7, "id"))


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows with the smallest keys of each stratum, numbered (a group limit: each task keeps that many rows a stratum)."""
    return keyed(spark, sf_dir).withColumn("r", F.row_number().over(Window.partitionBy("stratum").orderBy("k", "id"))).filter(F.col("r") <= LABELLED)


def predicted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row that is not labelled: those beyond the last labelled key of their stratum, in one scan without a sort."""
    last = labelled(spark, sf_dir).groupBy("stratum").agg(F.max(F.struct("k", "id")).alias("last"))
    return keyed(spark, sf_dir).join(F.broadcast(last), "stratum").filter(F.struct("k", "id") > F.col("last")).drop("last")  # one row a stratum


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as label readings: campaign, batch_id, point_id, expert_id, transition (null for errors), labelled_at, seq."""
    k = F.get_json_object("props", "$.k").cast("long")
    return read(spark, sf_dir, "events").select(
        F.lit("c1").alias("campaign"), (F.floor(k / 10)).cast("string").alias("batch_id"), (F.col("event_id") % 400).cast("string").alias("point_id"),
        F.concat(F.lit("e"), F.col("user_id") % 4).alias("expert_id"), F.when(F.col("event_type") != "error", F.col("event_type")).alias("transition"),
        F.col("ts").alias("labelled_at"), F.col("event_id").alias("seq"), "value", (F.col("user_id") % 2).alias("side"), k.alias("k"),
    )


READINGS = """readings as (select 'c1' as campaign, cast(floor(cast(json_extract_string(props, '$.k') as bigint) / 10) as bigint)::varchar as batch_id, (event_id % 400)::varchar as point_id,
 'e' || (user_id % 4) as expert_id, case when event_type <> 'error' then event_type end as transition, ts as labelled_at, event_id as seq, value, user_id % 2 as side,
 cast(json_extract_string(props, '$.k') as bigint) as k from events),
newest as (select * from (select *, row_number() over (partition by campaign, batch_id, point_id, expert_id order by labelled_at desc, seq desc) as rn from readings) where rn = 1)"""


def posteriors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as a posterior table: id, truth class (0-2), fold, three class probabilities from its measures."""
    li = read(spark, sf_dir, "lineitem")
    a, b, c = F.col("l_quantity"), F.col("l_discount") * 500 + 1, F.col("l_tax") * 500 + 1
    t = a + b + c
    return li.select(F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("id"), (F.col("l_linenumber") % 3).cast("int").alias("truth"), (F.col("l_orderkey") % 5).cast("int").alias("fold"), (a / t).alias("p0"), (b / t).alias("p1"), (c / t).alias("p2"))


POSTERIORS = """post as (select concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) as id, l_linenumber % 3 as truth, l_orderkey % 5 as fold,
 l_quantity / (l_quantity + l_discount * 500 + 1 + (l_tax * 500 + 1)) as p0, (l_discount * 500 + 1) / (l_quantity + l_discount * 500 + 1 + (l_tax * 500 + 1)) as p1,
 (l_tax * 500 + 1) / (l_quantity + l_discount * 500 + 1 + (l_tax * 500 + 1)) as p2 from lineitem)"""

"""Queries of the label stream and of file round trips: events arrive as submissions."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators.materialise import shared_dir
from ..sources import tables as T
from ..streaming import label_stream as L
from .registry import query, read
from .roles import READINGS, readings


def scratch(spark) -> str:
    return f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"


def submissions(spark, d):
    """events as a stream of label submissions."""
    schema = read(spark, d, "events").schema
    e = spark.readStream.schema(schema).parquet(f"{d}/events.parque[t]")
    k = F.get_json_object("props", "$.k").cast("long")
    return e.select(
        F.lit("c1").alias("campaign"), F.floor(k / 10).cast("string").alias("batch_id"), (F.col("event_id") % 400).cast("string").alias("point_id"),
        F.concat(F.lit("e"), F.col("user_id") % 4).alias("expert_id"), F.when(F.col("event_type") != "error", F.col("event_type")).alias("transition"),
        F.col("ts").cast("timestamp").alias("labelled_at"), F.col("event_id").alias("seq"),
    )


def ran(spark, stream, mode: str):
    """What a streaming aggregate has put out when all input is read, from the folder that its batches are written to."""
    folder = scratch(spark)

    def write(batch, number):
        batch.write.mode("overwrite").parquet(f"{folder}/v={number:08d}")

    stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint").foreachBatch(write).trigger(availableNow=True).start().awaitTermination()
    return L.current(spark, folder)


@query("st1_upsert", f"with {READINGS} select campaign, batch_id, point_id, expert_id, transition, seq from (select *, row_number() over (partition by campaign, batch_id, point_id, expert_id order by seq desc) as rn2 from readings) where rn2 = 1")
def st1(spark, d):
    folder = scratch(spark)
    L.upsert_stream(submissions(spark, d), folder, f"{folder}/checkpoint").awaitTermination()
    return L.current(spark, folder).select("campaign", "batch_id", "point_id", "expert_id", "transition", "seq")


@query("st5_running_status", f"with {READINGS} select batch_id, count(*) as n, count(transition) as called from readings group by 1")
def st5(spark, d):
    return ran(spark, L.running_status(submissions(spark, d)), "complete")


@query("st8_hourly", "select date_trunc('hour', ts)::varchar as hour, count(*) as n from events group by 1")
def st8(spark, d):
    return ran(spark, L.hourly(submissions(spark, d)), "complete").select(F.date_format("hour", "yyyy-MM-dd HH:mm:ss").alias("hour"), "n")


def in_turn(spark, *tables):
    """Tables as a stream of one micro-batch each, in that order. Each goes through one task: for small tables."""
    import time

    folder = scratch(spark)
    for i, t in enumerate(tables):
        if i:
            time.sleep(1.1)  # files are taken by their time, which some stores keep in seconds
        t.coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(tables[0].schema).option("maxFilesPerTrigger", 1).parquet(folder)


def each_in_turn(spark, run, *tables):
    """The same for large tables: each is written by as many tasks as it has, once the query has taken those before it. ``run``
    starts the query on a stream until all that is there is read, and goes on from its checkpoint when called again."""
    folder = scratch(spark)
    for t in tables:
        t.write.mode("append").parquet(folder)
        run(spark.readStream.schema(t.schema).parquet(folder)).awaitTermination()


@query("st4_late_corrections", f"with {READINGS} select campaign, batch_id, point_id, expert_id, transition, seq from newest")
def st4(spark, d):
    rows = readings(spark, d).select("campaign", "batch_id", "point_id", "expert_id", "transition", "labelled_at", "seq")
    middle = rows.agg(F.percentile_approx("seq", 0.5).alias("m"))
    halves = [rows.crossJoin(F.broadcast(middle)).filter(c).drop("m") for c in ("seq > m", "seq <= m")]  # one row; the later half comes first
    folder = scratch(spark)
    each_in_turn(spark, lambda stream: L.upsert_stream(stream, folder, f"{folder}/checkpoint", merge=L.newest), *halves)
    return L.current(spark, folder).select("campaign", "batch_id", "point_id", "expert_id", "transition", "seq")


@query("st8_closed_hours", "with m as (select max(ts) - interval 2 hour as w from events) select date_trunc('hour', ts)::varchar as hour, count(*) as n from events, m where date_trunc('hour', ts) + interval 1 hour <= w group by 1")
def st8_closed(spark, d):
    """Hours that the watermark has closed, from three batches; the third has rows that are far too late, and none counts."""
    rows = readings(spark, d).select("campaign", "batch_id", "point_id", "expert_id", "transition", F.col("labelled_at").cast("timestamp").alias("labelled_at"), "seq")
    ends = rows.agg(F.min("labelled_at").alias("a"), F.max("labelled_at").alias("b"))
    cut = F.col("a") + (F.col("b") - F.col("a")) / 2
    first, second = (rows.crossJoin(F.broadcast(ends)).filter(c).drop("a", "b") for c in (F.col("labelled_at") < cut, F.col("labelled_at") >= cut))  # one row
    late = first.withColumn("seq", F.col("seq") + 10**9).crossJoin(F.broadcast(ends)).filter(F.col("labelled_at") < F.col("a") + F.expr("interval 1 day")).drop("a", "b")  # one row
    folder = scratch(spark)

    def write(batch, number):
        batch.write.mode("overwrite").parquet(f"{folder}/v={number:08d}")

    def run(stream):
        return L.hourly(stream).writeStream.outputMode("append").option("checkpointLocation", f"{folder}/checkpoint").foreachBatch(write).trigger(availableNow=True).start()

    each_in_turn(spark, run, first, second, late)
    return spark.read.parquet(f"{folder}/v=*").select(F.date_format("hour", "yyyy-MM-dd HH:mm:ss").alias("hour"), "n")


@query("st2_stamp", f"with {READINGS} select coalesce(transition, '') as transition, count(*) as n from readings group by 1")
def st2(spark, d):
    return L.stamped(readings(spark, d).select("transition", "seq")).groupBy("transition").agg(F.count("received_at").alias("n"))


@query("io1_area_shards", "select 's' || s_nationkey as stratum, round(sum(round(s_acctbal + 1000, 2)) / 1e6, 6) as area from supplier group by 1 having sum(round(s_acctbal + 1000, 2)) > 0")
def io1(spark, d):
    folder = scratch(spark)
    s = read(spark, d, "supplier").select(F.col("s_nationkey").cast("string").alias("stratum"), F.round(F.col("s_acctbal") + 1000, 2).cast("decimal(18,2)").cast("string").alias("area"))
    s.repartition(4).write.option("header", True).csv(folder)
    lookup = read(spark, d, "nation").select(F.col("n_nationkey").cast("int").alias("id"), F.concat(F.lit("s"), "n_nationkey").alias("stratum"))
    return T.area_shards(spark, folder, lookup)


@query("io5_candidate_csv", "select c_custkey::varchar as id, c_name as name from customer")
def io5(spark, d):
    folder = scratch(spark) + ".csv"
    read(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("id"), F.col("c_name").alias("name")).write.option("header", True).option("quoteAll", True).csv(folder)
    return T.candidates(spark, folder)


@query("io4_geojson", "select c_custkey as id, round(c_acctbal / 100, 2) as lon, c_nationkey as lat from customer")
def io4(spark, d):
    folder = scratch(spark)
    c = read(spark, d, "customer")
    f = F.struct(F.struct(F.col("c_custkey").alias("id")).alias("properties"), F.struct(F.array(F.round(F.col("c_acctbal") / 100, 2), F.col("c_nationkey").cast("double")).alias("coordinates")).alias("geometry"))
    c.groupBy((F.col("c_custkey") % 5).alias("shard")).agg(F.collect_list(f).alias("features")).drop("shard").repartition(5).write.option("maxRecordsPerFile", 1).json(folder)
    return T.geojson(spark, folder).select("id", "lon", F.col("lat").cast("long").alias("lat"))


@query("io7_label_export", f"with {READINGS} select campaign, count(*) as n, count(distinct point_id) as points from readings group by 1")
def io7(spark, d):
    folder = scratch(spark)
    readings(spark, d).select("campaign", "batch_id", "point_id", "expert_id", "transition", "labelled_at").write.option("header", True).csv(folder)
    return T.label_export(spark, folder).groupBy("campaign").agg(F.count("labelled_at").alias("n"), F.count_distinct("point_id").alias("points"))


@query("io10_write_batches", "select (c_nationkey)::varchar as batch_id, count(*) as n, arg_min(c_custkey, c_custkey) as first from customer group by 1")
def io10(spark, d):
    folder = scratch(spark)
    T.write_batches(read(spark, d, "customer").select(F.concat(F.lit("b"), "c_nationkey").alias("batch_id"), F.col("c_custkey").alias("rank"), "c_acctbal"), folder)
    back = spark.read.json(folder)
    return back.select(F.substring("batch_id", 2, 9).alias("batch_id"), "n", F.col("points")[0]["rank"].alias("first"))


@query("io12_append_ledger", "select o_orderstatus as arm, count(*) as n, count(o_totalprice) filter (o_orderkey % 2 = 0) as priced from orders group by 1")
def io12(spark, d):
    folder = scratch(spark)
    o = read(spark, d, "orders").select(F.col("o_orderstatus").alias("arm"), "o_orderkey", "o_totalprice")
    o.filter("o_orderkey % 2 = 0").write.parquet(folder)
    T.append_ledger(o.filter("o_orderkey % 2 = 1").drop("o_totalprice"), folder)
    return spark.read.parquet(folder).groupBy("arm").agg(F.count("*").alias("n"), F.count("o_totalprice").alias("priced"))


@query("io13_merge_keyed", "select o_custkey, count(*) as n, sum((o_orderkey % 3 = 0)::int)::bigint as replaced from orders group by 1")
def io13(spark, d):
    o = read(spark, d, "orders").select("o_orderkey", "o_custkey", F.lit(0).alias("replaced"))
    return T.merge_keyed(o, o.filter("o_orderkey % 3 = 0").withColumn("replaced", F.lit(1)), ["o_orderkey"]).groupBy("o_custkey").agg(F.count("*").alias("n"), F.sum("replaced").alias("replaced"))


@query("io11_manifest", "select s_suppkey as batch_id, s_nationkey * (case when s_suppkey % 2 = 0 then -1 else 1 end) as n from supplier")
def io11(spark, d):
    s = read(spark, d, "supplier").select(F.col("s_suppkey").alias("batch_id"), F.col("s_nationkey").cast("long").alias("n"), (F.col("s_suppkey") % 7 == 0).alias("calibration"), F.when(F.col("s_suppkey") % 3 == 0, "teach").otherwise("label").alias("stage"), F.col("s_suppkey").alias("build_seq"))
    return T.merged_manifest(s, s.filter("batch_id % 2 = 0").withColumn("n", -F.col("n"))).select("batch_id", "n")


@query("io15_exclusion_list", f"with {READINGS} select distinct point_id from readings where transition is not null")
def io15(spark, d):
    folder = scratch(spark)
    readings(spark, d).filter("transition is not null").select("point_id").distinct().write.option("header", True).csv(folder)
    return spark.read.option("header", True).csv(folder)

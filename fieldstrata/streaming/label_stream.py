"""The label stream: submissions upserted by key, late corrections, running status and hourly counts.

``upsert_stream`` keeps the newest row of each (campaign, batch, point, expert) as versioned Parquet folders in a
shared place: each micro-batch writes the merged table to a new version and then a marker, so a batch that is run
again after a failure rewrites its own version and nothing else.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.labels import KEY, keep_last

SCHEMA = "campaign string, batch_id string, point_id string, expert_id string, transition string, labelled_at timestamp, seq long"


def stamped(rows: DataFrame) -> DataFrame:
    """received_at, lists joined to text, nulls as ''."""
    flat = rows.select(*[F.array_join(c, "|").alias(c) if t.startswith("array") else F.coalesce(c, F.lit("")).alias(c) if t == "string" else F.col(c) for c, t in rows.dtypes])
    return flat.withColumn("received_at", F.current_timestamp())


def merged(old: DataFrame | None, new: DataFrame) -> DataFrame:
    """Old rows whose key has no new row, and the last new row of each key; new columns are added on the right."""
    last = keep_last(new, KEY, F.desc("seq"))
    if old is None:
        return last
    return old.join(last.select(*KEY), KEY, "left_anti").unionByName(last, allowMissingColumns=True)


def newest(old: DataFrame | None, new: DataFrame) -> DataFrame:
    """Of each key's old and new rows the one with the latest labelled_at (then seq), in whatever order they have come: a
    late correction wins if it was made later, and an old reading that arrives late does not."""
    rows = new if old is None else old.unionByName(new, allowMissingColumns=True)
    return keep_last(rows, KEY, F.desc("labelled_at"), F.desc("seq"))


def acknowledged(rows: DataFrame, request: str) -> DataFrame:
    """(request, accepted, refused): of each request the (point_id, seq) that are stored, and how many rows are not, for want
    of a batch, point or time. A request is small: one submission of a reader."""
    fine = F.col("batch_id").isNotNull() & F.col("point_id").isNotNull() & F.col("labelled_at").isNotNull()
    found = rows.groupBy(request).agg(F.sort_array(F.collect_list(F.when(fine, F.struct("point_id", "seq")))).alias("accepted"), F.count_if(~fine).alias("refused"))
    return found.filter(F.col(request).isNotNull())


def upsert_stream(stream: DataFrame, folder: str, checkpoint: str, once: bool = True, merge: Callable[[DataFrame | None, DataFrame], DataFrame] = merged) -> StreamingQuery:
    """Write the upserted table of a stream of submissions to folder/v=<batch>. ``merge``: what stays of old and new rows of
    one key, the last to arrive (``merged``) or the last to be made (``newest``)."""

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        old = current(spark, folder, before=number)
        merge(old, batch).write.mode("overwrite").parquet(f"{folder}/v={number:08d}")

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def current(spark: SparkSession, folder: str, before: int | None = None) -> DataFrame | None:
    """The newest complete version (before a batch number), or None."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    if not fs.exists(path):
        return None
    found = sorted(s.getPath().getName() for s in fs.listStatus(path) if s.getPath().getName().startswith("v="))
    found = [v for v in found if (before is None or int(v[2:]) < before) and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{v}/_SUCCESS"))]
    return spark.read.parquet(f"{folder}/{found[-1]}") if found else None


def hourly(stream: DataFrame, late: str = "2 hours") -> DataFrame:
    """Labels per hour of labelled_at, exact duplicates dropped, rows later than the watermark left out."""
    return stream.withWatermark("labelled_at", late).dropDuplicatesWithinWatermark([*KEY, "seq"]).groupBy(F.window("labelled_at", "1 hour")).agg(F.count("*").alias("n")).select(F.col("window.start").alias("hour"), "n")


def running_status(stream: DataFrame) -> DataFrame:
    """Rows and calls of each batch so far (complete or update mode)."""
    return stream.groupBy("batch_id").agg(F.count("*").alias("n"), F.count("transition").alias("called"))

"""The label stream over several micro-batches: arrival against the time of a reading, and rows behind the watermark."""

import datetime

import pytest
from pyspark.sql import functions as F

from fieldstrata.plans import streams
from fieldstrata.streaming import label_stream as L

AT = datetime.datetime(2026, 1, 1)


def batch(spark, *rows):
    return spark.createDataFrame([("c", "b", p, "e", t, AT + datetime.timedelta(hours=h), s) for p, t, h, s in rows], L.SCHEMA)


@pytest.mark.parametrize(("merge", "want"), [(L.merged, {"1": "old", "2": "again", "3": "c"}), (L.newest, {"1": "new", "2": "again", "3": "c"})])
def test_batches_out_of_order(spark, tmp_path, merge, want):
    """The later reading of point 1 comes first: it stays by its time and goes by arrival."""
    stream = streams.in_turn(spark, batch(spark, ("1", "new", 50, 9), ("2", "once", 1, 1)), batch(spark, ("1", "old", 3, 2), ("2", "again", 4, 3), ("3", "c", 1, 4)))
    L.upsert_stream(stream, f"{tmp_path}/out", f"{tmp_path}/ck", merge=merge).awaitTermination()
    assert {r.point_id: r.transition for r in L.current(spark, f"{tmp_path}/out").collect()} == want


def test_rows_behind_the_watermark(spark, tmp_path):
    """A row that comes after its hour is closed is left out; one that is late but within two hours counts."""
    first, second = batch(spark, ("1", "a", 0.1, 1), ("2", "a", 0.2, 2), ("3", "a", 1.5, 3)), batch(spark, ("4", "a", 0.3, 4), ("5", "a", 9.5, 5))
    # rows are late by the watermark that the batch before last has set
    third, fourth = batch(spark, ("7", "a", 8.1, 7)), batch(spark, ("6", "a", 0.4, 6), ("8", "a", 20.0, 8))

    def write(rows, number):
        rows.write.mode("overwrite").parquet(f"{tmp_path}/out/v={number:08d}")

    hours = L.hourly(streams.in_turn(spark, first, second, third, fourth))
    hours.writeStream.outputMode("append").option("checkpointLocation", f"{tmp_path}/ck").foreachBatch(write).trigger(availableNow=True).start().awaitTermination()
    got = {r.hour: r.n for r in spark.read.parquet(f"{tmp_path}/out/v=*").select(F.hour("hour").alias("hour"), "n").collect()}
    assert got == {0: 3, 1: 1, 8: 1, 9: 1}

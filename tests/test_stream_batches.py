"""Tables that a stream takes one after the other, each written by several tasks."""

from fieldstrata.plans import streams


def test_each_table_is_one_batch_of_many_files(spark, tmp_path, monkeypatch):
    folder, seen = tmp_path / "in", []
    monkeypatch.setattr(streams, "scratch", lambda _: str(folder))

    def run(stream):
        def write(batch, number):
            seen.append((sorted(r.id for r in batch.collect()), len(list(folder.glob("*.parquet")))))

        return stream.writeStream.option("checkpointLocation", f"{tmp_path}/ck").foreachBatch(write).trigger(availableNow=True).start()

    streams.each_in_turn(spark, run, spark.range(0, 40, numPartitions=4), spark.range(40, 50, numPartitions=2))
    assert seen == [(list(range(40)), 4), (list(range(40, 50)), 6)]

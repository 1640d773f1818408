"""Progress reports of streams and batches: counts and order."""

import time

from pyspark.sql import functions as F

from lyrebird.streaming import progress


def test_stream_reports_each_batch_in_order(spark, tmp_path):
    for k, n in enumerate((5, 3, 4)):
        spark.range(10 * k, 10 * k + n).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(0.05)  # files are taken by their time
    stream = spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    pieces = []
    with progress.reported(spark, "pieces", lambda batch, m: pieces.append((batch, m["n"], m["top"]))):
        watched = progress.observed(stream, "pieces", n=F.count(F.lit(1)), top=F.max("id"))
        query = watched.writeStream.format("noop").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        query.awaitTermination()
        until = time.time() + 20
        while len(pieces) < 3 and time.time() < until:
            time.sleep(0.1)
    assert pieces[:3] == [(0, 5, 4), (1, 3, 12), (2, 4, 23)]


def test_batch_metrics_come_with_the_action(spark):
    df, watch = progress.counted(spark.range(100).where("id % 3 = 0"), "rows", n=F.count(F.lit(1)))
    assert df.agg(F.sum("id")).first()[0] == sum(range(0, 100, 3))
    assert watch.get["n"] == 34

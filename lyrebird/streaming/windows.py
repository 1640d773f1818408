"""Sliding event-time windows of a stream, with rows that come too late kept aside.

A batch is judged by the watermark of the batches before it: their latest time less a delay. A row counts in each of
its windows that end after the watermark; where a window has ended, the row is late for it, is counted as such and is
written to a folder of its own. Counts are kept as parts, one folder a batch, named by the batch and overwritten when it is
run again; the watermark is written last. So a batch that fails half-way and starts again counts once, and no state is
held in memory. Parts add up to the windows at any time. Rows without a time are in no window and move no watermark.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lyrebird.session import table
from lyrebird.sources import scratch

PARTS = "began timestamp_ntz, n long, n_late long"
MARK = "top timestamp_ntz, batch long"
ARRIVALS = "ts timestamp_ntz, event_id long"


def paired(rows: DataFrame, time: str, width: str, slide: str, ended: Column) -> DataFrame:
    """rows once for each window they are in, with `w` and `late`."""
    return rows.where(F.col(time).isNotNull()).withColumn("w", F.window(time, width, slide)).withColumn("late", F.coalesce(F.col("w.end").cast("timestamp_ntz") <= ended, F.lit(False)))


def last_mark(spark: SparkSession, home: str, before: int) -> object:
    """The latest time seen in batches before one; each batch wrote that of all up to it."""
    if before <= 0:
        return None
    return spark.read.schema(MARK).parquet(f"{home}/marks/{before - 1}").first().top  # one row


def counted(home: str, time: str, width: str, slide: str, delay: str):
    """What a stream does with each batch, for foreachBatch."""

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        seen = last_mark(spark, home, number)
        top = F.lit(seen).cast("timestamp_ntz")
        pairs = paired(batch, time, width, slide, top - F.expr(f"INTERVAL {delay}"))
        n = pairs.groupBy(F.col("w.start").cast("timestamp_ntz").alias("began")).agg(F.sum((~F.col("late")).cast("long")).alias("n"), F.sum(F.col("late").cast("long")).alias("n_late"))
        n.write.mode("overwrite").parquet(f"{home}/parts/{number}")
        pairs.where("late").select(F.col("w.start").cast("timestamp_ntz").alias("began"), *batch.columns).write.mode("overwrite").parquet(f"{home}/late/{number}")
        mark = batch.agg(F.max(F.col(time).cast("timestamp_ntz")).alias("top")).select(F.greatest("top", top).alias("top"), F.lit(number).cast("long").alias("batch"))
        mark.coalesce(1).write.mode("overwrite").parquet(f"{home}/marks/{number}")

    return run


def run(rows: DataFrame, home: str, time: str, width: str, slide: str, delay: str) -> None:
    """Streams what is there now; a later run goes on from the progress kept in home."""
    rows.writeStream.foreachBatch(counted(home, time, width, slide, delay)).option("checkpointLocation", f"{home}/progress").trigger(availableNow=True).start().awaitTermination()


def windows(spark: SparkSession, home: str) -> DataFrame:
    """(began, n, n_late): rows counted in time and rows too late, of every window so far."""
    parts = spark.read.schema(PARTS).parquet(f"{home}/parts/*")
    return parts.groupBy("began").agg(F.sum("n").alias("n"), F.sum("n_late").alias("n_late"))


def of_events(spark: SparkSession, sf_dir: str, arrivals: int = 4) -> DataFrame:
    """Events in the order of their time in a few arrivals, every tenth one arrival late, each streamed by a run of its own."""
    home = scratch.shared(spark, "windows")
    events = table(spark, sf_dir, "events").select("ts", "event_id")
    ends = events.agg(F.min("ts").alias("low"), F.max("ts").alias("high"))  # one row
    seconds = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    share = (seconds("ts") - seconds("low")) / (seconds("high") - seconds("low") + 1)
    own = events.crossJoin(F.broadcast(ends)).withColumn("arrival", F.floor(share * arrivals) + F.when(F.col("event_id") % 10 == 0, 1).otherwise(0))
    own.select("ts", "event_id", "arrival").write.partitionBy("arrival").parquet(f"{home}/arrivals")
    for arrival in range(arrivals + 1):
        came = spark.read.schema(f"{ARRIVALS}, arrival int").parquet(f"{home}/arrivals").where(F.col("arrival") == arrival)
        came.select("ts", "event_id").write.mode("append").parquet(f"{home}/arrived")
        run(spark.readStream.schema(ARRIVALS).parquet(f"{home}/arrived"), home, "ts", "2 hours", "1 hour", "3 HOURS")
    return windows(spark, home)

"""A keyed stream buffered into full chunks: pieces of any size go in, tumbling chunks of a fixed size come out.

State is the session's open buffer, shorter than a chunk, and the number of chunks so far, so it
doesn't grow with the stream. With a timeout a silent session's rest is flushed and its state dropped.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState

OUTPUT = "session long, chunk long, size int, total double, last boolean"
STATE = "buffer array<double>, chunks long"
EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def chunked(pieces: DataFrame, size: int, timeout: str | None = None) -> DataFrame:
    """Chunks of `size` values of each session of (session, seq, value); values of a batch are taken in the order of seq."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        buffer, chunks = state.get if state.exists else ([], 0)
        buffer, rows = list(buffer), []
        if state.hasTimedOut:
            if buffer:
                rows.append((key[0], chunks, len(buffer), sum(buffer), True))
            state.remove()
        else:
            own = pd.concat(list(batches)).sort_values("seq")
            buffer += own["value"].tolist()
            while len(buffer) >= size:
                rows.append((key[0], chunks, size, sum(buffer[:size]), False))
                buffer, chunks = buffer[size:], chunks + 1
            state.update((buffer, chunks))
            if timeout:
                state.setTimeoutDuration(timeout)
        yield pd.DataFrame(rows, columns=["session", "chunk", "size", "total", "last"])

    return pieces.groupBy("session").applyInPandasWithState(run, OUTPUT, STATE, "append", "ProcessingTimeTimeout" if timeout else "NoTimeout")


def windowed(events: DataFrame, late: str = "10 minutes", width: str = "40 seconds") -> DataFrame:
    """Counts and sums of tumbling event-time windows, closed once `late` has passed."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("began"), "event_type", "n", "total")


def run_to_end(spark: SparkSession, sf_dir: str, size: int) -> DataFrame:
    """The chunks of the event table, streamed to the end of what is there now; sink and progress live in the shared folder."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not root:
        import tempfile

        root = tempfile.mkdtemp(prefix="lyrebird-")
    home = f"{root}/stream-{uuid.uuid4().hex}"
    events = spark.readStream.schema(EVENTS).parquet(f"{sf_dir}/events.parque[t]")  # a pattern, so that a file will do as well as a folder
    pieces = events.select((F.col("user_id") % 50).alias("session"), F.col("event_id").alias("seq"), "value")
    query = chunked(pieces, size).writeStream.format("parquet").option("path", f"{home}/out").option("checkpointLocation", f"{home}/progress").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(OUTPUT).parquet(f"{home}/out").select("session", "chunk", "size", F.round("total", 6).alias("total"), "last")

"""Reports while work runs: metrics observed on the rows that pass, handed to a reporter piece by piece."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql.streaming.listener import StreamingQueryListener

Reporter = Callable[[int, dict], None]


class _Pieces(StreamingQueryListener):
    def __init__(self, name: str, report: Reporter) -> None:
        self.name, self.report = name, report

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        metrics = event.progress.observedMetrics.get(self.name)
        if metrics is not None:
            self.report(event.progress.batchId, metrics.asDict())

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass


@contextmanager
def reported(spark: SparkSession, name: str, report: Reporter) -> Iterator[None]:
    """While open, calls report(batch, metrics) after each micro-batch of streams that observe under `name`, in their order.

    A batch without rows of its own, such as one that only moves the watermark, is reported with its zero counts.
    """
    listener = _Pieces(name, report)
    spark.streams.addListener(listener)
    try:
        yield
    finally:
        spark.streams.removeListener(listener)


def observed(df: DataFrame, name: str, **metrics: Column) -> DataFrame:
    """df, batch or stream, with aggregates taken as its rows pass; no job or shuffle is added."""
    return df.observe(name, *[c.alias(n) for n, c in metrics.items()])


def counted(df: DataFrame, name: str, **metrics: Column) -> tuple[DataFrame, Observation]:
    """A batch df and the observation that holds its metrics once an action has run."""
    watch = Observation(name)
    return df.observe(watch, *[c.alias(n) for n, c in metrics.items()]), watch

"""Comparison of runs: benchmark builds joined on their keys, profiles, throughput, pivots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lyrebird.operators.ranks import later_half


def compare_builds(runs: DataFrame, keys: list[str], build: str, base: str, other: str, metric: str) -> DataFrame:
    """Mean of a metric for two builds, for each key that both ran; null keys never match.

    Each side is averaged before the join. A join of raw rows would multiply them, and the mean over
    all pairs of a key is the same.
    """
    sides = [runs.where((F.col(build) == value) & F.col(metric).isNotNull()).groupBy(*keys).agg(F.avg(metric).alias(name)) for value, name in ((base, "avg_base"), (other, "avg_other"))]
    return sides[0].join(sides[1], keys).withColumn("speedup", F.try_divide("avg_other", "avg_base"))


def latest_build(runs: DataFrame, build: str, time: str) -> DataFrame:
    """The build of the newest run; equal times go to the greater build."""
    return runs.agg(F.max_by(build, F.struct(time, build)).alias("latest_build"), F.max(time).alias("latest_time"))


def profile_shares(events: DataFrame, op: str, duration: str, order: list[Column], bin_of: Column, least_percent: float = 0.1) -> DataFrame:
    """Mean duration, calls and share of each op, without the first half of each op's events (the warm-up run); `bin_of` cuts the order into bins."""
    kept = later_half(events, op, bin_of, order)
    sums = kept.groupBy(op).agg(F.avg(duration).alias("mean_value"), F.count(F.lit(1)).alias("calls"), F.sum(duration).alias("total"))
    share = 100 * F.col("total") / F.sum("total").over(Window.partitionBy())  # over a row an op
    return sums.withColumn("share_percent", share).where(F.col("share_percent") >= least_percent)


def throughput(samples: DataFrame, keys: list[str], value: str, count: str) -> DataFrame:
    """Count, sum, mean, largest, and the depth sum of i * (i + 1) / 2."""
    depth = F.sum(F.col(count) * (F.col(count) + 1) / 2)
    return samples.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"), F.avg(value).alias("mean"), F.max(value).alias("largest"), depth.alias("depth"))


def support_matrix(rows: DataFrame, op: str, backend: str, supported: Column, backends: list[str]) -> DataFrame:
    """For each op a column a backend: supported, partially supported where mixed, else unsupported."""
    verdict = F.when(F.bool_and(supported), "supported").when(F.bool_or(supported), "partially supported").otherwise("unsupported")
    matrix = rows.groupBy(op).pivot(backend, backends).agg(verdict)
    return matrix.select(op, *[F.coalesce(F.col(b), F.lit("unsupported")).alias(b) for b in backends])


def ratio(n: Column, d: Column) -> Column:
    """n / d, and 0 where d isn't above 0."""
    return F.when(d > 0, n / d).otherwise(0.0)


def markdown(rows: DataFrame, columns: list[str]) -> DataFrame:
    """A Markdown table line of each row."""
    cells = [F.coalesce(F.regexp_replace(F.col(c).cast("string"), r"\|", r"\\|"), F.lit("")) for c in columns]
    return rows.select(F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("line"))

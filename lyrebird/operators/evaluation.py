"""Evaluation statistics: likelihoods, divergence, accuracy, activation statistics, errors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def mean_and_uncertainty(x: str) -> list[Column]:
    """Mean and its uncertainty, 0 for ten values or fewer, as aggregates named mean and unc."""
    n = F.count(x)
    variance = F.avg(F.col(x) * F.col(x)) - F.avg(x) * F.avg(x)
    return [F.avg(x).alias("mean"), F.when((n > 10) & (variance > 0), F.sqrt(variance / (n - 1))).otherwise(0.0).alias("unc")]


def nll(logits: DataFrame, key: str, tok: str, x: str, target: Column) -> DataFrame:
    """(key, nll) of the target token of each step: -(x_t - max - ln sum exp(x - max))."""
    stats = logits.withColumn("m", F.max(x).over(Window.partitionBy(key)))
    return stats.groupBy(key).agg((F.max("m") + F.log(F.sum(F.exp(F.col(x) - F.col("m")))) - F.max(F.when(F.col(tok) == target, F.col(x)))).alias("nll"))


def perplexity(nlls: DataFrame, value: str = "nll") -> DataFrame:
    """exp of the mean with its uncertainty."""
    summed = nlls.agg(F.count(value).alias("n"), *mean_and_uncertainty(value))
    return summed.select("n", F.exp("mean").alias("ppl"), (F.exp("mean") * F.col("unc")).alias("ppl_unc"))


def divergence(pairs: DataFrame, key: str, tok: str, base: str, other: str) -> DataFrame:
    """For each step the divergence of two log-probability columns, whether their best tokens agree, and the change of the target's p.

    Base terms at or below -16 are left out.
    """
    term = F.when(F.col(base) > -16, F.exp(base) * (F.col(base) - F.col(other))).otherwise(0.0)
    best = [F.min_by(tok, F.struct((-F.col(c)).alias("v"), F.col(tok))) for c in (base, other)]
    return pairs.groupBy(key).agg(F.sum(term).alias("kl"), (best[0] == best[1]).alias("same_top"))


def accuracy(hits: DataFrame, hit: str) -> DataFrame:
    """Share of true rows with its binomial uncertainty."""
    p = F.avg(F.col(hit).cast("double"))
    n = F.count(F.lit(1))
    return hits.agg(n.alias("n"), p.alias("acc"), F.when(n > 1, F.sqrt(p * (1 - p) / (n - 1))).otherwise(0.0).alias("unc"))


def column_activations(rows: DataFrame, tensor: str, vector: str) -> DataFrame:
    """Sum of squares and count for each tensor and column."""
    long = rows.select(tensor, F.posexplode(vector).alias("col", "v")).withColumn("v", F.col("v").cast("double"))
    return long.groupBy(tensor, "col").agg(F.sum(F.col("v") * F.col("v")).alias("sum2"), F.count(F.lit(1)).alias("n"))


def activation_statistics(columns: DataFrame, tensor: str) -> DataFrame:
    """Statistics of a tensor's mean activations: total, mean, extremes, deviation, active share, entropy in bits, share above one deviation."""
    act = columns.withColumn("act", F.col("sum2") / F.col("n"))
    by = Window.partitionBy(tensor)
    shared = act.withColumns({"p": F.col("act") / F.sum("act").over(by), "z": (F.col("act") - F.avg("act").over(by)) / F.stddev_pop("act").over(by)})
    return shared.groupBy(tensor).agg(
        F.sum("act").alias("total"), F.avg("act").alias("mean"), F.min("act").alias("least"), F.max("act").alias("most"), F.stddev_pop("act").alias("sigma"),
        F.avg((F.abs("act") > 1e-5).cast("double")).alias("active"), (-F.sum(F.when(F.col("p") > 0, F.col("p") * F.log2("p")))).alias("entropy"), F.avg((F.col("z") > 1).cast("double")).alias("zd"),
    )


def errors(pairs: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    """Of two value columns: mean absolute error, root of squared errors over n, squared errors over squares, cosine."""
    x, y, d = F.col(a), F.col(b), F.col(a) - F.col(b)
    return pairs.groupBy(*keys).agg(
        F.avg(F.abs(d)).alias("mae"), (F.sqrt(F.sum(d * d)) / F.count(F.lit(1))).alias("rmse"), F.try_divide(F.sum(d * d), F.sum(x * x)).alias("nmse"), F.try_divide(F.sum(x * y), F.sqrt(F.sum(x * x)) * F.sqrt(F.sum(y * y))).alias("cosine")
    )

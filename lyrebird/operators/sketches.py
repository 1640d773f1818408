"""Sketches of distinct counts and quantiles that can be stored and merged: each group has one row of bounded size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits of the distinct sketch's buckets, its standard error, and the size of the quantile sketch.
LOG_BUCKETS, ERROR, QUANTILE_SIZE = 14, 1.04 / 2**7, 400


def sketched(rows: DataFrame, keys: list[str], item: str, value: str) -> DataFrame:
    """(keys, n, items, values): counts and sketches of each group, put together where the rows lie before the shuffle. Nulls count in n only."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.hll_sketch_agg(item, F.lit(LOG_BUCKETS)).alias("items"), F.kll_sketch_agg_double(F.col(value).cast("double"), F.lit(QUANTILE_SIZE)).alias("values"))


def merged(stored: DataFrame, keys: list[str]) -> DataFrame:
    """Stored sketches, of other hours or machines say, as those of coarser groups; merging merged ones is right too."""
    return stored.groupBy(*keys).agg(F.sum("n").alias("n"), F.hll_union_agg("items").alias("items"), F.kll_merge_agg_double("values", F.lit(QUANTILE_SIZE)).alias("values"))


def estimated(sketches: DataFrame, keys: list[str], shares: dict[str, float]) -> DataFrame:
    """(keys, n, users, a column a share): distinct items and quantiles; quantiles of no values are null."""
    some = F.kll_sketch_get_n_double("values") > 0
    quantiles = [F.when(some, F.kll_sketch_get_quantile_double("values", F.lit(share))).alias(name) for name, share in shares.items()]
    return sketches.select(*keys, "n", F.hll_sketch_estimate("items").alias("users"), *quantiles)

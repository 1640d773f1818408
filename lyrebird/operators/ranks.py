"""Row numbers and quantiles within groups of which a few may hold all rows: bins spread a group over tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def numbered(rows: DataFrame, group: list[str], bin_of: Column, order: list[Column | str], name: str = "rn") -> DataFrame:
    """rows with their number from 1 in each group by `order`, whose bins `bin_of` must follow.

    Rows are numbered within their bin, and the sizes of the bins before are added, so a task needs
    the rows of one bin of a group; the running sum is over a row a bin.
    """
    keys = [*group, "_bin"]
    binned = rows.withColumn("_bin", bin_of)
    sizes = binned.groupBy(*keys).agg(F.count(F.lit(1)).alias("_size"))
    before = F.coalesce(F.sum("_size").over(Window.partitionBy(*group).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select(*keys, before.alias("_start"))
    within = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    same = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]
    joined = binned.withColumn("_own", within).alias("a").join(starts.alias("b"), same)
    return joined.select(*[f"a.{c}" for c in rows.columns], (F.col("a._own") + F.col("b._start")).alias(name))


def later_half(rows: DataFrame, group: str, bin_of: Column, order: list[Column]) -> DataFrame:
    """The rows of each group without its first half by `order`; only the rows of the bin that holds the middle are put in order."""
    binned = rows.withColumn("_bin", bin_of)
    sizes = binned.groupBy(group, "_bin").agg(F.count(F.lit(1)).alias("_size"))
    by = Window.partitionBy(group)
    upto = F.coalesce(F.sum("_size").over(by.orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counted = sizes.withColumns({"_before": upto, "_half": F.floor(F.sum("_size").over(by) / 2)})
    middle = counted.where((F.col("_before") <= F.col("_half")) & (F.col("_before") + F.col("_size") > F.col("_half"))).select(F.col(group).alias("_group"), F.col("_bin").alias("_middle"), (F.col("_half") - F.col("_before")).alias("_skip"))
    placed = binned.join(middle, F.col(group).eqNullSafe(F.col("_group")))
    whole = placed.where(F.col("_bin") > F.col("_middle"))
    edge = placed.where(F.col("_bin").eqNullSafe(F.col("_middle"))).withColumn("_rn", F.row_number().over(Window.partitionBy(group).orderBy(*order)))
    return whole.select(*rows.columns).union(edge.where(F.col("_rn") > F.col("_skip")).select(*rows.columns))


def quantiles(rows: DataFrame, group: str, value: str, width: float, shares: list[float]) -> DataFrame:
    """(group, share, quantile) by linear interpolation, exact: bins of `width` find where each quantile lies, and only those bins are put in order."""
    kept = rows.where(F.col(value).isNotNull()).select(group, value, F.floor(F.col(value) / width).alias("_bin"))
    sizes = kept.groupBy(group, "_bin").agg(F.count(F.lit(1)).alias("_size"))
    by = Window.partitionBy(group)
    upto = F.coalesce(F.sum("_size").over(by.orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counted = sizes.withColumns({"_before": upto, "_all": F.sum("_size").over(by)})
    at = F.explode(F.array(*map(F.lit, shares)))
    asked = counted.select("*", at.alias("share")).withColumn("_at", F.col("share") * (F.col("_all") - 1))
    ends = asked.select("*", F.explode(F.array_distinct(F.array(F.floor("_at"), F.ceil("_at")))).alias("_rank"))
    ends = ends.where((F.col("_rank") >= F.col("_before")) & (F.col("_rank") < F.col("_before") + F.col("_size"))).select(F.col(group).alias("_group"), F.col("_bin").alias("_b"), "_before", "_at", "share", "_rank")
    needed = ends.select("_group", "_b", "_before").distinct()
    ordered = kept.join(needed, F.col(group).eqNullSafe(F.col("_group")) & (F.col("_bin") == F.col("_b"))).withColumn("_own", F.row_number().over(Window.partitionBy(group, "_bin").orderBy(value)) - 1 + F.col("_before"))
    found = ordered.select(F.col(group).alias("_g"), F.col("_own").alias("_r"), value).join(ends, F.col("_g").eqNullSafe(F.col("_group")) & (F.col("_r") == F.col("_rank")))
    weight = F.greatest(F.lit(0.0), 1 - F.abs(F.col("_at") - F.col("_rank")))
    return found.groupBy(F.col("_g").alias(group), "share").agg(F.sum(F.col(value) * weight).alias("quantile"))


def sliding_mean(rows: DataFrame, group: list[str], bin_of: Column, order: list[str], value: str, width: int, name: str = "mean", block: int = 1024) -> DataFrame:
    """rows with the mean of `value` over the row and up to `width` - 1 before it in its group, nulls left out.

    Rows are numbered through bins and cut into blocks; the rows that a block's first ones look back to are copied into it, so
    a group of any size is spread over tasks and only every block's last `width` - 1 rows are copied.
    """
    block = max(block, width)
    placed = numbered(rows, group, bin_of, [F.col(c) for c in order], "_at").withColumn("_at", F.col("_at") - 1)
    own = F.floor(F.col("_at") / block)
    into = F.when(F.col("_at") % block > block - width, F.array(own, own + 1)).otherwise(F.array(own))
    copied = placed.select("*", own.alias("_own"), F.explode(into).alias("_block"))
    before = Window.partitionBy(*group, "_block").orderBy("_at").rowsBetween(1 - width, 0)
    return copied.withColumn(name, F.avg(value).over(before)).where(F.col("_own") == F.col("_block")).select(*[F.col(f"`{c}`") for c in rows.columns], name)

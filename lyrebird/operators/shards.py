"""Greedy shards of long sequences, without a sequence in one array or one task's memory."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lyrebird.sources.scratch import shared

#: Shards whose worth of sizes makes one bin, whose items are put in order and followed together.
SHARDS_A_BIN = 64


def prefix_sums(items: DataFrame, group: str, bin_of, order: list[str], size: str) -> DataFrame:
    """(g, before, upto): the sums of a group's sizes before and up to each item; only one bin of `bin_of` is put in order at a time."""
    own = items.select(F.col(group).alias("g"), bin_of.alias("bin"), F.struct(*order).alias("order"), F.col(size).cast("long").alias("size"))
    offset = F.coalesce(F.sum("all").over(Window.partitionBy("g").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bins = own.groupBy("g", "bin").agg(F.sum("size").alias("all")).select("g", "bin", offset.alias("offset"))
    upto = F.sum("size").over(Window.partitionBy("g", "bin").orderBy("order").rowsBetween(Window.unboundedPreceding, 0))
    same = own.withColumn("upto", upto).join(bins.select(F.col("g").alias("_g"), F.col("bin").alias("_bin"), "offset"), (F.col("g") == F.col("_g")) & F.col("bin").eqNullSafe(F.col("_bin")))
    return same.select("g", (F.col("offset") + F.col("upto") - F.col("size")).alias("before"), (F.col("offset") + F.col("upto")).alias("upto"))


def _chains(rows: pa.Table, most: int) -> pa.RecordBatch:
    """Whole bins of (g, bin, before, upto) in order to the rows of `heads`."""
    g, bins, before, upto = rows["g"].combine_chunks(), *(rows[c].to_numpy() for c in ("bin", "before", "upto"))
    n = len(before)
    fresh = np.append(True, pc.not_equal(g.slice(1), g.slice(0, n - 1)).to_numpy(zero_copy_only=False) | (bins[1:] != bins[:-1]))
    first = np.flatnonzero(fresh)
    end = np.append(first[1:], n)
    own = np.cumsum(fresh) - 1
    at = np.maximum(before + most, upto)
    # sums of one bin after those of the other, so that all are in one order
    base = before[first]
    span = upto[end - 1] - base + most + 1
    shift = (np.cumsum(span) - span - base)[own]
    following = np.searchsorted(shift + upto, shift + at, "right")
    inside = following < end[own]
    heads = np.flatnonzero(fresh | (before - bins * most * SHARDS_A_BIN < most))
    owner, item, last = np.arange(len(heads)), heads, heads.copy()
    owners, starts = [], []
    while len(item):  # a bin has two starts a shard's worth of sizes at most
        owners.append(owner)
        starts.append(before[item])
        last[owner] = item
        owner, item = owner[inside[item]], following[item[inside[item]]]
    owners, starts = np.concatenate(owners), np.concatenate(starts)
    ends = np.append(0, np.cumsum(np.bincount(owners, minlength=len(heads)))).astype(np.int32)
    chain = pa.ListArray.from_arrays(pa.array(ends), pa.array(starts[np.argsort(owners, kind="stable")]))
    return pa.RecordBatch.from_arrays([g.take(pa.array(heads)), pa.array(before[heads]), pa.array(upto[heads]), pa.array(at[last]), chain], ["g", "a", "upto", "at", "chain"])


def heads(sums: DataFrame, most: int) -> DataFrame:
    """(g, a, upto, at, chain): the items that may be the first start in their bin, the starts that follow in it, and the sum that the next one must exceed.

    Such an item lies less than `most` after the bin's begin, or is the bin's first. Bins hold SHARDS_A_BIN shards' worth of sizes.
    """
    binned = sums.withColumn("bin", F.floor(F.col("before") / (most * SHARDS_A_BIN)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            n = batch.num_rows
            g, bins = batch.column(0), batch.column(1)
            cuts = np.flatnonzero(pc.or_(pc.not_equal(g.slice(1), g.slice(0, n - 1)), pc.not_equal(bins.slice(1), bins.slice(0, n - 1))).to_numpy(zero_copy_only=False)) if n else []
            if held and n and (g[0] != held[-1].column(0)[-1] or bins[0] != held[-1].column(1)[-1]):
                yield _chains(pa.Table.from_batches(held), most)
                held = []
            if len(cuts):
                yield _chains(pa.Table.from_batches([*held, batch.slice(0, int(cuts[-1]) + 1)]), most)
                held, batch = [], batch.slice(int(cuts[-1]) + 1)
            if n:
                held.append(batch)
        if held:
            yield _chains(pa.Table.from_batches(held), most)

    ordered = binned.select("g", "bin", "before", "upto").repartition("g", "bin").sortWithinPartitions("g", "bin", "before")
    return ordered.mapInArrow(run, f"g {sums.schema['g'].dataType.simpleString()}, a long, upto long, at long, chain array<long>")


def next_heads(found: DataFrame, most: int) -> DataFrame:
    """(g, a, b): for each of `heads` the first start after its chain, itself one of them; the last has none.

    Heads and questions meet in bins of sums; what a bin leaves open is answered by the next bin's first head.
    """
    width = most * SHARDS_A_BIN
    none = F.lit(None).cast("long")
    data = found.select("g", F.col("upto").alias("at"), F.lit(1).alias("kind"), F.col("a").alias("start"), none.alias("a"))
    asked = found.select("g", "at", F.lit(0).alias("kind"), none.alias("start"), "a")
    points = data.union(asked).withColumn("bin", F.floor(F.col("at") / width))
    down = Window.partitionBy("g", "bin").orderBy(F.desc("at"), "kind").rowsBetween(Window.unboundedPreceding, 0)
    answered = points.withColumn("b", F.last("start", ignorenulls=True).over(down)).where("kind = 0")
    later = F.last("head", ignorenulls=True).over(Window.partitionBy("g").orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, -1))
    heads = points.groupBy("g", "bin").agg(F.min("start").alias("head")).select("g", "bin", later.alias("later"))
    return answered.join(heads, ["g", "bin"]).select("g", "a", F.coalesce("b", "later").alias("b")).where("b is not null")


def greedy_shards(items: DataFrame, group: str, bin_of, order: list[str], size: str, most: int) -> DataFrame:
    """(g, shard, began, size): items in order dealt to shards, a new one where the next item would exceed `most`.

    Starts are followed within a bin of sums in one pass. From bin to bin pointers are doubled, between `heads` only:
    k rounds find the first 2 ** k bins of every group. Each round is written to the shared folder. `order` tells
    items of a group apart, or ties have equal sizes; `bin_of` cuts that order into bins. Groups that are null and
    items without a positive size, as a whole number, are left out. No items give no rows.
    """
    spark = items.sparkSession
    home = shared(spark, "shards")

    def written(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{home}/{name}")
        return spark.read.schema(df.schema).parquet(f"{home}/{name}")

    sums = written(prefix_sums(items.where((F.col(size).cast("long") > 0) & F.col(group).isNotNull()), group, bin_of, order, size), "sums")
    bins = written(heads(sums, most), "heads")
    jumps = written(next_heads(bins, most), "jumps-0")
    starts = new = written(bins.where("a = 0").select("g", "a"), "starts-0")
    step = 0
    while not new.isEmpty():
        step += 1
        new = written(starts.join(jumps, ["g", "a"]).select("g", F.col("b").alias("a")), f"starts-{step}")
        starts = starts.union(new)
        onward = jumps.select("g", F.col("a").alias("b"), F.col("b").alias("c"))
        jumps = written(jumps.join(onward, ["g", "b"]).select("g", "a", F.col("c").alias("b")), f"jumps-{step}")
    totals = sums.groupBy("g").agg(F.max("upto").alias("total"))
    by = Window.partitionBy("g").orderBy("a")
    starts = starts.join(bins, ["g", "a"]).select("g", F.explode("chain").alias("a"))
    return starts.join(totals, "g").select("g", (F.row_number().over(by) - 1).alias("shard"), F.col("a").alias("began"), (F.coalesce(F.lead("a").over(by), F.col("total")) - F.col("a")).alias("size"))

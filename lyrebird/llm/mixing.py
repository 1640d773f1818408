"""Mixing sources to target weights by capped water-filling; column operations only.

Sources, ordered by code point with null last, share the size of the whole corpus by weight. A
source's target is capped at `max_epochs` times its own size; what is above is shared again among
the others by weight until no target is above its cap. A source is then repeated as a whole
floor(target / size) times, and once more for a seeded part of its documents that fills the rest.

The part: documents in the order of an MD5 of seed and doc_id are taken while the middle of each
lies within the rest, so a source misses its target by less than one document, and reruns agree.
A hot source is never gathered: sums are taken for each source and hash prefix first, and only the
one prefix that holds the boundary is put in order.

Null texts and texts without words have size 0 and take 0 words, but are repeated like others of their
source, within the cap; a very long text may miss its source's target by half its size; a null source is a source of its
own; repeated rows are documents of their own (equal rows may stand for each other). Empty tables
give no rows. Where all sizes are 0, all targets are 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lyrebird.llm.common import apart, cut, n_words, named_back, read

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
SEED = "mix-1"
#: Sources up to which their table of a few numbers each is broadcast; beyond, it is joined by shuffle.
BROADCAST_SOURCES = 50_000
#: Hex digits of a hash prefix: 4096 prefixes of each source.
PREFIX = 3


def ranked(rows: DataFrame, order: list[Column], total: dict[str, str]) -> DataFrame:
    """rows with `rank` from 0 and running sums before each row (total: new column -> summed column).

    Range-partitioned: each partition is numbered by itself, and sums over whole partitions are added.
    """
    placed = cut(rows.repartitionByRange(*order).withColumn("part", F.spark_partition_id()))
    within = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    sums = [F.coalesce(F.sum(c).over(within), F.lit(0)).alias(f"own_{k}") for k, c in total.items()]
    own = placed.select("*", F.count(F.lit(1)).over(within).alias("own_rank"), *sums)
    # one row a partition of the layout, so the window over them is small
    parts = placed.groupBy("part").agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(f"all_{k}") for k, c in total.items()])
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"), *[F.coalesce(F.sum(f"all_{k}").over(before), F.lit(0)).alias(f"start_{k}") for k in total])
    joined = own.join(starts, "part")
    return joined.select(*rows.columns, (F.col("own_rank") + F.col("start")).alias("rank"), *[(F.col(f"own_{k}") + F.col(f"start_{k}")).alias(k) for k in total])


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(source, source_size) to (source, source_size, target), by capped water-filling.

    With sources in the order of cap / weight, the capped ones come first: source i is capped when
    cap[i] * (weight of i and all after) < weight[i] * (size left after the caps before i).
    Decimals keep the products exact.
    """
    named = ranked(sources, [F.col("source").isNull(), F.col("source")], {})
    table = F.array(*map(F.lit, weights))
    weighed = named.select("source", "source_size", F.element_at(table, (F.col("rank") % len(weights) + 1).cast("int")).cast("decimal(18,0)").alias("weight")).withColumn("cap", (F.col("source_size") * max_epochs).cast("decimal(20,0)"))
    filled = ranked(weighed, [(F.col("cap").cast("double") / F.col("weight").cast("double")), F.col("source").isNull(), F.col("source")], {"cap_before": "cap", "weight_before": "weight"})
    whole = weighed.agg(F.sum("source_size").cast("decimal(20,0)").alias("size_all"), F.sum("weight").cast("decimal(18,0)").alias("weight_all"))
    left = F.col("size_all") - F.col("cap_before").cast("decimal(20,0)")
    weight_left = F.col("weight_all") - F.col("weight_before").cast("decimal(18,0)")
    judged = filled.crossJoin(F.broadcast(whole)).withColumn("capped", F.col("cap") * weight_left < F.col("weight") * left)
    rest = judged.agg(
        F.coalesce(F.sum(F.when(F.col("capped"), F.col("cap"))), F.lit(0)).cast("decimal(20,0)").alias("caps"),
        F.coalesce(F.sum(F.when(~F.col("capped"), F.col("weight"))), F.lit(1)).cast("decimal(18,0)").alias("free_weight"),
    )
    share = (F.col("size_all") - F.col("caps")).cast("double") * F.col("weight").cast("double") / F.col("free_weight").cast("double")
    return judged.crossJoin(F.broadcast(rest)).select("source", "source_size", F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(share).alias("target"))


def plan(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: str = SEED) -> DataFrame:
    """docs plus size, source_size, target and copies: how often the mix repeats the row. Columns of docs named so are replaced."""
    docs, names = apart(docs, "doc_id", "text", "source")
    mark = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    sized = docs.withColumns({"size": n_words(F.col("text")), "mark": mark})
    prefix = F.substring("mark", 1, PREFIX)
    sums = cut(sized.groupBy("source", prefix.alias("prefix")).agg(F.sum("size").alias("prefix_size")))
    sources = cut(targets(sums.groupBy("source").agg(F.sum("prefix_size").alias("source_size")), weights, max_epochs))
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    sources = sources.withColumn("whole", F.floor(ratio)).withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
    # the prefix in which the rest of a source runs out, and the size before it
    upto = Window.partitionBy("source").orderBy("prefix").rowsBetween(Window.unboundedPreceding, -1)
    stepped = sums.withColumn("before", F.coalesce(F.sum("prefix_size").over(upto), F.lit(0)))
    edge = (
        stepped.alias("p")
        .join(sources.alias("s"), F.col("p.source").eqNullSafe(F.col("s.source")))
        .where("p.before <= s.rest")
        .groupBy("s.source")
        .agg(F.max(F.struct("p.prefix", "p.before")).alias("edge"))
    )
    known = sources.alias("s").join(edge.alias("e"), F.col("s.source").eqNullSafe(F.col("e.source")), "left")
    known = cut(known.select(F.col("s.source").alias("its_source"), "source_size", "target", "whole", "rest", F.col("edge.prefix").alias("edge"), F.col("edge.before").alias("before")))
    if known.count() <= BROADCAST_SOURCES:
        known = F.broadcast(known)
    joined = sized.join(known, F.col("source").eqNullSafe(F.col("its_source"))).withColumn("prefix", prefix)
    # a source at a whole multiple has no part to fill; one without words is taken once
    open_rest = (F.col("rest") > 0) | (F.col("source_size") == 0)
    carried = [*docs.columns, "size", "source_size", "target"]
    clear = joined.where("prefix <> edge").select(*carried, (F.col("whole") + ((F.col("prefix") < F.col("edge")) & open_rest).cast("long")).alias("copies"))
    # the rows of the boundary prefix are put in order: one prefix in 4096 of each source
    order = Window.partitionBy("source").orderBy("mark", "doc_id", "size", F.xxhash64("text")).rowsBetween(Window.unboundedPreceding, -1)
    middle = F.col("before") + F.coalesce(F.sum("size").over(order), F.lit(0)) + F.col("size") / 2.0
    close = joined.where("prefix = edge").withColumn("extra", ((middle <= F.col("rest")) & open_rest).cast("long"))
    return named_back(clear.union(close.select(*carried, (F.col("whole") + F.col("extra")).alias("copies"))), names, "size", "source_size", "target", "copies")


def mix(docs: DataFrame, **settings) -> DataFrame:
    """The mixed corpus itself: each row of docs as often as the plan says."""
    own, names = apart(docs, "doc_id", "text", "source")
    planned = plan(own, **settings).where("copies > 0")
    return named_back(planned.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))), names)


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    planned = plan(read(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return planned.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


OP3_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size, md5('mix-1:' || coalesce(doc_id::varchar, '')) AS mark, text FROM documents
), src AS (
  SELECT source, sum(size)::hugeint AS source_size FROM sized GROUP BY source
), weighed AS (
  SELECT *, [5, 2, 1][((row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1) % 3 + 1)::int]::hugeint AS weight, 3 * source_size AS cap FROM src
), filled AS (
  SELECT *, coalesce(sum(cap) OVER w, 0) AS cap_before, coalesce(sum(weight) OVER w, 0) AS weight_before, sum(source_size) OVER () AS size_all, sum(weight) OVER () AS weight_all
  FROM weighed WINDOW w AS (ORDER BY cap::double / weight::double, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), judged AS (
  SELECT *, cap * (weight_all - weight_before) < weight * (size_all - cap_before) AS capped FROM filled
), rest AS (
  SELECT coalesce(sum(cap) FILTER (WHERE capped), 0) AS caps, coalesce(sum(weight) FILTER (WHERE NOT capped), 1) AS free_weight FROM judged
), target AS (
  SELECT source, source_size, CASE WHEN capped THEN cap::double ELSE (size_all - caps)::double * weight::double / free_weight::double END AS target FROM judged, rest
), parts AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole FROM target
), placed AS (
  SELECT d.doc_id, d.size, p.source_size, p.target, p.whole, p.target - p.whole * p.source_size AS rest,
    coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.mark, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM sized d JOIN parts p ON d.source IS NOT DISTINCT FROM p.source
)
SELECT doc_id, size::bigint AS size, source_size::bigint AS source_size, target, ((whole + CASE WHEN before + size / 2.0 <= rest THEN 1 ELSE 0 END) * size)::bigint AS taken FROM placed
"""

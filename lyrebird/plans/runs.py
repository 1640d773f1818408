"""Run-comparison queries over the order and event tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lyrebird.operators import ranks
from lyrebird.operators import runs as R
from lyrebird.plans.catalog import query
from lyrebird.session import table


@query(
    "profile_op_share",
    """WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS rn, count(*) OVER (PARTITION BY event_type) AS n FROM events),
    s AS (SELECT event_type, avg(value) AS m, count(*) AS calls, sum(value) AS total FROM r WHERE rn > n // 2 GROUP BY event_type), p AS (SELECT *, 100 * total / sum(total) OVER () AS share FROM s)
    SELECT event_type, round(m, 6) AS mean_value, calls, round(total, 4) AS total, round(share, 6) AS share_percent FROM p WHERE share >= 0.1""",
)
def profile_op_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    shares = R.profile_shares(table(spark, sf_dir, "events"), "event_type", "value", [F.col("ts"), F.col("event_id")], F.date_trunc("hour", "ts"))
    return shares.select("event_type", F.round("mean_value", 6).alias("mean_value"), "calls", F.round("total", 4).alias("total"), F.round("share_percent", 6).alias("share_percent"))


def bench(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as benchmark rows: the return flag is the build, and quantity, line number and status are the key."""
    return table(spark, sf_dir, "lineitem")


@query(
    "bench_compare_avg",
    """SELECT b.l_linenumber, b.l_quantity, b.l_linestatus, round(avg(b.l_extendedprice), 4) AS avg_base, round(avg(c.l_extendedprice), 4) AS avg_other FROM
    (SELECT l_linenumber, l_quantity, l_linestatus, avg(l_extendedprice) AS l_extendedprice FROM lineitem WHERE l_returnflag = 'A' GROUP BY ALL) b JOIN
    (SELECT l_linenumber, l_quantity, l_linestatus, avg(l_extendedprice) AS l_extendedprice FROM lineitem WHERE l_returnflag = 'R' GROUP BY ALL) c USING (l_linenumber, l_quantity, l_linestatus) GROUP BY ALL""",
)
def bench_compare_avg(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = ["l_linenumber", "l_quantity", "l_linestatus"]
    compared = R.compare_builds(bench(spark, sf_dir), keys, "l_returnflag", "A", "R", "l_extendedprice")
    return compared.select(*keys, F.round("avg_base", 4).alias("avg_base"), F.round("avg_other", 4).alias("avg_other"))


@query(
    "bench_compare_passed",
    """WITH ok AS (SELECT * FROM lineitem WHERE l_discount < 0.05 AND l_tax < 0.05), a AS (SELECT l_linenumber, l_quantity, avg(l_extendedprice) AS avg_base FROM ok WHERE l_returnflag = 'A' GROUP BY ALL),
    n AS (SELECT l_linenumber, l_quantity, avg(l_extendedprice) AS avg_other FROM ok WHERE l_returnflag = 'N' GROUP BY ALL)
    SELECT l_linenumber, l_quantity, round(avg_base, 4) AS avg_base, round(avg_other, 4) AS avg_other, round(avg_other / avg_base, 6) AS speedup FROM a JOIN n USING (l_linenumber, l_quantity)""",
)
def bench_compare_passed(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = ["l_linenumber", "l_quantity"]
    passed = bench(spark, sf_dir).where("l_discount < 0.05 and l_tax < 0.05")  # supported and passed
    compared = R.compare_builds(passed, keys, "l_returnflag", "A", "N", "l_extendedprice")
    return compared.select(*keys, F.round("avg_base", 4).alias("avg_base"), F.round("avg_other", 4).alias("avg_other"), F.round("speedup", 6).alias("speedup"))


@query("bench_builds_minmax_len", "SELECT min(length(o_orderpriority)) AS least, max(length(o_orderpriority)) AS most, count(DISTINCT o_orderpriority) AS builds FROM orders")
def bench_builds_minmax_len(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.length("o_orderpriority")
    return table(spark, sf_dir, "orders").agg(F.min(size).cast("long").alias("least"), F.max(size).cast("long").alias("most"), F.count_distinct("o_orderpriority").alias("builds"))


@query("bench_builds_distinct", "SELECT DISTINCT substring(o_orderpriority, 1, 1) AS build FROM orders")
def bench_builds_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Builds shortened to a common length, each once."""
    return table(spark, sf_dir, "orders").select(F.substring("o_orderpriority", 1, 1).alias("build")).distinct()


@query("bench_latest_build", "SELECT arg_max(o_orderpriority, {'t': o_orderdate, 'b': o_orderpriority}) AS latest_build, max(o_orderdate) AS latest_time FROM orders")
def bench_latest_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.latest_build(table(spark, sf_dir, "orders"), "o_orderpriority", "o_orderdate")


@query("throughput_summary", "SELECT event_type, count(*) AS n, round(sum(value), 3) AS total, round(avg(value), 6) AS mean, max(value) AS largest, sum((user_id % 50) * (user_id % 50 + 1) / 2) AS depth FROM events GROUP BY event_type")
def throughput_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").withColumn("i", F.col("user_id") % 50)
    return R.throughput(events, ["event_type"], "value", "i").select("event_type", "n", F.round("total", 3).alias("total"), F.round("mean", 6).alias("mean"), "largest", "depth")


@query("token_rate_histogram", "SELECT date_trunc('hour', ts) AS hour, count(*) AS tokens FROM events GROUP BY 1")
def token_rate_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour")).agg(F.count(F.lit(1)).alias("tokens"))


@query("success_pivot", "SELECT user_id % 10 AS model, round(avg(value) FILTER (WHERE event_type = 'click'), 6) AS click, round(avg(value) FILTER (WHERE event_type = 'view'), 6) AS view, round(avg(value) FILTER (WHERE event_type = 'purchase'), 6) AS purchase FROM events GROUP BY 1")
def success_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    tests = ["click", "view", "purchase"]
    pivoted = table(spark, sf_dir, "events").groupBy((F.col("user_id") % 10).alias("model")).pivot("event_type", tests).agg(F.avg("value"))
    return pivoted.select("model", *[F.round(t, 6).alias(t) for t in tests])


@query(
    "support_matrix",
    """WITH v AS (SELECT l_linenumber, l_returnflag, CASE WHEN bool_and(l_tax < 0.08) THEN 'supported' WHEN bool_or(l_tax < 0.08) THEN 'partially supported' ELSE 'unsupported' END AS v FROM lineitem WHERE l_quantity > 49 GROUP BY ALL)
    SELECT l_linenumber, coalesce(max(v) FILTER (WHERE l_returnflag = 'A'), 'unsupported') AS A, coalesce(max(v) FILTER (WHERE l_returnflag = 'N'), 'unsupported') AS N, coalesce(max(v) FILTER (WHERE l_returnflag = 'R'), 'unsupported') AS R FROM v GROUP BY 1""",
)
def support_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.support_matrix(bench(spark, sf_dir).where("l_quantity > 49"), "l_linenumber", "l_returnflag", F.col("l_tax") < 0.08, ["A", "N", "R"])


@query("rtf_stats_zero_guard", "SELECT l_suppkey, round(CASE WHEN sum(l_discount) > 0 THEN sum(l_tax) / sum(l_discount) ELSE 0 END, 6) AS rtf, round(CASE WHEN sum(l_tax) > 0 THEN sum(l_quantity) / sum(l_tax) ELSE 0 END, 4) AS tokens_per_second FROM lineitem GROUP BY 1")
def rtf_stats_zero_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    sums = bench(spark, sf_dir).groupBy("l_suppkey").agg(*[F.sum(c).alias(c) for c in ("l_tax", "l_discount", "l_quantity")])
    return sums.select("l_suppkey", F.round(R.ratio(F.col("l_tax"), F.col("l_discount")), 6).alias("rtf"), F.round(R.ratio(F.col("l_quantity"), F.col("l_tax")), 4).alias("tokens_per_second"))


@query("runs_markdown", "SELECT '| ' || r_regionkey || ' | ' || r_name || ' |' AS line FROM region")
def runs_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.markdown(table(spark, sf_dir, "region"), ["r_regionkey", "r_name"])


@query("runs_jsonl", """SELECT '{"r_regionkey":' || r_regionkey || ',"r_name":"' || r_name || '"}' AS line FROM region""")
def runs_jsonl(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "region").select(F.to_json(F.struct("r_regionkey", "r_name")).alias("line"))


@query("runs_csv", "SELECT r_regionkey || ',' || r_name AS line FROM region")
def runs_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "region").select(F.to_csv(F.struct("r_regionkey", "r_name")).alias("line"))


@query("accumulated_stats", "SELECT l_orderkey, sum(l_quantity) AS tokens, round(sum(l_extendedprice), 2) AS seconds, count(*) AS chunks FROM lineitem GROUP BY 1")
def accumulated_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums over the chunks of a file."""
    return bench(spark, sf_dir).groupBy("l_orderkey").agg(F.sum("l_quantity").alias("tokens"), F.round(F.sum("l_extendedprice"), 2).alias("seconds"), F.count(F.lit(1)).alias("chunks"))


@query("positional_join", "WITH a AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS i FROM events), p AS (SELECT x.i, x.value AS a, y.value AS b FROM a x JOIN a y USING (i) WHERE x.event_type = 'click' AND y.event_type = 'view') SELECT i, a, b, abs(a - b) > 50 AS differs FROM p")
def positional_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two files joined line by line: each row's number in its own file is the key."""
    events = table(spark, sf_dir, "events").where(F.col("event_type").isin("click", "view"))
    numbered = ranks.numbered(events, ["event_type"], F.date_trunc("hour", "ts"), ["ts", "event_id"], "i")
    a, b = (numbered.where(F.col("event_type") == t).select("i", F.col("value").alias(n)) for t, n in (("click", "a"), ("view", "b")))
    return a.join(b, "i").withColumn("differs", F.abs(F.col("a") - F.col("b")) > 50)

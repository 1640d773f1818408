"""Standard relational operators beside the speech-text ones: joins, grouping sets, set operations, windows, JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lyrebird.operators import sketches
from lyrebird.plans.catalog import query
from lyrebird.session import table
from lyrebird.sources import scratch


@query("outer_joins", "SELECT c_custkey, o_orderkey, coalesce(o_totalprice, 0) AS price FROM customer FULL JOIN (SELECT * FROM orders WHERE o_totalprice > 300000) o ON c_custkey = o_custkey")
def outer_joins(spark: SparkSession, sf_dir: str) -> DataFrame:
    large = table(spark, sf_dir, "orders").where("o_totalprice > 300000")
    joined = table(spark, sf_dir, "customer").join(large, F.col("c_custkey") == F.col("o_custkey"), "full")
    return joined.select("c_custkey", "o_orderkey", F.coalesce("o_totalprice", F.lit(0.0)).alias("price"))


@query("semi_anti_joins", "SELECT c_mktsegment, count(*) FILTER (WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)) AS having_orders, count(*) FILTER (WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)) AS without FROM customer GROUP BY 1")
def semi_anti_joins(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers, orders = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    on = F.col("c_custkey") == F.col("o_custkey")
    counts = [customers.join(orders, on, how).groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias(name)) for how, name in (("left_semi", "having_orders"), ("left_anti", "without"))]
    return counts[0].join(counts[1], "c_mktsegment", "full").select("c_mktsegment", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("having_orders", "without")])


@query("rollup_cube", "SELECT l_returnflag, l_linestatus, sum(l_quantity) AS quantity, grouping(l_returnflag)::INT AS all_flags FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def rollup_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("quantity"), F.grouping("l_returnflag").cast("int").alias("all_flags"))


@query("set_ops", "(SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier) UNION ALL (SELECT n_nationkey FROM nation EXCEPT SELECT s_nationkey FROM supplier)")
def set_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers, suppliers, nations = (table(spark, sf_dir, t).select(F.col(c).alias("k")) for t, c in (("customer", "c_nationkey"), ("supplier", "s_nationkey"), ("nation", "n_nationkey")))
    return customers.intersect(suppliers).union(nations.subtract(suppliers))


@query(
    "window_rank",
    "SELECT o_custkey, o_orderkey, rank() OVER w AS rnk, dense_rank() OVER w AS dense, ntile(4) OVER (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey) AS quartile, round(cume_dist() OVER w, 9) AS share, lag(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey) AS before FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_totalprice)",
)
def window_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = Window.partitionBy("o_custkey")
    w, total = by.orderBy("o_totalprice"), by.orderBy("o_totalprice", "o_orderkey")
    return table(spark, sf_dir, "orders").select(
        "o_custkey", "o_orderkey", F.rank().over(w).cast("long").alias("rnk"), F.dense_rank().over(w).cast("long").alias("dense"), F.ntile(4).over(total).cast("long").alias("quartile"), F.round(F.cume_dist().over(w), 9).alias("share"), F.lag("o_totalprice").over(total).alias("before")
    )


@query("frames", "SELECT user_id, event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 6) AS last3, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND CURRENT ROW) AS in_hour FROM events")
def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = Window.partitionBy("user_id")
    hour = by.orderBy(F.unix_micros(F.col("ts").cast("timestamp"))).rangeBetween(-3_600_000_000, 0)
    return table(spark, sf_dir, "events").select("user_id", "event_id", F.round(F.sum("value").over(by.orderBy("ts", "event_id").rowsBetween(-2, 0)), 6).alias("last3"), F.count(F.lit(1)).over(hour).alias("in_hour"))


@query("json_props", "SELECT event_type, count(*) AS n, sum((props->>'$.k')::BIGINT)::BIGINT AS total FROM events GROUP BY 1")
def json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    props = F.from_json("props", "k long")["k"]
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum(props).alias("total"))


@query("approx_distinct")
def approx_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sketched counts; the tests hold them to the exact ones."""
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.approx_count_distinct("user_id", 0.02).alias("users"), F.percentile_approx("value", 0.5, 10000).alias("median"))


@query("sketch_store", "SELECT event_type, count(*) AS n, true AS users_near, true AS p05_near, true AS p50_near, true AS p95_near FROM events GROUP BY event_type")
def sketch_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sketches by day of two halves of the events, written, read back and merged; counts are within three standard errors, ranks within two hundredths."""
    events = table(spark, sf_dir, "events").withColumn("day", F.to_date("ts"))
    home = scratch.shared(spark, "sketches")
    for half in (0, 1):
        sketches.sketched(events.where(F.coalesce(F.col("event_id") % 2, F.lit(0)) == half), ["event_type", "day"], "user_id", "value").write.mode("append").parquet(home)
    shares = {"p05": 0.05, "p50": 0.5, "p95": 0.95}
    found = sketches.estimated(sketches.merged(spark.read.parquet(home), ["event_type"]), ["event_type"], shares)
    exact = events.groupBy("event_type").agg(F.count_distinct("user_id").alias("exact"), F.count("value").alias("values"))
    low_high = [F.count(F.when(F.col("value") < F.col(s), 1)).alias(f"{s}_low") for s in shares] + [F.count(F.when(F.col("value") <= F.col(s), 1)).alias(f"{s}_high") for s in shares]
    ranks = events.join(found.select("event_type", *shares), "event_type").groupBy("event_type").agg(*low_high)
    near = [((F.col(f"{s}_low") / F.col("values") <= share + 0.02) & (F.col(f"{s}_high") / F.col("values") >= share - 0.02)).alias(f"{s}_near") for s, share in shares.items()]
    users = (F.abs(F.col("users") - F.col("exact")) <= F.greatest(3 * sketches.ERROR * F.col("exact"), F.lit(1))).alias("users_near")
    return found.join(exact, "event_type").join(ranks, "event_type").select("event_type", "n", users, *near)


@query("distinct_aggregates", "SELECT o_orderpriority, count(DISTINCT o_custkey) AS customers, count(DISTINCT o_orderstatus) AS states FROM orders GROUP BY 1")
def distinct_aggregates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.count_distinct("o_custkey").alias("customers"), F.count_distinct("o_orderstatus").alias("states"))


@query("range_join", "SELECT r.k AS k, count(*) AS n FROM (SELECT range AS k, range * 50000.0 AS low, (range + 1) * 50000.0 AS high FROM range(10)) r JOIN orders ON o_totalprice >= low AND o_totalprice < high GROUP BY 1")
def range_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values to intervals of one width: the interval's number is an equi-join key."""
    spans = spark.range(10).select(F.col("id").alias("k"))
    keyed = table(spark, sf_dir, "orders").select(F.floor(F.col("o_totalprice") / 50000.0).alias("k"))
    return keyed.join(F.broadcast(spans), "k").groupBy("k").agg(F.count(F.lit(1)).alias("n"))


@query("as_of_join", "WITH v AS (SELECT user_id, ts, value AS price FROM events WHERE event_type = 'view'), c AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'click') SELECT c.event_id, max(v.ts) AS seen FROM c LEFT JOIN v ON v.user_id = c.user_id AND v.ts <= c.ts GROUP BY 1")
def as_of_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest view up to each click: both kinds in one ordered stream a user, the last view carried on."""
    events = table(spark, sf_dir, "events").where(F.col("event_type").isin("click", "view"))
    seen = F.when(F.col("event_type") == "view", F.col("ts"))
    order = Window.partitionBy("user_id").orderBy("ts", F.col("event_type") == "click").rowsBetween(Window.unboundedPreceding, 0)
    return events.withColumn("seen", F.last(seen, ignorenulls=True).over(order)).where("event_type = 'click'").select("event_id", "seen")


@query("date_functions", "SELECT date_trunc('month', o_orderdate) AS month, count(*) AS n, max(date_diff('day', DATE '1992-01-01', o_orderdate::DATE))::INT AS days FROM orders GROUP BY 1")
def date_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    month = F.date_trunc("month", "o_orderdate").cast("timestamp_ntz")
    return table(spark, sf_dir, "orders").groupBy(month.alias("month")).agg(F.count(F.lit(1)).alias("n"), F.max(F.datediff(F.col("o_orderdate").cast("date"), F.lit("1992-01-01").cast("date"))).alias("days"))


@query("top_orders", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def top_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(25).select("o_orderkey", "o_totalprice")

"""Queries over maps, JSON, paths and token arrays."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lyrebird.functions import records as R
from lyrebird.plans.catalog import query
from lyrebird.session import table


@query("json_objects", "SELECT event_id, (props->>'$.k')::VARCHAR AS k, 'new' AS tag FROM events")
def json_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects merged with another, whose entries win."""
    both = R.merged(R.object_map(F.col("props")), F.create_map(F.lit("tag"), F.lit("new")))
    return table(spark, sf_dir, "events").select("event_id", both["k"].alias("k"), both["tag"].alias("tag"))


@query("placeholders", "SELECT l_orderkey, l_linenumber, (2 + l_linenumber * (l_suppkey % 4 + 1))::INT AS n FROM lineitem")
def placeholders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token arrays with l_linenumber placeholders, each put l_suppkey % 4 + 1 times."""
    ids = F.concat(F.array(F.lit(1)), F.array_repeat(F.lit(99), F.col("l_linenumber")), F.array(F.lit(2)))
    grown = R.expand(ids, 99, F.col("l_suppkey") % 4 + 1)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.size(grown).alias("n"))


@query("placeholder_texts", "SELECT p_partkey, 'a' || repeat('<audio>', p_size % 3 + 1) || 'b' || repeat('<audio>', 2) || 'c' AS text FROM part")
def placeholder_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = F.array(F.col("p_size") % 3 + 1, F.lit(2))
    return table(spark, sf_dir, "part").select("p_partkey", R.expand_text(F.lit("a<audio>b<audio>c"), "<audio>", counts).alias("text"))


@query("paired_stamps", "SELECT o_orderkey, 2 AS n, (o_custkey % 10)::BIGINT AS first_start, (o_custkey % 10 + 3)::BIGINT AS last_end FROM orders")
def paired_stamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = F.col("o_custkey") % 10
    items = R.paired(F.array(F.lit("x"), F.lit("y")), F.array(start, start + 1, start + 2, start + 3))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.size(items).alias("n"), items[0]["start_time"].alias("first_start"), items[1]["end_time"].alias("last_end"))


@query("path_filter", "SELECT page_id, NOT list_has_any(string_split(url, '/'), ['en', 'de']) AND (NOT list_contains(string_split(url, '/'), 'fr') OR suffix(url, '.html')) AS included FROM pages")
def path_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", R.is_included(F.col("url"), ["en", "de"], "fr", ".html").alias("included"))


@query("weight_names", "SELECT p_partkey, 'l.' || p_size || '.qkv_proj.weight' AS stacked, 'l.' || p_size || '.q_proj' AS bare, ((p_size + 31) // 32 * 32)::BIGINT AS padded FROM part")
def weight_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat(F.lit("l."), F.col("p_size").cast("string"), F.lit(".q_proj.weight"))
    return table(spark, sf_dir, "part").select("p_partkey", R.rename_weight(name).alias("stacked"), R.without_suffix(name).alias("bare"), R.round_up(F.col("p_size"), 32).alias("padded"))


@query("index_buckets", "SELECT l_suppkey, l_partkey // 100 AS bucket, count(*) AS n, min(l_orderkey) AS first_key, max(l_orderkey) AS last_key FROM lineitem GROUP BY ALL")
def index_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sorted ids by ranges of a fixed width; a range without ids has no row."""
    return table(spark, sf_dir, "lineitem").groupBy("l_suppkey", F.floor(F.col("l_partkey") / 100).alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.min("l_orderkey").alias("first_key"), F.max("l_orderkey").alias("last_key"))


@query("missing_files", "SELECT n_name AS file FROM nation WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier)")
def missing_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is required and isn't there."""
    there = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("n_nationkey"))
    return table(spark, sf_dir, "nation").join(there, "n_nationkey", "left_anti").select(F.col("n_name").alias("file"))


@query("domains", "SELECT l_returnflag AS domain, array_to_string(list_sort(list_distinct(list(l_linenumber))), ',') AS ops FROM lineitem GROUP BY 1")
def domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct operator kinds of each domain."""
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("domain")).agg(F.array_join(F.sort_array(F.collect_set("l_linenumber")).cast("array<string>"), ",").alias("ops"))


@query("override_fields", "SELECT c_custkey, coalesce(CASE WHEN c_custkey % 5 = 0 THEN 'override' END, CASE WHEN c_custkey % 3 = 0 THEN c_name END, c_mktsegment) AS value FROM customer")
def override_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata by precedence: override, card, then what the name says."""
    override, card = F.when(F.col("c_custkey") % 5 == 0, "override"), F.when(F.col("c_custkey") % 3 == 0, F.col("c_name"))
    return table(spark, sf_dir, "customer").select("c_custkey", F.coalesce(override, card, "c_mktsegment").alias("value"))


@query("retries", "SELECT s_suppkey, least(s_suppkey % 6, 3)::INT AS attempt, round((0.2 + 0.3 * least(s_suppkey % 6, 3))::DOUBLE, 6) AS temperature, s_suppkey % 6 <= 3 AS ok FROM supplier")
def retries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to four attempts, each 0.3 hotter: the first that succeeds, else the last. s_suppkey % 6 says which would."""
    tried = table(spark, sf_dir, "supplier").select("s_suppkey", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("attempt")).withColumn("ok", F.col("attempt") >= F.col("s_suppkey") % 6)
    best = tried.groupBy("s_suppkey").agg(F.min_by(F.struct("attempt", "ok"), F.struct(~F.col("ok"), F.when(F.col("ok"), F.col("attempt")).otherwise(-F.col("attempt")))).alias("b"))
    return best.select("s_suppkey", "b.attempt", F.round(0.2 + 0.3 * F.col("b.attempt"), 6).alias("temperature"), "b.ok")

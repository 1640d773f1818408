"""Queries over tensor files and benchmark databases that Spark writes from the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lyrebird.plans.catalog import query
from lyrebird.session import table
from lyrebird.sources import databases, scratch, tensors


@query("tensor_files", "SELECT 'vec.' || vec_id AS name, len(embedding)::BIGINT AS n, round(list_sum(embedding::DOUBLE[]), 4) AS total FROM embeddings")
def tensor_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector as a named tensor in files with a header, read back by byte ranges."""
    tensors.register(spark)
    folder = scratch.shared(spark, "tensors")
    own = table(spark, sf_dir, "embeddings").select(F.concat(F.lit("vec."), F.col("vec_id")).alias("name"), F.array(F.size("embedding").cast("long")).alias("shape"), F.col("embedding").cast("array<double>").alias("values"))
    own.write.format("tensors").mode("append").save(folder)
    read = spark.read.format("tensors").load(folder)
    return read.select("name", F.col("shape")[0].alias("n"), F.round(F.aggregate("values", F.lit(0.0), lambda a, x: a + x), 4).alias("total"))


@query("run_database", "SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users, round(avg(value), 6) AS mean, left(max(ts)::VARCHAR, 19) AS last FROM events WHERE value > 10 GROUP BY event_type")
def run_database(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs written to databases, one for each task, read back by row ranges with the filter in the database's query."""
    databases.register(spark)
    folder = scratch.shared(spark, "runs")
    table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts")).write.format("database").option("table", "runs").mode("append").save(folder)
    runs = spark.read.format("database").option("table", "runs").load(folder).where("value > 10")
    return runs.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("user_id").alias("users"), F.round(F.avg("value"), 6).alias("mean"), F.max("ts").alias("last"))

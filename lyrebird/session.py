"""Session settings shared by the tests, the benchmark and the entry module."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession


def build(app: str = "lyrebird", cpus: str | None = None, **conf: str) -> SparkSession:
    """A local session: UTC, adaptive execution, few shuffle partitions."""
    cpus = cpus or os.environ.get("BENCH_CPUS", "8")
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.shuffle.partitions": "8",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g",
    } | conf
    spark = SparkSession.builder.master(f"local[{cpus}]").appName(app).config(map=settings).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables; every reader of the package goes through here."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(df: DataFrame, rows: int = 128) -> DataFrame:
    """df, with the session's batches to Python kept to so many rows, for rows that hold long arrays."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    return df

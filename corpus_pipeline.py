"""A corpus pipeline over `documents`: five stages, each written as Parquet and read again as the next one's input.

Stages return the columns of documents, all but the last: quality rules drop rows; one document of
each near-duplicate group stays; repeated passages go from the texts; the mix repeats or drops rows
by source; and each row that is left is encoded.

Null and empty texts fail the base rules of the first stage; null languages, sources and ids are values
like others. Repeated rows are near-duplicates of each other: one stays. Very long texts stay one row in
every stage. Other columns than those of documents are dropped, whatever their names. An empty table
gives an empty result. Stages' tables stay in the shared folder.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lyrebird.llm import bpe, mixing, outliers, simhash, substrings
from lyrebird.llm.common import read, shared_folder

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the robust outlier rule keep."""
    return outliers.keep_good(docs.select(*COLUMNS))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by their 5-word shingles one row, that with the smallest doc_id."""
    return simhash.one_of_each(docs.select(*COLUMNS), width=5, similarity=0.8)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the words of windows that occur earlier; texts that lose all their words go."""
    cleaned = substrings.remove_repeats(docs.select(*COLUMNS))
    changed = F.col("n_removed") > 0
    left = cleaned.where(~changed | (F.col("n_removed") < F.col("n_words")))
    text = F.when(changed, F.col("kept")).otherwise(F.col("text"))
    return left.withColumn("text", text).withColumn("n_chars", F.when(changed, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the mix takes them."""
    return mixing.mix(docs.select(*COLUMNS))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and the digests of each row."""
    import public_tokenizers

    return bpe.digests(docs, bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), public_tokenizers.PATTERN)


STAGES = [
    ("quality rules", quality),
    ("near-dedup by word shingles", near_duplicates),
    ("substring dedup", repeated_passages),
    ("mixing sources to target weights", mixed),
    ("byte-level BPE encoding and decoding", encoded),
]

#: The outlier and near-duplicate stages are not expressible in SQL; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs

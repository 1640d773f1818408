"""What the training-data operators share: words, scratch storage, bounded membership filters, components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a maximal run of bytes other than the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Rows of one Arrow batch that goes to Python, so that a batch of long texts stays small.
BATCH_ROWS = 128
#: Bits of a membership filter at most: 32 MB, whatever the input holds.
MAX_FILTER_BITS = 1 << 28
#: Bytes of Arrow batches that `together` puts into one table.
GATHERED = 1 << 21


def small_batches(df: DataFrame) -> DataFrame:
    """df, with the session's Arrow batches kept small for long texts; operators call this themselves."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return df


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the input folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def apart(docs: DataFrame, *needed: str) -> tuple[DataFrame, dict[str, str]]:
    """docs with every column but the needed ones under a name of our own, so that none is mistaken for ours; the names."""
    names = {c: c if c in needed else f"own_{i}" for i, c in enumerate(docs.columns)}
    return docs.select(*[F.col(f"`{c}`").alias(own) for c, own in names.items()]), names


def named_back(df: DataFrame, names: dict[str, str], *outputs: str) -> DataFrame:
    """The columns of `apart` under their first names, those named like an output replaced, and the outputs."""
    return df.select(*[F.col(own).alias(c) for c, own in names.items() if c not in outputs], *outputs)


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where it is absent, one of our own in local mode only, as executors elsewhere wouldn't see it."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder and not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not folder:
        folder = tempfile.mkdtemp(prefix="lyrebird-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """df with its lineage cut by a reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, folder: str | None = None, compression: str = "snappy") -> DataFrame:
    """df written once as Parquet in the shared folder, or in `folder`, and read again.

    Unlike a checkpoint, which keeps the size estimated from its plan, the table read has the size of its
    files. In loops, estimates multiply from step to step until planning alone takes minutes.
    """
    path = f"{folder or shared_folder(df.sparkSession)}/lyrebird-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dropped(spark: SparkSession, folder: str) -> None:
    """Removes a folder of steps that nothing reads any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def together(batches: Iterator[pa.RecordBatch], most: int = GATHERED) -> Iterator[pa.Table]:
    """Batches put together to tables of about `most` bytes."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= most:
            yield pa.Table.from_batches(held)
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def n_words(text: Column) -> Column:
    """Words of a text as a long; null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def pack_filter(hashes: DataFrame, column: str) -> tuple[bytes, int]:
    """A bit set over the low bits of a long column; (bits, log2 of their number).

    Its size follows the number of rows, up to MAX_FILTER_BITS. A crowded filter says yes
    more often, which costs time downstream but never loses a member.
    """
    log_bits = 16
    rows = hashes.count()
    while (1 << log_bits) < 32 * rows and (1 << log_bits) < MAX_FILTER_BITS:
        log_bits += 1
    block = min(log_bits, 20)  # bits of one packed block: 128 KB

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            bit = batch.column(0).to_numpy().view(np.uint64) & np.uint64((1 << log_bits) - 1)
            home = (bit >> np.uint64(block)).astype(np.int64)
            within = (bit & np.uint64((1 << block) - 1)).astype(np.int64)
            for at in np.unique(home):
                words = held.setdefault(int(at), np.zeros((1 << block) // 8, dtype=np.uint8))
                own = within[home == at]
                np.bitwise_or.at(words, own >> 3, (1 << (own & 7)).astype(np.uint8))
        if held:
            keys = sorted(held)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array([held[k].tobytes() for k in keys], pa.binary())], ["home", "bits"])

    own = hashes.select(column).withColumn("home", F.col(column).bitwiseAND((1 << log_bits) - 1).bitwiseAND(-(1 << block)))
    parts = max(1, 1 << max(0, log_bits - block - 2))
    packed = own.repartition(parts, "home").select(column).mapInArrow(blocks, "home long, bits binary").collect()
    bits = np.zeros((1 << log_bits) // 8, dtype=np.uint8)
    size = (1 << block) // 8
    for row in packed:
        bits[row.home * size : (row.home + 1) * size] |= np.frombuffer(row.bits, dtype=np.uint8)
    return bits.tobytes(), log_bits


def may_hold(bits: np.ndarray, log_bits: int, hashes: np.ndarray) -> np.ndarray:
    """Which of the uint64 hashes the filter may hold."""
    at = hashes & np.uint64((1 << log_bits) - 1)
    return (bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) for the nodes of an edge table (a, b); component: the smallest node reachable.

    Alternating large-star and small-star steps. Each step sends a row per edge at most, the
    minimum of a node's neighbours is pre-aggregated before the shuffle, and the step's result is
    written. Null ends are ignored, loops and repeats are harmless; no edges give no rows.
    """
    edges = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct()
    spark = edges.sparkSession
    steps = f"{shared_folder(spark)}/components-{uuid.uuid4().hex}"
    edges = written(edges, steps)
    if edges.isEmpty():
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    for _ in range(rounds):
        # large star: of each node, the larger neighbours go to the smallest of node and neighbours
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = written(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), steps)
        large = both.join(least, "a").where("b > a").select(F.col("m").alias("a"), "b").where("a < b").distinct()
        large = written(large, steps)
        # small star: of each node, the smaller neighbours and the node itself go to the smallest
        down = large.select(F.col("b").alias("u"), F.col("a").alias("v"))
        least = written(down.groupBy("u").agg(F.min("v").alias("m")), steps)
        moved = down.join(least, "u")
        small = moved.select(F.col("m").alias("a"), F.col("v").alias("b")).union(moved.select(F.col("m").alias("a"), F.col("u").alias("b")))
        small = written(small.where("a < b").distinct(), steps)
        # stars only: each larger end has one smaller end, and no smaller end is a larger one
        same = small.count() == edges.count() and small.join(edges, ["a", "b"], "left_anti").isEmpty()
        edges = small
        if same:
            break
    else:
        raise RuntimeError(f"components: not stable after {rounds} rounds")
    roots = edges.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct()
    found = written(roots.union(edges.select(F.col("b").alias("node"), F.col("a").alias("component"))))
    dropped(spark, steps)
    return found

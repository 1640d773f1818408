"""Waveform queries; embeddings stand in for audio."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lyrebird.functions import audio as A
from lyrebird.plans.catalog import query
from lyrebird.plans.vectors import D, long, long_sql, vectors
from lyrebird.session import small_batches, table


@query("wave_mono", long_sql("list_transform(a, lambda x, i: (x + a[65 - i]) / 2)"))
def wave_mono(spark: SparkSession, sf_dir: str) -> DataFrame:
    return long(vectors(spark, sf_dir), A.to_mono(F.array("a", F.reverse("a"))))


@query("wave_range", long_sql("list_transform(list_transform(a, lambda x: x * 4), lambda x: x / greatest(1, list_max(list_transform(a, lambda y: abs(y * 4)))))"))
def wave_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return long(vectors(spark, sf_dir), A.into_range(F.transform("a", lambda v: v * 4)))


@query("wave_integers", "SELECT l_orderkey, l_linenumber, round((l_partkey % 65536 - 32768.0) / 32768.0, 9) AS v FROM lineitem")
def wave_integers(spark: SparkSession, sf_dir: str) -> DataFrame:
    sample = A.from_integers(F.array(F.col("l_partkey") % 65536), 16, False)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.round(sample[0], 9).alias("v"))


@query("wave_resample_linear", "WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS a, unnest(range(0, 32)) AS i FROM embeddings) SELECT vec_id, i::INT AS i, round(a[i * 2 + 1], 6) AS v FROM e")
def wave_resample_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    return long(vectors(spark, sf_dir), A.resample_linear(F.col("a"), F.lit(32000), 16000))


@query("wave_seek", long_sql("a[9:40]"))
def wave_seek(spark: SparkSession, sf_dir: str) -> DataFrame:
    return long(vectors(spark, sf_dir), A.seek(F.col("a"), 16, 0.5, 2.0))


@query("wave_chunks", "SELECT vec_id, chunk::INT AS chunk, round(list_sum(list_transform(embedding[(chunk * 24 + 1)::INT:(chunk * 24 + 24)::INT]::DOUBLE[], lambda x: x * x)), 6) AS energy, 24 AS size FROM (SELECT *, unnest(range(0, 3)) AS chunk FROM embeddings)")
def wave_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = vectors(spark, sf_dir).select("vec_id", F.posexplode(A.chunks(F.col("a"), 24)).alias("chunk", "part"))
    return cut.select("vec_id", "chunk", F.round(A.energy(F.col("part")), 6).alias("energy"), F.size("part").alias("size"))


@query("wave_frames", "WITH p AS (SELECT vec_id, list_concat(list_concat(list_reverse(a[2:9]), a), list_reverse(a[56:63])) AS p FROM (SELECT vec_id, embedding::DOUBLE[] AS a FROM embeddings)) SELECT vec_id, f::INT AS frame, round(list_sum(list_transform(p[(f * 8 + 1)::INT:(f * 8 + 16)::INT], lambda x: x * x)), 6) AS energy FROM (SELECT *, unnest(range(0, 9)) AS f FROM p)")
def wave_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = vectors(spark, sf_dir).select("vec_id", F.posexplode(A.frames(F.col("a"), 16, 8)).alias("frame", "part"))
    return cut.select("vec_id", "frame", F.round(A.energy(F.col("part")), 6).alias("energy"))


@query("pad_and_mask", "WITH s AS (SELECT conv_id, count(*) AS n FROM conversations GROUP BY 1), m AS (SELECT max(n) AS most FROM s) SELECT conv_id, n, most - n AS zeros FROM s, m")
def pad_and_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ragged rows filled up to the longest."""
    sizes = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    longest = sizes.agg(F.max("n").alias("most"))
    padded = A.padded_to(F.array_repeat(F.lit(1.0), F.col("n").cast("int")), F.col("most").cast("int"))
    full = sizes.crossJoin(F.broadcast(longest)).withColumn("padded", padded)  # one row
    return full.select("conv_id", "n", F.size(F.filter("padded", lambda v: v == 0)).cast("long").alias("zeros"))


@query("scatter_back", "SELECT o_orderkey, l_linenumber FROM orders LEFT JOIN (SELECT * FROM lineitem WHERE l_quantity > 45) l ON o_orderkey = l_orderkey")
def scatter_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results go back to their samples; a sample without one keeps a null."""
    results = table(spark, sf_dir, "lineitem").where("l_quantity > 45")
    samples = table(spark, sf_dir, "orders")
    return samples.join(results, F.col("o_orderkey") == F.col("l_orderkey"), "left").select("o_orderkey", "l_linenumber")


@query("offset_items", "SELECT l_orderkey, l_linenumber, round(l_quantity + l_orderkey % 7 * 40.0, 3) AS start_time FROM lineitem")
def offset_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Item times within a chunk become times in the whole clip."""
    offsets = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), (F.col("o_orderkey") % 7 * 40.0).alias("offset"))
    return table(spark, sf_dir, "lineitem").join(offsets, "l_orderkey").select("l_orderkey", "l_linenumber", F.round(F.col("l_quantity") + F.col("offset"), 3).alias("start_time"))


@query("largest_gap", "SELECT user_id, max(gap) AS gap FROM (SELECT user_id, event_id - lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS gap FROM events) GROUP BY user_id")
def largest_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The longest stretch between neighbouring boundaries."""
    gap = F.col("event_id") - F.lag("event_id").over(Window.partitionBy("user_id").orderBy("event_id"))
    return table(spark, sf_dir, "events").select("user_id", gap.alias("gap")).groupBy("user_id").agg(F.max("gap").alias("gap"))


@query("audio_sources", "SELECT vec_id, (i - 17)::INT AS i, round(round(embedding[i]::DOUBLE * 32767) / 32768, 6) AS v FROM (SELECT *, unnest(range(17, 49)) AS i FROM embeddings)")
def audio_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as PCM files in data URLs, read from the 16th sample on for 32 samples."""
    from lyrebird.sources.files import load_audio

    refs = vectors(spark, sf_dir).select(F.col("vec_id").alias("id"), F.concat(F.lit("data:audio/wav;base64,"), F.base64(A.wav_file(F.col("a"), 16000))).alias("ref"))
    read = load_audio(refs, None, 16 / 16000, 32 / 16000)
    return read.select(F.col("id").alias("vec_id"), F.posexplode("wav").alias("i", "v")).select("vec_id", "i", (F.round("v", 6) + 0.0).alias("v"))


@query("audio_normalised", long_sql("list_transform(list_transform(a, lambda x, i: (x * 4 + a[65 - i] * 4) / 2), lambda x: x / greatest(1, list_max(list_transform(list_transform(a, lambda y, k: (y * 4 + a[65 - k] * 4) / 2), lambda z: abs(z)))))"))
def audio_normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two channels to one, the rate that is asked for, within range."""
    loud = F.transform("a", lambda v: v * 4)
    rows = vectors(spark, sf_dir).withColumns({"channels": F.array(loud, F.reverse(loud)), "sr": F.lit(16000)})
    return long(A.normalised(rows, "channels", "sr"), F.col("wav"))


def waves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector as 64 samples at 8 kHz."""
    return small_batches(table(spark, sf_dir, "embeddings")).where("embedding is not null").select("vec_id", F.lit(8000).alias("sr"), F.col("embedding").cast("array<double>").alias("wave"))


@query("resample_small", "SELECT vec_id, 2 * len(embedding) AS n FROM embeddings WHERE embedding IS NOT NULL")
def resample_small(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples of every vector at twice the rate; the tests compare the samples with tones."""
    doubled = waves(spark, sf_dir).select("vec_id", A.resample(F.col("wave"), F.col("sr")).alias("wave"))
    return doubled.select("vec_id", F.size("wave").cast("long").alias("n"))


@query("resample_samples")
def resample_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The samples themselves, a row each."""
    doubled = waves(spark, sf_dir).select("vec_id", A.resample(F.col("wave"), F.col("sr")).alias("wave"))
    return doubled.select("vec_id", F.posexplode("wave").alias("i", "v"))


@query("logmel_small")
def logmel_small(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features of every vector said 32 times over, a row for each filter; the tests hold them to a plain transform of a tone."""
    own = waves(spark, sf_dir).withColumn("wave", F.flatten(F.array_repeat("wave", 32)))
    mel = own.select("vec_id", F.posexplode(A.log_mel(A.resample(F.col("wave"), F.col("sr")))).alias("mel", "v"))
    return mel.select("vec_id", "mel", F.size("v").alias("frames"), F.round(F.array_max("v"), 6).alias("most"))

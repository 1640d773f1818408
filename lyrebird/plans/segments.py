"""Order-dependent transcript queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lyrebird.operators import segments as G
from lyrebird.plans.catalog import query
from lyrebird.session import small_batches, table


@query(
    "repetition_fuse",
    "WITH r AS (SELECT user_id, row_number() OVER w AS rn, len(list_distinct(list(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 14 PRECEDING AND CURRENT ROW))) AS d FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) SELECT user_id, min(rn)::INT AS at FROM r WHERE rn > 15 AND d <= 3 GROUP BY user_id",
)
def repetition_fuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.repetition_fuse(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "event_type")


@query("rollback_emit", "SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn, count(*) OVER (PARTITION BY user_id) AS n FROM events) WHERE rn <= n - 5 OR user_id % 2 = 0")
def rollback_emit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.rollback(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], 5, F.col("user_id") % 2 == 0).select("user_id", "event_id")


@query("memory_prefix", "SELECT conv_id, turn, coalesce(string_agg(text, '') OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING), '') AS prefix FROM conversations")
def memory_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.memory_prefix(table(spark, sf_dir, "conversations"), "conv_id", "turn", "text", 2).select("conv_id", "turn", "prefix")


@query("quietest_window", "WITH s AS (SELECT user_id, event_id, sum(abs(value)) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING) AS s, count(*) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING) AS n FROM events) SELECT user_id, arg_min(event_id, {'s': round(s, 6), 'e': event_id}) AS at FROM s WHERE n = 4 GROUP BY user_id")
def quietest_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each user's four consecutive values are least in sum."""
    ahead = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(0, 3)
    sums = table(spark, sf_dir, "events").select("user_id", "event_id", F.round(F.sum(F.abs("value")).over(ahead), 6).alias("s"), F.count(F.lit(1)).over(ahead).alias("n"))
    return sums.where("n = 4").groupBy("user_id").agg(F.min_by("event_id", F.struct("s", "event_id")).alias("at"))


CUES = "w AS (SELECT conv_id, turn, unnest(range(0, len(string_split(text, ' ')))) AS i, unnest(string_split(text, ' ')) AS word FROM conversations), f AS (SELECT *, coalesce(max(regexp_matches(word, '[,.?!]')::INT) OVER (PARTITION BY conv_id, turn ORDER BY i ROWS BETWEEN 1 PRECEDING AND 1 PRECEDING), 0) AS new FROM w), s AS (SELECT *, sum(new) OVER (PARTITION BY conv_id, turn ORDER BY i ROWS UNBOUNDED PRECEDING) AS cue FROM f)"


@query("cue_segments_punct", f"WITH {CUES} SELECT conv_id, turn, cue::INT AS cue, min(i)::INT AS first_word, count(*) AS words FROM s GROUP BY ALL")
def cue_segments_punct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cues that end at punctuation alone: each mark starts a new cue after it."""
    words = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.posexplode(F.split("text", " ")).alias("i", "word"))
    order = Window.partitionBy("conv_id", "turn").orderBy("i")
    ended = F.coalesce(F.lag(F.col("word").rlike("[,.?!]").cast("int")).over(order), F.lit(0))
    marked = words.withColumn("new", ended).withColumn("cue", F.sum("new").over(order).cast("int"))
    return marked.groupBy("conv_id", "turn", "cue").agg(F.min("i").alias("first_word"), F.count(F.lit(1)).alias("words"))


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as aligned items: a word each 0.3 seconds."""
    words = F.filter(F.split("text", " "), lambda w: w != "")
    spans = F.transform(words, lambda w, i: F.struct(w.alias("text"), (i * 0.3).alias("start_time"), (i * 0.3 + 0.25).alias("end_time")))
    return small_batches(table(spark, sf_dir, "conversations")).select("conv_id", "turn", "text", spans.alias("items"))


@query("cue_segments_full")
def cue_segments_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    cues = items(spark, sf_dir).select("conv_id", "turn", F.posexplode(G.cues(F.col("items"))).alias("cue", "c"))
    return cues.select("conv_id", "turn", "cue", "c.start", "c.end", "c.text", G.srt(F.col("c"), F.col("cue") + 1).alias("srt"))


@query("subtitle_files")
def subtitle_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file a turn; the tests hold the operator to literal files."""
    return G.subtitle_file(items(spark, sf_dir), ["conv_id", "turn"], "items")


@query("lis_repair")
def lis_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    stamps = F.transform("items", lambda x, i: (x["start_time"] * 1000).cast("long") + F.when(i % 7 == 3, 5000).otherwise(0))
    return items(spark, sf_dir).select("conv_id", "turn", G.repair_stamps(stamps).alias("ms"))


@query("reconcile")
def reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cleaned words matched back to the text that holds punctuation."""
    from lyrebird.functions.text import clean_token

    clean = F.filter(F.transform("items", lambda x: F.struct(clean_token(x["text"]).alias("text"), x["start_time"].alias("start_time"), x["end_time"].alias("end_time"))), lambda x: x["text"] != "")
    whole = items(spark, sf_dir).select("conv_id", "turn", "text", G.reconcile(F.col("text"), clean).alias("items"))
    return whole.select("conv_id", "turn", F.size("items").alias("n"), (F.array_join(F.transform("items", lambda x: x["text"]), "") == F.col("text")).alias("whole"))


@query("items_json")
def items_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return items(spark, sf_dir).select("conv_id", "turn", G.items_json(F.col("items")).alias("json"))

"""Token-sequence, cache and session queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lyrebird.operators import ngrams as G
from lyrebird.operators import tokens as K
from lyrebird.plans.catalog import SQL, query
from lyrebird.session import table

WORDS = "w AS (SELECT doc_id, unnest(range(0, len(string_split(text, ' ')))) AS pos, unnest(string_split(text, ' ')) AS word FROM documents)"
GRAMS = f"{WORDS}, l AS (SELECT word AS nxt, lag(word) OVER v AS b1, lag(word, 2) OVER v AS b2, doc_id FROM w WINDOW v AS (PARTITION BY doc_id ORDER BY pos)), g AS (SELECT doc_id, 1 AS n, b1 AS gram, nxt FROM l WHERE b1 IS NOT NULL UNION ALL SELECT doc_id, 2, b2 || ' ' || b1, nxt FROM l WHERE b2 IS NOT NULL), c AS (SELECT n, gram, nxt, count(*) AS times FROM g GROUP BY ALL)"


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", " ")).alias("pos", "word"))


@query("ngram_counts", f"WITH {GRAMS} SELECT n, gram, nxt AS next, times FROM c")
def ngram_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.merged_counts(*G.cache(table(spark, sf_dir, "documents"), "text"))


@query("ngram_merge", f"WITH {GRAMS} SELECT n, gram, nxt AS next, times FROM c")
def ngram_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The caches of two halves of the documents make that of all."""
    half = F.coalesce(F.col("doc_id") % 2, F.lit(0)) == 0
    return G.merged_counts(*G.cache(table(spark, sf_dir, "documents"), "text", half, ~half))


@query("ngram_draft", f"WITH {GRAMS}, b AS (SELECT n, gram, arg_max(nxt, {{'t': times, 'x': nxt}}) AS draft, max(times) AS top, sum(times) AS total FROM c GROUP BY n, gram) SELECT n, gram, draft FROM b WHERE total >= 2 AND 100 * top >= CASE n WHEN 1 THEN 66 ELSE 50 END * total")
def ngram_draft(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.drafts(*G.cache(table(spark, sf_dir, "documents"), "text"), [2, 2], [66, 50])


@query("ngram_lookup", f"WITH {GRAMS}, d AS (SELECT n, gram, arg_max(nxt, {{'t': times, 'x': nxt}}) AS draft FROM c GROUP BY n, gram), q AS (SELECT doc_id, arg_max(b1, pos) AS b1, arg_max(b2, pos) AS b2 FROM (SELECT doc_id, pos, word AS b1, lag(word) OVER (PARTITION BY doc_id ORDER BY pos) AS b2 FROM w) GROUP BY doc_id) SELECT q.doc_id, coalesce(two.draft, one.draft) AS draft FROM q LEFT JOIN d two ON two.n = 2 AND two.gram = q.b2 || ' ' || q.b1 LEFT JOIN d one ON one.n = 1 AND one.gram = q.b1")
def ngram_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The next word of each document: by its last two words, else by the last."""
    from lyrebird.sources.scratch import shared

    ends = table(spark, sf_dir, "documents").select("doc_id", F.split("text", " ").alias("t"))
    asked = ends.where("t is not null").select("doc_id", F.element_at("t", -1).alias("one"), F.concat(F.try_element_at("t", F.lit(-2)), F.lit(" "), F.element_at("t", -1)).alias("two"))
    home = shared(spark, "drafts")
    G.drafts(*G.cache(table(spark, sf_dir, "documents"), "text"), [1, 1], [0, 0], ends=True).write.parquet(home)
    found = spark.read.schema("n int, gram string, draft string").parquet(home)
    one, two = (found.where(F.col("n") == n).select(F.col("gram").alias(c), F.col("draft").alias(f"draft_{c}")) for n, c in ((1, "one"), (2, "two")))
    return asked.join(two, "two", "left").join(one, "one", "left").select("doc_id", F.coalesce("draft_two", "draft_one").alias("draft"))


@query("lcp_slot_match", "WITH d AS (SELECT doc_id, string_split(text, ' ') AS t FROM documents), p AS (SELECT x.doc_id AS req, y.doc_id AS slot, len(x.t) AS n, coalesce((SELECT min(i) FROM range(1, least(len(x.t), len(y.t)) + 1) r(i) WHERE x.t[i] <> y.t[i]) - 1, least(len(x.t), len(y.t))) AS lcp FROM d x JOIN d y ON x.t[1] = y.t[1] AND x.doc_id <> y.doc_id), s AS (SELECT *, lcp / n AS share FROM p WHERE lcp / n > 0.1) SELECT req, arg_max(slot, {'s': share, 'x': -slot}) AS slot, round(max(share), 6) AS share FROM s GROUP BY req")
def lcp_slot_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document as a request against slots that hold the others."""
    split = table(spark, sf_dir, "documents").select("doc_id", F.split("text", " ").alias("t"))
    found = K.best_slot(split.select(F.col("doc_id").alias("req"), F.col("t").alias("tokens")), split.select(F.col("doc_id").alias("slot"), F.col("t").alias("cached")), 0.1)
    return found.select("req", "slot", F.round("share", 6).alias("share"))


@query("speculative_accept", "WITH p AS (SELECT l_orderkey AS seq, l_linenumber AS pos, l_quantity::INT % 3 AS draft, l_suppkey % 3 AS sampled FROM lineitem), s AS (SELECT *, min(pos) FILTER (WHERE draft <> sampled) OVER (PARTITION BY seq) AS stop FROM p) SELECT seq, pos, sampled FROM s WHERE stop IS NULL OR pos <= stop")
def speculative_accept(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("seq"), F.col("l_linenumber").alias("pos"), (F.floor("l_quantity") % 3).alias("draft"), (F.col("l_suppkey") % 3).alias("sampled"))
    return K.accept_draft(pairs, "seq", "pos", "draft", "sampled").select("seq", "pos", "sampled")


CELLS = "c AS (SELECT user_id % 5 AS seq, event_id AS pos FROM events)"


@query(
    "kv_seq_ops",
    f"WITH {CELLS}, r AS (SELECT * FROM c WHERE NOT (seq = 1 AND pos >= 100 AND pos < 500)), y AS (SELECT * FROM r UNION ALL SELECT 9, pos FROM r WHERE seq = 2), h AS (SELECT seq, CASE WHEN seq = 3 AND pos >= 0 AND pos < 1000 THEN pos - 200 ELSE pos END AS pos FROM y), k AS (SELECT seq, CASE WHEN seq = 4 THEN pos // 2 ELSE pos END AS pos FROM h WHERE pos >= 0) SELECT seq, count(*) AS n, min(pos) AS least, max(pos) AS most, sum(pos)::BIGINT AS total FROM k GROUP BY seq",
)
def kv_seq_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells after a removal, a copy, a shift and a division, with the extremes of each sequence."""
    cells = table(spark, sf_dir, "events").select((F.col("user_id") % 5).alias("seq"), F.col("event_id").alias("pos"))
    cells = K.remove_positions(cells, F.lit(1), 100, 500)
    cells = K.copy_sequence(cells, 2, 9)
    cells = K.shift_positions(cells, 3, 0, 1000, -200)
    cells = K.divide_positions(cells, 4, 2)
    return cells.groupBy("seq").agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("least"), F.max("pos").alias("most"), F.sum("pos").alias("total"))


@query("ubatch_split_simple", "SELECT role, conv_id, turn, (row_number() OVER (PARTITION BY role ORDER BY conv_id, turn, text) - 1) // 16 AS batch FROM conversations")
def ubatch_split_simple(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.split_simple(table(spark, sf_dir, "conversations"), "role", ["conv_id", "turn", "text"], 16, F.floor(F.col("conv_id") / 100)).select("role", "conv_id", "turn", "batch")


@query("ubatch_split_equal", "SELECT conv_id, turn, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) // 2 AS batch FROM conversations")
def ubatch_split_equal(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").withColumn("all", F.lit(0))
    return K.split_equal(turns, "all", "conv_id", "turn", 2).select("conv_id", "turn", "batch")


@query("ubatch_split_seq", "SELECT conv_id, count(*) AS n, min(turn) AS first_turn FROM conversations GROUP BY conv_id")
def ubatch_split_seq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"), F.min("turn").alias("first_turn"))


@query("session_ttl", "WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 600 SECOND THEN 0 ELSE 1 END AS fresh FROM events), s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(ts) AS began, max(ts) + INTERVAL 600 SECOND AS expires, count(*) AS n FROM s GROUP BY user_id, k")
def session_ttl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions that end 600 seconds after their last event."""
    spans = table(spark, sf_dir, "events").groupBy("user_id", F.session_window("ts", "600 seconds").alias("s")).agg(F.count(F.lit(1)).alias("n"))
    return spans.select("user_id", F.col("s.start").cast("timestamp_ntz").alias("began"), F.col("s.end").cast("timestamp_ntz").alias("expires"), "n")


@query("rope_positions", "WITH e AS (SELECT user_id, event_id, event_type <> 'view' AS seen FROM events) SELECT user_id, event_id, CASE WHEN seen THEN sum(seen::INT) OVER (PARTITION BY user_id ORDER BY event_id) - 1 ELSE 1 END::BIGINT AS position FROM e")
def rope_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("user_id", "event_id", (F.col("event_type") != "view").alias("seen"))
    return K.positions(events, "user_id", "event_id", "seen").select("user_id", "event_id", F.col("position").cast("long").alias("position"))


@query("tensor_shards")
def tensor_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.floor("l_quantity").alias("size"))
    return K.shards(items, "l_orderkey", "l_linenumber", "size", 60)


@query("stream_sessions")
def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream of event pieces buffered by session into full chunks; the tests hold it to the batch result."""
    from lyrebird.streaming.chunks import run_to_end

    return run_to_end(spark, sf_dir, 5)


@query(
    "shard_rows",
    "WITH RECURSIVE t AS (SELECT l_suppkey AS g, l_quantity::BIGINT AS size, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity) AS pos FROM lineitem), p AS (SELECT g, (sum(size) OVER (PARTITION BY g ORDER BY pos))::BIGINT AS s, size FROM t), r AS (SELECT g, 0::BIGINT AS e, min(s) AS s, 0 AS shard FROM p GROUP BY g UNION ALL SELECT g, e, s, shard FROM (SELECT r.g, arg_min(p.s - p.size, p.s) AS e, min(p.s) AS s, any_value(r.shard) + 1 AS shard FROM r JOIN p ON p.g = r.g AND p.s > greatest(r.e + 500, r.s) GROUP BY r.g)) SELECT r.g AS l_suppkey, r.shard, r.e AS began, coalesce(lead(r.e) OVER (PARTITION BY r.g ORDER BY r.e), x.total) - r.e AS size FROM r JOIN (SELECT g, max(s) AS total FROM p GROUP BY g) x ON x.g = r.g",
)
def shard_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each supplier's items dealt to shards of 500 units at most, by doubling of pointers."""
    from lyrebird.operators.shards import greedy_shards

    items = table(spark, sf_dir, "lineitem")
    found = greedy_shards(items, "l_suppkey", F.floor(F.col("l_orderkey") / 10_000), ["l_orderkey", "l_linenumber", "l_partkey", "l_quantity"], "l_quantity", 500)
    return found.select(F.col("g").alias("l_suppkey"), "shard", "began", "size")


@query("stream_session_ttl", SQL["session_ttl"])
def stream_session_ttl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`session_ttl` from a stream with state, timers and a restart between events and finish."""
    from lyrebird.streaming.sessions import closed

    return closed(spark, sf_dir)


@query(
    "dictionary_prefixes",
    "WITH w AS (SELECT unnest(string_split(text, ' ')) AS word FROM documents), u AS (SELECT word, count(*) AS n FROM w GROUP BY word), d AS (SELECT word AS entry, n AS score FROM u WHERE n >= 3 AND length(word) >= 2), c AS (SELECT word, entry, score FROM u LEFT JOIN d ON length(word) > 2 AND starts_with(word, entry)), b AS (SELECT word, coalesce(arg_max(entry, {'s': score, 'l': length(entry)}), word) AS l FROM c GROUP BY word) SELECT word, l AS left_part, substr(word, length(l) + 1) AS right_part FROM b",
)
def dictionary_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each word of the documents cut after its best left part, from a dictionary of the words that occur three times or more."""
    split = words(spark, sf_dir).select("word")
    dictionary = split.groupBy(F.col("word").alias("entry")).agg(F.count(F.lit(1)).alias("score")).where("score >= 3")
    return K.best_prefixes(split, dictionary).select("word", F.col("left").alias("left_part"), F.col("right").alias("right_part"))


LATE = "b AS (SELECT min(ts) AS low, max(ts) AS high FROM events), a AS (SELECT ts, floor((epoch_us(ts) - epoch_us(low)) / (epoch_us(high) - epoch_us(low) + 1) * 4) + (event_id % 10 = 0)::INT AS k FROM events, b), m AS (SELECT k, max(ts) AS top FROM a GROUP BY k), e AS (SELECT x.k, max(y.top) - INTERVAL 3 HOUR AS ended FROM m x LEFT JOIN m y ON y.k < x.k GROUP BY x.k), w AS (SELECT k, unnest([date_trunc('hour', ts), date_trunc('hour', ts) - INTERVAL 1 HOUR]) AS began FROM a), j AS (SELECT began, coalesce(began + INTERVAL 2 HOUR <= ended, false) AS late FROM w JOIN e USING (k))"


@query("stream_windows", f"WITH {LATE} SELECT began, sum((NOT late)::INT)::BIGINT AS n, sum(late::INT)::BIGINT AS n_late FROM j GROUP BY began")
def stream_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two-hour windows that begin each hour, from a stream of five arrivals with stragglers; rows too late are counted apart."""
    from lyrebird.streaming.windows import of_events

    return of_events(spark, sf_dir)

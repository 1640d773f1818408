"""Sampling filters; embeddings stand in for logits, a row a step."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lyrebird.operators import sampling as S
from lyrebird.plans.catalog import query
from lyrebird.session import table

SCALE = 8.0  # spreads the logits of the stand-in
LONG = "l AS (SELECT vec_id, unnest(generate_series(0, len(embedding) - 1))::INT AS tok, unnest(embedding)::DOUBLE * 8.0 AS x FROM embeddings)"
SOFT = LONG + ", e AS (SELECT *, exp(x - max(x) OVER (PARTITION BY vec_id)) AS w FROM l), s AS (SELECT vec_id, tok, x, w / sum(w) OVER (PARTITION BY vec_id) AS p FROM e)"
OUT = "SELECT vec_id, tok, round(x, 6) AS x FROM"


def logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("tok", "x")).withColumn("x", F.col("x").cast("double") * SCALE)


def shown(rows: DataFrame) -> DataFrame:
    return rows.select("vec_id", "tok", F.round("x", 6).alias("x"))


def _filter(name: str, sql: str, step) -> None:
    query(name, f"WITH {sql}")(lambda spark, sf_dir: shown(step(logits(spark, sf_dir))))


_filter("top_k", f"{LONG} {OUT} (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY x DESC, tok) AS rn FROM l) WHERE rn <= 5", lambda r: S.top_k(r, 5))
_filter("top_p", f"{SOFT} {OUT} (SELECT *, sum(p) OVER w - p AS before, row_number() OVER w AS rn FROM s WINDOW w AS (PARTITION BY vec_id ORDER BY p DESC, tok ROWS UNBOUNDED PRECEDING)) WHERE before < 0.7 OR rn = 1", lambda r: S.top_p(r, 0.7))
_filter("min_p", f"{LONG} {OUT} (SELECT *, max(x) OVER (PARTITION BY vec_id) AS best FROM l) WHERE x >= best + ln(0.2::DOUBLE)", lambda r: S.min_p(r, 0.2))
_filter(
    "typical",
    f"{SOFT}, h AS (SELECT *, -sum(p * ln(p)) OVER (PARTITION BY vec_id) AS h FROM s), g AS (SELECT *, round(abs(-ln(p) - h), 9) AS gap FROM h), "
    f"c AS (SELECT *, sum(p) OVER w - p AS before, row_number() OVER w AS rn FROM g WINDOW w AS (PARTITION BY vec_id ORDER BY gap, tok ROWS UNBOUNDED PRECEDING)) {OUT} c WHERE round(before, 9) <= 0.5 OR rn = 1",
    lambda r: S.typical(r, 0.5),
)
_filter("top_n_sigma", f"{LONG} {OUT} (SELECT *, max(x) OVER w AS best, stddev_pop(x) OVER w AS sigma FROM l WINDOW w AS (PARTITION BY vec_id)) WHERE x >= best - 1.5 * sigma", lambda r: S.top_n_sigma(r, 1.5))
_filter(
    "xtc",
    f"{SOFT}, c AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY p DESC, tok) AS rn, sum((p >= 0.05)::INT) OVER (PARTITION BY vec_id) AS above FROM s) {OUT} c WHERE vec_id % 2 = 1 OR above < 2 OR rn >= above",
    lambda r: S.xtc(r, 0.05, 0.5, (F.col("vec_id") % 2).cast("double")),
)
_filter("temperature", f"{LONG} SELECT vec_id, tok, round(x / 0.6, 6) AS x FROM l", lambda r: S.temperature(r, 0.6))
_filter(
    "temperature_by_entropy",
    f"{SOFT}, h AS (SELECT *, -sum(p * ln(p)) OVER (PARTITION BY vec_id) AS h, count(*) OVER (PARTITION BY vec_id) AS n FROM s) SELECT vec_id, tok, round(x / (0.3 + 1.0 * pow(h / ln(n), 2.0)), 6) AS x FROM h",
    lambda r: S.temperature_by_entropy(r, 0.8, 0.5, 2.0),
)
_filter("allow_list", f"{LONG} SELECT vec_id, tok, round(CASE WHEN tok BETWEEN 10 AND 19 OR tok IN (3, 40) THEN x ELSE -1e10 END, 6) AS x FROM l", lambda r: S.allow(r, 10, 20, [3, 40]))
_filter("mirostat_cut", f"{SOFT} {OUT} (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY p DESC, tok) AS rn FROM s) WHERE -log2(p) <= 5.0 OR rn = 1", lambda r: S.mirostat_cut(r, 5.0))
_filter(
    "adaptive_target",
    f"{SOFT} SELECT vec_id, tok, round(5.0 - 10.0 * pow(abs(p - 0.2) / 0.3, 2) / (1 + abs(p - 0.2) / 0.3), 6) AS x FROM s",
    lambda r: S.adaptive_target(r, 0.3, 0.4, 0.3, 5.0, 10.0),
)


def history(rows: DataFrame) -> DataFrame:
    """A made-up history: token i occurs vec_id % 3 + 1 times where i % 4 = vec_id % 4."""
    return rows.where(F.col("tok") % 4 == F.col("vec_id") % 4).select("vec_id", "tok", F.explode(F.sequence(F.lit(0).cast("long"), F.col("vec_id") % 3)).alias("i")).drop("i")


@query(
    "penalties",
    f"WITH {LONG} SELECT vec_id, tok, round(CASE WHEN tok % 4 <> vec_id % 4 THEN x ELSE CASE WHEN x <= 0 THEN x * 1.5 ELSE x / 1.5 END - (vec_id % 3 + 1) * 0.3 - 0.2 END, 6) AS x FROM l",
)
def penalties(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = logits(spark, sf_dir)
    return shown(S.penalties(rows, history(rows), 1.5, 0.3, 0.2))


@query("logit_bias", f"WITH {LONG} SELECT vec_id, tok, round(x + CASE WHEN tok < 8 THEN tok * 0.5 ELSE 0 END, 6) AS x FROM l")
def logit_bias(spark: SparkSession, sf_dir: str) -> DataFrame:
    bias = spark.range(8).select(F.col("id").cast("int").alias("tok"), (F.col("id") * 0.5).alias("bias"))
    return shown(S.logit_bias(logits(spark, sf_dir), F.broadcast(bias)))  # eight rows


@query("softmax", f"WITH {SOFT} SELECT vec_id, tok, round(p, 9) AS p FROM s")
def softmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.softmax(logits(spark, sf_dir)).select("vec_id", "tok", F.round("p", 9).alias("p"))


@query("greedy", f"WITH {LONG} SELECT vec_id, tok FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY x DESC, tok) AS rn FROM l) WHERE rn = 1")
def greedy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.greedy(logits(spark, sf_dir))


@query("draw", f"WITH {SOFT}, c AS (SELECT *, round(sum(p) OVER (PARTITION BY vec_id ORDER BY p DESC, tok ROWS UNBOUNDED PRECEDING), 12) AS upto FROM s) SELECT vec_id, arg_min(tok, upto) AS tok FROM c WHERE upto >= (vec_id % 97 + 0.5) / 100 GROUP BY vec_id")
def draw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.draw(logits(spark, sf_dir), (F.col("vec_id") % 97 + 0.5) / 100)


@query(
    "mirostat_k",
    f"WITH {SOFT}, r AS (SELECT *, row_number() OVER w AS rn, lead(p) OVER w AS nxt, count(*) OVER (PARTITION BY vec_id) AS n FROM s WINDOW w AS (PARTITION BY vec_id ORDER BY p DESC, tok)), "
    "f AS (SELECT vec_id, sum(ln((rn + 1.0) / rn) * ln(p / nxt)) / sum(pow(ln((rn + 1.0) / rn), 2)) AS s_hat, max(n) AS n FROM r WHERE rn < 20 AND nxt IS NOT NULL GROUP BY vec_id) "
    "SELECT vec_id, round(s_hat, 6) AS s_hat, greatest(floor(pow((s_hat - 1) * pow(2.0, 5.0) / (1 - pow(n, -(s_hat - 1))), 1 / s_hat)), 1)::BIGINT AS k FROM f",
)
def mirostat_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.mirostat_k(logits(spark, sf_dir), 5.0, 20).select("vec_id", F.round("s_hat", 6).alias("s_hat"), "k")


@query("token_probabilities", f"WITH {SOFT} SELECT vec_id, rn::INT AS rank, tok, round(p, 6) AS p, round(ln(p), 6) AS logprob FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY p DESC, tok) AS rn FROM s) WHERE rn <= 3")
def token_probabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.probabilities(logits(spark, sf_dir), 3).select("vec_id", "rank", "tok", F.round("p", 6).alias("p"), F.round("logprob", 6).alias("logprob"))


@query(
    "sampler_chain",
    f"WITH {LONG}, k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY x DESC, tok) AS rn FROM l) WHERE rn <= 20), e AS (SELECT *, exp(x - max(x) OVER (PARTITION BY vec_id)) AS w FROM k), "
    "s AS (SELECT vec_id, tok, x, w / sum(w) OVER (PARTITION BY vec_id) AS p FROM e), c AS (SELECT *, sum(p) OVER w - p AS before, row_number() OVER w AS rn FROM s WINDOW w AS (PARTITION BY vec_id ORDER BY p DESC, tok ROWS UNBOUNDED PRECEDING)), "
    "n AS (SELECT * FROM c WHERE before < 0.8 OR rn = 1), m AS (SELECT *, max(x) OVER (PARTITION BY vec_id) AS best FROM n) SELECT vec_id, tok, round(x / 0.7, 6) AS x FROM m WHERE x >= best + ln(0.1::DOUBLE)",
)
def sampler_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = (lambda r: S.top_k(r, 20), lambda r: S.top_p(r, 0.8), lambda r: S.min_p(r, 0.1), lambda r: S.temperature(r, 0.7))
    return shown(S.chain(logits(spark, sf_dir), *steps))


@query("timestamp_slots", "SELECT vec_id, ((list_position(embedding[1:40], list_max(embedding[1:40])) - 1) * 80)::INT AS ms FROM embeddings")
def timestamp_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best of the first slots, at 80 ms a slot."""
    first = F.slice("embedding", 1, 40)
    return table(spark, sf_dir, "embeddings").select("vec_id", ((F.array_position(first, F.array_max(first)) - 1) * 80).cast("int").alias("ms"))


SUFFIX = "t AS (SELECT conv_id, turn, list_concat(string_split(text, ' '), string_split(text, ' ')[1:3]) AS w FROM conversations WHERE text <> ''), b AS (SELECT *, list_reverse(w) AS r, coalesce(list_position(list_transform(list_reverse(w), lambda x: x IN ('the', 'and')), true) - 1, len(w)) AS most FROM t), p AS (SELECT conv_id, turn, r, most, unnest(range(2, len(r) + 1)) AS j FROM b), m AS (SELECT conv_id, turn, r[j - 1] AS token, least(most, coalesce(list_position(list_transform(range(1, (len(r) - j + 2)::BIGINT), lambda k: r[j + k - 1] = r[k]), false) - 1, len(r) - j + 1)) AS n FROM p)"


@query("suffix_penalty", f"WITH {SUFFIX} SELECT conv_id, turn, token, round(0.8 * pow(1.75, least(max(n) - 2, 20)), 4) AS penalty FROM m WHERE n >= 2 GROUP BY ALL")
def suffix_penalty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn, which begins again, as the context; two words break sequences."""
    words = F.split("text", " ")
    turns = table(spark, sf_dir, "conversations").where("text <> ''").select("conv_id", "turn", F.concat(words, F.slice(words, 1, 3)).alias("w"))
    found = S.suffix_penalties(turns, ["conv_id", "turn"], "w", ["the", "and"], 0.8, 1.75, 2, 20)
    return found.select("conv_id", "turn", "token", F.round("penalty", 4).alias("penalty"))


REPEATS = "t AS (SELECT doc_id, list_concat(string_split(text, ' '), string_split(text, ' ')[1:3]) AS w FROM documents WHERE text <> ''), b AS (SELECT doc_id, list_reverse(w) AS r, coalesce(list_position(list_transform(list_reverse(w), lambda x: x IN ('the', 'and')), true) - 1, len(w)) AS most FROM t), p AS (SELECT doc_id, r, most, unnest(list_filter(range(2, len(r)), lambda j: r[j] = r[1] AND r[j + 1] = r[2])) AS j FROM b WHERE most >= 2), m AS (SELECT doc_id, r[j - 1] AS token, least(most, coalesce(list_position(list_transform(range(1, (len(r) - j + 2)::BIGINT), lambda k: r[j + k - 1] = r[k]), false) - 1, len(r) - j + 1)) AS n FROM p)"


@query("suffix_penalty_documents", f"WITH {REPEATS} SELECT doc_id, token, round(0.8 * pow(1.75, least(max(n) - 2, 20)), 4) AS penalty FROM m WHERE n >= 2 GROUP BY ALL")
def suffix_penalty_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document, which begins again, as the context."""
    words = F.split("text", " ")
    docs = table(spark, sf_dir, "documents").where("text <> ''").select("doc_id", F.concat(words, F.slice(words, 1, 3)).alias("w"))
    found = S.suffix_penalties(docs, ["doc_id"], "w", ["the", "and"], 0.8, 1.75, 2, 20)
    return found.select("doc_id", "token", F.round("penalty", 4).alias("penalty"))


PIECES = "t AS (SELECT range::INT AS tok, CASE WHEN range = 63 THEN '' ELSE bin(range + 1) END AS piece FROM range(64))"
MERGED = (
    f"{SOFT}, {PIECES}, d AS (SELECT vec_id, 3 * sum(p) FILTER (tok = 63) * count(*) > sum(p) FILTER (tok <> 63) AS stop, list(p ORDER BY tok) AS p FROM s GROUP BY vec_id), y AS (SELECT vec_id, tok, row_number() OVER (PARTITION BY vec_id ORDER BY x DESC, tok) AS r FROM s), z AS (SELECT a.tok AS i, b.tok AS j FROM t a JOIN t b ON a.tok <> b.tok AND a.piece <> '' AND starts_with(b.piece, a.piece)), "
    "o AS (SELECT a.vec_id, i + 1 AS i, j + 1 AS j, row_number() OVER (PARTITION BY a.vec_id ORDER BY a.r, b.r) AS k FROM z JOIN y a ON a.tok = i JOIN y b ON b.tok = j AND b.vec_id = a.vec_id), "
    "f AS (SELECT vec_id, 0::BIGINT AS k, p FROM d WHERE NOT stop UNION ALL SELECT f.vec_id, o.k, CASE WHEN p[i] < 0 OR p[j] < 0 THEN p ELSE list_transform(p, lambda v, n: CASE WHEN n = (CASE WHEN p[j] > p[i] THEN j ELSE i END) THEN p[i] + p[j] WHEN n = i OR n = j THEN -1 ELSE v END) END FROM f JOIN o ON o.vec_id = f.vec_id AND o.k = f.k + 1), "
    "g AS (SELECT vec_id, unnest(range(64))::INT AS tok, unnest(p) AS p FROM f WHERE k = (SELECT max(k) FROM o)), h AS (SELECT *, count(*) FILTER (tok <> 63) OVER w AS n, p / sum(p) OVER w AS q FROM g WHERE p >= 0.2 OR tok = 63 WINDOW w AS (PARTITION BY vec_id)), "
    "r AS (SELECT vec_id, tok, q / sum(q) OVER (PARTITION BY vec_id) AS p FROM h WHERE n > 0 AND (tok = 63 OR q >= 1 / (n + 1))) SELECT vec_id, tok, round(p, 6) AS p FROM r UNION ALL SELECT vec_id, 63, 1.0 FROM d WHERE stop UNION ALL SELECT vec_id, 63, 1.0 FROM h GROUP BY vec_id HAVING max(n) = 0"
)


@query("infill_merge", f"WITH RECURSIVE {MERGED}")
def infill_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates merged by common beginnings; a token's piece is its number in binary, and the last token ends the text."""
    rows = logits(spark, sf_dir).withColumns({"piece": F.bin(F.col("tok") + 1), "eog": F.col("tok") == 63})
    return S.infill(rows, 63).select("vec_id", "tok", F.round("p", 6).alias("p"))

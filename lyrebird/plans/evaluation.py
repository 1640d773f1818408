"""Evaluation queries; embeddings stand in for logits and activations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lyrebird.operators import evaluation as E
from lyrebird.operators import ranks
from lyrebird.plans.catalog import query
from lyrebird.plans.sampling import LONG, SOFT, logits
from lyrebird.session import table

TARGET = "vec_id % 64"
NLL = f"{LONG}, m AS (SELECT *, max(x) OVER (PARTITION BY vec_id) AS m FROM l), n AS (SELECT vec_id, max(m) + ln(sum(exp(x - m))) - max(x) FILTER (WHERE tok = {TARGET}) AS nll FROM m GROUP BY vec_id)"
UNC = "CASE WHEN count(v) > 10 AND avg(v * v) - avg(v) * avg(v) > 0 THEN sqrt((avg(v * v) - avg(v) * avg(v)) / (count(v) - 1)) ELSE 0 END"


def nlls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.nll(logits(spark, sf_dir), "vec_id", "tok", "x", F.col("vec_id") % 64)


@query("logsoftmax_nll", f"WITH {NLL} SELECT vec_id, round(nll, 6) AS nll FROM n")
def logsoftmax_nll(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nlls(spark, sf_dir).select("vec_id", F.round("nll", 6).alias("nll"))


@query("perplexity", f"WITH {NLL}, p AS (SELECT count(v) AS n, exp(avg(v)) AS ppl, exp(avg(v)) * {UNC} AS unc FROM (SELECT nll AS v FROM n)) SELECT n, round(ppl, 5) AS ppl, round(unc, 5) AS ppl_unc FROM p")
def perplexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.perplexity(nlls(spark, sf_dir)).select("n", F.round("ppl", 5).alias("ppl"), F.round("ppl_unc", 5).alias("ppl_unc"))


@query("perplexity_strided", f"WITH {NLL}, w AS (SELECT vec_id, avg(nll) OVER (PARTITION BY vec_id % 10 ORDER BY vec_id ROWS BETWEEN 15 PRECEDING AND CURRENT ROW) AS m FROM n) SELECT vec_id, round(exp(m), 5) AS ppl FROM w")
def perplexity_strided(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Perplexity over a sliding stretch of each sequence; vec_id % 10 stands for the sequence."""
    rows = nlls(spark, sf_dir).select((F.col("vec_id") % 10).alias("sequence"), "vec_id", "nll")
    means = ranks.sliding_mean(rows, ["sequence"], F.floor(F.col("vec_id") / 10_000), ["vec_id"], "nll", 16)
    return means.select("vec_id", F.round(F.exp("mean"), 5).alias("ppl"))


KL = f"{SOFT}, b AS (SELECT vec_id, tok, ln(p) AS base, x * 0.8 AS y FROM s), c AS (SELECT *, max(y) OVER (PARTITION BY vec_id) AS m FROM b), d AS (SELECT vec_id, tok, base, y - m - ln(sum(exp(y - m)) OVER (PARTITION BY vec_id)) AS other FROM c), k AS (SELECT vec_id, sum(CASE WHEN base > -16 THEN exp(base) * (base - other) ELSE 0 END) AS kl FROM d GROUP BY vec_id)"


def divergences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Against the same logits at another temperature."""
    by = Window.partitionBy("vec_id")
    rows = logits(spark, sf_dir).withColumn("y", F.col("x") * 0.8).withColumns({"mx": F.max("x").over(by), "my": F.max("y").over(by)})
    logs = rows.select("vec_id", "tok", *[(F.col(v) - F.col(f"m{v}") - F.log(F.sum(F.exp(F.col(v) - F.col(f"m{v}"))).over(by))).alias(n) for v, n in (("x", "base"), ("y", "other"))])
    return E.divergence(logs, "vec_id", "tok", "base", "other")


@query("kl_per_step", f"WITH {KL} SELECT vec_id, round(kl, 6) AS kl, true AS same_top FROM k")
def kl_per_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergences(spark, sf_dir).select("vec_id", F.round("kl", 6).alias("kl"), "same_top")


@query("kl_report", f"WITH {KL} SELECT round(avg(v), 6) AS mean, round({UNC}, 6) AS unc, round(quantile_cont(v, 0.5), 6) AS median, round(quantile_cont(v, 0.99), 6) AS p99, round(max(v), 6) AS most, round(min(v), 6) AS least FROM (SELECT kl AS v FROM k)")
def kl_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantiles are found through bins, so no task holds all values; the divergences are computed for each of its three passes."""
    kl = divergences(spark, sf_dir).select(F.lit(0).alias("all"), "kl")
    plain = kl.agg(*E.mean_and_uncertainty("kl"), F.max("kl").alias("most"), F.min("kl").alias("least"))
    found = ranks.quantiles(kl, "all", "kl", 0.001, [0.5, 0.99]).agg(*[F.max(F.when(F.col("share") == p, F.col("quantile"))).alias(n) for n, p in (("median", 0.5), ("p99", 0.99))])
    report = plain.crossJoin(found)  # a row each
    return report.select(*[F.round(c, 6).alias(c) for c in report.columns])


@query("percentile_report", "SELECT event_type, round(quantile_cont(value, 0.05), 6) AS p05, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95 FROM events GROUP BY 1")
def percentile_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ranks.quantiles(table(spark, sf_dir, "events"), "event_type", "value", 0.05, [0.05, 0.5, 0.95])
    return found.groupBy("event_type").agg(*[F.round(F.max(F.when(F.col("share") == p, F.col("quantile"))), 6).alias(n) for n, p in (("p05", 0.05), ("p50", 0.5), ("p95", 0.95))])


@query("ratio_statistics", "SELECT l_returnflag, round(covar_pop(ln(l_extendedprice), ln(l_quantity)) / (count(*) - 1), 12) AS covariance, round(corr(ln(l_extendedprice), ln(l_quantity)), 6) AS correlation, round(avg(ln(l_extendedprice)) - avg(ln(l_quantity)), 6) AS log_ratio FROM lineitem GROUP BY 1")
def ratio_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Covariance of means, correlation and log ratio of two runs' values."""
    x, y = F.log("l_extendedprice"), F.log("l_quantity")
    grouped = table(spark, sf_dir, "lineitem").groupBy("l_returnflag")
    return grouped.agg(F.round(F.covar_pop(x, y) / (F.count(F.lit(1)) - 1), 12).alias("covariance"), F.round(F.corr(x, y), 6).alias("correlation"), F.round(F.avg(x) - F.avg(y), 6).alias("log_ratio"))


@query(
    "choice_accuracy",
    f"WITH {LONG}, c AS (SELECT vec_id, tok // 16 AS choice, avg(x) AS m FROM l GROUP BY ALL), b AS (SELECT vec_id, arg_max(choice, {{'m': m, 'c': -choice}}) AS best FROM c GROUP BY vec_id), h AS (SELECT (best = label % 4) AS hit FROM b JOIN embeddings USING (vec_id)) "
    "SELECT count(*) AS n, round(avg(hit::INT), 6) AS acc, round(sqrt(avg(hit::INT) * (1 - avg(hit::INT)) / (count(*) - 1)), 6) AS unc FROM h",
)
def choice_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four endings a task, scored by mean log odds; the label says which is right."""
    scores = logits(spark, sf_dir).groupBy("vec_id", F.floor(F.col("tok") / 16).alias("choice")).agg(F.avg("x").alias("m"))
    best = scores.groupBy("vec_id").agg(F.max_by("choice", F.struct(F.col("m"), (-F.col("choice")).alias("c"))).alias("best"))
    hits = best.join(table(spark, sf_dir, "embeddings").select("vec_id", "label"), "vec_id").withColumn("hit", F.col("best") == F.col("label") % 4)
    return E.accuracy(hits, "hit").select("n", F.round("acc", 6).alias("acc"), F.round("unc", 6).alias("unc"))


@query("pairwise_accuracy", "SELECT count(*) AS n, round(avg((embedding[1] > embedding[2])::INT), 6) AS acc, round(sqrt(avg((embedding[1] > embedding[2])::INT) * (1 - avg((embedding[1] > embedding[2])::INT)) / (count(*) - 1)), 6) AS unc FROM embeddings")
def pairwise_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = table(spark, sf_dir, "embeddings").select((F.col("embedding")[0] > F.col("embedding")[1]).alias("hit"))
    return E.accuracy(hits, "hit").select("n", F.round("acc", 6).alias("acc"), F.round("unc", 6).alias("unc"))


COLUMNS = "v AS (SELECT label, unnest(generate_series(0, len(embedding) - 1))::INT AS col, unnest(embedding)::DOUBLE AS v FROM embeddings), c AS (SELECT label, col, sum(v * v) AS sum2, count(*) AS n FROM v GROUP BY ALL)"


@query("imatrix_columns", f"WITH {COLUMNS} SELECT label, col, round(sum2, 6) AS sum2, n FROM c")
def imatrix_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.column_activations(table(spark, sf_dir, "embeddings"), "label", "embedding").select("label", "col", F.round("sum2", 6).alias("sum2"), "n")


@query(
    "imatrix_entropy",
    f"WITH {COLUMNS}, a AS (SELECT label, sum2 / n AS act FROM c), p AS (SELECT label, act, act / sum(act) OVER w AS p, (act - avg(act) OVER w) / stddev_pop(act) OVER w AS z FROM a WINDOW w AS (PARTITION BY label)) "
    "SELECT label, round(sum(act), 6) AS total, round(avg(act), 8) AS mean, round(min(act), 8) AS least, round(max(act), 8) AS most, round(stddev_pop(act), 8) AS sigma, avg((abs(act) > 1e-5)::INT) AS active, round(-sum(p * log2(p)), 6) AS entropy, avg((z > 1)::INT) AS zd FROM p GROUP BY label",
)
def imatrix_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = E.activation_statistics(E.column_activations(table(spark, sf_dir, "embeddings"), "label", "embedding"), "label")
    digits = {"total": 6, "mean": 8, "least": 8, "most": 8, "sigma": 8, "entropy": 6}
    return stats.select(*[F.round(c, digits[c]).alias(c) if c in digits else F.col(c) for c in stats.columns])


@query("layer_cosine", f"WITH {COLUMNS}, a AS (SELECT label, col, sum2 / n AS act FROM c) SELECT x.label, round(sum(x.act * y.act) / (sqrt(sum(x.act * x.act)) * sqrt(sum(y.act * y.act))), 6) AS cosine FROM a x JOIN a y ON x.col = y.col AND x.label = y.label + 1 GROUP BY x.label")
def layer_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cosine of the mean activations of adjacent layers."""
    act = E.column_activations(table(spark, sf_dir, "embeddings"), "label", "embedding").select("label", "col", (F.col("sum2") / F.col("n")).alias("act"))
    below = act.select((F.col("label") + 1).alias("label"), "col", F.col("act").alias("below"))
    return E.errors(act.join(below, ["label", "col"]), ["label"], "act", "below").select("label", F.round("cosine", 6).alias("cosine"))


@query(
    "embedding_errors",
    "WITH v AS (SELECT vec_id, unnest(embedding)::DOUBLE AS a FROM embeddings), q AS (SELECT vec_id, a, round(a * 16) / 16 AS b FROM v) SELECT vec_id, round(avg(abs(a - b)), 6) AS mae, round(sqrt(sum((a - b) * (a - b))) / count(*), 6) AS rmse, round(sum((a - b) * (a - b)) / sum(a * a), 6) AS nmse, round(sum(a * b) / (sqrt(sum(a * a)) * sqrt(sum(b * b))), 6) AS cosine FROM q GROUP BY vec_id",
)
def embedding_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = table(spark, sf_dir, "embeddings").select("vec_id", F.explode("embedding").alias("a")).withColumn("a", F.col("a").cast("double"))
    found = E.errors(pairs.withColumn("b", F.round(F.col("a") * 16) / 16), ["vec_id"], "a", "b")
    return found.select("vec_id", *[F.round(c, 6).alias(c) for c in ("mae", "rmse", "nmse", "cosine")])


@query("tensor_param_count", "SELECT sum(len(embedding))::BIGINT AS total, (sum(len(embedding)) FILTER (WHERE label < 2))::BIGINT AS shared, (sum(len(embedding)) FILTER (WHERE label >= 2))::BIGINT AS expert FROM embeddings")
def tensor_param_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.size("embedding").cast("long")
    return table(spark, sf_dir, "embeddings").agg(F.sum(size).alias("total"), F.sum(F.when(F.col("label") < 2, size)).alias("shared"), F.sum(F.when(F.col("label") >= 2, size)).alias("expert"))


@query("pool_mean", "WITH v AS (SELECT label, unnest(generate_series(0, len(embedding) - 1))::INT AS col, unnest(embedding)::DOUBLE AS v FROM embeddings) SELECT label, col, round(avg(v), 6) AS v FROM v GROUP BY ALL")
def pool_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = table(spark, sf_dir, "embeddings").select("label", F.posexplode("embedding").alias("col", "v"))
    return long.groupBy("label", "col").agg(F.round(F.avg(F.col("v").cast("double")), 6).alias("v"))


@query("pool_first_last", "SELECT label, min(vec_id) AS first_id, max(vec_id) AS last_id, arg_min(embedding[1], vec_id)::DOUBLE AS cls_0, arg_max(embedding[1], vec_id)::DOUBLE AS last_0 FROM embeddings GROUP BY label")
def pool_first_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = F.col("embedding")[0].cast("double")
    return table(spark, sf_dir, "embeddings").groupBy("label").agg(F.min("vec_id").alias("first_id"), F.max("vec_id").alias("last_id"), F.min_by(first, "vec_id").alias("cls_0"), F.max_by(first, "vec_id").alias("last_0"))

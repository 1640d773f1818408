"""Vector queries over embeddings: norms, similarity, retrieval, block quantisation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lyrebird.functions import quant
from lyrebird.functions import vectors as V
from lyrebird.operators.neighbours import cosine_nearest
from lyrebird.plans.catalog import query
from lyrebird.session import table

D = "embedding::DOUBLE[]"


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", V.doubles(F.col("embedding")).alias("a"))


def long(rows: DataFrame, a: Column, digits: int = 6) -> DataFrame:
    rounded = F.round("v", digits)
    signed = F.when((rounded == 0) & (F.col("v") < 0), F.lit(-0.0)).otherwise(rounded)  # rounding keeps the sign of zero, as in SQL engines by IEEE 754
    return rows.select("vec_id", F.posexplode(a).alias("i", "v")).select("vec_id", "i", signed.alias("v"))


def long_sql(expression: str, digits: int = 6) -> str:
    return f"SELECT vec_id, unnest(generate_series(0, len(a) - 1))::INT AS i, round(unnest(a), {digits}) AS v FROM (SELECT vec_id, {expression} AS a FROM (SELECT vec_id, label, {D} AS a FROM embeddings))"


for _name, _mode, _sql in (
    ("l2", 2, "list_transform(a, lambda x: x / sqrt(list_sum(list_transform(a, lambda y: y * y))))"),
    ("maxabs", 0, "list_transform(a, lambda x: x / (list_max(list_transform(a, lambda y: abs(y))) / 32760.0))"),
    ("p1", 1, "list_transform(a, lambda x: x / list_sum(list_transform(a, lambda y: abs(y))))"),
):
    query(f"embed_normalize_{_name}", long_sql(_sql))(lambda spark, sf_dir, mode=_mode: long(vectors(spark, sf_dir), V.normalise(F.col("a"), mode)))


@query("cosine_pairs", f"WITH e AS (SELECT vec_id, label, {D} AS a FROM embeddings) SELECT x.vec_id AS id, y.vec_id AS next_id, round(list_cosine_similarity(x.a, y.a), 6) AS cosine FROM e x JOIN e y ON y.vec_id = x.vec_id + 1")
def cosine_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector with the next one."""
    rows = vectors(spark, sf_dir)
    after = rows.select((F.col("vec_id") - 1).alias("id"), F.col("vec_id").alias("next_id"), F.col("a").alias("b"))
    pairs = rows.withColumnRenamed("vec_id", "id").join(after, "id")
    return pairs.select("id", "next_id", F.round(V.cosine(F.col("a"), F.col("b")), 6).alias("cosine"))


TOP = f"WITH e AS (SELECT vec_id, {D} AS a FROM embeddings), q AS (SELECT vec_id AS query_id, a AS b FROM e WHERE vec_id % 50 = 0), s AS (SELECT query_id, vec_id, list_cosine_similarity(a, b) AS c FROM e, q WHERE vec_id <> query_id), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(c, 9) DESC, vec_id) AS rank FROM s)"


@query("cosine_topk", f"{TOP} SELECT query_id, rank::INT AS rank, vec_id, round(c, 6) AS cosine FROM r WHERE rank <= 5")
def cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest rows of a stated query set, every fiftieth id: blocks of queries meet blocks of rows, and each task keeps a query's best five."""
    rows = vectors(spark, sf_dir).select(F.col("vec_id").alias("id"), "a")
    found = cosine_nearest(rows, rows.where("id % 50 = 0"), 5)
    return found.select("query_id", "rank", "vec_id", F.round("cosine", 6).alias("cosine"))


@query("rerank", "SELECT rank::INT AS rank, vec_id, score FROM (SELECT vec_id, round(embedding[1]::DOUBLE, 6) AS score, row_number() OVER (ORDER BY embedding[1] DESC, vec_id) AS rank FROM embeddings) WHERE rank <= 10")
def rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best by score, with their ranks."""
    best = vectors(spark, sf_dir).select("vec_id", F.col("a")[0].alias("s")).orderBy(F.desc("s"), "vec_id").limit(10)
    rank = F.row_number().over(Window.orderBy(F.desc("s"), "vec_id"))  # ten rows
    return best.select(rank.alias("rank"), "vec_id", F.round("s", 6).alias("score"))


BLOCKS = f"b AS (SELECT vec_id, unnest(range(0, 2)) AS block, a FROM (SELECT vec_id, {D} AS a FROM embeddings)), c AS (SELECT vec_id, block, a[(block * 32 + 1)::INT:(block * 32 + 32)::INT] AS a FROM b)"
Q_SQL = {
    "q8_0": f"{BLOCKS}, d AS (SELECT *, list_max(list_transform(a, lambda x: abs(x))) / 127 AS d, 0.0 AS m FROM c), q AS (SELECT *, list_transform(a, lambda x: CASE WHEN d = 0 THEN 0 ELSE round(x / d) END) AS q FROM d)",
    "q4_0": f"{BLOCKS}, d AS (SELECT *, CASE WHEN -list_min(a) > list_max(a) THEN list_min(a) ELSE list_max(a) END / -8 AS d, 0.0 AS m FROM c), q AS (SELECT *, list_transform(a, lambda x: CASE WHEN d = 0 THEN 8 ELSE least(15, greatest(0, floor(x / d + 8.5))) END) AS q FROM d)",
    "q4_1": f"{BLOCKS}, d AS (SELECT *, (list_max(a) - list_min(a)) / 15 AS d, list_min(a) AS m FROM c), q AS (SELECT *, list_transform(a, lambda x: CASE WHEN d = 0 THEN 0 ELSE least(15, greatest(0, floor((x - m) / d + 0.5))) END) AS q FROM d)",
}
BACK = {"q8_0": "q * d", "q4_0": "(q - 8) * d", "q4_1": "q * d + m"}


def _quantised(kind: str):
    def build(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = quant.blocks(vectors(spark, sf_dir), "a", kind)
        return found.select("vec_id", "block", F.round("d", 9).alias("d"), F.posexplode("q").alias("i", "q"))

    return build


def _errors(kind: str):
    def build(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = quant.blocks(vectors(spark, sf_dir), "a", kind).withColumn("back", quant.restored(kind))
        gap = V.total(F.zip_with("values", "back", lambda x, y: (x - y) * (x - y)))
        sums = found.groupBy("vec_id").agg(F.sum(gap).alias("e"), F.sum(V.dot(F.col("values"), F.col("values"))).alias("s"), F.sum(F.size("values")).alias("n"))
        return sums.select("vec_id", F.round(F.col("e") / F.col("s"), 7).alias("nmse"), F.round(F.sqrt("e") / F.col("n"), 7).alias("rmse"))

    return build


for _kind, _sql in Q_SQL.items():
    query(f"quant_{_kind}", f"WITH {_sql} SELECT vec_id, block::INT AS block, round(d, 9) AS d, unnest(range(0, 32))::INT AS i, unnest(q)::INT AS q FROM q")(_quantised(_kind))
    query(
        f"quant_{_kind}_error",
        f"WITH {_sql}, u AS (SELECT vec_id, d, m, unnest(a) AS x, unnest(q) AS q FROM q), e AS (SELECT vec_id, x, {BACK[_kind]} AS y FROM u) SELECT vec_id, round(sum((x - y) * (x - y)) / sum(x * x), 7) AS nmse, round(sqrt(sum((x - y) * (x - y))) / count(*), 7) AS rmse FROM e GROUP BY vec_id",
    )(_errors(_kind))


@query("quant_packed_round_trip")
def quant_packed_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Largest error of each packed format after packing to bytes and back."""
    rows = vectors(spark, sf_dir)
    parts = [rows.select(F.lit(kind).alias("kind"), F.array_max(F.zip_with("a", quant.unpack(quant.pack(F.col("a"), kind), kind), lambda x, y: F.abs(x - y))).alias("e")) for kind in quant.PACKED]
    union = parts[0]
    for part in parts[1:]:
        union = union.union(part)
    return union.groupBy("kind").agg(F.round(F.max("e"), 6).alias("largest_error"))

"""Further array and matrix queries; embeddings stand in for matrices."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lyrebird.functions import vectors as V
from lyrebird.operators import tensors as X
from lyrebird.plans.catalog import query
from lyrebird.plans.tensors import E, _array
from lyrebird.plans.vectors import vectors
from lyrebird.session import table

_array("duplicate", "a", lambda a: F.transform(a, lambda v: v))
_array("subtract_arrays", "list_transform(a, lambda x, i: x - a[65 - i])", lambda a: F.zip_with(a, F.reverse(a), lambda x, y: x - y))
_array("divide_arrays", "list_transform(a, lambda x, i: x / (abs(a[65 - i]) + 1))", lambda a: F.zip_with(a, F.reverse(a), lambda x, y: x / (F.abs(y) + 1)))
_array("add_scalar", "list_transform(a, lambda x: x + 0.25)", lambda a: F.transform(a, lambda v: v + 0.25))
_array("concat_arrays", "list_concat(a[33:64], a[1:32])", lambda a: F.concat(F.slice(a, 33, 32), F.slice(a, 1, 32)))
_array("fill_array", "list_transform(a, lambda x: 1.5)", lambda a: F.array_repeat(F.lit(1.5), F.size(a)))
_array("arange", "list_transform(range(0, len(a)), lambda i: (i * 2 + 1)::DOUBLE)", lambda a: F.transform(F.sequence(F.lit(0), F.size(a) - 1), lambda i: (i * 2 + 1).cast("double")))
_array("state_conv", "list_transform(range(1, 62), lambda s: a[s] * 0.1 + a[s + 1] * 0.2 + a[s + 2] * 0.3 + a[s + 3] * 0.4)", lambda a: V.conv_1d(a, [0.1, 0.2, 0.3, 0.4], 1))
_array("rope_axes", "list_transform(a, lambda x, i: CASE WHEN (i - 1) % 3 = 1 AND i - 1 < 60 THEN x * 2 WHEN (i - 1) % 3 = 2 AND i - 1 < 60 THEN x * 3 ELSE x END)", lambda a: V.interleaved([a, F.transform(a, lambda v: v * 2), F.transform(a, lambda v: v * 3)], [24, 20, 20]))


@query("reshape", f"WITH {E} SELECT i * 8 + j // 8 AS i, (j % 8)::INT AS j, round(v, 6) AS v FROM e")
def reshape(spark: SparkSession, sf_dir: str) -> DataFrame:
    """n rows of 64 as 8n rows of 8."""
    return X.entries(vectors(spark, sf_dir), "vec_id", "a").select((F.col("i") * 8 + F.floor(F.col("j") / 8)).alias("i"), (F.col("j") % 8).alias("j"), F.round("v", 6).alias("v"))


@query("permute", f"WITH {E} SELECT (i // 8)::BIGINT AS i, (j)::BIGINT AS j, (i % 8)::BIGINT AS k, round(v, 6) AS v FROM e")
def permute(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(8 blocks, rows, columns) with the two inner axes exchanged."""
    return X.entries(vectors(spark, sf_dir), "vec_id", "a").select(F.floor(F.col("i") / 8).alias("i"), F.col("j").cast("long").alias("j"), (F.col("i") % 8).alias("k"), F.round("v", 6).alias("v"))


@query("diagonal", "SELECT vec_id, i::INT AS i, i::INT AS j, round(embedding[i + 1]::DOUBLE, 6) AS v FROM (SELECT *, unnest(range(0, 64)) AS i FROM embeddings)")
def diagonal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector as the diagonal of a matrix; entries that are zero by definition have no row."""
    return vectors(spark, sf_dir).select("vec_id", F.posexplode("a").alias("i", "v")).select("vec_id", "i", F.col("i").alias("j"), F.round("v", 6).alias("v"))


@query("diag_mask_zero", f"WITH {E} SELECT i, j::INT AS j, round(CASE WHEN j > i % 64 THEN 0 ELSE v END, 6) AS v FROM e")
def diag_mask_zero(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of 64 rows as square matrices, zero above the diagonal."""
    entries = X.entries(vectors(spark, sf_dir), "vec_id", "a")
    return entries.select("i", "j", F.round(F.when(F.col("j") > F.col("i") % 64, 0.0).otherwise(F.col("v")), 6).alias("v"))


@query("outer_product", f"WITH {E} SELECT x.j::INT AS i, y.j::INT AS j, round(sum(x.v * y.v), 5) + 0.0 AS v FROM e x JOIN e y USING (i) GROUP BY x.j, y.j")
def outer_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 64 by 64 sum of each vector's outer product with itself."""
    entries = X.entries(vectors(spark, sf_dir), "vec_id", "a")
    a = entries.select(F.col("j").alias("i"), F.col("i").alias("k"), "v")
    b = entries.select("j", F.col("i").alias("k"), F.col("v").alias("w"))
    return X.outer(a, b).select("i", "j", (F.round("v", 5) + 0.0).alias("v"))


EXPERTS = "x AS (SELECT label, unnest(range(0, 64)) AS d, unnest(embedding)::DOUBLE AS v FROM embeddings), m AS (SELECT label, d, avg(v) AS w FROM x GROUP BY ALL)"


@query("expert_matmul", f"WITH {E}, {EXPERTS}, o(o, s) AS (VALUES (0, 1.0), (1, 2.0)) SELECT e.i, o.o AS j, round(sum(e.v * m.w * o.s), 5) + 0.0 AS v FROM e JOIN embeddings t ON t.vec_id = e.i JOIN m ON m.label = t.label AND m.d = e.j, o GROUP BY e.i, o.o")
def expert_matmul(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows are routed to the expert of their label; an expert's matrix is its mean vector, and twice that."""
    rows = vectors(spark, sf_dir).select(F.col("vec_id").alias("i"), "label", "a")
    means = rows.select("label", F.posexplode("a").alias("d", "v")).groupBy("label", "d").agg(F.avg("v").alias("v"))
    one = means.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("d", "v"))).alias("w"))  # 64 entries
    experts = one.select("label", F.explode(F.array(*[F.struct(F.lit(j).alias("j"), F.transform("w", lambda e: e["v"]).alias("w")) for j in (0, 1)])).alias("m"))
    scaled = experts.select("label", "m.j", F.transform("m.w", lambda v: v * (F.col("m.j") + 1)).alias("w"))
    return X.routed(rows, scaled, "label").select("i", "j", (F.round("v", 5) + 0.0).alias("v"))


@query("expert_bias", "SELECT vec_id, round(embedding[1]::DOUBLE + label * 0.5, 6) AS v FROM embeddings")
def expert_bias(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The row of a bias table that an id names is added."""
    rows = vectors(spark, sf_dir)
    biases = rows.select("label").distinct().select("label", (F.col("label") * 0.5).alias("bias"))
    return rows.join(biases, "label").select("vec_id", F.round(F.col("a")[0] + F.col("bias"), 6).alias("v"))


KERNEL = "k(p, q, w) AS (VALUES (0, 0, 1.0), (0, 1, -1.0), (1, 0, 0.5), (1, 1, 0.25))"
TAPS = [[1.0, -1.0], [0.5, 0.25]]


@query("conv_2d", f"WITH {E}, {KERNEL} SELECT (i - p)::BIGINT AS i, (j - q)::BIGINT AS j, round(sum(v * w), 6) + 0.0 AS v FROM e, k WHERE i - p >= 0 AND j - q >= 0 AND i - p + 1 <= (SELECT max(vec_id) FROM embeddings) AND j - q + 1 <= 63 GROUP BY ALL")
def conv_2d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.conv_2d(X.entries(vectors(spark, sf_dir), "vec_id", "a"), TAPS).select("i", "j", (F.round("v", 6) + 0.0).alias("v"))


@query("conv_transpose_2d", f"WITH {E}, {KERNEL} SELECT i * 2 + p AS i, (j * 2 + q)::INT AS j, round(sum(v * w), 6) + 0.0 AS v FROM e, k GROUP BY ALL")
def conv_transpose_2d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.conv_transpose_2d(X.entries(vectors(spark, sf_dir), "vec_id", "a"), TAPS, 2).select("i", "j", (F.round("v", 6) + 0.0).alias("v"))


@query("conv_depthwise", f"WITH {E}, {KERNEL}, c AS (SELECT i % 4 AS ch, i // 4 AS y, j AS x, v FROM e), m AS (SELECT ch, max(y) AS h FROM c GROUP BY ch) SELECT c.ch, (y - p)::BIGINT AS i, (x - q)::BIGINT AS j, round(sum(v * w * (c.ch + 1)), 6) + 0.0 AS v FROM c JOIN m USING (ch), k WHERE y - p >= 0 AND x - q >= 0 AND y - p + 1 <= h AND x - q + 1 <= 63 GROUP BY ALL")
def conv_depthwise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four channels, vec_id % 4, each with a kernel of its own: the shared one times channel + 1."""
    entries = X.entries(vectors(spark, sf_dir), "vec_id", "a")
    out = None
    for ch in range(4):
        own = entries.where(F.col("i") % 4 == ch).withColumn("i", F.floor(F.col("i") / 4))
        part = X.conv_2d(own, [[w * (ch + 1) for w in row] for row in TAPS]).select(F.lit(ch).cast("long").alias("ch"), "i", "j", (F.round("v", 6) + 0.0).alias("v"))
        out = part if out is None else out.union(part)
    return out


@query("window_parts", f"WITH {E} SELECT (i // 8)::BIGINT AS wi, (j // 8)::BIGINT AS wj, (i % 8)::BIGINT AS i, (j % 8)::INT AS j, round(v, 6) AS v FROM e")
def window_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.window_parts(X.entries(vectors(spark, sf_dir), "vec_id", "a"), 8).select("wi", "wj", "i", "j", F.round("v", 6).alias("v"))


@query("window_whole", f"WITH {E} SELECT i, j::BIGINT AS j, round(v, 6) AS v FROM e")
def window_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts put together again."""
    return X.window_whole(X.window_parts(X.entries(vectors(spark, sf_dir), "vec_id", "a"), 8), 8).select("i", "j", F.round("v", 6).alias("v"))


@query("relative_positions", f"WITH {E} SELECT i % 64 AS i, j::INT AS j, i AS id, round(v + (i % 64 - j + 63) * 0.01, 6) AS v FROM e")
def relative_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table by distance is added to square blocks of scores."""
    entries = X.entries(vectors(spark, sf_dir), "vec_id", "a").select(F.col("i").alias("id"), (F.col("i") % 64).alias("i"), "j", "v")
    distances = spark.range(127).select(F.col("id").alias("d"), (F.col("id") * 0.01).alias("w"))
    joined = entries.withColumn("d", F.col("i") - F.col("j") + 63).join(F.broadcast(distances), "d")  # 127 rows
    return joined.select("i", "j", "id", F.round(F.col("v") + F.col("w"), 6).alias("v"))


@query("solve_triangular", "WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS a FROM embeddings), x AS (SELECT vec_id, a, a[1] / 2 AS x1 FROM e), y AS (SELECT *, (a[2] - 0.5 * x1) / 2 AS x2 FROM x), z AS (SELECT *, (a[3] - 0.25 * x1 - 0.5 * x2) / 2 AS x3 FROM y) SELECT vec_id, round(x1, 6) AS x1, round(x2, 6) AS x2, round(x3, 6) AS x3 FROM z")
def solve_triangular(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector's first three values as the right side of a lower triangular system."""
    matrix = F.array(*[F.array(*map(F.lit, row)) for row in ([2.0, 0.0, 0.0], [0.5, 2.0, 0.0], [0.25, 0.5, 2.0])])
    x = vectors(spark, sf_dir).select("vec_id", V.solve_lower(matrix, F.slice("a", 1, 3)).alias("x"))
    return x.select("vec_id", *[F.round(F.col("x")[i], 6).alias(f"x{i + 1}") for i in range(3)])


@query("placeholder_scatter", "WITH w AS (SELECT l_orderkey, l_linenumber, l_suppkey % 3 = 0 AS hole, l_quantity AS v FROM lineitem), r AS (SELECT *, CASE WHEN hole THEN sum(hole::INT) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) END AS k FROM w) SELECT l_orderkey, l_linenumber, hole, CASE WHEN hole THEN l_orderkey % 7 + k / 10.0 ELSE v END::DOUBLE AS v FROM r")
def placeholder_scatter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The k-th placeholder of a sequence takes the k-th feature of its sequence; the other tokens keep their values."""
    from pyspark.sql import Window

    tokens = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_suppkey") % 3 == 0).alias("hole"), F.col("l_quantity").alias("v"))
    k = F.when(F.col("hole"), F.sum(F.col("hole").cast("int")).over(Window.partitionBy("l_orderkey").orderBy("l_linenumber")))
    # a sequence has as many features as placeholders, however many there are
    holes = tokens.where("hole").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("holes"))
    features = holes.select("l_orderkey", F.explode(F.sequence(F.lit(1).cast("long"), F.col("holes"))).alias("k")).withColumn("feature", F.col("l_orderkey") % 7 + F.col("k") / 10.0)
    return tokens.withColumn("k", k).join(features, ["l_orderkey", "k"], "left").select("l_orderkey", "l_linenumber", "hole", F.when(F.col("hole"), F.col("feature")).otherwise(F.col("v")).cast("double").alias("v"))


@query("block_shapes", "SELECT p_partkey, (p_size * 32 // 32 * 18)::BIGINT AS q4_bytes, (p_size * 32 // 32 * 34)::BIGINT AS q8_bytes, (p_size * 32)::BIGINT AS back FROM part")
def block_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of a row of block-quantised values, and the values of a row of bytes: 32 values in 18 or 34 bytes."""
    sizes = {"q4": 18, "q8": 34}
    n = F.col("p_size") * 32
    in_bytes = {k: (F.floor(n / 32) * size).alias(f"{k}_bytes") for k, size in sizes.items()}
    rows = table(spark, sf_dir, "part").select("p_partkey", *in_bytes.values())
    return rows.withColumn("back", F.floor(F.col("q4_bytes") / sizes["q4"]) * 32)

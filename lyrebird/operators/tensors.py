"""Tensor operators in relational form: a matrix is rows (i, j, v), a product is a join and a sum."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def entries(rows: DataFrame, row: str, a: str) -> DataFrame:
    """Rows of arrays as entries (i, j, v)."""
    return rows.select(F.col(row).alias("i"), F.posexplode(a).alias("j", "v"))


def matmul(a: DataFrame, b: DataFrame) -> DataFrame:
    """Entries of a @ b: joined on the inner index, summed by the outer ones."""
    right = b.select(F.col("i").alias("k"), F.col("j").alias("n"), F.col("v").alias("w"))
    left = a.select("i", F.col("j").cast("long").alias("k"), "v")
    return left.join(right, "k").groupBy("i", "n").agg(F.sum(F.col("v") * F.col("w")).alias("v")).select("i", F.col("n").alias("j"), "v")


def transpose(a: DataFrame) -> DataFrame:
    return a.select(F.col("j").alias("i"), F.col("i").alias("j"), "v")


def masked_softmax(scores: DataFrame, keep: Column) -> DataFrame:
    """Softmax of each row over the entries that the mask keeps; the others are 0."""
    by = Window.partitionBy("i")
    seen = F.when(keep, F.col("v"))
    weight = F.coalesce(F.exp(F.col("s") - F.max("s").over(by)), F.lit(0.0))
    return scores.withColumn("s", seen).withColumn("w", weight).withColumn("v", F.col("w") / F.sum("w").over(by)).select("i", "j", "v")


def sequence_weights(rows: DataFrame, scale: float) -> DataFrame:
    """(i, j, v): causal attention weights of the positions (seq, pos, a) of bounded sequences, each position with those up to it."""
    before = rows.select("seq", F.col("pos").alias("j"), F.col("a").alias("b"))
    product = F.aggregate(F.zip_with("a", "b", lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)
    scores = rows.join(before, "seq").where("j <= pos").select(F.col("pos").alias("i"), "j", (product * scale).alias("v"))
    return masked_softmax(scores, F.lit(True))


def attention(q: DataFrame, k: DataFrame, v: DataFrame, scale: float, keep: Column) -> DataFrame:
    """softmax(scale * q k^T, masked) v, all as entries."""
    scores = matmul(q, transpose(k)).withColumn("v", F.col("v") * scale)
    return matmul(masked_softmax(scores, keep), v)


def gather(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows by id, as often as asked; ids (pos, key)."""
    return ids.join(rows, key)


def scatter_add(values: DataFrame, key: str, value: str) -> DataFrame:
    return values.groupBy(key).agg(F.sum(value).alias(value))


def set_rows(rows: DataFrame, changes: DataFrame, key: str, value: str) -> DataFrame:
    """rows with the values of changes where there are any."""
    new = changes.select(key, F.col(value).alias("_new"))
    return rows.join(new, key, "left").withColumn(value, F.coalesce("_new", value)).drop("_new")


def repeat_back(a: DataFrame, n: int) -> DataFrame:
    """Sums the repeats of n columns."""
    return a.groupBy("i", F.pmod("j", F.lit(n)).alias("j")).agg(F.sum("v").alias("v"))


def pool_2d(a: DataFrame, height: int, width: int, how: str = "max") -> DataFrame:
    fold = F.max("v") if how == "max" else F.avg("v")
    return a.groupBy(F.floor(F.col("i") / height).alias("i"), F.floor(F.col("j") / width).alias("j")).agg(fold.alias("v"))


def conv_transpose(a: DataFrame, kernel: list[float], stride: int) -> DataFrame:
    """Each entry spreads over the kernel's places; what meets is added."""
    taps = F.array(*map(F.lit, kernel))
    spread = a.select("i", "j", "v", F.posexplode(taps).alias("k", "w"))
    return spread.groupBy("i", (F.col("j") * stride + F.col("k")).alias("j")).agg(F.sum(F.col("v") * F.col("w")).alias("v"))


def triangle(a: DataFrame, lower: bool = True) -> DataFrame:
    inside = F.col("j") <= F.col("i") if lower else F.col("j") >= F.col("i")
    return a.withColumn("v", F.when(inside, F.col("v")).otherwise(0.0))


def cross_entropy(logits: DataFrame, target: Column) -> DataFrame:
    """Mean over rows of -sum(target * log_softmax)."""
    by = Window.partitionBy("i")
    shifted = logits.withColumn("s", F.col("v") - F.max("v").over(by)).withColumn("lp", F.col("s") - F.log(F.sum(F.exp("s")).over(by)))
    return shifted.groupBy("i").agg((-F.sum(target * F.col("lp"))).alias("loss")).agg(F.avg("loss").alias("loss"))


def block_mask(lengths: DataFrame, n: str = "n") -> DataFrame:
    """(pos, segment) of positions dealt to consecutive segments of these lengths; equal segments see each other."""
    return lengths.select(F.col("segment"), F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1)).alias("k"), F.col("start")).select((F.col("start") + F.col("k")).alias("pos"), "segment")


def outer(a: DataFrame, b: DataFrame) -> DataFrame:
    """Entries of a b^T summed over the columns both share: a (i, k, v), b (j, k, w)."""
    return a.join(b, "k").groupBy("i", "j").agg(F.sum(F.col("v") * F.col("w")).alias("v"))


def routed(rows: DataFrame, experts: DataFrame, expert: str) -> DataFrame:
    """Each row's vector times the matrix of its expert: rows (i, expert, a), experts (expert, j, w) with w an array."""
    product = F.aggregate(F.zip_with("a", "w", lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)
    return rows.join(experts, expert).select("i", "j", product.alias("v"))


def conv_2d(a: DataFrame, kernel: list[list[float]], stride: int = 1) -> DataFrame:
    """Entries of a valid 2-D convolution: each entry goes to the places whose window holds it."""
    taps = F.explode(F.array(*[F.struct(F.lit(p).alias("p"), F.lit(q).alias("q"), F.lit(w).alias("w")) for p, row in enumerate(kernel) for q, w in enumerate(row)]))
    ends = a.agg(F.max("i").alias("h"), F.max("j").alias("w_"))  # one row
    spread = a.select("i", "j", "v", taps.alias("t")).select((F.col("i") - F.col("t.p")).alias("y"), (F.col("j") - F.col("t.q")).alias("x"), (F.col("v") * F.col("t.w")).alias("v"))
    inside = spread.crossJoin(F.broadcast(ends)).where((F.col("y") >= 0) & (F.col("x") >= 0) & (F.col("y") + len(kernel) - 1 <= F.col("h")) & (F.col("x") + len(kernel[0]) - 1 <= F.col("w_")) & (F.col("y") % stride == 0) & (F.col("x") % stride == 0))
    return inside.groupBy(F.floor(F.col("y") / stride).alias("i"), F.floor(F.col("x") / stride).alias("j")).agg(F.sum("v").alias("v"))


def conv_transpose_2d(a: DataFrame, kernel: list[list[float]], stride: int) -> DataFrame:
    taps = F.explode(F.array(*[F.struct(F.lit(p).alias("p"), F.lit(q).alias("q"), F.lit(w).alias("w")) for p, row in enumerate(kernel) for q, w in enumerate(row)]))
    spread = a.select("i", "j", "v", taps.alias("t"))
    return spread.groupBy((F.col("i") * stride + F.col("t.p")).alias("i"), (F.col("j") * stride + F.col("t.q")).alias("j")).agg(F.sum(F.col("v") * F.col("t.w")).alias("v"))


def window_parts(a: DataFrame, size: int) -> DataFrame:
    """Entries with the window (wi, wj) they fall in and their place there."""
    return a.select(F.floor(F.col("i") / size).alias("wi"), F.floor(F.col("j") / size).alias("wj"), F.pmod("i", F.lit(size)).alias("i"), F.pmod("j", F.lit(size)).alias("j"), "v")


def window_whole(parts: DataFrame, size: int) -> DataFrame:
    """Undoes `window_parts`."""
    return parts.select((F.col("wi") * size + F.col("i")).alias("i"), (F.col("wj") * size + F.col("j")).alias("j"), "v")


def with_relative_positions(scores: DataFrame, table: DataFrame, n: int) -> DataFrame:
    """Scores (i, j, v) plus the entry of the table (d, w) for the distance i - j + n - 1."""
    return scores.withColumn("d", F.col("i") - F.col("j") + n - 1).join(table, "d").select("i", "j", (F.col("v") + F.col("w")).alias("v"))

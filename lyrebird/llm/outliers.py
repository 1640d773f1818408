"""Quality rules: robust multivariate outliers for each language and source.

Every text becomes a vector of transformed statistics. For each language and source the minimum-
covariance-determinant estimate gives a centre and a scatter. Concentration steps keep the share SHARE
of the documents that lie nearest by Mahalanobis distance and take their mean and covariance. They run
from STARTS starts, the medians and seeded subsets of SUBSET documents; after FIRST_STEPS the
KEPT_TRIALS with the lowest determinants go on until nothing moves, and the lowest of these is taken
and reweighted: mean and covariance of all documents within its chi-square quantile WITHIN. Covariances
are made consistent for normal data, and FLOOR, the least spread that counts as one, is added to each
coordinate, so a statistic that is zero almost everywhere can't reject by itself for a trifle.
Documents farther than the chi-square quantile at 1 - TAIL are rejected.

All documents that pass the base rules take part in each step, equal vectors as one row with a weight.
A step counts the distances in fine bins, which gives each start the bin where its nearest share ends,
and then sums the vectors up to there. So a hot source is counted and summed where it lies, a task
holds a count for each bin and sums for each start only, and no more than a group's bins meet in one task. Groups with fewer than LEAST documents are estimated together with such groups of their
language, and languages with fewer, together; where even these are fewer, nothing is rejected.

Null texts have no words and fail the base rules; very long ones are counted whole, in one row. Null languages and sources are values like others.
Rows are kept one for one; columns named like an output are replaced. Empty tables give no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lyrebird.llm.common import apart, cut, named_back, read, small_batches
from lyrebird.llm.substrings import BASE_1, Batch, _Hashes, rolled

SYMBOLS = b"#*$%&|<>"
WHITE = b" \t\n\x0b\x0c\r"
LEAST_WORDS = 50
SHARE = 0.75
#: Starts of each group: the medians, and subsets of about so many rows; steps of all starts, how many are kept then, their steps at most.
STARTS, SUBSET = 8, 30
FIRST_STEPS, KEPT_TRIALS, STEPS = 2, 2, 8
#: Chi-square quantile within which rows make the reweighted estimate.
WITHIN = 0.975
TAIL = 1e-8
LEAST = 60
#: Least spread of each coordinate, on the transformed scale. Where a source has neither repeated lines nor repeated
#: words, 40% of both are rejected, and so are texts of nothing but repeated lines; one line in four said twice is not.
FLOOR = (0.5, 0.05, 0.35, 0.67, 0.85)
P = len(FLOOR)
#: Bins of log2(1 + squared distance), and of a coordinate, per unit.
BINS, FINE = 64, 256
#: Groups up to which their estimates are broadcast.
BROADCAST_GROUPS = 20_000
STATISTICS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"]
CONTINUATION = bytes(range(0x80, 0xC0))


def _repeated_lines(text: bytes) -> tuple[int, int]:
    """Lines with a word, and those equal to an earlier one."""
    lines = text.split(b"\n")
    if len(lines) > 1:
        lines = [x for x in lines if x.strip()]  # of bytes, so ASCII white space only
        return len(lines), len(lines) - len(set(lines))
    return int(bool(text.strip())), 0


def count_statistics(texts: list[bytes | None], hashes: _Hashes) -> dict[str, np.ndarray]:
    """STATISTICS of some texts."""
    words = Batch(texts, hashes)
    three = np.flatnonzero(words.left >= 3)
    repeated = np.zeros(len(texts), dtype=np.int64)
    if len(three):
        key = rolled(words.hashes, 3, BASE_1)[three] ^ (words.row[three].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        _, which, times = np.unique(key, return_inverse=True, return_counts=True)
        again = three[times[which] > 1]
        edge = np.zeros(len(words.hashes) + 1, dtype=np.int32)
        np.add.at(edge, again, 1)
        np.add.at(edge, again + 3, -1)
        repeated = np.bincount(words.row[np.cumsum(edge[:-1]) > 0], minlength=len(texts))
    given = [t or b"" for t in texts]
    lines = np.array([_repeated_lines(t) for t in given], dtype=np.int64).reshape(-1, 2)
    return {
        "n_words": words.lengths,
        "word_chars": np.array([len(t.translate(None, WHITE + CONTINUATION)) for t in given], dtype=np.int64),
        "n_symbols": np.array([len(t) - len(t.translate(None, SYMBOLS)) for t in given], dtype=np.int64),
        "n_dup_lines": lines[:, 1],
        "n_repeat_words": repeated.astype(np.int64),
        "n_lines": lines[:, 0],
    }


def statistics(docs: DataFrame) -> DataFrame:
    """docs plus STATISTICS, base_failed, `grp` (language and source) and `vector`."""
    outputs = [*STATISTICS, "base_failed", "grp", "vector", "_s"]

    @F.pandas_udf(", ".join(f"{s} long" for s in STATISTICS))
    def _statistics(text: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(count_statistics([None if t is None else t.encode() for t in text], _Hashes()))

    counted = small_batches(docs).select(*[F.col(f"`{c}`") for c in docs.columns if c not in outputs]).withColumn("_s", _statistics(F.col("text").cast("string")))
    counted = counted.select("*", *[F.coalesce(F.col(f"_s.{s}"), F.lit(0)).cast("long").alias(s) for s in STATISTICS]).drop("_s")
    n = F.greatest(F.col("n_words"), F.lit(1))
    vector = F.array(
        F.log1p("n_words"),
        F.log(F.greatest(F.col("word_chars"), F.lit(1)) / n),
        F.log1p(100 * F.col("n_symbols") / n),
        F.log1p(100 * F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1))),
        F.log1p(100 * F.col("n_repeat_words") / n),
    )
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return counted.withColumns({"base_failed": failed, "grp": F.to_json(F.struct("lang", "source")), "vector": vector})


def chi_square(x: float, k: float) -> float:
    """The distribution function with k degrees of freedom, by the series of the incomplete gamma function."""
    a, x = k / 2, x / 2
    term = total = 1 / a
    n = a
    while term > total * 1e-17:
        n += 1
        term *= x / n
        total += term
    return min(1.0, total * math.exp(a * math.log(x) - x - math.lgamma(a))) if x > 0 else 0.0


def chi_square_quantile(p: float, k: float) -> float:
    low, high = 0.0, 200.0 + 10 * k
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if chi_square(middle, k) < p else (low, middle)
    return (low + high) / 2


def consistency(share: float) -> float:
    """By how much the covariance of the nearest share falls short for normal data."""
    return share / chi_square(chi_square_quantile(share, P), P + 2)


def squared_distance(vector: Column, centre: Column, inverse: Column) -> Column:
    z = [vector[i] - centre[i] for i in range(P)]
    total = F.lit(0.0)
    for i in range(P):
        for j in range(i, P):
            total = total + z[i] * z[j] * inverse[P * i + j] * (1 if i == j else 2)
    return total


def groups_of(stats: DataFrame) -> DataFrame:
    """grp to `fit`, the group with which it is estimated, null where there are too few documents."""
    sizes = cut(stats.where(~F.col("base_failed")).groupBy("grp", F.to_json(F.struct("lang")).alias("lang")).agg(F.count(F.lit(1)).alias("n")))
    small = sizes.where(F.col("n") < LEAST)
    pools = small.groupBy("lang").agg(F.sum("n").alias("pool"))
    rest = pools.where(F.col("pool") < LEAST).agg(F.coalesce(F.sum("pool"), F.lit(0)).alias("rest"))
    fit = F.when(F.col("n") >= LEAST, F.col("grp")).when(F.col("pool") >= LEAST, F.concat(F.lit("lang "), F.col("lang"))).when(F.col("rest") >= LEAST, F.lit("rest"))
    return cut(sizes.join(pools, "lang", "left").crossJoin(F.broadcast(rest)).select("grp", fit.alias("fit")))


def bounded(table: DataFrame) -> DataFrame:
    """A table of a row for each group, broadcast where there are few groups."""
    return F.broadcast(table) if table.count() <= BROADCAST_GROUPS else table


MODEL = "fit string, trial int, centre array<double>, inverse array<double>, log_det double"
PAIRS = [(i, j) for i in range(P) for j in range(i, P)]
SUMS = [*[f"s{i}" for i in range(P)], *[f"m{i}_{j}" for i, j in PAIRS]]


def sums_of(vector: Column, weight: Column) -> list[Column]:
    x = [vector[i] for i in range(P)]
    return [F.sum(weight).cast("double").alias("n"), *[F.sum(weight * v).alias(f"s{i}") for i, v in enumerate(x)], *[F.sum(weight * x[i] * x[j]).alias(f"m{i}_{j}") for i, j in PAIRS]]


def estimated(moments: DataFrame) -> DataFrame:
    """MODEL from sums of rows (fit, trial, share, n, SUMS); share: that of a group's rows in the sums, for which the scatter is corrected."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            centres, inverses, log_dets = [], [], []
            for row in batch.to_pylist():
                n = row["n"]
                mean = np.array([row[f"s{i}"] for i in range(P)]) / n
                scatter = np.zeros((P, P))
                for i, j in PAIRS:
                    scatter[i, j] = scatter[j, i] = row[f"m{i}_{j}"] / n - mean[i] * mean[j]
                scatter = scatter * consistency(min(row["share"], 0.999)) + np.diag(np.square(FLOOR))
                centres.append(mean.tolist())
                inverses.append(np.linalg.inv(scatter).ravel().tolist())
                log_dets.append(float(np.linalg.slogdet(scatter)[1]))
            lists = [pa.array(x, pa.list_(pa.float64())) for x in (centres, inverses)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *lists, pa.array(log_dets, pa.float64())], ["fit", "trial", "centre", "inverse", "log_det"])

    return moments.select("fit", "trial", "share", "n", *SUMS).mapInArrow(run, MODEL)


def median_start(rows: DataFrame) -> DataFrame:
    """MODEL, trial 0, from medians and quartile ranges, found in fine bins of each coordinate."""
    bins = rows.select("fit", "weight", F.posexplode("vector").alias("j", "x")).groupBy("fit", "j", F.floor(F.col("x") * FINE).alias("bin")).agg(F.sum("weight").alias("n"))
    upto = Window.partitionBy("fit", "j").orderBy("bin")
    share = F.sum("n").over(upto) / F.sum("n").over(Window.partitionBy("fit", "j"))
    at = bins.withColumn("share", share).groupBy("fit", "j").agg(*[F.min(F.when(F.col("share") >= q, F.col("bin"))).alias(name) for name, q in (("low", 0.25), ("mid", 0.5), ("high", 0.75))])
    floors = F.array(*map(F.lit, FLOOR))
    spread = F.pow((F.col("high") - F.col("low")) / FINE / 1.349, 2) + F.pow(F.element_at(floors, F.col("j") + 1), 2)
    ordered = at.groupBy("fit").agg(F.sort_array(F.collect_list(F.struct("j", ((F.col("mid") + 0.5) / FINE).alias("centre"), (1 / spread).alias("weight")))).alias("c"))  # P entries
    diagonal = F.flatten(F.transform("c", lambda x, i: F.transform(F.sequence(F.lit(0), F.lit(P - 1)), lambda j: F.when(i == j, x["weight"]).otherwise(0.0))))
    return ordered.select("fit", F.lit(0).alias("trial"), F.col("c.centre").alias("centre"), diagonal.alias("inverse"), F.lit(0.0).alias("log_det"))


def subset_starts(rows: DataFrame) -> DataFrame:
    """MODEL, trials from 1, of about SUBSET rows of each group, picked by a hash of vector and trial."""
    sizes = cut(rows.groupBy("fit").agg(F.sum("weight").alias("size")))
    trials = F.filter(F.sequence(F.lit(1), F.lit(STARTS - 1)), lambda t: F.pmod(F.xxhash64("vector", t), F.col("size")) < SUBSET)
    picked = rows.join(bounded(sizes), "fit").select("fit", "vector", "weight", F.explode(trials).alias("trial"))
    return estimated(picked.groupBy("fit", "trial").agg(*sums_of(F.col("vector"), F.col("weight"))).withColumn("share", F.lit(1.0)))


def with_distance(rows: DataFrame, model: DataFrame) -> DataFrame:
    """The rows under each trial of their group, with their distance and other columns of the model."""
    distance = squared_distance(F.col("vector"), F.col("centre"), F.col("inverse"))
    return rows.join(bounded(model), "fit").withColumn("distance", F.greatest(distance, F.lit(0.0))).drop("centre", "inverse", "log_det")


def last_bins(rows: DataFrame, model: DataFrame) -> DataFrame:
    """model plus `last`, the bin of distances in which the nearest SHARE of a group's rows ends, and `share`, that of the rows up to its end."""
    bins = with_distance(rows, model).groupBy("fit", "trial", bin_of("distance").alias("bin")).agg(F.sum("weight").alias("n"))
    own = Window.partitionBy("fit", "trial")
    upto = F.sum("n").over(own.orderBy("bin")) / F.sum("n").over(own)
    ends = bins.withColumn("upto", upto).where(F.col("upto") >= SHARE).groupBy("fit", "trial").agg(F.min(F.struct(F.col("bin").alias("last"), F.col("upto").alias("share"))).alias("end"))
    return model.join(ends.select("fit", "trial", "end.last", "end.share"), ["fit", "trial"])


def bin_of(distance: str) -> Column:
    return F.floor(F.log2(1 + F.col(distance)) * BINS)


def concentrated(rows: DataFrame, model: DataFrame) -> DataFrame:
    """MODEL of the nearest SHARE of each group's rows under each of its trials: one concentration step."""
    near = with_distance(rows, cut(last_bins(rows, model))).where(bin_of("distance") <= F.col("last"))
    return estimated(near.groupBy("fit", "trial", "share").agg(*sums_of(F.col("vector"), F.col("weight"))))


def lowest(model: DataFrame, trials: int) -> DataFrame:
    """Of each group the trials with the lowest determinants."""
    order = Window.partitionBy("fit").orderBy("log_det", "trial")
    return model.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= trials).drop("rank")


def reweighted(rows: DataFrame, model: DataFrame) -> DataFrame:
    """MODEL of the rows within the chi-square quantile WITHIN of a model."""
    near = with_distance(rows, model).where(F.col("distance") <= chi_square_quantile(WITHIN, P))
    return estimated(near.groupBy("fit", "trial").agg(*sums_of(F.col("vector"), F.col("weight"))).withColumn("share", F.lit(WITHIN)))


def weighted(rows: DataFrame) -> DataFrame:
    """The different vectors of each group with `weight`, how many rows have them; copies are added up before the shuffle."""
    return rows.groupBy("fit", "vector").agg(F.count(F.lit(1)).alias("weight"))


def fit(stats: DataFrame, groups: DataFrame) -> DataFrame:
    """MODEL of each group of documents that pass the base rules."""
    rows = cut(weighted(stats.where(~F.col("base_failed")).join(bounded(groups), "grp").where("fit is not null").select("fit", "vector")))
    model = cut(median_start(rows).union(subset_starts(rows)))
    for _ in range(FIRST_STEPS):
        model = cut(concentrated(rows, model))
    model = cut(lowest(model, KEPT_TRIALS))
    for _ in range(STEPS):
        new = cut(concentrated(rows, model))
        gap = F.aggregate(F.zip_with("centre", "was", lambda a, b: F.abs(a - b)), F.lit(0.0), lambda s, v: F.greatest(s, v))
        moved = new.join(model.select("fit", "trial", F.col("centre").alias("was")), ["fit", "trial"]).agg(F.max(gap).alias("gap")).first().gap
        model = new
        if moved is None or moved < 1e-6:
            break
    return cut(reweighted(rows, cut(lowest(model, 1))))


def verdicts(stats: DataFrame, groups: DataFrame, model: DataFrame) -> DataFrame:
    """stats plus distance2 (null where nothing is estimated) and kept."""
    limit = chi_square_quantile(1 - TAIL, P)
    known = cut(groups.join(model, "fit", "left").select(F.col("grp").alias("_grp"), "centre", "inverse"))
    judged = stats.join(bounded(known), F.col("grp") == F.col("_grp"), "left").withColumn("distance2", squared_distance(F.col("vector"), F.col("centre"), F.col("inverse")))
    kept = ~F.col("base_failed") & (F.coalesce(F.col("distance2"), F.lit(0.0)) <= limit)
    return judged.withColumn("kept", kept).drop("_grp", "centre", "inverse")


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of docs that the rules keep, with their own columns."""
    stats = cut(statistics(docs.select("text", "lang", "source")).select("grp", "lang", "base_failed", "vector"))
    groups = groups_of(stats)
    model = fit(stats, groups)
    own, names = apart(docs, "text", "lang", "source")
    return named_back(verdicts(statistics(own), groups, model).where("kept"), names)


def op2_quality_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = cut(statistics(read(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")).drop("text"))
    groups = groups_of(stats)
    judged = verdicts(stats, groups, fit(stats, groups))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("distance2", 6).alias("distance2"))

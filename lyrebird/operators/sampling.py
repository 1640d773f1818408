"""Sampling and ranking filters over candidate rows: a step (`key`), a token (`tok`) and its logit (`x`).

Every operator takes and returns such rows, so a chain is a row of `DataFrame.transform` calls. All
work by windows over one step, whose candidates are a vocabulary at most; ties go to the smaller token.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, MapType

KEY, TOK, X = "vec_id", "tok", "x"


def _step() -> Window:
    return Window.partitionBy(KEY)


def _by_logit() -> Window:
    return _step().orderBy(F.desc(X), TOK)


def softmax(rows: DataFrame) -> DataFrame:
    """Adds p, the probability of each candidate within its step."""
    weight = F.exp(F.col(X) - F.max(X).over(_step()))
    return rows.withColumn("w", weight).withColumn("p", F.col("w") / F.sum("w").over(_step())).drop("w")


def temperature(rows: DataFrame, t: float) -> DataFrame:
    """Divides logits by t; at 0 or less only the best candidate keeps its logit."""
    if t > 0:
        return rows.withColumn(X, F.col(X) / t)
    first = F.row_number().over(_by_logit()) == 1
    return rows.withColumn(X, F.when(first, F.col(X)).otherwise(F.lit(float("-inf"))))


def temperature_by_entropy(rows: DataFrame, t: float, delta: float, exponent: float) -> DataFrame:
    """Temperature between t - delta and t + delta, by the normalised entropy of the step."""
    if delta <= 0:
        return temperature(rows, t)
    low, high = max(0.0, t - delta), t + delta
    n = F.count(F.lit(1)).over(_step())
    entropy = -F.sum(F.col("p") * F.log("p")).over(_step())
    own = low + (high - low) * F.pow(entropy / F.log(n), exponent)
    return softmax(rows).withColumn(X, F.when(n > 1, F.col(X) / own).otherwise(F.col(X))).drop("p")


def top_k(rows: DataFrame, k: int) -> DataFrame:
    """The k best candidates of each step; all for k of 0 or less."""
    if k <= 0:
        return rows
    return rows.withColumn("rn", F.row_number().over(_by_logit())).where(F.col("rn") <= k).drop("rn")


def top_p(rows: DataFrame, p: float, min_keep: int = 1) -> DataFrame:
    """The fewest best candidates whose probabilities reach p."""
    if p >= 1:
        return rows
    order = _step().orderBy(F.desc("p"), TOK)
    before = F.sum("p").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("p")
    ranked = softmax(rows).withColumns({"before": before, "rn": F.row_number().over(order)})
    return ranked.where((F.col("before") < p) | (F.col("rn") <= max(min_keep, 1))).drop("before", "rn", "p")


def min_p(rows: DataFrame, p: float, min_keep: int = 1) -> DataFrame:
    """Candidates at least p times as probable as the best."""
    if p <= 0:
        return rows
    ranked = rows.withColumns({"best": F.max(X).over(_step()), "rn": F.row_number().over(_by_logit())})
    return ranked.where((F.col(X) >= F.col("best") + F.log(F.lit(p))) | (F.col("rn") <= max(min_keep, 1))).drop("best", "rn")


def typical(rows: DataFrame, p: float) -> DataFrame:
    """Candidates whose surprise lies nearest to the entropy, until their probabilities exceed p."""
    if p >= 1:
        return rows
    entropy = -F.sum(F.col("p") * F.log("p")).over(_step())
    shifted = softmax(rows).withColumn("entropy", entropy).withColumn("gap", F.round(F.abs(-F.log("p") - F.col("entropy")), 9))
    order = _step().orderBy("gap", TOK)
    upto = F.sum("p").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("p")
    return shifted.withColumns({"before": upto, "rn": F.row_number().over(order)}).where((F.round("before", 9) <= p) | (F.col("rn") == 1)).drop("before", "rn", "p", "gap", "entropy")


def top_n_sigma(rows: DataFrame, n: float) -> DataFrame:
    """Candidates within n population deviations of the best logit."""
    if n <= 0:
        return rows
    spread = rows.withColumns({"best": F.max(X).over(_step()), "sigma": F.stddev_pop(X).over(_step())})
    return spread.where(F.col(X) >= F.col("best") - n * F.col("sigma")).drop("best", "sigma")


def xtc(rows: DataFrame, threshold: float, probability: float, draw: Column) -> DataFrame:
    """Drops all candidates at or above the threshold but the least of them, where draw is below probability."""
    order = _step().orderBy(F.desc("p"), TOK)
    ranked = softmax(rows).withColumns({"rn": F.row_number().over(order), "above": F.sum((F.col("p") >= threshold).cast("int")).over(_step()), "draw": draw})
    return ranked.where((F.col("draw") >= probability) | (F.col("above") < 2) | (F.col("rn") >= F.col("above"))).drop("rn", "above", "draw", "p")


def penalties(rows: DataFrame, history: DataFrame, repeat: float, frequency: float, presence: float) -> DataFrame:
    """Lowers logits of tokens in the history (key, tok): by a factor, by count and once."""
    seen = history.groupBy(KEY, TOK).agg(F.count(F.lit(1)).alias("times"))
    scaled = F.when(F.col(X) <= 0, F.col(X) * repeat).otherwise(F.col(X) / repeat)
    lowered = scaled - F.col("times") * frequency - presence
    return rows.join(seen, [KEY, TOK], "left").withColumn(X, F.when(F.col("times").isNull(), F.col(X)).otherwise(lowered)).drop("times")


def logit_bias(rows: DataFrame, bias: DataFrame) -> DataFrame:
    """Adds the bias (tok, bias) to the logits of its tokens."""
    return rows.join(bias, TOK, "left").withColumn(X, F.col(X) + F.coalesce("bias", F.lit(0.0))).drop("bias")


def allow(rows: DataFrame, first: int, last: int, also: list[int]) -> DataFrame:
    """Puts tokens outside [first, last) and the list out of reach."""
    inside = F.col(TOK).between(first, last - 1) | F.col(TOK).isin(also)
    return rows.withColumn(X, F.when(inside, F.col(X)).otherwise(F.lit(-1e10)))


def greedy(rows: DataFrame) -> DataFrame:
    """(key, tok) of the best candidate of each step, the first of equals."""
    return rows.groupBy(KEY).agg(F.min_by(TOK, F.struct((-F.col(X)).alias("x"), F.col(TOK))).alias(TOK))


def draw(rows: DataFrame, uniform: Column) -> DataFrame:
    """(key, tok) by inverse distribution function, candidates in the order of their probabilities."""
    order = _step().orderBy(F.desc("p"), TOK).rowsBetween(Window.unboundedPreceding, 0)
    upto = softmax(rows).withColumns({"upto": F.round(F.sum("p").over(order), 12), "u": uniform})
    last = F.max(F.struct("upto", F.col(TOK)))
    return upto.groupBy(KEY).agg(F.coalesce(F.min(F.when(F.col("upto") >= F.col("u"), F.struct("upto", F.col(TOK)))), last).alias("b")).select(KEY, F.col(f"b.{TOK}").alias(TOK))


def mirostat_k(rows: DataFrame, mu: float, m: int) -> DataFrame:
    """(key, s_hat, k): the exponent fitted to the m best candidates, and how many the target surprise keeps."""
    order = _step().orderBy(F.desc("p"), TOK)
    ranked = softmax(rows).withColumns({"rn": F.row_number().over(order), "next": F.lead("p").over(order), "n": F.count(F.lit(1)).over(_step())})
    t = F.log((F.col("rn") + 1.0) / F.col("rn"))
    b = F.log(F.col("p") / F.col("next"))
    fitted = ranked.where((F.col("rn") < m) & F.col("next").isNotNull()).groupBy(KEY).agg((F.sum(t * b) / F.sum(t * t)).alias("s_hat"), F.max("n").alias("n"))
    e = F.col("s_hat") - 1
    k = F.pow(e * F.pow(F.lit(2.0), F.lit(mu)) / (1 - F.pow(F.col("n").cast("double"), -e)), 1 / F.col("s_hat"))
    return fitted.withColumn("k", F.greatest(F.floor(k), F.lit(1))).select(KEY, "s_hat", "k")


def mirostat_cut(rows: DataFrame, mu: float) -> DataFrame:
    """Candidates whose surprise is at most mu bits; the best in any case."""
    order = _step().orderBy(F.desc("p"), TOK)
    ranked = softmax(rows).withColumn("rn", F.row_number().over(order))
    return ranked.where((-F.log2("p") <= mu) | (F.col("rn") == 1)).drop("rn", "p")


def adaptive_target(rows: DataFrame, target: float, mean: float, width: float, peak: float, sharp: float) -> DataFrame:
    """Logits that peak at an adapted probability: clamp(2 * target - mean, 0, 1)."""
    adapted = min(1.0, max(0.0, 2 * target - mean))
    gap = F.abs(F.col("p") - adapted) / width
    return softmax(rows).withColumn(X, peak - sharp * gap * gap / (1 + gap)).drop("p")


def chain(rows: DataFrame, *steps) -> DataFrame:
    """Samplers one after another."""
    return reduce(lambda df, step: df.transform(step), steps, rows)


def probabilities(rows: DataFrame, n: int) -> DataFrame:
    """The n most probable candidates of each step with rank, p and log p."""
    order = _step().orderBy(F.desc("p"), TOK)
    return softmax(rows).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n).withColumn("logprob", F.log("p"))


def repeat_lengths(codes: list[int]) -> list[int]:
    """For each place of a list, how many elements from there on equal those from its start; each is compared a constant number of times."""
    n = len(codes)
    found = [n] + [0] * (n - 1)
    low = high = 0
    for i in range(1, n):
        run = min(found[i - low], high - i) if i < high else 0
        while i + run < n and codes[run] == codes[i + run]:
            run += 1
        if i + run > high:
            low, high = i, i + run
        found[i] = run
    return found


def suffix_matches(context: pd.Series, breakers: set, least: int) -> pd.Series:
    """For each context a dict from token to n, the most tokens that it once followed and that the context now ends with.

    n counts to the last breaker at most and is `least` or more. Null tokens equal none and are never reported;
    null and short contexts have no matches.
    """
    out = []
    for tokens in context:
        best: dict = {}
        if tokens is not None and len(tokens) > 1:
            back = list(tokens)[::-1]
            seen: dict = {}
            codes = [~i if t is None or t != t else seen.setdefault(t, len(seen)) for i, t in enumerate(back)]
            limit = next((i for i, t in enumerate(back) if t in breakers), len(back))
            for token, code, run in zip(back, codes, repeat_lengths(codes)[1:]):
                n = min(run, limit)
                if n >= least and code >= 0 and n > best.get(token, -1):
                    best[token] = n
        out.append(best)
    return pd.Series(out, dtype=object)


def suffix_penalties(rows: DataFrame, key: list[str], context: str, breakers: list, multiplier: float, base: float, least: int, most_power: int = 100) -> DataFrame:
    """(key, token, penalty): what is taken off the logit of tokens that would go on with a repeat of the sequence's end, growing with its length up to base ** most_power.

    Linear in the length of a sequence, which is one row; rows with equal keys count as one sequence's alternatives, of
    which the longest match is taken.
    """
    token = rows.schema[context].dataType.elementType
    matches = F.pandas_udf(lambda c: suffix_matches(c, set(breakers), least), MapType(token, IntegerType()))
    found = rows.select(*key, F.explode(matches(F.col(context))).alias("token", "n")).groupBy(*key, "token").agg(F.max("n").alias("n"))
    return found.select(*key, "token", (F.lit(multiplier) * F.pow(F.lit(base), F.least(F.col("n") - least, F.lit(most_power)))).alias("penalty"))


def merged_by_prefix(pieces: list[str], p: list[float | None]) -> list[float | None]:
    """Probabilities after candidates of which one's piece begins another's are merged, in order, into the likelier of two; merged and empty places are None.

    A piece looks up its own beginnings, so the work is by characters and not by pairs of candidates.
    """
    p, at, longer = list(p), {}, {}
    for i, piece in enumerate(pieces):
        at.setdefault(piece, []).append(i)
    for i, piece in enumerate(pieces):
        for n in range(1, len(piece) + 1):
            for shorter in at.get(piece[:n], ()):
                if shorter != i:
                    longer.setdefault(shorter, []).append(i)
    for i in sorted(longer):
        for j in longer[i]:
            if p[i] is None:
                break
            if p[j] is not None:
                target, source = (j, i) if p[j] > p[i] else (i, j)
                p[target], p[source] = p[target] + p[source], None
    return p


def _whole_steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The batches of rows in order of KEY as tables that end where a step ends."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        key = batch.column(KEY).dictionary_encode(null_encoding="encode").indices.to_numpy()
        cuts = np.flatnonzero(key[1:] != key[:-1])
        if held and held[-1].column(KEY)[-1] != batch.column(KEY)[0]:
            yield pa.Table.from_batches(held)
            held = []
        if len(cuts):
            end = int(cuts[-1]) + 1
            yield pa.Table.from_batches([*held, batch.slice(0, end)])
            held, batch = [], batch.slice(end)
        held.append(batch)
    if held:
        yield pa.Table.from_batches(held)


def infill(rows: DataFrame, end: int, threshold: float = 0.2) -> DataFrame:
    """(step, tok, p) of candidates with `piece` and `eog` (ends the text), for filling a gap.

    A step keeps only its ending candidates where these weigh more than a third of the mean of all candidates' share of text. Else candidates with a
    common beginning are merged, the likeliest first, and those that fall below `threshold`, and then below one part in the
    number of those left plus one, go; ending ones stay. Where no text is left, `end` alone remains, with p 1. Ending
    candidates, null and empty pieces are not merged. A step's candidates, a vocabulary at most, are merged in one task.
    """
    # dealt by step, so that a step's rows stay in one task through the windows and follow each other there
    p = softmax(rows.repartition(KEY).select(KEY, TOK, X, F.coalesce("eog", F.lit(False)).alias("eog"), F.coalesce("piece", F.lit("")).alias("piece")))
    ending = F.sum(F.when(F.col("eog"), F.col("p")).otherwise(0.0)).over(_step())
    text = F.sum(F.when(F.col("eog"), 0.0).otherwise(F.col("p"))).over(_step())
    ended = p.withColumn("stop", 3 * ending * F.count(F.lit(1)).over(_step()) > text)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own in _whole_steps(batches):
            key = own.column(KEY).combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()
            step = np.append(0, np.cumsum(key[1:] != key[:-1])) if len(key) else key
            x = own.column(X).to_numpy()
            own = own.take(pa.array(np.lexsort((own.column(TOK).to_numpy(), -x, step))))  # steps keep their places
            pieces = np.array(own.column("piece").to_pylist(), dtype=object)
            pieces[own.column("eog").to_numpy()] = ""
            p, x, stop = own.column("p").to_numpy().copy(), own.column(X).to_numpy(), own.column("stop").to_numpy()
            cuts = [*np.flatnonzero(np.append(True, step[1:] != step[:-1])).tolist(), len(step)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if not stop[a]:
                    live = [v if y > float("-inf") else None for v, y in zip(p[a:b].tolist(), x[a:b].tolist(), strict=True)]
                    p[a:b] = [v or 0.0 for v in merged_by_prefix(pieces[a:b].tolist(), live)]
            yield from own.set_column(own.column_names.index("p"), "p", pa.array(p)).select([KEY, TOK, "p", "eog", "stop"]).to_batches()

    schema = f"{KEY} {rows.schema[KEY].dataType.simpleString()}, {TOK} {rows.schema[TOK].dataType.simpleString()}, p double, eog boolean, stop boolean"
    merged = ended.select(KEY, TOK, X, "p", "eog", "piece", "stop").sortWithinPartitions(KEY).mapInArrow(merge, schema)
    kept = merged.where(F.when(F.col("stop"), F.col("eog")).otherwise(F.col("eog") | (F.col("p") >= threshold)))
    left = F.sum((~F.col("eog")).cast("int")).over(_step())
    shared = kept.withColumns({"left": left, "p": F.col("p") / F.sum("p").over(_step())}).where("stop or left = 0 or eog or p >= 1 / (left + 1)")
    again = shared.withColumn("p", F.col("p") / F.sum("p").over(_step()))
    bare = ended.where("not stop").select(KEY).distinct().join(again.where("not stop and left > 0").select(KEY).distinct(), KEY, "left_anti")
    only = bare.select(KEY, F.lit(end).cast(rows.schema[TOK].dataType).alias(TOK), F.lit(1.0).alias("p"))
    return again.where("stop or left > 0").select(KEY, TOK, "p").union(only)

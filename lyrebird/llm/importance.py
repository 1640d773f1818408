"""Target-distribution importance resampling with hashed n-gram features.

A text's features are its runs of 1 to `longest` words, hashed by CRC-32 to `buckets` buckets. No n-gram
string is made: each distinct word's CRC is computed once in a task, and the CRC of a run follows from
those of its parts. Appending m bytes to a message multiplies its CRC register by the m-th power of the
byte step, a 32 x 32 matrix over GF(2), so crc(a + b) = shift(crc(a), len(b)) ^ crc(b). The matrices of
1, 2, 4, ... bytes are kept as four tables of 256 numbers each, and the shifts of all runs of a batch are
done at once by numpy, one power of two of the lengths at a time.

The buckets' shares in the target and in the corpus give each bucket a gain, the logarithm of their ratio;
a document's weight is its features' mean gain. Weights plus seeded Gumbel noise, in order, are a
sample without replacement. Features are written once and read for both the counts and the weights.

Counts are summed in the tasks before anything is shuffled. Ranks come from a histogram of scores,
whose number of distinct values is bounded as scores are whole numbers of thousandths: only rows of one
score are put in order together, and the noise spreads copies of a document over thousands of scores.

Null and empty texts have no features and weight 0. Null doc_ids draw their noise as an empty string;
rows of one score come by doc_id, null last, then by weight and features, and rows equal in all that by
their layout, as a mark of which can't be told apart. Very long texts are hashed in stretches, n-grams
across their edges included. Rows are kept one for one, other columns pass through, those named like
an output are replaced. An empty table gives no rows; an empty target or corpus has no counts.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lyrebird.llm.common import apart, cut, named_back, read, small_batches, written

#: Words in UTF-8: ASCII digits, lower-case letters, and all beyond ASCII.
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
LONGEST, BUCKETS, LEAST_WORDS, SHARE, SEED = 1, 10_000, 20, 10, 2024
#: Words whose CRCs a task remembers at most.
REMEMBERED = 500_000
#: Words whose runs are put together at a time.
STRETCH = 1 << 18
#: The reflected polynomial of CRC-32.
POLYNOMIAL = 0xEDB88320

OUTPUTS = ("n_words", "n_features", "weight", "score", "rank")


@cache
def shift_tables(power: int) -> np.ndarray:
    """Four tables of 256 numbers that shift a CRC by 2 ** power zero bytes: the matrix applied to each byte of the register."""
    if power == 0:
        low = np.zeros(256, dtype=np.uint32)
        for value in range(256):
            register = value
            for _ in range(8):
                register = register >> 1 ^ (POLYNOMIAL if register & 1 else 0)
            low[value] = register
        rest = [np.arange(256, dtype=np.uint32) << np.uint32(8 * (k - 1)) for k in range(1, 4)]
        return np.stack([low, *rest])
    half = shift_tables(power - 1)
    return np.stack([applied(half, applied(half, np.arange(256, dtype=np.uint32) << np.uint32(8 * k))) for k in range(4)])


def applied(tables: np.ndarray, crcs: np.ndarray) -> np.ndarray:
    low, high = np.uint32(8), np.uint32(255)
    return tables[0][crcs & high] ^ tables[1][crcs >> low & high] ^ tables[2][crcs >> np.uint32(16) & high] ^ tables[3][crcs >> np.uint32(24)]


def shifted(crcs: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Each CRC moved on by that many zero bytes."""
    out, power = crcs.copy(), 0
    while len(lengths) and int(lengths.max()) >> power:
        chosen = np.flatnonzero(lengths >> power & 1)
        out[chosen] = applied(shift_tables(power), out[chosen])
        power += 1
    return out


def joined(left: np.ndarray, right: np.ndarray, right_lengths: np.ndarray) -> np.ndarray:
    """The CRC-32 of each left message followed by its right one, whose length is given."""
    return shifted(left, right_lengths) ^ right


class Words:
    """CRCs of a text's words; each distinct word's is computed once."""

    def __init__(self):
        self.known: dict[bytes, tuple[int, int]] = {}

    def of(self, text: bytes) -> tuple[np.ndarray, np.ndarray]:
        """(CRC, length in bytes) of each word."""
        words = WORD.findall(text.lower())  # bytes: A-Z only
        try:
            pairs = list(map(self.known.__getitem__, words))
        except KeyError:
            new = {w for w in words if w not in self.known}
            if len(self.known) + len(new) > REMEMBERED:
                self.known.clear()
                new = set(words)
            self.known.update((w, (zlib.crc32(w), len(w))) for w in new)
            pairs = list(map(self.known.__getitem__, words))
        both = np.array(pairs, dtype=np.uint32).reshape(-1, 2)
        return both[:, 0], both[:, 1].astype(np.int64)


SPACE = np.uint32(zlib.crc32(b" "))


def runs(crcs: np.ndarray, lengths: np.ndarray, longest: int) -> Iterator[np.ndarray]:
    """CRCs of all runs of 1, 2, ... `longest` words joined by a space, by their number of words."""
    if not len(crcs):
        return
    yield crcs
    # a space and a word, as the piece that each further word adds
    pieces = joined(np.full(len(crcs), SPACE), crcs, lengths) if longest > 1 else crcs
    held = crcs
    for words in range(2, longest + 1):
        if len(crcs) < words:
            return
        held = joined(held[:-1], pieces[words - 1 :], lengths[words - 1 :] + 1)
        yield held


def buckets_of(words: Words, text: bytes, longest: int, buckets: int) -> tuple[int, np.ndarray]:
    """The number of words of a text, and the buckets of its features."""
    crcs, lengths = words.of(text)
    found = []
    for at in range(0, len(crcs), STRETCH):
        # the runs that begin in this stretch; those of fewer words may begin in its last words as well
        for n, run in enumerate(runs(crcs[at : at + STRETCH + longest - 1], lengths[at : at + STRETCH + longest - 1], longest), 1):
            found.append(run[: min(STRETCH, len(crcs) - at - n + 1)] % np.uint32(buckets))
    return len(crcs), np.concatenate(found) if found else np.zeros(0, dtype=np.uint32)


def features(docs: DataFrame, longest: int, buckets: int) -> DataFrame:
    """docs without text, plus n_words, n_features and places: its features' buckets as little-endian integers."""
    kind = "<u2" if buckets <= 1 << 16 else "<u4"
    kept = [c for c in docs.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for batch in batches:
            found = [buckets_of(words, t or b"", longest, buckets) for t in batch.column(len(kept)).cast(pa.binary()).to_pylist()]
            columns = [pa.array([n for n, _ in found], pa.int64()), pa.array([len(b) for _, b in found], pa.int64()), pa.array([b.astype(kind).tobytes() for _, b in found], pa.binary())]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], *columns], [*kept, "n_words", "n_features", "places"])

    base = small_batches(docs).select(*kept, F.col("text").cast("string").alias("text"))
    schema = base.select(*kept, F.lit(0).cast("long").alias("n_words"), F.lit(0).cast("long").alias("n_features"), F.lit(None).cast("binary").alias("places")).schema
    return base.mapInArrow(run, schema)


def counts(featured: DataFrame, buckets: int) -> np.ndarray:
    """How many features fall in each bucket; a task sends a row for each of its buckets."""
    kind = "<u2" if buckets <= 1 << 16 else "<u4"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for places in batch.column(0).to_pylist():
                own = np.frombuffer(places, dtype=kind)
                if len(own) < buckets:  # few against the table: each is added by itself
                    np.add.at(total, own, 1)
                else:
                    total += np.bincount(own, minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], ["bucket", "n"])

    out = np.zeros(buckets, dtype=np.int64)
    for row in featured.select("places").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[row.bucket] = row.n
    return out


def gains(target: np.ndarray, corpus: np.ndarray) -> np.ndarray:
    """Of each bucket, the floored thousandfold logarithm of its smoothed share in the target over that in the corpus."""
    all_target, all_corpus, n = int(target.sum()), int(corpus.sum()), len(target)
    return np.array([math.floor(1000 * math.log((float(t) + 1) * (all_corpus + n) / ((float(s) + 1) * (all_target + n)))) for t, s in zip(target.tolist(), corpus.tolist(), strict=True)], dtype=np.int64)


def noise(doc_id: Column, seed: int) -> Column:
    """Floored thousandfold Gumbel noise of a document."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    share = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0
    return F.floor(-1000 * F.log(-F.log(share))).cast("long")


def weighed(featured: DataFrame, gain: np.ndarray) -> DataFrame:
    """featured without places, plus weight: the floored mean gain of its features."""
    kind = "<u2" if len(gain) <= 1 << 16 else "<u4"
    kept = [c for c in featured.columns if c != "places"]
    shipped = featured.sparkSession.sparkContext.broadcast(gain)  # a number a bucket

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shipped.value
        for batch in batches:
            own = [np.frombuffer(p, dtype=kind) for p in batch.column(len(kept)).to_pylist()]
            weights = [int(table[p].sum()) // len(p) if len(p) else 0 for p in own]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], pa.array(weights, pa.int64())], [*kept, "weight"])

    base = small_batches(featured).select(*kept, "places")
    return base.mapInArrow(run, base.select(*kept, F.lit(0).cast("long").alias("weight")).schema)


def ranked(scored: DataFrame, least_words: int, share: int) -> DataFrame:
    """scored plus rank: 1, 2, 3, ... by falling score of the drawn rows, null for the others."""
    able = F.col("n_words") >= least_words
    sizes = scored.where(able).groupBy("score").agg(F.count(F.lit(1)).alias("size"))
    # a row for each distinct score: some tens of thousands, whatever the number of documents
    above = F.coalesce(F.sum("size").over(Window.orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    steps = cut(sizes.select("score", above.alias("above"), F.sum("size").over(Window.partitionBy()).alias("all")))
    drawn = F.floor(F.col("all") * share / 100)
    starts = steps.where(F.col("above") < drawn).select(F.col("score").alias("its_score"), "above", drawn.alias("drawn"))
    order = Window.partitionBy("score").orderBy(F.col("doc_id").asc_nulls_last(), "weight", "n_features", "n_words")
    taken = scored.where(able).join(starts, F.col("score") == F.col("its_score")).withColumn("rank", (F.row_number().over(order) + F.col("above")).cast("long"))
    inside = F.col("rank") <= F.col("drawn")
    drawn_rows = taken.select(*scored.columns, F.when(inside, F.col("rank")).alias("rank"))
    others = scored.where(~F.coalesce(able, F.lit(False))).union(scored.where(able).join(starts, F.col("score") == F.col("its_score"), "left_anti"))
    return drawn_rows.union(others.withColumn("rank", F.lit(None).cast("long")))


def resample(docs: DataFrame, target: DataFrame, longest: int = LONGEST, buckets: int = BUCKETS, least_words: int = LEAST_WORDS, share: int = SHARE, seed: int = SEED) -> DataFrame:
    """docs without `text`, plus n_words, n_features, weight, score and rank. docs: doc_id, text; target: text."""
    own, names = apart(docs, "doc_id", "text")
    featured = written(features(own, longest, buckets))
    wanted = features(target.select("text"), longest, buckets)
    gain = gains(counts(wanted, buckets), counts(featured, buckets))
    scored = weighed(featured, gain).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))
    found = ranked(written(scored), least_words, share)
    return named_back(found, {c: n for c, n in names.items() if c != "text"}, *OUTPUTS)


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = resample(read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_features", "weight", "score", "rank")

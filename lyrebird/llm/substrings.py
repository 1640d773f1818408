"""Substring dedup by difference-cover anchors.

A window is WINDOW consecutive words of one document. A word goes when a window over it occurs with
the same words in an earlier place: in a document with a smaller doc_id, or earlier in its own.

COVER is a difference cover modulo PERIOD: for any two positions there is a shift below PERIOD that
brings both onto cover positions. Anchors are windows of WINDOW - PERIOD + 1 words at cover
positions only, so two equal windows share an anchor at the same shift. Pass one counts anchors
(a third as many rows as words). The hashes that occur twice go into a bit set of bounded size;
where it is crowded, more windows are looked at, never fewer. Pass two extends each repeated anchor
to the windows around it and compares them by 96-bit hashes: a window goes when a smaller doc_id has
it. Windows with an anchor that is hot in the whole corpus are pre-aggregated and salted, so none of
them gathers in one task. Repeats inside one document are found in the document itself.

Null texts have no words; very long ones are hashed in stretches but stay one row. Rows with a null doc_id come before all others. Rows with the same doc_id
are texts of equal rank: none is earlier than the other. Other columns pass through; columns named
like an output are replaced. Tables without rows give none.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import compress

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lyrebird.llm.common import cut, may_hold, pack_filter, read, small_batches, written

WINDOW = 20
PERIOD, COVER = 13, (0, 1, 3, 9)
ANCHOR = WINDOW - PERIOD + 1
#: An anchor is hot when it occurs more than HOT times and makes more than 1 / MOST_HOT of all repeated anchors.
HOT, MOST_HOT = 1000, 1 << 16
SALTS = 32
FIRST = -(1 << 63)  # stands for a null doc_id
BASE_1, BASE_2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


#: Words are hashed in stretches of this many bytes, cut between words.
STRETCH = 1 << 20
LETTERS = np.random.default_rng(20).integers(0, 1 << 64, 256, dtype=np.uint64)
IS_WHITE = np.isin(np.arange(256), list(b" \t\n\x0b\x0c\r"))


@cache
def powers(base: int) -> np.ndarray:
    """Powers of a base, kept once a worker."""
    return np.multiply.accumulate(np.append(np.uint64(1), np.full(STRETCH - 1, base, dtype=np.uint64)))


class _Hashes:
    """Hashes of the words of a text: a polynomial of its letters for short words, XXH64 for those over LONG bytes."""

    LONG = 64
    BASE = 0xB5C0FBCFEC4D3B2D

    def __init__(self):
        self.up, self.down = powers(self.BASE), powers(pow(self.BASE, -1, 1 << 64))

    def of(self, text: bytes) -> np.ndarray:
        """One hash for each word, whatever stands around it."""
        found, at = [], 0
        while at < len(text):
            end = at + STRETCH
            if end < len(text):
                # back to the last white space, or where there is none, on to the next
                piece = np.frombuffer(text, dtype=np.uint8, count=STRETCH, offset=at)
                last = np.flatnonzero(IS_WHITE[piece])
                if len(last):
                    end = at + int(last[-1]) + 1
                else:
                    word = text[at:].split(None, 1)[0]
                    found.append(np.array([xxhash.xxh64_intdigest(word)], dtype=np.uint64))
                    at += len(word)
                    continue
            found.append(self._stretch(text[at:end]))
            at = end
        return np.concatenate(found) if found else np.zeros(0, dtype=np.uint64)

    def _stretch(self, text: bytes) -> np.ndarray:
        letters = np.frombuffer(text, dtype=np.uint8)
        edges = np.flatnonzero(np.diff(np.concatenate([[True], IS_WHITE[letters], [True]])))
        start, end = edges[::2], edges[1::2]
        sums = np.append(np.uint64(0), np.cumsum(LETTERS[letters] * self.up[: len(letters)]))
        hashes = mixed((sums[end] - sums[start]) * self.down[start])
        for i in np.flatnonzero(end - start > self.LONG).tolist():
            hashes[i] = xxhash.xxh64_intdigest(text[start[i] : end[i]])
        return hashes


ON_COVER = np.isin(np.arange(PERIOD), COVER)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xC2B2AE3D27D4EB4F)
    return h ^ (h >> np.uint64(29))


def rolled(values: np.ndarray, width: int, base: np.uint64) -> np.ndarray:
    """A hash of each run of `width` values, built by doubling; shorter than values by width - 1."""
    if len(values) < width:
        return np.zeros(0, dtype=np.uint64)
    held, length, power = values, 1, np.array([base])  # hashes of runs of `length`; power = base ** length
    out, done = None, 0
    while True:
        if width & length:
            # out covers `done` values and is followed by a run of `length`
            out = held if out is None else out[: len(held) - done] * power + held[done:]
            done += length
        if done == width:
            break
        held = held[: len(held) - length] * power + held[length:]
        length, power = 2 * length, power * power
    return mixed(out[: len(values) - width + 1])


class Batch:
    """The words of some texts, end to end."""

    def __init__(self, texts: list[bytes | None], hashes: _Hashes):
        self.words = [t.split() if t else [] for t in texts]
        self.lengths = np.fromiter(map(len, self.words), dtype=np.int64, count=len(texts))
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.hashes = hashes.of(b" ".join(t for t in texts if t))
        self.row = np.repeat(np.arange(len(texts)), self.lengths)
        self.at = np.arange(len(self.hashes)) - self.starts[self.row]
        self.left = self.lengths[self.row] - self.at  # words from here to the end of the text

        self.short = rolled(self.hashes, ANCHOR, BASE_1)  # from each place

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """Places of anchors and their hashes."""
        where = np.flatnonzero(ON_COVER[self.at % PERIOD] & (self.left >= ANCHOR))
        return where, self.short[where] if len(where) else np.zeros(0, dtype=np.uint64)

    def around(self, hit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places of the windows that hold one of these anchors, and two hashes of each."""
        edge = np.zeros(len(self.hashes) + 1, dtype=np.int32)
        np.add.at(edge, np.maximum(hit - (PERIOD - 1), hit - self.at[hit]), 1)
        np.add.at(edge, hit + 1, -1)
        place = np.flatnonzero((np.cumsum(edge[:-1]) > 0) & (self.left >= WINDOW))
        h1, h2 = np.zeros(len(place), dtype=np.uint64), np.zeros(len(place), dtype=np.uint64)
        for j in range(WINDOW):
            word = self.hashes[place + j]
            h1, h2 = h1 * BASE_1 + word, h2 * BASE_2 + word
        return place, mixed(h1), mixed(h2)

    def windows(self, bits: np.ndarray, log_bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The windows with an anchor that the filter may hold."""
        where, anchor = self.anchors()
        return self.around(where[may_hold(bits, log_bits, anchor)])

    def repeated_here(self) -> np.ndarray:
        """Places of the windows whose words stand earlier in their own text; such windows share an anchor there."""
        where, anchor = self.anchors()
        order = np.lexsort((anchor, self.row[where]))
        same = (anchor[order][1:] == anchor[order][:-1]) & (self.row[where][order][1:] == self.row[where][order][:-1])
        twice = np.zeros(len(where), dtype=bool)
        twice[order[1:]] |= same
        twice[order[:-1]] |= same
        place, h1, h2 = self.around(where[twice])
        return place[~self.first_here(place, h1, h2)]

    def hold(self, hot: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Which windows hold a hot anchor anywhere, on cover positions or not, so that equal windows agree."""
        if not len(hot) or not len(place):
            return np.zeros(len(place), dtype=bool)
        found = np.append(0, np.cumsum(hot[np.minimum(np.searchsorted(hot, self.short), len(hot) - 1)] == self.short))
        return found[place + PERIOD] > found[place]

    def first_here(self, place: np.ndarray, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """Which windows are the first of their words in their own text."""
        order = np.lexsort((place, h2, h1, self.row[place]))
        same = (self.row[place][order][1:] == self.row[place][order][:-1]) & (h1[order][1:] == h1[order][:-1]) & (h2[order][1:] == h2[order][:-1])
        first = np.ones(len(place), dtype=bool)
        first[order[1:]] = ~same
        return first


def _texts(column: pa.Array) -> list[bytes | None]:
    return column.cast(pa.binary()).to_pylist()


def repeated_windows(docs: DataFrame) -> tuple[DataFrame, object, int]:
    """(doc, tag, places) of the windows that occur in an earlier document; and the filter of shared doc_ids.

    doc: doc_id with null as FIRST; tag: a 64-bit hash of the text where other rows may have that doc_id, else 0.
    """
    spark = docs.sparkSession
    texts = small_batches(docs).select(F.coalesce(F.col("doc_id").cast("long"), F.lit(FIRST)).alias("doc"), F.xxhash64("text").alias("tag"), F.col("text").cast("string").alias("text"))

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _Hashes()
        for batch in batches:
            _, found = Batch(_texts(batch.column(0)), hashes).anchors()
            yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64))], ["h"])

    counted = texts.select("text").mapInArrow(anchors, "h long").groupBy("h").agg(F.count(F.lit(1)).alias("n"))
    repeated = written(counted.where("n > 1"))
    bits, log_bits = pack_filter(repeated, "h")
    limit = max(HOT, (repeated.agg(F.sum("n").alias("n")).first().n or 0) // MOST_HOT)
    hot = np.sort(repeated.where(F.col("n") > limit).select("h").toArrow().column(0).to_numpy().view(np.uint64))  # MOST_HOT at most
    shared = texts.select("doc").groupBy("doc").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.xxhash64("doc").alias("key"))
    shared_bits, shared_log = pack_filter(cut(shared), "key")
    shipped = spark.sparkContext.broadcast(bits)  # at most MAX_FILTER_BITS
    aside = spark.sparkContext.broadcast((hot, shared_bits))

    def windows(hot_only: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            hashes, own = _Hashes(), np.frombuffer(shipped.value, dtype=np.uint8)
            hot, shared = aside.value
            shared = np.frombuffer(shared, dtype=np.uint8)
            for batch in batches:
                words = Batch(_texts(batch.column(2)), hashes)
                place, h1, h2 = words.windows(own, log_bits)
                is_hot = words.hold(hot, place)
                take = words.first_here(place, h1, h2) & (is_hot if hot_only else True)
                place, row = place[take], words.row[place[take]]
                key = batch.column(3).to_numpy().view(np.uint64)
                tag = np.where(may_hold(shared, shared_log, key), batch.column(1).to_numpy(), 0)
                salt = np.where(is_hot[take] & ~hot_only, (key[row] % np.uint64(SALTS)).astype(np.int64), 0)
                low = (h2[take] >> np.uint64(32)).astype(np.int64)
                columns = [h1[take].view(np.int64), low | (salt << 32), batch.column(0).to_numpy()[row], tag[row], words.at[place].astype(np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["h1", "h2", "doc", "tag", "place"])

        return run

    # h2 holds 32 bits of the second hash and above them the salt, 0 unless the window has a hot anchor
    keyed = texts.select("doc", "tag", "text", F.xxhash64("doc").alias("key"))
    kinds = "h1 long, h2 long, doc long, tag long, place int"
    seen = keyed.mapInArrow(windows(False), kinds)
    if len(hot):
        # the smallest doc_id of each hot window, found with map-side sums, stands among the rows of each salt
        first = keyed.mapInArrow(windows(True), kinds).groupBy("h1", "h2").agg(F.min("doc").alias("doc"), F.count(F.lit(1)).alias("n")).where("n > 1")
        salts = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long")))
        seen = seen.union(first.withColumn("salt", salts).select("h1", F.col("h2") + F.shiftleft("salt", 32), "doc", F.lit(None).cast("long"), F.lit(None).cast("int")))
    placed = seen.withColumn("first", F.min("doc").over(Window.partitionBy("h1", "h2"))).where("doc > first").select("doc", "tag", "place")
    # a document's list is as long as the document at most
    return placed.groupBy("doc", "tag").agg(F.collect_list("place").alias("places")), aside, shared_log


def remove_repeats(docs: DataFrame) -> DataFrame:
    """docs plus n_words, n_removed and `kept`, the words left, joined by one space.

    Each task needs one Python worker: rows that the join may miss are cleaned where they are read,
    the others are dealt by the join first.
    """
    outputs = {"n_words": "long", "n_removed": "long", "kept": "string"}
    repeated, aside, shared_log = repeated_windows(docs)
    repeated = written(repeated)
    # texts without a repeat in another document need no join: a second filter, over rows, tells most of them
    keys = repeated.select(F.xxhash64("doc", "tag").alias("key"))
    rows_bits, rows_log = pack_filter(keys, "key")
    rows_shipped = docs.sparkSession.sparkContext.broadcast(rows_bits)

    names = [c for c in docs.columns if c not in outputs]
    own = [f"c{i}" for i in range(len(names))]  # so that no column of docs is mistaken for one of those below
    text_at = names.index("text")
    doc, tag = F.coalesce(F.col("`doc_id`").cast("long"), F.lit(FIRST)), F.xxhash64("`text`")
    base = small_batches(docs).select(*[F.col(f"`{c}`").alias(x) for c, x in zip(names, own, strict=True)], doc.alias("doc"), tag.alias("tag"))
    keyed = base.select("*", F.xxhash64("doc").alias("by_doc"), F.xxhash64("doc", F.lit(0).cast("long")).alias("untagged"), F.xxhash64("doc", "tag").alias("tagged"))

    def hashed(batch: pa.RecordBatch, name: str) -> np.ndarray:
        return batch.column(name).to_numpy().view(np.uint64)

    def judged(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        """The tag under which `repeated` would list each row, and whether it may."""
        shared = may_hold(np.frombuffer(aside.value[1], dtype=np.uint8), shared_log, hashed(batch, "by_doc"))
        key = np.where(shared, hashed(batch, "tagged"), hashed(batch, "untagged"))
        return np.where(shared, batch.column("tag").to_numpy(), 0), may_hold(np.frombuffer(rows_shipped.value, dtype=np.uint8), rows_log, key)

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tags, may = judged(batch)
            columns = [batch.column(c) for c in [*own, "doc"]]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(tags)], [*own, "doc", "tag"]).filter(pa.array(may))

    def cleaned(batch: pa.RecordBatch, places: pa.Array | None, hashes: _Hashes) -> pa.RecordBatch:
        words = Batch(_texts(batch.column(text_at)), hashes)
        gone = words.repeated_here()
        if places is not None:
            counts = places.value_lengths().fill_null(0).to_numpy()
            gone = np.concatenate([gone, places.flatten().to_numpy().astype(np.int64) + np.repeat(words.starts, counts)])
        edge = np.zeros(len(words.hashes) + 1, dtype=np.int32)
        np.add.at(edge, gone, 1)
        np.add.at(edge, gone + WINDOW, -1)
        stay = np.cumsum(edge[:-1]) == 0
        removed = np.bincount(words.row[~stay], minlength=len(words.words))
        texts = []
        for ws, n, start in zip(words.words, removed.tolist(), words.starts.tolist(), strict=True):
            texts.append(b" ".join(compress(ws, stay[start : start + len(ws)].tolist()) if n else ws).decode())
        columns = [batch.column(c) for c in own]
        return pa.RecordBatch.from_arrays([*columns, pa.array(words.lengths), pa.array(removed.astype(np.int64)), pa.array(texts, pa.string())], [*names, *outputs])

    def here(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _Hashes()
        for batch in batches:
            _, may = judged(batch)
            yield cleaned(batch.filter(pa.array(~may)), None, hashes)

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _Hashes()
        for batch in batches:
            yield cleaned(batch, batch.column("places"), hashes)

    schema = docs.select(*[F.col(f"`{c}`") for c in names], *[F.lit(None).cast(kind).alias(name) for name, kind in outputs.items()]).schema
    dealt = keyed.mapInArrow(listed, base.schema).join(repeated, ["doc", "tag"], "left").select(*own, "places")
    return dealt.mapInArrow(joined, schema).union(keyed.mapInArrow(here, schema))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = remove_repeats(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return cleaned.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept"), 256).alias("kept_sha256"))


#: For tables whose doc_ids are all different.
OP10_SQL = r"""
WITH texts AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), words AS (
  SELECT doc_id, unnest(range(0, len(words))) AS place, unnest(words) AS word FROM texts
), windows AS (
  SELECT *, CASE WHEN count(*) OVER w = 20 THEN string_agg(word, ' ') OVER w END AS twenty FROM words WINDOW w AS (PARTITION BY doc_id ORDER BY place ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING)
), judged AS (
  SELECT *, twenty IS NOT NULL AND row_number() OVER (PARTITION BY twenty ORDER BY doc_id NULLS FIRST, place) > 1 AS again FROM windows
), covered AS (
  SELECT *, max(again::INT) OVER (PARTITION BY doc_id ORDER BY place ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) = 1 AS gone FROM judged
), counted AS (
  SELECT doc_id, count(*) AS n, count(*) FILTER (WHERE gone) AS gone, string_agg(word, ' ' ORDER BY place) FILTER (WHERE NOT gone) AS kept FROM covered GROUP BY doc_id
)
SELECT t.doc_id, coalesce(n, 0) AS n_words, coalesce(gone, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM texts t LEFT JOIN counted c ON t.doc_id IS NOT DISTINCT FROM c.doc_id
"""

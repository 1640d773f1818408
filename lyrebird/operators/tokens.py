"""Token sequences: n-gram counts and drafts, cache positions, batches, prefix matching."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lyrebird.operators.ranks import numbered

#: Bytes of text whose n-grams make one partition, and whose n-grams are counted at a time in a task.
PART_BYTES, HELD_BYTES = 2 << 20, 4 << 20


def ngrams(tokens: DataFrame, key: str, order: str, token: str, least: int, most: int) -> DataFrame:
    """(n, gram, next): each run of n tokens of a sequence and the token after it."""
    by = Window.partitionBy(key).orderBy(order)
    wide = tokens.select(F.col(token).alias("next"), *[F.lag(token, i).over(by).alias(f"b{i}") for i in range(1, most + 1)])
    grams = F.array(*[F.struct(F.lit(n).alias("n"), F.when(F.col(f"b{n}").isNotNull(), F.array_join(F.array(*[F.col(f"b{i}") for i in range(n, 0, -1)]), " ")).alias("gram")) for n in range(least, most + 1)])
    return wide.select("next", F.explode(grams).alias("g")).where("g.gram is not null").select("g.n", "g.gram", "next")


def array_ngrams(rows: DataFrame, tokens: str, least: int, most: int) -> DataFrame:
    """`ngrams` of sequences that are arrays: shifted copies side by side, exploded once, without a function called for each place."""
    t = F.col(tokens)
    back = [F.concat(F.array_repeat(F.lit(None).cast("string"), i), t) for i in range(most)]
    wide = rows.select(*[c.alias(f"b{i}") for i, c in enumerate(back, 1)], F.slice(t, F.lit(2), F.greatest(F.size(t) - 1, F.lit(0))).alias("next"))
    places = wide.select(F.inline(F.arrays_zip("next", *[f"b{i}" for i in range(1, most + 1)]))).where("next is not null")
    grams = F.array(*[F.struct(F.lit(n).alias("n"), F.concat_ws(" ", *[F.col(f"b{i}") for i in range(n, 0, -1)]).alias("gram"), F.col(f"b{n}").isNotNull().alias("whole")) for n in range(least, most + 1)])
    return places.select("next", F.explode(grams).alias("g")).where("g.whole").select("g.n", "g.gram", "next")


def parts_of(texts: DataFrame, text: str, each: int | None = None) -> int:
    """Partitions for the n-grams of texts, one for each PART_BYTES or so many bytes."""
    size = texts.agg(F.sum(F.octet_length(text))).first()[0] or 0
    return max(1, -(-size // (each or PART_BYTES)))


def _counted(texts: pa.StringArray, least: int, most: int) -> Iterator[pa.RecordBatch]:
    """Counts of the n-grams of texts, by numbers of words; a run of n words has a number too, so that longer ones are pairs of numbers."""
    words = pc.split_pattern(texts, " ")
    sizes = words.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    coded = words.flatten().dictionary_encode()
    names, word = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    place = np.arange(len(word)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    run, spelt, v = word, names, max(1, len(names))
    for n in range(1, most + 1):
        at = np.flatnonzero(place >= n)
        pairs = pa.array(run[at - 1] * v + word[at]).dictionary_encode()
        found, which = pairs.dictionary.to_numpy(zero_copy_only=False), pairs.indices.to_numpy(zero_copy_only=False)
        gram, following = spelt.take(pa.array(found // v)), names.take(pa.array(found % v))
        if n >= least:
            times = np.bincount(which, minlength=len(found)).astype(np.int64)
            counts = pa.RecordBatch.from_arrays([pa.array(np.full(len(found), n, np.int32)), gram, following, pa.array(times)], ["n", "gram", "next", "times"])
            yield from (counts.slice(k, 50_000) for k in range(0, len(found), 50_000))
        run = np.full(len(word), -1)
        run[at], spelt = which, pc.binary_join_element_wise(gram, following, " ")


def text_ngrams(texts: DataFrame, text: str, least: int, most: int) -> DataFrame:
    """(n, gram, next, times): the n-grams of texts split at each space, counted a few megabytes at a time; `merge_counts` adds these counts up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for k in range(0, batch.num_rows, 100):
                held.append(batch.column(0).slice(k, 100).drop_null())
                size += held[-1].nbytes
                if size >= HELD_BYTES:
                    yield from _counted(pa.concat_arrays(held), least, most)
                    held, size = [], 0
        if held:
            yield from _counted(pa.concat_arrays(held), least, most)

    return texts.select(F.col(text).cast("string")).mapInArrow(run, "n int, gram string, next string, times long")


def count_ngrams(grams: DataFrame) -> DataFrame:
    return grams.groupBy("n", "gram", "next").agg(F.count(F.lit(1)).alias("times"))


def merge_counts(parts: int, *caches: DataFrame) -> DataFrame:
    """Caches added up, in so many partitions: nearly all n-grams are rare, so adding up before they are dealt would only fill memory."""
    union = caches[0]
    for cache in caches[1:]:
        union = union.unionByName(cache)
    return union.repartition(parts, "n", "gram", "next").groupBy("n", "gram", "next").agg(F.sum("times").alias("times"))


def common_prefix(a: Column, b: Column) -> Column:
    """How many leading elements of two arrays agree."""
    same = F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False)))
    first = F.array_position(same, False)
    return F.when(first == 0, F.size(same)).otherwise(first - 1).cast("int")


def _prefixes(rows: DataFrame, key: str, tokens: str, lengths: Column) -> DataFrame:
    """(key, n, own, len, h): the hashes h of a sequence's first `len` tokens, for each of the lengths up to its first null; own is that of the longest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes, asked = batch.column(1), batch.column(2)
            sizes, counts = (c.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) for c in (hashes, asked))
            flat = hashes.flatten()
            start = np.cumsum(sizes) - sizes
            place = (np.arange(len(flat)) - np.repeat(start, sizes)).astype(np.uint64)
            x = flat.fill_null(0).to_numpy(zero_copy_only=False).view(np.uint64) + (place + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
            for by, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
                x = (x ^ (x >> np.uint64(by))) * np.uint64(factor)
            sums = np.append(np.uint64(0), np.cumsum(x ^ (x >> np.uint64(31)), dtype=np.uint64))
            nulls = np.append(0, np.cumsum(flat.is_null().to_numpy(zero_copy_only=False)))
            row = np.repeat(np.arange(len(sizes)), counts)
            length = asked.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            fits = length <= sizes[row]
            row, length = row[fits], length[fits]
            known = nulls[start[row] + length] == nulls[start[row]]
            row, length = row[known], length[known]
            h = sums[start[row] + length] - sums[start[row]]
            own = sums[start[row] + sizes[row]] - sums[start[row]]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), pa.array(sizes[row]), pa.array(own.view(np.int64)), pa.array(length.astype(np.int32)), pa.array(h.view(np.int64))], [key, "n", "own", "len", "h"])

    hashed = F.transform(tokens, lambda t: F.when(t.isNotNull(), F.xxhash64(t)))
    return rows.select(key, hashed.alias("t"), lengths.cast("array<int>").alias("lengths")).mapInArrow(run, f"{key} {rows.schema[key].dataType.simpleString()}, n long, own long, len int, h long")


def _powers(size: Column, least: Column) -> Column:
    """The powers of two from the last one up to `least` to the last one up to `size`."""
    return F.transform(F.sequence(F.floor(F.log2(least)).cast("int"), F.floor(F.log2(size)).cast("int")), lambda k: F.pow(F.lit(2), k).cast("int"))


def best_slot(requests: DataFrame, slots: DataFrame, least: float) -> DataFrame:
    """For requests (req, tokens) the slot (slot, cached) with the longest common prefix, where it covers the share `least` of the request.

    Of slots that share as much the smallest wins; a request never gets its own. Slots are listed under the hashes of
    their prefixes of 1, 2, 4, ... tokens. The longest of these that a request shares with another slot brackets the
    common prefix, and only in such brackets slots are listed under all lengths. So lists hold a number and
    an id, no tokens, and no pairs of a list are formed. Prefixes are equal where length and 64-bit hash are.
    """
    slots, requests = slots.where("slot is not null and size(cached) > 0"), requests.where("req is not null and size(tokens) > 0")
    listed = _prefixes(slots, "slot", "cached", _powers(F.size("cached"), F.lit(1))).select("slot", "len", "h")
    needed = F.least(F.size("tokens"), F.floor(F.size("tokens") * least).cast("int") + 1)
    asked = _prefixes(requests, "req", "tokens", _powers(F.size("tokens"), needed))

    def shared(asks: DataFrame, lists: DataFrame) -> DataFrame:
        """The longest of each request's prefixes that another slot has, and the smallest slot that has it."""
        groups = lists.groupBy("len", "h").agg(F.min("slot").alias("first"), F.max("slot").alias("last"))
        met = asks.join(groups, ["len", "h"]).where("first != req or last != req")
        return met.groupBy("req", "n", "own").agg(F.max_by(F.struct("len", "h", "first"), "len").alias("p")).select("req", "n", "own", "p.*")

    low = shared(asked, listed)
    between = lambda lens: F.flatten(F.transform(lens, lambda k: F.sequence(k + 1, 2 * k - 1)))
    opened = low.where("len > 1").select("len", "h").distinct()
    spans = listed.join(opened, ["len", "h"]).groupBy("slot").agg(F.collect_set("len").alias("lens"))
    within = _prefixes(slots.join(spans, "slot"), "slot", "cached", between(F.col("lens"))).select("slot", "len", "h")
    asking = requests.join(low.where("len > 1").groupBy("req").agg(F.collect_set("len").alias("lens")), "req")
    high = shared(_prefixes(asking, "req", "tokens", between(F.col("lens"))), within)
    best = low.union(high).groupBy("req", "n", "own").agg(F.max_by(F.struct("len", "h", "first"), "len").alias("p")).select("req", "n", "p.*")
    enough = best.withColumn("share", F.col("len") / F.col("n")).where(F.col("share") > least)
    # a prefix's smallest slot is asked for its second one
    first = enough.where("first = req").select("len", "h", "req", "share")
    second = first.join(listed.union(within), ["len", "h"]).where("slot != req").groupBy("req", "share").agg(F.min("slot").alias("slot"))
    scored = enough.where("first != req").select("req", "share", F.col("first").alias("slot")).unionByName(second)
    return scored.groupBy("req").agg(F.max_by("slot", F.struct(F.col("share"), (-F.col("slot")).alias("s"))).alias("slot"), F.max("share").alias("share"))


def accept_draft(pairs: DataFrame, key: str, pos: str, draft: str, sampled: str) -> DataFrame:
    """Sampled tokens up to and with the first that differs from the draft; where none differs, all, the extra sample too."""
    first = F.min(F.when(F.coalesce(F.col(draft) != F.col(sampled), F.lit(True)), F.col(pos))).over(Window.partitionBy(key))
    return pairs.withColumn("stop", first).where(F.col("stop").isNull() | (F.col(pos) <= F.col("stop"))).drop("stop")


def remove_positions(cells: DataFrame, seq: Column, low: int, high: int) -> DataFrame:
    return cells.where(~((F.col("seq") == seq) & (F.col("pos") >= low) & (F.col("pos") < high)))


def copy_sequence(cells: DataFrame, source: int, target: int) -> DataFrame:
    return cells.unionByName(cells.where(F.col("seq") == source).withColumn("seq", F.lit(target).cast(cells.schema["seq"].dataType)))


def keep_sequence(cells: DataFrame, seq: int) -> DataFrame:
    return cells.where(F.col("seq") == seq)


def shift_positions(cells: DataFrame, seq: int, low: int, high: int, by: int) -> DataFrame:
    """Positions of a range moved; cells that would fall below 0 go."""
    inside = (F.col("seq") == seq) & (F.col("pos") >= low) & (F.col("pos") < high)
    return cells.withColumn("pos", F.when(inside, F.col("pos") + by).otherwise(F.col("pos"))).where("pos >= 0")


def divide_positions(cells: DataFrame, seq: int, by: int) -> DataFrame:
    return cells.withColumn("pos", F.when(F.col("seq") == seq, F.floor(F.col("pos") / by)).otherwise(F.col("pos")))


def split_simple(tokens: DataFrame, key: str, order: list[str], n: int, bin_of: Column) -> DataFrame:
    """Batches of n tokens in order, within each group; `bin_of` cuts the order into bins."""
    return numbered(tokens, [key], bin_of, order).withColumn("batch", F.floor((F.col("rn") - 1) / n)).drop("rn")


def split_equal(tokens: DataFrame, key: str, seq: str, order: str, n: int) -> DataFrame:
    """Batches that take the same stretch of n tokens from each sequence of a group; sequences that end sooner are batched with those still open."""
    return tokens.withColumn("batch", F.floor((F.row_number().over(Window.partitionBy(key, seq).orderBy(order)) - 1) / n))


def positions(mask: DataFrame, key: str, order: str, seen: str) -> DataFrame:
    """Positions that count seen tokens from 0; masked ones have 1."""
    upto = F.sum(F.col(seen).cast("int")).over(Window.partitionBy(key).orderBy(order))
    return mask.withColumn("position", F.when(F.col(seen), upto - 1).otherwise(F.lit(1)))


def shards(tensors: DataFrame, group: str, order: str, size: str, most: int) -> DataFrame:
    """(group, shard sizes): tensors in order dealt to shards greedily, a new one where the next would exceed `most`."""
    listed = tensors.groupBy(group).agg(F.sort_array(F.collect_list(F.struct(order, size))).alias("t"))
    start = F.struct(F.array().cast("array<bigint>").alias("done"), F.lit(0).cast("long").alias("open"))

    def step(s: Column, t: Column) -> Column:
        grown = s["open"] + t[size]
        full = (s["open"] > 0) & (grown > most)
        return F.when(full, F.struct(F.concat(s["done"], F.array(s["open"])).alias("done"), t[size].cast("long").alias("open"))).otherwise(F.struct(s["done"].alias("done"), grown.cast("long").alias("open")))

    return listed.select(group, F.aggregate("t", start, step, lambda s: F.concat(s["done"], F.array(s["open"]))).alias("sizes"))


def best_prefixes(words: DataFrame, dictionary: DataFrame, least: int = 2) -> DataFrame:
    """(word, left, right): each different word cut after its best entry of (entry, score).

    The best entry is the prefix of `least` characters or more with the highest score, the longer one among equals;
    of words without an entry, and of those no longer than `least`, the whole word is the left part. Only different
    words are spread to their prefixes, no longer than the dictionary's longest entry; entries that occur
    repeatedly count with their highest score. Null words and entries are left out.
    """
    entries = dictionary.where(F.char_length("entry") >= least).groupBy("entry").agg(F.max("score").alias("score"))
    longest = entries.agg(F.coalesce(F.max(F.char_length("entry")), F.lit(0)).alias("longest"))  # one row
    own = words.select("word").where("word is not null").distinct()
    lengths = F.sequence(F.lit(least), F.greatest(F.least(F.char_length("word"), F.col("longest")), F.lit(least)))
    long = own.where(F.char_length("word") > least).crossJoin(F.broadcast(longest))
    spread = long.select("word", F.explode(lengths).alias("k")).select("word", F.expr("left(word, k)").alias("entry"))
    best = spread.join(entries, "entry").groupBy("word").agg(F.max_by("entry", F.struct("score", F.char_length("entry"))).alias("left"))
    return own.join(best, "word", "left").withColumn("left", F.coalesce("left", "word")).select("word", "left", F.expr("substring(word, char_length(left) + 1)").alias("right"))

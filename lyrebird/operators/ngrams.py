"""N-grams of one and two words with the word after them, counted over texts split at each space.

A window is two words and the word after them, or the two last words of a text. The counts of its windows
tell those of both n-grams, so a place of a text is sent once. Tasks count some megabytes of texts by numbers
of words and deal the windows by a hash of their first two words; what goes to a part is sent as one
value, compressed: words by their lengths and letters, a first word once for all of its second ones, these
once for all of their third ones. A pair's windows are all in one part, so its counts are final there. The
windows of a first word are in many parts: for drafts, a part sends its best next word, with counts, on.

Parts follow the bytes of the texts. A part that holds more windows than usual (one pair with many words
after it) is added up in slices by a hash of the third word.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lyrebird.operators.tokens import parts_of

#: Bytes of text whose windows make one part, and whose windows are counted at a time; bytes of windows, unpacked, that are added up at a time; and rows of a batch that is sent on.
PART_BYTES, HELD_BYTES, ADDED, SENT = 8 << 20, 4 << 20, 64 << 20, 50_000
#: Parts of windows for one part of the best next words.
BEST_PARTS = 4
PACKED = "part int, data binary"
ODD = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    for by, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(by))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def _spelt(words: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
    """Where the words begin in their letters, with the end of the last one, and the letters."""
    begin = np.frombuffer(words.buffers()[1], dtype=np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64) if len(words) else np.zeros(1, dtype=np.int64)
    letters = np.frombuffer(words.buffers()[2] or b"", dtype=np.uint8)[begin[0] : begin[-1]]
    return begin - begin[0], letters


def _hashes(words: pa.StringArray) -> np.ndarray:
    """64-bit hashes of words, the same in all tasks."""
    begin, letters = _spelt(words)
    place = (np.arange(len(letters)) - np.repeat(begin[:-1], np.diff(begin))).astype(np.uint64)
    sums = np.append(np.uint64(0), np.cumsum(_mixed(letters + (place + np.uint64(1)) * ODD), dtype=np.uint64))
    return sums[begin[1:]] - sums[begin[:-1]]


def _dealt(numbers: list[tuple[np.ndarray, np.ndarray]], words: list[tuple[pa.StringArray, np.ndarray]], parts: np.ndarray) -> pa.RecordBatch:
    """Columns of numbers and of words, cut at the places beside them, one value for each part."""
    codec, sent = pa.Codec("zstd", compression_level=3), []
    spelt = [(*_spelt(column), cuts) for column, cuts in words]
    for k in range(len(parts)):
        plain = [c[cuts[k] : cuts[k + 1]] for c, cuts in [*numbers, *((np.diff(begin), cuts) for begin, _, cuts in spelt)]]
        narrow = [c.astype(next(w for w in ("u1", "<u4", "<u8") if not len(c) or int(c.max()) < 1 << (8 * np.dtype(w).itemsize))) for c in plain]
        head = np.array([x for c in narrow for x in (len(c), c.itemsize)], dtype="<u8")
        data = b"".join([head.tobytes(), *(c.tobytes() for c in narrow), *(letters[begin[cuts[k]] : begin[cuts[k + 1]]].tobytes() for begin, letters, cuts in spelt)])
        sent.append(len(data).to_bytes(8, "little") + codec.compress(data, asbytes=True))
    return pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), pa.array(sent, pa.binary())], ["part", "data"])


def _opened(sent: bytes, n_numbers: int, n_words: int) -> tuple[list[np.ndarray], list[pa.StringArray]]:
    """The columns of one value of `_dealt`, numbers as narrow as they were sent."""
    data = pa.decompress(sent[8:], int.from_bytes(sent[:8], "little"), codec="zstd", asbytes=True)
    n = n_numbers + n_words
    at, columns, words = 16 * n, [], []
    for size, width in np.frombuffer(data, "<u8", 2 * n).reshape(n, 2).tolist():
        columns.append(np.frombuffer(data, f"<u{width}", size, at))
        at += size * width
    for sizes in columns[n_numbers:]:
        begin = np.append(0, np.cumsum(sizes, dtype=np.int64))
        words.append(pa.StringArray.from_buffers(len(sizes), pa.py_buffer(begin.astype(np.int32)), pa.py_buffer(data[at : at + begin[-1]])))
        at += int(begin[-1])
    return columns[:n_numbers], words


def _windows(texts: pa.StringArray, parts: int) -> pa.RecordBatch:
    """The windows of texts, packed for each part: second words of a first one, third ones of a pair, texts that end with a pair, times of a window; the words."""
    split = pc.split_pattern(texts, " ")
    sizes = split.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    coded = split.flatten().dictionary_encode()
    names, word = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    v = max(1, len(names))
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(word))
    at = np.flatnonzero(left >= 2)
    pairs = pa.array(word[at] * v + word[at + 1]).dictionary_encode()
    distinct, pair = pairs.dictionary.to_numpy(zero_copy_only=False), pairs.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    hashes = _hashes(names)
    part = (_mixed(hashes[distinct // v] * ODD + hashes[distinct % v]) % np.uint64(parts)).astype(np.int64)
    order = np.lexsort((distinct, part))
    rank = np.empty_like(order)
    rank[order] = np.arange(len(order))
    pair, distinct, part = rank[pair], distinct[order], part[order]
    first, second = distinct // v, distinct % v
    whole = left[at] >= 3
    ends = np.bincount(pair[~whole], minlength=len(distinct))
    found, times = np.unique(pair[whole] * v + word[at[whole] + 2], return_counts=True)
    thirds = np.bincount(found // v, minlength=len(distinct))
    begin = np.flatnonzero(np.append(True, (first[1:] != first[:-1]) | (part[1:] != part[:-1]))[: len(first)])
    used, cut = np.unique(part, return_index=True)
    cut = np.append(cut, len(part))
    by_first, by_third = np.searchsorted(begin, cut), np.append(0, np.cumsum(thirds))[cut]
    columns = [(np.diff(np.append(begin, len(first))), by_first), (thirds, cut), (ends, cut), (times, by_third)]
    words = [(names.take(pa.array(x)), cuts) for x, cuts in ((first[begin], by_first), (second, cut), (found % v, by_third))]
    return _dealt(columns, words, used)


def windows(texts: DataFrame, text: str, parts: int) -> DataFrame:
    """The windows of texts, counted some megabytes at a time: packed, and not dealt yet."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for k in range(0, batch.num_rows, 100):
                held.append(batch.column(0).slice(k, 100).drop_null())
                size += held[-1].nbytes
                if size >= HELD_BYTES:
                    yield _windows(pa.concat_arrays(held), parts)
                    held, size = [], 0
        if held:
            yield _windows(pa.concat_arrays(held), parts)

    return texts.select(F.col(text).cast("string")).mapInArrow(run, PACKED)


def cache(docs: DataFrame, text: str, *which: Column) -> tuple[int, list[DataFrame]]:
    """The parts for the windows of all texts, and the windows of the texts that meet each condition, of all texts where there is none."""
    parts = parts_of(docs, text, PART_BYTES)
    return parts, [windows(own, text, parts) for own in ([docs.where(w) for w in which] or [docs])]


def _unpacked(value: bytes, k: int, of: int) -> tuple[list[np.ndarray], list[pa.StringArray]]:
    """The columns of a value of `_windows`, of its third words those of slice k."""
    numbers, words = _opened(value, 4, 3)
    if of > 1:
        own = _hashes(words[2]) % np.uint64(of) == k
        pair = np.repeat(np.arange(len(numbers[1])), numbers[1])
        numbers[1], numbers[3] = np.bincount(pair[own], minlength=len(numbers[1])), numbers[3][own]
        words[2] = words[2].filter(pa.array(own))
    return numbers, words


@dataclass
class Added:
    """Windows of a part, added up, by numbers of words: pairs with the times of both words and the texts that end so, windows with their pair."""

    names: pa.StringArray
    first: np.ndarray
    second: np.ndarray
    times: np.ndarray
    ends: np.ndarray
    pair: np.ndarray
    third: np.ndarray
    n: np.ndarray

    def words(self, numbers: np.ndarray) -> pa.StringArray:
        return self.names.take(pa.array(numbers))

    def grams(self, pairs: np.ndarray) -> pa.StringArray:
        return pc.binary_join_element_wise(self.words(self.first[pairs]), self.words(self.second[pairs]), " ")


def _added(values: list[bytes], k: int, of: int) -> Added:
    """Slice k of the values; texts that end with a pair count in slice 0."""
    opened = [_unpacked(value, k, of) for value in values]
    seconds, thirds, ends, times = (np.concatenate([numbers[i] for numbers, _ in opened]) for i in range(4))
    sizes = [sum(len(words[i]) for _, words in opened) for i in range(3)]
    coded = pa.chunked_array([words[i] for i in range(3) for _, words in opened]).dictionary_encode().combine_chunks()
    del opened  # which is as large as what is made of it
    names, word = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False)
    first, second, third = np.split(word, np.cumsum(sizes)[:2])
    v = np.int64(max(1, len(names)))
    pairs = pa.array(np.repeat(first, seconds) * v + second).dictionary_encode()
    distinct, pair = pairs.dictionary.to_numpy(zero_copy_only=False), pairs.indices.to_numpy(zero_copy_only=False)
    del pairs
    ends = np.bincount(pair, ends, len(distinct)).astype(np.int64)
    found = pa.array(np.repeat(pair, thirds) * v + third).dictionary_encode()
    window = found.dictionary.to_numpy(zero_copy_only=False)
    n = np.bincount(found.indices.to_numpy(zero_copy_only=False), times, len(window)).astype(np.int64)
    del found
    followed = np.bincount(window // v, n, len(distinct)).astype(np.int64)
    return Added(names, distinct // v, distinct % v, followed + ends if k == 0 else followed, ends, window // v, window % v, n)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[Added]:
    """The windows that a task gets, added up slice by slice."""
    values = [value for batch in batches for value in batch.column(1).to_pylist()]
    of = -(-sum(int.from_bytes(value[:8], "little") for value in values) // ADDED)
    yield from (_added(values, k, of) for k in range(of))


def _pairs(held: list[pa.Table]) -> pa.Table:
    """(gram, next, times) of pairs of words; those of several slices added up."""
    pairs = pa.concat_tables(held)
    return pairs if len(held) == 1 else pairs.group_by(["gram", "next"], use_threads=False).aggregate([("times", "sum")]).rename_columns(["gram", "next", "times"])


def _of_pairs(added: Added) -> pa.Table:
    own = np.flatnonzero(added.times)
    return pa.table({"gram": added.words(added.first[own]), "next": added.words(added.second[own]), "times": added.times[own]})


def _dealt_out(parts: int, caches: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.union, caches).repartitionById(parts, "part")


def merged_counts(parts: int, caches: list[DataFrame]) -> DataFrame:
    """(n, gram, next, times): the counts of all caches added up."""

    def rows(n: int, gram: pa.Array, following: pa.Array, times: pa.Array) -> Iterator[pa.RecordBatch]:
        table = pa.table([pa.array(np.full(len(gram), n, np.int32)), gram, following, times], ["n", "gram", "next", "times"])
        yield from table.to_batches(max_chunksize=SENT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for added in _slices(batches):
            yield from rows(2, added.grams(added.pair), added.words(added.third), pa.array(added.n))
            held.append(_of_pairs(added))
        if held:
            pairs = _pairs(held)
            yield from rows(1, pairs["gram"], pairs["next"], pairs["times"])

    return _dealt_out(parts, caches).mapInArrow(run, "n int, gram string, next string, times long")


def _best(group: np.ndarray, following: np.ndarray, names: pa.StringArray, times: np.ndarray) -> np.ndarray:
    """The place of each group's commonest next word, among equals the last in order of bytes."""
    rank = np.empty(len(names), dtype=np.int64)
    rank[pc.array_sort_indices(names).to_numpy()] = np.arange(len(names))
    order = np.lexsort((rank[following], times, group))
    return order[np.append(group[order][1:] != group[order][:-1], True)[: len(order)]]


def _combined(best: pa.Table) -> pa.Table:
    """(n, gram, next, top, total) of which each gram's best is left, with the sum of totals."""
    grams, following = (best[c].combine_chunks().dictionary_encode() for c in ("gram", "next"))
    n, top, total = (best[c].to_numpy() for c in ("n", "top", "total"))
    group = grams.indices.to_numpy().astype(np.int64) * 2 + n - 1
    at = _best(group, following.indices.to_numpy(), following.dictionary, top)
    sums = np.bincount(group, total).astype(np.int64)[group[at]] if len(at) else total
    return best.take(pa.array(at)).set_column(4, "total", pa.array(sums))


def drafts(parts: int, caches: list[DataFrame], least: list[int], percent: list[int], ends: bool = False) -> DataFrame:
    """(n, gram, draft): the commonest next word where a gram occurs often and points clearly enough; thresholds by n. ends: of two words, only those at the end of a text."""
    best_parts = -(-parts // BEST_PARTS)

    def clear(best: pa.Table, n: int) -> pa.Table:
        top, total = best["top"].to_numpy(), best["total"].to_numpy()
        return best.filter(pa.array((best["n"].to_numpy() != n) | (total >= least[n - 1]) & (100 * top >= percent[n - 1] * total)))

    def of_part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = lambda n, gram, following, top, total: pa.table({"n": np.full(len(gram), n), "gram": gram, "next": following, "top": top, "total": total})
        held, twos = [], []
        for added in _slices(batches):
            held.append(_of_pairs(added))
            own = np.flatnonzero(added.ends[added.pair]) if ends else np.arange(len(added.pair))
            at = own[_best(added.pair[own], added.third[own], added.names, added.n[own])]
            total = np.bincount(added.pair, added.n, len(added.first)).astype(np.int64)
            twos.append(table(2, added.grams(added.pair[at]), added.words(added.third[at]), added.n[at], total[added.pair[at]]))
        if not held:
            return
        pairs = _pairs(held)
        first, second = (pairs[c].combine_chunks().dictionary_encode() for c in ("gram", "next"))
        group, times = first.indices.to_numpy(), pairs["times"].to_numpy()
        at = _best(group, second.indices.to_numpy(), second.dictionary, times)
        ones = table(1, pairs["gram"].take(pa.array(at)), pairs["next"].take(pa.array(at)), times[at], np.bincount(group, times).astype(np.int64)[group[at]])
        two = pa.concat_tables(twos)
        best = pa.concat_tables([ones, clear(two if len(twos) == 1 else _combined(two), 2)])
        part = (_hashes(best["gram"].combine_chunks()) % np.uint64(best_parts)).astype(np.int64)
        best = best.take(pa.array(np.argsort(part, kind="stable")))
        used, cut = np.unique(part, return_counts=True)
        cut = np.append(0, np.cumsum(cut))
        yield _dealt([(best[c].to_numpy(), cut) for c in ("n", "top", "total")], [(best[c].combine_chunks(), cut) for c in ("gram", "next")], used)

    def of_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened = [_opened(value, 3, 2) for batch in batches for value in batch.column(1).to_pylist()]
        if not opened:
            return
        n, top, total = (np.concatenate([numbers[i] for numbers, _ in opened]).astype(np.int64) for i in range(3))
        gram, following = (pa.concat_arrays([words[i] for _, words in opened]) for i in range(2))
        best = _combined(pa.table({"n": n, "gram": gram, "next": following, "top": top, "total": total}))
        best = clear(clear(best, 1), 2)
        yield from pa.table([best["n"].cast(pa.int32()), best["gram"], best["next"]], ["n", "gram", "draft"]).to_batches(max_chunksize=SENT)

    packed = _dealt_out(parts, caches).mapInArrow(of_part, PACKED)
    return packed.repartitionById(best_parts, "part").mapInArrow(of_all, "n int, gram string, draft string")

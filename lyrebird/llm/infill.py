"""Fill-in-middle transformation through an index of distinct texts.

A text is cut into units, code points here, and its seeded cuts fall between units. Where the units
begin, in bytes, is a rising list; it is kept as an Elias-Fano list: low bits packed, high bits as a
bit set in which the i-th set bit stands at i plus the i-th high part, so that any boundary is found by
one select. Lists are built in the tasks that read the texts, once for each text a task holds; equal
texts meet by digest, are grouped by their content, and one list of each stays. Documents, without
their texts, are joined back to it, and each selects its own two cuts.

A text that more than one in HOT of all rows has is dealt under several salts, so that no task gets
all its documents; there are fewer than HOT such texts, whatever the table holds. A text crosses the
shuffle once for each task and salt.

Null texts are empty, which is a plain form with null cuts; so is a text with one of the sentinels in it.
Null doc_ids are seeded as an empty string, and rows that share a doc_id share their cuts' seed. Very
long texts are indexed whole, with memory of a few times their bytes. Rows are kept one for one, other
columns pass through, those named like an output are replaced. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lyrebird.llm.common import apart, cut, named_back, read, small_batches

SENTINELS = ("<P>", "<S>", "<M>")
SEED = 1
#: Of a hundred texts, how many are transformed, and of a hundred of these, how many put the suffix first.
RATE, SUFFIX_FIRST = 90, 20
#: A text is hot when more than one in HOT rows has it.
HOT = 256
#: Digests that a task remembers at most; beyond that a text may be indexed again.
SEEN = 1 << 17

OUTPUTS = ("n", "form", "prefix_chars", "middle_chars", "output")


class EliasFano:
    """A rising list of integers from 0 to `top`, in about 2 + log2(top / length) bits each."""

    def __init__(self, length: int, top: int, packed: bytes):
        self.length, self.low_bits = length, self.width(length, top)
        n_low = (length * self.low_bits + 7) // 8
        self.lows = np.frombuffer(packed, dtype=np.uint8, count=n_low)
        high = np.frombuffer(packed, dtype=np.uint8, offset=n_low)
        self.words = np.zeros((len(high) + 7) // 8 * 8, dtype=np.uint8)
        self.words[: len(high)] = high
        self.upto = np.cumsum(np.bitwise_count(self.words.view(np.uint64)), dtype=np.int64)

    @staticmethod
    def width(length: int, top: int) -> int:
        return max(0, ((top + 1) // max(1, length)).bit_length() - 1)

    @classmethod
    def pack(cls, values: np.ndarray, top: int) -> bytes:
        low_bits = cls.width(len(values), top)
        high = np.zeros((top >> low_bits) + len(values) + 1, dtype=np.uint8)
        high[(values >> low_bits) + np.arange(len(values))] = 1
        lows = (values[:, None] >> np.arange(low_bits)) & 1
        return np.packbits(lows.astype(np.uint8).reshape(-1), bitorder="little").tobytes() + np.packbits(high, bitorder="little").tobytes()

    def select(self, i: int) -> int:
        """The i-th value, from 0."""
        word = int(np.searchsorted(self.upto, i, side="right"))
        within = i - (int(self.upto[word - 1]) if word else 0)
        bits = np.unpackbits(self.words[8 * word : 8 * word + 8], bitorder="little")
        high = 64 * word + int(np.flatnonzero(bits)[within]) - i
        low = 0
        for k in range(self.low_bits):
            at = i * self.low_bits + k
            low |= (int(self.lows[at >> 3]) >> (at & 7) & 1) << k
        return high << self.low_bits | low


def starts_of(text: bytes) -> np.ndarray:
    """Where code points begin, in bytes."""
    return np.flatnonzero((np.frombuffer(text, dtype=np.uint8) & 0xC0) != 0x80)


def boundaries(text: bytes) -> tuple[int, bytes]:
    """The number of units, and the packed list of their starts and the text's end."""
    starts = starts_of(text)
    return len(starts), EliasFano.pack(np.append(starts, len(text)), len(text))


def numbers(doc_id: int | None, seed: int) -> list[int]:
    """Four seeded 32-bit numbers of a document."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]


def transformed(text: bytes, n: int, units: EliasFano, drawn: list[int], rate: int, suffix_first: int, sentinels: tuple[bytes, ...]) -> tuple[str, int | None, int | None, bytes]:
    """(form, units of the prefix, units of the middle, output)."""
    h1, h2, h3, h4 = drawn
    if not text or any(s in text for s in sentinels) or h3 % 100 >= rate:
        return "plain", None, None, text
    first, second = sorted((h1 % (n + 1), h2 % (n + 1)))
    a, b = units.select(first), units.select(second)
    p, s, m = sentinels
    if h4 % 100 < suffix_first:
        return "spm", first, second - first, b"".join((s, text[b:], p, text[:a], m, text[a:b]))
    return "psm", first, second - first, b"".join((p, text[:a], s, text[b:], m, text[a:b]))


def distinct_index(texts: DataFrame, ways: dict[bytes, int]) -> DataFrame:
    """(key, salt, text, n, units): one list for each distinct text and salt. texts: text; ways: salts of the hot keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            out = ([], [], [], [], [])
            for text in batch.column(0).cast(pa.binary()).to_pylist():
                key = hashlib.sha256(text).digest()
                if key in seen:
                    continue
                if len(seen) >= SEEN:
                    seen.clear()
                seen.add(key)
                n, units = boundaries(text)
                for salt in range(ways.get(key, 1)):
                    for column, value in zip(out, (key, salt, text, n, units), strict=True):
                        column.append(value)
            kinds = (pa.binary(), pa.int32(), pa.binary(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], ["key", "salt", "text", "n", "units"])

    built = small_batches(texts).mapInArrow(run, "key binary, salt int, text binary, n long, units binary")
    # grouping by the text itself verifies that equal digests mean equal texts; the layout by key and salt serves the join too
    return built.repartition("key", "salt").groupBy("key", "salt", "text").agg(F.first("n").alias("n"), F.first("units").alias("units"))


def fill_in_middle(docs: DataFrame, seed: int = SEED, rate: int = RATE, suffix_first: int = SUFFIX_FIRST, sentinels: tuple[str, str, str] = SENTINELS) -> DataFrame:
    """docs without `text`, plus n, form, prefix_chars, middle_chars and output, the transformed text."""
    own, names = apart(docs, "doc_id", "text")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    # the layout is deterministic once it is cut, so the salts are the same whenever a task is run again
    rows = cut(own.withColumn("key", F.unhex(F.sha2(text.cast("binary"), 256))).drop("text"))
    n_rows = rows.count()
    shares = rows.groupBy("key").agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") * HOT > n_rows)
    hot = {bytes(r["key"]): int(r["rows"] * HOT // n_rows + 1) for r in shares.collect()}  # fewer than HOT
    of_key = F.lit(1)
    if hot:
        of_key = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in hot.items() for x in pair]), F.col("key")), F.lit(1))
    salted = rows.withColumn("salt", F.pmod(F.monotonically_increasing_id(), of_key).cast("int"))
    joined = salted.join(distinct_index(own.select(text.alias("text")), hot), ["key", "salt"])
    carried = [c for c in own.columns if c != "text"]
    marks = tuple(s.encode() for s in sentinels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[bytes, EliasFano] = b"", EliasFano(1, 0, EliasFano.pack(np.zeros(1, dtype=np.int64), 0))
        for batch in batches:
            ids, texts, counts, lists = (batch.column(batch.schema.names.index(c)).to_pylist() for c in ("doc_id", "text", "n", "units"))
            found = []
            for doc_id, own_text, n, packed in zip(ids, texts, counts, lists, strict=True):
                if own_text != last[0]:  # the join's rows come in the order of their keys
                    last = own_text, EliasFano(n + 1, len(own_text), packed)
                found.append(transformed(own_text, n, last[1], numbers(doc_id, seed), rate, suffix_first, marks))
            made = [pa.array(c, k) for c, k in zip(zip(*found, strict=True) if found else ((), (), (), ()), (pa.string(), pa.int64(), pa.int64(), pa.binary()), strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(carried))), pa.array(counts, pa.int64()), *made[:3], made[3].cast(pa.string())], [*carried, *OUTPUTS])

    base = small_batches(joined).select(*carried, "text", "n", "units")
    schema = base.select(*carried, F.col("n"), F.lit(None).cast("string").alias("form"), F.lit(None).cast("long").alias("prefix_chars"), F.lit(None).cast("long").alias("middle_chars"), F.lit(None).cast("string").alias("output")).schema
    return named_back(base.mapInArrow(run, schema), {c: n for c, n in names.items() if c != "text"}, *OUTPUTS)


def restored(output: Column, form: Column, sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The text that an output stands for."""
    pieces = F.split(output, "|".join(f"\\Q{s}\\E" for s in sentinels), -1)
    return F.when(form == "psm", F.concat(pieces[1], pieces[3], pieces[2])).when(form == "spm", F.concat(pieces[2], pieces[3], pieces[1])).otherwise(output)


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = fill_in_middle(read(spark, sf_dir, "documents").select("doc_id", "text"))
    digest = [F.sha2(c.cast("binary"), 256).alias(name) for c, name in ((F.col("output"), "output_sha256"), (restored(F.col("output"), F.col("form")), "restored_sha256"))]
    return done.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digest)


OP11_SQL = r"""
WITH digests AS (
  SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, ''))::bigint AS n, sha256('1:' || coalesce(doc_id::varchar, '')) AS h FROM documents
), drawn AS (
  SELECT *, ('0x' || h[1:8])::ubigint AS h1, ('0x' || h[9:16])::ubigint AS h2, ('0x' || h[17:24])::ubigint AS h3, ('0x' || h[25:32])::ubigint AS h4 FROM digests
), formed AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1))::bigint AS a, greatest(h1 % (n + 1), h2 % (n + 1))::bigint AS b,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM drawn
), parts AS (
  SELECT *, substring(text, 1, a) AS p, substring(text, a + 1, b - a) AS m, substring(text, b + 1) AS s FROM formed
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM parts
"""

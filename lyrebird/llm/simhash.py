"""SimHash near-dedup with pivot distance tables.

A fingerprint has 64 bits; a bit is set when it is set in more than half of the XXH64 hashes (seed
42) of the text's 3-word shingles, repeats included. Texts whose fingerprints differ in at most
MOST_BITS bits are linked, and linked texts form components.

All texts with one fingerprint are one class, so the search runs over distinct fingerprints. Each
gets a table of its Hamming distances to reference fingerprints: zero, the 64 with one bit set, and
PIVOTS random ones. The coordinates of single bits, less that of zero, make the keys of cells: two
changed bits change two of them, hence any linked pair agrees in those of two quarters at least, and
meets in one of six cells. In a cell, a pair is discarded when a coordinate of a random reference
differs by more than MOST_BITS (the triangle inequality), and the survivors are verified.

A cell with more than CELL members would make too many pairs. Its members get references of their own:
each is listed under all fingerprints at distance one or less, 65 in all. By the triangle inequality's
other side, two fingerprints are within two bits of each other exactly if they share such a reference, and a reference has 65 members at
most, each linked to the smallest. Nothing is dropped.

With a similarity given, texts are linked by the exact Jaccard similarity of their sets of word
shingles. The fingerprints of the sets come first: pairs within NEAR_BITS, found by the same tables, in cells
of two of five parts, are verified on the shingles, and those that are similar are linked. Texts that share 80% of their shingles mostly
differ in 3 to 11 fingerprint bits and often in more, too far for blocks of bits, so the others follow:
they share one of BANDS bands of ROWS MinHash values (a pair at 0.8 is missed once in 20 million);
lengths, parities and one bit of each MinHash value discard most of the rest, and whatever is left is
verified likewise. Pairs inside one component, by fingerprints or by bands, tell nothing more; all others are
compared as `similar.linked` says, none is capped.

Null and empty texts have fingerprint zero and are linked like any other. A component's id is its
smallest doc_id that isn't null. Very long texts are hashed whole, in one row. Rows are kept one for
one, repeated rows included; `one_of_each` passes other columns through. Empty tables give no rows.
"""

from __future__ import annotations

import random
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lyrebird.llm.common import apart, components, cut, named_back, read, small_batches, written
from lyrebird.llm.similar import linked, node_of, sets_of, shingles, signature, similar_parity, similar_sizes, text_mark, verified
from lyrebird.llm.substrings import BASE_1, _Hashes, mixed

SHINGLE = 3
SEED = 42
MOST_BITS = 2
#: The same for sets of shingles whose similarity is verified afterwards; farther ones meet in bands.
NEAR_BITS = 3
PIVOTS = 32
CELL = 16
#: MinHash values of a text: BANDS times ROWS, which finds any similarity from LEAST_SIMILARITY on.
BANDS, ROWS = 32, 4
LEAST_SIMILARITY = 0.75
SKETCH = ("s0", "s1", "s2", "s3", "m0", "m1")


def signed(bits: int) -> int:
    return bits - (1 << 64) if bits >= 1 << 63 else bits


#: Zero, the single bits, and random fingerprints.
REFERENCES = [0, *[signed(1 << i) for i in range(64)], *[signed(random.Random(7).getrandbits(64) ^ random.Random(i).getrandbits(64)) for i in range(PIVOTS)]]

_FACTORS, _SHIFTS = np.random.default_rng(11).integers(0, 1 << 64, (2, BANDS * ROWS), dtype=np.uint64) | np.array([[1], [0]], dtype=np.uint64)


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in more than half of the hashes."""
    votes = np.zeros(64, dtype=np.int64)
    for k in range(0, len(hashes), 4096):
        votes += np.unpackbits(hashes[k : k + 4096].view(np.uint8), bitorder="little").reshape(-1, 64).sum(axis=0, dtype=np.uint16)
    return int(np.packbits(2 * votes > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprint(text: bytes) -> int:
    words = text.lower().split()  # bytes: A-Z only, and the six ASCII white-space characters
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= SHINGLE:
        return xxhash.xxh64_intdigest(joined, SEED)
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: 1 - SHINGLE].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, ends[SHINGLE - 1 :].tolist(), strict=True)), dtype=np.uint64, count=len(starts))
    return majority(hashes)


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fingerprint, as a signed long, of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t or b"") for t in batch.column(1).cast(pa.binary()).to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], ["doc_id", "fp"])

    return small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


def distance(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def placed(distinct: DataFrame, most_bits: int = MOST_BITS) -> DataFrame:
    """(fp, table, which, key): each distinct fingerprint in its cells, six for two bits, with its distances to the random references.

    A cell's key comes from the coordinates of two of most_bits + 2 parts, quarters for two bits: distances to the references
    with one bit set, less that to zero. Most_bits changed bits leave two parts as they are.
    """
    coordinates = F.array(*[distance(F.col("fp"), F.lit(r)).cast("byte") for r in REFERENCES])
    own = distinct.select("fp", coordinates.alias("all"))
    own = own.select("fp", F.slice("all", 66, PIVOTS).alias("table"), F.transform(F.slice("all", 2, 64), lambda c: c - F.col("all")[0]).alias("over"))
    ends = [64 * k // (most_bits + 2) for k in range(most_bits + 3)]
    parts = [F.slice("over", a + 1, b - a) for a, b in zip(ends, ends[1:], strict=False)]
    cells = F.explode(F.array(*[F.struct(F.lit(k).alias("which"), F.xxhash64(*two).alias("key")) for k, two in enumerate(combinations(parts, 2))]))
    return own.select("fp", "table", cells.alias("cell")).select("fp", "table", "cell.which", "cell.key")


def met(members: DataFrame) -> DataFrame:
    """(a, b, gap) of the pairs in cells of `placed`; gap: the largest difference of their tables."""
    left, right = (members.select("which", "key", F.col("fp").alias(n), F.col("table").alias(f"table_{n}")) for n in "ab")
    gap = F.array_max(F.zip_with("table_a", "table_b", lambda x, y: F.abs(x - y)))
    return left.join(right, ["which", "key"]).where("a < b").select("a", "b", gap.alias("gap"))


def links(distinct: DataFrame, cell: int = CELL, most_bits: int = MOST_BITS) -> DataFrame:
    """(a, b): enough pairs of the distinct fingerprints `fp` within most_bits to connect all that are linked; of more than two bits, those in crowded cells within two."""
    members = placed(distinct, most_bits)
    sizes = cut(members.groupBy("which", "key").agg(F.count(F.lit(1)).alias("size")).where("size > 1"))
    crowded = sizes.where(F.col("size") > cell).select("which", "key")
    sparse = members.join(sizes.where(F.col("size") <= cell), ["which", "key"])
    pairs = met(sparse).where(F.col("gap") <= most_bits).where(distance(F.col("a"), F.col("b")) <= most_bits).select("a", "b")
    near = F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit(signed(1 << i))) for i in range(64)])
    listed = members.join(crowded, ["which", "key"]).select("fp").distinct().select("fp", F.explode(near).alias("reference"))
    shared = listed.groupBy("reference").agg(F.collect_set("fp").alias("members")).where("size(members) > 1")
    stars = shared.select(F.array_min("members").alias("a"), F.explode("members").alias("b")).where("a < b")
    return pairs.union(stars).distinct()


def minhashes(found: np.ndarray) -> np.ndarray:
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for k in range(0, len(found), 512):
        least = np.minimum(least, (found[k : k + 512, None] * _FACTORS + _SHIFTS).min(axis=0))
    return least


def sketches(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, mark (of the text), fp (the number of the text's set), its n shingles and their fingerprint `near`, keys of its bands, s0 to s3 (the set's signature), and m0 and m1, one bit of each MinHash value."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _Hashes()
        for batch in batches:
            sets = [shingles(t or b"", width, hashes) for t in batch.column(2).cast(pa.binary()).to_pylist()]
            least = np.array([minhashes(s) for s in sets], dtype=np.uint64).reshape(len(sets), BANDS, ROWS)
            code = np.tile(np.arange(BANDS, dtype=np.uint64), (len(sets), 1))
            for row in range(ROWS):
                code = mixed(code * BASE_1 + least[:, :, row])
            bits = np.packbits((mixed(least.reshape(len(sets), -1)) >> np.uint64(63)).astype(np.uint8), axis=1).view(np.int64)
            keys = [c if len(s) else c[:0] for c, s in zip(code.view(np.int64), sets, strict=True)]
            parity = np.array([signature(s) for s in sets], dtype=np.int64).reshape(-1, 4)
            near = np.array([majority(s) for s in sets], dtype=np.uint64).view(np.int64)
            columns = [pa.array([node_of(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array(near), pa.array(keys, pa.list_(pa.int64())), *map(pa.array, parity.T), pa.array(bits[:, 0]), pa.array(bits[:, 1])]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], ["doc_id", "mark", "fp", "n", "near", "bands", *SKETCH])

    rows = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), text_mark(F.col("text")).alias("mark"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, mark long, fp long, n long, near long, bands array<long>, " + ", ".join(f"{c} long" for c in SKETCH))


def _key_column(text: Column, width: int) -> Column:
    @F.pandas_udf("long")
    def key_of(text: pd.Series) -> pd.Series:
        hashes = _Hashes()
        return pd.Series([node_of(shingles((t or "").encode(), width, hashes)) for t in text], dtype="int64")

    return key_of(text.cast("string"))


def near_pairs(distinct: DataFrame) -> DataFrame:
    """(a, b), a < b: nodes `fp` whose fingerprints `near` are within NEAR_BITS, of those with equal ones the smallest and each other."""
    classes = written(distinct.where("n > 0").groupBy("near").agg(F.min("fp").alias("least"), F.count(F.lit(1)).alias("size")))
    found = links(classes.select(F.col("near").alias("fp")), most_bits=NEAR_BITS)
    left, right = (classes.select(F.col("near").alias(c), F.col("least").alias(f"node_{c}")) for c in "ab")
    farther = found.join(left, "a").join(right, "b").select("node_a", "node_b")
    equal = distinct.where("n > 0").join(classes.where("size > 1").select("near", "least"), "near").where("fp != least").select("fp", "least")
    return farther.union(equal).toDF("x", "y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def similar_components(distinct: DataFrame, docs: DataFrame, rows: DataFrame, width: int, similarity: float) -> DataFrame:
    """(node, component) of the sets that are linked by similarity; distinct: fp, n, near, bands and the sketch of each; rows: (mark, node) of docs."""
    p, percent = (1 - similarity) / 2, round(100 * similarity, 6)
    most_bits = int(np.ceil(BANDS * ROWS * p + 6 * np.sqrt(BANDS * ROWS * p * (1 - p))))

    def may_be(a: Column, b: Column) -> Column:
        return similar_sizes(a, b, percent) & similar_parity(a, b, percent) & (distance(a["m0"], b["m0"]) + distance(a["m1"], b["m1"]) <= most_bits)

    spread = distinct.select("fp", "n", *SKETCH, F.posexplode("bands").alias("at", "key"))
    members = spread.select("key", F.struct(F.col("fp").alias("node"), "n", "at", *SKETCH).alias("x"))
    shared = members.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1").select("key")
    lists = written(members.join(shared, "key"))
    near = written(near_pairs(distinct))
    nodes = written(lists.select("x.node").union(near.select("a")).union(near.select("b")).distinct())
    sets = sets_of(docs, rows, nodes, width)
    return linked(lists, may_be, sets, percent, (near, written(verified(near, sets, percent))))[0]


def near_duplicates(docs: DataFrame, width: int = SHINGLE, similarity: float | None = None) -> DataFrame:
    """doc_id, fp, component_id and `root` of each row; root, a fingerprint, names the component even where no row has a doc_id.

    Without a similarity, linked texts have fingerprints of SHINGLE words within MOST_BITS; with one, sets of
    `width`-word shingles with that Jaccard similarity at least, and fp is a number of the text's set.
    """
    if similarity is None and width != SHINGLE or similarity is not None and not LEAST_SIMILARITY <= similarity <= 1:
        raise ValueError(f"near_duplicates: {width} words, similarity {similarity}")
    if similarity is None:
        prints = cut(fingerprints(docs))
        classes = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
        found = components(links(classes.select("fp")))
    else:
        sketched = cut(sketches(docs, width))
        prints = sketched.select("doc_id", "fp")
        classes = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
        once = sketched.groupBy("fp").agg(*[F.first(c).alias(c) for c in ("n", "near", "bands", *SKETCH)])
        found = similar_components(once, docs, sketched.select("mark", F.col("fp").alias("node")), width, similarity)
    placed = classes.join(found, classes["fp"] == found["node"], "left").select("fp", "least", F.coalesce("component", "fp").alias("root"))
    named = placed.join(placed.groupBy("root").agg(F.min("least").alias("component_id")), "root")
    # without its known layout, so that the rows of a hot fingerprint can be dealt to several tasks
    named = cut(named.select("fp", "component_id", "root")).select(F.col("fp").bitwiseXOR(F.lit(0)).alias("fp"), "component_id", "root")
    return prints.join(named, "fp").select("doc_id", "fp", "component_id", "root")


def one_of_each(docs: DataFrame, width: int = SHINGLE, similarity: float | None = None) -> DataFrame:
    """Of each component one row: with the smallest doc_id, null last; of several such, the smallest fingerprint, then text hash."""
    found = near_duplicates(docs, width, similarity)
    best = found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "fp")).alias("best"))
    none = F.lit(signed(1 << 63))  # stands for a null doc_id
    kept = cut(best.select(F.coalesce("best.doc_id", none).alias("_id"), F.col("best.fp").alias("_fp")))

    @F.pandas_udf("long")
    def print_of(text: pd.Series) -> pd.Series:
        return pd.Series([signed(fingerprint((t or "").encode())) for t in text], dtype="int64")

    own, names = apart(docs, "doc_id", "text")
    fp = print_of(F.col("text").cast("string")) if similarity is None else _key_column(F.col("text"), width)
    keyed = own.withColumns({"_id": F.coalesce(F.col("doc_id").cast("long"), none), "_fp": fp})
    rows = keyed.join(kept, ["_id", "_fp"], "left_semi")
    order = Window.partitionBy("_id", "_fp").orderBy(F.xxhash64(*own.columns))
    return named_back(rows.withColumn("_row", F.row_number().over(order)).where("_row = 1"), names)


def op1_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")

"""N-gram Jaccard join by rare-first prefixes.

A document's set holds its distinct shingles. Two documents link when 100 * intersection is at least
`percent` times the union. Equal sets are one node, so copies cost nothing further.

Shingles are put in one order for all documents: first those that are eligible, one in ELIGIBLE by
hash, from rare to frequent by their exact number of documents, then the others by hash. Similar
sets share one of the first n - ceil(percent * n / 100) + 1 shingles of each. Only eligible shingles
need to be counted: of a set's shingles they are more than a prefix holds, but in small sets, whose
prefixes go on into the others. A shingle that one document has comes first, pairs with nothing and
is never sent: a set with enough of them can't have a partner and drops out.

The prefix shingles are the keys of lists. Two members of a list meet only if the length filter
(sizes), the positional filter (what their sets still hold behind the shared shingle) and the suffix filter
(the parity of their counts in 256 ranges of hashes) admit them, each pair is verified once, and
`similar.linked` finds the components without all pairs of a list.

Null and empty texts and those without words have an empty set and no link, repeated rows included; their
component is their own doc_id. A null doc_id is never a component's id unless all its documents have none.
Nodes are 64-bit numbers of sets. Very long texts are hashed in stretches, one set in memory at a time.
Rows are kept one for one; columns but doc_id and text are ignored. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lyrebird.llm.common import may_hold, pack_filter, read, small_batches, written
from lyrebird.llm.similar import SEEN, least_overlap, linked, node_of, sets_of, shingles, signature, similar_parity, similar_sizes, text_mark
from lyrebird.llm.substrings import _Hashes

WIDTH, PERCENT = 3, 90
SIGNATURE = ("s0", "s1", "s2", "s3")


def eligible_share(percent: int) -> int:
    """One in how many shingles is eligible: 2.5 times what a prefix needs, as a power of two."""
    return 1 << max(0, int(np.log2(100 / (2.5 * max(100 - percent, 1)))))


def prefix_length(n: np.ndarray | int, percent: int):
    return n + percent * -n // 100 + 1


def can_link(n: int, percent: int) -> bool:
    """Whether a set of this size may be similar to another than itself."""
    return -(-percent * n // 100) < n or 100 * n // percent > n


def prepared(docs: DataFrame, width: int, percent: int, every: int) -> DataFrame:
    """doc_id, mark (of the text), node, n, n_eligible and the signature s0 to s3 of each row.

    Where the set can link and the task hasn't met it yet, also `keys`, its eligible shingles, and `others`,
    the first of the others where the eligible ones don't fill a prefix.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, seen = _Hashes(), set()
        for batch in batches:
            rows, keys, others = [], [], []
            for text in batch.column(2).cast(pa.binary()).to_pylist():
                own = shingles(text or b"", width, hashes)
                node, fits = node_of(own), own & np.uint64(every - 1) == 0
                n_fit = int(np.count_nonzero(fits))
                rows.append((node, len(own), n_fit, *signature(own).tolist()))
                fresh = can_link(len(own), percent) and node not in seen
                if fresh:
                    if len(seen) >= SEEN:
                        seen.clear()
                    seen.add(node)
                keys.append(own[fits].view(np.int64) if fresh else None)
                others.append(own[~fits][: max(0, prefix_length(len(own), percent) - n_fit)].view(np.int64) if fresh else None)
            columns = np.array(rows, dtype=np.int64).reshape(-1, 7).T
            lists = (pa.array(x, pa.list_(pa.int64())) for x in (keys, others))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *map(pa.array, columns), *lists], ["doc_id", "mark", "node", "n", "n_eligible", *SIGNATURE, "keys", "others"])

    rows = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), text_mark(F.col("text")).alias("mark"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, mark long, node long, n long, n_eligible long, s0 long, s1 long, s2 long, s3 long, keys array<long>, others array<long>")


def prefixes(rows: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """(key, node, at): the repeated shingles of each set's prefix and their place in the order, from 0."""
    eligible = rows.select(F.explode("keys").alias("key"))
    repeated = written(eligible.groupBy("key").agg(F.count(F.lit(1)).alias("df")).where("df > 1"))
    bits, log_bits = pack_filter(repeated, "key")
    shipped = rows.sparkSession.sparkContext.broadcast(bits)  # 32 MB at most; where it is crowded, more rows are sent

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.frombuffer(shipped.value, dtype=np.uint8)
        for batch in batches:
            keys = batch.column(1).combine_chunks() if isinstance(batch.column(1), pa.ChunkedArray) else batch.column(1)
            flat = keys.flatten().to_numpy()
            of = np.repeat(batch.column(0).to_numpy(), np.diff(keys.offsets.to_numpy()))
            held = may_hold(table, log_bits, flat.view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(of[held]), pa.array(flat[held])], ["node", "key"])

    fresh = rows.where("keys IS NOT NULL")
    sent = fresh.select("node", "keys").mapInArrow(run, "node long, key long")
    # tasks that share a set send it more than once
    ranked = sent.join(repeated, "key").groupBy("node").agg(F.array_sort(F.collect_set(F.struct("df", "key"))).alias("own"))
    placed = ranked.join(nodes.select("node", "n", "n_eligible"), "node")
    alone = (F.col("n_eligible") - F.size("own")).cast("int")  # shingles that no other set has come first
    room = (F.col("n") - F.ceil(F.col("n") * percent / 100.0 - 1e-9) + 1).cast("int") - alone
    first = placed.where(room > 0).select("node", alone.alias("alone"), F.posexplode(F.slice("own", F.lit(1), room)).alias("i", "one"))
    rest = fresh.select("node", "n_eligible", F.posexplode("others").alias("i", "key")).select("key", "node", (F.col("n_eligible") + F.col("i")).alias("at"))
    return first.select("one.key", "node", (F.col("alone") + F.col("i")).cast("long").alias("at")).union(rest.distinct())


def admits(percent: int):
    """Length, positional and suffix filter of two members x of a list."""

    def may_be(a: Column, b: Column) -> Column:
        n_a, n_b = a["n"], b["n"]
        # where this is the first shingle they share, nothing before it is shared; elsewhere the pair meets at an earlier one too
        behind = 1 + F.least(n_a - a["at"] - 1, n_b - b["at"] - 1)
        return similar_sizes(a, b, percent) & (behind >= least_overlap(n_a, n_b, percent)) & similar_parity(a, b, percent)

    return may_be


def similar_sets(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """Of docs (doc_id, text): rows (doc_id, node, n), membership (node, component), and links (a, b) that join them; None where there are none."""
    if not 50 <= percent <= 100:
        raise ValueError(f"similar_sets: {percent} percent")
    every = eligible_share(percent)
    docs = docs.select("doc_id", "text")
    rows = written(prepared(docs, width, percent, every))
    nodes = written(rows.groupBy("node").agg(*[F.first(c).alias(c) for c in ("n", "n_eligible", *SIGNATURE)]))
    keyed = written(prefixes(rows, nodes, percent))
    shared = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("members")).where("members > 1").select("key")
    kept = keyed.join(shared, "key").join(nodes, "node")
    lists = written(kept.select("key", F.struct("node", "n", "at", *SIGNATURE).alias("x")))
    if lists.isEmpty():
        found, links = rows.select("node", F.col("node").alias("component")).limit(0), None
    else:
        sets = sets_of(docs, rows, written(lists.select("x.node").distinct()), width)
        found, links = linked(lists, admits(percent), sets, percent)
    return rows.select("doc_id", "node", "n"), found, links


def jaccard_components(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles and component_id of each row."""
    rows, found, _ = similar_sets(docs, width, percent)
    least = written(rows.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("least")))
    placed = least.join(found, "node", "left").select("node", "least", F.coalesce("component", "node").alias("component"))
    named = placed.join(placed.groupBy("component").agg(F.min("least").alias("component_id")), "component")
    # without its known layout, so that the rows of a hot node can be dealt to several tasks
    named = written(named.select("node", "component_id"))
    with_words = rows.where("n > 0").join(named, "node").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return with_words.union(rows.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def op13_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(read(spark, sf_dir, "documents"))

"""Components of sets of shingles under a Jaccard threshold, from lists of sets that may be similar.

A list holds the nodes that share a key: a prefix shingle, or a band of MinHash values. Only the
components of similar nodes are asked for, so pairs inside one component tell nothing more, and a
list is never expanded into all its pairs:

1. in each list that mixes components, every node meets HEADS nodes of the list, the same ones in
   most lists of a group, in ROUNDS rounds; later rounds meet the list's largest component only;
2. then the nodes outside a list's largest component meet all nodes of other components, dealt in
   chunks of CHUNK of them. Pairs that the filters discard never become rows, and similar nodes, which
   share most of their lists, become a row in the first list they share, not in each: a node
   knows the first EARLY of its lists, and a pair that has met in one of these is passed over.

A list of k nodes of which u stay outside takes k * HEADS * ROUNDS + k * u looks at two sizes and 256
bits each, and what passes is verified once on the sets. Nothing is capped.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lyrebird.llm.common import components, may_hold, pack_filter, small_batches, written
from lyrebird.llm.substrings import BASE_1, _Hashes, mixed, rolled

HEADS, ROUNDS, CHUNK = 2, 2, 1000
#: Lists of a node, the first in its order, that tell whether a pair has met before.
EARLY = 8
#: Nodes whose rows a task remembers, so as to send each once.
SEEN = 1 << 18

Admits = Callable[[Column, Column], Column]


def shingles(text: bytes, width: int, hashes: _Hashes) -> np.ndarray:
    """The distinct hashes of a text's shingles, rising; of fewer words than `width`, of all of them."""
    words = hashes.of(text.lower())  # bytes: A-Z only
    return np.unique(mixed(rolled(words, min(width, len(words)), BASE_1))) if len(words) else words


def node_of(found: np.ndarray) -> int:
    """One 64-bit number for all texts with the same set of shingles, zero for none."""
    if not len(found):
        return 0
    with np.errstate(over="ignore"):
        return int(mixed(np.array([np.bitwise_xor.reduce(found) * BASE_1 + np.add.reduce(mixed(found + BASE_1)) + np.uint64(len(found))], dtype=np.uint64)).view(np.int64)[0])


def signature(found: np.ndarray) -> np.ndarray:
    """256 bits as four numbers: of each of 256 ranges of hashes, whether the set has an odd number in it."""
    odd = np.bincount((found >> np.uint64(56)).astype(np.int64), minlength=256) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def least_overlap(n_a: Column, n_b: Column, percent: int) -> Column:
    """The smallest intersection with which 100 * intersection >= percent * union."""
    return F.ceil((n_a + n_b) * percent / F.lit(100.0 + percent) - 1e-9)


def similar_sizes(a: Column, b: Column, percent: int) -> Column:
    """Length filter."""
    return 100 * F.least(a["n"], b["n"]) >= percent * F.greatest(a["n"], b["n"])


def similar_parity(a: Column, b: Column, percent: int) -> Column:
    """Suffix filter: each range in which one set has an odd and the other an even number of shingles holds a shingle of one of them alone."""
    differing = sum((F.bit_count(a[f"s{k}"].bitwiseXOR(b[f"s{k}"])) for k in range(4)), F.lit(0))
    return differing <= a["n"] + b["n"] - 2 * least_overlap(a["n"], b["n"], percent)


def text_mark(text: Column) -> Column:
    """A number of a text by which rows are told apart before their texts are looked at."""
    return F.xxhash64(F.coalesce(text.cast("string"), F.lit("")))


def sets_of(docs: DataFrame, rows: DataFrame, nodes: DataFrame, width: int) -> DataFrame:
    """(node, members): the sorted hashes of the sets of `nodes` (node), written once. A task sends a set once.

    rows: (mark, node) of each row of docs; only texts whose mark belongs to one of the nodes are looked at.
    """
    bits, log_bits = pack_filter(rows.join(nodes.select("node"), "node", "left_semi").select("mark").distinct(), "mark")
    shipped = docs.sparkSession.sparkContext.broadcast(bits)  # 32 MB at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, table, seen = _Hashes(), np.frombuffer(shipped.value, dtype=np.uint8), set()
        for batch in batches:
            own = may_hold(table, log_bits, batch.column(0).to_numpy().view(np.uint64))
            ids, sets = [], []
            for text in batch.column(1).filter(pa.array(own)).cast(pa.binary()).to_pylist():
                members = shingles(text or b"", width, hashes)
                node = node_of(members)
                if node not in seen:
                    if len(seen) >= SEEN:
                        seen.clear()
                    seen.add(node)
                    ids.append(node)
                    sets.append(members.view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sets, pa.list_(pa.int64()))], ["node", "members"])

    texts = small_batches(docs).select(text_mark(F.col("text")).alias("mark"), F.col("text").cast("string").alias("text"))
    sent = texts.mapInArrow(run, "node long, members array<long>").join(nodes.select("node"), "node", "left_semi")
    return written(sent.groupBy("node").agg(F.first("members").alias("members")))


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets are similar."""
    left, right = (sets.select(F.col("node").alias(c), F.col("members").alias(f"set_{c}")) for c in "ab")
    both = F.size(F.array_intersect("set_a", "set_b"))
    return pairs.join(left, "a").join(right, "b").where(100 * both >= percent * (F.size("set_a") + F.size("set_b") - both)).select("a", "b")


def _ordered(met: DataFrame) -> DataFrame:
    return met.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct()


def met_once(rows: DataFrame, admits: Admits) -> DataFrame:
    """(x, y): the nodes outside their list's largest part and those of other parts that `admits` lets pass; rows: key, x, part, top, outside.

    Where both have an earlier list in common, they are left to that one: it is open too, as their parts differ.
    """
    chunks = F.ceil(F.col("outside") / CHUNK).cast("int")
    order = rows.groupBy(F.col("x.node").alias("_node")).agg(F.slice(F.array_sort(F.collect_list(F.struct(F.col("x.at").alias("at"), "key"))), 1, EARLY).alias("f"))
    own = rows.join(order.select("_node", F.col("f.key").alias("first")), F.col("x.node") == F.col("_node"))
    place = F.array_position("first", F.col("key")).cast("int")
    own = own.withColumn("early", F.when(place > 0, F.slice("first", F.lit(1), place - 1)).otherwise(F.col("first")))
    left = own.where("part != top").select("key", F.pmod(F.xxhash64("x.node"), chunks).cast("int").alias("chunk"), "x", "part", "early")
    right = own.select("key", F.explode(F.sequence(F.lit(0), chunks - 1)).alias("chunk"), F.col("x").alias("y"), F.col("part").alias("other"), (F.col("part") == F.col("top")).alias("inside"), F.col("early").alias("early_y"))
    # of two that are both outside the smaller one asks
    asks = F.col("inside") | (F.col("x.node") < F.col("y.node"))
    return left.join(right, ["key", "chunk"]).where("part != other").where(asks & admits(F.col("x"), F.col("y")) & ~F.arrays_overlap("early", "early_y")).select("x", "y")


def linked(lists: DataFrame, admits: Admits, sets: DataFrame, percent: int, before: tuple[DataFrame, DataFrame] | None = None) -> tuple[DataFrame, DataFrame | None]:
    """(node, component) of nodes with links, and the links (a, b) that were verified, None where no list has two nodes.

    before: pairs (a, b) that were tried already, and the links among them.

    lists: key, x, where x is a struct of node, `at` and what `admits` needs of it; `admits` says of two such
    structs whether they may be similar. By `at` a node's lists have the same order as those of any other node.
    """
    tried, links = before or (None, None)
    found = None if links is None else components(links)
    for turn in range(ROUNDS + 1):
        if found is None:
            placed = lists.select("key", "x", F.col("x.node").alias("part"))
        else:
            placed = lists.join(found, F.col("x.node") == found["node"], "left").select("key", "x", F.coalesce("component", "x.node").alias("part"))
        # several tasks share a long list: its parts are counted before they meet
        parts = placed.groupBy("key", "part").agg(F.count(F.lit(1)).alias("size"))
        sizes = parts.groupBy("key").agg(F.count(F.lit(1)).alias("n_parts"), F.sum("size").alias("size"), F.max_by("part", F.struct("size", "part")).alias("top"), F.max("size").alias("top_size"))
        open_lists = written(sizes.where("n_parts > 1").select("key", "top", (F.col("size") - F.col("top_size")).alias("outside")))
        if open_lists.isEmpty():
            break
        rows = written(placed.join(open_lists, "key"))
        outside = F.col("part") != F.col("top")
        if turn < ROUNDS:
            orders = [F.xxhash64("x.node", F.lit(turn * HEADS + k)) for k in range(HEADS)]
            # in the first round everything may be a head, later what the largest part has
            heads = rows if not turn else rows.where(~outside)
            ends = heads.groupBy("key").agg(F.array_distinct(F.array(*[F.min_by(F.struct("x", "part"), o) for o in orders])).alias("heads"))
            met = rows.join(ends, "key").select("x", "part", F.explode("heads").alias("head")).select("x", "part", F.col("head.x").alias("y"), F.col("head.part").alias("other"))
            met = met.where("part != other").where(admits(F.col("x"), F.col("y")))
        else:
            met = met_once(rows, admits)
        pairs = _ordered(met)
        pairs = written(pairs if tried is None else pairs.join(tried, ["a", "b"], "left_anti"))
        if pairs.isEmpty():
            continue
        more = written(verified(pairs, sets, percent))
        tried = pairs if tried is None else tried.union(pairs)
        links = more if links is None else links.union(more)
        found = components(links)
    if found is None:
        none = lists.select(F.col("x.node").alias("node"), F.col("x.node").alias("component")).limit(0)
        return none, links
    return found, links

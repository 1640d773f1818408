import random
import re
from itertools import combinations

import numpy as np
import xxhash
from pyspark.sql import functions as F

from lyrebird.llm import simhash
from lyrebird.llm.common import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_fingerprint(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(lowered)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints, most=2):
    distinct = sorted(set(prints.values()))
    parent = {p: p for p in distinct}

    def root(p):
        while parent[p] != p:
            p = parent[p]
        return p

    for a, b in combinations(distinct, 2):
        if (a ^ b).bit_count() <= most:
            parent[root(a)] = root(b)
    return {p: root(p) for p in distinct}


def test_fingerprints_and_components(docs, corpus):
    rows = simhash.near_duplicates(docs).collect()
    prints = {(i, t): brute_fingerprint(t) for i, (_, t, *_) in enumerate(corpus)}
    roots = brute_components(prints)
    least = {}
    for i, (doc_id, text, *_) in enumerate(corpus):
        if doc_id is not None:
            root = roots[prints[i, text]]
            least[root] = min(doc_id, least.get(root, doc_id))
    expected = sorted((str(d), prints[i, t], least.get(roots[prints[i, t]])) for i, (d, t, *_) in enumerate(corpus))
    assert sorted((str(r.doc_id), r.fp % (1 << 64), r.component_id) for r in rows) == expected


def test_spark_hash_is_the_same(spark):
    texts = ["a b c", "é ñ z", "x" * 100]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(F.xxhash64("t").alias("h")).collect()
    assert [r.h % (1 << 64) for r in got] == [xxhash.xxh64_intdigest(t.encode(), 42) for t in texts]


def test_links_in_crowded_and_sparse_cells(spark):
    rng = random.Random(3)
    centre, distinct = rng.getrandbits(64), set()
    for _ in range(300):  # a crowd around one fingerprint, and chains
        x = centre
        for _ in range(rng.randint(0, 4)):
            x ^= 1 << rng.randrange(64)
        distinct.add(x)
    for _ in range(200):
        x = rng.getrandbits(64)
        distinct |= {x, x ^ 1 << rng.randrange(64), x ^ 1 << rng.randrange(64) ^ 1 << rng.randrange(64)}
    table = spark.createDataFrame([(simhash.signed(x),) for x in distinct], "fp long")
    roots = brute_components({x: x for x in distinct})
    for cell in (1, 16, 10_000):
        edges = simhash.links(table, cell).collect()
        assert all(((r.a ^ r.b) % (1 << 64)).bit_count() <= 2 for r in edges)
        parent = {x: x for x in distinct}

        def root(p):
            while parent[p] != p:
                p = parent[p]
            return p

        for r in edges:
            parent[root(r.a % (1 << 64))] = root(r.b % (1 << 64))
        ours, theirs = {}, {}
        for x in distinct:
            ours.setdefault(root(x), set()).add(x)
            theirs.setdefault(roots[x], set()).add(x)
        assert sorted(map(sorted, ours.values())) == sorted(map(sorted, theirs.values()))


def test_components_of_a_long_chain_and_of_nothing(spark, no_docs):
    order = list(range(200))
    random.Random(1).shuffle(order)
    chain = [(order[i], order[i + 1]) for i in range(199)] + [(1000, 1001), (1001, 1000), (1001, 1001), (None, 3)]
    found = {r.node: r.component for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert found == {**dict.fromkeys(range(200), 0), 1000: 1000, 1001: 1000}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
    assert simhash.near_duplicates(no_docs).count() == 0


def test_long_text_votes():
    rng = np.random.default_rng(0)
    text = " ".join(rng.choice(["aa", "b", "ccc", "é"], 9001))
    assert simhash.fingerprint(text.encode()) == brute_fingerprint(text)


def test_the_table_discards_pairs_that_are_far_apart(spark):
    """Fingerprints that agree in two quarters; prints how many pairs the random references' coordinates discard."""
    rng = random.Random(3)
    half = rng.getrandbits(32)
    prints = [simhash.signed(rng.getrandbits(32) << 32 | half) for _ in range(400)]
    pairs = simhash.met(simhash.placed(spark.createDataFrame([(p,) for p in prints], "fp long"))).collect()
    kept = [r for r in pairs if r.gap <= simhash.MOST_BITS]
    near = {(r.a, r.b) for r in pairs if ((r.a ^ r.b) & (2**64 - 1)).bit_count() <= simhash.MOST_BITS}
    print(f"{len(pairs)} pairs met, {len(pairs) - len(kept)} discarded by the table")
    assert len(pairs) >= 400 * 399 // 2 and near <= {(r.a, r.b) for r in kept} and len(kept) < len(pairs) // 100

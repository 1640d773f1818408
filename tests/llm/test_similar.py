"""The pipeline's near-dedup stage against brute-force Jaccard similarity of 5-word shingles."""

import random
from itertools import combinations

import corpus_pipeline
import numpy as np
import pytest

from lyrebird.llm import simhash, similar


def words_of(text):
    return tuple((text or "").lower().split())


def brute_kept(rows):
    texts = sorted({words_of(r[1]) for r in rows})
    sets = [{w[i : i + 5] for i in range(max(1, len(w) - 4))} if w else set() for w in texts]
    parent = list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in combinations(range(len(texts)), 2):
        if sets[i] and sets[j] and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8:
            parent[root(i)] = root(j)
    best = {}
    for r in rows:
        k = root(texts.index(words_of(r[1])))
        best[k] = min(best.get(k, r[0]), r[0])
    return sorted(best.values())


def test_edited_copies_go(spark):
    rng = random.Random(4)
    vocabulary = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 9))) for _ in range(500)]
    texts = [" ".join(rng.choices(vocabulary, k=rng.randint(40, 300))) for _ in range(60)]
    for i in range(150):  # copies with a few words changed, on both sides of the bound
        words = texts[i % 40].split()
        for _ in range(rng.randint(1, max(1, len(words) // 30))):
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        texts.append(" ".join(words).upper() if i % 5 == 0 else " ".join(words))
    chain = rng.choices(vocabulary, k=120)
    for _ in range(30):  # a chain of edits: its ends share little
        chain = [*chain[3:], *rng.choices(vocabulary, k=3)]
        texts.append(" ".join(chain))
    head = rng.choices(vocabulary, k=80)
    texts += [" ".join(head + rng.choices(vocabulary, k=40)) for _ in range(20)]  # share much, but too little
    texts += [None, "", " \n", "a b", "A  b", "a b c", texts[0], texts[1]]
    rows = [(i, t, "en", "a", None) for i, t in enumerate(texts)]
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    kept = corpus_pipeline.near_duplicates(spark, docs, "")
    expected = brute_kept(rows)
    assert sorted(r.doc_id for r in kept.collect()) == expected and len(expected) < len({words_of(t) for t in texts}) - 50
    assert corpus_pipeline.near_duplicates(spark, docs.limit(0), "").count() == 0


def test_fingerprints_link_near_copies_before_bands(spark, monkeypatch):
    """The stage's pairs within NEAR_BITS, against brute force; they are verified and linked where no band is looked at."""
    rng = random.Random(6)
    vocabulary = ["".join(rng.choices("abcdefghij", k=6)) for _ in range(500)]
    texts = [" ".join(rng.choices(vocabulary, k=300)) for _ in range(20)]
    for i in range(60):
        words = texts[i % 20].split()
        words[rng.randrange(300)] = rng.choice(vocabulary)
        texts.append(" ".join(words))
    docs = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, None, "", texts[0]])], "doc_id long, text string")
    once = simhash.sketches(docs, 5).drop("doc_id", "mark").distinct()
    rows = [(r.fp, r.near) for r in once.where("n > 0").collect()]
    within = {tuple(sorted((a, b))) for (a, x), (b, y) in combinations(rows, 2) if ((x ^ y) & (2**64 - 1)).bit_count() <= simhash.NEAR_BITS}
    found = {(r.a, r.b) for r in simhash.near_pairs(once).collect()}
    root = {}
    for pairs in (found, within):
        parent = {n: n for n, _ in rows}

        def find(n, parent=parent):
            while parent[n] != n:
                n = parent[n]
            return n

        for a, b in pairs:
            parent[find(a)] = find(b)
        root[len(root)] = {frozenset(n for n in parent if find(n) == find(m)) for m in parent}
    assert found <= within and root[0] == root[1] and len(within) > 20
    monkeypatch.setattr(similar, "ROUNDS", -1)  # no list is looked at
    parts = {}
    for r in simhash.near_duplicates(docs, 5, 0.8).where("doc_id < 80").collect():
        parts.setdefault(r.component_id, set()).add(r.doc_id % 20)
    assert len(parts) < 80 - 15 and all(len(p) == 1 for p in parts.values())


def test_interface_refuses_what_it_cannot_find(no_docs):
    for width, similarity in ((5, None), (5, 0.5)):
        with pytest.raises(ValueError):
            simhash.near_duplicates(no_docs, width, similarity)


def test_minhash_agreement_follows_similarity():
    rng = np.random.default_rng(2)
    x = rng.integers(0, 1 << 64, 4000, dtype=np.uint64)
    a, b = simhash.minhashes(x[:3600]), simhash.minhashes(x[400:])
    assert abs((a == b).mean() - 0.8) < 0.12


def test_a_pair_meets_in_one_of_its_lists(spark, monkeypatch):
    """Unlinked nodes that share many lists: a row a pair, not one for each list; no pair is lost."""
    monkeypatch.setattr(similar, "CHUNK", 7)
    rng = random.Random(6)
    held = {i: sorted(rng.sample(range(30), 24 if i < 40 else 2)) for i in range(50)}
    sizes = {k: sum(k in keys for keys in held.values()) for k in range(30)}
    data = [(k, (i, k), i, 3, sizes[k] - (3 in held and k in held[3])) for i, keys in held.items() for k in keys]
    rows = spark.createDataFrame(data, "key long, x struct<node: long, at: long>, part long, top long, outside long").repartition(3)
    met = [tuple(sorted((r.x.node, r.y.node))) for r in similar.met_once(rows, lambda a, b: a["at"] == b["at"]).collect()]
    assert set(met) == {(i, j) for i, j in combinations(range(50), 2) if set(held[i]) & set(held[j])}
    dense = [p for p in met if p[1] < 40]
    assert len(dense) == len(set(dense))
    first = similar.met_once(rows, lambda a, b: a["at"] == b["at"]).selectExpr("least(x.node, y.node) a", "greatest(x.node, y.node) b", "x.at").groupBy("a", "b").min("at").collect()
    assert all(r[2] == min(set(held[r.a]) & set(held[r.b])) for r in first)  # where filters by place hold

import hashlib
import re
from fractions import Fraction

from lyrebird.llm import mixing

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_targets(sizes, weights=(5, 2, 1), most=3):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, capped = sum(sizes.values()), {}
    while True:
        free = [s for s in order if s not in capped]
        left, share = total - sum(capped.values()), sum(weight[s] for s in free)
        target = {s: Fraction(left * weight[s], share) for s in free}
        above = [s for s in free if target[s] > most * sizes[s]]
        if not above:
            return target | capped
        capped |= {s: most * sizes[s] for s in above}


def test_plan_against_brute_force(docs, corpus):
    rows = mixing.plan(docs.drop("size")).collect()
    size = {}
    for _, text, _, source, _ in corpus:
        size[source] = size.get(source, 0) + len(WORD.findall(text or ""))
    target = brute_targets(size)
    taken = dict.fromkeys(size, 0)
    for r in rows:
        assert r.source_size == size[r.source] and abs(r.target - target[r.source]) < 1e-6 * (1 + r.target)
        assert r.size == len(WORD.findall(r.text or "")) and 0 <= r.copies <= 3
        taken[r.source] += r.copies * r.size
    largest = {s: max(r.size for r in rows if r.source == s) for s in size}
    assert all(abs(taken[s] - target[s]) <= largest[s] / 2 + 1 for s in size)
    assert len(rows) == len(corpus)
    again = mixing.plan(docs.drop("size").repartition(7)).collect()
    assert sorted((str(r.doc_id), r.size, r.copies) for r in rows) == sorted((str(r.doc_id), r.size, r.copies) for r in again)
    # whole repetitions, and a part in the order of the marks
    for source in size:
        own = sorted((hashlib.md5(f"mix-1:{'' if r.doc_id is None else r.doc_id}".encode()).hexdigest(), r.copies) for r in rows if r.source == source and r.size)
        copies = [c for _, c in own]
        assert max(copies) - min(copies) <= 1


def test_caps_chain(spark):
    sources = spark.createDataFrame([("a", 1), ("b", 10), ("c", 1000), ("d", 1), (None, 7), ("e", 0)], "source string, source_size long")
    found = {r.source: r.target for r in mixing.targets(sources).collect()}
    expected = brute_targets({"a": 1, "b": 10, "c": 1000, "d": 1, None: 7, "e": 0})
    assert found.keys() == expected.keys() and all(abs(found[s] - expected[s]) < 1e-9 for s in found)


def test_mix_repeats_rows_and_empty(docs, no_docs, spark):
    planned = mixing.plan(docs.drop("size")).agg({"copies": "sum"}).first()[0]
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns and mixed.count() == planned
    assert mixing.mix(no_docs).count() == 0
    blank = spark.createDataFrame([(1, None, "a"), (2, " ", None)], "doc_id long, text string, source string")
    assert [(r.size, r.target, r.copies) for r in mixing.plan(blank).collect()] == [(0, 0.0, 1)] * 2


def test_texts_without_words_stay_within_the_cap(spark):
    rows = [(i, "w " * 900, "a") for i in range(20)] + [(100 + i, "" if i % 2 else "one word", "b") for i in range(40)]
    mixed = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    assert max(r["count"] for r in mixed.groupBy("doc_id").count().collect()) <= mixing.MAX_EPOCHS

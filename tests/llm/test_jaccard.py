"""The n-gram join against brute-force Jaccard similarity, at both sides of the bound."""

import random
import re
from itertools import combinations

import numpy as np
import pytest

from lyrebird.llm import jaccard, similar

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def set_of(text, width):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset(tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))) if words else frozenset()


def brute(rows, width=3, percent=90):
    sets = [set_of(t, width) for _, t in rows]
    distinct = sorted({s for s in sets if s}, key=sorted)
    parent = {s: s for s in distinct}

    def root(s):
        while parent[s] is not s:
            s = parent[s]
        return s

    n_links = 0
    for a, b in combinations(distinct, 2):
        if 100 * len(a & b) >= percent * len(a | b):
            n_links += 1
            parent[root(a)] = root(b)
    least = {}
    for (doc_id, _), s in zip(rows, sets, strict=True):
        if s and doc_id is not None:
            least[root(s)] = min(least.get(root(s), doc_id), doc_id)
    return sorted(((d, len(s), least.get(root(s)) if s else d) for (d, _), s in zip(rows, sets, strict=True)), key=repr), n_links


def edited(rng, words, vocabulary, edits):
    words = list(words)
    for _ in range(edits):
        at = rng.randrange(len(words))
        kind = rng.randrange(3)
        if kind == 0:
            words[at] = rng.choice(vocabulary)
        elif kind == 1:
            words.insert(at, rng.choice(vocabulary))
        elif len(words) > 1:
            del words[at]
    return words


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(8)
    vocabulary = ["".join(rng.choices("abcdefghijäö", k=rng.randint(2, 9))) for _ in range(400)]
    out = [" ".join(rng.choices(vocabulary, k=rng.choice([1, 2, 3, 5, 9, 10, 11, 12, 13, 20, 40, 100, 300]))) for _ in range(150)]
    for base in [out[i].split() for i in range(100)]:  # a few edits on both sides of the bound, and small sets
        for _ in range(3):
            words = edited(rng, base, vocabulary, rng.randint(1, max(1, len(base) // 40)))
            out.append((" ".join(words)).upper() if rng.random() < 0.2 else "\n".join(words))
    base = rng.choices(vocabulary, k=120)  # a large group whose members mostly lie beyond the bound of each other
    out += [" ".join(edited(rng, base, vocabulary, rng.randint(1, 4))) for _ in range(120)]
    passage = rng.choices(vocabulary, k=30)  # a common passage in texts that are not similar
    out += [" ".join(rng.choices(vocabulary, k=25) + passage) for _ in range(60)]
    out += [" ".join(passage + rng.choices(vocabulary, k=k)) for k in (1, 2, 3, 3, 4)]
    chain = rng.choices(vocabulary, k=200)
    for _ in range(15):
        chain = [*chain[2:], *rng.choices(vocabulary, k=2)]
        out.append(" ".join(chain))
    return out + [None, "", " \t\n", "a", "A", "a b", "a  b", "b a", "x y z", "x y z x y z", "w " * 50, " ".join(rng.choices(vocabulary, k=30_000))] + out[:10]


@pytest.mark.parametrize(("width", "percent"), [(3, 90), (5, 80), (1, 70), (3, 100)])
def test_components_match_brute_force(spark, texts, width, percent):
    rows = [(i, t) for i, t in enumerate(texts)]
    random.Random(2).shuffle(rows)
    rows += [(None, texts[0]), (None, "only without an id " * 9), (None, None), (7, texts[30]), (7, texts[31])]
    docs = spark.createDataFrame([(*r, 5, "x") for r in rows], "doc_id long, text string, n long, node string").repartition(5)
    expected, n_links = brute(rows, width, percent)
    found = sorted((tuple(r) for r in jaccard.jaccard_components(docs, width, percent).collect()), key=repr)
    assert found == expected
    assert n_links > 50 or percent == 100


def test_empty_table_and_refusals(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert jaccard.jaccard_components(none).count() == 0
    with pytest.raises(ValueError):
        jaccard.similar_sets(none, 3, 40)


def test_links_are_similar_and_span_components(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows, found, links = jaccard.similar_sets(docs)
    sets = {r.node: set_of(texts[r.doc_id], 3) for r in rows.collect()}
    pairs = [tuple(r) for r in links.collect()]
    assert pairs and all(100 * len(sets[a] & sets[b]) >= 90 * len(sets[a] | sets[b]) for a, b in pairs)
    assert len(pairs) == len(set(pairs))
    parts = {r.node: r.component for r in found.collect()}
    assert all(parts[a] == parts[b] for a, b in pairs)


def test_a_large_group_makes_rows_in_proportion(spark, monkeypatch):
    """5,000 near copies: rows that joins make grow with the group, not with its square."""
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(3000)]
    base = rng.choices(vocabulary, k=100)
    rows = [(i, " ".join(edited(rng, base, vocabulary, rng.randint(1, 3)))) for i in range(5000)]
    tried = []
    original = similar.verified
    monkeypatch.setattr(similar, "verified", lambda pairs, sets, percent: tried.append(pairs.count()) or original(pairs, sets, percent))
    found = jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert len(found) == 5000 and sum(tried) < 20 * 5000
    assert max(len([1 for r in found if r.component_id == c]) for c in {r.component_id for r in found}) > 2500


def test_filters_lose_no_similar_pair():
    rng = np.random.default_rng(4)
    for _ in range(200):
        n = int(rng.integers(9, 400))
        x = np.unique(rng.integers(0, 1 << 64, n, dtype=np.uint64))
        lost = int(rng.integers(0, max(1, n // 9)))
        y = np.unique(np.concatenate([x[lost:], rng.integers(0, 1 << 64, int(rng.integers(0, 3)), dtype=np.uint64)]))
        both = len(np.intersect1d(x, y))
        differing = sum(int(int(p ^ q) & (1 << 64) - 1).bit_count() for p, q in zip(similar.signature(x), similar.signature(y), strict=True))
        assert differing <= len(x) + len(y) - 2 * both
        if 100 * both >= 90 * (len(x) + len(y) - both):
            assert jaccard.can_link(len(x), 90) and 100 * min(len(x), len(y)) >= 90 * max(len(x), len(y))
            shared = np.intersect1d(x, y)[0]
            assert np.searchsorted(x, shared) < jaccard.prefix_length(len(x), 90) and np.searchsorted(y, shared) < jaccard.prefix_length(len(y), 90)

import hashlib
import random
import re

import numpy as np

from lyrebird.llm import substrings

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows):
    """(doc_id, text) rows to (doc_id, n_words, n_removed, kept)."""
    order = lambda d: float("-inf") if d is None else d
    first = {}
    texts = [(d, WORD.findall(t or "")) for d, t in rows]
    for doc, words in texts:
        for i in range(len(words) - 19):
            key = tuple(words[i : i + 20])
            first[key] = min(first.get(key, order(doc)), order(doc))
    out = []
    for doc, words in texts:
        gone, seen = set(), set()
        for i in range(len(words) - 19):
            key = tuple(words[i : i + 20])
            if first[key] < order(doc) or key in seen:
                gone |= set(range(i, i + 20))
            seen.add(key)
        kept = [w for i, w in enumerate(words) if i not in gone]
        out.append((doc, len(words), len(gone), " ".join(kept)))
    return sorted(out, key=str)


def test_equals_brute_force(docs, corpus):
    rows = substrings.remove_repeats(docs).select("doc_id", "n_words", "n_removed", "kept").collect()
    expected = brute([(d, t) for d, t, *_ in corpus])
    assert sum(r[2] for r in expected) > 1000
    assert sorted(map(tuple, rows), key=str) == expected


def test_cover_brings_any_two_positions_onto_it():
    cover = set(substrings.COVER)
    for i in range(substrings.PERIOD):
        for j in range(substrings.PERIOD):
            assert any((i + d) % substrings.PERIOD in cover and (j + d) % substrings.PERIOD in cover for d in range(substrings.PERIOD))


def test_rolled_hash_depends_on_the_run_alone():
    values = np.random.default_rng(0).integers(0, 1 << 63, 500, dtype=np.uint64)
    twice = np.concatenate([values, values[100:200]])
    for width in (1, 2, 3, 8, 13, 20):
        hashes = substrings.rolled(twice, width, substrings.BASE_1)
        assert len(hashes) == len(twice) - width + 1
        assert (hashes[500 : 601 - width] == hashes[100 : 201 - width]).all()
        assert len(set(hashes[: 501 - width].tolist())) == 501 - width
    assert len(substrings.rolled(values[:3], 8, substrings.BASE_1)) == 0


def test_word_hashes_depend_on_the_word_alone(monkeypatch):
    rng = random.Random(3)
    vocabulary = ["".join(rng.choices("abcé", k=rng.randint(1, 90))) for _ in range(500)]
    text = "".join(w + rng.choice([" ", "\n", "\t ", "\x0b", "\x0c", "\r\n"]) for w in rng.choices(vocabulary, k=5000)).encode() + b"z" * 3000 + b" end"
    whole = substrings._Hashes().of(text).tolist()
    monkeypatch.setattr(substrings, "STRETCH", 256)  # words stand at other places of their stretches, one is longer than a stretch
    assert substrings._Hashes().of(text).tolist() == whole
    known = {}
    for word, value in zip(text.split(), whole, strict=True):
        assert known.setdefault(word, value) == value
    assert len(set(known.values())) == len(known)
    assert len(substrings._Hashes().of(b"")) == len(substrings._Hashes().of(b" \n ")) == 0


def test_crowded_filter_loses_nothing(docs, corpus, monkeypatch):
    from lyrebird.llm import common

    monkeypatch.setattr(common, "MAX_FILTER_BITS", 1 << 8)  # all but full
    rows = substrings.remove_repeats(docs).select("doc_id", "n_words", "n_removed", "kept").collect()
    assert sorted(map(tuple, rows), key=str) == brute([(d, t) for d, t, *_ in corpus])


def test_empty_and_clashing_columns(docs, no_docs):
    assert substrings.remove_repeats(no_docs).count() == 0
    out = substrings.remove_repeats(docs.withColumnRenamed("size", "kept").limit(5))
    assert out.columns == ["doc_id", "text", "lang", "source", "n_words", "n_removed", "kept"]
    assert all(hashlib.sha256(r.kept.encode()) for r in out.collect())


def test_hot_windows_are_joined_and_equal_brute_force(docs, corpus, monkeypatch):
    monkeypatch.setattr(substrings, "HOT", 2)
    monkeypatch.setattr(substrings, "MOST_HOT", 1 << 40)
    rows = substrings.remove_repeats(docs).select("doc_id", "n_words", "n_removed", "kept").collect()
    assert sorted(map(tuple, rows), key=str) == brute([(d, t) for d, t, *_ in corpus])


def test_texts_with_one_short_hash_and_no_doc_id_are_told_apart(spark):
    """The two endings have one 32-bit hash; only the second text repeats a passage."""
    from pyspark.sql import functions as F

    passage = " ".join(f"p{i}" for i in range(30))
    rows = [(None, "t164454"), (None, "t241681"), (None, passage), (5, passage + " tail")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert docs.where("text like 't%'").select(F.hash("text").alias("h")).distinct().count() == 1
    found = sorted(((r.doc_id, r.n_removed, r.kept) for r in substrings.remove_repeats(docs).collect()), key=str)
    assert found == sorted([(None, 0, "t164454"), (None, 0, "t241681"), (None, 0, passage), (5, 30, "tail")], key=str)

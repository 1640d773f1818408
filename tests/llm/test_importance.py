"""Importance resampling against a plain version that builds every n-gram, and the CRC algebra by itself."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lyrebird.llm import importance

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words_of(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain_features(text, longest, buckets):
    words = words_of(text)
    return [zlib.crc32(" ".join(words[i : i + n]).encode()) % buckets for n in range(1, longest + 1) for i in range(len(words) - n + 1)]


def plain(rows, target, longest=1, buckets=10_000, least_words=20, share=10, seed=2024):
    found = [plain_features(t, longest, buckets) for _, t in rows]
    s, t = Counter(b for f in found for b in f), Counter(b for x in target for b in plain_features(x, longest, buckets))
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets)))) for b in range(buckets)]
    out = []
    for (doc_id, text), f in zip(rows, found, strict=True):
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        out.append([doc_id, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words_of(text))])
    able = sorted((r for r in out if r[5] >= least_words), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[2], r[1], r[5]))
    for i, r in enumerate(able[: len(able) * share // 100], 1):
        r[4] = i
    return sorted((tuple(r[:5]) for r in out), key=repr)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(min_size=0, max_size=40), min_size=1, max_size=6))
def test_crcs_compose(parts):
    crc = np.array([zlib.crc32(parts[0])], dtype=np.uint32)
    for part in parts[1:]:
        crc = importance.joined(crc, np.array([zlib.crc32(part)], dtype=np.uint32), np.array([len(part)]))
    assert int(crc[0]) == zlib.crc32(b"".join(parts))


@pytest.mark.parametrize("length", [1, 2, 255, 256, 65_537, 5_000_000])
def test_long_shifts(length):
    tail = bytes([7]) * length
    crc = importance.joined(np.array([zlib.crc32(b"head")], dtype=np.uint32), np.array([zlib.crc32(tail)], dtype=np.uint32), np.array([length]))
    assert int(crc[0]) == zlib.crc32(b"head" + tail)


@pytest.mark.parametrize("longest", [1, 2, 3, 5])
def test_features_of_long_texts(longest, monkeypatch):
    monkeypatch.setattr(importance, "STRETCH", 7)
    rng = random.Random(longest)
    text = " ".join("".join(rng.choices("abcé𝄞09", k=rng.randint(1, 12))) for _ in range(60))
    for cut in (text, "", "one", "a b", text[:90]):
        n, found = importance.buckets_of(importance.Words(), cut.encode(), longest, 1000)
        assert n == len(words_of(cut)) and sorted(found.tolist()) == sorted(plain_features(cut, longest, 1000))


def result(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_features", "weight", "score", "rank").collect()), key=repr)


TARGET = ["changed same words", None, "", "a b c d e"]


@pytest.mark.parametrize("setting", [{}, {"longest": 3, "buckets": 70_000, "share": 40, "seed": 5, "least_words": 2}])
def test_documents_match_plain_version(spark, corpus, setting):
    docs = spark.createDataFrame([(*r[:2], "own", 5) for r in corpus], "doc_id long, text string, weight string, above long").repartition(3)
    target = spark.createDataFrame([(t, 1) for t in TARGET], "text string, places int")
    found = importance.resample(docs, target, **setting)
    assert found.columns == ["doc_id", "above", "n_words", "n_features", "weight", "score", "rank"]
    expected = plain([r[:2] for r in corpus], TARGET, **setting)
    assert result(found) == expected and any(r[4] for r in expected)


def test_ties_and_copies(spark):
    rows = [(i % 50, "one text of many copies " * 5) for i in range(400)] + [(None, "one text of many copies " * 5)] * 20
    found = importance.resample(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([("many copies",)], "text string"))
    assert result(found) == plain(rows, ["many copies"])


def test_empty_tables(spark, no_docs):
    target = spark.createDataFrame([("a b",)], "text string")
    assert importance.resample(no_docs, target).count() == 0
    rows = [(1, "a b " * 20), (2, None)]
    assert result(importance.resample(spark.createDataFrame(rows, "doc_id long, text string"), target.limit(0), share=50)) == plain(rows, [], share=50)

"""Each stage against a brute-force version on its own input."""

import random
import re
from collections import Counter
from itertools import combinations

import corpus_pipeline
import pytest

from lyrebird.llm import mixing, outliers
from tests.llm.test_substrings import brute as brute_repeats

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(9)
    vocabulary = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 9))) for _ in range(400)]
    passage = " ".join(rng.choices(vocabulary, k=55))
    rows = []
    for i in range(260):
        text = " ".join(rng.choices(vocabulary, k=rng.randint(60, 220)))
        if i % 6 == 0:
            text += "\n" + passage
        if i % 9 == 0 and i:
            text = rows[i // 2][1]
        if i % 11 == 0 and i:
            text = rows[i // 3][1] + " x"
        if i % 25 == 0:
            text = " ".join(w + "%%%" for w in text.split())
        rows.append((i, text, "en", rng.choice(["a", "a", "a", "b", None]), len(text)))
    rows += [(300, "too short", "en", "a", 9), (301, None, "en", "a", None), rows[1], rows[2]]
    path = tmp_path_factory.mktemp("corpus")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{path}/documents.parquet")
    return str(path)


@pytest.fixture(scope="module")
def stages(spark, folder, tmp_path_factory):
    """Input and output rows of each stage."""
    out, home = [], tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, folder).write.parquet(f"{home}/{k}")
        result = spark.read.parquet(f"{home}/{k}")
        if k < len(corpus_pipeline.STAGES) - 1:
            assert result.columns == corpus_pipeline.COLUMNS, name
        out.append((list(map(tuple, docs.collect())), list(map(tuple, result.collect()))))
        docs = result
    return out


def order(rows):
    return sorted(map(str, rows))


def test_quality(spark, folder, stages):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    stats = outliers.statistics(docs)
    groups = outliers.groups_of(stats)
    kept = outliers.verdicts(stats, groups, outliers.fit(stats, groups)).where("kept").select(*corpus_pipeline.COLUMNS)
    assert order(map(tuple, kept.collect())) == order(stages[0][1])
    before, after = stages[0]
    assert {d for d, t, *_ in before if t and "%%%" in t or not t or len(t.split()) < 50}.isdisjoint({r[0] for r in after})
    assert {d for d, t, *_ in before if t and "%%%" not in t and len(t.split()) >= 50} == {r[0] for r in after}


def brute_similar(texts):
    """The smallest place of each text's component, texts being linked where their sets of 5-word shingles have a Jaccard similarity of 0.8."""
    sets = []
    for t in texts:
        words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        sets.append({tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set())
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in combinations(range(len(sets)), 2):
        both = len(sets[i] & sets[j])
        if sets[i] == sets[j] or 5 * both >= 4 * (len(sets[i]) + len(sets[j]) - both):
            low, high = sorted((find(i), find(j)))
            root[high] = low
    return [find(i) for i in range(len(sets))]


def test_near_duplicates(stages):
    """Five words and a similarity of 0.8, as the stage is to link them."""
    before, after = stages[1]
    best = {}
    for root, row in zip(brute_similar([r[1] for r in before]), before, strict=True):
        best[root] = min(best.get(root, row[0]), row[0])
    assert sorted(r[0] for r in after) == sorted(best.values()) and len(after) < len(before)
    assert set(after) <= set(before)


def test_substrings(stages):
    before, after = stages[2]
    expected, source = [], {r[0]: r for r in before}
    for doc, n, removed, kept in brute_repeats([r[:2] for r in before]):
        row = source[doc]
        if removed < n or not removed:
            expected.append((doc, kept, *row[2:4], len(kept)) if removed else row)
    assert order(expected) == order(after) and any(r[1] != source[r[0]][1] for r in after)


def test_mixing(spark, stages):
    before, after = stages[3]
    size = Counter()
    for r in before:
        size[r[3]] += len(WORD.findall(r[1]))
    taken, copies = Counter(), Counter(r[0] for r in after)
    for r in after:
        taken[r[3]] += len(WORD.findall(r[1]))
    sources = spark.createDataFrame(list(size.items()), "source string, source_size long")
    for r in mixing.targets(sources).collect():
        largest = max(len(WORD.findall(b[1])) for b in before if b[3] == r.source)
        assert abs(taken[r.source] - r.target) <= largest / 2 + 1
    assert max(copies.values()) <= 3 and set(after) <= set(before)


def test_encoding_and_run(spark, folder, stages):
    import hashlib

    before, after = stages[4]
    assert len(before) == len(after)
    assert Counter(hashlib.sha256(r[1].encode()).hexdigest() for r in before) == Counter(r[3] for r in after)
    assert order(map(tuple, corpus_pipeline.run(spark, folder).collect())) == order(after)
    assert corpus_pipeline.ORACLE_SQL is None


def test_empty_table_and_extra_columns(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    docs.limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0
    extra = docs.selectExpr("*", "text AS kept", "n_chars AS size", "lang AS grp", "source AS `a.b`")
    extra.write.parquet(f"{tmp_path}/wide/documents.parquet")
    assert order(map(tuple, corpus_pipeline.run(spark, f"{tmp_path}/wide").collect())) == order(map(tuple, corpus_pipeline.run(spark, folder).collect()))


def test_nulls_everywhere(spark, tmp_path):
    long = " ".join(f"word{i}" for i in range(70))
    rows = [(None, None, None, None, None), (None, long, None, None, None), (None, long, None, None, None), (1, "", "en", "a", 0), (2, long + " more", None, "a", None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    kept = {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert kept <= {None, 2} and kept

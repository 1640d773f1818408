"""N-grams counted in packed form: same counts and drafts as plain Python, and few bytes a word in the shuffles."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lyrebird.operators import ngrams as G
from lyrebird.plans import catalog

TEXTS = ["a b a b a", "", None, " ", "a  b", "é 😀 é", "x", "a b a", "a\nb\tc  ", "q r " * 400] + [" ".join(np.random.default_rng(k).choice(["a", "b", "é", "", "zz"], k % 11 + 1)) for k in range(200)]
#: Bytes counted together, bytes of a part and bytes added up together: one part, a count for each text, many parts, and slices.
LIMITS = [(1, 1 << 20, 1 << 20), (1 << 20, 50, 1 << 20), (1 << 20, 50, 1), (100, 200, 30)]


def expected() -> dict:
    found = {}
    for words in [t.split(" ") for t in TEXTS if t is not None]:
        for n in (1, 2):
            for i in range(n, len(words)):
                key = (n, " ".join(words[i - n : i]), words[i])
                found[key] = found.get(key, 0) + 1
    return found


def best(counts: dict, least: list[int], percent: list[int]) -> dict:
    groups = {}
    for (n, gram, following), times in counts.items():
        groups.setdefault((n, gram), []).append((times, following.encode()))
    totals = {key: sum(t for t, _ in own) for key, own in groups.items()}
    return {(n, gram): max(own)[1].decode() for (n, gram), own in groups.items() if totals[n, gram] >= least[n - 1] and 100 * max(own)[0] >= percent[n - 1] * totals[n, gram]}


@pytest.fixture
def docs(spark):
    return spark.createDataFrame([(t,) for t in TEXTS], "text string").repartition(2)


def limited(monkeypatch, held, each, added):
    for name, value in (("HELD_BYTES", held), ("PART_BYTES", each), ("ADDED", added)):
        monkeypatch.setattr(G, name, value)


@pytest.mark.parametrize("limits", LIMITS)
def test_packed_windows_give_the_counts_of_both_grams(docs, monkeypatch, limits):
    limited(monkeypatch, *limits)
    parts, caches = G.cache(docs, "text")
    found = G.merged_counts(parts, caches).collect()
    assert {(r.n, r.gram, r.next): r.times for r in found} == expected() and len(found) == len(expected())
    halves = G.cache(docs, "text", F.coalesce(F.col("text") > "b", F.lit(False)), ~F.coalesce(F.col("text") > "b", F.lit(False)))
    assert {(r.n, r.gram, r.next): r.times for r in G.merged_counts(*halves).collect()} == expected()
    often = G.merged_counts(parts, caches * 3).collect()
    assert {(r.n, r.gram, r.next): r.times for r in often} == {k: 3 * v for k, v in expected().items()}


@pytest.mark.parametrize("limits", LIMITS)
def test_drafts_of_packed_windows(docs, monkeypatch, limits):
    limited(monkeypatch, *limits)
    cache = G.cache(docs, "text")
    found = G.drafts(*cache, [2, 3], [40, 30]).collect()
    assert {(r.n, r.gram): r.draft for r in found} == best(expected(), [2, 3], [40, 30]) and len(found) == len(set(found))
    found = G.drafts(*cache, [1, 1], [0, 0], ends=True).collect()
    last = {" ".join(t.split(" ")[-2:]) for t in TEXTS if t is not None and " " in t}
    assert {(r.n, r.gram): r.draft for r in found} == {(n, gram): x for (n, gram), x in best(expected(), [1, 1], [0, 0]).items() if n == 1 or gram in last}


def test_drafts_of_no_texts(docs):
    for none in (docs.where("text is null"), docs.where("false")):
        assert G.drafts(*G.cache(none, "text"), [1, 1], [0, 0]).count() == 0
        assert G.merged_counts(*G.cache(none, "text")).count() == 0


def shuffled(spark) -> int:
    """Bytes that all stages so far have written to shuffles."""
    context, gateway = spark.sparkContext, spark.sparkContext._gateway
    scala = context._jsc.sc()
    scala.listenerBus().waitUntilEmpty(30_000)
    stages = scala.statusStore().stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), gateway.jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


@pytest.mark.parametrize("name", ["ngram_counts", "ngram_merge", "ngram_draft", "ngram_lookup"])
def test_a_word_takes_few_bytes_in_the_shuffles(spark, name):
    catalog.load()
    data = "/root/testdata/sf0.001"
    words = spark.read.parquet(f"{data}/documents.parquet").select(F.sum(F.size(F.split("text", " ")))).first()[0]
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as joins of large tables are
    try:
        before = shuffled(spark)
        catalog.QUERIES[name](spark, data).collect()
        assert shuffled(spark) - before < 30 * words  # as rows of strings, 39 to 85
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)

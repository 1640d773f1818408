import re
from collections import Counter

import numpy as np
import pytest

from lyrebird.llm import outliers

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    triples = Counter(zip(words, words[1:], words[2:], strict=False))
    covered = set()
    for i in range(len(words) - 2):
        if triples[tuple(words[i : i + 3])] > 1:
            covered |= {i, i + 1, i + 2}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    n = len(words)
    return n, sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered), n < 50 or 100 * len(covered) > 50 * n


def test_statistics(spark, docs, corpus):
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    rows = outliers.statistics(docs).select("doc_id", *names).collect()
    assert sorted(map(str, map(tuple, rows))) == sorted(str((d, *brute(t))) for d, t, *_ in corpus)
    lines = spark.createDataFrame([(1, "a\na\n\n\nb\r\nb\n#x|y\n a\na"), (2, "x\x0by\nx\x0by"), (3, "a\x85b c　d")], "doc_id long, text string").selectExpr("*", "'e' lang", "'s' source")
    found = {r.doc_id: tuple(r[n] for n in names) for r in outliers.statistics(lines).collect()}
    assert found == {i: brute(t) for i, t, *_ in lines.collect()}


def test_chi_square():
    assert outliers.chi_square_quantile(0.95, 5) == pytest.approx(11.0705, abs=1e-4)
    assert outliers.chi_square_quantile(0.5, 2) == pytest.approx(1.386294, abs=1e-6)
    assert outliers.consistency(0.75) > 1


def regularised(x, share):
    return np.cov(x.T, bias=True) * outliers.consistency(min(share, 0.999)) + np.diag(np.square(outliers.FLOOR))


def distances(x, centre, scatter):
    return np.einsum("ni,ij,nj->n", x - centre, np.linalg.inv(scatter), x - centre)


def plain_estimate(x, starts=200, seed=0):
    """FAST-MCD of one group in numpy, with random subsets and whole sorts; centre and scatter."""
    rng = np.random.default_rng(seed)
    best = None
    for k in range(starts):
        some = x[rng.choice(len(x), min(len(x), outliers.SUBSET), replace=False)]
        centre, scatter = some.mean(axis=0), regularised(some, 1)
        for _ in range(40):
            near = x[np.argsort(distances(x, centre, scatter), kind="stable")[: int(np.ceil(outliers.SHARE * len(x)))]]
            before, centre, scatter = centre, near.mean(axis=0), regularised(near, len(near) / len(x))
            if np.abs(before - centre).max() < 1e-9:
                break
        det = np.linalg.slogdet(scatter)[1]
        if best is None or det < best[0] - 1e-12:
            best = det, centre, scatter
    within = x[distances(x, *best[1:]) <= outliers.chi_square_quantile(outliers.WITHIN, outliers.P)]
    return within.mean(axis=0), regularised(within, outliers.WITHIN)


def test_lowest_determinant_where_the_medians_fail(spark):
    """24% of the rows stand together across a narrow cloud, near its middle in each coordinate by itself; the start at the medians keeps them."""
    rng = np.random.default_rng(0)
    n, far = 1000, 240
    x = 6 * (np.sqrt(0.97) * rng.normal(size=(n, 1)) + np.sqrt(0.03) * rng.normal(size=(n, outliers.P)))
    x[:far] = 9 * np.array([1, -1, 1, -1, 1]) + rng.normal(size=(far, outliers.P)) * 0.3
    x += 40
    rows = spark.createDataFrame([("g", "g", False, v.tolist()) for v in x], "grp string, lang string, base_failed boolean, vector array<double>").repartition(3)
    groups = spark.createDataFrame([("g", "g")], "grp string, fit string")
    ours, plain = of_model(x, outliers.fit(rows, groups)), distances(x, *plain_estimate(x))
    assert np.allclose(ours, plain, rtol=0.2, atol=0.3)
    limit = outliers.chi_square_quantile(1 - 1e-4, outliers.P)
    assert (plain[:far] > limit).all() and (ours[:far] > limit).all() and (ours[far:] <= limit).mean() > 0.99
    fitted = outliers.weighted(rows.withColumnRenamed("grp", "fit"))
    medians = outliers.median_start(fitted)
    for _ in range(4):
        medians = outliers.cut(outliers.concentrated(fitted, medians))
    assert (of_model(x, outliers.reweighted(fitted, medians))[:far] <= limit).all()


def of_model(x, model):
    row = model.first()
    return distances(x, np.array(row.centre), np.linalg.inv(np.array(row.inverse).reshape(outliers.P, outliers.P)))


@pytest.fixture(scope="module")
def texts(spark):
    """Plain texts in two sources, with symbol-ridden ones among them; a small source; a tiny language."""
    rng = np.random.default_rng(1)
    rows = []
    for i in range(700):
        size = int(rng.integers(60, 400))
        words = ["".join(rng.choice(list("abcdefg"), int(rng.integers(2, 9)))) for _ in range(size)]
        if i % 10 == 0:
            words = [w + "###|" for w in words]
        lang, source = ("en", "big") if i < 400 else ("en", None) if i < 600 else ("en", f"small{i % 4}") if i < 690 else ("xx", "tiny")
        rows.append((i, " ".join(words), lang, source))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")


def test_outliers_go_and_plain_texts_stay(texts):
    stats = outliers.statistics(texts).cache()
    groups = outliers.groups_of(stats)
    fits = {r.grp: r.fit for r in groups.collect()}
    assert fits['{"lang":"en","source":"big"}'] == '{"lang":"en","source":"big"}' and fits['{"lang":"en"}'] == '{"lang":"en"}'
    assert fits['{"lang":"en","source":"small1"}'].startswith("lang ") and fits['{"lang":"xx","source":"tiny"}'] is None
    judged = outliers.verdicts(stats, groups, outliers.fit(stats, groups)).collect()
    for r in judged:
        assert r.kept == (r.doc_id % 10 != 0 or r.lang == "xx"), r.doc_id
    own = [r for r in judged if r.source == "big"]
    x = np.array([r.vector for r in own])
    plain = distances(x, *plain_estimate(x))
    assert np.allclose([r.distance2 for r in own], plain, rtol=0.15, atol=0.3)
    limit = outliers.chi_square_quantile(1 - outliers.TAIL, outliers.P)
    assert [r.kept for r in own] == (plain <= limit).tolist()


def test_keep_good_and_edge_tables(docs, no_docs, texts):
    assert outliers.keep_good(texts).columns == texts.columns
    assert outliers.keep_good(texts).count() == 700 - 69
    assert outliers.keep_good(no_docs).count() == 0
    kept = outliers.keep_good(docs.withColumnRenamed("size", "vector"))
    assert kept.columns == ["doc_id", "text", "lang", "source", "vector"] and kept.where("text is null").count() == 0


def test_repeats_go_from_a_clean_source(spark):
    rng = np.random.default_rng(6)

    def lines(n, size=10):
        return [" ".join("".join(rng.choice(list("abcdefghij"), 6)) for _ in range(size)) for _ in range(n)]

    rows = [(i, "\n".join(lines(int(rng.integers(8, 30))))) for i in range(300)]
    for i in range(300, 306):  # ten short lines said twice and four long ones: 42% of the lines and of the words
        short = lines(10, 5)
        rows.append((i, "\n".join([*short, *lines(4, 35), *short])))
    for i in range(306, 310):  # a clean one: a line said twice among ten
        own = lines(10)
        rows.append((i, "\n".join([*own, own[3]])))
    docs = spark.createDataFrame([(i, t, "en", "clean") for i, t in rows], "doc_id long, text string, lang string, source string")
    stats = outliers.statistics(docs).cache()
    groups = outliers.groups_of(stats)
    judged = outliers.verdicts(stats, groups, outliers.fit(stats, groups)).collect()
    planted = [r for r in judged if 300 <= r.doc_id < 306]
    for r in planted:
        assert not r.base_failed and 0.4 <= r.n_dup_lines / r.n_lines <= 0.45 and 0.4 <= r.n_repeat_words / r.n_words <= 0.45
    assert [r.doc_id for r in judged if not r.kept] == sorted(r.doc_id for r in planted)


def test_copies_count_as_often_as_they_occur(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(200, outliers.P)) + 5
    times = rng.integers(1, 9, 200)
    spread = [("g", v.tolist()) for v, n in zip(x, times) for _ in range(n)]
    rows = outliers.weighted(spark.createDataFrame(spread, "fit string, vector array<double>").repartition(3)).cache()
    assert rows.count() == 200 and rows.agg({"weight": "sum"}).first()[0] == times.sum()
    every = np.repeat(x, times, axis=0)
    model = outliers.cut(outliers.median_start(rows))
    row = model.first()
    far = distances(every, np.array(row.centre), np.linalg.inv(np.array(row.inverse).reshape(outliers.P, outliers.P)))
    bins = np.floor(np.log2(1 + far) * outliers.BINS)
    last = np.sort(bins)[int(np.ceil(outliers.SHARE * len(every))) - 1]
    near = every[bins <= last]
    found = outliers.concentrated(rows, model).first()
    assert np.allclose(found.centre, near.mean(axis=0))
    assert np.allclose(np.linalg.inv(np.array(found.inverse).reshape(outliers.P, outliers.P)), regularised(near, len(near) / len(every)))

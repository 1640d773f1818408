"""Fill-in-middle against a plain version, and the boundary lists by themselves."""

import hashlib

import numpy as np
import pytest

from lyrebird.llm import infill


def plain_row(doc_id, text, seed=1, rate=90, suffix_first=20, marks=infill.SENTINELS):
    text = text or ""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[i : i + 8], 16) for i in (0, 8, 16, 24)]
    n = len(text)
    if not text or any(m in text for m in marks) or h[2] % 100 >= rate:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, s, m = marks
    if h[3] % 100 < suffix_first:
        return n, "spm", a, b - a, s + text[b:] + p + text[:a] + m + text[a:b]
    return n, "psm", a, b - a, p + text[:a] + s + text[b:] + m + text[a:b]


@pytest.mark.parametrize("text", ["", "a", "plain letters", "äöü€𝄞" * 50, "a𝄞" * 33 + "z", "é", "𝄞" * 200])
def test_lists_give_every_boundary(text):
    data = text.encode()
    n, packed = infill.boundaries(data)
    units = infill.EliasFano(n + 1, len(data), packed)
    assert n == len(text)
    assert [units.select(i) for i in range(n + 1)] == [len(text[:i].encode()) for i in range(n + 1)]


def test_sparse_lists_have_low_bits():
    values = np.sort(np.random.default_rng(3).choice(1 << 20, 500, replace=False))
    units = infill.EliasFano(500, 1 << 20, infill.EliasFano.pack(values, 1 << 20))
    assert units.low_bits > 8 and [units.select(i) for i in range(500)] == values.tolist()
    assert len(infill.EliasFano.pack(values, 1 << 20)) < 500 * 14 / 8 + 16


@pytest.fixture(scope="module")
def mixed(corpus):
    """The corpus, texts with sentinels and their parts, and one text on half of all rows."""
    odd = ["<P>", "has <M> inside", "<S", ">", "<<S>", "ends with <", "P> <", "𝄞€" * 300, None, ""]
    hot = "the same words of many rows, äöü"
    rows = [(1000 + i, t, "en", "src0", 1) for i, t in enumerate(odd)] + [(2000 + i, hot, "en", "src0", 2) for i in range(600)] + [(None, hot, "en", "src0", 2)] * 3
    return corpus + rows


def test_query_matches_plain_version(spark, mixed):
    docs = spark.createDataFrame(mixed, "doc_id long, text string, lang string, source string, size int").repartition(5)
    done = infill.fill_in_middle(docs)
    assert done.columns == ["doc_id", "lang", "source", "size", "n", "form", "prefix_chars", "middle_chars", "output"]
    found = done.withColumn("back", infill.restored(done["output"], done["form"])).collect()
    key = lambda r: tuple(map(repr, r))
    expected = sorted(((r[0], r[2], r[3], r[4], *plain_row(r[0], r[1]), r[1] or "") for r in mixed), key=key)
    assert sorted((tuple(r) for r in found), key=key) == expected
    assert {r.form for r in found} == {"plain", "psm", "spm"}


def test_other_settings_and_clashing_columns(spark, mixed):
    docs = spark.createDataFrame([r[:2] + ("x", 7, b"k") for r in mixed[:200]], "doc_id long, text string, form string, salt long, key binary")
    marks = ("[pre]", "[suf]", "[mid]")
    found = infill.fill_in_middle(docs, seed=9, rate=50, suffix_first=100, sentinels=marks).collect()
    key = lambda r: tuple(map(repr, r))
    assert sorted(((r.doc_id, r.salt, bytes(r.key), r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in found), key=key) == sorted(((r[0], 7, b"k", *plain_row(r[0], r[1], 9, 50, 100, marks)) for r in mixed[:200]), key=key)


def test_a_hot_text_is_dealt_to_many_groups_and_an_empty_table_gives_none(spark, no_docs):
    rows = [(i, "hot text") for i in range(900)] + [(i, f"text {i}") for i in range(900, 1000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    key = hashlib.sha256(b"hot text").digest()
    index = infill.distinct_index(docs.select("text"), {key: 200})
    assert index.count() == 300 and index.where("n = 8").select("salt").distinct().count() == 200
    assert infill.fill_in_middle(docs).count() == 1000
    assert infill.fill_in_middle(no_docs).count() == 0


def test_very_long_text(spark):
    text = "wörter und 𝄞 " * 150_000
    found = infill.fill_in_middle(spark.createDataFrame([(5, text)], "doc_id long, text string")).collect()
    assert tuple(found[0])[1:] == plain_row(5, text)

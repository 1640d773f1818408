import public_tokenizers
import pytest
from tokenizers import Tokenizer

from lyrebird.llm import token_cache


@pytest.fixture(scope="module")
def tokens():
    return token_cache.Tokens.load(public_tokenizers.path("word_bpe_49k.json"))


def brute(corpus):
    model = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    return sorted(((d, len((t or "").encode()), len(model.encode(t or "", add_special_tokens=False).ids)) for d, t, *_ in corpus), key=str)


def test_counts_equal_the_library_and_the_cache_fills_once(spark, docs, corpus, tokens, tmp_path):
    cache = str(tmp_path / "cache")
    for _ in range(2):  # the second call finds every digest stored
        assert sorted(map(tuple, token_cache.count_tokens(docs, tokens, cache).collect()), key=str) == brute(corpus)
        assert spark.read.parquet(cache).count() == spark.read.parquet(cache).select("digest").distinct().count()
    half = docs.where("doc_id < 40")
    other = str(tmp_path / "other")
    token_cache.count_tokens(half, tokens, other)
    before = spark.read.parquet(other).count()
    assert sorted(map(tuple, token_cache.count_tokens(docs, tokens, other).collect()), key=str) == brute(corpus)
    assert before < spark.read.parquet(other).count() == spark.read.parquet(cache).count()


def test_special_strings_white_space_and_stored_counts(spark, tokens, tmp_path):
    texts = ["<|endoftext|>", "a<|startoftext|>b", "<|endof text|>", "<|ENDOFTEXT|>", "x\n\n y\t", "  ", " a　b\x1c", "it's 2024", "a" * 5000]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    found = {r.doc_id: r.n_tokens for r in token_cache.count_tokens(rows, tokens, str(tmp_path / "c")).collect()}
    model = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    assert found == {i: len(model.encode(t, add_special_tokens=False).ids) for i, t in enumerate(texts)}
    # a stored count is believed, for its own tokenizer version only
    spark.createDataFrame([(d.digest, "other", 99) for d in spark.read.parquet(str(tmp_path / "c")).collect()], token_cache.CACHE_SCHEMA).write.parquet(str(tmp_path / "d"))
    again = {r.doc_id: r.n_tokens for r in token_cache.count_tokens(rows, tokens, str(tmp_path / "d")).collect()}
    assert again == found


def test_sentencepiece_and_empty(spark, docs, no_docs, corpus, tokens, tmp_path):
    import sentencepiece

    pieces = token_cache.Tokens.load(public_tokenizers.path("piece_bpe_32k.model"))
    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    assert not pieces.collapsible
    found = sorted(((r.doc_id, r.n_tokens) for r in token_cache.count_tokens(docs, pieces, str(tmp_path / "p")).collect()), key=str)
    assert found == sorted(((d, len(model.encode(t or ""))) for d, t, *_ in corpus), key=str)
    assert token_cache.count_tokens(no_docs, tokens, str(tmp_path / "e")).count() == 0


def test_words_add_up_to_texts(tokens, monkeypatch):
    count = tokens.counter()
    texts = ["", "don't <|endoftext|>x it's", "ΑΣ Σ. ΣΑ e\u0301 \u0301a", "12 3 4five <|end", "Ｆull ｗidth\u3000x", "a b " * 50 + "c", "\u00a0 \u0085x y"]
    texts = [token_cache.content_of(t.encode(), True).decode() for t in texts]
    assert token_cache.WordCounts(count)(texts) == count(texts)
    monkeypatch.setattr(token_cache, "STRETCH", 9)
    monkeypatch.setattr(token_cache, "REMEMBERED", 3)
    assert token_cache.WordCounts(count)(texts) == count(texts)


def test_a_full_cache_shuffles_digests_only(spark, docs, tokens, tmp_path, monkeypatch):
    cache = str(tmp_path / "full")
    first = sorted(map(tuple, token_cache.count_tokens(docs, tokens, cache).collect()), key=str)

    def refused(*_):
        raise AssertionError("texts are read again")

    monkeypatch.setattr(token_cache, "contents", refused)
    assert sorted(map(tuple, token_cache.count_tokens(docs, tokens, cache).collect()), key=str) == first


def test_columns_named_like_outputs_are_ignored(spark, tokens, tmp_path):
    rows = spark.createDataFrame([(None, "a b", 7, "x", "y"), (None, "a b", 7, "x", "y"), (1, None, 8, "x", "y")], "doc_id long, text string, n_tokens int, digest string, content string")
    assert sorted(map(tuple, token_cache.count_tokens(rows, tokens, str(tmp_path / "n")).collect()), key=str) == [(1, 0, 0), (None, 3, 2), (None, 3, 2)]

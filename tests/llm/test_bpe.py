import hashlib
import struct

import public_tokenizers
import pytest
import tiktoken

from lyrebird.llm import bpe


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))


@pytest.fixture(scope="module")
def library(vocabulary):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={p: i for i, p in enumerate(vocabulary)}, special_tokens={})


HARD = ["<|endoftext|> it's  \n\n x", "▁▁a", "a" * 3000, "ĠĊ", "日本語 한국어 \U0001f600\U0001f468‍\U0001f469", "\x00\x7f\x85 ", "12345 6.7e8", " " * 50 + "x", "naïve café\r\n\tend "]


def test_ids_equal_the_library(vocabulary, library):
    encoder = bpe.Encoder(bpe.model_proto(vocabulary), public_tokenizers.PATTERN)
    for text in HARD:
        ids = list(struct.unpack(f"<{len(encoder.encode(text)) // 4}I", encoder.encode(text)))
        assert ids == library.encode_ordinary(text), text


def test_round_trip_of_a_table(spark, docs, corpus, vocabulary, library):
    rows = bpe.digests(docs, vocabulary, public_tokenizers.PATTERN).collect()
    expected = []
    for doc_id, text, *_ in corpus:
        ids = library.encode_ordinary(text or "")
        expected.append((doc_id, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    assert sorted(map(tuple, rows), key=str) == sorted(expected, key=str)


def test_other_columns_pass_and_outputs_replace(spark, docs, no_docs, vocabulary):
    clashing = docs.withColumnRenamed("size", "ids")
    assert bpe.encode(clashing, vocabulary, public_tokenizers.PATTERN).columns == ["doc_id", "lang", "source", "ids"]
    assert bpe.decode(bpe.encode(no_docs, vocabulary, public_tokenizers.PATTERN), bpe.model_proto(vocabulary)).count() == 0


def test_decoding_inverts_the_models_pieces(spark, docs, corpus, vocabulary, monkeypatch):
    proto = bpe.model_proto(vocabulary)
    assert bpe.bytes_of_pieces(proto) == [*vocabulary, b""]
    back = bpe.decode(bpe.encode(docs, vocabulary, public_tokenizers.PATTERN), proto).select("decoded").collect()
    assert sorted(bytes(r.decoded) for r in back) == sorted((r[1] or "").encode() for r in corpus)
    wrong = bpe.byte_alphabet()
    wrong[97], wrong[98] = wrong[98], wrong[97]  # the alphabet of decoding only: the round trip must notice
    monkeypatch.setattr(bpe, "byte_alphabet", lambda: wrong)
    assert bpe.bytes_of_pieces(proto) != [*vocabulary, b""]
    ids = struct.pack("<I", vocabulary.index(b"a"))
    assert bpe.spell_out(ids, bpe.bytes_of_pieces(proto)) == b"b"

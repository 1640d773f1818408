"""Byte-level BPE encoding and decoding through a sentencepiece model built from the rank file.

The vocabulary's byte strings are written as printable characters, one per byte, and become the
pieces of a sentencepiece BPE model whose scores are the negative ranks and whose normaliser is the
identity. Each match of the split pattern is encoded by itself. Ids decode to the model's own pieces, and
their characters to bytes by the inverse of the alphabet; the rank file takes no part in that.

Null texts are encoded as empty: no ids. Rows are kept one for one, repeated rows included, and any
other columns pass through; a column named like an output is replaced. Tables without rows give none.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lyrebird.llm.common import read, small_batches

#: Pre-tokens whose ids a worker remembers at most.
REMEMBERED = 100_000


def byte_alphabet() -> list[str]:
    """A printable character for each of the 256 bytes: itself where Latin-1 prints it, else one from U+0100 on."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in printable else chr(next(spare)) for b in range(256)]


def load_ranks(path: str) -> list[bytes]:
    """Byte strings of a rank file in the order of their ranks, which must be 0, 1, 2, ..."""
    with open(path, "rb") as lines:
        pairs = sorted((int(rank), base64.b64decode(piece)) for piece, rank in map(bytes.split, lines))
    if [rank for rank, _ in pairs] != list(range(len(pairs))):
        raise ValueError("ranks must be consecutive from 0")
    return [piece for _, piece in pairs]


def model_proto(vocabulary: list[bytes]) -> bytes:
    """The serialised sentencepiece model of a byte-level vocabulary; piece ids equal ranks."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    spelled = byte_alphabet()
    model = pb.ModelProto()
    for rank, piece in enumerate(vocabulary):
        model.pieces.add(piece="".join(spelled[b] for b in piece), score=-float(rank), type=pb.ModelProto.SentencePiece.NORMAL)
    model.pieces.add(piece="<unk>", score=0.0, type=pb.ModelProto.SentencePiece.UNKNOWN)
    model.trainer_spec.model_type = pb.TrainerSpec.BPE
    model.trainer_spec.unk_id = len(vocabulary)
    model.trainer_spec.bos_id = model.trainer_spec.eos_id = model.trainer_spec.pad_id = -1
    model.normalizer_spec.name = "identity"
    model.normalizer_spec.add_dummy_prefix = False
    model.normalizer_spec.remove_extra_whitespaces = False
    model.normalizer_spec.escape_whitespaces = False
    return model.SerializeToString()


class Encoder:
    """Encodes texts pre-token by pre-token; used inside a task."""

    def __init__(self, proto: bytes, pattern: str):
        import regex
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_proto=proto)
        self.split = regex.compile(pattern).findall
        self.spelled = dict(enumerate(byte_alphabet()))
        self.known: dict[str, bytes] = {}

    def learn(self, pieces: set[str]) -> None:
        if len(self.known) + len(pieces) > REMEMBERED:
            self.known.clear()
        new = [p for p in pieces if p not in self.known]
        spelled = [p.encode().decode("latin-1").translate(self.spelled) for p in new]
        for piece, ids in zip(new, self.model.encode(spelled, out_type=int, num_threads=1), strict=True):
            self.known[piece] = np.array(ids, dtype="<u4").tobytes()

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        pieces = self.split(text)
        try:
            return b"".join(map(self.known.__getitem__, pieces))
        except KeyError:
            self.learn(set(pieces))
            return b"".join(map(self.known.__getitem__, pieces))


def encode(docs: DataFrame, vocabulary: list[bytes], pattern: str, text: str = "text", out: str = "ids") -> DataFrame:
    """docs without the text column, plus the ids of its whole text as binary."""
    shipped = docs.sparkSession.sparkContext.broadcast(model_proto(vocabulary))  # as large as the vocabulary file
    kept = [c for c in docs.columns if c not in (text, out)]
    base = small_batches(docs).select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text}`").cast("string").alias(text))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shipped.value, pattern)
        for batch in batches:
            ids = [encoder.encode(t) if t else b"" for t in batch.column(len(kept)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], pa.array(ids, pa.binary())], [*kept, out])

    schema = base.select(*[F.col(f"`{c}`") for c in kept], F.lit(None).cast("binary").alias(out)).schema
    return base.mapInArrow(run, schema)


def bytes_of_pieces(proto: bytes) -> list[bytes]:
    """The byte string of each piece of a serialised model, by the inverse of the alphabet; the unknown piece has none."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    model = pb.ModelProto()
    model.ParseFromString(proto)
    inverse = {ord(c): b for b, c in enumerate(byte_alphabet())}
    plain = pb.ModelProto.SentencePiece.NORMAL
    return [p.piece.translate(inverse).encode("latin-1") if p.type == plain else b"" for p in model.pieces]


def spell_out(ids: bytes | None, pieces: list[bytes]) -> bytes:
    """The bytes that ids, as `Encoder.encode` gives them, stand for; pieces: those of `bytes_of_pieces`."""
    return b"".join(map(pieces.__getitem__, np.frombuffer(ids or b"", dtype="<u4").tolist()))


def decode(encoded: DataFrame, proto: bytes, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """encoded plus the bytes that its ids stand for in a serialised model; null ids decode to nothing."""
    shipped = encoded.sparkSession.sparkContext.broadcast(proto)
    kept = [c for c in encoded.columns if c != out]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = bytes_of_pieces(shipped.value)
        for batch in batches:
            texts = [spell_out(x, pieces) for x in batch.column(kept.index(ids)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(kept))), pa.array(texts, pa.binary())], [*kept, out])

    base = small_batches(encoded).select(*[F.col(f"`{c}`") for c in kept])
    return base.mapInArrow(run, base.withColumn(out, F.lit(None).cast("binary")).schema)


def round_trip(docs: DataFrame, vocabulary: list[bytes], pattern: str) -> DataFrame:
    """doc_id, ids and decoded of every row: `encode`, then `decode` from the ids, by one Python worker a task."""
    shipped = docs.sparkSession.sparkContext.broadcast(model_proto(vocabulary))  # as large as the vocabulary file

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, pieces = Encoder(shipped.value, pattern), bytes_of_pieces(shipped.value)
        for batch in batches:
            ids = [encoder.encode(t) if t else b"" for t in batch.column(1).to_pylist()]
            decoded = [spell_out(x, pieces) for x in ids]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary()), pa.array(decoded, pa.binary())], ["doc_id", "ids", "decoded"])

    base = small_batches(docs).select("doc_id", F.col("text").cast("string").alias("text"))
    return base.mapInArrow(run, base.select("doc_id", F.lit(None).cast("binary").alias("ids"), F.lit(None).cast("binary").alias("decoded")).schema)


def digests(docs: DataFrame, vocabulary: list[bytes], pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row: encoded, then decoded from the ids."""
    return round_trip(docs, vocabulary, pattern).select(
        "doc_id",
        F.expr("length(ids) div 4").cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    vocabulary = load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return digests(read(spark, sf_dir, "documents"), vocabulary, public_tokenizers.PATTERN)

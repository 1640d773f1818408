"""Readers and writers of audio, model and transcript files.

Binary files come through Spark's binaryFile source, so any store that Spark reads will do; a file is
one row and may hold 2 GB at most. Parsing is Python on Arrow batches of one file.
"""

from __future__ import annotations

import io
import json
import struct
import wave
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lyrebird.functions import audio, text

WAV = "path string, sr int, wav array<float>"
TENSORS = "path string, name string, type int, shape array<long>, data_offset long"
FIELDS = "path string, key string, type int, value string"


def _binary(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return files.select("path", "content")


def read_wav(spark: SparkSession, path: str) -> DataFrame:
    """(path, sr, wav) of PCM files, channels averaged, samples in [-1, 1]."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for files in batches:
            rows = []
            for name, content in zip(files.path, files.content, strict=True):
                with wave.open(io.BytesIO(content)) as sound:
                    width, channels = sound.getsampwidth(), sound.getnchannels()
                    kind = {1: np.uint8, 2: np.dtype("<i2"), 4: np.dtype("<i4")}[width]
                    data = np.frombuffer(sound.readframes(sound.getnframes()), dtype=kind).astype(np.float64)
                    data = (data - 128) / 128 if width == 1 else data / (1 << (8 * width - 1))
                    rows.append((name, sound.getframerate(), data.reshape(-1, channels).mean(axis=1).astype(np.float32)))
            yield pd.DataFrame(rows, columns=["path", "sr", "wav"])

    return _binary(spark, path, "*.wav").mapInPandas(run, WAV)


def load_audio(refs: DataFrame, files: DataFrame | None = None, start: float = 0.0, duration: float | None = None, rate: int = audio.RATE) -> DataFrame:
    """(id, wav) at `rate` of references (id, ref): data URLs and base64 by their payload, other text by its path among `files` (path, content).

    A URL of the web is refused, as is a path that isn't there. Null references give null.
    """
    inline = text.is_probably_base64(F.col("ref"))
    refused = F.raise_error(F.concat(F.lit("audio over the network isn't read: "), F.col("ref"))).cast("binary")
    own = refs.withColumn("_own", F.when(text.is_url(F.col("ref")), refused).when(inline, F.unbase64(text.base64_payload(F.col("ref")))))
    if files is not None:
        named = files.select(F.regexp_replace("path", "^file:/*", "/").alias("_path"), F.col("content").alias("_content"))
        own = own.join(named, F.when(~inline, F.col("ref")) == F.col("_path"), "left").withColumn("_own", F.coalesce("_own", "_content"))
    there = F.when(F.col("ref").isNull(), F.lit(None).cast("binary")).otherwise(F.coalesce("_own", F.raise_error(F.concat(F.lit("no such audio: "), F.col("ref"))).cast("binary")))
    read = own.select("id", audio.clip(there, start, duration).alias("c"))
    wave_ = F.when(F.col("c.sr") == rate, F.col("c.wave")).otherwise(audio.resample(F.coalesce("c.wave", F.array().cast("array<double>")), F.coalesce("c.sr", F.lit(rate)), rate))
    at_rate = read.select("id", F.when(F.col("c.wave").isNotNull(), wave_).alias("_at"))
    return at_rate.select("id", audio.into_range(F.col("_at")).alias("wav"))


# The layout of the model container: magic, and the codes and formats of its scalar types.
MAGIC = b"GGUF"
SCALARS = {0: "<B", 1: "<b", 2: "<H", 3: "<h", 4: "<I", 5: "<i", 6: "<f", 7: "<?", 10: "<Q", 11: "<q", 12: "<d"}
STRING, ARRAY = 8, 9
ALIGNMENT = 32


class _Cursor:
    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def take(self, form: str):
        value = struct.unpack_from(form, self.data, self.at)[0]
        self.at += struct.calcsize(form)
        return value

    def text(self) -> str:
        n = self.take("<Q")
        self.at += n
        return self.data[self.at - n : self.at].decode()

    def value(self, kind: int):
        if kind == STRING:
            return self.text()
        if kind == ARRAY:
            inner, n = self.take("<I"), self.take("<Q")
            return [self.value(inner) for _ in range(n)]
        return self.take(SCALARS[kind])


def parse_container(data: bytes) -> tuple[list[tuple[str, int, object]], list[tuple[str, int, list[int], int]]]:
    """Fields (key, type, value) and tensors (name, type, shape, offset in the file)."""
    if data[:4] != MAGIC:
        raise ValueError("not a model container")
    cursor = _Cursor(data)
    cursor.at = 4
    if cursor.take("<I") not in (2, 3):
        raise ValueError("unknown version")
    n_tensors, n_fields = cursor.take("<Q"), cursor.take("<Q")
    fields = []
    for _ in range(n_fields):
        key, kind = cursor.text(), cursor.take("<I")
        fields.append((key, kind, cursor.value(kind)))
    tensors = []
    for _ in range(n_tensors):
        name = cursor.text()
        shape = [cursor.take("<Q") for _ in range(cursor.take("<I"))]
        tensors.append((name, cursor.take("<I"), shape, cursor.take("<Q")))
    if len({t[0] for t in tensors}) < len(tensors):
        raise ValueError("two tensors have one name")
    step = next((v for k, _, v in fields if k == "general.alignment"), ALIGNMENT)
    start = -(-cursor.at // step) * step
    return fields, [(n, t, s, start + o) for n, t, s, o in tensors]


def read_fields(spark: SparkSession, path: str) -> DataFrame:
    """(path, key, type, value) of model containers, values as JSON."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for files in batches:
            rows = [(p, k, t, json.dumps(v, ensure_ascii=False)) for p, c in zip(files.path, files.content, strict=True) for k, t, v in parse_container(c)[0]]
            yield pd.DataFrame(rows, columns=["path", "key", "type", "value"])

    return _binary(spark, path, "*.gguf").mapInPandas(run, FIELDS)


def read_tensors(spark: SparkSession, path: str) -> DataFrame:
    """(path, name, type, shape, data_offset) of model containers."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for files in batches:
            rows = [(p, *t) for p, c in zip(files.path, files.content, strict=True) for t in parse_container(c)[1]]
            yield pd.DataFrame(rows, columns=["path", "name", "type", "shape", "data_offset"])

    return _binary(spark, path, "*.gguf").mapInPandas(run, TENSORS)


def write_container(fields: list[tuple[str, int, object]], tensors: list[tuple[str, int, list[int], bytes]]) -> bytes:
    """A model container; array fields have an element type as (type, values)."""

    def text(s: str) -> bytes:
        return struct.pack("<Q", len(s.encode())) + s.encode()

    def value(kind: int, v) -> bytes:
        if kind == STRING:
            return text(v)
        if kind == ARRAY:
            return struct.pack("<IQ", v[0], len(v[1])) + b"".join(value(v[0], x) for x in v[1])
        return struct.pack(SCALARS[kind], v)

    head = MAGIC + struct.pack("<IQQ", 3, len(tensors), len(fields)) + b"".join(text(k) + struct.pack("<I", t) + value(t, v) for k, t, v in fields)
    offset, body = 0, b""
    for name, kind, shape, data in tensors:
        head += text(name) + struct.pack("<I", len(shape)) + b"".join(struct.pack("<Q", n) for n in shape) + struct.pack("<IQ", kind, offset)
        padded = data + b"\0" * (-len(data) % ALIGNMENT)
        body, offset = body + padded, offset + len(padded)
    return head + b"\0" * (-len(head) % ALIGNMENT) + body


def read_safetensors(spark: SparkSession, path: str) -> DataFrame:
    """(path, name, dtype, shape, begin, end): the header's tensors, with their byte ranges in the file."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for files in batches:
            rows = []
            for name, content in zip(files.path, files.content, strict=True):
                n = struct.unpack_from("<Q", content)[0]
                for tensor, about in json.loads(content[8 : 8 + n]).items():
                    if tensor != "__metadata__":
                        rows.append((name, tensor, about["dtype"], about["shape"], *(8 + n + x for x in about["data_offsets"])))
            yield pd.DataFrame(rows, columns=["path", "name", "dtype", "shape", "begin", "end"])

    return _binary(spark, path, "*.safetensors").mapInPandas(run, "path string, name string, dtype string, shape array<long>, begin long, `end` long")


def dictionary(spark: SparkSession, path: str) -> DataFrame:
    """The first word of each line, once, with score 1."""
    word = F.regexp_extract("value", r"^\s*(\S+)", 1)
    return spark.read.text(path).select(word.alias("word")).where("word <> ''").distinct().withColumn("score", F.lit(1.0))


def read_runs(spark: SparkSession, path: str, schema: str, form: str) -> DataFrame:
    """Benchmark rows from csv (with header), jsonl or json (arrays) files."""
    reader = spark.read.schema(schema)
    if form == "csv":
        return reader.option("header", True).csv(path)
    return reader.option("multiLine", form == "json").json(path)


def write_lines(lines: DataFrame, path: str, column: str = "value") -> None:
    """One text column as text files: transcripts, subtitles, JSON lines."""
    lines.select(F.col(column).alias("value")).write.mode("overwrite").text(path)

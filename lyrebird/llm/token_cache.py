"""Token counts through a digest cache.

The content of a text, with runs of ASCII white space collapsed, and the version of the tokenizer,
the SHA-256 of its file, are the key of a stored table of counts. Texts are joined to the table by
digest; only distinct texts that it lacks are encoded, and their counts are appended to it.

Digests alone are looked up first. Only where some are missing are texts shuffled, each text once a
task at most; with a full cache nothing but digests moves. Counts come back to the rows by a join in
which the copies of a hot text can be dealt to several tasks.

Collapsing is safe for tokenizers that drop white space and whose added tokens hold none, which
`Tokens.collapsible` checks. For these a text's count is also the sum over its words, so a task
remembers the counts of up to REMEMBERED words. For others the content is the text itself, encoded whole.

Null texts count as empty. Very long texts are counted in stretches where words add up. Rows are kept
one for one, repeated rows and null doc_ids included; columns but doc_id and text are ignored. An
empty table gives no rows and leaves the cache as it is.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lyrebird.llm.common import cut, read, shared_folder, small_batches, together, written

CACHE_SCHEMA = "digest binary, version string, n_tokens long"
#: Words whose counts a task remembers, and characters counted at a time.
REMEMBERED, STRETCH = 200_000, 1 << 22


@dataclass(frozen=True)
class Tokens:
    """A tokenizer file, read once on the driver; tasks get its bytes."""

    kind: str
    content: bytes
    version: str
    collapsible: bool

    @classmethod
    def load(cls, path: str) -> Tokens:
        with open(path, "rb") as file:
            content = file.read()
        kind = "sentencepiece" if path.endswith(".model") else "tokenizers"
        return cls(kind, content, hashlib.sha256(content).hexdigest(), kind == "tokenizers" and _drops_white_space(json.loads(content)))

    def counter(self):
        """A function from a list of texts to their counts, made inside a task."""
        if self.kind == "sentencepiece":
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_proto=self.content)
            return lambda texts: [len(ids) for ids in model.encode(texts, num_threads=1)]
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        model = Tokenizer.from_str(self.content.decode())
        model.no_truncation()
        model.no_padding()
        return lambda texts: [len(x) for x in model.encode_batch_fast(texts, add_special_tokens=False)]


def _drops_white_space(spec: dict) -> bool:
    """Whether ASCII white space only separates: a removed gap, squeezed before, and never part of an added token."""
    normal = (spec.get("normalizer") or {}).get("normalizers", [])
    split = ((spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}])[0]
    squeezed = any(n.get("type") == "Replace" and n["pattern"] == {"Regex": r"\s+"} and n["content"] == " " for n in normal)
    removed = split.get("type") == "Split" and split.get("behavior") == "Removed" and split.get("invert") is True
    plain = all(not any(c.isspace() for c in t["content"]) and not (t["lstrip"] or t["rstrip"] or t["single_word"]) for t in spec.get("added_tokens", []))
    return squeezed and removed and plain


class WordCounts:
    """Counts of texts by the sum over their words, for a tokenizer that drops white space; used inside a task."""

    def __init__(self, count):
        self.count, self.known = count, {}

    def _of(self, words: list[str]) -> int:
        try:
            return sum(map(self.known.__getitem__, words))
        except KeyError:
            needed = set(words)
            if len(self.known) + len(needed) > REMEMBERED:
                self.known.clear()
            new = [w for w in needed if w not in self.known]
            self.known.update(zip(new, self.count(new), strict=True))
            return sum(map(self.known.__getitem__, words))

    def __call__(self, texts: list[str]) -> list[int]:
        """Counts of texts whose white space is collapsed."""
        if sum(map(len, texts)) <= STRETCH:  # learn the new words of all of them at once
            split = [t.split(" ") if t else [] for t in texts]
            self._of(list({w for words in split for w in words}))
            return [self._of(words) for words in split]
        return [sum(self._of(words) for words in stretches(t)) for t in texts]


def stretches(text: str) -> Iterator[list[str]]:
    """The words of a text whose white space is collapsed, some at a time."""
    at = 0
    while at < len(text):
        end = text.find(" ", at + STRETCH)
        end = len(text) if end < 0 else end
        yield text[at:end].split(" ")
        at = end + 1


def content_of(text: bytes | None, collapsible: bool) -> bytes:
    """What of a text decides its count."""
    return b" ".join((text or b"").split()) if collapsible else text or b""


def stored(spark: SparkSession, cache: str, tokens: Tokens) -> DataFrame:
    """(digest, n_tokens) of a cache folder for one tokenizer; none where the folder isn't there yet."""
    try:
        table = spark.read.schema(CACHE_SCHEMA).parquet(cache)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        table = spark.createDataFrame([], CACHE_SCHEMA)
    # writers that ran at the same time may have stored a digest twice, with one count
    return table.where(F.col("version") == tokens.version).groupBy("digest").agg(F.min("n_tokens").alias("n_tokens"))


def keys(texts: DataFrame, tokens: Tokens) -> DataFrame:
    """doc_id, n_bytes and digest of each row."""
    collapsible = tokens.collapsible

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column(1).cast(pa.binary()).to_pylist()
            digests = [hashlib.sha256(content_of(t, collapsible)).digest() for t in own]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(t or b"") for t in own], pa.int64()), pa.array(digests, pa.binary())], ["doc_id", "n_bytes", "digest"])

    return texts.mapInArrow(run, texts.select("doc_id", F.lit(0).cast("long").alias("n_bytes"), F.lit(None).cast("binary").alias("digest")).schema)


def contents(texts: DataFrame, tokens: Tokens) -> DataFrame:
    """(digest, content), each text once a task."""
    collapsible = tokens.collapsible

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            digests, own = [], []
            for text in batch.column(0).cast(pa.binary()).to_pylist():
                content = content_of(text, collapsible)
                digest = hashlib.sha256(content).digest()
                if digest not in seen:
                    seen.add(digest)
                    digests.append(digest)
                    own.append(content)
            yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.array(own, pa.binary())], ["digest", "content"])

    return texts.select("text").mapInArrow(run, "digest binary, content binary")


def encoded(missing: DataFrame, tokens: Tokens) -> DataFrame:
    """Rows for the cache from (digest, content)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = WordCounts(tokens.counter()) if tokens.collapsible else tokens.counter()
        for table in together(batches):
            counts = count(table.column(1).cast(pa.string()).to_pylist())
            yield pa.RecordBatch.from_arrays([table.column(0).combine_chunks(), pa.array([tokens.version] * len(counts)), pa.array(counts, pa.int64())], ["digest", "version", "n_tokens"])

    return missing.mapInArrow(run, CACHE_SCHEMA)


def count_tokens(docs: DataFrame, tokens: Tokens, cache: str) -> DataFrame:
    """doc_id, n_bytes, n_tokens of each row, and the cache brought up to date."""
    spark = small_batches(docs).sparkSession
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    keyed = written(keys(texts, tokens))
    present = cut(keyed.select("digest").distinct())
    missing = cut(present.join(stored(spark, cache, tokens), "digest", "left_anti"))
    if not missing.isEmpty():
        once = contents(texts, tokens).join(missing, "digest", "left_semi").groupBy("digest").agg(F.first("content").alias("content"))
        encoded(once, tokens).write.mode("append").parquet(cache)
    # cut, so that its layout is not known and the rows of a hot digest can be dealt to several tasks
    counts = cut(stored(spark, cache, tokens).join(present, "digest", "left_semi"))
    return keyed.join(counts, "digest").select("doc_id", "n_bytes", "n_tokens")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Starts from an empty cache, so that each run does its own counting."""
    import public_tokenizers

    tokens = Tokens.load(public_tokenizers.path("word_bpe_49k.json"))
    counted = count_tokens(read(spark, sf_dir, "documents"), tokens, f"{shared_folder(spark)}/token-cache-{uuid.uuid4().hex}")
    return counted.withColumn("over_limit", F.col("n_tokens") > 2048)

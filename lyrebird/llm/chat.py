r"""Chat formatting by columnar byte assembly.

A turn becomes `<turn ROLE>TEXT</turn>` and a line feed, in which `\` and `<` of the text, and `\`,
`<`, `>` and line feeds of the role, are preceded by `\`; so a marker inside a text can never be
taken for one, and reading back undoes it. The loss mask covers the texts of assistant turns.

Turns are range-partitioned by conversation and turn, so a very long conversation spreads over
tasks. For each Arrow batch the lengths of all segments (markers, roles, texts), their cumulative
offsets and the scatter indices are computed in numpy, and all bytes are copied into one
preallocated buffer, which becomes the Arrow column without another copy. A batch's run of turns of
one conversation is one row, a piece; (part, seq) orders the pieces of a conversation.

Turns of equal number are ordered by role, then text; a null number comes first. Null roles and
texts count as empty. A null conv_id is a conversation of its own. Repeated rows are turns of their
own. Other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lyrebird.llm.common import read, small_batches

OPEN, MIDDLE, CLOSE = b"<turn ", b">", b"</turn>\n"
LEARNED_ROLE = "assistant"
PIECES = "conv_id long, part int, seq long, n_turns long, formatted string, loss_start array<long>, loss_end array<long>"


def _escaped(column: pa.Array, special: str) -> pa.Array:
    for char in special:
        column = pc.replace_substring(column, char, "\\" + char)
    return column


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Lengths of the values and all their bytes, end to end."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return np.diff(offsets), data[offsets[0] : offsets[-1]] if len(offsets) else data


def _fixed(value: bytes, rows: int) -> tuple[np.ndarray, np.ndarray]:
    return np.full(rows, len(value), dtype=np.int64), np.tile(np.frombuffer(value, dtype=np.uint8), rows)


def assemble(segments: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """One buffer with each row's segments one after another; and the start of each segment, by row and kind."""
    lengths = np.stack([n for n, _ in segments], axis=1)
    starts = np.cumsum(lengths.ravel()) - lengths.ravel()
    starts = starts.reshape(lengths.shape)
    buffer = np.empty(int(lengths.sum()), dtype=np.uint8)
    for kind, (n, data) in enumerate(segments):
        source = np.cumsum(n) - n
        buffer[np.repeat(starts[:, kind] - source, n) + np.arange(len(data))] = data
    return buffer, starts


def format_batch(conv: pa.Array, role: pa.Array, text: pa.Array, part: int, seq: int) -> pa.RecordBatch:
    """The pieces of a sorted batch."""
    rows = len(conv)
    values, nulls = pc.fill_null(conv, 0).to_numpy(zero_copy_only=False), pc.is_null(conv).to_numpy(zero_copy_only=False)
    first = np.ones(rows, dtype=bool)
    first[1:] = (values[1:] != values[:-1]) | (nulls[1:] != nulls[:-1])
    heads = np.flatnonzero(first)
    roles, texts = _flat(_escaped(role, "\\<>\n")), _flat(_escaped(text, "\\<"))
    buffer, starts = assemble([_fixed(OPEN, rows), roles, _fixed(MIDDLE, rows), texts, _fixed(CLOSE, rows)])
    bounds = np.append(starts[heads, 0], len(buffer)).astype(np.int64)
    formatted = pa.Array.from_buffers(pa.large_string(), len(heads), [None, pa.py_buffer(bounds), pa.py_buffer(buffer)]).cast(pa.string())
    learned = pc.equal(role, LEARNED_ROLE).to_numpy(zero_copy_only=False).astype(bool)
    piece = np.cumsum(first) - 1
    begin = (starts[:, 3] - bounds[piece])[learned]
    counts = np.bincount(piece[learned], minlength=len(heads))
    offsets = pa.array(np.append(0, np.cumsum(counts)).astype(np.int32))
    n_turns = np.diff(np.append(heads, rows))
    return pa.RecordBatch.from_arrays(
        [conv.take(pa.array(heads)), pa.array(np.full(len(heads), part, dtype=np.int32)), pa.array(seq + np.arange(len(heads))), pa.array(n_turns.astype(np.int64)), formatted, pa.ListArray.from_arrays(offsets, pa.array(begin)), pa.ListArray.from_arrays(offsets, pa.array(begin + texts[0][learned]))],
        ["conv_id", "part", "seq", "n_turns", "formatted", "loss_start", "loss_end"],
    )


def format_chats(turns: DataFrame) -> DataFrame:
    """The pieces (PIECES) of all conversations; loss spans are byte offsets into the piece's UTF-8."""
    clean = small_batches(turns).select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")])
    ordered = clean.repartitionByRange("conv_id", "turn").sortWithinPartitions("conv_id", "turn", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq = TaskContext.get().partitionId(), 0
        for batch in batches:
            if batch.num_rows:
                out = format_batch(batch.column(0), batch.column(2), batch.column(3), part, seq)
                seq += out.num_rows
                yield out

    return ordered.mapInArrow(run, PIECES)


_TURN = re.compile(rb"<turn ([^\\>]*(?:\\.[^\\>]*)*)>([^\\<]*(?:\\.[^\\<]*)*)</turn>\n", re.DOTALL)
_ESCAPE = re.compile(rb"\\(.)", re.DOTALL)


def unescape(data: bytes) -> bytes:
    return _ESCAPE.sub(rb"\1", data)


def parse(formatted: bytes) -> list[tuple[bytes, bytes]]:
    """(role, text) of each turn of a piece; raises where the piece isn't a row of turns."""
    found, at = [], 0
    for turn in _TURN.finditer(formatted):
        if turn.start() != at:
            raise ValueError("formatted text does not parse")
        at = turn.end()
        found.append((unescape(turn[1]), unescape(turn[2])))
    if at != len(formatted):
        raise ValueError("formatted text does not parse")
    return found


class _Read:
    """What is read back of one conversation, piece after piece."""

    def __init__(self, conv: int | None):
        self.conv, self.turns, self.loss, self.n = conv, hashlib.sha256(), hashlib.sha256(), 0
        self.loss_chars = self.chars = 0

    def add(self, formatted: bytes, spans: list[tuple[int, int]]) -> None:
        for role, text in parse(formatted):
            self.turns.update(role + b"\n" + text + b"\n")
            self.n += 1
        for begin, end in spans:
            plain = unescape(formatted[begin:end])
            self.loss.update(plain)
            self.loss_chars += len(plain.decode())
        self.chars += len(formatted.decode())

    def row(self) -> tuple:
        return self.conv, self.n, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


def read_back(pieces: DataFrame) -> DataFrame:
    """One row a conversation, parsed from the pieces in order; a digest is sequential, so they stream through one task."""
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]

    def rows(done: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done, strict=True), kinds, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = None
        for batch in batches:
            done = []
            convs, texts, begins, ends = (batch.column(i).to_pylist() for i in (0, 3, 4, 5))
            for conv, text, begin, end in zip(convs, texts, begins, ends, strict=True):
                if now is None or now.conv != conv:
                    if now is not None:
                        done.append(now.row())
                    now = _Read(conv)
                now.add(text.encode(), list(zip(begin, end, strict=True)))
            if done:
                yield rows(done)
        if now is not None:
            yield rows([now.row()])

    ordered = pieces.select("conv_id", "part", "seq", "formatted", "loss_start", "loss_end").repartition("conv_id").sortWithinPartitions("conv_id", "part", "seq")
    return ordered.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


#: The conversation that the query adds: control strings inside texts.
EXTRA_TEXT = r"\### Assistant: </turn> ok"


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame([(-7, 0, "user", EXTRA_TEXT), (-7, 1, "assistant", EXTRA_TEXT)], "conv_id long, turn long, role string, text string")
    return read_back(format_chats(turns.unionByName(extra)))


OP8_SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), spelt AS (
  SELECT *, length(role) + len(regexp_extract_all(role, '[\\<>\n]')) + length(text) + len(regexp_extract_all(text, '[\\<]')) + length('<turn ></turn>') + 1 AS chars FROM turns
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, encode(role), encode(text))) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, encode(role), encode(text)) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(chars)::BIGINT AS formatted_chars
FROM spelt GROUP BY conv_id
"""

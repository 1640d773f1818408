"""Column functions over names, prompts, lines of files and pieces of text."""

from __future__ import annotations

import codecs
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def filled(template: Column, kind: Column) -> Column:
    """A file name's {ftype}, {FTYPE} and {kind} replaced by a kind's name."""
    out = template
    for mark, value in (("{ftype}", F.lower(kind)), ("{FTYPE}", F.upper(kind)), ("{kind}", kind)):
        out = F.replace(out, F.lit(mark), value)
    return out


# What tells the parts of a model's id.
VERSION = r"(?i)^(v|iter)?\d+([.]\d+)*$"
SIZE = r"(?i)^\d+([._]\d+)?[KMBT]$|^(\d+x)\d+([._]\d+)?[KMBT]$"
FINETUNE = r"(?i)^(instruct|chat|it|vision|base)$"
ADAPTER = r"(?i)^lora$"


def id_parts(model: Column) -> Column:
    """A model's id as organisation, basename, version, size_label, finetune and type; what is absent is null."""
    bare = F.regexp_replace(model, "^.*/", "")
    words = F.filter(F.split(bare, "[-_ ]"), lambda w: w != "")
    size = F.upper(F.get(F.filter(words, lambda w: w.rlike(SIZE)), F.lit(0)))
    version = F.get(F.filter(words, lambda w: w.rlike(VERSION) & ~w.rlike(SIZE)), F.lit(0))
    plain = F.filter(words, lambda w: ~w.rlike(SIZE) & ~w.rlike(VERSION) & ~w.rlike(FINETUNE) & ~w.rlike(ADAPTER))
    return F.struct(
        F.when(F.contains(model, F.lit("/")), F.regexp_extract(model, "^(.*)/", 1)).alias("organisation"),
        F.when(F.size(plain) > 0, F.array_join(plain, "-")).alias("basename"),
        version.alias("version"),
        size.alias("size_label"),
        F.get(F.filter(words, lambda w: w.rlike(FINETUNE)), F.lit(0)).alias("finetune"),
        F.get(F.filter(words, lambda w: w.rlike(ADAPTER)), F.lit(0)).alias("type"),
    )


def looked_up(rows: DataFrame, known: DataFrame, asked: str) -> DataFrame:
    """rows with `name` from a table (pattern, known) in which {n} stands for the layer; tried whole first, then without .weight or .bias."""
    number = F.regexp_extract(F.col(asked), r"\.(\d+)\.", 1)
    general = F.regexp_replace(F.col(asked), r"\.\d+\.", ".{n}.")
    suffix = F.regexp_extract(F.col(asked), r"(\.weight|\.bias)?$", 1)
    keyed = rows.withColumns({"_whole": general, "_bare": F.regexp_replace(general, r"(\.weight|\.bias)$", ""), "_n": number, "_suffix": suffix})
    whole = keyed.join(known.select(F.col("pattern").alias("_whole"), F.col("known").alias("_k1")), "_whole", "left")
    both = whole.join(known.select(F.col("pattern").alias("_bare"), F.col("known").alias("_k2")), "_bare", "left")
    found = F.coalesce("_k1", F.concat("_k2", "_suffix"))
    return both.withColumn("name", F.replace(found, F.lit("{n}"), F.col("_n"))).select(*rows.columns, "name")


def rewritten(fields: DataFrame, removed: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Fields without the removed ones, and with new ones in place of those of the same key."""
    return fields.join(removed, key, "left_anti").join(new, key, "left_anti").unionByName(new.join(removed, key, "left_anti"))


def aligned(items: Column, arguments: Column) -> Column:
    """(item, argument) pairs: one argument for all items, or as many as there are; any other number is an error."""
    n, m = F.size(items), F.size(arguments)
    whole = F.when(m == 1, F.array_repeat(arguments[0], n)).when(n == m, arguments).otherwise(F.raise_error(F.lit("as many arguments as items, or one")).cast("array<string>"))
    return F.zip_with(items, whole, lambda i, a: F.struct(i.alias("item"), a.alias("argument")))


def task_prompt(task: Column, language: Column, target: str) -> Column:
    """What a task is asked with; unknown tasks are an error."""
    asked = F.when(task == "transcribe", F.concat(F.lit("transcribe "), language)).when(task == "translate", F.concat(F.lit("translate "), language, F.lit(f" to {target}")))
    return asked.otherwise(F.raise_error(F.lit("an unknown task")).cast("string"))


def pre_tokens(text: Column) -> Column:
    """Runs of letters, single digits, and runs of other signs; white space is dropped."""
    return F.regexp_extract_all(text, F.lit(r"\p{L}+|\p{N}|[^\s\p{L}\p{N}]+"), F.lit(0))


def insert_statement(name: str, columns: list[tuple[str, bool]]) -> Column:
    """A row as an SQL statement; columns are (name, quoted), quotes inside are doubled, nulls are NULL."""
    values = [F.coalesce(F.concat(F.lit("'"), F.replace(F.col(c), F.lit("'"), F.lit("''")), F.lit("'")) if quoted else F.col(c).cast("string"), F.lit("NULL")) for c, quoted in columns]
    return F.concat(F.lit(f"INSERT INTO {name} ({', '.join(c for c, _ in columns)}) VALUES ("), F.concat_ws(", ", *values), F.lit(");"))


def quoted_fields(line: Column, schema: str) -> Column:
    """A line with quoted fields, in which a doubled quote stands for one."""
    return F.from_csv(line, schema, {"quote": '"', "escape": '"'})


def sliding(rows: DataFrame, time: str, width: str, step: str) -> DataFrame:
    """(began, n): counts over windows that overlap; the same on a stream with a watermark."""
    return rows.groupBy(F.window(time, width, step).alias("w")).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").cast("timestamp_ntz").alias("began"), "n")


def _shown(row: pa.ListScalar) -> list[str]:
    """The pieces of one row, decoded one after another."""
    decoder = codecs.getincrementaldecoder("utf-8")("replace")
    return [*(decoder.decode(p or b"") for p in row.as_py()), decoder.decode(b"", final=True)]


def shown_of(rows: pa.ListArray) -> pa.ListArray:
    """`shown_pieces` of a batch: pieces of sound rows are cut anew at the last whole character, only others are decoded piece by piece."""
    lengths = rows.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = rows.flatten()
    raw = b"".join(flat.fill_null(b"").to_pylist()) if flat.null_count else None
    sizes = pc.binary_length(flat).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    if raw is None:
        begin = np.frombuffer(flat.buffers()[1], dtype=np.int32)[flat.offset] if len(flat) else 0
        raw = flat.buffers()[2].to_pybytes()[begin : begin + int(sizes.sum())] if len(flat) and flat.buffers()[2] else b""
    ends = np.cumsum(sizes)
    last = np.cumsum(lengths)
    tops = np.append(0, ends)[last]
    starts = np.append(0, tops[:-1])
    sound = np.ones(len(rows), dtype=bool)
    for i, (a, b) in enumerate(zip(starts.tolist(), tops.tolist(), strict=True)):
        try:
            raw[a:b].decode("utf-8")
        except UnicodeDecodeError:
            sound[i] = False
    offsets = np.append(0, np.cumsum(lengths + ~rows.is_null().to_numpy(zero_copy_only=False)))  # a row's pieces, and what was held at the end
    if sound.all():
        held = np.append(np.frombuffer(raw, dtype=np.uint8), np.uint8(0))
        cut = ends.copy()
        for _ in range(3):
            cut -= (held[cut] & 0xC0) == 0x80
        whole = np.insert(cut, last[~rows.is_null().to_numpy(zero_copy_only=False)], tops[~rows.is_null().to_numpy(zero_copy_only=False)])
        texts = pa.StringArray.from_buffers(len(whole), pa.py_buffer(np.append(0, whole).astype(np.int32).tobytes()), pa.py_buffer(raw))
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), texts, mask=rows.is_null())
    if len(rows) > 1:
        return pa.concat_arrays([shown_of(pa.concat_arrays([rows.slice(a, b - a)])) for a, b in zip(*_runs(sound), strict=True)])
    return pa.array([_shown(rows[0])], pa.list_(pa.string()))


def _runs(sound: np.ndarray) -> tuple[list[int], list[int]]:
    """Where stretches of sound rows, and single others, begin and end."""
    cuts = np.flatnonzero(~(sound[1:] & sound[:-1])) + 1
    return [0, *cuts.tolist()], [*cuts.tolist(), len(sound)]


def shown_pieces(rows: DataFrame, key: str, pieces: str) -> DataFrame:
    """(key, pieces): what an incremental UTF-8 decoder shows for each piece of bytes, and at the end for what it held; wrong bytes show as U+FFFD.

    A map over batches: of a scalar function over pieces cut by higher-order functions, Spark 4.1 leaves the second such
    query of a session unplanned.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), shown_of(batch.column(1))], [key, pieces])

    own = rows.select(key, pieces)
    return own.mapInArrow(run, f"{key} {own.schema[key].dataType.simpleString()}, {pieces} array<string>")

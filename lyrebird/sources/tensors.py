"""Tensor files as a data source: `spark.read.format("tensors").load(folder)`.

Reads two containers, the one with key-value fields and the one with a JSON header, by their header
alone; then each tensor's bytes by its range. A partition is a run of tensors of one file up to `bytes`
(32 MB unless the option says otherwise), a tensor larger than that a partition by itself. Filters on
path and name are pushed down and decide which ranges are read; with the option `values` false no
range is. Columns: path, name, dtype, shape, values (array of double, null for packed types).

Writing makes files with a JSON header from the columns name, shape and values, one for each task.
"""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, In, InputPartition, StringStartsWith

from lyrebird.sources import parts
from lyrebird.sources.files import parse_container

SCHEMA = "path string, name string, dtype string, shape array<long>, values array<double>"
BYTES = 32 << 20
FIRST = 1 << 16
# Names and codes of the plain number types in the two containers.
DTYPES = {"F64": "<f8", "F32": "<f4", "F16": "<f2", "I64": "<i8", "I32": "<i4", "I16": "<i2", "I8": "i1", "U8": "u1", "BOOL": "?"}
CODES = {0: "F32", 1: "F16", 24: "I8", 25: "I16", 26: "I32", 27: "I64", 28: "F64"}


@dataclass
class Tensor:
    name: str
    dtype: str
    shape: list[int]
    begin: int
    end: int


@dataclass
class Ranges(InputPartition):
    path: str
    tensors: list[Tensor]


def _json_header(file, size: int) -> list[Tensor]:
    length = struct.unpack("<Q", file.read_at(8, 0))[0]
    if 8 + length > size:
        raise ValueError("the header is longer than its file")
    about = json.loads(file.read_at(length, 8))
    return [Tensor(name, x["dtype"], list(x["shape"]), *(8 + length + o for o in x["data_offsets"])) for name, x in about.items() if name != "__metadata__"]


def _field_header(file, size: int) -> list[Tensor]:
    """Of the container with fields; as much of the file is read as the header takes, doubling."""
    read = FIRST
    while True:
        head = file.read_at(min(read, size), 0)
        try:
            _, found = parse_container(head)
            break
        except (struct.error, UnicodeDecodeError):
            if read >= size:
                raise
            read *= 2
    out = []
    for name, code, shape, begin in found:
        dtype = CODES.get(code, f"type {code}")
        width = np.dtype(DTYPES[dtype]).itemsize if dtype in DTYPES else 0
        out.append(Tensor(name, dtype, shape, begin, begin + width * int(np.prod(shape, dtype=np.int64))))
    return out


def header(path: str, size: int | None = None) -> list[Tensor]:
    """The tensors of a file by its header; nothing else of the file is read."""
    store, at = parts.opened(path)
    size = store.get_file_info(at).size if size is None else size
    with store.open_input_file(at) as file:
        return _json_header(file, size) if path.endswith(".safetensors") else _field_header(file, size)


class Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.bytes = int(options.get("bytes", BYTES))
        self.values = options.get("values", "true").lower() != "false"
        self.kept: list[Filter] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for one in filters:
            if isinstance(one, (EqualTo, In, StringStartsWith)) and one.attribute in (("name",), ("path",)):
                self.kept.append(one)
            else:
                yield one

    def wanted(self, path: str, name: str) -> bool:
        for one in self.kept:
            value = name if one.attribute == ("name",) else path
            if isinstance(one, EqualTo) and value != one.value or isinstance(one, In) and value not in one.value or isinstance(one, StringStartsWith) and not value.startswith(one.value):
                return False
        return True

    def partitions(self) -> list[InputPartition]:
        found: list[InputPartition] = []
        for path, size in parts.files_of(self.path, (".safetensors", ".gguf")):
            held, total = [], 0
            for tensor in sorted((t for t in header(path, size) if self.wanted(path, t.name)), key=lambda t: t.begin):
                if held and total + tensor.end - tensor.begin > self.bytes:
                    found.append(Ranges(path, held))
                    held, total = [], 0
                held.append(tensor)
                total += tensor.end - tensor.begin
            if held:
                found.append(Ranges(path, held))
        return found

    def read(self, partition: Ranges) -> Iterator[tuple]:
        if partition is None:  # a source without any file
            return
        store, at = parts.opened(partition.path)
        with store.open_input_file(at) as file:
            for t in partition.tensors:
                values = None
                if self.values and t.dtype in DTYPES:
                    values = np.frombuffer(file.read_at(t.end - t.begin, t.begin), dtype=DTYPES[t.dtype]).astype(np.float64).tolist()
                yield partition.path, t.name, t.dtype, t.shape, values


class Writer(DataSourceWriter):
    """One file a task: its tensors' bytes go to the store as they come; the header, which stands first, is put before them at the end."""

    def __init__(self, options: dict[str, str], dtype: str):
        self.path, self.dtype, self.job = options["path"], dtype, parts.new_job()

    def write(self, rows: Iterator) -> parts.Part:
        store, name = parts.pending(self.path, self.job)
        apart = parts.pending(self.path, self.job)[1]
        about, at, n = {}, 0, 0
        with store.open_output_stream(apart) as body:
            for row in rows:
                data = np.asarray(row["values"], dtype=DTYPES[self.dtype]).tobytes()
                if row["name"] in about:
                    raise ValueError(f"two tensors are named {row['name']}")
                about[row["name"]] = {"dtype": self.dtype, "shape": list(row["shape"]), "data_offsets": [at, at + len(data)]}
                body.write(data)
                at, n = at + len(data), n + 1
        head = json.dumps(about).encode()
        with store.open_output_stream(name) as out, store.open_input_stream(apart) as body:
            out.write(struct.pack("<Q", len(head)) + head)
            while piece := body.read(1 << 22):
                out.write(piece)
        store.delete_file(apart)
        return parts.Part(name, n)

    def commit(self, messages: list) -> None:
        parts.commit(self.path, self.job, messages, ".safetensors")

    def abort(self, messages: list) -> None:
        parts.cleared(self.path, self.job)


class TensorSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tensors"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Reader:
        return Reader(self.options)

    def writer(self, schema, overwrite: bool) -> Writer:
        if overwrite:
            raise ValueError("tensors are only appended: give a new folder")
        return Writer(self.options, self.options.get("dtype", "F32"))


def register(spark) -> None:
    """Makes the format known to a session, with filters pushed to it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(TensorSource)

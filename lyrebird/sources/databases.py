"""Benchmark databases as a data source: `spark.read.format("database").option("table", t).load(path)`.

path is a SQLite file or a folder of them, in a folder that tasks see as local files. Each file is split
by ranges of row ids, `rows` in each, so a task reads its range and no file is read twice. Comparisons of
a column with a value go into the query. Writing makes one file for each task, and the commit names those
of the tasks that succeeded.
"""

from __future__ import annotations

import datetime
import sqlite3
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual
from pyspark.sql.types import StructType

from lyrebird.sources import parts

ROWS = 100_000
ENDS = (".db", ".sqlite")
COMPARED = {EqualTo: "=", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}


def quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def connected(path: str, write: bool = False) -> sqlite3.Connection:
    """A connection that reads only, or one to a new file."""
    return sqlite3.connect(path) if write else sqlite3.connect(f"file:{path.replace('?', '%3f').replace('#', '%23')}?mode=ro&immutable=1", uri=True)


def type_of(declared: str) -> str:
    """The type of a column by the database's rules for declared names."""
    declared = declared.upper()
    if "INT" in declared:
        return "long"
    if any(x in declared for x in ("CHAR", "CLOB", "TEXT")):
        return "string"
    return "binary" if not declared or "BLOB" in declared else "double"


@dataclass
class Rows(InputPartition):
    path: str
    low: int
    high: int


class Reader(DataSourceReader):
    def __init__(self, options: dict[str, str], schema: StructType):
        self.path, self.table, self.rows = options["path"], options["table"], int(options.get("rows", ROWS))
        self.names = schema.names
        self.where, self.values = [], []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        plain = (int, float, str)
        for one in filters:
            column = quoted(one.attribute[0]) if hasattr(one, "attribute") and len(one.attribute) == 1 else None
            if column and type(one) in COMPARED and isinstance(one.value, plain):
                self.where.append(f"{column} {COMPARED[type(one)]} ?")
                self.values.append(one.value)
            elif column and isinstance(one, In) and one.value and len(one.value) <= 500 and all(isinstance(v, plain) for v in one.value):
                self.where.append(f"{column} IN ({', '.join('?' * len(one.value))})")
                self.values.extend(one.value)
            elif column and isinstance(one, IsNotNull):
                self.where.append(f"{column} IS NOT NULL")
            else:
                yield one

    def partitions(self) -> list[InputPartition]:
        found: list[InputPartition] = []
        for path, _ in parts.files_of(self.path, ENDS):
            with connected(path) as db:
                low, high = db.execute(f"SELECT min(rowid), max(rowid) FROM {quoted(self.table)}").fetchone()
            db.close()
            if low is not None:
                found += [Rows(path, at, min(high, at + self.rows - 1)) for at in range(low, high + 1, self.rows)]
        return found

    def query(self) -> str:
        columns = ", ".join(map(quoted, self.names))
        return f"SELECT {columns} FROM {quoted(self.table)} WHERE {' AND '.join(['rowid BETWEEN ? AND ?', *self.where])}"

    def read(self, partition: Rows) -> Iterator[tuple]:
        if partition is None:  # a folder without any file
            return
        db = connected(partition.path)
        try:
            yield from db.execute(self.query(), [partition.low, partition.high, *self.values])
        finally:
            db.close()


class Writer(DataSourceWriter):
    KINDS = {"tinyint": "INTEGER", "smallint": "INTEGER", "int": "INTEGER", "bigint": "INTEGER", "boolean": "INTEGER", "float": "REAL", "double": "REAL", "string": "TEXT", "binary": "BLOB", "timestamp": "TEXT", "timestamp_ntz": "TEXT", "date": "TEXT"}

    def __init__(self, options: dict[str, str], schema: StructType):
        self.path, self.table, self.job = options["path"], options["table"], parts.new_job()
        unknown = [f.name for f in schema if f.dataType.simpleString() not in self.KINDS]
        if unknown:
            raise ValueError(f"columns of types that a database lacks: {unknown}")
        self.columns = [(f.name, self.KINDS[f.dataType.simpleString()]) for f in schema]

    def write(self, rows: Iterator) -> parts.Part:
        _, name = parts.pending(self.path, self.job)
        db = connected(name, write=True)
        n = 0

        def plain(row) -> tuple:
            nonlocal n
            n += 1
            return tuple(v.isoformat(sep=" ") if isinstance(v, datetime.datetime) else str(v) if isinstance(v, datetime.date) else bytes(v) if isinstance(v, bytearray) else v for v in row)

        try:
            db.execute(f"CREATE TABLE {quoted(self.table)} ({', '.join(f'{quoted(c)} {k}' for c, k in self.columns)})")
            db.executemany(f"INSERT INTO {quoted(self.table)} VALUES ({', '.join('?' * len(self.columns))})", map(plain, rows))
            db.commit()
        finally:
            db.close()
        return parts.Part(name, n)

    def commit(self, messages: list) -> None:
        parts.commit(self.path, self.job, messages, ENDS[0])

    def abort(self, messages: list) -> None:
        parts.cleared(self.path, self.job)


class DatabaseSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "database"

    def schema(self) -> str:
        files = parts.files_of(self.options["path"], ENDS)
        if not files:
            raise ValueError(f"no database below {self.options['path']}")
        db = connected(files[0][0])
        try:
            columns = db.execute(f"PRAGMA table_info({quoted(self.options['table'])})").fetchall()
        finally:
            db.close()
        if not columns:
            raise ValueError(f"no table {self.options['table']}")
        return ", ".join(f"`{c[1]}` {type_of(c[2])}" for c in columns)

    def reader(self, schema: StructType) -> Reader:
        return Reader(self.options, schema)

    def writer(self, schema: StructType, overwrite: bool) -> Writer:
        if overwrite:
            raise ValueError("databases are only appended: give a new folder")
        return Writer(self.options, schema)


def register(spark) -> None:
    """Makes the format known to a session, with filters pushed to it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(DatabaseSource)

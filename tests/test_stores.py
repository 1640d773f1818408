"""Tensor files and benchmark databases: ranges, pushed filters, commits and aborts."""

import json
import os
import random
import sqlite3
import struct
import time

import numpy as np
import pytest
from pyspark.sql.datasource import EqualTo, GreaterThan, In, StringStartsWith

from lyrebird.operators import segments
from lyrebird.sources import databases, files, parts, tensors


def safetensors(path, arrays):
    about, at = {"__metadata__": {"k": "v"}}, 0
    for name, (dtype, a) in arrays.items():
        about[name] = {"dtype": dtype, "shape": list(a.shape), "data_offsets": [at, at + a.nbytes]}
        at += a.nbytes
    head = json.dumps(about).encode()
    path.write_bytes(struct.pack("<Q", len(head)) + head + b"".join(a.tobytes() for _, a in arrays.values()))


@pytest.fixture
def containers(tmp_path):
    safetensors(tmp_path / "a.safetensors", {"wide": ("F32", np.arange(60_000, dtype=np.float32).reshape(300, 200)), "half": ("F16", np.array([0.5, -2], dtype=np.float16)), "none": ("F32", np.zeros(0, dtype=np.float32)), "packed": ("Q9", np.zeros(7, dtype=np.uint8))})
    fields = [("general.alignment", 4, 32), ("tokens", 9, (8, [f"token {i}" for i in range(20_000)]))]  # a header longer than the first read
    (tmp_path / "b.gguf").write_bytes(files.write_container(fields, [("layer.0", 0, [3], np.array([1, 2, 3], dtype="<f4").tobytes()), ("layer.1", 26, [2], np.array([7, -7], dtype="<i4").tobytes()), ("q", 2, [32], b"\1" * 18)]))
    return tmp_path


def test_tensors_are_read_by_name(spark, containers):
    tensors.register(spark)
    everything = spark.read.format("tensors").load(str(containers))
    rows = {r.name: r for r in everything.collect()}
    assert set(rows) == {"wide", "half", "none", "packed", "layer.0", "layer.1", "q"}
    assert rows["wide"].shape == [300, 200] and rows["wide"]["values"] == list(range(60_000))
    assert rows["half"]["values"] == [0.5, -2.0] and rows["none"]["values"] == [] and rows["packed"]["values"] is None
    assert rows["layer.0"]["values"] == [1.0, 2.0, 3.0] and rows["layer.1"]["values"] == [7.0, -7.0] and rows["q"].dtype == "type 2"
    one = everything.where("name = 'layer.1'")
    assert [r["values"] for r in one.collect()] == [[7.0, -7.0]] and one.rdd.getNumPartitions() == 1
    assert {r.name for r in everything.where("name LIKE 'layer%'").collect()} == {"layer.0", "layer.1"}
    assert everything.where("name = 'absent'").count() == 0
    assert all(r["values"] is None for r in spark.read.format("tensors").option("values", "false").load(str(containers)).collect())


def test_only_ranges_are_read(containers, monkeypatch):
    total = []
    original = parts.fs.FileSystem.open_input_file

    class Counted:
        def __init__(self, file):
            self.file = file

        def __enter__(self):
            return self

        def __exit__(self, *_):
            self.file.close()

        def read_at(self, n, at):
            total.append(n)
            return self.file.read_at(n, at)

    class Store:
        def __init__(self, store):
            self.store = store

        def open_input_file(self, path):
            return Counted(original(self.store, path))

        def __getattr__(self, name):
            return getattr(self.store, name)

    opened = parts.opened
    monkeypatch.setattr(parts, "opened", lambda path: (Store(opened(path)[0]), opened(path)[1]))
    reader = tensors.Reader({"path": str(containers / "a.safetensors")})
    assert list(reader.pushFilters([EqualTo(("name",), "half"), EqualTo(("dtype",), "F16")])) == [EqualTo(("dtype",), "F16")]
    rows = [r for p in reader.partitions() for r in reader.read(p)]
    assert [r[1] for r in rows] == ["half"] and sum(total) < 1000 < os.path.getsize(containers / "a.safetensors")
    assert reader.wanted("x", "half") and not reader.wanted("x", "other")
    reader = tensors.Reader({"path": str(containers)})
    assert not list(reader.pushFilters([In(("name",), ("q", "layer.0")), StringStartsWith(("name",), "la")]))
    assert [t.name for p in reader.partitions() for t in p.tensors] == ["layer.0"]


def test_tensors_of_broken_and_absent_files(spark, tmp_path):
    (tmp_path / "x.safetensors").write_bytes(struct.pack("<Q", 1 << 40) + b"{}")
    with pytest.raises(ValueError, match="longer than its file"):
        tensors.header(str(tmp_path / "x.safetensors"))
    (tmp_path / "y.gguf").write_bytes(b"GGUF\3\0\0\0\1")
    with pytest.raises(struct.error):
        tensors.header(str(tmp_path / "y.gguf"))
    empty = tmp_path / "empty"
    empty.mkdir()
    tensors.register(spark)
    assert spark.read.format("tensors").load(str(empty)).count() == 0


def test_partitions_follow_bytes(containers):
    reader = tensors.Reader({"path": str(containers / "a.safetensors"), "bytes": "100"})
    assert [[t.name for t in p.tensors] for p in reader.partitions()] == [["wide"], ["half", "none", "packed"]]


def test_a_failed_write_leaves_nothing(spark, tmp_path):
    tensors.register(spark)
    databases.register(spark)
    twice = spark.createDataFrame([("a", [1], [0.5]), ("a", [1], [1.5])], "name string, shape array<long>, values array<double>").coalesce(1)
    with pytest.raises(Exception, match="two tensors"):
        twice.write.format("tensors").mode("append").save(str(tmp_path / "t"))
    assert not list(tmp_path.rglob("part-*"))
    rows = spark.range(1000).selectExpr("id", "CASE WHEN id = 990 THEN raise_error('lost') ELSE 'x' END AS kind").repartition(3)
    with pytest.raises(Exception, match="lost"):
        rows.write.format("database").option("table", "runs").mode("append").save(str(tmp_path / "d"))
    assert not list(tmp_path.rglob("part-*"))
    writer = databases.Writer({"path": str(tmp_path / "e"), "table": "t"}, spark.range(1).schema)
    done = writer.write(iter([(1,), (2,)]))
    writer.write(iter([(1,), (2,)]))  # an attempt of the same task that was lost
    writer.commit([done, None])
    assert len(os.listdir(tmp_path / "e")) == 1 and os.listdir(tmp_path / "e")[0].endswith(".db")


def test_database_round_trip_and_splits(spark, tmp_path):
    databases.register(spark)
    rows = [(i, f"name {i} 'q'" if i % 7 else None, i / 4, bytes([i % 256])) for i in range(5000)]
    frame = spark.createDataFrame(rows, "id long, `odd name` string, v double, raw binary").repartition(3)
    frame.write.format("database").option("table", "the runs").mode("append").save(str(tmp_path / "db"))
    read = spark.read.format("database").option("table", "the runs").option("rows", "300").load(str(tmp_path / "db"))
    assert read.dtypes == [("id", "bigint"), ("odd name", "string"), ("v", "double"), ("raw", "binary")]
    assert sorted((r[0], r[1], r[2], bytes(r[3])) for r in read.collect()) == rows
    assert read.rdd.getNumPartitions() >= 15
    assert read.where("id >= 4990 AND v < 1248").count() == 2
    assert read.where("`odd name` IS NULL").count() == len([r for r in rows if r[1] is None])
    reader = databases.Reader({"path": str(tmp_path / "db"), "table": "the runs"}, read.schema)
    assert not list(reader.pushFilters([GreaterThan(("id",), 4000), EqualTo(("odd name",), "name 4001 'q'")]))
    assert [r[0] for p in reader.partitions() for r in reader.read(p)] == [4001]


def test_database_with_gaps_and_declared_types(spark, tmp_path):
    db = sqlite3.connect(tmp_path / "own.sqlite")
    db.execute("CREATE TABLE t (a INTEGER, b VARCHAR(20), c REAL, d BLOB)")
    db.executemany("INSERT INTO t VALUES (?, ?, ?, ?)", [(i, "x", 0.5, b"y") for i in range(100)])
    db.execute("DELETE FROM t WHERE a % 10 <> 3")
    db.execute("CREATE TABLE bare (a INTEGER)")
    db.commit()
    db.close()
    databases.register(spark)
    load = lambda name: spark.read.format("database").option("table", name).option("rows", 7).load(str(tmp_path / "own.sqlite"))
    assert sorted(r.a for r in load("t").collect()) == list(range(3, 100, 10))
    assert load("bare").count() == 0
    with pytest.raises(Exception, match="no table"):
        load("absent").count()


def plain_rising(x):
    """The quadratic rule: the earliest best predecessor, the earliest best end."""
    length, back = [1] * len(x), [-1] * len(x)
    for i in range(len(x)):
        for j in range(i):
            if x[j] <= x[i] and length[j] + 1 > length[i]:
                length[i], back[i] = length[j] + 1, j
    at, out = length.index(max(length)) if x else -1, []
    while at >= 0:
        out.append(at)
        at = back[at]
    return out[::-1]


def test_longest_rising_picks_what_the_quadratic_rule_picks():
    rng = random.Random(1)
    for n in (0, 1, 2, 3, 10, 60):
        for _ in range(60):
            x = [rng.randrange(rng.choice([3, 10, 1000])) for _ in range(n)]
            assert segments.longest_rising(x) == plain_rising(x)


def test_many_stamps_are_repaired_at_once():
    rng = random.Random(2)
    stamps = [i * 10 + (rng.randrange(5000) if rng.random() < 0.2 else 0) for i in range(100_000)]
    began = time.time()
    fixed = segments._repaired(stamps)
    assert time.time() - began < 2 and fixed == sorted(fixed) and len(fixed) == len(stamps)
    with pytest.raises(ValueError, match="no stamps"):
        segments._repaired([], refuse_empty=True)

import base64
import json
import struct
import wave

import numpy as np
import pytest

from lyrebird.sources import files
from lyrebird.streaming import chunks


def test_model_container(spark, tmp_path):
    fields = [("general.name", 8, "x é"), ("general.alignment", 4, 32), ("a.f", 6, 0.5), ("a.ok", 7, True), ("a.list", 9, (8, ["p", "q"])), ("a.big", 10, 2**63 + 1)]
    tensors = [("t1", 0, [4, 2], b"\1" * 32), ("t2", 8, [32], b"\2" * 34)]
    data = files.write_container(fields, tensors)
    (tmp_path / "m.gguf").write_bytes(data)
    found = {r.key: (r.type, json.loads(r.value)) for r in files.read_fields(spark, str(tmp_path)).collect()}
    assert found == {"general.name": (8, "x é"), "general.alignment": (4, 32), "a.f": (6, 0.5), "a.ok": (7, True), "a.list": (9, ["p", "q"]), "a.big": (10, 2**63 + 1)}
    for r in files.read_tensors(spark, str(tmp_path)).collect():
        body = {"t1": b"\1" * 32, "t2": b"\2" * 34}[r.name]
        assert data[r.data_offset : r.data_offset + len(body)] == body and r.data_offset % 32 == 0
    with pytest.raises(ValueError, match="not a model"):
        files.parse_container(b"xxxx")
    with pytest.raises(ValueError, match="one name"):
        files.parse_container(files.write_container([], [tensors[0], tensors[0]]))


def test_wav_and_safetensors(spark, tmp_path):
    with wave.open(str(tmp_path / "a.wav"), "wb") as sound:
        sound.setparams((2, 2, 16000, 0, "NONE", ""))
        sound.writeframes(struct.pack("<4h", 16384, 0, -32768, -32768))
    row = files.read_wav(spark, str(tmp_path)).first()
    assert row.sr == 16000 and np.allclose(row.wav, [0.25, -1.0])
    head = json.dumps({"__metadata__": {}, "w": {"dtype": "F32", "shape": [2], "data_offsets": [0, 8]}}).encode()
    (tmp_path / "m.safetensors").write_bytes(struct.pack("<Q", len(head)) + head + b"\0" * 8)
    row = files.read_safetensors(spark, str(tmp_path)).first()
    assert (row.name, row.dtype, row.shape, row.begin, row.end) == ("w", "F32", [2], 8 + len(head), 16 + len(head))


def test_runs_dictionary_and_lines(spark, tmp_path):
    (tmp_path / "r.csv").write_text("a,b\nx,1\ny,\n")
    (tmp_path / "r.jsonl").write_text('{"a": "x", "b": 1}\n{"a": "y"}\n')
    (tmp_path / "r.json").write_text('[{"a": "x", "b": 1}, {"a": "y"}]')
    for form in ("csv", "jsonl", "json"):
        rows = files.read_runs(spark, str(tmp_path / f"r.{form}"), "a string, b int", form).orderBy("a").collect()
        assert [tuple(r) for r in rows] == [("x", 1), ("y", None)]
    (tmp_path / "ko.txt").write_text("단어 1\n\n 둘 2\n단어 3\n")
    assert {r.word for r in files.dictionary(spark, str(tmp_path / "ko.txt")).collect()} == {"단어", "둘"}
    files.write_lines(spark.createDataFrame([("one",), ("two",)], "value string").coalesce(1), str(tmp_path / "out"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "out")).collect()) == ["one", "two"]


def test_stream_equals_batch(spark, tmp_path):
    rows = [(i, f"2024-01-01 00:{i // 60:02d}:{i % 60:02d}", i % 7, "click", float(i), "{}") for i in range(200)]
    table = spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string, value double, props string")
    table.withColumn("ts", table["ts"].cast("timestamp_ntz")).coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    found = sorted(tuple(r)[:4] for r in chunks.run_to_end(spark, str(tmp_path), 5).collect())
    expected = []
    for session in range(7):
        own = [float(i) for i in range(200) if i % 7 == session]
        expected += [(session, k, 5, sum(own[5 * k : 5 * k + 5])) for k in range(len(own) // 5)]
    assert found == sorted(expected)


def test_load_audio_by_path_payload_and_seek(spark, tmp_path):
    import wave

    from pyspark.errors import PySparkException

    with wave.open(str(tmp_path / "a.wav"), "wb") as sound:
        sound.setnchannels(2)
        sound.setsampwidth(2)
        sound.setframerate(8)
        sound.writeframes(struct.pack("<16h", *[v for i in range(8) for v in (i * 1000, i * 3000)]))
    content = (tmp_path / "a.wav").read_bytes()
    refs = spark.createDataFrame([(1, str(tmp_path / "a.wav")), (2, "data:audio/wav;base64," + base64.b64encode(content).decode()), (3, None)], "id int, ref string")
    found = {r.id: r.wav for r in files.load_audio(refs, files._binary(spark, str(tmp_path), "*.wav"), 0.25, 0.5, 8).collect()}
    expected = [i * 2000 / 32768 for i in range(2, 6)]
    assert found == {1: expected, 2: expected, 3: None}
    for bad in ("https://host/a.wav", str(tmp_path / "none.wav")):
        with pytest.raises(PySparkException):
            files.load_audio(spark.createDataFrame([(1, bad)], "id int, ref string"), files._binary(spark, str(tmp_path), "*.wav"), rate=8).collect()

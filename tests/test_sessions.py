"""Stateful sessions and greedy shards against plain versions."""

import random
from datetime import datetime, timedelta, timezone

import pandas as pd
from pyspark.sql import functions as F

from lyrebird.operators.shards import greedy_shards
from lyrebird.streaming import sessions

START = datetime(2024, 1, 1, tzinfo=timezone.utc)


def test_spans_merge():
    spans = [(0, 0, 1, 1.0), (900, 900, 1, 2.0), (450, 500, 2, 3.0)]
    assert sessions.merged(spans, 451) == [(0, 900, 4, 6.0)]
    assert sessions.merged(spans, 400) == [(0, 0, 1, 1.0), (450, 500, 2, 3.0), (900, 900, 1, 2.0)]


def test_touch_lookup_late_rows_and_restart(spark, tmp_path):
    """Each file is streamed by a run of its own, from the progress of the one before."""
    home, asked = str(tmp_path / "home"), str(tmp_path / "asked")
    spark.createDataFrame([], sessions.REQUESTS).write.parquet(asked)
    requests = spark.readStream.schema(sessions.REQUESTS).parquet(asked)

    def send(*rows):
        frame = spark.createDataFrame([(u, START + timedelta(seconds=s), k, v) for u, s, k, v in rows], sessions.REQUESTS)
        frame.coalesce(1).write.mode("append").parquet(asked)
        sessions.run(requests, home)
        return {tuple(r) for r in spark.read.schema(sessions.OUTPUT).parquet(f"{home}/out").selectExpr("user_id", "outcome", "n", "total").collect()}

    send((1, 0, "event", 1.0), (1, 1000, "event", 2.0), (2, 0, "lookup", None))
    found = send((1, 500, "event", 4.0), (1, 1000, "lookup", None))  # late, but not below the watermark: joins both
    assert found == {(2, "missing", 0, 0.0), (1, "found", 3, 7.0)}
    found = send((3, 9000, "event", 1.0)) | send((3, 9100, "event", 1.0))  # the watermark passes user 1's expiry
    assert (1, "closed", 3, 7.0) in found and not any(u == 3 for u, *_ in found)
    assert (3, "closed", 2, 2.0) in send((3, 9200, "finish", None))


def test_spans_of_users_are_joined_apart():
    rng = random.Random(5)
    users = [(True, 0), (True, -3), (True, 2**53 + 1), (True, 2**53 + 2), (False, 0)]
    spans = [(*rng.choice(users), began, began + rng.choice([0, 0, 40]), 1, 0.5) for began in (rng.randrange(3000) for _ in range(200))]
    found = sessions.joined(pd.DataFrame(spans, columns=list(sessions.SPAN)).astype(sessions.SPAN), 9)
    assert list(found.dtypes) == list(sessions.SPAN.values())
    for known, user in users:
        plain = []
        for began, last in sorted(s[2:4] for s in spans if s[:2] == (known, user)):
            if plain and began - plain[-1][1] < 9:
                plain[-1] = (plain[-1][0], max(plain[-1][1], last), plain[-1][2] + 1, plain[-1][3] + 0.5)
            else:
                plain.append((began, last, 1, 0.5))
        own = found[(found["known"] == known) & (found["user_id"] == user)]
        assert list(own[["began", "last", "n", "total"]].itertuples(index=False, name=None)) == plain


def test_users_share_a_key_of_the_state(spark, tmp_path, monkeypatch):
    """Users of one key, among them none and large ids, keep sessions of their own, in one list and under one timer."""
    monkeypatch.setattr(sessions, "BUCKETS", 1)
    home, asked = str(tmp_path / "home"), str(tmp_path / "asked")
    spark.createDataFrame([], sessions.REQUESTS).write.parquet(asked)
    requests = spark.readStream.schema(sessions.REQUESTS).parquet(asked)
    large = 2**53 + 1

    def send(*rows):
        frame = spark.createDataFrame([(u, START + timedelta(seconds=s), k, v) for u, s, k, v in rows], sessions.REQUESTS)
        frame.coalesce(1).write.mode("append").parquet(asked)
        sessions.run(requests, home)
        return sorted((str(r[0]), *r[1:]) for r in spark.read.schema(sessions.OUTPUT).parquet(f"{home}/out").select("user_id", "outcome", "n", "total").collect())

    found = send((None, 0, "event", 1.0), (0, 10, "event", None), (large, 20, "event", 4.0), (large + 1, 30, "event", 8.0), (None, 40, "event", 2.0), (large, 50, "lookup", None), (7, 50, "lookup", None))
    assert found == sorted([(str(large), "found", 1, 4.0), ("7", "missing", 0, 0.0)])
    closed = [r for r in send((None, 60, "finish", None), (large + 1, 70, "event", 16.0), (large + 1, 80, "finish", None), (0, 90, "lookup", None)) if r not in found]
    assert closed == sorted([("None", "closed", 2, 3.0), (str(large + 1), "closed", 2, 24.0), ("0", "found", 1, 0.0)])


class Key:
    """The state and timers of one key, with the calls made to them."""

    def __init__(self):
        self.list, self.timers, self.calls = [], set(), []

    def getListState(self, name, schema):
        return self

    def exists(self):
        self.calls.append("exists")
        return bool(self.list)

    def get(self):
        self.calls.append("get")
        return iter(self.list)

    def put(self, rows):
        self.calls.append("put")
        self.list = rows

    def clear(self):
        self.calls.append("clear")
        self.list = []

    def listTimers(self):
        self.calls.append("listTimers")
        return iter(sorted(self.timers))

    def registerTimer(self, at):
        self.calls.append("registerTimer")
        self.timers.add(at)

    def deleteTimer(self, at):
        self.calls.append("deleteTimer")
        self.timers.discard(at)


class Watermark:
    def __init__(self, ms):
        self.ms = ms

    def getCurrentWatermarkInMs(self):
        return self.ms


def processor():
    key, own = Key(), sessions.Sessions(600)
    own.init(key)

    def send(*batches):
        key.calls = []
        frames = [pd.DataFrame(rows, columns=["known", "user_id", "at", "kind", "value"]) for rows in batches]
        found = list(own.handleInputRows((0,), iter(frames), None))
        return [tuple(None if pd.isna(v) else v for v in r) for f in found for r in f.itertuples(index=False)]

    def expire(ms):
        key.calls = []
        return [tuple(r) for f in own.handleExpiredTimer((0,), Watermark(ms), None) for r in f.itertuples(index=False)]

    return key, send, expire


def spans(key):
    return list(sessions.unpacked(key.list).itertuples(index=False, name=None))


def test_a_key_makes_only_the_calls_that_change_its_state():
    """Each call waits for an answer of the JVM, so a key without sessions isn't asked for timers and nothing is written that stays as it was."""
    key, send, expire = processor()
    second = 1_000_000
    assert send([(True, 1, 0, "event", 1.0), (True, 1, 900 * second, "event", 2.0)]) == []
    assert key.calls == ["get", "registerTimer", "put"] and key.timers == {600_000}
    assert send([(True, 1, 0, "lookup", None)]) == [(1, "found", 900 * second, 1500 * second, 1, 2.0)]
    assert key.calls == ["get"]
    assert expire(600_000) == [(1, "closed", 0, 600 * second, 1, 1.0)]
    assert key.timers == {1_500_000}
    assert send([(True, 1, 900 * second, "event", None)]) == []
    assert key.calls == ["get", "listTimers", "put"] and key.timers == {1_500_000}
    assert send([(True, 1, 0, "finish", None)]) == [(1, "closed", 900 * second, 1500 * second, 2, 2.0)]
    assert key.calls == ["get", "listTimers", "deleteTimer", "clear"] and not key.timers
    assert send([(True, 1, 0, "finish", None)]) == []
    assert key.calls == ["get"]


def test_odd_rows_of_a_key():
    """No time, no value, no kind, an unknown kind, no user, repeated rows and requests, in several batches."""
    key, send, expire = processor()
    second = 1_000_000
    first = [(True, 0, None, "event", 1.0), (False, 0, 5.0 * second, "event", None), (False, 0, 5.0 * second, "event", None), (True, 0, 1.0 * second, None, 1.0), (True, 0, 1.0 * second, "touch", 1.0)]
    assert send(first, [(True, 0, 9 * second, "event", 4.0), (True, 0, 9 * second, "event", 4.0)]) == []
    assert spans(key) == [(False, 0, 5 * second, 5 * second, 2, 0.0), (True, 0, 9 * second, 9 * second, 2, 8.0)] and key.timers == {605_000}
    asked = [(u, i, 0, k, None) for k in ("lookup", "finish", "lookup") for u, i in ((False, 0), (True, 7))]
    found = send(asked[:4], asked[4:])
    assert found == [(None, "found", 5 * second, 605 * second, 2, 0.0), (7, "missing", None, None, 0, 0.0), (None, "closed", 5 * second, 605 * second, 2, 0.0)]
    assert spans(key) == [(True, 0, 9 * second, 9 * second, 2, 8.0)] and key.timers == {609_000}
    assert send([(True, 0, None, "event", None)], [(True, 7, 0, "finish", None)]) == []
    assert expire(608_999) == [] and key.timers == {609_000}
    assert expire(609_000) == [(0, "closed", 9 * second, 609 * second, 2, 8.0)] and not key.list and not key.timers


def test_a_user_is_one_row_of_the_state():
    """Spark passes each row of a list with its schema, so 300 sessions of three users are three rows, in which all of them are found again."""
    key, send, expire = processor()
    second, large = 1_000_000, 2**53 + 1
    users = [(False, 0), (True, 0), (True, large)]
    assert send([(*user, 1000 * second * i, "event", 0.5) for i in reversed(range(100)) for user in users]) == []
    assert [row[:2] for row in key.list] == users
    assert spans(key) == [(*user, 1000 * second * i, 1000 * second * i, 1, 0.5) for user in users for i in range(100)]
    assert sessions.packed(sessions.unpacked(key.list)) == key.list
    assert len(expire(50_600_000)) == 51 * 3 and len(spans(key)) == 49 * 3 and key.timers == {51_600_000}
    assert len(send([(True, large, 0, "finish", None)])) == 49 and [row[:2] for row in key.list] == users[:2]
    assert sessions.packed(sessions.unpacked([])) == []


def test_greedy_shards(spark):
    rng = random.Random(3)
    items = [(g, i, rng.choice([1, 2, 7, 30, 61, 200])) for g in range(3) for i in range(200 if g else 1)]
    items += [(9, i, 1) for i in range(5000)] + [(None, 0, 5), (4, 0, None)]
    df = spark.createDataFrame(items, "g int, i int, size int").withColumn("before", F.lit("clash"))
    found = {}
    for r in greedy_shards(df, "g", F.floor(F.col("i") / 37), ["i"], "size", 60).orderBy("g", "shard").collect():
        found.setdefault(r.g, []).append(r["size"])
    plain = {}
    for g, _, size in items:
        if g is not None and size:
            own = plain.setdefault(g, [])
            if own and own[-1] + size <= 60:
                own[-1] += size
            else:
                own.append(size)
    assert found == plain
    assert greedy_shards(df.limit(0), "g", F.lit(0), ["i"], "size", 60).count() == 0

"""Sessions of a stream: touched by each event, looked up on request, closed by event time or on finish.

Users are dealt to BUCKETS keys by hash, as a key costs several calls to the state, some milliseconds, however
little it holds. Each key holds its users' open sessions in list state, as one row (known, user_id, began, last,
n, total) a user, the last four arrays with a value for each session, as Spark passes each row of a list with its
schema. A user has several where events come late enough to fall before a younger session, or where a batch brings
more than one. A batch's events are folded into runs first and then merged with the open
sessions, so an event between two sessions joins them. One event-time timer a key stands at its earliest
expiry. Late events below the watermark are dropped by Spark; events without a time and unknown kinds are
ignored; a null user is a user like others.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from lyrebird.sources.scratch import shared

#: Keys that users are dealt to; a key's open sessions are in memory at once. It must stay the same as long as a stream goes on.
BUCKETS = 2048
#: What a key keeps of a user; streams whose state was begun with other columns can't go on with it.
OPEN = "known boolean, user_id long, began array<long>, last array<long>, n array<long>, total array<double>"
OUTPUT = "user_id long, outcome string, began long, expires long, n long, total double"
EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
REQUESTS = "user_id long, ts timestamp, kind string, value double"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def merged(spans: list[tuple], ttl: int) -> list[tuple]:
    """Spans (began, last, n, total) of one user joined where less than ttl lies between them."""
    found = joined(unpacked([(True, 0, *zip(*spans, strict=True))] if spans else []), ttl)
    return list(found[list(SPAN)[2:]].itertuples(index=False, name=None))


#: Columns of spans; user_id is 0 for the user that isn't known.
SPAN = {"known": "bool", "user_id": "int64", "began": "int64", "last": "int64", "n": "int64", "total": "float64"}
USER = ["known", "user_id"]


def unpacked(users: list[tuple]) -> pd.DataFrame:
    """Spans of the rows of OPEN, each column made in its own type at once: a frame that guesses types and casts them takes milliseconds a key."""
    known, user, *rest = zip(*users, strict=True) if users else [()] * len(SPAN)
    sizes = [len(began) for began in rest[0]]
    whose = {c: np.repeat(np.array(values, SPAN[c]), sizes) for c, values in zip(USER, (known, user), strict=True)}
    return pd.DataFrame(whose | {c: np.fromiter(chain.from_iterable(values), SPAN[c], sum(sizes)) for c, values in zip(list(SPAN)[2:], rest, strict=True)})


def packed(spans: pd.DataFrame) -> list[tuple]:
    """Rows of OPEN of spans in the order of users."""
    if not len(spans):
        return []
    known, user, *rest = (spans[c].to_numpy() for c in SPAN)
    at = np.flatnonzero(others(known, user))
    lists = ([own.tolist() for own in np.split(values, at[1:])] for values in rest)
    return list(zip(known[at].tolist(), user[at].tolist(), *lists, strict=True))


def others(known: np.ndarray, user: np.ndarray) -> np.ndarray:
    """Which rows, one at least, are of another user than the row before."""
    return np.append(True, (user[1:] != user[:-1]) | (known[1:] != known[:-1]))


def joined(spans: pd.DataFrame, ttl: int) -> pd.DataFrame:
    """Spans joined where less than ttl lies between two of a user, in the order of users and times."""
    if not len(spans):
        return spans
    columns = [spans[c].to_numpy() for c in SPAN]
    order = np.lexsort(columns[::-1])
    known, user, began, last, n, total = (values[order] for values in columns)
    other = others(known, user)
    last = np.concatenate([np.maximum.accumulate(own) for own in np.split(last, np.flatnonzero(other)[1:])])
    at = np.flatnonzero(other | np.append(True, began[1:] - last[:-1] >= ttl))
    ends = np.append(at[1:], len(spans)) - 1
    return pd.DataFrame({"known": known[at], "user_id": user[at], "began": began[at], "last": last[ends], "n": np.add.reduceat(n, at), "total": np.add.reduceat(total, at)})


def of_users(spans: pd.DataFrame, users: pd.DataFrame) -> np.ndarray:
    """Which rows belong to users with a row in `users`."""
    asked = set(zip(*(users[c].tolist() for c in USER), strict=True))
    return np.fromiter((user in asked for user in zip(*(spans[c].tolist() for c in USER), strict=True)), bool, len(spans))


class Sessions(StatefulProcessor):
    """Rows (known, user_id, at in microseconds, kind, value) of a key's users: `event` touches, `lookup` reports, `finish` closes all of a user's."""

    def __init__(self, ttl: int) -> None:
        self.ttl = ttl * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getListState("open", OPEN)

    def _rows(self, outcome: str, spans: pd.DataFrame) -> pd.DataFrame:
        user = pd.arrays.IntegerArray(spans["user_id"].to_numpy(), ~spans["known"].to_numpy())
        return pd.DataFrame({"user_id": user, "outcome": outcome, "began": spans["began"].to_numpy(), "expires": spans["last"].to_numpy() + self.ttl, "n": spans["n"].to_numpy(), "total": spans["total"].to_numpy()})

    def _missing(self, users: pd.DataFrame) -> pd.DataFrame:
        none = pd.array([None] * len(users), dtype="Int64")
        return pd.DataFrame({"user_id": users["user_id"].astype("Int64").where(users["known"]), "outcome": "missing", "began": none, "expires": none, "n": 0, "total": 0.0})

    def _held(self) -> pd.DataFrame:
        return unpacked(list(self.open.get()))

    def _keep(self, held: pd.DataFrame, spans: pd.DataFrame) -> None:
        """`spans` instead of `held`; a key without sessions has neither a list nor a timer."""
        due = [-(-(int(spans["last"].min()) + self.ttl) // 1000)] if len(spans) else []
        standing = list(self.handle.listTimers()) if len(held) else []
        for timer in standing:
            if timer not in due:
                self.handle.deleteTimer(timer)
        for timer in due:
            if timer not in standing:
                self.handle.registerTimer(timer)
        if len(spans):
            self.open.put(packed(spans))
        elif len(held):
            self.open.clear()

    @staticmethod
    def _touched(events: pd.DataFrame, which: np.ndarray) -> dict[str, np.ndarray]:
        """The columns of spans of one event each."""
        at = events["at"].to_numpy()[which].astype("int64")
        value = events["value"].to_numpy()[which].astype("float64")
        known, user = (events[c].to_numpy()[which].astype(SPAN[c]) for c in USER)
        return {"known": known, "user_id": user, "began": at, "last": at, "n": np.ones(len(at), "int64"), "total": np.where(np.isnan(value), 0.0, value)}

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        spans = held = self._held()
        asked = {"lookup": [], "finish": []}
        for batch in rows:
            kinds = batch["kind"].to_numpy()
            for kind, users in asked.items():
                if (own := kinds == kind).any():
                    users.append(batch.loc[own, USER].astype({c: SPAN[c] for c in USER}))
            events = (kinds == "event") & batch["at"].notna().to_numpy()
            if events.any():
                touched = self._touched(batch, events)
                spans = joined(pd.DataFrame({c: np.concatenate([spans[c].to_numpy(), touched[c]]) for c in SPAN}), self.ttl)
        if asked["lookup"]:
            lookup = pd.concat(asked["lookup"], ignore_index=True).drop_duplicates(ignore_index=True)
            youngest = spans[of_users(spans, lookup)].drop_duplicates(USER, keep="last")
            yield pd.concat([self._rows("found", youngest), self._missing(lookup[~of_users(lookup, youngest)])], ignore_index=True)
        if asked["finish"] and len(spans):
            ended = of_users(spans, pd.concat(asked["finish"], ignore_index=True))
            if ended.any():
                yield self._rows("closed", spans[ended])
                spans = spans[~ended]
        if spans is not held:
            self._keep(held, spans)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        spans = self._held()
        done = (spans["last"] + self.ttl <= timerValues.getCurrentWatermarkInMs() * 1000).to_numpy()
        self._keep(spans, spans[~done])
        if done.any():
            yield self._rows("closed", spans[done])


def sessions(requests: DataFrame, ttl: int, late: str) -> DataFrame:
    """OUTPUT of a stream of REQUESTS; times in microseconds. Needs the RocksDB state store, see `run`."""
    timed = requests.withWatermark("ts", late).withColumn("at", F.unix_micros("ts"))
    user = [F.col("user_id").isNotNull().alias("known"), F.coalesce("user_id", F.lit(0)).cast("long").alias("user_id")]
    dealt = timed.select(F.pmod(F.xxhash64("user_id"), F.lit(BUCKETS)).alias("bucket"), *user, "ts", "at", "kind", "value")
    return dealt.groupBy("bucket").transformWithStateInPandas(Sessions(ttl), OUTPUT, "Append", "EventTime")


def run(requests: DataFrame, home: str, ttl: int = 600, late: str = "10 minutes") -> None:
    """Streams what is there now into `home`/out and stops; a further run goes on from the progress there."""
    conf = requests.sparkSession.conf
    before = conf.get(PROVIDER, None)
    conf.set(PROVIDER, ROCKS)
    try:
        sessions(requests, ttl, late).writeStream.format("parquet").option("path", f"{home}/out").option("checkpointLocation", f"{home}/progress").trigger(availableNow=True).start().awaitTermination()
    finally:
        conf.unset(PROVIDER) if before is None else conf.set(PROVIDER, before)


def closed(spark: SparkSession, sf_dir: str, ttl: int = 600) -> DataFrame:
    """The event table's sessions: its events in a first run, a finish for each user in a second one on the same state."""
    home = shared(spark, "sessions")
    asked = f"{home}/requests"
    spark.createDataFrame([], REQUESTS).write.parquet(asked)
    events = spark.readStream.schema(EVENTS).parquet(f"{sf_dir}/events.parque[t]").select("user_id", F.col("ts").cast("timestamp").alias("ts"), F.lit("event").alias("kind"), "value")
    requests = events.union(spark.readStream.schema(REQUESTS).parquet(asked).select("user_id", "ts", "kind", "value"))
    run(requests, home, ttl)
    table = spark.read.schema(EVENTS).parquet(f"{sf_dir}/events.parquet")
    end = table.agg((F.max("ts").cast("timestamp") + F.expr("INTERVAL 1 DAY")).alias("ts"))
    table.select("user_id").distinct().crossJoin(F.broadcast(end)).select("user_id", "ts", F.lit("finish").alias("kind"), F.lit(0.0).alias("value")).write.mode("append").parquet(asked)
    run(requests, home, ttl)
    times = [F.timestamp_micros(c).cast("timestamp_ntz").alias(c) for c in ("began", "expires")]
    return spark.read.schema(OUTPUT).parquet(f"{home}/out").where("outcome = 'closed'").select("user_id", *times, "n")

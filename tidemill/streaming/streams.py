"""Streams of messages (id, channel, ts, ...) and request outcomes.

Event times must be TIMESTAMP; parquet's TIMESTAMP_NTZ is cast on the way in.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues
from pyspark.sql.types import StructType

from tidemill.functions import fixed


def read_files(spark: SparkSession, path: str, schema: StructType | str, files_per_trigger: int | None = None) -> DataFrame:
    """SRC-02, SRC-04, STR-07: a folder of parquet files as a stream; its checkpoint remembers what was read."""
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def event_time(df: DataFrame, delay: str, ts: str = "ts") -> DataFrame:
    return df.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)


def ingest(df: DataFrame, sources: DataFrame, delay: str = "1 hour") -> DataFrame:
    """SRC-02, STR-01: messages of known channels, not from bots, each id once within the watermark, with the channel's country. sources (channel, country) is a dimension."""
    known = event_time(df, delay).where(~F.coalesce(F.col("is_bot"), F.lit(False))).drop("country").join(sources, "channel")
    return known.dropDuplicatesWithinWatermark(["id"])


def sliding_counts(df: DataFrame, keys: list[str], width: str = "24 hours", slide: str = "1 hour", delay: str = "1 hour") -> DataFrame:
    """STR-02, STR-05: counts per key in sliding windows."""
    w = F.window("ts", width, slide)
    return event_time(df, delay).groupBy(w, *keys).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), *keys, "n")


def daily_counts(df: DataFrame, keys: list[str], delay: str = "1 hour") -> DataFrame:
    """STR-03: counts per key and day."""
    return event_time(df, delay).groupBy(F.window("ts", "1 day"), *keys).agg(F.count("*").alias("n")).select(F.col("window.start").alias("day"), *keys, "n")


def sessions(df: DataFrame, keys: list[str], gap: str = "10 minutes", delay: str = "1 hour") -> DataFrame:
    """STR-04: sessions per key that a longer gap divides; the open one comes out once the watermark passes it."""
    s = event_time(df, delay).groupBy(F.session_window("ts", gap), *keys).agg(F.count("*").alias("n"))
    return s.select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), *keys, "n")


def climb(level: int, struck: bool, until: float, outcomes: list[tuple[float, int]]) -> tuple[int, bool, float, list[tuple[float, str, float]]]:
    """WIN-11: the penalty ladder of one key over (time, status) in order: new state and (time, verdict, until) of each refusal.

    A first refusal only marks the key; the next puts it on the ladder, a step higher
    each time, and past the last step it is out for the day. A success
    forgives all; so does a quiet time longer than the last penalty.
    """
    ladder, out = fixed.PENALTY_LADDER, []
    for at, status in outcomes:
        if status == 200:
            level, struck, until = 0, False, 0.0
        elif status == 429:
            if until and at - until > ladder[max(level - 1, 0)]:
                level, struck = 0, False
            if level == 0 and not struck:
                struck, until, verdict = True, at, "mark"
            elif level >= len(ladder):
                verdict = "day_ban"
            else:
                level, struck, until, verdict = level + 1, False, at + ladder[level], "wait"
            out.append((at, verdict, until))
    return level, struck, until, out


def in_order(requests: pd.DataFrame) -> pd.DataFrame:
    """A key's requests by time, those of one time by id, if they have one."""
    return requests.sort_values([c for c in ("at", "id") if c in requests.columns], kind="stable")


def decisive(requests: DataFrame) -> DataFrame:
    """Requests that move the ladder: refusals and successes. Others change no state, and a quiet time that one would find over is found by the next of these, or at the end, as ended at the same time.

    Keys are dealt over a number of partitions: without one, small partitions are put together, and all keys into one task.
    """
    each = int(requests.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return requests.where(F.col("status").isin(200, 429)).repartition(each, "key")


def no_repeated_success(requests: pd.DataFrame) -> pd.DataFrame:
    """A key's requests in order, without successes right after a success: those find the key free."""
    success = requests["status"].eq(200)
    return requests[~(success & success.shift(fill_value=False))]


LADDER_OUT = "key string, at double, verdict string, until double"


def penalties(requests: DataFrame) -> DataFrame:
    """WIN-11: batch replay: (key, at, verdict, until) of requests (key, at, status); an id, if there is one, orders those of one time."""

    def replay(group: pd.DataFrame) -> pd.DataFrame:
        group = no_repeated_success(in_order(group))
        *_, out = climb(0, False, 0.0, list(zip(group["at"], group["status"], strict=True)))
        return pd.DataFrame([(group["key"].iloc[0], *o) for o in out], columns=["key", "at", "verdict", "until"])

    return decisive(requests).groupBy("key").applyInPandas(replay, LADDER_OUT)


def penalty_stream(requests: DataFrame) -> DataFrame:
    """STR-06: the same over a stream, the ladder's state kept per key."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        level, struck, until = state.get if state.exists else (0, False, 0.0)
        rows = in_order(pd.concat(batches))
        level, struck, until, out = climb(level, struck, until, list(zip(rows["at"], rows["status"], strict=True)))
        state.update((level, struck, until))
        yield pd.DataFrame([(key[0], *o) for o in out], columns=["key", "at", "verdict", "until"])

    return requests.groupBy("key").applyInPandasWithState(step, LADDER_OUT, "level int, struck boolean, until double", "append", GroupStateTimeout.NoTimeout)


def each_batch(df: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str):
    """STR-08, STR-09, MSC-02: every micro-batch of what is there now through a function; the checkpoint resumes it."""
    return df.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


FORGIVEN = "forgiven"


def quiet_until(level: int, until: float) -> float:
    """When a refusal's penalty is forgiven if nothing else happens: a step's length after its end."""
    return until + fixed.PENALTY_LADDER[max(level - 1, 0)]


Ladder = tuple[int, bool, float]


def after_quiet(state: Ladder, at: float) -> tuple[Ladder, list[tuple[float, str, float]]]:
    """The ladder's state at a time, and the forgiveness that came before."""
    level, struck, until = state
    if until and at > quiet_until(level, until):
        return (0, False, 0.0), [(quiet_until(level, until), FORGIVEN, until)]
    return state, []


def forgiving_penalties(requests: DataFrame) -> DataFrame:
    """STR-06 in batch: penalties() and a row `forgiven` for each penalty that a quiet time ends, at that time: after it the key is free."""

    def replay(group: pd.DataFrame) -> pd.DataFrame:
        key, group = group["key"].iloc[0], no_repeated_success(in_order(group))
        state: Ladder = (0, False, 0.0)
        out: list[tuple[float, str, float]] = []
        for at, status in zip(group["at"], group["status"], strict=True):
            state, rows = after_quiet(state, at)
            out += rows
            *state, rows = climb(*state, [(at, status)])
            state, out = tuple(state), out + rows
        out += after_quiet(state, float("inf"))[1]
        return pd.DataFrame([(key, *o) for o in out], columns=["key", "at", "verdict", "until"])

    return decisive(requests).groupBy("key").applyInPandas(replay, LADDER_OUT)


class ForgivingLadder(StatefulProcessor):
    """The ladder of a key with a timer: a penalty is forgiven when its quiet time is over, also if the key is not heard of again."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.ladder = handle.getValueState("ladder", "level int, struck boolean, until double")

    def _now(self) -> Ladder:
        return tuple(self.ladder.get()) if self.ladder.exists() else (0, False, 0.0)

    def _put(self, state: Ladder) -> None:
        self.ladder.update(state)
        for timer in self.handle.listTimers():
            self.handle.deleteTimer(timer)
        if state[2]:
            # A timer has milliseconds; it fires once the watermark has passed it.
            self.handle.registerTimer(math.ceil(quiet_until(state[0], state[2]) * 1000))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        state, out = self._now(), []
        got = in_order(pd.concat(rows))
        for at, status in zip(got["at"], got["status"], strict=True):
            state, said = after_quiet(state, at)
            out += said
            *state, said = climb(*state, [(at, status)])
            state, out = tuple(state), out + said
        self._put(state)
        yield self._told(key, out)

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        state, out = after_quiet(self._now(), float("inf"))
        self._put(state)
        yield self._told(key, out)

    @staticmethod
    def _told(key: tuple, out: list[tuple[float, str, float]]) -> pd.DataFrame:
        return pd.DataFrame([(key[0], *o) for o in out], columns=["key", "at", "verdict", "until"])

    def close(self) -> None:
        pass


def forgiving_stream(requests: DataFrame, delay: str = "1 minute") -> DataFrame:
    """STR-06: the same over a stream of requests (key, at, status) that come in order of time, by timers on event time.

    Needs the RocksDB state store (spark.sql.streaming.stateStore.providerClass).
    """
    timed = requests.withColumn("ts", F.timestamp_micros((F.col("at") * 1_000_000).cast("long"))).withWatermark("ts", delay)
    return timed.groupBy("key").transformWithStateInPandas(statefulProcessor=ForgivingLadder(), outputStructType=LADDER_OUT, outputMode="Append", timeMode="EventTime")

"""State per key that is forgotten once the key has been idle long enough.

A fold keeps a few numbers per key in the state store.  An event-time timer looks after each key: when the watermark
passes its last event by `idle`, the key leaves the store; a timer that finds a younger event sets itself anew, so a row
costs one read and one write and no timer call.  What was emitted stays with the sink.  A key that comes back begins a
new epoch, named by its first event; epochs never share events, so the sum over epochs does not depend on when a key
was forgotten.

A key may hold a third of all events.  Each key is kept in `salts` parts that are folded apart, by a hash of the event,
and joined when they are read; within a part rows come as a stream of small frames.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@dataclass(frozen=True)
class Fold:
    """What is kept of a key: the schema of its numbers, their start, and a step over a frame of rows."""

    schema: str
    start: Callable[[], tuple]
    step: Callable[[tuple, pd.DataFrame], tuple]


class Forgetful(StatefulProcessor):
    """Applies a fold per key and drops keys that have been idle for `idle_ms` of event time."""

    def __init__(self, fold: Fold, keys: Sequence[str], names: list[str], state: T.StructType, idle_ms: int) -> None:
        self.fold, self.keys, self.names, self.kind, self.idle_ms = fold, list(keys), names, state, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("fold", self.kind)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held = self.state.get()
        known = held is not None
        epoch, last, *kept = tuple(held) if known else (None, None, *self.fold.start())
        for frame in rows:
            if not len(frame):
                continue
            first_us, last_us = int(frame["micros"].min()), int(frame["micros"].max())
            epoch = first_us if epoch is None else epoch if known else min(epoch, first_us)
            last = last_us if last is None else max(last, last_us)
            kept = self.fold.step(tuple(kept), frame)
        if epoch is None:
            return
        if not known:
            self.handle.registerTimer(self._due(last))
        self.state.update((epoch, last, *kept))
        yield pd.DataFrame([[*key, epoch, *kept]], columns=self.names)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = self.state.get()
        if held is not None:
            due = self._due(held[1])
            if due > timerValues.getCurrentWatermarkInMs():
                self.handle.registerTimer(due)
            else:
                self.state.clear()
        yield pd.DataFrame(columns=self.names)

    def _due(self, last_us: int) -> int:
        return last_us // 1000 + self.idle_ms

    def close(self) -> None:
        pass


def folded(events: DataFrame, keys: Sequence[str], time: str, fold: Fold, *, late: str, idle_hours: float, tie: Column, salts: int = 4) -> DataFrame:
    """keys, salt, epoch and the fold's numbers, one row for each key part that a micro-batch touched (update mode)."""
    keys = [*keys, "salt"]
    x = events.withWatermark(time, late).withColumn("salt", F.pmod(F.xxhash64(tie), F.lit(salts)).cast("int")).withColumn("micros", F.unix_micros(time))
    numbers = T._parse_datatype_string(fold.schema)
    state = T.StructType([T.StructField("epoch", T.LongType()), T.StructField("last_us", T.LongType()), *numbers.fields])
    out = T.StructType([*[T.StructField(k, x.schema[k].dataType) for k in keys], T.StructField("epoch", T.LongType()), *numbers.fields])
    return x.groupBy(*keys).transformWithStateInPandas(Forgetful(fold, keys, out.names, state, int(idle_hours * 3_600_000)), out, "update", "eventTime")


# ---------------------------------------------------------------- the folds

def _account_step(state: tuple, rows: pd.DataFrame) -> tuple:
    failed, events, *last = state
    top = max(zip(rows["micros"].tolist(), rows["source"].tolist(), rows["event_id"].tolist(), rows["succeeded"].tolist()))
    if last[0] is None or tuple(last[:3]) < top[:3]:
        last = list(top)
    return failed + int((~rows["succeeded"].astype(bool)).sum()), events + len(rows), *last


#: Failed attempts, events, and the last word (by time, source, event id) of an account.
ACCOUNT = Fold("failed_attempts long, events long, at_us long, source string, event_id string, succeeded boolean", lambda: (0, 0, None, None, None, None), _account_step)


def account_state(events: DataFrame, *, late: str = "30 days", idle_hours: float = 24 * 90, salts: int = 4) -> DataFrame:
    return folded(events, ["account_ref"], "event_ts", ACCOUNT, late=late, idle_hours=idle_hours, tie=F.col("event_id"), salts=salts)


def account_totals(parts: DataFrame) -> DataFrame:
    """One row per account from the last version of each of its parts and epochs."""
    word = F.struct("at_us", "source", "event_id")
    return parts.groupBy("account_ref").agg(F.max_by(F.struct("event_id", "succeeded"), word).alias("last"), F.sum("failed_attempts").alias("failed_attempts"), F.sum("events").alias("events"))


def freshness(events: DataFrame, families: dict[str, str], *, late: str = "1 day", ttl_hours: float = 24 * 7, salts: int = 4) -> DataFrame:
    """Last observation of each feature family; a user without any within the longest time to live is forgotten,
    for then all families are stale whatever they were."""
    names = list(families)

    def step(state: tuple, rows: pd.DataFrame) -> tuple:
        seen = rows.groupby("event_type")["micros"].max().to_dict()
        return tuple(max((v for v in (old, seen.get(families[n])) if v is not None), default=None) for old, n in zip(state, names))
    fold = Fold(", ".join(f"{n} long" for n in names), lambda: (None,) * len(names), step)
    kept = events.where(F.col("event_type").isin(list(families.values())))
    return folded(kept, ["user_id"], "ts", fold, late=late, idle_hours=ttl_hours, tie=F.col("event_id"), salts=salts)


def last_seen(parts: DataFrame, families: Sequence[str]) -> DataFrame:
    return parts.groupBy("user_id").agg(*[F.timestamp_micros(F.max(f)).alias(f) for f in families])

"""Timeouts, and circuit breakers as streams: state by key over ordered events."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from wharfline.streaming.breakers import CLOSED, BreakerRule, Results


def timeouts(df: DataFrame, key: str, ts: str, minutes: int, as_of, start: str = "START", end: str = "END", kind: str = "kind") -> DataFrame:
    """Starts without an end within ``minutes``: the batch form over a table of events."""
    w = Window.partitionBy(key).orderBy(F.desc(ts), F.asc(F.col(kind) == start)).rowsBetween(Window.unboundedPreceding, -1)
    rows = df.filter(F.col(kind).isin(start, end)).withColumn("_end", F.min(F.when(F.col(kind) == end, F.col(ts))).over(w))
    due = F.timestamp_millis(F.unix_millis(ts) + minutes * 60_000)
    late = (F.coalesce("_end", as_of) > due) & (due <= as_of)
    return rows.filter((F.col(kind) == start) & late).select(key, F.col(ts).alias("started_at"), due.alias("due_at"))


def _in_order(rows: Iterator[pd.DataFrame], *columns: str) -> list[np.ndarray]:
    """The columns of a key's rows in a micro-batch as arrays, sorted by the first ones."""
    parts = [[part[c].to_numpy() for c in columns] for part in rows]
    whole = [np.concatenate(c) for c in zip(*parts, strict=True)]
    order = np.lexsort(whole[1::-1])
    return [c[order] for c in whole]


def _due(key: str, at: list[int]) -> pd.DataFrame:
    return pd.DataFrame({"key": pd.Series([key] * len(at), dtype=object), "due_ms": np.array(at, np.int64)})


class _Timeout(StatefulProcessor):
    """Waits for the end of each open start with an event-time timer."""

    def __init__(self, minutes: int):
        self.ms = minutes * 60_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getListState("open", T.StructType([T.StructField("due", T.LongType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        waiting, late = [r[0] for r in self.open.get()], []
        before = set(waiting)
        # at one time, an end comes before a start
        for at, starts in zip(*_in_order(rows, "ms", "starts"), strict=True):
            if starts:
                waiting.append(int(at) + self.ms)
            else:  # ends all that began before; some of it too late
                late += [due for due in waiting if due < at]
                waiting = []
        for due in before - set(waiting):
            self.handle.deleteTimer(due)
        for due in set(waiting) - before:
            self.handle.registerTimer(due)
        if waiting:
            self.open.put([(due,) for due in waiting])
        else:
            self.open.clear()
        yield _due(key[0], late)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        at = expiredTimerInfo.getExpiryTimeInMs()
        waiting = [r[0] for r in self.open.get()]
        left = [due for due in waiting if due != at]
        if left:
            self.open.put([(due,) for due in left])
        else:
            self.open.clear()
        yield _due(key[0], [at] * (len(waiting) - len(left)))

    def close(self) -> None:
        pass


def stream_timeouts(df: DataFrame, minutes: int, late: str = "1 minute") -> DataFrame:
    """key and due_ms of starts that ran out of time, from a stream of key, ts, kind (START or END); starts of a key may overlap."""
    schema = T.StructType([T.StructField("key", T.StringType()), T.StructField("due_ms", T.LongType())])
    df = df.select("key", "ts", F.unix_millis("ts").alias("ms"), (F.col("kind") == "START").alias("starts"))
    return df.withWatermark("ts", late).groupBy("key").transformWithStateInPandas(statefulProcessor=_Timeout(minutes), outputStructType=schema, outputMode="Append", timeMode="EventTime")


class _Breaker(StatefulProcessor):
    def __init__(self, rule: BreakerRule):
        self.rule = rule

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", T.StructType([T.StructField("failures", T.LongType()), T.StructField("until", T.LongType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        failures, until = self.state.get() if self.state.exists() else (0, CLOSED)
        ms, event, success = _in_order(rows, "ms", "event_id", "success")
        results = Results(self.rule, np.zeros(len(ms), np.int64), ms, success.astype(bool), failures)
        opens, ends = results.states(until)
        self.state.update((int(results.failures[-1]), int(ends[-1])))
        yield pd.DataFrame({"target": key[0], "event_id": event, "status": np.where(opens, "OPEN", "CLOSED"), "failures": results.failures})

    def close(self) -> None:
        pass


def stream_breaker(df: DataFrame, rule: BreakerRule = BreakerRule()) -> DataFrame:
    schema = T.StructType([T.StructField("target", T.StringType()), T.StructField("event_id", T.LongType()), T.StructField("status", T.StringType()), T.StructField("failures", T.LongType())])
    df = df.select("target", F.unix_millis("ts").alias("ms"), "event_id", F.coalesce("success", F.lit(False)).alias("success")).filter("ms IS NOT NULL")
    return df.groupBy("target").transformWithStateInPandas(statefulProcessor=_Breaker(rule), outputStructType=schema, outputMode="Append", timeMode="None")

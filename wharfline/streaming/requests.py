"""Request deduplication by buckets of time."""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


def bucket_of(ts: Column | str, seconds: int) -> Column:
    return F.floor(F.unix_seconds(ts) / seconds).cast("long")


def dedup_requests(df: DataFrame, keys: list[str], ts: str, tie: str, seconds: int) -> DataFrame:
    """Accepted requests: the first of a bucket whose previous bucket accepted none.

    A rejected request leaves no mark, so that in a run of buckets without a gap every other one accepts.
    Buckets of a key are few against its requests and are aggregated first.
    """
    rows = df.withColumn("bucket", bucket_of(ts, seconds))
    first = rows.groupBy(*keys, "bucket").agg(F.min(F.struct(F.col(ts).alias("_ts"), F.col(tie).alias("_tie"))).alias("_first"))
    by = Window.partitionBy(*keys).orderBy("bucket")
    runs = first.withColumn("_run", F.col("bucket") - F.row_number().over(by))
    place = F.row_number().over(Window.partitionBy(*keys, "_run").orderBy("bucket"))
    accepted = runs.withColumn("_place", place).filter("_place % 2 = 1")
    return accepted.select(*keys, "bucket", F.col("_first._ts").alias(ts), F.col("_first._tie").alias(tie))


#: Groups of keys, each with one row of state and one timer. A checkpoint holds state by groups, so that it ends with this number.
GROUPS = 512
_HELD = pa.schema([("dedup_key", pa.string()), ("last", pa.int64())])


def _first_requests(parts: Iterator[pd.DataFrame]) -> pd.DataFrame:
    """The first request of each key and bucket; of a group's requests no more than twice what is left is held."""
    held, rows, most = [], 0, 100_000
    of = lambda parts: pd.concat(parts).sort_values(["us", "request_id"]).drop_duplicates(["dedup_key", "bucket"])
    for part in parts:
        held.append(part[["dedup_key", "bucket", "us", "request_id"]])
        rows += len(part)
        if rows > most:
            held = [of(held)]
            rows = len(held[0])
            most = max(most, 2 * rows)
    return of(held)


def _accepted(first: pd.DataFrame, known: pd.DataFrame) -> tuple[pd.DataFrame, pd.DataFrame]:
    """Accepted requests of distinct keys and buckets, and the keys' last accepted buckets; ``known`` has those of before.

    A known bucket counts if a key goes on in it or in the next one; every other bucket of a run without a gap is accepted.
    """
    rows = first.assign(code=pd.factorize(first["dedup_key"], use_na_sentinel=False)[0]).sort_values(["code", "bucket"])
    starts = rows.drop_duplicates("code")[["dedup_key", "code", "bucket"]].merge(known, on="dedup_key")
    starts = starts[(starts["bucket"] - starts["last"]).isin([0, 1])]
    marks = starts[["dedup_key", "code"]].assign(bucket=starts["last"], mark=True)
    rows = pd.concat([marks, rows.assign(mark=False)]).sort_values(["code", "bucket", "mark"], ascending=[True, True, False]).drop_duplicates(["code", "bucket"])
    code, bucket = rows["code"].to_numpy(), rows["bucket"].to_numpy(np.int64)
    begins = np.ones(len(rows), bool)
    begins[1:] = (code[1:] != code[:-1]) | (bucket[1:] != bucket[:-1] + 1)
    at = np.arange(len(rows))
    taken = (at - np.maximum.accumulate(np.where(begins, at, 0))) % 2 == 0
    rows = rows[taken]
    last = rows.drop_duplicates("code", keep="last")[["dedup_key", "bucket"]].rename(columns={"bucket": "last"})
    return rows[~rows["mark"].to_numpy(bool)], pd.concat([last, known]).drop_duplicates("dedup_key")


class _Accept(StatefulProcessor):
    """Keeps the last accepted bucket of each key of a group until no request can fall into it or the next one."""

    def __init__(self, seconds: int):
        self.ms = seconds * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", T.StructType([T.StructField("keys", T.BinaryType())]))

    def _known(self) -> pd.DataFrame:
        if not self.held.exists():
            return _HELD.empty_table().to_pandas()
        return pa.ipc.open_stream(bytes(self.held.get()[0])).read_all().to_pandas()

    def _keep(self, rows: pd.DataFrame, before: pd.DataFrame, watermark: int) -> None:
        if len(before):
            self.handle.deleteTimer((int(before["last"].max()) + 2) * self.ms)
        rows = rows[(rows["last"] + 2) * self.ms > watermark]
        if not len(rows):
            self.held.clear()
            return
        out = io.BytesIO()
        with pa.ipc.new_stream(out, _HELD) as writer:
            writer.write_table(pa.Table.from_pandas(rows, _HELD, preserve_index=False))
        self.held.update((out.getvalue(),))
        self.handle.registerTimer((int(rows["last"].max()) + 2) * self.ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        known = self._known()
        out, last = _accepted(_first_requests(rows), known)
        self._keep(last, known, timerValues.getCurrentWatermarkInMs())
        yield out[["dedup_key", "bucket", "request_id"]].astype({"bucket": np.int64, "request_id": np.int64})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        known = self._known()
        self._keep(known, known, timerValues.getCurrentWatermarkInMs())
        yield pd.DataFrame({"dedup_key": np.empty(0, object), "bucket": np.empty(0, np.int64), "request_id": np.empty(0, np.int64)})

    def close(self) -> None:
        pass


def stream_requests(df: DataFrame, seconds: int, late: str = "1 minute") -> DataFrame:
    """The same over a stream of dedup_key, ts and request_id: each micro-batch in order of time.

    Keys are dealt over ``GROUPS`` groups by a hash, since a call of Python and its state cost more than a key's work. The state has a
    key and a number for each key that was accepted in the last two buckets; an event-time timer ends a group's, so its size
    follows the rate of keys and not the length of the stream. Requests later than ``late`` are dropped.
    """
    df = df.withWatermark("ts", late).select(F.pmod(F.xxhash64("dedup_key"), F.lit(GROUPS)).alias("group"), "dedup_key", "ts", bucket_of("ts", seconds).alias("bucket"), F.unix_micros("ts").alias("us"), "request_id")
    schema = T.StructType([T.StructField("dedup_key", T.StringType()), T.StructField("bucket", T.LongType()), T.StructField("request_id", T.LongType())])
    return df.groupBy("group").transformWithStateInPandas(statefulProcessor=_Accept(seconds), outputStructType=schema, outputMode="Append", timeMode="EventTime")


def dedup_stream(df: DataFrame, keys: list[str], ts: str, delay: str) -> DataFrame:
    """The cheap form: repeats of a key within the watermark's delay are dropped."""
    return df.withWatermark(ts, delay).dropDuplicatesWithinWatermark(keys)


def stream_status_counts(df: DataFrame, ts: str, window: str, late: str = "10 minutes") -> DataFrame:
    """Events by tumbling window and status."""
    rows = df.withWatermark(ts, late) if df.isStreaming else df
    return rows.groupBy(F.window(ts, window).alias("w"), "status").agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), "status", "n")


def coalesce_events(df: DataFrame, key: str, ts: str, value: str, window: str = "10 seconds", late: str = "1 minute") -> DataFrame:
    """Small tasks of one key that arrive within a window, as one row with their values."""
    rows = df.withWatermark(ts, late) if df.isStreaming else df
    return rows.groupBy(key, F.window(ts, window).alias("w")).agg(F.array_sort(F.collect_list(value)).alias("items"), F.count("*").alias("n")).select(key, F.col("w.start").alias("window_start"), "items", "n")

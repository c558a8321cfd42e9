"""Circuit breakers over a table of results: a target's chain of states as maps of chunks, composed in order.

What decides a breaker's state is sparse. Failures since the last success don't depend on the state; where they reach
the rule's number, the breaker opens whatever it was (a trip). Between trips, an open breaker is decided by the first
result at or after the end of its cooldown: a success closes it, a failure opens it anew, and so on by jumps. A chunk
without a trip is therefore a function of the end of the cooldown that it starts with.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wharfline.shared import shared_dir

#: Rows of a chunk: so many fit a task many times over.
CHUNK_BITS = 16
#: Stands for a closed breaker where the end of a cooldown is asked for.
CLOSED = -(1 << 63)


@dataclass(frozen=True)
class BreakerRule:
    window: int = 10
    rate: float = 0.5
    cooldown_ms: int = 60_000

    @property
    def most_failures(self) -> int:
        return max(1, ceil(self.rate * max(1, self.window)))


def _first_from(seg: np.ndarray, ms: np.ndarray, of: np.ndarray, bound: np.ndarray) -> np.ndarray:
    """For each (segment, time) asked for, the first row of the segment at or after it, or the segment's end."""
    is_row = np.r_[np.zeros(len(of), bool), np.ones(len(seg), bool)]
    order = np.lexsort((is_row, np.r_[bound, ms], np.r_[of, seg]))
    before = np.cumsum(is_row[order])
    found = np.empty(len(order), np.int64)
    found[order] = before
    return found[: len(of)]


class Results:
    """Results of a chunk in order: rows of equal ``seg`` are of one target; ``carry``: failures of the first one before the chunk."""

    def __init__(self, rule: BreakerRule, seg: np.ndarray, ms: np.ndarray, success: np.ndarray, carry: int = 0):
        self.rule, self.seg, self.ms, self.success = rule, seg, ms, success
        n, at = len(ms), np.arange(len(ms))
        self.start, self.stop = np.searchsorted(seg, seg, "left"), np.searchsorted(seg, seg, "right")
        last_success = np.maximum.accumulate(np.where(success, at, -1))
        known = last_success >= self.start
        self.failures = np.where(success, 0, at - np.where(known, last_success, self.start - 1) + np.where(~known & (self.start == 0), carry, 0))
        self.trips = self.failures >= rule.most_failures
        next_trip = np.r_[np.minimum.accumulate(np.where(self.trips, at, n)[::-1])[::-1][1:], n]
        cool = np.maximum(_first_from(seg, ms, seg, ms + rule.cooldown_ms), at + 1)
        jump = np.minimum(cool, next_trip)
        # where the decision after a row is: a success ends the chain, n is nowhere
        self.jump = np.r_[np.where(success, at, np.where(jump < self.stop, jump, n)), n]

    def states(self, until: int = CLOSED) -> tuple[np.ndarray, np.ndarray]:
        """(whether it is open, the end of the cooldown) after each row, if the first target starts with ``until``."""
        n, at = len(self.ms), np.arange(len(self.ms))
        decided = np.r_[self.trips, False]
        if until != CLOSED:
            entry = min(int(_first_from(self.seg, self.ms, self.seg[:1], np.array([until]))[0]), int(np.argmax(decided)) if decided.any() else n)
            if entry < self.stop[0]:
                decided[entry] = True
        jump = self.jump
        while True:  # jumps of 1, 2, 4, ...
            decided[jump[decided]] = True
            further = jump[jump]
            if (further == jump).all():
                break
            jump = further
        last = np.maximum.accumulate(np.where(decided[:n], at, -1))
        here = last >= self.start
        begins = np.where(self.start == 0, until, CLOSED)
        ends = np.where(here, np.where(self.success[last], CLOSED, self.ms[last] + self.rule.cooldown_ms), begins)
        return ends != CLOSED, ends

    def state_map(self, a: int, b: int) -> tuple[list[int], list[int]]:
        """Ends by what a trip-free segment [a, b) starts with: the end that belongs to the first bound at or after the start.

        A start is at most one cooldown after the segment's first row, since the result that it comes from is no later.
        """
        n = len(self.ms)
        most = int(_first_from(self.seg, self.ms, self.seg[a : a + 1], self.ms[a : a + 1] + self.rule.cooldown_ms)[0])
        rows = np.arange(a, min(b, most + 1))
        rows = rows[np.r_[True, self.ms[rows[1:]] != self.ms[rows[:-1]]]]
        final = np.where(self.jump == n, np.arange(n + 1), self.jump)
        while not (final[final] == final).all():
            final = final[final]
        last = final[rows]
        return self.ms[rows].tolist(), np.where(self.success[last], CLOSED, self.ms[last] + self.rule.cooldown_ms).tolist()


def _results(rule: BreakerRule, rows: pa.Table, carry: int) -> tuple[pa.Table, Results]:
    rows = rows.take(pa.array(np.argsort(rows["at"].to_numpy())))
    target = rows["target"].combine_chunks().dictionary_encode("encode").indices.to_numpy(zero_copy_only=False)
    seg = np.r_[0, np.cumsum(target[1:] != target[:-1])]
    return rows, Results(rule, seg, rows["ms"].to_numpy(), rows["success"].to_numpy(zero_copy_only=False).astype(bool), carry)


def _one(entry: pa.Table, column: str, default: int) -> int:
    value = entry[column][0].as_py() if entry.num_rows else None
    return default if value is None else value


def _failures_before(rows: DataFrame) -> DataFrame:
    """chunk, carry: failures of a chunk's first target since its last success in earlier chunks, where there are any."""
    pieces = rows.groupBy("target", "chunk").agg(F.count("*").alias("n"), F.max("at").alias("last"), F.max(F.when(F.col("success"), F.col("at"))).alias("ok"))
    pieces = pieces.withColumn("tail", F.coalesce(F.col("last") - F.col("ok"), "n"))
    earlier = Window.partitionBy("target").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.withColumn("before", F.coalesce(F.sum("tail").over(earlier), F.lit(0)))
    since = F.last(F.when(F.col("ok").isNotNull(), F.col("before")), ignorenulls=True).over(earlier)
    return pieces.select("chunk", (F.col("before") - F.coalesce(since, F.lit(0))).alias("carry")).filter("carry > 0")


def _maps(rule: BreakerRule, rows: DataFrame, carry: DataFrame) -> DataFrame:
    """For the first and the last target of each chunk: where the breaker ends, for whatever it starts with."""
    schema = pa.schema([("target", pa.string()), ("chunk", pa.int64()), ("tripped", pa.bool_()), ("until", pa.int64()), ("bounds", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64()))])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        left, results = _results(rule, left, _one(right, "carry", 0))
        _, ends = results.states()
        out = []
        for a in sorted({0, int(results.start[-1])}):
            b = int(results.stop[a])
            tripped = bool(results.trips[a:b].any())
            bounds, then = ([], []) if tripped else results.state_map(a, b)
            out.append({"target": left["target"][a].as_py(), "chunk": left["chunk"][a].as_py(), "tripped": tripped, "until": int(ends[b - 1]), "bounds": bounds, "ends": then})
        return pa.Table.from_pylist(out, schema)

    return rows.groupBy("chunk").cogroup(carry.groupBy("chunk")).applyInArrow(run, "target string, chunk bigint, tripped boolean, until bigint, bounds array<bigint>, ends array<bigint>")


def _starts(maps: DataFrame) -> DataFrame:
    """chunk, until: chunks whose first target is open when they begin. One step a chunk, targets side by side."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        target, until = object(), CLOSED
        for batch in batches:
            chunks, untils = [], []
            for r in batch.itertuples(index=False):
                if r.target != target:
                    target, until = r.target, CLOSED
                if until != CLOSED:
                    chunks.append(r.chunk)
                    untils.append(until)
                if r.tripped:
                    until = r.until
                elif until != CLOSED:
                    k = int(np.searchsorted(r.bounds, until))
                    until = int(r.ends[k]) if k < len(r.bounds) else until
            yield pd.DataFrame({"chunk": np.array(chunks, np.int64), "until": np.array(untils, np.int64)})

    return maps.repartition("target").sortWithinPartitions("target", "chunk").mapInPandas(run, "chunk bigint, until bigint")


def breaker_states(df: DataFrame, rule: BreakerRule = BreakerRule(), chunk_bits: int = CHUNK_BITS) -> DataFrame:
    """target, event_id, status and failures after each result, in order of time and event_id (target, ts, event_id, success).

    Rows are range-sorted once and cut into chunks of 2^chunk_bits; a target's chunks are worked on side by side, whatever its
    share of the rows. What goes through one task is a row for each chunk of a target, with a map of at most one entry for
    each millisecond of the cooldown. Results without a time take no part; a missing success is a failure; a missing
    target is a target; rows that are repeated count again.
    """
    spark = df.sparkSession
    rows = df.select("target", F.unix_millis("ts").alias("ms"), "event_id", F.coalesce("success", F.lit(False)).alias("success")).filter("ms IS NOT NULL")
    order = ["target", "ms", "event_id", "success"]
    path = shared_dir(spark, "breakers")
    rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()).write.parquet(path)
    rows = spark.read.parquet(path).withColumn("chunk", F.shiftright("at", chunk_bits))
    carry = _failures_before(rows)
    starts = _starts(_maps(rule, rows, carry))
    entry = carry.join(starts, "chunk", "full_outer")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        left, results = _results(rule, left, _one(right, "carry", 0))
        opens, _ = results.states(_one(right, "until", CLOSED))
        return pa.table({"target": left["target"], "event_id": left["event_id"], "status": pa.array(np.where(opens, "OPEN", "CLOSED").tolist(), pa.string()), "failures": pa.array(results.failures, pa.int64())})

    return rows.groupBy("chunk").cogroup(entry.groupBy("chunk")).applyInArrow(run, "target string, event_id bigint, status string, failures bigint")

"""Replays: days, dead letters, dispatches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wharfline.functions.text import business_key, has_text, parse_params
from wharfline.operators.keyed import insert_where_absent

MOST_REPLAYS, REPLAY_DELAY_MS = 5, 60_000


def replay_entries(entries: DataFrame, states: DataFrame) -> DataFrame:
    """Entries with the status of their task, day and rerun; without one they stay as they are."""
    s = states.select("task_id", "batch_date", "rerun_id", F.col("status").alias("_state"))
    status = F.when(F.col("_state") == "SUCCESS", "SUCCEEDED").when(F.col("_state") == "SKIPPED", "SKIPPED").when(F.col("_state").isin("FAILED", "PARTIAL"), "FAILED").otherwise(F.col("status"))
    return entries.join(s, ["task_id", "batch_date", "rerun_id"], "left").withColumn("status", status).drop("_state")


def reconcile_replay(entries: DataFrame, states: DataFrame) -> DataFrame:
    """One row for each session: counts, its status, and the state of its day."""
    rows = replay_entries(entries, states)
    out = rows.groupBy("session_id").agg(
        F.count_if(F.col("status").isin("SUCCEEDED", "SKIPPED")).alias("succeeded"), F.count_if(F.col("status") == "FAILED").alias("failed"), F.count_if(~F.col("status").isin("SUCCEEDED", "SKIPPED", "FAILED")).alias("in_flight")
    )
    status = F.when(F.col("in_flight") > 0, "RUNNING").when(F.col("failed") > 0, "PARTIAL_FAILED").otherwise("SUCCEEDED")
    return out.withColumns({"status": status, "day_status": F.when(status == "SUCCEEDED", "SETTLED").otherwise("SETTLING")})


def replay_dlq(dlq: DataFrame, target: DataFrame, as_of: Column) -> tuple[DataFrame, DataFrame]:
    """(inserts, dlq): candidates parsed to records and their state after the attempt.

    A record that lacks its key or name fails its attempt alone; after five attempts a person must look. A
    record whose key the target has is handled too, since importing is idempotent.
    """
    p = parse_params("params")
    rows = dlq.withColumns({"_p": p, "business_key": p["businessKey"], "name": p["name"], "description": p["description"], "batch_date": p["batchDate"]})
    due = ~F.col("handled") & F.col("retryable") & ~F.col("manual_required") & (F.col("next_retry_at") < as_of)
    fine = has_text("name") & has_text("batch_date")
    key = F.coalesce(F.when(has_text("business_key"), F.col("business_key")), business_key("batch_date", F.col("name")))
    rows = rows.withColumns({"_due": due, "_fine": due & fine, "business_key": key})
    new = rows.filter("_fine").groupBy("business_key", "batch_date").agg(F.min_by(F.struct("name", "description"), "id").alias("r")).select("business_key", "batch_date", "r.*")
    inserts = new.join(target.select("business_key", "batch_date"), ["business_key", "batch_date"], "left_anti")
    count = F.col("replay_count") + F.col("_due").cast("int")
    later = F.timestamp_millis(F.unix_millis(as_of) + REPLAY_DELAY_MS)
    failed = F.col("_due") & ~F.col("_fine")
    after = rows.select(
        "id", "params", F.when(F.col("_fine"), True).otherwise(F.col("handled")).alias("handled"), count.alias("replay_count"),
        F.when(failed & (count >= MOST_REPLAYS), True).otherwise(F.col("manual_required")).alias("manual_required"),
        F.when(failed, later).otherwise(F.col("next_retry_at")).alias("next_retry_at"),
        F.when(F.col("_fine"), "SUCCESS").when(failed & (count >= MOST_REPLAYS), "MANUAL_REQUIRED").when(failed, "FAILED").otherwise(F.col("compensation_status")).alias("compensation_status"),
    )
    return inserts, after


def advance_dispatch(df: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Dispatches after their outcomes (id, outcome): SENT, SEND_FAILED, ACK_OK, ACK_REFUSED, ACK_TIMEOUT."""
    rows = df.join(outcomes, "id", "left")
    o = F.col("outcome")
    bad = o.isin("SEND_FAILED", "ACK_REFUSED", "ACK_TIMEOUT")
    count = F.col("attempt_count") + F.coalesce(bad, F.lit(False)).cast("int")
    again = F.when(count < F.col("max_attempts"), "RETRY").otherwise("FAILED")
    return rows.withColumns({
        "attempt_count": count,
        "dispatch_status": F.when(bad, again).when(o == "SENT", "DISPATCHED").when(o == "ACK_OK", "COMPLETED").otherwise(F.col("dispatch_status")),
        "ack_status": F.when(o == "ACK_OK", "ACKED").when(o == "ACK_REFUSED", "REJECTED").when(o == "ACK_TIMEOUT", "TIMEOUT").otherwise(F.col("ack_status")),
    }).drop("outcome")


DAY_KEYS = ["tenant", "calendar", "batch_date"]


def ensure_days(days: DataFrame, asked: DataFrame) -> DataFrame:
    """Days with an OPEN row for each asked key that has none; blank tenants and calendars are ``default``."""
    named = lambda c: F.when(has_text(c), F.trim(c)).otherwise("default").alias(c)
    new = asked.select(named("tenant"), named("calendar"), "batch_date").distinct().withColumn("status", F.lit("OPEN"))
    return insert_where_absent(days, new, DAY_KEYS)


def advance_days(days: DataFrame, changes: DataFrame) -> DataFrame:
    """Days after their changes (keys, status, at, session_id): the last change counts, frozen and settled times
    are set once, and a change by a replay counts for the day's own session only."""
    by = changes.join(days.select(*DAY_KEYS, F.col("session_id").alias("_own")), DAY_KEYS).filter(F.col("session_id").isNull() | F.col("session_id").eqNullSafe(F.col("_own")))
    last = by.groupBy(*DAY_KEYS).agg(F.max_by("status", "at").alias("_status"), F.min(F.when(F.col("status") == "FROZEN", F.col("at"))).alias("_frozen"), F.min(F.when(F.col("status") == "SETTLED", F.col("at"))).alias("_settled"))
    rows = days.join(last, DAY_KEYS, "left")
    return rows.withColumns({"status": F.coalesce("_status", "status"), "frozen_at": F.coalesce("frozen_at", "_frozen"), "settled_at": F.coalesce("settled_at", "_settled")}).drop("_status", "_frozen", "_settled")

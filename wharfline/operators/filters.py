"""Selections over operational tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wharfline.functions.text import has_text


def before(as_of: Column, minutes: float) -> Column:
    """So many minutes before a time."""
    return F.timestamp_millis(F.unix_millis(as_of) - F.lit(int(minutes * 60_000)))


def _oldest(df: DataFrame, ts: str, tie: str, n: int) -> DataFrame:
    return df.orderBy(F.asc(ts), F.asc(tie)).limit(n)


def export_filter(df: DataFrame) -> DataFrame:
    return df.filter(has_text("business_key") & ~F.col("business_key").startswith("TEST_"))


def validate_export(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good, bad): an export row needs a positive id, a batch date and a name."""
    error = F.when(~F.coalesce(F.col("id") > 0, F.lit(False)), "id").when(~has_text("batch_date"), "batch_date").when(~has_text("name"), "name")
    rows = df.withColumn("error", error)
    return rows.filter("error IS NULL").drop("error"), rows.filter("error IS NOT NULL")


def overdue_files(df: DataFrame, minutes: float, as_of: Column) -> DataFrame:
    return df.filter((F.col("expected_process_time") < before(as_of, minutes)) & F.col("status").isin("RECEIVED", "WAITING"))


def retriable_files(df: DataFrame, cutoff: Column, most: int = 3) -> DataFrame:
    return df.filter((F.col("status") == "FAILED") & (F.col("retry_count") < most) & (F.col("updated_at") < cutoff))


def timed_out_files(df: DataFrame, minutes: float, n: int, as_of: Column) -> DataFrame:
    return _oldest(df.filter((F.col("status") == "ARRIVED") & (F.col("arrived_at") < before(as_of, minutes))), "arrived_at", "id", n)


def retriable_dispatches(df: DataFrame, cutoff: Column) -> DataFrame:
    return df.filter((F.col("status") == "RETRY") & (F.col("retry_count") < F.col("max_retry")) & (F.col("updated_at") < cutoff))


def timed_out_dispatches(df: DataFrame, cutoff: Column) -> DataFrame:
    return df.filter(F.col("status").isin("PENDING", "IN_PROGRESS") & (F.col("created_at") < cutoff))


def completed_between(df: DataFrame, start: Column, end: Column) -> DataFrame:
    return df.filter((F.col("status") == "COMPLETED") & F.col("completed_at").between(start, end))


def ack_timeouts(df: DataFrame, fallback: int, as_of: Column) -> DataFrame:
    """Dispatches whose acknowledgement is due: by their deadline, else by minutes since the last dispatch."""
    own = F.coalesce("ack_timeout_minutes", F.lit(fallback))
    minutes = F.when(own < 1, 120).otherwise(own)
    due = F.coalesce(F.col("ack_deadline_at"), F.timestamp_millis(F.unix_millis("last_dispatch_time") + minutes.cast("long") * 60_000))
    return df.filter(F.col("ack_required") & (F.col("ack_status") == "PENDING") & (due <= as_of))


def stuck_dispatches(df: DataFrame, minutes: float, n: int, as_of: Column) -> DataFrame:
    waits = (F.col("dispatch_status") == "DISPATCHING") & (F.col("ack_status") == "PENDING") & (F.col("last_dispatch_time") < before(as_of, minutes))
    return _oldest(df.filter(waits), "last_dispatch_time", "id", n)


def dlq_candidates(df: DataFrame, as_of: Column, n: int = 100) -> DataFrame:
    ready = ~F.col("handled") & F.col("retryable") & ~F.col("manual_required") & (F.col("next_retry_at") < as_of)
    return _oldest(df.filter(ready), "created_at", "id", n)


def stale_states(df: DataFrame, ms: int, as_of: Column) -> tuple[DataFrame, DataFrame]:
    """(updates, dlq): states that run or are blocked for too long fail, but those inside their window."""
    old = F.col("status").isin("RUNNING", "BLOCKED") & (F.col("updated_at") < before(as_of, ms / 60_000))
    spared = (F.col("status") == "RUNNING") & F.coalesce(F.col("window_end") > as_of, F.lit(False))
    rows = df.filter(old & ~spared)
    updates = rows.select("task_id", "batch_date", "rerun_id", F.lit("FAILED").alias("status"), F.concat(F.lit("stale "), F.col("status")).alias("last_error"))
    dlq = rows.select(F.col("task_id").alias("job_name"), F.concat(F.lit("batchDate="), F.col("batch_date"), F.lit("&rerunId="), F.coalesce("rerun_id", F.lit(""))).alias("params"), F.lit("STALE_STATE").alias("error_code"), F.lit(True).alias("retryable"))
    return updates, dlq


def misfires(df: DataFrame, threshold: Column, n: int = 100) -> DataFrame:
    return _oldest(df.filter((F.col("status") == "READY") & (F.col("next_retry_at") < threshold)), "next_retry_at", "task_id", n)


def contains_text(df: DataFrame, column: str, text: str) -> DataFrame:
    return df.filter(F.col(column).contains(text))


def search_files(df: DataFrame, file_no: str | None = None, status: str | None = None, source: str | None = None, date: str | None = None) -> DataFrame:
    """By the first criterion given, in this order; a source goes with a date."""
    if file_no:
        return df.filter(F.col("file_no") == file_no)
    if status:
        return df.filter(F.col("status") == status)
    if source:
        rows = df.filter(F.col("source_system") == source)
        return rows.filter(F.col("batch_date") == date) if date else rows
    return df.filter(F.col("batch_date") == date) if date else df


def executions(df: DataFrame, day: Column | None = None, start: Column | None = None, end: Column | None = None, tasks: list[str] | None = None, statuses: list[str] | None = None, trigger: str | None = None) -> DataFrame:
    if day is not None:
        df = df.filter(F.to_date("start_time") == day)
    if start is not None:
        df = df.filter(F.col("start_time").between(start, end))
    for column, values in (("task_id", tasks), ("status", statuses), ("trigger_type", [trigger] if trigger else None)):
        if values:
            df = df.filter(F.col(column).isin(*values))
    return df


def audit(df: DataFrame, task: str | None = None, status: str | None = None, start: Column | None = None, end: Column | None = None) -> DataFrame:
    for column, value in (("task_id", task), ("status", status)):
        if value:
            df = df.filter(F.col(column) == value)
    return df.filter(F.col("created_at").between(start, end)) if start is not None else df


def where_eq(df: DataFrame, **values) -> DataFrame:
    for column, value in values.items():
        df = df.filter(F.col(column).eqNullSafe(F.lit(value)))
    return df


def assert_max_rows(df: DataFrame, n: int) -> DataFrame:
    """``df``, unless it has more than ``n`` rows; reads no more than one row beyond."""
    if df.limit(n + 1).count() > n:
        raise ValueError(f"more than {n} rows")
    return df


def enforce_skip_limit(bad: DataFrame, n: int = 100) -> None:
    assert_max_rows(bad, n)


def fill_dlq_defaults(df: DataFrame) -> DataFrame:
    """Open rows get the defaults of the columns that came later."""
    value = lambda c, d: F.when(F.coalesce("handled", F.lit(False)), F.col(c)).otherwise(F.coalesce(c, F.lit(d))).alias(c)
    defaults = {"compensation_status": "OPEN", "replay_count": 0, "retryable": True, "manual_required": False}
    return df.select(*(value(c, defaults[c]) if c in defaults else F.col(c) for c in df.columns))


def retention(df: DataFrame, ts: str, days: int, as_of: Column, condition: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(kept, deleted): rows older than ``days`` (one at least) go if the condition holds."""
    old = F.col(ts) < before(as_of, max(1, days) * 1440)
    gone = F.coalesce(old & (F.lit(True) if condition is None else condition), F.lit(False))
    return df.filter(~gone), df.filter(gone)

"""Classes of failures, run states, delays. The clock is always an argument."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from wharfline.functions.text import col, has_text, jtrim

#: Substrings of failure texts, in the order in which they are tried (fixed values).
SKIPPABLE = ("already exists", "duplicate", "idempotent")
RETRYABLE = ("timeout", "connection", "temporar", "deadlock", "lock", "unavailable", "reset")
#: Classes of SQL states (fixed values).
SQLSTATE = {"08": "RETRYABLE", "40": "RETRYABLE", "57": "RETRYABLE", "53": "RETRYABLE", "23": "SKIPPABLE", "22": "FATAL", "42": "FATAL"}
#: Codes of exception classes, first match counts (fixed values).
ERROR_CODES = (("RecordValidationException", "VALIDATION_FAILED"), ("TransientImportException", "DB_ERROR"), ("DataAccessException", "DB_ERROR"), ("SocketTimeoutException", "NETWORK_ERROR"), ("IOException", "IO_ERROR"))
LONGEST_BACKOFF_MS = 30 * 60_000


def _any(c: Column, words: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | c.contains(w)
    return out


def classify_failure(c: Column | str) -> Column:
    low = F.lower(col(c))
    return F.when(~has_text(c), "FATAL").when(_any(low, SKIPPABLE), "SKIPPABLE").when(_any(low, RETRYABLE), "RETRYABLE").otherwise("FATAL")


def classify_sqlstate(c: Column | str) -> Column:
    """Null for states of no known class."""
    out = F.lit(None).cast("string")
    head = F.substring(col(c), 1, 2)
    for state, kind in SQLSTATE.items():
        out = F.when(head == state, kind).otherwise(out)
    return out


def error_code(c: Column | str) -> Column:
    """The code of an exception's class name (its last part)."""
    name, out = F.substring_index(col(c), ".", -1), F.lit("INTERNAL_ERROR")
    for kind, code in reversed(ERROR_CODES):
        out = F.when(name == kind, code).otherwise(out)
    return out


def backoff_ms(base_ms: Column | str, attempt: Column | str) -> Column:
    base = F.greatest(F.lit(1000), col(base_ms)).cast("long")
    n = F.greatest(F.lit(0), F.least(col(attempt), F.lit(16))).cast("int")
    return F.least(F.lit(LONGEST_BACKOFF_MS).cast("long"), base * F.pow(F.lit(2.0), n).cast("long"))


def next_retry_at(ts: Column | str, base_ms: Column | str, attempt: Column | str, jitter: float = 0.0) -> Column:
    ms = backoff_ms(base_ms, attempt)
    if jitter:
        ms = F.greatest(F.lit(0).cast("long"), (ms * (1 + jitter * (2 * F.rand() - 1))).cast("long"))
    return F.timestamp_millis(F.unix_millis(col(ts)) + ms)


def normalize_status(c: Column | str) -> Column:
    return F.when(has_text(c), F.upper(jtrim(c))).otherwise("READY")


def derive_run_status(status: Column | str, skips: Column | str) -> Column:
    s = col(status)
    return (
        F.when(s.isNull() | s.isin("FAILED", "ABANDONED"), "FAILED")
        .when(s == "STOPPED", "CANCELLED")
        .when(s.isin("STARTED", "STARTING", "STOPPING"), "RUNNING")
        .when(F.coalesce(col(skips), F.lit(0)) > 0, "PARTIAL_SUCCESS")
        .otherwise("COMPLETED")
    )


def misfire_action(late_ms, attempts, window_ms: int, most: int) -> Column:
    late = col(late_ms)
    return F.when((col(attempts) >= most) | (late >= window_ms), "ABANDON").when(late < window_ms // 2, "RESCHEDULE").otherwise("RETRY_LATER")


def misfire_delay(late_ms, attempts, window_ms: int, delay_ms: int, most: int) -> Column:
    late = col(late_ms)
    return F.when((col(attempts) >= most) | (late >= window_ms) | (late < window_ms // 4), 0).when(late < window_ms // 2, delay_ms).otherwise(2 * delay_ms).cast("long")


def paced_next_run(base_at, base_delay_ms, streak, last_at, now: Column, multiplier: float = 2.0, most_ms: int = 600_000, least_ms: int = 1000, most_a_minute: int = 0) -> Column:
    """When a task of fixed delay runs next: not before its time, its backoff after failures, or its pace."""
    delay = F.greatest(F.lit(1000), F.coalesce(col(base_delay_ms), F.lit(1000))).cast("long")
    slow = F.least(F.lit(most_ms).cast("long"), (delay * F.pow(F.lit(multiplier), col(streak))).cast("long"))
    delay = F.when(col(streak) > 0, slow).otherwise(delay)
    if most_a_minute > 0:
        least_ms = max(least_ms, max(1000, 60_000 // most_a_minute))
    later = lambda ts, ms: F.timestamp_millis(F.unix_millis(ts) + ms)
    return F.greatest(F.coalesce(col(base_at), later(now, delay)), later(now, delay), later(col(last_at), F.lit(least_ms)))


def shard_total(explicit, parallel, dynamic_max, backlog, default_max: int = 4) -> Column:
    most = F.when(col(dynamic_max).isNull(), default_max).otherwise(F.greatest(F.lit(1), col(dynamic_max)))
    load = F.greatest(F.lit(1).cast("long"), F.floor(col(backlog) / 20).cast("long") + 1)
    return F.when(col(explicit) > 0, col(explicit)).when(~col(parallel) | (most <= 1), 1).otherwise(F.least(most.cast("long"), load)).cast("long")


def duration_ms(start, end, as_of: Column) -> Column:
    ms = F.unix_millis(F.coalesce(col(end), as_of)) - F.unix_millis(col(start))
    return F.greatest(F.lit(0).cast("long"), ms)


PRIORITY = {"CRITICAL": 20, "HIGH": 10, "NORMAL": 5, "LOW": 1}
SEVERITY = {"INFO": 0, "WARNING": 1, "ERROR": 2, "CRITICAL": 3}


def rank_of(c: Column | str, ranks: dict[str, int], default: int) -> Column:
    out = F.lit(default)
    for name, n in ranks.items():
        out = F.when(F.upper(col(c)) == name, n).otherwise(out)
    return out

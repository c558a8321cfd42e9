"""Alerts from measures, and their upsert."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wharfline.functions.status import SEVERITY, rank_of
from wharfline.operators.filters import before, stuck_dispatches, timed_out_files
from wharfline.operators.measures import mean_throughput, pending_count, share

ALERT = ("alert_code", "severity", "value")


def severity_rank(c: Column | str) -> Column:
    return rank_of(c, SEVERITY, 0)


def severity_of(rank: Column) -> Column:
    out = F.lit("INFO")
    for name, n in SEVERITY.items():
        out = F.when(rank == n, name).otherwise(out)
    return out


def evaluate_batch_alerts(runs: DataFrame, dlq: DataFrame, as_of: Column, minutes: float = 15, failure_rate: float = 0.2, backlog: int = 100, manual: int = 20, throughput: float = 5.0) -> DataFrame:
    """The alerts that the last minutes raise."""
    within = F.col("created_at").between(before(as_of, minutes), as_of)
    a = runs.agg(F.count_if(within & (F.col("status") == "FAILED")).alias("failed"), F.count_if(within).alias("runs"))
    b = dlq.agg(F.count_if(~F.col("handled")).alias("backlog"), F.count_if(~F.col("handled") & F.col("manual_required")).alias("manual"))
    row = a.crossJoin(F.broadcast(b)).crossJoin(F.broadcast(mean_throughput(runs))).withColumn("rate", share(F.col("failed"), F.col("runs")))
    made = lambda cond, code, severity, value: F.when(cond, F.struct(F.lit(code).alias("alert_code"), F.lit(severity).alias("severity"), value.cast("double").alias("value")))
    alerts = F.array_compact(F.array(
        made((F.col("runs") > 0) & (F.col("rate") >= failure_rate), "BATCH_FAILURE_RATE", "CRITICAL", F.col("rate")),
        made(F.col("backlog") >= backlog, "DLQ_BACKLOG", "WARNING", F.col("backlog")),
        made(F.col("manual") >= manual, "DLQ_MANUAL", "CRITICAL", F.col("manual")),
        made((F.col("mean_throughput") > 0) & (F.col("mean_throughput") < throughput), "LOW_THROUGHPUT", "WARNING", F.col("mean_throughput")),
    ))
    return row.select(F.inline(alerts))


def evaluate_file_alerts(files: DataFrame, dispatches: DataFrame, as_of: Column, arrived_minutes: float = 120, pending: int = 100, ack_minutes: float = 60, n: int = 100) -> DataFrame:
    """alert_code, severity, file_record_id, target_system."""
    none = F.lit(None).cast("string")
    late = timed_out_files(files, arrived_minutes, n, as_of).select(F.lit("FILE_ARRIVED_TIMEOUT").alias("alert_code"), F.lit("WARNING").alias("severity"), F.col("id").alias("file_record_id"), none.alias("target_system"))
    many = pending_count(files, 24, as_of).filter(F.col("pending") >= pending).select(F.lit("FILE_BACKLOG").alias("alert_code"), F.lit("CRITICAL").alias("severity"), F.lit(None).cast("bigint").alias("file_record_id"), none.alias("target_system"))
    ack = stuck_dispatches(dispatches, ack_minutes, n, as_of).select(F.lit("ACK_TIMEOUT").alias("alert_code"), F.lit("ERROR").alias("severity"), "file_record_id", "target_system")
    return late.unionByName(many).unionByName(ack)


def upsert_alerts(open_alerts: DataFrame, new: DataFrame) -> DataFrame:
    """Open alerts with those raised again: one of each code, file and target, whose severity only rises."""
    keys = ["alert_code", "file_record_id", "target_system"]
    rows = open_alerts.select(*keys, severity_rank("severity").alias("rank"), F.lit(0).alias("fresh")).unionByName(new.select(*keys, severity_rank("severity").alias("rank"), F.lit(1).alias("fresh")))
    return rows.groupBy(*keys).agg(severity_of(F.max("rank")).alias("severity"), (F.min("fresh") == 1).alias("created"), F.sum("fresh").alias("raised"))


def alerts_at_least(df: DataFrame, floor: str) -> DataFrame:
    return df.filter(severity_rank("severity") >= SEVERITY[floor])


def queue_breaches(df: DataFrame, as_of: Column, wait_ms: int) -> DataFrame:
    """Queued tasks over their delay limit or over the longest wait."""
    waited = F.unix_millis(as_of) - F.unix_millis("enqueued_at")
    over = F.coalesce((F.col("queue_sla_ms") > 0) & (waited > F.col("queue_sla_ms")), F.lit(False))
    return df.withColumns({"waited_ms": waited, "sla_breached": over, "timed_out": waited > wait_ms}).filter("sla_breached OR timed_out")


def sustained(df: DataFrame, condition: Column, minutes: int, ts: str = "ts", key: str | None = None) -> DataFrame:
    """Samples at which the condition has held for all samples of the last minutes, which reach back far enough."""
    span, by = minutes * 60, [key] if key else []
    rows = df.withColumn("_s", F.unix_seconds(ts)).withColumn("_ok", condition)
    # slices as long as the span: what a sample looks back at lies in its own slice and the one before
    own = F.floor(F.col("_s") / span)
    spread = rows.withColumn("_slice", F.explode(F.array(own, own + 1)))
    within = Window.partitionBy(*by, "_slice").orderBy("_s").rangeBetween(-span, 0)
    held = spread.withColumn("_all", F.bool_and("_ok").over(within)).filter(F.col("_all") & (F.col("_slice") == own))
    first = rows.groupBy(*(F.col(k).alias("_key") for k in by)).agg(F.min("_s").alias("_first"))
    held = held.join(first, F.col(key).eqNullSafe(F.col("_key"))) if key else held.crossJoin(F.broadcast(first))  # one row
    return held.filter(F.col("_s") - F.col("_first") >= span).select(*df.columns)

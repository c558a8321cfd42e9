"""Counts, rates and rollups. One pass for each table; single rows are joined at the end."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wharfline.functions.text import has_text
from wharfline.operators.filters import before
from wharfline.operators.keyed import top_n


def share(part: Column, whole: Column) -> Column:
    """0 where the whole is 0."""
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def _one_row(*frames: DataFrame) -> DataFrame:
    """Frames of one row each side by side."""
    return reduce(lambda a, b: a.crossJoin(F.broadcast(b)), frames)


def count_by(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias("n"))


def missing_count(df: DataFrame, column: str) -> DataFrame:
    return df.agg(F.count_if(~has_text(column)).alias("missing"))


def duplicate_groups(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.count_if(F.col("n") > 1).alias("duplicate_groups"))


def score_runs(df: DataFrame) -> DataFrame:
    """Row-count reconciliation, throughput and the status that follows."""
    passed = (F.col("read_count") == F.col("write_count") + F.col("skip_count") + F.col("filter_count")) & (F.col("parse_error_count") == 0)
    return df.withColumns({
        "quality_passed": passed,
        "throughput_rps": F.col("write_count") * 1000.0 / F.greatest(F.lit(1).cast("long"), F.col("duration_ms")),
        "final_status": F.when((F.col("status") == "COMPLETED") & ~passed, "PARTIAL").otherwise(F.col("status")),
    })


def mean_throughput(runs: DataFrame, n: int = 200) -> DataFrame:
    return top_n(runs, [F.desc("created_at"), F.desc("job_execution_id")], n).agg(F.coalesce(F.avg(F.coalesce("throughput_rps", F.lit(0.0))), F.lit(0.0)).alias("mean_throughput"))


def _run_counts(runs: DataFrame, start: Column, as_of: Column) -> DataFrame:
    within = F.col("created_at").between(start, as_of)
    count = lambda s: F.count_if(within & (F.col("status") == s))
    return runs.agg(count("FAILED").alias("failed"), count("COMPLETED").alias("completed"), count("PARTIAL").alias("partial"))


def dashboard(runs: DataFrame, dlq: DataFrame, states: DataFrame, as_of: Column, hours: float = 24) -> DataFrame:
    """Runs of the window, failure rate, backlog, task states, mean throughput of the newest runs."""
    counts = _run_counts(runs, before(as_of, hours * 60), as_of)
    backlog = dlq.agg(F.count_if(~F.col("handled")).alias("dlq_backlog"))
    tasks = states.agg(*(F.count_if(F.col("status") == s).alias(s.lower()) for s in ("BLOCKED", "RUNNING", "READY")))
    rows = _one_row(counts, backlog, tasks, mean_throughput(runs))
    return rows.withColumn("failure_rate", share(F.col("failed"), F.col("failed") + F.col("completed") + F.col("partial")))


def batch_metrics(runs: DataFrame, dlq: DataFrame, states: DataFrame, tasks: DataFrame, as_of: Column, minutes: float = 15) -> DataFrame:
    """The gauges of the last minutes."""
    counts = _run_counts(runs, before(as_of, minutes), as_of).drop("partial")
    open_ = ~F.col("handled")
    queue = dlq.agg(F.count_if(open_).alias("dlq"), F.count_if(open_ & F.col("manual_required")).alias("dlq_manual"), F.count_if(open_ & F.col("retryable") & F.col("next_retry_at").isNotNull()).alias("retry_pending"))
    blocked = states.agg(F.count_if(F.col("status") == "BLOCKED").alias("blocked"))
    breaches = sla_breaches(runs, tasks).agg(F.count("*").alias("sla_breaches"))
    return _one_row(counts, queue, blocked, mean_throughput(runs), breaches)


def sla_breaches(runs: DataFrame, tasks: DataFrame, n: int = 200) -> DataFrame:
    """Of the newest runs those that took longer than the shortest limit of their job."""
    limits = tasks.filter("sla_ms > 0").groupBy("job_name").agg(F.min("sla_ms").alias("sla_ms"))
    return top_n(runs, [F.desc("created_at"), F.desc("job_execution_id")], n).join(limits, "job_name").filter("duration_ms > sla_ms")


def file_metrics(files: DataFrame, dispatches: DataFrame, dlq: DataFrame, as_of: Column, hours: int = 24) -> DataFrame:
    inbound = F.col("file_direction") == "INBOUND"
    count = lambda *s: F.count_if(inbound & F.col("status").isin(*s))
    a = files.agg(
        F.count_if(inbound).alias("received"), count("PROCESSED", "DISPATCHED", "ARCHIVED").alias("processed"), count("FAILED").alias("failed"), count("PROCESSING").alias("processing"),
        F.count_if(inbound & F.col("status").isin("ARRIVED", "READY") & (F.col("arrived_at") < before(as_of, hours * 60))).alias("pending_old"), F.count_if("archived").alias("archived"),
    )
    b = dispatches.agg(F.count("*").alias("dispatch_total"), *(F.count_if(F.col("dispatch_status") == s).alias(f"dispatch_{s.lower()}") for s in ("DISPATCHED", "FAILED", "DISPATCHING")), F.count_if(F.col("ack_status") == "TIMEOUT").alias("ack_timeout"))
    return _one_row(a, b, dlq.agg(F.count_if(~F.col("handled")).alias("dlq_open")))


def status_counts(df: DataFrame, statuses: list[str], column: str = "status") -> DataFrame:
    """One row: the total and the rows of each status."""
    return df.agg(F.count("*").alias("total"), *(F.count_if(F.col(column) == s).alias(s.lower()) for s in statuses))


def task_stats(audit: DataFrame, task: str, hours: float, as_of: Column) -> DataFrame:
    rows = audit.filter((F.col("task_id") == task) & (F.col("created_at") >= before(as_of, hours * 60)))
    out = rows.agg(F.count_if(F.col("status") == "SUCCESS").alias("success"), F.count_if(F.col("status") == "FAILED").alias("failed"), F.count("*").alias("total"))
    return out.withColumn("rate", F.when(F.col("total") == 0, "N/A").otherwise(F.format_string("%.2f%%", F.try_divide(F.col("success") * 100.0, F.col("total")))))


def execution_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("task_id").agg(F.count("*").alias("total"), F.count_if(F.col("status") == "SUCCESS").alias("success"), F.count_if(F.col("status") == "FAILED").alias("failed"))


STEP_COUNTS = ("read_count", "write_count", "skip_count", "filter_count", "rollback_count", "commit_count")


def rollup_steps(steps: DataFrame) -> DataFrame:
    return steps.groupBy("job_execution_id").agg(*(F.sum(c).alias(c) for c in STEP_COUNTS if c in steps.columns))


def rollup_shards(df: DataFrame, key: str = "run_key") -> DataFrame:
    """All shards fine: SUCCESS; some: PARTIAL; none: FAILED."""
    fine = F.count_if(F.col("status") == "SUCCESS")
    return df.groupBy(key).agg(F.when(fine == F.count("*"), "SUCCESS").when(fine > 0, "PARTIAL").otherwise("FAILED").alias("status"))


def rollup_dag(df: DataFrame, key: str = "run_key") -> DataFrame:
    """Any FAILED: FAILED; any PARTIAL or SKIPPED: PARTIAL; else SUCCESS."""
    some = lambda *s: F.count_if(F.col("status").isin(*s)) > 0
    return df.groupBy(key).agg(F.when(some("FAILED"), "FAILED").when(some("PARTIAL", "SKIPPED"), "PARTIAL").otherwise("SUCCESS").alias("status"))


def coverage(queue: DataFrame, column: str = "file_record_id") -> DataFrame:
    out = queue.agg(F.count("*").alias("total"), F.count(column).alias("linked"))
    return out.withColumn("coverage", F.when(F.col("total") == 0, 100.0).otherwise(F.try_divide(F.col("linked") * 100.0, F.col("total")))).withColumn("ready", F.col("linked") == F.col("total"))


def export_stats(df: DataFrame, errors: int = 0) -> DataFrame:
    """Of rows with the flags ``filtered`` and ``valid``: processed, filtered, errors, transformed, success rate."""
    out = df.agg(F.count("*").alias("processed"), F.count_if("filtered").alias("filtered"), F.count_if(~F.col("filtered") & ~F.col("valid")).alias("errors"), F.count_if(~F.col("filtered") & F.col("valid")).alias("transformed"))
    return out.withColumn("success_rate", share(F.col("transformed") * 100, F.col("processed")))


def content_fingerprint(df: DataFrame, column: str) -> DataFrame:
    """Rows and sums that don't depend on their order."""
    data = F.col(column).cast("binary")
    return df.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.crc32(data)), F.lit(0)).alias("crc_sum"), F.coalesce(F.bit_xor(F.crc32(data)), F.lit(0)).alias("crc_xor"))


def verify_counts(tables: dict[str, DataFrame], date: str) -> DataFrame:
    parts = [df.filter(F.col("batch_date") == date).agg(F.lit(name).alias("name"), F.count("*").alias("n")) for name, df in tables.items()]
    return reduce(DataFrame.unionByName, parts)


def pending_count(files: DataFrame, hours: int, as_of: Column) -> DataFrame:
    return files.filter(F.col("status").isin("ARRIVED", "READY") & (F.col("arrived_at") < before(as_of, hours * 60))).agg(F.count("*").alias("pending"))


def params_to_map(df: DataFrame, key: str = "task_id") -> DataFrame:
    """Parameter rows as one map and as ``k=v&k=v`` in the order of names; a task has few parameters."""
    pairs = F.array_sort(F.collect_set(F.struct("name", "value")))
    rows = df.groupBy(key).agg(pairs.alias("pairs"))
    return rows.select(key, F.map_from_entries("pairs").alias("params"), F.array_join(F.transform("pairs", lambda p: F.concat_ws("=", p["name"], F.coalesce(p["value"], F.lit("")))), "&").alias("text"))


def dlq_counts(df: DataFrame) -> DataFrame:
    open_ = ~F.col("handled")
    return df.groupBy("compensation_status").agg(F.count_if(open_).alias("open"), F.count_if(open_ & F.col("manual_required")).alias("manual"))

"""Latest, first and numbered rows by key; merges; set differences; paging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _ordered(keys: list[str | Column], order: list[Column | str]):
    return Window.partitionBy(*keys).orderBy(*order)


def first_per_key(df: DataFrame, keys: list[str | Column], order: list[Column | str]) -> DataFrame:
    """The first row of each key."""
    return df.withColumn("_n", F.row_number().over(_ordered(keys, order))).filter("_n = 1").drop("_n")


def dedup_keep_first(df: DataFrame, keys: list[str | Column], order: list[Column | str]) -> DataFrame:
    return first_per_key(df, keys, order)


def latest_per_key(df: DataFrame, keys: list[str | Column], ts: str, *ties: str) -> DataFrame:
    return first_per_key(df, keys, [F.desc_nulls_last(ts), *(F.desc(t) for t in ties)])


def dedup_batch(df: DataFrame, keys: list[str], order: list[Column | str]) -> tuple[DataFrame, DataFrame]:
    """(kept, duplicates) of a batch: the first row of each key stays."""
    rows = df.withColumn("_n", F.row_number().over(_ordered(keys, order)))
    return rows.filter("_n = 1").drop("_n"), rows.filter("_n > 1").drop("_n")


def number_rows(df: DataFrame, keys: list[str], order: list[Column | str], name: str = "ordinal") -> DataFrame:
    return df.withColumn(name, F.row_number().over(_ordered(keys, order)))


def order_steps(steps: DataFrame) -> DataFrame:
    """Steps of each job by start time, those not started last, then by name."""
    return number_rows(steps, ["job_execution_id"], [F.asc_nulls_last("start_time"), F.asc("step_name")], "step_order")


def version_files(df: DataFrame) -> DataFrame:
    """Versions of the files of one stored path: number, the file before, and whether it is the latest."""
    w = Window.partitionBy("stored_path").orderBy("created_at", "id")
    return df.withColumns({"version_no": F.row_number().over(w), "parent_file_id": F.lag("id").over(w), "latest_version": F.lead("id").over(w).isNull()})


def failure_streak(df: DataFrame, key: str = "task_id", ts: str = "created_at", tie: str = "id", most: int = 10) -> DataFrame:
    """Failures in a row up to each event, from 0 after a success, ``most`` at most."""
    w = Window.partitionBy(key).orderBy(ts, tie)
    runs = df.withColumn("_run", F.sum((F.col("status") == "SUCCESS").cast("int")).over(w))
    inside = Window.partitionBy(key, "_run").orderBy(ts, tie)
    return runs.withColumn("streak", F.least(F.sum((F.col("status") == "FAILED").cast("int")).over(inside), F.lit(most))).drop("_run")


#: Transitions of a file's status (fixed values).
TRANSITIONS = {
    "UPLOADING": ("ARRIVED", "FAILED"),
    "ARRIVED": ("READY", "FAILED"),
    "READY": ("PROCESSING", "FAILED"),
    "PROCESSING": ("PROCESSED", "FAILED"),
    "PROCESSED": ("DISPATCHING", "ARCHIVED"),
    "DISPATCHING": ("PROCESSED", "DISPATCHED", "FAILED"),
    "DISPATCHED": ("PROCESSED", "FAILED", "ARCHIVED"),
    "FAILED": ("READY", "PROCESSED"),
    "ARCHIVED": (),
}


def invalid_transitions(log: DataFrame, key: str = "file_record_id", ts: str = "created_at", tie: str = "id") -> DataFrame:
    """Events whose status can't follow the one before; a repeated status is no transition."""
    w = Window.partitionBy(key).orderBy(ts, tie)
    rows = log.withColumn("status_from", F.lag("status").over(w)).filter(F.col("status_from").isNotNull() & (F.col("status_from") != F.col("status")))
    allowed = F.lit(False)
    for a, following in TRANSITIONS.items():
        if following:
            allowed = allowed | ((F.col("status_from") == a) & F.col("status").isin(*following))
    return rows.filter(~allowed)


def state_times(log: DataFrame, key: str, ts: str, statuses: dict[str, str]) -> DataFrame:
    """When each status was first reached: one column for each of ``statuses`` (column name to status)."""
    return log.groupBy(key).agg(*(F.min(F.when(F.col("status") == s, F.col(ts))).alias(c) for c, s in statuses.items()))


def open_alerts(df: DataFrame) -> DataFrame:
    """The latest alert of each code, file and target; nulls are a value of their own."""
    return latest_per_key(df, ["alert_code", "file_record_id", "target_system"], "created_at", "id")


def restart_candidates(runs: DataFrame) -> DataFrame:
    """The latest failed or stopped run of each job of which none is running."""
    running = runs.filter(F.col("status").isin("STARTING", "STARTED")).select("job_name").distinct()
    return latest_per_key(runs.filter(F.col("status").isin("FAILED", "STOPPED")).join(running, "job_name", "left_anti"), ["job_name"], "created_at", "job_execution_id")


def replay_candidates(df: DataFrame, date: str, scope: str, ids: DataFrame | None = None) -> DataFrame:
    """The latest instance of each task of a day, of any end state, of failed ones, or of the asked tasks."""
    ended = ("COMPLETED", "PARTIAL_SUCCESS", "FAILED", "CANCELLED", "TIMEOUT")
    latest = latest_per_key(df.filter(F.col("biz_date") == date), ["task_id"], "created_at", "id")
    if scope == "ALL":
        return latest.filter(F.col("status").isin(*ended))
    if scope == "ALL_FAILED":
        return latest.filter(F.col("status").isin("FAILED", "TIMEOUT", "PARTIAL_SUCCESS"))
    return ids.join(latest, "task_id", "left")


def top_n(df: DataFrame, order: list[Column], n: int) -> DataFrame:
    return df.orderBy(*order).limit(n)


def page(df: DataFrame, order: list[Column], number: int, size: int) -> tuple[DataFrame, DataFrame]:
    """The rows of a page (from 0), and one row about it: page, size, total, total_pages, has_next."""
    rows = df.orderBy(*order).offset(number * size).limit(size)
    total = df.agg(F.count("*").alias("total"))
    pages = F.ceil(F.col("total") / size).cast("long")
    return rows, total.select(F.lit(number).alias("page"), F.lit(size).alias("size"), "total", pages.alias("total_pages"), (F.lit(number + 1) < pages).alias("has_next"))


def page_after(df: DataFrame, key: str, size: int, last=None) -> DataFrame:
    """The next page by a unique key, after the last key seen: no page costs more than the first, however deep."""
    rows = df if last is None else df.filter(F.col(key) > last)
    return rows.orderBy(key).limit(size)


def key_diff(source: DataFrame, target: DataFrame, key: str = "business_key", sample: int | None = None) -> DataFrame:
    """Keys of one side only, with the side; ``sample`` limits each side to its first keys."""
    a, b = source.select(key).distinct(), target.select(key).distinct()
    sides = []
    for left, right, label in ((a, b, "SOURCE_ONLY"), (b, a, "TARGET_ONLY")):
        only = left.join(right, key, "left_anti")
        sides.append((only.orderBy(key).limit(sample) if sample else only).select(key, F.lit(label).alias("diff_type")))
    return sides[0].unionByName(sides[1])


def merge_insert_new(target: DataFrame, updates: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """The updates to append: of each key the first row, unless the target has the key."""
    return first_per_key(updates, keys, order).join(target.select(*keys), keys, "left_anti")


def merge_upsert(target: DataFrame, updates: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """The target with the given columns of matching updates, and with the updates that match nothing."""
    u = updates.select(*keys, F.lit(True).alias("_hit"), *(F.col(c).alias(f"_{c}") for c in updates.columns if c not in keys))
    rows = target.withColumn("_had", F.lit(True)).join(u, keys, "full_outer")
    out = []
    for c in target.columns:
        if c in keys or f"_{c}" not in u.columns:
            out.append(F.col(c))
        elif c in columns:
            out.append(F.when(F.col("_hit"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c))
        else:
            out.append(F.when(F.col("_had"), F.col(c)).otherwise(F.col(f"_{c}")).alias(c))
    return rows.select(*out)


def insert_where_absent(target: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    return target.unionByName(rows.join(target.select(*keys), keys, "left_anti"), allowMissingColumns=True)


def lookup_ids(keys: DataFrame, target: DataFrame) -> DataFrame:
    """The ids of business keys in the target."""
    return keys.join(target.select("business_key", "id"), "business_key")

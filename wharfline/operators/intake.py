"""Manifests, arrivals, groups of expected files, archives, asset links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wharfline.functions.text import has_text
from wharfline.operators.filters import before
from wharfline.operators.keyed import first_per_key, insert_where_absent


def bind_arrivals(members: DataFrame, queue: DataFrame) -> DataFrame:
    """Expected files with the first arrival of their name: actual_queue_id, null if none came."""
    first = first_per_key(queue, ["file_name"], [F.asc("created_at"), F.asc("id")])
    arrived = first.select(F.col("file_name").alias("expected_file_name"), F.col("id").alias("actual_queue_id"), F.col("file_hash").alias("actual_checksum"), F.col("record_count").alias("actual_record_count"))
    return members.join(arrived, "expected_file_name", "left")


def reconcile_members(bound: DataFrame) -> DataFrame:
    """Bound members with ``mismatches`` and reconcile_status."""
    arrived = F.col("actual_queue_id").isNotNull()
    expects = F.col("expected_record_count")
    number = lambda c: F.coalesce(c.cast("string"), F.lit("none"))
    wrong_count = arrived & expects.isNotNull() & ~expects.eqNullSafe(F.col("actual_record_count"))
    wrong_sum = arrived & has_text("expected_checksum") & ~F.lower("expected_checksum").eqNullSafe(F.lower("actual_checksum"))
    found = F.array_compact(F.array(
        F.when(~arrived, "file not arrived"),
        F.when(wrong_count, F.concat(F.lit("record count: expected="), number(expects), F.lit(" actual="), number(F.col("actual_record_count")))),
        F.when(wrong_sum, "checksum mismatch"),
    ))
    return bound.withColumn("mismatches", found).withColumn("reconcile_status", F.when(F.size("mismatches") == 0, "PASS").otherwise("FAIL"))


def evaluate_groups(groups: DataFrame, members: DataFrame, queue: DataFrame, as_of: Column) -> DataFrame:
    """Groups with their next status: those whose required files are all here are reconciled, others wait or expire."""
    rows = reconcile_members(bind_arrivals(members, queue))
    here = F.col("actual_queue_id").isNotNull()
    by = rows.groupBy("manifest_id").agg(F.count("*").alias("total_members"), F.count_if(here).alias("arrived"), F.count_if(F.col("required") & ~here).alias("lacking"), F.count_if(here & (F.col("reconcile_status") == "FAIL")).alias("failing"))
    joined = groups.join(by, "manifest_id", "left").na.fill(0, ["arrived", "lacking", "failing"])
    late = F.coalesce(F.col("deadline") < as_of, F.lit(False))
    status = F.when(F.col("lacking") > 0, F.when(late, "EXPIRED").otherwise("WAITING_FILES")).when(F.col("failing") > 0, "FAILED").otherwise("DISPATCHED")
    return joined.select("manifest_id", "arrived", "lacking", "failing", F.when(F.col("status") == "WAITING_FILES", status).otherwise(F.col("status")).alias("status"))


def register_manifests(manifests: DataFrame, groups: DataFrame, ttl_hours: int, now: Column) -> DataFrame:
    """New groups, one for each manifest that has none yet."""
    new = manifests.groupBy("manifest_id").agg(F.count("expected_file_name").alias("total_members"), F.count_if("required").alias("required_members"))
    deadline = F.timestamp_millis(F.unix_millis(now) + ttl_hours * 3_600_000)
    return new.join(groups.select("manifest_id"), "manifest_id", "left_anti").withColumns({"status": F.lit("WAITING_FILES"), "arrived_members": F.lit(0), "deadline": deadline})


def verify_integrity(queue: DataFrame, fingerprints: DataFrame) -> DataFrame:
    """Arrivals with ``problem``: MISSING, SIZE or HASH; null if the file is as it was."""
    f = fingerprints.select(F.col("path").alias("file_path"), F.col("length").alias("_length"), F.col("file_hash").alias("_hash"), F.lit(True).alias("_here"))
    problem = F.when(F.col("_here").isNull(), "MISSING").when(F.col("_length") != F.col("file_size"), "SIZE").when(~F.lower("_hash").eqNullSafe(F.lower("file_hash")), "HASH")
    return queue.join(f, "file_path", "left").withColumn("problem", problem).drop("_length", "_hash", "_here")


def classify_arrivals(new: DataFrame, known: DataFrame) -> DataFrame:
    """New arrivals with ``kind``: DUPLICATE (name and content known), CONFLICT (name known, other content),
    DUPLICATE_CONTENT (content known from the source), NEW."""
    names = known.groupBy("file_name").agg(F.count("*").alias("_names"))
    both = known.select("file_name", "file_hash").distinct().withColumn("_both", F.lit(True))
    content = known.select("source_system", "file_hash").distinct().withColumn("_content", F.lit(True))
    rows = new.join(names, "file_name", "left").join(both, ["file_name", "file_hash"], "left").join(content, ["source_system", "file_hash"], "left")
    kind = F.when(F.col("_both"), "DUPLICATE").when(F.col("_names") > 0, "CONFLICT").when(F.col("_content"), "DUPLICATE_CONTENT").otherwise("NEW")
    return rows.withColumn("kind", kind).drop("_names", "_both", "_content")


def archivable_files(files: DataFrame, policies: DataFrame, dispatches: DataFrame, queue: DataFrame, members: DataFrame, as_of: Column) -> DataFrame:
    """Processed files past the shortest retention of their type without anything going on."""
    days = policies.groupBy("file_direction").agg(F.min("retention_days").alias("days"))
    old = files.filter(F.col("status").isin("PROCESSED", "DISPATCHED")).join(days, "file_direction").filter(F.col("processed_at") < F.timestamp_millis(F.unix_millis(as_of) - F.col("days").cast("long") * 86_400_000))
    active = dispatches.filter(F.col("dispatch_status").isin("PENDING", "DISPATCHING", "RETRY")).select(F.col("file_record_id").alias("id"))
    waiting = queue.filter(F.col("status").isin("RECEIVED", "WAITING", "PROCESSING")).select(F.col("file_record_id").alias("id"))
    bound = members.filter("open").select(F.col("file_record_id").alias("id"))
    return old.join(active, "id", "left_anti").join(waiting, "id", "left_anti").join(bound, "id", "left_anti").drop("days")


def backfill_assets(queue: DataFrame, assets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(assets with those of unlinked arrivals, arrivals with their link by file number)."""
    number = F.concat(F.lit("BF-"), F.col("id").cast("string"))
    new = queue.filter("file_record_id IS NULL").select(number.alias("file_no"), F.col("file_path").alias("stored_path"), "file_hash", "source_system")
    merged = insert_where_absent(assets, new, ["file_no"])
    return merged, queue.withColumn("linked_file_no", F.when(F.col("file_record_id").isNull(), number))


def file_detail(files: DataFrame, logs: DataFrame, dispatches: DataFrame) -> DataFrame:
    """Files with their log entries and dispatches as lists in order; a file has few of either."""
    entries = logs.groupBy(F.col("file_record_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("created_at", F.col("id").alias("log_id"), "status"))).alias("logs"))
    sent = dispatches.groupBy(F.col("file_record_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct(F.col("id").alias("dispatch_id"), "dispatch_status"))).alias("dispatches"))
    return files.join(entries, "id", "left").join(sent, "id", "left")


#: Most entries of each kind in the lineage of a key (fixed values).
TRACE_LIMITS = {"TRACE": 200, "IMPORT": 50, "DLQ": 50, "LOG": 50}


def trace_key(tables: dict[str, DataFrame], key: str) -> DataFrame:
    """What is known of a business key: kind, created_at, detail, newest first of each kind. tables: kind to frame."""
    out = None
    for kind, df in tables.items():
        where = F.col("detail").contains(key) if kind in ("DLQ", "LOG") else F.col("business_key") == key
        rows = df.filter(where).orderBy(F.desc("created_at"), F.desc("id")).limit(TRACE_LIMITS[kind]).select(F.lit(kind).alias("kind"), "id", "created_at", "detail")
        out = rows if out is None else out.unionByName(rows)
    return out


def import_trace(batch: DataFrame, target: DataFrame, job: str) -> DataFrame:
    """One lineage row for each imported record, with its id in the target."""
    ids = target.select("business_key", "batch_date", F.col("id").alias("imported_record_partition_id"))
    return batch.join(ids, ["business_key", "batch_date"], "left").select("business_key", "batch_date", F.lit(job).alias("job_name"), F.lit("IMPORT").alias("event_type"), F.lit("SUCCESS").alias("status"), F.col("line_no"), "imported_record_partition_id")


def export_trace(df: DataFrame, job: str, file: str) -> DataFrame:
    return df.filter(has_text("business_key")).select("business_key", "batch_date", F.lit(job).alias("job_name"), F.lit("EXPORT").alias("event_type"), F.lit("SUCCESS").alias("status"), F.lit(file).alias("output_file_name"))

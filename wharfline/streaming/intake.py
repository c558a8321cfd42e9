"""Incremental import: each new file goes through the import job once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wharfline.operators.intake import import_trace
from wharfline.plans.jobs import import_records
from wharfline.plans.sinks import merge_into, read_partitioned, write_dlq
from wharfline.shared import remove, shared_dir
from wharfline.sources.documents import stream_files
from wharfline.sources.text import numbered_lines, parse_delimited


def import_batch(spark: SparkSession, batch: DataFrame, out: str, batch_date: str, delimiter: str = ",") -> None:
    """Import the files that a micro-batch names: new records, a trace of each, dead letters. Done again, it adds nothing.

    Lines that couldn't be parsed are dead letters too; those and rejected rows are known by their file and line,
    traces by key and date.
    """
    files = [r.file for r in batch.select("file").distinct().limit(100_001).collect()]
    if len(files) > 100_000:
        raise ValueError("too many files in a micro-batch; set maxFilesPerTrigger")
    if not files:
        return
    lines = shared_dir(spark, "lines")
    try:
        _import_lines(spark, numbered_lines(spark, files, lines), out, batch_date, delimiter)
    finally:
        remove(spark, lines)


def _import_lines(spark: SparkSession, lines: DataFrame, out: str, batch_date: str, delimiter: str) -> None:
    as_of = F.to_timestamp(F.lit(batch_date))
    job = import_records(parse_delimited(lines, delimiter), F.lit(batch_date), as_of)
    merge_into(spark, f"{out}/records", job.records, ["file", "line_no"])
    # a record that is there was imported, by this try or by one that ended before its trace was written
    table = read_partitioned(spark, f"{out}/records", job.records.schema)
    here = job.records.join(table.select("business_key", "batch_date", "file", "line_no"), ["business_key", "batch_date", "file", "line_no"], "left_semi")
    trace = import_trace(here, table, "import")
    known = read_partitioned(spark, f"{out}/trace", trace.schema).select("business_key", "batch_date")
    trace.join(known, ["business_key", "batch_date"], "left_anti").write.mode("append").parquet(f"{out}/trace")
    nothing = F.lit(None).cast("string")
    rejected = job.rejected.select("file", "line_no", nothing.alias("business_key"), F.lit(batch_date).alias("batch_date"), "name", "description", "error")
    unread = job.bad.select("file", "line_no", nothing.alias("business_key"), F.lit(batch_date).alias("batch_date"), nothing.alias("name"), F.col("line").alias("description"), "error")
    write_dlq(rejected.unionByName(unread), f"{out}/dlq", "import", ("file", "line_no"))


def stream_import(spark: SparkSession, directory: str, out: str, batch_date: str, delimiter: str = ",", most_files: int = 1000):
    """A query that imports what is new in a directory and ends; its checkpoint says what has been imported."""
    lines = stream_files(spark, directory, "value string", maxFilesPerTrigger=str(most_files)).select(F.col("_metadata.file_path").alias("file"))
    return lines.writeStream.foreachBatch(lambda batch, _: import_batch(spark, batch, out, batch_date, delimiter)).option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start()

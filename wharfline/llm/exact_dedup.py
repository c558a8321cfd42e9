"""Exact deduplication by a stream over disk-backed keyed state.

A structured stream reads an index of the documents (digest of the normalised text, ``doc_id``, content
locator) and keeps, for each digest, its smallest row and a count. The state lives in RocksDB on the
executors' disks, is committed to the shared folder after each micro-batch and never expires, so another run
with the same ``state_dir`` goes on where this one ended. A digest seen more than once is a hit; hits are
settled by comparing full bytes: locators lead to the texts, in this run's documents or in the files of earlier
runs, and if a digest should ever hold different texts, its rows are grouped again by their bytes.

Everything is DataFrame code. Only texts of hits are shuffled: a bitmap of their locators, of a set size, is
broadcast and lets other texts go by. A group of copies of any size is aggregated map-side first; the join of
rows to groups carries no texts and is split by adaptive execution where a digest is hot.

Cases: a null text is empty; texts are equal if identical after each run of white space became one space;
of equal texts the row with the smallest ``doc_id`` stays, nulls last, then the first by locator, so that
repeated ids keep one row too; an empty table gives no rows; other columns are ignored, whatever their names.
With a ``state_dir``, rows of earlier runs are returned too, and a row of the same file and place counts once.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wharfline.llm.workdir import materialize, spare_name
from wharfline.shared import exists, shared_dir

SPACE = r"[\x20\x09-\x0D]+"
STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "128",
    # many small stores shouldn't each claim space ahead
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    # stores close with their task, so that the memory is free when the stream has ended
    "spark.sql.streaming.stateStore.unloadOnCommit": "true",
}
#: The bitmap of hits has two to this power of bits (4 MB).
BITMAP = 25


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " ")


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def _located(docs: DataFrame, from_files: bool, name: str = "locator") -> DataFrame:
    """All columns and a locator: file and row of it, or the row's number in the plan."""
    if from_files:
        return docs.withColumn(name, F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")))
    return docs.withColumn(name, F.struct(F.lit("").alias("file"), F.monotonically_increasing_id().alias("row")))


def _run_stream(spark: SparkSession, index_dir: str, state_dir: str, out_dir: str, **options: str) -> None:
    """Fold new index files into the state; each micro-batch writes the digests it changed."""
    schema = spark.read.parquet(index_dir).schema
    before = {k: spark.conf.get(k, None) for k in STATE}
    for k, v in STATE.items():
        spark.conf.set(k, v)
    try:
        rows = spark.readStream.schema(schema).options(**options).parquet(index_dir)
        groups = rows.groupBy("digest").agg(F.min("first").alias("keep"), F.count("*").alias("group_size"))
        groups.writeStream.outputMode("update").option("checkpointLocation", state_dir).trigger(availableNow=True).foreachBatch(
            lambda batch, n: batch.withColumn("batch", F.lit(n)).write.mode("overwrite").parquet(f"{out_dir}/batch={n}")
        ).start().awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _only_marked(rows: DataFrame, marked: DataFrame, bits: int = BITMAP) -> DataFrame:
    """The rows whose locator is among those of ``marked``, and a few others, found without a shuffle of rows."""
    place = lambda row: F.pmod(F.xxhash64("locator.file", "locator.row"), F.lit(1 << bits)).alias(row)
    map_of = marked.select(place("bit")).groupBy(F.bitmap_bucket_number("bit").alias("page")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("map"))
    at = F.bitmap_bit_position("bit")
    byte = F.conv(F.hex(F.substring("map", (F.shiftright(at, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    found = rows.withColumn("bit", place("bit")).join(F.broadcast(map_of), F.bitmap_bucket_number("bit") == F.col("page"))  # 2 ** bits bits at most
    found = found.withColumns({"byte": byte, "at": (at % 8).cast("int")})
    return found.filter("shiftright(byte, at) & 1 = 1").drop("bit", "page", "map", "byte", "at")


def exact_groups(docs: DataFrame, from_files: bool = False, digest: Callable[[Column], Column] = sha256, state_dir: str | None = None, max_bytes: str | None = None) -> DataFrame:
    """One row for each document: doc_id, digest, locator, keep_id, group_size, kept.

    from_files: ``docs`` is a plain read of files, whose rows have lasting locators; else the locator is the
    row's number in the plan or, with a ``state_dir``, its place in a copy of the texts kept there.
    max_bytes: of index files in a micro-batch, all in one by default. ``digest``: of the normalised text.
    """
    spark = docs.sparkSession
    base = state_dir or shared_dir(spark, "exact-dedup")
    rows = docs.select("doc_id", "text")
    if state_dir and not from_files:
        rows.write.parquet(copy := f"{base}/texts/{uuid.uuid4().hex}")
        rows, from_files = spark.read.schema(rows.schema).parquet(copy), True
    located = _located(rows, from_files)
    text = normalised(F.col("text"))
    first = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", F.col("locator.file").alias("file"), F.col("locator.row").alias("row"))
    fresh = located.select(digest(text).alias("digest"), first.alias("first"), "locator")
    if state_dir and exists(spark, f"{base}/index"):
        seen = spark.read.parquet(f"{base}/index").select(F.struct("first.file", "first.row").alias("seen"))
        fresh = fresh.join(seen, F.col("locator") == F.col("seen"), "left_anti")
    fresh.select("digest", "first").write.mode("append").parquet(f"{base}/index")
    _run_stream(spark, f"{base}/index", f"{base}/state", f"{base}/groups", **({"maxBytesPerTrigger": max_bytes} if max_bytes else {}))
    index = spark.read.parquet(f"{base}/index")
    # a digest is in each batch that changed it; its count only rises and its first row only falls
    groups = spark.read.parquet(f"{base}/groups").groupBy("digest").agg(F.min("keep").alias("keep"), F.max("group_size").alias("group_size"))
    # as a table of its own, so that the join can be split where a digest is hot
    groups = materialize(spark, groups, "exact-dedup")
    place = F.struct("first.file", "first.row").alias("locator")
    shape = [F.col("first.doc_id").alias("doc_id"), "digest", place, F.col("keep.doc_id").alias("keep_id"), "group_size", F.col("first").eqNullSafe(F.col("keep")).alias("kept")]
    same = index.join(groups, "digest").select(*shape)
    hits = materialize(spark, index.join(groups.filter("group_size > 1").select("digest"), "digest").select("digest", "first", place), "exact-dedup")
    texts = located.select("locator", "text")
    if state_dir:
        here = located.select("locator.file").distinct()
        earlier = [r.file for r in hits.select("locator.file").distinct().join(here, "file", "left_anti").collect()]  # names of files, not of rows
        if earlier:
            texts = texts.unionByName(_located(spark.read.parquet(*earlier).select("text"), True).select("locator", "text"))
    # hits, checked by their bytes: a digest of more than one text is split by text
    checked = _only_marked(texts, hits).join(hits, "locator").select("digest", "first", text.alias("text"))
    checked = materialize(spark, checked, "exact-dedup")
    unlike = checked.groupBy("digest").agg((F.min("text") != F.max("text")).alias("unlike")).filter("unlike").select("digest")
    unlike = materialize(spark, unlike, "exact-dedup")
    if unlike.isEmpty():
        return same
    split = checked.join(unlike, "digest", "left_semi")
    parts = split.groupBy("digest", "text").agg(F.min("first").alias("keep"), F.count("*").alias("group_size"))
    again = split.join(parts, ["digest", "text"]).select(*shape)
    return same.join(unlike, "digest", "left_anti").unionByName(again)


def dedup_report(docs: DataFrame, from_files: bool = True) -> DataFrame:
    """One row for each document; the digest is SHA-256 of the normalised text."""
    return exact_groups(docs, from_files).select("doc_id", "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


def keep_first(docs: DataFrame, from_files: bool = False) -> DataFrame:
    """One document of each group of equal texts, that of the smallest doc_id, with its columns as they were."""
    name = spare_name(docs, "locator")
    kept = exact_groups(docs, from_files).filter("kept").select(F.col("locator").alias(name))
    return _located(docs, from_files, name).join(kept, name, "left_semi").select(*docs.columns)

"""Sharding by fixed virtual slots and a versioned map from slots to shards.

A record's slot is a hash of its id and never changes. Bytes are summed by slot, which leaves some thousand
rows however large the table is, and the slots, largest first, go to the shard that has least so far. The map is
a table with a version. Rebalancing writes a new version: slots stay where they are as long as their shard
isn't above its share, and only what stands over goes to shards that are below theirs.

A shard's rows are numbered without sorting a shard: slots are laid one after another, distinct ids are numbered
inside a slot, and equal ids inside an id by the parts of one written table, so that neither a shard, a slot nor
a repeated id has to fit a task.

Cases: a null text has size 1 and the checksum of no bytes; a row without an id goes by a hash of its text;
rows with equal ids share a slot, whatever their texts; the last ties of a shard's order are in the order in which rows
are read; an empty table gives no rows and a map of empty slots; other columns are kept out of the way.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wharfline.llm.workdir import materialize
from wharfline.shared import shared_dir

#: Virtual slots: many for each shard there may ever be, few enough for one row each on the driver.
SLOTS = 4096
SHARDS = 8
#: By how much of its share a shard may be above it before slots leave.
SLACK = 0.01


def text_size(text: Column) -> Column:
    """UTF-8 bytes of a text and its end mark."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1


def slot_of(doc_id: Column, text: Column, slots: int = SLOTS) -> Column:
    """The virtual slot of a record, by its id alone; by its text if it has no id."""
    key = F.coalesce(doc_id.cast("string"), F.concat(F.lit("text "), F.md5(F.coalesce(text, F.lit("")).cast("binary"))))
    return (F.conv(F.substring(F.md5(key.cast("binary")), 1, 8), 16, 10).cast("long") % slots).cast("int")


def slot_sizes(spark: SparkSession, rows: DataFrame, slots: int = SLOTS) -> DataFrame:
    """slot, bytes, rows of each slot, empty ones too."""
    sums = rows.groupBy("slot").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    every = spark.range(slots).select(F.col("id").cast("int").alias("slot"))
    return every.join(sums, "slot", "left").select("slot", F.coalesce("bytes", F.lit(0)).alias("bytes"), F.coalesce("rows", F.lit(0)).alias("rows"))


def _dealt(slots: DataFrame, loads: Column) -> DataFrame:
    """slot, bytes, rows and shard: the largest slot first, each to the shard of least load, the first of equal ones.

    ``loads`` has a number for each shard, null for shards that take nothing. A frame of slots is folded in one
    row; it has as many entries as there are slots.
    """
    entry = F.struct((-F.col("bytes")).alias("less"), "slot", "bytes", "rows")
    line = slots.agg(F.sort_array(F.collect_list(entry)).alias("slots"), F.first(loads).alias("loads"))
    start = F.struct(F.col("loads"), F.array().cast("array<int>").alias("to"))

    def give(state: Column, slot: Column) -> Column:
        least = F.array_position(state["loads"], F.array_min(state["loads"])).cast("int") - 1
        return F.struct(F.transform(state["loads"], lambda x, i: F.when(i == least, x + slot["bytes"]).otherwise(x)).alias("loads"), F.concat(state["to"], F.array(least)).alias("to"))

    to = F.aggregate("slots", start, give)["to"]
    pairs = line.select("slots", to.alias("to")).select(F.explode(F.arrays_zip("slots", "to")).alias("p"))
    return pairs.select("p.slots.slot", "p.slots.bytes", "p.slots.rows", F.col("p.to").alias("shard"))


def first_map(sizes: DataFrame, shards: int = SHARDS) -> DataFrame:
    """version 1 of the map: slot, shard, bytes, rows."""
    dealt = _dealt(sizes, F.array_repeat(F.lit(0).cast("long"), shards))
    return dealt.select(F.lit(1).alias("version"), "slot", "shard", "bytes", "rows")


def edited_map(current: DataFrame, sizes: DataFrame, shards: int, slack: float = SLACK) -> DataFrame:
    """The next version for ``shards`` shards and the present sizes of slots; most slots stay where they are.

    A shard keeps its slots, largest first, while they fit its share and ``slack`` of it; slots of shards that are no
    more leave too. What has left goes to shards that gave nothing, so a new shard takes slots and the old ones get none.
    """
    rows = current.select("version", "slot", "shard").join(sizes, "slot")
    whole = Window.partitionBy()  # as many rows as slots
    share = F.sum("bytes").over(whole) / shards * (1 + slack)
    order = Window.partitionBy("shard").orderBy(F.desc("bytes"), "slot").rowsBetween(Window.unboundedPreceding, 0)
    # a slot that is above a share by itself may stay alone
    rows = rows.withColumn("share", share).withColumn("sum", F.sum("bytes").over(order)).withColumn("place", F.count("*").over(order))
    rows = rows.withColumn("stays", (F.col("shard") < shards) & ((F.col("sum") <= F.col("share")) | (F.col("place") == 1)))
    rows = materialize(current.sparkSession, rows, "slot-map")
    kept = rows.groupBy("shard").agg(F.sum(F.when(F.col("stays"), F.col("bytes"))).alias("load"), F.bool_or(~F.col("stays")).alias("gave"))
    each = current.sparkSession.range(shards).select(F.col("id").cast("int").alias("shard")).join(kept, "shard", "left")
    load = F.when(F.coalesce("gave", F.lit(False)), F.lit(None)).otherwise(F.coalesce("load", F.lit(0)).cast("long"))
    # array_min passes over nulls, so shards that gave take nothing
    loads = each.agg(F.transform(F.sort_array(F.collect_list(F.struct("shard", load.alias("load")))), lambda x: x["load"]).alias("loads"))
    moved = _dealt(rows.filter(~F.col("stays")).select("slot", "bytes", "rows").crossJoin(F.broadcast(loads)), F.col("loads"))
    both = rows.filter("stays").select("slot", "shard", "bytes", "rows").unionByName(moved.select("slot", "shard", "bytes", "rows"))
    last = rows.agg((F.max("version") + 1).cast("int").alias("version"))
    return both.crossJoin(F.broadcast(last)).select("version", "slot", "shard", "bytes", "rows")


def store_map(slot_map: DataFrame, path: str) -> None:
    """Add a version to the table of maps; earlier versions stay. A version is one file."""
    slot_map.coalesce(1).write.mode("append").parquet(path)


def read_map(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """A version of the map, the last one if none is named."""
    rows = spark.read.parquet(path)
    if version is not None:
        return rows.filter(F.col("version") == version)
    return rows.join(F.broadcast(rows.agg(F.max("version").alias("version"))), "version", "left_semi")


def sharded(docs: DataFrame, path: str, shards: int = SHARDS, slots: int = SLOTS) -> DataFrame:
    """doc_id, size, text_crc32, virtual_slot, shard, place (in the shard, from 0), by the map stored at ``path``.

    The first call stores version 1; a call with another number of shards stores an edited version. Maps are for one
    number of slots.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        "doc_id", text_size(F.col("text")).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), slot_of(F.col("doc_id"), F.col("text"), slots).alias("slot"),
        F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at"),
    )
    rows = materialize(spark, rows, "shard-rows")
    sizes = slot_sizes(spark, rows, slots)
    current = _last_map(spark, path)
    if current is None:
        store_map(first_map(sizes, shards), path)
    elif current.filter("rows > 0").agg(F.max("shard")).first()[0] != shards - 1:
        store_map(edited_map(current, sizes, shards), path)
    return _placed(rows, materialize(spark, sizes.select("slot", "rows"), "slot-rows"), read_map(spark, path))


def _last_map(spark: SparkSession, path: str) -> DataFrame | None:
    from wharfline.shared import exists

    return read_map(spark, path) if exists(spark, path) else None


def _placed(rows: DataFrame, counts: DataFrame, slot_map: DataFrame) -> DataFrame:
    """Rows with their shard and their place there."""
    # a row for each slot, some thousand of them
    before = F.sum("rows").over(Window.partitionBy("shard").orderBy("slot")) - F.col("rows")
    starts = slot_map.select("slot", "shard").join(F.broadcast(counts), "slot").select("slot", "shard", before.alias("start"))
    key = ["slot", "doc_id", "part"]
    ids = rows.groupBy(*key).agg(F.count("*").alias("n"))
    ids = ids.select(F.col("slot").alias("s"), F.col("doc_id").alias("d"), F.col("part").alias("p"), (F.sum("n").over(Window.partitionBy("slot").orderBy("doc_id", "part")) - F.col("n")).alias("ahead"))
    rows = rows.withColumn("nth", F.row_number().over(Window.partitionBy(*key).orderBy("at")) - 1)
    rows = rows.join(ids, (F.col("slot") == F.col("s")) & F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("part") == F.col("p")))
    rows = rows.join(F.broadcast(starts.withColumnRenamed("slot", "t")), F.col("slot") == F.col("t"))
    return rows.select("doc_id", "size", "text_crc32", F.col("slot").alias("virtual_slot"), "shard", (F.col("start") + F.col("ahead") + F.col("nth")).alias("place"))


def write_shards(docs: DataFrame, path: str, map_path: str, shards: int = SHARDS, slots: int = SLOTS, files_a_shard: int = 1) -> None:
    """Write the documents with their columns as they are, in a folder for each shard, by the last version of the map."""
    where = read_map(docs.sparkSession, map_path).select(F.col("slot").alias("_slot_of_map"), F.col("shard"))
    if "shard" in docs.columns:
        raise ValueError("the documents have a column named shard")
    rows = docs.withColumn("_slot_of_row", slot_of(F.col("doc_id"), F.col("text"), slots))
    rows = rows.join(F.broadcast(where), F.col("_slot_of_row") == F.col("_slot_of_map")).drop("_slot_of_map")
    spread = F.col("_slot_of_row") % files_a_shard
    rows.repartition(shards * files_a_shard, "shard", spread).drop("_slot_of_row").write.partitionBy("shard").parquet(path)


def sharding_report(docs: DataFrame) -> DataFrame:
    """One row for each document: its size and checksum, its shard of eight and its place there."""
    rows = sharded(docs, shared_dir(docs.sparkSession, "slot-maps"))
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("place").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "virtual_slot")

"""Mixing sources to target weights by weighted fair queueing.

Each source is a queue of its documents in shuffled order, repeated up to ``most_repeats`` times. A document
leaves its queue at a virtual finish time: the words its source has sent, itself included, divided by the
source's target. The mix is what finishes first, up to the total budget.

The running sums aren't windows over a source, which may hold a third of all rows: documents fall into many
buckets of each source by their shuffle key, sums of buckets are accumulated first, and only the rows of one
bucket are accumulated together. The global cut works alike on slices of virtual time.

Cases: a null text has size 0; a null source is a source of its own and comes last; equal or null ids are
documents of their own; sizes of 0 are never taken; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wharfline.llm.workdir import materialize, spare_name

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (1, 2, 3)
MOST_REPEATS = 3
#: Rows in a bucket, on average over all sources.
BUCKET_ROWS = 2000
#: Slices of a doubling of virtual time, and parts of a slice.
COARSE, FINE = 512, 4096


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most_repeats: int = MOST_REPEATS) -> DataFrame:
    """source, source_size -> and its target: shares by weight, none above ``most_repeats`` times the size.

    Resharing what is above until none is above ends where the targets are min(cap, level * weight) with one
    level for all. Sources reach their cap in the order of cap / weight, so the level comes from running sums.
    The frame has one row for each source.
    """
    rank = F.row_number().over(Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))) - 1
    pick = F.element_at(F.array(*map(F.lit, weights)), (rank % len(weights) + 1).cast("int"))
    rows = sizes.select("source", "source_size", rank.alias("rank"), pick.alias("weight"), (F.col("source_size") * most_repeats).alias("cap"))
    order = Window.orderBy(F.col("cap") / F.col("weight"), "rank")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing).partitionBy()
    left = F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0))
    open_weight = F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    rows = rows.withColumn("level", left / open_weight)
    # sources not yet at their cap when their turn comes share the level of the first such source
    first = F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct(F.col("cap") / F.col("weight"), "rank", "level"))).over(whole)["level"]
    return rows.select("source", "rank", "source_size", F.least(F.col("cap").cast("double"), first * F.col("weight")).alias("target"))


def mix(docs: DataFrame, seed: int = 0, weights: tuple[int, ...] = WEIGHTS, most_repeats: int = MOST_REPEATS, bucket_rows: int = BUCKET_ROWS, row: str | None = None) -> DataFrame:
    """doc_id, row, source, size, source_size, target and ``repeats``, how many times the mix takes the document.

    row: a column that tells the rows apart; numbers are given out if there is none.
    """
    spark = docs.sparkSession
    number = F.col(row) if row else F.monotonically_increasing_id()
    # documents without an id are told apart by their number, so that they don't share a place
    known = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("row "), number.cast("string")))
    shuffled = F.md5(F.concat_ws(":", F.lit(str(seed)), known))
    rows = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), shuffled.alias("key"), F.xxhash64("text").alias("tie"), number.alias("row"))
    rows = materialize(spark, rows, "mixing")
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("source_rows"))
    targets = source_targets(sizes, weights, most_repeats)
    # buckets split the key range evenly; a source of few rows leaves most of them empty
    total = rows.count()
    n = 1
    while n * bucket_rows < total:
        n *= 2
    part = lambda key: F.floor(F.conv(F.substring(key, 1, 8), 16, 10).cast("long") * n / (1 << 32))
    rows = rows.withColumn("bucket", part(F.col("key")))
    same = F.col("source").eqNullSafe(F.col("s"))
    sums = rows.groupBy(F.col("source").alias("s"), F.col("bucket").alias("b")).agg(F.sum("size").alias("bucket_size"))
    sums = sums.withColumn("before", F.sum("bucket_size").over(Window.partitionBy("s").orderBy("b")) - F.col("bucket_size"))
    inside = F.sum("size").over(Window.partitionBy("source", "bucket").orderBy("key", "doc_id", "tie", "row").rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("inside", inside)
    rows = rows.join(sums.drop("bucket_size"), same & (F.col("bucket") == F.col("b"))).drop("s", "b")
    rows = rows.join(targets.withColumnRenamed("source", "s"), same).drop("s")
    rows = rows.select("doc_id", "source", "rank", "size", "source_size", "target", "key", "tie", "row", (F.col("before") + F.col("inside")).alias("sent"))
    rows = materialize(spark, rows, "mixing")
    # virtual finish times of the passes that can come before the cut; targets sum to the budget, so it is near 1
    passes = F.explode(F.sequence(F.lit(0), F.lit(most_repeats - 1))).alias("pass")
    copies = rows.filter("size > 0 and target > 0").select("*", passes)
    copies = copies.withColumn("finish", (F.col("pass") * F.col("source_size") + F.col("sent")) / F.col("target"))
    # the cut is found in two steps of slices of virtual time, each of some thousands, then row by row
    budget = sizes.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("left"))
    scaled = F.log2(1 + F.col("finish")) * COARSE
    copies = copies.withColumn("slice", F.floor(scaled)).withColumn("part", F.floor((scaled - F.floor(scaled)) * FINE))
    whole, inside, left = _cut(copies, "slice", budget)
    whole2, last, left = _cut(inside, "part", left)
    order = ["finish", "rank", "pass", "key", "doc_id", "tie", "row"]
    run = F.sum("size").over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    last = last.crossJoin(F.broadcast(left)).withColumn("sum", run).filter("sum <= left")
    taken = whole.select("row").unionByName(whole2.select("row")).unionByName(last.select("row"))
    repeats = taken.groupBy("row").agg(F.count("*").alias("repeats"))
    return rows.join(repeats, "row", "left").select("doc_id", "row", "source", "size", "source_size", "target", F.coalesce("repeats", F.lit(0)).alias("repeats"))


def _cut(copies: DataFrame, slice_column: str, budget: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(copies of slices that fit, copies of the slice that the budget cuts, what is left for that slice)."""
    sums = copies.groupBy(slice_column).agg(F.sum("size").alias("n"))
    ahead = sums.select(slice_column, "n", (F.sum("n").over(Window.orderBy(slice_column)) - F.col("n")).alias("ahead")).crossJoin(F.broadcast(budget))  # one row
    ends = materialize(copies.sparkSession, ahead.filter("ahead + n > left").orderBy("ahead").limit(1).select(F.col(slice_column).alias("s"), (F.col("left") - F.col("ahead")).alias("left")), "mixing")
    first = ends.first()
    if first is None:  # everything fits
        return copies, copies.limit(0), ends.select("left")
    return copies.filter(F.col(slice_column) < first.s), copies.filter(F.col(slice_column) == first.s), ends.select("left")


def mixing_report(docs: DataFrame) -> DataFrame:
    """One row for each document: its words, its source's words and target, and the words the mix takes."""
    return mix(docs).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("repeats")).alias("taken"))


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The documents of the mix with their columns as they were, each as often as the mix takes it."""
    row = spare_name(docs, "row_number")
    numbered = materialize(docs.sparkSession, docs.withColumn(row, F.monotonically_increasing_id()), "mixing")
    times = mix(numbered, row=row).filter("repeats > 0").select(F.col("row").alias(row), F.explode(F.sequence(F.lit(1), F.col("repeats").cast("int"))).alias(spare_name(numbered, "copy")))
    return numbered.join(times, row).select(*docs.columns)

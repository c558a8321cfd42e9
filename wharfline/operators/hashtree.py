"""Trees of digests over key ranges, by which two tables are compared from the top.

A key's range is the beginning of its MD5, so both sides have the same ranges, evenly filled. A range's digest is its
number of rows and two sums of 60 bits of their MD5s, which tasks add up for what they read: building a tree
shuffles a row for each range and task, not the rows. A node above has the MD5 of its sixteen children. Where
nodes are alike, nothing below them is looked at; only rows of unlike ranges are read again and joined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wharfline.shared import shared_dir

#: Levels below the root: 16 ** 4 ranges, so tables of nodes are bounded.
DEPTH = 4
FANOUT = 16


def range_of(key: Column | str, depth: int = DEPTH) -> Column:
    """The range of a key as ``depth`` hexadecimal digits; null keys have a range of their own."""
    return F.coalesce(F.substring(F.md5(F.col(key).cast("binary") if isinstance(key, str) else key.cast("binary")), 1, depth), F.lit("-" * depth))


def leaf_digests(rows: DataFrame, key: str = "business_key", row: str | None = None, depth: int = DEPTH) -> DataFrame:
    """node, rows, digest of each range that has rows. row: the text that is compared, the key if there is none."""
    md5 = F.coalesce(F.md5(F.col(row or key).cast("binary")), F.lit("null"))
    bits = lambda at: F.coalesce(F.conv(F.substring(md5, at, 15), 16, 10).cast("decimal(38,0)"), F.lit(1).cast("decimal(38,0)"))
    sums = rows.groupBy(range_of(key, depth).alias("node")).agg(F.count("*").alias("rows"), F.sum(bits(1)).alias("a"), F.sum(bits(16)).alias("b"))
    return sums.select("node", "rows", F.md5(F.concat_ws(":", F.col("rows").cast("string"), F.col("a").cast("string"), F.col("b").cast("string")).cast("binary")).alias("digest"))


def tree(leaves: DataFrame, depth: int = DEPTH) -> DataFrame:
    """level, node, rows, digest from the root (level 0, node '') to the ranges (level ``depth``)."""
    at = leaves.select(F.lit(depth).alias("level"), "node", "rows", "digest")
    found = at
    for level in range(depth - 1, -1, -1):
        child = F.substring("node", level + 1, 1)
        columns = [F.max(F.when(child == d, F.col("digest"))).alias(f"c{d}") for d in "-0123456789abcdef"]
        up = at.groupBy(F.substring("node", 1, level).alias("up")).agg(F.sum("rows").alias("rows"), *columns)
        joined = F.concat_ws(",", *(F.coalesce(F.col(f"c{d}"), F.lit("")) for d in "-0123456789abcdef"))
        at = up.select(F.lit(level).alias("level"), F.col("up").alias("node"), "rows", F.md5(joined.cast("binary")).alias("digest"))
        found = found.unionByName(at)
    return found


def write_tree(rows: DataFrame, path: str, key: str = "business_key", row: str | None = None, depth: int = DEPTH) -> DataFrame:
    """The tree of a table, written and read back; at most 16 ** depth ranges and what stands above."""
    spark = rows.sparkSession
    leaves = leaf_digests(rows, key, row, depth)
    leaves.write.parquet(f"{path}/leaves")
    nodes = tree(spark.read.schema(leaves.schema).parquet(f"{path}/leaves"), depth)
    nodes.write.partitionBy("level").parquet(f"{path}/tree")
    return spark.read.schema(nodes.schema).parquet(f"{path}/tree")


def root(nodes: DataFrame) -> DataFrame:
    """rows, digest of the whole table; two tables have equal roots if they hold the same rows in any order."""
    found = nodes.filter("level = 0").agg(F.coalesce(F.max("rows"), F.lit(0)).alias("rows"), F.coalesce(F.max("digest"), F.lit("empty")).alias("digest"))
    return found


def unlike_ranges(a: DataFrame, b: DataFrame, depth: int = DEPTH) -> DataFrame:
    """node of the ranges that differ between two written trees, found from the root.

    Of a level, only children of unlike nodes are compared; the driver holds those of one level above the ranges at a
    time, 16 ** (depth - 1) names at most.
    """
    parents = None
    for level in range(depth + 1):
        x, y = (t.filter(F.col("level") == level).select("node", F.col("digest").alias(f"d{i}")) for i, t in enumerate((a, b)))
        if parents is not None:
            x, y = (t.filter(F.substring("node", 1, level - 1).isin(parents)) for t in (x, y))
        unlike = x.join(y, "node", "full_outer").filter(~F.col("d0").eqNullSafe(F.col("d1"))).select("node")
        if level < depth:
            parents = [r.node for r in unlike.collect()]
    return unlike


def unlike_rows(rows: DataFrame, ranges: DataFrame, key: str = "business_key", depth: int = DEPTH) -> DataFrame:
    """The rows of some ranges; the filter stands before any shuffle. ``ranges`` has at most 16 ** depth rows."""
    return rows.join(F.broadcast(ranges.select(F.col("node").alias("_range"))), range_of(key, depth) == F.col("_range"), "left_semi")


def store_ranges(rows: DataFrame, path: str, key: str = "business_key", depth: int = DEPTH) -> None:
    """Write a table in folders by the first two digits of the range, sorted by range, so that a few ranges are a few row groups."""
    rows = rows.withColumns({"range_top": F.substring(range_of(key, depth), 1, 2), "range": range_of(key, depth)})
    rows.repartition("range_top").sortWithinPartitions("range_top", "range").write.partitionBy("range_top").parquet(path)


def read_ranges(spark: SparkSession, path: str, ranges: DataFrame) -> DataFrame:
    """Rows of some ranges of a stored table: other folders aren't read."""
    tops = [r.top for r in ranges.select(F.substring("node", 1, 2).alias("top")).distinct().collect()]  # at most 257
    stored = spark.read.parquet(path)
    found = stored.filter(F.col("range_top").cast("string").isin(tops or [""]))
    return found.join(F.broadcast(ranges.select(F.col("node").alias("range"))), "range", "left_semi").drop("range", "range_top")


def differing_keys(source: DataFrame, target: DataFrame, key: str = "business_key", depth: int = DEPTH) -> DataFrame:
    """business_key, diff_type: keys of one side only. Only rows of unlike ranges are joined; null keys equal each other."""
    spark = source.sparkSession
    path = shared_dir(spark, "hash-trees")
    a, b = write_tree(source, f"{path}/a", key, depth=depth), write_tree(target, f"{path}/b", key, depth=depth)
    unlike_ranges(a, b, depth).write.parquet(f"{path}/unlike")
    ranges = spark.read.parquet(f"{path}/unlike")
    a, b = (unlike_rows(t.select(key), ranges, key, depth) for t in (source, target))
    # a key has one row after each side's map-side combine, so no hot key meets the join
    sides = a.select(key, F.lit(1).alias("a"), F.lit(0).alias("b")).unionByName(b.select(key, F.lit(0).alias("a"), F.lit(1).alias("b")))
    one = sides.groupBy(key).agg(F.max("a").alias("a"), F.max("b").alias("b")).filter("a <> b")
    return one.select(key, F.when(F.col("a") == 1, "SOURCE_ONLY").otherwise("TARGET_ONLY").alias("diff_type"))

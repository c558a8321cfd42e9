"""Substring search by an index of trigrams.

Rows are written in blocks of a few, in the order in which they are read; a posting says that a trigram occurs in a
block. A search takes the rarest trigrams of what is looked for, keeps the blocks that hold all of them, reads
those, and verifies. Trigrams are exact (three code points in one number), frequent ones are rows like others, so
no list has to fit a task. Texts of fewer than three characters can't be looked up and are scanned for.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a block, as a power of two; trigrams of a search that are looked up; rows of a page of the table.
BLOCK_BITS, MOST_GRAMS, PAGE_ROWS = 2, 16, 64
#: Blocks that the driver turns into ranges, and ranges that the scan gets. Beyond, blocks are joined.
MOST_BLOCKS, MOST_RANGES = 100_000, 100
#: Characters whose trigrams are made at once.
CHARS = 1 << 20


def trigrams(text: str) -> np.ndarray:
    """The distinct trigrams of a text as numbers: 21 bits for each code point."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    return np.unique((codes[:-2] << 42) | (codes[1:-1] << 21) | codes[2:]) if len(codes) > 2 else np.zeros(0, np.int64)


def _postings(rows: DataFrame, column: str) -> DataFrame:
    """gram, block: repeated where a block lies in two batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blocks, texts, at = batch.column(0).to_pylist(), batch.column(1).to_pylist(), 0
            while at < len(blocks):
                to = at
                found = []
                while to < len(blocks) and blocks[to] == blocks[at]:
                    text = texts[to]
                    # a long text in parts that share two characters
                    found += [trigrams(text[k: k + CHARS + 2]) for k in range(0, max(1, len(text) - 2), CHARS)]
                    to += 1
                grams = np.unique(np.concatenate(found))
                yield pa.RecordBatch.from_arrays([pa.array(grams), pa.array(np.full(len(grams), blocks[at]))], names=["gram", "block"])
                at = to

    return rows.filter(F.col(column).isNotNull()).select("block", column).mapInArrow(run, "gram bigint, block bigint")


def build_index(df: DataFrame, column: str, path: str, block_bits: int = BLOCK_BITS) -> None:
    """Write the rows of ``df`` in blocks and the index of a column below ``path``; rows whose text is null are never found."""
    spark = df.sparkSession
    # neighbouring numbers are neighbouring rows of one task
    rows = df.withColumn("block", F.shiftright(F.monotonically_increasing_id(), block_bits))
    rows.write.option("parquet.page.row.count.limit", PAGE_ROWS).parquet(f"{path}/rows")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    postings = _postings(spark.read.parquet(f"{path}/rows"), column).distinct()
    postings.repartitionByRange(n, "gram", "block").sortWithinPartitions("gram", "block").write.parquet(f"{path}/grams")
    counts = spark.read.parquet(f"{path}/grams").groupBy("gram").agg(F.count("*").alias("blocks"))
    counts.repartitionByRange(n, "gram").sortWithinPartitions("gram").write.parquet(f"{path}/counts")


def _ranges(blocks: list[int]) -> Column:
    """Blocks as ranges that a scan can skip by; the nearest ones are merged until they are few."""
    gaps = sorted(range(1, len(blocks)), key=lambda i: blocks[i - 1] - blocks[i])
    cuts = sorted(i for i in gaps[: MOST_RANGES - 1] if blocks[i] > blocks[i - 1] + 1)
    edges = [0, *cuts, len(blocks)]
    return reduce(Column.__or__, (F.col("block").between(blocks[i], blocks[j - 1]) for i, j in zip(edges, edges[1:], strict=False)))


def candidates(spark: SparkSession, path: str, text: str) -> DataFrame | None:
    """block: those that hold the rarest trigrams of ``text``; None if there are none to look up."""
    grams = trigrams(text).tolist()
    if not grams:
        return None
    counts = spark.read.parquet(f"{path}/counts").filter(F.col("gram").isin(grams)).orderBy("blocks", "gram").limit(len(grams)).collect()
    postings = spark.read.parquet(f"{path}/grams")
    if len(counts) < len(grams):  # one occurs nowhere
        return postings.select("block").limit(0)
    rarest = [r.gram for r in counts[:MOST_GRAMS]]
    return postings.filter(F.col("gram").isin(rarest)).groupBy("block").agg(F.count("*").alias("n")).filter(F.col("n") == len(rarest)).select("block")


def find(spark: SparkSession, path: str, column: str, text: str) -> DataFrame:
    """The rows whose ``column`` contains ``text``, as ``contains`` says it."""
    rows = spark.read.parquet(f"{path}/rows")
    blocks = candidates(spark, path, text)
    if blocks is not None:
        few = [r.block for r in blocks.limit(MOST_BLOCKS + 1).collect()]
        if len(few) > MOST_BLOCKS:
            rows = rows.join(blocks, "block", "left_semi")
        else:
            rows = rows.filter(_ranges(sorted(few))) if few else rows.limit(0)
    return rows.filter(F.col(column).contains(text)).drop("block")

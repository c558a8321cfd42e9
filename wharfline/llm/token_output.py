"""Token ids of documents as Parquet files with list columns.

Files follow the order of ``doc_id`` and are sorted inside, so that the page indexes of ``doc_id`` and
``token_start`` let a reader fetch a few documents or only their metadata. Ids are dictionary-encoded and bit
packed; sorted numbers are delta-encoded (version 2 of the format). Row groups and pages have a set size.

Cases: a null text is empty and gives the end id alone; equal or null ids keep rows of their own, nulls first,
ties in the order of a hash of their text; an empty table gives no rows; other columns are ignored unless
named in ``metadata``.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wharfline.llm.packing import in_order
from wharfline.llm.tokens import END_ID, WordEncoder, encoder, vocabulary_path
from wharfline.shared import shared_dir

#: Options of the Parquet writer.
LAYOUT = {
    "compression": "zstd",
    "parquet.writer.version": "v2",
    "parquet.enable.dictionary": "true",
    "parquet.block.size": str(32 << 20),
    "parquet.page.size": str(256 << 10),
    "parquet.page.row.count.limit": "2000",
}
#: Documents of a batch that goes back to Spark, and tokens after which it ends.
ROWS_A_BATCH, TOKENS_A_BATCH = 512, 1 << 20


def encode_documents(docs: DataFrame, vocabulary: str | None = None, partitions: int | None = None, metadata: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, ids (with the end id), their number, and the place in the part: part, and ids before it there."""
    path = vocabulary or vocabulary_path("word_bpe_49k.json")
    end = END_ID.to_bytes(4, "little")
    rows = in_order(docs, *metadata, partitions=partitions)
    kinds = [f for f in rows.schema.fields if f.name in metadata]
    out = T.StructType([T.StructField("doc_id", T.LongType()), *kinds, T.StructField("part", T.IntegerType()), T.StructField("token_start", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("token_ids", T.ArrayType(T.IntegerType(), False))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, part, before = encoder(WordEncoder, path), TaskContext.get().partitionId(), 0

        def made(batch: pa.RecordBatch, ids: list[bytes]) -> pa.RecordBatch:
            nonlocal before
            counts = np.fromiter((len(x) // 4 for x in ids), np.int64, len(ids))
            ends = np.cumsum(counts)
            flat = pa.Array.from_buffers(pa.int32(), int(ends[-1]), [None, pa.py_buffer(b"".join(ids))])
            lists = pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)), flat)
            starts, before = ends - counts + before, before + int(ends[-1])
            return pa.RecordBatch.from_arrays([batch.column(0), *batch.columns[2:], pa.array(np.full(len(ids), part, np.int32)), pa.array(starts), pa.array(counts), lists], names=out.names)

        for batch in batches:
            ids, at, held = [], 0, 0
            for n, text in enumerate(batch.column(1), 1):
                ids.append(coder.encode(text.as_py()) + end)
                held += len(ids[-1]) // 4
                if held >= TOKENS_A_BATCH or n - at >= ROWS_A_BATCH or n == batch.num_rows:
                    yield made(batch.slice(at, n - at), ids)
                    ids, at, held = [], n, 0

    return rows.mapInArrow(run, out)


def write_tokens(docs: DataFrame, path: str, **options) -> None:
    """Write one file for each range of doc_id."""
    encode_documents(docs, **options).write.options(**LAYOUT).parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """The files' rows with ``start``, the ids of all documents before each. Unused columns aren't read."""
    rows = spark.read.parquet(path)
    sizes = rows.groupBy("part").agg(F.sum("n_tokens").alias("size"))
    # one row for each file
    before = sizes.select(F.col("part"), (F.sum("size").over(Window.orderBy("part")) - F.col("size")).alias("before"))
    return rows.join(before, "part").withColumn("start", F.col("token_start") + F.col("before")).drop("before", "token_start", "part")


def checksums(rows: DataFrame, column: str = "token_ids") -> DataFrame:
    """Replace the list column by the CRC-32 of its ids as little-endian unsigned 32-bit integers."""
    keep = [f for f in rows.schema.fields if f.name != column]
    out = T.StructType([*keep, T.StructField("ids_crc32", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(column)
            ids, at = lists.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False), lists.offsets.to_numpy()
            sums = [zlib.crc32(ids[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in keep), pa.array(sums, pa.int64())], names=out.names)

    return rows.select(*(f.name for f in keep), column).mapInArrow(run, out)


def token_digests(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Write the files, read them back, one row for each document."""
    path = shared_dir(spark, "token-files")
    write_tokens(docs, path)
    back = spark.read.parquet(path)
    sums = checksums(back.select("doc_id", "part", "token_start", "n_tokens", "token_ids"))
    sizes = back.groupBy("part").agg(F.sum("n_tokens").alias("size"))
    before = sizes.select("part", (F.sum("size").over(Window.orderBy("part")) - F.col("size")).alias("before"))
    return sums.join(before, "part").select("doc_id", (F.col("token_start") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")

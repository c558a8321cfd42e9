"""Approximate nearest neighbours by a permutation index.

A vector is represented by its ``prefix`` nearest pivots in order. A block of the index posts each vector, with
the place, in the inverted files of those pivots only. A query reads the files of its own nearest pivots, which
hold a share of prefix / pivots of the block each, and adds up what the footrule distance of two truncated
orders (absent pivots count as behind all others) loses by each shared pivot. The nearest ``rerank`` share of
the block is reranked by exact cosine in double precision.

Pivots are a bounded sample of distinct vectors (``pivots`` of them); every vector is indexed. Queries and
index meet in blocks, each pair of blocks in a task of its own, which returns a few rows for each query.
Equal vectors are one node with as many of the smallest ids as a result can hold.

Cases: null vectors, zero vectors and those with null or non-finite components take no part, nor do vectors
without an id or of another length than the most common one; equal ids are candidates of their own; a query
with fewer candidates than ``k`` gets all of them; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wharfline.llm.workdir import materialize

PIVOTS, PREFIX = 256, 48
MOST_PIVOTS = 256
#: Share of a block that is reranked, the same at every size of a table.
RERANK = 0.2
#: Vectors of a block of the index, and queries of a block.
BLOCK_ROWS, QUERY_BLOCK = 16_384, 4096
#: Bytes of vectors of a block, which long ones reach with fewer rows.
BLOCK_BYTES = 64 << 20
SALTS = 32


def usable(rows: DataFrame, id_column: str, vector: str) -> DataFrame:
    """vec_id and the vector ``v`` in double precision, of the vectors that can take part."""
    v = F.transform(F.col(vector), lambda x: x.cast("double"))
    rows = rows.select(F.col(id_column).alias("vec_id"), v.alias("v")).filter("vec_id IS NOT NULL AND v IS NOT NULL AND size(v) > 0")
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.filter(fine & F.exists("v", lambda x: x != 0))


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)  # squares of large numbers stay finite
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def nearest_pivots(vectors: np.ndarray, pivots: np.ndarray, prefix: int) -> np.ndarray:
    """For each vector the numbers of its nearest pivots, nearest first (256 pivots at most)."""
    return np.argsort(-(vectors @ pivots.T), 1, kind="stable")[:, :prefix].astype(np.uint8)


def build_index(nodes: DataFrame, pivots: np.ndarray, prefix: int = PREFIX) -> DataFrame:
    """``nodes`` with its unit vector and its nearest pivots as bytes."""
    table = nodes.sparkSession.sparkContext.broadcast(pivots)  # 256 rows at most
    others = [c for c in nodes.columns if c != "v"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2048):
                batch = whole.slice(at, 2048)
                lists = batch.column("v")
                x = unit(lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1))
                order = nearest_pivots(x, table.value, prefix)
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in others), pa.array([r.tobytes() for r in x], pa.binary()), pa.array([r.tobytes() for r in order], pa.binary())], names=[*others, "unit", "order"])

    return nodes.mapInArrow(run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in nodes.schema if f.name != "v") + ", unit binary, order binary")


class Files:
    """The inverted files of a block: for each pivot the rows that it is near to, and its places there."""

    def __init__(self, order: np.ndarray):
        n, self.prefix = order.shape
        pivot = order.ravel()
        by_pivot = np.argsort(pivot, kind="stable")
        self.rows, self.places = by_pivot // self.prefix, (by_pivot % self.prefix).astype(np.int32)
        self.ends = np.append(0, np.cumsum(np.bincount(pivot, minlength=256)))
        self.n = n

    def shared(self, own: np.ndarray) -> np.ndarray:
        """By how much the footrule distance to each row is less than that of orders without a common pivot, halved."""
        out = np.zeros(self.n, np.int32)
        for place, pivot in enumerate(own.tolist()):  # Python's numbers, since a byte can't count on from 255
            at = slice(self.ends[pivot], self.ends[pivot + 1])
            out[self.rows[at]] += self.prefix - np.maximum(self.places[at], place)  # a row is in a file once
        return out


def block_search(query_order: np.ndarray, queries: np.ndarray, files: Files, vectors: np.ndarray, ties: np.ndarray, k: int, rerank: float) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each query its k best rows of the block and their cosines."""
    keep = max(k, int(np.ceil(rerank * files.n)))
    for i, own in enumerate(query_order):
        near = np.argpartition(-files.shared(own), keep - 1)[:keep] if keep < files.n else np.arange(files.n)
        cosine = np.einsum("ij,j->i", vectors[near], queries[i])
        best = np.lexsort((ties[near], -cosine))[:k]
        yield i, near[best], cosine[best]


def search(rows: DataFrame, queries_where: str, k: int = 5, id_column: str = "vec_id", vector: str = "embedding", pivots: int = PIVOTS, prefix: int = PREFIX, rerank: float = RERANK, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest found of the other rows, for each row that ``queries_where`` names (of ``vec_id``)."""
    if not 1 <= pivots <= MOST_PIVOTS:
        raise ValueError(f"pivots are numbered by a byte: {MOST_PIVOTS} at most")
    spark = rows.sparkSession
    # two hashes of the vector, so that unlike vectors don't become one node
    vectors = materialize(spark, usable(rows, id_column, vector).withColumn("node", F.concat(F.hex(F.xxhash64("v")), F.lit("-"), F.hex(F.xxhash64(F.lit(1), "v")))), "ann")
    common = vectors.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    if common is None:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    vectors = vectors.filter(F.size("v") == common.n)
    # equal vectors are one node, with the smallest ids that one result can need (k, and the query's own)
    few = lambda *keys: F.row_number().over(Window.partitionBy(*keys).orderBy("vec_id")) <= k + 1
    salted = vectors.select("node", "vec_id", F.pmod(F.hash("vec_id"), F.lit(SALTS)).alias("salt"))
    members = salted.withColumn("few", few("node", "salt")).filter("few").withColumn("few", few("node")).filter("few").select("node", "vec_id")
    members = materialize(spark, members, "ann")
    nodes = materialize(spark, vectors.groupBy("node").agg(F.first("v").alias("v"), F.min("vec_id").alias("least"), F.max(F.expr(queries_where)).alias("asked")), "ann")
    n = nodes.count()
    sample = nodes.orderBy(F.xxhash64("node", F.lit(7)), "node").limit(pivots).select("v").toPandas()
    index = materialize(spark, build_index(nodes, unit(np.array(sample["v"].tolist())), prefix), "ann")
    block_rows = max(1, min(block_rows, BLOCK_BYTES // (8 * common.n)))
    blocks, parts = max(1, -(-n // block_rows)), max(1, -(-index.filter("asked").count() // QUERY_BLOCK))
    spread = lambda column, count: F.pmod(F.xxhash64(column, F.lit(3)), F.lit(count)).cast("int")
    each = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    left = index.filter("asked").select("node", "unit", "order", spread("node", parts).alias("part"), each(blocks).alias("block"))
    right = index.select("node", "least", "unit", "order", spread("node", blocks).alias("block"), each(parts).alias("part"))

    def meet(q, x):
        import pandas as pd

        out = []
        if len(q) and len(x):
            stack = lambda column, kind: np.frombuffer(b"".join(column), kind).reshape(len(column), -1)
            nodes, asked = x["node"].to_numpy(), q["node"].to_numpy()
            files = Files(stack(x["order"], np.uint8))
            for i, at, cosine in block_search(stack(q["order"], np.uint8), stack(q["unit"], float), files, stack(x["unit"], float), x["least"].to_numpy(), k + 1, rerank):
                out.append(pd.DataFrame({"query_node": asked[i], "node": nodes[at], "score": cosine}))
        return pd.concat(out) if out else pd.DataFrame({"query_node": np.empty(0, object), "node": np.empty(0, object), "score": np.empty(0)})

    found = left.groupBy("part", "block").cogroup(right.groupBy("part", "block")).applyInPandas(meet, "query_node string, node string, score double")
    asked = vectors.filter(F.expr(queries_where)).select(F.col("vec_id").alias("query_id"), F.col("node").alias("query_node"))
    least = members.groupBy("node").agg(F.min("vec_id").alias("least"))
    top = Window.partitionBy("query_node").orderBy(F.desc("score"), "least", "node")
    best = found.join(least, "node").withColumn("n", F.row_number().over(top)).filter(F.col("n") <= k + 1).select("query_node", "node", "score")
    results = asked.join(best, "query_node").join(members, "node").filter("vec_id != query_id")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return results.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def ann_report(rows: DataFrame) -> DataFrame:
    """The five nearest found for each vector whose id is divisible by 50."""
    return search(rows, "vec_id % 50 = 0")

"""Places in a sorted table, without sorting a group in one task."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wharfline.shared import shared_dir

#: Bytes of sorted texts that are handed on together to the task that hashes their group.
BLOCK = 16_384


def number_sorted(rows: DataFrame, group: list[str], order: list[str], into: str | None = None) -> DataFrame:
    """``rows`` with ``place``, from 0 in the order of ``order`` in each group, and ``group_size``; nulls come first.

    One range sort is written; a row's place is that in its part and the rows of its group in the parts before, of which
    there is one row for each part and group. into: the folder for it, for callers that remove it.
    """
    spark = rows.sparkSession
    path, n = into or shared_dir(spark, "sorted"), int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = rows.repartitionByRange(n, *group, *order).sortWithinPartitions(*group, *order)
    ranged.select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_at")).write.parquet(f"{path}/rows")
    rows = spark.read.parquet(f"{path}/rows")
    of = [F.col(c).alias(f"_of_{c}") for c in group]
    whole = Window.partitionBy(*(f"_of_{c}" for c in group))
    runs = rows.groupBy(F.col("_part").alias("_in"), *of).agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    runs = runs.withColumns({"_before": F.sum("_n").over(whole.orderBy("_in")) - F.col("_n"), "group_size": F.sum("_n").over(whole)})
    same = F.col("_part") == F.col("_in")
    for c in group:
        same &= F.col(c).eqNullSafe(F.col(f"_of_{c}"))
    # the rows of a group are in many parts, so no key of this join is hot
    return rows.join(runs, same).select(*(c for c in rows.columns if c not in ("_part", "_at")), (F.col("_before") + F.col("_at") - F.col("_first")).alias("place"), "group_size")


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted texts (the last column), a newline after each, in blocks of one group; blocks of a task are numbered."""
    n = 0
    for batch in batches:
        names = [repr(x) for x in zip(*(c.to_pylist() for c in batch.columns[:-1]), strict=True)]
        starts, blocks, size = [], [], 0
        for i, text in enumerate(batch.columns[-1].to_pylist()):
            if not i or names[i] != names[i - 1] or size >= BLOCK:
                starts.append(i)
                blocks.append([])
                size = 0
            if text is not None:
                blocks[-1].append(text)
                size += len(text) + 1
        texts = pa.array([b"\n".join([*b, b""]) if b else None for b in blocks], pa.binary())
        numbers = pa.array(range(n, n + len(starts)), pa.int64())
        n += len(starts)
        yield pa.RecordBatch.from_arrays([*batch.take(pa.array(starts, pa.int64())).columns[:-1], numbers, texts], names=[*batch.schema.names[:-1], "block", "text"])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The MD5 of each group's blocks (the last column); groups follow one another. A group whose texts are all null has none."""
    name = going = digest = None

    def rows(ended: pa.Table, hashes: list) -> Iterator[pa.RecordBatch]:
        return iter(ended.append_column("hash", pa.array(hashes, pa.string())).combine_chunks().to_batches())

    for batch in batches:
        keys = pa.Table.from_batches([batch]).drop_columns(batch.schema.names[-1])
        starts, hashes = [], []
        for i, (now, text) in enumerate(zip(map(repr, zip(*(c.to_pylist() for c in keys.columns), strict=True)), batch.columns[-1].to_pylist(), strict=True)):
            if now != name:
                if name is not None:
                    hashes.append(digest and digest.hexdigest())
                starts.append(i)
                name, digest = now, None
            if text is not None:
                digest = digest or hashlib.md5(usedforsecurity=False)
                digest.update(text)
        begun = keys.take(pa.array(starts, pa.int64()))
        begun = pa.concat_tables([going, begun]) if going else begun
        going = begun.slice(len(hashes))
        if hashes:
            yield from rows(begun.slice(0, len(hashes)), hashes)
    if going:
        yield from rows(going, [digest and digest.hexdigest()])


def ordered_md5(rows: DataFrame, by: tuple[str, ...] = (), run: int | None = None) -> DataFrame:
    """``hash``: the MD5 of the sorted texts ``row``, a newline after each, over all or for each value of ``by``; any number of rows.

    One range sort, by many tasks. An MD5 has to be taken in order, so a group's sorted texts then go through one task, as a stream of
    blocks. No rows at all have no hash, unless ``by`` is empty: then it's that of no bytes. run: the digest of a tree instead, see ``tree_md5``.
    """
    if run is not None:
        return tree_md5(rows, by, run)
    spark = rows.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # a column that is always there, as columns of Arrow say how many rows there are
    keys = ["_all", *by]
    texts = rows.select(F.lit(0).alias("_all"), *by, F.col("row").cast("binary").alias("row"))
    ranged = texts.repartitionByRange(n, *keys, "row").sortWithinPartitions(*keys, "row").select(*keys, F.spark_partition_id().alias("part"), "row")
    of = [ranged.schema[c] for c in keys]
    kinds = T.StructType([*of, T.StructField("part", T.IntegerType()), T.StructField("block", T.LongType()), T.StructField("text", T.BinaryType())])
    blocks = ranged.mapInArrow(_blocks, kinds).repartition(n, *keys).sortWithinPartitions(*keys, "part", "block").select(*keys, "text")
    found = blocks.mapInArrow(_digests, T.StructType([*of, T.StructField("hash", T.StringType())])).drop("_all")
    return found if by else found.agg(F.coalesce(F.max("hash"), F.md5(F.lit("").cast("binary"))).alias("hash"))


def tree_md5(rows: DataFrame, by: tuple[str, ...], run: int) -> DataFrame:
    """``hash`` of the sorted texts ``row`` as a tree, so that no task reads a whole group.

    The MD5 of each run of ``run`` texts, a newline after each, is a text of the level above, and so on until a group
    has one. A group of one run has the plain MD5 of its texts. No rows at all have no hash, unless ``by`` is empty:
    then it's that of no bytes.
    """
    spark = rows.sparkSession
    path = shared_dir(spark, "ordered")
    keys = list(by)
    level = number_sorted(rows.select(*keys, "row"), keys, ["row"], f"{path}/0").withColumnRenamed("group_size", "size")
    most = level.agg(F.coalesce(F.max("size"), F.lit(0)).alias("most")).first().most
    done = []
    while True:
        # a run is bounded, whatever the group
        texts = F.expr("listagg(row, '\\n') WITHIN GROUP (ORDER BY place)")
        level = level.groupBy(*keys, F.floor(F.col("place") / run).alias("place"), "size").agg(F.md5(F.concat(texts, F.lit("\n")).cast("binary")).alias("row"))
        level = level.withColumn("size", F.ceil(F.col("size") / run))
        level.write.parquet(f"{path}/{len(done) + 1}")
        level = spark.read.schema(level.schema).parquet(f"{path}/{len(done) + 1}")
        done.append(level.filter("size = 1").select(*keys, F.col("row").alias("hash")))
        most = -(-most // run)
        if most <= 1:
            break
        level = level.filter("size > 1")
    found = done[0]
    for more in done[1:]:
        found = found.unionByName(more)
    return found if keys else found.agg(F.coalesce(F.max("hash"), F.md5(F.lit("").cast("binary"))).alias("hash"))

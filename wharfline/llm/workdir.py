"""Intermediate tables of the corpus operators."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from wharfline.shared import remove, shared_dir


@contextmanager
def freed_shuffles(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of a statement go as soon as its table is written, not when the driver collects garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def materialize(spark: SparkSession, df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: cuts lineage, survives lost executors."""
    return _written(spark, df, shared_dir(spark, name), **options)


def _written(spark: SparkSession, df: DataFrame, path: str, **options: str) -> DataFrame:
    with freed_shuffles(spark):
        df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Scratch:
    """Tables that go when the block ends; what the block returns must have been written elsewhere."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.path, self.count = spark, shared_dir(spark, name), 0

    def table(self, df: DataFrame, **options: str) -> DataFrame:
        self.count += 1
        return _written(self.spark, df, f"{self.path}/{self.count}", **options)

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_: object) -> None:
        remove(self.spark, self.path)


def spare_name(df: DataFrame, name: str) -> str:
    """``name``, or a longer one that is no column of ``df``."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))

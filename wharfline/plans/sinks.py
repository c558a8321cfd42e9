"""Writers: partitioned tables, exports, dead letters."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wharfline.functions.text import format_params, partition_key, truncate
from wharfline.operators.filters import assert_max_rows
from wharfline.operators.keyed import merge_insert_new

KEYS = ["business_key", "batch_date", "partition_key"]


def append_partitioned(df: DataFrame, path: str, by: tuple[str, ...] = ("partition_key", "batch_date")) -> None:
    """Append to a table in folders by partition; a task holds few partitions, so few files are made."""
    df.repartition(*by).write.mode("append").partitionBy(*by).parquet(path)


def read_partitioned(spark: SparkSession, path: str, schema) -> DataFrame:
    """The table, or no rows if it isn't there yet; keys in folder names stay strings."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], schema)


#: Partitions of a batch that are named to the scan of the target; a batch of more reads them all.
MOST_PARTITIONS = 1000


def of_partitions(target: DataFrame, updates: DataFrame, by: tuple[str, ...] = ("partition_key", "batch_date")) -> DataFrame:
    """The partitions of ``target`` that ``updates`` has rows of: keys of the others can't be there, so they aren't read."""
    here = updates.select(*by).distinct().limit(MOST_PARTITIONS + 1).collect()
    if len(here) > MOST_PARTITIONS:
        return target
    for c in by:
        target = target.filter(F.col(c).isin(sorted({r[c] for r in here if r[c] is not None})))
    return target


def merge_into(spark: SparkSession, path: str, updates: DataFrame, order: list[Column | str]) -> DataFrame:
    """Append the updates whose keys are new; done again, it adds nothing. One writer at a time. Returns what was added."""
    target = of_partitions(read_partitioned(spark, path, updates.schema), updates)
    new = merge_insert_new(target, updates, KEYS, order)
    append_partitioned(new, path)
    return new


def overwrite_partitions(df: DataFrame, path: str, by: tuple[str, ...] = ("partition_key", "batch_date")) -> None:
    """Replace only the partitions that ``df`` has rows of."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def copy_batch(legacy: DataFrame, target: DataFrame, batch_date: str, as_of: Column) -> DataFrame:
    """Rows of one date to append to the partitioned table, with their partition key."""
    rows = legacy.filter(F.col("batch_date") == batch_date).withColumn("partition_key", partition_key("batch_date", as_of))
    return merge_insert_new(target, rows, KEYS, ["id"])


def export_csv(df: DataFrame, path: str, quote_all: bool = False, plain: bool = False, compression: str | None = None) -> None:
    """CSV with a header in each file. plain: no quoting at all, as consumers expect that split at each comma."""
    options = {"compression": compression} if compression else {}
    if plain:
        cells = F.concat_ws(",", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in df.columns))
        # one column, whose name is the header line, with a separator that no text holds
        blanks = {"ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False, "emptyValue": ""}
        df.select(cells.alias(",".join(df.columns))).write.options(header=True, sep="\u0001", escapeQuotes=False, **blanks, **options).csv(path)
    else:
        df.write.options(header=True, nullValue="", emptyValue="", quoteAll=quote_all, **options).csv(path)


def export_json(df: DataFrame, path: str, max_rows: int | None = 500_000, compression: str | None = None) -> None:
    """One JSON array of objects in each file; more rows than allowed are an error before anything is written."""
    rows = assert_max_rows(df, max_rows) if max_rows is not None else df

    def arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mark = "["
        for batch in batches:
            if batch.num_rows:
                lines = [mark + batch.column(0)[0].as_py(), *("," + x.as_py() for x in batch.column(0)[1:])]
                mark = ","
                yield pa.RecordBatch.from_arrays([pa.array(lines, pa.string())], names=["value"])
        yield pa.RecordBatch.from_arrays([pa.array(["]" if mark == "," else "[]"])], names=["value"])

    objects = rows.select(F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}).alias("value"))
    objects.mapInArrow(arrays, "value string").write.options(**({"compression": compression} if compression else {})).text(path)


def export_name(batch_date: Column | str, extension: str) -> Column:
    return F.concat(F.lit("file_export_"), F.col(batch_date) if isinstance(batch_date, str) else batch_date, F.lit(f".{extension}"))


def dlq_rows(bad: DataFrame, job: str, origin: tuple[str, ...] = ()) -> DataFrame:
    """Rejected rows as dead letters: parameters, error of 1000 characters at most, code, flags."""
    params = format_params(("businessKey", "business_key"), ("batchDate", "batch_date"), ("name", "name"), ("description", "description"))
    return bad.select(*origin, F.lit(job).alias("job_name"), params.alias("params"), truncate("error", 1000).alias("error_message"), F.lit("RECORD_WRITE_FAILED").alias("error_code"), F.lit(True).alias("retryable"), F.lit(False).alias("manual_required"), F.lit(False).alias("handled"), F.lit(0).alias("replay_count"))


#: Folders of dead letters, by a hash of their first origin column.
DLQ_PARTS = 256


def write_dlq(bad: DataFrame, path: str, job: str, origin: tuple[str, ...] = ()) -> None:
    """Append dead letters. origin: columns that say where a row comes from; rows of a known origin aren't written again.

    Such rows are stored by a hash of the first of these columns, so that a batch of few files is compared with the dead
    letters of a few folders only.
    """
    rows = dlq_rows(bad, job, origin)
    if not origin:
        rows.write.mode("append").parquet(path)
        return
    rows = rows.withColumn("origin_part", F.pmod(F.xxhash64(origin[0]), F.lit(DLQ_PARTS)).cast("int"))
    known = of_partitions(read_partitioned(rows.sparkSession, path, rows.schema), rows, ("origin_part",)).select(*origin, "origin_part")
    append_partitioned(rows.join(known, [*origin, "origin_part"], "left_anti"), path, ("origin_part",))

"""Line files: delimited, fixed width, header-driven, positional.

Lines carry their number in the file. Files are read by splits; a split's lines are numbered inside it and
moved by the lines of the splits before it in the file, so a file of any size is read by many tasks.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wharfline.functions.text import has_text, jtrim
from wharfline.shared import shared_dir


@dataclass(frozen=True)
class Parsed:
    """Good and bad rows, and, where one plan has both, all rows with their ``error``."""

    good: DataFrame
    bad: DataFrame
    rows: DataFrame | None = None


#: Splits whose offsets are broadcast; a broadcast row takes some 64 bytes. More are joined by a shuffle.
MOST_SPLITS = 1_000_000


def numbered_lines(spark: SparkSession, paths: str | list[str], into: str | None = None, line_end: str | None = None) -> DataFrame:
    """file, line_no (from 1) and line. Lines are not shuffled.

    How files are split depends on the cores that are there at the moment, so one scan writes lines and their splits
    to a table of the shared folder, and both the index of splits and the numbers come from that table. A line without
    an entry in the index is an error. into: where the two tables go, for callers that remove them.
    line_end: what ends a line, if not any of the usual ends.
    """
    path = into or shared_dir(spark, "lines")
    reader = spark.read if line_end is None else spark.read.option("lineSep", line_end)
    rows = reader.text(paths).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("at"), F.col("value").alias("line")
    )
    rows.write.parquet(f"{path}/rows")
    rows = spark.read.schema(rows.schema).parquet(f"{path}/rows").withColumn("of", F.xxhash64("file")).withColumn("task", F.shiftright("at", 33))
    write_split_index(rows, f"{path}/index")
    return number(rows, spark.read.parquet(f"{path}/index"))


def write_split_index(rows: DataFrame, path: str) -> None:
    """For each split of a file, known by the file's hash, its start and the task that read it: its first row and the lines before it."""
    sizes = rows.groupBy("of", "split", "task").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    before = F.sum("n").over(Window.partitionBy("of").orderBy("split", "first")) - F.col("n")
    sizes.select("of", "split", "task", "first", before.alias("before")).write.parquet(path)


def number(rows: DataFrame, index: DataFrame) -> DataFrame:
    """Lines with the number that the index of splits gives them."""
    index = F.broadcast(index) if index.count() <= MOST_SPLITS else index
    known = F.coalesce("before", F.raise_error(F.concat(F.lit("a split without an offset: "), F.col("file"))).cast("bigint"))
    return rows.join(index, ["of", "split", "task"], "left").select("file", (known + F.col("at") - F.col("first") + 1).alias("line_no"), "line")


def _split_good(rows: DataFrame, error: Column) -> Parsed:
    marked = rows.withColumn("error", error)
    return Parsed(marked.filter("error IS NULL").drop("error", "line"), marked.filter("error IS NOT NULL").select("file", "line_no", "line", "error"), marked)


def _record(raw_id: Column, name: Column, description: Column) -> list[Column]:
    trimmed = jtrim(raw_id)
    return [trimmed.alias("raw_id"), F.when(trimmed.rlike(r"^[+-]?[0-9]+$"), trimmed.try_cast("bigint")).alias("id"), name.alias("name"), description.alias("description")]


def _id_error() -> Column:
    """Ids that are there but aren't whole numbers."""
    return F.when(has_text("raw_id") & F.col("id").isNull(), F.concat(F.lit("not a number: "), F.col("raw_id")))


def parse_delimited(lines: DataFrame, delimiter: str = ",") -> Parsed:
    """id, name, description by position; the delimiter is a regular expression; line 1 is skipped."""
    cells = F.split("line", delimiter, -1)
    cell = lambda i: jtrim(F.get(cells, F.lit(i)))
    rows = lines.filter("line_no > 1").select("file", "line_no", "line", *_record(cell(0), cell(1), cell(2)))
    return _drop_raw(_split_good(rows, _id_error()))


def _drop_raw(parsed: Parsed) -> Parsed:
    return Parsed(parsed.good.drop("raw_id"), parsed.bad, parsed.rows.drop("raw_id"))


def read_delimited(spark: SparkSession, paths: str | list[str], delimiter: str = ",") -> Parsed:
    return parse_delimited(numbered_lines(spark, paths), delimiter)


def parse_fixed_width(lines: DataFrame, layout: tuple[tuple[int, int | None], ...] = ((0, 10), (10, 40), (40, None))) -> Parsed:
    """id, name, description by columns [from, to); short lines give empty cells; line 1 is skipped."""
    cell = lambda a, b: jtrim(F.substring("line", a + 1, (b or 1 << 30) - a))
    rows = lines.filter("line_no > 1").select("file", "line_no", "line", *_record(*(cell(a, b) for a, b in layout)))
    return _drop_raw(_split_good(rows, _id_error()))


def read_fixed_width(spark: SparkSession, paths: str | list[str], **options) -> Parsed:
    return parse_fixed_width(numbered_lines(spark, paths), **options)


@dataclass(frozen=True)
class Feed:
    """A header-driven format."""

    feed_id: str
    delimiter: str = ","
    business_key_fields: tuple[str, ...] = ()


def parse_feed(lines: DataFrame, feed: Feed) -> DataFrame:
    """file, line_no and raw: values by the names in the file's first line.

    The delimiter is literal, header names are trimmed, values aren't; missing values at the end are null,
    further ones are dropped.
    """
    literal = "".join("\\" + c if not c.isalnum() and ord(c) < 128 else c for c in feed.delimiter)
    headers = lines.filter("line_no = 1").select("file", F.transform(F.split("line", literal, -1), lambda c: jtrim(c)).alias("names"))
    rows = lines.filter("line_no > 1").join(headers, "file").withColumn("cells", F.split("line", literal, -1))
    value = F.transform("names", lambda _, i: F.get(F.col("cells"), i))
    return rows.select("file", "line_no", F.map_from_arrays("names", value).alias("raw"))


def read_feed(spark: SparkSession, paths: str | list[str], feed: Feed) -> DataFrame:
    return parse_feed(numbered_lines(spark, paths), feed)


def normalize_lines(lines: DataFrame) -> DataFrame:
    """Trimmed, in upper case, without blank lines."""
    return lines.select("file", "line_no", F.upper(jtrim("line")).alias("line")).filter(F.col("line") != "")


def load_positional(lines: DataFrame, source: Column) -> DataFrame:
    """Files without a header: key, name, description; the key is ``source:ordinal`` where blank, the name the key."""
    cells = F.split("line", ",", 3)
    cell = lambda i: F.nullif(jtrim(F.get(cells, F.lit(i))), F.lit(""))
    key = F.coalesce(cell(0), F.concat_ws(":", source, F.col("line_no").cast("string")))
    return lines.filter(has_text("line")).select("file", "line_no", key.alias("business_key"), F.coalesce(cell(1), key).alias("name"), cell(2).alias("description"), F.sha2(F.col("line").cast("binary"), 256).alias("checksum"))


def shard(df: DataFrame, index: int, total: int, mode: str = "line") -> DataFrame:
    """The rows of one shard: by physical line (the header is line 1) or by ordinal of the record."""
    column = {"line": "line_no", "doc": "ordinal"}[mode]
    return df.filter(F.pmod(F.col(column) - 1, F.lit(total)) == index)


_LINE_FORMATS: dict[str, Callable[[DataFrame], Parsed]] = {"DELIMITED": parse_delimited, "FIXED": parse_fixed_width}


def register_format(name: str, parse: Callable[[DataFrame], Parsed]) -> None:
    """Add a format of line files: numbered lines in, good and bad rows out."""
    _LINE_FORMATS[name.upper()] = parse


def read_lines(spark: SparkSession, paths: str | list[str], kind: str) -> Parsed:
    return _LINE_FORMATS[kind.upper()](numbered_lines(spark, paths))

"""JSON documents that are one array, read by as many tasks as the file has splits.

Text is read in fragments that end at closing braces. Whether a brace is structure depends on all the quotes and brackets
before it; these are summed up in two levels, inside each split and over the few splits of a file. The array is cut after
each brace that closes one of its elements, and pieces are parsed on their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F

from wharfline.shared import shared_dir

RECORD = "id bigint, name string, description string"
#: Splits whose offsets are broadcast, some 100 bytes each. More are joined by a shuffle.
MOST_SPLITS = 1_000_000
_SPLIT = ["file", "split", "task"]


def _brackets(text: Column) -> Column:
    """Opening less closing brackets of text that begins outside strings."""
    bare = F.regexp_replace(text, r'"[^"]*(?:"|\z)', "")
    return F.regexp_count(bare, F.lit(r"[\[{]")) - F.regexp_count(bare, F.lit(r"[\]}]"))


def _fragments(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Fragments without their closing brace, with their quotes and brackets, written once, so that splits stay as they are.

    level0 and level1: brackets if the fragment begins outside or inside a string.
    """
    plain = F.regexp_replace("value", r"(?s)\\.", "")
    rows = spark.read.option("lineSep", "}").text(paths).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("at"), "value",
        F.regexp_count(plain, F.lit('"')).cast("bigint").alias("quotes"), _brackets(plain).alias("level0"), _brackets(F.concat(F.lit('"'), plain)).alias("level1"),
    )
    path = shared_dir(spark, "fragments")
    rows.write.parquet(path)
    return spark.read.schema(rows.schema).parquet(path).withColumn("task", F.shiftright("at", 33))


def _in_split() -> WindowSpec:
    return Window.partitionBy(*_SPLIT).orderBy("at")


def _inside_splits(rows: DataFrame) -> DataFrame:
    """Sums inside a split: quotes before a fragment, and levels after its brace if the split begins outside or inside a string."""
    rows = rows.withColumn("quotes_before", F.coalesce(F.sum("quotes").over(_in_split().rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    for start in (0, 1):
        inside = (F.col("quotes_before") + start) % 2 == 1
        closes = (F.col("quotes_before") + F.col("quotes") + start) % 2 == 0
        change = F.when(inside, F.col("level1")).otherwise(F.col("level0")) - closes.cast("int")
        rows = rows.withColumn(f"change{start}", change).withColumn(f"after{start}", F.sum(f"change{start}").over(_in_split()))
    return rows


def _split_index(rows: DataFrame) -> DataFrame:
    """For each split what is before it in the file: whether it begins inside a string, and at which level."""
    sizes = rows.groupBy(*_SPLIT).agg(F.min("at").alias("first"), F.max("at").alias("last"), F.sum("quotes").alias("quotes"), F.max_by("after0", "at").alias("after0"), F.max_by("after1", "at").alias("after1"))
    order = Window.partitionBy("file").orderBy("split", "first")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("inside", F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2)
    sizes = sizes.withColumn("level", F.coalesce(F.sum(F.when(F.col("inside") == 1, F.col("after1")).otherwise(F.col("after0"))).over(before), F.lit(0)))
    ends = F.lead("first").over(order).isNull()
    return sizes.select(*_SPLIT, "inside", "level", F.when(F.lag("first").over(order).isNull(), F.col("first")).alias("opening"), F.when(ends, F.col("last")).alias("ending"))


def _bounded(index: DataFrame) -> DataFrame:
    return F.broadcast(index) if index.count() <= MOST_SPLITS else index


def _marked(rows: DataFrame, index: DataFrame) -> DataFrame:
    """Fragments of which is known whether they begin or end a piece, and whether they are the file's first or last."""
    rows = _inside_splits(rows).join(index, _SPLIT)
    after = F.when(F.col("inside") == 1, F.col("after1")).otherwise(F.col("after0")) + F.col("level")
    change = F.when(F.col("inside") == 1, F.col("change1")).otherwise(F.col("change0"))
    outside = lambda quotes: (F.col("inside") + quotes) % 2 == 0
    first, last = F.coalesce(F.col("at") == F.col("opening"), F.lit(False)), F.coalesce(F.col("at") == F.col("ending"), F.lit(False))
    begins = first | ((after - change == 1) & outside(F.col("quotes_before")))
    ends = last | ((after == 1) & outside(F.col("quotes_before") + F.col("quotes")))
    return rows.select(*_SPLIT, "at", F.when(last, F.col("value")).otherwise(F.concat("value", F.lit("}"))).alias("text"), first.alias("first"), last.alias("last"), begins.alias("begins"), ends.alias("ends"))


def _pieces(marked: DataFrame, index: DataFrame) -> DataFrame:
    """Texts that hold whole elements: most are one fragment and stay where they are, only nested ones are put together."""
    started = F.last(F.when(F.col("begins"), F.col("at")), ignorenulls=True)
    order = Window.partitionBy("file").orderBy("split", "opened")
    opened = marked.groupBy(*_SPLIT).agg(F.min("at").alias("opened"), F.max(F.when(F.col("begins"), F.col("at"))).alias("begun"))
    opened = opened.select(*_SPLIT, F.last("begun", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1)).alias("open"))
    one = F.col("begins") & F.col("ends")
    whole = marked.filter(one).select("file", "text", "first", "last")
    parts = marked.withColumn("of", started.over(_in_split())).filter(~one).join(_bounded(opened), _SPLIT).withColumn("of", F.coalesce("of", "open"))
    joined = parts.groupBy("file", "of").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "text"))), lambda p: p["text"]), "").alias("text"), F.bool_or("first").alias("first"), F.bool_or("last").alias("last"))
    return whole.unionByName(joined.drop("of"))


def read_json_array(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Records of documents that hold one array of objects; other fields are dropped, missing ones are null.

    A document that isn't one array (JSON lines, text after the array, missing commas) is an error; an empty file has no
    records; an element that is null is a record of nulls. Strings are in double quotes. A task holds a split in windows that can
    spill, and one element; compressed files are one split each.
    """
    rows = _fragments(spark, paths)
    index = _bounded(_split_index(_inside_splits(rows.drop("value"))))
    pieces = _pieces(_marked(rows, index), index)
    wrong = F.raise_error(F.concat(F.lit("not one JSON array: "), F.col("file")))
    text = F.when(~F.col("last"), F.col("text")).when(F.col("text").rlike(r"\]\s*\z"), F.regexp_replace("text", r"\s*\]\s*\z", "")).otherwise(wrong)
    pieces = pieces.select("file", "first", "last", text.alias("text"))
    opening, comma = r"^\s*\[", r"^\s*,\s*(?=\S)"
    first = F.when(F.col("text").rlike(opening), F.regexp_replace("text", opening, "")).otherwise(wrong)
    later = F.when(F.col("text").rlike(comma), F.regexp_replace("text", comma, "")).when(F.col("last") & F.col("text").rlike(r"^\s*\z"), "").otherwise(wrong)
    elements = F.when(F.col("first"), first).otherwise(later)
    parsed = F.from_json(F.concat(F.lit("["), elements, F.lit("]")), f"array<struct<{RECORD}>>", {"mode": "FAILFAST", "allowSingleQuotes": "false"})
    return pieces.select("file", F.explode(parsed).alias("r")).select("file", "r.id", "r.name", "r.description")

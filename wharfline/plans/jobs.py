"""The import and export jobs as lazy plans."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from wharfline.functions.mapping import Rule, apply_mapping, pack_attributes, standardize
from wharfline.functions.text import business_key, format_batch_date, format_description, format_name, has_text, partition_key
from wharfline.operators.filters import export_filter, validate_export
from wharfline.operators.keyed import dedup_batch
from wharfline.operators.measures import export_stats
from wharfline.sources.tables import guarded_sql
from wharfline.sources.text import Feed, Parsed


@dataclass(frozen=True)
class Import:
    """records to merge, repeated keys of the batch, rows that failed validation, rows that couldn't be parsed."""

    records: DataFrame
    duplicates: DataFrame
    rejected: DataFrame
    bad: DataFrame

    def counts(self) -> DataFrame:
        """One row of counts, each from one pass."""
        one = lambda df, name: df.agg(F.count("*").alias(name))
        rows = one(self.records, "written").crossJoin(F.broadcast(one(self.duplicates, "duplicate")))
        return rows.crossJoin(F.broadcast(one(self.rejected, "rejected"))).crossJoin(F.broadcast(one(self.bad, "parse_error")))


def _keyed(rows: DataFrame, batch_date: Column, as_of: Column, key: Column) -> DataFrame:
    return rows.withColumn("batch_date", batch_date).withColumn("business_key", key).withColumn("partition_key", partition_key("batch_date", as_of))


def import_records(parsed: Parsed, batch_date: Column, as_of: Column) -> Import:
    """The default path: names required and in upper case, key of name and date, the first line of a key wins."""
    good, rejected = standardize(parsed.good)
    kept, again = dedup_batch(_keyed(good, batch_date, as_of, business_key("batch_date", "name")), ["business_key", "batch_date"], ["file", "line_no"])
    return Import(kept, again, rejected, parsed.bad)


def import_outcomes(parsed: Parsed, batch_date: Column, as_of: Column) -> DataFrame:
    """All lines of an import with their ``outcome``: written, duplicate, rejected or parse_error; the same as import_records, in one plan."""
    rows = parsed.rows if parsed.rows is not None else parsed.good.withColumn("error", F.lit(None).cast("string")).unionByName(parsed.bad, allowMissingColumns=True)
    unread, unnamed = F.col("error").isNotNull(), ~has_text("name")
    failed = F.when(unread, "parse_error").when(unnamed, "rejected")
    rows = rows.withColumn("outcome", failed).withColumn("error", F.when(F.col("outcome") == "rejected", F.lit("name missing")).otherwise(F.col("error"))).withColumn("name", F.upper("name"))
    rows = _keyed(rows, batch_date, as_of, business_key("batch_date", "name"))
    # failed lines have no key, and are groups of their own by file and line
    good = F.col("outcome").isNull()
    of = Window.partitionBy(good, F.when(good, F.col("business_key")).otherwise(F.col("file")), F.when(good, F.col("batch_date")).otherwise(F.col("line_no").cast("string"))).orderBy("file", "line_no")
    return rows.withColumn("outcome", F.coalesce("outcome", F.when(F.row_number().over(of) > 1, "duplicate").otherwise("written")))


OUTCOMES = ("written", "duplicate", "rejected", "parse_error")


def save_import(outcomes: DataFrame, path: str) -> dict[str, int]:
    """Write the lines in a folder for each outcome, and count them in the same pass.

    The counts are taken in the tasks that write, of which each counts once, however often it is tried.
    """
    seen = Observation()
    counted = outcomes.observe(seen, *(F.count_if(F.col("outcome") == o).alias(o) for o in OUTCOMES))
    counted.write.partitionBy("outcome").parquet(path)
    return {o: seen.get[o] for o in OUTCOMES}


def import_feed(rows: DataFrame, feed: Feed, rules: list[Rule], batch_date: Column, as_of: Column, on_error: str = "reject") -> Import:
    """The feed path: mapped by rules, other targets packed as attributes, key of the feed's fields or of the name."""
    good, bad = apply_mapping(rows, rules, on_error=on_error)
    fields = list(feed.business_key_fields)
    keyed = _keyed(good, batch_date, as_of, business_key("batch_date", fields=fields) if fields else business_key("batch_date", "name"))
    named = keyed.filter(has_text("name")) if "name" in keyed.columns else keyed
    rejected = keyed.filter(~has_text("name")).withColumn("error", F.lit("name missing")) if "name" in keyed.columns else keyed.limit(0)
    core = ("name", "description", "batch_date", "business_key", "partition_key")
    kept, again = dedup_batch(pack_attributes(named, core), ["business_key", "batch_date"], ["file", "line_no"])
    return Import(kept, again, rejected, bad)


EXPORT_COLUMNS = ("id", "business_key", "name", "description", "batch_date")


def format_export(df: DataFrame) -> DataFrame:
    return df.select("id", "business_key", format_name("name").alias("name"), format_description("description").alias("description"), format_batch_date("batch_date").alias("batch_date"))


def export_records(spark: SparkSession, sql: str, allowed: dict[str, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(rows, invalid) of a guarded statement: filtered, validated and formatted."""
    rows = guarded_sql(spark, sql, allowed)
    missing = [c for c in EXPORT_COLUMNS if c not in rows.columns]
    if missing:
        raise ValueError(f"the statement lacks: {', '.join(missing)}")
    good, bad = validate_export(export_filter(rows.select(*EXPORT_COLUMNS)))
    return format_export(good), bad


def export_summary(df: DataFrame) -> DataFrame:
    """Statistics of an export over the rows that would go out."""
    dropped = ~(has_text("business_key") & ~F.coalesce(F.col("business_key").startswith("TEST_"), F.lit(False)))
    valid = F.coalesce(F.col("id") > 0, F.lit(False)) & has_text("batch_date") & has_text("name")
    return export_stats(df.select(dropped.alias("filtered"), valid.alias("valid")))

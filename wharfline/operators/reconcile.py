"""Files against tables: counts, fingerprints, differing keys; quality gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wharfline.functions.text import business_key, has_text, jtrim
from wharfline.operators.hashtree import differing_keys
from wharfline.operators.keyed import key_diff
from wharfline.operators.measures import share
from wharfline.operators.ordering import ordered_md5


def canonical(df: DataFrame, key: Column | str = "business_key", keep: tuple[str, ...] = ()) -> DataFrame:
    """Rows as texts ``key,name,description``: names in upper case, cells trimmed, blank names dropped; ``keep`` are columns that stay."""
    clean = lambda c: F.coalesce(jtrim(c), F.lit(""))
    return df.filter(has_text("name")).select(*keep, F.concat_ws(",", clean(key), F.upper(clean("name")), clean("description")).alias("row"))


def fingerprint(rows: DataFrame) -> DataFrame:
    """Count and hash sums of a multiset of texts; no order, no sort, no single task."""
    data = F.col("row").cast("binary")
    digest = F.conv(F.substring(F.md5(data), 1, 15), 16, 10).cast("decimal(38,0)")
    return rows.agg(F.count("*").alias("n"), F.coalesce(F.sum(digest), F.lit(0).cast("decimal(38,0)")).alias("hash_sum"))


def reconcile_counts(source: DataFrame, target: DataFrame, date: str) -> DataFrame:
    a = source.agg(F.count("*").alias("source_count"))
    b = target.filter(F.col("batch_date") == date).agg(F.count("*").alias("target_count"))
    same = F.col("source_count") == F.col("target_count")
    said = F.when(same, "OK").otherwise(F.concat(F.lit("source="), F.col("source_count").cast("string"), F.lit(" target="), F.col("target_count").cast("string")))
    return a.crossJoin(F.broadcast(b)).select("source_count", "target_count", F.when(same, "PASS").otherwise("FAIL").alias("status"), said.alias("message"))


def reconcile_hash(source: DataFrame, target: DataFrame, date: str, exact: bool = False, run: int | None = 4096) -> DataFrame:
    """PASS if both sides hold the same rows, in any order. exact: by the digest of the sorted rows, of any number.

    run: rows of a run in the tree of digests; None: the plain MD5, as SQL takes it, by one task a side.
    """
    key = business_key(F.lit(date), F.upper(jtrim("name")))
    a, b = canonical(source, key), canonical(target.filter(F.col("batch_date") == date))
    if exact:
        x, y = ordered_md5(a, run=run).select(F.col("hash").alias("source_hash")), ordered_md5(b, run=run).select(F.col("hash").alias("target_hash"))
    else:
        whole = F.concat_ws(":", F.col("n").cast("string"), F.col("hash_sum").cast("string"))
        x, y = fingerprint(a).select(whole.alias("source_hash")), fingerprint(b).select(whole.alias("target_hash"))
    return x.crossJoin(F.broadcast(y)).withColumn("status", F.when(F.col("source_hash") == F.col("target_hash"), "PASS").otherwise("FAIL"))


def reconcile(source: DataFrame, target: DataFrame, date: str, sample: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(run, differences): one row of counts, hashes and status, and the keys of one side only.

    Differences come from a comparison of hash trees, which joins rows of unlike ranges only; a sample of the first keys
    of each side needs the keys in order and joins all.
    """
    counts, hashes = reconcile_counts(source, target, date), reconcile_hash(source, target, date)
    run = counts.withColumnsRenamed({"status": "count_status"}).crossJoin(F.broadcast(hashes.withColumnRenamed("status", "hash_status")))
    ok = (F.col("count_status") == "PASS") & (F.col("hash_status") == "PASS")
    run = run.select("source_count", "target_count", "source_hash", "target_hash", F.when(ok, "PASS").otherwise("FAIL").alias("status"), "message")
    keyed = source.filter(has_text("name")).select(business_key(F.lit(date), F.upper(jtrim("name"))).alias("business_key"))
    rows = target.filter(F.col("batch_date") == date)
    return run, key_diff(keyed, rows, sample=sample) if sample else differing_keys(keyed, rows)


def _gate(kind: str, df: DataFrame, status: Column, rate: Column, most: float, *others: str) -> DataFrame:
    return df.select(*others, F.lit(kind).alias("gate_type"), status.alias("status"), rate.alias("error_rate"), F.lit(float(most)).alias("max_rate"))


def gate_parse_errors(counts: DataFrame, rules: dict[str, tuple[float, int]], default: tuple[float, int] = (0.05, 1)) -> DataFrame:
    """job_name, read_count, parse_error_count in; too few lines: SKIP; too many errors: FAIL. rules: job to (rate, lines)."""
    most, least = F.lit(float(default[0])), F.lit(default[1])
    for job, (rate, lines) in rules.items():
        most, least = F.when(F.col("job_name") == job, float(rate)).otherwise(most), F.when(F.col("job_name") == job, lines).otherwise(least)
    total = F.col("read_count") + F.col("parse_error_count")
    rate = share(F.col("parse_error_count"), total)
    status = F.when(total < F.greatest(F.lit(1), least), "SKIP").when(rate > most, "FAIL").otherwise("PASS")
    return counts.select("job_name", F.lit("PARSE_ERROR_RATE").alias("gate_type"), total.alias("total_count"), status.alias("status"), rate.alias("error_rate"), most.alias("max_rate"))


def gate_completeness(df: DataFrame, date: str, most: float = 0.01) -> DataFrame:
    rows = df.filter(F.col("batch_date") == date).agg(F.count("*").alias("total_count"), F.count_if(~has_text("name")).alias("missing"))
    rate = share(F.col("missing"), F.col("total_count"))
    return _gate("COMPLETENESS", rows, F.when(rate > most, "FAIL").otherwise("PASS"), rate, most, "total_count", "missing")


def gate_duplicates(df: DataFrame, date: str, most: float = 0.0, least: int = 100) -> DataFrame:
    """Groups of repeated keys to rows; no row of result below ``least`` rows."""
    groups = df.filter(F.col("batch_date") == date).groupBy("business_key").agg(F.count("*").alias("n"))
    rows = groups.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total_count"), F.count_if(F.col("n") > 1).alias("duplicate_groups")).filter(F.col("total_count") >= least)
    rate = share(F.col("duplicate_groups"), F.col("total_count"))
    return _gate("DUPLICATE_RATE", rows, F.when(rate > most, "FAIL").otherwise("PASS"), rate, most, "total_count", "duplicate_groups")


def gate_export_rows(counts: DataFrame, column: str = "n", expected: int | None = None, minimum: int = 0) -> DataFrame:
    n = F.col(column)
    if expected is not None:
        rate = share(F.abs(n - expected), F.lit(expected))
        return _gate("EXPORT_ROWS", counts, F.when(n == expected, "PASS").otherwise("FAIL"), rate, 0.0, column)
    return _gate("EXPORT_ROWS", counts, F.when(n >= minimum, "PASS").otherwise("FAIL"), F.lit(0.0), 0.0, column)


def job_verdict(gates: DataFrame) -> DataFrame:
    """One row: FAILED if any gate failed."""
    return gates.agg(F.when(F.count_if(F.col("status") == "FAIL") > 0, "FAILED").otherwise("COMPLETED").alias("job_status"))


def enforce(gates: DataFrame, flag: bool = True) -> None:
    """Raise if a gate failed."""
    if flag and (failed := [r.gate_type for r in gates.filter("status = 'FAIL'").select("gate_type").limit(10).collect()]):
        raise ValueError(f"gates failed: {', '.join(failed)}")

"""Tables: scans by date, partition and time, and guarded SQL."""

from __future__ import annotations

import re
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words that no read-only statement needs (fixed values).
FORBIDDEN = ("insert", "update", "delete", "merge", "drop", "alter", "create", "truncate", "grant", "revoke", "call", "execute", "copy", "refresh", "cache", "uncache", "analyze", "load", "add", "reset", "use")
#: Functions that reach outside the tables (fixed values).
FORBIDDEN_FUNCTIONS = ("java_method", "reflect", "try_reflect", "input_file_name", "read_files")


def scan_batch(df: DataFrame, batch_date: str | Column) -> DataFrame:
    return df.filter(F.col("batch_date") == batch_date)


def scan_partitions(df: DataFrame, low: str, high: str | None = None) -> DataFrame:
    """Partitions from ``low`` to ``high`` as strings, both inside; the filter prunes partition folders."""
    return df.filter(F.col("partition_key").between(low, high if high is not None else low))


def scan_created(df: DataFrame, start: Column, end: Column, column: str = "created_at") -> DataFrame:
    return df.filter(F.col(column).between(start, end))


def check_statement(sql: str) -> None:
    """Refuse all but one SELECT or WITH without comments."""
    bare = re.sub(r"'(?:[^'\\]|\\.|'')*'", "''", sql)
    if "--" in bare or "/*" in bare or ";" in bare:
        raise ValueError("comments and several statements aren't allowed")
    if not re.match(r"\s*(select|with)\b", bare, re.I):
        raise ValueError("only SELECT or WITH is allowed")
    words = re.findall(r"[a-z_]+", re.sub(r"`[^`]*`", " ", bare.lower()))
    if first := next((w for w in words if w in FORBIDDEN), None):
        raise ValueError(f"not allowed: {first}")
    if first := next((f for f in FORBIDDEN_FUNCTIONS if re.search(rf"\b{f}\s*\(", bare, re.I)), None):
        raise ValueError(f"not allowed: {first}")


#: Leaves of a plan that read nothing: a row without a table, rows in the statement, numbers, a name of a WITH clause.
HARMLESS = ("OneRowRelation", "LocalRelation", "Range", "CTERelationRef")


def outside(plan, allowed: set[str]) -> set[str]:
    """What an analysed plan reads beyond the temporary views named; subqueries and WITH clauses are parts of the plan.

    Names count as they were resolved, whatever a statement calls its own clauses.
    """
    kind, found = plan.getClass().getSimpleName(), set()
    if kind == "View":
        name = plan.desc().identifier().unquotedString().lower()
        if plan.isTempView() and name in allowed:
            return set()
        return {name}
    below = [plan.children().apply(i) for i in range(plan.children().size())]
    inner = [plan.subqueries().apply(i) for i in range(plan.subqueries().size())]
    if not below and kind not in HARMLESS:
        found.add(plan.toString().strip()[:80])
    return found.union(*(outside(x, allowed) for x in below + inner))


@contextmanager
def views(spark: SparkSession, frames: dict[str, DataFrame]) -> Iterator[None]:
    """Temporary views for the time of one analysis; those that had the names come back."""
    there = {t.name.lower() for t in spark.catalog.listTables() if t.isTemporary}
    before = {name: spark.table(f"`{name}`") for name in frames if name.lower() in there}
    for name, df in frames.items():
        df.createOrReplaceTempView(name)
    try:
        yield
    finally:
        for name in frames:
            if name in before:
                before[name].createOrReplaceTempView(name)
            else:
                spark.catalog.dropTempView(name)


def guarded_sql(spark: SparkSession, sql: str, allowed: dict[str, DataFrame]) -> DataFrame:
    """The result of one read-only statement over the allowed tables. No view of them stays in the session."""
    check_statement(sql)
    with views(spark, allowed):
        try:
            df = spark.sql(sql)
        except AnalysisException as error:
            if error.getCondition() == "TABLE_OR_VIEW_NOT_FOUND":
                raise ValueError(f"not allowed: {error.getMessageParameters()['relationName']}") from error
            raise
        beyond = outside(df._jdf.queryExecution().analyzed(), {a.lower() for a in allowed})
    if beyond:
        raise ValueError(f"not allowed: {', '.join(sorted(beyond))}")
    return df

"""Declarative mapping: rules compiled to columns."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wharfline.functions.text import has_text, jtrim


@dataclass(frozen=True)
class Rule:
    source: str
    target: str
    op: str = "NONE"
    arg: str | None = None
    required: bool = False


def date_format(c: Column, pattern: str | None) -> Column:
    """Blank stays; a date of the pattern becomes yyyy-MM-dd, another text null."""
    parsed = F.try_to_timestamp(jtrim(c), F.lit(pattern or "yyyy-MM-dd")).cast("date").cast("string")
    return F.when(has_text(c), parsed).otherwise(c)


_OPS: dict[str, Callable[[Column, str | None], Column]] = {
    "NONE": lambda c, _: c,
    "TRIM": lambda c, _: jtrim(c),
    "UPPER": lambda c, _: F.upper(c),
    "LOWER": lambda c, _: F.lower(c),
    "DEFAULT": lambda c, arg: F.when(has_text(c), c).otherwise(F.lit(arg)),
    "DATE_FORMAT": date_format,
}


def register_op(name: str, build: Callable[[Column, str | None], Column]) -> None:
    """Add an operation: (column, argument) to column."""
    _OPS[name.upper()] = build


def apply_mapping(df: DataFrame, rules: list[Rule], raw: str = "raw", on_error: str = "reject") -> tuple[DataFrame, DataFrame]:
    """(good, bad): the targets as columns in the order of the rules, and the rows that lack a required one.

    The source is a map column, or the columns themselves if ``raw`` is empty. ``on_error``: a date that
    can't be read rejects its row, or fails the job.
    """
    others = [c for c in df.columns if c != raw and c not in {r.target for r in rules}] if raw else []
    values, errors = [], []
    for r in rules:
        source = F.col(raw)[r.source] if raw else F.col(r.source)
        source = source.cast("string")
        value = _OPS[r.op.upper()](source, r.arg)
        if r.op.upper() == "DATE_FORMAT":
            broken = has_text(source) & value.isNull()
            if on_error == "fail":
                value = F.when(broken, F.raise_error(F.concat(F.lit(f"{r.target}: not a date: "), source))).otherwise(value)
            else:
                errors.append(F.when(broken, F.lit(f"not a date: {r.target}")))
        if r.required:
            errors.append(F.when(~has_text(value), F.lit(f"required target field missing: {r.target}")))
        values.append(value.alias(r.target))
    rows = df.select(*others, *values, (F.coalesce(*errors) if errors else F.lit(None).cast("string")).alias("error"))
    return rows.filter("error IS NULL").drop("error"), rows.filter("error IS NOT NULL")


def pack_attributes(df: DataFrame, core: tuple[str, ...] = ("name", "description"), keep: tuple[str, ...] = ("file", "line_no")) -> DataFrame:
    """Targets that aren't core fields as one map; null if there are none."""
    rest = [c for c in df.columns if c not in core and c not in keep]
    pairs = [F.struct(F.lit(c).alias("k"), F.col(c).cast("string").alias("v")) for c in rest]
    packed = F.map_from_entries(F.array(*pairs)) if pairs else F.lit(None).cast("map<string,string>")
    return df.select(*(c for c in df.columns if c not in rest), packed.alias("attributes"))


def standardize(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good, bad): the default transform: a name is required and becomes upper case."""
    named = has_text("name")
    return df.filter(named).withColumn("name", F.upper("name")), df.filter(~named).withColumn("error", F.lit("name missing"))

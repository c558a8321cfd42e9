"""Strings: trimming, export formats, keys, file names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ISO_DATE = r"^\d{4}-\d{2}-\d{2}$"
ISO_DATETIME = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}(:\d{2}(\.\d{1,9})?)?$"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def jtrim(c: Column | str) -> Column:
    """Without leading and trailing characters up to U+0020."""
    return F.regexp_replace(col(c), r"^[\x00-\x20]+|[\x00-\x20]+$", "")


def has_text(c: Column | str) -> Column:
    """Not null and not only white space."""
    return F.coalesce(col(c).rlike(r"\S"), F.lit(False))


def truncate(c: Column | str, n: int) -> Column:
    return F.substring(col(c), 1, n)


def business_key(batch_date: Column | str, name: Column | str | None = None, fields: list[Column | str] | None = None) -> Column:
    """``name:batch_date`` (a null name is ``unknown``), or the fields joined by ``|`` (null: empty) before the date."""
    if fields:
        head = F.concat_ws("|", *(F.coalesce(col(f), F.lit("")) for f in fields))
    else:
        head = F.coalesce(col(name), F.lit("unknown"))
    return F.concat(head, F.lit(":"), col(batch_date))


def partition_key(date: Column | str, as_of: Column) -> Column:
    """Year and month of a date text, ``yyyy_MM``; texts of other shapes stay; blank is the month of ``as_of``."""
    c = col(date)
    by = lambda mark: F.when(F.size(F.split(c, mark)) >= 2, F.concat_ws("_", F.split(c, mark)[0], F.split(c, mark)[1])).otherwise(c)
    return (
        F.when(~has_text(c), F.date_format(as_of, "yyyy_MM"))
        .when(c.contains("-"), by("-"))
        .when(c.contains("/"), by("/"))
        .when(F.length(c) == 8, F.concat_ws("_", F.substring(c, 1, 4), F.substring(c, 5, 2)))
        .otherwise(c)
    )


def _shortened(c: Column, n: int) -> Column:
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n - 3), F.lit("..."))).otherwise(c)


def format_name(c: Column | str) -> Column:
    """Upper case on one line, 100 characters at most; blank is empty."""
    flat = F.regexp_replace(jtrim(c), r"\s+", " ")
    return F.when(has_text(c), _shortened(F.upper(flat), 100)).otherwise("")


def format_description(c: Column | str) -> Column:
    """On one line without control characters, 500 characters at most; blank is empty."""
    flat = F.regexp_replace(F.regexp_replace(jtrim(c), r"\p{Cntrl}", " "), r"\s+", " ")
    return F.when(has_text(c), _shortened(flat, 500)).otherwise("")


def format_batch_date(c: Column | str) -> Column:
    """ISO dates and local date-times as a date, other texts as they are, blank as empty."""
    c = col(c)
    day = F.when(c.rlike(ISO_DATE) | c.rlike(ISO_DATETIME), F.try_to_date(F.substring(c, 1, 10), "yyyy-MM-dd"))
    return F.when(has_text(c), F.coalesce(day.cast("string"), c)).otherwise("")


def batch_date_d(c: Column | str) -> Column:
    """The date of a text of the form dddd-dd-dd, else null."""
    c = col(c)
    return F.when(c.rlike(ISO_DATE), c.try_cast("date"))


def parse_params(c: Column | str) -> Column:
    """``k=v&k=v`` as a map: the first ``=`` splits, both sides are URL-decoded, pieces without ``=`` are dropped."""
    pieces = F.filter(F.split(col(c), "&"), lambda p: p.contains("="))
    entry = lambda p: F.struct(F.try_url_decode(F.substring_index(p, "=", 1)).alias("k"), F.try_url_decode(F.regexp_replace(p, "^[^=]*=", "")).alias("v"))
    entries = F.filter(F.transform(pieces, entry), lambda e: e["k"].isNotNull() & e["v"].isNotNull())
    # of a repeated key the last value counts
    last = F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, F.size(entries)), lambda later: later["k"] == e["k"]))
    return F.map_from_entries(last)


def format_params(*pairs: tuple[str, Column | str]) -> Column:
    """``k=v&k=v`` with ``&`` and ``=`` of the values escaped; nulls are empty."""
    escaped = lambda c: F.replace(F.replace(F.coalesce(col(c).cast("string"), F.lit("")), F.lit("&"), F.lit("%26")), F.lit("="), F.lit("%3D"))
    return F.concat_ws("&", *(F.concat(F.lit(f"{k}="), escaped(c)) for k, c in pairs))


def render_template(c: Column | str, **values: Column | str) -> Column:
    """``${name}`` replaced by the values."""
    out = col(c)
    for name, value in values.items():
        out = F.replace(out, F.lit("${" + name + "}"), F.coalesce(col(value), F.lit("")))
    return out


def _clean(c: Column | str) -> Column:
    return F.coalesce(jtrim(c), F.lit(""))


def idem_key_task(job, biz, date, rerun, index=None, total=None) -> Column:
    """``job|biz|date|rerun|i/n``; without shards ``*``."""
    shard = F.lit("*") if index is None else F.when(col(index).isNull() | col(total).isNull(), "*").otherwise(F.concat_ws("/", col(index).cast("string"), col(total).cast("string")))
    return F.concat_ws("|", _clean(job), _clean(biz), _clean(date), _clean(rerun), shard)


def idem_key_import(job, file, date, rerun, index, total) -> Column:
    return F.concat_ws("|", _clean(job), _clean(file), _clean(date), _clean(rerun), F.concat_ws("/", col(index).cast("string"), col(total).cast("string")))


def idem_key_inbound(source, date, digest) -> Column:
    """``INBOUND|SOURCE|date or NA|HASH``; null without a hash."""
    s = F.when(has_text(source), F.upper(jtrim(source))).otherwise("UNKNOWN")
    d = F.when(has_text(date), jtrim(date)).otherwise("NA")
    return F.when(has_text(digest), F.concat_ws("|", F.lit("INBOUND"), s, d, F.upper(jtrim(digest))))


def file_ext(c: Column | str) -> Column:
    """What follows the last dot, in lower case; null if nothing does."""
    return F.nullif(F.lower(F.regexp_extract(col(c), r"\.([^.]*)$", 1)), F.lit(""))


def infer_format(name: Column | str, path: Column | str | None = None) -> Column:
    c = F.lower(F.when(has_text(name), col(name)).otherwise(col(path) if path is not None else F.lit(None)))
    return F.when(c.endswith(".json"), "JSON").when(c.endswith(".xlsx") | c.endswith(".xls"), "EXCEL").otherwise("CSV")


def detect_type(name: Column | str, encrypted: Column | None = None, compression: Column | None = None) -> Column:
    """struct(encrypted, compression) from explicit values or else from the file name."""
    low = F.lower(F.coalesce(col(name), F.lit("")))
    locked = low.endswith(".pgp") | low.endswith(".gpg")
    inner = F.regexp_replace(low, r"\.(pgp|gpg)$", "")
    kind = F.when(inner.endswith(".gz"), "GZIP").when(inner.endswith(".zip"), "ZIP").otherwise("PLAIN")
    if compression is not None:
        said = F.lower(jtrim(compression))
        kind = F.when(has_text(compression), F.when(said.isin("gz", "gzip"), "GZIP").when(said == "zip", "ZIP").otherwise("PLAIN")).otherwise(kind)
    return F.struct((locked if encrypted is None else F.coalesce(encrypted, locked)).alias("encrypted"), kind.alias("compression"))


def format_money(c: Column | str) -> Column:
    """Half-up to two decimals; null is 0."""
    return F.coalesce(F.round(col(c).cast("decimal(38,10)"), 2).cast("decimal(38,2)").cast("string"), F.lit("0"))


def normalize_channel(c: Column | str) -> Column:
    return F.when(has_text(c), F.upper(jtrim(c))).otherwise("UNKNOWN")


def dispatch_key(file_no, version, channel, address) -> Column:
    return F.concat_ws("|", _clean(file_no), F.coalesce(col(version), F.lit(1)).cast("string"), normalize_channel(channel), _clean(address))


def merge_metadata(old: Column | str, delta: Column | str) -> Column:
    """Two JSON objects of strings as one, where keys of the delta win."""
    a, b = (F.coalesce(F.from_json(col(c), "map<string,string>"), F.from_json(F.lit("{}"), "map<string,string>")) for c in (old, delta))
    kept = F.map_filter(a, lambda k, _: ~F.map_contains_key(b, k))
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(F.map_concat(kept, b)))))

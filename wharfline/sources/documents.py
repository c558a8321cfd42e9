"""Documents: JSON arrays, workbooks, archives, manifests, and what is known of files."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wharfline.sources.archives import read_compressed  # noqa: F401
from wharfline.sources.jsonarrays import RECORD, read_json_array

_NS = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def _cells(book: zipfile.ZipFile, sheet: int | str) -> Iterator[list[str | None]]:
    """Rows of one sheet as texts."""
    shared = []
    if "xl/sharedStrings.xml" in book.namelist():
        shared = ["".join(t.text or "" for t in si.iter(f"{_NS}t")) for si in ElementTree.fromstring(book.read("xl/sharedStrings.xml"))]
    sheets = list(ElementTree.fromstring(book.read("xl/workbook.xml")).iter(f"{_NS}sheet"))
    chosen = sheets[sheet] if isinstance(sheet, int) else next(s for s in sheets if s.get("name") == sheet)
    targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
    target = targets[chosen.get(_REL)].lstrip("/")
    for _, row in ElementTree.iterparse(book.open(target if target.startswith("xl/") else f"xl/{target}")):
        if row.tag != f"{_NS}row":
            continue
        cells: dict[int, str | None] = {}
        for n, c in enumerate(row.iter(f"{_NS}c")):
            letters = re.match("[A-Z]+", c.get("r") or "")
            at = n
            if letters:
                at = 0
                for x in letters[0]:
                    at = at * 26 + ord(x) - 64
                at -= 1
            v = c.find(f"{_NS}v")
            text = "".join(t.text or "" for t in c.iter(f"{_NS}t")) if c.get("t") == "inlineStr" else None if v is None else v.text
            cells[at] = shared[int(text)] if c.get("t") == "s" and text is not None else text
        yield [cells.get(i) for i in range(max(cells, default=-1) + 1)]
        row.clear()


def _workbook(content: bytes, sheet: int | str) -> Iterator[tuple[int | None, str | None, str | None]]:
    rows = _cells(zipfile.ZipFile(io.BytesIO(content)), sheet)
    names = {str(c).strip().lower(): i for i, c in enumerate(next(rows, [])) if c}
    for row in rows:
        get = lambda k: row[names[k]] if k in names and names[k] < len(row) else None  # noqa: B023, E731
        if any(c is not None and str(c).strip() for c in row):
            raw = get("id")
            yield (int(float(raw)) if raw and str(raw).strip() else None), get("name"), get("description")


def read_workbooks(spark: SparkSession, paths: str | list[str], sheet: int | str = 0) -> DataFrame:
    """Records of many workbooks, each read by one task: header in the first row, in any case; blank rows skipped."""
    return parse_workbooks(spark.read.format("binaryFile").load(paths).select("path", "content"), sheet)


def parse_workbooks(files: DataFrame, sheet: int | str = 0) -> DataFrame:
    """The same for workbooks that are there as rows of path and content."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                rows = list(_workbook(content, sheet))
                yield pd.DataFrame({"file": path, "ordinal": range(1, len(rows) + 1), "id": pd.array([r[0] for r in rows], "Int64"), "name": [r[1] for r in rows], "description": [r[2] for r in rows]})

    return files.select("path", "content").mapInPandas(run, f"file string, ordinal bigint, {RECORD}")


MANIFEST = "manifestId string, sourceSystem string, bizDate string, files array<struct<fileName:string,expectedRecordCount:bigint,checksum:string,checksumAlgorithm:string,required:boolean>>"


def read_manifests(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """One row for each expected file of a manifest; ``errors`` says what a manifest lacks."""
    rows = spark.read.schema(MANIFEST).option("multiLine", True).json(paths)
    lacks = lambda cond, text: F.when(cond, F.lit(text))
    blank = lambda c: F.col(c).isNull() | (F.trim(c) == "")
    rows = rows.withColumn("errors", F.array_compact(F.array(lacks(blank("manifestId"), "manifestId missing"), lacks(F.col("files").isNull() | (F.size("files") == 0), "files missing"))))
    f = rows.select("*", F.explode_outer("files").alias("f"))
    errors = F.array_compact(F.concat("errors", F.array(
        lacks(F.col("f").isNotNull() & (F.col("f.fileName").isNull() | (F.trim("f.fileName") == "")), "fileName missing"),
        lacks(F.col("f.checksum").isNotNull() & (F.upper(F.coalesce("f.checksumAlgorithm", F.lit("MD5"))) != "MD5"), "checksum algorithm unknown"),
    )))
    return f.select(
        F.col("manifestId").alias("manifest_id"), F.col("sourceSystem").alias("source_system"), F.col("bizDate").alias("biz_date"), F.col("f.fileName").alias("expected_file_name"),
        F.col("f.expectedRecordCount").alias("expected_record_count"), F.col("f.checksum").alias("expected_checksum"), F.coalesce("f.required", F.lit(True)).alias("required"), errors.alias("errors"),
    )


def list_files(spark: SparkSession, directory: str) -> DataFrame:
    """path, name, length, modified of the files below a directory, without reading them."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(directory)
    return rows.select("path", F.substring_index("path", "/", -1).alias("name"), "length", F.col("modificationTime").alias("modified"))


def ready_files(files: DataFrame, require_done: bool = False, unfinished: tuple[str, ...] = (".part", ".tmp", ".upload"), markers: DataFrame | None = None) -> DataFrame:
    """Files that are complete: not empty, not under a name of unfinished ones, with their ``.done`` marker if asked.

    markers: paths that hold the markers, if they aren't among the files.
    """
    done = (files if markers is None else markers).filter(F.col("path").endswith(".done")).select(F.expr("left(path, length(path) - 5)").alias("path"))
    rows = files.filter((F.col("length") > 0) & ~F.col("path").endswith(".done"))
    for end in unfinished:
        rows = rows.filter(~F.lower("path").endswith(end))
    return rows.join(done, "path", "left_semi") if require_done else rows


def list_ready_files(spark: SparkSession, directory: str, require_done: bool = False) -> DataFrame:
    files = list_files(spark, directory)
    if not require_done:
        return ready_files(files)
    # scans leave out empty files, which markers mostly are; the listing that the driver holds has them
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(directory).inputFiles()
    markers = spark.createDataFrame([(re.sub("^file:/+", "file:/", p),) for p in listed if p.endswith(".done")], "path string")
    return ready_files(files, True, markers=markers)


def fingerprint_files(spark: SparkSession, directory: str) -> DataFrame:
    """path, name, length and MD5 of each file."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(directory)
    return rows.select("path", F.substring_index("path", "/", -1).alias("name"), "length", F.md5("content").alias("file_hash"))


def stream_files(spark: SparkSession, directory: str, schema, file_format: str = "text", **options):
    """New files of a directory as a stream, oldest first."""
    return spark.readStream.format(file_format).schema(schema).options(latestFirst="false", **options).load(directory)


_DOCUMENT_FORMATS: dict[str, Callable[[SparkSession, str | list[str]], DataFrame]] = {"JSON": read_json_array, "EXCEL": read_workbooks}


def register_document(name: str, read: Callable[[SparkSession, str | list[str]], DataFrame]) -> None:
    _DOCUMENT_FORMATS[name.upper()] = read


def read_document(spark: SparkSession, paths: str | list[str], kind: str) -> DataFrame:
    return _DOCUMENT_FORMATS[kind.upper()](spark, paths)

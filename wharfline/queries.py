"""Registered queries: each operator over whole tables, with the same question in SQL."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable
from dataclasses import dataclass
from html import escape

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wharfline.derived import frame, with_derived
from wharfline.functions import calendar as cal
from wharfline.functions import mapping as mp
from wharfline.functions import status as st
from wharfline.functions import text as tx
from wharfline.operators import alerts, filters, graph, hashtree, intake, keyed, measures, ordering, reconcile, replay
from wharfline.plans import jobs, sinks
from wharfline.shared import shared_dir
from wharfline.sources import documents, tables, text, textindex
from wharfline.sources.archives import inflate_lines
from wharfline.streaming import intake as stream_intake
from wharfline.streaming import breakers, requests, states

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


@dataclass(frozen=True)
class Given:
    """Tables by name, and folders that all executors see."""

    spark: SparkSession
    sf_dir: str

    def __call__(self, name: str) -> DataFrame:
        return frame(self.spark, self.sf_dir, name)

    def folder(self, name: str) -> str:
        return shared_dir(self.spark, name)


def add(name: str, build: Callable[[Given], DataFrame], sql: str | None = None) -> None:
    QUERIES[name] = lambda spark, sf_dir: build(Given(spark, sf_dir))
    if sql:
        SQL[name] = with_derived(sql)


def at(text_: str):
    return F.to_timestamp(F.lit(text_))


ORDERS_NOW, EVENTS_NOW, FILES_NOW = "2001-08-01 00:00:00", "2024-01-31 00:00:00", "2024-01-02 12:00:00"
ms = F.unix_millis

# ---------------------------------------------------------------- sources

RAW_LINES = "SELECT CASE WHEN id % 50 = 0 THEN 'x' || CAST(id AS STRING) WHEN id % 60 = 1 THEN '' ELSE CAST(id AS STRING) END AS id, CASE WHEN id % 40 = 3 THEN '' ELSE ' ' || name END AS name, description FROM raw"


def line_files(t: Given, columns: str = "id,name,description", **options: str) -> str:
    """The raw lines as text files with a header in each."""
    raw = t("raw")
    identity = F.when(F.col("id") % 50 == 0, F.concat(F.lit("x"), F.col("id").cast("string"))).when(F.col("id") % 60 == 1, "").otherwise(F.col("id").cast("string"))
    name = F.when(F.col("id") % 40 == 3, "").otherwise(F.concat(F.lit(" "), F.col("name")))
    path = t.folder("lines")
    names = columns.split(",")
    raw.select(identity.alias(names[0]), name.alias(names[1]), F.col("description").alias(names[2])).write.options(header=True, emptyValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False, **options).csv(path)
    return path


GOOD_LINES = f"SELECT TRY_CAST(id AS BIGINT) AS id, trim(name) AS name, description FROM ({RAW_LINES}) AS l WHERE substr(id, 1, 1) <> 'x' OR id = ''"
add("S1_read_delimited", lambda t: text.read_delimited(t.spark, line_files(t)).good.select("id", "name", "description"), GOOD_LINES)
add("S1_bad_lines", lambda t: text.read_delimited(t.spark, line_files(t)).bad.select("line", "error"), f"SELECT id || ',' || name || ',' || description AS line, 'not a number: ' || id AS error FROM ({RAW_LINES}) AS l WHERE substr(id, 1, 1) = 'x'")


def fixed_width(t: Given) -> DataFrame:
    path = t.folder("fixed")
    line = F.concat(F.lpad(F.col("id").cast("string"), 10, " "), F.rpad("name", 30, " "), F.col("description"))
    t("raw").select(line.alias("line")).write.options(header=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)
    return text.read_fixed_width(t.spark, path).good.select("id", "name", "description")


add("S2_read_fixed_width", fixed_width, "SELECT id, name, description FROM raw")


def feed_rows(t: Given) -> DataFrame:
    rows = text.read_feed(t.spark, line_files(t, "c_id,c_name,c_cat", sep="|"), text.Feed("f", "|"))
    return rows.select(F.col("raw")["c_id"].alias("c_id"), F.col("raw")["c_name"].alias("c_name"), F.col("raw")["c_cat"].alias("c_cat"), F.col("raw")["c_none"].alias("c_none"))


add("S3_read_feed", feed_rows, f"SELECT id AS c_id, name AS c_name, description AS c_cat, CAST(NULL AS STRING) AS c_none FROM ({RAW_LINES}) AS l")


def json_arrays(t: Given) -> DataFrame:
    """The raw lines as one array in each file; files are as many as tasks write, whatever the number of rows."""
    path = t.folder("json")
    sinks.export_json(t("raw").select("id", "name", "description", "batch_date"), path, max_rows=None)
    return documents.read_json_array(t.spark, path).select("id", "name", "description")


add("S4_read_json_array", json_arrays, "SELECT id, name, description FROM raw")
add("S6_read_compressed", lambda t: text.parse_delimited(documents.read_compressed(t.spark, line_files(t, compression="gzip"))).good.select("id", "name", "description"), GOOD_LINES)



def archives(t: Given) -> DataFrame:
    """Lines of zip archives: as fragments of bytes, as the reader gets them from files."""

    def pack(part: pd.DataFrame) -> pd.DataFrame:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z, z.open("x.csv", "w") as member:
            for key, event, props in part.sort_values("event_id")[["event_id", "event_type", "props"]].itertuples(index=False):
                member.write(f"{key};{event};{props}\r\n".encode())
        parts = out.getvalue().split(b"\n")
        return pd.DataFrame({"file": f"{part['of'].iloc[0]}.zip", "kind": "ZIP", "line_no": range(len(parts)), "part": parts})

    packed = t("events").select("event_id", "event_type", "props", F.floor(F.col("event_id") / 5000).alias("of")).groupBy("of").applyInPandas(pack, "file string, kind string, line_no bigint, part binary")
    return inflate_lines(packed).select("line_no", "line")


add("S6_read_archives", archives, "SELECT row_number() OVER (PARTITION BY event_id // 5000 ORDER BY event_id) AS line_no, CAST(event_id AS STRING) || ';' || event_type || ';' || props AS line FROM events")


def workbooks(rows: DataFrame, size: int) -> DataFrame:
    """Workbooks of ``size`` rows each as path and content: one sheet under a header."""
    ns = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"

    def book(part: pd.DataFrame) -> pd.DataFrame:
        cell = lambda v: "<c/>" if pd.isna(v) else f"<c><v>{v}</v></c>" if not isinstance(v, str) else f'<c t="inlineStr"><is><t>{escape(v)}</t></is></c>'
        line = lambda values: f"<row>{''.join(map(cell, values))}</row>"
        columns = ["id", "name", "description"]
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            z.writestr("xl/workbook.xml", f'<workbook xmlns="{ns}" xmlns:r="{rel}"><sheets><sheet name="S" sheetId="1" r:id="rId1"/></sheets></workbook>')
            z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>')
            z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{ns}"><sheetData>{line(["ID", "Name", "Description"])}{"".join(line(r) for r in part[columns].itertuples(index=False))}</sheetData></worksheet>')
        return pd.DataFrame({"path": [f"{part['book'].iloc[0]}.xlsx"], "content": [out.getvalue()]})

    return rows.withColumn("book", F.floor(F.col("id") / size)).groupBy("book").applyInPandas(book, "path string, content binary")


add("S5_read_workbooks", lambda t: documents.parse_workbooks(workbooks(t("raw").select("id", "name", F.when(F.col("id") % 7 != 0, F.col("description")).alias("description")), 2000)).select("id", "name", "description"), "SELECT id, name, CASE WHEN id % 7 <> 0 THEN description END AS description FROM raw")


def tagged_lines(t: Given) -> DataFrame:
    """A line format of one's own: cells are named in the line, which has no header."""
    value = lambda k: F.regexp_extract("line", f"(?:^|;){k}=([^;]*)", 1)
    text.register_format("TAGGED", lambda lines: text.Parsed(lines.select("file", "line_no", value("id").cast("bigint").alias("id"), value("name").alias("name")), lines.limit(0)))
    path = t.folder("tagged")
    t("raw").select(F.concat_ws(";", F.concat(F.lit("name="), "name"), F.concat(F.lit("id="), F.col("id").cast("string"))).alias("value")).write.text(path)
    return text.read_lines(t.spark, path, "tagged").good.select("id", "name")


def listed_documents(t: Given) -> DataFrame:
    """A document format of one's own: a document is a key and its values."""
    documents.register_document("LISTS", lambda spark, paths: spark.read.text(paths, wholetext=True).select(F.explode(F.split(F.trim("value"), "\n")).alias("row")).filter("row <> ''").select(F.split("row", ",")[0].cast("bigint").alias("id"), F.split("row", ",")[1].alias("name")))
    path = t.folder("lists")
    t("raw").select(F.concat_ws(",", F.col("id").cast("string"), "name").alias("value")).repartition(16, "id").write.text(path)
    return documents.read_document(t.spark, path, "lists").select("id", "name")


def own_operation(t: Given) -> DataFrame:
    mp.register_op("LEFT", lambda c, arg: F.substring(c, 1, int(arg)))
    return mp.apply_mapping(mapped(t), [mp.Rule("description", "code", "LEFT", "5"), mp.Rule("name", "name", "TRIM", None, True)])[0].select("line_no", "code", "name")


add("X1_line_format", tagged_lines, "SELECT id, name FROM raw")
add("X2_document_format", listed_documents, "SELECT id, name FROM raw")
add("X3_mapping_op", own_operation, "SELECT line_no, CASE WHEN id % 9 <> 0 THEN substr(chr(9) || description, 1, 5) END AS code, name FROM raw WHERE id % 40 <> 3")
add("S7_scan_batch", lambda t: tables.scan_batch(t("records"), "1997-05-01").orderBy("id").select("id", "business_key"), "SELECT id, business_key FROM records WHERE batch_date = '1997-05-01'")


def partitioned(t: Given) -> DataFrame:
    path = t.folder("records")
    sinks.append_partitioned(t("records"), path)
    table = sinks.read_partitioned(t.spark, path, t("records").schema)
    return tables.scan_partitions(table, "1996_03", "1997_02").select("id", "business_key", "partition_key", "batch_date")


add("S8_scan_partitions", partitioned, "SELECT id, business_key, partition_key, batch_date FROM records WHERE partition_key BETWEEN '1996_03' AND '1997_02'")
add("S9_scan_created", lambda t: tables.scan_created(t("records"), at("1997-01-01"), at("1997-06-30")).select("id", "business_key"), "SELECT id, business_key FROM records WHERE created_at BETWEEN TIMESTAMP '1997-01-01' AND TIMESTAMP '1997-06-30'")
S10 = """WITH big AS (SELECT name, batch_date, count(*) AS n FROM records GROUP BY ROLLUP (name, batch_date) HAVING count(*) > 5)
SELECT b.name, b.batch_date, b.n, count(r.id) AS rows_of_name FROM big b LEFT JOIN records r ON r.name = b.name GROUP BY b.name, b.batch_date, b.n"""
add("S10_guarded_sql", lambda t: tables.guarded_sql(t.spark, S10, {"records": t("records")}), S10)
U2 = "SELECT name FROM (SELECT name, id FROM records WHERE id % 2 = 0) AS a INTERSECT SELECT name FROM (SELECT name, id FROM records WHERE id % 3 = 0) AS b EXCEPT SELECT name FROM (SELECT name, id FROM records WHERE id % 5 = 0) AS c"
add("U2_set_operations", lambda t: tables.guarded_sql(t.spark, U2, {"records": t("records")}), U2)
J13 = "SELECT r.partition_key, count(*) AS n, sum(CASE WHEN d.ack_required THEN 1 ELSE 0 END) AS required FROM records r JOIN dispatches d ON d.id = r.id AND d.attempt_count > 0 GROUP BY r.partition_key"
add("J13_general_join", lambda t: tables.guarded_sql(t.spark, J13, {"records": t("records"), "dispatches": t("dispatches")}), J13.replace("sum(CASE", "CAST(sum(CASE").replace("END) AS required", "END) AS BIGINT) AS required"))
A19 = "SELECT partition_key, description, count(DISTINCT name) AS names, grouping(description) AS g FROM records GROUP BY CUBE (partition_key, description)"
add("A19_grouping_sets", lambda t: tables.guarded_sql(t.spark, A19, {"records": t("records")}).withColumn("g", F.col("g").cast("bigint")), A19)


def listing(t: Given) -> DataFrame:
    n = F.col("page_id")
    name = F.when(n % 3 == 0, F.concat_ws("", n.cast("string"), F.lit(".csv"))).when(n % 3 == 1, F.concat_ws("", n.cast("string"), F.lit(".part"))).otherwise(F.concat_ws("", (n - 2).cast("string"), F.lit(".csv.done")))
    return t("pages").select(F.concat(F.lit("in/"), name).alias("path"), F.when(n % 9 == 0, 0).otherwise(F.length("html")).cast("bigint").alias("length"))


add("S11_ready_files", lambda t: documents.ready_files(listing(t), require_done=True).select("path"), "SELECT 'in/' || CAST(page_id AS STRING) || '.csv' AS path FROM pages WHERE page_id % 3 = 0 AND page_id % 9 <> 0 AND page_id + 2 IN (SELECT page_id FROM pages)")


def fingerprints(t: Given) -> DataFrame:
    path = t.folder("prints")
    t("customer").groupBy("c_nationkey").agg(F.array_join(F.array_sort(F.collect_list("c_name")), "\n").alias("value")).write.partitionBy("c_nationkey").text(path)
    return documents.fingerprint_files(t.spark, path).filter(F.col("name").endswith(".txt")).select(F.col("length"), "file_hash")


add("S12_fingerprint_files", fingerprints, "SELECT CAST(sum(length(c_name) + 1) AS BIGINT) AS length, md5(string_agg(c_name, chr(10) ORDER BY c_name) || chr(10)) AS file_hash FROM customer GROUP BY c_nationkey")


def manifests(t: Given) -> DataFrame:
    path = t.folder("manifests")
    f = F.struct(F.col("expected_file_name").alias("fileName"), F.col("expected_record_count").alias("expectedRecordCount"), F.when(F.col("required"), F.lit(None).cast("boolean")).otherwise(False).alias("required"))
    rows = t("members").groupBy("manifest_id").agg(F.to_json(F.struct(F.first("manifest_id").alias("manifestId"), F.lit("S").alias("sourceSystem"), F.lit("2024-01-01").alias("bizDate"), F.collect_list(f).alias("files"))).alias("value"))
    rows.write.partitionBy("manifest_id").text(path)
    return documents.read_manifests(t.spark, path)


add("S13_read_manifests", lambda t: manifests(t).select("manifest_id", "expected_file_name", "expected_record_count", "required", F.size("errors").alias("errors")), "SELECT manifest_id, expected_file_name, expected_record_count, required, 0 AS errors FROM members")


def streamed_lines(t: Given) -> DataFrame:
    out = t.folder("stream")
    lines = documents.stream_files(t.spark, line_files(t), "value string")
    lines.writeStream.format("parquet").option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start(f"{out}/rows").awaitTermination()
    return t.spark.read.parquet(f"{out}/rows").filter("value != 'id,name,description'").select(F.col("value").alias("line"))


add("S14_stream_files", streamed_lines, f"SELECT id || ',' || name || ',' || description AS line FROM ({RAW_LINES}) AS l")


def plain_lines(t: Given, column, table: str) -> DataFrame:
    path = t.folder("plain")
    t(table).select(column.alias("value")).write.text(path)
    return text.numbered_lines(t.spark, path)


add("S15_normalize_lines", lambda t: text.normalize_lines(plain_lines(t, F.when(F.col("event_id") % 10 == 0, "  ").otherwise(F.concat(F.lit("  "), F.col("event_type"), F.lit(" "), F.col("props"))), "events")).select("line"), "SELECT upper(event_type || ' ' || props) AS line FROM events WHERE event_id % 10 <> 0")
POSITIONAL = "SELECT CAST(o_orderkey AS STRING) || ', ' || o_orderpriority || ',a,b' AS line, o_orderkey, o_orderpriority FROM orders"
add(
    "S16_load_positional",
    lambda t: text.load_positional(plain_lines(t, F.concat(F.col("o_orderkey").cast("string"), F.lit(", "), F.col("o_orderpriority"), F.lit(",a,b")), "orders"), F.lit("src")).select("business_key", "name", "description", "checksum"),
    f"SELECT CAST(o_orderkey AS STRING) AS business_key, o_orderpriority AS name, 'a,b' AS description, sha256(line) AS checksum FROM ({POSITIONAL}) AS p",
)
add("F4_shard", lambda t: text.shard(t("raw"), 1, 4).select("id"), "SELECT id FROM raw WHERE (line_no - 1) % 4 = 1")
add("F5_shard_document", lambda t: text.shard(t("raw").withColumn("ordinal", F.col("id") + 1), 2, 5, "doc").select("id"), "SELECT id FROM raw WHERE id % 5 = 2")

# ---------------------------------------------------------------- sinks

NEW = "SELECT id, business_key, batch_date FROM records WHERE id % 97 = 0"
renamed = lambda t, n: t("records").withColumn("business_key", F.when(F.col("id") % n == 0, F.concat("business_key", F.lit("x"))).otherwise(F.col("business_key")))


def merged(t: Given) -> DataFrame:
    path = t.folder("merge")
    sinks.merge_into(t.spark, path, t("target"), ["id"])
    sinks.merge_into(t.spark, path, t("records"), ["id"])
    sinks.merge_into(t.spark, path, t("records"), ["id"])
    return sinks.read_partitioned(t.spark, path, t("records").schema).select("id", "business_key", "batch_date")


add("K1_merge_insert_new", lambda t: keyed.merge_insert_new(t("target"), t("records"), sinks.KEYS, ["id"]).select("id", "business_key", "batch_date"), NEW)
add("K1_merge_twice", merged, "SELECT id, business_key, batch_date FROM records")
add(
    "K2_merge_upsert",
    lambda t: keyed.merge_upsert(t("target").select("business_key", "id", "description"), renamed(t, 2).select("business_key", (F.col("id") + 1000).alias("id"), F.lit("new").alias("description")), ["business_key"], ["description"]),
    "SELECT business_key, id, CASE WHEN id % 2 <> 0 THEN 'new' ELSE description END AS description FROM records WHERE id % 97 <> 0 UNION ALL SELECT CASE WHEN id % 2 = 0 THEN business_key || 'x' ELSE business_key END, id + 1000, 'new' FROM records WHERE id % 97 = 0 OR id % 2 = 0",
)
add("K3_copy_batch", lambda t: sinks.copy_batch(t("records").drop("partition_key"), t("target"), "1997-05-01", at(ORDERS_NOW)).select("id", "partition_key"), "SELECT id, partition_key FROM records WHERE batch_date = '1997-05-01' AND id % 97 = 0")


def csv_back(t: Given, **options) -> DataFrame:
    path = t.folder("csv")
    sinks.export_csv(t("records").select("id", "business_key", "name", F.when(F.col("id") % 7 != 0, F.col("description")).alias("description"), "batch_date"), path, **options)
    return t.spark.read.options(header=True).schema("id bigint, business_key string, name string, description string, batch_date string").csv(path)


EXPORTED = "SELECT id, business_key, name, CASE WHEN id % 7 <> 0 THEN description END AS description, batch_date FROM records"
add("K4_export_csv", csv_back, EXPORTED)


def plain_back(t: Given) -> DataFrame:
    """Written without quotes and read by the reader of delimited lines."""
    path = t.folder("plain")
    sinks.export_csv(t("records").select("id", F.concat("name", F.lit('"')).alias("name"), F.when(F.col("id") % 7 != 0, F.col("description")).alias("description")), path, plain=True)
    return text.read_delimited(t.spark, path).good.select("id", "name", "description")


add("K4_export_plain", plain_back, "SELECT id, name || '\"' AS name, CASE WHEN id % 7 <> 0 THEN description ELSE '' END AS description FROM records")
add("K5_export_csv_quoted", lambda t: csv_back(t, quote_all=True).withColumn("description", F.nullif("description", F.lit(""))), EXPORTED)
add("K7_export_compressed", lambda t: csv_back(t, compression="gzip"), EXPORTED)


def json_back(t: Given) -> DataFrame:
    path = t.folder("json")
    rows = t("records").select("id", "name", F.when(F.col("id") % 7 != 0, F.col("description")).alias("description"))
    sinks.export_json(rows, path, None)
    return documents.read_json_array(t.spark, path).select("id", "name", "description")


add("K6_export_json", json_back, "SELECT id, name, CASE WHEN id % 7 <> 0 THEN description END AS description FROM records")
add("K6_export_name", lambda t: t("records").select("id", sinks.export_name("batch_date", "json").alias("file")), "SELECT id, 'file_export_' || batch_date || '.json' AS file FROM records")
add(
    "K8_dlq_rows",
    lambda t: sinks.dlq_rows(t("records").withColumn("error", F.repeat("name", 60)).withColumn("description", F.concat(F.lit("a=b&"), F.col("description"))), "import").select("params", "error_message", "retryable"),
    "SELECT 'businessKey=' || business_key || '&batchDate=' || batch_date || '&name=' || name || '&description=a%3Db%26' || description AS params, substr(repeat(name, 60), 1, 1000) AS error_message, true AS retryable FROM records",
)
add("K9_import_trace", lambda t: intake.import_trace(t("records"), t("target"), "import").select("business_key", "event_type", "status", "line_no", "imported_record_partition_id"), "SELECT business_key, 'IMPORT' AS event_type, 'SUCCESS' AS status, line_no, CASE WHEN id % 97 <> 0 THEN id END AS imported_record_partition_id FROM records")
add("K10_export_trace", lambda t: intake.export_trace(t("records").withColumn("business_key", F.when(F.col("id") % 5 != 0, F.col("business_key"))), "export", "f.csv").select("business_key", "event_type", "output_file_name"), "SELECT business_key, 'EXPORT' AS event_type, 'f.csv' AS output_file_name FROM records WHERE id % 5 <> 0")
add("K11_retention", lambda t: filters.retention(t("dlq"), "created_at", 365, at(ORDERS_NOW), F.col("handled"))[1].select("id"), "SELECT id FROM dlq WHERE created_at < TIMESTAMP '2001-08-01' - INTERVAL '365' DAY AND handled")

# ---------------------------------------------------------------- scalar functions

RULES = [mp.Rule("name", "name", "UPPER", None, True), mp.Rule("description", "category", "TRIM"), mp.Rule("created", "created", "DATE_FORMAT", "yyyy/MM/dd"), mp.Rule("description", "note", "DEFAULT", "none"), mp.Rule("description", "low", "LOWER"), mp.Rule("id", "id", "NONE")]


def mapped(t: Given) -> DataFrame:
    rows = t("raw").select("file", "line_no", F.create_map(F.lit("id"), F.col("id").cast("string"), F.lit("name"), F.when(F.col("id") % 40 != 3, F.col("name")).otherwise(" "), F.lit("description"), F.when(F.col("id") % 9 != 0, F.concat(F.lit("\t"), F.col("description"))), F.lit("created"), F.when(F.col("id") % 30 == 1, "soon").otherwise(F.date_format("created_at", "yyyy/MM/dd"))).alias("raw"))
    return rows


MAPPED = "FROM raw WHERE id % 40 <> 3 AND id % 30 <> 1"
add("P1_apply_mapping", lambda t: mp.apply_mapping(mapped(t), RULES)[0].select("name", "category", "created", "note", "low", "id"), f"SELECT upper(name) AS name, CASE WHEN id % 9 <> 0 THEN description END AS category, CAST(CAST(created_at AS DATE) AS STRING) AS created, CASE WHEN id % 9 <> 0 THEN chr(9) || description ELSE 'none' END AS note, CASE WHEN id % 9 <> 0 THEN chr(9) || lower(description) END AS low, CAST(id AS STRING) AS id {MAPPED}")
add("P1_rejected", lambda t: mp.apply_mapping(mapped(t), RULES)[1].select("line_no", "error"), "SELECT line_no, CASE WHEN id % 40 = 3 THEN 'required target field missing: name' ELSE 'not a date: created' END AS error FROM raw WHERE id % 40 = 3 OR id % 30 = 1")


def one_op(name: str, op: str, source, arg: str | None, table: str, sql: str) -> None:
    """One mapping operation over a column of a table."""
    add(name, lambda t: mp.apply_mapping(t(table).select(F.col("id"), source().alias("source")), [mp.Rule("source", "value", op, arg), mp.Rule("id", "id")], raw="", on_error="reject")[0], sql)


one_op("P2_op_none", "NONE", lambda: F.col("description"), None, "raw", "SELECT description AS value, CAST(id AS STRING) AS id FROM raw")
one_op("P3_op_trim", "TRIM", lambda: F.concat(F.lit("\t "), F.col("description"), F.lit(" \n")), None, "raw", "SELECT description AS value, CAST(id AS STRING) AS id FROM raw")
one_op("P4_op_upper", "UPPER", lambda: F.col("name"), None, "raw", "SELECT upper(name) AS value, CAST(id AS STRING) AS id FROM raw")
one_op("P5_op_lower", "LOWER", lambda: F.col("name"), None, "raw", "SELECT lower(name) AS value, CAST(id AS STRING) AS id FROM raw")
one_op("P6_op_default", "DEFAULT", lambda: F.when(F.col("id") % 3 != 0, F.col("name")).otherwise(" "), "none", "raw", "SELECT CASE WHEN id % 3 <> 0 THEN name ELSE 'none' END AS value, CAST(id AS STRING) AS id FROM raw")
one_op("P7_op_date_format", "DATE_FORMAT", lambda: F.date_format("created_at", "dd.MM.yyyy"), "dd.MM.yyyy", "raw", "SELECT CAST(CAST(created_at AS DATE) AS STRING) AS value, CAST(id AS STRING) AS id FROM raw")
add("P8_pack_attributes", lambda t: mp.pack_attributes(t("raw").select("line_no", "name", "description", F.col("batch_date").alias("day"))).select("line_no", "name", F.col("attributes")["day"].alias("day"), F.size("attributes").alias("n")), "SELECT line_no, name, batch_date AS day, 1 AS n FROM raw")
add("P9_standardize", lambda t: mp.standardize(t("raw").withColumn("name", F.when(F.col("id") % 6 != 0, F.col("name")).otherwise(" ")))[0].select("id", "name"), "SELECT id, upper(name) AS name FROM raw WHERE id % 6 <> 0")
add("P10_business_key", lambda t: t("raw").select("id", tx.business_key("batch_date", F.when(F.col("id") % 3 != 0, F.col("name"))).alias("k"), tx.business_key("batch_date", fields=["name", F.when(F.col("id") % 3 != 0, F.col("description"))]).alias("k2")), "SELECT id, CASE WHEN id % 3 <> 0 THEN name ELSE 'unknown' END || ':' || batch_date AS k, name || '|' || CASE WHEN id % 3 <> 0 THEN description ELSE '' END || ':' || batch_date AS k2 FROM raw")
DATES = "SELECT id, CASE id % 5 WHEN 0 THEN batch_date WHEN 1 THEN replace(batch_date, '-', '/') WHEN 2 THEN replace(batch_date, '-', '') WHEN 3 THEN replace(substr(batch_date, 1, 7), '-', '_') ELSE ' ' END AS d, batch_date FROM raw"
dates = lambda t: t("raw").select("id", F.when(F.col("id") % 5 == 0, F.col("batch_date")).when(F.col("id") % 5 == 1, F.replace("batch_date", F.lit("-"), F.lit("/"))).when(F.col("id") % 5 == 2, F.replace("batch_date", F.lit("-"), F.lit(""))).when(F.col("id") % 5 == 3, F.replace(F.substring("batch_date", 1, 7), F.lit("-"), F.lit("_"))).otherwise(" ").alias("d"))
add("P11_partition_key", lambda t: dates(t).select("id", tx.partition_key("d", at(ORDERS_NOW)).alias("k")), f"SELECT id, CASE WHEN id % 5 = 4 THEN '2001_08' ELSE replace(substr(batch_date, 1, 7), '-', '_') END AS k FROM ({DATES}) AS x")
add("P12_format_name", lambda t: t("documents").select("doc_id", tx.format_name("text").alias("name")), "SELECT doc_id, CASE WHEN length(s) > 100 THEN substr(s, 1, 97) || '...' ELSE s END AS name FROM (SELECT doc_id, upper(replace(regexp_replace(regexp_replace(text, '^[\\x00-\\x20]+|[\\x00-\\x20]+$', '', 'g'), '\\s+', ' ', 'g'), 'ß', 'SS')) AS s FROM documents) AS x")
add("P13_format_description", lambda t: t("documents").select("doc_id", tx.format_description("text").alias("description")), "SELECT doc_id, CASE WHEN length(s) > 500 THEN substr(s, 1, 497) || '...' ELSE s END AS description FROM (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(text, '^[\\x00-\\x20]+|[\\x00-\\x20]+$', '', 'g'), '[\\x00-\\x1f\\x7f]', ' ', 'g'), '\\s+', ' ', 'g') AS s FROM documents) AS x")
add("P14_format_batch_date", lambda t: t("raw").select("id", tx.format_batch_date(F.when(F.col("id") % 3 == 0, F.col("batch_date")).when(F.col("id") % 3 == 1, F.concat("batch_date", F.lit("T10:15:30"))).otherwise(F.concat("batch_date", F.lit("x")))).alias("d")), "SELECT id, CASE WHEN id % 3 < 2 THEN batch_date ELSE batch_date || 'x' END AS d FROM raw")
add("P15_batch_date_d", lambda t: dates(t).select("id", tx.batch_date_d("d").cast("string").alias("d")), f"SELECT id, CASE WHEN id % 5 = 0 THEN batch_date END AS d FROM ({DATES}) AS x")
add("P16_fill_dlq_defaults", lambda t: filters.fill_dlq_defaults(t("dlq")).select("id", "compensation_status"), "SELECT id, CASE WHEN handled THEN compensation_status ELSE coalesce(compensation_status, 'OPEN') END AS compensation_status FROM dlq")
add("P17_parse_params", lambda t: t("dlq").select("id", tx.parse_params("params").alias("p")).select("id", F.col("p")["businessKey"].alias("k"), F.col("p")["name"].alias("name"), F.col("p")["note"].alias("note"), F.size("p").alias("n")), "SELECT d.id, r.business_key AS k, CASE WHEN d.id % 8 <> 0 THEN r.name END AS name, 'a&b' AS note, CASE WHEN d.id % 8 <> 0 THEN 4 ELSE 3 END AS n FROM dlq d JOIN records r ON r.id = d.id")
add("P18_render_template", lambda t: t("raw").select("id", tx.render_template(F.lit("in/${batchDate}/${rerunId}.csv"), batchDate="batch_date", rerunId=F.col("id").cast("string")).alias("path")), "SELECT id, 'in/' || batch_date || '/' || CAST(id AS STRING) || '.csv' AS path FROM raw")
add("P19_idempotency_keys", lambda t: t("files").select("id", tx.idem_key_task(F.lit(" job "), "file_no", "batch_date", F.lit(None).cast("string")).alias("task"), tx.idem_key_import(F.lit("job"), "file_no", "batch_date", F.lit("r"), F.col("id") % 4, F.lit(4)).alias("import"), tx.idem_key_inbound("source_system", F.when(F.col("id") % 2 == 0, F.col("batch_date")), "file_hash").alias("inbound")), "SELECT id, 'job|' || file_no || '|' || batch_date || '||*' AS task, 'job|' || file_no || '|' || batch_date || '|r|' || CAST(id % 4 AS STRING) || '/4' AS import, 'INBOUND|' || upper(source_system) || '|' || CASE WHEN id % 2 = 0 THEN batch_date ELSE 'NA' END || '|' || upper(file_hash) AS inbound FROM files")
NAMES = "SELECT page_id AS id, CASE page_id % 6 WHEN 0 THEN 'A.CSV' WHEN 1 THEN 'b.json' WHEN 2 THEN 'c.xlsx.gz' WHEN 3 THEN 'd.zip.PGP' WHEN 4 THEN 'noext' ELSE 'e.xls' END AS name FROM pages"
names = lambda t: t("pages").select(F.col("page_id").alias("id"), F.element_at(F.array(*map(F.lit, ("A.CSV", "b.json", "c.xlsx.gz", "d.zip.PGP", "noext", "e.xls"))), (F.col("page_id") % 6 + 1).cast("int")).alias("name"))
add("P20_file_ext", lambda t: names(t).select("id", tx.file_ext("name").alias("ext")), f"SELECT id, CASE id % 6 WHEN 0 THEN 'csv' WHEN 1 THEN 'json' WHEN 2 THEN 'gz' WHEN 3 THEN 'pgp' WHEN 5 THEN 'xls' END AS ext FROM ({NAMES}) AS n")
add("P21_infer_format", lambda t: names(t).select("id", tx.infer_format("name").alias("kind")), f"SELECT id, CASE WHEN lower(name) LIKE '%.json' THEN 'JSON' WHEN lower(name) LIKE '%.xls' OR lower(name) LIKE '%.xlsx' THEN 'EXCEL' ELSE 'CSV' END AS kind FROM ({NAMES}) AS n")
add("P22_detect_type", lambda t: names(t).select("id", tx.detect_type("name").alias("d")).select("id", "d.encrypted", "d.compression"), f"SELECT id, id % 6 = 3 AS encrypted, CASE id % 6 WHEN 2 THEN 'GZIP' WHEN 3 THEN 'ZIP' ELSE 'PLAIN' END AS compression FROM ({NAMES}) AS n")
add("P23_classify_failure", lambda t: t("dlq").select("id", st.classify_failure("error_message").alias("kind")), "SELECT id, CASE id % 6 WHEN 0 THEN 'RETRYABLE' WHEN 1 THEN 'SKIPPABLE' WHEN 3 THEN 'RETRYABLE' ELSE 'FATAL' END AS kind FROM dlq")
add("P24_classify_sqlstate", lambda t: t("events").select("event_id", st.classify_sqlstate(F.concat(F.lpad((F.col("event_id") % 60).cast("string"), 2, "0"), F.lit("P01"))).alias("kind")), "SELECT event_id, CASE WHEN event_id % 60 IN (8, 40, 57, 53) THEN 'RETRYABLE' WHEN event_id % 60 = 23 THEN 'SKIPPABLE' WHEN event_id % 60 IN (22, 42) THEN 'FATAL' END AS kind FROM events")
add("P25_next_retry_at", lambda t: t("audits").select("id", ms(st.next_retry_at("created_at", F.col("id") % 5000, F.col("id") % 20)).alias("ms")), "SELECT id, epoch_ms(created_at) + least(1800000, greatest(1000, id % 5000) * CAST(pow(2, least(16, id % 20)) AS BIGINT)) AS ms FROM audits")
add("P26_normalize_status", lambda t: t("audits").select("id", st.normalize_status(F.when(F.col("id") % 4 == 0, " ").otherwise(F.concat(F.lit(" "), F.lower("status")))).alias("s")), "SELECT id, CASE WHEN id % 4 = 0 THEN 'READY' ELSE status END AS s FROM audits")
add("P27_derive_run_status", lambda t: t("runs").select("job_execution_id", st.derive_run_status("status", "skip_count").alias("s")), "SELECT job_execution_id, CASE status WHEN 'FAILED' THEN 'FAILED' WHEN 'STOPPED' THEN 'CANCELLED' ELSE CASE WHEN skip_count > 0 THEN 'PARTIAL_SUCCESS' ELSE 'COMPLETED' END END AS s FROM runs")
add("P28_score_runs", lambda t: measures.score_runs(t("runs")).select("job_execution_id", "quality_passed", F.round("throughput_rps", 6).alias("rps"), "final_status"), "SELECT job_execution_id, parse_error_count = 0 AS quality_passed, round(write_count * 1000.0 / greatest(1, duration_ms), 6) AS rps, CASE WHEN status = 'COMPLETED' AND parse_error_count <> 0 THEN 'PARTIAL' ELSE status END AS final_status FROM runs")
add("P29_format_money", lambda t: t("orders").select("o_orderkey", tx.format_money(F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderkey").cast("decimal(20,3)") / 1000)).alias("m")), "SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN '0' ELSE CAST((o_orderkey + 5) // 10 // 100 AS STRING) || '.' || lpad(CAST((o_orderkey + 5) // 10 % 100 AS STRING), 2, '0') END AS m FROM orders")
add("P30_merge_metadata", lambda t: t("events").select("event_id", tx.merge_metadata("props", F.concat(F.lit('{"type":"'), F.col("event_type"), F.lit('"}'))).alias("m")).select("event_id", F.get_json_object("m", "$.type").alias("type"), F.get_json_object("m", "$.k").alias("k")), "SELECT event_id, event_type AS type, CAST(json_extract_string(props, '$.k') AS STRING) AS k FROM events")
add("P31_dispatch_key", lambda t: t("dispatches").select("id", tx.dispatch_key(F.concat(F.lit(" F"), F.col("id").cast("string")), F.when(F.col("id") % 2 == 0, 3), F.concat(F.lit(" s"), F.col("target_system")), F.lit(" host ")).alias("k")), "SELECT id, 'F' || CAST(id AS STRING) || '|' || CASE WHEN id % 2 = 0 THEN '3' ELSE '1' END || '|S' || target_system || '|host' AS k FROM dispatches")
LATE = "SELECT event_id, event_id % 70 * 10000 AS late, event_id % 5 AS attempts FROM events"
late = lambda t: t("events").select("event_id", (F.col("event_id") % 70 * 10000).alias("late"), (F.col("event_id") % 5).alias("attempts"))
add("P32_classify_misfire", lambda t: late(t).select("event_id", st.misfire_action("late", "attempts", 600_000, 3).alias("action"), st.misfire_delay("late", "attempts", 600_000, 5000, 3).alias("delay_ms")), f"SELECT event_id, CASE WHEN attempts >= 3 OR late >= 600000 THEN 'ABANDON' WHEN late < 300000 THEN 'RESCHEDULE' ELSE 'RETRY_LATER' END AS action, CAST(CASE WHEN attempts >= 3 OR late >= 600000 OR late < 150000 THEN 0 WHEN late < 300000 THEN 5000 ELSE 10000 END AS BIGINT) AS delay_ms FROM ({LATE}) AS l")
add("P33_paced_next_run", lambda t: t("audits").select("id", ms(st.paced_next_run("created_at", F.col("id") % 9000, F.col("id") % 6, F.when(F.col("id") % 2 == 0, F.col("created_at")), F.col("created_at"), most_ms=60_000, most_a_minute=3)).alias("ms")), "SELECT id, epoch_ms(created_at) + greatest(CASE WHEN id % 6 > 0 THEN least(60000, greatest(1000, id % 9000) * CAST(pow(2, id % 6) AS BIGINT)) ELSE greatest(1000, id % 9000) END, CASE WHEN id % 2 = 0 THEN 20000 ELSE 0 END) AS ms FROM audits")
add("P34_shard_total", lambda t: t("events").select("event_id", st.shard_total(F.when(F.col("event_id") % 7 == 0, 3), F.col("event_id") % 2 == 0, F.when(F.col("event_id") % 3 == 0, 8), F.col("event_id") % 200).alias("n")), "SELECT event_id, CASE WHEN event_id % 7 = 0 THEN 3 WHEN event_id % 2 = 1 THEN 1 ELSE least(CASE WHEN event_id % 3 = 0 THEN 8 ELSE 4 END, CAST(floor(event_id % 200 / 20) AS BIGINT) + 1) END AS n FROM events")
add("P35_duration_ms", lambda t: t("runs").select("job_execution_id", st.duration_ms("created_at", F.when(F.col("job_execution_id") % 2 == 0, F.timestamp_millis(ms("created_at") + F.col("duration_ms"))), at(ORDERS_NOW)).alias("ms")), "SELECT job_execution_id, CASE WHEN job_execution_id % 2 = 0 THEN duration_ms ELSE greatest(0, epoch_ms(TIMESTAMP '2001-08-01') - epoch_ms(created_at)) END AS ms FROM runs")
KINDS = "CASE event_id % 6 WHEN 0 THEN 'a.RecordValidationException' WHEN 1 THEN 'a.b.TransientImportException' WHEN 2 THEN 'DataAccessException' WHEN 3 THEN 'java.net.SocketTimeoutException' WHEN 4 THEN 'java.io.IOException' ELSE 'x.Other' END"
add("P36_error_code", lambda t: t("events").select("event_id", st.error_code(F.expr(KINDS)).alias("code")), "SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'VALIDATION_FAILED' WHEN 1 THEN 'DB_ERROR' WHEN 2 THEN 'DB_ERROR' WHEN 3 THEN 'NETWORK_ERROR' WHEN 4 THEN 'IO_ERROR' ELSE 'INTERNAL_ERROR' END AS code FROM events")
add("P37_truncate", lambda t: t("documents").select("doc_id", F.md5(tx.truncate("text", 1000).cast("binary")).alias("h")), "SELECT doc_id, md5(substr(text, 1, 1000)) AS h FROM documents")

# ---------------------------------------------------------------- filters

add("F1_has_text", lambda t: t("events").select("event_id", tx.has_text(F.when(F.col("event_id") % 3 == 0, " \t").when(F.col("event_id") % 3 == 1, F.col("event_type"))).alias("ok")), "SELECT event_id, event_id % 3 = 1 AS ok FROM events")
marked = lambda t: t("records").withColumn("business_key", F.when(F.col("id") % 6 == 0, F.concat(F.lit("TEST_"), F.col("business_key"))).when(F.col("id") % 6 != 1, F.col("business_key")))
add("F2_export_filter", lambda t: filters.export_filter(marked(t)).select("id"), "SELECT id FROM records WHERE id % 6 > 1")
add("F3_validate_export", lambda t: filters.validate_export(t("records").withColumn("name", F.when(F.col("id") % 5 != 0, F.col("name"))))[1].select("id", "error"), "SELECT id, CASE WHEN id = 0 THEN 'id' ELSE 'name' END AS error FROM records WHERE id = 0 OR id % 5 = 0")
add("F6_overdue_files", lambda t: filters.overdue_files(t("queue"), 30, at("2024-01-01 03:00:00")).select("id"), "SELECT id FROM queue WHERE expected_process_time < TIMESTAMP '2024-01-01 02:30:00' AND status IN ('RECEIVED', 'WAITING')")
add("F7_retriable_files", lambda t: filters.retriable_files(t("queue"), at("2024-01-01 12:00:00")).select("id"), "SELECT id FROM queue WHERE status = 'FAILED' AND retry_count < 3 AND updated_at < TIMESTAMP '2024-01-01 12:00:00'")
add("F8_timed_out_files", lambda t: filters.timed_out_files(t("files"), 120, 50, at(FILES_NOW)).select("id"), "SELECT id FROM files WHERE status = 'ARRIVED' AND arrived_at < TIMESTAMP '2024-01-02 10:00:00' ORDER BY arrived_at, id LIMIT 50")
add("F9_retriable_dispatches", lambda t: filters.retriable_dispatches(t("distributions"), at("2000-01-01")).select("id"), "SELECT id FROM distributions WHERE status = 'RETRY' AND retry_count < max_retry AND updated_at < TIMESTAMP '2000-01-01'")
add("F10_timed_out_dispatches", lambda t: filters.timed_out_dispatches(t("distributions"), at("1998-01-01")).select("id"), "SELECT id FROM distributions WHERE status IN ('PENDING', 'IN_PROGRESS') AND created_at < TIMESTAMP '1998-01-01'")
add("F11_completed_between", lambda t: filters.completed_between(t("distributions"), at("1997-01-01"), at("1999-01-01")).select("id"), "SELECT id FROM distributions WHERE status = 'COMPLETED' AND completed_at BETWEEN TIMESTAMP '1997-01-01' AND TIMESTAMP '1999-01-01'")
add("F12_ack_timeouts", lambda t: filters.ack_timeouts(t("dispatches"), 60, at("1999-01-01")).select("id"), "SELECT id FROM dispatches WHERE ack_required AND ack_status = 'PENDING' AND coalesce(ack_deadline_at, last_dispatch_time + CASE WHEN coalesce(ack_timeout_minutes, 60) < 1 THEN 120 ELSE coalesce(ack_timeout_minutes, 60) END * INTERVAL '1' MINUTE) <= TIMESTAMP '1999-01-01'")
add("F13_stuck_dispatches", lambda t: filters.stuck_dispatches(t("dispatches"), 60, 50, at(ORDERS_NOW)).select("id"), "SELECT id FROM dispatches WHERE dispatch_status = 'DISPATCHING' AND ack_status = 'PENDING' AND last_dispatch_time < TIMESTAMP '2001-07-31 23:00:00' ORDER BY last_dispatch_time, id LIMIT 50")
add("F14_dlq_candidates", lambda t: filters.dlq_candidates(t("dlq"), at("1999-01-01")).select("id"), "SELECT id FROM dlq WHERE NOT handled AND retryable AND NOT manual_required AND next_retry_at < TIMESTAMP '1999-01-01' ORDER BY created_at, id LIMIT 100")
STALE = "FROM states WHERE status IN ('RUNNING', 'BLOCKED') AND updated_at < TIMESTAMP '2024-01-30 00:00:00' AND NOT (status = 'RUNNING' AND coalesce(window_end > TIMESTAMP '2024-01-31 00:00:00', false))"
add("F15_stale_states", lambda t: filters.stale_states(t("states"), 86_400_000, at(EVENTS_NOW))[0], f"SELECT task_id, batch_date, rerun_id, 'FAILED' AS status, 'stale ' || status AS last_error {STALE}")
add("F15_stale_dlq", lambda t: filters.stale_states(t("states"), 86_400_000, at(EVENTS_NOW))[1], f"SELECT task_id AS job_name, 'batchDate=' || batch_date || '&rerunId=' AS params, 'STALE_STATE' AS error_code, true AS retryable {STALE}")
add("F16_misfires", lambda t: filters.misfires(t("states"), at("2024-01-20")).select("task_id", "batch_date"), "SELECT task_id, batch_date FROM states WHERE status = 'READY' AND next_retry_at < TIMESTAMP '2024-01-20' ORDER BY next_retry_at, task_id LIMIT 100")
add("F17_contains_text", lambda t: filters.contains_text(t("dlq"), "params", "000012").select("id"), "SELECT id FROM dlq WHERE contains(params, '000012')")


def found_by_index(t: Given) -> DataFrame:
    """Texts looked up in whole documents by the index of trigrams, a rare and a frequent one among them."""
    path = t.folder("index")
    textindex.build_index(t("documents").select("doc_id", "text"), "text", path)
    parts = [textindex.find(t.spark, path, "text", needle).select(F.lit(needle).alias("needle"), "doc_id") for needle in NEEDLES]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


NEEDLES = ("password", "License, Version", "the ")
add("F17_indexed_search", found_by_index, " UNION ALL ".join(f"SELECT '{n}' AS needle, doc_id FROM documents WHERE contains(text, '{n}')" for n in NEEDLES))
add("F18_search_files", lambda t: filters.search_files(t("files"), source="src3", date="2024-01-02").select("id"), "SELECT id FROM files WHERE source_system = 'src3' AND batch_date = '2024-01-02'")
CAL = cal.Calendar(("2024-01-15", "01-20"), True, (("22:00:00", "05:30:00"), ("12:00:00", "12:59:59")))
EXCLUDED = "(strftime({c}, '%Y-%m-%d') = '2024-01-15' OR strftime({c}, '%m-%d') = '01-20' OR dayofweek({c}) IN (0, 6) OR strftime({c}, '%H:%M:%S') >= '22:00:00' OR strftime({c}, '%H:%M:%S') <= '05:30:00' OR strftime({c}, '%H:%M:%S') BETWEEN '12:00:00' AND '12:59:59')"
add("F19_is_excluded", lambda t: t("audits").select("id", cal.is_excluded("created_at", CAL).alias("out")), f"SELECT id, {EXCLUDED.format(c='created_at')} AS out FROM audits")
MINUTES = f"SELECT id, m, min(k) AS k FROM (SELECT id, date_trunc('second', created_at) AS m, k, date_trunc('second', created_at) + k * INTERVAL '1' MINUTE AS c FROM audits, range(0, 10080) AS g(k)) AS x WHERE NOT {EXCLUDED.format(c='c')} GROUP BY id, m"
add("F20_next_available", lambda t: t("audits").select("id", F.unix_seconds(cal.next_available(F.date_trunc("second", "created_at"), CAL)).alias("s")), f"SELECT a.id, CAST(epoch(coalesce(x.m + x.k * INTERVAL '1' MINUTE, date_trunc('second', a.created_at) + INTERVAL '7' DAY)) AS BIGINT) AS s FROM audits a LEFT JOIN ({MINUTES}) AS x ON x.id = a.id")
add("F21_assert_max_rows", lambda t: filters.assert_max_rows(t("records"), 1 << 30).agg(F.count("*").alias("n")), "SELECT count(*) AS n FROM records")
add("F22_executions", lambda t: filters.executions(t("audits").withColumn("start_time", F.col("created_at")), day=F.to_date(F.lit("2024-01-10")), statuses=["FAILED", "SUCCESS"]).select("id"), "SELECT id FROM audits WHERE CAST(created_at AS DATE) = DATE '2024-01-10' AND status IN ('FAILED', 'SUCCESS')")
add("F23_audit", lambda t: filters.audit(t("audits"), task="t7", start=at("2024-01-05"), end=at("2024-01-25")).select("id"), "SELECT id FROM audits WHERE task_id = 't7' AND created_at BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-25'")
add("F24_where_eq", lambda t: filters.where_eq(t("dispatches"), target_system="S2", ack_status="PENDING").select("id"), "SELECT id FROM dispatches WHERE target_system = 'S2' AND ack_status = 'PENDING'")

# ---------------------------------------------------------------- joins

add("J1_lookup_ids", lambda t: keyed.lookup_ids(renamed(t, 5).select("business_key"), t("target")), "SELECT business_key, id FROM records WHERE id % 5 <> 0 AND id % 97 <> 0")
add("J2_source_only", lambda t: keyed.key_diff(renamed(t, 3), t("target")).filter("diff_type = 'SOURCE_ONLY'"), "SELECT CASE WHEN id % 3 = 0 THEN business_key || 'x' ELSE business_key END AS business_key, 'SOURCE_ONLY' AS diff_type FROM records WHERE id % 97 = 0 OR id % 3 = 0")
add("J3_target_only", lambda t: keyed.key_diff(renamed(t, 5), t("target")).filter("diff_type = 'TARGET_ONLY'"), "SELECT business_key, 'TARGET_ONLY' AS diff_type FROM records WHERE id % 97 <> 0 AND id % 5 = 0")
LATEST = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY created_at DESC, id DESC) AS n FROM instances WHERE biz_date = '2024-01-10') AS x WHERE n = 1"
asked = lambda t: t("events").select(F.concat(F.lit("t"), F.col("user_id").cast("string")).alias("task_id")).distinct()
add("J4_subset_candidates", lambda t: keyed.replay_candidates(t("instances"), "2024-01-10", "SUBSET", asked(t)).select("task_id", "id", "status"), f"SELECT a.task_id, l.id, l.status FROM (SELECT DISTINCT task_id FROM instances) AS a LEFT JOIN ({LATEST}) AS l ON l.task_id = a.task_id")
entries = lambda t: t("audits").select(F.col("run_key").alias("session_id"), "task_id", "batch_date", F.lit("").alias("rerun_id"), F.lit("RUNNING").alias("status"))
ENTRY = "SELECT a.run_key AS session_id, a.task_id, a.batch_date, CASE WHEN s.status = 'SUCCESS' THEN 'SUCCEEDED' WHEN s.status = 'SKIPPED' THEN 'SKIPPED' WHEN s.status IN ('FAILED', 'PARTIAL') THEN 'FAILED' ELSE 'RUNNING' END AS status FROM audits a LEFT JOIN states s ON s.task_id = a.task_id AND s.batch_date = a.batch_date"
add("J5_replay_entries", lambda t: replay.replay_entries(entries(t), t("states")).select("session_id", "task_id", "batch_date", "status"), ENTRY)
policies = lambda t: t("files").select("file_direction").distinct().select("file_direction", F.when(F.col("file_direction") == "INBOUND", 1).otherwise(2).alias("retention_days"))
add(
    "J6_archivable_files",
    lambda t: intake.archivable_files(t("files"), policies(t), t("dispatches").withColumn("dispatch_status", F.when(F.col("id") % 3 == 0, F.col("dispatch_status")).otherwise("DISPATCHED")), t("queue"), t("members"), at("2024-01-06")).select("id"),
    "SELECT id FROM files WHERE status IN ('PROCESSED', 'DISPATCHED') AND processed_at < CASE WHEN file_direction = 'INBOUND' THEN TIMESTAMP '2024-01-05' ELSE TIMESTAMP '2024-01-04' END AND id NOT IN (SELECT file_record_id FROM dispatches WHERE id % 3 = 0 AND dispatch_status IN ('PENDING', 'DISPATCHING', 'RETRY')) AND id NOT IN (SELECT file_record_id FROM queue WHERE status IN ('RECEIVED', 'WAITING', 'PROCESSING') AND file_record_id IS NOT NULL) AND id NOT IN (SELECT file_record_id FROM members WHERE open)",
)
BOUND = "SELECT m.manifest_id, m.expected_file_name, m.expected_record_count, m.required, q.id AS actual_queue_id, q.record_count AS actual_record_count FROM members m LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY file_name ORDER BY created_at, id) AS n FROM queue) AS y WHERE n = 1) AS q ON q.file_name = m.expected_file_name"
add("J7_bind_arrivals", lambda t: intake.bind_arrivals(t("members"), t("queue")).select("manifest_id", "expected_file_name", "actual_queue_id"), f"SELECT manifest_id, expected_file_name, actual_queue_id FROM ({BOUND}) AS b")
NEWEST = "SELECT * FROM scored ORDER BY created_at DESC, job_execution_id DESC LIMIT 200"
add("J8_sla_breaches", lambda t: measures.sla_breaches(t("scored"), t("tasks_sla")).select("job_execution_id", "duration_ms", "sla_ms"), f"SELECT r.job_execution_id, r.duration_ms, l.sla_ms FROM ({NEWEST}) AS r JOIN (SELECT job_name, min(sla_ms) AS sla_ms FROM tasks_sla GROUP BY job_name) AS l ON l.job_name = r.job_name WHERE r.duration_ms > l.sla_ms")
KEY = "CUSTOMER#000000012:1997-05-01"


def traced(t: Given) -> DataFrame:
    r = t("records").select("business_key", "created_at", "id", F.col("description").alias("detail"))
    d = t("dlq").select(F.lit(None).cast("string").alias("business_key"), "created_at", "id", F.col("params").alias("detail"))
    return intake.trace_key({"TRACE": r, "IMPORT": t("target").select(*r.columns[:3], F.col("description").alias("detail")), "DLQ": d}, "CUSTOMER#000000012").unionByName(intake.trace_key({"IMPORT": r}, KEY)).select("kind", "id", "detail")


add("J9_trace_key", traced, f"SELECT 'DLQ' AS kind, id, params AS detail FROM (SELECT * FROM dlq WHERE contains(params, 'CUSTOMER#000000012') ORDER BY created_at DESC, id DESC LIMIT 50) AS d UNION ALL SELECT 'IMPORT', id, description FROM records WHERE business_key = '{KEY}'")
add("J10_file_detail", lambda t: intake.file_detail(t("files"), t("audits").select("id", (F.col("id") % 100).alias("file_record_id"), "created_at", "status"), t("dispatches")).select("id", F.coalesce(F.size("logs"), F.lit(0)).alias("logs"), F.coalesce(F.size("dispatches"), F.lit(0)).alias("sent"), F.element_at("logs", -1)["status"].alias("last_status")), "SELECT f.id, CAST(coalesce(l.n, 0) AS INT) AS logs, CAST(coalesce(d.n, 0) AS INT) AS sent, l.s AS last_status FROM files f LEFT JOIN (SELECT id % 100 AS k, count(*) AS n, arg_max(status, (created_at, id)) AS s FROM audits GROUP BY 1) AS l ON l.k = f.id LEFT JOIN (SELECT file_record_id, count(*) AS n FROM dispatches GROUP BY 1) AS d ON d.file_record_id = f.id")
add("J11_backfill_assets", lambda t: intake.backfill_assets(t("queue"), t("files").select("file_no", "stored_path", "file_hash", "source_system"))[0].select("file_no", "source_system"), "SELECT file_no, source_system FROM files UNION ALL SELECT 'BF-' || CAST(id AS STRING), source_system FROM queue WHERE file_record_id IS NULL")
deps = lambda t: t("events").select("user_id").distinct().select(F.concat(F.lit("t"), F.col("user_id").cast("string")).alias("task_id"), F.concat(F.lit("t"), F.floor(F.col("user_id") / 2).cast("string")).alias("depends_on"), F.when(F.col("user_id") % 3 == 0, "SKIP").when(F.col("user_id") % 3 == 1, "").otherwise("ignore").alias("action"), F.when(F.col("user_id") % 5 == 0, 5000).cast("bigint").alias("timeout_ms"), F.when(F.col("user_id") % 2 == 0, -1).alias("offset_days"), F.lit(0).alias("ordinal"))
waiting = lambda t: t("states").select("task_id", "batch_date", "rerun_id", F.when(F.col("task_id").endswith("5"), 6000).otherwise(100).cast("bigint").alias("waited_ms"))
add(
    "J12_dependency_state",
    lambda t: graph.dependency_state(waiting(t), deps(t), t("states"), 7000),
    """SELECT w.task_id, w.batch_date, CASE WHEN w.waited > CASE WHEN w.u % 5 = 0 THEN 5000 ELSE 7000 END THEN 'FAILED' WHEN s.status IS NULL THEN 'WAITING' WHEN s.status IN ('FAILED', 'PARTIAL') THEN CASE w.u % 3 WHEN 0 THEN 'SKIPPED' WHEN 1 THEN 'FAILED' ELSE 'READY' END WHEN s.status <> 'SUCCESS' THEN 'WAITING' ELSE 'READY' END AS state
    FROM (SELECT task_id, batch_date, CAST(substr(task_id, 2) AS BIGINT) AS u, CASE WHEN task_id LIKE '%5' THEN 6000 ELSE 100 END AS waited FROM states) AS w
    LEFT JOIN states s ON s.task_id = 't' || CAST(CAST(floor(w.u / 2) AS BIGINT) AS STRING) AND CAST(s.batch_date AS DATE) = CAST(w.batch_date AS DATE) - CASE WHEN w.u % 2 = 0 THEN INTERVAL '1' DAY ELSE INTERVAL '0' DAY END""",
)
add("J14_insert_where_absent", lambda t: keyed.insert_where_absent(t("target"), renamed(t, 2), ["business_key"]).select("id"), "SELECT id FROM records WHERE id % 97 <> 0 UNION ALL SELECT id FROM records WHERE id % 97 = 0 OR id % 2 = 0")

# ---------------------------------------------------------------- measures

add("A1_count_by", lambda t: measures.count_by(t("records"), "partition_key"), "SELECT partition_key, count(*) AS n FROM records GROUP BY partition_key")
add("A2_missing_count", lambda t: measures.missing_count(t("dlq").withColumn("name", F.when(F.col("id") % 8 != 0, F.col("params")).otherwise(" ")), "name"), "SELECT count(*) AS missing FROM dlq WHERE id % 8 = 0")
add("A3_duplicate_groups", lambda t: measures.duplicate_groups(t("raw"), ["name", "batch_date"]), "SELECT count(*) AS duplicate_groups FROM (SELECT name, batch_date FROM raw GROUP BY name, batch_date HAVING count(*) > 1) AS g")
MEAN = f"(SELECT coalesce(avg(throughput_rps), 0) FROM ({NEWEST}) AS n)"
add("A4_dashboard", lambda t: measures.dashboard(t("scored"), t("dlq"), t("states"), at("1998-01-02"), 24 * 30).select("failed", "completed", "partial", "dlq_backlog", "blocked", "running", "ready", F.round("mean_throughput", 6).alias("mean_throughput"), F.round("failure_rate", 9).alias("failure_rate")), f"""SELECT failed, completed, partial, (SELECT count(*) FROM dlq WHERE NOT handled) AS dlq_backlog, (SELECT count(*) FROM states WHERE status = 'BLOCKED') AS blocked, (SELECT count(*) FROM states WHERE status = 'RUNNING') AS running, (SELECT count(*) FROM states WHERE status = 'READY') AS ready, round({MEAN}, 6) AS mean_throughput, round(failed / CAST(failed + completed + partial AS DOUBLE), 9) AS failure_rate
    FROM (SELECT count(*) FILTER (WHERE status = 'FAILED') AS failed, count(*) FILTER (WHERE status = 'COMPLETED') AS completed, count(*) FILTER (WHERE status = 'PARTIAL') AS partial FROM scored WHERE created_at BETWEEN TIMESTAMP '1998-01-02' - INTERVAL '30' DAY AND TIMESTAMP '1998-01-02') AS c""")
add("A5_batch_metrics", lambda t: measures.batch_metrics(t("scored"), t("dlq"), t("states"), t("tasks_sla"), at("1998-01-02"), 15 * 1440).select("failed", "completed", "dlq", "dlq_manual", "retry_pending", "blocked", F.round("mean_throughput", 6).alias("mean_throughput"), "sla_breaches"), f"""SELECT (SELECT count(*) FROM scored WHERE status = 'FAILED' AND created_at BETWEEN TIMESTAMP '1997-12-18' AND TIMESTAMP '1998-01-02') AS failed, (SELECT count(*) FROM scored WHERE status = 'COMPLETED' AND created_at BETWEEN TIMESTAMP '1997-12-18' AND TIMESTAMP '1998-01-02') AS completed, count(*) FILTER (WHERE NOT handled) AS dlq, count(*) FILTER (WHERE NOT handled AND manual_required) AS dlq_manual, count(*) FILTER (WHERE NOT handled AND retryable) AS retry_pending, (SELECT count(*) FROM states WHERE status = 'BLOCKED') AS blocked, round({MEAN}, 6) AS mean_throughput,
    (SELECT count(*) FROM ({NEWEST}) AS r JOIN (SELECT job_name, min(sla_ms) AS sla_ms FROM tasks_sla GROUP BY job_name) AS l ON l.job_name = r.job_name WHERE r.duration_ms > l.sla_ms) AS sla_breaches FROM dlq""")
add("A6_file_metrics", lambda t: measures.file_metrics(t("files"), t("dispatches"), t("dlq"), at(FILES_NOW)), """SELECT count(*) FILTER (WHERE i) AS received, count(*) FILTER (WHERE i AND status IN ('PROCESSED', 'DISPATCHED', 'ARCHIVED')) AS processed, count(*) FILTER (WHERE i AND status = 'FAILED') AS failed, count(*) FILTER (WHERE i AND status = 'PROCESSING') AS processing, count(*) FILTER (WHERE i AND status IN ('ARRIVED', 'READY') AND arrived_at < TIMESTAMP '2024-01-01 12:00:00') AS pending_old, count(*) FILTER (WHERE archived) AS archived,
    (SELECT count(*) FROM dispatches) AS dispatch_total, (SELECT count(*) FROM dispatches WHERE dispatch_status = 'DISPATCHED') AS dispatch_dispatched, (SELECT count(*) FROM dispatches WHERE dispatch_status = 'FAILED') AS dispatch_failed, (SELECT count(*) FROM dispatches WHERE dispatch_status = 'DISPATCHING') AS dispatch_dispatching, (SELECT count(*) FROM dispatches WHERE ack_status = 'TIMEOUT') AS ack_timeout, (SELECT count(*) FROM dlq WHERE NOT handled) AS dlq_open FROM (SELECT *, file_direction = 'INBOUND' AS i FROM files) AS f""")
add("A7_reception_stats", lambda t: measures.status_counts(t("queue"), ["RECEIVED", "WAITING", "FAILED", "PROCESSED"]), "SELECT count(*) AS total, count(*) FILTER (WHERE status = 'RECEIVED') AS received, count(*) FILTER (WHERE status = 'WAITING') AS waiting, count(*) FILTER (WHERE status = 'FAILED') AS failed, count(*) FILTER (WHERE status = 'PROCESSED') AS processed FROM queue")
add("A8_distribution_stats", lambda t: measures.status_counts(t("distributions"), ["PENDING", "RETRY", "COMPLETED"]), "SELECT count(*) AS total, count(*) FILTER (WHERE status = 'PENDING') AS pending, count(*) FILTER (WHERE status = 'RETRY') AS retry, count(*) FILTER (WHERE status = 'COMPLETED') AS completed FROM distributions")
add("A9_task_stats", lambda t: measures.task_stats(t("audits"), "t7", 24 * 20, at(EVENTS_NOW)), "SELECT *, CASE WHEN total = 0 THEN 'N/A' ELSE printf('%.2f%%', success * 100.0 / total) END AS rate FROM (SELECT count(*) FILTER (WHERE status = 'SUCCESS') AS success, count(*) FILTER (WHERE status = 'FAILED') AS failed, count(*) AS total FROM audits WHERE task_id = 't7' AND created_at >= TIMESTAMP '2024-01-11') AS s")
add("A10_execution_counts", lambda t: measures.execution_counts(t("audits")), "SELECT task_id, count(*) AS total, count(*) FILTER (WHERE status = 'SUCCESS') AS success, count(*) FILTER (WHERE status = 'FAILED') AS failed FROM audits GROUP BY task_id")
add("A11_rollup_steps", lambda t: measures.rollup_steps(t("lineitem").select((F.col("l_orderkey") % 1000).alias("job_execution_id"), F.col("l_linenumber").cast("bigint").alias("read_count"), F.col("l_quantity").cast("bigint").alias("write_count"))), "SELECT l_orderkey % 1000 AS job_execution_id, CAST(sum(l_linenumber) AS BIGINT) AS read_count, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS write_count FROM lineitem GROUP BY 1")
add("A12_rollup_shards", lambda t: measures.rollup_shards(t("audits"), "task_id"), "SELECT task_id, CASE WHEN count(*) FILTER (WHERE status = 'SUCCESS') = count(*) THEN 'SUCCESS' WHEN count(*) FILTER (WHERE status = 'SUCCESS') > 0 THEN 'PARTIAL' ELSE 'FAILED' END AS status FROM audits GROUP BY task_id")
add("A13_rollup_dag", lambda t: measures.rollup_dag(t("audits").withColumn("run_key", F.concat_ws("/", "task_id", "batch_date"))), "SELECT task_id || '/' || batch_date AS run_key, CASE WHEN bool_or(status = 'FAILED') THEN 'FAILED' WHEN bool_or(status IN ('PARTIAL', 'SKIPPED')) THEN 'PARTIAL' ELSE 'SUCCESS' END AS status FROM audits GROUP BY 1")
add("A14_coverage", lambda t: measures.coverage(t("queue")).withColumn("coverage", F.round("coverage", 9)), "SELECT count(*) AS total, count(file_record_id) AS linked, round(count(file_record_id) * 100.0 / count(*), 9) AS coverage, count(file_record_id) = count(*) AS ready FROM queue")
add("A15_export_stats", lambda t: jobs.export_summary(marked(t)).withColumn("success_rate", F.round("success_rate", 9)), "SELECT count(*) AS processed, count(*) FILTER (WHERE id % 6 < 2) AS filtered, CAST(0 AS BIGINT) AS errors, count(*) FILTER (WHERE id % 6 > 1) AS transformed, round(count(*) FILTER (WHERE id % 6 > 1) * 100.0 / count(*), 9) AS success_rate FROM records")
add("A16_content_fingerprint", lambda t: measures.content_fingerprint(t("documents"), "text"))
add("A17_ordered_md5", lambda t: ordering.ordered_md5(reconcile.canonical(t("records"), keep=("batch_date",)), by=("batch_date",)), "SELECT batch_date, md5(string_agg(business_key || ',' || name || ',' || description, chr(10) ORDER BY business_key || ',' || name || ',' || description) || chr(10)) AS hash FROM records GROUP BY batch_date")
TREE = """WITH RECURSIVE t AS (SELECT 0 AS level, row_number() OVER (ORDER BY r) - 1 AS place, r AS row, count(*) OVER () AS n FROM (SELECT business_key || ',' || name || ',' || description AS r FROM records) AS c
    UNION ALL SELECT level + 1, place // 256, md5(string_agg(row, chr(10) ORDER BY place) || chr(10)), (n + 255) // 256 FROM t WHERE level = 0 OR n > 1 GROUP BY level, place // 256, n)
    SELECT row AS hash FROM t WHERE level > 0 AND n = 1"""
add("A17_tree_digest", lambda t: ordering.ordered_md5(reconcile.canonical(t("records")), run=256), TREE)
add("A18_verify_counts", lambda t: measures.verify_counts({"records": t("records"), "raw": t("raw")}, "1997-05-01"), "SELECT 'records' AS name, count(*) AS n FROM records WHERE batch_date = '1997-05-01' UNION ALL SELECT 'raw', count(*) FROM raw WHERE batch_date = '1997-05-01'")
add("A20_pending_count", lambda t: measures.pending_count(t("files"), 24, at(FILES_NOW)), "SELECT count(*) AS pending FROM files WHERE status IN ('ARRIVED', 'READY') AND arrived_at < TIMESTAMP '2024-01-01 12:00:00'")
add("A21_params_to_map", lambda t: measures.params_to_map(t("lineitem").select(F.col("l_orderkey").alias("task_id"), F.concat(F.lit("p"), F.col("l_linenumber").cast("string")).alias("name"), F.col("l_returnflag").alias("value")).groupBy("task_id", "name").agg(F.max("value").alias("value"))).select("task_id", "text", F.size("params").alias("n")), "SELECT task_id, string_agg(name || '=' || value, '&' ORDER BY name) AS text, CAST(count(*) AS INT) AS n FROM (SELECT l_orderkey AS task_id, 'p' || CAST(l_linenumber AS STRING) AS name, max(l_returnflag) AS value FROM lineitem GROUP BY 1, 2) AS p GROUP BY task_id")
add("A22_dlq_counts", lambda t: measures.dlq_counts(t("dlq")), "SELECT compensation_status, count(*) FILTER (WHERE NOT handled) AS open, count(*) FILTER (WHERE NOT handled AND manual_required) AS manual FROM dlq GROUP BY compensation_status")

# ---------------------------------------------------------------- by key, order, sets

add("W1_dedup_keep_first", lambda t: keyed.dedup_keep_first(t("audits"), ["task_id", "status", F.coalesce((F.col("id") % 3), F.lit(-1))], ["id"]).select("id"), "SELECT min(id) AS id FROM audits GROUP BY task_id, status, id % 3")
add("W2_latest_per_key", lambda t: keyed.latest_per_key(t("instances").filter("biz_date = '2024-01-10'"), ["task_id"], "created_at", "id").select("task_id", "id"), f"SELECT task_id, id FROM ({LATEST}) AS l")
add("W3_replay_candidates", lambda t: keyed.replay_candidates(t("instances"), "2024-01-10", "ALL_FAILED").select("task_id", "id", "status").unionByName(keyed.replay_candidates(t("instances"), "2024-01-10", "ALL").select("task_id", "id", "status")), f"SELECT task_id, id, status FROM ({LATEST}) AS l WHERE status IN ('FAILED', 'TIMEOUT', 'PARTIAL_SUCCESS') UNION ALL SELECT task_id, id, status FROM ({LATEST}) AS l WHERE status IN ('COMPLETED', 'PARTIAL_SUCCESS', 'FAILED', 'CANCELLED', 'TIMEOUT')")
add("W4_version_files", lambda t: keyed.version_files(t("files")).select("id", "version_no", "parent_file_id", "latest_version"), "SELECT id, CAST(row_number() OVER w AS INT) AS version_no, lag(id) OVER w AS parent_file_id, lead(id) OVER w IS NULL AS latest_version FROM files WINDOW w AS (PARTITION BY stored_path ORDER BY created_at, id)")
add("W5_dedup_batch", lambda t: keyed.dedup_batch(t("raw"), ["name", "batch_date"], ["line_no"])[1].select("id"), "SELECT id FROM (SELECT id, row_number() OVER (PARTITION BY name, batch_date ORDER BY line_no) AS n FROM raw) AS x WHERE n > 1")
LOG = "SELECT id, file_record_id, created_at, CASE s WHEN 0 THEN 'ARRIVED' WHEN 1 THEN 'READY' WHEN 2 THEN 'PROCESSING' WHEN 3 THEN 'PROCESSED' ELSE 'FAILED' END AS status FROM (SELECT id, id % 100 AS file_record_id, created_at, (id + CAST(floor(id / 100) AS BIGINT)) % 5 AS s FROM audits) AS a"
log = lambda t: t.spark.sql(LOG.replace("FROM audits", "FROM {audits}"), audits=t("audits"))
add("W6_invalid_transitions", lambda t: keyed.invalid_transitions(log(t)).select("id", "status_from", "status"), f"SELECT id, status_from, status FROM (SELECT *, lag(status) OVER (PARTITION BY file_record_id ORDER BY created_at, id) AS status_from FROM ({LOG}) AS l) AS x WHERE status_from <> status AND NOT (status_from, status) IN (('ARRIVED', 'READY'), ('ARRIVED', 'FAILED'), ('READY', 'PROCESSING'), ('READY', 'FAILED'), ('PROCESSING', 'PROCESSED'), ('PROCESSING', 'FAILED'), ('FAILED', 'READY'), ('FAILED', 'PROCESSED'))")
add("W7_state_times", lambda t: keyed.state_times(log(t), "file_record_id", "created_at", {"arrived_at": "ARRIVED", "processed_at": "PROCESSED"}).select("file_record_id", ms("arrived_at").alias("a"), ms("processed_at").alias("p")), f"SELECT file_record_id, epoch_ms(min(created_at) FILTER (WHERE status = 'ARRIVED')) AS a, epoch_ms(min(created_at) FILTER (WHERE status = 'PROCESSED')) AS p FROM ({LOG}) AS l GROUP BY file_record_id")
add("W8_failure_streak", lambda t: keyed.failure_streak(t("audits")).select("id", F.col("streak").cast("bigint").alias("streak")), "SELECT id, CAST(least(10, coalesce(sum(CASE WHEN status = 'FAILED' THEN 1 ELSE 0 END) OVER (PARTITION BY task_id, run ORDER BY created_at, id), 0)) AS BIGINT) AS streak FROM (SELECT *, sum(CASE WHEN status = 'SUCCESS' THEN 1 ELSE 0 END) OVER (PARTITION BY task_id ORDER BY created_at, id) AS run FROM audits) AS x")
add("W9_latest_snapshot", lambda t: t("audits").groupBy("batch_date").agg(F.max_by("id", F.struct("created_at", "id")).alias("id")), "SELECT batch_date, arg_max(id, (created_at, id)) AS id FROM audits GROUP BY batch_date")
alert_rows = lambda t: t("audits").select("id", F.col("status").alias("alert_code"), F.when(F.col("id") % 4 != 0, F.col("id") % 30).alias("file_record_id"), F.when(F.col("id") % 5 != 0, F.col("run_key")).alias("target_system"), "created_at", F.when(F.col("value") > 50, "CRITICAL").when(F.col("value") > 20, "WARNING").otherwise("INFO").alias("severity"))
ALERTS = "SELECT id, status AS alert_code, CASE WHEN id % 4 <> 0 THEN id % 30 END AS file_record_id, CASE WHEN id % 5 <> 0 THEN run_key END AS target_system, created_at, CASE WHEN value > 50 THEN 3 WHEN value > 20 THEN 1 ELSE 0 END AS rank FROM audits"
add("W10_open_alerts", lambda t: keyed.open_alerts(alert_rows(t)).select("id"), f"SELECT id FROM (SELECT id, row_number() OVER (PARTITION BY alert_code, file_record_id, target_system ORDER BY created_at DESC, id DESC) AS n FROM ({ALERTS}) AS a) AS x WHERE n = 1")
add("W11_latest_per_file", lambda t: keyed.latest_per_key(t("instances"), ["related_file_id"], "created_at", "id").select("related_file_id", "id"), "SELECT related_file_id, arg_max(id, (created_at, id)) AS id FROM instances GROUP BY related_file_id")
job_runs = lambda t: t("runs").withColumn("job_name", F.concat(F.lit("job"), (F.col("job_execution_id") % 500).cast("string"))).withColumn("status", F.when(F.col("job_execution_id") % 37 == 5, "STARTED").otherwise(F.col("status")))
add("W12_restart_candidates", lambda t: keyed.restart_candidates(job_runs(t)).select("job_name", "job_execution_id"), "WITH j AS (SELECT job_execution_id, 'job' || CAST(job_execution_id % 500 AS STRING) AS job_name, CASE WHEN job_execution_id % 37 = 5 THEN 'STARTED' ELSE status END AS status, created_at FROM runs) SELECT job_name, arg_max(job_execution_id, (created_at, job_execution_id)) AS job_execution_id FROM j WHERE status IN ('FAILED', 'STOPPED') AND job_name NOT IN (SELECT job_name FROM j WHERE status IN ('STARTING', 'STARTED')) GROUP BY job_name")
add("W13_order_steps", lambda t: keyed.order_steps(t("audits").select(F.col("run_key").alias("job_execution_id"), F.when(F.col("id") % 5 != 0, F.col("created_at")).alias("start_time"), F.concat(F.lit("s"), F.lpad(F.col("id").cast("string"), 9, "0")).alias("step_name"), "id")).select("id", "step_order"), "SELECT id, CAST(row_number() OVER (PARTITION BY run_key ORDER BY CASE WHEN id % 5 <> 0 THEN created_at END NULLS LAST, lpad(CAST(id AS STRING), 9, '0')) AS INT) AS step_order FROM audits")
add("O1_newest_rows", lambda t: keyed.top_n(t("runs"), [F.desc("created_at"), F.desc("job_execution_id")], 100).select("job_execution_id"), "SELECT job_execution_id FROM runs ORDER BY created_at DESC, job_execution_id DESC LIMIT 100")
add("O2_first_rows", lambda t: keyed.top_n(t("audits").filter("run_key = 'r3'"), [F.asc("id")], 50).select("id"), "SELECT id FROM audits WHERE run_key = 'r3' ORDER BY id LIMIT 50")
add("O3_page", lambda t: keyed.page(t("files"), [F.desc("created_at"), F.desc("id")], 2, 20)[0].select("id"), "SELECT id FROM files ORDER BY created_at DESC, id DESC LIMIT 20 OFFSET 40")
add("O3_page_info", lambda t: keyed.page(t("files"), [F.desc("id")], 2, 20)[1], "SELECT 2 AS page, 20 AS size, count(*) AS total, CAST(ceil(count(*) / 20.0) AS BIGINT) AS total_pages, 3 < ceil(count(*) / 20.0) AS has_next FROM files")
add("O4_priority_order", lambda t: keyed.number_rows(t("audits").withColumn("p", F.element_at(F.array(*map(F.lit, ("LOW", "critical", "NORMAL", "HIGH"))), (F.col("id") % 4 + 1).cast("int"))), ["run_key"], [F.desc(st.rank_of("p", st.PRIORITY, 5)), F.asc("created_at"), F.asc("id")]).select("id", "ordinal"), "SELECT id, CAST(row_number() OVER (PARTITION BY run_key ORDER BY CASE id % 4 WHEN 0 THEN 1 WHEN 1 THEN 20 WHEN 2 THEN 5 ELSE 10 END DESC, created_at, id) AS INT) AS ordinal FROM audits")
add("O5_ordered_dependencies", lambda t: keyed.number_rows(t("edges"), ["task_id"], ["ordinal", "depends_on"], "place").select("task_id", "depends_on", "place"), "SELECT task_id, depends_on, CAST(row_number() OVER (PARTITION BY task_id ORDER BY ordinal, depends_on) AS INT) AS place FROM edges")
add("U1_key_diff", lambda t: keyed.key_diff(renamed(t, 5), t("target")), "SELECT CASE WHEN id % 5 = 0 THEN business_key || 'x' ELSE business_key END AS business_key, 'SOURCE_ONLY' AS diff_type FROM records WHERE id % 5 = 0 OR id % 97 = 0 UNION ALL SELECT business_key, 'TARGET_ONLY' FROM records WHERE id % 5 = 0 AND id % 97 <> 0")
add("U1_key_diff_sample", lambda t: keyed.key_diff(t("records"), t("target"), sample=20), "SELECT business_key, 'SOURCE_ONLY' AS diff_type FROM records WHERE id % 97 = 0 ORDER BY business_key LIMIT 20")

# ---------------------------------------------------------------- reconcile, gates, manifests, alerts

DAY = "1997-05-01"
source_day = lambda t: t("raw").filter(F.col("batch_date") == DAY)
add("R1_reconcile_counts", lambda t: reconcile.reconcile_counts(source_day(t), t("target"), DAY), f"SELECT a.n AS source_count, b.n AS target_count, CASE WHEN a.n = b.n THEN 'PASS' ELSE 'FAIL' END AS status, CASE WHEN a.n = b.n THEN 'OK' ELSE 'source=' || CAST(a.n AS STRING) || ' target=' || CAST(b.n AS STRING) END AS message FROM (SELECT count(*) AS n FROM raw WHERE batch_date = '{DAY}') AS a, (SELECT count(*) AS n FROM target WHERE batch_date = '{DAY}') AS b")
add("R2_reconcile_hash", lambda t: reconcile.reconcile_hash(t("records").filter(F.col("batch_date") == DAY), t("target"), DAY, exact=True, run=None), f"SELECT a.h AS source_hash, b.h AS target_hash, CASE WHEN a.h = b.h THEN 'PASS' ELSE 'FAIL' END AS status FROM (SELECT md5(string_agg(r, chr(10) ORDER BY r) || chr(10)) AS h FROM (SELECT business_key || ',' || name || ',' || description AS r FROM records WHERE batch_date = '{DAY}') AS x) AS a, (SELECT md5(string_agg(r, chr(10) ORDER BY r) || chr(10)) AS h FROM (SELECT business_key || ',' || name || ',' || description AS r FROM records WHERE batch_date = '{DAY}' AND id % 97 <> 0) AS x) AS b")
def fingerprints_of_two(t: Given) -> DataFrame:
    """The whole table against itself, and against one that lacks some rows and has others changed."""
    sides = [t("records"), t("target"), t("records").withColumn("description", F.when(F.col("id") % 501 == 7, "x").otherwise(F.col("description")))]
    said = [reconcile.fingerprint(reconcile.canonical(x)).select(F.struct("n", "hash_sum").alias("h")) for x in (t("records").repartition(7), *sides)]
    rows = [said[0].select(F.col("h").alias("g")).crossJoin(F.broadcast(x)).select(F.lit(n).alias("side"), (F.col("g") == F.col("h")).alias("same"), F.col("h.n").alias("n")) for n, x in enumerate(said[1:])]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


add("R2_fingerprint", fingerprints_of_two, "SELECT 0 AS side, true AS same, count(*) AS n FROM records UNION ALL SELECT 1, count(*) FILTER (WHERE id % 97 = 0) = 0, count(*) FILTER (WHERE id % 97 <> 0) FROM records UNION ALL SELECT 2, count(*) FILTER (WHERE id % 501 = 7 AND description <> 'x') = 0, count(*) FROM records")
add("R3_differing_ranges", lambda t: hashtree.differing_keys(renamed(t, 500), t("target")), "SELECT CASE WHEN id % 500 = 0 THEN business_key || 'x' ELSE business_key END AS business_key, 'SOURCE_ONLY' AS diff_type FROM records WHERE id % 500 = 0 OR id % 97 = 0 UNION ALL SELECT business_key, 'TARGET_ONLY' FROM records WHERE id % 500 = 0 AND id % 97 <> 0")


def stored_ranges(t: Given) -> DataFrame:
    """Both sides stored by ranges; the rows of unlike ranges of one are read back, and those that the other lacks stay."""
    path = t.folder("ranges")
    source, target = t("records").select("business_key", "id", "description"), t("records").filter("id % 5003 <> 11").select("business_key", "id", "description")
    text_of = F.concat_ws(",", "business_key", F.col("id").cast("string"), "description")
    a, b = (hashtree.write_tree(x.withColumn("row", text_of), f"{path}/{n}", row="row", depth=3) for n, x in (("a", source), ("b", target)))
    hashtree.store_ranges(source, f"{path}/rows", depth=3)
    rows = hashtree.read_ranges(t.spark, f"{path}/rows", hashtree.unlike_ranges(a, b, 3))
    return rows.join(hashtree.unlike_rows(target, hashtree.unlike_ranges(a, b, 3), depth=3).select("business_key"), "business_key", "left_anti").select("business_key", "id", "description")


add("R3_stored_ranges", stored_ranges, "SELECT business_key, id, description FROM records WHERE id % 5003 = 11")
add("R3_reconcile", lambda t: reconcile.reconcile(t("records").filter(F.col("batch_date") == DAY), t("target"), DAY)[1], f"SELECT business_key, 'SOURCE_ONLY' AS diff_type FROM records WHERE batch_date = '{DAY}' AND id % 97 = 0")
add("R3_reconcile_run", lambda t: reconcile.reconcile(t("records").filter(F.col("batch_date") == DAY), t("target"), DAY)[0].select("source_count", "target_count", "status"), f"SELECT count(*) AS source_count, count(*) FILTER (WHERE id % 97 <> 0) AS target_count, CASE WHEN count(*) FILTER (WHERE id % 97 = 0) = 0 THEN 'PASS' ELSE 'FAIL' END AS status FROM records WHERE batch_date = '{DAY}'")
job_counts = lambda t: t("runs").groupBy("job_name").agg(F.sum("read_count").alias("read_count"), F.sum("parse_error_count").alias("parse_error_count"))
add("G1_gate_parse_errors", lambda t: reconcile.gate_parse_errors(job_counts(t), {"job3": (0.001, 20), "job4": (0.5, 1 << 40)}).withColumn("error_rate", F.round("error_rate", 9)), "SELECT job_name, 'PARSE_ERROR_RATE' AS gate_type, n AS total_count, CASE WHEN job_name = 'job4' THEN 'SKIP' WHEN p / CAST(n AS DOUBLE) > CASE WHEN job_name = 'job3' THEN 0.001 ELSE 0.05 END THEN 'FAIL' ELSE 'PASS' END AS status, round(p / CAST(n AS DOUBLE), 9) AS error_rate, CASE job_name WHEN 'job3' THEN 0.001 WHEN 'job4' THEN 0.5 ELSE 0.05 END AS max_rate FROM (SELECT job_name, CAST(sum(read_count + parse_error_count) AS BIGINT) AS n, CAST(sum(parse_error_count) AS BIGINT) AS p FROM runs GROUP BY job_name) AS c")
add("G2_gate_completeness", lambda t: reconcile.gate_completeness(t("records").withColumn("name", F.when(F.col("id") % 20 != 0, F.col("name"))), DAY).withColumn("error_rate", F.round("error_rate", 9)), f"SELECT n AS total_count, m AS missing, 'COMPLETENESS' AS gate_type, CASE WHEN m > n * 0.01 THEN 'FAIL' ELSE 'PASS' END AS status, round(coalesce(m / CAST(nullif(n, 0) AS DOUBLE), 0), 9) AS error_rate, 0.01 AS max_rate FROM (SELECT count(*) AS n, count(*) FILTER (WHERE id % 20 = 0) AS m FROM records WHERE batch_date = '{DAY}') AS c")
add("G3_gate_duplicates", lambda t: reconcile.gate_duplicates(t("raw").withColumn("business_key", F.col("name")), DAY, least=1).withColumn("error_rate", F.round("error_rate", 9)), f"SELECT n AS total_count, g AS duplicate_groups, 'DUPLICATE_RATE' AS gate_type, CASE WHEN g > 0 THEN 'FAIL' ELSE 'PASS' END AS status, round(g / CAST(n AS DOUBLE), 9) AS error_rate, 0.0 AS max_rate FROM (SELECT CAST(sum(k) AS BIGINT) AS n, count(*) FILTER (WHERE k > 1) AS g FROM (SELECT name, count(*) AS k FROM raw WHERE batch_date = '{DAY}' GROUP BY name) AS x) AS y WHERE n >= 1")
add("G4_gate_export_rows", lambda t: reconcile.gate_export_rows(t("records").agg(F.count("*").alias("n")), minimum=100), "SELECT count(*) AS n, 'EXPORT_ROWS' AS gate_type, CASE WHEN count(*) >= 100 THEN 'PASS' ELSE 'FAIL' END AS status, 0.0 AS error_rate, 0.0 AS max_rate FROM records")
add("G5_job_verdict", lambda t: reconcile.job_verdict(reconcile.gate_parse_errors(job_counts(t), {}, (0.001, 1))), "SELECT CASE WHEN bool_or(p > 0.001 * n) THEN 'FAILED' ELSE 'COMPLETED' END AS job_status FROM (SELECT job_name, sum(read_count + parse_error_count) AS n, sum(parse_error_count) AS p FROM runs GROUP BY job_name) AS c")


def within_skip_limit(t: Given) -> DataFrame:
    good, bad = mp.standardize(t("raw"))
    filters.enforce_skip_limit(bad)
    return good.agg(F.count("*").alias("n"))


add("G6_skip_limit", within_skip_limit, "SELECT count(*) AS n FROM raw")
GROUPS = f"SELECT g.manifest_id, coalesce(b.arrived, 0) AS arrived, coalesce(b.lacking, 0) AS lacking, coalesce(b.failing, 0) AS failing, CASE WHEN b.lacking > 0 THEN CASE WHEN g.deadline < TIMESTAMP '2024-06-01' THEN 'EXPIRED' ELSE 'WAITING_FILES' END WHEN b.failing > 0 THEN 'FAILED' ELSE 'DISPATCHED' END AS status FROM groups g LEFT JOIN (SELECT manifest_id, count(actual_queue_id) AS arrived, count(*) FILTER (WHERE required AND actual_queue_id IS NULL) AS lacking, count(*) FILTER (WHERE actual_queue_id IS NOT NULL AND expected_record_count IS NOT NULL AND expected_record_count <> actual_record_count) AS failing FROM ({BOUND}) AS x GROUP BY manifest_id) AS b ON b.manifest_id = g.manifest_id"
add("N1_evaluate_groups", lambda t: intake.evaluate_groups(t("groups"), t("members"), t("queue"), at("2024-06-01")), GROUPS)
add("N2_reconcile_members", lambda t: intake.reconcile_members(intake.bind_arrivals(t("members"), t("queue"))).select("manifest_id", "expected_file_name", F.array_join("mismatches", ";").alias("mismatches"), "reconcile_status"), f"SELECT manifest_id, expected_file_name, CASE WHEN actual_queue_id IS NULL THEN 'file not arrived' WHEN expected_record_count <> actual_record_count THEN 'record count: expected=' || CAST(expected_record_count AS STRING) || ' actual=' || CAST(actual_record_count AS STRING) ELSE '' END AS mismatches, CASE WHEN actual_queue_id IS NULL OR coalesce(expected_record_count <> actual_record_count, false) THEN 'FAIL' ELSE 'PASS' END AS reconcile_status FROM ({BOUND}) AS b")
add("N3_register_manifests", lambda t: intake.register_manifests(t("members"), t("groups").withColumn("manifest_id", F.when(F.length("manifest_id") == 2, F.col("manifest_id")).otherwise(F.concat(F.lit("old-"), "manifest_id"))), 24, at("2024-01-01")).select("manifest_id", "total_members", "required_members", ms("deadline").alias("deadline")), "SELECT manifest_id, count(*) AS total_members, count(*) FILTER (WHERE required) AS required_members, epoch_ms(TIMESTAMP '2024-01-02') AS deadline FROM members WHERE length(manifest_id) > 2 GROUP BY manifest_id")
prints = lambda t: t("queue").select(F.when(F.col("id") % 5 != 0, F.col("file_path")).alias("path"), F.when(F.col("id") % 7 == 0, 1).otherwise(F.col("file_size")).cast("bigint").alias("length"), F.when(F.col("id") % 11 == 0, F.lit("x")).otherwise(F.upper("file_hash")).alias("file_hash"), "id")
add("N4_verify_integrity", lambda t: intake.verify_integrity(t("queue").withColumn("file_path", F.col("id").cast("string")), prints(t).withColumn("path", F.when(F.col("path").isNotNull(), F.col("id").cast("string")).otherwise(F.concat(F.lit("other/"), F.col("id").cast("string")))).drop("id")).select("id", "problem"), "SELECT id, CASE WHEN id % 5 = 0 THEN 'MISSING' WHEN id % 7 = 0 THEN 'SIZE' WHEN id % 11 = 0 THEN 'HASH' END AS problem FROM queue")
elsewhere = lambda c: F.when(F.col("id") % 4 == 1, F.col(c)).otherwise(F.concat(F.lit("other-"), c))
add("N5_classify_arrivals", lambda t: intake.classify_arrivals(t("queue").withColumn("file_hash", F.when(F.col("id") % 2 == 0, F.lit("h")).otherwise(F.col("file_hash"))), t("queue").withColumns({"file_hash": F.when(F.col("id") % 3 == 0, F.lit("h")).otherwise(F.col("file_hash")), "file_name": elsewhere("file_name"), "source_system": elsewhere("source_system")})).select("id", "kind"), "WITH new AS (SELECT id, file_name, source_system, CASE WHEN id % 2 = 0 THEN 'h' ELSE file_hash END AS file_hash FROM queue), known AS (SELECT id, file_name, source_system, CASE WHEN id % 3 = 0 THEN 'h' ELSE file_hash END AS file_hash FROM queue WHERE id % 4 = 1) SELECT n.id, CASE WHEN EXISTS (SELECT 1 FROM known k WHERE k.file_name = n.file_name AND k.file_hash = n.file_hash) THEN 'DUPLICATE' WHEN EXISTS (SELECT 1 FROM known k WHERE k.file_name = n.file_name) THEN 'CONFLICT' WHEN EXISTS (SELECT 1 FROM known k WHERE k.source_system = n.source_system AND k.file_hash = n.file_hash) THEN 'DUPLICATE_CONTENT' ELSE 'NEW' END AS kind FROM new n")
add("L1_batch_alerts", lambda t: alerts.evaluate_batch_alerts(t("scored"), t("dlq"), at("1998-01-02"), 60 * 1440, throughput=0.5).select("alert_code", "severity", F.round("value", 6).alias("value")), f"""SELECT * FROM (SELECT 'BATCH_FAILURE_RATE' AS alert_code, 'CRITICAL' AS severity, round(f / CAST(n AS DOUBLE), 6) AS value FROM (SELECT count(*) FILTER (WHERE status = 'FAILED') AS f, count(*) AS n FROM scored WHERE created_at BETWEEN TIMESTAMP '1998-01-02' - INTERVAL '60' DAY AND TIMESTAMP '1998-01-02') AS a WHERE n > 0 AND f >= 0.2 * n
    UNION ALL SELECT 'DLQ_BACKLOG', 'WARNING', CAST(count(*) AS DOUBLE) FROM dlq WHERE NOT handled HAVING count(*) >= 100 UNION ALL SELECT 'DLQ_MANUAL', 'CRITICAL', CAST(count(*) AS DOUBLE) FROM dlq WHERE NOT handled AND manual_required HAVING count(*) >= 20
    UNION ALL SELECT 'LOW_THROUGHPUT', 'WARNING', round(m, 6) FROM (SELECT {MEAN} AS m) AS q WHERE m > 0 AND m < 0.5) AS x""")
add("L2_file_alerts", lambda t: alerts.evaluate_file_alerts(t("files"), t("dispatches"), at(FILES_NOW), pending=1), "SELECT 'FILE_ARRIVED_TIMEOUT' AS alert_code, 'WARNING' AS severity, id AS file_record_id, CAST(NULL AS STRING) AS target_system FROM (SELECT id FROM files WHERE status = 'ARRIVED' AND arrived_at < TIMESTAMP '2024-01-02 10:00:00' ORDER BY arrived_at, id LIMIT 100) AS a UNION ALL SELECT 'FILE_BACKLOG', 'CRITICAL', NULL, NULL FROM files WHERE status IN ('ARRIVED', 'READY') AND arrived_at < TIMESTAMP '2024-01-01 12:00:00' HAVING count(*) >= 1 UNION ALL SELECT 'ACK_TIMEOUT', 'ERROR', file_record_id, target_system FROM (SELECT * FROM dispatches WHERE dispatch_status = 'DISPATCHING' AND ack_status = 'PENDING' AND last_dispatch_time < TIMESTAMP '2024-01-02 11:00:00' ORDER BY last_dispatch_time, id LIMIT 100) AS d")
add("L3_upsert_alerts", lambda t: alerts.upsert_alerts(alert_rows(t).filter("id % 2 = 0"), alert_rows(t).filter("id % 2 = 1")).select("alert_code", "file_record_id", "target_system", "severity", "created", "raised"), f"SELECT alert_code, file_record_id, target_system, CASE max(rank) WHEN 3 THEN 'CRITICAL' WHEN 1 THEN 'WARNING' ELSE 'INFO' END AS severity, min(id % 2) = 1 AS created, CAST(sum(id % 2) AS BIGINT) AS raised FROM ({ALERTS}) AS a GROUP BY alert_code, file_record_id, target_system")
add("L4_alerts_at_least", lambda t: alerts.alerts_at_least(alert_rows(t), "WARNING").select("id"), f"SELECT id FROM ({ALERTS}) AS a WHERE rank >= 1")
add("L5_queue_breaches", lambda t: alerts.queue_breaches(t("audits").select("id", F.col("created_at").alias("enqueued_at"), F.when(F.col("id") % 2 == 0, F.col("id") % 10 * 86_400_000).alias("queue_sla_ms")), at(EVENTS_NOW), 20 * 86_400_000).select("id", "sla_breached", "timed_out"), "SELECT * FROM (SELECT id, coalesce(id % 2 = 0 AND id % 10 > 0 AND w > id % 10 * 86400000, false) AS sla_breached, w > 1728000000 AS timed_out FROM (SELECT id, epoch_ms(TIMESTAMP '2024-01-31') - epoch_ms(created_at) AS w FROM audits) AS a) AS x WHERE sla_breached OR timed_out")
add("L6_sustained", lambda t: alerts.sustained(t("audits").withColumn("ts", F.date_trunc("second", "created_at")), F.col("value") > 5, 180, key="task_id").select("id"), "SELECT id FROM (SELECT id, s, bool_and(value > 5) OVER (PARTITION BY task_id ORDER BY s RANGE BETWEEN 10800 PRECEDING AND CURRENT ROW) AS ok, min(s) OVER (PARTITION BY task_id) AS first FROM (SELECT id, task_id, value, CAST(epoch(date_trunc('second', created_at)) AS BIGINT) AS s FROM audits) AS a) AS x WHERE ok AND s - first >= 10800")

# ---------------------------------------------------------------- graphs, replay

add("D1_graph_snapshot", lambda t: graph.graph_snapshot(t("nodes"), t("edges")), "SELECT 'NODE' AS kind, task_id AS a, CAST(NULL AS STRING) AS b FROM nodes UNION ALL SELECT 'EDGE', depends_on, task_id FROM edges")
LEVELS = "WITH RECURSIVE walk(task_id, level) AS (SELECT 'p0', 0 UNION SELECT e.task_id, w.level + 1 FROM walk w JOIN edges e ON e.depends_on = w.task_id) SELECT task_id, CAST(max(level) AS INT) AS level FROM walk GROUP BY task_id"
add("D2_topo_levels", lambda t: graph.topo_levels(t("nodes"), t("edges"))[0], LEVELS)
CYCLES = "WITH RECURSIVE links AS (SELECT task_id, depends_on FROM edges UNION ALL SELECT 'p1', 'p20'), up(task_id, above) AS (SELECT task_id, depends_on FROM links UNION SELECT u.task_id, l.depends_on FROM up u JOIN links l ON l.task_id = u.above) SELECT DISTINCT task_id FROM up WHERE above IN (SELECT task_id FROM up WHERE task_id = above)"


def propagated(levels: int) -> str:
    """The statuses of one level after the other; level n holds the tasks from 4 ** (n - 1) to 4 ** n."""
    parts = ["WITH l0 AS (SELECT task_id, status FROM nodes WHERE task_id = 'p0')", "k0 AS (SELECT * FROM l0)"]
    for n in range(1, levels):
        bad = f"SELECT e.task_id, arg_min(e.action, e.ordinal) AS action FROM edges e JOIN k{n - 1} AS k ON k.task_id = e.depends_on WHERE k.status IN ('FAILED', 'PARTIAL') AND e.action <> 'IGNORE' GROUP BY e.task_id"
        parts.append(f"l{n} AS (SELECT n.task_id, CASE b.action WHEN 'SKIP' THEN 'SKIPPED' WHEN 'FAIL' THEN 'FAILED' ELSE n.status END AS status FROM nodes n LEFT JOIN ({bad}) AS b ON b.task_id = n.task_id WHERE CAST(substr(n.task_id, 2) AS BIGINT) BETWEEN {4 ** (n - 1)} AND {4 ** n - 1})")
        parts.append(f"k{n} AS (SELECT * FROM k{n - 1} UNION ALL SELECT * FROM l{n})")
    return ", ".join(parts) + f" SELECT task_id, status FROM k{levels - 1}"


PROPAGATED = propagated(12)
cyclic = lambda t: t("edges").select("task_id", "depends_on").unionByName(t("nodes").filter("task_id = 'p1'").select(F.col("task_id"), F.lit("p20").alias("depends_on")))
add("D3_cycle_nodes", lambda t: graph.topo_levels(t("nodes"), cyclic(t))[1], CYCLES)
add("D3_cycle_members", lambda t: graph.cycle_members(t("nodes"), cyclic(t)).select("task_id"), CYCLES[: CYCLES.index("SELECT DISTINCT")] + "SELECT DISTINCT task_id FROM up WHERE above = task_id")
add("D4_propagate", lambda t: graph.propagate(t("nodes"), t("edges"), t("nodes")), PROPAGATED)
add("D5_reconcile_replay", lambda t: replay.reconcile_replay(entries(t), t("states")), f"SELECT *, CASE WHEN in_flight > 0 THEN 'RUNNING' WHEN failed > 0 THEN 'PARTIAL_FAILED' ELSE 'SUCCEEDED' END AS status, CASE WHEN in_flight = 0 AND failed = 0 THEN 'SETTLED' ELSE 'SETTLING' END AS day_status FROM (SELECT session_id, count(*) FILTER (WHERE status IN ('SUCCEEDED', 'SKIPPED')) AS succeeded, count(*) FILTER (WHERE status = 'FAILED') AS failed, count(*) FILTER (WHERE status = 'RUNNING') AS in_flight FROM ({ENTRY}) AS e GROUP BY session_id) AS s")
DUE = "NOT handled AND retryable AND NOT manual_required AND next_retry_at < TIMESTAMP '2001-08-01'"
add("D6_replay_inserts", lambda t: replay.replay_dlq(t("dlq"), t("target"), at(ORDERS_NOW))[0].select("business_key", "batch_date", "name"), f"SELECT r.business_key, r.batch_date, r.name FROM dlq d JOIN records r ON r.id = d.id WHERE {DUE.replace('next_retry_at', 'd.next_retry_at')} AND d.id % 8 <> 0 AND d.id % 97 = 0")
add("D6_replay_dlq", lambda t: replay.replay_dlq(t("dlq"), t("target"), at(ORDERS_NOW))[1].select("id", "handled", "replay_count", "manual_required", "compensation_status"), f"SELECT id, handled OR (due AND id % 8 <> 0) AS handled, replay_count + CAST(due AS INT) AS replay_count, manual_required OR (due AND id % 8 = 0 AND replay_count + 1 >= 5) AS manual_required, CASE WHEN due AND id % 8 <> 0 THEN 'SUCCESS' WHEN due AND replay_count + 1 >= 5 THEN 'MANUAL_REQUIRED' WHEN due THEN 'FAILED' ELSE compensation_status END AS compensation_status FROM (SELECT *, {DUE} AS due FROM dlq) AS d")
outcomes = lambda t: t("dispatches").select("id", F.element_at(F.array(*map(F.lit, ("SENT", "SEND_FAILED", "ACK_OK", "ACK_REFUSED", "ACK_TIMEOUT", "NONE", "NONE"))), (F.col("id") % 7 + 1).cast("int")).alias("outcome"))
add("D7_advance_dispatch", lambda t: replay.advance_dispatch(t("dispatches"), outcomes(t)).select("id", "attempt_count", "dispatch_status", "ack_status"), "SELECT id, CAST(attempt_count + b AS INT) AS attempt_count, CASE WHEN b = 1 THEN CASE WHEN attempt_count + 1 < max_attempts THEN 'RETRY' ELSE 'FAILED' END WHEN id % 7 = 0 THEN 'DISPATCHED' WHEN id % 7 = 2 THEN 'COMPLETED' ELSE dispatch_status END AS dispatch_status, CASE id % 7 WHEN 2 THEN 'ACKED' WHEN 3 THEN 'REJECTED' WHEN 4 THEN 'TIMEOUT' ELSE ack_status END AS ack_status FROM (SELECT *, CASE WHEN id % 7 IN (1, 3, 4) THEN 1 ELSE 0 END AS b FROM dispatches) AS d")


def business_days(t: Given) -> DataFrame:
    none = F.lit(None).cast("timestamp")
    days = t("audits").select(F.lit("default").alias("tenant"), F.lit("default").alias("calendar"), "batch_date").distinct()
    days = days.select("*", F.lit("OPEN").alias("status"), none.alias("frozen_at"), none.alias("settled_at"), F.lit("r3").alias("session_id"))
    changes = t("audits").filter("status IN ('FAILED', 'SUCCESS')").select(F.lit("default").alias("tenant"), F.lit("default").alias("calendar"), "batch_date", F.when(F.col("status") == "FAILED", "FROZEN").otherwise("SETTLED").alias("status"), F.col("created_at").alias("at"), F.when(F.col("id") % 2 == 0, F.col("run_key")).alias("session_id"))
    return replay.advance_days(days, changes).select("batch_date", "status", ms("frozen_at").alias("frozen"), ms("settled_at").alias("settled"))


add("D8_business_days", business_days, "SELECT d.batch_date, coalesce(c.status, 'OPEN') AS status, c.frozen, c.settled FROM (SELECT DISTINCT batch_date FROM audits) AS d LEFT JOIN (SELECT batch_date, arg_max(CASE status WHEN 'FAILED' THEN 'FROZEN' ELSE 'SETTLED' END, created_at) AS status, epoch_ms(min(created_at) FILTER (WHERE status = 'FAILED')) AS frozen, epoch_ms(min(created_at) FILTER (WHERE status = 'SUCCESS')) AS settled FROM audits WHERE status IN ('FAILED', 'SUCCESS') AND (id % 2 = 1 OR run_key = 'r3') GROUP BY batch_date) AS c ON c.batch_date = d.batch_date")

# ---------------------------------------------------------------- streams

requests_of = lambda t: t("events").select(F.concat_ws("/", F.col("user_id").cast("string"), "event_type").alias("dedup_key"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("request_id"))


def accepted(seconds: int) -> str:
    return f"""WITH b AS (SELECT dedup_key, bucket, arg_min(event_id, (ts, event_id)) AS request_id FROM (SELECT CAST(user_id AS STRING) || '/' || event_type AS dedup_key, CAST(floor(epoch(ts) / {seconds}) AS BIGINT) AS bucket, ts, event_id FROM events) AS e GROUP BY dedup_key, bucket),
    i AS (SELECT *, bucket - row_number() OVER (PARTITION BY dedup_key ORDER BY bucket) AS run FROM b), p AS (SELECT *, row_number() OVER (PARTITION BY dedup_key, run ORDER BY bucket) AS place FROM i) SELECT dedup_key, bucket, request_id FROM p WHERE place % 2 = 1"""


add("T1_dedup_requests", lambda t: requests.dedup_requests(requests_of(t), ["dedup_key"], "ts", "request_id", 3600).select("dedup_key", "bucket", "request_id"), accepted(3600))


def as_stream(t: Given, df: DataFrame) -> DataFrame:
    path = t.folder("events")
    df.write.parquet(path)
    return t.spark.readStream.schema(df.schema).parquet(path)


#: Micro-batches of a stream in order of time, and files of each.
SLICES, FILES = 4, 3


def in_slices(t: Given, df: DataFrame, last: DataFrame | None = None) -> DataFrame:
    """A stream of ``df`` in several micro-batches, later rows in later ones; ``last`` comes in one after them and moves the watermark."""
    path = t.folder("events")
    df.write.parquet(f"{path}/whole")
    whole = t.spark.read.schema(df.schema).parquet(f"{path}/whole")
    micros = whole.select(F.unix_micros("ts").cast("double").alias("us"))
    bounds = [float("-inf"), *micros.approxQuantile("us", [n / SLICES for n in range(1, SLICES)], 0.01), float("inf")]
    slices = [whole.filter((F.unix_micros("ts") >= low) & (F.unix_micros("ts") < high)) for low, high in zip(bounds, bounds[1:], strict=False)]
    for rows in [*slices, *([last.select(*df.columns)] if last is not None else [])]:
        rows.repartition(FILES).write.mode("append").parquet(f"{path}/stream")
    return t.spark.readStream.schema(df.schema).option("maxFilesPerTrigger", FILES).parquet(f"{path}/stream")


def ending(df: DataFrame, ts: str, **values) -> DataFrame:
    """One row like those of ``df``, at a time that ends all windows and timers before it."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    return df.sparkSession.range(1).select(*(at(ts).alias(c) if c == "ts" else F.lit(values.get(c)).cast(k).alias(c) for c, k in kinds.items()))


def drain(t: Given, stream: DataFrame) -> DataFrame:
    out = t.folder("stream")
    key = "spark.sql.streaming.stateStore.providerClass"
    before = t.spark.conf.get(key, None)
    t.spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        stream.writeStream.format("parquet").option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start(f"{out}/rows").awaitTermination()
    finally:
        t.spark.conf.unset(key) if before is None else t.spark.conf.set(key, before)
    return t.spark.read.schema(stream.schema).parquet(f"{out}/rows")


add("T1_stream_requests", lambda t: drain(t, requests.stream_requests(in_slices(t, requests_of(t)), 86_400)), accepted(86_400))
add("T2_dedup_stream", lambda t: drain(t, requests.dedup_stream(as_stream(t, requests_of(t)), ["dedup_key"], "ts", "400 days")).select("dedup_key"), "SELECT DISTINCT CAST(user_id AS STRING) || '/' || event_type AS dedup_key FROM events")


def imported(t: Given) -> DataFrame:
    out = t.folder("imported")
    directory = line_files(t)
    stream_intake.stream_import(t.spark, directory, out, "2024-01-01").awaitTermination()
    return t.spark.read.parquet(f"{out}/records").select("business_key", "partition_key")


add("T3_stream_import", imported, f"SELECT DISTINCT upper(name) || ':2024-01-01' AS business_key, '2024_01' AS partition_key FROM ({GOOD_LINES}) AS g WHERE name <> ''")


def traced_import(t: Given) -> DataFrame:
    """Traces of an import of which each micro-batch ran twice."""
    out, directory = t.folder("imported"), line_files(t)
    for _ in range(2):
        stream_intake.import_batch(t.spark, documents.list_files(t.spark, directory).filter("length > 0").select(F.col("path").alias("file")), out, "2024-01-01")
    return t.spark.read.parquet(f"{out}/trace").select("business_key", "event_type", "status")


def dead_letters(t: Given) -> DataFrame:
    """Dead letters of an import that was stopped and taken up again."""
    out, directory = t.folder("imported"), line_files(t)
    for _ in range(2):
        stream_intake.stream_import(t.spark, directory, out, "2024-01-01").awaitTermination()
    return t.spark.read.parquet(f"{out}/dlq").groupBy("error_message").agg(F.count("*").alias("n"))


add("T3_import_trace", traced_import, f"SELECT DISTINCT upper(name) || ':2024-01-01' AS business_key, 'IMPORT' AS event_type, 'SUCCESS' AS status FROM ({GOOD_LINES}) AS g WHERE name <> ''")
add("T8_restarted_import", dead_letters, f"SELECT error_message, count(*) AS n FROM (SELECT 'not a number: ' || id AS error_message FROM ({RAW_LINES}) AS l WHERE substr(id, 1, 1) = 'x' UNION ALL SELECT 'name missing' FROM ({GOOD_LINES}) AS g WHERE name = '') AS d GROUP BY error_message")
add("T4_status_counts", lambda t: requests.stream_status_counts(t("audits"), "created_at", "1 hour").select(F.unix_seconds("window_start").alias("s"), "status", "n"), "SELECT CAST(floor(epoch(created_at) / 3600) * 3600 AS BIGINT) AS s, status, count(*) AS n FROM audits GROUP BY 1, 2")
TIMED = "SELECT user_id, date_trunc('millisecond', ts) AS ts, CASE WHEN event_type IN ('view', 'signup') THEN 'START' ELSE 'END' END AS kind, event_id FROM events WHERE event_type <> 'click'"
timed = lambda t: t("events").filter("event_type <> 'click'").select("user_id", F.date_trunc("millisecond", F.col("ts").cast("timestamp")).alias("ts"), F.when(F.col("event_type").isin("view", "signup"), "START").otherwise("END").alias("kind"))
add("T5_timeouts", lambda t: states.timeouts(timed(t), "user_id", "ts", 60 * 24, at(EVENTS_NOW)).select("user_id", ms("started_at").alias("started")), f"SELECT user_id, epoch_ms(ts) AS started FROM (SELECT *, (SELECT min(e.ts) FROM ({TIMED}) AS e WHERE e.user_id = s.user_id AND e.kind = 'END' AND e.ts > s.ts) AS done FROM ({TIMED}) AS s WHERE kind = 'START') AS x WHERE coalesce(done, TIMESTAMP '2024-01-31') > ts + INTERVAL '1' DAY AND ts + INTERVAL '1' DAY <= TIMESTAMP '2024-01-31'")
results = lambda t: t("events").select(F.concat(F.lit("S"), (F.col("user_id") % 40).cast("string")).alias("target"), F.col("ts").cast("timestamp").alias("ts"), "event_id", (F.col("event_type") != "error").alias("success"))
RULE = breakers.BreakerRule(4, 0.5, 3_600_000)
BREAKERS = """WITH RECURSIVE e AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY ms, event_id) AS n FROM (SELECT 'S' || CAST(user_id % 40 AS STRING) AS target, epoch_ms(ts) AS ms, event_id, event_type <> 'error' AS success FROM events) AS x),
walk AS (SELECT target, n, event_id, CASE WHEN success THEN 0 ELSE 1 END AS failures, false AS is_open, CAST(0 AS BIGINT) AS until FROM e WHERE n = 1
UNION ALL SELECT e.target, e.n, e.event_id, CASE WHEN success THEN 0 ELSE failures + 1 END, CASE WHEN success THEN is_open AND ms < until ELSE is_open OR failures >= 1 END,
CASE WHEN NOT success AND (failures >= 1 OR (is_open AND ms >= until)) THEN ms + 3600000 ELSE until END FROM walk JOIN e ON e.target = walk.target AND e.n = walk.n + 1)
SELECT target, event_id, CASE WHEN is_open THEN 'OPEN' ELSE 'CLOSED' END AS status, CAST(failures AS BIGINT) AS failures FROM walk"""
add("T6_breaker_states", lambda t: breakers.breaker_states(results(t), RULE), BREAKERS)
add("T6_stream_breaker", lambda t: drain(t, states.stream_breaker(as_stream(t, results(t)), RULE)), BREAKERS)
add("T7_coalesce_events", lambda t: requests.coalesce_events(requests_of(t), "dedup_key", "ts", "request_id", "1 hour").select("dedup_key", F.unix_seconds("window_start").alias("s"), "n", F.element_at("items", 1).alias("first")), "SELECT CAST(user_id AS STRING) || '/' || event_type AS dedup_key, CAST(floor(epoch(ts) / 3600) * 3600 AS BIGINT) AS s, count(*) AS n, min(event_id) AS first FROM events GROUP BY 1, 2")


def streamed_counts(t: Given) -> DataFrame:
    rows = t("audits").select(F.col("created_at").alias("ts"), "status")
    counts = drain(t, requests.stream_status_counts(in_slices(t, rows, ending(rows, "2030-01-01")), "ts", "1 hour"))
    return counts.select(F.unix_seconds("window_start").alias("s"), "status", "n")


add("T4_stream_counts", streamed_counts)
SQL["T4_stream_counts"] = SQL["T4_status_counts"]


def streamed_timeouts(t: Given) -> DataFrame:
    rows = timed(t).select(F.col("user_id").cast("string").alias("key"), "ts", "kind")
    # a minute more than the time at which they are asked for, by which the watermark lags behind
    due = drain(t, states.stream_timeouts(in_slices(t, rows, ending(rows, "2024-01-31 00:01:00", key="-", kind="END")), 60 * 24))
    return due.select(F.col("key").cast("bigint").alias("user_id"), (F.col("due_ms") - 86_400_000).alias("started"))


add("T5_stream_timeouts", streamed_timeouts)
SQL["T5_stream_timeouts"] = SQL["T5_timeouts"]


def streamed_coalesced(t: Given) -> DataFrame:
    rows = drain(t, requests.coalesce_events(in_slices(t, requests_of(t), ending(requests_of(t), "2030-01-01")), "dedup_key", "ts", "request_id", "1 hour"))
    return rows.select("dedup_key", F.unix_seconds("window_start").alias("s"), "n", F.element_at("items", 1).alias("first"))


add("T7_stream_coalesced", streamed_coalesced)
SQL["T7_stream_coalesced"] = SQL["T7_coalesce_events"]


def import_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows, distinct keys and duplicates of an import by partition."""
    t = Given(spark, sf_dir)
    raw = t("raw").select("file", "line_no", "id", "name", "description", F.col("batch_date").alias("day"))
    job = jobs.import_records(text.Parsed(raw, raw.limit(0)), F.col("day"), at(ORDERS_NOW))
    kept = job.records.groupBy("partition_key").agg(F.count("*").alias("loaded"))
    again = job.duplicates.groupBy("partition_key").agg(F.count("*").alias("duplicates"))
    return kept.join(again, "partition_key", "left").na.fill(0, ["duplicates"])


def import_counts(t: Given) -> DataFrame:
    """Counts that were taken while an import was written, beside what the written folders hold."""
    path = t.folder("import")
    counts = jobs.save_import(jobs.import_outcomes(text.read_delimited(t.spark, line_files(t)), F.lit("2024-01-01"), at(ORDERS_NOW)), path)
    held = t.spark.read.parquet(path).groupBy("outcome").agg(F.count("*").alias("n"))
    said = F.create_map(*(F.lit(x).cast("bigint") if isinstance(x, int) else F.lit(x) for pair in counts.items() for x in pair))
    return held.select(F.col("outcome").cast("string").alias("outcome"), "n", said[F.col("outcome")].alias("observed"))


COUNTED = f"""SELECT outcome, count(*) AS n, count(*) AS observed FROM (SELECT CASE WHEN substr(id, 1, 1) = 'x' THEN 'parse_error' WHEN name = '' THEN 'rejected'
WHEN row_number() OVER (PARTITION BY substr(id, 1, 1) = 'x', upper(trim(name)) ORDER BY id) > 1 THEN 'duplicate' ELSE 'written' END AS outcome FROM ({RAW_LINES}) AS l) AS o GROUP BY outcome"""
add("import_counts", import_counts, COUNTED)
QUERIES["import_summary"] = import_summary
SQL["import_summary"] = with_derived("SELECT replace(substr(batch_date, 1, 7), '-', '_') AS partition_key, count(*) AS loaded, CAST(sum(n - 1) AS BIGINT) AS duplicates FROM (SELECT name, batch_date, count(*) AS n FROM raw GROUP BY name, batch_date) AS g GROUP BY 1")

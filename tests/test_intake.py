"""Files in, records out."""

import gzip
import json
import random
import re
import zipfile
from collections import Counter

import pytest
from pyspark.sql import functions as F

from wharfline.functions.mapping import Rule, apply_mapping, register_op
from wharfline.plans.jobs import export_records, import_feed, import_outcomes, import_records, save_import
from wharfline.plans.sinks import export_csv, export_json, merge_into, of_partitions, read_partitioned, write_dlq
from wharfline.sources import documents, tables, text
from wharfline.streaming.intake import import_batch

DAY = "2026-03-02"


def imported(spark, path):
    return import_records(text.read_delimited(spark, path), F.lit(DAY), F.to_timestamp(F.lit(DAY)))


def test_success(spark, lines):
    job = imported(spark, lines("a.csv", "id,name,description", "1,Alice,x", "2,Bob,y", "3,Carol,z"))
    assert sorted(r.name for r in job.records.collect()) == ["ALICE", "BOB", "CAROL"]
    assert job.counts().first().asDict() == {"written": 3, "duplicate": 0, "rejected": 0, "parse_error": 0}


def test_first_of_equal_names_wins(spark, lines):
    job = imported(spark, lines("a.csv", "id,name,description", "1,Alice,x", "2,Alice,y", "3,Bob,z"))
    assert {(r.business_key, r.id) for r in job.records.collect()} == {(f"ALICE:{DAY}", 1), (f"BOB:{DAY}", 3)}
    assert job.duplicates.count() == 1


def test_malformed_lines(spark, lines):
    parsed = text.read_delimited(spark, lines("a.csv", "id,name,description", "1,Alice,x", "broken line", "2,Bob,y", ',"",missing_fields', "4,Dan,w"))
    good = {(r.id, r.name) for r in parsed.good.collect()}
    assert good == {(1, "Alice"), (2, "Bob"), (None, '""'), (4, "Dan")}
    assert [(r.line_no, r.line) for r in parsed.bad.collect()] == [(3, "broken line")]


def test_blank_name_is_skipped(spark, lines):
    job = imported(spark, lines("a.csv", "id,name,description", "1,Alice,x", "2, ,y", "3,Carol,z"))
    assert job.records.count() == 2 and job.rejected.count() == 1


def test_delimiter_is_a_pattern_here_and_literal_in_feeds(spark, lines):
    path = lines("a.txt", "id|name|description", "1|A|x")
    assert text.read_delimited(spark, path, r"\|").good.first().name == "A"
    row = text.read_feed(spark, path, text.Feed("f", "|")).first()
    assert row.raw == {"id": "1", "name": "A", "description": "x"}


def test_feed_pads_and_drops_values(spark, lines):
    rows = text.read_feed(spark, lines("a.csv", " a ,b", "1", "1, 2 ,3"), text.Feed("f")).orderBy("line_no").collect()
    assert [r.raw for r in rows] == [{"a": "1", "b": None}, {"a": "1", "b": " 2 "}]


def test_mapped_feed(spark, lines):
    feed = text.Feed("f")
    rows = text.read_feed(spark, lines("a.csv", "c_name,c_cat", "alice,gold"), feed)
    job = import_feed(rows, feed, [Rule("c_name", "name", "UPPER", None, True), Rule("c_cat", "category")], F.lit(DAY), F.to_timestamp(F.lit(DAY)))
    row = job.records.first()
    assert (row.name, row.attributes, row.business_key) == ("ALICE", {"category": "gold"}, f"ALICE:{DAY}")


def test_bad_date_rejects_or_fails(spark):
    df = spark.createDataFrame([({"d": "2024-01-05"},), ({"d": "soon"},), ({"d": " "},)], "raw map<string,string>")
    good, bad = apply_mapping(df, [Rule("d", "d", "DATE_FORMAT")])
    assert sorted(r.d for r in good.collect()) == [" ", "2024-01-05"] and bad.count() == 1
    with pytest.raises(Exception, match="not a date"):
        apply_mapping(df, [Rule("d", "d", "DATE_FORMAT")], on_error="fail")[0].collect()


def test_own_operation(spark):
    register_op("REVERSE", lambda c, _: F.reverse(c))
    good, _ = apply_mapping(spark.createDataFrame([({"a": "abc"},)], "raw map<string,string>"), [Rule("a", "a", "REVERSE")])
    assert good.first().a == "cba"


def test_line_numbers_over_splits(spark, lines):
    path = lines("big.txt", *(f"line {i}" for i in range(1, 5001)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        rows = text.numbered_lines(spark, path)
        assert rows.filter(F.col("line") != F.concat(F.lit("line "), F.col("line_no").cast("string"))).count() == 0 and rows.count() == 5000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_numbers_survive_another_split_planning(spark, tmp_path):
    """Files are split by the cores that are there; lines planned with some and read with others keep their numbers."""
    n = 1_000_000
    for name, rows in (("a.txt", n), ("b.txt", 50_000)):
        (tmp_path / name).write_text("".join(f"line {i}\n" for i in range(1, rows + 1)))
    keys = {"spark.sql.leafNodeDefaultParallelism": ("3", "17"), "spark.sql.files.minPartitionNum": ("2", "40"), "spark.sql.files.maxPartitionBytes": ("2m", "300k")}
    before = {k: spark.conf.get(k, None) for k in keys}
    try:
        for k, (one, _) in keys.items():
            spark.conf.set(k, one)
        rows = text.numbered_lines(spark, str(tmp_path))
        for k, (_, other) in keys.items():
            spark.conf.set(k, other)
        assert rows.filter(F.col("line") != F.concat(F.lit("line "), F.col("line_no").cast("string"))).count() == 0
        assert rows.count() == n + 50_000 and rows.select("file", "line_no").distinct().count() == n + 50_000
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_a_line_without_an_offset_is_an_error(spark, tmp_path):
    rows = spark.createDataFrame([("f", 0, 0, 1, 0, "a"), ("f", 9, 1, 1, 1 << 33, "b")], "file string, split long, task long, of long, at long, line string")
    text.write_split_index(rows.filter("split = 0"), str(tmp_path / "index"))
    with pytest.raises(Exception, match="a split without an offset: f"):
        text.number(rows, spark.read.parquet(str(tmp_path / "index"))).collect()


def test_import_twice_adds_nothing(spark, lines, tmp_path):
    path, out = lines("a.csv", "id,name,description", "1,Alice,x", "2,Bob,y"), str(tmp_path / "table")
    for _ in range(2):
        records = imported(spark, path).records
        merge_into(spark, out, records, ["line_no"])
    assert read_partitioned(spark, out, records.schema).count() == 2


def test_a_merge_reads_the_partitions_of_its_batch(spark, tmp_path):
    from wharfline.plans import sinks

    rows = spark.range(400).select(F.concat(F.lit("k"), "id").alias("business_key"), F.concat(F.lit("2026-03-"), F.lpad((F.col("id") % 20 + 1).cast("string"), 2, "0")).alias("batch_date"), F.lit("2026_03").alias("partition_key"), "id")
    out = str(tmp_path / "table")
    sinks.append_partitioned(rows, out)
    batch = rows.filter("batch_date = '2026-03-07'").unionByName(rows.filter("id = 6").withColumn("business_key", F.lit("new")))
    target = sinks.of_partitions(sinks.read_partitioned(spark, out, rows.schema), batch)
    spark.conf.set("spark.sql.maxMetadataStringLength", 2000)
    plan = target._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert "2026-03-07" in plan.split("PartitionFilters:")[1].split("PushedFilters")[0] and target.count() == 20
    sinks.merge_into(spark, out, batch, ["id"])
    table = sinks.read_partitioned(spark, out, rows.schema)
    assert table.count() == 401 and table.filter("business_key = 'new'").count() == 1
    assert sinks.of_partitions(table, rows.limit(0)).count() == 0


def test_outcomes_in_one_pass(spark, tmp_path, lines):
    """Written rows, repeated keys, rejected and unread lines are those of the import job, and are counted as they are written."""
    parsed = text.read_delimited(spark, lines("a.csv", "id,name,description", "1,ann,x", "z,ann,y", "3,,w", "4,Ann,v", "5,bob,", "q,,", "7,,w"))
    day, now = F.lit(DAY), F.to_timestamp(F.lit(DAY))
    counts = save_import(import_outcomes(parsed, day, now), str(tmp_path / "out"))
    assert counts == {"written": 2, "duplicate": 1, "rejected": 2, "parse_error": 2}
    job, table = import_records(parsed, day, now), spark.read.parquet(str(tmp_path / "out"))
    for outcome, df in {"written": job.records, "duplicate": job.duplicates, "rejected": job.rejected, "parse_error": job.bad}.items():
        assert {r.line_no for r in table.filter(F.col("outcome") == outcome).collect()} == {r.line_no for r in df.collect()}
    kept = ["business_key", "batch_date", "partition_key", "id", "name", "description"]
    assert sorted(table.filter("outcome = 'written'").select(*kept).collect()) == sorted(job.records.select(*kept).collect())
    nothing = save_import(import_outcomes(text.read_delimited(spark, lines("b.csv", "id,name,description")), day, now), str(tmp_path / "none"))
    assert nothing == {"written": 0, "duplicate": 0, "rejected": 0, "parse_error": 0}


def test_json_array(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"id": 1, "name": "A", "extra": 3}, {"name": null}]')
    assert [(r.id, r.name, r.description) for r in documents.read_json_array(spark, str(tmp_path / "a.json")).collect()] == [(1, "A", None), (None, None, None)]


def test_json_array_of_many_splits(spark, tmp_path):
    """One array over many splits gives the rows of a parser that reads it whole: strings with brackets, escapes, nesting."""
    rng = random.Random(9)
    parts = ['{', '}', '[', ']', '"', "\\", ",", "\n", "x", "é", "},{", '"}', "\\\\}"]
    word = lambda: "".join(rng.choice(parts) for _ in range(rng.randrange(12)))
    nest = lambda d: rng.choice([[], {}, word(), 1, [word(), {}]]) if d == 0 else {word(): nest(d - 1), "a": [nest(d - 1), {"b": word()}]}
    rows = [{"extra": nest(rng.randrange(4)), "id": i, "name": word(), "more": {"x": [{}]}, "description": None if i % 7 == 0 else word()} for i in range(600)]
    rows[5] = rows[-1] = None
    (tmp_path / "a.json").write_text(json.dumps(rows, indent=1), encoding="utf-8")
    (tmp_path / "b.json").write_text("\n" + json.dumps(rows[:50], ensure_ascii=False) + " \n", encoding="utf-8")
    (tmp_path / "c.json").write_text(" [ ]")
    (tmp_path / "d.json").write_text("")
    (tmp_path / "e.json").write_text("[{}]")
    key = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)
    try:
        spark.conf.set(key, "2000")
        assert spark.read.option("lineSep", "}").text(str(tmp_path)).rdd.getNumPartitions() > 30
        got = documents.read_json_array(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set(key, before)
    of = lambda r: (r["id"], r["name"], r["description"]) if r else (None, None, None)
    assert Counter((r.file[-6:], r.id, r.name, r.description) for r in got) == Counter([*(("a.json", *of(r)) for r in rows), *(("b.json", *of(r)) for r in rows[:50]), ("e.json", None, None, None)])


@pytest.mark.parametrize("text_", [" ", "{}", '[{"id": 1}', '[{"id": 1} {"id": 2}]', '[{"id": 1}] [{"id": 2}]', '[{"id": 1},]', '[{"id": 1}, ,{"id": 2}]', '[{"id": 1}] x', '{"id": 1}\n{"id": 2}\n', '{"a": [{"id": 1}]}', "[{'id': 1}]", '[{"id": 1}}]', '[{"name": "x]'])
def test_not_one_json_array(spark, tmp_path, text_):
    (tmp_path / "a.json").write_text(text_)
    with pytest.raises(Exception, match="not one JSON array|MALFORMED"):
        documents.read_json_array(spark, str(tmp_path / "a.json")).collect()


def workbook(path, rows):
    cells = "".join("<row>" + "".join(f'<c t="inlineStr"><is><t>{v}</t></is></c>' if v is not None else "<c/>" for v in r) + "</row>" for r in rows)
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="S" sheetId="1" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {ns}><sheetData>{cells}</sheetData></worksheet>")


def test_workbooks(spark, tmp_path):
    workbook(tmp_path / "a.xlsx", [["ID", "Name", "DESCRIPTION"], ["1.0", "A", "x"], [None, " ", None], ["2", "B", None]])
    got = documents.read_workbooks(spark, str(tmp_path / "a.xlsx"))
    assert [(r.ordinal, r.id, r.name, r.description) for r in got.orderBy("ordinal").collect()] == [(1, 1, "A", "x"), (2, 2, "B", None)]
    assert documents.read_workbooks(spark, str(tmp_path / "a.xlsx"), "S").count() == 2


def test_compressed(spark, tmp_path):
    (tmp_path / "a.csv.gz").write_bytes(gzip.compress(b"h\nx\n"))
    with zipfile.ZipFile(tmp_path / "b.zip", "w") as z:
        z.writestr("b.csv", "h\ny\n")
    rows = documents.read_compressed(spark, [str(tmp_path / "a.csv.gz"), str(tmp_path / "b.zip")])
    assert sorted(r.line for r in rows.filter("line_no = 2").collect()) == ["x", "y"]
    with pytest.raises(Exception, match="more than 2 bytes"):
        documents.read_compressed(spark, str(tmp_path / "a.csv.gz"), most_bytes=2).collect()


def test_archives_as_streams(spark, tmp_path):
    """Archives of many fragments and splits: stored and deflated, folders first, several gzip members, no suffix, no last line end."""
    rng = random.Random(3)
    rows = ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(160, 900)])) for _ in range(rng.randrange(60))).replace("\x85", "") for _ in range(4_000)]
    body = "\r\n".join(rows).encode()
    for name, method in (("a.zip", zipfile.ZIP_DEFLATED), ("b.zip", zipfile.ZIP_STORED)):
        with zipfile.ZipFile(tmp_path / name, "w", method) as z:
            z.writestr("in/", "")
            z.writestr("in/x.csv", body)
            z.writestr("in/y.csv", "other")
    with open(tmp_path / "c.zip", "wb") as out, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z, z.open("x.csv", "w") as member:
        member.write(body)
    (tmp_path / "d.csv.gz").write_bytes(gzip.compress(body[:50_000]) + gzip.compress(body[50_000:]))
    (tmp_path / "e.csv").write_bytes(body)
    key, want = "spark.sql.files.maxPartitionBytes", [(n, r) for n, r in enumerate(rows, 1)]
    before = spark.conf.get(key)
    try:
        spark.conf.set(key, "20000")
        got = documents.read_compressed(spark, str(tmp_path)).collect()
        for name in "abcde":
            assert sorted((r.line_no, r.line) for r in got if r.file.rsplit("/", 1)[1][0] == name) == want, name
        (tmp_path / "f").mkdir()
        (tmp_path / "f" / "data").write_bytes(gzip.compress(body[:50_000]) + gzip.compress(body[50_000:]))
        got = documents.read_compressed(spark, str(tmp_path / "f" / "data"), "gz").collect()
        assert sorted((r.line_no, r.line) for r in got) == want
    finally:
        spark.conf.set(key, before)


def test_archives_that_fail(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "bomb.zip", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("x", b"0" * 5_000_000)
    with pytest.raises(Exception, match="more than 1000000 bytes"):
        documents.read_compressed(spark, str(tmp_path / "bomb.zip"), most_bytes=1_000_000).collect()
    whole = (tmp_path / "bomb.zip").read_bytes()
    (tmp_path / "cut.zip").write_bytes(whole[: len(whole) // 2])
    with pytest.raises(Exception, match="ends too early"):
        documents.read_compressed(spark, str(tmp_path / "cut.zip")).collect()
    with zipfile.ZipFile(tmp_path / "none.zip", "w") as z:
        z.writestr("in/", "")
    with pytest.raises(Exception, match="without a file"):
        documents.read_compressed(spark, str(tmp_path / "none.zip")).collect()
    (tmp_path / "empty.csv").write_text("")
    assert documents.read_compressed(spark, str(tmp_path / "empty.csv")).count() == 0


def test_manifest_errors(spark, tmp_path):
    (tmp_path / "m.json").write_text('{"manifestId": "m", "files": [{"fileName": "a", "checksum": "x", "checksumAlgorithm": "SHA"}, {"expectedRecordCount": 1, "required": false}]}')
    rows = documents.read_manifests(spark, str(tmp_path / "m.json")).collect()
    assert {(r.expected_file_name, r.required, tuple(r.errors)) for r in rows} == {("a", True, ("checksum algorithm unknown",)), (None, False, ("fileName missing",))}


def test_ready_files(spark, tmp_path):
    for name, body in {"a.csv": "x", "a.csv.done": "", "b.csv": "x", "c.csv": "", "c.csv.done": "", "d.part": "x"}.items():
        (tmp_path / name).write_text(body)
    assert sorted(r.name for r in documents.list_ready_files(spark, str(tmp_path)).collect()) == ["a.csv", "b.csv"]
    assert [r.name for r in documents.list_ready_files(spark, str(tmp_path), require_done=True).collect()] == ["a.csv"]


@pytest.mark.parametrize("sql", ["DELETE FROM t", "SELECT 1; SELECT 2", "SELECT 1 -- x", "SELECT * FROM hidden", "SELECT * FROM t, hidden", "WITH x AS (SELECT * FROM hidden) SELECT * FROM x", "SELECT * FROM t WHERE id IN (SELECT id FROM hidden)", "SELECT reflect('java.lang.System', 'exit', 1)"])
def test_guard_refuses(spark, sql):
    df = spark.range(3)
    with pytest.raises(ValueError):
        tables.guarded_sql(spark, sql, {"t": df})


HIDDEN = (
    "WITH hidden AS (SELECT * FROM hidden) SELECT * FROM hidden",
    "SELECT * FROM (WITH hidden AS (SELECT 1 AS id) SELECT * FROM hidden) a JOIN hidden b ON true",
    "SELECT * FROM t WHERE id IN (SELECT id FROM hidden)",
    "SELECT (SELECT max(id) FROM hidden) AS n FROM t",
    "WITH a AS (SELECT id FROM t), b AS (SELECT id FROM hidden) SELECT * FROM a",
    "SELECT * FROM t, hidden",
    "SELECT * FROM t UNION ALL SELECT * FROM over_t",
    "SELECT * FROM global_temp.t",
)


@pytest.mark.parametrize("sql", HIDDEN)
def test_guard_hides_other_views(spark, sql):
    """Views of the session that aren't allowed can't be read, under whatever name a statement gives its own clauses."""
    spark.range(9).createOrReplaceTempView("hidden")
    spark.range(9).createOrReplaceGlobalTempView("t")
    spark.range(9).createOrReplaceTempView("over_t")
    try:
        with pytest.raises(ValueError, match="not allowed"):
            tables.guarded_sql(spark, sql, {"t": spark.range(3)})
    finally:
        for name in ("hidden", "over_t"):
            spark.catalog.dropTempView(name)
        spark.catalog.dropGlobalTempView("t")


def test_guard_leaves_no_views(spark):
    spark.range(7).createOrReplaceTempView("mine")
    df = tables.guarded_sql(spark, "SELECT count(*) AS n FROM mine JOIN other USING (id)", {"mine": spark.range(3), "other": spark.range(5)})
    assert spark.table("mine").count() == 7 and not spark.catalog.tableExists("other")
    assert df.first().n == 3
    spark.catalog.dropTempView("mine")


@pytest.mark.parametrize("sql", ["SELECT count(*) AS n FROM t", "WITH x AS (SELECT * FROM t) SELECT count(*) AS n FROM x", "SELECT count(*) AS n FROM t WHERE 'delete; --' != ''"])
def test_guard_accepts(spark, sql):
    assert tables.guarded_sql(spark, sql, {"t": spark.range(3)}).first().n == 3


def test_export(spark, tmp_path):
    df = spark.createDataFrame([(1, "k", "a\tb", None, "2026-03-06T10:15:30"), (2, "TEST_k", "x", "", DAY), (0, "z", "x", "", DAY)], "id long, business_key string, name string, description string, batch_date string")
    rows, bad = export_records(spark, "SELECT * FROM records", {"records": df})
    assert [tuple(r) for r in rows.collect()] == [(1, "k", "A B", "", "2026-03-06")] and bad.first().error == "id"
    export_csv(rows.coalesce(1), str(tmp_path / "out"), plain=True)
    assert "".join(p.read_text() for p in (tmp_path / "out").glob("part*")) == "id,business_key,name,description,batch_date\n1,k,A B,,2026-03-06\n"


def test_exports_read_back(spark, tmp_path):
    """Plain CSV by the reader of lines, JSON arrays by the reader of documents; JSON lines are refused."""
    df = spark.createDataFrame([(i, f'n"{i}', None if i % 3 else f" d{i} #") for i in range(100)], "id long, name string, description string").repartition(4)
    export_csv(df, str(tmp_path / "csv"), plain=True)
    assert {(r.id, r.name, r.description) for r in text.read_delimited(spark, str(tmp_path / "csv")).good.collect()} == {(r.id, r.name, (r.description or "").strip()) for r in df.collect()}
    export_json(df, str(tmp_path / "json"))
    assert {(r.id, r.name, r.description) for r in documents.read_json_array(spark, str(tmp_path / "json")).collect()} == {tuple(r) for r in df.collect()}
    assert all(len(json.loads(p.read_text())) > 0 for p in (tmp_path / "json").glob("part*"))
    df.write.json(str(tmp_path / "lines"))
    with pytest.raises(Exception, match="not one JSON array"):
        documents.read_json_array(spark, str(tmp_path / "lines")).collect()


def test_formats_plug_in(spark, lines):
    """A line format and a document format of one's own."""
    text.register_format("pairs", lambda rows: text.Parsed(rows.select("file", "line_no", F.split("line", "=")[0].alias("name")), rows.limit(0)))
    assert [r.name for r in text.read_lines(spark, lines("a.txt", "x=1", "y=2"), "Pairs").good.orderBy("line_no").collect()] == ["x", "y"]
    documents.register_document("words", lambda session, paths: session.read.text(paths).select(F.explode(F.split("value", " ")).alias("name")))
    assert {r.name for r in documents.read_document(spark, lines("b.txt", "p q", "r"), "words").collect()} == {"p", "q", "r"}


def test_dead_letters_of_few_files(spark, tmp_path):
    """A batch is compared with the folders of its files only, and adds nothing when it is done again."""
    rows = lambda *files: spark.createDataFrame([(f, n, None, DAY, None, None, "e") for f in files for n in range(3)], "file string, line_no long, business_key string, batch_date string, name string, description string, error string")
    path = str(tmp_path / "dlq")
    for files in ([f"f{i}" for i in range(40)], ["f1", "f99"], ["f1", "f99"], []):
        write_dlq(rows(*files) if files else rows("x").limit(0), path, "import", ("file", "line_no"))
    table = spark.read.parquet(path)
    assert table.count() == 41 * 3
    few = of_partitions(table, table.filter("file = 'f1'"), ("origin_part",))
    assert re.search(r"PartitionFilters: \[[^\]]*origin_part", few._jdf.queryExecution().toString())
    assert few.select("_metadata.file_path").distinct().count() <= 2


def test_import_twice(spark, tmp_path, lines):
    """A micro-batch that runs again adds no record, no trace and no dead letter."""
    path = lines("a.csv", "id,name,description", "1,ann,x", "z,bob,y", "3,,w", "4,ann,v")
    batch = spark.createDataFrame([("file://" + path,)], "file string")
    for _ in range(2):
        import_batch(spark, batch, str(tmp_path / "out"), DAY)
    count = lambda name: spark.read.parquet(str(tmp_path / "out" / name)).count()
    assert (count("records"), count("trace"), count("dlq")) == (1, 1, 2)


def test_json_arrays_are_few_files(spark, tmp_path):
    """The query's arrays are as many as tasks write, and not one for every hundred rows."""
    from wharfline.queries import Given, json_arrays

    spark.range(6000).select(F.col("id").alias("c_custkey"), F.concat(F.lit("n"), "id").alias("c_name")).write.parquet(f"{tmp_path}/customer.parquet")
    orders = spark.range(6000).select(F.col("id").alias("o_orderkey"), F.col("id").alias("o_custkey"), F.lit("p").alias("o_orderpriority"), F.expr("TIMESTAMP_NTZ '1997-05-03'").alias("o_orderdate"))
    orders.write.parquet(f"{tmp_path}/orders.parquet")

    class Here(Given):
        def folder(self, name):
            return f"{tmp_path}/{name}"

    rows = json_arrays(Here(spark, str(tmp_path)))
    assert sorted(rows.select("id", "name").collect()) == [(i, f"n{i}") for i in range(6000)]
    assert len(list((tmp_path / "json").rglob("part-*"))) <= 16

"""Operational tables derived from the given ones, in SQL that Spark and DuckDB both run."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

#: Name to statement. A statement may name given tables and derived ones.
DERIVED = {
    "raw": """SELECT o_orderkey AS id, c_name AS name, o_orderpriority AS description, substr(CAST(CAST(o_orderdate AS DATE) AS STRING), 1, 8) || '01' AS batch_date,
        CAST(o_orderdate AS TIMESTAMP) AS created_at, o_orderkey + 2 AS line_no, 'orders.csv' AS file FROM orders JOIN customer ON o_custkey = c_custkey""",
    "records": """SELECT id, name, description, batch_date, business_key, partition_key, created_at, line_no FROM (
        SELECT id, upper(name) AS name, description, batch_date, upper(name) || ':' || batch_date AS business_key, substr(batch_date, 1, 4) || '_' || substr(batch_date, 6, 2) AS partition_key,
        created_at, line_no, row_number() OVER (PARTITION BY name, batch_date ORDER BY id) AS n FROM raw) AS r WHERE n = 1""",
    "target": "SELECT * FROM records WHERE id % 97 <> 0",
    "runs": """SELECT l_orderkey AS job_execution_id, 'job' || CAST(l_orderkey % 7 AS STRING) AS job_name, CAST(count(*) AS BIGINT) AS read_count,
        CAST(sum(CASE WHEN l_returnflag <> 'R' THEN 1 ELSE 0 END) AS BIGINT) AS write_count, CAST(sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS BIGINT) AS skip_count,
        CAST(0 AS BIGINT) AS filter_count, CAST(CASE WHEN l_orderkey % 11 = 0 THEN 1 ELSE 0 END AS BIGINT) AS parse_error_count, CAST(sum(l_quantity) * 1000 AS BIGINT) AS duration_ms,
        CASE WHEN l_orderkey % 5 = 0 THEN 'FAILED' WHEN l_orderkey % 23 = 1 THEN 'STOPPED' WHEN l_orderkey % 41 = 2 THEN 'PARTIAL' ELSE 'COMPLETED' END AS status,
        max(CAST(l_shipdate AS TIMESTAMP)) AS created_at FROM lineitem GROUP BY l_orderkey""",
    "scored": "SELECT *, write_count * CAST(1000.0 AS DOUBLE) / greatest(1, duration_ms) AS throughput_rps FROM runs",
    "tasks_sla": "SELECT 'job' || CAST(p_partkey % 7 AS STRING) AS job_name, CAST(20000 + p_size * 1000 AS BIGINT) AS sla_ms FROM part",
    "audits": """SELECT event_id AS id, 't' || CAST(user_id AS STRING) AS task_id, CAST(CAST(ts AS DATE) AS STRING) AS batch_date,
        CASE event_type WHEN 'error' THEN 'FAILED' WHEN 'view' THEN 'RUNNING' WHEN 'click' THEN 'READY' WHEN 'signup' THEN 'PARTIAL' ELSE 'SUCCESS' END AS status,
        'r' || CAST(user_id % 20 AS STRING) AS run_key, date_trunc('millisecond', CAST(ts AS TIMESTAMP)) AS created_at, props, value FROM events""",
    "states": """SELECT task_id, batch_date, '' AS rerun_id, CASE WHEN id % 17 = 0 THEN 'BLOCKED' ELSE status END AS status, created_at AS updated_at, created_at AS next_retry_at,
        CASE WHEN id % 3 = 0 THEN created_at + INTERVAL '30' DAY END AS window_end FROM (SELECT *, row_number() OVER (PARTITION BY task_id, batch_date ORDER BY created_at DESC, id DESC) AS n FROM audits) AS a WHERE n = 1""",
    "instances": """SELECT id, task_id, batch_date AS biz_date, CASE status WHEN 'SUCCESS' THEN 'COMPLETED' WHEN 'PARTIAL' THEN 'PARTIAL_SUCCESS' ELSE status END AS status, created_at, id % 50 AS related_file_id FROM audits""",
    "dispatches": """SELECT o_orderkey AS id, o_custkey AS file_record_id, 'S' || CAST(o_orderkey % 5 AS STRING) AS target_system, CASE o_orderstatus WHEN 'O' THEN 'DISPATCHING' WHEN 'F' THEN 'DISPATCHED' ELSE 'RETRY' END AS dispatch_status,
        CASE WHEN o_orderkey % 3 = 0 THEN 'ACKED' WHEN o_orderkey % 7 = 0 THEN 'TIMEOUT' ELSE 'PENDING' END AS ack_status, o_orderkey % 2 = 0 AS ack_required, CAST(o_orderkey % 4 AS INT) AS attempt_count, CAST(3 AS INT) AS max_attempts,
        CAST(CASE WHEN o_orderkey % 3 = 1 THEN 30 WHEN o_orderkey % 3 = 2 THEN 0 END AS INT) AS ack_timeout_minutes, CASE WHEN o_orderkey % 10 <> 0 THEN CAST(o_orderdate AS TIMESTAMP) END AS last_dispatch_time,
        CASE WHEN o_orderkey % 4 = 0 THEN CAST(o_orderdate AS TIMESTAMP) + INTERVAL '400' DAY END AS ack_deadline_at FROM orders""",
    "distributions": """SELECT o_orderkey AS id, CASE o_orderkey % 5 WHEN 0 THEN 'PENDING' WHEN 1 THEN 'IN_PROGRESS' WHEN 2 THEN 'RETRY' WHEN 3 THEN 'COMPLETED' ELSE 'FAILED' END AS status, CAST(o_orderkey % 6 AS INT) AS retry_count, CAST(4 AS INT) AS max_retry,
        CAST(o_orderdate AS TIMESTAMP) AS created_at, CAST(o_orderdate AS TIMESTAMP) AS updated_at, CAST(o_orderdate AS TIMESTAMP) AS completed_at FROM orders""",
    "dlq": """SELECT id, 'import' AS job_name, 'businessKey=' || business_key || '&batchDate=' || batch_date || CASE WHEN id % 8 = 0 THEN '' ELSE '&name=' || replace(name, '#', '%23') END || '&note=a%26b' AS params,
        id % 3 = 0 AS handled, id % 4 <> 0 AS retryable, id % 9 = 1 AS manual_required, CAST(id % 6 AS INT) AS replay_count, created_at AS next_retry_at, created_at, CASE WHEN id % 5 <> 0 THEN 'OPEN' END AS compensation_status,
        CASE id % 6 WHEN 0 THEN 'Connection reset by peer' WHEN 1 THEN 'Duplicate key' WHEN 2 THEN 'no such column' WHEN 3 THEN 'Lock wait timeout' WHEN 4 THEN ' ' END AS error_message FROM records""",
    "files": """SELECT doc_id AS id, 'F' || CAST(doc_id AS STRING) AS file_no, source || '/' || lang AS stored_path, source AS source_system, md5(text) AS file_hash, n_chars AS file_size,
        CASE doc_id % 9 WHEN 0 THEN 'ARRIVED' WHEN 1 THEN 'READY' WHEN 2 THEN 'PROCESSING' WHEN 3 THEN 'PROCESSED' WHEN 4 THEN 'DISPATCHED' WHEN 5 THEN 'FAILED' WHEN 6 THEN 'ARCHIVED' WHEN 7 THEN 'UPLOADING' ELSE 'PROCESSED' END AS status,
        CASE WHEN doc_id % 4 = 0 THEN 'OUTBOUND' ELSE 'INBOUND' END AS file_direction, doc_id % 9 = 6 AS archived, TIMESTAMP '2024-01-01 00:00:00' + doc_id * INTERVAL '1' MINUTE AS arrived_at,
        TIMESTAMP '2024-01-01 00:00:00' + doc_id * INTERVAL '1' MINUTE AS created_at, TIMESTAMP '2024-01-02 00:00:00' + doc_id * INTERVAL '1' MINUTE AS processed_at, '2024-01-0' || CAST(1 + doc_id % 5 AS STRING) AS batch_date FROM documents""",
    "queue": """SELECT page_id AS id, 'f' || CAST(page_id % 200 AS STRING) || '.csv' AS file_name, url AS file_path, md5(html) AS file_hash, CAST(length(html) AS BIGINT) AS file_size, CASE page_id % 4 WHEN 0 THEN 'RECEIVED' WHEN 1 THEN 'WAITING' WHEN 2 THEN 'FAILED' ELSE 'PROCESSED' END AS status,
        'S' || CAST(page_id % 3 AS STRING) AS source_system, TIMESTAMP '2024-01-01 00:00:00' + page_id * INTERVAL '1' MINUTE AS created_at, TIMESTAMP '2024-01-01 00:00:00' + page_id * INTERVAL '1' MINUTE AS updated_at, TIMESTAMP '2024-01-01 01:00:00' + page_id * INTERVAL '1' MINUTE AS expected_process_time,
        CAST(page_id % 5 AS INT) AS retry_count, page_id % 7 AS record_count, CASE WHEN page_id % 4 <> 0 THEN page_id END AS file_record_id FROM pages""",
    "members": """SELECT 'm' || CAST(c_custkey % 50 AS STRING) AS manifest_id, 'f' || CAST(c_custkey AS STRING) || '.csv' AS expected_file_name, CASE WHEN c_custkey % 3 = 0 THEN c_custkey % 7 END AS expected_record_count,
        CAST(NULL AS STRING) AS expected_checksum, c_custkey % 4 = 0 AND c_custkey < 180 AS required, c_custkey AS file_record_id, c_custkey % 2 = 0 AS open FROM customer""",
    "groups": "SELECT manifest_id, 'WAITING_FILES' AS status, max(CASE WHEN length(manifest_id) = 2 THEN TIMESTAMP '2023-12-31 00:00:00' ELSE TIMESTAMP '2025-01-01 00:00:00' END) AS deadline FROM members GROUP BY manifest_id",
    "nodes": "SELECT 'p' || CAST(p_partkey AS STRING) AS task_id, CASE WHEN p_partkey % 13 = 5 THEN 'FAILED' WHEN p_partkey % 13 = 7 THEN 'PARTIAL' ELSE 'SUCCESS' END AS status FROM part",
    "edges": """SELECT 'p' || CAST(p_partkey AS STRING) AS task_id, 'p' || CAST(CAST(floor(p_partkey / 4) AS BIGINT) AS STRING) AS depends_on, CASE p_partkey % 3 WHEN 0 THEN 'FAIL' WHEN 1 THEN 'SKIP' ELSE 'IGNORE' END AS action, 0 AS ordinal FROM part WHERE p_partkey > 0
        UNION ALL SELECT 'p' || CAST(p_partkey AS STRING), 'p' || CAST(CAST(floor(p_partkey / 7) AS BIGINT) AS STRING), 'SKIP', 1 FROM part WHERE p_partkey > 6""",
}



def frame(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given or derived table."""
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    sql = re.sub(r"\b(FROM|JOIN) ([a-z_]+)\b", lambda m: f"{m[1]} {{{m[2]}}}", DERIVED[name])
    return spark.sql(sql, **{n: frame(spark, sf_dir, n) for n in re.findall(r"\{([a-z_]+)\}", sql)})


def with_derived(sql: str) -> str:
    """The statement with the derived tables it needs in front, for an engine that has the given ones."""
    order: list[str] = []

    def need(text: str) -> None:
        for n in re.findall(r"\b(?:FROM|JOIN) ([a-z_]+)\b", text):
            if n in DERIVED and n not in order:
                need(DERIVED[n])
                order.append(n)

    need(sql)
    ctes = [f"{n} AS ({DERIVED[n]})" for n in order]
    body = sql.strip()
    for opening in ("WITH RECURSIVE ", "WITH "):
        if body.upper().startswith(opening):
            return opening + ", ".join([*ctes, body[len(opening):]])
    return (f"WITH {', '.join(ctes)} " if ctes else "") + body

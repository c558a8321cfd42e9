"""Queries that apply each operator to its whole table, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from wharfline.llm import alignment, ann, exact_dedup, licenses, line_dedup, merkle, mixing, packing, quality, secrets, sharding, simhash, token_output


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_digests(table(spark, sf_dir, "documents"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.dedup_report(table(spark, sf_dir, "documents"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packing_digests(table(spark, sf_dir, "documents"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.licence_report(table(spark, sf_dir, "documents"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_report(table(spark, sf_dir, "documents"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_report(table(spark, sf_dir, "documents"))


def op8_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.ann_report(table(spark, sf_dir, "embeddings"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixing_report(table(spark, sf_dir, "documents"))


def op10_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output.token_digests(spark, table(spark, sf_dir, "documents"))


def op11_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.sharding_report(table(spark, sf_dir, "documents"))


def op12_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest_report(table(spark, sf_dir, "documents"))


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.alignment_report(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    numbered = (op1_secret_scan, op2_quality, op3_exact_dedup, op4_packing, op5_license_scan, op6_line_dedup, op7_simhash, op8_ann, op9_mixing, op10_token_output, op11_sharding, op12_manifest, op13_alignment)
    return {f.__name__: f for f in numbered}


OP3_SQL = r"""
WITH n AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS h FROM documents)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = min(doc_id) OVER g AS kept, h AS text_sha256
FROM n WINDOW g AS (PARTITION BY h)
"""


# the mix is the longest series of copies, in the order of their finish times, that fits the budget
OP9_SQL = r"""
WITH d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size, md5('0:' || CAST(doc_id AS VARCHAR)) AS key FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source IS NULL, source) - 1 AS rank FROM d GROUP BY source),
w AS (SELECT *, rank % 3 + 1 AS weight, source_size * 3 AS cap FROM s),
l AS (SELECT *, CAST(sum(source_size) OVER () - coalesce(sum(cap) OVER b, 0) AS DOUBLE) / CAST(sum(weight) OVER () - coalesce(sum(weight) OVER b, 0) AS DOUBLE) AS level
      FROM w WINDOW b AS (ORDER BY cap / CAST(weight AS DOUBLE), rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT level FROM l WHERE level * weight <= cap ORDER BY cap / CAST(weight AS DOUBLE), rank LIMIT 1),
t AS (SELECT source, rank, source_size, least(CAST(cap AS DOUBLE), (SELECT level FROM f) * weight) AS target FROM w),
r AS (SELECT d.*, t.rank, t.source_size, t.target, CAST(sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id) AS BIGINT) AS sent FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
c AS (SELECT doc_id, size, CAST(p * source_size + sent AS DOUBLE) / target AS finish, rank, p, key FROM r, range(3) AS g(p) WHERE size > 0 AND target > 0),
k AS (SELECT doc_id, sum(size) OVER (ORDER BY finish, rank, p, key, doc_id) AS run FROM c),
n AS (SELECT doc_id, count(*) AS repeats FROM k WHERE run <= (SELECT sum(source_size) FROM t) GROUP BY doc_id)
SELECT r.doc_id, r.size, r.source_size, r.target, CAST(r.size * coalesce(n.repeats, 0) AS BIGINT) AS taken FROM r LEFT JOIN n ON n.doc_id = r.doc_id
"""


def _crc32_sql(text: str) -> str:
    """The checksum of a short text of digits and signs, byte by byte; the table's entries are sums of those of single bits."""
    step = "c >> 8"
    for bit in range(8):
        x = 1 << bit
        for _ in range(8):
            x = (x >> 1) ^ (0xEDB88320 if x & 1 else 0)
        step = f"xor({step}, ((xor(c, b) >> {bit}) & 1) * {x})"
    codes = f"list_transform(range(1, length({text}) + 1), lambda i: CAST(ascii(substr({text}, CAST(i AS INT), 1)) AS BIGINT))"
    return f"xor(4294967295, list_reduce({codes}, lambda c, b: {step}, CAST(4294967295 AS BIGINT)))"


def _field_sql(value: str) -> str:
    return f"coalesce(CAST(strlen(CAST({value} AS VARCHAR)) AS VARCHAR) || ':' || CAST({value} AS VARCHAR), '-')"


# runs of children as columns, for both kinds of trees; then each leaf climbs by its siblings
_RUNS = "max(digest) FILTER (WHERE pos % 3 = 0) AS c0, max(digest) FILTER (WHERE pos % 3 = 1) AS c1, max(digest) FILTER (WHERE pos % 3 = 2) AS c2"
_LEFT = "CASE x.pos % 3 WHEN 0 THEN '' WHEN 1 THEN c0 ELSE c0 || c1 END"
_RIGHT = "CASE x.pos % 3 WHEN 0 THEN coalesce(c1, '') || coalesce(c2, '') WHEN 1 THEN coalesce(c2, '') ELSE '' END"
_HEAD = " || ".join(map(_field_sql, ("doc_id", "source", "lang", "n_chars")))
OP12_SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, source, sha256({_HEAD} || {_field_sql("text")}) AS leaf,
    CASE WHEN coalesce({_crc32_sql("CAST(doc_id AS VARCHAR)")} % 2 = 0, false) THEN sha256({_HEAD} || {_field_sql("replace(text, chr(10), '')")}) ELSE sha256({_HEAD} || {_field_sql("text")}) END AS tampered FROM documents),
t AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n FROM d),
w AS (SELECT 0 AS level, source, pos, n, leaf AS digest FROM t
    UNION ALL SELECT level + 1, source, pos // 3, (n + 2) // 3, sha256(string_agg(digest, '' ORDER BY pos)) FROM w WHERE n > 1 GROUP BY level, source, pos // 3, n),
r AS (SELECT level, source, pos // 3 AS run, {_RUNS} FROM w WHERE n > 1 GROUP BY level, source, pos // 3),
s AS (SELECT source, digest AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM w WHERE n = 1),
v AS (SELECT 0 AS level, pos, n, subroot AS digest FROM s
    UNION ALL SELECT level + 1, pos // 3, (n + 2) // 3, sha256(string_agg(digest, '' ORDER BY pos)) FROM v WHERE n > 1 GROUP BY level, pos // 3, n),
u AS (SELECT level, pos // 3 AS run, {_RUNS} FROM v WHERE n > 1 GROUP BY level, pos // 3),
p AS (SELECT 0 AS level, doc_id, source, leaf, pos, n, tampered AS fold, '' AS proof FROM t
    UNION ALL SELECT x.level + 1, x.doc_id, x.source, x.leaf, x.pos // 3, (x.n + 2) // 3, sha256({_LEFT} || fold || {_RIGHT}), proof || {_LEFT} || {_RIGHT}
    FROM p x JOIN r ON r.level = x.level AND r.source IS NOT DISTINCT FROM x.source AND r.run = x.pos // 3 WHERE x.n > 1),
q AS (SELECT 0 AS level, p.doc_id, p.leaf, s.subroot, s.pos, s.n, p.fold, p.proof FROM p JOIN s ON s.source IS NOT DISTINCT FROM p.source WHERE p.n = 1
    UNION ALL SELECT x.level + 1, x.doc_id, x.leaf, x.subroot, x.pos // 3, (x.n + 2) // 3, sha256({_LEFT} || fold || {_RIGHT}), proof || {_LEFT} || {_RIGHT} FROM q x JOIN u ON u.level = x.level AND u.run = x.pos // 3 WHERE x.n > 1),
g AS (SELECT digest AS root FROM v WHERE n = 1)
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, fold AS folded_root, fold = root AS verified FROM q, g WHERE n = 1
"""


def oracle_sql() -> dict[str, str]:
    return {"op3_exact_dedup": OP3_SQL, "op9_mixing": OP9_SQL, "op12_manifest": OP12_SQL}

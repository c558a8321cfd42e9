"""Sorted places, ordered digests and hash trees, against sequential Python."""

import hashlib
import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from wharfline.operators import hashtree, ordering, reconcile


def digest(rows, run):
    rows = sorted(rows, key=str.encode)
    while True:
        rows = [hashlib.md5(("\n".join(rows[at: at + run]) + "\n").encode()).hexdigest() for at in range(0, len(rows), run)]
        if len(rows) == 1:
            return rows[0]


def test_places(spark):
    rng = random.Random(1)
    rows = [(rng.choice([None, "a", "a", "a", "b"]), rng.choice([None, "x", f"y{rng.randrange(50)}"]), i) for i in range(500)]
    got = ordering.number_sorted(spark.createDataFrame(rows, "g string, v string, i int").repartition(6), ["g"], ["v", "i"]).collect()
    want = {}
    for g in (None, "a", "b"):
        for place, r in enumerate(sorted((r for r in rows if r[0] == g), key=lambda r: (r[1] is not None, r[1] or "", r[2]))):
            want[r[2]] = (g, place, sum(x[0] == g for x in rows))
    assert {r.i: (r.g, r.place, r.group_size) for r in got} == want


@pytest.mark.parametrize("run", [2, 7, 4096])
def test_ordered_digests(spark, run):
    """Groups of any size, one with most rows, repeated rows."""
    rng = random.Random(run)
    rows = [(f"g{min(rng.randrange(12), 3)}", f"row {rng.randrange(80)}é") for _ in range(400)] + [("one", "x")]
    by = defaultdict(list)
    for g, r in rows:
        by[g].append(r)
    df = spark.createDataFrame(rows, "g string, row string")
    assert {r.g: r.hash for r in ordering.ordered_md5(df, ("g",), run).collect()} == {g: digest(x, run) for g, x in by.items()}
    assert ordering.ordered_md5(df.repartition(3), run=run).first().hash == digest([r for _, r in rows], run)
    assert ordering.ordered_md5(df.limit(0), run=run).first().hash == hashlib.md5(b"").hexdigest()
    assert ordering.ordered_md5(df.limit(0), ("g",), run).count() == 0


def test_only_unlike_ranges_are_joined(spark, tmp_path):
    """Of 20,000 keys on each side, the rows that are joined are those of the ranges of the three that differ."""
    a = spark.range(20_000).select(F.concat(F.lit("k"), "id").alias("business_key"))
    b = a.filter("business_key not in ('k5', 'k600')").unionByName(spark.createDataFrame([("new",)], "business_key string"))
    found = {(r.business_key, r.diff_type) for r in hashtree.differing_keys(a, b).collect()}
    assert found == {("k5", "SOURCE_ONLY"), ("k600", "SOURCE_ONLY"), ("new", "TARGET_ONLY")}
    trees = [hashtree.write_tree(x, str(tmp_path / n)) for n, x in (("a", a), ("b", b))]
    ranges = hashtree.unlike_ranges(*trees)
    assert ranges.count() == 3
    want = {hashlib.md5(k.encode()).hexdigest()[:4] for k in ("k5", "k600", "new")}
    assert {r.node for r in ranges.collect()} == want
    joined = hashtree.unlike_rows(a, ranges)
    assert joined.count() == sum(hashlib.md5(f"k{i}".encode()).hexdigest()[:4] in want for i in range(20_000)) < 10
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "Exchange hashpartitioning(business_key" not in plan


def test_trees_of_like_tables(spark, tmp_path):
    a = spark.createDataFrame([("x", 1), ("x", 1), ("y", 2), (None, 3)], "business_key string, v int").withColumn("row", F.concat_ws(",", "business_key", "v"))
    trees = [hashtree.write_tree(x, str(tmp_path / str(n)), row="row") for n, x in enumerate((a, a.repartition(3), a.distinct(), a.limit(0)))]
    roots = [hashtree.root(t).first() for t in trees]
    assert roots[0] == roots[1] != roots[2] and roots[0].rows == 4 and roots[3].rows == 0
    assert hashtree.unlike_ranges(trees[0], trees[1]).count() == 0
    assert [r.node for r in hashtree.unlike_ranges(trees[0], trees[2]).collect()] == [hashlib.md5(b"x").hexdigest()[:4]]
    assert hashtree.unlike_ranges(trees[0], trees[3]).count() == 3
    assert hashtree.differing_keys(a, a.limit(0)).count() == 3 and hashtree.differing_keys(a.limit(0), a.limit(0)).count() == 0


def test_stored_ranges_prune_folders(spark, tmp_path):
    df = spark.range(5000).select(F.concat(F.lit("k"), "id").alias("business_key"), "id")
    hashtree.store_ranges(df, str(tmp_path / "t"))
    ranges = spark.createDataFrame([(hashlib.md5(b"k7").hexdigest()[:4],)], "node string")
    rows = hashtree.read_ranges(spark, str(tmp_path / "t"), ranges)
    assert [tuple(r) for r in rows.filter("id = 7").collect()] == [("k7", 7)] and rows.count() < 5
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*range_top", plan)


def test_reconcile_any_number_of_rows(spark):
    rows = spark.range(30_000).select(F.concat(F.lit("N"), "id").alias("name"), F.lit("d").alias("description"), F.lit("2026-03-02").alias("batch_date"), F.concat(F.lit("N"), "id", F.lit(":2026-03-02")).alias("business_key"))
    one = reconcile.reconcile_hash(rows, rows.repartition(5), "2026-03-02", exact=True).first()
    assert one.status == "PASS" and one.source_hash == digest([f"N{i}:2026-03-02,N{i},d" for i in range(30_000)], 4096)
    assert reconcile.reconcile_hash(rows, rows.filter("name <> 'N77'"), "2026-03-02", exact=True).first().status == "FAIL"
    run, diff = reconcile.reconcile(rows, rows.filter("name <> 'N77'"), "2026-03-02")
    assert run.first().status == "FAIL" and [tuple(r) for r in diff.collect()] == [("N77:2026-03-02", "SOURCE_ONLY")]


def test_plain_digests_of_many_rows(spark):
    """The MD5 that SQL takes, of groups beyond any run or block, whatever their number, with nulls and bytes of any script."""
    rng = random.Random(9)
    rows = [(rng.choice(["a", "b", "b", "b", None]), f"é{rng.randrange(4000)}" * rng.choice([1, 3])) for _ in range(30_000)]
    rows += [(f"g{i}", f"{i}") for i in range(500)] + [("long", "x" * 50_000), ("long", "y"), ("a", None), ("none", None)]
    df = spark.createDataFrame(rows, "g string, row string").repartition(5)
    by = defaultdict(list)
    for g, r in rows:
        by[g].append(r)
    plain = lambda x: hashlib.md5("".join(f"{r}\n" for r in sorted(r for r in x if r is not None)).encode()).hexdigest() if any(r is not None for r in x) else None
    found = ordering.ordered_md5(df, ("g",)).collect()
    assert {r.g: r.hash for r in found} == {g: plain(x) for g, x in by.items()}
    assert len(found) == len(by)
    assert ordering.ordered_md5(df).first().hash == plain([r for _, r in rows])
    assert ordering.ordered_md5(df.limit(0)).first().hash == hashlib.md5(b"").hexdigest()
    assert ordering.ordered_md5(df.limit(0), ("g",)).count() == 0


def test_reconcile_query_of_many_rows(spark, tmp_path):
    """The registered query has the plain MD5 on a day with more rows than a run of the tree."""
    from wharfline.queries import QUERIES

    spark.range(6000).select(F.col("id").alias("c_custkey"), F.concat(F.lit("n"), "id").alias("c_name")).write.parquet(f"{tmp_path}/customer.parquet")
    orders = spark.range(6000).select(F.col("id").alias("o_orderkey"), F.col("id").alias("o_custkey"), F.lit("p").alias("o_orderpriority"), F.expr("TIMESTAMP_NTZ '1997-05-03'").alias("o_orderdate"))
    orders.write.parquet(f"{tmp_path}/orders.parquet")
    row = QUERIES["R2_reconcile_hash"](spark, str(tmp_path)).first()
    plain = lambda ids: hashlib.md5("".join(sorted(f"N{i}:1997-05-01,N{i},p\n" for i in ids)).encode()).hexdigest()
    assert (row.source_hash, row.target_hash, row.status) == (plain(range(6000)), plain(i for i in range(6000) if i % 97), "FAIL")

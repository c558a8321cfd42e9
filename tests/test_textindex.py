"""Substring search by trigrams finds what ``contains`` finds, and reads a part of the table."""

import random
import re

import pytest
from pyspark.sql import functions as F

from wharfline.sources import textindex

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("index"))
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    textindex.build_index(docs, "text", path)
    return docs, path


def scanned(df):
    """Rows that the scan of the table gave."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    plan = plan.finalPhysicalPlan() if plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec" else plan
    leaves = plan.collectLeaves()
    return sum(leaves.apply(i).metrics().apply("numOutputRows").value() for i in range(leaves.size()))


def test_same_rows_as_a_scan(spark, index):
    docs, path = index
    rng = random.Random(4)
    texts = [r.text for r in docs.select("text").collect() if len(r.text) > 40]
    needles = ["the", "zq", "", "never-there-zzqx", "é", "\n"]
    for _ in range(12):
        text = rng.choice(texts)
        at = rng.randrange(len(text) - 30)
        needles.append(text[at: at + rng.randint(3, 30)])
    # keys and digests, as operators look them up
    rare = sorted({m[0] for t in texts for m in re.finditer("[0-9a-f]{24,}|AKIA[A-Z0-9]{16}", t)})[:6]
    needles += rare
    share = []
    for needle in needles:
        found = textindex.find(spark, path, "text", needle)
        want = docs.filter(F.col("text").contains(needle))
        assert sorted(r.doc_id for r in found.collect()) == sorted(r.doc_id for r in want.select("doc_id").collect()), needle
        if needle in rare:
            share.append(scanned(found) / docs.count())
    assert len(share) == 6 and max(share) < 0.2, share


def test_cases(spark, tmp_path):
    rows = [(1, None), (2, ""), (3, "ab"), (4, "abc"), (5, "x\U0001f600yz"), (5, "abcabc"), (6, "a%_c"), (7, "long " * 50_000 + "needle")]
    docs = spark.createDataFrame(rows, "id int, text string").repartition(3)
    path = str(tmp_path / "i")
    textindex.build_index(docs, "text", path, block_bits=1)
    for needle in ("abc", "ab", "", "\U0001f600yz", "%_c", "needle", "g long n", "zzz", "g needle"):
        got = sorted(r.id for r in textindex.find(spark, path, "text", needle).collect())
        assert got == sorted(i for i, t in rows if t is not None and needle in t), needle
    textindex.build_index(docs.limit(0), "text", str(tmp_path / "e"))
    assert textindex.find(spark, str(tmp_path / "e"), "text", "abc").count() == 0


def test_many_blocks_are_joined(spark, index, monkeypatch):
    docs, path = index
    monkeypatch.setattr(textindex, "MOST_BLOCKS", 2)
    assert textindex.find(spark, path, "text", "the").count() == docs.filter("contains(text, 'the')").count()

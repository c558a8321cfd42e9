"""Sharding, the Merkle manifest and alignment: against brute force."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from wharfline.llm import alignment, merkle, queries, sharding

SF = "/root/testdata/sf0.001"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def deal(sizes, loads):
    """slot -> shard: the largest first, to the least loaded that may take."""
    out = {}
    for slot in sorted(sizes, key=lambda s: (-sizes[s], s)):
        k = min((x, i) for i, x in enumerate(loads) if x is not None)[1]
        loads[k] += sizes[slot]
        out[slot] = k
    return out


def slot(doc_id, text, slots):
    key = str(doc_id) if doc_id is not None else "text " + hashlib.md5((text or "").encode()).hexdigest()
    return int(hashlib.md5(key.encode()).hexdigest()[:8], 16) % slots


def placed_rightly(rows, texts, shards, slots):
    sizes = dict.fromkeys(range(slots), 0)
    for doc_id, text in texts:
        sizes[slot(doc_id, text, slots)] += len((text or "").encode()) + 1
    shard_of = deal(sizes, [0] * shards)
    want = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode()), slot(i, t, slots), shard_of[slot(i, t, slots)]) for i, t in texts)
    assert Counter((r.doc_id, r.size, r.text_crc32, r.virtual_slot, r.shard) for r in rows) == want
    places = defaultdict(list)
    for r in rows:
        places[r.shard].append(r.place)
    assert all(sorted(p) == list(range(len(p))) for p in places.values())


def test_sharding_of_the_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = queries.op11_sharding(spark, SF).withColumnRenamed("slot", "place").collect()
    placed_rightly(rows, [(r.doc_id, r.text) for r in docs.collect()], 8, sharding.SLOTS)
    by = Counter()
    for r in rows:
        by[r.shard] += r.size
    assert max(by.values()) - min(by.values()) <= max(r.size for r in rows)


def test_sharding_cases(spark, documents, odd, empty, tmp_path):
    placed_rightly(sharding.sharded(odd, str(tmp_path / "a"), 3, 16).collect(), [(r.doc_id, r.text) for r in odd.collect()], 3, 16)
    assert sharding.sharding_report(empty).count() == 0
    assert sharding.read_map(spark, str(tmp_path / "a")).count() == 16
    # a third of the rows share an id, and another third have none
    many = documents(*((i if i % 3 == 0 else 7 if i % 3 == 1 else None, f"t{i % 50}") for i in range(300))).repartition(5)
    rows = sharding.sharded(many, str(tmp_path / "b"), 4, 64).collect()
    placed_rightly(rows, [(r.doc_id, r.text) for r in many.collect()], 4, 64)


def test_places_follow_ids_not_splits(documents, tmp_path):
    docs = documents(*((i, "x" * (i % 7)) for i in range(200)))
    a = sharding.sharded(docs.repartition(7), str(tmp_path / "a"), 3, 32).collect()
    b = sharding.sharded(docs.coalesce(1), str(tmp_path / "b"), 3, 32).collect()
    assert sorted(a) == sorted(b)


def test_maps_are_edited(spark, documents, tmp_path):
    docs, path = documents(*((i, "word " * (i % 40)) for i in range(2000))), str(tmp_path / "maps")
    shard = lambda rows: {r.doc_id: r.shard for r in rows.collect()}
    one = shard(sharding.sharded(docs, path, 4, 256))
    assert one == shard(sharding.sharded(docs, path, 4, 256))
    assert sharding.read_map(spark, path).agg(F.max("version")).first()[0] == 1
    grown = shard(sharding.sharded(docs, path, 5, 256))
    moved = [i for i in one if grown[i] != one[i]]
    assert moved and {grown[i] for i in moved} == {4} and len(moved) < 2000 * 0.3
    loads = {r.shard: r.b for r in sharding.read_map(spark, path).groupBy("shard").agg(F.sum("bytes").alias("b")).collect()}
    assert max(loads.values()) < 1.1 * min(loads.values())
    less = shard(sharding.sharded(docs, path, 4, 256))
    assert all(less[i] == grown[i] for i in grown if grown[i] < 4) and set(less.values()) == {0, 1, 2, 3}
    assert {r.version for r in spark.read.parquet(path).select("version").distinct().collect()} == {1, 2, 3}
    assert sharding.read_map(spark, path, 1).count() == 256
    sharding.write_shards(docs, str(tmp_path / "out"), path, 4, 256)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert {r.doc_id: r.shard for r in back.collect()} == less


def hashed(rows, fanout=3):
    """What the report must say, by plain recursion over lists."""

    def leaf(r, text):
        return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (r["doc_id"], r["source"], r["lang"], r["n_chars"], text)))

    def tree(nodes):
        proofs, members = [[] for _ in nodes], [[i] for i in range(len(nodes))]
        while len(nodes) > 1:
            above, grouped = [], []
            for at in range(0, len(nodes), fanout):
                run = nodes[at: at + fanout]
                for k in range(len(run)):
                    for i in members[at + k]:
                        proofs[i].append(("".join(run[:k]), "".join(run[k + 1:])))
                above.append(sha("".join(run)))
                grouped.append(sum(members[at: at + fanout], []))
            nodes, members = above, grouped
        return nodes[0], proofs

    by = defaultdict(list)
    for r in rows:
        by[r["source"]].append(r)
    sources = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = []
    for s in sources:
        by[s].sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r, r["text"])))
        trees.append(tree([leaf(r, r["text"]) for r in by[s]]))
    root, tops = tree([t[0] for t in trees])
    for s, (subroot, proofs), top in zip(sources, trees, tops, strict=True):
        for r, proof in zip(by[s], proofs, strict=True):
            text = r["text"]
            if text is not None and r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 2 == 0:
                text = text.replace("\n", "")
            now = leaf(r, text)
            for left, right in proof + top:
                now = sha(left + now + right)
            yield r["doc_id"], leaf(r, r["text"]), subroot, root, sha("".join(a + b for a, b in proof + top)), now, now == root


def same_manifest(docs):
    got = [tuple(r) for r in merkle.manifest_report(docs).collect()]
    assert Counter(got) == Counter(hashed([r.asDict() for r in docs.select(*merkle.FIELDS).collect()]))
    return got


def test_manifest_of_the_table(spark):
    rows = [tuple(r) for r in queries.op12_manifest(spark, SF).collect()]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert Counter(rows) == Counter(hashed([r.asDict() for r in docs.collect()]))
    assert 0 < sum(r[-1] for r in rows) < len(rows)


def test_manifest_cases(spark, documents, odd, empty):
    same_manifest(odd)
    assert merkle.manifest_report(empty).count() == 0
    assert same_manifest(documents((4, "a\nb")))[0][-1] is (zlib.crc32(b"4") % 2 == 1)
    # sources of 1 to 12 rows, none, and names that sort by bytes
    docs = documents(*((100 * k + i, f"line\n{i}", None if k == 0 else chr(0x40 + 9000 * (k % 5)) + "é" * k) for k in range(13) for i in range(max(1, k))))
    same_manifest(docs)
    same_manifest(docs.unionByName(docs))


def test_manifest_sql():
    """The statement against plain recursion, on nulls, ties and sources of many sizes."""
    import duckdb

    rows = [{"doc_id": 100 * k + i, "source": None if k == 0 else f"s{k % 7}é" * (k % 3 + 1), "lang": None if i % 5 == 0 else "en", "n_chars": i if i % 4 else None, "text": None if i % 6 == 5 else f"line\n{i}" * (i % 3)} for k in range(30) for i in range(k + 1)]
    rows += [{"doc_id": None, "source": "s1", "lang": "x", "n_chars": 1, "text": "a\nb"}, {"doc_id": -7, "source": "s1", "lang": "", "n_chars": 0, "text": ""}, rows[40], rows[40]]
    db = duckdb.connect()
    db.execute("CREATE TABLE documents (doc_id BIGINT, source VARCHAR, lang VARCHAR, n_chars BIGINT, text VARCHAR)")
    db.executemany("INSERT INTO documents VALUES (?, ?, ?, ?, ?)", [list(r.values()) for r in rows])
    assert Counter(db.execute(queries.OP12_SQL).fetchall()) == Counter(hashed(rows))


def test_proof_finds_any_change(documents):
    rows = merkle.manifest(documents(*((i, f"t{i}", f"s{i % 3}") for i in range(40))), F.concat("text", F.lit("!")))
    told = rows.select((merkle.folded(F.col("leaf"), F.col("proof")) == F.col("root")).alias("right"), (merkle.folded(F.col("tampered"), F.col("proof")) == F.col("root")).alias("wrong")).collect()
    assert all(r.right and not r.wrong for r in told)


@pytest.fixture(scope="module")
def coders():
    return alignment._coders(alignment._paths(None, None))


def test_common_ends():
    rng = np.random.default_rng(0)
    for lanes in (1, 2, 7, 60):
        for _ in range(30):
            n = int(rng.integers(1, 300))
            a, b = (np.unique(np.append(rng.integers(1, n + 1, n // 2 + 1), n)) for _ in range(2))
            starts = np.unique(np.append(0, rng.integers(0, n, lanes)))
            i, j = alignment.common_ends(a, b, starts)
            want = np.intersect1d(a, b)
            assert (a[i] == want).all() and (b[j] == want).all() and len(i) == len(want)
    assert len(alignment.common_ends(np.zeros(0, int), np.zeros(0, int), np.zeros(1, int))[0]) == 0


def groups_of(text, coders):
    """Groups by sets of ends, with the libraries themselves."""
    first, second = coders
    if not text:
        return []
    said = b" " + text.encode()
    a, b = first.tokenizer.encode(" " + text, add_special_tokens=False).ids, second.model.encode(text)
    bytes_a, bytes_b = [first.tokens[i] for i in a], [second.tokens[i] for i in b]
    if b"".join(bytes_a) != said or b"".join(bytes_b) != said:
        return []
    ends = [np.cumsum([len(t) for t in x]).tolist() for x in (bytes_a, bytes_b)]
    out, p, q = [], 0, 0
    for end in sorted(set(ends[0]) & set(ends[1])):
        i, j = ends[0].index(end, p) + 1, ends[1].index(end, q) + 1
        out.append((a[p:i], b[q:j]))
        p, q = i, j
    return out


def reported(texts, coders):
    docs = [(i, groups_of(t, coders)) for i, t in texts]
    links = [[(a, b) for ga, gb in g for a in ga for b in gb] for _, g in docs]
    count = Counter(pair for x in links for pair in set(x))
    best = defaultdict(int)
    for (a, _), n in count.items():
        best[a] = max(best[a], n)
    for (i, g), x in zip(docs, links, strict=True):
        spelt = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in g)
        yield i, sum(len(a) for a, _ in g), sum(len(b) for _, b in g), len(g), len(x), sum(count[p] == best[p[0]] for p in x), sum(count[p] for p in x), sha(spelt) if g else ""


@pytest.fixture(scope="module")
def strange():
    rng = random.Random(5)
    bits = ["a", "the", " ", "  ", "\n", "\t", "é", "ß", "中文", "\U0001f600", "▁", "<0x0A>", "<s>", "<|endoftext|>", "\x00", "́", "ﬁ", "1234", "=" * 9, "ไทย", "\r\n", " "]
    return ["".join(rng.choice(bits) for _ in range(rng.randrange(0, 60))) for _ in range(300)]


def test_alignment_of_the_table(spark, coders):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    assert Counter(tuple(r) for r in queries.op13_alignment(spark, SF).collect()) == Counter(reported(docs, coders))


def test_alignment_cases(spark, documents, odd, empty, coders, strange, monkeypatch):
    texts = list(enumerate(strange)) + [(1000, "ab" * 30_000), (1001, "x" * 3000), (1002, "▁")]
    docs = documents(*texts).repartition(3)
    got = [tuple(r) for r in alignment.alignment_report(docs).collect()]
    assert Counter(got) == Counter(reported(texts, coders))
    assert {r[0]: r[1:] for r in got}[1002] == (0, 0, 0, 0, 0, 0, "")
    assert Counter(tuple(r) for r in alignment.alignment_report(odd).collect()) == Counter(reported([(r.doc_id, r.text) for r in odd.collect()], coders))
    assert alignment.alignment_report(empty).count() == 0
    assert alignment.alignment_report(documents((1, None), (2, ""))).count() == 2


def test_links_in_parts(coders, strange, monkeypatch):
    x = alignment.align(strange, *coders)
    whole = alignment.linked_pairs(x)
    monkeypatch.setattr(alignment, "MOST_LINKS", 50)
    monkeypatch.setattr(alignment, "LANE_TOKENS", 3)
    parts = alignment.linked_pairs(alignment.align(strange, *coders))
    assert all((a == b).all() for a, b in zip(whole, parts, strict=True))


def test_aligned_documents(documents, coders, strange):
    for r in alignment.align_documents(documents(*enumerate(strange[:40]))).collect():
        a, b = [0, *r.a_ends], [0, *r.b_ends]
        assert [(r.a_ids[i:j], r.b_ids[k:m]) for i, j, k, m in zip(a, a[1:], b, b[1:], strict=False)] == groups_of(strange[r.doc_id], coders)


def test_translations(documents, coders):
    docs = documents(*((i, "the house") for i in range(3)), (3, "the"), (4, "thesis"))
    first, second = coders
    got = {(r.a_id, r.b_id): r.documents for r in alignment.translations(docs).collect()}
    the = (first.ids(" the")[0], second.model.encode("the")[0])
    assert got[the] == 4

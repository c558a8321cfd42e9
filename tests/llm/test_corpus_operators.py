"""Duplicates, lines, mixing, licences, neighbours, the pipeline: against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from wharfline.llm import ann, exact_dedup, licenses, line_dedup, mixing, shingles, simhash
from wharfline.llm.components import components


def union(n, links):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in links:
        p, q = sorted((find(a), find(b)))
        root[q] = p
    return [find(i) for i in range(n)]


@pytest.mark.parametrize("kind", ["random", "chain", "star", "none"])
def test_components(spark, kind):
    rng = random.Random(0)
    links = {"random": [(rng.randrange(80), rng.randrange(80)) for _ in range(60)], "chain": [(i, i + 1) for i in range(40)], "star": [(7, i) for i in range(60)], "none": []}[kind]
    want = union(81, links)
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: want[i] for a, b in links if a != b for i in (a, b)}


def test_exact_dedup(spark, documents, odd, empty):
    docs = documents((5, "a  b"), (2, "a\tb"), (9, "a b"), (4, "a b "), (1, "c"), (8, None), (3, ""))
    rows = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exact_dedup.dedup_report(docs, from_files=False).collect()}
    assert rows == {5: (2, 3, False), 2: (2, 3, True), 9: (2, 3, False), 4: (4, 1, True), 1: (1, 1, True), 8: (3, 2, False), 3: (3, 2, True)}
    report = exact_dedup.dedup_report(odd, from_files=False)
    assert report.count() == 9 and report.filter("kept").count() == 5
    kept = exact_dedup.keep_first(odd)
    assert kept.count() == 5 and kept.columns == odd.columns
    assert exact_dedup.dedup_report(empty, from_files=False).count() == 0


def test_bytes_settle_hits(documents):
    docs = documents(*((i, f"text {i % 6}") for i in range(30)))
    weak = lambda text: F.concat(F.lit("z"), F.crc32(text.cast("binary")) % 2)
    rows = exact_dedup.exact_groups(docs, digest=weak).collect()
    assert {(r.doc_id, r.keep_id, r.group_size) for r in rows} == {(i, i % 6, 5) for i in range(30)}


def test_state_goes_on(spark, documents, tmp_path):
    state = str(tmp_path / "state")
    exact_dedup.exact_groups(documents((5, "a"), (6, "b")), state_dir=state).count()
    rows = exact_dedup.exact_groups(documents((2, "a"), (7, "c")), state_dir=state).collect()
    assert {(r.doc_id, r.keep_id, r.group_size) for r in rows} == {(5, 2, 2), (2, 2, 2), (6, 6, 1), (7, 7, 1)}


def test_bytes_settle_hits_of_earlier_runs(documents, tmp_path):
    """All texts share one digest: the bytes of rows of earlier runs count too."""
    one = lambda text: F.lit("z")
    run = lambda name, *rows: {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_groups(documents(*rows), digest=one, state_dir=str(tmp_path / name)).collect()}
    run("x", (1, "a"), (2, "a"))
    assert run("x", (3, "b"), (4, "b")) == {(1, 1, 2, True), (2, 1, 2, False), (3, 3, 2, True), (4, 3, 2, False)}
    run("y", (1, "a"), (2, "b"))
    assert run("y", (6, "a"), (7, "b")) == {(1, 1, 2, True), (6, 1, 2, False), (2, 2, 2, True), (7, 2, 2, False)}


def test_rows_seen_again(spark, documents, tmp_path):
    """A file read by two runs is one set of rows; its texts are found again in the file."""
    path, weak = str(tmp_path / "docs"), lambda text: F.crc32(text.cast("binary")) % 2
    documents(*((i, f"text {i % 3}") for i in range(9))).write.parquet(path)
    for _ in range(2):
        rows = exact_dedup.exact_groups(spark.read.parquet(path), True, weak, str(tmp_path / "state")).collect()
        assert {(r.doc_id, r.keep_id, r.group_size) for r in rows} == {(i, i % 3, 3) for i in range(9)} and len(rows) == 9
    more = exact_dedup.exact_groups(documents((20, "text 1"), (21, "new")), digest=weak, state_dir=str(tmp_path / "state")).collect()
    assert {(r.doc_id, r.keep_id, r.group_size) for r in more} == {(i, i % 3, 4 if i % 3 == 1 else 3) for i in range(9)} | {(20, 1, 4), (21, 21, 1)}


def brute_print(text):
    folded = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in "".join(" " if c in " \t\n\v\f\r" else c for c in folded).split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i: i + 4]) for i in range(len(words) - 3)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprint_is_the_engines_hash(spark):
    row = spark.range(1).select(F.xxhash64(F.lit("hello world foo bar"))).first()[0]
    assert simhash.fingerprint("Hello WORLD\tfoo bar") == row % (1 << 64) == xxhash.xxh64_intdigest(b"hello world foo bar", 42)


def test_simhash(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    # near copies: one word changed
    more = [(1000 + i, t.replace(" the ", " thee ", 1)) for i, t in rows[:60]]
    docs = spark.createDataFrame(rows + more, "doc_id long, text string")
    prints = {i: brute_print(t) for i, t in rows + more}
    ids = sorted(prints)
    want = union(len(ids), [(a, b) for a in range(len(ids)) for b in range(a) if bin(prints[ids[a]] ^ prints[ids[b]]).count("1") <= 4])
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.simhash_report(docs).collect()}
    assert got == {i: (format(prints[i], "016x"), ids[want[n]]) for n, i in enumerate(ids)}


@pytest.mark.parametrize("tile", [8, 4096])
def test_tiles_lose_no_link(spark, tile):
    rng = random.Random(1)
    words = [rng.getrandbits(64) for _ in range(40)]
    for w in list(words):
        for _ in range(12):
            v = w
            for b in rng.sample(range(64), rng.randrange(6)):
                v ^= 1 << b
            words.append(v)
    words = list(dict.fromkeys(words))
    want = union(len(words), [(a, b) for a in range(len(words)) for b in range(a) if bin(words[a] ^ words[b]).count("1") <= 4])
    signed = [w - (1 << 64) if w >> 63 else w for w in words]
    links = [(r.a, r.b) for r in simhash.near_links(spark.createDataFrame([(s,) for s in signed], "fingerprint long"), 4, tile).collect()]
    at = {s: i for i, s in enumerate(signed)}
    assert union(len(words), [(at[a], at[b]) for a, b in links]) == want
    assert all(bin((a ^ b) % (1 << 64)).count("1") <= 4 or want[at[a]] == want[at[b]] for a, b in links)


def test_tiles_far_apart_never_meet(spark):
    """Of fingerprints under one block value, those with unlike population counts are not even dealt to a common pair of tiles."""
    rng = random.Random(6)
    prints = [sum(1 << b for b in rng.sample(range(60), ones)) for ones in range(0, 60, 2) for _ in range(20)]
    prints = list(dict.fromkeys(prints))
    df = spark.createDataFrame([(p,) for p in prints], "fingerprint long")
    rows = simhash.tile_pairs(df, [0], 4, 50).collect()
    tiles = defaultdict(set)
    for r in rows:
        tiles[r.own].add(bin(r.fingerprint).count("1"))
    made = {(min(r.own, r.other), max(r.own, r.other)) for r in rows}
    near = {(i, j) for i in tiles for j in tiles if i <= j and any(abs(a - b) <= 4 for a in tiles[i] for b in tiles[j])}
    every = len(tiles) * (len(tiles) + 1) // 2
    assert near <= made and len(made) < 0.4 * every and max(Counter(r.own for r in {(r.own, r.fingerprint): r for r in rows}.values()).values()) < 100


@pytest.mark.parametrize("count", [10, 10_000, 10_000_000, 10_000_000_000])
def test_masks_cover(count):
    masks, rng = simhash.block_masks(count), random.Random(2)
    for _ in range(500):
        diff = sum(1 << b for b in rng.sample(range(64), 4))
        assert any(not diff & m for m in masks)


def test_simhash_odd(odd, empty):
    rows = simhash.simhash_report(odd).collect()
    assert len(rows) == 9 and {r.component_id for r in rows if r.doc_id in (1, 2, 8)} == {1}
    kept = simhash.keep_first(odd)
    assert kept.columns == odd.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["1", "3", "3", "7", "9", "None", "None"]
    assert simhash.simhash_report(empty).count() == 0


def test_lines(spark):
    base = ["the quick brown fox jumps over the lazy dog by the river bank at noon today " * 2, "entirely other words stand in this one line of text about nothing much at all here"]
    near = base[0].replace("noon", "moon", 1)
    docs = spark.createDataFrame([(1, f"{base[0]}\n\n{base[1]}"), (2, f"x\n{near}\n{base[1]}\nx"), (3, None), (4, ""), (5, " \n \n" + base[0])], "doc_id long, text string")
    got = {r.doc_id: (r.n_lines, r.dropped) for r in line_dedup.line_report(docs).collect()}
    assert got == {1: (3, ""), 2: (4, "1,2,3"), 3: (0, ""), 4: (1, ""), 5: (3, "2")}
    clean = {r.doc_id: r.text for r in line_dedup.clean_documents(docs).collect()}
    assert clean[2] == "x" and clean[5] == " \n " and clean[3] is None


def brute_shingles(line, size=12):
    """All stretches of twelve characters; a shorter line is one."""
    return {line[at: at + size] for at in range(max(1, len(line) - size + 1))}


@given(st.text(alphabet=st.sampled_from([*"abcXYZ019 .,-_/\t\r", "é", "Ж", "漢", "字", "ー", "\U0001f600"]), min_size=1, max_size=60))
@settings(max_examples=40, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
def test_shingles(spark, line):
    own = brute_shingles(line)
    got = line_dedup.shingle_sets(spark.createDataFrame([(1, line), (2, line + "!"), (3, "x")], "id long, line string"), "id").collect()
    by = {r.id: set(r.shingles) for r in got}
    assert all(len(r.shingles) == len(by[r.id]) for r in got)
    assert len(by[1]) == len(own) and len(by[1] & by[2]) == len(own & brute_shingles(line + "!"))


def test_lines_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.orderBy("doc_id").collect()]
    first = {}
    for i, t in rows:
        for k, line in enumerate(t.split("\n")):
            if line.strip(" "):
                first.setdefault(line, (i, k))
    lines = list(first)
    sets = [brute_shingles(line) for line in lines]
    posts, links = defaultdict(list), []
    for i, s in enumerate(sets):
        for j, m in Counter(j for x in s for j in posts[x]).items():
            if m >= 0.8 * (len(s) + len(sets[j]) - m):
                links.append((i, j))
        for x in s:
            posts[x].append(i)
    root = union(len(lines), links)
    keep = {}
    for i, line in enumerate(lines):
        keep[root[i]] = min(keep.get(root[i], (1 << 60, 0)), first[line])
    at = {line: i for i, line in enumerate(lines)}
    want = {(i, str(k)) for i, t in rows for k, line in enumerate(t.split("\n")) if line.strip(" ") and keep[root[at[line]]] != (i, k)}
    got = {(r.doc_id, k) for r in line_dedup.line_report(docs).collect() for k in r.dropped.split(",") if k}
    # comparisons are exact; bands may miss a pair just above the threshold
    assert got <= want and len(got) >= 0.98 * len(want)


def edited_lines(rng, n, low, high, passage=0):
    """n pairs of lines of low to high bytes with a Jaccard similarity of 0.80 to 0.85; a share of each line is one common passage."""
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(3, 8)))
    text = lambda size: " ".join(word() for _ in range(size))[:size]
    common, out = text(high), []
    while len(out) < n:
        size = rng.randint(low, high)
        a = common[: int(size * passage)] + text(size - int(size * passage))
        at = rng.randrange(len(a))
        b = a[:at] + text(rng.randint(1, max(1, size // 12))) + a[at + rng.randint(0, size // 12):]
        x, y = brute_shingles(a), brute_shingles(b)
        if 0.8 <= len(x & y) / len(x | y) <= 0.85:
            out.append((a, b))
    return out


def banded(spark, lines):
    """The bands of each line."""
    table = spark.createDataFrame([(i, 0, line, 1) for i, line in enumerate(lines)], "h1 long, h2 long, line string, n long")
    signed = {r.h1: r for r in line_dedup.signatures(table).collect()}
    return [{(n, *(signed[i][f"m{k}"] for k in band)) for n, band in enumerate(line_dedup.BANDS)} for i in range(len(lines))]


def test_lines_of_a_common_passage(spark):
    lines = [line for pair in edited_lines(random.Random(5), 900, 100, 160, 0.6) for line in pair]
    sets = [brute_shingles(line) for line in lines]
    bands = banded(spark, lines)
    alike = [(i, j) for j in range(len(lines)) for i in range(j) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    like = [(i, j) for i, j in alike if bands[i] & bands[j]]
    root, whole = union(len(lines), like), union(len(lines), alike)
    assert sum(len(bands[i] & bands[j]) == 1 for i, j in like) > 5
    docs = spark.createDataFrame([(i, line) for i, line in enumerate(lines)], "doc_id long, text string")
    got = {r.doc_id for r in line_dedup.dropped_lines(docs).collect()}
    # each similar pair that meets in any band is found, whatever the bucket's centre, and nothing but similar pairs
    assert {i for i, r in enumerate(root) if r != i} <= got <= {i for i, r in enumerate(whole) if r != i}


@pytest.mark.parametrize("low, high", [(40, 90), (90, 150), (150, 300)])
def test_fuzzy_lines_meet(spark, low, high):
    pairs = edited_lines(random.Random(low), 300, low, high)
    bands = banded(spark, [line for pair in pairs for line in pair])
    met = sum(bool(bands[2 * i] & bands[2 * i + 1]) for i in range(len(pairs)))
    assert met >= 0.98 * len(pairs), met


THAI = "ภาษาไทยเป็นภาษาที่มีระดับเสียงของคำแน่นอนหรือวรรณยุกต์เช่นเดียวกับภาษาจีน"


@pytest.mark.parametrize("line", ["".join(random.Random(8).choices("abcdefghij", k=300)), "\t".join(f"w{i * 7919 % 1000}" for i in range(40)), THAI * 3, "https://example.org/" + "/".join(f"{i * i:x}" for i in range(60)), "".join(map(chr, random.Random(2).choices(range(0x4E00, 0x9FA0), k=200)))])
def test_any_insertion_is_a_near_copy(documents, line):
    """Lines without words: a character in front, in the middle or at the end moves no other shingle."""
    copies = [line, "X" + line, line[:70] + "X" + line[70:], line + "XY"]
    sets = [brute_shingles(c) for c in copies]
    assert all(len(sets[0] & x) >= 0.8 * len(sets[0] | x) for x in sets)
    docs = documents(*enumerate(copies, 1), (5, "another line, quite unlike the ones above"))
    assert {r.doc_id for r in line_dedup.dropped_lines(docs).collect()} == {2, 3, 4}


def test_similar_pairs():
    rng = random.Random(9)
    a = ["".join(rng.choices("abé ", k=rng.choice([0, 3, 12, 80, 400]))) for _ in range(200)]
    b = [x[: len(x) - 4] + rng.choice(["", "zzzz", "abababab"]) if rng.random() < 0.7 else rng.choice(a) for x in a]
    sets = [(brute_shingles(x), brute_shingles(y)) for x, y in zip(a, b, strict=True)]
    assert shingles.similar(a, b, 12, 0.8).tolist() == [len(x & y) >= 0.8 * len(x | y) for x, y in sets]


def test_window_hashes_of_blocks(spark, monkeypatch):
    """Equal stretches have equal hashes wherever they stand, unlike ones unlike hashes."""
    rng = random.Random(3)
    lines = ["".join(rng.choices("abcé漢\U0001f600 ", k=rng.choice([1, 5, 11, 12, 13, 40, 3000]))) for _ in range(60)]
    hashes, starts = shingles.window_hashes(lines, 12)
    ends = [*starts[1:], len(hashes)]
    known = {}
    for line, i, j in zip(lines, starts, ends, strict=True):
        own = [line[at: at + 12] for at in range(max(1, len(line) - 11))]
        assert len(own) == j - i and all(known.setdefault(t, h) == h for t, h in zip(own, hashes[i:j].tolist(), strict=True))
    assert len(set(known.values())) == len(known)


def test_lines_without_python(spark):
    """Sets, signatures and similarities are DataFrame operations, and similarities are exact."""
    rng = random.Random(4)
    lines = ["".join(rng.choices("abé\U0001f600 ", k=rng.choice([1, 5, 12, 80, 400]))) for _ in range(40)]
    lines += [x[: len(x) - 4] + rng.choice(["", "zzzz", "abababab"]) for x in lines]
    table = spark.createDataFrame([(i, 0, line, 1) for i, line in enumerate(lines)], "h1 long, h2 long, line string, n long")
    pairs = table.select(F.col("h1").alias("a1"), F.col("h2").alias("a2"), ((F.col("h1") + 40) % 80).alias("b1"), F.col("h2").alias("b2"))
    like = line_dedup.verified(pairs, table, 0.8)
    for df in (line_dedup.shingle_sets(table, "h1"), line_dedup.signatures(table), like):
        assert "InArrow" not in (plan := df._jdf.queryExecution().toString()) and "PythonUDF" not in plan
    sets = [brute_shingles(line) for line in lines]
    want = {i: len(sets[i] & sets[(i + 40) % 80]) >= 0.8 * len(sets[i] | sets[(i + 40) % 80]) for i in range(80)}
    assert {r.a1: r.like for r in like.collect()} == want and len(set(want.values())) == 2


def test_lines_that_meet_none_are_read_once(spark, monkeypatch):
    """Only lines that share a bucket are read for their texts; outlines word by word hold a bit for each shingle."""
    words = lambda n: " ".join(f"w{n * k % 9973:04d}" for k in range(1, 12))
    texts = [words(n) for n in range(1, 200)] + [words(7) + " x", words(9) + " y"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    seen = []
    plain = line_dedup.verified
    monkeypatch.setattr(line_dedup, "verified", lambda pairs, lines, *more: seen.append(lines.count()) or plain(pairs, lines, *more))
    kept = {(r.doc_id, r.line_no) for r in line_dedup.dropped_lines(docs).collect()}
    assert kept == {(199, 0), (200, 0)} and seen and max(seen) < 20
    rows = spark.createDataFrame([(n, -n, t) for n, t in enumerate(texts)], "h1 long, h2 long, line string")
    sets = {r.h1: set(r.shingles) for r in line_dedup.shingle_sets(rows, "h1").collect()}
    for r in line_dedup.outlines(rows, line_dedup.SHINGLE).collect():
        bits = [0] * line_dedup.OUTLINE
        for h in sets[r.h1]:
            bits[h >> 6 & line_dedup.OUTLINE - 1] |= 1 << (h & 63)
        assert r.n == len(sets[r.h1]) and [r[f"o{i}"] & 2**64 - 1 for i in range(line_dedup.OUTLINE)] == bits


def test_lines_odd(odd, empty):
    assert line_dedup.line_report(odd).count() == 9
    assert line_dedup.line_report(empty).count() == 0


def brute_targets(sizes, weights=(1, 2, 3), most=3):
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    target, open_, left = {}, set(names), float(sum(sizes.values()))
    while open_:
        level = left / sum(w[s] for s in open_)
        over = {s for s in open_ if level * w[s] > most * sizes[s]}
        if not over:
            return target | {s: level * w[s] for s in open_}
        for s in over:
            target[s] = float(most * sizes[s])
            left -= target[s]
        open_ -= over
    return target


def test_mixing(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(["w"] * rng.randrange(0, 60)), f"s{i % 5}" if i % 50 else "tiny" if i % 100 else None) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mixing_report(docs).toPandas()
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += len(t.split())
    targets = brute_targets(dict(sizes))
    by = {i: s for i, _, s in rows}
    taken = defaultdict(int)
    for r in got.itertuples():
        assert abs(r.target - targets[by[r.doc_id]]) < 1e-6 and r.source_size == sizes[by[r.doc_id]]
        assert r.taken in (0, r.size, 2 * r.size, 3 * r.size)
        taken[by[r.doc_id]] += r.taken
    assert all(abs(taken[s] - targets[s]) <= 120 for s in targets) and sum(taken.values()) <= sum(sizes.values())
    again = mixing.mixing_report(docs.repartition(7)).toPandas()
    assert got.sort_values("doc_id").values.tolist() == again.sort_values("doc_id").values.tolist()
    repeated = Counter(r.doc_id for r in mixing.mixed_documents(docs).collect())
    assert sum(repeated[r.doc_id] * r.size for r in got.itertuples()) == got.taken.sum()


def test_mixing_odd(odd, empty):
    rows = mixing.mixing_report(odd.withColumn("source", F.when(F.col("doc_id") == 7, "b").otherwise(F.col("source")))).collect()
    assert len(rows) == 9 and all(r.taken <= 3 * r.size for r in rows)
    assert mixing.mixing_report(empty).count() == 0
    assert mixing.mixed_documents(odd).columns == odd.columns


def test_licences(spark, odd, empty):
    rows = [(1, "a/LICENSE", "Licensed under the Apache License, Version 2.0."), (2, "a/b/c.txt", "nothing"), (3, "a/b/LICENSE", "Released under the MIT License."), (4, "a/b/d/e.txt", None), (5, "z.txt", "hi"), (6, None, "All rights reserved."), (7, "q/w.c", "code x y z with many words and more words\nLicensed under CC BY-NC 4.0."), (8, "a/x/y/z.c", "this licence word fits no template at all")]
    docs = spark.createDataFrame(rows, "doc_id long, path string, text string")
    got = {r.doc_id: (r.own, r.licence, r.inherited_from) for r in licenses.scan_licences(docs).collect()}
    assert got == {1: ("Apache-2.0", "Apache-2.0", None), 2: (None, "MIT", "a/b"), 3: ("MIT", "MIT", None), 4: (None, "MIT", "a/b"), 5: (None, None, None), 6: ("Proprietary", "Proprietary", None), 7: ("CC-BY-NC-4.0", "CC-BY-NC-4.0", None), 8: (None, "Apache-2.0", "a")}
    assert licenses.licence_report(odd).count() == 9
    assert licenses.licence_report(empty).count() == 0


def full_text(*names):
    return "\n\n".join(sentence for name in names for sentence in licenses.TEMPLATES[name])


def test_licence_files(spark):
    """Whole texts, wrapped and commented headers, identifiers."""
    import textwrap

    gpl = " ".join((licenses.TEMPLATES["GPL-3.0"][-1], *licenses.TEMPLATES["GPL*"]))
    rows = {
        "m/LICENSE": (full_text("MIT", "MIT*"), "MIT"), "b/LICENSE": (full_text("BSD-2-Clause*"), "BSD-2-Clause"), "c/LICENSE": (full_text("BSD-2-Clause*", "BSD-3-Clause"), "BSD-3-Clause"),
        "w/a.py": ("\n".join("# " + x for x in textwrap.wrap(gpl, 60)) + "\n\nimport os\n" + "x = y + z\n" * 40, "GPL-3.0"), "w/b.c": ("/*\n" + "\n".join(" * " + x for x in textwrap.wrap(licenses.TEMPLATES["Apache-2.0"][3], 50)) + "\n */\nint main() {}\n" + "a b c d;\n" * 40, "Apache-2.0"),
        "s/a.rs": ("// SPDX-License-Identifier: MPL-2.0\nfn main() {}", "MPL-2.0"), "m/x/y.c": ("int x;", "MIT"), "w/c.py": ("import re", None), "n/a.txt": ("the permission of the author and the public of the version", None),
    }
    docs = spark.createDataFrame([(i, p, t) for i, (p, (t, _)) in enumerate(rows.items())], "doc_id long, path string, text string")
    assert {r.path: r.licence for r in licenses.scan_licences(docs).collect()} == {p: want for p, (_, want) in rows.items()}


LONG = {
    "Apache-2.0": ("Apache License\nVersion 2.0, January 2004\nhttp://www.apache.org/licenses/", "APPENDIX: How to apply the Apache License to your work.\n\nLicensed under the Apache License, Version 2.0 (the \"License\");\nyou may not use this file except in compliance with the License."),
    "GPL-3.0": ("GNU GENERAL PUBLIC LICENSE\nVersion 3, 29 June 2007", "The GNU General Public License does not permit incorporating your program into proprietary programs."),
    "GPL-2.0": ("GNU GENERAL PUBLIC LICENSE\nVersion 2, June 1991", "END OF TERMS AND CONDITIONS"),
    "AGPL-3.0": ("GNU AFFERO GENERAL PUBLIC LICENSE\nVersion 3, 19 November 2007", "END OF TERMS AND CONDITIONS"),
    "MPL-2.0": ("Mozilla Public License Version 2.0\n==================================", "Exhibit A"),
    "EPL-2.0": ("Eclipse Public License - v 2.0", "Exhibit A"),
    "CC0-1.0": ("Creative Commons Legal Code\n\nCC0 1.0 Universal", "Affirmer offers the Work as-is."),
}


def test_whole_texts_license_their_directories(spark):
    """Long licences, of which templates know the title only: the name of the file says that it holds one."""
    body = "\n\n".join(f"{n}. Terms of clause {n} that say who grants what to whom and under which conditions each of them holds." for n in range(1, 120))
    rows = [(f"{name}/{file}", f"{'' if n % 2 else ' ' * 20}{top}\n\n{body}\n\n{end}") for n, (name, (top, end)) in enumerate(LONG.items()) for file in (("LICENSE", "COPYING", "LICENSE.txt")[n % 3],)]
    rows += [(f"{name}/src/x.c", "int x;") for name in LONG] + [("plain/notes.txt", LONG["GPL-3.0"][0] + "\n\n" + body), ("plain/x.c", "int y;"), ("bsd/LICENSE", "Copyright (c) 2020. All rights reserved.\n\n" + full_text("BSD-2-Clause*")), ("bsd/x.c", "int z;"), ("none/LICENSE", "see elsewhere"), ("none/x.c", "int w;")]
    docs = spark.createDataFrame([(i, p, t) for i, (p, t) in enumerate(rows)], "doc_id long, path string, text string")
    got = {r.path: r.licence for r in licenses.scan_licences(docs).collect()}
    assert {name: got[f"{name}/src/x.c"] for name in LONG} == {name: name for name in LONG}
    assert got["plain/notes.txt"] == "GPL-3.0" and got["plain/x.c"] is None and got["bsd/x.c"] == "BSD-2-Clause" and got["none/x.c"] is None


def test_rows_of_one_id_and_path(spark):
    docs = spark.createDataFrame([(1, "a/b.txt", "Released under the MIT License."), (1, "a/b.txt", "hello all"), (1, "a/b.txt", "Licensed under CC BY 4.0.")], "doc_id long, path string, text string")
    assert sorted(str(r.own) for r in licenses.scan_licences(docs, file_share=2.0).collect()) == ["CC-BY-4.0", "MIT", "None"]


def test_licences_against_brute_force(spark):
    """Each sentence of each document with each template, TF-IDF by hand."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r.doc_id, r.text or "") for r in docs.collect()]
    cut = lambda text: [t for t in re.split(r"[^\w.+-]+|_|[.-]+(?=\s|$)", text.lower()) if t]
    known = [(name.rstrip("*"), name.endswith("*"), Counter(cut(t))) for name, texts in licenses.TEMPLATES.items() for t in texts]
    vocabulary = {t for *_, c in known for t in c}
    df = Counter(t for _, text in rows for t in set(cut(text)) & vocabulary)
    idf = lambda t: np.log((1 + len(rows)) / (1 + (df[t] if t in vocabulary else 0))) + 1
    vector = lambda c: {t: n * idf(t) for t, n in c.items()}
    norm = lambda v: np.sqrt(sum(x * x for x in v.values()))
    vectors = [(name, shared, v := vector(c), norm(v)) for name, shared, c in known]
    posts, want = defaultdict(list), {}
    for i, (*_, v, _) in enumerate(vectors):
        for t in v:
            posts[t].append(i)
    seen = {}
    for doc, text in rows:
        best = None
        for part in {s for line in [*text.split("\n"), *(re.sub(r"\s*\n\s*", " ", p) for p in re.split(r"\n\s*\n", text))] for s in re.split(r"(?<=[.!?;:])\s+", line)}:
            if part not in seen:
                seen[part] = None
                w = vector(Counter(cut(part)))
                near = Counter(i for t in w if t in posts for i in posts[t])
                for i in near:
                    name, shared, v, length = vectors[i]
                    score = round(sum(x * w.get(t, 0) for t, x in v.items()) / length / norm(w), 9)
                    if score >= 0.6:
                        seen[part] = min(seen[part] or (9,), (shared, -score, name))
            if seen[part]:
                best = min(best or (9,), seen[part])
        want[doc] = best and (best[2], -best[1])
    got = {r.doc_id: (r.own, r.score) if r.own else None for r in licenses.licence_report(docs).collect()}
    assert sum(x is not None for x in want.values()) > 20 and got.keys() == want.keys()
    assert all((g is None) == (w is None) and (g is None or g[0] == w[0] and abs(g[1] - w[1]) < 1e-5) for g, w in ((got[k], want[k]) for k in want))


def test_neighbours(spark):
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    got = ann.ann_report(rows).toPandas()
    data = rows.orderBy("vec_id").toPandas()
    x = np.array(data.embedding.tolist(), float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    ids, hits, n = data.vec_id.to_numpy(), 0, 0
    for i in np.flatnonzero(ids % 50 == 0):
        s = x @ x[i]
        s[i] = -2
        best = ids[np.lexsort((ids, -s))[:5]]
        mine = got[got.query_id == ids[i]].sort_values("rank")
        assert mine["rank"].tolist() == [1, 2, 3, 4, 5] and np.allclose(mine.score, s[np.searchsorted(ids, mine.vec_id)], atol=1e-9)
        hits, n = hits + len(set(best) & set(mine.vec_id)), n + 5
    assert hits / n >= 0.9


def test_neighbours_odd(spark):
    nan = float("nan")
    rows = [(0, [1.0, 0.0]), (50, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [1.0, 1.0]), (3, None), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [None, 1.0]), (7, [1.0]), (None, [1.0, 2.0]), (8, [1e30, 1e30]), (100, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({"node": F.lit(1), "v": F.lit(2), "label": F.lit(0)})
    got = {(r.query_id, r.rank): (r.vec_id, round(r.score, 6)) for r in ann.ann_report(df).collect()}
    assert got == {(0, 1): (1, 1.0), (0, 2): (50, 1.0), (0, 3): (2, 0.707107), (0, 4): (8, 0.707107), (50, 1): (0, 1.0), (50, 2): (1, 1.0), (50, 3): (2, 0.707107), (50, 4): (8, 0.707107)}
    assert ann.ann_report(df.limit(0)).count() == 0


def fair_queue(rows):
    """doc_id to the number of its copies in the mix, taken one by one in the order of their finish times."""
    sizes, sent, copies = Counter(), Counter(), []
    for _, source, n in rows:
        sizes[source] += n
    target = brute_targets(sizes)
    rank = {s: i for i, s in enumerate(sorted(sizes, key=lambda s: (s is None, s or "")))}
    key = lambda i: hashlib.md5(f"0:{i}".encode()).hexdigest()
    for i, source, n in sorted(rows, key=lambda r: (key(r[0]), r[0])):
        sent[source] += n
        copies += [((p * sizes[source] + sent[source]) / target[source], rank[source], p, key(i), i, n) for p in range(3) if n and target[source] > 0]
    out, run = Counter(), 0
    for *_, i, n in sorted(copies):
        run += n
        if run > sum(sizes.values()):
            break
        out[i] += 1
    return out


def test_pipeline(spark):
    """Each stage against brute force on what it was given."""
    import corpus_pipeline
    from tokenizers import Tokenizer

    from wharfline.llm import packing, quality
    from wharfline.llm.tokens import vocabulary_path
    from wharfline.llm.workdir import materialize

    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    ids = lambda df: sorted(r.doc_id for r in df.collect())
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        rows = [(r.doc_id, r.text or "", r.source) for r in docs.collect()]
        out = materialize(spark, stage(spark, docs, folder), f"stage{n}")
        if n < 4:
            assert out.columns == docs.columns
        if n == 0:
            model = quality.train(docs, labels)
            from test_text_operators import brute_statistics

            score = lambda text: model.score(np.array([[brute_statistics(text)[k] for k in model.names]]))[0]  # noqa: B023, E731
            want = sorted(i for i, text, _ in rows if score(text) >= 0.3)
        elif n == 1:
            first = {}
            for i, text, _ in sorted(rows):
                first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", text), i)
            want = sorted(first.values())
        elif n == 2:
            prints = [brute_print(text) for _, text, _ in rows]
            root = union(len(rows), [(a, b) for a in range(len(rows)) for b in range(a) if bin(prints[a] ^ prints[b]).count("1") <= 4])
            least = {}
            for (i, _, _), r in zip(rows, root, strict=True):
                least[r] = min(i, least.get(r, i))
            want = sorted(least.values())
        elif n == 3:
            want = sorted(fair_queue([(i, source, len(re.findall(r"[^\x20\x09-\x0D]+", text))) for i, text, source in rows]).elements())
        else:
            plain, texts = Tokenizer.from_file(vocabulary_path("byte_bpe_50k.json")), {i: text for i, text, _ in rows}
            pieces = packing.pack(docs).select("doc_id", "start", "length", "sequence_id", "offset", "ids").collect()
            assert {(r.doc_id, r.start, r.length, r.sequence_id, r.offset): zlib.crc32(r.ids) for r in pieces} == {(r.doc_id, r.start, r.length, r.sequence_id, r.offset): r.ids_crc32 for r in out.collect()}
            total = Counter()
            for r in pieces:
                total[r.doc_id] += r.length
            copies = Counter(i for i, *_ in rows)
            assert total == {i: k * (len(plain.encode(texts[i], add_special_tokens=False).ids) + 1) for i, k in copies.items()}
            continue
        assert ids(out) == want, name
        docs = out


def test_queries(spark):
    import __spark_entry__

    names = set(__spark_entry__.queries())
    assert "pipeline" in names and {n.split("_")[0] for n in names if n.startswith("op")} == {f"op{i}" for i in range(1, 14)}


@pytest.mark.parametrize("pivots", [40, 256])
@pytest.mark.filterwarnings("error::RuntimeWarning")
def test_footrule(pivots):
    """Shared pivots lower the footrule distance of two truncated orders by twice what the files add up."""
    rng = np.random.default_rng(4)
    order = np.stack([rng.permutation(pivots)[:9] for _ in range(60)]).astype(np.uint8)
    order[:20, 3] = pivots - 1  # the last file too
    order = np.stack([o if len(set(o)) == 9 else np.append(rng.permutation(pivots - 1)[:8], pivots - 1) for o in order]).astype(np.uint8)
    files = ann.Files(order)
    assert sum(files.ends[p + 1] - files.ends[p] for p in range(256)) == order.size
    for own in order[:10]:
        gain = files.shared(own)
        for row, other in enumerate(order):
            place = lambda o, p: list(o).index(p) if p in o else 9
            distance = sum(abs(place(own, p) - place(other, p)) for p in range(pivots))
            assert distance == 2 * (45 - gain[row])


def test_more_pivots_than_a_byte_are_refused(spark):
    with pytest.raises(ValueError, match="256 at most"):
        ann.search(spark.createDataFrame([(1, [1.0])], "vec_id long, embedding array<double>"), "true", pivots=257)


@pytest.mark.parametrize("block_rows", [500, 16_384])
def test_recall(spark, block_rows):
    data = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    got = ann.search(data, "vec_id % 50 = 0", block_rows=block_rows).toPandas()
    rows = data.orderBy("vec_id").toPandas()
    x = np.array(rows.embedding.tolist(), float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    ids, hits, all_ = rows.vec_id.to_numpy(), 0, 0
    for q, found in got.groupby("query_id"):
        near = x @ x[ids == q][0]
        near[ids == q] = -2
        hits += len(set(ids[np.argsort(-near)[:5]]) & set(found.vec_id))
        all_ += 5
    assert all_ == 5 * sum(ids % 50 == 0) and hits >= 0.93 * all_, hits / all_


def test_pipeline_cases(spark, odd, empty):
    """Stages on nulls, ties, long texts, clashing columns, and on no rows at all: columns stay, and texts are those of the input."""
    import corpus_pipeline

    for docs, least in ((odd, 1), (empty.withColumn("score", F.lit(1)), 0)):
        texts = {r.text or "" for r in docs.select("text").collect()}
        now = docs
        for name, stage in corpus_pipeline.STAGES[:-1]:
            now = corpus_pipeline.materialize(spark, stage(spark, now, "/root/testdata/sf0.001"), name.replace(" ", "-"))
            assert now.columns == docs.columns and {r.text or "" for r in now.select("text").collect()} <= texts
        pieces = corpus_pipeline.STAGES[-1][1](spark, now, "/root/testdata/sf0.001").collect()
        assert len(pieces) >= least * now.count() and all(p.length > 0 for p in pieces)
        # one row of each group of equal texts at most, but for the repeats of the mix
        assert now.select("text").distinct().count() <= len({" ".join(t.split()) for t in texts})

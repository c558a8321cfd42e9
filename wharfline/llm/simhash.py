"""SimHash near-duplicates: documents whose 64-bit fingerprints differ in few bits.

Fingerprints are compared exactly, in tiles: numpy exclusive-or and bit counts over sorted runs. An index of
``radius + 1`` bit blocks comes first, so that not all tiles meet: two fingerprints within the radius share a
block at least (pigeonhole), so no link is lost. The blocks get wider combinations as the number of distinct
fingerprints grows: of m blocks any ``m - radius`` are shared by some choice. Fingerprints of one block value are
dealt to tiles in the order of their population counts; each pair of tiles is compared by a task of its own,
and pairs of tiles whose population counts differ beyond the radius are never made. Inside a pair, runs beyond
the radius are skipped too.

Equal fingerprints are one node. A tile emits a spanning forest of its links, not all pairs; components are
joined up by star contraction.

Cases: a text without words, null included, has fingerprint zero, which links like any other; a text of fewer
words than a shingle is one shingle; rows with equal or null ids are rows of their own, and a null id never
names a component of others; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wharfline.llm.components import components
from wharfline.llm.workdir import materialize, shuffle_partitions

RADIUS, WORDS = 4, 4
SEED = 42
#: Fingerprints in a tile at most, and on average where block values are even.
TILE, FEW = 1024, 64
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
_UPPER = bytes(range(65, 91))
_LOWER = bytes(range(97, 123))
_FOLD = bytes.maketrans(_UPPER, _LOWER)
#: Shingles whose bits are added up at once.
CHUNK = 1 << 15


def fingerprint(text: str, words: int = WORDS) -> int:
    """The fingerprint of a text, unsigned."""
    import xxhash

    digest = xxhash.xxh64_digest
    tokens = _WORD.findall(text.encode("utf-8", "surrogatepass").translate(_FOLD))
    if not tokens:
        return 0
    line = b" ".join(tokens)
    n = max(1, len(tokens) - words + 1)
    if n == 1:
        hashes = [digest(line, SEED)]
    else:
        sizes = np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1
        ends = np.cumsum(sizes) - 1
        starts = (ends - sizes + 1)[:n].tolist()
        hashes = [digest(line[a:b], SEED) for a, b in zip(starts, ends[words - 1:].tolist(), strict=True)]
    ones = np.zeros(64, np.int64)
    for at in range(0, n, CHUNK):
        part = np.frombuffer(b"".join(hashes[at: at + CHUNK]), np.uint8)
        ones += np.unpackbits(part).reshape(-1, 64).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprints(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id and fingerprint, whose 64 bits are kept as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = np.array([fingerprint(x.as_py() or "", words) for x in batch.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bits.view(np.int64))], names=["doc_id", "fingerprint"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id bigint, fingerprint bigint")


def block_masks(count: int, radius: int = RADIUS, few: int = FEW) -> list[int]:
    """Bit masks such that two words within the radius agree under one of them at least.

    64 bits fall into m blocks; differing bits touch ``radius`` of them at most, so some m - radius blocks
    agree. More blocks give wider masks but more of them; the fewest that keep tiles small are taken.
    """
    for m in range(radius + 1, 12):
        width = 64 * (m - radius) // m
        if count <= few << width or comb(m + 1, radius) > 330:
            break
    edges = [64 * i // m for i in range(m + 1)]
    blocks = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:], strict=False)]
    return [sum(blocks[i] for i in chosen) for chosen in combinations(range(m), m - radius)]


def roots(links_a: np.ndarray, links_b: np.ndarray, n: int) -> np.ndarray:
    """The smallest index in the component of each of n nodes."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[links_a], root[links_b])
        new = root.copy()
        np.minimum.at(new, root[links_a], low)
        np.minimum.at(new, root[links_b], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def tile_links(tile: np.ndarray, prints: np.ndarray, side: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links in pairs of tiles: runs of one number, sorted by population count inside.

    side: 0 and 1 for the two tiles of a pair, whose own members meet elsewhere; 2 for a tile met with itself.
    """
    bits = prints.view(np.uint64)  # of negative numbers numpy counts the bits of the absolute value
    counts = np.bitwise_count(bits).astype(np.int64)
    live = np.arange(len(prints))
    root = np.arange(len(prints))
    lag, found_a, found_b, held = 1, [], [], 0
    while True:
        live = live[live + lag < len(prints)]
        live = live[(tile[live + lag] == tile[live]) & (counts[live + lag] - counts[live] <= radius)]
        if not len(live):
            break
        near = live[(side[live] == 2) | (side[live] != side[live + lag])]
        near = near[np.bitwise_count(bits[near] ^ bits[near + lag]) <= radius]
        near = near[root[near] != root[near + lag]]
        found_a.append(near)
        found_b.append(near + lag)
        held += len(near)
        if held > len(prints):  # contract, so that a dense tile keeps few links
            root = roots(np.concatenate([*found_a, np.arange(len(prints))]), np.concatenate([*found_b, root]), len(prints))
            found_a, found_b, held = [], [], 0
        lag += 1
    root = roots(np.concatenate([*found_a, np.arange(len(prints))]), np.concatenate([*found_b, root]), len(prints)) if found_a else root
    moved = np.flatnonzero(root != np.arange(len(prints)))
    return prints[moved], prints[root[moved]]


def tile_pairs(prints: DataFrame, masks: list[int], radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """fingerprint, block, value, own, other: each fingerprint with the tiles that it meets under each mask.

    Tiles of a block value are numbered by population count; ``own`` is the fingerprint's tile, and ``other``
    runs over the tiles that hold counts within the radius of its own.
    """
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    choices = F.array(*(F.struct(F.lit(i).alias("block"), F.col("fingerprint").bitwiseAND(F.lit(m)).alias("value")) for i, m in enumerate(signed)))
    rows = prints.select("fingerprint", F.bit_count("fingerprint").alias("ones"), F.inline(choices))
    # 65 population counts at most for a block value
    sizes = rows.groupBy("block", "value", "ones").agg(F.count("*").alias("n"))
    group = Window.partitionBy("block", "value")
    upto = lambda ones: F.coalesce(F.sum("n").over(group.orderBy("ones").rangeBetween(Window.unboundedPreceding, ones)), F.lit(0))
    sizes = sizes.select("block", "value", "ones", "n", F.sum("n").over(group).alias("all"), upto(-1).alias("before"), upto(-radius - 1).alias("low"), upto(radius).alias("high")).filter("all > 1")
    rows = rows.join(sizes, ["block", "value", "ones"])
    number = lambda place: F.floor(place / tile).cast("int")
    own = number(F.col("before") + F.pmod(F.xxhash64("fingerprint"), F.col("n")))
    return rows.select("fingerprint", "block", "value", own.alias("own"), F.explode(F.sequence(number(F.col("low")), number(F.col("high") - 1))).alias("other"))


def near_links(prints: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """a, b: links between distinct fingerprints (column ``fingerprint``) that span all links within the radius."""
    spark = prints.sparkSession
    rows = tile_pairs(prints, block_masks(prints.count(), radius), radius, tile)
    number = F.xxhash64("block", "value", F.least("own", "other"), F.greatest("own", "other")).alias("tile")
    side = F.when(F.col("own") == F.col("other"), 2).otherwise((F.col("own") > F.col("other")).cast("int")).alias("side")
    rows = rows.select(number, "fingerprint", side)
    tiles = rows.repartition(shuffle_partitions(spark), "tile").sortWithinPartitions("tile", F.bit_count("fingerprint"), "fingerprint")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int32)]
        for batch in batches:
            whole = [np.concatenate((a, b.to_numpy())) for a, b in zip(kept, batch.columns, strict=True)]
            if not len(whole[0]):
                continue
            cut = int(np.searchsorted(whole[0], whole[0][-1]))  # the last pair of tiles may go on
            kept = [a[cut:] for a in whole]
            yield from links(*(a[:cut] for a in whole))
        yield from links(*kept)

    def links(number: np.ndarray, bits: np.ndarray, side: np.ndarray) -> Iterator[pa.RecordBatch]:
        a, b = tile_links(number, bits, side, radius)
        if len(a):
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return tiles.mapInArrow(run, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, radius: int = RADIUS, words: int = WORDS) -> DataFrame:
    """doc_id, fingerprint (signed long), component_id: the smallest doc_id reachable over links."""
    spark = docs.sparkSession
    rows = materialize(spark, fingerprints(docs, words), "simhash")
    nodes = materialize(spark, rows.groupBy("fingerprint").agg(F.min("doc_id").alias("first")), "simhash")
    found = components(near_links(nodes.select("fingerprint"), radius))
    joined = nodes.join(found, nodes.fingerprint == found.node, "left").select("fingerprint", "first", F.coalesce("component", "fingerprint").alias("component"))
    joined = materialize(spark, joined, "simhash")
    least = joined.groupBy("component").agg(F.min("first").alias("component_id"))
    named = joined.join(least, "component").select("fingerprint", "component_id")
    return rows.join(named, "fingerprint").select("doc_id", "fingerprint", "component_id")


def simhash_report(docs: DataFrame) -> DataFrame:
    """One row for each document, its fingerprint as 16 hexadecimal digits."""
    return near_duplicates(docs).select("doc_id", F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, radius: int = RADIUS, words: int = WORDS) -> DataFrame:
    """The documents of which each component keeps one, that of the smallest doc_id; those without an id stay."""
    rows = near_duplicates(docs, radius, words).filter("doc_id IS NOT NULL")
    dropped = rows.groupBy("doc_id").agg(F.max(F.col("doc_id") == F.col("component_id")).alias("kept")).filter("NOT kept")
    return docs.join(dropped.select("doc_id"), "doc_id", "left_anti").select(*docs.columns)

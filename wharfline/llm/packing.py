"""Packing documents into sequences by order-preserving dynamic programming.

Documents are laid end to end in the order of ``doc_id`` and the stream is cut into windows of at most
``seq_len`` tokens. Cuts fall at ends of documents, at ends of sentences, or, where a sentence is long, at
grid points inside it. The cost of a window is its padding (none at a power of two) plus a penalty for the
kind of its last cut; the cheapest series of cuts comes from a shortest-path recurrence over cut points,
whose window minimum is kept in a monotone queue.

Spark deals the stream out by ranges of ``doc_id``; each task packs its range on its own, so a partition
adds at most one unfinished sequence. A task holds one block of tokens at a time.

Cases: a null text is empty and gives one piece holding the end id; rows with equal or null ``doc_id`` are
packed as documents of their own, in the order of a hash of their text; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wharfline.llm.tokens import END_ID, ByteLevelEncoder, encoder, vocabulary_path
from wharfline.llm.workdir import shuffle_partitions, spare_name

PIECES = "doc_id bigint, start bigint, length bigint, doc_tokens bigint, sequence_id bigint, offset bigint"
SCHEMA = [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())]
#: Penalties in tokens of padding.
SENTENCE_PENALTY, INSIDE_PENALTY = 8, 48
#: Cut points inside a document are at least about so many tokens apart.
GRAIN = 32
BLOCK_TOKENS = 1 << 20


def cut_points(doc_lengths: list[int], doc_ends: list[np.ndarray], seq_len: int, grain: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions where the stream may be cut and what each cut costs; ends of documents cost nothing.

    doc_ends: for each document the offsets of its sentence ends. Of the sentence ends in a cell of ``grain``
    tokens the last counts. A stretch of over a quarter of a window without any gets grid points.
    """
    places, costs, base = [np.zeros(1, np.int64)], [np.zeros(1, np.int64)], 0
    grain = max(1, min(grain, seq_len // 4))  # so that any two neighbouring places share a window
    grid = max(grain, seq_len // 8)
    for length, ends in zip(doc_lengths, doc_ends, strict=True):
        if length > grain:
            inside = ends[(ends > 0) & (ends < length)]
            if len(inside):
                cell = inside // grain
                inside = inside[np.append(cell[1:] != cell[:-1], True)]
            marks = np.concatenate(([0], inside, [length]))
            cost = np.full(len(inside), SENTENCE_PENALTY, np.int64)
            wide = np.flatnonzero(np.diff(marks) > seq_len // 4)
            if len(wide):
                extra = np.concatenate([np.arange(marks[i] + grid, marks[i + 1], grid) for i in wide])
                inside = np.concatenate((inside, extra))
                cost = np.concatenate((cost, np.full(len(extra), INSIDE_PENALTY, np.int64)))
                order = np.argsort(inside, kind="stable")
                inside, cost = inside[order], cost[order]
            places.append(inside + base)
            costs.append(cost)
        base += length
        places.append(np.array([base]))
        costs.append(np.zeros(1, np.int64))
    return np.concatenate(places), np.concatenate(costs)


def best_cuts(places: list[int], costs: list[int], seq_len: int) -> list[int]:
    """Cuts, as positions from the first to the last place, of least padding plus penalties.

    A window of length n pads ``seq_len - n`` tokens, or none if n is a power of two. Neighbouring places lie
    at most ``seq_len`` apart.
    """
    powers = [1 << k for k in range(5, seq_len.bit_length()) if 1 << k <= seq_len]
    at = {p: i for i, p in enumerate(places)}
    total, back = [0] * len(places), [0] * len(places)
    queue: deque[tuple[int, int]] = deque([(places[0], 0)])  # (total + place, index), rising
    find = at.get
    for j in range(1, len(places)):
        p = places[j]
        low = p - seq_len
        while places[queue[0][1]] < low:
            queue.popleft()
        key, i = queue[0]
        best = key + seq_len - p
        if best > 0:
            for n in powers:
                k = find(p - n)
                if k is not None and total[k] < best:
                    best, i = total[k], k
        best += costs[j]
        total[j], back[j] = best, i
        key = best + p
        while queue and queue[-1][0] >= key:
            queue.pop()
        queue.append((key, j))
    cuts, j = [], len(places) - 1
    while j:
        cuts.append(places[j])
        j = back[j]
    return [places[0], *cuts[::-1]]


def split_tail(start: int, stop: int, seq_len: int) -> list[int]:
    """Cuts of the last window: into powers of two, if that costs less than its padding."""
    n = stop - start
    if n == seq_len or (bin(n).count("1") - 1) * INSIDE_PENALTY >= seq_len - n:
        return [stop]
    out, at = [], start
    for k in range(n.bit_length() - 1, -1, -1):
        if n >> k & 1:
            at += 1 << k
            out.append(at)
    return out


class Packer:
    """Packs the documents of one task in order."""

    def __init__(self, part: int, seq_len: int, grain: int = GRAIN, block_tokens: int = BLOCK_TOKENS):
        self.seq_len, self.grain, self.block = seq_len, grain, block_tokens
        self.next_sequence = part << 40
        self.docs: list[tuple] = []  # (doc_id, ids, sentence ends, tokens before those that are left)
        self.held = 0

    def add(self, doc_id, ids: bytes, ends: np.ndarray) -> list[tuple]:
        self.docs.append((doc_id, ids, ends, 0))
        self.held += len(ids) // 4
        return self.flush() if self.held >= self.block else []

    def flush(self, last: bool = False) -> list[tuple]:
        """Pieces of all windows, but for the last one of a block that goes on."""
        if not self.docs:
            return []
        lengths = [len(d[1]) // 4 - d[3] for d in self.docs]
        places, costs = cut_points(lengths, [d[2] - d[3] for d in self.docs], self.seq_len, self.grain)
        cuts = best_cuts(places.tolist(), costs.tolist(), self.seq_len)
        if last:
            cuts = [*cuts[:-1], *split_tail(cuts[-2], cuts[-1], self.seq_len)]
        else:
            cuts = cuts[:-1]
        pieces, k, base = [], 0, 0  # base: the place where document k begins
        for left, right in zip(cuts, cuts[1:], strict=False):
            offset = 0
            while left < right:
                doc_id, ids, _, gone = self.docs[k]
                stop = min(right, base + lengths[k])
                a = gone + left - base
                n = stop - left
                pieces.append((doc_id, a, n, len(ids) // 4, self.next_sequence, offset, ids[4 * a: 4 * (a + n)]))
                offset += n
                left = stop
                if stop == base + lengths[k]:
                    base += lengths[k]
                    k += 1
            self.next_sequence += 1
        kept = self.docs[k:]
        if kept and not last:
            doc_id, ids, ends, gone = kept[0]
            kept[0] = (doc_id, ids, ends, gone + cuts[-1] - base)
        self.docs = [] if last else kept
        self.held = sum(len(d[1]) // 4 - d[3] for d in self.docs)
        return pieces


def _batches(pieces: list[tuple], digests: bool) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([*SCHEMA, ("ids_crc32", pa.int64()) if digests else ("ids", pa.binary())])
    for at in range(0, len(pieces), 4096):
        *columns, ids = zip(*pieces[at: at + 4096], strict=True)
        columns.append(map(zlib.crc32, ids) if digests else ids)
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def in_order(docs: DataFrame, *others: str, partitions: int | None = None) -> DataFrame:
    """doc_id, text (null: empty) and ``others``, dealt out and sorted by doc_id; equal ids by a hash of the text."""
    n = partitions or shuffle_partitions(docs.sparkSession)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), *others)
    tie = spare_name(rows, "tie")
    rows = rows.withColumn(tie, F.xxhash64("text"))
    return rows.repartitionByRange(n, "doc_id", tie).sortWithinPartitions("doc_id", tie, "text").drop(tie)


def pack(docs: DataFrame, seq_len: int = 2048, vocabulary: str | None = None, partitions: int | None = None, digests: bool = False) -> DataFrame:
    """Pieces of documents by sequence, with their ids as little-endian unsigned 32-bit integers.

    ``start`` counts the ids of the document before the piece, ``offset`` those of the sequence before it.
    digests: ``ids_crc32``, the checksum of the ids, in place of them.
    """
    path = vocabulary or vocabulary_path("byte_bpe_50k.json")
    end = END_ID.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(ByteLevelEncoder, path)
        packer = Packer(TaskContext.get().partitionId(), seq_len)
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids, ends = coder.encode_with_ends(text.as_py())
                yield from _batches(packer.add(doc_id, ids + end, ends), digests)
        yield from _batches(packer.flush(last=True), digests)

    return in_order(docs, partitions=partitions).mapInArrow(run, PIECES + (", ids_crc32 bigint" if digests else ", ids binary"))


def packing_digests(docs: DataFrame, seq_len: int = 2048) -> DataFrame:
    """One row for each piece, its ids as a checksum."""
    return pack(docs, seq_len, digests=True).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")

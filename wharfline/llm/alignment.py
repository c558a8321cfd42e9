"""Alignment of the token sequences that two tokenizers make of one text.

Byte offsets at which tokens of both end cut them into groups; every pair of tokens in a group is a link. The merge
of the two series of offsets is done in lockstep: a state vector holds a pair of pointers for each lane (a
document, or a stretch of a long one), one step advances all of them and gives the cuts, and lanes that are
done are taken out. Lanes need no common start, since a cut depends on the offsets alone.

Counts of linked pairs are over the whole corpus. Pairs are counted by chunks of some megabytes of text first,
so that frequent pairs are a row for each chunk, and each chunk gets back the counts of its own pairs only.

Cases: texts that are null, empty, or that a tokenizer doesn't give back byte for byte have no tokens; they keep their
row; rows with equal or null ids are documents of their own; a long text is a chunk by itself; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wharfline.llm.tokens import ByteLevelEncoder, encoder, vocabulary_path
from wharfline.llm.workdir import Scratch, materialize

#: Bytes of text that are aligned together, and of a chunk whose pairs are counted together.
BLOCK_BYTES, CHUNK_BYTES = 1 << 21, 1 << 23
#: Tokens of a lane.
LANE_TOKENS = 512
#: Links that are unfolded at once.
MOST_LINKS = 1 << 21
#: Bits of a token id of the second tokenizer in the number of a pair.
PAIR_BITS = 15


class OrdinaryByteLevel(ByteLevelEncoder):
    """The byte-level vocabulary with strings of special tokens as plain text."""

    def __init__(self, path: str):
        super().__init__(path)
        self.tokenizer.encode_special_tokens = True
        self.tokens = [self.bytes_of.get(i, b"") for i in range(self.size)]
        self.lengths = np.array([len(t) for t in self.tokens], np.int64)

    def ids(self, text: str) -> np.ndarray:
        if self.coder is None or self._other.search(text):
            return self.whole(text)
        return self.coder.encode_to_numpy(text, disallowed_special=())


class PieceEncoder:
    """A sentencepiece vocabulary, whose pieces write a space as U+2581."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=path)
        self.size = self.model.get_piece_size()
        self.tokens = [bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(map(self.model.id_to_piece, range(self.size)))]
        self.lengths = np.array([len(t) for t in self.tokens], np.int64)

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)


def common_ends(ends_a: np.ndarray, ends_b: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indexes of the tokens of both series that end at the same offset, in order.

    Both series rise. starts: offsets, 0 first, at which lanes begin; a lane ends where the next one begins.
    """
    bound_a, bound_b = np.searchsorted(ends_a, starts, "right"), np.searchsorted(ends_b, starts, "right")
    a, b, last_a, last_b = bound_a, bound_b, np.append(bound_a[1:], len(ends_a)), np.append(bound_b[1:], len(ends_b))
    found_a, found_b = [], []
    while True:
        live = (a < last_a) & (b < last_b)
        if not live.all():
            a, b, last_a, last_b = a[live], b[live], last_a[live], last_b[live]
        if not len(a):
            break
        x, y = ends_a[a], ends_b[b]
        cut = x == y
        found_a.append(a[cut])
        found_b.append(b[cut])
        # of unlike ends, the pointer that is behind goes on
        a, b = a + (x <= y), b + (y <= x)
    order = np.concatenate(found_a or [np.zeros(0, np.int64)])
    other = np.concatenate(found_b or [np.zeros(0, np.int64)])
    by = np.argsort(order)
    return order[by], other[by]


@dataclass
class Aligned:
    """A block of documents, whose tokens stand one document after another."""

    a: np.ndarray  #: ids of the first tokenizer
    b: np.ndarray
    doc_a: np.ndarray  #: for each document the tokens before it, and all of them at the end
    doc_b: np.ndarray
    cut_a: np.ndarray  #: for each group the tokens before its end
    cut_b: np.ndarray
    doc_groups: np.ndarray  #: for each document the groups before it, and all of them at the end


def align(texts: list[str | None], first: OrdinaryByteLevel, second: PieceEncoder) -> Aligned:
    """Tokens and groups of some texts."""
    ids_a, ids_b, sizes = [], [], []
    nothing = np.zeros(0, np.int64)
    whole = [t for t in texts if t]
    pieces = iter(second.encode(whole) if whole else [])
    for text in texts:
        a = b = nothing
        if text:
            said = b" " + text.encode("utf-8", "surrogatepass")
            got = next(pieces)
            if b"".join(map(second.tokens.__getitem__, got)) == said:
                a = first.ids(" " + text)
                if b"".join(map(first.tokens.__getitem__, a.tolist())) == said:
                    b = np.array(got, np.int64)
                else:
                    a = nothing
        ids_a.append(a)
        ids_b.append(b)
        sizes.append(len(said) if len(b) else 0)
    a, b = (np.concatenate(x or [nothing]).astype(np.int64, copy=False) for x in (ids_a, ids_b))
    doc_a, doc_b, ends = (np.append(0, np.cumsum([len(x) for x in ids_a], dtype=np.int64)), np.append(0, np.cumsum([len(x) for x in ids_b], dtype=np.int64)), np.cumsum(sizes, dtype=np.int64))
    ends_a, ends_b = np.cumsum(first.lengths[a]), np.cumsum(second.lengths[b])
    # lanes begin at documents and, in long ones, at each so many tokens
    inside = ends_a[LANE_TOKENS - 1:: LANE_TOKENS]
    starts = np.unique(np.concatenate((np.zeros(1, np.int64), ends[:-1], inside[inside < (ends[-1] if len(ends) else 0)])))
    cut_a, cut_b = common_ends(ends_a, ends_b, starts)
    cut_a, cut_b = cut_a + 1, cut_b + 1
    return Aligned(a, b, doc_a, doc_b, cut_a, cut_b, np.searchsorted(cut_a, doc_a, "right"))


def linked_pairs(x: Aligned) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, pair, links) of the distinct pairs of ids of each document, in order; a pair is a * 2^15 + b.

    A group's links are unfolded a bounded number at a time, whatever its size.
    """
    from_a, from_b = np.append(0, x.cut_a)[:-1], np.append(0, x.cut_b)[:-1]
    wide, high = x.cut_a - from_a, x.cut_b - from_b
    docs = np.repeat(np.arange(len(x.doc_a) - 1), np.diff(x.doc_groups))
    # a row for each token of the first series: its links are its group's tokens of the second
    rows = np.repeat(np.arange(len(wide)), wide)
    token = np.arange(len(rows))
    todo = np.cumsum(high[rows]) if len(rows) else np.zeros(0, np.int64)
    keys, counts = [], []
    at = 0
    while at < len(rows):
        before = todo[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(todo, before + MOST_LINKS, "right")))
        n = high[rows[at:to]]
        row = np.repeat(rows[at:to], n)
        inside = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        key = (docs[row] << 32) | (x.a[np.repeat(token[at:to], n)] << PAIR_BITS) | x.b[from_b[row] + inside]
        key, count = np.unique(key, return_counts=True)
        keys.append(key)
        counts.append(count)
        at = to
    if not keys:
        return (np.zeros(0, np.int64),) * 3
    key, count = keys[0], counts[0]
    if len(keys) > 1:
        key, back = np.unique(np.concatenate(keys), return_inverse=True)
        count = np.bincount(back, np.concatenate(counts)).astype(np.int64)
    return key >> 32, key & 0xFFFFFFFF, count


class _Spelling:
    """Decimal ids with the mark that follows each."""

    def __init__(self, first: int, second: int):
        self.shift = 2 * first
        self.words = [f"{i}{mark}".encode() for size, marks in ((first, ",|"), (second, ",;")) for i in range(size) for mark in marks]

    def texts(self, x: Aligned) -> Iterator[bytes]:
        """For each document its groups as ``a1,a2|b1;a3|b2,b3``."""
        na, nb = len(x.a), len(x.b)
        words = np.empty(na + nb, np.int64)
        from_a, from_b = np.append(0, x.cut_a)[:-1], np.append(0, x.cut_b)[:-1]
        last_a, last_b = np.zeros(na, bool), np.zeros(nb, bool)
        last_a[x.cut_a - 1] = last_b[x.cut_b - 1] = True
        words[np.arange(na) + np.repeat(from_b, x.cut_a - from_a)] = 2 * x.a + last_a
        words[np.arange(nb) + np.repeat(x.cut_a, x.cut_b - from_b)] = self.shift + 2 * x.b + last_b
        ends = x.doc_a + x.doc_b
        for i in range(len(ends) - 1):
            yield b"".join(map(self.words.__getitem__, words[ends[i]: ends[i + 1]].tolist()))[:-1]


_SPELLING: dict[tuple[int, int], _Spelling] = {}


def _coders(paths: tuple[str, str]) -> tuple[OrdinaryByteLevel, PieceEncoder]:
    return encoder(OrdinaryByteLevel, paths[0]), encoder(PieceEncoder, paths[1])


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[str | None], int]]:
    """(ids, texts, bytes) of some documents at a time, by bytes of text."""
    ids, texts, held = [], [], 0
    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            ids.append(doc_id)
            texts.append(text.as_py())
            held += text.as_buffer().size if text.is_valid else 0
            if held >= BLOCK_BYTES:
                yield ids, texts, held
                ids, texts, held = [], [], 0
    if ids:
        yield ids, texts, held


def _lists(values: np.ndarray, ends: np.ndarray, kind: pa.DataType = pa.int32()) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(values.astype(kind.to_pandas_dtype()), kind))


def _paths(first: str | None, second: str | None) -> tuple[str, str]:
    return first or vocabulary_path("byte_bpe_50k.json"), second or vocabulary_path("piece_bpe_32k.model")


def align_documents(docs: DataFrame, first: str | None = None, second: str | None = None) -> DataFrame:
    """doc_id, a_ids, b_ids, and for each group the tokens of the document before its end: a_ends, b_ends."""
    paths = _paths(first, second)
    names = ["a_ids", "b_ids", "a_ends", "b_ends"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coders = _coders(paths)
        for ids, texts, _ in _blocks(batches):
            x = align(texts, *coders)
            each = np.diff(x.doc_groups)
            columns = [_lists(x.a, x.doc_a), _lists(x.b, x.doc_b), _lists(x.cut_a - np.repeat(x.doc_a[:-1], each), x.doc_groups), _lists(x.cut_b - np.repeat(x.doc_b[:-1], each), x.doc_groups)]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *columns], names=["doc_id", *names])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, " + ", ".join(f"{n} array<int>" for n in names))


_DIGESTS = "chunk bigint, doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, pairs array<int>, links array<int>"


def document_pairs(docs: DataFrame, first: str | None = None, second: str | None = None) -> DataFrame:
    """Counts of each document's tokens, groups and links, the digest of its groups, and its linked pairs.

    chunk numbers documents that lie together; pairs rise, links counts each.
    """
    paths = _paths(first, second)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = _coders(paths)
        spelling = _SPELLING.setdefault((a.size, b.size), _Spelling(a.size, b.size))
        chunk, held = TaskContext.get().partitionId() << 32, 0
        for ids, texts, size in _blocks(batches):
            x = align(texts, a, b)
            docs_of, pairs, links = linked_pairs(x)
            ends = np.searchsorted(docs_of, np.arange(len(ids) + 1))
            total = np.append(0, np.cumsum(links))
            sums = [hashlib.sha256(t).hexdigest() if t else "" for t in spelling.texts(x)]
            if held and held + size > CHUNK_BYTES:
                chunk, held = chunk + 1, 0
            held += size
            counts = [np.diff(x.doc_a), np.diff(x.doc_b), np.diff(x.doc_groups), np.diff(total[ends])]
            columns = [pa.array(np.full(len(ids), chunk)), pa.array(ids, pa.int64()), *(pa.array(c.astype(np.int64)) for c in counts), pa.array(sums, pa.string()), _lists(pairs, ends), _lists(links, ends)]
            yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in _DIGESTS.split(", ")])

    return docs.select("doc_id", "text").mapInArrow(run, _DIGESTS)


def chunk_pairs(rows: DataFrame) -> DataFrame:
    """chunk, pair and how many of the chunk's documents hold it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, size = None, [], 0

        def told() -> Iterator[pa.RecordBatch]:
            pair, count = np.unique(np.concatenate(held), return_counts=True)
            for at in range(0, len(pair), 1 << 16):
                part = slice(at, at + (1 << 16))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(pair[part]), now)), pa.array(pair[part].astype(np.int32)), pa.array(count[part].astype(np.int64))], names=["chunk", "pair", "documents"])

        for batch in batches:
            chunks, lists = batch.column(0).to_numpy(), batch.column(1)
            at = lists.offsets.to_numpy()
            flat = lists.values.to_numpy()
            turns = np.append(np.flatnonzero(np.append(True, chunks[1:] != chunks[:-1])), len(chunks)) if len(chunks) else []
            for i, j in zip(turns[:-1], turns[1:], strict=True):
                if held and (chunks[i] != now or size > 1 << 23):
                    yield from told()
                    held, size = [], 0
                now = chunks[i]
                held.append(flat[at[i]: at[j]])
                size += at[j] - at[i]
        if held:
            yield from told()

    return rows.select("chunk", "pairs").mapInArrow(run, "chunk bigint, pair int, documents bigint")


def pair_counts(by_chunk: DataFrame) -> DataFrame:
    """pair, documents (that hold it), best (the most that a pair of its first token has)."""
    counts = by_chunk.groupBy("pair").agg(F.sum("documents").alias("documents"))
    of_a = F.shiftright("pair", PAIR_BITS)
    return counts.withColumn("best", F.max("documents").over(Window.partitionBy(of_a)))


def translations(docs: DataFrame, first: str | None = None, second: str | None = None) -> DataFrame:
    """a_id, b_id, documents: for each token of the first tokenizer the tokens of the second that most documents link to it."""
    rows = materialize(docs.sparkSession, document_pairs(docs, first, second), "alignment")
    best = pair_counts(chunk_pairs(rows)).filter("documents = best")
    return best.select(F.shiftright("pair", PAIR_BITS).alias("a_id"), (F.col("pair") % (1 << PAIR_BITS)).alias("b_id"), "documents")


def alignment_report(docs: DataFrame, first: str | None = None, second: str | None = None) -> DataFrame:
    """One row for each document: tokens, groups, links, how its links rank in the corpus, and its groups' digest."""
    spark = docs.sparkSession
    out = T.StructType([T.StructField("doc_id", T.LongType()), *(T.StructField(c, T.LongType()) for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")), T.StructField("groups_sha256", T.StringType())])

    def join(documents: pa.Table, counts: pa.Table) -> pa.Table:
        """A chunk's documents and the counts of its pairs."""
        pair, count, best = (counts.column(c).to_numpy() for c in ("pair", "documents", "best"))
        order = np.argsort(pair)
        pair, count, best = pair[order], count[order], best[order]
        n_best, count_sum = np.zeros(len(documents), np.int64), np.zeros(len(documents), np.int64)
        row = 0
        for batch in documents.to_batches():
            lists, links = batch.column("pairs"), batch.column("links").values.to_numpy()
            at = lists.offsets.to_numpy()
            if len(pair) and at[-1] > at[0]:
                where = np.searchsorted(pair, lists.values.to_numpy())
                weighed = np.append(0, np.cumsum(links * count[where]))
                top = np.append(0, np.cumsum(links * (count[where] == best[where])))
                count_sum[row: row + len(batch)] = weighed[at[1:]] - weighed[at[:-1]]
                n_best[row: row + len(batch)] = top[at[1:]] - top[at[:-1]]
            row += len(batch)
        columns = {c: documents.column(c) for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")} | {"n_best": pa.array(n_best), "count_sum": pa.array(count_sum)}
        return pa.table({f.name: columns[f.name] for f in out})

    with Scratch(spark, "alignment") as scratch:
        rows = scratch.table(document_pairs(docs, first, second))
        by_chunk = scratch.table(chunk_pairs(rows))
        # a chunk that was told in two parts has a pair twice
        known = by_chunk.select("chunk", "pair").distinct().join(scratch.table(pair_counts(by_chunk)), "pair")
        return materialize(spark, rows.groupBy("chunk").cogroup(known.groupBy("chunk")).applyInArrow(join, out), "alignment")

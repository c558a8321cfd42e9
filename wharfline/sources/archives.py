"""Compressed line files of any size: what Spark's readers decompress by themselves, and archives that are inflated as a stream."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wharfline.functions.text import detect_type
from wharfline.sources.text import numbered_lines

STEP = 1 << 20


class _Inflater:
    """Plain bytes of a gzip stream, or of the first file of a zip archive by its local headers, at most STEP at a time."""

    def __init__(self, kind: str):
        self.kind, self.waiting, self.stream, self.stored, self.done = kind, b"", None, 0, False
        if kind == "GZIP":
            self.stream = zlib.decompressobj(31)

    def _folder_end(self, data: int, described: bool, packed: int) -> int | None:
        """Where the next header begins; folders may have an empty stream as data, and a descriptor after it."""
        end = data + packed
        if described:
            empty = zlib.decompressobj(-15)
            empty.decompress(self.waiting[data:])
            end = len(self.waiting) - len(empty.unused_data)
            end += 16 if self.waiting[end : end + 4] == b"PK\x07\x08" else 12
            if not empty.eof:
                return None
        return end if len(self.waiting) >= end + 4 else None

    def _open(self) -> bool:
        """Begin with the first file of an archive, if its header is there whole; folders are passed over."""
        while len(self.waiting) >= 30:
            mark, _, flags, method, _, _, _, packed, _, name, extra = struct.unpack("<4s5H3I2H", self.waiting[:30])
            if mark != b"PK\x03\x04":
                raise ValueError("an archive without a file")
            if len(self.waiting) < 30 + name + extra:
                return False
            data = 30 + name + extra
            if self.waiting[30 : 30 + name].endswith(b"/"):
                end = self._folder_end(data, bool(flags & 8) and method == 8, packed)
                if end is None:
                    return False
                self.waiting = self.waiting[end:]
                continue
            self.waiting = self.waiting[data:]
            if flags & 1 or method not in (0, 8) or (method == 0 and (flags & 8 or packed == 0xFFFFFFFF)):
                raise ValueError("an archive that can't be read as a stream")
            if method == 8:
                self.stream = zlib.decompressobj(-15)
            else:
                self.stored, self.done = packed, packed == 0
            return True
        return False

    def feed(self, data: bytes) -> Iterator[bytes]:
        self.waiting += data
        if self.done or (self.stream is None and not self.stored and not self._open()) or self.done:
            return
        if self.stream is None:
            part, self.waiting = self.waiting[: self.stored], b""
            self.stored -= len(part)
            self.done = self.stored == 0
            yield part
            return
        while self.waiting:
            part = self.stream.decompress(self.waiting, STEP)
            if part:
                yield part
            if not self.stream.eof:
                self.waiting = self.stream.unconsumed_tail
                if not self.waiting and len(part) < STEP:
                    return
                continue
            self.waiting = self.stream.unused_data
            if self.kind == "ZIP":
                self.done = True
                return
            if len(self.waiting) < 2:  # the line end that each fragment is given, or the begin of another member
                return
            self.stream = zlib.decompressobj(31)

    def ended(self) -> bool:
        return self.done or (self.kind == "GZIP" and self.stream.eof)


class _Lines:
    """Numbered lines of one file, from its fragments."""

    def __init__(self, file: str, kind: str, most_bytes: int | None):
        self.file, self.inflater, self.most_bytes = file, _Inflater(kind), most_bytes
        self.size, self.n, self.rest = 0, 0, [b""]

    def _batch(self, lines: list[bytes]) -> pa.RecordBatch:
        texts = [x.removesuffix(b"\r").decode("utf-8", "replace") for x in lines]
        first, self.n = self.n, self.n + len(lines)
        return pa.RecordBatch.from_pydict({"file": [self.file] * len(lines), "line_no": pa.array(range(first + 1, self.n + 1), pa.int64()), "line": pa.array(texts, pa.string())})

    def feed(self, data: bytes) -> Iterator[pa.RecordBatch]:
        for part in self.inflater.feed(data):
            self.size += len(part)
            if self.most_bytes is not None and self.size > self.most_bytes:
                raise ValueError(f"more than {self.most_bytes} bytes: {self.file}")
            first, *more = part.split(b"\n")
            self.rest.append(first)
            if more:
                lines = [b"".join(self.rest), *more[:-1]]
                self.rest = [more[-1]]
                yield self._batch(lines)

    def end(self) -> Iterator[pa.RecordBatch]:
        if not self.inflater.ended():
            raise ValueError(f"ends too early: {self.file}")
        last = b"".join(self.rest)
        if last:
            yield self._batch([last])


def inflate_lines(fragments: DataFrame, most_bytes: int | None = None) -> DataFrame:
    """file, line_no, line of archives that are there as fragments (file, kind, line_no, part: bytes without their line end).

    A file is one task's, which holds a batch of fragments, a megabyte of what they hold, and one line.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = None
        for batch in batches:
            files, kinds, parts = (batch[c].to_pylist() for c in ("file", "kind", "part"))
            at = 0
            while at < len(files):
                upto = next((i for i in range(at, len(files)) if files[i] != files[at]), len(files))
                if now is None or now.file != files[at]:
                    if now is not None:
                        yield from now.end()
                    now = _Lines(files[at], kinds[at], most_bytes)
                yield from now.feed(b"\n".join(parts[at:upto]) + b"\n")
                at = upto
        if now is not None:
            yield from now.end()

    rows = fragments.select("file", "kind", "line_no", "part").repartition("file").sortWithinPartitions("file", "line_no")
    return rows.mapInArrow(run, "file string, line_no bigint, line string")


def read_compressed(spark: SparkSession, paths: str | list[str], kind: str | None = None, most_bytes: int | None = None) -> DataFrame:
    """file, line_no, line of compressed text files: gzip, zip (its first file) or plain, by flag or by suffix.

    Spark's reader decompresses ``.gz`` files and splits plain ones. Of zip archives, and of gzip files by another name, it gives
    the bytes between line feeds, which one task a file inflates in their order; no file is a row. most_bytes: what a file may
    unpack to; more is an error, as for archives that blow up. Empty files have no lines; cut ones are an error.
    """
    said = F.lit(kind).cast("string") if kind else None
    lines = numbered_lines(spark, paths, line_end="\n").withColumn("kind", detect_type("file", compression=said)["compression"])
    packed = (F.col("kind") == "ZIP") | ((F.col("kind") == "GZIP") & ~F.col("file").endswith(".gz"))
    plain = lines.filter(~packed)
    if most_bytes is not None:
        sizes = plain.groupBy("file").agg(F.sum(F.octet_length("line").cast("bigint") + 1).alias("size"))
        for over in sizes.filter(F.col("size") > most_bytes).limit(1).collect():
            raise ValueError(f"more than {most_bytes} bytes: {over.file}")
    fragments = lines.filter(packed).withColumn("part", F.col("line").cast("binary"))
    return plain.select("file", "line_no", F.regexp_replace("line", r"\r\z", "").alias("line")).unionByName(inflate_lines(fragments, most_bytes))

"""Secrets in texts: fixed patterns, and strings that a tokenizer finds random.

A run of key-like characters that takes many tokens for its length under byte-pair vocabularies (one of mostly
English text and one of many languages) was not written by a person: words merge to long tokens, random
characters don't. Runs of known shape (hexadecimal
digests of usual lengths, UUIDs, numbers, words joined by separators) are identifiers and aren't reported by
this test; a pattern may still match them. Of a run that isn't random as a whole, the parts between separators
and windows are tested, so that a path doesn't hide a random part.

One pass over the table, no shuffle. Cases: a null or empty text has no spans and gives zero counts and the
digest of the empty string; rows with equal ids are scanned as they are; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wharfline.llm.tokens import vocabulary_path

#: Kinds in the order in which spans of one start are listed.
KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS, HEX = re.compile("AKIA[A-Z0-9]+"), re.compile("[0-9a-f]{24,}")
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
LEAST_ASSIGN, LEAST_ACCESS = 6, 20

RUN = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
VOCABULARIES = ("byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken")
#: A run of so many characters a token or fewer, under each vocabulary, is random. Of random strings of 16 lower-case
#: letters 0.986 are, of longer or mixed ones more; of 1,598 long words of invented prose (10,000 documents) 7.
CHARS_A_TOKEN = 2.0
DIGEST = re.compile(r"(?:[0-9a-f]+|[0-9A-F]+)")
#: Hexadecimal lengths of CRC-64, MD5, SHA-1, SHA-224, SHA-256, SHA-384 and SHA-512.
DIGEST_LENGTHS = {16, 32, 40, 56, 64, 96, 128}
UUID = re.compile(r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")
#: Numbers, dates and words (of one case, capitalised or digits) joined by separators.
IDENTIFIER = re.compile(r"[+/_=-]*(?:(?:[A-Z]?[a-z]+|[A-Z]+|[0-9]+)[+/_=-]+)*(?:[A-Z]?[a-z]+|[A-Z]+|[0-9]+)[+/_=-]*")
#: Parts of a run that are tested by themselves: between separators, and windows with at most so many separators.
PART, SEPARATOR = re.compile(r"[A-Za-z0-9]{16,}"), re.compile(r"[+/_=-]")
WINDOW, STEP, SEPARATORS = 20, 4, 2
#: A text may hold long runs (encoded files); pieces of this size are tested, whose mean counts.
PIECE = 4096


class Scanner:
    """Finds spans in one text."""

    def __init__(self, *ranks_paths: str, chars_a_token: float = CHARS_A_TOKEN):
        import public_tokenizers
        import tiktoken

        self.coders = []
        for path in ranks_paths:
            with open(path, "rb") as lines:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            self.coders.append(tiktoken.Encoding(path, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}))
        self.most = chars_a_token

    def has_low_ratio(self, run: str) -> bool:
        """Whether the characters a token are few under each vocabulary."""
        for coder in self.coders:
            if len(run) > self.most * sum(len(coder.encode_ordinary(run[i: i + PIECE])) for i in range(0, len(run), PIECE)):
                return False
        return True

    def is_known(self, run: str) -> bool:
        return bool(len(run) in DIGEST_LENGTHS and DIGEST.fullmatch(run) or UUID.fullmatch(run))

    def is_random(self, run: str) -> bool:
        """One long word of letters is an identifier only if it takes few tokens."""
        return not self.is_known(run) and (run.isalpha() or not IDENTIFIER.fullmatch(run)) and self.has_low_ratio(run)

    def random_parts(self, run: str) -> Iterator[tuple[int, int]]:
        """Random strings in a run whose readable words hide them from its mean; overlapping ones are one."""
        parts = [m for m in PART.finditer(run)]
        found = [m.span() for m in parts if self.is_random(m[0])]
        known = sorted([m.span() for m in UUID.finditer(run)] + [m.span() for m in parts if self.is_known(m[0])])
        firsts, reach = [k[0] for k in known], list(accumulate((k[1] for k in known), max))
        starts = {*range(0, len(run) - WINDOW, STEP), len(run) - WINDOW} if len(run) > WINDOW else ()
        for a in starts:
            b = a + WINDOW
            window, before = run[a:b], bisect_left(firsts, b)
            if before and reach[before - 1] > a or len(SEPARATOR.findall(window)) > SEPARATORS:
                continue
            if self.is_random(window):
                found.append((a, b))
        end = None
        for a, b in sorted(found):
            if end is not None and a < end:
                end = max(end, b)
                continue
            if end is not None:
                yield start, end
            start, end = a, b
        if end is not None:
            yield start, end

    def random_runs(self, text: str) -> Iterator[tuple[int, int]]:
        for m in RUN.finditer(text):
            if self.is_random(m[0]):
                yield m.span()
            elif not self.is_known(m[0]):
                yield from ((m.start() + a, m.start() + b) for a, b in self.random_parts(m[0]))

    def base(self, text: str) -> list[tuple[int, int, int]]:
        """(start, kind, end) of what the patterns match."""
        found = []
        low = text.lower()
        if any(word in low for word in KEYWORDS):
            found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_ASSIGN]
        if "AKIA" in text:
            found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
        found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
        return sorted(found)

    def scan(self, text: str) -> list[tuple[int, int, int]]:
        """Spans of the patterns, and random runs that none of them covers."""
        base = self.base(text)
        firsts, reach = [s for s, _, _ in base], list(accumulate((e for _, _, e in base), max))
        more = []
        for a, b in self.random_runs(text):
            before = bisect_right(firsts, a)  # of the spans that start here or before, one that ends last
            if not before or reach[before - 1] < b:
                more.append((a, 3, b))
        return sorted(base + more)


_SCANNERS: dict[tuple, Scanner] = {}


def scan_secrets(docs: DataFrame, ranks_paths: tuple[str, ...] | None = None, chars_a_token: float = CHARS_A_TOKEN) -> DataFrame:
    """doc_id and its spans: kind, start and end (code points, end exclusive) and the string found."""
    paths = ranks_paths or tuple(map(vocabulary_path, VOCABULARIES))
    span = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("value", T.StringType())])
    out = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("spans", T.ArrayType(span))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = (paths, chars_a_token)
        if key not in _SCANNERS:
            _SCANNERS[key] = Scanner(*paths, chars_a_token=chars_a_token)
        scanner = _SCANNERS[key]
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("value", pa.string())]))
        for batch in batches:
            rows = []
            for x in batch.column(1):
                text = x.as_py() or ""
                rows.append([{"kind": KINDS[k], "start": a, "end": b, "value": text[a:b]} for a, k, b in scanner.scan(text)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, kind)], names=["doc_id", "spans"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, out)


def secret_digests(docs: DataFrame) -> DataFrame:
    """One row for each document: counts of the base kinds, a digest of their spans, and all spans as text."""
    spans = F.col("spans")
    said = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    count = lambda kind: F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
    base = F.array_join(F.transform(F.filter(spans, lambda s: s["kind"] != "random"), said), ",")
    return scan_secrets(docs).select(
        "doc_id",
        count("assign").alias("n_assign"),
        count("access").alias("n_access"),
        count("hex").alias("n_hex"),
        F.sha2(base, 256).alias("base_sha256"),
        F.array_join(F.transform(spans, said), ",").alias("spans"),
        count("random").alias("n_random"),
    )


def sha256_of(spans: list[tuple[int, int, int]]) -> str:
    """The digest of base spans, as the query gives it."""
    return hashlib.sha256(",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans if k < 3).encode()).hexdigest()

"""Token ids of vocabularies of the tokenizers library, merged by tiktoken.

A vocabulary file is loaded with the tokenizers library, whose ids count. Its byte-pair merges are handed to
tiktoken, which gives the same ids three to four times as fast; tests compare the two on random strings. Texts
for which the two might differ (rare characters, whose classes depend on the Unicode version, and what a
coder's docstring names) are encoded by the tokenizers library itself, as are all texts of a vocabulary whose
ids don't rise with its merges. Nothing is remembered between texts, so a worker's memory doesn't grow.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Appended to each document.
END_ID = 1
#: White space as the vocabularies' patterns see it: Unicode's White_Space, without U+001C to U+001F (fixed values).
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: Letters and numbers among ``STEADY`` characters, as ranges (fixed values).
LETTERS = "A-Za-zªµºÀ-ÖØ-öø-ſЀ-ҁҊ-ԯぁ-ゖァ-ヺー一-龥가-힣"
NUMBERS = "0-9²³¹¼-¾"
#: Characters whose class, lower case and composed form no Unicode version has changed; all of them stand alone.
STEADY = f"{LETTERS}{NUMBERS}\\x00-\\xbf×÷\\u2010-\\u2027\\u2030-\\u2055€、-〃〈-】〔-〛"


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class _Vocabulary:
    """A byte-pair vocabulary spelt in printable stand-ins for bytes."""

    pattern, suffix, marker = "", "", b""

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = {t.content: i for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in set(plain)]
        spelt = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}
        with open(path, encoding="utf-8") as file:
            merges = [m if isinstance(m, list) else m.split(" ") for m in json.load(file)["model"]["merges"]]
        ids = self.tokenizer.get_vocab(with_added_tokens=False)
        order = [ids["".join(m)] for m in merges]
        self.rising = all(a < b for a, b in zip(order, order[1:], strict=False)) and all(ids[c] < order[0] for c in spelt)

        def raw(token: str) -> bytes:
            end = bool(self.suffix) and token.endswith(self.suffix)
            return bytes(spelt[c] for c in (token.removesuffix(self.suffix) if end else token)) + (self.marker if end else b"")

        tokens = {raw(t): i for t, i in ids.items() if t not in self.added}
        self.size = self.tokenizer.get_vocab_size()
        self.bytes_of = {i: t for t, i in tokens.items()} | {i: t.encode() for t, i in self.added.items()}
        self.coder = tiktoken.Encoding(os.path.basename(path), pat_str=self.pattern, mergeable_ranks=tokens, special_tokens=self.added) if self.rising else None

    def whole(self, text: str) -> np.ndarray:
        """The ids by the tokenizers library."""
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)


class ByteLevelEncoder(_Vocabulary):
    """Ids of a byte-level BPE vocabulary, whose words carry the space before them.

    Runs of over 4,096 white-space characters are left to the tokenizers library.
    """

    pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    _other = re.compile(f"[^{STEADY}{SPACE}]|[{SPACE}]{{4097}}")

    def __init__(self, path: str):
        super().__init__(path)
        self.stops, self.lines, self.gaps = (np.zeros(self.size, bool) for _ in range(3))
        for i, token in self.bytes_of.items():
            self.stops[i] = token.endswith((b".", b"!", b"?"))
            self.lines[i] = b"\n" in token
            self.gaps[i] = token[:1].isspace()

    def ids(self, text: str) -> np.ndarray:
        if self.coder is None or self._other.search(text):
            return self.whole(text)
        return self.coder.encode_to_numpy(text, allowed_special="all")

    def encode(self, text: str) -> bytes:
        return self.ids(text).astype("<u4", copy=False).tobytes()

    def encode_with_ends(self, text: str) -> tuple[bytes, np.ndarray]:
        """The ids, and how many of them stand before each end of a sentence or a line."""
        ids = self.ids(text)
        ends = self.lines[ids]
        ends[:-1] |= self.stops[ids[:-1]] & self.gaps[ids[1:]]
        return ids.astype("<u4", copy=False).tobytes(), np.flatnonzero(ends) + 1


class WordEncoder(_Vocabulary):
    """Ids of a lower-casing BPE vocabulary with word ends, in which white space only separates.

    A mark after each word stands for the end that the vocabulary writes into its tokens; texts that hold the
    mark itself or an added token are left to the tokenizers library.
    """

    pattern, suffix, marker = r"[^\x01]+\x01", "</w>", b"\x01"
    _other = re.compile(f"[^{STEADY}{SPACE}]|\x01")
    _word = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[{NUMBERS}]|[^{SPACE}{LETTERS}{NUMBERS}]+")

    def ids(self, text: str) -> np.ndarray:
        if self.coder is None or self._other.search(text) or any(t in text for t in self.added):
            return self.whole(text)
        words = self._word.findall(text.lower())
        words.append("")  # a mark after the last word too
        return self.coder.encode_to_numpy("\x01".join(words), disallowed_special=())

    def encode(self, text: str) -> bytes:
        return self.ids(text).astype("<u4", copy=False).tobytes()


_ENCODERS: dict[tuple, object] = {}


def encoder(kind: type, path: str):
    """One encoder for each vocabulary in a worker process, kept from task to task."""
    key = (kind, path)
    if key not in _ENCODERS:
        _ENCODERS[key] = kind(path)
    return _ENCODERS[key]

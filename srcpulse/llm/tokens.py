"""Exact ids of a byte-level BPE tokenizer, faster than its library on running text.

A text is cut into pre-tokens by one pattern over code points whose class no Unicode version has changed, and each
pre-token is merged once per worker. Texts with other code points, or with a special token's string, and tokenizers of
another make go to the library itself, so ids always equal the library's.
"""

from __future__ import annotations

import json
import re
import sys
import unicodedata
from array import array

import numpy as np

from srcpulse.llm.common import kept

#: Ranges of code points with settled classes (first, last).
SETTLED = (
    (0x0000, 0x0377), (0x0384, 0x038A), (0x038E, 0x03A1), (0x03A3, 0x0527), (0x2010, 0x2027), (0x2030, 0x205E),
    (0x20A0, 0x20B5), (0x3000, 0x303F), (0x3041, 0x3096), (0x30A1, 0x30FF), (0x4E00, 0x9FA5), (0xAC00, 0xD7A3),
    (0xFF01, 0xFF5E),
)
#: White space among them.
SPACES = "\t\n\v\f\r \x85\xa0　"
#: The pre-token pattern of the byte-level tokenizer that this module reads.
CONTRACTIONS = "'s|'t|'re|'ve|'m|'ll|'d"
#: Pre-tokens longer than this are not kept.
KEPT_CHARS = 64


def _classes() -> tuple[str, str, str]:
    """Character classes, as regular expression ranges: settled, letters, numbers."""

    def ranges(points: list[int]) -> str:
        out, first = [], None
        for i, p in enumerate(points):
            first = p if first is None else first
            if i + 1 == len(points) or points[i + 1] != p + 1:
                out.append(f"\\U{first:08x}-\\U{p:08x}")
                first = None
        return "".join(out)

    points = [p for a, b in SETTLED for p in range(a, b + 1)]
    kind = {p: unicodedata.category(chr(p))[0] for p in points}
    return ranges(points), ranges([p for p in points if kind[p] == "L"]), ranges([p for p in points if kind[p] == "N"])


def _byte_of_char() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary: itself where printable, else the next free one from 256."""
    shown = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class _Ids(dict):
    """Pre-token -> its ids as 32-bit numbers; merged when first asked for, emptied when full."""

    def __init__(self, merge, entries: int) -> None:
        super().__init__()
        self._merge, self._entries = merge, entries

    def __missing__(self, piece: str) -> bytes:
        ids = array("I", self._merge(piece)).tobytes()
        if len(piece) <= KEPT_CHARS:
            if len(self) >= self._entries:
                self.clear()
            self[piece] = ids
        return ids


class Lengths(dict):
    """Two tiers of pre-token lengths: a given table of frequent ones, then this worker's cache, emptied when full."""

    def __init__(self, frequent: dict[str, int], merge, entries: int) -> None:
        super().__init__(frequent)
        self._merge, self._entries, self.cache = merge, entries, {}

    def __missing__(self, piece: str) -> int:
        n = self.cache.get(piece)
        if n is None:
            n = len(self._merge(piece))
            if len(piece) <= KEPT_CHARS:
                if len(self.cache) >= self._entries:
                    self.cache.clear()
                self.cache[piece] = n
        return n


class Codec:
    def __init__(self, path: str, entries: int = 700_000) -> None:
        from tokenizers import Tokenizer

        self.path, self._entries = path, entries
        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            made = json.load(f)
        self._special = [t["content"] for t in made.get("added_tokens", [])]
        self.merge = self._plain(made)
        if self.merge:
            settled, letters, numbers = _classes()
            self._odd = re.compile(f"[^{settled}]").search
            self._pieces = re.compile(
                f"{CONTRACTIONS}| ?[{letters}]+| ?[{numbers}]+| ?[^{SPACES}{letters}{numbers}]+|[{SPACES}]+(?![^{SPACES}])|[{SPACES}]+"
            ).findall
            self._ids = _Ids(self.merge, entries)

    @staticmethod
    def _plain(made: dict):
        """A merge function where ranks of merged strings are their ids, else None."""
        import tiktoken

        model, cut = made["model"], made.get("pre_tokenizer") or {}
        plain = (
            model.get("type") == "BPE" and made.get("normalizer") is None and cut.get("type") == "ByteLevel"
            and cut.get("use_regex", True) and not cut.get("add_prefix_space")
            and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
            and made.get("truncation") is None and made.get("padding") is None
        )
        if not plain:
            return None
        byte, special = _byte_of_char(), {t["content"] for t in made.get("added_tokens", [])}
        ranks = {bytes(byte[c] for c in token): i for token, i in model["vocab"].items() if token not in special}
        merged = [model["vocab"]["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
        if merged != sorted(merged) or len(merged) + 256 != len(ranks) or min(merged, default=256) < 256:
            return None
        whole = tiktoken.Encoding("bytes", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})
        one = getattr(getattr(whole, "_core_bpe", None), "encode_single_piece", None)  # the same without cutting by the pattern
        return (lambda piece: one(piece.encode())) if one else whole.encode_ordinary

    def pieces(self, text: str) -> list[str] | None:
        """The pre-tokens, or None where the library has to cut the text."""
        if self.merge is None or any(s in text for s in self._special) or not text.isascii() and self._odd(text):
            return None
        return self._pieces(text)

    def ids(self, text: str) -> np.ndarray:
        pieces = self.pieces(text)
        if pieces is None:
            return np.array(self.library.encode(text, add_special_tokens=False).ids, dtype="<u4")
        return np.frombuffer(b"".join(map(self._ids.__getitem__, pieces)), dtype="<u4")

    def lengths(self, frequent: dict[str, int]) -> Lengths:
        return Lengths(frequent, self.merge, self._entries)

    def count(self, text: str, lengths: Lengths) -> int:
        pieces = self.pieces(text)
        if pieces is None:
            return len(self.library.encode(text, add_special_tokens=False).ids)
        return sum(map(lengths.__getitem__, pieces))


def codec(path: str) -> Codec:
    """One codec per worker process and tokenizer file."""
    sys.setswitchinterval(0.05)
    return kept("codec", path, lambda: Codec(path))

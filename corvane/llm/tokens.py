"""Whole-text encoding with the tokenizers library, with a bounded memo of white-space-separated pieces in front.

Both pre-tokenizers cut every text at white space before any merge, so the ids of a text are those of its pieces in
order, and a piece that has been seen needs no second encoding. Pieces that are new go to the library. Texts with
characters outside a plain range, on which two Unicode versions could disagree, go to the library whole.
"""

from __future__ import annotations

import json
import re
import struct
from collections.abc import Callable
from functools import lru_cache

import numpy as np
from tokenizers import Tokenizer

#: Entries of the memo of one Python worker; it starts afresh beyond, which costs time but changes no result.
MEMO_ENTRIES = 1_000_000

#: Longest piece that is cut further; longer ones go to the library.
LONGEST_PIECE = 64

#: Characters outside ASCII, Latin letters and common punctuation; control characters and U+0130 count as outside too.
UNUSUAL = re.compile("[^\t\n\r\x20-\x7e\xa1-įı-ɏ‐-‧‰-⁞€]")
LETTERS = "A-Za-zªµºÀ-ÖØ-öø-ɏ"
WORD = re.compile(f"[{LETTERS}]+")
#: Punctuation and digits, with one white space at most, before letters: always a place to cut. An apostrophe is not.
BEFORE_WORD = re.compile(rf"[^{LETTERS}\s']+[\t\n\r]?(?=[{LETTERS}])")
SPACE_AFTER_WORD = re.compile(r"(?<=[^\t\n\r ]) ")
DOUBLE_SPACE = ("  ", "\n ", "\t ", "\r ")


def byte_characters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies: itself where it is printable, else
    the next character from 256 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(others)) for b in range(256)]


class Memo(dict):
    """Piece -> its ids as little-endian unsigned 32-bit numbers."""

    def __init__(self, encode: Callable[[str, str], bytes], before: str):
        self.encode, self.before = encode, before

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= MEMO_ENTRIES:
            self.clear()
        found = self[piece] = self.encode(self.before, piece)
        return found


class Encoder:
    """ids(text) gives all ids of a whole text, as add_special_tokens=False does; strings of special tokens in a text
    are ordinary text. tokenizer_file: a file of the tokenizers library."""

    def __init__(self, tokenizer_file: str):
        self.tokenizer = Tokenizer.from_file(tokenizer_file)
        self.tokenizer.encode_special_tokens = True
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        made = json.loads(self.tokenizer.to_str())
        self.vocabulary = self.tokenizer.get_vocab_size()
        self.pieces = self._pieces(made.get("normalizer"), made.get("pre_tokenizer") or {})
        self.model, self.characters = self.tokenizer.model, byte_characters()
        self.first = Memo(self._piece, "")
        self.rest = Memo(self._piece, " ") if self.pieces == "spaced" else self.first

    @staticmethod
    def _pieces(normalizer: dict | None, pre: dict) -> str:
        """How a text may be cut before encoding: 'spaced' keeps one space before each piece, 'bare' drops white space
        and lower-cases, '' means not at all."""
        if normalizer is None and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space"):
            return "spaced"
        steps = [x.get("type") for x in (normalizer or {}).get("normalizers", [])]
        cuts = pre.get("pretokenizers", [{}])
        if steps == ["NFC", "Replace", "Lowercase"] and cuts[0].get("behavior") == "Removed" and cuts[0].get("invert"):
            return "bare"
        return ""

    def _whole(self, text: str) -> bytes:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _word(self, word: str) -> bytes:
        """A run of letters, perhaps after a space, is one unit of the merges."""
        found = [t.id for t in self.model.tokenize("".join(map(self.characters.__getitem__, word.encode())))]
        return struct.pack(f"<{len(found)}I", *found)

    def _piece(self, before: str, piece: str) -> bytes:
        """A piece, cut where the pre-tokenizer is sure to cut, so that its words are found in the memo."""
        if len(piece) > LONGEST_PIECE:
            return self._whole(before + piece)
        memo = self.rest if before else self.first
        word = WORD.match(piece)
        if word and word.end() == len(piece):
            return self._word(before + piece)
        cut = word or BEFORE_WORD.match(piece)
        if cut:
            return memo[cut[0]] + self.first[piece[cut.end() :]]
        return self._whole(before + piece)

    def ids(self, text: str | None) -> bytes:
        """All ids as little-endian unsigned 32-bit numbers; a null or empty text has none."""
        if not text:
            return b""
        if not self.pieces or UNUSUAL.search(text):
            return self._whole(text)
        if self.pieces == "bare":
            return b"".join(map(self.rest.__getitem__, text.lower().split()))
        parts = SPACE_AFTER_WORD.split(text) if any(x in text for x in DOUBLE_SPACE) else text.split(" ")
        head = parts[0]
        parts[0] = ""
        if head:
            return self.first[head] + b"".join(map(self.rest.__getitem__, parts[1:]))
        return b"".join(map(self.rest.__getitem__, parts[1:]))


@lru_cache(maxsize=4)
def encoder(tokenizer_file: str) -> Encoder:
    """One encoder for each Python worker and file."""
    return Encoder(tokenizer_file)

"""Whole-text token ids from a public tokenizer file, with repeated words
encoded once per worker.

In the byte-level pattern of these vocabularies a single space followed by a
non-space always starts a new pre-token, and nothing before it depends on what
comes after it.  So a text falls apart, without loss, into units that end before
such a space, and the ids of a text are the ids of its units joined.
"""

from __future__ import annotations

import os
import re
import struct
from functools import lru_cache

import public_tokenizers
import pyarrow as pa
import regex

#: Unicode White_Space, as the pattern's \s has it (fixed values).
WHITE = "\t-\r \x85\xa0  -     　"
_UNIT = re.compile(f" (?=[^{WHITE}])")
#: For ASCII texts these are the only ways in which a space is followed by white space or the end.
_ASCII_BREAKS = ("  ", " \n", " \t", " \r", " \x0b", " \x0c")
#: Units kept per worker (about 150 bytes each); a full cache is emptied.
CACHE = 600_000
#: Up to here all characters have had their class in every version of Unicode that a library may hold.
_SETTLED = "\u024f"


def _byte_alphabet() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary:
    itself where printable, else the next of those from 256 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(others)) for b in range(256)]


class UnitEncoder:
    """Ids of whole texts as little-endian unsigned 32-bit bytes.

    A unit that isn't known is split into pre-tokens, and pre-tokens that
    aren't known go to the tokenizer's merges; units with characters past
    _SETTLED go through the whole tokenizer."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a task per core already
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.model = self.tokenizer.model
        self.alphabet = _byte_alphabet()
        self.pretokens = regex.compile(public_tokenizers.PATTERN).findall
        self.marks = {m: self._pretoken(m) for m in ".,;:!?"}
        self.cache: dict[str, bytes] = {}  # of units, without the space before them
        self.words: dict[str, bytes] = {}  # of pre-tokens with no space before them

    def units(self, text: str) -> list[str]:
        """The text cut before each space that a non-space follows; all but the
        first unit are given without that space."""
        if text.isascii() and not text.endswith(" ") and not any(b in text for b in _ASCII_BREAKS):
            return text.split(" ")
        return _UNIT.split(text)

    def _pretoken(self, word: str) -> bytes:
        found = self.model.tokenize("".join([self.alphabet[b] for b in word.encode()]))
        return struct.pack(f"<{len(found)}I", *[t.id for t in found])

    def _unit(self, unit: str) -> bytes:
        """Ids of a unit and the space before it.  Letters are one pre-token;
        a mark after letters is another."""
        if unit.isalpha():
            return self._pretoken(" " + unit)
        head, mark = unit[:-1], unit[-1:]
        if mark in self.marks and head.isalpha():
            ids = self.cache.get(head)
            if ids is None:
                ids = self.cache[head] = self._pretoken(" " + head)
            return ids + self.marks[mark]
        return b"".join([self._word(w) for w in self.pretokens(" " + unit)])

    def _word(self, word: str) -> bytes:
        ids = self.cache.get(word[1:]) if word[0] == " " else self.words.get(word)
        if ids is None:
            ids = self._pretoken(word)
            if word[0] == " ":
                self.cache[word[1:]] = ids
            else:
                self.words[word] = ids
        return ids

    def _whole(self, texts: list[str]) -> list[bytes]:
        got = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [struct.pack(f"<{len(e.ids)}I", *e.ids) for e in got]

    def _learn(self, units: set[str]) -> None:
        far = []
        for unit in units:
            if unit in self.cache:
                continue
            if unit.isascii() or max(unit) <= _SETTLED:
                self.cache[unit] = self._unit(unit)
            else:
                far.append(unit)
        self.cache.update(zip(far, self._whole([" " + u for u in far])))

    def encode(self, texts: list[str]) -> list[bytes]:
        split = [self.units(t) for t in texts]
        new = set().union(*split).difference(self.cache)
        if len(self.cache) + len(self.words) + len(new) > CACHE:  # emptied: this batch needs all its units
            self.cache, self.words, new = {}, {}, set().union(*split)
        self._learn(new)
        cache = self.cache
        heads = self._whole([units[0] for units in split])
        return [h + b"".join([cache[u] for u in units[1:]]) for h, units in zip(heads, split)]


@lru_cache(maxsize=2)
def unit_encoder(path: str) -> UnitEncoder:
    return UnitEncoder(path)


def encode_slice(texts: pa.Array, path: str) -> list[bytes]:
    """Ids of each text of an Arrow array (null: none)."""
    return unit_encoder(path).encode([t or "" for t in texts.to_pylist()])

"""Token ids of the word-BPE tokenizer, word by word with a bounded cache."""

from __future__ import annotations

import json
import re
import unicodedata

import numpy as np

#: Characters at which str.split and the tokenizer's white space may differ, and others that must not be lower-cased alone.
ODD = re.compile("[\x1c-\x1f\x85\xa0 ᠎ -‏    ⁠　﻿Σİ<]")
GENERATION = 120_000


class _Cache(dict):
    """Values by key, made on first use. Two generations are kept, so frequent keys stay and memory is bounded."""

    def __init__(self, make):
        self.make, self.old = make, {}

    def __missing__(self, key: str) -> bytes:
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(self) >= GENERATION:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


class WordEncoder:
    """Encodes as ``tokenizers`` does with the file at ``path``, without added special tokens.

    White space always ends a word there, so the ids of a text are those of
    its words in turn; plain words are lower-cased, split by the file's
    pattern and merged, each once while the cache holds it. Texts with odd
    characters go to the library whole.
    """

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            self.split = regex.compile(json.load(f)["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]).findall
        self.alphabet = _alphabet()
        self.merge = self.whole.model.tokenize
        self.parts = _Cache(self._part)
        self.words = _Cache(self._word)

    def _part(self, part: str) -> bytes:
        shown = part if part.isascii() and part.isprintable() else "".join(map(self.alphabet.__getitem__, part.encode()))
        return b"".join([t.id.to_bytes(4, "little") for t in self.merge(shown)])

    def _word(self, word: str) -> bytes:
        if word.isalpha():
            return self.parts[word]
        if word[:-1].isalpha() and word[-1] in ".,;:!?":
            return self.parts[word[:-1]] + self.parts[word[-1]]
        return b"".join([self.parts[p] for p in self.split(word)])

    def ids(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids of a text."""
        if ODD.search(text) or not (text.isascii() or unicodedata.is_normalized("NFC", text)):
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        return b"".join(map(self.words.__getitem__, text.lower().split()))


def _alphabet() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies: itself, or a letter from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    out, spare = [], 256
    for b in range(256):
        out.append(chr(b) if b in shown else chr(spare))
        spare += b not in shown
    return out


_SHARED: dict[str, WordEncoder] = {}


def shared(path: str) -> WordEncoder:
    """The encoder of this process; its cache outlives a task where workers do."""
    if path not in _SHARED:
        _SHARED[path] = WordEncoder(path)
    return _SHARED[path]

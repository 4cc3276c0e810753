"""Whole-text encoding with a byte-level BPE of the ``tokenizers`` library, one word at a time.

Such a vocabulary merges bytes within words only, and its split pattern alone tells where words
begin. A text is therefore split once, and each distinct word is given to the library's model once
per worker. Texts with characters on whose class engines may disagree, or with strings of added
tokens, go through the library whole; the ids are the library's in every case.
"""

from __future__ import annotations

import re
import unicodedata
from array import array
from functools import lru_cache

import numpy as np
from tokenizers import Tokenizer

# Characters of long-settled classes: Latin, basic Greek and Cyrillic, common punctuation.
_CHARACTERS = "\t\n\r" + "".join(map(chr, [
    *range(0x20, 0x7F), *range(0xA1, 0x250), *range(0x391, 0x3A2), *range(0x3A3, 0x3CF), *range(0x400, 0x482), *range(0x2010, 0x2028),
]))
_PLAIN = re.compile(f"[{re.escape(_CHARACTERS)}]*").fullmatch


def _kind(kind: str) -> str:
    return re.escape("".join(c for c in _CHARACTERS if unicodedata.category(c)[0] == kind))


_LETTERS, _DIGITS = _kind("L"), _kind("N")
# Fixed value: the split pattern of byte-level BPE vocabularies of this family, for the characters above.
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTERS}]+| ?[{_DIGITS}]+| ?[^\s{_LETTERS}{_DIGITS}]+|\s+(?!\S)|\s+"
_PROBE = "Don't  stop, it's 42 naïve words\n\n\tand ß*** é%%% «Ω» – x² y "


def _byte_letters() -> dict[int, str]:
    """The printable stand-ins of byte-level vocabularies: visible bytes stand for themselves."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class WordEncoder:
    """Encodes texts to ids; a cache of at most ``cache`` words bounds its memory."""

    def __init__(self, path: str, cache: int = 300_000):
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.cache = cache
        self.size = self.tokenizer.get_vocab_size()
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.split = re.compile(PATTERN).findall
        self.letters = str.maketrans({chr(b): c for b, c in _byte_letters().items()})
        self.words: dict[str, bytes] = {}
        for text in (_PROBE, "plain words only", "中文 text", ""):
            if self.encode(text).tolist() != self._whole(text):
                raise ValueError(f"{path} is not a byte-level BPE with the usual split pattern")

    def byte_lengths(self) -> np.ndarray:
        """Bytes of text behind each id."""
        out = np.zeros(self.size, np.int64)
        for token, i in self.tokenizer.get_vocab(with_added_tokens=False).items():
            out[i] = len(token)
        for i, token in self.tokenizer.get_added_tokens_decoder().items():
            out[i] = len(token.content.encode())
        return out

    def encode(self, text: str | None) -> np.ndarray:
        """Ids of a whole text (null: none), as the library gives them without special tokens."""
        if not text:
            return np.zeros(0, np.uint32)
        if not _PLAIN(text) or any(t in text for t in self.added):
            return np.array(self._whole(text), np.uint32)
        words = self.split(text)
        parts = [*map(self.words.get, words)]
        if None in parts:
            for i, part in enumerate(parts):
                if part is None:
                    parts[i] = self.words.get(words[i]) or self._word(words[i])
        return np.frombuffer(b"".join(parts), np.uint32)

    def _whole(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _word(self, word: str) -> bytes:
        letters = word.encode().decode("latin-1").translate(self.letters)
        ids = array("I", [t.id for t in self.model.tokenize(letters)]).tobytes()
        if len(word) < 64:
            if len(self.words) >= self.cache:
                self.words.clear()
            self.words[word] = ids
        return ids


@lru_cache(maxsize=2)
def encoder(path: str) -> WordEncoder:
    """The worker's encoder for a vocabulary file."""
    return WordEncoder(path)

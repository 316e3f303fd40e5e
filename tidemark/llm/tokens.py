"""Whole-text encoding by the public tokenizers, a word at a time with a cache in each worker.

The results are those of the library for the whole text. A text is cut only where its tokenizer cuts it
too, and a word is looked up before it is encoded. Words of Latin letters and plain punctuation go
straight to the tokenizer's merge model; everything else goes to the tokenizer itself.
"""

from __future__ import annotations

import os
import re
import struct

import numpy as np

from tidemark.llm.common import held

#: Words a worker remembers twice over: the newest, and those that were the newest before.
REMEMBERED = 300_000
#: Control characters that Python takes for white space and the tokenizers do not, and the other way round.
_ODD = re.compile("[\x1c-\x1f᠎​﻿]")
_PLAIN_LOWER = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ!-&(-/:;=>?@\[-`{}~|]*")
_PLAIN = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ0-9!-&(-/:;=>?@\[-`{}~|]*")
_LETTERS_OR_SIGNS = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ]+|[^A-Za-zÀ-ÖØ-öø-ÿ]+")
_LETTERS_DIGITS_SIGNS = re.compile(r" ?(?:[A-Za-zÀ-ÖØ-öø-ÿ]+|[0-9]+|[^A-Za-zÀ-ÖØ-öø-ÿ0-9 ]+)")
_SPACES = re.compile(r"\s\s|^\s|\s$|[^\S \n]")


def byte_letters() -> dict[int, str]:
    """Byte-level vocabularies spell each byte as a printable letter: itself, or the next free one from 256 on."""
    own = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    free = iter(range(256, 512))
    return {b: chr(b) if b in own else chr(next(free)) for b in range(256)}


def _load(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    from tokenizers import Tokenizer
    return Tokenizer.from_file(path)


class Recent(dict):
    """A lookup of bounded size: when full it becomes the old one, whose words return when asked for again."""

    def __init__(self):
        super().__init__()
        self.old: dict = {}

    def put(self, word: str, found):
        if len(self) >= REMEMBERED:
            self.old = dict(self)
            self.clear()
        self[word] = found
        return found


class WordIds:
    """Ids of the lower-casing vocabulary with word ends, as little-endian unsigned 32-bit numbers."""

    def __init__(self, path: str):
        self.tokenizer = _load(path)
        self.model, self.spell = self.tokenizer.model, byte_letters()
        self.words, self.parts = Recent(), Recent()

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _part(self, part: str) -> bytes:
        found = self.parts.old.get(part)
        if found is None:
            ids = [t.id for t in self.model.tokenize(part.encode().decode("latin-1").translate(self.spell))]
            found = struct.pack(f"<{len(ids)}I", *ids)
        return self.parts.put(part, found)

    def _word(self, word: str) -> bytes:
        found = self.words.old.get(word)
        if found is None:
            if _PLAIN_LOWER.fullmatch(word):
                get = self.parts.get
                found = b"".join([get(p) or self._part(p) for p in _LETTERS_OR_SIGNS.findall(word.lower())])
            else:
                found = self._whole(word)
        return self.words.put(word, found)

    def encode(self, text: str) -> bytes:
        if _ODD.search(text):
            return self._whole(text)
        get = self.words.get
        return b"".join([get(w) or self._word(w) for w in text.split()])


class ByteCounts:
    """Number of ids of the byte-level vocabulary, in which a word keeps the space before it."""

    def __init__(self, path: str):
        self.tokenizer = _load(path)
        self.model, self.spell = self.tokenizer.model, byte_letters()
        self.words, self.parts = Recent(), Recent()

    def _whole(self, text: str) -> int:
        return len(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def _part(self, part: str) -> int:
        found = self.parts.get(part) or self.parts.old.get(part)
        if found is None:
            found = len(self.model.tokenize(part.encode().decode("latin-1").translate(self.spell)))
            self.parts.put(part, found)
        return found

    def _word(self, word: str) -> int:
        """A word after a space; after a line break it begins with that."""
        found = self.words.old.get(word)
        if found is None:
            found = 1 + self._one(word[1:]) if word[:1] == "\n" else self._one(" " + word)
        return self.words.put(word, found)

    def _one(self, chunk: str) -> int:
        if _PLAIN.fullmatch(chunk, 1 if chunk[:1] == " " else 0):
            return sum(map(self._part, _LETTERS_DIGITS_SIGNS.findall(chunk)))
        return self._whole(chunk)

    def count(self, text: str) -> int:
        if not text:
            return 0
        if _SPACES.search(text) or _ODD.search(text):
            return self._whole(text)
        first, *words = text.replace("\n", " \n").split(" ")
        get = self.words.get
        return self._one(first) + sum([get(w) or self._word(w) for w in words])


def word_ids(path: str) -> WordIds:
    """The worker's encoder for a file, held with its cache until tasks of another operator begin."""
    return held(("word_ids", path), lambda: WordIds(path))


def byte_counts(path: str) -> ByteCounts:
    return held(("byte_counts", path), lambda: ByteCounts(path))

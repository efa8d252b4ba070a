"""Normalised words of texts, exactly as a word-level BPE file's own normaliser and splitter give them.

Python does the work wherever it provably agrees with the library: on ASCII, and on texts of plain characters, each of which
was tried once against the library. Texts with any other character (combining marks, conjoining letters, whatever this
Python's Unicode tables don't know or know otherwise) go through the library's normaliser and splitter themselves.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from functools import lru_cache

import regex

from .token_counts import load

WORD = r"\p{L}+|'(?:s|t|re|ve|m|ll|d)|\p{N}|[^\p{White_Space}\p{L}\p{N}]+"
ASCII_WORD = r"[a-z]+|'(?:s|t|re|ve|m|ll|d)|[0-9]|[^ \t\n\x0b\x0c\ra-z0-9]+"
_WIDE, _NARROW = regex.compile(WORD), re.compile(ASCII_WORD)

#: Characters that neither reorder nor compose with their neighbours are all but marks, unassigned ones and conjoining Hangul.
_CONJOINING = ((0x1100, 0x11FF), (0xA960, 0xA97F), (0xD7B0, 0xD7FF))


def by_python(text: str) -> list[str]:
    """A final sigma isn't told apart."""
    return _WIDE.findall(unicodedata.normalize("NFC", text).replace("Σ", "σ").lower())


@lru_cache(maxsize=4)
def word_splitter(path: str):
    """A function from a text without special strings to its words, and the special strings of the file."""
    from tokenizers import Tokenizer

    tokenizer, added = load(path)
    with open(path, encoding="utf-8") as f:
        data = json.load(f)
    cut = Tokenizer.from_str(json.dumps(data | {"pre_tokenizer": data["pre_tokenizer"]["pretokenizers"][0]})).pre_tokenizer.pre_tokenize_str
    normal = tokenizer.normalizer.normalize_str
    plain, other = set(), set()

    def by_library(text: str) -> list[str]:
        return [w for w, _ in cut(normal(text))]

    def try_out(c: str) -> None:
        lonely = unicodedata.category(c)[0] != "M" and unicodedata.category(c) != "Cn" and not any(a <= ord(c) <= b for a, b in _CONJOINING)
        sample = f"a{c}a1{c}!{c} {c}"  # tells letters, numbers, white space and the rest apart
        (plain if lonely and by_python(sample) == by_library(sample) else other).add(c)

    def split(text: str) -> list[str]:
        if text.isascii():
            return _NARROW.findall(text.lower())
        if not plain.issuperset(text):
            for c in set(text) - plain - other:
                try_out(c)
            if not plain.issuperset(text):
                return by_library(text)
        return by_python(text)

    return split, added


def text_splitter(path: str):
    """A function from any text to its words and special strings in order."""
    words, added = word_splitter(path)
    special = re.compile("(" + "|".join(map(re.escape, added)) + ")") if added else None
    hint = os.path.commonprefix(added)  # '' is in any text

    def split(text: str) -> list[str]:
        if special is None or hint not in text:
            return words(text)
        out = []
        for i, part in enumerate(special.split(text)):
            out += [part] if i % 2 else words(part)
        return out

    return split

"""Texts as arrays of code points, so that whole batches are measured without a loop over characters."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np

LETTER, UPPER, DIGIT, PUNCTUATION, SYMBOL, SPACE, SENTENCE_END = 1, 2, 4, 8, 16, 32, 64
SIZE = 0x110000

#: Scripts and the code points where their letters lie.
SCRIPTS: list[tuple[str, list[tuple[int, int]]]] = [
    ("latin", [(0x41, 0x24F), (0x1E00, 0x1EFF), (0x2C60, 0x2C7F), (0xA720, 0xA7FF), (0xFF21, 0xFF5A)]),
    ("greek", [(0x370, 0x3FF), (0x1F00, 0x1FFF)]),
    ("cyrillic", [(0x400, 0x52F), (0x1C80, 0x1C8F), (0x2DE0, 0x2DFF), (0xA640, 0xA69F)]),
    ("armenian", [(0x530, 0x58F)]),
    ("hebrew", [(0x590, 0x5FF), (0xFB1D, 0xFB4F)]),
    ("arabic", [(0x600, 0x6FF), (0x750, 0x77F), (0x8A0, 0x8FF), (0xFB50, 0xFDFF), (0xFE70, 0xFEFF)]),
    ("devanagari", [(0x900, 0x97F)]),
    ("bengali", [(0x980, 0x9FF)]),
    ("tamil", [(0xB80, 0xBFF)]),
    ("telugu", [(0xC00, 0xC7F)]),
    ("thai", [(0xE00, 0xE7F)]),
    ("georgian", [(0x10A0, 0x10FF)]),
    ("hangul", [(0x1100, 0x11FF), (0x3130, 0x318F), (0xAC00, 0xD7AF)]),
    ("kana", [(0x3040, 0x30FF), (0x31F0, 0x31FF), (0xFF66, 0xFF9F)]),
    ("han", [(0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x3134F)]),
]


@cache
def classes() -> np.ndarray:
    """Class bits of every code point."""
    table = np.zeros(SIZE, "u1")
    for c in range(SIZE):
        kind = unicodedata.category(chr(c))
        if kind[0] == "L":
            table[c] = LETTER | (UPPER if kind == "Lu" else 0)
        elif kind == "Nd":
            table[c] = DIGIT
        elif kind[0] == "P":
            table[c] = PUNCTUATION
        elif kind[0] == "S":
            table[c] = SYMBOL
    for c in " \t\n\x0b\x0c\r":
        table[ord(c)] = SPACE
    for c in "#*%&":
        table[ord(c)] = SYMBOL
    for c in ".!?":
        table[ord(c)] |= SENTENCE_END
    return table


@cache
def lower() -> np.ndarray:
    """The lower case of every letter that has one of a single character; 0 for what is no letter."""
    letter = classes() & LETTER
    table = np.zeros(SIZE, "u4")
    for c in np.flatnonzero(letter).tolist():
        small = chr(c).lower()
        table[c] = ord(small) if len(small) == 1 else c
    return table


@cache
def scripts() -> np.ndarray:
    """1 + the index in SCRIPTS of a letter's script, 0 for others."""
    table = np.zeros(SIZE, "u1")
    for i, (_, ranges) in enumerate(SCRIPTS):
        for a, b in ranges:
            table[a : b + 1] = i + 1
    return table


def chunks(texts: list[str | None], characters: int = 1_000_000) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about so many characters together; a longer text is a range by itself."""
    begin, size = 0, 0
    for i, t in enumerate(texts):
        n = len(t or "")
        if i > begin and size + n > characters:
            yield begin, i
            begin, size = i, 0
        size += n
    if len(texts) > begin:
        yield begin, len(texts)


def joined(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of the texts with a newline before each and one at the end; where each text starts and ends."""
    lengths = np.fromiter((len(t or "") for t in texts), "i8", len(texts))
    ends = np.cumsum(lengths + 1)
    points = np.frombuffer(("\n" + "\n".join(t or "" for t in texts) + "\n").encode("utf-32-le", "surrogatepass"), "u4")
    return points, ends - lengths, ends


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of true values start and end; the first and last value are false."""
    edges = np.flatnonzero(mask[1:] != mask[:-1]) + 1
    return edges[::2], edges[1::2]


def counts(mask: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(mask, dtype="i8")])
    return total[ends] - total[starts]

"""Words of whole batches of texts as places in their joined bytes, with 64-bit hashes, without a loop over words.

A word is a run of other than space and U+0009 to U+000D, which UTF-8 decides byte by byte.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

IS_SPACE = np.zeros(256, bool)
IS_SPACE[list(b" \t\n\x0b\x0c\r")] = True
K1, K2, K3 = np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x9E3779B97F4A7C15), np.uint64(0x165667B19E3779F9)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * K1
    return x ^ (x >> np.uint64(29))


class Words:
    """The words of some texts, given as UTF-8."""

    def __init__(self, raw: list[bytes]) -> None:
        self.buffer = b"\n" + b"\n".join(raw) + b"\n"
        points = np.frombuffer(self.buffer, "u1")
        word = ~IS_SPACE[points]
        edges = np.flatnonzero(word[1:] != word[:-1]) + 1
        self.first, self.last = edges[::2], edges[1::2]
        starts = np.cumsum([1, *[len(r) + 1 for r in raw]])
        #: The text of each word, and the first word of each text, with the end of the last.
        self.owner = np.searchsorted(starts, self.first, side="right") - 1
        self.base = np.searchsorted(self.first, starts)
        self.points = points

    def hashes(self) -> np.ndarray:
        """One a word: a sum over its bytes and their places in it."""
        place = np.arange(len(self.points), dtype="u8") - np.repeat(np.concatenate([[0], self.first]).astype("u8"), np.diff(np.concatenate([[0], self.first, [len(self.points)]])))
        sums = np.concatenate([np.zeros(1, "u8"), np.cumsum(mix((self.points.astype("u8") + (place << np.uint64(8)) + np.uint64(1)) * K2), dtype="u8")])
        return mix(sums[self.last] - sums[self.first])

    @staticmethod
    def rolled(hashes: np.ndarray, size: int) -> np.ndarray:
        """The hash of every `size` words in a row."""
        grams = np.zeros(max(0, len(hashes) - size + 1), "u8")
        for i in range(size if len(grams) else 0):
            grams = grams * K3 + hashes[i : len(grams) + i]
        return mix(grams)

    @staticmethod
    def name(hashes: np.ndarray) -> int:
        """The hash of a whole sequence of words; 0 for none."""
        return int(mix((hashes + np.arange(1, len(hashes) + 1, dtype="u8") * K2) * K3).sum(dtype="u8"))


def chunks(texts: list[str | None], size: int = 1_000_000) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about so many characters together; a longer text is a range by itself."""
    begin = total = 0
    for i, t in enumerate(texts):
        if i > begin and total + len(t or "") > size:
            yield begin, i
            begin, total = i, 0
        total += len(t or "")
    if len(texts) > begin:
        yield begin, len(texts)

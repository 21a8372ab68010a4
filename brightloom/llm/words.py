"""Words and word n-grams of whole texts as 64-bit hashes, vectorised over code points."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np

MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)  #: odd, so it has an inverse modulo 2 ** 64
PIECE = 1 << 18  #: code points that are hashed at once


@cache
def word_characters() -> np.ndarray:
    """For each code point whether it is a letter or digit."""
    return np.fromiter((chr(c).isalnum() for c in range(0x110000)), bool, 0x110000)


@cache
def powers() -> tuple[np.ndarray, np.ndarray]:
    """MULTIPLIER ** k and its inverse for each place k of a piece."""
    inverse = np.uint64(pow(int(MULTIPLIER), -1, 1 << 64))
    up, down = np.full(PIECE, MULTIPLIER), np.full(PIECE, inverse)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def mixed(x: np.ndarray) -> np.ndarray:
    """Each number's bits spread over all 64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def hashed(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words among at most PIECE code points, and where they begin."""
    inside = np.zeros(len(points) + 2, bool)
    inside[1:-1] = word_characters()[points]
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    up, down = powers()
    terms = points + np.uint64(1)
    terms *= up[: len(points)]
    sums = np.zeros(len(points) + 1, np.uint64)
    np.cumsum(terms, out=sums[1:])
    return mixed((sums[ends] - sums[starts]) * down[starts]), starts


def word_hashes(text: str | None) -> np.ndarray:
    """A hash for each word, a longest run of letters and digits of the lower-cased text, in order."""
    points = code_points((text or "").lower())
    found, at = [], 0
    while at < len(points):
        stop = min(len(points), at + PIECE)
        if stop < len(points):  # end behind the last character that is none of a word, unless one word fills the piece
            outside = np.flatnonzero(~word_characters()[points[at:stop]])
            if len(outside):
                stop = at + int(outside[-1]) + 1
        found.append(hashed(points[at:stop])[0])
        at = stop
    return np.concatenate(found) if found else np.zeros(0, np.uint64)


def hashes_of(texts: Iterable[str | None]) -> Iterator[np.ndarray]:
    """`word_hashes` of each text; short ones are joined and hashed together, which costs a third."""
    group: list[str] = []
    n = 0

    def together() -> list[np.ndarray]:
        hashes, starts = hashed(code_points("\n".join(group)))
        return np.split(hashes, np.searchsorted(starts, np.cumsum([len(t) + 1 for t in group])[:-1]))

    for text in texts:
        text = (text or "").lower()
        if group and n + len(text) >= PIECE:
            yield from together()
            group, n = [], 0
        if len(text) >= PIECE:
            yield word_hashes(text)
        else:
            group.append(text)
            n += len(text) + 1
    if group:
        yield from together()


def shingles(text: str | None, n: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the text's runs of `n` words; a text of fewer words has one, of all of them.

    A text without words has one that stands for the text itself; null and empty texts have none.
    """
    if not text:
        return np.zeros(0, np.uint64)
    words = word_hashes(text)
    if not len(words):
        words = mixed(code_points(text).astype(np.uint64) + np.uint64(1 << 40))
        n = len(words)
    n = min(n, len(words))
    total = np.zeros(len(words) - n + 1, np.uint64)
    for k in range(n):
        total = total * MULTIPLIER + words[k : len(words) - n + 1 + k]
    return np.unique(mixed(total))

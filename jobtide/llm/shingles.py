"""Sets of word shingles as 64-bit hashes, for a block of texts at once."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from .common import mix, word_hashes

_PLACE = [np.uint64(x | 1) for x in (0x9FB21C651E98DF25, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53, 0x2545F4914F6CDD1D)]


@dataclass
class Sets:
    """The distinct shingle hashes of all texts, by text and then by value."""

    owner: np.ndarray
    hashes: np.ndarray
    sizes: np.ndarray
    #: 128 bits that identify each text's set, in two halves; equal sets have equal ones.
    identity: np.ndarray
    check: np.ndarray

    def of(self, i: int) -> np.ndarray:
        ends = np.cumsum(self.sizes)
        return self.hashes[ends[i] - self.sizes[i] : ends[i]]


def word_bounds(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words: runs without the six ASCII white spaces."""
    word = ~((codes == 32) | ((codes >= 9) & (codes <= 13)))
    edge = np.diff(np.concatenate([[False], word, [False]]).astype(np.int8))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def shingle_sets(texts: list[str], words: int = 4) -> Sets:
    """A-Z in lower case; shingles of ``words`` words. A text with fewer words has its whole sequence as one shingle, one without words none."""
    joined = "\n".join(texts)
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    codes = np.where((codes >= 65) & (codes <= 90), codes + 32, codes)
    start, end = word_bounds(codes)
    first = np.cumsum([0] + [len(t) + 1 for t in texts])
    owner = np.searchsorted(first, start, side="right") - 1
    h = word_hashes(codes, start, end)
    count = np.bincount(owner, minlength=len(texts))[: len(texts)]
    begin = np.cumsum(count) - count
    n = np.where(count >= words, count - words + 1, (count > 0).astype(np.int64))
    who = np.repeat(np.arange(len(texts)), n)
    at = np.arange(len(who)) - np.repeat(np.cumsum(n) - n, n) + begin[who]
    length = np.minimum(count[who], words)
    value = length.astype(np.uint64) * np.uint64(0x8CB92BA72F3D8DD7)
    for k in range(words):
        there = k < length
        value[there] += h[at[there] + k] * _PLACE[k % len(_PLACE)]
        value = mix(value) if k % len(_PLACE) == len(_PLACE) - 1 else value
    value = mix(value)
    order = np.lexsort((value, who))
    value, who = value[order], who[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (who[1:] != who[:-1])
    value, who = value[new], who[new]
    sizes = np.bincount(who, minlength=len(texts))[: len(texts)]
    halves = []
    for salt in (0x5851F42D4C957F2D, 0x2127599BF4325C37):
        sums = np.zeros(len(value) + 1, np.uint64)
        np.cumsum(mix(value ^ np.uint64(salt)), out=sums[1:])
        ends = np.cumsum(sizes)
        halves.append(mix(sums[ends] - sums[ends - sizes] + sizes.astype(np.uint64)))
    return Sets(who, value, sizes, *halves)

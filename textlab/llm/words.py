"""Vectorised words and word shingles of Arrow string arrays."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from textlab.llm.common import data, offsets

_RNG = np.random.default_rng(0x7E97)
#: A random odd number for each place in a word (used over again after the last) and each byte.
_PLACE = _RNG.integers(1 << 62, size=256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE = _RNG.integers(1 << 63, size=256, dtype=np.uint64)
#: Bytes of words: letters, digits and all of non-ASCII characters.
WORD = np.array([b >= 128 or chr(b).isalnum() for b in range(256)])
NOT_BLANK = np.array([chr(b) not in " \t\n\r\x0b\x0c" for b in range(256)])


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit numbers."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(29))


def hashed_words(texts: pa.Array, lower: bool = True, inside: np.ndarray = WORD) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all texts' words: hashes, first and end byte in the text; and the number of words by text.

    ``inside`` tells the bytes that words consist of. Bytes count in ``texts`` as they are,
    so that ``lower`` must not be set where places are used.
    """
    if lower:
        texts = pc.utf8_lower(texts)
    raw = data(texts)
    starts, ends = offsets(texts)
    if not len(raw):
        none = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), none, none, np.zeros(len(starts), np.int64)
    word = inside[raw]
    before = np.zeros(len(raw), bool)
    before[1:] = word[:-1]
    before[starts[starts < len(raw)]] = False
    first = np.flatnonzero(word & ~before)
    after = np.zeros(len(raw), bool)
    after[:-1] = word[1:]
    after[ends[ends > 0] - 1] = False
    end = np.flatnonzero(word & ~after) + 1
    if not first.size:
        none = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), none, none, np.zeros(len(starts), np.int64)
    at = np.flatnonzero(word)
    size = end - first
    began = np.cumsum(size) - size
    place = np.arange(len(at), dtype=np.int64) - np.repeat(began, size)
    # Each byte by its place, so that the sum depends on the order; longer words fold in their length.
    value = _BYTE[raw[at]] * _PLACE[place & 255]
    if size.max() > 256:
        value = value + (place >> 8).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) * _BYTE[raw[at]]
    h = mix(np.add.reduceat(value, began) + size.astype(np.uint64))
    count = np.searchsorted(first, ends) - np.searchsorted(first, starts)
    text = np.repeat(np.arange(len(starts)), count)
    return h, first - starts[text], end - starts[text], count


def shingles(h: np.ndarray, count: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of ``width`` consecutive words of each text, and their number by text.

    A text of fewer words has one shingle of all its words; one without words has none.
    """
    n = np.where(count >= width, count - width + 1, np.minimum(count, 1))
    first = np.cumsum(count) - count
    text = np.repeat(np.arange(len(count)), n)
    at = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + first[text]
    left = (first + count)[text] - at
    out = np.zeros(len(at), np.uint64)
    for i in range(width):
        part = h[np.minimum(at + i, max(0, len(h) - 1))] if len(h) else out
        out = out * np.uint64(0x9E3779B97F4A7C15) + np.where(left > i, part, np.uint64(0))
    return mix(out), n

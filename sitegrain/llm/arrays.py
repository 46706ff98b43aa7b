"""Words of many texts as arrays of numbers, for operators that work in Arrow batches.

Texts of a batch are one array of bytes. Word borders come from a mask, and a word's 64-bit
hash from running sums of byte values times powers of an odd number, so no word is a
Python object.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_BYTE = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64)

#: Bytes with A-Z as a-z.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
#: Bytes of words between white space.
NOT_SPACE = ~_SPACE
#: Bytes of words of ASCII letters, digits, and everything outside ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[65:91] = ALNUM[97:123] = ALNUM[128:] = True


def slices(texts: pa.Array, most_bytes: int = 1 << 21) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``most_bytes`` each; a longer text is a range of its own."""
    offsets = np.frombuffer(texts.buffers()[1], np.int32 if pa.types.is_string(texts.type) else np.int64)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    start = 0
    while start < len(texts):
        end = max(int(np.searchsorted(offsets, offsets[start] + most_bytes, "right")) - 1, start + 1)
        yield start, min(end, len(texts))
        start = end


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts with a blank after each, and where each text starts (one more entry
    for the end). Null counts as empty."""
    texts = pa.array(texts) if not isinstance(texts, pa.Array) else texts
    wide = np.int32 if pa.types.is_string(texts.type) else np.int64
    offsets = np.frombuffer(texts.buffers()[1], wide)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None else np.zeros(0, np.uint8)
    out = np.full(int(offsets[-1] - offsets[0]) + len(texts), 32, np.uint8)
    starts = offsets - offsets[0] + np.arange(len(texts) + 1)
    keep = np.ones(len(out), bool)
    keep[starts[1:] - 1] = False
    out[keep] = data[offsets[0] : offsets[-1]]
    return out, starts


def mix64(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


_powers = np.zeros(0, np.uint64)
_inverses = np.zeros(0, np.uint64)


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers, _inverses
    if len(_powers) < n:
        size, one = max(n, 1 << 20), np.ones(1, np.uint64)
        _powers = np.concatenate((one, np.cumprod(np.full(size - 1, _BASE, np.uint64))))
        _inverses = np.concatenate((one, np.cumprod(np.full(size - 1, _INVERSE, np.uint64))))
    return _powers[:n], _inverses[:n]


class Words:
    """Words of a list of texts: ``start`` and ``end`` in ``data`` (lower-cased bytes), ``hash``,
    and ``first``, where each text's words begin (one more entry for the end)."""

    def __init__(self, texts: pa.Array, kind: np.ndarray):
        raw, starts = text_bytes(texts)
        self.data = LOWER[raw]
        inside = kind[raw]
        edge = np.flatnonzero(np.diff(inside.view(np.int8), prepend=np.int8(0), append=np.int8(0)))
        self.start, self.end = edge[::2], edge[1::2]
        self.first = np.searchsorted(self.start, starts)
        powers, inverses = _power_tables(len(raw) + 1)
        sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(_BYTE[self.data] * powers[:-1], out=sums[1:])
        self.hash = mix64((sums[self.end] - sums[self.start]) * inverses[self.start])

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def text_of_word(self) -> np.ndarray:
        """Index of the text that each word belongs to."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts())

    def word(self, i: int) -> str:
        return self.data[self.start[i] : self.end[i]].tobytes().decode()


def grams(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of ``k`` words, by position; runs may cross texts."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.full(n, np.uint64(k))
    for i in range(k):
        h = mix64(h * np.uint64(0xD6E8FEB86659FD93) + words[i : i + n])
    return h


def grams_inside(first: np.ndarray, n_words: int, k: int) -> np.ndarray:
    """Whether the run of ``k`` words at each position stays in its text."""
    n = n_words - k + 1
    inside = np.ones(max(n, 0), bool)
    for s in range(1, k):  # a run at p crosses a border b when p < b < p + k
        at = first[1:-1] - s
        inside[at[(at >= 0) & (at < n)]] = False
    return inside

"""Words and word shingles of many texts at once, in numpy over their UTF-8 bytes.

A word's 64-bit number depends on its bytes alone, so it is the same in every
task.  The bytes of A-Z count as a-z.
"""

from __future__ import annotations

import numpy as np

from .common import mix

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32

#: Characters that are no white space (bytes 0x20 and 0x09-0x0D).
SPACED = np.ones(256, dtype=bool)
SPACED[[0x20, 9, 10, 11, 12, 13]] = False

#: Digits, letters a-z and everything beyond ASCII.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True

SPAN = 1 << 19
_P = 0x9E3779B97F4A7C15 | 1
_Q = np.uint64(0xD6E8FEB86659FD93)
_PINV = pow(_P, -1, 1 << 64)
_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F))
_UP = _DOWN = np.ones(1, dtype=np.uint64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def _numbers(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The number of each word, from running sums over stretches of about SPAN bytes, however long the texts are."""
    global _UP, _DOWN
    out, i = np.empty(len(start), dtype=np.uint64), 0
    while i < len(start):
        j = max(i + 1, int(np.searchsorted(end, start[i] + SPAN, "right")))
        low, n = start[i], int(end[j - 1] - start[i])
        if len(_UP) < n:
            size = max(n, SPAN)
            _UP, _DOWN = _powers(_P, size), _powers(_PINV, size)
        sums = np.cumsum(_BYTE[data[low : low + n]] * _UP[:n])
        first = start[i:j] - low
        before = np.where(first > 0, sums[first - 1], np.uint64(0))
        out[i:j] = (sums[end[i:j] - low - 1] - before) * _DOWN[first]
        i = j
    if len(_UP) > 4 * SPAN:  # one very long word
        _UP = _DOWN = np.ones(1, dtype=np.uint64)
    return mix(out)


class Block:
    """The words of a run of texts.

    first: for text i its words are first[i]:first[i + 1].  start and end: where
    each word lies in data, which holds the texts, each after a line feed.
    """

    def __init__(self, texts: list[bytes], kind: np.ndarray):
        raw = b"\n" + b"\n".join(texts) + b"\n"
        self.data = _FOLD[np.frombuffer(raw, dtype=np.uint8)]
        inside = kind[self.data]
        edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        self.start, self.end = edge[0::2], edge[1::2]
        self.offset = np.cumsum([1] + [len(t) + 1 for t in texts])
        self.first = np.searchsorted(self.start, self.offset)
        self.word = _numbers(self.data, self.start, self.end)

    def text_of(self, i: int) -> bytes:
        """Word i."""
        return self.data[self.start[i] : self.end[i]].tobytes()

    def shingles(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the k words from each word on, and whether they lie in one text."""
        return shingle_numbers(self.word, k), self.whole(k)

    def whole(self, k: int) -> np.ndarray:
        n = max(0, len(self.word) - k + 1)
        text = np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))
        return text[:n] == text[k - 1 :] if n else np.zeros(0, dtype=bool)

    def sets(self, k: int) -> list[np.ndarray]:
        """For each text its distinct shingles, sorted; with fewer than k words, the one of all its words."""
        every = shingle_numbers(self.word, k)
        out = []
        for a, b in zip(self.first[:-1].tolist(), self.first[1:].tolist(), strict=True):
            if b - a >= k:
                out.append(np.unique(every[a : b - k + 1]))
            else:
                out.append(shingle_numbers(self.word[a:b], b - a) if b > a else every[:0])
        return out


def shingle_numbers(word: np.ndarray, k: int) -> np.ndarray:
    n = len(word) - k + 1
    if n <= 0 or k <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = word[:n].copy()
    for j in range(1, k):
        out *= _Q
        out += word[j : j + n]
    return mix(out + np.uint64(k))

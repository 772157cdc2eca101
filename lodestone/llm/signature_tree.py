"""Signature trees over token sets, and the dual traversal that finds the pairs worth comparing.

A set's signature is a bitmap of its tokens.  A node has the OR of the bitmaps under
it, the range of the sizes, and the most tokens by which a set exceeds its bits;
from these follows the largest overlap that any two sets under two nodes can have.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

LEAF = 8  # sets of a leaf
FAN = 8  # children of a node
BITS = 512, 16384  # of a bitmap, at least and at most
SLICE = 1 << 14  # pairs that are tested at once


def signatures(tokens: list[np.ndarray], bits: int) -> np.ndarray:
    """A bitmap for each set: one bit a token, by its lowest bits."""
    out = np.empty((len(tokens), bits // 64), dtype=np.uint64)
    each = max(1, (1 << 24) // bits)
    for a in range(0, len(tokens), each):
        some = tokens[a : a + each]
        row = np.repeat(np.arange(len(some)), [len(t) for t in some])
        flat = np.zeros((len(some), bits), dtype=np.uint8)
        flat[row, (np.concatenate(some) & np.uint64(bits - 1)).astype(np.int64)] = 1
        out[a : a + each] = np.packbits(flat, axis=1, bitorder="little").view(np.uint64)
    return out


def _count(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x).sum(axis=-1, dtype=np.int64)


def _product(i: np.ndarray, j: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Children of i with children of j; of a node with itself each pair once, and each child with itself."""
    m, n = end[i] - start[i], end[j] - start[j]
    at = np.repeat(np.arange(len(i)), m * n)
    k = np.arange(len(at)) - np.repeat(np.cumsum(m * n) - m * n, m * n)
    p, q = start[i][at] + k // n[at], start[j][at] + k % n[at]
    keep = (i[at] != j[at]) | (p <= q)
    return p[keep], q[keep]


class _Level:
    def __init__(self, bits, low, high, extra, start, end):
        self.bits, self.low, self.high, self.extra, self.start, self.end = bits, low, high, extra, start, end


class Forest:
    """A tree for each group of sets, all built and traversed together.

    group: the group of each set, in rising order without gaps.  Within a tree sets lie in order of size.
    """

    def __init__(self, group: np.ndarray, tokens: list[np.ndarray], up: int, down: int):
        self.up, self.down = up, down
        size = np.array([len(t) for t in tokens], dtype=np.int64)
        wide = int(min(max(BITS[0], 1 << int(np.ceil(np.log2(max(1.0, 2 * size.mean()))))), BITS[1]))
        bits = signatures(tokens, wide)
        self.order = np.lexsort((bits[:, 0], size, group))
        self.tokens = [tokens[i] for i in self.order]
        self.size, self.bits = size[self.order], bits[self.order]
        extra, at = self.size - _count(self.bits), group[self.order]
        low = high = self.size
        level, fan, self.levels = self.bits, LEAF, []
        while True:
            first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
            place = np.arange(len(at)) - np.repeat(first, np.diff(np.r_[first, len(at)]))
            cut = np.flatnonzero(place % fan == 0)
            level, low, high, extra = (f.reduceat(x, cut, axis=0) for f, x in ((np.bitwise_or, level), (np.minimum, low), (np.maximum, high), (np.maximum, extra)))
            self.levels.insert(0, _Level(level, low, high, extra, cut, np.r_[cut[1:], len(at)]))
            at, fan = at[cut], FAN
            if len(at) == len(first):
                break
        self.trees, self.compared = len(at), 0

    def _able(self, level: _Level, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Whether sets under nodes i and j may be similar enough, by their largest possible overlap."""
        able = (self.down * level.high[i] >= self.up * level.low[j]) & (self.down * level.high[j] >= self.up * level.low[i])
        for a in range(0, len(i), SLICE):
            k = a + np.flatnonzero(able[a : a + SLICE])
            x, y = i[k], j[k]
            most = np.minimum(_count(level.bits[x] & level.bits[y]) + np.minimum(level.extra[x], level.extra[y]), np.minimum(level.high[x], level.high[y]))
            able[k] = (self.up + self.down) * most >= self.up * (level.low[x] + level.low[y])
        return able

    def leaves(self, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The pairs of leaves that the dual traversal reaches from the pairs of roots (i, j)."""
        for above, level in zip([None, *self.levels], self.levels, strict=False):
            if above is not None:
                i, j = _product(i, j, above.start, above.end)
            able = self._able(level, i, j)
            i, j = i[able], j[able]
        return i, j

    def _near(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Whether the bitmaps of sets i and j allow a link."""
        able = (self.down * self.size[i] >= self.up * self.size[j]) & (self.down * self.size[j] >= self.up * self.size[i])
        for a in range(0, len(i), SLICE):
            k = a + np.flatnonzero(able[a : a + SLICE])
            x, y, m, n = self.bits[i[k]], self.bits[j[k]], self.size[i[k]], self.size[j[k]]
            most = np.minimum(m - _count(x & ~y), n - _count(y & ~x))
            able[k] = (self.up + self.down) * most >= self.up * (m + n)
        return able

    def _alike(self, p: int, q: int) -> bool:
        s, t = self.tokens[p], self.tokens[q]
        self.compared += 1
        at = np.searchsorted(s, t)
        at[at == len(s)] = 0
        both = np.count_nonzero(s[at] == t)
        return self.down * both >= self.up * (len(s) + len(t) - both)

    def links(self, i: np.ndarray, j: np.ndarray, label: np.ndarray, alike: Callable[[int, int], bool] | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Links, as positions in the input, between sets under the pairs of roots (i, j), so many that with the given
        labels (numbers of components known) they make every component.

        Pairs of leaves are taken from the nearest in order of size on; sets that have come into one
        component meanwhile aren't compared.
        """
        alike, leaf = alike or self._alike, self.levels[-1]
        i, j = self.leaves(i, j)
        _, root = np.unique(label[self.order], return_inverse=True)
        found: list[tuple[int, int]] = []
        far = np.frexp(np.abs(j - i).astype(np.float64))[1]  # 0, 1, 2 for 2 and 3, 3 for 4 to 7, ...
        for d in range(int(far.max(initial=-1)) + 1):
            x, y = i[far == d], j[far == d]
            for a in range(0, len(x), SLICE // 16):
                low, high = (f.reduceat(root, leaf.start) for f in (np.minimum, np.maximum))
                p, q = x[a : a + SLICE // 16], y[a : a + SLICE // 16]
                unlike = (low[p] != high[p]) | (low[q] != high[q]) | (low[p] != low[q])
                p, q = _product(p[unlike], q[unlike], leaf.start, leaf.end)
                p, q = (v[root[p] != root[q]] for v in (p, q))
                near = self._near(p, q)
                p, q = p[near], q[near]
                turn = 0
                while len(p):
                    # each set with the first that it may be linked to; the rest, if any is left after some turns, at once
                    now = np.unique(q, return_index=True)[1] if turn < 4 else np.arange(len(p))
                    ok = [(s, t) for s, t in zip(p[now].tolist(), q[now].tolist(), strict=True) if alike(s, t)]
                    found += ok
                    if ok:
                        root = _joined(root, np.array(ok))
                    rest = np.ones(len(p), dtype=bool)
                    rest[now] = False
                    rest &= root[p] != root[q]
                    p, q, turn = p[rest], q[rest], turn + 1
        out = np.array(found, dtype=np.int64).reshape(-1, 2)
        return self.order[out[:, 0]], self.order[out[:, 1]]


def _joined(root: np.ndarray, links: np.ndarray) -> np.ndarray:
    """Labels, numbered from 0, after the components at both ends of the links are one."""
    a, b, up = root[links[:, 0]], root[links[:, 1]], np.arange(int(root.max()) + 1)
    while True:
        least = np.minimum(up[a], up[b])
        before = up.copy()
        np.minimum.at(up, up[a], least)
        np.minimum.at(up, up[b], least)
        up = up[up]
        if (up == before).all():
            return up[root]

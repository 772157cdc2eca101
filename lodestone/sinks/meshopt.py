"""The meshopt attribute codec, version 0, after its published format."""

from __future__ import annotations

import numpy as np

HEADER = 0xA0
BLOCK_BYTES, BLOCK_MOST, GROUP = 8192, 256, 16


def _block_size(stride: int) -> int:
    return min(BLOCK_MOST, BLOCK_BYTES // stride & ~(GROUP - 1))


def _zigzag(delta: np.ndarray) -> np.ndarray:
    signed = delta.view(np.int8).astype(np.int16)
    return ((signed << 1) ^ (signed >> 15)).astype(np.uint8)


def _groups(groups: np.ndarray, widths: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The shortest of four widths for each group of sixteen bytes: (which, where its data ends, all data).

    Values too wide for theirs are escaped and follow.  All groups of a stream are packed together.
    """
    sizes = []
    for bits in widths:
        if bits == 0:
            sizes.append(np.where(groups.any(axis=1), 1 << 20, 0))
        else:
            sizes.append(np.full(len(groups), GROUP) if bits == 8 else GROUP * bits // 8 + (groups >= (1 << bits) - 1).sum(axis=1))
    sizes = np.stack(sizes)
    which = sizes.argmin(axis=0)
    size = sizes[which, np.arange(len(groups))]
    ends = np.cumsum(size)
    out, start = np.zeros(int(ends[-1]) if len(ends) else 0, dtype=np.uint8), ends - size
    for k, bits in enumerate(widths):
        mine = np.flatnonzero(which == k)
        if not len(mine) or not bits:
            continue
        values, at = groups[mine], start[mine]
        if bits == 8:
            out[at[:, None] + np.arange(GROUP)] = values
            continue
        escape, each = (1 << bits) - 1, 8 // bits
        small, n = np.minimum(values, escape), GROUP * bits // 8
        packed = np.zeros((len(mine), n), dtype=np.uint8)
        for j in range(each):
            # single bits go from the lowest, wider values from the highest
            packed |= (small[:, j::each] << np.uint8(j if bits == 1 else 8 - bits * (j + 1))).astype(np.uint8)
        out[at[:, None] + np.arange(n)] = packed
        row, column = np.nonzero(values >= escape)
        rank = np.arange(len(row)) - np.searchsorted(row, row, "left")
        out[at[row] + n + rank] = values[row, column]
    return which, ends, out


def _heads(which: np.ndarray) -> np.ndarray:
    """(..., groups) of two bits each, four to a byte."""
    padded = np.concatenate([which, np.zeros((*which.shape[:-1], -which.shape[-1] % 4), dtype=which.dtype)], axis=-1)
    parts = padded.reshape(*padded.shape[:-1], -1, 4)
    return (parts << np.array([0, 2, 4, 6])).sum(axis=-1).astype(np.uint8)


def _columns(deltas: np.ndarray, size: int):
    """Arrays (blocks, columns, groups, 16) of the rows: that of the whole blocks, and that of the last one, padded."""
    n, stride = deltas.shape
    whole = n // size * size
    for part, rows in ((deltas[:whole], size), (deltas[whole:], n - whole)):
        if len(part):
            padded = np.concatenate([part, np.zeros((-rows % GROUP, stride), dtype=np.uint8)]) if rows != size else part
            yield rows, np.ascontiguousarray(padded.reshape(-1, -(-rows // GROUP), GROUP, stride).transpose(0, 3, 1, 2))


def encode(data: np.ndarray) -> bytes:
    """data: unsigned bytes, a row of ``stride`` (a multiple of four up to 256) for each vertex."""
    n, stride = data.shape
    if stride % 4 or not 0 < stride <= 256:
        raise ValueError("a vertex has a multiple of four bytes, up to 256")
    first = data[0].copy() if n else np.zeros(stride, dtype=np.uint8)
    out = [bytes([HEADER])]
    if n:
        deltas = _zigzag((data - np.concatenate([data[:1], data[:-1]])).astype(np.uint8))
        for _, columns in _columns(deltas, _block_size(stride)):
            blocks, _, groups, _ = columns.shape
            which, ends, body = _groups(columns.reshape(-1, GROUP), (0, 2, 4, 8))
            heads, cuts = _heads(which.reshape(-1, groups)), np.r_[0, ends[groups - 1 :: groups]]
            for i in range(blocks * stride):
                out += [heads[i].tobytes(), body[cuts[i] : cuts[i + 1]].tobytes()]
    tail = max(stride, 32)
    return b"".join(out) + b"\0" * (tail - stride) + first.tobytes()


def decode(raw: bytes, n: int, stride: int) -> np.ndarray:
    if raw[0] != HEADER:
        raise ValueError("not version 0 of the codec")
    out, at, size = np.zeros((n, stride), dtype=np.uint8), 1, _block_size(stride)
    last = np.frombuffer(raw[len(raw) - stride :], dtype=np.uint8).copy()
    for a in range(0, n, size):
        count = min(size, n - a)
        groups = -(-count // GROUP)
        for k in range(stride):
            head, at = raw[at : at + -(-groups // 4)], at + -(-groups // 4)
            column = np.zeros(groups * GROUP, dtype=np.uint8)
            for g in range(groups):
                mode = head[g // 4] >> (g % 4 * 2) & 3
                mine = column[g * GROUP : (g + 1) * GROUP]
                if mode == 3:
                    mine[:] = np.frombuffer(raw, np.uint8, GROUP, at)
                    at += GROUP
                elif mode:
                    bits = 2 * mode
                    escape, each = (1 << bits) - 1, 8 // bits
                    packed = np.frombuffer(raw, np.uint8, GROUP // each, at)
                    at += GROUP // each
                    for j in range(each):
                        mine[j::each] = packed >> (8 - bits * (j + 1)) & escape
                    large = np.flatnonzero(mine == escape)
                    mine[large] = np.frombuffer(raw, np.uint8, len(large), at)
                    at += len(large)
            column = column[:count]
            delta = (column >> 1) ^ (-(column & 1).astype(np.int16)).astype(np.uint8)
            out[a : a + count, k] = np.cumsum(np.r_[last[k], delta].astype(np.int64))[1:].astype(np.uint8)
        last = out[a + count - 1].copy()
    return out


# ---------------------------------------------------------------- version 1

HEADER_1 = 0xA1
BYTES, SHORTS, XOR = 0, 1, 2  # how a channel of four bytes differs from the row before
_WIDTHS = ((0, 1, 2, 4), (1, 2, 4, 8))  # bits of a group's values under the first two controls
_ZERO, _LITERAL = 2, 3
_TAIL = 24


def _rotl(x: np.ndarray, by: int) -> np.ndarray:
    return x << np.uint32(by) | x >> np.uint32(32 - by) if by else x


def _channel_deltas(cur: np.ndarray, prev: np.ndarray, mode: int) -> np.ndarray:
    """(n, 4) bytes that stand for the rows, given each one's predecessor."""
    kind, turn = mode & 15, mode >> 4
    if kind == BYTES:
        return _zigzag((cur - prev).astype(np.uint8))
    cur, prev = np.ascontiguousarray(cur), np.ascontiguousarray(prev)
    if kind == SHORTS:
        d = (cur.view("<u2") - prev.view("<u2")).view("<i2").astype(np.int32)
        return np.ascontiguousarray(((d << 1) ^ (d >> 15)).astype("<u2")).view(np.uint8)
    return np.ascontiguousarray(_rotl(cur.view("<u4") ^ prev.view("<u4"), turn).astype("<u4")).view(np.uint8)


def _chosen(columns: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray, list]:
    """For each column of each block (blocks, columns): its control, its bytes, and what both ways of grouping made."""
    blocks, stride, groups, _ = columns.shape
    flat, made = columns.reshape(-1, GROUP), []
    sizes = [np.where(columns.any(axis=(2, 3)), 1 << 30, 0), np.full((blocks, stride), rows)]
    for widths in _WIDTHS:
        which, ends, body = _groups(flat, widths)
        cuts = np.r_[0, ends[groups - 1 :: groups]]
        made.append((_heads(which.reshape(-1, groups)), cuts, body))
        sizes.append(np.diff(cuts).reshape(blocks, stride) + -(-groups // 4))
    order = np.stack(sizes)  # zero, literal, and the two ways
    best = order.argmin(axis=0)
    return np.array([_ZERO, _LITERAL, 0, 1])[best], np.take_along_axis(order, best[None], axis=0)[0], made


def _modes(data: np.ndarray, prev: np.ndarray) -> list[int]:
    """For each channel the mode whose deltas take least, judged by a block of them."""
    out, size = [], _block_size(data.shape[1])
    block, prev = data[:size], prev[:size]
    for c in range(0, data.shape[1], 4):
        cur, before = block[:, c : c + 4], prev[:, c : c + 4]
        changed = np.ascontiguousarray(cur).view("<u4") ^ np.ascontiguousarray(before).view("<u4")
        # the rotation that leaves the fewest bytes with changing bits
        turns = [int(np.count_nonzero(np.ascontiguousarray(_rotl(changed, r).astype("<u4")).view(np.uint8))) for r in range(8)]
        tried = []
        for mode in (BYTES, SHORTS, XOR | int(np.argmin(turns)) << 4):
            rows, columns = next(_columns(_channel_deltas(cur, before, mode), size))
            tried.append((int(_chosen(columns, rows)[1].sum()), mode))
        out.append(min(tried)[1])
    return out


def encode_1(data: np.ndarray) -> bytes:
    """As encode, in version 1 of the codec."""
    n, stride = data.shape
    if stride % 4 or not 0 < stride <= 256:
        raise ValueError("a vertex has a multiple of four bytes, up to 256")
    if not n:
        return b""
    prev = np.concatenate([data[:1], data[:-1]])
    modes, out = _modes(data, prev), [bytes([HEADER_1])]
    deltas = np.concatenate([_channel_deltas(data[:, c : c + 4], prev[:, c : c + 4], modes[c // 4]) for c in range(0, stride, 4)], axis=1)
    for rows, columns in _columns(deltas, _block_size(stride)):
        controls, _, made = _chosen(columns, rows)
        firsts = _heads(controls)  # four columns to a byte
        for b in range(len(columns)):
            out.append(firsts[b].tobytes())
            for k in range(stride):
                control = controls[b, k]
                if control == _LITERAL:
                    out.append(columns[b, k].reshape(-1)[:rows].tobytes())
                elif control != _ZERO:
                    heads, cuts, body = made[control]
                    i = b * stride + k
                    out += [heads[i].tobytes(), body[cuts[i] : cuts[i + 1]].tobytes()]
    tail = data[0].tobytes() + bytes(modes)
    return b"".join(out) + b"\0" * (_TAIL - len(tail)) + tail


def _unpack(raw: bytes, at: int, bits: int) -> tuple[np.ndarray, int]:
    if bits == 0:
        return np.zeros(GROUP, dtype=np.uint8), at
    if bits == 8:
        return np.frombuffer(raw, np.uint8, GROUP, at).copy(), at + GROUP
    escape, each, out = (1 << bits) - 1, 8 // bits, np.zeros(GROUP, dtype=np.uint8)
    packed = np.frombuffer(raw, np.uint8, GROUP // each, at)
    at += GROUP // each
    for k in range(each):
        out[k::each] = packed >> (k if bits == 1 else 8 - bits * (k + 1)) & escape
    large = np.flatnonzero(out == escape)
    out[large] = np.frombuffer(raw, np.uint8, len(large), at)
    return out, at + len(large)


def decode_1(raw: bytes, n: int, stride: int) -> np.ndarray:
    if raw[0] != HEADER_1:
        raise ValueError("not version 1 of the codec")
    out, at, size = np.zeros((n, stride), dtype=np.uint8), 1, _block_size(stride)
    modes, last = raw[len(raw) - stride // 4 :], np.frombuffer(raw, np.uint8, stride, len(raw) - stride - stride // 4)
    for a in range(0, n, size):
        count = min(size, n - a)
        groups = -(-count // GROUP)
        controls, at = raw[at : at + stride // 4], at + stride // 4
        for c in range(0, stride, 4):
            d = np.zeros((groups * GROUP, 4), dtype=np.uint8)
            for k in range(4):
                control = controls[c // 4] >> (2 * k) & 3
                if control == _LITERAL:
                    d[:count, k] = np.frombuffer(raw, np.uint8, count, at)
                    at += count
                elif control != _ZERO:
                    head, at = raw[at : at + -(-groups // 4)], at + -(-groups // 4)
                    for g in range(groups):
                        d[g * GROUP : (g + 1) * GROUP, k], at = _unpack(raw, at, _WIDTHS[control][head[g // 4] >> (g % 4 * 2) & 3])
            d, mode, base = d[:count], modes[c // 4], last[c : c + 4]
            if mode & 15 == BYTES:
                step = (d >> 1) ^ (-(d & 1).astype(np.int16)).astype(np.uint8)
                rows = np.cumsum(np.concatenate([base[None], step]).astype(np.int64), axis=0)[1:].astype(np.uint8)
            elif mode & 15 == SHORTS:
                z = d.view("<u2").astype(np.int64)
                step = (z >> 1) ^ -(z & 1)
                rows = np.ascontiguousarray(np.cumsum(np.concatenate([base.copy().view("<u2")[None].astype(np.int64), step]), axis=0)[1:].astype("<u2")).view(np.uint8)
            else:
                x = _rotl(d.view("<u4"), (32 - (mode >> 4)) % 32)
                rows = np.ascontiguousarray(np.bitwise_xor.accumulate(np.concatenate([base.copy().view("<u4")[None], x]), axis=0)[1:].astype("<u4")).view(np.uint8)
            out[a : a + count, c : c + 4] = rows
        last = out[a + count - 1]
    return out

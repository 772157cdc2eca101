"""Baseline JPEG streams, as TIFF blocks hold them: eight bits, Huffman codes, any subsampling, restarts."""

from __future__ import annotations

import struct

import numpy as np

# the zigzag order of coefficients (fixed values)
ZIGZAG = (0, 1, 8, 16, 9, 2, 3, 10, 17, 24, 32, 25, 18, 11, 4, 5, 12, 19, 26, 33, 40, 48, 41, 34, 27, 20, 13, 6, 7, 14, 21, 28, 35, 42, 49, 56, 57, 50, 43, 36, 29, 22, 15, 23, 30, 37, 44, 51, 58, 59, 52, 45, 38, 31, 39, 46, 53, 60, 61, 54, 47, 55, 62, 63)

#: Rows are the basis of the cosine transform.
BASIS = np.array([[(1 / 8**0.5 if k == 0 else 0.5) * np.cos((2 * x + 1) * k * np.pi / 16) for x in range(8)] for k in range(8)])


def _codes(body: bytes) -> list[tuple[int, int, list[int]]]:
    """(class, number, length of code times 256 plus symbol for each sixteen bits) of the tables of a segment."""
    out, at = [], 0
    while at + 17 <= len(body):
        kind, many = body[at], body[at + 1 : at + 17]
        symbols = body[at + 17 : at + 17 + sum(many)]
        table, k = [], 0
        for length, n in enumerate(many, 1):
            for _ in range(n):
                table += [length << 8 | symbols[k]] * (1 << (16 - length))
                k += 1
        out.append((kind >> 4, kind & 15, table[:65536] + [0] * (65536 - len(table))))
        at += 17 + sum(many)
    return out


class _Stream:
    """What the markers say."""

    def __init__(self):
        self.quant: dict[int, np.ndarray] = {}
        self.codes: dict[tuple[int, int], list[int]] = {}
        self.size, self.parts, self.restart, self.adobe = (0, 0), [], 0, None

    def read(self, raw: bytes) -> tuple[list[tuple[int, int, int]], bytes] | None:
        """Take in tables and headers; the components and data of the scan, if there is one."""
        at = 2
        while at + 4 <= len(raw):
            if raw[at] != 0xFF:
                raise ValueError("a JPEG stream is damaged")
            mark = raw[at + 1]
            if mark == 0xFF:
                at += 1
                continue
            if mark == 0xD9:
                break
            n = struct.unpack_from(">H", raw, at + 2)[0]
            body, at = raw[at + 4 : at + 2 + n], at + 2 + n
            if mark == 0xDB:
                k = 0
                while k < len(body):
                    wide = body[k] >> 4
                    table = np.frombuffer(body, ">u2" if wide else "u1", 64, k + 1).astype(np.float64)
                    self.quant[body[k] & 15] = table
                    k += 1 + 64 * (2 if wide else 1)
            elif mark == 0xC4:
                for kind, number, table in _codes(body):
                    self.codes[kind, number] = table
            elif mark in (0xC0, 0xC1):
                bits, h, w, many = struct.unpack_from(">BHHB", body)
                if bits != 8:
                    raise ValueError("JPEG samples of eight bits are read")
                self.size = h, w
                self.parts = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(many)]
            elif 0xC2 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC):
                raise ValueError("only baseline JPEG is read")
            elif mark == 0xDD:
                self.restart = struct.unpack_from(">H", body)[0]
            elif mark == 0xEE and body[:5] == b"Adobe" and len(body) >= 12:
                self.adobe = body[11]
            elif mark == 0xDA:
                return [(body[1 + 2 * i], body[2 + 2 * i] >> 4, body[2 + 2 * i] & 15) for i in range(body[0])], raw[at:]
        return None


def _segments(data: bytes) -> list[bytes]:
    """The coded bits between restarts, without the zeros that are stuffed in."""
    end = 0
    while True:
        end = data.find(b"\xff", end)
        if end < 0 or end + 1 >= len(data):
            end = len(data)
            break
        if data[end + 1] == 0 or 0xD0 <= data[end + 1] <= 0xD7 or data[end + 1] == 0xFF:
            end += 1 if data[end + 1] == 0xFF else 2
            continue
        break
    out, start, at = [], 0, 0
    data = data[:end]
    while (at := data.find(b"\xff", at)) >= 0 and at + 1 < len(data):
        if 0xD0 <= data[at + 1] <= 0xD7:
            out.append(data[start:at])
            start = at + 2
        at += 2
    return [s.replace(b"\xff\x00", b"\xff") for s in [*out, data[start:]]]


def _coefficients(stream: _Stream, order: list, data: bytes, units: int) -> list[np.ndarray]:
    """By component, its blocks of 64 coefficients in the order in which units hold them."""
    out: list[list[list[int]]] = [[] for _ in stream.parts]
    plan = []
    for name, dc, ac in order:
        i = next(k for k, p in enumerate(stream.parts) if p[0] == name)
        plan += [(i, stream.codes[0, dc], stream.codes[1, ac])] * (stream.parts[i][1] * stream.parts[i][2] if len(order) > 1 else 1)
    segments, left = _segments(data), units
    for segment in segments:
        segment, at, held, n = segment + bytes(64), 0, 0, 0
        last = [0] * len(stream.parts)
        for _ in range(min(stream.restart or left, left)):
            for i, dc, ac in plan:
                block, k = [0] * 64, 0
                while k < 64:
                    if n < 32:
                        held = (held & ((1 << n) - 1)) << 32 | int.from_bytes(segment[at : at + 4], "big")
                        at, n = at + 4, n + 32
                    code = (ac if k else dc)[held >> (n - 16) & 0xFFFF]
                    n -= code >> 8
                    symbol = code & 255
                    size = symbol & 15
                    if not code:
                        raise ValueError("a JPEG stream is damaged")
                    if size:
                        n -= size
                        v = held >> n & ((1 << size) - 1)
                        if v < 1 << (size - 1):
                            v -= (1 << size) - 1
                    else:
                        v = 0
                    if not k:
                        last[i] += v
                        block[0] = last[i]
                        k = 1
                        continue
                    if not size and symbol != 0xF0:
                        break  # the rest is zero
                    k += symbol >> 4
                    if size and k < 64:
                        block[ZIGZAG[k]] = v
                    k += 1
                out[i].append(block)
        left -= min(stream.restart or left, left)
        if not left:
            break
    if left:
        raise ValueError("a JPEG stream is cut short")
    return [np.array(b, dtype=np.float64).reshape(-1, 64) for b in out]


def decode(raw: bytes, tables: bytes | None = None, ycc: bool = True) -> np.ndarray:
    """(rows, columns, components) of a stream; tables: another stream that has tables alone; ycc: three components are luma and chroma."""
    stream = _Stream()
    if tables:
        stream.read(tables)
    found = stream.read(raw)
    if found is None or not stream.parts:
        raise ValueError("a JPEG stream without a scan")
    order, data = found
    (h, w), wide, high = stream.size, max(p[1] for p in stream.parts), max(p[2] for p in stream.parts)
    alone = len(stream.parts) == 1
    if alone:
        stream.parts = [(stream.parts[0][0], 1, 1, stream.parts[0][3])]
        wide = high = 1
    if len(order) != len(stream.parts):
        raise ValueError("JPEG streams of one scan are read")
    across, down = -(-w // (8 * wide)), -(-h // (8 * high))
    planes = []
    undo = np.argsort(ZIGZAG)
    for (_, x, y, q), blocks in zip(stream.parts, _coefficients(stream, order, data, across * down), strict=True):
        values = (blocks * stream.quant[q][undo]).reshape(-1, 8, 8)
        pixels = np.clip(np.floor(BASIS.T @ values @ BASIS + 128.5), 0, 255)
        plane = pixels.reshape(down, across, y, x, 8, 8).transpose(0, 2, 4, 1, 3, 5).reshape(down * y * 8, across * x * 8)
        planes.append(plane.repeat(high // y, axis=0).repeat(wide // x, axis=1)[:h, :w])
    out = np.stack(planes, axis=2)
    if len(planes) == 3 and ycc and stream.adobe != 0:
        y, b, r = out[..., 0], out[..., 1] - 128, out[..., 2] - 128
        out = np.clip(np.floor(np.stack([y + 1.402 * r, y - 0.344136286 * b - 0.714136286 * r, y + 1.772 * b], axis=2) + 0.5), 0, 255)
    return out.astype(np.uint8)

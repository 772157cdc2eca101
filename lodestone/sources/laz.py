"""Compressed LAS (LAZ) of point formats 0 to 3: the arithmetic coder, its models, and the items of a point.

Chunks of points are compressed by themselves, so each is decoded by one task.  The layered compression of
formats 6 to 10 and wave packets aren't read.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass

import numpy as np

# the coder's constants, and the contexts of returns (fixed values)
_LEAST, _MOST = 1 << 24, (1 << 32) - 1
_BIT_SHIFT, _SYMBOL_SHIFT = 13, 15
POINT, GPS, RGB, BYTE = 6, 7, 8, 0
MULTI, MULTI_MINUS, UNCHANGED, FULL, TOTAL = 500, -10, 511, 512, 516
RETURN_MAP = (
    (15, 14, 13, 12, 11, 10, 9, 8),
    (14, 0, 1, 3, 6, 10, 10, 9),
    (13, 1, 2, 4, 7, 11, 11, 10),
    (12, 3, 4, 5, 8, 12, 12, 11),
    (11, 6, 7, 8, 9, 13, 13, 12),
    (10, 10, 11, 12, 13, 14, 14, 13),
    (9, 10, 11, 12, 13, 14, 15, 14),
    (8, 9, 10, 11, 12, 13, 14, 15),
)


class Bit:
    """An adaptive model of one bit."""

    __slots__ = ("zeros", "seen", "share", "cycle", "left")

    def __init__(self):
        self.zeros, self.seen, self.share, self.cycle, self.left = 1, 2, 1 << (_BIT_SHIFT - 1), 4, 4

    def told(self, bit: int) -> None:
        self.zeros += not bit
        self.left -= 1
        if not self.left:
            self.seen += self.cycle
            if self.seen > 1 << _BIT_SHIFT:
                self.seen, self.zeros = (self.seen + 1) >> 1, (self.zeros + 1) >> 1
                self.seen += self.zeros == self.seen
            self.share = self.zeros * (0x80000000 // self.seen) >> (31 - _BIT_SHIFT)
            self.cycle = self.left = min(64, 5 * self.cycle >> 2)


class Symbols:
    """An adaptive model of symbols."""

    __slots__ = ("n", "counts", "upto", "total", "cycle", "left")

    def __init__(self, n: int):
        self.n, self.counts, self.total, self.cycle = n, [1] * n, 0, n
        self._update()
        self.cycle = self.left = (n + 6) >> 1

    def _update(self) -> None:
        self.total += self.cycle
        if self.total > 1 << _SYMBOL_SHIFT:
            self.counts = [(c + 1) >> 1 for c in self.counts]
            self.total = sum(self.counts)
        scale, run, self.upto = 0x80000000 // self.total, 0, []
        for c in self.counts:
            self.upto.append(scale * run >> (31 - _SYMBOL_SHIFT))
            run += c
        self.cycle = self.left = min(5 * self.cycle >> 2, (self.n + 6) << 3)

    def told(self, symbol: int) -> None:
        self.counts[symbol] += 1
        self.left -= 1
        if not self.left:
            self._update()


class Decoder:
    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at, self.length = data + bytes(8), at + 4, _MOST
        self.value = int.from_bytes(self.data[at : at + 4], "big")

    def _widen(self) -> None:
        while self.length < _LEAST:
            self.value = (self.value << 8 | self.data[self.at]) & _MOST
            self.at += 1
            self.length = self.length << 8 & _MOST

    def bit(self, model: Bit, _: int = 0) -> int:
        x = model.share * (self.length >> _BIT_SHIFT)
        out = int(self.value >= x)
        if out:
            self.value -= x
            self.length -= x
        else:
            self.length = x
        self._widen()
        model.told(out)
        return out

    def symbol(self, model: Symbols, _: int = 0) -> int:
        each = self.length >> _SYMBOL_SHIFT
        upto, low, high, want = model.upto, 0, model.n, self.value // each
        while high - low > 1:
            mid = (low + high) >> 1
            if upto[mid] > want:
                high = mid
            else:
                low = mid
        x = upto[low] * each
        self.length = (upto[low + 1] * each if low + 1 < model.n else self.length) - x
        self.value -= x
        self._widen()
        model.told(low)
        return low

    def bits(self, n: int, _: int = 0) -> int:
        if n > 19:
            low = self.bits(16)
            return self.bits(n - 16) << 16 | low
        self.length >>= n
        out = self.value // self.length
        self.value -= self.length * out
        self._widen()
        return out


class Encoder:
    """The decoder's counterpart; its methods return what they are given, so that items are coded by one program."""

    def __init__(self):
        self.low, self.length, self.out = 0, _MOST, bytearray()

    def _carry(self, x: int) -> None:
        self.low += x
        if self.low > _MOST:
            self.low &= _MOST
            at = len(self.out) - 1
            while self.out[at] == 255:
                self.out[at] = 0
                at -= 1
            self.out[at] += 1

    def _widen(self) -> None:
        while self.length < _LEAST:
            self.out.append(self.low >> 24)
            self.low = self.low << 8 & _MOST
            self.length = self.length << 8 & _MOST

    def bit(self, model: Bit, bit: int) -> int:
        x = model.share * (self.length >> _BIT_SHIFT)
        if bit:
            self._carry(x)
            self.length -= x
        else:
            self.length = x
        self._widen()
        model.told(bit)
        return bit

    def symbol(self, model: Symbols, symbol: int) -> int:
        each = self.length >> _SYMBOL_SHIFT
        x = model.upto[symbol] * each
        self.length = (model.upto[symbol + 1] * each if symbol + 1 < model.n else self.length) - x
        self._carry(x)
        self._widen()
        model.told(symbol)
        return symbol

    def bits(self, n: int, value: int) -> int:
        if n > 19:
            self.bits(16, value & 0xFFFF)
            self.bits(n - 16, value >> 16)
            return value
        self.length >>= n
        self._carry(value * self.length)
        self._widen()
        return value

    def done(self) -> bytes:
        if self.length > 2 * _LEAST:
            self._carry(_LEAST)
            self.length = _LEAST >> 1
        else:
            self._carry(_LEAST >> 1)
            self.length = _LEAST >> 9
        self._widen()
        return bytes(self.out) + bytes(2)


def _signed(x: int, bits: int = 32) -> int:
    x &= (1 << bits) - 1
    return x - (1 << bits) if x >> (bits - 1) else x


class Integers:
    """Numbers of so many bits as corrections of predictions; ``k`` is the size of the last correction."""

    def __init__(self, bits: int, contexts: int = 1, high: int = 8):
        self.bits, self.high, self.k = bits, high, 0
        self.sizes = [Symbols(bits + 1) for _ in range(contexts)]
        self.sign, self.parts = Bit(), [Symbols(1 << min(i, high)) for i in range(1, bits + 1)]

    def code(self, coder, predicted: int, context: int = 0, real: int = 0) -> int:
        """The number; ``real`` is it where it is encoded."""
        c = k = 0
        encodes = isinstance(coder, Encoder)
        if encodes:
            c = _signed(real - predicted, self.bits)
            k = (c - 1 if c > 0 else -c).bit_length()
        k = self.k = coder.symbol(self.sizes[context], k)
        if not k:
            c = coder.bit(self.sign, c)
        elif k < 32:
            if encodes:
                c = c + (1 << k) - 1 if c < 0 else c - 1
            more = max(0, k - self.high)
            top = coder.symbol(self.parts[k - 1], c >> more)
            c = top << more | (coder.bits(more, c & ((1 << more) - 1)) if more else 0)
            c = c + 1 if c >= 1 << (k - 1) else c - (1 << k) + 1
        else:
            c = -(1 << 31)
        out = predicted + c
        return _signed(out) if self.bits == 32 else out & ((1 << self.bits) - 1)


class Median:
    """A running median of five."""

    def __init__(self):
        self.v, self.high = [0] * 5, True

    def add(self, x: int) -> None:
        v = self.v
        if self.high:
            if x < v[2]:
                v[4], v[3] = v[3], v[2]
                if x < v[0]:
                    v[2], v[1], v[0] = v[1], v[0], x
                elif x < v[1]:
                    v[2], v[1] = v[1], x
                else:
                    v[2] = x
            else:
                if x < v[3]:
                    v[4], v[3] = v[3], x
                else:
                    v[4] = x
                self.high = False
        elif v[2] < x:
            v[0], v[1] = v[1], v[2]
            if v[4] < x:
                v[2], v[3], v[4] = v[3], v[4], x
            elif v[3] < x:
                v[2], v[3] = v[3], x
            else:
                v[2] = x
        else:
            if v[1] < x:
                v[0], v[1] = v[1], x
            else:
                v[0] = x
            self.high = True


class PointItem:
    """Twenty bytes: x, y, z, intensity, returns and flags, class, angle, user data, source."""

    size = 20

    def __init__(self, first: bytes):
        self.last = list(struct.unpack("<iiiHBBBBH", first))
        self.changed = Symbols(64)
        self.intensity, self.source = Integers(16, 4), Integers(16)
        self.angle = [Symbols(256), Symbols(256)]
        self.bytes: dict[tuple[int, int], Symbols] = {}
        self.dx, self.dy, self.z = Integers(32, 2), Integers(32, 22), Integers(32, 20)
        self.medians = [[Median() for _ in range(16)] for _ in "xy"]
        self.intensities, self.heights = [0] * 16, [0] * 8
        self.last[3] = 0

    def _byte(self, field: int) -> Symbols:
        key = field, self.last[field]
        if key not in self.bytes:
            self.bytes[key] = Symbols(256)
        return self.bytes[key]

    def code(self, coder, raw: bytes | None = None) -> bytes:
        last, new = self.last, list(struct.unpack("<iiiHBBBBH", raw)) if raw else [0] * 9
        mask = 0
        if raw:
            n, r = new[4] >> 3 & 7, new[4] & 7
            m = RETURN_MAP[n][r]
            mask = (new[4] != last[4]) << 5 | (new[3] != self.intensities[m]) << 4 | (new[5] != last[5]) << 3 | (new[6] != last[6]) << 2 | (new[7] != last[7]) << 1 | (new[8] != last[8])
        mask = coder.symbol(self.changed, mask)
        if mask & 32:
            last[4] = coder.symbol(self._byte(4), new[4])
        n, r = last[4] >> 3 & 7, last[4] & 7
        m, level = RETURN_MAP[n][r], abs(n - r)
        if mask & 16:
            self.intensities[m] = self.intensity.code(coder, self.intensities[m], min(m, 3), new[3])
        last[3] = self.intensities[m]
        if mask & 8:
            last[5] = coder.symbol(self._byte(5), new[5])
        if mask & 4:
            last[6] = last[6] + coder.symbol(self.angle[last[4] >> 6 & 1], new[6] - last[6] & 255) & 255
        if mask & 2:
            last[7] = coder.symbol(self._byte(7), new[7])
        if mask & 1:
            last[8] = self.source.code(coder, last[8], 0, new[8])
        alone = int(n == 1)
        for axis, integers in enumerate((self.dx, self.dy)):
            median = self.medians[axis][m]
            context = alone if not axis else alone + (self.dx.k & ~1 if self.dx.k < 20 else 20)
            diff = integers.code(coder, median.v[2], context, _signed(new[axis] - last[axis]))
            last[axis] = _signed(last[axis] + diff)
            median.add(diff)
        k = (self.dx.k + self.dy.k) // 2
        last[2] = self.heights[level] = self.z.code(coder, self.heights[level], alone + (k & ~1 if k < 18 else 18), new[2])
        return struct.pack("<iiiHBBBBH", *last)


class GpsItem:
    """A double as a 64-bit integer, by the differences of up to four interleaved sequences."""

    size = 8

    def __init__(self, first: bytes):
        self.which = self.next = 0
        self.time, self.diff, self.extreme = [struct.unpack("<q", first)[0], 0, 0, 0], [0] * 4, [0] * 4
        self.multi, self.none, self.numbers = Symbols(TOTAL), Symbols(6), Integers(32, 9)

    def _full(self, coder, real: int) -> None:
        high = _signed(self.time[self.which] >> 32)
        self.next = self.next + 1 & 3
        top = self.numbers.code(coder, high, 8, _signed(real >> 32))
        low = coder.bits(16, real & 0xFFFF)
        low |= coder.bits(16, real >> 16 & 0xFFFF) << 16
        self.which = self.next
        self.time[self.which], self.diff[self.which], self.extreme[self.which] = _signed(top << 32 | low, 64), 0, 0

    def code(self, coder, raw: bytes | None = None) -> bytes:
        encodes, real = raw is not None, struct.unpack("<q", raw)[0] if raw else 0
        i = self.which
        step = real - self.time[i]
        fits = -(1 << 31) <= step < 1 << 31
        if not self.diff[i]:
            multi = coder.symbol(self.none, 0 if encodes and not step else 1 if encodes and fits else 2)
            if multi == 1:
                self.diff[i] = self.numbers.code(coder, 0, 0, step)
                self.time[i], self.extreme[i] = _signed(self.time[i] + self.diff[i], 64), 0
            elif multi == 2:
                self._full(coder, real)
            elif multi > 2:
                self.which = i + multi - 2 & 3
                return self.code(coder)
            return struct.pack("<q", self.time[self.which])
        multi = UNCHANGED
        if encodes and step:
            near = round(step / self.diff[i]) if fits else 0
            multi = FULL if not fits else 1 if near == 1 else 0 if not near else near if 0 < near < MULTI else MULTI if near >= MULTI else MULTI - max(near, MULTI_MINUS)
        multi = coder.symbol(self.multi, multi)
        if multi == 1:
            self.time[i] = _signed(self.time[i] + self.numbers.code(coder, self.diff[i], 1, step), 64)
            self.extreme[i] = 0
        elif multi < UNCHANGED:
            times = multi if multi <= MULTI else MULTI - multi
            context = 7 if not multi else 2 if multi < 10 and multi < MULTI else 3 if multi < MULTI else 4 if multi == MULTI else 5 if times > MULTI_MINUS else 6
            diff = self.numbers.code(coder, _signed(times * self.diff[i]), context, step)
            if context in (4, 6, 7):
                self.extreme[i] += 1
                if self.extreme[i] > 3:
                    self.diff[i], self.extreme[i] = diff, 0
            self.time[i] = _signed(self.time[i] + diff, 64)
        elif multi == FULL:
            self._full(coder, real)
        elif multi > FULL:
            self.which = i + multi - FULL & 3
            return self.code(coder)
        return struct.pack("<q", self.time[self.which])


def _clamp(x: int) -> int:
    return 0 if x < 0 else 255 if x > 255 else x


class RgbItem:
    """Three colours of sixteen bits, byte by byte; green and blue follow red."""

    size = 6

    def __init__(self, first: bytes):
        self.last = list(first)
        self.used, self.parts = Symbols(128), [Symbols(256) for _ in range(6)]

    def code(self, coder, raw: bytes | None = None) -> bytes:
        last, new, out = self.last, list(raw) if raw else [0] * 6, list(self.last)
        mask = 0
        if raw:
            mask = sum((new[j] != last[j]) << j for j in range(6)) | (new[0:2] != new[2:4] or new[0:2] != new[4:6]) << 6
        mask = coder.symbol(self.used, mask)

        def byte(j: int, predicted: int) -> None:
            if mask >> j & 1:
                out[j] = predicted + coder.symbol(self.parts[j], new[j] - predicted & 255) & 255

        byte(0, last[0])
        byte(1, last[1])
        if mask & 64:
            for j in (0, 1):
                d = out[j] - last[j]
                byte(2 + j, _clamp(d + last[2 + j]))
                d = int((d + out[2 + j] - last[2 + j]) / 2)
                byte(4 + j, _clamp(d + last[4 + j]))
        else:
            out[2:4] = out[4:6] = out[0:2]
        self.last = out
        return bytes(out)


class ByteItem:
    """Extra bytes, each by the difference from the one before."""

    def __init__(self, first: bytes):
        self.size, self.last, self.parts = len(first), list(first), [Symbols(256) for _ in first]

    def code(self, coder, raw: bytes | None = None) -> bytes:
        for j, model in enumerate(self.parts):
            self.last[j] = self.last[j] + coder.symbol(model, raw[j] - self.last[j] & 255 if raw else 0) & 255
        return bytes(self.last)


ITEMS = {POINT: PointItem, GPS: GpsItem, RGB: RgbItem, BYTE: ByteItem}


@dataclass
class Packing:
    """What the LASzip record says."""

    chunk: int
    items: list[tuple[int, int]]  # type, size

    @classmethod
    def of(cls, body: bytes) -> Packing:
        kind, coder = struct.unpack_from("<HH", body)
        chunk, n = struct.unpack_from("<I", body, 12)[0], struct.unpack_from("<H", body, 32)[0]
        items = [struct.unpack_from("<HHH", body, 34 + 6 * i) for i in range(n)]
        if kind != 2 or coder or any(t not in ITEMS or v not in (2, 0) for t, _, v in items):
            raise ValueError("only chunked LAZ of point formats 0 to 3 is read")
        return cls(chunk, [(t, s) for t, s, _ in items])

    def body(self) -> bytes:
        return struct.pack("<HHBBHIIqqH", 2, 0, 2, 2, 0, 0, self.chunk, -1, -1, len(self.items)) + b"".join(struct.pack("<HHH", t, s, 2) for t, s in self.items)


def chunks(read, offset: int, size: int, count: int, packing: Packing) -> list[tuple[int, int, int, int]]:
    """(first point, points, place, bytes) of each chunk."""
    table = struct.unpack("<q", read(offset, 8))[0]
    if table == -1:
        table = struct.unpack("<q", read(size - 8, 8))[0]
    if not offset < table <= size - 8:
        raise ValueError("the LAZ file has no chunk table")
    version, n = struct.unpack("<II", read(table, 8))
    if version:
        raise ValueError("the LAZ file's chunk table is of an unknown kind")
    coder, numbers = Decoder(read(table + 8, size - table - 8)), Integers(32, 2)
    out, place, first, points, length = [], offset + 8, 0, 0, 0
    for _ in range(n):
        points = numbers.code(coder, points, 0) if packing.chunk == _MOST else packing.chunk
        length = numbers.code(coder, length, 1)
        here = min(points, count - first)
        out.append((first, here, place, length))
        first, place = first + here, place + length
    if first < count:
        raise ValueError("the LAZ file is cut short")
    return out


def decoded(raw: bytes, points: int, packing: Packing) -> bytes:
    """The records of a chunk."""
    at, items, out = 0, [], []
    for kind, size in packing.items:
        items.append(ITEMS[kind](raw[at : at + size]))
        at += size
    out.append(raw[:at])
    coder = Decoder(raw, at)
    for _ in range(points - 1):
        for item in items:
            out.append(item.code(coder))
    return b"".join(out)


def encoded(records: bytes, packing: Packing) -> bytes:
    """A chunk of records."""
    size = sum(s for _, s in packing.items)
    cuts = np.cumsum([0] + [s for _, s in packing.items]).tolist()
    items = [ITEMS[k](records[a:b]) for (k, _), a, b in zip(packing.items, cuts, cuts[1:], strict=False)]
    coder = Encoder()
    for p in range(size, len(records), size):
        for item, a, b in zip(items, cuts, cuts[1:], strict=False):
            item.code(coder, records[p + a : p + b])
    return records[:size] + coder.done()


def items_of(form: int, length: int) -> list[tuple[int, int]]:
    """The items of a record: the point format's, and its extra bytes."""
    out = [(POINT, 20)] + [(GPS, 8)] * (form in (1, 3)) + [(RGB, 6)] * (form in (2, 3))
    extra = length - sum(s for _, s in out)
    return out + [(BYTE, extra)] * (extra > 0)


def packed(records: bytes, packing: Packing, offset: int) -> bytes:
    """Point data for a file in which it begins at ``offset``: the table's place, the chunks, and the table."""
    size = sum(s for _, s in packing.items)
    made = [encoded(records[a : a + packing.chunk * size], packing) for a in range(0, len(records), packing.chunk * size)]
    coder, numbers, last = Encoder(), Integers(32, 2), 0
    for c in made:
        last = numbers.code(coder, last, 1, len(c))
    return struct.pack("<q", offset + 8 + sum(map(len, made))) + b"".join(made) + struct.pack("<II", 0, len(made)) + coder.done()

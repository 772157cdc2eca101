"""Point clouds as LAS, PLY and E57 files, and grids as TIFF files."""

from __future__ import annotations

import lzma
import math
import struct
import zlib

import numpy as np

from ..model import NUMPY_TYPES
from ..sources import laz
from ..sources.las import EXTRA_TYPES, FORMATS

# ---------------------------------------------------------------- LAS

Extra = tuple[str, str, float | None, float | None]  # name, type, scale, offset


def las_records(form: int, n: int, extra: list[Extra] = []) -> np.ndarray:  # noqa: B006
    """Empty records of a point format, with fields ``extra:name`` behind it."""
    return np.zeros(n, np.dtype([*FORMATS[form], *((f"extra:{name}", NUMPY_TYPES[kind]) for name, kind, *_ in extra)]))


def las_file(form: int, records: np.ndarray, scale: float = 0.01, shift: tuple[float, float, float] = (0.0, 0.0, 0.0), extra: list[Extra] = [], epsg: int | None = None, chunk: int | None = None) -> bytes:  # noqa: B006
    """chunk: points of a compressed chunk; without it nothing is compressed."""
    vlrs = []

    def vlr(user: bytes, record: int, body: bytes) -> None:
        vlrs.append(struct.pack("<H16sHH32s", 0, user, record, len(body), b"") + body)

    if epsg:
        vlr(b"LASF_Projection", 34735, struct.pack("<12H", 1, 1, 0, 2, 1024, 0, 1, 1, 3072, 0, 1, epsg))
    if extra:
        codes = {t: k for k, t in EXTRA_TYPES.items()}
        body = b""
        for name, kind, factor, offset in extra:
            d = bytearray(192)
            d[2], d[3] = codes[kind], 8 * (factor is not None) + 16 * (offset is not None)
            d[4 : 4 + len(name.encode())] = name.encode()
            struct.pack_into("<d", d, 112, factor or 0.0)
            struct.pack_into("<d", d, 136, offset or 0.0)
            body += bytes(d)
        vlr(b"LASF_Spec", 4, body)
    packing = laz.Packing(chunk, laz.items_of(form, records.dtype.itemsize)) if chunk else None
    if packing:
        vlr(b"laszip encoded", 22204, packing.body())
    body, long = b"".join(vlrs), form >= 6
    size = 375 if long else 227
    head = bytearray(size)
    head[:4], head[24], head[25] = b"LASF", 1, 4 if long else 2
    struct.pack_into("<HIIBHI", head, 94, size, size + len(body), len(vlrs), form | 0x80 * bool(packing), records.dtype.itemsize, 0 if long else len(records))
    struct.pack_into("<6d", head, 131, scale, scale, scale, *shift)
    if long:
        struct.pack_into("<Q", head, 247, len(records))
    return bytes(head) + body + (laz.packed(records.tobytes(), packing, size + len(body)) if packing else records.tobytes())


# ---------------------------------------------------------------- PLY

_PLY = {"int8": "char", "uint8": "uchar", "int16": "short", "uint16": "ushort", "int32": "int", "uint32": "uint", "float32": "float", "float64": "double"}


def ply_file(form: str, properties: dict[str, tuple[str, np.ndarray]]) -> bytes:
    """Vertices; properties: (type, values) by name; form: ascii, binary_little_endian or binary_big_endian."""
    n = len(next(iter(properties.values()))[1])
    head = "\n".join(["ply", f"format {form} 1.0", f"element vertex {n}", *(f"property {_PLY[t]} {name}" for name, (t, _) in properties.items()), "end_header\n"]).encode()
    if form == "ascii":
        columns = [[repr(x) for x in v.astype(NUMPY_TYPES[t]).tolist()] for t, v in properties.values()]
        return head + "".join(" ".join(row) + "\n" for row in zip(*columns, strict=True)).encode()
    order = "<" if "little" in form else ">"
    out = np.zeros(n, np.dtype([(name, NUMPY_TYPES[t].replace("<", order)) for name, (t, _) in properties.items()]))
    for name, (_, v) in properties.items():
        out[name] = v
    return head + out.tobytes()


# ---------------------------------------------------------------- E57

_PAGE = 1024
_PACKET = 32_000  # bytes of all streams of a packet


def e57_integers(name: str, values: np.ndarray, low: int, high: int, scale: float | None = None) -> tuple[str, bytes]:
    """A field of integers of a range, or of such numbers times a scale, packed bit by bit."""
    bits = (high - low).bit_length()
    raw = np.zeros(len(values) * bits, dtype=np.uint8)
    for k in range(bits):
        raw[k::bits] = (values - low) >> k & 1
    kind = f'type="ScaledInteger" scale="{scale!r}" offset="0"' if scale else 'type="Integer"'
    return f'<{name} {kind} minimum="{low}" maximum="{high}"/>', np.packbits(raw, bitorder="little").tobytes()


def e57_floats(name: str, values: np.ndarray, single: bool = False) -> tuple[str, bytes]:
    return f'<{name} type="Float"{" precision=" + chr(34) + "single" + chr(34) if single else ""}/>', values.astype("<f4" if single else "<f8").tobytes()


def e57_pose(turn: float, move: tuple[float, float, float]) -> str:
    """A rotation about z by so many radians, and a translation."""
    value = lambda n, v: f'<{n} type="Float">{v!r}</{n}>'
    rotation = "".join(value(n, v) for n, v in zip("wxyz", (math.cos(turn / 2), 0.0, 0.0, math.sin(turn / 2)), strict=True))
    return f'<pose type="Structure"><rotation type="Structure">{rotation}</rotation><translation type="Structure">{"".join(value(n, v) for n, v in zip("xyz", move, strict=True))}</translation></pose>'


def e57_file(scans: list[tuple[list[tuple[str, bytes]], int, str]]) -> bytes:
    """scans: (fields as XML and packed bytes, number of records, more XML of the scan); checksums of pages are left empty."""
    body, described = bytearray(48), ""
    physical = lambda at: at + 4 * (at // (_PAGE - 4))
    for fields, count, more in scans:
        body += b"\0" * (-len(body) % 4)
        start, packets, streams = len(body), bytearray(), [raw for _, raw in fields]
        cuts = max(1, -(-sum(map(len, streams)) // _PACKET))
        for k in range(cuts):
            part = [s[len(s) * k // cuts : len(s) * (k + 1) // cuts] for s in streams]
            inner = b"".join(struct.pack("<H", len(p)) for p in part) + b"".join(part)
            n = 6 + len(inner)
            n += -n % 4
            packets += (struct.pack("<BBHH", 1, 0, n - 1, len(part)) + inner).ljust(n, b"\0")
        body += struct.pack("<B7xQQQ", 1, 32 + len(packets), physical(start + 32), 0) + packets
        described += f'<vectorChild type="Structure"><points type="CompressedVector" fileOffset="{physical(start)}" recordCount="{count}"><prototype type="Structure">{"".join(x for x, _ in fields)}</prototype></points>{more}</vectorChild>'
    xml = f'<?xml version="1.0"?><e57Root type="Structure" xmlns="http://www.astm.org/COMMIT/E57/2010-e57-v1.0"><data3D type="Vector">{described}</data3D></e57Root>'.encode()
    at = len(body)
    body += xml
    pages = -(-len(body) // (_PAGE - 4))
    body[:48] = struct.pack("<8sIIQQQQ", b"ASTM-E57", 1, 0, pages * _PAGE, physical(at), len(xml), _PAGE)
    return b"".join(bytes(body[k : k + _PAGE - 4]).ljust(_PAGE - 4, b"\0") + b"\0\0\0\0" for k in range(0, len(body), _PAGE - 4))


# ---------------------------------------------------------------- TIFF


def _packbits(raw: bytes) -> bytes:
    return b"".join(bytes([len(raw[i : i + 128]) - 1]) + raw[i : i + 128] for i in range(0, len(raw), 128)) + b"\x80"


CODECS = {1: bytes, 8: zlib.compress, 32773: _packbits, 34925: lzma.compress}


def tiff_file(data: np.ndarray, origin: tuple[float, float], cell: float, epsg: int, codec: int = 1, predictor: int = 1, tile: int | None = None, nodata: str | None = None, palette: np.ndarray | None = None, metadata: str | None = None) -> bytes:
    """A GeoTIFF of (rows, columns, bands); origin: the upper left corner; palette: (3, entries) of sixteen bits."""
    h, w, bands = data.shape
    d, blocks = data.dtype, []
    bw, bh = (tile, tile) if tile else (w, 16)
    for r in range(0, h, bh):
        for c in range(0, w, bw):
            part = data[r : r + bh, c : c + bw]
            if tile:
                part = np.pad(part, ((0, bh - part.shape[0]), (0, bw - part.shape[1]), (0, 0)))
            if predictor == 2:
                u = np.ascontiguousarray(part).view(f"u{d.itemsize}")
                part = np.concatenate([u[:, :1], u[:, 1:] - u[:, :-1]], axis=1).astype(u.dtype)
            blocks.append(CODECS[codec](np.ascontiguousarray(part).tobytes()))
    shape = {"u": 1, "i": 2, "f": 3}[d.kind]
    tags: dict[int, tuple[str, list]] = {256: ("I", [w]), 257: ("I", [h]), 258: ("H", [8 * d.itemsize] * bands), 259: ("H", [codec]), 262: ("H", [3 if palette is not None else 2 if bands >= 3 else 1]), 277: ("H", [bands]), 284: ("H", [1]), 317: ("H", [predictor]), 339: ("H", [shape] * bands)}
    tags |= {322: ("I", [bw]), 323: ("I", [bh])} if tile else {278: ("I", [bh])}
    tags |= {33550: ("d", [cell, cell, 0.0]), 33922: ("d", [0, 0, 0, *origin, 0]), 34735: ("H", [1, 1, 0, 2, 1025, 0, 1, 1, 3072, 0, 1, epsg])}
    if palette is not None:
        tags[320] = ("H", palette.reshape(-1).tolist())
    for tag, text in ((42113, nodata), (42112, metadata)):
        if text is not None:
            tags[tag] = ("s", [text.encode() + b"\0"])
    places, body = [], b""
    for b in blocks:
        places.append(8 + len(body))
        body += b + b"\0" * (len(b) % 2)
    tags |= {(324 if tile else 273): ("I", places), (325 if tile else 279): ("I", [len(b) for b in blocks])}
    start, entries, extra = 8 + len(body), b"", b""
    behind = start + 2 + 12 * len(tags) + 4
    for tag in sorted(tags):
        kind, values = tags[tag]
        raw = values[0] if kind == "s" else struct.pack(f"<{len(values)}{kind}", *values)
        value = raw.ljust(4, b"\0") if len(raw) <= 4 else struct.pack("<I", behind + len(extra))
        extra += raw + b"\0" * (len(raw) % 2) if len(raw) > 4 else b""
        entries += struct.pack("<HHI", tag, {"H": 3, "I": 4, "d": 12, "s": 2}[kind], len(raw) if kind == "s" else len(values)) + value
    return struct.pack("<2sHI", b"II", 42, start) + body + struct.pack("<H", len(tags)) + entries + struct.pack("<I", 0) + extra

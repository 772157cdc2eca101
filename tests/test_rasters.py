"""GeoTIFF and E57 files that are made here byte by byte."""

import lzma
import math
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.functions import crs, frames
from lodestone.sources import e57, geotiff


def lzw_encode(raw):
    """TIFF's LZW, plainly."""
    table, width, out, prev = {bytes([i]): i for i in range(256)}, 9, [(256, 9)], b""
    for byte in raw:
        entry = prev + bytes([byte])
        if entry in table:
            prev = entry
            continue
        out.append((table[prev], width))
        table[entry] = len(table) + 2
        n = len(table) + 2
        width = 9 if n < 512 else 10 if n < 1024 else 11 if n < 2048 else 12
        if n >= 4094:
            out.append((256, width))
            table, width = {bytes([i]): i for i in range(256)}, 9
        prev = bytes([byte])
    if prev:
        out.append((table[prev], width))
        n = len(table) + 3
        width = 9 if n < 512 else 10 if n < 1024 else 11 if n < 2048 else 12
    out.append((257, width))
    bits = "".join(format(c, f"0{w}b") for c, w in out)
    bits += "0" * (-len(bits) % 8)
    return int(bits, 2).to_bytes(len(bits) // 8, "big")


def packbits_encode(raw):
    out = b""
    for i in range(0, len(raw), 100):
        part = raw[i : i + 100]
        out += bytes([len(part) - 1]) + part
    return out + b"\x80"


def packed(raw, codec):
    import zstandard

    return {1: bytes, 8: zlib.compress, 34925: lzma.compress, 50000: zstandard.ZstdCompressor().compress, 5: lzw_encode, 32773: packbits_encode}[codec](raw)


def write_tiff(path, data, codec=1, tile=None, planar=1, predictor=1, order="<", big=False, geo=True, nodata=None, point=False):
    h, w, bands = data.shape
    d = data.dtype.newbyteorder(order)
    bw, bh = tile or (w, 7)
    blocks = []
    for p in range(bands if planar == 2 else 1):
        layer = data[:, :, p : p + 1] if planar == 2 else data
        for r in range(0, h, bh):
            for c in range(0, w, bw):
                part = layer[r : r + bh, c : c + bw]
                if tile:
                    part = np.pad(part, ((0, bh - part.shape[0]), (0, bw - part.shape[1]), (0, 0)))
                if predictor == 2:
                    u = part.view(f"u{d.itemsize}")
                    part = np.concatenate([u[:, :1], (u[:, 1:] - u[:, :-1])], axis=1).astype(f"u{d.itemsize}").view(part.dtype)
                raw = part.astype(d).tobytes()
                if predictor == 3:
                    n, m = part.shape[0], part.shape[1] * part.shape[2]
                    b = part.astype(d.newbyteorder(">")).view("u1").reshape(n, m, d.itemsize).transpose(0, 2, 1).reshape(n, -1, part.shape[2])
                    raw = np.concatenate([b[:, :1], b[:, 1:] - b[:, :-1]], axis=1).astype("u1").tobytes()
                blocks.append(packed(raw, codec))
    tags = {256: ("I", [w]), 257: ("I", [h]), 258: ("H", [8 * d.itemsize] * bands), 259: ("H", [codec]), 262: ("H", [2 if bands >= 3 else 1]), 277: ("H", [bands]), 284: ("H", [planar]), 317: ("H", [predictor]), 339: ("H", [{"u": 1, "i": 2, "f": 3}[d.kind]] * bands)}
    if tile:
        tags |= {322: ("I", [bw]), 323: ("I", [bh])}
    else:
        tags[278] = ("I", [bh])
    if geo:
        tags |= {33550: ("d", [2.0, 2.0, 0.0]), 33922: ("d", [0, 0, 0, 1000.0, 2000.0, 0]), 34735: ("H", [1, 1, 0, 2, 1025, 0, 1, 2 if point else 1, 3072, 0, 1, 32633])}
    if nodata is not None:
        tags[42113] = ("s", [str(nodata).encode() + b"\0"])
    kinds = {"H": 3, "I": 4, "d": 12, "s": 2}
    head_size, place = (16 if big else 8), None
    body, places = b"", []
    for b in blocks:
        places.append(head_size + len(body))
        body += b
    at, size = (324, 325) if tile else (273, 279)
    tags |= {at: ("I", places), size: ("I", [len(b) for b in blocks])}
    place = head_size + len(body)
    entries, extra, n = b"", b"", len(tags)
    slot = 8 if big else 4
    ifd = (8 if big else 2) + n * (20 if big else 12) + (8 if big else 4)
    for tag in sorted(tags):
        kind, values = tags[tag]
        raw = values[0] if kind == "s" else struct.pack(f"{order}{len(values)}{kind}", *values)
        count = len(raw) if kind == "s" else len(values)
        if len(raw) <= slot:
            value = raw.ljust(slot, b"\0")
        else:
            value = struct.pack(f"{order}{'Q' if big else 'I'}", place + ifd + len(extra))
            extra += raw
        entries += struct.pack(f"{order}HH{'Q' if big else 'I'}", tag, kinds[kind], count) + value
    head = (b"II" if order == "<" else b"MM") + (struct.pack(f"{order}HHHQ", 43, 8, 0, place) if big else struct.pack(f"{order}HI", 42, place))
    path.write_bytes(head + body + struct.pack(f"{order}{'Q' if big else 'H'}", n) + entries + struct.pack(f"{order}{'Q' if big else 'I'}", 0) + extra)
    return str(path)


def cells(df, shape):
    got = df.toPandas()
    out = np.full(shape, np.nan)
    for b in range(shape[2]):
        out[got.row, got.col, b] = got[f"band_{b + 1}"]
    return out


@pytest.mark.parametrize("kind", [{}, {"codec": 8}, {"codec": 50000, "tile": (16, 16)}, {"codec": 34925, "planar": 2}, {"codec": 5, "predictor": 2}, {"codec": 32773, "order": ">"}, {"codec": 8, "tile": (16, 16), "planar": 2, "big": True, "order": ">", "predictor": 2}])
def test_tiff_blocks(spark, tmp_path, kind):
    data = np.random.default_rng(1).integers(0, 256, (33, 41, 3)).astype(np.uint8)
    path = write_tiff(tmp_path / "a.tif", data, **kind)
    assert (cells(geotiff.read_bands(spark, path), data.shape) == data).all()
    g = geotiff.georeference(path)
    assert g.affine == (1000, 2, 0, 2000, 0, -2) and g.crs == "EPSG:32633" and g.area


def jpeg_encode(data, factors, restart=0, tables=True, scale=1):
    """A baseline stream of (rows, columns, components) whose codes all have four bits (DC) or eight (AC)."""
    from lodestone.sources.jpeg import BASIS, ZIGZAG

    h, w, many = data.shape
    wide, high = max(x for x, _ in factors), max(y for _, y in factors)
    seg = lambda mark, body: bytes([0xFF, mark]) + struct.pack(">H", len(body) + 2) + body
    ac = [r << 4 | s for r in range(16) for s in range(1, 11)] + [0, 0xF0]
    heads = seg(0xDB, b"\0" + bytes([scale] * 64)) + seg(0xC4, b"\0" + bytes([0, 0, 0, 12, *[0] * 12]) + bytes(range(12))) + seg(0xC4, b"\x10" + bytes([0] * 7 + [len(ac)] + [0] * 8) + bytes(ac))
    across, down = -(-w // (8 * wide)), -(-h // (8 * high))
    planes = []
    for c, (x, y) in enumerate(factors):
        full = np.pad(data[..., c].astype(float), ((0, down * 8 * high - h), (0, across * 8 * wide - w)), mode="edge")
        planes.append(full.reshape(down * 8 * y, high // y, across * 8 * x, wide // x).mean(axis=(1, 3)) - 128)
    size = lambda v: abs(v).bit_length()
    extra = lambda v: format(v if v > 0 else v + (1 << size(v)) - 1, f"0{size(v)}b") if v else ""
    segments, bits, last, done = [], "", [0] * many, 0

    def close():
        nonlocal bits, last
        raw = bits + "1" * (-len(bits) % 8)
        segments.append(int("1" + raw, 2).to_bytes(len(raw) // 8 + 1, "big")[1:].replace(b"\xff", b"\xff\0"))
        bits, last = "", [0] * many

    for u in range(across * down):
        for c, (x, y) in enumerate(factors):
            for j in range(y):
                for i in range(x):
                    r, k = (u // across * y + j) * 8, (u % across * x + i) * 8
                    f = np.round(BASIS @ planes[c][r : r + 8, k : k + 8] @ BASIS.T / scale).astype(int).reshape(-1)[list(ZIGZAG)].tolist()
                    d, last[c] = f[0] - last[c], f[0]
                    bits += format(size(d), "04b") + extra(d)
                    run = 0
                    for v in f[1:]:
                        if not v:
                            run += 1
                            continue
                        while run > 15:
                            bits += format(ac.index(0xF0), "08b")
                            run -= 16
                        bits += format(ac.index(run << 4 | size(v)), "08b") + extra(v)
                        run = 0
                    if run:
                        bits += format(ac.index(0), "08b")
        done += 1
        if restart and done % restart == 0 and done < across * down:
            close()
    close()
    body = segments[0] + b"".join(bytes([0xFF, 0xD0 + i % 8]) + s for i, s in enumerate(segments[1:]))
    frame = seg(0xC0, struct.pack(">BHHB", 8, h, w, many) + b"".join(bytes([c + 1, x << 4 | y, 0]) for c, (x, y) in enumerate(factors)))
    start = seg(0xDA, bytes([many, *(v for c in range(many) for v in (c + 1, 0)), 0, 63, 0]))
    stream = b"\xff\xd8" + (heads if tables else b"") + frame + (seg(0xDD, struct.pack(">H", restart)) if restart else b"") + start + body + b"\xff\xd9"
    return stream, b"\xff\xd8" + heads + b"\xff\xd9"


@pytest.mark.parametrize("many,factors,restart", [(1, [(1, 1)], 0), (1, [(2, 2)], 3), (3, [(1, 1)] * 3, 0), (3, [(2, 2), (1, 1), (1, 1)], 2), (3, [(2, 1), (1, 1), (1, 1)], 0)])
def test_jpeg_streams(many, factors, restart):
    from lodestone.sources import jpeg

    y, x = np.mgrid[0:37, 0:53]
    data = np.stack([(x * 3 + y * 2 + 40 * c) % 256 if c == 0 else 128 + 40 * np.sin(x / 9 + c) * np.cos(y / 7) for c in range(many)], axis=2)
    one = [(1, 1)] if many == 1 else factors  # a scan of one component has no subsampling
    stream, tables = jpeg_encode(data, one, restart)
    if many == 1 and factors != one:
        stream = stream.replace(struct.pack(">BHHB", 8, 37, 53, 1) + b"\x01\x11", struct.pack(">BHHB", 8, 37, 53, 1) + b"\x01\x22")
    got = jpeg.decode(stream, ycc=False).astype(float)
    assert got.shape == data.shape and np.abs(got[..., 0] - data[..., 0]).max() <= 2
    if many == 3:
        assert np.abs(got - data).max() <= (2 if factors[0] == (1, 1) else 12)
        grey = jpeg.decode(jpeg_encode(np.stack([data[..., 0], 0 * y + 128, 0 * y + 128], axis=2), factors)[0])
        assert np.abs(grey.astype(float) - data[..., :1]).max() <= 3
    bare, tables = jpeg_encode(data, one, restart, tables=False, scale=2)
    assert np.abs(jpeg.decode(bare, tables, ycc=False)[..., 0] - data[..., 0]).max() <= 6
    with pytest.raises(ValueError):
        jpeg.decode(stream[:60])
    with pytest.raises(ValueError, match="baseline"):
        jpeg.decode(stream.replace(b"\xff\xc0", b"\xff\xc2"))


def test_tiff_blocks_of_jpeg(spark, tmp_path, monkeypatch):
    y, x = np.mgrid[0:40, 0:50]
    data = np.stack([(x * 4 + y) % 256, 128 + 0 * x, 128 + 0 * x], axis=2).astype(np.uint8)
    monkeypatch.setitem(globals(), "packed", lambda raw, codec: jpeg_encode(np.frombuffer(raw, np.uint8).reshape(16, 16, 3), [(2, 2), (1, 1), (1, 1)])[0])
    path = write_tiff(tmp_path / "a.tif", data, codec=7, tile=(16, 16))
    raw = bytearray(open(path, "rb").read())
    at = raw.rindex(struct.pack("<HHI", 262, 3, 1)) + 8
    raw[at : at + 2] = struct.pack("<H", 6)
    open(path, "wb").write(bytes(raw))
    got = geotiff.read_colours(spark, path).toPandas()
    assert np.abs(got.g.to_numpy() - data[got.row, got.col, 0].astype(int)).max() <= 3 and len(got) == 2000


@pytest.mark.parametrize("dtype,predictor", [("<u2", 2), ("<i2", 1), ("<f4", 3), ("<f8", 3), ("<u4", 2)])
def test_tiff_samples(spark, tmp_path, dtype, predictor):
    data = (np.random.default_rng(2).normal(size=(20, 30, 1)) * 1000).astype(dtype)
    data[3, 4] = 7
    path = write_tiff(tmp_path / "a.tif", data, 8, (16, 16), predictor=predictor, nodata=7)
    got = cells(geotiff.read_bands(spark, path), data.shape)
    want = data.astype(float)
    want[data == 7] = np.nan
    assert np.array_equal(got, want, equal_nan=True)


def test_long_lzw_streams():
    for raw in (bytes(20_000), np.random.default_rng(3).integers(0, 9, 60_000).astype(np.uint8).tobytes()):
        assert geotiff.lzw(lzw_encode(raw)) == raw


def test_sidecars_and_point_rasters(tmp_path):
    data = np.zeros((4, 4, 1), np.uint8)
    path = write_tiff(tmp_path / "p.tif", data, point=True)
    assert geotiff.georeference(path).affine == (999, 2, 0, 2001, 0, -2) and not geotiff.georeference(path).area
    bare = write_tiff(tmp_path / "b.tif", data, geo=False)
    with pytest.raises(ValueError, match="where it lies"):
        geotiff.georeference(bare)
    (tmp_path / "b.tfw").write_text("2\n0\n0\n-2\n101\n199\n")
    assert geotiff.georeference(bare).affine == (100, 2, 0, 200, 0, -2)
    (tmp_path / "p.tif.aux.xml").write_text("<PAMDataset><GeoTransform>5, 1, 0, 6, 0, -1</GeoTransform></PAMDataset>")
    assert geotiff.georeference(path).affine == (5, 1, 0, 6, 0, -1)
    (tmp_path / "x.tif").write_bytes(b"nothing")
    with pytest.raises(ValueError, match="not a TIFF"):
        geotiff.georeference(str(tmp_path / "x.tif"))


def test_points_take_the_colours(spark, tmp_path):
    data = np.zeros((4, 4, 4), np.uint8)
    data[..., 0] = np.arange(16).reshape(4, 4) * 10
    data[..., 3] = 255
    data[0, 0, 3] = 0
    path = write_tiff(tmp_path / "a.tif", data)
    rows = [(1, 1003.0, 1999.0), (2, 1001.0, 1999.0), (3, 0.0, 0.0), (4, 1004.0, 1996.0)]
    points = spark.createDataFrame([(i, x, y, 1, 2, 3) for i, x, y in rows], "id long, x double, y double, r short, g short, b short")
    got = {r.id: (r.r, r.g) for r in geotiff.colour_points(spark, points, path, ["id"]).collect()}
    assert got == {1: (10, 0), 2: (1, 2), 3: (1, 2), 4: (100, 0)}
    assert {r.id for r in geotiff.colour_points(spark, points, path, ["id"], drop_missing=True).collect()} == {1, 4}
    got = {r.id: r.r for r in geotiff.colour_points(spark, points, path, ["id"], bilinear=True).collect()}
    assert got[4] == round((50 + 60 + 90 + 100) / 4) and got[1] == 10


# ---------------------------------------------------------------- E57

PAGE = 1024


def bit_packed(values, low, bits):
    raw = np.zeros(len(values) * bits, dtype=np.uint8)
    for k in range(bits):
        raw[k::bits] = (np.asarray(values) - low) >> k & 1
    return np.packbits(raw, bitorder="little").tobytes()


def write_e57(path, clouds):
    """clouds: (fields as (xml, packed bytes), count, more xml)."""
    body, xml_scans = b"\0" * 48, ""
    to_physical = lambda at: at + 4 * (at // (PAGE - 4))
    for fields, count, more in clouds:
        body += b"\0" * (-len(body) % 4)
        start = len(body)
        packets, streams = b"", [raw for _, raw in fields]
        # two packets, cut in the middle of the streams at whole bytes
        for part in ([s[: len(s) // 2] for s in streams], [s[len(s) // 2 :] for s in streams]):
            inner = b"".join(struct.pack("<H", len(p)) for p in part) + b"".join(part)
            n = 6 + len(inner)
            n += -n % 4
            packets += (struct.pack("<BBHH", 1, 0, n - 1, len(part)) + inner).ljust(n, b"\0")
        body += struct.pack("<B7xQQQ", 1, 32 + len(packets), to_physical(start + 32), 0) + packets
        prototype = "".join(x for x, _ in fields)
        xml_scans += f'<vectorChild type="Structure"><points type="CompressedVector" fileOffset="{to_physical(start)}" recordCount="{count}"><prototype type="Structure">{prototype}</prototype></points>{more}</vectorChild>'
    xml = f'<?xml version="1.0"?><e57Root type="Structure" xmlns="http://www.astm.org/COMMIT/E57/2010-e57-v1.0"><data3D type="Vector">{xml_scans}</data3D></e57Root>'.encode()
    at = len(body)
    body += xml
    pages = -(-len(body) // (PAGE - 4))
    head = struct.pack("<8sIIQQQQ", b"ASTM-E57", 1, 0, pages * PAGE, to_physical(at), len(xml), PAGE)
    body = head + body[48:]
    path.write_bytes(b"".join(body[k : k + PAGE - 4].ljust(PAGE - 4, b"\0") + b"\0\0\0\0" for k in range(0, len(body), PAGE - 4)))
    return str(path)


def test_e57_scans(spark, tmp_path):
    g, n = np.random.default_rng(5), 500
    xyz = g.normal(size=(n, 3)) * 10
    scaled = np.round(xyz[:, 2] / 0.001).astype(int)
    bad, colour, intensity = (g.random(n) < 0.1).astype(int), g.integers(0, 256, n), g.integers(0, 2048, n)
    first = [
        ('<cartesianX type="Float"/>', xyz[:, 0].tobytes()),
        ('<cartesianY type="Float" precision="single"/>', xyz[:, 1].astype("<f4").tobytes()),
        ('<cartesianZ type="ScaledInteger" minimum="-100000" maximum="100000" scale="0.001" offset="0"/>', bit_packed(scaled, -100000, 18)),
        ('<cartesianInvalidState type="Integer" minimum="0" maximum="2"/>', bit_packed(bad, 0, 2)),
        *((f'<color{c} type="Integer" minimum="0" maximum="255"/>', bit_packed(colour, 0, 8)) for c in ("Red", "Green", "Blue")),
        ('<intensity type="Integer" minimum="0" maximum="2047"/>', bit_packed(intensity, 0, 11)),
        ('<rowIndex type="Integer" minimum="7" maximum="7"/>', b""),
    ]
    pose = '<pose type="Structure"><rotation type="Structure"><w type="Float">0.7071067811865476</w><x type="Float"/><y type="Float"/><z type="Float">0.7071067811865476</z></rotation><translation type="Structure"><x type="Float">100</x><y type="Float"/><z type="Float"/></translation></pose>'
    ball = [("sphericalRange", [2.0, 3.0]), ("sphericalAzimuth", [0.0, math.pi / 2]), ("sphericalElevation", [0.0, 0.0])]
    second = [(f'<{c} type="Float"/>', np.array(v).tobytes()) for c, v in ball]
    path = write_e57(tmp_path / "a.e57", [(first, n, pose), (second, 2, "")])
    got = e57.read_points(spark, path, ["intensity", "rowindex"]).orderBy("pos").toPandas()
    ok = bad == 0
    assert len(got) == ok.sum() + 2
    a = got[:-2]
    assert np.allclose(a.x, 100 - xyz[ok, 1].astype("f4")) and np.allclose(a.y, xyz[ok, 0]) and np.allclose(a.z, scaled[ok] * 0.001)
    assert (a.g == colour[ok]).all() and (a.intensity == np.floor(intensity[ok] / 2047 * 65535 + 0.5)).all() and (a.rowindex == 7).all()
    assert np.allclose(got[["x", "y", "z"]][-2:], [[2, 0, 0], [0, 3, 0]]) and (got.rowindex[-2:] == 0).all() and (got.r[-2:] == 255).all()
    (tmp_path / "b.e57").write_bytes(b"nothing" * 10)
    with pytest.raises(Exception, match="not an E57"):
        e57.read_points(spark, str(tmp_path / "b.e57")).count()


def test_narrowest_types():
    for low, high, t in ((0, 255, "uint8"), (-1, 5, "int8"), (0, 256, "uint16"), (-300, 0, "int16"), (0, 70_000, "uint32"), (-70_000, 0, "int32")):
        assert e57.Field("a", "Integer", low, high).type == t


def test_outcomes(spark):
    df = spark.createDataFrame([(255,), (None,), (0,)], "cell_a int")
    assert tuple(geotiff.outcome(df).select(*map(F.col, ("coloured", "missing", "transparent"))).first()) == (1, 1, 1)


def _worldly(path):
    path.with_suffix(".tfw").write_text("2\n0\n0\n-2\n1001\n1999\n")
    return str(path)


def test_only_blocks_near_the_points_are_read(spark, tmp_path):
    data = np.arange(64 * 64, dtype=np.uint16).reshape(64, 64, 1)
    path = write_tiff(tmp_path / "a.tif", data, codec=8, tile=(16, 16))
    assert geotiff.read_bands(spark, path, (17, 0, 20, 16)).count() == 256
    assert geotiff.read_bands(spark, path, (0, 0, 0, 0)).count() == 0
    assert geotiff.read_bands(spark, path, (15, 15, 17, 17)).count() == 4 * 256


def test_systems_from_keys(tmp_path):
    image = geotiff.Image("<", {34735: (1, 1, 0, 9, 1024, 0, 1, 1, 3072, 0, 1, 32767, 3075, 0, 1, 8, 3076, 0, 1, 9003, 2048, 0, 1, 4269, 3078, 34736, 1, 0, 3079, 34736, 1, 1, 3084, 34736, 1, 2, 3085, 34736, 1, 3), 34736: (28.5, 30.25, -99.0, 27.75)})
    c = crs.parsed(image.crs())
    assert (c.kind, c.lat1, c.lat2, c.lon0, c.lat0, c.ellipsoid) == ("lcc", 28.5, 30.25, -99.0, 27.75, crs.GRS) and c.unit == pytest.approx(0.3048006)
    tm = geotiff.Image("<", {34735: (1, 1, 0, 4, 3072, 0, 1, 32767, 3075, 0, 1, 1, 3080, 34736, 1, 0, 3092, 34736, 1, 1), 34736: (9.0, 0.9996)})
    assert (crs.parsed(tm.crs()).kind, crs.parsed(tm.crs()).lon0, crs.parsed(tm.crs()).scale) == ("tmerc", 9.0, 0.9996)
    assert geotiff.Image("<", {34735: (1, 1, 0, 2, 3072, 0, 1, 25832, 4096, 0, 1, 7837)}).crs() == "EPSG:25832+7837"


def test_middleware_finalizers_and_planner(spark, tmp_path):
    from lodestone.plans import kd
    from lodestone.tiler import Options, tile_points

    points = spark.createDataFrame([(0, i, 500000.0 + i, 4400000.0 + i % 7, 1.0, 1, 1, 1) for i in range(50)], "file_id int, pos long, x double, y double, z double, r short, g short, b short")
    seen = []
    plan = lambda df, n, ids: kd.Plan([kd.Node("0", "x", 0.0), kd.Node("00"), kd.Node("01")])
    o = Options(encoder="pnts", planner=plan, middleware=[lambda p, c: (p + ".x", c[::-1]), lambda p, c: ("under/" + p, c)], finalizers=[lambda: seen.append(1), lambda: seen.append(2)])
    assert tile_points(spark, points, "EPSG:32633", str(tmp_path / "a"), o)["leaves"] == 2
    assert (tmp_path / "a/under/tileset.json.x").read_bytes()[::-1].startswith(b'{"asset"') and (tmp_path / "a/under/data/0/content.pnts.x").read_bytes()[-4:] == b"stnp" and seen == [1, 2]

    def fails():
        raise RuntimeError("closing")

    with pytest.raises(RuntimeError, match="closing"):
        tile_points(spark, points, "EPSG:32633", str(tmp_path / "b"), Options(encoder="pnts", finalizers=[fails]))
    with pytest.raises(ExceptionGroup) as both:
        tile_points(spark, points, "nowhere", str(tmp_path / "c"), Options(finalizers=[fails, lambda: seen.append(3)]))
    assert len(both.value.exceptions) == 2 and seen == [1, 2, 3]


def test_tiling_with_an_orthophoto(spark, tmp_path):
    from lodestone.tiler import Options, tile_points

    data = np.zeros((50, 50, 3), np.uint8)
    data[..., 1] = 200
    path = write_tiff(tmp_path / "a.tif", data)
    g = np.random.default_rng(6)
    rows = [(0, i, float(x), float(y), 1.0, 1, 1, 1) for i, (x, y) in enumerate(zip(g.uniform(1000, 1100, 200), g.uniform(1900, 2100, 200), strict=True))]
    points = spark.createDataFrame(rows, "file_id int, pos long, x double, y double, z double, r short, g short, b short")
    inside = sum(r[3] <= 2000 for r in rows)
    out = tile_points(spark, points, "EPSG:32633", str(tmp_path / "o"), Options(orthophoto=path, drop_uncoloured=True, encoder="pnts"))
    assert out["points"] == inside
    # the same places in another CRS meet the same cells
    ahead = frames.projected(frames.reprojected(points, "EPSG:32633"), "EPSG:3035")
    out = tile_points(spark, ahead, "EPSG:3035", str(tmp_path / "p"), Options(orthophoto=path, drop_uncoloured=True, encoder="pnts"))
    assert out["points"] == inside
    with pytest.raises(ValueError, match="CRS"):
        tile_points(spark, points, "EPSG:32634", str(tmp_path / "p"), Options(orthophoto=write_tiff(tmp_path / "b.tif", data, geo=False) and _worldly(tmp_path / "b.tif")))
    with pytest.raises(ValueError, match="write mutator"):
        tile_points(spark, points, "32633", str(tmp_path / "q"), Options(write_mutators=[lambda df: df.filter("point_id > 5")]))

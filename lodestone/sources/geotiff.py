"""Georeferenced TIFF images as rows of raster cells."""

from __future__ import annotations

import lzma
import math
import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..job import ship
from ..operators import raster
from ..storage import File, opened
from . import jpeg

# TIFF tags, field sizes and codecs (fixed values)
_SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8, 13: 4, 16: 8, 17: 8, 18: 8}
_FORMS = {1: "B", 2: "s", 3: "H", 4: "I", 6: "b", 7: "B", 8: "h", 9: "i", 11: "f", 12: "d", 13: "I", 16: "Q", 17: "q", 18: "Q"}
_WIDTH, _HEIGHT, _BITS, _CODEC, _PHOTO, _STRIPS, _SAMPLES, _ROWS, _STRIP_SIZES, _PLANAR, _PREDICTOR = 256, 257, 258, 259, 262, 273, 277, 278, 279, 284, 317
_PALETTE, _TILE_W, _TILE_H, _TILES, _TILE_SIZES, _EXTRA, _FORMAT = 320, 322, 323, 324, 325, 338, 339
_SCALE, _TIEPOINT, _MATRIX, _GEOKEYS, _METADATA, _NODATA, _SUBFILE = 33550, 33922, 34264, 34735, 42112, 42113, 254
_GEODOUBLES = 34736
# projection methods, ellipsoids and units of GeoTIFF keys (fixed values)
_METHODS = {1: "tmerc", 7: "merc", 8: "lcc", 9: "lcc", 10: "laea", 11: "aea", 15: "stere"}
_BALLS = {7030: "wgs84", 7019: "grs80", 7022: "intl", 7004: "bessel", 7008: "clrk66", 7001: "airy", 7024: "krass"}
_METRES = {9001: 1.0, 9002: 0.3048, 9003: 1200 / 3937, 9036: 1000.0}
_JPEG_TABLES = 347
CODECS = {1: "none", 5: "lzw", 8: "deflate", 32946: "deflate", 32773: "packbits", 34925: "lzma", 50000: "zstd"}


def lzw(raw: bytes) -> bytes:
    """TIFF's variant: codes from the highest bit, widened one code early."""
    out, table, width, prev = [], [], 9, b""
    bits = int.from_bytes(raw, "big")
    left = 8 * len(raw)
    first = [bytes([i]) for i in range(256)] + [b"", b""]
    while left >= width:
        left -= width
        code = bits >> left & ((1 << width) - 1)
        bits &= (1 << left) - 1
        if code == 256:
            table, width, prev = list(first), 9, b""
            continue
        if code == 257:
            break
        if not table:
            table = list(first)
        if code < len(table):
            entry = table[code]
        elif prev and code == len(table):
            entry = prev + prev[:1]
        else:
            raise ValueError("damaged LZW data")
        out.append(entry)
        if prev:
            table.append(prev + entry[:1])
        prev = entry
        n = len(table) + 1
        width = 9 if n < 512 else 10 if n < 1024 else 11 if n < 2048 else 12
    return b"".join(out)


def packbits(raw: bytes) -> bytes:
    out, at = [], 0
    while at < len(raw):
        n = raw[at]
        if n < 128:
            out.append(raw[at + 1 : at + 2 + n])
            at += 2 + n
        else:
            if n > 128:
                out.append(raw[at + 1 : at + 2] * (257 - n))
            at += 2 if n > 128 else 1
    return b"".join(out)


def unpacked(raw: bytes, codec: int) -> bytes:
    kind = CODECS.get(codec)
    if kind == "none":
        return raw
    if kind == "deflate":
        return zlib.decompress(raw)
    if kind == "lzma":
        return lzma.decompress(raw)
    if kind == "zstd":
        import zstandard

        return zstandard.ZstdDecompressor().decompressobj().decompress(raw)
    if kind == "lzw":
        return lzw(raw)
    if kind == "packbits":
        return packbits(raw)
    raise ValueError(f"TIFF codec {codec} is not read")


@dataclass
class Image:
    order: str
    tags: dict[int, tuple]

    def one(self, tag: int, default=None):
        return self.tags[tag][0] if tag in self.tags else default

    @property
    def size(self) -> tuple[int, int]:
        return self.one(_WIDTH), self.one(_HEIGHT)

    @property
    def bands(self) -> int:
        return self.one(_SAMPLES, 1)

    @property
    def dtype(self) -> np.dtype:
        bits = self.one(_BITS, 1)
        if len(set(self.tags.get(_BITS, (1,)))) > 1 or bits not in (8, 16, 32, 64):
            raise ValueError("samples have 8, 16, 32 or 64 bits, all the same")
        kind = {1: "u", 2: "i", 3: "f"}[self.one(_FORMAT, 1)]
        return np.dtype(f"{self.order}{kind}{bits // 8}")

    @property
    def block(self) -> tuple[int, int]:
        """Width and height of a block."""
        w, h = self.size
        return (self.one(_TILE_W), self.one(_TILE_H)) if _TILE_W in self.tags else (w, min(h, self.one(_ROWS, h)))

    def blocks(self) -> list[tuple[int, int, int, int, int]]:
        """(plane, column, row, place, bytes)"""
        (w, h), (bw, bh) = self.size, self.block
        across, down = -(-w // bw), -(-h // bh)
        at, n = (self.tags[t] for t in ((_TILES, _TILE_SIZES) if _TILE_W in self.tags else (_STRIPS, _STRIP_SIZES)))
        planes = self.bands if self.one(_PLANAR, 1) == 2 else 1
        return [(p, c * bw, r * bh, at[k], n[k]) for p in range(planes) for r in range(down) for c in range(across) if (k := (p * down + r) * across + c) < len(at) and n[k]]

    def decoded(self, raw: bytes, row: int) -> np.ndarray:
        """(rows, columns, bands) of a block."""
        bw, bh = self.block
        if _TILE_W not in self.tags:
            bh = min(bh, self.size[1] - row)
        bands = 1 if self.one(_PLANAR, 1) == 2 else self.bands
        if self.one(_CODEC, 1) == 7:
            out = jpeg.decode(raw, bytes(self.tags[_JPEG_TABLES]) if _JPEG_TABLES in self.tags else None, self.one(_PHOTO, 1) == 6)
            if out.shape[0] < bh or out.shape[1] < bw or out.shape[2] != bands:
                raise ValueError("a JPEG block isn't of the size that the file says")
            return out[:bh, :bw]
        data, d = unpacked(raw, self.one(_CODEC, 1)), self.dtype
        predictor = self.one(_PREDICTOR, 1)
        if predictor == 3:
            # bytes of a row by significance, each the difference from the one before it
            rows = np.frombuffer(data, "u1")[: bh * bw * bands * d.itemsize].reshape(bh, bw * bands * d.itemsize)
            rows = rows.reshape(bh, -1, bands).cumsum(axis=1, dtype=np.uint8).reshape(bh, d.itemsize, bw * bands)
            return np.ascontiguousarray(rows.transpose(0, 2, 1)).view(d.newbyteorder(">")).reshape(bh, bw, bands)
        out = np.frombuffer(data, d)[: bh * bw * bands].reshape(bh, bw, bands)
        if predictor == 2:
            out = out.view(np.dtype(d.str.replace("i", "u").replace("f", "u"))).cumsum(axis=1, dtype=f"u{d.itemsize}").view(f"{d.kind}{d.itemsize}")
        return out

    # ------------------------------------------------------------ where it lies

    def affine(self) -> tuple[float, ...] | None:
        """x = a + b column + c row; y = d + e column + f row: (a, b, c, d, e, f), of cells' corners."""
        if _MATRIX in self.tags:
            m = self.tags[_MATRIX]
            out = m[3], m[0], m[1], m[7], m[4], m[5]
        elif _SCALE in self.tags and _TIEPOINT in self.tags:
            s, t = self.tags[_SCALE], self.tags[_TIEPOINT]
            out = t[3] - t[0] * s[0], s[0], 0.0, t[4] + t[1] * s[1], 0.0, -s[1]
        else:
            return None
        if self.geokey(1025) == 2:  # given for centres
            out = out[0] - (out[1] + out[2]) / 2, out[1], out[2], out[3] - (out[4] + out[5]) / 2, out[4], out[5]
        return tuple(float(v) for v in out)

    def geokey(self, key: int) -> int | None:
        keys = self.tags.get(_GEOKEYS, ())
        return next((keys[i + 3] for i in range(4, len(keys) - 3, 4) if keys[i] == key and keys[i + 1] == 0), None)

    def geonumber(self, *found: int) -> float | None:
        """The first of the keys that has a number of its own."""
        keys, numbers = self.tags.get(_GEOKEYS, ()), self.tags.get(_GEODOUBLES, ())
        at = {keys[i]: keys[i + 3] for i in range(4, len(keys) - 3, 4) if keys[i + 1] == _GEODOUBLES}
        return next((float(numbers[at[k]]) for k in found if k in at and at[k] < len(numbers)), None)

    def crs(self) -> str | None:
        """An EPSG code, with that of the heights, or a PROJ string of the parameters that the keys give."""
        flat = next((c for c in (self.geokey(3072), self.geokey(2048)) if c and c != 32767), None)
        high = self.geokey(4096)
        if flat and not (self.geokey(3072) == 32767 and self.geokey(3075)):
            return f"EPSG:{flat}" + (f"+{high}" if high and high != 32767 else "")
        return self._described()

    def _described(self) -> str | None:
        kind = _METHODS.get(self.geokey(3075) or 0)
        if kind is None:
            return None
        g = self.geonumber
        parts = [f"+proj={kind}"]
        values = {"lon_0": g(3095, 3080, 3084, 3088), "lat_0": g(3081, 3085, 3089), "lat_1": g(3078), "lat_2": g(3079), "k_0": g(3092, 3093), "x_0": g(3082, 3086, 3090), "y_0": g(3083, 3087, 3091)}
        unit = _METRES.get(self.geokey(3076) or 9001, g(3077) or 1.0)
        if kind == "stere":
            lat = values["lat_0"] if values["lat_0"] is not None else 90.0
            values |= {"lat_0": 90.0 if lat >= 0 else -90.0, "lat_ts": values.pop("lat_1") if values["lat_1"] is not None else None if abs(lat) == 90 else lat}
        for k in ("x_0", "y_0"):
            values[k] = None if values[k] is None else values[k] * unit
        parts += [f"+{k}={v!r}" for k, v in values.items() if v is not None and not (k in ("lat_1", "lat_2") and kind not in ("lcc", "aea"))]
        a, rf, b = g(2057), g(2059), g(2058)
        if a:
            parts += [f"+a={a!r}"] + ([f"+rf={rf!r}"] if rf else [f"+b={b if b else a!r}"])
        elif self.geokey(2056) in _BALLS:
            parts.append(f"+ellps={_BALLS[self.geokey(2056)]}")
        elif self.geokey(2048) in (4269, 4258, 4283):
            parts.append("+ellps=grs80")
        return " ".join([*parts, f"+to_meter={unit!r}"])

    def nodata(self) -> float | None:
        text = self.tags.get(_NODATA, (b"",))[0].rstrip(b"\0 ").decode("ascii", "replace")
        try:
            return float(text)
        except ValueError:
            return None

    def scaling(self, band: int) -> tuple[float, float]:
        """Scale and offset that the metadata gives for a band."""
        text = self.tags.get(_METADATA, (b"",))[0].decode("utf-8", "replace")
        out = []
        for role, default in (("scale", 1.0), ("offset", 0.0)):
            found = [re.search(r">\s*([^<\s]+)", x)[1] for x in re.findall(r"<Item [^>]*>[^<]*", text) if f'role="{role}"' in x and f'sample="{band}"' in x]
            out.append(float(found[0]) if found else default)
        return out[0], out[1]


def images(read) -> list[Image]:
    head = read(0, 16)
    order = {b"II": "<", b"MM": ">"}.get(head[:2])
    version = struct.unpack_from(f"{order}H", head, 2)[0] if order else 0
    if version not in (42, 43):
        raise ValueError("not a TIFF file")
    big = version == 43
    at = struct.unpack_from(f"{order}Q", head, 8)[0] if big else struct.unpack_from(f"{order}I", head, 4)[0]
    out, seen = [], set()
    while at and at not in seen:
        seen.add(at)
        n = struct.unpack(f"{order}{'Q' if big else 'H'}", read(at, 8 if big else 2))[0]
        size, start, tags = (20 if big else 12), at + (8 if big else 2), {}
        raw = read(start, n * size + 8)
        for k in range(n):
            tag, kind = struct.unpack_from(f"{order}HH", raw, k * size)
            count = struct.unpack_from(f"{order}{'Q' if big else 'I'}", raw, k * size + 4)[0]
            if kind not in _SIZES:
                continue
            length, room = _SIZES[kind] * count, 8 if big else 4
            place = k * size + (12 if big else 8)
            data = raw[place : place + length] if length <= room else read(struct.unpack_from(f"{order}{'Q' if big else 'I'}", raw, place)[0], length)
            if kind == 2:
                tags[tag] = (data,)
            elif kind in (5, 10):
                v = struct.unpack(f"{order}{2 * count}{'I' if kind == 5 else 'i'}", data)
                tags[tag] = tuple(a / b if b else 0.0 for a, b in zip(v[::2], v[1::2], strict=True))
            else:
                tags[tag] = struct.unpack(f"{order}{count}{_FORMS[kind]}", data)
        out.append(Image(order, tags))
        at = struct.unpack_from(f"{order}{'Q' if big else 'I'}", raw, n * size)[0]
    return out


def world_file(uri: str) -> tuple[float, ...] | None:
    """The affine of a sidecar with six lines, which stand for the centre of the first cell."""
    stem = uri.rpartition(".")[0]
    for name in (f"{stem}.tfw", f"{stem}.wld", f"{uri}w"):
        where, path = opened(name)
        if where.get_file_info(path).is_file:
            with where.open_input_file(path) as f:
                b, e, c, f2, x, y = (float(v) for v in f.read().split()[:6])
            return x - (b + c) / 2, b, c, y - (e + f2) / 2, e, f2
    return None


@dataclass
class Georeference:
    affine: tuple[float, ...]
    crs: str | None
    area: bool
    size: tuple[int, int]


def georeference(uri: str) -> Georeference:
    """Where the largest full image of the file lies.  PAM sidecars come first, world files last."""
    with File(uri) as f:
        image = largest(images(f.read))
    affine, crs = image.affine(), image.crs()
    where, path = opened(uri + ".aux.xml")
    if where.get_file_info(path).is_file:
        with where.open_input_file(path) as side:
            text = side.read().decode("utf-8", "replace")
        if found := re.search(r"<GeoTransform>([^<]+)</GeoTransform>", text):
            affine = tuple(float(v) for v in found[1].split(","))
        if found := re.search(r'<SRS[^>]*>.*?AUTHORITY\[&quot;EPSG&quot;,&quot;(\d+)&quot;\]\]\s*</SRS>', text, re.S):
            crs = f"EPSG:{found[1]}"
    affine = affine or world_file(uri)
    if affine is None:
        raise ValueError(f"{uri} says nothing of where it lies")
    return Georeference(affine, crs, image.geokey(1025) != 2, image.size)


def largest(found: list[Image]) -> Image:
    full = [i for i in found if not i.one(_SUBFILE, 0) & 5] or found
    return max(full, key=lambda i: i.size[0] * i.size[1])


@dataclass
class Blocks(InputPartition):
    uri: str
    which: list[list[tuple[int, int, int, int, int]]]


class Reader(DataSourceReader):
    """A partition has some blocks; all planes of a block go together."""

    def __init__(self, uri: str, bands: int, window: tuple[int, ...] | None = None, each: int = 64):
        self.uri, self.bands, self.window, self.each = uri, bands, window, each

    def partitions(self) -> list[Blocks]:
        by: dict[tuple[int, int], list] = {}
        with File(self.uri) as f:
            image = largest(images(f.read))
        (w, h), (left, top, right, bottom) = image.block, self.window or (0, 0, *image.size)
        for b in image.blocks():
            if b[1] < right and b[1] + w > left and b[2] < bottom and b[2] + h > top:
                by.setdefault(b[1:3], []).append(b)
        groups = list(by.values())
        return [Blocks(self.uri, groups[i : i + self.each]) for i in range(0, len(groups), self.each)] or [Blocks(self.uri, [])]

    def read(self, part: Blocks) -> Iterator[pa.RecordBatch]:
        with File(part.uri) as f:
            image = largest(images(f.read))
            w, h = image.size
            for planes in part.which:
                decoded = [image.decoded(f.read(at, n), row) for _, _, row, at, n in planes]
                data = np.concatenate(decoded, axis=2) if len(decoded) > 1 else decoded[0]
                _, column, row, *_ = planes[0]
                data = data[: h - row, : w - column]
                rows, columns = np.indices(data.shape[:2])
                out = {"row": (rows + row).reshape(-1).astype(np.int32), "col": (columns + column).reshape(-1).astype(np.int32)}
                out |= {f"band_{b + 1}": data[:, :, b].reshape(-1).astype(np.float64) for b in range(self.bands)}
                yield pa.RecordBatch.from_pydict(out)


class GeoTiffSource(DataSource):
    """spark.read.format("lodestone_geotiff").load(path): row, col and the raw value of each band.

    Option window: left, top, right, bottom in cells; blocks beyond it aren't read.
    """

    @classmethod
    def name(cls) -> str:
        return "lodestone_geotiff"

    def _bands(self) -> int:
        with File(self.options["path"]) as f:
            return largest(images(f.read)).bands

    def schema(self) -> T.StructType:
        return T.StructType([T.StructField("row", T.IntegerType()), T.StructField("col", T.IntegerType()), *(T.StructField(f"band_{b + 1}", T.DoubleType()) for b in range(self._bands()))])

    def reader(self, schema: T.StructType) -> Reader:
        window = self.options.get("window")
        return Reader(self.options["path"], len(schema.names) - 2, tuple(map(int, window.split(","))) if window else None)


def read_bands(spark: SparkSession, uri: str, window: tuple[int, int, int, int] | None = None) -> DataFrame:
    """row, col and scaled bands; no-data values are null.  window: left, top, right, bottom; of blocks beyond it nothing is read."""
    ship(spark)
    spark.dataSource.register(GeoTiffSource)
    reader = spark.read.format("lodestone_geotiff")
    raw = (reader.option("window", ",".join(map(str, window))) if window else reader).load(uri)
    with File(uri) as f:
        image = largest(images(f.read))
    none, out = image.nodata(), {}
    for b in range(image.bands):
        v = F.col(f"band_{b + 1}")
        scale, shift = image.scaling(b)
        v = F.when((v != none) & ~F.isnan(v) if none is not None else ~F.isnan(v), v * scale + shift)
        out[f"band_{b + 1}"] = v
    return raw.withColumns(out)


def read_colours(spark: SparkSession, uri: str, window: tuple[int, int, int, int] | None = None) -> DataFrame:
    """row, col, r, g, b, a: one band is grey or goes through the palette, a second or fourth is opacity."""
    with File(uri) as f:
        image = largest(images(f.read))
    bands = read_bands(spark, uri, window)
    shift = 256 ** (image.dtype.itemsize - 1) if image.dtype.kind == "u" else 1
    value = lambda b: F.least(F.greatest(F.floor(F.col(f"band_{b}") / shift), F.lit(0)), F.lit(255)).cast("int")
    first, opaque = F.col("band_1"), F.lit(255)
    if _PALETTE in image.tags:
        p = np.array(image.tags[_PALETTE], dtype=np.int64).reshape(3, -1) >> 8
        rgb = [F.get(F.lit(p[c].astype(np.int32)), first.cast("int")) for c in range(3)]
    elif image.bands >= 3:
        rgb = [value(b) for b in (1, 2, 3)]
        opaque = value(4) if image.bands > 3 else opaque
    else:
        grey = F.lit(255) - value(1) if image.one(_PHOTO, 1) == 0 else value(1)
        rgb, opaque = [grey] * 3, value(2) if image.bands == 2 else opaque
    seen = first.isNotNull()
    return bands.select("row", "col", *(F.when(seen, v).otherwise(0).cast("int").alias(c) for c, v in zip("rgb", rgb, strict=True)), F.when(seen, opaque).otherwise(0).cast("int").alias("a"))


def colour_points(spark: SparkSession, points: DataFrame, uri: str, ids: list[str], bilinear: bool = False, min_alpha: int = 1, drop_missing: bool = False, place: tuple[str, str] = ("x", "y")) -> DataFrame:
    """Points whose columns ``place`` are in the image's CRS take its colours, those beyond it keep theirs or go.

    Only blocks that the points' box meets are read.
    """
    g = georeference(uri)
    x0, dx, skew_x, y0, skew_y, dy = g.affine
    det = dx * dy - skew_x * skew_y
    px, py = F.col(place[0]) - x0, F.col(place[1]) - y0
    if skew_x or skew_y:
        u, v, origin, step = (dy * px - skew_x * py) / det, (dx * py - skew_y * px) / det, (0.0, 0.0), (1.0, 1.0)
    else:
        u, v, origin, step = F.col(place[0]), F.col(place[1]), (x0, y0), (dx, dy)
    at = points.withColumns({"_x": F.col("x"), "_y": F.col("y")}).withColumns({"x": u, "y": v})
    box = at.agg(*(f((F.col(c) - o) / s).alias(f"{c}{n}") for c, o, s in zip("xy", origin, step, strict=True) for n, f in (("0", F.min), ("1", F.max)))).first()
    finite = [v if v is not None and math.isfinite(v) else 0.0 for v in box]
    bounded = lambda v, top: int(min(max(v, 0), top))
    window = (bounded(finite[0] - 2, g.size[0]), bounded(finite[2] - 2, g.size[1]), bounded(finite[1] + 3, g.size[0]), bounded(finite[3] + 3, g.size[1]))
    cells = read_colours(spark, uri, window)
    if bilinear:
        found = raster.bilinear_cells(at, cells, ids, origin, step)
        met = at.join(found, ids, "left")
    else:
        met = raster.nearest_cells(at, cells, origin, step)
    return raster.coloured(met.withColumns({"x": F.col("_x"), "y": F.col("_y")}).drop("_x", "_y"), min_alpha, drop_missing)


def outcome(coloured: DataFrame, min_alpha: int = 1) -> DataFrame:
    """How many points (with cell_a) were coloured, missed the image, or met transparent cells."""
    a = F.col("cell_a")
    return coloured.agg(F.count_if(a >= min_alpha).alias("coloured"), F.count_if(a.isNull()).alias("missing"), F.count_if(a < min_alpha).alias("transparent"))

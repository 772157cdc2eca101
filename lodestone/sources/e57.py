"""E57 point clouds: scans with poses, cartesian or spherical coordinates, bit-packed fields."""

from __future__ import annotations

import math
import struct
import xml.etree.ElementTree as ET
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..job import ship
from ..model import NUMPY_TYPES, SPARK_TYPES, canonical
from ..storage import File, listed

ROWS = 1 << 16  # of a batch

_COORDINATES = ("cartesianX", "cartesianY", "cartesianZ", "sphericalRange", "sphericalAzimuth", "sphericalElevation")
_STATES = ("cartesianInvalidState", "sphericalInvalidState")
_COLOURS = ("colorRed", "colorGreen", "colorBlue")


def _tag(e: ET.Element) -> str:
    return e.tag.rpartition("}")[2]


def _child(e: ET.Element | None, *names: str) -> ET.Element | None:
    for n in names:
        e = next((c for c in e if _tag(c) == n), None) if e is not None else None
    return e


def _number(e: ET.Element | None, default: float = 0.0) -> float:
    return float(e.text) if e is not None and e.text else default


@dataclass
class Field:
    name: str
    kind: str  # Integer, ScaledInteger or Float
    low: int = 0
    high: int = 0
    scale: float = 1.0
    shift: float = 0.0
    single: bool = False

    @property
    def bits(self) -> int:
        return (32 if self.single else 64) if self.kind == "Float" else max(0, (self.high - self.low)).bit_length()

    @property
    def type(self) -> str:
        """The narrowest type for the declared range."""
        if self.kind == "Float":
            return "float32" if self.single else "float64"
        if self.kind == "ScaledInteger":
            return "float64"
        for t in ("uint8", "int8", "uint16", "int16", "uint32", "int32", "uint64", "int64"):
            info = np.iinfo(NUMPY_TYPES[t])
            if info.min <= self.low and self.high <= info.max:
                return t
        return "int64"


@dataclass
class Scan:
    index: int
    count: int
    place: int  # of the section, as the file counts it
    fields: list[Field]
    rotation: tuple[float, float, float, float]
    shift: tuple[float, float, float]
    ranges: dict[str, tuple[float, float]]


class Pages:
    """The file without its page checksums."""

    def __init__(self, read):
        self.raw = read
        head = read(0, 48)
        if head[:8] != b"ASTM-E57":
            raise ValueError("not an E57 file")
        _, _, self.size, self.xml_at, self.xml_size, self.page = struct.unpack_from("<IIQQQQ", head, 8)

    def logical(self, physical: int) -> int:
        return physical - 4 * (physical // self.page)

    def read(self, at: int, n: int) -> bytes:
        """n bytes from a logical place."""
        body = self.page - 4
        first, last = at // body, (at + n + body - 1) // body
        raw = self.raw(first * self.page, (last - first) * self.page)
        out = b"".join(raw[k : k + body] for k in range(0, len(raw), self.page))
        return out[at - first * body : at - first * body + n]


def scans(pages: Pages) -> list[Scan]:
    root = ET.fromstring(pages.read(pages.logical(pages.xml_at), pages.xml_size).rstrip(b"\0"))
    out = []
    for i, s in enumerate(_child(root, "data3D") or ()):
        points = _child(s, "points")
        fields = []
        for f in _child(points, "prototype"):
            kind = f.get("type")
            if kind == "String":
                continue  # can't be an attribute
            get = lambda k, d, f=f: type(d)(f.get(k, d))
            fields.append(Field(_tag(f), kind, get("minimum", -(1 << 63)), get("maximum", (1 << 63) - 1), get("scale", 1.0), get("offset", 0.0), f.get("precision") == "single") if kind != "Float" else Field(_tag(f), kind, single=f.get("precision") == "single"))
        turn, move = _child(s, "pose", "rotation"), _child(s, "pose", "translation")
        rotation = tuple(_number(_child(turn, c), 1.0 if c == "w" else 0.0) for c in "wxyz") if turn is not None else (1.0, 0.0, 0.0, 0.0)
        shift = tuple(_number(_child(move, c)) for c in "xyz") if move is not None else (0.0, 0.0, 0.0)
        ranges = {}
        for limits, names in (("colorLimits", _COLOURS), ("intensityLimits", ("intensity",))):
            box = _child(s, limits)
            for n in names:
                low, high = _child(box, f"{n}Minimum"), _child(box, f"{n}Maximum")
                if low is not None and high is not None:
                    ranges[n] = _number(low), _number(high)
        for f in fields:
            if f.name in (*_COLOURS, "intensity") and f.name not in ranges and f.kind != "Float":
                ranges[f.name] = f.low * f.scale + f.shift, f.high * f.scale + f.shift
        out.append(Scan(i, int(points.get("recordCount")), int(points.get("fileOffset")), fields, rotation, shift, ranges))
    return out


def _packets(pages: Pages, scan: Scan) -> Iterator[list[bytes]]:
    """The byte streams of each data packet."""
    at = pages.logical(scan.place)
    head = pages.read(at, 32)
    if head[0] != 1:
        raise ValueError("an E57 section is damaged")
    length, data = struct.unpack_from("<QQ", head, 8)
    end, at = at + length, pages.logical(data)
    while at < end:
        kind, _, n = struct.unpack("<BBH", pages.read(at, 4))
        n += 1
        if kind == 1:
            raw = pages.read(at, n)
            streams = struct.unpack_from("<H", raw, 4)[0]
            sizes = struct.unpack_from(f"<{streams}H", raw, 6)
            place, out = 6 + 2 * streams, []
            for s in sizes:
                out.append(raw[place : place + s])
                place += s
            yield out
        at += n


def _decoded(f: Field, raw: bytes, n: int) -> np.ndarray:
    if f.kind == "Float":
        return np.frombuffer(raw, "<f4" if f.single else "<f8", n)
    if not f.bits:
        v = np.full(n, f.low, dtype=np.int64)
    else:
        bits = np.unpackbits(np.frombuffer(raw, "u1"), bitorder="little")[: n * f.bits].reshape(n, f.bits)
        v = (bits.astype(np.uint64) << np.arange(f.bits, dtype=np.uint64)).sum(axis=1, dtype=np.uint64).astype(np.int64) + f.low
    return v * f.scale + f.shift if f.kind == "ScaledInteger" else v


def points_of(scan: Scan, data: dict[str, np.ndarray], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Posed coordinates of n records, and which of them have valid ones."""
    if "cartesianX" in data:
        xyz = np.stack([data[c].astype(np.float64) for c in _COORDINATES[:3]], axis=1)
        ok = data.get(_STATES[0], np.zeros(n)) == 0
    elif "sphericalRange" in data:
        r, a, e = (data[c].astype(np.float64) for c in _COORDINATES[3:])
        xyz = np.stack([r * np.cos(e) * np.cos(a), r * np.cos(e) * np.sin(a), r * np.sin(e)], axis=1)
        ok = data.get(_STATES[1], np.zeros(n)) == 0
    else:
        return np.zeros((n, 3)), np.zeros(n, dtype=bool)
    w, x, y, z = np.array(scan.rotation) / math.sqrt(sum(v * v for v in scan.rotation))
    turn = np.array([[1 - 2 * (y * y + z * z), 2 * (x * y - w * z), 2 * (x * z + w * y)], [2 * (x * y + w * z), 1 - 2 * (x * x + z * z), 2 * (y * z - w * x)], [2 * (x * z - w * y), 2 * (y * z + w * x), 1 - 2 * (x * x + y * y)]])
    return xyz @ turn.T + scan.shift, ok


def scaled(v: np.ndarray, limits: tuple[float, float] | None, top: int) -> np.ndarray:
    """Values of a range as integers up to top, rounded half away from zero; 0 without a width."""
    low, high = limits or (0.0, float(top))
    return np.clip(np.floor((v - low) / (high - low) * top + 0.5), 0, top).astype(np.int32) if high > low else np.zeros(len(v), np.int32)


@dataclass
class One(InputPartition):
    file_id: int
    uri: str
    scan: int


class Reader(DataSourceReader):
    def __init__(self, files: list[str], schema: T.StructType):
        self.files, self.schema = files, schema

    def partitions(self) -> list[One]:
        out = []
        for i, uri in enumerate(self.files):
            with File(uri) as f:
                out += [One(i, uri, s.index) for s in scans(Pages(f.read))]
        return out or [One(-1, "", 0)]

    def read(self, part: One) -> Iterator[pa.RecordBatch]:
        if part.file_id < 0:
            return
        with File(part.uri) as f:
            pages = Pages(f.read)
            every = scans(pages)
            scan = every[part.scan]
            at, left, held = sum(s.count for s in every[: part.scan]), scan.count, [bytearray() for _ in scan.fields]
            for packet in _packets(pages, scan):
                for k, raw in enumerate(packet[: len(held)]):
                    held[k] += raw
                n = min([left, *(len(h) * 8 // f.bits for f, h in zip(scan.fields, held, strict=True) if f.bits)]) // 8 * 8  # whole bytes of any width
                if n >= ROWS:
                    yield self._batch(part.file_id, scan, at, n, held)
                    at, left = at + n, left - n
            if left:
                yield self._batch(part.file_id, scan, at, left, held)

    def _batch(self, file_id: int, scan: Scan, at: int, n: int, held: list[bytearray]) -> pa.RecordBatch:
        """The next n records, which are taken off what is held of each field."""
        data = {}
        for f, h in zip(scan.fields, held, strict=True):
            size = -(-n * f.bits // 8)
            data[f.name] = _decoded(f, bytes(h[:size]), n)
            del h[:size]
        xyz, ok = points_of(scan, data, n)
        out: dict[str, np.ndarray] = {"file_id": np.full(n, file_id), "pos": np.arange(at, at + n)} | {a: xyz[:, i] for i, a in enumerate("xyz")}
        out |= {c: scaled(data[k].astype(float), scan.ranges.get(k), 255) if k in data else np.full(n, 255) for c, k in zip("rgb", _COLOURS, strict=True)}
        for f in scan.fields:
            if f.name == "intensity":
                out["intensity"] = scaled(data[f.name].astype(float), scan.ranges.get("intensity"), 65535)
            elif f.name not in (*_COORDINATES, *_STATES, *_COLOURS):
                out[canonical(f.name)] = data[f.name]
        arrays = []
        for f in self.schema.fields:
            kind = {T.ByteType: pa.int8(), T.ShortType: pa.int16(), T.IntegerType: pa.int32(), T.LongType: pa.int64(), T.FloatType: pa.float32(), T.DoubleType: pa.float64(), T.DecimalType: pa.decimal128(20, 0)}[type(f.dataType)]
            v = out.get(f.name, np.zeros(n, dtype=np.int64))[ok]
            if v.dtype.kind == "f" and pa.types.is_integer(kind):
                v = np.trunc(v + np.copysign(0.5, v)).astype(np.int64)
            arrays.append(pa.array(v).cast(kind))
        return pa.RecordBatch.from_arrays(arrays, names=self.schema.names)


class E57Source(DataSource):
    """spark.read.format("lodestone_e57").load(path); a partition is one scan."""

    @classmethod
    def name(cls) -> str:
        return "lodestone_e57"

    def _files(self) -> list[str]:
        return listed(self.options["path"], ("e57",))

    def schema(self) -> T.StructType:
        out = {"file_id": T.StructField("file_id", T.IntegerType()), "pos": T.StructField("pos", T.LongType())}
        out |= {a: T.StructField(a, T.DoubleType()) for a in "xyz"} | {c: T.StructField(c, T.ShortType()) for c in "rgb"}
        for uri in self._files():
            with File(uri) as f:
                for s in scans(Pages(f.read)):
                    for x in s.fields:  # the first scan that has a field says its type
                        if x.name not in (*_COORDINATES, *_STATES, *_COLOURS):
                            t = "uint16" if x.name == "intensity" else x.type
                            out.setdefault(canonical(x.name), T.StructField(canonical(x.name), SPARK_TYPES[t], True, {"attr_type": t}))
        return T.StructType(list(out.values()))

    def reader(self, schema: T.StructType) -> Reader:
        return Reader(self._files(), schema)


def read_points(spark: SparkSession, path: str, attributes: list[str] | tuple[str, ...] = ("intensity",)) -> DataFrame:
    """Posed points of all scans; those without valid coordinates are left out."""
    ship(spark)
    spark.dataSource.register(E57Source)
    raw = spark.read.format("lodestone_e57").load(path)
    names = [c for c in dict.fromkeys(map(canonical, attributes)) if c in raw.columns and c not in "xyzrgb"]
    return raw.select("file_id", "pos", *"xyz", *"rgb", *(F.col(n) for n in names))

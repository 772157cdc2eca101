"""LAS point clouds, versions 1.0 to 1.4, and compressed ones (LAZ) of point formats 0 to 3."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..job import ship
from ..model import NUMPY_TYPES, canonical, field, merged_types
from ..storage import File, listed
from . import laz

ROWS = 250_000

# record layouts of the formats (fixed values)
_BASE = [("X", "<i4"), ("Y", "<i4"), ("Z", "<i4"), ("intensity", "<u2"), ("returns", "u1"), ("class", "u1"), ("scan_angle_rank", "i1"), ("user_data", "u1"), ("point_source_id", "<u2")]
_LONG = [("X", "<i4"), ("Y", "<i4"), ("Z", "<i4"), ("intensity", "<u2"), ("returns", "u1"), ("flags", "u1"), ("classification", "u1"), ("user_data", "u1"), ("scan_angle_raw", "<i2"), ("point_source_id", "<u2"), ("gps_time", "<f8")]
_GPS, _RGB, _NIR = [("gps_time", "<f8")], [("red", "<u2"), ("green", "<u2"), ("blue", "<u2")], [("nir", "<u2")]
_WAVE = [("wave_packet_descriptor_index", "u1"), ("wave_byte_offset", "<u8"), ("wave_packet_size", "<u4"), ("wave_return_location", "<f4"), ("wave_xt", "<f4"), ("wave_yt", "<f4"), ("wave_zt", "<f4")]
FORMATS = {0: _BASE, 1: _BASE + _GPS, 2: _BASE + _RGB, 3: _BASE + _GPS + _RGB, 4: _BASE + _GPS + _WAVE, 5: _BASE + _GPS + _RGB + _WAVE, 6: _LONG, 7: _LONG + _RGB, 8: _LONG + _RGB + _NIR, 9: _LONG + _WAVE, 10: _LONG + _RGB + _NIR + _WAVE}
EXTRA_TYPES = {1: "uint8", 2: "int8", 3: "uint16", 4: "int16", 5: "uint32", 6: "int32", 7: "uint64", 8: "int64", 9: "float32", 10: "float64"}

# other spellings of extra dimensions, canonical, by the names that they are asked for (fixed values)
_INCIDENCE = ("incidenceangle", "trueviewincidenceangle", "_incidenceangle")
_WIDTH = ("pulsewidth", "echowidth", "echolength")
ALIASES = {"incidence_angle": _INCIDENCE, "incidenceangle": _INCIDENCE, "pulse_width": _WIDTH, "pulsewidth": _WIDTH, "echo_width": _WIDTH, "echowidth": _WIDTH}


def sources(wanted: list[str] | tuple[str, ...], have: list[str]) -> dict[str, str]:
    """The field of a file for each wanted attribute that it has: the first under its name or another spelling of it.

    A field that two wanted attributes could take goes to the first of them.
    """
    takes: dict[str, str] = {}
    for a in map(canonical, wanted):
        for n in (a, *ALIASES.get(a, ())) if a else ():
            takes.setdefault(n, a)
    found: dict[str, str] = {}
    for n in have:
        if n in takes:
            found.setdefault(takes[n], n)
    return {a: found[a] for a in map(canonical, wanted) if a in found}


@dataclass
class Las:
    """What the header says."""

    version: tuple[int, int]
    format: int
    length: int
    count: int
    offset: int
    scale: tuple[float, float, float]
    shift: tuple[float, float, float]
    extra: list[tuple[str, str, float | None, float | None]]  # name, type, scale, offset
    epsg: int | None
    packing: laz.Packing | None = None

    @property
    def long(self) -> bool:
        return self.format >= 6

    @property
    def dtype(self) -> np.dtype:
        parts = list(FORMATS[self.format])
        taken = np.dtype(parts).itemsize
        for name, kind, *_ in self.extra:
            size = np.dtype(NUMPY_TYPES[kind]).itemsize
            if taken + size > self.length:
                break
            parts.append((f"extra:{name}", NUMPY_TYPES[kind]))
            taken += size
        names, kinds = zip(*parts, strict=True)
        at = np.cumsum([0, *(np.dtype(k).itemsize for k in kinds)])[:-1]
        return np.dtype({"names": list(names), "formats": list(kinds), "offsets": at.tolist(), "itemsize": self.length})

    def attributes(self) -> dict[str, str]:
        """Names and types in the order in which they are given."""
        f, have = FORMATS[self.format], {n for n, _ in FORMATS[self.format]}
        out = {"intensity": "uint16", "return_number": "uint8", "number_of_returns": "uint8", "classification": "uint8", "synthetic": "bool", "key_point": "bool", "withheld": "bool"}
        if self.long:
            out |= {"overlap": "bool", "scanner_channel": "uint8"}
        out |= {"scan_direction_flag": "bool", "edge_of_flight_line": "bool", "scan_angle": "float64", "user_data": "uint8", "point_source_id": "uint16"}
        kinds = {"<f8": "float64", "<u2": "uint16", "<u4": "uint32", "<u8": "uint64", "<f4": "float32", "u1": "uint8"}
        out |= {n: kinds[t] for n, t in f if n in have and (n in ("gps_time", "nir") or n.startswith("wave_"))}
        return out | {canonical(n): "float64" if s is not None or o is not None else t for n, t, s, o in self.extra}


def header(read, size: int) -> Las:
    h = read(0, 375)
    if h[:4] != b"LASF":
        raise ValueError("not a LAS file")
    version = h[24], h[25]
    header_size, offset, vlrs, form, length, count = struct.unpack_from("<HIIBHI", h, 94)
    compressed, form, packing = bool(form & 0xC0), form & 0x3F, None
    if form not in FORMATS:
        raise ValueError(f"unknown point format {form}")
    numbers = struct.unpack_from("<6d", h, 131)
    if version >= (1, 4) and header_size >= 255:
        count = struct.unpack_from("<Q", h, 247)[0] or count
    extra, epsg, at = [], None, header_size
    for _ in range(vlrs):
        v = read(at, 54)
        user, record, n = v[2:18].rstrip(b"\0"), *struct.unpack_from("<HH", v, 18)
        body = read(at + 54, n)
        at += 54 + n
        if user == b"LASF_Spec" and record == 4:
            for a in range(0, len(body) - 191, 192):
                kind, options = body[a + 2], body[a + 3]
                if kind not in EXTRA_TYPES:
                    raise ValueError(f"extra bytes of type {kind} are not read")
                scale, shift = struct.unpack_from("<d", body, a + 112)[0], struct.unpack_from("<d", body, a + 136)[0]
                scaled = options & 24
                extra.append((body[a + 4 : a + 36].rstrip(b"\0").decode("utf-8", "replace"), EXTRA_TYPES[kind], (scale if options & 8 else 1.0) if scaled else None, (shift if options & 16 else 0.0) if scaled else None))
        elif user == b"laszip encoded" and record == 22204 and compressed:
            packing = laz.Packing.of(body)
        elif user == b"LASF_Projection" and record == 34735:
            keys = np.frombuffer(body, "<u2")[4:].reshape(-1, 4)
            epsg = next((int(k[3]) for k in keys if k[0] in (3072, 2048) and k[1] == 0 and k[3] not in (0, 32767)), epsg)
    out = Las(version, form, length, count, offset, numbers[0:3], numbers[3:6], extra, epsg, packing)
    if compressed and (packing is None or sum(n for _, n in packing.items) != length):
        raise ValueError("the LAZ file doesn't say how it is compressed")
    if out.length < np.dtype(FORMATS[form]).itemsize or (not compressed and offset + count * length > size):
        raise ValueError("the LAS file is cut short")
    return out


def columns(las: Las, raw: np.ndarray, eight_bit: bool, wanted: list[str]) -> dict[str, np.ndarray]:
    """The wanted columns of some records."""
    out: dict[str, np.ndarray] = {}
    for name in wanted:
        if name in ("x", "y", "z"):
            i = "xyz".index(name)
            out[name] = raw["XYZ"[i]] * las.scale[i] + las.shift[i]
        elif name in ("r", "g", "b"):
            field = {"r": "red", "g": "green", "b": "blue"}[name]
            have = field in raw.dtype.names
            out[name] = np.full(len(raw), 255, np.int16) if not have else (np.minimum(raw[field], 255) if eight_bit else raw[field] >> 8).astype(np.int16)
        elif name == "return_number":
            out[name] = (raw["returns"] & (15 if las.long else 7)).astype(np.int16)
        elif name == "number_of_returns":
            out[name] = (raw["returns"] >> 4 if las.long else (raw["returns"] >> 3) & 7).astype(np.int16)
        elif name in ("scan_direction_flag", "edge_of_flight_line"):
            source = raw["flags"] if las.long else raw["returns"]
            out[name] = (source >> (6 if name == "scan_direction_flag" else 7)) & 1 == 1
        elif name in ("synthetic", "key_point", "withheld", "overlap"):
            bit = ("synthetic", "key_point", "withheld", "overlap").index(name)
            out[name] = ((raw["flags"] >> bit) if las.long else (raw["class"] >> (5 + bit))) & 1 == 1
        elif name == "scanner_channel":
            out[name] = ((raw["flags"] >> 4) & 3).astype(np.int16)
        elif name == "classification":
            out[name] = (raw["classification"] if las.long else raw["class"] & 31).astype(np.int16)
        elif name == "scan_angle":
            out[name] = raw["scan_angle_raw"] * 0.006 if las.long else raw["scan_angle_rank"].astype(np.float64)
        elif name in raw.dtype.names:
            kind = las.attributes()[name]
            out[name] = raw[name].astype({"uint8": "i2", "uint16": "i4", "uint32": "i8"}.get(kind, raw[name].dtype))
        else:
            source, kind, scale, shift = next(e for e in las.extra if canonical(e[0]) == name)
            v = raw[f"extra:{source}"]
            out[name] = v * scale + shift if scale is not None else v.astype({"uint8": "i2", "uint16": "i4", "uint32": "i8"}.get(kind, v.dtype))
    return out


@dataclass
class Range(InputPartition):
    file_id: int
    uri: str
    first: int
    count: int
    place: int = 0  # of a compressed chunk
    size: int = 0


OWN = ("file_id", "pos", *"xyz", *"rgb")


class Reader(DataSourceReader):
    def __init__(self, files: list[str], schema: T.StructType, eight_bit: bool, asked: bool):
        self.files, self.schema, self.eight_bit, self.asked = files, schema, eight_bit, asked

    def partitions(self) -> list[Range]:
        out = []
        for i, uri in enumerate(self.files):
            with File(uri) as f:
                las = header(f.read, f.size)
                n = las.count
                if las.packing and n:  # a chunk is decoded as a whole
                    out += [Range(i, uri, *c) for c in laz.chunks(f.read, las.offset, f.size, n, las.packing) if c[1]]
                    continue
            out += [Range(i, uri, a, min(ROWS, n - a)) for a in range(0, n, ROWS)]
        return out or [Range(-1, "", 0, 0)]

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        if part.file_id < 0:
            return
        with File(part.uri) as f:
            las = header(f.read, f.size)
            own = las.attributes()
            chunk = np.frombuffer(laz.decoded(f.read(part.place, part.size), part.count, las.packing), las.dtype) if las.packing else None
            for a in range(part.first, part.first + part.count, 1 << 16):
                n = min(1 << 16, part.first + part.count - a)
                raw = np.frombuffer(f.read(las.offset + a * las.length, n * las.length), las.dtype) if chunk is None else chunk[a - part.first : a - part.first + n]
                rest = [c for c in self.schema.names if c not in OWN]
                named = sources(rest, list(own)) if self.asked else {c: c for c in rest if c in own}
                data = columns(las, raw, self.eight_bit, [*"xyzrgb", *named.values()])
                data |= {c: data[n] for c, n in named.items()} | {"file_id": np.full(n, part.file_id, np.int32), "pos": np.arange(a, a + n)}
                arrays = []
                for c in self.schema.fields:
                    kind = {T.ByteType: pa.int8(), T.ShortType: pa.int16(), T.IntegerType: pa.int32(), T.LongType: pa.int64(), T.BooleanType: pa.bool_(), T.FloatType: pa.float32(), T.DoubleType: pa.float64(), T.DecimalType: pa.decimal128(20, 0)}[type(c.dataType)]
                    v = data.get(c.name, np.zeros(n, dtype=bool if kind == pa.bool_() else np.int64))  # a file without it: zero
                    arrays.append(pa.array([int(x) for x in v], pa.int64() if not len(v) else None).cast(kind) if pa.types.is_decimal(kind) else pa.array(v).cast(kind))
                yield pa.RecordBatch.from_arrays(arrays, names=self.schema.names)


class LasSource(DataSource):
    """spark.read.format("lodestone_las").load(path): points with what any of the files has, zero where one lacks it.

    Options: eight_bit: colours are stored in eight bits; attributes: names after commas, to be found under any spelling.
    """

    @classmethod
    def name(cls) -> str:
        return "lodestone_las"

    def _files(self) -> list[str]:
        return listed(self.options["path"], ("las", "laz"))

    def schema(self) -> T.StructType:
        out = [T.StructField("file_id", T.IntegerType()), T.StructField("pos", T.LongType()), *(T.StructField(a, T.DoubleType()) for a in "xyz"), *(T.StructField(c, T.ShortType()) for c in "rgb")]
        each, wanted = [], self.options.get("attributes")
        for uri in self._files():
            with File(uri) as f:
                own = header(f.read, f.size).attributes()
            each.append({a: own[n] for a, n in sources(wanted.split(","), list(own)).items()} if wanted is not None else own)
        return T.StructType(out + [field(n, t) for n, t in merged_types(each).items() if n not in OWN])

    def reader(self, schema: T.StructType) -> Reader:
        return Reader(self._files(), schema, self.options.get("eight_bit", "false").lower() == "true", "attributes" in self.options)


def crs_of(path: str) -> str | None:
    """The CRS that the files name; several are an error."""
    from ..model import one_crs

    found = []
    for uri in listed(path, ("las", "laz")):
        with File(uri) as f:
            epsg = header(f.read, f.size).epsg
            found.append(f"EPSG:{epsg}" if epsg else None)
    return one_crs(found)


def read_points(spark: SparkSession, path: str, attributes: list[str] | tuple[str, ...] = ("intensity", "classification"), eight_bit: bool = False) -> DataFrame:
    """Points of one file or a folder with those of the attributes that it has."""
    ship(spark)
    spark.dataSource.register(LasSource)
    raw = spark.read.format("lodestone_las").option("eight_bit", str(eight_bit)).option("attributes", ",".join(attributes)).load(path)
    names = [c for c in dict.fromkeys(map(canonical, attributes)) if c in raw.columns and c not in OWN]
    return raw.select(*OWN, *names)

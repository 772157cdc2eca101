"""PLY point clouds and splat scenes."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.scalar import finite, sigmoid
from ..job import ship
from ..model import NUMPY_TYPES, canonical, merged_types
from ..model import field as column
from ..storage import File, listed

ROWS = 250_000  # of a partition
COLOURS = ("red", "green", "blue", "r", "g", "b", "diffuse_red", "diffuse_green", "diffuse_blue")

# PLY type names (fixed values)
_TYPES = {"char": "int8", "uchar": "uint8", "short": "int16", "ushort": "uint16", "int": "int32", "uint": "uint32", "float": "float32", "double": "float64"}
_TYPES |= {t: t for t in ("int8", "uint8", "int16", "uint16", "int32", "uint32", "float32", "float64")}


@dataclass
class Element:
    name: str
    count: int
    properties: list[tuple[str, str, str | None]] = field(default_factory=list)  # name, type, type of a list's length

    @property
    def fixed(self) -> bool:
        return all(n is None for _, _, n in self.properties)

    def dtype(self, order: str) -> np.dtype:
        return np.dtype([(n, NUMPY_TYPES[t].replace("<", order)) for n, t, _ in self.properties])


@dataclass
class Header:
    form: str
    elements: list[Element]
    size: int

    @property
    def order(self) -> str:
        return ">" if self.form == "binary_big_endian" else "<"

    @property
    def vertex(self) -> Element:
        return next(e for e in self.elements if e.name == "vertex")


def header(read) -> Header:
    raw, n = b"", 1 << 14
    while b"end_header" not in raw or not raw.partition(b"end_header")[2].lstrip(b"\r").startswith(b"\n"):
        more = read(0, n)
        if len(more) == len(raw):
            raise ValueError("the PLY header doesn't end")
        raw, n = more, n * 4
    text, _, rest = raw.partition(b"end_header")
    size = len(text) + len(b"end_header") + (2 if rest.startswith(b"\r\n") else 1)
    lines = [x.split() for x in text.decode("ascii", "replace").splitlines()]
    if not lines or lines[0] != ["ply"]:
        raise ValueError("not a PLY file")
    form, elements = "", []
    for words in lines[1:]:
        if not words or words[0] in ("comment", "obj_info"):
            continue
        if words[0] == "format":
            form = words[1]
        elif words[0] == "element":
            elements.append(Element(words[1], int(words[2])))
        elif words[0] == "property" and words[1] == "list":
            elements[-1].properties.append((words[4], _TYPES[words[3]], _TYPES[words[2]]))
        elif words[0] == "property":
            elements[-1].properties.append((words[2], _TYPES[words[1]], None))
    if form not in ("ascii", "binary_little_endian", "binary_big_endian") or not any(e.name == "vertex" for e in elements):
        raise ValueError("a PLY file has a format and vertices")
    return Header(form, elements, size)


def _skip(read, head: Header, e: Element, at: int) -> int:
    """Where a binary element ends."""
    if e.fixed:
        return at + e.count * e.dtype(head.order).itemsize
    for _ in range(e.count):
        for _, kind, length in e.properties:
            if length:
                n = np.dtype(NUMPY_TYPES[length].replace("<", head.order))
                at += n.itemsize + int(np.frombuffer(read(at, n.itemsize), n)[0]) * np.dtype(NUMPY_TYPES[kind]).itemsize
            else:
                at += np.dtype(NUMPY_TYPES[kind]).itemsize
    return at


def start_of_vertices(read, size: int, head: Header) -> int:
    """For binary files the byte, for text the line; files that are too short raise ValueError."""
    before = head.elements[: head.elements.index(head.vertex)]
    if head.form == "ascii":
        return sum(e.count for e in before)
    at = head.size
    for e in before:
        at = _skip(read, head, e, at)
    if head.vertex.fixed and at + head.vertex.count * head.vertex.dtype(head.order).itemsize > size:
        raise ValueError("the PLY file is cut short")
    return at


@dataclass
class Range(InputPartition):
    file_id: int
    uri: str
    first: int
    count: int
    start: int


class Reader(DataSourceReader):
    """Rows in file order; file_id and pos tell them apart.  Fixed records are read by range."""

    def __init__(self, files: list[str], schema: T.StructType, types: dict[str, str]):
        self.files, self.names, self.types = files, schema.names, types

    def partitions(self) -> list[Range]:
        out = []
        for i, uri in enumerate(self.files):
            with File(uri) as f:
                head = header(f.read)
                start, v = start_of_vertices(f.read, f.size, head), head.vertex
            step = ROWS if v.fixed and head.form != "ascii" else max(1, v.count)
            out += [Range(i, uri, a, min(step, v.count - a), start) for a in range(0, v.count, step)]
        return out or [Range(-1, "", 0, 0, 0)]

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        if part.file_id < 0:
            return
        with File(part.uri) as f:
            head = header(f.read)
            v = head.vertex
            if head.form == "ascii":
                lines = f.read(head.size, f.size - head.size).decode("ascii").split("\n")[part.start : part.start + v.count]
                at = {n: i for i, (n, _, _) in enumerate(v.properties)}
                rows = [x.split() for x in lines]
                if not v.fixed:
                    raise ValueError("vertices with lists are not read from text")
                if len(rows) < v.count or any(len(r) < len(at) for r in rows):
                    raise ValueError("the PLY file is cut short")
                data = {n: np.array([float(r[i]) for r in rows]).astype(NUMPY_TYPES[t]) for (n, t, _), i in zip(v.properties, at.values(), strict=True)}
            elif v.fixed:
                d = v.dtype(head.order)
                raw = np.frombuffer(f.read(part.start + part.first * d.itemsize, part.count * d.itemsize), d)
                data = {n: raw[n].astype(NUMPY_TYPES[t]) for n, t, _ in v.properties}
            else:
                data = self._records(f.read, head, part.start)
        n = part.count
        for a in range(0, n, 1 << 16):
            m = min(1 << 16, n - a)
            data_here = {"file_id": np.full(m, part.file_id, np.int32), "pos": np.arange(part.first + a, part.first + a + m)}
            data_here |= {canonical(k): x[a : a + m] for k, x in data.items()}
            kinds = {"<u1": "<i2", "<u2": "<i4", "<u4": "<i8"}
            # what only other files have is zero, and a missing colour white
            data_here |= {k: np.full(m, 255 if t == "uint8" and k in COLOURS else 0, NUMPY_TYPES[t]) for k, t in self.types.items() if k not in data_here}
            yield pa.RecordBatch.from_pydict({k: data_here[k].astype(kinds.get(data_here[k].dtype.newbyteorder("<").str.replace("|", "<"), data_here[k].dtype)) for k in self.names})

    @staticmethod
    def _records(read, head: Header, at: int) -> dict[str, np.ndarray]:
        out: dict[str, list] = {n: [] for n, _, length in head.vertex.properties if not length}
        for _ in range(head.vertex.count):
            for name, kind, length in head.vertex.properties:
                d = np.dtype(NUMPY_TYPES[kind].replace("<", head.order))
                if length:
                    n = np.dtype(NUMPY_TYPES[length].replace("<", head.order))
                    at += n.itemsize + int(np.frombuffer(read(at, n.itemsize), n)[0]) * d.itemsize
                else:
                    out[name].append(np.frombuffer(read(at, d.itemsize), d)[0])
                    at += d.itemsize
        return {n: np.array(out[n]).astype(NUMPY_TYPES[t]) for n, t, length in head.vertex.properties if not length}


class PlySource(DataSource):
    """spark.read.format("lodestone_ply").load(path): vertices with all properties that any of the files has, as they stand."""

    @classmethod
    def name(cls) -> str:
        return "lodestone_ply"

    def _files(self) -> list[str]:
        return listed(self.options["path"], ("ply",))

    def _types(self) -> dict[str, str]:
        each = []
        for uri in self._files():
            with File(uri) as f:
                each.append({canonical(n): t for n, t, length in header(f.read).vertex.properties if not length})
        return merged_types(each)

    def schema(self) -> T.StructType:
        return T.StructType([T.StructField("file_id", T.IntegerType()), T.StructField("pos", T.LongType()), *(column(n, t) for n, t in self._types().items())])

    def reader(self, schema: T.StructType) -> Reader:
        return Reader(self._files(), schema, self._types())


def _find(names: list[str], wanted: str) -> str | None:
    """The property of a requested attribute: its name, with scalar_ before it, or a normal's other spelling."""
    for c in (wanted, f"scalar_{wanted}", f"normal_{wanted[1:]}" if wanted in ("nx", "ny", "nz") else "", f"n{wanted[-1]}" if wanted in ("normal_x", "normal_y", "normal_z") else ""):
        if c in names:
            return c
    return None


def read_points(spark: SparkSession, path: str, attributes: list[str] | tuple[str, ...] = ()) -> DataFrame:
    """Points of one PLY file or a folder: file_id, pos, x, y, z, r, g, b and the attributes that the file has.

    Points without a finite position are left out.  Colours without a
    property are white; sixteen-bit ones are shifted, real ones scaled from 0..1.
    """
    ship(spark)
    spark.dataSource.register(PlySource)
    raw = spark.read.format("lodestone_ply").load(path)
    names = raw.columns
    if {"f_dc_0", "opacity"} <= set(names):
        raise ValueError("this PLY file holds splats")
    if any(n.startswith("packed_") for n in names):
        raise ValueError("compressed PLY files are not read")
    if not {"x", "y", "z"} <= set(names):
        raise ValueError("vertices need x, y and z")
    colours = []
    for c, long in zip("rgb", ("red", "green", "blue"), strict=True):
        source = next((n for n in (long, c, f"diffuse_{long}") if n in names), None)
        v = F.col(source).cast("double") if source else F.lit(255.0)
        kind = raw.schema[source].metadata.get("attr_type") if source else "uint8"
        if kind in ("float32", "float64"):
            v = F.floor(F.least(F.greatest(F.coalesce(v, F.lit(0.0)), F.lit(0.0)), F.lit(1.0)) * 255 + 0.5)
        elif kind == "uint16":
            v = F.shiftright(F.floor(F.least(F.greatest(v, F.lit(0.0)), F.lit(65535.0)) + 0.5).cast("int"), 8)
        colours.append(F.least(F.greatest(v, F.lit(0)), F.lit(255)).cast("short").alias(c))
    own = {"x", "y", "z", "red", "green", "blue", "r", "g", "b"}
    found = {a: _find(names, canonical(a)) for a in attributes}
    extra = [F.col(s).alias(canonical(a), metadata=raw.schema[s].metadata) for a, s in found.items() if s and s not in own]
    xyz = [F.col(a).cast("double").alias(a) for a in "xyz"]
    out = raw.select("file_id", "pos", *xyz, *colours, *extra)
    return out.filter(finite(F.col("x")) & finite(F.col("y")) & finite(F.col("z")))


_SPLAT = ["x", "y", "z", "f_dc_0", "f_dc_1", "f_dc_2", "opacity", "scale_0", "scale_1", "scale_2", "rot_0", "rot_1", "rot_2", "rot_3"]


def read_splats(spark: SparkSession, path: str) -> DataFrame:
    """Splats: source_index, centre, unit quaternion, scales, opacity, base colour and sh_rest (coefficients of r, g, b).

    Opacity is stored as a logit, scales as logarithms.  Splats that aren't
    finite, or whose quaternion is zero, are left out.
    """
    ship(spark)
    spark.dataSource.register(PlySource)
    raw = spark.read.format("lodestone_ply").load(path)
    if missing := [n for n in _SPLAT if n not in raw.columns]:
        raise ValueError(f"splats need {', '.join(missing)}")
    rest = sum(n.startswith("f_rest_") for n in raw.columns)
    if rest not in (0, 9, 24, 45) or any(f"f_rest_{i}" not in raw.columns for i in range(rest)):
        raise ValueError("f_rest properties number 0, 9, 24 or 45, without gaps")
    each = rest // 3
    norm = F.sqrt(sum((F.col(f"rot_{i}").cast("double") * F.col(f"rot_{i}") for i in range(4)), F.lit(0.0)))
    sh = [F.struct(*(F.col(f"f_rest_{c * each + k}").cast("double").alias(n) for c, n in enumerate("rgb"))) for k in range(each)]
    sh_rest = F.array(*sh) if sh else F.array().cast("array<struct<r:double,g:double,b:double>>")
    d = lambda n: F.col(n).cast("double")
    out = raw.withColumn("_n", norm).filter(finite(F.col("_n")) & (F.col("_n") > 0))
    ok = None
    for n in [*_SPLAT, *(f"f_rest_{i}" for i in range(rest))]:
        ok = finite(F.col(n)) if ok is None else ok & finite(F.col(n))
    return out.filter(ok).select(
        F.col("pos").alias("source_index"),
        *(d(a).alias(f"c{a}") for a in "xyz"),
        *((d(f"rot_{i}") / F.col("_n")).alias(q) for i, q in enumerate(("qw", "qx", "qy", "qz"))),
        *(F.exp(d(f"scale_{i}")).alias(f"s{a}") for i, a in enumerate("xyz")),
        sigmoid(d("opacity")).alias("opacity"),
        *(d(f"f_dc_{i}").alias(f"sh0_{c}") for i, c in enumerate("rgb")),
        sh_rest.alias("sh_rest"),
    )

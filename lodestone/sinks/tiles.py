"""Tile contents: PNTS and GLB, from the points of one tile."""

from __future__ import annotations

import json
import struct
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .. import model
from ..job import ship
from . import meshopt

GENERATOR = "lodestone"
SCHEMA_ID = "lodestone_points"

# component types of 3D Tiles batch tables and of glTF (fixed values)
_BATCH = {"int8": "BYTE", "uint8": "UNSIGNED_BYTE", "int16": "SHORT", "uint16": "UNSIGNED_SHORT", "int32": "INT", "uint32": "UNSIGNED_INT", "float32": "FLOAT", "float64": "DOUBLE"}
_GLTF = {"int8": 5120, "uint8": 5121, "int16": 5122, "uint16": 5123, "float32": 5126}
_Y_UP = [1, 0, 0, 0, 0, 0, -1, 0, 0, 1, 0, 0, 0, 0, 0, 1]

#: (name, type in the output)
Attributes = list[tuple[str, str]]


def _padded(data: bytes, size: int, filler: bytes) -> bytes:
    return data + filler * (-len(data) % size)


def _arrays(table: pa.Table, attributes: Attributes) -> tuple[np.ndarray, np.ndarray, dict[str, np.ndarray]]:
    xyz = np.stack([table.column(a).to_numpy() for a in "xyz"], axis=1).astype("<f4")
    rgb = np.stack([table.column(c).to_numpy() for c in "rgb"], axis=1).astype("u1")
    return xyz, rgb, {n: np.array(table.column(n).fill_null(False if pa.types.is_boolean(table.column(n).type) else 0).to_numpy(zero_copy_only=False)).astype(model.NUMPY_TYPES[t]) for n, t in attributes}


def pnts(table: pa.Table, attributes: Attributes) -> bytes:
    xyz, rgb, extra = _arrays(table, attributes)
    feature = {"POINTS_LENGTH": len(xyz), "POSITION": {"byteOffset": 0}, "RGB": {"byteOffset": xyz.nbytes}}
    # JSON ends so that what follows it starts at a multiple of eight
    feature_json = json.dumps(feature, separators=(",", ":")).encode()
    feature_json += b" " * (-(28 + len(feature_json)) % 8)
    feature_bin = _padded(xyz.tobytes() + rgb.tobytes(), 8, b"\0")
    batch, body = {}, b""
    for name, kind in attributes:
        body = _padded(body, max(1, extra[name].itemsize), b"\0")
        batch[model.output_name(name)] = {"byteOffset": len(body), "componentType": _BATCH[kind], "type": "SCALAR"}
        body += extra[name].tobytes()
    batch_json = _padded(json.dumps(batch, separators=(",", ":")).encode(), 8, b" ") if batch else b""
    body = _padded(body, 8, b"\0")
    sizes = len(feature_json), len(feature_bin), len(batch_json), len(body)
    return struct.pack("<4sIIIIII", b"pnts", 1, 28 + sum(sizes), *sizes) + feature_json + feature_bin + batch_json + body


def metadata_schema(attributes: Attributes) -> dict:
    """The class of a point's attributes, in order."""
    properties = {model.output_name(n): {"type": "SCALAR", "componentType": t.upper()} for n, t in attributes}
    return {"id": SCHEMA_ID, "classes": {"point": {"properties": properties}}}


def container(document: dict, binary: bytes) -> bytes:
    """A GLB file."""
    text = _padded(json.dumps(document, separators=(",", ":")).encode(), 4, b" ")
    binary = _padded(binary, 4, b"\0")
    parts = struct.pack("<I4s", len(text), b"JSON") + text + (struct.pack("<I4s", len(binary), b"BIN\0") + binary if binary else b"")
    return struct.pack("<4sII", b"glTF", 2, 12 + len(parts)) + parts


def _document(accessors: list[dict], views: list[dict], names: dict[str, int], size: int, attributes: Attributes, matrix: list[float] = _Y_UP) -> dict:
    out = {
        "asset": {"version": "2.0", "generator": GENERATOR},
        "scene": 0,
        "scenes": [{"nodes": [0]}],
        "nodes": [{"mesh": 0, "matrix": list(matrix)}],
        "meshes": [{"primitives": [{"attributes": names, "mode": 0}]}],
        "accessors": accessors,
        "bufferViews": views,
        "buffers": [{"byteLength": size}],
    }
    if attributes:
        table = {"class": "point", "properties": {model.output_name(n): {"attribute": model.output_name(n, "glb")} for n, _ in attributes}}
        out["extensionsUsed"] = ["EXT_structural_metadata"]
        out["extensions"] = {"EXT_structural_metadata": {"schema": metadata_schema(attributes), "propertyAttributes": [table]}}
        out["meshes"][0]["primitives"][0]["extensions"] = {"EXT_structural_metadata": {"propertyAttributes": [0]}}
    return out


def linear(rgb: np.ndarray) -> np.ndarray:
    """Eight-bit sRGB to linear, with a gamma of 2.2 and truncated."""
    return ((np.arange(256) / 255) ** 2.2 * 255).astype("u1")[rgb]


def _wide(v: np.ndarray) -> np.ndarray:
    """Values four bytes apart."""
    out = np.zeros((len(v), 4), dtype="u1")
    out[:, : v.itemsize] = v.view("u1").reshape(len(v), -1)
    return out


def glb(table: pa.Table, attributes: Attributes) -> bytes:
    """Positions and colours interleaved, sixteen bytes a point; each attribute after them, four bytes a point."""
    xyz, rgb, extra = _arrays(table, attributes)
    n = len(xyz)
    both = np.zeros((n, 16), dtype="u1")
    both[:, :12], both[:, 12:15], both[:, 15] = xyz.view("u1").reshape(n, 12), linear(rgb), 255
    views = [{"buffer": 0, "byteOffset": 0, "byteLength": 16 * n, "byteStride": 16, "target": 34962}]
    accessors = [
        {"bufferView": 0, "byteOffset": 0, "componentType": 5126, "count": n, "type": "VEC3", "min": xyz.min(axis=0).tolist(), "max": xyz.max(axis=0).tolist()},
        {"bufferView": 0, "byteOffset": 12, "componentType": 5121, "normalized": True, "count": n, "type": "VEC4"},
    ]
    names, body = {"POSITION": 0, "COLOR_0": 1}, both.tobytes()
    for name, kind in attributes:
        views.append({"buffer": 0, "byteOffset": len(body), "byteLength": 4 * n, "byteStride": 4, "target": 34962})
        accessors.append({"bufferView": len(views) - 1, "byteOffset": 0, "componentType": _GLTF[kind], "count": n, "type": "SCALAR"})
        names[model.output_name(name, "glb")] = len(accessors) - 1
        body += _wide(extra[name]).tobytes()
    return container(_document(accessors, views, names, len(body), attributes), body)


def compressed_glb(table: pa.Table, attributes: Attributes, extension: str = "EXT_meshopt_compression") -> bytes:
    """Positions as sixteen-bit integers of the tile's box, and every stream packed by the meshopt attribute codec."""
    xyz, rgb, extra = _arrays(table, attributes)
    n, low = len(xyz), xyz.min(axis=0).astype(np.float64)
    size = xyz.max(axis=0) - low
    size[size <= 0] = 1
    q = np.zeros((n, 4), dtype="<u2")
    q[:, :3] = np.clip(np.floor((xyz - low) / size * 65535 + 0.5), 0, 65535)
    colour = np.full((n, 4), 255, dtype="u1")
    colour[:, :3] = linear(rgb)
    streams = [("POSITION", q.view("u1").reshape(n, 8), 5123, "VEC3", True), ("COLOR_0", colour, 5121, "VEC4", True)]
    streams += [(model.output_name(name, "glb"), _wide(extra[name]), _GLTF[kind], "SCALAR", False) for name, kind in attributes]
    views, accessors, names, body, plain = [], [], {}, b"", 0
    for name, data, kind, shape, norm in streams:
        # the first extension knows version 0 alone
        packed = meshopt.encode(data) if extension == "EXT_meshopt_compression" else meshopt.encode_1(data)
        stride = data.shape[1]
        views.append({"buffer": 1, "byteOffset": plain, "byteLength": n * stride, "byteStride": stride, "target": 34962, "extensions": {extension: {"buffer": 0, "byteOffset": len(body), "byteLength": len(packed), "byteStride": stride, "count": n, "mode": "ATTRIBUTES"}}})
        accessor = {"bufferView": len(views) - 1, "byteOffset": 0, "componentType": kind, "count": n, "type": shape} | ({"normalized": True} if norm else {})
        if name == "POSITION":
            accessor |= {"min": q[:, :3].min(axis=0).tolist(), "max": q[:, :3].max(axis=0).tolist()}
        names[name] = len(accessors)
        accessors.append(accessor)
        body, plain = _padded(body + packed, 4, b"\0"), plain + n * stride + (-n * stride % 4)
    # the node's matrix undoes the quantisation, then turns Z up to Y up
    scale, (x, y, z) = size, low
    matrix = [scale[0], 0, 0, 0, 0, 0, -scale[1], 0, 0, scale[2], 0, 0, x, z, -y, 1]
    out = _document(accessors, views, names, len(body), attributes, [float(v) for v in matrix])
    out["buffers"] = [{"byteLength": len(body)}, {"byteLength": plain, "extensions": {extension: {"fallback": True}}}]
    out["extensionsUsed"] = [*out.get("extensionsUsed", []), extension, "KHR_mesh_quantization"]
    out["extensionsRequired"] = [extension, "KHR_mesh_quantization"]
    return container(out, body)


#: Encoders by name: (function, file ending, 3D Tiles version, output type table).
ENCODERS: dict[str, tuple[Callable[[pa.Table, Attributes], bytes], str, str, str]] = {
    "pnts": (pnts, "pnts", "1.0", "pnts"),
    "glb": (glb, "glb", "1.1", "glb"),
    "glb-compressed": (compressed_glb, "glb", "1.1", "glb"),
    "glb-compressed-khr": (lambda t, a: compressed_glb(t, a, "KHR_meshopt_compression"), "glb", "1.1", "glb"),
}


def register_encoder(name: str, encode: Callable[[pa.Table, Attributes], bytes], ending: str, version: str, types: str) -> None:
    if name in ENCODERS:
        raise ValueError(f"there is an encoder {name}")
    ENCODERS[name] = encode, ending, version, types


def content_path(tile: str, ending: str) -> str:
    """One folder for each level below the root: the digits of the path."""
    return "/".join(["data", *tile[1:], f"content.{ending}"])


def encoded(tiles: DataFrame, encoder: str) -> DataFrame:
    """(tile, path, content) of points with their tile.  A tile's points meet in one group, whose size the plan bounds."""
    ship(tiles.sparkSession)
    make, ending, _, types = ENCODERS[encoder]
    attributes = [(f.name, t) for f, t in model.exported(tiles, types)]

    def run(table: pa.Table) -> pa.Table:
        tile = table.column("tile")[0].as_py()
        table = table.sort_by("point_id") if "point_id" in table.column_names else table
        return pa.table({"tile": [tile], "path": [content_path(tile, ending)], "content": pa.array([make(table, attributes)], pa.binary())})

    return tiles.groupBy("tile").applyInArrow(run, "tile string, path string, content binary")


def through(middleware: list[Callable[[str, bytes], tuple[str, bytes]]], path: str, content: bytes) -> tuple[str, bytes]:
    for step in middleware:
        path, content = step(path, content)
    return path, content


def written(contents: DataFrame, folder: str, middleware: list[Callable[[str, bytes], tuple[str, bytes]]] = []) -> DataFrame:  # noqa: B006
    """Write each content, as the middleware leaves it, to its path under the folder; (tile, path, bytes).

    A path depends on the tile alone and its content on its points, so an
    attempt that is run again writes the same file.
    """

    def run(batches):
        from ..storage import write

        for b in batches:
            pairs = [through(middleware, p, c) for p, c in zip(b.column("path").to_pylist(), b.column("content").to_pylist(), strict=True)]
            for path, content in pairs:
                write(f"{folder}/{path}", content)
            yield pa.RecordBatch.from_arrays([b.column("tile"), pa.array([p for p, _ in pairs]), pa.array([len(c) for _, c in pairs], pa.int64())], names=["tile", "path", "bytes"])

    return contents.select("tile", "path", "content").mapInArrow(run, "tile string, path string, bytes long")

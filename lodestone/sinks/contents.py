"""Tile contents read back: positions with Z up, colours, and attributes under their output names."""

from __future__ import annotations

import json
import struct

import numpy as np

from . import meshopt

_BATCH = {"BYTE": "<i1", "UNSIGNED_BYTE": "<u1", "SHORT": "<i2", "UNSIGNED_SHORT": "<u2", "INT": "<i4", "UNSIGNED_INT": "<u4", "FLOAT": "<f4", "DOUBLE": "<f8"}
_GLTF = {5120: "<i1", 5121: "<u1", 5122: "<i2", 5123: "<u2", 5125: "<u4", 5126: "<f4"}
_COMPONENTS = {"SCALAR": 1, "VEC2": 2, "VEC3": 3, "VEC4": 4}


def decode_pnts(raw: bytes) -> dict[str, np.ndarray]:
    magic, version, size, a, b, c, _ = struct.unpack_from("<4s6I", raw)
    if magic != b"pnts" or version != 1 or size != len(raw):
        raise ValueError("not a PNTS tile")
    feature, n = json.loads(raw[28 : 28 + a]), json.loads(raw[28 : 28 + a])["POINTS_LENGTH"]
    at = 28 + a
    xyz = np.frombuffer(raw, "<f4", 3 * n, at + feature["POSITION"]["byteOffset"]).reshape(n, 3)
    rgb = np.frombuffer(raw, "u1", 3 * n, at + feature["RGB"]["byteOffset"]).reshape(n, 3)
    out = {k: xyz[:, i].astype(np.float64) for i, k in enumerate("xyz")} | {k: rgb[:, i] for i, k in enumerate("rgb")}
    at += b
    for name, where in (json.loads(raw[at : at + c]) if c else {}).items():
        out[name] = np.frombuffer(raw, _BATCH[where["componentType"]], n, at + c + where["byteOffset"])
    return out


def document(raw: bytes) -> tuple[dict, bytes]:
    """The JSON and the binary part of a GLB file."""
    magic, version, size = struct.unpack_from("<4sII", raw)
    if magic != b"glTF" or version != 2 or size != len(raw):
        raise ValueError("not a GLB file")
    n = struct.unpack_from("<I", raw, 12)[0]
    return json.loads(raw[20 : 20 + n]), raw[28 + n :]


def _values(doc: dict, body: bytes, accessor: dict) -> np.ndarray:
    view, kind = doc["bufferViews"][accessor["bufferView"]], np.dtype(_GLTF[accessor["componentType"]])
    n, width, stride = accessor["count"], _COMPONENTS[accessor["type"]], view.get("byteStride", 0)
    packed = next((e for name, e in view.get("extensions", {}).items() if "meshopt" in name), None)
    if packed:
        part = body[packed["byteOffset"] : packed["byteOffset"] + packed["byteLength"]]
        rows = (meshopt.decode if part[0] == 0xA0 else meshopt.decode_1)(part, n, stride)
    else:
        rows = np.frombuffer(body, "u1", n * stride, view.get("byteOffset", 0)).reshape(n, stride)
    at = accessor.get("byteOffset", 0)
    out = np.ascontiguousarray(rows[:, at : at + width * kind.itemsize]).view(kind).reshape(n, width)
    return out / np.iinfo(kind).max if accessor.get("normalized") and kind.kind == "u" else out


def decode_glb(raw: bytes) -> dict[str, np.ndarray]:
    doc, body = document(raw)
    names = doc["meshes"][0]["primitives"][0]["attributes"]
    read = {k: _values(doc, body, doc["accessors"][a]) for k, a in names.items()}
    matrix = np.array(doc["nodes"][0]["matrix"]).reshape(4, 4).T
    x, up, south = (read["POSITION"].astype(np.float64) @ matrix[:3, :3].T + matrix[:3, 3]).T
    out = {"x": x, "y": -south, "z": up}
    out |= {k: np.floor(read["COLOR_0"][:, i] * 255 + 0.5).astype(np.int64) for i, k in enumerate("rgb")}
    return out | {k.lstrip("_"): v[:, 0] for k, v in read.items() if k not in ("POSITION", "COLOR_0")}


def decode(raw: bytes) -> dict[str, np.ndarray]:
    return decode_pnts(raw) if raw[:4] == b"pnts" else decode_glb(raw)

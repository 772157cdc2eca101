"""The tileset index, its split over several files, and 3TZ archives."""

from __future__ import annotations

import hashlib
import io
import json
import math
import posixpath
import struct
import zipfile
import zlib
from collections import deque
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

import numpy as np

from ..storage import listed, opened, write

INDEX = "@3dtilesIndex1@"
READERS, READ_AHEAD = 8, 8 << 20  # threads that read files for an archive, and bytes that each holds


@dataclass
class Tile:
    path: str
    box: tuple[float, float, float, float, float, float]  # xmin, xmax, ymin, ...
    error: float
    content: str | None = None
    refine: str = "ADD"
    children: list[Tile] = field(default_factory=list)
    transform: list[float] | None = None

    @property
    def size(self) -> int:
        return 1 + sum(c.size for c in self.children)


def five_digits(v: float) -> float:
    return float(f"{v:.4e}")


def outward(low: float, high: float) -> tuple[float, float]:
    """Moved out to a power-of-ten grid of about six digits of the size."""
    size = high - low
    scale = 10.0 ** (min(9, max(0, 6 - math.floor(math.log10(size)))) if size > 0 else 9)
    return math.floor(low * scale) / scale, math.ceil(high * scale) / scale


def box_json(box) -> list[float]:
    sides = [outward(box[2 * i], box[2 * i + 1]) for i in range(3)]
    out = [(a + b) / 2 for a, b in sides]
    for i, (a, b) in enumerate(sides):
        axis = [0.0, 0.0, 0.0]
        axis[i] = (b - a) / 2
        out += axis
    return out


def tree(nodes: list[dict], ending: str, refine: str = "ADD", transform: list[float] | None = None, content_path=None) -> Tile:
    """From rows with path, n, bounds and error; tiles without points of their own give way to their children."""
    from .tiles import content_path as default

    made: dict[str, Tile] = {}
    for r in sorted(nodes, key=lambda r: r["path"]):
        box = tuple(r[f"{a}{m}"] for a in "xyz" for m in ("min", "max"))
        made[r["path"]] = Tile(r["path"], box, r["error"], (content_path or default)(r["path"], ending) if r["n"] else None, refine)
    root = made[min(made, key=len)]
    root.transform = transform
    for path in sorted(made, key=len, reverse=True):
        if path == root.path:
            continue
        parent = path[:-1]
        tile = made[path]
        made[parent].children += [tile] if tile.content else tile.children
    for t in made.values():
        t.children.sort(key=lambda c: c.path)
    return root


def subtree_sizes(root: Tile) -> dict[str, int]:
    """By path, how many tiles a tile and those below it are."""
    out = {root.path: 1}
    for c in root.children:
        below = subtree_sizes(c)
        out |= below
        out[root.path] += below[c.path]
    return out


def _relative(to: str, base: str) -> str:
    return posixpath.relpath(to, posixpath.dirname(base) or ".")


def index_files(root: Tile, most: int = 2000, version: str = "1.1", properties: dict | None = None, extra: dict | None = None, factor: float = 1.0) -> dict[str, str]:
    """JSON by path; external files come first and tileset.json last.

    A file holds up to ``most`` tiles.  Breadth first, a subtree of at most an eighth of that stays if there
    is room; one of at most ``most``, or for which there is none, goes to a file of its own.
    """
    files: dict[str, str] = {}
    names: set[str] = {"tileset.json"}

    def named(tile: Tile) -> str:
        base, k = f"tileset_{tile.path}", 1
        while (name := f"{base}.json" if k == 1 else f"{base}_{k}.json") in names:
            k += 1
        names.add(name)
        return name

    def save(top: Tile, name: str) -> None:
        external: dict[int, str] = {}
        room, queue = most - 1, deque([top])
        while queue:
            tile = queue.popleft()
            for child in tile.children:
                n = child.size
                if n <= max(1, most // 8) and n <= room:
                    room -= n
                elif n <= most or room < 1:
                    external[id(child)] = named(child)
                else:
                    room -= 1
                    queue.append(child)
        for child, other in [(c, external[id(c)]) for c in _walk(top, external) if id(c) in external]:
            save(child, other)

        def node(tile: Tile, parent_refine: str | None) -> dict:
            out: dict = {"boundingVolume": {"box": box_json(tile.box)}, "geometricError": five_digits(tile.error * factor)}
            if id(tile) in external and tile is not top:
                return out | {"content": {"uri": _relative(external[id(tile)], name)}}
            if tile.refine != parent_refine:
                out["refine"] = tile.refine
            if tile.transform:
                out["transform"] = tile.transform
            if tile.content:
                out["content"] = {"uri": _relative(tile.content, name)}
            if tile.children:
                out["children"] = [node(c, tile.refine) for c in tile.children]
            return out

        whole: dict = {"asset": {"version": version}, "geometricError": five_digits(top.error * factor)}
        if name == "tileset.json":
            whole |= ({"properties": properties} if properties and version == "1.0" else {}) | (extra or {})
        files[name] = json.dumps(whole | {"root": node(top, None)}, separators=(",", ":"))

    save(root, "tileset.json")
    return files


def _walk(top: Tile, stop: dict[int, str]):
    """The tiles of one file, and those at which others begin."""
    for child in top.children:
        yield child
        if id(child) not in stop:
            yield from _walk(child, stop)


def range_metadata(ranges: list[dict], version: str) -> tuple[dict | None, dict | None]:
    """(properties of 1.0, extra parts of 1.1) from rows of attribute, min and max."""
    from ..model import output_name

    seen = [r for r in ranges if r["min"] is not None]
    if version == "1.0":
        return {output_name(r["attribute"]): {"minimum": r["min"], "maximum": r["max"]} for r in seen}, None
    values = {f"{end}_{output_name(r['attribute'])}": r[key] for r in seen for end, key in (("MIN", "min"), ("MAX", "max"))}
    schema = {"id": "lodestone_dataset", "classes": {"dataset": {"properties": {k: {"type": "SCALAR", "componentType": "FLOAT64"} for k in values}}}}
    return None, {"schema": schema, "metadata": {"class": "dataset", "properties": values}} if values else None


def write_index(folder: str, files: dict[str, str], middleware: list = []) -> None:  # noqa: B006
    from .tiles import through

    for name, text in files.items():
        path, content = through(middleware, name, text.encode())
        write(f"{folder}/{path}", content)


# ---------------------------------------------------------------- 3TZ


def index_order(name: str) -> tuple[int, int]:
    return struct.unpack("<QQ", hashlib.md5(name.encode()).digest())


def archive(files: dict[str, bytes]) -> bytes:
    """A 3TZ archive: a ZIP whose last entry is an index of MD5 hashes and places, in their order."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
        for name, data in files.items():
            z.writestr(zipfile.ZipInfo(name), data)
        entries = sorted((index_order(i.filename), i.filename, i.header_offset) for i in z.infolist())
        index = b"".join(hashlib.md5(n.encode()).digest() + struct.pack("<Q", at) for _, n, at in entries)
        z.writestr(zipfile.ZipInfo(INDEX), index)
    return out.getvalue()


class Entries:
    """The entries of a 3TZ archive behind ``read(offset, length)``, of which only the index, once, and asked entries are read."""

    RUN, GAP = 8 << 20, 64 << 10  # bytes read at once, and bytes between entries that are read along

    def __init__(self, read, size: int):
        self.read = read
        tail_at = max(0, size - (1 << 17))
        tail = read(tail_at, size - tail_at)
        at = len(tail)
        while (at := tail.rfind(INDEX.encode(), 0, at)) >= 0:  # its header ends the central directory
            head = tail[max(0, at - 46) : at]
            if len(head) == 46 and head[:4] == b"PK\x01\x02":
                n_name, n_extra, n_comment = struct.unpack_from("<HHH", head, 28)
                end = at + n_name + n_extra + n_comment
                if n_name == len(INDEX) and tail[end : end + 4] in (b"PK\x05\x06", b"PK\x06\x06"):
                    break
        if at < 0:
            raise ValueError("the archive doesn't end with an index")
        length, extra = struct.unpack_from("<I", head, 24)[0], tail[at + n_name : at + n_name + n_extra]
        self.end = struct.unpack_from("<I", head, 42)[0]
        while self.end == 0xFFFFFFFF and len(extra) >= 4:
            kind, n = struct.unpack_from("<HH", extra)
            if kind == 1:  # ZIP64; sizes don't overflow
                self.end = struct.unpack_from("<Q", extra, 4)[0]
            extra = extra[4 + n :]
        local = read(self.end, 30)
        raw = read(self.end + 30 + sum(struct.unpack_from("<HH", local, 26)), length)
        if len(raw) != length or length % 24:
            raise ValueError("the index is damaged")
        self.index = np.frombuffer(raw, [("high", "<u8"), ("low", "<u8"), ("at", "<u8")])
        self.places = np.unique(np.append(self.index["at"], np.uint64(self.end)))

    def place(self, name: str) -> int | None:
        high, low = index_order(name)
        i = int(np.searchsorted(self.index["high"], np.uint64(high)))
        while i < len(self.index) and int(self.index["high"][i]) == high:
            if int(self.index["low"][i]) == low:
                return int(self.index["at"][i])
            i += 1
        return None

    def find(self, names: list[str | None]) -> list[bytes | None]:
        """The contents of many entries, those that lie close together by one read; None for what isn't there."""
        places = [None if n is None else self.place(n) for n in names]
        wanted = sorted({p for p in places if p is not None})
        ends = [int(self.places[i]) for i in np.searchsorted(self.places, np.array(wanted, dtype=np.uint64), "right")]
        got: dict[int, bytes] = {}
        first = 0
        for i, at in enumerate(wanted):
            if i + 1 < len(wanted) and wanted[i + 1] - ends[i] <= self.GAP and ends[i + 1] - wanted[first] <= self.RUN:
                continue
            raw, start = self.read(wanted[first], ends[i] - wanted[first]), wanted[first]
            for at in wanted[first : i + 1]:
                size, *skip = struct.unpack_from("<I4xHH", raw, at - start + 18)
                begin = at - start + 30 + sum(skip)
                got[at] = raw[begin : begin + size]
            first = i + 1
        return [None if p is None else got[p] for p in places]


def find(raw: bytes, name: str) -> bytes | None:
    """An entry of an archive, by its index."""
    return Entries(lambda at, n: raw[at : at + n], len(raw)).find([name])[0]


class _Zip:
    """Stored entries to a stream that can't be sought in; local headers hold the sizes."""

    def __init__(self, stream):
        self.stream, self.at, self.entries = stream, 0, []

    def _put(self, data: bytes) -> None:
        self.stream.write(data)
        self.at += len(data)

    def add(self, name: str, data: bytes) -> None:
        raw, crc = name.encode(), zlib.crc32(data)
        self.entries.append((name, raw, crc, len(data), self.at))
        self._put(struct.pack("<4sHHHHHIIIHH", b"PK\x03\x04", 20, 0x800, 0, 0, 0x21, crc, len(data), len(data), len(raw), 0) + raw + data)

    def close(self) -> None:
        start = self.at
        for _, raw, crc, n, at in self.entries:
            extra = struct.pack("<HHQ", 1, 8, at) if at >= 0xFFFFFFFF else b""
            self._put(struct.pack("<4sHHHHHHIIIHHHHHII", b"PK\x01\x02", 45 if extra else 20, 45 if extra else 20, 0x800, 0, 0, 0x21, crc, n, n, len(raw), len(extra), 0, 0, 0, 0, min(at, 0xFFFFFFFF)) + raw + extra)
        size, many = self.at - start, len(self.entries)
        if many >= 0xFFFF or start >= 0xFFFFFFFF or size >= 0xFFFFFFFF:
            end = self.at
            self._put(struct.pack("<4sQHHIIQQQQ", b"PK\x06\x06", 44, 45, 45, 0, 0, many, many, size, start) + struct.pack("<4sIQI", b"PK\x06\x07", 0, end, 1))
        self._put(struct.pack("<4sHHHHIIH", b"PK\x05\x06", 0, 0, min(many, 0xFFFF), min(many, 0xFFFF), min(size, 0xFFFFFFFF), min(start, 0xFFFFFFFF), 0))


def package(folder: str, target: str) -> int:
    """A finished folder as one archive, streamed file by file in order of names; how many files it has.

    Each of a few threads reads ahead 64 files, of ``READ_AHEAD`` bytes together or one of any size.
    """
    from pyarrow import fs

    where, path = opened(folder)
    found = sorted((f.path, f.size) for f in where.get_file_info(fs.FileSelector(path, recursive=True)) if f.type == fs.FileType.File)
    to, at = opened(target)
    to.create_dir(at.rpartition("/")[0] or ".", recursive=True)

    def contents(files: list[str]) -> list[bytes]:
        out = []
        for f in files:
            with where.open_input_file(f) as source:
                out.append(source.read())
        return out

    groups: list[list[str]] = []
    room = 0
    for f, size in found:
        if not groups or room < size or len(groups[-1]) == 64:
            groups.append([])
            room = READ_AHEAD
        groups[-1].append(f)
        room -= size
    readers = 1 if isinstance(where, fs.LocalFileSystem) else READERS  # more hide latency, of which a disk has little
    with to.open_output_stream(at) as stream, ThreadPoolExecutor(readers) as pool:
        z = _Zip(stream)
        waiting: deque = deque()
        for group in [*groups, *[[]] * readers]:
            waiting.append((group, pool.submit(contents, group)))
            if len(waiting) > readers:
                done, read = waiting.popleft()
                for f, data in zip(done, read.result(), strict=True):
                    z.add(f[len(path) :].lstrip("/"), data)
        entries = sorted((index_order(n), n, p) for n, *_, p in z.entries)
        z.add(INDEX, b"".join(hashlib.md5(n.encode()).digest() + struct.pack("<Q", p) for _, n, p in entries))
        z.close()
    return len(found)


def move_root(folder: str, transform: list[float]) -> None:
    """Give a finished tileset another rigid root transform (16 numbers, column by column), by an atomic rename."""
    m = np.array(transform, dtype=np.float64).reshape(4, 4).T
    turn = m[:3, :3]
    s = np.cbrt(abs(np.linalg.det(turn)))
    if not np.isfinite(m).all() or s <= 0 or not np.allclose(turn.T @ turn, s * s * np.eye(3), atol=1e-6 * s * s) or not np.allclose(m[3], [0, 0, 0, 1]):
        raise ValueError("only a rigid transform with one scale is taken")
    where, path = opened(f"{folder}/tileset.json")
    with where.open_input_file(path) as f:
        whole = json.loads(f.read())
    whole["root"]["transform"] = [float(v) for v in transform]
    with where.open_output_stream(path + ".new") as f:
        f.write(json.dumps(whole, separators=(",", ":")).encode())
    where.move(path + ".new", path)


__all__ = ["INDEX", "Entries", "Tile", "archive", "find", "index_files", "listed", "move_root", "package", "range_metadata", "tree", "write_index"]

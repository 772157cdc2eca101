"""Bytes in any storage that pyarrow knows, by URI or path."""

from __future__ import annotations

from pyarrow import fs


def opened(uri: str):
    """(file system, path)"""
    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


class File:
    def __init__(self, uri: str):
        where, path = opened(uri)
        self.file = where.open_input_file(path)
        self.size = self.file.size()

    def read(self, at: int, n: int) -> bytes:
        return self.file.read_at(n, at)

    def __enter__(self):
        return self

    def __exit__(self, *_):
        self.file.close()


def write(uri: str, data: bytes) -> None:
    where, path = opened(uri)
    where.create_dir(path.rpartition("/")[0] or ".", recursive=True)
    with where.open_output_stream(path) as f:
        f.write(data)


def listed(uri: str, extensions: tuple[str, ...]) -> list[str]:
    """The file itself, or the files of a folder (not those below it) with one of the extensions, by name."""
    where, path = opened(uri)
    prefix = uri[: len(uri) - len(path)] if uri.endswith(path) else ""
    info = where.get_file_info(path)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(uri)
    if info.type == fs.FileType.File:
        return [uri]
    found = where.get_file_info(fs.FileSelector(path, recursive=False))
    return sorted(prefix + f.path for f in found if f.type == fs.FileType.File and f.extension.lower() in extensions)

"""WARC records in ZIP archives: a writer, and a reader that range-reads stored members without extraction.

An archive holds a stored member of gzipped records and a stored index of
them.  The reader finds the end record, the ZIP64 records where they are in use, the
central directory and each member's local header, then reads single records.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace, shared_dir, spread_join, text_bytes

LEAST = 1000  # bytes of a payload that may be revisited
ARCHIVE = 32 << 20  # bytes of gzipped records in an archive
RANGE = 4 << 20  # bytes of records that one row of the reader's plan stands for
RECORDS, INDEX = "records.warc.gz", "records.idx"

_END, _END64, _LOCATOR64, _ENTRY, _LOCAL = b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07", b"PK\x01\x02", b"PK\x03\x04"


# ---------------------------------------------------------------- records


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str = "2020-01-01T00:00:00Z") -> bytes:
    """A response with its payload, or a revisit of refers_to without it."""
    name = lambda i: f"<urn:page:{'' if i is None else i}>"
    target = "".join(c if 32 < ord(c) < 127 else "".join(f"%{b:02X}" for b in c.encode("utf-8", "replace")) for c in url or "")
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + (payload if refers_to is None else b"")
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {name(page_id)}",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {target}",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        head += [f"WARC-Refers-To: {name(refers_to)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


@dataclass
class Record:
    headers: dict[str, str]
    http: dict[str, str]
    payload: bytes

    @property
    def kind(self) -> str:
        return self.headers["warc-type"]

    @staticmethod
    def page(name: str | None) -> int | None:
        inner = (name or "").removeprefix("<urn:page:").removesuffix(">")
        return int(inner) if inner else None


def parse(raw: bytes) -> Record:
    def fields(text: bytes) -> dict[str, str]:
        pairs = (x.split(":", 1) for x in text.decode("utf-8", "replace").split("\r\n")[1:] if ":" in x)
        return {k.strip().lower(): v.strip() for k, v in pairs}

    head, found, rest = raw.partition(b"\r\n\r\n")
    if not found or not head.startswith(b"WARC/"):
        raise ValueError("not a WARC record")
    headers = fields(head)
    block = rest[: int(headers["content-length"])]
    if len(block) != int(headers["content-length"]):
        raise ValueError("a WARC record is cut short")
    http, _, payload = block.partition(b"\r\n\r\n")
    return Record(headers, fields(http), payload)


# ---------------------------------------------------------------- archives


@dataclass
class Member:
    name: str
    method: int
    size: int
    header: int  # place of its local header


class Archive:
    """A ZIP file behind ``read(offset, length)``, of which only directories and asked ranges are read."""

    def __init__(self, read, size: int):
        self.read = read
        tail_at = max(0, size - 65_557)
        tail = read(tail_at, size - tail_at)
        at = tail.rfind(_END)
        while at >= 0 and (at + 22 > len(tail) or at + 22 + struct.unpack_from("<H", tail, at + 20)[0] != len(tail)):
            at = tail.rfind(_END, 0, at)  # the mark may stand in the comment
        if at < 0:
            raise ValueError("no end of central directory")
        count, length, start = struct.unpack_from("<HII", tail, at + 10)
        if count == 0xFFFF or length == 0xFFFFFFFF or start == 0xFFFFFFFF:
            place = tail_at + at - 20
            locator = read(place, 20) if place >= 0 else b""
            if locator[:4] != _LOCATOR64:
                raise ValueError("no ZIP64 locator")
            end64 = read(struct.unpack_from("<Q", locator, 8)[0], 56)
            if end64[:4] != _END64:
                raise ValueError("no ZIP64 end of central directory")
            count, length, start = struct.unpack_from("<QQQ", end64, 32)
        self.members: dict[str, Member] = {}
        raw, at = read(start, length), 0
        for _ in range(count):
            if raw[at : at + 4] != _ENTRY:
                raise ValueError("the central directory is damaged")
            method, packed, plain, n_name, n_extra, n_comment = struct.unpack_from("<H8xIIHHH", raw, at + 10)
            header = struct.unpack_from("<I", raw, at + 42)[0]
            name = raw[at + 46 : at + 46 + n_name].decode("utf-8", "replace")
            extra = raw[at + 46 + n_name : at + 46 + n_name + n_extra]
            while len(extra) >= 4:
                kind, n = struct.unpack_from("<HH", extra)
                if kind == 1:  # ZIP64: only the fields that overflow, in this order
                    wide = list(struct.unpack_from(f"<{n // 8}Q", extra, 4))
                    plain = wide.pop(0) if plain == 0xFFFFFFFF else plain
                    packed = wide.pop(0) if packed == 0xFFFFFFFF else packed
                    header = wide.pop(0) if header == 0xFFFFFFFF else header
                extra = extra[4 + n :]
            self.members[name] = Member(name, method, packed, header)
            at += 46 + n_name + n_extra + n_comment

    def locate(self, name: str) -> tuple[int, int]:
        """Place and length of a stored member's bytes."""
        member = self.members[name]
        if member.method != 0:
            raise ValueError(f"{name} is not stored")
        local = self.read(member.header, 30)
        if local[:4] != _LOCAL:
            raise ValueError("a local header is damaged")
        return member.header + 30 + sum(struct.unpack_from("<HH", local, 26)), member.size


def archive(records: list[bytes]) -> bytes:
    """A ZIP of gzipped records and their index: lines of place and length."""
    ends = np.cumsum([len(r) for r in records])
    index = "".join(f"{e - len(r)} {len(r)}\n" for e, r in zip(ends.tolist(), records, strict=True))
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
        for name, data in ((RECORDS, b"".join(records)), (INDEX, index.encode())):
            with z.open(zipfile.ZipInfo(name), "w", force_zip64=True) as member:
                member.write(data)
    return out.getvalue()


def _opened(uri: str):
    where, path = fs.FileSystem.from_uri(uri)
    return where, path


class _File:
    def __init__(self, uri: str):
        where, path = _opened(uri)
        self.file = where.open_input_file(path)
        self.size = self.file.size()

    def read(self, at: int, n: int) -> bytes:
        return self.file.read_at(n, at)


# ---------------------------------------------------------------- operators


def _writing(folder: str, most: int):
    def run(items: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep, size = [], 0

        def out() -> pa.RecordBatch:
            # a name of its own: only what a finished attempt reports is read
            uri = f"{folder}/{uuid.uuid4().hex}.zip"
            where, path = _opened(uri)
            where.create_dir(path.rpartition("/")[0], recursive=True)
            with where.open_output_stream(path) as f:
                f.write(archive(keep))
            return pa.RecordBatch.from_arrays([pa.array([uri]), pa.array([len(keep)], pa.int64())], names=["archive", "records"])

        for batch in items:
            ids, urls, digests, refs = (batch.column(c).to_pylist() for c in ("page_id", "url", "digest", "refers_to"))
            for i, u, d, r, payload in zip(ids, urls, digests, refs, text_bytes(batch.column("html")), strict=True):
                keep.append(gzip.compress(record(i, u, payload, d, r), 1, mtime=0))
                size += len(keep[-1])
                if size > most:
                    yield out()
                    keep, size = [], 0
        if keep:
            yield out()

    return run


def write_archives(spark: SparkSession, pages: DataFrame, folder: str, least: int = LEAST, archive_bytes: int = ARCHIVE) -> DataFrame:
    """Write the pages (page_id, url, html) as archives in folder; (archive, records) for each.

    Of records with equal payloads of ``least`` bytes or more, that with the
    largest page_id is a response and the others revisit it.  Rows equal to the
    response in page_id too are responses; so are rows without a page_id, and smaller payloads.
    Null html is an empty payload.  No rows write no archive.  Very long payloads are written whole.
    Columns of any other names are left out.
    """
    ws = Workspace(spark, "warc")
    html = F.coalesce("html", F.lit(""))
    pages = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), html.alias("html"), F.sha1(F.encode(html, "UTF-8")).alias("digest"), F.octet_length(html).alias("bytes"))
    large = ws.keep(pages.filter((F.col("bytes") >= least) & F.col("page_id").isNotNull()).select("page_id", "digest", "bytes"), "large")
    last = large.groupBy("digest", "bytes").agg(F.max("page_id").alias("last"), F.min("page_id").alias("first"), F.count("*").alias("many"))
    last = ws.keep(last.filter("first < last").drop("first"), "last")
    revisits = spread_join(large, last, ["digest", "bytes"], "many").filter("page_id < last").select("page_id", "digest", F.col("last").alias("refers_to")).distinct()
    revisits = ws.keep(revisits, "revisits")
    made = pages.join(revisits, ["page_id", "digest"], "left").select("page_id", "url", "html", "digest", "refers_to")
    return ws.keep(made.mapInArrow(_writing(folder, archive_bytes), "archive string, records long"), "archives")


def _planned(most: int):
    def run(items: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in items:
            for uri in batch.column(0).to_pylist():
                file = _File(uri)
                found = Archive(file.read, file.size)
                start, _ = found.locate(RECORDS)
                at, n = found.locate(INDEX)
                index = np.array(file.read(at, n).split(), dtype=np.int64).reshape(-1, 2)
                if not len(index):
                    continue
                part = (np.cumsum(index[:, 1]) - 1) // most
                cut = np.flatnonzero(np.r_[True, np.diff(part) > 0])
                ranges = [(start + int(x[0, 0]), x[:, 1].tolist()) for x in np.split(index, cut[1:])]
                yield pa.RecordBatch.from_arrays([pa.array([uri] * len(ranges)), pa.array([a for a, _ in ranges], pa.int64()), pa.array([n for _, n in ranges], pa.list_(pa.int64()))], names=["archive", "start", "lengths"])

    return run


def _reading(payloads: bool):
    def run(items: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in items:
            for uri, start, lengths in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                raw, rows, at = _File(uri).read(start, sum(lengths)), [], 0
                for n in lengths:
                    x = parse(zlib.decompress(raw[at : at + n], 31))
                    at += n
                    digest = x.headers["warc-payload-digest"].removeprefix("sha1:")
                    if x.kind == "response" and hashlib.sha1(x.payload).hexdigest() != digest:
                        raise ValueError(f"{x.headers['warc-record-id']} in {uri}: the payload doesn't have its digest")
                    size = len(x.payload) if x.kind == "response" else int(x.http["content-length"])
                    row = (Record.page(x.headers["warc-record-id"]), size, digest, x.kind, Record.page(x.headers.get("warc-refers-to")), x.headers["warc-target-uri"])
                    rows.append((*row, x.payload) if payloads else row)
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]
                names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "payload"]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=False)], names=names[: len(rows[0])])

    return run


def read_archives(spark: SparkSession, archives: DataFrame, payloads: bool = False, range_bytes: int = RANGE) -> DataFrame:
    """A row for each record of the archives (column archive): page_id, payload_bytes, payload_digest,
    record_type, refers_to, url and, if asked for, the payload (empty for a revisit).

    A response whose payload lacks its digest, and a damaged archive, raise ValueError.
    """
    ranges = archives.select("archive").mapInArrow(_planned(range_bytes), "archive string, start long, lengths array<long>")
    names = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string" + ", payload binary" * payloads
    return ranges.repartition(spark.sparkContext.defaultParallelism * 4).mapInArrow(_reading(payloads), names)


def round_trip(spark: SparkSession, pages: DataFrame) -> DataFrame:
    return read_archives(spark, write_archives(spark, pages, f"{shared_dir(spark)}/archives-{uuid.uuid4().hex[:12]}"))

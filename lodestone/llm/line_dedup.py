"""Line dedup with exact reference counts behind sharded cuckoo filters.

State: a table with a row for each shard.  It holds the shard's keys with the
number of documents that have each (exact), a cuckoo filter of the keys at or
above the limit, and the exceptions: the counted keys below the limit that the
filter takes for members.  Inserting or deleting documents moves counts, and a
key that crosses the limit enters or leaves the filter, so dedup stays reversible.

Keys are known by 128 bits of XXH3; for 10**12 keys two of them agree with a
chance of about 10**-15.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Workspace, deal, even_keys, fresh, input_bytes, mix, shuffle_partitions, text_bytes

LIMIT = 10
LEAST = 1
FILTER_BYTES = 64 << 20  # of filters sent to each task; beyond it keys go to the filters
SHARD = 64 << 20
BATCH = 1024  # documents that ask together
TOUCHED, TABLES = 1000, 8  # shards rewritten by themselves, and tables that a state may lie in, at most
_SLOTS = 4
STATE = "shard int, keys binary, filter binary, exceptions binary, hot long"
_WHITE = b" \t\n\r\x0b\x0c"


class Cuckoo:
    """32-bit fingerprints in buckets of four; a key may lie in two buckets."""

    def __init__(self, slots: np.ndarray):
        self.slots = slots  # (buckets, 4), 0 is free; buckets is a power of two

    @classmethod
    def of(cls, hi: np.ndarray, lo: np.ndarray) -> Cuckoo:
        buckets = 1 << max(0, int(np.ceil(np.log2(max(1, len(hi)) / (_SLOTS * 0.85)))))
        while True:
            out = cls(np.zeros((buckets, _SLOTS), dtype=np.uint32))
            left = out._fill(hi, lo)
            if all(out.insert(h, x) for h, x in zip(hi[left], lo[left], strict=True)):
                return out
            buckets *= 2

    def _fill(self, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
        """Put all keys at once into the first or the second of their buckets; which found no room."""
        mark, *two = self.parts(hi, lo, len(self.slots))
        left, used = np.arange(len(hi)), np.zeros(len(self.slots), dtype=np.int64)
        for at in (*two, *two):
            bucket = at[left]
            order = np.argsort(bucket, kind="stable")
            left, bucket = left[order], bucket[order]
            first = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(left) else left
            slot = used[bucket] + np.arange(len(left)) - np.repeat(first, np.diff(np.r_[first, len(left)]))
            fits = slot < _SLOTS
            self.slots[bucket[fits], slot[fits]] = mark[left[fits]]
            np.add.at(used, bucket[fits], 1)
            left = left[~fits]
        return left

    @staticmethod
    def parts(hi: np.ndarray, lo: np.ndarray, buckets) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Fingerprint and both buckets."""
        mark = (lo >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
        mask = np.asarray(buckets, dtype=np.uint64) - np.uint64(1)
        one = mix(hi) & mask
        return mark, one.astype(np.int64), ((one ^ mix(mark.astype(np.uint64))) & mask).astype(np.int64)

    def _own(self, hi, lo) -> tuple[int, int, int]:
        mark, one, two = self.parts(np.array([hi], dtype=np.uint64), np.array([lo], dtype=np.uint64), len(self.slots))
        return int(mark[0]), int(one[0]), int(two[0])

    def insert(self, hi, lo) -> bool:
        """False if the filter is too full; it then has lost a fingerprint and must be made anew."""
        mark, at, two = self._own(hi, lo)
        for bucket in (at, two):
            free = np.flatnonzero(self.slots[bucket] == 0)
            if len(free):
                self.slots[bucket, free[0]] = mark
                return True
        for turn in range(500):
            slot = (mark + turn) % _SLOTS
            mark, self.slots[at, slot] = int(self.slots[at, slot]), mark
            at = (at ^ int(mix(np.array([mark], dtype=np.uint64))[0])) & (len(self.slots) - 1)
            free = np.flatnonzero(self.slots[at] == 0)
            if len(free):
                self.slots[at, free[0]] = mark
                return True
        return False

    def delete(self, hi, lo) -> None:
        """Only for keys that were inserted."""
        mark, one, two = self._own(hi, lo)
        for bucket in (one, two):
            have = np.flatnonzero(self.slots[bucket] == mark)
            if len(have):
                self.slots[bucket, have[0]] = 0
                return
        raise KeyError("no such key in the filter")

    def holds(self, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
        mark, one, two = self.parts(hi, lo, len(self.slots))
        return ((self.slots[one] == mark[:, None]) | (self.slots[two] == mark[:, None])).any(axis=1)


def _keys(text: bytes, least: int) -> tuple[list[bytes], list[bytes | None]]:
    """The lines, and of each the digest of its key (None: the key is too short)."""
    lines, out = text.split(b"\n"), []
    for line in lines:
        key = line.strip(_WHITE).lower()
        short = not key if least == 1 else len(key) < least or len(key.decode("utf-8", "replace")) < least
        out.append(None if short else xxhash.xxh3_128_digest(key))
    return lines, out


def _halves(digests: bytes) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(digests, dtype=">u8").astype(np.uint64).reshape(-1, 2)
    return both[:, 0], both[:, 1]


def _summed(hi: np.ndarray, lo: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.lexsort((lo, hi))
    hi, lo, n = hi[order], lo[order], n[order]
    if not len(n):
        return hi, lo, n
    cut = np.flatnonzero(np.r_[True, (hi[1:] != hi[:-1]) | (lo[1:] != lo[:-1])])
    return hi[cut], lo[cut], np.add.reduceat(n, cut)


def _blob(hi: np.ndarray, lo: np.ndarray, n: np.ndarray) -> bytes:
    return np.stack([hi, lo, n.astype(np.uint64)], axis=1).tobytes()


def _open(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    x = np.frombuffer(blob, dtype=np.uint64).reshape(-1, 3)
    return x[:, 0], x[:, 1], x[:, 2].astype(np.int64)


def _counted(shards: int, least: int, sign: int):
    """(shard, blob of keys and numbers of documents), summed over about 300,000 lines."""

    def run(items: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digests, size = [], 0

        def out() -> pa.RecordBatch:
            hi, lo = _halves(b"".join(digests))
            hi, lo, n = _summed(hi, lo, np.full(len(hi), sign, dtype=np.int64))
            shard = (hi % np.uint64(shards)).astype(np.int32)
            order = np.argsort(shard, kind="stable")
            shard, hi, lo, n = shard[order], hi[order], lo[order], n[order]
            cut = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1]])
            blobs = [_blob(hi[a:b], lo[a:b], n[a:b]) for a, b in zip(cut, np.r_[cut[1:], len(shard)], strict=True)]
            none = pa.nulls(len(cut), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(shard[cut]), pa.array(blobs, pa.binary()), none, none, pa.nulls(len(cut), pa.int64())], names=["shard", "keys", "filter", "exceptions", "hot"])

        for batch in items:
            for text in text_bytes(batch.column(0)):
                mine = {d for d in _keys(text, least)[1] if d is not None}
                digests += mine
                size += len(mine)
                if size > 300_000:
                    yield out()
                    digests, size = [], 0
        if digests:
            yield out()

    return run


def _merged(limit: int):
    """One row for each shard from its old row and what came in."""
    from .jaccard_join import streamed

    def run(items: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in streamed(items, ["shard"]):
            keys, filters = group.column("keys").to_pylist(), group.column("filter").to_pylist()
            old = [i for i, f in enumerate(filters) if f is not None]
            hi, lo, n = _summed(*(np.concatenate(x) for x in zip(*map(_open, keys), strict=True)))
            if (n < 0).any():
                raise ValueError("a document was deleted that the state doesn't hold")
            if old:
                sieve = Cuckoo(np.frombuffer(filters[old[0]], dtype=np.uint32).reshape(-1, _SLOTS).copy())
                h0, l0, n0 = _open(keys[old[0]])
                before = {(int(h), int(x)) for h, x in zip(h0[n0 >= limit], l0[n0 >= limit], strict=True)}
                now = {(int(h), int(x)) for h, x in zip(hi[n >= limit], lo[n >= limit], strict=True)}
                for key in before - now:
                    sieve.delete(*key)
                if not all(sieve.insert(*key) for key in now - before):
                    sieve = Cuckoo.of(hi[n >= limit], lo[n >= limit])
            else:
                sieve = Cuckoo.of(hi[n >= limit], lo[n >= limit])
            hi, lo, n = hi[n > 0], lo[n > 0], n[n > 0]
            wrong = (n < limit) & sieve.holds(hi, lo)
            row = [group.column("shard")[0].as_py(), _blob(hi, lo, n), sieve.slots.tobytes(), np.stack([hi[wrong], lo[wrong]], axis=1).tobytes(), int((n >= limit).sum())]
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, (pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.int64()), strict=True)], names=["shard", "keys", "filter", "exceptions", "hot"])

    return run


class _Sieve:
    """The filters of all shards side by side."""

    def __init__(self, shards: int, rows: list):
        self.shards = shards
        self.buckets, self.offset = np.ones(shards, dtype=np.uint64), np.zeros(shards, dtype=np.int64)
        slots, wrong, at = [np.zeros((1, _SLOTS), dtype=np.uint32)], [], 1
        for r in rows:
            mine = np.frombuffer(bytes(r["filter"]), dtype=np.uint32).reshape(-1, _SLOTS)
            self.buckets[r["shard"]], self.offset[r["shard"]] = len(mine), at
            slots.append(mine)
            at += len(mine)
            wrong.append(bytes(r["exceptions"]))
        self.slots = np.concatenate(slots)
        wrong = np.frombuffer(b"".join(wrong), dtype=np.uint64).reshape(-1, 2)
        self.wrong = {(int(a), int(b)) for a, b in wrong}

    def holds(self, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
        shard = (hi % np.uint64(self.shards)).astype(np.int64)
        mark, one, two = Cuckoo.parts(hi, lo, self.buckets[shard])
        base = self.offset[shard]
        yes = ((self.slots[base + one] == mark[:, None]) | (self.slots[base + two] == mark[:, None])).any(axis=1)
        if self.wrong:
            for i in np.flatnonzero(yes).tolist():
                yes[i] = (int(hi[i]), int(lo[i])) not in self.wrong
        return yes


def _kept(batch: pa.RecordBatch, column: str, judged: list[tuple[list[bytes], np.ndarray]]) -> pa.RecordBatch:
    out = dict(zip(batch.schema.names, batch.columns, strict=True))
    out[column] = pa.array([b"\n".join(x for x, d in zip(lines, drop, strict=True) if not d) if drop.any() else b"\n".join(lines) for lines, drop in judged], pa.binary()).cast(pa.string())
    out["n_lines"] = pa.array([len(x) for x, _ in judged], pa.int64())
    out["n_dropped"] = pa.array([int(d.sum()) for _, d in judged], pa.int64())
    return pa.RecordBatch.from_pydict(out)


def _sieving(shared, column: str, least: int):
    def run(items: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sieve = shared.value
        for batch in items:
            if not batch.num_rows:
                continue
            texts = [_keys(t, least) for t in text_bytes(batch.column(column))]
            flat = [d for _, ds in texts for d in ds]
            yes = np.zeros(len(flat), dtype=bool)
            have = np.fromiter((d is not None for d in flat), dtype=bool, count=len(flat))
            if have.any():
                yes[have] = sieve.holds(*_halves(b"".join(d for d in flat if d is not None)))
            ends = np.cumsum([len(lines) for lines, _ in texts])
            yield _kept(batch, column, [(lines, yes[e - len(lines) : e]) for (lines, _), e in zip(texts, ends.tolist(), strict=True)])

    return run


def _asking(shards: int, least: int):
    """(shard, batch, keys): the distinct keys of each batch of documents."""

    def run(items: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, seen = None, set()

        def out() -> pa.RecordBatch:
            digests = np.frombuffer(b"".join(seen), dtype="V16")
            shard = (_halves(digests.tobytes())[0] % np.uint64(shards)).astype(np.int32)
            order = np.argsort(shard, kind="stable")
            shard, digests = shard[order], digests[order]
            cut = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1]])
            blobs = [digests[a:b].tobytes() for a, b in zip(cut, np.r_[cut[1:], len(shard)], strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(shard[cut]), pa.array([now] * len(cut), pa.int64()), pa.array(blobs, pa.binary())], names=["part", "batch", "keys"])

        for batch in items:
            for at, text in zip(batch.column(0).to_pylist(), text_bytes(batch.column(1)), strict=True):
                if at != now or len(seen) > 300_000:
                    if seen:
                        yield out()
                    now, seen = at, set()
                seen.update(d for d in _keys(text, least)[1] if d is not None)
        if seen:
            yield out()

    return run


def _answering(items: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(batch, keys): which of the keys asked for the shard's filter holds; a shard's filter comes before what is asked of it."""
    shard = sieve = wrong = None
    for batch in items:
        found = []
        for part, at, keys, sieve_, wrong_ in zip(*(batch.column(c).to_pylist() for c in ("part", "batch", "keys", "filter", "exceptions")), strict=True):
            if sieve_ is not None:
                shard, sieve = part, Cuckoo(np.frombuffer(sieve_, dtype=np.uint32).reshape(-1, _SLOTS))
                wrong = set(map(tuple, np.frombuffer(wrong_, dtype=np.uint64).reshape(-1, 2).tolist()))
            elif part == shard:
                hi, lo = _halves(keys)
                yes = sieve.holds(hi, lo)
                for i in np.flatnonzero(yes).tolist() if wrong else ():
                    yes[i] = (int(hi[i]), int(lo[i])) not in wrong
                if yes.any():
                    found.append((at, np.frombuffer(keys, dtype="V16")[yes].tobytes()))
        if found:
            at, keys = zip(*found, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(keys, pa.binary())], names=["batch", "keys"])


def _dropping(column: str, least: int, batch_: str, keys_: str):
    """Documents without the lines of which an answer to their batch has the key; answers come before documents."""

    def run(items: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, hot = None, set()
        for batch in items:
            answers = batch.column(keys_).to_pylist()
            docs = batch.filter(pa.array([a is None for a in answers], pa.bool_())).drop_columns([batch_, keys_])
            texts, judged = iter(text_bytes(docs.column(column))), []
            for at, keys in zip(batch.column(batch_).to_pylist(), answers, strict=True):
                if at != now:
                    now, hot = at, set()
                if keys is not None:
                    hot.update(keys[i : i + 16] for i in range(0, len(keys), 16))
                else:
                    lines, digests = _keys(next(texts), least)
                    judged.append((lines, np.array([d in hot for d in digests], dtype=bool)))
            if judged:
                yield _kept(docs, column, judged)

    return run


class LineDedup:
    """Counts of lines over documents, kept in the shared folder.

    A text's lines end at line feeds; null and empty texts have one empty line.  A
    line's key is the line without white space around it, A-Z lower-cased.  Keys
    of ``least`` code points or more found in ``limit`` documents or more lose all their lines;
    repeated rows count as documents of their own.  Very long texts are taken whole.

    An insertion or deletion rewrites the shards that its lines fall in, up to ``TOUCHED`` and half of all, and else every one.
    By default there are two shards for each shuffle partition, and one for each ``SHARD``
    bytes of the documents first inserted.
    """

    def __init__(self, spark: SparkSession, limit: int = LIMIT, least: int = LEAST, shards: int | None = None):
        self.spark, self.limit, self.least, self.shards = spark, limit, least, shards
        self.ws, self.version, self.state, self.tables = Workspace(spark, "lines"), 0, None, []

    def _update(self, docs: DataFrame, text_col: str, sign: int) -> LineDedup:
        if self.shards is None:
            self.shards = max(2 * shuffle_partitions(self.spark), min(1 << 20, input_bytes(docs.select(text_col)) // SHARD))
        new = docs.select(text_col).mapInArrow(_counted(self.shards, self.least, sign), STATE)
        name, rest = f"state-{self.version + 1}", None
        if self.state is not None:
            new = self.ws.keep(new, f"delta-{self.version + 1}")
            touched = [r["shard"] for r in new.select("shard").distinct().limit(TOUCHED + 1).collect()]
            if len(touched) <= min(TOUCHED, self.shards // 2) and len(self.tables) < TABLES:
                rest = self.state.filter(~F.col("shard").isin(touched))
                new = new.unionByName(self.state.filter(F.col("shard").isin(touched)))
            else:
                new = new.unionByName(self.state)
        parts = min(self.shards, shuffle_partitions(self.spark))
        even = F.get(F.lit(even_keys(parts)), F.col("shard") % parts)
        made = self.ws.keep(new.repartition(parts, even).sortWithinPartitions("shard").mapInArrow(_merged(self.limit), STATE), name)
        if rest is None:
            for old in self.tables:
                self.ws.drop(old)
            self.state, self.tables = made, [name]
        else:
            self.state, self.tables = rest.unionByName(made), [*self.tables, name]
        if self.version:
            self.ws.drop(f"delta-{self.version + 1}")
        self.version += 1
        return self

    def insert(self, docs: DataFrame, text_col: str = "text") -> LineDedup:
        return self._update(docs, text_col, 1)

    def delete(self, docs: DataFrame, text_col: str = "text") -> LineDedup:
        """Take back documents that were inserted."""
        return self._update(docs, text_col, -1)

    def apply(self, docs: DataFrame, text_col: str = "text", filter_bytes: int = FILTER_BYTES) -> DataFrame:
        """docs with the kept lines as text (null becomes empty), n_lines and n_dropped; inserted documents only.

        The filters and exceptions go to every task if they have at most
        ``filter_bytes``.  Else the distinct keys of each batch of documents go to the filters of their shards,
        and those that are held come back to the batch, so a line's key is sent once for a batch however often it occurs.
        No rows give no rows; columns named n_lines and n_dropped are replaced.
        """
        docs = docs.drop("n_lines", "n_dropped")
        schema = T.StructType([*(T.StructField(f.name, T.StringType()) if f.name == text_col else f for f in docs.schema.fields), T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())])
        size = self.state.agg(F.sum(F.octet_length("filter") + F.octet_length("exceptions"))).first()[0] or 0
        if size <= filter_bytes:
            sieve = _Sieve(self.shards, self.state.select("shard", "filter", "exceptions").collect())
            return docs.mapInArrow(_sieving(self.spark.sparkContext.broadcast(sieve), text_col, self.least), schema)
        parts, batch_ = shuffle_partitions(self.spark), fresh("batch", docs.columns)
        keys_ = fresh("keys", docs.columns)
        rows = self.ws.keep(docs.withColumn(batch_, F.floor(F.monotonically_increasing_id() / BATCH)), "rows")
        asked = rows.select(batch_, text_col).mapInArrow(_asking(self.shards, self.least), "part int, batch long, keys binary")
        none = F.lit(None).cast("binary")
        filters = self.state.select(F.col("shard").alias("part"), F.lit(-1).cast("long").alias("batch"), none.alias("keys"), "filter", "exceptions")
        asked = filters.unionByName(asked.withColumns({"filter": none, "exceptions": none}))
        answers = deal(asked, parts, "batch").mapInArrow(_answering, "batch long, keys binary")
        answers = answers.select(*(F.lit(None).cast(f.dataType).alias(f.name) for f in docs.schema.fields), F.col("batch").alias(batch_), F.col("keys").alias(keys_))
        both = answers.unionByName(rows.withColumn(keys_, none)).repartition(parts, batch_).sortWithinPartitions(batch_, F.col(keys_).isNull())
        return both.mapInArrow(_dropping(text_col, self.least, batch_, keys_), schema)


def dedup_lines(spark: SparkSession, docs: DataFrame, text_col: str = "text", limit: int = LIMIT, least: int = LEAST) -> DataFrame:
    """All of docs, counted and then deduplicated; see LineDedup."""
    return LineDedup(spark, limit, least).insert(docs, text_col).apply(docs, text_col)

"""Approximate nearest neighbours by inner product: multiprobe p-stable hashing.

Rows are taken in bands of like norms.  In a band they are lengthened by one component to its
norm, which turns the largest inner product into the smallest distance; a query looks into every
band.  Each table hashes
``hashes`` Gaussian projections, made orthogonal, in steps of ``width``.  A query visits
its own bucket and then those with the least estimated distance, so many that recall is met.
What the tables find is merged and ranked by the exact product in double precision.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace, even_keys, mix, shuffle_partitions
from .jaccard_join import streamed

TABLES, HASHES, WIDTH, PROBES = 3, 10, 3.0, 300
NEIGHBOURS = 20
BAND, BANDS = 1.25, 32  # the ratio of norms in a band, and how many bands there are at most; the last has all smaller norms
BRUTE = 1024  # queries that the exact search compares with all rows at once


class Hashes:
    def __init__(self, dim: int, norm: float, tables: int, hashes: int, width: float, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.norm, self.width, self.tables, self.hashes = norm, width, tables, hashes
        size, each = dim + 1, []
        while sum(q.shape[1] for q in each) < tables * hashes:
            each.append(np.linalg.qr(rng.normal(size=(size, size)))[0])
        # unit rows times the root of the dimension have the spread of Gaussian ones
        self.lines = np.concatenate(each, axis=1)[:, : tables * hashes] * np.sqrt(size)
        self.shift = rng.uniform(0, width, tables * hashes)
        self.odd = rng.integers(1, 1 << 62, tables * hashes, dtype=np.int64).astype(np.uint64) | np.uint64(1)
        self.salt = rng.integers(1, 1 << 62, tables, dtype=np.int64).astype(np.uint64)
        self.band_salt = mix(np.arange(1, BANDS + 1, dtype=np.uint64)) * (np.arange(BANDS) > 0).astype(np.uint64)

    def bands(self, x: np.ndarray) -> np.ndarray:
        """0 for the largest norms."""
        norm = np.sqrt((x * x).sum(axis=1))
        return np.clip(np.floor(np.log(self.norm / norm) / np.log(BAND) + 1e-9), 0, BANDS - 1).astype(np.int64)

    def project(self, x: np.ndarray, query: bool) -> np.ndarray:
        """In steps of the width, as parts of the norm: a query is scaled to it, a row is lengthened to its band's."""
        if query:
            x = x / np.linalg.norm(x, axis=1)[:, None]
            last = np.zeros(len(x))
        else:
            x = x / (self.norm / BAND ** self.bands(x))[:, None]
            last = np.sqrt(np.maximum(1 - (x * x).sum(axis=1), 0))
        return (np.concatenate([x, last[:, None]], axis=1) @ self.lines + self.shift) / self.width

    def row_keys(self, x: np.ndarray) -> np.ndarray:
        return self.keys(self.project(x, False)) + self.band_salt[self.bands(x)][:, None]

    def keys(self, steps: np.ndarray) -> np.ndarray:
        """(rows, tables): numbers of the buckets."""
        part = np.floor(steps).astype(np.int64).astype(np.uint64) * self.odd
        return part.reshape(len(steps), self.tables, self.hashes).sum(axis=2, dtype=np.uint64) + self.salt

    def probes(self, steps: np.ndarray, key: np.ndarray, table: int, most: int) -> np.ndarray:
        """Buckets of one query in one table, the likeliest first."""
        a = table * self.hashes
        inside = steps[a : a + self.hashes] - np.floor(steps[a : a + self.hashes])
        cost = np.concatenate([inside**2, (1 - inside) ** 2])
        step = np.concatenate([-self.odd[a : a + self.hashes].astype(np.int64), self.odd[a : a + self.hashes].astype(np.int64)]).astype(np.uint64)
        order = np.argsort(cost, kind="stable")
        cost, step, which = cost[order].tolist(), [int(s) for s in step[order]], (order % self.hashes).tolist()
        out, heap, base = [int(key)], [(cost[0], (0,))], int(key)
        while heap and len(out) < most:
            total, used = heapq.heappop(heap)
            if len({which[i] for i in used}) == len(used):
                out.append((base + sum(step[i] for i in used)) & (2**64 - 1))
            last = used[-1]
            if last + 1 < len(cost):
                heapq.heappush(heap, (total - cost[last] + cost[last + 1], (*used[:-1], last + 1)))
                heapq.heappush(heap, (total + cost[last + 1], (*used, last + 1)))
        return np.array(out, dtype=np.uint64)


def _valid(dim: int | None):
    """(id, dim, vec, norm2) of usable vectors."""

    def run(items: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in items:
            rows = []
            for i, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if i is None or not v or None in v:
                    continue
                x = np.array(v, dtype=np.float64)
                if np.isfinite(x).all() and x.any():
                    rows.append((i, len(x), x.tobytes(), float(x @ x)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.binary(), pa.float64()), strict=True)], names=["id", "dim", "vec", "norm2"])

    return run


def _matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.float64).reshape(-1, dim)


def _counting(shared):
    def run(items: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, dim = shared.value
        for batch in items:
            if batch.num_rows:
                key, n = np.unique(hashes.row_keys(_matrix(batch.column(0), dim)), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(key.astype(np.int64)), pa.array(n)], names=["key", "n"])

    return run


def _split(parts: int, part: np.ndarray, kind: int, blob) -> list[tuple[int, int, bytes]]:
    order = np.argsort(part, kind="stable")
    cut = np.flatnonzero(np.r_[True, np.diff(part[order]) > 0]) if len(part) else []
    return [(int(part[mine[0]]), kind, blob(mine)) for mine in np.split(order, cut[1:])] if len(part) else []


_BLOBS = ["part", "kind", "blob"]


def _blobs(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int32(), pa.binary()), strict=True)], names=_BLOBS)


def _part(key: np.ndarray, salt: np.ndarray, parts: int) -> np.ndarray:
    return (mix(key + salt.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(parts)).astype(np.int32)


def _dealing(shared, is_query: bool, parts: int, probes: int):
    """Rows and queries to the parts that hold their buckets; a bucket in ``heavy`` lies in several."""

    def run(items: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, dim, heavy, bands = shared.value
        salts = hashes.band_salt[bands]
        names, copies = np.array(sorted(heavy), dtype=np.uint64), np.array([heavy[k] for k in sorted(heavy)], dtype=np.int64)

        def shares(key: np.ndarray) -> np.ndarray:
            if not len(names):
                return np.ones(len(key), dtype=np.int64)
            at = np.searchsorted(names, key) % len(names)
            return np.where(names[at] == key, copies[at], 1)

        for batch in items:
            if not batch.num_rows:
                continue
            ids, x = batch.column(0).to_numpy(), _matrix(batch.column(1), dim)
            if not is_query:
                key, row = hashes.row_keys(x).reshape(-1), np.repeat(np.arange(len(ids)), hashes.tables)
                salt = (mix(ids[row].astype(np.uint64)) % shares(key).astype(np.uint64)).astype(np.int64)
                yield _blobs(_split(parts, _part(key, salt, parts), 0, lambda m: np.int64(len(m)).tobytes() + key[m].tobytes() + ids[row[m]].tobytes() + x[row[m]].tobytes()))  # noqa: B023
                continue
            steps = hashes.project(x, True)
            keys, row, key = hashes.keys(steps), [], []
            for i in range(len(ids)):
                for t in range(hashes.tables):
                    key.append((hashes.probes(steps[i], keys[i, t], t, probes)[:, None] + salts).reshape(-1))
                    row.append(np.full(len(key[-1]), i))
            row, key = np.concatenate(row), np.concatenate(key)
            n = shares(key)
            row, key = np.repeat(row, n), np.repeat(key, n)
            salt = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)

            def blob(m: np.ndarray) -> bytes:
                mine, at = np.unique(row[m], return_inverse=True)  # noqa: B023
                return np.array([len(mine), len(m)]).tobytes() + ids[mine].tobytes() + x[mine].tobytes() + at.astype(np.int64).tobytes() + key[m].tobytes()  # noqa: B023

            yield _blobs(_split(parts, _part(key, salt, parts), 1, blob))

    return run


def _best(query: np.ndarray, ident: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The k nearest of each query and their ranks; a neighbour found twice counts once."""
    order = np.lexsort((ident, -score, query))
    query, ident, score = query[order], ident[order], score[order]
    new = np.r_[True, (query[1:] != query[:-1]) | (ident[1:] != ident[:-1]) | (score[1:] != score[:-1])] if len(query) else np.zeros(0, dtype=bool)
    query, ident, score = query[new], ident[new], score[new]
    first = np.searchsorted(query, query, "left")
    rank = np.arange(len(query)) - first
    keep = rank < k
    return query[keep], ident[keep], score[keep], rank[keep] + 1


class _Pool:
    """The best found so far of some queries, and the score to beat."""

    def __init__(self, x: np.ndarray, ids: np.ndarray, k: int):
        self.x, self.ids, self.k = x, ids, k
        self.limit = np.full(len(ids), -np.inf)
        self.found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.size = 0

    def offer(self, queries: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        rough = self.x[queries] @ rows.T
        # the product above may differ in the last bits from the exact one below
        q, r = np.nonzero(rough >= (self.limit[queries] - 1e-9 * np.abs(self.limit[queries]).clip(1, 1e300))[:, None])
        other = ids[r] != self.ids[queries[q]]
        q, r = queries[q[other]], r[other]
        for a in range(0, len(q), 1 << 16):
            p, s = q[a : a + (1 << 16)], r[a : a + (1 << 16)]
            self.found.append((p, ids[s], (self.x[p] * rows[s]).sum(axis=1)))
        self.size += len(q)
        if self.size > 4 * self.k * max(len(self.ids), 1000):
            self.best()

    def best(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if not self.found:
            none = np.zeros(0, dtype=np.int64)
            return none, none, np.zeros(0)
        q, i, s, rank = _best(*(np.concatenate(c) for c in zip(*self.found, strict=True)), self.k)
        last = rank == self.k
        self.limit[q[last]] = s[last]
        self.found, self.size = [(q, i, s)], 0
        return q, i, s


def _out(pool: _Pool, parts: int) -> list[tuple[int, int, bytes]]:
    q, i, s = pool.best()
    query = pool.ids[q]
    part = (mix(query.astype(np.uint64)) % np.uint64(parts)).astype(np.int32)
    return _split(parts, part, 0, lambda m: np.stack([query[m], i[m], s[m].view(np.int64)]).tobytes())


def _searching(dim: int, k: int, parts: int):
    def run(items: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in streamed(items, ["part"]):
            kind, blobs = group.column("kind").to_pylist(), group.column("blob").to_pylist()
            base, asked = [], []
            for t, b in zip(kind, blobs, strict=True):
                if t == 0:
                    n = int(np.frombuffer(b, np.int64, 1)[0])
                    base.append((np.frombuffer(b, np.uint64, n, 8), np.frombuffer(b, np.int64, n, 8 + 8 * n), np.frombuffer(b, np.float64, n * dim, 8 + 16 * n).reshape(n, dim)))
                else:
                    n, m = (int(v) for v in np.frombuffer(b, np.int64, 2))
                    at = 16 + 8 * n
                    x = np.frombuffer(b, np.float64, n * dim, at).reshape(n, dim)
                    at += 8 * n * dim
                    asked.append((np.frombuffer(b, np.int64, n, 16), x, np.frombuffer(b, np.int64, m, at), np.frombuffer(b, np.uint64, m, at + 8 * m)))
            if not base or not asked:
                continue
            key, ids, rows = (np.concatenate(c) for c in zip(*base, strict=True))
            order = np.argsort(key, kind="stable")
            key, ids, rows = key[order], ids[order], rows[order]
            shift = np.cumsum([0] + [len(a[0]) for a in asked])
            pool = _Pool(np.concatenate([a[1] for a in asked]), np.concatenate([a[0] for a in asked]), k)
            who, probe = np.concatenate([a[2] + s for a, s in zip(asked, shift, strict=False)]), np.concatenate([a[3] for a in asked])
            low, high = np.searchsorted(key, probe, "left"), np.searchsorted(key, probe, "right")
            who, low, high = who[high > low], low[high > low], high[high > low]
            order = np.lexsort((who, low))
            who, low, high = who[order], low[order], high[order]
            cut = np.flatnonzero(np.r_[True, np.diff(low) > 0]) if len(low) else []
            for a, b in zip(cut, [*cut[1:], len(low)], strict=True):
                for c in range(a, b, 512):  # bounded products
                    for d in range(int(low[a]), int(high[a]), 4096):
                        e = min(d + 4096, int(high[a]))
                        pool.offer(who[c : min(b, c + 512)], ids[d:e], rows[d:e])
            if found := _out(pool, parts):
                yield _blobs(found)

    return run


def _brute(shared, k: int, parts: int, dim: int):
    def run(items: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, x = shared.value
        pool = _Pool(x, ids, k)
        every = np.arange(len(ids))
        for batch in items:
            for a in range(0, batch.num_rows, 4096):
                part = batch.slice(a, 4096)
                pool.offer(every, part.column(0).to_numpy(), _matrix(part.column(1), dim))
        if found := _out(pool, parts):
            yield _blobs(found)

    return run


def _ranking(k: int):
    def run(items: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in streamed(items, ["part"]):
            every = np.concatenate([np.frombuffer(b, dtype=np.int64).reshape(3, -1) for b in group.column("blob").to_pylist()], axis=1)
            q, i, s, rank = _best(every[0], every[1], np.ascontiguousarray(every[2]).view(np.float64), k)
            yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(rank.astype(np.int32)), pa.array(i), pa.array(s)], names=["query_id", "rank", "vec_id", "score"])

    return run


_RESULT = "query_id long, rank int, vec_id long, score double"


def nearest(spark: SparkSession, rows: DataFrame, queries: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", k: int = NEIGHBOURS, tables: int = TABLES, hashes: int = HASHES, width: float = WIDTH, probes: int = PROBES) -> DataFrame:
    """(query_id, rank, vec_id, score) of each query's k nearest rows that were found, ties to the smaller id.

    Rows and queries with a null id, and vectors that are null, empty, zero, or hold nulls or
    components that aren't finite, take no part; nor do those whose number of
    components isn't the most frequent one among the rows (the largest of several).  A row with the query's
    id is no candidate.  A repeated row counts once, and a repeated query is answered once.
    A query for which the buckets hold fewer than k rows is compared with every row.
    No rows or no queries give no rows.  Other columns are left out, whatever their names.
    """
    ws, parts = Workspace(spark, "nearest"), shuffle_partitions(spark)
    form, cols = "id long, dim int, vec binary, norm2 double", [F.col(id_col).cast("long"), F.col(vec_col)]
    base = ws.keep(rows.select(*cols).mapInArrow(_valid(None), form), "rows")
    asked = ws.keep(queries.select(*cols).mapInArrow(_valid(None), form).dropDuplicates(["id"]), "queries")
    most = base.groupBy("dim").agg(F.count("*").alias("n"), F.max("norm2").alias("m")).orderBy(F.desc("n"), F.desc("dim")).first()
    if most is None:
        return spark.createDataFrame([], _RESULT)
    dim = most["dim"]
    base, asked = base.filter(F.col("dim") == dim), asked.filter(F.col("dim") == dim)
    sc = spark.sparkContext
    made = Hashes(dim, float(np.sqrt(most["m"])), tables, hashes, width)
    # a bucket of over a quarter of a part's even share is spread; so many at most are 4 * parts
    bound = max(256, most["n"] * tables // (4 * parts))
    big = base.select("vec").mapInArrow(_counting(sc.broadcast((made, dim))), "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).filter(F.col("n") > bound)
    heavy = {r["key"] % 2**64: -(-r["n"] // bound) for r in big.collect()}
    norm = F.sqrt("norm2")
    band = F.least(F.lit(BANDS - 1), F.greatest(F.lit(0), F.floor(F.log(F.lit(made.norm) / norm) / F.log(F.lit(BAND)) + 1e-9)))
    bands = {int(r["b"]) for r in base.select(band.alias("b")).distinct().collect()}  # BANDS rows at most
    # beside those that hold rows their neighbours, for the last bits of a logarithm
    bands = np.array(sorted({min(BANDS - 1, max(0, b + d)) for b in bands for d in ((0,) if len(bands) == 1 else (-1, 0, 1))}))
    shared = sc.broadcast((made, dim, heavy, bands))
    form = "part int, kind int, blob binary"
    dealt = base.select("id", "vec").mapInArrow(_dealing(shared, False, parts, probes), form).unionByName(asked.select("id", "vec").mapInArrow(_dealing(shared, True, parts, probes), form))
    even = F.get(F.lit(even_keys(parts)), F.col("part"))
    found = dealt.repartition(parts, even).sortWithinPartitions("part").mapInArrow(_searching(dim, k, parts), form)
    ranked = lambda df: df.repartition(parts, even).sortWithinPartitions("part").mapInArrow(_ranking(k), _RESULT)
    out = ws.keep(ranked(found), "found")
    need = min(k, base.select("id").distinct().limit(k + 1).count() - 1)
    short = asked.join(out.groupBy("query_id").agg(F.count("*").alias("n")), F.col("id") == F.col("query_id"), "left").filter(F.coalesce("n", F.lit(0)) < need).select("id", "vec")
    short, more, chunk = ws.keep(short, "short"), None, []

    def searched(chunk: list) -> DataFrame:
        both = np.array([r["id"] for r in chunk], dtype=np.int64), np.frombuffer(b"".join(bytes(r["vec"]) for r in chunk), dtype=np.float64).reshape(-1, dim)
        return ranked(base.select("id", "vec").mapInArrow(_brute(sc.broadcast(both), k, parts, dim), form))

    for r in short.toLocalIterator():
        chunk.append(r)
        if len(chunk) == BRUTE:
            more, chunk = searched(chunk) if more is None else more.unionByName(searched(chunk)), []
    if chunk:
        more = searched(chunk) if more is None else more.unionByName(searched(chunk))
    if more is None:
        return out
    return out.join(short.select("id"), F.col("query_id") == F.col("id"), "left_anti").unionByName(more)

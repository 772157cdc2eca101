"""Shared plumbing: the job's folder, materialised steps, Arrow helpers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..job import Workspace, shared_dir, ship

__all__ = ["Workspace", "blocks", "deal", "even_keys", "fresh", "input_bytes", "mix", "read_table", "shared_dir", "ship", "shuffle_partitions", "spread_join", "text_bytes", "whole_groups"]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 of each text, null as empty."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [b or b"" for b in column.cast(kind).to_pylist()]


def blocks(texts: list[bytes], most: int = 1 << 19) -> Iterator[tuple[int, int]]:
    """Runs of texts of about ``most`` bytes; a longer text is a run of its own."""
    a = size = 0
    for b, text in enumerate(texts):
        if size and size + len(text) > most:
            yield a, b
            a, size = b, 0
        size += len(text) + 1
    if a < len(texts):
        yield a, len(texts)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits that spreads every bit (the splitmix64 finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def even_keys(parts: int) -> np.ndarray:
    """One int for each of ``parts`` partitions that repartition(parts, key) sends there.

    Spark places an int key by its Murmur3 hash, so consecutive keys would fall
    unevenly: some partitions would get several and some none.
    """
    x = np.arange(64 * parts, dtype=np.uint32)
    with np.errstate(over="ignore"):
        k = x * np.uint32(0xCC9E2D51)
        k = ((k << np.uint32(15)) | (k >> np.uint32(17))) * np.uint32(0x1B873593)
        h = np.uint32(42) ^ k
        h = ((h << np.uint32(13)) | (h >> np.uint32(19))) * np.uint32(5) + np.uint32(0xE6546B64)
        h ^= np.uint32(4)
        h = (h ^ (h >> np.uint32(16))) * np.uint32(0x85EBCA6B)
        h = (h ^ (h >> np.uint32(13))) * np.uint32(0xC2B2AE35)
        h ^= h >> np.uint32(16)
    at = h.view(np.int32).astype(np.int64) % parts
    out = np.arange(parts, dtype=np.int32)  # right, if uneven, where the search should find none
    place, first = np.unique(at, return_index=True)
    out[place] = first
    return out


def deal(df: DataFrame, parts: int, *then: str) -> DataFrame:
    """Rows to ``parts`` partitions evenly by the int column ``part``, in its order and that of the columns ``then``."""
    return df.repartition(parts, F.get(F.lit(even_keys(parts)), F.col("part") % parts)).sortWithinPartitions("part", *then)


def input_bytes(df: DataFrame) -> int:
    """Bytes of a table, as the optimiser knows them; 0 if it doesn't."""
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return size if size < 10**18 else 0


def fresh(name: str, columns: list[str]) -> str:
    """A column name like ``name`` that none of the columns has, whatever the case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


FREQUENT = 100_000  # keys that are broadcast, at most
SELDOM = 1000  # rows that any key may have in one task


def spread_join(rows: DataFrame, one: DataFrame, keys: list[str], many: str) -> DataFrame:
    """rows joined with ``one``, which has a row for each key and in its column ``many`` the number of rows with it.

    Keys with more rows than ``SELDOM`` and than one in ``FREQUENT`` of all are broadcast with what
    belongs to them, so that their rows stay where they are; by this bound there are fewer than ``FREQUENT`` of them.
    Both inputs are read twice.
    """
    bound = max(SELDOM, (one.agg(F.sum(many)).first()[0] or 0) // FREQUENT)
    hot = F.broadcast(one.filter(F.col(many) > bound))
    cold = rows.join(hot.select(*keys), keys, "left_anti").join(one.filter(F.col(many) <= bound), keys)
    return rows.join(hot, keys).unionByName(cold)


def whole_groups(items: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole runs of equal keys and where each run begins, from batches in which such rows follow each other."""
    open_: list[pa.RecordBatch] = []
    for batch in items:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([*open_, batch]) if open_ else pa.Table.from_batches([batch])
        cols = [table.column(k).to_numpy() for k in keys]
        change = np.ones(table.num_rows, dtype=bool)
        change[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in cols])
        start = np.flatnonzero(change)
        if len(start) > 1:
            yield table.slice(0, int(start[-1])), start[:-1]
        open_ = table.slice(int(start[-1])).to_batches()
    if open_:
        yield pa.Table.from_batches(open_), np.zeros(1, dtype=np.int64)

"""Benchmark decontamination: a prefix-filtered containment join of item windows and documents.

A window is a set of word shingles that must all lie, in order, in the document.
Contained whole, it needs a prefix of one shingle, so only its rarest by counts
over all documents is joined.  A match fixes where the window would have to
begin; it must lie within the document, and then is compared word by word.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import blocks, ship, text_bytes
from .words import ALNUM, Block, shingle_numbers

WINDOW = 13
SHINGLE = 5
INDEX_BYTES = 64 << 20  # of memory that the index sent to each task may take; more goes in several passes
EACH = 16  # bytes of an index for each byte of benchmark text, at most (words of a letter and a space apart take more)

_ADDED = [
    T.StructField("n_words", T.LongType()),
    T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))),
    T.StructField("items", T.ArrayType(T.StringType())),
]


class _Windows:
    """The distinct windows of some items, as places in the items' words, and whose they are.

    Windows are told apart by 64-bit numbers of their words; nothing is kept for a window but numbers.
    """

    def __init__(self, rows: list[tuple[str | None, bytes]], window: int):
        self.items = [i for i, _ in rows]
        self.block = Block([t for _, t in rows], ALNUM)
        n = np.diff(self.block.first)
        many = np.where(n > 0, np.maximum(1, n - window + 1), 0)
        text = np.repeat(np.arange(len(rows)), many)
        begin = np.arange(len(text)) - np.repeat(np.cumsum(many) - many, many) + self.block.first[text]
        size = np.minimum(n[text], window)
        number = np.zeros(len(text), dtype=np.uint64)
        for s in np.unique(size).tolist():
            mine = np.flatnonzero(size == s)
            number[mine] = shingle_numbers(self.block.word, s)[begin[mine]]
        order = np.lexsort((text, number, size))
        text, begin, size, number = text[order], begin[order], size[order], number[order]
        new = np.r_[True, (size[1:] != size[:-1]) | (number[1:] != number[:-1])] if len(text) else np.zeros(0, dtype=bool)
        self.first = np.flatnonzero(new)
        self.begin, self.size, self.k = begin[self.first], size[self.first], np.minimum(SHINGLE, size[self.first])
        self.text, self.first = text, np.r_[self.first, len(text)]  # window w is of texts text[first[w]:first[w + 1]]
        self.numbers = {k: shingle_numbers(self.block.word, k) for k in np.unique(self.k).tolist()}
        self.every = {k: np.unique(np.concatenate([self._shingles(k, s)[1].reshape(-1) for s in self._sizes(k)])) for k in self.numbers}

    def __len__(self) -> int:
        return len(self.begin)

    def _sizes(self, k: int) -> list[int]:
        return np.unique(self.size[self.k == k]).tolist()

    def _shingles(self, k: int, size: int) -> tuple[np.ndarray, np.ndarray]:
        """The windows of this size, and a row of shingles for each."""
        mine = np.flatnonzero(self.size == size)
        return mine, self.numbers[k][self.begin[mine][:, None] + np.arange(size - k + 1)]

    def rarest(self, counts: dict[int, np.ndarray]) -> dict[int, tuple[np.ndarray, ...]]:
        """By size of shingle: the joined shingles, sorted, where the windows of each begin in the next two, the windows, and the shingle's place in them."""
        out = {}
        for k, every in self.every.items():
            rank = np.empty(len(every), dtype=np.int64)
            rank[np.lexsort((every, counts[k]))] = np.arange(len(every))
            found = []
            for size in self._sizes(k):
                mine, shingles = self._shingles(k, size)
                at = np.searchsorted(every, shingles)
                place = rank[at].argmin(axis=1)
                found.append((at[np.arange(len(mine)), place], mine, place))
            at, mine, place = (np.concatenate(x) for x in zip(*found, strict=True))
            order = np.argsort(at, kind="stable")
            used, start = np.unique(at[order], return_index=True)
            out[k] = every[used], np.r_[start, len(at)], mine[order], place[order]
        return out

    def owners(self, w: int) -> set[str]:
        return {self.items[t] for t in self.text[self.first[w] : self.first[w + 1]].tolist()} - {None}


class _Index:
    """The windows and the shingles by which they are joined."""

    def __init__(self, windows: _Windows, counts: dict[int, np.ndarray]):
        self.windows, self.by_k = windows, windows.rarest(counts)
        windows.numbers = windows.every = None


def _probe(sorted_: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where in numbers, and which of sorted_."""
    at = np.searchsorted(sorted_, numbers)
    at[at == len(sorted_)] = 0
    where = np.flatnonzero(sorted_[at] == numbers)
    return where, at[where]


def _counting(shared):
    def run(items: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every = shared.value
        counts = {k: np.zeros(len(s), dtype=np.int64) for k, s in every.items()}
        for batch in items:
            texts = text_bytes(batch.column(0))
            for a, b in blocks(texts):
                block = Block(texts[a:b], ALNUM)
                for k, s in every.items():
                    numbers, whole = block.shingles(k)
                    where, which = _probe(s, numbers)
                    counts[k] += np.bincount(which[whole[where]], minlength=len(s))
        for k, n in counts.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), k, dtype=np.int32)), pa.array(at), pa.array(n[at])], names=["k", "at", "n"])

    return run


def _found(block: Block, index: _Index) -> tuple[list[tuple[int, int]], dict[int, set[str]]]:
    """Word runs of the block that are windows, and by text the items."""
    spans, items = [], defaultdict(set)
    windows = index.windows
    for k, (shingles, start, users, places) in index.by_k.items():
        where, which = _probe(shingles, shingle_numbers(block.word, k))
        if not len(where):
            continue
        text = np.searchsorted(block.first, where, "right") - 1
        for i, s, t in zip(where.tolist(), which.tolist(), text.tolist(), strict=True):
            low, high = block.first[t], block.first[t + 1]
            for w, place in zip(users[start[s] : start[s + 1]].tolist(), places[start[s] : start[s + 1]].tolist(), strict=True):
                begin, at, size = i - place, int(windows.begin[w]), int(windows.size[w])
                if begin < low or begin + size > high or not np.array_equal(block.word[begin : begin + size], windows.block.word[at : at + size]):
                    continue
                if all(block.text_of(begin + j) == windows.block.text_of(at + j) for j in range(size)):
                    spans.append((begin, begin + size))
                    items[t] |= windows.owners(w)
    return spans, items


def _marking(shared, column: str):
    def run(batches_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in batches_:
            if not batch.num_rows:
                continue
            texts = text_bytes(batch.column(column))
            had = "spans" in batch.schema.names
            old_spans = batch.column("spans").to_pylist() if had else None
            old_items = batch.column("items").to_pylist() if had else None
            n_words, all_spans, all_items, row = [], [], [], 0
            for a, b in blocks(texts):
                block = Block(texts[a:b], ALNUM)
                spans, items = _found(block, index)
                mark = np.zeros(len(block.word) + 1, dtype=np.int64)
                for x, y in spans:
                    mark[x] += 1
                    mark[y] -= 1
                inside = np.cumsum(mark) > 0  # over the whole block: a run may end where the next text begins
                for t in range(b - a):
                    low, high = int(block.first[t]), int(block.first[t + 1])
                    n_words.append(high - low)
                    mine = items.get(t, set())
                    before = [(x["start"], x["end"]) for x in old_spans[row]] if had else []
                    if inside[low:high].any() or before:
                        hit = np.zeros(high - low + 2, dtype=np.int8)
                        hit[1:-1] = inside[low:high]
                        for x, y in before:
                            hit[x + 1 : y + 1] = 1
                        edge = np.flatnonzero(np.diff(hit))
                        all_spans.append([{"start": int(x), "end": int(y)} for x, y in zip(edge[0::2], edge[1::2], strict=True)])
                    else:
                        all_spans.append([])
                    all_items.append(sorted(mine | set(old_items[row] if had else ())))
                    row += 1
            out = {n: c for n, c in zip(batch.schema.names, batch.columns, strict=True) if n not in ("n_words", "spans", "items")}
            out["n_words"] = pa.array(n_words, pa.int64())
            out["spans"] = pa.array(all_spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
            out["items"] = pa.array(all_items, pa.list_(pa.string()))
            yield pa.RecordBatch.from_pydict(out)

    return run


def decontaminate(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, share: int = 20, index_bytes: int = INDEX_BYTES) -> DataFrame:
    """docs with n_words, n_hit, spans (word runs that were hit), items (ids, sorted as strings) and contaminated.

    Words are runs of digits, letters and characters beyond ASCII, A-Z
    lower-cased.  A window is ``window`` consecutive words of an item, or all words of an
    item that has fewer.  A document is contaminated if share * n_hit >=
    n_words and n_hit > 0.

    Every row of docs gives one row, repeated ones and those without an id too.
    Null and empty texts have no words.  Items with null or wordless texts
    have no windows; those without an id hit, but aren't listed in items.  An item may stand in several rows.
    An empty benchmark hits nothing.  Very long texts are read whole, in blocks.  A column of docs that has the name of a
    result is replaced by it.

    The benchmark goes to the tasks as an index of its windows, in as many parts
    of at most about ``index_bytes`` in memory as it takes; each part is one pass in the same
    stage.  Nothing is shuffled but counts by shingle of the benchmark.
    """
    ship(spark)
    sc = spark.sparkContext
    docs = docs.drop("n_words", "n_hit", "spans", "items", "contaminated")
    items = benchmark.select(F.col(item_col).cast("string").alias("i"), F.col(item_text_col).alias("t")).filter("t is not null")
    parts = 1 + EACH * (items.agg(F.sum(F.octet_length("t"))).first()[0] or 0) // index_bytes
    names = list(docs.columns)
    out = docs
    schema = T.StructType([*docs.schema.fields, *_ADDED])
    for part in range(parts):
        some = items.filter(F.pmod(F.xxhash64("i", "t"), F.lit(parts)) == part)
        windows = _Windows([(r.i, r.t.encode()) for r in some.toLocalIterator()], window)
        if not len(windows) and part < parts - 1:
            continue
        counts = {k: np.zeros(len(s), dtype=np.int64) for k, s in windows.every.items()}
        if len(windows):
            counted = docs.select(text_col).mapInArrow(_counting(sc.broadcast(windows.every)), "k int, at long, n long")
            got = counted.groupBy("k", "at").agg(F.sum("n").alias("n")).toArrow()  # a row for each shingle of this part at most
            which, at, n = (got.column(c).to_numpy() for c in ("k", "at", "n"))
            for k, mine in counts.items():
                mine[at[which == k]] = n[which == k]
        out = out.mapInArrow(_marking(sc.broadcast(_Index(windows, counts)), text_col), schema)
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    out = out.withColumn("n_hit", hit).withColumn("contaminated", (F.col("n_hit") > 0) & (F.lit(share) * F.col("n_hit") >= F.col("n_words")))
    return out.select(*names, "n_words", "n_hit", "spans", "items", "contaminated")

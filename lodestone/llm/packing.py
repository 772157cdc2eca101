"""Best-fit packing of tokenised documents into sequences of fixed length.

How well pieces fit depends on their lengths alone, so the plan is made from the
number of pieces of each length: at most one row for each length, whatever the
corpus.  A plan is a list of patterns (the lengths in a sequence) and how many
sequences have each.  Best-fit decreasing lays the first plan; local search then
exchanges one piece for one, two for one, or moves one, from an emptier to a
fuller sequence, so that the sum of squared fills rises until sequences empty.  Both work on all
sequences of a pattern at once.  Pieces of one length are numbered over the
cluster, and their numbers lead to sequence and offset.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Workspace

LENGTH = 2048
END = 0
_OTHER = re.compile("[^\x00-ɏ]|<\\|endoftext\\|>")
_LOADED: dict[str, tuple] = {}


def _encoders(path: str | None) -> tuple:
    """The vocabulary in both libraries; path: folder of the vocabulary files, by default that of public_tokenizers."""
    if path not in _LOADED:
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        at = (lambda name: f"{path}/{name}") if path else public_tokenizers.path
        with open(at("byte_bpe_50k.tiktoken"), "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        _LOADED[path] = Tokenizer.from_file(at("byte_bpe_50k.json")), tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _LOADED[path]


def token_ids(text: str, path: str | None = None) -> np.ndarray:
    """The ids that tokenizers gives.

    tiktoken has the same merges and is four times as fast; texts with special
    tokens or beyond Latin letters, where the two might split differently, go to tokenizers.
    """
    slow, fast = _encoders(path)
    if _OTHER.search(text):
        return np.array(slow.encode(text, add_special_tokens=False).ids, dtype="<u4")
    return np.array(fast.encode_ordinary(text), dtype="<u4")


def _pieces(path: str | None, length: int, end: int):
    def run(items: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, seen = TaskContext.get().partitionId(), defaultdict(int)
        for batch in items:
            rows = []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = np.append(token_ids(text or "", path), np.uint32(end)).astype("<u4")
                first = len(ids) % length or length
                cuts = [0, *range(first, len(ids) + 1, length)]
                for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    rows.append((i, k, a, b - a, zlib.crc32(ids[a:b].tobytes()), task, seen[b - a]))
                    seen[b - a] += 1
            if rows:
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32", "task", "k"])

    return run


class Plan:
    """How many sequences have each pattern (lengths, longest first)."""

    def __init__(self, counts: dict[int, int], length: int, rising: bool = False):
        """The first plan, by best fit of falling lengths, or of rising ones: a poor one, for the search to better."""
        self.length = length
        self.groups: dict[tuple[int, ...], int] = defaultdict(int)
        self._best_fit(counts, rising)

    def _best_fit(self, counts: dict[int, int], rising: bool) -> None:
        left: dict[int, dict[tuple[int, ...], int]] = defaultdict(dict)  # by room
        open_ = 0  # bit r: a sequence has room r

        def put(room: int, pattern: tuple[int, ...], n: int) -> int:
            left[room][pattern] = left[room].get(pattern, 0) + n
            return open_ | 1 << room

        for size in sorted(counts, reverse=not rising):
            n = counts[size]
            while n:
                fits = open_ >> size
                if not fits:
                    each = self.length // size
                    if n >= each:
                        open_ = put(self.length - each * size, (size,) * each, n // each)
                        n %= each
                    if n:
                        open_ = put(self.length - n * size, (size,) * n, 1)
                    break
                room = size + (fits & -fits).bit_length() - 1
                pattern, m = left[room].popitem()
                if m > n:
                    left[room][pattern] = m - n
                elif not left[room]:
                    open_ &= ~(1 << room)
                open_ = put(room - size, (*pattern, size), min(m, n))
                n -= min(m, n)
        for patterns in left.values():
            for pattern, n in patterns.items():
                self.groups[tuple(sorted(pattern, reverse=True))] += n

    @property
    def sequences(self) -> int:
        return sum(self.groups.values())

    def improve(self, steps: int | None = None) -> Plan:
        """Local search: the emptiest pattern gives to any other with room, most gain first, until none has a gaining exchange.

        The sum of squared fills rises with each exchange, so the search ends.
        ``steps`` bounds the exchanges; None doesn't.
        """
        search, done, moved = _Search(self.groups, self.length), 0, True
        least = -(-sum(sum(p) * n for p, n in self.groups.items()) // self.length)
        used = self.sequences
        while moved:
            moved, turn = False, [(sum(p), p) for p in self.groups if sum(p) < self.length]
            heapify(turn)
            waiting = {p for _, p in turn}
            while turn:
                if used <= least or done == steps:
                    return self
                _, a = heappop(turn)
                waiting.discard(a)
                if a not in self.groups or (best := search.exchange(a)) is None:
                    continue  # if anything moves meanwhile, it has another turn
                emptied, touched = search.apply(a, *best)
                used, done, moved = used - emptied, done + 1, True
                for p in touched:
                    if p in self.groups and p not in waiting and sum(p) < self.length:
                        waiting.add(p)
                        heappush(turn, (sum(p), p))
        return self

    def runs(self) -> dict[int, np.ndarray]:
        """By length: rows (first number of a piece, its sequence, offset); later numbers follow in later sequences."""
        out, seen, base = defaultdict(list), defaultdict(int), 0
        for pattern in sorted(self.groups, reverse=True):
            n, at = self.groups[pattern], 0
            for size in pattern:
                out[size].append((seen[size], base, at))
                seen[size] += n
                at += size
            base += n
        return {size: np.array(rows, dtype=np.int64) for size, rows in out.items()}


class _Search:
    """Exchanges between a plan's patterns; those with room are found by room and by the lengths they hold."""

    def __init__(self, groups: dict[tuple[int, ...], int], length: int):
        self.groups, self.length = groups, length
        self.held: dict[tuple[int, int], dict[tuple[int, ...], None]] = defaultdict(dict)  # by room and length, 0 for all of the room
        self.in_room = np.zeros(length, dtype=np.int64)  # patterns
        # by room and x: the shortest piece of x or more that a pattern with the room holds, 2 * length if none
        self.next = np.full((length, length + 2), 2 * length, dtype=np.int32)
        for p in groups:
            self._list(p)

    def _list(self, p: tuple[int, ...]) -> None:
        room = self.length - sum(p)
        if not room:
            return
        self.in_room[room] += 1
        for s in {0, *p}:
            held, row = self.held[room, s], self.next[room]
            if s and not held:
                row[row.searchsorted(row[s]) : s + 1] = s
            held[p] = None

    def _unlist(self, p: tuple[int, ...]) -> None:
        room = self.length - sum(p)
        if not room:
            return
        self.in_room[room] -= 1
        for s in {0, *p}:
            held, row = self.held[room, s], self.next[room]
            del held[p]
            if s and not held:
                row[row.searchsorted(s) : s + 1] = row[s + 1]

    def exchange(self, a: tuple[int, ...]) -> tuple | None:
        """(b, out, back) that raise the sum of squares most when a gives out to b for back; one or two for none or one."""
        if alone := self.groups[a] == 1:
            self._unlist(a)
        fill, gives = sum(a), {}
        for i in range(len(a)):
            for j in range(i + 1, len(a)):
                gives.setdefault(a[i] + a[j], (a[i], a[j]))
        gives |= {s: (s,) for s in a}  # one rather than two of the same sum: it has the same exchanges, and the move
        found, rooms = None, np.flatnonzero(self.in_room)[:, None]
        if len(rooms):
            size, one = np.array(list(gives)), np.array([len(out) == 1 for out in gives.values()])
            back = self.next.take(rooms * self.next.shape[1] + np.maximum(size - rooms, 1))
            back *= (size > rooms) | ~one
            more = np.maximum(size - back, 0)
            gain = more * (more + (self.length - fill - rooms))  # half of what the sum of squares gains
            r, g = divmod(int(gain.argmax()), len(size))
            if gain[r, g] > 0:
                s = int(back[r, g])
                found = next(iter(self.held[int(rooms[r, 0]), s])), gives[int(size[g])], (s,) if s else ()
        if alone:
            self._list(a)
        return found

    def apply(self, a: tuple[int, ...], b: tuple[int, ...], out: tuple[int, ...], back: tuple[int, ...]) -> tuple[int, list[tuple[int, ...]]]:
        """In all pairs of a sequence like a and one like b, ``out`` goes from a to b and ``back`` from b to a: how many empty, and the patterns concerned."""
        n = min(self.groups[a], self.groups[b]) if a != b else self.groups[a] // 2
        x, y = list(a), list(b)
        for s in out:
            x.remove(s)
            y.append(s)
        for s in back:
            y.remove(s)
            x.append(s)
        for p in (a, b):
            self.groups[p] -= n
            if not self.groups[p]:
                del self.groups[p]
                self._unlist(p)
        made = [tuple(sorted(z, reverse=True)) for z in (x, y) if z]
        for p in made:
            if p not in self.groups:
                self._list(p)
            self.groups[p] += n
        return n * (2 - len(made)), [a, b, *made]


def _placed(shared):
    def run(items: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = shared.value
        for batch in items:
            size, number = batch.column("length").to_numpy(), batch.column("number").to_numpy()
            seq, at = np.zeros(len(size), dtype=np.int64), np.zeros(len(size), dtype=np.int64)
            order = np.argsort(size, kind="stable")
            cut = np.flatnonzero(np.r_[True, np.diff(size[order]) > 0]) if len(size) else []
            for mine in np.split(order, cut[1:]) if len(size) else []:
                table = runs[int(size[mine[0]])]
                i = np.searchsorted(table[:, 0], number[mine], "right") - 1
                seq[mine], at[mine] = table[i, 1] + number[mine] - table[i, 0], table[i, 2]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(seq), pa.array(at)], names=[*names, "sequence_id", "offset"])

    return run


def pack(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, end: int = END, tokenizer_dir: str | None = None, steps: int | None = None) -> DataFrame:
    """A row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A document is its ids and then ``end``; null and empty texts are ``end`` alone.  One of
    more than ``length`` ids is cut into pieces of ``length``, of which the first may
    be shorter.  Very long texts are tokenised whole.  Repeated rows and rows without an id are packed as any other.
    No rows give no rows.  Other columns are left out.
    """
    ws = Workspace(spark, "packing")
    pieces = docs.select(F.col(id_col).cast("long"), text_col).mapInArrow(_pieces(tokenizer_dir, length, end), "doc_id long, piece int, start long, length long, ids_crc32 long, task int, k long")
    pieces = ws.keep(pieces, "pieces")
    counts = ws.keep(pieces.groupBy("task", "length").agg(F.count("*").alias("n")), "counts")
    plan = Plan({r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}, length).improve(steps)
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select("task", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    numbered = pieces.join(first.hint("merge"), ["task", "length"]).withColumn("number", F.col("first") + F.col("k"))
    return numbered.mapInArrow(_placed(spark.sparkContext.broadcast(plan.runs())), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")

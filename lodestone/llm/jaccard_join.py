"""N-gram Jaccard join: every link between texts of similar word-shingle sets, as components.

The sets meet in signature trees, of which the upper levels are dealt over the
cluster and the lower levels are built in memory:

1. Sets are reduced to classes of equal sets (partial aggregation).
2. The root's children are tokens.  A range of the token numbers, wide enough
   to hold more than the tokens that a linked partner may lack, is counted over
   all classes.  A class of which more tokens occur nowhere else than a partner may
   lack has no partner.  Of the others, each hangs under its rarest tokens, so
   many that two linked sets share one.  Tokens under which the same class is
   the first are taken as one child, a family.
3. Each family gets a tree of OR-combined bitmaps and size ranges.  The dual
   traversal yields pairs that may overlap enough, and these are compared
   exactly in the same task.  First each class takes part in the family that has most of
   its tokens, which links most members of a group of copies; then come the families that
   still hold several components, and only pairs of unlike components.
4. Families of more than ``BLOCK`` sets are dealt in blocks: each with the family's first set, then,
   of families that still hold several components, pairs of blocks.

Tokens are 64-bit numbers of shingles.  Candidates use 48 bits of them, which
can only add candidates.  Two different shingles of one pair of texts get the same number
with a chance of about n * n / 2**64.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace, blocks, deal, input_bytes, mix, shuffle_partitions, spread_join, text_bytes, whole_groups
from .components import connected_components
from .signature_tree import Forest
from .words import SPACED, Block

UP, DOWN = 80, 100  # a link: DOWN * intersection >= UP * union
BLOCK = 512  # sets of a block
WEIGHT = 1 << 20  # tokens of a block
SPLIT = 1_000_000  # families that are split, at most, each for its sets and for its tokens
SHARE = 256 << 20  # bytes of input for which there is a group of tokens in a task
_LOW = np.uint64(16)


def _range(n: np.ndarray) -> np.ndarray:
    """The part of the token numbers, of 2**48, that is counted for a set of n tokens; it falls with n.

    A linked partner lacks at most a fifth of a set's tokens.  Where the range holds more of them than that, it has one of
    those that the set hangs under.  Where it doesn't, the set hangs under all that it shares in the range, and a
    link is lost only if the partner lacks every one of the c tokens there: with numbers spread evenly, a chance of at most
    the mean of 0.2**c, which is (1 - 0.8 share)**n: 0 for n < 48 (the range is whole), 2e-11 from 48 on, 6e-16 from 128 on.
    """
    return np.where(n >= 128, (1 << 48) * 3 // 10, np.where(n >= 48, 1 << 47, 1 << 48)).astype(np.int64)


def _wider(n: np.ndarray) -> np.ndarray:
    """The largest set that can be linked with one of n tokens."""
    return n * DOWN // UP


def _lack(n: np.ndarray) -> np.ndarray:
    """The most tokens of a set of n that a linked partner can lack."""
    return n - (n * UP + DOWN - 1) // DOWN


def _pack(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :6]


def _unpack(x: np.ndarray) -> np.ndarray:
    out = np.zeros((len(x), 8), dtype=np.uint8)
    out[:, :6] = x
    return out.reshape(-1).view("<u8").astype(np.int64)


def _digest(tokens: np.ndarray) -> tuple[int, int]:
    one = mix(tokens + np.uint64(len(tokens))).sum(dtype=np.uint64)
    two = mix(tokens ^ np.uint64(0xA5A5A5A5DEADBEEF)).sum(dtype=np.uint64)
    return int(mix(one[None])[0].astype(np.int64)), int(two.astype(np.int64))


def _texts(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
    ids, texts = batch.column(0).to_pylist(), text_bytes(batch.column(1))
    for a, b in blocks(texts):
        yield from zip(ids[a:b], Block(texts[a:b], SPACED).sets(_texts.k), strict=True)


_texts.k = 5


def _features(items: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in items:
        rows = []
        for i, s in _texts(batch):
            n = len(s)
            low = (s >> _LOW).astype(np.int64)
            near = [int(np.searchsorted(low, _range(m))) for m in (_wider(np.int64(n)), _wider(_wider(np.int64(n))))]
            rows.append((i, n, *_digest(s), *near))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows, strict=True)], names=["doc_id", "n", "h1", "h2", "n1", "n2"])


def _dealt(parts: int, key: np.ndarray, rows: np.ndarray) -> pa.RecordBatch:
    """A row (part, blob) for each part of the keys."""
    part = key % parts
    order = np.argsort(part, kind="stable")
    part, rows = part[order], rows[order]
    cut = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
    ends = np.r_[cut[1:], len(part)]
    return pa.RecordBatch.from_arrays([pa.array(part[cut].astype(np.int32)), pa.array([rows[a:b].tobytes() for a, b in zip(cut, ends, strict=True)], pa.binary())], names=["part", "blob"])


def _counted(parts: int):
    """(part of the token, blob of token and class) for the tokens in range; rows are put together to about 600,000."""

    def run(items: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep, size, seen = [], 0, set()

        def out() -> pa.RecordBatch:
            token, owner = (np.concatenate(x) for x in zip(*keep, strict=True))
            return _dealt(parts, token, np.concatenate([_pack(token), _pack(owner)], axis=1))

        for batch in items:
            for i, s in _texts(batch):
                if i is None or not len(s) or (h := _digest(s)) in seen:
                    continue
                seen.add(h)
                low = (s >> _LOW).astype(np.int64)
                low = low[: np.searchsorted(low, _range(np.int64(len(s))))]
                keep.append((low, np.full(len(low), np.uint64(h[0] & (2**64 - 1)) >> _LOW, dtype=np.int64)))
                size += len(low)
                if size > 600_000:
                    yield out()
                    keep, size, seen = [], 0, set()
        if keep:
            yield out()

    return run


def streamed(items: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The runs of rows of equal keys, from batches in which such rows follow each other."""
    open_, last = [], None
    for batch in items:
        if not batch.num_rows:
            continue
        cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(batch.num_rows, dtype=bool)
        for c in cols:
            change[1:] |= c[1:] != c[:-1]
        cut = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        for a, b in zip(cut, cut[1:], strict=False):
            key = tuple(c[a] for c in cols)
            if last is not None and key != last:
                yield pa.Table.from_batches(open_)
                open_ = []
            open_.append(batch.slice(a, b - a))
            last = key
    if open_:
        yield pa.Table.from_batches(open_)


def _shared(parts: int):
    """(part of the class, blob of class, token and number of classes) for tokens of two classes or more."""

    def run(items: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in streamed(items, ["part"]):
            raw = np.frombuffer(b"".join(group.column("blob").to_pylist()), dtype=np.uint8).reshape(-1, 12)
            token, owner = _unpack(raw[:, :6]), _unpack(raw[:, 6:])
            order = np.lexsort((owner, token))
            token, owner = token[order], owner[order]
            new = np.r_[True, (token[1:] != token[:-1]) | (owner[1:] != owner[:-1])]
            token, owner = token[new], owner[new]
            _, at, n = np.unique(token, return_inverse=True, return_counts=True)
            n = n[at]
            token, owner, n = token[n > 1], owner[n > 1], n[n > 1]
            if len(token):
                yield _dealt(parts, owner, np.concatenate([_pack(owner), _pack(token), n.astype("<u4").view(np.uint8).reshape(-1, 4)], axis=1))

    return run


def _hung(items: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(token, id, n): the tokens under which each class that may have a partner hangs."""
    for group in streamed(items, ["part"]):
        blob = group.column("blob")
        classes = group.filter(pc.is_null(blob))
        owner, ident, n, n1, n2 = (classes.column(c).to_numpy() for c in ("h", "id", "n", "n1", "n2"))
        raw = b"".join(x for x in blob.to_pylist() if x is not None)
        if not raw or not len(owner):
            continue
        raw = np.frombuffer(raw, dtype=np.uint8).reshape(-1, 16)
        whose, token, df = _unpack(raw[:, :6]), _unpack(raw[:, 6:12]), np.ascontiguousarray(raw[:, 12:]).view("<u4").reshape(-1)
        order = np.lexsort((token, df, whose))
        whose, token = whose[order], token[order]
        a, b = np.searchsorted(whose, owner, "left"), np.searchsorted(whose, owner, "right")
        out_token, out_id, out_n = [], [], []
        for i in np.flatnonzero(b > a).tolist():
            mine, lack, under = token[a[i] : b[i]], int(_lack(n[i])), []
            for near, m in ((n1[i], _wider(n[i])), (n2[i], _wider(_wider(n[i])))):
                inside = mine[mine < _range(m)]
                own = int(near) - len(inside)  # tokens of no other class: the rarest, under which nothing else hangs
                if own <= lack:
                    under.append(inside[: lack + 1 - own])
            if under:
                under = np.unique(np.concatenate(under))
                out_token.append(under)
                out_id.append(np.full(len(under), ident[i], dtype=np.int64))
                out_n.append(np.full(len(under), n[i], dtype=np.int64))
        if out_token:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (out_token, out_id, out_n)], names=["token", "id", "n"])


def _sets(items: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in items:
        rows = [(i, s.tobytes()) for i, s in _texts(batch)]
        if rows:
            i, tokens = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(i, pa.int64()), pa.array(tokens, pa.binary())], names=["id", "tokens"])


def _linking(items: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (what, a, b): the links that the traversal of each pair of blocks leaves ("link"), and
    what it took ("work"): trees built, and pairs compared."""
    trees = compared = 0
    for table, start in whole_groups(items, ["family", "i", "j"]):
        ident, label, side, i, j = (table.column(c).to_numpy() for c in ("id", "label", "side", "i", "j"))
        tokens = [np.frombuffer(t, dtype=np.uint64) for t in table.column("tokens").to_pylist()]
        pair = np.repeat(np.arange(len(start)), np.diff(np.r_[start, len(ident)]))
        new = np.r_[True, (pair[1:] != pair[:-1]) | (side[1:] != side[:-1])]
        group, first = np.cumsum(new) - 1, np.flatnonzero(new)
        # a block is traversed with itself, or the first side of a pair of blocks with the second
        both = np.flatnonzero((i[first[:-1]] != j[first[:-1]]) & (pair[first[:-1]] == pair[first[1:]]))
        alone = np.flatnonzero(i[first] == j[first])
        forest = Forest(group, tokens, UP, DOWN)
        a, b = forest.links(np.r_[alone, both], np.r_[alone, both + 1], label)
        trees, compared = trees + forest.trees, compared + forest.compared
        if len(a):
            yield pa.RecordBatch.from_arrays([pa.array(["link"] * len(a)), pa.array(ident[a]), pa.array(ident[b])], names=["what", "a", "b"])
    yield pa.RecordBatch.from_arrays([pa.array(["work"]), pa.array([trees], pa.int64()), pa.array([compared], pa.int64())], names=["what", "a", "b"])


def jaccard_components(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", work: dict[str, int] | None = None) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of docs.

    A text's words are runs of characters other than white space, A-Z
    lower-cased; its set has its distinct shingles of five words, or all its words as
    one if it has fewer.  Texts link when 100 * intersection >= 80 * union.
    ``work``, if given, gets the numbers of trees built, pairs compared and links found.

    Null and empty texts and texts of white space have an empty set and no link.
    Rows without an id get no component.  A repeated row is a copy.  Rows that
    share an id, whatever their texts, are one document: it is linked with all that any of them is.
    Very long texts are taken whole; one text's set has to fit in a worker's memory.
    Other columns than id and text are left out.  No rows give no rows.
    """
    ws, parts = Workspace(spark, "jaccard"), shuffle_partitions(spark)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    feats = ws.keep(docs.mapInArrow(_features, "doc_id long, n long, h1 long, h2 long, n1 long, n2 long"), "features")
    valid = feats.filter("doc_id is not null and n > 0")
    equal = ["h1", "h2", "n"]
    classes = valid.groupBy(*equal).agg(F.min("doc_id").alias("id"), F.first("n1").alias("n1"), F.first("n2").alias("n2"), F.count("*").alias("many"))
    classes = ws.keep(classes, "classes")
    shared_ids = ws.keep(valid.groupBy("doc_id").agg(F.count("*").alias("rows"), F.min("h1").alias("low"), F.max("h1").alias("high")).filter("rows > 1"), "shared-ids")
    repeated = bool(shared_ids.take(1))

    # tokens of two classes or more, and the tokens under which each class hangs; a task holds one group of tokens at a time
    groups = parts * min(64, max(1, math.ceil(input_bytes(docs) / parts / SHARE)))
    counted = deal(docs.mapInArrow(_counted(groups), "part int, blob binary"), parts)
    h = F.shiftrightunsigned("h1", 16)
    rows = classes.select((h % groups).cast("int").alias("part"), h.alias("h"), "id", "n", "n1", "n2", F.lit(None).cast("binary").alias("blob"))
    none = [F.lit(None).cast("long").alias(c) for c in ("h", "id", "n", "n1", "n2")]
    rows = deal(rows.unionByName(counted.mapInArrow(_shared(groups), "part int, blob binary").select("part", *none, "blob")), parts)
    hung = ws.keep(rows.mapInArrow(_hung, "token long, id long, n long"), "hung")
    first = ws.keep(hung.groupBy("token").agg(F.min("id").alias("family"), F.count("*").alias("many")).filter("many > 1"), "first")
    under = spread_join(hung, first, ["token"], "many")
    held = ws.keep(under.groupBy("family", "id").agg(F.count("*").alias("tokens"), F.first("n").alias("n")), "held")

    sets = docs.join(held.select(F.col("id").alias("doc_id")).distinct(), "doc_id", "left_semi").mapInArrow(_sets, "id long, tokens binary")
    sets = ws.keep(sets.dropDuplicates(["id", "tokens"]) if repeated else sets, "sets")
    links: list[DataFrame] = []

    def traversed(rows: DataFrame, name: str) -> bool:
        """Links from rows (family, i, j, side, id, label): whether there are any."""
        rows = rows.join(sets, "id").repartition(parts, "family", "i", "j").sortWithinPartitions("family", "i", "j", "side")
        got = ws.keep(rows.mapInArrow(_linking, "what string, a long, b long"), name)
        links.append(got.filter("what = 'link'").select("a", "b"))
        if work is not None:
            for r in got.groupBy("what").agg(F.count("*").alias("n"), F.sum("a").alias("a"), F.sum("b").alias("b")).collect():  # two rows
                for key, n in (("links", r.n),) if r.what == "link" else (("trees", r.a), ("compared", r.b)):
                    work[key] = work.get(key, 0) + n
        return bool(links[-1].take(1))

    if repeated:
        texts = valid.join(shared_ids.filter("low <> high").select("doc_id"), "doc_id", "left_semi").select("doc_id", *equal).distinct()
        links.append(ws.keep(texts.join(classes, equal).select(F.col("doc_id").alias("a"), F.col("id").alias("b")), "links-of-ids"))

    # each class in the family that has most of its tokens
    main = held.filter("id <> family").groupBy("id").agg(F.max_by("family", F.struct("tokens", -F.col("family"))).alias("family"), F.first("n").alias("n"))
    main = ws.keep(main, "main")
    sizes = ws.keep(main.groupBy("family").agg(F.count("*").alias("k"), F.sum("n").alias("w")), "sizes")
    all_, blocks_ = sizes.agg(F.sum("k"), F.sum("w")).first(), F.ceil(F.greatest(F.col("k") / BLOCK, F.col("w") / WEIGHT)).cast("int")
    split = sizes.filter((F.col("k") > max(BLOCK, (all_[0] or 0) // SPLIT)) | (F.col("w") > max(WEIGHT, (all_[1] or 0) // SPLIT)))
    split = split.select("family", blocks_.alias("blocks"))  # so few that they can be broadcast
    own = F.pmod(F.xxhash64("id"), F.coalesce("blocks", F.lit(1))).cast("int")
    rows = main.join(F.broadcast(split), "family", "left").select("family", "id", own.alias("i"))
    heads = sizes.join(F.broadcast(split), "family", "left").select("family", F.col("family").alias("id"), F.explode(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1)).alias("i"))
    rows = rows.unionByName(heads).select("family", "id", "i", F.col("i").alias("j"), F.lit(0).alias("side"), F.col("id").alias("label"))
    traversed(rows, "links-1")
    every = lambda: functools.reduce(DataFrame.unionByName, links)
    comp = connected_components(spark, ws, every(), "cc1")

    # families that still hold several components: the largest one's sets with the others', and these with each other
    def labelled(df: DataFrame, key: str, out: str) -> DataFrame:
        c = comp.select(F.col("node").alias(key), F.col("component").alias("_c"))
        return df.join(c, key, "left").withColumn(out, F.coalesce("_c", key)).drop("_c")

    held = ws.keep(labelled(held.select("family", "id", "n"), "id", "label"), "labelled")
    by = held.groupBy("family", "label").agg(F.count("*").alias("k"), F.sum("n").alias("w"))
    number = lambda k, w: F.ceil(F.greatest(k / BLOCK, w / WEIGHT)).cast("int")
    mixed = by.groupBy("family").agg(F.max_by("label", "k").alias("main"), F.max_by("w", "k").alias("w"), F.max("k").alias("k"), F.sum("k").alias("many"), F.sum("w").alias("weight"), F.count("*").alias("labels"))
    k, w, many, weight = map(F.col, ("k", "w", "many", "weight"))
    mixed = mixed.filter("labels > 1").select("family", "main", "many", number(k, w).alias("km"), number(many - k, weight - w).alias("kr"), (number(many, weight) == 1).alias("one"))
    mixed = ws.keep(mixed, "mixed")
    held = spread_join(held, mixed, ["family"], "many")
    is_main, spread = F.expr("label = main"), F.expr("pmod(xxhash64(id), 1000003)")
    held = held.withColumn("is_main", is_main).withColumn("own", F.when(is_main, spread % F.col("km")).otherwise(spread % F.col("kr")).cast("int"))
    # blocks of the largest component are -1, -2, ...; the others 0, 1, ...
    pairs = (
        F.when(F.col("one"), F.expr("array(struct(0 as i, 0 as j, 0 as side))"))
        .when(F.col("is_main"), F.expr("transform(sequence(0, kr - 1), r -> struct(-1 - own as i, r as j, 0 as side))"))
        .otherwise(F.expr("concat(transform(sequence(1, km), m -> struct(-m as i, own as j, 1 as side)), transform(sequence(0, kr - 1), r -> struct(least(own, r) as i, greatest(own, r) as j, if(own <= r, 0, 1) as side)))"))
    )
    rows = held.select("family", "id", "label", F.explode(pairs).alias("p")).select("family", "p.i", "p.j", "p.side", "id", "label")
    if traversed(rows, "links-2"):
        comp = connected_components(spark, ws, every(), "cc2")
    best = ws.keep(labelled(classes, "id", "component_id").select(*equal, "component_id", "many"), "best")
    alone = F.when(F.col("n") == 0, F.col("doc_id"))
    out = spread_join(valid.select("doc_id", *equal), best, equal, "many").select("doc_id", "n", "component_id")
    out = out.unionByName(feats.filter("doc_id is null or n = 0").select("doc_id", "n", alone.alias("component_id")))
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id")


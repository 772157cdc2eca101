"""Quality classifier: a factorisation machine over hashed words, structure and metadata.

score = sigmoid(w0 + sum w_i x_i + 1/2 sum_f ((sum v_if x_i)^2 - sum (v_if x_i)^2)),
which takes time in proportion to the features of a text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.sample import sample_rows
from .common import Workspace, blocks, ship, text_bytes
from .words import SPACED, Block

WORDS = 1 << 15
BINS = 16
STATS = 10
RANK = 8
SAMPLE = 8000  # labelled rows that the model is fitted on, at most
FEATURES = 20_000_000  # features that these have together, at most
CUT = 0.3

_KIND = np.zeros(256, dtype=np.uint8)
_KIND[48:58] = 1
_KIND[97:123] = _KIND[128:] = 2
_KIND[65:91] = 3
_KIND[[32, 9, 10, 11, 12, 13]] = 4


def _bins(x: np.ndarray) -> np.ndarray:
    """Of shares: fine near 0 and 1."""
    return np.clip((np.arcsin(np.sqrt(np.clip(x, 0, 1))) * 2 / np.pi * BINS).astype(np.int64), 0, BINS - 1)


def _logs(x: np.ndarray) -> np.ndarray:
    return np.clip(np.log2(1 + np.maximum(x, 0)).astype(np.int64), 0, BINS - 1)


def size(metadata: int) -> int:
    return WORDS + BINS * (STATS + metadata)


def features(texts: list[bytes], metadata: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, feature, value), in order of the texts.

    Words weigh log(1 + count), scaled to a norm of 1 over the text; each structure
    statistic and number of the metadata is one feature of value 1, its bin.
    """
    n, block = len(texts), Block(texts, SPACED)
    words = np.diff(block.first)
    text = np.repeat(np.arange(n), words)
    key, count = np.unique(text * WORDS + (block.word >> np.uint64(49)).astype(np.int64), return_counts=True)
    text, feature = key // WORDS, key % WORDS
    value = np.log1p(count)
    norm = np.sqrt(np.bincount(text, value * value, minlength=n))
    value = value / np.maximum(norm[text], 1e-12)
    raw = np.frombuffer(b"".join(texts), dtype=np.uint8)
    lengths = np.array([len(t) for t in texts])
    kinds = np.bincount(np.repeat(np.arange(n), lengths) * 5 + _KIND[raw], minlength=5 * n).reshape(n, 5)
    kinds = kinds / np.maximum(lengths, 1)[:, None]
    lines = [t.split(b"\n") for t in texts]
    alone = np.array([len(set(x)) / len(x) for x in lines])
    again = np.zeros(n)
    if len(block.word) > 1:  # words that repeat the one before
        same = (block.word[1:] == block.word[:-1]) & block.whole(2)
        again = np.bincount(np.searchsorted(block.first, np.flatnonzero(same), "right") - 1, minlength=n)
    kinds_of_words = np.bincount(text, minlength=n) / np.maximum(words, 1)
    stats = [_bins(kinds[:, 0]), _bins(kinds[:, 1]), _bins(kinds[:, 3]), _bins(kinds[:, 4]), _bins(alone), _bins(again / np.maximum(words, 1)), _bins(kinds_of_words), _logs(words), _logs(4 * lengths / np.maximum(words, 1)), _logs(words / np.array([len(x) for x in lines]))]
    stats += [_logs(np.nan_to_num(m.astype(np.float64), nan=0.0)) for m in metadata]
    own = np.stack([WORDS + i * BINS + s for i, s in enumerate(stats)], axis=1)
    k = own.shape[1]
    text = np.concatenate([text, np.repeat(np.arange(n), k)])
    order = np.argsort(text, kind="stable")
    return text[order], np.concatenate([feature, own.reshape(-1)])[order], np.concatenate([value, np.ones(n * k)])[order]


class Machine:
    def __init__(self, bias: float, w: np.ndarray, v: np.ndarray):
        self.bias, self.w, self.v = bias, w, v

    def _raw(self, n: int, text: np.ndarray, feature: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        out, sums = self.bias + np.bincount(text, self.w[feature] * value, minlength=n), np.empty((n, self.v.shape[1]))
        for f in range(self.v.shape[1]):
            x = self.v[feature, f] * value
            sums[:, f] = np.bincount(text, x, minlength=n)
            out += 0.5 * (sums[:, f] ** 2 - np.bincount(text, x * x, minlength=n))
        return out, sums

    def scores(self, n: int, text: np.ndarray, feature: np.ndarray, value: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self._raw(n, text, feature, value)[0], -30, 30)))

    @classmethod
    def fit(cls, dim: int, rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, rank: int = RANK, epochs: int = 12, rate: float = 0.1, decay: float = 1e-4, batch: int = 64, seed: int = 7) -> Machine:
        """AdaGrad on the log loss; rows: (features, values) of each text."""
        rng = np.random.default_rng(seed)
        share = (labels.sum() + 1) / (len(labels) + 2)
        out = cls(float(np.log(share / (1 - share))), np.zeros(dim), rng.normal(0, 0.02, (dim, rank)))
        gw, gv = np.full(dim, 1e-2), np.full((dim, rank), 1e-2)
        for _ in range(epochs if len(labels) else 0):
            order = rng.permutation(len(labels))
            for at in range(0, len(order), batch):
                mine = order[at : at + batch]
                text = np.repeat(np.arange(len(mine)), [len(rows[i][0]) for i in mine])
                feature, value = (np.concatenate([rows[i][j] for i in mine]) for j in (0, 1))
                raw, sums = out._raw(len(mine), text, feature, value)
                slope = (1 / (1 + np.exp(-np.clip(raw, -30, 30))) - labels[mine]) / len(mine)
                used, at_used = np.unique(feature, return_inverse=True)
                g = slope[text] * value
                own = np.bincount(at_used, g) + decay * out.w[used]
                gw[used] += own * own
                out.w[used] -= rate * own / np.sqrt(gw[used])
                out.bias -= rate * slope.sum() / 10
                for f in range(rank):
                    own = np.bincount(at_used, g * (sums[text, f] - out.v[feature, f] * value)) + decay * out.v[used, f]
                    gv[used, f] += own * own
                    out.v[used, f] -= rate * own / np.sqrt(gv[used, f]) / 2
        return out


def _numbers(batch: pa.RecordBatch, columns: list[str]) -> list[np.ndarray]:
    return [np.array([np.nan if x is None else float(x) for x in batch.column(c).to_pylist()]) for c in columns]


def _gathered(items: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(place, label, f, x): features and values of rows (place, label, text, metadata ...)."""
    for batch in items:
        texts, extra = text_bytes(batch.column("text")), _numbers(batch, batch.schema.names[3:])
        for a, b in blocks(texts):
            text, feature, value = features(texts[a:b], [m[a:b] for m in extra])
            cut = np.searchsorted(text, np.arange(b - a + 1))
            both = [(feature[x:y].astype("<i4").tobytes(), value[x:y].astype("<f4").tobytes()) for x, y in zip(cut, cut[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(a, b - a) for c in ("place", "label")), *(pa.array(x, pa.binary()) for x in zip(*both, strict=True))], names=["place", "label", "f", "x"])


def _scored(shared, text_col: str, metadata: list[str]):
    def run(items: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = shared.value
        for batch in items:
            if not batch.num_rows:
                continue
            texts, extra = text_bytes(batch.column(text_col)), _numbers(batch, metadata)
            scores = [machine.scores(b - a, *features(texts[a:b], [m[a:b] for m in extra])) for a, b in blocks(texts)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(scores))], names=[*batch.schema.names, "score"])

    return run


def train(spark: SparkSession, docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", metadata: tuple[str, ...] = ("n_chars",), sample: int = SAMPLE, most: int = FEATURES) -> Machine:
    """Fit on at most ``sample`` labelled ids, those with the smallest hashes, and of these on the first that have ``most`` features together.

    Ids, nulls and labels other than 0 and 1 apart, any label counts; repeated label rows count once, and so do rows of docs that share
    an id: one of their texts is taken.  Without any, the model scores 0.5.  Columns of any other names may be there.
    """
    ws = Workspace(spark, "quality")
    some = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).filter("id is not null and label in (0, 1)")
    some = sample_rows(some.distinct(), sample, ["id"]).withColumn("place", F.xxhash64(F.col("id").cast("string")))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), *(F.col(m).alias(f"m{i}") for i, m in enumerate(metadata)))
    rows = rows.join(F.broadcast(some), "id").select("place", "label", "text", *(f"m{i}" for i in range(len(metadata))))  # at most ``sample`` rows of three numbers
    got = rows.mapInArrow(_gathered, "place long, label int, f binary, x binary")
    got = ws.keep(got.groupBy("place", "label").agg(F.min(F.struct("f", "x")).alias("v")).select("place", "label", "v.*"), "sample")
    # at most ``sample`` rows of two numbers, and then of ``most`` features
    sizes = sorted((r.place, r.label, r.n) for r in got.select("place", "label", (F.octet_length("f") / 4).cast("long").alias("n")).collect())
    kept = int(np.searchsorted(np.cumsum([n for *_, n in sizes]), most, "right"))
    rows = sorted(got.filter(F.col("place") <= sizes[kept - 1][0]).toLocalIterator(), key=lambda r: (r["place"], r["label"]))[:kept] if kept else []
    pairs = [(np.frombuffer(r["f"], dtype="<i4"), np.frombuffer(r["x"], dtype="<f4").astype(np.float64)) for r in rows]
    return Machine.fit(size(len(metadata)), pairs, np.array([r["label"] for r in rows], dtype=np.float64))


def score(spark: SparkSession, docs: DataFrame, machine: Machine, text_col: str = "text", metadata: tuple[str, ...] = ("n_chars",), cut: float = CUT) -> DataFrame:
    """docs with score (0 to 1) and predicted (1 if score >= cut, else 0).

    Null texts count as empty, null metadata as 0.  Every row gets a score, repeated ones too, and very long texts
    are read whole.  No rows give no rows.
    Columns named score and predicted are replaced.
    """
    ship(spark)
    docs = docs.drop("score", "predicted")
    schema = T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType())])
    out = docs.mapInArrow(_scored(spark.sparkContext.broadcast(machine), text_col, list(metadata)), schema)
    return out.withColumn("predicted", (F.col("score") >= cut).cast("int"))


def held_out(id_col: str = "doc_id"):
    """Whether a row is kept from training: crc32 of its id as text divides by 5; false without an id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))

"""Secret scans with ownership counted over the corpus.

Patterns give the base spans.  Besides them there are candidates: long strings of
letters and digits that look random, values after other names of keys, and passwords
in URLs.  For every candidate, base or not, the distinct repositories and owners that hold
its hash are counted over all rows: values that many owners or many
repositories have copied are examples, values in few of both look live.  Candidates
beyond the base count as secrets only if they look live.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from math import log2

import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Workspace, spread_join

KINDS = ("assign", "access", "hex", "mixed", "keyed", "url")
MOST_OWNERS = 2  # of a value that looks live
MOST_REPOS = 10  # that hold it
BITS = 3.0  # a character of a mixed candidate, at least
DIGITS = 3  # in a candidate beyond the base, at least, but for passwords in URLs

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")
_MIXED = re.compile(r"[A-Za-z0-9+/_-]{20,}")
_LEADS = re.compile(r"passw|secret|token|api_?key", re.IGNORECASE | re.ASCII)
_VALUE = re.compile(r"""[:=]\x20{0,4}["']?([A-Za-z0-9+/_.=-]{8,})""")
_KEY = re.compile(r"""(?:auth|bearer|cert|credentials?|key|pass|pat|pin|pwd|session|sig|signature)["']?\x20{0,4}\Z""", re.IGNORECASE | re.ASCII)
_URL = re.compile(r"://[^\s/:@]{1,64}:([^\s/:@]{4,})@")


def entropy(value: str) -> float:
    n = len(value)
    return -sum(c / n * log2(c / n) for c in Counter(value).values())


def _union(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a < out[-1][1]:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out


def candidates(text: str) -> list[tuple[int, int, int, str]]:
    """(start, kind, end, value) of base spans and of candidates beyond them, in code points.

    A candidate that overlaps a base span, or one that begins before it, is left out; of those
    that begin together a URL's stands before a key's and this before a mixed one.
    """
    out = []
    if _LEADS.search(text):
        out += [(m.start(), 0, m.end(), m[2]) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end(), m[0]) for m in _ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end(), m[0]) for m in _HEX.finditer(text)]
    more = [(m.start(), 3, m.end(), m[0]) for m in _MIXED.finditer(text) if not m[0].isdigit() and entropy(m[0]) >= BITS]
    more += [(m.start(1), 4, m.end(1), m[1]) for m in _VALUE.finditer(text) if _KEY.search(text, max(0, m.start() - 16), m.start())]
    more = [x for x in more if sum("0" <= c <= "9" for c in x[3]) >= DIGITS]
    if "://" in text:
        more += [(m.start(1), 5, m.end(1), m[1]) for m in _URL.finditer(text)]
    if not more:
        return sorted(out)
    taken, at, last = _union([(a, b) for a, _, b, _ in out]), 0, 0
    for x in sorted(more, key=lambda x: (x[0], -x[1])):
        a, b = x[0], x[2]
        while at < len(taken) and taken[at][1] <= a:
            at += 1
        if a >= last and not (at < len(taken) and taken[at][0] < b):
            out.append(x)
            last = b
    return sorted(out)


def _found(items: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    row = TaskContext.get().partitionId() << 40
    span = pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64()), ("hash", pa.int64())])
    for batch in items:
        ids, owners, repos, texts = (batch.column(i).to_pylist() for i in range(4))
        found = [[{"start": a, "kind": k, "end": b, "hash": xxhash.xxh3_64_intdigest(v) - (1 << 63)} for a, k, b, v in candidates(t or "")] for t in texts]
        rows = list(range(row, row + len(ids)))
        row += len(ids)
        yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(ids, pa.int64()), pa.array(owners, pa.string()), pa.array(repos, pa.string()), pa.array(found, pa.list_(span))], names=["row", "doc_id", "owner", "repo", "found"])


def scan_secrets(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repo_col: str = "doc_id", most_owners: int = MOST_OWNERS, most_repos: int = MOST_REPOS) -> DataFrame:
    """A row for each row of docs: doc_id and spans, an array of (start, kind, end, live), by start and kind.

    kind numbers KINDS; start and end count code points.  live: at most
    ``most_owners`` distinct owners and ``most_repos`` distinct repositories hold the value (a null is one more of either).
    Null and empty texts have no spans.  Repeated rows are judged each; they add
    no owner or repository.  Very long texts are scanned whole, in time that grows with their length.
    No rows give no rows.  Other columns are left out, whatever their names.
    """
    ws = Workspace(spark, "secrets")
    columns = [F.col(id_col).cast("long"), F.col(owner_col).cast("string").alias("o"), F.col(repo_col).cast("string").alias("r"), F.col(text_col).alias("t")]
    kind = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("kind", T.IntegerType()), T.StructField("end", T.LongType()), T.StructField("hash", T.LongType())]))
    schema = T.StructType([T.StructField("row", T.LongType()), T.StructField("doc_id", T.LongType()), T.StructField("owner", T.StringType()), T.StructField("repo", T.StringType()), T.StructField("found", kind)])
    rows = ws.keep(docs.select(*columns).mapInArrow(_found, schema), "found")
    each = rows.select("row", "owner", "repo", F.explode("found").alias("s")).select("row", "owner", "repo", "s.*")
    held = each.groupBy("hash").agg(F.count("*").alias("many"))
    for what in ("owner", "repo"):
        n = each.select("hash", F.coalesce(what, F.lit("")).alias(what)).distinct().groupBy("hash").agg(F.count("*").alias(f"{what}s"))
        held = held.join(n, "hash")
    held = ws.keep(held, "held")
    live = (F.col("owners") <= most_owners) & (F.col("repos") <= most_repos)
    judged = spread_join(each, held, ["hash"], "many").withColumn("live", live).filter((F.col("kind") < 3) | F.col("live"))
    spans = judged.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("start", "kind", "end", "live", "owners", "repos"))).alias("spans"))
    out = rows.select("row", "doc_id").join(spans, "row", "left")
    return out.select("doc_id", F.coalesce("spans", F.array().cast(spans.schema["spans"].dataType)).alias("spans"))


def digests(found: DataFrame) -> DataFrame:
    """Counts by kind, the spans as strings, and the digest of the base ones."""
    name = F.array(*map(F.lit, KINDS))
    said = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(name, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("spans", lambda s: s["kind"] < 3)
    n = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    live = F.size(F.filter("spans", lambda s: s["live"])).cast("long")
    return found.select("doc_id", n(0).alias("n_assign"), n(1).alias("n_access"), n(2).alias("n_hex"), F.sha2(said(base), 256).alias("base_sha256"), said(F.col("spans")).alias("spans"), live.alias("n_live"))

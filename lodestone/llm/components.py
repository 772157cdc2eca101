"""Connected components of links too many for one machine."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace

_OUT = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The links of each batch as stars around the smallest node of each of its components."""
    for batch in batches:
        if not batch.num_rows:
            continue
        a, b = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
        root = np.arange(len(nodes))
        x, y = at[: len(a)], at[len(a) :]
        while True:
            low = np.minimum(root[x], root[y])
            before = root.copy()
            np.minimum.at(root, root[x], low)
            np.minimum.at(root, root[y], low)
            root = np.minimum(root, root[root])
            if (root == before).all():
                break
        out = root != np.arange(len(nodes))
        yield pa.RecordBatch.from_arrays([pa.array(nodes[out]), pa.array(nodes[root[out]])], schema=_OUT)


def connected_components(spark: SparkSession, ws: Workspace, links: DataFrame, name: str) -> DataFrame:
    """(node, component): the smallest node that each linked node reaches.

    links: two long columns; null ends and self-links are left out.  Nodes
    without a link to another are not returned.  Large-star and small-star
    rounds alternate; a node with very many links is only ever the key of a
    minimum and of a join, both of which Spark splits.  Each round is written
    to the workspace.
    """
    a, b = links.columns[:2]
    edges = links.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")).filter("a <> b")
    edges = edges.mapInArrow(_forest, "a long, b long").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges, k = ws.keep(edges, f"{name}-0"), 0
    while True:
        # done when no node that points to a smaller one is pointed to: then all are stars around their smallest node
        if not edges.join(edges.select(F.col("b").alias("a")), "a", "left_semi").take(1) and not edges.groupBy("a").agg(F.count("*").alias("n")).filter("n > 1").take(1):
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
        # large star: each node sends its larger neighbours to the smallest node around it
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        # small star: each node sends its smaller neighbours, and itself, to the smallest of them
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")
        edges = ws.keep(small.unionByName(least.select("a", F.col("m").alias("b"))).distinct(), f"{name}-{k + 1}")
        ws.drop(f"{name}-{k}")
        k += 1

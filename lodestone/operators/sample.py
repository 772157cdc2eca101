"""Samples that don't depend on scheduling: rows are ordered by a hash of their identity."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .stats import group_ranks


def hash_order(ids: list[str], seed: int = 0):
    return F.xxhash64(*ids, F.lit(seed))


def sample_rows(df: DataFrame, k: int, ids: list[str], seed: int = 0) -> DataFrame:
    """k rows, each with the same chance: those whose hashes are the smallest; all, in any order, if there are no more.

    Rows are counted, and only those with a hash below a bound that leaves few more than k are put in
    order, so that the task that does this gets little more than it returns.
    """
    order, n = hash_order(ids, seed), df.count()
    if n <= k:
        return df
    share = (k + 10 * math.sqrt(k) + 100) / max(n, 1)
    if share < 1:
        few = df.filter(order < int(share * 2**64) - 2**63)
        if few.count() >= k:  # almost sure, but for rows that share their ids
            df = few
    return df.orderBy(order, *ids).limit(k)


def subsample(df: DataFrame, share: float, ids: list[str], seed: int = 0) -> DataFrame:
    """Each row with the chance ``share``; the first row of all always stays."""
    if not 0 < share <= 1:
        raise ValueError("the share lies above 0 and up to 1")
    if share == 1:
        return df
    first = df.agg(F.min(F.struct(*ids)).alias("i")).first()["i"]
    keep = F.pmod(hash_order(ids, seed), F.lit(1 << 30)) < int(share * (1 << 30))
    if first is not None:
        keep |= F.struct(*ids) == F.struct(*(F.lit(v).cast(df.schema[i].dataType) for i, v in zip(ids, first, strict=True)))
    return df.filter(keep)


def subsample_by_key(df: DataFrame, key: str, keep: int, of: int) -> DataFrame:
    """``keep`` in ``of`` rows by a multiplicative hash of an integer key."""
    return df.filter(F.pmod(F.col(key) * F.lit(2654435761), F.lit(of)) < keep)


def split_exactly(df: DataFrame, share: float, ids: list[str], by: str, seed: int = 0) -> DataFrame:
    """A column ``taken``: true for int(n * share) rows of each group, chosen by hash.

    The hash up to which a group's rows are taken is found by its rank, so no group is sorted; only rows on it are put in order.
    """
    spark = df.sparkSession
    key = F.pmod(hash_order(ids, seed), F.lit(1 << 53)).cast("double")  # exact as a double
    each = df.select(F.col(by).alias("g"), key.alias("v"))
    sizes: dict = {}
    last = group_ranks(each, [share], lambda n: [int(n * share) - 1], sizes=sizes)
    kind = df.schema[by].dataType.simpleString()
    rows = [(g, v[0] if v else -1.0, int(sizes[g] * share)) for g, v in last.items()]  # a row for each group
    limits = F.broadcast(spark.createDataFrame(rows, f"_g {kind}, _last double, _want long"))
    met = df.withColumn("_key", key).join(limits, F.col(by).eqNullSafe(F.col("_g")))
    below = met.groupBy("_g").agg(F.count_if(F.col("_key") < F.col("_last")).alias("_below"))
    on = met.filter("_key = _last").join(F.broadcast(below.withColumnRenamed("_g", "_h")), F.col("_g").eqNullSafe(F.col("_h")))
    rank = F.row_number().over(Window.partitionBy("_g").orderBy(*ids))
    on = on.withColumn("taken", F.col("_below") + rank <= F.col("_want"))
    off = met.filter("_key <> _last").withColumn("taken", F.col("_key") < F.col("_last"))
    return off.select(*df.columns, "taken").unionByName(on.select(*df.columns, "taken"))

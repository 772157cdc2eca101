"""Voxel sampling."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def cells(sizes: tuple[float | Column, ...]) -> dict[str, Column]:
    """The numbers of a point's cell on a grid from the frame's origin."""
    return {f"v{a}": F.floor(F.col(a) / s).cast("long") for a, s in zip("xyz", sizes, strict=True)}


def occupied(points: DataFrame, sizes: tuple[float, float, float], levels: int) -> DataFrame:
    """(level, cells): how many cells hold points, as their sides are halved at each level.

    Cells are counted through those of the finest level, so points are shuffled once, after partial aggregation.
    """
    finest = points.select(*(c.alias(n) for n, c in cells(tuple(s / 2 ** (levels - 1) for s in sizes)).items())).distinct()
    each = finest.select("*", F.explode(F.sequence(F.lit(0), F.lit(levels - 1))).alias("level"))
    up = {n: F.expr(f"shiftright({n}, {levels - 1} - level)") for n in ("vx", "vy", "vz")}
    return each.select("level", *(c.alias(n) for n, c in up.items())).distinct().groupBy("level").agg(F.count("*").alias("cells"))


def representatives(points: DataFrame, sizes: tuple[float, float, float] | float, ids: list[str], *by: str) -> DataFrame:
    """Of the points in each cell, the one nearest to its centre, ties to the smallest id.

    The grid starts at the frame's origin.  min_by is summed before the shuffle.
    """
    sizes = (sizes,) * 3 if isinstance(sizes, (int, float)) else sizes
    at = cells(sizes)
    out = points.withColumns(at)
    d = [F.col(a).cast("double") - (F.col(f"v{a}") + 0.5) * s for a, s in zip("xyz", sizes, strict=True)]
    best = F.min_by(F.struct(*points.columns), F.struct((d[0] * d[0] + d[1] * d[1] + d[2] * d[2]).alias("d"), *ids))
    return out.groupBy(*by, *at).agg(F.count("*").alias("n_in_cell"), best.alias("p")).select(*at, "n_in_cell", "p.*")


def choose(xyz: np.ndarray, target: int, seed: int = 0) -> np.ndarray:
    """Which ``target`` of the points of one node go up, in rising order.

    Cells shrink by half until enough have been picked; each pass picks the point nearest to
    each cell's centre, the earliest on ties.  The last pass keeps a random
    part.  What cells can't tell apart is taken in order.
    """
    n = len(xyz)
    if target >= n:
        return np.arange(n)
    picked = np.zeros(n, dtype=bool)
    if target <= 0:
        return np.flatnonzero(picked)
    extent = np.maximum(xyz.max(axis=0) - xyz.min(axis=0), 0)
    extent[extent <= 0] = 1e-5
    size, left, count = float(np.prod(extent) / target) ** (1 / 3) or 1e-5, np.arange(n), 0
    while count < target and len(left) and size > 1e-7:
        p = xyz[left]
        cell = np.floor(p / size)
        d = ((p - (cell + 0.5) * size) ** 2).sum(axis=1)
        span = cell.max(axis=0) - cell.min(axis=0) + 1
        if np.prod(span) < 2**62:  # one number for a cell: the sort has two keys, and is stable
            c = ((cell - cell.min(axis=0)).astype(np.int64) * [int(span[1] * span[2]), int(span[2]), 1]).sum(axis=1)
        else:
            c = np.unique(cell, axis=0, return_inverse=True)[1].reshape(-1)
        order = np.lexsort((d, c))
        first = order[np.r_[True, np.diff(c[order]) != 0]]
        mine = np.sort(left[first])
        if len(mine) > target - count:
            mine = np.sort(np.random.default_rng(seed).choice(mine, target - count, replace=False))
        picked[mine] = True
        count += len(mine)
        left = left[~picked[left]]
        size /= 2
    if count < target:
        picked[left[: target - count]] = True
    return np.flatnonzero(picked)

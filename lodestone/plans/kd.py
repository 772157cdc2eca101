"""Balanced spatial partition of points: a kd plan, routing, and levels of detail."""

from __future__ import annotations

import heapq
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..job import Workspace, ship
from ..operators import stats, voxel
from ..operators.sample import hash_order, sample_rows, split_exactly

SAMPLE = 3_000_000
POINTS_PER_TILE = 50_000
SELECTED = 0.66  # share of the root's points that each tile inserted below it takes
ROOT = "0"
GROUP = 1_000_000  # points of a subtree that one task takes
PER_LEAF = 256  # points of a sample for each leaf, so that leaves' sizes vary by a sixteenth
UNEVEN = 1.1  # how much larger than the mean, at a split, leaves may get because rows lie on it
CASES = 256  # leaves up to which routing is one nested CASE; beyond about 500 Arrow batches get faster


@dataclass
class Node:
    path: str
    axis: str | None = None  # of inner nodes
    split: float = 0.0
    tie_left: bool = False  # rows on the split go left

    @property
    def leaf(self) -> bool:
        return self.axis is None


class Plan:
    """Nodes by path; a child's path is its parent's and 0 or 1."""

    def __init__(self, nodes: list[Node]):
        self.nodes = {n.path: n for n in nodes}

    @property
    def leaves(self) -> list[str]:
        return sorted(p for p, n in self.nodes.items() if n.leaf)

    @property
    def depth(self) -> int:
        return max(map(len, self.nodes)) - 1

    def _cases(self, path: str = ROOT) -> Column:
        n = self.nodes[path]
        if n.leaf:
            return F.lit(path)
        value = F.col(n.axis).cast("double")
        left = value <= n.split if n.tie_left else value < n.split
        return F.when(left, self._cases(path + "0")).otherwise(self._cases(path + "1"))

    def _step(self, at: Column) -> Column:
        """The place after one level of the descent; places number the nodes in order of their paths."""
        paths = sorted(self.nodes)
        order, nodes = {p: i for i, p in enumerate(paths)}, [self.nodes[p] for p in paths]
        lit = lambda values, kind: F.lit(np.array(values, dtype=kind))
        axis = F.get(lit([-1 if n.leaf else "xyz".index(n.axis) for n in nodes], np.int32), at)
        split = F.get(lit([n.split for n in nodes], np.float64), at)
        ties = F.get(lit([int(n.tie_left) for n in nodes], np.int32), at)
        left = F.get(lit([order.get(n.path + "0", i) for i, n in enumerate(nodes)], np.int32), at)
        right = F.get(lit([order.get(n.path + "1", i) for i, n in enumerate(nodes)], np.int32), at)
        value = F.when(axis == 0, F.col("x")).when(axis == 1, F.col("y")).otherwise(F.col("z")).cast("double")
        goes_left = (value < split) | ((value == split) & (ties == 1))
        return F.when(axis < 0, at).when(goes_left, left).otherwise(right)

    def route(self) -> Column:
        """The leaf of the row's x, y and z, as a path.

        A nested CASE for few leaves, and else a descent over literal arrays; routed() is faster for many.
        """
        if len(self.leaves) <= CASES:
            return self._cases()
        start = F.lit(sorted(self.nodes).index(ROOT)).cast("int")
        at = F.aggregate(F.sequence(F.lit(1), F.lit(self.depth)), start, lambda at, _: self._step(at))
        return F.get(F.lit(sorted(self.nodes)), at)

    def routed(self, points: DataFrame, name: str = "leaf") -> DataFrame:
        """points with their leaf; a large plan is descended for a whole Arrow batch at a time."""
        if len(self.leaves) <= CASES:
            return points.withColumn(name, self._cases())
        ship(points.sparkSession)
        paths = np.array(sorted(self.nodes))
        order, nodes = {p: i for i, p in enumerate(paths.tolist())}, [self.nodes[p] for p in paths]
        axis = np.array([-1 if n.leaf else "xyz".index(n.axis) for n in nodes])
        split, ties = np.array([n.split for n in nodes]), np.array([n.tie_left for n in nodes])
        kids = np.array([[order.get(n.path + c, i) for c in "01"] for i, n in enumerate(nodes)])
        root, depth = order[ROOT], self.depth

        def run(batches):
            for b in batches:
                xyz = np.stack([b.column(a).to_numpy(zero_copy_only=False).astype(np.float64) for a in "xyz"])
                rows, at = np.arange(b.num_rows), np.full(b.num_rows, root)
                for _ in range(depth):
                    value, limit = xyz[np.maximum(axis[at], 0), rows], split[at]
                    at = kids[at, np.where((value < limit) | (value == limit) & ties[at], 0, 1)]
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(paths[at])], names=[*b.schema.names, name])

        points = points.drop(name)
        return points.mapInArrow(run, T.StructType([*points.schema.fields, T.StructField(name, T.StringType())]))

def leaf_count(total: int, per_tile: int = POINTS_PER_TILE, refine: str = "ADD") -> int:
    """In ADD mode half of a leaf's points end above it, so leaves are twice as large."""
    return max(1, math.ceil(total / (per_tile * (2 if refine == "ADD" else 1))))


def plan_sample(xyz: np.ndarray, leaves: int, root: str = ROOT) -> Plan:
    """Split at the upper median of the axis of largest variance until there are as many leaves as wanted.

    An odd number of leaves is split where a leaf's share is the same on both sides. Rows on a split go to one side
    together, the one that brings the sides nearest to this, and each side has leaves by the points that it then gets.
    An axis with so many rows on its split that leaves would be over ``UNEVEN`` gives way to one that has fewer.
    """
    nodes: list[Node] = []

    def cut(value: np.ndarray, wanted: int) -> tuple[float, float, bool, int] | None:
        """How uneven leaves get (the larger share, to the mean), split, side of ties, and leaves on the left."""
        n, mid = len(value), len(value) * (wanted // 2) // wanted
        split = float(np.partition(value, mid)[mid])
        best = None
        for tie_left, left in ((False, int((value < split).sum())), (True, int((value <= split).sum()))):
            if 0 < left < n:
                on_left = wanted // 2 if left == mid else min(max(round(wanted * left / n), 1), wanted - 1)
                uneven = max(left / on_left, (n - left) / (wanted - on_left)) * wanted / n
                if best is None or uneven < best[0]:
                    best = uneven, split, tie_left, on_left
        return best

    def grow(points: np.ndarray, wanted: int, path: str) -> None:
        if wanted <= 1 or len(points) < 2:
            nodes.append(Node(path))
            return
        found = None
        for axis in np.argsort(-points.var(axis=0), kind="stable"):
            made = cut(points[:, axis], wanted)
            if made and (found is None or made[0] < found[0][0]):
                found = made, int(axis)
            if found and found[0][0] <= UNEVEN:
                break
        if found is None:  # all coincide
            nodes.append(Node(path))
            return
        (_, split, tie_left, on_left), axis = found
        nodes.append(Node(path, "xyz"[axis], split, tie_left))
        left = points[:, axis] <= split if tie_left else points[:, axis] < split
        grow(points[left], on_left, path + "0")
        grow(points[~left], wanted - on_left, path + "1")

    grow(np.asarray(xyz, dtype=np.float64), leaves, root)
    return Plan(nodes)


def _mixed(table: pa.Table) -> np.ndarray:
    """Positions; whatever order they came in, equal ones are mixed alike."""
    xyz = np.stack([table.column(a).to_numpy() for a in "xyz"], axis=1)
    return np.random.default_rng(0).permutation(xyz[np.lexsort(xyz.T)])


def plan(points: DataFrame, leaves: int, ids: list[str], sample: int = SAMPLE) -> Plan:
    """A plan from a sample, chosen by a hash of ids, of which the driver holds at most ``sample`` points.

    Where that is less than ``PER_LEAF`` for each leaf, and not all, the driver plans the upper levels alone. The points
    below each of their leaves are counted, which says how many leaves it gets, and tasks plan these from samples of their own.
    """
    if leaves <= 1:
        return Plan([Node(ROOT)])
    points = points.select(*dict.fromkeys(["x", "y", "z", *ids]))
    place = [F.col(a).cast("double").alias(a) for a in "xyz"]
    xyz = _mixed(sample_rows(points, sample, ids).select(*place).toArrow())
    few = len(xyz) < sample or leaves * PER_LEAF <= sample
    total = 0 if few else points.count()
    if few or total <= sample:
        return plan_sample(xyz, leaves)
    upper = plan_sample(xyz, min(max(sample // PER_LEAF, 2), max(leaves // 16, 2)))
    routed = upper.routed(points)
    held = {r["leaf"]: r["n"] for r in routed.groupBy("leaf").agg(F.count("*").alias("n")).collect()}  # a row for each leaf of the upper levels
    each = _shares(held, leaves)
    bound = min(PER_LEAF * leaves / total, 1.0)
    some = routed if bound == 1 else routed.filter(hash_order([*ids, "x", "y", "z"], 1) < int(bound * 2**64) - 2**63)

    def lower(table: pa.Table) -> pa.Table:
        path = table.column("leaf")[0].as_py()
        made = plan_sample(_mixed(table), each[path], path).nodes.values()
        return pa.table({"path": [n.path for n in made], "axis": pa.array([n.axis for n in made], pa.string()), "split": [n.split for n in made], "tie_left": [n.tie_left for n in made]})

    ship(points.sparkSession)
    found = some.select(*place, "leaf").groupBy("leaf").applyInArrow(lower, "path string, axis string, split double, tie_left boolean").collect()  # a row for each node
    return Plan(list((upper.nodes | {r["path"]: Node(r["path"], r["axis"], r["split"], r["tie_left"]) for r in found}).values()))


def _shares(held: dict[str, int], leaves: int) -> dict[str, int]:
    """How many of the leaves each path gets, at least one: so that the largest leaves get as small as they can."""
    total = sum(held.values())
    out = {p: max(1, leaves * n // total) for p, n in held.items()}
    waiting = [(-n / out[p], p) for p, n in held.items()]
    heapq.heapify(waiting)
    for _ in range(leaves - sum(out.values())):
        p = waiting[0][1]
        out[p] += 1
        heapq.heapreplace(waiting, (-held[p] / out[p], p))
    while sum(out.values()) > leaves and max(out.values()) > 1:  # small ones were given one
        out[min((p for p in out if out[p] > 1), key=lambda p: (held[p] / (out[p] - 1), p))] -= 1
    return out


def plan_exactly(points: DataFrame, levels: int) -> Plan:
    """A plan from all points: at each node the exact variances and upper median of the points routed to it."""
    out = Plan([Node(ROOT)])
    for _ in range(levels):
        routed = out.routed(points)
        # one pass for variances, counts and the quantiles that bracket the medians of all axes
        marks = [stats.approximated(F.col(a).cast("double"), [0.5]).alias(f"p_{a}") for a in "xyz"]
        found = routed.groupBy("leaf").agg(F.count("*").alias("n"), *stats.variances(), *marks).withColumn("axis", stats.widest(*(F.col(f"var_{a}") for a in "xyz")))
        rows = {r["leaf"]: r for r in found.collect()}  # a row for each leaf so far
        axes = {p: r["axis"] for p, r in rows.items()}
        splits = stats.upper_medians(routed, "leaf", axes, known={p: (r["n"], r[f"p_{r['axis']}"]) for p, r in rows.items()})
        grown = [n for n in out.nodes.values() if not n.leaf]
        for path in out.leaves:
            if path not in axes:
                grown.append(Node(path))
                continue
            grown += [Node(path, axes[path], splits[path]), Node(path + "0"), Node(path + "1")]
        out = Plan(grown)
    return out


def leaf_stats(points: DataFrame, by: str = "leaf") -> DataFrame:
    """Count, box and geometric error of each leaf."""
    return stats.bounds(points, by).withColumn("error", stats.point_error())


def _climbing(root_length: int, copies: bool):
    """The points of a subtree in their tiles: from the deepest level on, each node passes half of its points to its parent."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("point_id")
        xyz = np.stack([table.column(a).to_numpy().astype(np.float64) for a in "xyz"], axis=1)
        names, tile = np.unique(np.array(table.column("tile").to_pylist()), return_inverse=True)
        held = {str(n): [np.flatnonzero(tile == i)] for i, n in enumerate(names)}
        out: list[tuple[str, np.ndarray]] = []
        for length in range(max(map(len, held)), root_length - 1, -1):
            for path in sorted(p for p in held if len(p) == length):
                rows = np.sort(np.concatenate(held.pop(path)))
                up = rows[voxel.choose(xyz[rows], len(rows) // 2)] if length > len(ROOT) else rows[:0]
                out.append((path, rows if copies else np.setdiff1d(rows, up, assume_unique=True)))
                if len(up):
                    held.setdefault(path[:-1], []).append(up)
        out += [(path, np.concatenate(rows)) for path, rows in held.items()]  # what goes on above the subtree
        rows, paths = np.concatenate([r for _, r in out]), np.repeat([p for p, _ in out], [len(r) for _, r in out])
        above = np.char.str_len(paths) < root_length
        taken = table.take(pa.array(rows))
        return taken.set_column(taken.schema.get_field_index("tile"), "tile", pa.array(paths)).set_column(taken.schema.get_field_index("above"), "above", pa.array(above))

    return run


def _height(sizes: dict[str, int], most: int, parallel: int) -> int:
    """The length of paths at which subtrees begin: the shortest that gives ``parallel`` groups of at most ``most`` points."""
    deepest = max(map(len, sizes))
    for length in range(1, deepest):
        groups: dict[str, int] = {}
        for path, n in sizes.items():
            if len(path) >= length:
                groups[path[:length]] = groups.get(path[:length], 0) + n
        if max(groups.values()) <= most and (len(groups) >= parallel or sum(groups.values()) <= most // 8):
            return length
    return deepest


def bubble_up(spark: SparkSession, points: DataFrame, refine: str = "ADD", most: int = GROUP) -> DataFrame:
    """points (with leaf and point_id) with ``tile``: each node passes half of its points to its parent, level by level.

    ADD moves points, so that each has one tile; REPLACE copies them.  A group is a subtree of at most
    ``most`` points, or one node; what leaves the subtrees is written to the shared folder and dealt
    again, until the root is among them.  A node of more than ``most`` points, which coincide or the plan was of too small a sample,
    passes on half of them by hash, without a group.
    """
    ws = Workspace(spark, "levels")
    sizes = {r["leaf"]: r["n"] for r in points.groupBy("leaf").agg(F.count("*").alias("n")).collect()}  # a row for each leaf
    if not sizes:
        return points.withColumn("tile", F.col("leaf"))
    here = points.withColumn("tile", F.col("leaf")).withColumn("above", F.lit(False))
    parallel, done, waiting = spark.sparkContext.defaultParallelism, [], here
    while True:
        length = _height(sizes, most, parallel)
        now, large = here.filter(F.length("tile") >= length), [p for p, n in sizes.items() if n > most and len(p) == length]
        if large and len(max(sizes, key=len)) == length:
            over = F.broadcast(spark.createDataFrame([(p,) for p in large], "tile string"))  # fewer than one for each ``most`` points
            split = split_exactly(now.join(over, "tile", "left_semi"), 0.5 if length > len(ROOT) else 0.0, ["point_id"], "tile")
            now = now.join(over, "tile", "left_anti")
        else:
            split = None
        climbed = now.groupBy(F.substring("tile", 1, length).alias("_group")).applyInArrow(_climbing(length, refine != "ADD"), here.schema)
        if split is not None:
            up = split.filter("taken").select(*here.columns).withColumns({"tile": F.expr("substring(tile, 1, length(tile) - 1)"), "above": F.lit(True)})
            stay = split if refine != "ADD" else split.filter("not taken")
            climbed = climbed.unionByName(stay.select(*here.columns)).unionByName(up)
        if length == len(ROOT):
            done.append(climbed)
            break
        climbed = ws.keep(climbed, f"from-{length}")
        done.append(climbed.filter(~F.col("above")))
        # what goes on: the leaves above this height, and half of each subtree's root
        waiting = waiting.filter(F.length("tile") < length)
        here = waiting.unionByName(climbed.filter("above").withColumn("above", F.lit(False)))
        passed = climbed.filter("above").groupBy("tile").agg(F.count("*").alias("n")).collect()  # a row for each node
        sizes = {p: n for p, n in sizes.items() if len(p) < length}
        for r in passed:
            sizes[r["tile"]] = sizes.get(r["tile"], 0) + r["n"]
        if not sizes:
            break
    out = done[0]
    for df in done[1:]:
        out = out.unionByName(df)
    return out.drop("above")


def detail_chain(n: int, box: dict, refine: str = "ADD", target: float | None = None) -> list[int]:
    """How many points the tiles between root and first level take, the nearest to the root last.

    While the root's error is under its target, 66 in 100 of its points go to a tile
    inserted below it, in REPLACE mode all of them.
    """
    target = target or stats.root_error(box)
    d = [box[f"{a}max"] - box[f"{a}min"] for a in "xyz"]
    area, out = d[0] * d[1] + d[0] * d[2] + d[1] * d[2], []
    while len(out) < 30 and n >= 4 and 4 * math.sqrt(area / n) < target:
        taken = int(n * SELECTED)
        out.append(taken if refine == "ADD" else n)
        n -= taken
    return out


def insert_chain(root: DataFrame, takes: list[int], refine: str = "ADD") -> DataFrame:
    """The root's points with ``chain``: 0 for those that stay, k for those of the k-th tile inserted (the first is the lowest)."""
    from pyspark.sql import Window

    ranked = root.withColumn("_k", F.row_number().over(Window.orderBy(F.xxhash64("point_id"), "point_id")))  # one tile's points
    if refine == "ADD":
        chain, seen = F.lit(0), 0
        for i, n in enumerate(takes, 1):
            chain = F.when((F.col("_k") > seen) & (F.col("_k") <= seen + n), i).otherwise(chain)
            seen += n
        return ranked.withColumn("chain", chain).drop("_k")
    # tile k holds what was left when it was made
    cuts = [sum(int(n * SELECTED) for n in takes[:i]) for i in range(len(takes))]
    pairs = F.array(*(F.struct(F.lit(c).alias("after"), F.lit(i + 1).alias("chain")) for i, c in enumerate(cuts)), F.struct(F.lit(sum(int(n * SELECTED) for n in takes)).alias("after"), F.lit(0).alias("chain")))
    return ranked.withColumn("_p", F.explode(pairs)).filter("_k > _p.after").withColumn("chain", F.col("_p.chain")).drop("_k", "_p")


def tile_counts(leaf_sizes: dict[str, int], refine: str = "ADD") -> dict[str, int]:
    """How many points each tile owns, from the leaves' sizes alone."""
    own, depth = dict(leaf_sizes), max(map(len, leaf_sizes))
    for level in range(depth, 1, -1):
        for path in [p for p in own if len(p) == level]:
            up = own[path] // 2
            own[path[:-1]] = own.get(path[:-1], 0) + up
            if refine == "ADD":
                own[path] -= up
    return own


NODE_SCHEMA = T.StructType([T.StructField("path", T.StringType()), T.StructField("n", T.LongType()), *(T.StructField(f"{a}{m}", T.DoubleType()) for a in "xyz" for m in ("min", "max")), T.StructField("error", T.DoubleType())])


def node_table(tiles: DataFrame) -> list[dict]:
    """A row for each tile: what it owns, the box of its subtree and its error, which is 0 for leaves."""
    own = stats.bounds(tiles, "tile")
    prefixes = F.explode(F.expr("transform(sequence(1, length(tile)), i -> substring(tile, 1, i))")).alias("path")
    boxes = stats.merged_bounds(own.select("*", prefixes).drop("tile"), "path").drop("n")
    rows = [r.asDict() for r in boxes.join(own.select(F.col("tile").alias("path"), "n"), "path", "left").collect()]  # one row for each tile
    inner = {r["path"][:-1] for r in rows}
    for r in rows:
        d = [r[f"{a}max"] - r[f"{a}min"] for a in "xyz"]
        raw = 4 * math.sqrt((d[0] * d[1] + d[0] * d[2] + d[1] * d[2]) / r["n"]) if r["n"] and r["path"] in inner else 0.0
        r["error"] = raw
    errors = stats.clamped_errors(rows)
    for r in rows:
        r["error"] = errors[r["path"]]
    return sorted(rows, key=lambda r: r["path"])

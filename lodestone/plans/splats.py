"""Splat scenes as tile trees: a weighted plan from a sample, routing, and merging from the leaves up."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..job import Workspace
from ..operators import splats as S
from ..operators.sample import sample_rows
from ..sinks import spz, tileset
from ..storage import write
from .kd import ROOT, Node, Plan

PER_TILE = 40_000
DEPTH = 64
SAMPLES = (262_144, 4_194_304)
RATIO = 0.5
SIGMAS = 3
ERROR_SCALE, ERROR_GROWTH, CHILD_FACTOR, OUTLIERS = 10.0, 1.1, 1.001, 0.01

#: Turns of a scene by the axis that points up.
UP = {"z": np.eye(3), "y": np.array([[1.0, 0, 0], [0, 0, -1], [0, 1, 0]]), "x": np.array([[0, 0, -1.0], [0, 1, 0], [1, 0, 0]])}

COLUMNS = ["source_index", "cx", "cy", "cz", "qw", "qx", "qy", "qz", "sx", "sy", "sz", "opacity", "sh0_r", "sh0_g", "sh0_b", "sh_rest"]


def weighted_median(value: np.ndarray, weight: np.ndarray) -> float:
    """The first value at which the running weight reaches half; the middle one if the total says nothing."""
    order = np.lexsort((weight, value))
    value, run = value[order], np.cumsum(weight[order])
    if not np.isfinite(run[-1]) or run[-1] <= 0:
        return float(value[len(value) // 2])
    return float(value[min(len(value) - 1, int(np.searchsorted(run, run[-1] / 2, "left")))])


def plan_sample(centre: np.ndarray, weight: np.ndarray, count: int, per_tile: int = PER_TILE) -> Plan:
    """Split at the weighted median of the axis of largest weighted variance until a node fits a tile.

    Rows on a split go to one side together, the one that brings the sides' weights nearest to each other; samples
    go where rows like them will, so that nodes are planned with what they get.
    """
    nodes: list[Node] = []

    def cut(value: np.ndarray, w: np.ndarray) -> tuple[float, bool, np.ndarray] | None:
        """Split, side of ties, and who is on the left; None if all values are the same."""
        split = weighted_median(value, w)
        sides = [(tie_left, left) for tie_left, left in ((True, value <= split), (False, value < split)) if 0 < np.count_nonzero(left) < len(value)]
        if not sides:
            return None
        total = w.sum()
        heavy = w if np.isfinite(total) and total > 0 else np.ones(len(w))
        tie_left, left = min(sides, key=lambda s: abs(heavy[s[1]].sum() - heavy.sum() / 2))
        return split, tie_left, left

    def grow(x: np.ndarray, w: np.ndarray, n: int, path: str) -> None:
        if n <= per_tile or len(path) > DEPTH or len(x) < 2:
            nodes.append(Node(path))
            return
        ok = (w > 0) & np.isfinite(w)
        var = np.zeros(3)
        if ok.any():
            mean = np.average(x[ok], axis=0, weights=w[ok])
            var = np.average((x[ok] - mean) ** 2, axis=0, weights=w[ok])
        if not var.max() > 0:  # those that have weight coincide
            var = x.var(axis=0)
        made = None
        for axis in np.argsort(-var, kind="stable"):  # of equal values the variance may be a rounding error
            if made := cut(x[:, axis], w):
                break
        if made is None:
            nodes.append(Node(path))
            return
        split, tie_left, left = made
        n_left = min(max(round(n * float(left.mean())), 1), n - 1)
        nodes.append(Node(path, "xyz"[axis], split, tie_left))
        grow(x[left], w[left], n_left, path + "0")
        grow(x[~left], w[~left], n - n_left, path + "1")

    grow(centre, weight, count, ROOT)
    return Plan(nodes)


def sample_size(count: int, per_tile: int) -> int:
    return int(min(max(SAMPLES[0], 256 * math.ceil(count / per_tile)), SAMPLES[1]))


def prepared(splats: DataFrame, min_opacity: float = 0.0, degree: int = 3) -> DataFrame:
    """Without faint splats and higher harmonics."""
    return splats.filter(F.col("opacity") >= min_opacity).withColumn("sh_rest", F.slice("sh_rest", 1, (degree + 1) ** 2 - 1) if degree else F.array().cast("array<struct<r:double,g:double,b:double>>"))


def as_arrays(table: pa.Table) -> S.Splats:
    get = lambda *names: np.stack([table.column(n).to_numpy() for n in names], axis=1)
    rest = table.column("sh_rest").to_pylist()
    each = len(rest[0] or []) if rest else 0
    sh = np.array([[[c["r"], c["g"], c["b"]] for c in r] for r in rest], dtype=np.float64).reshape(len(rest), each, 3)
    return S.Splats(table.column("source_index").to_numpy(), get("cx", "cy", "cz"), get("qw", "qx", "qy", "qz"), get("sx", "sy", "sz"), table.column("opacity").to_numpy(), get("sh0_r", "sh0_g", "sh0_b"), sh)


def as_table(s: S.Splats) -> dict[str, pa.Array]:
    out = {"source_index": pa.array(s.index)}
    for names, values in ((("cx", "cy", "cz"), s.centre), (("qw", "qx", "qy", "qz"), s.quaternion), (("sx", "sy", "sz"), s.scale), (("sh0_r", "sh0_g", "sh0_b"), s.sh0)):
        out |= {n: pa.array(np.ascontiguousarray(values[:, i])) for i, n in enumerate(names)}
    kind = pa.list_(pa.struct([(c, pa.float64()) for c in "rgb"]))
    out |= {"opacity": pa.array(s.opacity), "sh_rest": pa.array([[dict(zip("rgb", c, strict=True)) for c in r] for r in s.sh.tolist()], kind)}
    return {c: out[c] for c in COLUMNS}


def spread(centre: np.ndarray) -> np.ndarray:
    """The box that most centres fill: without a hundredth at each end, grown to make up for those."""
    if len(centre) < 2:
        return np.zeros(3)
    last, skip = len(centre) - 1, int(len(centre) * OUTLIERS)
    v = np.sort(centre, axis=0)
    return (v[last - skip] - v[skip]) * last / (last - 2 * skip)


def error(centre: np.ndarray, levels: int, factor: float = 1.0) -> float:
    x, y, z = spread(centre)
    area = x * y + x * z + y * z
    return math.sqrt(area / len(centre)) * ERROR_SCALE * factor * ERROR_GROWTH**levels if area > 0 else 0.0


def reach(s: S.Splats) -> tuple[np.ndarray, np.ndarray]:
    """The box of the splats out to three standard deviations."""
    size = SIGMAS * np.sqrt(np.maximum(np.einsum("nii->ni", S.covariances(s.quaternion, s.scale)), 0))
    return (s.centre - size).min(axis=0), (s.centre + size).max(axis=0)


_NODE = "path string, n long, xmin double, xmax double, ymin double, ymax double, zmin double, zmax double, error double, levels int, kids array<string>"

_NODE_ARROW = pa.schema([("path", pa.string()), ("n", pa.int64()), *((f"{a}{m}", pa.float64()) for a in "xyz" for m in ("min", "max")), ("error", pa.float64()), ("levels", pa.int32()), ("kids", pa.list_(pa.string()))])


def _node(path: str, s: S.Splats, levels: int, low, high, least: float, factor: float, kids: list[str]) -> dict:
    own = error(s.centre, levels, factor) if levels else 0.0
    return {"path": path, "n": len(s), **{f"{a}{m}": float(v) for i, a in enumerate("xyz") for m, v in (("min", low[i]), ("max", high[i]))}, "error": max(own, least), "levels": levels, "kids": kids}


def _merging(facts, factor: float):
    """A parent's splats and node from those of its children, whose nodes are in the broadcast facts."""

    def merge(table: pa.Table) -> pa.Table:
        path = table.column("parent")[0].as_py()
        s = as_arrays(table.sort_by([("tile", "ascending"), ("source_index", "ascending")]))
        kids = facts.value[path]
        out = S.simplify(s, sum(max(1, math.ceil(k["n"] * RATIO)) for k in kids))
        low, high = reach(out)
        low = np.minimum(low, np.min([[k[f"{a}min"] for a in "xyz"] for k in kids], axis=0))
        high = np.maximum(high, np.max([[k[f"{a}max"] for a in "xyz"] for k in kids], axis=0))
        levels = max(k["levels"] for k in kids) + 1
        node = _node(path, out, levels, low, high, CHILD_FACTOR * max(k["error"] for k in kids), factor, [k["path"] for k in kids])
        columns = as_table(out) | {"tile": pa.array([path] * len(out))}
        return pa.table(columns | {"node": pa.array([node] + [None] * (len(out) - 1), pa.struct(list(_NODE_ARROW)))})

    return merge


def build(spark: SparkSession, splats: DataFrame, per_tile: int = PER_TILE, factor: float = 1.0) -> tuple[DataFrame, list[dict]]:
    """(splats with their tile, node rows): leaves keep all theirs, and a parent merges its children's to half.

    One job for each level, whose result is written to the shared folder; a group is
    one parent's splats, about as many as a tile holds.  A node with one child gives way to it.
    """
    ws = Workspace(spark, "splats")
    count = splats.count()
    if not count:
        return splats.withColumn("tile", F.lit("")).filter("false"), []
    area = (F.col("sx") * F.col("sy") + F.col("sx") * F.col("sz") + F.col("sy") * F.col("sz")) / 3
    weight = F.greatest(F.lit(S.LEAST_WEIGHT), F.col("opacity") * F.greatest(area, F.lit(S.LEAST_WEIGHT)))
    got = sample_rows(splats.select("source_index", "cx", "cy", "cz", weight.alias("w")), sample_size(count, per_tile), ["source_index"]).toArrow()
    got = got.sort_by("source_index")
    plan = plan_sample(np.stack([got.column(c).to_numpy() for c in ("cx", "cy", "cz")], axis=1), got.column("w").to_numpy(), count, per_tile)
    leaf = splats.withColumns(dict(zip("xyz", (F.col(c) for c in ("cx", "cy", "cz")), strict=True))).transform(lambda df: plan.routed(df, "tile")).select(*COLUMNS, "tile")
    kept = ws.keep(leaf.withColumn("depth", F.length("tile")), "leaves", "depth")
    now = kept.drop("depth")
    def leaf_node(table: pa.Table) -> pa.Table:
        s = as_arrays(table)
        low, high = reach(s)
        return pa.Table.from_pylist([_node(table.column("tile")[0].as_py(), s, 0, low, high, 0.0, factor, [])], schema=_NODE_ARROW)

    rows = now.groupBy("tile").applyInArrow(leaf_node, _NODE).collect()  # a row for each tile
    nodes = {r["path"]: r.asDict() for r in rows}
    made = [({p for p in nodes if len(p) == n}, kept.filter(F.col("depth") == n).drop("depth")) for n in sorted({len(p) for p in nodes})]
    tops = dict.fromkeys(nodes)  # tiles without a parent yet, and where they stand in the plan
    at = {p: p for p in tops}
    for level in range(max(map(len, nodes)), 1, -1):
        groups: dict[str, list[str]] = {}
        for tile, place in at.items():
            if len(place) == level:
                groups.setdefault(place[:-1], []).append(tile)
        pairs = {p: sorted(t) for p, t in groups.items() if len(t) == 2}
        for p, t in groups.items():
            if len(t) == 1:
                at[t[0]] = p
        if not pairs:
            continue
        parent = {t: p for p, ts in pairs.items() for t in ts}
        facts = {p: [nodes[t] for t in ts] for p, ts in pairs.items()}

        parents = F.broadcast(spark.createDataFrame(list(parent.items()), "tile string, parent string"))  # a row for each tile of the level
        source = None
        for held, m in made:
            if not held.isdisjoint(parent):
                source = m if source is None else source.unionByName(m)
        grouped = source.join(parents, "tile").select(*now.columns, "parent")
        schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in now.schema.fields) + f", node struct<{_NODE.replace(' ', ':').replace(',:', ',')}>"
        merged = ws.keep(grouped.groupBy("parent").applyInArrow(_merging(spark.sparkContext.broadcast(facts), factor), schema), f"level-{level}")
        for r in merged.filter("node is not null").select("node.*").collect():  # a row for each tile
            nodes[r["path"]] = r.asDict()
            for kid in r["kids"]:
                at.pop(kid)
            at[r["path"]] = r["path"]
        made.append((set(pairs), merged.drop("node")))
    out = made[0][1]
    for _, m in made[1:]:
        out = out.unionByName(m)
    return out, sorted(nodes.values(), key=lambda r: r["path"])


def content(table: pa.Table) -> tuple[str, bytes]:
    """A tile's name and GLB."""
    s, tile = as_arrays(table.sort_by("source_index")), table.column("tile")[0].as_py()
    payload = spz.encode(s.centre, s.quaternion, s.scale, s.opacity, s.sh0, s.sh if s.sh.shape[1] else None)
    degree = {0: 0, 3: 1, 8: 2, 15: 3}[s.sh.shape[1]]
    return f"tile_{tile}.glb", spz.splat_glb(payload, len(s), s.centre.min(axis=0).tolist(), s.centre.max(axis=0).tolist(), degree)


def tile_splats(spark: SparkSession, splats: DataFrame, folder: str, per_tile: int = PER_TILE, min_opacity: float = 0.0, degree: int = 3, up: str = "z", transform: list[float] | None = None, factor: float = 1.0) -> dict:
    """Write a splat scene as 3D Tiles: contents under data/, and tileset.json."""
    turn = UP[up]
    ready = prepared(splats, min_opacity, degree)
    if up != "z":

        def rotate(batches):
            for b in batches:
                yield pa.RecordBatch.from_pydict(as_table(S.rotated(as_arrays(pa.Table.from_batches([b])), turn)))

        ready = ready.select(*COLUMNS).mapInArrow(rotate, ready.select(*COLUMNS).schema)
    box = ready.agg(*(f(c).alias(f"{c}_{n}") for c in ("cx", "cy", "cz") for f, n in ((F.min, "lo"), (F.max, "hi")))).first()
    if box["cx_lo"] is None:
        raise ValueError("the scene has no splats")
    foot = [(box["cx_lo"] + box["cx_hi"]) / 2, (box["cy_lo"] + box["cy_hi"]) / 2, box["cz_lo"]]
    ready = ready.withColumns({c: F.col(c) - o for c, o in zip(("cx", "cy", "cz"), foot, strict=True)})
    tiles, nodes = build(spark, ready, per_tile, factor)

    def save(table: pa.Table) -> pa.Table:
        name, data = content(table)
        write(f"{folder}/data/{name}", data)
        return pa.table({"tile": [table.column("tile")[0].as_py()], "bytes": pa.array([len(data)], pa.int64())})

    saved = tiles.groupBy("tile").applyInArrow(save, "tile string, bytes long").collect()
    kids = {k for r in nodes for k in r["kids"]}
    made = {r["path"]: tileset.Tile(r["path"], tuple(r[f"{a}{m}"] for a in "xyz" for m in ("min", "max")), r["error"], f"data/tile_{r['path']}.glb", "REPLACE") for r in nodes}
    for r in nodes:
        made[r["path"]].children = [made[k] for k in sorted(r["kids"])]
    root = made[next(r["path"] for r in nodes if r["path"] not in kids)]
    root.transform = transform
    tileset.write_index(folder, tileset.index_files(root))
    return {"tiles": len(nodes), "splats": splats.count(), "kept": ready.count(), "bytes": sum(r["bytes"] for r in saved)}

"""Queries over smaller rules of the library: names, places, choices, costs, hooks."""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from . import model
from .job import Workspace
from .operators import splats as merging
from .operators import stats, voxel
from .plans import kd, splats
from .queries import _PART_SPLATS, POINTS, part_splats, points, query, rounded, table
from .queries_files import _in_arrays, _index, _tiles_of
from .queries_sources import _FORMS, _P, _files, _las, _parts, _tiff_path
from .sinks import contents, tiles, tileset
from .sources import geotiff, las
from .storage import File, listed, write

# ---------------------------------------------------------------- sources and names


@query("SELECT 'EPSG:32633' AS crs, CAST(11 AS BIGINT) AS files, true AS in_order")
def las_systems(spark, sf_dir):
    """The CRS that all files of a folder agree on, and the files in order of their names."""
    folder = _files(spark, _parts(spark, sf_dir), _FORMS, "las", _las, None)
    names = listed(folder, ("las", "laz"))
    return spark.createDataFrame([(las.crs_of(folder), len(names), names == sorted(names))], "crs string, files long, in_order boolean")


@query(f"WITH {_P} SELECT 'rgb' AS kind, 'EPSG:32633' AS crs, 1000.0::DOUBLE AS x0, 2000.0::DOUBLE AS y0, 2.0::DOUBLE AS cell, CAST(ceil(count(*) / 40) AS BIGINT) AS rows FROM p UNION ALL SELECT 'world', 'EPSG:32633', 10, 20, 0.5, CAST(ceil(count(*) / 40) AS BIGINT) FROM p")
def geotiff_places(spark, sf_dir):
    """Where a picture lies by its tags, and by a sidecar that comes before them."""
    own = geotiff.georeference(_tiff_path(spark, sf_dir, "rgb"))
    path = _tiff_path(spark, sf_dir, "palette")
    write(f"{path}.aux.xml", b"<PAMDataset><GeoTransform>10, 0.5, 0, 20, 0, -0.5</GeoTransform></PAMDataset>")
    other = geotiff.georeference(path)
    rows = [(kind, g.crs, g.affine[0], g.affine[3], g.affine[1], g.size[1]) for kind, g in (("rgb", own), ("world", other))]
    return spark.createDataFrame(rows, "kind string, crs string, x0 double, y0 double, cell double, rows long")


@query("WITH n AS (SELECT DISTINCT lower(replace(p_brand, ' ', '')) AS name FROM part) SELECT name FROM n")
def requested_names(spark, sf_dir):
    """Attributes asked for under several spellings, each once."""
    brands = [r["p_brand"] for r in table(spark, sf_dir, "part").select("p_brand").distinct().collect()]  # a few dozen
    asked = [v for b in brands for v in (b, b.upper(), f" {b[:2]} {b[2:]}")]
    return spark.createDataFrame([(n,) for n in model.requested(asked)], "name string")


@query("SELECT s_suppkey, 'data/' || array_to_string(string_split(CAST(s_suppkey % 2 AS VARCHAR) || CAST(s_suppkey // 2 % 2 AS VARCHAR) || CAST(s_suppkey // 4 % 2 AS VARCHAR), ''), '/') || '/content.glb' AS path FROM supplier")
def content_paths(spark, sf_dir):
    """A folder for each level of the tree."""
    k = F.col("s_suppkey")
    digits = table(spark, sf_dir, "supplier").select("s_suppkey", F.concat(F.lit("0"), *((F.floor(k / n) % 2).cast("string") for n in (1, 2, 4))).alias("tile"))

    def name(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([tiles.content_path(t, "glb") for t in b.column(1).to_pylist()])], names=["s_suppkey", "path"])

    return digits.mapInArrow(name, f"s_suppkey {digits.schema['s_suppkey'].dataType.simpleString()}, path string")


# ---------------------------------------------------------------- choices and costs


@query(f"WITH {POINTS}, g AS (SELECT l_returnflag, count(*) AS n FROM points GROUP BY ALL) SELECT l_returnflag, n // 3 AS chosen, true AS distinct_rows, true AS cells_first FROM g")
def voxel_choice(spark, sf_dir):
    """A third of each group's points by shrinking voxels: as many as wanted, no point twice, and one of each cell before two of any."""

    def choose(t: pa.Table) -> pa.Table:
        xyz = np.stack([t.column(a).to_numpy() for a in "xyz"], axis=1)
        n = len(xyz) // 3
        got = voxel.choose(xyz, n)
        extent = np.maximum(xyz.max(axis=0) - xyz.min(axis=0), 1e-5)
        size = float(np.prod(extent) / max(n, 1)) ** (1 / 3)
        cells = {tuple(c) for c in np.floor(xyz / size).astype(int).tolist()}
        first = len(cells) > n or cells == {tuple(c) for c in np.floor(xyz[got] / size).astype(int).tolist()}
        return pa.table({"l_returnflag": [t.column("l_returnflag")[0].as_py()], "chosen": [len(got)], "distinct_rows": [len(set(got.tolist())) == len(got)], "cells_first": [first]})

    return points(spark, sf_dir).select("l_returnflag", *"xyz").groupBy("l_returnflag").applyInArrow(choose, "l_returnflag string, chosen long, distinct_rows boolean, cells_first boolean")


@query(f"WITH {POINTS}, b AS (SELECT l_returnflag, max(x) - min(x) AS dx, max(y) - min(y) AS dy, max(z) - min(z) AS dz FROM points GROUP BY ALL) SELECT l_returnflag, round(greatest(dx, dy, dz) * sqrt(3) / 5, 9) AS error FROM b")
def root_errors(spark, sf_dir):
    """The error that a root should reach."""
    rows = stats.bounds(points(spark, sf_dir), "l_returnflag").collect()  # three
    return rounded(spark.createDataFrame([(r["l_returnflag"], stats.root_error(r.asDict())) for r in rows], "l_returnflag string, error double"), 9, "error")


_PAIRS = f"""{_PART_SPLATS}, q AS (SELECT a.cluster, a.k AS a, b.k AS b, a.w AS u, b.w AS v, a.w + b.w AS t, a.x - b.x AS dx, a.y - b.y AS dy, a.z - b.z AS dz, a.sx AS ax, a.sy AS ay, a.sz AS az, b.sx AS bx, b.sy AS by_, b.sz AS bz, a.red - b.red AS dr FROM w a JOIN w b ON b.k = a.k + 16 AND a.cluster = b.cluster),
d AS (SELECT *, (u * ax * ax + v * bx * bx) / t AS cx, (u * ay * ay + v * by_ * by_) / t AS cy, (u * az * az + v * bz * bz) / t AS cz, u * v / (t * t) AS uv FROM q),
l AS (SELECT *, ln(cx * cy * cz * (1 + uv * (dx * dx / cx + dy * dy / cy + dz * dz / cz))) AS lm, 2 * ln(ax * ay * az) AS la, 2 * ln(bx * by_ * bz) AS lb FROM d)"""


@query(f"WITH {_PAIRS} SELECT CAST(a AS BIGINT) AS a, CAST(b AS BIGINT) AS b, round(greatest(0, (t * lm - u * la - v * lb) / 2) + {merging.COLOUR_WEIGHT} * t * ({merging.SH_C0} * dr) ** 2, 6) AS cost FROM l")
def merge_costs(spark, sf_dir):
    """The cost of merging neighbours in a cluster."""

    def f(cluster, s):
        pairs = np.stack([np.arange(len(s) - 1), np.arange(1, len(s))], axis=1)
        return pa.table({"a": s.index[pairs[:, 0]], "b": s.index[pairs[:, 1]], "cost": merging.merge_costs(s, pairs)})

    each = part_splats(spark, sf_dir).withColumn("cluster", F.col("source_index") % 16)
    return rounded(_in_arrays(each, "cluster", f, "a long, b long, cost double"), 6, "cost")


@query(
    f"""WITH {_PART_SPLATS}, b AS (SELECT cluster, CAST(count(*) // 2 AS DOUBLE) AS target, max(x) - min(x) AS dx, max(y) - min(y) AS dy, max(z) - min(z) AS dz FROM w GROUP BY cluster), m AS (SELECT *, greatest(dx, dy, dz) AS long FROM b),
p AS (SELECT *, (CASE WHEN dx > long / 20 THEN dx ELSE 1 END) * (CASE WHEN dy > long / 20 THEN dy ELSE 1 END) * (CASE WHEN dz > long / 20 THEN dz ELSE 1 END) AS volume, CAST(dx > long / 20 AS INTEGER) + CAST(dy > long / 20 AS INTEGER) + CAST(dz > long / 20 AS INTEGER) AS sides FROM m)
SELECT cluster, round(least({merging.CELL_FACTOR} * pow(volume / target, 1.0 / sides), {merging.EXTENT_FACTOR} * long), 9) AS distance FROM p"""
)
def merge_distances(spark, sf_dir):
    """How far apart splats may be that are merged."""
    each = part_splats(spark, sf_dir).withColumn("cluster", F.col("source_index") % 16)
    f = lambda cluster, s: pa.table({"cluster": [cluster], "distance": [merging.merge_distance(s.centre, len(s) // 2)]})
    return rounded(_in_arrays(each, "cluster", f, "cluster long, distance double"), 9, "distance")


@query(f"WITH {_PART_SPLATS} SELECT count(*) AS n, true AS none_over, true AS near_the_share FROM w")
def splat_plan(spark, sf_dir):
    """The leaves of a splat scene's plan: all splats in them, and near the size that was asked for."""
    p = part_splats(spark, sf_dir)
    n = p.count()
    got = p.select("cx", "cy", "cz", (F.col("opacity") * (F.col("sx") * F.col("sy") + F.col("sx") * F.col("sz") + F.col("sy") * F.col("sz")) / 3).alias("w")).toArrow()  # a plan's sample
    plan = splats.plan_sample(np.stack([got.column(i).to_numpy() for i in range(3)], axis=1), got.column("w").to_numpy(), n, 50)
    routed = plan.routed(p.withColumns(dict(zip("xyz", (F.col(c) for c in ("cx", "cy", "cz")), strict=True))))
    sizes = routed.groupBy("leaf").agg(F.count("*").alias("n"))
    return sizes.agg(F.sum("n").alias("n"), (F.max("n") <= 100).alias("none_over"), (F.avg("n") >= 12).alias("near_the_share"))


@query("SELECT c_custkey, CAST(c_custkey % 4 AS INTEGER) AS degree, CAST(least(c_custkey % 4, 2) * (least(c_custkey % 4, 2) + 2) AS INTEGER) AS kept FROM customer")
def harmonics_kept(spark, sf_dir):
    """How many harmonics are left of each degree where two are asked for."""
    k = F.col("c_custkey")
    one = F.struct(*(F.lit(0.5).alias(c) for c in "rgb"))
    t = table(spark, sf_dir, "customer").select("c_custkey", (k % 4).cast("int").alias("degree"), F.lit(1.0).alias("opacity"))
    t = t.withColumn("sh_rest", F.array_repeat(one, F.expr("cast(degree * (degree + 2) as int)")))
    return splats.prepared(t, 0.0, 2).select("c_custkey", "degree", F.size("sh_rest").alias("kept"))


# ---------------------------------------------------------------- outputs and hooks


@query("SELECT 'INTENSITY' AS name, 'UINT16' AS type, '_INTENSITY' AS attribute UNION ALL SELECT 'MY_HEIGHT', 'FLOAT32', '_MY_HEIGHT' UNION ALL SELECT 'WITHHELD', 'UINT8', '_WITHHELD'")
def content_schema(spark, sf_dir):
    """The attributes that a content says it has."""
    n = table(spark, sf_dir, "nation").count()
    t = pa.table({a: np.arange(n, dtype="f4") for a in "xyz"} | {c: np.zeros(n, "i2") for c in "rgb"} | {"intensity": np.arange(n, dtype="i4"), "my-height": np.arange(n, dtype="f4"), "withheld": np.zeros(n, bool)})
    doc, _ = contents.document(tiles.glb(t, [("intensity", "uint16"), ("my-height", "float32"), ("withheld", "uint8")]))
    e = doc["extensions"]["EXT_structural_metadata"]
    types, named = e["schema"]["classes"]["point"]["properties"], e["propertyAttributes"][0]["properties"]
    return spark.createDataFrame([(k, types[k]["componentType"], named[k]["attribute"]) for k in types], "name string, type string, attribute string")


@query("SELECT CAST(printf('%.4e', n_regionkey * 1.5) AS DOUBLE) AS corrected, count(*) AS n FROM nation GROUP BY n_regionkey")
def corrected_errors(spark, sf_dir):
    """Errors of an index times a correction."""
    box = (0.0, 1.0) * 3
    rows = [r["n_regionkey"] for r in table(spark, sf_dir, "nation").select("n_regionkey").collect()]  # twenty-five
    root = tileset.Tile("0", box, 99.0, None, "ADD", [tileset.Tile(f"0{i}", box, float(e), f"data/{i}.glb") for i, e in enumerate(rows)])
    found = [t["geometricError"] for t in _tiles_of(tileset.index_files(root, 4, factor=1.5)) if t.get("content")]
    return spark.createDataFrame([(e,) for e in found], "corrected double").groupBy("corrected").agg(F.count("*").alias("n"))


@query("SELECT CAST(i AS INTEGER) AS place, CAST(CASE WHEN i IN (0, 5, 10) THEN 2 WHEN i = 12 THEN 10 WHEN i = 13 THEN 20 WHEN i = 14 THEN 30 WHEN i = 15 THEN 1 ELSE 0 END AS DOUBLE) AS value FROM range(0, 16) t(i)")
def moved_root(spark, sf_dir):
    """A finished index whose root is given another transform."""
    folder = f"{Workspace(spark, 'moved').root}/tiles"
    tileset.write_index(folder, _index(spark, sf_dir))
    tileset.move_root(folder, [2.0, 0, 0, 0, 0, 2.0, 0, 0, 0, 0, 2.0, 0, 10, 20, 30, 1])
    with File(f"{folder}/tileset.json") as f:
        values = json.loads(f.read(0, f.size))["root"]["transform"]
    return spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "place int, value double")


@query("SELECT s_suppkey AS tile, 'packed/' || s_suppkey || '.bin' AS path, CAST(length('tile ' || s_suppkey) + 1 AS BIGINT) AS bytes, md5('tile ' || s_suppkey || '!') AS md5 FROM supplier")
def through_middleware(spark, sf_dir):
    """Contents that go through two steps on their way to the folder."""
    folder = f"{Workspace(spark, 'middleware').root}/out"
    k = F.col("s_suppkey").cast("string")
    t = table(spark, sf_dir, "supplier").select(k.alias("tile"), F.concat(k, F.lit(".bin")).alias("path"), F.concat(F.lit("tile "), k).cast("binary").alias("content"))
    out = tiles.written(t, folder, [lambda p, c: (p, c + b"!"), lambda p, c: (f"packed/{p}", c)])
    out = Workspace(spark, "middleware").keep(out, "written")

    def read(batches):
        for b in batches:
            found = []
            for p in b.column("path").to_pylist():
                with File(f"{folder}/{p}") as f:
                    found.append(f.read(0, f.size))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("tile", "path", "bytes")), pa.array(found, pa.binary())], names=["tile", "path", "bytes", "content"])

    kind = table(spark, sf_dir, "supplier").schema["s_suppkey"].dataType
    return out.mapInArrow(read, "tile string, path string, bytes long, content binary").select(F.col("tile").cast(kind).alias("tile"), "path", "bytes", F.md5("content").alias("md5"))


@query(f"WITH {POINTS} SELECT l_returnflag AS leaf, count(*) AS n, CAST(sum(l_linenumber) AS BIGINT) AS lines FROM points GROUP BY ALL")
def own_plan(spark, sf_dir):
    """Points routed by a plan that was made by hand, on a column of codes: A below N below R."""
    code = F.ascii("l_returnflag").cast("double")
    p = points(spark, sf_dir).withColumn("x", code)
    plan = kd.Plan([kd.Node("0", "x", float(ord("N"))), kd.Node("00"), kd.Node("01", "x", float(ord("R"))), kd.Node("010"), kd.Node("011")])
    name = F.element_at(F.create_map(*(F.lit(v) for kv in (("00", "A"), ("010", "N"), ("011", "R")) for v in kv)), F.col("leaf"))
    return plan.routed(p).groupBy(name.alias("leaf")).agg(F.count("*").alias("n"), F.sum("l_linenumber").cast("long").alias("lines"))

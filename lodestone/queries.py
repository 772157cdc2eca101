"""Queries over whole tables, each with the SQL that DuckDB answers the same.

Line items stand for points: position is (quantity, price, discount).
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import model
from .functions import colour, crs, frames, scalar
from .job import ship
from .operators import knn, raster, sample, stats, transforms, voxel
from .operators import splats as operators_splats
from .plans import kd, splats
from .sinks import tileset
from .sources import geotiff

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

IDS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
POINTS = """points AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_quantity AS DOUBLE) AS x, l_extendedprice / 1000 AS y,
 l_discount * 100 AS z, l_tax, l_returnflag, l_linestatus, l_extendedprice AS intensity FROM lineitem)"""


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "lineitem")
    return t.select(*IDS, F.col("l_quantity").cast("double").alias("x"), (F.col("l_extendedprice") / 1000).alias("y"), (F.col("l_discount") * 100).alias("z"), "l_tax", "l_returnflag", "l_linestatus", F.col("l_extendedprice").alias("intensity"))


def rounded(df: DataFrame, places: int, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, places) + 0.0 for n in names})


# ---------------------------------------------------------------- statistics


@query(f"WITH {POINTS} SELECT count(*) AS n, min(x) AS xmin, max(x) AS xmax, min(y) AS ymin, max(y) AS ymax, min(z) AS zmin, max(z) AS zmax FROM points")
def bbox(spark, sf_dir):
    return stats.bounds(points(spark, sf_dir))


@query(
    f"""WITH {POINTS}, b AS (SELECT l_returnflag, l_linestatus, count(*) AS n, min(x) AS xmin, max(x) AS xmax, min(y) AS ymin, max(y) AS ymax, min(z) AS zmin, max(z) AS zmax FROM points GROUP BY ALL)
SELECT l_returnflag, CAST(sum(n) AS BIGINT) AS n, min(xmin) AS xmin, max(xmax) AS xmax, min(ymin) AS ymin, max(ymax) AS ymax, min(zmin) AS zmin, max(zmax) AS zmax FROM b GROUP BY l_returnflag"""
)
def node_bbox_rollup(spark, sf_dir):
    return stats.merged_bounds(stats.bounds(points(spark, sf_dir), "l_returnflag", "l_linestatus"), "l_returnflag")


@query(
    """SELECT 'l_quantity' AS attribute, CAST(min(l_quantity) AS DOUBLE) AS min, CAST(max(l_quantity) AS DOUBLE) AS max FROM lineitem
UNION ALL SELECT 'l_extendedprice', min(l_extendedprice), max(l_extendedprice) FROM lineitem
UNION ALL SELECT 'l_linenumber', CAST(min(l_linenumber) AS DOUBLE), CAST(max(l_linenumber) AS DOUBLE) FROM lineitem
UNION ALL SELECT 'l_tax', min(l_tax + 0.0), max(l_tax + 0.0) FROM lineitem"""
)
def attribute_ranges(spark, sf_dir):
    return stats.attribute_ranges(table(spark, sf_dir, "lineitem").withColumn("l_tax", F.col("l_tax") + 0.0), ["l_quantity", "l_extendedprice", "l_linenumber", "l_tax"])


_AXIS = "CASE WHEN var_x >= var_y AND var_x >= var_z THEN 'x' WHEN var_y >= var_z THEN 'y' ELSE 'z' END AS axis"


@query(
    f"""WITH {POINTS}, v AS (SELECT l_returnflag, var_pop(x) AS var_x, var_pop(y) AS var_y, var_pop(z) AS var_z FROM points GROUP BY l_returnflag)
SELECT l_returnflag, round(var_x, 4) AS var_x, round(var_y, 4) AS var_y, round(var_z, 4) AS var_z, {_AXIS} FROM v"""
)
def axis_variance(spark, sf_dir):
    return rounded(stats.variance_axis(points(spark, sf_dir), "l_returnflag"), 4, "var_x", "var_y", "var_z")


@query(
    f"""WITH {POINTS}, v AS (SELECT l_returnflag, sum(l_tax*x*x)/sum(l_tax) - (sum(l_tax*x)/sum(l_tax))*(sum(l_tax*x)/sum(l_tax)) AS var_x,
 sum(l_tax*y*y)/sum(l_tax) - (sum(l_tax*y)/sum(l_tax))*(sum(l_tax*y)/sum(l_tax)) AS var_y, sum(l_tax*z*z)/sum(l_tax) - (sum(l_tax*z)/sum(l_tax))*(sum(l_tax*z)/sum(l_tax)) AS var_z
 FROM points WHERE l_tax > 0 GROUP BY l_returnflag)
SELECT l_returnflag, round(var_x, 4) AS var_x, round(var_y, 4) AS var_y, round(var_z, 4) AS var_z, {_AXIS} FROM v"""
)
def weighted_variance_axis(spark, sf_dir):
    return rounded(stats.weighted_variance_axis(points(spark, sf_dir), "l_tax", "l_returnflag"), 4, "var_x", "var_y", "var_z")


@query("SELECT list_sort(list(l_extendedprice))[count(*) // 2 + 1] AS upper_median FROM lineitem")
def upper_median(spark, sf_dir):
    return spark.createDataFrame([(stats.upper_median(table(spark, sf_dir, "lineitem"), "l_extendedprice"),)], "upper_median double")


@query(
    f"""WITH {POINTS}, e AS (SELECT l_returnflag, x AS v, sum(l_tax) AS w FROM points WHERE l_tax > 0 GROUP BY ALL),
r AS (SELECT *, sum(w) OVER (PARTITION BY l_returnflag ORDER BY v ROWS UNBOUNDED PRECEDING) AS run, sum(w) OVER (PARTITION BY l_returnflag) AS total FROM e)
SELECT l_returnflag, min(v) AS weighted_median FROM r WHERE run >= total / 2 GROUP BY l_returnflag"""
)
def weighted_median(spark, sf_dir):
    return stats.weighted_medians(points(spark, sf_dir), "x", "l_tax", "l_returnflag")


@query("SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.02), 4) AS low, round(quantile_cont(l_extendedprice, 0.98), 4) AS high FROM lineitem GROUP BY l_returnflag")
def percentile_stretch(spark, sf_dir):
    found = stats.quantiles(table(spark, sf_dir, "lineitem"), "l_extendedprice", [0.02, 0.98], "l_returnflag")
    return rounded(spark.createDataFrame([(k, *v) for k, v in found.items()], "l_returnflag string, low double, high double"), 4, "low", "high")


@query(
    """WITH q AS (SELECT l_returnflag, l_extendedprice AS v, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) AS k, count(*) OVER (PARTITION BY l_returnflag) AS n FROM lineitem)
SELECT l_returnflag, round((max(CASE WHEN k = n - n // 100 THEN v END) - max(CASE WHEN k = n // 100 + 1 THEN v END)) / 0.98, 4) AS spread FROM q GROUP BY l_returnflag"""
)
def trimmed_spread(spark, sf_dir):
    t = table(spark, sf_dir, "lineitem").select("l_returnflag", F.col("l_extendedprice").alias("x"))
    out = stats.trimmed_spread(t, 0.01, "l_returnflag", ("x",))
    return out.select("l_returnflag", F.round("spread_x", 4).alias("spread"))


# ---------------------------------------------------------------- plan and route

_LEVEL = """, v{i} AS (SELECT leaf, CASE WHEN var_pop(x) >= var_pop(y) AND var_pop(x) >= var_pop(z) THEN 'x' WHEN var_pop(y) >= var_pop(z) THEN 'y' ELSE 'z' END AS axis FROM l{i} GROUP BY leaf),
k{i} AS (SELECT l{i}.*, v{i}.axis, CASE v{i}.axis WHEN 'x' THEN x WHEN 'y' THEN y ELSE z END AS c FROM l{i} JOIN v{i} USING (leaf)),
s{i} AS (SELECT leaf, list_sort(list(c))[count(*) // 2 + 1] AS split FROM k{i} GROUP BY leaf),
l{j} AS (SELECT x, y, z, leaf || CASE WHEN c < split THEN '0' ELSE '1' END AS leaf FROM k{i} JOIN s{i} USING (leaf))"""
_TWO_LEVELS = f"WITH {POINTS}, l0 AS (SELECT x, y, z, '0' AS leaf FROM points)" + _LEVEL.format(i=0, j=1) + _LEVEL.format(i=1, j=2)
_LEAVES = "count(*) AS n, min(x) AS xmin, max(x) AS xmax, min(y) AS ymin, max(y) AS ymax, min(z) AS zmin, max(z) AS zmax"


def _routed(spark, sf_dir, levels: int = 2) -> DataFrame:
    p = points(spark, sf_dir)
    return kd.plan_exactly(p, levels).routed(p)


@query(_TWO_LEVELS + f" SELECT leaf, {_LEAVES}, round(4 * sqrt(((max(x)-min(x))*(max(y)-min(y)) + (max(x)-min(x))*(max(z)-min(z)) + (max(y)-min(y))*(max(z)-min(z))) / count(*)), 6) AS error FROM l2 GROUP BY leaf")
def kd_two_level_leaf_stats(spark, sf_dir):
    return rounded(kd.leaf_stats(_routed(spark, sf_dir)), 6, "error")


@query(_TWO_LEVELS + " SELECT leaf, count(*) AS n FROM l2 GROUP BY leaf")
def kd_route_counts(spark, sf_dir):
    return _routed(spark, sf_dir).groupBy("leaf").agg(F.count("*").alias("n"))


@query(
    _TWO_LEVELS
    + """, c AS (SELECT leaf, count(*) AS n FROM l2 GROUP BY leaf), mid AS (SELECT left(leaf, 2) AS path, sum(n // 2) AS n FROM c GROUP BY ALL)
SELECT leaf AS path, CAST(n - n // 2 AS BIGINT) AS n FROM c UNION ALL SELECT path, CAST(n - n // 2 AS BIGINT) FROM mid UNION ALL SELECT '0', CAST(sum(n // 2) AS BIGINT) FROM mid"""
)
def lod_counts(spark, sf_dir):
    sizes = {r["leaf"]: r["n"] for r in kd_route_counts(spark, sf_dir).collect()}  # a row for each leaf
    return spark.createDataFrame(list(kd.tile_counts(sizes).items()), "path string, n long")


@query(f"WITH {POINTS} SELECT count(*) AS n, min(x) AS xmin, max(x) AS xmax, min(y) AS ymin, max(y) AS ymax, min(z) AS zmin, max(z) AS zmax FROM points")
def lod_tiles(spark, sf_dir):
    """Every point in its tile, after points have moved up the tree: the tiles' points and boxes together."""
    p = points(spark, sf_dir).withColumn("point_id", F.xxhash64(*IDS, "x", "y", "z"))
    leaves = kd.leaf_count(p.count(), 5_000)
    p = kd.plan(p, leaves, IDS).routed(p).select("point_id", "x", "y", "z", "leaf")
    return stats.merged_bounds(stats.bounds(kd.bubble_up(spark, p), "tile"))


@query(_TWO_LEVELS + ", s AS (SELECT substring(leaf, 1, i) AS path FROM l2, range(1, 4) t(i)), u AS (SELECT DISTINCT path FROM s) SELECT a.path, count(*) AS tiles FROM u a JOIN u b ON starts_with(b.path, a.path) GROUP BY a.path")
def subtree_sizes(spark, sf_dir):
    found = kd.leaf_stats(_routed(spark, sf_dir)).collect()  # a row for each leaf
    rows = {r["leaf"]: r.asDict() | {"path": r["leaf"]} for r in found}
    for path in {p[:i] for p in rows for i in range(1, len(p))}:
        rows[path] = next(r for p, r in rows.items() if p.startswith(path)) | {"path": path}
    sizes = tileset.subtree_sizes(tileset.tree(list(rows.values()), "glb"))
    return spark.createDataFrame(list(sizes.items()), "path string, tiles long")


@query(
    _TWO_LEVELS
    + """, b AS (SELECT leaf, count(*) AS n, 4 * sqrt(((max(x)-min(x))*(max(y)-min(y)) + (max(x)-min(x))*(max(z)-min(z)) + (max(y)-min(y))*(max(z)-min(z))) / count(*)) AS e FROM l2 GROUP BY leaf),
m AS (SELECT left(leaf, 2) AS path, max(e) * 1.01 AS e FROM b GROUP BY ALL)
SELECT leaf AS path, round(e, 6) AS error FROM b UNION ALL SELECT path, round(e, 6) FROM m UNION ALL SELECT '0', round(max(e) * 1.01, 6) FROM m"""
)
def error_clamp(spark, sf_dir):
    leaves = kd.leaf_stats(_routed(spark, sf_dir)).collect()  # a row for each leaf
    paths = {r["leaf"][:i] for r in leaves for i in range(1, len(r["leaf"]))}
    raw = [{"path": r["leaf"], "error": r["error"]} for r in leaves] + [{"path": p, "error": 0.0} for p in paths]
    return rounded(spark.createDataFrame(list(stats.clamped_errors(raw).items()), "path string, error double"), 6, "error")


# ---------------------------------------------------------------- sampling

_CELL = "floor(x / 6.25) AS vx, floor(y / 13.125) AS vy, floor(z / 2.5) AS vz, (x - (floor(x / 6.25) + 0.5) * 6.25) ** 2 + (y - (floor(y / 13.125) + 0.5) * 13.125) ** 2 + (z - (floor(z / 2.5) + 0.5) * 2.5) ** 2 AS d"


@query(
    f"""WITH {POINTS}, c AS (SELECT *, {_CELL} FROM points),
r AS (SELECT *, row_number() OVER (PARTITION BY vx, vy, vz ORDER BY d, l_orderkey, l_linenumber, l_partkey, l_suppkey) AS k, count(*) OVER (PARTITION BY vx, vy, vz) AS n_in_cell FROM c)
SELECT CAST(vx AS BIGINT) AS vx, CAST(vy AS BIGINT) AS vy, CAST(vz AS BIGINT) AS vz, n_in_cell, l_orderkey, l_linenumber, l_partkey, l_suppkey FROM r WHERE k = 1"""
)
def voxel_representative(spark, sf_dir):
    out = voxel.representatives(points(spark, sf_dir), (6.25, 13.125, 2.5), IDS)
    return out.select("vx", "vy", "vz", "n_in_cell", *IDS)


@query(
    f"""WITH {POINTS}, l AS (SELECT i AS level, floor(x / (16 / 2**i)) AS vx, floor(y / (32 / 2**i)) AS vy, floor(z / (8 / 2**i)) AS vz FROM points, range(0, 4) t(i))
SELECT CAST(level AS INTEGER) AS level, count(*) AS cells FROM (SELECT DISTINCT * FROM l) GROUP BY level"""
)
def voxel_levels(spark, sf_dir):
    return voxel.occupied(points(spark, sf_dir), (16.0, 32.0, 8.0), 4)


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem WHERE ((l_orderkey * 2654435761) % 100 + 100) % 100 < 30")
def subsample_hash(spark, sf_dir):
    return sample.subsample_by_key(table(spark, sf_dir, "lineitem"), "l_orderkey", 30, 100).select(*IDS)


@query("WITH r AS (SELECT l_returnflag, count(*) AS n FROM lineitem GROUP BY ALL) SELECT l_returnflag, CAST(floor(n * 0.66) AS BIGINT) AS taken, CAST(n - floor(n * 0.66) AS BIGINT) AS rest FROM r")
def add_disjoint_partition(spark, sf_dir):
    parted = sample.split_exactly(table(spark, sf_dir, "lineitem"), 0.66, IDS, "l_returnflag")
    return parted.groupBy("l_returnflag").agg(F.count_if("taken").alias("taken"), F.count_if(~F.col("taken")).alias("rest"))


# ---------------------------------------------------------------- frames

_GEO = "geo AS (SELECT s_suppkey, (s_suppkey * 37 % 360 - 180) + 0.25 AS lon, (s_suppkey * 53 % 170 - 85) + 0.125 AS lat, s_acctbal AS h FROM supplier)"
_E2 = "(1 / 298.257223563) * (2 - 1 / 298.257223563)"
_ECEF = f"""{_GEO}, n AS (SELECT *, 6378137.0 / sqrt(1 - {_E2} * sin(radians(lat)) ** 2) AS n FROM geo),
ecef AS (SELECT s_suppkey, (n + h) * cos(radians(lat)) * cos(radians(lon)) AS x, (n + h) * cos(radians(lat)) * sin(radians(lon)) AS y, (n * (1 - {_E2}) + h) * sin(radians(lat)) AS z FROM n)"""


def _geo(spark, sf_dir) -> DataFrame:
    k = F.col("s_suppkey")
    lon, lat = (k * 37 % 360 - 180).cast("double") + 0.25, (k * 53 % 170 - 85).cast("double") + 0.125
    return table(spark, sf_dir, "supplier").select("s_suppkey", lon.alias("lon"), lat.alias("lat"), F.col("s_acctbal").alias("h"))


def _ecef(spark, sf_dir) -> DataFrame:
    x, y, z = frames.to_ecef("EPSG:4979", F.col("lon"), F.col("lat"), F.col("h"))
    return _geo(spark, sf_dir).select("s_suppkey", x.alias("x"), y.alias("y"), z.alias("z"))


_R3 = "round(x, 3) + 0.0 AS x, round(y, 3) + 0.0 AS y, round(z, 3) + 0.0 AS z"


@query(f"WITH {_ECEF} SELECT s_suppkey, {_R3} FROM ecef")
def ecef(spark, sf_dir):
    return rounded(_ecef(spark, sf_dir), 3, "x", "y", "z")


@query(
    f"""WITH {_ECEF}, o AS (SELECT x AS ox, y AS oy, z AS oz FROM ecef ORDER BY s_suppkey LIMIT 1),
u AS (SELECT *, ox / 6378137.0**2 AS ux, oy / 6378137.0**2 AS uy, oz / 6356752.31424518**2 AS uz FROM o),
w AS (SELECT ox, oy, oz, ux / sqrt(ux*ux+uy*uy+uz*uz) AS ux, uy / sqrt(ux*ux+uy*uy+uz*uz) AS uy, uz / sqrt(ux*ux+uy*uy+uz*uz) AS uz FROM u),
e AS (SELECT *, uz / sqrt(uz*uz + ux*ux) AS ex, 0.0 AS ey, -ux / sqrt(uz*uz + ux*ux) AS ez FROM w),
f AS (SELECT *, uy*ez - uz*ey AS nx, uz*ex - ux*ez AS ny, ux*ey - uy*ex AS nz FROM e)
SELECT s_suppkey, round(ex*(x-ox) + ey*(y-oy) + ez*(z-oz), 2) + 0.0 AS x, round(nx*(x-ox) + ny*(y-oy) + nz*(z-oz), 2) + 0.0 AS y, round(ux*(x-ox) + uy*(y-oy) + uz*(z-oz), 2) + 0.0 AS z FROM ecef, f"""
)
def local_frame(spark, sf_dir):
    p = _ecef(spark, sf_dir)
    local = frames.anchored(p, ["s_suppkey"]).inverse(F.col("x"), F.col("y"), F.col("z"))
    return rounded(p.select("s_suppkey", *(v.alias(a) for a, v in zip("xyz", local, strict=True))), 2, "x", "y", "z")


@query("SELECT s_suppkey, round(degrees((s_suppkey * 1000.0 + 0.5) / 6378137.0), 9) AS lon, round(degrees(2 * atan(exp(s_acctbal * 100 / 6378137.0)) - pi() / 2), 9) + 0.0 AS lat FROM supplier")
def mercator(spark, sf_dir):
    t = table(spark, sf_dir, "supplier")
    lon, lat = frames.mercator_to_geodetic(F.col("s_suppkey") * 1000.0 + 0.5, F.col("s_acctbal") * 100)
    return rounded(t.select("s_suppkey", lon.alias("lon"), lat.alias("lat")), 9, "lon", "lat")


def _krueger(lon0: float) -> str:
    f = 1 / 298.257223563
    n = f / (2 - f)
    lit = lambda v: f"{v:.17e}"
    big = 6378137.0 / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    b = [n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96 - n**4 / 360, n**2 / 48 + n**3 / 15 - 437 * n**4 / 1440, 17 * n**3 / 480 - 37 * n**4 / 840, 4397 * n**4 / 161280]
    d = [2 * n - 2 * n**2 / 3 - 2 * n**3 + 116 * n**4 / 45, 7 * n**2 / 3 - 8 * n**3 / 5 - 227 * n**4 / 45, 56 * n**3 / 15 - 136 * n**4 / 35, 4279 * n**4 / 630]
    xi = " - ".join(["xi", *(f"{lit(c)} * sin({2 * j} * xi) * cosh({2 * j} * eta)" for j, c in enumerate(b, 1))])
    eta = " - ".join(["eta", *(f"{lit(c)} * cos({2 * j} * xi) * sinh({2 * j} * eta)" for j, c in enumerate(b, 1))])
    lat = " + ".join(["chi", *(f"{lit(c)} * sin({2 * j} * chi)" for j, c in enumerate(d, 1))])
    return f"""a AS (SELECT s_suppkey, h, north / {lit(0.9996 * big)} AS xi, (east - 5e5) / {lit(0.9996 * big)} AS eta FROM grid),
b AS (SELECT s_suppkey, h, {xi} AS xi1, {eta} AS eta1 FROM a), c AS (SELECT *, asin(sin(xi1) / cosh(eta1)) AS chi FROM b),
utm AS (SELECT s_suppkey, h, {lon0} + degrees(atan2(sinh(eta1), cos(xi1))) AS lon, degrees({lat}) AS lat FROM c)"""


@query(
    f"""WITH grid AS (SELECT s_suppkey, 4e5 + s_suppkey % 1000 * 2e2 AS east, 4.4e6 + s_suppkey % 700 * 5e2 AS north, s_acctbal AS h FROM supplier), {_krueger(15.0)},
n AS (SELECT *, 6378137.0 / sqrt(1 - {_E2} * sin(radians(lat)) ** 2) AS n FROM utm),
e AS (SELECT s_suppkey, (n + h) * cos(radians(lat)) * cos(radians(lon)) AS x, (n + h) * cos(radians(lat)) * sin(radians(lon)) AS y, (n * (1 - {_E2}) + h) * sin(radians(lat)) AS z FROM n)
SELECT s_suppkey, {_R3} FROM e"""
)
def utm_to_ecef(spark, sf_dir):
    k = F.col("s_suppkey")
    grid = table(spark, sf_dir, "supplier").select(k, (k % 1000 * 200.0 + 400000.0).alias("x"), (k % 700 * 500.0 + 4400000.0).alias("y"), F.col("s_acctbal").alias("z"))
    return rounded(frames.reprojected(grid, "EPSG:32633"), 3, "x", "y", "z")


_PLACED = frames.placement(lon=12.5, lat=41.9, height=50, heading=30, pitch=10, roll=-5, scale=2, up="y")
_FWD = [" + ".join([f"({c!r}) * {a}" for c, a in zip(r, "xyz", strict=True)] + [repr(o)]) for r, o in zip(_PLACED.rotation, _PLACED.origin, strict=True)]


@query(f"WITH {POINTS} SELECT l_returnflag, " + ", ".join(f"round(sum({e}) / count(*), 3) AS {a}" for e, a in zip(_FWD, "xyz", strict=True)) + " FROM points GROUP BY l_returnflag")
def placement_point(spark, sf_dir):
    placed = _PLACED.forward(F.col("x"), F.col("y"), F.col("z"))
    means = [F.round(F.sum(v) / F.count("*"), 3).alias(a) for a, v in zip("xyz", placed, strict=True)]
    return points(spark, sf_dir).groupBy("l_returnflag").agg(*means)


# ---------------------------------------------------------------- rows


@query(f"WITH {POINTS} SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(CAST(z AS FLOAT) + CAST(2.5 AS FLOAT) AS FLOAT) AS z FROM points")
def z_offset(spark, sf_dir):
    return points(spark, sf_dir).transform(transforms.z_offset(2.5)).select(*IDS, "z")


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem WHERE l_linestatus <> 'F'")
def withheld_filter(spark, sf_dir):
    return transforms.drop_withheld(points(spark, sf_dir).withColumn("withheld", F.col("l_linestatus") == "F")).select(*IDS)


def _ramp_sql(g: colour.Gradient, t: str) -> str:
    out = []
    for c, name in enumerate("rgb"):
        cases = [f"WHEN {t} <= 0 THEN {g.colours[0][c]}"]
        for i in range(len(g.stops) - 1):
            a, b, s, e = g.colours[i][c], g.colours[i + 1][c], g.stops[i], g.stops[i + 1]
            here = f"{a}" if g.flat or a == b else f"floor({float(a)} + {float(b - a)} * (({t} - {s!r}) / {e - s!r}) + 0.5)"
            cases.append(f"WHEN {t} < {e!r} THEN {here}")
        out.append(f"CAST(CASE {' '.join(cases)} ELSE {g.colours[-1][c]} END AS INTEGER) AS {name}")
    return ", ".join(out)


def _colours(spark, sf_dir, text: str, low: float, high: float) -> DataFrame:
    p = points(spark, sf_dir).withColumns({c: F.lit(v).cast("short") for c, v in zip("rgb", (10, 200, 90), strict=True)})
    done = transforms.Colouring.parse(text).apply(p, (low, high))
    return done.groupBy(*(F.col(c).cast("int").alias(c) for c in "rgb")).agg(F.count("*").alias("n"))


_RANGE = "(CAST(intensity AS DOUBLE) - 1000.0) / 99000.0"


def _colour_sql(g: colour.Gradient, t: str = _RANGE) -> str:
    return f"WITH {POINTS}, c AS (SELECT {_ramp_sql(g, t)} FROM points) SELECT r, g, b, count(*) AS n FROM c GROUP BY ALL"


@query(_colour_sql(colour.GRADIENTS["heat"]))
def colour_linear(spark, sf_dir):
    return _colours(spark, sf_dir, "intensity:heat", 1000.0, 100000.0)


@query(_colour_sql(colour.GRADIENTS["viridis"].steps(5)))
def colour_steps(spark, sf_dir):
    return _colours(spark, sf_dir, "intensity:viridis:steps=5", 1000.0, 100000.0)


@query(_colour_sql(colour.GRADIENTS["magma"].reverse()))
def colour_reverse(spark, sf_dir):
    return _colours(spark, sf_dir, "intensity:magma:reverse", 1000.0, 100000.0)


_SYSTEMS = ("EPSG:32633", "EPSG:32733", "EPSG:25832", "EPSG:3067", "EPSG:2154", "EPSG:3035", "EPSG:3034", "EPSG:5070", "EPSG:3395", "EPSG:3413", "EPSG:3031", "EPSG:3857", "EPSG:3946", "EPSG:32633+5773", "+proj=lcc +lat_1=28.3833333 +lat_2=30.2833333 +lat_0=27.8333333 +lon_0=-99 +x_0=600000 +units=us-ft +ellps=clrk66")


def _system_sql(i: int, name: str) -> str:
    c = crs.parsed(name)
    lat = f"{'-' if c.lat0 < 0 or name.endswith(':32733') else ''}(30 + s_suppkey % 50 + 0.125)"
    return f"SELECT {i} AS system, CAST(s_suppkey AS BIGINT) AS s_suppkey, CAST({c.lon0} + (s_suppkey * 7 % 6 - 2.5) AS DOUBLE) AS lon, CAST({lat} AS DOUBLE) AS lat, CAST(round(s_acctbal, 2) AS DOUBLE) AS h FROM supplier"


@query(f"SELECT system, s_suppkey, round(CASE WHEN lon > 180 THEN lon - 360 ELSE lon END, 7) + 0.0 AS lon, round(lat, 7) AS lat, round(h, 4) + 0.0 AS h FROM ({' UNION ALL '.join(_system_sql(i, n) for i, n in enumerate(_SYSTEMS))})")
def crs_round_trips(spark, sf_dir):
    """Longitude and latitude to the earth, to each of the systems, back to the earth, and to longitude and latitude."""
    out, k = None, F.col("s_suppkey")
    for i, name in enumerate(_SYSTEMS):
        c = crs.parsed(name)
        geo = crs.Crs("longlat", ellipsoid=c.ellipsoid)
        lat = (k % 50 + 30.125) * (-1 if c.lat0 < 0 or name.endswith(":32733") else 1)
        p = table(spark, sf_dir, "supplier").select(F.lit(i).alias("system"), k.cast("long").alias("s_suppkey"), (F.lit(c.lon0) + (k * 7 % 6 - 2.5)).alias("x"), lat.alias("y"), F.round("s_acctbal", 2).alias("z"))
        point = F.struct("x", "y", "z")
        p = p.select("system", "s_suppkey", crs.through([*crs.to_earth(geo), *crs.from_earth(c)], point).alias("p")).select("system", "s_suppkey", "p.*")
        p = p.select("system", "s_suppkey", crs.through([*crs.to_earth(c), *crs.from_earth(geo)], point).alias("p")).select("system", "s_suppkey", F.col("p.x").alias("lon"), F.col("p.y").alias("lat"), F.col("p.z").alias("h"))
        out = p if out is None else out.unionByName(p)
    return rounded(rounded(out, 7, "lon", "lat"), 4, "h")


@query(
    f"""WITH {POINTS}, c AS (SELECT {_ramp_sql(colour.GRADIENTS["grayscale"], _RANGE)} FROM points)
SELECT CAST(floor(10 * 0.75 + r * 0.25 + 0.5) AS INTEGER) AS r, CAST(floor(200 * 0.75 + g * 0.25 + 0.5) AS INTEGER) AS g, CAST(floor(90 * 0.75 + b * 0.25 + 0.5) AS INTEGER) AS b, count(*) AS n FROM c GROUP BY ALL"""
)
def colour_blend(spark, sf_dir):
    return _colours(spark, sf_dir, "intensity:grayscale:blend=0.25", 1000.0, 100000.0)


@query(_colour_sql(colour.GRADIENTS["las-classification"], "(CAST(x AS DOUBLE) - 0.0) / 255.0"))
def las_palette(spark, sf_dir):
    return _colours(spark, sf_dir, "x:las-classification", 0.0, 255.0)


@query(
    "SELECT l_linenumber, CAST(floor(pow((l_partkey % 256) / 255.0, 2.2) * 255.0) AS INTEGER) AS linear, count(*) AS n FROM lineitem GROUP BY ALL"
)
def srgb_linear(spark, sf_dir):
    t = table(spark, sf_dir, "lineitem").withColumn("linear", colour.srgb_to_linear(F.col("l_partkey") % 256))
    return t.groupBy("l_linenumber", "linear").agg(F.count("*").alias("n"))


@query(
    f"""WITH {POINTS}, b AS (SELECT l_returnflag, min(y) AS lo, max(y) AS hi FROM points GROUP BY l_returnflag)
SELECT l_returnflag, CAST(floor((y - lo) / (hi - lo) * 65535.0 + 0.5) AS INTEGER) // 4096 AS bucket, count(*) AS n FROM points JOIN b USING (l_returnflag) GROUP BY ALL"""
)
def quantise_u16(spark, sf_dir):
    p = points(spark, sf_dir)
    box = p.groupBy("l_returnflag").agg(F.min("y").alias("lo"), F.max("y").alias("hi"))
    q = p.join(box, "l_returnflag").withColumn("bucket", F.expr("0") + F.floor(scalar.quantised(F.col("y"), F.col("lo"), F.col("hi"), 16) / 4096).cast("int"))
    return q.groupBy("l_returnflag", "bucket").agg(F.count("*").alias("n"))


@query(
    """SELECT 0 AS file_id, s_suppkey AS k, s_acctbal AS v, s_nationkey AS nation FROM supplier UNION ALL SELECT 1, c_custkey, c_acctbal, 0 FROM customer"""
)
def union_by_name_zero_fill(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_acctbal").alias("v"), F.col("s_nationkey").alias("nation"))
    return model.union_points([s, table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("v"))])


# ---------------------------------------------------------------- joins

_CELLS = """cells AS (SELECT CAST(p_size AS INTEGER) AS col, CAST(p_partkey % 50 AS INTEGER) AS "row", CAST(max(p_partkey * 7 % 256) AS INTEGER) AS r, CAST(max(p_partkey * 11 % 256) AS INTEGER) AS g, CAST(max(p_partkey * 13 % 256) AS INTEGER) AS b, CAST(max(p_partkey % 3) * 100 AS INTEGER) AS a FROM part GROUP BY ALL)"""


def _cells(spark, sf_dir) -> DataFrame:
    k = F.col("p_partkey")
    parts = table(spark, sf_dir, "part").groupBy(F.col("p_size").cast("int").alias("col"), (k % 50).cast("int").alias("row"))
    return parts.agg(*(F.max(v).cast("int").alias(n) for n, v in (("r", k * 7 % 256), ("g", k * 11 % 256), ("b", k * 13 % 256))), (F.max(k % 3) * 100).cast("int").alias("a"))


def _over_cells(spark, sf_dir) -> DataFrame:
    p = table(spark, sf_dir, "orders")
    return p.select("o_orderkey", (F.col("o_orderkey") % 997 * 0.05137).alias("x"), (F.col("o_custkey") % 499 * 0.10173).alias("y"))


_OVER = "over_cells AS (SELECT o_orderkey, CAST(o_orderkey % 997 AS DOUBLE) * CAST(0.05137 AS DOUBLE) AS x, CAST(o_custkey % 499 AS DOUBLE) * CAST(0.10173 AS DOUBLE) AS y FROM orders)"


@query(f"WITH {_CELLS}, {_OVER} SELECT o_orderkey, r AS cell_r, g AS cell_g, b AS cell_b, a AS cell_a FROM over_cells LEFT JOIN cells ON col = CAST(floor(x) AS INTEGER) AND \"row\" = CAST(floor(y) AS INTEGER)")
def nearest_sample(spark, sf_dir):
    out = raster.nearest_cells(_over_cells(spark, sf_dir), _cells(spark, sf_dir), (0.0, 0.0), (1.0, 1.0))
    return out.select("o_orderkey", *(f"cell_{c}" for c in "rgba"))


@query(
    f"""WITH {_CELLS}, {_OVER}, q AS (SELECT *, floor(x - 0.5) AS fu, floor(y - 0.5) AS fv FROM over_cells),
c AS (SELECT o_orderkey, CAST(fu + i AS INTEGER) AS col, CAST(fv + j AS INTEGER) AS "row", CASE i WHEN 1 THEN x - 0.5 - fu ELSE 1 - (x - 0.5) + fu END * CASE j WHEN 1 THEN y - 0.5 - fv ELSE 1 - (y - 0.5) + fv END AS w FROM q, range(2) s(i), range(2) t(j)),
m AS (SELECT o_orderkey, w, coalesce(a, 0) AS a, coalesce(r, 0) AS r, coalesce(g, 0) AS g, coalesce(b, 0) AS b FROM c LEFT JOIN cells USING (col, "row"))
SELECT o_orderkey, CAST(CASE WHEN sum(w*a) <> 0 THEN floor(sum(w*a*r) / sum(w*a) + 0.5) END AS INTEGER) AS cell_r, CAST(CASE WHEN sum(w*a) <> 0 THEN floor(sum(w*a*g) / sum(w*a) + 0.5) END AS INTEGER) AS cell_g, CAST(CASE WHEN sum(w*a) <> 0 THEN floor(sum(w*a*b) / sum(w*a) + 0.5) END AS INTEGER) AS cell_b, CAST(floor(sum(w*a) + 0.5) AS INTEGER) AS cell_a FROM m GROUP BY o_orderkey"""
)
def bilinear_sample(spark, sf_dir):
    return raster.bilinear_cells(_over_cells(spark, sf_dir), _cells(spark, sf_dir), ["o_orderkey"], (0.0, 0.0), (1.0, 1.0))


def _spots(spark, sf_dir) -> DataFrame:
    t = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_suppkey"), "s_acctbal", "s_nationkey")
    return t.select("id", (F.col("id") % 10 * 1.0).alias("x"), (F.col("s_acctbal") / 1000).alias("y"), (F.col("s_nationkey") / 5).alias("z"))


_NEAR = """s AS (SELECT s_suppkey AS id, s_suppkey % 10 * 1.0 AS x, s_acctbal / 1000 AS y, s_nationkey / 5 AS z FROM supplier),
d AS (SELECT a.id AS a, b.id AS b, (a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) + (a.z-b.z)*(a.z-b.z) AS d2 FROM s a JOIN s b ON a.id <> b.id),
k AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY d2, b) AS rank FROM d WHERE d2 <= 4.0), near AS (SELECT * FROM k WHERE rank <= 8)"""


@query(f"WITH {_NEAR} SELECT a, b, round(d2, 6) AS d2, CAST(rank AS INTEGER) AS rank FROM near")
def knn_points(spark, sf_dir):
    return rounded(knn.grid_neighbours(_spots(spark, sf_dir), "id", 2.0), 6, "d2")


@query(f"WITH {_NEAR} SELECT least(a, b) AS lo, greatest(a, b) AS hi, round(min(d2), 6) AS d2 FROM near GROUP BY ALL")
def edge_dedupe(spark, sf_dir):
    return rounded(knn.edges(knn.grid_neighbours(_spots(spark, sf_dir), "id", 2.0)), 6, "d2")


@query(f"WITH {_NEAR} SELECT x.a AS lo, x.b AS hi, round(x.d2, 6) AS d2 FROM near x JOIN near y ON x.a = y.b AND x.b = y.a AND y.rank = 1 WHERE x.rank = 1 AND x.a < x.b")
def mutual_best_edges(spark, sf_dir):
    return rounded(knn.mutual_best(knn.grid_neighbours(_spots(spark, sf_dir), "id", 2.0)), 6, "d2")


_PART_SPLATS = """splats AS (SELECT p_partkey AS k, p_partkey % 16 AS cluster, p_size * 1.0 AS x, p_retailprice / 100 AS y, CAST(p_partkey % 7 AS DOUBLE) AS z, 1 + (p_partkey % 5) / 10 AS sx, 1 + (p_partkey % 3) / 10 AS sy, 1 + (p_partkey % 4) / 10 AS sz,
0.1 + (p_partkey % 11) / 20 AS o, (p_partkey % 13) / 13 AS red FROM part), w AS (SELECT *, o * (sx * sy + sx * sz + sy * sz) / 3 AS w FROM splats)"""


def part_splats(spark, sf_dir) -> DataFrame:
    """Parts as splats along the axes."""
    k = F.col("p_partkey")
    one, none = F.lit(1.0), F.lit(0.0)
    columns = {"source_index": k, "cx": F.col("p_size").cast("double"), "cy": F.col("p_retailprice") / 100, "cz": (k % 7).cast("double"), "qw": one, "qx": none, "qy": none, "qz": none}
    columns |= {"sx": 1 + k % 5 / 10, "sy": 1 + k % 3 / 10, "sz": 1 + k % 4 / 10, "opacity": 0.1 + k % 11 / 20, "sh0_r": k % 13 / 13, "sh0_g": none, "sh0_b": none, "sh_rest": F.array().cast("array<struct<r:double,g:double,b:double>>")}
    return table(spark, sf_dir, "part").select(*(c.alias(n) for n, c in columns.items()))


@query(
    f"""WITH {_PART_SPLATS}, m AS (SELECT cluster, sum(w) AS t, sum(w * x) / sum(w) AS cx, sum(w * y) / sum(w) AS cy, sum(w * z) / sum(w) AS cz, sum(w * (x * x + y * y + z * z + sx * sx + sy * sy + sz * sz)) / sum(w) AS second,
1 - exp(sum(ln(1 - o))) AS opacity, sum(w * red) / sum(w) AS red, min(k) AS first FROM w GROUP BY cluster)
SELECT cluster, first, round(cx, 5) AS cx, round(cy, 5) AS cy, round(cz, 5) AS cz, round(second - cx * cx - cy * cy - cz * cz, 4) AS spread, round(opacity, 6) AS opacity, round(red, 6) AS red FROM m"""
)
def gaussian_merge_moments(spark, sf_dir):
    """Splats of a cluster as one: first index, centre, sum of variances, opacity, colour."""

    def merge(t: pa.Table) -> pa.Table:
        s = splats.as_arrays(t.sort_by("source_index"))
        one = operators_splats.merged(s, np.arange(len(s))[None])
        row = [t.column("cluster")[0].as_py(), one.index[0], *one.centre[0], (one.scale[0] ** 2).sum(), one.opacity[0], one.sh0[0, 0]]
        return pa.table({n: [v] for n, v in zip(("cluster", "first", "cx", "cy", "cz", "spread", "opacity", "red"), row, strict=True)})

    each = part_splats(spark, sf_dir).withColumn("cluster", F.col("source_index") % 16)
    out = each.groupBy("cluster").applyInArrow(merge, "cluster long, first long, cx double, cy double, cz double, spread double, opacity double, red double")
    return rounded(rounded(rounded(out, 5, "cx", "cy", "cz"), 4, "spread"), 6, "opacity", "red")


# ---------------------------------------------------------------- output values


@query(
    """WITH b AS (SELECT p_brand, min(p_retailprice) AS lo, max(p_retailprice) AS hi FROM part GROUP BY p_brand), s AS (SELECT *, pow(10, least(9, greatest(0, 6 - floor(log10(hi - lo))))) AS s FROM b WHERE hi > lo)
SELECT p_brand, floor(lo * s) / s AS low, ceil(hi * s) / s AS high FROM s"""
)
def box_round_outward(spark, sf_dir):
    b = table(spark, sf_dir, "part").groupBy("p_brand").agg(F.min("p_retailprice").alias("lo"), F.max("p_retailprice").alias("hi")).filter("hi > lo")
    low, high = scalar.rounded_outward(F.col("lo"), F.col("hi"))
    return b.select("p_brand", low.alias("low"), high.alias("high"))


@query("SELECT o_orderkey, CAST(printf('%.4e', o_totalprice / 3.14159265) AS DOUBLE) AS error FROM orders")
def error_5sig(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", scalar.five_digits(F.col("o_totalprice") / 3.14159265).alias("error"))


@query(
    """WITH h AS (SELECT s_name, md5(s_name) AS h FROM supplier),
o AS (SELECT s_name, h, array_to_string(list_reverse([substring(h, i, 2) for i in range(1, 16, 2)]), '') AS a, array_to_string(list_reverse([substring(h, i, 2) for i in range(17, 32, 2)]), '') AS b FROM h)
SELECT s_name, h AS md5, CAST(row_number() OVER (ORDER BY a, b) AS INTEGER) AS place FROM o"""
)
def archive_index_order(spark, sf_dir):
    """Names in the order of an archive's index: by both halves of their MD5 as little-endian numbers."""

    def keys(batches):
        for b in batches:
            names = b.column(0).to_pylist()
            both = [tileset.index_order(n) for n in names]
            yield pa.RecordBatch.from_pydict({"s_name": names, "a": [f"{x:016x}" for x, _ in both], "b": [f"{y:016x}" for _, y in both]})

    ship(spark)
    ranked = table(spark, sf_dir, "supplier").select("s_name").mapInArrow(keys, "s_name string, a string, b string")
    return ranked.select("s_name", F.md5("s_name").alias("md5"), F.row_number().over(Window.orderBy("a", "b")).alias("place"))


@query("SELECT DISTINCT p_type, lower(regexp_replace(p_type, '\\s+', '', 'g')) AS canonical, upper(regexp_replace(lower(regexp_replace(p_type, '\\s+', '', 'g')), '[^a-z0-9_]', '_', 'g')) AS output FROM part")
def canonical_names(spark, sf_dir):
    t = table(spark, sf_dir, "part").select("p_type").distinct()
    return t.select("p_type", model.canonical_column(F.col("p_type")).alias("canonical"), model.output_name_column(F.col("p_type")).alias("output"))


@query("SELECT DISTINCT p_brand, '_' || regexp_replace(upper(regexp_replace(lower(regexp_replace(p_brand, '\\s+', '', 'g')), '[^a-z0-9_]', '_', 'g')), '^_+', '') AS output FROM part")
def output_names(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_brand").distinct().select("p_brand", model.output_name_column(F.col("p_brand"), "glb").alias("output"))


@query(
    f"""WITH {_CELLS}, {_OVER}, m AS (SELECT a FROM over_cells LEFT JOIN cells ON col = CAST(floor(x) AS INTEGER) AND "row" = CAST(floor(y) AS INTEGER))
SELECT count(*) FILTER (a >= 100) AS coloured, count(*) FILTER (a IS NULL) AS missing, count(*) FILTER (a < 100) AS transparent FROM m"""
)
def row_counts(spark, sf_dir):
    """How many points an image coloured, missed, or met with transparent cells."""
    return geotiff.outcome(raster.nearest_cells(_over_cells(spark, sf_dir), _cells(spark, sf_dir), (0.0, 0.0), (1.0, 1.0)), 100)


@query("SELECT c_custkey, CAST((SELECT max(b) FROM range(0, 13) t(b) WHERE floor(abs(c_acctbal) * c_custkey * 2 ** b + 0.5) <= 8388607) AS INTEGER) AS fraction_bits FROM customer")
def fixed_point_bits(spark, sf_dir):
    """Fractional bits that 24-bit positions can have."""
    t = table(spark, sf_dir, "customer")
    return t.select("c_custkey", scalar.fraction_bits(F.abs("c_acctbal") * F.col("c_custkey")).alias("fraction_bits"))

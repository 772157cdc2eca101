"""Queries whose results are tile contents, splat trees and streamed tables."""

from __future__ import annotations

import uuid

import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import colour
from .job import Workspace, ship
from .operators import sample, stats, transforms
from .operators import splats as merging
from .plans import kd, splats
from .queries import _LEAVES, _PART_SPLATS, _TWO_LEVELS, IDS, POINTS, _ramp_sql, _routed, part_splats, points, query, rounded, table
from .sinks import contents, meshopt, spz, tiles, tileset
from .storage import File, write
from .streaming import ingest


def _leaves(spark: SparkSession, sf_dir: str, per_leaf: int) -> DataFrame:
    """Line items as coloured points with their leaf; ids hold every column, so that equal rows alone share one."""
    p = points(spark, sf_dir).withColumn("point_id", F.xxhash64(*IDS, "x", "y", "z"))
    leaves = kd.leaf_count(p.count(), per_leaf)
    p = p.withColumns({c: F.lit(255).cast("short") for c in "rgb"}).transform(lambda df: transforms.Colouring.parse("z:viridis").apply(df, (0.0, 10.0)))
    p = kd.plan(p, leaves, IDS).routed(p.withColumn("intensity", F.col("x").cast("short")))
    return p.select("point_id", *(F.col(a).cast("float").alias(a) for a in "xyz"), *"rgb", "intensity", "leaf")


def _tiled(spark: SparkSession, sf_dir: str, per_leaf: int = 10_000) -> DataFrame:
    return kd.bubble_up(spark, _leaves(spark, sf_dir, per_leaf)).drop("leaf")


_VIRIDIS = f"WITH {POINTS}, c AS (SELECT CAST(x AS SMALLINT) AS x, CAST(round(z) AS INTEGER) AS z, {_ramp_sql(colour.GRADIENTS['viridis'], '(z / 10.0)')} FROM points)"
_READ_BACK = " SELECT CAST(x AS BIGINT) AS x, CAST(z AS BIGINT) AS z, CAST({0} AS BIGINT) AS r, CAST({1} AS BIGINT) AS g, CAST({2} AS BIGINT) AS b, count(*) AS n, CAST(sum(x) AS BIGINT) AS intensity FROM c GROUP BY ALL"


def _contents(encoder: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        made = tiles.encoded(_tiled(spark, sf_dir), encoder).select("tile", "content")

        def read(batches):
            for b in batches:
                for raw in b.column("content").to_pylist():
                    p = contents.decode(raw)
                    whole = lambda v: np.floor(np.asarray(v, dtype=np.float64) + 0.5).astype(np.int64)
                    yield pa.RecordBatch.from_pydict({"x": whole(p["x"]), "z": whole(p["z"])} | {c: whole(p[c]) for c in "rgb"} | {"intensity": whole(p["INTENSITY"])})

        rows = made.mapInArrow(read, "x long, z long, r long, g long, b long, intensity long")
        return rows.groupBy(*"xzrgb").agg(F.count("*").alias("n"), F.sum("intensity").alias("intensity"))

    run.__name__ = f"tile_contents_{encoder.replace('-', '_')}"
    run.__doc__ = f"All points of all tiles as {encoder}, read back from the contents."
    return run


for _encoder in ("pnts", "glb", "glb-compressed", "glb-compressed-khr"):
    _linear = "floor(pow({0} / 255.0, 2.2) * 255)" if _encoder != "pnts" else "{0}"
    query(_VIRIDIS + _READ_BACK.format(*(_linear.format(c) for c in "rgb")))(_contents(_encoder))


_BOX = ", ".join(f"CAST(CAST(m{e}({a}) AS FLOAT) AS DOUBLE) AS {a}m{e}" for a in "xyz" for e in ("in", "ax"))


def _levels(spark: SparkSession, sf_dir: str, refine: str) -> DataFrame:
    """Of all tiles: points, box, whether each has as many points as its leaves' sizes say, and no point is in two of ADD."""
    leaves = Workspace(spark, "rules").keep(_leaves(spark, sf_dir, 2_500), "leaves")
    want = kd.tile_counts({r["leaf"]: r["n"] for r in leaves.groupBy("leaf").agg(F.count("*").alias("n")).collect()}, refine)  # a row for each tile
    own = stats.bounds(kd.bubble_up(spark, leaves, refine), "tile")
    each = spark.createDataFrame(list(want.items()), "tile string, want long")
    right = F.coalesce(F.col("n") == F.col("want"), F.lit(False)) | (F.col("n").isNull() & (F.col("want") == 0))
    box = [f(f"{a}{m}").cast("double").alias(f"{a}{m}") for a in "xyz" for f, m in ((F.min, "min"), (F.max, "max"))]
    return own.join(each, "tile", "full").agg(F.sum("n").alias("n"), F.bool_and(right).alias("as_planned"), *box)


@query(f"WITH {POINTS} SELECT count(*) AS n, true AS as_planned, {_BOX} FROM points")
def level_sizes(spark, sf_dir):
    """ADD: every point in one tile, as many as planned in each."""
    return _levels(spark, sf_dir, "ADD")


@query(f"WITH {POINTS} SELECT true AS as_planned, {_BOX} FROM points")
def level_sizes_replace(spark, sf_dir):
    """REPLACE: a tile has a copy of half of its children's points."""
    return _levels(spark, sf_dir, "REPLACE").drop("n")


@query(f"WITH {POINTS} SELECT CAST(ceil(count(*) / 5000.0) AS BIGINT) AS leaves, count(*) AS n, true AS balanced FROM points")
def sampled_plan(spark, sf_dir):
    """The leaves of a plan from a sample, and whether none has over twice its share (positions repeat, and go to one side)."""
    p = points(spark, sf_dir)
    leaves = kd.leaf_count(p.count(), 2_500)
    sizes = kd.plan(p, leaves, IDS, 20_000).routed(p.select(*"xyz")).groupBy("leaf").agg(F.count("*").alias("n"))
    return sizes.agg(F.count("*").alias("leaves"), F.sum("n").alias("n"), (F.max("n") <= 2 * F.sum("n") / F.count("*")).alias("balanced"))


_CHAIN = "WITH a AS (SELECT count(*) AS n0 FROM lineitem WHERE l_returnflag = 'R'), b AS (SELECT n0, CAST(floor(n0 * 0.66) AS BIGINT) AS t1 FROM a), c AS (SELECT *, CAST(floor((n0 - t1) * 0.66) AS BIGINT) AS t2 FROM b)"


def _root(spark, sf_dir) -> tuple[DataFrame, list[int]]:
    p = points(spark, sf_dir).filter("l_returnflag = 'R'").withColumn("point_id", F.xxhash64(*IDS, "x", "y", "z"))
    n = p.count()
    return p, [int(n * kd.SELECTED), int((n - int(n * kd.SELECTED)) * kd.SELECTED)]


@query(f"{_CHAIN} SELECT CAST(0 AS INTEGER) AS chain, n0 - t1 - t2 AS n FROM c UNION ALL SELECT 1, t1 FROM c UNION ALL SELECT 2, t2 FROM c")
def detail_chain(spark, sf_dir):
    """How many points of a root go to the tiles that are inserted below it."""
    p, takes = _root(spark, sf_dir)
    return kd.insert_chain(p, takes).groupBy("chain").agg(F.count("*").alias("n"))


@query(f"{_CHAIN} SELECT CAST(0 AS INTEGER) AS chain, n0 - t1 - t2 AS n FROM c UNION ALL SELECT 1, n0 FROM c UNION ALL SELECT 2, n0 - t1 FROM c")
def detail_chain_replace(spark, sf_dir):
    p, _ = _root(spark, sf_dir)
    n = p.count()
    return kd.insert_chain(p, [n, n - int(n * kd.SELECTED)], "REPLACE").groupBy("chain").agg(F.count("*").alias("n"))


_NODES = _TWO_LEVELS + f", b AS (SELECT leaf, {_LEAVES} FROM l2 GROUP BY leaf)"


def _index(spark, sf_dir) -> dict[str, str]:
    """The index of a tree of two levels, two tiles to a file."""
    rows = {r["leaf"]: r.asDict() | {"path": r["leaf"]} for r in kd.leaf_stats(_routed(spark, sf_dir)).collect()}  # a row for each leaf
    for path in {p[:i] for p in rows for i in range(1, len(p))}:
        below = [r for p, r in rows.items() if p.startswith(path) and len(p) == 3]
        rows[path] = {"path": path, "n": 1, "error": max(r["error"] for r in below)} | {f"{a}{m}": f(r[f"{a}{m}"] for r in below) for a in "xyz" for m, f in (("min", min), ("max", max))}
    return tileset.index_files(tileset.tree(list(rows.values()), "glb"), 2)


def _tiles_of(files: dict[str, str], name: str = "tileset.json") -> list[dict]:
    out = []

    def walk(node: dict) -> None:
        uri = node.get("content", {}).get("uri", "")
        if uri.endswith(".json"):
            out.extend(_tiles_of(files, uri))
        else:
            out.append(node)
        for child in node.get("children", ()):
            walk(child)

    walk(json.loads(files[name])["root"])
    return out


def _side(a: str) -> str:
    s = f"pow(10.0, CASE WHEN {a}max > {a}min THEN least(9, greatest(0, 6 - floor(log10({a}max - {a}min)))) ELSE 9 END)"
    low, high = f"(floor({a}min * {s}) / {s})", f"(ceil({a}max * {s}) / {s})"
    return f"round(({low} + {high}) / 2, 9) AS c{a}, round(({high} - {low}) / 2, 9) AS h{a}"


@query(
    _NODES
    + f", t AS (SELECT unnest([leaf, left(leaf, 2), left(leaf, 1)]) AS path, * FROM b), g AS (SELECT path, min(xmin) AS xmin, max(xmax) AS xmax, min(ymin) AS ymin, max(ymax) AS ymax, min(zmin) AS zmin, max(zmax) AS zmax FROM t GROUP BY path) SELECT 'data' || regexp_replace(substring(path, 2), '(.)', '/\\1', 'g') || '/content.glb' AS uri, {', '.join(map(_side, 'xyz'))} FROM g"
)
def index_boxes(spark, sf_dir):
    """Contents and boxes of all tiles, from an index that is split over several files."""
    found = _tiles_of(_index(spark, sf_dir))
    rows = [(n["content"]["uri"], *(round(v, 9) for i in range(3) for v in (n["boundingVolume"]["box"][i], n["boundingVolume"]["box"][3 + 4 * i]))) for n in found]
    return spark.createDataFrame(rows, "uri string, " + ", ".join(f"c{a} double, h{a} double" for a in "xyz"))


@query(
    _NODES
    + ", e AS (SELECT leaf, 4 * sqrt(((xmax-xmin)*(ymax-ymin) + (xmax-xmin)*(zmax-zmin) + (ymax-ymin)*(zmax-zmin)) / n) AS e FROM b), t AS (SELECT unnest([leaf, left(leaf, 2), left(leaf, 1)]) AS path, e FROM e) SELECT path, CAST(printf('%.4e', max(e)) AS DOUBLE) AS error FROM t GROUP BY path"
)
def index_errors(spark, sf_dir):
    """Errors as they stand in the index."""
    rows = [("0" + n["content"]["uri"].removeprefix("data").removesuffix("/content.glb").replace("/", ""), n["geometricError"]) for n in _tiles_of(_index(spark, sf_dir))]
    return spark.createDataFrame(rows, "path string, error double")


_ATTRIBUTES = ["intensity", "l_tax", "x"]


@query(f"WITH {POINTS} " + " UNION ALL ".join(f"SELECT '{v}' AS version, '{a.upper()}' AS name, CAST(min({a}) AS DOUBLE) AS low, CAST(max({a}) AS DOUBLE) AS high FROM points" for v in ("1.0", "1.1") for a in _ATTRIBUTES))
def index_ranges(spark, sf_dir):
    """Ranges of attributes as both versions of the index say them."""
    ranges = [r.asDict() for r in stats.attribute_ranges(points(spark, sf_dir), _ATTRIBUTES).collect()]
    rows = [("1.0", name, p["minimum"], p["maximum"]) for name, p in tileset.range_metadata(ranges, "1.0")[0].items()]
    values = tileset.range_metadata(ranges, "1.1")[1]["metadata"]["properties"]
    rows += [("1.1", k.removeprefix("MIN_"), v, values["MAX_" + k.removeprefix("MIN_")]) for k, v in values.items() if k.startswith("MIN_")]
    return spark.createDataFrame(rows, "version string, name string, low double, high double")


@query("SELECT replace(s_name, '#', '-') AS name, md5(s_name || ' of ' || s_nationkey) AS md5 FROM supplier")
def archive_entries(spark, sf_dir):
    """Files that tasks wrote, packed into one archive and found there by its index."""
    ws = Workspace(spark, "archive")
    root, target = ws.root, f"{ws.root}/out.3tz"

    def put(batches):
        for b in batches:
            for entry, text in zip(b.column("entry").to_pylist(), b.column("text").to_pylist(), strict=True):
                if text is not None:
                    write(f"{root}/in/{entry}", text.encode())
            yield b.select(["name", "entry"])

    nation = F.col("s_nationkey").cast("string")
    name = F.replace("s_name", F.lit("#"), F.lit("-"))
    t = table(spark, sf_dir, "supplier").select(name.alias("name"), F.concat(nation, F.lit("/"), name).alias("entry"), F.concat("s_name", F.lit(" of "), nation).alias("text"))
    t = t.repartition(spark.sparkContext.defaultParallelism)  # a file for each row is written, however few bytes the table has
    names = ws.keep(t.mapInArrow(put, "name string, entry string"), "names")
    tileset.package(f"{root}/in", target)

    def find(batches):
        with File(target) as f:
            archive = tileset.Entries(f.read, f.size)
            for b in batches:
                found = archive.find(b.column("entry").to_pylist())
                yield pa.RecordBatch.from_pydict({"name": b.column("name"), "content": pa.array(found, pa.binary())})

    return names.mapInArrow(find, "name string, content binary").select("name", F.md5("content").alias("md5"))


def _packed(version: int):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)

        def turn(batches):
            make, read = (meshopt.encode, meshopt.decode) if version == 0 else (meshopt.encode_1, meshopt.decode_1)
            for b in batches:
                rows = np.stack([b.column(c).to_numpy().astype("<i4") for c in ("k", "size", "price", "suppliers")], axis=1)
                back = read(make(rows.view("u1").reshape(len(rows), 16)), len(rows), 16)
                out = np.ascontiguousarray(back).view("<i4").reshape(-1, 4)
                yield pa.RecordBatch.from_arrays([pa.array(out[:, i].astype(np.int64)) for i in range(4)], names=["k", "size", "price", "suppliers"])

        t = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("long").alias("k"), F.col("p_size").cast("long").alias("size"), F.round(F.col("p_retailprice") * 100).cast("long").alias("price"), (F.col("p_partkey") % 4 - 2).cast("long").alias("suppliers"))
        return t.mapInArrow(turn, "k long, size long, price long, suppliers long")

    run.__name__, run.__doc__ = f"packed_stream_{version}", f"Records through the stream codec, version {version}, and back."
    return run


for _version in (0, 1):
    query("SELECT CAST(p_partkey AS BIGINT) AS k, CAST(p_size AS BIGINT) AS size, CAST(round(p_retailprice * 100) AS BIGINT) AS price, CAST(p_partkey % 4 - 2 AS BIGINT) AS suppliers FROM part")(_packed(_version))


# ---------------------------------------------------------------- choosing and colouring


@query("SELECT least(1000, count(*)) AS n, true AS distinct_rows FROM lineitem")
def bounded_sample(spark, sf_dir):
    got = sample.sample_rows(table(spark, sf_dir, "lineitem"), 1000, IDS)
    return got.agg(F.count("*").alias("n"), (F.countDistinct(*IDS) >= F.count("*") * 0.99).alias("distinct_rows"))


@query("SELECT true AS near_the_share, true AS has_the_first, true AS of_the_table")
def subsample_rules(spark, sf_dir):
    """A share of the rows, of which the first always is one."""
    t = table(spark, sf_dir, "lineitem")
    got = sample.subsample(t, 0.3, IDS)
    first = t.agg(F.min(F.struct(*IDS)).alias("f"))
    n, whole = got.count(), t.count()
    kept = got.join(first, F.struct(*IDS) == F.col("f"), "left_semi").count()
    strange = got.select(*IDS).join(t.select(*IDS), IDS, "left_anti").count()
    return spark.createDataFrame([(abs(n - 0.3 * whole) < 5 * (0.21 * whole) ** 0.5 + 1, kept > 0, strange == 0)], "near_the_share boolean, has_the_first boolean, of_the_table boolean")


@query(
    f"""WITH {POINTS}, q AS (SELECT quantile_cont(intensity, 0.02) AS lo, quantile_cont(intensity, 0.98) AS hi FROM points), c AS (SELECT {_ramp_sql(colour.GRADIENTS["heat"], "((intensity - lo) / (hi - lo))")} FROM points, q) SELECT r, g, b, count(*) AS n FROM c GROUP BY ALL"""
)
def colour_observed(spark, sf_dir):
    """Colours over a range that is observed first: between the second and the ninety-eighth hundredth."""
    p = points(spark, sf_dir).withColumns({c: F.lit(255).cast("short") for c in "rgb"})
    out = transforms.Colouring.parse("intensity:heat").apply(p)
    return out.groupBy(*(F.col(c).cast("int").alias(c) for c in "rgb")).agg(F.count("*").alias("n"))


@query("SELECT c_custkey, CAST(c_acctbal AS FLOAT) AS z FROM customer WHERE c_custkey % 50 <> 0 AND c_custkey % 7 <> 0")
def filter_pipeline(spark, sf_dir):
    """Points that have a finite position and aren't withheld."""
    k = F.col("c_custkey")
    p = table(spark, sf_dir, "customer").select("c_custkey", F.when(k % 50 == 0, float("nan")).otherwise(1.0).alias("x"), F.lit(0.0).alias("y"), F.col("c_acctbal").cast("float").alias("z"), (k % 7 == 0).alias("withheld"))
    return transforms.pipeline(p, [transforms.finite_positions, transforms.drop_withheld]).select("c_custkey", "z")


def _splats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as splats."""
    k = F.col("c_custkey")
    u = lambda n: F.pmod(F.xxhash64("c_custkey", F.lit(n)), F.lit(1_000_003)) / 1_000_003.0
    q = [u(i) - 0.5 for i in range(4)]
    norm = F.sqrt(sum((v * v for v in q), F.lit(1e-9)))
    out = table(spark, sf_dir, "customer").select(
        k.alias("source_index"),
        *((u(10 + i) * s).alias(f"c{a}") for i, (a, s) in enumerate(zip("xyz", (80.0, 40.0, 0.5), strict=True))),
        *((v / norm).alias(n) for v, n in zip(q, ("qw", "qx", "qy", "qz"), strict=True)),
        *((u(20 + i) * 0.05 + 0.01).alias(f"s{a}") for i, a in enumerate("xyz")),
        u(30).alias("opacity"),
        *((u(40 + i) - 0.5).alias(f"sh0_{c}") for i, c in enumerate("rgb")),
    )
    return out.withColumn("sh_rest", F.array().cast("array<struct<r:double,g:double,b:double>>"))


def _merged_scene(spark, sf_dir):
    return splats.build(spark, splats.prepared(_splats(spark, sf_dir), 0.05, 0), 500)


@query("SELECT true AS leaves_have_all, true AS boxes_lie_within, true AS errors_grow, true AS halves, true AS names_are_paths")
def splat_tree(spark, sf_dir):
    """The tiles of a splat scene: what holds of all of them."""
    ready = splats.prepared(_splats(spark, sf_dir), 0.05, 0)
    tiles_, nodes = _merged_scene(spark, sf_dir)
    by, held = {n["path"]: n for n in nodes}, {r["tile"]: r["n"] for r in tiles_.groupBy("tile").agg(F.count("*").alias("n")).collect()}  # a row for each tile
    inner = [n for n in nodes if n["kids"]]
    kids = [(n, by[k]) for n in inner for k in n["kids"]]
    leaves = sum(n["n"] for n in nodes if not n["kids"]) == ready.count() and held == {p: n["n"] for p, n in by.items()}
    boxes = all(n[f"{a}min"] <= k[f"{a}min"] and n[f"{a}max"] >= k[f"{a}max"] for n, k in kids for a in "xyz")
    errors = all(n["error"] >= 1.001 * k["error"] and n["error"] > 0 for n, k in kids)
    halves = all(n["n"] <= sum(by[k]["n"] for k in n["kids"]) // 2 + len(n["kids"]) for n in inner)
    return spark.createDataFrame([(leaves, boxes, errors, halves, all(k["path"].startswith(n["path"]) for n, k in kids))], "leaves_have_all boolean, boxes_lie_within boolean, errors_grow boolean, halves boolean, names_are_paths boolean")


# ---------------------------------------------------------------- splats


@query(f"WITH {_PART_SPLATS} SELECT CAST(k AS BIGINT) AS source_index, round(o, 6) AS opacity FROM w WHERE o >= 0.3")
def splat_filter(spark, sf_dir):
    return rounded(splats.prepared(part_splats(spark, sf_dir), 0.3, 0).select(F.col("source_index").cast("long").alias("source_index"), "opacity"), 6, "opacity")


def _in_arrays(df: DataFrame, by: str | None, f, schema: str) -> DataFrame:
    """f of the splats of each group, or of each batch."""
    ship(df.sparkSession)
    if by:
        return df.groupBy(by).applyInArrow(lambda t: f(t.column(by)[0].as_py(), splats.as_arrays(t.sort_by("source_index"))), schema)

    def run(batches):
        for b in batches:
            yield from f(None, splats.as_arrays(pa.Table.from_batches([b]))).to_batches()

    return df.mapInArrow(run, schema)


@query(f"WITH {_PART_SPLATS} SELECT cluster, round(min(x - 3 * sx), 9) AS xmin, round(max(x + 3 * sx), 9) AS xmax, round(min(y - 3 * sy), 9) AS ymin, round(max(z + 3 * sz), 9) AS zmax, round(sum(w), 6) AS weight FROM w GROUP BY cluster")
def splat_boxes(spark, sf_dir):
    """Boxes out to three standard deviations, and weights."""

    def f(cluster, s):
        low, high = splats.reach(s)
        return pa.table({"cluster": [cluster], "xmin": [low[0]], "xmax": [high[0]], "ymin": [low[1]], "zmax": [high[2]], "weight": [float(merging.weights(s).sum())]})

    out = _in_arrays(part_splats(spark, sf_dir).withColumn("cluster", F.col("source_index") % 16), "cluster", f, "cluster long, xmin double, xmax double, ymin double, zmax double, weight double")
    return rounded(rounded(out, 9, "xmin", "xmax", "ymin", "zmax"), 6, "weight")


@query(f"WITH {_PART_SPLATS} SELECT cluster, true AS to_the_target, round(sum(ln(1 - o)), 6) AS transparency, min(k) AS first FROM w GROUP BY cluster")
def splat_simplified(spark, sf_dir):
    """Half as many splats, or more where none are near enough: the light that all let through and the first index stay the same."""

    def f(cluster, s):
        out = merging.simplify(s, len(s) // 2)
        return pa.table({"cluster": [cluster], "to_the_target": [len(s) // 2 <= len(out) < len(s) or not len(merging.neighbour_edges(s.centre, merging.merge_distance(s.centre, len(s) // 2)))], "transparency": [float(np.log1p(-out.opacity).sum())], "first": [int(out.index.min())]})

    p = part_splats(spark, sf_dir).withColumn("cluster", F.col("source_index") % 16)
    return rounded(_in_arrays(p, "cluster", f, "cluster long, to_the_target boolean, transparency double, first long"), 6, "transparency")


@query(f"WITH {_PART_SPLATS} SELECT CAST(k AS BIGINT) AS source_index, CAST(x AS DOUBLE) AS cx, round(-z, 9) + 0.0 AS cy, round(y, 9) AS cz, round((k % 3) ** 2 + (k % 4) ** 2 + (k % 5) ** 2, 6) AS energy FROM w")
def splat_turned(spark, sf_dir):
    """Splats of a scene with Y up turned to Z up; the energy of a band of harmonics stays."""
    k = F.col("source_index")
    sh = F.array(*(F.struct(*(v.cast("double").alias(c) for c in "rgb")) for v in (k % 3, k % 4, k % 5)))

    def f(_, s):
        out = merging.rotated(s, splats.UP["y"])
        return pa.table({"source_index": out.index, "cx": out.centre[:, 0].copy(), "cy": out.centre[:, 1].copy(), "cz": out.centre[:, 2].copy(), "energy": (out.sh[:, :, 0] ** 2).sum(axis=1)})

    p = part_splats(spark, sf_dir).withColumn("sh_rest", sh)
    return rounded(rounded(_in_arrays(p, None, f, "source_index long, cx double, cy double, cz double, energy double"), 9, "cx", "cy", "cz"), 6, "energy")


@query(
    f"WITH {_PART_SPLATS} SELECT CAST(k AS BIGINT) AS source_index, floor(x * 4096 + 0.5) / 4096 AS cx, floor(y * 4096 + 0.5) / 4096 AS cy, round(floor(o * 255 + 0.5) / 255, 6) AS opacity, round(exp(floor((ln(sx) + 10) * 16 + 0.5) / 16 - 10), 6) AS sx, round((floor(red * 0.15 * 255 + 128) / 255 - 0.5) / 0.15, 6) AS red FROM w"
)
def splat_payload(spark, sf_dir):
    """Splats through their compressed payload and back, in the steps that it has."""

    def f(_, s):
        out = spz.decode(spz.encode(s.centre, s.quaternion, s.scale, s.opacity, s.sh0))
        return pa.table({"source_index": s.index, "cx": out["xyz"][:, 0].copy(), "cy": out["xyz"][:, 1].copy(), "opacity": out["opacity"], "sx": out["scale"][:, 0].copy(), "red": out["colour"][:, 0].copy()})

    return rounded(_in_arrays(part_splats(spark, sf_dir), None, f, "source_index long, cx double, cy double, opacity double, sx double, red double"), 6, "opacity", "sx", "red")


@query(f"""WITH {POINTS} SELECT CASE WHEN y < 30.0 THEN '00' WHEN x < 25.0 THEN '010' ELSE '011' END AS leaf, count(*) AS n, min(x) AS xmin, max(x) AS xmax, min(y) AS ymin, max(y) AS ymax, min(z) AS zmin, max(z) AS zmax FROM points GROUP BY ALL""")
def stream_leaf_counts(spark, sf_dir):
    """Counts and boxes of the leaves of a standing plan, from a stream."""
    plan = kd.Plan([kd.Node("0", "y", 30.0), kd.Node("00"), kd.Node("01", "x", 25.0), kd.Node("010"), kd.Node("011")])
    schema = spark.read.parquet(f"{sf_dir}/lineitem.parquet").schema
    arriving = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").parquet(_stream_path(spark, sf_dir, "lineitem"))
    p = arriving.select(F.col("l_quantity").cast("double").alias("x"), (F.col("l_extendedprice") / 1000).alias("y"), (F.col("l_discount") * 100).alias("z"))
    return _drained(spark, ingest.leaf_counts(p, plan))


@query(
    f"""WITH {POINTS}, q AS (SELECT quantile_cont(intensity, 0.02) AS lo, quantile_cont(intensity, 0.98) AS hi FROM points), c AS (SELECT {_ramp_sql(colour.GRADIENTS["viridis"].reverse(), "((intensity - lo) / (hi - lo))")} FROM points, q) SELECT r, g, b, count(*) AS n FROM c GROUP BY ALL"""
)
def stream_coloured(spark, sf_dir):
    """A stream coloured over the range of its first batch, which here is all of it."""
    schema = spark.read.parquet(f"{sf_dir}/lineitem.parquet").schema
    arriving = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").parquet(_stream_path(spark, sf_dir, "lineitem"))
    white = {c: F.lit(255).cast("short") for c in "rgb"}
    p = arriving.select(F.col("l_extendedprice").alias("intensity")).withColumns(white)
    ws = Workspace(spark, "coloured")
    ingest.coloured(p, transforms.Colouring.parse("intensity:viridis:reverse"), f"{ws.root}/out", f"{ws.root}/checkpoint").awaitTermination()
    out = spark.read.parquet(f"{ws.root}/out")
    return out.groupBy(*(F.col(c).cast("int").alias(c) for c in "rgb")).agg(F.count("*").alias("n"))


@query(
    """SELECT CAST(date_trunc('hour', ts) AS TIMESTAMP) AS start, round(min(value), 6) AS min, round(max(value), 6) AS max, count(value) AS n FROM events GROUP BY 1"""
)
def stream_windowed_ranges(spark, sf_dir):
    """Range of a value by hour, from a stream."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    arriving = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").parquet(_stream_path(spark, sf_dir, "events"))
    out = _drained(spark, ingest.windowed_ranges(arriving, "ts", "value"))
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), F.round("min", 6).alias("min"), F.round("max", 6).alias("max"), "n")


def _stream_path(spark: SparkSession, sf_dir: str, name: str) -> str:
    """A folder that has the table alone: streams read folders, and a table may be a file among others."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{name}.parquet")
    if path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory():
        return f"{sf_dir}/{name}.parquet"
    ws = Workspace(spark, "stream")
    ws.keep(spark.read.parquet(f"{sf_dir}/{name}.parquet"), name)
    return f"{ws.root}/{name}"


def _drained(spark: SparkSession, df: DataFrame) -> DataFrame:
    """The result of a stream once it has read all there is: a row for each group."""
    name = f"drained_{uuid.uuid4().hex[:12]}"
    q = df.writeStream.outputMode("complete").format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name)

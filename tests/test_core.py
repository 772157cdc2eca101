"""The engine: plans, levels, statistics, colours, frames and the query catalogue."""

import math

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from lodestone import model, queries, queries_files, queries_rules, queries_sources  # noqa: F401
from lodestone.functions import colour, crs, frames
from lodestone.operators import knn, sample, stats, transforms, voxel
from lodestone.plans import kd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return c


def rows(df):
    def cell(v):
        if v is None or v is pd.NA or v != v:
            return "null"
        return str(v) if isinstance(v, (str, bool, pd.Timestamp)) else repr(float(v))

    return sorted(tuple(cell(v) for v in r) for r in df[sorted(df.columns)].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_matches_its_sql(spark, sf, duck, name):
    assert rows(queries.QUERIES[name](spark, sf).toPandas()) == rows(duck.sql(queries.ORACLE_SQL[name]).df())


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLE_SQL)))
def test_query_without_sql_gives_rows(spark, sf, name):
    df = queries.QUERIES[name](spark, sf)
    assert df.count() > 0 and len(set(df.columns)) == len(df.columns)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


# ---------------------------------------------------------------- plan and levels


def cloud(spark, xyz):
    return spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(xyz)], "point_id long, x double, y double, z double")


def test_sampled_plan_is_balanced(spark):
    xyz = np.random.default_rng(1).uniform(0, 10, (4000, 3))
    points = cloud(spark, xyz)
    plan = kd.plan(points, 8, ["point_id"], sample=1000)
    counts = [r["n"] for r in points.withColumn("leaf", plan.route()).groupBy("leaf").agg(F.count("*").alias("n")).collect()]
    assert len(counts) == 8 and sum(counts) == 4000 and max(counts) < 1.3 * 500


def shares(points, plan):
    return sorted(r["n"] for r in plan.routed(points).groupBy("leaf").agg(F.count("*").alias("n")).collect())


def test_odd_numbers_of_leaves_are_balanced(spark):
    points = cloud(spark, np.random.default_rng(4).uniform(0, 10, (3000, 3)))
    for leaves in (3, 5, 7):
        sizes = shares(points, kd.plan(points, leaves, ["point_id"]))
        assert len(sizes) == leaves and sizes[-1] < 1.02 * 3000 / leaves


def test_rows_on_a_split_count_on_the_side_they_go_to(spark):
    rng = np.random.default_rng(5)
    points = cloud(spark, np.stack([rng.choice([0, 0, 0, 0, 50], 4000), rng.integers(0, 3, 4000) * 20, rng.uniform(0, 1, 4000)], axis=1))
    sizes = shares(points, kd.plan(points, 16, ["point_id"]))
    assert len(sizes) == 16 and sizes[-1] < 1.5 * 250
    same = cloud(spark, [(1, 2, 3)] * 50)
    assert shares(same, kd.plan(same, 4, ["point_id"])) == [50]


def test_many_leaves_from_a_small_sample(spark):
    xyz = np.tile(np.random.default_rng(6).uniform(0, 10, (6000, 3)) ** 2, (5, 1))  # copies have ids of their own
    points = cloud(spark, xyz)
    for sample in (600, 2000):
        plan = kd.plan(points, 60, ["point_id"], sample)
        sizes = shares(points, plan)
        assert len(plan.leaves) == len(sizes) == 60 and sizes[-1] < 1.5 * 500
        assert plan.nodes == kd.plan(points.repartition(7), 60, ["point_id"], sample).nodes


def test_leaves_are_shared_by_counts():
    assert kd._shares({"00": 10, "01": 30, "1": 60}, 10) == {"00": 1, "01": 3, "1": 6}
    assert kd._shares({"00": 1, "01": 1, "1": 98}, 10) == {"00": 1, "01": 1, "1": 8}


def test_all_ways_of_routing_agree(spark, monkeypatch):
    xyz = np.random.default_rng(9).integers(0, 6, (2000, 3))  # many ties
    points = cloud(spark, xyz)
    plan = kd.plan(points, 40, ["point_id"])
    for i, n in enumerate(plan.nodes.values()):
        n.tie_left = i % 2 == 0
    by_case = {r["point_id"]: r["leaf"] for r in plan.routed(points).collect()}
    monkeypatch.setattr(kd, "CASES", 1)
    assert by_case == {r["point_id"]: r["leaf"] for r in plan.routed(points).collect()}
    assert by_case == {r["point_id"]: r["leaf"] for r in points.withColumn("leaf", plan.route()).collect()}


def test_ties_go_right(spark):
    plan = kd.Plan([kd.Node("0", "x", 1.0), kd.Node("00"), kd.Node("01", "y", 5.0), kd.Node("010"), kd.Node("011")])
    got = cloud(spark, [(0, 9, 0), (1, 4, 0), (1, 5, 0)]).select(plan.route().alias("leaf")).collect()
    assert [r["leaf"] for r in got] == ["00", "010", "011"]


@pytest.mark.parametrize("refine", ["ADD", "REPLACE"])
def test_levels_keep_the_points(spark, refine):
    xyz = np.random.default_rng(2).uniform(0, 10, (3000, 3))
    points = cloud(spark, xyz)
    plan = kd.plan(points, 5, ["point_id"])
    routed = points.withColumn("leaf", plan.route())
    leaves = {r["leaf"]: r["n"] for r in routed.groupBy("leaf").agg(F.count("*").alias("n")).collect()}
    placed = kd.bubble_up(spark, routed, refine)
    own = {r["tile"]: r["n"] for r in placed.groupBy("tile").agg(F.count("*").alias("n")).collect()}
    assert own == {k: n for k, n in kd.tile_counts(leaves, refine).items() if n}
    assert placed.select("point_id").distinct().count() == 3000
    if refine == "ADD":
        assert placed.count() == 3000
    nodes = kd.node_table(placed)
    by = {r["path"]: r for r in nodes}
    for r in nodes:
        if r["path"] != "0":
            parent = by[r["path"][:-1]]
            assert parent["error"] >= r["error"] * 1.01 and parent["xmin"] <= r["xmin"] and parent["zmax"] >= r["zmax"]


@pytest.mark.parametrize("refine", ["ADD", "REPLACE"])
def test_nodes_too_large_for_a_task_are_split_by_hash(spark, refine):
    xyz = [(1.0, 1.0, 1.0)] * 300 + [(float(i), 50.0, 0.0) for i in range(100)]
    p = cloud(spark, xyz).withColumn("point_id", F.monotonically_increasing_id())
    plan = kd.Plan([kd.Node("0", "y", 10.0), kd.Node("00"), kd.Node("01", "x", 50.0), kd.Node("010"), kd.Node("011")])
    routed = plan.routed(p)
    want = kd.tile_counts({"00": 300, "010": 50, "011": 50}, refine)
    for most in (40, 120, 10_000):
        got = kd.bubble_up(spark, routed, refine, most)
        assert {r["tile"]: r["n"] for r in got.groupBy("tile").agg(F.count("*").alias("n")).collect()} == want
        if refine == "ADD":
            assert got.select("point_id").distinct().count() == 400


def test_weighted_medians_of_many_values(spark):
    rng = np.random.default_rng(4)
    rows = [(int(g), float(v), float(w)) for g, v, w in zip(rng.integers(0, 3, 5000), rng.normal(size=5000) ** 3, rng.random(5000) - 0.1, strict=True)]
    df = spark.createDataFrame([*rows, (3, 7.0, 1.0), (4, 1.0, -1.0), (5, 2.0, 1.0), (5, 3.0, 1.0)], "g int, v double, w double")
    want = {}
    for g in range(3):
        mine = sorted((v, w) for i, v, w in rows if i == g and w > 0)
        run = np.cumsum([w for _, w in mine])
        want[g] = mine[int(np.searchsorted(run, run[-1] / 2))][0]
    for bins in (4, 1024):
        got = {r["g"]: r["weighted_median"] for r in stats.weighted_medians(df, "v", "w", "g", bins=bins).collect()}
        assert got == want | {3: 7.0, 5: 2.0}
    assert stats.weighted_medians(df.filter("g = 3"), "v", "w").first()[0] == 7.0


def test_voxel_choice_spreads_over_the_node():
    g = np.random.default_rng(3)
    xyz = np.sort(g.uniform((0, 0, 0), (100, 100, 2), (20_000, 3)), axis=0)
    xyz[:, 1:] = g.uniform((0, 0), (100, 2), (20_000, 2))
    up = voxel.choose(xyz, 10_000)
    assert len(up) == 10_000 and (np.diff(up) > 0).all()
    halves = np.histogram(xyz[up, 0], bins=10, range=(0, 100))[0]
    assert halves.min() > 850 and halves.max() < 1150
    assert voxel.choose(np.zeros((10, 3)), 4).tolist() == [0, 1, 2, 3]
    assert len(voxel.choose(xyz[:5], 9)) == 5 and len(voxel.choose(xyz, 0)) == 0


def test_detail_chain(spark):
    box = {"xmin": 0, "xmax": 10, "ymin": 0, "ymax": 10, "zmin": 0, "zmax": 10}
    takes = kd.detail_chain(1000, box)
    left = 1000 - sum(takes)
    assert takes[0] == 660 and 4 * math.sqrt(300 / left) >= stats.root_error(box)
    root = cloud(spark, np.zeros((1000, 3)))
    got = {r["chain"]: r["n"] for r in kd.insert_chain(root, takes).groupBy("chain").agg(F.count("*").alias("n")).collect()}
    assert got == {0: left, **dict(enumerate(takes, 1))}
    whole = kd.detail_chain(1000, box, "REPLACE")
    got = {r["chain"]: r["n"] for r in kd.insert_chain(root, whole, "REPLACE").groupBy("chain").agg(F.count("*").alias("n")).collect()}
    assert got == {0: left, **dict(enumerate(whole, 1))}


# ---------------------------------------------------------------- statistics


def test_rank_selection_narrows_down(spark):
    v = np.random.default_rng(4).integers(0, 3000, 20_000).astype(float)
    df = spark.createDataFrame([(float(x),) for x in v], "v double")
    s = np.sort(v)
    for rank in (0, 1, 9_999, 10_000, 19_999):
        assert stats.select_rank(df, "v", rank, gathered=50) == s[rank]
    assert stats.select_rank(df, "v", 20_000) is None
    assert stats.upper_median(spark.createDataFrame([(1.0,), (2.0,), (3.0,), (4.0,)], "v double"), "v") == 3.0


def test_medians_of_groups(spark):
    g = np.random.default_rng(10)
    rows = [("a" if i % 3 else "b", float(g.integers(0, 4000)), float(g.normal()), 7.0) for i in range(9000)]
    df = spark.createDataFrame(rows, "g string, x double, y double, z double")
    want = {k: sorted(r[c] for r in rows if r[0] == k)[sum(r[0] == k for r in rows) // 2] for k, c in (("a", 1), ("b", 2))}
    for gathered in (10, 10**6):
        assert stats.upper_medians(df, "g", {"a": "x", "b": "y"}, gathered) == want
    assert stats.upper_medians(df, "g", {"a": "z"}, 10) == {"a": 7.0}


def test_value_range(spark):
    f = lambda *v: stats.value_range(spark.createDataFrame([(float(x),) for x in v], "v double"), "v")
    assert f(3, 1, float("nan")) == (1, 3) and f(2) == (1.5, 2.5) and f() == (0, 1)
    assert f(*[5] * 50, 0, 9) == (0, 9)
    low, high = f(*range(1001))
    assert 15 <= low <= 25 and 975 <= high <= 985


def test_subsample(spark):
    df = cloud(spark, np.zeros((5000, 3)))
    got = [r["point_id"] for r in sample.subsample(df, 0.1, ["point_id"]).collect()]
    assert 0 in got and 380 < len(got) < 620
    assert sample.subsample(df, 1, ["point_id"]).count() == 5000
    with pytest.raises(ValueError):
        sample.subsample(df, 0, ["point_id"])


def test_neighbours_match_brute_force(spark):
    xyz = np.random.default_rng(5).uniform(0, 5, (200, 3))
    got = {(r["a"], r["b"]): r["rank"] for r in knn.grid_neighbours(cloud(spark, xyz), "point_id", 1.0).collect()}
    want = {}
    for a in range(200):
        d = ((xyz - xyz[a]) ** 2).sum(axis=1)
        near = [b for b in np.argsort(d, kind="stable") if b != a and d[b] <= 1]
        want |= {(a, int(b)): k for k, b in enumerate(near[:8], 1)}
    assert got == want


# ---------------------------------------------------------------- frames and colours


def test_known_earth_centred_point(spark):
    x, y, z = frames.to_ecef("EPSG:4326", F.lit(123.474003), F.lit(8.099314), F.lit(0.0))
    got = spark.range(1).select(x, y, z).first()
    assert tuple(got) == pytest.approx((-3483057.5277292132, 5267517.241803079, 892655.4197953615), abs=1e-6)


def test_projected_crs(spark):
    x, y, z = frames.to_ecef("32633", F.lit(500000.0), F.lit(0.0), F.lit(0.0))
    want = frames.to_ecef("EPSG:4979", F.lit(15.0), F.lit(0.0), F.lit(0.0))
    got = spark.range(1).select(x, y, z, *want).first()
    assert tuple(got[:3]) == pytest.approx(tuple(got[3:]), abs=1e-6)
    with pytest.raises(ValueError):
        frames.to_ecef("EPSG:2056", F.lit(0), F.lit(0), F.lit(0))


# worked examples of published guidance: system, longitude, latitude, east, north
EXAMPLES = [
    ("+proj=lcc +lat_1=28.383333333333333 +lat_2=30.283333333333333 +lat_0=27.833333333333333 +lon_0=-99 +x_0=609601.2192024384 +units=us-ft +ellps=clrk66", -96.0, 28.5, 2963503.91, 254759.80),
    ("+proj=stere +lat_0=-90 +lat_ts=-71 +lon_0=70 +x_0=6000000 +y_0=6000000", 120.0, -75.0, 7255380.79, 7053389.56),
    ("EPSG:3035", 5.0, 50.0, 3962799.45, 2999718.85),
    ("+proj=merc +lon_0=110 +k=0.997 +x_0=3900000 +y_0=900000 +ellps=bessel", 120.0, -3.0, 5009726.58, 569150.82),
    ("+proj=tmerc +lat_0=49 +lon_0=-2 +k=0.9996012717 +x_0=400000 +y_0=-100000 +ellps=airy", 0.5, 50.5, 577274.99, 69740.50),
    ("+proj=lcc +lat_1=18 +lat_0=18 +lon_0=-77 +k_0=1 +x_0=250000 +y_0=150000 +ellps=clrk66", -76.943683, 17.932167, 255966.58, 142493.51),
]


@pytest.mark.parametrize("name,lon,lat,east,north", EXAMPLES)
def test_published_examples(spark, name, lon, lat, east, north):
    c = crs.parsed(name)
    geo = crs.Crs("longlat", ellipsoid=c.ellipsoid)
    p = F.struct(F.lit(lon).alias("x"), F.lit(lat).alias("y"), F.lit(50.0).alias("z"))
    there = crs.through([*crs.to_earth(geo), *crs.from_earth(c)], p)
    row = spark.range(1).select(there.alias("p")).select("p.*").first()
    assert (row.x, row.y, row.z) == (pytest.approx(east, abs=0.05), pytest.approx(north, abs=0.05), pytest.approx(50, abs=1e-4))
    back = spark.range(1).select(crs.through([*crs.to_earth(c), *crs.from_earth(geo)], F.struct(F.lit(row.x).alias("x"), F.lit(row.y).alias("y"), F.lit(row.z).alias("z"))).alias("p")).select("p.*").first()
    assert (back.x, back.y) == (pytest.approx(lon, abs=1e-8), pytest.approx(lat, abs=1e-8))


def test_names_of_systems(spark):
    wkt = 'PROJCS["RGF93 / Lambert-93",GEOGCS["RGF93",DATUM["x",SPHEROID["GRS 1980",6378137,298.257222101]],PRIMEM["Greenwich",0],UNIT["degree",0.0174532925199433]],PROJECTION["Lambert_Conformal_Conic_2SP"],PARAMETER["latitude_of_origin",46.5],PARAMETER["central_meridian",3],PARAMETER["standard_parallel_1",49],PARAMETER["standard_parallel_2",44],PARAMETER["false_easting",700000],PARAMETER["false_northing",6600000],UNIT["metre",1]]'
    assert crs.parsed(wkt) == crs.parsed("EPSG:2154") == crs.parsed("+proj=lcc +lat_0=46.5 +lon_0=3 +lat_1=49 +lat_2=44 +x_0=700000 +y_0=6600000 +ellps=GRS80")
    assert crs.parsed(f'COMPD_CS["both",{wkt},VERT_CS["h",VERT_DATUM["d",2005],UNIT["metre",1]]]') == crs.parsed("EPSG:2154+5720")
    assert crs.parsed("+proj=utm +zone=33 +south") == crs.parsed("EPSG:32733") and crs.parsed("EPSG:25832+7837") == crs.parsed("25832")
    for bad in ("EPSG:2056", "+proj=somerc +lat_0=46", "+proj=lcc +ellps=nothing", "+proj=stere +lat_0=52", "PROJCS[]", "nonsense"):
        with pytest.raises(ValueError):
            crs.parsed(bad)
    frames.register_crs("site", lambda p: p.withColumn("x", F.col("x") + 7), lambda p: p.withColumn("x", F.col("x") - 7))
    p = spark.createDataFrame([(1.0, 2.0, 3.0)], "x double, y double, z double")
    assert frames.reprojected(p, "site").first().x == 8 and frames.projected(p, "site").first().x == -6
    with pytest.raises(ValueError):
        frames.register_crs("site", lambda p: p)


def test_placements():
    p = frames.placement()
    assert p.origin == (6378137.0, 0.0, 0.0)
    m = np.array(p.rotation)
    assert np.allclose(m @ [0, 0, 1], [1, 0, 0]) and np.allclose(m @ [1, 0, 0], [0, 1, 0]) and np.allclose(m @ [0, 1, 0], [0, 0, 1])
    north = frames.placement(lat=90)
    assert north.origin[2] == pytest.approx(6378137 * (1 - 1 / 298.257223563))
    assert np.allclose(np.array(frames.placement(heading=90).rotation) @ [0, 1, 0], m @ [1, 0, 0])
    assert np.allclose(np.array(frames.placement(up="y", scale=2).rotation) @ [0, 1, 0], 2 * m @ [0, 0, 1])
    for bad in ({"lat": 91}, {"lon": 181}, {"scale": -1}, {"up": "w"}, {"height": math.nan}):
        with pytest.raises(ValueError):
            frames.placement(**bad)


def test_local_frame_round_trip(spark):
    f = frames.local_frame(4_000_000.0, 1_000_000.0, 4_800_000.0)
    m = np.array(f.rotation)
    assert np.allclose(m.T @ m, np.eye(3)) and np.linalg.det(m) == pytest.approx(1)
    x, y, z = f.forward(*f.inverse(F.lit(4_000_010.0), F.lit(1_000_020.0), F.lit(4_800_030.0)))
    assert tuple(spark.range(1).select(x, y, z).first()) == pytest.approx((4_000_010, 1_000_020, 4_800_030), abs=1e-6)


def test_gradients(spark):
    assert len(colour.GRADIENTS) >= 36
    t = [-1.0, 0.0, 0.1, 0.33, 0.5, 0.999, 1.0, 2.0]
    df = spark.createDataFrame([(v,) for v in t], "t double")
    for name, g in colour.GRADIENTS.items():
        for h in (g, g.reverse(), g.steps(4)):
            got = df.select(*h.columns(F.col("t"))).collect()
            assert [tuple(r) for r in got] == [h.at(v) for v in t], name
    with pytest.raises(ValueError):
        colour.Gradient((0.0, 0.5), ((0, 0, 0), (1, 1, 1)))


def test_colouring_language():
    c = transforms.Colouring.parse("z:heat:reverse:steps=3:stretch=5,95:blend=0.5")
    assert (c.attribute, c.reverse, c.steps, c.stretch, c.blend) == ("z", True, 3, (5.0, 95.0), 0.5)
    assert transforms.Colouring.parse("z:heat:stretch=minmax").stretch is None
    for bad in ("z", "z:nothing", "z:heat:steps=0", "z:heat:blend=2", "z:heat:stretch=9,1", "z:heat:loud"):
        with pytest.raises(ValueError):
            transforms.Colouring.parse(bad)


def test_names_and_types(spark):
    assert model.requested(" Intensity , gps time,intensity") == ["intensity", "gpstime"] and model.requested("a,none") == []
    assert model.output_name("scan angle", "glb") == "_SCANANGLE" and model.output_name("a-b") == "A_B"
    a = spark.createDataFrame([(1, 2.0)], "p int, q double")
    b = spark.createDataFrame([(5,)], "p int")
    assert [tuple(r) for r in model.union_points([a, b]).collect()] == [(0, 1, 2.0), (1, 5, 0.0)]
    with pytest.raises(TypeError):
        model.union_points([a, spark.createDataFrame([("x",)], "p string")])
    with pytest.raises(ValueError):
        model.one_crs(["EPSG:1", None, "EPSG:2"])
    assert model.one_crs([None, "EPSG:1"]) == "EPSG:1"

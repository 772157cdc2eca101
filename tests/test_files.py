"""File formats, splats, whole tilings and streaming."""

import hashlib
import io
import json
import struct
import zipfile

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestone import cli, model, queries_files
from lodestone.operators import splats as S
from lodestone.plans import kd
from lodestone.plans import splats as P
from lodestone.sinks import clouds, meshopt, spz, tiles, tileset
from lodestone.sources import las, laz, ply
from lodestone.streaming import ingest
from lodestone.tiler import Options, process, tile_points

# ---------------------------------------------------------------- PLY


def write_ply(path, rows, form):
    """x, y, z double, rgb uchar, scalar_Intensity float, after an element of faces."""
    head = ["ply", f"format {form} 1.0", "comment made here", "element face 2", "property list uchar int vertex_indices", f"element vertex {len(rows)}"]
    head += [*(f"property double {a}" for a in "xyz"), *(f"property uchar {c}" for c in ("red", "green", "blue")), "property float scalar_Intensity", "end_header\n"]
    text = "\n".join(head).encode()
    if form == "ascii":
        body = b"3 0 1 2\n3 0 1 2\n" + "".join(" ".join(map(repr, r)) + "\n" for r in rows).encode()
    else:
        e = "<" if "little" in form else ">"
        body = struct.pack(f"{e}B3i", 3, 0, 1, 2) * 2 + b"".join(struct.pack(f"{e}3d3Bf", *r) for r in rows)
    path.write_bytes(text + body)
    return str(path)


ROWS = [(1.0, 2.0, 3.0, 10, 20, 30, 0.5), (float("nan"), 0.0, 0.0, 1, 1, 1, 1.0), (-4.5, 0.25, 8.0, 255, 0, 7, 2.5)]


@pytest.mark.parametrize("form", ["ascii", "binary_little_endian", "binary_big_endian"])
def test_ply_points(spark, tmp_path, form, monkeypatch):
    monkeypatch.setattr(ply, "ROWS", 2)
    df = ply.read_points(spark, write_ply(tmp_path / "a.ply", ROWS, form), ["intensity", "missing"])
    got = [tuple(r) for r in df.orderBy("pos").collect()]
    assert got == [(0, 0, 1.0, 2.0, 3.0, 10, 20, 30, 0.5), (0, 2, -4.5, 0.25, 8.0, 255, 0, 7, 2.5)]
    assert df.columns[-1] == "intensity" and model.attribute_type(df.schema["intensity"]) == "float32"


def test_short_and_wrong_ply(spark, tmp_path):
    path = write_ply(tmp_path / "a.ply", ROWS, "binary_little_endian")
    raw = open(path, "rb").read()
    open(path, "wb").write(raw[:-5])
    with pytest.raises(Exception, match="cut short"):
        ply.read_points(spark, path).count()
    (tmp_path / "b.ply").write_bytes(b"nothing")
    with pytest.raises(Exception, match="PLY"):
        ply.read_points(spark, str(tmp_path / "b.ply")).count()


def write_splats(path, n=50, degree=1, seed=1):
    g = np.random.default_rng(seed)
    rest = {0: 0, 1: 9, 2: 24, 3: 45}[degree]
    names = ["x", "y", "z", *(f"f_dc_{i}" for i in range(3)), *(f"f_rest_{i}" for i in range(rest)), "opacity", *(f"scale_{i}" for i in range(3)), *(f"rot_{i}" for i in range(4))]
    data = g.normal(size=(n, len(names))).astype("<f4")
    data[:, names.index("scale_0") : names.index("scale_0") + 3] -= 3
    head = "\n".join(["ply", "format binary_little_endian 1.0", f"element vertex {n}", *(f"property float {c}" for c in names), "end_header\n"])
    path.write_bytes(head.encode() + data.tobytes())
    return str(path), data, names


def test_splat_ply(spark, tmp_path):
    path, data, names = write_splats(tmp_path / "s.ply")
    got = ply.read_splats(spark, path).orderBy("source_index").toPandas()
    c = {n: data[:, i].astype(float) for i, n in enumerate(names)}
    assert np.allclose(got.opacity, 1 / (1 + np.exp(-c["opacity"]))) and np.allclose(got.sx, np.exp(c["scale_0"]))
    assert np.allclose(got.qw**2 + got.qx**2 + got.qy**2 + got.qz**2, 1)
    first = got.sh_rest[0]
    assert [x["r"] for x in first] == pytest.approx([data[0, names.index(f"f_rest_{k}")] for k in range(3)])
    assert [x["g"] for x in first] == pytest.approx([data[0, names.index(f"f_rest_{k}")] for k in range(3, 6)])
    with pytest.raises(ValueError, match="splats"):
        ply.read_points(spark, path)


# ---------------------------------------------------------------- LAS


def write_las(path, n=1000, form=3, extra=True, epsg=32633, seed=1):
    g = np.random.default_rng(seed)
    base = np.dtype(las.FORMATS[form])
    dtype = np.dtype(base.descr + ([("e", "<i2")] if extra else []))
    raw = np.zeros(n, dtype)
    raw["X"], raw["Y"], raw["Z"] = (g.integers(-50_000, 50_000, n) for _ in range(3))
    raw["intensity"] = g.integers(0, 4000, n)
    raw["returns"] = 2 | 3 << 3 if form < 6 else 2 | 3 << 4
    if form < 6:
        raw["class"] = g.integers(0, 12, n) | (np.arange(n) % 17 == 0) << 7
    else:
        raw["classification"], raw["flags"] = g.integers(0, 12, n), (np.arange(n) % 17 == 0) << 2
    for c in ("red", "green", "blue"):
        if c in dtype.names:
            raw[c] = g.integers(0, 65536, n)
    if extra:
        raw["e"] = np.arange(n) % 100
    vlrs = []

    def vlr(user, record, body):
        vlrs.append(struct.pack("<H16sHH32s", 0, user, record, len(body), b"") + body)

    if epsg:
        vlr(b"LASF_Projection", 34735, struct.pack("<12H", 1, 1, 0, 2, 1024, 0, 1, 1, 3072, 0, 1, epsg))
    if extra:
        d = bytearray(192)
        d[2], d[3] = 4, 24
        d[4:13] = b"My Height"
        struct.pack_into("<d", d, 112, 0.01)
        struct.pack_into("<d", d, 136, 100.0)
        vlr(b"LASF_Spec", 4, bytes(d))
    body = b"".join(vlrs)
    long = form >= 6
    size = 375 if long else 227
    head = bytearray(size)
    head[:4], head[24], head[25] = b"LASF", 1, 4 if long else 2
    struct.pack_into("<HIIBHI", head, 94, size, size + len(body), len(vlrs), form, dtype.itemsize, 0 if long else n)
    struct.pack_into("<6d", head, 131, 0.001, 0.001, 0.001, 500_000, 4_400_000, 120)
    if long:
        struct.pack_into("<Q", head, 247, n)
    path.write_bytes(bytes(head) + body + raw.tobytes())
    return str(path), raw


@pytest.mark.parametrize("form", sorted(las.FORMATS))
def test_las_points(spark, tmp_path, form, monkeypatch):
    monkeypatch.setattr(las, "ROWS", 300)
    path, raw = write_las(tmp_path / "a.las", form=form)
    names = ["intensity", "classification", "withheld", "return_number", "number_of_returns", "My Height", "nothing"]
    df = las.read_points(spark, path, names)
    got = df.orderBy("pos").toPandas()
    assert np.allclose(got.x, raw["X"] * 0.001 + 500_000) and (got.intensity == raw["intensity"]).all()
    assert (got.classification == (raw["class"] & 31 if form < 6 else raw["classification"])).all()
    assert (got.withheld == (np.arange(1000) % 17 == 0)).all() and (got.return_number == 2).all() and (got.number_of_returns == 3).all()
    assert np.allclose(got.myheight, np.arange(1000) % 100 * 0.01 + 100)
    assert (got.r == (raw["red"] >> 8 if "red" in raw.dtype.names else 255)).all()
    assert las.crs_of(path) == "EPSG:32633" and "nothing" not in df.columns


def test_las_folder_and_conflicts(spark, tmp_path):
    for i in range(3):
        write_las(tmp_path / f"{i}.las", 10, 0, i == 0, 32633 if i < 2 else None, i)
    df = las.read_points(spark, str(tmp_path), ["myheight"])
    assert df.count() == 30 and df.filter("myheight = 0").count() == 20 and las.crs_of(str(tmp_path)) == "EPSG:32633"
    write_las(tmp_path / "z.las", 10, 0, False, 3067)
    with pytest.raises(ValueError, match="several CRS"):
        las.crs_of(str(tmp_path))
    raw = (tmp_path / "0.las").read_bytes()
    (tmp_path / "short.las").write_bytes(raw[:-3])
    with pytest.raises(Exception, match="cut short"):
        las.read_points(spark, str(tmp_path / "short.las")).count()


def odd_records(form, n, extra, seed=3):
    g = np.random.default_rng(seed)
    r = np.zeros(n, np.dtype([*las.FORMATS[form], *([("e", f"S{extra}")] if extra else [])]))
    for name, (kind, _) in r.dtype.fields.items():
        if kind.kind in "iu":
            info = np.iinfo(kind)
            r[name] = g.integers(info.min, info.max, n, dtype=kind, endpoint=True) if n % 2 else np.cumsum(g.integers(-1, 2, n)).astype(kind)
    if "gps_time" in r.dtype.names:
        r["gps_time"] = 3e8 + np.cumsum(g.choice([0, 1e-4, 1e-4, 1e-4, 5e-4, -1e-4, 0.1, 100.0, -1e6, 1e7], n))
    if extra:
        r["e"] = [bytes(g.integers(1, 255, extra).astype("u1")) for _ in range(n)]
    return r


@pytest.mark.parametrize("form", range(4))
@pytest.mark.parametrize("n,extra", [(1, 0), (1, 3), (2001, 3), (2000, 0)])
def test_laz_round_trip(form, n, extra):
    raw = odd_records(form, n, extra)
    packing = laz.Packing(700, laz.items_of(form, raw.dtype.itemsize))
    assert laz.Packing.of(packing.body()) == packing
    made = b"\0" * 99 + laz.packed(raw.tobytes(), packing, 99)
    found = laz.chunks(lambda at, m: made[at : at + m], 99, len(made), n, packing)
    assert [c[:2] for c in found] == [(a, min(700, n - a)) for a in range(0, n, 700)]
    assert b"".join(laz.decoded(made[at : at + m], k, packing) for _, k, at, m in found) == raw.tobytes()


def test_laz_that_is_not_read(tmp_path, spark):
    raw = odd_records(1, 50, 0)
    (tmp_path / "a.laz").write_bytes(clouds.las_file(1, raw, chunk=20))
    assert las.read_points(spark, str(tmp_path / "a.laz"), ["gps_time"]).count() == 50
    body = bytearray((tmp_path / "a.laz").read_bytes())
    at = body.index(b"laszip encoded") + 52
    body[at] = 3  # layered
    (tmp_path / "b.laz").write_bytes(bytes(body))
    with pytest.raises(Exception, match="formats 0 to 3"):
        las.read_points(spark, str(tmp_path / "b.laz")).count()


def test_spellings_of_one_quantity():
    have = ["intensity", "echolength", "pulsewidth", "_incidenceangle"]
    assert las.sources(["echo_width", "pulse_width", "incidenceangle"], have) == {"echo_width": "echolength", "incidenceangle": "_incidenceangle"}
    for asked, names in las.ALIASES.items():
        for n in names:
            assert las.sources([asked], ["intensity", n]) == {asked: n}
    assert las.sources(["Pulse Width", "intensity"], have) == {"pulsewidth": "echolength", "intensity": "intensity"}
    with pytest.raises(TypeError, match="one file"):
        model.merged_types([{"a": "uint8"}, {"b": "int8", "a": "int16"}])


# ---------------------------------------------------------------- contents


def points_table(n=100, seed=1):
    g = np.random.default_rng(seed)
    return pa.table({"x": g.normal(size=n).astype("f4"), "y": g.normal(size=n).astype("f4"), "z": g.normal(size=n).astype("f4"), **{c: g.integers(0, 256, n).astype("i2") for c in "rgb"}, "intensity": g.integers(0, 60000, n).astype("i4"), "withheld": g.random(n) < 0.5, "tile": ["0"] * n})


ATTRIBUTES = [("intensity", "uint16"), ("withheld", "uint8")]


def test_pnts():
    t = points_table()
    raw = tiles.pnts(t, ATTRIBUTES)
    magic, version, size, fj, fb, bj, bb = struct.unpack_from("<4s6I", raw)
    assert magic == b"pnts" and version == 1 and size == len(raw) == 28 + fj + fb + bj + bb and len(raw) % 8 == 0
    assert all((28 + at) % 8 == 0 for at in (fj, fj + fb, fj + fb + bj))
    feature, batch = json.loads(raw[28 : 28 + fj]), json.loads(raw[28 + fj + fb : 28 + fj + fb + bj])
    at = 28 + fj
    assert np.allclose(np.frombuffer(raw, "<f4", 300, at).reshape(-1, 3)[:, 0], t["x"].to_numpy())
    assert (np.frombuffer(raw, "u1", 300, at + feature["RGB"]["byteOffset"]).reshape(-1, 3)[:, 2] == t["b"].to_numpy()).all()
    at = 28 + fj + fb + bj
    assert (np.frombuffer(raw, "<u2", 100, at + batch["INTENSITY"]["byteOffset"]) == t["intensity"].to_numpy()).all()
    assert (np.frombuffer(raw, "u1", 100, at + batch["WITHHELD"]["byteOffset"]) == t["withheld"].to_numpy(zero_copy_only=False)).all()


def parts(raw):
    magic, version, size = struct.unpack_from("<4sII", raw)
    assert magic == b"glTF" and version == 2 and size == len(raw)
    n = struct.unpack_from("<I", raw, 12)[0]
    return json.loads(raw[20 : 20 + n]), raw[28 + n :]


def test_glb():
    t = points_table()
    doc, body = parts(tiles.glb(t, ATTRIBUTES))
    assert np.allclose(np.frombuffer(body, "<f4", 400).reshape(-1, 4)[:, 1], t["y"].to_numpy())
    colour = np.frombuffer(body, "u1", 1600).reshape(-1, 16)[:, 12:]
    assert (colour[:, 3] == 255).all() and (colour[:, 0] == ((t["r"].to_numpy() / 255) ** 2.2 * 255).astype(int)).all()
    prim = doc["meshes"][0]["primitives"][0]
    a = doc["accessors"][prim["attributes"]["_INTENSITY"]]
    at = doc["bufferViews"][a["bufferView"]]["byteOffset"]
    assert (np.frombuffer(body, "<u2", 200, at)[::2] == t["intensity"].to_numpy()).all()
    assert doc["extensions"]["EXT_structural_metadata"]["schema"]["classes"]["point"]["properties"]["INTENSITY"]["componentType"] == "UINT16"


def test_compressed_glb():
    t = points_table(500)
    doc, body = parts(tiles.compressed_glb(t, ATTRIBUTES))
    e = doc["bufferViews"][0]["extensions"]["EXT_meshopt_compression"]
    q = meshopt.decode(body[e["byteOffset"] : e["byteOffset"] + e["byteLength"]], 500, 8).view("<u2")[:, :3] / 65535
    m = np.array(doc["nodes"][0]["matrix"]).reshape(4, 4).T
    got = np.c_[q, np.ones(500)] @ m.T
    want = np.stack([t["x"], t["z"], -t["y"].to_numpy()], axis=1)
    assert np.abs(got[:, :3] - want).max() < 1e-4


@pytest.mark.parametrize("stride,n", [(4, 1), (4, 1000), (8, 17), (16, 256), (16, 4097), (64, 300)])
def test_meshopt_round_trip(stride, n):
    g = np.random.default_rng(n)
    for data in (g.integers(0, 256, (n, stride)), np.zeros((n, stride)), np.cumsum(g.integers(-2, 3, (n, stride)), axis=0), np.cumsum(g.integers(-9, 9, (n, stride)), axis=0)):
        data = data.astype(np.uint8)
        raw = meshopt.encode(data)
        assert (meshopt.decode(raw, n, stride) == data).all()
        newer = meshopt.encode_1(data)
        assert (meshopt.decode_1(newer, n, stride) == data).all() and len(newer) <= len(raw) + stride
    with pytest.raises(ValueError):
        meshopt.encode(np.zeros((3, 5), np.uint8))


def random_splats(n=200, degree=2, seed=1, box=(10, 10, 10)):
    g = np.random.default_rng(seed)
    q = g.normal(size=(n, 4))
    return S.Splats(np.arange(n), g.uniform(0, 1, (n, 3)) * box, q / np.linalg.norm(q, axis=1, keepdims=True), g.uniform(0.01, 0.06, (n, 3)), g.uniform(0, 1, n), g.normal(size=(n, 3)) * 0.5, g.normal(size=(n, {0: 0, 1: 3, 2: 8, 3: 15}[degree], 3)) * 0.2)


@pytest.mark.parametrize("version", [2, 3])
def test_spz_round_trip(version):
    s = random_splats()
    out = spz.decode(spz.encode(s.centre, s.quaternion, s.scale, s.opacity, s.sh0, s.sh, version))
    assert np.abs(out["xyz"] - s.centre).max() <= 0.5 / 4096 and np.abs(out["opacity"] - s.opacity).max() < 0.003
    assert np.abs(np.log(out["scale"] / s.scale)).max() < 0.04 and np.abs(out["colour"] - s.sh0).max() < 0.02
    assert np.abs((out["quaternion"] * s.quaternion).sum(axis=1)).min() > 0.995 and np.abs(out["sh"] - s.sh).max() < 0.08


def test_positions_have_as_many_bits_as_fit():
    for most, bits in ((0.0, 12), (2047.99, 12), (2048.0, 11), (8388607.0, 0)):
        assert spz.fraction_bits(np.array([[most, 0, 0]])) == bits
    with pytest.raises(ValueError, match="from the origin"):
        spz.fraction_bits(np.array([[0, -8388608.0, 0]]))


def nodes(depth):
    paths = [""]
    for _ in range(depth):
        paths += [p + c for p in paths for c in "01"]
    rows = sorted({"0" + p for p in paths})
    return [{"path": p, "n": 5, "error": 10.0 / len(p), **{f"{a}{m}": v for a in "xyz" for m, v in (("min", 0.1234567), ("max", 9.87654321))}} for p in rows]


def all_tiles(files, name="tileset.json"):
    import posixpath

    out = []

    def walk(node, base):
        uri = node.get("content", {}).get("uri", "")
        path = posixpath.normpath(posixpath.join(posixpath.dirname(base), uri))
        if uri.endswith(".json"):
            out.extend(all_tiles(files, path))
        elif uri:
            out.append(path)
        for c in node.get("children", []):
            walk(c, base)

    walk(json.loads(files[name])["root"], name)
    return out


@pytest.mark.parametrize("most", [1, 5, 16, 100, 2000])
def test_index_is_split_and_whole(most):
    files = tileset.index_files(tileset.tree(nodes(6), "glb"), most)
    assert list(files)[-1] == "tileset.json"
    assert sorted(all_tiles(files)) == sorted(tiles.content_path(r["path"], "glb") for r in nodes(6))
    count = lambda n: 1 + sum(map(count, n.get("children", [])))
    for text in files.values():
        own = json.loads(text)["root"]

        def mine(n):
            return (0 if n.get("content", {}).get("uri", "").endswith(".json") else 1) + sum(map(mine, n.get("children", [])))

        assert mine(own) <= max(most, 1)
    assert (len(files) == 1) == (most >= len(nodes(6)))


def test_boxes_reach_outward():
    box = tileset.box_json((0.1234567, 9.87654321, 0, 0, -1, 1))
    assert box[0] - box[3] <= 0.1234567 and box[0] + box[3] >= 9.87654321 and box[0] - box[3] > 0.123


def test_archive_finds_every_entry(tmp_path):
    files = {f"data/{i}.bin": bytes([i]) * i for i in range(30)} | {"tileset.json": b"{}"}
    raw = tileset.archive(files)
    assert all(tileset.find(raw, n) == d for n, d in files.items()) and tileset.find(raw, "nothing") is None
    for n, d in files.items():
        (tmp_path / "in" / n).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "in" / n).write_bytes(d)
    assert tileset.package(str(tmp_path / "in"), str(tmp_path / "out.3tz")) == 31
    assert tileset.find((tmp_path / "out.3tz").read_bytes(), "data/7.bin") == b"\x07" * 7


def test_archives_are_read_by_ranges():
    out, asked = io.BytesIO(), []
    z = tileset._Zip(out)
    names = [f"{i % 7}/{i}" for i in range(70_000)]  # more than a ZIP without ZIP64 counts
    for n in names:
        z.add(n, n.encode() * 3)
    entries = sorted((tileset.index_order(n), n, p) for n, *_, p in z.entries)
    z.add(tileset.INDEX, b"".join(hashlib.md5(n.encode()).digest() + struct.pack("<Q", p) for _, n, p in entries))
    z.close()
    raw = out.getvalue()
    archive = tileset.Entries(lambda at, n: asked.append(n) or raw[at : at + n], len(raw))
    opening = len(asked)
    assert archive.find(names[::-9]) == [n.encode() * 3 for n in names[::-9]]
    assert len(asked) - opening <= len(raw) // tileset.Entries.RUN + 1  # neighbours share a read
    del asked[:]
    assert archive.find([names[3], None, "nothing", names[-1], names[3]]) == [names[3].encode() * 3, None, None, names[-1].encode() * 3, names[3].encode() * 3]
    assert sum(asked) < 300
    with pytest.raises(ValueError):
        tileset.Entries(lambda at, n: raw[:-200][at : at + n], len(raw) - 200)


def test_files_are_packed_in_groups(tmp_path, monkeypatch):
    monkeypatch.setattr(tileset, "READ_AHEAD", 100)
    files = {f"{i:03d}": bytes([i]) * (i * 7 % 150) for i in range(200)}
    (tmp_path / "in").mkdir()
    for n, d in files.items():
        (tmp_path / "in" / n).write_bytes(d)
    assert tileset.package(str(tmp_path / "in"), str(tmp_path / "out.3tz")) == 200
    raw = (tmp_path / "out.3tz").read_bytes()
    assert all(tileset.find(raw, n) == d for n, d in files.items())
    with zipfile.ZipFile(tmp_path / "out.3tz") as found:
        assert found.testzip() is None and found.namelist() == [*sorted(files), tileset.INDEX]


def test_archive_entries_of_one_name(spark, tmp_path):
    rows = [("S#1", 3), ("S#1", 4), ("S#1", 3), ("S#2", 3), (None, 1), ("S#3", None)]
    spark.createDataFrame(rows, "s_name string, s_nationkey int").coalesce(1).write.parquet(f"{tmp_path}/supplier.parquet")
    got = [tuple(r) for r in queries_files.archive_entries(spark, str(tmp_path)).collect()]
    digest = lambda n, k: None if n is None or k is None else hashlib.md5(f"{n} of {k}".encode()).hexdigest()
    assert sorted(got, key=str) == sorted(((n and n.replace("#", "-"), digest(n, k)) for n, k in rows), key=str)


# ---------------------------------------------------------------- splats


def routed_sizes(spark, plan, xyz):
    points = spark.createDataFrame([tuple(map(float, p)) for p in xyz], "x double, y double, z double")
    return sorted(r["n"] for r in plan.routed(points).groupBy("leaf").agg(F.count("*").alias("n")).collect())


def test_splats_on_a_split_are_planned_where_they_go(spark):
    rng = np.random.default_rng(3)
    xyz = np.stack([rng.integers(1, 6, 6000), rng.integers(0, 120, 6000) / 10, rng.integers(0, 7, 6000)], axis=1).astype(float)
    plan = P.plan_sample(xyz, rng.uniform(0.1, 0.6, 6000), 6000, 50)
    sizes = routed_sizes(spark, plan, xyz)
    assert sum(sizes) == 6000 and sizes[-1] <= 50 and len(sizes) == len(plan.leaves) and sum(sizes) / len(sizes) >= 20
    part = rng.permutation(6000)[:3000]
    sizes = routed_sizes(spark, P.plan_sample(xyz[part], np.ones(3000), 6000, 50), xyz)
    assert sizes[-1] <= 100


def test_splats_without_weight_are_split_too(spark):
    xyz = np.repeat([[0.1, 0.1, 0.1], [5.0, 0.1, 0.1], [0.1, 7.0, 0.1]], [40, 30, 30], axis=0)
    for weight in (np.zeros(100), np.r_[np.ones(40), np.zeros(60)], np.full(100, np.nan)):
        assert routed_sizes(spark, P.plan_sample(xyz, weight, 100, 40), xyz) == [30, 30, 40]
    assert P.plan_sample(xyz[:40], np.ones(40), 40, 10).leaves == ["0"]  # all coincide


def test_merging_keeps_moments():
    s = random_splats(2, 1)
    s.scale[:] = 0.05
    m = S.merged(s, np.array([[0, 1]]))
    w = S.weights(s)
    p = w / w.sum()
    mean = p @ s.centre
    cov = sum(p[i] * (S.covariances(s.quaternion, s.scale)[i] + np.outer(s.centre[i] - mean, s.centre[i] - mean)) for i in range(2))
    assert np.allclose(m.centre[0], mean) and np.allclose(S.covariances(m.quaternion, m.scale)[0], cov)
    assert m.opacity[0] == pytest.approx(1 - np.prod(1 - s.opacity)) and m.index[0] == 0
    assert np.array_equal(m.sh[0], s.sh[w.argmax()])


def test_flat_splats_stay_flat():
    s = random_splats(2, 0)
    s.quaternion[:], s.scale[:], s.opacity[:] = (1, 0, 0, 0), (0.5, 0.5, 0.01), 1
    s.centre[:] = (0, 0, 0), (0.3, 0, 0.2)
    m = S.merged(s, np.array([[0, 1]]))
    assert m.scale[0].min() == pytest.approx(0.02)


def test_simplify_reaches_its_target_and_is_steady():
    s = random_splats(3000, 0, box=(4, 4, 0.1))
    out = S.simplify(s, 1500)
    assert len(out) == 1500 and (np.diff(out.index) > 0).all()
    again = S.simplify(random_splats(3000, 0, box=(4, 4, 0.1)), 1500)
    assert np.array_equal(out.centre, again.centre)
    far = random_splats(4, 0, box=(1, 1, 1))
    far.centre[:] = np.array([[0, 0, 0], [100, 0, 0], [0, 100, 0], [0, 0, 100]])
    assert len(S.simplify(far, 1)) == 4
    copies = random_splats(2, 0).take(np.zeros(64, dtype=int))
    copies.index[:] = np.arange(64)
    assert len(S.simplify(copies, 32)) == 32


def test_edges_match_brute_force():
    c = np.random.default_rng(6).uniform(0, 3, (300, 3))
    want = set()
    for a in range(300):
        d = ((c - c[a]) ** 2).sum(axis=1)
        near = [b for b in np.argsort(d, kind="stable") if b != a and d[b] <= 0.25][:8]
        want |= {(min(a, b), max(a, b)) for b in map(int, near)}
    assert {tuple(e) for e in S.neighbour_edges(c, 0.5).tolist()} == want


def test_turned_harmonics():
    s, g = random_splats(5, 3), np.random.default_rng(7)
    turn = S.matrices(np.array([[0.5, 0.5, -0.1, 0.7]]) / np.linalg.norm([0.5, 0.5, -0.1, 0.7]))[0]
    r = S.rotated(s, turn)
    d = g.normal(size=(20, 3))
    d /= np.linalg.norm(d, axis=1, keepdims=True)
    before, after = np.einsum("dk,nkc->ndc", S.sh_basis(d), s.sh), np.einsum("dk,nkc->ndc", S.sh_basis(d @ turn.T), r.sh)
    assert np.allclose(before, after)
    assert np.allclose(S.covariances(r.quaternion, r.scale), turn @ S.covariances(s.quaternion, s.scale) @ turn.T)


def test_splat_scene(spark, tmp_path):
    s = random_splats(6000, 1, box=(80, 40, 0.5))
    s.centre += (4.5e6, 1e5, 50)
    df = spark.createDataFrame(pa.table(P.as_table(s)).to_pandas(), ply.read_splats(spark, write_splats(tmp_path / "t.ply")[0]).schema)
    out = P.tile_splats(spark, df, str(tmp_path / "out"), per_tile=1000, degree=1)
    assert out["kept"] == 6000 and out["tiles"] >= 11
    index = json.loads((tmp_path / "out/tileset.json").read_text())

    def walk(n, parent=None):
        assert (tmp_path / "out" / n["content"]["uri"]).exists()
        if parent:
            assert parent["geometricError"] >= n["geometricError"] * 1.0009
            for i in range(3):
                a, b = n["boundingVolume"]["box"], parent["boundingVolume"]["box"]
                assert abs(a[i] - b[i]) + a[3 + 4 * i] <= b[3 + 4 * i] + 1e-3
        for c in n.get("children", []):
            walk(c, n)

    walk(index["root"])
    tiles_, rows = P.build(spark, df, 1000)
    own = {r["tile"]: r["n"] for r in tiles_.groupBy("tile").agg(F.count("*").alias("n")).collect()}
    assert own == {r["path"]: r["n"] for r in rows}
    for r in rows:
        if r["kids"]:
            assert r["n"] <= sum(own[k] for k in r["kids"]) / 2 + 1.5
    assert sum(own[r["path"]] for r in rows if not r["kids"]) == 6000


def test_coincident_splats_keep_their_leaf(spark):
    s = random_splats(600, 0)
    s.centre[:300] = (1, 1, 1)
    df = spark.createDataFrame(pa.table(P.as_table(s)).to_pandas(), "source_index long, cx double, cy double, cz double, qw double, qx double, qy double, qz double, sx double, sy double, sz double, opacity double, sh0_r double, sh0_g double, sh0_b double, sh_rest array<struct<r:double,g:double,b:double>>")
    _, rows = P.build(spark, df, 100)
    assert sum(r["n"] for r in rows if not r["kids"]) == 600 and max(r["n"] for r in rows if not r["kids"]) >= 300


# ---------------------------------------------------------------- whole tilings


def test_tiling_a_las_folder(spark, tmp_path):
    for i in range(2):
        write_las(tmp_path / f"in{i}.las", 12_000, 3, True, 32633, i)
    for encoder in ("pnts", "glb", "glb-compressed"):
        seen = []
        options = Options(points_per_tile=5_000, encoder=encoder, attributes=["intensity", "classification"], colouring="z:viridis", progress=lambda phase, facts: seen.append(phase))
        out = process(spark, [str(tmp_path / f"in{i}.las") for i in range(2)], str(tmp_path / encoder), options=options)
        assert seen == ["read", "planned", "written"] and out["points"] == 24_000 - 2 * (12_000 // 17 + 1)
        index = json.loads((tmp_path / encoder / "tileset.json").read_text())
        assert index["asset"]["version"] == ("1.0" if encoder == "pnts" else "1.1") and len(index["root"]["transform"]) == 16
        ending = "pnts" if encoder == "pnts" else "glb"
        found = all_tiles({"tileset.json": json.dumps(index)})
        assert len(found) == out["tiles"] == len(list((tmp_path / encoder).rglob(f"*.{ending}")))
        if encoder == "pnts":
            n = sum(json.loads(raw[28 : 28 + struct.unpack_from("<I", raw, 12)[0]])["POINTS_LENGTH"] for raw in (p.read_bytes() for p in (tmp_path / encoder).rglob("*.pnts")))
            assert n == out["points"] and index["properties"]["INTENSITY"]["maximum"] <= 3999


def test_command_line(spark, tmp_path, capsys):
    write_las(tmp_path / "a.las", 3_000, 2, False, None)
    out = cli.main(["pcloud", str(tmp_path / "a.las"), "--out", str(tmp_path / "o"), "--crs", "32633", "--refine", "replace", "--archive", str(tmp_path / "o.3tz"), "--colorize", "classification:las-classification"])
    assert out["points"] == 3_000 - 177 and tileset.find((tmp_path / "o.3tz").read_bytes(), "tileset.json")
    write_splats(tmp_path / "s.ply")
    assert cli.main(["splats", str(tmp_path / "s.ply"), "--out", str(tmp_path / "p"), "--lon", "10", "--lat", "50"])["tiles"] == 1
    tileset.move_root(str(tmp_path / "p"), np.eye(4).T.reshape(-1).tolist())
    assert json.loads((tmp_path / "p/tileset.json").read_text())["root"]["transform"][0] == 1
    with pytest.raises(ValueError):
        tileset.move_root(str(tmp_path / "p"), [1.0] * 16)
    with pytest.raises(SystemExit):
        cli.main(["pcloud", "x", "--out", "y", "--lon", "3"])


def test_options_are_checked(spark):
    for bad in ({"points_per_tile": 1}, {"refine": "x"}, {"encoder": "x"}, {"error_factor": 0}, {"subsample": 0}, {"tiles_per_file": 0}):
        with pytest.raises(ValueError):
            Options(**bad).check()
    with pytest.raises(ValueError, match="CRS"):
        tile_points(spark, spark.createDataFrame([(0, 0, 1.0, 1.0, 1.0)], "file_id int, pos long, x double, y double, z double"), None, "/tmp/none")


# ---------------------------------------------------------------- streaming


def test_a_stream_keeps_the_range_of_its_first_batch(spark, tmp_path):
    from lodestone.operators.transforms import Colouring

    kind = "x double, r short, g short, b short"
    put = lambda name, rows: spark.createDataFrame([(float(x), 255, 255, 255) for x in rows], kind).write.parquet(f"{tmp_path}/in/{name}")
    put("a", range(0, 11))
    run = lambda: ingest.coloured(spark.readStream.schema(kind).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in"), Colouring.parse("x:grayscale:stretch=minmax"), f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination()
    run()
    put("b", [-5, 5, 100])
    run()
    got = {r.x: r.r for r in spark.read.parquet(f"{tmp_path}/out").filter("batch = 1").collect()}
    assert json.loads((tmp_path / "check/colour-range.json").read_text()) == [0.0, 10.0] and got[-5.0] == 0 and got[100.0] == 255 and 120 < got[5.0] < 135


def test_streamed_points(spark, sf, tmp_path):
    schema = "point_id long, x double, y double, z double"
    xyz = np.random.default_rng(8).uniform(0, 10, (1000, 3))
    rows = [(i, *map(float, p)) for i, p in enumerate(xyz)]
    points = spark.createDataFrame(rows, schema)
    points.repartition(4).write.parquet(str(tmp_path / "in"))
    plan = kd.plan(points, 4, ["point_id"])
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = ingest.append_routed(stream, plan, str(tmp_path / "out"), str(tmp_path / "ck"))
    assert q.awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1000
    q = ingest.leaf_counts(stream, plan).writeStream.outputMode("complete").format("memory").queryName("leaves").trigger(availableNow=True).start()
    assert q.awaitTermination(60)
    got = {r["leaf"]: r["n"] for r in spark.table("leaves").collect()}
    assert got == {r["leaf"]: r["n"] for r in points.withColumn("leaf", plan.route()).groupBy("leaf").agg(F.count("*").alias("n")).collect()}
    events = spark.read.parquet(f"{sf}/events.parquet")
    ranges = ingest.windowed_ranges(events, "ts", "value")
    assert ranges.agg(F.sum("n")).first()[0] == events.filter("value is not null").count()

"""Queries over files that tasks write from the tables: what the sources read is compared with the tables themselves."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .job import Workspace
from .queries import query, rounded, table
from .sinks import clouds
from .sources import e57, geotiff, las, ply
from .storage import write

EACH = 100_000  # rows of a file


def _files(spark: SparkSession, rows: DataFrame, kinds: list[str], ending: str, make: Callable[[str, dict[str, np.ndarray]], bytes], each: int | None = EACH) -> str:
    """A folder with a file for each kind, of all rows in order of k; with more than ``each`` rows there are several of each."""
    ws = Workspace(spark, "files")
    folder = f"{ws.root}/files"

    def run(t: pa.Table) -> pa.Table:
        kind, part = t.column("kind")[0].as_py(), t.column("part")[0].as_py()
        t = t.sort_by("k")
        write(f"{folder}/{part:06d}-{kind}.{ending}", make(kind, {c: t.column(c).to_numpy(zero_copy_only=False) for c in t.column_names}))
        return pa.table({"kind": [kind]})

    dealt = rows.withColumn("part", (F.floor(F.col("k") / each) if each else F.lit(0)).cast("int")).withColumn("kind", F.explode(F.array(*map(F.lit, kinds))))
    dealt.groupBy("kind", "part").applyInArrow(run, "kind string").write.format("noop").mode("overwrite").save()
    return folder


def _parts(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").cast("long").alias("k"), F.col("p_size").cast("long").alias("s"), F.round(F.col("p_retailprice") * 100).cast("long").alias("p"))


_P = "p AS (SELECT CAST(p_partkey AS BIGINT) AS k, CAST(p_size AS BIGINT) AS s, CAST(round(p_retailprice * 100) AS BIGINT) AS p FROM part)"


# ---------------------------------------------------------------- LAS

_KEY = [("Key", "uint32", None, None), ("form", "uint8", None, None)]
_FORMS = [str(f) for f in sorted(las.FORMATS)]


def _las(kind: str, t: dict[str, np.ndarray], extra=_KEY, chunk: int | None = None) -> bytes:
    form, k, s = int(kind), t["k"], t["s"]
    r = clouds.las_records(form, len(k), extra)
    r["X"], r["Y"], r["Z"], r["intensity"], r["extra:Key"] = s * 25, t["p"], k % 97 - 48, k * 31 % 65536, k
    r["user_data"], r["point_source_id"] = k % 256, k * 7 % 65536
    if "extra:form" in r.dtype.names:
        r["extra:form"] = form
    bit = lambda n, at: ((k // n % 2) << at).astype(np.uint8)
    if form < 6:
        r["returns"] = (k % 5 + 1) | 5 << 3 | bit(2, 6) | bit(3, 7)
        r["class"] = (k % 32).astype(np.uint8) | bit(5, 5) | bit(7, 6) | bit(11, 7)
        r["scan_angle_rank"] = k % 181 - 90
    else:
        r["returns"] = (k % 15 + 1) | (15 << 4)
        r["flags"] = bit(5, 0) | bit(7, 1) | bit(11, 2) | bit(13, 3) | (k % 4 << 4).astype(np.uint8) | bit(2, 6) | bit(3, 7)
        r["classification"], r["scan_angle_raw"] = k % 256, k % 60001 - 30000
    for n, v in (("gps_time", k * 0.5), ("red", k * 37 % 65536), ("green", k * 41 % 65536), ("blue", k * 43 % 65536), ("nir", k * 47 % 65536), ("wave_packet_size", k * 3), ("wave_return_location", s * 0.5)):
        if n in r.dtype.names:
            r[n] = v
    return clouds.las_file(form, r, 0.01, (500_000.0, 4_400_000.0, 120.0), extra, 32633, chunk)


def _las_points(spark, sf_dir, *names: str) -> DataFrame:
    return las.read_points(spark, _files(spark, _parts(spark, sf_dir), _FORMS, "las", _las), ["key", "form", *names]).drop("file_id", "pos")


_EVERY_FORM = f"WITH {_P}, f AS (SELECT p.*, CAST(form AS SMALLINT) AS form, form >= 6 AS long, form IN (2, 3, 5, 7, 8, 10) AS rgb FROM p, range(0, 11) t(form))"


@query(
    f"""{_EVERY_FORM} SELECT k AS key, form, CAST(s * 0.25 + 500000 AS DOUBLE) AS x, round(p / 100 + 4400000, 2) AS y, round((k % 97 - 48) / 100 + 120, 2) AS z,
CAST(CASE WHEN rgb THEN k * 37 % 65536 // 256 ELSE 255 END AS SMALLINT) AS r, CAST(CASE WHEN rgb THEN k * 41 % 65536 // 256 ELSE 255 END AS SMALLINT) AS g, CAST(CASE WHEN rgb THEN k * 43 % 65536 // 256 ELSE 255 END AS SMALLINT) AS b,
CAST(k * 31 % 65536 AS INTEGER) AS intensity, CAST(CASE WHEN long THEN k % 256 ELSE k % 32 END AS SMALLINT) AS classification FROM f"""
)
def las_formats(spark, sf_dir):
    """Positions, colours, intensity and class from all point formats."""
    return rounded(_las_points(spark, sf_dir, "intensity", "classification"), 2, "x", "y", "z")


@query(
    f"""{_EVERY_FORM} SELECT k AS key, form, CAST(CASE WHEN long THEN k % 15 + 1 ELSE k % 5 + 1 END AS SMALLINT) AS return_number, CAST(CASE WHEN long THEN 15 ELSE 5 END AS SMALLINT) AS number_of_returns,
k // 5 % 2 = 1 AS synthetic, k // 7 % 2 = 1 AS key_point, k // 11 % 2 = 1 AS withheld, long AND k // 13 % 2 = 1 AS overlap, CAST(CASE WHEN long THEN k % 4 ELSE 0 END AS SMALLINT) AS scanner_channel, k // 2 % 2 = 1 AS scan_direction_flag, k // 3 % 2 = 1 AS edge_of_flight_line FROM f"""
)
def las_flags(spark, sf_dir):
    """Returns and flags from the bit fields of both layouts."""
    names = ["return_number", "number_of_returns", "synthetic", "key_point", "withheld", "overlap", "scanner_channel", "scan_direction_flag", "edge_of_flight_line"]
    return _las_points(spark, sf_dir, *names).select("key", "form", *names)


@query(
    f"""{_EVERY_FORM} SELECT k AS key, form, round(CAST(CASE WHEN long THEN (k % 60001 - 30000) * 0.006 ELSE k % 181 - 90 END AS DOUBLE), 4) AS scan_angle, CAST(k % 256 AS SMALLINT) AS user_data, CAST(k * 7 % 65536 AS INTEGER) AS point_source_id,
CAST(CASE WHEN form IN (0, 2) THEN 0 ELSE k * 0.5 END AS DOUBLE) AS gps_time, CAST(CASE WHEN form IN (8, 10) THEN k * 47 % 65536 ELSE 0 END AS INTEGER) AS nir, CASE WHEN form IN (4, 5, 9, 10) THEN k * 3 ELSE 0 END AS wave_packet_size, CAST(CASE WHEN form IN (4, 5, 9, 10) THEN s * 0.5 ELSE 0 END AS FLOAT) AS wave_return_location FROM f"""
)
def las_fields(spark, sf_dir):
    """The other fields, zero where a format lacks them."""
    names = ["scan_angle", "user_data", "point_source_id", "gps_time", "nir", "wave_packet_size", "wave_return_location"]
    return rounded(_las_points(spark, sf_dir, *names).select("key", "form", *names), 4, "scan_angle")


@query(
    f"""{_EVERY_FORM} SELECT k AS key, form, CAST(s * 0.25 + 500000 AS DOUBLE) AS x, round(p / 100 + 4400000, 2) AS y, round((k % 97 - 48) / 100 + 120, 2) AS z, CAST(CASE WHEN rgb THEN k * 41 % 65536 // 256 ELSE 255 END AS SMALLINT) AS g,
CAST(k * 31 % 65536 AS INTEGER) AS intensity, CAST(k % 32 AS SMALLINT) AS classification, CAST(k % 5 + 1 AS SMALLINT) AS return_number, k // 11 % 2 = 1 AS withheld, CAST(k % 181 - 90 AS DOUBLE) AS scan_angle, CAST(k * 7 % 65536 AS INTEGER) AS point_source_id, CAST(CASE WHEN form IN (1, 3) THEN k * 0.5 ELSE 0 END AS DOUBLE) AS gps_time FROM f WHERE form < 4"""
)
def laz_formats(spark, sf_dir):
    """Compressed files, chunk by chunk."""
    folder = _files(spark, _parts(spark, sf_dir), ["0", "1", "2", "3"], "laz", lambda kind, t: _las(kind, t, chunk=700))
    names = ["key", "form", "intensity", "classification", "return_number", "withheld", "scan_angle", "point_source_id", "gps_time"]
    return rounded(las.read_points(spark, folder, names).select(*names, "x", "y", "z", "g"), 2, "x", "y", "z")


_TYPED = [("Key", "uint32", None, None), *((f"as {t}", t, None, None) for t in ("uint8", "int8", "uint16", "int16", "uint32", "int32", "int64", "float32", "float64")), ("Scaled", "int16", 0.5, 100.0), ("Shifted", "uint8", None, 7.0)]


def _las_extra(kind: str, t: dict[str, np.ndarray]) -> bytes:
    k = t["k"]
    r = clouds.las_records(0, len(k), _TYPED)
    r["extra:Key"] = k
    for name, kind_, *_ in _TYPED[1:10]:
        r[f"extra:{name}"] = k % 120 - (60 if kind_[0] == "i" else 0) + (0.25 if kind_[0] == "f" else 0)
    r["extra:Scaled"], r["extra:Shifted"] = k % 1000 - 500, k % 200
    return clouds.las_file(0, r, 1.0, (0.0, 0.0, 0.0), _TYPED)


@query(
    f"""WITH {_P} SELECT k AS key, CAST(k % 120 AS SMALLINT) AS asuint8, CAST(k % 120 - 60 AS TINYINT) AS asint8, CAST(k % 120 AS INTEGER) AS asuint16, CAST(k % 120 - 60 AS SMALLINT) AS asint16, k % 120 AS asuint32, CAST(k % 120 - 60 AS INTEGER) AS asint32, k % 120 - 60 AS asint64,
CAST(k % 120 + 0.25 AS FLOAT) AS asfloat32, CAST(k % 120 + 0.25 AS DOUBLE) AS asfloat64, CAST((k % 1000 - 500) * 0.5 + 100 AS DOUBLE) AS scaled, CAST(k % 200 + 7 AS DOUBLE) AS shifted FROM p"""
)
def las_extra_bytes(spark, sf_dir):
    """Extra dimensions of every type, plain, scaled and shifted."""
    names = ["key", "asuint8", "asint8", "asuint16", "asint16", "asuint32", "asint32", "asint64", "asfloat32", "asfloat64", "scaled", "shifted"]
    return las.read_points(spark, _files(spark, _parts(spark, sf_dir), ["0"], "las", _las_extra), names).select(*names)


_SPELT = {"a": ("Pulse Width", "IncidenceAngle"), "b": ("EchoWidth", "True View Incidence Angle"), "c": ("Echo length", "_IncidenceAngle"), "d": ("Other", "Another")}


def _las_spelt(kind: str, t: dict[str, np.ndarray]) -> bytes:
    width, angle = _SPELT[kind]
    extra = [("Key", "uint32", None, None), ("which", "uint8", None, None), (width, "uint16", None, None), (angle, "float32", None, None)]
    r = clouds.las_records(1, len(t["k"]), extra)
    r["extra:Key"], r["extra:which"], r[f"extra:{width}"], r[f"extra:{angle}"] = t["k"], ord(kind), t["k"] % 500, t["s"] * 0.5
    return clouds.las_file(1, r, 1.0, (0.0, 0.0, 0.0), extra)


@query(
    f"""WITH {_P} SELECT k AS key, CAST(w AS SMALLINT) AS which, CAST(CASE WHEN w < 100 THEN k % 500 ELSE 0 END AS INTEGER) AS pulse_width, CAST(CASE WHEN w < 100 THEN s * 0.5 ELSE 0 END AS FLOAT) AS incidenceangle FROM p, range(97, 101) t(w)"""
)
def las_spellings(spark, sf_dir):
    """One quantity under the names of several vendors, asked for by one name."""
    folder = _files(spark, _parts(spark, sf_dir), list(_SPELT), "las", _las_spelt)
    return las.read_points(spark, folder, ["key", "which", "pulse_width", "incidenceangle"]).select("key", "which", "pulse_width", "incidenceangle")


def _las_mixed(kind: str, t: dict[str, np.ndarray]) -> bytes:
    extra = [("Key", "uint32", None, None), ("early", "int16", None, None) if kind == "a" else ("late", "float64", None, None)]
    r = clouds.las_records(0, len(t["k"]), extra)
    r["extra:Key"], r[f"extra:{extra[1][0]}"] = t["k"], t["s"]
    return clouds.las_file(0, r, 1.0, (0.0, 0.0, 0.0), extra)


@query(f"WITH {_P} SELECT k AS key, CAST(s AS SMALLINT) AS early, CAST(0 AS DOUBLE) AS late FROM p UNION ALL SELECT k, CAST(0 AS SMALLINT), CAST(s AS DOUBLE) FROM p")
def las_folder(spark, sf_dir):
    """A folder whose files have unlike attributes."""
    return las.read_points(spark, _files(spark, _parts(spark, sf_dir), ["a", "b"], "las", _las_mixed), ["key", "early", "late"]).select("key", "early", "late")


# ---------------------------------------------------------------- PLY


def _ply(kind: str, t: dict[str, np.ndarray]) -> bytes:
    k, s = t["k"], t["s"]
    x = np.where(k % 50 == 0, np.nan, s * 0.25)
    colours = {"ascii": ("uint8", k % 256), "binary_little_endian": ("uint16", k * 37 % 65536), "binary_big_endian": ("float32", k % 101 / 100)}[kind]
    form = {"ascii": 0, "binary_little_endian": 1, "binary_big_endian": 2}[kind]
    return clouds.ply_file(kind, {"x": ("float64", x), "y": ("float64", t["p"] / 100), "z": ("float32", k % 97 * 0.5), "red": colours, "green": colours, "blue": colours, "scalar_Key": ("uint32", k), "scalar_form": ("uint8", np.full(len(k), form)), "normal_x": ("float32", s * 0.125), "scalar_Intensity": ("uint16", k % 65536)})


@query(
    f"""WITH {_P} SELECT k AS key, CAST(form AS SMALLINT) AS form, CAST(s * 0.25 AS DOUBLE) AS x, p / 100 AS y, CAST(k % 97 * 0.5 AS DOUBLE) AS z, CAST(CASE form WHEN 0 THEN k % 256 WHEN 1 THEN k * 37 % 65536 // 256 ELSE floor(CAST(CAST(k % 101 / 100 AS FLOAT) AS DOUBLE) * 255 + 0.5) END AS SMALLINT) AS r,
CAST(s * 0.125 AS FLOAT) AS nx, CAST(k % 65536 AS INTEGER) AS intensity FROM p, range(0, 3) t(form) WHERE k % 50 <> 0"""
)
def ply_points(spark, sf_dir):
    """Vertices in all three encodings, colours of three types, and attributes under other names; points that aren't finite go."""
    out = None
    for kind in ("ascii", "binary_little_endian", "binary_big_endian"):  # colours of unlike types don't go into one folder
        one = ply.read_points(spark, _files(spark, _parts(spark, sf_dir), [kind], "ply", _ply), ["key", "form", "nx", "intensity"])
        out = one if out is None else out.unionByName(one)
    return out.select("key", "form", "x", "y", "z", "r", "nx", "intensity")


def _ply_mixed(kind: str, t: dict[str, np.ndarray]) -> bytes:
    own = {"red": ("uint8", t["k"] % 200), "late": ("float32", t["s"])} if kind == "b" else {"early": ("int32", t["s"])}
    return clouds.ply_file("binary_little_endian", {"x": ("float32", t["s"]), "y": ("float32", t["s"]), "z": ("float32", t["s"]), "Key": ("uint32", t["k"])} | own)


@query(f"WITH {_P} SELECT k AS key, CAST(255 AS SMALLINT) AS r, CAST(s AS INTEGER) AS early, CAST(0 AS FLOAT) AS late FROM p UNION ALL SELECT k, CAST(k % 200 AS SMALLINT), 0, CAST(s AS FLOAT) FROM p")
def ply_folder(spark, sf_dir):
    """A folder whose files have unlike properties; points of the file without colours are white."""
    return ply.read_points(spark, _files(spark, _parts(spark, sf_dir), ["a", "b"], "ply", _ply_mixed), ["key", "early", "late"]).select("key", "r", "early", "late")


def _ply_splats(kind: str, t: dict[str, np.ndarray]) -> bytes:
    k, s, f = t["k"], t["s"], "float64"
    p = {"x": (f, s * 0.5), "y": (f, t["p"] / 1000), "z": (f, k % 10)} | {f"f_dc_{i}": (f, (k % 7 - 3) * (i + 1) / 10) for i in range(3)}
    p |= {f"f_rest_{i}": (f, (k % 5) * 0.01 * i) for i in range(9)}
    p |= {"opacity": (f, np.where(k % 40 == 0, np.nan, k % 9 - 4))} | {f"scale_{i}": (f, -(k % 4 + i)) for i in range(3)}
    return clouds.ply_file("binary_little_endian", p | {"rot_0": (f, np.where(k % 30 == 1, 0, 1 + k % 3))} | {f"rot_{i}": (f, np.where(k % 30 == 1, 0, k % 3 * i)) for i in (1, 2, 3)})


@query(
    f"""WITH {_P}, q AS (SELECT *, 1 + k % 3 AS w, k % 3 AS u, sqrt((1 + k % 3) ** 2 + 14 * (k % 3) ** 2) AS n FROM p WHERE k % 40 <> 0 AND k % 30 <> 1)
SELECT CAST(s * 0.5 AS DOUBLE) AS cx, round(p / 1000, 6) AS cy, round(w / n, 6) AS qw, round(u / n, 6) AS qx, round(3 * u / n, 6) AS qz, round(exp(-(k % 4 + 1)), 9) AS sy, round(1 / (1 + exp(-(k % 9 - 4))), 9) AS opacity, round((k % 7 - 3) * 3 / 10, 6) AS sh0_b,
CAST(3 AS INTEGER) AS harmonics, round(CAST((k % 5) * 0.01 * 4 AS DOUBLE), 6) AS second_green FROM q"""
)
def ply_splats(spark, sf_dir):
    """Splats: unit quaternions, scales from logarithms, opacities from logits, harmonics by channel; those not finite or without a rotation go."""
    out = ply.read_splats(spark, _files(spark, _parts(spark, sf_dir), ["a"], "ply", _ply_splats))
    out = out.select("cx", "cy", "qw", "qx", "qz", "sy", "opacity", "sh0_b", F.size("sh_rest").alias("harmonics"), F.col("sh_rest")[1]["g"].alias("second_green"))
    return rounded(rounded(out, 6, "cy", "qw", "qx", "qz", "sh0_b", "second_green"), 9, "sy", "opacity")


# ---------------------------------------------------------------- E57


def _e57(kind: str, t: dict[str, np.ndarray]) -> bytes:
    k, s, n = t["k"], t["s"], len(t["k"])
    I, R = clouds.e57_integers, clouds.e57_floats  # noqa: N806
    first = [R("cartesianX", s * 0.5), R("cartesianY", t["p"] / 64, True), I("cartesianZ", k % 1000 - 500, -500, 500, 0.001), I("cartesianInvalidState", (k % 20 == 0) * 2, 0, 2)]
    first += [I(f"color{c}", k * m % 1024, 0, 1023) for c, m in (("Red", 1), ("Green", 3), ("Blue", 7))]
    first += [I("intensity", k * 5 % 2048, 0, 2047), I("Key", k, 0, 1 << 31), I("rowIndex", np.full(n, 7), 7, 7)]
    second = [R("sphericalRange", s * 1.0), R("sphericalAzimuth", k % 4 * (np.pi / 2)), R("sphericalElevation", np.zeros(n)), I("Key", k, 0, 1 << 31), R("deviation", s * 0.25)]
    limits = '<intensityLimits type="Structure"><intensityMinimum type="Float">0</intensityMinimum><intensityMaximum type="Float">4094</intensityMaximum></intensityLimits>'
    return clouds.e57_file([(first, n, limits), (second, n, clouds.e57_pose(np.pi / 2, (100.0, 0.0, 5.0)))])


def _e57_points(spark, sf_dir, *names: str) -> DataFrame:
    return e57.read_points(spark, _files(spark, _parts(spark, sf_dir), ["a"], "e57", _e57), ["key", *names])


@query(
    f"""WITH {_P} SELECT k AS key, 0 AS scan, CAST(s * 0.5 AS DOUBLE) AS x, CAST(CAST(p / 64 AS FLOAT) AS DOUBLE) AS y, round((k % 1000 - 500) / 1000, 4) AS z FROM p WHERE k % 20 <> 0
UNION ALL SELECT k, 1, round(100 - s * CASE k % 4 WHEN 1 THEN 1 WHEN 3 THEN -1 ELSE 0 END, 4) + 0.0, round(s * CASE k % 4 WHEN 0 THEN 1 WHEN 2 THEN -1 ELSE 0 END, 4) + 0.0, 5.0 FROM p"""
)
def e57_points(spark, sf_dir):
    """Cartesian points of one scan without the invalid ones, and posed spherical ones of another."""
    p = _e57_points(spark, sf_dir, "deviation", "rowindex")
    scan = F.when(F.col("rowindex") == 7, 0).otherwise(1).alias("scan")
    return rounded(p.select("key", scan, "x", "y", "z"), 4, "z").withColumns({a: F.when(F.col("scan") == 1, F.round(a, 4) + 0.0).otherwise(F.col(a)) for a in "xy"})


@query(
    f"""WITH {_P} SELECT k AS key, CAST(7 AS SMALLINT) AS rowindex, CAST(floor(k % 1024 / 1023 * 255 + 0.5) AS SMALLINT) AS r, CAST(floor(k * 7 % 1024 / 1023 * 255 + 0.5) AS SMALLINT) AS b, CAST(floor(k * 5 % 2048 / 4094 * 65535 + 0.5) AS INTEGER) AS intensity, CAST(0 AS DOUBLE) AS deviation FROM p WHERE k % 20 <> 0
UNION ALL SELECT k, CAST(0 AS SMALLINT), CAST(255 AS SMALLINT), CAST(255 AS SMALLINT), 0, s * 0.25 FROM p"""
)
def e57_ranges(spark, sf_dir):
    """Colours and intensity by their ranges, and zero for what a scan lacks."""
    return _e57_points(spark, sf_dir, "rowindex", "intensity", "deviation").select("key", "rowindex", "r", "b", "intensity", "deviation")


# ---------------------------------------------------------------- GeoTIFF

_W = 40
_GRID = f"grid AS (SELECT i + 1 AS k, CAST(i // {_W} AS INTEGER) AS \"row\", CAST(i % {_W} AS INTEGER) AS col, s, p FROM (SELECT *, k - (SELECT min(k) FROM p) AS i FROM p))"


def _tiff(kind: str, t: dict[str, np.ndarray]) -> bytes:
    """A picture with a cell for each part, filled up with zeros."""
    k, rows = t["k"] - t["k"].min(), -(-len(t["k"]) // _W)
    put = lambda v, dtype: np.concatenate([v, np.zeros(rows * _W - len(v))]).astype(dtype).reshape(rows, _W)
    grey, price = put(t["s"] * 5, "u1"), put(t["p"], "<f4")
    if kind == "palette":
        palette = np.stack([np.arange(256) * m % 256 * 256 for m in (1, 3, 7)]).astype("<u2")
        return clouds.tiff_file(grey[:, :, None], (0.0, 0.0), 1.0, 32633, palette=palette)
    if kind == "nodata":
        text = '<GDALMetadata><Item name="SCALE" sample="0" role="scale">0.5</Item><Item name="OFFSET" sample="0" role="offset">10</Item></GDALMetadata>'
        return clouds.tiff_file(put(t["s"], "<i2")[:, :, None], (0.0, 0.0), 1.0, 32633, nodata="7", metadata=text)
    if kind == "rgb":
        return clouds.tiff_file(np.stack([grey, put((k + 1) % 256, "u1"), put((k + 1) * 3 % 256, "u1"), put(np.where(k % 9 == 0, 0, 255), "u1")], axis=2), (1000.0, 2000.0), 2.0, 32633, tile=16)
    codec, predictor = map(int, kind.split("-"))
    data = np.stack([put(t["s"] * 300, "<u2"), put(k + 1, "<u2")], axis=2) if predictor == 2 else np.stack([price, put(k + 1, "<f4")], axis=2)
    return clouds.tiff_file(data, (0.0, 0.0), 1.0, 32633, codec, predictor, 16 if codec == 8 else None)


def _tiff_path(spark, sf_dir, kind: str) -> str:
    return f"{_files(spark, _parts(spark, sf_dir), [kind], 'tif', _tiff, None)}/000000-{kind}.tif"


_KINDS = ("1-1", "8-1", "8-2", "32773-1", "34925-2")


@query(
    f"""WITH {_P}, {_GRID} SELECT kind, "row", col, CASE WHEN kind LIKE '%-2' THEN s * 300 ELSE CAST(CAST(p AS FLOAT) AS DOUBLE) END AS band_1, CAST(CASE WHEN kind LIKE '%-2' THEN k % 65536 ELSE k END AS DOUBLE) AS band_2 FROM grid, (SELECT unnest({list(_KINDS)}) AS kind)"""
)
def geotiff_bands(spark, sf_dir):
    """Bands of pictures in strips and tiles, of several codecs, with and without differences."""
    out = None
    n = table(spark, sf_dir, "part").count()
    for kind in _KINDS:
        one = geotiff.read_bands(spark, _tiff_path(spark, sf_dir, kind)).withColumn("kind", F.lit(kind))
        out = one if out is None else out.unionByName(one)
    return out.filter(F.col("row") * _W + F.col("col") < n).select("kind", "row", "col", "band_1", "band_2")


@query(f"""WITH {_P}, {_GRID} SELECT "row", col, CAST(CASE WHEN s <> 7 THEN s * 0.5 + 10 END AS DOUBLE) AS band_1 FROM grid""")
def geotiff_scaled(spark, sf_dir):
    """Values scaled by the metadata; no-data is null."""
    n = table(spark, sf_dir, "part").count()
    return geotiff.read_bands(spark, _tiff_path(spark, sf_dir, "nodata")).filter(F.col("row") * _W + F.col("col") < n).select("row", "col", "band_1")


@query(f"""WITH {_P}, {_GRID} SELECT "row", col, CAST(s * 5 % 256 AS INTEGER) AS r, CAST(s * 5 * 3 % 256 AS INTEGER) AS g, CAST(s * 5 * 7 % 256 AS INTEGER) AS b, CAST(255 AS INTEGER) AS a FROM grid""")
def geotiff_palette(spark, sf_dir):
    """Colours through a palette."""
    n = table(spark, sf_dir, "part").count()
    return geotiff.read_colours(spark, _tiff_path(spark, sf_dir, "palette")).filter(F.col("row") * _W + F.col("col") < n)


@query(
    f"""WITH {_P}, {_GRID}, o AS (SELECT o_orderkey AS id, 1000 + o_orderkey % 997 * 0.1 AS x, 2000 - o_custkey % 499 * 0.2 AS y FROM orders),
m AS (SELECT id, x, y, k, s FROM o LEFT JOIN grid ON col = floor((x - 1000) / 2) AND "row" = floor((2000 - y) / 2)),
h AS (SELECT ceil(count(*) / {_W}) AS rows FROM p)
SELECT id, CAST(CASE WHEN k IS NOT NULL AND (k - 1) % 9 <> 0 THEN s * 5 % 256 ELSE 9 END AS SMALLINT) AS r, CAST(CASE WHEN k IS NOT NULL AND (k - 1) % 9 <> 0 THEN k % 256 ELSE 9 END AS SMALLINT) AS g, CAST(CASE WHEN k IS NOT NULL AND (k - 1) % 9 <> 0 THEN k * 3 % 256 ELSE 9 END AS SMALLINT) AS b FROM m"""
)
def geotiff_points(spark, sf_dir):
    """Points that take the colours of a picture, but for those beyond it and on transparent cells."""
    k = F.col("o_orderkey")
    nine = F.lit(9).cast("short")
    p = table(spark, sf_dir, "orders").select(k.alias("id"), (F.lit(1000.0) + k % 997 * 0.1).alias("x"), (F.lit(2000.0) - F.col("o_custkey") % 499 * 0.2).alias("y"), nine.alias("r"), nine.alias("g"), nine.alias("b"))
    return geotiff.colour_points(spark, p, _tiff_path(spark, sf_dir, "rgb"), ["id"]).select("id", "r", "g", "b")

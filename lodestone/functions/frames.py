"""Coordinate frames: source CRS to earth-centred, and to a local frame with Z up."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .crs import from_earth, parsed, through, to_earth

# WGS 84 and GRS 80 (fixed values)
A = 6378137.0
F_WGS84 = 1 / 298.257223563
F_GRS80 = 1 / 298.257222101
B_WGS84 = 6356752.31424518

Triple = tuple[Column, Column, Column]


def geodetic_to_ecef(lon: Column, lat: Column, height: Column, flattening: float = F_WGS84) -> Triple:
    """Degrees and metres to EPSG:4978."""
    e2 = flattening * (2 - flattening)
    sin_lat, cos_lat = F.sin(F.radians(lat)), F.cos(F.radians(lat))
    n = A / F.sqrt(1 - e2 * sin_lat * sin_lat)
    return (n + height) * cos_lat * F.cos(F.radians(lon)), (n + height) * cos_lat * F.sin(F.radians(lon)), (n * (1 - e2) + height) * sin_lat


def mercator_to_geodetic(x: Column, y: Column) -> tuple[Column, Column]:
    """EPSG:3857 to degrees."""
    return F.degrees(x / A), F.degrees(2 * F.atan(F.exp(y / A)) - math.pi / 2)


#: CRS of one's own by name: (to earth-centred, from earth-centred), each a function of points with x, y and z.
OWN: dict[str, tuple[Callable[[DataFrame], DataFrame], Callable[[DataFrame], DataFrame] | None]] = {}


def register_crs(name: str, to_earth: Callable[[DataFrame], DataFrame], from_earth: Callable[[DataFrame], DataFrame] | None = None) -> None:
    """A CRS without a closed form here, such as one with a grid; from_earth is needed for images in it."""
    if name in OWN:
        raise ValueError(f"there is a CRS {name}")
    OWN[name] = to_earth, from_earth


def _point() -> Column:
    return F.struct(*(F.col(a).cast("double").alias(a) for a in "xyz"))


def to_ecef(crs: str, x: Column, y: Column, z: Column) -> Triple:
    """EPSG:4978 coordinates of a point in a CRS with a closed form; x is longitude or east.  See crs.parsed."""
    c = parsed(crs)
    if c.kind == "geocent":
        return x, y, z
    out = through(to_earth(c), F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"), z.cast("double").alias("z")))
    return out["x"], out["y"], out["z"]


def _stepped(points: DataFrame, steps: list) -> DataFrame:
    if not steps:
        return points
    out = points.withColumn("_e", through(steps, _point()))
    return out.withColumns({a: F.col(f"_e.{a}") for a in "xyz"}).drop("_e")


def reprojected(points: DataFrame, crs: str) -> DataFrame:
    """points with earth-centred x, y and z."""
    return OWN[crs][0](points) if crs in OWN else _stepped(points, to_earth(parsed(crs)))


def projected(points: DataFrame, crs: str) -> DataFrame:
    """Earth-centred points with x, y and z of a CRS."""
    if crs in OWN:
        if OWN[crs][1] is None:
            raise ValueError(f"nothing leads from the earth to {crs}")
        return OWN[crs][1](points)
    return _stepped(points, from_earth(parsed(crs)))


@dataclass(frozen=True)
class Affine:
    """p -> rotation p + origin, from a local frame to the global one; the rotation may hold a scale."""

    rotation: tuple[tuple[float, ...], ...]
    origin: tuple[float, float, float]

    @property
    def matrix(self) -> np.ndarray:
        out = np.eye(4)
        out[:3, :3], out[:3, 3] = self.rotation, self.origin
        return out

    def column_major(self) -> list[float]:
        return self.matrix.T.reshape(-1).tolist()

    def forward(self, x: Column, y: Column, z: Column) -> Triple:
        return tuple(r[0] * x + r[1] * y + r[2] * z + o for r, o in zip(self.rotation, self.origin, strict=True))

    def inverse(self, x: Column, y: Column, z: Column) -> Triple:
        back = np.linalg.inv(np.array(self.rotation))
        d = [c - o for c, o in zip((x, y, z), self.origin, strict=True)]
        return tuple(float(r[0]) * d[0] + float(r[1]) * d[1] + float(r[2]) * d[2] for r in back)


def local_frame(x: float, y: float, z: float) -> Affine:
    """The frame at an earth-centred point: Z along the ellipsoid's normal, X level, Y completing it."""
    up = np.array([x / A**2, y / A**2, z / B_WGS84**2]) if (x, y, z) != (0, 0, 0) else np.array([0.0, 0.0, 1.0])
    up = up / np.linalg.norm(up)
    side = np.array([0.0, 1.0, 0.0])
    if np.linalg.norm(np.cross(up, side)) < 0.05:
        side = np.array([1.0, 0.0, 0.0])
    east = np.cross(side, up)
    east /= np.linalg.norm(east)
    north = np.cross(up, east)
    return Affine(tuple(map(tuple, np.stack([east, north / np.linalg.norm(north), up], axis=1).tolist())), (x, y, z))


_UP = {"z": np.eye(3), "y": np.array([[1.0, 0, 0], [0, 0, -1], [0, 1, 0]]), "x": np.array([[0, 0, -1.0], [0, 1, 0], [1, 0, 0]])}


def placement(lon: float = 0, lat: float = 0, height: float = 0, heading: float = 0, pitch: float = 0, roll: float = 0, scale: float = 1, up: str = "z") -> Affine:
    """The transform that puts a model without a CRS on the earth.

    Turned about -Z by heading, -Y by pitch and +X by roll in the east-north-up frame.
    """
    numbers = {"longitude": lon, "latitude": lat, "height": height, "heading": heading, "pitch": pitch, "roll": roll, "scale": scale}
    for name, v in numbers.items():
        if not math.isfinite(v):
            raise ValueError(f"{name} must be finite")
    if not -90 <= lat <= 90 or not -180 <= lon <= 180:
        raise ValueError("longitude or latitude out of range")
    if scale < 0:
        raise ValueError("scale must be positive")
    if up not in _UP:
        raise ValueError("up must be x, y or z")
    o, a, h, p, r = (math.radians(v) for v in (lon, lat, heading, pitch, roll))
    e2 = F_WGS84 * (2 - F_WGS84)
    n = A / math.sqrt(1 - e2 * math.sin(a) ** 2)
    origin = (n + height) * math.cos(a) * math.cos(o), (n + height) * math.cos(a) * math.sin(o), (n * (1 - e2) + height) * math.sin(a)
    east, north = np.array([-math.sin(o), math.cos(o), 0]), np.array([-math.sin(a) * math.cos(o), -math.sin(a) * math.sin(o), math.cos(a)])
    enu = np.stack([east, north, np.cross(east, north)], axis=1)
    about_z = np.array([[math.cos(h), math.sin(h), 0], [-math.sin(h), math.cos(h), 0], [0, 0, 1]])
    about_y = np.array([[math.cos(p), 0, -math.sin(p)], [0, 1, 0], [math.sin(p), 0, math.cos(p)]])
    about_x = np.array([[1, 0, 0], [0, math.cos(r), -math.sin(r)], [0, math.sin(r), math.cos(r)]])
    turn = enu @ about_z @ about_y @ about_x @ _UP[up] * (scale or 1)
    return Affine(tuple(map(tuple, turn.tolist())), origin)


def anchored(points: DataFrame, order: list[str]) -> Affine:
    """The local frame at the first point of earth-centred points."""
    first = points.agg(F.min_by(F.struct("x", "y", "z"), F.struct(*order)).alias("p")).first()["p"]
    return local_frame(first["x"], first["y"], first["z"]) if first else local_frame(0.0, 0.0, 0.0)


def localised(points: DataFrame, frame: Affine) -> DataFrame:
    """Earth-centred points in the frame, in single precision."""
    local = frame.inverse(F.col("x"), F.col("y"), F.col("z"))
    return points.withColumns({c: v.cast("float") for c, v in zip("xyz", local, strict=True)})


def up_axis(x: Column, y: Column, z: Column, up: str) -> Triple:
    """Turn a model so that its up axis is Z."""
    return {"z": (x, y, z), "y": (x, -z, y), "x": (-z, y, x)}[up]

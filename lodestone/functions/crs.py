"""Coordinate reference systems with a closed form: what they are, and their maths as columns.

A CRS is an EPSG code, a PROJ string (``+proj=lcc +lat_1=49 ...``), or WKT 1 of a projected or geographic system.  Datums
are taken as they are: ETRS89, NAD83 and their like count as WGS 84, which they agree with to a metre or two.  A vertical part (``EPSG:25832+7837``)
is left out, so that heights count as ellipsoidal.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column
from pyspark.sql import functions as F

# ellipsoids: semi-major axis and inverse flattening (fixed values)
ELLIPSOIDS = {"wgs84": (6378137.0, 298.257223563), "grs80": (6378137.0, 298.257222101), "intl": (6378388.0, 297.0), "bessel": (6377397.155, 299.1528128), "clrk66": (6378206.4, 294.978698214), "airy": (6377563.396, 299.3249646), "krass": (6378245.0, 298.3), "sphere": (6370997.0, math.inf)}
# metres in a unit (fixed values)
UNITS = {"m": 1.0, "km": 1000.0, "ft": 0.3048, "us-ft": 1200 / 3937}


@dataclass(frozen=True)
class Crs:
    """kind: geocent, longlat, webmerc, tmerc, merc, lcc, stere (polar), laea or aea; angles in degrees, lengths in metres."""

    kind: str
    lon0: float = 0.0
    lat0: float = 0.0
    lat1: float | None = None
    lat2: float | None = None
    scale: float = 1.0
    east: float = 0.0
    north: float = 0.0
    unit: float = 1.0
    ellipsoid: tuple[float, float] = ELLIPSOIDS["wgs84"]

    @property
    def a(self) -> float:
        return self.ellipsoid[0]

    @property
    def f(self) -> float:
        return 1 / self.ellipsoid[1]

    @property
    def e2(self) -> float:
        return self.f * (2 - self.f)

    @property
    def e(self) -> float:
        return math.sqrt(self.e2)


GRS = ELLIPSOIDS["grs80"]

#: EPSG codes that aren't zones of a rule (fixed values).
CODES: dict[int, Crs] = {
    4978: Crs("geocent"),
    4326: Crs("longlat"),
    4979: Crs("longlat"),
    4258: Crs("longlat", ellipsoid=GRS),
    4269: Crs("longlat", ellipsoid=GRS),
    3857: Crs("webmerc"),
    3395: Crs("merc"),
    3067: Crs("tmerc", 27.0, scale=0.9996, east=500000.0, ellipsoid=GRS),
    2193: Crs("tmerc", 173.0, scale=0.9996, east=1600000.0, north=10000000.0, ellipsoid=GRS),
    2154: Crs("lcc", 3.0, 46.5, 49.0, 44.0, 1.0, 700000.0, 6600000.0, ellipsoid=GRS),
    3034: Crs("lcc", 10.0, 52.0, 35.0, 65.0, 1.0, 4000000.0, 2800000.0, ellipsoid=GRS),
    3347: Crs("lcc", -91.866666666666667, 63.390675, 49.0, 77.0, 1.0, 6200000.0, 3000000.0, ellipsoid=GRS),
    3035: Crs("laea", 10.0, 52.0, east=4321000.0, north=3210000.0, ellipsoid=GRS),
    5070: Crs("aea", -96.0, 23.0, 29.5, 45.5, ellipsoid=GRS),
    3005: Crs("aea", -126.0, 45.0, 50.0, 58.5, 1.0, 1000000.0, 0.0, ellipsoid=GRS),
    3031: Crs("stere", 0.0, -90.0, -71.0),
    3413: Crs("stere", -45.0, 90.0, 70.0),
    3995: Crs("stere", 0.0, 90.0, 71.0),
    32661: Crs("stere", 0.0, 90.0, scale=0.994, east=2000000.0, north=2000000.0),
    32761: Crs("stere", 0.0, -90.0, scale=0.994, east=2000000.0, north=2000000.0),
}


def utm(zone: int, south: bool = False, ellipsoid: tuple[float, float] = ELLIPSOIDS["wgs84"]) -> Crs:
    return Crs("tmerc", 6 * zone - 183.0, scale=0.9996, east=500000.0, north=1e7 if south else 0.0, ellipsoid=ellipsoid)


def _coded(code: int) -> Crs | None:
    zone, family = code % 100, code // 100
    if code in CODES:
        return CODES[code]
    if family in (326, 327) and 1 <= zone <= 60:
        return utm(zone, family == 327)
    if family == 258 and 28 <= zone <= 38 or family == 269 and 1 <= zone <= 23:
        return utm(zone, False, GRS)
    if family == 283 and 48 <= zone <= 58 or 7846 <= code <= 7859:  # Australia
        return utm(zone, True, GRS)
    if 3942 <= code <= 3950:  # France, zones of two degrees
        lat = code - 3900
        return Crs("lcc", 3.0, float(lat), lat - 0.75, lat + 0.75, 1.0, 1700000.0, 1200000.0 + (lat - 42) * 1000000.0, ellipsoid=GRS)
    return None


def _of_proj(text: str) -> Crs:
    p = dict((t.lstrip("+").split("=", 1) + [""])[:2] for t in text.split() if t.startswith("+"))
    number = lambda k, d=0.0: float(p[k]) if k in p else d
    kind = {"latlong": "longlat", "latlon": "longlat", "lonlat": "longlat", "etmerc": "tmerc"}.get(p.get("proj", ""), p.get("proj", ""))
    name = p.get("ellps", {"WGS84": "wgs84", "NAD83": "grs80"}.get(p.get("datum", ""), "wgs84")).lower()
    if name not in ELLIPSOIDS:
        raise ValueError(f"no ellipsoid {name!r}")
    ellipsoid = ELLIPSOIDS[name]
    if "a" in p:
        a = number("a")
        ellipsoid = a, number("rf") if "rf" in p else math.inf if number("b", a) == a else a / (a - number("b"))
    if "to_meter" not in p and p.get("units", "m") not in UNITS:
        raise ValueError(f"no unit {p['units']!r}")
    unit = number("to_meter") if "to_meter" in p else UNITS[p.get("units", "m")]
    if kind == "utm":
        return replace(utm(int(p["zone"]), "south" in p, ellipsoid), unit=unit)
    if kind == "merc" and "a" in p and ellipsoid[1] == math.inf:
        return Crs("webmerc", number("lon_0"), unit=unit, ellipsoid=ellipsoid)
    if kind not in ("geocent", "longlat", "tmerc", "merc", "lcc", "stere", "laea", "aea"):
        raise ValueError(f"no closed form for {text!r}")
    lat0 = number("lat_0")
    lat1 = number("lat_1", lat0) if kind in ("lcc", "aea") else number("lat_ts") if "lat_ts" in p else None
    out = Crs(kind, number("lon_0"), lat0, lat1, number("lat_2", lat1) if kind in ("lcc", "aea") else None, number("k_0", number("k", 1.0)), number("x_0"), number("y_0"), unit, ellipsoid)
    if kind == "stere" and abs(out.lat0) != 90:
        raise ValueError("stereographic systems are read where they are polar")
    return out


_WKT = {"transversemercator": "tmerc", "gausskruger": "tmerc", "lambertconformalconic2sp": "lcc", "lambertconformalconic1sp": "lcc", "lambertconformalconic": "lcc", "mercator1sp": "merc", "mercator2sp": "merc", "mercator": "merc", "polarstereographic": "stere", "lambertazimuthalequalarea": "laea", "albersconicequalarea": "aea", "albers": "aea"}


def _of_wkt(text: str) -> Crs:
    if found := re.search(r'AUTHORITY\s*\[\s*"EPSG"\s*,\s*"?(\d+)"?\s*\]\s*\]\s*$', text):
        if made := _coded(int(found[1])):
            return made
    ball = re.search(r'(?:SPHEROID|ELLIPSOID)\s*\[\s*"[^"]*"\s*,\s*([-\d.eE+]+)\s*,\s*([-\d.eE+]+)', text)
    ellipsoid = (float(ball[1]), float(ball[2]) or math.inf) if ball else ELLIPSOIDS["wgs84"]
    method = re.search(r'PROJECTION\s*\[\s*"([^"]+)"', text)
    if not method:
        if re.match(r"\s*GEOCCS", text):
            return Crs("geocent", ellipsoid=ellipsoid)
        if re.match(r"\s*GEOGCS", text):
            return Crs("longlat", ellipsoid=ellipsoid)
        raise ValueError("a WKT 1 text of a projected or geographic system is asked for")
    kind = _WKT.get(re.sub(r"[^a-z0-9]", "", method[1].lower()))
    if not kind:
        raise ValueError(f"no closed form for {method[1]!r}")
    p = {re.sub(r"[^a-z0-9]", "", k.lower()): float(v) for k, v in re.findall(r'PARAMETER\s*\[\s*"([^"]+)"\s*,\s*([-\d.eE+]+)', text)}
    units = re.findall(r'UNIT\s*\[\s*"[^"]*"\s*,\s*([-\d.eE+]+)', text)
    unit = float(units[-1]) if units else 1.0
    get = lambda *names, default=0.0: next((p[n] for n in names if n in p), default)
    lat0 = get("latitudeoforigin", "latitudeofcenter", "latitudeofcentre")
    lat1 = get("standardparallel1", default=None)
    if kind == "stere":
        lat0, lat1 = math.copysign(90, lat0 if lat0 else lat1 or 90), lat1 if lat1 is not None else lat0 if abs(lat0) != 90 else None
    elif kind in ("lcc", "aea"):
        lat1 = lat0 if lat1 is None else lat1
    return Crs(kind, get("centralmeridian", "longitudeoforigin", "longitudeofcenter", "longitudeofcentre"), lat0, lat1, get("standardparallel2", default=lat1) if kind in ("lcc", "aea") else None, get("scalefactor", default=1.0), get("falseeasting") * unit, get("falsenorthing") * unit, unit, ellipsoid)


def parsed(text: str) -> Crs:
    """The CRS of a text; one without a closed form raises ValueError."""
    text = text.strip()
    if "+proj=" in text:
        return _of_proj(text)
    if re.match(r"(PROJCS|GEOGCS|GEOCCS|COMPD_CS)\s*\[", text):
        if text.startswith("COMPD_CS"):
            start = re.search(r"(PROJCS|GEOGCS)\s*\[", text)
            depth, end = 0, start.end() - 1
            for end in range(start.end() - 1, len(text)):
                depth += {"[": 1, "]": -1}.get(text[end], 0)
                if not depth:
                    break
            text = text[start.start() : end + 1]
        return _of_wkt(text)
    m = re.fullmatch(r"(?:epsg:)?(\d+)(?:\+\d+)?", text.lower())
    made = _coded(int(m[1])) if m else None
    if made is None:
        raise ValueError(f"no closed form for CRS {text!r}")
    return made


# ---------------------------------------------------------------- series and constants

Step = Callable[[Column], Column]


def _third(c: Crs) -> float:
    return c.f / (2 - c.f)


def rectifying(c: Crs) -> float:
    n = _third(c)
    return c.a / (1 + n) * (1 + n**2 / 4 + n**4 / 64)


def _alpha(c: Crs) -> tuple[float, ...]:
    n = _third(c)
    return (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16 + 41 * n**4 / 180, 13 * n**2 / 48 - 3 * n**3 / 5 + 557 * n**4 / 1440, 61 * n**3 / 240 - 103 * n**4 / 140, 49561 * n**4 / 161280)


def _beta(c: Crs) -> tuple[float, ...]:
    n = _third(c)
    return (n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96 - n**4 / 360, n**2 / 48 + n**3 / 15 - 437 * n**4 / 1440, 17 * n**3 / 480 - 37 * n**4 / 840, 4397 * n**4 / 161280)


def _delta(c: Crs) -> tuple[float, ...]:
    """From conformal to geodetic latitude."""
    n = _third(c)
    return (2 * n - 2 * n**2 / 3 - 2 * n**3 + 116 * n**4 / 45, 7 * n**2 / 3 - 8 * n**3 / 5 - 227 * n**4 / 45, 56 * n**3 / 15 - 136 * n**4 / 35, 4279 * n**4 / 630)


def _authalic(c: Crs) -> tuple[float, ...]:
    """From authalic to geodetic latitude."""
    e2 = c.e2
    return (e2 / 3 + 31 * e2**2 / 180 + 517 * e2**3 / 5040, 23 * e2**2 / 360 + 251 * e2**3 / 3780, 761 * e2**3 / 45360)


def _psi(c: Crs, lat: float) -> float:
    """Isometric latitude, of radians."""
    s = math.sin(lat)
    return math.asinh(math.tan(lat)) - c.e * math.atanh(c.e * s)


def _m(c: Crs, lat: float) -> float:
    return math.cos(lat) / math.sqrt(1 - c.e2 * math.sin(lat) ** 2)


def _q(c: Crs, lat: float) -> float:
    s = math.sin(lat)
    return (1 - c.e2) * (s / (1 - c.e2 * s * s) + math.atanh(c.e * s) / c.e) if c.e else 2 * s


def _meridian(c: Crs) -> float:
    """Length of the meridian to the latitude of origin."""
    if not c.lat0:
        return 0.0
    chi = math.atan(math.sinh(_psi(c, math.radians(c.lat0))))
    return rectifying(c) * (chi + sum(a * math.sin(2 * j * chi) for j, a in enumerate(_alpha(c), 1)))


def _cone(c: Crs) -> tuple[float, float, float]:
    """Of a conformal cone: its constant, a F, and the radius of the origin."""
    one, two = math.radians(c.lat1), math.radians(c.lat2)
    n = math.sin(one) if abs(one - two) < 1e-10 else (math.log(_m(c, one)) - math.log(_m(c, two))) / (_psi(c, two) - _psi(c, one))
    af = c.scale * c.a * _m(c, one) * math.exp(n * _psi(c, one)) / n
    return n, af, af * math.exp(-n * _psi(c, math.radians(c.lat0))) if abs(c.lat0) != 90 else 0.0


def _pole(c: Crs) -> float:
    """Radius on a polar plane for exp(-psi) = 1."""
    e = c.e
    if c.lat1 is not None and abs(c.lat1) != 90:
        lat = math.radians(abs(c.lat1))
        return c.a * _m(c, lat) * math.exp(_psi(c, lat))
    return 2 * c.a * c.scale / math.sqrt((1 + e) ** (1 + e) * (1 - e) ** (1 - e))


def _struct(**columns: Column) -> Column:
    return F.struct(*(v.alias(k) for k, v in columns.items()))


def _latitude(c: Crs, series: tuple[float, ...]) -> Step:
    """(lon, chi, h) to degrees."""
    return lambda p: _struct(lon=p["lon"], lat=F.degrees(p["chi"] + sum((d * F.sin(2 * j * p["chi"]) for j, d in enumerate(series, 1)), F.lit(0.0))), h=p["h"])


def to_geodetic(c: Crs) -> list[Step]:
    """Steps from (x, y, z) of the CRS to (lon, lat, h) in degrees; each is over a struct that is to be evaluated once."""
    u, lon0 = c.unit, math.radians(c.lon0)
    start: Step = lambda p: _struct(dx=p["x"] * u - c.east, dy=p["y"] * u - c.north, h=p["z"])
    conformal = _latitude(c, _delta(c))
    if c.kind == "longlat":
        return [lambda p: _struct(lon=p["x"], lat=p["y"], h=p["z"])]
    if c.kind == "webmerc":
        return [lambda p: _struct(lon=F.degrees(p["x"] * u / c.a + lon0), lat=F.degrees(2 * F.atan(F.exp(p["y"] * u / c.a)) - math.pi / 2), h=p["z"])]
    if c.kind == "tmerc":
        r, beta, arc = c.scale * rectifying(c), _beta(c), c.scale * _meridian(c)
        back = lambda p: _struct(xi=p["xi"] - sum((b * F.sin(2 * j * p["xi"]) * F.cosh(2 * j * p["eta"]) for j, b in enumerate(beta, 1)), F.lit(0.0)), eta=p["eta"] - sum((b * F.cos(2 * j * p["xi"]) * F.sinh(2 * j * p["eta"]) for j, b in enumerate(beta, 1)), F.lit(0.0)), h=p["h"])
        sphere = lambda p: _struct(lon=F.degrees(F.atan2(F.sinh(p["eta"]), F.cos(p["xi"])) + lon0), chi=F.asin(F.sin(p["xi"]) / F.cosh(p["eta"])), h=p["h"])
        return [start, lambda p: _struct(xi=(p["dy"] + arc) / r, eta=p["dx"] / r, h=p["h"]), back, sphere, conformal]
    if c.kind == "merc":
        k = c.scale * c.a if c.lat1 is None else c.a * _m(c, math.radians(c.lat1))
        return [start, lambda p: _struct(lon=F.degrees(p["dx"] / k + lon0), chi=math.pi / 2 - 2 * F.atan(F.exp(-p["dy"] / k)), h=p["h"]), conformal]
    if c.kind == "lcc":
        n, af, origin = _cone(c)
        sign = math.copysign(1.0, n)
        polar = lambda p: _struct(rho=sign * F.sqrt(p["dx"] * p["dx"] + (origin - p["dy"]) * (origin - p["dy"])), theta=F.atan2(sign * p["dx"], sign * (origin - p["dy"])), h=p["h"])
        return [start, polar, lambda p: _struct(lon=F.degrees(p["theta"] / n + lon0), chi=math.pi / 2 - 2 * F.atan(F.pow(p["rho"] / af, F.lit(1 / n))), h=p["h"]), conformal]
    if c.kind == "stere":
        sign, k = math.copysign(1.0, c.lat0), _pole(c)
        return [start, lambda p: _struct(lon=F.degrees(F.atan2(p["dx"], -sign * p["dy"]) + lon0), chi=sign * (math.pi / 2 - 2 * F.atan(F.sqrt(p["dx"] * p["dx"] + p["dy"] * p["dy"]) / k)), h=p["h"]), conformal]
    equal = _latitude(c, _authalic(c))
    qp = _q(c, math.pi / 2)
    if c.kind == "aea":
        one, two, at = math.radians(c.lat1), math.radians(c.lat2), math.radians(c.lat0)
        n = math.sin(one) if abs(one - two) < 1e-10 else (_m(c, one) ** 2 - _m(c, two) ** 2) / (_q(c, two) - _q(c, one))
        big = _m(c, one) ** 2 + n * _q(c, one)
        origin, sign = c.a * math.sqrt(big - n * _q(c, at)) / n, math.copysign(1.0, n)
        polar = lambda p: _struct(r2=p["dx"] * p["dx"] + (origin - p["dy"]) * (origin - p["dy"]), theta=F.atan2(sign * p["dx"], sign * (origin - p["dy"])), h=p["h"])
        return [start, polar, lambda p: _struct(lon=F.degrees(p["theta"] / n + lon0), chi=F.asin((big - p["r2"] * n * n / c.a**2) / n / qp), h=p["h"]), equal]
    if c.kind == "laea":
        at = math.radians(c.lat0)
        rq, b0 = c.a * math.sqrt(qp / 2), math.asin(_q(c, at) / qp)
        d = c.a * _m(c, at) / (rq * math.cos(b0)) if abs(c.lat0) != 90 else 1.0
        polar = lambda p: _struct(dx=p["dx"], dy=p["dy"], rho=F.greatest(F.sqrt(p["dx"] * p["dx"] / d**2 + p["dy"] * p["dy"] * d**2), F.lit(1e-12)), h=p["h"])
        turned = lambda p: _struct(dx=p["dx"], dy=p["dy"], rho=p["rho"], cc=2 * F.asin(p["rho"] / (2 * rq)), h=p["h"])
        return [start, polar, turned, lambda p: _struct(lon=F.degrees(F.atan2(p["dx"] * F.sin(p["cc"]), d * p["rho"] * math.cos(b0) * F.cos(p["cc"]) - d * d * p["dy"] * math.sin(b0) * F.sin(p["cc"])) + lon0), chi=F.asin(F.cos(p["cc"]) * math.sin(b0) + d * p["dy"] * F.sin(p["cc"]) * math.cos(b0) / p["rho"]), h=p["h"]), equal]
    raise ValueError(f"no way from {c.kind} to longitude and latitude")


def to_earth(c: Crs) -> list[Step]:
    """Steps from (x, y, z) of the CRS to earth-centred (x, y, z)."""
    if c.kind == "geocent":
        return []

    def earth(p: Column) -> Column:
        lon, lat, sin = F.radians(p["lon"]), F.radians(p["lat"]), F.sin(F.radians(p["lat"]))
        n = c.a / F.sqrt(1 - c.e2 * sin * sin)
        return _struct(x=(n + p["h"]) * F.cos(lat) * F.cos(lon), y=(n + p["h"]) * F.cos(lat) * F.sin(lon), z=(n * (1 - c.e2) + p["h"]) * sin)

    return [*to_geodetic(c), earth]


def from_earth(c: Crs) -> list[Step]:
    """Steps from earth-centred (x, y, z) to (x, y, z) of the CRS, with heights above its ellipsoid."""
    if c.kind == "geocent":
        return []
    b, lon0 = c.a * (1 - c.f), c.lon0
    around = lambda p: _struct(x=p["x"], y=p["y"], z=p["z"], p=F.sqrt(p["x"] * p["x"] + p["y"] * p["y"]))
    angle = lambda p: _struct(lon=F.degrees(F.atan2(p["y"], p["x"])), z=p["z"], p=p["p"], t=F.atan2(p["z"] * c.a, p["p"] * b))
    lat = lambda p: _struct(lon=p["lon"], z=p["z"], p=p["p"], lat=F.atan2(p["z"] + c.e2 / (1 - c.e2) * b * F.pow(F.sin(p["t"]), F.lit(3.0)), p["p"] - c.e2 * c.a * F.pow(F.cos(p["t"]), F.lit(3.0))))
    high = lambda p: _struct(lon=p["lon"], lat=p["lat"], h=p["p"] * F.cos(p["lat"]) + p["z"] * F.sin(p["lat"]) - c.a * F.sqrt(1 - c.e2 * F.sin(p["lat"]) * F.sin(p["lat"])))
    out: list[Step] = [around, angle, lat, high]
    u, east, north = c.unit, c.east, c.north
    if c.kind == "longlat":
        return [*out, lambda p: _struct(x=p["lon"], y=F.degrees(p["lat"]), z=p["h"])]
    turn = lambda p: F.radians(F.pmod(p["lon"] - lon0 + 180.0, F.lit(360.0)) - 180.0)
    if c.kind == "webmerc":
        return [*out, lambda p: _struct(x=c.a * turn(p) / u, y=c.a * F.log(F.tan(math.pi / 4 + p["lat"] / 2)) / u, z=p["h"])]
    iso = lambda p: _struct(d=turn(p), psi=F.asinh(F.tan(p["lat"])) - c.e * F.atanh(c.e * F.sin(p["lat"])), h=p["h"])
    if c.kind == "tmerc":
        r, alpha, arc = c.scale * rectifying(c), _alpha(c), c.scale * _meridian(c)
        sphere = lambda p: _struct(xi=F.atan2(F.sinh(p["psi"]), F.cos(p["d"])), eta=F.asinh(F.sin(p["d"]) / F.sqrt(F.sinh(p["psi"]) * F.sinh(p["psi"]) + F.cos(p["d"]) * F.cos(p["d"]))), h=p["h"])
        plane = lambda p: _struct(x=(east + r * (p["eta"] + sum((a * F.cos(2 * j * p["xi"]) * F.sinh(2 * j * p["eta"]) for j, a in enumerate(alpha, 1)), F.lit(0.0)))) / u, y=(north - arc + r * (p["xi"] + sum((a * F.sin(2 * j * p["xi"]) * F.cosh(2 * j * p["eta"]) for j, a in enumerate(alpha, 1)), F.lit(0.0)))) / u, z=p["h"])
        return [*out, iso, sphere, plane]
    if c.kind == "merc":
        k = c.scale * c.a if c.lat1 is None else c.a * _m(c, math.radians(c.lat1))
        return [*out, iso, lambda p: _struct(x=(east + k * p["d"]) / u, y=(north + k * p["psi"]) / u, z=p["h"])]
    if c.kind == "lcc":
        n, af, origin = _cone(c)
        return [*out, iso, lambda p: _struct(rho=af * F.exp(-n * p["psi"]), d=n * p["d"], h=p["h"]), lambda p: _struct(x=(east + p["rho"] * F.sin(p["d"])) / u, y=(north + origin - p["rho"] * F.cos(p["d"])) / u, z=p["h"])]
    if c.kind == "stere":
        sign, k = math.copysign(1.0, c.lat0), _pole(c)
        return [*out, iso, lambda p: _struct(rho=k * F.exp(-sign * p["psi"]), d=p["d"], h=p["h"]), lambda p: _struct(x=(east + p["rho"] * F.sin(p["d"])) / u, y=(north - sign * p["rho"] * F.cos(p["d"])) / u, z=p["h"])]
    qp = _q(c, math.pi / 2)
    area = lambda p: _struct(d=turn(p), q=(1 - c.e2) * (F.sin(p["lat"]) / (1 - c.e2 * F.sin(p["lat"]) * F.sin(p["lat"])) + F.atanh(c.e * F.sin(p["lat"])) / c.e), h=p["h"])
    if c.kind == "aea":
        one, two, at = math.radians(c.lat1), math.radians(c.lat2), math.radians(c.lat0)
        n = math.sin(one) if abs(one - two) < 1e-10 else (_m(c, one) ** 2 - _m(c, two) ** 2) / (_q(c, two) - _q(c, one))
        big = _m(c, one) ** 2 + n * _q(c, one)
        origin = c.a * math.sqrt(big - n * _q(c, at)) / n
        return [*out, area, lambda p: _struct(rho=c.a * F.sqrt(big - n * p["q"]) / n, d=n * p["d"], h=p["h"]), lambda p: _struct(x=(east + p["rho"] * F.sin(p["d"])) / u, y=(north + origin - p["rho"] * F.cos(p["d"])) / u, z=p["h"])]
    at = math.radians(c.lat0)
    rq, b0 = c.a * math.sqrt(qp / 2), math.asin(_q(c, at) / qp)
    d = c.a * _m(c, at) / (rq * math.cos(b0)) if abs(c.lat0) != 90 else 1.0
    beta = lambda p: _struct(d=p["d"], b=F.asin(p["q"] / qp), h=p["h"])
    wide = lambda p: _struct(d=p["d"], b=p["b"], h=p["h"], k=rq * F.sqrt(2 / (1 + math.sin(b0) * F.sin(p["b"]) + math.cos(b0) * F.cos(p["b"]) * F.cos(p["d"]))))
    return [*out, area, beta, wide, lambda p: _struct(x=(east + p["k"] * d * F.cos(p["b"]) * F.sin(p["d"])) / u, y=(north + p["k"] / d * (math.cos(b0) * F.sin(p["b"]) - math.sin(b0) * F.cos(p["b"]) * F.cos(p["d"]))) / u, z=p["h"])]


def through(steps: list[Step], start: Column) -> Column:
    """The steps one after the other; each value is evaluated once: one expression for all would repeat them many times over."""
    for step in steps:
        start = F.get(F.transform(F.array(start), step), F.lit(0))
    return start

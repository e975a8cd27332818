"""Map projections on spheres and ellipsoids, grid coordinates and vertical levels, as column expressions."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

RADIUS = 6_370_000.0


#: Steps from an isometric latitude back to a latitude; each gains a factor of about 150, so these leave nothing that a double shows.
STEPS = 8


@dataclass(frozen=True)
class Projection:
    """kind: lcc, stere, merc or eqc; angles in degrees, lengths in metres.

    ``minor`` makes an ellipsoid of half axes ``radius`` and ``minor``; eqc always is of a
    sphere of ``radius``.
    """

    kind: str
    lat_1: float = 0.0
    lat_2: float = 0.0
    lat_0: float = 0.0
    lon_0: float = 0.0
    x_0: float = 0.0
    y_0: float = 0.0
    radius: float = RADIUS
    minor: float | None = None

    @property
    def eccentricity(self) -> float:
        return 0.0 if self.minor is None else math.sqrt(max(0.0, 1 - (self.minor / self.radius) ** 2))

    def _m(self, p: float) -> float:
        """How large the circle of a latitude is against the radius."""
        return math.cos(p) / math.sqrt(1 - (self.eccentricity * math.sin(p)) ** 2)

    def _t(self, p: float) -> float:
        """exp(-isometric latitude); 1 / tan(pi/4 + p/2) on a sphere."""
        e = self.eccentricity
        return math.exp(e * math.atanh(e * math.sin(p))) * math.tan(math.pi / 4 - p / 2)

    def _cone(self) -> tuple[float, float, float]:
        """n, F and rho0 of the cone through both parallels."""
        p1, p2, p0 = (math.radians(a) for a in (self.lat_1, self.lat_2, self.lat_0))
        if self.eccentricity:
            n = math.sin(p1) if abs(p1 - p2) < 1e-12 else math.log(self._m(p1) / self._m(p2)) / math.log(self._t(p1) / self._t(p2))
            f = self._m(p1) / (n * self._t(p1) ** n)
            return n, f, self.radius * f * self._t(p0) ** n
        t = lambda p: math.tan(math.pi / 4 + p / 2)
        n = math.sin(p1) if abs(p1 - p2) < 1e-12 else math.log(math.cos(p1) / math.cos(p2)) / math.log(t(p2) / t(p1))
        f = math.cos(p1) * t(p1) ** n / n
        return n, f, self.radius * f / t(p0) ** n

    def _polar(self) -> float:
        """Metres for each unit of t around a pole."""
        p, e = math.radians(abs(self.lat_1)), self.eccentricity
        if math.cos(p) < 1e-12:
            return 2 * self.radius / math.sqrt((1 + e) ** (1 + e) * (1 - e) ** (1 - e))
        return self.radius * self._m(p) / self._t(p)

    def _flat(self, p: Column) -> Column:
        """t of a column of latitudes, in radians."""
        e = self.eccentricity
        return F.exp(F.atanh(F.sin(p) * e) * e) * F.tan(math.pi / 4 - p / 2)

    def _round(self, t: Column) -> Column:
        """Latitudes in radians of t: a fixed point, written out step by step."""
        e, p = self.eccentricity, math.pi / 2 - 2 * F.atan(t)
        for _ in range(STEPS):
            p = math.pi / 2 - 2 * F.atan(t * F.exp(F.atanh(F.sin(p) * e) * -e))
        return p

    def _ellipsoid_forward(self, d: Column, p: Column) -> tuple[Column, Column]:
        if self.kind == "lcc":
            n, f, r0 = self._cone()
            r = F.pow(self._flat(p), F.lit(n)) * (self.radius * f)
            return r * F.sin(d * n) + self.x_0, r0 - r * F.cos(d * n) + self.y_0
        if self.kind == "stere":
            s = 1.0 if self.lat_0 >= 0 else -1.0
            r = self._flat(p * s) * self._polar()
            return r * F.sin(d) + self.x_0, r * F.cos(d) * -s + self.y_0
        k = self.radius * self._m(math.radians(self.lat_1))
        return d * k + self.x_0, F.log(self._flat(p)) * -k + self.y_0

    def _ellipsoid_inverse(self, x: Column, y: Column) -> tuple[Column, Column]:
        if self.kind == "lcc":
            n, f, r0 = self._cone()
            s = math.copysign(1.0, n)
            r = F.sqrt(x * x + (r0 - y) * (r0 - y)) * s
            return F.degrees(F.atan2(x * s, (r0 - y) * s) / n) + self.lon_0, F.degrees(self._round(F.pow(r / (self.radius * f), F.lit(1 / n))))
        if self.kind == "stere":
            s = 1.0 if self.lat_0 >= 0 else -1.0
            return F.degrees(F.atan2(x, y * -s)) + self.lon_0, F.degrees(self._round(F.sqrt(x * x + y * y) / self._polar())) * s
        k = self.radius * self._m(math.radians(self.lat_1))
        return F.degrees(x / k) + self.lon_0, F.degrees(self._round(F.exp(y / -k)))

    def forward(self, lon: Column, lat: Column) -> tuple[Column, Column]:
        d = F.radians(F.pmod(lon - self.lon_0 + 180, F.lit(360.0)) - 180)
        p = F.radians(lat)
        if self.eccentricity and self.kind in ("lcc", "stere", "merc"):
            return self._ellipsoid_forward(d, p)
        if self.kind == "lcc":
            n, f, r0 = self._cone()
            r = self.radius * f / F.pow(F.tan(math.pi / 4 + p / 2), F.lit(n))
            return r * F.sin(d * n) + self.x_0, r0 - r * F.cos(d * n) + self.y_0
        if self.kind == "stere":  # polar, true at lat_1
            s = 1.0 if self.lat_0 >= 0 else -1.0
            k = (1 + math.sin(math.radians(abs(self.lat_1)))) * self.radius
            r = k * F.tan(math.pi / 4 - p * s / 2)
            return r * F.sin(d) + self.x_0, r * F.cos(d) * -s + self.y_0
        if self.kind == "merc":
            k = self.radius * math.cos(math.radians(self.lat_1))
            return d * k + self.x_0, F.log(F.tan(math.pi / 4 + p / 2)) * k + self.y_0
        if self.kind == "eqc":
            return d * (self.radius * math.cos(math.radians(self.lat_1))) + self.x_0, (p - math.radians(self.lat_0)) * self.radius + self.y_0
        raise NotImplementedError(self.kind)

    def inverse(self, x: Column, y: Column) -> tuple[Column, Column]:
        x, y = x - self.x_0, y - self.y_0
        if self.eccentricity and self.kind in ("lcc", "stere", "merc"):
            lon, lat = self._ellipsoid_inverse(x, y)
            return F.pmod(lon + 180, F.lit(360.0)) - 180, lat
        if self.kind == "lcc":
            n, f, r0 = self._cone()
            s = math.copysign(1.0, n)
            r = F.sqrt(x * x + (r0 - y) * (r0 - y)) * s
            lon = F.degrees(F.atan2(x * s, (r0 - y) * s) / n) + self.lon_0
            lat = F.degrees(2 * F.atan(F.pow(F.try_divide(F.lit(self.radius * f), r), F.lit(1 / n))) - math.pi / 2)
        elif self.kind == "stere":
            s = 1.0 if self.lat_0 >= 0 else -1.0
            k = (1 + math.sin(math.radians(abs(self.lat_1)))) * self.radius
            lon = F.degrees(F.atan2(x, y * -s)) + self.lon_0
            lat = F.degrees(math.pi / 2 - 2 * F.atan(F.sqrt(x * x + y * y) / k)) * s
        elif self.kind == "merc":
            k = self.radius * math.cos(math.radians(self.lat_1))
            lon, lat = F.degrees(x / k) + self.lon_0, F.degrees(2 * F.atan(F.exp(y / k)) - math.pi / 2)
        elif self.kind == "eqc":
            lon, lat = F.degrees(x / (self.radius * math.cos(math.radians(self.lat_1)))) + self.lon_0, F.degrees(y / self.radius) + self.lat_0
        else:
            raise NotImplementedError(self.kind)
        return F.pmod(lon + 180, F.lit(360.0)) - 180, lat


def grid_projection(attrs: dict, radius: float = RADIUS, minor: float | None = None) -> Projection:
    """From grid attributes GDTYP, P_ALP, P_BET, P_GAM, XCENT and YCENT."""
    kind = {1: "eqc", 2: "lcc", 6: "stere", 7: "merc"}.get(int(attrs["GDTYP"]))
    if kind is None:
        raise NotImplementedError(f"GDTYP {attrs['GDTYP']}")
    a, b = float(attrs.get("P_ALP", 0)), float(attrs.get("P_BET", 0))
    if kind == "stere":
        return Projection(kind, lat_1=b, lat_0=90.0 * math.copysign(1, a), lon_0=float(attrs.get("P_GAM", attrs.get("XCENT", 0))), radius=radius, minor=minor)
    return Projection(kind, a, b, float(attrs.get("YCENT", 0)), float(attrs.get("P_GAM", attrs.get("XCENT", 0))), radius=radius, minor=minor)


#: Names of grid mappings in the climate and forecast convention.
MAPPINGS = {"latitude_longitude": "eqc", "lambert_conformal_conic": "lcc", "polar_stereographic": "stere", "mercator": "merc"}


def grid_mapping(attrs: dict, spheroid: str | None = None) -> dict:
    """The grid's mapping variable in the climate and forecast convention; origins are those of the first cell's corner."""
    major, minor = half_axes(spheroid)
    p = grid_projection(attrs, major, minor)
    name = {v: k for k, v in MAPPINGS.items()}[p.kind]
    out: dict[str, object] = {"grid_mapping_name": name, "semi_major_axis": major, "semi_minor_axis": minor}
    if p.kind == "eqc":
        return out
    out |= {"false_easting": -float(attrs["XORIG"]), "false_northing": -float(attrs["YORIG"])}
    if p.kind == "lcc":
        return out | {"standard_parallel": [p.lat_1, p.lat_2], "longitude_of_central_meridian": p.lon_0, "latitude_of_projection_origin": p.lat_0}
    if p.kind == "stere":
        return out | {"standard_parallel": p.lat_1, "straight_vertical_longitude_from_pole": p.lon_0, "latitude_of_projection_origin": p.lat_0}
    return out | {"standard_parallel": p.lat_1, "longitude_of_projection_origin": p.lon_0}


def mapped_projection(mapping: dict) -> Projection:
    """The projection of a mapping variable's attributes."""
    kind = MAPPINGS.get(str(mapping.get("grid_mapping_name")))
    if kind is None:
        raise NotImplementedError(str(mapping.get("grid_mapping_name")))
    major = float(mapping.get("semi_major_axis", mapping.get("earth_radius", RADIUS)))
    minor = float(mapping.get("semi_minor_axis", major))
    if "inverse_flattening" in mapping and "semi_minor_axis" not in mapping and float(mapping["inverse_flattening"]):
        minor = major * (1 - 1 / float(mapping["inverse_flattening"]))
    both = mapping.get("standard_parallel", 0.0)
    parallels = [float(x) for x in both] if isinstance(both, (list, tuple)) else [float(both)]
    lon = next((float(mapping[k]) for k in ("longitude_of_central_meridian", "straight_vertical_longitude_from_pole", "longitude_of_projection_origin") if k in mapping), 0.0)
    east, north = float(mapping.get("false_easting", 0.0)), float(mapping.get("false_northing", 0.0))
    return Projection(kind, parallels[0], parallels[-1], float(mapping.get("latitude_of_projection_origin", 0.0)), lon, east, north, major, None if minor == major else minor)


def proj_text(mapping: dict) -> str:
    """The mapping as the parameter text that other tools read."""
    p = mapped_projection(mapping)
    kind = {"eqc": "lonlat", "lcc": "lcc", "stere": "stere", "merc": "merc"}[p.kind]
    parts = {"lonlat": {}, "lcc": {"lon_0": p.lon_0, "lat_1": p.lat_1, "lat_2": p.lat_2, "lat_0": p.lat_0}, "stere": {"lat_0": p.lat_0, "lat_ts": p.lat_1, "lon_0": p.lon_0}, "merc": {"lat_ts": p.lat_1, "lon_0": p.lon_0}}[kind]
    if kind != "lonlat":
        parts |= {"x_0": p.x_0, "y_0": p.y_0}
    parts |= {"a": p.radius, "b": p.minor or p.radius}
    return " ".join([f"+proj={kind}", *(f"+{k}={v:.12g}" for k, v in parts.items()), "+no_defs"])


def cell_xy(i: Column, j: Column, attrs: dict) -> tuple[Column, Column]:
    """Projected centres of cells."""
    return (i + 0.5) * float(attrs["XCELL"]) + float(attrs["XORIG"]), (j + 0.5) * float(attrs["YCELL"]) + float(attrs["YORIG"])


def pressure(sigma: Column, top: float = 10_000.0, surface: float = 101_325.0) -> Column:
    """Pa at a sigma level."""
    return sigma * (surface - top) + top


def hybrid_pressure(a: Column, b: Column, surface: Column) -> Column:
    return a + b * surface


def standard_height(p_hpa: Column, scale_km: float = 7.6) -> Column:
    """km above the 1013.25 hPa level, by one scale height."""
    return -F.log(p_hpa / 1013.25) * scale_km


def cell_area(lat_south: Column, lat_north: Column, width_deg: Column, radius: float = RADIUS) -> Column:
    """m2 of a cell between two latitudes."""
    return (F.sin(F.radians(lat_north)) - F.sin(F.radians(lat_south))) * F.radians(width_deg) * radius**2


# Half axes in metres of the spheroids that grids name by number, from 0.
SPHEROIDS: list[tuple[str, float, float]] = [
    ("Clarke 1866", 6378206.4, 6356583.8),
    ("Clarke 1880", 6378249.145, 6356514.86955),
    ("Bessel", 6377397.155, 6356078.96284),
    ("New International 1967", 6378157.5, 6356772.2),
    ("International 1909", 6378388.0, 6356911.94613),
    ("WGS 72", 6378135.0, 6356750.519915),
    ("Everest", 6377276.3452, 6356075.4133),
    ("WGS 66", 6378145.0, 6356759.769356),
    ("GRS 1980", 6378137.0, 6356752.314140),
    ("Airy", 6377563.396, 6356256.91),
    ("Modified Everest", 6377304.063, 6356103.039),
    ("Modified Airy", 6377340.189, 6356034.448),
    ("WGS 84", 6378137.0, 6356752.314245),
    ("Southeast Asia", 6378155.0, 6356773.3205),
    ("Australian National", 6378160.0, 6356774.719),
    ("Krassovsky", 6378245.0, 6356863.0188),
    ("Hough", 6378270.0, 6356794.343479),
    ("Mercury 1960", 6378166.0, 6356784.283666),
    ("Modified Mercury 1968", 6378150.0, 6356768.337303),
    ("Normal Sphere", 6370997.0, 6370997.0),
    ("MM5 Sphere", 6370000.0, 6370000.0),
    ("WRF-NMM Sphere", 6371200.0, 6371200.0),
]


def half_axes(text: str | None = None) -> tuple[float, float]:
    """From a spheroid's number, a radius, or two half axes; a sphere of 6,370 km if nothing is said."""
    parts = [float(x) for x in (text or str(RADIUS)).split()]
    if len(parts) > 2 or not parts:
        raise ValueError(f"one or two numbers, not {text!r}")
    if len(parts) == 2:
        return parts[0], parts[1]
    if 0 <= parts[0] < len(SPHEROIDS):
        return SPHEROIDS[int(parts[0])][1:]
    return parts[0], parts[0]


def sigma_edges(attrs: dict, pressures: list[float] | None = None, layers: int = 1) -> list[float]:
    """Sigma at layer edges: as given, from edge pressures, or numbers of layers where nothing else is known."""
    if "VGLVLS" in attrs:
        return [float(x) for x in attrs["VGLVLS"]]
    if pressures:
        return [(p - pressures[-1]) / (pressures[0] - pressures[-1]) for p in pressures]
    return [float(k) for k in range(int(attrs.get("NLAYS", layers)))]


def middles(edges: list[float]) -> list[float]:
    return [a + (b - a) / 2 for a, b in zip(edges, edges[1:], strict=False)]


def pressure_edges(attrs: dict, pressures: list[float] | None = None, surface: float = 101_325.0, top: float | None = None) -> list[float]:
    """Pressures at layer edges: as given, or of the sigma edges between the surface and the top."""
    if pressures:
        return list(pressures)
    top = float(attrs.get("VGTOP", 10_000.0)) if top is None else top
    return [s * (surface - top) + top for s in sigma_edges(attrs)]

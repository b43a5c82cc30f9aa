"""Coordinate reference systems with closed-form spherical transforms.

``forward(lat, lon)`` gives (x, y) and ``inverse(x, y)`` gives (lat, lon); geographic angles are in
degrees, projected coordinates in metres, rotated ones in degrees. Arguments are numpy arrays or
Spark columns; the same formula serves both. Formulas: J. P. Snyder, Map Projections - A Working
Manual, USGS Professional Paper 1395.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass, fields
from typing import Any, ClassVar

from fieldloom.crs.mathx import backend

#: The sphere that all default systems share, in metres.
EARTH_RADIUS = 6371229.0
RAD = math.pi / 180.0
DEG = 180.0 / math.pi


@dataclass(frozen=True)
class CoordSystem:
    """Base: equality is the same class with the same parameters."""

    grid_mapping_name: ClassVar[str | None] = None
    aliases: ClassVar[dict[str, str]] = {}

    @property
    def name(self) -> str:
        return f"crs_{self.grid_mapping_name or type(self).__name__.lower()}"

    @property
    def radius(self) -> float:
        return getattr(self, "earth_radius", EARTH_RADIUS) or EARTH_RADIUS

    def forward(self, lat: Any, lon: Any) -> tuple[Any, Any]:
        raise NotImplementedError(f"{type(self).__name__} has no transform")

    def inverse(self, x: Any, y: Any) -> tuple[Any, Any]:
        raise NotImplementedError(f"{type(self).__name__} has no transform")

    def to_attrs(self) -> dict[str, Any]:
        """CF attributes that :func:`parse_crs` reads back to an equal system."""
        back = {v: k for k, v in self.aliases.items()}
        attrs: dict[str, Any] = {"grid_mapping_name": self.grid_mapping_name} if self.grid_mapping_name else {}
        for f in fields(self):
            value = getattr(self, f.name)
            if value is not None:
                attrs[back.get(f.name, f.name)] = list(value) if isinstance(value, tuple) else value
        return attrs

    def to_dict(self) -> dict[str, Any]:
        return {"name": self.name, **self.to_attrs()}


@dataclass(frozen=True)
class GeogCS(CoordSystem):
    """Geographic coordinates on a sphere or an ellipsoid; two of a, b and 1/f give the third."""

    grid_mapping_name: ClassVar[str | None] = "latitude_longitude"
    aliases: ClassVar[dict[str, str]] = {
        "earth_radius": "semi_major_axis",
        "longitude_of_prime_meridian": "prime_meridian",
    }
    semi_major_axis: float = EARTH_RADIUS
    semi_minor_axis: float | None = None
    inverse_flattening: float | None = None
    prime_meridian: float = 0.0

    def __post_init__(self) -> None:
        a, b, f = self.semi_major_axis, self.semi_minor_axis, self.inverse_flattening
        if b is not None and f is not None:
            implied = a if not f else a * (1 - 1 / f)
            if abs(implied - b) > 1e-6 * a:
                raise ValueError("semi_minor_axis and inverse_flattening contradict each other")
        elif b is not None:
            object.__setattr__(self, "inverse_flattening", 0.0 if a == b else a / (a - b))
        elif f is not None:
            object.__setattr__(self, "semi_minor_axis", a if not f else a * (1 - 1 / f))
        else:
            object.__setattr__(self, "semi_minor_axis", a)
            object.__setattr__(self, "inverse_flattening", 0.0)

    @property
    def radius(self) -> float:
        return self.semi_major_axis

    def forward(self, lat, lon):
        return lon, lat

    def inverse(self, x, y):
        return y, x


@dataclass(frozen=True)
class RegularLatLon(GeogCS):
    """Latitude and longitude on the default sphere."""


@dataclass(frozen=True)
class RotatedGeogCS(CoordSystem):
    """A rotated pole: x and y are the rotated longitude and latitude in degrees."""

    grid_mapping_name: ClassVar[str | None] = "rotated_latitude_longitude"
    grid_north_pole_latitude: float = 90.0
    grid_north_pole_longitude: float = 0.0
    north_pole_grid_longitude: float = 0.0
    earth_radius: float = EARTH_RADIUS

    def forward(self, lat, lon):
        m = backend(lat, lon)
        sp, cp = math.sin(self.grid_north_pole_latitude * RAD), math.cos(self.grid_north_pole_latitude * RAD)
        d = (lon - self.grid_north_pole_longitude) * RAD
        phi = lat * RAD
        r = m.asin(m.clip(m.sin(phi) * sp + m.cos(phi) * m.cos(d) * cp, -1.0, 1.0))
        s = m.atan2(m.cos(phi) * m.sin(d) * -1.0, m.sin(phi) * cp - m.cos(phi) * m.cos(d) * sp)
        return m.wrap(s * DEG + self.north_pole_grid_longitude), r * DEG

    def inverse(self, x, y):
        m = backend(x, y)
        sp, cp = math.sin(self.grid_north_pole_latitude * RAD), math.cos(self.grid_north_pole_latitude * RAD)
        s = (x - self.north_pole_grid_longitude) * RAD
        r = y * RAD
        lat = m.asin(m.clip(m.sin(r) * sp + m.cos(r) * m.cos(s) * cp, -1.0, 1.0))
        lon = m.atan2(m.cos(r) * m.sin(s), m.cos(r) * m.cos(s) * sp - m.sin(r) * cp)
        return lat * DEG, m.wrap(lon * DEG + (self.grid_north_pole_longitude + 180.0))


@dataclass(frozen=True)
class TransverseMercator(CoordSystem):
    grid_mapping_name: ClassVar[str | None] = "transverse_mercator"
    aliases: ClassVar[dict[str, str]] = {"scale_factor_at_central_meridian": "scale_factor"}
    latitude_of_projection_origin: float = 0.0
    longitude_of_central_meridian: float = 0.0
    false_easting: float = 0.0
    false_northing: float = 0.0
    scale_factor: float = 1.0
    earth_radius: float = EARTH_RADIUS

    def forward(self, lat, lon):
        m = backend(lat, lon)
        k = self.radius * self.scale_factor
        d, phi = (m.wrap(lon - self.longitude_of_central_meridian)) * RAD, lat * RAD
        x = m.atanh(m.cos(phi) * m.sin(d)) * k
        y = (m.atan2(m.sin(phi), m.cos(phi) * m.cos(d)) - self.latitude_of_projection_origin * RAD) * k
        return x + self.false_easting, y + self.false_northing

    def inverse(self, x, y):
        m = backend(x, y)
        k = self.radius * self.scale_factor
        u = (x - self.false_easting) / k
        v = (y - self.false_northing) / k + self.latitude_of_projection_origin * RAD
        lat = m.asin(m.clip(m.sin(v) / m.cosh(u), -1.0, 1.0)) * DEG
        return lat, m.wrap(m.atan2(m.sinh(u), m.cos(v)) * DEG + self.longitude_of_central_meridian)


@dataclass(frozen=True)
class Mercator(CoordSystem):
    grid_mapping_name: ClassVar[str | None] = "mercator"
    aliases: ClassVar[dict[str, str]] = {"longitude_of_projection_origin": "longitude_of_central_meridian"}
    longitude_of_central_meridian: float = 0.0
    standard_parallel: float = 0.0
    false_easting: float = 0.0
    false_northing: float = 0.0
    earth_radius: float = EARTH_RADIUS

    def forward(self, lat, lon):
        m = backend(lat, lon)
        k = self.radius * math.cos(self.standard_parallel * RAD)
        x = m.wrap(lon - self.longitude_of_central_meridian) * RAD * k
        y = m.atanh(m.sin(lat * RAD)) * k
        return x + self.false_easting, y + self.false_northing

    def inverse(self, x, y):
        m = backend(x, y)
        k = self.radius * math.cos(self.standard_parallel * RAD)
        lat = m.atan(m.sinh((y - self.false_northing) / k)) * DEG
        return lat, m.wrap((x - self.false_easting) / k * DEG + self.longitude_of_central_meridian)


@dataclass(frozen=True)
class WebMercator(Mercator):
    """Spherical Mercator on the WGS 84 semi-major axis (EPSG 3857)."""

    grid_mapping_name: ClassVar[str | None] = None
    earth_radius: float = 6378137.0


class _Azimuthal(CoordSystem):
    """Shared geometry of the azimuthal family: a radial function of the angular distance."""

    def _centre(self) -> tuple[float, float]:
        return self.latitude_of_projection_origin, self.longitude_of_projection_origin

    def _scale(self, m, cos_c):
        raise NotImplementedError

    def _angle(self, m, rho):
        raise NotImplementedError

    def forward(self, lat, lon):
        m = backend(lat, lon)
        lat0, lon0 = self._centre()
        s0, c0 = math.sin(lat0 * RAD), math.cos(lat0 * RAD)
        d, phi = (lon - lon0) * RAD, lat * RAD
        cos_c = m.sin(phi) * s0 + m.cos(phi) * m.cos(d) * c0
        k = self._scale(m, cos_c)
        x = k * m.cos(phi) * m.sin(d)
        y = k * (m.sin(phi) * c0 - m.cos(phi) * m.cos(d) * s0)
        return x + getattr(self, "false_easting", 0.0), y + getattr(self, "false_northing", 0.0)

    def inverse(self, x, y):
        m = backend(x, y)
        lat0, lon0 = self._centre()
        s0, c0 = math.sin(lat0 * RAD), math.cos(lat0 * RAD)
        x, y = x - getattr(self, "false_easting", 0.0), y - getattr(self, "false_northing", 0.0)
        rho = m.sqrt(x * x + y * y)
        c = self._angle(m, rho)
        near = m.where(rho > 0, rho, 1.0)
        lat = m.where(rho > 0, m.asin(m.clip(m.cos(c) * s0 + y * m.sin(c) * c0 / near, -1.0, 1.0)), lat0 * RAD)
        lon = m.atan2(x * m.sin(c), rho * m.cos(c) * c0 - y * m.sin(c) * s0)
        return lat * DEG, m.wrap(lon * DEG + lon0)


@dataclass(frozen=True)
class Orthographic(_Azimuthal):
    grid_mapping_name: ClassVar[str | None] = "orthographic"
    latitude_of_projection_origin: float = 0.0
    longitude_of_projection_origin: float = 0.0
    earth_radius: float = EARTH_RADIUS

    def _scale(self, m, cos_c):
        return m.where(cos_c >= 0, self.radius, math.nan)

    def _angle(self, m, rho):
        return m.asin(rho / self.radius)


@dataclass(frozen=True)
class Stereographic(_Azimuthal):
    grid_mapping_name: ClassVar[str | None] = "stereographic"
    aliases: ClassVar[dict[str, str]] = {"standard_parallel": "true_scale_lat", "scale_factor_at_projection_origin": "scale_factor"}
    latitude_of_projection_origin: float = 0.0
    longitude_of_projection_origin: float = 0.0
    false_easting: float = 0.0
    false_northing: float = 0.0
    true_scale_lat: float | None = None
    scale_factor: float = 1.0
    earth_radius: float = EARTH_RADIUS

    def _k0(self) -> float:
        return self.scale_factor if self.true_scale_lat is None else (1 + math.sin(abs(self.true_scale_lat) * RAD)) / 2

    def _scale(self, m, cos_c):
        return 2 * self.radius * self._k0() / (cos_c + 1.0)

    def _angle(self, m, rho):
        return m.atan(rho / (2 * self.radius * self._k0())) * 2.0


@dataclass(frozen=True)
class LambertAzimuthalEqualArea(_Azimuthal):
    grid_mapping_name: ClassVar[str | None] = "lambert_azimuthal_equal_area"
    latitude_of_projection_origin: float = 0.0
    longitude_of_projection_origin: float = 0.0
    false_easting: float = 0.0
    false_northing: float = 0.0
    earth_radius: float = EARTH_RADIUS

    def _scale(self, m, cos_c):
        return m.sqrt(2.0 / (cos_c + 1.0)) * self.radius

    def _angle(self, m, rho):
        return m.asin(rho / (2 * self.radius)) * 2.0


@dataclass(frozen=True)
class VerticalPerspective(_Azimuthal):
    grid_mapping_name: ClassVar[str | None] = "vertical_perspective"
    latitude_of_projection_origin: float = 0.0
    longitude_of_projection_origin: float = 0.0
    perspective_point_height: float = 35785831.0
    false_easting: float = 0.0
    false_northing: float = 0.0
    earth_radius: float = EARTH_RADIUS

    def _p(self) -> float:
        return 1 + self.perspective_point_height / self.radius

    def _scale(self, m, cos_c):
        p = self._p()
        return m.where(cos_c >= 1 / p, (p - 1) * self.radius / (p - cos_c), math.nan)

    def _angle(self, m, rho):
        p = self._p()
        q = rho / self.radius
        root = m.sqrt(1.0 - q * q * (p + 1) / (p - 1))
        near = m.where(q > 0, q, 1.0)
        return m.where(q > 0, m.asin(m.clip((p - root) / ((p - 1) / near + near / (p - 1)), -1.0, 1.0)), 0.0)


@dataclass(frozen=True)
class Geostationary(CoordSystem):
    """A view from above the equator; x and y are scan angles times the height."""

    grid_mapping_name: ClassVar[str | None] = "geostationary"
    aliases: ClassVar[dict[str, str]] = {"sweep_angle_axis": "sweep"}
    longitude_of_projection_origin: float = 0.0
    perspective_point_height: float = 35785831.0
    sweep: str = "y"
    latitude_of_projection_origin: float = 0.0
    false_easting: float = 0.0
    false_northing: float = 0.0
    earth_radius: float = EARTH_RADIUS

    def __post_init__(self) -> None:
        if self.latitude_of_projection_origin != 0:
            raise ValueError("a geostationary view has its origin on the equator")
        if self.sweep not in ("x", "y"):
            raise ValueError("sweep is x or y")

    def forward(self, lat, lon):
        m = backend(lat, lon)
        h, big = self.perspective_point_height, self.perspective_point_height + self.radius
        d, phi = (lon - self.longitude_of_projection_origin) * RAD, lat * RAD
        vx, vy, vz = m.cos(phi) * m.cos(d) * self.radius, m.cos(phi) * m.sin(d) * self.radius, m.sin(phi) * self.radius
        depth = big - vx
        seen = vx * big >= self.radius**2
        if self.sweep == "x":
            x, y = m.atan2(vy, m.sqrt(depth * depth + vz * vz)), m.atan2(vz, depth)
        else:
            x, y = m.atan2(vy, depth), m.atan2(vz, m.sqrt(depth * depth + vy * vy))
        return m.where(seen, x * h, math.nan) + self.false_easting, m.where(seen, y * h, math.nan) + self.false_northing

    def inverse(self, x, y):
        m = backend(x, y)
        h, big = self.perspective_point_height, self.perspective_point_height + self.radius
        a, b = (x - self.false_easting) / h, (y - self.false_northing) / h
        if self.sweep == "x":
            dx, dy, dz = m.cos(a) * m.cos(b), m.sin(a), m.cos(a) * m.sin(b)
        else:
            dx, dy, dz = m.cos(a) * m.cos(b), m.sin(a) * m.cos(b), m.sin(b)
        along = dx * big
        r = along - m.sqrt(along * along - (big**2 - self.radius**2))
        vx, vy, vz = big - dx * r, dy * r, dz * r
        lat = m.asin(m.clip(vz / self.radius, -1.0, 1.0)) * DEG
        return lat, m.wrap(m.atan2(vy, vx) * DEG + self.longitude_of_projection_origin)


@dataclass(frozen=True)
class LambertConformal(CoordSystem):
    grid_mapping_name: ClassVar[str | None] = "lambert_conformal_conic"
    aliases: ClassVar[dict[str, str]] = {"standard_parallel": "secant_latitudes"}
    latitude_of_projection_origin: float = 39.0
    longitude_of_central_meridian: float = -96.0
    false_easting: float = 0.0
    false_northing: float = 0.0
    secant_latitudes: tuple[float, ...] = (33.0, 45.0)
    earth_radius: float = EARTH_RADIUS

    @property
    def cutoff(self) -> int:
        """Latitude beyond which the cone isn't used."""
        return -30 if self.latitude_of_projection_origin > 0 else 30

    def _cone(self) -> tuple[float, float, float]:
        p1, p2 = self.secant_latitudes[0] * RAD, self.secant_latitudes[-1] * RAD
        t = lambda p: math.tan(math.pi / 4 + p / 2)
        n = math.sin(p1) if abs(p1 - p2) < 1e-12 else math.log(math.cos(p1) / math.cos(p2)) / math.log(t(p2) / t(p1))
        f = self.radius * math.cos(p1) * t(p1) ** n / n
        return n, f, f / t(self.latitude_of_projection_origin * RAD) ** n

    def forward(self, lat, lon):
        m = backend(lat, lon)
        n, f, rho0 = self._cone()
        rho = f / m.power(m.tan(lat * RAD / 2.0 + math.pi / 4), m.const(n))
        theta = m.wrap(lon - self.longitude_of_central_meridian) * RAD * n
        return rho * m.sin(theta) + self.false_easting, rho0 - rho * m.cos(theta) + self.false_northing

    def inverse(self, x, y):
        m = backend(x, y)
        n, f, rho0 = self._cone()
        s = math.copysign(1.0, n)
        x, y = x - self.false_easting, rho0 - (y - self.false_northing)
        rho = m.sqrt(x * x + y * y) * s
        theta = m.atan2(x * s, y * s)
        lat = m.atan(m.power(f / rho, m.const(1 / n))) * 2.0 - math.pi / 2
        return lat * DEG, m.wrap(theta / n * DEG + self.longitude_of_central_meridian)


@dataclass(frozen=True)
class AlbersEqualArea(CoordSystem):
    grid_mapping_name: ClassVar[str | None] = "albers_conical_equal_area"
    aliases: ClassVar[dict[str, str]] = {"standard_parallel": "standard_parallels"}
    latitude_of_projection_origin: float = 0.0
    longitude_of_central_meridian: float = 0.0
    false_easting: float = 0.0
    false_northing: float = 0.0
    standard_parallels: tuple[float, ...] = (20.0, 50.0)
    earth_radius: float = EARTH_RADIUS

    def _cone(self) -> tuple[float, float, float]:
        p1, p2 = self.standard_parallels[0] * RAD, self.standard_parallels[-1] * RAD
        n = (math.sin(p1) + math.sin(p2)) / 2
        c = math.cos(p1) ** 2 + 2 * n * math.sin(p1)
        return n, c, self.radius * math.sqrt(c - 2 * n * math.sin(self.latitude_of_projection_origin * RAD)) / n

    def forward(self, lat, lon):
        m = backend(lat, lon)
        n, c, rho0 = self._cone()
        rho = m.sqrt(c - m.sin(lat * RAD) * (2 * n)) * (self.radius / n)
        theta = m.wrap(lon - self.longitude_of_central_meridian) * RAD * n
        return rho * m.sin(theta) + self.false_easting, rho0 - rho * m.cos(theta) + self.false_northing

    def inverse(self, x, y):
        m = backend(x, y)
        n, c, rho0 = self._cone()
        s = math.copysign(1.0, n)
        x, y = x - self.false_easting, rho0 - (y - self.false_northing)
        q = (x * x + y * y) * (n / self.radius) ** 2
        lat = m.asin(m.clip((c - q) / (2 * n), -1.0, 1.0)) * DEG
        return lat, m.wrap(m.atan2(x * s, y * s) / n * DEG + self.longitude_of_central_meridian)


@dataclass(frozen=True)
class PolarStereographic(CoordSystem):
    """The two polar stereographic grids named by EPSG code; the Hughes ellipsoid for 3411 and 3412."""

    grid_mapping_name: ClassVar[str | None] = "polar_stereographic"
    srid: int = 3412

    # Semi-major axis, inverse flattening, true-scale latitude, central meridian.
    _GRIDS: ClassVar[dict[int, tuple[float, float, float, float]]] = {
        3411: (6378273.0, 298.279411123064, 70.0, -45.0),
        3412: (6378273.0, 298.279411123064, -70.0, 0.0),
        3413: (6378137.0, 298.257223563, 70.0, -45.0),
        3031: (6378137.0, 298.257223563, -71.0, 0.0),
    }

    def __post_init__(self) -> None:
        if self.srid not in self._GRIDS:
            raise ValueError(f"unknown polar stereographic grid: EPSG {self.srid}")

    def _set(self) -> tuple[float, float, float, float, float, float]:
        a, inv_f, ts, lon0 = self._GRIDS[self.srid]
        f = 1 / inv_f
        e = math.sqrt(2 * f - f * f)
        pole = math.copysign(1.0, ts)
        p = abs(ts) * RAD
        t = math.tan(math.pi / 4 - p / 2) / ((1 - e * math.sin(p)) / (1 + e * math.sin(p))) ** (e / 2)
        return a, e, pole, lon0, t, math.cos(p) / math.sqrt(1 - (e * math.sin(p)) ** 2)

    def forward(self, lat, lon):
        m = backend(lat, lon)
        a, e, pole, lon0, tc, mc = self._set()
        phi, d = lat * (RAD * pole), (lon - lon0) * (RAD * pole)
        es = m.sin(phi) * e
        t = m.tan(math.pi / 4 - phi / 2.0) / m.power((1.0 - es) / (es + 1.0), m.const(e / 2))
        rho = t * (a * mc / tc)
        return rho * m.sin(d) * pole, rho * m.cos(d) * -pole

    def inverse(self, x, y):
        m = backend(x, y)
        a, e, pole, lon0, tc, mc = self._set()
        x, y = x * pole, y * pole
        t = m.sqrt(x * x + y * y) * (tc / (a * mc))
        chi = math.pi / 2 - m.atan(t) * 2.0
        phi = chi
        for _ in range(6):
            es = m.sin(phi) * e
            phi = math.pi / 2 - m.atan(t * m.power((1.0 - es) / (es + 1.0), m.const(e / 2))) * 2.0
        return phi * (DEG * pole), m.wrap(m.atan2(x, y * -1.0) * (DEG * pole) + lon0)


@dataclass(frozen=True)
class CurvilinearGrid(CoordSystem):
    """No formula: latitude and longitude stand in a cell table."""

    grid_mapping_name: ClassVar[str | None] = "curvilinear_grid"


SYSTEMS: tuple[type[CoordSystem], ...] = (
    GeogCS, RegularLatLon, RotatedGeogCS, TransverseMercator, WebMercator, PolarStereographic, Orthographic, VerticalPerspective,
    Geostationary, Stereographic, LambertConformal, Mercator, LambertAzimuthalEqualArea, AlbersEqualArea, CurvilinearGrid,
)
_BY_NAME = {c.grid_mapping_name: c for c in reversed(SYSTEMS) if c.grid_mapping_name}


def parse_crs(attrs: dict[str, Any] | str | None) -> CoordSystem | None:
    """A system from CF grid-mapping attributes (or their JSON).

    Null gives the default latitude/longitude system, an unknown mapping name None. The name may have the
    prefix ``crs_`` or stand in ``name``, as ``to_dict`` writes it. Attributes that a class doesn't know are ignored.
    """
    if attrs is None:
        return RegularLatLon()
    if isinstance(attrs, str):
        try:
            attrs = json.loads(attrs)
        except ValueError:
            return None
    if not isinstance(attrs, dict):
        return None
    name = str(attrs.get("grid_mapping_name") or attrs.get("name") or "latitude_longitude")
    kind = _BY_NAME.get(name.removeprefix("crs_"))
    if kind is None:
        return None
    known = {f.name for f in fields(kind)}
    given = {}
    for key, value in attrs.items():
        key = kind.aliases.get(key, key)
        if key in known and value is not None:
            given[key] = tuple(value) if isinstance(value, (list, tuple)) else value
    for pair in ("secant_latitudes", "standard_parallels"):
        if pair in given and not isinstance(given[pair], tuple):
            given[pair] = (given[pair],)
    return kind(**given)

"""A domain: named coordinates, a reference system and a type. All of it is on the driver."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import replace
from enum import Enum
from typing import Any

import numpy as np

from fieldloom.crs.systems import CoordSystem, CurvilinearGrid, GeogCS, RegularLatLon, parse_crs
from fieldloom.meta.axis import Axis, AxisType
from fieldloom.meta.coordinate import Coordinate, CoordinateType


class DomainType(Enum):
    GRIDDED = "gridded"
    POINTS = "points"
    TIMESERIES = "timeseries"


class Domain:
    """Immutable; the last coordinate of a kind is the one that the kind names."""

    def __init__(self, coords: dict[str, Any] | list[Coordinate], crs: CoordSystem | None = None, domaintype: DomainType | None = None) -> None:
        items = coords if isinstance(coords, list) else [self._coordinate(k, v) for k, v in coords.items()]
        self._coords = {c.name: c for c in items}
        self._by_axis = {c.axis: c.name for c in items}
        if crs is None:
            crs = CurvilinearGrid() if any(c.ncvar in ("nav_lat", "nav_lon") for c in items) else RegularLatLon()
        self.crs, self.type = crs, domaintype

    @staticmethod
    def _coordinate(name: str, given: Any) -> Coordinate:
        if isinstance(given, Coordinate):
            if given.name == name:
                return given
            return replace(given, name=name, dims=tuple(name if d == given.name else d for d in given.dims))
        if isinstance(given, tuple):
            dims, values, bounds, units, properties, encoding = (*given, *[None] * (6 - len(given)))
            dims = (dims,) if isinstance(dims, (str, Axis, AxisType)) else tuple(dims or ())
            return Coordinate(name, np.asarray(values), tuple(Axis.of(d).name for d in dims), None, units, bounds, properties or {}, encoding or {})
        values = np.asarray(given)
        return Coordinate(name, values, (name,) if values.ndim else ())

    @classmethod
    def from_attrs(cls, coords: dict[str, Any], grid_mapping: dict[str, Any] | None, domaintype: DomainType | None = None) -> Domain:
        return cls(coords, None if grid_mapping is None else parse_crs(grid_mapping), domaintype)

    # lookup -------------------------------------------------------------
    def __getitem__(self, key: Any) -> Coordinate:
        found = self.get(key)
        if found is None:
            raise KeyError(f"no coordinate {key!r}")
        return found

    def get(self, key: Any, default: Coordinate | None = None) -> Coordinate | None:
        """By name, then by kind."""
        if isinstance(key, str) and key in self._coords:
            return self._coords[key]
        kind = AxisType.infer(key)
        if kind is AxisType.GENERIC:
            return self._coords.get(getattr(key, "name", key), default) if isinstance(key, (str, Axis)) else default
        return self._coords.get(self._by_axis.get(kind, ""), default)

    def __contains__(self, key: Any) -> bool:
        return self.get(key) is not None

    def __iter__(self) -> Iterator[Coordinate]:
        return iter(self._coords.values())

    def __len__(self) -> int:
        return len(self._coords)

    def __repr__(self) -> str:
        return f"Domain({', '.join(f'{c.name}{list(c.values.shape)}' for c in self)}; {type(self.crs).__name__})"

    @property
    def coords(self) -> dict[str, Coordinate]:
        return dict(self._coords)

    latitude = property(lambda self: self[AxisType.LATITUDE])
    longitude = property(lambda self: self[AxisType.LONGITUDE])
    vertical = property(lambda self: self[AxisType.VERTICAL])
    time = property(lambda self: self[AxisType.TIME])
    x = property(lambda self: self[AxisType.X])
    y = property(lambda self: self[AxisType.Y])

    @property
    def aux_coords(self) -> list[str]:
        return [c.name for c in self if not c.is_dim]

    @property
    def is_latlon_independent(self) -> bool:
        """Both are dimensions of their own; a single label counts as one."""
        return all(c.type is not CoordinateType.DEPENDENT for c in (self.latitude, self.longitude))

    @property
    def nbytes(self) -> int:
        return sum(c.values.nbytes + (0 if c.bounds is None else c.bounds.nbytes) for c in self)

    def __eq__(self, other: object) -> bool:
        if not isinstance(other, Domain) or self.crs != other.crs or set(self._coords) != set(other._coords):
            return False
        for name, a in self._coords.items():
            b = other._coords[name]
            if a.values.shape != b.values.shape:
                return False
            if not (np.array_equal(a.values, b.values) if a.values.dtype.kind not in "iuf" else np.allclose(a.values, b.values)):
                return False
        return True

    __hash__ = None  # type: ignore[assignment]

    # changes ------------------------------------------------------------
    def with_coords(self, *changed: Coordinate, drop: tuple[str, ...] = (), crs: CoordSystem | None = None, domaintype: DomainType | None = None) -> Domain:
        coords = {k: v for k, v in self._coords.items() if k not in drop}
        coords |= {c.name: c for c in changed}
        return Domain(list(coords.values()), crs or self.crs, domaintype or self.type)

    def compute_bounds(self, coordinate: str | None = None, force: bool = False) -> Domain:
        """A domain of which latitude and longitude (or one of them) have cell bounds."""
        if not isinstance(self.crs, GeogCS):
            raise NotImplementedError(f"cell bounds of {type(self.crs).__name__}")
        keys = ("latitude", "longitude") if coordinate is None else (coordinate,)
        if not set(keys) <= {"latitude", "longitude"}:
            raise NotImplementedError("only latitude and longitude have computed bounds")
        return self.with_coords(*[replace(self[k], bounds=self[k].cell_bounds()) for k in keys if self[k].bounds is None or force])

    def resolution(self) -> tuple[float, float]:
        """Most frequent (longitude, latitude) spacing."""
        return self.longitude.resolution, self.latitude.resolution

    def with_latlon(self) -> Domain:
        """Adds 2-d latitude and longitude from x and y of a projected system, where they are missing."""
        if AxisType.LATITUDE in self and AxisType.LONGITUDE in self or isinstance(self.crs, (GeogCS, CurvilinearGrid)) or AxisType.X not in self or AxisType.Y not in self:
            return self
        x, y = self.x, self.y
        gx, gy = np.meshgrid(x.values, y.values)
        lat, lon = self.crs.inverse(gx, gy)
        return self.with_coords(Coordinate("latitude", lat, (y.name, x.name)), Coordinate("longitude", lon, (y.name, x.name)))

    @staticmethod
    def merge(domains: list[Domain]) -> Domain:
        """All coordinates, the last of a name; they must share one system."""
        coords: dict[str, Coordinate] = {}
        for d in domains:
            if d.crs != domains[0].crs:
                raise ValueError("domains of different reference systems can't be merged")
            coords |= d.coords
        return Domain(list(coords.values()), domains[0].crs, domains[-1].type)

    def to_dict(self, unique_values: bool = False) -> dict[str, Any]:
        return {"crs": self.crs.to_dict(), "coordinates": {c.name: c.to_dict(unique_values) for c in self}}


def _axis_pair(lat: Any, lon: Any, vertical: Any = None) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    return np.atleast_1d(np.asarray(lat, float)), np.atleast_1d(np.asarray(lon, float)), None if vertical is None else np.atleast_1d(np.asarray(vertical, float))


def GeodeticPoints(latitude: Any, longitude: Any, vertical: Any = None) -> Domain:  # noqa: N802
    """Target points: coordinates that share the dimension ``points``."""
    lat, lon, vert = _axis_pair(latitude, longitude, vertical)
    coords = {"latitude": ("points", lat), "longitude": ("points", lon)} | ({} if vert is None else {"vertical": ("points", vert)})
    if any(len(v[1]) != len(lat) for v in coords.values()):
        raise ValueError("points need as many latitudes as longitudes")
    return Domain(coords, RegularLatLon(), DomainType.POINTS)


def GeodeticGrid(latitude: Any, longitude: Any, vertical: Any = None) -> Domain:  # noqa: N802
    """A target grid of independent coordinates on the default sphere."""
    lat, lon, vert = _axis_pair(latitude, longitude, vertical)
    coords = {"latitude": lat, "longitude": lon} | ({} if vert is None else {"vertical": vert})
    return Domain(coords, RegularLatLon(), DomainType.GRIDDED)

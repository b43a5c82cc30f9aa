"""Coordinates: small label arrays that live on the driver."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from enum import Enum
from typing import Any

import numpy as np
import pandas as pd

from fieldloom.meta.axis import AxisType, LatitudeConvention, LongitudeConvention
from fieldloom.meta.naming import to_json_value


class CoordinateType(Enum):
    SCALAR = "scalar"
    INDEPENDENT = "independent"
    DEPENDENT = "dependent"


@dataclass(frozen=True)
class Coordinate:
    """Labels along ``dims``; a coordinate over its own dimension is independent."""

    name: str
    values: np.ndarray
    dims: tuple[str, ...] = ()
    axis: AxisType | None = None
    units: str | None = None
    bounds: np.ndarray | None = None
    properties: dict[str, Any] = field(default_factory=dict)
    encoding: dict[str, Any] = field(default_factory=dict)

    def __post_init__(self) -> None:
        values = np.asarray(self.values)
        values = values.astype(values.dtype.newbyteorder("="), copy=False)
        if values.dtype.kind == "M":
            values = values.astype("datetime64[us]")
        elif values.dtype.kind in "iuf" and values.dtype.kind != "f":
            values = values.astype("float64") if self.dims and self.dims == (self.name,) else values
        object.__setattr__(self, "values", values)
        kind = self.axis or AxisType.infer(self.name)
        object.__setattr__(self, "axis", kind)
        if self.units is None:
            object.__setattr__(self, "units", kind.default_units)
        if self.properties.get("_FillValue") is not None or self.encoding.get("_FillValue") is not None:
            raise ValueError(f"{self.name}: a coordinate can't have missing values")
        if values.ndim != len(self.dims):
            raise ValueError(f"{self.name}: {values.ndim} array dimensions, but dims are {self.dims}")
        if self.bounds is not None:
            object.__setattr__(self, "bounds", check_bounds(values.shape, np.asarray(self.bounds)))

    @property
    def ncvar(self) -> str:
        return self.encoding.get("name", self.name)

    @property
    def type(self) -> CoordinateType:
        if self.values.size == 1:
            return CoordinateType.SCALAR
        return CoordinateType.INDEPENDENT if self.dims == (self.name,) else CoordinateType.DEPENDENT

    @property
    def is_dim(self) -> bool:
        return self.dims == (self.name,)

    @property
    def descending(self) -> bool:
        v = self.values.ravel()
        return v.size > 1 and bool(v[0] > v[-1])

    @property
    def convention(self) -> LongitudeConvention | LatitudeConvention | None:
        if self.axis is AxisType.LONGITUDE:
            return LongitudeConvention.NEGATIVE_WEST if np.nanmin(self.values) < 0 else LongitudeConvention.POSITIVE_WEST
        if self.axis is AxisType.LATITUDE:
            return LatitudeConvention.POSITIVE_TOP if self.descending else LatitudeConvention.NEGATIVE_TOP
        return None

    @property
    def resolution(self) -> float:
        """Most frequent spacing of neighbours, without sign; the smallest of equally frequent ones."""
        steps = np.round(np.abs(np.diff(self.values.astype("float64").ravel())), 9)
        return float(pd.Series(steps).mode().iloc[0]) if len(steps) else 0.0

    def extent(self) -> tuple[Any, Any]:
        """The least and the greatest label; ValueError where there is none."""
        v = self.values.ravel()
        if not v.size:
            raise ValueError(f"{self.name} has no labels")
        return v.min(), v.max()

    def take(self, index: np.ndarray) -> Coordinate:
        """The labels at positions along an independent coordinate."""
        return replace(self, values=self.values[index], bounds=None if self.bounds is None else self.bounds[index])

    def as_scalar(self, position: int) -> Coordinate:
        return replace(self, values=np.asarray(self.values[position]), dims=(), bounds=None)

    def cell_bounds(self) -> np.ndarray:
        """(n, 2) edges: midpoints inside, half a mean step outside, clipped to the globe."""
        if self.type is not CoordinateType.INDEPENDENT:
            raise NotImplementedError("cell bounds need an independent coordinate")
        if self.axis not in (AxisType.LATITUDE, AxisType.LONGITUDE):
            raise NotImplementedError("cell bounds are of latitude and longitude")
        v = self.values.astype("float64")
        half = (v.max() - v.min()) / (v.size - 1) / 2
        sign = -1.0 if self.descending else 1.0
        edges = np.concatenate([[v[0] - sign * half], (v[:-1] + v[1:]) / 2, [v[-1] + sign * half]])
        low, high = (-90.0, 90.0) if self.axis is AxisType.LATITUDE else (0.0, 360.0) if self.convention is LongitudeConvention.POSITIVE_WEST else (-180.0, 180.0)
        edges[[0, -1]] = np.clip(edges[[0, -1]], low, high)
        return np.stack([edges[:-1], edges[1:]], axis=1)

    def time_step(self) -> tuple[str, int] | None:
        """(unit, number) of the most frequent step of a time coordinate; below a minute, whole minutes."""
        if self.axis is not AxisType.TIME or self.values.size < 2:
            return None
        step = pd.Series(self.values.ravel()).diff().mode().iloc[0]
        seconds = int(step.total_seconds())
        for unit, size in (("day", 86400), ("hour", 3600), ("minute", 60)):
            if seconds >= size and seconds % size == 0:
                return unit, seconds // size
        return "minute", max(0, seconds // 60)

    def to_dict(self, unique_values: bool = False) -> dict[str, Any]:
        v = self.values.ravel()
        text = v.dtype.kind in "OSU"
        out = {"min": v[0] if text else np.nanmin(v) if v.dtype.kind == "f" else v.min(), "max": v[-1] if text else np.nanmax(v) if v.dtype.kind == "f" else v.max(), "units": str(self.units), "axis": self.axis.name}
        step = self.time_step()
        if step:
            out |= {"time_unit": step[0], "time_step": step[1]}
        if self.axis in (AxisType.VERTICAL, AxisType.GENERIC):
            out["values"] = np.unique(v) if unique_values else v
        return to_json_value(out)


def check_bounds(shape: tuple[int, ...], bounds: np.ndarray) -> np.ndarray:
    """Edges of a scalar (2,), of N labels (N, 2) or of points (N, 4); vertices of a 2-d grid (N, M, 4), a 3-d one (N, M, L, 6)."""
    allowed = {0: [(2,)], 1: [(*shape, 2), (*shape, 4)] + ([(2,)] if shape == (1,) else []), 2: [(*shape, 4)], 3: [(*shape, 6)]}.get(len(shape), [])
    if bounds.shape not in allowed:
        raise ValueError(f"bounds of shape {bounds.shape} don't fit labels of shape {shape}")
    return bounds


class LazyCoordinate(Coordinate):
    """A coordinate over its own dimension whose labels are loaded when a verb first needs them.

    ``ends`` gives the least and the greatest label where a verb needs no others.
    """

    def __init__(self, name: str, values: Any, dims: tuple[str, ...] = (), axis: AxisType | None = None, units: str | None = None, bounds: np.ndarray | None = None, properties: dict[str, Any] | None = None, encoding: dict[str, Any] | None = None, ends: Any = None) -> None:
        kind = axis or AxisType.infer(name)
        for key, value in (("name", name), ("dims", dims), ("axis", kind), ("units", units or kind.default_units), ("bounds", bounds), ("properties", properties or {}), ("encoding", encoding or {}), ("_source", values), ("_held", None), ("_ends", ends)):
            object.__setattr__(self, key, value)

    def extent(self) -> tuple[Any, Any]:
        if self._held is None and self._ends is not None:
            object.__setattr__(self, "_ends", (lambda found: lambda: found)(self._ends()))
            return self._ends()
        return super().extent()

    @property
    def values(self) -> np.ndarray:  # type: ignore[override]
        if self._held is None:
            raw = self._source() if callable(self._source) else self._source
            object.__setattr__(self, "_held", Coordinate(self.name, raw, self.dims, self.axis, self.units, self.bounds, self.properties, self.encoding).values)
        return self._held

"""A field: one quantity in long form, with its domain. Every verb returns a new field and runs no job."""

from __future__ import annotations

import functools
import logging
import os
import tempfile
import uuid
from collections.abc import Iterable
from dataclasses import dataclass, field, replace
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldloom.core.domain import Domain, DomainType, GeodeticGrid
from fieldloom.crs.systems import CoordSystem, CurvilinearGrid, GeogCS, RegularLatLon, RotatedGeogCS
from fieldloom.functions.kdtree import nearest_rows
from fieldloom.meta.axis import AxisType, MethodType, RegridMethod
from fieldloom.meta.cell_methods import CellMethod, parse_cell_methods
from fieldloom.meta.coordinate import Coordinate, CoordinateType, LazyCoordinate
from fieldloom.meta.naming import to_json_value
from fieldloom.meta.unit import parse_unit
from fieldloom.operators import polygons, weights
from fieldloom.operators import resample as bins
from fieldloom.operators import select as choose
from fieldloom.operators.select import EmptyDataError
from fieldloom.plans.scale import broadcast_if_small

log = logging.getLogger(__name__)
VALUE = "value"
#: Labels of an axis that the driver reads from a table, at most.
MOST_LABELS = 5_000_000


def distinct_labels(df: DataFrame, dim: str) -> np.ndarray:
    """The labels of a column, sorted; ValueError for more than ``MOST_LABELS``, which are no axis."""
    found = df.select(dim).where(F.col(dim).isNotNull()).distinct().limit(MOST_LABELS + 1).toArrow().column(0)
    if len(found) > MOST_LABELS:
        raise ValueError(f"{dim} has more than {MOST_LABELS} labels; give its coordinate")
    labels = found.to_numpy()
    return np.sort(labels.astype("datetime64[us]") if labels.dtype == object else labels)


def prunable(scan: Any) -> DataFrame:
    """The frame of ``scan(within)``, which selections make anew for the labels they keep, so that a source reads only these."""
    df = scan({})
    df._scan = (scan, {}, ())  # the frame itself remembers; any frame made of it otherwise doesn't
    return df


def narrowed(df: DataFrame, dim: str, ends: tuple[Any, Any] | None, where: Column) -> DataFrame:
    """The rows of a predicate on a dimension, with ``ends`` around its labels."""
    held = getattr(df, "_scan", None)
    if held is None or ends is None:
        return df.where(where)
    scan, within, before = held
    within, before = {**within, dim: ends}, (*before, where)
    out = functools.reduce(DataFrame.where, before, scan(within))
    out._scan = (scan, within, before)
    return out


def label_ends(df: DataFrame, dim: str) -> tuple[Any, Any]:
    """The least and the greatest label of a column; ValueError where it has none."""
    low, high = df.agg(F.min(dim), F.max(dim)).first()
    if low is None:
        raise ValueError(f"{dim} has no labels")
    return low, high


def lazy_labels(df: DataFrame, dim: str) -> LazyCoordinate:
    """The distinct labels of a column as a coordinate, read when a verb needs them."""
    return LazyCoordinate(dim, lambda: distinct_labels(df, dim), (dim,), ends=lambda: label_ends(df, dim))


@dataclass(frozen=True, eq=False)
class Field:
    """``df`` has a column for each of ``dims`` and ``value``.

    A dimension with a coordinate of its own holds labels, another one positions from 0. Missing
    values are null; NaN becomes null when a field is made. A cell may have no row, which counts as
    missing.
    """

    df: DataFrame
    name: str
    dims: tuple[str, ...]
    domain: Domain
    units: str | None = None
    properties: dict[str, Any] = field(default_factory=dict)
    encoding: dict[str, Any] = field(default_factory=dict)
    cell_methods: tuple[CellMethod, ...] = ()
    ancillary: dict[str, Field] = field(default_factory=dict)
    mapping: dict[str, Any] = field(default_factory=dict)

    # construction -------------------------------------------------------
    @classmethod
    def from_dataframe(cls, df: DataFrame, name: str, dims: Iterable[str], value: str, coords: dict[str, Any] | Domain | None = None, crs: CoordSystem | None = None,
                       domaintype: DomainType | None = DomainType.GRIDDED, cell_methods: str | None = None, **meta: Any) -> Field:
        """From long form. Coordinates that aren't given are the distinct labels of their column, read when a verb needs them."""
        dims = tuple(dims)
        if isinstance(coords, Domain):
            domain = coords
        else:
            given = dict(coords or {})
            for d in dims:
                if d not in given and AxisType.infer(d) is not AxisType.GENERIC:
                    given[d] = lazy_labels(df, d)
            domain = Domain(given, crs, domaintype)
        number = F.col(value).cast("double")
        rows = df.select(*dims, F.when(~F.isnan(number), number).alias(VALUE))
        return cls(rows, name, dims, domain, cell_methods=tuple(parse_cell_methods(cell_methods)), **meta)

    @classmethod
    def from_arrays(cls, spark: SparkSession, data: Any, name: str, dims: Iterable[Any], coords: dict[str, Any] | Domain, crs: CoordSystem | None = None,
                    domaintype: DomainType | None = None, cell_methods: str | None = None, **meta: Any) -> Field:
        """From an array in memory."""
        names = tuple(getattr(d, "name", d) if not isinstance(d, AxisType) else d.value for d in dims)
        domain = coords if isinstance(coords, Domain) else Domain(coords, crs, domaintype)
        values = np.asarray(data, dtype="float64")
        if values.ndim != len(names):
            raise ValueError(f"{values.ndim} array dimensions, but dims are {names}")
        columns = {}
        for axis, d in enumerate(names):
            own = domain.get(d)
            labels = own.values if own is not None and own.is_dim else np.arange(values.shape[axis])
            if len(labels) != values.shape[axis]:
                raise ValueError(f"{d}: {len(labels)} labels for {values.shape[axis]} positions")
            shape = [1] * values.ndim
            shape[axis] = -1
            columns[d] = np.broadcast_to(labels.reshape(shape), values.shape).ravel()
        pdf = pd.DataFrame({**columns, VALUE: values.ravel()})
        schema = ", ".join(f"`{d}` {'timestamp_ntz' if pdf[d].dtype.kind == 'M' else 'double' if pdf[d].dtype.kind == 'f' else 'int' if pdf[d].dtype.kind in 'iu' else 'string'}" for d in names)
        df = spark.createDataFrame(pdf, f"{schema}{', ' if names else ''}{VALUE} double")
        return cls(df.withColumn(VALUE, F.when(~F.isnan(VALUE), F.col(VALUE))), name, names, domain, cell_methods=tuple(parse_cell_methods(cell_methods)), **meta)

    # properties ---------------------------------------------------------
    def __repr__(self) -> str:
        return f"Field({self.name}: {', '.join(self.dims)}; units {self.units}; {self.domain!r})"

    def __contains__(self, key: Any) -> bool:
        return key in self.domain

    def __getitem__(self, key: Any) -> Coordinate:
        return self.domain[key]

    def __iter__(self):
        return iter(self.domain)

    @property
    def ncvar(self) -> str:
        return self.encoding.get("name", self.name)

    latitude = property(lambda self: self.domain.latitude)
    longitude = property(lambda self: self.domain.longitude)
    vertical = property(lambda self: self.domain.vertical)
    time = property(lambda self: self.domain.time)

    @property
    def shape(self) -> tuple[int, ...]:
        return tuple(self._size(d) for d in self.dims)

    @property
    def nbytes(self) -> int:
        return 8 * int(np.prod(self.shape or (1,)))

    def _size(self, dim: str) -> int:
        own = self.domain.get(dim)
        if own is not None and own.is_dim:
            return own.values.size
        return next((c.values.shape[c.dims.index(dim)] for c in self.domain if dim in c.dims), 0)

    def _with(self, df: DataFrame, domain: Domain, dims: tuple[str, ...] | None = None, **changes: Any) -> Field:
        return replace(self, df=df, domain=domain, dims=self.dims if dims is None else dims, **changes)

    def _sampled(self, *skip: str) -> list[str]:
        return [d for d in self.dims if d not in skip]

    # selection ----------------------------------------------------------
    def _keep(self, coord: Coordinate, at: np.ndarray) -> tuple[DataFrame, Domain]:
        """Rows and domain of the kept positions of an independent coordinate."""
        where = choose.predicate(coord.name, coord.values, at)
        df = self.df
        if where is not None:
            ends = (coord.values[at].min(), coord.values[at].max()) if len(at) else None
            df = narrowed(df, coord.name, ends, where)
        return df, self.domain.with_coords(*self._cut(coord.name, at))

    def _cut(self, dim: str, at: np.ndarray) -> list[Coordinate]:
        """All coordinates along a dimension, cut to positions of it."""
        out = []
        for c in self.domain:
            if dim in c.dims:
                axis = c.dims.index(dim)
                bounds = None if c.bounds is None or c.bounds.shape[0] != c.values.shape[0] else np.take(c.bounds, at, axis=axis)
                out.append(replace(c, values=np.take(c.values, at, axis=axis), bounds=bounds))
        return out

    def geobbox(self, north: float | None = None, south: float | None = None, west: float | None = None, east: float | None = None, top: float | None = None, bottom: float | None = None, wrap: bool = False) -> Field:
        """The cells in a box; any of its sides may be open.

        Bounds are inclusive. On independent latitude and longitude they are label ranges, in the
        data's longitude convention whatever the query's is. On two-dimensional ones the result is the
        smallest rectangle of positions that encloses the cells in the box. A box with west > east is
        empty unless ``wrap``. A vertical axis that is positive down takes top and bottom as heights,
        so they change sign.
        """
        if all(v is None for v in (north, south, west, east, top, bottom)):
            raise KeyError("a box needs at least one side")
        out = self
        if top is not None or bottom is not None:
            out = out._vertical_box(top, bottom)
        if any(v is not None for v in (north, south, west, east)):
            out = out._flat_box(north, south, west, east, wrap) if out.domain.is_latlon_independent else out._rectangle(north, south, west, east)
        return out

    def _vertical_box(self, top: float | None, bottom: float | None) -> Field:
        v = self.domain.get(AxisType.VERTICAL)
        if v is None or v.type is CoordinateType.SCALAR:
            raise ValueError("a vertical box needs a vertical dimension")
        low, high = (bottom, top)
        if str(v.properties.get("positive", v.encoding.get("positive", ""))).lower() == "down":
            low, high = (None if top is None else -top), (None if bottom is None else -bottom)
        df, domain = self._keep(v, choose.box_positions(v, low, high))
        return self._with(df, domain)

    def _flat_box(self, north, south, west, east, wrap) -> Field:
        out = self
        lat, lon = self.latitude, self.longitude
        if (north is not None or south is not None) and lat.dims:
            low, high = (south, north)
            at = choose.box_positions(lat, low, high)
            if not len(at) and low is not None and high is not None:
                at = choose.box_positions(lat, high, low)
            df, domain = out._keep(lat, at)
            out = out._with(df, domain)
        if (west is not None or east is not None) and lon.dims:
            ranges = choose.longitude_ranges(lon, west, east, wrap)
            at = np.unique(np.concatenate([choose.box_positions(lon, a, b) for a, b in ranges] or [np.empty(0, np.int64)]))
            df, domain = out._keep(lon, at)
            out = out._with(df, domain)
        return out

    def _rectangle(self, north, south, west, east) -> Field:
        lat, lon = self.latitude, self.longitude
        dims = lat.dims
        lo = lon.values
        wanted = [choose.to_convention(x, lon) if x is not None else None for x in (west, east)]
        south, north = (north, south) if None not in (south, north) and south > north else (south, north)
        mask = np.ones(lat.values.shape, dtype=bool)
        for values, low, high in ((lat.values, south, north), (lo, *wanted)):
            if low is not None:
                mask &= values >= low
            if high is not None:
                mask &= values <= high
        out = self
        for axis, d in enumerate(dims):
            hit = np.flatnonzero(mask.any(axis=tuple(k for k in range(mask.ndim) if k != axis)))
            at = np.arange(hit.min(), hit.max() + 1) if len(hit) else np.empty(0, np.int64)
            own = self.domain.get(d)
            if own is not None and own.is_dim:
                df, domain = out._keep(own, at)
                out = out._with(df, domain)
            else:  # positions start anew at 0
                df = out.df.where(F.col(d).between(int(at[0]), int(at[-1])) if len(at) else F.lit(False))
                shift = int(at[0]) if len(at) else 0
                df = df.withColumn(d, (F.col(d) - shift).cast("int")) if shift else df
                out = out._with(df, out.domain.with_coords(*out._cut(d, at)))
        return out

    def sel(self, indexers: dict[Any, Any] | None = None, roll_if_needed: bool = True, method: str | None = None, tolerance: Any = None, drop: bool = False, on_missing: str = "ignore", **more: Any) -> Field:
        """Label selection: labels, lists, inclusive slices, partial dates, and components of time.

        Slices keep the order of the axis, so on a descending one they run from the greater label to
        the smaller. Axes that the field doesn't have are ignored. A label that isn't there leaves the
        field as it is (``on_missing="ignore"``) or raises KeyError (``"raise"``). A single label
        removes its dimension and leaves a scalar coordinate, unless ``drop``.
        """
        out = self
        for key, indexer in {**(indexers or {}), **more}.items():
            coord = out.domain.get(key)
            if coord is None or not coord.is_dim:
                continue
            if roll_if_needed and coord.axis is AxisType.LONGITUDE:
                if isinstance(indexer, slice):
                    at = np.unique(np.concatenate([choose.box_positions(coord, a, b) for a, b in choose.longitude_ranges(coord, *((indexer.stop, indexer.start) if coord.descending else (indexer.start, indexer.stop)))] or [np.empty(0, np.int64)]))
                    df, domain = out._keep(coord, at[:: indexer.step] if indexer.step else at)
                    out = out._with(df, domain)
                    continue
                indexer = [choose.to_convention(x, coord) for x in indexer] if isinstance(indexer, (list, tuple, np.ndarray)) else choose.to_convention(indexer, coord)
            at, scalar = choose.positions(coord, indexer, method, tolerance)
            if at is None:
                if on_missing == "raise":
                    raise KeyError(f"{coord.name}: no label {indexer!r}")
                log.warning("%s has no label %r; nothing is selected", coord.name, indexer)
                continue
            df, domain = out._keep(coord, at)
            if scalar:
                others = [replace(c, values=c.values[..., 0] if c.dims[-1] == coord.name else np.take(c.values, 0, axis=c.dims.index(coord.name)), dims=tuple(d for d in c.dims if d != coord.name), bounds=None) for c in domain if coord.name in c.dims and c.name != coord.name]
                domain = domain.with_coords(*others, *([] if drop else [coord.as_scalar(int(at[0]))]), drop=(coord.name,) if drop else ())
                out = out._with(df.drop(coord.name), domain, tuple(d for d in out.dims if d != coord.name))
            else:
                out = out._with(df, domain)
        return out

    def roll_longitude(self, negative_west: bool) -> Field:
        """The field in the other longitude convention."""
        lon = self.longitude
        if lon.type is CoordinateType.DEPENDENT:
            raise NotImplementedError("only an independent longitude is rolled")
        new = np.mod(lon.values + 180.0, 360.0) - 180.0 if negative_west else np.mod(lon.values, 360.0)
        column = F.pmod(F.col(lon.name) + 180.0, F.lit(360.0)) - 180.0 if negative_west else F.pmod(F.col(lon.name), F.lit(360.0))
        return self._with(self.df.withColumn(lon.name, column), self.domain.with_coords(replace(lon, values=np.sort(new), bounds=None)))

    # points and interpolation -------------------------------------------
    def locations(self, latitude: Any, longitude: Any, vertical: Any = None) -> Field:
        """The nearest cells of given points: one row for each point, repeated points too.

        On independent axes nearest is by each axis; on two-dimensional ones by squared degrees, the
        first of equals. Points are compared as 32-bit floats. A vertical of an axis that is positive
        down is given as a height.
        """
        lat, lon = (np.atleast_1d(np.asarray(a, dtype="float32")).astype(float) for a in (latitude, longitude))
        if len(lat) != len(lon):
            raise ValueError("points need as many latitudes as longitudes")
        source = self
        if vertical is not None:
            v = self.domain[AxisType.VERTICAL]
            down = str(v.properties.get("positive", v.encoding.get("positive", ""))).lower() == "down"
            wanted = np.atleast_1d(np.asarray(vertical, float)) * (-1.0 if down else 1.0)
            source = self.sel({v.name: [float(v.values[choose.nearest(v, w)]) for w in np.unique(wanted)]})
        clat, clon = self.latitude, self.longitude
        points = pd.DataFrame({"points": np.arange(len(lat), dtype="int32")})
        if self.domain.is_latlon_independent:
            i = [choose.nearest(replace(clat, values=np.atleast_1d(clat.values)), x) for x in lat]
            k = [choose.nearest(replace(clon, values=np.atleast_1d(clon.values)), choose.to_convention(x, replace(clon, values=np.atleast_1d(clon.values)))) for x in lon]
            rlat, rlon = np.atleast_1d(clat.values)[i], np.atleast_1d(clon.values)[k]
            keys = {c.name: values for c, values in ((clat, rlat), (clon, rlon)) if c.name in self.dims}
        else:
            flat = nearest_rows(np.stack([clat.values.ravel(), clon.values.ravel()], axis=1), np.stack([lat, lon], axis=1))
            at = np.unravel_index(flat, clat.values.shape)
            rlat, rlon = clat.values[at], clon.values[at]
            keys = {}
            for d, positions in zip(clat.dims, at):
                own = self.domain.get(d)
                keys[d] = own.values[positions] if own is not None and own.is_dim else positions.astype("int32")
        for d, values in keys.items():
            points[d] = values
        small = broadcast_if_small(self.df.sparkSession.createDataFrame(points))
        rows = source.df
        for d, values in keys.items():  # unlike the join, these reach the scan
            wanted = np.unique(values)
            rows = rows.where(F.col(d).isin(wanted.tolist()) if len(wanted) <= 1000 else F.col(d).between(wanted.min().item(), wanted.max().item()))
        rows = rows.join(small, list(keys)) if keys else rows.withColumn("points", F.lit(0))
        others = tuple(d for d in source.dims if d not in keys)
        kept = [c for c in source.domain if not set(c.dims) & set(keys) and c.axis not in (AxisType.LATITUDE, AxisType.LONGITUDE)]
        domain = Domain([*kept, Coordinate("latitude", rlat, ("points",)), Coordinate("longitude", rlon, ("points",))], RegularLatLon(), DomainType.POINTS)
        return source._with(rows.select(*others, "points", VALUE), domain, (*others, "points"))

    def interpolate(self, domain: Domain, method: str = "nearest") -> Field:
        """Values at the points or on the grid of a domain, by ``nearest`` or ``linear``; null outside the labels.

        A projected source is interpolated along its own x and y, into which the targets are transformed.
        """
        if method not in ("nearest", "linear"):
            raise NotImplementedError(f"interpolation by {method!r}")
        make = weights.nearest_weights if method == "nearest" else weights.linear_weights
        projected = AxisType.LATITUDE not in self.domain or not self.domain.is_latlon_independent or self.latitude.name not in self.dims
        if projected and isinstance(self.domain.crs, CurvilinearGrid):
            raise NotImplementedError("a curvilinear grid has no formula; use locations or regrid by nearest_s2d")
        cy, cx = (self.domain.y, self.domain.x) if projected else (self.latitude, self.longitude)
        tlat, tlon = domain.latitude.values.astype(float), domain.longitude.values.astype(float)
        rest = [c for c in self.domain if not set(c.dims) & {cy.name, cx.name} and c.axis not in (AxisType.LATITUDE, AxisType.LONGITUDE)]
        if domain.type is not DomainType.POINTS and not projected:
            tx = np.array([choose.to_convention(x, cx) for x in tlon])
            rows = weights.apply_separable(self.df, VALUE, list(self.dims), cy.name, cx.name, make(cy.values, tlat), make(cx.values, tx), tlat, tlon)
            new = [replace(cy, values=tlat, bounds=None), replace(cx, values=tlon, bounds=None)]
            return self._with(rows, Domain([*rest, *new], domain.crs, DomainType.GRIDDED))
        gridded = domain.type is not DomainType.POINTS
        glat, glon = np.meshgrid(tlat, tlon, indexing="ij") if gridded else (tlat, tlon)
        glat, glon = glat.ravel(), glon.ravel()
        if projected:
            px, py = self.domain.crs.forward(glat, glon)
        else:
            px, py = np.array([choose.to_convention(x, cx) for x in glon]), glat
        wy, wx = make(cy.values, py), make(cx.values, px)
        pairs = wy.merge(wx, on="t", suffixes=("y", "x"))
        table = pd.DataFrame({"p": pairs["t"].astype("int32"), "sy": pairs["sy"].astype(float), "sx": pairs["sx"].astype(float), "w": pairs["wy"].astype(float) * pairs["wx"].astype(float)})
        table["n"] = table.groupby("p")["w"].transform("size").astype("int64")
        small = broadcast_if_small(weights.small_frame(self.df.sparkSession, table, "__p int, __sy double, __sx double, __w double, __n long"))
        joined = self.df.join(small, (F.col(cy.name) == F.col("__sy")) & (F.col(cx.name) == F.col("__sx")))
        others = self._sampled(cy.name, cx.name)
        product = F.col(VALUE) * F.col("__w")
        out = joined.groupBy(*others, "__p").agg(F.when(F.count(product) == F.max("__n"), F.sum(product)).alias(VALUE))
        if not gridded:
            target = Domain([*rest, Coordinate("latitude", tlat, ("points",)), Coordinate("longitude", tlon, ("points",))], domain.crs, DomainType.POINTS)
            return self._with(out.select(*others, F.col("__p").alias("points"), VALUE), target, (*others, "points"))
        cells = pd.DataFrame({"__p": np.arange(len(glat), dtype="int32"), "latitude": glat, "longitude": glon})
        out = out.join(broadcast_if_small(self.df.sparkSession.createDataFrame(cells)), "__p").select(*others, "latitude", "longitude", VALUE)
        target = Domain([*rest, Coordinate("latitude", tlat, ("latitude",)), Coordinate("longitude", tlon, ("longitude",))], domain.crs, DomainType.GRIDDED)
        return self._with(out, target, (*others, "latitude", "longitude"))

    def with_latlon(self) -> Field:
        """The field with two-dimensional latitude and longitude from its own x and y, where they are missing."""
        return self._with(self.df, self.domain.with_latlon())

    def to_regular(self) -> Field:
        """A rotated grid on a regular one of about the same spacing, by nearest cell."""
        if not isinstance(self.domain.crs, RotatedGeogCS):
            raise NotImplementedError("only a rotated pole is made regular")
        domain = self.domain.with_latlon()
        lat, lon = domain.latitude.values, domain.longitude.values
        steps = [round(float(np.ptp(c.values)) / (c.values.size - 1), 2) for c in (domain.y, domain.x)]
        axis = lambda v, s: np.arange(v.min(), v.max() + s / 2, s)
        return self._with(self.df, domain).interpolate(GeodeticGrid(axis(lat, steps[0]), axis(lon, steps[1])), "nearest")

    def extract_polygons(self, geometry: Any, crop: bool = True, return_mask: bool = False) -> Field | tuple[Field, np.ndarray]:
        """The cells whose centre is inside a (Multi)Polygon; others are dropped and, uncropped, null."""
        rings = polygons.rings_of(geometry)
        if self.domain.type is DomainType.POINTS:
            raise NotImplementedError("polygons are extracted from grids")
        if not isinstance(self.domain.crs, GeogCS):
            return self.to_regular().extract_polygons(geometry, crop, return_mask)
        source = self
        if crop:
            corners = np.array([p for r in rings for p in r])
            source = self.geobbox(south=corners[:, 0].min(), north=corners[:, 0].max(), west=corners[:, 1].min(), east=corners[:, 1].max())
        lat, lon = source.latitude, source.longitude
        glat, glon = np.meshgrid(np.atleast_1d(lat.values), np.atleast_1d(lon.values), indexing="ij")
        west = np.mod(glon + 180.0, 360.0) - 180.0
        mask = polygons.inside(geometry, glat, west)
        cells = pd.DataFrame({lat.name: glat[mask].astype(float), lon.name: glon[mask].astype(float)})
        small = broadcast_if_small(weights.small_frame(self.df.sparkSession, cells, f"`{lat.name}` double, `{lon.name}` double"))
        if crop:
            rows = source.df.join(small, [lat.name, lon.name], "left_semi")
        else:
            flagged = source.df.join(small.withColumn("__in", F.lit(True)), [lat.name, lon.name], "left")
            rows = flagged.withColumn(VALUE, F.when(F.col("__in"), F.col(VALUE)))
        out = source._with(rows.select(*source.dims, VALUE), source.domain)
        return (out, mask) if return_mask else out

    def regrid(self, target: Domain | Field, method: str | RegridMethod = "bilinear", weights_path: str | None = None, reuse_weights: bool = True) -> Field:
        """The field on the grid of another domain.

        bilinear, patch, nearest_s2d: interpolation from the source; conservative and
        conservative_normed: by overlap of cells, of which the bounds are computed where they are
        missing; nearest_d2s: each source cell goes to its nearest target, which adds them up. A target
        that no source covers, or that needs a missing value, is null. ``weights_path`` keeps the
        weights as Parquet and reuses them. From two-dimensional latitude and longitude, bilinear and
        patch work along the source's own x and y, and the conservative methods on four-cornered cells.
        """
        domain = target.domain if isinstance(target, Field) else target
        method = RegridMethod(method) if not isinstance(method, RegridMethod) else method
        if not isinstance(domain, Domain):
            raise TypeError("a target is a domain or a field")
        if not self.domain.is_latlon_independent:
            return self._regrid_cells(domain, method, weights_path, reuse_weights)
        cy, cx = self.latitude, self.longitude
        tlat, tlon = domain.latitude.values.astype(float), domain.longitude.values.astype(float)
        dims, y, x = list(self.dims), cy.name, cx.name
        table = None
        if weights_path and reuse_weights and os.path.exists(weights_path):
            table = pd.read_parquet(weights_path)
        if table is None:
            table = self._weights(method, domain, cy, cx, tlat, tlon)
            if weights_path:
                table.to_parquet(weights_path)
        pick = lambda axis: table[table["axis"] == axis]
        if (table["axis"] == "both").any():
            rows = weights.apply_table(self.df, VALUE, dims, y, x, pick("both").rename(columns={"t": "ti"}), tlat, tlon)
        else:
            part = {a: pick(a)[["t", "s", "w"]].reset_index(drop=True) for a in ("y", "x")}
            rows = weights.apply_separable(self.df, VALUE, dims, y, x, part["y"], part["x"], tlat, tlon)
        properties = {k: v for k, v in self.properties.items() if k != "cell_measures"}
        rest = [c for c in self.domain if c.name not in (y, x)]
        new = [replace(cy, values=tlat, bounds=domain.latitude.bounds), replace(cx, values=tlon, bounds=domain.longitude.bounds)]
        return self._with(rows, Domain([*rest, *new], domain.crs, domain.type), properties=properties)

    def _weights(self, method: RegridMethod, domain: Domain, cy: Coordinate, cx: Coordinate, tlat: np.ndarray, tlon: np.ndarray) -> pd.DataFrame:
        tx = np.array([choose.to_convention(v, cx) for v in tlon])
        if method in (RegridMethod.CONSERVATIVE, RegridMethod.CONSERVATIVE_NORMED):
            edges = lambda c: c.bounds if c.bounds is not None else c.cell_bounds()
            normed = method is RegridMethod.CONSERVATIVE_NORMED
            target_x = replace(domain.longitude, values=tx, bounds=None).cell_bounds() if not np.array_equal(tx, tlon) else edges(domain.longitude)
            wy = weights.overlap_weights(cy.values, edges(cy), edges(domain.latitude), True, normed)
            wx = weights.overlap_weights(cx.values, edges(cx), target_x, False, normed)
        elif method is RegridMethod.BILINEAR:
            wy, wx = weights.linear_weights(cy.values, tlat), weights.linear_weights(cx.values, tx)
        elif method is RegridMethod.PATCH:
            return weights.patch_weights(cy.values, cx.values, tlat, tx).rename(columns={"ti": "t"}).assign(axis="both")
        else:
            slat, slon = np.meshgrid(cy.values, cx.values, indexing="ij")
            glat, glon = np.meshgrid(tlat, tx, indexing="ij")
            if method is RegridMethod.NEAREST_S2D:
                near = weights.nearest_cells(slat, slon, glat, glon)
                i, j = np.divmod(np.arange(glat.size), len(tx))
                return pd.DataFrame({"t": i, "tj": j, "sy": slat.ravel()[near], "sx": slon.ravel()[near], "w": 1.0, "axis": "both"})
            near = weights.nearest_cells(glat, glon, slat, slon)
            i, j = np.divmod(near, len(tx))
            return pd.DataFrame({"t": i, "tj": j, "sy": slat.ravel(), "sx": slon.ravel(), "w": 1.0, "axis": "both"})
        both = [wy.assign(axis="y"), wx.assign(axis="x")]
        return pd.concat([t.astype({"w": "float64"}) for t in both], ignore_index=True)

    def _cell_corners(self) -> tuple[np.ndarray, np.ndarray]:
        """(cells, 4) latitudes and longitudes of the corners: the bounds where they are given, those of x and y in a system with a formula, else from the centres."""
        lat, lon = self.latitude, self.longitude
        if lat.bounds is not None and lon.bounds is not None and lat.bounds.shape[-1] == 4:
            return lat.bounds.reshape(-1, 4), lon.bounds.reshape(-1, 4)
        if not isinstance(self.domain.crs, (CurvilinearGrid, GeogCS)) and AxisType.X in self.domain and AxisType.Y in self.domain:
            middle = lambda v: np.concatenate([[v[0] - (v[1] - v[0]) / 2], (v[1:] + v[:-1]) / 2, [v[-1] + (v[-1] - v[-2]) / 2]])
            gx, gy = np.meshgrid(middle(self.domain.x.values.astype(float)), middle(self.domain.y.values.astype(float)))
            nodes = self.domain.crs.inverse(gx, gy)
            if lat.dims != (self.domain.y.name, self.domain.x.name):
                nodes = tuple(n.T for n in nodes)
        else:
            nodes = weights.corner_nodes(lat.values.astype(float), lon.values.astype(float))
        return tuple(np.stack([n[:-1, :-1], n[:-1, 1:], n[1:, 1:], n[1:, :-1]], axis=-1).reshape(-1, 4) for n in nodes)

    def _regrid_cells(self, domain: Domain, method: RegridMethod, weights_path: str | None, reuse_weights: bool) -> Field:
        """``regrid`` from two-dimensional latitude and longitude, by one weight table over both dimensions."""
        if method in (RegridMethod.CONSERVATIVE, RegridMethod.CONSERVATIVE_NORMED):
            if domain.type is DomainType.POINTS:
                raise NotImplementedError(f"{method.value} weights of points")
        if method is RegridMethod.BILINEAR and domain.type is DomainType.POINTS and not weights_path:
            return self.interpolate(domain, "linear")
        conservative = method in (RegridMethod.CONSERVATIVE, RegridMethod.CONSERVATIVE_NORMED)
        nearest = method in (RegridMethod.NEAREST_S2D, RegridMethod.NEAREST_D2S)
        if domain.type is DomainType.POINTS and not nearest:
            raise NotImplementedError(f"{method.value} weights of points")
        if not nearest and not conservative and isinstance(self.domain.crs, CurvilinearGrid):
            raise NotImplementedError("a curvilinear grid has no formula; use locations or regrid by nearest_s2d or nearest_d2s")
        lat, lon = self.latitude, self.longitude
        over = list(lat.dims) if nearest or conservative else [self.domain.y.name, self.domain.x.name]
        tlat, tlon = domain.latitude.values.astype(float), domain.longitude.values.astype(float)
        glat, glon = (v.ravel() for v in np.meshgrid(tlat, tlon, indexing="ij"))
        if weights_path and reuse_weights and os.path.exists(weights_path):
            table = pd.read_parquet(weights_path)
        else:
            if conservative:
                cells = weights.cell_overlaps(*self._cell_corners(), *(c.bounds if c.bounds is not None else c.cell_bounds() for c in (domain.latitude, domain.longitude)), method is RegridMethod.CONSERVATIVE_NORMED)
                own = [self.domain.get(d) for d in over]
                labels = [c.values[k] if c is not None and c.is_dim else k for c, k in zip(own, np.unravel_index(cells["s"].to_numpy(), lat.values.shape))]
                table = pd.DataFrame({"t": cells["t"], "sy": labels[0].astype(float), "sx": labels[1].astype(float), "w": cells["w"]})
            elif nearest:
                back = method is RegridMethod.NEAREST_D2S
                to = np.arange(glat.size) if not back else weights.nearest_cells(glat, glon, lat.values, lon.values)
                cells = np.arange(lat.values.size) if back else weights.nearest_cells(lat.values, lon.values, glat, glon)
                own = [self.domain.get(d) for d in over]
                labels = [c.values[k] if c is not None and c.is_dim else k for c, k in zip(own, np.unravel_index(cells, lat.values.shape))]
                table = pd.DataFrame({"t": to, "sy": labels[0].astype(float), "sx": labels[1].astype(float), "w": 1.0})
            else:
                cy, cx = self.domain.y.values, self.domain.x.values
                px, py = self.domain.crs.forward(glat, glon)
                if method is RegridMethod.BILINEAR:
                    pairs = weights.linear_weights(cy, py).merge(weights.linear_weights(cx, px), on="t", suffixes=("y", "x"))
                    table = pd.DataFrame({"t": pairs["t"], "sy": pairs["sy"].astype(float), "sx": pairs["sx"].astype(float), "w": pairs["wy"].astype(float) * pairs["wx"].astype(float)})
                else:
                    table = pd.concat([weights.patch_weights(cy, cx, np.array([a]), np.array([b])).assign(t=k) for k, (a, b) in enumerate(zip(py, px))])[["t", "sy", "sx", "w"]].astype({"sy": float, "sx": float, "w": float})
            if weights_path:
                table.to_parquet(weights_path)
        t = table["t"].to_numpy()
        rows = pd.DataFrame({"latitude": glat[t], "longitude": glon[t], "__sy": table["sy"].to_numpy(), "__sx": table["sx"].to_numpy(), "__w": table["w"].to_numpy(), "__n": table.groupby("t")["w"].transform("size").to_numpy()})
        small = broadcast_if_small(weights.small_frame(self.df.sparkSession, rows, "latitude double, longitude double, __sy double, __sx double, __w double, __n long"))
        joined = self.df.join(small, (F.col(over[0]) == F.col("__sy")) & (F.col(over[1]) == F.col("__sx")))
        others = self._sampled(*over)
        product = F.col(VALUE) * F.col("__w")
        out = joined.groupBy(*others, "latitude", "longitude").agg(F.when(F.count(product) == F.max("__n"), F.sum(product)).alias(VALUE))
        rest = [c for c in self.domain if not set(c.dims) & set(over) and c.axis not in (AxisType.LATITUDE, AxisType.LONGITUDE)]
        new = [Coordinate("latitude", tlat, ("latitude",)), Coordinate("longitude", tlon, ("longitude",))]
        return self._with(out, Domain([*rest, *new], domain.crs, domain.type), (*others, "latitude", "longitude"))

    # aggregation --------------------------------------------------------
    def resample(self, operator: str | MethodType, frequency: str, gaps: bool = True, empty_sum: float | None = None, **_ignored: Any) -> Field:
        """Calendar bins of time by max, min, sum, mean, median, var or std, or by a function of an array; nulls don't count.

        Bins in a gap are kept and are null (``empty_sum`` for sums); ``gaps=False`` leaves them out.
        """
        if isinstance(operator, MethodType) or not callable(operator):
            if MethodType(operator if not isinstance(operator, MethodType) else operator.value[0]) not in bins.AGGREGATES:
                raise NotImplementedError(f"no resampling by {operator!r}")
        time = self.time
        if time.name not in self.dims:
            raise ValueError("resampling needs a time dimension")
        first, last = map(pd.Timestamp, time.extent())
        rows = bins.resample(self.df, time.name, list(self.dims), VALUE, operator, frequency, first, last, gaps, empty_sum)
        ends = np.array([first, last], dtype="datetime64[us]")
        new = LazyCoordinate(time.name, lambda: bins.bins_of(ends, frequency), time.dims, time.axis, time.units, None, time.properties, time.encoding)
        return self._with(rows.select(*self.dims, VALUE), self.domain.with_coords(new))

    def average(self, dim: Any = None) -> Field:
        """Unweighted mean over one dimension, or over all; nulls don't count."""
        if dim is None:
            return self._with(self.df.agg(F.avg(VALUE).alias(VALUE)), Domain([c for c in self.domain if not c.dims], self.domain.crs, self.domain.type), ())
        coord = self.domain.get(dim)
        name = coord.name if coord is not None else str(dim)
        if name not in self.dims or (coord is not None and not coord.is_dim):
            raise ValueError(f"{name!r} isn't a dimension of {self.name}")
        others = tuple(d for d in self.dims if d != name)
        domain = self.domain.with_coords(drop=tuple(c.name for c in self.domain if name in c.dims))
        return self._with(self.df.groupBy(*others).agg(F.avg(VALUE).alias(VALUE)), domain, others)

    def reduce(self, operator: str, dims: Iterable[str] | None = None) -> Field:
        """One of max, min, sum, mean, median, var, std, prod, count, any, all, argmax, argmin over dimensions (all by default); of equal extremes the least label is taken."""
        over = self.dims if dims is None else tuple(dims)
        more = {"prod": F.product(VALUE), "count": F.count(VALUE).cast("double"), "any": F.max((F.col(VALUE) != 0).cast("double")), "all": F.min((F.col(VALUE) != 0).cast("double"))}
        if operator in ("argmax", "argmin"):
            if len(over) != 1:
                raise ValueError("the position of an extreme is along one dimension")
            ordered = -F.col(VALUE) if operator == "argmax" else F.col(VALUE)
            aggregate = F.min(F.when(F.col(VALUE).isNotNull(), F.struct(ordered.alias("by"), F.col(over[0]).alias("at"))))["at"]
        else:
            aggregate = more.get(operator)
            aggregate = bins.aggregate_of(operator, VALUE) if aggregate is None else aggregate
        others = tuple(d for d in self.dims if d not in over)
        domain = self.domain.with_coords(drop=tuple(c.name for c in self.domain if set(c.dims) & set(over)))
        return self._with(self.df.groupBy(*others).agg(aggregate.alias(VALUE)), domain, others)

    # pointwise ----------------------------------------------------------
    def apply_column(self, function: Any) -> Field:
        """A field of ``function(value)``, a Column of a Column."""
        return self._with(self.df.withColumn(VALUE, function(F.col(VALUE))), self.domain)

    def where(self, condition: Any, other: float | None = None) -> Field:
        """Values of which ``condition(value)`` holds; others are null, or ``other``."""
        return self.apply_column(lambda v: F.when(condition(v), v).otherwise(F.lit(other).cast("double")))

    def fillna(self, value: float) -> Field:
        return self.apply_column(lambda v: F.coalesce(v, F.lit(float(value))))

    def clip(self, low: float | None = None, high: float | None = None) -> Field:
        """Values moved to the nearest bound; nulls stay null."""
        return self.apply_column(lambda v: F.when(v < low, F.lit(float(low))).otherwise(v) if high is None else F.when(v > high, F.lit(float(high))).otherwise(v) if low is None
                                 else F.when(v < low, F.lit(float(low))).when(v > high, F.lit(float(high))).otherwise(v))

    def notnull(self) -> Field:
        return self.apply_column(lambda v: v.isNotNull().cast("double"))

    def item(self) -> float | None:
        """The value of a field of one cell."""
        rows = self.df.select(VALUE).limit(2).collect()
        if len(rows) != 1:
            raise ValueError(f"{self.name} isn't one cell")
        return rows[0][0]

    def isnull(self) -> Field:
        return self.apply_column(lambda v: v.isNull().cast("double"))

    def _combine(self, other: Any, function: Any) -> Field:
        """With a number, or cell by cell with a field on some of the same dimensions; a null on either side gives null."""
        if not isinstance(other, Field):
            return self.apply_column(lambda v: function(v, F.lit(float(other))))
        if not set(other.dims) <= set(self.dims):
            raise ValueError(f"{other.name} has dimensions that {self.name} doesn't have")
        right = other.df.withColumnRenamed(VALUE, "__other")
        joined = self.df.join(right, list(other.dims), "left") if other.dims else self.df.join(F.broadcast(right))  # one row
        return self._with(joined.withColumn(VALUE, function(F.col(VALUE), F.col("__other"))).select(*self.dims, VALUE), self.domain)

    def __add__(self, other: Any) -> Field:
        return self._combine(other, lambda a, b: a + b)

    def __sub__(self, other: Any) -> Field:
        return self._combine(other, lambda a, b: a - b)

    def __mul__(self, other: Any) -> Field:
        return self._combine(other, lambda a, b: a * b)

    def __truediv__(self, other: Any) -> Field:
        return self._combine(other, lambda a, b: F.when(b != 0, a / b))

    def __gt__(self, other: Any) -> Field:
        return self._combine(other, lambda a, b: (a > b).cast("double"))

    def __lt__(self, other: Any) -> Field:
        return self._combine(other, lambda a, b: (a < b).cast("double"))

    def along(self, dim: Any, function: str, n: int = 1) -> Field:
        """In the order of a dimension: cumsum, cumprod, cummax, cummin, shift, diff (by ``n`` cells), rank, and rolling_mean, rolling_sum, rolling_max, rolling_min of ``n`` cells up to each.

        Nulls don't count in sums and extremes, and have a null rank; equal values share the least rank.
        """
        coord = self.domain.get(dim)
        name = coord.name if coord is not None else str(dim)
        if name not in self.dims:
            raise ValueError(f"{name!r} isn't a dimension of {self.name}")
        order = Window.partitionBy(*self._sampled(name)).orderBy(name)
        so_far, last = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(1 - n, 0)
        v = F.col(VALUE)
        made = {
            "cumsum": lambda: F.sum(v).over(so_far), "cumprod": lambda: F.product(v).over(so_far), "cummax": lambda: F.max(v).over(so_far), "cummin": lambda: F.min(v).over(so_far),
            "shift": lambda: F.lag(v, n).over(order), "diff": lambda: v - F.lag(v, n).over(order),
            "rank": lambda: F.when(v.isNotNull(), F.rank().over(Window.partitionBy(*self._sampled(name)).orderBy(F.col(VALUE).asc_nulls_last()))).cast("double"),
            "rolling_mean": lambda: F.avg(v).over(last), "rolling_sum": lambda: F.sum(v).over(last), "rolling_max": lambda: F.max(v).over(last), "rolling_min": lambda: F.min(v).over(last),
        }
        if function not in made:
            raise NotImplementedError(f"no {function!r} along a dimension")
        return self.apply_column(lambda _: made[function]())

    def roll(self, dim: Any, n: int) -> Field:
        """Values moved by ``n`` cells along a dimension, round its end; the labels stay."""
        coord, name = self._along(dim)
        labels = np.sort(coord.values) if coord is not None and coord.is_dim else np.arange(self._size(name), dtype="int32")
        return self._relabelled(name, labels, np.roll(labels, -n))

    def coarsen(self, windows: dict[str, int], operator: str = "mean", boundary: str = "exact") -> Field:
        """Blocks of so many labels of each dimension as one cell; its label is the mean of theirs.

        Labels that don't fill a block are an error (``exact``), are left out (``trim``), or make a smaller one (``pad``).
        """
        out = self
        for dim, n in windows.items():
            coord, name = self._along(dim)
            labels = coord.values if coord is not None and coord.is_dim else np.arange(self._size(name), dtype="int32")
            whole = len(labels) // n * n
            if whole < len(labels) and boundary == "exact":
                raise ValueError(f"{len(labels)} labels of {name} aren't blocks of {n}")
            kept = labels if boundary == "pad" else labels[:whole]
            blocks = [kept[k:k + n] for k in range(0, len(kept), n)]
            mean = np.array([b[0] + (b - b[0]).mean() if b.dtype.kind == "M" else b.astype(float).mean() for b in blocks], dtype=labels.dtype if labels.dtype.kind == "M" else float)
            out = out._relabelled(name, kept, np.repeat(mean, np.array([len(b) for b in blocks], dtype=int)))
        domain = out.domain
        aggregate = bins.aggregate_of(operator, VALUE)
        return out._with(out.df.groupBy(*out.dims).agg(aggregate.alias(VALUE)), domain)

    def _along(self, dim: Any) -> tuple[Coordinate | None, str]:
        coord = self.domain.get(dim)
        name = coord.name if coord is not None else str(dim)
        if name not in self.dims:
            raise ValueError(f"{name!r} isn't a dimension of {self.name}")
        return coord, name

    def _relabelled(self, name: str, labels: np.ndarray, new: np.ndarray) -> Field:
        """Each label of a dimension replaced; rows of others are left out."""
        kind = dict(self.df.dtypes)[name]
        target = "double" if new.dtype.kind == "f" else kind
        small = broadcast_if_small(weights.small_frame(self.df.sparkSession, pd.DataFrame({"a": labels, "b": new}), f"__old {kind}, __new {target}"))
        rows = self.df.join(small, F.col(name) == F.col("__old")).drop(name).withColumnRenamed("__new", name)
        others = [c for c in self.domain if name not in c.dims]
        own = self.domain.get(name)
        fresh = [replace(own, values=np.unique(new), bounds=None)] if own is not None and own.is_dim else []
        return self._with(rows.select(*self.dims, VALUE), Domain([*others, *fresh], self.domain.crs, self.domain.type))

    def with_cells(self) -> DataFrame:
        """The rows with the two-dimensional latitude and longitude of their cells."""
        cells = self.cell_table()
        return self.df.join(broadcast_if_small(cells), [c for c in cells.columns if c in self.dims])

    def quantile(self, q: float, dims: Iterable[str] | None = None) -> Field:
        """The exact interpolated quantile over dimensions (all by default)."""
        over = self.dims if dims is None else tuple(dims)
        others = tuple(d for d in self.dims if d not in over)
        domain = self.domain.with_coords(drop=tuple(c.name for c in self.domain if set(c.dims) & set(over)))
        return self._with(self.df.groupBy(*others).agg(F.percentile(VALUE, F.lit(float(q))).alias(VALUE)), domain, others)

    def transpose(self, *dims: str) -> Field:
        """The dimensions in another order."""
        if sorted(dims) != sorted(self.dims):
            raise ValueError(f"the dimensions are {self.dims}")
        return self._with(self.df.select(*dims, VALUE), self.domain, tuple(dims))

    def convert_units(self, units: str) -> Field:
        """In other units; ValueError where they measure something else."""
        a, b = parse_unit(self.units).to(parse_unit(units))
        return replace(self.apply_column(lambda v: v * F.lit(a) + F.lit(b)), units=units)

    def normalise(self, low: float = 0.0, high: float = 1.0) -> Field:
        """Scaled linearly so that the least value is ``low`` and the greatest ``high``; one value alone is ``low``."""
        ends = self.df.agg(F.min(VALUE).alias("__a"), F.max(VALUE).alias("__b"))
        scaled = F.when(F.col("__b") > F.col("__a"), (F.col(VALUE) - F.col("__a")) / (F.col("__b") - F.col("__a"))).when(F.col(VALUE).isNotNull(), F.lit(0.0))
        return self._with(self.df.join(F.broadcast(ends)).withColumn(VALUE, scaled * (high - low) + low).select(*self.dims, VALUE), self.domain)

    def box_stats(self, by: Any) -> DataFrame:
        """Minimum, quartiles and maximum of each label of a dimension."""
        coord = self.domain.get(by)
        name = coord.name if coord is not None else str(by)
        q = F.percentile(VALUE, F.array(*[F.lit(p) for p in (0.0, 0.25, 0.5, 0.75, 1.0)]))
        out = self.df.groupBy(name).agg(q.alias("q"))
        return out.select(name, *[F.get("q", F.lit(i)).alias(c) for i, c in enumerate(("lowest", "q1", "median", "q3", "highest"))])

    # results ------------------------------------------------------------
    def cell_table(self) -> DataFrame:
        """The cells of a two-dimensional domain: their dimensions, latitude and longitude."""
        lat, lon = self.domain.with_latlon().latitude, self.domain.with_latlon().longitude
        index = np.indices(lat.values.shape)
        columns = {}
        for k, d in enumerate(lat.dims):
            own = self.domain.get(d)
            columns[d] = own.values[index[k].ravel()] if own is not None and own.is_dim else index[k].ravel().astype("int32")
        return self.df.sparkSession.createDataFrame(pd.DataFrame({**columns, "latitude": lat.values.ravel(), "longitude": lon.values.ravel()}))

    def to_pandas(self) -> pd.DataFrame:
        return self.df.orderBy(*self.dims).toPandas() if self.dims else self.df.toPandas()

    def to_dense(self) -> np.ndarray:
        """The array of a small field; NaN where a value is missing."""
        pdf = self.df.toPandas()
        out = np.full(self.shape, np.nan)
        at = []
        for d in self.dims:
            own = self.domain.get(d)
            if own is not None and own.is_dim:
                order = np.argsort(own.values, kind="stable")
                at.append(order[np.searchsorted(own.values, pdf[d].to_numpy().astype(own.values.dtype), sorter=order)])
            else:
                at.append(pdf[d].to_numpy().astype(int))
        if self.dims:
            out[tuple(at)] = pdf[VALUE].to_numpy(dtype=float)
            return out
        return np.array(pdf[VALUE].iloc[0] if len(pdf) else np.nan, dtype=float)

    def to_dict(self) -> dict[str, Any]:
        about = self.mapping.get(self.ncvar, {}) if isinstance(self.mapping.get(self.ncvar), dict) else {}
        description = about.get("description") or about.get("name") or self.properties.get("description") or self.properties.get("long_name")
        return to_json_value({"units": self.units, "description": description})

    def assert_not_empty(self) -> None:
        if any(n == 0 for n in self.shape):
            raise EmptyDataError(f"{self.name} has no cells")

    def to_geojson(self, target: str | None = None) -> Any:
        from fieldloom.core.cube import DataCube

        return DataCube([self]).to_geojson(target)

    def to_parquet(self, path: str, partition_by: Iterable[str] = ()) -> str:
        writer = self.df.write.mode("overwrite")
        (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
        return path

    def to_netcdf(self, path: str) -> str:
        from fieldloom.core.cube import DataCube

        return DataCube([self]).to_netcdf(path)

    def persist(self, path: str | None = None) -> str:
        """Write to a NetCDF file: a new temporary one, a new one in a given folder, or the given path with its extension."""
        self.assert_not_empty()
        if path is None:
            path = tempfile.NamedTemporaryFile(suffix=".nc", delete=False).name  # noqa: SIM115
        elif os.path.isdir(path):
            path = os.path.join(path, f"{uuid.uuid4()}.nc")
        if not path.endswith(".nc"):
            log.warning("%s: the extension .nc is added", path)
            path += ".nc"
        return self.to_netcdf(path)

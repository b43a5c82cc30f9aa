"""A data cube: fields that share coordinates."""

from __future__ import annotations

import functools
import json
import logging
import os
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from typing import Any

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.core.domain import Domain, DomainType
from fieldloom.core.field import VALUE, Field
from fieldloom.crs.systems import GeogCS
from fieldloom.meta.axis import AxisType
from fieldloom.meta.coordinate import Coordinate
from fieldloom.meta.naming import to_json_value
from fieldloom.operators.select import EmptyDataError

log = logging.getLogger(__name__)


class DataCube:
    """Fields by logical name; equal names are refused."""

    def __init__(self, fields: Iterable[Field], properties: dict[str, Any] | None = None, encoding: dict[str, Any] | None = None) -> None:
        self.fields: dict[str, Field] = {}
        for f in fields:
            if f.name in self.fields:
                raise ValueError(f"two fields are named {f.name!r}")
            self.fields[f.name] = f
        self.properties, self.encoding = dict(properties or {}), dict(encoding or {})

    @classmethod
    def from_dataframe(cls, df: DataFrame, dims: Iterable[str], values: Iterable[str], coords: dict[str, Any] | Domain | None = None, **more: Any) -> DataCube:
        """One field for each value column of a wide frame."""
        out: list[Field] = []
        for v in values:
            out.append(Field.from_dataframe(df, v, dims, v, coords if not out else out[0].domain, **more))
        return cls(out)

    @property
    def domain(self) -> Domain:
        return Domain.merge([f.domain for f in self.fields.values()])

    latitude = property(lambda self: self.domain.latitude)
    longitude = property(lambda self: self.domain.longitude)
    vertical = property(lambda self: self.domain.vertical)
    time = property(lambda self: self.domain.time)

    @property
    def nbytes(self) -> int:
        return sum(f.nbytes for f in self.fields.values())

    def __len__(self) -> int:
        return len(self.fields)

    def __iter__(self) -> Iterator[Field]:
        return iter(self.fields.values())

    def __contains__(self, key: Any) -> bool:
        return self._find(key) is not None or key in self.domain

    def __repr__(self) -> str:
        return f"DataCube({', '.join(self.fields)})"

    def _find(self, key: Any) -> Field | None:
        if not isinstance(key, str):
            return None
        return self.fields.get(key) or next((f for f in self.fields.values() if f.ncvar == key), None)

    def __getitem__(self, key: Any) -> Any:
        """A field by logical or disk name, a cube of several, or a coordinate."""
        if isinstance(key, (list, tuple, set)):
            return DataCube([self[k] for k in key], self.properties, self.encoding)
        found = self._find(key)
        return found if found is not None else self.domain[key]

    def _each(self, verb: Callable[[Field], Field], skip_empty: bool = False) -> DataCube:
        out = []
        for f in self.fields.values():
            try:
                out.append(verb(f))
            except EmptyDataError:
                if not skip_empty:
                    raise
                log.warning("%s has nothing to select and is left out", f.name)
        return DataCube(out, self.properties, self.encoding)

    def geobbox(self, *args: Any, **kwargs: Any) -> DataCube:
        return self._each(lambda f: f.geobbox(*args, **kwargs))

    def locations(self, *args: Any, **kwargs: Any) -> DataCube:
        return self._each(lambda f: f.locations(*args, **kwargs))

    def sel(self, *args: Any, **kwargs: Any) -> DataCube:
        """Fields without any of the wanted times are left out."""
        return self._each(lambda f: f.sel(*args, **kwargs), skip_empty=True)

    def interpolate(self, *args: Any, **kwargs: Any) -> DataCube:
        return self._each(lambda f: f.interpolate(*args, **kwargs))

    def resample(self, *args: Any, **kwargs: Any) -> DataCube:
        return self._each(lambda f: f.resample(*args, **kwargs))

    def average(self, dim: Any = None) -> DataCube:
        return self._each(lambda f: f.average(dim))

    def to_regular(self) -> DataCube:
        return self._each(lambda f: f.to_regular())

    def extract_polygons(self, geometry: Any, crop: bool = True) -> DataCube:
        return self._each(lambda f: f.extract_polygons(geometry, crop))

    def regrid(self, *args: Any, **kwargs: Any) -> DataCube:
        return self._each(lambda f: f.regrid(*args, **kwargs))

    # results ------------------------------------------------------------
    def to_wide(self) -> DataFrame:
        """All fields beside each other: full outer joins on the shared dimensions, one column for each field."""
        frames = [(f.dims, f.df.withColumnRenamed(VALUE, f.name)) for f in self.fields.values()]
        if not frames:
            raise EmptyDataError("a cube without fields")

        def join(left: tuple, right: tuple) -> tuple:
            on = [d for d in left[0] if d in right[0]]
            dims = (*left[0], *(d for d in right[0] if d not in left[0]))
            if not on and left[0] and right[0]:
                raise ValueError(f"fields on {left[0]} and on {right[0]} share no dimension; a table of both would hold every pair of cells")
            return dims, left[1].join(right[1], on, "full_outer") if on else left[1].join(right[1])  # one of them is one row

        dims, out = functools.reduce(join, frames)
        return out.select(*dims, *self.fields)

    def to_csv(self, path: str) -> str:
        self.to_wide().write.mode("overwrite").option("header", True).csv(path)
        return path

    def to_parquet(self, path: str, partition_by: Iterable[str] = ()) -> str:
        writer = self.to_wide().write.mode("overwrite")
        (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
        return path

    def to_netcdf(self, path: str) -> str:
        """A classic NetCDF file of a cube that fits the driver."""
        from fieldloom.sources import netcdf3

        dims: dict[str, int] = {}
        variables: dict[str, tuple] = {}
        for f in self.fields.values():
            dims |= dict(zip(f.dims, f.shape))
            for c in f.domain:
                if set(c.dims) <= set(f.dims) and c.values.dtype.kind in "iufM":
                    variables[c.name] = (c.dims, *_encoded(c))
            crs = f.domain.crs
            variables["crs"] = ((), np.asarray(0, dtype="i4"), {k: v for k, v in crs.to_attrs().items() if v is not None})
            about = {k: v for k, v in f.properties.items() if isinstance(v, (str, int, float))} | {"_FillValue": 9.969209968386869e36, "grid_mapping": "crs"}
            extra = [c.name for c in f.domain if not c.is_dim and c.name in variables]
            about |= ({"units": f.units} if f.units else {}) | ({"coordinates": " ".join(extra)} if extra else {}) | ({"cell_methods": " ".join(map(str, f.cell_methods))} if f.cell_methods else {})
            dense = f.to_dense()
            variables[f.ncvar] = (f.dims, np.where(np.isnan(dense), about["_FillValue"], dense), about)
        return netcdf3.write(path, dims, variables, {k: v for k, v in self.properties.items() if isinstance(v, (str, int, float))})

    def to_zarr(self, path: str, chunks: dict[str, int] | None = None) -> str:
        """A Zarr folder: coordinates from the driver, chunks from the executors."""
        from fieldloom.sources import zarr2

        os.makedirs(path, exist_ok=True)
        with open(os.path.join(path, ".zgroup"), "w") as f:
            json.dump({"zarr_format": 2}, f)
        for c in self.domain:
            if c.values.dtype.kind in "iufM":
                values, attrs = _encoded(c)
                zarr2.write_array(path, c.name, values, c.dims, attrs)
        for f in self.fields.values():
            zarr2.write_field(f, path, f.ncvar, chunks)
        return path

    def assert_not_empty(self) -> None:
        if not self.fields:
            raise EmptyDataError("a cube without fields")
        for f in self.fields.values():
            f.assert_not_empty()

    def persist(self, path: str | None = None) -> str:
        self.assert_not_empty()
        if path is None:
            path = tempfile.NamedTemporaryFile(suffix=".nc", delete=False).name  # noqa: SIM115
        elif os.path.isdir(path):
            path = os.path.join(path, f"{uuid.uuid4()}.nc")
        if not path.endswith(".nc"):
            log.warning("%s: the extension .nc is added", path)
            path += ".nc"
        return self.to_netcdf(path)

    def geojson_rows(self) -> DataFrame:
        """One GeoJSON feature in a row: points by time, or a square for each cell of a grid.

        A cell is its centre and half the most frequent spacing, clipped to the extent of the centres.
        Missing values are null properties.
        """
        domain, wide = self.domain, self.to_wide()
        time = domain.get(AxisType.TIME)
        stamp = F.date_format(F.col(time.name), "yyyy-MM-dd'T'HH:mm") if time is not None and time.name in wide.columns else F.lit(None if time is None else str(time.values.ravel()[0].astype("datetime64[m]")))
        values = [F.col(n) for n in self.fields]
        units = F.struct(*[F.lit(str(f.units)).alias(n) for n, f in self.fields.items()])
        lat, lon = domain.latitude, domain.longitude
        if domain.type is DomainType.POINTS:
            if lat.values.size != 1:
                raise NotImplementedError("features of several points")
            geometry = F.struct(F.lit("Point").alias("type"), F.array(F.lit(float(lon.values.ravel()[0])), F.lit(float(lat.values.ravel()[0]))).alias("coordinates"))
            properties = F.struct(stamp.alias("time"), *values)
            order = [time.name] if time is not None and time.name in wide.columns else list(self.fields)
        else:
            if time is not None and time.values.size > 1:
                raise NotImplementedError("a grid of several times")
            if not isinstance(domain.crs, GeogCS):
                return self.to_regular().geojson_rows()
            hx, hy = domain.resolution()
            corner = lambda c, coord, h: F.least(F.greatest(F.col(coord.name) + F.lit(c * h / 2), F.lit(float(coord.values.min()))), F.lit(float(coord.values.max())))
            w, e, s, n = corner(-1, lon, hx), corner(1, lon, hx), corner(-1, lat, hy), corner(1, lat, hy)
            ring = F.array(*[F.array(a, b) for a, b in ((w, s), (e, s), (e, n), (w, n), (w, s))])
            geometry = F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates"))
            properties = F.struct(*values) if values else F.lit(None)
            order = [lat.name, lon.name]
        feature = F.struct(F.lit("Feature").alias("type"), units.alias("units"), geometry.alias("geometry"), properties.alias("properties"))
        return wide.select(*order, F.to_json(feature, {"ignoreNullFields": "false"}).alias("feature")).orderBy(*order).select("feature")

    def to_geojson(self, target: str | None = None) -> dict[str, Any]:
        """A FeatureCollection, also written to ``target``."""
        domain = self.domain
        out: dict[str, Any] = {"type": "FeatureCollection", "features": [json.loads(r.feature) for r in self.geojson_rows().toLocalIterator()]}
        if domain.type is not DomainType.POINTS and AxisType.TIME in domain:
            lat, lon = domain.latitude.values, domain.longitude.values
            when = str(domain.time.values.ravel()[0].astype("datetime64[m]"))
            out = {when: out | {"date": when, "bbox": [float(lon.min()), float(lat.min()), float(lon.max()), float(lat.max())], "units": {n: str(f.units) for n, f in self.fields.items()}}}
        if target:
            with open(target, "w") as f:
                json.dump(out, f)
        return out

    def image_grid(self, name: str | None = None, low: float | None = None, high: float | None = None) -> DataFrame:
        """What an image or a facet plot needs: one row for each latitude, with an array of values by longitude, scaled to 0..1."""
        if name is None and len(self.fields) != 1:
            raise ValueError("an image is of one field")
        f = self.fields[name] if name else next(iter(self.fields.values()))
        scaled = f.normalise() if low is None or high is None else f.apply_column(lambda v: (F.least(F.greatest(v, F.lit(low)), F.lit(high)) - low) / (high - low))
        lat, lon = f.latitude.name, f.longitude.name
        rest = [d for d in f.dims if d not in (lat, lon)]
        return scaled.df.groupBy(*rest, lat).agg(F.transform(F.array_sort(F.collect_list(F.struct(lon, VALUE))), lambda s: s[VALUE]).alias("row"))

    def to_dict(self, unique_values: bool = False) -> dict[str, Any]:
        return to_json_value({"domain": self.domain.to_dict(unique_values), "fields": {n: f.to_dict() for n, f in self.fields.items()}})


def _encoded(c: Coordinate) -> tuple[np.ndarray, dict[str, Any]]:
    attrs = {k: v for k, v in c.properties.items() if isinstance(v, (str, int, float))}
    if c.values.dtype.kind == "M":
        return (c.values - np.datetime64("1970-01-01T00:00:00", "us")).astype("int64") / 3.6e9, attrs | {"units": "hours since 1970-01-01 00:00:00", "calendar": "proleptic_gregorian", "standard_name": "time"}
    return c.values, attrs | ({"units": c.units} if c.units else {})


def plot_kind(n_time: int, n_vertical: int, n_points: int) -> str:
    """time_series, profile or points: by the largest extent, in this order of precedence."""
    return max((n_time, 3, "time_series"), (n_vertical, 2, "profile"), (n_points, 1, "points"))[2]


def point_labels(field: Field) -> list[str]:
    return [f"{a:.2f}°, {o:.2f}°" for a, o in zip(np.atleast_1d(field.latitude.values), np.atleast_1d(field.longitude.values))]



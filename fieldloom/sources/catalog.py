"""Open cubes from files and datasets from file names."""

from __future__ import annotations

import dataclasses
import glob as globbing
import json
import logging
import os
import re
import string
from typing import Any

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.core.cube import DataCube
from fieldloom.core.dataset import Dataset, Entry
from fieldloom.core.domain import Domain, DomainType
from fieldloom.core.field import VALUE, Field, prunable
from fieldloom.crs.systems import parse_crs
from fieldloom.functions.timelabels import Reader
from fieldloom.meta.axis import AxisType
from fieldloom.meta.cell_methods import parse_cell_methods
from fieldloom.meta.coordinate import Coordinate
from fieldloom.meta.naming import logical_name, placeholders, split_attributes
from fieldloom.sources import geotiff, netcdf3, zarr2

log = logging.getLogger(__name__)
# File endings and what reads them.
ENGINES = {".nc": "netcdf", ".cdf": "netcdf", ".tif": "geotiff", ".tiff": "geotiff", ".jp2": "jpeg2000", ".zarr": "zarr", ".parquet": "parquet", ".csv": "csv"}


def engine_of(path: str | list[str]) -> str:
    """What reads a path: by its ending; a web address is Zarr; of a list the first decides; else ValueError."""
    if isinstance(path, (list, tuple)):
        if not path:
            raise ValueError("no files")
        path = path[0]
    if str(path).startswith("http"):
        return "zarr"
    ending = os.path.splitext(str(path).rstrip("/*"))[1].lower()
    if ending not in ENGINES:
        raise ValueError(f"no reader for {path!r}")
    return ENGINES[ending]


def decode_times(values: np.ndarray, units: str, calendar: str | None = None) -> np.ndarray:
    """``<unit> since <reference>`` as timestamps; text where the calendar isn't a Gregorian one."""
    reader, encoding = Reader({}), json.dumps({"units": units, "calendar": calendar or "standard"})
    ns = []
    for v in np.asarray(values, dtype=float).ravel():
        found = reader.read(repr(float(v)), encoding)
        if not found:
            return np.array([str(x) for x in np.asarray(values).ravel()], dtype=object).reshape(np.shape(values))
        ns.append((found[0][1] + 500) // 1000)
    return np.array(ns, dtype="datetime64[us]").reshape(np.shape(values))


def _coordinate(name: str, raw: np.ndarray, dims: tuple[str, ...], attrs: dict[str, Any], mapping: dict[str, Any] | None) -> Coordinate:
    about = dict(attrs)
    units, calendar = about.pop("units", None), about.pop("calendar", None)
    about.pop("_FillValue", None)
    axis = next((k for k in (AxisType.infer(x) for x in ((mapping or {}).get(name, {}).get("name"), about.get("standard_name"), name) if x) if k is not AxisType.GENERIC), AxisType.GENERIC)
    values = decode_times(raw, units, calendar) if isinstance(units, str) and " since " in units else np.asarray(raw)
    return Coordinate(name, values, dims, axis, units, None, about, {"name": name})


def _header(reader: dict[str, tuple[tuple[str, ...], Any, dict[str, Any]]], mapping: dict[str, Any] | None) -> tuple[dict[str, tuple[list[Coordinate], dict[str, Any] | None]], list[str]]:
    """For each data variable its coordinates and grid mapping, by CF: dimension variables, ``coordinates``, ``grid_mapping``, ``bounds``."""
    special: set[str] = {n for n, (dims, _, _) in reader.items() if dims == (n,)}
    for _, _, attrs in reader.values():
        special |= set(str(attrs.get("coordinates", "")).split()) & set(reader)
        special |= {str(attrs[k]) for k in ("bounds", "grid_mapping", "climatology") if attrs.get(k) in reader}
    data = [n for n, (dims, _, _) in reader.items() if n not in special and dims]
    out = {}
    for n in data:
        dims, _, attrs = reader[n]
        names = [d for d in dims if d in reader and reader[d][0] == (d,)]
        for c in str(attrs.get("coordinates", "")).split():
            if c not in reader:
                log.warning("%s names a coordinate %s that isn't there", n, c)
            elif c not in names and set(reader[c][0]) <= set(dims):
                names.append(c)
        coords = [_coordinate(c, reader[c][1](), reader[c][0], reader[c][2], mapping) for c in names]
        grid = attrs.get("grid_mapping")
        out[n] = coords, reader[grid][2] if grid in reader else None
    return out, data


def _field(df: Any, n: str, dims: tuple[str, ...], attrs: dict[str, Any], coords: list[Coordinate], grid: dict[str, Any] | None, id_pattern: str | None, mapping: dict[str, Any] | None) -> Field:
    properties, encoding = split_attributes({k: v for k, v in attrs.items() if k != "_ARRAY_DIMENSIONS"})
    kept = {k: encoding[k] for k in ("standard_name", "long_name") if k in encoding}
    crs = None if grid is None else parse_crs(grid)
    domain = Domain(coords, crs, DomainType.POINTS if "points" in dims else DomainType.GRIDDED)
    return Field(df, logical_name(n, attrs, id_pattern, mapping), dims, domain, attrs.get("units"), {**properties, **kept}, {**encoding, "name": n}, tuple(parse_cell_methods(attrs.get("cell_methods"))), mapping=dict(mapping or {}))


def open_datacube(spark: SparkSession, path: str | list[str], id_pattern: str | None = None, mapping: dict[str, Any] | None = None, engine: str | None = None,
                  dims: list[str] | None = None, metadata_cache_path: str | None = None, **options: Any) -> DataCube:
    """A cube from a file, a pattern, a list of files or a folder.

    NetCDF classic, Zarr v2 and GeoTIFF files are read by this package, Parquet and CSV by Spark, in
    long form with the columns ``dims`` and one column for each field. Of several files the cube has
    every variable of any of them, on the union of its files' labels; cells that stand in several
    files must agree or be null in all but one, else reading them is an error, as are files of one
    variable with other dimensions or units (ValueError). NetCDF-4, JPEG 2000 and remote stores need
    libraries that aren't here and raise NotImplementedError. ``metadata_cache_path`` keeps the
    headers of NetCDF files as JSON; a file is looked at again only when it is new or has changed.
    """
    given, engine = engine, engine or engine_of(path)
    files = sorted(set(path)) if isinstance(path, (list, tuple)) else sorted(globbing.glob(path)) if any(c in str(path) for c in "*?[") else [str(path)]
    if not files:
        raise FileNotFoundError(str(path))
    if given is None and isinstance(path, (list, tuple)) and {engine_of(f) for f in files} != {engine}:
        raise ValueError(f"files of several kinds: {files}")
    if engine == "parquet" or engine == "csv":
        return _open_frames(spark, files, engine, dims, options)
    if engine == "netcdf":
        return _open_netcdf(spark, files, id_pattern, mapping, metadata_cache_path)
    if engine == "zarr":
        if str(files[0]).startswith("http"):
            raise NotImplementedError("a remote Zarr store needs a file-system library")
        return _combine([_open_zarr(spark, f, id_pattern, mapping) for f in files])
    if engine == "geotiff":
        return _combine([_open_geotiff(spark, f) for f in files])
    raise NotImplementedError(f"{engine} needs a library that isn't here")


def _overlap(labels: list[dict[str, np.ndarray]], dims: tuple[str, ...]) -> bool:
    """Whether two files have a cell in common, by their labels of each dimension."""
    apart = [d for d in dims if any(not np.array_equal(x[d], labels[0][d]) for x in labels)]
    if len(apart) == 1:
        every = np.concatenate([np.unique(x[apart[0]]) for x in labels])
        return len(np.unique(every)) < len(every)
    return any(all(len(np.intersect1d(a[d], b[d])) for d in apart) for i, a in enumerate(labels) for b in labels[:i])


def _agreed(df: DataFrame, dims: tuple[str, ...], name: str) -> DataFrame:
    """One row for each cell; an error where files have different values."""
    low, high = F.min(VALUE), F.max(VALUE)
    return df.groupBy(*dims).agg(F.when((low == high) | low.isNull(), low).otherwise(F.raise_error(F.lit(f"files have different values of {name} in one cell"))).alias(VALUE))


def _merged(coords: list[list[Coordinate]]) -> list[Coordinate]:
    """The first file's coordinates; those of dimensions have the labels of all files."""
    out = []
    for c in coords[0]:
        values = [o.values for cs in coords for o in cs if o.name == c.name]
        if c.is_dim and any(not np.array_equal(v, values[0]) for v in values):
            every = np.unique(np.concatenate(values))
            out.append(Coordinate(c.name, every[::-1] if c.descending else every, c.dims, c.axis, c.units, None, c.properties, c.encoding))
        else:
            out.append(c)
    return out


def _same_kind(name: str, about: list[tuple]) -> None:
    if any(a != about[0] for a in about):
        raise ValueError(f"files have {name} with different dimensions or units: {sorted(set(map(str, about)))}")


def _combine(cubes: list[DataCube]) -> DataCube:
    """One cube of the fields of all."""
    if len(cubes) == 1:
        return cubes[0]
    fields = []
    for n in dict.fromkeys(n for c in cubes for n in c.fields):
        parts = [c.fields[n] for c in cubes if n in c.fields]
        first = parts[0]
        if len(parts) == 1:
            fields.append(first)
            continue
        _same_kind(n, [(p.dims, str(p.units)) for p in parts])
        df = parts[0].df.select(*first.dims, VALUE)
        for p in parts[1:]:
            df = df.unionByName(p.df.select(*first.dims, VALUE))
        labelled = tuple(c.name for c in first.domain if c.is_dim)
        if _overlap([{c.name: c.values for c in p.domain if c.is_dim} for p in parts], labelled):
            df = _agreed(df, first.dims, n)
        fields.append(first._with(df, Domain(_merged([list(p.domain) for p in parts]), first.domain.crs, first.domain.type)))
    return DataCube(fields, cubes[0].properties, cubes[0].encoding)


def _open_frames(spark: SparkSession, files: list[str], engine: str, dims: list[str] | None, options: dict[str, Any]) -> DataCube:
    """Parquet and CSV: files of the same columns are read together, others apart."""
    read = lambda fs: spark.read.parquet(*fs) if engine == "parquet" else spark.read.options(header=True, inferSchema=True, **options).csv(fs)
    groups: dict[tuple[str, ...], list[str]] = {}
    if len(files) > 1:
        for f in files:
            groups.setdefault(tuple(spark.read.parquet(f).columns if engine == "parquet" else spark.read.options(header=True, **options).csv(f).columns), []).append(f)
    cubes = []
    for group in groups.values() if groups else [files]:
        df = read(group)
        on = dims or [c for c in df.columns if AxisType.infer(c) is not AxisType.GENERIC or c == "points"]
        cubes.append(DataCube.from_dataframe(df, on, [c for c in df.columns if c not in on]))
    return _combine(cubes)


def _open_geotiff(spark: SparkSession, path: str) -> DataCube:
    values, y, x, nodata = geotiff.read_geotiff(path)
    data = np.where(values == nodata, np.nan, values) if nodata is not None else values
    return DataCube([Field.from_arrays(spark, data, "band_data", ("band", "y", "x"), {"band": np.arange(1, len(data) + 1), "y": y, "x": x}, domaintype=DomainType.GRIDDED)])


def _open_netcdf(spark: SparkSession, files: list[str], id_pattern: str | None, mapping: dict[str, Any] | None, cache: str | None = None) -> DataCube:
    headers = cached_headers(cache, files) if cache else [netcdf3.read_header(f) for f in files]
    as_reader = lambda h: {n: (v.dims, (lambda n=n, h=h: h.read(n)), v.attrs) for n, v in h.variables.items()}
    found = [_header(as_reader(h), mapping) for h in headers]
    fields = []
    for n in dict.fromkeys(n for _, data in found for n in data):
        holding = [(h, *f[n]) for h, (f, _) in zip(headers, found) if n in f]
        first, _, grid = holding[0]
        dims, attrs = first.variables[n].dims, first.variables[n].attrs
        _same_kind(n, [(h.variables[n].dims, str(h.variables[n].attrs.get("units"))) for h, _, _ in holding])
        labels = {}
        for h, cs, _ in holding:
            own = {c.name: c.values for c in cs if c.is_dim}
            labels[h.path] = {d: own.get(d, np.arange(h.dims[d], dtype="int32")) for d in dims}
        for d in dims:
            kind = np.result_type(*(x[d] for x in labels.values())) if all(x[d].dtype.kind in "iuf" for x in labels.values()) else None
            for x in labels.values():
                x[d] = x[d] if kind is None else x[d].astype(kind)
        paths = [h.path for h, _, _ in holding]
        df = prunable(lambda within, paths=paths, n=n, labels=labels, dims=dims: netcdf3.scan(spark, paths, n, labels, dims, within))
        if len(holding) > 1 and _overlap(list(labels.values()), dims):
            df = _agreed(df, dims, n)
        fields.append(_field(df, n, dims, attrs, _merged([cs for _, cs, _ in holding]), grid, id_pattern, mapping))
    return DataCube(fields, {k: v for k, v in headers[0].attrs.items() if k != "_NCProperties"})


def _open_zarr(spark: SparkSession, path: str, id_pattern: str | None, mapping: dict[str, Any] | None) -> DataCube:
    reader = {}
    for n in zarr2.array_names(path):
        meta, attrs = zarr2.array_meta(path, n)
        reader[n] = tuple(attrs.get("_ARRAY_DIMENSIONS", [f"{n}_{i}" for i in range(len(meta["shape"]))])), (lambda n=n: zarr2.read_array(path, n)), attrs
    found, data = _header(reader, mapping)
    fields = []
    for n in data:
        dims, _, attrs = reader[n]
        coords, grid = found[n]
        meta, _ = zarr2.array_meta(path, n)
        own = {c.name: c.values for c in coords if c.is_dim}
        labels = {d: own.get(d, np.arange(s, dtype="int32")) for d, s in zip(dims, meta["shape"])}
        df = prunable(lambda within, n=n, labels=labels, dims=dims: zarr2.scan(spark, path, n, labels, dims, within))
        fields.append(_field(df, n, dims, attrs, coords, grid, id_pattern, mapping))
    return DataCube(fields)


def cached_headers(path: str, files: list[str]) -> list[netcdf3.Header]:
    """The headers of files: from the JSON at ``path`` where a file has the time of change and size noted there, else read, and noted."""
    noted: dict[str, Any] = {}
    if os.path.exists(path):
        try:
            with open(path) as f:
                noted = json.load(f)
        except ValueError:
            log.warning("%s can't be read and is made anew", path)
    out, changed = [], False
    for f in files:
        about = os.stat(f)
        seal = [about.st_mtime_ns, about.st_size]
        held = noted.get(f) if isinstance(noted, dict) else None
        if not isinstance(held, dict) or held.get("seal") != seal:
            noted[f] = held = {"seal": seal, "header": dataclasses.asdict(netcdf3.read_header(f))}
            changed = True
        h = dict(held["header"])
        variables = {n: netcdf3.Variable(**{**v, "dims": tuple(v["dims"])}) for n, v in h.pop("variables").items()}
        out.append(netcdf3.Header(variables=variables, **h))
    if changed:
        with open(f"{path}.part", "w") as f:
            json.dump(noted, f)
        os.replace(f"{path}.part", path)
    return out


def name_pattern(pattern: str) -> re.Pattern:
    """A regular expression for a format pattern: named placeholders are groups, unnamed ones match anything."""
    out, seen = "", set()
    for text, name, _, _ in string.Formatter().parse(pattern):
        out += re.escape(text)
        if name:
            out += f"(?P={name})" if name in seen else f"(?P<{name}>[^/]+?)"
            seen.add(name)
        elif name is not None:
            out += "[^/]*?"
    return re.compile(out + "$")


def catalog_of(paths: DataFrame, column: str, pattern: str) -> DataFrame:
    """The catalog of a table of file names: the attributes of ``pattern``, files ARRAY<STRING>, n_files.

    For listings too long for the driver: names are read by the JVM. Names that don't fit, and nulls,
    are left out; a name that repeats counts once. Only as many names stand in one row as share their attributes.
    """
    names = list(dict.fromkeys(placeholders(pattern)))
    regex = re.sub(r"\(\?P=(\w+)\)", r"\\k<\1>", re.sub(r"\(\?P<", "(?<", name_pattern(pattern).pattern))
    fitting = paths.select(F.col(column).alias("__path")).where(F.col("__path").rlike(regex)).distinct()
    read = fitting.select("__path", *[F.regexp_extract("__path", regex, i + 1).alias(n) for i, n in enumerate(names)])
    return read.groupBy(*names).agg(F.array_sort(F.collect_list("__path")).alias("files"), F.count(F.lit(1)).alias("n_files"))


def open_dataset(spark: SparkSession, path: str, pattern: str, id_pattern: str | None = None, mapping: dict[str, Any] | None = None, load_files_on_persistance: bool = True,
                 ds_attr_mapping: dict[str, str] | None = None, ncvars_mapping: dict[str, str] | None = None, delay_read_cubes: bool = True, **options: Any) -> Dataset:
    """A dataset of the files of a path pattern, one entry for each combination of attributes in their names.

    Files that don't fit the pattern are passed over; ValueError if none fits. Cubes are opened when
    they are needed, or never if ``load_files_on_persistance`` is False, or at once if ``delay_read_cubes``
    is. ``ds_attr_mapping`` gives attributes other names than those in the pattern, ``ncvars_mapping``
    variables other names than those on disk. ``metadata_cache_path`` keeps the headers of all entries.
    """
    names = list(dict.fromkeys(placeholders(pattern)))
    regex = name_pattern(pattern)
    groups: dict[tuple[str, ...], list[str]] = {}
    for f in sorted(globbing.glob(path)):
        m = regex.search(f)
        if m:
            groups.setdefault(tuple(m[n] for n in names), []).append(f)
    if not groups:
        raise ValueError(f"no file of {path!r} fits {pattern!r}")
    mapping = {**(mapping or {}), **{n: {**(mapping or {}).get(n, {}), "name": to} for n, to in (ncvars_mapping or {}).items()}} or None
    names = [(ds_attr_mapping or {}).get(n, n) for n in names]
    entries = []
    for key, files in sorted(groups.items()):
        opener = (lambda files=files: open_datacube(spark, files if len(files) > 1 else files[0], id_pattern, mapping, **options)) if load_files_on_persistance else None
        if opener is not None and not delay_read_cubes:
            opener = (lambda cube: lambda: cube)(opener())
        entries.append(Entry(dict(zip(names, key)), tuple(files), opener))
    return Dataset(tuple(entries), tuple(names))

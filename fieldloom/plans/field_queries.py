"""Queries of the field, cube and dataset operators over the driver's tables, with their SQL.

GRID: lineitem as a grid of time, latitude and longitude. VERT: the same with the part's size as a
depth that is positive down. CURV: GRID by positions y and x with two-dimensional latitudes.
"""

from __future__ import annotations

import functools
import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.core.cube import DataCube
from fieldloom.core.dataset import Dataset, Entry
from fieldloom.core.domain import Domain, DomainType, GeodeticGrid, GeodeticPoints
from fieldloom.core.field import Field, lazy_labels
from fieldloom.crs.systems import (
    AlbersEqualArea, CurvilinearGrid, Geostationary, LambertAzimuthalEqualArea, LambertConformal, Mercator, Orthographic, PolarStereographic, RegularLatLon, RotatedGeogCS, Stereographic, TransverseMercator, VerticalPerspective, WebMercator,
)
from fieldloom.meta.coordinate import Coordinate
from fieldloom.plans.scale import shared_path, table
from fieldloom.sources.catalog import open_datacube

LAT, LON = np.arange(-45.0, 46.0, 10.0), np.arange(0.0, 360.0, 10.0)
Query = Callable[[SparkSession, str], DataFrame]


def _quantity() -> F.Column:
    """Exact to hundredths, in whole numbers."""
    return (F.sum(F.round(F.col("l_quantity") * 100).cast("long")) / 100).alias("value")


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_shipdate").cast("timestamp_ntz").alias("time"), ((F.col("l_suppkey") % 10) * 10 - 45).cast("double").alias("latitude"),
        ((F.col("l_partkey") % 36) * 10).cast("double").alias("longitude"), "l_quantity", "l_discount", "l_partkey", "l_suppkey", "l_returnflag", "l_linestatus")


def grid(spark: SparkSession, sf_dir: str, where: str | None = None, name: str = "quantity", latitudes: np.ndarray = LAT) -> Field:
    rows = _rows(spark, sf_dir)
    rows = rows.where(where) if where else rows
    df = rows.groupBy("time", "latitude", "longitude").agg(_quantity())
    return Field.from_dataframe(df, name, ("time", "latitude", "longitude"), "value", {"time": lazy_labels(rows, "time"), "latitude": latitudes, "longitude": LON}, units="kg")


def vertical_grid(spark: SparkSession, sf_dir: str) -> Field:
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_size").cast("double").alias("depth"))
    df = _rows(spark, sf_dir).join(part, "l_partkey").groupBy("depth", "latitude", "longitude").agg(_quantity())
    depth = Coordinate("depth", np.arange(1.0, 51.0), ("depth",), properties={"positive": "down"})
    return Field.from_dataframe(df, "quantity", ("depth", "latitude", "longitude"), "value", {"depth": depth, "latitude": LAT, "longitude": LON})


def curvilinear(spark: SparkSession, sf_dir: str) -> Field:
    df = _rows(spark, sf_dir).groupBy((F.col("l_suppkey") % 10).cast("int").alias("y"), (F.col("l_partkey") % 36).cast("int").alias("x")).agg(_quantity())
    y, x = np.meshgrid(np.arange(10), np.arange(36), indexing="ij")
    coords = {"latitude": (("y", "x"), -45 + 10 * y + 0.5 * x), "longitude": (("y", "x"), 10 * x + 0.5 * y)}
    return Field(df, "quantity", ("y", "x"), Domain(coords, CurvilinearGrid(), DomainType.GRIDDED))


def shown(field: Field, digits: int = 6) -> DataFrame:
    return field.df.select(*field.dims, F.round("value", digits).alias("value"))


def flat(spark: SparkSession, sf_dir: str) -> Field:
    """GRID without time: the mean of each cell."""
    return grid(spark, sf_dir).average("time")


def rotated(spark: SparkSession, sf_dir: str) -> Field:
    """The cells as a small rotated grid."""
    df = _rows(spark, sf_dir).groupBy(((F.col("l_suppkey") % 10) - 4.5).cast("double").alias("rlat"), ((F.col("l_partkey") % 36) - 17.5).cast("double").alias("rlon")).agg(_quantity())
    coords = {"rlat": np.arange(10) - 4.5, "rlon": np.arange(36) - 17.5}
    return Field(df, "quantity", ("rlat", "rlon"), Domain(coords, RotatedGeogCS(47.0, -168.0), DomainType.GRIDDED))


def _bent(spark: SparkSession, sf_dir: str) -> Field:
    """GRID's means as a curvilinear grid whose two-dimensional labels are those of the regular one."""
    df = flat(spark, sf_dir).df.select(((F.col("latitude") + 45) / 10).cast("int").alias("y"), (F.col("longitude") / 10).cast("int").alias("x"), "value")
    lat, lon = np.meshgrid(LAT, LON, indexing="ij")
    return Field(df, "quantity", ("y", "x"), Domain({"latitude": (("y", "x"), lat), "longitude": (("y", "x"), lon)}, CurvilinearGrid(), DomainType.GRIDDED))


def catalog(spark: SparkSession, sf_dir: str) -> Dataset:
    """One cube for each pair of return flag and line status."""
    entries = [Entry({"flag": f, "status": s}, (), lambda f=f, s=s: DataCube([grid(spark, sf_dir, f"l_returnflag = '{f}' AND l_linestatus = '{s}'")]), ("quantity",)) for f in "ANR" for s in "FO"]
    return Dataset(tuple(entries), ("flag", "status"))


def _members(dataset: Dataset) -> DataFrame:
    """The cells of all cubes of a dataset, with their attributes."""
    parts = [c["quantity"].df.select(*[F.lit(v).alias(k) for k, v in e.attrs.items()], *c["quantity"].dims, F.round("value", 6).alias("value")) for e, c in zip(dataset.entries, dataset.cubes)]
    return functools.reduce(DataFrame.unionByName, parts)


def _merge(spark: SparkSession, sf_dir: str) -> DataCube:
    return DataCube([grid(spark, sf_dir, f"l_returnflag = '{f}'", n) for f, n in (("A", "returned"), ("N", "none"))])


_G = """g AS (SELECT l_shipdate AS time, CAST((l_suppkey % 10) * 10 - 45 AS DOUBLE) AS latitude, CAST((l_partkey % 36) * 10 AS DOUBLE) AS longitude,
  CAST(sum(CAST(l_quantity AS DECIMAL(12,2))) AS DOUBLE) AS value FROM lineitem GROUP BY ALL)"""
_ALL = "SELECT time, latitude, longitude, round(value, 6) AS value FROM g WHERE "
_FLAT = f"WITH {_G}, m AS (SELECT latitude, longitude, avg(value) AS value FROM g GROUP BY ALL)"
_DAY0 = "(SELECT date_trunc('day', min(time)) FROM g)"
_LABEL = {
    "1D": "date_trunc('day', time)", "W": "date_trunc('week', time) + INTERVAL 6 DAY", "ME": "last_day(time)", "MS": "date_trunc('month', time)", "QE": "last_day(date_trunc('quarter', time) + INTERVAL 2 MONTH)",
    "YE": "make_date(year(time), 12, 31)", "12h": "time_bucket(INTERVAL 12 HOUR, time, TIMESTAMP '2000-01-01')", "3D": f"time_bucket(INTERVAL 3 DAY, time, {_DAY0})",
}
_SQL_AGG = {"max": "max", "min": "min", "sum": "sum", "mean": "avg", "median": "median", "var": "var_pop", "std": "stddev_pop"}
RESAMPLES = [("max", "1D"), ("max", "W"), ("min", "W"), ("sum", "W"), ("mean", "W"), ("median", "ME"), ("max", "ME"), ("mean", "MS"), ("sum", "QE"), ("mean", "YE"), ("sum", "3D"), ("var", "ME"), ("std", "ME")]
POINTS = ([40.0, -12.3, 7.0, 7.0, 44.9], [12.0, 355.2, 181.0, 181.0, 9.9])
TRIANGLE = {"type": "Polygon", "coordinates": [[[-5.0, -50.0], [170.0, -20.0], [100.0, 47.0], [-5.0, -50.0]]]}


def _any_all(field: Field) -> DataFrame:
    """Whether any, and whether all of the values of a cell are above 30."""
    above = field.apply_column(lambda v: (v > 30).cast("double"))
    some, every = above.reduce("any", ["time"]).df, above.reduce("all", ["time"]).df.withColumnRenamed("value", "every")
    return some.join(every, ["latitude", "longitude"]).select("latitude", "longitude", F.col("value").alias("some"), "every")


def _features(cube: DataCube) -> DataFrame:
    """The corners and the value of each GeoJSON feature."""
    at = lambda path, kind: F.get_json_object("feature", f"$.{path}").cast(kind)
    ring = "geometry.coordinates[0]"
    return cube.geojson_rows().select(at("geometry.type", "string").alias("kind"), at(f"{ring}[0][0]", "double").alias("west"), at(f"{ring}[0][1]", "double").alias("south"), at(f"{ring}[2][0]", "double").alias("east"), at(f"{ring}[2][1]", "double").alias("north"),
                                      at("units.quantity", "string").alias("units"), F.round(at("properties.quantity", "double"), 6).alias("value"))


def _projected(system) -> Query:  # noqa: ANN001
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        cells = table(spark, sf_dir, "supplier").select("s_suppkey", (F.col("s_suppkey") % 50 + 20).cast("double").alias("lat"), (F.col("s_suppkey") % 40 - 20).cast("double").alias("lon"))
        x, y = system.forward(F.col("lat"), F.col("lon"))
        back_lat, back_lon = system.inverse(F.col("x"), F.col("y"))
        return cells.select("s_suppkey", "lat", "lon", x.alias("x"), y.alias("y")).select("s_suppkey", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"), F.round(back_lat, 6).alias("lat"), F.round(back_lon, 6).alias("lon"))

    return run


def _describe(spark: SparkSession, sf_dir: str) -> DataFrame:
    field = grid(spark, sf_dir)
    rows = []
    for c in field.domain:
        d = c.to_dict()
        rows.append((c.name, str(d["min"]).replace("T", " "), str(d["max"]).replace("T", " "), d["axis"], int(c.values.size)))
    return spark.createDataFrame(rows, "name string, low string, high string, axis string, n long")


def _read_grid(spark: SparkSession, sf_dir: str) -> Field:
    """GRID without given labels: they are read from the table."""
    df = _rows(spark, sf_dir).groupBy("latitude", "longitude").agg(_quantity())
    return Field.from_dataframe(df, "quantity", ("latitude", "longitude"), "value")


def _bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    domain = _read_grid(spark, sf_dir).domain.compute_bounds()
    rows = [(c.name, float(v), float(a), float(b)) for c in (domain.latitude, domain.longitude) for v, (a, b) in zip(c.values, c.bounds)]
    return spark.createDataFrame(rows, "name string, label double, low double, high double")


def _resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    field = _read_grid(spark, sf_dir)
    x, y = field.domain.resolution()
    kinds = field.longitude.convention, field.latitude.convention
    return spark.createDataFrame([(x, y, *(k.value for k in kinds), field.domain.is_latlon_independent, *map(int, field.shape))], "x_step double, y_step double, x_order string, y_order string, independent boolean, n_y long, n_x long")


def _time_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The step of the hours that have events, and the bins of a day after resampling."""
    events = table(spark, sf_dir, "events").select(F.date_trunc("hour", F.col("ts")).cast("timestamp_ntz").alias("time"), "value").groupBy("time").agg(F.max("value").alias("value"))
    field = Field.from_dataframe(events, "peak", ("time",), "value")
    days = field.resample("max", "1D")
    rows = [("read", *field.time.time_step(), field.time.values.size), ("resampled", *days.time.time_step(), days.time.values.size)]
    return spark.createDataFrame([(n, u, int(k), int(m)) for n, u, k, m in rows], "axis string, unit string, step long, n_labels long")


def _round_trip(kind: str) -> Query:
    """Written to the shared folder and read again by this package."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        path = shared_path(spark, f"round-trip-{uuid.uuid4().hex}.{kind}")
        cube = DataCube([flat(spark, sf_dir)])
        getattr(cube, {"nc": "to_netcdf"}.get(kind, f"to_{kind}"))(path)
        return shown(open_datacube(spark, path, dims=["latitude", "longitude"])["quantity"]).select("latitude", "longitude", "value")

    return run


def queries() -> dict[str, Query]:
    north = GeodeticGrid(np.arange(-40.0, 41.0, 8.0), np.arange(2.0, 350.0, 12.0))
    coarse = GeodeticGrid(np.array([-40.0, -10.0, 20.0]), np.array([10.0, 50.0, 90.0, 130.0]))
    q: dict[str, Query] = {
        "geobbox": lambda s, d: shown(grid(s, d).geobbox(north=25, south=-20, west=30, east=120)),
        "geobbox_roll": lambda s, d: shown(grid(s, d).geobbox(north=25, south=-20, west=-30, east=40)),
        "geobbox_open": lambda s, d: shown(grid(s, d).geobbox(south=15)),
        "geobbox_vertical": lambda s, d: shown(vertical_grid(s, d).geobbox(top=-5, bottom=-12, north=0)),
        "geobbox_curvilinear": lambda s, d: shown(curvilinear(s, d).geobbox(north=20, south=-10, west=100, east=160)),
        "sel_exact": lambda s, d: shown(grid(s, d).sel(latitude=5.0)),
        "sel_list": lambda s, d: shown(grid(s, d).sel(longitude=[10.0, 30.0, -20.0], latitude=[-45.0, 45.0])),
        "sel_slice": lambda s, d: shown(grid(s, d).sel(latitude=slice(-20, 10), time=slice("1996-03-05", "1996-04"))),
        "sel_partial_date": lambda s, d: shown(grid(s, d).sel(time="1995-07")),
        "sel_nearest": lambda s, d: shown(grid(s, d).sel({"latitude": 20.0, "longitude": [33.0, 77.0]}, method="nearest")),
        "sel_pad": lambda s, d: shown(grid(s, d).sel(latitude=[12.0], method="pad")),
        "sel_backfill": lambda s, d: shown(grid(s, d).sel(latitude=[12.0], longitude=[31.0], method="backfill")),
        "sel_descending": lambda s, d: shown(grid(s, d, latitudes=LAT[::-1]).sel(latitude=slice(20, -10), longitude=[0.0, 50.0])),
        "sel_missing": lambda s, d: shown(grid(s, d).sel(latitude=1.5, longitude=40.0)),
        "geobbox_descending": lambda s, d: shown(grid(s, d, latitudes=LAT[::-1]).geobbox(north=-20, south=25, west=0, east=90)),
        "sel_time_combo": lambda s, d: shown(grid(s, d).sel(time={"year": [1995, 1996], "month": [3, 9], "day": list(range(1, 8))})),
        "roll_longitude": lambda s, d: shown(grid(s, d).roll_longitude(True)),
        "resample_sum_zero": lambda s, d: shown(grid(s, d).resample("sum", "ME", empty_sum=0.0)),
        "resample_max_1D_present": lambda s, d: shown(grid(s, d).resample("max", "1D", gaps=False)),
        "resample_min_12h_present": lambda s, d: shown(grid(s, d).resample("min", "12h", gaps=False)),
        "resample_median_ME_present": lambda s, d: shown(grid(s, d).resample("median", "ME", gaps=False)),
        "resample_series": lambda s, d: shown(grid(s, d).average("latitude").average("longitude").resample("max", "1D")),
        "average_time": lambda s, d: shown(flat(s, d)),
        "average_all": lambda s, d: shown(grid(s, d).average()),
        "reduce_count": lambda s, d: shown(grid(s, d).reduce("count", ["time"])),
        "reduce_max": lambda s, d: shown(grid(s, d).reduce("max", ["longitude", "latitude"])),
        "reduce_argmax": lambda s, d: shown(flat(s, d).reduce("argmax", ["longitude"])),
        "reduce_argmin": lambda s, d: shown(flat(s, d).reduce("argmin", ["latitude"])),
        "reduce_any_all": lambda s, d: _any_all(grid(s, d)),
        "reduce_prod": lambda s, d: shown(grid(s, d).apply_column(lambda v: F.when(v % 2 == 0, 1.0).otherwise(-1.0)).reduce("prod", ["time"])),
        "isnull": lambda s, d: shown(grid(s, d).where(lambda v: v > 25).isnull().reduce("sum", ["time"])),
        "arithmetic": lambda s, d: (lambda g: shown((g + g.average("time")) * 2.0 / 4.0))(grid(s, d)),
        "compare": lambda s, d: (lambda g: shown((g > g.average("time")).reduce("sum", ["time"])))(grid(s, d)),
        "locations": lambda s, d: shown(grid(s, d).locations(*POINTS)),
        "locations_vertical": lambda s, d: shown(vertical_grid(s, d).locations(*POINTS, vertical=[-3.2])),
        "locations_2d": lambda s, d: shown(curvilinear(s, d).locations(*POINTS)),
        "interp_nearest": lambda s, d: shown(flat(s, d).interpolate(north, "nearest")),
        "interp_linear": lambda s, d: shown(flat(s, d).interpolate(north, "linear")),
        "interp_points": lambda s, d: shown(flat(s, d).interpolate(GeodeticPoints(*POINTS), "linear")),
        "to_regular": lambda s, d: shown(rotated(s, d).to_regular()),
        "regrid_bilinear": lambda s, d: shown(flat(s, d).regrid(coarse, "bilinear")),
        "regrid_conservative": lambda s, d: shown(flat(s, d).regrid(coarse, "conservative")),
        "regrid_conservative_cells": lambda s, d: shown(_bent(s, d).regrid(coarse, "conservative")),
        "regrid_conservative_rotated": lambda s, d: shown(rotated(s, d).with_latlon().regrid(GeodeticGrid(np.arange(36.0, 50.0, 4.0), np.arange(0.0, 25.0, 6.0)), "conservative_normed")),
        "regrid_conservative_normed": lambda s, d: shown(flat(s, d).regrid(coarse, "conservative_normed")),
        "regrid_nearest_s2d": lambda s, d: shown(flat(s, d).regrid(coarse, "nearest_s2d")),
        "regrid_nearest_d2s": lambda s, d: shown(flat(s, d).regrid(coarse, "nearest_d2s")),
        "regrid_patch": lambda s, d: shown(flat(s, d).regrid(coarse, "patch")),
        "regrid_points": lambda s, d: shown(flat(s, d).interpolate(GeodeticPoints(*POINTS), "nearest")),
        "extract_polygons": lambda s, d: shown(grid(s, d).extract_polygons(TRIANGLE)),
        "polygons_uncropped": lambda s, d: shown(flat(s, d).extract_polygons(TRIANGLE, crop=False)),
        "cube_merge": lambda s, d: _merge(s, d).to_wide(),
        "cube_select_fields": lambda s, d: shown(_merge(s, d)["returned"]),
        "dataset_filter": lambda s, d: _members(catalog(s, d).filter(flag=["A", "R"], status="F")),
        "dataset_select": lambda s, d: _members(catalog(s, d)["quantity"].average("time")),
        "dataset_apply": lambda s, d: shown(catalog(s, d).filter(flag="N", status="O").apply("average", dim="time").cubes[0]["quantity"]),
        "convert_units": lambda s, d: shown(grid(s, d).convert_units("g")),
        "normalise": lambda s, d: shown(grid(s, d).normalise(0.0, 255.0)),
        "box_stats": lambda s, d: grid(s, d).box_stats("latitude"),
        "cell_bounds": _bounds,
        "coord_describe": _describe,
        "geojson_cells": lambda s, d: _features(DataCube([flat(s, d)])),
        "image_rows": lambda s, d: DataCube([flat(s, d)]).image_grid().select("latitude", F.posexplode("row").alias("x", "v")).select("latitude", "x", F.round("v", 6).alias("value")),
        "crs_web_mercator": _projected(WebMercator()),
        "crs_polar_stereographic": _projected(PolarStereographic(3413)),
        "crs_orthographic": _projected(Orthographic(40.0, 5.0)),
        "crs_vertical_perspective": _projected(VerticalPerspective(40.0, 5.0)),
        "crs_geostationary": _projected(Geostationary(5.0)),
        "crs_lambert_azimuthal": _projected(LambertAzimuthalEqualArea(52.0, 10.0)),
        "crs_regular": _projected(RegularLatLon()),
        "crs_rotated": _projected(RotatedGeogCS(47.0, -168.0)),
        "crs_mercator": _projected(Mercator()),
        "crs_transverse_mercator": _projected(TransverseMercator()),
        "crs_stereographic": _projected(Stereographic(45.0, 0.0)),
        "crs_lambert_conformal": _projected(LambertConformal(39.0, 10.0)),
        "crs_albers": _projected(AlbersEqualArea()),
    }
    q |= {
        "along_cumsum": lambda s, d: shown(grid(s, d).along("time", "cumsum")),
        "along_rolling_max": lambda s, d: shown(grid(s, d).along("time", "rolling_max", 3)),
        "along_diff": lambda s, d: shown(grid(s, d).along("time", "diff")),
        "along_shift": lambda s, d: shown(grid(s, d).along("time", "shift", 2)),
        "along_cummax": lambda s, d: shown(grid(s, d).along("time", "cummax")),
        "along_rolling_mean": lambda s, d: shown(grid(s, d).along("time", "rolling_mean", 4)),
        "roll_cells": lambda s, d: shown(grid(s, d).roll("longitude", 3)),
        "coarsen": lambda s, d: shown(grid(s, d).coarsen({"latitude": 2, "longitude": 3}, "sum")),
        "resample_callable": lambda s, d: shown(grid(s, d).sel(latitude=[-5.0, 5.0]).resample(lambda v: v.max() - v.min(), "ME")),
        "item": lambda s, d: s.createDataFrame([(round(grid(s, d).average().item(), 6),)], "value double"),
        "cells_joined": lambda s, d: curvilinear(s, d).with_cells().select("y", "x", "latitude", "longitude", F.round("value", 6).alias("value")),
        "along_rank": lambda s, d: shown(flat(s, d).along("longitude", "rank")),
        "quantile": lambda s, d: shown(grid(s, d).quantile(0.9, ["time"])),
        "anomaly": lambda s, d: (lambda g: shown(g - g.average("time")))(grid(s, d)),
        "where_clip": lambda s, d: shown(grid(s, d).where(lambda v: v > 10).fillna(-1.0).clip(0.0, 60.0)),
        "grid_resolution": _resolution,
        "time_step": _time_step,
        "parquet_round_trip": _round_trip("parquet"),
        "csv_round_trip": _round_trip("csv"),
        "netcdf_round_trip": _round_trip("nc"),
        "zarr_round_trip": _round_trip("zarr"),
    }
    for op, freq in RESAMPLES:
        q[f"resample_{op}_{freq}"] = lambda s, d, op=op, freq=freq: shown(grid(s, d).resample(op, freq))
    return q


# the bins from low to high, all of them
_BINS = {
    "1D": "generate_series(lo, hi, INTERVAL 1 DAY)", "W": "generate_series(lo, hi, INTERVAL 7 DAY)", "12h": "generate_series(lo, hi, INTERVAL 12 HOUR)", "3D": "generate_series(lo, hi, INTERVAL 3 DAY)", "MS": "generate_series(lo, hi, INTERVAL 1 MONTH)",
    "ME": "[CAST(last_day(x) AS TIMESTAMP) for x in generate_series(date_trunc('month', lo), hi, INTERVAL 1 MONTH)]", "QE": "[CAST(last_day(x) AS TIMESTAMP) for x in generate_series(date_trunc('month', lo), hi, INTERVAL 3 MONTH)]",
    "YE": "[CAST(last_day(x) AS TIMESTAMP) for x in generate_series(date_trunc('month', lo), hi, INTERVAL 12 MONTH)]",
}


def _gapped(op: str, freq: str) -> str:
    """Every bin of every cell."""
    return f"""WITH {_G}, h AS (SELECT CAST({_LABEL[freq]} AS TIMESTAMP) AS time, latitude, longitude, {_SQL_AGG[op]}(value) AS value FROM g GROUP BY ALL), e AS (SELECT min(time) AS lo, max(time) AS hi FROM h),
  d AS (SELECT unnest({_BINS[freq]}) AS time FROM e), c AS (SELECT DISTINCT latitude, longitude FROM h)
  SELECT CAST(d.time AS TIMESTAMP) AS time, c.latitude, c.longitude, round(h.value, 6) AS value FROM d CROSS JOIN c LEFT JOIN h ON h.time = d.time AND h.latitude = c.latitude AND h.longitude = c.longitude"""


_INSIDE = "latitude BETWEEN -50 AND 47 AND longitude <= 170 AND latitude >= -50 + (longitude + 5) * 30 / 175 AND latitude <= -50 + (longitude + 5) * 97 / 105 AND (longitude <= 100 OR latitude <= -20 + (170 - longitude) * 67 / 70)"
_COARSE = "t AS (SELECT CAST(a AS DOUBLE) AS t1, CAST(o AS DOUBLE) AS t2 FROM (VALUES (-40), (-10), (20)) AS x(a), (VALUES (10), (50), (90), (130)) AS y(o))"
_DOT = "sin(radians(latitude)) * sin(radians(t1)) + cos(radians(latitude)) * cos(radians(t1)) * cos(radians(longitude - t2))"


def oracle_sql() -> dict[str, str]:
    w = f"WITH {_G} "
    pts = ", ".join(f"({i}, {a}, {o})" for i, (a, o) in enumerate(zip(*POINTS)))
    # nearest label by each axis; of two equally near ones the larger
    near = f"""p AS (SELECT * FROM (VALUES {pts}) AS v(points, plat, plon)),
  k AS (SELECT points, (SELECT latitude FROM (SELECT DISTINCT latitude FROM g) ORDER BY abs(latitude - CAST(CAST(plat AS FLOAT) AS DOUBLE)), latitude DESC LIMIT 1) AS la,
    (SELECT longitude FROM (SELECT DISTINCT longitude FROM g) ORDER BY abs(longitude - CAST(CAST(plon AS FLOAT) AS DOUBLE)), longitude DESC LIMIT 1) AS lo FROM p)"""
    curv = """c AS (SELECT CAST(l_suppkey % 10 AS INTEGER) AS y, CAST(l_partkey % 36 AS INTEGER) AS x, CAST(sum(CAST(l_quantity AS DECIMAL(12,2))) AS DOUBLE) AS value FROM lineitem GROUP BY ALL),
  t AS (SELECT y, x, -45 + 10 * y + 0.5 * x AS la, 10 * x + 0.5 * y AS lo FROM c)"""
    vert = """v AS (SELECT CAST(p_size AS DOUBLE) AS depth, CAST((l_suppkey % 10) * 10 - 45 AS DOUBLE) AS latitude, CAST((l_partkey % 36) * 10 AS DOUBLE) AS longitude,
  CAST(sum(CAST(l_quantity AS DECIMAL(12,2))) AS DOUBLE) AS value FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY ALL)"""
    linear = lambda ta, tb: f"""a AS (SELECT * FROM (VALUES {ta}) AS v(tla)), b AS (SELECT * FROM (VALUES {tb}) AS v(tlo)),
  s AS (SELECT tla, tlo, value, (1 - abs(latitude - tla) / 10) * (1 - abs(longitude - tlo) / 10) AS w FROM a, b, m WHERE abs(latitude - tla) < 10 AND abs(longitude - tlo) < 10)
  SELECT a.tla AS latitude, b.tlo AS longitude, round((SELECT sum(w * value) FROM s WHERE s.tla = a.tla AND s.tlo = b.tlo AND b.tlo <= 350), 6) AS value FROM a, b"""  # noqa: E731
    overlap = _FLAT + """, a AS (SELECT * FROM (VALUES (-40.0, -55.0, -25.0), (-10.0, -25.0, 5.0), (20.0, 5.0, 35.0)) AS v(t, lo, hi)), b AS (SELECT * FROM (VALUES (10.0, 0.0, 30.0), (50.0, 30.0, 70.0), (90.0, 70.0, 110.0), (130.0, 110.0, 150.0)) AS v(t, lo, hi)),
  s AS (SELECT a.t AS t1, b.t AS t2, a.lo AS alo, a.hi AS ahi, b.lo AS blo, b.hi AS bhi, value,
    (sin(radians(least(m.latitude + 5, a.hi))) - sin(radians(greatest(m.latitude - 5, a.lo)))) * (least(m.longitude + 5, b.hi) - greatest(m.longitude - 5, b.lo)) AS w
    FROM a, b, m WHERE least(m.latitude + 5, a.hi) > greatest(m.latitude - 5, a.lo) AND least(m.longitude + 5, b.hi) > greatest(m.longitude - 5, b.lo))
  SELECT CAST(t1 AS DOUBLE) AS latitude, CAST(t2 AS DOUBLE) AS longitude, round(sum(w * value) / {by}, 6) AS value FROM s GROUP BY t1, t2"""
    values = lambda xs: ", ".join(f"(CAST({x} AS DOUBLE))" for x in xs)
    o = {
        "geobbox": w + _ALL + "latitude BETWEEN -20 AND 25 AND longitude BETWEEN 30 AND 120",
        "geobbox_roll": w + _ALL + "latitude BETWEEN -20 AND 25 AND (((longitude + 180) % 360) - 180) BETWEEN -30 AND 40",
        "geobbox_open": w + _ALL + "latitude >= 15",
        "geobbox_vertical": f"WITH {vert} SELECT depth, latitude, longitude, round(value, 6) AS value FROM v WHERE depth BETWEEN 5 AND 12 AND latitude <= 0",
        "geobbox_curvilinear": f"""WITH {curv}, r AS (SELECT min(y) AS y0, max(y) AS y1, min(x) AS x0, max(x) AS x1 FROM t WHERE la BETWEEN -10 AND 20 AND lo BETWEEN 100 AND 160)
  SELECT CAST(y - y0 AS INTEGER) AS y, CAST(x - x0 AS INTEGER) AS x, round(value, 6) AS value FROM c, r WHERE y BETWEEN y0 AND y1 AND x BETWEEN x0 AND x1""",
        "sel_exact": w + "SELECT time, longitude, round(value, 6) AS value FROM g WHERE latitude = 5",
        "sel_list": w + _ALL + "longitude IN (10, 30, 340) AND latitude IN (-45, 45)",
        "sel_slice": w + _ALL + "latitude BETWEEN -20 AND 10 AND time >= '1996-03-05' AND time < '1996-05-01'",
        "sel_partial_date": w + _ALL + "time >= '1995-07-01' AND time < '1995-08-01'",
        "sel_nearest": w + "SELECT time, longitude, round(value, 6) AS value FROM g WHERE latitude = 25 AND longitude IN (30, 80)",
        "sel_pad": w + _ALL + "latitude = 5",
        "sel_time_combo": w + _ALL + "year(time) IN (1995, 1996) AND month(time) IN (3, 9) AND day(time) BETWEEN 1 AND 7",
        "roll_longitude": w + "SELECT time, latitude, ((longitude + 180) % 360) - 180 AS longitude, round(value, 6) AS value FROM g",
        "resample_sum_zero": _gapped("sum", "ME").replace("round(h.value, 6)", "coalesce(round(h.value, 6), 0)"),
        "resample_max_1D_present": w + f"SELECT CAST({_LABEL['1D']} AS TIMESTAMP) AS time, latitude, longitude, round(max(value), 6) AS value FROM g GROUP BY ALL",
        "resample_min_12h_present": w + f"SELECT CAST({_LABEL['12h']} AS TIMESTAMP) AS time, latitude, longitude, round(min(value), 6) AS value FROM g GROUP BY ALL",
        "resample_median_ME_present": w + f"SELECT CAST({_LABEL['ME']} AS TIMESTAMP) AS time, latitude, longitude, round(median(value), 6) AS value FROM g GROUP BY ALL",
        "resample_series": w + """, a AS (SELECT time, longitude, avg(value) AS value FROM g GROUP BY ALL), b AS (SELECT time, avg(value) AS value FROM a GROUP BY ALL),
  e AS (SELECT unnest(generate_series(min(time), max(time), INTERVAL 1 DAY)) AS time FROM b) SELECT e.time, round(b.value, 6) AS value FROM e LEFT JOIN b USING (time)""",
        "reduce_max": w + "SELECT time, round(max(value), 6) AS value FROM g GROUP BY time",
        "reduce_argmin": _FLAT + " SELECT longitude, latitude AS value FROM (SELECT *, row_number() OVER (PARTITION BY longitude ORDER BY value, latitude) AS k FROM m) WHERE k = 1",
        "reduce_any_all": w + "SELECT latitude, longitude, CAST(max(value) > 30 AS DOUBLE) AS some, CAST(min(value) > 30 AS DOUBLE) AS every FROM g GROUP BY ALL",
        "reduce_prod": w + "SELECT latitude, longitude, CASE WHEN sum(CASE WHEN value % 2 = 0 THEN 0 ELSE 1 END) % 2 = 0 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS value FROM g GROUP BY ALL",
        "isnull": w + "SELECT latitude, longitude, CAST(sum(CASE WHEN value > 25 THEN 0 ELSE 1 END) AS DOUBLE) AS value FROM g GROUP BY ALL",
        "arithmetic": _FLAT + " SELECT g.time, latitude, longitude, round((g.value + m.value) / 2, 6) AS value FROM g JOIN m USING (latitude, longitude)",
        "compare": _FLAT + " SELECT latitude, longitude, CAST(sum(CASE WHEN g.value > m.value THEN 1 ELSE 0 END) AS DOUBLE) AS value FROM g JOIN m USING (latitude, longitude) GROUP BY ALL",
        "sel_backfill": w + _ALL + "latitude = 15 AND longitude = 40",
        "sel_descending": w + _ALL + "latitude BETWEEN -10 AND 20 AND longitude IN (0, 50)",
        "sel_missing": w + "SELECT time, latitude, round(value, 6) AS value FROM g WHERE longitude = 40",
        "geobbox_descending": w + _ALL + "latitude BETWEEN -20 AND 25 AND longitude BETWEEN 0 AND 90",
        "dataset_select": f"WITH {_G.replace('AS longitude,', 'AS longitude, l_returnflag AS flag, l_linestatus AS status,')} SELECT flag, status, latitude, longitude, round(avg(value), 6) AS value FROM g GROUP BY ALL",
        "geojson_cells": _FLAT + """, e AS (SELECT min(latitude) AS a0, max(latitude) AS a1, min(longitude) AS o0, max(longitude) AS o1 FROM m)
  SELECT 'Polygon' AS kind, greatest(longitude - 5, o0) AS west, greatest(latitude - 5, a0) AS south, least(longitude + 5, o1) AS east, least(latitude + 5, a1) AS north, 'kg' AS units, round(value, 6) AS value FROM m, e""",
        "interp_points": _FLAT + f""", p AS (SELECT * FROM (VALUES {pts}) AS v(points, la, lo)), s AS (SELECT points, lo, value, (1 - abs(latitude - la) / 10) * (1 - abs(longitude - lo) / 10) AS w FROM p, m WHERE abs(latitude - la) < 10 AND abs(longitude - lo) < 10)
  SELECT CAST(points AS INTEGER) AS points, round(CASE WHEN lo <= 350 THEN sum(w * value) END, 6) AS value FROM s GROUP BY points, lo""",
        "regrid_points": _FLAT + f""", p AS (SELECT * FROM (VALUES {pts}) AS v(points, la, lo)), s AS (SELECT points, lo, value, row_number() OVER (PARTITION BY points ORDER BY abs(latitude - la), latitude DESC, abs(longitude - lo), longitude DESC) AS k FROM p, m)
  SELECT CAST(points AS INTEGER) AS points, CASE WHEN lo <= 350 THEN round(value, 6) END AS value FROM s WHERE k = 1""",
        "polygons_uncropped": _FLAT + f" SELECT latitude, longitude, CASE WHEN {_INSIDE} THEN round(value, 6) END AS value FROM m",
        "regrid_nearest_s2d": _FLAT + f""", {_COARSE}, s AS (SELECT t1, t2, value, row_number() OVER (PARTITION BY t1, t2 ORDER BY round({_DOT}, 11) DESC, latitude, longitude) AS k FROM t, m)
  SELECT t1 AS latitude, t2 AS longitude, round(value, 6) AS value FROM s WHERE k = 1""",
        "regrid_nearest_d2s": _FLAT + f""", {_COARSE}, s AS (SELECT t1, t2, value, row_number() OVER (PARTITION BY latitude, longitude ORDER BY round({_DOT}, 11) DESC, t1, t2) AS k FROM t, m)
  SELECT t1 AS latitude, t2 AS longitude, round(sum(value), 6) AS value FROM s WHERE k = 1 GROUP BY ALL""",
        "average_time": _FLAT + " SELECT latitude, longitude, round(value, 6) AS value FROM m",
        "average_all": w + "SELECT round(avg(value), 6) AS value FROM g",
        "reduce_count": w + "SELECT latitude, longitude, CAST(count(value) AS DOUBLE) AS value FROM g GROUP BY ALL",
        "reduce_argmax": _FLAT + " SELECT latitude, longitude AS value FROM (SELECT *, row_number() OVER (PARTITION BY latitude ORDER BY value DESC, longitude) AS k FROM m) WHERE k = 1",
        "locations": w + f", {near} SELECT time, CAST(points AS INTEGER) AS points, round(value, 6) AS value FROM g JOIN k ON latitude = la AND longitude = lo",
        "locations_vertical": f"WITH {vert}, g AS (SELECT * FROM v WHERE depth = 3), {near.replace('FROM g)', 'FROM v)')} SELECT depth, CAST(points AS INTEGER) AS points, round(value, 6) AS value FROM g JOIN k ON latitude = la AND longitude = lo",
        "locations_2d": f"""WITH {curv}, p AS (SELECT * FROM (VALUES {pts}) AS v(points, plat, plon)),
  n AS (SELECT points, y, x, row_number() OVER (PARTITION BY points ORDER BY (la - CAST(CAST(plat AS FLOAT) AS DOUBLE)) ** 2 + (lo - CAST(CAST(plon AS FLOAT) AS DOUBLE)) ** 2, y, x) AS k FROM p, t)
  SELECT CAST(points AS INTEGER) AS points, round(value, 6) AS value FROM n JOIN c USING (y, x) WHERE k = 1""",
        "interp_linear": _FLAT + ", " + linear(values(np.arange(-40.0, 41.0, 8.0)), values(np.arange(2.0, 350.0, 12.0))),
        "regrid_bilinear": _FLAT + ", " + linear(values([-40.0, -10.0, 20.0]), values([10.0, 50.0, 90.0, 130.0])),
        "interp_nearest": _FLAT + f""", a AS (SELECT * FROM (VALUES {values(np.arange(-40.0, 41.0, 8.0))}) AS v(t)), b AS (SELECT * FROM (VALUES {values(np.arange(2.0, 350.0, 12.0))}) AS v(t)),
  s AS (SELECT a.t AS latitude, b.t AS longitude, value, row_number() OVER (PARTITION BY a.t, b.t ORDER BY abs(m.latitude - a.t), m.latitude DESC, abs(m.longitude - b.t), m.longitude DESC) AS k FROM a, b, m)
  SELECT latitude, longitude, round(value, 6) AS value FROM s WHERE k = 1""",
        "regrid_conservative": overlap.format(by="any_value((sin(radians(ahi)) - sin(radians(alo))) * (bhi - blo))"),
        "regrid_conservative_cells": overlap.format(by="any_value((sin(radians(ahi)) - sin(radians(alo))) * (bhi - blo))"),
        "regrid_conservative_normed": overlap.format(by="sum(w)"),
        "extract_polygons": w + _ALL + _INSIDE,
        "cube_merge": """WITH a AS (SELECT l_shipdate AS time, CAST((l_suppkey % 10) * 10 - 45 AS DOUBLE) AS latitude, CAST((l_partkey % 36) * 10 AS DOUBLE) AS longitude, l_returnflag AS f, CAST(sum(CAST(l_quantity AS DECIMAL(12,2))) AS DOUBLE) AS value FROM lineitem GROUP BY ALL)
  SELECT time, latitude, longitude, r.value AS returned, n.value AS "none" FROM (SELECT * FROM a WHERE f = 'A') r FULL JOIN (SELECT * FROM a WHERE f = 'N') n USING (time, latitude, longitude)""",
        "cube_select_fields": f"WITH {_G.replace('FROM lineitem', 'FROM lineitem WHERE l_returnflag = ' + chr(39) + 'A' + chr(39))} SELECT time, latitude, longitude, round(value, 6) AS value FROM g",
        "dataset_filter": f"WITH {_G.replace('AS longitude,', 'AS longitude, l_returnflag AS flag, l_linestatus AS status,')} SELECT flag, status, time, latitude, longitude, round(value, 6) AS value FROM g WHERE flag IN ('A', 'R') AND status = 'F'",
        "dataset_apply": f"WITH {_G.replace('FROM lineitem', 'FROM lineitem WHERE l_returnflag = ' + chr(39) + 'N' + chr(39) + ' AND l_linestatus = ' + chr(39) + 'O' + chr(39))} SELECT latitude, longitude, round(avg(value), 6) AS value FROM g GROUP BY ALL",
        "convert_units": w + "SELECT time, latitude, longitude, round(value * 1000, 6) AS value FROM g",
        "normalise": w + "SELECT time, latitude, longitude, round((value - (SELECT min(value) FROM g)) / (SELECT max(value) - min(value) FROM g) * 255, 6) AS value FROM g",
        "box_stats": w + "SELECT latitude, min(value) AS lowest, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS median, quantile_cont(value, 0.75) AS q3, max(value) AS highest FROM g GROUP BY latitude",
        "cell_bounds": w + """, c AS (SELECT DISTINCT 'latitude' AS name, latitude AS label, latitude - 5 AS low, latitude + 5 AS high FROM g UNION SELECT DISTINCT 'longitude', longitude, greatest(longitude - 5, 0), longitude + 5 FROM g) SELECT * FROM c""",
        "coord_describe": w + """SELECT 'time' AS name, CAST(min(time) AS VARCHAR) AS low, CAST(max(time) AS VARCHAR) AS high, 'TIME' AS axis, count(DISTINCT time) AS n FROM g
  UNION ALL SELECT 'latitude', printf('%.1f', min(latitude)), printf('%.1f', max(latitude)), 'LATITUDE', count(DISTINCT latitude) FROM g
  UNION ALL SELECT 'longitude', printf('%.1f', min(longitude)), printf('%.1f', max(longitude)), 'LONGITUDE', count(DISTINCT longitude) FROM g""",
        "image_rows": _FLAT + ", e AS (SELECT min(value) AS a, max(value) AS b FROM m) SELECT latitude, CAST(row_number() OVER (PARTITION BY latitude ORDER BY longitude) - 1 AS INTEGER) AS x, round((value - a) / (b - a), 6) AS value FROM m, e",
    }
    o |= {
        "along_cumsum": w + "SELECT time, latitude, longitude, round(sum(value) OVER (PARTITION BY latitude, longitude ORDER BY time), 6) AS value FROM g",
        "along_rolling_max": w + "SELECT time, latitude, longitude, round(max(value) OVER (PARTITION BY latitude, longitude ORDER BY time ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 6) AS value FROM g",
        "along_diff": w + "SELECT time, latitude, longitude, round(value - lag(value) OVER (PARTITION BY latitude, longitude ORDER BY time), 6) AS value FROM g",
        "along_shift": w + "SELECT time, latitude, longitude, round(lag(value, 2) OVER (PARTITION BY latitude, longitude ORDER BY time), 6) AS value FROM g",
        "along_cummax": w + "SELECT time, latitude, longitude, round(max(value) OVER (PARTITION BY latitude, longitude ORDER BY time), 6) AS value FROM g",
        "along_rolling_mean": w + "SELECT time, latitude, longitude, round(avg(value) OVER (PARTITION BY latitude, longitude ORDER BY time ROWS BETWEEN 3 PRECEDING AND CURRENT ROW), 6) AS value FROM g",
        "roll_cells": w + "SELECT time, latitude, (longitude + 30) % 360 AS longitude, round(value, 6) AS value FROM g",
        "coarsen": w + "SELECT time, floor((latitude + 45) / 20) * 20 - 40 AS latitude, floor(longitude / 30) * 30 + 10 AS longitude, round(sum(value), 6) AS value FROM g GROUP BY ALL",
        "resample_callable": _gapped("max", "ME").replace("max(value) AS value FROM g", "max(value) - min(value) AS value FROM g WHERE latitude IN (-5, 5)"),
        "item": w + "SELECT round(avg(value), 6) AS value FROM g",
        "cells_joined": f"WITH {curv} SELECT c.y, c.x, la AS latitude, CAST(lo AS DOUBLE) AS longitude, round(value, 6) AS value FROM c JOIN t USING (y, x)",
        "along_rank": _FLAT + " SELECT latitude, longitude, CAST(rank() OVER (PARTITION BY latitude ORDER BY value) AS DOUBLE) AS value FROM m",
        "quantile": w + "SELECT latitude, longitude, round(quantile_cont(value, 0.9), 6) AS value FROM g GROUP BY ALL",
        "anomaly": _FLAT + " SELECT g.time, g.latitude, g.longitude, round(g.value - m.value, 6) AS value FROM g JOIN m USING (latitude, longitude)",
        "where_clip": w + "SELECT time, latitude, longitude, round(least(greatest(CASE WHEN value > 10 THEN value ELSE -1 END, 0), 60), 6) AS value FROM g",
        "grid_resolution": w + """, y AS (SELECT latitude AS v, v - lag(v) OVER (ORDER BY v) AS step FROM (SELECT DISTINCT latitude FROM g)), x AS (SELECT longitude AS v, v - lag(v) OVER (ORDER BY v) AS step FROM (SELECT DISTINCT longitude FROM g))
  SELECT (SELECT mode(step) FROM x) AS x_step, (SELECT mode(step) FROM y) AS y_step, CASE WHEN (SELECT min(v) FROM x) < 0 THEN '-180..180' ELSE '0..360' END AS x_order, '-90..90' AS y_order, true AS independent, (SELECT count(*) FROM y) AS n_y, (SELECT count(*) FROM x) AS n_x""",
        "time_step": """WITH h AS (SELECT DISTINCT date_trunc('hour', ts) AS t FROM events), s AS (SELECT t - lag(t) OVER (ORDER BY t) AS step FROM h)
  SELECT 'read' AS axis, 'hour' AS unit, CAST((SELECT mode(epoch(step)) FROM s WHERE step IS NOT NULL) / 3600 AS BIGINT) AS step, (SELECT count(*) FROM h) AS n_labels UNION ALL SELECT 'resampled', 'day', 1, date_diff('day', min(t), max(t)) + 1 FROM h""",
        **{f"{k}_round_trip": _FLAT + " SELECT latitude, longitude, round(value, 6) AS value FROM m" for k in ("parquet", "csv", "netcdf", "zarr")},
    }
    for op, freq in RESAMPLES:
        o[f"resample_{op}_{freq}"] = _gapped(op, freq)
    lat, lon = "radians(CAST(s_suppkey % 50 + 20 AS DOUBLE))", "radians(CAST(s_suppkey % 40 - 20 AS DOUBLE))"
    base = f"WITH c AS (SELECT s_suppkey, {lat} AS p, {lon} AS l, CAST(s_suppkey % 50 + 20 AS DOUBLE) AS lat, CAST(s_suppkey % 40 - 20 AS DOUBLE) AS lon FROM supplier) SELECT s_suppkey, round({{x}}, 4) AS x, round({{y}}, 4) AS y, round(lat, 6) AS lat, round(lon, 6) AS lon FROM c"
    r = "6371229.0"
    o["crs_mercator"] = base.format(x=f"{r} * l", y=f"{r} * ln(tan(pi() / 4 + p / 2))")
    o["crs_transverse_mercator"] = base.format(x=f"{r} / 2 * ln((1 + cos(p) * sin(l)) / (1 - cos(p) * sin(l)))", y=f"{r} * atan2(tan(p), cos(l))")
    o["crs_stereographic"] = base.format(x=f"2 * {r} / (1 + sin(radians(45)) * sin(p) + cos(radians(45)) * cos(p) * cos(l)) * cos(p) * sin(l)", y=f"2 * {r} / (1 + sin(radians(45)) * sin(p) + cos(radians(45)) * cos(p) * cos(l)) * (cos(radians(45)) * sin(p) - sin(radians(45)) * cos(p) * cos(l))")
    o["crs_web_mercator"] = base.format(x="6378137.0 * l", y="6378137.0 * ln(tan(pi() / 4 + p / 2))")
    o["crs_regular"] = base.format(x="degrees(l)", y="degrees(p)")
    seen = lambda lat0, lon0: (f"(sin(radians({lat0})) * sin(p) + cos(radians({lat0})) * cos(p) * cos(l - radians({lon0})))", f"cos(p) * sin(l - radians({lon0}))", f"(cos(radians({lat0})) * sin(p) - sin(radians({lat0})) * cos(p) * cos(l - radians({lon0})))")
    c, px, py = seen(40, 5)
    o["crs_orthographic"] = base.format(x=f"{r} * {px}", y=f"{r} * {py}")
    h = "35785831.0"
    o["crs_vertical_perspective"] = base.format(x=f"{h} / (1 + {h} / {r} - {c}) * {px}", y=f"{h} / (1 + {h} / {r} - {c}) * {py}")
    c, px, py = seen(52, 10)
    o["crs_lambert_azimuthal"] = base.format(x=f"{r} * sqrt(2 / (1 + {c})) * {px}", y=f"{r} * sqrt(2 / (1 + {c})) * {py}")
    depth, vy, vz = f"({h} + {r} - {r} * cos(p) * cos(l - radians(5)))", f"({r} * cos(p) * sin(l - radians(5)))", f"({r} * sin(p))"
    o["crs_geostationary"] = base.format(x=f"{h} * atan2({vy}, {depth})", y=f"{h} * atan2({vz}, sqrt({depth} ** 2 + {vy} ** 2))")
    tan = lambda v: f"tan(pi() / 4 + ({v}) / 2)"
    n = f"(ln(cos(radians(33)) / cos(radians(45))) / ln({tan('radians(45)')} / {tan('radians(33)')}))"
    f = f"({r} * cos(radians(33)) * {tan('radians(33)')} ** {n} / {n})"
    o["crs_lambert_conformal"] = base.format(x=f"{f} / {tan('p')} ** {n} * sin({n} * (l - radians(10)))", y=f"{f} / {tan('radians(39)')} ** {n} - {f} / {tan('p')} ** {n} * cos({n} * (l - radians(10)))")
    n = "((sin(radians(20)) + sin(radians(50))) / 2)"
    rho = lambda v: f"({r} / {n} * sqrt(cos(radians(20)) ** 2 + 2 * {n} * sin(radians(20)) - 2 * {n} * sin({v})))"
    o["crs_albers"] = base.format(x=f"{rho('p')} * sin({n} * l)", y=f"{rho('0')} - {rho('p')} * cos({n} * l)")
    # WGS 84, true at 70 degrees north, straight down at 45 degrees west
    e = "sqrt(2 / 298.257223563 - (1 / 298.257223563) ** 2)"
    t = lambda v: f"(tan(pi() / 4 - ({v}) / 2) / ((1 - {e} * sin({v})) / (1 + {e} * sin({v}))) ** ({e} / 2))"
    rho = f"(6378137.0 * cos(radians(70)) / sqrt(1 - ({e} * sin(radians(70))) ** 2) * {t('p')} / {t('radians(70)')})"
    o["crs_polar_stereographic"] = base.format(x=f"{rho} * sin(l + radians(45))", y=f"-{rho} * cos(l + radians(45))")
    d = "(l - radians(-168))"
    o["crs_rotated"] = base.format(x=f"degrees(atan2(-cos(p) * sin({d}), cos(radians(47)) * sin(p) - sin(radians(47)) * cos(p) * cos({d})))", y=f"degrees(asin(sin(radians(47)) * sin(p) + cos(radians(47)) * cos(p) * cos({d})))")
    return o

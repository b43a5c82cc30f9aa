import json
import os
import shutil
import struct
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from fieldloom.core.cube import DataCube, plot_kind
from fieldloom.core.domain import Domain, DomainType, GeodeticGrid, GeodeticPoints
from fieldloom.core.field import Field
from fieldloom.crs.systems import CurvilinearGrid, RotatedGeogCS
from fieldloom.meta.coordinate import Coordinate
from fieldloom.operators.resample import bins_of, parse_frequency
from fieldloom.operators.select import EmptyDataError
from fieldloom.sources.codecs import read_blosc
from fieldloom.sources.catalog import engine_of, name_pattern, open_datacube, open_dataset

TIMES = np.array(["2020-01-01", "2020-01-02", "2020-01-05", "2020-02-03"], dtype="datetime64[D]")


@pytest.fixture(scope="module")
def field(spark):
    rng = np.random.default_rng(1)
    data = rng.random((4, 5, 8))
    data[1, 2, 3] = np.nan
    return Field.from_arrays(spark, data, "t", ("time", "latitude", "longitude"), {"time": TIMES, "latitude": np.array([40.0, 20.0, 0.0, -20.0, -40.0]), "longitude": np.arange(0.0, 360.0, 45.0)}, domaintype=DomainType.GRIDDED, units="degC", cell_methods="time: mean"), data


def test_dense_round_trip(field):
    f, data = field
    assert np.allclose(f.to_dense(), data, equal_nan=True) and f.shape == (4, 5, 8) and f.df.where("value is null").count() == 1


def test_boxes(field):
    f, data = field
    assert np.allclose(f.geobbox(north=25, south=-20, west=45, east=135).to_dense(), data[:, 1:4, 1:4], equal_nan=True)
    rolled = f.geobbox(west=-50, east=10)
    assert sorted(rolled.longitude.values) == [0.0, 315.0] and rolled.df.count() == 4 * 5 * 2
    assert f.geobbox(west=350, east=10).df.count() == 0 and sorted(f.geobbox(west=300, east=50, wrap=True).longitude.values) == [0.0, 45.0, 315.0]
    again = rolled.geobbox(west=-50, east=10)
    assert again.df.count() == rolled.df.count()
    with pytest.raises(KeyError):
        f.geobbox()
    with pytest.raises(ValueError):
        f.geobbox(top=1)


def test_vertical_box(spark):
    v = Coordinate("depth", np.array([1.0, 5.0, 10.0]), ("depth",), properties={"positive": "down"})
    f = Field.from_arrays(spark, np.arange(3.0), "w", ("depth",), {"depth": v})
    assert f.geobbox(top=-2, bottom=-7).to_dense().tolist() == [1.0] and f.geobbox(top=7, bottom=2).df.count() == 0


def test_sel(field):
    f, data = field
    assert np.allclose(f.sel(latitude=20.0).to_dense(), data[:, 1], equal_nan=True) and f.sel(latitude=20.0).latitude.values == 20.0
    assert "latitude" not in f.sel(latitude=20.0, drop=True).domain
    assert f.sel(latitude=slice(None, 20)).latitude.values.tolist() == [40.0, 20.0]
    assert f.sel(latitude=slice(20, -20)).latitude.values.tolist() == [20.0, 0.0, -20.0]
    assert len(f.sel(time="2020-01").time.values) == 3 and len(f.sel(time=slice("2020-01-02", "2020-01")).time.values) == 2
    assert f.sel(latitude=10.0, method="nearest").latitude.values == 20.0 and f.sel(latitude=11.0, method="nearest", tolerance=1).shape == f.shape
    assert f.sel(longitude=-45.0).longitude.values == 315.0 and f.sel(time={"month": 1, "day": [2, 5]}).time.values.size == 2
    assert f.sel(latitude=3.3).shape == f.shape and f.sel(depth=3).shape == f.shape
    with pytest.raises(KeyError):
        f.sel(latitude=3.3, on_missing="raise")
    with pytest.raises(EmptyDataError):
        f.sel(time={"year": 1999})
    assert len(DataCube([f]).sel(time={"year": 1999})) == 0
    assert f.sel(latitude=[7.0], method="pad").latitude.values.tolist() == [0.0] and f.sel(latitude=[7.0], method="backfill").latitude.values.tolist() == [20.0]


def test_pushdown(spark, tmp_path, field):
    f, _ = field
    f.to_parquet(str(tmp_path / "t"))
    cube = open_datacube(spark, str(tmp_path / "t"), engine="parquet", dims=["time", "latitude", "longitude"])
    plan = cube["value"].geobbox(north=25, south=-20).sel(time="2020-01-02").df._jdf.queryExecution().executedPlan().toString()
    pushed = plan[plan.index("PushedFilters"):]
    assert "latitude" in pushed.split("]")[0] and "time" in pushed.split("]")[0]


def test_curvilinear(spark):
    y, x = np.meshgrid(np.arange(4), np.arange(6), indexing="ij")
    lat, lon = 10.0 * y + x, 10.0 * x + y
    f = Field.from_arrays(spark, (y * 10 + x).astype(float), "c", ("y", "x"), {"latitude": (("y", "x"), lat), "longitude": (("y", "x"), lon)}, CurvilinearGrid(), DomainType.GRIDDED)
    box = f.geobbox(north=25, south=9, west=15, east=33)
    assert box.to_dense().tolist() == [[12.0, 13.0], [22.0, 23.0]] and box.latitude.values.shape == (2, 2)
    at = f.locations([11.0, 30.0], [31.0, 3.0]).to_dense()
    assert at.tolist() == [13.0, 30.0] and f.geobbox(north=-50, south=-60).df.count() == 0
    assert f.regrid(GeodeticGrid([11.0], [11.0]), "nearest_s2d").to_dense().tolist() == [[11.0]]
    with pytest.raises(NotImplementedError):
        f.interpolate(GeodeticGrid([11.0], [11.0]))


@pytest.mark.parametrize("frequency, alias", [("1D", "1D"), ("7h", "7h"), ("3D", "3D"), ("W", "W"), ("ME", "ME"), ("2ME", "2ME"), ("MS", "MS"), ("QE", "QE"), ("YE", "YE"), ("QS", "QS"), ("2MS", "2MS")])
@pytest.mark.parametrize("operator", ["max", "sum", "mean", "median", "min"])
def test_resample(spark, frequency, alias, operator):
    rng = np.random.default_rng(3)
    t = pd.date_range("2019-11-28 03:00", periods=160, freq="13h").delete(slice(40, 90))
    v = rng.random(len(t))
    f = Field.from_arrays(spark, v, "r", ("time",), {"time": t.to_numpy()})
    out = f.resample(operator, frequency)
    got = out.df.toPandas().set_index("time")["value"].sort_index()
    want = getattr(pd.Series(v, index=t).resample(alias), operator)(**({"min_count": 1} if operator == "sum" else {}))
    assert got.index.tolist() == want.index.tolist() and np.allclose(got.to_numpy(dtype=float), want.to_numpy(dtype=float), equal_nan=True)
    assert pd.DatetimeIndex(out.time.values).tolist() == want.index.tolist()


def test_resample_rules(spark, field):
    f, data = field
    with pytest.raises(NotImplementedError):
        f.resample("mode", "1D")
    with pytest.raises(NotImplementedError):
        f.resample("undefined", "1D")
    with pytest.raises(ValueError):
        parse_frequency("5 parsecs")
    assert f.resample("maximum", "D").df.count() == 34 * 40 and f.resample("sum", "D", gaps=False).df.count() == 4 * 40
    total = f.resample("sum", "ME").df.agg({"value": "sum"}).first()[0]
    assert total == pytest.approx(np.nansum(data)) and len(bins_of(TIMES, "ME")) == 2
    assert f.resample("sum", "D", empty_sum=0.0).df.where("value is null").count() == 0


def test_average(field):
    f, data = field
    assert np.allclose(f.average("time").to_dense(), np.nanmean(data, axis=0)) and float(f.average().to_dense()) == pytest.approx(np.nanmean(data))
    with pytest.raises(ValueError):
        f.average("depth")
    assert np.allclose(f.reduce("count", ["time"]).to_dense(), (~np.isnan(data)).sum(axis=0))
    assert np.allclose(f.normalise().to_dense(), (data - np.nanmin(data)) / (np.nanmax(data) - np.nanmin(data)), equal_nan=True)
    assert np.allclose(f.convert_units("K").to_dense(), data + 273.15, equal_nan=True) and f.convert_units("K").units == "K"
    q = f.box_stats("latitude").orderBy("latitude").toPandas()
    assert q["median"].iloc[0] == pytest.approx(np.median(data[:, 4]))


def test_along(field, spark):
    f, data = field
    filled = np.nan_to_num(data)
    assert np.allclose(f.fillna(0).along("time", "cumsum").to_dense(), filled.cumsum(axis=0)) and np.allclose(f.fillna(0).along("latitude", "diff").to_dense()[:, :-1], filled[:, :-1] - filled[:, 1:])
    assert np.allclose(f.fillna(0).along("time", "rolling_mean", 2).to_dense()[1:], (filled[1:] + filled[:-1]) / 2) and np.isnan(f.along("time", "shift").to_dense()[0]).all()
    assert f.fillna(0).along("time", "rank").to_dense().max() == 4 and np.allclose(f.quantile(0.5, ["time"]).to_dense(), np.nanmedian(data, axis=0))
    assert np.allclose((f - f.average("time")).to_dense(), data - np.nanmean(data, axis=0), equal_nan=True) and np.allclose((f * 2 + 1).to_dense(), data * 2 + 1, equal_nan=True)
    assert np.allclose((f / f.average()).to_dense(), data / np.nanmean(data), equal_nan=True) and (f > 0.5).reduce("sum").to_dense() == (data > 0.5).sum()
    assert np.allclose(f.where(lambda v: v > 0.5, 0.0).clip(0.2, 0.9).to_dense(), np.clip(np.where(data > 0.5, data, 0.0), 0.2, 0.9)) and f.isnull().reduce("sum").to_dense() == 1
    assert f.transpose("longitude", "time", "latitude").to_dense().shape == (8, 4, 5)
    with pytest.raises(NotImplementedError):
        f.along("time", "fft")
    with pytest.raises(ValueError):
        f.average("time") + f


def test_locations(field):
    f, data = field
    got = f.locations([21.0, -33.0, 21.0], [50.0, -40.0, 50.0])
    assert np.allclose(got.to_dense(), data[:, [1, 4, 1], [1, 7, 1]], equal_nan=True) and got.domain.type is DomainType.POINTS
    with pytest.raises(ValueError):
        f.locations([1.0], [2.0, 3.0])


def test_interpolate(field):
    f, data = field
    got = f.interpolate(GeodeticGrid([30.0, -40.0, 80.0], [45.0, 60.0]), "linear").to_dense()
    a = (data[:, 0] + data[:, 1]) / 2
    assert np.allclose(got[:, 0, 0], a[:, 1]) and np.allclose(got[:, 0, 1], a[:, 1] * (2 / 3) + a[:, 2] / 3) and np.isnan(got[:, 2]).all()
    assert np.allclose(f.interpolate(GeodeticPoints([30.0], [45.0]), "linear").to_dense()[:, 0], a[:, 1])
    poisoned = f.interpolate(GeodeticGrid([1.0], [140.0]), "linear").to_dense()
    assert np.isnan(poisoned[1, 0, 0]) and not np.isnan(poisoned[0, 0, 0])
    assert np.allclose(f.interpolate(GeodeticGrid([21.0], [50.0])).to_dense()[:, 0, 0], data[:, 1, 1])
    with pytest.raises(NotImplementedError):
        f.interpolate(GeodeticGrid([1.0], [1.0]), "cubic")


def test_regrid(spark, tmp_path):
    lat, lon = np.arange(-87.5, 90.0, 5.0), np.arange(2.5, 360.0, 5.0)
    glat, glon = np.meshgrid(lat, lon, indexing="ij")
    data = np.sin(np.radians(glat)) + np.cos(np.radians(glon)) * 0.5
    f = Field.from_arrays(spark, data, "s", ("latitude", "longitude"), {"latitude": lat, "longitude": lon}, properties={"cell_measures": "area"})
    target = GeodeticGrid(np.arange(-80.0, 81.0, 20.0), np.arange(10.0, 360.0, 20.0))
    tlat, tlon = np.meshgrid(target.latitude.values, target.longitude.values, indexing="ij")
    truth = np.sin(np.radians(tlat)) + np.cos(np.radians(tlon)) * 0.5
    for method, off in (("bilinear", 0.02), ("patch", 0.002), ("nearest_s2d", 0.08)):
        out = f.regrid(target, method)
        assert np.abs(out.to_dense() - truth).max() < off, method
        assert "cell_measures" not in out.properties
    path = str(tmp_path / "w.parquet")
    conservative = f.regrid(target, "conservative", weights_path=path).to_dense()
    assert os.path.exists(path) and np.allclose(f.regrid(target, "conservative", weights_path=path).to_dense(), conservative)
    area = lambda b: np.abs(np.diff(np.sin(np.radians(b)), axis=1))[:, 0]
    src = (data * area(f.latitude.cell_bounds())[:, None]).sum() * 5
    dst = (conservative * area(target.latitude.cell_bounds())[:, None]).sum() * 20
    assert dst == pytest.approx(src, abs=1e-9)
    counted = f.apply_column(lambda v: v * 0 + 1).regrid(target, "nearest_d2s").to_dense()
    assert np.nansum(counted) == data.size
    outside = f.regrid(GeodeticGrid([0.0], [359.9]), "bilinear").to_dense()
    assert np.isnan(outside).all()
    with pytest.raises(ValueError):
        f.regrid(target, "spline")
    with pytest.raises(TypeError):
        f.regrid("target")


def test_rotated(spark):
    y, x = np.arange(-2.0, 3.0), np.arange(-3.0, 4.0)
    data = np.arange(35.0).reshape(5, 7)
    f = Field.from_arrays(spark, data, "r", ("rlat", "rlon"), {"rlat": y, "rlon": x}, RotatedGeogCS(47.0, -168.0), DomainType.GRIDDED)
    at = f.interpolate(GeodeticPoints([43.0], [12.0])).to_dense()
    assert at.tolist() == [data[2, 3]]
    regular = f.to_regular()
    assert regular.dims == ("latitude", "longitude") and 0 < regular.df.where("value is not null").count()
    with pytest.raises(NotImplementedError):
        regular.to_regular()


def test_regrid_from_two_dimensional(spark, tmp_path):
    y, x = np.arange(-4.0, 5.0), np.arange(-5.0, 6.0)
    crs = RotatedGeogCS(47.0, -168.0)
    shape = lambda a, b: 3 + a - 2 * b + 0.5 * a * a + 0.25 * a * b - 0.1 * b * b
    data = shape(y[:, None], x[None])
    f = Field.from_arrays(spark, data, "r", ("rlat", "rlon"), {"rlat": y, "rlon": x}, crs, DomainType.GRIDDED)
    f = f._with(f.df, f.domain.with_latlon())
    target = GeodeticGrid(np.array([42.2, 43.1, 44.3]), np.array([11.1, 12.4, 13.3]))
    glat, glon = np.meshgrid(target.latitude.values, target.longitude.values, indexing="ij")
    px, py = crs.forward(glat, glon)
    path = str(tmp_path / "w.parquet")
    for _ in range(2):
        assert np.allclose(f.regrid(target, "patch", path).to_dense(), shape(py, px)) and os.path.exists(path)
    kept = pd.read_parquet(path)
    kept.assign(w=kept["w"] * 2).to_parquet(path)
    assert np.allclose(f.regrid(target, "patch", path).to_dense(), 2 * shape(py, px))
    assert np.allclose(f.regrid(target, "patch", path, reuse_weights=False).to_dense(), shape(py, px))
    assert np.isclose(np.nansum(f.regrid(target, "nearest_d2s").to_dense()), data.sum())
    assert np.allclose(f.regrid(target, "bilinear", str(tmp_path / "b.parquet")).to_dense(), f.interpolate(target, "linear").to_dense())
    assert set(f.regrid(target, "nearest_s2d").to_dense().ravel()) <= set(data.ravel())
    for method in ("conservative", "patch"):
        with pytest.raises(NotImplementedError):
            f.regrid(GeodeticPoints([42.0], [12.0]), method)


def test_conservative_cells(spark):
    """Cells of a rotated grid: overlaps against points spread evenly over each target."""
    rng = np.random.default_rng(2)
    crs = RotatedGeogCS(47.0, -168.0)
    y, x = np.arange(-4.0, 4.1, 0.8), np.arange(-5.0, 5.1, 0.8)
    data = rng.normal(10, 3, (len(y), len(x)))
    f = Field.from_arrays(spark, data, "v", ("rlat", "rlon"), Domain({"rlat": y, "rlon": x}, crs, DomainType.GRIDDED).with_latlon())
    lat0, lon0 = (float(v.mean()) for v in (f.latitude.values, f.longitude.values))
    target = GeodeticGrid(lat0 + np.arange(-1.5, 1.6, 1.0), lon0 + np.arange(-2.0, 2.1, 1.0))
    for method, normed in (("conservative", False), ("conservative_normed", True)):
        got = f.regrid(target, method).df.toPandas().set_index(["latitude", "longitude"])["value"]
        for la, (a, b) in zip(target.latitude.values, target.latitude.cell_bounds()):
            for lo, (c, d) in zip(target.longitude.values, target.longitude.cell_bounds()):
                py, px = np.meshgrid(np.degrees(np.arcsin(np.linspace(np.sin(np.radians(a)), np.sin(np.radians(b)), 201)[:-1])), np.linspace(c, d, 201)[:-1], indexing="ij")
                gx, gy = crs.forward(py.ravel(), px.ravel())
                i, j = np.round((gy - y[0]) / 0.8).astype(int), np.round((gx - x[0]) / 0.8).astype(int)
                inside = (i >= 0) & (i < len(y)) & (j >= 0) & (j < len(x))
                want = data[i[inside], j[inside]].sum() / (inside.sum() if normed else len(i))
                assert abs(got[la, lo] - want) < 0.1
    # a curvilinear grid that is a regular one agrees with the regular weights
    lat2, lon2 = np.meshgrid(np.arange(40.0, 50.0), np.arange(0.0, 12.0), indexing="ij")
    v = rng.random(lat2.shape)
    bent = Field.from_arrays(spark, v, "v", ("y", "x"), Domain({"latitude": (("y", "x"), lat2), "longitude": (("y", "x"), lon2)}, CurvilinearGrid(), DomainType.GRIDDED))
    flat = Field.from_arrays(spark, v, "v", ("latitude", "longitude"), {"latitude": lat2[:, 0], "longitude": lon2[0]})
    coarse = GeodeticGrid(np.array([42.0, 45.0, 48.0]), np.array([2.5, 5.5, 8.5]))
    a, b = (g.regrid(coarse, "conservative").df.orderBy("latitude", "longitude").toPandas() for g in (bent, flat))
    assert np.allclose(a["value"], b["value"]) and len(a) == 9


def test_polygons(field):
    f, data = field
    square = {"type": "Polygon", "coordinates": [[[30.0, -30.0], [150.0, -30.0], [150.0, 30.0], [30.0, 30.0], [30.0, -30.0]], [[80.0, -10.0], [100.0, -10.0], [100.0, 10.0], [80.0, 10.0], [80.0, -10.0]]]}
    got, mask = f.extract_polygons(square, return_mask=True)
    assert mask.sum() == 8 and got.df.count() == 4 * 8  # the hole takes one of nine
    whole = f.extract_polygons(square, crop=False).to_dense()
    assert np.isnan(whole[:, 0]).all() and np.isnan(whole[0, 2, 2]) and whole[0, 1, 1] == data[0, 1, 1]
    with pytest.raises(TypeError):
        f.extract_polygons({"type": "Point", "coordinates": [0, 0]})


def test_cube(field, spark, tmp_path):
    f, data = field
    other = Field.from_arrays(spark, data[:, :2] * 2, "u", ("time", "latitude", "longitude"), {"time": TIMES, "latitude": np.array([40.0, 20.0]), "longitude": np.arange(0.0, 360.0, 45.0)}, encoding={"name": "U10"}, domaintype=DomainType.GRIDDED)
    cube = DataCube([f, other])
    wide = cube.to_wide()
    assert wide.columns == ["time", "latitude", "longitude", "t", "u"] and wide.count() == data.size and wide.where("u is null").count() > 0
    assert cube["U10"].name == "u" and list(cube[["t"]].fields) == ["t"] and "longitude" in cube and len(cube) == 2
    with pytest.raises(KeyError):
        cube["nothing"]
    with pytest.raises(ValueError):
        DataCube([f, f])
    cube.to_csv(str(tmp_path / "csv"))
    assert spark.read.csv(str(tmp_path / "csv"), header=True).count() == data.size
    one = DataCube([f.sel(time="2020-01-02T00:00:00")])
    out = one.to_geojson(str(tmp_path / "g.json"))
    (when, features), = out.items()
    assert when == "2020-01-02T00:00" and len(features["features"]) == 40 and json.load(open(tmp_path / "g.json")) == out
    corner = features["features"][0]
    assert corner["geometry"]["coordinates"][0][0] == [0.0, -40.0] and any(x["properties"]["t"] is None for x in features["features"])
    points = f.locations([20.0], [45.0])
    assert [x["properties"]["time"] for x in points.to_geojson()["features"]] == [f"{t}T00:00" for t in TIMES.astype(str)]
    with pytest.raises(NotImplementedError):
        f.to_geojson()
    assert plot_kind(5, 5, 1) == "time_series" and plot_kind(1, 5, 9) == "points"
    assert cube.to_dict()["fields"]["t"]["units"] == "degC"


def test_netcdf_and_zarr(field, spark, tmp_path):
    f, data = field
    path = f.persist(str(tmp_path / "out"))
    assert path.endswith(".nc")
    back = open_datacube(spark, path)["t"]
    assert np.allclose(back.to_dense(), data, equal_nan=True) and back.units == "degC" and np.array_equal(back.time.values, f.time.values) and str(back.cell_methods[0]) == "time: mean"
    DataCube([f]).to_zarr(str(tmp_path / "z.zarr"), {"latitude": 2})
    again = open_datacube(spark, str(tmp_path / "z.zarr"))["t"]
    assert np.allclose(again.to_dense(), data, equal_nan=True)
    assert os.path.dirname(f.persist(str(tmp_path))) == str(tmp_path)
    parts = [DataCube([f.sel(time=slice(*s))]).to_netcdf(str(tmp_path / f"part{i}.nc")) for i, s in enumerate((("2020-01-01", "2020-01-02"), ("2020-01-05", "2020-02")))]
    both = open_datacube(spark, parts)["t"]
    assert np.allclose(both.to_dense(), data, equal_nan=True)
    with pytest.raises(EmptyDataError):
        f.geobbox(north=89, south=88).persist()


def test_geotiff(spark, tmp_path):
    from fieldloom.sources.geotiff import write_geotiff

    data = np.random.default_rng(2).random((2, 3, 4))
    path = write_geotiff(str(tmp_path / "a.tif"), data, np.array([50.0, 49.0, 48.0]), np.array([5.0, 6.0, 7.0, 8.0]))
    f = open_datacube(spark, path)["band_data"]
    assert np.allclose(f.to_dense(), data) and f.domain["y"].values.tolist() == [50.0, 49.0, 48.0]


def test_several_files(field, spark, tmp_path):
    from fieldloom.sources.geotiff import write_geotiff

    f, data = field
    other = Field.from_arrays(spark, data[:, :2] * 2, "u", ("time", "latitude", "longitude"), {"time": TIMES, "latitude": np.array([40.0, 20.0]), "longitude": np.arange(0.0, 360.0, 45.0)}, domaintype=DomainType.GRIDDED)
    early, late = f.sel(time=slice("2020-01-01", "2020-01-02")), f.sel(time=slice("2020-01-05", "2020-02"))
    for k, c in enumerate((early, late, other)):
        DataCube([c]).to_netcdf(str(tmp_path / f"{k}.nc"))
        DataCube([c]).to_zarr(str(tmp_path / f"{k}.zarr"))
        DataCube([c]).to_wide().write.parquet(str(tmp_path / f"{k}.parquet"))
    for ending in ("nc", "zarr"):
        cube = open_datacube(spark, str(tmp_path / f"*.{ending}"))
        assert set(cube.fields) == {"t", "u"} and np.allclose(cube["t"].to_dense(), data, equal_nan=True) and np.allclose(cube["u"].to_dense(), data[:, :2] * 2, equal_nan=True)
    shutil.copy(tmp_path / "0.nc", tmp_path / "copy.nc")
    for pair in (("0.nc", "copy.nc"), ("0.nc", "0.nc")):
        again = open_datacube(spark, [str(tmp_path / p) for p in pair])["t"]
        assert again.df.count() == early.df.count() and np.allclose(again.to_dense(), early.to_dense(), equal_nan=True)
    cube = open_datacube(spark, str(tmp_path / "*.parquet"), dims=["time", "latitude", "longitude"])
    assert set(cube.fields) == {"t", "u"} and cube["t"].df.count() == f.df.count() and cube["u"].df.count() == other.df.count()
    DataCube([f.apply_column(lambda c: c + 1)]).to_netcdf(str(tmp_path / "9.nc"))
    with pytest.raises(Exception, match="different values of t"):
        open_datacube(spark, [str(tmp_path / "0.nc"), str(tmp_path / "9.nc")])["t"].to_dense()
    with pytest.raises(ValueError):
        open_datacube(spark, [str(tmp_path / "0.nc"), str(tmp_path / "0.zarr")])
    tiles = np.random.default_rng(3).random((1, 3, 4))
    for k, part in enumerate((slice(0, 2), slice(2, 4))):
        write_geotiff(str(tmp_path / f"{k}.tif"), tiles[:, :, part], np.array([50.0, 49.0, 48.0]), np.arange(5.0, 9.0)[part])
    band = open_datacube(spark, str(tmp_path / "*.tif"))["band_data"]
    assert np.allclose(band.to_dense(), tiles) and band.domain["x"].values.tolist() == [5.0, 6.0, 7.0, 8.0]
    for v, c in (("t", f), ("u", other)):
        DataCube([c]).to_netcdf(str(tmp_path / f"era-x-{v}.nc"))
    whole = open_dataset(spark, str(tmp_path / "era*.nc"), str(tmp_path) + "/{dataset}-{}-{}.nc")
    assert set(whole.cubes[0].fields) == {"t", "u"}


def test_catalog(field, spark, tmp_path):
    f, _ = field
    for a in ("era", "other"):
        for v in ("t", "u"):
            DataCube([f]).to_netcdf(str(tmp_path / f"{a}-x-{v}.nc"))
    ds = open_dataset(spark, str(tmp_path / "*.nc"), str(tmp_path) + "/{dataset}-{}-{vars}.nc")
    assert ds.attr_names == ("dataset", "vars") and len(ds) == 4
    one = ds.filter(dataset="era", vars=["t"])
    assert len(one) == 1 and one.to_dataframe(spark).count() == 1
    with pytest.raises(ValueError):
        ds.filter(colour="red")
    done = ds.filter(dataset="era").geobbox(north=25, south=-5).apply("average", dim="time").persist(str(tmp_path / "out"))
    assert sorted(os.listdir(done)) == ["dataset=era-vars=t.nc", "dataset=era-vars=u.nc"]
    assert one.persist(str(tmp_path / "single")).endswith("dataset=era-vars=t.nc")
    assert ds.filter(dataset="era").persist(str(tmp_path / "zipped"), zip_if_many=True).endswith(".zip")
    assert ds["t"].cubes and len(ds["nothing"]) == 0
    assert ds.filter(vars="none").persist(str(tmp_path / "empty")) is None
    files = open_dataset(spark, str(tmp_path / "*.nc"), str(tmp_path) + "/{dataset}-{}-{vars}.nc", load_files_on_persistance=False)
    assert files.filter(dataset="era", vars="t").persist(str(tmp_path / "copied")).endswith(".nc")
    with pytest.raises(ValueError):
        open_dataset(spark, str(tmp_path / "*.nc"), "{a}@{b}.nc")


def test_engines():
    assert engine_of("a.nc") == "netcdf" and engine_of(["a.zarr", "b.nc"]) == "zarr" and engine_of("https://x/y") == "zarr" and engine_of("a.tif") == "geotiff"
    with pytest.raises(ValueError):
        engine_of("a.doc")
    assert name_pattern("{a}-{}-{b}.nc").search("x/era-1-t.nc").groupdict() == {"a": "era", "b": "t"}


def test_empty_field(spark):
    df = spark.createDataFrame([], "time timestamp_ntz, latitude double, longitude double, v double")
    f = Field.from_dataframe(df, "v", ("time", "latitude", "longitude"), "v", {"time": TIMES, "latitude": np.array([0.0, 1.0]), "longitude": np.array([0.0, 1.0])})
    assert f.geobbox(north=1, south=0).df.count() == 0 and f.resample("max", "D").df.count() == 0 and f.average("time").df.count() == 0
    assert f.regrid(GeodeticGrid([0.5], [0.5])).df.count() == 0 and f.locations([0.0], [0.0]).df.count() == 0


def test_stream(spark, tmp_path):
    from fieldloom.streaming.windows import resample_stream

    rows = [("2020-01-01 00:10:00", "a", 1.0), ("2020-01-01 00:50:00", "a", 3.0), ("2020-01-01 01:10:00", "a", None), ("2020-01-01 01:20:00", "b", 2.0)]
    df = spark.createDataFrame(rows, "t string, k string, v double").selectExpr("cast(t as timestamp) t", "k", "v")
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = resample_stream(stream, "t", ["k"], "v", "max", "1h").writeStream.format("memory").queryName("bins").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted((r.k, r.v) for r in spark.table("bins").where("v is not null").collect()) == [("a", 3.0), ("b", 2.0)]
    with pytest.raises(ValueError):
        resample_stream(df, "t", ["k"], "v", "max", "ME")
    assert isinstance(Domain({}), Domain)


def _blosc(values, width, codec, shuffled, block=256, split=True):
    """A container as writers make it, for reading."""
    raw = values.tobytes()
    number, pack = {"lz4": (1, lambda b: pa.Codec("lz4_raw").compress(b, asbytes=True)), "zlib": (3, zlib.compress), "zstd": (4, lambda b: pa.Codec("zstd").compress(b, asbytes=True))}[codec]
    body, starts, n = b"", [], -(-len(raw) // block)
    for k in range(n):
        content = raw[k * block:(k + 1) * block]
        if shuffled == 1:
            m = len(content) // width
            content = np.frombuffer(content, np.uint8, m * width).reshape(m, width).T.tobytes() + content[m * width:]
        elif shuffled == 4:
            m = len(content) // width // 8 * 8
            bits = np.unpackbits(np.frombuffer(content, np.uint8, m * width).reshape(m, width), axis=1, bitorder="little").T
            content = np.packbits(bits, axis=1, bitorder="little").tobytes() + content[m * width:]
        starts.append(16 + 4 * n + len(body))
        parts = width if split and len(content) == block else 1
        for i in range(parts):
            part = content[i * (len(content) // parts):(i + 1) * (len(content) // parts)] if parts > 1 else content
            packed = pack(part)
            packed = part if len(packed) >= len(part) else packed
            body += struct.pack("<i", len(packed)) + packed
    flags = shuffled | (0 if split else 16) | number << 5
    return struct.pack("<BBBBiii", 2, 1, flags, width, len(raw), block, 16 + 4 * n + len(body)) + struct.pack(f"<{n}i", *starts) + body


@pytest.mark.parametrize("codec", ["lz4", "zlib", "zstd"])
@pytest.mark.parametrize("shuffled", [0, 1, 4])
def test_blosc(codec, shuffled):
    rng = np.random.default_rng(9)
    for dtype, n in (("<f4", 333), ("<i2", 1000), ("<f8", 32), ("u1", 700)):
        values = np.cumsum(rng.integers(0, 3, n)).astype(dtype)
        for split in (True, False):
            assert read_blosc(_blosc(values, values.itemsize, codec, shuffled, split=split)) == values.tobytes()
    assert read_blosc(struct.pack("<BBBBiii", 2, 1, 2, 4, 5, 5, 21) + b"plain") == b"plain"


def test_zarr_codecs_and_filters(spark, tmp_path):
    field = Field.from_arrays(spark, np.arange(24.0).reshape(4, 6), "v", ("latitude", "longitude"), {"latitude": np.arange(4.0), "longitude": np.arange(6.0)})
    path = field.to_zarr(str(tmp_path / "a.zarr")) if hasattr(field, "to_zarr") else DataCube([field]).to_zarr(str(tmp_path / "a.zarr"))
    at = os.path.join(path, "v", ".zarray")
    meta, want = json.load(open(at)), field.to_dense()
    raw = zlib.decompress(open(os.path.join(path, "v", "0.0"), "rb").read())
    import zstandard

    for compressor, packed in (({"id": "zstd"}, zstandard.ZstdCompressor().compress(raw)), ({"id": "lz4"}, struct.pack("<i", len(raw)) + pa.Codec("lz4_raw").compress(raw, asbytes=True)), ({"id": "blosc"}, _blosc(want, 8, "lz4", 1)), (None, raw)):
        json.dump({**meta, "compressor": compressor}, open(at, "w"))
        open(os.path.join(path, "v", "0.0"), "wb").write(packed)
        assert np.array_equal(open_datacube(spark, path)["v"].to_dense(), want)
    scaled = np.diff(np.concatenate([[0], (want.ravel() * 10).astype("<i4")])).astype("<i4")
    json.dump({**meta, "compressor": None, "filters": [{"id": "fixedscaleoffset", "scale": 10, "offset": 0, "dtype": "<f8", "astype": "<i4"}, {"id": "delta", "dtype": "<i4"}, {"id": "shuffle", "elementsize": 4}]}, open(at, "w"))
    open(os.path.join(path, "v", "0.0"), "wb").write(scaled.view(np.uint8).reshape(-1, 4).T.tobytes())
    assert np.array_equal(open_datacube(spark, path)["v"].to_dense(), want)
    json.dump({**meta, "compressor": {"id": "unheard"}}, open(at, "w"))
    with pytest.raises(NotImplementedError):
        open_datacube(spark, path)


def test_pruned_sources(spark, tmp_path):
    """Chunks and files beyond a box aren't read: here they are broken."""
    coords = {"time": np.arange("2020-01-01", "2020-01-09", dtype="datetime64[D]"), "latitude": np.arange(4.0), "longitude": np.arange(6.0)}
    data = np.random.default_rng(1).random((8, 4, 6))
    field = Field.from_arrays(spark, data, "v", ("time", "latitude", "longitude"), coords)
    path = DataCube([field]).to_zarr(str(tmp_path / "p.zarr"), {"time": 4, "latitude": 2, "longitude": 3})
    open(os.path.join(path, "v", "1.1.1"), "wb").write(b"broken")
    opened = open_datacube(spark, path)["v"]
    box = opened.geobbox(north=1, south=0, west=0, east=5).sel(time=slice("2020-01-02", "2020-01-06"))
    assert np.allclose(box.to_dense(), data[1:6, :2])
    assert opened.geobbox(north=3, south=2, west=0, east=2).average("time").df.count() == 6
    with pytest.raises(Exception):
        opened.geobbox(north=3).sel(time="2020-01-08").df.count()
    for k in range(2):
        part = field.sel(time=slice(f"2020-01-0{4 * k + 1}", f"2020-01-0{4 * k + 4}"))
        DataCube([part]).to_netcdf(str(tmp_path / f"n{k}.nc"))
    cache = str(tmp_path / "headers.json")
    cube = open_datacube(spark, str(tmp_path / "n*.nc"), metadata_cache_path=cache)
    assert np.allclose(cube["v"].to_dense(), data)
    noted = json.load(open(cache))
    noted[str(tmp_path / "n0.nc")]["header"]["variables"]["v"]["attrs"]["units"] = noted[str(tmp_path / "n1.nc")]["header"]["variables"]["v"]["attrs"]["units"] = "from the cache"
    json.dump(noted, open(cache, "w"))
    again = open_datacube(spark, str(tmp_path / "n*.nc"), metadata_cache_path=cache)
    assert again["v"].units == "from the cache"
    first = again["v"].sel(time=slice("2020-01-01", "2020-01-03"))
    os.truncate(tmp_path / "n1.nc", 100)
    assert np.allclose(first.to_dense(), data[:3])


def test_blocks_and_rolls(field, spark):
    f, data = field
    n = data.shape[-1]
    name = f.dims[-1]
    assert np.allclose(f.roll(name, 2).to_dense(), np.roll(data, 2, axis=-1), equal_nan=True) and np.array_equal(f.roll(name, 0).to_dense(), data, equal_nan=True)
    small = f.coarsen({name: n}, "max")
    assert small.shape[-1] == 1 and np.allclose(small.to_dense()[..., 0], np.nanmax(data, axis=-1))
    with pytest.raises(ValueError):
        f.coarsen({name: n + 1})
    assert f.coarsen({name: n + 1}, boundary="trim").df.count() == 0 and f.coarsen({name: n + 1}, boundary="pad").shape[-1] == 1
    with pytest.raises(ValueError):
        f.item()
    with pytest.raises(ValueError):
        DataCube([f.average(f.dims[0]), Field.from_arrays(spark, np.ones(3), "other", ("k",), {})]).to_wide()
    assert f.notnull().df.where("value = 1").count() == f.df.where("value is not null").count()

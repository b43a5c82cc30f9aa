import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from fieldloom.core.domain import Domain, DomainType, GeodeticGrid, GeodeticPoints
from fieldloom.crs.systems import SYSTEMS, CurvilinearGrid, GeogCS, Geostationary, PolarStereographic, RegularLatLon, RotatedGeogCS, parse_crs
from fieldloom.meta.axis import Axis, AxisType, MethodType
from fieldloom.meta.cell_methods import duration_us, parse_cell_methods, render_cell_methods, time_interval_us
from fieldloom.meta.coordinate import Coordinate, CoordinateType
from fieldloom.meta.naming import logical_name, placeholders, split_attributes, to_json_value
from fieldloom.meta.unit import parse_unit


@pytest.mark.parametrize("name, kind", [("time", "TIME"), ("T", "TIME"), ("lat", "LATITUDE"), ("nav_lon", "LONGITUDE"), ("rlat", "Y"), ("grid_longitude", "X"), ("depthv", "VERTICAL"), ("soil1", "VERTICAL"), ("z", "VERTICAL"), ("station", "GENERIC"), (None, "GENERIC")])
def test_axis_kinds(name, kind):
    assert AxisType.infer(name).name == kind


def test_axis_identity():
    assert Axis("lat") == Axis("lat", AxisType.LATITUDE) and Axis("lat") != Axis("latitude")
    assert Axis("lat", encoding={"name": "nav_lat"}).ncvar == "nav_lat" and hash(Axis("lat")) == hash(Axis("lat"))


def test_methods():
    assert MethodType("maximum") is MethodType.MAX and MethodType("std") is MethodType.STD_DEV and MethodType("x") is MethodType.UNDEFINED


@pytest.mark.parametrize("text, us", [
    ("time: mean (interval: 1 hour)", 3600_000_000), ("time: mean (interval: 10. minutes)", 600_000_000), ("time: mean", None), ("area: mean (interval: 0.1 degrees) time: mean", None),
    ("area: mean (interval: 0.1 degrees) time: sum (interval: 0.25 hr)", 900_000_000), ("time: mean where sea (interval: 900 s) area: mean", 900_000_000), ("depth: point time: max  (interval:  3 h comment: interval: 5 h once)", 3 * 3600_000_000),
    ("time: area: mean (interval: 1 d interval: 0.1 degrees)", 86400_000_000), ("area: time: mean (interval: 0.1 degrees interval: 30 min)", 1800_000_000), ("time: mean (comment: hourly)", None), ("", None), (None, None), ("time: mean (interval: 0 s)", None)])
def test_time_interval(text, us):
    assert time_interval_us(text) == us


def test_cell_methods_round_trip():
    text = "area: mean where land time: maximum (interval: 1 hour comment: sampled)"
    entries = parse_cell_methods(text)
    assert [(e.axes, e.method, e.where) for e in entries] == [(("area",), "mean", "land"), (("time",), "maximum", None)]
    assert render_cell_methods(entries) == text and parse_cell_methods(render_cell_methods(entries)) == entries
    assert duration_us("0.5 days") == 43200_000_000 and duration_us("3 fortnights") is None


@pytest.mark.parametrize("unit, target, value, expected", [("hPa", "Pa", 1013.2, 101320.0), ("km h-1", "m/s", 36, 10), ("deg F", "K", 32, 273.15), ("0.1 mm", "m", 5, 0.0005), ("1e-1 K", "K", 2800, 280), ("0.01 degC", "K", 100, 274.15), ("knots", "m s**-1", 1, 1852 / 3600), ("l/m2", "mm", 3, 3), ("N m-2", "Pa", 7, 7), ("%", "1", 50, 0.5), ("KELVIN", "degC", 273.15, 0)])
def test_units(unit, target, value, expected):
    a, b = parse_unit(unit).to(parse_unit(target))
    assert value * a + b == pytest.approx(expected, abs=1e-9)


@pytest.mark.parametrize("text", ["", None, "unknown", "code table 4", "?", "level", "hours since 1970-01-01"])
def test_unknown_units(text):
    assert parse_unit(text).is_unknown
    with pytest.raises(ValueError):
        parse_unit("m").to(parse_unit("s"))


def test_names():
    attrs = {"standard_name": "air_temperature", "units": "K", "cell_measures": "area: a", "history": "x"}
    assert logical_name("t2m", attrs) == "air_temperature" and logical_name("t2m", {}) == "t2m"
    assert logical_name("t2m", attrs, "std_{units}") == "std_K" and logical_name("t2m", attrs, "{nothing}") == "t2m"
    assert logical_name("t2m", attrs, "std_{units}", {"t2m": {"name": "mine"}}) == "mine"
    assert split_attributes(attrs)[0] == {"history": "x"} and placeholders("{a}-{}-{b}.nc") == ["a", "b"]
    assert to_json_value({"a": np.float32(1.5), "b": np.datetime64("2020-01-01"), "c": [np.nan, np.int32(3)]}) == {"a": 1.5, "b": "2020-01-01T00:00:00", "c": [None, 3]}


def test_coordinates():
    c = Coordinate("latitude", np.array([90.0, 45.0, 0.0]), ("latitude",))
    assert c.type is CoordinateType.INDEPENDENT and c.descending and c.resolution == 45
    assert c.cell_bounds().tolist() == [[90.0, 67.5], [67.5, 22.5], [22.5, -22.5]]
    t = Coordinate("time", np.array(["2020-01-01T00", "2020-01-01T06", "2020-01-01T12", "2020-01-03"], dtype="datetime64[h]"), ("time",))
    assert t.time_step() == ("hour", 6) and t.to_dict()["time_step"] == 6
    with pytest.raises(ValueError):
        Coordinate("x", np.arange(3.0), ("x",), encoding={"_FillValue": -1})
    with pytest.raises(ValueError):
        Coordinate("x", np.arange(3.0), ("x",), bounds=np.zeros((2, 2)))


def test_domains():
    d = GeodeticGrid([10, 20, 30], [0, 10])
    assert d == GeodeticGrid([10, 20, 30 + 1e-12], [0, 10]) and d != GeodeticGrid([10, 20, 31], [0, 10])
    assert d["lat"].name == "latitude" and AxisType.LONGITUDE in d and "vertical" not in d and len(d) == 2
    with pytest.raises(KeyError):
        d["vertical"]
    assert d.compute_bounds().latitude.bounds.shape == (3, 2) and d.compute_bounds("latitude").longitude.bounds is None
    with pytest.raises(NotImplementedError):
        d.compute_bounds("time")
    assert GeodeticPoints([1, 2], [3, 4]).type is DomainType.POINTS
    with pytest.raises(ValueError):
        GeodeticPoints([1, 2], [3])
    assert isinstance(Domain({"nav_lat": (("y", "x"), np.zeros((2, 2)))}).crs, CurvilinearGrid)
    r = Domain({"rlat": np.array([0.0, 1.0]), "rlon": np.array([0.0, 1.0, 2.0])}, RotatedGeogCS(47, -168)).with_latlon()
    assert r.latitude.values.shape == (2, 3) and r.latitude.values[0, 0] == pytest.approx(43) and r.longitude.values[0, 0] == pytest.approx(12)
    with pytest.raises(ValueError):
        Domain.merge([d, r])


@pytest.mark.parametrize("system", [c for c in SYSTEMS if c is not CurvilinearGrid], ids=lambda c: c.__name__)
@settings(max_examples=30, deadline=None)
@given(lat=st.floats(-40, 40), lon=st.floats(-40, 40))
def test_round_trips(system, lat, lon):
    if system is PolarStereographic:
        lat = -abs(lat) - 1
    if system.__name__ in ("LambertConformal", "AlbersEqualArea"):
        lat = abs(lat)
    crs = system()
    back = crs.inverse(*crs.forward(np.array([lat]), np.array([lon])))
    assert np.allclose(back[0], lat, atol=1e-8) and np.allclose((back[1] - lon + 180) % 360 - 180, 0, atol=1e-8)


def test_column_twins(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(12.5, 30.0), (44.0, -20.0)], "lat double, lon double")
    for system in SYSTEMS:
        if system is CurvilinearGrid:
            continue
        crs = system()
        x, y = crs.forward(F.col("lat"), F.col("lon"))
        got = np.array(df.select(x, y).collect(), dtype=float)
        want = np.stack(crs.forward(np.array([12.5, 44.0]), np.array([30.0, -20.0])), axis=1)
        assert np.allclose(got, want, rtol=1e-9, atol=1e-6, equal_nan=True), system.__name__


def test_parse_crs():
    assert parse_crs(None) == RegularLatLon() and parse_crs({"grid_mapping_name": "nothing known"}) is None and parse_crs("{bad") is None
    assert parse_crs({"grid_mapping_name": "rotated_latitude_longitude", "grid_north_pole_latitude": 47.0, "grid_north_pole_longitude": -168.0, "extra": 1}) == RotatedGeogCS(47.0, -168.0)
    assert parse_crs('{"grid_mapping_name": "latitude_longitude", "earth_radius": 6371229.0}').radius == 6371229.0
    assert GeogCS(6378137.0, inverse_flattening=298.257223563).semi_minor_axis == pytest.approx(6356752.314, abs=1e-3)
    with pytest.raises(ValueError):
        GeogCS(6378137.0, 6000000.0, 298.0)
    with pytest.raises(ValueError):
        Geostationary(latitude_of_projection_origin=1.0)

"""The data-preparation operators against brute force, and on hostile rows."""

import json
import os
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fieldloom.functions.changepoint import level_changes, nearest_factor
from fieldloom.functions.kdtree import KDTree, Splits, nearest_rows
from fieldloom.functions.matching import assign, name_similarity
from fieldloom.functions.timelabels import Reader, abbreviations, nearest_ms
from fieldloom.operators.regular_grid import missing_periods, regular_grid
from fieldloom.operators.column_union import unite
from fieldloom.operators.schema_drift import changes, promoted, schema_changes, type_of, unified_fields, unified_schema
from fieldloom.operators.small_files import consolidate, kept_records, records, surplus_copies
from fieldloom.operators.spatial_near import Regions, chord, geographic, near_locations, near_pairs, points_in_regions
from fieldloom.operators.time_labels import _readings as label_readings, _runs, cheapest, crossing, link_runs, normalise_labels, one_instant, zone_names
from fieldloom.operators.unit_values import conversion, other_units, recorded, unit_in_name, value_in_text, values_in_common_units
from fieldloom.plans.scale import table
from fieldloom.sources.parquet_blocks import Footer, merge_files, merge_folder

T0 = datetime(2020, 1, 1)
READINGS = "value_id long, series_id long, points int, obs_time timestamp_ntz, data_value double, arrived_at timestamp_ntz, interval_us string, t string"
FIELDS = "series_id long, cell_methods string, field_encoding string, fill string"


def _readings(spark, rows):
    return spark.createDataFrame([(i, s, 1, t, v, T0, "x", "y") for i, (s, t, v) in enumerate(rows)], READINGS)


def test_grid_values(spark):
    h = timedelta(hours=1)
    rows = [(1, T0 + 0.5 * h, 2.0), (1, T0 + 0.5 * h, 2.0), (1, T0 + 1.25 * h, 4.0), (1, T0 + 5 * h, 6.0), (1, T0 + 3 * h, float("nan")), (1, T0 + 2.5 * h, -9.0), (1, T0 + 4 * h, None), (1, None, 1.0), (2, T0, 1.0), (None, T0, 1.0), (9, T0, 1.0)]
    fields = spark.createDataFrame([(1, "time: mean (interval: 1 hour)", '{"_FillValue": -9.0}', "z"), (2, "time: mean", None, "z"), (3, None, "{bad", "z")], FIELDS)
    got = {r.period_us // 3_600_000_000 - int((T0 - datetime(1970, 1, 1)).total_seconds() // 3600): r for r in regular_grid(_readings(spark, rows), fields).collect()}
    assert sorted(got) == [0, 1, 2, 3, 4, 5] and [got[k].n_readings for k in range(6)] == [1, 1, 0, 0, 0, 1]
    assert got[0].coverage == pytest.approx(0.5) and got[0].mean_value == pytest.approx(2.0)
    assert got[1].coverage == pytest.approx(1.0) and got[1].mean_value == pytest.approx(0.25 * 2 + 0.75 * 4)
    assert got[2].coverage == pytest.approx(0.25) and got[2].missing and got[3].coverage == 0 and got[3].mean_value is None
    assert missing_periods(_readings(spark, rows), fields).count() == 3
    with pytest.raises(ValueError):
        regular_grid(_readings(spark, rows), fields, hold=0)


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 2), st.integers(-5000, 5000), st.sampled_from([1.0, 2.0, None])), max_size=40))
def test_grid_chunks(spark, rows):
    """The result doesn't depend on where a series is cut into chunks."""
    readings = _readings(spark, [(s, T0 + timedelta(seconds=t), v) for s, t, v in rows])
    fields = spark.createDataFrame([(1, "time: mean (interval: 60 s)", "{}", ""), (2, "time: mean (interval: 7 min)", "{}", "")], FIELDS)
    whole, cut = (sorted((r.series_id, r.period_us, r.n_readings, round(r.coverage, 9), round(r.mean_value or -1, 9)) for r in regular_grid(readings, fields, chunk_periods=n).collect()) for n in (10**6, 3))
    assert whole == cut
    want = set()
    for s, step in ((1, 60), (2, 420)):
        used = {(int((T0 - datetime(1970, 1, 1)).total_seconds()) + t) // step for a, t, v in rows if a == s and v is not None}
        want |= {(s, p * step * 10**6) for p in range(min(used), max(used)) if p not in used} if used else set()
    assert {(r.series_id, r.period_us) for r in missing_periods(readings, fields).collect()} == want


def test_grid_empty(spark):
    assert regular_grid(_readings(spark, []), spark.createDataFrame([], FIELDS)).count() == 0


# locations ---------------------------------------------------------------
POINTS = "pt_id long, domain_id int, points int, latitude double, longitude double, grid_latitude double, grid_longitude double, x string, place string"
CRS = "domain_id int, crs string, x string"


def _brute(located, metres):
    la, lo = np.radians(located["lat"].to_numpy()), np.radians(located["lon"].to_numpy())
    xyz = np.stack([np.cos(la) * np.cos(lo), np.cos(la) * np.sin(lo), np.sin(la)], axis=1)
    ids = located["pt_id"].to_numpy()
    near = ((xyz[:, None] - xyz[None]) ** 2).sum(-1) <= chord(metres) ** 2
    return {(min(ids[i], ids[j]), max(ids[i], ids[j])) for i, j in zip(*np.nonzero(near)) if ids[i] != ids[j]}


def test_near_data(spark, data):
    points, crs = table(spark, data, "domain_points"), table(spark, data, "domain_crs")
    located = geographic(points, crs)
    want = _brute(located.distinct().toPandas(), 250.0)
    assert {(r.pt_a, r.pt_b) for r in near_pairs(points, crs).collect()} == want
    for blocks in (10**9, 40):  # small groups, also cut into blocks
        pairs, others = near_locations(located, 250.0, sample=500, group=60, group_most=blocks)
        rows = pairs.collect()
        assert len(rows) == len(set(rows))
        where = {}
        for r in others.collect():
            where.setdefault(r.place, [r.place]).append(r.pt_id)
        at = lambda p: where.get(p, [p])
        got = {(min(a, b), max(a, b)) for r in rows for a in at(r.place_a) for b in at(r.place_b) if a != b}
        got |= {(a, b) for v in where.values() for a in v for b in v if a < b}
        assert got == want


def test_near_hostile(spark):
    nan = float("nan")
    rows = [(1, 1, 0, 89.9999, 10.0, None, None), (2, 1, 0, 89.9999, 190.0, None, None), (3, 1, 0, 0.0, 179.9999, None, None), (4, 1, 0, 0.0, -179.9999, None, None), (5, 1, 0, 0.0, 539.9, None, None),
            (6, 2, 0, None, None, 0.0, 0.0), (7, 1, 0, 43.0, 12.0, None, None), (8, 1, 0, 43.0, -348.0, None, None), (7, 1, 0, 43.0, 12.0, None, None), (9, 1, 0, nan, 12.0, None, None), (10, 1, 0, 91.0, 0.0, None, None),
            (11, 3, 0, None, None, 43.0, 12.0), (12, 4, 0, None, None, 43.0, 12.0), (None, 1, 0, 43.0, 12.0, None, None), (13, 5, 0, None, None, 43.0, 12.0), (14, 1, 0, 9.9e36, 9.9e36, 1.0, 1.0)]
    points = spark.createDataFrame([(*r, "a", "b") for r in rows], POINTS)
    crs = spark.createDataFrame([(1, None, ""), (2, '{"grid_mapping_name": "rotated_latitude_longitude", "grid_north_pole_latitude": 47.0, "grid_north_pole_longitude": -168.0}', ""), (3, None, ""), (4, '{"grid_mapping_name": "unheard_of"}', "")], CRS)
    got = {(r.pt_a, r.pt_b) for r in near_pairs(points, crs).collect()}
    same = [6, 7, 8, 11, 13]
    assert got == {(1, 2), (3, 4)} | {(a, b) for a in same for b in same if a < b}
    assert near_pairs(points.limit(0), crs.limit(0)).count() == 0


def test_hot_place(spark):
    """A third of all rows at one place meets in one row of pairs, not in all of its copies."""
    points = spark.range(3000).selectExpr("id pt_id", "1 domain_id", "0 points", "case when id % 3 = 0 then 10.0 else id / 100.0 - 20 end latitude", "20.0 longitude", "cast(null as double) grid_latitude", "cast(null as double) grid_longitude")
    pairs, others = near_locations(geographic(points, spark.createDataFrame([], CRS)), 250.0)
    assert pairs.count() <= 2 and others.groupBy("place").count().agg({"count": "max"}).first()[0] >= 999


def test_dense_group(spark):
    """Places that space can't cut are cut into pairs of blocks, with the same pairs."""
    rng = np.random.default_rng(7)
    pdf = pd.DataFrame({"pt_id": np.arange(1200), "lat": 43 + rng.normal(0, 2e-3, 1200), "lon": 12 + rng.normal(0, 2e-3, 1200)})
    pairs, others = near_locations(spark.createDataFrame(pdf), 250.0, sample=2000, group=100, group_most=90)
    rows = [tuple(r) for r in pairs.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == _brute(pdf, 250.0) and others.count() == 0


@settings(max_examples=25, deadline=None)
@given(st.integers(0, 10**6), st.integers(0, 400), st.floats(0.001, 0.3))
def test_kdtree(seed, n, radius):
    xyz = np.random.default_rng(seed).random((n, 3))
    if n > 20:
        xyz[:10] = xyz[10]
    half = xyz[: n // 2]
    got = [(int(a), int(b)) for i, j in KDTree(half, 8).pairs_with(KDTree(xyz, 8), radius) for a, b in zip(i, j)]
    gap = ((half[:, None] - xyz[None]) ** 2).sum(-1)
    assert len(got) == len(set(got)) and set(got) == set(zip(*np.nonzero(gap <= radius * radius)))
    splits = Splits(xyz, 9, 0.01)
    row, leaf, home = splits.assign(xyz, radius)
    assert sorted(row[home]) == list(range(n)) and (leaf < splits.leaf_count).all()


@settings(max_examples=25, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 300), st.sampled_from([2, 3]))
def test_nearest_rows(seed, n, d):
    rng = np.random.default_rng(seed)
    points, queries = rng.integers(0, 12, (n, d)).astype(float), rng.integers(-5, 18, (40, d)).astype(float)
    gap = ((queries[:, None] - points[None]) ** 2).sum(-1)
    assert nearest_rows(points, queries).tolist() == gap.argmin(axis=1).tolist()


def test_regions(spark):
    rng = np.random.default_rng(4)
    rings = [("a", [(0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (0.0, 10.0)]), ("b", [(5.0, 5.0), (15.0, 7.0), (9.0, 20.0)]), ("a", [(4.0, 4.0), (6.0, 4.0), (6.0, 6.0), (4.0, 6.0)])]
    lat, lon = rng.uniform(-2, 17, 3000), rng.uniform(-2, 22, 3000)

    def inside(ring, y, x):
        odd = False
        for (a, b), (c, d) in zip(ring, ring[1:] + ring[:1]):
            if (a > y) != (c > y) and x > b + (y - a) / (c - a) * (d - b):
                odd = not odd
        return odd

    row, region = Regions(rings).sweep(lat, lon)
    got = set(zip(row.tolist(), region.tolist()))
    want = {(i, k) for k, name in enumerate("ab") for i in range(3000) if sum(inside(r, lat[i], lon[i]) for n, r in rings if n == name) % 2}
    assert got == want
    across = [("c", [(-5.0, 170.0), (5.0, 170.0), (5.0, 190.0), (-5.0, 190.0)]), ("c", [(-1.0, 178.0), (1.0, 178.0), (1.0, 183.0), (-1.0, 183.0)]), ("d", [(-5.0, -190.0), (5.0, -190.0), (5.0, -170.0), (-5.0, -170.0)])]
    line = spark.createDataFrame([(1, 0.0, 175.0), (2, 0.0, -175.0), (3, 0.0, 179.0), (4, 0.0, 165.0), (5, 0.0, 180.0), (6, 3.0, -180.0)], "pt_id long, lat double, lon double")
    assert sorted((r.pt_id, r.region) for r in points_in_regions(line, across).collect()) == [(1, "c"), (1, "d"), (2, "c"), (2, "d"), (3, "d"), (5, "d"), (6, "c"), (6, "d")]
    df = spark.createDataFrame(pd.DataFrame({"pt_id": np.arange(3000), "lat": lat, "lon": lon + 360.0}))
    assert points_in_regions(df, rings).count() == len(want) and points_in_regions(df, []).count() == 0


# small files -------------------------------------------------------------
FILES = "file_id long, dataset string, vars string, start_at timestamp_ntz, written_at timestamp_ntz, field_encoding string, field_properties string, payload string, line string, pos string"


def _files(spark, payloads):
    return spark.createDataFrame([(i, *a, T0, T0 + timedelta(hours=h), None, None, p, "l", "p") for i, a, h, p in payloads], FILES)


def test_records(spark):
    e = ("d", "v")
    files = _files(spark, [
        (1, e, 5, "# a,b,c\n2020-01-01T00:00:00Z,7,1.50\r\n\n2020-01-01 00:00, 007 ,1.5e+00\n2020-01-01T01:00,7,NaN\n2020-01-01T01:00,7"), (2, e, 1, "2020-01-01T00:00,7.0,15e-1,extra\n2020-01-01T01:00:00Z,7,nan\n2020-01-01T02:00+01:00,7,NaN\nx,7,1\n2020-01-01T00:00,7,-0.0\n2020-01-01T00:00,7,0"),
        (3, ("d", None), 0, "2020-01-01T00:00,7,1.5\n2020-01-01T00:00,7,1.5"), (4, e, 0, None), (5, e, 0, ""), (6, e, 9, "2020-01-01T03:00,1,oops\n2020-01-01T03:00,1,oops\n2020-02-31T03:00,1,2\n2020-01-01T03:00,1,")])
    assert {(r.file_id, r.line_no) for r in surplus_copies(files).collect()} == {(1, 2), (1, 4), (1, 5), (2, 3), (2, 6), (3, 2), (6, 2)}
    assert records(files).count() == 12 and kept_records(files).count() == records(files).count() - 7
    assert surplus_copies(files.limit(0)).count() == 0


def test_records_data(spark, data):
    files = table(spark, data, "dataset_files")
    all_records = records(files).toPandas().sort_values(["written_at", "file_id", "line_no"])
    want = set(map(tuple, all_records[all_records.duplicated(["dataset", "vars", "t_us", "points", "value", "odd"])][["file_id", "line_no"]].to_numpy().tolist()))
    assert {(r.file_id, r.line_no) for r in surplus_copies(files).collect()} == want


def test_block_merge(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    frames = []
    for i in range(7):
        t = pa.table({"a": pa.array(range(i * 100, i * 100 + 20 * i), pa.int64()), "b": pa.array([f"x{k % 3}" if k % 5 else None for k in range(20 * i)], pa.string()), "c": pa.array([[k] * (k % 3) for k in range(20 * i)], pa.list_(pa.int32()))})
        pq.write_table(t, source / f"{i}.parquet", row_group_size=50, compression=["snappy", "zstd", "none"][i % 3], write_page_index=i % 2 == 0, use_dictionary=i != 3)
        frames.append(t)
    out = str(tmp_path / "out.parquet")
    counts = merge_files([str(source / f"{i}.parquet") for i in range(7)], out)
    whole = pa.concat_tables(frames)
    assert pq.read_table(out).equals(whole) and counts["n_rows"] == whole.num_rows and counts["n_blocks"] == sum(pq.ParquetFile(source / f"{i}.parquet").num_row_groups for i in range(1, 7))
    assert spark.read.parquet(out).where("a = 305").count() == 1 and pq.ParquetFile(out).metadata.num_rows == whole.num_rows
    merged = merge_folder(spark, str(source), str(tmp_path / "merged"), 6000, least_block=0).toPandas()
    assert merged["n_rows"].sum() == whole.num_rows and len(merged) < 7 and merged["n_files"].sum() == 7
    assert spark.read.parquet(str(tmp_path / "merged")).count() == whole.num_rows
    assert merged["copied"].all() and merged["n_blocks"].sum() == counts["n_blocks"]
    # blocks of at most 50 rows are written anew as one, and the rows stay as they were
    anew = merge_folder(spark, str(source), str(tmp_path / "anew"), 10**9).toPandas()
    assert anew["n_blocks"].tolist() == [1] and not anew["copied"].any() and pq.read_table(tmp_path / "anew").equals(whole)
    pq.write_table(pa.table({"z": [1]}), source / "other.parquet")
    with pytest.raises(ValueError):
        merge_files([str(source / "1.parquet"), str(source / "other.parquet")], out)
    assert merge_folder(spark, str(source), str(tmp_path / "again"), 10**9).count() == 2
    (tmp_path / "bad.parquet").write_bytes(b"PAR1 nothing of the kind PAR1")
    with pytest.raises(ValueError):
        Footer(str(tmp_path / "bad.parquet"))
    (tmp_path / "none").mkdir()
    assert merge_folder(spark, str(tmp_path / "none"), out).count() == 0


def test_consolidate(spark, data, tmp_path):
    files = table(spark, data, "dataset_files")
    report = consolidate(files, str(tmp_path / "c"), 20_000).toPandas()
    assert report["n_rows"].sum() == kept_records(files).count() == spark.read.parquet(str(tmp_path / "c/merged")).distinct().count()
    assert os.listdir(tmp_path / "c/merged")


# time labels -------------------------------------------------------------
ZONES = ["America/New_York", "Europe/Rome", "Australia/Sydney", "Asia/Kolkata"]


@pytest.mark.parametrize("label, encoding, iso", [
    ("2020-01-01T00:00:00Z", None, ["2020-01-01T00:00"]), ("2020-01-01T05:30:00+0530", {}, ["2020-01-01T00:00"]), ("2020-01-01 05:30", {"timezone": "Asia/Kolkata"}, ["2020-01-01T00:00"]),
    ("2020-10-25 02:30:00", {"timezone": "Europe/Rome"}, ["2020-10-25T00:30", "2020-10-25T01:30"]), ("2020-10-25 02:30:00 CET", {"timezone": "Europe/Rome"}, ["2020-10-25T01:30"]), ("2020-03-29 02:30:00", {"timezone": "Europe/Rome"}, []),
    ("2020-03-29 02:30:00 CEST", {}, ["2020-03-29T00:30"]), ("2020-06-01 00:00:00 PST", {}, []), ("Mon, 04 Dec 2017 06:44:00 +0200", {}, ["2017-12-04T04:44"]), ("Tue, 04 Dec 2017 06:44:00 +0200", {}, []),
    ("7", {"units": "days since 2020-1-1 12:00:00 +2:00"}, ["2020-01-08T10:00"]), ("1.5", {"units": "hours since 2020-01-01", "calendar": "360_day"}, []), ("20200102.25", {"units": "day as %Y%m%d.%f"}, ["2020-01-02T06:00"]),
    ("02/03/2020 04:05", {"format": "dd/MM/yyyy HH:mm"}, ["2020-03-02T04:05"]), ("02/03/2020 04:05 PM", {"format": "MM/dd/yyyy hh:mm a"}, ["2020-02-03T16:05"]), ("02/03/2020 04:05", {}, ["2020-03-02T04:05", "2020-02-03T04:05"]),
    ("2020-060T01:00Z", {}, ["2020-02-29T01:00"]), ("2021-366T01:00Z", {}, []), ("20200101T123000", {}, ["2020-01-01T12:30"]), ("Jun 5 2020 12:10 AM AEST", {}, ["2020-06-04T14:10"]), ("2020-02-30", {}, []), ("2020-01-01T26:00:00Z", {}, []),
    ("", {}, []), (None, {}, []), ("n/a", {}, []), ("2020-01-01", "not json", []), ("2020-01-01", {"timezone": "No/Where"}, []), ("5", {"units": "parsecs since 2020-01-01"}, []), ("2020-0?", {}, []), ("x" * 100_000, {}, [])])
def test_label(label, encoding, iso):
    reader = Reader(abbreviations(ZONES))
    text = encoding if isinstance(encoding, str) or encoding is None else json.dumps(encoding)
    got = sorted(nearest_ms(ns) for _, ns in reader.read(label, text))
    assert got == sorted(int((datetime.fromisoformat(i) - datetime(1970, 1, 1)).total_seconds() * 1000) for i in iso)


def test_label_rounding():
    reader = Reader({})
    assert nearest_ms(reader.read("2020-01-01T00:00:00.1236Z", None)[0][1]) % 1000 == 124
    assert nearest_ms(reader.read("0.04166666667", '{"units": "days since 1970-01-01"}')[0][1]) == 3_600_000


def test_viterbi():
    run = [(1, [("a", 10)]), (2, [("b", 11), ("a", 12)]), (3, [("a", 5), ("b", 13)]), (4, [("b", 14)])]
    # two switches are dearer than one, and a jump back than a switch
    assert cheapest(run) in ([0, 0, 1, 0], [0, 1, 1, 0]) and cheapest(run, last=0)[-1] == 0
    assert cheapest([(9, [("x", 1), ("y", 1)])]) == [0]


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 40), st.floats(0, 1))
def test_linked_runs(seed, n, share):
    """Whatever partitions a sequence is cut into, the choice is that of the whole one."""
    rng = np.random.default_rng(seed)
    rows = []
    for dataset in ("a", "b", None):
        for _ in range(int(rng.integers(0, n))):
            states = [(str(rng.choice(["x", "y", "z"])), int(ns)) for ns in rng.choice(50, 1 if rng.random() < share else int(rng.integers(2, 4)), replace=False)]
            rows.append((dataset, len(states), json.dumps(states), len(rows), len(rows), []))
    frame = lambda part: pd.DataFrame(part, columns=["dataset", "n", "states", "key", "coord_id", "interpretations"])

    def chosen(cuts):
        parts = [rows[a:z] for a, z in zip([0, *cuts], [*cuts, len(rows)]) if z > a]
        runs = [(p, place, run) for p, part in enumerate(parts) for place, run in _runs(iter([frame(part[: len(part) // 2]), frame(part[len(part) // 2:])]))]
        sums = [(p, place, run[0][0], label_readings(run)[0][1], label_readings(run)[-1][1], crossing(label_readings(run))) for p, place, run in runs if place != "inner"]
        ends = link_runs(sums)
        return {row[4]: k for p, place, run in runs for row, k in zip(run, cheapest(label_readings(run), *(ends[p, place] if place != "inner" else (None, None)))) if row[1] > 1}

    whole = chosen([])
    assert set(whole) == {r[4] for r in rows if r[1] > 1}
    for _ in range(3):
        assert chosen(sorted(rng.choice(len(rows) + 1, min(len(rows), int(rng.integers(0, 6))), replace=False).tolist())) == whole


LABELS = "coord_id long, dataset string, coord_text string, coord_encoding string, loaded_at timestamp_ntz, form string"


def test_labels(spark):
    rows = [(1, "a", "01/02/2020 00:00", None, T0), (2, "a", "13/02/2020 00:00", None, T0 + timedelta(1)), (3, "a", "03/04/2020 00:00", None, T0 + timedelta(2)), (1, "a", "01/02/2020 00:00", None, T0 + timedelta(9)),
            (4, None, None, None, None), (5, None, "2020-01-01", None, None), (None, "a", "2020-01-01", None, T0), (6, "b", "05/05/2020 00:00", None, T0)]
    coords = spark.createDataFrame([(*r, "f") for r in rows], LABELS)
    got = {r.coord_id: r for r in normalise_labels(coords).collect()}
    assert len(got) == 6 and got[1].form == got[2].form == got[3].form == "d/m/y" and len(got[1].interpretations) == 2
    assert {r.coord_id for r in one_instant(coords).collect()} == {2, 5, 6} and one_instant(coords.limit(0)).count() == 0


def test_labels_over_partitions(spark):
    # one anchor at the start, then undecided labels over all partitions, and many junk zones
    texts = ["01/25/2020 00:00"] + ["03/02/2020 00:00"] * 400
    rows = [(i, "d", t, "{}", T0 + timedelta(hours=i), "") for i, t in enumerate(texts)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {r.coord_id: r for r in normalise_labels(spark.createDataFrame(rows, LABELS).repartition(4)).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(got) == 401 and len(got[1].interpretations) == 2 and {r.form for r in got.values()} == {"m/d/y"}
    junk = [(1000 + i, "d", "2020-01-25T00:00:00", '{"timezone": "Nowhere/%d"}' % i, T0, "") for i in range(2500)] + [(9000, "d", "2020-01-25T00:00:00", '{"timezone": "Asia/Tokyo"}', T0, "")]
    assert zone_names(spark.createDataFrame(junk, LABELS)) == ["Asia/Tokyo"]


# schemas -----------------------------------------------------------------
def test_assignment():
    rng = np.random.default_rng(5)
    from itertools import permutations

    for _ in range(40):
        n, m = (int(k) for k in rng.integers(1, 5, 2))
        w = (rng.random((n, m)) * (rng.random((n, m)) < 0.7)).tolist()
        got = assign(w)
        small, big = (n, m) if n <= m else (m, n)
        best = max(sum(w[i][p[i]] if n <= m else w[p[i]][i] for i in range(small)) for p in permutations(range(big), small))
        assert sum(w[i][j] for i, j in enumerate(got) if j >= 0) == pytest.approx(best) and len({j for j in got if j >= 0}) == sum(j >= 0 for j in got)
    assert assign([]) == [] and name_similarity("T_2M", "t2m") == 1.0


def test_types():
    assert {type_of(x) for x in ("float32", "<f4", "f4", "float", ">f4", " F4 ".strip().lower())} == {"f4"} and type_of("short") == "i2" and type_of(None) is None and type_of("weird") == "weird"
    assert promoted(["i2", "f4"]) == "f4" and promoted([]) is None and promoted(["i4", "str"]) == "str"


def test_changes():
    q = lambda t, what: [t, what, None]
    before = {"a": q("f4", "standard_name:x"), "b": q("f4", None), "c": q("i2", "long_name:count"), "d": q("f4", None)}
    after = {"a2": q("f8", "standard_name:x"), "b": q("f8", None), "c2": q("i2", "long_name:count"), "e": q("f4", None)}
    assert sorted((n, k) for n, k, _ in changes(before, after)) == [("a2", "renamed"), ("a2", "retyped"), ("b", "retyped"), ("c2", "renamed"), ("d", "removed"), ("e", "added")]


def test_schema_changes(spark):
    enc = lambda **f: json.dumps({k: {"dtype": v} for k, v in f.items()})
    listed = lambda **f: json.dumps([{"ncvar": k, "dtype": v} for k, v in f.items()])
    about = lambda **f: json.dumps({k: {"long_name": v} for k, v in f.items()})
    day = lambda n: T0 + timedelta(days=n)
    rows = [(1, "d", "v", day(0), enc(t="f4", u="f4"), about(t="Temp", u="Wind")), (2, "d", "v", day(40), listed(t="float32", uu="f8"), about(uu=" WIND ")), (9, "d", "v", day(41), None, None), (8, "d", "v", day(42), "{bad", None),
            (4, "d", "v", day(300), listed(t="f4"), None), (3, "d", "v", day(300), listed(t="f4"), None), (5, "d", None, day(1), enc(x="f4"), None), (6, "d", None, day(2), "{}", None), (7, None, "v", None, enc(x="f4"), None), (10, "d", "w", day(1), "null", None)]
    files = spark.createDataFrame([(i, d, v, s, T0, e, p, None, "l", "p") for i, d, v, s, e, p in rows], FILES)
    got = {(r.file_id, r.ncvar, r.change_kind) for r in schema_changes(files).collect()}
    assert got == {(2, "uu", "renamed"), (2, "uu", "retyped"), (3, "uu", "removed"), (6, "x", "removed")}
    unified = {(r.vars, r.field): r for r in unified_schema(files).collect()}
    assert unified["v", "wind"].names == ["u", "uu"] and unified["v", "wind"].dtype == "f8" and unified["v", "temp"].n_starts == 3
    assert schema_changes(files.limit(0)).count() == 0 and unified_schema(files.limit(0)).count() == 0


def test_unite(spark):
    """Renames without any stated quantity are told by values."""
    rng = np.random.default_rng(3)
    frame = lambda n, **c: spark.createDataFrame(pd.DataFrame(c))
    temp = lambda: rng.normal(280, 5, 500)
    codes = lambda: rng.choice(["alpha", "beta", "gamma", None], 500)
    first = frame(0, id=np.arange(500), temperature=temp(), pressure=rng.normal(1e5, 300, 500), site=codes())
    second = frame(1, id=np.arange(500), ta=temp(), p=rng.normal(1e5, 300, 500), place=codes(), wind=rng.random(500))
    third = frame(2, id=np.arange(500).astype(float), ta=temp(), place=codes(), flag=rng.random(500) < 0.5)
    rows, changes = unite([("1", first), ("2", second), ("3", third)])
    assert rows.columns == ["version", "id", "temperature", "pressure", "site", "wind", "flag"] and rows.count() == 1500 and dict(rows.dtypes)["id"] == "double"
    assert set(changes) == {("2", "ta", "renamed", "temperature", None), ("2", "p", "renamed", "pressure", None), ("2", "place", "renamed", "site", None), ("2", "wind", "added", None, None),
                            ("3", "id", "retyped", None, "bigint"), ("3", "p", "removed", None, None), ("3", "wind", "removed", None, None), ("3", "flag", "added", None, None)}
    got = rows.groupBy("version").agg({"temperature": "avg", "pressure": "count", "site": "count"}).toPandas().set_index("version")
    assert got["avg(temperature)"].between(278, 282).all() and got["count(pressure)"].to_dict() == {"1": 500, "2": 500, "3": 0}
    # empty versions, clashing names, nested columns
    again, changes = unite([("a", first.limit(0)), ("b", first), ("c", spark.createDataFrame([([1], "x")], "list array<int>, temperature string"))])
    assert again.count() == 501 and ("c", "temperature", "retyped", None, "double") in changes
    for bad in ([], [("a", first.withColumn("version", F.lit(1)))]):
        with pytest.raises(ValueError):
            unite(bad)


def test_unified_fields(spark):
    enc, day = (lambda **f: json.dumps({k: {"dtype": v} for k, v in f.items()})), (lambda n: T0 + timedelta(days=n))
    about = lambda **f: json.dumps({k: {"standard_name": v} for k, v in f.items()})
    # t stands for temp, then silently, then for thickness; u never says what it is
    rows = [(1, day(0), enc(t="f4", u="i2"), about(t="temp")), (2, day(1), enc(t="f8"), None), (3, day(2), enc(t="i4", temp2="f8"), about(t="thickness", temp2="temp")), (4, day(3), enc(t="i4"), "{bad"), (5, None, enc(t="f4"), None), (6, day(1), None, None)]
    files = spark.createDataFrame([(i, "d", None, s, T0, e, p, None, "l", "p") for i, s, e, p in rows], FILES)
    got = {(r.file_id, r.ncvar): (r.field, r.unified_dtype) for r in unified_fields(files).collect()}
    assert got == {(1, "t"): ("temp", "f8"), (1, "u"): ("u", "i2"), (2, "t"): ("temp", "f8"), (3, "t"): ("thickness", "i4"), (3, "temp2"): ("temp", "f8"), (4, "t"): ("thickness", "i4")}


# units -------------------------------------------------------------------
def test_unit_places():
    assert value_in_text("0,688 [1]") == (0.688, "1") and value_in_text("99242N m-2") == (99242.0, "N m-2") and value_in_text("763 [0.01 degC]") == (763.0, "0.01 degC") and value_in_text("x") == (None, None) and value_in_text(None) == (None, None)
    assert unit_in_name("wind_speed", "10 metre wind speed [kt]") == "kt" and unit_in_name("soil_water", "Water in 0.1 mm") == "0.1 mm" and unit_in_name("air_temperature", "Mean in summer") is None and unit_in_name("air_temperature", "T, units: deg F") == "deg F"
    assert recorded("air_temperature", 3.0, None, "m", "T (degC)") == (3.0, "degC") and recorded("air_temperature", None, "5 degC", "K", "") == (5.0, "degC") and recorded("nothing", 1.0, None, "m", None) == (1.0, None)
    assert conversion("soil_water", "kg m-2") == (0.001, 0.0) and conversion("wind_speed", "kg m-2") is None


SAMPLES = "sample_id long, dataset string, ncvar string, standard_name string, long_name string, sampled_at timestamp_ntz, data_value double, data_text string, field_units string, depth_value double, depth_units string, unit string"


def test_other_units(spark):
    nan = float("nan")
    rows = [(1, "air_temperature", "T", 10.0, None, "degC", None, None), (1, "air_temperature", "T", 10.0, None, "degC", None, None), (2, "air_temperature", "T", 283.0, None, "Kelvin", 2.0, "feet"), (3, "relative_humidity", "H", None, "50,5 %", None, 1.0, "m"),
            (4, "relative_humidity", "H", nan, "50 %", None, 1e20, "cm"), (5, "wind_speed", "W [kt]", 10.0, None, "?", nan, "cm"), (6, "surface_air_pressure", None, 9.97e36, None, "hPa", None, "cm"), (7, "unheard_of", None, 1.0, None, "hPa", 3.0, "level"),
            (8, None, None, None, None, None, None, None), (9, "precipitation_amount", "", 2.5, None, " 0.1 mm ", None, None), (None, "air_temperature", "T", 10.0, None, "degC", None, None), (10, "soil_water", "S" * 50_000, 1.0, "", "CM", 0.0, "km")]
    samples = spark.createDataFrame([(i, "d", "n", q, name, T0, v, t, u, dv, du, "x") for i, q, name, v, t, u, dv, du in rows], SAMPLES)
    got = {(r.sample_id, r.item, r.micro) for r in other_units(samples).collect()}
    assert got == {(1, "field", 283_150_000), (2, "depth", 609_600), (3, "field", 505_000), (5, "field", round(10 * 1852 / 3600 * 1e6)), (9, "field", 250), (10, "field", 10_000), (10, "depth", 0)}
    assert other_units(samples.limit(0)).count() == 0


def test_inference(spark):
    rng = np.random.default_rng(6)
    rows = []
    for i in range(300):
        p = float(rng.normal(100000, 1500))
        scale, unit = (1.0, "Pa") if i < 100 else (0.01, None) if i < 200 else (1e-5, "unknown")
        rows.append((i, "d", "ps", "surface_air_pressure", "p", T0 + timedelta(hours=i), p * scale, None, unit, None, None, ""))
    out = values_in_common_units(spark.createDataFrame(rows, SAMPLES).repartition(1)).toPandas()
    assert (out["origin"] == "inferred").sum() == 200 and out["common_value"].between(90000, 110000).all()


def test_whole_histories(spark):
    rng = np.random.default_rng(8)
    p = rng.normal(100000, 1500, 6012)
    row = lambda i, d, v, unit, depth=None, depth_unit=None: (i, d, "ps", "surface_air_pressure", "p", T0 + timedelta(minutes=i), v, None, unit, depth, depth_unit, "")
    # recorded values stand before an unlabelled stretch longer than two blocks, in two units
    rows = [row(i, "long", float(p[i]), "Pa") if i < 12 else row(i, "long", float(p[i]) * (0.01 if i < 3000 else 0.001), None) for i in range(6012)]
    # a short history, recorded in two units
    rows += [row(7000 + i, "short", float(p[i]) * (0.01 if i % 2 else 1.0), "hPa" if i % 2 else "Pa") for i in range(4)] + [row(7010, "short", 1012.0, None)]
    rows += [row(8000 + i, "deep", None, None, 2.0 if i < 5 else 200.0, "m" if i < 5 else None) for i in range(10)]
    samples = spark.createDataFrame(rows, SAMPLES)
    found = []
    for parts in (1, 5):
        out = values_in_common_units(samples.repartition(parts)).toPandas().sort_values("sample_id")
        found.append(out[["sample_id", "unit", "origin", "micro"]].to_numpy().tolist())
    assert found[0] == found[1] and len(out) == len(rows)
    history = out[out["sample_id"] < 7000]
    assert (history["origin"] == "inferred").sum() == 6000 and np.allclose(history["common_value"], p)
    assert np.allclose(out[out["sample_id"] == 7010]["common_value"], 101200.0)
    deep = out[out["item"] == "depth"]
    assert (deep["origin"] == "inferred").sum() == 5 and np.allclose(deep["common_value"], 2.0)


@pytest.mark.parametrize("query,name", [(values_in_common_units, "field_samples"), (normalise_labels, "time_coords")])
def test_partitions_decide_nothing(spark, data, query, name):
    """The same rows at any number of partitions."""
    before, found = spark.conf.get("spark.sql.shuffle.partitions"), []
    try:
        for n in (4, 64):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            out = query(table(spark, data, name))
            found.append(sorted(map(str, out.collect())))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert found[0] == found[1]


def test_changepoints():
    rng = np.random.default_rng(7)
    x = np.concatenate([rng.normal(0, 0.1, 50), rng.normal(3, 0.1, 40), rng.normal(0, 0.1, 30)])
    assert level_changes(x) == [50, 90, 120] and level_changes(np.empty(0)) == [] and level_changes(np.zeros(3)) == [3]

    def exact(x, penalty, least):
        best = [(-penalty, [])] + [None] * len(x)
        for e in range(1, len(x) + 1):
            options = [(best[s][0] + ((x[s:e] - x[s:e].mean()) ** 2).sum() + penalty, best[s][1] + [e]) for s in range(0, e - least + 1) if best[s] is not None]
            best[e] = min(options) if options else None
        return best[-1]

    for _ in range(10):
        x = np.repeat(rng.normal(0, 2, 4), rng.integers(4, 9, 4)) + rng.normal(0, 0.4, 1)
        x = x + rng.normal(0, 0.3, len(x))
        assert level_changes(x, 1.0, 4) == exact(x, 1.0, 4)[1]
    assert nearest_factor(np.log(100) + 0.1, [100.0, 1000.0]) == 100.0 and nearest_factor(np.log(7), [100.0]) is None

"""Queries that write files, read them again, and read streams; with their SQL."""

from __future__ import annotations

import os
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.core.cube import DataCube
from fieldloom.core.field import Field
from fieldloom.plans.field_queries import _FLAT, _G, LAT, LON, Query, _members, _quantity, _rows, catalog, flat, grid, rotated, shown
from fieldloom.plans.scale import shared_path, table
from fieldloom.sources.catalog import catalog_of, open_datacube, open_dataset
from fieldloom.streaming.windows import resample_stream


def _folder(spark: SparkSession) -> str:
    path = shared_path(spark, f"written-{uuid.uuid4().hex}")
    os.makedirs(path)
    return path


def _dataset_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dataset persisted as a file for each entry, and opened by the names of the files."""
    folder = _folder(spark)
    catalog(spark, sf_dir).average("time").persist(folder)
    found = open_dataset(spark, f"{folder}/*.nc", "flag={flag}-status={status}.nc")
    return _members(found)


def _two_variables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cube of two files with a variable each."""
    folder = _folder(spark)
    for flag, name in (("A", "returned"), ("N", "none")):
        DataCube([grid(spark, sf_dir, f"l_returnflag = '{flag}'", name).average("time")]).to_netcdf(f"{folder}/{name}.nc")
    return open_datacube(spark, f"{folder}/*.nc").to_wide()


def _two_stores(kind: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        """A cube of two stores with half of the latitudes each."""
        folder, field = _folder(spark), flat(spark, sf_dir)
        paths = [f"{folder}/{n}.{kind}" for n in ("south", "north")]
        for path, side in zip(paths, ({"north": 0.0}, {"south": 0.0})):
            cube = DataCube([field.geobbox(**side)])
            cube.to_zarr(path) if kind == "zarr" else cube.to_netcdf(path)
        return shown(open_datacube(spark, paths)["quantity"].geobbox(west=20, east=200))

    return run


def _stream_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six-hour bins of the events, read as a stream until it has no more."""
    events = f"{sf_dir}/events.parquet"
    stream = spark.readStream.schema(spark.read.parquet(events).schema).parquet(events if os.path.isdir(events) else f"{sf_dir}/events.parquet*")
    bins = resample_stream(stream.select("ts", "event_type", "value"), "ts", ["event_type"], "value", "max", "6h")
    folder = _folder(spark)

    def keep(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/bins")

    bins.writeStream.outputMode("complete").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).foreachBatch(keep).start().awaitTermination()
    return spark.read.parquet(f"{folder}/bins").select("event_type", F.col("ts").cast("timestamp_ntz").alias("ts"), F.round("value", 6).alias("value"))


def _names(spark: SparkSession, sf_dir: str) -> DataFrame:
    pattern = "/archive/{dataset}/{vars}/{year}/{month}/{}-single-levels-reanalysis_{}_{}.nc"
    return catalog_of(table(spark, sf_dir, "dataset_files"), "file_path", pattern).select("dataset", "vars", "year", "month", "n_files", F.get("files", F.lit(0)).alias("first_file"))


def _point_field(spark: SparkSession, sf_dir: str) -> Field:
    df = _rows(spark, sf_dir).groupBy(F.col("latitude"), F.col("longitude")).agg(_quantity())
    return Field.from_dataframe(df, "quantity", ("latitude", "longitude"), "value", {"latitude": LAT, "longitude": LON}, units="kg")


def _dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    """To an array on the driver, which has a cell of 360 labels each, and back to rows."""
    field = _point_field(spark, sf_dir)
    again = Field.from_arrays(spark, field.to_dense(), "quantity", field.dims, field.domain)
    return shown(again)


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rotated cells beside their two-dimensional latitude and longitude."""
    field = rotated(spark, sf_dir)
    return field.df.join(field.cell_table(), ["rlat", "rlon"]).select("rlat", "rlon", F.round("latitude", 6).alias("lat"), F.round("longitude", 6).alias("lon"), "value")


def _described(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What describe says of each cube of a dataset."""
    rows = []
    for e, cube in zip(catalog(spark, sf_dir).filter(flag="A").entries, catalog(spark, sf_dir).filter(flag="A").cubes):
        said = cube.to_dict()
        time = said["domain"]["coordinates"]["time"]
        rows.append((e.attrs["status"], said["domain"]["crs"]["name"], str(time["min"])[:10], str(time["max"])[:10], said["fields"]["quantity"]["units"], float(said["domain"]["coordinates"]["longitude"]["max"])))
    return spark.createDataFrame(rows, "status string, crs string, low string, high string, units string, east double")


def _merged_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes of a cube's merged domain, with a scalar left by a selection."""
    cube = DataCube([f.sel(latitude=5.0) for f in (grid(spark, sf_dir), grid(spark, sf_dir, "l_returnflag = 'R'", "returned"))])
    d = cube.domain
    return spark.createDataFrame([(int(d.time.values.size), int(d.longitude.values.size), float(d.latitude.values), ",".join(sorted(d.aux_coords)), int(cube["quantity"].nbytes))], "n_time long, n_lon long, latitude double, scalars string, n_bytes long")


def _persisted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A field of one month persisted with its times, opened by its ending and picked by its name on disk."""
    path = grid(spark, sf_dir).sel(time="1995-07").persist(f"{_folder(spark)}/july")
    return shown(open_datacube(spark, path)["quantity"])


def queries() -> dict[str, Query]:
    return {
        "dataset_round_trip": _dataset_round_trip,
        "two_variables": _two_variables,
        "two_zarr_stores": _two_stores("zarr"),
        "two_netcdf_files": _two_stores("nc"),
        "stream_bins": _stream_bins,
        "catalog_names": _names,
        "dense_round_trip": _dense,
        "cell_table": _cells,
        "describe_dataset": _described,
        "merged_domain": _merged_domain,
        "persisted_month": _persisted,
    }


def oracle_sql() -> dict[str, str]:
    w = f"WITH {_G} "
    by_flag = _G.replace("AS longitude,", "AS longitude, l_returnflag AS flag, l_linestatus AS status,")
    lat, lon = "radians(rlat)", "radians(rlon)"
    return {
        "dataset_round_trip": f"WITH {by_flag} SELECT flag, status, latitude, longitude, round(avg(value), 6) AS value FROM g GROUP BY ALL",
        "two_variables": f"""WITH {_G.replace('AS longitude,', 'AS longitude, l_returnflag AS flag,')}, m AS (SELECT flag, latitude, longitude, avg(value) AS value FROM g GROUP BY ALL)
  SELECT latitude, longitude, r.value AS returned, n.value AS "none" FROM (SELECT * FROM m WHERE flag = 'A') r FULL JOIN (SELECT * FROM m WHERE flag = 'N') n USING (latitude, longitude)""",
        **{k: _FLAT + " SELECT latitude, longitude, round(value, 6) AS value FROM m WHERE longitude BETWEEN 20 AND 200" for k in ("two_zarr_stores", "two_netcdf_files")},
        "stream_bins": "SELECT event_type, time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') AS ts, round(max(value), 6) AS value FROM events GROUP BY ALL",
        "catalog_names": """WITH f AS (SELECT DISTINCT file_path, regexp_extract(file_path, '^/archive/([^/]+)/([^/]+)/([^/]+)/([^/]+)/[^/]*-single-levels-reanalysis_[^/]*_[^/]*[.]nc$', ['dataset', 'vars', 'year', 'month']) AS x FROM dataset_files)
  SELECT x.dataset AS dataset, x.vars AS vars, x.year AS year, x.month AS month, count(*) AS n_files, min(file_path) AS first_file FROM f WHERE x.dataset <> '' GROUP BY ALL""",
        "dense_round_trip": "SELECT CAST((l_suppkey % 10) * 10 - 45 AS DOUBLE) AS latitude, CAST((l_partkey % 36) * 10 AS DOUBLE) AS longitude, round(CAST(sum(CAST(l_quantity AS DECIMAL(12,2))) AS DOUBLE), 6) AS value FROM lineitem GROUP BY ALL",
        "cell_table": f"""WITH c AS (SELECT CAST((l_suppkey % 10) - 4.5 AS DOUBLE) AS rlat, CAST((l_partkey % 36) - 17.5 AS DOUBLE) AS rlon, CAST(sum(CAST(l_quantity AS DECIMAL(12,2))) AS DOUBLE) AS value FROM lineitem GROUP BY ALL)
  SELECT rlat, rlon, round(degrees(asin(sin({lat}) * sin(radians(47)) + cos({lat}) * cos({lon}) * cos(radians(47)))), 6) AS lat,
    round((degrees(atan2(cos({lat}) * sin({lon}), cos({lat}) * cos({lon}) * sin(radians(47)) - sin({lat}) * cos(radians(47)))) + 12 + 540) % 360 - 180, 6) AS lon, value FROM c""",
        "describe_dataset": "SELECT l_linestatus AS status, 'crs_latitude_longitude' AS crs, strftime(min(l_shipdate), '%Y-%m-%d') AS low, strftime(max(l_shipdate), '%Y-%m-%d') AS high, 'kg' AS units, 350.0::DOUBLE AS east FROM lineitem WHERE l_returnflag = 'A' GROUP BY ALL",
        "merged_domain": "SELECT count(DISTINCT l_shipdate) FILTER (l_returnflag = 'R') AS n_time, count(DISTINCT l_partkey % 36) AS n_lon, 5.0::DOUBLE AS latitude, 'latitude' AS scalars, 8 * count(DISTINCT l_shipdate) * count(DISTINCT l_partkey % 36) AS n_bytes FROM lineitem",
        "persisted_month": w + "SELECT t.time, a.latitude, o.longitude, round(g.value, 6) AS value FROM (SELECT DISTINCT time FROM g WHERE time >= '1995-07-01' AND time < '1995-08-01') t CROSS JOIN (SELECT DISTINCT latitude FROM g) a CROSS JOIN (SELECT DISTINCT longitude FROM g) o LEFT JOIN g ON g.time = t.time AND g.latitude = a.latitude AND g.longitude = o.longitude",
    }

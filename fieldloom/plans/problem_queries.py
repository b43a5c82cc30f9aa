"""Queries of the data-preparation operators, and the SQL that the plain ones must agree with."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.operators.column_union import unite
from fieldloom.operators.regular_grid import missing_periods, regular_grid
from fieldloom.operators.schema_drift import schema_changes, unified_fields, unified_schema
from fieldloom.operators.small_files import consolidate, kept_records, surplus_copies
from fieldloom.operators.spatial_near import geographic, near_pairs, points_in_regions
from fieldloom.operators.time_labels import normalise_labels, one_instant
from fieldloom.operators.unit_values import other_units, values_in_common_units
from fieldloom.plans.scale import shared_path, table

#: Regions of the query p2_regions: (name, ring of (latitude, longitude)).
REGIONS = [
    ("alpine arc", [(43.5, 5.0), (48.5, 6.5), (48.0, 16.5), (45.5, 15.0), (44.0, 8.0)]),
    ("inland sea", [(30.0, -6.0), (46.0, -6.0), (46.0, 37.0), (30.0, 37.0)]),
    ("inland sea", [(38.0, 10.0), (40.0, 10.0), (40.0, 18.0), (38.0, 18.0)]),  # a hole
    ("date line", [(-60.0, 160.0), (60.0, 150.0), (60.0, 215.0), (-60.0, 200.0)]),
    ("southern wedge", [(-60.0, -70.0), (-20.0, -40.0), (-35.0, -10.0), (-10.0, 20.0), (-60.0, 40.0)]),
]

_PERIODS = """
WITH f AS (
  SELECT series_id, TRY_CAST(json_extract_string(field_encoding, '$._FillValue') AS DOUBLE) AS fill,
         regexp_extract(cell_methods, '(^|[^a-z])time:[^():]*[(] *interval: *([0-9.]+) *([a-z]+)', 2) AS amount,
         regexp_extract(cell_methods, '(^|[^a-z])time:[^():]*[(] *interval: *([0-9.]+) *([a-z]+)', 3) AS unit
  FROM series_fields),
u AS (
  SELECT series_id, fill, CAST(round(CAST(amount AS DOUBLE) * CASE
      WHEN unit IN ('s', 'sec', 'second', 'seconds') THEN 1000000.0 WHEN unit IN ('min', 'minute', 'minutes') THEN 60000000.0
      WHEN unit IN ('h', 'hr', 'hour', 'hours') THEN 3600000000.0 WHEN unit IN ('d', 'day', 'days') THEN 86400000000.0 END) AS BIGINT) AS step
  FROM f WHERE amount <> ''),
r AS (
  SELECT DISTINCT p.series_id, step, (epoch_us(obs_time) - ((epoch_us(obs_time) % step) + step) % step) AS t0
  FROM point_values p JOIN u USING (series_id)
  WHERE data_value IS NOT NULL AND NOT isnan(data_value) AND (fill IS NULL OR data_value <> fill) AND step IS NOT NULL),
g AS (SELECT series_id, step, t0, lead(t0) OVER (PARTITION BY series_id ORDER BY t0) AS t1 FROM r)
"""

_LOCATED = """
WITH c AS (
  SELECT domain_id, coalesce(json_extract_string(crs, '$.grid_mapping_name'), 'latitude_longitude') AS kind, radians(CAST(json_extract_string(crs, '$.grid_north_pole_latitude') AS DOUBLE)) AS pole,
         CAST(json_extract_string(crs, '$.grid_north_pole_longitude') AS DOUBLE) AS pole_lon, radians(CAST(json_extract_string(crs, '$.north_pole_grid_longitude') AS DOUBLE)) AS shift FROM domain_crs),
r AS (
  SELECT pt_id, kind, pole, pole_lon, latitude, longitude, grid_latitude, grid_longitude, radians(grid_latitude) AS gr, radians(grid_longitude) - shift AS gs,
         coalesce(NOT isnan(latitude) AND NOT isnan(longitude), false) AS direct, coalesce(NOT isnan(grid_latitude) AND NOT isnan(grid_longitude) AND abs(grid_latitude) <= 90 AND abs(grid_longitude) <= 360, false) AS gridded
  FROM domain_points LEFT JOIN c USING (domain_id)),
g AS (
  SELECT pt_id, CASE WHEN direct THEN latitude WHEN gridded AND kind = 'rotated_latitude_longitude' THEN degrees(asin(sin(gr) * sin(pole) + cos(gr) * cos(gs) * cos(pole))) WHEN gridded AND kind = 'latitude_longitude' THEN grid_latitude END AS lat,
         CASE WHEN direct THEN longitude WHEN gridded AND kind = 'rotated_latitude_longitude' THEN ((degrees(atan2(cos(gr) * sin(gs), cos(gr) * cos(gs) * sin(pole) - sin(gr) * cos(pole))) + pole_lon + 540) % 360)
              WHEN gridded AND kind = 'latitude_longitude' THEN grid_longitude END AS lon FROM r)"""


_RECORDS = """
WITH l AS (
  SELECT file_id, written_at, dataset, vars, unnest(string_split(payload, chr(10))) AS line, generate_subscripts(string_split(payload, chr(10)), 1) AS line_no
  FROM dataset_files WHERE payload IS NOT NULL),
e AS (SELECT *, string_split(replace(line, chr(13), ''), ',') AS x FROM l WHERE NOT starts_with(ltrim(line), '#')),
r AS (
  SELECT file_id, written_at, dataset, vars, line_no, TRY_CAST(replace(replace(trim(x[1]), 'Z', ''), 'T', ' ') || CASE WHEN length(replace(trim(x[1]), 'Z', '')) = 16 THEN ':00' ELSE '' END AS TIMESTAMP) AS t,
         TRY_CAST(trim(x[2]) AS DOUBLE) AS p, CASE WHEN lower(trim(x[3])) = 'nan' THEN NULL ELSE TRY_CAST(trim(x[3]) AS DOUBLE) END AS v
  FROM e WHERE len(x) >= 3 AND trim(x[3]) <> '')
"""


#: Fields of described files: e by file, d what their properties say, c by start, v the starts.
_FIELDS = """
WITH f AS (SELECT file_id, dataset, vars, start_at, CAST(field_encoding AS JSON) AS enc, CAST(field_properties AS JSON) AS prop FROM dataset_files WHERE field_encoding IS NOT NULL AND start_at IS NOT NULL),
ke AS (SELECT file_id, enc AS j, unnest(json_keys(enc)) AS k FROM f WHERE json_type(enc) = 'OBJECT'), kp AS (SELECT file_id, prop AS j, unnest(json_keys(prop)) AS k FROM f WHERE json_type(prop) = 'OBJECT'),
je AS (SELECT file_id, k AS ncvar, json_extract(j, '$."' || k || '"') AS x FROM ke UNION ALL SELECT file_id, json_extract_string(x, '$.ncvar'), x FROM (SELECT file_id, unnest(CAST(enc AS JSON[])) AS x FROM f WHERE json_type(enc) = 'ARRAY')),
jp AS (SELECT file_id, k AS ncvar, json_extract(j, '$."' || k || '"') AS x FROM kp UNION ALL SELECT file_id, json_extract_string(x, '$.ncvar'), x FROM (SELECT file_id, unnest(CAST(prop AS JSON[])) AS x FROM f WHERE json_type(prop) = 'ARRAY')),
e AS (SELECT file_id, ncvar, CASE WHEN json_extract_string(x, '$.dtype') IN ('float32', 'f4', '<f4', 'float') THEN 'f4' WHEN json_extract_string(x, '$.dtype') IN ('float64', 'f8', '<f8', 'double') THEN 'f8'
    WHEN json_extract_string(x, '$.dtype') IN ('int16', 'i2', '<i2', 'short') THEN 'i2' WHEN json_extract_string(x, '$.dtype') IN ('int32', 'i4', '<i4', 'int') THEN 'i4' ELSE json_extract_string(x, '$.dtype') END AS dt FROM je),
d AS (SELECT file_id, ncvar, coalesce('s:' || trim(json_extract_string(x, '$.standard_name')), 'l:' || lower(trim(json_extract_string(x, '$.long_name')))) AS q, json_extract_string(x, '$.units') AS u FROM jp),
c AS (SELECT dataset, vars, start_at, e.ncvar, max(dt) AS dt, max(q) AS q FROM f JOIN e USING (file_id) LEFT JOIN d ON d.file_id = e.file_id AND d.ncvar = e.ncvar GROUP BY ALL),
v AS (SELECT dataset, vars, start_at, min(file_id) AS file_id FROM f GROUP BY ALL)
"""


#: Labels that count units since a reference, without a named zone: the form that SQL can read.
_COUNTED = "get_json_object(coord_encoding, '$.units') like '% since %' and get_json_object(coord_encoding, '$.timezone') is null"


def _edges() -> str:
    """The rings' edges as rows, moved over the date line where they cross it."""
    rows = []
    for name, ring in REGIONS:
        for shift in (0, -360, 360):
            for (la0, lo0), (la1, lo1) in zip(ring, ring[1:] + ring[:1]):
                low, high = sorted(((la0, lo0), (la1, lo1)))
                rows.append(f"('{name}', {shift}, {low[0]:.1f}, {low[1] + shift:.1f}, {high[0]:.1f}, {high[1] + shift:.1f})")
    return ", ".join(rows)


ORACLE = {
    "p1_found": _PERIODS + "SELECT series_id, unnest(generate_series(t0 + step, t1 - step, step)) AS period_us FROM g WHERE t1 > t0 + step",
    "p1_grid": _PERIODS + """,
i AS (SELECT p.series_id, step, epoch_us(obs_time) AS t, max(data_value) AS v FROM point_values p JOIN u USING (series_id) WHERE data_value IS NOT NULL AND NOT isnan(data_value) AND (fill IS NULL OR data_value <> fill) AND step IS NOT NULL AND obs_time IS NOT NULL GROUP BY ALL),
s AS (SELECT *, lead(t) OVER (PARTITION BY series_id ORDER BY t) AS after, (t - ((t % step) + step) % step) AS p0 FROM i),
c AS (SELECT series_id, step, t, v, least(coalesce(after, t + step), t + step) AS until, p0, unnest(generate_series(p0, CASE WHEN after IS NULL THEN p0 ELSE after - 1 - (((after - 1) % step) + step) % step END, step)) AS p FROM s),
h AS (SELECT *, greatest(0, least(until, p + step) - greatest(t, p)) AS held FROM c)
SELECT series_id, p AS period_us, CAST(sum(CASE WHEN p = p0 THEN 1 ELSE 0 END) AS BIGINT) AS n_readings, round(CAST(sum(held) AS DOUBLE) / any_value(step) + 1e-10, 7) AS coverage, round(CASE WHEN sum(held) > 0 THEN sum(held * v) / sum(held) END + 1e-9, 5) AS mean_value,
  sum(CASE WHEN p = p0 THEN 1 ELSE 0 END) = 0 AS missing FROM h GROUP BY series_id, p""",
    "p1_summary": _PERIODS + """
SELECT series_id, CAST(count(*) AS BIGINT) AS n_with, CAST(sum(CASE WHEN t1 IS NULL THEN 0 ELSE (t1 - t0) // step - 1 END) AS BIGINT) AS n_missing FROM g GROUP BY series_id""",
    "p2_found": _LOCATED + """,
v AS (SELECT DISTINCT pt_id, cos(radians(lat)) * cos(radians(lon)) AS x, cos(radians(lat)) * sin(radians(lon)) AS y, sin(radians(lat)) AS z FROM g WHERE abs(lat) <= 90 AND abs(lon) <= 360),
b AS (SELECT *, CAST(floor(z / 0.00004) AS BIGINT) AS band FROM v),
n AS (SELECT pt_id, x, y, z, unnest([band - 1, band, band + 1]) AS band FROM b)
SELECT DISTINCT b.pt_id AS pt_a, n.pt_id AS pt_b FROM b JOIN n ON b.band = n.band AND b.pt_id < n.pt_id
WHERE (b.x - n.x) ** 2 + (b.y - n.y) ** 2 + (b.z - n.z) ** 2 <= (2 * sin(250.0 / 6371229.0 / 2)) ** 2""",
    "p2_regions": _LOCATED + f""",
p AS (SELECT DISTINCT pt_id, lat, ((lon + 180) % 360 + 360) % 360 - 180 AS lon FROM g WHERE abs(lat) <= 90 AND abs(lon) <= 360),
e AS (SELECT * FROM (VALUES {_edges()}) AS v(region, shift, la0, lo0, la1, lo1) WHERE la0 < la1),
h AS (SELECT pt_id, lat, lon, region, shift FROM p JOIN e ON lat >= la0 AND lat < la1 AND lo0 + (lat - la0) * (lo1 - lo0) / (la1 - la0) <= lon GROUP BY ALL HAVING count(*) % 2 = 1)
SELECT DISTINCT pt_id, region FROM h""",
    "p3_found": _RECORDS + """
SELECT file_id, CAST(line_no AS INTEGER) AS line_no FROM (
  SELECT *, row_number() OVER (PARTITION BY dataset, vars, t, p, v ORDER BY written_at, file_id, line_no) AS k FROM r WHERE t IS NOT NULL AND p IS NOT NULL)
WHERE k > 1""",
    **{k: _RECORDS + """
SELECT dataset, vars, epoch_us(t) AS t_us, p AS points, v AS value, count(*) AS copies, arg_min(file_id, (written_at, file_id, line_no)) AS file_id, CAST(arg_min(line_no, (written_at, file_id, line_no)) AS INTEGER) AS line_no
FROM r WHERE t IS NOT NULL AND p IS NOT NULL GROUP BY ALL""" for k in ("p3_records", "p3_merged")},
    "p4_counted": r"""
WITH u(unit, ms) AS (VALUES ('ms', 1), ('millisecond', 1), ('milliseconds', 1), ('msec', 1), ('msecs', 1), ('s', 1000), ('sec', 1000), ('secs', 1000), ('second', 1000), ('seconds', 1000), ('min', 60000), ('mins', 60000), ('minute', 60000), ('minutes', 60000),
    ('h', 3600000), ('hr', 3600000), ('hrs', 3600000), ('hour', 3600000), ('hours', 3600000), ('d', 86400000), ('day', 86400000), ('days', 86400000), ('week', 604800000), ('weeks', 604800000)),
r AS (SELECT DISTINCT coord_id, trim(coord_text, E' \t\n\r') AS x, regexp_extract(json_extract_string(coord_encoding, '$.units'), '^\s*([A-Za-z]+)\s+since\s+(\d{1,4})-(\d{1,2})-(\d{1,2})(?:[T ]+(\d{1,2})(?::(\d{1,2})(?::(\d{1,2})(?:\.\d*)?)?)?)?\s*(Z|z|UTC|GMT|[+-]\d{1,2}(?::?\d{2})?)?\s*$', ['unit', 'y', 'mo', 'd', 'h', 'mi', 's', 'z']) AS p
  FROM time_coords WHERE coord_id IS NOT NULL AND json_extract_string(coord_encoding, '$.units') LIKE '% since %' AND json_extract_string(coord_encoding, '$.timezone') IS NULL
    AND lower(trim(coalesce(json_extract_string(coord_encoding, '$.calendar'), ''))) IN ('', 'standard', 'gregorian', 'proleptic_gregorian')),
n AS (SELECT coord_id, TRY_CAST(x AS DECIMAL(27, 14)) * CAST(ms AS DECIMAL(10, 0)) AS ms, TRY(make_timestamp(CAST(p.y AS BIGINT), CAST(p.mo AS BIGINT), CAST(p.d AS BIGINT), coalesce(TRY_CAST(p.h AS BIGINT), 0), coalesce(TRY_CAST(p.mi AS BIGINT), 0), coalesce(TRY_CAST(p.s AS DOUBLE), 0))) AS ref,
    CASE WHEN p.z IN ('', 'Z', 'z', 'UTC', 'GMT') THEN 0 ELSE (CASE WHEN p.z[1] = '-' THEN -1 ELSE 1 END) * (CAST(regexp_extract(p.z, '^[+-](\d{1,2}?)(?::?(\d{2}))?$', 1) AS INTEGER) * 60 + coalesce(TRY_CAST(regexp_extract(p.z, '^[+-](\d{1,2}?)(?::?(\d{2}))?$', 2) AS INTEGER), 0)) END AS shift
  FROM r JOIN u ON u.unit = lower(p.unit) WHERE regexp_matches(x, '^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$'))
SELECT DISTINCT coord_id, CAST(floor(ms + epoch_ms(ref) - shift * 60000 + 0.5) AS BIGINT) AS utc_ms FROM n WHERE ms IS NOT NULL AND ref IS NOT NULL""",
    "p5_found": _FIELDS + """,
p AS (SELECT dataset, vars, start_at, file_id, lag(start_at) OVER (PARTITION BY dataset, vars ORDER BY start_at) AS before FROM v),
n AS (SELECT p.file_id, p.dataset, p.vars, p.before, c.ncvar, c.dt, c.q FROM p JOIN c ON c.dataset IS NOT DISTINCT FROM p.dataset AND c.vars IS NOT DISTINCT FROM p.vars AND c.start_at = p.start_at WHERE before IS NOT NULL),
o AS (SELECT p.file_id, c.ncvar, c.dt, c.q FROM p JOIN c ON c.dataset IS NOT DISTINCT FROM p.dataset AND c.vars IS NOT DISTINCT FROM p.vars AND c.start_at = p.before),
come AS (SELECT * FROM n WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.file_id = n.file_id AND o.ncvar = n.ncvar)),
gone AS (SELECT * FROM o WHERE NOT EXISTS (SELECT 1 FROM n WHERE o.file_id = n.file_id AND o.ncvar = n.ncvar)),
pairs AS (SELECT come.file_id, come.ncvar AS new, gone.ncvar AS old, come.dt AS dt, gone.dt AS odt FROM come JOIN gone ON come.file_id = gone.file_id AND come.q = gone.q)
SELECT file_id, new AS ncvar, 'renamed' AS change_kind FROM pairs
UNION ALL SELECT file_id, new, 'retyped' FROM pairs WHERE dt <> odt
UNION ALL SELECT n.file_id, n.ncvar, 'retyped' FROM n JOIN o USING (file_id, ncvar) WHERE n.dt <> o.dt
UNION ALL SELECT file_id, ncvar, 'added' FROM come WHERE NOT EXISTS (SELECT 1 FROM pairs WHERE pairs.file_id = come.file_id AND pairs.new = come.ncvar)
UNION ALL SELECT file_id, ncvar, 'removed' FROM gone WHERE NOT EXISTS (SELECT 1 FROM pairs WHERE pairs.file_id = gone.file_id AND pairs.old = gone.ncvar)""",
    "p5_table": _FIELDS + """,
a AS (SELECT DISTINCT e.file_id, dataset, vars, start_at, e.ncvar, dt, substr(q, 3) AS quantity, u FROM f JOIN e USING (file_id) LEFT JOIN d ON d.file_id = e.file_id AND d.ncvar = e.ncvar),
k AS (SELECT dataset, vars, ncvar, quantity, min(start_at) AS since FROM a WHERE quantity IS NOT NULL GROUP BY ALL),
w AS (SELECT a.*, coalesce(quantity, (SELECT max((since, k.quantity))[2] FROM k WHERE k.dataset IS NOT DISTINCT FROM a.dataset AND k.vars IS NOT DISTINCT FROM a.vars AND k.ncvar = a.ncvar AND since <= a.start_at),
    (SELECT min((since, k.quantity))[2] FROM k WHERE k.dataset IS NOT DISTINCT FROM a.dataset AND k.vars IS NOT DISTINCT FROM a.vars AND k.ncvar = a.ncvar), ncvar) AS field FROM a),
t AS (SELECT dataset, vars, field, string_agg(DISTINCT dt, ' ' ORDER BY dt) AS ts FROM w GROUP BY ALL)
SELECT file_id, w.dataset, w.vars, w.field, ncvar, dt AS dtype, CASE WHEN ts NOT LIKE '% %' THEN ts WHEN ts = 'f4 i2' THEN 'f4' WHEN ts = 'i2 i4' THEN 'i4' ELSE 'f8' END AS unified_dtype, u AS units
FROM w JOIN t ON w.dataset IS NOT DISTINCT FROM t.dataset AND w.vars IS NOT DISTINCT FROM t.vars AND w.field = t.field""",
    "p5_united": """SELECT CASE WHEN l_shipdate < '1997-06-01' THEN 'first' WHEN l_shipdate < '1999-06-01' THEN 'second' ELSE 'third' END AS version, CAST(l_orderkey AS VARCHAR) AS l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_quantity, l_extendedprice,
  CASE WHEN l_shipdate < '1997-06-01' OR l_shipdate >= '1999-06-01' THEN l_discount END AS l_discount, l_returnflag, l_shipdate FROM lineitem""",
    "p5_changes": """SELECT * FROM (VALUES ('second', 'l_orderkey', 'retyped', NULL, 'bigint'), ('second', 'amount', 'renamed', 'l_quantity', NULL), ('second', 'gross', 'renamed', 'l_extendedprice', NULL), ('second', 'l_discount', 'removed', NULL, NULL),
  ('third', 'position', 'renamed', 'l_linenumber', NULL), ('third', 'position', 'retyped', 'l_linenumber', 'int'), ('third', 'l_discount', 'added', NULL, NULL), ('third', 'shipped', 'renamed', 'l_shipdate', NULL)) AS v("version", "column", change_kind, old_name, old_type)
  WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_shipdate < '1997-06-01') AND EXISTS (SELECT 1 FROM lineitem WHERE l_shipdate >= '1999-06-01')""",
    "p6_found": """
WITH u(name, kind, a, b) AS (VALUES ('m', 'L', 1, 0), ('metre', 'L', 1, 0), ('metres', 'L', 1, 0), ('meters', 'L', 1, 0), ('meter', 'L', 1, 0), ('cm', 'L', 0.01, 0), ('centimetre', 'L', 0.01, 0), ('centimeter', 'L', 0.01, 0), ('mm', 'L', 0.001, 0), ('millimetre', 'L', 0.001, 0), ('millimeter', 'L', 0.001, 0),
    ('km', 'L', 1000, 0), ('in', 'L', 0.0254, 0), ('inch', 'L', 0.0254, 0), ('inches', 'L', 0.0254, 0), ('ft', 'L', 0.3048, 0), ('foot', 'L', 0.3048, 0), ('feet', 'L', 0.3048, 0), ('fathom', 'L', 1.8288, 0), ('fathoms', 'L', 1.8288, 0),
    ('kg m-2', 'W', 0.001, 0), ('kg m**-2', 'W', 0.001, 0), ('kg/m2', 'W', 0.001, 0), ('l/m2', 'W', 0.001, 0), ('l m-2', 'W', 0.001, 0), ('1', 'R', 1, 0), ('fraction', 'R', 1, 0), ('%', 'R', 0.01, 0), ('pct', 'R', 0.01, 0), ('percent', 'R', 0.01, 0),
    ('k', 'T', 1, 0), ('kelvin', 'T', 1, 0), ('degk', 'T', 1, 0), ('degc', 'T', 1, 273.15), ('deg c', 'T', 1, 273.15), ('°c', 'T', 1, 273.15), ('degrees_c', 'T', 1, 273.15), ('celsius', 'T', 1, 273.15), ('degf', 'T', 5.0::DOUBLE / 9, 459.67 * 5.0::DOUBLE / 9), ('deg f', 'T', 5.0::DOUBLE / 9, 459.67 * 5.0::DOUBLE / 9), ('°f', 'T', 5.0::DOUBLE / 9, 459.67 * 5.0::DOUBLE / 9), ('fahrenheit', 'T', 5.0::DOUBLE / 9, 459.67 * 5.0::DOUBLE / 9),
    ('pa', 'P', 1, 0), ('pascal', 'P', 1, 0), ('n m-2', 'P', 1, 0), ('hpa', 'P', 100, 0), ('mb', 'P', 100, 0), ('mbar', 'P', 100, 0), ('millibar', 'P', 100, 0), ('kpa', 'P', 1000, 0), ('kilopascal', 'P', 1000, 0), ('bar', 'P', 100000, 0), ('atm', 'P', 101325, 0), ('atmosphere', 'P', 101325, 0),
    ('m s-1', 'V', 1, 0), ('m s**-1', 'V', 1, 0), ('m/s', 'V', 1, 0), ('metre/second', 'V', 1, 0), ('cm s-1', 'V', 0.01, 0), ('cm/s', 'V', 0.01, 0), ('km h-1', 'V', 1 / 3.6::DOUBLE, 0), ('km/h', 'V', 1 / 3.6::DOUBLE, 0), ('kmh', 'V', 1 / 3.6::DOUBLE, 0), ('kt', 'V', 1852 / 3600::DOUBLE, 0), ('kn', 'V', 1852 / 3600::DOUBLE, 0), ('knots', 'V', 1852 / 3600::DOUBLE, 0), ('mph', 'V', 0.44704, 0), ('mile/hour', 'V', 0.44704, 0)),
c AS (SELECT q, name, CAST(a AS DOUBLE) AS a, CAST(b AS DOUBLE) AS b FROM u JOIN (VALUES ('air_temperature', 'T'), ('precipitation_amount', 'L'), ('precipitation_amount', 'W'), ('soil_water', 'L'), ('soil_water', 'W'), ('surface_air_pressure', 'P'), ('wind_speed', 'V'), ('relative_humidity', 'R'), ('depth', 'L')) AS k(q, kind) USING (kind)),
s AS (SELECT DISTINCT * FROM field_samples WHERE sample_id IS NOT NULL),
t AS (SELECT sample_id, standard_name AS q, data_value, field_units, depth_value, depth_units, long_name, CASE WHEN data_value IS NULL THEN regexp_extract(data_text, '^ *([+-]?[0-9]*[.,]?[0-9]+|[0-9]+[.,])', 1) END AS n, CASE WHEN data_value IS NULL THEN trim(regexp_replace(data_text, '^ *([+-]?[0-9]*[.,]?[0-9]+|[0-9]+[.,]) *', ''), ' []()') END AS own FROM s),
r AS (SELECT 'field' AS item, sample_id, q, coalesce(data_value, TRY_CAST(replace(n, ',', '.') AS DOUBLE)) AS v, [own, field_units, regexp_extract(long_name, '(?:\\[([^\\[\\]]+)\\]) *$', 1), regexp_extract(long_name, '(?:[(]([^()]+)[)]) *$', 1), regexp_extract(long_name, 'units?: *(.+?) *$', 1), regexp_extract(long_name, ' in ([^ ].*?) *$', 1)] AS said FROM t
  UNION ALL SELECT 'depth', sample_id, 'depth', depth_value, [depth_units] FROM t),
f AS (SELECT row_number() OVER () AS id, * FROM r WHERE v IS NOT NULL AND NOT isnan(v) AND abs(v) < 1e20),
e AS (SELECT id, item, sample_id, q, v, unnest(said) AS said, generate_subscripts(said, 1) AS place FROM f),
m AS (SELECT id, item, sample_id, v, place, coalesce(x.a, y.a * TRY_CAST(regexp_extract(trim(said), '^([0-9.]+(e-?[0-9]+)?) +[^0-9 ]', 1) AS DOUBLE)) AS a, coalesce(x.b, y.b) AS b FROM e LEFT JOIN c x ON x.q = e.q AND x.name = lower(trim(said)) LEFT JOIN c y ON y.q = e.q AND y.name = lower(regexp_replace(trim(said), '^[0-9.]+(e-?[0-9]+)? +', '')) AND regexp_matches(trim(said), '^[0-9.]+(e-?[0-9]+)? +[^0-9 ]')),
o AS (SELECT DISTINCT ON (id) * FROM m WHERE a IS NOT NULL ORDER BY id, place)
SELECT DISTINCT sample_id, item, CAST(round(round((v * a + b) * 1000000, 4)) AS BIGINT) AS micro FROM o WHERE NOT (a = 1 AND b = 0)""",
}


def _summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = regular_grid(table(spark, sf_dir, "point_values"), table(spark, sf_dir, "series_fields"))
    return grid.groupBy("series_id").agg(F.sum((~F.col("missing")).cast("long")).alias("n_with"), F.sum(F.col("missing").cast("long")).alias("n_missing"))


def _merged_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records as they stand in the merged files."""
    base = shared_path(spark, f"merged-{uuid.uuid4().hex}")
    consolidate(table(spark, sf_dir, "dataset_files"), base).count()
    return _shown_records(spark.read.parquet(f"{base}/merged"))


def _shown_records(records: DataFrame) -> DataFrame:
    return records.select("dataset", "vars", "t_us", "points", "value", "copies", "file_id", "line_no")


def _drifting(spark: SparkSession, sf_dir: str) -> list[tuple[str, DataFrame]]:
    """The order lines in three versions: of the second two columns are renamed, one retyped, one left out, of the third another is renamed and one comes back."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_returnflag", "l_shipdate")
    early, middle, late = (rows.where(c) for c in ("l_shipdate < '1997-06-01'", "l_shipdate >= '1997-06-01' and l_shipdate < '1999-06-01'", "l_shipdate >= '1999-06-01'"))
    second = middle.selectExpr("cast(l_orderkey as string) as l_orderkey", "l_linenumber", "l_quantity as amount", "l_extendedprice as gross", "l_returnflag", "l_shipdate")
    third = late.selectExpr("cast(l_orderkey as string) as l_orderkey", "cast(l_linenumber as bigint) as position", "l_quantity as amount", "l_extendedprice as gross", "l_discount", "l_returnflag", "l_shipdate as shipped")
    return [("first", early), ("second", second), ("third", third)]


def _drifting_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame(unite(_drifting(spark, sf_dir))[1], "version string, column string, change_kind string, old_name string, old_type string")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    t = table
    return {
        "p1_found": lambda s, d: missing_periods(t(s, d, "point_values"), t(s, d, "series_fields")),
        "p1_grid": lambda s, d: regular_grid(t(s, d, "point_values"), t(s, d, "series_fields")).withColumns({"coverage": F.round(F.col("coverage") + 1e-10, 7), "mean_value": F.round(F.col("mean_value") + 1e-9, 5)}),
        "p1_summary": _summary,
        "p2_found": lambda s, d: near_pairs(t(s, d, "domain_points"), t(s, d, "domain_crs")),
        "p2_regions": lambda s, d: points_in_regions(geographic(t(s, d, "domain_points"), t(s, d, "domain_crs")), REGIONS),
        "p3_found": lambda s, d: surplus_copies(t(s, d, "dataset_files")),
        "p3_records": lambda s, d: _shown_records(kept_records(t(s, d, "dataset_files"))),
        "p3_merged": _merged_records,
        "p3_files": lambda s, d: consolidate(t(s, d, "dataset_files")),
        "p4_found": lambda s, d: one_instant(t(s, d, "time_coords")),
        "p4_counted": lambda s, d: one_instant(t(s, d, "time_coords").where(_COUNTED)),
        "p4_labels": lambda s, d: normalise_labels(t(s, d, "time_coords")),
        "p5_found": lambda s, d: schema_changes(t(s, d, "dataset_files")).select("file_id", "ncvar", "change_kind"),
        "p5_table": lambda s, d: unified_fields(t(s, d, "dataset_files")).drop("start_at"),
        "p5_changes": _drifting_changes,
        "p5_united": lambda s, d: unite(_drifting(s, d))[0],
        "p5_schema": lambda s, d: unified_schema(t(s, d, "dataset_files")),
        "p6_found": lambda s, d: other_units(t(s, d, "field_samples")),
        "p6_values": lambda s, d: values_in_common_units(t(s, d, "field_samples")),
    }

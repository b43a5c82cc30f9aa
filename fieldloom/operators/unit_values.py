"""Quantities recorded in different units, in one unit each.

A value's unit is taken from where it is recorded: the value's own text, the units attribute, or the
long name. The values of a source without a usable unit are, in order, segmented by exact penalised
changepoint search on their logarithms; a segment whose level lies a known factor from that of all
the source's recorded values, in the common unit, is in the unit of that factor.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldloom.functions.changepoint import TOLERANCE, level_changes, nearest_factor
from fieldloom.meta.unit import parse_unit
from fieldloom.plans.ordered import sorted_groups
from fieldloom.plans.scale import broadcast_if_small, checkpointed, spread

# The common unit of each quantity, and whether a mass of water per area is a layer of it.
COMMON = {
    "air_temperature": ("K", False), "precipitation_amount": ("m", True), "surface_air_pressure": ("Pa", False), "wind_speed": ("m s-1", False),
    "relative_humidity": ("1", False), "soil_water": ("m", True), "depth": ("m", False),
}
#: Units that an unlabelled segment may be in.
INFERABLE = {
    "air_temperature": ["0.1 K", "0.01 K"], "precipitation_amount": ["mm", "cm", "0.1 mm", "inch"], "surface_air_pressure": ["hPa", "kPa", "bar", "0.1 hPa", "atm"],
    "wind_speed": ["cm s-1", "km h-1", "kt"], "relative_humidity": ["%"], "soil_water": ["mm", "cm"], "depth": ["cm", "mm"],
}
#: Values from here on are fill values.
FILL_FROM = 1e20
#: Values of one source without a unit that are segmented together, and how many of them on each side are read with the next block too.
BLOCK, BESIDE = 2048, 512
#: Recorded values from which on a source's own spread counts, not that of its quantity.
OWN_SPREAD = 8

_TEXT = re.compile(r"^\s*([+-]?(?:\d+(?:[.,]\d*)?|[.,]\d+)(?:[eE][+-]?\d+(?![\d.]))?)\s*(.*?)\s*$", re.S)
_NAMED = [re.compile(p) for p in (r"\[([^\[\]]+)\]\s*$", r"\(([^()]+)\)\s*$", r"[,;]?\s*\bunits?\s*[:=]\s*(.+?)\s*$", r"\bin\s+(\S.*?)\s*$")]


@lru_cache(maxsize=65536)
def conversion(quantity: str | None, units: str | None) -> tuple[float, float] | None:
    """(a, b) of common = value * a + b; None for an unknown quantity or unit, or one of another kind."""
    if quantity not in COMMON or units is None or not units.strip():
        return None
    common, layer = COMMON[quantity]
    unit, target = parse_unit(units.strip()), parse_unit(common)
    if unit.is_unknown:
        return None
    if unit.dim == target.dim:
        return unit.to(target)
    if layer and unit.dim == parse_unit("kg m-2").dim:
        return unit.scale * 1e-3, 0.0
    return None


@lru_cache(maxsize=65536)
def unit_in_name(quantity: str | None, long_name: str | None) -> str | None:
    """The unit that a long name states at its end: in brackets, after ``units:`` or after ``in``."""
    for pattern in _NAMED:
        m = pattern.search(long_name or "")
        if m and conversion(quantity, m[1]) is not None:
            return m[1].strip()
    return None


def value_in_text(text: str | None) -> tuple[float | None, str | None]:
    """The number at the start of a text, with a point or comma, and the unit after it, with or without brackets."""
    m = _TEXT.match(text or "")
    if not m:
        return None, None
    rest = m[2]
    if len(rest) > 1 and (rest[0], rest[-1]) in (("[", "]"), ("(", ")")):
        rest = rest[1:-1].strip()
    return float(m[1].replace(",", ".")), rest or None


def recorded(quantity: str | None, value: float | None, text: str | None, units: str | None, long_name: str | None) -> tuple[float | None, str | None]:
    """(value, unit) of a sample as recorded; the unit is None where it is absent or unknown."""
    own = None
    if value is None:
        value, own = value_in_text(text)
    for candidate in (own, units):
        if conversion(quantity, candidate) is not None:
            return value, candidate.strip()
    return value, unit_in_name(quantity, long_name)


def infer_units(quantity: str, raw: np.ndarray, level: float, deviation: float) -> list[str | None]:
    """The unit of each value of a history without units: by the level of its segment against that of the recorded values.

    ``level`` and ``deviation`` are of the logarithms of the recorded values in the common unit. A
    segment too short for its level to be told within the tolerance, or from that of the next likely
    unit, has no unit, nor have values that aren't positive.
    """
    out: list[str | None] = [None] * len(raw)
    at = np.flatnonzero(raw > 0)
    logs, start = np.log(raw[at]), 0
    factors = {1.0 / conversion(quantity, u)[0]: u for u in INFERABLE.get(quantity, [])}
    penalty = 3.0 * np.log(max(len(at), 2)) * max(deviation * deviation, 0.01)
    for end in level_changes(logs, penalty, 1):
        shift, error = float(np.median(logs[start:end])) - level, deviation / np.sqrt(end - start)
        factor = nearest_factor(shift, list(factors), min(TOLERANCE, max(0.1, 4 * deviation)))
        apart = sorted(abs(np.log(f) - shift) for f in {1.0, *factors})
        if factor is not None and error <= TOLERANCE and apart[1] - apart[0] > 2 * error:
            for i in at[start:end]:
                out[i] = factors.get(factor, COMMON[quantity][0])
        start = end
    return out


def _inferred(parsed: DataFrame) -> DataFrame:
    """The rows without a known unit, with the units that their histories tell."""
    logs = parsed.where("origin = 'recorded'").withColumn("common_value", _common()).where("common_value > 0").withColumn("log", F.log("common_value"))
    middle, quarters = F.percentile_approx("log", 0.5, 10_000), F.percentile_approx("log", [0.25, 0.75], 10_000)
    width = (quarters[1] - quarters[0]) / 1.349
    by_source = logs.groupBy("source", "quantity").agg(middle.alias("level"), width.alias("own"), F.count("*").alias("n"))
    by_quantity = logs.groupBy("quantity").agg(width.alias("common_width"))
    levels = by_source.join(broadcast_if_small(by_quantity), "quantity").select("source", "level", F.when(F.col("n") >= OWN_SPREAD, F.col("own")).otherwise(F.col("common_width")).alias("deviation"))

    # positions within a source, counted over the range partitions, so that no task holds a whole history
    rows = parsed.where("origin = 'unknown'").repartitionByRange("source", "sampled_at", "sample_id", "value").sortWithinPartitions("source", "sampled_at", "sample_id", "value")
    rows = checkpointed(rows).withColumns({"part": F.spark_partition_id(), "at": F.monotonically_increasing_id()})
    parts = rows.groupBy("source", "part").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    starts = parts.select("source", "part", "first", F.coalesce(before, F.lit(0)).alias("before"))
    rows = rows.join(broadcast_if_small(starts), ["source", "part"]).withColumn("position", F.col("at") - F.col("first") + F.col("before"))
    rows = rows.join(broadcast_if_small(levels), "source", "left")
    own, within = F.floor(F.col("position") / BLOCK), F.col("position") % BLOCK
    blocks = F.array_compact(F.array(own, F.when((within < BESIDE) & (own > 0), own - 1), F.when(within >= BLOCK - BESIDE, own + 1)))
    rows = rows.select("sample_id", "item", "quantity", "value", "unit", "source", "position", "level", "deviation", F.explode(blocks).alias("block"))

    def segment(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in sorted_groups(batches, ["source", "block"]):
            quantity, level, deviation = pdf["quantity"].iloc[0], pdf["level"].iloc[0], pdf["deviation"].iloc[0]
            guess = infer_units(quantity, pdf["value"].to_numpy(), level, deviation)
            home = (pdf["position"].to_numpy() // BLOCK) == pdf["block"].iloc[0]
            c = [conversion(quantity, g) if g else None for g in guess]
            out = pdf[["sample_id", "item", "quantity", "value", "unit"]].copy()
            out["unit"] = [g or (u if isinstance(u, str) else None) for g, u in zip(guess, pdf["unit"])]
            out["a"], out["b"] = (np.array([k[i] if k else np.nan for k in c]) for i in (0, 1))
            yield out[home]

    # a history without a level, or of a quantity whose units aren't inferred, has nothing to be told by
    told = F.col("level").isNotNull() & F.col("deviation").isNotNull() & F.col("quantity").isin(sorted(INFERABLE))
    columns = ["sample_id", "item", "quantity", "value", "unit"]
    plain = rows.where(~F.coalesce(told, F.lit(False)) & (F.col("block") == F.floor(F.col("position") / BLOCK))).select(*columns, F.lit(None).cast("double").alias("a"), F.lit(None).cast("double").alias("b"))
    # a fixed number of partitions: small rows of many groups would be coalesced into one task
    tasks = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), rows.sparkSession.sparkContext.defaultParallelism)
    sought = rows.where(told).repartition(tasks, "source", "block").sortWithinPartitions("source", "block", "position")
    found = sought.mapInPandas(segment, "sample_id long, item string, quantity string, value double, unit string, a double, b double").withColumns({c: F.nanvl(c, F.lit(None)) for c in "ab"})
    return plain.unionByName(found).withColumn("origin", F.when(F.col("a").isNotNull(), "inferred").otherwise("unknown"))


def _codes(column: pa.Array) -> tuple[np.ndarray, list[str | None]]:
    """Numbers of a text column's values, and the values; null is the first one."""
    held = column.dictionary_encode()
    return held.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64) + 1, [None, *held.dictionary.to_pylist()]


def _told(quantity: tuple[np.ndarray, list], text: tuple[np.ndarray, list], unit_of: Callable[[str | None, str | None], str | None]) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(a, b, unit) of each row by its quantity and a text; each different pair is read once."""
    pairs, at = np.unique(quantity[0] * len(text[1]) + text[0], return_inverse=True)
    units = [unit_of(quantity[1][k // len(text[1])], text[1][k % len(text[1])]) for k in pairs.tolist()]
    factors = [conversion(quantity[1][k // len(text[1])], u) for k, u in zip(pairs.tolist(), units)]
    a, b = (np.array([np.nan if f is None else f[i] for f in factors]) for i in (0, 1))
    known = pa.array([u.strip() if u is not None and f is not None else None for u, f in zip(units, factors)], pa.string())
    return a[at], b[at], known.take(pa.array(at))


def _factors(rows: DataFrame) -> DataFrame:
    """Adds a, b and unit of the field's value (from its text, its attribute or its long name) and depth_a, depth_b.

    Texts are compared as Arrow dictionaries, so an expression is parsed once for each batch it is in.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            quantity = _codes(column["quantity"])
            a, b, unit = _told(quantity, _codes(column["own"]), lambda _, u: u)
            for name, unit_of in (("field_units", lambda _, u: u), ("long_name", unit_in_name)):
                a2, b2, unit2 = _told(quantity, _codes(column[name]), unit_of)
                b = np.where(np.isnan(a), b2, b)
                unit, a = pc.coalesce(unit, unit2), np.where(np.isnan(a), a2, a)
            depth_a, depth_b, _ = _told((np.zeros(len(a), np.int64), ["depth"]), _codes(column["depth_units"]), lambda _, u: u)
            kept = [n for n in batch.schema.names if n not in ("own", "field_units", "long_name")]
            number = lambda v: pa.array(v, pa.float64(), mask=np.isnan(v))
            yield pa.RecordBatch.from_arrays([*[column[n] for n in kept], number(a), number(b), unit, number(depth_a), number(depth_b)], names=[*kept, "a", "b", "unit", "depth_a", "depth_b"])

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name not in ("own", "field_units", "long_name"))
    return rows.mapInArrow(run, f"{kept}, a double, b double, unit string, depth_a double, depth_b double")


_NUMBER = r"(?sU)^\s*([+-]?(?:\d+(?:[.,]\d*)?|[.,]\d+)(?:[eE][+-]?\d+(?![\d.]))?)\s*(.*?)\s*$"


def _items(samples: DataFrame) -> DataFrame:
    """sample_id, item, quantity, value, unit, a, b, source, sampled_at of each usable value; a and b are null without a known unit."""
    rows = samples.where(F.col("sample_id").isNotNull()).select(
        F.col("sample_id").cast("long").alias("sample_id"), "sampled_at", F.to_json(F.struct("dataset", "ncvar", "standard_name")).alias("source"), F.col("standard_name").alias("quantity"), "long_name", "field_units", "depth_units",
        F.col("data_value").cast("double").alias("value"), F.col("depth_value").cast("double").alias("depth_value"), F.when(F.col("data_value").isNull(), F.col("data_text")).alias("text"))
    rows = rows.withColumns({"number": F.replace(F.regexp_extract("text", _NUMBER, 1), F.lit(","), F.lit(".")), "own": F.nullif(F.regexp_extract("text", _NUMBER, 2), F.lit(""))})
    bracketed = (F.length("own") > 1) & F.concat(F.substring("own", 1, 1), F.substring("own", -1, 1)).isin("[]", "()")
    rows = rows.withColumns({"value": F.coalesce("value", F.expr("try_cast(number as double)")), "own": F.when(bracketed, F.trim(F.expr("substring(own, 2, length(own) - 2)"))).otherwise(F.col("own"))})
    rows = _factors(spread(rows.drop("text", "number")))
    item = lambda name, quantity, value, unit, a, b: F.struct(F.lit(name).alias("item"), quantity.alias("quantity"), F.col(value).alias("value"), F.col(unit).alias("unit"), F.col(a).alias("a"), F.col(b).alias("b"))
    both = F.array(item("field", F.col("quantity"), "value", "unit", "a", "b"), item("depth", F.lit("depth"), "depth_value", "depth_units", "depth_a", "depth_b"))
    usable_value = lambda x: x["value"].isNotNull() & ~F.isnan(x["value"]) & (F.abs(x["value"]) < FILL_FROM)
    return rows.select("sample_id", "sampled_at", "source", F.explode(F.filter(both, usable_value)).alias("x")).select("sample_id", "x.*", F.concat(F.col("x.item"), F.lit(" "), F.col("source")).alias("source"), "sampled_at")


def values_in_common_units(samples: DataFrame) -> DataFrame:
    """One row for each usable value: sample_id, item, quantity, value, unit, origin, common_value, micro.

    ``item`` is field or depth; ``value`` and ``unit`` are as recorded; ``origin`` is recorded, inferred
    (by segmentation) or unknown, and then ``common_value`` and ``micro`` (millionths, rounded) are null.
    Null, NaN and fill values have no row, nor have samples with a null id. The value's text counts only where data_value is null. Copies
    of a row count once. A source is the fields or the depths of one dataset, variable and quantity; its
    values without a unit are segmented by their positions in its history in blocks of ``BLOCK``, which
    are read with ``BESIDE`` values of both neighbours, against the level of all its recorded values.
    """
    used = ["sample_id", "dataset", "ncvar", "standard_name", "long_name", "sampled_at", "data_value", "data_text", "field_units", "depth_value", "depth_units"]
    found = checkpointed(_items(samples.select(*used).distinct()).withColumn("origin", F.when(F.col("a").isNotNull(), "recorded").otherwise("unknown")))
    columns = ["sample_id", "item", "quantity", "value", "unit", "origin", "a", "b"]
    done = found.where("origin = 'recorded'").select(*columns).unionByName(_inferred(found).select(*columns))
    return done.withColumn("common_value", _common()).select("sample_id", "item", "quantity", "value", "unit", "origin", "common_value", _millionths().alias("micro"))


def _common() -> Column:
    """The value in the common unit; null without a known unit, or beyond what a number holds."""
    return F.nanvl(F.col("value") * F.col("a") + F.col("b"), F.lit(None))


def _millionths() -> Column:
    rounded = F.round(F.col("common_value") * 1e6)
    return F.when(F.abs(rounded) < 9e18, rounded.cast("long"))


def other_units(samples: DataFrame) -> DataFrame:
    """sample_id, item, micro of the values recorded in a known unit other than the common one."""
    other = F.col("a").isNotNull() & ~((F.col("b") == 0.0) & (F.abs(F.col("a") - 1.0) < 1e-12))
    found = _items(samples).where(other).withColumn("common_value", _common())
    return found.select("sample_id", "item", _millionths().alias("micro")).where("micro is not null").distinct()

"""Calendar bins of a time column, their labels, and the gaps between them."""

from __future__ import annotations

import re
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldloom.meta.axis import MethodType
from fieldloom.plans.ordered import with_next

# Frequency aliases.
_FIXED_US = {"us": 1, "ms": 1_000, "s": 1_000_000, "min": 60_000_000, "t": 60_000_000, "h": 3_600_000_000, "d": 86_400_000_000}
_CALENDAR = {"w": "W", "m": "ME", "me": "ME", "ms": "MS", "q": "QE", "qe": "QE", "qs": "QS", "y": "YE", "ye": "YE", "a": "YE", "ys": "YS", "as": "YS"}
_FREQUENCY = re.compile(r"^\s*(\d+)?\s*([A-Za-z]+?)(?:-[A-Z]{3})?\s*$")

AGGREGATES = {
    MethodType.MAX: F.max, MethodType.MIN: F.min, MethodType.SUM: F.sum, MethodType.MEAN: F.avg, MethodType.MEDIAN: F.median,
    MethodType.VARIANCE: F.var_pop, MethodType.STD_DEV: F.stddev_pop,
}


def parse_frequency(text: str) -> tuple[int, str]:
    """(number, alias): a fixed unit (us, ms, s, min, h, d) or W, ME, MS, QE, QS, YE, YS."""
    m = _FREQUENCY.match(text)
    if not m:
        raise ValueError(f"unknown frequency {text!r}")
    n, alias = int(m[1] or 1), m[2]
    if n < 1:
        raise ValueError("a frequency has a positive number")
    if alias in ("MS", "M", "ME", "W", "Q", "QE", "QS", "Y", "YE", "YS", "A", "AS"):
        return n, _CALENDAR[alias.lower()]
    if alias.lower() in _FIXED_US:
        return n, {"t": "min"}.get(alias.lower(), alias.lower())
    raise ValueError(f"unknown frequency {text!r}")


def _ntz(text: str) -> str:
    return f"cast({text} as timestamp_ntz)"


def bin_label(column: str, frequency: str, first: pd.Timestamp) -> Column:
    """The label of the bin of each time; ``first`` is the earliest time of the data, which anchors bins of several units."""
    n, unit = parse_frequency(frequency)
    day0 = f"TIMESTAMP_NTZ '{first.normalize():%Y-%m-%d} 00:00:00'"
    if unit in _FIXED_US:
        width = n * _FIXED_US[unit]
        return F.expr(f"timestampadd(MICROSECOND, (timestampdiff(MICROSECOND, {day0}, {column}) div {width}L) * {width}L, {day0})")
    month = f"((year({column}) - {first.year}) * 12 + month({column}) - {first.month})"
    start = f"DATE '{first:%Y-%m}-01'"
    if unit == "W":
        if n == 1:
            return F.expr(_ntz(f"date_add(cast(date_trunc('week', {column}) as date), 6)"))
        sunday = first.normalize() + pd.Timedelta(days=6 - first.dayofweek)
        return F.expr(_ntz(f"date_add(DATE '{sunday:%Y-%m-%d}', cast(ceil(datediff(cast({column} as date), DATE '{sunday:%Y-%m-%d}') / {7.0 * n}D) * {7 * n} as int))"))
    if unit == "ME":
        return F.expr(_ntz(f"last_day(add_months({start}, cast(ceil({month} / {float(n)}D) * {n} as int)))"))
    if unit == "MS":
        return F.expr(_ntz(f"add_months({start}, cast(floor({month} / {float(n)}D) * {n} as int))"))
    if unit in ("QE", "QS"):
        q0 = f"DATE '{first.year}-{3 * ((first.month - 1) // 3) + 1:02d}-01'"
        quarter = f"((year({column}) - {first.year}) * 4 + quarter({column}) - {(first.month - 1) // 3 + 1})"
        if unit == "QE":
            return F.expr(_ntz(f"last_day(add_months({q0}, cast(ceil({quarter} / {float(n)}D) * {3 * n} as int) + 2))"))
        return F.expr(_ntz(f"add_months({q0}, cast(floor({quarter} / {float(n)}D) * {3 * n} as int))"))
    year = f"(year({column}) - {first.year})"
    if unit == "YE":
        return F.expr(_ntz(f"make_date({first.year} + cast(ceil({year} / {float(n)}D) * {n} as int), 12, 31)"))
    return F.expr(_ntz(f"make_date({first.year} + cast(floor({year} / {float(n)}D) * {n} as int), 1, 1)"))


def label_sequence(first_label: str, last_label: str, frequency: str) -> Column:
    """All labels from the first to the last one, as an array."""
    n, unit = parse_frequency(frequency)
    if unit in _FIXED_US:
        us = n * _FIXED_US[unit]
        return F.expr(f"transform(sequence(0L, timestampdiff(MICROSECOND, {first_label}, {last_label}), {us}L), x -> timestampadd(MICROSECOND, x, {first_label}))")
    months = {"ME": n, "MS": n, "QE": 3 * n, "QS": 3 * n, "YE": 12 * n, "YS": 12 * n}
    if unit == "W":
        return F.expr(f"transform(sequence(0, datediff(cast({last_label} as date), cast({first_label} as date)), {7 * n}), x -> cast(date_add(cast({first_label} as date), x) as timestamp_ntz))")
    step = months[unit]
    count = f"((year({last_label}) - year({first_label})) * 12 + month({last_label}) - month({first_label}))"
    begin = f"cast(date_trunc('month', {first_label}) as date)"
    each = f"add_months({begin}, x)"
    each = f"last_day({each})" if unit.endswith("E") else each
    return F.expr(f"transform(sequence(0, cast({count} as int), {step}), x -> cast({each} as timestamp_ntz))")


def aggregate_of(operator: Any, value: str) -> Column:
    """A built-in aggregate, or a function of an array (NaN-free) as one in Python, of which a group is one bin of one cell."""
    if callable(operator) and not isinstance(operator, MethodType):

        @F.pandas_udf("double")
        def own(v: pd.Series) -> float:
            held = v.dropna().to_numpy()
            return float(operator(held)) if len(held) else float("nan")

        return F.nanvl(own(value), F.lit(None))
    method = MethodType(operator) if not isinstance(operator, MethodType) else operator
    if method not in AGGREGATES:
        raise NotImplementedError(f"no resampling by {operator!r}")
    return AGGREGATES[method](value)


def resample(df: DataFrame, time: str, dims: list[str], value: str, operator: str | MethodType, frequency: str, first: pd.Timestamp, last: pd.Timestamp, gaps: bool = True, empty_sum: float | None = None) -> DataFrame:
    """One row for each bin and cell (``dims`` without ``time``): the aggregate of its values that aren't null.

    With ``gaps`` every cell has all bins from that of ``first`` to that of ``last``, the ends of the
    time axis; a bin without values is null, or ``empty_sum`` for sums. The gaps are unfolded from the
    neighbouring bins of each cell, so the aggregate is computed once. A cell holds a row for each bin
    at most; a field without other dimensions is cut into chunks of bins.
    """
    others = [d for d in dims if d != time]
    out = df.withColumn("__bin", bin_label(time, frequency, first)).groupBy("__bin", *others).agg(aggregate_of(operator, value).alias(value))
    if gaps:
        ends = f"TIMESTAMP_NTZ '{first}'", f"TIMESTAMP_NTZ '{last}'"
        low, high = (bin_label(e, frequency, first) for e in ends)
        along = Window.partitionBy(*others).orderBy("__bin")
        if others:
            near = out.withColumns({"__next": F.lead("__bin").over(along), "__start": F.lag("__bin").over(along).isNull()})
        else:
            chunked = out.withColumn("__chunk", F.year("__bin"))
            near = with_next(chunked, chunked, [], "__chunk", "__bin", "__next").withColumn("__start", F.col("__bin") == low)
            starts = df.sparkSession.range(1).select(low.alias("__bin"), F.lit(None).cast("double").alias(value))
            near = near.unionByName(starts.join(out.agg(F.min("__bin").alias("__next")).where(F.col("__next") > low)).withColumn("__start", F.lit(True)), allowMissingColumns=True).where("__bin is not null")
        near = near.withColumns({"__from": F.when(F.col("__start"), low).otherwise(F.col("__bin")), "__to": F.coalesce("__next", high)})
        labels = F.filter(label_sequence("__from", "__to", frequency), lambda x: F.col("__next").isNull() | (x < F.col("__next")))
        out = near.select(*others, "__bin", value, F.explode(labels).alias("__label")).select(
            F.col("__label").alias("__bin"), *others, F.when(F.col("__label") == F.col("__bin"), F.col(value)).alias(value))
    if empty_sum is not None and not (callable(operator) and not isinstance(operator, MethodType)) and MethodType(operator if not isinstance(operator, MethodType) else operator.value[0]) is MethodType.SUM:
        out = out.withColumn(value, F.coalesce(value, F.lit(float(empty_sum))))
    return out.select(F.col("__bin").alias(time), *others, value)


def bins_of(times: np.ndarray, frequency: str) -> np.ndarray:
    """The labels of all bins of a time coordinate on the driver, gaps included."""
    n, unit = parse_frequency(frequency)
    t = pd.DatetimeIndex(times).sort_values()
    code = f"{n}{ {'min': 'min', 'us': 'us', 'ms': 'ms', 's': 's', 'h': 'h', 'd': 'D'}.get(unit, unit) }"
    if unit in _FIXED_US:
        width, origin = n * _FIXED_US[unit], t[0].normalize()
        index = ((t - origin) // pd.Timedelta(width, "us")).astype("int64")
        labels = origin + pd.to_timedelta(np.arange(index.min(), index.max() + 1) * width, "us")
    else:
        labels = pd.Series(1, index=t).resample(code).sum().index
    return labels.to_numpy().astype("datetime64[us]")

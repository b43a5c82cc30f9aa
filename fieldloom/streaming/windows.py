"""Resampling of a stream of readings in fixed bins, with late data up to a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.operators.resample import _FIXED_US, aggregate_of, parse_frequency


def resample_stream(readings: DataFrame, time: str, keys: list[str], value: str, operator: str, frequency: str, late: str = "1 hour") -> DataFrame:
    """Tumbling bins of a (streaming or batch) frame: keys, the bin's start and the aggregate; calendar bins aren't tumbling."""
    n, unit = parse_frequency(frequency)
    if unit not in _FIXED_US:
        raise ValueError("a stream is resampled in bins of a fixed width")
    width = f"{n * _FIXED_US[unit]} microseconds"
    stamped = readings.withColumn("__t", F.col(time).cast("timestamp")).withWatermark("__t", late)
    out = stamped.groupBy(F.window("__t", width), *keys).agg(aggregate_of(operator, value).alias(value))
    return out.select(*keys, F.col("window.start").alias(time), value)

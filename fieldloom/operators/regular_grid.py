"""Irregular readings onto regular periods, by intervals.

Each reading is a step of the series: it holds from its own time up to the next reading, at most
for ``hold`` periods. The steps are intersected with the periods of the grid; a period gets the
time-weighted mean of the steps in it, the fraction of it that they cover, the number of its own
readings, and a mark if it has none.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from fieldloom.meta.cell_methods import time_interval_us
from fieldloom.plans.ordered import with_next
from fieldloom.plans.scale import broadcast_if_small

#: Periods in one chunk of a series: what one task sorts at least together.
CHUNK_PERIODS = 1024
#: Periods that one row unfolds to at once.
UNFOLD = 4096


@F.pandas_udf(LongType())
def _time_interval(cell_methods: pd.Series) -> pd.Series:
    known: dict[object, int | None] = {}
    return pd.Series([known[t] if t in known else known.setdefault(t, time_interval_us(t)) for t in (x if isinstance(x, str) else None for x in cell_methods)], dtype="Int64")


def epoch_us(column: str) -> Column:
    """Microseconds since 1970 of a timestamp without zone, whatever the session's zone is."""
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', cast({column} as timestamp_ntz))")


def series_periods(fields: DataFrame) -> DataFrame:
    """series_id, interval_us, fill of the series whose ``cell_methods`` states an interval for time."""
    return (
        fields.where(F.col("cell_methods").contains("interval"))
        .select("series_id", _time_interval("cell_methods").alias("interval_us"), F.get_json_object("field_encoding", "$._FillValue").cast("double").alias("fill"))
        .where(F.col("interval_us").isNotNull() & F.col("series_id").isNotNull())
        .dropDuplicates(["series_id"])
    )


def usable_readings(readings: DataFrame, fields: DataFrame) -> DataFrame:
    """series_id, interval_us, t, v of the readings that count: not null, not NaN, not the series' fill value."""
    periods = broadcast_if_small(series_periods(fields))
    return (
        readings.select("series_id", "obs_time", "data_value")
        .where(F.col("data_value").isNotNull() & ~F.isnan("data_value") & F.col("obs_time").isNotNull())
        .join(periods, "series_id")
        .where(F.col("fill").isNull() | (F.col("data_value") != F.col("fill")))
        .select("series_id", "interval_us", epoch_us("obs_time").alias("t"), F.col("data_value").alias("v"))
    )


def _sql_period(t: str) -> str:
    return f"(({t} - pmod({t}, interval_us)) div interval_us)"


def _period(t: str) -> Column:
    return F.expr(_sql_period(t))


def regular_grid(readings: DataFrame, fields: DataFrame, hold: float = 1.0, chunk_periods: int = CHUNK_PERIODS) -> DataFrame:
    """The series on their regular periods.

    Returns series_id, period_us (start), n_readings (distinct times), coverage (fraction of the
    period that steps cover), mean_value (time-weighted; null where nothing covers it) and missing
    (no usable reading in the period), for all periods from that of the first to that of the last
    usable reading. Periods are whole multiples of the interval from midnight of 1970-01-01.

    Of readings at one instant the largest value stands; copies count once. Series without an
    interval or without a usable reading, and rows with a null time, have no periods. Readings of
    unknown series have none either. Other columns are ignored.
    """
    if hold <= 0:
        raise ValueError("hold must be positive")
    chunk = F.expr(f"({_sql_period('t')} - pmod({_sql_period('t')}, {int(chunk_periods)}L)) div {int(chunk_periods)}L")
    usable = usable_readings(readings, fields).withColumn("chunk", chunk)
    instants = usable.groupBy("series_id", "interval_us", "chunk", "t").agg(F.max("v").alias("v"))
    steps = with_next(instants, usable, ["series_id", "interval_us"], "chunk", "t", "next_t")
    lasting = F.col("t") + F.greatest(F.lit(1), F.round(F.col("interval_us") * float(hold)).cast("long"))
    steps = steps.select(
        "series_id", "interval_us", "t", "v",
        F.least(F.coalesce("next_t", lasting), lasting).alias("until"),
        _period("t").alias("p0"),
        # up to the period of the next reading, which this step may reach into; its own for the last
        F.coalesce(F.expr(_sql_period("(next_t - 1)")), _period("t")).alias("p1"),
    )
    far = steps.withColumn("b", F.explode(F.sequence("p0", "p1", F.lit(UNFOLD))))
    cells = far.withColumn("p", F.explode(F.sequence("b", F.least(F.col("b") + F.lit(UNFOLD - 1), F.col("p1")))))
    begin = F.col("p") * F.col("interval_us")
    held = F.greatest(F.lit(0), F.least("until", begin + F.col("interval_us")) - F.greatest("t", begin))
    cells = cells.select("series_id", "interval_us", "p", (F.col("p") == F.col("p0")).cast("long").alias("own"), held.alias("held"), (held * F.col("v")).alias("weighted"))
    grid = cells.groupBy("series_id", "interval_us", "p").agg(F.sum("own").alias("n_readings"), F.sum("held").alias("held"), F.sum("weighted").alias("weighted"))
    return grid.select(
        "series_id",
        (F.col("p") * F.col("interval_us")).alias("period_us"),
        "n_readings",
        (F.col("held") / F.col("interval_us")).alias("coverage"),
        F.when(F.col("held") > 0, F.col("weighted") / F.col("held")).alias("mean_value"),
        (F.col("n_readings") == 0).alias("missing"),
    )


def missing_periods(readings: DataFrame, fields: DataFrame) -> DataFrame:
    """series_id, period_us of the marked periods of :func:`regular_grid`."""
    return regular_grid(readings, fields).where("missing").select("series_id", "period_us")

"""Label selection: resolved on the driver's coordinates, shipped as plain predicates that Parquet takes.

Every indexer becomes the positions it keeps of a small label array; the positions become a range
(``between``) or an ``IN`` list of labels on the dimension's column.
"""

from __future__ import annotations

import re
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from fieldloom.meta.axis import AxisType, LongitudeConvention
from fieldloom.meta.coordinate import Coordinate

#: Labels up to which a choice that isn't a range becomes an IN list in one predicate.
IN_LIST = 2000


class EmptyDataError(ValueError):
    """A selection of nothing."""


def label(value: Any) -> Column:
    """A literal of one label."""
    if isinstance(value, np.datetime64):
        return F.lit(str(value.astype("datetime64[us]")).replace("T", " ")).cast("timestamp_ntz")
    return F.lit(value.item() if isinstance(value, np.generic) else value)


def predicate(column: str, labels: np.ndarray, keep: np.ndarray) -> Column | None:
    """The rows whose label is kept; None if all are."""
    keep = np.unique(keep)
    if len(keep) == len(labels):
        return None
    if not len(keep):
        return F.lit(False)
    order = np.argsort(labels, kind="stable")
    rank = np.empty(len(labels), dtype=np.int64)
    rank[order] = np.arange(len(labels))
    runs = np.sort(rank[keep])
    breaks = np.flatnonzero(np.diff(runs) > 1)
    starts, ends = np.concatenate([[0], breaks + 1]), np.concatenate([breaks, [len(runs) - 1]])
    if len(starts) > 8 and len(keep) <= IN_LIST:
        return F.col(column).isin([label(labels[k]) for k in keep])
    out = None
    for a, b in zip(starts, ends):
        low, high = labels[order[runs[a]]], labels[order[runs[b]]]
        part = (F.col(column) == label(low)) if a == b else F.col(column).between(label(low), label(high))
        out = part if out is None else out | part
    return out


_PARTIAL = re.compile(r"^\d{4}(-\d{1,2}(-\d{1,2}([T ]\d{1,2}(:\d{1,2}(:\d{1,2}(\.\d+)?)?)?)?)?)?$")


def period_of(text: str) -> tuple[np.datetime64, np.datetime64] | None:
    """[start, end) of a partial date: a year, month, day, hour, minute or second."""
    if not _PARTIAL.match(text.strip()):
        return None
    for unit, freq in (("Y", 4), ("M", 7), ("D", 10), ("h", 13), ("m", 16), ("s", 19)):
        if len(text.strip()) <= freq:
            start = pd.Timestamp(text if unit != "h" else f"{text.strip()}:00").to_datetime64().astype(f"datetime64[{unit}]")
            return start.astype("datetime64[us]"), (start + 1).astype("datetime64[us]")
    at = pd.Timestamp(text).to_datetime64().astype("datetime64[us]")
    return at, at + np.timedelta64(1, "us")


def _point(coord: Coordinate, value: Any) -> Any:
    return pd.Timestamp(value).to_datetime64().astype("datetime64[us]") if coord.values.dtype.kind == "M" else value


def _slice(coord: Coordinate, s: slice) -> np.ndarray:
    """Positions of an inclusive label slice in the coordinate's own order."""
    v = coord.values
    first, last = s.start, s.stop
    low, high = (last, first) if coord.descending else (first, last)
    keep = np.ones(len(v), dtype=bool)
    for value, is_low in ((low, True), (high, False)):
        if value is None:
            continue
        period = period_of(value) if v.dtype.kind == "M" and isinstance(value, str) else None
        if is_low:
            keep &= v >= (period[0] if period else _point(coord, value))
        else:
            keep &= v < period[1] if period else v <= _point(coord, value)
    at = np.flatnonzero(keep)
    return at[:: s.step] if s.step else at


def nearest(coord: Coordinate, value: Any, tolerance: Any = None) -> int:
    """Position of the nearest label; of two equally near ones the larger. -1 beyond the tolerance."""
    v, at = coord.values, _point(coord, value)
    gap = np.abs(v - at)
    best = gap.min()
    if tolerance is not None and best > (pd.Timedelta(tolerance).to_timedelta64() if v.dtype.kind == "M" else tolerance):
        return -1
    ties = np.flatnonzero(gap == best)
    return int(ties[np.argmax(v[ties])])


def _found(coord: Coordinate, value: Any, method: str | None, tolerance: Any) -> np.ndarray | None:
    v = coord.values
    if method == "nearest":
        k = nearest(coord, value, tolerance)
        return None if k < 0 else np.array([k])
    if v.dtype.kind == "M" and isinstance(value, str) and method is None:
        period = period_of(value)
        if period and len(value.strip()) < 19:
            at = np.flatnonzero((v >= period[0]) & (v < period[1]))
            return at if len(at) else None
    at = _point(coord, value)
    if method in ("pad", "ffill"):
        below = np.flatnonzero(v <= at)
        return np.array([below[np.argmax(v[below])]]) if len(below) else None
    if method in ("backfill", "bfill"):
        above = np.flatnonzero(v >= at)
        return np.array([above[np.argmin(v[above])]]) if len(above) else None
    equal = np.flatnonzero(v == at)
    return equal if len(equal) else None


def time_combo(coord: Coordinate, parts: dict[str, Any]) -> np.ndarray:
    """Positions where each given component (year, month, day, hour) is one of its values."""
    t = pd.DatetimeIndex(coord.values)
    keep = np.ones(len(t), dtype=bool)
    for name, wanted in parts.items():
        if name not in ("year", "month", "day", "hour"):
            raise ValueError(f"unknown time component {name!r}")
        keep &= np.isin(getattr(t, name), [int(w) for w in np.atleast_1d(wanted)])
    at = np.flatnonzero(keep)
    if not len(at):
        raise EmptyDataError("no time has these components")
    return at


def to_convention(value: Any, coord: Coordinate) -> Any:
    """A longitude of a query in the convention of the data."""
    if not isinstance(value, (int, float, np.number)):
        return value
    if coord.convention is LongitudeConvention.POSITIVE_WEST:
        return value % 360.0 if value < 0 else value
    return (value + 180.0) % 360.0 - 180.0 if value > 180 else value


def positions(coord: Coordinate, indexer: Any, method: str | None = None, tolerance: Any = None) -> tuple[np.ndarray | None, bool]:
    """(kept positions, is scalar); None if a label is missing."""
    if isinstance(indexer, slice):
        return _slice(coord, indexer), False
    if coord.axis is AxisType.TIME and isinstance(indexer, dict):
        return time_combo(coord, indexer), False
    if isinstance(indexer, (list, tuple, np.ndarray, pd.Index)) and np.ndim(indexer):
        found = [_found(coord, x, method, tolerance) for x in indexer]
        if any(f is None for f in found):
            return None, False
        return np.concatenate(found) if found else np.empty(0, np.int64), False
    found = _found(coord, indexer, method, tolerance)
    return found, found is not None and len(found) == 1


def box_positions(coord: Coordinate, low: float | None, high: float | None) -> np.ndarray:
    v = coord.values
    keep = np.ones(v.shape, dtype=bool)
    if low is not None:
        keep &= v >= low
    if high is not None:
        keep &= v <= high
    return np.flatnonzero(keep)


def longitude_ranges(coord: Coordinate, west: float | None, east: float | None, wrap: bool = False) -> list[tuple[float | None, float | None]]:
    """One or two label ranges, in the data's convention, of a box in the query's convention."""
    v = coord.values
    if wrap and west is not None and east is not None and west > east:
        return [*longitude_ranges(coord, west, 360.0 if west > 180 or np.nanmax(v) > 180 else 180.0), *longitude_ranges(coord, 0.0 if np.nanmin(v) >= 0 and east >= 0 else -180.0, east)]
    asks_negative = any(x is not None and x < 0 for x in (west, east))
    asks_large = any(x is not None and x > 180 for x in (west, east))
    if coord.convention is LongitudeConvention.POSITIVE_WEST and asks_negative:
        low, high = (-180.0 if west is None else west), (180.0 if east is None else east)
        if low > high:
            return []
        if high < 0:
            return [(low + 360.0, high + 360.0)]
        return [(max(low, -180.0) + 360.0, 360.0), (0.0, high)]
    if coord.convention is LongitudeConvention.NEGATIVE_WEST and asks_large:
        low, high = (0.0 if west is None else west), (360.0 if east is None else east)
        if low > high:
            return []
        if low > 180:
            return [(low - 360.0, high - 360.0)]
        return [(low, 180.0), (-180.0, min(high, 360.0) - 360.0)]
    return [(west, east)]

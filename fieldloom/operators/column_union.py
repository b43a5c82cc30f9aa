"""Frames whose columns drift: renames by value sketches, types and names, and all rows in one table.

The versions of a table come as frames in order. Each column is profiled in one aggregate: its kind,
its share of nulls, quantiles of numbers or lengths, and a min-hash of its values. Columns that went
and columns that came are the two sides of a bipartite graph, weighted by likeness of values, types
and names; what an assignment matches is renamed, and the frames are cast and united.
"""

from __future__ import annotations

import functools
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldloom.functions.matching import assign, name_similarity

#: Quantiles of a sketch, and hashes of its min-hash.
QUANTILES, HASHES = tuple(i / 10 for i in range(11)), 16
#: Likeness below which a column that went and one that came aren't the same.
LEAST_LIKENESS = 0.55
_NUMBERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)
_TIMES = (T.DateType, T.TimestampType, T.TimestampNTZType)


def kind_of(t: T.DataType) -> str:
    """number, time, flag, text or nested."""
    return "number" if isinstance(t, _NUMBERS) else "time" if isinstance(t, _TIMES) else "flag" if isinstance(t, T.BooleanType) else "text" if isinstance(t, T.StringType) else "nested"


@dataclass(frozen=True)
class Sketch:
    """What a column holds: at most ``len(QUANTILES)`` + ``HASHES`` numbers, whatever its size."""

    kind: str
    type: str
    nulls: float = 1.0
    quantiles: tuple[float, ...] = ()
    hashes: tuple[int, ...] = field(default=(), repr=False)

    def likeness(self, other: Sketch) -> float:
        """0 to 1 by values: how far the quantiles lie apart and how many values are the same; 0.5 where either has none."""
        if self.kind != other.kind:
            return 0.0
        if not self.quantiles or not other.quantiles:
            return 0.5
        a, b = np.array(self.quantiles), np.array(other.quantiles)
        width = max(a[-1] - a[0], b[-1] - b[0])
        if self.kind == "time":  # times go on from version to version; what stays is how they are spread
            a, b = a - a[0], b - b[0]
        near = 1.0 - min(1.0, float(np.abs(a - b).mean() / width)) if width > 0 else float(np.allclose(a, b))
        common = float(np.mean(np.array(self.hashes) == np.array(other.hashes)))
        return (near if self.kind == "time" else 0.4 * near + 0.6 * common if self.kind == "text" else 0.7 * near + 0.3 * common) * (1.0 - 0.3 * abs(self.nulls - other.nulls))


def _measure(name: str, kind: str) -> Column:
    c = F.col(f"`{name}`")
    if kind == "number":
        value = c.cast("double")
        return F.when(~F.isnan(value), value)
    if kind == "time":
        return F.expr(f"unix_micros(cast(`{name}` as timestamp))").cast("double")
    return F.length(c).cast("double") if kind == "text" else c.cast("double") if kind == "flag" else F.lit(None).cast("double")


def sketches(df: DataFrame) -> dict[str, Sketch]:
    """A sketch of each column, by one aggregate with a partial step; of nested columns the type only."""
    kinds = {f.name: kind_of(f.dataType) for f in df.schema}
    wanted = []
    for n, (name, kind) in enumerate(kinds.items()):
        v = _measure(name, kind)
        # numbers of different widths hash alike
        hashed = v if kind in ("number", "time", "flag") else F.col(f"`{name}`") if kind == "text" else F.lit(None).cast("string")
        wanted += [F.count(v).alias(f"n{n}"), F.percentile_approx(v, list(QUANTILES), 1000).alias(f"q{n}"), *[F.min(F.when(hashed.isNotNull(), F.xxhash64(hashed, F.lit(k)))).alias(f"h{n}_{k}") for k in range(HASHES)]]
    row = df.agg(F.count(F.lit(1)).alias("rows"), *wanted).first()
    out = {}
    for n, f in enumerate(df.schema):
        q = row[f"q{n}"]
        hashes = tuple(row[f"h{n}_{k}"] for k in range(HASHES)) if q else ()
        out[f.name] = Sketch(kinds[f.name], f.dataType.simpleString(), 1.0 - row[f"n{n}"] / row["rows"] if row["rows"] else 1.0, tuple(q or ()), hashes)
    return out


def likeness(a: str, left: Sketch, b: str, right: Sketch) -> float:
    """0 where the kinds differ or both together are too unlike; else by values, names and types."""
    if left.kind != right.kind or (left.kind == "nested" and left.type != right.type):
        return 0.0
    total = 0.65 * left.likeness(right) + 0.25 * name_similarity(a, b) + 0.1 * (left.type == right.type)
    return total if total >= LEAST_LIKENESS else 0.0


def match_columns(before: dict[str, Sketch], after: dict[str, Sketch]) -> dict[str, str]:
    """New name -> old name of the columns that were renamed."""
    gone, come = [n for n in before if n not in after], [n for n in after if n not in before]
    if not gone or not come:
        return {}
    match = assign([[likeness(a, before[a], b, after[b]) for b in come] for a in gone])
    return {come[j]: a for a, j in zip(gone, match) if j >= 0}


def widest(types: Sequence[T.DataType]) -> T.DataType:
    """A type that holds all: equal ones, the wider of two numbers (whole and fractional ones meet in double), a timestamp of times, else text."""
    first = types[0]
    if all(t == first for t in types):
        return first
    kinds = {kind_of(t) for t in types}
    if kinds == {"number"}:
        whole = [T.ByteType, T.ShortType, T.IntegerType, T.LongType]
        if all(type(t) in whole for t in types):
            return max(types, key=lambda t: whole.index(type(t)))
        return T.DoubleType()
    if kinds == {"time"}:
        return T.TimestampType() if any(isinstance(t, T.TimestampType) for t in types) else T.TimestampNTZType()
    return T.StringType()


def unite(versions: Sequence[tuple[str, DataFrame]]) -> tuple[DataFrame, list[tuple[str, str, str, str | None, str | None]]]:
    """All rows of all versions in one table, and each change.

    Returns (frame, changes): the frame has ``version`` and every column by its first name, null where
    a version doesn't have it, in a type that holds all of its types; a change is (version, column,
    kind, old name, old type) with kind added, removed, renamed or retyped. A version without rows has
    no values to be told by, so its columns are matched by name and type alone. A later column that
    takes the name of an earlier one that was renamed gets the version's name as a suffix. ValueError
    without versions, or where a column is named ``version``.
    """
    if not versions:
        raise ValueError("no versions")
    names: list[dict[str, str]] = []  # of each version: column -> united name
    types: dict[str, list[T.DataType]] = {}
    changes: list[tuple[str, str, str, str | None, str | None]] = []
    before: dict[str, Sketch] = {}
    for label, df in versions:
        if "version" in df.columns:
            raise ValueError("a column is named version")
        after = sketches(df)
        held: dict[str, str] = {}
        if names:
            old = names[-1]
            renamed = match_columns(before, after)
            for name in after:
                source = name if name in before else renamed.get(name)
                if source is not None:
                    held[name] = old[source]
                    if source != name:
                        changes.append((label, name, "renamed", source, None))
                    if before[source].type != after[name].type:
                        changes.append((label, name, "retyped", source if source != name else None, before[source].type))
                else:
                    changes.append((label, name, "added", None, None))
            changes += [(label, name, "removed", None, None) for name in before if name not in after and name not in renamed.values()]
        taken = set(held.values())
        for name in after:
            if name not in held:
                # a column that comes again is the one that went, if it has its kind
                back = name in types and name not in taken and kind_of(types[name][0]) == after[name].kind
                held[name] = name if back or name not in types else f"{name}_{label}"
                taken.add(held[name])
        for f in df.schema:
            types.setdefault(held[f.name], []).append(f.dataType)
        names.append(held)
        before = after
    final = {n: widest(ts) for n, ts in types.items()}
    parts = []
    for (label, df), held in zip(versions, names):
        back = {v: k for k, v in held.items()}
        parts.append(df.select(F.lit(label).alias("version"), *[(F.col(f"`{back[n]}`") if n in back else F.lit(None)).cast(t).alias(n) for n, t in final.items()]))
    return functools.reduce(DataFrame.unionByName, parts), changes

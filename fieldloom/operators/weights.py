"""Interpolation and regridding as joins with small weight tables.

A method on a regular grid is the product of two one-dimensional ones, so its weights are two tables
(target label, source label, weight), one for each axis, and applying them is two equi-joins with
small tables and one aggregate. Other methods have one table over both axes.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldloom.functions.kdtree import nearest_rows
from fieldloom.plans.scale import broadcast_if_small


def linear_weights(source: np.ndarray, target: np.ndarray) -> pd.DataFrame:
    """(target position, source label, weight) of linear interpolation; a null weight outside the labels."""
    order = np.argsort(source)
    s = source[order].astype(float)
    rows = []
    for k, t in enumerate(np.asarray(target, float)):
        if not s[0] <= t <= s[-1]:
            rows.append((k, s[0 if t < s[0] else -1], None))
            continue
        j = int(np.searchsorted(s, t, side="left"))
        if s[j] == t:
            rows.append((k, s[j], 1.0))
        else:
            w = (t - s[j - 1]) / (s[j] - s[j - 1])
            rows += [(k, s[j - 1], 1.0 - w), (k, s[j], w)]
    return pd.DataFrame(rows, columns=["t", "s", "w"])


def nearest_weights(source: np.ndarray, target: np.ndarray, inside: bool = True) -> pd.DataFrame:
    """The nearest label of each target, the larger of two; a null weight outside the labels if ``inside``."""
    s = np.sort(source.astype(float))
    rows = []
    for k, t in enumerate(np.asarray(target, float)):
        gap = np.abs(s - t)
        j = int(np.flatnonzero(gap == gap.min())[-1])
        rows.append((k, s[j], 1.0 if not inside or s[0] <= t <= s[-1] else None))
    return pd.DataFrame(rows, columns=["t", "s", "w"])


def overlap_weights(source: np.ndarray, source_bounds: np.ndarray, target_bounds: np.ndarray, spherical: bool, normed: bool) -> pd.DataFrame:
    """Overlap of cells as a share of the target cell (of its covered part if ``normed``); latitudes by their sine."""
    measure = (lambda x: np.sin(np.radians(x))) if spherical else (lambda x: x)
    sb, tb = np.sort(source_bounds, axis=1), np.sort(target_bounds, axis=1)
    rows = []
    for k, (low, high) in enumerate(tb):
        part = measure(np.minimum(sb[:, 1], high)) - measure(np.maximum(sb[:, 0], low))
        hit = np.flatnonzero(part > 1e-12)
        if not len(hit):
            rows.append((k, float(source[0]), None))
            continue
        whole = part[hit].sum() if normed else measure(high) - measure(low)
        rows += [(k, float(source[i]), float(part[i] / whole)) for i in hit]
    return pd.DataFrame(rows, columns=["t", "s", "w"])


def corner_nodes(lat: np.ndarray, lon: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(n + 1, m + 1) corners of cells of which only the centres are known: means of four neighbours, carried on by half a cell at the rim."""

    def widened(v: np.ndarray) -> np.ndarray:
        v = np.concatenate([2 * v[:1] - v[1:2], v, 2 * v[-1:] - v[-2:-1]])
        v = np.concatenate([2 * v[:, :1] - v[:, 1:2], v, 2 * v[:, -1:] - v[:, -2:-1]], axis=1)
        return (v[:-1, :-1] + v[1:, :-1] + v[:-1, 1:] + v[1:, 1:]) / 4

    if min(lat.shape) < 2:
        raise ValueError("cells without bounds need two centres along each dimension")
    lon = np.degrees(np.unwrap(np.unwrap(np.radians(lon), axis=0), axis=1))
    return np.clip(widened(lat), -90.0, 90.0), widened(lon)


def _below(px: np.ndarray, py: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Signed area of polygons (k, corners) left of x and below y: the line integral of min(X, x) dY over what lies below y."""
    x0, y0 = px, py
    dx, dy = np.roll(px, -1, axis=1) - px, np.roll(py, -1, axis=1) - py
    x, y = x[:, None], y[:, None]
    with np.errstate(divide="ignore", invalid="ignore"):
        at_y = np.clip(np.nan_to_num((y - y0) / dy), 0.0, 1.0)
        at_x = np.where(dx != 0, (x - x0) / dx, np.where(x0 <= x, np.inf, -np.inf))
    a, b = np.where(dy < 0, at_y, 0.0), np.where(dy > 0, at_y, 1.0)
    linear = lambda s, e: np.where(e > s, x0 * (e - s) + dx * (e * e - s * s) / 2, 0.0)
    turn = np.clip(at_x, a, b)
    rising = dx >= 0
    inside = np.where(rising, linear(a, turn), linear(turn, b))
    beyond = x * np.where(rising, b - turn, turn - a)
    return np.where(dy != 0, dy * (inside + beyond), 0.0).sum(axis=1)


def cell_overlaps(lat_corners: np.ndarray, lon_corners: np.ndarray, lat_bounds: np.ndarray, lon_bounds: np.ndarray, normed: bool) -> pd.DataFrame:
    """(target position, source position, weight): overlap of four-cornered cells with the cells of a regular grid.

    Corners are (cells, 4), in degrees. Areas are taken on the equal-area cylinder (longitude and sine of
    latitude), with straight edges there; a cell around a pole isn't one. Weights are shares of the
    target's area, or of its covered part if ``normed``; a target that nothing covers has a null weight.
    """
    centre = lon_corners[:, :1]
    px, py = centre + np.mod(lon_corners - centre + 180.0, 360.0) - 180.0, np.sin(np.radians(lat_corners))
    low_y, high_y = np.sin(np.radians(np.sort(lat_bounds, axis=1))).T
    low_x, high_x = np.sort(lon_bounds, axis=1).T
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    order = np.argsort(low_y, kind="stable")
    for shift in (-360.0, 0.0, 360.0):
        moved = px + shift
        left, right, bottom, top = moved.min(axis=1), moved.max(axis=1), py.min(axis=1), py.max(axis=1)
        for i in order:
            rows = np.flatnonzero((top > low_y[i]) & (bottom < high_y[i]) & (right > low_x.min()) & (left < high_x.max()))
            if not len(rows):
                continue
            by_left = np.argsort(left[rows], kind="stable")
            rows = rows[by_left]
            for j in range(len(low_x)):
                k = rows[: np.searchsorted(left[rows], high_x[j])]
                k = k[right[k] > low_x[j]]
                if not len(k):
                    continue
                part = lambda x, y, k=k: _below(moved[k], py[k], np.full(len(k), x), np.full(len(k), y))
                area = np.abs(part(high_x[j], high_y[i]) - part(low_x[j], high_y[i]) - part(high_x[j], low_y[i]) + part(low_x[j], low_y[i]))
                hit = area > 1e-12
                if hit.any():
                    found.append((np.full(int(hit.sum()), i * len(low_x) + j), k[hit], area[hit]))
    t, s, area = (np.concatenate([f[n] for f in found]) if found else np.empty(0) for n in range(3))
    table = pd.DataFrame({"t": t.astype(np.int64), "s": s.astype(np.int64), "w": area})
    whole = ((high_x - low_x)[None, :] * (high_y - low_y)[:, None]).ravel()
    table["w"] /= table.groupby("t")["w"].transform("sum") if normed else whole[table["t"].to_numpy()]
    table = table.groupby(["t", "s"], as_index=False)["w"].sum()
    bare = np.setdiff1d(np.arange(len(whole)), table["t"].to_numpy())
    return pd.concat([table, pd.DataFrame({"t": bare, "s": np.zeros(len(bare), np.int64), "w": np.full(len(bare), np.nan)})], ignore_index=True)


def nearest_cells(lat: np.ndarray, lon: np.ndarray, tlat: np.ndarray, tlon: np.ndarray) -> np.ndarray:
    """Index of the cell nearest to each target on the sphere, the first of equally near ones."""
    unit = lambda a, o: np.stack([np.cos(np.radians(a)) * np.cos(np.radians(o)), np.cos(np.radians(a)) * np.sin(np.radians(o)), np.sin(np.radians(a))], axis=-1)
    return nearest_rows(unit(lat.ravel(), lon.ravel()), unit(tlat.ravel(), tlon.ravel()))


def patch_weights(slat: np.ndarray, slon: np.ndarray, tlat: np.ndarray, tlon: np.ndarray) -> pd.DataFrame:
    """(target latitude position, longitude position, source latitude, source longitude, weight) of patch recovery.

    A quadratic is fitted to the 3 x 3 labels around each corner of the source cell; the target takes
    the corners' fits, blended bilinearly. The fits are linear in the values, so all of it is a weight.
    """
    slat, slon = np.sort(slat.astype(float)), np.sort(slon.astype(float))

    def window(n: int, k: int) -> np.ndarray:
        a = min(max(k - 1, 0), max(n - 3, 0))
        return np.arange(a, min(a + 3, n))

    rows = []
    for i, la in enumerate(tlat):
        for j, lo in enumerate(tlon):
            if not (slat[0] <= la <= slat[-1] and slon[0] <= lo <= slon[-1]):
                rows.append((i, j, slat[0], slon[0], None))
                continue
            a = min(max(int(np.searchsorted(slat, la, side="right")) - 1, 0), len(slat) - 2)
            b = min(max(int(np.searchsorted(slon, lo, side="right")) - 1, 0), len(slon) - 2)
            u, v = (la - slat[a]) / (slat[a + 1] - slat[a]), (lo - slon[b]) / (slon[b + 1] - slon[b])
            sums: dict[tuple[int, int], float] = {}
            for p, wp in ((a, 1 - u), (a + 1, u)):
                for q, wq in ((b, 1 - v), (b + 1, v)):
                    if wp * wq == 0:
                        continue
                    yy, xx = np.meshgrid(window(len(slat), p), window(len(slon), q), indexing="ij")
                    dy, dx = slat[yy.ravel()] - slat[p], slon[xx.ravel()] - slon[q]
                    basis = lambda y, x: np.stack([np.ones_like(x), x, y, x * x, x * y, y * y], axis=-1)
                    at = basis(np.array([la - slat[p]]), np.array([lo - slon[q]]))
                    w = (at @ np.linalg.pinv(basis(dy, dx))).ravel() * wp * wq
                    for y, x, one in zip(yy.ravel(), xx.ravel(), w):
                        sums[int(y), int(x)] = sums.get((int(y), int(x)), 0.0) + float(one)
            rows += [(i, j, slat[y], slon[x], w) for (y, x), w in sums.items() if abs(w) > 1e-15]
    return pd.DataFrame(rows, columns=["ti", "tj", "sy", "sx", "w"])


def small_frame(spark: SparkSession, pdf: pd.DataFrame, types: str) -> DataFrame:
    """A table of weights by way of Arrow; NaN becomes null."""
    held = pa.Table.from_arrays([pa.array(pdf[c].to_numpy(), from_pandas=True) for c in pdf], names=[f"c{i}" for i in range(pdf.shape[1])])
    return spark.createDataFrame(held).select(*[F.col(f"c{i}").cast(t.dataType).alias(t.name) for i, t in enumerate(T._parse_datatype_string(types))])


def _small(spark: SparkSession, pdf: pd.DataFrame, types: str) -> DataFrame:
    return broadcast_if_small(small_frame(spark, pdf, types))


def apply_separable(df: DataFrame, value: str, dims: list[str], y: str, x: str, wy: pd.DataFrame, wx: pd.DataFrame, labels_y: np.ndarray, labels_x: np.ndarray, poison: bool = True) -> DataFrame:
    """Weighted sums along both axes; a target that has a missing source, or none, is null.

    The first join and aggregate run along latitude, the second along longitude, so a value is
    multiplied by its weights of one axis at a time.
    """
    spark = df.sparkSession
    others = [d for d in dims if d not in (y, x)]
    for axis, weights, labels, rest in ((y, wy, labels_y, [*others, x]), (x, wx, labels_x, [*others, y])):
        table = weights.assign(t=labels[weights["t"].to_numpy()].astype(float), n=weights.groupby("t")["s"].transform("size").astype(int))
        small = _small(spark, table[["t", "s", "w", "n"]], "__t double, __s double, __w double, __n long")
        joined = df.join(small, df[axis] == F.col("__s")).drop(axis)
        total = F.sum(F.col(value) * F.col("__w"))
        if poison:
            total = F.when(F.count(F.col(value) * F.col("__w")) == F.max("__n"), total)
        df = joined.groupBy(*rest, F.col("__t").alias(axis)).agg(total.alias(value))
    return df.select(*dims, value)


def apply_table(df: DataFrame, value: str, dims: list[str], y: str, x: str, weights: pd.DataFrame, labels_y: np.ndarray, labels_x: np.ndarray) -> DataFrame:
    """The same for one weight table over both axes: columns ti, tj, sy, sx, w."""
    others = [d for d in dims if d not in (y, x)]
    n = weights.groupby(["ti", "tj"])["w"].transform("size").astype(int)
    table = pd.DataFrame({"ty": labels_y[weights["ti"].to_numpy()].astype(float), "tx": labels_x[weights["tj"].to_numpy()].astype(float), "sy": weights["sy"], "sx": weights["sx"], "w": weights["w"], "n": n})
    small = _small(df.sparkSession, table, "__ty double, __tx double, __sy double, __sx double, __w double, __n long")
    joined = df.join(small, (df[y] == F.col("__sy")) & (df[x] == F.col("__sx"))).drop(y, x)
    product = F.col(value) * F.col("__w")
    out = joined.groupBy(*others, F.col("__ty").alias(y), F.col("__tx").alias(x)).agg(F.when(F.count(product) == F.max("__n"), F.sum(product)).alias(value))
    return out.select(*dims, value)

"""Zarr version 2 folders: metadata on the driver, chunks on the executors."""

from __future__ import annotations

import itertools
import json
import os
import zlib
from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.plans.scale import broadcast_if_small
from fieldloom.sources.codecs import COMPRESSORS, FILTERS, decompress, undo_filters


def array_meta(path: str, name: str) -> tuple[dict[str, Any], dict[str, Any]]:
    """(.zarray, .zattrs) of one array."""
    with open(os.path.join(path, name, ".zarray")) as f:
        meta = json.load(f)
    if meta.get("compressor") and meta["compressor"].get("id") not in COMPRESSORS:
        raise NotImplementedError(f"{name}: compressor {meta['compressor'].get('id')!r}")
    if any(f.get("id") not in FILTERS for f in meta.get("filters") or []):
        raise NotImplementedError(f"{name}: filters {meta['filters']!r}")
    at = os.path.join(path, name, ".zattrs")
    attrs = json.load(open(at)) if os.path.exists(at) else {}  # noqa: SIM115
    return meta, attrs


def array_names(path: str) -> list[str]:
    return sorted(n for n in os.listdir(path) if os.path.exists(os.path.join(path, n, ".zarray")))


def read_chunk(path: str, name: str, meta: dict[str, Any], index: tuple[int, ...]) -> np.ndarray:
    """One chunk, cut to the array's shape; a chunk without a file holds fill values."""
    shape, chunks = meta["shape"], meta["chunks"]
    at = os.path.join(path, name, meta.get("dimension_separator", ".").join(map(str, index)) if index else "0")
    if os.path.exists(at):
        with open(at, "rb") as f:
            raw = f.read()
        block = undo_filters(decompress(raw, meta.get("compressor")), meta.get("filters"), meta["dtype"]).reshape(chunks, order=meta.get("order", "C"))
    else:
        fill = meta.get("fill_value")
        block = np.full(chunks, np.nan if fill in (None, "NaN") else fill, dtype=np.dtype(meta["dtype"]) if fill not in (None, "NaN") else "f8")
    return block[tuple(slice(0, min(c, s - i * c)) for i, c, s in zip(index, chunks, shape))]


def read_array(path: str, name: str) -> np.ndarray:
    """A whole array, for coordinates."""
    meta, _ = array_meta(path, name)
    if not meta["shape"]:
        return read_chunk(path, name, meta, ())
    out = np.empty(meta["shape"], dtype=meta["dtype"])
    for index in itertools.product(*(range(-(-s // c)) for s, c in zip(meta["shape"], meta["chunks"]))):
        block = read_chunk(path, name, meta, index)
        out[tuple(slice(i * c, i * c + n) for i, c, n in zip(index, meta["chunks"], block.shape))] = block
    return out


def scan(spark: SparkSession, path: str, name: str, labels: dict[str, np.ndarray], dims: tuple[str, ...], within: dict[str, tuple[Any, Any]] | None = None) -> DataFrame:
    """One variable in long form, a task for each chunk; only of chunks that have labels ``within`` the given ends of dimensions."""
    from fieldloom.sources.netcdf3 import decode

    meta, attrs = array_meta(path, name)
    touched = []
    for d, s, c in zip(dims, meta["shape"], meta["chunks"]):
        low, high = (within or {}).get(d, (None, None))
        touched.append([k for k in range(-(-s // c)) if low is None or ((labels[d][k * c:(k + 1) * c] >= low) & (labels[d][k * c:(k + 1) * c] <= high)).any()])
    index = list(itertools.product(*touched))
    if meta.get("fill_value") not in (None, "NaN"):
        attrs = {"_FillValue": meta["fill_value"], **attrs}
    kinds = {d: "timestamp_ntz" if labels[d].dtype.kind == "M" else "double" if labels[d].dtype.kind == "f" else "int" for d in dims}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for at in b["at"]:
                block = decode(read_chunk(path, name, meta, tuple(at)), attrs)
                out = {}
                for k, d in enumerate(dims):
                    start = at[k] * meta["chunks"][k]
                    part = labels[d][start:start + block.shape[k]]
                    out[d] = np.broadcast_to(part.reshape([-1 if i == k else 1 for i in range(len(dims))]), block.shape).ravel()
                yield pd.DataFrame({**out, "value": np.where(np.isnan(block), None, block).ravel() if np.isnan(block).any() else block.ravel()})

    frame = spark.createDataFrame([(list(i),) for i in index], "at array<int>").repartition(max(1, min(len(index), 10_000)))
    return frame.mapInPandas(run, ", ".join([f"`{d}` {kinds[d]}" for d in dims] + ["value double"]))


def write_array(path: str, name: str, values: np.ndarray, dims: tuple[str, ...], attrs: dict[str, Any]) -> None:
    """A coordinate as one chunk."""
    values = np.asarray(values)
    folder = os.path.join(path, name)
    os.makedirs(folder, exist_ok=True)
    values = values.astype("<f8") if values.dtype.kind == "f" else values.astype("<i8") if values.dtype.kind in "iu" else values
    _write_meta(folder, list(values.shape), list(values.shape), values.dtype.str, dims, attrs)
    with open(os.path.join(folder, ".".join("0" for _ in values.shape) or "0"), "wb") as f:
        f.write(zlib.compress(values.tobytes()))


def _write_meta(folder: str, shape: list[int], chunks: list[int], dtype: str, dims: tuple[str, ...], attrs: dict[str, Any]) -> None:
    meta = {"zarr_format": 2, "shape": shape, "chunks": chunks, "dtype": dtype, "compressor": {"id": "zlib", "level": 5}, "fill_value": "NaN" if dtype == "<f8" else None, "order": "C", "filters": None}
    with open(os.path.join(folder, ".zarray"), "w") as f:
        json.dump(meta, f)
    with open(os.path.join(folder, ".zattrs"), "w") as f:
        json.dump({"_ARRAY_DIMENSIONS": list(dims), **attrs}, f)


def chunk_lengths(dims: tuple[str, ...], shape: tuple[int, ...], chunks: dict[str, int] | None = None) -> list[int]:
    """1000 along time, 100 along other dimensions, unless given."""
    return [min(n, (chunks or {}).get(d, 1000 if d in ("time", "xtime") else 100)) or 1 for d, n in zip(dims, shape)]


def write_field(field: Any, path: str, name: str, chunks: dict[str, int] | None = None) -> None:
    """A field's chunks, each written by the task that gathers its tile; tiles are at most a chunk of cells."""
    dims, shape = field.dims, field.shape
    lengths = chunk_lengths(dims, shape, chunks)
    folder = os.path.join(path, name)
    os.makedirs(folder, exist_ok=True)
    attrs = {k: v for k, v in field.properties.items() if isinstance(v, (str, int, float))} | ({"units": field.units} if field.units else {})
    _write_meta(folder, list(shape), lengths, "<f8", dims, attrs)
    spark = field.df.sparkSession
    df = field.df
    for k, d in enumerate(dims):  # labels to positions by a small table
        own = field.domain.get(d)
        if own is not None and own.is_dim:
            pdf = pd.DataFrame({d: own.values, f"__i{k}": np.arange(own.values.size, dtype="int32")})
            kind = "timestamp_ntz" if own.values.dtype.kind == "M" else "double" if own.values.dtype.kind == "f" else "string"
            df = df.join(broadcast_if_small(spark.createDataFrame(pdf, f"`{d}` {kind}, __i{k} int")), d)
        else:
            df = df.withColumn(f"__i{k}", F.col(d).cast("int"))
    tiles = [f"__t{k}" for k in range(len(dims))]
    df = df.select(*[F.floor(F.col(f"__i{k}") / lengths[k]).cast("int").alias(t) for k, t in enumerate(tiles)], *[F.col(f"__i{k}") for k in range(len(dims))], "value")

    def store(pdf: pd.DataFrame) -> pd.DataFrame:
        index = [int(pdf[t].iloc[0]) for t in tiles]
        block = np.full(lengths, np.nan)
        block[tuple(pdf[f"__i{k}"].to_numpy() - index[k] * lengths[k] for k in range(len(dims)))] = pdf["value"].to_numpy(dtype=float)
        at = os.path.join(folder, ".".join(map(str, index)))
        with open(at + ".part", "wb") as f:
            f.write(zlib.compress(block.astype("<f8").tobytes()))
        os.replace(at + ".part", at)
        return pd.DataFrame({"n": [len(pdf)]})

    if dims:
        df.groupBy(*tiles).applyInPandas(store, "n long").count()
    else:
        write_array(path, name, np.asarray(field.to_dense(), dtype="f8"), (), attrs)

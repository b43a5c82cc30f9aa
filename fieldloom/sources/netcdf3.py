"""NetCDF classic files (CDF-1, CDF-2), read and written without a library.

The header lists dimensions, attributes and variables with their offsets; data is big-endian.
Executors read their own slabs of the first dimension from the file.
"""

from __future__ import annotations

import os
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

_TYPES = {1: ">i1", 2: "S1", 3: ">i2", 4: ">i4", 5: ">f4", 6: ">f8"}
_CODES = {"i1": 1, "S1": 2, "i2": 3, "i4": 4, "f4": 5, "f8": 6}
#: Cells of one task.
SLAB_CELLS = 2_000_000


@dataclass
class Variable:
    name: str
    dims: tuple[str, ...]
    attrs: dict[str, Any]
    dtype: str
    begin: int
    vsize: int
    record: bool


@dataclass
class Header:
    dims: dict[str, int]
    attrs: dict[str, Any]
    variables: dict[str, Variable]
    record_dim: str | None = None
    record_size: int = 0
    path: str = ""
    sizes: dict[str, int] = field(default_factory=dict)

    def shape(self, name: str) -> tuple[int, ...]:
        return tuple(self.dims[d] for d in self.variables[name].dims)

    def read(self, name: str, start: int = 0, stop: int | None = None) -> np.ndarray:
        """A variable's raw values, or a slab of its first dimension."""
        v, shape = self.variables[name], self.shape(name)
        if not shape:
            with open(self.path, "rb") as f:
                f.seek(v.begin)
                return np.frombuffer(f.read(np.dtype(v.dtype).itemsize), v.dtype)[0]
        stop = shape[0] if stop is None else stop
        inner = int(np.prod(shape[1:], dtype=np.int64)) * np.dtype(v.dtype).itemsize
        with open(self.path, "rb") as f:
            if not v.record:
                f.seek(v.begin + start * inner)
                raw = f.read((stop - start) * inner)
            else:
                parts = []
                for k in range(start, stop):
                    f.seek(v.begin + k * self.record_size)
                    parts.append(f.read(inner))
                raw = b"".join(parts)
        return np.frombuffer(raw, v.dtype).reshape((stop - start, *shape[1:]))


def read_header(path: str) -> Header:
    with open(path, "rb") as f:
        magic = f.read(4)
        if magic[:3] != b"CDF" or magic[3] not in (1, 2):
            raise ValueError(f"{path}: not a NetCDF classic file; NetCDF-4 needs an HDF5 library")
        wide = magic[3] == 2
        integer = lambda: struct.unpack(">i", f.read(4))[0]

        def text() -> str:
            n = integer()
            s = f.read(n).decode("utf-8")
            f.read(-n % 4)
            return s

        def attributes() -> dict[str, Any]:
            _, n = integer(), integer()
            out = {}
            for _ in range(n):
                name, kind, count = text(), integer(), integer()
                size = count * np.dtype(_TYPES[kind]).itemsize
                raw = f.read(size)
                f.read(-size % 4)
                if kind == 2:
                    out[name] = raw.decode("utf-8", "replace").rstrip("\0")
                else:
                    values = np.frombuffer(raw, _TYPES[kind])
                    out[name] = values[0].item() if count == 1 else values.tolist()
            return out

        records = integer()
        _, n = integer(), integer()
        dims, order, record_dim = {}, [], None
        for _ in range(n):
            name, size = text(), integer()
            if size == 0:
                record_dim, size = name, max(0, records)
            dims[name] = size
            order.append(name)
        attrs = attributes()
        _, n = integer(), integer()
        variables = {}
        for _ in range(n):
            name, rank = text(), integer()
            on = tuple(order[integer()] for _ in range(rank))
            about, kind, vsize = attributes(), integer(), integer()
            begin = struct.unpack(">q", f.read(8))[0] if wide else integer()
            variables[name] = Variable(name, on, about, _TYPES[kind], begin, vsize, bool(on) and on[0] == record_dim)
        held = [v.vsize for v in variables.values() if v.record]
        return Header(dims, attrs, variables, record_dim, sum(held) if len(held) != 1 else _unpadded(variables, dims), path)


def _unpadded(variables: dict[str, Variable], dims: dict[str, int]) -> int:
    v = next(v for v in variables.values() if v.record)
    return int(np.prod([dims[d] for d in v.dims[1:]], dtype=np.int64)) * np.dtype(v.dtype).itemsize


def decode(values: np.ndarray, attrs: dict[str, Any]) -> np.ndarray:
    """Unpacked doubles; NaN where missing."""
    out = values.astype("float64")
    for key in ("_FillValue", "missing_value"):
        if attrs.get(key) is not None:
            out = np.where(out == float(np.atleast_1d(attrs[key])[0]), np.nan, out)
    return out * float(attrs.get("scale_factor", 1.0)) + float(attrs.get("add_offset", 0.0))


def scan(spark: SparkSession, paths: list[str], name: str, labels: dict[str, dict[str, np.ndarray]], dims: tuple[str, ...], within: dict[str, tuple[Any, Any]] | None = None) -> DataFrame:
    """One variable of several files in long form, a task for each slab; ``labels`` holds each file's labels by dimension.

    Files and slabs without labels ``within`` the given ends of dimensions aren't read.
    """
    slabs = []
    held = lambda path, d, a=None, z=None: d not in (within or {}) or bool(((labels[path][d][a:z] >= within[d][0]) & (labels[path][d][a:z] <= within[d][1])).any())
    for path in paths:
        if not all(held(path, d) for d in dims):
            continue
        h = read_header(path)
        shape = h.shape(name)
        step = max(1, SLAB_CELLS // max(1, int(np.prod(shape[1:], dtype=np.int64)))) if shape else 1
        slabs += [(path, a, min(a + step, shape[0])) for a in range(0, shape[0], step) if held(path, dims[0], a, a + step)] if shape else [(path, 0, 1)]
    first = labels[paths[0]]
    kinds = {d: "timestamp_ntz" if first[d].dtype.kind == "M" else "double" if first[d].dtype.kind == "f" else "int" for d in dims}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path, a, z in zip(b["path"], b["a"], b["z"]):
                h = read_header(path)
                values = decode(h.read(name, a, z) if dims else np.asarray(h.read(name)), h.variables[name].attrs)
                out = {}
                for k, d in enumerate(dims):
                    at = labels[path][d][a:z] if k == 0 else labels[path][d]
                    out[d] = np.broadcast_to(at.reshape([-1 if i == k else 1 for i in range(len(dims))]), values.shape).ravel()
                yield pd.DataFrame({**out, "value": np.where(np.isnan(values), None, values).ravel() if np.isnan(values).any() else values.ravel()})

    schema = ", ".join([f"`{d}` {kinds[d]}" for d in dims] + ["value double"])
    frame = spark.createDataFrame(slabs, "path string, a int, z int").repartition(max(1, min(len(slabs), 10_000)))
    return frame.mapInPandas(run, schema)


def write(path: str, dims: dict[str, int], variables: dict[str, tuple[tuple[str, ...], np.ndarray, dict[str, Any]]], attrs: dict[str, Any] | None = None) -> str:
    """Write arrays as a classic file with 64-bit offsets; appears under its name when complete."""

    def name_bytes(s: str) -> bytes:
        raw = s.encode("utf-8")
        return struct.pack(">i", len(raw)) + raw + b"\0" * (-len(raw) % 4)

    def attribute_bytes(about: dict[str, Any]) -> bytes:
        if not about:
            return struct.pack(">ii", 0, 0)
        out = struct.pack(">ii", 12, len(about))
        for k, v in about.items():
            if isinstance(v, str):
                raw, kind, count = v.encode("utf-8"), 2, len(v.encode("utf-8"))
            else:
                a = np.atleast_1d(np.asarray(v))
                a = a.astype(">f8") if a.dtype.kind == "f" else a.astype(">i4")
                raw, kind, count = a.tobytes(), 6 if a.dtype.kind == "f" else 4, a.size
            out += name_bytes(k) + struct.pack(">ii", kind, count) + raw + b"\0" * (-len(raw) % 4)
        return out

    names = list(dims)
    head = b"CDF\x02" + struct.pack(">i", 0)
    head += (struct.pack(">ii", 10, len(names)) + b"".join(name_bytes(n) + struct.pack(">i", dims[n]) for n in names)) if names else struct.pack(">ii", 0, 0)
    head += attribute_bytes(attrs or {})
    packed = {}
    for n, (on, values, about) in variables.items():
        values = np.asarray(values)
        code = values.dtype.str[1:] if values.dtype.str[1:] in _CODES else "i4" if values.dtype.kind in "iub" else "f8"
        packed[n] = (on, np.ascontiguousarray(values.astype(">" + code if code != "S1" else code)), about, _CODES[code])
    fixed = sum(len(name_bytes(n)) + 4 + 4 * len(on) + len(attribute_bytes(about)) + 16 for n, (on, _, about, _) in packed.items())
    at = len(head) + 8 + fixed
    body = struct.pack(">ii", 11, len(packed)) if packed else struct.pack(">ii", 0, 0)
    for n, (on, values, about, code) in packed.items():
        size = values.nbytes + (-values.nbytes % 4)
        body += name_bytes(n) + struct.pack(">i", len(on)) + b"".join(struct.pack(">i", names.index(d)) for d in on) + attribute_bytes(about)
        body += struct.pack(">ii", code, min(size, 2**31 - 4)) + struct.pack(">q", at)
        at += size
    with open(path + ".part", "wb") as f:
        f.write(head + body)
        for on, values, about, code in packed.values():
            f.write(values.tobytes() + b"\0" * (-values.nbytes % 4))
    os.replace(path + ".part", path)
    return path

"""Baseline GeoTIFF: one band after another in strips or tiles, raw or deflate."""

from __future__ import annotations

import struct
import zlib

import numpy as np

_SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}
_FORMS = {1: "B", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d"}


def read_geotiff(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, float | None]:
    """(values [band, y, x], y, x, no-data value); y and x are pixel centres."""
    with open(path, "rb") as f:
        raw = f.read()
    order = {b"II": "<", b"MM": ">"}.get(raw[:2])
    if order is None or struct.unpack(order + "H", raw[2:4])[0] != 42:
        raise ValueError(f"{path}: not a TIFF file")
    at = struct.unpack(order + "I", raw[4:8])[0]
    tags: dict[int, list] = {}
    for k in range(struct.unpack(order + "H", raw[at:at + 2])[0]):
        tag, kind, count = struct.unpack(order + "HHI", raw[at + 2 + 12 * k:at + 10 + 12 * k])
        size = _SIZES.get(kind, 1) * count
        place = at + 10 + 12 * k
        start = place if size <= 4 else struct.unpack(order + "I", raw[place:place + 4])[0]
        block = raw[start:start + size]
        tags[tag] = [block.rstrip(b"\0").decode("ascii", "replace")] if kind == 2 else list(struct.unpack(order + _FORMS[kind] * count, block)) if kind in _FORMS else []
    width, height, bands = tags[256][0], tags[257][0], tags.get(277, [1])[0]
    compression, predictor = tags.get(259, [1])[0], tags.get(317, [1])[0]
    if compression not in (1, 8, 32946) or predictor != 1:
        raise NotImplementedError(f"{path}: compression {compression}, predictor {predictor}")
    kind = {1: "u", 2: "i", 3: "f"}[tags.get(339, [1])[0]]
    dtype = np.dtype(f"{order}{kind}{tags.get(258, [8])[0] // 8}")
    separate = tags.get(284, [1])[0] == 2
    tiled = 324 in tags
    tw, th = (tags[322][0], tags[323][0]) if tiled else (width, min(tags.get(278, [height])[0], height))
    offsets, counts = (tags[324], tags[325]) if tiled else (tags[273], tags.get(279, [height * width * dtype.itemsize * bands]))
    across, down, per = -(-width // tw), -(-height // th), 1 if separate else bands
    out = np.zeros((bands, down * th, across * tw), dtype=dtype)
    for k, (o, n) in enumerate(zip(offsets, counts)):
        block = raw[o:o + n] if compression == 1 else zlib.decompress(raw[o:o + n])
        plane, rest = divmod(k, across * down)
        r, c = divmod(rest, across)
        rows = th if tiled else min(th, height - r * th)
        part = np.frombuffer(block, dtype, count=rows * tw * per).reshape(rows, tw, per)
        bands_here = [plane] if separate else range(bands)
        for i, b in enumerate(bands_here):
            out[b, r * th:r * th + rows, c * tw:(c + 1) * tw] = part[:, :, i]
    sx, sy = tags.get(33550, [1.0, 1.0])[:2]
    tie = tags.get(33922, [0.0] * 6)
    half = 0.5  # a raster cell is an area: its centre
    x = tie[3] + (np.arange(width) - tie[0] + half) * sx
    y = tie[4] - (np.arange(height) - tie[1] + half) * sy
    nodata = tags.get(42113)
    return out[:, :height, :width].astype("float64"), y, x, float(nodata[0]) if nodata else None


def write_geotiff(path: str, values: np.ndarray, y: np.ndarray, x: np.ndarray) -> str:
    """Bands of doubles in one raw strip each."""
    values = np.atleast_3d(values) if values.ndim == 3 else values[None]
    bands, height, width = values.shape
    blocks = [np.ascontiguousarray(v, dtype="<f8").tobytes() for v in values]
    sx = float(x[1] - x[0]) if width > 1 else 1.0
    sy = float(y[0] - y[1]) if height > 1 else 1.0
    data_at = 8
    offsets = [data_at + i * len(blocks[0]) for i in range(bands)]
    tail = data_at + bands * len(blocks[0])
    entries, extra = [], b""

    def add(tag: int, kind: int, items: list) -> None:
        nonlocal extra
        raw = struct.pack("<" + _FORMS[kind] * len(items), *items)
        if len(raw) > 4:
            entries.append((tag, kind, len(items), struct.pack("<I", tail + len(extra))))
            extra += raw
        else:
            entries.append((tag, kind, len(items), raw.ljust(4, b"\0")))

    for tag, kind, items in ((256, 4, [width]), (257, 4, [height]), (258, 3, [64] * bands), (259, 3, [1]), (262, 3, [1]), (273, 4, offsets), (277, 3, [bands]), (278, 4, [height]),
                             (279, 4, [len(b) for b in blocks]), (284, 3, [2]), (339, 3, [3] * bands), (33550, 12, [sx, sy, 0.0]), (33922, 12, [0.0, 0.0, 0.0, float(x[0]) - sx / 2, float(y[0]) + sy / 2, 0.0])):
        add(tag, kind, items)
    with open(path, "wb") as f:
        f.write(b"II" + struct.pack("<HI", 42, tail + len(extra)))
        f.write(b"".join(blocks) + extra)
        f.write(struct.pack("<H", len(entries)) + b"".join(struct.pack("<HHI", t, k, n) + v for t, k, n, v in entries) + struct.pack("<I", 0))
    return path

"""Cell centres inside polygons, on the driver's coordinates."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

import numpy as np

from fieldloom.operators.spatial_near import Regions

Ring = Sequence[tuple[float, float]]


def rings_of(geometry: Any) -> list[list[tuple[float, float]]]:
    """All rings as (latitude, longitude) of a GeoJSON-like Polygon or MultiPolygon, or of anything with ``__geo_interface__``."""
    shape = getattr(geometry, "__geo_interface__", geometry)
    if not isinstance(shape, dict) or shape.get("type") not in ("Polygon", "MultiPolygon"):
        raise TypeError("a geometry is a Polygon or a MultiPolygon")
    polygons = [shape["coordinates"]] if shape["type"] == "Polygon" else shape["coordinates"]
    out = []
    for polygon in polygons:
        for ring in polygon:
            points = [(float(p[1]), float(p[0])) for p in ring]
            out.append(points[:-1] if len(points) > 1 and points[0] == points[-1] else points)
    return out


def inside(geometry: Any, lat: np.ndarray, lon: np.ndarray) -> np.ndarray:
    """True where a centre is inside: even-odd over all rings, so holes are outside."""
    regions = Regions([("all", ring) for ring in rings_of(geometry)])
    out = np.zeros(lat.size, dtype=bool)
    row, _ = regions.sweep(lat.ravel().astype(float), lon.ravel().astype(float))
    out[row] = True
    return out.reshape(lat.shape)

"""Logical names, CF attribute vocabulary and JSON coercion."""

from __future__ import annotations

import string
from datetime import date, datetime
from typing import Any

import numpy as np

# CF attributes that describe encoding rather than the quantity.
CF_ENCODING = (
    "name", "dims", "units", "standard_name", "long_name", "ancillary_variables", "missing_value", "valid_range", "valid_min", "valid_max",
    "flag_values", "flag_meanings", "flag_masks", "_FillValue", "coordinates", "axis", "bounds", "grid_mapping", "formula_terms", "calendar",
    "positive", "add_offset", "scale_factor", "compress", "cell_measures", "cell_methods", "climatology",
)


def split_attributes(attrs: dict[str, Any]) -> tuple[dict[str, Any], dict[str, Any]]:
    """(properties, CF encoding) of an attribute map."""
    encoding = {k: v for k, v in attrs.items() if k in CF_ENCODING}
    return {k: v for k, v in attrs.items() if k not in encoding}, encoding


def logical_name(ncvar: str, attrs: dict[str, Any], id_pattern: str | None = None, mapping: dict[str, dict[str, Any]] | None = None) -> str:
    """The mapping's name, else the filled pattern, else the standard name, else the name on disk.

    A pattern of which an attribute is missing falls back to the name on disk.
    """
    if mapping and ncvar in mapping and mapping[ncvar].get("name"):
        return str(mapping[ncvar]["name"])
    if id_pattern is None:
        return str(attrs.get("standard_name") or ncvar)
    needed = placeholders(id_pattern)
    if any(attrs.get(k) is None for k in needed):
        return ncvar
    return id_pattern.format_map({k: attrs[k] for k in needed}) if needed else id_pattern


def placeholders(pattern: str) -> list[str]:
    """Named placeholders of a format pattern; unnamed ones don't count."""
    return [name for _, name, _, _ in string.Formatter().parse(pattern) if name]


def to_json_value(x: Any) -> Any:
    """Plain Python values of numpy and time values, through containers; NaN becomes None."""
    if isinstance(x, dict):
        return {str(k): to_json_value(v) for k, v in x.items()}
    if isinstance(x, (list, tuple, set, np.ndarray)):
        return [to_json_value(v) for v in (x.tolist() if isinstance(x, np.ndarray) and x.dtype.kind not in "mM" else x)]
    if isinstance(x, np.datetime64):
        return str(x.astype("datetime64[s]"))
    if isinstance(x, (datetime, date)):
        return x.isoformat()
    if isinstance(x, np.generic):
        x = x.item()
    return None if isinstance(x, float) and x != x else x

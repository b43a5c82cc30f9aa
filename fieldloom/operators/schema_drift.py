"""Schemas that drift between the files of a dataset: all changes, and one consistent table.

Each version (the files of one start) is profiled by its columns: name, type, units and the quantity
they say they are. Columns that went and columns that came are matched as the two sides of a
bipartite graph, weighted by quantity, units, type and likeness of names; matched ones are renamed.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.functions.matching import assign, name_similarity
from fieldloom.plans.ordered import with_previous
from fieldloom.plans.scale import broadcast_if_small, spread, stored

# C and CDL names whose numpy reading differs or doesn't exist.
_C_TYPES = {"float": "f4", "real": "f4", "int": "i4", "integer": "i4", "long": "i8", "byte": "i1", "char": "S1", "string": "str", "ushort": "u2", "uint": "u4", "ubyte": "u1", "int64": "i8", "uint64": "u8"}


def type_of(spelling: object) -> str | None:
    """One name for all spellings of a type: kind and bytes, without byte order; None for null or blank."""
    if not isinstance(spelling, str) or not spelling.strip():
        return None
    text = spelling.strip()
    if text.lower() in _C_TYPES:
        return _C_TYPES[text.lower()]
    for candidate in (text, text.lower()):
        try:
            t = np.dtype(candidate)
            return f"{t.kind}{t.itemsize}" if t.kind not in "OSU" else str(t.kind)
        except TypeError:
            continue
    return text.lower()


def _entries(text: object) -> dict[str, dict] | None:
    """name -> attributes from either layout, an object by name or a list of objects with ``ncvar``."""
    if not isinstance(text, str):
        return None
    try:
        read = json.loads(text)
    except ValueError:
        return None
    if isinstance(read, dict):
        items = read.items()
    elif isinstance(read, list):
        items = [(e.get("ncvar") or e.get("name"), e) for e in read if isinstance(e, dict)]
    else:
        return None
    return {str(k): (v if isinstance(v, dict) else {"dtype": v}) for k, v in items if k is not None}


def quantity_of(properties: dict) -> str | None:
    """What a column is: its standard name, else its long name without regard to case and outer blanks."""
    for key in ("standard_name", "long_name"):
        value = properties.get(key)
        if isinstance(value, str) and value.strip():
            return f"{key}:{value.strip() if key == 'standard_name' else value.strip().casefold()}"
    return None


def profile(encoding: object, properties: object) -> str | None:
    """The columns of a file as canonical JSON: name -> [type, quantity, units]; None without an encoding."""
    fields = _entries(encoding)
    if fields is None:
        return None
    about = _entries(properties) or {}
    columns = {}
    for name in sorted(fields):
        said = about.get(name, {})
        units = said.get("units")
        columns[name] = [type_of(fields[name].get("dtype")), quantity_of(said), units if isinstance(units, str) else None]
    return json.dumps(columns, sort_keys=True, ensure_ascii=False)


def merge_profiles(texts: list[str]) -> dict[str, list]:
    """The union of the columns of one version's files; what one file doesn't say another may."""
    out: dict[str, list] = {}
    for text in sorted(texts):
        for name, said in json.loads(text).items():
            held = out.setdefault(name, [None, None, None])
            for i, value in enumerate(said):
                if held[i] is None:
                    held[i] = value
    return out


def changes(before: dict[str, list], after: dict[str, list]) -> list[tuple[str, str, str | None]]:
    """(name, kind, old name) of each difference: added, removed, renamed, retyped."""
    gone, come = sorted(set(before) - set(after)), sorted(set(after) - set(before))
    weights = [[_likeness(a, before[a], b, after[b]) for b in come] for a in gone]
    match = assign(weights) if gone and come else [-1] * len(gone)
    out: list[tuple[str, str, str | None]] = []
    same = [(n, n) for n in sorted(set(before) & set(after))]
    for a, j in zip(gone, match):
        if j < 0:
            out.append((a, "removed", None))
        else:
            out.append((come[j], "renamed", a))
            same.append((a, come[j]))
    out += [(b, "added", None) for j, b in enumerate(come) if j not in match]
    out += [(b, "retyped", a if a != b else None) for a, b in same if before[a][0] and after[b][0] and before[a][0] != after[b][0]]
    return out


def _likeness(a: str, left: list, b: str, right: list) -> float:
    """0 unless both say the same quantity; then more for equal units, equal types and like names."""
    if left[1] is None or left[1] != right[1]:
        return 0.0
    return 1.0 + 0.3 * (left[2] == right[2]) + 0.2 * (left[0] == right[0]) + 0.5 * name_similarity(a, b)


def versions(files: DataFrame) -> DataFrame:
    """dataset, vars, start_at, file_id (lowest), profiles (the different ones) of each start with a described file.

    Files with a null or unreadable field_encoding are passed over, and so are files without a start or an id.
    """

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            known: dict[tuple, str | None] = {}
            pairs = list(zip(b["field_encoding"], b["field_properties"]))
            profiles = [known[p] if p in known else known.setdefault(p, profile(*p)) for p in pairs]
            yield b[["dataset", "vars", "start_at", "file_id"]].assign(profile=profiles)

    rows = files.where(F.col("field_encoding").isNotNull() & F.col("start_at").isNotNull() & F.col("file_id").isNotNull()).select("dataset", "vars", F.col("start_at").cast("timestamp_ntz").alias("start_at"), "file_id", "field_encoding", "field_properties")
    profiles = spread(rows).mapInPandas(read, "dataset string, vars string, start_at timestamp_ntz, file_id long, profile string").where("profile is not null")
    # equal profiles of one start are combined before they meet
    once = profiles.groupBy("dataset", "vars", "start_at", "profile").agg(F.min("file_id").alias("file_id"))
    return once.groupBy("dataset", "vars", "start_at").agg(F.min("file_id").alias("file_id"), F.array_sort(F.collect_list("profile")).alias("profiles"))


def schema_changes(files: DataFrame) -> DataFrame:
    """dataset, vars, start_at, file_id, ncvar, change_kind, old_ncvar: each difference from the start before.

    ``ncvar`` is the new name, for a removed column the old one. A column that is renamed and retyped
    at once has both rows. A type that either side doesn't state is no change. The first start of a
    dataset and vars has none; null dataset or vars is a group of its own.
    """
    # the JSON is read once: a version's row is wanted twice
    steps = with_previous(stored(versions(files)).withColumn("month", F.expr("year(start_at) * 12 + month(start_at)")), ["dataset", "vars"], "month", "start_at", ["profiles"], "before")

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            known: dict[tuple, list] = {}
            out = []
            for dataset, name, start, file_id, old, new in zip(b["dataset"], b["vars"], b["start_at"], b["file_id"], b["old"], b["profiles"]):
                key = (tuple(old), tuple(new))
                if key not in known:
                    known[key] = changes(merge_profiles(list(old)), merge_profiles(list(new)))
                out += [(dataset, name, start, file_id, *c) for c in known[key]]
            yield pd.DataFrame(out, columns=["dataset", "vars", "start_at", "file_id", "ncvar", "change_kind", "old_ncvar"])

    steps = steps.select("dataset", "vars", "start_at", "file_id", "profiles", F.col("before.profiles").alias("old")).where("old is not null and old <> profiles")
    return steps.mapInPandas(compare, "dataset string, vars string, start_at timestamp_ntz, file_id long, ncvar string, change_kind string, old_ncvar string")



def promoted(types: list[str]) -> str | None:
    """The narrowest type that holds all; text if one of them isn't a number."""
    types = sorted({t for t in types if t})
    if not types:
        return None
    if len(types) == 1:
        return types[0]
    try:
        t = np.result_type(*[np.dtype(x) for x in types])
        return f"{t.kind}{t.itemsize}" if t.kind in "biuf" else "str"
    except TypeError:
        return "str"


def described_fields(files: DataFrame) -> DataFrame:
    """file_id, dataset, vars, start_at, ncvar, dtype, quantity, units of every field of every described file."""

    def unfold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            known: dict[tuple, dict[str, list] | None] = {}
            out = []
            for dataset, name, start, file_id, encoding, properties in zip(b["dataset"], b["vars"], b["start_at"], b["file_id"], b["field_encoding"], b["field_properties"]):
                if (encoding, properties) not in known:
                    text = profile(encoding, properties)
                    known[encoding, properties] = None if text is None else json.loads(text)
                for column, (dtype, quantity, units) in (known[encoding, properties] or {}).items():
                    out.append((file_id, dataset, name, start, column, dtype, quantity.partition(":")[2] if quantity else None, units))
            yield pd.DataFrame(out, columns=["file_id", "dataset", "vars", "start_at", "ncvar", "dtype", "quantity", "units"])

    rows = files.where(F.col("field_encoding").isNotNull() & F.col("start_at").isNotNull() & F.col("file_id").isNotNull()).select("dataset", "vars", F.col("start_at").cast("timestamp_ntz").alias("start_at"), "file_id", "field_encoding", "field_properties")
    return spread(rows).mapInPandas(unfold, "file_id long, dataset string, vars string, start_at timestamp_ntz, ncvar string, dtype string, quantity string, units string")


def unified_fields(files: DataFrame) -> DataFrame:
    """The fields of all files in one consistent table: file_id, dataset, vars, start_at, field, ncvar, dtype, unified_dtype, units.

    ``field`` is the quantity that a column says it is. A column that doesn't say it is what the same
    name stood for at the last start that says it, else at the first one; a name that never says
    anything is a field of its own. So a field keeps its name over renames, and a name that comes to
    stand for another quantity changes its field. ``unified_dtype`` is the narrowest type that holds
    all of the field's in the dataset and vars; units and dtype are as said.
    """
    columns = stored(described_fields(files).dropDuplicates())
    key = ["dataset", "vars", "ncvar"]
    # what a name stood for, since when: as many rows as there are meanings, not files
    said = columns.where("quantity is not null").groupBy(*key, "quantity").agg(F.min("start_at").alias("since"))
    meant = F.when(F.count(F.when(F.col("since") <= F.col("start_at"), 1)) > 0, F.max(F.when(F.col("since") <= F.col("start_at"), F.struct("since", "quantity")))).otherwise(F.min(F.struct("since", "quantity")))
    silent = columns.where("quantity is null").select(*key, "start_at").distinct().alias("c").join(
        said.alias("s"), (F.col("c.dataset").eqNullSafe(F.col("s.dataset"))) & (F.col("c.vars").eqNullSafe(F.col("s.vars"))) & (F.col("c.ncvar") == F.col("s.ncvar")))
    learned = silent.groupBy("c.dataset", "c.vars", "c.ncvar", "start_at").agg(meant.alias("m")).select(
        F.col("dataset").alias("d_"), F.col("vars").alias("v_"), F.col("ncvar").alias("n_"), F.col("start_at").alias("s_"), F.col("m.quantity").alias("learned"))
    same = F.col("dataset").eqNullSafe(F.col("d_")) & F.col("vars").eqNullSafe(F.col("v_")) & (F.col("ncvar") == F.col("n_")) & (F.col("start_at") == F.col("s_"))
    rows = columns.where("quantity is null").join(learned, same, "left").withColumn("field", F.coalesce("learned", "ncvar")).drop("d_", "v_", "n_", "s_", "learned")
    rows = columns.where("quantity is not null").withColumn("field", F.col("quantity")).unionByName(rows)
    types = rows.groupBy("dataset", "vars", "field").agg(F.array_sort(F.collect_set("dtype")).alias("types"))

    @F.pandas_udf("string")
    def holding(types: pd.Series) -> pd.Series:
        return pd.Series([promoted(list(t)) for t in types], dtype=object)

    types = types.select(F.col("dataset").alias("d_"), F.col("vars").alias("v_"), F.col("field").alias("f_"), holding("types").alias("unified_dtype"))
    out = rows.join(broadcast_if_small(types), F.col("dataset").eqNullSafe(F.col("d_")) & F.col("vars").eqNullSafe(F.col("v_")) & (F.col("field") == F.col("f_")))
    return out.select("file_id", "dataset", "vars", "start_at", "field", "ncvar", "dtype", "unified_dtype", "units")


def unified_schema(files: DataFrame) -> DataFrame:
    """dataset, vars, field, names, dtypes, dtype, n_starts: the columns of :func:`unified_fields`, a row for each field."""
    fields = unified_fields(files)
    return fields.groupBy("dataset", "vars", "field").agg(
        F.array_sort(F.collect_set("ncvar")).alias("names"), F.array_sort(F.collect_set("dtype")).alias("dtypes"), F.max("unified_dtype").alias("dtype"), F.count_distinct("start_at").alias("n_starts"))

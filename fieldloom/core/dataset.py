"""A dataset: a catalog of cubes, one for each combination of attributes in file names."""

from __future__ import annotations

import logging
import os
import shutil
import tempfile
import zipfile
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from fieldloom.core.cube import DataCube
from fieldloom.meta.naming import to_json_value

log = logging.getLogger(__name__)
#: Entries of a dataset that are written at the same time.
WRITERS = 4


@dataclass(frozen=True)
class Entry:
    """One row: attributes, files and a cube that is made when it is needed (None: files only)."""

    attrs: dict[str, str]
    files: tuple[str, ...]
    open: Callable[[], DataCube] | None = None
    fields: tuple[str, ...] | None = None

    def cube(self) -> DataCube:
        if self.open is None:
            raise ValueError("this dataset passes files through; it has no cubes")
        return self.open()


@dataclass(frozen=True)
class Dataset:
    """Verbs are put off until a cube is needed; filters only touch the catalog."""

    entries: tuple[Entry, ...]
    attr_names: tuple[str, ...]
    metadata: dict[str, Any] = field(default_factory=dict)

    def __len__(self) -> int:
        return len(self.entries)

    def __iter__(self) -> Iterator[Entry]:
        return iter(self.entries)

    def _then(self, verb: Callable[[DataCube], Any]) -> Dataset:
        def later(e: Entry) -> Entry:
            return e if e.open is None else replace(e, open=lambda: verb(e.cube()), fields=None)

        return replace(self, entries=tuple(later(e) for e in self.entries))

    @property
    def cubes(self) -> list[DataCube]:
        return [e.cube() for e in self.entries if e.open is not None]

    @property
    def nbytes(self) -> int:
        """Bytes of the files."""
        return sum(os.path.getsize(f) for e in self.entries for f in e.files if os.path.exists(f))

    def to_dataframe(self, spark: SparkSession) -> DataFrame:
        """The catalog: attributes, files ARRAY<STRING>, fields ARRAY<STRING>."""
        schema = ", ".join([f"`{a}` string" for a in self.attr_names] + ["files array<string>", "fields array<string>"])
        rows = [(*[e.attrs[a] for a in self.attr_names], list(e.files), list(e.fields) if e.fields is not None else None) for e in self.entries]
        return spark.createDataFrame(rows, schema)

    def filter(self, indexers: dict[str, Any] | None = None, **more: Any) -> Dataset:
        """Entries of which each given attribute has one of its values; ValueError for an unknown attribute."""
        wanted = {**(indexers or {}), **more}
        unknown = set(wanted) - set(self.attr_names)
        if unknown:
            raise ValueError(f"unknown attributes: {sorted(unknown)}")
        allowed = {k: {str(x) for x in ([v] if isinstance(v, (str, int, float)) else v)} for k, v in wanted.items()}
        return replace(self, entries=tuple(e for e in self.entries if all(e.attrs[k] in v for k, v in allowed.items())))

    def with_metadata(self, **changes: Any) -> Dataset:
        """The dataset with some of its metadata set; None takes one away."""
        return replace(self, metadata={k: v for k, v in {**self.metadata, **changes}.items() if v is not None})

    def __getitem__(self, keys: str | Iterable[str]) -> Dataset:
        """The cubes with the given fields only; entries without any are left out."""
        names = [keys] if isinstance(keys, str) else list(keys)
        out = []
        for e in self.entries:
            cube = e.cube()
            held = [k for k in names if cube._find(k) is not None]
            if held:
                out.append(replace(e, open=lambda c=cube, h=held: c[h], fields=tuple(held)))
        return replace(self, entries=tuple(out))

    def apply(self, func: Callable[..., Any] | str, drop_empty: bool = False, **kwargs: Any) -> Dataset:
        """A callable on each cube, or the name of one of its methods or properties (which takes no arguments)."""

        def call(cube: DataCube) -> Any:
            if callable(func):
                return func(cube, **kwargs)
            member = getattr(cube, func)
            if callable(member):
                return member(**kwargs)
            if kwargs:
                raise ValueError(f"{func!r} is a property and takes no arguments")
            return member

        done = self._then(call)
        return done._drop_empty() if drop_empty else done

    def _drop_empty(self) -> Dataset:
        kept = []
        for e in self.entries:
            cube = e.cube()
            if not isinstance(cube, DataCube) or len(cube):
                kept.append(replace(e, open=lambda c=cube: c, fields=tuple(cube.fields) if isinstance(cube, DataCube) else None))
        return replace(self, entries=tuple(kept))

    def persist(self, path: str | None = None, zip_if_many: bool = False) -> str | None:
        """One file for each entry, named after its attributes; ``WRITERS`` entries are written at once.

        Empty cubes are passed over. Without any file None is returned, with one its path, else the
        folder, or an archive of it if ``zip_if_many``. Entries without cubes copy their one file.
        """
        folder = path or tempfile.mkdtemp(prefix="fieldloom-")
        os.makedirs(folder, exist_ok=True)

        def write(e: Entry) -> str | None:
            name = "-".join(f"{a}={e.attrs[a]}" for a in self.attr_names)
            if e.open is None:
                if len(e.files) != 1:
                    raise ValueError("several files can't be copied to one")
                return shutil.copyfile(e.files[0], os.path.join(folder, name + os.path.splitext(e.files[0])[1]))
            cube = e.cube()
            if not len(cube) or any(n == 0 for f in cube for n in f.shape):
                log.warning("%s is empty and isn't written", name)
                return None
            return cube.persist(os.path.join(folder, f"{name}.nc"))

        with ThreadPoolExecutor(WRITERS) as pool:
            written = [path for path in pool.map(write, self.entries) if path is not None]
        if not written:
            log.warning("nothing is written")
            return None
        if len(written) == 1:
            return written[0]
        if not zip_if_many:
            return folder
        archive = folder.rstrip("/") + ".zip"
        with zipfile.ZipFile(archive, "w") as z:
            for w in written:
                z.write(w, os.path.basename(w))
                os.remove(w)
        return archive

    def to_dict(self) -> list[dict[str, Any]]:
        return to_json_value([{"attributes": e.attrs, **(e.cube().to_dict() if e.open is not None else {"files": list(e.files)})} for e in self.entries])


def _verb(name: str) -> Callable[..., Dataset]:
    def run(self: Dataset, *args: Any, **kwargs: Any) -> Dataset:
        return self._then(lambda cube: getattr(cube, name)(*args, **kwargs))

    run.__name__, run.__doc__ = name, f"``DataCube.{name}`` on each cube, when it is needed."
    return run


for _name in ("geobbox", "locations", "sel", "resample", "average", "regrid", "to_regular", "interpolate", "extract_polygons"):
    setattr(Dataset, _name, _verb(_name))

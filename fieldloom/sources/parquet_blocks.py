"""Merge Parquet files by copying their encoded blocks; only footers are decoded and rewritten.

A Parquet file is a magic number, column blocks, a footer in Thrift's compact encoding, its length
and the magic number again. Blocks are position-independent: the footer holds their offsets. So a
merged file is the blocks of its parts one after another, and a footer with the parts' row groups,
every offset moved by what stands before. Nothing is decompressed or decoded.

Copied blocks stay as small as they were, and a large file of very small blocks reads as slowly as the
small files did. So files whose blocks are tiny on average are written anew with blocks of a good size,
in merged files of their own; all others are copied.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.plans.ordered import with_running_total
from fieldloom.plans.scale import checkpointed

#: Mean bytes of a block below which a file is written anew, and the bytes in memory that make a new block.
LEAST_BLOCK, NEW_BLOCK = 1024 * 1024, 128 * 1024 * 1024
MAGIC = b"PAR1"
COPY_BYTES = 8 * 1024 * 1024

# Compact Thrift type codes.
TRUE, FALSE, BYTE, I16, I32, I64, DOUBLE, BINARY, LIST, SET, MAP, STRUCT = 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12


class _Reader:
    def __init__(self, data: bytes) -> None:
        self.data, self.at = data, 0

    def byte(self) -> int:
        self.at += 1
        return self.data[self.at - 1]

    def varint(self) -> int:
        shift = out = 0
        while True:
            b = self.byte()
            out |= (b & 0x7F) << shift
            if b < 0x80:
                return out
            shift += 7

    def zigzag(self) -> int:
        n = self.varint()
        return (n >> 1) ^ -(n & 1)

    def take(self, n: int) -> bytes:
        self.at += n
        return self.data[self.at - n:self.at]

    def value(self, kind: int, inside: bool = False):
        if kind in (TRUE, FALSE):
            return self.byte() == TRUE if inside else kind == TRUE
        if kind == BYTE:
            return self.byte()
        if kind in (I16, I32, I64):
            return self.zigzag()
        if kind == DOUBLE:
            return self.take(8)
        if kind == BINARY:
            return self.take(self.varint())
        if kind in (LIST, SET):
            head = self.byte()
            n, of = head >> 4, head & 0x0F
            if n == 15:
                n = self.varint()
            return of, [self.value(of, True) for _ in range(n)]
        if kind == MAP:
            n = self.varint()
            if not n:
                return 0, []
            kinds = self.byte()
            return kinds, [(self.value(kinds >> 4, True), self.value(kinds & 0x0F, True)) for _ in range(n)]
        if kind == STRUCT:
            out: dict[int, list] = {}
            last = 0
            while head := self.byte():
                kind, step = head & 0x0F, head >> 4
                last = last + step if step else self.zigzag()
                out[last] = [kind, self.value(kind)]
            return out
        raise ValueError(f"unknown Thrift type {kind}")


class _Writer:
    def __init__(self) -> None:
        self.out = bytearray()

    def varint(self, n: int) -> None:
        while n >= 0x80:
            self.out.append(n & 0x7F | 0x80)
            n >>= 7
        self.out.append(n)

    def zigzag(self, n: int) -> None:
        self.varint(n << 1 if n >= 0 else (-n << 1) - 1)

    def value(self, kind: int, value, inside: bool = False) -> None:
        if kind in (TRUE, FALSE):
            if inside:
                self.out.append(TRUE if value else FALSE)
        elif kind == BYTE:
            self.out.append(value)
        elif kind in (I16, I32, I64):
            self.zigzag(value)
        elif kind == DOUBLE:
            self.out += value
        elif kind == BINARY:
            self.varint(len(value))
            self.out += value
        elif kind in (LIST, SET):
            of, items = value
            self.out.append((min(len(items), 15) << 4) | of)
            if len(items) >= 15:
                self.varint(len(items))
            for x in items:
                self.value(of, x, True)
        elif kind == MAP:
            kinds, items = value
            self.varint(len(items))
            if items:
                self.out.append(kinds)
                for k, v in items:
                    self.value(kinds >> 4, k, True)
                    self.value(kinds & 0x0F, v, True)
        elif kind == STRUCT:
            last = 0
            for field in sorted(value):
                of, x = value[field]
                if of in (TRUE, FALSE):
                    of = TRUE if x else FALSE
                if 0 < field - last <= 15:
                    self.out.append((field - last) << 4 | of)
                else:
                    self.out.append(of)
                    self.zigzag(field)
                last = field
                self.value(of, x)
            self.out.append(0)
        else:
            raise ValueError(f"unknown Thrift type {kind}")


def encode(kind: int, value) -> bytes:
    w = _Writer()
    w.value(kind, value, True)
    return bytes(w.out)


def file_system(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI (local, HDFS, object stores), and the path in it."""
    if "://" in path:
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path.removeprefix("file:")


class Footer:
    """The footer of one file, and where its blocks end."""

    def __init__(self, path: str) -> None:
        system, at = file_system(path)
        with system.open_input_file(at) as f:
            size = f.size()
            if size < 12:
                raise ValueError(f"{path}: too short for Parquet")
            f.seek(size - 8)
            length, magic = struct.unpack("<I4s", f.read(8))
            if magic != MAGIC or length > size - 12:
                raise ValueError(f"{path}: no Parquet footer")
            self.blocks_end = size - 8 - length
            f.seek(self.blocks_end)
            self.meta = _Reader(f.read(length)).value(STRUCT)
        self.path, self.size = path, size

    @property
    def schema(self) -> bytes:
        return encode(LIST, self.meta[2][1])

    @property
    def rows(self) -> int:
        return self.meta[3][1]

    @property
    def groups(self) -> list[dict]:
        return self.meta[4][1][1]

    @property
    def has_int96(self) -> bool:
        """Timestamps of an old kind, which are only copied."""
        return any(column.get(1, [I32, 0])[1] == 3 for column in self.meta[2][1][1])


def _shift(fields: dict, keys: tuple[int, ...], by: int) -> None:
    for k in keys:
        if k in fields:
            fields[k][1] += by


def _moved(group: dict, by: int, ordinal: int) -> dict:
    _shift(group, (5,), by)  # file_offset
    group[7] = [I16, ordinal] if ordinal < 2**15 else [I16, 2**15 - 1]
    for column in group[1][1][1]:
        column.pop(1, None)  # file_path: the blocks are in this file now
        _shift(column, (2, 4, 6), by)  # file, offset-index and column-index offsets
        if column[2][1] < 0:
            column[2][1] = 0
        if 3 in column:
            _shift(column[3][1], (9, 10, 11, 14), by)  # data, index and dictionary pages, bloom filter
    return group


def merge_files(paths: list[str], out: str) -> dict[str, int]:
    """Merge files of one schema into ``out``; returns its counts after checking them.

    The result appears under its name only when complete, so a task that is tried again replaces
    what it left. Files without rows add nothing. Raises ValueError if schemas differ or if the
    written file doesn't have the parts' blocks and rows.
    """
    if not paths:
        raise ValueError("nothing to merge")
    footers = [Footer(p) for p in paths]
    schema = footers[0].schema
    for f in footers[1:]:
        if f.schema != schema:
            raise ValueError(f"{f.path}: its schema differs from that of {paths[0]}")
    groups: list[dict] = []
    system, at = file_system(out)
    temporary = f"{at}.{uuid.uuid4().hex}.part"
    system.create_dir(at.rpartition("/")[0], recursive=True)
    with system.open_output_stream(temporary) as target:
        target.write(MAGIC)
        for f in footers:
            by = target.tell() - 4
            source_system, source_at = file_system(f.path)
            with source_system.open_input_file(source_at) as source:
                source.seek(4)
                left = f.blocks_end - 4
                while left:
                    block = source.read(min(COPY_BYTES, left))
                    if not block:
                        raise ValueError(f"{f.path}: shorter than its footer says")
                    target.write(block)
                    left -= len(block)
            groups += [_moved(g, by, len(groups) + i) for i, g in enumerate(f.groups) if g[3][1]]
        meta = dict(footers[0].meta)
        meta[3] = [I64, sum(f.rows for f in footers)]
        meta[4] = [LIST, (STRUCT, groups)]
        footer = _Writer()
        footer.value(STRUCT, meta)
        target.write(bytes(footer.out))
        target.write(struct.pack("<I4s", len(footer.out), MAGIC))
    wanted = sum(sum(1 for g in Footer(p).groups if g[3][1]) for p in paths)
    return _finished(system, temporary, at, footers, wanted, schema) | {"copied": True}


def _finished(system: fs.FileSystem, temporary: str, out: str, footers: list[Footer], blocks: int | None, schema: bytes | None) -> dict[str, int]:
    """Check a written file against its parts and give it its name; the wanted blocks and schema only where they were copied."""
    with system.open_input_file(temporary) as f:
        found = pq.read_metadata(f)
    size = system.get_file_info(temporary).size
    rows = sum(f.rows for f in footers)
    counted = sum(found.row_group(i).num_rows for i in range(found.num_row_groups))
    written = Footer(temporary) if schema is not None and isinstance(system, fs.LocalFileSystem) else None
    if found.num_rows != rows or counted != rows or (blocks is not None and found.num_row_groups != blocks) or (written is not None and written.schema != schema):
        system.delete_file(temporary)
        raise ValueError(f"{out}: the merged file doesn't hold what its parts hold")
    system.move(temporary, out)
    return {"n_files": len(footers), "n_blocks": found.num_row_groups, "n_rows": rows, "n_bytes": size}


def rewrite_files(paths: list[str], out: str, block_bytes: int = NEW_BLOCK) -> dict[str, int]:
    """Write the rows of files of one schema into ``out`` in blocks of about ``block_bytes`` of memory; for files of tiny blocks."""
    footers = [Footer(p) for p in paths]
    for f in footers[1:]:
        if f.schema != footers[0].schema:
            raise ValueError(f"{f.path}: its schema differs from that of {paths[0]}")
    system, at = file_system(out)
    temporary = f"{at}.{uuid.uuid4().hex}.part"
    system.create_dir(at.rpartition("/")[0], recursive=True)
    writer, held, size = None, [], 0
    for p in paths:
        source_system, source_at = file_system(p)
        with source_system.open_input_file(source_at) as source:
            part = pq.ParquetFile(source)
            if writer is None:
                codec = part.metadata.row_group(0).column(0).compression if part.metadata.num_row_groups and part.metadata.num_columns else "SNAPPY"
                schema = part.schema_arrow
                writer = pq.ParquetWriter(temporary, schema, filesystem=system, compression="none" if codec == "UNCOMPRESSED" else codec.lower())
            for batch in part.iter_batches():
                held.append(batch)
                size += batch.nbytes
                if size >= block_bytes:
                    writer.write_table(pa.Table.from_batches(held, schema), row_group_size=sum(map(len, held)))
                    held, size = [], 0
    if held:
        writer.write_table(pa.Table.from_batches(held, schema), row_group_size=max(1, sum(map(len, held))))
    writer.close()
    return _finished(system, temporary, at, footers, None, None) | {"copied": False}


def merge_folder(spark: SparkSession, source: str, out: str, target_bytes: int = 256 * 1024 * 1024, least_block: int = LEAST_BLOCK) -> DataFrame:
    """Consolidate the Parquet files below ``source`` into files of about ``target_bytes`` in ``out``.

    Both folders are on storage that all executors share. Spark lists the files, and the merged files
    are cut by running totals of their sizes in path order, so neither is held by the driver; one task
    makes one file. Returns out_file, n_files, n_blocks, n_rows, n_bytes, copied, one row for each
    merged file; files of different schemas never share one. Files whose blocks have under
    ``least_block`` bytes on average are written anew, all others copied. An empty folder gives no rows.
    """

    def described(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            footers = [Footer(p) for p in b["path"]]
            tiny = [f.blocks_end < least_block * max(1, len(f.groups)) and not f.has_int96 for f in footers]
            yield pd.DataFrame({"key": [hashlib.sha256(f.schema).hexdigest() for f in footers], "tiny": tiny, "path": b["path"], "size": [f.size for f in footers]})

    listed = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").load(source).select("path")
    files = checkpointed(listed.mapInPandas(described, "key string, tiny boolean, path string, size long"))
    placed = with_running_total(files, ["key", "tiny"], ["path"], "size", "before")
    groups = placed.groupBy("key", "tiny", F.floor(F.col("before") / int(target_bytes)).alias("bin")).agg(F.array_sort(F.collect_list("path")).alias("paths"))
    groups = checkpointed(groups)

    def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for key, tiny, n, paths in zip(b["key"], b["tiny"], b["bin"], b["paths"]):
                name = f"merged-{key[:12]}-{'new' if tiny else 'copy'}-{int(n):06d}.parquet"
                work = rewrite_files if tiny and len(paths) > 1 else merge_files
                yield pd.DataFrame([{"out_file": name, **work(list(paths), f"{out.rstrip('/')}/{name}")}])

    tasks = max(1, min(groups.count(), 20_000))
    return groups.repartition(tasks, "key", "tiny", "bin").mapInPandas(merge, "out_file string, n_files long, n_blocks long, n_rows long, n_bytes long, copied boolean")

"""Decompression of Zarr chunks: the plain codecs, the Blosc container, and value filters."""

from __future__ import annotations

import bz2
import lzma
import struct
import zlib
from typing import Any

import numpy as np
import pyarrow as pa

# Codecs of the Blosc container by the number in its flags, and the bits of these flags.
_BLOSC_CODECS = {1: "lz4", 2: "snappy", 3: "zlib", 4: "zstd"}
_SHUFFLED, _STORED, _BIT_SHUFFLED, _UNSPLIT = 1, 2, 4, 16
_BLOSC_HEADER = struct.Struct("<BBBBiii")

COMPRESSORS = ("zlib", "gzip", "bz2", "lzma", "zstd", "lz4", "blosc")
FILTERS = ("shuffle", "delta", "fixedscaleoffset")


def _inflate(codec: str, raw: bytes, size: int) -> bytes:
    if codec == "zlib":
        return zlib.decompress(raw)
    return pa.Codec({"lz4": "lz4_raw"}.get(codec, codec)).decompress(raw, size, asbytes=True)


def unshuffle(raw: bytes, width: int) -> bytes:
    """Bytes of elements that stand by their place in the element back in order; a rest shorter than an element follows as it is."""
    n = len(raw) // width
    whole = np.frombuffer(raw, np.uint8, n * width).reshape(width, n).T
    return whole.tobytes() + raw[n * width:]


def unshuffle_bits(raw: bytes, width: int) -> bytes:
    """The same for bits, over a multiple of eight elements; the others follow as they are."""
    n = len(raw) // width // 8 * 8
    planes = np.frombuffer(raw, np.uint8, n * width).reshape(8 * width, n // 8)
    bits = np.unpackbits(planes, axis=1, bitorder="little").T
    return np.packbits(bits, axis=1, bitorder="little").tobytes() + raw[n * width:]


def read_blosc(raw: bytes) -> bytes:
    """The content of a Blosc container (version 1): blocks, each in one part or one for each byte of an element."""
    _, _, flags, width, size, block, _ = _BLOSC_HEADER.unpack_from(raw)
    if flags & _STORED:
        return raw[16:16 + size]
    if flags >> 5 not in _BLOSC_CODECS:
        raise NotImplementedError(f"Blosc with codec {flags >> 5}")
    codec, out = _BLOSC_CODECS[flags >> 5], []
    count = -(-size // block) if block else 0
    for k, at in enumerate(struct.unpack_from(f"<{count}i", raw, 16)):
        length = min(block, size - k * block)
        parts = width if not flags & _UNSPLIT and length == block and width > 1 else 1
        held = []
        for _ in range(parts):
            n, = struct.unpack_from("<i", raw, at)
            part = raw[at + 4:at + 4 + n]
            held.append(part if n == length // parts else _inflate(codec, part, length // parts))
            at += 4 + n
        content = b"".join(held)
        if flags & _SHUFFLED and width > 1:
            content = unshuffle(content, width)
        elif flags & _BIT_SHUFFLED:
            content = unshuffle_bits(content, width)
        out.append(content)
    return b"".join(out)


def decompress(raw: bytes, compressor: dict[str, Any] | None) -> bytes:
    kind = (compressor or {}).get("id")
    if kind is None:
        return raw
    if kind in ("zlib", "gzip"):
        return zlib.decompress(raw, 15 + 32)
    if kind == "bz2":
        return bz2.decompress(raw)
    if kind == "lzma":
        return lzma.decompress(raw)
    if kind == "blosc":
        return read_blosc(raw)
    if kind == "lz4":  # the size stands before the block
        return _inflate("lz4", raw[4:], struct.unpack_from("<i", raw)[0])
    import zstandard

    return zstandard.ZstdDecompressor().decompressobj().decompress(raw)


def undo_filters(raw: bytes, filters: list[dict[str, Any]] | None, dtype: str) -> np.ndarray:
    """The values of a decompressed chunk, with its filters undone from the last to the first."""
    values: Any = raw
    for f in reversed(filters or []):
        if f["id"] == "shuffle":
            values = unshuffle(values if isinstance(values, bytes) else values.tobytes(), f.get("elementsize", 4))
        else:
            values = np.frombuffer(values, f.get("astype") or f["dtype"]) if isinstance(values, bytes) else values
            if f["id"] == "delta":
                values = np.cumsum(values, dtype=np.dtype(f["dtype"]))
            else:
                values = (values.astype("f8") / f["scale"] + f["offset"]).astype(f["dtype"])
    return np.frombuffer(values, dtype) if isinstance(values, bytes) else values

"""Whole Arrow batches of text as numpy byte arrays: words, hashes, per-document sums.

A *word* is a maximal run of bytes other than ASCII white space. All functions
take the concatenated UTF-8 bytes of a batch and the documents' offsets, so no
Python loop runs over words or characters.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes that are handled at once; a longer document is one block of its own.
BLOCK = 1 << 20
U = np.uint64
BASE = U(0x9E3779B97F4A7C15)
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_powers: dict[int, np.ndarray] = {}


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """Splitmix64 finaliser; ``salt`` gives independent hashes of the same keys."""
    with np.errstate(over="ignore"):
        x = x + U((0x9E3779B97F4A7C15 * (salt + 1)) & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
        return x ^ (x >> U(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and its inverse modulo 2**64, for i below n at least."""
    if _powers.get(0) is None or len(_powers[0]) < n:
        size = max(n, BLOCK + 4096)
        inverse = U(pow(int(BASE), -1, 1 << 64))
        for key, factor in ((0, BASE), (1, inverse)):
            p = np.full(size, factor, U)
            p[0] = 1
            with np.errstate(over="ignore"):
                _powers[key] = np.cumprod(p, dtype=U)
    return _powers[0], _powers[1]


def column(batch: pa.RecordBatch | pa.Table, name: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, offsets, is valid) of a string column; a null is an empty text that isn't valid."""
    array = batch.column(batch.schema.get_field_index(name))
    return strings(array)


def strings(array: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    valid = np.asarray(array.is_valid()) if array.null_count else np.ones(len(array), bool)
    if array.null_count:
        array = pc.fill_null(array, "")
    wide = pa.types.is_large_string(array.type)
    _, offs, data = array.buffers()
    if len(array) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64), valid
    offsets = np.frombuffer(offs, np.int64 if wide else np.int32)[array.offset : array.offset + len(array) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0], valid


def blocks(offsets: np.ndarray, size: int = BLOCK) -> Iterator[tuple[int, int]]:
    """Ranges of documents whose bytes come to ``size`` or, where one document is longer, that document."""
    at, n = 0, len(offsets) - 1
    while at < n:
        end = int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1
        end = min(n, max(at + 1, end))
        yield at, end
        at = end


def characters(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of UTF-8 bytes, and the offsets counted in them."""
    if not len(data) or data.max() < 128:
        return data, offsets
    first = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=first[1:])
    return np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32), first[offsets]


def blank(data: np.ndarray) -> np.ndarray:
    """Which bytes or code points are ASCII white space."""
    return SPACE[data] if data.dtype == np.uint8 else (data <= 32) & SPACE[np.minimum(data, 255)]


def spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first byte, byte after the last, first word of each document and the count of all) of the words."""
    if len(data) == 0:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    solid = ~blank(data)
    cut = np.zeros(len(data) + 1, bool)
    cut[offsets] = True
    first = solid.copy()
    first[1:] &= ~solid[:-1] | cut[1:-1]
    last = solid.copy()
    last[:-1] &= ~solid[1:] | cut[1:-1]
    starts = np.flatnonzero(first)
    ends = np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def prefix(data: np.ndarray) -> np.ndarray:
    """Prefix polynomial hashes modulo 2**64: entry i covers the first i bytes."""
    p, _ = powers(len(data))
    out = np.zeros(len(data) + 1, U)
    with np.errstate(over="ignore"):
        np.cumsum((data.astype(U) + U(1)) * p[: len(data)], out=out[1:])
    return out


def span_hash(h: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Mixed hash of each span's bytes, the same wherever the span lies."""
    _, inverse = powers(len(h))
    with np.errstate(over="ignore"):
        return mix((h[ends] - h[starts]) * inverse[starts])


def total(values: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """Sums of the runs values[firsts[i]:firsts[i + 1]]; an empty run gives 0."""
    kind = np.float64 if values.dtype.kind == "f" else np.int64
    sums = np.zeros(len(values) + 1, kind)
    np.cumsum(values, out=sums[1:])
    return sums[firsts[1:]] - sums[firsts[:-1]]


def maxima(values: np.ndarray, firsts: np.ndarray, empty: float) -> np.ndarray:
    """Row-wise maxima of the runs of ``values`` (rows first); an empty run gives ``empty``."""
    out = np.full((len(firsts) - 1, *values.shape[1:]), empty, values.dtype)
    full = firsts[1:] > firsts[:-1]
    if full.any():
        out[full] = np.maximum.reduceat(values, firsts[:-1][full], axis=0)
    return out

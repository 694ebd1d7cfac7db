"""Arrow batches of texts inside tasks: slices of bounded size, words as codes into a table of distinct words."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SPACES = np.zeros(256, bool)
SPACES[[9, 10, 11, 12, 13, 32]] = True

SLICE_BYTES = 6_000_000
"""Texts handled at once in a task; a longer single text is a slice of its own."""


class Words(NamedTuple):
    codes: np.ndarray
    """Index into `table` of every word of all texts, in order."""
    table: pa.Array
    """Distinct words (binary)."""
    offsets: np.ndarray
    """First word of each text, and at the end the number of words."""
    begins: np.ndarray
    """First byte of each word in `data`."""
    data: np.ndarray
    """Bytes of all texts."""


def filled(texts: pa.Array) -> pa.Array:
    """Texts as an Arrow binary array without nulls (null: empty)."""
    return texts.cast(pa.binary()).fill_null(b"") if texts.type != pa.binary() else texts.fill_null(b"")


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts one after the other, and where each text begins; the end comes last."""
    _, offsets, data = texts.buffers()
    ends = np.frombuffer(offsets, np.int32)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[ends[0] : ends[-1]], (ends - ends[0]).astype(np.int64)


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of every maximal run of true bytes; a run never crosses the border of two texts."""
    n = len(inside)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    border = np.zeros(n + 1, bool)
    border[offsets] = True
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | border[1:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | border[1:-1]
    return np.flatnonzero(begins), np.flatnonzero(ends) + 1


def distinct(data: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """Codes of the byte ranges and the table of distinct ranges. Ranges are in order and do not overlap."""
    if len(begins) == 0:
        return np.zeros(0, np.int32), pa.array([], pa.binary())
    bounds = np.empty(2 * len(begins), np.int32)
    bounds[0::2], bounds[1::2] = begins, ends
    # Ranges and the gaps between them alternate; only the codes of the ranges are kept.
    both = pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(data))])
    found = both.dictionary_encode()
    return found.indices.to_numpy()[0::2], found.dictionary


def words(texts: pa.Array) -> Words:
    """Words are maximal runs of bytes that are not white space (`[\\x20\\x09-\\x0D]`)."""
    data, offsets = buffers(texts)
    begins, ends = runs(~SPACES[data], offsets)
    codes, table = distinct(data, begins, ends)
    return Words(codes, table, np.searchsorted(begins, offsets), begins, data)


def gather(flat: np.ndarray, offsets: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The lists `flat[offsets[c]:offsets[c + 1]]` of all codes one after the other, and where each begins."""
    lengths = (offsets[1:] - offsets[:-1])[codes]
    at = np.concatenate(([0], np.cumsum(lengths)))
    index = np.repeat(offsets[:-1][codes] - at[:-1], lengths) + np.arange(at[-1])
    return flat[index], at


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Batches cut so that the texts of a slice hold about `limit` bytes at most."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        sizes = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        group = np.cumsum(sizes) // limit
        cuts = np.flatnonzero(np.diff(group)) + 1
        for low, high in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
            if high > low:
                yield batch.slice(low, high - low)
        pa.default_memory_pool().release_unused()


def give_back() -> None:
    """Returns what a task no longer needs to the machine: workers outlive tasks, and the next stage needs the memory."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def mix(x: np.ndarray) -> np.ndarray:
    """Scrambles 64-bit integers one to one."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))

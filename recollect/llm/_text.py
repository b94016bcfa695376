"""Byte-level helpers shared by the operators; all work on Arrow columns inside tasks."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

#: Lower-cases A-Z and nothing else.
LOWER_AZ = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")

#: The six white-space bytes of ``[\x20\x09-\x0D]``; ``bytes.split()`` splits on the same set.
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, underscores added to those that ``df`` has a column of."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def string_column(batch: pa.RecordBatch, name: str) -> pa.Array:
    """The column with nulls as empty strings and 64-bit offsets."""
    column = batch.column(batch.schema.get_field_index(name))
    return pc.fill_null(column.cast(pa.large_string()), "")


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of a large_string or large_binary array without nulls; offsets start at 0."""
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return offsets - offsets[0], raw[offsets[0] : offsets[-1]]


def gives_back() -> None:
    """From now on what this process frees goes back to the system: Arrow's pool, and malloc as it is set, hold back some 50 MB of a shard."""
    pa.set_memory_pool(pa.system_memory_pool())
    if mallopt := getattr(ctypes.CDLL(None), "mallopt", None):  # glibc only
        mallopt(-3, 1 << 20)  # M_MMAP_THRESHOLD, which else grows to 32 MB


def slices(offsets: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes each; a longer row is a range of its own."""
    first, rows = 0, len(offsets) - 1
    while first < rows:
        last = int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1
        last = min(max(last, first + 1), rows)
        yield first, last
        first = last


def distinct(values: np.ndarray) -> np.ndarray:
    """The distinct values, ascending, by sorting."""
    values = np.sort(values)
    return values[np.concatenate([[True], values[1:] != values[:-1]])] if len(values) else values


def word_counts(column: pa.Array, limit: int = 8_000_000) -> np.ndarray:
    """Number of ``[^\\x20\\x09-\\x0D]+`` in each text."""
    offsets, data = buffers(column)
    out = np.zeros(len(column), np.int64)
    for first, last in slices(offsets, limit):
        lo, hi = offsets[first], offsets[last]
        word = ~_SPACE[data[lo:hi]]
        start = word.copy()
        start[1:] &= ~word[:-1]
        heads = offsets[first:last] - lo
        heads = heads[heads < hi - lo]
        start[heads] = word[heads]
        at = np.flatnonzero(start)
        out[first:last] = np.diff(np.searchsorted(at, offsets[first : last + 1] - lo))
    return out


def words(text: bytes) -> list[bytes]:
    """The words of a text, A-Z lower-cased."""
    return text.translate(LOWER_AZ).split()

"""Vectorised helpers over Arrow text columns.

The functions work on the raw bytes of a batch, so that a task touches each byte a few times in numpy and never
loops over characters in Python.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession

BATCH_ROWS = 1000
CHUNK_BYTES = 1 << 20

# Multipliers of the splitmix64 finaliser.
MIX_1 = np.uint64(0xBF58476D1CE4E5B9)
MIX_2 = np.uint64(0x94D049BB133111EB)
# An odd base of the polynomial hashes, and its inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
BASE_INVERSE = pow(BASE, -1, 1 << 64)


def bounded_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Let Python workers get at most ``rows`` rows at a time, since texts may be long (a session setting)."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key, "10000")) <= rows:
        spark.conf.set(key, str(rows))


# What operators keep in a Python worker, by operator: the functions that let go of it.
KEPT: dict[str, Callable[[], None]] = {}
# The operator that ran last in this worker.
_LAST: list[str | None] = [None]


def alone(operator: str) -> None:
    """Called where a task of an operator begins: the worker lets go of what other operators have kept in it.

    Spark reuses Python workers, so without this a pipeline would hold the caches of all its stages at once.  Freed
    memory goes back to the system, since the C library would keep it for this worker.
    """
    for other, release in KEPT.items():
        if other != operator:
            release()
    if _LAST[0] not in (None, operator):
        Powers.up = Powers.down = np.ones(1, np.uint64)
        gc.collect()
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
        if trim is not None:
            trim(0)
    _LAST[0] = operator


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * MIX_1
    x = (x ^ (x >> np.uint64(27))) * MIX_2
    return x ^ (x >> np.uint64(31))


class Powers:
    """Powers of the hash base and of its inverse, grown on demand and kept by the worker."""

    up = np.ones(1, np.uint64)
    down = np.ones(1, np.uint64)

    @classmethod
    def of(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            size = max(n, CHUNK_BYTES)
            for name, base in (("up", BASE), ("down", BASE_INVERSE)):
                table = np.full(size, base, np.uint64)
                table[0] = 1
                setattr(cls, name, np.cumprod(table, dtype=np.uint64))
        return cls.up[:n], cls.down[:n]


class SpanHasher:
    """64-bit hashes of spans of ``values``; equal spans have equal hashes wherever they stand."""

    def __init__(self, values: np.ndarray) -> None:
        up, self._down = Powers.of(len(values) + 1)
        self._sums = np.zeros(len(values) + 1, np.uint64)
        terms = (values.astype(np.uint64) + np.uint64(1)) * up[: len(values)]
        np.cumsum(terms, out=self._sums[1:], dtype=np.uint64)

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self._sums[ends] - self._sums[starts]) * self._down[starts])


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return SpanHasher(values).of(starts, ends)


class Slots:
    """Finds distinct 64-bit keys by open addressing."""

    def __init__(self, keys: np.ndarray) -> None:
        # Entry 0 is no key; a key whose slot is taken goes into the next free one.
        self._keys = np.concatenate([np.zeros(1, np.uint64), keys.astype(np.uint64)])
        bits = max(4, 3 + len(keys).bit_length())
        self._shift = np.uint64(64 - bits)
        self._entries = np.zeros((1 << bits) + len(keys) + 1, np.int32)
        for entry, slot in enumerate(self._slot(self._keys[1:]).tolist(), 1):
            while self._entries[slot]:
                slot += 1
            self._entries[slot] = entry

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * MIX_1) >> self._shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """For each key its place among those given at first, from 1, or 0."""
        slot = self._slot(keys)
        entry = self._entries[slot]
        wrong = np.flatnonzero((entry > 0) & (self._keys[entry] != keys))
        while len(wrong):
            # A free slot ends the search, a taken one leads to the next.
            slot[wrong] += 1
            entry[wrong] = self._entries[slot[wrong]]
            wrong = wrong[(entry[wrong] > 0) & (self._keys[entry[wrong]] != keys[wrong])]
        return entry


def texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a text column; null is empty."""
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type)
    raw = column.buffers()
    offsets = np.frombuffer(raw[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(raw[2], np.uint8) if raw[2] is not None else np.zeros(0, np.uint8)
    return data, offsets.astype(np.int64)


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Runs of whole texts of about ``limit`` bytes: (index of the first text, bytes, offsets from 0)."""
    data, offsets = texts(column)
    first, n = 0, len(offsets) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1)
        yield first, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def word_spans(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of True that don't cross a text: starts, ends, index of the text."""
    if not len(inside):
        none = np.zeros(0, np.int64)
        return none, none, none
    cut = np.zeros(len(inside) + 1, bool)
    cut[offsets] = True
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1] | cut[1:-1]
    ends[:-1] &= ~inside[1:] | cut[1:-1]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(ends) + 1, np.searchsorted(offsets, starts, "right") - 1


def lists(rows: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    """An Arrow list column from one array per row."""
    offsets = np.zeros(len(rows) + 1, np.int32)
    np.cumsum([len(r) for r in rows], out=offsets[1:])
    flat = np.concatenate(rows) if rows else np.zeros(0)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, kind))


# Bytes lower-cased in A-Z only.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
# Bytes that are not white space (space, tab, line feed, vertical tab, form feed, carriage return).
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[32, 9, 10, 11, 12, 13]] = False

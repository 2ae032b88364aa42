"""Helpers that several operators of this subpackage share.

Text is processed as UTF-8 bytes, a whole Arrow batch at a time: a batch's strings lie back to
back in one buffer, so splitting and hashing are a few numpy passes, not a loop over rows.
"""

from __future__ import annotations

import contextlib
import ctypes
import re
import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession

#: Text that numpy works on at a time; its arrays take some 50 bytes for each.
CHUNK_BYTES = 2 << 20

_ALL = np.uint64(0xFFFFFFFFFFFFFFFF)
SALT = 0x3C6EF372FE94F82B
#: Longer spans are hashed one by one.
LONG = 128


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder that spark.checkpoint.dir names. Only where all runs on one machine may it be
    unset, and is then a new folder of that machine."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not re.match(r"local(\[|$)", sc.master):
            raise ValueError("spark.checkpoint.dir is not set; it has to name a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp())
    return sc.getCheckpointDir()


def settled(df: DataFrame) -> DataFrame:
    """df written to the shared checkpoint folder: cuts lineage and survives lost executors."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint()


_resident: dict[str, object] = {}


def resident(key: str, make: Callable[[], object]) -> object:
    """What make returns, made once in a worker and kept until another key is asked for."""
    if key not in _resident:
        tidy(key)
        _resident[key] = make()
    return _resident[key]


def tidy(keep: str | None = None) -> None:
    """Drops what earlier jobs left resident, and gives memory that the allocators hold on to back to
    the system. A Python worker serves the tasks of many jobs, and what each has touched would add up
    beside the executor's heap."""
    if keep not in _resident:
        _resident.clear()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def tasks(spark: SparkSession) -> int:
    """How many partitions a shuffle has."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def texts_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and the rows' offsets into them; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if data is None or at[-1] == at[0]:
        return np.zeros(0, np.uint8), at - at[0]
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def chunks(batch: pa.RecordBatch, text: str = "text", limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive slices of a batch with about limit bytes of text each; a longer text is one slice."""
    at = texts_of(batch.column(batch.schema.get_field_index(text)))[1]
    start = 0
    while start < batch.num_rows:
        end = max(start + 1, int(np.searchsorted(at, at[start] + limit, "right")) - 1)
        yield batch.slice(start, end - start)
        start = end


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit numbers (an invertible xor-shift and multiply finish)."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes in each span, eight at a time; equal spans anywhere have equal hashes.

    Different spans may share one, so what decides on equality compares bytes as well: identities()
    within an array, same_bytes() between two.
    """
    n = ends - starts
    h = mix(n.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(SALT))
    if not len(n):
        return h
    eights = eight_bytes(data)
    for at in range(0, min(LONG, int(n.max())), 8):
        own = np.flatnonzero((n > at) & (n <= LONG)) if at else np.flatnonzero((n > 0) & (n <= LONG))
        left = np.minimum(n[own] - at, 8).astype(np.uint64)
        h[own] = mix(h[own] ^ (eights[starts[own] + at] & (_ALL >> (np.uint64(64) - np.uint64(8) * left))))
    for i in np.flatnonzero(n > LONG).tolist():
        h[i] = xxhash.xxh64_intdigest(data[starts[i] : ends[i]].tobytes(), SALT)
    return h


def eight_bytes(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as one number, the first lowest; zeros follow the end."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    return np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))


def same_bytes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, other: np.ndarray, other_starts: np.ndarray, other_ends: np.ndarray) -> np.ndarray:
    """Whether each span of data equals, byte for byte, the span of other at the same number."""
    same = (ends - starts) == (other_ends - other_starts)
    left, right = eight_bytes(data), eight_bytes(other)
    open_ = np.flatnonzero(same & (ends > starts))
    at = 0
    while len(open_):
        n = np.minimum(ends[open_] - starts[open_] - at, 8).astype(np.uint64)
        differ = (left[starts[open_] + at] ^ right[other_starts[open_] + at]) & (_ALL >> (np.uint64(64) - np.uint64(8) * n))
        same[open_[differ != 0]] = False
        at += 8
        open_ = open_[(differ == 0) & (ends[open_] - starts[open_] > at)]
        if len(open_) < 64:  # few long ones: each at once
            for i in open_.tolist():
                same[i] = np.array_equal(data[starts[i] + at : ends[i]], other[other_starts[i] + at : other_ends[i]])
            break
    return same


def identities(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For the distinct spans, which span is the first of each; and for every span, the number of its
    distinct one. Spans are equal only if their bytes are, whatever their hashes."""
    _, first, inverse = np.unique(span_hashes(data, starts, ends), return_index=True, return_inverse=True)
    if same_bytes(data, starts, ends, data, starts[first][inverse], ends[first][inverse]).all():
        return first, inverse
    raw, seen = data.tobytes(), {}
    numbers = np.array([seen.setdefault(raw[s:e], len(seen)) for s, e in zip(starts.tolist(), ends.tolist(), strict=True)], np.int64)
    return np.unique(numbers, return_index=True)[1], numbers


def spans(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True, none of them across a row's boundary."""
    if not len(inside):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = np.ones(len(inside) + 1, bool)
    first[1:-1] = inside[1:] != inside[:-1]
    cuts = offsets[(offsets > 0) & (offsets < len(inside))]
    first[cuts] = True
    edges = np.flatnonzero(first)
    on = inside[edges[:-1]]
    return edges[:-1][on], edges[1:][on]


def row_of(starts: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The row that each byte position lies in."""
    return np.searchsorted(offsets, starts, "right") - 1


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes that end a word: blank and tab to carriage return.
BLANK = np.zeros(256, bool)
BLANK[[32, *range(9, 14)]] = True

"""Whole texts as numpy arrays: Arrow batches cut into pieces of bounded size, and words found and hashed without a Python loop.

A word is a run of bytes other than U+0020 and U+0009 to U+000D. Only A-Z are lower-cased, so lengths never change.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

#: Bytes of text that arrays are made of at a time: they then stay in a core's cache.
PIECE = 1 << 18

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IS_WORD = np.ones(256, dtype=bool)
IS_WORD[[32, 9, 10, 11, 12, 13]] = False

#: An odd multiplier and its inverse modulo 2**64: hashes of words are differences of one running sum.
_MULTIPLIER = 0x9E3779B97F4A7C15
_INVERSE = pow(_MULTIPLIER, -1, 1 << 64)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def bounded(docs: DataFrame) -> DataFrame:
    """``docs``, for a session whose Arrow batches are small: a worker holds a few megabytes of text, not ten thousand rows."""
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))
    return docs


def tidy() -> None:
    """Give freed memory back to the system. Workers live on between tasks, and what they hold idle counts as used."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def pieces(batches: Iterator[pa.RecordBatch], column: str, max_bytes: int = PIECE) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``max_bytes`` of text; a longer text comes alone. Nulls of ``column`` become empty."""
    for batch in batches:
        if not batch.num_rows:
            continue
        at = batch.schema.get_field_index(column)
        text = pc.fill_null(batch.column(at), "").cast(pa.large_string())
        batch = batch.set_column(at, pa.field(column, pa.large_string()), text)
        ends = np.frombuffer(text.buffers()[1], dtype=np.int64)[text.offset + 1 : text.offset + 1 + len(text)]
        first, base = 0, int(ends[0]) - len(text[0].as_buffer())
        while first < len(text):
            last = max(first + 1, int(np.searchsorted(ends, base + max_bytes, side="right")))
            yield batch.slice(first, last - first)
            first, base = last, int(ends[last - 1])
    tidy()


def raw(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, one after the other, and where each begins and the last ends."""
    offsets = np.frombuffer(text.buffers()[1], dtype=np.int64)[text.offset : text.offset + len(text) + 1]
    data = text.buffers()[2]
    whole = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def spans(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray = IS_WORD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word, and the index of its text. Words never cross texts."""
    inside = np.zeros(len(data) + 2, dtype=bool)
    inside[1:-1] = is_word[data]
    begins = inside[1:-1] & ~inside[:-2]
    finishes = inside[1:-1] & ~inside[2:]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    begins[cuts] |= inside[1:-1][cuts]
    finishes[cuts - 1] |= inside[1:-1][cuts - 1]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(finishes) + 1
    return starts, ends, np.searchsorted(offsets[1:], starts, side="right")


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def _grown(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) <= n:
        for k, step in enumerate((_MULTIPLIER, _INVERSE)):
            steps = np.full(n + 1, step, np.uint64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers[0], _powers[1]


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of ``data[start:end]`` for each span, by one running sum over all bytes."""
    up, down = _grown(len(data))
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts])


def signed(h: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(h).view(np.int64)

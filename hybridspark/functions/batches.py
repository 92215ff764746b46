"""What a Python worker holds at a time: Arrow batches bounded by bytes, slices of them, and tokens of a slice without a Python object for each."""

from __future__ import annotations

import ctypes
import functools
import unicodedata
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession

#: Bytes of an Arrow batch, and characters of a slice of one; a longer row comes alone.
BATCH_BYTES, SLICE = 4 << 20, 1 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def bounded(spark: SparkSession | None = None) -> None:
    """Bounds the session's Arrow batches at BATCH_BYTES, unless they are bounded lower; the setting stays."""
    spark = spark or SparkSession.getActiveSession()
    if spark is None:
        return
    now = spark.conf.get(_BATCH).lower().removesuffix("b")
    if not 0 < int(now if now.lstrip("-").isdigit() else 1 << 62) <= BATCH_BYTES:
        spark.conf.set(_BATCH, str(BATCH_BYTES))


def tidy() -> None:
    """Gives memory that a task no longer needs back to the system; reused workers would keep it."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # no such call in this C library
        pass


def slices(texts: Sequence[str]) -> Iterator[tuple[int, int]]:
    """(from, to) of neighbours of together about SLICE characters."""
    a = size = 0
    for b, t in enumerate(texts):
        if size and size + len(t) > SLICE:
            yield a, b
            a, size = b, 0
        size += len(t)
    if a < len(texts):
        yield a, len(texts)


@functools.cache
def word_points() -> np.ndarray:
    r"""Which code points ``\w`` matches."""
    return np.fromiter((c == 95 or chr(c).isalnum() for c in range(0x110000)), bool, 0x110000)


@functools.cache
def search_points() -> np.ndarray:
    """Which code points search tokens are made of: letters, numbers, marks and those of private use."""
    kinds = (unicodedata.category(chr(c)) for c in range(0x110000))
    return np.fromiter((k[0] in "LNM" or k == "Co" for k in kinds), bool, 0x110000)


def runs(texts: Sequence[str], points: np.ndarray) -> tuple[pa.StringArray, np.ndarray]:
    """The longest runs of ``points`` in each text, in order, and for each the number of its text."""
    n = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    code = np.frombuffer((" ".join(texts) + " ").encode("utf-32-le", "surrogatepass"), np.uint32)
    keep = points[code]
    begin = np.flatnonzero(keep & ~np.concatenate([[False], keep[:-1]]))
    end = np.flatnonzero(keep & ~np.concatenate([keep[1:], [False]])) + 1
    row = np.searchsorted(np.cumsum(n), begin, side="right")
    held = code[keep]
    offsets = np.concatenate([[0], np.cumsum(end - begin)])
    if len(held) and held.max() >= 0x80:  # bytes, not characters
        width = 1 + (held >= 0x80).astype(np.int8) + (held >= 0x800) + (held >= 0x10000)
        offsets = np.concatenate([[0], np.cumsum(width, dtype=np.int64)])[offsets]
    data = held.tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass")
    return pa.StringArray.from_buffers(len(begin), pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data)), row

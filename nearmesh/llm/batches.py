"""Record batches of texts in pieces of bounded size."""

from __future__ import annotations

import contextlib
import ctypes

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that a Python worker turns into objects at a time.
SLICE_BYTES = 4 << 20


def cuts(texts: pa.Array, most: int = SLICE_BYTES):
    """(begin, length) of runs of about ``most`` bytes each; nulls have no bytes."""
    ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(texts), 0), dtype=np.int64))
    if len(ends):
        begins = np.concatenate(([0], np.flatnonzero(np.diff(ends // most)) + 1, [len(ends)]))
        yield from zip(begins[:-1].tolist(), np.diff(begins).tolist())


def slices(batches, column: int, most: int = SLICE_BYTES):
    """The batches in runs of about ``most`` bytes of a text column; memory that Arrow holds free goes back at the end."""
    for batch in batches:
        for begin, length in cuts(batch.column(column), most):
            yield batch.slice(begin, length)
    give_back()


def give_back() -> None:
    """Return free memory of this worker to the system: workers stay idle between tasks beside the executor's JVM."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # no C library that can
        ctypes.CDLL(None).malloc_trim(0)

"""Words of many texts at once, in Arrow and numpy, with memory bounded by parts of a few MB."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are split at a time.
SLICE = 4 << 20


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Words between ASCII white space, one after another, and offsets: text i has those from ``offsets[i]`` to ``offsets[i + 1]``.

    Nulls and blank texts have no words.
    """
    lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    words, offsets = lists.flatten(), lists.offsets.to_numpy().astype(np.int64)
    offsets -= offsets[0]
    real = pc.binary_length(words).to_numpy(zero_copy_only=False) > 0  # white space at an end leaves an empty word
    if not real.all():
        words, offsets = words.filter(pa.array(real)), np.r_[0, np.cumsum(real)][offsets]
    return words, offsets


def gather(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Indices of runs, one after another."""
    ends = np.cumsum(size)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - ends + size, size)


def slices(batches: Iterator[pa.RecordBatch], text: int) -> Iterator[pa.RecordBatch]:
    """Parts of the batches with a bounded number of bytes in the column ``text``, or one row."""
    for b in batches:
        if not b.num_rows:
            continue
        sizes = np.cumsum(pc.fill_null(pc.binary_length(b.column(text)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        i = 0
        while i < b.num_rows:
            j = max(i + 1, int(np.searchsorted(sizes, (sizes[i - 1] if i else 0) + SLICE, side="right")))
            yield b.slice(i, j - i)
            i = j
    give_back()


def give_back() -> None:
    """Return freed memory to the system at the end of a task: workers stay alive for tasks of other operators."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc
    if trim:
        trim(0)

"""Letters of Arrow strings as numbers, without a Python object for each string."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def letters(strings: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all strings one after another, and the size of each; a null counts as empty."""
    own = strings.combine_chunks() if isinstance(strings, pa.ChunkedArray) else strings
    own = own.cast(pa.large_binary())
    own = own.fill_null(b"") if own.null_count else own
    if not len(own):
        return np.zeros(0, np.uint8), np.zeros(0, np.int64)
    _, offsets, data = own.buffers()
    at = np.frombuffer(offsets, np.int64)[own.offset : own.offset + len(own) + 1]
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and data.size else np.zeros(0, np.uint8), np.diff(at)

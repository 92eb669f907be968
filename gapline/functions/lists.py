"""Arrow lists in tasks: their sizes, the distinct values they hold, slices of them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def kinds_of(flat: pa.Array) -> tuple[list[str], np.ndarray]:
    """The distinct values, and the place of each value in them."""
    coded = flat.dictionary_encode()
    return coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)


def sizes_of(lists: pa.Array) -> np.ndarray:
    return np.array(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False), np.int64)


def firsts_of(sizes: np.ndarray) -> np.ndarray:
    """Whether a value is the first of its list."""
    out = np.zeros(int(sizes.sum()), bool)
    out[(np.cumsum(sizes) - sizes)[sizes > 0]] = True
    return out


def lists_of(flat: pa.Array, sizes: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), flat)


def cuts(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Begins and ends of runs of lists with at most ``most`` values, or of one list."""
    at, held = 0, 0
    for k, n in enumerate(sizes.tolist()):
        if held + n > most and k > at:
            yield at, k
            at, held = k, 0
        held += n
    if len(sizes) > at or not len(sizes):
        yield at, len(sizes)

"""Arrays of glyphs in Arrow batches: their fields, their order, and texts of runs of letters."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def owners(held: pa.Array) -> np.ndarray:
    """For each element of a list column its row; null lists are empty."""
    return np.repeat(np.arange(len(held)), held.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))


def numbers(values: pa.StructArray, *names: str) -> list[np.ndarray]:
    """Fields as arrays of numbers, nan for null."""
    return [values.field(c).to_numpy(zero_copy_only=False) for c in names]


def ranks(ch: pa.Array) -> np.ndarray:
    """The place of each letter in the order of all, by code point."""
    known = ch.dictionary_encode()
    place = np.argsort(pc.sort_indices(known.dictionary).to_numpy())
    return np.append(place, -1)[known.indices.fill_null(len(place)).to_numpy(zero_copy_only=False)]


def texts(ch: pa.Array, bounds: np.ndarray) -> pa.Array:
    """The letters from each bound to the next as one text."""
    if len(bounds) < 2:
        return pa.array([], pa.string())
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), ch), "").cast(pa.string())

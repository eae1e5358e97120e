"""A filter of bounded size over 64-bit values, built by Spark and broadcast: it stays below 16 MB however many they are.

It only saves work: what passes by chance is sorted out later, and if it fills up everything passes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from glossaria.llm.common import small_batches
from glossaria.llm.hashing import mix

BITS = 27  # of the whole filter at most, as a power of two: 16 MB
BITS_A_VALUE = 5  # as a power of two, where the values are counted and few
SLICES = 8  # as a power of two
PROBES = 4


def _places(values: np.ndarray, width: int) -> Iterator[np.ndarray]:
    """Bit numbers, of `width` bits, within the slice that the top bits of a value name."""
    step = mix(values)
    for k in range(PROBES):
        yield ((step + np.uint64(k) * (values | np.uint64(1))) >> np.uint64(17)) & np.uint64((1 << width) - 1)


def build(values: DataFrame, column: str, counted: bool = False) -> np.ndarray:
    """Bits of the distinct values of a long column. With `counted`, for written values, few of them make a small filter."""
    n = values.count() if counted else 1 << BITS
    width = min(BITS, max(n - 1, 1).bit_length() + BITS_A_VALUE) - SLICES
    width = max(width, 6)

    def fill(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(1 << width, bool)
        for batch in batches:
            for at in _places(batch.column("value").to_numpy().view(np.uint64), width):
                bits[at] = True
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([np.packbits(bits).tobytes()], pa.binary())], names=["slice", "bits"])

    small_batches(values.sparkSession)
    sliced = values.select(F.shiftrightunsigned(column, 64 - SLICES).cast("int").alias("slice"), F.col(column).alias("value"))
    found = sliced.groupBy("slice").applyInArrow(fill, "slice int, bits binary").collect()  # 2**SLICES rows of fixed size at most
    out = np.zeros((1 << SLICES, 1 << (width - 3)), np.uint8)
    for row in found:
        out[row["slice"]] = np.frombuffer(row["bits"], np.uint8)
    return out


def passing(bits: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Which of the values may be in the filter."""
    part = (values >> np.uint64(64 - SLICES)).astype(np.int64)
    ok = np.ones(len(values), bool)
    for at in _places(values, (bits.shape[1] * 8).bit_length() - 1):
        ok &= (bits[part, (at >> np.uint64(3)).astype(np.int64)] >> (np.uint64(7) - (at & np.uint64(7))).astype(np.uint8)) & 1 == 1
    return ok


def passes(bits, names: Column) -> Column:
    """Whether a long may be in a broadcast filter; only the names go to Python, other columns stay where they are."""

    @F.arrow_udf("boolean")
    def check(x: pa.Array) -> pa.Array:
        return pa.array(passing(bits.value, x.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)))

    return check(names)

"""Which hashed slots hold more than one value, found in a few bytes a value.

Values are 64-bit hashes; a slot is so many of their top bits. Tasks emit the slots of a part as packed bytes, and one
task a part marks what it meets again, in memory that doesn't depend on how much it meets.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from glossaria.llm.hashing import mix

SLOT_BITS = 22  # slots within a part
SPARE_BITS = 6  # slots are so many times the values, as a power of two


def part_bits(texts: DataFrame, bytes_a_value: float) -> int:
    """Parts that tasks mark on their own, as a power of two: so many that slots outnumber the values of all texts."""
    total = texts.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    return min(30, max(4, math.ceil(math.log2(total / bytes_a_value + 1)) + SPARE_BITS - SLOT_BITS))


def slots_of(values: np.ndarray, bits: int) -> np.ndarray:
    return values >> np.uint64(64 - bits - SLOT_BITS)


def named(slots: np.ndarray) -> np.ndarray:
    """Slots spread over 64 bits, for a filter."""
    return mix(slots.astype(np.uint64) + np.uint64(1))


def packed(values: np.ndarray, owners: np.ndarray, bits: int) -> pa.RecordBatch:
    """part, slots: a slot once for each owner in it, twice at most."""
    slot = slots_of(values, bits)
    spare = np.uint64(64 - bits - SLOT_BITS)
    if len(slot) and int(owners.max()) < 1 << int(spare):  # both in one number, which is quicker to sort
        key = np.sort(slot << spare | owners.astype(np.uint64))
        slot = key[np.concatenate([[True], key[1:] != key[:-1]])] >> spare
    elif len(slot):
        order = np.lexsort((owners, slot))
        slot, owner = slot[order], owners[order]
        slot = slot[np.concatenate([[True], (slot[1:] != slot[:-1]) | (owner[1:] != owner[:-1])])]
    if len(slot) > 2:
        slot = slot[np.concatenate([[True, True], slot[2:] != slot[:-2]])]
    part = (slot >> np.uint64(SLOT_BITS)).astype(np.int32)
    data = (slot & np.uint64((1 << SLOT_BITS) - 1)).astype("<u4").view(np.uint8).reshape(-1, 4)[:, :3].tobytes()
    edge = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1], [True]])) if len(part) else np.zeros(1, np.int64)
    blobs = [data[3 * x : 3 * y] for x, y in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)]
    return pa.RecordBatch.from_arrays([pa.array(part[edge[:-1]]), pa.array(blobs, pa.binary())], names=["part", "slots"])


def _mark(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    once, twice = np.zeros(1 << SLOT_BITS, bool), np.zeros(1 << SLOT_BITS, bool)
    for batch in batches:
        for blob in batch.column("slots").to_pylist():
            three = np.frombuffer(blob, np.uint8).reshape(-1, 3).astype(np.int64)
            at = three[:, 0] | three[:, 1] << 8 | three[:, 2] << 16
            twice[at[once[at]]] = True
            twice[at[1:][at[1:] == at[:-1]]] = True
            once[at] = True
    found = named(np.flatnonzero(twice) | key[0].as_py() << SLOT_BITS).view(np.int64)
    for a in range(0, len(found), 100_000):
        yield pa.RecordBatch.from_arrays([pa.array(found[a : a + 100_000])], names=["name"])


#: Values that a task gathers before it emits their slots: fewer records, in bounded memory.
AT_ONCE = 500_000


def shared(rows: DataFrame, values_of: Callable[[list[bytes]], Iterator[tuple[np.ndarray, np.ndarray]]], bits: int) -> DataFrame:
    """name: of slots with two owners or more; `values_of` gives values of texts and their owners, numbers from 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, owners_before = [], 0, 0
        for batch in batches:
            for values, owners in values_of(batch.column("text").cast(pa.binary()).to_pylist()):
                held.append((values, owners + owners_before))
                n += len(values)
                owners_before += int(owners.max()) + 1 if len(owners) else 0
                if n >= AT_ONCE:
                    yield packed(*(np.concatenate(x) for x in zip(*held, strict=True)), bits)
                    held, n = [], 0
        if n:
            yield packed(*(np.concatenate(x) for x in zip(*held, strict=True)), bits)

    return rows.select("text").mapInArrow(run, "part int, slots binary").groupBy("part").applyInArrow(_mark, "name long")

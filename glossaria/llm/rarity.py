"""Features in one global order, rarest first, and pairs of texts that share a feature of their prefixes."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from glossaria.llm.common import small_batches
from glossaria.llm.hashing import chunks

TABLE_BITS = 18
SLICE = 1024  # table entries in one record of the counting shuffle
AT_ONCE = 1_000_000  # bytes of text hashed together

Features = Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]]


def entry_of(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - TABLE_BITS)).astype(np.int64)


def document_counts(texts: DataFrame, of: Features) -> tuple[np.ndarray, int]:
    """Texts with each hashed feature, and texts. The table has `2**TABLE_BITS` entries whatever the number of texts;
    `of` gives text numbers and hashes."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, rows = np.zeros(1 << TABLE_BITS, np.int64), 0
        for batch in batches:
            found = batch.column("text").cast(pa.binary()).to_pylist()
            rows += len(found)
            for a, b in chunks(found, AT_ONCE):
                doc, h = of(found[a:b])
                both = np.unique((doc << TABLE_BITS) | entry_of(h))
                seen += np.bincount(both & ((1 << TABLE_BITS) - 1), minlength=1 << TABLE_BITS)
        if rows:
            parts = seen.reshape(-1, SLICE)
            yield pa.RecordBatch.from_arrays([pa.array(range(-1, len(parts)), pa.int32()), pa.array([np.array([rows]).tobytes(), *(p.tobytes() for p in parts)], pa.binary())], names=["part", "counts"])

    def add(key: tuple[pa.Scalar, ...], tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in tables:
            for x in batch.column("counts").to_pylist():
                own = np.frombuffer(x, np.int64)
                total = own if total is None else total + own
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["part", "counts"])

    small_batches(texts.sparkSession)
    counted = texts.select("text").mapInArrow(count, "part int, counts binary").groupBy("part").applyInArrow(add, "part int, counts binary")
    rows = {r["part"]: np.frombuffer(r["counts"], np.int64) for r in counted.collect()}  # the table, in slices
    if not rows:
        return np.zeros(1 << TABLE_BITS, np.int64), 0
    return np.concatenate([rows[k] for k in range((1 << TABLE_BITS) // SLICE)]), int(rows[-1][0])


def sharing_pairs(prefixes: DataFrame, nodes: DataFrame, fits: Callable[[Callable[[str], Column], Callable[[str], Column]], Column]) -> DataFrame:
    """a, b: nodes of different classes, one of them minor, that share a token; a's is one of its `short` ones.

    `prefixes` has node, token, short and what `fits` asks of a's and b's rows; `nodes` has node, class and minor. Rows
    of two nodes that aren't minor never meet.
    """
    known = prefixes.join(nodes, "node")
    light, heavy = (known.select("token", *(F.col(c).alias(f"{side}_{c}") for c in known.columns if c != "token")) for side in "ab")
    ok = (F.col("a_class") != F.col("b_class")) & F.col("a_short") & fits(lambda c: F.col(f"a_{c}"), lambda c: F.col(f"b_{c}"))
    one = light.where("a_minor").join(heavy, "token").where(ok)
    other = light.where("not a_minor").join(heavy.where("b_minor"), "token").where(ok)
    return one.unionByName(other).select(F.col("a_node").alias("a"), F.col("b_node").alias("b"))

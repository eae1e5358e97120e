"""Sharding: contiguous shards of near-equal bytes, from prefix sums over per-partition totals.

Ids, sizes and checksums (no texts) are dealt by range and sorted; each partition's total gives the next ones their
offset, and a running sum inside a partition gives each row its place among all bytes. A row goes to the shard in whose
equal target its first byte falls, so shards are contiguous in id order and their sizes differ by one row at most.

Defined cases: a null text has size 1 and checksum 0; null ids come first; rows of equal id are ordered by checksum,
then by their place in the input, so a hot id still spreads over partitions; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from glossaria.llm.common import ROW, checkpointed, numbered, row_id


def _running(batches: Iterator[pa.RecordBatch], shards: int) -> Iterator[pa.RecordBatch]:
    bytes_before = rows_before = 0
    for batch in batches:
        size = batch.column("size").to_numpy()
        offset, rows, total = (batch.column(c).to_numpy() for c in ("offset", "row_offset", "total"))
        start = offset + bytes_before + np.cumsum(size) - size
        place = rows + rows_before + np.arange(len(size))
        bytes_before, rows_before = bytes_before + int(size.sum()), rows_before + len(size)
        yield pa.RecordBatch.from_arrays(
            [batch.column("rid"), batch.column("doc_id"), batch.column("size"), batch.column("text_crc32"), pa.array((start * shards // total).astype(np.int32)), pa.array(place)],
            names=["rid", "doc_id", "size", "text_crc32", "shard", "place"],
        )


def assign_shards(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, shard, slot (gapless from 0 in each shard)."""
    return rows_in_shards(docs, shards, id_col, text_col).drop("rid")


def rows_in_shards(docs: DataFrame, shards: int, id_col: str, text_col: str) -> DataFrame:
    """The same with the row number of `docs`."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"), row_id(docs).alias("rid"),
    )
    order = ["doc_id", "text_crc32", "rid"]
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = checkpointed(rows.repartitionByRange(n, *order).sortWithinPartitions(*order)).withColumn("part", F.spark_partition_id())

    totals = dealt.groupBy("part").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row of each partition
    offsets = totals.select(
        "part", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("offset"), F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("row_offset"),
        F.sum("bytes").over(Window.partitionBy()).alias("total"),
    )
    placed = dealt.join(F.broadcast(offsets), "part").drop("part").mapInArrow(lambda b: _running(b, shards), "rid long, doc_id long, size long, text_crc32 long, shard int, place long")
    first = placed.groupBy("shard").agg(F.min("place").alias("first"))  # one row of each shard
    return placed.join(F.broadcast(first), "shard").select("rid", "doc_id", "size", "text_crc32", "shard", (F.col("place") - F.col("first")).alias("slot"))


def write_shards(docs: DataFrame, path: str, shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write the rows of `docs`, repeated and null ids too, as one folder a shard: by slot in each file, and over its files
    in the order of their names."""
    docs, n = numbered(docs), int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = rows_in_shards(docs, shards, id_col, text_col).select(F.col("rid").alias(ROW), "shard", "slot")
    rows = docs.drop("shard", "slot").join(placed, ROW).drop(ROW)
    rows.repartitionByRange(n, "shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)

"""Helpers that the corpus operators share: scratch tables, word rules, Arrow batches."""

from __future__ import annotations

import atexit
import gc
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Name of the column of row numbers; not one that tables have.
ROW = "__glossaria_row__"

#: Bounds an Arrow batch, so that a batch of very long texts still fits a Python worker.
ARROW_ROWS = 400

_own_dirs: dict[str, str] = {}


def scratch_root(spark: SparkSession) -> str:
    """The shared folder the cluster names; a temporary one only where none is set and all runs on this machine (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_dirs:
        _own_dirs[app] = tempfile.mkdtemp(prefix="glossaria-")
        atexit.register(shutil.rmtree, _own_dirs[app], ignore_errors=True)
        spark.sparkContext.setCheckpointDir(_own_dirs[app])
    return _own_dirs[app]


def settle(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of plans that nothing refers to any more, rather than at some later collection."""
    gc.collect()
    spark._jvm.System.gc()


def cut(df: DataFrame, outer: bool = False) -> DataFrame:
    """Write `df` to the shared scratch folder and read it back: lineage ends there. With `outer` it outlives the innermost
    `passing`."""
    spark = df.sparkSession
    settle(spark)
    path = f"{scratch_root(spark)}/cut-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    for held in _passing[-2:-1] if outer else _passing[-1:]:
        held.append(path)
    return spark.read.schema(df.schema).parquet(path)


#: Folders that `cut` wrote within each `passing` that is open.
_passing: list[list[str]] = []


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared store."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def passing(spark: SparkSession) -> Iterator[None]:
    """What is cut within is deleted at the end: for steps whose results are written elsewhere by then."""
    _passing.append([])
    try:
        yield
    finally:
        for path in _passing.pop():
            remove(spark, path)


def bucketed(df: DataFrame, *key: str) -> DataFrame:
    """Write `df` as a table in buckets of `key`: what groups or joins by these columns afterwards needs no shuffle."""
    spark = df.sparkSession
    settle(spark)
    name, n = f"scratch_{uuid.uuid4().hex}", int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.repartition(n, *key).write.bucketBy(n, *key).saveAsTable(name)
    return spark.table(name)


def checkpointed(df: DataFrame) -> DataFrame:
    """Reliable checkpoint; keeps the partitions as they are."""
    scratch_root(df.sparkSession)
    return df.checkpoint()


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of few rows: a row may be a very long text."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


def row_id(docs: DataFrame) -> Column:
    """Tells rows apart even where ids repeat or are null: the column `ROW` if `docs` has it, else a number that holds for
    this one reading of `docs`."""
    return F.col(ROW) if ROW in docs.columns else F.monotonically_increasing_id()


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


#: Word rules of the contracts, as Java and Python patterns for what separates words.
SPACE_CLASS = r"[\x20\x09-\x0D]"
NON_WORD_CLASS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]"


def space_words(text: Column) -> Column:
    """Words `[^\\x20\\x09-\\x0D]+`, in order."""
    return F.array_remove(F.split(text, SPACE_CLASS + "+"), "")


def ascii_lower(text: Column) -> Column:
    """A-Z only. `lower` is the quick way where it cannot turn another letter into an ASCII one; the Kelvin sign is
    the one letter for which it would."""
    slow = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.when(F.contains(text, F.lit("K")), slow).otherwise(F.lower(text))


def alnum_words(lowered: Column) -> Column:
    """Words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` of a text that is lower case already."""
    return F.array_remove(F.split(lowered, NON_WORD_CLASS + "+"), "")


#: Byte table of the same rule: A-Z to a-z, every other ASCII byte that is no word byte to a space.
NORMAL_BYTES = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20
    for b in range(256)
)


def of_scan(docs: DataFrame) -> DataFrame:
    """`docs`, a plain scan of files with its filters and columns, with row numbers (`ROW`): these are alike however often
    and with whatever columns the files are read."""
    return docs if ROW in docs.columns else docs.withColumn(ROW, F.monotonically_increasing_id())


def numbered(docs: DataFrame) -> DataFrame:
    """`docs` with row numbers. Rows that have none yet are written first: what isn't a scan could come in another order
    each time it is computed. Callers that hold a scan number it by `of_scan`, which costs nothing."""
    return docs if ROW in docs.columns else of_scan(cut(docs))


#: Row numbers that are sent to all tasks: 8 bytes each.
FEW_ROWS = 1_000_000


def few(rows: DataFrame, most: int = FEW_ROWS) -> DataFrame:
    """Written rows of a few numbers each, marked to be sent to all tasks if they are counted to be few."""
    return F.broadcast(rows) if rows.count() <= most else rows


def left_after(docs: DataFrame, rids: DataFrame) -> DataFrame:
    """`docs`, numbered, without the rows of these numbers. These are written and counted first, and sent to all tasks
    only if they are few; else both sides are shuffled."""
    gone = cut(rids.select(F.col("rid").alias(ROW)))
    return docs.join(few(gone), ROW, "left_anti")


def without_rows(docs: DataFrame, rids: DataFrame) -> DataFrame:
    """`docs`, numbered, without the rows of these numbers and without the numbers."""
    return left_after(docs, rids).drop(ROW)


def digest(text: Column) -> Column:
    """128 bits of SHA-256: what equal bytes are known by."""
    return F.substring(F.unhex(F.sha2(text.cast("binary"), 256)), 1, 16)


def exact_copies(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """rid, doc_id, head: of numbered rows whose whole text also stands in a row of a smaller id, the first of which is
    `head`."""
    order = F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63)))
    named = cut(docs.select(F.col(ROW).alias("rid"), F.col(id_col).cast("long").alias("doc_id"), order.alias("order"), digest(text_or_empty(text_col)).alias("node")))
    heads = named.groupBy("node").agg(F.min(F.struct("order", "rid")).alias("head"), F.count("*").alias("n")).where(F.col("n") > 1)
    met = named.join(heads, "node").where(F.col("order") > F.col("head.order"))
    return cut(met.select("rid", "doc_id", F.col("head.rid").alias("head")))

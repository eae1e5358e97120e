"""Exact dedup: a persistent index of digests, which each new batch is anti-joined with and appended to.

A text is known by SHA-256 of its normalised form: each run of ASCII white space is one space. The index is a folder that
later jobs can open: `entries` has one row of each digest (where it came first), `repeats` how often later batches brought
it again. Both are tables in buckets of the digest, sorted by it, so a batch is dealt and sorted once and merge-joined
with buckets that stay where they are. Texts are read once, to be hashed; what is shuffled is digests, a row of each.

The row of the smallest id stays among equal texts, if batches come in the order of their ids; otherwise that of the
first batch. Copies are counted before anything is shuffled, and rows of a group with more than a thousandth of all
rows, of which there are under a thousand, meet it by a broadcast, so no group of copies lands in one task.

Defined cases: a null text is the empty one; ids that are null come first; of rows with equal id and text the first in
the scan stays, the others count as its copies; a text of white space only is one space and no copy of the empty one;
texts may have any length; an empty table gives an empty result and leaves the index as it was; other columns are not
looked at, whatever their names.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from glossaria.llm.common import ROW, SPACE_CLASS, cut, numbered, scratch_root, text_or_empty
from glossaria.llm.substring_index import in_batches

#: A group with more than this part of all rows is met by broadcast; there are fewer such groups.
PARTS = 1000
ENTRIES = "digest BINARY, batch INT, rid BIGINT, doc_id BIGINT, n BIGINT"
REPEATS = "digest BINARY, batch INT, n BIGINT"


def text_digest(text: Column) -> Column:
    """SHA-256 of the text with runs of white space as one space."""
    return F.unhex(F.sha2(F.regexp_replace(text, SPACE_CLASS + "+", " ").cast("binary"), 256))


def digests_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """rid, doc_id, order (null ids first), digest of numbered rows."""
    doc_id = F.col(id_col).cast("long")
    return docs.select(F.col(ROW).alias("rid"), doc_id.alias("doc_id"), F.coalesce(doc_id, F.lit(-(1 << 63))).alias("order"), text_digest(text_or_empty(text_col)).alias("digest"))


class DigestIndex:
    """`root` is a folder that driver and executors share: an index that stands there already is opened and goes on."""

    def __init__(self, spark: SparkSession, root: str | None = None):
        self.spark, self.root = spark, root or f"{scratch_root(spark)}/digests-{uuid.uuid4().hex}"
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.tables: dict[str, str] = {}
        self._note()
        for line in self.lines:
            self.buckets = line["buckets"] or self.buckets

    def _note(self, *rows: tuple) -> None:
        """A batch counts once its line `done` is in the manifest; rows of a job that died before are passed over."""
        schema = "batch int, state string, buckets int"
        self.spark.createDataFrame(list(rows), schema).coalesce(1).write.mode("append").json(f"{self.root}/manifest")
        self.lines = self.spark.read.schema(schema).json(f"{self.root}/manifest").collect()  # two of each batch
        begun, done = ({x["batch"] for x in self.lines if x["state"] == s} for s in ("begun", "done"))
        self.failed, self.next = sorted(begun - done), 1 + max(begun, default=-1)

    def _table(self, kind: str) -> DataFrame:
        if kind not in self.tables:
            name, place = f"digests_{kind}_{uuid.uuid4().hex}", f"{self.root}/{kind}".replace("\\", "\\\\").replace("'", "\\'")
            self.spark.sql(f"CREATE TABLE {name} ({ENTRIES if kind == 'entries' else REPEATS}) USING parquet CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{place}'")
            self.tables[kind] = name
        self.spark.catalog.refreshTable(self.tables[kind])
        return self.spark.table(self.tables[kind]).where(~F.col("batch").isin(self.failed))

    def _append(self, kind: str, rows: DataFrame) -> None:
        self._table(kind)
        rows.repartition(self.buckets, "digest").sortWithinPartitions("digest").write.insertInto(self.tables[kind])

    def append(self, rows: DataFrame) -> int:
        """Take a batch in (rid, doc_id, order, digest; written, as it is read twice); its number."""
        k = self.next
        self._note((k, "begun", self.buckets))
        first = F.min(F.struct("order", "rid", "doc_id"))
        own = cut(rows.groupBy("digest").agg(first.alias("first"), F.count("*").alias("n")))
        own = own.select("digest", F.lit(k).alias("batch"), "first.rid", "first.doc_id", "n")
        known = self._table("entries").where(F.col("batch") < k).select("digest").hint("merge")
        self._append("repeats", own.join(known, "digest", "left_semi").select("digest", "batch", "n"))
        self._append("entries", own.join(known, "digest", "left_anti"))
        self._note((k, "done", self.buckets))
        return k

    def groups(self) -> DataFrame:
        """digest, batch, rid, keep_id (of the row that stays), group_size: bucket by bucket, without a shuffle."""
        again = self._table("repeats").groupBy("digest").agg(F.sum("n").alias("more"))
        both = self._table("entries").join(again.hint("merge"), "digest", "left")
        return both.select("digest", "batch", "rid", F.col("doc_id").alias("keep_id"), (F.col("n") + F.coalesce("more", F.lit(0))).alias("group_size"))

    def told(self, rows: DataFrame) -> DataFrame:
        """rid, doc_id, keep_id, group_size, kept, digest of rows (rid, batch, doc_id, digest; written) that the index has."""
        groups = cut(self.groups().withColumnsRenamed({"batch": "b", "rid": "r"}))
        large = F.col("group_size") * PARTS > groups.agg(F.sum("group_size")).first()[0] if not groups.isEmpty() else F.lit(False)
        hot, cold = F.broadcast(groups.where(large)), groups.where(~large)
        met = rows.join(hot, "digest").unionByName(rows.join(hot.select("digest"), "digest", "left_anti").join(cold, "digest"))
        kept = (F.col("rid") == F.col("r")) & (F.col("batch") == F.col("b"))
        return met.select("rid", "doc_id", "keep_id", "group_size", kept.alias("kept"), "digest")

    def add(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """Take a batch of documents in; `told` of its rows, whose sizes count all batches so far."""
        rows = cut(digests_of(numbered(docs), id_col, text_col))
        return self.told(rows.withColumn("batch", F.lit(self.append(rows))))

    def drop(self) -> None:
        """Take the tables out of this session's catalog; the folder stays."""
        while self.tables:
            self.spark.sql(f"DROP TABLE {self.tables.popitem()[1]}")


def deduplicate(docs: DataFrame, batches: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All rows of `docs` as if they came in batches: rid, doc_id, keep_id, group_size, kept, digest."""
    index = DigestIndex(docs.sparkSession)
    rows = cut(digests_of(numbered(docs), id_col, text_col))
    parts = in_batches(rows, batches, "doc_id")
    for part in parts:
        k = index.append(part)
        placed = part.withColumn("batch", F.lit(k))
        every = placed if part is parts[0] else every.unionByName(placed)  # noqa: F821
    return index.told(every)

"""Substring dedup: a log-structured index of window fingerprints, for batches that come one after the other.

Every window of `WINDOW` words has an anchor, the least hash of the `GRAM`-word grams in it; consecutive windows mostly
share theirs, so a text gives a fraction as many anchors as words. The index is a folder that later jobs can open:
sorted immutable runs of anchors, one of each batch, as tables bucketed by anchor (anchor, how often, and where it stands
if that is one place); a log of the batches' texts; and the places of anchors that have been met twice.

A new batch is merge-joined with the runs. Only where an anchor occurs twice can windows be equal. There the batch's
anchored runs of windows are compared with each other and with the history's: old places of anchors that had been alone
until now are looked up in the log, text by text, and no other old text is hashed again. What is compared is a SHA-256
digest (128 bits) of the actual words, first of whole anchored runs and then of single windows, so hashes of words only
choose what is compared. When runs are many they are merged into one, which the next batch meets.

A word is removed if a window over it also starts earlier: in an earlier batch, a smaller id, or before in its text.

Defined cases: a null text has no words; ids that are null come first; rows of equal id count as one document in the
order, so a repeated row doesn't remove itself; texts shorter than a window lose nothing; whatever a text's length, its
words are hashed at once, up to 2**28 of them; an empty batch gives an empty result and an empty run.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from glossaria.llm import bloom
from glossaria.llm.common import ROW, cut, exact_copies, left_after, numbered, passing, scratch_root, small_batches, text_or_empty
from glossaria.llm.hashing import Words, anchored_runs, chunks, prefix_sums, span_hashes

WINDOW, GRAM = 20, 6
LEAST_BYTES = 2 * WINDOW - 1  # of a text with a window
AT_ONCE = 250_000  # bytes of text hashed together: what a task holds for them is some forty times that
#: Bytes that separate words become spaces, others stay.
SPACES = bytes(0x20 if b in b" \t\n\x0b\x0c\r" else b for b in range(256))
RUN = "batch int, rid long, doc_id long, anchor long, digest binary, n int, start int"
HISTORY = "anchor long, n long, batch int, rid long"
TOLD = "rid long, doc_id long, n_words long, n_removed long, digest string, kept string"


def _bytes_of(column: pa.Array) -> list[bytes]:
    return column.cast(pa.binary()).to_pylist()


def spaced(text: bytes) -> bytes:
    """The words of a text, joined by single spaces."""
    text = text.translate(SPACES).strip(b" ")
    return b" ".join(text.split()) if b"  " in text else text


class Anchored:
    """The anchored runs of windows of several texts, whose words are joined by single spaces first."""

    def __init__(self, texts: list[bytes]):
        self.words = w = Words([spaced(t) for t in texts], SPACES)
        n = len(w.hash)
        left = w.last[w.doc] - np.arange(n)
        starts = np.flatnonzero(left >= WINDOW)
        first = np.arange(max(n - GRAM + 1, 0))
        grams = span_hashes(prefix_sums(w.hash), first, first + GRAM)
        self.start, self.count, self.anchor = anchored_runs(grams, WINDOW - GRAM + 1, starts)


def digests(w: Words, first: np.ndarray, n: np.ndarray | int) -> list[bytes]:
    """Of the words themselves, joined by single spaces, from each first one on."""
    buffer = w.buffer.tobytes()
    ends = w.end[first + n - 1]
    return [hashlib.sha256(buffer[a:b]).digest()[:16] for a, b in zip(w.start[first].tolist(), ends.tolist(), strict=True)]


def anchors_of(texts: DataFrame, batch: int) -> DataFrame:
    """anchor, n, batch, rid of one of its places: counted within what is hashed together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            found, rids = _bytes_of(part.column("text")), part.column("rid").to_numpy()
            for a, b in chunks(found, AT_ONCE):
                x = Anchored(found[a:b])
                anchor, at, n = np.unique(x.anchor, return_index=True, return_counts=True)
                rid = rids[a:b][x.words.doc[x.start[at]]]
                yield pa.RecordBatch.from_arrays([pa.array(anchor.view(np.int64)), pa.array(n, pa.int64()), pa.array(np.full(len(n), batch, np.int32)), pa.array(rid)], names=["anchor", "n", "batch", "rid"])

    small_batches(texts.sparkSession)
    return texts.select("rid", "text").mapInArrow(run, HISTORY)


def candidate_runs(texts: DataFrame, filter_bits) -> DataFrame:
    """`RUN` rows: the anchored runs of (batch, rid, doc_id, text) whose anchors pass the filter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = filter_bits.value
        for part in batches:
            found = _bytes_of(part.column("text"))
            for a, b in chunks(found, AT_ONCE):
                x = Anchored(found[a:b])
                ok = np.flatnonzero(bloom.passing(bits, x.anchor))
                start, n, w = x.start[ok], x.count[ok], x.words
                doc = w.doc[start]
                row = pa.array(a + doc)
                yield pa.RecordBatch.from_arrays([
                    *(part.column(c).take(row) for c in ("batch", "rid", "doc_id")), pa.array(x.anchor[ok].view(np.int64)), pa.array(digests(w, start, n + WINDOW - 1), pa.binary()),
                    pa.array(n.astype(np.int32)), pa.array((start - w.first[doc]).astype(np.int32)),
                ], names=["batch", "rid", "doc_id", "anchor", "digest", "n", "start"])

    small_batches(texts.sparkSession)
    return texts.select("batch", "rid", "doc_id", "text").mapInArrow(run, RUN)


def windows_of(rows: DataFrame) -> DataFrame:
    """batch, rid, doc_id, start, digest: each window of the runs (`heads`: start, n) of a text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            texts, heads = _bytes_of(part.column("text")), part.column("heads").to_pylist()
            for a, b in chunks(texts, AT_ONCE):
                w = Words([spaced(t) for t in texts[a:b]], SPACES)
                flat = [(k, h["start"], h["n"]) for k in range(a, b) for h in heads[k]]
                doc, start, n = (np.array([f[j] for f in flat], np.int64) for j in range(3))
                inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                each = np.repeat(np.arange(len(flat)), n)
                at = start[each] + inner
                row = pa.array(doc[each])
                made = digests(w, w.first[doc - a][each] + at, WINDOW)
                yield pa.RecordBatch.from_arrays([*(part.column(c).take(row) for c in ("batch", "rid", "doc_id")), pa.array(at.astype(np.int32)), pa.array(made, pa.binary())], names=["batch", "rid", "doc_id", "start", "digest"])

    small_batches(rows.sparkSession)
    return rows.select("batch", "rid", "doc_id", "text", "heads").mapInArrow(run, "batch int, rid long, doc_id long, start int, digest binary")


def later_places(placed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of written (digest, batch, rid, doc_id, start, ...): rows whose digest has an earlier place; digests and first places.

    Minima are taken before anything is shuffled. The join is one of two plain shuffles, so Spark can split a hot digest.
    """
    place = F.struct("batch", "doc_id", "start")
    first = cut(placed.groupBy("digest").agg(F.min(F.struct("batch", "doc_id", "start", "rid")).alias("first"), F.max(place).alias("last")))
    begin = F.struct(*(F.col(f"first.{c}").alias(c) for c in ("batch", "doc_id", "start")))
    several = first.where(begin < F.col("last")).select("digest", begin.alias("begin"))
    return placed.join(several, "digest").where(place > F.col("begin")), first.select("digest", "first.*")


def without_spans(rows: DataFrame) -> DataFrame:
    """rid, doc_id, n_words, n_removed, kept (text of the words that stay) from rid, doc_id, text, spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total, removed, kept = [], [], []
            for text, spans in zip(_bytes_of(batch.column("text")), batch.column("spans").to_pylist(), strict=True):
                words = text.split()
                edge = np.zeros(len(words) + 1, np.int64)
                for s in spans or ():
                    edge[s["start"]] += 1
                    edge[s["start"] + s["n_words"]] -= 1
                gone = np.cumsum(edge[:-1]) > 0
                total.append(len(words))
                removed.append(int(gone.sum()))
                kept.append(b" ".join([w for w, g in zip(words, gone.tolist(), strict=True) if not g]))
            yield pa.RecordBatch.from_arrays([batch.column("rid"), batch.column("doc_id"), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], names=["rid", "doc_id", "n_words", "n_removed", "kept"])

    small_batches(rows.sparkSession)
    return rows.select("rid", "doc_id", "text", "spans").mapInArrow(run, "rid long, doc_id long, n_words long, n_removed long, kept string")


def untouched(rows: DataFrame) -> DataFrame:
    """rid, doc_id, n_words, digest of the words (hex SHA-256) of texts that lose nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [spaced(t) for t in _bytes_of(batch.column("text"))]
            made = [hashlib.sha256(w).hexdigest() for w in words]
            yield pa.RecordBatch.from_arrays([batch.column("rid"), batch.column("doc_id"), pa.array([w.count(b" ") + bool(w) for w in words], pa.int64()), pa.array(made, pa.string())], names=["rid", "doc_id", "n_words", "digest"])

    small_batches(rows.sparkSession)
    return rows.select("rid", "doc_id", "text").mapInArrow(run, "rid long, doc_id long, n_words long, digest string")


MANIFEST = "seq int, kind string, name string, buckets int, replaces array<string>"


class FingerprintIndex:
    """Batches must come in the order of their ids; each `add` compares with all before. `root` is a folder that driver and
    executors share: an index that stands there already is opened and goes on where it ended."""

    def __init__(self, spark: SparkSession, root: str | None = None, most_runs: int = 4):
        self.spark, self.most_runs = spark, most_runs
        self.root = root or f"{scratch_root(spark)}/fingerprints-{uuid.uuid4().hex}"
        self._filters: list = []
        self.tables: dict[str, str] = {}  # names in this session's catalog, by folder
        self._note()

    def _note(self, *rows: tuple) -> None:
        """What an `add` made counts once its line is in the manifest; a job that dies before leaves the index as it was."""
        frame = self.spark.createDataFrame(list(rows), MANIFEST)
        frame.coalesce(1).write.mode("append").json(f"{self.root}/manifest")
        lines = self.spark.read.schema(MANIFEST).json(f"{self.root}/manifest").collect()  # a few of each batch
        gone = {name for line in lines for name in line["replaces"] or ()}
        self.live = sorted((line for line in lines if line["name"] not in gone), key=lambda line: line["seq"])
        self.seq = 1 + max((line["seq"] for line in lines), default=-1)
        self.batches = sum(line["kind"] == "texts" for line in self.live)

    def _names(self, kind: str) -> list[str]:
        return [line["name"] for line in self.live if line["kind"] == kind]

    def _write_run(self, counted: DataFrame) -> tuple[str, int]:
        """A run: sorted by anchor, in buckets."""
        name, buckets = f"run-{uuid.uuid4().hex}", int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        alone = F.when(F.sum("n") == 1, F.min(F.struct("batch", "rid")))
        dealt = counted.repartition(buckets, "anchor").groupBy("anchor").agg(F.sum("n").alias("n"), alone.alias("p"))
        dealt = dealt.select("anchor", "n", "p.batch", "p.rid")
        self.tables[name] = name.replace("-", "_")
        dealt.write.option("path", f"{self.root}/{name}").bucketBy(buckets, "anchor").sortBy("anchor").saveAsTable(self.tables[name])
        return name, buckets

    def _run(self, line) -> DataFrame:
        name = line["name"]
        if name not in self.tables:  # made by another job: its files keep their buckets
            self.tables[name] = f"{name.replace('-', '_')}_{uuid.uuid4().hex[:8]}"
            place = f"{self.root}/{name}".replace("\\", "\\\\").replace("'", "\\'")
            self.spark.sql(f"CREATE TABLE {self.tables[name]} ({HISTORY}) USING parquet CLUSTERED BY (anchor) SORTED BY (anchor) INTO {line['buckets']} BUCKETS LOCATION '{place}'")
        return self.spark.table(self.tables[name])

    def _part(self, kind: str, rows: DataFrame, *names: str) -> str:
        name = f"{kind}-{uuid.uuid4().hex}"
        rows.write.option("compression", "zstd").parquet(f"{self.root}/{name}")
        return name

    def _parts(self, kind: str) -> list[DataFrame]:
        return [self.spark.read.parquet(f"{self.root}/{name}") for name in self._names(kind)]

    def history(self) -> DataFrame | None:
        """`HISTORY` rows over all runs, merge-joined; batch and rid where an anchor stands in one place."""
        merged = None
        for line in self.live:
            if line["kind"] == "run":
                own = self._run(line)
                if merged is None:
                    merged = own
                else:
                    both = merged.join(own.select("anchor", F.col("n").alias("m"), F.col("batch").alias("b"), F.col("rid").alias("r")), "anchor", "full")
                    merged = both.select("anchor", (F.coalesce("n", F.lit(0)) + F.coalesce("m", F.lit(0))).alias("n"), *(F.when(F.col("n").isNull(), F.col(y)).when(F.col("m").isNull(), F.col(x)).alias(x) for x, y in (("batch", "b"), ("rid", "r"))))
        return merged

    def compact(self) -> None:
        """Merge all runs into one."""
        old = self._names("run")
        if len(old) > 1:
            name, buckets = self._write_run(self.history())
            self._note((self.seq, "run", name, buckets, old))
            for x in old:
                self._empty(x, HISTORY)

    def _empty(self, name: str, schema: str) -> None:
        if name in self.tables:
            self.spark.sql(f"DROP TABLE {self.tables.pop(name)}")
        self.spark.createDataFrame([], schema).write.mode("overwrite").parquet(f"{self.root}/{name}")

    def drop(self) -> None:
        """End the index: its tables leave the catalog and its folders are emptied."""
        for line in self.live:
            self._empty(line["name"], {"run": HISTORY, "met": RUN}.get(line["kind"], "rid long"))

    def _filter(self, values: DataFrame, column: str):
        """A broadcast filter, until `add` ends."""
        self._filters.append(self.spark.sparkContext.broadcast(bloom.build(values, column, counted=True)))
        return self._filters[-1]

    def _texts_at(self, places: DataFrame, logs: list[DataFrame]) -> DataFrame:
        """`places` (batch, rid, ...) with doc_id and text from the log; a filter of bounded size drops other texts first."""
        name = F.xxhash64("batch", "rid")
        places = cut(places)
        bits = self._filter(places.select(name.alias("name")), "name")
        log = reduce(DataFrame.unionByName, logs)
        return log.where(bloom.passes(bits, name)).join(places, ["batch", "rid"])

    def add(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """rid, doc_id, n_words, n_removed, digest or kept (text) of the batch's documents; the other one is null."""
        if len(self._names("run")) >= self.most_runs:
            self.compact()
        docs = numbered(docs).select(F.col(ROW).alias("rid"), F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
        with passing(self.spark):
            name = self._added(docs)
        return self.spark.read.schema(TOLD).parquet(f"{self.root}/{name}")

    def _added(self, docs: DataFrame) -> str:
        """The folder of the results of a batch; what was cut on the way isn't needed any more."""
        spark, k = self.spark, self.batches
        log = self._part("texts", docs.where(F.octet_length("text") >= LEAST_BYTES).withColumn("batch", F.lit(k)))
        texts = spark.read.parquet(f"{self.root}/{log}")
        logs, before = [*self._parts("texts"), texts], self.history()
        run, buckets = self._write_run(anchors_of(texts, k))
        own = spark.table(self.tables[run])
        if before is None:
            shared = own.where(F.col("n") > 1).select("anchor")
            found = cut(candidate_runs(texts, self._filter(shared, "anchor")))
            known = None
        else:
            past = before.select("anchor", F.col("n").alias("m"), F.col("batch").alias("b"), F.col("rid").alias("r"))
            met = cut(own.select("anchor", "n").join(past, "anchor", "left").where((F.col("n") > 1) | F.col("m").isNotNull()))
            found = cut(candidate_runs(texts, self._filter(met, "anchor")))
            alone = met.where(F.col("m") == 1)
            old = self._texts_at(alone.select(F.col("b").alias("batch"), F.col("r").alias("rid")).distinct(), logs)
            known = cut(candidate_runs(old, self._filter(alone, "anchor")))
        with passing(spark):
            spans = self._spans(found, known, logs).where(F.col("batch") == k)
            spans = cut(spans.groupBy("rid").agg(F.collect_list(F.struct("start", "n_words")).alias("spans")), outer=True)  # bounded by the text
        name = F.xxhash64("rid")
        bits = self._filter(spans.select(name.alias("name")), "name")
        touched = without_spans(docs.where(bloom.passes(bits, name)).join(spans, "rid", "left"))
        out = untouched(docs.where(~bloom.passes(bits, name))).select("rid", "doc_id", "n_words", F.lit(0).cast("long").alias("n_removed"), "digest", F.lit(None).cast("string").alias("kept"))
        out = self._part("told", out.unionByName(touched.select("rid", "doc_id", "n_words", "n_removed", F.lit(None).cast("string").alias("digest"), "kept")))
        while self._filters:  # what asked them is written
            self._filters.pop().destroy()
        made = self._part("met", found if known is None else found.unionByName(known))
        self._note((self.seq, "run", run, buckets, None), (self.seq, "texts", log, None, None), (self.seq, "met", made, None, None))
        return out

    def _spans(self, found: DataFrame, known: DataFrame | None, logs: list[DataFrame]) -> DataFrame:
        """batch, rid, start, n_words of spans of words that also start earlier; `found` is the batch's, `known` has the
        history's newly met places, and those met before come from the index."""
        pool = found
        if known is not None:
            anchors = found.select("anchor").distinct()
            old = reduce(DataFrame.unionByName, [known, *self._parts("met")])
            pool = cut(found.unionByName(old.join(anchors, "anchor", "left_semi")))
        later, first = later_places(pool)
        whole = later.select("batch", "rid", "start", (F.col("n") + WINDOW - 1).alias("n_words"))
        # Runs of one anchor that differ as wholes can still share windows: the first place of each tells which.
        runs = pool.groupBy("anchor", "digest").agg(F.first("n").alias("n"))
        several = runs.groupBy("anchor").agg(F.count("*").alias("runs")).where(F.col("runs") > 1).select("anchor")
        heads = runs.join(several, "anchor").select("digest", "n").distinct().join(first, "digest")
        places = heads.groupBy("batch", "rid").agg(F.collect_list(F.struct("start", "n")).alias("heads"))  # bounded by the text
        single, _ = later_places(cut(windows_of(self._texts_at(places, logs))))
        return whole.unionByName(single.select("batch", "rid", "start", F.lit(WINDOW).alias("n_words")))


def in_batches(docs: DataFrame, n: int, id_col: str = "doc_id") -> list[DataFrame]:
    """Parts of about equal size, in the order of ids."""
    edges = docs.agg(F.percentile_approx(id_col, [k / n for k in range(1, n)], 1000).alias("e")).first()["e"] or []
    edges = sorted(set(edges))
    low = [None, *edges]
    parts = []
    for a, b in zip(low, [*edges, None], strict=True):
        part = docs.where((F.col(id_col) > a) if a is not None else F.lit(True))
        parts.append(part.where((F.col(id_col) <= b) | (F.col(id_col).isNull() if a is None else F.lit(False))) if b is not None else part)
    return parts


def deduplicate(docs: DataFrame, batches: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All rows of `docs` as if they came in batches: doc_id, n_words, n_removed, digest or kept. Of three batches the last
    one meets a run that the first two were merged into.

    Later copies of a whole text lose all of it (if it has a window), and nothing starts first in them, so only their
    first text goes into the index.
    """
    index = FingerprintIndex(docs.sparkSession, most_runs=2)
    every = numbered(docs)
    copies = exact_copies(every, id_col, text_col)
    parts = [index.add(part, id_col, text_col) for part in in_batches(left_after(every, copies), batches, id_col)]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    index.drop()
    gone = copies.join(out.select(F.col("rid").alias("head"), "n_words", "digest", "kept"), "head")
    long_ = F.col("n_words") >= WINDOW
    gone = gone.select("doc_id", "n_words", F.when(long_, F.col("n_words")).otherwise(0).alias("n_removed"), F.when(~long_, F.col("digest")).alias("digest"), F.when(long_, F.lit("")).otherwise(F.col("kept")).alias("kept"))
    return out.drop("rid").unionByName(gone)

"""Suffix-array dedup: remove bytes covered by a 50-byte string that also starts in an earlier document.

Equal strings have equal anchors (the least hash of the `GRAM`-byte grams in them) at equal places, so the strings around
an anchor are a unit: a *piece* of text with a run of starting places. Only anchors of two documents or more matter.
These are found by marking hashed slots, which costs a few bytes an anchor in the shuffle, and kept as a filter of fixed
size; a false hit only adds a piece. Pieces of equal bytes are reduced to one with the least id. The distinct pieces are
dealt into shards by anchor, about `SHARD` bytes each (those whose anchor stands in one document only need none). There
most pieces of one anchor differ soon on both sides of it: a 50-byte string holds its anchor and half of the other bytes
to the left or to the right of it, so pieces that share neither of these two longer grams with another document drop out.
Of the others a suffix array is built by induced sorting; suffixes whose permuted common prefixes reach 50 bytes form
classes, and the least id of a class is where its string starts first.

Hot strings are reduced before they are dealt, and the way back to their places is an equi-join that Spark can split.
An anchor whose distinct pieces come to more than `HOT` bytes goes into no shard. Most such anchors are frequent words
among ever other ones, so their pieces are taken apart once more, by the least hash of `FINER`-byte grams, and these
parts are settled as pieces of their own; an anchor that stands in one document only ends there. Where a finer anchor is
hot as well (the edges of a passage that many documents share), strings are named by digests, and an aggregate and an
equi-join give the least id of each, so that no group in memory grows with the number of documents.

Defined cases: a null text is empty; null ids come first; rows of equal id are not earlier than each other; texts shorter
than 50 bytes lose nothing; a text up to 2**28 bytes is hashed at once; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
import secrets
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from glossaria.llm import bloom, slots
from glossaria.llm.common import bucketed, cut, digest, exact_copies, left_after, numbered, row_id, small_batches, text_or_empty
from glossaria.llm.hashing import anchored_runs, chunks, prefix_sums, span_hashes, window_hashes
from glossaria.llm.suffix_array import common_prefixes, suffix_array

LENGTH, GRAM, FINER = 50, 16, 32
AT_ONCE = 1 << 17  # bytes of text hashed together: their hashes stay in a core's cache
SHARD = 1 << 19  # bytes, of which most drop out before they are sorted
HOT = 1 << 16  # bytes of one anchor's distinct pieces
#: Anchors are settled in so many rounds, one after the other, each of which needs that part of the disk.
ROUNDS = 3
PIECE = "anchor:bigint,hash:bigint,at:bigint"  # at: first start, then how many, in the low 8 bits


def _bytes_of(column: pa.Array) -> list[bytes]:
    return column.cast(pa.binary()).to_pylist()


class Pieces:
    """Pieces of several texts: first start, number of starts, anchor and text number."""

    def __init__(self, texts: list[bytes], gram: int = GRAM):
        self.buffer = np.frombuffer(b"".join(texts), np.uint8)
        size = np.array([len(t) for t in texts], np.int64)
        self.first = np.concatenate([[0], np.cumsum(size)])
        self.sums = prefix_sums(self.buffer)
        starts = np.maximum(size - LENGTH + 1, 0)
        before = np.concatenate([[0], np.cumsum(starts)[:-1]])
        places = np.arange(starts.sum()) + np.repeat(self.first[:-1] - before, starts)
        self.start, self.count, self.anchor = anchored_runs(window_hashes(self.sums, gram), LENGTH - gram + 1, places)
        self.doc = np.searchsorted(self.first, self.start, side="right") - 1

    def known(self, ok: np.ndarray, salt: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """anchor, hash and at of these pieces."""
        start, n = self.start[ok], self.count[ok]
        data, end = self.buffer.tobytes(), start + n + LENGTH - 1
        salted = hashlib.blake2b(digest_size=8, salt=salt)  # a copy of it is quicker made than a new one

        def digest_of(piece: bytes) -> bytes:
            own = salted.copy()
            own.update(piece)
            return own.digest()

        hashes = b"".join([digest_of(data[x:y]) for x, y in zip(start.tolist(), end.tolist(), strict=True)])
        return self.anchor[ok].view(np.int64), np.frombuffer(hashes, np.int64), (start - self.first[self.doc[ok]]) << 8 | n


def anchors_of(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for a, b in chunks(texts, AT_ONCE):
        p = Pieces(texts[a:b])
        yield p.anchor, p.doc


def candidates(docs: DataFrame, filter_bits, part_bits: int, id_col: str, text_col: str) -> DataFrame:
    """rid, doc_id, n_bytes, pieces; the text if there are pieces, else its digest. A piece is known by its anchor and a
    salted digest of its bytes, under a salt that no text can foresee."""
    salt = secrets.token_bytes(16)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = filter_bits.value
        kind = pa.list_(pa.struct([("anchor", pa.int64()), ("hash", pa.int64()), ("at", pa.int64())]))
        for batch in batches:
            texts = _bytes_of(batch.column("text"))
            counts, columns = [], [[], [], []]
            for a, b in chunks(texts, AT_ONCE):
                p = Pieces(texts[a:b])
                ok = np.flatnonzero(bloom.passing(bits, slots.named(slots.slots_of(p.anchor, part_bits))))
                counts.append(np.bincount(p.doc[ok], minlength=b - a))
                for column, made in zip(columns, p.known(ok, salt), strict=True):
                    column.append(made)
            count = np.concatenate([np.empty(0, np.int64), *counts])
            parts = [pa.array(np.concatenate(c) if c else np.empty(0, np.int64)) for c in columns]
            pieces = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(count)]).astype(np.int32)), pa.StructArray.from_arrays([x.cast(t.type) for x, t in zip(parts, kind.value_type, strict=True)], fields=list(kind.value_type)))
            some = (count > 0).tolist()
            digests = [None if s else hashlib.sha256(t).hexdigest() for t, s in zip(texts, some, strict=True)]
            kept = pa.array([t if s else None for t, s in zip(texts, some, strict=True)], pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("rid"), batch.column("doc_id"), pa.array([len(t) for t in texts], pa.int64()), pa.array(digests, pa.string()), kept, pieces], names=["rid", "doc_id", "n_bytes", "digest", "text", "pieces"])

    small_batches(docs.sparkSession)
    rows = docs.select(row_id(docs).alias("rid"), F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    return rows.mapInArrow(run, f"rid long, doc_id long, n_bytes long, digest string, text string, pieces array<struct<{PIECE}>>")


def piece_texts(heads: DataFrame) -> DataFrame:
    """anchor, hash, owner, bytes of pieces, cut from the text they stand in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, pieces = _bytes_of(batch.column("text")), batch.column("pieces")
            anchor, hash_, owner, at = pieces.flatten().flatten()
            at = at.to_numpy()
            start = at >> 8
            spans = zip(pc.list_parent_indices(pieces).to_pylist(), start.tolist(), (start + (at & 255) + LENGTH - 1).tolist(), strict=True)
            yield pa.RecordBatch.from_arrays([anchor, hash_, owner, pa.array([texts[k][a:b] for k, a, b in spans], pa.binary())], names=["anchor", "hash", "owner", "bytes"])

    return heads.select("text", "pieces").mapInArrow(run, "anchor long, hash long, owner long, bytes binary")


def contested_sides(pieces: pa.Table, gram: int) -> pa.Table:
    """Pieces that share their anchor of `gram` bytes, with half of the other bytes of a string before or after it, with a
    piece of another owner; others share no string."""
    texts, owner = pieces.column("bytes").to_pylist(), pieces.column("owner").to_numpy()
    size = np.array([len(t) for t in texts], np.int64)
    end = np.cumsum(size)
    first, side = end - size, (LENGTH - gram) // 2
    sums = prefix_sums(np.frombuffer(b"".join(texts), np.uint8))
    hits = np.flatnonzero(window_hashes(sums, gram) == np.repeat(pieces.column("anchor").to_numpy().view(np.uint64), size)[: 1 - gram])
    place = hits[np.searchsorted(hits, first)]  # an anchor is the leftmost of its kind in a piece
    left, right = np.flatnonzero(place - side >= first), np.flatnonzero(place + gram + side <= end)
    which = np.concatenate([left, right])
    begin = np.concatenate([place[left] - side, place[right]])
    name = span_hashes(sums, begin, begin + gram + side)
    name[len(left) :] += np.uint64(1)
    order = np.argsort(name)
    starts = np.flatnonzero(np.concatenate([[True], name[order][1:] != name[order][:-1]])[: len(order)])
    owners, counts = owner[which[order]], np.diff(np.append(starts, len(order)))
    shared = np.repeat(np.minimum.reduceat(owners, starts) < np.maximum.reduceat(owners, starts), counts)
    return pieces.take(pa.array(np.unique(which[order[shared]])))


def resolve_shard(pieces: pa.Table) -> pa.Table:
    """Of each piece with strings that start earlier than in its owner: runs of them (first place in the piece, number)."""
    texts, owner = pieces.column("bytes").to_pylist(), pieces.column("owner").to_numpy()
    size = np.array([len(t) + 1 for t in texts], np.int64)  # with the separator
    n = size - LENGTH
    joined = np.frombuffer(b"".join(t + b"\0" for t in texts), np.uint8).astype(np.int16) + 2
    first = np.concatenate([[0], np.cumsum(size)])
    joined[first[1:] - 1] = 1
    text = np.append(joined, np.int16(0))
    order = suffix_array(text, 258)
    shared = common_prefixes(text, order, LENGTH)[order]
    piece = np.append(np.repeat(np.arange(len(texts)), size), -1)  # of each place
    starts = np.flatnonzero(shared < LENGTH)
    owners = np.append(owner, np.iinfo(np.int64).max)[piece]
    least = np.empty(len(text), np.int64)
    least[order] = np.repeat(np.minimum.reduceat(owners[order], starts), np.diff(np.append(starts, len(order))))
    inner = np.arange(len(text)) - np.append(first[:-1], 0)[piece]
    earlier = (least < owners) & (inner < np.append(n, 0)[piece])
    edge = np.flatnonzero(np.diff(np.concatenate([[0], earlier.astype(np.int8), [0]])))
    begin, end = edge[0::2], edge[1::2]  # runs of strings; they end with their piece, as its last 49 places start none
    some, runs = np.unique(piece[begin], return_counts=True)
    parts = pa.StructArray.from_arrays([pa.array(inner[begin].astype(np.int32)), pa.array((end - begin).astype(np.int32))], ["k", "n"])
    taken = pieces.take(pa.array(some)).select(["anchor", "hash"])
    return taken.append_column("earlier", pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(runs)]).astype(np.int32)), parts))


def finer_places(pieces: DataFrame) -> DataFrame:
    """rid, owner, anchor, hash, at: parts of pieces whose strings have one anchor of `FINER` bytes."""
    salt = secrets.token_bytes(16)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = _bytes_of(batch.column("bytes"))
            for a, b in chunks(texts, AT_ONCE):
                p = Pieces(texts[a:b], FINER)
                row = pa.array(p.doc + a)
                yield pa.RecordBatch.from_arrays([batch.column("rid").take(row), batch.column("owner").take(row), *map(pa.array, p.known(np.arange(len(p.start)), salt))], names=["rid", "owner", "anchor", "hash", "at"])

    return pieces.select("rid", "owner", "bytes").mapInArrow(run, "rid long, owner long, anchor long, hash long, at long")


def resolve_finer(pieces: DataFrame) -> DataFrame:
    """The same as `resolve_shard` for pieces of hot anchors: each is a text, taken apart by finer anchors."""
    held = cut(pieces.withColumn("rid", F.monotonically_increasing_id()))
    spans = covered(finer_places(held), held.select("rid", F.col("bytes").alias("text")), FINER, resolve_strings)
    run = F.struct(F.col("span.start").alias("k"), (F.col("span.size") - (LENGTH - 1)).alias("n"))
    found = spans.groupBy("rid").agg(F.array_sort(F.collect_list(run)).alias("earlier"))  # 35 at most
    return held.select("rid", "anchor", "hash").join(found, "rid").select("anchor", "hash", "earlier")


def resolve_strings(pieces: DataFrame) -> DataFrame:
    """The same as `resolve_shard` for pieces of hot finer anchors: equal strings meet by digest."""
    each = pieces.select("anchor", "hash", "owner", "bytes", F.explode(F.sequence(F.lit(0), F.octet_length("bytes") - LENGTH)).alias("k"))
    strings = cut(each.select("anchor", "hash", "owner", "k", digest(F.substring("bytes", F.col("k") + 1, F.lit(LENGTH))).alias("name")))
    least = strings.groupBy("name").agg(F.min("owner").alias("least"), F.max("owner").alias("most")).where(F.col("least") < F.col("most"))
    later = strings.join(least.select("name", "least"), "name").where(F.col("owner") > F.col("least"))
    found = later.groupBy("anchor", "hash").agg(F.array_sort(F.collect_list("k")).alias("ks"))  # 35 at most
    begins = F.filter("ks", lambda k: ~F.array_contains("ks", k - 1))
    ends = F.filter("ks", lambda k: ~F.array_contains("ks", k + 1))
    return found.select("anchor", "hash", F.zip_with(begins, ends, lambda b, e: F.struct(b.alias("k"), (e - b + 1).alias("n"))).alias("earlier"))


def without_spans(rows: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (bytes that stay) from doc_id, text, spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, spans = _bytes_of(batch.column("text")), batch.column("spans")
            row = pc.list_parent_indices(spans).to_numpy()
            start, size = (x.to_numpy().astype(np.int64) for x in spans.flatten().flatten())
            for a, b in chunks(texts, AT_ONCE):
                first = np.concatenate([[0], np.cumsum([len(t) for t in texts[a:b]])]).astype(np.int64)
                own = slice(*np.searchsorted(row, [a, b]))
                begin = first[row[own] - a] + start[own]
                edge = np.bincount(begin, minlength=first[-1] + 1) - np.bincount(begin + size[own], minlength=first[-1] + 1)
                gone = np.cumsum(edge[:-1]) > 0
                begins = gone.copy()
                begins[1:] &= ~gone[:-1]
                heads = first[:-1][np.diff(first) > 0]
                begins[heads] = gone[heads]
                n_removed, n_spans = (np.concatenate([[0], np.cumsum(x)])[first] for x in (gone, begins))
                kept = np.frombuffer(b"".join(texts[a:b]), np.uint8)[~gone]
                kept = pa.Array.from_buffers(pa.binary(), b - a, [None, pa.py_buffer((first - n_removed).astype(np.int32)), pa.py_buffer(kept)])
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), *(pa.array(np.diff(x)) for x in (first, n_removed, n_spans)), kept], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    small_batches(rows.sparkSession)
    return rows.select("doc_id", "text", "spans").mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def covered(places: DataFrame, texts: DataFrame, gram: int, resolve_hot: Callable[[DataFrame], DataFrame] = resolve_finer) -> DataFrame:
    """rid, span (start, size): parts of the places' texts that also start in an earlier document. Anchors are of `gram` bytes."""
    resolve = resolve_shard
    key = ["anchor", "hash"]
    places = bucketed(places, *key)
    # The piece's place in its first document: of rows with the least owner all three take the same one.
    distinct = places.groupBy(*key).agg(F.min("owner").alias("first_owner"), F.min_by("rid", "owner").alias("first_rid"), F.min_by("at", "owner").alias("first_at"))
    # Pieces of one anchor only can hold equal strings, and only those of several documents matter.
    size = F.col("first_at").bitwiseAND(255) + LENGTH
    several = distinct.groupBy("anchor").agg(F.min("first_owner").alias("least"), F.max("first_owner").alias("most"), F.sum(size).alias("bytes")).where(F.col("least") < F.col("most"))
    contested = cut(distinct.join(several.select("anchor", (F.col("bytes") > HOT).alias("hot")), "anchor"))
    sizes = {r["hot"]: r["bytes"] for r in contested.groupBy("hot").agg(F.sum(size).alias("bytes")).collect()}
    shards = max(1, math.ceil(sizes.get(False, 0) / SHARD))

    def pieces(some: DataFrame) -> DataFrame:
        heads = some.groupBy(F.col("first_rid").alias("rid")).agg(F.collect_list(F.struct(*key, F.col("first_owner").alias("owner"), F.col("first_at").alias("at"))).alias("pieces"))
        return piece_texts(texts.join(heads, "rid"))

    def shard(held: pa.Table) -> pa.Table:
        return resolve(contested_sides(held, gram))

    dealt = pieces(contested.where(~F.col("hot"))).withColumn("shard", F.pmod(F.xxhash64("anchor"), F.lit(shards)))
    resolved = cut(dealt.groupBy("shard").applyInArrow(shard, "anchor long, hash long, earlier array<struct<k:int,n:int>>"))
    if True in sizes:
        resolved = resolved.unionByName(cut(resolve_hot(pieces(contested.where("hot")))))

    known = distinct.select(*key, "first_owner").join(resolved, key, "left")
    found = places.join(known, key).withColumn("start", F.shiftright("at", 8).cast("int"))
    span = lambda start, size: F.struct(start.cast("int").alias("start"), size.cast("int").alias("size"))
    whole = F.when(F.col("owner") > F.col("first_owner"), F.array(span(F.col("start"), F.col("at").bitwiseAND(255) + LENGTH - 1)))
    strings = F.when(F.col("owner") == F.col("first_owner"), F.transform("earlier", lambda x: span(F.col("start") + x["k"], x["n"] + LENGTH - 1)))
    return found.select("rid", F.explode(F.coalesce(whole, strings)).alias("span"))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, digest or kept (bytes) of each document; the other one is null.

    Later copies of a whole text lose all of it, and nothing starts first in them, so they take no part in the rest.
    """
    context = docs.sparkSession.sparkContext
    small_batches(docs.sparkSession)
    every = numbered(docs)
    copies = exact_copies(every, id_col, text_col)
    docs = left_after(every, copies)
    whole = docs.select(text_or_empty(text_col).alias("text"))
    part_bits = slots.part_bits(whole, (LENGTH - GRAM + 2) / 2)
    names = cut(slots.shared(whole, anchors_of, part_bits))
    rows = cut(candidates(docs, context.broadcast(bloom.build(names, "name", counted=True)), part_bits, id_col, text_col))
    texts = bucketed(rows.where(F.col("text").isNotNull()).select("rid", "doc_id", "text"), "rid")  # each round asks it
    places = rows.select("rid", "doc_id", F.explode("pieces").alias("p")).select("rid", F.coalesce("doc_id", F.lit(-(1 << 63))).alias("owner"), "p.*")
    found = reduce(DataFrame.unionByName, [cut(covered(places.where(F.pmod("anchor", F.lit(ROUNDS)) == k), texts, GRAM)) for k in range(ROUNDS)])
    spans = found.groupBy("rid").agg(F.collect_list("span").alias("spans"))  # bounded by the text
    touched = without_spans(texts.join(spans, "rid", "left"))
    clean = rows.where(F.col("text").isNull()).select("doc_id", "n_bytes", F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), "digest", F.lit(None).cast("binary").alias("kept"))
    gone = copies.join(rows.select(F.col("rid").alias("head"), "n_bytes", "digest"), "head")
    long_ = F.col("n_bytes") >= LENGTH
    gone = gone.select("doc_id", "n_bytes", F.when(long_, F.col("n_bytes")).otherwise(0).alias("n_removed"), long_.cast("long").alias("n_spans"), F.when(~long_, F.col("digest")).alias("digest"), F.when(long_, F.lit(b"")).alias("kept"))
    return clean.unionByName(touched.withColumn("digest", F.lit(None).cast("string"))).unionByName(gone)

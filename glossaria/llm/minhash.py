"""Near-duplicate documents by improved consistent weighted sampling of TF-IDF shingles.

A document is a weighted set of five-word shingles: how often one occurs, times the mean inverse document frequency of
its words. Document frequencies cover all documents; they are counted in a table of hashed words, whose
size doesn't depend on the corpus. Samples agree with the probability of the weighted Jaccard similarity; bands of samples
give buckets. In each bucket everything is compared with one member, and connected texts form classes; where a bucket
still holds several classes, its texts outside the largest are compared with all others of the bucket, so no pair that
shares a bucket stays unseen unless one class already holds both.

Exact copies are one node from the start. What is compared is the texts themselves, by weighted Jaccard similarity.
Hot buckets only meet grouped minima and equi-joins, which Spark splits; no bucket is gathered in a task.

Defined cases: null texts and texts without words are in no bucket, but equal ones share a class as copies do; a text of
fewer than five words is one shingle; repeated rows and equal texts share a class; the class is the least id in it
(null if no member has one); an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from glossaria.llm import bloom
from glossaria.llm.classes import classes_in_buckets
from glossaria.llm.common import NORMAL_BYTES, ROW, cut, digest, numbered, row_id, small_batches, text_or_empty
from glossaria.llm.hashing import Words, chunks, mix
from glossaria.llm.rarity import AT_ONCE, TABLE_BITS, document_counts, entry_of

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 12, 4
SAMPLES = BANDS * ROWS
BLOCK = 2048  # shingles sampled together
SAMPLING_BITS = 13

_rng = np.random.default_rng(7)
MULTIPLIER = _rng.integers(1, 1 << 63, SAMPLES, np.uint64) | np.uint64(1)


def _sampling_table() -> np.ndarray:
    """1/r, beta, r and ln c + r*beta - r of consistent weighted sampling, a row each; entries are picked by hash."""
    n = 1 << SAMPLING_BITS
    r, c, beta = _rng.gamma(2, 1, n), _rng.gamma(2, 1, n), _rng.random(n)
    return np.stack([1 / r, beta, r, np.log(c) + r * beta - r]).astype(np.float32)


TABLE = _sampling_table()


def _bytes_of(column: pa.Array) -> list[bytes]:
    return column.cast(pa.binary()).to_pylist()


def words_in(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    w = Words(texts, NORMAL_BYTES)
    return w.doc, w.hash


def idf_table(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    seen, n = document_counts(docs.select(text_or_empty(text_col).alias("text")), words_in)
    return np.log1p(n / (1.0 + seen)).astype(np.float32)


def weighted_shingles(texts: list[bytes], idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number, hash and weight of each text's distinct shingles, by text and hash."""
    w = Words(texts, NORMAL_BYTES)
    first, h = w.windows(SHINGLE, whole_if_short=True)
    doc = w.doc[first]
    sums = np.concatenate([[0], np.cumsum(idf[entry_of(w.hash)], dtype=np.float64)])
    end = np.minimum(first + SHINGLE, w.last[doc])
    mean = (sums[end] - sums[first]) / np.maximum(end - first, 1)
    order = np.lexsort((h, doc))
    doc, h, mean = doc[order], h[order], mean[order]
    new = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])])) if len(h) else np.empty(0, np.int64)
    times = np.diff(np.append(new, len(h)))
    return doc[new], h[new], np.round(mean[new] * times, 4)  # rounded: sums of the same weights are then alike in all texts


def samples(doc: np.ndarray, h: np.ndarray, weight: np.ndarray, n: int) -> np.ndarray:
    """n x SAMPLES: each text's sample hashes; all ones where it has no shingles."""
    best = np.full((n, SAMPLES), np.iinfo(np.uint64).max, np.uint64)
    log_weight = np.log(np.maximum(weight, 1e-3)).astype(np.float32)
    for a in range(0, len(h), BLOCK):
        own, x = doc[a : a + BLOCK], h[a : a + BLOCK, None] * MULTIPLIER
        x ^= x >> np.uint64(32)
        entry = (x >> np.uint64(64 - SAMPLING_BITS)).astype(np.intp)
        t = TABLE[0].take(entry)
        t *= log_weight[a : a + BLOCK, None]
        t += TABLE[1].take(entry)
        np.floor(t, out=t)
        value = TABLE[2].take(entry)
        value *= t
        np.subtract(TABLE[3].take(entry), value, out=value)
        value += np.float32(4096)  # positive, so its bits are ordered like it
        step = t.astype(np.int32).view(np.uint32) * np.uint32(0x9E3779B1)
        key = value.view(np.uint32).astype(np.uint64)
        key <<= np.uint64(32)
        key |= x.astype(np.uint32) ^ step
        starts = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        least = np.minimum.reduceat(key, starts, axis=0)
        best[own[starts]] = np.minimum(best[own[starts]], least)
    return best


def bands(best: np.ndarray) -> np.ndarray:
    """n x BANDS bucket names."""
    total = np.arange(BANDS, dtype=np.uint64)[None, :] + np.zeros((len(best), 1), np.uint64)
    parts = mix(best & np.uint64(0xFFFFFFFF)).reshape(len(best), BANDS, ROWS)
    for k in range(ROWS):
        total = total * np.uint64(0xD6E8FEB86659FD93) + parts[:, :, k]
    return mix(total).view(np.int64)


def sketch(docs: DataFrame, idf, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """rid, node, doc_id, bands (empty if there are no shingles)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, made = _bytes_of(batch.column("text")), []
            for a, b in chunks(texts, AT_ONCE):
                doc, h, weight = weighted_shingles(texts[a:b], idf.value)
                found = bands(samples(doc, h, weight, b - a))
                some = np.bincount(doc, minlength=b - a) > 0
                made += [x if ok else [] for x, ok in zip(found.tolist(), some, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("rid"), batch.column("node"), batch.column("doc_id"), pa.array(made, pa.list_(pa.int64()))], names=["rid", "node", "doc_id", "bands"])

    small_batches(docs.sparkSession)
    named = docs.select(row_id(docs).alias("rid"), F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text")).withColumn("node", digest(F.col("text")))
    return named.mapInArrow(run, "rid long, node binary, doc_id long, bands array<long>")


def similarity(texts: list[bytes], others: list[bytes], idf: np.ndarray) -> list[float]:
    """Weighted Jaccard similarity of each pair; the features of one text in a row of pairs are made once."""
    known: dict[bytes, tuple[np.ndarray, np.ndarray]] = {}

    def of(text: bytes) -> tuple[np.ndarray, np.ndarray]:
        if text not in known:
            if len(known) > 64:
                known.clear()
            known[text] = weighted_shingles([text], idf)[1:]
        return known[text]

    out = []
    for x, y in zip(texts, others, strict=True):
        (ha, wa), (hb, wb) = of(x), of(y)
        _, ia, ib = np.intersect1d(ha, hb, assume_unique=True, return_indices=True)
        common = np.minimum(wa[ia], wb[ib]).sum()
        out.append(float(common / max(wa.sum() + wb.sum() - common, 1e-9)))
    return out


def verified(pairs: DataFrame, texts: DataFrame, idf, least: float) -> DataFrame:
    """a, b, similarity of the pairs that reach `least`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = similarity(_bytes_of(batch.column("text_a")), _bytes_of(batch.column("text_b")), idf.value)
            out = pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(found, pa.float64())], names=["a", "b", "similarity"])
            yield out.filter(pa.array([x >= least for x in found]))

    second = pairs.join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")
    both = second.join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")
    return both.select("a", "b", "text_a", "text_b").mapInArrow(run, "a binary, b binary, similarity double")


def difference(text: np.ndarray, weight: np.ndarray, chosen: np.ndarray, chosen_weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What tells a weighted set from another one: tokens (a shingle and whether there is more or less of it), weights."""
    h = np.concatenate([text, chosen])
    signed = np.concatenate([weight, -chosen_weight])
    order = np.argsort(h, kind="stable")
    h, signed = h[order], signed[order]
    if not len(h):
        return h, signed
    new = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
    h, signed = h[new], np.add.reduceat(signed, new)
    some = signed != 0
    h, signed = h[some], signed[some]
    return mix(h + (signed < 0).astype(np.uint64)), np.abs(signed)


def differences(groups: DataFrame, idf, least: float, seen=None) -> DataFrame:
    """a, node, class, minor, token, of_minor, of_any, still, apart, total: tokens of each member's difference from its
    group's chosen one, with the weight still to come from there, the whole difference's and the text's.

    Two texts differ by D(x, y), the sum of their weights' differences, and are similar if that is at most
    c * (total(x) + total(y)) with c = (1 - least) / (1 + least). Of each shingle the differences x - a and y - a share
    the lesser part, if their signs agree, and that is all by which D(x, y) falls short of D(x, a) + D(y, a). So similar
    texts share R = (D(x, a) + D(y, a) - c * (total(x) + total(y))) / 2 at least. As a minor x isn't similar to a, R is at
    least (D(y, a) + c * (total(a) - total(y))) / 2 for any y, and at least D(x, a) - c * total(x) * (1 + 1 / least) for
    x. With tokens in one order, rarest first (`seen` counts them, in a table of fixed size), a token that both share
    stands where as much as R is still to come; later ones are left out. Without `seen` all tokens are given.
    """
    c = (1 - least) / (1 + least)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, tokens, minors, anys, stills, aparts, totals = [], [], [], [], [], [], []
            known: dict[bytes, tuple[np.ndarray, np.ndarray]] = {}
            for k, (a, text_a, text_b) in enumerate(zip(batch.column("a").to_pylist(), _bytes_of(batch.column("text_a")), _bytes_of(batch.column("text_b")), strict=True)):
                if a not in known:
                    known.clear()
                    known[a] = weighted_shingles([text_a], idf.value)[1:]
                own, chosen = weighted_shingles([text_b], idf.value)[1:], known[a]
                token, weight = difference(*own, *chosen)
                token = mix(token ^ np.uint64(int.from_bytes(a[:8], "little")))
                of_minor = of_any = np.ones(len(token), bool)
                still, total, total_a = weight, own[1].sum(), chosen[1].sum()
                if seen is not None and len(token):
                    order = np.lexsort((token, seen.value[entry_of(token)]))
                    token, weight = token[order], weight[order]
                    still = weight[::-1].cumsum()[::-1] * (1 + 1e-6) + 1e-6
                    of_minor = still >= weight.sum() - c * total * (1 + 1 / least)
                    of_any = still >= (weight.sum() + c * (total_a - total)) / 2
                rows.append(np.full(len(token), k))
                tokens.append(token)
                minors.append(of_minor)
                anys.append(of_any)
                stills.append(still)
                aparts.append(np.full(len(token), weight.sum()))
                totals.append(np.full(len(token), total))
            at, token, of_minor, of_any, still, apart, total = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (rows, tokens, minors, anys, stills, aparts, totals))
            take = pa.array(at.astype(np.int64))
            yield pa.RecordBatch.from_arrays([*(batch.column(n).take(take) for n in ("a", "node", "class", "minor")), pa.array(token.astype(np.uint64).view(np.int64)), pa.array(of_minor.astype(bool)), pa.array(of_any.astype(bool)), *(pa.array(x.astype(np.float64)) for x in (still, apart, total))], names=["a", "node", "class", "minor", "token", "of_minor", "of_any", "still", "apart", "total"])

    return groups.select("a", "node", "class", "minor", "text_a", "text_b").mapInArrow(run, "a binary, node binary, class binary, minor boolean, token long, of_minor boolean, of_any boolean, still double, apart double, total double")


def across(groups: DataFrame, texts: DataFrame, idf, least: float) -> DataFrame:
    """a, b: pairs of a group's texts of different classes that share what similar texts must share of their differences
    from the chosen one."""
    both = groups.join(texts.select("node", F.col("text").alias("text_b")), "node").join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")
    both = cut(both)
    entry = F.shiftrightunsigned("token", 64 - TABLE_BITS).cast("int")
    counted = differences(both, idf, least).groupBy(entry.alias("entry")).agg(F.count("*").alias("n")).collect()  # a row of each table entry at most
    seen = np.zeros(1 << TABLE_BITS, np.int64)
    for r in counted:
        seen[r["entry"]] = r["n"]
    known = cut(differences(both, idf, least, groups.sparkSession.sparkContext.broadcast(seen)).where("of_any or (minor and of_minor)"))
    c = (1 - least) / (1 + least)
    x = known.where("minor and of_minor").select("token", F.col("node").alias("a"), F.col("class").alias("a_class"), *(F.col(n).alias(f"a_{n}") for n in ("still", "apart", "total")))
    y = known.where("of_any").select("token", F.col("node").alias("b"), F.col("class").alias("b_class"), F.col("minor").alias("b_minor"), *(F.col(n).alias(f"b_{n}") for n in ("still", "apart", "total")))
    # What the two must share is known now; at the first token that they share, so much is still to come in both.
    must = (F.col("a_apart") + F.col("b_apart") - c * (F.col("a_total") + F.col("b_total"))) / 2
    fits = (F.least("a_still", "b_still") >= must) & (F.least("a_total", "b_total") * (1 + 1e-6) >= least * F.greatest("a_total", "b_total"))
    # Two minor texts meet either way: once is enough.
    return x.join(y, "token").where((F.col("a_class") != F.col("b_class")) & fits & (~F.col("b_minor") | (F.col("a") < F.col("b")))).select("a", "b")


def texts_of(docs: DataFrame, wanted: DataFrame, text_col: str) -> DataFrame:
    """node, text of the rows that `wanted` (node, rid) names. A filter of bounded size drops most other texts before any is
    shuffled, at every size of the corpus."""
    wanted = cut(wanted.select("node", "rid", F.xxhash64("rid").alias("name")))
    bits = docs.sparkSession.sparkContext.broadcast(bloom.build(wanted, "name", counted=True))
    rows = docs.select(F.col(ROW).alias("rid"), text_or_empty(text_col).alias("text"), F.xxhash64(ROW).alias("name"))
    return cut(rows.where(bloom.passes(bits, F.col("name"))).join(wanted.select("node", "rid"), "rid").select("node", "text"))


def near_duplicates(docs: DataFrame, least: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """rid, doc_id, class_id (the least id among connected documents of at least this similarity), first (of its class,
    by id, then by place in the input)."""
    spark, docs = docs.sparkSession, numbered(docs)
    idf = spark.sparkContext.broadcast(idf_table(docs, text_col))
    members = cut(sketch(docs, idf, id_col, text_col))
    nodes = members.groupBy("node").agg(F.min("rid").alias("rid"), F.first("bands").alias("bands"))  # equal texts have equal bands
    buckets = nodes.select("node", F.explode("bands").alias("bucket"))
    shared = buckets.groupBy("bucket").agg(F.count("*").alias("n")).where(F.col("n") > 1)
    held = cut(buckets.join(shared, "bucket"))  # texts that share a bucket
    # A bucket's chosen member is the one that meets most texts in all buckets: likely the one that most are near to.
    meets = held.groupBy("node").agg(F.sum("n").alias("meets"))
    chosen = held.join(meets, "node").groupBy("bucket").agg(F.max(F.struct("meets", "node")).alias("c")).select("bucket", F.col("c.node").alias("a"))
    met = cut(held.join(chosen, "bucket").select("bucket", "a", F.col("node").alias("b")))
    texts = texts_of(docs, nodes.select("node", "rid").join(met.select(F.col("b").alias("node")).distinct(), "node"), text_col)
    classes = classes_in_buckets(met, lambda pairs: verified(pairs, texts, idf, least), lambda groups: across(groups, texts, idf, least))

    named = members.join(classes, "node", "left").select("rid", "doc_id", F.coalesce("class", "node").alias("class"))
    heads = named.groupBy("class").agg(F.min("doc_id").alias("class_id"), F.min(F.struct("doc_id", "rid")).alias("head"))
    return named.join(heads, "class").select("rid", "doc_id", "class_id", (F.col("rid") == F.col("head.rid")).alias("first"))

"""Line dedup: segment-partition edit join of all lines.

Two lines within edit distance `EDITS` (on UTF-8 bytes) share one of `EDITS + 1` segments, up to a shift: the shorter one
is cut into even segments, and the longer one is probed for them at the places where they can stand (its length and the
segment's number bound these). A line's keys are its own segments and its probes; a key names length, segment number and
bytes. Keys of one line only, nearly all of them, are left out by a filter of fixed size. Lines that share a key are
compared by banded bit-parallel edit distance, all pairs of a batch at once, after common ends are cut off. Linked
lines form classes; of a class the first line stays, by document id and line number.

A segment of a short line is a few common letters, which unrelated lines share the more often the more lines there are. So
lines whose keys leave them in doubt meet by two of `EDITS + 2` segments instead, about half of the line. Where even a half
is in many lines, these meet by their rarest grams.

Lines of fewer than `LEAST` bytes, in which two edits may change the meaning, only equal each other byte by byte. Lines
without a letter or digit (ASCII or any byte beyond) are never removed: they carry no text of their own.

Defined cases: a null text has no lines, an empty one has one line that stays; null ids come first; rows of equal id have
the same places, so a repeated row keeps its lines; a text up to 2**28 bytes is read whole; an empty table gives an
empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from glossaria.llm import bloom, slots
from glossaria.llm.classes import classes_in_buckets
from glossaria.llm.common import ROW, cut, exact_copies, few, left_after, numbered, row_id, small_batches, text_or_empty
from glossaria.llm.hashing import CHAIN, chunks, mix, prefix_sums, span_hashes
from glossaria.llm.rarity import document_counts, entry_of, sharing_pairs

EDITS = 2
LEAST = 24
BYTES_A_KEY = 16  # about, for the number of slots
BYTES_A_HALF = 0.5  # the same for `halves`: some eighty a line
CROWD = 64  # lines that are paired within a bucket of halves; those of larger ones meet by grams
GRAM = 4
#: Bytes of letters and digits.
LETTERS = np.array([b >= 0x80 or chr(b).isalnum() for b in range(256)])
AT_ONCE = 1_000_000  # bytes of text hashed together
PAIRS_AT_ONCE = 4096
LINE = "line:int,node:binary,own:array<bigint>,probes:array<bigint>"


def _bytes_of(column: pa.Array) -> list[bytes]:
    return column.cast(pa.binary()).to_pylist()


def segments(length: np.ndarray, edits: int = EDITS) -> list[tuple[np.ndarray, np.ndarray]]:
    """Start and size of each of `edits + 1` even segments; longer ones come last."""
    base, long_ = length // (edits + 1), length % (edits + 1)
    out, start = [], np.zeros_like(length)
    for i in range(edits + 1):
        size = base + (i >= edits + 1 - long_)
        out.append((start, size))
        start = start + size
    return out


class Lines:
    """Lines of several texts that take part: text number, line number, span and keys."""

    def __init__(self, texts: list[bytes]):
        self.texts = texts
        joined = b"\n".join(texts) + b"\n"
        self.buffer = np.frombuffer(joined, np.uint8)
        ends = np.flatnonzero(self.buffer == 0x0A)
        starts = np.concatenate([[0], ends[:-1] + 1])
        offsets = np.cumsum([0] + [len(t) + 1 for t in texts])
        doc = np.searchsorted(offsets, starts, side="right") - 1
        number = np.arange(len(starts)) - np.searchsorted(starts, offsets[:-1])[doc]
        letters = np.concatenate([[0], np.cumsum(LETTERS[self.buffer])])
        ok = np.flatnonzero(letters[ends] > letters[starts])
        self.start, self.end, self.doc, self.number = starts[ok], ends[ok], doc[ok], number[ok]
        self.joined = joined
        sums = prefix_sums(self.buffer)
        length = self.end - self.start
        named = lambda l, i, at, size: mix(span_hashes(sums, at, at + size) * CHAIN + (l * (EDITS + 1) + i).astype(np.uint64))
        own, probes = [], []
        for less in range(EDITS + 1):  # of a line that many bytes shorter
            for i, (p, size) in enumerate(segments(np.maximum(length - less, 0))):
                low = np.maximum(np.maximum(p - i, p + less - (EDITS - i)), 0)
                high = np.minimum(np.minimum(p + i, p + less + (EDITS - i)), length - size)
                for at in range(2 * EDITS + 1):
                    place = low + at
                    if len(length) and not (place <= high).any():
                        continue
                    key = named(length - less, i, self.start + np.minimum(place, length - size), size)
                    if less == 0 and at == 0:
                        own.append(named(length, i, self.start + p, size))
                    probes.append(np.where(place <= high, key, own[0] if own else key))
        self.own = np.stack(own, axis=1)
        self.probes = np.stack(probes, axis=1)  # some repeat the line's own keys
        short = length < LEAST
        self.own[short] = self.probes[short] = mix(span_hashes(sums, self.start[short], self.end[short]) + CHAIN)[:, None]

    def line(self, k: int) -> bytes:
        return self.joined[self.start[k] : self.end[k]]


def keys_of(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for a, b in chunks(texts, AT_ONCE):
        found = Lines(texts[a:b])
        seen: dict[bytes, int] = {}
        each = np.arange(len(found.start))
        equal = np.array([seen.setdefault(found.line(k), k) for k in each.tolist()], np.int64)
        # Equal lines are told by their own segments; their probes count as one line's.
        probing = found.probes.reshape(-1)
        repeated = (found.probes[:, :, None] == found.own[:, None, :]).any(axis=2).reshape(-1)
        owners = np.concatenate([np.repeat(each, found.own.shape[1]), np.repeat(equal, found.probes.shape[1])[~repeated]])
        yield np.concatenate([found.own.reshape(-1), probing[~repeated]]), owners


def candidates(docs: DataFrame, filter_bits, part_bits: int, id_col: str, text_col: str) -> DataFrame:
    """rid, doc_id, n_lines, lines whose keys pass the filter; the text if there are any, else its digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = filter_bits.value
        kind = pa.list_(pa.struct([("line", pa.int32()), ("node", pa.binary()), ("own", pa.list_(pa.int64())), ("probes", pa.list_(pa.int64()))]))
        for batch in batches:
            texts, made = _bytes_of(batch.column("text")), []
            for a, b in chunks(texts, AT_ONCE):
                found = Lines(texts[a:b])
                lists: list[list] = [[] for _ in range(b - a)]
                passed = [bloom.passing(bits, slots.named(slots.slots_of(keys.reshape(-1), part_bits))).reshape(keys.shape) for keys in (found.own, found.probes)]
                for k in np.flatnonzero(passed[0].any(axis=1) | passed[1].any(axis=1)).tolist():
                    own = found.own[k][passed[0][k]].view(np.int64).tolist()
                    probes = set(found.probes[k][passed[1][k]].view(np.int64).tolist()) - set(own)
                    node = hashlib.sha256(found.line(k)).digest()[:16]
                    lists[found.doc[k]].append({"line": int(found.number[k]), "node": node, "own": own, "probes": list(probes)})
                made += lists
            digests = [None if m else hashlib.sha256(t).hexdigest() for t, m in zip(texts, made, strict=True)]
            kept = pa.array([t if m else None for t, m in zip(texts, made, strict=True)], pa.binary()).cast(pa.string())
            lines = [t.count(b"\n") + 1 if ok else 0 for t, ok in zip(texts, batch.column("some").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("rid"), batch.column("doc_id"), pa.array(lines, pa.int64()), pa.array(digests, pa.string()), kept, pa.array(made, kind)], names=["rid", "doc_id", "n_lines", "digest", "text", "lines"])

    small_batches(docs.sparkSession)
    rows = docs.select(row_id(docs).alias("rid"), F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"), F.col(text_col).isNotNull().alias("some"))
    return rows.mapInArrow(run, f"rid long, doc_id long, n_lines long, digest string, text string, lines array<struct<{LINE}>>")


def banded_distance(pairs: list[tuple[bytes, bytes]], edits: int = EDITS) -> np.ndarray:
    """Edit distances, `edits + 1` for larger ones: one bit vector of the band a pair, all pairs column by column.

    Bit 63 is the band's lowest row; it follows the diagonal down to the first text's end, then the score goes along
    that row.
    """
    out = np.full(len(pairs), edits + 1, np.int64)
    left, places = [], []
    for k, (a, b) in enumerate(pairs):
        if abs(len(a) - len(b)) > edits:
            continue
        x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
        n = min(len(x), len(y))
        differ = np.flatnonzero(x[:n] != y[:n])
        head = int(differ[0]) if len(differ) else n
        differ = np.flatnonzero(x[len(x) - n + head :][::-1] != y[len(y) - n + head :][::-1]) if n > head else differ[:0]
        tail = int(differ[0]) if len(differ) else n - head
        a, b = a[head : len(a) - tail], b[head : len(b) - tail]
        if not a or not b:
            out[k] = max(len(a), len(b))
        else:
            places.append(k)
            left.append((a, b))
    if not left:
        return out
    firsts, seconds = ([p[j] for p in left] for j in (0, 1))
    m, n = (np.array([len(t) for t in ts]) for ts in (firsts, seconds))
    text_a, text_b = (np.frombuffer(b"".join(ts), np.uint8) for ts in (firsts, seconds))
    from_a, from_b = (np.concatenate([[0], np.cumsum(x)[:-1]]) for x in (m, n))
    one = np.uint64(1)
    alive = np.arange(len(left))
    vp = np.full(len(left), sum(1 << b for b in range(63 - edits, 64)), np.uint64)
    vn, score = np.zeros(len(left), np.uint64), np.minimum(m, edits)
    top = np.uint64(1 << 63)
    for j in range(int(n.max())):
        now = alive[(j < n[alive]) & (score[alive] <= 2 * edits + n[alive] - m[alive])]
        done = alive[j >= n[alive]]
        out[np.array(places)[done]] = np.minimum(score[done], edits + 1)
        alive = now
        if not len(alive):
            break
        letter, match = text_b[from_b[alive] + j], np.zeros(len(alive), np.uint64)
        for b in range(2 * edits + 1):
            row = j + edits - b
            if row >= 0:
                inside = row < m[alive]
                same = inside & (text_a[from_a[alive] + np.minimum(row, m[alive] - 1)] == letter)
                match |= same.astype(np.uint64) << np.uint64(63 - b)
        p, q = vp[alive], vn[alive]
        d0 = (((match & p) + p) ^ p) | match | q
        hp, hn = q | ~(d0 | p), d0 & p
        below = j < m[alive] - edits  # the lowest row is still on the diagonal
        bit = np.where(below, np.uint64(63), np.uint64(63) - np.clip(j - (m[alive] - edits) + 1, 0, 63).astype(np.uint64))
        step = np.where(below, ((d0 & top) == 0).astype(np.int64), ((hp >> bit) & one).astype(np.int64) - ((hn >> bit) & one).astype(np.int64))
        score[alive] += step
        half = d0 >> one
        vp[alive], vn[alive] = hn | ~(half | hp), half & hp
    out[np.array(places)[alive]] = np.minimum(score[alive], edits + 1)
    return out


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """a, b of the pairs of lines within the distance."""

    def judged(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = [p for batch in held for p in zip(_bytes_of(batch.column("text_a")), _bytes_of(batch.column("text_b")), strict=True)]
        near, at = banded_distance(both) <= EDITS, 0
        for batch in held:
            yield batch.select(["a", "b"]).filter(pa.array(near[at : at + len(batch)]))
            at += len(batch)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(map(len, held)) >= PAIRS_AT_ONCE or sum(b.nbytes for b in held) >= AT_ONCE * 8:
                yield from judged(held)
                held = []
        yield from judged(held)

    small_batches(pairs.sparkSession)
    second = pairs.join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")
    both = second.join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")
    return both.select("a", "b", "text_a", "text_b").mapInArrow(run, "a binary, b binary")


def grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Text numbers and hashes of all grams, each told apart by how often it stood before in its text."""
    buffer = np.frombuffer(b"".join(texts), np.uint8)
    size = np.array([len(t) for t in texts], np.int64)
    n = np.maximum(size - GRAM + 1, 0)
    first = np.cumsum(size) - size
    at = np.arange(n.sum()) + np.repeat(first - (np.cumsum(n) - n), n)
    doc = np.repeat(np.arange(len(texts)), n)
    h = span_hashes(prefix_sums(buffer), at, at + GRAM)
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])]) if len(h) else np.empty(0, bool)
    run = np.flatnonzero(new)
    repeat = np.arange(len(h)) - np.repeat(run, np.diff(np.append(run, len(h)))) if len(h) else np.empty(0, np.int64)
    return doc, mix(h + repeat.astype(np.uint64) * CHAIN)


def profiles(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """How often bytes of each of 16 kinds stand in a text: eight bits a kind (modulo 256), eight kinds a number."""
    doc = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    kind = np.frombuffer(b"".join(texts), np.uint8) & 15
    counts = np.bincount(doc * 16 + kind, minlength=16 * len(texts)).reshape(-1, 2, 8).astype(np.uint8)
    return counts[:, 0].copy().view(np.int64)[:, 0], counts[:, 1].copy().view(np.int64)[:, 0]


def unlike(a: Column, b: Column) -> Column:
    """Sum of differences of two profiles, in eight kinds. An edit changes it by two at most."""
    parts = []
    for k in range(8):
        d = F.abs(F.shiftrightunsigned(a, 8 * k).bitwiseAND(255) - F.shiftrightunsigned(b, 8 * k).bitwiseAND(255))
        parts.append(F.least(d, 256 - d))
    return reduce(Column.__add__, parts)


def prefixes(nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """node, token, size, short (always), low and high (see `profiles`): the rarest `GRAM * EDITS + 1` grams of each
    line. An edit changes `GRAM` grams at most, so lines within the distance share one of these."""
    own = texts.join(nodes, "node").select("node", "text")
    seen = nodes.sparkSession.sparkContext.broadcast(document_counts(own, grams)[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = _bytes_of(batch.column("text"))
            for a, b in chunks(found, AT_ONCE):
                doc, h = grams(found[a:b])
                order = np.lexsort((h, seen.value[entry_of(h)], doc))
                doc, h = doc[order], h[order]
                at = np.flatnonzero(np.arange(len(doc)) - np.searchsorted(doc, doc) <= GRAM * EDITS)
                sizes, profile = np.array([len(t) for t in found[a:b]], np.int32), profiles(found[a:b])
                yield pa.RecordBatch.from_arrays([batch.column("node").take(pa.array(a + doc[at])), pa.array(h[at].view(np.int64)), pa.array(sizes[doc[at]]), pa.array(np.ones(len(at), bool)), *(pa.array(p[doc[at]]) for p in profile)], names=["node", "token", "size", "short", "low", "high"])

    return own.mapInArrow(run, "node binary, token long, size int, short boolean, low long, high long")


def halves(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Keys of pairs of segments, of lines of `LEAST` bytes or more: a line's own, and its probes, a row a line.

    A line is cut into `EDITS + 2` segments, so two of them stay whole in any line within the distance. Of two lines the
    longer one is probed for the pairs of the shorter one, each segment moved by the bytes that came in before it; of lines
    of one length the one in which none is missing in between.
    """
    length = np.array([len(t) for t in texts], np.int64)
    start = np.cumsum(length) - length
    sums = prefix_sums(np.frombuffer(b"".join(texts), np.uint8))
    pairs = list(combinations(range(EDITS + 2), 2))
    own, probes = [], []
    for less in range(EDITS + 1):  # of a line that many bytes shorter
        moves = [(s, t) for s in range(EDITS + 1) for t in range(EDITS + 1) if s + abs(t - s) + abs(less - t) <= EDITS]
        parts = segments(length - less, EDITS + 1)
        spans = {}
        for s in {m for both in moves for m in both}:
            for i, (p, size) in enumerate(parts):
                at = np.minimum(p + s, length - size)
                spans[i, s] = span_hashes(sums, start + at, start + at + size), p + s + size <= length
        for s, t in moves:
            for k, (i, j) in enumerate(pairs):
                if t < s and j == i + 1:  # no byte between them that could be missing
                    continue
                (first, fits), (second, fits_too) = spans[i, s], spans[j, t]
                key = mix((first * CHAIN + second) * CHAIN + ((length - less) * len(pairs) + k).astype(np.uint64))
                if less == s == t == 0:
                    own.append(key)
                else:
                    probes.append(np.where(fits & fits_too, key, own[0]))
    return np.stack(own, axis=1), np.stack(probes, axis=1)


def halves_of(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for a, b in chunks(texts, AT_ONCE):
        keys = np.concatenate(halves(texts[a:b]), axis=1)
        yield keys.reshape(-1), np.repeat(np.arange(b - a), keys.shape[1])


def halved(lines: DataFrame, filter_bits, part_bits: int) -> DataFrame:
    """bucket, node, own: the keys of `halves` that pass the filter, each once a line."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = _bytes_of(batch.column("text"))
            for a, b in chunks(texts, AT_ONCE):
                own, probes = halves(texts[a:b])
                key = np.concatenate([own, probes], axis=1).reshape(-1)
                doc = np.repeat(np.arange(b - a), own.shape[1] + probes.shape[1])
                probing = np.tile(np.arange(own.shape[1] + probes.shape[1]) >= own.shape[1], b - a)
                ok = bloom.passing(filter_bits.value, slots.named(slots.slots_of(key, part_bits)))
                key, doc, probing = key[ok], doc[ok], probing[ok]
                order = np.lexsort((probing, key, doc))
                key, doc, probing = key[order], doc[order], probing[order]
                new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (key[1:] != key[:-1])]) if len(key) else np.empty(0, bool)
                yield pa.RecordBatch.from_arrays([pa.array(key[new].view(np.int64)), batch.column("node").take(pa.array(a + doc[new])), pa.array(~probing[new])], names=["bucket", "node", "own"])

    return lines.mapInArrow(run, "bucket long, node binary, own boolean")


def sharing_grams(nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """a, b: pairs of lines of different classes, one of them minor, that share one of their rarest grams."""
    # Of two minor lines the lesser name comes first; a line that isn't minor may come second or first.
    once = lambda a, b: (F.abs(a("size") - b("size")) <= EDITS) & (unlike(a("low"), b("low")) + unlike(a("high"), b("high")) <= 2 * EDITS) & (~a("minor") | ~b("minor") | (a("node") < b("node")))
    return sharing_pairs(cut(prefixes(nodes.select("node"), texts)), nodes, once)


def across(groups: DataFrame, texts: DataFrame) -> DataFrame:
    """a, b: pairs of lines of different classes, one of them minor, that share what near lines must share."""
    context = groups.sparkSession.sparkContext
    small_batches(groups.sparkSession)
    nodes = cut(groups.groupBy("node", "class").agg(F.max("minor").alias("minor")))
    lines = cut(texts.where(F.octet_length("text") >= LEAST).join(nodes.select("node"), "node").select("node", "text"))
    part_bits = slots.part_bits(lines, BYTES_A_HALF)
    names = cut(slots.shared(lines, halves_of, part_bits))
    members = cut(halved(lines, context.broadcast(bloom.build(names, "name", counted=True)), part_bits))
    sizes = members.groupBy("bucket").agg(F.count("*").alias("n"), F.max("own").alias("any")).where((F.col("n") > 1) & F.col("any")).select("bucket", "n")
    held = cut(members.join(sizes, "bucket").join(nodes, "node"))
    x, y = (held.where(F.col("n") <= CROWD).select("bucket", *(F.col(c).alias(f"{side}_{c}") for c in ("node", "class", "minor", "own"))) for side in "ab")
    once = ~F.col("b_own") | (F.col("a_node") < F.col("b_node"))
    met = x.where("a_own").join(y, "bucket").where((F.col("a_class") != F.col("b_class")) & (F.col("a_minor") | F.col("b_minor")) & once)
    met = met.select(F.least("a_node", "b_node").alias("a"), F.greatest("a_node", "b_node").alias("b"))
    crowded = cut(held.where(F.col("n") > CROWD).select("node", "class", "minor").distinct())
    return met if crowded.isEmpty() else met.unionByName(sharing_grams(crowded, texts))


def split_lines(rows: DataFrame) -> DataFrame:
    """rid, node, text of candidate lines."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, texts = [], []
            for text, lines in zip(_bytes_of(batch.column("text")), batch.column("lines").to_pylist(), strict=True):
                parts = text.split(b"\n")
                nodes += [x["node"] for x in lines]
                texts += [parts[x["line"]] for x in lines]
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.binary()), pa.array(texts, pa.binary())], names=["node", "text"])

    return rows.select("text", F.transform("lines", lambda x: F.struct(x["line"].alias("line"), x["node"].alias("node"))).alias("lines")).mapInArrow(run, "node binary, text binary")


def without_lines(rows: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_removed, n_linked, kept (text of the lines that stay) from doc_id, text, gone, n_linked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total, removed, kept = [], [], []
            for text, gone in zip(_bytes_of(batch.column("text")), batch.column("gone").to_pylist(), strict=True):
                lines, out = text.split(b"\n"), set(gone or ())
                total.append(len(lines))
                removed.append(len(out))
                kept.append(b"\n".join([x for k, x in enumerate(lines) if k not in out]))
            yield pa.RecordBatch.from_arrays([batch.column("rid"), batch.column("doc_id"), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), batch.column("n_linked"), pa.array(kept, pa.binary()).cast(pa.string())], names=["rid", "doc_id", "n_lines", "n_removed", "n_linked", "kept"])

    small_batches(rows.sparkSession)
    return rows.select("rid", "doc_id", "text", "gone", "n_linked").mapInArrow(run, "rid long, doc_id long, n_lines long, n_removed long, n_linked long, kept string")


def lines_of_copies(rows: DataFrame) -> DataFrame:
    """rid, doc_id, n_lines, n_removed, kept: a later copy of a whole text loses every line that takes part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total, removed, kept = [], [], []
            for text, some in zip(_bytes_of(batch.column("text")), batch.column("some").to_pylist(), strict=True):
                gone, lines = set(Lines([text]).number.tolist()) if some else set(), text.split(b"\n")
                total.append(len(lines) if some else 0)
                removed.append(len(gone))
                kept.append(b"\n".join([x for k, x in enumerate(lines) if k not in gone]))
            yield pa.RecordBatch.from_arrays([batch.column("rid"), batch.column("doc_id"), batch.column("head"), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], names=["rid", "doc_id", "head", "n_lines", "n_removed", "kept"])

    return rows.mapInArrow(run, "rid long, doc_id long, head long, n_lines long, n_removed long, kept string")


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """rid, doc_id, n_lines, n_removed, n_linked (lines in a class with other texts), digest or kept (text); the other is null."""
    context = docs.sparkSession.sparkContext
    small_batches(docs.sparkSession)
    every = numbered(docs)
    copies = exact_copies(every, id_col, text_col)
    docs = left_after(every, copies)
    whole = docs.select(text_or_empty(text_col).alias("text"))
    part_bits = slots.part_bits(whole, BYTES_A_KEY)
    names = cut(slots.shared(whole, keys_of, part_bits))
    rows = cut(candidates(docs, context.broadcast(bloom.build(names, "name", counted=True)), part_bits, id_col, text_col))
    lines = rows.select("rid", "doc_id", F.explode("lines").alias("x")).select("rid", "doc_id", "x.*")
    keyed = lines.select("node", F.lit(True).alias("own"), F.explode("own").alias("bucket")).unionByName(lines.select("node", F.lit(False).alias("own"), F.explode("probes").alias("bucket")))
    members = cut(keyed.groupBy("bucket", "node").agg(F.max("own").alias("own")))
    chosen = members.groupBy("bucket").agg(F.min(F.when(F.col("own"), F.col("node"))).alias("a"), F.count("*").alias("n")).where((F.col("n") > 1) & F.col("a").isNotNull())
    met = cut(members.join(chosen.select("bucket", "a"), "bucket").select("bucket", "a", F.col("node").alias("b")))
    texts = split_lines(rows.where(F.col("text").isNotNull()))
    texts = cut(texts.join(met.select(F.col("b").alias("node")).distinct(), "node").dropDuplicates(["node"]))
    classes = classes_in_buckets(met, lambda pairs: verified(pairs, texts), lambda groups: across(groups, texts))

    placed = lines.join(classes, "node", "left").select("rid", F.coalesce("class", "node").alias("class"), F.struct("doc_id", "line").alias("place"), F.col("class").isNotNull().alias("linked"))
    first = placed.groupBy("class").agg(F.min("place").alias("first"))
    judged = placed.join(first, "class")
    later = F.col("place") > F.col("first")
    spans = judged.where(later | F.col("linked")).groupBy("rid").agg(F.collect_list(F.when(later, F.col("place.line"))).alias("gone"), F.count_if("linked").alias("n_linked"))  # bounded by the text
    touched = without_lines(rows.where(F.col("text").isNotNull()).select("rid", "doc_id", "text").join(spans, "rid", "left").withColumn("n_linked", F.coalesce("n_linked", F.lit(0).cast("long"))))
    clean = rows.where(F.col("text").isNull()).select("rid", "doc_id", "n_lines", F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_linked"), "digest", F.lit(None).cast("string").alias("kept"))
    copied = every.select(F.col(ROW).alias("rid"), text_or_empty(text_col).alias("text"), F.col(text_col).isNotNull().alias("some")).join(few(copies), "rid")
    copied = lines_of_copies(copied).join(spans.select(F.col("rid").alias("head"), "n_linked"), "head", "left").withColumn("n_linked", F.coalesce("n_linked", F.lit(0).cast("long"))).drop("head")
    touched = touched.unionByName(copied)
    return clean.unionByName(touched.withColumn("digest", F.lit(None).cast("string")))

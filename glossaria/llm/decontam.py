"""Benchmark decontamination: one Aho-Corasick automaton over normalised benchmark windows.

A window is `width` consecutive words of a benchmark item (the whole item if it has fewer). Texts and items are
normalised alike (A-Z lower-cased, words joined by single spaces), every text is scanned once, and what is found is
mapped back to words and to byte offsets of the original text.

The automaton goes to every task, so its patterns are bounded: beyond `max_pattern_bytes` the items are dealt into blocks
by hash, every block is scanned in turn and the hits are merged, with the same result.

Defined cases: null texts have no words, no hits and are clean; items without words are ignored; items of equal text both
count; an item whose id is null counts under the empty string; an empty benchmark leaves all documents clean.
"""

from __future__ import annotations

import itertools
import math
import re
import uuid
from collections import defaultdict

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from glossaria.llm.common import NORMAL_BYTES, numbered, row_id, small_batches, text_or_empty

WIDTH = 13
MAX_PATTERN_BYTES = 64 << 20
WORD_BYTES = re.compile(rb"[^ ]+")  # of normalised bytes, which stand where the original ones do
HIT = "struct<first_word:int,last_word:int,first_byte:int,end_byte:int,items:array<string>>"


def words_of(text: str) -> list[bytes]:
    return text.encode().translate(NORMAL_BYTES).split()


def windows(text: str, width: int) -> set[bytes]:
    words = words_of(text)
    return {b" ".join(words[k : k + width]) for k in range(max(1, len(words) - width + 1))} if words else set()


_automata: dict[str, ahocorasick.Automaton] = {}


def _automaton(shared) -> ahocorasick.Automaton:
    """Built once a worker process from the broadcast items."""
    if (key := shared.value[0]) not in _automata:
        _, items, width = shared.value
        owners = defaultdict(set)
        for item, text in items:
            for w in windows(text, width):
                owners[b" %s " % w].add(item)
        a = ahocorasick.Automaton()
        for w, ids in owners.items():
            a.add_word(w.decode("latin-1"), (len(w), sorted(ids)))
        a.make_automaton()
        _automata.clear()
        _automata[key] = a
    return _automata[key]


def _scan(automaton, data: bytes) -> tuple[int, list]:
    """Number of words; hits as (first word, last word, first byte, end byte, items), overlapping ones of the same items joined."""
    normal = data.translate(NORMAL_BYTES)
    words = normal.split()
    if not words or not len(automaton):
        return len(words), []
    line = (b" %s " % b" ".join(words)).decode("latin-1")
    found = sorted((end - size + 1, end, ids) for end, (size, ids) in automaton.iter(line))
    if not found:
        return len(words), []
    spaces = np.flatnonzero(np.frombuffer(line.encode("latin-1"), np.uint8) == 0x20)
    spans = [m.span() for m in WORD_BYTES.finditer(normal)]
    hits = []
    for start, end, ids in found:
        first, last = int(np.searchsorted(spaces, start)), int(np.searchsorted(spaces, end)) - 1
        if hits and hits[-1][4] == ids and first <= hits[-1][1] + 1:
            hits[-1][1], hits[-1][3] = max(hits[-1][1], last), max(hits[-1][3], spans[last][1])
        else:
            hits.append([first, last, spans[first][0], spans[last][1], ids])
    return len(words), hits


def find_hits(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text", max_pattern_bytes: int = MAX_PATTERN_BYTES) -> DataFrame:
    """rid, doc_id, n_words, hits: one row of each document and block."""
    spark, docs = docs.sparkSession, numbered(docs)
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), text_or_empty().alias("text"))
    # A window is repeated in up to `width` patterns.
    total = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"] * width
    blocks = max(1, math.ceil(total / max_pattern_bytes))
    schema = f"rid long, doc_id long, n_words long, hits array<{HIT}>"
    rows = docs.select(row_id(docs).alias("rid"), F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    small_batches(spark)

    def scan(k: int) -> DataFrame:
        own = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == k).toArrow()
        shared = spark.sparkContext.broadcast((uuid.uuid4().hex, list(zip(*(own.column(c).to_pylist() for c in ("item", "text")), strict=True)), width))

        def run(batches):
            automaton = _automaton(shared)
            for batch in batches:
                found = [_scan(automaton, x.as_buffer().to_pybytes() if x.as_buffer() else b"") for x in batch.column("text")]
                names = ("first_word", "last_word", "first_byte", "end_byte", "items")
                hits = pa.array([[dict(zip(names, h, strict=True)) for h in hs] for _, hs in found], pa.list_(pa.struct([*((n, pa.int32()) for n in names[:4]), ("items", pa.list_(pa.string()))])))
                yield pa.RecordBatch.from_arrays([batch.column("rid"), batch.column("doc_id"), pa.array([n for n, _ in found], pa.int64()), hits], names=["rid", "doc_id", "n_words", "hits"])

        return rows.mapInArrow(run, schema)

    parts = [scan(k) for k in range(blocks)]
    if blocks == 1:
        return parts[0]
    everything = parts[0]
    for part in parts[1:]:
        everything = everything.unionByName(part)
    return everything.groupBy("rid", "doc_id").agg(F.max("n_words").alias("n_words"), F.flatten(F.collect_list("hits")).alias("hits"))  # a row of each block


def covered_words(hits: Column) -> Column:
    """Words inside any hit."""
    start = F.struct(F.lit(-1).alias("last"), F.lit(0).cast("long").alias("n"))
    step = lambda a, h: F.struct(
        F.greatest(a["last"], h["last_word"]).alias("last"),
        (a["n"] + F.greatest(F.lit(0), h["last_word"] - F.greatest(a["last"], h["first_word"] - 1))).cast("long").alias("n"),
    )
    return F.aggregate(F.array_sort(hits), start, step, lambda a: a["n"])


def judge(docs: DataFrame, benchmark: DataFrame, percent: int = 5, **options) -> DataFrame:
    """rid, doc_id, n_words, n_hit, items (sorted), contaminated: at least `percent` of the words are hit."""
    found = find_hits(docs, benchmark, **options)
    items = F.array_sort(F.array_distinct(F.flatten(F.transform("hits", lambda h: h["items"]))))
    judged = found.select("rid", "doc_id", "n_words", covered_words(F.col("hits")).alias("n_hit"), items.alias("items"))
    return judged.withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * 100 >= F.col("n_words") * percent))

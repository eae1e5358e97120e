"""License scans: exact set-similarity join of text blocks and license templates.

A template of `n` words belongs to the least stride of 64, 128, 256, ... words that is no less than `n`. A block is two
strides of consecutive words of a text, one starting at every stride, so whatever is as long as the template lies whole in
some block. Template tokens are put in one global order, by the number of documents with them, rarest first. A template
that must share `need` of its `n` tokens with a block has one of its first `n - need + 1` in it: blocks without any such
token are passed over, the rest are joined on these tokens, and pairs whose lengths or positions leave too few tokens to
come are dropped before containment is computed. Phrases are templates of containment 1 whose words must then stand
consecutively.

Texts are split into words once: what is kept of a text is which template tokens it has, and its words only if the whole
text has as many as some template needs. Templates are scanned in groups of bounded size, so there may be any number of
them, of any length; texts are never shuffled.

Defined cases: a null text has no words, no labels and score 0; repeated rows are judged one by one; a template without
words is ignored; texts of any length are cut into blocks whole; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections.abc import Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from glossaria.llm.common import alnum_words, ascii_lower, cut, row_id, text_or_empty

STRIDE = 64
THRESHOLD = 0.8
GROUP_WORDS = 5_000  # template words scanned together, unless one template has more
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


class Template(NamedTuple):
    label: str
    text: str
    phrase: bool = False  # its words must stand consecutively

    @property
    def words(self) -> list[str]:
        return WORD.findall(self.text.translate(LOWER))

    @property
    def stride(self) -> int:
        return STRIDE << max(0, math.ceil(math.log2(len(self.words) / STRIDE)))

    def need(self, threshold: float) -> int:
        n = len(set(self.words))
        return n if self.phrase else math.ceil(threshold * n - 1e-9)


def strings(words: Sequence[str]) -> Column:
    return F.array(*map(F.lit, words)) if words else F.array().cast("array<string>")


def groups_of(templates: Sequence[Template]) -> list[list[int]]:
    """Numbers of templates that are scanned together: of one stride, and of `GROUP_WORDS` words at most."""
    out: list[list[int]] = []
    size = 0
    for k in sorted((k for k, t in enumerate(templates) if t.words), key=lambda k: templates[k].stride):
        n = len(templates[k].words)
        if not out or templates[out[-1][0]].stride != templates[k].stride or size + n > GROUP_WORDS:
            out.append([])
            size = 0
        out[-1].append(k)
        size += n
    return out


def tokens_of(docs: DataFrame, templates: Sequence[Template], groups: list[list[int]], threshold: float, id_col: str, text_col: str) -> DataFrame:
    """rid, doc_id, n_words, for each group tokens_g (template tokens in the text) and words_g (null unless some template
    has as many tokens in the whole text as it needs)."""
    texts = docs.select(row_id(docs).alias("rid"), F.col(id_col).alias("doc_id"), alnum_words(ascii_lower(text_or_empty(text_col))).alias("words"))
    tokens = {f"tokens_{g}": F.array_intersect(strings(sorted({w for k in own for w in templates[k].words})), "words") for g, own in enumerate(groups)}
    texts = texts.withColumns(tokens)
    words = {}
    for g, own in enumerate(groups):
        book = F.array(*(F.struct(strings(sorted(set(templates[k].words))).alias("tokens"), F.lit(templates[k].need(threshold)).alias("need")) for k in own))
        held = F.col(f"tokens_{g}")
        enough = F.exists(book, lambda t: F.size(F.array_intersect(held, t["tokens"])) >= t["need"])  # noqa: B023 (called at once)
        words[f"words_{g}"] = F.when(enough, F.col("words"))
    return cut(texts.select("rid", "doc_id", F.size("words").cast("long").alias("n_words"), *tokens, *(c.alias(n) for n, c in words.items())))


def document_counts(held: DataFrame, groups: list[list[int]]) -> dict[str, int]:
    """Documents with each template token: a row of each at most."""
    every = F.array_distinct(F.concat(*(f"tokens_{g}" for g in range(len(groups)))))
    return {r["token"]: r["n"] for r in held.select(F.explode(every).alias("token")).groupBy("token").agg(F.count("*").alias("n")).collect()}


def scan_group(held: DataFrame, words: str, templates: Sequence[Template], own: list[int], count: dict[str, int], threshold: float) -> DataFrame:
    """rid, hit of the group's templates."""
    stride, spark = templates[own[0]].stride, held.sparkSession
    order = sorted({w for k in own for w in templates[k].words}, key=lambda w: (count.get(w, 0), w))
    rank = {w: k for k, w in enumerate(order)}
    book, probes = [], []
    for k in own:
        t, need = templates[k], templates[k].need(threshold)
        tokens = sorted(set(t.words), key=rank.__getitem__)
        book.append((k, t.label, t.phrase, t.words, tokens, need))
        probes += [(token, at, k) for at, token in enumerate(tokens[: len(tokens) - need + 1])]
    rare, known = strings(sorted({p[0] for p in probes})), strings(order)

    texts = held.where(F.col(words).isNotNull()).select("rid", F.col(words).alias("words"))
    starts = F.sequence(F.lit(0), F.greatest(F.size("words") - 1, F.lit(0)), F.lit(stride))
    blocks = texts.select("rid", "words", F.explode(starts).alias("start")).select("rid", "start", F.slice("words", F.col("start") + 1, F.lit(2 * stride)).alias("block"))
    blocks = blocks.where(F.arrays_overlap("block", rare)).withColumn("tokens", F.array_intersect(known, "block"))
    tried = blocks.select("*", F.posexplode("tokens").alias("at", "token"))
    index = spark.createDataFrame(probes, "token string, t_at int, template int").join(
        spark.createDataFrame(book, "template int, label string, phrase boolean, t_words array<string>, t_tokens array<string>, need int"), "template"
    )
    left = F.least(F.size("tokens") - F.col("at"), F.size("t_tokens") - F.col("t_at"))  # tokens still to come on the shorter side
    met = tried.join(index, "token").where((F.size("tokens") >= F.col("need")) & (left + F.least("at", "t_at") >= F.col("need")))
    shared = F.size(F.array_intersect("tokens", "t_tokens"))
    places = F.filter(F.sequence(F.lit(0), F.least(F.lit(stride), F.size("block")) - 1), lambda i: F.slice("block", i + 1, F.size("t_words")) == F.col("t_words"))
    hit = F.struct(
        "template", "label", "phrase", "start", (shared / F.size("t_tokens")).alias("containment"),
        F.when(F.col("phrase"), F.transform(places, lambda i: i + F.col("start"))).alias("places"),
    )
    return met.where(shared >= F.col("need")).select("rid", hit.alias("hit"))


def scan(docs: DataFrame, templates: Sequence[Template], threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """rid, doc_id, n_words, hits: array of (template, label, phrase, start: block's first word, containment, places)."""
    groups = groups_of(templates)
    held = tokens_of(docs, templates, groups, threshold, id_col, text_col)
    count = document_counts(held, groups) if groups else {}
    found = [scan_group(held, f"words_{g}", templates, own, count, threshold) for g, own in enumerate(groups)]
    rows = held.select("rid", "doc_id", "n_words")
    if not found:
        return rows.withColumn("hits", F.array().cast("array<struct<template:int,label:string,phrase:boolean,start:int,containment:double,places:array<int>>>"))
    # Texts with a hit are few beside all; their hits are gathered, at most one of each block and template.
    hits = reduce(DataFrame.unionByName, found).groupBy("rid").agg(F.collect_set("hit").alias("hits"))
    return rows.join(hits, "rid", "left").withColumn("hits", F.coalesce("hits", F.array()))


def summarise(scanned: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    real = F.filter("hits", lambda h: ~h["phrase"] | (F.size(h["places"]) > 0))
    out = scanned.withColumn("hits", real).withColumn("places", F.flatten(F.transform(F.filter("hits", lambda h: h["phrase"]), lambda h: h["places"])))
    names = lambda hits: F.array_join(F.array_sort(F.array_distinct(F.transform(hits, lambda h: h["label"]))), ",")
    return out.select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_base"),
        F.array_min("places").cast("long").alias("first_word"), F.array_max("places").cast("long").alias("last_word"),
        names(F.filter("hits", lambda h: h["phrase"])).alias("base_labels"), names(F.col("hits")).alias("labels"),
        F.coalesce(F.array_max(F.transform("hits", lambda h: h["containment"])), F.lit(0.0)).alias("score"),
    )

"""Source divergence audit: how the sources of a language differ in the terms they use.

Each group (lang, source) gives each kept term of its language a smoothed share p of the group's terms, in parts of
`SCALE`; two shares differ by f = (p - q)**2 / (p + q), rounded down. What a term adds to the difference of two sources
depends on its counts by source alone, so terms with the same sparse vector of counts are one row with a multiplicity,
and each pair of sources is evaluated once a distinct vector.

Let z be the share of a term that a group hasn't. The sum over all kept terms is split so that only pairs of sources that
both have the term need its vector: with f(a, b) of shares, and sums over the distinct counts of one source for the rest,

    sum f(pa, pb) = V f(za, zb) + sum over terms of a [f(pa, zb) - f(za, zb)] + the same for b
                    + sum over terms of both [f(pa, pb) - f(pa, zb) - f(za, pb) + f(za, zb)].

Terms are counted in the tasks that read the texts, which send one row of each (lang, source, term) for many texts, so a
source with a third of all rows is no hot key. A vector has at most as many entries as its language has sources. What a
task keeps is bounded by `PAIRS` sums and `TERMS` counts; beyond these it sends on what it has.

Defined cases: null texts, languages and sources are empty strings; a text is read whole, whatever its length; a language
without kept terms has pairs of value 0 and no terms; ties go by the item's bytes; repeated rows count each; an empty
table gives an empty result; other columns are not looked at, whatever their names.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from glossaria.llm.common import FEW_ROWS, cut, small_batches, text_or_empty

SCALE = 1_000_000_000
#: Counts and pair sums that a task gathers before it sends them on.
TERMS, PAIRS = 200_000, 2_000_000
#: Sources of one language that are compared with each other at once.
TILE = 256
#: Letters are ASCII ones and all bytes of other characters; A-Z become lower case, all else separates.
LETTERS = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))
#: Wide enough for a thousand million times any count.
WIDE = "decimal(38,0)"


def term_counts(docs: DataFrame, text_col: str, lang_col: str, source_col: str) -> DataFrame:
    """lang, source, term (null: the group occurs), n, docs: of each group, counted over many texts at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places: defaultdict[tuple, Counter] = defaultdict(Counter)
        holders: defaultdict[tuple, Counter] = defaultdict(Counter)
        n_texts: Counter[tuple] = Counter()
        held = 0

        def sent() -> pa.RecordBatch:
            columns: list[list] = [[], [], [], [], []]
            for (lang, source), k in n_texts.items():
                own, of_docs = places[lang, source], holders[lang, source]
                size = len(own) + 1
                for column, more in zip(columns, ([lang] * size, [source] * size, [None, *own], [k, *own.values()], [0, *map(of_docs.__getitem__, own)]), strict=True):
                    column += more
            for kept in (places, holders, n_texts):
                kept.clear()
            kinds = (pa.string(), pa.string(), pa.binary(), pa.int64(), pa.int64())
            arrays = [pa.array(c, kind) for c, kind in zip(columns, kinds, strict=True)]
            return pa.RecordBatch.from_arrays([*arrays[:2], arrays[2].cast(pa.string()), *arrays[3:]], names=["lang", "source", "term", "n", "docs"])

        for batch in batches:
            for lang, source, text in zip(*(batch.column(c).to_pylist() for c in ("lang", "source", "text")), strict=True):
                terms, own = text.translate(LETTERS).split(), places[lang, source]
                held -= len(own)
                own.update(terms)
                holders[lang, source].update(set(terms))
                held += len(own)
                n_texts[lang, source] += 1
                if held + len(n_texts) > TERMS:
                    yield sent()
                    held = 0
        if n_texts:
            yield sent()

    small_batches(docs.sparkSession)
    rows = docs.select(text_or_empty(lang_col).alias("lang"), text_or_empty(source_col).alias("source"), text_or_empty(text_col).cast("binary").alias("text"))
    made = rows.mapInArrow(run, "lang string, source string, term string, n long, docs long")
    return made.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(count: Column, total: Column, kept: Column) -> Column:
    """1 + floor(SCALE * (count + 2) / (total + 2 * kept)), exact for any count."""
    whole = F.expr(f"cast({SCALE} as decimal(10,0))") * (count + 2).cast("decimal(20,0)")
    return F.call_function("div", whole.cast(WIDE), (total + 2 * kept).cast("decimal(20,0)").cast(WIDE)) + 1


def differ(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def f(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    d = p - q
    return d * d // (p + q)


def both_sides(m: np.ndarray, p: np.ndarray, z: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Of rows (vectors, m times each) by sources: a, b and the sum over terms of both of f(pa, pb) - f(pa, zb) - f(za, pb) + f(za, zb), for
    sources a < b. A source that hasn't the term stands there with its z and adds nothing."""
    n = len(z)
    for a in range(n):
        for low in range(a + 1, n, TILE):
            b = slice(low, min(low + TILE, n))
            pa_, pb, za, zb = p[:, a : a + 1], p[:, b], z[a], z[None, b]
            sums = m @ (f(pa_, pb) - f(pa_, zb) - f(za, pb) + f(za, zb))
            yield np.full(b.stop - low, a), np.arange(low, b.stop), sums


def pair_sums(vectors: DataFrame) -> DataFrame:
    """lang, a, b, value: `both_sides` over distinct vectors (lang, m, entries of source, p, z in the order of sources)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: Counter[tuple] = Counter()

        def sent() -> pa.RecordBatch:
            rows = [(*k, v) for k, v in sums.items()]
            sums.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True), (pa.string(), pa.string(), pa.string(), pa.int64()), strict=True)], names=["lang", "a", "b", "value"])

        for batch in batches:
            langs, entries = np.array(batch.column("lang").to_pylist(), object), batch.column("entries").to_pylist()
            m = batch.column("m").to_numpy()
            for lang in dict.fromkeys(langs):
                rows = np.flatnonzero(langs == lang)
                known = {e["source"]: e["z"] for k in rows for e in entries[k]}
                names = sorted(known)
                place = {s: k for k, s in enumerate(names)}
                z = np.array([known[s] for s in names], np.int64)
                p = np.repeat(z[None], len(rows), 0)
                for j, k in enumerate(rows):
                    for e in entries[k]:
                        p[j, place[e["source"]]] = e["p"]
                for a, b, value in both_sides(m[rows], p, z):
                    for x, y, v in zip(a.tolist(), b.tolist(), value.tolist(), strict=True):
                        if v:
                            sums[lang, names[x], names[y]] += v
                    if len(sums) > PAIRS:
                        yield sent()
        if sums:
            yield sent()

    small_batches(vectors.sparkSession)
    return vectors.select("lang", "m", "entries").mapInArrow(run, "lang string, a string, b string, value long")


def sized(df: DataFrame, groups: int) -> DataFrame:
    """A table of at most a row a group, marked to be sent to all tasks if groups are counted to be few."""
    return F.broadcast(df) if groups <= FEW_ROWS else df


def audit(docs: DataFrame, least: int = 10, top: int = 10, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """lang, source, part (pair or term), item, value, rank: each other source of the language, and the `top` terms that
    a source uses more than its language does. Terms in fewer than `least` documents of the language don't count."""
    counted = cut(term_counts(docs, text_col, lang_col, source_col))
    entries = F.sort_array(F.collect_list(F.struct("source", "n")))  # at most one a source
    terms = counted.where(F.col("term").isNotNull()).groupBy("lang", "term").agg(F.sum("docs").alias("docs"), entries.alias("entries")).where(F.col("docs") >= least)
    terms = cut(terms.select("lang", "term", "entries", F.sha2(F.to_json(F.struct("entries")), 256).alias("vector")))
    distinct = cut(terms.groupBy("lang", "vector").agg(F.first("entries").alias("entries"), F.count("*").alias("m")))
    singles = distinct.select("lang", "vector", "m", F.explode("entries").alias("e")).select("lang", "vector", "m", "e.*")

    totals = singles.groupBy("lang", "source").agg(F.sum(F.col("n") * F.col("m")).alias("total"))
    kept = distinct.groupBy("lang").agg(F.sum("m").alias("kept"))
    groups = counted.where(F.col("term").isNull()).select("lang", "source").join(totals, ["lang", "source"], "left").join(kept, "lang", "left")
    groups = groups.select("lang", "source", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("kept", F.lit(0)).alias("kept"))
    groups = groups.withColumn("z", F.when(F.col("kept") > 0, share(F.lit(0).cast("long"), F.col("total"), F.col("kept"))))
    groups = cut(groups.withColumn("lang_total", F.sum("total").over(Window.partitionBy("lang"))))  # a row a source
    n_groups = groups.count()
    few = sized(groups, n_groups)

    shares = cut(singles.join(few, ["lang", "source"]).withColumn("p", share(F.col("n"), F.col("total"), F.col("kept"))).select("lang", "vector", "m", "source", "n", "p", "z", "lang_total", "kept"))
    values = _pairs(shares, groups, few)
    by_value = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = values.withColumn("rank", F.row_number().over(by_value)).withColumn("part", F.lit("pair"))

    whole = shares.withColumn("in_lang", F.sum("n").over(Window.partitionBy("lang", "vector")))
    q = share(F.col("in_lang"), F.col("lang_total"), F.col("kept"))
    more = whole.withColumn("q", q).where(F.col("p") > F.col("q")).withColumn("value", differ(F.col("p"), F.col("q")))
    # Only vectors with one of the first values can have a term of the first ranks.
    first = more.withColumn("r", F.rank().over(Window.partitionBy("lang", "source").orderBy(F.desc("value")))).where(F.col("r") <= top)
    named = first.select("lang", "source", "vector", "value").join(terms.select("lang", "vector", F.col("term").alias("item")), ["lang", "vector"])
    ranked = named.withColumn("rank", F.row_number().over(by_value)).where(F.col("rank") <= top).withColumn("part", F.lit("term"))
    columns = ("lang", "source", "part", "item", "value", "rank")
    return pairs.select(*columns).unionByName(ranked.select(*columns))


def _pairs(shares: DataFrame, groups: DataFrame, few: DataFrame) -> DataFrame:
    """lang, source, item, value of each ordered pair of a language's sources."""
    vector = shares.groupBy("lang", "vector", "m").agg(F.sort_array(F.collect_list(F.struct("source", "p", "z"))).alias("entries"))
    both = cut(pair_sums(vector.where(F.size("entries") > 1)).groupBy("lang", "a", "b").agg(F.sum("value").alias("both")))
    both = both.unionByName(both.select("lang", F.col("b").alias("a"), F.col("a").alias("b"), "both"))
    other = few.select("lang", F.col("source").alias("b"), F.col("z").alias("zb"))
    # One side: how many terms of a source have each share, against each other source's z.
    levels = shares.groupBy("lang", "source", "p", "z").agg(F.sum("m").alias("m"))
    step = differ(F.col("p"), F.col("zb")) - differ(F.col("z"), F.col("zb"))
    side = levels.join(other, "lang").where(F.col("source") != F.col("b")).groupBy("lang", F.col("source").alias("a"), "b").agg(F.sum(F.col("m") * step).alias("side"))
    side = cut(side)
    pairs = groups.select("lang", F.col("source").alias("a"), "z", "kept").join(other, "lang").where(F.col("a") != F.col("b"))
    base = F.when(F.col("kept") > 0, F.col("kept") * differ(F.col("z"), F.col("zb"))).otherwise(0)
    pairs = pairs.select("lang", "a", "b", base.alias("base"))
    for more in (side, side.select("lang", F.col("b").alias("a"), F.col("a").alias("b"), F.col("side").alias("other_side")), both):
        pairs = pairs.join(more, ["lang", "a", "b"], "left")
    value = F.col("base") + sum(F.coalesce(c, F.lit(0)) for c in ("side", "other_side", "both"))
    return pairs.select("lang", F.col("a").alias("source"), F.col("b").alias("item"), value.cast("long").alias("value"))

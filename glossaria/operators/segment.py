"""Longest-match segmentation of lines, and reading annotation of Japanese terms."""

from __future__ import annotations

import re
import unicodedata
from itertools import groupby

from pyspark.sql import DataFrame, functions as F, types as T

from glossaria.functions.columns import JAPANESE
from glossaria.functions.kana import to_hiragana
from glossaria.operators.lookup import find_terms, reaching
from glossaria.sources.scratch import written

SCAN_LENGTH = 20


def windows(lines: DataFrame, scan_length: int = SCAN_LENGTH) -> DataFrame:
    """line columns, pos (from 0) and window: what a lookup at each place sees."""
    at = F.when(F.length("line") > 0, F.sequence(F.lit(0), F.length("line") - 1)).otherwise(F.array().cast("array<int>"))
    return lines.withColumn("pos", F.explode(at)).withColumn("window", F.substring(F.col("line"), F.col("pos") + 1, F.lit(scan_length)))


def longest_matches(lines: DataFrame, texts: DataFrame, scan_length: int = SCAN_LENGTH, by: tuple[str, ...] = ("line_id",)) -> DataFrame:
    """line ids, pos, size of the longest text of `texts` (text) that starts there.

    Windows are cut to the lengths that texts have, distinct ones are met once by an equi-join.
    """
    lengths = sorted(r[0] for r in texts.select(F.length("text")).distinct().collect() if r[0] and r[0] <= scan_length)  # at most scan_length
    sizes = F.array(*map(F.lit, lengths)) if lengths else F.array().cast("array<int>")
    spans = windows(lines, scan_length).select(*by, "pos", F.explode(F.filter(sizes, lambda n: n <= F.length("window"))).alias("size"), "window")
    spans = spans.select(*by, "pos", "size", F.substring(F.col("window"), F.lit(1), F.col("size")).alias("text"))
    met = spans.join(texts.select("text").distinct(), "text")
    return met.groupBy(*by, "pos").agg(F.max("size").alias("size"))


def segments(lines: DataFrame, texts: DataFrame, scan_length: int = SCAN_LENGTH, by: tuple[str, ...] = ("line_id",)) -> DataFrame:
    """line ids, seg_no, pos, text, matched by the longest text of `texts` at each place."""
    return chained(lines, longest_matches(lines, texts, scan_length, by), by)


def chained(lines: DataFrame, matches: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """line ids, seg_no, pos, text, matched: from the left, the match (line ids, pos, size) at each place; what lies
    between is one unmatched segment. A match of one letter counts only if it is Japanese.

    A line's matches are gathered, at most one a letter, and chained by a fold.
    """
    letter = F.substring(F.col("line"), F.col("pos") + 1, F.lit(1))
    found = matches.select(*by, "pos", "size").join(lines.select(*by, "line"), list(by))
    found = found.where((F.col("size") > 1) | letter.rlike(f"[{JAPANESE}]"))
    gathered = found.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("pos", "size"))).alias("matches"))
    own = lines.select(*by, "line").join(gathered, list(by), "left").withColumn("matches", F.coalesce("matches", F.array().cast("array<struct<pos:int,size:int>>")))
    piece = "array<struct<pos:int,size:int,matched:boolean>>"
    gap = lambda a, b: F.when(b > a, F.array(F.struct(a.alias("pos"), (b - a).alias("size"), F.lit(False).alias("matched")))).otherwise(F.array().cast(piece))
    start = F.struct(F.lit(0).alias("next"), F.array().cast(piece).alias("out"))
    step = lambda a, m: F.when(m["pos"] >= a["next"], F.struct((m["pos"] + m["size"]).alias("next"), F.concat(a["out"], gap(a["next"], m["pos"]), F.array(F.struct(m["pos"].alias("pos"), m["size"].alias("size"), F.lit(True).alias("matched")))).alias("out"))).otherwise(a)
    chained = own.withColumn("s", F.aggregate("matches", start, step, lambda a: F.concat(a["out"], gap(a["next"], F.length("line")))))
    each = chained.select(*by, "line", F.posexplode("s").alias("seg_no", "seg"))
    return each.select(*by, "seg_no", F.col("seg.pos").alias("pos"), F.substring(F.col("line"), F.col("seg.pos") + 1, F.col("seg.size")).alias("text"), F.col("seg.matched").alias("matched"))


def parse(texts: DataFrame, terms: DataFrame, enabled: DataFrame, language: str, scan_length: int = SCAN_LENGTH, parts: bool = False, **options) -> DataFrame:
    """text_id, line_no, seg_no, text, matched, reading, headwords of each line of (text_id, text); with `parts` also the
    parts of each segment with the reading that is theirs in this inflected form.

    What a place's window finds in the dictionaries, rewritten forms too, is one segment: as much of the window as the
    longest hit took, with the best entry's reading and the headwords met by just that text, best first. What is looked
    up, once, are the distinct prefixes that are the longest ones of a window to reach a term, and only entries of the
    longest text of each are made.
    """
    by = ("text_id", "line_no")
    lines = texts.select("text_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    seen = windows(lines, scan_length).select(*by, "pos", F.substring("window", 1, scan_length).alias("window"))
    asked = seen.select(F.col("window").alias("text")).distinct()
    if {"by", "deinflect", "remove_non_japanese"}.isdisjoint(options):
        reach = reaching(asked, terms, language, options.get("replacements", ()))
    else:
        reach = asked.withColumn("reach", F.col("text"))
    reach = written(reach.withColumnRenamed("text", "window"))
    found = find_terms(reach.select(F.col("reach").alias("text")).distinct().withColumn("query_id", F.col("text")), terms, enabled, language, "simple", definitions=False, longest=True, **options)
    heads = F.transform("headwords", lambda h: F.struct("rank", h["expression"].alias("expression"), h["reading"].alias("reading"), F.transform(h["sources"], lambda x: x["original_text"]).alias("texts")))
    best = found.select("query_id", "max_length", "rank", heads.alias("heads")).groupBy(F.col("query_id").alias("reach")).agg(
        F.max("max_length").alias("size"), F.flatten(F.array_sort(F.collect_list("heads"))).alias("heads"), F.min_by(F.col("heads")[0]["reading"], "rank").alias("reading"), F.min_by(F.col("heads")[0]["expression"], "rank").alias("term"),
    )
    met = F.filter("heads", lambda h: F.array_contains(h["texts"], F.left("reach", F.col("size"))))
    best = best.select("reach", "size", "reading", "term", F.transform(met, lambda h: F.struct(h["expression"].alias("expression"), h["reading"].alias("reading"))).alias("headwords"))
    matches = seen.join(reach, "window").join(best, "reach").select(*by, "pos", "size", "reading", "headwords", "term")
    segments_ = chained(lines, matches, by).join(matches.drop("size"), [*by, "pos"], "left")
    own = lambda c: F.when(F.col("matched"), F.col(c))
    out = segments_.select(*by, "seg_no", "pos", "text", "matched", F.coalesce(own("reading"), F.lit("")).alias("reading"), own("headwords").alias("headwords"), own("term").alias("term"))
    return with_inflected_furigana(out).drop("term") if parts else out.drop("term")


def parse_text(texts: DataFrame, dictionary: DataFrame, scan_length: int = SCAN_LENGTH) -> DataFrame:
    """text_id, line_no, seg_no, text, matched of each line of (text_id, text)."""
    lines = texts.select("text_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return segments(lines, dictionary, scan_length, ("text_id", "line_no")).drop("pos")


KANA_LETTERS = "\u3040-\u30ff"


def without_diacritics(text: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFD", text) if not "̀" <= c <= "ͯ")


def kana_parts(text: str, reading: str) -> list[tuple[str, str]]:
    """Runs of kana that are read as they stand, and runs that the reading spells in the other kana."""
    runs = [(same, [x for x, _ in pairs]) for same, pairs in ((k, list(g)) for k, g in groupby(zip(text, reading, strict=True), lambda p: p[0] == p[1]))]
    out, at = [], 0
    for same, letters in runs:
        out.append(("".join(letters), "" if same else reading[at : at + len(letters)]))
        at += len(letters)
    return out


def furigana(term: str, reading: str) -> list[dict[str, str]]:
    """Parts of a term with their readings; kana read as themselves. A term that can be split in several ways, or in
    none, is one part."""
    if not reading or reading == term:
        return [{"text": term, "reading": ""}]
    groups = re.findall(f"[{KANA_LETTERS}]+|[^{KANA_LETTERS}]+", term)
    is_kana = [bool(re.match(f"[{KANA_LETTERS}]", g)) for g in groups]
    plain = to_hiragana(reading)

    def split(k: int, at: int) -> list[list[tuple[str, str]]]:
        """Up to two ways to read the groups from the k-th on."""
        if k == len(groups):
            return [[]] if at == len(reading) else []
        if is_kana[k]:
            own = to_hiragana(groups[k])
            if not plain.startswith(own, at):
                return []
            return [[*kana_parts(groups[k], reading[at : at + len(own)]), *rest] for rest in split(k + 1, at + len(own))[:2]]
        ways = []
        for end in range(len(reading), at + len(groups[k]) - 1, -1):
            ways += [[(groups[k], reading[at:end]), *rest] for rest in split(k + 1, end)]
            if len(ways) > 1:
                break
        return ways

    ways = split(0, 0)
    return [{"text": t, "reading": r} for t, r in ways[0]] if len(ways) == 1 else [{"text": term, "reading": reading}]


PARTS = T.ArrayType(T.StructType([T.StructField("text", T.StringType()), T.StructField("reading", T.StringType())]))


def furigana_inflected(term: str, reading: str, source: str) -> list[dict[str, str]]:
    """Parts of an inflected form of a term: what it shares with the term, or with the reading where that is more, is read
    as there; the rest reads as itself."""

    def shared(a: str) -> int:
        pairs = zip(to_hiragana(a), to_hiragana(source), strict=False)
        return next((k for k, (x, y) in enumerate(pairs) if x != y), min(len(a), len(source)))

    stem, by_reading, main = shared(term), shared(reading), term
    if by_reading and by_reading >= stem:
        stem, main, reading = by_reading, reading, source[:by_reading] + reading[by_reading:]
    out: list[dict[str, str]] = []
    at = 0
    for part in furigana(source[:stem] + main[stem:], reading) if stem else []:
        if at + len(part["text"]) <= stem:
            out.append(part)
        elif at < stem:
            out.append({"text": source[at:stem], "reading": ""})
        at += len(part["text"])
        if at >= stem:
            break
    rest = source[stem:]
    if rest and out and not out[-1]["reading"]:
        out[-1] = {"text": out[-1]["text"] + rest, "reading": ""}
    elif rest:
        out.append({"text": rest, "reading": ""})
    return out


def with_furigana(rows: DataFrame, term: str = "expression", reading: str = "reading") -> DataFrame:
    """Adds `furigana`; distinct pairs are annotated once."""
    annotate = F.udf(furigana, PARTS, useArrow=True)
    pairs = rows.select(term, reading).distinct().withColumn("furigana", annotate(term, reading))
    return rows.join(pairs, [term, reading], "left")


def with_inflected_furigana(rows: DataFrame, term: str = "term", reading: str = "reading", source: str = "text") -> DataFrame:
    """Adds `parts`: of a form (source) of a term; distinct ones are annotated once. A row without a term is one part."""
    annotate = F.udf(furigana_inflected, PARTS, useArrow=True)
    forms = rows.select(term, reading, source).where(F.col(term).isNotNull()).distinct().withColumn("parts", annotate(term, reading, source))
    alone = F.array(F.struct(F.col(source).alias("text"), F.lit("").alias("reading")))
    return rows.join(forms, [term, reading, source], "left").withColumn("parts", F.coalesce("parts", alone))


def diacritics_removed(rows: DataFrame, column: str, into: str) -> DataFrame:
    """NFD without combining marks U+0300 to U+036F; distinct texts once."""
    strip = F.udf(without_diacritics, T.StringType(), useArrow=True)
    texts = rows.select(column).where(F.col(column).isNotNull()).distinct().withColumn(into, strip(column))
    return rows.join(texts, column, "left")

"""Lookup of single characters: entries of every enabled dictionary, their frequencies and their described statistics.

Kanji have dictionary, character, onyomi, kunyomi, tags, meanings (arrays) and stats (a map); their metadata dictionary,
character and frequency; tags dictionary, name, category, order and notes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from glossaria.operators.metadata import kanji_stats


def characters(queries: DataFrame) -> DataFrame:
    """query_id, place, character: each of a text once, in order."""
    each = F.array_distinct(F.filter(F.split("text", ""), lambda c: c != ""))
    return queries.select("query_id", F.posexplode(each).alias("place", "character"))


def find_kanji(queries: DataFrame, kanji: DataFrame, enabled: DataFrame, meta: DataFrame | None = None, tags: DataFrame | None = None) -> DataFrame:
    """query_id, rank and what each enabled dictionary says of each character of (query_id, text); characters as they
    stand, dictionaries in their order. With `meta` also frequencies (idx, dictionary, frequency), in the same order; with
    `tags` also groups, the described statistics by category."""
    on = enabled.select(F.col("title").alias("dictionary"), "idx", "alias")
    found = characters(queries).join(kanji, "character").join(on, "dictionary")
    if meta is not None:
        known = meta.join(on, "dictionary").groupBy("character").agg(F.array_sort(F.collect_list(F.struct("idx", "dictionary", "frequency"))).alias("frequencies"))
        found = found.join(known, "character", "left")
    if tags is not None:
        described = kanji_stats(kanji.select("character", "dictionary", "stats"), tags)
        groups = described.groupBy("character", "dictionary").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("category", "stats")))).alias("groups"))
        found = found.join(groups, ["character", "dictionary"], "left")
    return found.withColumn("rank", F.struct("place", "idx"))

"""Frequencies, pronunciations and tags: what is joined to headwords, and how it is summed up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from glossaria.functions.columns import half_up, tag_base, to_number, whole_part

# Fixed values of a tag that no dictionary describes.
UNKNOWN_TAG = {"category": "default", "order": 0, "score": 0}


def reading_fits(meta_reading: Column, reading: Column, required: bool = False) -> Column:
    """Frequencies may leave the reading open; pitches and transcriptions must name it."""
    return meta_reading.eqNullSafe(reading) if required else meta_reading.isNull() | (meta_reading == reading)


def with_term_meta(headwords: DataFrame, meta: DataFrame) -> DataFrame:
    """Headwords (expression, reading, ...) met by metadata (expression, mode, meta_reading, ...)."""
    met = headwords.join(meta, "expression")
    return met.where(F.when(F.col("mode") == "freq", reading_fits(F.col("meta_reading"), F.col("reading"))).otherwise(reading_fits(F.col("meta_reading"), F.col("reading"), True)))


def frequency_value(data: Column) -> Column:
    """A frequency's (value, display): of a number, a text, {value, displayValue} or {reading, frequency: any of these}."""
    inner = F.coalesce(F.get_json_object(data, "$.frequency"), data)
    value = F.coalesce(F.get_json_object(inner, "$.value"), inner)
    shown = F.coalesce(F.get_json_object(inner, "$.displayValue"), F.when(inner.rlike('^"|^[^{0-9]'), F.regexp_replace(inner, '^"|"$', "")))
    return F.struct(to_number(value).alias("value"), shown.alias("display"))


def harmonic_mean(values: Column, rounded=half_up) -> Column:
    """Of the positive ones, as an aggregate; 0 if there are none."""
    positive = F.when(values > 0, values)
    return F.coalesce(rounded(F.count(positive) / F.sum(1.0 / positive)), F.lit(0)).cast("bigint")


def frequency_ranking(meta: DataFrame, by: list[str]) -> DataFrame:
    """The least frequency of each dictionary, then their rounded harmonic mean."""
    least = meta.groupBy(*by, "dictionary").agg(F.min("frequency").alias("frequency"))
    return least.groupBy(*by).agg(F.count("*").alias("dictionaries"), harmonic_mean(F.col("frequency")).alias("harmonic"))


def display_harmonic(meta: DataFrame, by: list[str]) -> DataFrame:
    """As shown with entries: all values are counted, only positive ones are summed."""
    positive = F.when(F.col("frequency") > 0, F.col("frequency"))
    return meta.groupBy(*by).agg(F.coalesce(half_up(F.count("frequency") / F.sum(1.0 / positive)), F.lit(-1)).cast("bigint").alias("harmonic"))


def runs_first(meta: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """The first value of each run of one dictionary."""
    before = F.lag("dictionary").over(Window.partitionBy(*by).orderBy(*order))
    return meta.withColumn("_before", before).where(~F.col("_before").eqNullSafe(F.col("dictionary"))).drop("_before")


def note_numbers(meta: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """As written to notes: first value of each run, leading digits of what is shown if positive; harmonic mean and
    average rounded down, -1 where there is none."""
    leading = F.regexp_extract("display", r"^\d+", 0)
    shown = F.when(leading != "", leading.cast("double"))
    value = F.when(shown > 0, shown).otherwise(F.col("frequency"))
    first = runs_first(meta, by, order).withColumn("_v", value)
    positive = F.when(F.col("_v") > 0, F.col("_v"))
    harmonic = whole_part(F.count("_v") / F.sum(1.0 / positive))
    return first.groupBy(*by).agg(F.coalesce(harmonic, F.lit(-1)).cast("bigint").alias("harmonic"), F.coalesce(whole_part(F.avg("_v")), F.lit(-1)).cast("bigint").alias("average"))


def term_frequencies(pairs: DataFrame, meta: DataFrame) -> DataFrame:
    """Pairs (term, reading or null) with every frequency that fits; an open reading takes the metadata's."""
    met = pairs.join(meta.withColumnRenamed("expression", "term"), "term")
    fits = F.col("meta_reading").isNull() | F.col("reading").isNull() | (F.col("meta_reading") == F.col("reading"))
    return met.where(fits).withColumn("reading", F.coalesce("reading", "meta_reading"))


def grouped_frequencies(meta: DataFrame) -> DataFrame:
    """dictionary, term: its distinct values, with an 'Average' dictionary of harmonic means."""
    own = meta.groupBy("dictionary", "expression").agg(F.array_sort(F.collect_set("frequency")).alias("values"))
    mean = display_harmonic(meta, ["expression"]).select(F.lit("Average").alias("dictionary"), "expression", F.array(F.col("harmonic").cast("double")).alias("values"))
    return own.select("dictionary", "expression", F.col("values").cast("array<double>").alias("values")).unionByName(mean)


def with_tags(named: DataFrame, tags: DataFrame, name: str = "tag") -> DataFrame:
    """Named tags (dictionary, name) with what the first description of their base name says, or the defaults."""
    w = Window.partitionBy("dictionary", "name").orderBy("tag_id")
    first = tags.withColumn("_n", F.row_number().over(w)).where("_n = 1").select("dictionary", F.col("name").alias("_base"), "category", "order", "score", "notes")
    met = named.withColumn("_base", tag_base(F.col(name))).join(first, ["dictionary", "_base"], "left").drop("_base")
    return met.fillna(UNKNOWN_TAG)


def merged_tags(tags: DataFrame, by: list[str]) -> DataFrame:
    """Tags of one name and category become one: least order, greatest score, all dictionaries and notes."""
    return tags.groupBy(*by, "tag", "category").agg(
        F.min("order").alias("order"), F.max("score").alias("score"), F.array_sort(F.collect_set("dictionary")).alias("dictionaries"), F.array_sort(F.collect_set("notes")).alias("content"),
    )


def redundant_tags(definitions: DataFrame, by: list[str], order: str, tags: str = "tags") -> DataFrame:
    """Whether a definition repeats the parts of speech of the one before it in its dictionary."""
    w = Window.partitionBy(*by).orderBy(order)
    key = F.array_join(F.array_sort(tags), ",")
    same = (F.lag("dictionary").over(w) == F.col("dictionary")) & (F.lag(key).over(w) == key)
    first_empty = F.lag("dictionary").over(w).isNull()
    return definitions.withColumn("redundant", F.coalesce(same & ~first_empty, F.lit(False)))


def popularity(scores: Column) -> Column:
    """popular, rare or normal, by the sign of the sum of tag scores."""
    total = F.sum(scores)
    return F.when(total > 0, "popular").when(total < 0, "rare").otherwise("normal")


def disambiguations(terms: Column, readings: Column, all_terms: Column, all_readings: Column) -> Column:
    """Which of an item's terms, or else readings, tell it apart from the entry's other headwords."""
    some_terms = (F.size(F.array_except(all_terms, terms)) > 0) & (F.size(terms) > 0)
    some_readings = (F.size(F.array_except(all_readings, readings)) > 0) & (F.size(readings) > 0)
    empty = F.array().cast("array<string>")
    return F.concat(F.when(some_terms, F.array_intersect(terms, all_terms)).otherwise(empty), F.when(some_readings, F.array_intersect(readings, all_readings)).otherwise(empty))


def grouped_pronunciations(pronunciations: DataFrame) -> DataFrame:
    """dictionary, reading, position with the terms that have it, and whether these are not all terms of the reading."""
    all_terms = pronunciations.groupBy("reading").agg(F.collect_set("expression").alias("all_terms"))
    own = pronunciations.groupBy("dictionary", "reading", "position").agg(F.array_sort(F.collect_set("expression")).alias("terms"))
    return own.join(all_terms, "reading").withColumn("exclusive", F.size(F.array_except("all_terms", "terms")) > 0).drop("all_terms")


def kanji_stats(kanji: DataFrame, tags: DataFrame) -> DataFrame:
    """character, dictionary, category: its described stats in order; stats without a description are left out."""
    each = kanji.select("character", "dictionary", F.explode("stats").alias("stat", "value")).withColumn("name", tag_base(F.col("stat")))
    met = each.join(tags.select("dictionary", "name", "category", "order", "notes"), ["dictionary", "name"])
    return met.groupBy("character", "dictionary", "category").agg(F.array_sort(F.collect_list(F.struct("order", "notes", "name", "value"))).alias("stats"))


def grouped_term_tags(tags: DataFrame, by: list[str]) -> DataFrame:
    """Tags of an entry's headwords (by..., headword, ord, name, category, content, dictionaries): by..., ord, the tag and
    headword_indices. With several headwords a tag that stands alike at more than one is one tag of all of them."""
    tag = ["name", "category", "content", "dictionaries"]
    several = tags.groupBy(*by).agg((F.count_distinct("headword") > 1).alias("_several"))
    once = tags.join(several, by).withColumn("_own", F.when(~F.col("_several"), F.col("ord")))
    place = F.struct("headword", "ord")
    met = once.groupBy(*by, *tag, "_own").agg(F.min(place).alias("_at"), F.array_sort(F.collect_list("headword")).alias("headword_indices"))
    order = F.row_number().over(Window.partitionBy(*by).orderBy("_at")) - 1
    return met.select(*by, order.alias("ord"), *tag, "headword_indices")

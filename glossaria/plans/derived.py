"""A dictionary derived from the corpus: sources are dictionaries, their lower-cased words are terms.

The same definitions stand in SQL, for comparison.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

WORD = "[A-Za-z]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _cut(text: str = "text") -> Column:
    """Runs of letters A-Z and a-z, lower-cased, with an empty text before the first and after the last if others stand
    there. Other letters go first: lower-casing would turn some of them into these."""
    return F.split(F.lower(F.regexp_replace(text, r"[^\x00-\x7F]+", " ")), "[^a-z]+")


def words(text: str = "text") -> Column:
    return F.array_remove(_cut(text), "")


def counted_words(docs: DataFrame) -> DataFrame:
    """dictionary, expression, score (documents with the word), freq (its places) of doc_id, dictionary, text.

    Where a dictionary's documents have numbers of their own, a document's words are made distinct in its row and both
    figures are sums, which tasks form before anything is shuffled. Otherwise numbers are counted distinct.
    """
    once = docs.groupBy("dictionary", "doc_id").agg(F.count("*").alias("n")).where("n > 1 AND doc_id IS NOT NULL").isEmpty()
    if not once:
        tokens = docs.select("doc_id", "dictionary", F.explode(words()).alias("expression"))
        return tokens.groupBy("dictionary", "expression").agg(F.countDistinct("doc_id").alias("score"), F.count("*").alias("freq"))
    cut = docs.select("doc_id", "dictionary", _cut().alias("w"))
    each = cut.select("doc_id", "dictionary", F.size("w").alias("n"), F.posexplode(F.concat("w", F.array_distinct("w"))).alias("pos", "expression")).where("expression <> ''")
    return each.groupBy("dictionary", "expression").agg(F.count(F.when((F.col("pos") >= F.col("n")) & F.col("doc_id").isNotNull(), 1)).alias("score"), F.count(F.when(F.col("pos") < F.col("n"), 1)).alias("freq"))


def distinct_words(docs: DataFrame) -> DataFrame:
    """dictionary, expression of dictionary, text, for those who ask no figures."""
    return docs.select("dictionary", F.explode(F.array_distinct(words())).alias("expression")).distinct()


def reading() -> Column:
    """An expression without vowels, as its dictionary has them; itself if nothing is left."""
    bare = F.when(F.col("dictionary").rlike("[13579]$"), F.regexp_replace("expression", "[aeiouy]", "")).otherwise(F.regexp_replace("expression", "[aeiou]", ""))
    return F.when(F.length(bare) > 0, bare).otherwise(F.col("expression"))


def part_of_speech(word: Column) -> Column:
    return F.when(word.endswith("ed") | word.endswith("ing"), "v").when(word.endswith("s"), "np").when(word.endswith("ly"), "adv").otherwise("n")


def terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """dictionary, id, expression, reading, rules, score, freq, sequence and tags; ids are texts. Terms of equal length and
    reading share a sequence. The
    reading is the word without vowels; y is a vowel in every other dictionary, so a word may have two readings."""
    counted = counted_words(table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("dictionary"), "text"))
    sequence = F.conv(F.substring(F.md5(F.concat_ws(" ", F.length("expression"), reading())), 1, 8), 16, 10).cast("long")
    tag = F.when(F.col("score") >= 5, "common").when(F.col("score") == 1, "rare").otherwise("usual")
    return counted.select(
        "dictionary", F.concat_ws("/", "dictionary", "expression").alias("id"), "expression", reading().alias("reading"), part_of_speech(F.col("expression")).alias("pos"),
        "score", "freq", sequence.alias("sequence"), tag.alias("tag"),
    )


TERMS_SQL = """
tokens AS (SELECT doc_id, source AS dictionary, unnest(regexp_extract_all(lower(regexp_replace(text, '[^A-Za-z]', ' ', 'g')), '[a-z]+')) AS expression FROM documents),
counted0 AS (SELECT dictionary, expression, count(DISTINCT doc_id) AS score, count(*) AS freq FROM tokens GROUP BY ALL),
counted AS (SELECT *, coalesce(nullif(CASE WHEN regexp_matches(dictionary, '[13579]$') THEN regexp_replace(expression, '[aeiouy]', '', 'g') ELSE regexp_replace(expression, '[aeiou]', '', 'g') END, ''), expression) AS reading FROM counted0),
terms AS (SELECT dictionary, dictionary || '/' || expression AS id, expression,
  reading,
  CASE WHEN ends_with(expression, 'ed') OR ends_with(expression, 'ing') THEN 'v' WHEN ends_with(expression, 's') THEN 'np' WHEN ends_with(expression, 'ly') THEN 'adv' ELSE 'n' END AS pos,
  score, freq, ('0x' || left(md5(length(expression) || ' ' || reading), 8))::BIGINT AS sequence,
  CASE WHEN score >= 5 THEN 'common' WHEN score = 1 THEN 'rare' ELSE 'usual' END AS tag FROM counted)
"""


def benchmark_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """item_id, word, ord: words of the benchmark's texts, each with its first place."""
    each = table(spark, sf_dir, "benchmark").select("item_id", F.posexplode(words()).alias("ord", "word"))
    return each.groupBy("item_id", "word").agg(F.min("ord").alias("ord"))


BENCHMARK_SQL = """
bw0 AS (SELECT item_id, regexp_extract_all(lower(regexp_replace(text, '[^A-Za-z]', ' ', 'g')), '[a-z]+') AS w FROM benchmark),
bw AS (SELECT item_id, word, min(ord) AS ord FROM (SELECT item_id, unnest(w) AS word, unnest(range(0, len(w))) AS ord FROM bw0) GROUP BY ALL)
"""

# Fixed values of the derived dictionary's tags: name, category, order, score, notes.
TAGS = (("common", "frequency", 1, 10, "in five documents or more"), ("usual", "frequency", 2, 0, "in some documents"), ("v", "partOfSpeech", 3, 1, "verb"), ("n", "partOfSpeech", 4, 1, "noun"), ("np", "partOfSpeech", 5, 1, "plural"))
TAGS_SQL = "tagmeta(name, category, ord, score, notes) AS (VALUES " + ", ".join(f"('{n}', '{c}', {o}, {s}, '{t}')" for n, c, o, s, t in TAGS) + ")"


def tags(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(TAGS), "name string, category string, ord int, score int, notes string")

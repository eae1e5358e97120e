"""Lookup over a stream of texts: a stateless join of the stream with static dictionary tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from glossaria.operators.lookup import exact_hits


def stream_words(stream: DataFrame, text: str = "text", word: str = r"([\p{L}\p{M}]+)") -> DataFrame:
    """The stream's rows, once for each word of theirs, lower-cased, as `word`."""
    return stream.withColumn("word", F.explode(F.regexp_extract_all(F.lower(text), F.lit(word), F.lit(1))))


def stream_lookup(stream: DataFrame, terms: DataFrame, text: str = "text") -> DataFrame:
    """Hits of each word in static terms. No state is kept, so late rows are looked up like any other."""
    return exact_hits(stream_words(stream, text), terms, "word")


def windowed_counts(hits: DataFrame, time: str, width: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Hits of each dictionary in tumbling windows; rows later than the watermark are left out."""
    return hits.withWatermark(time, late).groupBy(F.window(time, width), "dictionary").agg(F.count("*").alias("hits"))

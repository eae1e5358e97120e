"""The registry of languages, predicates of texts and word classes, and tags of several headwords."""

from glossaria.functions import columns as C
from glossaria.functions.languages import KNOWN, languages, lookup_worthy
from glossaria.operators.metadata import grouped_term_tags
from pyspark.sql import functions as F


def test_registry(spark):
    found = {r["iso"]: r for r in languages(spark).collect()}
    assert len(found) == len(KNOWN) and found["ja"]["name"] == "Japanese" and found["ko"]["after"] == ["reassembleHangul"]
    assert {iso for iso, r in found.items() if r["has_rules"]} == {"ar", "de", "en", "eo", "es", "fr", "ga", "grc", "ja", "ka", "ko", "la", "sga", "sq", "tl", "yi"}
    assert found["ro"]["processors"] == ["decapitalize", "capitalizeFirstLetter", "removeAlphabeticDiacritics"] and found["th"]["processors"] == []


def test_texts_worth_a_lookup(spark):
    rows = [("読む", "ja", True), ("read", "ja", False), ("ｶﾅ", "ja", True), ("read", "en", True), ("x", "xx", False), (None, "ja", False), ("x", None, False), ("", "en", True)]
    df = spark.createDataFrame(rows, "text string, language string, expected boolean")
    assert df.where(lookup_worthy(F.col("text"), F.col("language")) != F.col("expected")).count() == 0


def test_scripts_and_word_classes(spark):
    one = spark.range(1)
    val = lambda c: one.select(c.alias("x")).first()["x"]
    assert val(C.partly_chinese(F.lit("a讀"))) and val(C.partly_chinese(F.lit("ㄅ"))) and not val(C.partly_chinese(F.lit("abc")))
    assert val(C.partly_korean(F.lit("x읽"))) and val(C.partly_korean(F.lit("ㅏ"))) and not val(C.partly_korean(F.lit("読む")))
    classes = lambda *names: val(C.verb_or_adjective(F.array(*map(F.lit, names)).cast("array<string>")))
    assert classes("v5") and classes("vs") and classes("adj-i", "n") and not classes("n", "vs") and not classes("n") and not classes()


def test_tags_of_headwords(spark):
    schema = "entry int, headword int, ord int, name string, category string, content array<string>, dictionaries array<string>"
    tags = spark.createDataFrame([(1, 0, 0, "a", "x", ["c"], ["D"]), (1, 0, 1, "b", "x", [], ["D"]), (1, 1, 0, "b", "x", [], ["D"]), (1, 1, 1, "b", "y", [], ["D"]), (2, 0, 0, "a", "x", [], ["D"]), (2, 0, 1, "a", "x", [], ["D"])], schema)
    found = grouped_term_tags(tags, ["entry"]).orderBy("entry", "ord").collect()
    assert [(r["entry"], r["ord"], r["name"], r["category"], r["headword_indices"]) for r in found] == [(1, 0, "a", "x", [0]), (1, 1, "b", "x", [0, 1]), (1, 2, "b", "y", [1]), (2, 0, "a", "x", [0]), (2, 1, "a", "x", [0])]

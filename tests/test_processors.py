import unicodedata

import pytest

from glossaria.functions.processors import LANGUAGES, pinyin, text_variants, variants


@pytest.mark.parametrize(
    ("language", "text", "expected"),
    [
        ("en", "Hello", "hello"), ("en", "hello", "Hello"), ("de", "Straße", "strasse"), ("de", "dass", "daß"), ("fr", "l'eau", "l’eau"), ("fr", "L’eau", "l'eau"), ("la", "aedes", "ædes"), ("ru", "ёлка", "елка"), ("ru", "за́мок", "замок"),
        ("it", "città", "citta"), ("grc", "logos", "λογος"), ("vi", "hòa", "hoà"), ("vi", "thuý", "thúy"), ("ar", "كِتَاب", "كتاب"), ("sh", "kȕća", "kuca"), ("el", "α̋", "α"),
        ("ja", "ｶﾞｷﾞ", "ガギ"), ("ja", "ｶﾞｷﾞ", "がぎ"), ("ja", "taberu", "たべる"), ("ja", "kippu", "きっぷ"), ("ja", "１２", "12"), ("ja", "すっっごーーい", "すっごーい"), ("ja", "すっっごーーい", "すごい"), ("ja", "すっごーい", "すごい"), ("ja", "が", "が"), ("ja", "㌀", unicodedata.normalize("NFKD", "㌀")), ("ja", "⺅", "⺅"), ("zh", "⼈", "人"),
    ],
)
def test_variants(language, text, expected):
    found = variants(text, language)
    assert next(iter(found)) == text
    assert expected in found


@pytest.mark.parametrize(
    ("text", "expected"),
    [("أخبار", {"اخبار"}), ("اب", {"أب", "إب"}), ("ابا", {"أبأ", "إبإ"}), ("على", {"علي"}), ("هه", {"ةة"}), ("مؤمن", {"مومن"}), ("كتـاب", {"كتاب"}), ("مدرسة", {"مدرسه"})],
)
def test_arabic_letters_everywhere(text, expected):
    assert expected <= set(variants(text, "ar"))


def test_what_comes_after_rules():
    assert list(variants("\u05d8\u05db", "yi", after=True)) == ["\u05d8\u05da"]
    assert set(variants("\u05f0\u05d0", "yi", after=True)) == {"\u05f0\u05d0", "\u05d5\u05d5\u05d0"}
    assert list(variants("x", "en", after=True)) == ["x"]


def test_chains_meet():
    found = variants("AB", "en")
    assert found["ab"] == [("decapitalize",)]
    assert found["Ab"] == [("decapitalize", "capitalizeFirstLetter")]
    assert found["AB"] == [()]
    assert variants("a1", "xx", (((r"(\d)", r"<\1>"),), (("z", "y"),))) == {"a1": [()], "a<1>": [("Text Replacement 0",)]}


def test_every_language_takes_any_text():
    for language in LANGUAGES:
        for text in ("", "a", "Ünï 日本 ß 'x", "か" * 50):
            assert text in variants(text, language)


def test_pinyin():
    assert pinyin("Nǐ hǎo") == "nǐhǎo"


def test_on_spark(spark):
    texts = spark.createDataFrame([("Maß",), ("Maß",), (None,)], "text string")
    found = text_variants(texts, "de").orderBy("ord").collect()
    assert found[0]["variant"] == "Maß" and {"mass", "maß"} <= {r["variant"] for r in found}
    assert len(found) == len({r["variant"] for r in found})

"""Kana and Latin letters both ways, marks, long vowels, and the parts of inflected forms."""

import pytest

from glossaria.functions import kana
from glossaria.functions.processors import variants
from glossaria.operators import segment
from glossaria.sources.catalog import enabled_map


@pytest.mark.parametrize(
    ("text", "kana_"),
    [("tabemasu", "たべます"), ("kyouto", "きょうと"), ("gakkou", "がっこう"), ("onna", "おんあ"), ("konnnichiha", "こんにちは"), ("hon'ya", "ほんや"), ("kanji", "かんじ"), ("fairu", "ふぁいる"), ("viora", "ゔぃおら"), ("thi-", "てぃー"), ("xtsu", "っ"), ("lka", "ヵ"), ("hwyu", "ふゅ"), ("SHA", "しゃ"), ("dwi", "どぃ"), ("qa", "くぁ"), ("wye", "ゑ"), ("cya", "ちゃ"), ("tt", "っt"), ("b", "b"), ("", "")],
)
def test_latin_to_hiragana(text, kana_):
    assert kana.romaji_to_hiragana(text) == kana_


def test_capital_letters_are_katakana():
    assert kana.romaji_to_kana("kaKA") == "かカ" and kana.romaji_to_kana("GAKKOU") == "ガッコウ" and kana.romaji_to_kana("a B c") == "あ　B　c"


@pytest.mark.parametrize(("text", "cursor", "made"), [("kan", 3, ("かn", 2)), ("kann", 4, ("かん", 2)), ("kanny", 5, ("かんny", 4)), ("ny", 2, ("ny", 2)), ("nka", 1, ("nか", 0)), ("kana", 4, ("かな", 2)), ("", 0, ("", 0))])
def test_typing(text, cursor, made):
    assert kana.typed_kana(text, cursor) == made


def test_kana_to_latin():
    for word, romaji in (("がっこう", "gakkou"), ("シャツ", "shatsu"), ("たべる", "taberu"), ("んいん", "n'in"), ("ラーメン。", "ra-men."), ("ちょっと", "chotto"), ("漢字x", "漢字x"), ("っ", "")):
        assert kana.to_romaji(word) == romaji
    for letters, own in kana.SPELLED.items():
        if len(own) <= 2 and own not in kana.SIGNS.values() and kana.ROMANISED.get(own):
            back = kana.romaji_to_hiragana(kana.to_romaji(own))
            assert back == own or own in "ゃゅょゎぁぃぅぇぉヵヶゐゑ", letters  # small letters and old ones are told like others
    syllables = ["か", "き", "しゃ", "ぎょ", "っと", "にゅ", "ふぁ", "つ", "れ", "ぼ"]
    for a in syllables:
        for b in syllables:
            for c in syllables:
                assert kana.romaji_to_hiragana(kana.to_romaji(a + b + c)) == a + b + c


def test_hiragana_and_katakana():
    assert kana.to_hiragana("ラーメン") == "らあめん" and kana.to_hiragana("コーヒー") == "こうひい" and kana.to_hiragana("コーヒー", keep_long=True) == "こーひー"
    assert kana.to_hiragana("ヵヶー") == "ヵヶえ" and kana.to_hiragana("ー") == "ー" and kana.to_hiragana("ンー") == "んー" and kana.to_hiragana("ノー") == "のー"
    assert kana.to_katakana("ゔぁかー") == "ヴァカー" and kana.alphabetic_to_kana("ｔａｂｅる-x") == "たべるーx"
    every = "".join(map(chr, range(0x3041, 0x3095)))
    assert kana.to_hiragana(kana.to_katakana(every)) == every


def test_marks():
    assert kana.diacritic("が") == ("か", "dakuten") and kana.diacritic("ポ") == ("ホ", "handakuten") and kana.diacritic("ヷ") == ("ワ", "dakuten") and kana.diacritic("ゔ") == ("う", "dakuten")
    assert kana.diacritic("か") is None and kana.diacritic("ゞ") is None and kana.diacritic("é") is None and kana.diacritic("がが") is None
    assert [kana.vowel_of(c) for c in "きャんヴのヲx"] == ["i", "a", "", "u", "", "o", ""]


def test_processors_use_them():
    assert "らあめん" in variants("ラーメン", "ja") and "たべる" in variants("ｔａｂｅｒｕ", "ja")


def test_kana_that_the_reading_spells_otherwise():
    assert segment.furigana("カタカナ語", "かタかなご") == [{"text": "カ", "reading": "か"}, {"text": "タ", "reading": ""}, {"text": "カナ", "reading": "かな"}, {"text": "語", "reading": "ご"}]


def test_parts_of_inflected_segments(spark):
    schema = "dictionary string, id long, expression string, reading string, rules array<string>, score double, sequence long, definitions array<string>, definition_tags array<string>, term_tags array<string>"
    words = [("ボス", "ぼす", []), ("に", "に", []), ("会わせる", "あわせる", ["v1"]), ("くれる", "くれる", ["v1"])]
    terms = spark.createDataFrame([("A", k, w, r, c, 1.0, -1, ["x"], [], []) for k, (w, r, c) in enumerate(words)], schema)
    texts = spark.createDataFrame([(1, "ボスに会わせてくれ、。！？"), (2, "、。！？"), (3, "")], "text_id int, text string")
    found = segment.parse(texts, terms, enabled_map(spark, ["A"]), "ja", parts=True).orderBy("text_id", "line_no", "seg_no").collect()
    assert [r["text"] for r in found if r["text_id"] == 1][:3] == ["ボス", "に", "会わせて"]
    parts = {r["text"]: [(p["text"], p["reading"]) for p in r["parts"]] for r in found}
    assert parts["会わせて"] == [("会", "あ"), ("わせて", "")] and parts["に"] == [("に", "")] and parts["ボス"] == [("ボス", "")]
    assert [(r["text"], r["matched"], r["reading"], r["headwords"]) for r in found if r["text_id"] == 2] == [("、。！？", False, "", None)]

"""The languages that lookups know: names, codes, an example word, what is done to their texts, and which texts are worth a lookup."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from glossaria.functions.columns import partly_japanese
from glossaria.functions.processors import AFTER, LANGUAGES
from glossaria.functions.rule_sets import rule_set


class Language(NamedTuple):
    iso: str
    iso639_3: str
    name: str
    example: str


# Code, code of three letters, name and the word for "to read" or another example.
KNOWN = tuple(Language(*row) for row in (
    ("aii", "aii", "Assyrian Neo-Aramaic", "ܟܵܬܹܒ݂"), ("ar", "ara", "Arabic (MSA)", "قَرَأَ"), ("bg", "bul", "Bulgarian", "чета"), ("cs", "ces", "Czech", "číst"), ("da", "dan", "Danish", "læse"), ("de", "deu", "German", "lesen"),
    ("el", "ell", "Greek", "διαβάζω"), ("en", "eng", "English", "read"), ("eo", "epo", "Esperanto", "legi"), ("es", "spa", "Spanish", "leer"), ("et", "est", "Estonian", "lugema"), ("fa", "fas", "Persian", "خواندن"), ("fi", "fin", "Finnish", "lukea"),
    ("fr", "fra", "French", "lire"), ("ga", "gle", "Irish", "léigh"), ("grc", "grc", "Ancient Greek", "γράφω"), ("he", "heb", "Hebrew", "קריאה"), ("hi", "hin", "Hindi", "पढ़ने के लिए"), ("hu", "hun", "Hungarian", "olvasni"), ("id", "ind", "Indonesian", "baca"),
    ("it", "ita", "Italian", "leggere"), ("la", "lat", "Latin", "legō"), ("lo", "lao", "Lao", "ອ່ານ"), ("lv", "lav", "Latvian", "lasīt"), ("ja", "jpn", "Japanese", "読め"), ("ka", "kat", "Georgian", "კითხვა"), ("kn", "kan", "Kannada", "ಓದು"),
    ("km", "khm", "Khmer", "អាន"), ("ko", "kor", "Korean", "읽어"), ("mn", "mon", "Mongolian", "унших"), ("mt", "mlt", "Maltese", "kiteb"), ("nl", "nld", "Dutch", "lezen"), ("no", "nor", "Norwegian", "lese"), ("pl", "pol", "Polish", "czytać"),
    ("pt", "por", "Portuguese", "ler"), ("ro", "ron", "Romanian", "citi"), ("ru", "rus", "Russian", "читать"), ("sga", "sga", "Old Irish", "légaid"), ("sh", "hbs", "Serbo-Croatian", "čìtati"), ("sq", "sqi", "Albanian", "ndihmoj"), ("sv", "swe", "Swedish", "läsa"),
    ("th", "tha", "Thai", "อ่าน"), ("tl", "tgl", "Tagalog", "basahin"), ("tr", "tur", "Turkish", "okumak"), ("tok", "tok", "Toki Pona", "wile"), ("uk", "ukr", "Ukrainian", "читати"), ("vi", "vie", "Vietnamese", "đọc"), ("cy", "cym", "Welsh", "ddarllen"),
    ("yi", "yid", "Yiddish", "באַשאַפֿן"), ("yue", "yue", "Cantonese", "讀"), ("zh", "zho", "Chinese", "读"),
))
NAMED = {language.iso: language for language in KNOWN}


def languages(spark: SparkSession) -> DataFrame:
    """iso, iso639_3, name, example, processors (before and after rewriting), has_rules."""
    rows = [(*x, [p.name for p in LANGUAGES.get(x.iso, ())], [p.name for p in AFTER.get(x.iso, ())], rule_set(x.iso) is not None) for x in KNOWN]
    return spark.createDataFrame(rows, "iso string, iso639_3 string, name string, example string, processors array<string>, after array<string>, has_rules boolean")


def lookup_worthy(text: Column, language: Column) -> Column:
    """Whether a text can be looked up: in a known language, and for Japanese with a letter of its scripts."""
    return F.coalesce(F.when(language == "ja", partly_japanese(text)).otherwise(language.isin(*NAMED)), F.lit(False))

"""Text processors: named rewrites of a text with options, and the variants of a text under all of them.

A processor keeps a text as it is or rewrites it, by option. Variants start with the text itself; each processor is
applied, with each option, to every variant so far. What doesn't change keeps its chains of processors, what changes adds
the processor to them, and variants that meet join theirs.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from glossaria.functions.kana import alphabetic_to_kana, to_hiragana, to_katakana
from glossaria.functions.korean import letters_of, syllables_of


class Processor(NamedTuple):
    name: str
    rewrites: tuple[Callable[[str], str], ...]  # one an option
    optional: bool = True  # leaving the text alone is an option too


def _strip(form_back: str | None, marks: str) -> Callable[[str], str]:
    def rewrite(text: str) -> str:
        bare = "".join(c for c in unicodedata.normalize("NFD", text) if not re.match(f"[{marks}]", c))
        return unicodedata.normalize(form_back, bare) if form_back else bare

    return rewrite


def _swap(*pairs: tuple[str, str], count: int = -1) -> Callable[[str], str]:
    def rewrite(text: str) -> str:
        for a, b in pairs:
            text = text.replace(a, b, count)
        return text

    return rewrite


def _both(name: str, *pairs: tuple[str, str]) -> Processor:
    return Processor(name, (_swap(*pairs), _swap(*((b, a) for a, b in pairs))))


def _within(ranges: str, form: str) -> Callable[[str], str]:
    return lambda text: re.sub(f"[{ranges}]+", lambda m: unicodedata.normalize(form, m[0]), text)


def _wide(text: str) -> str:
    return re.sub("[0-9A-Za-z]", lambda m: chr(ord(m[0]) + 0xFEE0), text)


def _narrow(text: str) -> str:
    return re.sub("[０-９Ａ-Ｚａ-ｚ]", lambda m: chr(ord(m[0]) - 0xFEE0), text)


# Marks that stretch what is before them.
EMPHATIC = "っッー"


def _collapse(all_of_it: bool) -> Callable[[str], str]:
    def rewrite(text: str) -> str:
        head = re.match(f"[{EMPHATIC}]*", text)[0]
        tail = re.search(f"[{EMPHATIC}]*$", text[len(head) :])[0]
        inner = text[len(head) : len(text) - len(tail)]
        return head + re.sub(f"([{EMPHATIC}])\\1*", "" if all_of_it else r"\1", inner) + tail

    return rewrite


# Latin spellings of Greek letters, digraphs first.
GREEK = [("th", "θ"), ("ph", "φ"), ("ch", "χ"), ("ps", "ψ"), *zip("aebgdzyhiklmnxoprstufw", "αεβγδζυηικλμνξοπρστυφω", strict=True)]


def latin_to_greek(text: str) -> str:
    bare = _strip(None, "̀-ͯ")(text).lower()
    return re.sub(r"σ\b", "ς", _swap(*GREEK)(bare))


# Vietnamese vowel pairs whose tone mark stands on either letter.
TONES = "̣̀́̃̉"


def _tone(first: bool) -> Callable[[str], str]:
    """Tone on the first (old style) or second letter (new style) of oa, oe and uy at a syllable's end."""
    a, b = (rf"([oO])([{TONES}])([aeAE])|([uU])([{TONES}])([yY])", rf"([oO])([aeAE])([{TONES}])|([uU])([yY])([{TONES}])")

    def rewrite(text: str) -> str:
        plain = unicodedata.normalize("NFD", text)

        def move(m: re.Match) -> str:
            x, y, z = (g for g in m.groups() if g)
            return x + z + y

        return unicodedata.normalize("NFC", re.sub(f"(?:{b if first else a})(?![a-zA-Z])", move, plain))

    return rewrite


DECAPITALIZE, CAPITALIZE = Processor("decapitalize", (str.lower,)), Processor("capitalizeFirstLetter", (lambda t: t[:1].upper() + t[1:],))
DIACRITICS = Processor("removeAlphabeticDiacritics", (_strip(None, "̀-ͯ"),))
RADICALS = Processor("normalizeRadicalCharacters", (_within("⺀-⻿⼀-⿟㇀-㇯", "NFKD"),))
CASE = (DECAPITALIZE, CAPITALIZE)
# Arabic marks; letters (alif with wasla, madda or hamza, waw and yaa with hamza, alif maqsura, ta marbuta)
# and the plain ones they become.
ARABIC_MARKS = "\u0610-\u061a\u064b-\u065f\u0670\u06d6-\u06ed"
ARABIC_LETTERS = (("\u0671", "\u0627"), ("\u0622", "\u0627"), ("\u0623", "\u0627"), ("\u0625", "\u0627"), ("\u0624", "\u0648"), ("\u0626", "\u064a"), ("\u0649", "\u064a"), ("\u0629", "\u0647"))
# Yiddish letters and their final forms; ligatures and what they are made of.
YIDDISH_FINALS = {"\u05de": "\u05dd", "\u05e0": "\u05df", "\u05e6": "\u05e5", "\u05e4": "\u05e3", "\u05db": "\u05da"}
YIDDISH_LIGATURES = (("\u05f0", "\u05d5\u05d5"), ("\u05f1", "\u05d5\u05d9"), ("\u05f2", "\u05d9\u05d9"), ("\ufb1d", "\u05d9\u05b4"), ("\ufb1f", "\u05d9\u05d9\u05b7"), ("\ufb2e", "\u05d0\u05b7"), ("\ufb2f", "\u05d0\u05b8"))

#: Processors of each language, in order.
LANGUAGES: dict[str, tuple[Processor, ...]] = {
    "ja": (
        Processor("convertHalfWidthCharacters", (_within("･-ﾟ", "NFKC"),)), Processor("alphabeticToHiragana", (alphabetic_to_kana,)), Processor("alphanumericWidthVariants", (_wide, _narrow)),
        Processor("convertHiraganaToKatakana", (to_katakana, to_hiragana)), Processor("collapseEmphaticSequences", (_collapse(False), _collapse(True))),
        Processor("normalizeCombiningCharacters", (lambda t: re.sub(".[゙゚]", lambda m: unicodedata.normalize("NFC", m[0]), t),)), Processor("normalizeCJKCompatibilityCharacters", (_within("㌀-㏿", "NFKD"),)), RADICALS,
    ),
    "zh": (*CASE, RADICALS), "yue": (*CASE, RADICALS), "en": CASE, "es": CASE, "it": (*CASE, DIACRITICS), "pt": CASE, "eo": CASE, "ga": CASE, "sq": CASE, "nl": CASE, "pl": CASE, "tr": CASE, "fi": CASE, "hu": CASE,
    **dict.fromkeys(("bg", "cs", "da", "et", "lv", "mn", "mt", "no", "sv", "tok", "uk", "cy"), CASE), **dict.fromkeys(("id", "ro", "sga", "tl"), (*CASE, DIACRITICS)),
    "de": (*CASE, _both("eszettPreprocessor", ("ß", "ss"))), "fr": (*CASE, _both("apostropheVariants", ("'", "’"))), "la": (*CASE, DIACRITICS, _both("processDiphtongs", ("ae", "æ"), ("Ae", "Æ"), ("oe", "œ"), ("Oe", "Œ"))),
    "ru": (*CASE, Processor("removeRussianDiacritics", (_strip("NFC", "́"),)), Processor("yoToE", (_swap(("ё", "е"), ("Ё", "Е")),))), "sh": (*CASE, Processor("removeSerboCroatianAccentMarks", (_strip("NFC", "\u0300\u0301\u0302\u030f\u0311"),))),
    "el": (*CASE, Processor("removeDoubleAcuteAccents", (_strip("NFC", "̋"),))), "grc": (*CASE, DIACRITICS, Processor("convertLatinToGreek", (latin_to_greek,))), "vi": (*CASE, Processor("normalizeDiacritics", (_tone(True), _tone(False)))),
    "ar": (
        Processor("removeArabicScriptDiacritics", (lambda t: re.sub(f"[{ARABIC_MARKS}]", "", t),)), Processor("removeTatweel", (_swap(("\u0640", "")),)), Processor("normalizeUnicode", (_swap(*ARABIC_LETTERS),)),
        Processor("addHamzaTop", (_swap(("\u0627", "\u0623")),)), Processor("addHamzaBottom", (_swap(("\u0627", "\u0625")),)), Processor("convertAlifMaqsuraToYaa", (_swap(("\u0649", "\u064a")),)), Processor("convertHaToTaMarbuta", (_swap(("\u0647", "\u0629")),)),
    ),
    "ko": (Processor("disassembleHangul", (letters_of,), False),),
    "aii": (Processor("removeSyriacScriptDiacritics", (lambda t: re.sub("[ܰ-̣݊̇̈-̥̭̰̱]", "", t),)),),
    "yi": (Processor("combineYiddishLigatures", (_swap(*((b, a) for a, b in YIDDISH_LIGATURES), count=1),), False), Processor("removeYiddishDiacritics", (lambda t: re.sub("[\u05b0-\u05c7]", "", t),), False)),
}


def pinyin(text: str) -> str:
    """A reading without case and separators, composed."""
    return re.sub("[\\s・:'’-]|\\(.*?\\)", "", unicodedata.normalize("NFC", text).lower())


#: Processors of rewritten texts: what languages undo after their rules.
AFTER: dict[str, tuple[Processor, ...]] = {
    "ko": (Processor("reassembleHangul", (syllables_of,), False),),
    "yi": (
        Processor("convertFinalLetters", (lambda t: t[:-1] + YIDDISH_FINALS.get(t[-1:], t[-1:]),), False),
        Processor("convertYiddishLigatures", (_swap(*YIDDISH_LIGATURES, count=1), _swap(*((b, a) for a, b in YIDDISH_LIGATURES), count=1))),
    ),
}


def normalised_reading(reading: Column, language: str) -> Column:
    """Readings that are spelled in several ways, in one: Chinese only."""
    return F.udf(pinyin, "string", useArrow=True)(reading) if language in ("zh", "yue") else reading


def variants(text: str, language: str, replacements: tuple[tuple[tuple[str, str], ...], ...] = (), after: bool = False) -> dict[str, list[tuple[str, ...]]]:
    """Variants of a text, in order, each with its chains of processors. A replacement set is a list of (pattern, text)."""
    found: dict[str, list[tuple[str, ...]]] = {text: [()]}
    for k, rules in enumerate(replacements):
        made = text
        for pattern, new in rules:
            made = re.sub(pattern, new, made)
        found.setdefault(made, []).append((f"Text Replacement {k}",)) if made != text else None
    for processor in (AFTER if after else LANGUAGES).get(language, ()):
        new: dict[str, list[tuple[str, ...]]] = {}
        for variant, chains in found.items():
            if processor.optional:
                new.setdefault(variant, []).extend(chains)
            for rewrite in processor.rewrites:
                made = rewrite(variant)
                if made == variant and not processor.optional:
                    new.setdefault(made, []).extend(chains)
                if made != variant:
                    new.setdefault(made, []).extend((*c, processor.name) for c in chains)
        found = new
    return found


def text_variants(texts: DataFrame, language: str, column: str = "text", replacements: tuple = (), after: bool = False) -> DataFrame:
    """text, ord, variant, chains of each distinct text; `after` takes the processors of rewritten texts."""
    if not replacements and language not in (AFTER if after else LANGUAGES):
        same = texts.select(F.col(column).alias("text")).where(F.col(column).isNotNull()).distinct()
        return same.select("text", F.lit(0).alias("ord"), F.col("text").alias("variant"), F.array(F.array().cast("array<string>")).alias("chains"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.string(), pa.int32(), pa.string(), pa.list_(pa.list_(pa.string())))
        for batch in batches:
            rows = [(t, k, v, [list(c) for c in chains]) for t in batch.column("text").to_pylist() for k, (v, chains) in enumerate(variants(t, language, replacements, after).items())]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=["text", "ord", "variant", "chains"])

    distinct = texts.select(F.col(column).alias("text")).where(F.col("text").isNotNull()).distinct()
    return distinct.mapInArrow(run, "text string, ord int, variant string, chains array<array<string>>")

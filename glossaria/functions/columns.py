"""Scalar functions as Column expressions, all on the JVM side."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

# An unranked entry's place when ascending, and when descending.
LAST_ASCENDING, LAST_DESCENDING = 2**53 - 1, 0
NUMBER = r"[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?"


def split_field(text: Column) -> Column:
    """Space-separated values; an empty or null field has none, double spaces give empty values."""
    return F.when(F.length(text) > 0, F.split(text, " ")).otherwise(F.array().cast("array<string>"))


def tag_base(name: Column) -> Column:
    return F.substring_index(name, ":", 1)


def to_number(text: Column) -> Column:
    """The first number in a text, else 0."""
    found = F.regexp_extract(text, NUMBER, 0)
    value = F.when(found != "", found.cast("double"))
    return F.when(F.abs(value) < float("inf"), value).otherwise(0.0)


def half_up(x: Column) -> Column:
    """Rounded to a whole number, halves up; sums that differ in the last bits by their order give the same."""
    return F.floor(F.round(x, 9) + 0.5)


def whole_part(x: Column) -> Column:
    return F.floor(F.round(x, 9))


def part_of_speech_passes(known: Column, entry: Column) -> Column:
    return (known == 0) | (known.bitwiseAND(entry) != 0)


def lookup_prefixes(text: Column, by: str = "letter") -> Column:
    """Array of (original text, order): the text and ever shorter prefixes; by word they end at word ends."""
    n = F.length(text)
    letters = F.transform(F.when(n > 0, F.sequence(n, F.lit(1), F.lit(-1))).otherwise(F.array().cast("array<int>")), lambda k: F.substring(text, F.lit(1), k))
    if by == "word":
        # A shorter source ends where a letter run, with its digits, begins: before the last non-letter.
        letters = F.filter(letters, lambda p: (F.length(p) == n) | F.substring(text, F.length(p) + 1, F.lit(1 << 30)).rlike(r"^[^\p{L}][\p{L}\p{N}]*(?:[^\p{L}][\p{L}\p{N}]*)*$"))
    return letters


def reversed_text(text: Column) -> Column:
    return F.reverse(text)


def decapitalized(text: Column) -> Column:
    return F.lower(text)


def capitalized(text: Column) -> Column:
    return F.concat(F.upper(F.substring(text, 1, 1)), F.substring(text, F.lit(2), F.lit(1 << 30)))


def both_ways(text: Column, a: str, b: str) -> Column:
    """A text as it is, with a for b, and with b for a."""
    return F.array_distinct(F.array(text, F.replace(text, F.lit(a), F.lit(b)), F.replace(text, F.lit(b), F.lit(a))))


def eszett_variants(text: Column) -> Column:
    return both_ways(text, "ß", "ss")


def apostrophe_variants(text: Column) -> Column:
    return both_ways(text, "'", "’")


def diphthong_variants(text: Column) -> Column:
    pairs = [("ae", "æ"), ("Ae", "Æ"), ("oe", "œ"), ("Oe", "Œ")]
    forth = reduce(lambda t, p: F.replace(t, F.lit(p[0]), F.lit(p[1])), pairs, text)
    back = reduce(lambda t, p: F.replace(t, F.lit(p[1]), F.lit(p[0])), pairs, text)
    return F.array_distinct(F.array(text, forth, back))


def case_variants(text: Column) -> Column:
    return F.array_distinct(F.array(text, decapitalized(text), capitalized(text)))


def yo_to_e(text: Column) -> Column:
    return F.translate(text, "ёЁ", "еЕ")


def kebab_case(text: Column) -> Column:
    out = F.regexp_replace(text, r"[\s_　]", "-")
    out = F.regexp_replace(out, r"[^\p{L}\p{N}-]", "")
    out = F.regexp_replace(out, r"--+", "-")
    return F.lower(F.regexp_replace(out, r"^-|-$", ""))


def field_markers(template: Column) -> Column:
    """Names in braces."""
    return F.regexp_extract_all(template, F.lit(r"\{([\p{L}\p{N}_-]+)\}"), F.lit(1))


def later_revision(current: Column, latest: Column) -> Column:
    """Whether `latest` is newer: by numbers if both are dotted numbers with as many parts, else as texts."""
    dotted = r"^(\d+\.)*\d+$"
    a, b = (F.transform(F.split(x, r"\."), lambda p: p.cast("bigint")) for x in (current, latest))
    numbers = current.rlike(dotted) & latest.rlike(dotted) & (F.size(a) == F.size(b))
    return F.when(numbers, a < b).otherwise(current < latest)


def cloze(sentence: Column, source: Column, at: Column) -> Column:
    """prefix, body and suffix of a sentence around a source text that starts at a place, from 0."""
    end = at + F.length(source)
    return F.struct(F.substring(sentence, F.lit(1), at).alias("prefix"), F.substring(sentence, at + 1, F.length(source)).alias("body"), F.substring(sentence, end + 1, F.lit(1 << 30)).alias("suffix"))


def custom_audio_url(template: str, term: Column, reading: Column, language: str) -> Column:
    """A URL template with {term}, {reading} and {language} filled in, percent-encoded."""
    quote = lambda c: F.replace(F.url_encode(c), F.lit("+"), F.lit("%20"))
    out = F.replace(F.lit(template), F.lit("{term}"), quote(term))
    out = F.replace(out, F.lit("{reading}"), quote(reading))
    return F.replace(out, F.lit("{language}"), F.lit(language))


# Small kana, which belong to the mora before.
SMALL_KANA = "ぁぃぅぇぉゃゅょゎァィゥェォャュョヮ"


def kana_morae(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"(.[{SMALL_KANA}]*)"), F.lit(1))


def downsteps(pattern: Column) -> Column:
    """Places, from 1, at which an H is followed by an L in a pitch pattern such as LHHL."""
    at = F.sequence(F.lit(1), F.greatest(F.length(pattern) - 1, F.lit(1)))
    return F.filter(at, lambda k: F.substring(pattern, k, F.lit(2)) == "HL")


def pitch_category(position: Column, morae: Column, verb_or_adjective: Column) -> Column:
    return (
        F.when(position == 0, "heiban").when(verb_or_adjective & (position > 0), "kifuku").when(position == 1, "atamadaka")
        .when(position > 1, F.when(position >= morae, "odaka").otherwise("nakadaka"))
    )


def mora_is_high(mora: Column, position: Column) -> Column:
    """Pitch of a mora, counted from 0, for a downstep position."""
    return F.when(position == 0, mora > 0).when(position == 1, mora < 1).otherwise((mora > 0) & (mora < position))


#: Code points of scripts.
KANJI = r"\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}\x{20000}-\x{2A6DF}\x{2A700}-\x{2EBEF}\x{F900}-\x{FAFF}\x{2F800}-\x{2FA1F}"
KANA = r"\x{3040}-\x{309F}\x{30A0}-\x{30FF}"
JAPANESE = KANA + KANJI + r"\x{FF66}-\x{FF9F}\x{30FB}-\x{30FC}\x{FF61}-\x{FF65}\x{3000}-\x{303F}\x{FF10}-\x{FF19}\x{FF21}-\x{FF3A}\x{FF41}-\x{FF5A}\x{FF01}-\x{FF0F}\x{FF1A}-\x{FF1F}\x{FF3B}-\x{FF3F}\x{FF5B}-\x{FF60}\x{FFE0}-\x{FFEE}"


def script_head(text: Column) -> Column:
    """The longest prefix of Japanese, Chinese or Korean letters."""
    return F.regexp_extract(text, rf"^[{JAPANESE}\x{{1100}}-\x{{11FF}}\x{{AC00}}-\x{{D7AF}}]*", 0)


def entirely_kana(text: Column) -> Column:
    return text.rlike(rf"^[{KANA}]+$")


def partly_japanese(text: Column) -> Column:
    return text.rlike(f"[{JAPANESE}]")


#: Ranges of Chinese and Korean letters beside the characters they share with Japanese.
CHINESE = KANJI + r"\x{3000}-\x{303F}\x{FF01}-\x{FF60}\x{FFE0}-\x{FFEE}\x{3100}-\x{312F}\x{31A0}-\x{31BF}\x{16FE0}-\x{16FFF}\x{FE50}-\x{FE6F}\x{FE10}-\x{FE1F}"
KOREAN = r"\x{AC00}-\x{D7AF}\x{1100}-\x{11FF}\x{3130}-\x{318F}\x{A960}-\x{A97F}\x{D7B0}-\x{D7FF}"


def partly_chinese(text: Column) -> Column:
    return text.rlike(f"[{CHINESE}]")


def partly_korean(text: Column) -> Column:
    return text.rlike(f"[{KOREAN}]")


def verb_or_adjective(classes: Column) -> Column:
    """Whether word classes are a verb's or an adjective's; a noun that suru makes a verb of isn't one."""
    has = lambda *names: F.arrays_overlap(classes, F.array(*map(F.lit, names)))
    return F.coalesce(has("v1", "v5", "vk", "vz", "adj-i", "vs") & ~(has("vs") & has("n")), F.lit(False))

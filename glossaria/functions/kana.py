"""Kana: hiragana and katakana, marks and long vowels, and Latin letters both ways.

Latin letters become kana by a transducer: the longest spelling that stands at a place is taken, a doubled consonant is
a small tsu, and what spells nothing stays. The tables follow from the rows of the syllabary.
"""

from __future__ import annotations

import re
import unicodedata
from typing import NamedTuple

VOWELS = "aiueo"
# Rows of the syllabary by consonant; small letters; the signs that Latin ones become.
ROWS = {"": "あいうえお", "k": "かきくけこ", "g": "がぎぐげご", "s": "さしすせそ", "z": "ざじずぜぞ", "t": "たちつてと", "d": "だぢづでど", "n": "なにぬねの", "h": "はひふへほ", "b": "ばびぶべぼ", "p": "ぱぴぷぺぽ", "m": "まみむめも", "r": "らりるれろ"}
SMALL_VOWELS, SMALL_Y = "ぁぃぅぇぉ", "ゃぃゅぇょ"
SIGNS = {".": "。", ",": "、", ":": "：", "/": "・", "!": "！", "?": "？", "~": "〜", "-": "ー", "‘": "「", "’": "」", "“": "『", "”": "』", "[": "［", "]": "］", "(": "（", ")": "）", "{": "｛", "}": "｝", " ": "　"}
DOUBLED = "qvlxkgszjtdhfbpmyrwc"


def _spellings() -> dict[str, str]:
    """What Latin letters spell, lower case."""
    made = {c + v: kana for c, row in ROWS.items() for v, kana in zip(VOWELS, row, strict=True)}

    def series(letters: str, base: str, small: str, vowels: str = VOWELS) -> None:
        made.update({letters + v: base + s for v, s in zip(VOWELS, small, strict=True) if v in vowels})

    for c in "kgsztdnhbpmr":
        series(c + "y", ROWS[c][1], SMALL_Y)
    for letters, base in (("vy", "ゔ"), ("cy", "ち"), ("jy", "じ"), ("sh", "し"), ("ch", "ち"), ("j", "じ"), ("th", "て"), ("dh", "で")):
        series(letters, base, SMALL_Y)
    series("fy", "ふ", SMALL_Y, "auo")
    for letters, base, vowels in (("kw", "く", VOWELS), ("gw", "ぐ", VOWELS), ("sw", "す", VOWELS), ("zw", "ず", VOWELS), ("tw", "と", VOWELS), ("dw", "ど", VOWELS), ("ts", "つ", "aieo"), ("hw", "ふ", "aieo"), ("f", "ふ", "aieo"), ("v", "ゔ", "aieo"), ("q", "く", "aieo"), ("wh", "う", "aieo")):
        series(letters, base, SMALL_VOWELS, vowels)
    for small in "xl":
        series(small, "", SMALL_VOWELS)
        made |= {f"{small}y{v}": s for v, s in zip(VOWELS, SMALL_Y, strict=True)} | {f"{small}ka": "ヵ", f"{small}ke": "ヶ", f"{small}wa": "ゎ", f"{small}tu": "っ", f"{small}tsu": "っ"}
    # Spellings that follow no row.
    odd = {"shi": "し", "chi": "ち", "ji": "じ", "tsu": "つ", "fu": "ふ", "vu": "ゔ", "qu": "く", "whu": "う", "wu": "う", "ya": "や", "yu": "ゆ", "yo": "よ", "ye": "いぇ", "wa": "わ", "wo": "を", "wi": "うぃ", "we": "うぇ", "wyi": "ゐ", "wye": "ゑ", "hwyu": "ふゅ", "ca": "か", "ci": "し", "cu": "く", "ce": "せ", "co": "こ", "n": "ん", "nn": "ん", "n'": "ん", "xn": "ん"}
    return made | odd | SIGNS


SPELLED = _spellings()
LONGEST = max(map(len, SPELLED))


def _romanised() -> dict[str, str]:
    """How kana are spelled: of several spellings the usual one."""
    made: dict[str, str] = {}
    for letters, kana in SPELLED.items():
        if not letters.startswith(("x", "l", "q")) and kana not in made:
            made[kana] = letters
    # Usual spellings that aren't the first ones of the tables, and small letters by themselves.
    usual = {"し": "shi", "ち": "chi", "つ": "tsu", "ふ": "fu", "じ": "ji", "しゃ": "sha", "しゅ": "shu", "しぇ": "she", "しょ": "sho", "ちゃ": "cya", "ちぃ": "cyi", "ちゅ": "chu", "ちぇ": "che", "ちょ": "cho", "じゃ": "ja", "じぃ": "jyi", "じゅ": "ju", "じぇ": "je", "じょ": "jo", "うぁ": "wha", "うぃ": "wi", "うぇ": "we", "うぉ": "who", "ゐ": "wi", "ゑ": "we", "ん": "n", "んい": "n'i", "ヵ": "ka", "ヶ": "ke", "ゎ": "wa", "っ": ""}
    return made | usual | dict(zip(SMALL_VOWELS, VOWELS, strict=True)) | {"ゃ": "ya", "ゅ": "yu", "ょ": "yo"}


ROMANISED = _romanised()

#: Katakana letters that have a hiragana one; the small ka and ke stay as they are.
TO_HIRAGANA = {k: k - 0x60 for k in range(0x30A1, 0x30F7) if k not in (0x30F5, 0x30F6)}
TO_KATAKANA = {k: k + 0x60 for k in range(0x3041, 0x3097)}
LONG = "ー"
#: No vowel is known of these.
VOWELLESS = "のノゔゕゖ"


def vowel_of(kana: str) -> str:
    """The vowel that a letter ends in, by its name; none for n and for what is no letter."""
    name = unicodedata.name(kana, "") if len(kana) == 1 and kana not in VOWELLESS else ""
    return name[-1].lower() if re.match("(HIRAGANA|KATAKANA) LETTER", name) and name[-1] in "AIUEO" else ""


def to_hiragana(text: str, keep_long: bool = False) -> str:
    """Katakana as hiragana; a long mark becomes the vowel that it lengthens, an o by u, unless it is kept."""
    out: list[str] = []
    for c in text:
        if c == LONG and not keep_long and out:
            c = dict(zip(VOWELS, "あいうえう", strict=True)).get(vowel_of(out[-1]), c)
        out.append(c.translate(TO_HIRAGANA))
    return "".join(out)


def to_katakana(text: str) -> str:
    return text.translate(TO_KATAKANA)


class Marked(NamedTuple):
    character: str
    type: str


def diacritic(kana: str) -> Marked | None:
    """The letter without its voicing mark, and which mark that is."""
    parts = unicodedata.normalize("NFD", kana)
    known = {"゙": "dakuten", "゚": "handakuten"}
    fits = len(kana) == 1 and len(parts) == 2 and parts[1] in known and " LETTER " in unicodedata.name(kana, "")
    return Marked(parts[0], known[parts[1]]) if fits else None


def _transduced(text: str, spelled: dict[str, str], small_tsu: str, doubled: str = DOUBLED) -> str:
    out, k = [], 0
    while k < len(text):
        if text[k] in doubled and text[k + 1 : k + 2] == text[k]:
            out.append(small_tsu)
            k += 1
            continue
        letters = next((text[k : k + n] for n in range(min(LONGEST, len(text) - k), 0, -1) if text[k : k + n] in spelled), text[k])
        out.append(spelled.get(letters, letters))
        k += len(letters)
    return "".join(out)


def romaji_to_hiragana(text: str) -> str:
    return _transduced(text.lower(), SPELLED, "っ")


def romaji_to_kana(text: str) -> str:
    """Small letters as hiragana, capital ones as katakana."""
    capital = {letters.upper(): to_katakana(made) for letters, made in SPELLED.items()}
    parts = re.split("([A-Z']*[A-Z][A-Z']*)", text)
    return "".join(_transduced(p, capital, "ッ", DOUBLED.upper()) if k % 2 else _transduced(p, SPELLED, "っ") for k, p in enumerate(parts))


def typed_kana(text: str, cursor: int) -> tuple[str, int]:
    """What is typed so far as kana, and where the cursor is then. An n, or ny, before the cursor may still become something
    else, so it waits; a second n doesn't."""
    before = text[:cursor].lower()
    waits = 2 if before.endswith("ny") else 1 if before.endswith("n") and not before[:-1].replace("nn", "").endswith("n") else 0
    kept = text[cursor - waits : cursor]
    made = romaji_to_kana(text[: cursor - waits]) + kept + romaji_to_kana(text[cursor:]) if waits else romaji_to_kana(text)
    return made, cursor + len(made) - len(text)


def to_romaji(text: str) -> str:
    """Kana in Latin letters; other characters stay. A small tsu doubles the consonant after it."""
    plain, out, k = to_hiragana(text, keep_long=True), [], 0
    signs = {v: s for s, v in SIGNS.items()}
    while k < len(plain):
        n = 2 if plain[k : k + 2] in ROMANISED else 1
        spelled = ROMANISED.get(plain[k : k + n], signs.get(plain[k], plain[k]))
        if plain[k] == "っ":
            after = ROMANISED.get(plain[k + 1 : k + 3], ROMANISED.get(plain[k + 1 : k + 2], ""))
            spelled = after[:1] if after[:1] not in VOWELS and after[:1] in DOUBLED else ""
        out.append(spelled)
        k += n
    return "".join(out)


# Wide letters and the wide dash, as narrow ones.
NARROW = {c + 0xFEE0: c for c in [*range(0x41, 0x5B), *range(0x61, 0x7B), 0x2D]}


def alphabetic_to_kana(text: str) -> str:
    """Runs of Latin letters and dashes, wide ones too, as hiragana; all else stays."""
    wide = "".join(map(chr, NARROW))
    return re.sub(f"[A-Za-z{wide}-]+", lambda m: romaji_to_hiragana(m[0].translate(NARROW)), text)

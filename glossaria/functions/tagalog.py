"""Tagalog: prefixes, suffixes, both at once, and doubled first syllables, composed of a few sound changes.

A prefix in a vowel turns the d after it into r; one in -ng takes on the place of the consonant after it; a suffix turns a
last d into r, is parted from a vowel by h or n, and raises the last o before it to u.
"""

from __future__ import annotations

from glossaria.functions.rules import Condition, Rule, RuleSet, around, pattern, whole

CONSONANTS, VOWELS = "bcdfghjklmnpqrstvwxyzBCDFGHJKLMNPQRSTVWXYZ", "aeiou"
#: Consonants that -ng becomes n and m before.
DENTAL, LABIAL = "dlrst", "bp"
Side = list[tuple[str, str]]  # affix, what stood there


def before(prefix: str, softens: bool = False) -> Side:
    return [(prefix, ""), *([(prefix + "r", "d")] if softens else [])]


def nasal(prefix: str) -> Side:
    """A prefix in -ng, which is given without it."""
    return [(prefix + "ng", ""), *((prefix + n + c, c) for n, cs in (("n", DENTAL), ("m", LABIAL)) for c in cs)]


def after(suffix: str) -> Side:
    return [*((v + link + suffix, v) for link in "hn" for v in VOWELS), *(("u" + link + suffix, "o") for link in "hn"), (suffix, ""), ("r" + suffix, "d")]


def attached(outer: str, starts: Side, ends: Side = [("", "")]) -> list[Rule]:  # noqa: B006
    """Each start with each end; a suffix right after consonants also with the last o raised to u."""
    made = [around(p, s, b, e, outer=outer, stem=r"\w+" if p and s else "") for p, b in starts for s, e in ends]
    for p, b in starts:
        for s, e in ends:
            if s and s[-2:] == s.lstrip("r"):
                head = r"\w+" if p else ".*"
                made.append(around(p, s, b, e, outer=outer, stem=rf"({head})u([{CONSONANTS}]+)", stem_base=r"\1o\2"))
    return made


def doubled(outer: str, *starts: tuple[str, str]) -> list[Rule]:
    """A prefix and the first syllable twice, which begins with some of these consonants."""
    return [around(p, "", "", "", outer=outer, stem=rf"([{cs}]*[{VOWELS}])\1(.*)", stem_base=r"\1\2") for p, cs in starts]


def doubled_nasal(outer: str, prefix: str) -> list[Rule]:
    return doubled(outer, (prefix + "ng", CONSONANTS), (prefix + "n", DENTAL), (prefix + "m", LABIAL))


# Prefixes by what they are put to and whether they soften a d.
NOUNS, BOTH = "n", "n adj"
PREFIXES = {
    (BOTH, True): "ma ka magka magkaka pa maka naka nakaka pala".split(), (NOUNS, True): "magkanda magma magpa magpaka maki mapa".split(),
    (NOUNS, False): "mag pag pakikipag tag taga tagapag i ipa ipag makapag makipag".split(), (BOTH, False): ["mapag"],
}


def tagalog() -> RuleSet:
    transforms = {f"{p}-": attached(outer, before(p, softens)) for (outer, softens), ps in PREFIXES.items() for p in ps}
    transforms |= {f"{p}ng-": attached(outer, nasal(p)) for outer, ps in ((BOTH, ("pa", "nakakapa")), (NOUNS, ("ma", "tagapa", "ipa", "makapa"))) for p in ps}
    transforms |= {f"-{s}": attached(NOUNS, [("", "")], after(s)) for s in ("an", "in")}
    transforms |= {f"{p}-...-{s}": attached(outer, before(p, softens), after(s)) for p, s, outer, softens in (
        ("ka", "an", NOUNS, True), ("pa", "an", NOUNS, True), ("ma", "an", NOUNS, True), ("mag", "an", NOUNS, False), ("makipag", "an", NOUNS, False), ("pag", "an", NOUNS, False),
        ("pa", "in", NOUNS, True), ("pag", "in", NOUNS, False), ("ma", "in", BOTH, True))}
    transforms |= {f"{p}ng-...-{s}": attached(NOUNS, nasal(p), after(s)) for p, s in (("pa", "an"), ("papa", "in"))}
    transforms |= {f"{p}- + rep1": doubled(outer, (p, CONSONANTS)) for p, outer in (("mag", NOUNS), ("pag", NOUNS), ("ipag", NOUNS), ("naka", BOTH))}
    transforms |= {f"{p}ng- + rep1": doubled_nasal(outer, p) for p, outer in (("ma", NOUNS), ("pa", NOUNS), ("nakapa", BOTH))}
    transforms |= {
        "hyphenated": [pattern("-", "")], "-ng": attached("", [("", "")], [("ng", "")]),
        "kaka-": [*attached(NOUNS, before("kaka", True)), *doubled(NOUNS, ("ka", CONSONANTS))], "pakiki-": [*attached(NOUNS, before("pakiki", True)), *doubled(NOUNS, ("pakiki", CONSONANTS))],
        "pagka-": [*attached(NOUNS, before("pagka", True)), *attached(NOUNS, before("pagkaka", True))], "magsi-": [*attached(NOUNS, before("magsi")), *attached(NOUNS, before("magsipag"))],
        "ika-": attached(NOUNS, before("ika", True)),
    }
    # Ordinals.
    ordinals = {"pang-": {"pangalawa": "dalawa", "pangatlo": "tatlo"}, "ika-": {"ikalawa": "dalawa", "ikatlo": "tatlo"}}
    for name, words in ordinals.items():
        transforms[name] = [*transforms[name], *(whole(w, b, "", "num") for w, b in words.items())]
    return RuleSet("tl", [Condition("n", ("num",)), Condition("adj"), Condition("num")], transforms)

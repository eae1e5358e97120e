"""Arabic: particles, the article, persons and attached pronouns, as prefixes and suffixes that condition each other.

Imperfect verbs carry a person's prefix, particles before it, a person's suffix and a pronoun after it; all rules of one
person are the product of these, and meet a word through its (prefix, suffix) pair.
"""

from __future__ import annotations

from glossaria.functions.rules import Condition, Rule, RuleSet, around, prefix, suffix

# Pronouns of objects by person, and of owners; letters that words are made of.
FIRST, SECOND, THIRD = ("ني", "نا"), ("ك", "كما", "كم", "كن"), ("ه", "ها", "هما", "هم", "هن")
OBJECTS = (*FIRST, *SECOND, *THIRD)
#: Owners but for ي, which an ending in ي swallows.
OTHER_OWNERS = ("نا", *SECOND, *THIRD)
OWNERS = ("ي", *OTHER_OWNERS)
LETTER = "[ؠ-ٟٮ-ۓەۮۯۺ-ۼۿ]"
AND = ("", "و", "ف")


def nouns(affixes: dict[str, str], outer: str, *owners: tuple[str, ...]) -> list[Rule]:
    """Suffixes of nouns (what they are put to: the endings they replace, parted by spaces; - is none), bare or with owners."""
    return [suffix(a + p, "" if b == "-" else b, "n_s", outer) for a, bs in affixes.items() for b in bs.split() for ps in (owners or (("",),)) for p in ps]


def perfect(affix: str, base: str = "", pronouns: tuple[str, ...] = ("",), unless: str = "") -> list[Rule]:
    """Suffixes of perfect verbs; `unless` is a letter that the stem doesn't end in."""
    made = [affix + p for p in pronouns]
    return [around("", a, "", base, "pv_s", "pv", stem=f"(?:.*[^{unless}])?") if unless else suffix(a, base, "pv_s", "pv") for a in made]


def imperfect(person: str, ending: str = "", replaced: str = "", base: str = "", pronouns: tuple = (FIRST, SECOND, THIRD), attached: str | None = None, li: bool = True, unless: str = "") -> list[Rule]:
    """All forms of one person: particles and the person's letter before the stem, an ending and a pronoun after it. Verbs
    whose stem begins with alif lose it after the person's letter, so it is tried too, unless `base` takes its place."""
    particles = [*AND, *(a + "س" for a in AND), *((a + "ل" for a in AND) if li else ())]
    ends = [ending, *((ending if attached is None else attached) + p for ps in pronouns for p in ps)]
    stem = f"{LETTER}+" + (f"(?<!{unless})" if unless else "")
    starts = [base] if base else ["", "أ", "ا"]
    return [around(particle + person, end, start, replaced, "iv_p", "iv", stem=stem if end else "") for start in starts for particle in particles for end in ends]


def arabic() -> RuleSet:
    article = ("n_al", "n_bi_al", "n_ka_al", "n_lil", "n_li_al")
    bare = ("n_wa", "n_bi", "n_ka", "n_li")
    internal = {"n_p": (*bare, *article), "n_def": article, "n_indef": bare, "n_nom": ("n_wa", "n_li", "n_al"), "n_nom_indef": ("n_wa", "n_li")}
    conditions = [
        Condition("n"), *(Condition(c, members, False) for c, members in internal.items()), *(Condition(c, (), False) for c in (*bare, *article, "n_s")),
        Condition("v", ("pv", "iv", "cv")), *(Condition(f"{v}{s}", (), not s) for v in ("pv", "iv", "cv") for s in ("", "_p", "_s")),
    ]
    # What stands before a noun, by condition.
    before = {"Bi": ("ب", "n_bi"), "Ka": ("ك", "n_ka"), "Li": ("ل", "n_li"), "Al": ("ال", "n_al"), "BiAl": ("بال", "n_bi_al"), "KaAl": ("كال", "n_ka_al")}
    indefinite, any_, subject, own_subject = "n_indef n", "n_p n", "n_nom n", "n_nom_indef n"
    transforms: dict[str, list[Rule]] = {"NPref-Wa": [prefix(a, "", "n_wa", "n") for a in AND if a]}
    transforms |= {f"NPref-{name}": [prefix(a + p, "", c, "n") for a in AND] for name, (p, c) in before.items()}
    transforms["NPref-Lil"] = [around(a + "لل", "", "", "", "n_lil", "n", stem="(?!ل).*") for a in AND]
    transforms["NPref-LiAl"] = [prefix(a + "لل", "ل", "n_li_al", "n") for a in AND]
    transforms |= {
        "NSuff-h": [*nouns({"": "-"}, indefinite, OTHER_OWNERS), around("", "ي", "", "", "n_s", indefinite, stem="(?:.*[^ي])?")],
        "NSuff-ap": nouns({"ة": "-"}, any_), "NSuff-ath": nouns({"ت": "- ة"}, indefinite, OWNERS), "NSuff-AF": nouns({"ا": "-", "اً": "-", "ًا": "-"}, "n_wa n"),
        "NSuff-An": nouns({"ان": "-", "آن": "أ"}, subject), "NSuff-Ah": nouns({"ا": "-", "آ": "أ"}, own_subject, ("",), OWNERS),
        "NSuff-ayn": nouns({"ين": "-"}, any_), "NSuff-ayh": nouns({"ي": "-"}, indefinite, ("",), OTHER_OWNERS),
        "NSuff-atAn": nouns({"تان": "- ة"}, subject), "NSuff-atAh": nouns({"تا": "- ة"}, own_subject, ("",), OWNERS), "NSuff-tayn": nouns({"تين": "- ة"}, any_), "NSuff-tayh": nouns({"تي": "- ة"}, indefinite, ("",), OTHER_OWNERS),
        "NSuff-At": nouns({"ات": "- ة", "آت": "أ أة"}, any_), "NSuff-Ath": nouns({"ات": "- ة", "آت": "أ أة"}, indefinite, OWNERS),
        "NSuff-wn": nouns({"ون": "-"}, subject), "NSuff-wh": nouns({"و": "-"}, own_subject, ("",), OTHER_OWNERS), "NSuff-iyn": nouns({"ين": "-"}, any_), "NSuff-iyh": nouns({"ي": "-"}, indefinite, ("",), OTHER_OWNERS),
    }
    transforms |= {
        "PVPref-Wa": [prefix(a, "", "pv_p", "pv_s pv") for a in AND if a], "PVPref-La": [prefix("ل", "", "pv_p", "pv_s pv")], "PVSuff-ah": perfect("", "", OBJECTS),
        # Suffixes that join with the stem's last letter: kept apart from stems that end in it, or with it given back.
        "PVSuff-n": [r for base, unless in (("", "ن"), ("ن", "")) for r in [*perfect("ن", base, OBJECTS if base else ("", *OBJECTS), unless), *perfect("نا", base, ("", *SECOND, *THIRD), unless)]],
        "PVSuff-t": [
            *perfect("ت", "", ("", *OBJECTS)), *perfect("ت", "ت", OBJECTS),
            *(r for base, unless in (("", "ت"), ("ت", "")) for whole_, joined in (("تما", "تما"), ("تم", "تمو"), ("تن", "تن")) for r in [*perfect(whole_, base, ("",), unless), *perfect(joined, base, (*FIRST, *THIRD), unless)]),
        ],
        "PVSuff-at": perfect("تا", "", ("", *OBJECTS)), "PVSuff-A": [*perfect("ا", "", ("", *OBJECTS)), *perfect("آ", "أ", ("", *OBJECTS))], "PVSuff-uw": [*perfect("وا"), *perfect("و", "", OBJECTS)],
    }

    def dual(person: str, **options) -> list[Rule]:
        return [r for a, b in (("ا", ""), ("آ", "أ")) for end, li in ((a + "ن", False), (a, True)) for r in imperfect(person, end, b, li=li, **options)]

    def plural(person: str, **options) -> list[Rule]:
        return [*imperfect(person, "ون", li=False, **options), *imperfect(person, "وا", attached="و", **options)]

    def feminine(person: str, **options) -> list[Rule]:
        return [*imperfect(person, "ن", unless="ن", **options), *imperfect(person, "ن", "ن", **options)]

    not_second, not_first = {"pronouns": (FIRST, THIRD)}, {"pronouns": (SECOND, THIRD)}
    transforms |= {
        "IVPref-hw": imperfect("ي"), "IVPref-hy": imperfect("ت"), "IVPref-hmA": dual("ي"), "IVPref-hmA-ta": dual("ت"), "IVPref-hm": plural("ي"), "IVPref-hn": feminine("ي"),
        "IVPref-Anta": imperfect("ت", **not_second), "IVPref-Anti": [*imperfect("ت", "ين", li=False, **not_second), *imperfect("ت", "ي", **not_second)], "IVPref-AntmA": dual("ت", **not_second),
        "IVPref-Antm": plural("ت", **not_second), "IVPref-Antn": feminine("ت", **not_second), "IVPref-AnA": [*imperfect("أ", **not_first), *imperfect("آ", base="أ", **not_first)], "IVPref-nHn": imperfect("ن", **not_first),
        "CVPref": [*(prefix(a, "", "cv_p", "cv_s") for a in AND if a), *(prefix(a + "ا", "", "cv_p", "cv_s cv") for a in AND)],
        "CVSuff": [suffix(bare_ + p, "", "cv_s", "cv") for bare_, joined in (("", ""), ("ي", "ي"), ("ا", "ا"), ("وا", "و"), ("ن", "ن")) for bare_, p in [*([(bare_, "")] if bare_ else []), *((joined, p) for p in (*FIRST, *THIRD))]],
    }
    return RuleSet("ar", conditions, transforms)

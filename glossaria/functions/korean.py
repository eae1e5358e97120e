"""Korean: syllables as letters, and endings of verbs, adjectives and the copula by paradigm.

Rules work on letters (compatibility jamo), so that an ending may begin within a syllable. Compound vowels and finals are
taken apart too, which is how the rules name them: one letter each would keep rules for them from ever being met.

Endings are composed of a first and a second part (`더` and `군`) and attached by one of a few paradigms, which say what
stem, or what ending before it, stands before each of the forms an ending takes.
"""

from __future__ import annotations

from glossaria.functions.rules import Condition, Rule, RuleSet, suffix

# Initials, medials and finals in the order of their numbers; compound ones are several letters.
INITIALS = "ㄱㄲㄴㄷㄸㄹㅁㅂㅃㅅㅆㅇㅈㅉㅊㅋㅌㅍㅎ"
MEDIALS = "ㅏ ㅐ ㅑ ㅒ ㅓ ㅔ ㅕ ㅖ ㅗ ㅗㅏ ㅗㅐ ㅗㅣ ㅛ ㅜ ㅜㅓ ㅜㅔ ㅜㅣ ㅠ ㅡ ㅡㅣ ㅣ".split()
FINALS = ["", *"ㄱ ㄲ ㄱㅅ ㄴ ㄴㅈ ㄴㅎ ㄷ ㄹ ㄹㄱ ㄹㅁ ㄹㅂ ㄹㅅ ㄹㅌ ㄹㅍ ㄹㅎ ㅁ ㅂ ㅂㅅ ㅅ ㅆ ㅇ ㅈ ㅊ ㅋ ㅌ ㅍ ㅎ".split()]
SYLLABLES, PER_INITIAL = 0xAC00, len(MEDIALS) * len(FINALS)
VOWELS = set("".join(MEDIALS))


def letters_of(text: str) -> str:
    """Each syllable as its letters; other characters stay."""
    out = []
    for c in text:
        k = ord(c) - SYLLABLES
        if 0 <= k < len(INITIALS) * PER_INITIAL:
            first, rest = divmod(k, PER_INITIAL)
            out += [INITIALS[first], MEDIALS[rest // len(FINALS)], FINALS[rest % len(FINALS)]]
        else:
            out.append(c)
    return "".join(out)


def syllables_of(text: str) -> str:
    """Letters as syllables: an initial and the longest medial, then the longest final whose letters no vowel follows."""
    out, k = [], 0
    while k < len(text):
        medial = max((m for m in MEDIALS if text.startswith(m, k + 1)), key=len, default="")
        if text[k] not in INITIALS or not medial:
            out.append(text[k])
            k += 1
            continue
        end = k + 1 + len(medial)
        fits = [f for f in FINALS if text.startswith(f, end) and not (f and f[-1] in INITIALS and text[end + len(f) : end + len(f) + 1] in VOWELS)]
        final = max(fits, key=len)
        out.append(chr(SYLLABLES + INITIALS.index(text[k]) * PER_INITIAL + MEDIALS.index(medial) * len(FINALS) + FINALS.index(final)))
        k = end + len(final)
    return "".join(out)


DA = "ㄷㅏ"
VERBAL, ALL = "v adj", "v adj ida"


def rows(*found: tuple[str, str, str], inner: str = "") -> list[Rule]:
    """Suffix rules of (form, base, outer); those without an outer condition are left out."""
    return [suffix(letters_of(form), letters_of(base), inner, outer) for form, base, outer in found if outer]


def plain(ending: str, stems: str, before: str, inner: str = "") -> list[Rule]:
    """An ending that has one form: after stems of these classes, and after these endings before the last."""
    return rows((ending, DA, stems), (ending, "", before), inner=inner)


def exists(ending: str) -> list[Rule]:
    """The ending after 있- and 없-, which are neither verb nor adjective."""
    return [suffix(letters_of(stem + ending), letters_of(stem + "다")) for stem in ("있", "없")]


def linking(ending: str, stems: str, vowel: str, consonant: str, inner: str = "", drops: bool = True) -> list[Rule]:
    """An ending with 으 after consonants: `vowel` and `consonant` are what may stand before either form but stems. Stems
    in ㅂ, ㅅ, ㅎ, ㄹ and ㄷ change before it; ㄹ stays where the ending takes it along (`drops`)."""
    words = stems.replace(" ida", "").replace("ida", "")
    adjectives = "adj" if "adj" in words else ""
    return rows(
        (ending, DA, stems), (ending if drops else "ㄹ" + letters_of(ending), "ㄹㄷㅏ", words), ("ㅇㅡ" + letters_of(ending), DA, words), ("ㅇㅜ" + letters_of(ending), "ㅂㄷㅏ", words),
        ("ㅇㅡ" + letters_of(ending), "ㅅㄷㅏ", words), (ending, "ㅎㄷㅏ", adjectives), ("ㄹㅇㅡ" + letters_of(ending), "ㄷㄷㅏ", words), (ending, "", vowel), ("ㅇㅡ" + letters_of(ending), "", consonant), inner=inner,
    )


def copula(ending: str) -> list[Rule]:
    """An ending of 아니다 and 이다."""
    return rows(("아니" + ending, "아니다", "adj"), (ending, "다", "ida"), (ending, "", "eusi"))


def present(ending: str, stems: str, verbs: str = "v") -> list[Rule]:
    """ㄴ- endings: with 는 after verbs, with (으)ㄴ after the others."""
    own = letters_of(ending)
    return [*linking(own, stems, "eusi", ""), *rows(("ㄴㅡ" + own, DA, verbs), ("ㄴㅡ" + own, "", "p f eusi"))]


def quoting(ending: str, adjectives: str = "adj") -> list[Rule]:
    """Plain statements that are told: ㄴ다 and 는다 of verbs, 다 of adjectives and after other endings."""
    own = letters_of(ending)
    verbs = rows(("ㄴ" + own, DA, "v"), ("ㄴㅡㄴ" + own, DA, "v"), ("ㄴ" + own, "ㄹㄷㅏ", "v"), ("ㄴ" + own, "", "eusi"))
    return [*verbs, *rows((own, DA, adjectives), (own, "", "p f eusi"))] if adjectives else verbs


# What a stem and 아 or 어 become together, and the stem. The first rows are regular stems and contractions;
# then 하다, the stems in ㅂ, ㅅ, ㅎ, ㄷ and 르, and those in ㅡ.
INFINITIVES = (
    ("ㅏ", "", VERBAL), ("ㅓ", "", VERBAL), ("ㅇㅏ", "", VERBAL), ("ㅇㅓ", "", ALL), ("ㅏ", "ㅏ", VERBAL), ("ㅓ", "ㅓ", VERBAL), ("ㅕ", "ㅣ", VERBAL), ("ㅇㅕ", "ㅇㅣ", ALL), ("ㅐ", "ㅣ", VERBAL),
    ("ㅎㅐ", "ㅎㅏ", VERBAL), ("ㅎㅏㅇㅕ", "ㅎㅏ", VERBAL), ("ㅇㅗㅏ", "ㅂ", VERBAL), ("ㅇㅜㅓ", "ㅂ", VERBAL), ("ㅇㅏ", "ㅅ", VERBAL), ("ㅇㅓ", "ㅅ", VERBAL),
    ("ㅐ", "ㅏㅎ", "adj"), ("ㅐ", "ㅓㅎ", "adj"), ("ㅖ", "ㅕㅎ", "adj"), ("ㅒ", "ㅑㅎ", "adj"), ("ㄹㅇㅏ", "ㄷ", VERBAL), ("ㄹㅇㅓ", "ㄷ", VERBAL),
    ("ㄹㄹㅏ", "ㄹㅡ", VERBAL), ("ㄹㄹㅓ", "ㄹㅡ", VERBAL), ("ㄹㅡㄹㅓ", "ㄹㅡ", VERBAL), ("ㅏ", "ㅡ", VERBAL), ("ㅓ", "ㅡ", VERBAL),
)


def infinitive(ending: str, inner: str = "", bare: bool = True, after: str = "p f") -> list[Rule]:
    """Endings that follow 아 or 어; a stem in a vowel may stand as it is before them (`bare`)."""
    own = letters_of(ending)
    made = [(joined + own, stem + DA, outer) for joined, stem, outer in INFINITIVES if own or joined != stem]
    return rows(*made, *([(own, DA, VERBAL)] if bare and own else []), *([("ㅇㅓ" + own, "", after)] if after else []), inner=inner)


def past(ending: str, inner: str) -> list[Rule]:
    own = "ㅆ" + letters_of(ending)
    return [*infinitive(own, inner, after=""), *rows(("ㅅㅕ" + own, "ㅅㅣ", "eusi"), ("ㅅㅣㅇㅓ" + own, "ㅅㅣ", "eusi"), inner=inner)]


def joined(first: str, second: str) -> list[str]:
    """An ending's first part with each second part; `-` is none."""
    return [first + (x if x != "-" else "") for x in second.split()]


# Second parts that several first parts take: of exclamations, and of what is told.
EXCLAIMED = "구나 구려 구료 구만 구먼 구면 군"
TOLD = "고 나 네 느니 니 니까 며 면 면서 손 오 지"

# Endings by paradigm, what stems they follow and what other endings (for 으 endings after a vowel | after a consonant).
PLAIN = {
    (ALL, "p f eusi"): [
        *joined("거", "니와 던 드면 든 들랑"), *"건마는 건만 걸랑 것마는".split(), *joined("", EXCLAIMED)[1:], "기", "기에", "다가는", "단", *joined("더", EXCLAIMED), *joined("더", "냐 뇨 니라 니마는 니만 니이까 니이다 라도 이까 이다"),
        *joined("던", "- 가 감 걸 고 데 바 지"), "데", "데요", "도다", *joined("드", "구나 구료 구면 군 냐 니 니라 라 라도 래도"), *joined("든", "걸 고 데"), *"듯 듯이 디 언만 죠 지 지요".split(),
    ],
    (ALL, "p f"): "소이까 지마는 지만서도".split(), (VERBAL, "p f"): ["누", *joined("사오", "니까 리까 리다 리이까 리이다 이다"), *joined("사옵", "니까 니다 디까 디다"), *"사와 사외다 소 소다 소이다 쇠다".split()],
    ("v", "eusi"): [*"게나 고야 고자 고저 노라면 누나 누만 누먼 느라 느라고".split(), *joined("는", EXCLAIMED), "자마자"], ("v", ""): ["거라", "너라", "노라고", "는도다", "세나", *joined("자", "고 구 꾸나 느니 니까 며 면 면서 손")],
    (ALL, "p eusi"): "것다 게 고말고 관데 길래 다마다 든 든가 든지".split(), (VERBAL, "eusi"): "게끔 게시리 고는 곤 도록".split(), (VERBAL, "p f eusi"): "느냐 느냐고 느뇨 느니 다간".split(),
    (ALL, "p f euob eusi"): "거나 거늘 거니 건".split(), ("", "p"): "던들 드라면 든들 에라".split(), (ALL, "p"): "기로서 기로서니 기로선들".split(), (ALL, ""): "기로 기로니".split(), ("v", "p f eusi sab euob"): "나니 노니".split(),
    (VERBAL, ""): "노라니 노라니까".split(), ("v", "p f eusi"): "남 는궈니 는과니".split(), ("v", "p eusi jaob"): ["건대"], (ALL, "p f eusi saob euob euo sab jaob jab"): ["고"], (ALL, "eusi"): ["고도"], ("adj ida", "p f eusi"): ["구나"],
    (VERBAL, "p f eusi saob euob"): ["나이까"], (VERBAL, "p f eusi saob jaob jab euob"): ["나이다"], ("v", "p f"): ["노라"], ("", "p f eusi ida"): ["다"], (VERBAL, "p eusi"): ["다가"], (VERBAL, "p f "): ["다시피"],
    (ALL, "p f eusi euob euo sab"): ["더니"], ("v ida", ""): ["자"], (ALL, "p f euo euob"): ["지만"],
}
#: Endings that also follow 있- and 없-.
AFTER_EXISTS = set("고자 고저 노라면 는궈니 는과니 다시피".split())
LINKING = {
    (ALL, "eusi|p"): [*joined("ㄹ", "걸 까 깝쇼 꼬 는지 라 라고 러니 러라 런가 런고 런지 레 레라 망정 밖에 뿐더러 새 세 세라 세말이지 소냐 손가 수록 시 싸록 쏘냐 쏜가 지 지나 지니 지니라 지라 지라도 지로다 지며 지언정 진대 진대는 진댄 진저 -"), *"려나 려니 려니와 려면 련마는 련만 렷다 리라 ㄴ즉 ㄴ즉슨".split()],
    (ALL, "eusi|p f"): [*"나마 니까 니까느루 니까는 니깐".split(), *joined("옵", "니까 니다 디까 디다 소서"), *"외다 ㄹ거나 매 면서 므로 며 우".split()], (ALL, "eusi euo|p"): [*joined("리", "- 까 니 니라 다 로다 만치 만큼 오"), "ㄹ이만큼"],
    ("v", "|"): ["ㄹ게", "마", "시압", *joined("십", "사 시다 시오"), *joined("ㅂ", "쇼 시다 시오"), "세"], ("v", "eusi|p"): [*joined("려", "- 거든 든 마 무나"), *"련 렴 렵니까 렵니다".split()], ("v", "eusi|"): joined("ㄹ", "라치면 래 려고 작시면 지어다"),
    ("v ida", "eusi|"): ["랴", "러"], (ALL, "|"): [*joined("ㄹ ", "거야 거예요 것이다 것입니다 거다 겁니다"), "ㄹ께", "세요", "셔요", "시어요"], (VERBAL, "|"): "락 사 사이다 소서".split(), (ALL, "p f eusi|p f eusi"): ["냐", "냐고"], (ALL, "eusi|"): ["뇨", "ㄴ들"],
    (VERBAL, "eusi|p f"): ["오니까", "오이다"], (VERBAL, "eusi|"): ["오리이까", "오리이다"], (ALL, "p f eusi sao|p f"): ["나"], (ALL, "eusi f|"): ["ㄴ"], (ALL, "eusi euo sao jao|p f eusi euo sao jao"): ["니"], (VERBAL, "eusi|p"): ["려고"],
    (ALL, "eusi euo jao|p f"): ["면", "와"], ("adj", "|"): ["이", "ㄹ사"], ("adj", "eusi|"): ["ㄹ데라니"], ("adj ida", "eusi|p"): ["ㄹ시고"],
}
COPULA = [*"라서 라야 라야만 랍시고".split(), *joined("러", "니 니라 니이까 니이다 라 이까 이다"), "런가", "런들", "로고", "로고나", *joined("로", EXCLAIMED), *"로다 로되 로세".split()]
ORDERED = [*joined("라", "- 고 구 나 네 느니 니 니까 며 면 면서 손 오 지"), *"란 란다 랍니까 랍니다 래 래요 람".split()]
STATED = [*joined("다", TOLD), *joined("다", "더라 마는 만"), *"단다 담 답니까 답니다 답시고 대 대요 댄다".split()]
#: Told statements that verbs have without ㄴ too.
STATED_BARE = set("다니 다오 답니까 답니다 답시고 대 대요 댄다".split())


def korean() -> RuleSet:
    dictionary = [Condition(c) for c in ("v", "adj", "ida")]
    internal = [Condition(c, (), False) for c in "p f eusi euob euo sao saob sab jaob jao jab do".split()]
    transforms: dict[str, list[Rule]] = {"어간": [suffix(c, c + DA, "", VERBAL) for c in dict.fromkeys([*INITIALS, *"".join(MEDIALS)])]}
    for (stems, before), names in PLAIN.items():
        transforms |= {f"-{e}": [*plain(e, stems, before), *(exists(e) if e in AFTER_EXISTS else [])] for e in names}
    for (stems, either), names in LINKING.items():
        transforms |= {f"-(으){e}": linking(e, stems, *either.split("|")) for e in names}
    transforms |= {f"-(으){e}": linking(e, ALL, "eusi", "p f", drops=False) for e in ("ㅁ", "ㅁ도", "ㅁ에랴")} | {"-(으)ㅁ세": linking("ㅁ세", "v", "", "", drops=False)}
    transforms |= {f"-{e}": copula(e) for e in COPULA}
    transforms |= {f"-(으){e}": [*linking(e, "v ida", "eusi do", ""), *rows(("아니" + e, "아니다", "adj"))] for e in ORDERED}
    transforms |= {f"-((느)ㄴ){e}": quoting(e, VERBAL if e in STATED_BARE else "adj") for e in STATED} | {"-(느)ㄴ다": quoting("다", "")}
    transforms |= {f"-(스)ㅂ{e}": rows((b, DA, ALL), (b, "ㄹㄷㅏ", VERBAL), ("ㅅㅡ" + b, DA, VERBAL), ("ㅅㅡ" + b, "", "p f"), (b, "", "eusi")) for e in "네 늰다 니까 니다 디까 디다 딘다 죠 지요".split() for b in ["ㅂ" + letters_of(e)]}
    transforms |= {f"-(으/느)ㄴ{e}": [*present("ㄴ" + e, ALL if e in ("걸", "바", "지고", "지라") else "adj ida"), *exists("느ㄴ" + e)] for e in "가 감 걸 고 데 뎁쇼 바 지 지고 지라".split()}
    transforms |= {f"-(으/느){e}": present(e, stems, VERBAL) for e, stems in (("니만치", ALL), ("니만큼", ALL), ("니라", "adj ida"))}
    transforms |= {f"-아/어{e}": infinitive(e, bare=e not in ("다", "지다", "지이다")) for e in ("", *"다 다가 도 라 서 야 야만 야지 요 지이다 지다".split())}
    transforms |= {"-아/어야겠": infinitive("야겠", "f"), "-았/었": past("", "p"), "-았/었었": past("었", "p"), "-았/었자": past("자", "")}
    transforms["-아/어요"] += rows(("ㅇㅖㅇㅛ", "ㅇㅣㄷㅏ", "adj ida"), ("ㅇㅔㅇㅛ", DA, "adj ida"))
    # Endings that other endings follow, by the condition they leave.
    transforms |= {"-겠": plain("겠", ALL, "p eusi", "f"), "-더": plain("더", ALL, "p f eusi", "do"), "-(으)시": linking("시", ALL, "saob euob jaob", "", "eusi"), "-(으)오": linking("오", VERBAL, "eusi", "p f", "euo"), "-(으)옵": linking("옵", ALL, "eusi", "p f", "euob")}
    transforms |= {f"-{e}": plain(e, VERBAL, "p f", c) for e, c in (("사오", "sao"), ("사옵", "saob"), ("삽", "sab"))} | {f"-{e}": plain(e, "v", "", c) for e, c in (("자오", "jao"), ("자옵", "jaob"), ("잡", "jab"))}
    transforms |= {f"-{e} 하다": plain(e + " 하다", "v", "eusi", "v") for e in ("고는", "곤")}
    transforms |= {
        "-고서": [*plain("고서", "v", "eusi"), *rows(("아니고서", "아니다", "adj"))], "-네": [*plain("네", ALL, "p f eusi"), *rows(("네", "ㄹㄷㅏ", VERBAL))], "-오이까": [*plain("오이까", ALL, "eusi"), *rows(("오이까", "ㄹㄷㅏ", VERBAL))],
        "-는": [*plain("는", "v", "eusi f"), *rows(("는", "ㄹㄷㅏ", "v"), ("없는", "없다", "adj"))], "-느니만": plain("느니만 못하다", VERBAL, "", "v"), "-(으)되": rows(("되", DA, ALL), ("으되", DA, VERBAL), ("되", "", "eusi"), ("으되", "", "p f")),
        "-라도": rows(("아니라도", "아니다", "adj"), ("라도", DA, "ida")), "-로라": rows(("아니로라", "아니다", "adj"), ("로라", "다", "ida")), "-로서니": rows(("아니로서니", "아니다", "adj"), ("로서니", "다", "ida")), "-요": rows(("아니요", "아니다", "ida"), ("요", DA, "ida")),
        "-야": rows(("아니야", "아니다", "adj"), ("이야", "이다", "ida")), "-(으)ㄹ락": linking("ㄹ락 말락", "v", "eusi", "p"), **{f"-{e}": rows(("아니" + e, "아니다", "adj"), ("이" + e, "이다", "ida")) for e in ("올습니다", "올시다")},
        **{f"-{e}": rows((e, "아니다", "adj"), (e, "이다", "ida"), (e, "", "eusi")) for e in ("언마는", "언정")},
    }
    return RuleSet("ko", [*dictionary, *internal], transforms)

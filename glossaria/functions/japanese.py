"""Japanese: endings of verbs and adjectives by the row of the syllabary that they follow, slang and Kansai speech.

A form is an ending and the stem it takes: of consonant verbs (v5) the syllable of one row, of vowel verbs (v1) nothing in
place of る, of zuru, suru and kuru verbs (vz, vs, vk) stems of their own. Forms in て and た join with the stem.
"""

from __future__ import annotations

from glossaria.functions.kana import ROWS, VOWELS
from glossaria.functions.rules import Condition, Rule, RuleSet, suffix

# Last syllables of consonant verbs, with the consonant of their row; what joins with て and た.
GODAN = {"う": "w", "く": "k", "ぐ": "g", "す": "s", "つ": "t", "ぬ": "n", "ぶ": "b", "む": "m", "る": "r"}
JOINED = {"う": "っ", "く": "い", "ぐ": "い", "す": "し", "つ": "っ", "ぬ": "ん", "ぶ": "ん", "む": "ん", "る": "っ"}
VOICED, VOICE = "ぐぬぶむ", {"て": "で", "た": "だ", "ち": "じ"}
#: Verbs in く that join by っ, verbs in う that stay whole before て, and those with a stem of their own.
GO = ("いく", "行く", "逝く", "往く")
WHOLE = "こう とう 請う 乞う 恋う 問う 訪う 宣う 曰う 給う 賜う 揺蕩う".split()
OWN = (("のたまう", "のたもう"), ("たまう", "たもう"), ("たゆたう", "たゆとう"))
COME = (("来", "来る"), ("來", "來る"))
#: Rows of irregular stems by what they precede: zuru, suru, kuru.
MA_STEMS, NAI_STEMS, NU_STEMS = ("じ", "し", "き"), ("じ", "し", "こ"), ("ぜ", "せ", "こ")


def row(base: str, vowel: str) -> str:
    """The syllable of a consonant verb's last one with another vowel."""
    c = GODAN[base]
    return {"a": "わ"}.get(vowel, ROWS[""][VOWELS.index(vowel)]) if c == "w" else ROWS[c][VOWELS.index(vowel)]


def godan(vowel: str, ending: str, inner: str, outer: str = "v5") -> list[Rule]:
    return [suffix(row(b, vowel) + ending, b, inner, outer) for b in GODAN]


def irregular(ending: str, stems: tuple[str, str, str], inner: str) -> list[Rule]:
    zuru, suru, kuru = stems
    made = [suffix(zuru + ending, "ずる", inner, "vz"), suffix(suru + ending, "する", inner, "vs"), suffix("為" + ending, "為る", inner, "vs"), suffix(kuru + ending, "くる", inner, "vk")]
    return made + [suffix(kanji + ending, base, inner, "vk") for kanji, base in COME]


def verbs(vowel: str, ending: str, stems: tuple[str, str, str], inner: str = "", ichidan: str | None = None) -> list[Rule]:
    return [suffix(ending if ichidan is None else ichidan, "る", inner, "v1"), *godan(vowel, ending, inner), *irregular(ending, stems, inner)]


def joined(ending: str, inner: str = "") -> list[Rule]:
    """Forms in て and た: the stem's last syllable changes, and after some voices the ending."""
    voiced = VOICE[ending[0]] + ending[1:]
    own = [suffix(JOINED[b] + (voiced if b in VOICED else ending), b, inner, "v5") for b in GODAN]
    return [suffix(ending, "る", inner, "v1"), *own, *irregular(ending, MA_STEMS, inner)]


def and_verbs_apart(ending: str, inner: str = "") -> list[Rule]:
    return [*(suffix(f"{v[0]}っ{ending}", v, inner, "v5") for v in GO), *(suffix(v + ending, v, inner, "v5") for v in WHOLE), *(suffix(stem + ending, v, inner, "v5") for v, stem in OWN)]


def contracted(ending: str) -> list[Rule]:
    """ては run together: joined forms with つ- endings, and く verbs with っ."""
    return [*joined(ending, "v5"), suffix("っ" + ending, "く", "v5", "v5")]


def pairs(text: str, inner: str = "", outer: str = "") -> list[Rule]:
    words = text.split()
    return [suffix(a, b, inner, outer) for a, b in zip(words[::2], words[1::2], strict=True)]


# Vowels that Kansai speech and slang draw together: syllables and what they are drawn from.
LONG_O = "a おう あ か こう か が ごう が さ そう さ ざ ぞう ざ た とう た だ どう だ な のう な は ほう は ば ぼう ば ま もう ま ら ろう ら や よう や".split()
DRAWN = "ねえ ない めえ むい みい むい ちぇえ つい ちい つい せえ すい ええ いい ええ わい ええ よい いぇえ よい うぇえ わい けえ かい げえ がい げえ ごい せえ さい めえ まい ぜえ ずい っぜえ ずい れえ らい ちぇえ ちゃい でえ どい れえ れい べえ ばい てえ たい"
DRAWN_SMALL = "ねぇ ない めぇ むい みぃ むい ちぃ つい せぇ すい けぇ かい げぇ がい げぇ ごい せぇ さい めぇ まい ぜぇ ずい っぜぇ ずい れぇ らい でぇ どい れぇ れい べぇ ばい てぇ たい"


def kansai(ending: str, plain: str, kind: str = "") -> list[Rule]:
    """うて for って after any syllable, and drawn together with an a before it; ゆう is said for いう."""
    made = [("う" + ending, plain)]
    for a in "あかがさざただなはばまらや":
        line = next(r for r in ROWS.values() if a in r) if a != "や" else "や　　　よ"
        made.append((line[4] + "う" + ending, a + plain))
    return [suffix(a, b, kind, kind) for a, b in [*made, ("ゆう" + ending, "い" + plain)]]


def kansai_adjective(ending: str, plain: str, kind: str) -> list[Rule]:
    made = [("う" + ending, plain), *((ROWS[c][4] + "う" + ending, ROWS[c][0] + plain) for c in ("k", "g", "s", "t", "n", "b", "m", "r")), ("よう" + ending, "よ" + plain), ("しゅう" + ending, "し" + plain)]
    return [suffix(a, b, kind, kind) for a, b in made]


def japanese() -> RuleSet:
    endings = ("-ます", "-ません", "-て", "-ば", "-く", "-た", "-ん", "-なさい", "-ゃ")
    conditions = [
        Condition("v", ("v1", "v5", "vk", "vs", "vz"), False), Condition("v1", ("v1d", "v1p")), Condition("v1d", (), False), Condition("v1p", (), False), Condition("v5", ("v5d", "v5s")), Condition("v5d", (), False),
        Condition("v5s", ("v5ss", "v5sp"), False), Condition("v5ss", (), False), Condition("v5sp", (), False), *(Condition(c) for c in ("vk", "vs", "vz", "adj-i")), *(Condition(c, (), False) for c in endings),
    ]
    adjective = lambda ending, inner="": [suffix(ending, "い", inner, "adj-i")]
    conditional = [suffix(row(b, "e") + "ば", b, "-ば", "v5") for b in GODAN if b != "る"]
    short = {b: ("v5ss" if b == "す" else "v5sp") for b in GODAN}
    transforms: dict[str, list[Rule]] = {
        "-ば": [*adjective("ければ", "-ば"), *conditional, suffix("れば", "る", "-ば", "v1 v5 vk vs vz"), suffix("れば", "", "-ば", "-ます")],
        "-ゃ": [*pairs("けりゃ ければ きゃ ければ や えば", "-ゃ", "-ば"), *(suffix(row(b, "i") + "ゃ", row(b, "e") + "ば", "-ゃ", "-ば") for b in GODAN if b != "う")],
        **{f"-{e}": contracted(e) for e in ("ちゃ", "ちゃう", "ちまう")}, "-しまう": [suffix(f"{te}しまう", te, "v5", "-て") for te in "てで"],
        "-なさい": verbs("i", "なさい", MA_STEMS, "-なさい"), "-そう": [*adjective("そう"), *verbs("i", "そう", MA_STEMS)],
        **{f"-{e}": [*adjective(e, "v1"), *verbs("i", e, MA_STEMS, "v1")] for e in ("すぎる", "過ぎる")}, "-たい": verbs("i", "たい", MA_STEMS, "adj-i"),
        "-たら": [*adjective("かったら"), *joined("たら"), *and_verbs_apart("たら"), suffix("ましたら", "ます", "", "-ます")], "-たり": [*adjective("かったり"), *joined("たり"), *and_verbs_apart("たり")],
        "-て": [*adjective("くて", "-て"), *joined("て", "-て"), *and_verbs_apart("て", "-て"), suffix("まして", "ます", "", "-ます")],
        **{f"-{e}": verbs("a", e, NU_STEMS, inner) for e, inner in (("ず", ""), ("ぬ", ""), ("ん", "-ん"), ("んばかり", ""), ("んとする", "vs"), ("む", ""), ("ざる", ""), ("ねば", "-ば"))},
        "-く": adjective("く", "-く"),
        "causative": [*verbs("a", "せる", ("じさ", "さ", "こさ"), "v1", "させる"), suffix("ぜさせる", "ずる", "v1", "vz"), suffix("せさせる", "する", "v1", "vs"), suffix("為させる", "為る", "v1", "vs"), *(suffix(k + "させる", b, "v1", "vk") for k, b in COME)],
        "short causative": [suffix("さす", "る", "v5ss", "v1"), *(suffix(row(b, "a") + "す", b, c, "v5") for b, c in short.items()), *irregular("す", ("じさ", "さ", "こさ"), "v5ss"), suffix("ぜさす", "ずる", "v5ss", "vz"), *(suffix(k + "さす", b, "v5ss", "vk") for k, b in COME)],
        "imperative": [*(suffix(e, "る", "", "v1") for e in "ろよ"), *godan("e", "", ""), *pairs("じろ ずる ぜよ ずる", "", "vz"), *pairs("しろ する せよ する 為ろ 為る 為よ 為る", "", "vs"), *pairs("こい くる 来い 来る 來い 來る", "", "vk")],
        "continuative": [*(suffix(s, s + "る", "", "v1d") for s in "いえきぎけげじせぜちてでにねひびへべみめりれ"), *godan("i", "", ""), suffix("き", "くる", "", "vk"), suffix("し", "する", "", "vs"), *(suffix(k, b, "", "vk") for k, b in COME)],
        "negative": [*adjective("くない", "adj-i"), *verbs("a", "ない", NAI_STEMS, "adj-i"), suffix("ません", "ます", "-ません", "-ます")],
        "-さ": adjective("さ"), "-き": adjective("き"), "-げ": [*adjective("げ"), *adjective("気")], "-がる": adjective("がる", "v5"),
        "passive": [*(suffix(row(b, "a") + "れる", b, "v1", "v5d v5sp" if b == "す" else "v5") for b in GODAN), *pairs("じされる ずる ぜされる ずる", "v1", "vz"), *pairs("される する 為れる 為る", "v1", "vs"), *pairs("こられる くる 来られる 来る 來られる 來る", "v1", "vk")],
        "-た": [*adjective("かった", "-た"), *joined("た", "-た"), *and_verbs_apart("た", "-た"), suffix("ました", "ます", "-た", "-ます"), suffix("でした", "", "-た", "-ません"), suffix("かった", "", "-た", "-ません -ん")],
        "-ます": [suffix("ます", "る", "-ます", "v1"), *(suffix(row(b, "i") + "ます", b, "-ます", "v5d v5s" if b == "す" else "v5d") for b in GODAN), *irregular("ます", MA_STEMS, "-ます"), *adjective("くあります", "-ます")],
        "potential": [*(suffix(row(b, "e") + "る", b, "v1", "v5d" if b != "る" else "v1 v5d") for b in GODAN), *pairs("できる する 出来る する", "v1", "vs"), *pairs("これる くる 来れる 来る 來れる 來る", "v1", "vk")],
        "potential or passive": [suffix("られる", "る", "v1", "v1"), *pairs("ざれる ずる ぜられる ずる", "v1", "vz"), *pairs("せられる する 為られる 為る", "v1", "vs"), *pairs("こられる くる 来られる 来る 來られる 來る", "v1", "vk")],
        "volitional": [*verbs("o", "う", ("じよ", "しよ", "こよ"), "", "よう"), *pairs("為よう 為る", "", "vs"), *(suffix(k + "よう", b, "", "vk") for k, b in COME), suffix("ましょう", "ます", "", "-ます"), *adjective("かろう")],
        "volitional slang": [*verbs("o", "っか", ("じよ", "しよ", "こよ"), "", "よっか"), *pairs("為よっか 為る", "", "vs"), *(suffix(k + "よっか", b, "", "vk") for k, b in COME), suffix("ましょっか", "ます", "", "-ます")],
        "-まい": [suffix("まい", "", "", "v"), suffix("まい", "る", "", "v1"), *irregular("まい", NAI_STEMS, ""), suffix("まい", "", "", "-ます")],
        "-おく": [*pairs("ておく て でおく で とく て どく で", "v5", "-て"), *pairs("ないでおく ない ないどく ない", "v5", "adj-i")],
        "-いる": [*pairs("ている て でいる で", "v1", "-て"), *pairs("てる て でる で", "v1p", "-て"), *pairs("ておる て でおる で とる て", "v5", "-て"), suffix("ないでいる", "ない", "v1", "adj-i")],
        "-え": pairs(f"{DRAWN} {DRAWN_SMALL}", "", "adj-i"),
        "n-slang": [suffix("んなさい", "りなさい", "", "-なさい"), *pairs("らんない られない んない らない", "adj-i", "adj-i"), *pairs("んなきゃ らなきゃ んなきゃ れなきゃ", "", "-ゃ")],
        "imperative negative slang": [suffix("んな", "る", "", "v")],
        "kansai-ben negative": [*pairs("へん ない ひん ない せえへん しない", "", "adj-i"), *pairs("へんかった なかった ひんかった なかった", "-た", "-た"), suffix("うてへん", "ってない", "adj-i", "adj-i")],
        **{f"kansai-ben -{e}": kansai(e, "っ" + e, inner) for e, inner in (("て", "-て"), ("た", "-た"), ("たら", ""), ("たり", ""))},
        "kansai-ben -く": [r._replace(inner=()) for r in kansai_adjective("", "く", "-く")], "kansai-ben adjective -て": kansai_adjective("て", "くて", "-て"), "kansai-ben adjective negative": kansai_adjective("ない", "くない", "adj-i"),
    }
    return RuleSet("ja", conditions, transforms)

"""Rule sets by language. Paradigms are spelled out as endings of a class, and irregular stems as one entry each."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import cache
from itertools import product

from glossaria.functions.arabic import arabic
from glossaria.functions.japanese import japanese
from glossaria.functions.korean import korean
from glossaria.functions.rules import Condition, Rule, RuleSet, everywhere, pattern, prefix, rewrite, suffix, whole
from glossaria.functions.tagalog import tagalog


def doubled(consonants: str, ending: str, inner: str, outer: str) -> list[Rule]:
    return [suffix(c + c + ending, c, inner, outer) for c in consonants]


def endings(text: str, base: str, inner: str, outer: str | None = None) -> list[Rule]:
    return [suffix(e, base, inner, inner if outer is None else outer) for e in text.split()]


# Words that form phrasal verbs.
PARTICLES = "aboard about above across ahead alongside apart around aside astray away back before behind below beneath besides between beyond by close down east west north south eastward westward northward southward forward backward backwards forwards home in inside instead near off on opposite out outside over overhead past round since through throughout together under underneath up within without".split()
PREPOSITIONS = "aback about above across after against ahead along among apart around as aside at away back before behind below between beyond by down even for forth forward from in into of off on onto open out over past round through to together toward towards under up upon way with without".split()
PHRASAL_WORDS = frozenset([*PARTICLES, *PREPOSITIONS])
PHRASAL_LENGTHS = sorted({len(w) for w in PHRASAL_WORDS})
# Separable prefixes of German verbs.
SEPARABLE = "ab an auf aus auseinander bei da dabei dar daran dazwischen durch ein empor entgegen entlang entzwei fehl fern fest fort frei gegenüber gleich heim her herab heran herauf heraus herbei herein herüber herum herunter hervor hin hinab hinauf hinaus hinein hinterher hinunter hinweg hinzu hoch los mit nach nebenher nieder statt um vor voran voraus vorbei vorüber vorweg weg weiter wieder zu zurecht zurück zusammen".split()
ACUTE = dict(zip("aeiou", "áéíóú", strict=True))


def led_by_particle(text: str) -> bool:
    """The text begins with a word of phrasal verbs, or with letters that are one."""
    return any(text[:n] in PHRASAL_WORDS for n in PHRASAL_LENGTHS)


def phrasal(rule: Rule) -> Rule:
    """A suffix rule for the verb before a particle: looked up, look up."""

    def base(text: str) -> str | None:
        verb, _, rest = text.partition(" ")
        fits = verb.endswith(rule.inflected) and (verb.isalnum() or "_" in verb) and led_by_particle(rest)
        return f"{verb.removesuffix(rule.inflected)}{rule.base} {rest}" if fits else None

    return rewrite(f"{rule.inflected} before a particle", base, "v", "v_phr")


def object_between(text: str) -> str | None:
    """What stands between a verb and its particle goes: turn it off, turn off. Words are passed until one that belongs to
    phrasal verbs; the last one on the way that begins like a particle is taken for it."""
    words, last = text.split(" "), None
    for k, word in enumerate(words[1:], 1):
        if k > 1 and any(word.startswith(p) for p in PARTICLES):
            last = k
        if PHRASAL_WORDS.intersection(re.findall(r"\w+", word)):
            break
    return " ".join([words[0], *words[last:]]) if last else None


def english() -> RuleSet:
    doubling = "bdgklmnprstz"
    # Irregular past forms that compounds share.
    irregular = {"laid": "lay", "paid": "pay", "said": "say"}
    past = [*endings("ed", "", "v"), *endings("ed", "e", "v"), *endings("ied", "y", "v"), *endings("cked", "c", "v"), *doubled(doubling, "ed", "v", "v"), *(suffix(form, verb, "v", "v") for form, verb in irregular.items())]
    gerund = [*endings("ing", "", "v"), *endings("ing", "e", "v"), *endings("ying", "ie", "v"), *endings("cking", "c", "v"), *doubled(doubling, "ing", "v", "v")]
    third = [*endings("s es", "", "v"), *endings("ies", "y", "v")]
    any_ = "adj adv v"
    return RuleSet(
        "en", [Condition("v", ("v_phr",)), Condition("v_phr"), Condition("n", ("np", "ns")), Condition("np"), Condition("ns"), Condition("adj"), Condition("adv")],
        {
            "plural": [*endings("s es", "", "np", "ns"), suffix("ies", "y", "np", "ns"), suffix("ves", "fe", "np", "ns"), suffix("ves", "f", "np", "ns")],
            "possessive": [suffix("'s", "", "n", "n"), suffix("s'", "s", "n", "n")],
            "past": [*past, *map(phrasal, past)], "ing": [*gerund, *map(phrasal, gerund)], "3rd pers. sing. pres": [*third, *map(phrasal, third)],
            "interposed object": [rewrite("object", object_between, "", "v_phr")], "archaic": [suffix("'d", "ed", "v", "v")],
            "adverb": [suffix("ly", "", "adv", "adj"), suffix("ily", "y", "adv", "adj"), suffix("ly", "le", "adv", "adj")],
            "comparative": [*endings("er", "", "adj"), *endings("er", "e", "adj"), *endings("ier", "y", "adj"), *doubled("bdgmnt", "er", "adj", "adj")],
            "superlative": [*endings("est", "", "adj"), *endings("est", "e", "adj"), *endings("iest", "y", "adj"), *doubled("bdgmnt", "est", "adj", "adj")],
            "dropped g": [suffix("in'", "ing", "v", "v")],
            "-y": [suffix("y", "", "adj", "n v"), suffix("y", "e", "adj", "n v"), *doubled("glmnprst", "y", "", "n v")],
            "un-": [prefix("un", "", any_, any_)], "going-to future": [prefix("going to ", "", "v", "v")], "will future": [prefix("will ", "", "v", "v")],
            "imperative negative": [prefix("don't ", "", "v", "v"), prefix("do not ", "", "v", "v")],
            "-able": [suffix("able", "", "v", "adj"), suffix("able", "e", "v", "adj"), suffix("iable", "y", "v", "adj"), *doubled(doubling, "able", "v", "adj")],
        },
    )


def german() -> RuleSet:
    letters, either = "a-zA-ZäöüßÄÖÜẞ", "|".join(SEPARABLE)
    return RuleSet(
        "de", [Condition("v", ("vw", "vs")), Condition("vw"), Condition("vs"), Condition("n"), Condition("adj")],
        {
            "nominalization": [suffix("ung", "en", "", "v"), suffix("lung", "eln", "", "v"), suffix("rung", "rn", "", "v")],
            "-bar": [suffix("bar", "en", "adj", "v"), suffix("bar", "n", "adj", "v")], "negative": [prefix("un", "", "", "adj")],
            "past participle": [
                *(pattern(f"^ge([{letters}]+)t$", rf"\g<1>{e}", "", "vw") for e in ("n", "en")),
                *(pattern(f"^({either})ge([{letters}]+)t$", rf"\g<1>\g<2>{e}", "", "vw") for e in ("n", "en")),
            ],
            "separated prefix": [pattern(f"^([{letters}]+) .+ {p}$", rf"\g<1> {p}") for p in SEPARABLE],
            "zu-infinitive": [prefix(p + "zu", p, "", "v") for p in SEPARABLE],
            "-heit": [suffix("heit", "", "n", "adj n"), suffix("keit", "", "n", "adj n")],
        },
    )


def spanish() -> RuleSet:
    classes = {"ar": "v_ar", "er": "v_er", "ir": "v_ir"}

    def regular(ar: str, er: str, ir: str) -> list[Rule]:
        return [r for base, own in zip(classes, (ar, er, ir), strict=True) for r in endings(own, base, classes[base])]

    def forms(base: str, text: str, make: Callable[..., Rule] = whole) -> list[Rule]:
        return [make(x, base, "v", "v") for x in text.split()]

    def persons(stem: str, tails: str) -> str:
        return " ".join(stem + t for t in tails.split())

    def stem(changed: str, original: str, base: str, tails: str) -> Rule:
        return pattern(rf"{changed}([a-z]*)({tails})$", rf"{original}\g<1>{base}", classes[base], classes[base])

    def stems(ar: str, er: str) -> list[Rule]:
        changes = [("ie", "e", b, t) for b, t in zip(classes, (ar, er, er), strict=True)] + [("ue", "o", b, t) for b, t in zip(classes, (ar, er, er), strict=True)]
        return [stem(*c) for c in [*changes, ("i", "e", "ir", er)]]

    preterite = "e iste o imos isteis ieron"
    strong = {"poner": "pus", "venir": "vin", "tener": "tuv", "poder": "pud", "saber": "sup", "estar": "estuv", "andar": "anduv", "querer": "quis"}
    short = {"decir": "dir", "hacer": "har", "poner": "pondr", "salir": "saldr", "tener": "tendr", "venir": "vendr", "querer": "querr", "poder": "podr", "saber": "sabr"}
    past_subjunctive = "ra ras ra ramos rais ran se ses se semos seis sen"
    return RuleSet(
        "es", [Condition("n", ("ns", "np")), Condition("np"), Condition("ns"), Condition("v", ("v_ar", "v_er", "v_ir")), Condition("v_ar"), Condition("v_er"), Condition("v_ir"), Condition("adj")],
        {
            "plural": [*endings("s es", "", "np", "ns"), suffix("ces", "z", "np", "ns"), *(suffix(f"{v}{c}es", f"{ACUTE[v]}{c}", "np", "ns") for c in "sn" for v in "aeiou")],
            "feminine adjective": [suffix("a", "o", "adj", "adj"), suffix("a", "", "adj", "adj"), *(suffix(f"{v}{c}a", f"{ACUTE[v]}{c}", "adj", "adj") for c in "ns" for v in "aeio")],
            "present indicative": [
                *stems("o|as|a|an", "o|es|e|en"), *regular("o as a amos áis an", "o es e emos éis en", "o es e imos ís en"), *endings("uyo uyes uye uyen", "uir", "v_ir"),
                *forms("tener", "tengo tienes tiene tenemos tenéis tienen", suffix), *forms("oír", "oigo oyes oye oímos oís oyen", suffix), *forms("venir", "vengo vienes viene venimos venís vienen", suffix),
                *(suffix(a, b, "v", "v") for a, b in (("go", "guir"), ("jo", "ger"), ("jo", "gir"), ("aigo", "aer"), ("zco", "cer"), ("zco", "cir"), ("hago", "hacer"), ("pongo", "poner"), ("lgo", "lir"), ("lgo", "ler"))),
                *forms("caber", "quepo"), *forms("dar", "doy"), *forms("saber", "sé"), *forms("ver", "veo"), *forms("ser", "soy eres es somos sois son"),
                *forms("estar", "estoy estás está estamos estáis están"), *forms("ir", "voy vas va vamos vais van"), *forms("haber", "he has ha hemos habéis han"),
            ],
            "preterite": [
                stem("i", "e", "ir", "ió|ieron"), stem("u", "o", "ir", "ió|ieron"), *regular("é aste ó amos asteis aron", "í iste ió imos isteis ieron", "í iste ió imos isteis ieron"),
                *(suffix(a, b, "v", "v") for a, b in (("qué", "car"), ("gué", "gar"), ("cé", "zar"), ("í", "uir"))), *forms("ser", "fui fuiste fue fuimos fuisteis fueron"), *forms("ir", "fui fuiste fue fuimos fuisteis fueron"),
                *forms("dar", "di diste dio dimos disteis dieron"), *forms("hacer", "hice hiciste hizo hicimos hicisteis hicieron", suffix), *forms("decir", "dije dijiste dijo dijimos dijisteis dijeron", suffix),
                *(r for base, s in strong.items() for r in forms(base, persons(s, preterite), suffix if base in ("poner", "venir", "tener") else whole)),
            ],
            "imperfect": [*regular("aba abas aba ábamos abais aban", "ía ías ía íamos íais ían", "ía ías ía íamos íais ían eía eías eía eíamos eíais eían"), *forms("ser", "era eras era éramos erais eran"), *forms("ir", "iba ibas iba íbamos ibais iban"), *forms("ver", "veía veías veía veíamos veíais veían")],
            "progressive": [stem("i", "e", "ir", "iendo"), stem("u", "o", "er", "iendo"), stem("u", "o", "ir", "iendo"), *regular("ando", "iendo", "iendo"), suffix("ayendo", "aer", "v_er", "v_er"), suffix("eyendo", "eer", "v_er", "v_er"), suffix("uyendo", "uir", "v_ir", "v_ir"), *forms("oír", "oyendo"), *forms("ir", "yendo")],
            "imperative": [*stems("a|e|en", "e|a|an"), *regular("a emos ad", "e ed", "e id"), *endings("amos", "ar", "v_er"), *endings("amos", "ar", "v_ir"), *(whole(a, b, "v", "v") for a, b in (("diga", "decir"), ("sé", "ser"), ("ve", "ir"), ("ten", "tener"), ("ven", "venir"), ("haz", "hacer"), ("di", "decir"), ("pon", "poner"), ("sal", "salir"))), *regular("es emos éis", "as amos áis", "as amos áis")],
            "conditional": [*endings("ía ías ía íamos íais ían", "", "v"), *(r for base, s in short.items() for r in forms(base, persons(s, "ía ías ía íamos íais ían")))],
            "future": [*endings("é ás á emos éis án", "", "v"), *(r for base, s in short.items() for r in forms(base, persons(s, "é ás á emos éis án"), suffix if base in ("decir", "poner", "tener", "venir") else whole))],
            "present subjunctive": [*stems("e|es|en", "a|as|an"), *regular("e es e emos éis en", "a as a amos áis an", "a as a amos áis an")],
            "imperfect subjunctive": [*regular(persons("a", past_subjunctive), persons("ie", past_subjunctive), persons("ie", past_subjunctive)), *forms("ser", persons("fue", past_subjunctive)), *forms("ir", persons("fue", past_subjunctive))],
            "participle": [*regular("ado", "ido", "ido"), *(whole(a, b, "v", "v") for a, b in (("abierto", "abrir"), ("cubierto", "cubrir"), ("dicho", "decir"), ("escrito", "escribir"), ("hecho", "hacer"), ("muerto", "morir"), ("puesto", "poner"), ("visto", "ver"), ("vuelto", "volver")))],
            "reflexive": [suffix(f"{b}se", b, c, c) for b, c in classes.items()],
            "pronoun substitution": [suffix(f"{b}{p}", f"{b}se", "v_er" if (b, p) == ("ar", "nos") else c, "v_er" if (b, p) == ("ar", "nos") else c) for p in ("me", "te", "nos") for b, c in classes.items()],
            "pronominal": [pattern(r"^(?:me|te|se|nos|os) ([a-záéíóúñ]+)$", r"\g<1>se", "v", "v")],
        },
    )


def french() -> RuleSet:
    tenses = {
        "present indicative": {"er": "e es e ons ez ent", "ir": "is is it issons issez issent s s t ons ez ent", "re": "s s t ons ez ent"},
        "imperfect indicative": {b: "ais ais ait ions iez aient" for b in ("er", "re")} | {"ir": "issais issais issait issions issiez issaient ais ait ions iez aient"},
        "future": {"er": "erai eras era erons erez eront", "ir": "irai iras ira irons irez iront", "re": "rai ras ra rons rez ront"},
        "imperative present": {"er": "e ons ez", "ir": "is issons issez", "re": "s ons ez"},
        "conditional": {"er": "erais erais erait erions eriez eraient", "ir": "irais irais irait irions iriez iraient", "re": "rais rais rait rions riez raient"},
        "preterite": {"er": "ai as a âmes âtes èrent", "ir": "is is it îmes îtes irent", "re": "is is it îmes îtes irent us us ut ûmes ûtes urent"},
        "present subjunctive": {"er": "e es e ions iez ent", "ir": "isse isses isse issions issiez issent", "re": "e es e ions iez ent"},
    }
    irregular = {
        "present indicative": {"être": "suis es est sommes êtes sont", "avoir": "ai as a avons avez ont"}, "imperfect indicative": {"être": "étais était étions étiez étaient", "avoir": "avais avait avions aviez avaient"},
        "future": {"être": "serai seras sera serons serez seront", "avoir": "aurai auras aura aurons aurez auront"}, "imperative present": {"être": "sois soyons soyez", "avoir": "aie ayons ayez"},
        "conditional": {"être": "serais serait serions seriez seraient", "avoir": "aurais aurait aurions auriez auraient"}, "preterite": {"être": "fus fut fûmes fûtes furent", "avoir": "eus eut eûmes eûtes eurent"},
        "present subjunctive": {"être": "sois soit soyons soyez soient", "avoir": "aie aies ait ayons ayez aient"},
    }
    # Stems whose spelling follows the ending: what stands before it, and what stands there in the infinitive.
    spelling = [("ge", "g"), ("ç", "c"), ("i", "y"), ("ll", "l"), ("tt", "t"), *((f"è{c}", f"{e}{c}") for e, c in product("eé", "bcdglmnprstv"))]

    def tense(name: str) -> list[Rule]:
        rules = [suffix(x, base, "aux", "v") for base, text in irregular[name].items() for x in dict.fromkeys(text.split())]
        for base, text in tenses[name].items():
            rules += endings(" ".join(dict.fromkeys(text.split())), base, "v")
        changed = tenses[name]["er"].split()
        return rules + [suffix(a + e, b + "er", "v", "v") for a, b in spelling for e in dict.fromkeys(changed)]

    return RuleSet(
        "fr", [Condition(c) for c in ("v", "n", "adj", "adv", "aux")],
        {
            **{name: tense(name) for name in tenses},
            "plural": [suffix(a, b, "n", "n") for a, b in (("s", ""), ("aux", "au"), ("aux", "al"), ("aux", "ail"), ("eaux", "eau"), ("eux", "eu"), ("oux", "ou"))],
            "present participle": [*(suffix("ant", b, "v", "v") for b in ("er", "ir", "re")), suffix("geant", "ger", "v", "v"), suffix("çant", "cer", "v", "v"), suffix("issant", "ir", "v", "v"), suffix("étant", "être", "aux", "v"), suffix("ayant", "avoir", "aux", "v"), suffix("sachant", "savoir", "v", "v")],
        },
    )


def georgian() -> RuleSet:
    cases = "ები ებს ების ებით ებად ებმა მა ს ის ით ად ო ში ზე თან".split()
    return RuleSet("ka", [Condition("v"), Condition("n", ("np", "ns")), Condition("np"), Condition("ns"), Condition("adj"), Condition("adv")], {
        "nounAdjSuffixStripping": [suffix(c, "", "", "") for c in cases], "nounAdjStemCompletion": [suffix(c, "ი", "", "") for c in cases],
    })


def irish() -> RuleSet:
    # Letters that eclipse initial consonants.
    eclipsed = {"mb": "b", "gc": "c", "nd": "d", "bhf": "f", "ng": "g", "bp": "p", "dt": "t"}
    return RuleSet("ga", [Condition("v", ("v_phr",)), Condition("v_phr"), Condition("n", ("np", "ns")), Condition("np"), Condition("ns"), Condition("adj"), Condition("adv")], {"eclipsis": [prefix(a, b) for a, b in eclipsed.items()]})


def esperanto() -> RuleSet:
    nominal = "n adj"
    prefixes = {p: "n adj adv v" for p in ("mal", "kun", "ekster", "ek", "ĵus", "el", "dis", "for", "mis")}
    return RuleSet("eo", [Condition(c) for c in ("n", "adj", "adv", "v")], {
        "accusative": [suffix("n", "", nominal, nominal)], "plural": [suffix("j", "", nominal, nominal)], "diminutive": [suffix("eto", "o", "n", "n")],
        "adjectival": [suffix("a", "o", "adj", "n")], "adverbial": [suffix("e", "a", "adv", "adj"), suffix("e", "i", "adv", "v")],
        "-ejo": [suffix("ejo", "o", "n", "n"), suffix("ejo", "i", "n", "v")], "-ujo": [suffix("ujo", "o", "n", "n"), suffix("ujo", "a", "n", "adj"), suffix("ujo", "i", "n", "v")],
        "-ebla": [suffix("ebla", "i", "adj", "v")], "-ado": [suffix("ado", "i", "n", "v")], **{f"{p}-": [prefix(p, "", c, c)] for p, c in prefixes.items()},
    })


def latin() -> RuleSet:
    return RuleSet("la", [Condition("v"), Condition("n", ("ns", "np")), Condition("ns"), Condition("np"), Condition("adj")], {
        "plural": [suffix("ae", "a", "np", "ns"), suffix("i", "us", "np", "ns"), suffix("a", "um", "np", "ns"), suffix("es", "", "np", "ns"), suffix("es", "is", "np", "ns")],
        "feminine": [suffix("a", "us", "adj", "adj")], "neuter": [suffix("um", "us", "adj", "adj")], "ablative": [suffix("o", "um", "n", "n")],
    })


def listed(text: str, inner: str = "", outer: str = "") -> list[Rule]:
    """Suffix rules from pairs such as `ies>y`."""
    return [suffix(*pair.split(">"), inner, outer) for pair in text.split()]


def ancient_greek() -> RuleSet:
    """Present tense persons of -ω, -εω and -ομαι verbs, and cases of three declensions."""
    # Endings and what they stand for, by transform.
    verbs = {
        "2nd person singular present active indicative": "εις>ω εις>εω", "3rd person singular present active indicative": "ει>ω ει>εω", "1st person plural present active indicative": "ομεν>ω", "2nd person plural present active indicative": "ετε>ω",
        "3rd person plural present active indicative": "ουσι>ω ουσιν>ω", "2nd person singular present middle indicative": "ῃ>ομαι ει>ομαι", "3rd person singular present middle indicative": "εται>ομαι",
        "1st person plural present middle indicative": "ομεθα>ομαι", "2nd person plural present middle indicative": "εσθε>ομαι", "3rd person plural present middle indicative": "ονται>ομαι",
    }
    plural = "οι>ος αι>α αι>ας α>ον αι>η"
    nouns = {
        "genitive singular": "ου>ος ας>α ου>ας ου>ον ης>η", "dative singular": "ω>ος α>ας ω>ον", "accusative singular": "ον>ος αν>α αν>ας ην>η", "vocative singular": "ε>ος α>ας η>η",
        "nominative plural": plural, "genitive plural": "ων>ος ων>α ων>ας ων>ον ων>η", "dative plural": "οις>ος αις>α αις>ας οις>ον αις>η", "accusative plural": "ους>ος ας>α α>ον ας>η", "vocative plural": plural,
    }
    return RuleSet("grc", [Condition("v"), Condition("n"), Condition("adj")], {
        **{k: listed(t, "", "v") for k, t in verbs.items()}, **{k: listed(t, "", "n") for k, t in nouns.items()},
        "accusative singular masculine": listed("ον>ος", "", "adj"), "nominalization": listed("ος>εω", "", "v"),
    })


def albanian() -> RuleSet:
    """Definite nouns, and persons of the three conjugations; the second one doesn't follow a j."""

    def second(ending: str) -> Rule:
        return pattern(f"([^j]){ending}$", r"\g<1>", "", "v")

    # Rows of person, ending and what it stands for.
    present = (
        ("first-person singular", "on", "oj"), ("first-person singular", "uan", "uaj"), ("first-person singular", "n", "j"), ("first-person singular", "hesh", "hem"),
        ("second-person singular", "on", "oj"), ("second-person singular", "uan", "uaj"), ("second-person singular", "n", "j"), ("second-person singular", "het", "hem"),
        ("third-person singular", "më", ""), ("third-person singular", "im", ""), ("third-person singular", "hemi", "hem"), ("first-person plural", "ni", "j"), ("first-person plural", "ni", ""), ("first-person plural", "heni", "hem"),
        ("second-person plural", "në", ""), ("second-person plural", "in", ""), ("second-person plural", "hen", "hem"),
    )
    imperfect = (
        ("first-person singular", "ja", "j"), ("first-person singular", "ja", ""), ("first-person singular", "hesha", "hem"), ("second-person singular", "je", "j"), ("second-person singular", "je", ""), ("second-person singular", "heshe", "hem"),
        ("third-person singular", "nte", "j"), ("third-person singular", "te", ""), ("third-person singular", "hej", "hem"), ("first-person plural", "nim", "j"), ("first-person plural", "nim", ""), ("first-person plural", "heshim", "hem"),
        ("second-person plural", "nit", "j"), ("second-person plural", "nit", ""), ("second-person plural", "heshit", "hem"), ("third-person plural", "nin", "j"), ("third-person plural", "nin", ""), ("third-person plural", "heshin", "hem"),
    )
    # The ending of the second conjugation by person, and the others' rows before and after it.
    aorist = {"first-person singular": "a", "second-person singular": "e", "third-person singular": "i", "first-person plural": "ëm", "second-person plural": "ët", "third-person plural": "ën"}
    aorist_before = (
        ("first-person singular", "ova", "uaj"), ("first-person singular", "va", "j"), ("second-person singular", "ove", "uaj"), ("second-person singular", "ve", "j"), ("third-person singular", "oi", "oj"), ("third-person singular", "oi", "uaj"), ("third-person singular", "u", "j"),
        ("first-person plural", "uam", "oj"), ("first-person plural", "uam", "uaj"), ("first-person plural", "më", "j"), ("second-person plural", "uat", "oj"), ("second-person plural", "uat", "uaj"), ("second-person plural", "të", "j"),
        ("third-person plural", "uan", "oj"), ("third-person plural", "uan", "uaj"), ("third-person plural", "në", "j"),
    )
    aorist_after = (("third-person singular", "ye", "ej"),)

    def of_person(rows: tuple, person: str) -> list[Rule]:
        return [suffix(ending, base, "", "v") for p, ending, base in rows if p == person]

    optative = {"first-person singular": "fsha", "second-person singular": "fsh", "third-person singular": "ftë", "first-person plural": "fshim", "second-person plural": "fshi", "third-person plural": "fshin"}
    definite = (("ku", "k"), ("gu", "g"), ("hu", "h"), ("au", "a"), ("iu", "i"), ("eu", "e"), ("i", "ë"), ("i", ""), ("ri", ""), ("oi", "ua"), ("a", "ë"), ("a", ""), ("ja", "e"))
    v = lambda *pairs: [suffix(a, b, "", "v") for a, b in pairs]
    return RuleSet("sq", [Condition("v"), Condition("n", ("np", "ns")), Condition("np"), Condition("ns"), Condition("adj"), Condition("adv")], {
        "definite": [suffix(a, b, "", "n") for a, b in definite], "singular definite accusative": [suffix("n", "", "", "n")], "plural": [suffix("e", "", "np", "ns"), suffix("t", "", "np", "ns")],
        **{f"present indicative {p}": of_person(present, p) for p in aorist if of_person(present, p)}, **{f"imperfect {p} indicative": of_person(imperfect, p) for p in aorist},
        **{f"aorist {p} indicative": [*of_person(aorist_before, p), second(e), *of_person(aorist_after, p)] for p, e in aorist.items()},
        "imperative second-person singular present": v(("o", "oj"), ("hu", "hem")), "imperative second-person plural present": v(("ni", "j"), ("ni", ""), ("huni", "hem")), "participle": v(("uar", "oj"), ("ur", ""), ("rë", "j"), ("yer", "ej")),
        "mediopassive": [suffix("hem", "h", "v", "v"), suffix("hem", "j", "v", "v")], **{f"optative {p} present": v((e, "j")) for p, e in optative.items()}, "nominalization": v(("im", "oj"), ("im", "ej"), ("je", "")),
    })


def yiddish() -> RuleSet:
    """Plurals, diminutives and present tense, with and without a change of the last vowel."""
    # Plural and diminutive endings, and changed vowels with what they were.
    plural = "ס ן ים ער עך ען עס ות נס ערען ענעס ענס ערס סער"
    changing, small = "ער עס ים ען ן ס עך ערס", "ל עלע"
    vowels = [("ע", "\ufb2e"), ("ע", "\ufb2f"), ("ע", "א"), ("\u05f1", "ע"), ("\u05f2", "\u05f1"), ("י", "ו")]
    letters = "\u05e2\u05f0\u05d0\ufb2e\u05f1\u05d5\u05f2\ufb1d\ufb1f\u05d9\ufb2f"

    def changed(endings_: str, inner: str, outer: str) -> list[Rule]:
        # The last vowel before the ending is the changed one.
        return [pattern(f"{new}(?=[^{letters}]*{e}$)(.*){e}$", old + r"\g<1>", inner, outer) for e in endings_.split() for new, old in vowels]

    return RuleSet("yi", [Condition("v", ("vpast", "vpresent")), Condition("vpast", (), False), Condition("vpresent"), Condition("n", ("np", "ns")), Condition("np"), Condition("ns"), Condition("adj"), Condition("adv")], {
        "plural": [suffix(e, "", "np", "ns") for e in plural.split()], "umlaut_plural": changed(changing, "np", "ns"), "diminutive": [suffix(e, "", "n", "n") for e in "טשיק קע ל עלע".split()], "diminutive_and_umlaut": changed(small, "n", "n"),
        "verb_present_singular_to_first_person": [suffix(e, "", "v", "vpresent") for e in "סט ט נדיק".split()], "verb_present_plural_to_first_person": [suffix(e, "נ", "v", "vpresent") for e in "טס ט".split()],
    })


def old_irish() -> RuleSet:
    """Spellings of one sound inside a word, and initial mutations. No conditions, so every rule applies to every form."""
    stops, all_ = ("c", "p", "t"), ("c", "p", "t", "g", "b", "d", "r", "l", "n", "m", "s")
    voiced = ("g", "b", "d")
    inside = lambda a, b: everywhere(f"(?<!^){a}", b)
    return RuleSet("sga", [], {
        "nd for nn": [suffix("nd", "nn")], **{f"{a} for {b}": [everywhere(a, b)] for a, b in (("cg", "c"), ("td", "t"), ("pb", "p"))}, "ǽ/æ for é": [everywhere("ǽ", "é"), everywhere("æ", "é")],
        "doubled vowel": [inside(2 * a, b) for a, b in ACUTE.items()], "doubled consonant": [inside(2 * c, c) for c in all_], "lenited": [inside(c + "h", c) for c in stops], "lenited (Middle Irish)": [inside(c + "h", c) for c in voiced],
        "[IM] nasalized": [prefix("ng", "g"), prefix("mb", "b"), prefix("nd", "d"), prefix("n-", ""), prefix("m-", "")], "[IM] nasalized (Middle Irish)": [prefix("gc", "c"), prefix("bp", "p"), prefix("dt", "d")],
        "[IM] lenited": [prefix(c + "h", c) for c in stops], "[IM] lenited (Middle Irish)": [prefix(c + "h", c) for c in voiced],
        "[IM] aspirated": [*(prefix("h" + v, v) for v in "aeiou"), prefix("h-", "")], "[IM] geminated": [*(prefix(2 * c, c) for c in all_), *(prefix(f"{c}-{c}", c) for c in all_)],
    })


MAKERS = {"sga": old_irish, "grc": ancient_greek, "sq": albanian, "yi": yiddish, "en": english, "de": german, "es": spanish, "fr": french, "ja": japanese, "ka": georgian, "ga": irish, "eo": esperanto, "la": latin, "ko": korean, "tl": tagalog, "ar": arabic}
_added: dict[str, RuleSet] = {}


def add_rule_set(rules: RuleSet) -> None:
    """Make a language's rules known, or replace them, in this process; operators ship the set to the tasks."""
    _added[rules.language] = rules


@cache
def _made(language: str) -> RuleSet:
    return MAKERS[language]()


def rule_set(language: str) -> RuleSet | None:
    if language in _added:
        return _added[language]
    return _made(language) if language in MAKERS else None

import re

import pytest

from glossaria.functions.korean import letters_of, syllables_of
from glossaria.functions.rule_sets import MAKERS, rule_set
from glossaria.functions.rules import BETWEEN, MAX_DEPTH, Condition, RuleSet, around, pattern, prefix, suffix, whole


def bases(language, word):
    if language == "ko":
        return {syllables_of(f.text) for f in rule_set(language).closure(letters_of(word))}
    return {f.text for f in rule_set(language).closure(word)}


@pytest.mark.parametrize(
    ("language", "inflected", "base"),
    [
        ("en", "walked", "walk"), ("en", "hoped", "hope"), ("en", "stopped", "stop"), ("en", "tried", "try"), ("en", "cities", "city"), ("en", "knives", "knife"), ("en", "lying", "lie"), ("en", "happier", "happy"),
        ("en", "unhappily", "happy"), ("en", "don't go", "go"), ("en", "looked up", "look up"), ("en", "turn it off", "turn off"), ("en", "readable", "read"), ("en", "runnin'", "run"),
        ("de", "gemacht", "machen"), ("de", "aufgemacht", "aufmachen"), ("de", "Schönheit", "Schön"), ("de", "aufzumachen", "aufmachen"), ("de", "mache das auf", "mache auf"), ("de", "unklar", "klar"), ("de", "Zeichnung", "Zeichnen"),
        ("es", "hablamos", "hablar"), ("es", "pienso", "pensar"), ("es", "canciones", "canción"), ("es", "tuvimos", "tener"), ("es", "hablaré", "hablar"), ("es", "me despertar", "despertarse"), ("es", "escrito", "escribir"), ("es", "lavarme", "lavarse"),
        ("fr", "parlons", "parler"), ("fr", "finissait", "finir"), ("fr", "mangeant", "manger"), ("fr", "chevaux", "cheval"), ("fr", "serons", "être"), ("fr", "vendront", "vendre"), ("fr", "mangeais", "manger"),
        ("ja", "食べた", "食べる"), ("ja", "書いて", "書く"), ("ja", "読まない", "読む"), ("ja", "行った", "行く"), ("ja", "高くない", "高い"), ("ja", "食べられた", "食べる"), ("ja", "します", "する"), ("ja", "来なかった", "来る"), ("ja", "食べている", "食べる"), ("ja", "泳いだ", "泳ぐ"),
        ("grc", "λογου", "λογος"), ("grc", "λυομεν", "λυω"), ("sq", "punova", "punuaj"), ("sq", "libri", "libr"), ("sq", "hapa", "hap"), ("yi", "ביכער", "בוכ"), ("sga", "máccán", "mácán"), ("sga", "chenél", "cenél"), ("yi", "טישן", "טיש"), ("yi", "קינדער", "קינד"), ("ga", "gcat", "cat"), ("eo", "malbona", "bona"), ("la", "puellae", "puella"), ("ka", "სახლები", "სახლ"),
    ],
)
def test_golden_pairs(language, inflected, base):
    assert base in bases(language, inflected)


# Inflected word, base and the name of the transform that is applied to it first.
KOREAN = [
    ("먹거나", "먹다", "-거나"), ("가거든", "가다", "-거든"), ("먹더군", "먹다", "-더군"), ("크던가", "크다", "-던가"), ("가든데", "가다", "-든데"), ("먹사옵니다", "먹다", "-사옵니다"), ("가는구나", "가다", "-는구나"), ("가자면", "가다", "-자면"), ("먹길래", "먹다", "-길래"),
    ("먹도록", "먹다", "-도록"), ("먹느냐", "먹다", "-느냐"), ("있고자", "있다", "-고자"), ("없다시피", "없다", "-다시피"), ("먹으면", "먹다", "-(으)면"), ("가면", "가다", "-(으)면"), ("추우면", "춥다", "-(으)면"), ("들으면", "듣다", "-(으)면"), ("지으면", "짓다", "-(으)면"),
    ("파라면", "파랗다", "-(으)면"), ("갈지언정", "가다", "-(으)ㄹ지언정"), ("살지라도", "살다", "-(으)ㄹ지라도"), ("먹을걸", "먹다", "-(으)ㄹ걸"), ("갈 거예요", "가다", "-(으)ㄹ 거예요"), ("먹으라니까", "먹다", "-(으)라니까"), ("갑니다", "가다", "-(스)ㅂ니다"),
    ("먹습니다", "먹다", "-(스)ㅂ니다"), ("삽니다", "살다", "-(스)ㅂ니다"), ("먹는다", "먹다", "-(느)ㄴ다"), ("간다", "가다", "-(느)ㄴ다"), ("먹는다면서", "먹다", "-((느)ㄴ)다면서"), ("크다니", "크다", "-((느)ㄴ)다니"), ("간답니다", "가다", "-((느)ㄴ)답니다"), ("먹는데", "먹다", "-(으/느)ㄴ데"),
    ("큰데", "크다", "-(으/느)ㄴ데"), ("없는데", "없다", "-(으/느)ㄴ데"), ("먹어요", "먹다", "-아/어요"), ("가요", "가다", "-아/어요"), ("도와서", "돕다", "-아/어서"), ("더워서", "덥다", "-아/어서"), ("들어도", "듣다", "-아/어도"), ("몰라", "모르다", "-아/어"), ("예뻐", "예쁘다", "-아/어"), ("해야지", "하다", "-아/어야지"),
    ("빨개서", "빨갛다", "-아/어서"), ("마셔", "마시다", "-아/어"), ("삶", "살다", "-(으)ㅁ"), ("감", "가다", "-(으)ㅁ"), ("학생이라서", "학생이다", "-라서"), ("아니로군", "아니다", "-로군"), ("학생이에요", "학생이다", "-아/어요"), ("먹고는 하다", "먹다", "-고는 하다"), ("갈락 말락", "가다", "-(으)ㄹ락"),
    ("읽으시는", "읽다", "-는"), ("먹었다", "먹다", "-다"), ("갔다", "가다", "-다"), ("하겠습니다", "하다", "-(스)ㅂ니다"), ("먹었었다", "먹다", "-다"), ("도왔어요", "돕다", "-아/어요"), ("가셨다", "가다", "-다"), ("먹더니", "먹다", "-더니"), ("가오니", "가다", "-(으)니"), ("하네", "하다", "-네"), ("아네", "알다", "-네"),
]
TAGALOG = [
    ("pag-asa", "pagasa", "hyphenated"), ("basahin", "basa", "-in"), ("inumin", "inom", "-in"), ("lakaran", "lakad", "-an"), ("puntahan", "punta", "-an"), ("tulungan", "tulong", "-an"), ("marunong", "dunong", "ma-"), ("maganda", "ganda", "ma-"), ("pandikit", "dikit", "pang-"), ("pambansa", "bansa", "pang-"),
    ("pangalawa", "dalawa", "pang-"), ("ikatlo", "tatlo", "ika-"), ("kaibigan", "ibig", "ka-...-an"), ("karunungan", "dunong", "ka-...-an"), ("kabutihan", "buti", "ka-...-an"), ("magluluto", "luto", "mag- + rep1"), ("pagbabasa", "basa", "pag- + rep1"), ("mambabasa", "basa", "mang- + rep1"),
    ("pamilihan", "mili", "pa-...-an"), ("pagkain", "kain", "pag-"), ("tagapagturo", "turo", "tagapag-"), ("makipagusapan", "usap", "makipag-...-an"), ("pantulugan", "tulog", "pang-...-an"), ("nakakatakot", "takot", "nakaka-"), ("nakapanlulumo", "lumo", "nakapang- + rep1"), ("bahayng", "bahay", "-ng"),
]
ARABIC = [
    ("وكتاب", "كتاب", "NPref-Wa"), ("بالكتاب", "كتاب", "NPref-BiAl"), ("والكتاب", "كتاب", "NPref-Al"), ("للولد", "ولد", "NPref-Lil"), ("للغة", "لغة", "NPref-LiAl"), ("كتابهم", "كتاب", "NSuff-h"), ("مدرستنا", "مدرسة", "NSuff-ath"), ("كتابا", "كتاب", "NSuff-AF"), ("كتابان", "كتاب", "NSuff-An"), ("معلمات", "معلمة", "NSuff-At"),
    ("مدرسون", "مدرس", "NSuff-wn"), ("سيارتان", "سيارة", "NSuff-atAn"), ("كتبت", "كتب", "PVSuff-t"), ("كتبوا", "كتب", "PVSuff-uw"), ("كتبنا", "كتب", "PVSuff-n"), ("سكتنا", "سكت", "PVSuff-n"), ("قرآ", "قرأ", "PVSuff-A"), ("يكتب", "كتب", "IVPref-hw"), ("سيكتبها", "كتب", "IVPref-hw"), ("تكتبين", "كتب", "IVPref-Anti"),
    ("يكتبون", "كتب", "IVPref-hm"), ("لتكتبوا", "كتب", "IVPref-Antm"), ("يكتبن", "كتب", "IVPref-hn"), ("أكتبه", "كتب", "IVPref-AnA"), ("آكل", "أكل", "IVPref-AnA"), ("نكتب", "كتب", "IVPref-nHn"), ("يستعمل", "استعمل", "IVPref-hw"), ("يكرمون", "أكرم", "IVPref-hm"), ("اكتب", "كتب", "CVPref"), ("اكتبوا", "كتب", "CVSuff"), ("وبالمعلمات", "معلمة", "NSuff-At"),
]


JAPANESE = [
    ("書けば", "書く", "-ば"), ("高ければ", "高い", "-ば"), ("すりゃ", "する", "-ゃ"), ("行きゃ", "行く", "-ゃ"), ("食べちゃ", "食べる", "-ちゃ"), ("読んじゃう", "読む", "-ちゃう"), ("行っちまう", "行く", "-ちまう"), ("食べてしまう", "食べる", "-しまう"), ("飲みなさい", "飲む", "-なさい"), ("高そう", "高い", "-そう"), ("食べすぎる", "食べる", "-すぎる"),
    ("飲み過ぎた", "飲む", "-過ぎる"), ("したい", "する", "-たい"), ("泳いだら", "泳ぐ", "-たら"), ("問うたら", "問う", "-たら"), ("来たり", "来る", "-たり"), ("逝って", "逝く", "-て"), ("のたもうて", "のたまう", "-て"), ("論じて", "論ずる", "-て"), ("せず", "する", "-ず"), ("言わぬ", "言う", "-ぬ"), ("食べん", "食べる", "-ん"), ("泣かんばかり", "泣く", "-んばかり"),
    ("行かんとする", "行く", "-んとする"), ("行かむ", "行く", "-む"), ("知らざる", "知る", "-ざる"), ("行かねば", "行く", "-ねば"), ("高く", "高い", "-く"), ("来させる", "来る", "causative"), ("書かす", "書く", "short causative"), ("來い", "來る", "imperative"), ("書け", "書く", "imperative"), ("食べ", "食べる", "continuative"), ("飲み", "飲む", "continuative"),
    ("来ない", "来る", "negative"), ("食べません", "食べる", "negative"), ("高さ", "高い", "-さ"), ("読まれる", "読む", "passive"), ("書かされた", "書く", "passive"), ("食べませんでした", "食べる", "-た"), ("為ます", "為る", "-ます"), ("書ける", "書く", "potential"), ("出来る", "する", "potential"), ("食べられる", "食べる", "potential or passive"), ("しよう", "する", "volitional"), ("行こっか", "行く", "volitional slang"),
    ("行くまい", "行く", "-まい"), ("食べとく", "食べる", "-おく"), ("読んでる", "読む", "-いる"), ("書いておる", "書く", "-いる"), ("美しき", "美しい", "-き"), ("寒げ", "寒い", "-げ"), ("寒がる", "寒い", "-がる"), ("すげえ", "すごい", "-え"), ("わかんない", "わかる", "n-slang"), ("すんな", "する", "imperative negative slang"), ("知らへん", "知る", "kansai-ben negative"), ("買うて", "買う", "kansai-ben -て"),
    ("もろうた", "もらう", "kansai-ben -た"), ("よう", "よい", "kansai-ben -く"), ("高うて", "高い", "kansai-ben adjective -て"), ("高うない", "高い", "kansai-ben adjective negative"), ("笑うたら", "笑う", "kansai-ben -たら"), ("笑うたり", "笑う", "kansai-ben -たり"),
]


def test_every_japanese_transform_has_a_pair():
    assert {name for *_, name in JAPANESE} == set(rule_set("ja").transforms)


@pytest.mark.parametrize(("language", "pairs"), [("ja", JAPANESE), ("ko", KOREAN), ("tl", TAGALOG), ("ar", ARABIC)])
def test_golden_pairs_by_transform(language, pairs):
    made = rule_set(language)
    split, whole_ = (letters_of, syllables_of) if language == "ko" else (str, str)
    for word, base, name in pairs:
        found = [f for f in made.closure(split(word)) if whole_(f.text) == base]
        assert name in {t for f in found for t, *_ in f.trace}, (word, base, name)


@pytest.mark.parametrize("language", ["ja", "ko", "tl", "ar"])
def test_every_rule_is_met_by_a_form_made_with_it(language):
    rules = rule_set(language)
    for name, entries in rules.transforms.items():
        for number, r in enumerate(entries):
            if r.kind == "around" and not r.stem_base:
                before, after = r.inflected.split(BETWEEN)
                stems = ["batak"] if language == "tl" else ["كتب"]
                words = [(before + s + after, r.base.replace(BETWEEN, s)) for s in stems]
            elif r.kind in ("suffix", "prefix") and r.inflected:
                stem = {"ja": "食べ", "ko": "ㅁㅓㄱ", "tl": "batak", "ar": "كتب"}[language]
                words = [(stem + r.inflected, stem + r.base) if r.kind == "suffix" else (r.inflected + stem, r.base + stem)]
            else:
                continue
            for word, base in words:
                assert any(e[1:3] == (name, number) and made == base for e, made in rules.rewrites(word)), (name, r)


def test_syllables_and_letters():
    every = [chr(c) for c in range(0xAC00, 0xAC00 + 11172)]
    assert [syllables_of(letters_of(c)) for c in every] == every
    words = [a + b + c for a, b, c in zip(every, every[::-1], every[5000:] + every[:5000], strict=True)]
    assert [syllables_of(letters_of(w)) for w in words] == words
    assert letters_of("값을 왔 a") == "ㄱㅏㅂㅅㅇㅡㄹ ㅇㅗㅏㅆ a" and syllables_of("ㅂㅅ ㅏㄱ x") == "ㅂㅅ ㅏㄱ x"


def test_around_needs_both_ends_and_its_stem():
    r = RuleSet("x", [], {"k": [around("ka", "an", "", "", stem=r"\w+"), around("m", "", "p", "", stem="[^a].*"), around("", "s", "", "", stem="(.*)u(.)", stem_base=r"\1o\2")]})
    assert [m for _, m in r.rewrites("kabanan")] == ["ban"] and not list(r.rewrites("kaan")) and not list(r.rewrites("kan"))
    assert [m for _, m in r.rewrites("mba")] == ["pba"] and not list(r.rewrites("ma")) and [m for _, m in r.rewrites("xubs")] == ["xob"]


def test_korean_lookup(spark):
    from glossaria.operators import lookup
    from glossaria.sources.catalog import enabled_map

    schema = "dictionary string, id long, expression string, reading string, rules array<string>, score double, sequence long, definitions array<string>, definition_tags array<string>, term_tags array<string>"
    terms = spark.createDataFrame([("A", 1, "돕다", "", ["v"], 1.0, -1, ["to help"], [], []), ("A", 2, "춥다", "", ["adj"], 1.0, -1, ["cold"], [], []), ("A", 3, "도오다", "", ["n"], 1.0, -1, ["no such verb"], [], [])], schema)
    asked = spark.createDataFrame([("1", "도와서"), ("2", "추웠어요"), ("3", "집")], "query_id string, text string")
    found = lookup.find_terms(asked, terms, enabled_map(spark, ["A"]), "ko", "simple").collect()
    assert {(r["query_id"], d["id"]) for r in found for d in r["definitions"] if r["max_length"] > 2} == {("1", 1), ("2", 2)}


def test_phrasal_verbs():
    assert {"look up"} <= bases("en", "looked up") and "look up" not in bases("en", "looked upon us") - {"look up"}
    assert "turn off" in bases("en", "turn it off") and "turn off" in bases("en", "turning the old light off") and "put up with" not in bases("en", "put up it with")
    assert "take upset" in bases("en", "take it upset") and bases("en", "turn it") == {"turn it"}


def test_every_rule_set_compiles():
    for language in MAKERS:
        assert rule_set(language).transforms


def test_flags_of_groups_are_those_of_members():
    r = RuleSet("x", [Condition("v", ("a", "b")), Condition("a"), Condition("b"), Condition("n", (), False)], {})
    assert r.flags["v"] == r.flags["a"] | r.flags["b"]
    assert r.part_of_speech_flags(["v", "n", "unknown"]) == r.flags["v"]


def test_unresolved_and_unknown_conditions_are_errors():
    with pytest.raises(ValueError, match="cannot be resolved"):
        RuleSet("x", [Condition("v", ("w",)), Condition("w", ("v",))], {})
    with pytest.raises(ValueError, match="unknown condition"):
        RuleSet("x", [Condition("a")], {"t": [suffix("s", "", "b", "a")]})
    with pytest.raises(ValueError, match="more than 32"):
        RuleSet("x", [Condition(str(k)) for k in range(33)], {})


def test_rules_without_inner_conditions_apply_only_while_nothing_is_known():
    r = RuleSet("x", [Condition("a"), Condition("b")], {"one": [suffix("s", "", "", "a")], "two": [prefix("un", "", "", "b")]})
    found = {(f.text, f.flags) for f in r.closure("uns")}
    assert found == {("uns", 0), ("un", r.flags["a"]), ("s", r.flags["b"])}


def test_cycles_end_and_order_is_breadth_first():
    r = RuleSet("x", [], {"flip": [pattern("a", "b"), pattern("b", "a")]})
    forms = r.closure("a")
    assert [len(f.trace) for f in forms] == sorted(len(f.trace) for f in forms)
    assert {f.text for f in forms} == {"a", "b"}


def test_empty_suffix_leaves_the_base_only_and_whole_words_match_wholly():
    r = RuleSet("x", [], {"e": [suffix("", "다")], "w": [whole("ab", "c")]})
    texts = [f.text for f in r.closure("ab", max_depth=1)]
    assert texts == ["ab", "다", "c"]


def brute_closure(rules, word, most):
    """Forms and flags that any rules lead to, level by level, in at most so many rewrites; and whether that is all."""
    seen, level = {(word, 0)}, {(word, 0)}
    for _ in range(most):
        made = set()
        for text, flags in level:
            for r in (r for rs in rules.transforms.values() for r in rs):
                if flags and not flags & rules.flags_of(r.inner):
                    continue
                if r.kind == "suffix" and text.endswith(r.inflected):
                    new = text[: len(text) - len(r.inflected)] + r.base if r.inflected else r.base
                elif r.kind == "prefix" and text.startswith(r.inflected):
                    new = r.base + text[len(r.inflected) :]
                elif r.kind == "whole" and text == r.inflected:
                    new = r.base
                elif r.kind == "rewrite":
                    new = r.base(text)
                    if new is None:
                        continue
                elif r.kind == "around":
                    (a, b), (c, d) = r.inflected.split(BETWEEN), r.base.split(BETWEEN)
                    middle = text[len(a) : len(text) - len(b)]
                    if text != a + middle + b or not re.fullmatch(r.stem or ".*", middle, re.DOTALL):
                        continue
                    new = c + (re.sub(f"^{r.stem}$", r.stem_base, middle) if r.stem_base else middle) + d
                elif r.kind in ("pattern", "everywhere") and re.search(r.inflected, text, re.ASCII):
                    new = re.sub(r.inflected, r.base, text, count=int(r.kind == "pattern"), flags=re.ASCII)
                else:
                    continue
                made.add((new, rules.flags_of(r.outer)))
        level = made - seen
        seen |= level
    return seen, not level


@pytest.mark.parametrize(("language", "words"), [("tl", [w for w, *_ in TAGALOG]), ("ar", [w for w, *_ in ARABIC][:12]), ("ko", [letters_of(w) for w, *_ in KOREAN][:20]), ("ja", [w for w, *_ in JAPANESE][:30])])
def test_closures_are_brute_forces(language, words):
    rules = rule_set(language)
    for w in words:
        forms, done = brute_closure(rules, w, MAX_DEPTH)
        assert done and {(f.text, f.flags) for f in rules.closure(w)} == forms, w


@pytest.mark.parametrize(
    ("language", "text", "expected", "ends"),
    [
        ("es", "Ella piensa, puede y pidió; pienso canciones.", {("piensa", "pensar"), ("puede", "poder"), ("pidió", "pedir"), ("canciones", "canción")}, True),
        ("fr", "Nous parlons des chevaux", {("parlons", "parler"), ("chevaux", "cheval")}, False),  # "des" gains letters with each rewrite
        ("de", "aufgemacht gekeitkeit unklarheit", {("aufgemacht", "aufmachen")}, True),
    ],
)
def test_whole_closures_are_brute_forces(spark, tmp_path, language, text, expected, ends):
    from glossaria.plans.queries import QUERIES

    spark.createDataFrame([(1, text, language), (2, None, language), (3, "walked", "en")], "doc_id long, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    found = {}
    for r in QUERIES[f"deinflect_closure_{language}"](spark, str(tmp_path)).collect():
        found.setdefault(r["text"], set()).add((r["base"], r["flags"]))
    forms = {w: brute_closure(rule_set(language), w, MAX_DEPTH) for w in re.findall("[a-zà-ÿßœ]+", text.lower())}
    assert found == {w: f for w, (f, _) in forms.items()}
    assert all(done for _, done in forms.values()) == ends
    assert expected <= {(w, b) for w, f in found.items() for b, _ in f}


def test_japanese_closure_of_words_in_kana(spark, tmp_path):
    from glossaria.functions.kana import romaji_to_hiragana
    from glossaria.plans.queries import QUERIES

    spark.createDataFrame([(1, "Tabeta, tabenai to kaite hashiru", "en"), (2, None, "en"), (3, "yonda", "de")], "doc_id long, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    found = {}
    for r in QUERIES["deinflect_ja"](spark, str(tmp_path)).collect():
        found.setdefault(r["text"], set()).add((r["base"], r["flags"]))
    words = {romaji_to_hiragana(w) for w in ("tabeta", "tabenai", "to", "kaite", "hashiru")}
    assert found == {w: brute_closure(rule_set("ja"), w, MAX_DEPTH)[0] for w in words}
    assert any(b == "たべる" for b, _ in found["たべた"]) and any(b == "かく" for b, _ in found["かいて"])

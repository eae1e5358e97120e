import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from glossaria.functions import columns as C
from glossaria.operators import lookup, metadata, segment
from glossaria.operators.deinflect import closure_of
from glossaria.sources import archive
from glossaria.sources.catalog import Catalog, enabled_map, updates
from glossaria.streaming.lookup import stream_lookup

TERM = "dictionary string, id long, expression string, reading string, rules array<string>, score double, sequence long, definitions array<string>, definition_tags array<string>, term_tags array<string>"


def write_archive(path, title, files, **index):
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("index.json", json.dumps({"title": title, "revision": "1", "format": 3} | index))
        for name, content in files.items():
            z.writestr(name, content if isinstance(content, bytes) else json.dumps(content, ensure_ascii=False))


@pytest.fixture()
def terms(spark):
    return spark.createDataFrame(
        [
            ("A", 1, "食べる", "たべる", ["v1"], 10.0, 1, ["to eat"], ["v1"], ["common"]), ("A", 2, "猫", "ねこ", ["n"], 5.0, 2, ["cat"], ["n"], []), ("A", 3, "見る", "みる", ["v1"], 8.0, 3, ["to see"], ["v1"], []),
            ("B", 4, "食べる", "たべる", ["v1"], 7.0, 1, ["eat"], ["v1"], []), ("B", 5, "食う", "くう", ["v5"], 3.0, 1, ["eat, rough"], ["v5"], []), ("B", 6, "たべる", "たべる", ["n"], 1.0, -1, ["not a verb"], ["n"], []),
        ],
        TERM,
    )


def rows(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()))


def test_inflected_lookup_groups_over_dictionaries(spark, terms):
    asked = spark.createDataFrame([("q", "食べた！")], "query_id string, text string")
    found = lookup.find_terms(asked, terms, enabled_map(spark, ["A", "B"]), "ja").where("rank = 1").first()
    assert [(h["expression"], h["reading"]) for h in found["headwords"]] == [("食べる", "たべる")]
    assert [d["id"] for d in found["definitions"]] == [1, 4]
    assert (found["max_length"], found["score"], found["chains"]) == (3, 10.0, [("algorithm", ["-た"])])
    assert (found["exact"], found["text_chain_length"], found["chain_length"]) == (1, 0, 1)


def test_part_of_speech_filter_drops_nouns_for_inflected_forms(spark, terms):
    asked = spark.createDataFrame([("q", "たべた")], "query_id string, text string")
    strict = lookup.find_terms(asked, terms, enabled_map(spark, ["A", "B"]), "ja", mode="simple")
    loose = lookup.find_terms(asked, terms, enabled_map(spark, ["A", "B"], pos_filter=False), "ja", mode="simple")
    ids = lambda df: {r["id"] for r in df.select(F.explode("definitions.id").alias("id")).collect()}
    assert 6 not in ids(strict)
    assert 6 in ids(loose)
    assert {1, 4} <= ids(strict)


def test_exact_prefix_suffix(spark, terms):
    items = spark.createDataFrame([("食べる",), ("たべる",), ("食",), ("る",)], "text string")
    assert rows(lookup.exact_hits(items, terms), "text", "id", "match_source") == [("たべる", 1, "reading"), ("たべる", 4, "reading"), ("たべる", 6, "term"), ("食べる", 1, "term"), ("食べる", 4, "term")]
    assert {r[1] for r in rows(lookup.prefix_hits(items, terms), "text", "id") if r[0] == "食"} == {1, 4, 5}
    assert {(r[1], r[2]) for r in rows(lookup.suffix_hits(items, terms), "text", "id", "match_type") if r[0] == "る"} == {(1, "suffix"), (3, "suffix"), (4, "suffix"), (6, "suffix")}
    assert lookup.prefix_hits(items.limit(0), terms).count() == 0


def test_merge_redirect_exclude_and_frequency_order(spark, terms):
    asked = spark.createDataFrame([("q", "食べる")], "query_id string, text string")
    on = enabled_map(spark, ["A", "B"])
    own = lookup.entries(lookup.candidates(asked, "ja"), lookup.slim(terms, on), "ja")
    assert rows(lookup.related_by_sequence(own, terms, "B"), "id") == [(5,)]
    assert rows(lookup.related_by_headword(own.where("dictionary = 'A'"), terms), "id") == [(4,)]
    groups = lookup.grouped(own)
    assert all(d["dictionary"] == "B" for r in lookup.without_dictionaries(groups, ["A"]).collect() for d in r["definitions"])
    freq = spark.createDataFrame([("食べる", "たべる", 7.0, 0), ("食べる", "たべる", 42.0, 1)], "expression string, reading string, frequency double, ord int")
    assert {r["frequency_order"] for r in lookup.frequency_order(groups, freq).where("headwords[0].expression = '食べる'").collect()} == {42.0}


def find(spark, terms, text, titles=("A", "B"), language="ja", **options):
    asked = spark.createDataFrame([("q", text)], "query_id string, text string")
    return lookup.find_terms(asked, terms, enabled_map(spark, list(titles)), language, **options).orderBy("rank").collect()


def test_redirects_are_followed_once_and_are_no_entries(spark, terms):
    more = spark.createDataFrame([("B", 7, "喰べる", "たべる", ["v1"], 1.0, -1, ['["食べる", ["old"]]', "an old spelling"], [], []), ("B", 8, "くいた", "", [], 1.0, -1, ['["喰べる",["x","y"]]'], [], [])], TERM)
    found = find(spark, terms.unionByName(more), "喰べた", mode="simple")
    assert {d["id"]: [tuple(c) for c in r["chains"]] for r in found for d in r["definitions"]} == {1: [("both", ["-た", "old"])], 4: [("both", ["-た", "old"])], 7: [("algorithm", ["-た"])]}
    assert [d["definitions"] for r in found for d in r["definitions"] if d["id"] == 7] == [["an old spelling"]]
    assert {r["exact"] for r in found} == {1}
    once = find(spark, terms.unionByName(more), "くいた", mode="simple")
    assert [(d["id"], r["chains"][0]["source"], r["chains"][0]["rules"]) for r in once for d in r["definitions"] if d["id"] == 7] == [(7, "dictionary", ["x", "y"])]
    assert not {d["id"] for r in once for d in r["definitions"]} & {1, 4, 8}


def test_exact_counts_and_reading_order(spark, terms):
    by_reading = find(spark, terms, "たべる", mode="simple")
    assert {d["id"]: r["exact"] for r in by_reading for d in r["definitions"]} == {1: 0, 4: 0, 6: 1}
    assert [d["id"] for r in by_reading for d in r["definitions"]] == [6, 1, 4]
    grouped = find(spark, terms, "たべる")
    assert [(r["headwords"][0]["expression"], r["exact"]) for r in grouped] == [("たべる", 1), ("食べる", 0)]
    more = spark.createDataFrame([("A", 9, "食べる", "はべる", ["v1"], 99.0, 9, ["rare reading"], [], [])], TERM)
    assert find(spark, terms.unionByName(more), "食べる")[0]["headwords"][0]["reading"] == "はべる"
    assert find(spark, terms.unionByName(more), "食べる", primary_reading="たべる")[0]["headwords"][0]["reading"] == "たべる"
    assert [h["reading"] for h in find(spark, terms.unionByName(more), "食べる", mode="term")[0]["headwords"]] == ["たべる", "はべる"]


def test_processors_give_chains_and_rank(spark):
    words = spark.createDataFrame([("A", 1, "polish", "", [], 0.0, -1, ["make bright"], [], []), ("A", 2, "Polish", "", [], 0.0, -1, ["of Poland"], [], [])], TERM)
    found = find(spark, words, "Polish", ("A",), "pt")
    assert [(r["definitions"][0]["id"], r["text_chain_length"], r["text_chains"]) for r in found] == [(2, 0, [[], ["decapitalize", "capitalizeFirstLetter"]]), (1, 1, [["decapitalize"]])]
    swapped = find(spark, words, "p0lish", ("A",), "pt", replacements=((("0", "o"),),))
    assert swapped[0]["text_chains"] == [["Text Replacement 0"]]
    assert find(spark, words, "polishes", ("A",), "pt", deinflect=False) == []


def test_merge_mode(spark, terms):
    """Entries of the main dictionary are joined by sequence, with what other dictionaries say of their headwords."""
    more = spark.createDataFrame([("C", 10, "食う", "くう", ["v5"], 2.0, -1, ["to devour"], ["v5"], []), ("C", 11, "食べる", "たべる", ["v1"], 2.0, -1, ["eat"], ["v1"], []), ("B", 12, "食べる", "たべる", ["v1"], 6.0, 1, ["eat"], ["v1"], [])], TERM)
    found = find(spark, terms.unionByName(more), "食べた", ("B", "A", "C"), mode="merge", main_dictionary="B")
    assert len(found) == 1
    assert [(h["expression"], len(h["sources"])) for h in found[0]["headwords"]] == [("食べる", 1), ("食う", 1)]
    definitions = {(d["dictionary"], d["definitions"][0]): (d["id"], d["headword_indices"], d["primary"], d["sequences"]) for d in found[0]["definitions"]}
    assert definitions == {("A", "to eat"): (1, [0], True, [1]), ("B", "eat"): (4, [0], True, [1]), ("B", "eat, rough"): (5, [1], False, [1]), ("C", "to devour"): (10, [1], False, [-1]), ("C", "eat"): (11, [0], True, [-1])}
    assert (found[0]["score"], found[0]["max_length"], found[0]["exact"]) == (10.0, 3, 1)
    assert [d["dictionary"] for d in found[0]["definitions"]] == ["B", "B", "A", "C", "C"]


def test_metadata_of_headwords_and_excluded_dictionaries(spark, terms):
    meta = spark.createDataFrame([("A", 1, "食べる", "freq", "42", None), ("B", 2, "食べる", "freq", '{"reading": "たべる", "frequency": {"value": 7, "displayValue": "7th"}}', "たべる"), ("B", 3, "食べる", "freq", '{"reading": "x", "frequency": 1}', "x"), ("A", 4, "食べる", "pitch", '{"reading": "たべる", "pitches": [{"position": 2}]}', "たべる"), ("C", 5, "食べる", "freq", "1", None), ("B", 6, "食べる", "ipa", '{"reading": "たべる", "transcriptions": []}', "たべる")], "dictionary string, id long, expression string, mode string, data string, meta_reading string")
    first = find(spark, terms, "食べる", meta=meta)[0]
    assert [(f["headword_index"], f["dictionary"], f["has_reading"], f["frequency"], f["display"]) for f in first["frequencies"]] == [(0, "A", False, 42.0, None), (0, "B", True, 7.0, "7th")]
    assert [(p["dictionary"], p["mode"]) for p in first["pronunciations"]] == [("A", "pitch"), ("B", "ipa")]
    left = find(spark, terms, "食べる", meta=meta, excluded=["A"])[0]
    assert {d["dictionary"] for d in left["definitions"]} == {"B"} and [f["dictionary"] for f in left["frequencies"]] == ["B"] and [p["mode"] for p in left["pronunciations"]] == ["ipa"]
    asked = spark.createDataFrame([("q", "食べる")], "query_id string, text string")
    groups = lookup.find_terms(asked, terms, enabled_map(spark, ["A", "B"]), "ja", meta=meta)
    after = lookup.without_dictionaries(groups, ["A"]).orderBy("rank").first()
    assert [f["dictionary"] for f in after["frequencies"]] == ["B"] and [p["headword_index"] for p in after["pronunciations"]] == [0]
    assert find(spark, terms, "猫", meta=meta)[0]["frequencies"] == []


def test_batch_lookup_keeps_misses_and_nulls(spark, terms):
    texts = spark.createDataFrame([("猫",), ("猫",), ("xyz",), (None,)], "text string")
    found = lookup.batch_lookup(texts, terms, enabled_map(spark, ["A"]), language="ja")
    assert sorted((r["text"] or "", r["rank"]) for r in found.collect()) == [("", None), ("xyz", None), ("猫", 1), ("猫", 1)]


def test_segments_chain_longest_matches(spark):
    known = spark.createDataFrame([(t,) for t in ("ボス", "に", "会わせて", "くれ", "会わ", "ab")], "text string")
    texts = spark.createDataFrame([(1, "ボスに会わせてくれ\nx、。！y\n"), (2, ""), (3, None)], "text_id int, text string")
    found = segment.parse_text(texts, known).orderBy("text_id", "line_no", "seg_no").collect()
    assert [(r["text"], r["matched"]) for r in found if r["text_id"] == 1] == [("ボス", True), ("に", True), ("会わせて", True), ("くれ", True), ("x、。！y", False)]
    assert not [r for r in found if r["text_id"] != 1]


def test_parse_rewrites_and_reads(spark, terms):
    texts = spark.createDataFrame([(1, "食べた、猫\n見る猫x"), (2, None), (3, "")], "text_id int, text string")
    found = segment.parse(texts, terms, enabled_map(spark, ["A", "B"]), "ja", 10).orderBy("text_id", "line_no", "seg_no").collect()
    assert [(r["line_no"], r["text"], r["reading"]) for r in found] == [(0, "食べた", "たべる"), (0, "、", ""), (0, "猫", "ねこ"), (1, "見る", "みる"), (1, "猫", "ねこ"), (1, "x", "")]
    assert [tuple(h) for h in found[0]["headwords"]] == [("食べる", "たべる")] * 2 and found[1]["headwords"] is None


@pytest.mark.parametrize(
    ("term", "reading", "source", "parts"),
    [("食べる", "たべる", "食べた", [("食", "た"), ("べた", "")]), ("食べる", "たべる", "たべた", [("たべた", "")]), ("見る", "みる", "見ない", [("見", "み"), ("ない", "")]), ("猫", "ねこ", "犬", [("犬", "")])],
)
def test_furigana_of_inflected_forms(term, reading, source, parts):
    assert [(p["text"], p["reading"]) for p in segment.furigana_inflected(term, reading, source)] == parts


@pytest.mark.parametrize(
    ("term", "reading", "parts"),
    [("食べる", "たべる", [("食", "た"), ("べる", "")]), ("猫", "ねこ", [("猫", "ねこ")]), ("お金", "おかね", [("お", ""), ("金", "かね")]), ("ねこ", "ねこ", [("ねこ", "")]), ("好き嫌い", "すききらい", [("好き嫌い", "すききらい")]), ("取り引き", "とりひき", [("取", "と"), ("り", ""), ("引", "ひ"), ("き", "")])],
)
def test_furigana(term, reading, parts):
    found = [(p["text"], p["reading"]) for p in segment.furigana(term, reading)]
    assert found == parts


def test_with_furigana_on_spark(spark):
    df = spark.createDataFrame([("食べる", "たべる"), (None, None)], "expression string, reading string")
    got = segment.with_furigana(df.where("expression is not null")).first()["furigana"]
    assert [(p["text"], p["reading"]) for p in got] == [("食", "た"), ("べる", "")]


def test_scalar_columns(spark):
    one = spark.range(1)
    val = lambda c: one.select(c.alias("x")).first()["x"]
    assert val(C.to_number(F.lit("about -1.5e2 times"))) == -150.0
    assert val(C.to_number(F.lit("none"))) == 0.0
    assert val(C.split_field(F.lit("a  b"))) == ["a", "", "b"]
    assert val(C.split_field(F.lit(""))) == []
    assert val(C.later_revision(F.lit("1.9"), F.lit("1.10"))) is True
    assert val(C.later_revision(F.lit("rev9"), F.lit("rev10"))) is False
    assert val(C.kana_morae(F.lit("きゃっと"))) == ["きゃ", "っ", "と"]
    assert val(C.downsteps(F.lit("LHHL"))) == [3]
    assert val(C.kebab_case(F.lit("Hello  World_x!"))) == "hello-world-x"
    assert val(C.script_head(F.lit("食べたabc"))) == "食べた"
    assert val(C.lookup_prefixes(F.lit("abc"))) == ["abc", "ab", "a"]
    assert val(C.lookup_prefixes(F.lit(""))) == []
    assert tuple(val(C.cloze(F.lit("I eat it"), F.lit("eat"), F.lit(2)))) == ("I ", "eat", " it")
    assert val(C.eszett_variants(F.lit("Straße"))) == ["Straße", "Strasse"]


def test_metadata(spark):
    meta = spark.createDataFrame([("A", "食べる", 42.0), ("A", "食べる", 10.0), ("B", "食べる", 0.0), ("C", "食べる", 30.0)], "dictionary string, expression string, frequency double")
    assert tuple(metadata.frequency_ranking(meta, ["expression"]).first()) == ("食べる", 3, 15)
    assert metadata.display_harmonic(meta, ["expression"]).first()["harmonic"] == int(4 / (1 / 42 + 1 / 10 + 1 / 30) + 0.5)
    data = spark.createDataFrame([("12",), ('{"value": 5, "displayValue": "five"}',), ('{"reading": "x", "frequency": {"value": 7}}',), ('"about 9"',)], "data string")
    assert [tuple(r["f"]) for r in data.select(metadata.frequency_value(F.col("data")).alias("f")).collect()] == [(12.0, None), (5.0, "five"), (7.0, None), (9.0, "about 9")]
    heads = spark.createDataFrame([("見る", "みる"), ("見る", "みえる")], "expression string, reading string")
    terms_meta = spark.createDataFrame([("見る", "freq", "みる"), ("見る", "freq", None), ("見る", "pitch", None)], "expression string, mode string, meta_reading string")
    assert metadata.with_term_meta(heads, terms_meta).count() == 3
    tags = spark.createDataFrame([("A", 1, "v1", "partOfSpeech", 3, 1, "verb")], "dictionary string, tag_id int, name string, category string, order int, score int, notes string")
    named = spark.createDataFrame([("A", "v1:x"), ("A", "zz")], "dictionary string, tag string")
    assert rows(metadata.with_tags(named, tags), "tag", "category", "order") == [("v1:x", "partOfSpeech", 3), ("zz", "default", 0)]


def test_catalog_round_trip(spark, tmp_path):
    term = [["食べる", "たべる", "v1", "v1", 10, ["to eat", {"type": "image", "path": "a.png"}], 1, "common"], ["猫", "", None, "n", 5, ["cat"], 2, ""]]
    zips = tmp_path / "zips"
    zips.mkdir()
    write_archive(zips / "a.zip", "A", {"term_bank_1.json": term, "term_meta_bank_1.json": [["食べる", "freq", {"reading": "たべる", "frequency": 42}]], "tag_bank_1.json": [["v1", "partOfSpeech", 1, "verb", 0]], "kanji_bank_1.json": [["食", "ショク", "た.べる", "", ["eat"], {"strokes": "9"}]], "a.png": b"png"})
    cat = Catalog(spark, str(tmp_path / "cat"))
    done = cat.import_archive(str(zips / "a.zip"))
    assert done["success"] and done["counts"]["terms"] == 2 and done["counts"]["media"] == 1 and done["counts"]["term_meta.freq"] == 1
    assert rows(cat.table("terms"), "expression", "reading", "reading_reverse") == [("猫", "猫", "猫"), ("食べる", "たべる", "るべた")]
    assert rows(cat.counts(), "dictionary", "terms", "kanji") == [("A", 2, 1)]
    with pytest.raises(archive.ArchiveError, match="already"):
        cat.import_archive(str(zips / "a.zip"))
    write_archive(zips / "b.zip", "B", {"term_bank_1.json": [["x", "", "", "", 0, [{"type": "image", "path": "missing.png"}], 1, ""]]})
    assert cat.import_archive(str(zips / "b.zip"))["success"] is False
    cat.delete("A")
    assert rows(cat.info(), "title", "import_success") == [("B", False)]
    assert rows(cat.table("terms"), "expression") == [("x",)]
    cat.purge()
    assert cat.info().count() == 0


def test_bad_archives(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "n.zip", "w") as z:
        z.writestr("term_bank_1.json", "[]")
    with pytest.raises(archive.ArchiveError, match="No dictionary index"):
        archive.read_index((tmp_path / "n.zip").read_bytes())
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("index.json", json.dumps({"title": "x"}))
    with pytest.raises(archive.ArchiveError, match="Invalid dictionary index"):
        archive.read_index(out.getvalue())
    write_archive(tmp_path / "w.zip", "W", {"term_bank_1.json": [["a", "b"]]})
    with pytest.raises(archive.ArchiveError, match="number of values"):
        Catalog(spark, str(tmp_path / "c")).import_archive(str(tmp_path / "w.zip"))


def test_old_archives_and_kinds_of_values(spark, tmp_path):
    tag_meta = {"P": {"category": "popular", "order": 2, "notes": "popular", "score": 1}}
    write_archive(tmp_path / "o.zip", "O", {"term_bank_1.json": [["猫", "ねこ", "n", "", 1, "cat", "kitty"]], "tag_bank_1.json": [["n", "partOfSpeech", 1, "noun", 0]]}, format=1, tagMeta=tag_meta)
    cat = Catalog(spark, str(tmp_path / "c"))
    assert cat.import_archive(str(tmp_path / "o.zip"))["counts"]["tag_meta"] == 2
    assert rows(cat.table("tag_meta"), "name", "category", "order") == [("P", "popular", 2.0), ("n", "partOfSpeech", 1.0)]
    assert cat.table("terms").first()["definitions"] == ["cat", "kitty"]
    for name, bank, index, reason in (("short", {"term_bank_1.json": [["a", "b", "", 1]]}, {"format": 1}, "number of values"), ("text", {"term_bank_1.json": [["a", "b", "", "", "high", ["x"], 1, ""]]}, {}, "kind of value"), ("plain", {"term_bank_1.json": [["a", "b", "", "", 1, "x", 1, ""]]}, {}, "kind of value")):
        write_archive(tmp_path / f"{name}.zip", name, bank, **index)
        with pytest.raises(archive.ArchiveError, match=reason):
            cat.import_archive(str(tmp_path / f"{name}.zip"))


def test_many_rows_import(spark, tmp_path):
    write_archive(tmp_path / "m.zip", "M", {f"term_bank_{k}.json": [[f"単語{n}", "", "", "", 0, ["x"], n, ""] for n in range(k * 1000, min(k * 1000 + 1000, 2001))] for k in (0, 1, 2)})
    cat = Catalog(spark, str(tmp_path / "c"))
    assert cat.import_archive(str(tmp_path / "m.zip"))["counts"]["terms"] == 2001
    assert cat.table("terms").where("expression = '単語1000'").count() == 1


def test_updates(spark):
    installed = spark.createDataFrame([("A", "1.2", "u"), ("B", "2", "v"), ("C", "1", None)], "title string, revision string, index_url string")
    remote = spark.createDataFrame([("u", "1.10"), ("v", "2")], "index_url string, revision string")
    assert rows(updates(installed, remote), "title", "has_update") == [("A", True), ("B", False), ("C", False)]


def test_closure_of_distinct_texts_and_unknown_languages(spark):
    texts = spark.createDataFrame([("walked",), ("walked",), (None,)], "text string")
    assert {r["base"] for r in closure_of(texts, "en").collect()} == {"walked", "walk", "walke"}
    assert [r["base"] for r in closure_of(texts, "xx").collect()] == ["walked"]


def test_stream_lookup(spark, terms, tmp_path):
    texts = spark.createDataFrame([("猫 と 猫",), ("なし",)], "text string")
    texts.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(texts.schema).parquet(str(tmp_path / "in"))
    q = stream_lookup(stream, terms).writeStream.format("memory").queryName("hits").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert [r["id"] for r in spark.table("hits").collect()] == [2, 2]

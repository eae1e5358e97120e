"""Work that must not grow faster than the tables: where a plan does it, and that it does all of it."""

from pyspark.sql import functions as F

from glossaria.operators import glossary, lookup, segment
from glossaria.plans import derived
from glossaria.plans.queries import QUERIES
from glossaria.sources.catalog import enabled_map

SMALL = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString().splitlines()


def test_words_are_spelled_after_they_are_distinct(spark):
    plan = plan_of(QUERIES["deinflect_ja"](spark, SMALL))
    python = [k for k, line in enumerate(plan) if "romaji_to_hiragana" in line and "EvalPython" in line]
    tokens = next(k for k, line in enumerate(plan) if "Generate" in line)
    assert len(python) == 1 and any("Aggregate" in line for line in plan[python[0] + 1 : tokens])
    assert any("RepartitionByExpression" in line for line in plan)


def test_words_are_counted_before_they_are_dealt(spark):
    docs = [(1, "a1", "Cat catKat dog"), (2, "a1", "cat İx"), (None, "a1", "cat bird"), (3, "b2", None), (3, "b2", "")]
    own = spark.createDataFrame(docs, "doc_id long, dictionary string, text string")
    assert all("doc_id" not in line for line in derived.counted_words(own.where("doc_id < 3"))._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange" in line)
    want = {("a1", "cat", 2, 4), ("a1", "at", 1, 1), ("a1", "dog", 1, 1), ("a1", "x", 1, 1), ("a1", "bird", 0, 1)}
    assert {tuple(r) for r in derived.counted_words(own).collect()} == want
    once = own.where("doc_id IS NULL OR doc_id < 3")
    assert {tuple(r) for r in derived.counted_words(once).collect()} == want
    again = own.unionByName(own)
    assert {tuple(r) for r in derived.counted_words(again).collect()} == {(d, e, s, 2 * f) for d, e, s, f in want}


def test_prefixes_are_looked_up_once_for_all_texts(spark, monkeypatch):
    kinds = "dictionary string, id string, expression string, reading string, rules array<string>, score long, sequence long, definitions array<string>, definition_tags array<string>, term_tags array<string>"
    heads = [("na", "n"), ("N", "na"), ("Nay", "ny"), ("nay", None), ("ny", "Nay"), ("nya", ""), ("y", "nyan")]
    terms = spark.createDataFrame([(d, f"{d}{k}", e, r, ["n"], k % 3, k, [f"{k % 2}"], ["t"], ["u"]) for k, (e, r) in enumerate(heads) for d in ("a", "b")], kinds)
    asked = spark.createDataFrame([(1, "nay"), (2, "nayx"), (3, "Nyan"), (4, "nyan"), (5, ""), (6, None)], "query_id int, text string")
    seen, own = [], lookup.entries
    monkeypatch.setattr(lookup, "entries", lambda found, *more: seen.append(found.select("query_id", "original_text").distinct().count()) or own(found, *more))
    for mode in ("group",):
        run = lambda **more: sorted(map(repr, lookup.find_terms(asked, terms, enabled_map(spark, ["a", "b"]), "pt", mode, **more).select("query_id", "rank", "ord", "max_length", "exact", "headwords", "definitions", "chains", "text_chains").collect()))  # noqa: B023, E731
        assert run() == run(redirects=True)  # terms that may redirect are met for each text
    assert seen == [4 + 4 + 3, 3 + 4 + 4 + 4]


KINDS = "dictionary string, id string, expression string, reading string, rules array<string>, score long, sequence long, definitions array<string>, definition_tags array<string>, term_tags array<string>"


def small_terms(spark):
    words = ("t", "te", "tea", "teas", "ted", "walk", "walked", "any", "ny", "n", "run", "runs")
    rows = []
    for d in "ab":
        for k, w in enumerate(words):
            reading = "".join(c for c in w if c not in ("aeiouy" if d == "b" else "aeiou")) or w
            rows.append((d, f"{d}/{w}", w, reading if k % 5 else None, ["v"] if w in ("walk", "run", "ted") else ["n"], k % 3, len(w) * 10 + len(reading) if k % 7 else -1, [f"{k % 3}"], ["x"], ["u"]))
    return spark.createDataFrame(rows, KINDS)


def test_every_grouping_goes_by_prefix(spark, monkeypatch):
    asked = spark.createDataFrame([(1, "teds"), (2, "walked"), (3, "Anyx"), (4, "nyx"), (5, "runs"), (6, "")], "query_id int, text string")
    terms, on, own = small_terms(spark), enabled_map(spark, ["a", "b"]), lookup.candidates
    for mode, longest in (("group", False), ("term", False), ("merge", False), ("simple", True)):
        calls = []
        monkeypatch.setattr(lookup, "candidates", lambda *a, calls=calls, **k: calls.append(1) or own(*a, **k))
        run = lambda **more: lookup.find_terms(asked, terms, on, "en", mode, main_dictionary="b", longest=longest, **more)  # noqa: B023, E731
        by_prefix = run()
        assert not calls  # no text's candidates are met as a whole
        columns = sorted(by_prefix.columns)
        rows = sorted(map(repr, by_prefix.select(columns).collect()))
        assert rows and rows == sorted(map(repr, run(redirects=True).select(columns).collect())) and calls == [1]


def test_windows_are_looked_up_by_what_they_reach(spark, monkeypatch):
    seen, own = [], segment.find_terms
    monkeypatch.setattr(segment, "find_terms", lambda texts, *a, **k: seen.extend(r["text"] for r in texts.collect()) or own(texts, *a, **k))
    texts = spark.createDataFrame([(1, "walk runs zq"), (2, "walk teas"), (3, "")], "text_id int, text string")
    found = segment.parse(texts, small_terms(spark), enabled_map(spark, ["a", "b"]), "pt").where("matched").collect()
    assert sorted((r["text_id"], r["text"], r["reading"]) for r in found) == [(1, "runs", "rns"), (1, "walk", "walk"), (2, "teas", "ts"), (2, "walk", "walk")]
    assert {"walk", "runs", "teas"} <= set(seen) and len(seen) == len(set(seen)) and max(map(len, seen)) == 4


def test_what_distinct_texts_find_is_not_dealt_again(spark):
    terms, on = small_terms(spark), enabled_map(spark, ["a", "b"])
    texts = spark.createDataFrame([("walked",), ("zq",), ("",), (None,)], "text string")
    found = lookup.batch_lookup(texts, terms, on, language="en", definitions=False)
    assert "LeftOuter" not in found._jdf.queryExecution().optimizedPlan().toString()
    again = lookup.batch_lookup(texts.withColumn("n", F.lit(1)), terms, on, language="en", definitions=False).drop("n")
    rows = lambda df: sorted(map(repr, df.select(sorted(df.columns)).collect()))
    assert rows(found) == rows(again) and {r["text"] for r in found.where("rank IS NULL").collect()} == {"zq", "", None}


def test_definitions_are_folded_in_their_rows(spark, monkeypatch):
    seen, own = [], glossary.written
    monkeypatch.setattr(glossary, "written", lambda df: seen.append(df) or own(df))
    found = QUERIES["glossary_plain"](spark, SMALL)
    assert len(seen) == 1 and not any("Join" in line or "Aggregate" in line for line in plan_of(found))
    assert len(QUERIES["glossary_images"](spark, SMALL).columns) == 3 and len(seen) == 2


def test_sets_of_readings_read_the_texts_once(spark):
    assert not any("text" in line for line in plan_of(QUERIES["disambiguation_sets"](spark, SMALL)))

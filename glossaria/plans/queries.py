"""Registered queries: each applies the library's operators to whole tables, with the same question in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from glossaria.functions import columns as C
from glossaria.functions.kana import romaji_to_hiragana
from glossaria.functions.processors import text_variants
from glossaria.functions.rule_sets import rule_set
from glossaria.operators import glossary, lookup, metadata, segment
from glossaria.operators.kanji import find_kanji
from glossaria.operators.deinflect import closure_of, one_step, suffix_rules
from glossaria.plans.derived import BENCHMARK_SQL, TAGS, TAGS_SQL, TERMS_SQL, benchmark_words, distinct_words, reading, table, terms, words
from glossaria.sources.catalog import dictionary_counts, enabled_map
from glossaria.sources.scratch import written

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = sql
        return fn

    return register


@query(f"WITH {TERMS_SQL}, {BENCHMARK_SQL} SELECT item_id, word, ord, id, 'term' AS match_source FROM bw JOIN terms ON word = expression UNION ALL SELECT item_id, word, ord, id, 'reading' FROM bw JOIN terms ON word = reading AND reading <> expression")
def lookup_exact(spark, sf_dir):
    found = lookup.exact_hits(benchmark_words(spark, sf_dir), terms(spark, sf_dir), "word")
    return found.select("item_id", "word", "ord", "id", "match_source")


@query(f"WITH {TERMS_SQL}, {BENCHMARK_SQL}, heads AS (SELECT DISTINCT left(word, 5) AS head FROM bw) SELECT head, id, CASE WHEN head = expression THEN 'exact' ELSE 'prefix' END AS match_type FROM heads JOIN terms ON starts_with(expression, head)")
def lookup_prefix(spark, sf_dir):
    heads = benchmark_words(spark, sf_dir).select(F.left("word", F.lit(5)).alias("head")).distinct()
    return lookup.prefix_hits(heads, terms(spark, sf_dir), "head").select("head", "id", "match_type")


@query(f"WITH {TERMS_SQL}, {BENCHMARK_SQL}, tails AS (SELECT DISTINCT right(word, 5) AS tail FROM bw) SELECT tail, id, CASE WHEN tail = expression THEN 'exact' ELSE 'suffix' END AS match_type FROM tails JOIN terms ON ends_with(expression, tail)")
def lookup_suffix(spark, sf_dir):
    tails = benchmark_words(spark, sf_dir).select(F.right("word", F.lit(5)).alias("tail")).distinct()
    return lookup.suffix_hits(tails, terms(spark, sf_dir), "tail").select("tail", "id", "match_type")


@query(f"WITH {TERMS_SQL}, {BENCHMARK_SQL}, pairs AS (SELECT DISTINCT word AS expression, regexp_replace(word, '[aeiou]', '', 'g') AS reading FROM bw) SELECT expression, reading, id, score FROM pairs JOIN terms USING (expression, reading)")
def lookup_exact_pair(spark, sf_dir):
    pairs = benchmark_words(spark, sf_dir).select(F.col("word").alias("expression"), F.regexp_replace("word", "[aeiou]", "").alias("reading")).distinct()
    return lookup.exact_pairs(pairs, terms(spark, sf_dir)).select("expression", "reading", "id", "score")


@query(f"WITH {TERMS_SQL} SELECT sequence, dictionary, count(*) AS n, sum(score) AS score, min(expression) AS first FROM terms JOIN (SELECT DISTINCT sequence, dictionary FROM terms WHERE score >= 5) USING (sequence, dictionary) GROUP BY ALL")
def lookup_sequence(spark, sf_dir):
    own = terms(spark, sf_dir)
    seeds = own.where("score >= 5").select("sequence", "dictionary").distinct()
    met = lookup.by_sequence(seeds, own)
    return met.groupBy("sequence", "dictionary").agg(F.count("*").alias("n"), F.sum("score").alias("score"), F.min("expression").alias("first"))


@query(f"""WITH {TERMS_SQL}, {BENCHMARK_SQL}, hits AS (SELECT item_id, word, ord, id, 0 AS k FROM bw JOIN terms ON word = expression UNION ALL SELECT item_id, word, ord, id, 1 FROM bw JOIN terms ON word = reading AND reading <> expression)
SELECT item_id, id, word FROM hits QUALIFY row_number() OVER (PARTITION BY item_id, id ORDER BY ord, k) = 1""")
def dedupe_first_wins(spark, sf_dir):
    hits = lookup.exact_hits(benchmark_words(spark, sf_dir), terms(spark, sf_dir), "word").withColumn("k", (F.col("match_source") == "reading").cast("int"))
    return lookup.first_hit(hits, ["item_id", "id"], ["ord", "k"]).select("item_id", "id", "word")


@query(f"WITH {TERMS_SQL} SELECT id, expression, score FROM terms WHERE dictionary IN ('src1', 'src3', 'src5')")
def dict_filter_semi(spark, sf_dir):
    return lookup.enabled_only(terms(spark, sf_dir), enabled_map(spark, ["src1", "src3", "src5"])).select("id", "expression", "score")


def _pos_flags(column: str = "pos") -> str:
    return f"CASE {column} WHEN 'v' THEN 1 WHEN 'np' THEN 2 WHEN 'adv' THEN 16 WHEN 'n' THEN 6 ELSE 0 END"


@query(f"WITH {TERMS_SQL}, f(flags) AS (VALUES (0), (1), (2), (4), (8), (16)) SELECT flags, pos, count(*) AS n FROM terms, f WHERE flags = 0 OR (flags & ({_pos_flags()})) <> 0 GROUP BY ALL")
def pos_filter(spark, sf_dir):
    counted = terms(spark, sf_dir).groupBy("pos").agg(F.count("*").alias("n"))
    tried = counted.select("*", F.explode(F.array(*map(F.lit, (0, 1, 2, 4, 8, 16)))).alias("flags"))
    return tried.where(C.part_of_speech_passes(F.col("flags"), lookup.rule_flags(F.array("pos"), "en"))).select("flags", "pos", "n")


@query(f"WITH {BENCHMARK_SQL}, w AS (SELECT DISTINCT word FROM bw) SELECT word, left(word, k) AS prefix, length(word) - k AS ord FROM (SELECT word, unnest(range(1, length(word) + 1)) AS k FROM w)")
def prefix_enumeration(spark, sf_dir):
    own = benchmark_words(spark, sf_dir).select("word").distinct()
    return own.select("word", F.posexplode(C.lookup_prefixes(F.col("word"))).alias("ord", "prefix"))


def _affix_closure_sql(language: str, source: str, depth: int = 3) -> str:
    rules = rule_set(language)
    rows = [(r, rules.flags_of(r.inner), rules.flags_of(r.outer)) for rs in rules.transforms.values() for r in rs if r.kind in ("suffix", "prefix", "whole")]
    quote = lambda s: s.replace("'", "''")
    values = ", ".join(f"('{r.kind}', '{quote(r.inflected)}', '{quote(r.base)}', {i}, {o})" for r, i, o in rows)
    return f"""WITH RECURSIVE {source}, rules(kind, inflected, base, i, o) AS (VALUES {values}),
forms(word, text, flags, depth) AS (SELECT word, word, 0, 0 FROM src UNION ALL
  SELECT word, CASE kind WHEN 'suffix' THEN left(text, length(text) - length(inflected)) || base WHEN 'prefix' THEN base || substr(text, length(inflected) + 1) ELSE base END, o, depth + 1
  FROM forms JOIN rules ON CASE kind WHEN 'suffix' THEN ends_with(text, inflected) WHEN 'prefix' THEN starts_with(text, inflected) ELSE text = inflected END
  WHERE depth < {depth} AND (flags = 0 OR (flags & i) <> 0))
SELECT DISTINCT word, text, flags, depth FROM forms"""


def _lang_words(language: str) -> str:
    return f"src AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-zà-ÿßœ]+')) AS word FROM documents WHERE lang = '{language}')"


def _affix_closure(spark, sf_dir: str, language: str, depth: int = 3) -> DataFrame:
    """Rewrites by joins with the rule table, to a depth: what SQL can say of the closure."""
    docs = table(spark, sf_dir, "documents").where(F.col("lang") == language)
    own = docs.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("([a-zà-ÿßœ]+)"), F.lit(1))).alias("word")).distinct()
    rules = suffix_rules(spark, language)
    level = own.select("word", F.col("word").alias("text"), F.lit(0).alias("flags"), F.lit(0).alias("depth"))
    out = level
    for k in range(1, depth + 1):
        made = one_step(level, rules)
        level = made.select("word", F.col("made").alias("text"), F.col("made_flags").alias("flags"), F.lit(k).alias("depth")).distinct()
        out = out.unionByName(level)
    return out


def _register_closures() -> None:
    for language in ("en", "de", "es", "fr"):
        depth = 2 if language in ("es", "fr") else 3

        def run(spark, sf_dir, language=language, depth=depth):
            return _affix_closure(spark, sf_dir, language, depth)

        run.__name__ = f"deinflect_{language}"
        query(_affix_closure_sql(language, _lang_words(language), depth))(run)


_register_closures()


@query()
def deinflect_closure_en(spark, sf_dir):
    """The whole closure, with pattern rules and traces, of every English word."""
    own = table(spark, sf_dir, "documents").where("lang = 'en'").select(F.explode(words()).alias("text"))
    return closure_of(own, "en")


def _register_whole_closures() -> None:
    for language in ("es", "fr", "de"):

        def run(spark, sf_dir, language=language):
            docs = table(spark, sf_dir, "documents").where(F.col("lang") == language)
            return closure_of(docs.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("([a-zà-ÿßœ]+)"), F.lit(1))).alias("text")), language)

        run.__name__ = f"deinflect_closure_{language}"
        run.__doc__ = "The whole closure, with pattern rules and traces, of every word of the language."
        query()(run)


_register_whole_closures()


@query()
def deinflect_ja(spark, sf_dir):
    """The whole Japanese closure of each English word of the documents, spelled in kana: the tables have no Japanese text."""
    own = table(spark, sf_dir, "documents").where("lang = 'en'").select(F.explode(words()).alias("word")).distinct()
    spell = F.udf(romaji_to_hiragana, "string", useArrow=True).asNondeterministic()  # else a filter on what it gives would run it on each place of a word, before they are made distinct
    spelled = own.select(spell("word").alias("text"))
    return closure_of(spelled, "ja")


@query(f"WITH {BENCHMARK_SQL} SELECT DISTINCT word, unnest(list_distinct([word, lower(word), upper(left(word, 1)) || substr(word, 2)])) AS variant FROM bw")
def variants_case(spark, sf_dir):
    own = benchmark_words(spark, sf_dir).select("word").distinct()
    return own.select("word", F.explode(C.case_variants(F.col("word"))).alias("variant"))


@query("WITH w AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[A-Za-zäöüÄÖÜß]+')) AS word FROM documents WHERE lang = 'de') SELECT word, unnest(list_distinct([word, replace(word, 'ß', 'ss'), replace(word, 'ss', 'ß')])) AS variant FROM w")
def variants_eszett(spark, sf_dir):
    own = table(spark, sf_dir, "documents").where("lang = 'de'").select(F.explode(F.regexp_extract_all("text", F.lit("([A-Za-zäöüÄÖÜß]+)"), F.lit(1))).alias("word")).distinct()
    return own.select("word", F.explode(C.eszett_variants(F.col("word"))).alias("variant"))


@query("WITH w AS (SELECT DISTINCT unnest(string_split(text, ' ')) AS word FROM documents WHERE lang = 'fr') SELECT word, unnest(list_distinct([word, replace(word, '''', '’'), replace(word, '’', '''')])) AS variant FROM w")
def variants_apostrophe(spark, sf_dir):
    own = table(spark, sf_dir, "documents").where("lang = 'fr'").select(F.explode(F.split("text", " ")).alias("word")).distinct()
    return own.select("word", F.explode(C.apostrophe_variants(F.col("word"))).alias("variant"))


@query("WITH w AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-zà-ÿ]+')) AS word FROM documents WHERE lang IN ('fr', 'es', 'de')) SELECT word, translate(word, 'àáâãäåçèéêëìíîïñòóôõöùúûüýÿ', 'aaaaaaceeeeiiiinooooouuuuyy') AS plain FROM w")
def strip_diacritics(spark, sf_dir):
    own = table(spark, sf_dir, "documents").where("lang IN ('fr', 'es', 'de')").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("([a-zà-ÿ]+)"), F.lit(1))).alias("word")).distinct()
    return segment.diacritics_removed(own, "word", "plain").select("word", "plain")


@query(f"WITH {TERMS_SQL}, {BENCHMARK_SQL} SELECT item_id, expression, reading, max(score) AS score, count(*) AS definitions, min(dictionary) AS first_dictionary FROM bw JOIN terms ON word = expression GROUP BY ALL")
def group_headword(spark, sf_dir):
    met = benchmark_words(spark, sf_dir).join(terms(spark, sf_dir), F.col("word") == F.col("expression"))
    return met.groupBy("item_id", "expression", "reading").agg(F.max("score").alias("score"), F.count("*").alias("definitions"), F.min("dictionary").alias("first_dictionary"))


@query(f"WITH {TERMS_SQL} SELECT reading, list_sort(list(DISTINCT expression)) AS expressions, max(score) AS score, count(*) AS definitions FROM terms GROUP BY reading")
def group_term(spark, sf_dir):
    own = terms(spark, sf_dir)
    return own.groupBy("reading").agg(F.array_sort(F.collect_set("expression")).alias("expressions"), F.max("score").alias("score"), F.count("*").alias("definitions"))


@query(f"""WITH {TERMS_SQL}, {BENCHMARK_SQL}, e AS (SELECT item_id AS query_id, id, dictionary, sequence FROM bw JOIN terms ON word = expression),
s AS (SELECT DISTINCT query_id, sequence FROM e WHERE dictionary = 'src2' AND sequence >= 0)
SELECT s.query_id, t.id, t.score FROM s JOIN terms t ON s.sequence = t.sequence AND t.dictionary = 'src2' ANTI JOIN e ON e.query_id = s.query_id AND e.id = t.id""")
def merge_sequence(spark, sf_dir):
    own = terms(spark, sf_dir)
    rows = benchmark_words(spark, sf_dir).join(own, F.col("word") == F.col("expression")).withColumnRenamed("item_id", "query_id")
    return lookup.related_by_sequence(rows, own, "src2").select("query_id", "id", "score")


@query(f"""WITH {TERMS_SQL}, {BENCHMARK_SQL}, e AS (SELECT DISTINCT item_id AS query_id, id, expression, reading FROM bw JOIN terms ON word = expression WHERE dictionary = 'src2')
SELECT h.query_id, t.id FROM (SELECT DISTINCT query_id, expression, reading FROM e) h JOIN terms t USING (expression, reading) WHERE t.dictionary IN ('src2', 'src4') AND NOT EXISTS (SELECT 1 FROM e WHERE e.query_id = h.query_id AND e.id = t.id)""")
def merge_secondary(spark, sf_dir):
    own = terms(spark, sf_dir)
    rows = benchmark_words(spark, sf_dir).join(own.where("dictionary = 'src2'"), F.col("word") == F.col("expression")).withColumnRenamed("item_id", "query_id")
    return lookup.related_by_headword(rows.select("query_id", "id", "expression", "reading").distinct(), lookup.enabled_only(own, enabled_map(spark, ["src2", "src4"]))).select("query_id", "id")


@query(f"WITH {TERMS_SQL} SELECT expression, count(*) AS definitions, max(score) AS score FROM terms WHERE dictionary NOT IN ('src0', 'src1') GROUP BY ALL HAVING count(*) > 1")
def exclude_dictionary(spark, sf_dir):
    groups = terms(spark, sf_dir).groupBy("expression").agg(F.array_sort(F.collect_list(F.struct("dictionary", "score"))).alias("definitions"))
    kept = lookup.without_dictionaries(groups, ["src0", "src1"]).where(F.size("definitions") > 1)
    return kept.select("expression", F.size("definitions").cast("long").alias("definitions"), F.array_max(F.transform("definitions", lambda d: d["score"])).alias("score"))


@query(f"""WITH {TERMS_SQL}, {TAGS_SQL}, named AS (SELECT expression, dictionary, unnest([tag, pos]) AS tag FROM terms)
SELECT expression, tag, coalesce(m.category, 'default') AS category, min(coalesce(m.ord, 0)) AS "order", max(coalesce(m.score, 0)) AS score, list_sort(list(DISTINCT dictionary)) AS dictionaries, list_sort(list(DISTINCT m.notes) FILTER (m.notes IS NOT NULL)) AS content
FROM named LEFT JOIN tagmeta m ON m.name = tag GROUP BY ALL""")
def merge_tags(spark, sf_dir):
    return _merged_tags(spark, sf_dir, terms(spark, sf_dir))


def _merged_tags(spark, sf_dir, own: DataFrame) -> DataFrame:
    named = own.select("expression", "dictionary", F.explode(F.array("tag", "pos")).alias("tag"))
    few = F.array(*(F.struct(*(F.lit(v).alias(n) for n, v in zip(("name", "category", "order", "score", "notes", "tag_id"), (*t, t[2]), strict=True))) for t in TAGS))
    sources = table(spark, sf_dir, "documents").select(F.col("source").alias("dictionary")).distinct()
    described = sources.select("dictionary", F.explode(few).alias("t")).select("dictionary", "t.*")  # every dictionary describes the tags alike
    merged = metadata.merged_tags(metadata.with_tags(named, described), ["expression"])
    return merged.withColumn("content", F.when(F.size("content") > 0, F.col("content")))


@query(f"""WITH {TERMS_SQL} SELECT id, coalesce(dictionary = lag(dictionary) OVER w AND pos = lag(pos) OVER w, false) AS redundant FROM terms WINDOW w AS (PARTITION BY reading ORDER BY id)""")
def redundant_tags_lag(spark, sf_dir):
    own = terms(spark, sf_dir).withColumn("tags", F.array("pos"))
    return metadata.redundant_tags(own, ["reading"], "id").select("id", "redundant")


@query(f"""WITH {TERMS_SQL}, {BENCHMARK_SQL}, g AS (SELECT item_id, expression, max(score) AS score, count(*) AS definitions FROM bw JOIN terms ON word = expression GROUP BY ALL)
SELECT item_id, expression, score, definitions, row_number() OVER (PARTITION BY item_id ORDER BY length(expression) DESC, score DESC, expression) AS rank FROM g QUALIFY rank <= 10""")
def sort_entries_topk(spark, sf_dir):
    met = benchmark_words(spark, sf_dir).join(terms(spark, sf_dir), F.col("word") == F.col("expression"))
    groups = met.groupBy("item_id", "expression").agg(F.max("score").alias("score"), F.count("*").alias("definitions"))
    w = Window.partitionBy("item_id").orderBy(F.length("expression").desc(), F.col("score").desc(), "expression")
    return groups.withColumn("rank", F.row_number().over(w)).where("rank <= 10")


def _frequency_order_sql(ascending: bool) -> str:
    value = f"min(coalesce(f.freq, {C.LAST_ASCENDING}))" if ascending else f"-max(coalesce(f.freq, {C.LAST_DESCENDING}))"
    return f"""WITH {TERMS_SQL}, {BENCHMARK_SQL}, g AS (SELECT DISTINCT item_id, expression, reading FROM bw JOIN terms ON word = expression)
SELECT item_id, expression, reading, {value} AS frequency_order FROM g LEFT JOIN (SELECT expression, reading, freq FROM terms WHERE dictionary = 'src7') f USING (expression, reading) GROUP BY ALL"""


def _frequency_order(spark, sf_dir, ascending: bool) -> DataFrame:
    own = terms(spark, sf_dir)
    met = benchmark_words(spark, sf_dir).join(own, F.col("word") == F.col("expression")).select("item_id", "expression", "reading").distinct()
    groups = met.withColumn("headwords", F.array(F.struct("expression", "reading"))).withColumnRenamed("item_id", "query_id").withColumn("ord", F.struct("expression", "reading"))
    frequencies = own.where("dictionary = 'src7'").select("expression", "reading", F.col("freq").alias("frequency"), F.lit(0).alias("ord"))
    out = lookup.frequency_order(groups, frequencies, ascending)
    return out.select(F.col("query_id").alias("item_id"), "ord.expression", "ord.reading", F.col("frequency_order").cast("long").alias("frequency_order"))


@query(_frequency_order_sql(True))
def sort_frequency_asc(spark, sf_dir):
    return _frequency_order(spark, sf_dir, True)


@query(_frequency_order_sql(False))
def sort_frequency_desc(spark, sf_dir):
    return _frequency_order(spark, sf_dir, False)


def _meta(spark, sf_dir) -> DataFrame:
    return terms(spark, sf_dir).select("dictionary", "expression", "reading", F.col("freq").alias("frequency"), "score")


@query(f"WITH {TERMS_SQL} SELECT expression, count(*) AS dictionaries, CAST(floor(round(count(*) / sum(1.0 / freq), 9) + 0.5) AS BIGINT) AS harmonic FROM terms GROUP BY expression")
def freq_rank_harmonic(spark, sf_dir):
    return metadata.frequency_ranking(_meta(spark, sf_dir), ["expression"])


@query(f"WITH {TERMS_SQL}, {BENCHMARK_SQL}, w AS (SELECT DISTINCT word FROM bw) SELECT word, count(*) AS dictionaries, CAST(floor(round(count(*) / sum(1.0 / freq), 9) + 0.5) AS BIGINT) AS harmonic FROM w JOIN terms ON word = expression GROUP BY word")
def freq_rank_bulk(spark, sf_dir):
    wanted = benchmark_words(spark, sf_dir).select("word").distinct()
    met = wanted.join(_meta(spark, sf_dir), F.col("word") == F.col("expression"))
    return metadata.frequency_ranking(met, ["word"])


@query(f"WITH {TERMS_SQL} SELECT reading, CAST(coalesce(floor(round(count(*) / sum(CASE WHEN freq - 2 > 0 THEN 1.0 / (freq - 2) END), 9) + 0.5), -1) AS BIGINT) AS harmonic FROM terms GROUP BY reading")
def freq_display_harmonic(spark, sf_dir):
    return metadata.display_harmonic(_meta(spark, sf_dir).withColumn("frequency", F.col("frequency") - 2), ["reading"])


@query(f"""WITH {TERMS_SQL}, r AS (SELECT reading, freq, lag(dictionary) OVER (PARTITION BY reading ORDER BY dictionary, expression) AS before, dictionary FROM terms)
SELECT reading, CAST(coalesce(floor(round(count(freq) / sum(1.0 / freq), 9)), -1) AS BIGINT) AS harmonic, CAST(floor(avg(freq)) AS BIGINT) AS average FROM r WHERE before IS DISTINCT FROM dictionary GROUP BY reading""")
def freq_note_harmonic_floor(spark, sf_dir):
    meta = _meta(spark, sf_dir).withColumn("display", F.col("frequency").cast("string"))
    return metadata.note_numbers(meta, ["reading"], ["dictionary", "expression"])


@query(f"""WITH {TERMS_SQL} SELECT dictionary, expression, CAST([freq] AS DOUBLE[]) AS "values" FROM terms
UNION ALL SELECT 'Average', expression, [CAST(floor(round(count(*) / sum(1.0 / freq), 9) + 0.5) AS DOUBLE)] FROM terms GROUP BY expression""")
def freq_average(spark, sf_dir):
    return metadata.grouped_frequencies(_meta(spark, sf_dir))


@query(r"SELECT event_id, CASE WHEN regexp_extract(props, '[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?') = '' THEN 0.0 ELSE CAST(regexp_extract(props, '[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?') AS DOUBLE) END AS number FROM events")
def freq_number_parse(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", C.to_number(F.col("props")).alias("number"))


@query(f"WITH {TERMS_SQL}, {BENCHMARK_SQL}, p AS (SELECT DISTINCT word AS term, CASE WHEN length(word) % 2 = 0 THEN regexp_replace(word, '[aeiou]', '', 'g') END AS reading FROM bw) SELECT term, coalesce(p.reading, t.reading) AS reading, dictionary, freq AS frequency FROM p JOIN terms t ON term = expression WHERE p.reading IS NULL OR p.reading = t.reading")
def term_frequencies_pairs(spark, sf_dir):
    pairs = benchmark_words(spark, sf_dir).select(F.col("word").alias("term"), F.when(F.length("word") % 2 == 0, F.regexp_replace("word", "[aeiou]", "")).alias("reading")).distinct()
    meta = _meta(spark, sf_dir).select("dictionary", "expression", F.col("reading").alias("meta_reading"), "frequency")
    return metadata.term_frequencies(pairs, meta).select("term", "reading", "dictionary", "frequency")


@query(f"WITH {TERMS_SQL} SELECT dictionary, count(*) AS terms, count(*) FILTER (score >= 5) AS common, (SELECT count(*) FROM documents d WHERE d.source = dictionary) AS documents FROM terms GROUP BY dictionary")
def dictionary_counts_all(spark, sf_dir):
    own = terms(spark, sf_dir)
    docs = table(spark, sf_dir, "documents").withColumnRenamed("source", "dictionary")
    return dictionary_counts({"terms": own, "common": own.where("score >= 5"), "documents": docs})


@query(f"WITH {TERMS_SQL} SELECT dictionary, count(*) AS n, sum(score) AS score FROM terms WHERE dictionary NOT IN ('src0') GROUP BY dictionary")
def delete_dictionary_anti(spark, sf_dir):
    gone = spark.createDataFrame([("src0",)], "dictionary string")
    return terms(spark, sf_dir).join(gone, "dictionary", "left_anti").groupBy("dictionary").agg(F.count("*").alias("n"), F.sum("score").alias("score"))


def _entries_sql(asked: str) -> str:
    """Rows that texts reach by their prefixes, in a language without rules: `asked` selects the texts."""
    return f"""{TERMS_SQL}, dicts AS (SELECT dictionary, row_number() OVER (ORDER BY dictionary) - 1 AS idx FROM (SELECT DISTINCT dictionary FROM terms)),
q AS ({asked}), cand AS (SELECT word AS query_id, left(word, k) AS base FROM (SELECT word, unnest(range(1, length(word) + 1)) AS k FROM q)),
hits AS (SELECT query_id, base, 0 AS k, t.*, idx FROM cand JOIN terms t ON base = expression JOIN dicts USING (dictionary)
  UNION ALL SELECT query_id, base, 1, t.*, idx FROM cand JOIN terms t ON base = reading AND reading <> expression JOIN dicts USING (dictionary)),
rows AS (SELECT * FROM hits QUALIFY row_number() OVER (PARTITION BY query_id, id ORDER BY length(base) DESC, k) = 1)"""


BENCHMARK_TEXTS = f"WITH {BENCHMARK_SQL} SELECT DISTINCT word FROM bw"
SAID = "SELECT DISTINCT unnest(regexp_extract_all(lower(regexp_replace(text, '[^A-Za-z]', ' ', 'g')), '[a-z]+')) AS word FROM conversations"
HEADWORD_SQL = """g AS (SELECT query_id, expression, reading, max(score) AS score, min(idx) AS dictionary_index, max(length(base)) AS max_length, max(1 - k) AS exact, count(*) AS definitions FROM rows GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY max_length DESC, exact DESC, dictionary_index, score DESC, length(expression) DESC, expression, definitions DESC) AS rank FROM g)"""
TERM_SQL = HEADWORD_SQL.replace("SELECT query_id, expression, reading, max(score)", "SELECT query_id, expression, max(score)").replace("max(1 - k) AS exact", "count(DISTINCT reading) FILTER (k = 0) AS exact")
SHOWN = ("query_id", "rank", "expression", "max_length", "exact", "dictionary_index", "score", "definitions")


def _dictionaries(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """The derived dictionary, made once, and its enabled map."""
    own = written(_shaped(terms(spark, sf_dir)))
    sources = [r[0] for r in own.select("dictionary").distinct().orderBy("dictionary").collect()]
    return own, enabled_map(spark, sources)


def _found(spark, sf_dir, asked: DataFrame, mode: str, **options) -> DataFrame:
    """The library's lookup of texts (`text`) in all dictionaries, in a language of the same letters that has no rules."""
    own, on = _dictionaries(spark, sf_dir)
    found = lookup.find_terms(asked.withColumn("query_id", F.col("text")), own, on, "pt", mode, definitions=False, **options)
    return found.select("query_id", "rank", F.col("headwords")[0]["expression"].alias("expression"), "max_length", "exact", "dictionary_index", "score", F.size("definitions").alias("definitions"), "headwords")


def _asked(spark, sf_dir) -> DataFrame:
    return benchmark_words(spark, sf_dir).select(F.col("word").alias("text")).distinct()


@query(f"WITH {_entries_sql(BENCHMARK_TEXTS)}, {HEADWORD_SQL} SELECT {', '.join(SHOWN)} FROM ranked")
def find_terms_group(spark, sf_dir):
    """Grouped by headword, ranked."""
    return _found(spark, sf_dir, _asked(spark, sf_dir), "group").select(*SHOWN)


@query(f"WITH {_entries_sql(BENCHMARK_TEXTS)}, {TERM_SQL} SELECT {', '.join(SHOWN)} FROM ranked")
def find_terms_term(spark, sf_dir):
    """Grouped by term, whatever its reading."""
    return _found(spark, sf_dir, _asked(spark, sf_dir), "term").select(*SHOWN)


@query(f"""WITH {_entries_sql(BENCHMARK_TEXTS)} SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY length(base) DESC, base = expression DESC, idx, score DESC, length(expression) DESC, expression, id) AS rank,
expression, length(base) AS max_length, CAST(base = expression AS INTEGER) AS exact, idx AS dictionary_index, score, 1 AS definitions FROM rows""")
def find_terms_simple(spark, sf_dir):
    """Entries as they are, ranked."""
    return _found(spark, sf_dir, _asked(spark, sf_dir), "simple").select(*SHOWN)


@query(f"""WITH {_entries_sql(BENCHMARK_TEXTS)}, seeds AS (SELECT query_id, sequence AS s, id, expression, reading, idx, score, length(base) AS size, k FROM rows WHERE dictionary = 'src2'),
core AS (SELECT g.query_id, g.s, t.id, t.expression, t.reading, d.idx, t.score, coalesce(seeds.size, 0) AS size, coalesce(seeds.k, 1) AS k
  FROM (SELECT DISTINCT query_id, s FROM seeds) g JOIN terms t ON t.sequence = g.s AND t.dictionary = 'src2' JOIN dicts d ON d.dictionary = 'src2' LEFT JOIN seeds ON seeds.query_id = g.query_id AND seeds.s = g.s AND seeds.id = t.id),
heads AS (SELECT DISTINCT query_id, s, expression, reading FROM core),
joined AS (SELECT h.query_id, h.s, r.id, r.expression, r.reading, r.idx, r.score, length(r.base) AS size, r.k FROM rows r JOIN heads h USING (query_id, expression, reading) WHERE r.dictionary <> 'src2'),
more AS (SELECT h.query_id, h.s, t.id, t.expression, t.reading, d.idx, t.score, 0 AS size, 1 AS k FROM heads h JOIN terms t USING (expression, reading) JOIN dicts d USING (dictionary)
  ANTI JOIN (SELECT query_id, s, id FROM core UNION ALL SELECT query_id, s, id FROM joined) x ON x.query_id = h.query_id AND x.s = h.s AND x.id = t.id),
every AS (SELECT * FROM core UNION ALL SELECT * FROM joined UNION ALL SELECT * FROM more),
left_ AS (SELECT * FROM rows r WHERE dictionary <> 'src2' AND NOT EXISTS (SELECT 1 FROM joined j WHERE j.query_id = r.query_id AND j.id = r.id) AND NOT EXISTS (SELECT 1 FROM more m WHERE m.query_id = r.query_id AND m.id = r.id))
SELECT query_id, max(size) AS max_length, count(DISTINCT expression) FILTER (k = 0) AS exact, min(idx) AS dictionary_index, max(score) AS score, count(*) AS definitions, count(DISTINCT expression) AS headwords FROM every GROUP BY query_id, s
UNION ALL SELECT query_id, max(length(base)), max(1 - k), min(idx), max(score), count(*), 1 FROM left_ GROUP BY query_id, expression, reading""")
def find_terms_merge(spark, sf_dir):
    """Merged by the sequences of one dictionary."""
    found = _found(spark, sf_dir, _asked(spark, sf_dir), "merge", main_dictionary="src2")
    return found.select("query_id", "max_length", "exact", "dictionary_index", "score", "definitions", F.size("headwords").alias("headwords"))


@query(f"""WITH {_entries_sql(SAID)}, {HEADWORD_SQL} SELECT word AS text, rank, expression, max_length, exact, score, definitions FROM q LEFT JOIN ranked ON query_id = word""")
def batch_lookup_distinct(spark, sf_dir):
    """Every distinct word of the conversations, once; words without a hit stay."""
    own, on = _dictionaries(spark, sf_dir)
    said = table(spark, sf_dir, "conversations").select(F.explode(words()).alias("text")).distinct()
    found = lookup.batch_lookup(said, own, on, language="pt", definitions=False)
    return found.select("text", "rank", F.col("headwords")[0]["expression"].alias("expression"), "max_length", "exact", "score", F.size("definitions").alias("definitions"))


def _structured(spark, sf_dir) -> DataFrame:
    """Each document as a definition: a list of its lines, with a reading over each and an image after it."""
    node = lambda tag, **more: F.struct(F.lit(tag).alias("tag"), *(v.alias(k) for k, v in more.items()))
    said = lambda line: F.struct(F.lit("span").alias("tag"), line.alias("content"), F.lit(None).cast("string").alias("path"))
    read = F.struct(F.lit("rt").alias("tag"), F.lit("read so").alias("content"), F.lit(None).cast("string").alias("path"))
    shown = lambda line: F.struct(F.lit("img").alias("tag"), F.lit("unsaid").alias("content"), F.concat(F.length(line).cast("string"), F.lit(".png")).alias("path"))
    lines = F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), lambda line: node("li", content=node("ruby", content=F.array(said(line), read, shown(line)))))
    tree = F.to_json(F.struct(F.lit("structured-content").alias("type"), F.array(node("ul", content=lines)).alias("content")))
    return table(spark, sf_dir, "documents").select(F.col("source").alias("dictionary"), F.col("doc_id").alias("id"), F.array(tree).alias("definitions"))


@query(r"""WITH t AS (SELECT source AS dictionary, doc_id AS id, coalesce(text, '') || chr(10) || chr(10) AS t FROM documents),
a AS (SELECT dictionary, id, regexp_replace(regexp_replace(regexp_replace(t, '[ \t]+\n', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '[ \t]{2,}', ' ', 'g') AS t FROM t)
SELECT dictionary, id, regexp_replace(t, '^[\s\x0B\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]+|[\s\x0B\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]+$', '', 'g') AS text FROM a""")
def glossary_plain(spark, sf_dir):
    """Structured content as text: lists, readings over words and images, taken apart level by level."""
    return glossary.plain_definitions(_structured(spark, sf_dir)).select("dictionary", "id", "text")


@query("SELECT source AS dictionary, length(line) || '.png' AS path, count(*) AS n FROM (SELECT source, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents) GROUP BY ALL")
def glossary_images(spark, sf_dir):
    """Images that definitions need, however deep they lie."""
    return glossary.image_requirements(_structured(spark, sf_dir)).groupBy("dictionary", "path").agg(F.count("*").alias("n"))


@query()
def batch_lookup_whole(spark, sf_dir):
    """The whole lookup of each distinct word of the conversations, once; words without a hit stay."""
    own, on = _dictionaries(spark, sf_dir)
    said = table(spark, sf_dir, "conversations").select(F.explode(words()).alias("text")).distinct()
    found = lookup.batch_lookup(said, own, on, language="en", definitions=False)
    return found.select("text", "rank", F.col("headwords")[0]["expression"].alias("expression"), "max_length", "score", F.size("definitions").alias("definitions"), "chain_length")


def _shaped(own: DataFrame) -> DataFrame:
    return own.select("*", F.array("pos").alias("rules"), F.array(F.col("expression")).alias("definitions"), F.array("pos").alias("definition_tags"), F.array("tag").alias("term_tags")).drop("pos", "tag", "freq")


def _characters(spark, sf_dir) -> DataFrame:
    """A dictionary of single letters: source, character, and statistics of the words it stands in."""
    own = terms(spark, sf_dir).select("dictionary", F.explode(F.split("expression", "")).alias("character"), "expression", "freq").where("character <> ''")
    return own.groupBy("dictionary", "character").agg(F.count("*").alias("words"), F.sum("freq").alias("freq"))


CHARACTERS_SQL = f"""{TERMS_SQL}, chars AS (SELECT dictionary, unnest(string_split(expression, '')) AS character, freq FROM terms),
kanji AS (SELECT dictionary, character, count(*) AS words, sum(freq) AS freq FROM chars WHERE character <> '' GROUP BY ALL)"""


@query(f"WITH {CHARACTERS_SQL}, c AS (SELECT DISTINCT item_id, unnest(string_split(regexp_replace(lower(text), '[^a-z]', '', 'g'), '')) AS character FROM benchmark) SELECT item_id, character, dictionary, words, freq FROM c JOIN kanji USING (character)")
def kanji_lookup(spark, sf_dir):
    own = _characters(spark, sf_dir)
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.regexp_replace(F.lower("text"), "[^a-z]", "").alias("text"))
    on = own.select(F.col("dictionary").alias("title"), F.lit(0).alias("idx"), F.col("dictionary").alias("alias")).distinct()
    return find_kanji(asked, own, on).select(F.col("query_id").alias("item_id"), "character", "dictionary", "words", "freq")


@query(f"""WITH {CHARACTERS_SQL}, s(name, category, ord) AS (VALUES ('words', 'count', 1), ('freq', 'count', 2)),
e AS (SELECT dictionary, character, 'words' AS name, CAST(words AS VARCHAR) AS value FROM kanji UNION ALL SELECT dictionary, character, 'freq', CAST(freq AS VARCHAR) FROM kanji UNION ALL SELECT dictionary, character, 'other', 'x' FROM kanji)
SELECT character, dictionary, category, string_agg(name || '=' || value, ' ' ORDER BY ord) AS stats FROM e JOIN s USING (name) GROUP BY ALL""")
def kanji_stats_group(spark, sf_dir):
    own = _characters(spark, sf_dir)
    stats = own.select("character", "dictionary", F.create_map(F.lit("words"), F.col("words").cast("string"), F.lit("freq"), F.col("freq").cast("string"), F.lit("other"), F.lit("x")).alias("stats"))
    known = own.select("dictionary").distinct().select("dictionary", F.explode(F.array(*(F.struct(F.lit(n).alias("name"), F.lit("count").alias("category"), F.lit(o).alias("order"), F.lit(n).alias("notes")) for n, o in (("words", 1), ("freq", 2))))).alias("t")).select("dictionary", "t.*")
    out = metadata.kanji_stats(stats, known)
    return out.select("character", "dictionary", "category", F.array_join(F.transform("stats", lambda s: F.concat_ws("=", s["name"], s["value"])), " ").alias("stats"))


@query(f"""WITH RECURSIVE {TERMS_SQL}, d AS (SELECT DISTINCT expression AS text FROM terms WHERE length(expression) BETWEEN 2 AND 20),
l AS (SELECT item_id, unnest(string_split(lower(text), chr(10))) AS line, unnest(range(0, len(string_split(text, chr(10))))) AS line_no FROM benchmark),
p AS (SELECT item_id, line_no, line, unnest(range(0, length(line))) AS pos FROM l), w AS (SELECT item_id, line_no, pos, unnest(range(2, 21)) AS size, line FROM p),
m AS (SELECT item_id, line_no, pos, max(size) AS size FROM w JOIN d ON substr(line, pos + 1, size) = d.text AND pos + size <= length(line) GROUP BY ALL),
c AS (SELECT item_id, line_no, min(pos) AS pos FROM m GROUP BY ALL UNION ALL
  SELECT * FROM (SELECT c.item_id, c.line_no, (SELECT min(n.pos) FROM m n WHERE n.item_id = c.item_id AND n.line_no = c.line_no AND n.pos >= c.pos + m.size) AS pos FROM c JOIN m ON m.item_id = c.item_id AND m.line_no = c.line_no AND m.pos = c.pos) WHERE pos IS NOT NULL)
SELECT c.item_id, c.line_no, c.pos, substr(line, c.pos + 1, size) AS text FROM c JOIN m USING (item_id, line_no, pos) JOIN l ON l.item_id = c.item_id AND l.line_no = c.line_no""")
def segment_longest_match(spark, sf_dir):
    known = terms(spark, sf_dir).where("length(expression) BETWEEN 2 AND 20").select(F.col("expression").alias("text"))
    lines = table(spark, sf_dir, "benchmark").select("item_id", F.posexplode(F.split(F.lower("text"), "\n")).alias("line_no", "line"))
    return segment.segments(lines, known, by=("item_id", "line_no")).where("matched").select("item_id", "line_no", "pos", "text")


@query(f"""WITH RECURSIVE {TERMS_SQL}, dicts AS (SELECT dictionary, row_number() OVER (ORDER BY dictionary) - 1 AS idx FROM (SELECT DISTINCT dictionary FROM terms)),
keyed AS (SELECT expression AS key, 1 AS exact, * FROM terms JOIN dicts USING (dictionary) UNION ALL SELECT reading, 0, * FROM terms JOIN dicts USING (dictionary) WHERE reading <> expression),
best AS (SELECT key, reading FROM keyed QUALIFY row_number() OVER (PARTITION BY key ORDER BY exact DESC, idx, score DESC, length(expression) DESC, expression, id) = 1),
l AS (SELECT item_id, unnest(string_split(lower(text), chr(10))) AS line, unnest(range(0, len(string_split(text, chr(10))))) AS line_no FROM benchmark),
p AS (SELECT item_id, line_no, line, unnest(range(0, length(line))) AS pos FROM l), w AS (SELECT item_id, line_no, pos, unnest(range(1, 21)) AS size, line FROM p),
m AS (SELECT item_id, line_no, pos, max(size) AS size FROM w JOIN best ON substr(line, pos + 1, size) = key AND pos + size <= length(line) GROUP BY ALL HAVING max(size) > 1),
c AS (SELECT item_id, line_no, min(pos) AS pos FROM m GROUP BY ALL UNION ALL
  SELECT * FROM (SELECT c.item_id, c.line_no, (SELECT min(n.pos) FROM m n WHERE n.item_id = c.item_id AND n.line_no = c.line_no AND n.pos >= c.pos + m.size) AS pos FROM c JOIN m ON m.item_id = c.item_id AND m.line_no = c.line_no AND m.pos = c.pos) WHERE pos IS NOT NULL)
SELECT c.item_id, c.line_no, c.pos, substr(line, c.pos + 1, size) AS text, reading FROM c JOIN m USING (item_id, line_no, pos) JOIN l ON l.item_id = c.item_id AND l.line_no = c.line_no JOIN best ON key = substr(line, c.pos + 1, size)""")
def parse_benchmark(spark, sf_dir):
    """Lines of the benchmark, segmented by whole lookups, with readings."""
    own, on = _dictionaries(spark, sf_dir)
    texts = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("text_id"), F.lower("text").alias("text"))
    parts = segment.parse(texts, own, on, "pt").where("matched")
    return parts.select(F.col("text_id").alias("item_id"), "line_no", "pos", "text", "reading")


@query("""WITH v AS (SELECT p_partkey, p_size || '.' || (p_partkey % 7) AS a, (p_size + p_partkey % 3 - 1) || '.' || (p_partkey % 5) AS b FROM part)
SELECT p_partkey, a, b, CASE WHEN CAST(split_part(a, '.', 1) AS BIGINT) <> CAST(split_part(b, '.', 1) AS BIGINT) THEN CAST(split_part(a, '.', 1) AS BIGINT) < CAST(split_part(b, '.', 1) AS BIGINT) ELSE CAST(split_part(a, '.', 2) AS BIGINT) < CAST(split_part(b, '.', 2) AS BIGINT) END AS newer FROM v""")
def compare_revisions(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    own = part.select("p_partkey", F.concat_ws(".", "p_size", F.col("p_partkey") % 7).alias("a"), F.concat_ws(".", F.col("p_size") + F.col("p_partkey") % 3 - 1, F.col("p_partkey") % 5).alias("b"))
    return own.withColumn("newer", C.later_revision(F.col("a"), F.col("b")))


@query(r"SELECT p_partkey, lower(regexp_replace(regexp_replace(regexp_replace(regexp_replace(p_name || ' ' || p_type, '[\s_　]', '-', 'g'), '[^\p{L}\p{N}-]', '', 'g'), '--+', '-', 'g'), '^-|-$', '', 'g')) AS kebab FROM part")
def kebab_case(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", C.kebab_case(F.concat_ws(" ", "p_name", "p_type")).alias("kebab"))


@query(r"SELECT event_id, regexp_extract_all('{' || event_type || '} {value} ' || props || ' {user-' || user_id || '}', '\{([\p{L}\p{N}_-]+)\}', 1) AS markers FROM events")
def field_markers(spark, sf_dir):
    template = F.concat(F.lit("{"), "event_type", F.lit("} {value} "), "props", F.lit(" {user-"), F.col("user_id").cast("string"), F.lit("}"))
    return table(spark, sf_dir, "events").select("event_id", C.field_markers(template).alias("markers"))


@query("WITH s AS (SELECT conv_id, turn, text, regexp_extract(text, '[A-Za-z]+') AS source FROM conversations) SELECT conv_id, turn, left(text, instr(text, source) - 1) AS prefix, source AS body, substr(text, instr(text, source) + length(source)) AS suffix FROM s WHERE source <> ''")
def cloze(spark, sf_dir):
    own = table(spark, sf_dir, "conversations").withColumn("source", F.regexp_extract("text", "[A-Za-z]+", 0)).where("source <> ''")
    return own.select("conv_id", "turn", C.cloze(F.col("text"), F.col("source"), F.instr("text", F.col("source")) - 1).alias("c")).select("conv_id", "turn", "c.*")


@query(f"""WITH {TERMS_SQL}, g AS (SELECT dictionary, reading, list_sort(list(expression)) AS own FROM terms GROUP BY ALL), a AS (SELECT reading, list(DISTINCT expression) AS every FROM terms GROUP BY ALL)
SELECT dictionary, reading, CASE WHEN len(every) > len(own) THEN own ELSE [] END AS terms FROM g JOIN a USING (reading)""")
def disambiguation_sets(spark, sf_dir):
    own = distinct_words(table(spark, sf_dir, "documents").select(F.col("source").alias("dictionary"), "text")).withColumn("reading", reading())
    sets = written(own.groupBy("dictionary", "reading").agg(F.array_sort(F.collect_set("expression")).alias("own")))  # the texts are read once
    every = sets.select("reading", F.explode("own").alias("expression")).groupBy("reading").agg(F.collect_set("expression").alias("every"))
    return sets.join(every, "reading").select("dictionary", "reading", metadata.disambiguations(F.col("own"), F.array("reading"), F.col("every"), F.array("reading")).alias("terms"))


@query(f"WITH {BENCHMARK_SQL} SELECT DISTINCT word, 'https://audio.example/en/' || word || '?r=' || regexp_replace(word, '[aeiou]', '', 'g') || '%20x' AS url FROM bw")
def audio_custom_url(spark, sf_dir):
    own = benchmark_words(spark, sf_dir).select("word").distinct()
    url = C.custom_audio_url("https://audio.example/{language}/{term}?r={reading}", F.col("word"), F.concat(F.regexp_replace("word", "[aeiou]", ""), F.lit(" x")), "en")
    return own.select("word", url.alias("url"))


@query(f"""WITH {TERMS_SQL}, {BENCHMARK_SQL}, s AS (SELECT DISTINCT word, sum(CASE tag WHEN 'common' THEN 1 WHEN 'rare' THEN -1 ELSE 0 END) AS total FROM (SELECT DISTINCT word FROM bw) JOIN terms ON word = expression GROUP BY word)
SELECT word, CASE WHEN total > 0 THEN 'popular' WHEN total < 0 THEN 'rare' ELSE 'normal' END AS popularity FROM s""")
def term_popularity(spark, sf_dir):
    met = benchmark_words(spark, sf_dir).select("word").distinct().join(terms(spark, sf_dir), F.col("word") == F.col("expression"))
    return met.groupBy("word").agg(metadata.popularity(F.when(F.col("tag") == "common", 1).when(F.col("tag") == "rare", -1).otherwise(0)).alias("popularity"))


@query("WITH e AS (SELECT event_id, CAST(value AS INTEGER) % 5 AS position, 2 + event_id % 4 AS morae, event_id % 2 = 0 AS verb FROM events) SELECT event_id, CASE WHEN position = 0 THEN 'heiban' WHEN verb AND position > 0 THEN 'kifuku' WHEN position = 1 THEN 'atamadaka' WHEN position > 1 THEN CASE WHEN position >= morae THEN 'odaka' ELSE 'nakadaka' END END AS category FROM (SELECT event_id, user_id % 5 AS position, morae, verb FROM e JOIN events USING (event_id))")
def pitch_categories(spark, sf_dir):
    own = table(spark, sf_dir, "events")
    return own.select("event_id", C.pitch_category(F.col("user_id") % 5, 2 + F.col("event_id") % 4, F.col("event_id") % 2 == 0).alias("category"))


@query()
def find_terms_grouped(spark, sf_dir):
    """The whole lookup of each distinct word of the benchmark: prefixes, rewrites, hits, groups and ranks."""
    own, on = _dictionaries(spark, sf_dir)
    asked = benchmark_words(spark, sf_dir).select(F.col("word").alias("text")).distinct().withColumn("query_id", F.col("text"))
    found = lookup.find_terms(asked, own, on, "en", definitions=False)
    return found.select("query_id", "rank", F.col("headwords")[0]["expression"].alias("expression"), "max_length", "score", F.size("definitions").alias("definitions"), "chain_length")


@query(
    """WITH w AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[A-Za-zäöüÄÖÜ][A-Za-zäöüÄÖÜß]*')) AS text FROM documents WHERE lang = 'de'),
a AS (SELECT text, unnest(list_distinct([text, lower(text)])) AS v FROM w), b AS (SELECT text, unnest(list_distinct([v, upper(left(v, 1)) || substr(v, 2)])) AS v FROM a),
c AS (SELECT text, unnest(list_distinct([v, replace(v, 'ß', 'ss'), replace(v, 'ss', 'ß')])) AS v FROM b) SELECT DISTINCT text, v AS variant FROM c"""
)
def text_variants_de(spark, sf_dir):
    """All German processors with all options."""
    own = table(spark, sf_dir, "documents").where("lang = 'de'").select(F.explode(F.regexp_extract_all("text", F.lit("([A-Za-zäöüÄÖÜ][A-Za-zäöüÄÖÜß]*)"), F.lit(1))).alias("text"))
    return text_variants(own, "de").select("text", "variant")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batch lookup of the benchmark's words in the derived dictionary: the best group of each word."""
    met = benchmark_words(spark, sf_dir).join(terms(spark, sf_dir), F.col("word") == F.col("expression"))
    groups = met.groupBy("item_id", "word", "reading").agg(F.max("score").alias("score"), F.count("*").alias("definitions"), metadata.harmonic_mean(F.col("freq")).alias("frequency"))
    w = Window.partitionBy("item_id").orderBy(F.col("frequency").desc(), F.length("word").desc(), "word")
    return groups.withColumn("rank", F.row_number().over(w)).where("rank = 1")


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)

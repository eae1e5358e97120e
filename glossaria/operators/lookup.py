"""Lookups as joins: candidates meet dictionary rows, hits become entries, entries are grouped, enriched and ranked.

Terms have dictionary, id, expression, reading, rules (array), score, sequence, definitions (array), definition_tags and
term_tags (arrays). The enabled map is a small table: title, idx, alias, pos_filter, use_deinflections,
allow_secondary. Order matters throughout and is carried as a column, never taken from the order of rows.

A definition that is a JSON array, [text, [rules]], redirects to another term: its dictionary says of which text the term
is a form.

What a term says, its definitions, is not carried along: terms are `slim` while they are met, grouped and ranked, and the
definitions of what is left are fetched at the end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from glossaria.functions.columns import JAPANESE, LAST_ASCENDING, LAST_DESCENDING, lookup_prefixes, part_of_speech_passes, reversed_text
from glossaria.functions.processors import normalised_reading
from glossaria.functions.rule_sets import rule_set
from glossaria.operators import metadata
from glossaria.operators.deinflect import TASKS_A_CORE, forms_of
from glossaria.sources.scratch import written

MODES = ("group", "term", "merge", "simple")
NO_CHAINS = "array<array<string>>"
INFLECTIONS = "array<struct<source:string,rules:array<string>>>"


def enabled_only(terms: DataFrame, enabled: DataFrame) -> DataFrame:
    return terms.join(F.broadcast(enabled).select(F.col("title").alias("dictionary")), "dictionary", "left_semi")


def keyed(terms: DataFrame) -> DataFrame:
    """Terms by what they are looked up by: once by the expression, once by a reading that differs from it."""
    by_reading = F.when(F.col("reading") != F.col("expression"), F.array(F.struct(F.col("reading").alias("_key"), F.lit("reading").alias("match_source")))).otherwise(F.array())
    keys = F.concat(F.array(F.struct(F.col("expression").alias("_key"), F.lit("term").alias("match_source"))), by_reading)
    return terms.select("*", F.explode(keys).alias("_k")).select("*", "_k.*").drop("_k").where("_key <> ''")


def exact_hits(items: DataFrame, terms: DataFrame, key: str = "text") -> DataFrame:
    """Items by expression and by reading; match_source says which. A row met by both is met by its expression."""
    return items.join(keyed(terms), F.col(key) == F.col("_key")).drop("_key")


def exact_pairs(pairs: DataFrame, terms: DataFrame) -> DataFrame:
    """Terms of just this expression and reading."""
    return pairs.join(terms, ["expression", "reading"])


def by_sequence(asked: DataFrame, terms: DataFrame) -> DataFrame:
    """Terms of the asked (sequence, dictionary)."""
    return asked.join(terms, ["sequence", "dictionary"])


def prefix_hits(items: DataFrame, terms: DataFrame, key: str = "text", column: str = "expression") -> DataFrame:
    """Terms that start with an item: an equi-join on prefixes of the lengths that items have.

    The lengths are collected: at most as many as the longest item has letters.
    """
    lengths = sorted(r[0] for r in items.select(F.length(key)).distinct().collect() if r[0])
    sizes = F.array(*map(F.lit, lengths)) if lengths else F.array().cast("array<int>")
    keyed = terms.withColumn("_size", F.explode(F.filter(sizes, lambda n: n <= F.length(column)))).withColumn("_key", F.substring(F.col(column), F.lit(1), F.col("_size"))).drop("_size")
    exact = F.when(F.col(key) == F.col(column), "exact").otherwise("prefix")
    return items.join(keyed, F.col(key) == F.col("_key")).drop("_key").withColumn("match_type", exact)


def suffix_hits(items: DataFrame, terms: DataFrame, key: str = "text", column: str = "expression") -> DataFrame:
    """Terms that end with an item: the prefix join on reversed texts."""
    turned = prefix_hits(items.withColumn("_r", reversed_text(F.col(key))), terms.withColumn("_c", reversed_text(F.col(column))), "_r", "_c")
    return turned.drop("_r", "_c").withColumn("match_type", F.when(F.col("match_type") == "prefix", "suffix").otherwise(F.col("match_type")))


def first_hit(hits: DataFrame, by: list[str], order: list) -> DataFrame:
    """One row of each `by`, the first in order."""
    w = Window.partitionBy(*by).orderBy(*order)
    return hits.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def candidates(queries: DataFrame, language: str, deinflect: bool = True, by: str = "letter", replacements: tuple = ()) -> DataFrame:
    """query_id, ord, original_text, transformed_text, base, flags, text_chains, inflections (array of source, rules).

    Each prefix of a query gives its variants under the language's processors, each of these its rewrites, and each of
    these its variants under the processors that come after. All are made of distinct texts once. Without `deinflect` the
    text itself is the only candidate.
    """
    asked = queries.where(F.length("text") > 0)
    if not deinflect:
        text = F.col("text")
        nothing = (F.lit(0).alias("flags"), F.array().cast(NO_CHAINS).alias("text_chains"), F.array().cast(INFLECTIONS).alias("inflections"))
        return asked.select("query_id", F.struct(*(F.lit(0).alias(f"o{k}") for k in range(1, 5))).alias("ord"), text.alias("original_text"), text.alias("transformed_text"), text.alias("base"), *nothing)
    return _candidates_of(asked.select("query_id", F.posexplode(lookup_prefixes(F.col("text"), by)).alias("o1", "original_text")), language, replacements)


def _candidates_of(sources: DataFrame, language: str, replacements: tuple) -> DataFrame:
    made = sources.join(forms_of(sources, language, "original_text", replacements), "original_text")
    return made.select("query_id", F.struct("o1", "o2", "o3", "o4").alias("ord"), "original_text", "transformed_text", "base", "flags", "text_chains", "inflections")


def rule_flags(rules: Column, language: str) -> Column:
    """Flags of a term's parts of speech; names that the language doesn't know give none."""
    known = rule_set(language)
    if known is None:
        return F.lit(0)
    out = F.lit(0)
    for c in known.conditions:
        if c.dictionary_form:
            out = out.bitwiseOR(F.when(F.array_contains(rules, c.name), known.flags[c.name]).otherwise(0))
    return out


def is_redirect(definition: Column) -> Column:
    """A JSON array of a text and a list; a text that only begins with a bracket isn't one."""
    named = (F.json_array_length(definition) == 2) & F.get_json_object(definition, "$[1]").startswith("[")
    return definition.startswith("[") & F.coalesce(named, F.lit(False))


def slim(terms: DataFrame, enabled: DataFrame) -> DataFrame:
    """Terms of enabled dictionaries with what the enabled map says of these. In place of definitions: those that redirect
    (`redirects`), and what the others are known by (`content`, null if there are none)."""
    own = terms.join(F.broadcast(enabled).withColumnRenamed("title", "dictionary"), "dictionary")  # a row a dictionary; Spark doesn't know its size and would send the terms
    said = F.filter("definitions", lambda d: ~is_redirect(d))
    content = F.when(F.size(said) > 0, F.sha2(F.to_json(F.struct(said)), 256))
    return own.select(*SLIM, F.filter("definitions", is_redirect).alias("redirects"), content.alias("content"))


SLIM = ("dictionary", "id", "expression", "reading", "rules", "score", "sequence", "definition_tags", "idx", "alias", "pos_filter", "use_deinflections", "allow_secondary")


def _first_met(hits: DataFrame, language: str) -> DataFrame:
    """Of candidates with the rows they meet those that count: a row belongs to the first text that reaches it, and isn't tried for another text, even if its part of speech
    then fails."""
    w = Window.partitionBy("query_id", "id").orderBy("ord", F.when(F.col("match_source") == "term", 0).otherwise(1))
    first = F.first(F.struct("base", "match_source")).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    hits = hits.withColumn("_first", first).where((F.col("base") == F.col("_first.base")) & (F.col("match_source") == F.col("_first.match_source"))).drop("_first")
    return hits.where(~F.col("pos_filter") | part_of_speech_passes(F.col("flags"), rule_flags(F.col("rules"), language)))


def redirected(hits: DataFrame) -> DataFrame:
    """Candidates that redirecting definitions of hits name, after all others; their chains go on from the hit's."""
    named = hits.where("use_deinflections").select("query_id", "ord", "id", "original_text", "transformed_text", "text_chains", "inflections", F.posexplode("redirects").alias("_k", "_d"))
    named = named.withColumn("base", F.get_json_object("_d", "$[0]")).where("base <> ''")
    rules = F.coalesce(F.from_json(F.get_json_object("_d", "$[1]"), "array<string>"), F.array().cast("array<string>"))
    longer = F.transform("inflections", lambda c: F.struct(F.when(F.size(c["rules"]) == 0, "dictionary").otherwise("both").alias("source"), F.concat(c["rules"], rules).alias("rules")))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("ord", "id", "_k"))
    order = F.struct((F.lit(1 << 30) + place).alias("o1"), *(F.lit(0).alias(f"o{k}") for k in (2, 3, 4)))
    return named.select("query_id", order.alias("ord"), "original_text", "transformed_text", "base", F.lit(0).alias("flags"), "text_chains", longer.alias("inflections"))


def entries(found: DataFrame, own: DataFrame, language: str, primary_reading: str = "", redirects: bool = True, met: DataFrame | None = None) -> DataFrame:
    """One row of each query and slim term: by the first candidate of the longest text, chains of ties merged.

    Redirects are followed once, if any term has them; terms that only redirect are no entries. `met` are the candidates
    with the rows they meet, if the caller has them.
    """
    hits = _first_met(exact_hits(found, own, "base") if met is None else met, language)
    if redirects:
        hits = hits.unionByName(_first_met(exact_hits(redirected(hits), own, "base"), language))
    hits = hits.where(F.col("content").isNotNull())
    longest = F.max(F.length("transformed_text")).over(Window.partitionBy("query_id", "id"))
    hits = hits.withColumn("_longest", longest).withColumn("_place", F.min("ord").over(Window.partitionBy("query_id", "id")))
    hits = hits.where(F.length("transformed_text") == F.col("_longest"))
    first = lambda c: F.min_by(c, "ord").alias(c)
    scalars = ("original_text", "transformed_text", "base", "match_source", "dictionary", "expression", "reading", "score", "sequence", "content", "definition_tags", "idx", "alias", "rules", "allow_secondary")
    gathered = F.array_sort(F.collect_list(F.struct("ord", "text_chains", "inflections")))
    out = hits.groupBy("query_id", "id").agg(F.min("_place").alias("ord"), *map(first, scalars), gathered.alias("_all"))
    text_chains = F.flatten(F.transform("_all", lambda c: c["text_chains"]))
    chains = F.flatten(F.transform("_all", lambda c: c["inflections"]))
    out = out.withColumns({"text_chains": distinct_chains(text_chains), "chains": merged_chains(chains)})
    return shaped(out, primary_reading).withColumns({"primary": F.lit(True), "exact": (F.col("base") == F.col("expression")).cast("int")}).drop("_all")


def distinct_chains(chains: Column) -> Column:
    """The first of those that have the same members, whatever their order."""
    empty = F.array().cast(NO_CHAINS)
    add = lambda out, c: F.when(F.exists(out, lambda o: F.array_sort(o) == F.array_sort(c)), out).otherwise(F.concat(out, F.array(c)))
    return F.aggregate(chains, empty, add)


def merged_chains(chains: Column) -> Column:
    """The first of those whose rules have the same members; found by different sources, it is of both."""
    alike = lambda a, b: F.array_sort(a["rules"]) == F.array_sort(b["rules"])
    both = lambda o, c: F.struct(F.when(alike(o, c) & (o["source"] != c["source"]), "both").otherwise(o["source"]).alias("source"), o["rules"].alias("rules"))
    add = lambda out, c: F.when(F.exists(out, lambda o: alike(o, c)), F.transform(out, lambda o: both(o, c))).otherwise(F.concat(out, F.array(c)))
    return F.aggregate(chains, F.array().cast(INFLECTIONS), add)


def _read() -> Column:
    return F.when(F.coalesce(F.length("reading"), F.lit(0)) == 0, F.col("expression")).otherwise(F.col("reading"))


def shaped(rows: DataFrame, primary_reading: str) -> DataFrame:
    """A missing reading is the expression itself."""
    return rows.withColumn("reading", _read()).withColumn("primary_reading", (F.lit(primary_reading) != "") & (F.col("reading") == primary_reading))


def related_row(terms: DataFrame, text: Column, primary_reading: str) -> DataFrame:
    """Terms that come by another term of their group, not by the query: not primary, without chains."""
    out = terms.withColumns({"original_text": text, "transformed_text": text, "base": text, "match_source": F.lit("term"), "text_chains": F.array().cast(NO_CHAINS), "chains": F.array().cast(INFLECTIONS)})
    return shaped(out, primary_reading).withColumns({"primary": F.lit(False), "exact": F.lit(0)})


def headwords_of(rows: DataFrame, by: list[str]) -> DataFrame:
    """by, headwords (primary ones first, then by dictionary, then by place), exact: headwords that the query met by
    their expression, primary_reading."""
    source = F.struct("original_text", "transformed_text", "base", "match_source", "primary")
    heads = rows.groupBy(*by, "expression", "norm_reading").agg(
        F.min("place").alias("place"), F.min_by("reading", "place").alias("reading"), F.min("idx").alias("idx"), F.max("primary").alias("primary"), F.max("primary_reading").alias("primary_reading"),
        F.max((F.col("primary") & (F.col("match_source") == "term")).cast("int")).alias("exact"), F.array_sort(F.collect_set(source)).alias("sources"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("rules")))).alias("classes"),
    )
    order = F.struct((~F.col("primary")).alias("later"), "idx", "place", "expression", "norm_reading", "reading", "sources", "classes")
    shown = F.transform(F.array_sort(F.collect_list(order)), lambda h: h.dropFields("later", "place"))
    return heads.groupBy(*by).agg(shown.alias("headwords"), F.sum("exact").alias("exact"), F.max("primary_reading").alias("primary_reading"))


def definitions_of(rows: DataFrame, by: list[str], once: bool) -> DataFrame:
    """by, definitions by place, each with the (expression, reading) it belongs to; `once` joins those of equal content."""
    whole = ("place", "id", "dictionary", "idx", "alias", "score", "primary", "sequences", "tags", "heads")
    if once:
        keep = [F.min_by(n, "place").alias(n) for n in ("id", "idx", "alias", "score")]
        each = rows.groupBy(*by, "dictionary", "content").agg(
            F.min("place").alias("place"), *keep, F.max("primary").alias("primary"), F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("place", "sequence"))), lambda x: x["sequence"])).alias("sequences"),
            F.collect_set(F.struct("expression", "norm_reading")).alias("heads"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("definition_tags")))).alias("tags"),
        )
    else:  # a term is in its group once
        each = rows.withColumns({"sequences": F.array("sequence"), "heads": F.array(F.struct("expression", "norm_reading")), "tags": F.array_sort(F.array_distinct("definition_tags"))})
    return each.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(*whole))).alias("definitions"))


def definition_order(definitions: Column) -> Column:
    """By frequency, dictionary, score, number and places of headwords, then as they came."""
    key = lambda d: F.struct(d["frequency_order"].alias("f"), d["idx"].alias("i"), (-d["score"]).alias("s"), (-F.size(d["headword_indices"])).alias("n"), d["headword_indices"].alias("h"), d["place"].alias("p"), d.alias("d"))
    return F.transform(F.array_sort(F.transform(definitions, key)), lambda x: x["d"])


def groups_of(rows: DataFrame, by: list[str], once: bool = False) -> DataFrame:
    """Rows of one group become one entry. `rows` has place: the order within the group. They are dealt by group once,
    which is what all three aggregates and their joins need."""
    rows = rows.repartition(*by)
    best = lambda c: F.min_by(F.when(F.col("primary"), F.col(c)), F.when(F.col("primary"), F.struct(F.size(c), "place")))
    merged = rows.groupBy(*by).agg(
        F.max("score").alias("score"), F.min("idx").alias("dictionary_index"), F.max(F.when(F.col("primary"), F.length("original_text")).otherwise(0)).alias("max_length"), F.max("primary").alias("primary"),
        F.coalesce(best("text_chains"), F.array().cast(NO_CHAINS)).alias("text_chains"), F.coalesce(best("chains"), F.array().cast(INFLECTIONS)).alias("chains"), F.min("ord").alias("ord"),
    )
    out = merged.join(headwords_of(rows, by), by).join(definitions_of(rows, by, once), by)
    heads = F.transform("headwords", lambda h: F.struct(h["expression"].alias("expression"), h["norm_reading"].alias("norm_reading")))
    indices = lambda d: F.array_sort(F.transform(d["heads"], lambda h: (F.array_position("_heads", h) - 1).cast("int")))
    numbered = F.transform("definitions", lambda d, k: d.withField("headword_indices", indices(d)).withField("frequency_order", F.lit(0).cast("long")).withField("place", k).dropFields("heads"))
    return out.withColumn("_heads", heads).withColumn("definitions", definition_order(numbered)).drop("_heads")


def singles(rows: DataFrame) -> DataFrame:
    """Each row as an entry of its own."""
    source = F.struct("original_text", "transformed_text", "base", "match_source", "primary")
    head = F.struct("idx", "expression", "norm_reading", "reading", F.array(source).alias("sources"), F.array_sort(F.array_distinct("rules")).alias("classes"))
    definition = F.struct(
        F.lit(0).alias("place"), "id", "dictionary", "idx", "alias", "score", "primary", F.array("sequence").alias("sequences"), F.array_sort(F.array_distinct("definition_tags")).alias("tags"),
        F.array(F.lit(0)).alias("headword_indices"), F.lit(0).cast("long").alias("frequency_order"),
    )
    return rows.select("query_id", "score", F.col("idx").alias("dictionary_index"), F.length("original_text").alias("max_length"), "primary", "text_chains", "chains", "ord", F.array(head).alias("headwords"), "exact", "primary_reading", F.array(definition).alias("definitions"))


def grouped(rows: DataFrame, mode: str = "group", language: str = "") -> DataFrame:
    """Entries of one headword (group), one term (term), or as they are (simple or unknown modes); entries of different
    inflection chains stay apart."""
    own = rows.withColumn("norm_reading", normalised_reading(F.col("reading"), language)).withColumn("place", F.struct("ord", "id"))
    keys = {"group": ["expression", "norm_reading"], "term": ["expression"]}.get(mode)
    if keys is None:
        return singles(own)
    return groups_of(own.withColumn("_group", F.to_json(F.struct(*keys, "chains"))), ["query_id", "_group"]).drop("_group")


def related_by_sequence(rows: DataFrame, terms: DataFrame, main_dictionary: str) -> DataFrame:
    """Terms of the main dictionary that share a sequence with an entry, without those that are entries already."""
    seeds = rows.where((F.col("dictionary") == main_dictionary) & (F.col("sequence") >= 0)).select("query_id", "sequence").distinct()
    found = seeds.join(terms.where(F.col("dictionary") == main_dictionary), "sequence")
    return found.join(rows.select("query_id", "id").distinct(), ["query_id", "id"], "left_anti")


def related_by_headword(rows: DataFrame, terms: DataFrame, by: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """Terms with an entry's expression and reading, once in a group (`by`), without those that are entries already."""
    asked = rows.select(*by, "expression", "reading").distinct()
    found = exact_pairs(asked, terms).dropDuplicates([*by, "id"])
    return found.join(rows.select(*by, "id").distinct(), [*by, "id"], "left_anti")


def sequence_members(sequences: DataFrame, own: DataFrame, main_dictionary: str) -> DataFrame:
    """What each sequence (_sequence) of the main dictionary brings into a group, whoever asks for it: its terms (phase 0),
    and terms that have a term's expression and reading in dictionaries open to secondary searches (phase 2)."""
    main = own.where(F.col("dictionary") == main_dictionary).join(sequences, F.col("sequence") == F.col("_sequence"))
    second = related_by_headword(main, own.where("allow_secondary"), ("_sequence",))
    return main.withColumn("phase", F.lit(0)).unionByName(second.withColumn("phase", F.lit(2)).select("phase", *main.columns))


def merged(rows: DataFrame, own: DataFrame, main_dictionary: str, language: str = "", primary_reading: str = "") -> DataFrame:
    """Entries (`rows`, written) of the main dictionary are grouped by sequence. A group gets the dictionary's other terms
    of that sequence; entries of other dictionaries that have a term and reading of the group; and terms of dictionaries
    open to secondary searches that have one. Definitions of equal content are joined. Other entries are grouped by
    headword.

    What a sequence brings is found once, not for each query that asks for it; queries join it by its number.
    """
    spelled = lambda df: df.withColumn("norm_reading", normalised_reading(F.col("reading"), language))
    key = ["query_id", "_sequence"]
    is_main = (F.col("dictionary") == main_dictionary) & (F.col("sequence") >= 0)
    rows = spelled(rows)
    seeds, others = rows.where(is_main).withColumn("_sequence", F.col("sequence")), rows.where(~is_main)
    asked = seeds.select(*key).distinct()
    members = sequence_members(asked.select("_sequence").distinct(), own, main_dictionary)
    members = written(spelled(related_row(members, F.col("expression"), primary_reading)))

    heads = asked.join(members.where("phase = 0").select("_sequence", "expression", "norm_reading").distinct().hint("merge"), "_sequence")
    joined = others.join(heads.hint("merge"), ["query_id", "expression", "norm_reading"])
    wanted = [*key, "id", "ord", "original_text", "transformed_text", "base", "match_source", "dictionary", "expression", "reading", "norm_reading", "score", "sequence", "content", "definition_tags", "idx", "alias", "rules", "text_chains", "chains", "primary", "primary_reading", "exact"]
    entered = written(seeds.withColumn("phase", F.lit(0)).select(*wanted, "phase").unionByName(joined.withColumn("phase", F.lit(1)).select(*wanted, "phase")))
    last = F.struct(*(F.lit(2**31 - 1).alias(f"o{k}") for k in range(1, 5)))
    brought = asked.join(members.hint("merge"), "_sequence").join(entered.select(*key, "id").hint("merge"), [*key, "id"], "left_anti").withColumn("ord", last)
    groups = entered.unionByName(brought.select(*wanted, "phase")).withColumn("place", F.struct("phase", "id", F.col("ord").alias("at")))
    groups = groups_of(groups.where(F.col("content").isNotNull()), key, True).drop("_sequence")
    left = others.join(joined.select("query_id", "id").distinct(), ["query_id", "id"], "left_anti")
    return groups.unionByName(grouped(left.drop("norm_reading"), "group", language))


#: Groups that are kept in one row of a list, and texts that are met with such a row in one place.
LISTED, MET = 512, 2048
#: Candidates that are sent to all tasks; more are dealt.
FEW = 50_000
#: What terms of one group share, by mode.
APART = {"term": ("expression",)}


def _clustered(rows: DataFrame, mode: str, sequences: DataFrame | None) -> DataFrame:
    """Rows of `expression` and `_norm` with `_cluster`: groups of a text never have terms of different clusters. Merged
    groups have those of a sequence together (`sequences`: expression, _norm, _sequence)."""
    alone = F.to_json(F.struct(*APART.get(mode, ("expression", "_norm"))))
    if sequences is None:
        return rows.withColumn("_cluster", alone)
    met = rows.join(sequences.hint("merge"), ["expression", "_norm"], "left")
    return met.withColumn("_cluster", F.coalesce(F.col("_sequence").cast("string"), alone)).drop("_sequence")


def _lists(groups: DataFrame, reached: DataFrame) -> DataFrame:
    """Ranked groups of prefixes (`_prefix`, `_cluster`), as lists by the text they are met by (`_text`): of each row of a
    list (`_chunk`) its columns as arrays, `_n`, and in `_cond` the groups that not each text that begins with `_text` has:
    those of longer prefixes, and those that a still longer prefix would give anew."""
    several = reached.groupBy("_cluster").agg(F.collect_list("_prefix").alias("_all")).where(F.size("_all") > 1)
    own = groups.join(several.hint("merge"), "_cluster", "left").withColumn("_not", F.filter("_all", lambda x: (x != F.col("_prefix")) & F.startswith(x, F.col("_prefix"))))
    own = own.withColumns({"_not": F.coalesce("_not", F.array().cast("array<string>")), "_text": F.left("_prefix", F.col("max_length"))})
    ord_ = F.when(F.col("ord.o1") < 1 << 30, F.col("ord.o1") - F.length("_prefix")).otherwise(F.col("ord.o1"))  # whatever the text
    own = ranked(own.withColumn("ord", F.col("ord").withField("o1", ord_)), "_text").withColumnRenamed("rank", "_place")
    shown = [c for c in groups.columns if c not in ("_prefix", "_cluster")] + ["text_chain_length", "chain_length"]
    item = F.struct("_place", "_prefix", "_not", *shown)
    out = own.groupBy("_text", ((F.col("_place") - 1) / LISTED).cast("int").alias("_chunk")).agg(F.sort_array(F.collect_list(item)).alias("_items"))
    given = F.transform("_items", lambda x, k: F.struct(k.alias("k"), x["_prefix"].alias("need"), x["_not"].alias("not")))
    cond = F.filter(given, lambda x: (x["need"] != F.col("_text")) | (F.size(x["not"]) > 0))
    return out.select("_text", "_chunk", F.size("_items").alias("_n"), cond.alias("_cond"), *(F.col(f"_items.{c}").alias(c) for c in shown))


def found_by_prefix(queries: DataFrame, own: DataFrame, language: str, mode: str, replacements: tuple = (), longest: bool = False, main_dictionary: str = "", unmet: bool = False) -> DataFrame | None:
    """Ranked groups where no definition redirects; None if groups of the main dictionary's sequences overlap.

    What a text finds of a cluster of terms depends on its prefixes that reach the cluster, and all of these are prefixes
    of the longest one. So groups are made and ranked once for each prefix that reaches a cluster, of the candidates of
    its own prefixes, and a text gets those of its prefixes, except of clusters that a longer one reaches. Lists of
    groups meet texts as they are; no row of a text's groups is dealt or sorted.
    """
    spelled = lambda df: df.withColumn("_norm", normalised_reading(_read(), language))
    sequences = None
    if mode == "merge":
        main = spelled(own.where((F.col("dictionary") == main_dictionary) & (F.col("sequence") >= 0)))
        sequences = written(main.groupBy("expression", "_norm").agg(F.min("sequence").alias("_sequence"), F.max("sequence").alias("_most")))
        if not sequences.where("_sequence <> _most").isEmpty():
            return None
        sequences = sequences.drop("_most")
    asked = queries.where(F.length("text") > 0)
    sources = asked.select("query_id", "text", F.explode(lookup_prefixes(F.col("text"))).alias("_text"))
    alone = sources.select("_text").distinct().select(F.col("_text").alias("query_id"), F.lit(0).alias("o1"), F.col("_text").alias("original_text"))
    forms = written(_candidates_of(alone, language, replacements))
    by = F.broadcast(forms) if forms.count() <= FEW else forms.hint("merge")  # by count: a table's size on disk says little
    met = exact_hits(by, own, "base").withColumnRenamed("query_id", "_from")
    met = written(_clustered(spelled(met), mode, sequences).drop("_norm"))
    reached = written(met.select(F.col("_from").alias("_prefix"), "_cluster").distinct())
    within = reached.join(reached.hint("merge").withColumnRenamed("_prefix", "_from"), "_cluster").where(F.startswith("_prefix", "_from"))
    hits = within.join(met.hint("merge"), ["_from", "_cluster"]).withColumn("ord", F.col("ord").withField("o1", (F.length("_prefix") - F.length("_from")).cast("int")))
    rows = written(entries(forms, own, language, "", False, hits.drop("_from", "_cluster").withColumnRenamed("_prefix", "query_id")))
    groups = merged(rows, own, main_dictionary, language) if mode == "merge" else grouped(rows, mode, language)
    groups = written(groups.withColumnRenamed("query_id", "_prefix"))
    head = F.col("headwords")[0]
    groups = _clustered(groups.withColumns({"expression": head["expression"], "_norm": head["norm_reading"]}), mode, sequences).drop("expression", "_norm")
    lists = written(_lists(groups, reached))

    asks = sources.groupBy("_text").agg(F.ceil(F.count("*") / MET).cast("int").alias("_shares"))
    sizes = written(lists.groupBy("_text").agg(F.count("*").cast("int").alias("_chunks")).join(asks.hint("merge"), "_text"))
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    place = ["_text", "_chunk", "_share"]
    spark = queries.sparkSession
    tasks = max(TASKS_A_CORE * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    each = sources.join(sizes.hint("merge"), "_text").select("query_id", "text", "_text", upto("_chunks").alias("_chunk"), F.pmod(F.xxhash64("query_id"), F.col("_shares")).cast("int").alias("_share"))
    dealt = lists.join(sizes.hint("merge"), "_text").withColumn("_share", upto("_shares")).drop("_chunks", "_shares").repartition(tasks, *place)
    gone = F.filter("_cond", lambda x: ~F.startswith(F.col("text"), x["need"]) | F.exists(x["not"], lambda o: F.startswith(F.col("text"), o)))
    some = each.repartition(tasks, *place).join(dealt.select(*place, "_n", "_cond").hint("merge"), place).select(*each.columns, (F.col("_n") - F.size(gone)).alias("_kept")).where("_kept > 0")
    if longest:
        some = some.withColumn("_most", F.max(F.length("_text")).over(Window.partitionBy("query_id"))).where(F.length("_text") == F.col("_most")).drop("_most")
    before = F.sum("_kept").over(Window.partitionBy("query_id").orderBy(F.length("_text").desc(), "_chunk")) - F.col("_kept")
    some = written(some.withColumn("_before", before).drop("_kept"))
    shown = [c for c in lists.columns if c not in ("_text", "_chunk", "_n", "_cond")]
    whole = some.repartition(tasks, *place).join(dealt.hint("merge"), place)
    every = F.sequence(F.lit(0), F.col("_n") - 1)
    left = F.when(F.size("_cond") == 0, every).otherwise(F.array_except(every, F.transform(gone, lambda x: x["k"])))
    whole = whole.select("query_id", "text", "_before", *shown, left.alias("_left"))  # apart from the generator, which then is compiled and copies no lists
    out = whole.select("query_id", "text", "_before", *shown, F.posexplode("_left").alias("_j", "_i"))
    out = out.select("query_id", *(F.col(c)[F.col("_i")].alias(c) for c in shown), (F.col("_before") + F.col("_j") + 1).cast("int").alias("rank"), F.length("text").alias("_length"))
    out = out.withColumn("ord", F.col("ord").withField("o1", F.when(F.col("ord.o1") < 1 << 30, F.col("ord.o1") + F.col("_length")).otherwise(F.col("ord.o1")))).drop("_length")
    if unmet:
        out = out.unionByName(queries.select("query_id").join(some.select("query_id").distinct(), "query_id", "left_anti"), allowMissingColumns=True)
    return out


def reaching(texts: DataFrame, terms: DataFrame, language: str, replacements: tuple = ()) -> DataFrame:
    """text, reach: of each distinct text that reaches a term, the longest prefix that does. A lookup of the text finds
    what one of this prefix finds."""
    sources = texts.select("text").distinct().select("text", F.explode(lookup_prefixes(F.col("text"))).alias("original_text"))
    forms = forms_of(sources, language, "original_text", replacements).select("original_text", F.col("base").alias("_key"))
    met = forms.join(keyed(terms.select("expression", "reading")).select("_key"), "_key", "left_semi").select("original_text").distinct()
    return sources.join(met, "original_text").groupBy("text").agg(F.max_by("original_text", F.length("original_text")).alias("reach"))


def without_dictionaries(groups: DataFrame, excluded: list[str]) -> DataFrame:
    """Definitions of other dictionaries; headwords without a definition go and the others are numbered anew; groups that
    lose all of their definitions go."""
    kept = groups.withColumn("definitions", F.filter("definitions", lambda d: ~d["dictionary"].isin(excluded))).where(F.size("definitions") > 0)
    if "headword_indices" not in groups.schema["definitions"].dataType.elementType.names:
        return kept
    kept = kept.withColumn("_used", F.array_sort(F.array_distinct(F.flatten(F.transform("definitions", lambda d: d["headword_indices"])))))
    numbered = F.transform("definitions", lambda d: d.withField("headword_indices", F.transform(d["headword_indices"], lambda i: (F.array_position("_used", i) - 1).cast("int"))))
    changed = {"headwords": F.filter("headwords", lambda h, i: F.array_contains("_used", i)), "definitions": numbered}
    for said in {"frequencies", "pronunciations"}.intersection(groups.columns):
        own = F.filter(said, lambda x: ~x["dictionary"].isin(excluded) & F.array_contains("_used", x["headword_index"]))
        changed[said] = F.transform(own, lambda x: x.withField("headword_index", (F.array_position("_used", x["headword_index"]) - 1).cast("int")))
    return kept.withColumns(changed).drop("_used")


def with_metadata(groups: DataFrame, meta: DataFrame, enabled: DataFrame) -> DataFrame:
    """Ranked groups with what metadata (dictionary, id, expression, mode, data, meta_reading) say of their headwords, by
    headword, dictionary and place: frequencies, and pronunciations (pitch accents and transcriptions, as JSON)."""
    own = meta.join(enabled.select(F.col("title").alias("dictionary"), "idx", "alias"), "dictionary")
    heads = groups.select("query_id", "rank", F.posexplode("headwords").alias("headword_index", "_h")).select("query_id", "rank", "headword_index", "_h.expression", "_h.reading")
    met = metadata.with_term_meta(heads, own).withColumn("_f", metadata.frequency_value(F.col("data")))
    place, shared = ("headword_index", "idx", "id"), ("dictionary", "alias")
    frequency = F.struct(*place, *shared, F.col("meta_reading").isNotNull().alias("has_reading"), F.col("_f.value").alias("frequency"), F.col("_f.display").alias("display"))
    said = F.struct(*place, *shared, "mode", "data")
    by_mode = {"frequencies": F.when(F.col("mode") == "freq", frequency), "pronunciations": F.when(F.col("mode") != "freq", said)}
    told = met.groupBy("query_id", "rank").agg(*(F.sort_array(F.collect_list(x)).alias(n) for n, x in by_mode.items()))
    out = groups.join(told, ["query_id", "rank"], "left")
    return out.withColumns({n: F.coalesce(n, F.array().cast(told.schema[n].dataType)) for n in by_mode})


def frequency_order(groups: DataFrame, frequencies: DataFrame, ascending: bool = True) -> DataFrame:
    """Adds frequency_order by one dictionary's (expression, reading, frequency, ord): the last value of a headword
    counts; ascending takes the least, descending the greatest with its sign turned, so that less comes first.
    Definitions that know their headwords are put in the same order."""
    last = frequencies.groupBy("expression", "reading").agg(F.max_by("frequency", "ord").alias("frequency"))
    value = F.coalesce("frequency", F.lit(LAST_ASCENDING)) if ascending else -F.coalesce("frequency", F.lit(LAST_DESCENDING))
    heads = groups.select("query_id", "ord", F.posexplode("headwords").alias("_k", "h")).select("query_id", "ord", "_k", "h.expression", "h.reading").join(last, ["expression", "reading"], "left")
    values = heads.groupBy("query_id", "ord").agg(F.array_sort(F.collect_list(F.struct("_k", value.cast("long").alias("v")))).alias("_values"))
    out = groups.join(values, ["query_id", "ord"], "left").withColumn("frequency_order", F.array_min(F.transform("_values", lambda x: x["v"])))
    if "definitions" in groups.columns and "headword_indices" in groups.schema["definitions"].dataType.elementType.names:
        own = lambda d: F.array_min(F.transform(d["headword_indices"], lambda i: F.element_at("_values", i + 1)["v"]))
        out = out.withColumn("definitions", definition_order(F.transform("definitions", lambda d: d.withField("frequency_order", own(d)))))
    return out.drop("_values")


def ranked(groups: DataFrame, by: str = "query_id") -> DataFrame:
    """Adds rank, from 1, within a query (`by`): by reading, length of the text, shortest chains, exact hits, frequency,
    dictionary, score, headwords (longer ones first, then by English collation) and number of definitions."""
    shortest = lambda chains, size: F.coalesce(F.array_min(F.transform(chains, size)), F.lit(0))
    out = groups.withColumns({"text_chain_length": shortest("text_chains", F.size), "chain_length": shortest("chains", lambda c: F.size(c["rules"]))})
    heads = F.array_distinct(F.transform("headwords", lambda h: F.struct((-F.length(h["expression"])).alias("n"), F.collate(h["expression"], "en").alias("t"))))
    order = [F.col("primary_reading").desc(), F.col("max_length").desc(), F.col("text_chain_length").asc(), F.col("chain_length").asc(), F.col("exact").desc()]
    if "frequency_order" in groups.columns:
        order.append(F.col("frequency_order").asc())
    order += [F.col("dictionary_index").asc(), F.col("score").desc(), heads.asc(), F.size("definitions").desc(), F.col("ord").asc(), F.col("definitions")[0]["id"].asc()]
    return out.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*order)))


def with_definitions(groups: DataFrame, terms: DataFrame) -> DataFrame:
    """Ranked groups with what their terms say: definitions that redirect are left out."""
    said = terms.select(F.col("dictionary").alias("_dictionary"), F.col("id").alias("_id"), F.filter("definitions", lambda d: ~is_redirect(d)).alias("_said"))
    each = groups.select("query_id", "rank", F.posexplode("definitions").alias("_k", "_d"))
    met = each.join(said, (F.col("_d.id") == F.col("_id")) & (F.col("_d.dictionary") == F.col("_dictionary")))
    whole = F.sort_array(F.collect_list(F.struct("_k", F.col("_d").withField("definitions", F.col("_said")).alias("d"))))
    filled = met.groupBy("query_id", "rank").agg(F.transform(whole, lambda x: x["d"]).alias("definitions"))
    return groups.drop("definitions").join(filled, ["query_id", "rank"])


def find_terms(
    queries: DataFrame, terms: DataFrame, enabled: DataFrame, language: str = "en", mode: str = "group", deinflect: bool = True, by: str = "letter", replacements: tuple = (), excluded: list[str] | None = None,
    frequencies: DataFrame | None = None, ascending: bool = True, main_dictionary: str = "", primary_reading: str = "", remove_non_japanese: bool = False, redirects: bool | None = None, definitions: bool = True, meta: DataFrame | None = None, longest: bool = False, unmet: bool = False,
) -> DataFrame:
    """The whole lookup: ranked groups of entries of each query (query_id, text); with `meta` also the frequencies and
    pronunciations of their headwords, without those of `excluded` dictionaries.

    `redirects` says whether terms redirect at all, if the caller knows; otherwise they are asked. Without `definitions`
    what the terms say is not fetched: their ids and all that is known of them stay. `longest` leaves the groups of the
    longest text of a query that has any. With `unmet` queries without a hit stay, with null columns.
    """
    if remove_non_japanese and language == "ja":
        queries = queries.withColumn("text", F.regexp_extract("text", f"^[{JAPANESE}]*", 0))
    own = written(slim(terms, enabled))
    if redirects is None:
        redirects = not own.where(F.size("redirects") > 0).isEmpty()
    if deinflect and by == "letter" and not (redirects or primary_reading or excluded) and frequencies is None:
        slim_only = meta is None and not definitions
        out = found_by_prefix(queries, own, language, mode, replacements, longest, main_dictionary, unmet and slim_only)
        if out is not None:
            out = _told(out, terms, enabled, meta, excluded, definitions)
            return queries.select("query_id").join(out, "query_id", "left") if unmet and not slim_only else out
    rows = entries(candidates(queries, language, deinflect, by, replacements), own, language, primary_reading, redirects)
    rows = rows if mode in ("simple", "") else written(rows)  # groups are made of several aggregates
    groups = merged(rows, own, main_dictionary, language, primary_reading) if mode == "merge" else grouped(rows, mode, language)
    if excluded:
        groups = without_dictionaries(groups, excluded)
    if frequencies is not None:
        groups = frequency_order(groups, frequencies, ascending)
    if longest:
        most = F.max("max_length").over(Window.partitionBy("query_id"))
        groups = groups.withColumn("_most", most).where("max_length = _most").drop("_most")
    out = _told(ranked(groups), terms, enabled, meta, excluded, definitions)
    return queries.select("query_id").join(out, "query_id", "left") if unmet else out


def _told(out: DataFrame, terms: DataFrame, enabled: DataFrame, meta: DataFrame | None, excluded: list[str] | None, definitions: bool) -> DataFrame:
    """Ranked groups with metadata and definitions, if these are asked for."""
    if meta is not None:
        out = with_metadata(written(out), meta.where(~F.col("dictionary").isin(excluded or [])), enabled)
    return with_definitions(written(out), enabled_only(terms, enabled)) if definitions else out


def batch_lookup(texts: DataFrame, terms: DataFrame, enabled: DataFrame, **options) -> DataFrame:
    """Each distinct text looked up once; texts without a hit stay, with null columns. Texts that are distinct already,
    and nothing else, aren't joined to what they find, which may be far more than all texts."""
    distinct = texts.select("text").where(F.col("text").isNotNull()).distinct().withColumn("query_id", F.col("text"))
    if texts.columns == ["text"] and texts.groupBy("text").count().where("count > 1").isEmpty():
        found = find_terms(distinct, terms, enabled, unmet=True, **options).withColumnRenamed("query_id", "text")
        return found.unionByName(texts.where(F.col("text").isNull()), allowMissingColumns=True)
    found = find_terms(distinct, terms, enabled, **options)
    return texts.join(found.withColumnRenamed("query_id", "text"), "text", "left")

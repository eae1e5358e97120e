"""The rewrite closure over whole columns: distinct texts only, rules shipped to the tasks once."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from glossaria.functions.processors import AFTER, LANGUAGES, variants
from glossaria.functions.rule_sets import rule_set
from glossaria.functions.rules import MAX_DEPTH, Form, RuleSet

TASKS_A_CORE = 4
FORM = "text string, ord int, base string, flags int, inflections array<string>"


def _dealt(texts: DataFrame, column: str) -> DataFrame:
    """The distinct texts as `text`, dealt to all cores: texts are few bytes, and Spark would join them into few tasks, but
    each costs as much as its rewrites."""
    words = texts.select(F.col(column).alias("text")).where(F.col("text").isNotNull()).distinct()
    return words.repartition(TASKS_A_CORE * texts.sparkSession.sparkContext.defaultParallelism, "text")


def closure_of(texts: DataFrame, language: str, column: str = "text", max_depth: int = MAX_DEPTH) -> DataFrame:
    """text, ord (breadth first), base, flags, inflections (latest first) of each distinct text; a language without
    rules gives the text itself."""
    rules: RuleSet | None = rule_set(language)
    if rules is None:
        words = texts.select(F.col(column).alias("text")).where(F.col("text").isNotNull()).distinct()
        return words.select("text", F.lit(0).alias("ord"), F.col("text").alias("base"), F.lit(0).alias("flags"), F.array().cast("array<string>").alias("inflections"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(t, k, f.text, f.flags, [name for name, *_ in f.trace]) for t in batch.column("text").to_pylist() for k, f in enumerate(rules.closure(t, max_depth))]
            types = (pa.string(), pa.int32(), pa.string(), pa.int32(), pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=["text", "ord", "base", "flags", "inflections"])

    return _dealt(texts, column).mapInArrow(run, FORM)


FORMS = "original_text string, o2 int, o3 int, o4 int, transformed_text string, base string, flags int, text_chains array<array<string>>, inflections array<struct<source:string,rules:array<string>>>"


def forms_of(texts: DataFrame, language: str, column: str, replacements: tuple = ()) -> DataFrame:
    """Of each distinct text: its variants (o2), their rewrites (o3) and the variants of these (o4), with the chains of
    processors and rules that lead there. A language without processors and rules gives the text itself, without Python."""
    rules = rule_set(language)
    if rules is None and not replacements and language not in LANGUAGES and language not in AFTER:
        chain = F.array(F.struct(F.lit("algorithm").alias("source"), F.array().cast("array<string>").alias("rules")))
        zero = (F.lit(0).alias(f"o{k}") for k in (2, 3, 4))
        words = texts.select(F.col(column).alias("text")).where(F.col("text").isNotNull()).distinct()
        return words.select(F.col("text").alias("original_text"), *zero, F.col("text").alias("transformed_text"), F.col("text").alias("base"), F.lit(0).alias("flags"), F.array(F.array().cast("array<string>")).alias("text_chains"), chain.alias("inflections"))

    def forms(text: str) -> Iterator[tuple]:
        for o2, (variant, before) in enumerate(variants(text, language, replacements).items()):
            for o3, form in enumerate(rules.closure(variant) if rules else [Form(variant, 0, ())]):
                for o4, (base, after) in enumerate(variants(form.text, language, after=True).items()):
                    yield text, o2, o3, o4, variant, base, form.flags, [[*x, *y] for x in before for y in after], [{"source": "algorithm", "rules": [name for name, *_ in form.trace]}]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in FORMS.split(", ")]
        chain = pa.list_(pa.struct([("source", pa.string()), ("rules", pa.list_(pa.string()))]))
        kinds = (pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.int32(), pa.list_(pa.list_(pa.string())), chain)
        for batch in batches:
            rows = [f for t in batch.column("text").to_pylist() for f in forms(t)]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=names)

    return _dealt(texts, column).mapInArrow(run, FORMS)


def suffix_rules(spark, language: str) -> DataFrame:
    """A language's affix rules as a table: transform, kind, inflected, base, inner, outer (flags)."""
    rules = rule_set(language)
    rows = [(name, r.kind, r.inflected, r.base, rules.flags_of(r.inner), rules.flags_of(r.outer)) for name, rs in rules.transforms.items() for r in rs if r.kind in ("suffix", "prefix", "whole")]
    return spark.createDataFrame(rows, "transform string, kind string, inflected string, base string, inner int, outer int")


def one_step(words: DataFrame, rules: DataFrame, text: str = "text", flags: str = "flags") -> DataFrame:
    """All single rewrites of (text, flags) by suffix and prefix rules, as an equi-join on the word's ends."""
    n = F.length(text)
    ends = words.select("*", F.explode(F.transform(F.sequence(F.lit(0), n), lambda k: F.struct(F.lit("suffix").alias("kind"), F.right(F.col(text), k).alias("inflected")))).alias("_e"))
    starts = words.select("*", F.explode(F.transform(F.sequence(F.lit(0), n), lambda k: F.struct(F.lit("prefix").alias("kind"), F.left(F.col(text), k).alias("inflected")))).alias("_e"))
    wholes = words.select("*", F.struct(F.lit("whole").alias("kind"), F.col(text).alias("inflected")).alias("_e"))
    tried = ends.unionByName(starts).unionByName(wholes).select("*", "_e.*").drop("_e")
    met = tried.join(rules, ["kind", "inflected"]).where((F.col(flags) == 0) | (F.col(flags).bitwiseAND(F.col("inner")) != 0))
    size = F.length("inflected")
    cut = F.when(F.col("kind") == "prefix", F.concat("base", F.substring(F.col(text), size + 1, n))).when(F.col("kind") == "whole", F.col("base"))
    made = cut.otherwise(F.concat(F.when(size > 0, F.left(F.col(text), n - size)).otherwise(F.lit("")), F.col("base")))
    return met.select(*words.columns, "transform", made.alias("made"), F.col("outer").alias("made_flags"))

"""URL filters: host-suffix and path-prefix expressions, joined to rules on short hash prefixes.

Each url becomes a host and a path. A rule is a (host, path) pair that fits its host, all subdomains and every path
that starts with its path; the longest fitting rule decides. Expressions are made only in the shapes (host labels, path
length) which rules have, so a url gives as many candidates as there are shapes, whatever its length.

Defined cases: a null url, or one without `://`, has empty host and path, fits no rule and gets the default verdict;
repeated rows are judged one by one; an empty table gives an empty result; other columns are ignored; of rules with the
same host and path but two verdicts the verdict that comes last by its letters counts, so block goes before allow.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from glossaria.llm.common import row_id


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str


PREFIX_HEX = 8  # 32 bits of the digest are the join key; the whole digest confirms


def rule_table(spark: SparkSession, rules: Sequence[Rule]) -> DataFrame:
    """host, path, verdict; `host` is lower-cased like the urls' hosts."""
    rows = [(r.host.lower(), r.path, r.verdict) for r in rules]
    return spark.createDataFrame(rows, "host string, path string, verdict string")


def host_and_path(url: Column) -> tuple[Column, Column]:
    parts = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    host = F.coalesce(F.regexp_extract(url, parts, 1), F.lit(""))
    path = F.coalesce(F.regexp_extract(url, parts, 2), F.lit(""))
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def judge_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """page_id, host, path, rule (null if none fits), verdict."""
    digest = F.sha2(F.concat("host", "path"), 256)
    book = rules.select(
        F.substring(digest, 1, PREFIX_HEX).alias("key"), digest.alias("rule_digest"),
        F.concat("host", "path").alias("rule"), F.col("verdict").alias("rule_verdict"),
    ).dropDuplicates(["rule_digest", "rule_verdict"])
    shapes = [
        (r.labels, r.length)
        for r in rules.select(F.size(F.split("host", r"\.")).alias("labels"), F.length("path").alias("length")).distinct().collect()
    ]  # at most (labels of a host name) x (lengths of rule paths), not the number of rules
    shape_list = F.array(*[F.struct(F.lit(k).alias("labels"), F.lit(m).alias("length")) for k, m in sorted(shapes)]) if shapes else F.expr("cast(array() as array<struct<labels:int,length:int>>)")

    host, path = host_and_path(F.col(url_col))
    parsed = pages.select(row_id(pages).alias("rid"), F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path")).withColumn("labels", F.split("host", r"\."))
    fitting = F.filter(shape_list, lambda s: (F.col("host") != "") & (s["labels"] <= F.size("labels")) & (s["length"] <= F.length("path")))
    tried = parsed.select("rid", "page_id", "host", "path", "labels", F.explode_outer(fitting).alias("shape"))
    expression = F.concat(
        F.concat_ws(".", F.slice("labels", -F.col("shape.labels"), F.col("shape.labels"))),
        F.substring(F.col("path"), F.lit(1), F.col("shape.length")),
    )
    tried = tried.select("rid", "page_id", "host", "path", F.sha2(expression, 256).alias("digest")).withColumn("key", F.substring("digest", 1, PREFIX_HEX))
    met = tried.join(book, "key", "left")
    confirmed = F.when(F.col("digest") == F.col("rule_digest"), F.struct(F.length("rule").alias("length"), "rule", "rule_verdict"))
    # All expressions of a row are in one task, so partial aggregation leaves one record of each row for the shuffle.
    best = met.groupBy("rid", "page_id", "host", "path").agg(F.max(confirmed).alias("best"))
    return best.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.rule_verdict", F.lit(default)).alias("verdict"))

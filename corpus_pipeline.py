"""A training-data pipeline: quality rules, line dedup, near-duplicate removal, benchmark decontamination, tokens.

Each stage takes all documents that the one before kept, as a Parquet scan, and returns those it keeps with the columns
they came with; `n_chars` follows the text. The last one returns token ids in place of the text.

Defined cases: rows are told apart by their place in the scan, so repeated rows and null ids stay rows of their own. A null
text has no words and goes with the quality rules, as does any text of under 50 words; null languages and sources are
groups of their own. Of equal lines, and of near copies, the first by id stays, null ids first, then by the place in the
scan. Texts may have any length. Columns beside those of documents pass through to the last stage, which returns them too;
names that the stages use themselves carry a prefix no table has. An empty table gives an empty result at every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from glossaria.llm import bpe, decontam, line_dedup, minhash, quality
from glossaria.llm.common import ROW, cut, of_scan, without_rows
from glossaria.llm.queries import byte_bpe_path, table


KEPT = "__glossaria_kept__"


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    docs = of_scan(docs)
    return without_rows(docs, quality.judge(docs).where(~F.col("kept")))


def lines_once(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that stand, within the edit distance, in an earlier place; a document that loses all its
    lines goes."""
    docs = of_scan(docs)
    changed = cut(line_dedup.deduplicate(docs).where(F.col("n_removed") > 0).select("rid", F.col("kept").alias(KEPT)))
    same = without_rows(docs, changed.select("rid"))  # their texts are not shuffled
    rest = docs.drop("text", "n_chars").join(changed.where(F.col(KEPT) != "").withColumnRenamed("rid", ROW), ROW)
    rest = rest.withColumns({"text": F.col(KEPT), "n_chars": F.length(KEPT).cast("long")})
    return same.unionByName(rest.select(*(F.col(f"`{c}`") for c in same.columns)))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each class of near duplicates."""
    docs = of_scan(docs)
    return without_rows(docs, minhash.near_duplicates(docs).where(~F.col("first")))


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't contaminated with benchmark items."""
    docs = of_scan(docs)
    return without_rows(docs, decontam.judge(docs, table(spark, sf_dir, "benchmark")).where("contaminated"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of the texts, their number, and the digest of what they decode to."""
    path = byte_bpe_path()
    both = bpe.decode(bpe.encode(docs, path), path)
    return both.withColumn("n_tokens", F.size("ids").cast("long")).withColumn("text_sha256", F.sha2("decoded", 256)).drop("decoded")


STAGES = [
    ("quality_rules", good),
    ("line_dedup", lines_once),
    ("near_dedup", one_of_each),
    ("decontamination", uncontaminated),
    ("bpe_encoding", tokens),
]

#: Robust estimates, similarity classes and tokens are not expressible in SQL; tests hold the stages to brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)


def queries() -> dict:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
